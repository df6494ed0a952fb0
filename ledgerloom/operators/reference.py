"""Reference lists: exact lookup in priority order, rarity-weighted candidates, near spellings, spans.

Values are made distinct before lists are asked, so work grows with distinct names, and pairs only form through a shared key or word.
Lists are reference data, smaller than the rows; whether one is broadcast is left to the planner, which knows its size.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import _compacted, _folded, compact, fold, normalise, trim_to, variants, words
from ledgerloom.operators.spelling import Entries, nearest

Pools = list[tuple[str, str]]


def index(table: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """First row per folded key of a list column; blank keys are left out.  ``order`` tells which row is first (value order if none)."""
    if column not in table.columns:
        raise KeyError(column)
    keyed = table.withColumn("key", fold(normalise(column))).where("key <> ''")
    w = Window.partitionBy("key").orderBy(*([order] if order else [F.col(c) for c in table.columns]))
    return keyed.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def contains(rows: DataFrame, column: str, table: DataFrame, list_column: str) -> DataFrame:
    """Rows whose value is in the list, by folded key."""
    return rows.withColumn("__key", fold(normalise(column))).join(index(table, list_column).select(F.col("key").alias("__key")), "__key", "left_semi").drop("__key")


def values(table: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values of a list column, in code-point order."""
    return table.select(normalise(column).alias("value")).where("value <> ''").distinct().orderBy("value")


def entries(pools: Pools, tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct values of all pools: ``pool, table, column, entry``; pools that are not there are skipped."""
    out = None
    for i, (name, column) in enumerate(pools):
        if name in tables and column in tables[name].columns:
            part = tables[name].select(F.lit(i).alias("pool"), F.lit(name).alias("table"), F.lit(column).alias("column"), normalise(column).alias("entry")).where("entry <> ''").distinct()
            out = part if out is None else out.unionAll(part)
    if out is None:
        raise ValueError("none of the pools is there")
    return out


def lookup(rows: DataFrame, column: str, pools: Pools, tables: dict[str, DataFrame], markers: list[str] | None = None) -> DataFrame:
    """Find each value in the first pool that holds it: adds ``matched_name, table, column, tried``.

    First every reading of the value, pool by pool, by folded key; then, pool by pool and entry by entry, with punctuation gone and a
    qualifier of the entry after `` - `` ignored.  Both passes are equi-joins on distinct readings; the first hit is the least
    (pass, reading, pool, entry).
    """
    text = trim_to(column, markers) if markers else normalise(column)
    distinct = rows.select(F.col(column).alias("value"), text.alias("text")).distinct().withColumn("tried", variants("text"))
    read = distinct.select("value", F.posexplode("tried").alias("reading", "form")).withColumn("key", fold("form")).withColumn("bare", compact("form"))
    all_ = entries(pools, tables)
    first = Window.partitionBy("pool", "key").orderBy("entry")
    folded = all_.withColumn("key", fold("entry")).where("key <> ''").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    base = F.when(F.col("entry").contains(" - "), F.split_part("entry", F.lit(" - "), F.lit(1))).otherwise(F.col("entry"))
    bare = all_.select("*", F.explode(F.array_distinct(F.array("entry", base))).alias("part")).withColumn("bare", compact("part")).where("bare <> ''").drop("part").distinct()
    hit = ["value", "pass", "reading", "pool", "entry", "table", "column"]
    one = read.join(folded, "key").select("value", F.lit(1).alias("pass"), "reading", "pool", "entry", "table", "column")
    two = read.where("bare <> ''").select("value", "bare").distinct().join(bare, "bare").select("value", F.lit(2).alias("pass"), F.lit(0).alias("reading"), "pool", "entry", "table", "column")
    best = one.unionAll(two).groupBy("value").agg(F.min(F.struct(*hit[1:])).alias("b"))
    found = distinct.join(best, "value", "left").select("value", "tried", F.col("b.entry").alias("matched_name"), F.col("b.table").alias("table"), F.col("b.column").alias("column"))
    return rows.join(found, rows[column].eqNullSafe(found["value"]), "left").drop("value")


def entry_words(all_: DataFrame) -> DataFrame:
    """Words of every entry, each once."""
    return all_.select("*", F.explode(words(fold("entry"))).alias("word"))


def word_weights(all_: DataFrame) -> DataFrame:
    """``word, df, n, weight``: the rarer among the entries, the heavier."""
    df = entry_words(all_).groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("n", _size(all_))
    return df.withColumn("weight", F.log((F.col("n") + 1) / (F.col("df") + 1)))


def _size(all_: DataFrame) -> Column:
    return all_.agg(F.count(F.lit(1)).alias("n")).scalar()


def _summed(words_: Column) -> Column:
    return F.aggregate(words_, F.lit(0.0), lambda a, x: a + x["weight"])


def _ordered(words_: DataFrame, owner: list[str]) -> DataFrame:
    """Weighted words of each owner, heaviest first, with their total; the order is the same for all owners, as a word has one weight."""
    gathered = words_.where("weight > 0").groupBy(*owner).agg(F.sort_array(F.collect_list(F.struct("weight", "word")), asc=False).alias("ws"))
    return gathered.withColumn("total", _summed(F.col("ws")))


def _postings(owned: DataFrame) -> DataFrame:
    """A row for each word: its position ``p`` and ``tail``, the weight from it on.  Owners whose first common word it is share that much at most."""
    rows = owned.select("*", F.posexplode("ws").alias("p", "x")).select("*", F.col("x.word").alias("word")).drop("x")
    return rows.withColumn("tail", _summed(F.slice("ws", F.col("p") + 1, F.size("ws"))))


def candidate_pairs(rows: DataFrame, column: str, pools: Pools, tables: dict[str, DataFrame], limit: int = 5) -> DataFrame:
    """Pairs of a distinct value and an entry that the search has to score: ``value, pool, table, column, entry, raw``.

    The score is what both share by the heavier total.  First every value meets at most ``2 * limit`` entries per word, the shortest and the first ones; its
    ``limit``-th best of these is a floor.  Then words are taken heaviest first, and a word joins value and entry only where they can still reach that
    floor: if it is the first that both have, they share no more than the lesser of what either has from it on.  So a word of half of the entries is
    joined on by those values only whose first ``limit`` ranks it can change, and each pair forms once, at its first common word.
    """
    all_ = entries(pools, tables)
    known = word_weights(all_).select("word", "weight")
    unseen = F.log(_size(all_) + F.lit(1.0))
    entry = ["pool", "table", "column", "entry"]
    theirs = _postings(_ordered(entry_words(all_).join(known, "word"), entry))
    asked = rows.select(F.col(column).alias("value")).distinct().select("value", F.explode(words(fold("value"))).alias("word"))
    mine = _postings(_ordered(asked.join(known, "word", "left").withColumn("weight", F.coalesce("weight", unseen)), ["value"]))
    mine = mine.select("value", "word", F.col("ws").alias("mine_ws"), F.col("total").alias("mine"), F.col("p").alias("mine_p"), F.col("tail").alias("mine_tail"))

    names = lambda ws: F.transform(ws, lambda x: x["word"])
    fresh = ~F.arrays_overlap(F.slice(names(F.col("mine_ws")), F.lit(1), F.col("mine_p")), names(F.col("ws")))
    shared = _summed(F.filter("mine_ws", lambda x: F.array_contains(names(F.col("ws")), x["word"])))
    raw = (shared / F.greatest("mine", "total")).alias("raw")

    first = lambda *order: theirs.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where(F.col("k") <= limit).drop("k")
    few = first("total", "pool", "entry").unionAll(first("pool", "entry")).dropDuplicates(["word", "pool", "entry"])
    seeds = mine.join(few, "word").where(fresh).select("value", "pool", "entry", F.bround(raw, 3).alias("score"))
    best = Window.partitionBy("value").orderBy(F.desc("score"), "pool", "entry")
    floor = seeds.withColumn("k", F.row_number().over(best)).where(F.col("k") <= limit).where(F.col("k") == limit)
    floor = floor.select("value", F.col("score").alias("floor"), F.struct("pool", "entry").alias("floor_place"))

    reach = lambda bound: F.coalesce(F.bround(bound + F.lit(1e-9), 3) >= F.col("floor"), F.lit(True))
    able = mine.join(floor, "value", "left").where(reach(F.col("mine_tail") / F.col("mine"))).select(F.col("word").alias("w"), "value", "mine_ws", "mine", "mine_p", "mine_tail", "floor", "floor_place")
    bound = F.bround(F.least("mine_tail", "tail") / F.greatest("mine", "total") + F.lit(1e-9), 3)
    still = F.col("floor").isNull() | (bound > F.col("floor")) | ((bound == F.col("floor")) & (F.struct("pool", "entry") <= F.col("floor_place")))
    return able.join(theirs, (F.col("w") == F.col("word")) & still).where(fresh).select("value", *entry, raw)


def candidates(rows: DataFrame, column: str, pools: Pools, tables: dict[str, DataFrame], limit: int = 5) -> DataFrame:
    """Entries that share identifying words with each distinct value: ``value, rank, matched_name, table, column, score``.

    The score is the lesser of the weight shares of the common words on both sides; words that weigh nothing identify nothing.
    """
    scored = candidate_pairs(rows, column, pools, tables, limit).withColumn("score", F.bround("raw", 3))
    rank = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("score"), "pool", "entry"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("value", "rank", F.col("entry").alias("matched_name"), "table", "column", "score")


def resemblance(left: Column, right: Column, weights: dict[str, float], unseen: float) -> Column:
    """Share of the weight of ``left``'s words that ``right`` has too, with the weights as literals (few words)."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]) if weights else F.create_map().cast("map<string,double>")
    weigh = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(unseen)))
    mine = words(fold(left))
    total = weigh(mine)
    return F.when(F.size(mine) == 0, 0.0).otherwise(weigh(F.array_intersect(mine, words(fold(right)))) / F.when(total == 0, 1.0).otherwise(total))


#: Length bands to the factor by which the lengths of two strings may differ at most.
BANDS = 4


def close_matches(rows: DataFrame, column: str, table: DataFrame, list_column: str, limit: int = 5, cutoff: float = 0.6, block: int = 4_000) -> DataFrame:
    """Entries nearest in spelling (matching blocks ratio over folded forms): ``value, rank, matched_name, ratio``.

    A stated query set, the distinct values, meets the list by length: lengths that differ too much cannot reach the cutoff, so a value goes to the bands
    of lengths that can.  A task holds ``block`` values and ``block`` entries of a band at most (bands of more are dealt into shares), bounds the ratios from
    above by letter counts and common subsequences, and scores what can still be among a value's ``limit`` best.  How many shares a band has is counted
    in the plan; nothing runs on the driver.
    """
    factor = (2 - cutoff) / cutoff
    band = lambda n: F.floor(F.log(F.greatest(n, F.lit(1.0))) * F.lit(BANDS / math.log(factor)) + F.lit(1e-9)).cast("int")
    folded = table.select(normalise(list_column).alias("entry")).where("entry <> ''").distinct().withColumn("f", fold("entry")).groupBy("f").agg(F.max("entry").alias("entry"))
    folded = folded.withColumn("band", band(F.length("f").cast("double")))
    asked = rows.select(F.col(column).alias("value")).distinct().withColumn("g", fold("value")).withColumn("n", F.length("g").cast("double"))
    asked = asked.withColumn("band", F.explode(F.sequence(F.greatest(band(F.col("n") / factor) - 1, F.lit(0)), band(F.col("n") * factor) + 1)))
    sizes = lambda df, name: df.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    shares = sizes(folded, "shares").join(sizes(asked, "parts"), "band")  # a row per band of lengths
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = folded.join(shares, "band").withColumn("share", dealt("f", "shares")).withColumn("part", every("parts")).select("band", "share", "part", "f", "entry")
    asked = asked.join(shares, "band").withColumn("part", dealt("value", "parts")).withColumn("share", every("shares")).select("band", "share", "part", "value", "g")

    def best(values: pd.DataFrame, entries_: pd.DataFrame) -> pd.DataFrame:
        names = dict(zip(entries_["f"], entries_["entry"]))
        pool = Entries(list(names))
        out = [(value, names[f], ratio, f) for value, g in zip(values["value"], values["g"]) for ratio, f in nearest(g, pool, limit, cutoff)[0]]
        return pd.DataFrame(out, columns=["value", "matched_name", "ratio", "f"])

    at = ("band", "share", "part")
    found = asked.groupBy(*at).cogroup(blocks.groupBy(*at)).applyInPandas(best, "value string, matched_name string, ratio double, f string")
    rank = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("ratio"), F.desc("f")))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("value", "rank", "matched_name", "ratio")


def _span(narrative: str | None, name: str | None) -> str:
    """Earliest, shortest slice whose letters and digits spell ``name``.

    Folding is per character but for combining marks, so the slice grows with a cursor over the target instead of being folded anew.
    """
    text = " ".join((narrative or "").split())
    target = _compacted(name)
    if not text or not target:
        return ""
    keys = ["".join(c for c in _folded(ch) if c.isalnum()) for ch in text]
    for start, ch in enumerate(text):
        if not ch.isalnum():
            continue
        at = 0
        for end in range(start, len(text)):
            if not target.startswith(keys[end], at):
                break
            at += len(keys[end])
            if at == len(target):
                return text[start : end + 1].strip(" ,.")
    return ""


def narrative_span(narrative: Column | str, name: Column | str) -> Column:
    """The original characters of ``name`` in a narrative, or empty."""
    find = lambda a, b: pd.Series([_span(x, y) for x, y in zip(a, b)], dtype="object")

    def spans(a: pd.Series, b: pd.Series) -> pd.Series:
        return find(a, b)

    return F.pandas_udf(spans, "string")(F.col(narrative) if isinstance(narrative, str) else narrative, F.col(name) if isinstance(name, str) else name)


def answerable(questions: DataFrame, mounted: list[str]) -> DataFrame:
    """Questions with ``available``: all tables they require are mounted; and which are ``missing``."""
    have = F.array(*[F.lit(m) for m in mounted]).cast("array<string>") if mounted else F.array().cast("array<string>")
    missing = F.array_except(F.coalesce("requires", F.array().cast("array<string>")), have)
    return questions.withColumn("missing", missing).withColumn("available", F.size("missing") == 0)
