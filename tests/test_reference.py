"""Searches of reference lists against plain versions: candidates by words, nearest spellings."""

import difflib
import math
import random
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.catalog import ORACLE, QUERIES
from ledgerloom.functions.text import _folded
from ledgerloom.operators import reference
from ledgerloom.operators.spelling import Entries, nearest

NAME = lambda rnd, n: "".join(rnd.choice("aaabceeeghiiklmnooprsttuvy") for _ in range(n))


def plain_candidates(values, pools, limit):
    """Score of every pair by the rule, best ``limit`` per value."""
    words = lambda t: list(dict.fromkeys(w for w in ("".join(c for c in p if c.isalnum()) for p in _folded(t).split(" ")) if w))
    entries = [(i, e) for i, pool in enumerate(pools) for e in sorted(set(pool))]
    of = {x: words(x[1]) for x in entries}
    df = Counter(w for ws in of.values() for w in ws)
    weight = lambda w: math.log((len(entries) + 1) / (df[w] + 1)) if w in df else math.log(len(entries) + 1)
    out = {}
    for v in set(values):
        mine = words(v)
        total = sum(map(weight, mine)) or 1.0
        scored = []
        for x, theirs in of.items():
            shared = sum(weight(w) for w in mine if w in theirs)
            raw = min(shared / total, shared / (sum(map(weight, theirs)) or 1.0))
            if raw > 0:
                scored.append((-round(raw, 3), *x))
        out[v] = sorted(scored)[:limit]
    return {v: [(e, -s) for s, _, e in rows] for v, rows in out.items() if rows}


def test_candidates_equal_the_plain_rule_and_skip_common_words(spark):
    rnd = random.Random(3)
    rare = [NAME(rnd, 6) for _ in range(300)]
    first = [f"Holding {rare[k % 300]} {rnd.choice(rare)}" for k in range(1200)] + ["Holding", "holding HOLDING", "Échanges holding SA"]
    second = [f"{rnd.choice(rare)} Fund {rnd.choice(['I', 'II', 'III'])}" for _ in range(600)] + ["Holding"]
    values = [f"{rnd.choice(rare)} holding" for _ in range(60)] + ["holding", "holding unseen", "unseen", "", None, "fund iii", "echanges"] + [f"{rnd.choice(rare)} {rnd.choice(rare)} fund" for _ in range(40)]
    tables = {"a": spark.createDataFrame([(x,) for x in first], "n string"), "b": spark.createDataFrame([(x,) for x in second], "n string")}
    pools = [("a", "n"), ("b", "n")]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = {}
    for r in reference.candidates(rows, "v", pools, tables).orderBy("value", "rank").collect():
        got.setdefault(r.value, []).append((r.matched_name, r.score))
    want = plain_candidates([v for v in values if v is not None], [first, second], 5)
    near = lambda a, b: [x[0] for x in a] == [x[0] for x in b] and all(abs(x[1] - y[1]) <= 0.001 for x, y in zip(a, b))
    assert {v: (got.get(v), want[v]) for v in want if not near(got.get(v, []), want[v])} == {} and got.keys() == want.keys()
    pairs = reference.candidate_pairs(rows, "v", pools, tables)
    formed = pairs.count()
    assert formed == pairs.select("value", "pool", "entry").distinct().count()
    holding = sum("holding" in _folded(v or "") for v in set(values)) * len(set(first))
    assert formed < 0.05 * holding  # the word of two thirds of all entries is hardly ever joined on


def test_candidates_equal_sql_at_sf_0_1(spark):
    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    cur = con.execute(ORACLE["candidates_topk"])
    names = [d[0] for d in cur.description]
    assert Counter(tuple(r[c] for c in names) for r in QUERIES["candidates_topk"](spark, sf).collect()) == Counter(cur.fetchall())


def plain_nearest(value, pool, limit, cutoff):
    matcher = difflib.SequenceMatcher()
    matcher.set_seq2(value)
    scored = []
    for f in pool:
        matcher.set_seq1(f)
        if (ratio := matcher.ratio()) >= cutoff:
            scored.append((ratio, f))
    return sorted(scored, reverse=True)[:limit]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcé中𝔘 ", max_size=12), min_size=1, max_size=12, unique=True), st.text(alphabet="abcdé中𝔘 ", max_size=12), st.sampled_from([0.0, 0.3, 0.6, 0.9, 1.0]), st.integers(1, 4))
def test_nearest_equals_the_plain_scan(pool, value, cutoff, limit):
    assert nearest(value, Entries(pool), limit, cutoff)[0] == plain_nearest(value, pool, limit, cutoff)


def test_nearest_of_long_strings():
    rnd = random.Random(5)
    pool = [NAME(rnd, n) for n in (0, 1, 63, 64, 65, 200, 260, 300)] + ["ab" * 150]
    for value in [pool[2][:60], pool[3], pool[4] + "x", pool[5][5:], "ab" * 140, "", "b"]:
        assert nearest(value, Entries(pool), 3, 0.5)[0] == plain_nearest(value, pool, 3, 0.5)


def test_close_matches_equal_the_plain_scan_and_score_few_pairs(spark):
    rnd = random.Random(6)
    names = sorted({" ".join(NAME(rnd, rnd.randint(3, 9)).title() for _ in range(rnd.randint(1, 3))) for _ in range(1500)})
    typo = lambda s: "".join(c for c in s if rnd.random() > 0.06) + rnd.choice(["", "s", " Ltd"])
    values = [typo(rnd.choice(names)) for _ in range(250)] + ["", "zz", names[0], names[1].upper(), None]
    table = spark.createDataFrame([(n,) for n in names + [names[5].upper(), " "]], "n string")
    got = {}
    for r in reference.close_matches(spark.createDataFrame([(v,) for v in values], "v string"), "v", table, "n", block=300).orderBy("value", "rank").collect():
        got.setdefault(r.value, []).append((r.ratio, _folded(r.matched_name)))
    pool = {_folded(n) for n in names}
    want = {v: found for v in set(values) if (found := plain_nearest(_folded(v), pool, 5, 0.6))}
    assert got == want
    block = Entries(sorted(pool))
    assert sum(nearest(_folded(v), block, 5, 0.6)[1] for v in set(values)) < 0.05 * len(set(values)) * len(pool)


def test_close_matches_of_empty_sides(spark):
    some, none = spark.createDataFrame([("abc",)], "n string"), spark.createDataFrame([], "n string")
    assert reference.close_matches(some, "n", none, "n").count() == 0 and reference.close_matches(none, "n", some, "n").count() == 0
    assert reference.candidates(none, "n", [("t", "n")], {"t": some}).count() == 0
    assert reference.candidates(some, "n", [("t", "n")], {"t": none}).count() == 0
    assert [r.matched_name for r in reference.candidates(some.withColumn("n", F.lit("abc x")), "n", [("t", "n")], {"t": some.unionAll(spark.createDataFrame([("d",)], "n string"))}).collect()] == ["abc"]
