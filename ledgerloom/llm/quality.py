"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own; lines that fail are removed; a document that loses too much of its text is rejected.

Line rules (a line without a word is kept as it is):

* *punctuation*: more than one symbol of ``[#*$%&|<>]`` for every two words, or ``!!``/``??`` runs for over 30 % of the
  words, or under half of its word characters are letters or their marks (vowel signs, accents) in lines of 8 words or more;
  in scripts that put no spaces between words (``UNSPACED``), each letter is as good as a word here;
* *navigation*: three or more stand-alone separators (``|``, ``>``, ``»``, ``·``, ``/``) that make up a fifth of the words;
* *boilerplate*: the line has fewer than 20 words and holds one of the phrases in ``BOILERPLATE``, or those in ``EVERYDAY`` are over half
  of its word characters.

Document rules: the base rules (fewer than ``MIN_WORDS`` words, or over 30 % of the words inside an 8-word window that
occurs twice or more in the text), then: removed lines held over ``MAX_LOST`` of the word characters.

Everything is row-local: no shuffle, no Python, and a repeated window is recognised by the 64-bit hash of its word hashes.

Edge cases: a null text has no words, is not kept and stays null; an empty text likewise; repeated rows get the same
verdict; an empty table gives an empty result; other columns pass through, and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, WINDOW, MAX_REPEATED, MAX_LOST = 20, 8, 30, 50
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
# Fixed values, in lower case: phrases that only page furniture uses, and everyday ones that are furniture where they are most of a short line.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here to subscribe", "cookie policy", "cookie settings", "enable javascript", "follow us on facebook", "follow us on instagram",
    "follow us on twitter", "javascript is disabled", "log in to comment", "lorem ipsum", "sign up for our newsletter", "subscribe to our newsletter",
    "this site uses cookies", "this website uses cookies", "we use cookies",
)
EVERYDAY = ("click here", "follow us", "log in", "privacy policy", "read more", "share this", "sign in", "sign up", "subscribe", "terms of service", "terms of use")


def _phrases(phrases: tuple[str, ...]) -> str:
    return r"(?<![\p{L}\p{M}\p{N}])(" + "|".join(phrases) + r")(?![\p{L}\p{M}\p{N}])"


GAP = r"[\x20\x09-\x0D]"


def _line_stats(line: Column) -> Column:
    """What the rules need of a line: hashes of its words, word characters, and those that are not letters."""
    return F.struct(
        line.alias("line"),
        F.transform(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("w"),
        F.length(F.regexp_replace(line, GAP + "+", "")).alias("chars"),
        F.regexp_count(line, F.lit(r"[^\p{L}\p{M}\x20\x09-\x0D]")).alias("odd"),
    )


def line_fails(s: Column) -> Column:
    """Does a line (of ``_line_stats``) break one of the rules?

    Symbols, runs and separators are among the characters that are no letters, so lines with few of those need no other pattern.
    """
    line, n, odd = s["line"], F.size(s["w"]), s["odd"]
    symbols = F.regexp_count(line, F.lit("[" + SYMBOLS + "]"))
    bangs = F.regexp_count(line, F.lit(r"[!?]{2,}"))
    wide = F.regexp_count(line, F.lit(UNSPACED))
    marks = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])[|>»·/](?![^\x20\x09-\x0D])"))
    low = F.lower(line)
    rest = F.length(F.regexp_replace(F.regexp_replace(low, _phrases(EVERYDAY), ""), GAP + "+", ""))
    furniture = low.rlike(_phrases(BOILERPLATE + EVERYDAY)) & (low.rlike(_phrases(BOILERPLATE)) | (2 * rest < s["chars"]))
    return (n > 0) & (
        ((n >= 8) & (2 * (s["chars"] - odd) < s["chars"]))
        | ((2 * odd > n) & (2 * symbols > n) & (2 * symbols > wide))
        | ((5 * odd > 3 * n) & (10 * bangs > 3 * n) & (10 * bangs > 3 * wide))
        | ((odd >= 3) & (5 * odd >= n) & (marks >= 3) & (5 * marks >= n))
        | ((n < 20) & furniture & (wide < 20))
    )


def _repeated() -> Column:
    """Words inside windows that occur twice: the windows' starts, sorted, with overlaps counted once."""
    beside = lambda i: F.get("__sorted", i)["h"]  # noqa: E731  null outside the array
    twins = F.filter("__sorted", lambda s, i: s["h"].eqNullSafe(beside(i - 1)) | s["h"].eqNullSafe(beside(i + 1)))
    ordered = F.array_sort(F.transform(twins, lambda s: s["at"]))
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("sum"), x.alias("last")),
        lambda acc: acc["sum"],
    )


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``q_words, q_chars, q_symbols, q_dup_lines, q_repeat_words, q_lost_chars, q_base_failed, q_kept, q_text``.

    ``q_text`` is the text without the lines that fail.  All columns of ``docs`` stay, in a struct ``row``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("lines", F.transform(F.split("t", "\n", -1), _line_stats))
    rows = rows.withColumn("w", F.flatten(F.transform("lines", lambda s: s["w"])))
    n = F.size("w")
    at = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))
    windows = F.when(n >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("n", n).withColumn("h", windows)
    rows = rows.withColumn("many", F.size(F.array_distinct("h")) < F.size("h"))
    # Only a text with a repeated window needs to know where.
    rows = rows.withColumn("__sorted", F.when(F.col("many"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    rows = rows.withColumn("repeat", F.when(F.col("many"), _repeated()).otherwise(F.lit(0)))
    rows = rows.withColumn("fails", F.transform("lines", line_fails))
    rows = rows.withColumn("any", F.exists("fails", lambda x: x))
    total = lambda keep: F.aggregate(F.filter("lines", keep), F.lit(0), lambda acc, s: acc + s["chars"])
    rows = rows.withColumn("chars", total(lambda s: F.lit(True))).withColumn("lost", F.when(F.col("any"), total(lambda s, i: F.get("fails", i))).otherwise(F.lit(0)))
    clean = F.array_join(F.transform(F.filter("lines", lambda s, i: ~F.get("fails", i)), lambda s: s["line"]), "\n")
    rows = rows.withColumn("clean", F.when(F.col("any"), clean).otherwise(F.col("t")))
    rows = rows.withColumn("full", F.transform(F.filter("lines", lambda s: F.size(s["w"]) > 0), lambda s: s["line"]))
    failed = (F.col("n") < MIN_WORDS) | (F.lit(100).cast("bigint") * F.col("repeat") > F.lit(MAX_REPEATED).cast("bigint") * F.col("n"))
    verdict = F.struct(
        F.col("n").cast("bigint").alias("q_words"),
        F.col("chars").cast("bigint").alias("q_chars"),
        F.regexp_count("t", F.lit("[" + SYMBOLS + "]")).cast("bigint").alias("q_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("bigint").alias("q_dup_lines"),
        F.col("repeat").cast("bigint").alias("q_repeat_words"),
        F.col("lost").cast("bigint").alias("q_lost_chars"),
        failed.alias("q_base_failed"),
        (~failed & (F.lit(100).cast("bigint") * F.col("lost") <= F.lit(MAX_LOST).cast("bigint") * F.col("chars"))).alias("q_kept"),
        F.col("clean").alias("q_text"),
    )
    # A generator, so that a filter on the verdict stays above the rules instead of being copied into each of them.
    return rows.select("row", F.inline(F.array(verdict)))


def keep_good(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """Documents that are kept, with their columns; failing lines are gone from the text (and its length follows)."""
    judged = judge(docs, text_col).where("q_kept")
    new = {text_col: F.col("q_text")}
    if count_col in docs.columns:
        new[count_col] = F.length("q_text").cast(docs.schema[count_col].dataType)
    return judged.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
