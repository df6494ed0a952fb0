"""Small documents with the cases that every operator must take, and brute-force helpers."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, bucket string, n_words string, in_x string, part string"


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Documents with nulls, blanks, long words and texts, copies, near copies, shared passages, repeated rows."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdéß中") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)) + "."
    passage, base = prose(60), prose(120)
    out: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "Two words"), (5, base), (6, base.replace(" ", "\n\t ", 5)), (7, base), (7, base)]
    words = base.split(" ")
    words[50] = "changed"
    out += [(8, " ".join(words)), (9, prose(30) + "\n" + passage), (10, passage + " " + prose(20)), (11, prose(10) + " " + passage + " " + prose(10))]
    out += [(12, "again " * 200), (13, prose(5000)), (14, "x" * 5000), (None, prose(40)), (None, None), (15, " ".join(["a b c d e f g h"] * 12)), (16, prose(34)), (17, prose(35))]
    out += [(18, "menu | home | about | contact\n" * 9), (19, "really!! now!! buy!! it!! " * 9), (20, "\x85\xa0odd　spaces\x1chere▁too <|endoftext|> é"), (-3, base)]
    out += [(100 + i, prose(rnd.randint(1, 90))) for i in range(40)]
    return out


def frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """A documents table with extra columns, some null, whose names operators might use themselves."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 == 0 else "en", "src", None if t is None else len(t), 1, "f", "b", "w", None, "p") for i, t in rows], SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
