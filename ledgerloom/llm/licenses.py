"""License scans: notice phrases and identifier tags found by Aho-Corasick, expressions evaluated by a shunting-yard parser.

Row-local: a text is lower-cased (A-Z), split into words and read once by an automaton of all phrases, and once more, as written, by one
of all tags.  What follows a tag up to the end of its line is parsed as a license expression.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._storage import bounded_batches
from ledgerloom.llm._words import slices

# Phrases of the base rule, further notice phrases, tags, and how much the terms of a family restrict reuse (0: not at all, 1: no reuse).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "apache license": "apache", "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl",
    "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0", "general public license v2": "gpl-2.0", "general public license v3": "gpl-3.0",
    "cc0": "cc0", "public domain": "public-domain", "free and unencumbered software": "unlicense",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "proprietary and confidential": "proprietary", "may not be reproduced": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:", '"license":', "license =")
LEVELS = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0, "wtfpl": 0.0,
    "mit": 0.1, "isc": 0.1, "zlib": 0.1, "bsd": 0.1, "bsl": 0.1, "apache": 0.2, "cc-by": 0.2, "python": 0.2, "psf": 0.2,
    "mpl": 0.4, "epl": 0.4, "cddl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8,
    "cc-by-nc": 0.8, "cc-by-nd": 0.8, "proprietary": 1.0, "reserved": 1.0,
}
UNKNOWN, EXCEPTION = 0.5, 0.5
STRENGTH = {"or": 1, "and": 2, "with": 3}

_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")


def family(name: str) -> str | None:
    """The longest known family that a license id belongs to: the id itself, or its start up to a hyphen."""
    parts = name.removesuffix("+").split("-")
    return next((f for n in range(len(parts), 0, -1) if (f := "-".join(parts[:n])) in LEVELS), None)


def level(name: str) -> float:
    return LEVELS[f] if (f := family(name)) else UNKNOWN


def tokens(text: str) -> list[str]:
    """Parentheses and names of an expression, in lower case; it ends where anything else begins."""
    out, at = [], 0
    while m := _TOKEN.match(text, at):
        out.append(m[1].lower())
        at = m.end()
    return out


def evaluated(expression: list[str]) -> tuple[frozenset[str], float] | None:
    """Names and restriction of an expression by the shunting-yard algorithm; None if it is malformed.

    ``with`` binds closest, then ``and``, then ``or``; all of them to the left.  All terms of an ``and`` bind (the greater restriction), of an
    ``or`` one may be chosen (the lesser), an exception halves what its license restricts.
    """
    values: list[tuple[frozenset[str], float]] = []
    waiting: list[str] = []
    operand = True  # is one expected?

    def apply() -> None:
        op, (right, y), (left, x) = waiting.pop(), values.pop(), values.pop()
        values.append((left | right, {"and": max(x, y), "or": min(x, y), "with": x * EXCEPTION}[op]))

    for t in expression:
        if t in STRENGTH:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[t]:
                apply()
            waiting.append(t)
            operand = True
        elif t == "(":
            if not operand or waiting and waiting[-1] == "with":
                return None
            waiting.append(t)
        elif t == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand:
                return None
            values.append((frozenset([t]), level(t)))
            operand = False
    if operand or "(" in waiting:
        return None
    while waiting:
        apply()
    return values[0]


@functools.cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p, label in (NOTICES | BASE).items():
        phrases.add_word(f" {p} ", (len(p) + 1, p in BASE, label))
    for t in TAGS:
        tags.add_word(t, t)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def expressions(text: str, lowered: str) -> Iterator[tuple[str, bool, frozenset[str], float]]:
    """Expression, validity, names and restriction for each tag of a text.

    A malformed expression binds by all names in it that are known.  After other tags than the first, words may follow that are no expression: there
    only expressions of known licenses count.
    """
    for end, tag in _automata()[1].iter(lowered):
        stop = text.find("\n", end)
        found = tokens(text[end + 1 : stop if stop >= 0 else len(text)].lstrip(" \t\"'[{"))
        if not found:
            continue
        value = evaluated(found)
        names = [t for k, t in enumerate(found) if t not in STRENGTH and t not in "()" and (k == 0 or found[k - 1] != "with")]
        if tag != TAGS[0] and (value is None or not all(map(family, names))):
            continue
        known = frozenset(t for t in names if family(t))
        yield (" ".join(found), value is not None, *(value if value is not None else (known, max(map(level, known), default=0.0))))


def scan(data: bytes) -> dict:
    """All that a scan says of one text."""
    found = data.translate(_WORDS).split(b" ")
    words = [w for w in found if w]
    stream = f" {b' '.join(words).decode()} "
    n_base, first, last, base, labels, score = 0, None, None, set(), set(), 0.0
    for end, (size, is_base, label) in _automata()[0].iter(stream):
        labels.add(label)
        if is_base:
            at = end - size
            n_base += 1
            base.add(label)
            first = at if first is None or at < first else first
            last = at if last is None or at > last else last
    if b":" in data or b"=" in data:
        text = data.decode()
        stated = list(expressions(text, data.translate(_LOWER).decode()))
    else:
        stated = []
    score = max([0.0, *map(level, labels), *(x[3] for x in stated)])
    named = labels.union(*(x[2] for x in stated))
    place = lambda at: None if at is None else stream.count(" ", 0, at)
    return {
        "n_words": len(words), "n_base": n_base, "first_word": place(first), "last_word": place(last), "base_labels": sorted(base), "labels": sorted(named),
        "expressions": [{"expression": e, "valid": v, "restriction": x} for e, v, _, x in stated], "score": score,
    }


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, score`` for each row.

    ``labels`` are those of the base phrases, of further notices and of the names in license expressions; ``score`` is the greatest restriction that a
    notice or an expression states (0: none, or nothing is stated; 1: no reuse).  A null or empty text has no words and scores 0; repeated rows give
    the same row each; other columns are not looked at; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    names = T.ArrayType(T.StringType())
    made = T.StructType().add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long").add("base_labels", names).add("labels", names)
    made = made.add("expressions", T.ArrayType(T.StructType().add("expression", "string").add("valid", "boolean").add("restriction", "double"))).add("score", "double")
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *made.fields])
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.list_(pa.struct([("expression", pa.string()), ("valid", pa.bool_()), ("restriction", pa.float64())])), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [scan(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([r[f.name] for r in rows], k) for f, k in zip(made.fields, kinds)]], names=out.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def joined(labels: Column) -> Column:
    return F.array_join(labels, ",")
