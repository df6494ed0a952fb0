"""Importance resampling, fill-in-middle and license scans against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import fill_middle, importance, licenses, queries
from tests.llm.fixtures import frame, lower, texts

SF = "/root/testdata/sf0.001"
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# Importance resampling


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 9), st.randoms(use_true_random=False))
def test_crc_of_spans(data, times, rnd):
    raw = np.frombuffer(data * times, np.uint8)
    spans = [sorted(rnd.sample(range(len(raw) + 1), 2)) for _ in range(20)]
    start, end = np.array(spans).T
    assert importance.crc32_spans(raw, start, end).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in spans]


def test_crc_of_long_spans(monkeypatch):
    raw = np.random.default_rng(3).integers(0, 256, 300_000, dtype=np.uint8)
    sizes = [1, 255, 256, 257, 511, 512, 513, 65_535, 65_536, 65_537, 299_999]
    end = np.full(len(sizes), len(raw))
    want = [zlib.crc32(raw[-n:].tobytes()) for n in sizes]
    assert importance.crc32_spans(raw, end - sizes, end).tolist() == want
    monkeypatch.setattr(importance, "RUN", 1000)
    assert importance.crc32_spans(raw, end - sizes, end).tolist() == want
    assert importance.crc32_spans(raw, end[:0], end[:0]).tolist() == []


def brute_scores(docs, target, low=1, high=1, buckets=10_000, seed=2024, percent=10, least=20):
    words = lambda t: LETTERS.findall(lower(t))
    grams = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in side for g in grams(x)) for side in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        g = grams(x)
        weight = sum(gain[bucket(y)] for y in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("options", [{}, {"low": 1, "high": 3, "percent": 50}, {"low": 2, "high": 2, "buckets": 97, "percent": 100, "least_words": 0}])
def test_scores_equal_brute_force(spark, options):
    rows = texts(5) + [(500 + k, " ".join(f"w{(k * j) % 13}" for j in range(30))) for k in range(40)] + [(700, "x" * 70_000 + " y"), (700, "same id, other text " * 9)]
    target = [(0, "w1 w2 w3 again"), (1, None), (2, "again a b c d e"), (3, "")]
    got = importance.importance_scores(frame(spark, rows), frame(spark, target), **options)
    brute = {("least" if k == "least_words" else k): v for k, v in options.items()}
    assert Counter(map(tuple, got.collect())) == brute_scores(rows, [t for _, t in target], **brute)


def test_scores_with_ties_repeats_and_null_ids(spark):
    rows = [(7, "one two three " * 9)] * 30 + [(None, "one two three " * 9)] * 20 + [(k, "four five six " * 9) for k in range(60)]
    got = importance.importance_scores(frame(spark, rows), frame(spark, [(1, "one two")]), percent=40).collect()
    assert Counter(map(tuple, got)) == brute_scores(rows, ["one two"], percent=40)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 45))


def test_scores_of_empty_tables(spark):
    empty, some = frame(spark, [(1, "a")]).where("false"), frame(spark, [(1, "a b " * 20)])
    assert importance.importance_scores(empty, some).count() == 0
    assert [tuple(r)[:4] for r in importance.importance_scores(some, empty).collect()] == [(1, 40, 40, brute_scores([(1, "a b " * 20)], []).popitem()[0][3])]


def test_resample_keeps_columns_and_prefers_the_target(spark):
    rows = [(k, ("alpha beta gamma " if k % 2 else "delta epsilon zeta ") * 10) for k in range(400)]
    docs = frame(spark, rows)
    got = importance.resample(docs, frame(spark, [(1, "alpha beta gamma " * 30)]), percent=25)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == 100 and sum(i % 2 for i in ids) > 80


# Fill-in-middle


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.sampled_from([0, 1, 100, 8000]))
def test_rank_index_is_exact_and_bounded(steps, error):
    places = np.cumsum([0, *steps])
    index = fill_middle.RankIndex(places, error)
    ranks = np.arange(len(places))
    assert index.place(ranks).tolist() == places.tolist()
    assert np.abs(index.residual.astype(int)).max() <= error + 1
    assert fill_middle.RankIndex(np.arange(0, 10_000, 7), error).first.tolist() == [0]  # even bounds are one segment
    with pytest.raises(ValueError):
        fill_middle.RankIndex(places, 1 << 15)


def brute_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def odd_lines(n=150):
    rnd = random.Random(8)
    alphabet = ["a", "é\n", "\n", "𝔘", " ", "<", "P>", "\r\n", "\x85", " ", "\x0b", "中" * 50, "<P"]
    rows = [(1000 + k, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))) for k in range(n)]
    return rows + [(5000, "line\n" * 20_000), (5001, "z" * 200_000), (5002, "a<P>b\n"), (5003, "<S>"), (5004, "x\n<M>"), (5005, "\n"), (5006, "<p>\n< P>\n<M")]


@pytest.mark.parametrize("options", [{}, {"seed": 1, "rate": 40, "spm": 10}])
def test_fill_in_middle_equals_brute_force(spark, options):
    rows = texts() + odd_lines()
    got = fill_middle.fill_in_middle(frame(spark, rows), carry=("lang", "n_words"), **options)
    back = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(got.output, got.form).alias("back"), "in_n_words").collect()
    assert Counter(tuple(r)[:6] for r in back) == Counter(brute_fim(*r, **options) for r in rows)
    assert Counter((r.doc_id, r.back) for r in back) == Counter((i, t or "") for i, t in rows) and {r.in_n_words for r in back} == {"w"}
    assert len({r.form for r in back}) == 3


def test_fill_in_middle_of_an_empty_table_and_other_sentinels(spark):
    assert fill_middle.fill_in_middle(frame(spark).where("false")).count() == 0
    got = fill_middle.fill_in_middle(frame(spark, [(k, "a\nb <P>\nc\n" * 3) for k in range(20)]), sentinels=("[p]", "[s]", "[m]"))
    rows = got.select("form", fill_middle.restored(got.output, got.form, ("[p]", "[s]", "[m]")).alias("t")).collect()
    assert {r.t for r in rows} == {"a\nb <P>\nc\n" * 3} and {r.form for r in rows} == {"psm", "spm"}


# License scans


def brute_expression(tokens):
    """Names and restriction by recursive descent, or None."""
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def chain(op, below, pick):
        nonlocal at
        value = below()
        while value is not None and peek() == op:
            at += 1
            other = below()
            value = None if other is None else (value[0] | other[0], pick(value[1], other[1]))
        return value

    def atom():
        nonlocal at
        t = peek()
        if t == "(":
            at += 1
            value = disjunction()
            if value is None or peek() != ")":
                return None
            at += 1
            return value
        if t is None or t in ("and", "or", "with", ")"):
            return None
        at += 1
        return frozenset([t]), licenses.level(t)

    def exception():
        nonlocal at
        value = atom()
        while value is not None and peek() == "with":
            at += 1
            t = peek()
            if t is None or t in ("and", "or", "with", "(", ")"):
                return None
            at += 1
            value = (value[0] | {t}, value[1] * licenses.EXCEPTION)
        return value

    conjunction = lambda: chain("and", exception, max)
    disjunction = lambda: chain("or", conjunction, min)
    value = disjunction()
    return value if at == len(tokens) else None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["mit", "gpl-2.0-only", "odd", "cc0-1.0", "and", "or", "with", "(", ")"]), max_size=9))
def test_expressions_equal_recursive_descent(tokens):
    assert licenses.evaluated(tokens) == brute_expression(tokens)


@pytest.mark.parametrize(
    "text,names,level",
    [
        ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.1), ("mit and (gpl-2.0+ or Apache-2.0)", {"mit", "gpl-2.0+", "apache-2.0"}, 0.2),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only", "classpath-exception-2.0"}, 0.35), ("AGPL-3.0 AND LicenseRef-odd", {"agpl-3.0", "licenseref-odd"}, 0.8),
        ("CC-BY-NC-SA-4.0", {"cc-by-nc-sa-4.0"}, 0.8), ("MIT OR GPL-2.0 AND AGPL-3.0", {"mit", "gpl-2.0", "agpl-3.0"}, 0.1),
    ],
)
def test_expression_values(text, names, level):
    assert licenses.evaluated(licenses.tokens(text)) == (frozenset(names), level)


@pytest.mark.parametrize("text", ["", "mit or", "or mit", "mit gpl", "(mit", "mit)", "mit with (gpl)", "()", "mit and and gpl"])
def test_malformed_expressions(text):
    assert licenses.evaluated(licenses.tokens(text)) is None


def brute_scan(text):
    text = text or ""
    words = LETTERS.findall(lower(text))
    hits = [(i, p, label) for p, label in (licenses.NOTICES | licenses.BASE).items() for q in [p.split(" ")] for i in range(len(words)) if words[i : i + len(q)] == q]
    base = [(i, label) for i, p, label in hits if p in licenses.BASE]
    labels, score = {h[2] for h in hits}, max([0.0, *(licenses.level(h[2]) for h in hits)])
    n = 0
    for m in re.finditer(r"(?=(spdx-license-identifier:|license-expression:|\"license\":|license =)[ \t\"'\[{]*([^\n]*))", text, re.I | re.A):
        part = re.match(r"(\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*))*", m[2])[0]
        tokens = [x.lower() for x in re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", part)]
        names = [t for k, t in enumerate(tokens) if t not in ("and", "or", "with", "(", ")") and (k == 0 or tokens[k - 1] != "with")]
        value = brute_expression(tokens)
        known = [t for t in names if licenses.family(t)]
        if not tokens or m[1].lower() != "spdx-license-identifier:" and (value is None or len(known) < len(names)):
            continue
        n += 1
        labels |= value[0] if value else set(known)
        score = max([score, value[1]] if value else [score, *map(licenses.level, known)])
    at = [i for i, _ in base]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, n


NOTICES = [
    "Licensed under CC BY-NC 4.0.", "CC BY cc by, CC-BY", "This is the GNU General Public License, version 3.", "All rights\nreserved. All rights reserved", "Released under the MIT License.",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "// spdx-license-identifier: MIT OR OR", 'x "license": "MIT AND ISC",', '"license": "see the file"',
    "license = 'BSD-3-Clause'", "license =", "SPDX-License-Identifier: LicenseRef-x SPDX-License-Identifier: mit", "Lesser General Public License v3", "ALL RİGHTS RESERVED", "general public license" * 3, "éall rights reserved",
    "cc0 public domain", "SPDX-License-Identifier:", "SPDX-License-Identifier: GPL-2.0+ */ MIT", "License-Expression: MIT or (isc", "cc by sa nc", "cc by cc by cc by",
]


def test_license_scan_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = texts() + [(2000 + k, x) for k, x in enumerate(NOTICES)] + [(3000 + k, " ".join(rnd.choice(NOTICES) + rnd.choice(["\n", " ", ". "]) for _ in range(6))) for k in range(60)]
    rows += [(4000, "cc by " * 30_000), (4001, "\n".join(NOTICES) * 200)]
    docs = frame(spark, rows)
    got = licenses.license_scan(docs)
    got = got.select("doc_id", "n_words", "n_base", "first_word", "last_word", licenses.joined(got.base_labels), licenses.joined(got.labels), "score", "expressions").collect()
    assert Counter((*tuple(r)[:8], len(r.expressions)) for r in got) == Counter((i, *brute_scan(t)) for i, t in rows)
    assert licenses.license_scan(docs.where("false")).count() == 0


def test_op13_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op13_license_scans(spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, *brute_scan(r.text)) for r in docs)
    assert any(r.n_base for r in got) and len({r.score for r in got}) > 3
