"""Substring, exact and near dedup against brute force."""

import hashlib
import random
import time
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, simhash, substring_dedup
from ledgerloom.llm._storage import written
from ledgerloom.llm.components import components
from tests.llm.fixtures import frame, lower, texts, words


def removed(rows, window):
    counts = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,gram,bucket", [(35, 12, 4 << 20), (35, 12, 2000), (8, 3, 500)])
def test_substring_matches_brute_force(spark, window, gram, bucket):
    got = substring_dedup.remove_repeats(frame(spark), window=window, gram=gram, bucket_bytes=bucket, block_bytes=3000).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=repr) == removed(texts(), window)
    for r in got:
        assert sum(s.end - s.first for s in r.spans) == r.n_removed


@pytest.mark.parametrize("window,bucket", [(35, None), (8, 700)])
def test_factors_are_copies_of_their_sources(spark, window, bucket):
    """A factor's words stand at its source, another place; factors are as long as their sources agree, and cover what is removed."""
    rows = texts() + [(200, " ".join("abab" for _ in range(70))), (201, texts()[5][1][40:]), (201, texts()[5][1][40:])]
    got = substring_dedup.remove_repeats(frame(spark, rows), carry=("text",), window=window, gram=3, bucket_bytes=bucket, block_bytes=2000)
    rows_ = got.collect()
    docs = [words(r.in_text) for r in rows_]
    counts = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    for r, w in zip(rows_, docs):
        marked = set()
        for f in r.factors:
            assert f.end - f.first >= window and counts[tuple(w[f.first : f.first + window])] > 1
            marked |= set(range(f.first, f.end))
        assert marked == {k for s in r.spans for k in range(s.first, s.end)}
        assert [f.first for f in r.factors] == sorted(f.first for f in r.factors)
        assert all(a.source_first + (b.first - a.first) != b.source_first or a.source_bucket != b.source_bucket for a, b in zip(r.factors, r.factors[1:]) if b.first == a.end - window + 1)


def test_factors_point_at_equal_words():
    """One bucket, so that a source's place can be read off."""
    import pyarrow as pa

    docs = [t for _, t in texts() if t][:20] + ["x y z " * 30]
    flat = [w for t in docs for w in words(t)]
    p = substring_dedup._Parse(pa.array(docs), 10, 3)
    shared = np.unique(p.anchor)
    index = substring_dedup._Index([p], shared)
    nowhere = np.full(len(index.keys), substring_dedup.NOWHERE)
    first, end, source = substring_dedup.factors(p, shared, index, nowhere, 7)
    assert len(first) and (source >> np.uint64(32) == 7).all()
    for a, b, s in zip(first.tolist(), end.tolist(), (source & np.uint64(0xFFFFFFFF)).tolist()):
        assert a != s and flat[a:b] == flat[s : s + b - a]


def test_homes_need_both_hashes_and_another_bucket():
    keys = np.array([5, 5, 5, 9, 9, 4], np.uint64)
    sent = np.array([(3, 1), (1, 1), (0, 2), (8, 1), (2, 1), (6, 1)], substring_dedup.SENT)
    got = substring_dedup.homes(keys, sent.tobytes(), np.array([2, 1, 0, 4, 6, 0], np.int32)).tolist()
    place = lambda b, w: (b << 32) + w
    assert got == [place(1, 1), place(2, 3), 2**64 - 1, place(6, 2), place(4, 8), 2**64 - 1]


def test_words_of_one_pattern_are_not_equal(spark):
    """Words that polynomial hashes modulo 2**64 cannot tell apart."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rest = " ".join(f"w{i}" for i in range(34))
    got = substring_dedup.remove_repeats(frame(spark, [(1, f"{a} {rest}"), (2, f"{b} {rest}")])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_substring_carries_columns_and_layout(spark):
    got = substring_dedup.remove_repeats(frame(spark), carry=("lang", "bucket", "n_words", "in_x"), keep_layout=True)
    assert {"in_lang", "in_bucket", "in_n_words", "in_in_x"} <= set(got.columns)
    by = {r.doc_id: r for r in got.collect()}
    assert by[6].n_removed and by[2].kept_text == " \t\n" and by[0].kept_text == ""


def test_substring_empty_table(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_periodic_text_is_its_own_copy(spark):
    got = substring_dedup.remove_repeats(frame(spark, [(1, "a b c " * 20), (2, "a b")])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 60, 2: 0}


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("primes,huge,salted", [(exact_dedup.PRIMES, exact_dedup.HUGE, 500), ((11, 13), exact_dedup.HUGE, 500), (exact_dedup.PRIMES, 300, 1)])
def test_exact_matches_brute_force_even_with_collisions(spark, primes, huge, salted, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK", 100 if huge == 300 else exact_dedup.CHUNK)
    rows = texts()
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    least = {n: min([i for i in ids if i is not None], default=None) for n, ids in groups.items()}
    want = sorted([(i, least[normal(t)], len(groups[normal(t)]), i == least[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows], key=repr)
    got = exact_dedup.exact_duplicates(frame(spark), primes=primes, huge=huge, salted=salted).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=repr) == want
    kept = exact_dedup.drop_copies(frame(spark), primes=primes, huge=huge, salted=salted)
    assert kept.columns == frame(spark).columns
    assert sorted(map(repr, ((r.doc_id, normal(r.text)) for r in kept.collect()))) == sorted(repr((least[n], n)) for n in groups)


def test_exact_empty_table(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.drop_copies(frame(spark, [])).count() == 0


def test_fingerprints_compose(spark):
    data = np.frombuffer("compose me, chunk by chunk".encode() * 40, np.uint8)
    whole = exact_dedup.fingerprint(data, np.array([0, len(data)]))
    assert exact_dedup.fingerprint(data, np.array([0, len(data)]), chunk=17)[0] == whole[0]
    text = data.tobytes().decode()
    chunks = spark.createDataFrame([(1, a, text[a : a + 100]) for a in range(0, len(text), 100)], "k long, at long, c string")
    row = exact_dedup.combine_chunks(chunks, "k", "at", "c").first()
    assert (row.n_bytes, row.fp) == (len(data), int(whole[0]))


def fingerprint(t):
    w = words(lower(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_components(spark):
    rows = texts()
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = sorted(((i, f, least[r]) for (i, _), f, r in zip(rows, fps, root)), key=repr)
    got = simhash.near_duplicates(frame(spark)).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == want
    kept = simhash.drop_near_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("home,other", [(1 << 15, 1 << 19), (40, 100)])
def test_links_equal_brute_force_however_tiles_are_cut(spark, home, other):
    rnd = np.random.default_rng(4)
    centre = rnd.integers(0, 2**63, 40, dtype=np.int64)
    near = [int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rnd.integers(0, 63, (8, 2))]
    values = sorted({*centre.tolist(), *near, 0, -1, -2})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in components(simhash.links(fps, 3, home, other)).collect()}
    root = {v: v for v in values}
    for v in values:
        for u in values:
            if v < u and ((v ^ u) % 2**64).bit_count() <= 3:
                a, b = root[v], root[u]
                root = {k: (min(a, b) if x in (a, b) else x) for k, x in root.items()}
    assert {v: found.get(v, v) for v in values} == root


def test_components_of_a_star_and_a_chain(spark):
    star = [(0, i) for i in range(1, 300)]
    chain = [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(star + chain + [(5, 5), (7, 0)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 for i in range(61)) and len(got) == 361


def shingles(t, k=5):
    w = words(lower(t))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(seed=6, families=25):
    """Families of texts that differ in some words each, sizes from a few words to some hundred."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    out = [(None, None), (0, ""), (1, " "), (2, "one"), (3, "one"), (4, "one two")]
    for f in range(families):
        base = [word() for _ in range(rnd.choice([20, 60, 150, 400, 900]))]
        for k in range(8):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice([[word()], [], [w[at], word()]])
            out.append((10 + 10 * f + k, " ".join(w)))
    return out


@pytest.mark.parametrize("home,other", [(1 << 13, 1 << 16), (20, 30)])
def test_near_copies_against_all_pairs(spark, home, other):
    rows = edited()
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    root = list(range(len(rows)))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [b if x == a else x for x in root]
    got = {}
    for r in simhash.near_copies(frame(spark, rows), home=home, other=other).collect():
        got.setdefault((r.id, bytes(r.key)), r.component_id)
    of = {i: got[(i, hashlib.md5((t or "").encode()).digest())] for i, t in rows}
    ids = [i for i, _ in rows]
    least = {}
    for i, r in zip(ids, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    true = {i: least[r] for i, r in zip(ids, root)}
    for i in of:  # nothing is joined that does not belong together
        assert true[of[i]] == true[i]
    found = sum(of[ids[i]] == of[ids[j]] for i, j in pairs)
    assert found >= 0.97 * len(pairs) > 100
    kept = simhash.drop_near_copies(frame(spark, rows), home=home, other=other)
    assert kept.columns == frame(spark).columns and {r.doc_id for r in kept.collect()} == set(of.values()) and kept.count() == len(set(of.values()))


def test_spanning_forest_is_minimal():
    rnd = random.Random(8)
    for _ in range(40):
        n, m = rnd.randint(2, 12), rnd.randint(1, 40)
        links = [(rnd.randrange(n), rnd.randrange(n), rnd.randint(0, 9)) for _ in range(m)]
        a, b, d = (np.array(x) for x in zip(*links))
        root = list(range(n))
        want = 0
        for x, y, w in sorted(links, key=lambda e: e[2]):
            if root[x] != root[y]:
                want += w
                p, q = root[x], root[y]
                root = [q if r == p else r for r in root]
        at = simhash.spanning(a, b, d)
        assert int(d[at].sum()) == want and len(at) == n - len(set(root))


def test_majority_counts_every_bit():
    rnd = np.random.default_rng(2)
    per = np.array([0, 1, 2, 700, 0, 255, 256])
    h = rnd.integers(0, 2**64, int(per.sum()), dtype=np.uint64)
    at, want = 0, []
    for n in per.tolist():
        want.append(sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[at : at + n]) > n))
        at += n
    assert simhash.majority(h, per).tolist() == want


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, simhash.drop_near_copies, exact_dedup.drop_copies])
def test_of_repeated_rows_one_stays_and_names_may_clash(spark, drop):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "quite another text of eight words here now"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("__i", "__s", "__h", "__k", "row", "k0", "s0", "z", "id", "key", "a.b")})
    got = drop(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text, r["__i"], r["a.b"]) for r in got.collect()), key=repr) == sorted({(i, t, "__i", "a.b") for i, t in rows}, key=repr)
    assert drop(df.limit(0)).count() == 0


def test_forest_spans():
    a, b = simhash.forest(np.array([3, 5, 9], np.uint64), np.array([5, 8, 2], np.uint64))
    assert sorted(zip(a.tolist(), b.tolist())) == [(5, 3), (8, 3), (9, 2)]


def test_operators_ignore_row_order(spark):
    one = frame(spark).orderBy(F.desc("doc_id"))
    assert sorted(map(repr, simhash.near_duplicates(one).select("doc_id", "component_id").collect())) == sorted(map(repr, simhash.near_duplicates(frame(spark)).select("doc_id", "component_id").collect()))


def test_near_copies_beyond_the_radius_are_found(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, 200)] for _ in range(4)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)] + [(10 + k, " ".join([*b[:100], f"other{k}", *b[101:]])) for k, b in enumerate(base)]
    found = {r.id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), radius=0).collect()}
    assert found == {k: k % 10 for k, _ in rows}


def test_alike_sets_share_a_member_of_their_prefixes():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, 1 << simhash.PLACES)
    for n in [1, 2, 5, 9, 10, 100]:
        for lost in range(n // 5 + 1):
            for added in range(n // 4 + 1):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                b = np.unique(np.r_[rng.permutation(a)[lost:], rng.integers(0, 1 << 63, added, dtype=np.uint64)])
                both = len(np.intersect1d(a, b))
                if both < 0.8 * (len(a) + len(b) - both):
                    continue
                some, _, take = simhash.prefixes(np.r_[a, b], np.array([len(a), len(b)]), counts, 0.8)
                assert np.intersect1d(some[: take[0]], some[take[0] :]).size


def test_only_pairs_that_may_be_alike_are_held_against_their_shingles(spark):
    """Every shingle is in two texts and any two texts share a third of theirs: they meet, but in too few members of their prefixes."""
    rng = np.random.default_rng(7)
    part = [[" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)) for _ in range(2)] for _ in range(3)]
    rows = [(k, " ".join(part[p][c] for p, c in enumerate(cut))) for k, cut in enumerate([(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    node = {k: hashlib.md5(t.encode()).digest() for k, t in rows}
    n = {k: len(shingles(t)) for k, t in rows}
    named = spark.createDataFrame([(bytearray(node[k]), bytearray(node[k]), n[k]) for k in node], "node binary, root binary, n int")
    assert simhash._missed(docs, named, "text", 5, 0.8).count() == 0


@pytest.mark.parametrize("cuts", [{}, {"meet": 16, "block": 100, "held": 2000}])
def test_a_family_under_many_roots_is_linked_by_a_forest(spark, cuts):
    """120 texts that all meet at the same shingles, each under a root of its own: as many links as join what is alike, not one per pair."""
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(100)]
    rows = []
    for k in range(120):
        w = list(base)
        for at in rnd.sample(range(5, 95), 1 + k % 3):
            w[at] = f"own{k}"
        rows.append((k, " ".join(w)))
    node = {hashlib.md5(t.encode()).digest(): k for k, t in rows}
    sets = [shingles(t) for _, t in rows]
    named = spark.createDataFrame([(bytearray(x), bytearray(x), len(sets[k])) for x, k in node.items()], "node binary, root binary, n int")
    found = [(node[bytes(r.a)], node[bytes(r.b)]) for r in simhash._missed(spark.createDataFrame(rows, "doc_id long, text string"), named, "text", 5, 0.8, **cuts).collect()]
    assert all(alike(sets[a], sets[b]) >= 0.8 for a, b in found)

    def roots(links):
        root = list(range(len(rows)))
        for a, b in links:
            p, q = root[a], root[b]
            root = [min(p, q) if r in (p, q) else r for r in root]
        return root

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    assert roots(found) == roots(pairs) and 2 < len(set(roots(pairs))) < len(rows) - 20
    assert len(pairs) > 5 * len(rows)
    assert len(found) < (len(rows) if not cuts else len(pairs))


def test_parities_tell_no_alike_sets_apart():
    """All pairs of one group under different roots that are alike are in reach, however narrow the parities; each pair comes once."""
    rng = np.random.default_rng(11)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.unique(np.r_[rng.permutation(base)[lost:], rng.integers(0, 1 << 63, lost // 2, dtype=np.uint64)]) for lost in rng.integers(0, 60, 80).tolist()] + [np.zeros(0, np.uint64)]
    n = np.array([len(s) for s in sets])
    group, root = rng.integers(0, 3, len(sets)), rng.integers(0, 5, len(sets))
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    for bits in (64, 512, 1 << 13):
        p = simhash.parities(np.concatenate(sets), n, bits)
        for part in (None, rng.integers(0, 2, len(sets))):
            got = [(min(a, b), max(a, b), d) for x, y, z in simhash.in_reach(group, n, root, part, p, 0.8) for a, b, d in zip(x.tolist(), y.tolist(), z.tolist())]
            assert len(got) == len({g[:2] for g in got}) and all(n[i] + n[j] - 2 * both(i, j) >= d for i, j, d in got)
            want = {(i, j) for j in range(len(sets)) for i in range(j) if group[i] == group[j] and root[i] != root[j] and (part is None or part[i] != part[j]) and both(i, j) >= 0.8 * (n[i] + n[j] - both(i, j))}
            assert want <= {g[:2] for g in got} and len(want) > 20
    assert len(got) < 2 * len(want)
    wide = simhash.wide_parities(np.concatenate(sets), n)
    assert all((simhash.folded(w, 6) == p).all() for w, p in zip(wide, simhash.parities(np.concatenate(sets), n, 64))) and {len(w) for w in wide} == {8, 128}


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    got = written(spark.range(1000).repartition(3, "id"), "some")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and got.count() == 1000
