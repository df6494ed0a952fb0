"""Registered queries against their SQL, and the pipeline against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pandas
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import quality, queries
from tests.llm.fixtures import lower, words
from tests.llm.test_dedup import alike, fingerprint, normal, shingles
from tests.llm.test_dedup import removed as brute_removed
from tests.llm.test_text import SCRIPTS
from tests.llm.test_web import plain_texts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == Counter(map(repr, cur.fetchall()))


def test_quality_verdicts_equal_sql_in_other_scripts_and_furniture(spark):
    lines = list(SCRIPTS.values()) + ["We use cookies to improve your visit.", "Please enable JavaScript.", "Read more »", "Sign in sign up log in", "Sign in | Sign up", "Cookies", "Bake the cookies.", "好!! 好!! 好!!"]
    lines += ["产量###***$$$ 增长%%%&&&|||<<<", "a#b c#d e", "well!! now!! then", "Log in hand, he walked.", "LOG IN\tto read", "sign  in", "x | y | z > w"]
    prose = "this line of plain words is here to carry the text over twenty words and it says nothing else at all today"
    rows = [(i, f"{line}\n{prose[: n]}") for i, (line, n) in enumerate((line, n) for line in lines for n in (0, 20, 200))]
    rows += [(1000 + i, "\n".join([line + " " + str(k) for k in range(25)])) for i, line in enumerate(lines)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r[0]: (r[1], r[2]) for r in quality.judge(docs).select("row.doc_id", "q_kept", "q_lost_chars").collect()}
    con = duckdb.connect()
    documents = pandas.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    sql = queries.ORACLE["op3_quality_rules"]
    lost = dict(con.execute(sql[: sql.rindex("SELECT doc_id")] + "SELECT doc_id, lost FROM y").fetchall())
    verdict = {r[0]: r[-1] for r in con.execute(sql).fetchall()}
    assert {i: (verdict[i], lost[i]) for i in verdict} == kept and len({n for _, n in kept.values()}) > 3


def test_names():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n.split("_")[0][2:]))] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, SF).collect()
    assert 0 < len(good) < docs.count()
    # Exact dedup, near-dedup and passages, by plain Python on what the rules kept.
    least = {}
    for r in good:
        key = normal(r.text)
        if key not in least or r.doc_id < least[key].doc_id:
            least[key] = r
    left = sorted(least.values(), key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in left]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    stay = [r for i, r in enumerate(left) if root[i] == i]
    cut = {i: (kept if gone else None) for i, _, gone, kept in brute_removed([(r.doc_id, r.text) for r in stay], 35)}
    texts = {r.doc_id: (r.text if cut[r.doc_id] is None else cut[r.doc_id]) for r in stay}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == want
    assert sum(r.length for r in rows) == sum(want.values())
    whole = {r.doc_id: r.ids_crc32 for r in rows if r.length == r.doc_tokens}
    for i, crc in whole.items():
        ids = tok.encode(texts[i], add_special_tokens=False).ids + [0]
        assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    assert words("a b") == ["a", "b"]


def test_stages_return_document_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_op2_query(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in table(spark, "documents")}
    ends, seen = {}, Counter()
    for r in sorted(queries.op2_packing(spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        ends[r.sequence_id] = r.offset + r.length
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) == r.ids_crc32
        seen.update((r.doc_id, r.start + k) for k in range(r.length))
    assert seen == Counter((i, k) for i, x in ids.items() for k in range(len(x))) and max(ends.values()) <= 1024 and len([e for e in ends.values() if e < 1024]) <= 1


def test_op5_query(spark):
    docs = [(r.doc_id, [*words(lower(r.text)), None]) for r in table(spark, "documents")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in docs if not held(i) for w in t)
    total, types = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.op5_lm_scoring(spark, SF).collect()}
    for i, t in docs:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(count[w] > 0 for w in t), total) and abs(r.base_score - base) < 1e-6 * max(1, -base)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better than single words on what it has not seen


def test_op7_query(spark):
    docs = table(spark, "documents")
    fps = [fingerprint(r.text) for r in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {}
    for r, x in zip(docs, root):
        least[x] = min(least.get(x, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", least[x]) for r, f, x in zip(docs, fps, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SF).collect()) == want


def test_op8_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, "pages")]
    urls = {i: u for i, u, _ in rows}
    got = queries.op8_html_extraction(spark, SF).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted(plain_texts(rows))
    assert all(r.url == urls[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_op9_query(spark):
    rows = [(r.page_id, (r.html or "").encode()) for r in table(spark, "pages")]
    first = {}
    for i, h in rows:
        if len(h) >= 100:
            first[h] = min(first.get(h, i), i)
    want = Counter((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if first.get(h, i) != i else "response", first[h] if first.get(h, i) != i else None) for i, h in rows)
    got = queries.op9_warc(spark, SF)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want


def test_op10_query(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, "documents")}
    got = queries.op10_sentencepiece(spark, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.replace("▁", " ").encode()).hexdigest() for i, t in docs.items()}
    assert all(list(r.nbest_scores) == sorted(r.nbest_scores, reverse=True) for r in got)
