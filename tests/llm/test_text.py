"""Quality rules, packing, scoring, segmentation."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import lm_scoring, packing, pieces, quality
from tests.llm.fixtures import frame, lower, texts, words

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def base_counts(t):
    t = t or ""
    w = words(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked), failed


def test_quality_counts_match_brute_force(spark):
    rows = quality.judge(frame(spark)).select("row.doc_id", "row.text", "q_words", "q_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_base_failed", "q_kept").collect()
    for r in rows:
        assert tuple(r[2:8]) == base_counts(r.text), r.doc_id
        assert not (r.q_kept and r.q_base_failed)
    assert len(rows) == len(texts())


def test_quality_lines(spark):
    clean = "This is an ordinary line of prose, with words and stops. No window of eight words is in it twice, so the base rules let it pass. It ends here."
    docs = [(1, clean), (2, clean + "\nhome | about | contact | shop"), (3, "word### word*** more$$$ text%%% " * 9), (4, "All rights reserved.\n" + clean), (5, "one | two | three | four five\n" * 2 + clean[:60])]
    kept = {r.doc_id: r for r in quality.keep_good(frame(spark, docs)).collect()}
    assert kept[1].text == clean and kept[2].text == clean and kept[4].text == clean and 3 not in kept
    assert kept[2].n_chars == len(clean) and kept[1].source == "src"
    assert quality.keep_good(frame(spark, docs)).columns == frame(spark, docs).columns
    assert quality.judge(frame(spark, [])).count() == 0


SCRIPTS = {
    "Burmese": "လူတိုင်းသည် တူညီ လွတ်လပ်သော ဂုဏ်သိက္ခာဖြင့် လည်းကောင်း၊ တူညီလွတ်လပ်သော အခွင့်အရေးများဖြင့် လည်းကောင်း၊ မွေးဖွားလာသူများ ဖြစ်သည်။",
    "Hindi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में (1948) जन्मजात स्वतन्त्रता और समानता प्राप्त है।",
    "Malayalam": "മനുഷ്യരെല്ലാവരും തുല്യാവകാശങ്ങളോടും അന്തസ്സോടും സ്വാതന്ത്ര്യത്തോടും കൂടി (1948) ജനിച്ചിട്ടുള്ളവരാണ് അവർ എല്ലാവരും.",
    "Chinese": "今年的产量比去年增长了百分之八,也就是8%,超过了预期。",
    "Chinese shout": "这个消息真是太好了!!",
    "Japanese": "研究&開発の予算は今年も増えました。",
    "Thai": "ยอดขายในปีนี้เพิ่มขึ้น5%จากปีก่อน",
}


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_quality_keeps_other_scripts(spark, script):
    text = "\n".join(f"{SCRIPTS[script]}{chr(0x430 + i)}" for i in range(25))
    r = quality.judge(frame(spark, [(1, text)])).first()
    assert r.q_lost_chars == 0 and r.q_text == text


def test_quality_still_removes_symbols_in_unspaced_scripts(spark):
    junk = "产量###***$$$ 增长%%%&&&|||<<<"
    assert quality.judge(frame(spark, [(1, junk), (2, "好!! 好!! 好!!")])).where("q_lost_chars < q_chars").count() == 0


def test_quality_keeps_everyday_words(spark):
    clean = ["Bake the cookies for ten minutes.", "Cookies", "JavaScript runs in every browser.", "She told them to sign in at the desk.", "He would read more at night.", "They did not follow us to the river.",
             "I subscribe to that view of the matter.", "Log in hand, he walked to the stove.", "The minister defended the privacy policy of the bank."]
    furniture = ["We use cookies to improve your visit.", "Please enable JavaScript.", "Subscribe to our newsletter!", "Sign in | Sign up", "Read more »", "Follow us", "Terms of use - Privacy policy"]
    text = "\n".join(clean)
    r = quality.judge(frame(spark, [(1, text + "\n" + "\n".join(furniture))])).first()
    assert r.q_text == text and r.q_kept


def test_quality_runs_no_python(spark):
    plan = quality.keep_good(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def check_packed(got, rows, encode, length):
    """All ids lie in one piece each, and sequences have no holes."""
    want = Counter((i, tuple([*encode(t or ""), 0])) for i, t in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id, r.sequence_id * length + r.offset - r.start].append(r)  # where the document starts in the stream
        sequences[r.sequence_id].append(r)
    seen = Counter()
    for (i, _), parts in docs.items():
        ids = []
        for r in sorted(parts, key=lambda x: x.start):
            assert r.start == len(ids) and r.length == len(r.ids) and zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32
            ids += r.ids
        assert len(ids) == parts[0].doc_tokens
        seen[i, tuple(ids)] += 1
    assert seen == want
    ends = []
    for k in sorted(sequences):
        at = 0
        for r in sorted(sequences[k], key=lambda x: x.offset):
            assert r.offset == at
            at += r.length
        ends.append(at)
    assert list(sorted(sequences)) == list(range(len(ends))) and all(e == length for e in ends[:-1]) and ends[-1] <= length


@pytest.mark.parametrize("length", [1024, 7])
def test_packing_matches_tokenizer(spark, length):
    tok = Tokenizer.from_file(BPE)
    got = packing.pack(frame(spark), BPE, length=length, with_ids=True).collect()
    check_packed(got, texts(), lambda t: tok.encode(t, add_special_tokens=False).ids, length)


def test_packing_other_tokenizer_and_empty_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(frame(spark, []), BPE).count() == 0
    assert packing._Encoder(path).ranked is None  # not a byte-level model: the tokenizer itself encodes


_bpe = Tokenizer.from_file(BPE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab1é中ß🙂 \n\t'  　\u0085\x1c.!-|"), max_size=30), max_size=6))
def test_encoding_by_pieces_is_exact(rows):
    ids, offs = packing.encode(pa.array([*rows, "", None, "<|endoftext|> a"], pa.string()), BPE, 0)
    for i, t in enumerate([*rows, "", "", "<|endoftext|> a"]):
        assert ids[offs[i] : offs[i + 1]].tolist() == [*_bpe.encode(t, add_special_tokens=False).ids, 0]


def test_scoring_counts_and_base(spark):
    rows = texts(3) + texts(4)
    tokens = [(i, words(lower(t)) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in tokens if not held(i) for w in t)
    total, types = sum(count.values()), len(count)
    for bucket in (4 << 20, 3000):
        got = lm_scoring.score(frame(spark, rows), bucket_bytes=bucket, block_bytes=5000).collect()
        want = Counter((i, held(i), len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in t), 6)) for i, t in tokens)
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def plain_em(tokens, total, types, start, rounds=3000):
    """Mixture weights from single tokens (c(v), c(v,w), c(w)), and the log likelihood of each round."""
    w, path = list(start), []
    for _ in range(rounds):
        sums, like = [0.0] * 3, 0.0
        for c, p, u in tokens:
            part = [w[0] * (p / c if c else 0.0), w[1] * u / max(1, total), w[2] / (types + 1)]
            z = sum(part)
            like += math.log(z)
            sums = [s + x / z for s, x in zip(sums, part)]
        path.append(like)
        new = [s / len(tokens) for s in sums]
        if max(abs(x - y) for x, y in zip(new, w)) < 1e-10:
            break
        w = new
    return w, path


def test_scoring_model_matches_brute_force(spark):
    """Counts and weights by plain Python, token by token; probabilities of a context sum to one."""
    rows = [(i, t) for i, t in texts(5) if i is not None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    fold = lambda i: zlib.crc32(str(i).encode()) % 10 == 1
    seq = [(i, ["<s>", *words(lower(t)), None]) for i, t in rows]
    uni, pair, ctx = Counter(), Counter(), Counter()
    funi, fpair, fctx = Counter(), Counter(), Counter()
    for i, s in seq:
        if not held(i):
            for a, b in zip(s, s[1:]):
                uni[b] += 1; pair[a, b] += 1; ctx[a] += 1  # noqa: E702
                if fold(i):
                    funi[b] += 1; fpair[a, b] += 1; fctx[a] += 1  # noqa: E702
    total, types = sum(uni.values()), len(uni)
    bucket = lambda c: min(16, int(math.log2(c + 1)))
    tokens = defaultdict(list)
    for i, s in seq:
        if fold(i):
            for a, b in zip(s, s[1:]):
                c = ctx[a] - fctx[a]
                tokens[bucket(c)].append((c, pair[a, b] - fpair[a, b], uni[b] - funi[b]))
    weights = {}
    for k in range(lm_scoring.CONTEXTS):
        start = lm_scoring.DEFAULT if k else (0.0, lm_scoring.DEFAULT[0] + lm_scoring.DEFAULT[1], lm_scoring.DEFAULT[2])
        weights[k], path = plain_em(tokens[k], total - sum(funi.values()), types, start) if tokens[k] else (start, [])
        assert all(y >= x - 1e-9 for x, y in zip(path, path[1:]))
        if tokens[k]:
            c, p, u = (np.array(x, float) for x in zip(*tokens[k]))
            got = lm_scoring.mixture(k, np.ones(len(c)), np.where(c > 0, p / np.maximum(c, 1), 0), u, total - sum(funi.values()), types)
            assert got == pytest.approx(weights[k], abs=1e-6)
    prob = lambda a, b: (lambda w: w[0] * pair[a, b] / max(ctx[a], 1) + w[1] * uni[b] / total + w[2] / (types + 1))(weights[bucket(ctx[a])])
    for a in ("<s>", "again"):
        assert abs(sum(prob(a, b) for b in uni) + weights[bucket(ctx[a])][2] / (types + 1) - 1) < 1e-6
    want = {i: sum(math.log10(prob(a, b)) for a, b in zip(s, s[1:])) for i, s in seq}
    got = Counter((r.doc_id, round(r.score, 2)) for r in lm_scoring.score(frame(spark, rows), bucket_bytes=4000).collect())
    assert len(got) and {i for i, _ in got} == set(want)
    for i, x in got:
        assert x == pytest.approx(want[i], rel=2e-3, abs=0.02)


def test_scoring_empty_table(spark):
    assert lm_scoring.score(frame(spark, [])).count() == 0


def test_keys_and_counts_round_trip():
    rnd = np.random.default_rng(2)
    for keys in (np.zeros(0, np.uint64), np.unique(rnd.integers(0, 2**64 - 1, 500, dtype=np.uint64)), np.array([0, 1, 2**64 - 1], np.uint64)):
        assert (lm_scoring.unpack_keys(lm_scoring.pack_keys(keys)) == keys).all()
    a, b = np.array([0, 1, 300]), np.array([2**40, 0, 5])
    assert all((x == y).all() for x, y in zip(lm_scoring._unpack(lm_scoring._pack(a, b), 3, 2), (a, b)))


def all_segmentations(m, text):
    t, out = pieces.SPACE + text.replace(" ", pieces.SPACE), []

    def go(i, score, ids):
        if i == len(t):
            out.append((score, tuple(ids)))
            return
        for e in range(i + 1, min(len(t), i + m.longest) + 1):
            if t[i:e] in m.piece:
                go(e, score + m.piece[t[i:e]][1], [*ids, m.piece[t[i:e]][0]])
            elif e == i + 1:
                go(e, score + m.unknown, [*ids, *(m.byte[b] for b in t[i:e].encode())])

    go(0, 0.0, [])
    return sorted(out, reverse=True)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("thein a\né①"), min_size=1, max_size=9))
def test_nbest_is_the_best_of_all(text):
    m = pieces.model(PIECES)
    (ids, scores, lists), _ = pieces.encode_column(pa.array([text, None]), m, 5)
    every = all_segmentations(m, text)
    assert scores == [s for s, _ in every[:5]] and len({*lists}) == len(lists)
    for s, x in zip(scores, lists):
        assert (s, tuple(np.frombuffer(x, "<u4").tolist())) in set(every)
    assert m.decode(np.frombuffer(ids, "<u4").tolist()).decode() == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("$%&=-ab"), min_size=1, max_size=14), min_size=1, max_size=3))
def test_nbest_with_ties(words_):
    m, text = pieces.model(PIECES), " ".join(words_)[:16]
    (ids, scores, lists), _ = pieces.encode_column(pa.array([text, None]), m, 4)
    every = all_segmentations(m, text)
    assert scores == [s for s, _ in every[:4]] and len({*lists}) == len(lists) and lists[0] == ids
    assert all((s, tuple(np.frombuffer(x, "<u4").tolist())) in set(every) for s, x in zip(scores, lists))


def test_ties_fall_the_same_way_everywhere():
    m = pieces.model(PIECES)
    (once, *_), (often, *_) = pieces.encode_column(pa.array(["And&&&", " ".join(["And&&&"] * 9)]), m, 4)
    assert often == once * 9


def test_no_list_of_best_segmentations_repeats_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pieces.encode(docs, PIECES, with_ids=True).collect()
    assert len(got) == 1000 and all(len({tuple(x) for x in r.nbest_ids}) == len(r.nbest_ids) and r.nbest_ids[0] == r.ids for r in got)


def test_a_model_that_normalises_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(open(PIECES, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="normalises"):
        pieces.model(str(tmp_path / "m.model"))


def test_pieces_round_trip(spark):
    rows = [(i, t) for i, t in texts() if "▁" not in (t or "")]
    got = pieces.encode(frame(spark, rows), PIECES, with_ids=True)
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.decoded_sha256) for r in got.collect()) == want
    back = pieces.decode(got, PIECES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in rows)
    assert all(r.nbest_scores == sorted(r.nbest_scores, reverse=True) for r in back)
    assert pieces.encode(frame(spark, []), PIECES).count() == 0


def test_columns_that_clash(spark):
    docs = frame(spark).select("*", F.lit(1).alias("row"), F.lit(2).alias("t"), F.lit(3).alias("w"), F.lit(4).alias("lines"), F.lit(5).alias("q_kept"))
    assert quality.keep_good(docs).columns == docs.columns
