"""Queries of this subpackage: one ``opN_<name>`` per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._storage import new_path
from ledgerloom.llm.exact_dedup import exact_duplicates
from ledgerloom.llm.fill_middle import fill_in_middle, restored
from ledgerloom.llm.html_text import main_text
from ledgerloom.llm.importance import importance_scores
from ledgerloom.llm.licenses import joined, license_scan
from ledgerloom.llm.lm_scoring import score
from ledgerloom.llm.packing import pack
from ledgerloom.llm.pieces import encode
from ledgerloom.llm.quality import BOILERPLATE, EVERYDAY, judge
from ledgerloom.llm.sharding import ShardStore
from ledgerloom.llm.simhash import near_duplicates
from ledgerloom.llm.substring_dedup import remove_repeats
from ledgerloom.llm.warc import archive_and_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing every 35-word passage that starts anywhere else."""
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    """The public byte-level tokenizer of the queries; the operators take any file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 1024 tokens."""
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts behind the quality rules and the verdict on every document."""
    judged = judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = {"q_words": "n_words", "q_chars": "word_chars", "q_symbols": "n_symbols", "q_dup_lines": "n_dup_lines", "q_repeat_words": "n_repeat_words"}
    names |= {"q_base_failed": "base_failed", "q_kept": "kept"}
    return judged.select(F.col("row.doc_id").alias("doc_id"), *[F.col(a).alias(b) for a, b in names.items()])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts, and the document that stays, for every document."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and interpolated log10 probability of every document."""
    return score(_table(spark, sf_dir, "documents")).drop("types")


ARRIVALS = (8, 4, 1, 1, 1, 1)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a compacted shard store holds them, after arrivals of different sizes, read from its last manifest version."""
    store = ShardStore(spark, new_path(spark, "shards"))
    docs = _table(spark, sf_dir, "documents")
    place, first = F.pmod(F.xxhash64("doc_id"), F.lit(sum(ARRIVALS))), 0
    for size in ARRIVALS:  # together they are the whole table
        store.append(docs.where((place >= first) & (place < first + size)))
        first += size
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(_table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the merged capture index."""
    index = archive_and_index(_table(spark, sf_dir, "pages"))
    return index.select(
        F.col("id").cast("bigint").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"), "url_key", F.col("time").alias("capture_time"), "history_pos",
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and N-best segmentations of every document, and the hash of the text decoded from the best."""
    import public_tokenizers

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of a tenth that looks like ``benchmark``."""
    scored = importance_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in the middle, as digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and expressions of every document, and how much they restrict reuse."""
    found = license_scan(_table(spark, sf_dir, "documents"))
    labels = joined(F.col("base_labels")).alias("base_labels"), joined(F.col("labels")).alias("labels")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *labels, "score", F.size("expressions").cast("bigint").alias("n_expressions"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_html_extraction": op8_html_extraction,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_license_scans": op13_license_scans,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
        k AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM s),
        c AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
        g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM k WHERE h IN (SELECT h FROM c)),
        u AS (SELECT d.r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
        x AS (SELECT u.r, count(g.j) AS gone, string_agg(word, ' ' ORDER BY u.j) FILTER (g.j IS NULL) AS kept
              FROM u LEFT JOIN g ON u.r = g.r AND u.j = g.j GROUP BY u.r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN x ON d.r = x.r""",
    "op3_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
        k AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS h FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
        m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM k) WHERE c > 1),
        p AS (SELECT r, sum(least(8, coalesce(i - before, 8))) AS repeated FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM m) GROUP BY r),
        l AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                     length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
                     length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
                     len(regexp_extract_all(line, '[!?]{2,}')) AS bangs,
                     len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: x IN ('|', '>', '»', '·', '/'))) AS marks,
                     length(regexp_replace(line, '[\p{L}\p{M}\x20\x09-\x0D]+', '', 'g')) AS odd,
                     length(regexp_replace(line, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+', '', 'g')) AS wide,
                     regexp_matches(lower(line), '(^|[^\p{L}\p{M}\p{N}])(@FURNITURE)([^\p{L}\p{M}\p{N}]|$)') AS furniture,
                     lower(line) <> once AS everyday,
                     length(regexp_replace(regexp_replace(once, '(^|[^\p{L}\p{M}\p{N}])(@EVERYDAY)([^\p{L}\p{M}\p{N}]|$)', '\1\3', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS rest
              FROM (SELECT *, regexp_replace(lower(line), '(^|[^\p{L}\p{M}\p{N}])(@EVERYDAY)([^\p{L}\p{M}\p{N}]|$)', '\1\3', 'g') AS once
                    FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d))),
        b AS (SELECT r, count(*) - count(DISTINCT line) AS dup,
                     coalesce(sum(chars) FILTER ((2 * symbols > n AND 2 * symbols > wide) OR (10 * bangs > 3 * n AND 10 * bangs > 3 * wide) OR (marks >= 3 AND 5 * marks >= n)
                         OR (n < 20 AND wide < 20 AND (furniture OR (everyday AND 2 * rest < chars))) OR (n >= 8 AND 2 * (chars - odd) < chars)), 0) AS lost
              FROM l WHERE n > 0 GROUP BY r),
        x AS (SELECT w.doc_id, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                     length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(b.dup, 0) AS n_dup_lines,
                     coalesce(p.repeated, 0) AS n_repeat_words, coalesce(b.lost, 0) AS lost
              FROM w LEFT JOIN b ON w.r = b.r LEFT JOIN p ON w.r = p.r),
        y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT base_failed AND 100 * lost <= 50 * word_chars AS kept
        FROM y""".replace("@FURNITURE", "|".join(BOILERPLATE)).replace("@EVERYDAY", "|".join(EVERYDAY)),
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t""",
    "op6_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op11_importance_resampling": r"""
        WITH w AS (SELECT 0 AS side, doc_id, row_number() OVER () AS r, @WORDS AS w FROM documents UNION ALL SELECT 1, NULL, NULL, @WORDS FROM benchmark),
        f AS (SELECT side, r, unnest(w) AS word FROM w),
        v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM f)),
        b AS (SELECT word, xor(list_reduce(list_transform(range(0, length(x) // 2 + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT) END),
                  lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)), 4294967295) % 10000 AS bucket FROM v),
        c AS (SELECT bucket, count_if(side = 0) AS s, count_if(side = 1) AS t FROM f JOIN b USING (word) GROUP BY bucket),
        a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
        g AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS gain FROM c, a),
        m AS (SELECT r, floor(sum(gain) / count(*)) AS weight FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
        d AS (SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                     CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) AS h FROM w LEFT JOIN m ON w.r = m.r WHERE side = 0),
        e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
        k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM e WHERE n_features >= 20),
        n AS (SELECT 10 * count(*) // 100 AS take FROM k)
        SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT take FROM n) THEN k END AS rank FROM e LEFT JOIN k ON e.r = k.r""".replace(
        "@WORDS", r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    ),
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS x FROM documents),
        h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || x[25:32] AS BIGINT) % 100 AS f FROM d),
        p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN f < 50 THEN 'spm' ELSE 'psm' END AS form,
                     array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM h)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p""",
}
