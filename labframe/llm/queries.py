"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labframe.llm import align, ann, bpe, chat, lines, mixing, packing, quality, resample, sharding, simhash, substrings, warc
from labframe.llm.common import materialize, read_table, scratch_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    shared = materialize(warc.shared_payloads(pages), "payloads")
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, shared, path)
    return warc.page_digests(warc.read_archives(spark, path))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     m AS (SELECT *, strlen(h) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY h) AS again, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM m
"""


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_documents(docs).drop("kept_text")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.expand(rows.unionByName(more)))


OP3_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, 24 + length(role) + (length(role) - length(replace(replace(role, chr(92), ''), chr(10), '')))
           + (length(role) - length(replace(role, '<|', ''))) // 2
           + length(text) + (length(text) - length(replace(text, chr(92), ''))) + (length(text) - length(replace(text, '<|', ''))) // 2 AS chars
  FROM c
), g AS (
  SELECT *, sum(chars) OVER w AS so_far, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(so_far) FILTER (role = 'assistant' OR back = 1)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR back = 1) AS n_examples
FROM g GROUP BY conv_id
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), o AS (
  SELECT *, 3.0::DOUBLE * n / w AS ratio,
         (sum(n) OVER () - 3 * coalesce(sum(n) OVER (ORDER BY 3.0::DOUBLE * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(w) OVER (ORDER BY 3.0::DOUBLE * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, n, CASE WHEN level > ratio THEN 3.0::DOUBLE * n ELSE (SELECT arg_min(level, ratio) FROM o WHERE level <= ratio) * w END AS target FROM o
), b AS (
  SELECT *, CASE WHEN n = 0 THEN 1 ELSE least(3, floor(target / n)) END AS whole FROM t
), g AS (
  SELECT d.source, d.h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY d.h) - sum(size) AS before
  FROM d GROUP BY d.source, d.h
), e AS (
  SELECT b.source, arg_max(g.h, g.h) AS h, arg_max(g.n, g.h) AS n, arg_max(g.before, g.h) AS before
  FROM b JOIN g ON g.source IS NOT DISTINCT FROM b.source AND g.before <= b.target - b.whole * b.n GROUP BY b.source
), r AS (
  SELECT b.*, CASE WHEN b.n = 0 OR b.whole >= 3 OR b.target - b.whole * b.n <= 0 THEN 0
                   ELSE e.h + CASE WHEN e.n - (b.target - b.whole * b.n - e.before) < b.target - b.whole * b.n - e.before THEN 1 ELSE 0 END END AS threshold
  FROM b LEFT JOIN e ON e.source IS NOT DISTINCT FROM b.source
)
SELECT d.doc_id, d.size, r.n AS source_size, r.target, (d.size * (r.whole + CASE WHEN d.h < r.threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source
"""


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align_documents(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_LEVEL))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resample.resample(docs.select("doc_id", "text"), target.select("text")).drop("n_words")


def _crc_table() -> list[int]:
    """What CRC-32 adds for each value of a byte, from its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
gf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM g),
h AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, TABLE[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM gf)
), s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM gf JOIN h USING (f) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS s_all, (SELECT count(*) FROM gf)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), n),
x AS (SELECT r, count(*) AS n_features, sum(gain) AS total FROM df JOIN h USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
    weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN x USING (r)
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * count(*) FILTER (n_words >= 20) OVER () // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id) AS place FROM scored)
""".replace("TABLE", str(_crc_table()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc, "op2_substrings": op2_substrings, "op3_chat": op3_chat, "op4_mixing": op4_mixing, "op5_quality": op5_quality, "op6_ann": op6_ann, "op7_sharding": op7_sharding,
        "op8_lines": op8_lines, "op9_bpe": op9_bpe, "op10_simhash": op10_simhash, "op11_align": op11_align, "op12_packing": op12_packing, "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_chat": OP3_SQL, "op4_mixing": OP4_SQL, "op13_resample": OP13_SQL}
