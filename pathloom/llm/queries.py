"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bpe_count import token_counts
from pathloom.llm.centroids import cluster, cluster_sql
from pathloom.llm.chat import rotate
from pathloom.llm.common import new_path, read, word_count
from pathloom.llm.language import identify, learn, remainder
from pathloom.llm.lines import dedup_lines
from pathloom.llm.mixing import assign, in_order
from pathloom.llm.neighbours import search
from pathloom.llm.packing import pack_documents
from pathloom.llm.quality import judge
from pathloom.llm.simhash import near_duplicates
from pathloom.llm.spelling import SPELLING_SQL, spelling_variants
from pathloom.llm.warc import read_back, write
from pathloom.llm.winnow import edited_likeness

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer's file is on this node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_exact", "n_near", "text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = assign(sized)
    ordered = mixed.withColumn("first_position", F.try_element_at("positions", F.lit(1))).withColumn("first_order", F.try_element_at("order", F.lit(1)))
    ordered = in_order(ordered, "first_position", "first_order", "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.drop("lang").withColumn("held_out", F.coalesce(remainder("doc_id") == 0, F.lit(False))), learn(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "archives")
    write(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_back(spark, folder)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neighbours, op2_lines, op3_mixing, op4_quality, op5_token_counts, op6_simhash, op7_perspectives, op8_language, op9_warc, op10_packing, op11_centroids, op12_spelling, op13_fingerprints, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": QUALITY_SQL, "op7_perspectives": PERSPECTIVE_SQL, "op9_warc": WARC_SQL, "op11_centroids": cluster_sql(), "op12_spelling": SPELLING_SQL}


WORD = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM win),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) x WHERE n >= 2),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) z GROUP BY r),
b AS (
  SELECT d.r, doc_id, source, t, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(cover.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cover ON d.r = cover.r),
u AS (SELECT source, t, any_value(l) AS l FROM b GROUP BY source, t),
hosts AS (SELECT source, count(*) AS docs FROM u GROUP BY source),
ln AS (SELECT source, t, unnest(l) AS x FROM u),
nl AS (SELECT source, t, trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS h,
              len(regexp_extract_all(x, '{WORD}')) AS w FROM ln),
hot AS (SELECT n.source, h FROM (SELECT source, h, count(DISTINCT t) AS c FROM nl GROUP BY source, h) n
        JOIN hosts ON n.source IS NOT DISTINCT FROM hosts.source WHERE c > 10 AND c > 0.05 * docs),
gone AS (SELECT nl.source, t, sum(w) AS n FROM nl JOIN hot ON nl.h = hot.h AND nl.source IS NOT DISTINCT FROM hot.source GROUP BY nl.source, t)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - coalesce(gone.n, 0) >= 0.3 * n_words) AS kept,
       coalesce(gone.n, 0)::BIGINT AS n_removed
FROM b LEFT JOIN gone ON b.t = gone.t AND b.source IS NOT DISTINCT FROM gone.source
"""

#: Base32 of a SHA-1 by SQL: the hex digits as bits, five at a time.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
n AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS kept FROM p),
h AS (SELECT DISTINCT hex FROM p),
bits AS (SELECT hex, string_agg(right('0000' || bin(('0x' || substr(hex, i::INT, 1))::INT), 4), '' ORDER BY i) AS b
         FROM h, range(1, 41) t(i) GROUP BY hex),
d AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (substr(b, (5 * i + 1)::INT, 1)::INT * 16 + substr(b, (5 * i + 2)::INT, 1)::INT * 8 + substr(b, (5 * i + 3)::INT, 1)::INT * 4
         + substr(b, (5 * i + 4)::INT, 1)::INT * 2 + substr(b, (5 * i + 5)::INT, 1)::INT + 1)::INT, 1), '' ORDER BY i) AS digest
      FROM bits, range(0, 32) t(i) GROUP BY hex)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM n JOIN d ON n.hex = d.hex
"""

PERSPECTIVE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, name AS perspective FROM t),
r AS (SELECT t.*, perspective, perspective = name AS mine,
        CASE WHEN perspective = name THEN '<|assistant|>' || chr(10) ELSE '<|user|>' || replace(name, '<|', '< |') || ': ' END AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM r),
o AS (SELECT *, length(segment) AS n, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, name, segment
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT conv_id, perspective, turn, name, CASE WHEN mine THEN 'assistant' ELSE 'user' END AS role, start::BIGINT AS start, n::BIGINT AS length,
       CASE WHEN mine THEN start + length(head) END::BIGINT AS mask_start, CASE WHEN mine THEN start + n - 1 END::BIGINT AS mask_end, segment
FROM o
"""
