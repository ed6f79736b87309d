"""The registered queries over the operators of this subpackage.

Each applies its operator, with production parameters, to the whole of its
table and derives the digest columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: str, kind: str):
    """n_kind: how many structs in ``spans`` are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def _text(spans: str):
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.pii import KINDS, find_personal_data

    found = find_personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(_count("base", k) for k in KINDS), F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.packing import pack_documents

    pieces = pack_documents(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.chat import fold, read_back, render, row_events

    said = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    marked = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{marked}'), (-7L, 1L, 'assistant', '{marked}') AS v(conv_id, turn, role, text)")
    back = read_back(render(fold(row_events(said.unionByName(more)))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: The template writes 26 characters around each turn's role and text, and one more for each control string in them.
OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role0, text AS text0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, len(regexp_extract_all(role, '<\|(?:turn|text|end)\|>|</?s>|\[/?INST\]|<</?SYS>>'))
          + len(regexp_extract_all(text, '<\|(?:turn|text|end)\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS marks
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS learned,
    3 + CAST(sum(8 + length(role) + 9 + length(text) + 9 + marks) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars
FROM g
"""


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.linededup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", F.coalesce(F.size("_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"), "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.warc import plan_records, read_archives, write_archives

    manifest = write_archives(plan_records(_table(spark, sf_dir, "pages")))
    chunks = read_archives(manifest)
    return chunks.where("is_last").select(F.col("record_id").alias("page_id"), "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.secrets import scan_secrets

    found = scan_secrets(_table(spark, sf_dir, "documents"))
    counts = [_count("base", k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.decontam import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.langid import held_out, identify, learn

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pit_engine.llm.topk import integer_vectors, top_k

    vectors = integer_vectors(_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM u) q JOIN u c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_linededup": op5_linededup,
    "op6_warc": op6_warc,
    "op7_secrets": op7_secrets,
    "op8_decontam": op8_decontam,
    "op9_langid": op9_langid,
    "op10_topk": op10_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op10_topk": OP10_SQL,
}
