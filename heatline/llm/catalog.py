"""The training-data operators as queries on the driver tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatline.llm import (
    conversations,
    decontaminate,
    languages,
    licenses,
    mixing,
    nearest,
    packing,
    repeats,
    simhash,
    token_files,
    toxicity,
    warc,
    whitening,
)
from heatline.llm.batches import id_crc, prepared
from heatline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_license_scan", licenses.scan_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document by their sentences."""
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", id_crc("doc_id") % 3 == 1
    )
    model = languages.train(docs.filter(~F.col("held_out")))
    return languages.predict(docs, model, keep=["doc_id", "held_out"])


@query("op3_repeated_bytes")
def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its repeated 200-byte strings."""
    return repeats.removals(table(spark, sf_dir, "documents"), 200)


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, from the files they were written to."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-files")
    token_files.write(docs, path, "word_bpe_49k.json", end_id=1)
    return token_files.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op5_warc_derivatives", warc.derivatives_sql())
def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    records = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return records.withColumnRenamed("key", "page_id").drop("warc_header")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_crc("doc_id") % 4 == 2)
    labels = table(spark, sf_dir, "labels").filter(id_crc("doc_id") % 4 != 2)
    labelled = toxicity.labelled_texts(docs.filter(~F.col("held_out")), labels)
    model = toxicity.train(docs, labelled, copies="copies")
    return toxicity.score(docs, model, keep=["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int")
    )


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, most_bits=2)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place."""
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, "byte_bpe_50k.json", end_id=0, capacity=2048)


_WORDS_SQL = r"""regexp_extract_all(
  translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op9_decontamination",
    f"""
WITH items AS (SELECT item_id, {_WORDS_SQL.format("text")} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, list_slice(ws, i, i + least(len(ws), 10) - 1) AS w
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS_SQL.format("text")}, []) AS ws FROM documents),
spots AS (
  SELECT doc_id, i, m, list_slice(ws, i, i + m - 1) AS w
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT m FROM windows))),
found AS (SELECT doc_id, i, s.m, item_id FROM spots s JOIN windows v ON s.m = v.m AND s.w = v.w),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word passages of the benchmark."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items, 10).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op10_exact_top_k",
    """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0 AND NOT isnan(x)) AS bits
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
        len(list_filter(range(1, len(q.bits) + 1), lambda i: q.bits[i] <> v.bits[i])) AS distance
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, neighbor_id, CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 10""",
)
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every hundredth vector among all others."""
    codes = nearest.sign_codes(table(spark, sf_dir, "embeddings"))
    queries = codes.filter("id % 100 = 0").select(F.col("id").alias("q"), "code")
    return nearest.top_k(codes, queries, 10).select(
        F.col("q").alias("query_id"), F.col("id").alias("neighbor_id"), "distance", "rank"
    )


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after a planned damage."""
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.summaries(conversations.repair(rows, copies="copies"))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen whitened components of every vector."""
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whitened(rows, whitening.fit(rows), keep=["vec_id"])


@query("op13_source_mix", mixing.mix_sql())
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix with target weights takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")
