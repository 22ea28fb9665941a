"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, line_dedup, mixing, near_dedup, packing, pivot_search, quality, sharding, token_files, token_links, url_lists, whitening
from .scratch import Scratch


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = language_id.remainder_of_three(F.col("doc_id"))
    found = language_id.identify(_documents(spark, sf_dir), learn=rest != 1)
    held_out = F.coalesce(language_id.remainder_of_three(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: what is left of its text, whether it is kept, and its removed spans as start:length:keep_doc_id:keep_unit."""
    found = line_dedup.dedup_substrings(_documents(spark, sf_dir), unit="line")
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws(":", s["start"], s["length"], s["keep_doc_id"], s["keep_unit"])), " ")
    return found.select("doc_id", "kept", F.size("removed_spans").cast("long").alias("n_removed"), "text", spans.alias("removed_spans"))


def op3_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched on a day that their id tells, against list entries that the hosts of the table give:
    the crc32 of a host says when it is blocked, when that ends, and whether one of its folders is allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    day = lambda n: F.expr("timestamp '2024-01-01 00:00:00'") + F.make_dt_interval(n.cast("int"))
    captures = pages.select("page_id", "url", day(F.col("page_id") % 366).alias("fetched"))
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    hosts = hosts.withColumn("h", F.crc32(F.encode("pattern", "UTF-8")))
    row = lambda name, verdict, pattern, dated, action: F.struct(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), pattern.alias("pattern"), dated.alias("dated"), F.lit(action).alias("action"))
    entries = hosts.where("h % 3 = 0").select(
        F.explode(
            F.array(
                row("spam", "block", F.col("pattern"), day(F.col("h") % 200), "add"),
                row("spam", "block", F.col("pattern"), day(F.col("h") % 200 + 60 + F.col("h") % 90), "remove"),
                row("trusted", "allow", F.concat("pattern", F.lit("/fr")), day(F.col("h") % 100), "add"),
            )
        ).alias("e")
    ).select("e.*")
    return url_lists.judge(captures, entries)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), words=3, percent=85).drop("text_hash")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(_documents(spark, sf_dir))


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_documents(spark, sf_dir))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_records(_documents(spark, sf_dir), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def _crc32(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(2)
        n, crc = [len(x.as_buffer()) // 4 for x in ids], [zlib.crc32(x.as_buffer()) for x in ids]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = Scratch(spark, "tokens").path("files"), _documents(spark, sf_dir)
    token_files.write_token_files(docs, path, end_id=0)
    return token_files.read_token_files(spark, path).mapInArrow(_crc32, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def op9_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), room=1024, end_id=2)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact_dedup.exact_duplicates(_documents(spark, sf_dir))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align_documents(_documents(spark, sf_dir))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_embeddings(spark, sf_dir), components=8)


def op13_pivot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _embeddings(spark, sf_dir)
    return pivot_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


# Sentences (with the white space behind them) of lines, a private-use character at their ends; lines as groups of them.
OP2_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(replace(regexp_replace(regexp_replace(text, '([.!?])([ \t]+)', '\1\2' || chr(57345), 'g'), '([。！？][ \t]*)', '\1' || chr(57345), 'g'),
    chr(10), chr(10) || chr(57345)), chr(57345)) AS p FROM documents WHERE text IS NOT NULL AND text <> ''),
cut AS (SELECT doc_id, unnest(range(len(p))) AS k, unnest(p) AS part FROM parts),
unit AS (SELECT *, length(part) AS n, coalesce(sum(length(part)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    coalesce(sum(CASE WHEN part LIKE '%' || chr(10) THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
    trim(regexp_replace(lower(part), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
block AS (SELECT doc_id, line, string_agg(norm, ' ' ORDER BY k) AS norm FROM unit WHERE norm <> '' GROUP BY 1, 2),
whole AS (SELECT doc_id, line, (doc_id, line) <> min((doc_id, line)) OVER (PARTITION BY norm) AS whole FROM block),
first AS (SELECT doc_id, k, min((doc_id, k)) OVER (PARTITION BY norm) AS f FROM unit WHERE norm <> ''),
mark AS (SELECT u.*, coalesce(w.whole, false) AS whole, coalesce((u.doc_id, u.k) <> f, false) AS again, f[1] AS keep_doc_id, f[2] AS keep_unit
    FROM unit u LEFT JOIN first s ON s.doc_id = u.doc_id AND s.k = u.k LEFT JOIN whole w ON w.doc_id = u.doc_id AND w.line = u.line AND u.norm <> ''),
run AS (SELECT *, sum(CASE WHEN norm <> '' AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM mark),
gone AS (SELECT *, again AND (whole OR sum(CASE WHEN again THEN length(norm) ELSE 0 END) OVER (PARTITION BY doc_id, run) >= 160) AS gone FROM run),
other AS (SELECT *, sum(CASE WHEN norm <> '' AND NOT (gone AND keep_doc_id <> doc_id) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS o FROM gone),
passage AS (SELECT *, sum(CASE WHEN gone AND keep_doc_id <> doc_id THEN length(norm) ELSE 0 END) OVER (PARTITION BY doc_id, o) >= 160 AS passage FROM other),
doc AS (SELECT doc_id, count(*) FILTER (gone) AS n, coalesce(string_agg(part, '' ORDER BY k) FILTER (NOT gone), '') AS text,
    coalesce(string_agg(concat(start, ':', n, ':', keep_doc_id, ':', keep_unit), ' ' ORDER BY k) FILTER (gone), '') AS spans,
    (bool_or(norm <> '' AND NOT gone) OR NOT bool_or(norm <> '')) AND NOT bool_or(passage) AS kept FROM passage GROUP BY 1)
SELECT d.doc_id, coalesce(x.kept, true) AS kept, coalesce(x.n, 0) AS n_removed, coalesce(x.text, d.text) AS text, coalesce(x.spans, '') AS removed_spans
FROM documents d LEFT JOIN doc x ON x.doc_id = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_convolution, op2_line_dedup, op3_dated_url_lists, op4_minhash_near_dedup, op5_mix_sources, op6_tokeniser_fertility, op7_virtual_slots, op8_token_files, op9_bin_completion, op10_exact_dedup, op11_pointer_jumping, op12_bit_sliced_whitening, op13_pivot_distance)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op10_exact_dedup": OP10_SQL}
