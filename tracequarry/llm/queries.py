"""Queries over the text corpus and the artefact names for the language-model data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import encoding_repair, packing, spam, tokens
from tracequarry.runtime import cut_lineage, table


#: The names and paths in which wrong decodings are looked for.
NAMES = (("reg_values", "value_name"), ("mft_entries", "full_path"), ("shim_entries", "entry_path"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, name).select(F.lit(name).alias("rec_table"), F.col("row_id").alias("rec_id"), F.col(column).alias("value"))
        for name, column in NAMES
    ]
    values = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return encoding_repair.find_garbled(values, "value", ["rec_table", "rec_id"])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the texts that the ids of all documents decode to."""
    back = tokens.token_texts(p7_ids(spark, folder))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def p8_bins(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p8_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of all containers: every text in one piece and once, none too full, few more than the least number."""
    documents = table(spark, folder, "documents")
    counts = tokens.token_counts(documents)
    pieces = cut_lineage(packing.pack(counts))
    bins = pieces.groupBy("bin_id").agg(F.sum("n_tokens").alias("fill"))
    docs = pieces.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("placed"))
    joined = counts.where("n_tokens > 0").join(docs, "doc_id", "full")
    of_docs = joined.agg(
        F.count_if(F.col("placed").isNotNull()).alias("n_docs"),
        F.count_if(~F.col("placed").eqNullSafe(F.col("n_tokens"))).alias("n_wrong"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= 2048)).alias("n_cut"),
    )
    of_bins = bins.agg(F.count_if(F.col("fill") > 2048).alias("n_over"), (F.count("*") <= F.ceil(F.sum("fill") / 2048) * 1.01 + 1).alias("few"))
    both = of_docs.unionByName(of_bins, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents"))


QUERIES = {"p3_found": p3_found, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_bins": p8_bins, "p8_totals": p8_totals, "p9_found": p9_found}
ORACLE_SQL = {
    "p7_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_totals": "SELECT count(*) FILTER (text IS NOT NULL AND text <> '') AS n_docs, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS BIGINT) AS n_cut, CAST(0 AS BIGINT) AS n_over, true AS few FROM documents",
}
