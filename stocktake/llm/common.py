"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.operators.ordering import numbered
from stocktake.sources.scratch import new_folder, settle, shared_dir

__all__ = ["WORD", "n_words", "new_folder", "own_ids", "row_keys", "settle", "shared_dir", "small_batches", "table", "width", "with_facts"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts may be very long, so an Arrow batch of whole texts takes few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with the one row of facts that has their keys; facts(n): how many rows have these keys, total: how many rows there are.

    Keys of more than a small share of the rows would each be one task's work. There are
    at most 4 of them for each shuffle partition, because they hold that share each, so they are
    broadcast and their rows stay where they are. The others are joined as usual.
    """
    most = max(1, total // (4 * width(rows.sparkSession)))
    hot = F.broadcast(facts.filter(F.col(n) > most))
    rest = rows.join(hot.select(keys), keys, "left_anti").join(facts.filter(F.col(n) <= most), keys)
    return rows.join(hot, keys).unionByName(rest)


def _id_counts(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The doc_ids that several rows of docs have; how many they are, and how many rows have none."""
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = settle(counts.filter("doc_id is null or n > 1"), "ids")
    row = repeated.agg(F.count("doc_id").alias("ids"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without")).first()
    return repeated.filter("doc_id is not null").select("doc_id"), row["ids"], row["without"]


def _in_order(rows: DataFrame, *first: F.Column) -> DataFrame:
    """rows with __place, from 1, by `first` and then by text; only rows that are equal there can change places."""
    rows = settle(rows.withColumn("__m", F.monotonically_increasing_id()), "rows")
    return numbered(rows, [*first, F.xxhash64("text"), F.col("__m")], "__place").drop("__m")


def row_keys(docs: DataFrame) -> DataFrame:
    """doc, nth, text: a key for each document of docs(doc_id long, text), ordered as doc_ids are, null ones first.

    Rows without a doc_id are documents of their own (nth below 0), rows of one doc_id
    are told apart by their text, and share a key if that is equal.
    """
    repeated, ids, without = _id_counts(docs)
    keyed = docs.filter("doc_id is not null").select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("nth"), "text")
    if ids:
        marked = keyed.join(repeated.select(F.col("doc_id").alias("doc"), F.lit(True).alias("__more")), "doc", "left")
        keyed = marked.select("doc", F.when(F.col("__more"), F.shiftrightunsigned(F.xxhash64("text"), 1)).otherwise(F.col("nth")).alias("nth"), "text")
    if without:
        alone = _in_order(docs.filter("doc_id is null").select("doc_id", "text"))
        keyed = keyed.unionByName(alone.select(F.lit(-(2**63)).alias("doc"), (F.col("__place") - without - 1).alias("nth"), "text"))
    return keyed


def own_ids(docs: DataFrame, out: str = "__id") -> DataFrame:
    """docs(doc_id, text, ...) with a doc_id that no other row has; out: the one that the row came with.

    A doc_id that one row has stays; of rows that share one, the first by text keeps
    it. The others, and rows without any, get numbers beyond those in use.
    """
    docs = docs.withColumns({out: F.col("doc_id"), "doc_id": F.col("doc_id").cast("long")})
    repeated, ids, without = _id_counts(docs)
    if not ids and not without:
        return docs
    of = docs.filter("doc_id is null")
    single = docs.filter("doc_id is not null")
    if ids:
        of, single = of.unionByName(single.join(repeated, "doc_id", "left_semi").select(docs.columns)), single.join(repeated, "doc_id", "left_anti").select(docs.columns)
    top, n = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)), F.count("*")).first()
    if top + n >= 2**63:  # no room beyond: all rows are numbered
        placed = _in_order(docs, F.asc_nulls_last("doc_id"))
        return placed.withColumn("doc_id", F.col("__place")).select(docs.columns)
    placed = settle(_in_order(of, F.asc_nulls_last("doc_id")), "rows")
    first = placed.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__of")).agg(F.min("__place").alias("__first"))
    placed = placed.join(first, F.col("doc_id") == F.col("__of"), "left")
    key = F.when(F.col("__place") == F.col("__first"), F.col("doc_id")).otherwise(F.lit(top).cast("long") + F.col("__place"))
    return single.unionByName(placed.withColumn("doc_id", key).select(docs.columns))
