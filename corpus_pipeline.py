"""A training corpus from documents: each stage applies one operator to all its predecessor kept and hands its documents on.

Every stage but the last returns the columns of documents as it got them. Rows
without a doc_id, and rows that share one, take part like all others and keep what they came with; the
operators see a number of each row's own (own_ids). A null text counts as empty. Columns may have any
names, because they travel as one struct. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm import bin_completion, line_dedup, minhash_dedup, quality_rules, source_mix
from stocktake.llm.common import WORD, own_ids, settle, table


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id (no other row has it), text and row: all columns of docs as a struct."""
    return own_ids(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))


def _joined(rows: DataFrame, decisions: DataFrame, how: str = "inner") -> DataFrame:
    """rows with what was decided for their doc_id; decisions: one row for each doc_id."""
    decisions = decisions.withColumnRenamed("doc_id", "of")
    joined = rows.join(decisions, rows["doc_id"] == decisions["of"], how)
    return joined if how.startswith("left_") else joined.drop("of")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has no words and goes; rows that repeat share their fate; a verdict
    does not depend on doc_id. The rules are weighed over all rows.
    """
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go, and documents of which no word is left after that.

    Of equal or nearly equal lines the first stays, by doc_id, then by text; a document
    that repeats loses all lines that the first one has. n_chars, where there is one, follows the text. A text without any dropped
    line stays as it is, also one that is null or empty.
    """
    rows = _numbered(docs)
    dropped = line_dedup.dropped_lines(rows.select("doc_id", "text")).filter(F.size("dropped") > 0).select("doc_id", "dropped")
    joined = _joined(rows, dropped, "left")
    text = F.when(F.col("dropped").isNotNull(), line_dedup.without_lines(F.col("text"), F.col("dropped"))).otherwise(F.col("text"))
    cut = joined.withColumn("cut", text).filter(F.col("dropped").isNull() | F.rlike("cut", F.lit(WORD)))
    row = F.col("row").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("dropped").isNotNull(), F.length("cut").cast(kind)).otherwise(F.col("row.n_chars")))
    return cut.select(row.alias("row")).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the smallest doc_id, of equal ones the first by text.

    Texts without words have no duplicates and stay.
    """
    rows = _numbered(docs)
    found = minhash_dedup.near_duplicates(rows.select("doc_id", "text"))
    return _joined(rows, found.filter("not kept").select("doc_id"), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0, 1 or 2) as the mix of sources takes it; rows without a source are one source, the last.

    Each row counts for itself, so rows that repeat take no more than their share. Of documents of one
    source and length a seeded hash of doc_id decides; reruns agree.
    """
    rows = _numbered(docs)
    copies = source_mix.mix(rows.select("doc_id", "row.source", "text")).select("doc_id", "copies").filter("copies > 0")
    return _joined(rows, copies).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of bounded length: one row for each piece of each row of docs, also of rows that repeat or have no doc_id."""
    return bin_completion.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_dedup", near),
    ("source_mix", mixed),
    ("best_fit_packing", packed),
]
#: The stages fit a label model, confirm links of whole sets and pack by search: no SQL for that; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
