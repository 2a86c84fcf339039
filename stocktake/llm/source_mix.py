"""Mixing sources to target weights: histograms of exact lengths, a bounded-knapsack fit of what is left, seeded documents by length count."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocktake.operators.ordering import numbered

from .common import n_words, settle, table, width, with_facts

#: The dynamic program fits at most this many words exactly; larger budgets are first filled in equal shares of every length.
EXACT_WORDS = 1 << 16


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(no_source, of, source_size) with the target of each: shares by repeating weights of share times all sizes, at most `most` times the source's size.

    Sources go by code point, null last, and take the weights in turn. The excess of sources at their bound
    is shared by weight among the others until none is above; what no source can take
    is left out. Each round is one aggregation, and only its sums reach the driver, so there may be any number of
    sources; a round ends at a level that only more sources can reach, so few are needed.
    """
    placed = numbered(sources, ["no_source", "of"])
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    placed = settle(placed.withColumns({"weight": turn, "bound": F.col("source_size") * F.lit(float(most))}), "targets")
    level, full = 0.0, 0
    all_words = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        # a source is at its bound once the words for one unit of weight are bound / weight or more
        at = F.col("bound") <= F.lit(level) * F.col("weight")
        row = placed.agg(F.count_if(at).alias("full"), F.coalesce(F.sum(F.when(at, F.col("bound"))), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~at, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if not row.weight:
            return placed.withColumn("target", F.col("bound")).drop("nth", "weight", "bound")
        new = (share * all_words - row.taken) / row.weight
        if level and row.full == full or not new:
            return placed.withColumn("target", F.when(at, F.col("bound")).otherwise(F.lit(new) * F.col("weight"))).drop("nth", "weight", "bound")
        level, full = new, row.full


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to budget as can be from below.

    The bounded-knapsack dynamic program decides on the last `exact` words. Of a larger
    budget every length first gives its share, and the largest lengths that fit take
    what is left above `exact`, so the program always works on the documents not yet taken.
    Up to `exact` the sum is the best there is. Beyond, it is the best that the documents left can add; it
    misses the budget by less than the smallest length left wherever a document of that length is left.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.astype(np.int64)
    if budget <= 0:
        return take
    left = budget
    if left > exact:
        take = np.floor(counts * (max(0, left - exact) / total)).astype(np.int64)
        left -= int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= exact:
            break
        more = min(int(counts[i] - take[i]), max(0, left - exact // 2) // int(lengths[i]) if lengths[i] else 0)
        take[i] += more
        left -= more * int(lengths[i])
    reach, mask, parts = 1, (1 << (left + 1)) - 1, []
    came = np.full(left + 1, -1, np.int32)
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        free = min(int(counts[i] - take[i]), left // length) if length else 0
        chunk = 1
        while free > 0:  # a count in binary parts, so that every number up to it can be made
            n = min(chunk, free)
            free, chunk = free - n, chunk * 2
            new = (reach << (n * length)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")[: left + 1]
                came[bits == 1] = len(parts)
                parts.append((i, n, n * length))
                reach |= new
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    while at > 0:
        i, n, words = parts[came[at]]
        take[i] += n
        at -= words
    return take


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """How many words of each document of docs(doc_id, source, text) the mix takes.

    Returns doc_id, size, source_size, target, copies, taken. Sources go by code
    point, null last. A document is taken whole, 0, 1 or 2 times: every document of
    a source once for each whole time that the target holds the source, and of the
    rest a seeded choice whose count for each length the knapsack fit gives. Documents
    of no words (null and empty texts) have size 0 and taken 0. Rows that repeat are
    documents of their own; an empty table gives no rows. Reruns agree.
    """
    source = F.col("source").cast("string")
    sized = docs.select("doc_id", source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("of"), n_words(F.col("text").cast("string")).alias("size"))
    sized = settle(sized, "mix")
    # a source's words, number of documents and lengths: pre-aggregated, one row for each source and length
    lengths = sized.groupBy("no_source", "of", "size").agg(F.count("*").alias("n"))
    goal = targets(lengths.groupBy("no_source", "of").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)

    def counted(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("size", ignore_index=True)
        whole = int(own["source_size"].iloc[0])
        budget = int(math.floor(own["target"].iloc[0] + 0.5))
        base = budget // whole if whole else 0
        sizes, counts = own["size"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        extra = fit(sizes, counts, budget - base * whole) if base < most else counts * 0
        return own[["no_source", "of", "size", "n", "source_size", "target"]].assign(base=base, extra=extra)

    keys = ["no_source", "of"]
    chosen = lengths.join(goal, keys).groupBy(*keys).applyInPandas(counted, "no_source boolean, of string, size long, n long, source_size long, target double, base int, extra long")
    chosen = settle(chosen, "mix")
    # The first `extra` documents of a length by seeded hash. Lengths of many documents are ranked in ranges of the hash,
    # so that no group holds more than a small share of all rows.
    total = sized.count()
    group_rows = max(1, total // (4 * width(docs.sparkSession)))
    place = F.xxhash64(F.lit(seed), "doc_id").cast("double") / 2.0**64 + 0.5
    parts = F.ceil(F.col("n") / group_rows)
    keys = ["no_source", "of", "size"]
    hashed = with_facts(sized, chosen, keys, "n", total)
    hashed = hashed.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("part", F.least(F.floor(place * parts), parts - 1))
    groups = [*keys, "part"]
    before = hashed.groupBy(*groups).agg(F.count("*").alias("own"))
    before = before.select(*groups, F.coalesce(F.sum("own").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy("key", "doc_id"))).join(before, groups)
    copies = F.col("base") + (F.col("rank") + F.col("earlier") <= F.col("extra")).cast("int")
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
