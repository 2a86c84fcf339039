"""Connected components of links between documents, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, with_facts


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links(a, b): the smallest id that can be reached.

    Each round takes the smallest label among neighbours and then the label of that
    label, so chains halve; it ends when no label changes. Minima are combined before
    shuffles, so an id of many links is no hot group; labels that very many ids have are
    looked up without a shuffle of those ids. Each round is cut by a written table.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        low = settle(labels.join(near, F.col("id") == F.col("a"), "left").select("id", "component", F.least("component", "near").alias("low")), "labels")
        of = labels.select(F.col("id").alias("low"), F.col("component").alias("next"))
        # every label is an id of its own, so each has a row here
        facts = settle(low.groupBy("low").agg(F.count("*").alias("n")).join(of, "low"), "labels")
        joined = with_facts(low, facts, ["low"], "n", low.count())
        new = settle(joined.select("id", F.least("low", "next").alias("component"), (F.least("low", "next") != F.col("component")).alias("changed")), "labels")
        labels = new.select("id", "component")
        if new.filter("changed").isEmpty():
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(id, component) after more links(a, b): only the components that they join are worked on; ids without a label so far are their own."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = settle(joined.filter("a != b").distinct(), "links")
    if joined.isEmpty():
        return labels
    more = components(joined)
    next_ = more.select(F.col("id").alias("component"), F.col("component").alias("next"))
    facts = labels.groupBy("component").agg(F.count("*").alias("n")).join(next_, "component", "left").withColumn("next", F.coalesce("next", "component"))
    old = with_facts(labels, settle(facts, "labels"), ["component"], "n", labels.count()).select("id", F.col("next").alias("component"))
    return settle(old.unionByName(more.join(labels.select("id"), "id", "left_anti")), "labels")
