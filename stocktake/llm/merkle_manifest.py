"""A Merkle manifest of a table: leaves by part, a tree for each part, a tree over the parts' roots, and a proof for each row.

Each level is a self-join: a node computes the indices of its siblings in its run (XOR where runs
are pairs, slot offsets otherwise) and meets them by equality; the rows of slot zero emit the parents.
Nodes are dealt by run, so a level shuffles its nodes once, join and grouping included, and a part that
holds most rows is as many groups as it has runs. Levels are written tables; the driver sees the number of nodes of the largest part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.operators.ordering import numbered

from .common import settle, table, with_facts

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:binary,right:binary>>"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of the values in order, each `-` if null, else its number of UTF-8 bytes, `:`, and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def siblings(place: Column, n: Column, fanout: int) -> Column:
    """The indices of the other nodes of the run that place is in, on a level of n nodes."""
    if fanout == 2:
        found = F.array(place.bitwiseXOR(F.lit(1).cast("long")))
    else:
        found = F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda offset: place - place % fanout + (place + offset) % fanout)
    return F.filter(found, lambda sibling: sibling < n)


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes(tree, n, place, digest, row) with run (the parent's place) and the digests left and right of each node in its run, as one binary each."""
    dealt = nodes.withColumn("run", F.expr(f"place div {int(fanout)}")).repartition("tree", "run")
    wanted = dealt.select("tree", "run", "n", "place", "digest", "row", F.explode_outer(siblings(F.col("place"), F.col("n"), fanout)).alias("at"))
    others = dealt.select(F.col("tree").alias("t"), F.col("run").alias("r"), F.col("place").alias("p"), F.col("digest").alias("sibling"))
    # as a difference, so that equal indices are met inside the runs that both sides are dealt by and nothing is dealt again
    same = F.col("at") - F.col("p") == 0
    met = wanted.join(others, (F.col("tree") == F.col("t")) & (F.col("run") == F.col("r")) & same, "left")
    run = F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "sibling"))))
    found = met.groupBy("tree", "run", "place").agg(F.first("n").alias("n"), F.first("digest").alias("digest"), F.first("row").alias("row"), run.alias("found"))
    joined = lambda list_: F.aggregate(list_, F.expr("X''"), lambda so_far, x: F.concat(so_far, x["sibling"]))
    left = F.filter("found", lambda x: x["at"] < F.col("place"))
    right = F.filter("found", lambda x: x["at"] > F.col("place"))
    return found.select("tree", "run", "n", "place", "digest", "row", joined(left).alias("left"), joined(right).alias("right"))


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _levels(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """Written levels (tree, n, place, digest, row) from nodes up to one node for each tree; most: the nodes of the largest tree.

    A tree that has one node left hands it up as it is. row is null above the leaves.
    """
    levels = [nodes]
    while most > 1:
        parent = F.unhex(F.sha2(_hex(F.concat("left", "digest", "right")), 256))
        up = _with_siblings(levels[-1].withColumn("row", F.lit(None).cast("string")), fanout).filter(F.col("place") % fanout == 0)
        up = up.select("tree", F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.col("run").alias("place"), F.when(F.col("n") > 1, parent).otherwise(F.col("digest")).alias("digest"), "row")
        levels.append(settle(up, "level"))
        most = -(-most // fanout)
    return levels


def _paths(levels: list[DataFrame], found: DataFrame, fanout: int) -> DataFrame:
    """The rows of the lowest level with their steps to the root; found: the highest level with the steps of each tree's own root, and `of`, which its rows inherit."""
    for level in levels[-2::-1]:
        up = found.select(F.col("tree").alias("t"), F.col("place").alias("r"), F.col("steps").alias("over"), "of")
        joined = _with_siblings(level, fanout).join(up, (F.col("tree") == F.col("t")) & (F.col("run") == F.col("r")))
        steps = F.when(F.col("n") > 1, F.concat(F.array(F.struct("left", "right")), F.col("over"))).otherwise(F.col("over"))
        found = joined.select("tree", "n", "place", "digest", "row", steps.alias("steps"), "of")
    return found.select("tree", "digest", "row", "steps", "of")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", part: str = "source", fanout: int = 16, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: key, part, the columns of carry, leaf, subroot, root (hex) and steps, from the leaf's run to the root.

    A leaf is the digest of `columns`. Leaves of a part ascend by key; every `fanout` nodes become
    their digest until one is left, the part's root. Roots of parts, ordered by part, become the root
    likewise. A step has the siblings left and right of the node, as joined digests. A null key comes first; rows of
    one key are ordered by their leaf, and equal rows are leaves of their own with equal digests; a null part is a part, the first. Empty texts have a length of 0.
    Columns that are not named have no effect, whatever their names. An empty table has no rows.
    """
    if fanout < 2:
        raise ValueError("a run has at least two nodes")
    tree = F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit(""))
    held = F.struct(F.col(key).alias("key"), F.col(part).alias("part"), *(c.alias(f"c{i}") for i, c in enumerate((carry or {}).values())))
    leaves = settle(docs.select(tree.alias("tree"), F.unhex(leaf([F.col(c) for c in columns])).alias("digest"), held.alias("row")), "leaves")
    counts = settle(leaves.groupBy("tree").agg(F.count("*").alias("n")), "parts")
    n_parts, most, total = counts.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = numbered(counts, ["tree"], "nth")
    placed = numbered(leaves, [F.asc_nulls_first("row.key"), "digest"], "nth", keys=["tree"]).withColumn("place", F.col("nth") - 1)
    nodes = settle(with_facts(placed.drop("nth"), counts, ["tree"], "n", total).select("tree", "n", "place", "digest", "row"), "nodes")
    levels = _levels(nodes, most, fanout)

    top = levels[-1].select("tree", "digest").join(parts.select("tree", (F.col("nth") - 1).alias("place")), "tree")
    roots = _levels(settle(top.select(F.lit("").alias("tree"), F.lit(n_parts).cast("long").alias("n"), "place", "digest", F.col("tree").alias("row")), "nodes"), n_parts, fanout)
    last = roots[-1].first()
    parts_ = _paths(roots, roots[-1].withColumns({"steps": F.array().cast(_STEPS), "of": F.lit("")}), fanout)
    above = parts_.select(F.col("row").alias("tree"), "steps", _hex("digest").alias("of"))
    found = _paths(levels, levels[-1].join(above, "tree"), fanout)
    carried = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry or {})]
    return found.select(F.col("row.key").alias(key), F.col("row.part").alias(part), *carried, _hex("digest").alias("leaf"), F.col("of").alias("subroot"), F.lit(last and last.digest.hex()).alias("root"), "steps")


def folded(leaf_: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, leaf_, lambda so_far, x: F.sha2(F.concat(_hex(x["left"]), so_far, _hex(x["right"])), 256))


def proof(steps: Column) -> Column:
    """The digests of all steps, left to right, level by level, as hex text."""
    return F.array_join(F.transform(steps, lambda x: _hex(F.concat(x["left"], x["right"]))), "")


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked after some texts were tampered with: A-Z in lower case where 5 divides the CRC-32 of doc_id.

    A null doc_id is never tampered with, a null text stays null.
    """
    ascii_only = F.octet_length("text") == F.char_length("text")
    small = F.when(ascii_only, F.lower("text")).otherwise(F.translate("text", _CAPITALS, _SMALL))
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    found = manifest(docs, carry={"changed": F.when(chosen, F.unhex(leaf([small if c == "text" else F.col(c) for c in COLUMNS])))})
    now = F.coalesce(_hex("changed"), F.col("leaf"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("steps")), 256).alias("proof_sha256"), folded(now, F.col("steps")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


def _sql_leaf(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen(cast({v} as varchar)) || ':' || cast({v} as varchar), '-')" for v in values) + ")"


_UP = "list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], '')))"
_BESIDE = "{{'l': array_to_string(nodes[{at} // 16 * 16 + 1 : {at}], ''), 'r': array_to_string(nodes[{at} + 2 : {at} // 16 * 16 + 16], '')}}"
#: CRC-32 of a short text, bit by bit.
_CRC = """(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen({x}) + 1), lambda i: ascii({x}[i])::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: case when y % 2 = 1 then xor(y // 2, 3988292384) else y // 2 end)) # 4294967295)""".replace("# 4294967295", "")

SQL = f"""
with recursive leaves as (
  select doc_id, source, {_sql_leaf("text")} as leaf, {_sql_leaf(f"translate(text, '{_CAPITALS}', '{_SMALL}')")} as changed,
    xor({_CRC.format(x="cast(doc_id as varchar)")}, 4294967295) as crc from documents),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from leaves),
trees as (
  select source, 0 as level, list(leaf order by place) as nodes from placed group by source
  union all select source, level + 1, {_UP} from trees where len(nodes) > 1),
subroots as (select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as part from trees where len(nodes) = 1),
roots as (
  select 0 as level, list(subroot order by part) as nodes from subroots
  union all select level + 1, {_UP} from roots where len(nodes) > 1),
steps as (
  select p.source, p.place, level, {_BESIDE.format(at="(p.place // cast(pow(16, level) as bigint))")} as step from placed p join trees t on p.source is not distinct from t.source where len(nodes) > 1
  union all select p.source, p.place, 100 + level, {_BESIDE.format(at="(s.part // cast(pow(16, level) as bigint))")} from placed p join subroots s on p.source is not distinct from s.source cross join roots where len(nodes) > 1),
paths as (select source, place, list(step order by level) as steps from steps group by source, place),
found as (
  select p.doc_id, p.leaf, s.subroot, (select nodes[1] from roots where len(nodes) = 1) as root, coalesce(h.steps, []) as steps,
    case when p.crc % 5 = 0 then p.changed else p.leaf end as now
  from placed p join subroots s on p.source is not distinct from s.source left join paths h on p.source is not distinct from h.source and p.place = h.place)
select *, folded_root = root as verified from (
  select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.l || x.r), '')) as proof_sha256,
    list_reduce(list_prepend({{'l': now, 'r': ''}}, steps), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l as folded_root
  from found)
"""
