"""How filters interact, whatever their order: posting lists of failing ids for each part, merged and subtracted by galloping.

Rows of a part are numbered, and each range of numbers has one sorted list of failing ids for each
filter. What a filter removes after others have run is its list less their union. Lists of a range are merged in one
task and only sizes are added up, so a part that holds most rows is as many tasks' work as it has ranges. Every order of the filters
reads its counts from these sizes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.operators.ordering import numbered

from .common import settle, small_batches, table, with_facts

#: Rows in one range of ids.
SPAN = 4096
#: Ids of a list that are looked up at once.
_BLOCK = 128
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
LETTERS = "ABCDE"


def gallop(of: np.ndarray, at: int, bound: int) -> int:
    """The first place from `at` on in the rising list `of` that is not below bound: strides double, and only the last one is searched."""
    stride = 1
    while at + stride <= len(of) and of[at + stride - 1] < bound:
        at, stride = at + stride, 2 * stride
    return at + int(np.searchsorted(of[at : at + stride], bound))


def inside(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the rising values are in the rising list `of`: block by block, each between the places where a gallop finds its ends."""
    found, at = np.zeros(len(values), bool), 0
    for begin in range(0, len(values), _BLOCK):
        block = values[begin : begin + _BLOCK]
        at = gallop(of, at, block[0])
        end = gallop(of, at, block[-1] + 1)
        places = np.searchsorted(of[at:end], block)
        hit = np.flatnonzero(places < end - at)
        found[begin + hit[of[at + places[hit]] == block[hit]]] = True
        at = end
    return found


def less(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The rising values that are not in `of`."""
    return values[~inside(values, of)] if len(of) else values


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two rising lists without an id in common: the shorter is dealt into the longer."""
    short, long = sorted((a, b), key=len)
    return np.insert(long, np.searchsorted(long, short), short) if len(short) else long


def sizes(lists: Sequence[np.ndarray], marked: Sequence[np.ndarray]) -> np.ndarray:
    """For each set of filters `before` (as bits) and each filter not in it, in that order: the size of the filter's list less the union of those before,
    and how many ids of that are in each list of `marked`."""
    unions, out = {0: np.empty(0, np.int64)}, []
    for before in range(1 << len(lists)):
        for f in range(len(lists)):
            if not before >> f & 1:
                left = less(lists[f], unions[before])
                if before | 1 << f not in unions:
                    unions[before | 1 << f] = merged(unions[before], left)
                out.append([len(left), *(int(inside(left, m).sum()) for m in marked)])
    return np.array(out, np.int64)


def steps(k: int) -> list[tuple[int, int]]:
    """(before, filter) in the order of sizes."""
    return [(before, f) for before in range(1 << k) for f in range(k) if not before >> f & 1]


def posting_lists(rows: DataFrame, filters: Sequence[str], marks: Sequence[str], order: Sequence[Column | str], span: int = SPAN) -> DataFrame:
    """part, range, n, and for each filter and mark the rising numbers of the rows of rows(part, ...) where that boolean column is true.

    Rows of a part are numbered from 0 in the order; `span` numbers are a range. A null flag counts as false.
    """
    named = {c: f"f{i}" for i, c in enumerate([*filters, *marks])}
    flags = rows.select("part", *(F.col(c).alias(a) for c, a in named.items()), *(o.alias(f"o{i}") if isinstance(o, Column) else F.col(o).alias(f"o{i}") for i, o in enumerate(order)))
    placed = numbered(flags, [F.asc_nulls_first(f"o{i}") for i in range(len(order))], "id", keys=["part"]).withColumn("id", F.col("id") - 1)
    lists = [F.sort_array(F.collect_list(F.when(F.col(a), F.col("id")))).alias(a) for a in named.values()]
    found = placed.groupBy("part", F.expr(f"id div {int(span)}").alias("range")).agg(F.count("*").alias("n"), *lists)
    return found.select("part", "range", "n", *(F.col(a).alias(f"list_{c}") for c, a in named.items()))


def differences(lists: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """part and totals(array), added up over the ranges of posting_lists: the number of rows, and then what sizes() has, row by row."""
    k, m = len(filters), len(marks)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                ids = [batch.column(2 + i)[row].values.to_numpy(zero_copy_only=False) for i in range(k + m)]
                found.append(np.concatenate([[batch.column(1)[row].as_py()], sizes(ids[:k], ids[k:]).ravel()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["part", "sizes"])

    each = lists.select("part", "n", *(f"list_{c}" for c in [*filters, *marks])).mapInArrow(merge, "part string, sizes array<long>")
    added = each.select("part", F.posexplode("sizes").alias("at", "size")).groupBy("part", "at").agg(F.sum("size").alias("size"))
    return added.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "size"))), lambda x: x["size"]).alias("totals"))


def orders(totals: DataFrame, filters: Sequence[str], marks: Mapping[str, str]) -> DataFrame:
    """One row for each part, order of all filters and step, from differences().

    kept: rows of the part left after the step; removed: those that the step took; redundant: those that fail its filter
    but were gone before; unique_fails: those that fail no other filter; one column for each mark, by the name it is given here: removed rows that have it;
    shapley: what the filter removes, added up over all orders. There are as many orders as permutations: meant for up to six filters.
    """
    k, width = len(filters), 1 + len(marks)
    slot = {step: 1 + width * i for i, step in enumerate(steps(k))}
    ways = list(permutations(range(k)))
    taken = [[slot[sum(1 << g for g in way[:i]), way[i]] for i in range(k)] for way in ways]
    count = lambda at: F.get("totals", at)
    shapley = []
    for f in range(k):
        each = [(count(F.lit(slot[b, f])), factorial(b.bit_count()) * factorial(k - 1 - b.bit_count())) for b in range(1 << k) if not b >> f & 1]
        shapley.append(sum((c * w for c, w in each), F.lit(0).cast("long")))
    constants = {
        "names": ["".join(filters[f] for f in way) for way in ways], "taken": [x for row in taken for x in row], "filter": [f for way in ways for f in way],
        "alone": [slot[0, f] for f in range(k)], "last": [slot[(1 << k) - 1 - (1 << f), f] for f in range(k)],
    }
    fixed = {c: F.lit(v) for c, v in constants.items()}
    x, step = F.col("x"), F.col("x") % k
    rows = totals.select("part", "totals", F.array(*shapley).alias("shares"), F.explode(F.sequence(F.lit(0), F.lit(k * len(ways) - 1))).alias("x"))
    rows = rows.withColumns({"f": F.get(fixed["filter"], x), "at": F.get(fixed["taken"], x)})
    gone = F.aggregate(F.slice(fixed["taken"], x - step + 1, step + 1), F.lit(0).cast("long"), lambda so_far, at: so_far + count(at))
    return rows.select(
        "part", F.get(fixed["names"], F.floor(x / k).cast("int")).alias("filter_order"), (step + 1).cast("int").alias("step"), (count(F.lit(0)) - gone).alias("kept"), count(F.col("at")).alias("removed"),
        (count(F.get(fixed["alone"], F.col("f"))) - count(F.col("at"))).alias("redundant"), count(F.get(fixed["last"], F.col("f"))).alias("unique_fails"),
        *(count(F.col("at") + 1 + j).alias(name) for j, name in enumerate(marks.values())), F.get("shares", F.col("f")).alias("shapley"),
    )


def text_failures(text: str) -> int:
    """The filters A to D that the text fails, as bits."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, distinct = len(words), len(set(words))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    symbols = len(data) != len(data.translate(None, _SYMBOLS))
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * len(text)) << 2 | symbols << 3


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, doc_id, A to E (whether the row fails the filter), good and toxic for each row of docs(doc_id, source, text); labels(doc_id, quality, toxic).

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals A-Z > 5 * code points; D: a character of #$%&*|;
    E: the text equals that of a smaller doc_id, by SHA-256. A null text is empty; a null source is part ''; a null doc_id is
    smaller than none and has no smaller one, nor a label; rows of one doc_id are no copies of each other. Several labels of a doc_id: any counts.
    """
    small_batches(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([text_failures(t or "") for t in batch.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], bits], names=["doc_id", "part", "digest", "bits"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = settle(read.mapInArrow(look, "doc_id long, part string, digest binary, bits int"), "failures")
    facts = settle(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "texts")
    marked = with_facts(rows, facts, ["digest"], "copies", rows.count())
    label = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = marked.filter("doc_id is not null")
    labelled = known.join(label, F.col("doc_id") == F.col("of"), "left").select(*marked.columns, "good", "toxic")
    unknown = marked.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    bit = lambda i: F.col("bits").bitwiseAND(1 << i) != 0
    flags = {**{c: bit(i) for i, c in enumerate("ABCD")}, "E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))}
    both = labelled.unionByName(unknown)
    return both.select("part", "doc_id", "bits", "digest", *(v.alias(c) for c, v in flags.items()), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, span: int = SPAN) -> DataFrame:
    """The counts of orders() for the filters A to E of failures(), zeros included; documents without rows give none."""
    rows = settle(failures(docs, labels), "audit")
    lists = posting_lists(rows, LETTERS, ("good", "toxic"), ["doc_id", "digest"], span)
    return orders(differences(lists, LETTERS, ("good", "toxic")), LETTERS, {"good": "good_lost", "toxic": "toxic_lost"})


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
SQL = f"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {_WORDS} as words from (select doc_id, source, text, coalesce(text, '') as t from documents)),
label as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
flags as (
  select part, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
    coalesce(doc_id > min(doc_id) over (partition by t), false) as e, coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from texts left join label using (doc_id)),
fails as (
  select part, good, toxic, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as fails, count(*) as n
  from flags group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
filter_orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps as (select filter_order, step, substr(filter_order, step, 1) as f, substr(filter_order, 1, step - 1) as before from filter_orders, (select unnest(range(1, 6)) as step)),
took as (
  select *, contains(fails, f) as failing, len(regexp_replace(fails, '[^' || before || '-]', '', 'g')) > 0 as gone
  from fails, steps),
counts as (
  select part, filter_order, step, f, sum(n) filter (not gone and not failing) as kept, sum(n) filter (failing and not gone) as removed, sum(n) filter (failing and gone) as redundant,
    sum(n) filter (fails = f) as unique_fails, sum(n) filter (failing and not gone and good) as good_lost, sum(n) filter (failing and not gone and toxic) as toxic_lost
  from took group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley
from counts
"""
