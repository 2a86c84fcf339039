"""Exact top-k search by the threshold algorithm over sorted per-dimension lists, with floors from a first pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, width

EXACT_FLOAT = 2**53
PIVOTS = 64  # directions by which rows are dealt to shards, at most
SHARD_LEAST = 1024  # rows of a shard, about, below which neither directions nor parallel work split the table further
_QUERY_CHUNK = 256  # queries that are scored by one matrix product


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null for a vector that is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale)))


def _above(x: np.ndarray) -> np.ndarray:
    """Doubles that are no smaller than x, also where x holds integers beyond what a double can."""
    return np.nextafter(x.astype(float), np.inf)


class SortedLists:
    """One list of rows for each dimension, by rising component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, self.order, axis=0)
        self.scored = 0  # rows that were scored in full, over all queries
        self.read: list[int] = []  # queries that have read lists, by place
        self.stopped: list[int] = []  # those of them that a bound has stopped before all rows were scored

    def bounds(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """What a row that no list shows in its first `depth` places can score at most: component times list value, summed up."""
        n = len(self.rows)
        return _above(np.maximum(queries, 0) @ self.values[n - 1 - depth] + np.minimum(queries, 0) @ self.values[depth])

    def _seen(self, query: np.ndarray, depth: int) -> np.ndarray:
        """Rows in the first places of the lists, each from its high end where the query's component is positive, else from its low end."""
        used = np.flatnonzero(query != 0)
        places = np.arange(depth)[:, None]
        return np.unique(self.order[np.where(query[used] > 0, len(self.rows) - 1 - places, places), used])

    def _best(self, own: int, at: np.ndarray | slice, scores: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id) that reach the floor, but those of id own, ties to the smaller id."""
        ids = self.ids[at]
        fit = np.flatnonzero((scores >= floor) & (ids != own))
        if len(fit) > k and scores.dtype != object:
            values = scores[fit]
            fit = fit[values >= np.partition(values, len(values) - k)[len(values) - k]]
            fit = fit[np.lexsort((ids[fit], -scores[fit]))[:k]]
        return sorted(((int(scores[i]), int(ids[i])) for i in fit), key=lambda x: (-x[0], x[1]))[:k]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each query the k best (score, id) among those that reach its floor.

        The lists are read in rounds of doubling depth; rows come to be seen, are scored
        in full, and a query is done once the bound of what it has not seen is below its
        kth score or its floor (at an equal score a smaller id may still come). The
        floor is a score that k rows are known to reach; a query whose bound lies below it
        from the start reads nothing. Every other query reads at least one round. If after that not even lists so deep that
        they show a quarter of the rows could stop it, with the kth score it has by then, all rows are scored by one matrix product for many such queries.
        """
        n, dims = self.rows.shape
        reach = np.full(len(queries), -np.inf) if floors is None else np.asarray(floors, float)
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        open_ = np.flatnonzero(self.bounds(queries, 0) >= reach) if n else np.zeros(0, int)
        depth, deep, full = max(1, n // (64 * max(1, dims))), min(n - 1, max(1, n // (4 * max(1, dims)))), []
        if depth <= deep:
            self.read = open_.tolist()
        while len(open_) and depth <= deep:
            for i in open_:
                seen = self._seen(queries[i], depth)
                self.scored += len(seen)
                out[i] = self._best(int(own[i]), seen, self.rows[seen] @ queries[i], k, reach[i])
                if len(out[i]) == k:
                    reach[i] = max(reach[i], np.nextafter(float(out[i][-1][0]), -np.inf) if abs(out[i][-1][0]) >= EXACT_FLOAT else out[i][-1][0])
            below = self.bounds(queries[open_], depth) < reach[open_]
            self.stopped += open_[below].tolist()
            open_ = open_[~below]
            hopeless = self.bounds(queries[open_], deep) >= reach[open_]
            full.append(open_[hopeless])
            open_ = open_[~hopeless]
            depth *= 2
        open_ = np.concatenate([*full, open_])
        for a in range(0, len(open_), _QUERY_CHUNK):
            part = open_[a : a + _QUERY_CHUNK]
            scores = queries[part] @ self.rows.T
            self.scored += scores.size
            for i, row in zip(part, scores):
                out[i] = self._best(int(own[i]), slice(None), row, k, reach[i])
        return out


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims) if dims else np.zeros((len(column), 0), np.int64)


def _exact(*of: np.ndarray) -> list[np.ndarray]:
    """The matrices as doubles where no sum of products can lose a digit, else as Python integers."""
    peak = max((max(abs(int(x.max())), abs(int(x.min()))) for x in of if x.size), default=0)
    kind = np.float64 if peak * peak * max(of[0].shape[1], 1) < EXACT_FLOAT else object
    return [x.astype(kind) for x in of]


def _dealt(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors(id, vector, dims) with the pivot that each is most alike; -1 for vectors of other dimensions."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            pivot = np.full(len(sizes), -1, np.int64)
            own = np.flatnonzero(sizes == pivots.shape[1])
            if len(own) and pivots.size:
                rows = _matrix(pa.chunked_array([batch.column(1).take(pa.array(own))]), pivots.shape[1]).astype(float)
                pivot[own] = (rows @ pivots.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], names=["id", "vector", "dims", "pivot"])

    return vectors.select("id", "vector", "dims").mapInArrow(deal, "id long, vector array<bigint>, dims long, pivot long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 16384, query_rows: int = 4096, least: int = SHARD_LEAST) -> DataFrame:
    """The k best rows of vectors(id, vector) for each row of queries(id, vector), by inner product of integer vectors.

    A row is no candidate for a query of its own id; only vectors of as many
    components are compared. Ties go to the smaller id; fewer than k rows come back
    if there are no more. Null ids and vectors that are null or hold nulls take no part; empty tables give
    no rows. Rows that repeat are candidates of their own.

    Rows are dealt by direction (the likest of some rows, those of smallest
    hashed id: one for each `least` rows, PIVOTS at most) to shards of bounded size; a direction that holds many rows is split by hash. First each query searches one
    shard of its own direction: the kth score there is its floor. Then the extremes of
    a shard's lists say which queries can find anything in it at all, and those run the
    threshold algorithm there from their floor. Queries go in blocks of bounded size;
    the k best of each shard meet by query.
    """
    hits = _hits(vectors, queries, k, shard_rows, query_rows, least).filter("vec_id is not null")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_report(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 16384, query_rows: int = 4096, least: int = SHARD_LEAST) -> DataFrame:
    """What top_k does for these tables: one row with searches (of a query in a shard that it can be served by), how many of them read lists,
    how many a bound stopped before all rows of the shard were scored, rows scored in full, and the rows that a scan would score."""
    told = _hits(vectors, queries, k, shard_rows, query_rows, least).filter("vec_id is null")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return told.agg(F.count("*").alias("searches"), total("read"), total("stopped"), total("scored"), total("held"))


_HIT = "query_id long, vec_id long, score long, read long, stopped long, scored long, held long"


def _hits(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int, query_rows: int, least: int) -> DataFrame:
    """query_id, vec_id and score of the k best of each shard, and for each query and shard a row without vec_id that says what was read."""
    spark = vectors.sparkSession
    kind = F.col("vector").cast("array<bigint>")
    take = lambda df: df.select(F.col("id").cast("long").alias("id"), kind.alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", F.isnull)).withColumn("dims", F.size("vector").cast("long"))
    vectors, queries = take(vectors), take(queries)
    main = vectors.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if main is None:
        return spark.createDataFrame([], _HIT)
    n_pivots = min(PIVOTS, max(1, main["n"] // least))
    chosen = vectors.filter(F.col("dims") == main["dims"]).orderBy(F.xxhash64("id"), "id", "vector").limit(n_pivots).select("vector").collect()
    pivots = np.array([r.vector for r in chosen], float).reshape(len(chosen), main["dims"])
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)

    dealt, asked = settle(_dealt(vectors, pivots), "vectors"), settle(_dealt(queries, pivots), "vectors")
    sizes = {r.pivot: r.n for r in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # PIVOTS + 1 rows
    most = min(shard_rows, max(least, math.ceil(sum(sizes.values()) / width(spark))))
    parts = {p: max(1, math.ceil(sizes.get(p, 0) / most)) for p in range(-1, len(chosen))}
    shards, blocks = sum(parts.values()), max(1, math.ceil(asked.count() / query_rows))
    of = F.element_at(F.array(*(F.lit(parts[p]) for p in range(-1, len(chosen)))), (F.col("pivot") + 2).cast("int"))
    shard = (F.col("pivot") * 2**32 + F.pmod(F.xxhash64("id"), of)).alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    rows = dealt.select("id", "vector", "dims", shard)
    asked = asked.select("id", "vector", "dims", shard, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    keys = ["dims", "shard", "block"]

    def search(own: pa.Table, ask: pa.Table) -> pa.Table:
        hits: list[tuple[int | None, ...]] = []
        if len(own) and len(ask):
            dims = own.column("dims")[0].as_py()
            of, asks = _exact(_matrix(own.column("vector"), dims), _matrix(ask.column("vector"), dims))
            ids = ask.column("id").to_numpy()
            floors = ask.column("floor").to_numpy() if "floor" in ask.column_names else None
            lists = SortedLists(own.column("id").to_numpy(), of)
            found = lists.search(ids, asks, k, None if floors is None else np.where(np.isnan(floors), -np.inf, floors))
            hits = [(q, i, s, None, None, None, None) for q, best in zip(ids.tolist(), found) for s, i in best]
            # scored rows are told once for all queries of the group
            read, stopped = set(lists.read), set(lists.stopped)
            hits += [(q, None, None, int(j in read), int(j in stopped), lists.scored if j == 0 else 0, len(of)) for j, q in enumerate(ids.tolist())]
        return pa.table({x.split()[0]: pa.array([h[j] for h in hits], pa.int64()) for j, x in enumerate(_HIT.split(", "))})

    spread = rows.select("*", every)
    first = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, _HIT).filter("vec_id is not null")
    # k rows are known to reach the smallest of k scores; below 2**53 a double holds it, and a smaller floor is no error
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    low = F.when(F.abs("least") < EXACT_FLOAT, F.col("least").cast("double"))
    floors = settle(floors.select(F.col("query_id").alias("id"), low.alias("floor")), "floors")
    asked = asked.join(floors, "id", "left")

    def extremes(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        of = _matrix(own.column("vector"), key[0].as_py())
        return pa.table({"dims": [key[0].as_py()], "shard": [key[1].as_py()], "low": [of.min(axis=0).tolist()], "high": [of.max(axis=0).tolist()]}, pa.schema([("dims", pa.int64()), ("shard", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))]))

    n_groups = max(1, math.ceil(shards / 1024))
    groups = F.pmod(F.xxhash64("shard"), F.lit(n_groups)).cast("int").alias("group")
    edges = settle(rows.groupBy("dims", "shard").applyInArrow(extremes, "dims long, shard long, low array<bigint>, high array<bigint>"), "edges").select("*", groups, every)

    def reachable(own: pa.Table, ask: pa.Table) -> pa.Table:
        """The queries of a block with the shards of a group whose bound reaches their floor."""
        found: list[list[int]] = [[] for _ in range(len(ask))]
        if len(own) and len(ask):
            dims = own.column("dims")[0].as_py()
            low, high, asks = _exact(_matrix(own.column("low"), dims), _matrix(own.column("high"), dims), _matrix(ask.column("vector"), dims))
            floors = ask.column("floor").to_numpy()
            bound = _above(np.maximum(asks, 0) @ high.T + np.minimum(asks, 0) @ low.T)
            names = own.column("shard").to_numpy()
            found = [names[b >= f].tolist() for b, f in zip(bound, np.where(np.isnan(floors), -np.inf, floors))]
        return pa.table({"id": ask.column("id"), "vector": ask.column("vector"), "dims": ask.column("dims"), "block": ask.column("block"), "floor": ask.column("floor"), "shards": pa.array(found, pa.list_(pa.int64()))})

    meet = ["dims", "group", "block"]
    asked = asked.drop("shard").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    reached = edges.groupBy(*meet).cogroup(asked.groupBy(*meet)).applyInArrow(reachable, "id long, vector array<bigint>, dims long, block int, floor double, shards array<bigint>")
    reached = reached.withColumn("shard", F.explode("shards")).drop("shards")
    return spread.groupBy(*keys).cogroup(reached.groupBy(*keys)).applyInArrow(search, _HIT)


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), scaled(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.filter(F.col("id") % 50 == 0))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0 and vec_id is not null
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
