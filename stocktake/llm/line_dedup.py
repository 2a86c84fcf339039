"""Line dedup: a deletion-neighbourhood join of lines within one edit; the earliest of such lines stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_keys, settle, small_batches, table, with_facts
from .shingles import mixed

#: A line is parted into so many blocks; lines within one edit agree in all blocks but one.
BLOCKS = 3
EMITTED = 1 << 17  # variants that a task holds before it hands them on, and those of one line more
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def deletion_keys(line: str) -> tuple[np.ndarray, np.uint64]:
    """Hashes of the line without its ith code point for each i, and of the whole line."""
    points = mixed(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + _BASE)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(points), _BASE)]))
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * powers[:-1], dtype=np.uint64)])
    return before[:-1] + (before[-1] - before[1:]) * _BASE_INVERSE, before[-1]


def variants(line: str, blocks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and roles of the variants of a line whose edit lies in one of its open blocks.

    blocks: (shorter, j): block j of the line seen as one of n code points, n its own
    length, or one less where shorter is 1. Roles: 0 for a line that loses one of n
    code points (equal keys: a substitution), 1 for a whole line of n, 2 for a line of
    n + 1 that loses one (1 and 2 with equal keys: an insertion or deletion).
    """
    less, whole = deletion_keys(line)
    size = len(line)
    keys, roles = [mixed(np.array([whole]) ^ np.uint64(size))], [1]
    for shorter, j in blocks:
        n = size - shorter
        low, high = n * j // BLOCKS, n * (j + 1) // BLOCKS + shorter
        at = np.arange(low, min(high, size))
        own = mixed(less[at] ^ np.uint64(n))
        keys.append(np.unique(own) if shorter else mixed(own + at.astype(np.uint64) + np.uint64(1)))
        roles.append(2 if shorter else 0)
    return np.concatenate(keys).view(np.int64), np.repeat(np.array(roles, np.int32), [len(k) for k in keys])


def _block_keys(line: Column) -> Column:
    """A key for each way to leave out one block, for lines seen as of their own length and of one less."""
    size, keys = F.length(line), []
    for shorter in (0, 1):
        n = size - shorter
        for j in range(BLOCKS):
            low, high = F.floor(n * j / BLOCKS).cast("int"), F.floor(n * (j + 1) / BLOCKS).cast("int")
            tail = n - high
            key = F.xxhash64(n, F.lit(j), F.substring(line, F.lit(1), low), F.substring(line, size - tail + 1, tail))
            keys.append(F.struct(key.alias("key"), F.lit(shorter).alias("shorter"), F.lit(j).alias("j")))
    return F.array(*keys)


def _frames(held: list[tuple]) -> Iterator[pd.DataFrame]:
    sizes = [len(x[0]) for x in held]
    columns = {"key": np.concatenate([x[0] for x in held]), "role": np.concatenate([x[1] for x in held])}
    columns |= {name: np.repeat(np.array([x[j] for x in held], kind), sizes) for j, name, kind in ((2, "doc", np.int64), (3, "nth", np.int64), (4, "line_no", np.int32))}
    whole = pd.DataFrame(columns)
    yield from (whole.iloc[at : at + EMITTED] for at in range(0, len(whole), EMITTED))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines and the line numbers (from 0, rising) that line dedup drops from docs(doc_id, text).

    Lines are the \\n-split pieces of whole texts. A line of at least min_chars code
    points is dropped if an equal line or one within one edit (a code point inserted,
    deleted or substituted) stands earlier, by doc_id and line number; whether the
    earlier line is itself dropped makes no difference. Shorter lines stay. A null text has no lines;
    rows without a doc_id are documents of their own and come first; rows that repeat
    share their decisions, rows of one doc_id and several texts do not; an empty
    table gives no rows.

    Lines within one edit agree in all blocks but one, so keys that leave out one block
    find the lines that can have a partner. Only those emit all variants of the
    open block as hashed keys; equal variants meet, the earliest of each is compared
    by its real edit distance.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    exploded = docs.select("doc", "nth", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.length("line") >= min_chars)
    ids = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    lines = settle(exploded.select("doc", "nth", "line_no", *ids), "lines")
    first = settle(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "nth", "line_no")).alias("first"), F.count("*").alias("n")), "lines")

    keys = exploded.select(ids[0], F.explode(_block_keys(F.col("line"))).alias("k")).select("h1", "k.*")
    shared = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("key")
    open_ = keys.join(shared, "key", "left_semi").groupBy("h1").agg(F.collect_set(F.struct("shorter", "j")).alias("blocks"))
    wanted = first.join(open_, "h1").select("first.doc", "first.nth", "first.line_no", "h1", "h2", "blocks")
    wanted = wanted.groupBy("doc", "nth").agg(F.collect_list(F.struct("line_no", "h1", "h2", "blocks")).alias("wanted"))
    suspects = docs.join(wanted, ["doc", "nth"]).select("doc", "nth", F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("w"))
    suspects = settle(suspects.select("doc", "nth", "w.*", F.element_at("lines", F.col("w.line_no") + 1).alias("line")).filter(F.xxhash64("line") == F.col("h1")).dropDuplicates(["doc", "nth", "line_no"]), "lines")

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Variants in blocks of bounded size, however long a line is."""
        held, rows = [], 0
        for f in frames:
            for d, m, i, line, blocks in zip(f["doc"], f["nth"], f["line_no"], f["line"], f["blocks"]):
                keys, roles = variants(line, [(b["shorter"], b["j"]) for b in blocks])
                held.append((keys, roles, d, m, i))
                rows += len(keys)
                if rows >= EMITTED:
                    yield from _frames(held)
                    held, rows = [], 0
        if held:
            yield from _frames(held)

    made = suspects.select("doc", "nth", "line_no", "line", "blocks").mapInPandas(emit, "key long, role int, doc long, nth long, line_no int")
    own = F.struct("doc", "nth", "line_no")
    group = Window.partitionBy("key")
    earliest = [F.min(F.when(F.col("role") == r, own)).over(group) for r in (0, 1, 2)]
    partner = F.when(F.col("role") == 0, earliest[0]).when(F.col("role") == 1, earliest[2]).otherwise(earliest[1])
    pairs = made.select("doc", "nth", "line_no", partner.alias("partner")).filter(F.col("partner") < own).distinct()
    text = suspects.select(F.struct("doc", "nth", "line_no").alias("partner"), F.col("line").alias("earlier"))
    checked = pairs.join(suspects.select("doc", "nth", "line_no", "h1", "h2", "line"), ["doc", "nth", "line_no"]).join(text, "partner")
    near = checked.filter(F.levenshtein("line", "earlier", 1).between(0, 1)).select("h1", "h2", F.lit(True).alias("near")).distinct()

    # lines that stand once and are near nothing stay: only the others are looked up, and those that very many documents share are no one task's work
    judged = settle(first.join(near, ["h1", "h2"], "left").filter("n > 1 or near is not null"), "judged")
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gone = with_facts(lines, judged, ["h1", "h2"], "n", total).filter(F.col("near").isNotNull() | (F.col("first") != own))
    gone = gone.groupBy("doc", "nth").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))
    counted = docs.select("doc", "nth", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n"), F.col("text").isNull().alias("none"))
    out = counted.join(gone, ["doc", "nth"], "left")
    doc_id = F.when(F.col("nth") >= 0, F.col("doc"))
    return out.select(doc_id.alias("doc_id"), F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long").alias("n_lines"), F.coalesce("dropped", F.expr("array()").cast("array<int>")).alias("dropped"))


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines of these numbers."""
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(dropped, i))
    return F.when(F.size(dropped) > 0, F.array_join(kept, "\n")).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    lines = dropped_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped_lines"))


SQL = """
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where text is not null
),
c as (select line, length(line) as n, min((doc_id, i)) as first from l where length(line) >= 10 group by line),
v as (select line, n, first, unnest(range(1, n + 1)) as p from c),
x as (select line, n, first, p, line[:p - 1] || line[p + 1:] as less from v),
near as (
  select line from (select line, first, min(first) over (partition by n, p, less) as best from x) where best < first
  union
  select s.line from x s join c t on s.less = t.line where t.first < s.first
  union
  select t.line from x s join c t on s.less = t.line where s.first < t.first
),
gone as (
  select doc_id, i from l join c using (line) where (doc_id, i) <> c.first or line in (select line from near)
),
g as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as lines from gone group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) as n_lines, coalesce(g.n, 0) as n_dropped, coalesce(g.lines, '') as dropped_lines
from documents d left join g using (doc_id)
"""
