"""Near-dedup by MinHash bands; odd sketches of the samples screen candidates, full shingle sets confirm links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches, table, with_facts
from .components import components, extended
from .shingles import mixed, shingle_set

BANDS, ROWS = 40, 4  # a pair at similarity 0.75 shares no band once in 4 million times
#: Candidates below this estimate are dropped; a pair at 0.75 falls below it by six standard deviations.
SCREEN = 0.55
#: Samples and screen where buckets are searched in full; a pair at 0.75 falls below it by five standard deviations.
WIDE, WIDE_SCREEN = 1024, 0.655
_SETS = "doc long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"
_A = mixed(np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_B = mixed(_A)


def samples(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The minimum of each of n hash functions over a shingle set."""
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        np.minimum(out, (_A[:n, None] * part[None, :] + _B[:n, None]).min(axis=1), out=out)
    return out


def band_keys(of: np.ndarray) -> np.ndarray:
    rows = of.reshape(BANDS, ROWS)
    keys = mixed(np.arange(BANDS, dtype=np.uint64))
    for r in range(ROWS):
        keys = mixed(keys ^ rows[:, r])
    return keys


def odd_sketch(of: np.ndarray) -> np.ndarray:
    """A bitmap of the parity of how many samples fall on each bit; it has 4 to 8 bits for each sample."""
    bits = sketch_bits(len(of))
    place = mixed(mixed(of) + np.arange(len(of), dtype=np.uint64)) % np.uint64(bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(bool))


def sketch_bits(n: int) -> int:
    return 1 << (4 * n - 1).bit_length()


def similarity(ones: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The similarity estimated from the ones of the XOR of two odd sketches of n samples: they count the samples that differ."""
    bits = sketch_bits(n)
    return 1 + bits / (4 * n) * np.log(1 - np.minimum(2 * ones / bits, 0.999))


def _ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shingle_set(text)
                d1, d2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
                of = samples(own)
                rows.append((doc, len(own), d1, d2, band_keys(of).view(np.int64).tolist(), odd_sketch(of).tobytes()) if len(own) else (doc, 0, d1, d2, [], b""))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["doc", "n_shingles", "d1", "d2", "bands", "sketch"])

    return docs.mapInArrow(run, _SETS)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= 75 * union."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, np.ndarray] | None = None
        for f in frames:
            good = []
            for b, x, y in zip(f["b"], f["text_a"], f["text_b"]):
                if held is None or held[0] != b:
                    held = (b, shingle_set(y))
                own, other = shingle_set(x), held[1]
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(100 * both >= 75 * (len(own) + len(other) - both))
            yield f.loc[good, ["a", "b"]]

    with_a = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    return settle(with_b.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long"), "links")


_BLOCK = 2048
_ROWS = "key long, m int, o int, asks boolean, doc long, component long, odd boolean, n long, bands binary, sketch binary"


def _meet(frame: pd.DataFrame, most: int | None) -> list[tuple[int, int]]:
    """Pairs of one group: rows that ask with the others, of different components, likely and not met in an earlier band."""
    own, ask = frame[~frame["asks"]], frame[frame["asks"]]
    if not len(own) or not len(ask):
        return []
    key = np.uint64(int(frame["key"].iloc[0]) & ((1 << 64) - 1))
    docs, part, odd, n = (own[c].to_numpy() for c in ("doc", "component", "odd", "n"))
    bands, sketch = _sketches(own["bands"]), _sketches(own["sketch"])
    out: list[tuple[int, int]] = []
    for doc, component, size, mine, sketched in zip(ask["doc"], ask["component"], ask["n"], _sketches(ask["bands"]), _sketches(ask["sketch"])):
        # a pair whose sizes are too far apart cannot reach 0.75
        fit = np.flatnonzero((part != component) & (~odd | (docs < doc)) & (100 * np.minimum(n, size) >= 75 * np.maximum(n, size)))
        if len(fit):
            same = bands[fit] == mine
            fit = fit[mine[same.argmax(axis=1)] == key]
        if len(fit):
            score = similarity(_ones(sketch[fit], sketched[None, :]), WIDE)
            likely = score >= WIDE_SCREEN
            fit, score = fit[likely], score[likely]
            if most is not None and len(fit) > most:
                fit = fit[np.argsort(-score, kind="stable")[:most]]
            out += [(doc, int(d)) for d in docs[fit]]
    return out


def _apart(members: DataFrame, labels: DataFrame, sketches: DataFrame, most: int | None) -> DataFrame:
    """Pairs of one bucket and different components whose estimate passes the screen.

    Buckets of one component are done. In others, every row outside the bucket's
    largest component meets all rows, in blocks of bounded size, and a pair is tested in
    the first band that it shares; `most` keeps the likeliest partners of each row and block only, for a
    round that comes before one without it.
    """
    of = members.join(labels, F.col("doc") == F.col("id"), "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    sizes = of.groupBy("key", "component").agg(F.count("*").alias("rows"))
    sizes = sizes.groupBy("key").agg(F.sum("rows").alias("rows"), F.max_by("component", F.struct("rows", "component")).alias("main"), F.max("rows").alias("large"), F.count("*").alias("parts")).filter("parts > 1")
    many = lambda n: F.ceil(n / _BLOCK).cast("int")
    rows = of.join(sizes, "key").join(sketches, "doc")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    block = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    rows = rows.withColumns({"inner": many(F.col("rows")), "outer": many(F.col("rows") - F.col("large")), "odd": F.col("component") != F.col("main")})
    names = [x.split()[0] for x in _ROWS.split(", ")]
    own = rows.withColumns({"m": block(F.col("inner")), "asks": F.lit(False)}).withColumn("o", every(F.col("outer"))).select(names)
    ask = rows.filter("odd").withColumns({"o": block(F.col("outer")), "asks": F.lit(True)}).withColumn("m", every(F.col("inner"))).select(names)
    grouped = own.unionByName(ask).repartition("key", "m", "o").sortWithinPartitions("key", "m", "o")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups stand together; the last one of a batch may go on in the next."""
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            keys = f[["key", "m", "o"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = [0, *cuts.tolist()]
            pairs = [p for a, b in zip(starts, starts[1:]) for p in _meet(f.iloc[a:b], most)]
            rest = f.iloc[starts[-1] :]
            yield pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")
        if rest is not None:
            yield pd.DataFrame(_meet(rest, most), columns=["a", "b"]).astype("int64")

    return settle(grouped.mapInPandas(run, "a long, b long").distinct(), "pairs")


def _wide(texts: DataFrame) -> DataFrame:
    """doc, n, bands and a wide odd sketch of texts(doc, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, text in zip(f["doc"], f["text"]):
                own = shingle_set(text)
                of = samples(own, WIDE)
                rows.append((doc, len(own), band_keys(of[: BANDS * ROWS]).tobytes(), odd_sketch(of).tobytes()))
            yield pd.DataFrame(rows, columns=["doc", "n", "bands", "sketch"])

    return texts.mapInPandas(run, "doc long, n long, bands binary, sketch binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for docs(doc_id, text).

    Documents link if their sets of distinct 5-word shingles (fewer words: one) have
    100 * intersection >= 75 * union; a component is what links reach, named by its
    smallest doc_id, whose document is kept. A null text or one without words has no
    shingles and links with nothing. Rows without a doc_id are left out; rows that
    repeat share a component; an empty table gives no rows.

    Equal sets are one class from the start. Classes of one band's bucket are first
    compared with the bucket's smallest member, each only with the likeliest by odd
    sketch; then buckets that still hold several components are searched in full.
    Every link is confirmed on whole sets.
    """
    small_batches(docs.sparkSession, 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter(F.col("doc").isNotNull())
    sets = settle(_sets(docs), "sets")
    full = sets.filter("n_shingles > 0")
    classes = settle(full.groupBy("d1", "d2").agg(F.min("doc").alias("class"), F.count("*").alias("n")), "classes")
    # any row of a class has its bands and sketch; rows of one doc_id may be of several classes
    reps = full.join(classes.withColumnsRenamed({"d1": "c1", "d2": "c2"}), (F.col("doc") == F.col("class")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")))
    exploded = reps.select("doc", F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("doc").alias("center"), F.max("doc").alias("last")).filter("center < last").select("key", "center")
    members = settle(exploded.join(buckets, "key").distinct(), "members")
    ids = members.select("doc").distinct()
    sketches = reps.select("doc", "sketch").join(ids, "doc", "left_semi").dropDuplicates(["doc"])
    sketches = settle(sketches, "sketches")
    texts = settle(docs.join(ids, "doc", "left_semi").dropDuplicates(["doc"]), "texts")

    def likeness(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            score = similarity(_ones(_sketches(f["sketch"]), _sketches(f["other"]))) if len(f) else np.zeros(0)
            yield f[["doc", "center"]].assign(score=score)

    stars = members.filter("doc != center").select("doc", "center").distinct()
    stars = stars.join(sketches, "doc").join(sketches.select(F.col("doc").alias("center"), F.col("sketch").alias("other")), "center")
    scored = stars.select("doc", "center", "sketch", "other").mapInPandas(likeness, "doc long, center long, score double").filter(F.col("score") >= SCREEN)
    likeliest = scored.groupBy("doc").agg(F.max_by("center", F.struct("score", -F.col("center"))).alias("b")).select(F.col("doc").alias("a"), "b")
    # the likeliest partners first, then all that are still apart: nothing is left out
    labels = components(_confirmed(likeliest, texts))
    of = members.join(labels, F.col("doc") == F.col("id"), "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    open_ = of.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    members = settle(members.join(open_, "key", "left_semi"), "members")
    wide = settle(_wide(texts.join(members.select("doc").distinct(), "doc", "left_semi")), "sketches")
    for most in (8, None):
        labels = extended(labels, _confirmed(_apart(members, labels, wide, most), texts))
    labels = labels.select(F.col("id").alias("class"), "component")
    of = settle(classes.join(labels, "class", "left").select("d1", "d2", F.coalesce("component", "class").alias("component"), "n"), "classes")
    total = of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = with_facts(full.select("doc", "n_shingles", "d1", "d2"), of, ["d1", "d2"], "n", total).select("doc", "n_shingles", "component")
    # a document without shingles is alone
    out = out.unionByName(sets.filter("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("component")))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("component") == F.col("doc")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents where doc_id is not null
),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)
),
r as (
  select doc_id as id, doc_id as c from n
  union
  select p.b, r.c from r join p on p.a = r.id where r.c < p.b
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.c, d.doc_id) as component_id, coalesce(m.c, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join (select id, min(c) as c from r group by id) m on m.id = d.doc_id
"""
