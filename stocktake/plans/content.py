"""Queries of contents, blocks and hard links."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.operators import content as C
from stocktake.operators import reconcile

from .registry import query

c = F.col
_JOINED = "select s.doc_id, s.block, s.length, coalesce(s.hash = d.hash, false) as reused from (select * from blocks where side = 'src') s left join (select * from blocks where side = 'dst') d using (doc_id, block)"


def _joined(t):
    side = lambda x: t.blocks.filter(c("side") == x).drop("side")
    return C.block_join(side("src"), side("dst"))


@query("j12_block_join", f"select doc_id, count(*) as blocks, count(*) filter (reused) as reused from ({_JOINED}) group by doc_id")
def j12(t):
    return _joined(t).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if("reused").alias("reused"))


@query("g10_block_reuse", f"select doc_id, coalesce(sum(length) filter (reused), 0)::bigint as bytes_reused, coalesce(sum(length) filter (not reused), 0)::bigint as bytes_sent from ({_JOINED}) group by doc_id")
def g10(t):
    return C.block_reuse(_joined(t))


@query("w03_differing_ranges", f"""
select doc_id, start, least(start + 7, last) as stop from (select doc_id, last, unnest(range(first, last + 1, 8)) as start from (
  select doc_id, min(block) as first, max(block) as last from (select *, block - row_number() over (partition by doc_id order by block) as i from ({_JOINED}) where not reused) group by doc_id, i))""")  # fmt: skip
def w03(t):
    return C.differing_ranges(_joined(t), 8)


# Contents with 300 zero bytes after the first 100 characters: the place of the run says which blocks it fills.
@query("w04_zero_runs", """
select doc_id, (p + 63) // 64 as first, case when rest = 0 then (p + 363) // 64 - 1 else (p + 300) // 64 - 1 end as last
from (select doc_id, octet_length(encode(text[1:100])) as p, octet_length(encode(text[101:])) as rest from documents where doc_id % 3 = 0 and text is not null)""")
def w04(t):
    part = lambda start, n: F.encode(F.substring("text", start, n), "UTF-8")
    content = F.when(c("doc_id") % 3 == 0, F.concat(part(1, 100), F.lit(bytes(300)), part(101, 2**30))).otherwise(F.encode("text", "UTF-8"))
    return C.zero_runs(t.documents.select("doc_id", content.alias("content")), 64)


@query("s09_read_blocks", """
select doc_id, b as block, b * 512 as "offset", least(512, n - b * 512) as length, md5(unhex(hex(encode(text))[b * 1024 + 1:b * 1024 + 1024])) as hash
from (select doc_id, text, octet_length(encode(text)) as n, unnest(range(0, (octet_length(encode(text)) + 511) // 512)) as b from documents)""")
def s09(t):
    return C.split_blocks(t.documents.select("doc_id", c("text").alias("content")), 512)


@query("w05_hardlink_representative", "select device, inode, nth, case when nth = min(nth) over (partition by device, inode) then 'transfer' else 'link' end as role from hardlinks")
def w05(t):
    return C.representatives(t.hardlinks).select("device", "inode", "nth", "role")


@query("j17_hardlink_followers", "select device, inode, nth from hardlinks where nth > 1 and (device + inode) % 3 <> 0")
def j17(t):
    ok = t.hardlinks.select("device", "inode", ((c("device") + c("inode")) % 3 != 0).alias("ok")).distinct()
    return C.followers(t.hardlinks, ok).select("device", "inode", "nth")


@query("g09_expected_hash_groups", "select device, inode, count(distinct digest) as n from hardlinks group by device, inode having count(distinct digest) > 1")
def g09(t):
    return C.group_conflicts(t.hardlinks, "digest")


@query("g11_conflicting_group_metadata", "select device, inode, count(distinct mode_asked) as n from hardlinks group by device, inode having count(distinct mode_asked) > 1")
def g11(t):
    return C.group_conflicts(t.hardlinks, "mode_asked")


@query("g09_digests_by_algorithm", "select device, inode, nth % 2 as algorithm, count(distinct digest) as n from hardlinks group by device, inode, nth % 2 having count(distinct digest) > 1")
def g09_algorithm(t):
    return C.group_conflicts(t.hardlinks.withColumn("algorithm", c("nth") % 2), "digest", ["algorithm"])


# Names of every fifth inode come from a store that knows no devices.
_PARTLY = "(select case when inode % 5 = 0 then null else device end as device, inode, nth, digest, mode_asked from hardlinks)"


def _partly(t):
    return t.hardlinks.withColumn("device", F.when(c("inode") % 5 != 0, c("device"))).drop("nlink")


@query("w05_without_identity", f"select device, inode, nth, case when device is null or nth = min(nth) over (partition by device, inode) then 'transfer' else 'link' end as role from {_PARTLY}")
def w05_partly(t):
    return C.representatives(_partly(t)).select("device", "inode", "nth", "role")


@query("j17_without_identity", f"select device, inode, nth from {_PARTLY} where device is not null and nth > 1 and (device + inode) % 3 <> 0")
def j17_partly(t):
    ok = _partly(t).select("device", "inode", ((c("device") + c("inode")) % 3 != 0).alias("ok")).distinct()
    return C.followers(_partly(t), ok).select("device", "inode", "nth")


@query("g09_without_identity", f"select device, inode, count(distinct digest) as n from {_PARTLY} where device is not null group by device, inode having count(distinct digest) > 1")
def g09_partly(t):
    return C.group_conflicts(_partly(t), "digest")


@query("g11_without_identity", f"select device, inode, count(distinct mode_asked) as n from {_PARTLY} where device is not null group by device, inode having count(distinct mode_asked) > 1")
def g11_partly(t):
    return C.group_conflicts(_partly(t), "mode_asked")


@query("a14_without_identity", f"select sum(b)::bigint as bytes, count(*) as inodes, false as fits from (select max(nth * 100) as b from {_PARTLY} where device is not null group by device, inode union all select nth * 100 from {_PARTLY} where device is null)")
def a14_partly(t):
    return reconcile.capacity(_partly(t).withColumn("bytes", (c("nth") * 100).cast("long")), 1000, 5000)
