"""Inventories and other tables that are derived from the given ones by rules that Spark and SQL state alike."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktake.operators.content import split_blocks
from stocktake.operators.ordering import numbered


class Tables:
    """The given tables of a folder by name, and the derived ones as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def inv_src(self) -> DataFrame:
        d = F.col("doc_id")
        text = F.coalesce("text", F.lit(""))
        kind = F.when(d % 23 == 3, "symlink").when(d % 29 == 4, "fifo").otherwise("file")
        return self.documents.select(
            F.concat_ws("/", "source", "lang", F.concat(d.cast("string"), F.lit(".txt"))).alias("path"), kind.alias("kind"), F.octet_length(text).cast("long").alias("size"),
            (F.lit(1700000000) + d * 37).alias("mtime_s"), (d * 7919 % 1000 * 1000000).cast("int").alias("mtime_ns"), F.lit(420).alias("mode"), (1000 + d % 3).alias("uid"), F.lit(100).cast("long").alias("gid"),
            F.lit(1).cast("long").alias("device"), d.alias("inode"), F.lit(1).cast("long").alias("nlink"), F.when(kind == "symlink", F.concat(F.lit("../"), F.col("lang"))).alias("link_target"), F.sha2(text, 256).alias("hash"), d.alias("doc_id"),
        )

    @cached_property
    def inv_dst(self) -> DataFrame:
        d = F.col("doc_id")
        base = self.inv_src.filter(d % 10 != 0).withColumns({
            "size": F.col("size") + F.when(d % 7 == 0, 1).otherwise(0), "mtime_s": F.col("mtime_s") - F.when(d % 5 == 0, 60).when(d % 31 == 0, -90).otherwise(0), "mode": F.when(d % 11 == 0, 384).otherwise(F.col("mode")),
            "mtime_ns": F.when(d % 13 == 0, F.lit(0)).otherwise(F.col("mtime_ns")), "kind": F.when(d % 37 == 5, "dir").otherwise(F.col("kind")), "device": F.when(d % 41 == 6, F.lit(1)).otherwise(F.lit(2)).cast("long"),
            "hash": F.when(d % 7 == 0, F.sha2(F.col("path"), 256)).otherwise(F.col("hash")),
        })
        extra = self.inv_src.filter(d % 9 == 0).withColumns({"path": F.concat(F.lit("extra/"), "path"), "device": F.lit(2).cast("long")})
        return base.unionByName(extra)

    @cached_property
    def mapping(self) -> DataFrame:
        """dst lists sources by month; every 50th row takes the dst of the row before it, every 60th lies below another's file."""
        month = F.date_format(F.timestamp_seconds("mtime_s"), "yyyy/MM")
        d = F.col("doc_id")
        dst = lambda n: F.concat_ws("/", month, F.lower("source_"), F.concat(n.cast("string"), F.lit(".txt")))
        shared = lambda n: F.concat(F.lit("shared/"), n.cast("string"), F.lit(".txt"))
        rows = self.inv_src.withColumn("source_", F.element_at(F.split("path", "/"), 1))
        chosen = F.when(d % 50 == 49, shared(d)).when((d % 50 == 0) & (d > 0), shared(d - 1)).when(d % 60 == 6, shared(d)).when(d % 60 == 7, F.concat(shared(d - 1), F.lit("/below.txt"))).otherwise(dst(d))
        return rows.select(F.when(d % 45 == 2, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("src"), chosen.alias("dst"), F.when(d % 3 == 0, "file").when(d % 61 == 1, "dir").alias("kind"), "hash", F.when(d % 4 == 0, 384).alias("mode"), F.when(d % 6 == 0, F.col("mtime_s") + 5).alias("mtime"), "doc_id")

    @cached_property
    def listing(self) -> DataFrame:
        rest = F.regexp_replace("url", "^https?://", "")
        key = F.regexp_replace(F.regexp_replace(rest, r"^[^/]*/?", ""), r"\?.*$", "")
        return self.pages.select(F.regexp_extract(rest, "^([^/]*)", 1).alias("bucket"), key.alias("key"), F.octet_length("html").cast("long").alias("size"), F.md5("html").alias("etag"), "page_id")

    @cached_property
    def versions(self) -> DataFrame:
        return self.conversations.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("long").alias("version"), (F.col("role") == "assistant").alias("marker"))

    @cached_property
    def blocks(self) -> DataFrame:
        """64-byte blocks of both sides; the destination's text has another character at place 501 where doc_id is divisible by 3 and lacks the first two where it is divisible by 8."""
        text = F.coalesce("text", F.lit(""))
        other = F.when(F.col("doc_id") % 8 == 0, F.substring(text, 3, 2**30)).when(F.col("doc_id") % 3 == 0, F.concat(F.substring(text, 1, 500), F.lit("#"), F.substring(text, 502, 2**30))).otherwise(text)
        sides = self.documents.select("doc_id", F.explode(F.array(F.struct(F.lit("src").alias("side"), text.alias("text")), F.struct(F.lit("dst").alias("side"), other.alias("text")))).alias("s")).select("doc_id", "s.side", F.encode("s.text", "UTF-8").alias("content"))
        return split_blocks(sides, 64, ["doc_id", "side"]).drop("offset")

    @cached_property
    def hardlinks(self) -> DataFrame:
        w = Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
        return self.lineitem.select(F.col("l_suppkey").alias("device"), F.col("l_orderkey").alias("inode"), F.row_number().over(w).alias("nth"), (F.col("l_partkey") % 2).alias("mode_asked"), F.md5(F.col("l_partkey").cast("string")).alias("digest"), F.count("*").over(Window.partitionBy("l_suppkey", "l_orderkey")).alias("nlink"))

    @cached_property
    def measurements(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.events.select(F.col("user_id").alias("run"), F.row_number().over(w).alias("sequence"), F.lit(0).alias("segment"), (1 + F.floor(F.col("event_id") / 3) % 4).alias("workers"), F.lit(1.5).cast("double").alias("seconds"), F.col("value").alias("rate"), (F.col("event_id") % 11 != 0).alias("usable"))

    @cached_property
    def results(self) -> DataFrame:
        """Records of runs: user_id is the run, its events are the records; event_id gives sizes, outcomes and retry answers."""
        e = F.col("event_id")
        seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        last = F.count("*").over(Window.partitionBy("user_id")) - 1
        kind = F.when(seq == 0, "run").when((seq == last) & (F.col("user_id") % 5 != 0), "result").when(e % 6 == 0, "error").when(e % 6 == 1, "trace").otherwise("operation_result")
        out = F.when(kind == "operation_result", F.when(e % 9 == 0, "failed").when(e % 4 == 0, "unchanged").when(e % 17 == 0, "excluded").otherwise("transferred"))
        return self.events.select(
            F.col("user_id").alias("run"), seq.alias("seq"), "ts", kind.alias("type"), out.alias("disposition"), F.when(out.isNotNull(), F.concat(F.lit("f/"), e.cast("string"))).alias("dst"), (e * 131 % 100000).alias("bytes"),
            F.when(out == "failed", F.when(e % 4 == 1, "yes").otherwise("no")).alias("retryable"), F.when((kind == "error") & (e % 12 == 0), F.lit("f/1")).alias("diagnostic_for"), F.when(kind == "result", F.when(F.col("user_id") % 3 == 0, "partial").when(F.col("user_id") % 7 == 0, "refused").when(F.col("user_id") % 11 == 0, "aborted").when(F.col("user_id") % 13 == 0, "failed").otherwise("success")).alias("status"),
        )

    @cached_property
    def download_events(self) -> DataFrame:
        e = F.col("event_id")
        nations = self.nation.select("n_nationkey", F.col("n_name").alias("country"))
        asset = F.element_at(F.array(*(F.lit(x) for x in ("install.sh", "tool-release-manifest.json", "tool.rb", "tool-linux-x64.gz.sha256", "tool-linux-x64.gz", "tool-macos-arm64", "notes.txt"))), (e % 7 + 1).cast("int"))
        agent = F.when(e % 3 == 0, F.concat(F.lit("tool/1."), (e % 5).cast("string"), F.lit(".0"))).when(e % 3 == 1, F.lit("curl/8.5"))
        return self.events.join(nations, F.col("user_id") % 25 == F.col("n_nationkey")).select(
            "event_id", "ts", F.to_date("ts").alias("day"), asset.alias("asset"), agent.alias("user_agent"), F.when(e % 10 == 0, "linux-x64").alias("target_header"),
            F.when(e % 4 == 0, "check").when(e % 4 == 1, "interactive").when(e % 4 == 2, "odd").alias("purpose_header"), (F.floor(e / 4) % 2).cast("int").alias("latest"), F.concat(F.lit("v1."), (e % 5).cast("string")).alias("tag"), "country", F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("ip"),
        )

    @cached_property
    def trials(self) -> DataFrame:
        rows = self.lineitem.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        placed = numbered(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "round", ["l_returnflag", "l_linestatus"])
        return placed.select(F.col("l_returnflag").alias("case"), F.col("l_linestatus").alias("variant"), F.col("round").cast("int").alias("round"), F.col("l_quantity").cast("double").alias("seconds"), (F.col("l_partkey") % 10 != 0).alias("verified"))

    @cached_property
    def spans(self) -> DataFrame:
        start = F.unix_date(F.to_date("o_orderdate")).cast("long") * 1000
        return self.orders.select((F.col("o_custkey") % 20).alias("run"), F.element_at(F.array(F.lit("scan"), F.lit("copy"), F.lit("prune")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("phase"), start.alias("start_ms"), (start + 1 + F.floor(F.col("o_totalprice")) % 2500).cast("long").alias("end_ms"))


# The same rules as SQL, in the order in which they build on each other.
SQL: dict[str, str] = {
    "inv_src": """
select source || '/' || lang || '/' || doc_id || '.txt' as path, case when doc_id % 23 = 3 then 'symlink' when doc_id % 29 = 4 then 'fifo' else 'file' end as kind,
  octet_length(encode(coalesce(text, '')))::bigint as size, 1700000000 + doc_id * 37 as mtime_s, (doc_id * 7919 % 1000 * 1000000)::int as mtime_ns, 420 as mode, 1000 + doc_id % 3 as uid, 100::bigint as gid,
  1::bigint as device, doc_id as inode, 1::bigint as nlink, case when doc_id % 23 = 3 then '../' || lang end as link_target, sha256(coalesce(text, '')) as hash, doc_id from documents""",
    "inv_dst": """
select path, case when doc_id % 37 = 5 then 'dir' else kind end as kind, size + (doc_id % 7 = 0)::int as size, mtime_s - case when doc_id % 5 = 0 then 60 when doc_id % 31 = 0 then -90 else 0 end as mtime_s,
  case when doc_id % 13 = 0 then 0 else mtime_ns end as mtime_ns, case when doc_id % 11 = 0 then 384 else mode end as mode, uid, gid, case when doc_id % 41 = 6 then 1 else 2 end::bigint as device, inode, nlink, link_target,
  case when doc_id % 7 = 0 then sha256(path) else hash end as hash, doc_id from inv_src where doc_id % 10 <> 0
union all select 'extra/' || path, kind, size, mtime_s, mtime_ns, mode, uid, gid, 2::bigint, inode, nlink, link_target, hash, doc_id from inv_src where doc_id % 9 = 0""",
    "mapping": """
select case when doc_id % 45 = 2 then path || '.gone' else path end as src,
  case when doc_id % 50 = 49 then 'shared/' || doc_id || '.txt' when doc_id % 50 = 0 and doc_id > 0 then 'shared/' || (doc_id - 1) || '.txt' when doc_id % 60 = 6 then 'shared/' || doc_id || '.txt' when doc_id % 60 = 7 then 'shared/' || (doc_id - 1) || '.txt/below.txt' else m || '/' || lower(s) || '/' || doc_id || '.txt' end as dst,
  case when doc_id % 3 = 0 then 'file' when doc_id % 61 = 1 then 'dir' end as kind, hash, case when doc_id % 4 = 0 then 384 end as mode, case when doc_id % 6 = 0 then mtime_s + 5 end as mtime, doc_id
from (select *, strftime(make_timestamp(mtime_s * 1000000), '%Y/%m') as m, split_part(path, '/', 1) as s from inv_src)""",
    "listing": """
select regexp_extract(r, '^([^/]*)', 1) as bucket, regexp_replace(regexp_replace(r, '^[^/]*/?', ''), '\\?.*$', '') as key, octet_length(encode(html))::bigint as size, md5(html) as etag, page_id
from (select *, regexp_replace(url, '^https?://', '') as r from pages)""",
    "versions": "select conv_id::varchar as key, turn::bigint as version, role = 'assistant' as marker from conversations",
    "blocks": """
select doc_id, side, b::bigint as block, least(64, n - b * 64)::bigint as length, md5(unhex(h[b * 128 + 1:b * 128 + 128])) as hash from (
  select doc_id, side, hex(encode(text)) as h, octet_length(encode(text)) as n, unnest(range(0, (octet_length(encode(text)) + 63) // 64)) as b from (
    select doc_id, 'src' as side, coalesce(text, '') as text from documents
    union all select doc_id, 'dst', case when doc_id % 8 = 0 then coalesce(text, '')[3:] when doc_id % 3 = 0 then coalesce(text, '')[1:500] || '#' || coalesce(text, '')[502:] else coalesce(text, '') end from documents
  ) where length(text) > 0)""",
    "hardlinks": """
select l_suppkey as device, l_orderkey as inode, row_number() over (partition by l_suppkey, l_orderkey order by l_linenumber, l_partkey, l_extendedprice)::int as nth, l_partkey % 2 as mode_asked, md5(l_partkey::varchar) as digest,
  count(*) over (partition by l_suppkey, l_orderkey) as nlink from lineitem""",
    "measurements": """
select user_id as run, row_number() over (partition by user_id order by ts, event_id)::int as sequence, 0 as segment, 1 + event_id // 3 % 4 as workers, 1.5::double as seconds, value as rate, event_id % 11 <> 0 as usable from events""",
    "results": """
select run, seq, ts, type, disposition, case when disposition is not null then 'f/' || e end as dst, e * 131 % 100000 as bytes, case when disposition = 'failed' then case when e % 4 = 1 then 'yes' else 'no' end end as retryable,
  case when type = 'error' and e % 12 = 0 then 'f/1' end as diagnostic_for, case when type = 'result' then case when run % 3 = 0 then 'partial' when run % 7 = 0 then 'refused' when run % 11 = 0 then 'aborted' when run % 13 = 0 then 'failed' else 'success' end end as status
from (select *, case when type = 'operation_result' then case when e % 9 = 0 then 'failed' when e % 4 = 0 then 'unchanged' when e % 17 = 0 then 'excluded' else 'transferred' end end as disposition
  from (select *, case when seq = 0 then 'run' when seq = last and run % 5 <> 0 then 'result' when e % 6 = 0 then 'error' when e % 6 = 1 then 'trace' else 'operation_result' end as type
    from (select user_id as run, event_id as e, ts, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, count(*) over (partition by user_id) - 1 as last from events)))""",
    "download_events": """
select event_id, ts, ts::date as day, ['install.sh', 'tool-release-manifest.json', 'tool.rb', 'tool-linux-x64.gz.sha256', 'tool-linux-x64.gz', 'tool-macos-arm64', 'notes.txt'][event_id % 7 + 1] as asset,
  case when event_id % 3 = 0 then 'tool/1.' || event_id % 5 || '.0' when event_id % 3 = 1 then 'curl/8.5' end as user_agent, case when event_id % 10 = 0 then 'linux-x64' end as target_header,
  case when event_id % 4 = 0 then 'check' when event_id % 4 = 1 then 'interactive' when event_id % 4 = 2 then 'odd' end as purpose_header, (event_id // 4 % 2)::int as latest, 'v1.' || event_id % 5 as tag, n_name as country, '10.0.0.' || user_id % 50 as ip
from events join nation on user_id % 25 = n_nationkey""",
    "trials": """
select l_returnflag as "case", l_linestatus as variant, row_number() over (partition by l_returnflag, l_linestatus order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::int as round, l_quantity::double as seconds, l_partkey % 10 <> 0 as verified from lineitem""",
    "spans": """
select o_custkey % 20 as run, ['scan', 'copy', 'prune'][o_orderkey % 3 + 1] as phase, s as start_ms, s + 1 + floor(o_totalprice)::bigint % 2500 as end_ms from (select *, (o_orderdate::date - date '1970-01-01')::bigint * 1000 as s from orders)""",
}


def with_tables(sql: str) -> str:
    """The query with the derived tables that it names, and those that they build on."""
    import re

    named = lambda text: {k for k in SQL if re.search(rf"\b{k}\b", text)}
    need, more = set(), named(sql)
    while more - need:
        need |= more
        more = {x for k in need for x in named(SQL[k]) if x != k} | need
    ctes = ", ".join(f"{k} as ({SQL[k]})" for k in SQL if k in need)
    return f"with recursive {ctes} {sql}" if ctes and not sql.lstrip().startswith("with") else (f"with recursive {ctes}, {sql.lstrip()[4:]}" if ctes else sql)
