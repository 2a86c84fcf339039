"""Secret scans: single-part patterns, and multipart credentials linked by an interval join within scopes. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, table

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

# Parts of credentials that are too weak to report alone.
WEAK_ID = r"[A-Z0-9]{16,}"
WEAK_SECRET = r"[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""

#: Base kinds as listed, then the kinds that linking adds.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SCOPE = 400  # code points between parts of one credential at most
_SPAN = "struct<start:int,rank:int,kind:string,stop:int>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once for each row."""
    return F.transform(F.array(value), then)[0]


def _running(sizes: Column) -> Column:
    """Sums of an array of integers up to each place, in rounds that double how far a sum reaches: n log n steps."""

    def reach(n: Column) -> Column:
        return F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)

    def double(sums: Column, k: Column) -> Column:
        earlier = F.slice(F.concat(F.array_repeat(F.lit(0), F.call_function("shiftleft", F.lit(1), k)), sums), F.lit(1), F.size(sums))
        return F.zip_with(sums, earlier, lambda a, b: a + b)

    return _let(sizes, lambda x: F.when(F.size(x) > 1, F.aggregate(reach(F.size(x)), x, double)).otherwise(x))


def _spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column]) -> Column:
    """The leftmost non-overlapping matches that keep holds for, as spans in code points: what stands between them is summed up with them."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))

    def placed(of: Column) -> Column:
        gaps = F.slice(of["gaps"], F.lit(1), F.size(of["whole"]))
        stops = _running(F.zip_with(gaps, of["whole"], lambda gap, m: gap + F.length(m)))
        span = lambda m, stop: F.struct((stop - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"))
        return F.filter(F.zip_with(of["whole"], stops, lambda m, stop: F.when(keep(m), span(m, stop))), lambda s: s.isNotNull())

    return F.when(F.rlike(text, F.lit(pattern)), _let(found, placed)).otherwise(F.expr("array()").cast(f"array<{_SPAN}>"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Spans of secrets in docs(doc_id, text), code points, end exclusive.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans. Base kinds are
    assign, access and hex. Weak parts are reported only where their complements
    stand within `scope` code points: an identifier with a secret, a secret with an
    identifier or an endpoint, an endpoint with both; base access identifiers and
    base secrets count as complements. Weak parts that overlap a base span are
    dropped. A null text counts as empty; rows that repeat and null ids are kept; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    every = lambda _: F.lit(True)
    base = F.concat(
        _spans(F.col("text"), ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        _spans(F.col("text"), ACCESS, "access", lambda m: F.length(m) >= 20),
        _spans(F.col("text"), "[0-9a-f]{24,}", "hex", every),  # a run of 24 or more is a match of HEX that is kept, and no other is
    )
    weak = F.concat(
        _spans(F.col("text"), WEAK_ID, "weak_id", lambda m: F.rlike(m, F.lit("[A-Z]")) & F.rlike(m, F.lit("[0-9]"))),
        _spans(F.col("text"), WEAK_SECRET, "weak_secret", lambda m: F.rlike(m, F.lit("[A-Z]")) & F.rlike(m, F.lit("[a-z]")) & F.rlike(m, F.lit("[0-9]"))),
        _spans(F.col("text"), ENDPOINT, "endpoint", every),
    )
    found = settle(docs.select("doc_id", F.sha2("text", 256).alias("of"), base.alias("base"), weak.alias("weak")), "secrets")

    # One row for each part of a text that has weak parts; texts that repeat are linked once. A bin of a scope holds few parts.
    with_weak = found.filter(F.size("weak") > 0).dropDuplicates(["doc_id", "of"])
    part = with_weak.select("doc_id", "of", F.explode(F.concat("base", "weak")).alias("part"))
    part = part.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("doc_id").isNull().alias("no_id"), "of", "part.*")
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    own = ["doc", "no_id", "of", "start", "rank", "kind", "stop"]
    binned = part.withColumn("bin", bins(F.col("start"), F.col("stop")))
    taken = binned.filter("rank < 3").select("doc", "no_id", "of", "bin", F.col("start").alias("from"), F.col("stop").alias("to"))
    covered = binned.filter("rank >= 3").join(taken, ["doc", "no_id", "of", "bin"]).filter((F.col("from") < F.col("stop")) & (F.col("start") < F.col("to"))).select(own).distinct()
    part = settle(part.join(covered, own, "left_anti").select(own), "parts")
    role = F.when(F.col("kind").isin("access", "weak_id"), "id").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret")
    near = part.withColumn("bin", bins(F.col("start"), F.col("stop"))).select("doc", "no_id", "of", "bin", F.col("start").alias("from"), F.col("stop").alias("to"), role.alias("role"))
    asks = part.filter(F.col("rank") >= 3).withColumn("bin", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("stop") + scope))
    gap = F.greatest(F.col("from") - F.col("stop"), F.col("start") - F.col("to"))
    pairs = asks.join(near, ["doc", "no_id", "of", "bin"]).filter(gap <= scope)
    has = {r: F.max(F.col("role") == r).alias(f"has_{r}") for r in ("id", "secret", "endpoint")}
    linked = pairs.groupBy("doc", "no_id", "of", "start", "rank", "kind", "stop").agg(*has.values())
    complete = {"weak_id": ["has_secret"], "endpoint": ["has_id", "has_secret"]}
    rule = reduce(lambda a, b: a | b, [(F.col("kind") == k) & reduce(lambda a, b: a & b, map(F.col, v)) for k, v in complete.items()])
    linked = linked.filter(rule | (F.col("kind") == "weak_secret") & (F.col("has_id") | F.col("has_endpoint")))
    linked = linked.groupBy(F.when(~F.col("no_id"), F.col("doc")).alias("_doc"), F.col("of").alias("_of")).agg(F.collect_list(F.struct("start", "rank", "kind", "stop")).alias("added"))

    out = found.join(linked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("of") == F.col("_of")), "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.concat("base", F.coalesce("added", F.expr("array()").cast(f"array<{_SPAN}>")))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    def spans(kind: str, pattern: str, keep: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
  select row, '{kind}' as kind, {KINDS.index(kind)} as rank, start, start + length(m) as stop, m from (
    select row, m, g2, sum(length(gap)) over w + coalesce(sum(length(m)) over (w rows between unbounded preceding and 1 preceding), 0) as start from (
      select row, unnest(regexp_extract_all(text, '{quoted}', 0)) as m, unnest(regexp_extract_all(text, '{quoted}', {2 if kind == "assign" else 0})) as g2,
        unnest(string_split_regex(text, '{quoted}')) as gap, generate_subscripts(string_split_regex(text, '{quoted}'), 1) as nth
      from d where regexp_matches(text, '{quoted}')
    ) window w as (partition by row order by nth)
  ) where m is not null and {keep}"""

    both = "regexp_matches(m, '[A-Z]') and regexp_matches(m, '[0-9]')"
    base = " union all ".join([spans("assign", ASSIGN, "length(g2) >= 6"), spans("access", ACCESS, "length(m) >= 20"), spans("hex", HEX, "length(m) >= 24")])
    weak = " union all ".join([spans("weak_id", WEAK_ID, both), spans("weak_secret", WEAK_SECRET, both + " and regexp_matches(m, '[a-z]')"), spans("endpoint", ENDPOINT, "true")])
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
base as ({base}),
weak as (select * from ({weak}) w where not exists (select 1 from base b where b.row = w.row and b.start < w.stop and w.start < b.stop)),
parts as (select * from base union all select * from weak),
linked as (
  select w.row, w.kind, w.rank, w.start, w.stop,
    bool_or(p.kind in ('access', 'weak_id')) as has_id, bool_or(p.kind in ('assign', 'hex', 'weak_secret')) as has_secret, bool_or(p.kind = 'endpoint') as has_endpoint
  from weak w join parts p on p.row = w.row and greatest(p.start - w.stop, w.start - p.stop) <= {SCOPE}
  group by all
),
spans as (
  select row, kind, rank, start, stop from base union all
  select row, kind, rank, start, stop from linked
  where kind = 'weak_id' and has_secret or kind = 'weak_secret' and (has_id or has_endpoint) or kind = 'endpoint' and has_id and has_secret
),
of as (
  select row, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(concat_ws(':', kind, start::bigint, stop::bigint), ',' order by start, rank) filter (rank < 3) as base,
    string_agg(concat_ws(':', kind, start::bigint, stop::bigint), ',' order by start, rank) as spans
  from spans group by row
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join of using (row)
"""


SQL = _sql()
