"""Scalar functions of modes, times, sizes, digests and versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File type bits of a mode, unit suffixes, digest lengths.
KIND_OF_TYPE_BITS = {0o100000: "file", 0o040000: "dir", 0o120000: "symlink", 0o010000: "fifo", 0o140000: "socket", 0o020000: "char", 0o060000: "block"}
SIZE_UNITS = {"B": 1, "kB": 10**3, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40}
DURATION_UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 604800 * 10**9}
RATE_UNITS = {"": 2**10, "k": 2**10, "kib": 2**10, "b": 1, "kb": 10**3, "m": 2**20, "mib": 2**20, "mb": 10**6, "g": 2**30, "gib": 2**30, "gb": 10**9, "t": 2**40, "tib": 2**40, "tb": 10**12, "p": 2**50, "pib": 2**50, "pb": 10**15}
DIGEST_LENGTHS = {"blake3": 64, "sha256": 64, "md5": 32, "xxh3-128": 32}
BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def entry_kind_of(mode: Column) -> Column:
    """The kind that a mode's file type bits name; `other` for unknown bits."""
    bits = mode.bitwiseAND(0o170000)
    return reduce(lambda c, x: c.when(bits == x[0], x[1]), KIND_OF_TYPE_BITS.items(), F.when(bits.isNull(), F.lit(None))).otherwise("other")


def mapping_kind(kind: Column) -> Column:
    return F.when(kind.isin("file", "dir", "symlink"), kind).when(kind.isNotNull(), "special")


def is_directory_marker(key: Column, size: Column) -> Column:
    return (size == 0) & F.endswith(key, F.lit("/"))


def permission_bits(mode: Column) -> Column:
    return mode.bitwiseAND(0o7777)


def ts_nanos(seconds: Column, nanos: Column) -> Column:
    """Nanoseconds since the epoch, exactly."""
    return seconds.cast("decimal(28,0)") * F.lit(10**9).cast("decimal(10,0)") + nanos.cast("decimal(10,0)")


def add_duration(seconds: Column, nanos: Column, duration_ns: Column) -> Column:
    """A time (seconds, nanoseconds below 10**9) moved by a duration in nanoseconds, as a struct of both; exact, also before the epoch."""
    second = F.lit(10**9).cast("decimal(10,0)")
    total = ts_nanos(seconds, nanos) + duration_ns.cast("decimal(28,0)")
    rest = F.pmod(total, second)
    return F.struct(((total - rest) / second).cast("long").alias("seconds"), rest.cast("int").alias("nanos"))


def ts_diff(a_seconds: Column, a_nanos: Column, b_seconds: Column, b_nanos: Column) -> Column:
    """Nanoseconds from time b to time a, exactly."""
    return ts_nanos(a_seconds, a_nanos) - ts_nanos(b_seconds, b_nanos)


def preferred_time(stored: Column, service: Column) -> Column:
    return F.coalesce(stored, service)


def mtime_matches(src_s: Column, src_ns: Column, dst_s: Column, dst_ns: Column) -> Column:
    """Equal whole seconds, and equal fractions at the precision that the destination shows; a zero fraction matches all."""
    digits = dst_ns.cast("string")
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    step = F.pow(F.lit(10.0), zeros).cast("long")
    return (src_s == dst_s) & ((dst_ns == 0) | (F.floor(src_ns / step) == F.floor(dst_ns / step)))


def mtime_matches_coarse(src_s: Column, dst_s: Column) -> Column:
    """For systems that keep two-second steps."""
    return F.abs(src_s - dst_s) <= 1


def quantity(text: Column, units: dict[str, int]) -> Column:
    """'1.5MiB' in whole base units; null for an unknown unit or where no whole number comes out."""
    number, unit = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]{1,18})?)([A-Za-z]*)$", 1), F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]{1,18})?)([A-Za-z]*)$", 2)
    factor = F.element_at(F.create_map(*(F.lit(x) for kv in units.items() for x in kv)), unit)
    exact = F.nullif(number, F.lit("")).cast("decimal(22,9)") * factor.cast("decimal(15,0)")
    return F.when(exact == F.floor(exact), exact.cast("decimal(38,0)").cast("long"))


def parse_rate(text: Column) -> Column:
    """Bytes a second of a rate such as 1.5m: KiB by default, +1 or -1 byte, rounded to KiB; 0 is unlimited, null is refused (below 512 too)."""
    pattern = r"^\s*([0-9]*\.?[0-9]+)([A-Za-z]*)([+-]1)?\s*$"
    number, unit, more = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    factor = F.element_at(F.create_map(*(F.lit(x) for kv in RATE_UNITS.items() for x in kv)), F.lower(unit))
    value = F.nullif(number, F.lit("")).cast("double") * factor + F.when(more == "+1", 1).when(more == "-1", -1).otherwise(0)
    rounded = F.floor((F.floor(value + 0.5) + 512) / 1024) * 1024
    return F.when(value == 0, F.lit(0).cast("long")).when(value >= 512, rounded.cast("long"))


def _half_even(n: Column, unit: int, digits: int) -> Column:
    """n / unit with so many decimals; exact ties go to the even digit, which format_string does not do."""
    scaled, whole = n.cast("decimal(38,0)") * 10**digits, F.lit(unit).cast("decimal(38,0)")
    rest = scaled % whole
    q = ((scaled - rest) / whole).cast("long")
    q = q + F.when((2 * rest > whole) | ((2 * rest == whole) & (q % 2 == 1)), 1).otherwise(0)
    if not digits:
        return q.cast("string")
    return F.concat(F.floor(q / 10**digits).cast("string"), F.lit("."), F.lpad((q % 10**digits).cast("string"), digits, "0"))


def human_bytes(n: Column) -> Column:
    """Bytes in binary units: two decimals below 10, one below 100, none beyond."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(BYTE_UNITS[1:], 1):
        of = 1024**i
        text = F.when(n < 10 * of, _half_even(n, of, 2)).when(n < 100 * of, _half_even(n, of, 1)).otherwise(_half_even(n, of, 0))
        out = F.when(n >= of, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def hms(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    minutes, rest = F.floor(s / 60), s % 60
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), minutes % 60, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def digest_valid(algorithm: Column, value: Column) -> Column:
    length = F.element_at(F.create_map(*(F.lit(x) for kv in DIGEST_LENGTHS.items() for x in kv)), algorithm)
    return F.coalesce(F.rlike(value, F.lit("^[0-9a-fA-F]+$")) & (F.length(value) == length), F.lit(False))


def digest_parse(text: Column) -> Column:
    """struct(algorithm, value in lower case) of 'algorithm:hex'."""
    parts = F.split(text, ":", 2)
    return F.struct(parts[0].alias("algorithm"), F.lower(F.try_element_at(parts, F.lit(2))).alias("value"))


def content_hash(content: Column, algorithm: str) -> Column:
    """Hex digest of a content by sha256 or md5; blake3 and xxh3-128 digests are only compared where they are stored."""
    if algorithm not in ("sha256", "md5"):
        raise ValueError(f"no built-in digest {algorithm!r}")
    return F.sha2(content, 256) if algorithm == "sha256" else F.md5(content)


def dst_by_time(mtime_s: Column, name: Column, pattern: str = "yyyy/MM") -> Column:
    """A destination below folders of the time in UTC, in lower case; the session's time zone makes no difference."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(mtime_s), F.current_timezone())
    return F.concat_ws("/", F.date_format(utc, pattern), F.lower(name))


def normalized_md5_matches(text: Column, digest: Column) -> Column:
    """MD5 of the content, or of the content with line ends made one byte."""
    return (F.md5(text) == digest) | (F.md5(F.replace(text, F.lit("\r\n"), F.lit("\n"))) == digest)


def version_numbers(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: x.cast("long"))


def version_matches(version: Column, expression: str) -> Column:
    """'>=1.2.0,<2.0.0|=3.0.0': commas all hold, bars any; the expression is read once on the driver."""
    operators = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "=": lambda a, b: a == b}
    own, any_of = version_numbers(version), []
    for group in expression.split("|"):
        all_of = []
        for part in (x.strip() for x in group.split(",")):
            sign = next((o for o in operators if part.startswith(o)), "")
            numbers = part[len(sign) :].strip().split(".")
            if len(numbers) != 3 or not all(x.isdigit() for x in numbers):
                raise ValueError(f"expected a numeric x.y.z version, got {part!r}")
            all_of.append(operators[sign or "="](own, F.array(*(F.lit(int(x)).cast("long") for x in numbers))))
        any_of.append(reduce(lambda a, b: a & b, all_of))
    return reduce(lambda a, b: a | b, any_of)


def object_version_uri(bucket: Column, key: Column, version: Column) -> Column:
    """bucket/key?versionId=version with bytes outside A-Za-z0-9-_.~ percent-encoded, '/' of the key kept."""
    plain = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(plain(bucket), F.lit("/"), F.replace(plain(key), F.lit("%2F"), F.lit("/")), F.coalesce(F.concat(F.lit("?versionId="), plain(version)), F.lit("")))


def epoch_day_to_date(day: Column) -> Column:
    return F.date_from_unix_date(day.cast("int"))
