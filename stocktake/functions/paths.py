"""Scalar functions of paths. A path is relative, its components are parted by '/'; the empty path is the root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_name(path: Column) -> Column:
    """The last component."""
    return F.element_at(F.split(path, "/"), -1)


def path_extension(path: Column) -> Column:
    """What follows the last dot of the name; empty without one, or with a leading dot alone."""
    return F.regexp_extract(path_name(path), r"(?s)^.+\.([^.]*)$", 1)


def path_parent(path: Column) -> Column:
    """The path without its last component; empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def path_ancestors(path: Column) -> Column:
    """Every strict prefix that ends before a '/', from the top."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.expr("cast(array() as array<string>)"))


def path_join(a: Column, b: Column) -> Column:
    """No '/' where a side is empty."""
    return F.concat_ws("/", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def path_relative(path: Column, root: Column) -> Column:
    """The remainder below root, '' for root itself, null outside; 'a' is not above 'ab'."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(root == "", path).when(path == root, F.lit("")).when(inside, F.substring(path, F.length(root) + 2, F.length(path)))


def expression_path(root: Column, relative: Column) -> Column:
    """A root entry goes by its own name."""
    return F.coalesce(F.nullif(relative, F.lit("")), path_name(root))


def path_error(path: Column) -> Column:
    """Why a path is refused, or null."""
    parts = F.split(path, "/")
    return (
        F.when(path.isNull(), F.lit("missing"))
        .when(path == "", F.lit("empty"))
        .when(F.startswith(path, F.lit("/")), F.lit("absolute"))
        .when(F.contains(path, F.lit("\0")), F.lit("nul"))
        .when(F.exists(parts, lambda c: c == ""), F.lit("empty_component"))
        .when(F.exists(parts, lambda c: c.isin(".", "..")), F.lit("dot_component"))
    )


def decode_path(encoding: Column, value: Column) -> Column:
    """Bytes of a tagged path: UTF-8 text, or strict base64; null where the value is malformed."""
    strict = F.rlike(value, F.lit(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"))
    return F.when(encoding == "utf-8", F.encode(value, "UTF-8")).when((encoding == "base64") & strict, F.try_to_binary(value, F.lit("base64")))


def encode_path(raw: Column) -> Column:
    """A tagged path: text where the bytes are UTF-8, else base64."""
    valid = F.is_valid_utf8(raw.cast("string"))
    return F.when(valid, F.struct(F.lit("utf-8").alias("encoding"), raw.cast("string").alias("value"))).otherwise(F.struct(F.lit("base64").alias("encoding"), F.base64(raw).alias("value")))


#: The tool whose leftovers are looked for: part of every name below.
TOOL = "transfer"


def is_partial_name(path: Column, tool: str = TOOL) -> Column:
    """`.NAME.<tool>-partial-` and 16 characters of a-z and 2-7, as copies leave beside their target."""
    return F.rlike(path_name(path), F.lit(rf"(?s)^\..*\.{tool}-partial-[a-z2-7]{{16}}$"))


def is_object_partial_name(path: Column, tool: str = TOOL) -> Column:
    """`.<tool>-s3-HASH.partial` with 64 lower-case hex digits, as object downloads leave."""
    return F.rlike(path_name(path), F.lit(rf"^\.{tool}-s3-[0-9a-f]{{64}}\.partial$"))


def is_recovery_name(path: Column, tool: str = TOOL) -> Column:
    """`.<tool>-swap-PROCESS-COUNTER` as any component: entries displaced by an interrupted replacement."""
    return F.exists(F.split(path, "/"), lambda c: F.rlike(c, F.lit(rf"^\.{tool}-swap-[0-9]+-[0-9]+$")))
