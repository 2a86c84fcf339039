"""Files: scanning folders, writing and removing files from tasks. Tasks may run twice, so every step can be repeated."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.functions.ignore import ignored
from stocktake.functions.paths import path_depth

from .scratch import settle

SCANNED = "path string, kind string, size long, mtime_s long, mtime_ns int, warning string"
#: Entries of a listing that a task holds at once, however many a folder has.
_ROWS = 10_000


def _store(root: str):
    """The file system of a root given as URI or local path, and the root's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to several tasks for each core. The work on a file is the same whatever its row holds, so neither the row groups that the
    rows came in nor their few bytes, by which adaptive execution joins partitions, say how many tasks there should be."""
    return rows.repartition(4 * max(rows.sparkSession.sparkContext.defaultParallelism, 1), F.xxhash64(*keys))


def _entries(store, base: str, folder: str) -> Iterator[tuple]:
    """What stands directly in a folder below base: path, kind, size, time and a warning. Links are not followed where the store has any.

    A folder that cannot be listed, and an entry that cannot be looked at, is a row that has nothing but a path and a warning.
    """
    import os
    import stat

    at = f"{base}/{folder}" if folder else base
    under = lambda name: f"{folder}/{name}" if folder else name
    told = lambda path, what, e: (path, None, None, None, None, f"cannot {what}: {type(e).__name__}: {e.strerror or e}")
    if store.type_name == "local":
        try:
            found = os.scandir(at)
        except OSError as e:
            yield told(folder, "list", e)
            return
        with found:
            while True:
                try:
                    x = next(found, None)
                except OSError as e:
                    yield told(folder, "list", e)
                    return
                if x is None:
                    return
                try:
                    of = x.stat(follow_symlinks=False)
                    kind = "symlink" if x.is_symlink() else "dir" if x.is_dir(follow_symlinks=False) else "file" if stat.S_ISREG(of.st_mode) else "special"
                    yield under(x.name), kind, of.st_size if kind == "file" else None, of.st_mtime_ns // 10**9, of.st_mtime_ns % 10**9, None
                except OSError as e:
                    yield told(under(x.name), "stat", e)
    from pyarrow import fs

    try:
        found = store.get_file_info(fs.FileSelector(at, recursive=False))
    except OSError as e:
        yield told(folder, "list", e)
        return
    for x in found:
        kind = {fs.FileType.Directory: "dir", fs.FileType.File: "file"}.get(x.type, "special")
        seconds, nanos = divmod(x.mtime_ns, 10**9) if x.mtime_ns is not None else (None, None)
        yield under(x.base_name), kind, x.size if kind == "file" else None, seconds, nanos, None


def _frames(found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Entries as frames of at most _ROWS rows; the next are looked at when one is done with."""
    while rows := list(islice(found, _ROWS)):
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCANNED.split(", ")]).astype({"size": "Int64", "mtime_s": "Int64", "mtime_ns": "Int32"})


def scan_with_warnings(spark: SparkSession, root: str, ignore: Sequence[str] = ()) -> DataFrame:
    """path below root, kind (file, dir, symlink, special), size of files, time and warning of every entry below root; contents are not read.

    Each level of folders is one job that lists its folders in tasks; ignored entries
    are left out and ignored folders are not descended into, nor are links. Order rows
    by mapping.parents_first() for parents before children. A folder that cannot be listed, or an entry that cannot be looked at, is a
    row with a warning and no kind; the rest is listed all the same. A deletion must not follow from such a scan: prune.gated closes on its warnings.
    A root that cannot be listed is an error.
    """

    def listed(store, base: str, folder: str) -> Iterator[tuple]:
        for row in _entries(store, base, folder):
            if row[0] == "":
                raise OSError(f"{root}: {row[-1]}")
            yield row

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for f in frames:
            yield from _frames(row for folder in f["path"] for row in listed(store, base, folder))

    out, folders = None, spark.createDataFrame([("",)], "path string")
    while True:
        level = spread(folders, "path").mapInPandas(run, SCANNED)
        kept = F.col("warning").isNotNull() | ~ignored(F.col("path"), F.coalesce(F.col("kind") == "dir", F.lit(False)), ignore)
        level = settle(level.filter(kept) if ignore else level, "entries")
        out = level if out is None else out.unionByName(level)
        folders = level.filter("kind = 'dir'").select("path")
        if folders.isEmpty():
            return out


def scan_files(spark: SparkSession, root: str, ignore: Sequence[str] = ()) -> DataFrame:
    """The entries of scan_with_warnings. Folders that cannot be listed have none here: what deletes by a scan has to look at the warnings too."""
    return scan_with_warnings(spark, root, ignore).filter("warning is null").drop("warning")


def _refused(path: str) -> str | None:
    """Why a path may not be touched below a root."""
    parts = path.split("/") if path else [""]
    return "path leaves its root" if any(x in ("", ".", "..") for x in parts) or "\0" in path else None


def copy_files(contents: DataFrame, root: str, produce: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Writes each dst of contents(dst, content) below the shared folder root: under a temporary name, then moved into place.

    produce: a callback for each content. A promised `size` (a column of contents) is
    compared before the move. Returns dst, bytes, disposition (transferred or failed)
    and message: an entry that fails leaves nothing behind and does not stop the
    others. A null content is an empty file.
    """
    promised = F.col("size").cast("long") if "size" in contents.columns else F.lit(None).cast("long")

    def write(store, base: str, dst: str, content: bytes, size: float) -> int:
        from uuid import uuid4

        if reason := _refused(dst):
            raise ValueError(reason)
        data = content if produce is None else produce(content)
        if not pd.isna(size) and len(data) != int(size):
            raise ValueError(f"{len(data)} bytes where {int(size)} were promised")
        path = f"{base}/{dst}"
        store.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid4().hex}.part"
        try:
            with store.open_output_stream(part) as out:
                out.write(data)
            store.move(part, path)
        except BaseException:
            try:
                store.delete_file(part)
            except OSError:
                pass
            raise
        return len(data)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for f in frames:
            rows = []
            for dst, content, size in zip(f["dst"], f["content"], f["size"]):
                try:
                    rows.append((dst, write(store, base, dst, b"" if content is None else bytes(content), size), "transferred", None))
                except Exception as e:  # whatever a callback or a store raises is this entry's outcome
                    rows.append((dst, 0, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["dst", "bytes", "disposition", "message"])

    rows = contents.select("dst", F.col("content").cast("binary").alias("content"), promised.alias("size"))
    return spread(rows, "dst").mapInPandas(run, "dst string, bytes long, disposition string, message string")


def _remove_folder(store, path: str) -> bool:
    """Removes a folder that holds nothing; False where it holds anything.

    The local rmdir tests and removes at once. Elsewhere the folder is listed right before, and
    a store that deletes folders with what they hold is asked only if the list is empty.
    """
    import errno
    import os

    from pyarrow import fs

    if store.type_name == "local":
        try:
            os.rmdir(path)
        except OSError as e:
            if e.errno in (errno.ENOTEMPTY, errno.EEXIST):
                return False
            raise
        return True
    if store.get_file_info(path).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if store.get_file_info(fs.FileSelector(path, recursive=False)):
        return False
    store.delete_dir(path)
    return True


def remove_files(plan: DataFrame, root: str) -> DataFrame:
    """Removes each path of plan(path, kind): files first, then directories level by level from the deepest.

    Returns path, disposition and message: removed; already_absent, which counts as
    done; kept for a directory that still holds anything, which is never removed with
    it; failed with what the store said. Each level is one job, because a directory must be empty before it goes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for f in frames:
            rows = []
            for path, kind in zip(f["path"], f["kind"]):
                try:
                    if reason := _refused(path):
                        raise ValueError(reason)
                    if kind != "dir":
                        store.delete_file(f"{base}/{path}")
                    elif not _remove_folder(store, f"{base}/{path}"):
                        rows.append((path, "kept", "not empty"))
                        continue
                    rows.append((path, "removed", None))
                except FileNotFoundError:
                    rows.append((path, "already_absent", None))
                except (OSError, ValueError) as e:
                    rows.append((path, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "disposition", "message"])

    shape = "path string, disposition string, message string"
    out = settle(spread(plan.filter("kind != 'dir'").select("path", "kind"), "path").mapInPandas(run, shape), "removed")
    dirs = plan.filter("kind = 'dir'").select("path", "kind", path_depth(F.col("path")).alias("depth"))
    for (depth,) in sorted(dirs.select("depth").distinct().collect(), reverse=True):
        out = out.unionByName(settle(spread(dirs.filter(F.col("depth") == depth).select("path", "kind"), "path").mapInPandas(run, shape), "removed"))
    return out
