"""Mappings that carry where their sources come from, and functions over them."""

from __future__ import annotations

import asyncio
import inspect
from collections import deque
from collections.abc import Awaitable, Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Context:
    base: str
    endpoint: str | None = None


@dataclass(frozen=True)
class Mapping:
    """rows(src, dst, ...) whose src is below the context's base at its endpoint."""

    rows: DataFrame
    context: Context

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Mapping:
        """A function of the DataFrame; the context stays. It is lazy."""
        return replace(self, rows=fn(self.rows))

    def map_rows(self, fn: Callable[[dict], dict | None]) -> Mapping:
        """A function of one entry that gives an entry or None to omit it. It runs in tasks, in no promised order."""
        schema, columns = self.rows.schema, self.rows.columns

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = [x for x in map(fn, f.astype(object).where(f.notna(), None).to_dict("records")) if x is not None]
                yield pd.DataFrame(out, columns=columns)

        return replace(self, rows=self.rows.mapInPandas(run, schema))

    def map_rows_async(self, fn: Callable[[dict], dict | None | Awaitable[dict | None]], under_way: int = 16, error: str = "error") -> Mapping:
        """A function of one entry that may be awaited; it gives an entry or None to omit it. Entries stay in order within a partition.

        Each task has an event loop with at most `under_way` calls at a time, and reads on only as they end. An entry whose
        call raises stays as it came, and the column `error`, null for all others, says what was raised. Calls may be made again if a task is lost.
        """
        columns = self.rows.columns
        if error in columns or under_way < 1:
            raise ValueError(f"{error!r} is a column already, or nothing may be under way")
        schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in self.rows.schema), T.StructField(error, T.StringType())])  # a function may return nulls

        async def one(entry: dict) -> dict | None:
            try:
                found = fn(entry)
                found = await found if inspect.isawaitable(found) else found
                return None if found is None else {**found, error: None}
            except Exception as e:  # whatever the function raises is this entry's outcome
                return {**entry, error: f"{type(e).__name__}: {e}"}

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with asyncio.Runner() as runner:
                loop, calls = runner.get_loop(), deque()
                framed = lambda found: pd.DataFrame([x for x in found if x is not None], columns=[*columns, error])
                for f in frames:
                    out = []
                    for entry in f.astype(object).where(f.notna(), None).to_dict("records"):
                        if len(calls) == under_way:
                            out.append(loop.run_until_complete(calls.popleft()))
                        calls.append(loop.create_task(one(entry)))
                    yield framed(out)
                yield framed([loop.run_until_complete(x) for x in calls])

        return replace(self, rows=self.rows.mapInPandas(run, schema))

    def union(self, other: Mapping) -> Mapping:
        """Entries of both; sources of different contexts are refused."""
        if self.context != other.context:
            raise ValueError(f"sources of {other.context} cannot join those of {self.context}")
        return replace(self, rows=self.rows.unionByName(other.rows))


def consumed(contents: DataFrame, key: str, callback: Callable[[bytes], object], out: str) -> DataFrame:
    """What a callback makes of each content of contents(key, content), as `out` (name and type); a null content gives null.

    The callback gets the bytes and runs in tasks, perhaps more than once for an entry; contents stay where they are.
    """
    name = out.split()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], name: [None if x is None else callback(bytes(x)) for x in f["content"]]})

    of = contents.schema[key].dataType.simpleString()
    return contents.select(key, F.col("content").cast("binary").alias("content")).mapInPandas(run, f"{key} {of}, {out}")
