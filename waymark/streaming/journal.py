"""Streams of journal lines.

Spark's file source never reads a file again that has grown, so a Python
source keeps byte offsets: a batch is the byte ranges that were added, and a
line that isn't finished yet waits for its line feed.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from waymark.sources.tables import JUMP, remove


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class JournalReader(DataSourceStreamReader):
    """Whole lines by (file, byte offset); a file that got shorter is read anew, one that vanished is forgotten.

    Driver and executors read the folder as a path of their own, so on a
    cluster it is one that all of them mount.  ``start`` is ``all`` lines, or
    ``last``: the last jump of the file changed last, and what is added later.
    """

    def __init__(self, folder: str, start: str = "all"):
        if start not in ("all", "last"):
            raise ValueError(f"start is all or last, not {start!r}")
        self.folder, self.start = folder, start

    def initialOffset(self) -> dict:
        ends = self._ends() if self.start == "last" else {}
        if ends:
            newest = max(ends, key=lambda path: (os.stat(path).st_mtime_ns, path))
            if (at := self._last_jump(newest, ends[newest])) is not None:
                ends[newest] = at
        return ends

    def _last_jump(self, path: str, end: int) -> int | None:
        """Where the last line with a jump begins; the file is read from its end."""
        tail, lo = b"", end
        with open(path, "rb") as f:
            while lo:
                step = min(lo, 1 << 16)
                lo -= step
                f.seek(lo)
                tail = f.read(step) + tail
                # the first line of the tail may be cut, unless it is the file's first
                first = 0 if not lo else tail.find(b"\n") + 1
                at = len(tail)
                while at > first:
                    begin = max(tail.rfind(b"\n", 0, at - 1) + 1, first)
                    if b'"FSDJump"' in tail[begin:at]:
                        return lo + begin
                    at = begin
        return None

    def _ends(self) -> dict[str, int]:
        ends = {}
        for path in sorted(glob.glob(os.path.join(self.folder, "Journal.*"))):
            with open(path, "rb") as f:
                size = f.seek(0, os.SEEK_END)
                # back to the end of the last finished line
                while size:
                    step = min(size, 1 << 16)
                    f.seek(size - step)
                    if (at := f.read(step).rfind(b"\n")) >= 0:
                        size += at + 1 - step
                        break
                    size -= step
            ends[path] = size
        return ends

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            if stop != begin:
                out.append(_Range(path, begin if begin < stop else 0, stop))
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                if line.strip():
                    yield (partition.path, at, line.decode("utf-8", "replace").rstrip("\r\n"))
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def streamReader(self, schema) -> JournalReader:
        return JournalReader(self.options["path"], self.options.get("start", "all"))


def stream_jumps(spark: SparkSession, folder: str, start: str = "all") -> DataFrame:
    """FSDJump events of a folder of growing journals, as a stream; ``start`` as in JournalReader."""
    spark.dataSource.register(JournalSource)
    lines = spark.readStream.format("journal").option("start", start).load(folder)
    return lines.select("path", "offset", F.from_json("value", JUMP).alias("e")).select("path", "offset", "e.*").where("event = 'FSDJump'")


def _in_order(frames):
    """All rows of a key in a batch, by file and place in it: journals' names begin with their time."""
    return pd.concat(list(frames)).sort_values(["path", "offset"], kind="stable")


def track(jumps: DataFrame, key: str = "commander", sample: str = "every") -> DataFrame:
    """Changes of location per key, by a state that holds the last one: (key, system, path, offset).

    ``sample`` is ``every`` jump, or the ``last`` one of each batch, as one
    sees it who looks at a journal only now and then.
    """

    def step(k, frames, state):
        last = state.get[0] if state.exists else None
        rows = _in_order(frames)[["StarSystem", "path", "offset"]]
        out = []
        for system, path, offset in (rows.tail(1) if sample == "last" else rows).itertuples(index=False):
            if system != last:
                out.append((k[0], system, path, offset))
                last = system
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "system", "path", "offset"])

    return jumps.groupBy(key).applyInPandasWithState(step, f"{key} string, system string, path string, offset long", "last string", "append", GroupStateTimeout.NoTimeout)


def advance(jumps: DataFrame, nodes: DataFrame, key: str = "commander") -> DataFrame:
    """Progress along a route (system, seq) per key: (key, system, progress) whenever it grows.

    The largest place reached is state of the stream, so it is checkpointed
    with it and goes on after a restart.
    """
    first = nodes.groupBy(F.col("system").alias("StarSystem")).agg((F.min("seq") + 1).cast("long").alias("place"))
    on_route = jumps.join(F.broadcast(first), "StarSystem")

    def step(k, frames, state):
        best = state.get[0] if state.exists else 0
        out = []
        for system, place in _in_order(frames)[["StarSystem", "place"]].itertuples(index=False):
            if place > best:
                best = place
                out.append((k[0], system, best))
        state.update((int(best),))
        yield pd.DataFrame(out, columns=[key, "system", "progress"])

    return on_route.groupBy(key).applyInPandasWithState(step, f"{key} string, system string, progress long", "best long", "append", GroupStateTimeout.NoTimeout)


class Tracker:
    """Follows a stream of changes and hands each batch of them to a sink (frame, batch number).

    What the stream knows lies in ``checkpoint``: a tracker that is started
    again goes on where the last one ended, unless that one was stopped with
    ``clear``, after which the same location counts as new.
    """

    def __init__(self, changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 1.0):
        self.changes, self.sink, self.checkpoint, self.seconds = changes, sink, checkpoint, seconds
        self.query: StreamingQuery | None = None

    @property
    def tracking(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self) -> Tracker:
        if not self.tracking:
            writer = self.changes.writeStream.foreachBatch(self.sink).option("checkpointLocation", self.checkpoint)
            self.query = writer.trigger(processingTime=f"{int(self.seconds * 1000)} milliseconds").start()
        return self

    def stop(self, clear: bool = True) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
        if clear:
            remove(self.changes.sparkSession, self.checkpoint)


def persisted(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the latest row of each batch's keys under ``path``, one folder a batch, written anew if a batch is repeated."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
