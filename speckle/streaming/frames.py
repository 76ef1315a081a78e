"""Frames and logs as they arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from speckle.sources import texts


def running_powder(photons: DataFrame) -> DataFrame:
    """(pix, total) so far, of a stream of (frame_id, pix, cnt); state is a row for each pixel."""
    return photons.groupBy("pix").agg(F.sum("cnt").alias("total"))


def windowed_counts(photons: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(start, photons, frames) of time windows; windows close, and their state goes, `late` after their end."""
    x = photons.withWatermark(time, late).groupBy(F.window(time, width))
    return x.agg(F.sum("cnt").alias("photons"), F.approx_count_distinct("frame_id").alias("frames")).select(F.col("window.start").alias("start"), "photons", "frames")


def log_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the iteration logs that appear in a folder."""
    return texts.log(spark.readStream.text(folder))


def run_to_end(df: DataFrame, name: str, mode: str) -> DataFrame:
    """A stream's result over what is there now, as a table in memory: for tests and small looks."""
    spark = df.sparkSession
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


MOVES = "frame_id long, iteration int, moved boolean, late boolean"


class _Last(StatefulProcessor):
    """Keeps of each frame the last iteration that was seen and its orientation."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "iteration int, rmax int", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        t = pd.concat(list(rows)).sort_values("iteration", kind="stable")
        seen, out = self.last.get() if self.last.exists() else None, []
        for iteration, rmax in zip(t["iteration"].tolist(), t["rmax"].tolist()):
            late = seen is not None and iteration <= seen[0]
            out.append((key[0], iteration, None if late or seen is None else rmax != seen[1], late))
            if not late:
                seen = (iteration, rmax)
        self.last.update(seen)
        out = [x for x in out if x[2] is not None or x[3]]
        yield pd.DataFrame({n: pd.Series([x[i] for x in out], dtype=k) for i, (n, k) in enumerate((("frame_id", "int64"), ("iteration", "int32"), ("moved", "boolean"), ("late", "bool")))})

    def close(self) -> None:
        pass


def orientation_moves(log: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(frame_id, iteration, moved, late) of a stream (iteration, frame_id, rmax), as rows come: whether a frame's orientation
    differs from that of the iteration before, as analysis.changes() has it.

    State is a row a frame, which is forgotten keep_ms after its last change, if that is given: the next iteration then
    counts as the first. Rows of one batch may come in any order; one of an iteration that is not past the last seen is late
    and says nothing of moves. Wants the RocksDB state store.
    """
    return log.groupBy("frame_id").transformWithStateInPandas(_Last(keep_ms), MOVES, "Append", "ProcessingTime" if keep_ms else "None")
