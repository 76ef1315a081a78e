"""The binary frame format as a Spark data source: spark.read.format("emc"), df.write.format("emc").

A file is 1024 bytes of 32-bit integers (frames, pixels, type, zeros), then the numbers of ones and multis of each
frame, the places of ones, the places of multis and their counts. Type 0 is sparse; 1 and 2 hold every pixel as a
32-bit integer or a double. Rows are (frame_id, place_ones, place_multi, count_multi) for sparse files and
(frame_id, frame) for dense ones. Paths are those of a file system all executors mount.

A read sums the head of each file once, in slabs, when it is planned; a task gets the offsets at which its frames begin and
reads what is theirs alone. The option `ids`, as "33" or "28-31,40", names the frames to be read, so a lookup opens their
ranges only. (Spark's own push-down to such sources keeps what one query pushed for the next one on the same DataFrame, which
then lacks rows; so it is not used.) A write makes a file a task; single_file() puts them together.
"""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER, SPARSE, INTEGER, DOUBLE = 1024, 0, 1, 2
SPARSE_SCHEMA = "frame_id long, place_ones array<int>, place_multi array<int>, count_multi array<int>"
DENSE_SCHEMA = "frame_id long, frame array<double>"


def header(path: str) -> tuple[int, int, int]:
    with open(path, "rb") as f:
        n, pix, kind = np.frombuffer(f.read(12), "<i4").tolist()
    return n, pix, kind


def is_hdf5(path: str) -> bool:
    """Whether a file starts with the HDF5 signature."""
    with open(path, "rb") as f:
        return f.read(8) == b"\x89HDF\r\n\x1a\n"


@dataclass
class Slice(InputPartition):
    """Frames lo to hi of a file: the number of the first one of the file, and how many ones and multis lie before lo, and in all."""

    path: str
    lo: int
    hi: int
    first: int = 0
    before: tuple[int, int] = (0, 0)
    total: tuple[int, int] = (0, 0)


#: Numbers of a head that are summed at once.
SLAB = 1 << 22


def _sums(path: str, n: int, at: list[int]) -> list[tuple[int, int]]:
    """For each of the sorted frame numbers `at`, how many ones and multis lie before it; a head is read once."""
    out = np.zeros((len(at), 2), np.int64)
    for k in (0, 1):
        total, done = 0, 0
        for i, stop in enumerate(at):
            while done < stop:
                step = min(SLAB, stop - done)
                total += int(np.fromfile(path, "<i4", step, offset=HEADER + 4 * (k * n + done)).sum(dtype=np.int64))
                done += step
            out[i, k] = total
    return [tuple(x) for x in out.tolist()]


def slices(path: str, first: int = 0, step: int = 10_000, ranges: list[tuple[int, int]] | None = None) -> list[Slice]:
    """A file's frames in parts of `step`, or of ranges of frame numbers, counted from `first` on."""
    n, _, kind = header(path)
    cuts = [(lo, min(lo + step, hi)) for a, b in (ranges or [(first, first + n)]) for lo, hi in [(max(0, a - first), min(n, b - first))] for lo in range(lo, hi, step)]
    if kind != SPARSE:
        return [Slice(path, lo, hi, first) for lo, hi in cuts]
    ends = sorted({n, *[lo for lo, _ in cuts]})
    sums = dict(zip(ends, _sums(path, n, ends)))
    return [Slice(path, lo, hi, first, sums[lo], sums[n]) for lo, hi in cuts]


def rows(s: Slice):
    """The frames of a slice: tuples of arrays, read from where they lie."""
    n, pix, kind = header(s.path)
    if kind != SPARSE:
        x = np.memmap(s.path, "<i4" if kind == INTEGER else "<f8", "r", HEADER, (n, pix))
        for k in range(s.lo, min(s.hi, n)):
            yield (x[k].astype(float),)
        return
    read = lambda count, at: np.fromfile(s.path, "<i4", count, offset=at) if count else np.zeros(0, "<i4")
    ones, multi = (read(s.hi - s.lo, HEADER + 4 * (k * n + s.lo)).astype(np.int64) for k in (0, 1))
    base = HEADER + 8 * n
    places = read(int(ones.sum()), base + 4 * s.before[0])
    at = base + 4 * (s.total[0] + s.before[1])
    more, counts = read(int(multi.sum()), at), read(int(multi.sum()), at + 4 * s.total[1])
    a, c = np.concatenate([[0], np.cumsum(ones)]), np.concatenate([[0], np.cumsum(multi)])
    for k in range(len(ones)):
        yield places[a[k] : a[k + 1]], more[c[k] : c[k + 1]], counts[c[k] : c[k + 1]]


def frames(path: str, lo: int, hi: int):
    """Frames lo to hi of a file."""
    for s in slices(path, 0, max(1, hi - lo), [(lo, hi)]):
        yield from rows(s)


def write(path: str, pix: int, rows: list[tuple]) -> None:
    """A sparse file of rows (place_ones, place_multi, count_multi)."""
    cols = [[np.asarray(r[i], "<i4") for r in rows] for i in range(3)]
    head = np.zeros(HEADER // 4, "<i4")
    head[:3] = len(rows), pix, SPARSE
    counts = [np.array([len(x) for x in cols[i]], "<i4") for i in (0, 1)]
    with open(path, "wb") as f:
        for x in (head, *counts, *[np.concatenate(c) if c else np.zeros(0, "<i4") for c in cols]):
            f.write(x.tobytes())


def ranges(ids: str) -> list[tuple[int, int]]:
    """Sorted ranges of frame numbers, their ends left out, that neither meet nor overlap: of "28-31,40" (28, 32) and (40, 41)."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((int(x[0]), int(x[-1]) + 1) for x in (p.split("-") for p in ids.replace(" ", "").split(",") if p)):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], step: int, ids: str | None):
        self.paths, self.step, self.ranges = paths, step, None if ids is None else ranges(ids) or [(0, 0)]

    def partitions(self):
        out, first = [], 0
        for p in self.paths:
            out += slices(p, first, self.step, self.ranges)
            first += header(p)[0]
        return out

    def read(self, part):
        # without any partition Spark asks for none
        for k, x in enumerate(rows(part) if part else ()):
            yield (part.first + part.lo + k, *[v.tolist() for v in x])


class _Done(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceWriter):
    """One file a task, named when all tasks are done, so a task that is run again leaves no second file."""

    def __init__(self, path: str, pix: int):
        self.path, self.pix = path, pix

    def write(self, rows):
        from pyspark import TaskContext

        task = TaskContext.get()
        got = sorted(((r.frame_id, r.place_ones, r.place_multi, r.count_multi) for r in rows), key=lambda r: r[0])
        if not got:
            return _Done(None)
        os.makedirs(self.path, exist_ok=True)
        to = os.path.join(self.path, f".part-{task.partitionId():05d}-{task.taskAttemptId()}.emc")
        write(to, self.pix, [r[1:] for r in got])
        return _Done(to)

    def commit(self, messages):
        for m in messages:
            if m is not None and m.path:
                name = os.path.basename(m.path)[1:].rsplit("-", 1)[0] + ".emc"
                os.replace(m.path, os.path.join(self.path, name))

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class EmcSource(DataSource):
    """Options: path (file, folder or pattern), frames (of a partition), ids, num_pix (when writing)."""

    @classmethod
    def name(cls) -> str:
        return "emc"

    def _paths(self) -> list[str]:
        p = self.options["path"]
        return sorted(glob.glob(os.path.join(p, "part-*.emc")) if os.path.isdir(p) else glob.glob(p))

    def schema(self) -> str:
        return SPARSE_SCHEMA if header(self._paths()[0])[2] == SPARSE else DENSE_SCHEMA

    def reader(self, schema):
        return _Reader(self._paths(), int(self.options.get("frames", 10_000)), self.options.get("ids"))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options["num_pix"]))


def single_file(spark: SparkSession, folder: str, path: str, copied: int = 1 << 26) -> int:
    """Puts the sparse files of a folder together, in the order of their names, as one file, and returns its frames.

    A first pass sums each part's head; from the sums follow the places at which its sections lie in the file, and tasks
    copy them there, `copied` bytes at a time. The file gets its name when all have ended, so a task that runs again writes
    the same bytes to the same places. The order of parts and of frames in them is that of the frames written, if these were
    repartitioned by range.
    """
    names = sorted(glob.glob(os.path.join(folder, "part-*.emc")))
    if not names:
        raise ValueError(f"{folder} holds no parts")

    def heads(batches):
        for b in batches:
            for k, name in zip(b.column("k").to_pylist(), b.column("name").to_pylist()):
                n, pix, _ = header(name)
                ((ones, multi),) = _sums(name, n, [n])
                yield pa.RecordBatch.from_pylist([{"k": k, "name": name, "n": n, "pix": pix, "ones": ones, "multi": multi}])

    parts = spark.createDataFrame(list(enumerate(names)), "k long, name string").repartition(len(names))
    found = parts.mapInArrow(heads, "k long, name string, n long, pix long, ones long, multi long").orderBy("k").collect()
    total = {x: sum(r[x] for r in found) for x in ("n", "ones", "multi")}
    if len({r.pix for r in found}) > 1:
        raise ValueError(f"parts of {folder} differ in their pixels")
    # sections of the file, and where each part's begin in it and in its own file
    sections = ("n", "n", "ones", "multi", "multi")
    starts = [HEADER + 4 * sum(total[x] for x in sections[:i]) for i in range(len(sections))]
    jobs, done = [], dict.fromkeys(total, 0)
    for r in found:
        own = HEADER
        for start, x in zip(starts, sections):
            jobs += [(r.name, own + at, start + 4 * done[x] + at, min(copied, 4 * r[x] - at)) for at in range(0, 4 * r[x], copied)]
            own += 4 * r[x]
        for x in total:
            done[x] += r[x]
    head = np.zeros(HEADER // 4, "<i4")
    head[:3] = total["n"], found[0].pix, SPARSE
    unfinished = f"{path}.unfinished"
    with open(unfinished, "wb") as f:
        f.write(head.tobytes())
        f.truncate(starts[-1] + 4 * total["multi"])

    def copy(batches):
        for b in batches:
            for name, at, to, n in zip(*(b.column(x).to_pylist() for x in ("name", "at", "to", "n"))):
                with open(name, "rb") as f, open(unfinished, "r+b") as g:
                    f.seek(at)
                    g.seek(to)
                    g.write(f.read(n))
            yield pa.RecordBatch.from_arrays([b.column("n")], ["n"])

    todo = spark.createDataFrame(jobs, "name string, at long, to long, n long").repartition(max(1, min(len(jobs), 4 * spark.sparkContext.defaultParallelism)))
    todo.mapInArrow(copy, "n long").agg(F.sum("n")).collect()
    os.replace(unfinished, path)
    return total["n"]


def write_single(frames: DataFrame, path: str, num_pix: int) -> int:
    """Sparse frames (frame_id, place_ones, place_multi, count_multi) as one file in the order of frame_id; the number of frames."""
    folder = f"{path}.parts"
    frames.repartitionByRange("frame_id").write.format("emc").option("path", folder).option("num_pix", num_pix).mode("append").save()
    n = single_file(frames.sparkSession, folder, path)
    for name in glob.glob(os.path.join(folder, "part-*.emc")):
        os.remove(name)
    os.rmdir(folder)
    return n
