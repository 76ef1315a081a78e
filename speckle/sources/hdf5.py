"""HDF5 inputs, where h5py is installed: sparse and dense frames, detectors, orientations. Not tested where it is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

try:
    import h5py
except ImportError:  # the other formats do without
    h5py = None


def _open(path: str):
    if h5py is None:
        raise RuntimeError("reading HDF5 files needs h5py")
    return h5py.File(path, "r")


def frames(spark: SparkSession, path: str, step: int = 1000) -> DataFrame:
    """(frame_id, place_ones, place_multi, count_multi) of a sparse file, read by the executors in ranges."""
    with _open(path) as f:
        n = len(f["place_ones"])

    def read(batches):
        for b in batches:
            with _open(path) as f:
                for lo in b["id"]:
                    hi = min(n, int(lo) + step)
                    cols = {k: [x.tolist() for x in f[k][int(lo) : hi]] for k in ("place_ones", "place_multi", "count_multi")}
                    import pandas as pd

                    yield pd.DataFrame({"frame_id": range(int(lo), hi), **cols})

    return spark.range(0, n, step).mapInPandas(read, "frame_id long, place_ones array<int>, place_multi array<int>, count_multi array<int>")


def length(path: str, dataset: str) -> int:
    with _open(path) as f:
        return len(f[dataset])


def dense(spark: SparkSession, path: str, dataset: str, step: int = 1000) -> DataFrame:
    """(frame_id, frame) of a dataset whose first axis counts frames, read by the executors in ranges."""
    n = length(path, dataset)

    def read(batches):
        import pandas as pd

        for b in batches:
            with _open(path) as f:
                for lo in b["id"]:
                    x = f[dataset][int(lo) : int(lo) + step]
                    yield pd.DataFrame({"frame_id": range(int(lo), int(lo) + len(x)), "frame": list(x.reshape(len(x), -1).astype(float))})

    return spark.range(0, n, step).mapInPandas(read, "frame_id long, frame array<double>")


def orientations(spark: SparkSession, path: str) -> DataFrame:
    """(r, q0..q3, w): rows of four numbers weigh the same, and all weights sum to 1."""
    from speckle.operators.orientation import table, weighted

    with _open(path) as f:
        return table(spark, weighted(f["quaternions"][:]))


def detector(spark: SparkSession, path: str) -> DataFrame:
    """(pix, qx, qy, qz, corr, mask) and background if there is one."""
    import pandas as pd

    with _open(path) as f:
        cols = {k: f[k][:].ravel() for k in ("qx", "qy", "qz", "corr", "mask", "background") if k in f}
    x = pd.DataFrame(cols)
    x.insert(0, "pix", range(len(x)))
    return spark.createDataFrame(x)
