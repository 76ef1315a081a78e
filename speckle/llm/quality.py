"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.llm import _common as c

#: Labelled rows that a model is fitted on, at most, and bytes of their texts: those of the least hash of their doc_id.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 64 << 20
UPDATES, BATCH_ROWS, RATE, SEED = 400, 32, 0.01, 7
#: A chunk is two blocks, and chunks start at every block, so they overlap by half; a filter reads KERNEL bytes every STEP bytes.
BLOCK, KERNEL, STEP, WIDTH, FILTERS = 256, 12, 4, 8, 16
SLAB = 512


class ByteConv:
    """Byte embedding, filters, max over each chunk, then max and mean over the chunks, and a logistic unit."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, WIDTH)).astype("f4"),
            "filters": r.normal(0, (2 / (KERNEL * WIDTH)) ** 0.5, (KERNEL * WIDTH, FILTERS)).astype("f4"),
            "bias": np.zeros(FILTERS, "f4"), "out": r.normal(0, 0.1, 2 * FILTERS).astype("f4"), "out_bias": np.zeros(1, "f4"),
        }

    @staticmethod
    def blocks(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of BLOCK bytes and the look-ahead of the last filter, zeros after a text's end; and each text's first row."""
        n = np.diff(ends)
        rows = np.maximum(1, -(-n // BLOCK))
        first = np.concatenate([[0], np.cumsum(rows)])
        flat = np.zeros(first[-1] * BLOCK, np.uint8)
        flat[np.repeat(first[:-1] * BLOCK - ends[:-1], n) + np.arange(len(raw))] = raw
        x = np.zeros((first[-1], BLOCK + KERNEL - STEP), np.uint8)
        x[:, :BLOCK] = flat.reshape(-1, BLOCK)
        x[:-1, BLOCK:] = x[1:, : KERNEL - STEP]
        x[first[1:] - 1, BLOCK:] = 0
        return x, first

    def activations(self, x: np.ndarray) -> np.ndarray:
        """(rows, windows, FILTERS) of byte rows."""
        e = self.p["embed"][x]
        s = e.strides
        win = np.lib.stride_tricks.as_strided(e, (len(x), BLOCK // STEP, KERNEL * WIDTH), (s[0], s[1] * STEP, s[2]))
        return (win.reshape(-1, KERNEL * WIDTH) @ self.p["filters"]).reshape(len(x), BLOCK // STEP, FILTERS)

    def pooled(self, tops: np.ndarray, first: np.ndarray):
        """Features of each text from its rows' maxima: (texts, 2 * FILTERS); and the chunks' maxima and last rows."""
        last = np.zeros(len(tops), bool)
        last[first[1:] - 1] = True
        nxt = np.where(last, np.arange(len(tops)), np.arange(1, len(tops) + 1))
        chunks = np.maximum(np.maximum(tops, tops[nxt]), 0)
        # a text's last row makes no chunk of its own, unless it is the only one
        counts = np.maximum(1, np.diff(first) - 1)
        keep = ~last
        keep[first[:-1][np.diff(first) == 1]] = True
        mean = np.add.reduceat(chunks * keep[:, None], first[:-1]) / counts[:, None]
        return np.hstack([np.maximum.reduceat(chunks, first[:-1]), mean]).astype("f4"), chunks, nxt, keep, counts

    def scores(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(ends) < 2:
            return np.zeros(0)
        x, first = self.blocks(raw, ends)
        tops = np.concatenate([self.activations(x[i : i + SLAB]).max(1) for i in range(0, len(x), SLAB)]) + self.p["bias"]
        z = self.pooled(tops, first)[0] @ self.p["out"] + self.p["out_bias"]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))

    def gradients(self, raw: np.ndarray, ends: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p = self.p
        x, first = self.blocks(raw, ends)
        act = [self.activations(x[i : i + SLAB]) for i in range(0, len(x), SLAB)]
        arg = np.concatenate([a.argmax(1) for a in act])
        tops = np.concatenate([a.max(1) for a in act]) + p["bias"]
        f, chunks, nxt, keep, counts = self.pooled(tops, first)
        d = (1 / (1 + np.exp(-np.clip(f @ p["out"] + p["out_bias"], -30, 30))) - y).astype("f4") / len(y)
        text = np.repeat(np.arange(len(y)), np.diff(first))
        g = (d[:, None] * p["out"][None, FILTERS:] / counts[:, None])[text] * keep[:, None]
        top = np.maximum.reduceat(chunks, first[:-1])[text]
        hit = (chunks == top) & (np.arange(len(x))[:, None] == np.minimum.reduceat(np.where(chunks == top, np.arange(len(x))[:, None], len(x)), first[:-1])[text])
        g = (g + (d[:, None] * p["out"][None, :FILTERS])[text] * hit) * (chunks > 0)
        rows = np.where(tops >= tops[nxt], np.arange(len(x))[:, None], nxt[:, None])
        at, k = np.nonzero(g)
        row, value = rows[at, k], g[at, k]
        window = x[row[:, None], (arg[row, k] * STEP)[:, None] + np.arange(KERNEL)]
        # What each byte at each place of each filter adds; both gradients are products of it.
        seen = np.bincount(((k[:, None] * KERNEL + np.arange(KERNEL)) * 256 + window).ravel(), np.repeat(value, KERNEL), FILTERS * KERNEL * 256)
        seen = seen.reshape(FILTERS * KERNEL, 256).astype("f4")
        back = (seen @ p["embed"]).reshape(FILTERS, KERNEL * WIDTH).T
        embed = seen.T @ p["filters"].T.reshape(FILTERS * KERNEL, WIDTH)
        bias = np.bincount(k, value, FILTERS).astype("f4")
        return {"embed": embed, "filters": back, "bias": bias, "out": f.T @ d, "out_bias": d.sum(keepdims=True)}

    def fit(self, texts: list[bytes], y: np.ndarray, updates: int = UPDATES, seed: int = SEED) -> ByteConv:
        """Adam on shuffled batches; the rate falls to nothing."""
        r, m, v = np.random.default_rng(seed), {}, {}
        order: list[int] = []
        for step in range(updates if texts else 0):
            if len(order) < min(BATCH_ROWS, len(texts)):
                order += r.permutation(len(texts)).tolist()
            batch, order = order[:BATCH_ROWS], order[BATCH_ROWS:]
            ends = np.concatenate([[0], np.cumsum([len(texts[i]) for i in batch])]).astype(np.int64)
            g = self.gradients(np.frombuffer(b"".join(texts[i] for i in batch), np.uint8), ends, y[batch])
            for k, x in g.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                v[k] = 0.999 * v.get(k, 0) + 0.001 * x * x
                self.p[k] -= (RATE * (1 - step / updates) * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.999 ** (step + 1))) + 1e-8)).astype("f4")
        return self


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, updates: int = UPDATES) -> ByteConv:
    """A model of labels.quality from at most `rows` labelled rows that are not held out, of SAMPLE_BYTES in all.

    Only the whole texts of these rows reach the driver; a row whose text does not fit any more is left out, and those after
    it are tried. Null labels and ids teach nothing; of several labels of a
    document the largest holds, of rows that repeat an id any. Without any label every score is that of the untrained
    net. Other columns are ignored.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col("doc_id").alias("_id"), c.text_or_empty().alias("_t"))
    sizes = texts.join(F.broadcast(known), "_id").groupBy("_id", "_y").agg(F.max(F.octet_length("_t")).alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()
    fits, left = [], SAMPLE_BYTES
    for r in sizes:
        if r.n <= left:
            fits.append((r._id, r._y))
            left -= r.n
    known = docs.sparkSession.createDataFrame(fits, known.schema)
    got = texts.join(F.broadcast(known), "_id").dropDuplicates(["_id"]).collect()
    got.sort(key=lambda r: r._id)
    return ByteConv().fit([r._t.encode("utf-8", "replace") for r in got], np.array([r._y for r in got], "f4"), updates)


def score(docs: DataFrame, model: ByteConv) -> DataFrame:
    """docs' rows as (doc_id, held_out, score, predicted). Only the text enters the score.

    Null text is empty text, which has a score too; texts of any length are read whole; a null doc_id is not held out;
    rows that repeat are scored each; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for b in c.slices(batches, "text"):
            s = model.scores(*c.flat_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), c.text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: ByteConv) -> DataFrame:
    """The rows of docs, with their columns whatever their names, that the model predicts as good, as score() has it."""

    def run(batches):
        for b in c.slices(batches, "text"):
            yield b.filter(pa.array(model.scores(*c.flat_bytes(b.column("text"))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
