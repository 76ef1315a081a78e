"""Quality rules: statistics of whole texts, and minimum-covariance-determinant estimates per language and source that
reject by Mahalanobis distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speckle.llm import _common as c
from speckle.llm._shingles import SPACE, pieces

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Ratios are taken as if a text had this many ordinary words more, of ORDINARY characters each: a short text says less.
PRIOR, ORDINARY = 30, 5
#: Numbers of the vector are rounded to this part, so that sums of them are exact and estimates the same in every run.
SCALE = 1000
#: What each number of the vector is known to, as a standard deviation: length, word length, symbols, equal lines, repeats.
NOISE = (1.5, 0.05, 0.05, 0.5, 0.15)
P = len(NOISE)
#: Share of a group's rows that its estimate rests on; groups of fewer rows are estimated together, and not at all if these are as few.
SHARE, MIN_ROWS, STEPS = 0.75, 50, 20
#: Quantiles of the distance under normality: of rows that refine an estimate, and beyond which a text is rejected.
REFINE, REJECT = 0.975, 0.9999
#: Bins of a distance's logarithm; a bin is 2%.
BINS = 50
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MOMENTS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]
PARAMS = [*[f"m{i}" for i in range(P)], *[f"p{i}{j}" for i, j in PAIRS]]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: First bytes of characters of words.
_LETTER = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)


def statistics(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of the five statistics of each text; words, lines and windows are compared as they are, not by hashes."""
    out = np.zeros((len(ends) - 1, 5), np.int64)
    numbers: dict[bytes, int] = {}
    ids = []
    for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        own, text = raw[lo:hi], raw[lo:hi].tobytes()
        for piece in pieces(text):
            words = piece.split()
            for w in set(words).difference(numbers):
                numbers[w] = len(numbers)
            ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            out[i, 0] += len(words)
        out[i, 1] = np.count_nonzero(_LETTER[own])
        out[i, 2] = np.count_nonzero(_SYMBOL[own])
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        out[i, 3] = len(lines) - len(set(lines))
    out[:, 4] = _repeated(np.concatenate(ids) if ids else np.zeros(0, np.int64), out[:, 0])
    return out


def _repeated(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text in windows of WINDOW that it holds twice or more, from the words' numbers, text after text."""
    n = len(w) - WINDOW + 1
    if n < 1:
        return np.zeros(len(counts), np.int64)
    # numbers of windows of two, four and five words, made of those of shorter ones
    number = lambda a, b: pd.factorize(a * (int(b.max()) + 1) + b)[0]
    two = number(w[:-1], w[1:])
    five = number(number(two[:-2], two[2:])[:n], w[WINDOW - 1 :])
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.nonzero(text[:n] == text[WINDOW - 1 :])[0]
    key = pd.factorize(text[at] * (int(five.max()) + 1) + five[at])[0]
    start = np.zeros(len(w) + WINDOW, np.int8)
    start[at[np.bincount(key, minlength=1)[key] > 1] + WINDOW] = 1
    covered = np.zeros(len(w), bool)
    for k in range(WINDOW):
        covered |= start[WINDOW - k : WINDOW - k + len(w)] > 0
    return np.bincount(text[covered], minlength=len(counts))


def base_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the five statistics, base_failed) of every row of docs."""

    def run(batches):
        for b in c.slices(batches, "text"):
            s = statistics(*c.flat_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(x) for x in s.T]], ["doc_id", "lang", "source", *BASE.replace(" long", "").split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), c.text_or_empty().alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang string, source string, " + BASE)
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics, as whole numbers of 1 / SCALE."""
    n = F.col("n_words")
    parts = [
        F.log1p(n), F.log((F.col("word_chars") + PRIOR * ORDINARY) / (n + PRIOR)), F.sqrt(F.col("n_symbols") / (n + PRIOR)),
        F.log1p(F.col("n_dup_lines")), F.sqrt(F.col("n_repeat_words") / (n + PRIOR)),
    ]
    return [F.round(x * SCALE).cast("long") for x in parts]


def chi2(x: float, k: int) -> float:
    """The distribution function of chi-squared with k degrees of freedom."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x else 0.0


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if chi2((lo + hi) / 2, k) < q else (lo, (lo + hi) / 2)
    return lo


def consistency(q: float) -> float:
    """What a covariance of the share q of least distances is too small by, under normality."""
    return q / chi2(chi2_quantile(q, P), P + 2)


def _distance() -> Column:
    z = [F.col(x) / SCALE - F.col(f"m{i}") for i, x in enumerate(X)]
    terms = [(1 if i == j else 2) * F.col(f"p{i}{j}") * z[i] * z[j] for i, j in PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS]]


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """(group, PARAMS, size): means, the inverse of the covariance, and the logarithm of its determinant, of each group's sums."""
    noise = np.diag(np.square(NOISE))

    def run(batches):
        for b in batches:
            v = {k: b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in MOMENTS}
            mean = np.stack([v[f"s{i}"] / v["n"] / SCALE for i in range(P)], 1)
            cov = np.zeros((len(b), P, P))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = v[f"s{i}{j}"] / v["n"] / SCALE**2 - mean[:, i] * mean[:, j]
            cov = factor * cov + noise
            inv = np.linalg.inv(cov)
            cols = [b.column("group"), *[pa.array(mean[:, i]) for i in range(P)], *[pa.array(inv[:, i, j]) for i, j in PAIRS], pa.array(np.linalg.slogdet(cov)[1])]
            yield pa.RecordBatch.from_arrays(cols, ["group", *PARAMS, "size"])

    schema = "group string, " + ", ".join(f"{x} double" for x in PARAMS) + ", size double"
    return moments.select("group", *MOMENTS).mapInArrow(run, schema)


def _start(rows: DataFrame) -> DataFrame:
    """Estimates from the median and the quartiles of each number by itself, which outliers do not move far."""
    long = rows.select("group", F.posexplode(F.array(*X)).alias("i", "x")).groupBy("group", "i", "x").count()
    w = Window.partitionBy("group", "i").orderBy("x")
    long = long.withColumn("upto", F.sum("count").over(w)).withColumn("all", F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    q = lambda share: F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("x")))
    found = long.groupBy("group", "i").agg(q(0.5).alias("median"), ((q(0.75) - q(0.25)) / 1.349).alias("spread"))
    of = lambda i, x: F.max(F.when(F.col("i") == i, F.col(x))) / SCALE
    wide = found.groupBy("group").agg(*[of(i, "median").alias(f"m{i}") for i in range(P)], *[of(i, "spread").alias(f"d{i}") for i in range(P)])
    inverse = [(1 / (F.col(f"d{i}") * F.col(f"d{i}") + NOISE[i] ** 2) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in PAIRS]
    return wide.select("group", *[f"m{i}" for i in range(P)], *inverse, F.lit(math.inf).alias("size"))


def fit(rows: DataFrame) -> DataFrame:
    """(group, PARAMS, size) of each group of rows (group, X): the minimum covariance determinant, by steps of concentration.

    A step is one aggregation: sums by group and bin of distance, of which the bins hold up to SHARE of the group make
    the next estimate. Sums are of whole numbers, so the order of rows changes nothing. Steps end when no determinant
    shrinks any more. Last, rows within the REFINE quantile make the final estimate.
    """
    now, before = c.stored(_start(rows), "rules-start"), math.inf
    w = Window.partitionBy("group").orderBy("bin")
    for step in range(STEPS):
        near = rows.join(c.small(now, 20_000).drop("size"), "group").withColumn("bin", F.floor(BINS * F.log(_distance() + 1e-6)))
        bins = near.groupBy("group", "bin").agg(*_moments())
        bins = bins.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("group")))
        held = bins.filter(F.col("before") < SHARE * F.col("all")).groupBy("group").agg(*[F.sum(x).alias(x) for x in MOMENTS])
        new = c.stored(_estimates(held, consistency(SHARE)), "rules-step")
        c.drop(now)
        now, size = new, new.agg(F.sum("size")).first()[0]
        if size is None or size > before - 1e-3:
            break
        before = size
    near = rows.join(c.small(now, 20_000), "group").filter(_distance() <= chi2_quantile(REFINE, P))
    last = c.stored(_estimates(near.groupBy("group").agg(*_moments()), consistency(REFINE)), "rules-estimates")
    c.drop(now)
    return last


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row.

    Rows that fail the base rules take no part in the estimates, and have no distance. The others are grouped by lang and
    source, null being a value of its own; groups of fewer than MIN_ROWS are estimated as one, and where these are still
    fewer there is no estimate: such rows are kept, without a distance. Null text is empty and fails the base rules; texts
    of any length are read whole; rows that repeat count as often as they are there; an empty table gives an empty
    result; other columns are ignored.
    """
    with c.arrow_batches(docs.sparkSession, size="8m"):
        facts = c.stored(base_rules(docs).withColumn("group", F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})).drop("lang", "source"), "rules-facts")
    sizes = facts.filter("NOT base_failed").groupBy("group").count().filter(F.col("count") >= MIN_ROWS).select("group", F.lit(True).alias("own"))
    grouped = facts.join(c.small(sizes, 100_000), "group", "left").withColumn("group", F.when(F.col("own"), F.col("group")).otherwise("")).drop("own")
    rows = grouped.select("*", *[x.alias(n) for x, n in zip(vector(), X)])
    good = rows.filter("NOT base_failed").select("group", *X)
    few = good.filter("group = ''").count() < MIN_ROWS
    found = fit(good.filter("group <> ''") if few else good)
    judged = rows.join(c.small(found, 20_000).drop("size"), "group", "left")
    distance = F.when(~F.col("base_failed") & F.col("m0").isNotNull(), _distance())
    judged = judged.withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(REJECT, P), F.lit(True))
    return judged.select("doc_id", *BASE.replace(" long", "").split(", "), "base_failed", kept.alias("kept"), "distance")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_quality_rules": op12_quality_rules}
ORACLE: dict[str, str] = {}
