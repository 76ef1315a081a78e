"""Cross-tokenizer alignment: groups of tokens that two tokenizers end at the same bytes, and corpus-wide counts of the links."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.llm import _common as c
from speckle.llm import _tokens

#: A worker forgets its aligned units beyond so many, or so many characters of them.
CACHE_UNITS, CACHE_CHARS = 600_000, 32 << 20
#: Texts are cut into units in pieces of about so many characters.
PIECE = 1 << 20
#: Units are encoded together up to about so many characters; links of a group beyond so many are counted by distinct ids.
AT_ONCE, LONG = 1 << 16, 1 << 12
#: Pairs of ids whose counts are broadcast, at most (16 bytes each): the most frequent ones. Others are joined.
HEAD = 1 << 19
#: Pairs that a task holds before it merges them.
MERGE = 4 << 20
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


@functools.cache
def _byte_level(path: str):
    """The tokenizer, for which special tokens' strings are plain text, and the bytes of each id and how many."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    entry = {i: bytes(byte[x] for x in token) if all(x in byte for x in token) else token.encode() for token, i in vocab.items()}
    sizes = np.zeros(max(entry) + 1, np.int64)
    sizes[list(entry)] = [len(x) for x in entry.values()]
    return t, entry, sizes


@functools.cache
def _sentence_pieces(path: str):
    """The tokenizer, the bytes of each id, how many, and whether the id stands for a single byte.

    No piece may hold a space after another character: then nothing merges across the start of a word, and units can be
    encoded by themselves.
    """
    t = _tokens._pieces(path)
    pieces = [t.id_to_piece(i) for i in range(t.get_piece_size())]
    if len(pieces) > 1 << 16 or any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError(f"{path}: pieces run across words, or are too many")
    single = np.array([t.is_byte(i) for i in range(len(pieces))])
    entry = [bytes([int(p[1:-1], 16)]) if s else p.replace("▁", " ").encode() for p, s in zip(pieces, single)]
    return t, entry, np.array([len(x) for x in entry]), single


def _ends(coarse: np.ndarray, rough: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens end: the ends of their spans, refined by decoded bytes where a span says too little."""
    return np.where(rough, np.cumsum(sizes), coarse)


def spans_a(path: str, text: str):
    """(ids, ends) of a text that begins with a space; None where the tokens' bytes are not the text's.

    Spans count characters, and all tokens of a character that is split have the span of the whole: those that another
    one of the same character follows are placed by their own bytes.
    """
    t, entry, sizes = _byte_level(path)
    (e,) = t.encode_batch([text], add_special_tokens=False)
    if b"".join(map(entry.__getitem__, e.ids)) != text.encode():
        return None
    ids = np.array(e.ids, np.int64)
    spans = np.fromiter(itertools.chain.from_iterable(e.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
    rough = np.append(spans[1:, 0] < spans[:-1, 1], False)[: len(ids)]
    if not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        byte_at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))])
        spans = byte_at[spans]
    return ids, _ends(spans[:, 1], rough, sizes[ids])


def spans_b(path: str, text: str):
    """The same of the other tokenizer, which adds the first space itself.

    Its proto has spans in bytes of the text without that space. Byte-fallback tokens of a character have empty spans
    but for the last one, and are placed by the byte that each stands for. (The library's former 'immutable_proto' is
    called 'proto' in the version installed.)
    """
    t, entry, sizes, single = _sentence_pieces(path)
    found = [v for x in t.encode(text[1:], return_type="proto").pieces for v in (x.id, x.end)]
    ids, ends = np.array(found, np.int64).reshape(-1, 2).T
    if b"".join(map(entry.__getitem__, found[::2])) != text.encode():
        return None
    return ids, _ends(ends + 1, single[ids], sizes[ids])


def _firm(x: str) -> bool:
    """Whether units() cuts after the character."""
    return "!" <= x <= "~" or x.isalnum()


def units(text: str) -> list[str]:
    """space + text cut before single spaces that follow a letter, digit or ASCII sign; without that space each.

    Neither tokenizer has a token, or looks, across such a place: the first splits there whatever stands around it, the
    second has no piece with a space inside, which _sentence_pieces() makes sure of.
    """
    parts = text.split(" ")
    if parts[-1] and all(map(_firm, {x[-1:] for x in parts})):
        return parts
    out, own = [], parts[:1]
    for x in parts[1:]:
        if own[-1] and _firm(own[-1][-1]):
            out.append(" ".join(own))
            own = [x]
        else:
            own.append(x)
    out.append(" ".join(own))
    if len(out) > 1 and not out[-1]:
        out[-2:] = [out[-2] + " "]
    return out


def pieces(text: str):
    """text cut before spaces as units() does, into pieces of about PIECE characters, without the space that units() adds."""
    lo = 0
    while len(text) - lo > PIECE:
        at = lo + PIECE
        while (at := text.find(" ", at)) >= 0 and not ("!" <= text[at - 1] <= "~" or text[at - 1].isalnum()):
            at += 1
        if at < 0 or not text[at:].strip(" "):
            break
        yield text[lo:at]
        lo = at + 1
    yield text[lo:]


class Batch:
    """Units encoded as one text: of each its numbers of tokens, groups and links, what its groups are, and its links."""

    def __init__(self, a, b, ends: np.ndarray):
        """a, b: (ids, ends) of the text; ends: where the units end."""
        n = len(ends)
        common = np.intersect1d(a[1], b[1], assume_unique=True)
        unit, of_a, of_b = np.searchsorted(ends, common), np.searchsorted(common, a[1]), np.searchsorted(common, b[1])
        n_a, n_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        add = lambda x: np.bincount(unit, x, n).astype(np.int64)
        self.counts = np.stack([add(n_a), add(n_b), np.bincount(unit, minlength=n), add(n_a * n_b)], 1)
        # links: every token of A with every one of B of its group; of long groups every distinct id with every other
        long = n_a * n_b > LONG
        each = np.nonzero(~long[of_a])[0]
        first = np.concatenate([[0], np.cumsum(n_b)])[of_a[each]]
        size = n_b[of_a[each]]
        at_b = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        pair, owner = np.repeat(a[0][each], size) << 32 | b[0][at_b], np.repeat(unit[of_a[each]], size)
        times = np.ones(len(pair), np.int64)
        for g in np.nonzero(long)[0].tolist():
            (x, nx), (y, ny) = (np.unique(ids[of == g], return_counts=True) for ids, of in ((a[0], of_a), (b[0], of_b)))
            pair = np.concatenate([pair, (x[:, None] << 32 | y[None]).ravel()])
            times = np.concatenate([times, (nx[:, None] * ny[None]).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), unit[g])])
        order = np.argsort(owner, kind="stable")
        self.pair, self.times, self.n_links = pair[order], times[order], np.bincount(owner, minlength=n)
        # ids in order, the tokens of A of a group before those of B
        ids, side = np.concatenate([a[0], b[0]]), np.repeat([0, 1], [len(a[0]), len(b[0])])
        of = np.concatenate([of_a, of_b])
        order = np.lexsort((side, of))
        ids, side, of = ids[order], side[order], of[order]
        last = np.append((of[1:] != of[:-1]) | (side[1:] != side[:-1]), True)[: len(ids)]
        said = _said()
        words = list(map(said.__getitem__, (ids * 3 + last * (1 + side)).tolist()))
        size = np.fromiter(map(len, words), np.int64, len(words))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(unit[of], size, n).astype(np.int64))]).tolist()
        text = b"".join(words)
        self.said = [text[i : j - 1] for i, j in zip(cuts, cuts[1:])]


@functools.cache
def _said() -> list[bytes]:
    """Each id with what may follow it: another of its kind, the other kind, the next group."""
    return [f"{i}{x}".encode() for i in range(1 << 16) for x in ",|;"]


class Aligned:
    """Units aligned so far: counts and texts of each, and its links as ranges of flat arrays."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.bad: set[int] = set()
        self.said: list[bytes] = []
        self.parts: list[Batch] = []
        self.chars, self.flat = 0, None

    def encoded(self, new: list[str]) -> Batch | None:
        """Of the units as one text; None if it has other bytes than its tokens."""
        text = " " + " ".join(new)
        a, b = spans_a(self.a, text), spans_b(self.b, text)
        return None if a is None or b is None else Batch(a, b, np.cumsum([1 + len(u.encode()) for u in new]))

    def add(self, new: list[str]):
        self.flat = None
        lo = 0
        while lo < len(new):
            # so many at once; units that end in what no unit may follow come alone
            hi, size = lo, 0
            while hi < len(new) and size < AT_ONCE and (hi == lo or _firm(new[hi - 1][-1:])):
                size += len(new[hi])
                hi += 1
            if (x := self.encoded(new[lo:hi])) is None:
                if hi - lo > 1:
                    mid = (lo + hi) // 2
                    self.add(new[lo:mid])
                    self.add(new[mid:hi])
                    lo = hi
                    continue
                self.bad.add(len(self.known))
                x = Batch((np.zeros(0, np.int64),) * 2, (np.zeros(0, np.int64),) * 2, np.array([1]))
            for u in new[lo:hi]:
                self.known[u] = len(self.known)
            self.said += x.said
            self.parts.append(x)
            self.chars += size
            lo = hi

    def numbers(self, text: str, cut: list[list[str]]) -> np.ndarray:
        """The numbers of the text's units; none for a text without tokens. cut: its units, where they are known."""
        out = []
        for us in cut or map(units, pieces(text)):
            if not cut and (new := set(us).difference(self.known)):
                self.add(sorted(new, key=lambda u: _firm(u[-1:]), reverse=True))
            out.append(np.fromiter(map(self.known.__getitem__, us), np.int64, len(us)))
        at = np.concatenate(out) if out else np.zeros(0, np.int64)
        if self.bad and not self.bad.isdisjoint(at.tolist()):
            # A unit with other bytes than the tokens': the whole text decides.
            if text not in self.known:
                self.add([text])
            i = self.known[text]
            return np.array([] if i in self.bad else [i], np.int64)
        return at

    def arrays(self):
        if self.flat is None:
            join = lambda name: np.concatenate([getattr(x, name) for x in self.parts]) if self.parts else np.zeros(0, np.int64)
            first = np.concatenate([[0], np.cumsum(join("n_links"))]).astype(np.int64)
            times = join("times")
            self.flat = first, join("pair"), None if (times == 1).all() else times, join("counts").reshape(-1, 4)
        return self.flat

    def rows(self, doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        if len(self.known) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self.clear()
        # units of all short texts at once
        cut = [[units(t)] if 0 < len(t) <= PIECE else [] for t in texts]
        if new := set().union(*(x[0] for x in cut if x)).difference(self.known):
            self.add(sorted(new, key=lambda u: _firm(u[-1:]), reverse=True))
        of = [self.numbers(t, x) if t else np.zeros(0, np.int64) for t, x in zip(texts, cut)]
        first, pair, times, counts = self.arrays()
        n = np.array([len(x) for x in of])
        at = np.concatenate(of) if of else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(of)), n)
        total = np.zeros((len(of), 4), np.int64)
        for k in range(4):
            total[:, k] = np.bincount(doc, counts[at, k], len(of)) if len(at) else 0
        # links of all units of all texts, and the same pair of a text added up; ids of B are below 2^16
        size = first[at + 1] - first[at]
        flat = np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        both = np.repeat(doc, size) << 40 | pair[flat] >> 32 << 16 | pair[flat] & 0xFFFF
        if times is None:
            both.sort()
        else:
            order = np.argsort(both, kind="stable")
            both, times = both[order], times[flat][order]
        where = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
        sums = np.diff(np.append(where, len(both))) if times is None else np.add.reduceat(times, where) if len(where) else np.zeros(0, np.int64)
        both = both[where]
        cuts = pa.array(np.searchsorted(both >> 40, np.arange(len(of) + 1)).astype(np.int32))
        pairs = pa.ListArray.from_arrays(cuts, pa.array((both >> 16 & 0xFFFFFF) << 32 | both & 0xFFFF))
        sha = [hashlib.sha256(b";".join(map(self.said.__getitem__, x.tolist()))).hexdigest() if len(x) else "" for x in of]
        cols = [doc_ids, *[pa.array(total[:, k]) for k in range(4)], pa.array(sha, pa.string()), pairs, pa.ListArray.from_arrays(cuts, pa.array(sums))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


@functools.cache
def _aligned(a: str, b: str) -> Aligned:
    return Aligned(a, b)


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row of docs.

    pairs has each pair of ids that the text links, id of A * 2^32 + id of B, and times how often.
    """

    def run(batches):
        known = _aligned(a, b)
        for x in batches:
            for s in c.slices([x], "text", size=4 << 20):
                yield known.rows(s.column("doc_id"), s.column("text").to_pylist())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_or_empty().alias("text")).mapInArrow(run, ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many rows of alignments() hold each pair; counted in each task before they are shuffled."""

    def count(batches):
        keys, n, held = [], [], 0

        def merged():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at.reshape(-1), np.concatenate(n), len(k)).astype(np.int64)

        for b in batches:
            k, m = np.unique(b.column("pairs").flatten().to_numpy(), return_counts=True)
            keys.append(k)
            n.append(m)
            held += len(k)
            if held > MERGE:
                k, m = merged()
                if len(k) > MERGE // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m)], ["pair", "n"])
                    k, m = k[:0], m[:0]
                keys, n, held = [k], [m], len(k)
        if keys:
            k, m = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m)], ["pair", "n"])

    return rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, a: str, b: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    A text's tokens of `a` (a byte-level .json) and of `b` (a sentencepiece .model) are cut into groups at the bytes where
    both have an end; a link is a token of each in one group, its count the number of rows that hold the pair of ids. The
    counts of the most frequent pairs are broadcast, `head` of them at most, and the greatest count of each id of A, which
    the vocabulary bounds; links of other pairs are joined. Texts that are null, empty, or that either tokenizer writes
    otherwise (U+2581 in the text) have no tokens: zeros and ''. Texts of any length are aligned whole; rows that repeat
    count each, with or without a doc_id; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    with c.arrow_batches(spark, size="8m"):
        rows = c.stored(alignments(docs, a, b).withColumn("row", F.monotonically_increasing_id()), "align-rows")
        counts = c.stored(pair_counts(rows), "align-counts")
    level = F.floor(F.log2("n")).cast("int")
    least, total = 64, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if (total := total + r["count"]) > head:
            break
        least = r.level
    top = counts.filter(level >= least).toArrow()
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).toArrow()
    key = np.array(top.column("pair"), np.int64)
    order = np.argsort(key)
    most = np.zeros(int(max(best.column("a").to_pylist(), default=0)) + 1, np.int64)
    most[np.array(best.column("a"), np.int64)] = np.array(best.column("n"), np.int64)
    shared = spark.sparkContext.broadcast((key[order], np.array(top.column("n"), np.int64)[order], most))

    def resolve(batches):
        key, n, most = shared.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy()
            flat, size = pairs.flatten().to_numpy(), pairs.value_lengths().to_numpy()
            at = np.minimum(np.searchsorted(key, flat), max(0, len(key) - 1))
            found = key[at] == flat if len(key) else np.zeros(len(flat), bool)
            count = np.where(found, n[at], 0) if len(key) else np.zeros(len(flat), np.int64)
            owner = np.repeat(np.arange(len(b)), size)
            add = lambda x: np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(size)])]
            sums, bests = np.diff(add(count * times)), np.diff(add(np.where(found & (count == most[flat >> 32]), times, 0)))
            rest = np.nonzero(~found)[0]
            cuts = pa.array(np.searchsorted(owner[rest], np.arange(len(b) + 1)).astype(np.int32))
            tail = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(flat[rest]), pa.array(times[rest]), pa.array(most[flat[rest] >> 32])], ["pair", "times", "most"]))
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(bests), pa.array(sums), tail], [*b.schema.names[:7], "n_best", "count_sum", "tail"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    with c.arrow_batches(spark, size="8m"):
        got = c.stored(rows.select(*kept, "pairs", "times").mapInArrow(resolve, schema + ", tail array<struct<pair:long,times:long,most:long>>"), "align-resolved")
    c.drop(rows)
    if total > head:
        links = got.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(counts.filter(level < least), "pair")
        more = links.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("s"), F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("b"))
        got = got.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0)))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, _tokens.vocabulary("byte_bpe_50k.json"), _tokens.vocabulary("piece_bpe_32k.model"))


QUERIES = {"op13_alignment": op13_alignment}
ORACLE: dict[str, str] = {}
