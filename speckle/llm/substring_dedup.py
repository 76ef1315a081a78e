"""Repeated substrings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases. A window of WINDOW bytes belongs to the first trigger within its
reach (to the least rolling hash there, where no trigger is), so equal windows have their trigger at the same place and
agree on the *core*, the CORE bytes after it. All windows of one trigger make an *item*: the phrase before the trigger,
of which they are suffixes, and what the parse goes on with, up to the last window's end.

The dictionary is the items' phrases, sorted from their ends; neighbours' common suffixes give, for each length d, the
classes of equal phrase suffixes. The parse is sorted by what follows the triggers; neighbours' common prefixes give the
classes of equal continuations. A window is a pair of both, so corpus order is that of (suffix class, rank in the
parse), and a window is repeated where a neighbour in this order agrees on WINDOW bytes. Bytes are compared, not hashes;
items that come again within a chunk are found by hashes and their bytes compared too.

Only items whose core occurs again are sorted: a count of hashed cores, in which a clash merely adds work, finds them.
Items of one core meet in one task; a core of more than PART_ROWS items is dealt to parts, whose windows then meet by the
128 bits of BLAKE2b, one row for each class of a part: these windows alone are not compared byte by byte.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.llm import _common as c
from speckle.llm._shingles import ODD, _powers

WINDOW, GRAM, PERIOD, CORE = 200, 12, 64, 64
#: Texts are parsed in chunks of about this many bytes; a longer text in slabs that overlap by a window.
CHUNK, SLAB = 1 << 20, 1 << 19
#: Cores that a bucket of the count holds on average, items that a bucket of the sort holds, and items of a core in one part.
BUCKET_CORES, BUCKET_ROWS, PART_ROWS = 200_000, 32_768, 4096
BUCKETS = 32
TABLE, FULL, PROBE, OTHERS, SORTED, DIGESTS = range(6)
#: Buckets from here on hold digests; negative ones hold what goes to the chunks as it is.
DIGEST_BUCKETS = 1 << 60
ROW = "bucket long, chunk long, kind int, data binary"
FOUND = "doc_id long, th long, spans binary, live binary, hot binary, n_live long"
CORES = np.dtype([("core", "<u8"), ("item", "<u4"), ("n", "<u4")])
HEAD = np.dtype([("at", "<u4"), ("size", "<u2"), ("back", "u1"), ("hot", "u1")])
DIGEST = np.dtype([("a", "<u8"), ("b", "<u8"), ("chunk", "<i8"), ("at", "<u4")])
PRIMES = ((2147483647, 1140671485), (2147483629, 1664525))


@functools.lru_cache(4)
def _prime_powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers below n of a number and of its inverse, modulo a prime; n is a power of two."""
    p, base = PRIMES[which]
    out = []
    for x in (base, pow(base, -1, p)):
        a = np.ones(1, np.uint64)
        while len(a) < n:
            a = np.concatenate([a, a * np.uint64(pow(x, len(a), p)) % np.uint64(p)])
        out.append(a.astype(np.uint32))
    return out[0], out[1]


class Text:
    """Rolling hashes of pieces of text end to end."""

    table = c.mix(np.arange(1, 257, dtype=np.uint64) * ODD)

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        self.n, self.raw, self.ends = len(raw), raw, ends
        self.room = 1 << max(1, int(self.n)).bit_length()
        self.power, self.inverse = _powers(self.room)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[raw] * self.power[: self.n], dtype=np.uint64)])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return c.mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * ODD)

    def second(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """62 bits more, of two hashes modulo primes."""
        out = np.zeros(len(a), np.uint64)
        for which, (p, _) in enumerate(PRIMES):
            p, (power, inverse) = np.uint64(p), _prime_powers(self.room, which)
            values = c.mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(7919 * (which + 1))) % p
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[self.raw] * power[: self.n] % p, dtype=np.uint64)])
            out = out << np.uint64(31) | (sums[b] - sums[a]) % p * inverse[a] % p
        return out

    def parse(self, window: int, gram: int, period: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(trigger, first, last) of each item: the window starts from first to last are those of this trigger."""
        reach, n = window - core, self.n
        if n < window:
            return (np.zeros(0, np.int64),) * 3
        roll = c.mix((self.sums[gram:] - self.sums[: n - gram + 1]) * self.inverse[: n - gram + 1])
        after = np.full(n + 1, n + window, np.int32)
        triggers = np.nonzero(roll % np.uint64(period) == 0)[0]
        after[triggers] = triggers
        after = np.minimum.accumulate(after[::-1])[::-1]
        room = np.maximum(np.diff(self.ends) - window + 1, 0)
        start = _spread(self.ends[:-1][room > 0].astype(np.int32), room[room > 0])
        if not len(start):
            return (np.zeros(0, np.int64),) * 3
        trigger = after[start]
        del after
        far = np.nonzero(trigger > start + reach)[0]
        if len(far):
            key = np.full(-(-(n + reach) // (reach + 1)) * (reach + 1) + reach + 1, ~np.uint64(0))
            key[: len(roll)] = (roll >> np.uint64(32) << np.uint64(32)) | np.arange(len(roll), dtype=np.uint64)
            key = key.reshape(-1, reach + 1)
            up, down = np.minimum.accumulate(key, 1).ravel(), np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
            s = start[far]
            trigger[far] = (np.minimum(down[s], up[s + reach]) & np.uint64(0xFFFFFFFF)).astype(np.int32)
            del key, up, down
        new = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1)])
        head = np.nonzero(new)[0]
        return tuple(x.astype(np.int64) for x in (trigger[head], start[head], start[np.concatenate([head[1:] - 1, [len(start) - 1]])]))


class Chunk:
    """Texts end to end as pieces no longer than a slab and a window, and their items; at: first starts in the texts' own bytes."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, window: int, gram: int, period: int, core: int, slab: int):
        sizes = np.diff(ends)
        parts = np.maximum(1, -(-np.maximum(sizes - window + 1, 0) // slab))
        row = np.repeat(np.arange(len(sizes)), parts)
        lo = ends[row] + (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * slab
        hi = np.minimum(lo + slab + window - 1, ends[row + 1])
        if len(row) > len(sizes):
            raw = np.concatenate([raw[a:b] for a, b in zip(lo, hi)])
        cuts = np.concatenate([[0], np.cumsum(hi - lo)])
        self.text = Text(raw, cuts)
        self.trigger, self.first, self.last = self.text.parse(window, gram, period, core)
        piece = np.searchsorted(cuts, self.first, "right") - 1
        self.at = self.first - cuts[piece] + lo[piece]
        #: How many items each text has; items of a text follow each other.
        self.items = np.bincount(row[piece], minlength=len(sizes))


def _same(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each distinct key, how often it comes, and for all places the number of their key."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    heads = np.nonzero(new)[0]
    return order[heads], np.diff(np.concatenate([heads, [len(order)]])), number


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each lo on, n of them."""
    return np.repeat((lo - np.cumsum(n) + n).astype(lo.dtype), n) + np.arange(n.sum(), dtype=lo.dtype)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> bytes:
    return np.stack([lo, hi], 1).astype("<i8").tobytes()


def _merged(pairs: np.ndarray) -> np.ndarray:
    """(k, 2) ranges as sorted ranges that neither meet nor overlap."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    top = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > top[:-1]])
    return np.stack([pairs[new, 0], top[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(pairs) - 1]])]], 1)


def _chunks(batches, least: int):
    """Arrow batches put together to chunks of at least so many bytes, but for the last."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(x: np.ndarray):
    cuts = np.concatenate([[0], np.nonzero(x[1:] != x[:-1])[0] + 1, [len(x)]]) if len(x) else [0]
    return [(x[lo], lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:])]


def _same_bytes(text: Text, first: np.ndarray, stop: np.ndarray, trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_same() of items by their bytes and the trigger's place in them: grouped by hashes, then compared with their group's first."""
    head, n, number = _same(text.hash(first, stop), text.second(first, stop), trigger - first)
    i = np.nonzero(n[number] > 1)[0]
    j = head[number[i]]
    size = stop[i] - first[i]
    if (size == stop[j] - first[j]).all() and (text.raw[_spread(first[i], size)] == text.raw[_spread(first[j], size)]).all():
        return head, n, number
    seen: dict[tuple, int] = {}
    number = np.array([seen.setdefault((q - a, text.raw[a:b].tobytes()), len(seen)) for a, b, q in zip(first.tolist(), stop.tolist(), trigger.tolist())], np.int64)
    _, head, n = np.unique(number, return_index=True, return_counts=True)
    return head, n, number


def _rows(bucket: np.ndarray, chunk: int, kind: int, data: np.ndarray):
    """One row for each bucket, of the records that fall into it."""
    order = np.argsort(bucket, kind="stable")
    for b, lo, hi in _runs(bucket[order]):
        yield int(b), chunk, kind, data[order[lo:hi]].tobytes()


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["bucket", "chunk", "kind", "data"])


def _to_chunk(chunk: int, kind: int, data: bytes, buckets: int) -> tuple:
    return -1 - chunk % buckets, chunk, kind, data


def _table(t: pa.Table, ends: np.ndarray, items: np.ndarray, chunk: int, buckets: int) -> tuple:
    """The row that names a chunk's texts, their ends and their numbers of items."""
    return _to_chunk(chunk, TABLE, np.stack([t["doc_id"].to_numpy(), t["th"].to_numpy(), ends[1:], items], 1).astype("<i8").tobytes(), buckets)


def _first_pass(buckets: int, window: int, gram: int, period: int, core: int, chunk_bytes: int, slab: int):
    """Of each chunk: its texts, items that come again within it, and the cores of its distinct items for the count."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for t in _chunks(batches, chunk_bytes):
            chunk += 1
            raw, ends = c.flat_bytes(t["text"])
            x = Chunk(raw, ends, window, gram, period, core, slab)
            rows = [_table(t, ends, x.items, chunk, buckets)]
            if len(x.at):
                stop = x.last + window
                head, n, number = _same_bytes(x.text, x.first, stop, x.trigger)
                again = n[number] > 1
                if again.any():
                    rows.append(_to_chunk(chunk, FULL, _ranges(x.at[again], (x.at + stop - x.first)[again]), buckets))
                cores = x.text.hash(x.trigger[head], x.trigger[head] + core)
                one, n, number = _same(cores)
                e = np.zeros(len(one), CORES)
                e["core"], e["item"], e["n"] = cores[one], head[one], n
                rows += _rows((e["core"] >> np.uint64(32)).astype(np.int64) % buckets, chunk, PROBE, e)
                more = np.setdiff1d(np.arange(len(head)), one)
                if len(more):
                    rows.append(_to_chunk(chunk, OTHERS, np.stack([head[one][number[more]], head[more]], 1).astype("<u4").tobytes(), buckets))
            yield _batch(rows)

    return run


def _count(key, t):
    """Tells each chunk which of its cores occur again, and how many items they have."""
    if key[0].as_py() < 0:
        return t.select(["bucket", "chunk", "kind", "data"])
    t = t.sort_by("chunk")
    data = t["data"].to_pylist()
    x = np.frombuffer(b"".join(data), CORES)
    chunk = np.repeat(t["chunk"].to_numpy(), [len(d) // CORES.itemsize for d in data])
    _, inverse = np.unique(x["core"], return_inverse=True)
    total = np.bincount(inverse, x["n"].astype(float))[inverse]
    live = np.nonzero(total > 1)[0]
    pairs = np.stack([x["item"][live], np.minimum(total[live], 2**32 - 1)], 1).astype("<u4")
    return pa.Table.from_batches([_batch([(-1, int(k), PROBE, pairs[lo:hi].tobytes()) for k, lo, hi in _runs(chunk[live])])])


def _assemble(part_rows: int):
    """A chunk's ranges and items dealt to its texts: a bit for each item that is to be sorted, and the items of hot cores."""

    def assemble(key, t):
        kinds, data = t["kind"].to_pylist(), t["data"].to_pylist()
        of = lambda kind, dtype: np.frombuffer(b"".join(d for k, d in zip(kinds, data) if k == kind), dtype)
        table = next((np.frombuffer(d, "<i8").reshape(-1, 4) for k, d in zip(kinds, data) if k == TABLE), None)
        if table is None:
            raise ValueError("a chunk without its table")
        ends, starts = np.concatenate([[0], table[:, 2]]), np.concatenate([[0], np.cumsum(table[:, 3])])
        spans = _merged(of(FULL, "<i8").reshape(-1, 2))
        # ranges of neighbouring texts may have met
        lo, hi = np.searchsorted(ends, spans[:, 0], "right") - 1, np.searchsorted(ends, spans[:, 1], "left")
        doc = _spread(lo, hi - lo)
        parts = np.stack([doc, np.maximum(np.repeat(spans[:, 0], hi - lo), ends[doc]) - ends[doc], np.minimum(np.repeat(spans[:, 1], hi - lo), ends[doc + 1]) - ends[doc]], 1)
        parts = parts[parts[:, 1] < parts[:, 2]]
        probes, others = of(PROBE, "<u4").reshape(-1, 2).astype(np.int64), of(OTHERS, "<u4").reshape(-1, 2).astype(np.int64)
        live = np.zeros(starts[-1], np.int64)
        live[probes[:, 0]] = probes[:, 1]
        live[others[:, 1]] = live[others[:, 0]]
        with_spans = {int(d): parts[a:b, 1:] for d, a, b in _runs(parts[:, 0])}
        some = sorted(with_spans.keys() | set((np.searchsorted(starts, np.nonzero(live)[0], "right") - 1).tolist()))
        cols = [[], [], [], [], []]
        for d in some:
            n = live[starts[d] : starts[d + 1]]
            hot = np.nonzero(n > part_rows)[0]
            for to, v in zip(cols, (d, with_spans[d].astype("<i8").tobytes() if d in with_spans else b"", np.packbits(n > 0).tobytes(), np.stack([hot, n[hot]], 1).astype("<u4").tobytes(), int((n > 0).sum()))):
                to.append(v)
        docs = np.array(cols[0], np.int64)
        arrays = [pa.array(table[docs, 0]), pa.array(table[docs, 1]), *[pa.array(x, pa.binary()) for x in cols[1:4]], pa.array(cols[4], pa.int64())]
        return pa.Table.from_arrays(arrays, ["doc_id", "th", "spans", "live", "hot", "n_live"])

    return assemble


def _second_pass(buckets: int, window: int, gram: int, period: int, core: int, chunk_bytes: int, slab: int, part_rows: int):
    """The live items' bytes, dealt by their core; those of a hot core by core and part."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for t in _chunks(batches, chunk_bytes):
            chunk += 1
            raw, ends = c.flat_bytes(t["text"])
            x = Chunk(raw, ends, window, gram, period, core, slab)
            starts = np.cumsum(x.items) - x.items
            bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(t["live"].to_pylist(), x.items)]
            live = np.nonzero(np.concatenate(bits))[0]
            hot = [np.frombuffer(h, "<u4").reshape(-1, 2).astype(np.int64) + [[s, 0]] for h, s in zip(t["hot"].to_pylist(), starts)]
            parts = np.zeros(len(x.at), np.int64)
            hot = np.concatenate(hot)
            parts[hot[:, 0]] = -(-hot[:, 1] // part_rows)
            first, q, parts = x.first[live], x.trigger[live], parts[live]
            size = x.last[live] + window - first
            part = (c.mix(live.astype(np.uint64) + np.uint64(chunk)) % np.maximum(parts, 1).astype(np.uint64)) * (parts > 0)
            bucket = (c.mix(x.text.hash(q, q + core) + part * ODD) % np.uint64(buckets)).astype(np.int64)
            rows = [_table(t, ends, x.items, chunk, buckets)]
            order = np.argsort(bucket, kind="stable")
            heads = np.zeros(len(live), HEAD)
            heads["at"], heads["size"], heads["back"], heads["hot"] = x.at[live], size, q - first, parts > 0
            for b, lo, hi in _runs(bucket[order]):
                i = order[lo:hi]
                rows.append((int(b), chunk, SORTED, len(i).to_bytes(4, "little") + heads[i].tobytes() + x.text.raw[_spread(first[i], size[i])].tobytes()))
            yield _batch(rows)

    return run


def _in_order(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each row, common, best): rows sorted by their first `sizes` bytes.

    common: how many bytes each place's row has in common with the one before; best: each row's most with a neighbour.
    """
    rows = np.ascontiguousarray(rows)
    order = np.lexsort((sizes, rows.view(f"S{rows.shape[1]}").ravel()))
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        depth = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        common[1:] = np.minimum(depth, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    best = np.empty(len(order), np.int64)
    best[order] = np.maximum(common, np.concatenate([common[1:], [0]]))
    return place, common, best


def repeated_windows(rows: np.ndarray, back: np.ndarray, ahead: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each distinct item, number of each row's item, which windows of an item occur in two rows or items).

    rows: an item's phrase of `back` bytes, right-aligned, then its continuation of `ahead` bytes; a window of item i that
    starts d bytes before the trigger is told by [i, d].
    """
    reach = rows.shape[1] - window
    left_place, left_common, left_best = _in_order(rows[:, :reach][:, ::-1], back)
    right_place, right_common, right_best = _in_order(rows[:, reach:], ahead)
    # places whose row equals the one before have one class; equal sizes sort side by side
    whole = []
    for place, common, sizes in ((left_place, left_common, back), (right_place, right_common, ahead)):
        at = np.empty(len(place), np.int64)
        at[place] = sizes
        same = np.concatenate([[False], (common[1:] == at[1:]) & (at[1:] == at[:-1])])
        whole.append((np.cumsum(~same) - 1)[place])
    head, n, number = _same(*whole)
    out = np.zeros((len(head), reach + 1), bool)
    d = np.arange(reach + 1)
    has = (d >= window - ahead[head][:, None]) & (d <= back[head][:, None])
    out[n > 1] = has[n > 1]
    lp, rp, lb, rb = left_place[head], right_place[head], left_best[head], right_best[head]
    for d in range(reach + 1):
        some = np.nonzero(has[:, d] & (lb >= d) & (rb >= window - d))[0]
        if len(some) < 2:
            continue
        suffix, follows = np.cumsum(left_common < d)[lp[some]], np.cumsum(right_common < window - d)[rp[some]]
        # corpus order of these windows: classes of equal suffixes, then ranks in the parse
        order = np.lexsort((rp[some], suffix))
        agree = (suffix[order[1:]] == suffix[order[:-1]]) & (follows[order[1:]] == follows[order[:-1]])
        out[some[order[1:][agree]], d] = out[some[order[:-1][agree]], d] = True
    return head, number, out


def _sort(window: int, core: int, buckets: int):
    """Repeated windows of a bucket's items as FULL ranges of their chunks; digests of the windows of hot cores."""
    reach = window - core

    def reduce(key, t):
        if key[0].as_py() < 0:
            return t.select(["bucket", "chunk", "kind", "data"])
        t = t.sort_by("chunk")
        heads, bodies, counts = [], [], []
        for d in t["data"].to_pylist():
            n = int.from_bytes(d[:4], "little")
            heads.append(np.frombuffer(d, HEAD, n, 4))
            bodies.append(np.frombuffer(d, np.uint8, offset=4 + n * HEAD.itemsize))
            counts.append(n)
        h, chunk = np.concatenate(heads), np.repeat(t["chunk"].to_numpy(), counts)
        at, size, back, width = h["at"].astype(np.int64), h["size"].astype(np.int64), h["back"].astype(np.int64), reach + window
        rows = np.zeros((len(h), width), np.uint8)
        rows.ravel()[_spread(np.arange(len(h)) * width + reach - back, size)] = np.concatenate(bodies)
        head, number, repeated = repeated_windows(rows, back, size - back, window)
        out = []
        # runs of repeated windows, from the one that starts first
        edge = np.diff(repeated[number].astype(np.int8), axis=1, prepend=0, append=0)
        (i, least), (_, most) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        lo, hi = at[i] + back[i] - most + 1, at[i] + back[i] - least + window
        for k, a, b in _runs(chunk[i]):
            out.append(_to_chunk(int(k), FULL, _ranges(lo[a:b], hi[a:b]), buckets))
        hot = np.zeros(len(head), bool)
        hot[number[h["hot"] > 0]] = True
        i = np.nonzero(hot)[0]
        if len(i):
            row = head[i]
            n = back[row] - (window - size[row] + back[row]) + 1
            d = _spread(window - size[row] + back[row], n)
            i, row, start = np.repeat(i, n), np.repeat(head[i], n), np.repeat(np.arange(len(i)) * width, n) + reach - d
            text = np.ascontiguousarray(rows[head[np.nonzero(hot)[0]]]).tobytes()
            e = np.zeros(len(start), DIGEST)
            digests = b"".join(hashlib.blake2b(text[k : k + window], digest_size=16).digest() for k in start.tolist())
            e["a"], e["b"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
            e["chunk"], e["at"] = np.where(repeated[i, d], -1, chunk[row]), np.where(repeated[i, d], 0, at[row] + back[row] - d)
            e = e[_same(e["a"], e["b"])[0]]
            out += _rows((e["a"] >> np.uint64(20)).astype(np.int64) % buckets + DIGEST_BUCKETS, -1, DIGESTS, e)
        return pa.Table.from_batches([_batch(out)])

    return reduce


def _meet(window: int):
    """Windows of hot cores that other parts have too."""

    def reduce(key, t):
        if key[0].as_py() < 0:
            return t.select(["bucket", "chunk", "kind", "data"])
        e = np.frombuffer(b"".join(t["data"].to_pylist()), DIGEST)
        _, n, number = _same(e["a"], e["b"])
        again = n > 1
        again[number[e["chunk"] < 0]] = True
        e = e[again[number] & (e["chunk"] >= 0)]
        e = e[np.argsort(e["chunk"], kind="stable")]
        at = e["at"].astype(np.int64)
        return pa.Table.from_batches([_batch([(-1, int(k), FULL, _ranges(at[lo:hi], at[lo:hi] + window)) for k, lo, hi in _runs(e["chunk"])])])

    return reduce


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, period: int = PERIOD, core: int = CORE, chunk_bytes: int = CHUNK, slab: int = SLAB, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, th, spans) of the rows (doc_id, th, text) that share a window with another place; th is a hash of the text.

    spans: ranges of bytes, pairs of little-endian 64-bit integers, in one or more binaries of a list; their union is
    what such windows cover. gram is at most core, and window - core below 256. rows come from a table, so that a task
    that runs again reads them in the same order.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    args, assemble = (window, gram, period, core, chunk_bytes, slab), _assemble(part_rows)
    with c.arrow_batches(spark, rows=500, size="1m"):
        passed = rows.mapInArrow(_first_pass(max(BUCKETS, size // period // BUCKET_CORES), *args), ROW).groupBy("bucket").applyInArrow(_count, ROW)
        found = c.stored(passed.groupBy("chunk").applyInArrow(assemble, FOUND), "spans-first")
        live = found.agg(F.sum("n_live")).first()[0] or 0
        if not live:
            return found.groupBy("doc_id", "th").agg(F.collect_set("spans").alias("spans"))
        # Of rows that repeat a doc_id and its text any stands for all, as their spans are joined below.
        wanted = found.filter("n_live > 0").groupBy("doc_id", "th").agg(F.max(F.struct("n_live", "live", "hot")).alias("w")).select("doc_id", "th", "w.live", "w.hot")
        # In a fixed order: a task that runs again after a lost executor must cut the same chunks.
        again = rows.join(c.stored(wanted, "spans-live"), ["doc_id", "th"]).select("doc_id", "th", "text", "live", "hot").sortWithinPartitions("doc_id", "th")
        buckets = max(BUCKETS, live // BUCKET_ROWS)
        items = again.mapInArrow(_second_pass(buckets, *args, part_rows), ROW).groupBy("bucket").applyInArrow(_sort(window, core, buckets), ROW)
        met = items.groupBy("bucket").applyInArrow(_meet(window), ROW)
        more = c.stored(met.groupBy("chunk").applyInArrow(assemble, FOUND), "spans-second")
    both = found.select("doc_id", "th", "spans").union(more.select("doc_id", "th", "spans")).filter("length(spans) > 0")
    return c.stored(both.groupBy("doc_id", "th").agg(F.collect_set("spans").alias("spans")), "spans")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), c.text_or_empty().alias("text"))
    return rows.withColumn("th", F.xxhash64("text"))


def without_repeats(docs: DataFrame, with_text: bool = False, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs, and the bytes kept if with_text.

    A byte goes if a window of WINDOW bytes that covers it also starts at another place of any text, or of the same.
    All copies go. Texts are UTF-8 bytes of any length, null is empty; windows do not cross texts. Rows that repeat are
    places of their own. An empty table gives an empty result; other columns are ignored.

    Where spans go to texts, Spark joins by their size: small ones are broadcast, others shuffled with the texts.
    """
    rows = _keyed(docs)
    spans = repeated_spans(rows, **how)

    def cut(batches):
        for b in c.slices(batches, "text"):
            raw, ends = c.flat_bytes(b["text"])
            cols = [[], [], [], [], []]
            for lo, hi, s in zip(ends[:-1], ends[1:], b["spans"].to_pylist()):
                pairs = _merged(np.frombuffer(b"".join(s or []), "<i8").reshape(-1, 2))
                text, edges = raw[lo:hi].tobytes(), [0, *pairs.ravel().tolist(), int(hi - lo)]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))
                for to, v in zip(cols, (len(text), len(text) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest(), kept)):
                    to.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [b["doc_id"], *[pa.array(x, k) for x, k in zip(cols, kinds)]][: 6 if with_text else 5]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    names = [x.split()[0] for x in schema.split(", ")]
    done = rows.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
    return done.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE: dict[str, str] = {}
