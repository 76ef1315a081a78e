"""N-gram Jaccard join by grouped prefixes: collapse, filter group pairs, expand and verify members.

Candidates are found by 64 bits of a shingle's hash, and texts are one class when the 128-bit digest of their sets of
128-bit shingles is the same (BLAKE2b, by words and by sets). Pairs are verified by their words, not by hashes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speckle.llm import _common as c
from speckle.llm._shingles import exact_sets, forget, shingle_sets

WORDS, PERCENT = 4, 85
#: Counters of shingles (a byte each is broadcast), the pieces that they are added up in, and what makes a shingle frequent.
COUNTER_BITS, PIECES, HOT_DF = 23, 64, 16
COUNTERS = 1 << COUNTER_BITS
#: Groups that share a prefix token are all paired up to this number; beyond it each is first paired with a few pivots.
BUCKET, PIVOTS = 32, 4
#: Groups of a hot token that one task compares.
BLOCK = 512
#: Ids up to this number may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
PAIR = "a long, b long, na long, nb long"


def least_overlap(na, nb, percent: int):
    """The least intersection at which sizes na and nb link: percent of the union."""
    return -(-(percent * (na + nb)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _sets(batch, k: int):
    raw, ends = c.flat_bytes(batch.column("text"))
    return shingle_sets(raw, ends, k)


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """A level for each of COUNTERS places of the shingles' hashes: 0 for rare ones, else rising with the frequency.

    Every shingle of every document is counted at its place; the counters are added up in two steps, piece by piece,
    and only their levels, a byte each, reach the driver. Shingles that share a place share its level: the level
    orders them, so any will do. A place is rare below what chance fills places with, and HOT_DF more.
    """
    step = COUNTERS // PIECES

    def packed(x: np.ndarray) -> bytes:
        return zlib.compress(np.minimum(x, 2**32 - 1).astype("<u4").tobytes(), 1)

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            got = [s[:, 0] for s in _sets(b, k) if len(s)]
            if got:
                at, n = np.unique((np.concatenate(got) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), return_counts=True)
                total[at] += n
        forget()
        part = TaskContext.get().partitionId() // 256
        for i in range(PIECES):
            x = total[i * step : (i + 1) * step]
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part], pa.int64()), pa.array([packed(x)], pa.binary())], ["piece", "part", "data"])

    def add(key, t):
        x = np.zeros(step, np.int64)
        for d in t["data"]:
            x += np.frombuffer(zlib.decompress(d.as_py()), "<u4")
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([0], pa.int64()), pa.array([packed(x)], pa.binary())], ["piece", "part", "data"])

    schema = "piece long, part long, data binary"
    sums = docs.select("text").mapInArrow(count, schema).groupBy("piece", "part").applyInArrow(add, schema).groupBy("piece").applyInArrow(add, schema)
    total = np.zeros(COUNTERS, np.uint32)
    for r in sums.toLocalIterator():
        total[r.piece * step : (r.piece + 1) * step] = np.frombuffer(zlib.decompress(r.data), "<u4")
    mean = total.mean(dtype=np.float64)
    least = mean + 8 * mean**0.5 + HOT_DF
    return np.where(total < least, 0, np.clip(1 + 8 * np.log2(np.maximum(total, 1) / least), 1, 255)).astype(np.uint8)


def signatures(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, n, ck, gk, prefix): set size, set digest, digest of size and prefix, and the prefix.

    The order of shingles is by level, then by hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def sign(batches):
        levels = shared.value
        for b in batches:
            sets = _sets(b, k)
            prefixes, keys = [], []
            for s in sets:
                s = s[:, 0]
                p = prefix_length(len(s), percent)
                level = levels[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                if level.any():
                    s = s[np.argsort(level, kind="stable")]
                prefixes.append(s[:p].view(np.int64))
                keys.append(int(c.mix(np.sum(c.mix(s[:p]), dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]))
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32))
            cols = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(cuts, flat)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "ck", "gk", "prefix"])
        forget()

    return docs.mapInArrow(sign, "doc_id long, n long, ck binary, gk long, prefix array<long>")


def _bucket_pairs(percent: int):
    """Reads (token, n, g) sorted; gives (a, b, na, nb, token): pairs of groups, or with b null a hot token and one of its groups."""

    def pairs(batches):
        tok, g, n = (np.zeros(0, np.int64) for _ in range(3))
        heat = None  # the hot token whose run is being read

        def fits(x, y):
            return percent * y <= 100 * x

        def run(t, gs, ns, out):
            nonlocal heat
            if heat != t and len(gs) <= BUCKET:
                i, j = np.triu_indices(len(gs), 1)
                ok = fits(ns[i], ns[j])
                out.append((gs[i[ok]], gs[j[ok]], ns[i[ok]], ns[j[ok]]))
                return
            heat = t
            hot.append((t, gs, ns))

        def emit(out, hot):
            a, b, na, nb = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4))
            swap = a > b
            a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
            ht = np.concatenate([np.full(len(x[1]), x[0]) for x in hot]) if hot else np.zeros(0, np.int64)
            hg, hn = (np.concatenate([x[i] for x in hot]) if hot else np.zeros(0, np.int64) for i in (1, 2))
            cols = [
                pa.array(np.concatenate([a, hg])), pa.concat_arrays([pa.array(b), pa.nulls(len(hg), pa.int64())]), pa.array(np.concatenate([na, hn])),
                pa.concat_arrays([pa.array(nb), pa.nulls(len(hg), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(ht)]),
            ]
            return pa.RecordBatch.from_arrays(cols, ["a", "b", "na", "nb", "token"])

        for b in batches:
            tok, g, n = (np.concatenate([x, b.column(k).to_numpy()]) for x, k in ((tok, "token"), (g, "g"), (n, "n")))
            if not len(tok):
                continue
            starts = np.concatenate([[0], np.nonzero(tok[1:] != tok[:-1])[0] + 1])
            sizes = np.diff(np.concatenate([starts, [len(tok)]]))
            out, hot = [], []
            whole = np.arange(len(starts) - 1)
            two = whole[(sizes[whole] == 2) & (tok[starts[whole]] != heat)] if heat is not None else whole[sizes[whole] == 2]
            i = starts[two]
            i = i[fits(n[i], n[i + 1])]
            out.append((g[i], g[i + 1], n[i], n[i + 1]))
            for r in whole[(sizes[whole] > 2) | ((tok[starts[whole]] == heat) if heat is not None else False)]:
                s = slice(starts[r], starts[r] + sizes[r])
                run(int(tok[starts[r]]), g[s], n[s], out)
            keep = starts[-1]
            if sizes[-1] > BUCKET or tok[-1] == heat:
                run(int(tok[-1]), g[keep:], n[keep:], out)
                keep = len(tok)
            yield emit(out, hot)
            tok, g, n = tok[keep:], g[keep:], n[keep:]
        if len(tok) > 1:
            out, hot = [], []
            run(int(tok[0]), g, n, out)
            yield emit(out, hot)

    return pairs


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents with these distinct ids."""
    ids = ids.select(F.col("id").alias("_id"))
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("_id")).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of documents whose sets link, by their words; pairs are distinct."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = c.stored(_texts_of(docs, ids), "jaccard-texts")

    def check(batches):
        for whole in batches:
            for b in c.slices([whole], "tb", size=4 << 20):
                x, y = (b.column(n).dictionary_encode() for n in ("ta", "tb"))
                sets = exact_sets([*x.dictionary.to_pylist(), *y.dictionary.to_pylist()], k)
                good = []
                for i, j in zip(x.indices.to_pylist(), y.indices.to_pylist()):
                    p, q = sets[i], sets[len(x.dictionary) + j]
                    both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                    good.append(len(p) > 0 and 100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return c.stored(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "jaccard-links")


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Two documents link when the Jaccard similarity of their sets of k-word shingles is at least percent / 100; the
    component is the least doc_id reachable by links. Null, empty and blank texts have empty sets and link with
    nothing. Equal sets are one class from the start, so rows that repeat cost nothing more. Rows that repeat a doc_id with
    other texts are one document, which links where any of its texts does; rows without a doc_id link with nothing and have
    no component. An empty table gives an empty result; other columns are ignored.

    First round: every two groups (equal size and prefix) that share a prefix token of few groups, and for tokens of
    many groups each with its pivots, by their first members; and members of a group with its first. Second round, for
    exactness: what pairs of members are left whose components still differ, tokens of many groups in blocks.
    """
    with c.arrow_batches(docs.sparkSession, rows=1000, size="4m"):
        return _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_or_empty().alias("text")), k, percent)


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    sig = c.stored(signatures(docs, k, percent, frequencies(docs, k)), "jaccard-signatures")
    full = sig.filter("n > 0 AND doc_id IS NOT NULL")
    classes = c.stored(full.groupBy("ck", "n", "gk").agg(F.min("doc_id").alias("id"), F.count("*").alias("count")), "jaccard-classes")
    groups = c.stored(full.groupBy("gk", "n", "prefix").agg(F.min("doc_id").alias("g")), "jaccard-groups")
    # Tokens of a thousandth of all groups go straight to the hot ones, so that no task gathers them.
    index = groups.select(F.explode("prefix").alias("token"), "n", "g")
    hottest = c.stored(c.hot_keys(index.groupBy("token").count(), "token", groups.count()), "jaccard-hottest")
    flagged = index.join(F.broadcast(hottest.withColumn("hottest", F.lit(True))), "token", "left")
    rest = flagged.filter("hottest IS NULL").select("token", "n", "g").repartition("token").sortWithinPartitions("token", "n", "g")
    found = c.stored(rest.mapInArrow(_bucket_pairs(percent), PAIR + ", token long"), "jaccard-candidates")
    heat = found.filter("b IS NULL").select("token", F.col("a").alias("g"), F.col("na").alias("n")).union(flagged.filter("hottest").select("token", "g", "n"))
    any_hot = not heat.isEmpty()
    pairs = found.filter("b IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    if any_hot:
        # Prefix tokens that the count of shared ones may have missed.
        h = heat.groupBy("g").agg(F.count("*").cast("int").alias("h"))
        heat = c.stored(heat.join(h, "g"), "jaccard-hot")
        pairs = pairs.join(h.select(F.col("g").alias("a"), F.col("h").alias("ha")), "a", "left").join(h.select(F.col("g").alias("b"), F.col("h").alias("hb")), "b", "left")
        pairs = pairs.withColumn("shared", F.col("shared") + F.coalesce(F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))), F.lit(0)))
    pairs = pairs.filter(_can_link(percent)).select("a", "b")
    if any_hot:
        pairs = pairs.union(_pivot_pairs(heat, percent)).distinct()
    pairs = c.stored(pairs, "jaccard-pairs")
    members = classes.join(groups.select("gk", "n", "g"), ["gk", "n"]).select("g", "id", "n")
    inside = members.filter("id <> g").select(F.col("g").alias("a"), F.col("id").alias("b"))
    links = verified(docs, pairs.union(inside).distinct(), k, percent)
    links = _second_round(docs, links, pairs, members, heat if any_hot else None, k, percent)
    # A doc_id of several texts joins their classes.
    several = full.groupBy("doc_id").agg(F.min("ck").alias("lo"), F.max("ck").alias("hi")).filter("lo <> hi").select("doc_id")
    links = links.union(full.select("doc_id", "ck").join(several, "doc_id", "left_semi").distinct().join(classes.select("ck", "id"), "ck").select("doc_id", "id"))
    comp = c.stored(c.components(links), "jaccard-components")
    c.drop(groups, hottest, found, pairs, *[heat] * any_hot)
    named = classes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("ck", F.coalesce("component", "id").alias("component_id"), "count")
    hot = c.hot_keys(named, "ck", sig.count())
    linked = c.spread_join(full.select("doc_id", "n", "ck"), named.drop("count"), "ck", hot)
    alone = sig.filter("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").union(alone).withColumnRenamed("n", "n_shingles")


def _can_link(percent: int):
    """Whether the shared prefix tokens leave a pair the overlap that it needs.

    Common tokens up to the earlier end of both prefixes are counted; after it come at most what that document has
    outside its prefix.
    """
    rest = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    return F.col("shared") + F.greatest(rest("na"), rest("nb")) >= F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))


def _second_round(docs: DataFrame, links: DataFrame, pairs: DataFrame, members: DataFrame, heat: DataFrame | None, k: int, percent: int) -> DataFrame:
    """links, and those of the pairs that the first round left out because they could not be told from its components."""
    crowded = members.groupBy("g").count().filter("count > 1").select("g")
    if heat is None and crowded.isEmpty():
        return links
    comp = c.components(links)
    members = c.stored(members.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).select("g", "id", "n", "comp"), "jaccard-members")
    more = []
    if not crowded.isEmpty():
        more.append(_crowded_pairs(members, pairs, crowded))
    if heat is not None:
        sizes = members.groupBy("g").count()
        spread = c.stored(c.spread_join(members.select("g", "id", "comp"), heat, "g", c.hot_keys(sizes, "g", members.count())), "jaccard-heat")
        more.append(_hot_pairs(spread, percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    new = more[0] if len(more) == 1 else more[0].union(more[1])
    new = c.stored(new.distinct(), "jaccard-more")
    return links if new.isEmpty() else links.union(verified(docs, new, k, percent))


def _crowded_pairs(members: DataFrame, pairs: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of different components, of pairs of groups of which one has several members, and of each
    such group with itself; members are (g, id, comp).

    Nearly all members of a group are of one component by now. So components are paired first, and members only where
    these differ; groups of many components or members are dealt out.
    """
    both = pairs.select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    wide = both.join(crowded.withColumnRenamed("g", "ga"), "ga", "left_semi").union(both.join(crowded.withColumnRenamed("g", "gb"), "gb", "left_semi").select("ga", "gb"))
    wide = wide.union(crowded.select(F.col("g").alias("ga"), F.col("g").alias("gb"))).distinct()
    comps = c.stored(members.groupBy("g", "comp").agg(F.count("*").alias("n")), "jaccard-comps")
    ends = comps.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    for x in "ab":
        wide = wide.join(ends.select(F.col("g").alias(f"g{x}"), F.col("lo").alias(f"lo{x}"), F.col("hi").alias(f"hi{x}")), f"g{x}")
    wide = wide.filter("NOT (loa = hia AND lob = hib AND loa = lob)").select("ga", "gb")

    def expanded(rows: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """rows joined with right on (group) or (group, component), rows of hot keys dealt out."""
        key = F.xxhash64(*on).alias("_key") if len(on) > 1 else F.col(on[0]).alias("_key")
        left = c.stored(rows.withColumn("_key", key), "jaccard-crowded")
        hot = c.hot_keys(left.groupBy("_key").count(), "_key", left.count())
        pair = right.withColumn("_key", key).toDF(*[f"_r_{n}" if n in on else n for n in right.columns], "_key")
        x = c.spread_join(left, pair, "_key", hot)
        for n in on:
            x = x.filter(F.col(n) == F.col(f"_r_{n}"))
        return x.drop("_key", *[f"_r_{n}" for n in on])

    own = lambda x: (F.col("g").alias(f"g{x}"), F.col("comp").alias(f"c{x}"))
    apart = expanded(expanded(wide, comps.select(*own("a")), ["ga"]), comps.select(*own("b")), ["gb"])
    apart = apart.filter("ca <> cb AND (ga <> gb OR ca < cb)")
    x = expanded(expanded(apart, members.select(*own("a"), F.col("id").alias("a")), ["ga", "ca"]), members.select(*own("b"), F.col("id").alias("b")), ["gb", "cb"])
    x = x.filter("NOT (a = ga AND b = gb) AND (ga <> gb OR (a <> ga AND b <> ga))")
    return x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _pivot_pairs(heat: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each group of a hot token (token, g, n, h) with the token's pivots of a size that can link.

    Pivots are the groups whose prefixes hold the most hot tokens, so the least of their own: one of each of PIVOTS
    random parts of the groups of a band of sizes. Found by an aggregation, which no frequent token burdens.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    part = F.pmod(F.xxhash64("g"), F.lit(PIVOTS))
    top = heat.groupBy("token", band.alias("band"), part.alias("part")).agg(F.max(F.struct("h", (-F.col("g")).alias("g"), "n")).alias("t"))
    top = top.select("token", (-F.col("t.g")).alias("p"), F.col("t.n").alias("pn"), F.col("t.h").alias("ph"))
    counts = heat.groupBy("token").agg(F.count("*").alias("count"))
    x = c.spread_join(heat, top, "token", c.hot_keys(counts, "token", heat.count()))
    x = x.filter(F.col("g") != F.col("p")).select(
        F.least("g", "p").alias("a"), F.greatest("g", "p").alias("b"), F.col("n").alias("na"), F.col("pn").alias("nb"), F.least("h", "ph").alias("shared")
    )
    return x.filter(_can_link(percent) & (percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb"))).select("a", "b").distinct()


def _hot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components that share a hot token, from (token, g, n, id, comp, h).

    Tokens whose members are all of one component are done. A pair that shares no other prefix token needs as many hot
    ones as _can_link() says, and has at most the smaller h of the two, the hot tokens of their prefixes: a member that
    reaches this with no size there is in its bucket goes before any pairing. The others are dealt to blocks, those of
    the token's largest component by themselves, and every two blocks but for two of these are compared in a task of
    their own: m members of which all but a few are of one component make about m rows, not m squared.
    """
    counts = rows.groupBy("token", "comp").agg(F.count("*").alias("count"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    stats = counts.groupBy("token").agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("count").alias("count"), F.min("n0").alias("n0"), F.max("n1").alias("n1"))
    stats = c.stored(stats.filter("comps > 1").select("token", F.col("top.comp").alias("top"), "count", "n0", "n1"), "jaccard-tokens")
    hot = c.hot_keys(stats, "token", rows.count())
    rows = c.spread_join(rows, stats.drop("count"), "token", hot)
    # the tokens needed fall with the partner's distance in size, so the ends of the sizes that can link decide
    rest = lambda n: F.ceil(n * percent / 100) - 1
    need = lambda m: F.ceil(percent * (F.col("n") + m) / (100 + percent)) - F.greatest(rest(F.col("n")), rest(m))
    low, high = F.greatest("n0", F.ceil(F.col("n") * percent / 100)), F.least("n1", F.floor(F.col("n") * 100 / percent))
    rows = rows.filter(F.col("h") >= F.least(need(low), need(high)) - 1)
    rows = c.stored(rows.withColumn("apart", F.col("comp") != F.col("top")).select("token", "id", "n", "comp", "h", "apart"), "jaccard-apart")
    blocks = lambda flag: F.ceil(F.count(F.when(F.col("apart") == flag, 1)) / BLOCK).cast("int")
    sizes = rows.groupBy("token").agg(blocks(False).alias("nb0"), blocks(True).alias("nb1")).filter("nb1 > 0")
    rows = c.spread_join(rows, sizes, "token", hot)
    rows = rows.withColumn("block", F.when(F.col("apart"), F.col("nb0") + F.pmod(F.xxhash64("id"), "nb1")).otherwise(F.pmod(F.xxhash64("id"), "nb0")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("apart"), 0).otherwise(F.col("nb0")), F.col("nb0") + F.col("nb1") - 1)))
    rows = rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "comp", "h")

    def compare(key, t):
        i, j = key[1].as_py(), key[2].as_py()
        block, ids, n, comp, h = (t[x].to_numpy() for x in ("block", "id", "n", "comp", "h"))
        a, b = (np.nonzero(block == x)[0] for x in (i, j))
        na, nb, left = n[a][:, None], n[b][None], -(-percent * n // 100) - 1
        ok = (comp[a][:, None] != comp[b][None]) & (percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb))
        ok &= np.minimum(h[a][:, None], h[b][None]) + np.maximum(left[a][:, None], left[b][None]) >= least_overlap(na, nb, percent)
        if i == j:
            ok = np.triu(ok, 1)
        x, y = np.nonzero(ok)
        x, y = a[x], b[y]
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pa.Table.from_arrays([pa.array(v) for v in (ids[x], ids[y], n[x], n[y])], ["a", "b", "na", "nb"])

    # Dealt by blocks: else the blocks of a token would all stay in the task of the join before.
    found = rows.repartition("token", "i", "j").groupBy("token", "i", "j").applyInArrow(compare, PAIR).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return found.filter(_can_link(percent)).select("a", "b")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, of which one document of each component stays: that of the least doc_id.

    Documents without words are no near copies of each other and all stay, and so do rows without a doc_id; rows that
    repeat a doc_id that stays all stay. An empty table gives an empty result; columns may have any names.
    """
    (near,) = c.fresh(docs, "_near_id")
    ids = jaccard_components(docs, k, percent).filter("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias(near)).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(near)), "left_semi")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLE = {
    "op5_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.node = d.doc_id GROUP BY ALL
"""
}
