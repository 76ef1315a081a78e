"""The filter audit, the quality rules and the alignment of tokenizers against brute force."""

import functools
import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from speckle.llm import _tokens, alignment, filter_audit, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("part", "mask", "sha", "maybe", "least", "count", "good", "toxic", "row", "pair", "n", "group", "own", "x0", "m0", "bin", "pairs", "times", "level")
A, B = _tokens.vocabulary("byte_bpe_50k.json"), _tokens.vocabulary("piece_bpe_32k.model")


def prose(n, r):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))


def some_texts():
    r = random.Random(3)
    long = prose(70, r)
    return [
        None, "", " \n\t", "one", "A B C " * 30, "word " * 80, prose(60, r), prose(60, r) + " $", long, long, long + " ", "X" * 400, "a\x0bb\x0cc\n" * 40, prose(20_000, r),
        "naïve café 日本語 😀 ÀÉ " * 15, "tab\tA\tB", long, "é" * 300 + " " + prose(55, r), "A# b& c* " * 20,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 4 == 0 else f"s{i % 2}") for i, t in enumerate(some_texts())]
    df = spark.createDataFrame([*rows, rows[8], rows[5], (None, rows[8][1], "en", "s1"), (8, "other text", "en", "s0")], SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit(c))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_audit(rows, labels):
    text = lambda r: r.text or ""
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[text(r)] = min(least.get(text(r), r.doc_id), r.doc_id)
    masks = defaultdict(list)
    for r in rows:
        t = text(r)
        w = t.encode().split()
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": r.doc_id is not None and r.doc_id > least[t],
        }
        masks[r.source or ""].append(({k for k, v in fails.items() if v}, labels.get(r.doc_id, (0, 0))))
    out = {}
    for part, docs in masks.items():
        total = Counter()
        for o in itertools.permutations("ABCDE"):
            left = docs
            for k, x in enumerate(o):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                failing = [d for d in docs if x in d[0]]
                out[part, "".join(o), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(d[0] == {x} for d in failing), sum(d[1][0] for d in gone), sum(d[1][1] for d in gone)]
                total[x] += len(gone)
        for o in itertools.permutations("ABCDE"):
            for k, x in enumerate(o):
                out[part, "".join(o), k + 1].append(total[x])
    return out


@pytest.mark.parametrize("most", [filter_audit.MOST, 1 << 6])
def test_filter_audit(spark, docs, empty, most):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(3, None, None), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    known = {i: (int(i % 2 or i == 4), int(i % 3 == 0)) for i in range(12)}
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.filter_audit(docs, labels, most).collect()}
    assert got == brute_audit(docs.collect(), known) and len(got) == 3 * 600
    assert filter_audit.filter_audit(empty, labels).count() == 0


def test_sketch_clears_only_what_is_unique(spark):
    rows = spark.range(3000).select(F.unhex(F.sha2((F.col("id") % 2500).cast("string"), 256)).alias("sha"), (F.col("id") % 2500).alias("k")).repartition(5)
    got = rows.withColumn("maybe", filter_audit.possible_repeat(rows, 3000)("sha")).collect()
    assert all(r.maybe for r in got if r.k < 500)
    assert sum(r.maybe for r in got if r.k >= 500) < 60


def brute_statistics(text):
    raw = text.encode()
    w = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)]


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_statistics(monkeypatch, piece):
    from speckle.llm import _shingles

    monkeypatch.setattr(_shingles, "PIECE", piece)
    r = random.Random(piece)
    texts = [t or "" for t in some_texts()[:13]] + [" ".join(r.choice("abc") for _ in range(n)) for n in range(0, 60, 3)] + ["a b\n\na b\n \n x\na b", "日本 語\x0b<|>"]
    raw, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    assert quality_rules.statistics(raw, ends).tolist() == [brute_statistics(t) for t in texts]


def brute_distances(x):
    """Concentration steps as the operator has them, on whole arrays; x in parts of SCALE."""
    p, noise = x.shape[1], np.diag(np.square(quality_rules.NOISE))
    x = x / quality_rules.SCALE

    def quantile(v, share):
        v = np.sort(v)
        return v[math.ceil(share * len(v)) - 1]

    mean = np.array([quantile(x[:, i], 0.5) for i in range(p)])
    spread = np.array([(quantile(x[:, i], 0.75) - quantile(x[:, i], 0.25)) / 1.349 for i in range(p)])
    cov, before = np.diag(spread**2) + noise, math.inf
    far = lambda: np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
    for _ in range(quality_rules.STEPS):
        bins = np.floor(quality_rules.BINS * np.log(far() + 1e-6))
        order = np.sort(bins)
        held = x[np.array([np.searchsorted(order, b) for b in bins]) < quality_rules.SHARE * len(x)]
        mean, cov = held.mean(0), quality_rules.consistency(quality_rules.SHARE) * np.cov(held.T, bias=True) + noise
        size = np.linalg.slogdet(cov)[1]
        if size > before - 1e-3:
            break
        before = size
    held = x[far() <= quality_rules.chi2_quantile(quality_rules.REFINE, p)]
    mean, cov = held.mean(0), quality_rules.consistency(quality_rules.REFINE) * np.cov(held.T, bias=True) + noise
    return far()


def test_chi_squared():
    # tables of the distribution
    assert quality_rules.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-4)
    assert quality_rules.chi2_quantile(0.75, 5) == pytest.approx(6.6257, abs=1e-4)
    assert quality_rules.chi2(7.0, 7) == pytest.approx(0.5711, abs=1e-4)


def test_quality_rules(spark, docs, empty):
    r = random.Random(8)
    rows = [(i, prose(r.randint(15, 300), r), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "$$$%" for w in prose(80, r).split()), "en", "s0") for i in range(15)] + [(2000 + i, prose(100, r), "fr", None) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in quality_rules.quality_rules(df).collect()}
    assert not any(got[1000 + i].kept for i in range(15)) and all(got[i].kept for i in range(300))
    assert all(got[2000 + i].kept and got[2000 + i].distance is None for i in range(9))
    again = {x.doc_id: x for x in quality_rules.quality_rules(df.repartition(7)).collect()}
    assert got == again
    for source in ("s0", "s1"):
        own = [i for i, _, lang, s in rows if (lang, s) == ("en", source)]
        x = df.filter((F.col("source") == source) & (F.col("lang") == "en"))
        v = {y.doc_id: list(y)[1:] for y in quality_rules.base_rules(x).select("doc_id", *quality_rules.vector()).collect()}
        assert np.allclose([got[i].distance for i in own], brute_distances(np.array([v[i] for i in own], float)), rtol=1e-6)
    out = quality_rules.quality_rules(docs)
    assert out.count() == docs.count() and quality_rules.quality_rules(empty).count() == 0
    texts = {(x.doc_id, x.text or "") for x in docs.collect()}
    for x in out.collect():
        assert any(i == x.doc_id and [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words] == brute_statistics(t) for i, t in texts)
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and not (x.base_failed and x.kept)


def test_clean_labelled_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert all(r.kept for r in got if r.quality == 1) and np.mean([r.kept for r in got if r.quality == 0]) < 0.1


@functools.cache
def _library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t


def library(text):
    """Tokens of the whole text by the libraries, and their bytes, without any span."""
    entry = alignment._byte_level(A)[1]
    a = _library().encode(" " + text, add_special_tokens=False).ids
    sp = _tokens._pieces(B)
    b = sp.encode(text)
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return (a, [entry[i] for i in a]), (b, [piece(i) for i in b])


def brute_alignment(text):
    if not text:
        return [], Counter()
    (a, x), (b, y) = library(text)
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return [], Counter()
    ends_a, ends_b = np.cumsum([len(v) for v in x]).tolist(), np.cumsum([len(v) for v in y]).tolist()
    groups, links, lo = [], Counter(), 0
    for end in sorted(set(ends_a) & set(ends_b)):
        g = [[t for t, e in zip(ids, ends) if lo < e <= end] for ids, ends in ((a, ends_a), (b, ends_b))]
        groups.append(g)
        links.update(itertools.product(*g))
        lo = end
    return groups, links


def odd_texts():
    r = random.Random(1)
    parts = ["a", "b", "the", "éü", "ß", " ", "  ", "\n", "\t", " \n ", "世", "界", "🙂", "𐍈", "!", "...", "'s", " 're", "12", "٣", " ", "　", "​", "é", "<s>", "<|endoftext|>", "\x00", "\r\n", "क्षि", "</s>", "<0x41>", "_", "\x1c", "\x85", "한국", "▁"]
    return ["".join(r.choice(parts[: 36 if k % 5 == 0 else 35]) + r.choice(["", "", " "]) for _ in range(r.randint(0, 30))) for k in range(150)]


@pytest.mark.parametrize("how", [{}, {"head": 40}])
def test_alignment(spark, docs, empty, how):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 5000] + [(100 + i, t) for i, t in enumerate(odd_texts())]
    got = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pairs", F.lit(1)).repartition(4), A, B, **how).collect()
    brute = {t: brute_alignment(t or "") for _, t in rows}
    counts, best = Counter(k for _, t in rows for k in brute[t][1]), Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    want = Counter()
    for i, t in rows:
        groups, links = brute[t]
        said = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        want[(
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), sum(m for k, m in links.items() if counts[k] == best[k[0]]),
            sum(m * counts[k] for k, m in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        )] += 1
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_a > 0 for r in got) > 100 and any(r.n_a == 0 and r.doc_id is not None and r.doc_id > 99 for r in got)
    assert alignment.aligned(empty, A, B).count() == 0


def test_units_and_pieces_are_the_whole_text(monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 9)
    for t in odd_texts():
        whole, alg = brute_alignment(t), alignment.Aligned(A, B)
        assert "".join(" " + u for u in alignment.units(t)) == " " + t
        assert "".join(" " + u for p in alignment.pieces(t) for u in alignment.units(p)) == " " + t
        at = alg.numbers(t, []) if t else []
        assert b";".join(alg.said[i] for i in at).decode() == ";".join("|".join(",".join(map(str, x)) for x in g) for g in whole[0])


def test_long_groups_are_counted_by_ids(monkeypatch):
    text = "a" * 50
    monkeypatch.setattr(alignment, "LONG", 1)
    alg = alignment.Aligned(A, B)
    import pyarrow as pa

    r = alg.rows(pa.array([1]), [text]).to_pylist()[0]
    _, links = brute_alignment(text)
    assert dict(zip(r["pairs"], r["times"])) == {a << 32 | b: n for (a, b), n in links.items()} and r["n_links"] == sum(links.values())


def test_registered_search_finds_the_nearest(spark):
    """Recall of the registered query, with its own parameters, over a whole table."""
    from speckle.llm import ann

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in sorted(ann.QUERIES["op2_ann"](spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = 0
    for q, found in got.items():
        scores = v @ v[ids == q][0]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:20]
        hits += len({int(ids[i]) for i in order} & {i for i, _ in found})
        assert len(found) == 20 and all(s == pytest.approx(scores[ids == i][0]) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hits / (20 * len(got)) >= 0.9
