"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from speckle.llm import _common, _tokens, ann, exact_dedup, jaccard, mixing, packing, pii, quality, substring_dedup, token_counts, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("norm", "h", "count", "key", "size", "range", "token", "n", "spans", "th", "ck", "part", "kept", "content", "hash", "id")
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(160)
TEXTS = [
    None, "", " \t\n", "a", "A b", "one two three", "One  Two\tthree", BASE, BASE, " " + BASE, BASE.upper(), BASE.replace(WORDS[0], "zz"), prose(90), prose(3000), "x" * 500, "ab" * 250,
    "naïve café ñandú <|endoftext|> 日本語 😀", prose(5) + "\x1c " + prose(5), BASE + " more",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + [rows[7], (None, "no id", "en", "s1", 5)], SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit(c))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def all_rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def reference_ids(name, texts):
    path = _tokens.vocabulary(name)
    if name.endswith(".model"):
        return _tokens._pieces(path).encode(texts)
    return [e.ids for e in _tokens._json(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_encoding_is_the_library_s(name):
    texts = [t or "" for t in TEXTS] + ["It's we'll <|startoftext|>x a.b,c!? ÀÉÎ ǅ İstanbul ﬁ \r\n\x0b end  ", "été ẛ̣", "a" * 300, "!!!... $$$ %%%###"]
    got = _tokens.encode(_tokens.vocabulary(name), texts)
    assert [x.tolist() for x in got] == reference_ids(name, texts)


def test_exact_groups(docs):
    rows = all_rows(docs)
    strip = lambda t: t.translate({k: None for k in (0x20, *range(9, 14))})
    classes = {}
    for d, t in rows:
        classes.setdefault(strip(t), []).append((-len(t), -(1 << 63) if d is None else d))
    for hashed in (F.md5, lambda c: F.lit("00" * 16), lambda c: F.concat(F.substring(F.md5(c), 1, 1), F.lit("0"))):
        got = exact_dedup.exact_groups(docs, hashed).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                continue
            t = strip(dict(rows)[r.doc_id])
            assert (r.keep_id, r.group_size, r.kept) == (min(classes[t])[1], len(classes[t]), r.doc_id == min(classes[t])[1])
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_keeps_columns_and_one_row(docs, empty):
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    n = Counter(r.doc_id for r in got.collect())
    assert max(n.values()) == 1 and 9 in n and 7 not in n and 8 not in n
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.exact_dedup(empty).count() == 0


def test_mix_meets_targets(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
    by_source = {}
    src = {(r.doc_id, r.size): r for r in got}
    for r in docs.select("doc_id", "source", mixing.words().alias("size")).collect():
        s = by_source.setdefault(r.source, [0, 0.0, 0])
        x = src[(r.doc_id, r.size)]
        s[0], s[1], s[2] = s[0] + x.taken, x.target, s[2] + r.size
    for taken, target, size in by_source.values():
        assert abs(taken - target) < 1 or size == 0
    assert sum(x[1] for x in by_source.values()) == pytest.approx(1.5 * sum(x[2] for x in by_source.values()))
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 500), (True, "", 40)], "is_null boolean, s string, source_size long")
    got = {(r.s, r.is_null): r.target for r in mixing.source_targets(sizes).collect()}
    weight, cap, total = [3, 1, 2, 3], [20, 2000, 1000, 80], 1.5 * 1550
    t, open_ = [0.0] * 4, {0, 1, 2, 3}
    while True:
        left = total - sum(cap[i] for i in range(4) if i not in open_)
        t = [left * weight[i] / sum(weight[k] for k in open_) if i in open_ else cap[i] for i in range(4)]
        over = {i for i in open_ if t[i] > cap[i]}
        if not over:
            break
        open_ -= over
    assert [got[k] for k in (("a", False), ("b", False), ("c", False), ("", True))] == pytest.approx(t)


def test_mixed_documents_take_what_the_mix_says(docs, empty):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] += r.taken
    have = Counter()
    for r in got.select("doc_id", mixing.words().alias("w")).collect():
        have[r.doc_id] += r.w
    assert have == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mixed_documents(empty).count() == 0


def test_pack(docs, empty):
    path = _tokens.vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs, path, length=64, with_ids=True).collect()
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in got:
        assert r.sequence_id * 64 + r.offset == at and r.offset + r.length <= 64 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.length
    want = Counter((d, tuple(i + [0])) for (d, t), i in zip(all_rows(docs), reference_ids("byte_bpe_50k.json", [t for _, t in all_rows(docs)])))
    have, parts = Counter(), {}
    for r in got:
        ids = parts.setdefault(r.doc_id, [])
        assert r.start == len(ids)
        ids.extend(np.frombuffer(r.ids, "<u4").tolist())
        if len(ids) == r.doc_tokens:
            have[(r.doc_id, tuple(parts.pop(r.doc_id)))] += 1
    assert have == want and not parts
    assert packing.pack(empty, path).count() == 0


def test_token_counts_and_their_cache(spark, docs, empty, tmp_path):
    path, cache = _tokens.vocabulary("piece_bpe_32k.model"), str(tmp_path / "cache")
    rows = all_rows(docs)
    want = Counter((d, len(t.encode()), len(i), len(i) > 100) for (d, t), i in zip(rows, reference_ids("piece_bpe_32k.model", [t for _, t in rows])))
    for _ in range(2):
        got = token_counts.token_counts(docs, path, cache, limit=100)
        assert Counter(tuple(r) for r in got.collect()) == want
        assert spark.read.parquet(cache).count() == len({t for _, t in rows})
    more = spark.createDataFrame([(99, "a new text"), (7, BASE)], "doc_id long, text string")
    token_counts.token_counts(more, path, cache).collect()
    assert spark.read.parquet(cache).count() == len({t for _, t in rows}) + 1
    assert token_counts.token_counts(empty, path, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_token_segments(n):
    r = np.random.default_rng(n)
    ids = r.integers(0, 50, n).astype(np.uint32)
    ids[r.random(n) < 0.05] = 2**32 - 1
    ids[: n // 3] = 7
    counts = np.array([n - n // 4, 0, n // 4])
    data = token_files.write_segment(3, 11, np.array([1, 2, -5]), counts, ids) + b"\n"
    (shard, before, docs, c, back), two = token_files.read_segments(data + data)
    assert (two[4] == ids).all()
    assert (shard, before, docs.tolist(), c.tolist()) == (3, 11, [1, 2, -5], counts.tolist()) and (back == ids).all()
    with pytest.raises(ValueError):
        list(token_files.read_segments(data[:-6] + bytes([data[-6] ^ 1]) + data[-5:]))
    with pytest.raises(ValueError):
        list(token_files.read_segments(data[:-3]))


def test_token_files(spark, docs, empty, tmp_path):
    path = _tokens.vocabulary("word_bpe_49k.json")
    token_files.write_tokens(docs, path, str(tmp_path / "t"))
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect(), key=lambda r: r.start)
    rows = sorted(all_rows(docs), key=lambda r: (r[0] is not None, r[0], r[1]))
    ids = reference_ids("word_bpe_49k.json", [t for _, t in rows])
    at = 0
    for r, (d, _), i in zip(got, rows, ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(i) + 1, crc(i + [1])) and np.frombuffer(r.ids, "<u4").tolist() == i + [1]
        at += r.n_tokens
    token_files.write_tokens(empty, path, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = bytes(t, "utf-8").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(seed):
    r = random.Random(seed)
    texts = [t or "" for t in TEXTS]
    for _ in range(3):
        base = [r.choice(WORDS) for _ in range(r.choice([12, 60, 150]))]
        for _ in range(70):
            rate, x = r.random() * 0.12, list(base)
            x = [r.choice(WORDS) if r.random() < rate else w for w in x]
            texts.append(" ".join(x[: len(x) - r.randint(0, 3)]))
    line = " ".join(WORDS[:12])
    texts += [line + " " + " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30))) for _ in range(50)]
    return texts


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, percent):
    texts = near_copies(k)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes, roots = brute_components(texts, k, percent)
    got = by_id(jaccard.jaccard_components(df, k, percent))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == list(zip(sizes, roots))
    kept = sorted(r.doc_id for r in jaccard.near_dedup(df, k, percent).collect())
    assert kept == sorted(set(roots))


def test_jaccard_edges(docs, empty):
    got = jaccard.jaccard_components(docs)
    assert got.count() == docs.count() and jaccard.near_dedup(docs).columns == docs.columns
    assert {r.component_id for r in got.collect() if r.doc_id in (7, 8, 9, 10)} == {7}
    assert jaccard.jaccard_components(empty).count() == jaccard.near_dedup(empty).count() == 0


def test_words_match_the_pattern():
    from speckle.llm._shingles import words

    texts = [t.encode() for t in ("", "a", " a\x0bb\x0c ", "A b c", "\n\n")]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    h, n = words(raw, ends)
    assert n.tolist() == [len(t.split()) for t in texts]
    want = [w.lower() for t in texts for w in t.split()]
    assert [(h[i] == h[j]).all() for i in range(len(want)) for j in range(i)] == [want[i] == want[j] for i in range(len(want)) for j in range(i)]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 7])
def test_exact_sets_are_those_of_the_shingles(k):
    from speckle.llm import _shingles

    r = random.Random(k)
    texts = [" ".join(r.choice(["a", "B", "b", "cc", "d"]) for _ in range(n)).encode() for n in (0, 1, 2, 3, 4, 5, 8, 40, 200)] + [b"", b" \n", b"a\x0bB\x0c"]
    want = []
    for t in texts:
        w = t.lower().split()
        want.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    for got in (_shingles.exact_sets(texts, k), [[tuple(x) for x in s.tolist()] for s in _shingles.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]), k)]):
        assert [len(x) for x in got] == [len(x) for x in want]
        assert all(len(set(list(x)) & set(list(y))) == len(p & q) for x, p in zip(got, want) for y, q in zip(got, want))


def test_words_that_polynomials_confuse_stay_apart(spark):
    # a Thue-Morse word and its complement: equal under any polynomial hash modulo a power of two
    one, two = ("".join(x[bin(i).count("1") & 1] for i in range(1024)) for x in ("ab", "ba"))
    df = spark.createDataFrame([(1, one + " one two three four"), (2, two + " one two three four"), (3, one), (4, two)], "doc_id long, text string")
    assert [(r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).orderBy("doc_id").collect()] == [(2, 1), (2, 2), (1, 3), (1, 4)]


def test_a_doc_id_of_several_texts_is_one_document(spark):
    x, y = BASE, prose(80)
    df = spark.createDataFrame([(5, x), (5, y), (3, y), (9, x + " end"), (None, x), (7, prose(50))], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (None, None), (7, 7)}


def brute_spans(texts, window):
    texts = [t.encode() for t in texts]
    seen = Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                cover[k] += 1
                cover[k + window] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def spliced(seed):
    r = random.Random(seed)
    base = [prose(r.randint(1, 150), r) for _ in range(30)]
    texts = [t or "" for t in TEXTS if t is None or len(t) < 5000] + ["a" * 1000, "x" * 199, "x" * 200, "\0" * 300 + "y", "a\0" * 150] + base
    for _ in range(50):
        a, k = r.choice(base), r.randint(0, 300)
        texts.append(a[k : k + r.randint(1, 600)] + " " + prose(r.randint(1, 30), r) + r.choice(base)[: r.randint(0, 400)])
    return texts


def test_items_of_equal_hashes_are_told_apart(monkeypatch):
    raw = np.frombuffer(b"abcdabcdabceabcd", np.uint8)
    text = substring_dedup.Text(raw, np.array([0, 16]))
    first = np.array([0, 4, 8, 12])
    want = [0, 0, 1, 0]
    for same in (text.hash, lambda a, b: np.zeros(len(a), np.uint64)):
        monkeypatch.setattr(text, "hash", same)
        monkeypatch.setattr(text, "second", same)
        head, n, number = substring_dedup._same_bytes(text, first, first + 4, first + 1)
        assert [number[i] == number[0] for i in range(4)] == [x == 0 for x in want]
        assert sorted(n.tolist()) == [1, 3] and sorted(number[head].tolist()) == [0, 1] and sorted(head.tolist()) == [0, 2]


@pytest.mark.parametrize("how", [{"chunk_bytes": 1000}, {"chunk_bytes": 20000}, {"chunk_bytes": 4000, "slab": 333}, {"chunk_bytes": 1000, "part_rows": 1}, {"chunk_bytes": 3000, "part_rows": 3, "period": 16}], ids=str)
def test_substrings(spark, how):
    texts = spliced(str(how))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(substring_dedup.without_repeats(df, **how))
    assert [tuple(got[i])[1:] for i in range(len(texts))] == brute_spans(texts, 200)


def test_a_passage_of_every_text_is_dealt_to_parts(spark):
    r = random.Random(9)
    passage = prose(60, r)
    texts = [prose(r.randint(0, 40), r) + " " + passage + " " + prose(r.randint(0, 40), r) for _ in range(300)] + [passage] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = by_id(substring_dedup.without_repeats(df, chunk_bytes=2000, part_rows=16))
    assert [tuple(got[i])[1:] for i in range(len(texts))] == brute_spans(texts, 200)


def test_corpus_order_of_windows():
    """Items against a comparison of all windows."""
    r = np.random.default_rng(4)
    rows = np.zeros((60, 36), np.uint8)
    back, ahead = r.integers(0, 17, 60), r.integers(12, 21, 60)
    for i in range(60):
        rows[i, 16 - back[i] : 16 + ahead[i]] = r.integers(0, 2, back[i] + ahead[i])
    rows[40:50], back[40:50], ahead[40:50] = rows[30:40], back[30:40], ahead[30:40]
    head, number, out = substring_dedup.repeated_windows(rows, back, ahead, 20)
    where = {}
    for i in range(60):
        for d in range(max(0, 20 - ahead[i]), back[i] + 1):
            where.setdefault((d, rows[i, 16 - d : 36 - d].tobytes()), []).append(i)
    want = np.zeros((60, 17), bool)
    for (d, _), found in where.items():
        want[found, d] = len(found) > 1
    assert (out[number] == want).all()


def test_long_texts_repeat_across_slabs(spark):
    r = random.Random(3)
    line = prose(100, r)
    long = "".join(r.choice("abcdefghij ") for _ in range(1_300_000))
    texts = [long[:1_048_000] + line + long[1_048_000:], "head " + line, long[700:1100], "q" * 1_200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(substring_dedup.without_repeats(df))
    assert got[3].n_removed == 1_200_000 and got[2].n_removed == 400 and got[1].n_removed == len(line) and got[1].n_spans == 1
    assert (got[0].n_bytes, got[0].n_removed, got[0].n_spans) == (len(texts[0]), 400 + len(line), 2)


def test_substring_edges(docs, empty):
    got = substring_dedup.without_repeats(docs, with_text=True).collect()
    assert len(got) == docs.count() and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id in (7, 8))
    assert substring_dedup.without_repeats(empty).count() == 0


def test_nearest_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 16))
    x[300:500] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [0.0] * 15), (904, [None] * 16), (None, x[0].tolist())]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert v.count() == 900
    got = ann.search(v.filter("id % 20 = 0"), v, k=10, cells=8, probes=6, shortlist=120).collect()
    mine = {}
    for q in got:
        mine.setdefault(q.query_id, []).append((q.rank, q.vec_id))
        assert q.score == (x[q.query_id] * x[q.vec_id]).sum() and q.vec_id != q.query_id
    hit = 0
    for q in range(0, 900, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hit += len({k for _, k in mine[q]} & set(np.lexsort([np.arange(900), -s])[:10].tolist()))
        assert [k for k, _ in sorted(mine[q])] == list(range(1, 11))
    assert hit / 450 >= 0.9
    tie = [k for _, k in sorted(mine[300])][:10]
    assert tie == list(range(301, 311))
    few = v.filter("id < 5")
    assert ann.search(few.filter("id = 0"), few).count() == 4
    assert ann.search(few.filter("id < 0"), few).count() == ann.search(few, few.filter("id < 0")).count() == 0


def pseudonyms(spark, texts):
    return [(r.text, r.n_found, r.kinds) for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_are_valid_and_linked(spark):
    values = {"card": "4111-1111-1111-1111", "iban": "GB82 WEST 1234 5698 7654 32", "ssn": "123-45-6789", "date": "2020-02-29", "phone": "+1 (017) 555-7713", "ipv4": "97.51.17.173", "email": "bob.smith7@example.com"}
    one = pseudonyms(spark, [f"See {v}, or {v}." for v in values.values()])
    for (text, n, kinds), (kind, v) in zip(one, values.items()):
        assert n == 2 and kinds == [kind] and v not in text
        a, b = text[4 : 4 + len(text.split(", or ")[0]) - 4], text.split(", or ")[1][:-1]
        assert a == b
        if kind != "ipv4":
            assert len(a) == len(v) and [c for c in a if not c.isalnum()] == [c for c in v if not c.isalnum()]
        if kind == "card":
            assert luhn(a)
        if kind == "iban":
            s = a.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    again = pseudonyms(spark, [t for t, _, _ in one])
    assert all(n == 2 for _, n, _ in again)


def test_pseudonyms_are_permutations(spark):
    day = spark.range(pii.DAYS).select(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")).cast("string").alias("m"))
    assert day.select(pii.date(F.col("m"), "k").alias("d")).distinct().count() == pii.DAYS
    some = spark.range(20000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("s"))
    assert some.select(pii.digits_permuted(F.col("s"), F.lit("t"), "k").alias("d")).distinct().count() == 20000
    ssn = spark.range(1, 9999, 7).select(F.concat(F.lit("667-01-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("s"))
    got = ssn.select(pii.ssn(F.col("s"), "k").alias("d"))
    assert got.distinct().count() == ssn.count() and got.filter(~pii.is_ssn(F.col("d"))).count() == 0


def test_values_side_by_side(spark):
    values = ["+1 (826) 555-4081", "190.137.223.204", "4111111111111111", "+49 30 1234567", "10.0.0.1", "2020-02-29", "bob@example.com"]
    (text, n, _), = pseudonyms(spark, [" ".join(values)])
    assert n == len(values) and not any(v in text for v in values)


def test_other_numbers_stay(spark):
    clean = [None, "", "no data", "4111111111111112", "000-12-3456", "DE89370400440532013001", "2021-02-29", "300.1.1.1", "v1.2.3 3.14 1.2.3.4.5", "Apache License, Version 2.0, January 2004", "a@b", "12345"]
    assert [(t, n) for t, n, _ in pseudonyms(spark, clean)] == [(t, 0) for t in clean]


def test_gradients_of_the_network():
    m = quality.ByteConv(3)
    texts = [b"plain words in a row " * 40, b"$$$ junk%%% " * 9, b"", b"z" * 700]
    ends = np.cumsum([0] + [len(t) for t in texts])
    raw, y = np.frombuffer(b"".join(texts), np.uint8), np.array([1, 0, 1, 0], "f4")
    g = m.gradients(raw, ends, y)

    def loss():
        p = m.scores(raw, ends)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, at in (("filters", (5, 3)), ("out", (2,)), ("out", (20,)), ("bias", (1,)), ("embed", (ord("r"), 1))):
        keep = m.p[k][at]
        m.p[k][at] = keep + 0.005
        up = loss()
        m.p[k][at] = keep - 0.005
        down = loss()
        m.p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / 0.01, abs=2e-3)


def test_scores_do_not_depend_on_company():
    m = quality.ByteConv(3)
    texts = [b"", b"a", b"words " * 300, bytes(range(256)) * 5, b"b" * 256, b"c" * 257]
    ends = np.cumsum([0] + [len(t) for t in texts])
    together = m.scores(np.frombuffer(b"".join(texts), np.uint8), ends)
    alone = [m.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_scores_are_those_of_a_second_forward_pass():
    """The network written out, byte by byte and chunk by chunk."""
    m = quality.ByteConv(5)
    p = {k: v.astype(float) for k, v in m.p.items()}
    block, kernel, step = quality.BLOCK, quality.KERNEL, quality.STEP

    def score(text):
        rows = max(1, -(-len(text) // block))
        padded = text + b"\0" * (rows * block + kernel - len(text))
        best = []
        for row in range(rows):
            # a row's last windows look ahead into the next row of the same text
            acts = []
            for at in range(row * block, (row + 1) * block, step):
                values = np.concatenate([p["embed"][b] for b in padded[at : at + kernel]])
                acts.append(values @ p["filters"] + p["bias"])
            best.append(np.max(acts, 0))
        chunks = [np.maximum(np.maximum(best[i], best[min(i + 1, rows - 1)]), 0) for i in range(max(1, rows - 1))]
        last = np.maximum(best[-1], 0)
        features = np.concatenate([np.maximum(np.max(chunks, 0), last), np.mean(chunks, 0)])
        return 1 / (1 + np.exp(-(features @ p["out"] + p["out_bias"][0])))

    texts = [t.encode() for t in ("", "a", prose(30), prose(400), "x" * 255, "x" * 256, "y" * 257, "naïve café 日本語 " * 40, prose(2000))]
    got = m.scores(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    assert np.allclose(got, [score(t) for t in texts], atol=1e-5)


def test_a_text_past_the_bound_leaves_the_rest_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 20_000)
    texts = {i: ("good words here " * 20 if i % 2 else "$$$ %%% junk " * 20) for i in range(90)}
    first = min((i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"))).first()[0])
    texts[first] = "z" * 30_000
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    m = quality.fit(d, spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int"), updates=20)
    assert any((m.p[k] != quality.ByteConv().p[k]).any() for k in m.p)


def test_quality(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(d, lab, updates=250)
    got = quality.score(d, model).join(lab.dropDuplicates(["doc_id"]), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.93
    assert np.mean([r.predicted for r in held if r.quality == 1]) >= 0.97
    assert quality.score(docs, model).count() == docs.count()
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).filter("predicted = 1").count()
    assert quality.score(empty, quality.fit(empty, lab)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 2), *[(100, 100 + k) for k in range(1, 60)], *[(k, k + 1) for k in range(200, 240)]]
    got = {r.node: r.component for r in _common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got.get(2) == got.get(3) == 1 and got[11] == 10 and all(got[100 + k] == 100 for k in range(1, 60)) and all(got[k] == 200 for k in range(201, 241))
    assert _common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_join(spark):
    left = spark.range(9000).select((F.col("id") % 9 % 3 % 2).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, v string")
    counts = left.groupBy("k").count()
    hot = _common.hot_keys(counts, "k", 9000)
    assert hot.count() == 2
    assert sorted(map(tuple, _common.spread_join(left, right, "k", hot).collect())) == sorted(map(tuple, left.join(right, "k").collect()))
