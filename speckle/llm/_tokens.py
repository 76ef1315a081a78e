"""Tokenizers by path, loaded once for each Python worker."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words of a worker's table of encoded words; there are two, a new and an old one.
CACHE_WORDS = 300_000
#: Texts are handed to a tokenizer in blocks of about this many characters.
BLOCK_CHARS = 1 << 20


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def version(path: str) -> str:
    """Digest of the tokenizer's file: counts made by another version are never reused."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.cache
def _json(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def _ranks(path: str):
    """The tiktoken encoding with the same vocabulary as a byte-level .json, if its rank file lies beside it."""
    import public_tokenizers
    import tiktoken

    file = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(file):
        return None
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    same = _json(path).get_vocab_size() == len(ranks) + 1
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None


def _plain(text: str) -> bool:
    """No special token's string, and no character above Latin Extended-B, whose class Unicode versions may disagree on."""
    return "<|" not in text and (text.isascii() or max(text) < "ɐ")


_words: dict[str, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}


@functools.cache
def _separator(path: str) -> tuple[str, int]:
    """A special token and its id: nothing but its own string, which _encoded() sets apart, is encoded to it."""
    i, t = max((i, t) for i, t in _json(path).get_added_tokens_decoder().items() if t.special)
    return t.content, i


@functools.cache
def _merger(path: str):
    """(merge, ids): the merges of a byte-level BPE file with word ends as a tiktoken rank table, and each rank's id.

    The end of a word is written as byte 255, which is in no UTF-8 text. None if the file is of another kind, or if
    the table encodes any whole word of the vocabulary unlike the library.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not end:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    symbol = {b: ch for ch, b in byte.items()}

    def spelt(token: str) -> bytes:
        return bytes(byte[ch] for ch in token.removesuffix(end)) + b"\xff" * token.endswith(end)

    vocab, ranks, ids = model["vocab"], {b"\xff": 0}, [-1]
    tokens = [symbol[b] for b in range(255)] + [symbol[b] + end for b in range(255)]
    tokens += ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
    for t in tokens:
        if t in vocab and spelt(t) not in ranks:
            ranks[spelt(t)] = len(ids)
            ids.append(vocab[t])
    import tiktoken

    merge = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    numbers = np.array(ids)
    whole = [w for w in (spelt(t)[:-1].decode("utf-8", "replace") for t in list(vocab)[::16] if t.endswith(end)) if _latin(w) and w == w.lower()]
    same = all(numbers[merge(w.encode() + b"\xff")].tolist() == _json(path).encode(w, add_special_tokens=False).ids for w in whole)
    return (merge, numbers) if same else None


def _latin(word: str) -> bool:
    """Letters up to Latin Extended-B that stay letters in lower case."""
    return word.isalpha() and (word.isascii() or (max(word) < "ɐ" and word.lower().isalpha()))


@functools.cache
def _id_bytes(path: str, dtype: str) -> list[bytes]:
    """The bytes of each rank's id."""
    return [np.array(i if i >= 0 else 0, dtype).tobytes() for i in _merger(path)[1].tolist()]


#: Signs that words end in; a run of them is a piece of its own.
SIGNS = ".,!?|$%&#*"


def _encoded(path: str, new: list[bytes], dtype: str) -> list[bytes]:
    """Ids of each word.

    Latin letters, with or without signs after them, go through the rank table; other words through the library, as
    one text in which a special token parts them; words that hold special strings one by one.
    """
    merger = _merger(path)
    merge, as_bytes = (merger[0], _id_bytes(path, dtype).__getitem__) if merger else (None, None)
    got, plain = {}, []
    for w in new:
        s = w.decode()
        head = s.rstrip(SIGNS)
        if merger and _latin(head):
            ranks = merge(head.lower().encode() + b"\xff")
            if len(head) < len(s):
                ranks += merge(s[len(head) :].encode() + b"\xff")
            got[w] = b"".join(map(as_bytes, ranks))
        elif "<|" in s:
            got[w] = np.asarray(_json(path).encode(s, add_special_tokens=False).ids, dtype).tobytes()
        else:
            plain.append(w)
    mark, mark_id = _separator(path)
    for i in range(0, len(plain), 20_000):
        part = plain[i : i + 20_000]
        ids = np.asarray(_json(path).encode_batch_fast([mark.join(w.decode() for w in part)], add_special_tokens=False)[0].ids, dtype)
        cuts = np.nonzero(ids == mark_id)[0]
        size = ids.itemsize
        data, lo, hi = ids.tobytes(), np.concatenate([[0], cuts + 1]) * size, np.concatenate([cuts, [len(ids)]]) * size
        got.update(zip(part, map(data.__getitem__, map(slice, lo.tolist(), hi.tolist())), strict=True))
    return [got[w] for w in new]


def _by_word(path: str, texts: list[str], dtype: str) -> list[np.ndarray]:
    """For tokenizers that drop white space: ids of a text are those of its words, end to end, so words are cached.

    When the table is full it becomes the old one, from which words that come again are taken over.
    """
    known, old = _words.get(path, ({}, {}))
    if len(known) > CACHE_WORDS:
        known, old = {}, known
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    new = []
    for w in set().union(*split).difference(known):
        if (x := old.get(w)) is None:
            new.append(w)
        else:
            known[w] = x
    known.update(zip(new, _encoded(path, new, dtype), strict=True))
    _words[path] = known, old
    return [np.frombuffer(b"".join(map(known.__getitem__, ws)), dtype) for ws in split]


@functools.cache
def drops_space(path: str) -> bool:
    """Whether the tokenizer encodes white-space separated words one by one."""
    t = _json(path)
    probe = ["Two  words", "a\nb ", "<|x|> y's 12\t3"]
    return all(t.encode(p, add_special_tokens=False).ids == [i for w in p.split() for i in t.encode(w, add_special_tokens=False).ids] for p in probe) and not t.encode(" \n\t", add_special_tokens=False).ids


def encode(path: str, texts: list[str], dtype: str = "<u4") -> list[np.ndarray]:
    """Ids of each text by the library for the file, without begin, end or added special tokens."""
    if path.endswith(".model"):
        return [np.asarray(x, dtype) for x in _pieces(path).encode(texts, num_threads=1)]
    if drops_space(path):
        return _by_word(path, texts, dtype)
    ranks = _ranks(path)
    if ranks is None:
        return [np.asarray(e.ids, dtype) for e in _json(path).encode_batch_fast(texts, add_special_tokens=False)]
    return [np.asarray(ranks.encode_ordinary(t) if _plain(t) else _json(path).encode(t, add_special_tokens=False).ids, dtype) for t in texts]


def blocks(texts: list[str]):
    """Slices of texts, each of about BLOCK_CHARS characters, at least one text."""
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= BLOCK_CHARS:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
