"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

A suffix automaton over the vocabulary names, at each byte of a word, every token that ends there.
Each prefix has one last token: the one that fits the last token of the rest, where two tokens fit
if merging their joined bytes by rank gives just these two. Back-pointers then give the exact ids.
Many distinct words are handled at once, a byte of each at a time, as numpy arrays; words repeat, so
each Python worker keeps the ids of recent ones in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: the public split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BASE = 256
#: Parts of texts whose ids a worker keeps; entries of the table of last tokens; characters of the texts that are encoded together.
#: They bound a worker's memory; ids do not depend on them.
CACHED_PIECES, CELLS, TOGETHER = 200_000, 2_000_000, 1_000_000
#: Characters of parts and words that a worker keeps for each of CACHED_PIECES: parts are short where texts have spaces, but whole lines where not.
CACHED_CHARS = 32
#: Bytes from which a word is encoded alone: few are that long, and arrays over them would hold a row or two.
LONG = 512


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _check(spec: dict) -> None:
    """Refuse settings that this codec does not follow."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["normalizer"] * bool(spec.get("normalizer")) + ["type"] * (model.get("type", "BPE") != "BPE")
    wrong += ["pre_tokenizer"] * (split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True))
    wrong += [k for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if x.get(k)]
    back = _byte_of_char()
    if sorted(back[t] for t, i in model["vocab"].items() if i < BASE and len(t) == 1) != list(range(BASE)):
        wrong.append("the first ids are not the bytes")
    if wrong:
        raise ValueError(f"not supported in this tokenizer: {', '.join(wrong)}")


def load_model(path: str) -> dict:
    """Token bytes, merges and the vocabulary's automaton as flat arrays; its size is the vocabulary's.
    A byte-level tokenizer with other settings (see _check) is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _check(spec)
    back, vocab = _byte_of_char(), spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for t, i in vocab.items():
        tokens[i] = t.encode() if t in special else bytes(back[c] for c in t)
    for t, i in special.items():
        tokens[i] = t.encode()
    left, right = (np.zeros(len(tokens), np.int32) for _ in range(2))
    for m in spec["model"]["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        left[vocab[a + b]], right[vocab[a + b]] = vocab[a], vocab[b]
    plain = {i: t for i, t in enumerate(tokens) if t and i not in special.values()}
    return {"tokens": tokens, "special": special, "left": left, "right": right} | _automaton(plain)


def _automaton(words: dict[int, bytes]) -> dict[str, np.ndarray]:
    """A suffix automaton of all words: transitions, suffix links, lengths, and the word that a state spells."""
    step: list[dict[int, int]] = [{}]
    link, length, word = [-1], [0], [-1]

    def state(size: int, steps: dict[int, int], suffix: int) -> int:
        step.append(steps), link.append(suffix), length.append(size), word.append(-1)
        return len(step) - 1

    def split(p: int, c: int, q: int) -> int:
        """The part of q that is reached from p by c, as a state of its own."""
        new = state(length[p] + 1, dict(step[q]), link[q])
        link[q] = new
        while p != -1 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    for i, w in words.items():
        at = 0
        for c in w:
            q = step[at].get(c)
            if q is not None:
                at = q if length[q] == length[at] + 1 else split(at, c, q)
                continue
            new, p = state(length[at] + 1, {}, 0), at
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
            at = new
        word[at] = i
    near = [-1] * len(step)  # the first state along the links, itself included, that spells a word
    for s in sorted(range(1, len(step)), key=length.__getitem__):
        near[s] = s if word[s] >= 0 else near[link[s]] if link[s] > 0 else -1
    keys = np.fromiter((s << 8 | c for s, d in enumerate(step) for c in d), np.int64)
    to = np.fromiter((t for d in step for t in d.values()), np.int32, len(keys))
    return {"keys": keys, "to": to} | {k: np.array(v, np.int32) for k, v in (("link", link), ("length", length), ("word", word), ("near", near))}


class _Table:
    """Integer keys to values, by open addressing, for whole arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, keys.size) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = keys.astype(np.int64), values.astype(np.int32)
        at = self._home(keys)
        while keys.size:
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for one place the last one stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        at = self._home(keys)
        seen = self.keys[at]
        out = self.values[at]
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while left.size:
            at[left] = (at[left] + 1) & self.mask
            seen = self.keys[at[left]]
            out[left] = self.values[at[left]]
            left = left[(seen != keys[left]) & (seen >= 0)]
        return np.where(self.keys[at] == keys, out, -1)

    def one(self, key: int) -> int:
        """get() of one key."""
        keys, values = memoryview(self.keys), memoryview(self.values)
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while keys[at] != key:
            if keys[at] < 0:
                return -1
            at = (at + 1) & self.mask
        return values[at]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + size[i] - 1 of all i in sequence."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if size.size else 0) + np.repeat(start - (ends - size), size)


class _Numbers(dict):
    """A number for each key, in the order of first use; `new` lists the keys since the last take()."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def take(self) -> list:
        new, self.new = self.new, []
        return new


class _Lists:
    """Lists of integers by number, end to end."""

    def __init__(self):
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.r_[self.start, self.flat.size + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.flat = np.r_[self.flat, flat.astype(np.int32)]

    def get(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers end to end, and their sizes."""
        size = self.size[which]
        return self.flat[_ragged(self.start[which], size)], size


class Codec:
    """Encodes and decodes with a model of load_model()."""

    def __init__(self, model: dict, cached: int = CACHED_PIECES):
        self.tokens, self.special, self.cached = model["tokens"], model["special"], cached
        self.left, self.right, self.link, self.length, self.word, self.near = (model[k] for k in ("left", "right", "link", "length", "word", "near"))
        self.sizes = np.array([len(t) for t in self.tokens])
        made = np.array(sorted(set(range(BASE, len(self.tokens))) - set(self.special.values())), np.int64)
        self.pair = _Table(self.left[made].astype(np.int64) << 20 | self.right[made], made)
        self.step = _Table(model["keys"], model["to"])
        self.decimals = list(map(str, range(len(self.tokens))))
        self.split = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.heads = {s[0] for s in self.special}
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.piece_ids = _Numbers(), _Lists()
        self.words, self.word_ids = _Numbers(), _Lists()
        self.held = 0  # characters of parts and words

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of two tokens merge into these two: undo the later of the two
        merges at the border again and again; no border merge may have come before it."""
        out, at, bound = np.ones(a.size, bool), np.arange(a.size), np.full(a.size, 1 << 30)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while at.size:
            merged = self.pair.get(a << 20 | b)
            fails = (merged >= 0) & (merged < bound)
            out[at[fails]] = False
            go = np.flatnonzero(~fails & ((a >= BASE) | (b >= BASE)))
            at, a, b = at[go], a[go], b[go]
            later = a > b
            bound = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def _last_tokens(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Words as rows of bytes, the longest first -> for each prefix of each, its last token."""
        last = np.zeros((sizes.size, data.shape[1] + 1), np.int32)
        at, size = np.zeros(sizes.size, np.int64), np.zeros(sizes.size, np.int64)
        for i in range(1, data.shape[1] + 1):
            n = int(np.searchsorted(-sizes, -i, "right"))
            at, size, c = at[:n], size[:n], data[:n, i - 1].astype(np.int64)
            to = self.step.get(at << 8 | c)
            lost = np.flatnonzero(to < 0)
            while lost.size:  # each byte is a token, so the automaton's root steps on
                at[lost] = self.link[at[lost]]
                size[lost] = self.length[at[lost]]
                to[lost] = self.step.get(at[lost] << 8 | c[lost])
                lost = lost[to[lost] < 0]
            at, size = to.astype(np.int64), size + 1
            s = np.where((self.word[at] >= 0) & (self.length[at] <= size), at, self.near[self.link[at]])
            row = np.arange(n)
            while row.size:  # the longest token first; one of them fits
                t = self.word[s]
                rest = i - self.length[s]
                fits = rest == 0
                ask = np.flatnonzero(~fits)
                fits[ask] = self._fits(last[row[ask], rest[ask]], t[ask])
                last[row[fits], i] = t[fits]
                row, s = row[~fits], self.near[self.link[s[~fits]]]
        return last

    def _fit(self, a: int, b: int) -> bool:
        """_fits() of one pair."""
        left, right, bound = memoryview(self.left), memoryview(self.right), 1 << 30
        while True:
            if 0 <= self.pair.one(a << 20 | b) < bound:
                return False
            if a < BASE and b < BASE:
                return True
            if a > b:
                a, bound = right[a], a
            else:
                b, bound = left[b], b + 1

    def _encode_long(self, word: bytes) -> list[int]:
        """The ids of one word, a byte at a time with plain numbers; steps and fitting pairs met before are remembered. A word of n
        bytes takes time in proportion to n."""
        link, length, token, near = (memoryview(x) for x in (self.link, self.length, self.word, self.near))
        steps: dict[int, int] = {}
        fitting: dict[int, bool] = {}
        last, at, size = array("i", bytes(4 * (len(word) + 1))), 0, 0
        for i, c in enumerate(word, 1):
            while True:
                key = at << 8 | c
                to = steps.get(key)
                if to is None:
                    to = steps[key] = self.step.one(key)
                if to >= 0:
                    break
                at = link[at]
                size = length[at]
            at, size = to, size + 1
            s = at if token[at] >= 0 and length[at] <= size else near[link[at]]
            while rest := i - length[s]:  # the longest token first; one of them fits
                key = last[rest] << 20 | token[s]
                fits = fitting.get(key)
                if fits is None:
                    fits = fitting[key] = self._fit(last[rest], token[s])
                if fits:
                    break
                s = near[link[s]]
            last[i] = token[s]
        ids, end = [], len(word)
        while end:
            ids.append(last[end])
            end -= len(self.tokens[last[end]])
        return ids[::-1]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of the split pattern, end to end, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(sizes) - sizes
        ids, counts, a = [], np.zeros(sizes.size, np.int64), 0
        while a < order.size:  # so many words at once that their table stays small
            if sizes[order[a]] > LONG:
                ids.append(np.array(self._encode_long(words[order[a]]), np.int32))
                counts[order[a]] = ids[-1].size
                a += 1
                continue
            part = order[a : a + max(1, CELLS // int(sizes[order[a]] + 1))]
            a += part.size
            n = sizes[part]
            data = np.zeros((part.size, int(n[0])), np.uint8)
            data[np.repeat(np.arange(part.size), n), _ragged(np.zeros(part.size, np.int64), n)] = flat[_ragged(start[part], n)]
            last = self._last_tokens(data, n)
            row, end, found = np.arange(part.size), n.copy(), []
            while row.size:  # back-pointers: the last token of the word, of what is before it, and so on
                t = last[row, end]
                found.append((row, t))
                end = end - self.sizes[t]
                row, end = row[end > 0], end[end > 0]
            rows, tokens = (np.concatenate([x[k] for x in reversed(found)]) for k in (0, 1))
            by_word = np.argsort(rows, kind="stable")
            ids.append(tokens[by_word].astype(np.int32))
            counts[part] = np.bincount(rows, minlength=part.size)
        store = _Lists()
        store.add(np.concatenate(ids), counts[order])
        back = np.empty_like(order)
        back[order] = np.arange(order.size)
        return store.get(back)

    def _parts(self, text: str) -> list[str]:
        """The text's parts between two spaces, each with the space before it; a line break stands in for that space."""
        if any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or not text.replace("\n", "").isprintable():
            # blanks next to blanks, or rare ones: parts between spaces would not be independent
            return ["\0" + w for w in self.split.findall(text)]
        return ("\0" + text).replace("\n", " \n").split(" ") if text else []

    def _learn(self) -> None:
        """Encode the parts and words that have got a number since the last time."""
        pieces = self.pieces.take()
        if not pieces:
            return
        number, found, sizes = self.words.__getitem__, [], []
        for p in pieces:
            if p[:1] == "\1":
                found.append(~self.special[p[1:]])
                sizes.append(1)
                continue
            words = self.split.findall(p if p[:1] == "\n" else p[1:] if p[:1] == "\0" else " " + p)
            found += map(number, words)
            sizes.append(len(words))
        words = self.words.take()
        self.held += sum(map(len, pieces)) + sum(map(len, words))
        if words:
            self.word_ids.add(*self._encode_words([w.encode() for w in words]))
        which, sizes = np.array(found, np.int64), np.array(sizes, np.int64)
        word = which >= 0
        n = np.ones(which.size, np.int64)
        n[word] = self.word_ids.size[which[word]]
        ids = np.empty(int(n.sum()), np.int32)
        spot = np.repeat(word, n)
        ids[spot] = self.word_ids.get(which[word])[0]
        ids[~spot] = ~which[~word]
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(sizes)]]
        self.piece_ids.add(ids, np.diff(ends))

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has; null counts as empty."""
        number, which, counts = self.pieces.__getitem__, array("q"), []
        for text in texts:
            text, before = text or "", len(which)
            marked = any(h in text for h in self.heads)
            for i, run in enumerate(self.marks.split(text) if marked else [text]):
                # "\1" marks a special token; a text of its own that holds it is not printable, so it gets "\0" before it
                which.extend(map(number, ["\1" + run] if i % 2 else self._parts(run)))
            counts.append(len(which) - before)
        self._learn()
        flat, size = self.piece_ids.get(np.frombuffer(which, np.int64))
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(np.array(counts, np.int64))]]
        if max(len(self.pieces), len(self.words)) > self.cached or self.held > self.cached * CACHED_CHARS:
            self._forget()
        return flat, np.diff(ends)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The ids of one text, packed as int32 and as decimals joined by commas."""
        ids = self.encode_many([text])[0]
        return ids.tobytes(), ",".join(map(self.decimals.__getitem__, ids.tolist()))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class _Model:
    """The broadcast model with a key by which a worker knows it again."""

    def __init__(self, spark: SparkSession, path: str):
        self.id, self.shared = hashlib.sha256(path.encode()).hexdigest(), spark.sparkContext.broadcast(load_model(path))

    @property
    def value(self) -> dict:
        return self.shared.value


_codecs: dict[str, Codec] = {}


def _codec(model: _Model) -> Codec:
    """One codec a worker process: the last model's."""
    if model.id not in _codecs:
        _codecs.clear()
        _codecs[model.id] = Codec(model.value)
    return _codecs[model.id]


def _slices(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of batches of about `most` characters (one row at least) with their texts."""
    for batch in batches:
        texts, start, held = [], 0, 0
        for i, t in enumerate(batch.column(1)):
            texts.append(t.as_py())
            held += len(texts[-1] or "")
            if held >= most or i + 1 == batch.num_rows:
                yield batch.slice(start, len(texts)), texts
                texts, start, held = [], i + 1, 0


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col (long), n_tokens (long), ids (array<int>).

    Whole texts are encoded as ordinary text; a special token's own string becomes that token. Null
    and empty texts have no ids. Repeated rows give repeated results; other columns are ignored.
    """
    model = _Model(docs.sparkSession, tokenizer_path)

    def run(batches):
        codec = _codec(model)
        for b, texts in _slices(batches):
            flat, counts = codec.encode_many(texts)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), ids], [id_col, "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids array<int>")


def decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of rows: id_col (long), text. Null or empty ids give an empty text; an id
    outside the vocabulary fails."""
    model = _Model(rows.sparkSession, tokenizer_path)

    def run(batches):
        codec = _codec(model)
        for b in batches:
            texts = [codec.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    rows = rows.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encode() and of decode() on its ids, in one pass: id_col, n_tokens, ids_sha256, decoded_sha256."""
    model = _Model(docs.sparkSession, tokenizer_path)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches):
        codec = _codec(model)
        for b, texts in _slices(batches):
            flat, counts = codec.encode_many(texts)
            out: list[tuple[int, str, str]] = []
            at = 0
            for n in counts.tolist():
                ids = flat[at : at + n].tolist()
                at += n
                decimal = ",".join(map(codec.decimals.__getitem__, ids))
                out.append((n, sha(decimal.encode()), sha(codec.decode(ids).encode())))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> str:
    """The public byte-level vocabulary, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_tokenizer())
