"""Benchmark decontamination by winnowing.

Of every window of words the least hash of its k-word groups is the window's fingerprint; two equal
windows have equal ones, so each shared span of a window's length or more meets by a fingerprint.
Test fingerprints go to the tasks as a bit field of bounded size. A document window whose
fingerprint is in it, and whose extension to the whole window is in a second one, joins the test
windows on the words themselves; met windows extend to spans. Texts are never shuffled, and what
passes a bit field wrongly is ruled out by the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise, table
from .substring import BASE, _least, _mix, _rolled

#: Words of a window, and of the groups whose least hash is its fingerprint.
WINDOW, GRAM = 10, 5
#: Text bytes cut at once, words hashed at once, and the largest bit field (as a power of two): 8 MB.
PIECE_BYTES, BLOCK_WORDS, FIELD_BITS = 4 << 20, 1 << 19, 26
#: Bytes of words as they are compared: A-Z lower-cased, ASCII other than letters and digits blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class _Hashes(dict):
    """A 64-bit hash of each word seen; forgets all at a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def _pieces(text: bytes, overlap: int, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first word's place, words) of a text's pieces; each begins with the `overlap` words before it."""
    text = text.translate(FOLD)
    at, place, before = 0, 0, []
    while at < len(text):
        end = len(text) if len(text) - at <= size else text.rfind(b" ", at, at + size)
        if end < 0:
            end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end + 1
        words = before + text[at:end].split()
        yield place - len(before), words
        place += len(words) - len(before)
        before = words[-overlap:] if overlap else []
        at = end


class _Block:
    """The words of some pieces together: windows do not run from one into the next."""

    def __init__(self, pieces: list[tuple[int, int, list[bytes]]], hashes: _Hashes):
        self.words = list(chain.from_iterable(w for _, _, w in pieces))
        self.hash = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, len(self.words))
        size = np.array([len(w) for _, _, w in pieces], np.int64)
        self.of = np.repeat(np.arange(size.size), size)
        self.owner = np.array([o for o, _, _ in pieces], np.int64)
        self.place = np.array([p for _, p, _ in pieces], np.int64) - (np.cumsum(size) - size)
        self.grams: dict[int, np.ndarray] = {}

    def fingerprints(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, fingerprints) of the windows of `size` words."""
        k = min(gram, size)
        if k not in self.grams:
            self.grams[k] = _rolled(self.hash, k)
        low = _least(self.grams[k], size - k + 1) if self.words[size - 1 :] else np.zeros(0, np.uint64)
        at = np.flatnonzero(self.of[: low.size] == self.of[size - 1 :])
        return at, _mix(low[at] + np.uint64(size))

    def extended(self, at: np.ndarray, size: int) -> np.ndarray:
        """A hash of each whole window."""
        out = np.full(at.size, size, np.uint64)
        for i in range(size):
            out = out * np.uint64(BASE) + self.hash[at + i]
        return _mix(out)

    def keys(self, at: np.ndarray, size: int) -> list[bytes]:
        return [b" ".join(self.words[i : i + size]) for i in at.tolist()]


def _has(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a hash's bit is set; the highest bits of a hash are its place."""
    at = h >> np.uint64(64 - (field.size * 64).bit_length() + 1)
    return (field[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _test_windows(window: int, gram: int, piece_bytes: int):
    """(item, text) -> each window of the item: item, size, key (its words), fingerprint, extended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for i in range(b.num_rows):
                for place, words in _pieces(b.column(1)[i].as_py() or b"", window - 1, piece_bytes):
                    if not words:
                        continue
                    size = min(window, len(words))
                    block = _Block([(0, place, words)], hashes)
                    at, prints = block.fingerprints(size, gram)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(b.column(0)[i], at.size), pa.array(np.full(at.size, size, np.int32)), pa.array(block.keys(at, size), pa.binary()),
                         pa.array(prints.view(np.int64)), pa.array(block.extended(at, size).view(np.int64))],
                        ["item", "size", "key", "fingerprint", "extended"],
                    )

    return run


_FOUND = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("key", pa.binary())])


def _candidates(sizes: list[int], gram: int, fields, piece_bytes: int):
    """(id, text) -> id, n_words and the windows that pass both bit fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (prints, whole) = _Hashes(), fields.value
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            owner, start, stop, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
            held, waiting = [], 0

            def take() -> None:
                block = _Block(held, hashes)  # noqa: B023
                for size in sizes:
                    at, low = block.fingerprints(size, gram)
                    at = at[_has(prints, low)]
                    at = at[_has(whole, block.extended(at, size))]
                    of = block.of[at]
                    owner.append(block.owner[of])  # noqa: B023
                    start.append((at + block.place[of]).astype(np.int32))  # noqa: B023
                    stop.append(start[-1] + np.int32(size))  # noqa: B023
                    keys.extend(block.keys(at, size))  # noqa: B023

            for i in range(b.num_rows):
                for place, words in _pieces(b.column(1)[i].as_py() or b"", max(sizes, default=1) - 1, piece_bytes):
                    n[i] = place + len(words)
                    held.append((i, place, words))
                    waiting += len(words)
                    if waiting >= BLOCK_WORDS:
                        take()
                        held, waiting = [], 0
            if waiting:
                take()
            of = np.concatenate(owner)
            order = np.argsort(of, kind="stable")
            offsets = np.searchsorted(of[order], np.arange(b.num_rows + 1))
            flat = [pa.array(np.concatenate(start)[order]), pa.array(np.concatenate(stop)[order]), pa.array([keys[i] for i in order.tolist()], pa.binary())]
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(_FOUND)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), found], ["id", "n_words", "found"])

    return run


def _spans():
    """(row, windows, hits) -> row, windows, n_hit and the spans that overlapping and adjoining hits make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(2)
            lengths = np.diff(hits.offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows, dtype=np.int64), lengths)
            flat = hits.flatten()
            start, stop = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            order = np.lexsort((start, of))
            of, start, stop = of[order], start[order], stop[order]
            reach = np.maximum.accumulate((of << 32) + stop)
            new = np.r_[True, (of[1:] << 32) + start[1:] > reach[:-1]] if of.size else np.zeros(0, bool)
            head = np.flatnonzero(new)
            begin, own = start[head], of[head]
            end = (reach[np.r_[head[1:] - 1, of.size - 1]] if head.size else head) & 0xFFFFFFFF
            n_hit = np.bincount(own, end - begin, b.num_rows).astype(np.int64)
            offsets = np.searchsorted(own, np.arange(b.num_rows + 1))
            pairs = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "stop"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["row", "windows", "n_hit", "spans"])

    return run


def _field(windows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit field of 2 ** bits bits with those of the column's hashes set; it has a row per 64 bits at most."""
    at = F.shiftrightunsigned(column, 64 - bits)
    words = windows.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", field_bits: int = FIELD_BITS, piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, spans (start, stop of runs of hit words), items (the ids, as
    strings in order, of items with a window in the document), contaminated.

    Words are runs of anything but ASCII characters other than letters and digits, A-Z lower-cased. A window is
    `window` consecutive words of an item, or the whole of a shorter item; a document word inside an occurrence of
    one is hit. `gram` words make a group of winnowing; it changes the work, never the result.

    A null or wordless text has no words, a wordless item no window. Rows of docs that repeat an id are judged each,
    rows of an item that repeat an id are one item; the windows of an item without an id hit words, but it is not
    listed. Other columns are ignored, whatever their names. Empty tables give an empty result or no hit.

    The bit fields have 16 bits a window up to 2 ** field_bits bits; beyond that more candidates travel and the join
    rules them out. A document emits each of its own candidates once and never meets another document; items come in
    by the distinct sets of windows that documents hold, so copies of a contaminated text expand once.
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.encode(F.col(f"`{item_text_col}`").cast("string"), "UTF-8").alias("text"))
    every = materialise(tests.mapInArrow(_test_windows(window, gram, piece_bytes), "item string, size int, key binary, fingerprint long, extended long"))
    windows = every.groupBy("key").agg(F.min("size").alias("size"), F.min("fingerprint").alias("fingerprint"), F.min("extended").alias("extended"))
    windows = materialise(windows.withColumn("window", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    bits = min(field_bits, max(16, (16 * windows.count()).bit_length()))
    fields = spark.sparkContext.broadcast((_field(windows, "fingerprint", bits), _field(windows, "extended", bits)))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.encode(F.col(f"`{text_col}`").cast("string"), "UTF-8").alias("text"))
    rows = texts.mapInArrow(_candidates(sizes, gram, fields, piece_bytes), "id long, n_words long, found array<struct<start: int, stop: int, key: binary>>")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    met = rows.select("row", F.inline("found")).join(windows.select("key", "window"), "key")
    met = met.groupBy("row").agg(F.array_sort(F.collect_set("window")).alias("windows"), F.collect_list(F.struct("start", "stop")).alias("hits"))
    hit = met.select("row", "windows", "hits").mapInArrow(_spans(), "row long, windows array<long>, n_hit long, spans array<struct<start: int, stop: int>>")
    hit = materialise(hit.withColumn("held", F.sha2(F.concat_ws(",", F.col("windows").cast("array<string>")), 256)))
    sets = hit.groupBy("held").agg(F.first("windows").alias("windows")).select("held", F.explode("windows").alias("window"))
    of = every.filter("item is not null").select("key", "item").distinct().join(windows.select("key", "window"), "key").select("window", "item")
    items = sets.join(of, "window").select("held", "item").distinct().groupBy("held").agg(F.array_sort(F.collect_list("item")).alias("items"))
    items = items.select(F.concat("held").alias("held"), "items")  # dealt anew, so AQE may split the documents of a hot set
    listed = hit.join(items, "held", "left").select("row", "n_hit", "spans", "items")
    out = rows.select("row", "id", "n_words").join(listed, "row", "left")
    none, empty = F.array().cast("array<string>"), F.array().cast("array<struct<start: int, stop: int>>")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", empty).alias("spans"),
        F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS key FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
u AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, s, key FROM u WHERE key IN (SELECT key FROM t)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT m.doc_id, CAST(t.item_id AS VARCHAR) AS x FROM m JOIN t USING (key)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""
