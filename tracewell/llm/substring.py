"""Removal of repeated passages by super-k-mer partitioning.

Every window of k words has a minimiser, the least hash of the m-word groups in it; neighbouring
windows that share one travel as one packed string to the minimiser's bucket, where sorting brings
equal windows together and the words themselves confirm them. Before that, each batch of texts
settles its own repeats, so that of a hot passage one copy a batch travels, not one a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = 0x9E3779B97F4A7C15
#: Text bytes a bucket stands for, and text bytes a batch takes at once.
BUCKET_BYTES, BATCH_BYTES = 2 << 20, 4 << 20
NO_ID = np.iinfo(np.int64).max
#: Windows that a task remembers from batch to batch; the others travel once a batch.
HOT_WINDOWS = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in sequence, from the words' hashes."""
    out = np.zeros(max(0, h.size - k + 1), np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + h[i : i + out.size]
    return _mix(out)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minima over each n neighbours."""
    size, out = 1, x
    while size < n:
        step = min(size, n - size)
        out = np.minimum(out[: out.size - step], out[step:])
        size += step
    return out


class Words:
    """The words of joined texts (one blank between words): their places and a 64-bit hash of each."""

    def __init__(self, data: bytes):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        word = (raw != 32) & (raw != 10)
        edge = np.diff(np.r_[np.int8(0), word.view(np.int8), np.int8(0)])
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = self.stop - self.start
        if not size.size:
            self.hash = np.zeros(0, np.uint64)
            return
        first = np.cumsum(size) - size
        powers = np.cumprod(np.r_[np.uint64(1), np.full(size.max() - 1, BASE, np.uint64)], dtype=np.uint64)
        terms = powers[np.arange(first[-1] + size[-1]) - np.repeat(first, size)]
        terms *= raw[word].astype(np.uint64) + np.uint64(1)
        self.hash = _mix(np.add.reduceat(terms, first) + size.astype(np.uint64))

    def window(self, i: int, k: int) -> bytes:
        return self.data[self.start[i] : self.stop[i + k - 1]]


def least_doc(words: Words, at: np.ndarray, doc: np.ndarray, k: int, h: np.ndarray | None = None) -> np.ndarray:
    """For each window of k words (from word at[i], of document doc[i]) the least document that has
    an equal one. Equal hashes are confirmed on the words; where they lie, the words decide."""
    h = _rolled(words.hash, k)[at] if h is None else h
    if not h.size:
        return doc
    order = np.argsort(h)
    sorted_h, places = h[order], at[order]
    new = np.r_[True, sorted_h[1:] != sorted_h[:-1]]
    heads = np.flatnonzero(new)
    low = np.empty_like(doc)
    low[order] = np.minimum.reduceat(doc[order], heads)[np.cumsum(new) - 1]
    again = np.flatnonzero(~new)
    data = words.data
    a, b = words.start[places[again - 1]].tolist(), words.stop[places[again - 1] + k - 1].tolist()
    c, d = words.start[places[again]].tolist(), words.stop[places[again] + k - 1].tolist()
    lies = [n for n, (i, j, x, y) in enumerate(zip(a, b, c, d, strict=True)) if data[i:j] != data[x:y]]
    if lies:
        hit = np.flatnonzero(np.isin(h, sorted_h[again[lies]]))
        best: dict[bytes, int] = {}
        for i in hit.tolist():
            w = words.window(at[i], k)
            best[w] = min(best.get(w, NO_ID), int(doc[i]))
        low[hit] = [best[words.window(at[i], k)] for i in hit.tolist()]
    return low


class Hot:
    """Windows that a batch of a task held more than once, with the least document that had them: what
    a later batch of the task knows of them need not travel again. At most HOT_WINDOWS are kept."""

    def __init__(self, k: int):
        self.k, self.hash, self.seen = k, np.zeros(0, np.uint64), {}

    def settle(self, words: Words, at: np.ndarray, h: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The least document of each window, earlier batches included; takes this batch's hot windows up."""
        out = low.copy()
        for i in np.flatnonzero(np.isin(h, self.hash)).tolist():
            text, least = self.seen[int(h[i])]
            if text == words.window(at[i], self.k):
                out[i] = min(int(out[i]), least)
        again = np.flatnonzero(low < doc)
        _, first = np.unique(h[again], return_index=True)
        for i in again[first].tolist():
            text, key = words.window(at[i], self.k), int(h[i])
            if key in self.seen:
                if self.seen[key][0] == text:
                    self.seen[key] = text, min(self.seen[key][1], int(out[i]))
            elif len(self.seen) < HOT_WINDOWS:
                self.seen[key] = text, int(out[i])
        self.hash = np.fromiter(self.seen, np.uint64, len(self.seen))
        return out


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[np.int8(0), flag.view(np.int8), np.int8(0)])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: What travels: of each super-k-mer its document, text tag, first word's place, number of words and
#: words; a row without text holds runs of windows already settled, with the number of windows.
PARTS = {"doc": np.int64, "tag": np.int64, "at": np.int32, "n": np.int32}
SENT = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in (*PARTS, "text"))])


def _send(k: int, m: int, buckets: int):
    """Rows (doc, tag, text) -> packed super-k-mers by bucket."""

    def pack(bucket: int, text: bytes | None, **parts: np.ndarray) -> dict:
        press = zstandard.ZstdCompressor(level=6)
        sized = {c: press.compress(parts[c].astype(kind).tobytes()) for c, kind in PARTS.items()}
        return sized | {"bucket": bucket, "text": None if text is None else press.compress(text)}

    def one(doc: np.ndarray, tag: np.ndarray, texts: list[bytes], hot: "Hot") -> Iterator[dict]:
        words = Words(b"\n".join(texts))
        n = words.hash.size - k + 1
        if n < 1:
            return
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        of = np.searchsorted(bounds, words.start, "right") - 1
        first = np.searchsorted(words.start, bounds)
        at = np.flatnonzero(of[:n] == of[k - 1 :])
        if not at.size:
            return
        known = np.zeros(n, bool)
        rolled = _rolled(words.hash, k)
        low = least_doc(words, at, doc[of[at]], k, rolled[at])
        known[at] = hot.settle(words, at, rolled[at], low, doc[of[at]]) < doc[of[at]]
        ask = np.zeros(n, bool)
        ask[at] = ~known[at]
        s, e = _runs(known)
        if s.size:
            any_bucket = int(_mix(doc[:1].view(np.uint64) + np.uint64(s.size))[0] % np.uint64(buckets))  # these need no company
            yield pack(any_bucket, None, doc=doc[of[s]], tag=tag[of[s]], at=s - first[of[s]], n=e - s)
        least = _least(_rolled(words.hash, m), k - m + 1)
        cut = (least[1:] != least[:-1]) | (of[1:n] != of[: n - 1]) | (ask[1:] != ask[:-1])
        begin = np.r_[0, np.flatnonzero(cut) + 1]
        end = np.r_[begin[1:], n]
        begin, end = begin[ask[begin]], end[ask[begin]]
        bucket = least[begin] % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        begin, end, bucket = begin[order], end[order], bucket[order]
        left, right, own, data = words.start[begin].tolist(), words.stop[end + k - 2].tolist(), of[begin], words.data
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if begin.size else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            text = b"\n".join([data[i:j] for i, j in zip(left[a:b], right[a:b], strict=True)])
            yield pack(int(bucket[a]), text, doc=doc[own[a:b]], tag=tag[own[a:b]], at=begin[a:b] - first[own[a:b]], n=end[a:b] - begin[a:b] + k - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Hot(k)
        for b in batches:
            doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts, begin, size = [], 0, 0
            for i in range(b.num_rows):
                texts.append(b" ".join((b.column(2)[i].as_py() or "").encode().split()))
                size += len(texts[-1])
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    if rows := list(one(doc[begin : i + 1], tag[begin : i + 1], texts, hot)):
                        yield pa.RecordBatch.from_pylist(rows, SENT)
                    texts, begin, size = [], i + 1, 0

    return run


def _settle(k: int):
    """Packed super-k-mers, a bucket's rows in sequence -> (doc, tag, run): runs of windows that a
    smaller document has too, as first window << 32 | windows."""

    def one(held: list[dict]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        cols = {c: [np.frombuffer(expand.decompress(r[c]), kind) for r in held] for c, kind in PARTS.items()}
        known = [i for i, r in enumerate(held) if r["text"] is None]
        new = [i for i, r in enumerate(held) if r["text"] is not None]
        take = lambda c, rows: np.concatenate([cols[c][i] for i in rows] or [np.zeros(0, PARTS[c])])
        doc, tag, at, n = ([take(c, known)] for c in PARTS)
        if new:
            d, t, a, w = (take(c, new) for c in PARTS)
            words = Words(b"\n".join([expand.decompress(held[i]["text"]) for i in new]))
            first = np.cumsum(w, dtype=np.int64) - w
            many = w - k + 1
            of = np.repeat(np.arange(w.size), many)
            start = np.arange(of.size) - np.repeat(np.cumsum(many) - many, many)
            seen = least_doc(words, first[of] + start, d[of], k) < d[of]
            # A blank place after each string keeps runs apart.
            flag = np.zeros(of.size + w.size, bool)
            flag[np.arange(of.size) + of] = seen
            s, e = _runs(flag)
            mine = np.searchsorted(np.cumsum(many + 1), s, "right")
            doc.append(d[mine]), tag.append(t[mine]), n.append(e - s)
            at.append(a[mine] + s - (np.cumsum(many + 1) - many - 1)[mine])
        run = np.concatenate(at).astype(np.int64) << 32 | np.concatenate(n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc)), pa.array(np.concatenate(tag)), pa.array(run)], ["doc", "tag", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and held[-1]["bucket"] != row["bucket"]:
                    yield from one(held)
                    held = []
                held.append(row)
        if held:
            yield from one(held)

    return run


def _strike(k: int):
    """Rows (id, text, runs) -> id, n_words, n_removed, text without the covered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, gone, kept = [], [], []
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                count.append(len(words))
                if runs.is_valid and len(runs):
                    r = runs.values.to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, r >> 32, 1)
                    np.add.at(edge, (r >> 32) + (r & 0xFFFFFFFF) + k - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                gone.append(count[-1] - len(words))
                kept.append(b" ".join(words).decode())
            arrays = [pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["id", "n_words", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, k: int = 13, m: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, text (the kept words, one blank between).

    A word goes if a window of k words that covers it also starts in a document with a smaller id;
    windows are judged on the input. Null texts have no words. A null id counts as larger than any
    other, and rows of one id never count as smaller than each other, so they strike nothing among
    themselves; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.coalesce("id", F.lit(int(NO_ID))).alias("doc"), "text")
    ids = rows.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    size, most = ids.agg(F.sum("size"), F.max("n")).first()
    buckets = min(max(64, -(-(size or 0) // bucket_bytes)), 1 << 30)
    # Only where ids repeat does a text need a mark of its own: a hash of it, as rows of one id and one text have one result.
    tag = F.xxhash64(F.lit(7), "text") if (most or 0) > 1 else F.lit(0).cast("long")
    rows = rows.withColumn("tag", tag)
    sent = rows.select("doc", "tag", "text").mapInArrow(_send(k, m, buckets), "bucket int, doc binary, tag binary, at binary, n binary, text binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    runs = dealt.mapInArrow(_settle(k), "doc long, tag long, run long").groupBy("doc", "tag").agg(F.collect_set("run").alias("runs"))
    joined = rows.join(runs, ["doc", "tag"], "left").select("id", "text", "runs")
    return joined.mapInArrow(_strike(k), "id long, n_words long, n_removed long, text string").withColumnRenamed("id", id_col)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
