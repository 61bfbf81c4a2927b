"""Documents whose sets of word shingles are similar, by SimHash and MinHash candidates and exact confirmation.

SimHash fingerprints within 4 bits, all of them found by bit-sliced comparison, name the close pairs; bands of minima name those that are
further apart than its radius reaches. Then the sets themselves decide. A pair of similarity 0.8 shares no band with a
probability of (1 - 0.8 ** 6) ** 40 = 5e-6, one of 0.85 with 6e-9; no pair under the threshold links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import connected_components, materialise
from .simhash import near_duplicates

#: Bands, and minima of each; text bytes of a block of documents that are compared with each other.
BANDS, ROWS, BLOCK_BYTES = 40, 6, 16 << 20
_R = np.random.default_rng(11)
FLIP, TIMES, FOLD = (_R.integers(0, 1 << 64, n, np.uint64) for n in (BANDS * ROWS, BANDS * ROWS, ROWS))
TIMES, FOLD = TIMES | np.uint64(1), FOLD | np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct XXH64 (seed 42) of a text's shingles, ascending; A-Z are lower-cased, words are
    runs of anything but ASCII blanks; a shorter text is one shingle, also one without words."""
    tokens = (text or "").encode().lower().split()
    data, k = b" ".join(tokens), max(1, min(words, len(tokens)))
    ends = list(accumulate(map(len, tokens), lambda a, n: a + 1 + n)) or [0]
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64))


def bands(found: np.ndarray, width: int = 1024) -> np.ndarray:
    """One key for each band of a set of hashes."""
    low = np.full(FLIP.size, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, found.size, width):
        low = np.minimum(low, ((found[None, a : a + width] ^ FLIP[:, None]) * TIMES[:, None]).min(axis=1))
    low ^= low >> np.uint64(32)
    keys = (low.reshape(BANDS, ROWS) * FOLD).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=np.uint64)


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(a.size, b.size) < least * max(a.size, b.size) - 1e-9:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (both.size - shared) - 1e-9


def linked(sets: list[np.ndarray], least: float) -> list[int]:
    """For each set, the first one of those that links of similarity `least` join it with. A set is
    compared with the members of a group, the latest first, until one links."""
    groups: list[list[int]] = []
    for i, s in enumerate(sets):
        hit = [any(_alike(s, sets[j], least) for j in reversed(g)) for g in groups]
        new = sorted([i, *(j for g, h in zip(groups, hit, strict=True) if h for j in g)])
        groups = [*(g for g, h in zip(groups, hit, strict=True) if not h), new]
    out = [0] * len(sets)
    for g in groups:
        for i in g:
            out[i] = g[0]
    return out


def _keys(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [bands(shingles(t.as_py(), words)) for t in b.column(1)]
            if keys:
                ids = np.repeat(b.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(keys).view(np.int64))], ["id", "key"])

    return run


def _from_pivot(words: int):
    """Rows (component, id, text, pivot's text) -> (component, id, size, apart): the text's bytes and its Jaccard distance from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.zeros(0, np.uint64)
        for b in batches:
            apart, size = [], []
            for t, p in zip(b.column(2), b.column(3), strict=True):
                text, other = t.as_py() or "", p.as_py() or ""
                if other != last:
                    last, pivot = other, shingles(other, words)
                own = shingles(text, words)
                shared = np.intersect1d(own, pivot, assume_unique=True).size
                apart.append(1 - shared / (own.size + pivot.size - shared))
                size.append(len(text.encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(apart, pa.float64())], ["component", "id", "size", "apart"])

    return run


def _links(words: int, least: float):
    """Rows (group, id, text), the rows of a group in sequence -> (a, b) links to the first of each linked group."""

    def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        first = linked(sets, least)
        go = [i for i, f in enumerate(first) if i != f]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in go], pa.int64()), pa.array([ids[first[i]] for i in go], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        for b in batches:
            for g, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if g != group and ids:
                    yield links(ids, sets)
                    ids, sets = [], []
                group = g
                ids.append(i)
                sets.append(shingles(t.as_py(), words))
        if ids:
            yield links(ids, sets)

    return run


def close_links(rows: DataFrame, words: int = 5) -> DataFrame:
    """(a, b): rows (id, text) and the smallest id of those that links of SimHash fingerprints, 4 bits at most apart, join them with."""
    return near_duplicates(rows, words, id_col="id").filter("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))


def band_links(rows: DataFrame, words: int = 5) -> DataFrame:
    """(a, b): rows (id, text) and the smallest id of those that share a band with them."""
    keys = materialise(rows.mapInArrow(_keys(words), "id long, key long"))
    low = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("key", "low")
    return keys.join(low, "key").filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct id of docs that is not null: id_col, component_id, the smallest id that
    links join it with. Two documents link if the Jaccard similarity of their sets of shingles is at
    least `least`; the bands are chosen for 0.8 or more.

    A null text counts as empty, and texts without words are alike. Rows that repeat an id link
    through it; other columns are ignored. An empty table gives an empty result.

    Candidates' connected groups are settled in two steps. Each document is held against its group's
    first one, the pivot, and links with it if they are similar. Jaccard distance is a metric, so a
    document beyond the reach of the pivot can only link with such as lie further from the pivot than
    its own distance less the reach; only these are compared with each other, in blocks of about
    block_bytes of text of which each two meet in a task. A large group of near copies therefore
    costs one comparison a document, and no group is held whole.
    """
    reach = 1 - least + 1e-9
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("id is not null")
    maybe = materialise(connected_components(close_links(rows, words).union(band_links(rows, words))))
    met = rows.join(maybe, "id").select("component", "id", "text")
    pivots = met.filter("id = component").groupBy((F.col("component") + F.lit(0)).alias("component")).agg(F.max(F.coalesce("text", F.lit(""))).alias("pivot"))
    far = materialise(met.join(pivots, "component").mapInArrow(_from_pivot(words), "component long, id long, size long, apart double"))
    # Of a pivot whose id has several texts, one is the pivot and the others are as far from it as they are.
    outside = far.filter(F.col("apart") > reach).groupBy("component").agg(F.min("apart").alias("nearest"))
    pool = far.join(outside, "component").filter(F.col("apart") >= F.col("nearest") - reach).select("component", "id", "size")
    blocks = pool.groupBy("component").agg(F.ceil(F.sum("size") / F.lit(block_bytes)).cast("int").alias("blocks"))
    dealt = pool.join(blocks, "component").select("component", "id", F.greatest("blocks", F.lit(1)).alias("n")).distinct()
    mine, other = F.pmod(F.xxhash64("id"), F.col("n")).cast("int"), F.col("other")
    dealt = dealt.select("component", "id", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    meeting = F.xxhash64("component", F.least("mine", other), F.greatest("mine", other)).alias("meeting")
    together = rows.join(dealt.select("id", meeting), "id").select("meeting", "id", "text").repartition("meeting").sortWithinPartitions("meeting", "id")
    found = together.mapInArrow(_links(words, least), "a long, b long")
    near = far.filter((F.col("apart") <= reach) & (F.col("id") != F.col("component"))).select(F.col("id").alias("a"), F.col("component").alias("b"))
    parts = connected_components(found.union(near))
    return rows.select("id").distinct().join(parts, "id", "left").select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component_id"))
