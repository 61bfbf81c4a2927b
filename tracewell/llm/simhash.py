"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within r bits agree on at least (blocks - r) of their bit blocks, so every choice of
that many blocks is a table of buckets, and two linked fingerprints share a bucket in one of them.
In a bucket, fingerprints lie vertically: 64 of them form a block of 64 bit planes, a query updates
64 distances at once by carry-save counters, and a block is left once all its lanes are too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import connected_components, materialise, table

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
LANES = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: Fingerprints of a bucket beyond which it is dealt anew by more of its bits.
MOST = 50_000


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit words h have each bit: full adders over thirds, carries one place up."""
    out, cur, weight = np.zeros(64, np.int64), h, 1
    while cur.size:
        carries = []
        while cur.size >= 3:
            m = cur.size // 3
            a, b, c = cur[:m], cur[m : 2 * m], cur[2 * m : 3 * m]
            x = a ^ b
            carries.append((a & b) | (c & x))
            cur = np.concatenate([x ^ c, cur[3 * m :]])
        for w in cur:
            out += ((w & LANES) != 0) * weight
        cur, weight = np.concatenate(carries) if carries else cur[:0], 2 * weight
    return out


def fingerprint(text: str | None, words: int = 4) -> int:
    """The fingerprint of a text as an unsigned integer; see fingerprints()."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    data, k = b" ".join(tokens), min(words, len(tokens))
    ends = list(accumulate(map(len, tokens), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    h = np.array([xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64)
    return int(LANES[bit_counts(h) * 2 > h.size].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id (long), fp (long, the 64 bits).

    A-Z are lower-cased, words are runs of anything but ASCII blanks; every shingle of `words` words
    votes with its XXH64 (seed 42), repeats included; a shorter text is one shingle; null, empty and
    blank texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _masks(bits: list[int], parts: int, same: int) -> list[int]:
    """Masks over every choice of `same` of `parts` runs of the given bit places."""
    runs = np.array_split(np.array(bits), parts)
    return [sum(1 << int(i) for r in chosen for i in runs[r]) for chosen in combinations(range(parts), same)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _planes(fp: np.ndarray) -> np.ndarray:
    """(blocks, 64) bit planes of fingerprints whose number is a multiple of 64."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def near(planes: np.ndarray, block: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each pair of a block and a query, the lanes out of `lanes` within the radius (under 8).

    Counters of three bits and one that sticks hold 64 distances of a pair; every eight planes, the
    pairs whose lanes are all beyond the radius go.
    """
    out, left = np.zeros(block.size, np.uint64), np.arange(block.size)
    c0, c1, c2, over = (np.zeros(block.size, np.uint64) for _ in range(4))
    far = np.zeros(block.size, np.uint64)
    for i in range(64):
        d = planes[block, i] ^ (ALL * ((query >> np.uint64(i)) & np.uint64(1)))
        carry = c0 & d
        c0 = c0 ^ d
        up = c1 & carry
        c1 = c1 ^ carry
        over = over | (c2 & up)
        c2 = c2 ^ up
        if i % 8 == 7:
            far = over.copy()
            for n in range(radius + 1, 8):
                far |= (c0 if n & 1 else ~c0) & (c1 if n & 2 else ~c1) & (c2 if n & 4 else ~c2)
            go = (lanes & ~far) != 0
            if not go.all():
                left, block, query, lanes, far, c0, c1, c2, over = (x[go] for x in (left, block, query, lanes, far, c0, c1, c2, over))
                if not left.size:
                    break
    out[left] = lanes & ~far
    return out


def local_links(key: np.ndarray, fp: np.ndarray, radius: int, chunk: int = 1 << 16) -> np.ndarray:
    """For each row (rows of a key stand together), the first row of its linked group within the key."""
    n = key.size
    label = np.arange(n)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, n])
    first, size = first[size > 1], size[size > 1]
    if not first.size:
        return label
    blocks = -(-size // 64)
    base = np.r_[0, np.cumsum(blocks)]
    row = np.concatenate([np.arange(s, s + m) for s, m in zip(first, size, strict=True)])
    group = np.repeat(np.arange(size.size), size)
    offset = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size)
    slot = base[group] * 64 + offset
    lane_fp, lane_row = np.zeros(base[-1] * 64, np.uint64), np.full(base[-1] * 64, -1)
    lane_fp[slot], lane_row[slot] = fp[row], row
    planes = _planes(lane_fp)
    used = np.zeros(base[-1], np.uint64)
    np.bitwise_or.at(used, slot // 64, LANES[slot % 64])
    span = base[group + 1] - slot // 64  # blocks from the query's own to its key's last
    at = 0
    while at < row.size:
        to = max(at + 1, int(np.searchsorted(np.cumsum(span[at : at + chunk]), chunk, "right")) + at)
        reps = span[at:to]
        q = np.repeat(np.arange(at, to), reps)
        step = np.arange(q.size) - np.repeat(np.cumsum(reps) - reps, reps)
        block = slot[q] // 64 + step
        lanes = used[block]
        lane = (slot[q] % 64).astype(np.uint64)
        later = np.where(lane == 63, np.uint64(0), ALL << np.minimum(lane + np.uint64(1), np.uint64(63)))
        lanes = np.where(step == 0, lanes & later, lanes)
        hits = near(planes, block, fp[row[q]], lanes, radius)
        got = np.flatnonzero(hits)
        for part in np.array_split(got, max(1, got.size // 16384)):
            which, bit = np.nonzero(np.unpackbits(hits[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = label[row[q[part[which]]]], label[lane_row[block[part[which]] * 64 + bit]]
            label = _union(label, a[a != b], b[a != b])
        at = to
    return label


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the groups a[i] and b[i]; each group is named by its first row."""
    if not a.size:
        return label
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for x, y in set(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    old = np.array(list(root))
    to = np.arange(label.size)
    to[old] = [find(x) for x in root]
    return to[label]


def _bucket_edges(radius: int, rows: int = 1 << 18):
    """Rows (key, fp, rep), the rows of a key in sequence -> (a, b) links to the smallest rep of each linked group."""

    def edges(key, fp, rep) -> pa.RecordBatch:
        label = local_links(key, fp, radius)
        low = np.full(label.size, np.iinfo(np.int64).max)
        np.minimum.at(low, label, rep)
        go = low[label] != rep
        return pa.RecordBatch.from_arrays([pa.array(rep[go]), pa.array(low[label][go])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()))
            if sum(x[0].size for x in held) >= rows:
                key, fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
                if cut:
                    yield edges(key[:cut], fp[:cut], rep[:cut])
                held = [(key[cut:], fp[cut:], rep[cut:])]
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def hamming_components(fps: DataFrame, radius: int = 4, blocks: int = 6, most: int = MOST) -> DataFrame:
    """(id, fp) rows -> the same rows with component_id: the smallest id reachable by links of at
    most `radius` (under 8) differing bits.

    Equal fingerprints become one node first, so copies never meet as pairs. A bucket of over `most`
    fingerprints is dealt anew: of its other bits, cut into radius + 1 runs, one run must be equal,
    which makes smaller buckets and loses no link; what is still larger is cut into blocks of which
    each two meet, so no bucket is held whole. A null id never names a component; a null
    fingerprint links with nothing and has its own id as component.
    """
    nodes = materialise(fps.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    masks = _masks(list(range(64)), blocks, blocks - radius)
    # A bucket's name holds its table and its bits; two buckets with one name only add comparisons.
    table_rows = F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits")) for t, m in enumerate(masks)]))
    rows = nodes.filter("rep is not null").select("fp", "rep", table_rows)
    hot = rows.groupBy("t", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("t", "bits", F.lit(True).alias("hot"))
    rest = [[i for i in range(64) if not m >> i & 1] for m in masks]
    finer = F.array(*[F.array(*[F.lit(_signed(x)).cast("long") for x in _masks(r, radius + 1, 1)]) for r in rest])
    none = F.array(F.lit(0).cast("long"))
    dealt = rows.join(hot, ["t", "bits"], "left").select(
        "t", "bits", "hot", "fp", "rep", F.posexplode(F.when(F.col("hot"), finer[F.col("t")]).otherwise(none)).alias("s", "m")
    )
    key = F.xxhash64("t", "bits", "s", F.col("fp").bitwiseAND(F.col("m"))).alias("key")
    dealt = dealt.select(key, "hot", "fp", "rep")
    # Near copies agree on most bits, so a bucket of them stays large: there, blocks meet two by two.
    large = dealt.filter("hot").groupBy("key").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("n")).filter("n > 1").select((F.col("key") + F.lit(0)).alias("key"), "n")
    spread = dealt.join(large, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    spread = spread.select("key", "n", "fp", "rep", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    meeting = F.when(F.col("n") > 1, F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("key")).alias("key")
    buckets = spread.select(meeting, "fp", "rep").repartition("key").sortWithinPartitions("key", "fp")
    edges = buckets.mapInArrow(_bucket_edges(radius), "a long, b long")
    parts = connected_components(edges)
    named = nodes.join(parts, nodes["rep"] == parts["id"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(named, "fp", "left").select(
        "id", "fp", F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id.

    Rows that repeat an id are rows of one document if their texts agree, and link through it if not;
    other columns are ignored. A row with a null id takes part under the ids of its fingerprint only.
    """
    fps = materialise(fingerprints(docs, words, id_col, text_col))
    return hamming_components(fps, radius, most=most).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
