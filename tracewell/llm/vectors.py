"""Near-duplicate embeddings by product quantisation.

Unit vectors go to coarse inverted lists; of each, the residual from the list's centre is coded by
subspaces. A query probes every list that can hold a vector within the radius (a bound on the border
between two lists' cells), reads asymmetric distances from a table per subspace, and keeps what
those distances and the code's own error cannot rule out; double-precision cosine decides. So both
the probes and the table look-up lose nothing, whatever the sample that the index was fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among_lowest, connected_components, materialise, table
from .simhash import _union

#: Vectors that centres and codebooks are fitted on, at most; subspaces and codes of each; members
#: of a list that are compared in one block.
SAMPLE, PARTS, CODES, BLOCK = 20_000, 8, 64, 4096


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = x[r.permutation(x.shape[0])[: min(k, x.shape[0])]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=centres.shape[0])
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[a : a + 4096], centres).argmin(1) for a in range(0, x.shape[0], 4096)] or [np.zeros(0, int)])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Index:
    """Coarse centres and the subspaces' codebooks."""

    def __init__(self, sample: np.ndarray, lists: int):
        x = _unit(sample).astype(np.float32)
        self.centres = _kmeans(x, lists)
        self.cuts = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        rest = x - self.centres[_nearest(x, self.centres)]
        self.books = [_kmeans(rest[:, a:b], CODES, 6) for a, b in self._parts()]

    def _parts(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True))

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and each code's error."""
        rest = x - self.centres[lists]
        code = np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self._parts(), self.books, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([book[code[:, i]] for i, book in enumerate(self.books)], axis=1)
        return code, np.sqrt(((rest - back) ** 2).sum(1)).astype(np.float32)

    def distances(self, x: np.ndarray, of: int, code: np.ndarray) -> np.ndarray:
        """Asymmetric distances of vectors to the codes of list `of`: a sum of one table entry a subspace."""
        rest = x - self.centres[of]
        out = np.zeros((x.shape[0], code.shape[0]), np.float32)
        for i, ((a, b), book) in enumerate(zip(self._parts(), self.books, strict=True)):
            out += _squared(rest[:, a:b], book)[:, code[:, i]]
        return np.sqrt(out)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own list, and which lists can hold a vector within the radius of it: a
        member of list c lies beyond the plane between c and the own centre."""
        d = _squared(x, self.centres)
        own = d.argmin(1)
        apart = np.sqrt(_squared(self.centres, self.centres))[own]
        return own, d - d.min(1)[:, None] <= 2 * radius * apart + 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _assign(indexes: dict[int, Index], radius: float, kind: str):
    """Classes (space, cls, size, embedding) -> rows by list: the member, and a query a probed list."""

    def spread(b: pa.RecordBatch, index: Index) -> pa.RecordBatch:
        raw = _matrix(b.column(3))
        x = _unit(raw).astype(np.float32)
        own, probe = index.probes(x, radius)
        code, error = index.encode(x, own)
        # Lists before the own one are left out: their members probe this one instead.
        q, c = np.nonzero(probe & (np.arange(probe.shape[1]) >= own[:, None]))
        row, lists = np.r_[np.arange(own.size), q], np.r_[own, c]
        none, vectors = [None] * q.size, [v.tobytes() for v in raw.astype(kind)]
        columns = [
            b.column(0).take(pa.array(row)),
            pa.array(lists.astype(np.int32)),
            pa.array(np.r_[np.zeros(own.size, bool), np.ones(q.size, bool)]),
            pa.array(own[row].astype(np.int32)),
            b.column(1).take(pa.array(row)),
            b.column(2).take(pa.array(row)),
            pa.array([vectors[i] for i in row.tolist()], pa.binary()),
            pa.array([*(v.tobytes() for v in code), *none], pa.binary()),
            pa.array([*error.tolist(), *none], pa.float32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["space", "list", "query", "own", "cls", "size", "vec", "code", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                dims = pa.compute.list_value_length(b.column(3)).to_numpy()
                for d in np.unique(dims).tolist():
                    yield spread(b.take(pa.array(np.flatnonzero(dims == d))), indexes[d])

    return run


ROW = "space string, list int, query boolean, own int, cls long, size long, vec binary, code binary, error float"


class _Block:
    """The members of one block of a list, and what queries have found among them."""

    def __init__(self, indexes: dict[int, Index], of: int, rows: list[pa.RecordBatch], cosine: float, radius: float, kind: str):
        t = pa.Table.from_batches(rows)
        self.of, self.cosine, self.radius, self.kind = of, cosine, radius, kind
        self.cls, self.size = t["cls"].to_numpy(), t["size"].to_numpy()
        self.unit = self._units(t["vec"])
        self.index = indexes[self.unit.shape[1]]
        self.code = np.stack([np.frombuffer(v, np.uint8) for v in t["code"].to_pylist()])
        self.error = t["error"].to_numpy()
        self.n, self.label = np.zeros(self.cls.size, np.int64), np.arange(self.cls.size)

    def _units(self, column) -> np.ndarray:
        return _unit(np.stack([np.frombuffer(v, self.kind) for v in column.to_pylist()]).astype(np.float64))

    def ask(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries -> ids, weights of links and one linked member of those that have any."""
        cls, size, own = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("cls", "size", "own"))
        unit = self._units(b.column(b.schema.get_field_index("vec")))
        far = self.index.distances(unit.astype(np.float32), self.of, self.code) > self.radius + self.error + 1e-3
        i, j = np.nonzero(~far & ((own != self.of)[:, None] | (cls[:, None] < self.cls)))
        hit = np.zeros(i.size, bool)
        for a in range(0, i.size, 1 << 16):
            s = slice(a, a + (1 << 16))
            hit[s] = np.einsum("ij,ij->i", unit[i[s]], self.unit[j[s]]) >= self.cosine
        i, j = i[hit], j[hit]
        np.add.at(self.n, j, size[i])
        links = np.zeros(cls.size, np.int64)
        np.add.at(links, i, self.size[j])
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if i.size else i
        lead = j[first][np.cumsum(np.r_[True, i[1:] != i[:-1]]) - 1] if i.size else j
        a, c = self.label[lead], self.label[j]
        self.label = _union(self.label, a[a != c], c[a != c])
        return cls[i[first]], links[i[first]], self.cls[j[first]]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        go = (self.n > 0) | (self.label != np.arange(self.label.size))
        return self.cls[go], self.n[go], self.cls[self.label][go]


def _compare(indexes: dict[int, Index], cosine: float, radius: float, kind: str):
    """Rows of blocks in sequence, members before queries -> (cls, n, other): link weights and links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, key = None, [], None

        def told(x) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["cls", "n", "other"])

        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))  # space, list, block, query
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                here = keys[a][:3]
                if here != key:
                    if block is not None:
                        yield told(block.found())
                    block, members, key = None, [], here
                if not keys[a][3]:
                    members.append(b.slice(a, z - a))
                elif members or block is not None:
                    if block is None:
                        block, members = _Block(indexes, here[1], members, cosine, radius, kind), []
                    for s in range(a, z, 256):
                        yield told(block.ask(b.slice(s, min(256, z - s))))
        if block is not None:
            yield told(block.found())

    return run


def _label_text(label: Column, kind: T.DataType) -> Column:
    """A text that is equal for equal labels of any type, and only for those; null for null."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        label = F.when(label == 0, F.lit(0.0).cast(kind)).otherwise(label)  # -0.0 equals 0.0
    if isinstance(kind, T.BinaryType):
        return F.hex(label)
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.when(label.isNotNull(), F.to_json(F.struct(label)))
    return label.cast("string")


def _fit_index(classes: DataFrame, dim: int, n: int, sample: int, lists: int) -> Index:
    """An index on the n vectors of length dim with the smallest hashes, at most `sample` of them."""
    mine, h = classes.filter(F.size("v") == dim), F.xxhash64("v").alias("h")
    low = mine.select(h).filter(among_lowest(F.col("h"), F.lit(n), sample))
    end = low.orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    drawn = mine.filter(F.xxhash64("v") <= end).select("v", h, "space").orderBy("h", "space").limit(sample)
    fitted = drawn.select("v").toArrow()["v"].combine_chunks()
    x = _matrix(fitted.combine_chunks() if isinstance(fitted, pa.ChunkedArray) else fitted)
    return Index(x, min(lists, max(8, x.shape[0] // 8)))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, lists: int | None = None, block: int = BLOCK, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Only vectors of equal, non-null labels link; labels are compared in their own type. A vector
    that is null, empty or zero, holds null or non-finite components or has a null id links with
    nothing: no links, its own id as component. Vectors of different lengths never link; each length
    has an index of its own. Equal vectors of a label become one class with a weight, so their links
    are counted, not listed. Rows that repeat an id are vectors of their own, each with the links and
    component of its vector. Other columns are ignored, whatever their names. The indexes are fitted
    on at most `sample` vectors in all (one of each length at least), chosen by hash; every vector
    is in one. An empty table gives an empty result.
    """
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    schema = vectors.schema
    single = isinstance(getattr(schema[vec_col].dataType, "elementType", None), T.FloatType)
    v = F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>").alias("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), _label_text(F.col(f"`{label_col}`"), schema[label_col].dataType).alias("label"), v)
    ok = "id IS NOT NULL AND label IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    # A space holds the vectors of one label and one length.
    rows = rows.select("id", F.expr(f"if(coalesce({ok}, false), concat(size(v), ':', label), NULL)").alias("space"), "v")
    groups = rows.filter("space IS NOT NULL").groupBy("space", "v").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    classes = materialise(groups.withColumn("cls", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}
    named = lambda df: df.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce("kept", F.lit(False)).alias("kept"))
    if not sizes:
        return named(rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")))
    total = sum(sizes.values())
    indexes = {d: _fit_index(classes, d, n, max(1, sample * n // total), lists or max(8, int(np.sqrt(n) / 16))) for d, n in sizes.items()}
    kind = "f4" if single else "f8"
    spread = classes.select("space", "cls", "size", "v").mapInArrow(_assign(indexes, radius, kind), ROW)
    spread = materialise(spread)
    blocks = spread.filter("not query").groupBy("space", "list").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    salt = F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))
    dealt = spread.join(blocks, ["space", "list"]).withColumn("block", F.explode(salt))
    dealt = dealt.select("space", "list", "block", "query", "own", "cls", "size", "vec", "code", "error")
    dealt = dealt.repartition("space", "list", "block").sortWithinPartitions("space", "list", "block", "query")
    found = materialise(dealt.mapInArrow(_compare(indexes, cosine, radius, kind), "cls long, n long, other long"))
    parts = connected_components(found.select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cls")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "cls", "left").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    known = known.select("space", "v", "rep", "component", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"))
    low = known.groupBy("component").agg(F.min("rep").alias("c"))
    out = rows.join(known.join(low, "component").select("space", "v", "n", "c"), ["space", "v"], "left")
    out = out.select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return named(out.withColumn("kept", F.col("id") == F.col("component_id")))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
