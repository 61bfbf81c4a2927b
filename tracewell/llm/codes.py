"""Compression of vectors to short codes: one codebook a part position, fitted by Lloyd's rounds.

Components become integers, so equal parts are equal exactly: a round runs over the distinct parts
of each position, weighted by how often they occur, and codes and errors are joined back to the
vectors at the end. All sums and distances are exact integers; what the driver holds are the
codebooks alone (parts x entries x width numbers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of which a task holds the distances to a codebook at once.
BLOCK = 4096

#: (length of the vectors, part position) -> the entries, a row each.
Books = dict[tuple[int, int], np.ndarray]


@dataclass
class Compressed:
    """codes: vec_id, label, dim, code, error; books: dim, part, entry, components; sha256: by length, of all entries."""

    codes: DataFrame
    books: DataFrame
    sha256: dict[int, str]


def _cut(dim: Column | int, p: int, parts: int) -> Column | int:
    """Where part p begins; a length that parts do not divide gives parts of about equal width."""
    return F.floor(dim * p / parts).cast("int") if isinstance(dim, Column) else dim * p // parts


def _whole(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dim and the integer components of vectors without null or non-finite ones."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fit = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # Squared distances of a part, summed, stay within a long.
    most = F.floor(F.lit(2.0**30) / F.sqrt(F.greatest(F.size(x), F.lit(1))))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, most), -most)).cast("int"))
    kept = vectors.filter(fit).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), whole.alias("x"))
    return kept.withColumn("dim", F.size("x"))


def _parts(kept: DataFrame, parts: int, *columns: str) -> DataFrame:
    """columns, dim, part and the part's components x, a row per vector and part."""
    cut = [_cut(F.col("dim"), p, parts) for p in range(parts + 1)]
    pieces = F.array(*[F.slice("x", cut[p] + 1, cut[p + 1] - cut[p]) for p in range(parts)])
    return kept.select(*columns, "dim", F.posexplode(pieces).alias("part", "x"))


def _first(kept: DataFrame, entries: int, parts: int) -> Books:
    """The parts of the vectors with the smallest ids, by length. Equal ids go by their components."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    found = kept.withColumn("salt", F.spark_partition_id() % 64)
    for keys in (["dim", "salt"], ["dim"]):
        found = found.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= entries)
    rows: dict[int, list[tuple[int, list[int]]]] = {}
    for r in found.select("dim", "n", "x").collect():
        rows.setdefault(r.dim, []).append((r.n, r.x))
    books = {}
    for dim, own in rows.items():
        x = np.array([v for _, v in sorted(own)], np.int64).reshape(len(own), dim)
        books |= {(dim, p): x[:, _cut(dim, p, parts) : _cut(dim, p + 1, parts)] for p in range(parts)}
    return books


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first nearest entry and its squared distance, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if x.shape[1] * 4 * most * most < 1 << 53:  # doubles hold every term
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    else:
        d = np.zeros((x.shape[0], book.shape[0]), np.int64)
        for i in range(x.shape[1]):
            d += (x[:, i, None] - book[:, i]) ** 2
    code = d.argmin(1)
    return code, d[np.arange(code.size), code].astype(np.int64)


def _by_book(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch, np.ndarray]]:
    """A batch (dim, part, x, ...) by length and part, in blocks, with the components as a matrix."""
    keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
    for dim, part in np.unique(keys, axis=0).tolist():
        rows = np.flatnonzero((keys == (dim, part)).all(axis=1))
        for a in range(0, rows.size, BLOCK):
            own = batch.take(pa.array(rows[a : a + BLOCK]))
            yield (dim, part), own, own.column(2).flatten().to_numpy().astype(np.int64).reshape(own.num_rows, -1)


def _moves(books: Books):
    """Distinct parts (dim, part, x, weight) -> a task's weighted sums by entry: dim, part, entry, at, total, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(b.shape, object) for k, b in books.items()}
        count = {k: np.zeros(b.shape[0], object) for k, b in books.items()}
        for batch in batches:
            for key, own, x in _by_book(batch):
                code, _ = nearest(x, books[key])
                weight = own.column(3).to_numpy()
                order = np.argsort(code, kind="stable")
                head = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
                kind = np.int64 if int(weight.max()) * (int(np.abs(x).max(initial=0)) + 1) * x.shape[0] < 1 << 62 else object
                weight = weight[order].astype(kind)
                used = code[order][head]
                sums[key][used] += np.add.reduceat(weight[:, None] * x[order].astype(kind), head, axis=0).astype(object)
                count[key][used] += np.add.reduceat(weight, head).astype(object)
        for (dim, part), n in count.items():
            used = np.flatnonzero(n > 0)
            # One more place, so that parts of no width count too.
            total = np.c_[sums[dim, part][used], np.zeros(used.size, object)]
            entry, at = np.repeat(used, total.shape[1]), np.tile(np.arange(total.shape[1]), used.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(entry.size, dim), pa.int32()), pa.array(np.full(entry.size, part), pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()),
                 pa.array(total.ravel().tolist(), pa.decimal128(38, 0)), pa.array(np.repeat(n[used], total.shape[1]).tolist(), pa.decimal128(38, 0))],
                ["dim", "part", "entry", "at", "total", "n"],
            )

    return run


def _codes(books: Books):
    """Distinct parts (dim, part, x, ...) -> dim, part, x, code, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own, x in _by_book(batch):
                code, error = nearest(x, books[key])
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(code, pa.int64()), pa.array(error)], ["dim", "part", "x", "code", "error"])

    return run


def _round(distinct: DataFrame, books: Books) -> Books:
    moved = distinct.mapInArrow(_moves(books), "dim int, part int, entry int, at int, total decimal(38,0), n decimal(38,0)")
    books = {k: b.copy() for k, b in books.items()}
    for r in moved.groupBy("dim", "part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        book = books[r.dim, r.part]
        if r.at < book.shape[1]:
            book[r.entry, r.at] = int(r.total) // int(r.n)
    return books


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> Compressed:
    """Codes of the vectors and the codebooks.

    Each component x becomes floor(scale * x), and a vector `parts` consecutive parts of equal
    width. A position's codebook starts as that part of the `entries` vectors with the smallest ids;
    in each round every part goes to its nearest entry (squared distance, ties to the lower one) and
    an entry becomes the floor of its parts' mean, or stays where it has none. code holds an entry in two
    hexadecimal digits (entries up to 256) for each part; error is the sum of the parts' squared distances.

    Vectors that are null or hold null or non-finite components give no row. Vectors of another
    length have codebooks of their own, and a length that `parts` does not divide gives parts that
    differ in width by one; vectors without components have code 00... and error 0. Scaled components beyond
    2 ** 30 / sqrt(length) count as that, since an error could not be held in a long otherwise. Rows that repeat an id
    stay rows; a null id counts as the largest. Other columns are ignored, whatever their names. An
    empty table gives empty results.
    """
    if not 1 <= entries <= 256 or not 1 <= parts <= 7:
        raise ValueError("entries must be 1 to 256, parts 1 to 7")
    spark = vectors.sparkSession
    kept = materialise(_whole(vectors, scale, id_col, vector_col, label_col))
    distinct = materialise(_parts(kept, parts).groupBy("dim", "part", "x").agg(F.count("*").alias("weight")))
    books = _first(kept, entries, parts)
    for _ in range(rounds):
        books = _round(distinct, books)
    coded = distinct.mapInArrow(_codes(books), "dim int, part int, x array<int>, code long, error long")
    mine = _parts(kept.withColumn("row", F.monotonically_increasing_id()), parts, "row", "vec_id", "label")
    # A part that very many vectors share is a hot key of this join: both sides are dealt anew, so AQE may split it.
    met = mine.join(coded, ["dim", "part", "x"]).groupBy("row", "vec_id", "label", "dim")
    shifted = F.col("code") * F.pow(F.lit(256), F.lit(parts - 1) - F.col("part")).cast("long")
    codes = met.agg(F.sum(shifted).alias("c"), F.sum("error").alias("error"))
    codes = materialise(codes.select("vec_id", "label", "dim", F.lpad(F.lower(F.hex("c")), 2 * parts, "0").alias("code"), "error"))
    rows = [(dim, p, e, v) for (dim, p), book in sorted(books.items()) for e, v in enumerate(book.tolist())]
    numbers: dict[int, list[str]] = {}
    for dim, _, _, v in rows:
        numbers.setdefault(dim, []).extend(map(str, v))
    sha = {dim: hashlib.sha256(",".join(v).encode()).hexdigest() for dim, v in numbers.items()}
    return Compressed(codes, spark.createDataFrame(rows, "dim int, part int, entry int, components array<long>"), sha)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes and label_error, the error summed over equal labels, nulls together."""
    sums = codes.groupBy(F.col("label").alias("its")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("its"))).drop("its")


def decompress(made: Compressed, scale: int = SCALE) -> DataFrame:
    """vec_id, dim and the vector that each code stands for. The codebooks are parts x entries rows a length."""
    book = made.books.select("dim", "part", F.lower(F.lpad(F.hex("entry"), 2, "0")).alias("digits"), "components")
    row = made.codes.withColumn("row", F.monotonically_increasing_id())
    n = (F.length("code") / 2).cast("int")
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.substr(F.col("code"), 2 * p + 1, F.lit(2)))
    each = row.select("row", "vec_id", "dim", F.posexplode(digits).alias("part", "digits")).join(book, ["dim", "part", "digits"])
    pieces = F.array_sort(F.collect_list(F.struct("part", "components")))
    flat = F.flatten(F.transform(pieces, lambda s: s["components"]))
    return each.groupBy("row", "vec_id", "dim").agg(F.transform(flat, lambda v: v / F.lit(float(scale))).alias("vector")).drop("row")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compress(table(spark, sf_dir, "embeddings"))
    sha = F.create_map(*[F.lit(x) for kv in made.sha256.items() for x in kv])[F.col("dim")] if made.sha256 else F.lit(None).cast("string")
    return with_label_errors(made.codes).select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


def _oracle(rounds: int) -> str:
    near = """a{r} AS MATERIALIZED (SELECT vec_id, pos, any_value(label) AS label, any_value(p.v) AS v, min({{'d': list_dot_product(p.f, p.f) - 2 * list_dot_product(p.f, b.f) + list_dot_product(b.f, b.f), 'k': b.entry}}) AS m
  FROM parts p JOIN b{r} b USING (pos) GROUP BY vec_id, pos)"""
    move = """b{n} AS MATERIALIZED (SELECT pos, entry, list(x ORDER BY i) AS f FROM (
    SELECT pos, m.k AS entry, i, CAST(floor(sum(v[i]) / count(*)) AS DOUBLE) AS x FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS i) GROUP BY pos, m.k, i) GROUP BY pos, entry
  UNION ALL SELECT pos, entry, f FROM b{r} b WHERE NOT EXISTS (SELECT 1 FROM a{r} a WHERE a.pos = b.pos AND a.m.k = b.entry))"""
    steps = [near.format(r=0)] + [s for r in range(rounds) for s in (move.format(r=r, n=r + 1), near.format(r=r + 1))]
    return f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, pos, v, CAST(v AS DOUBLE[]) AS f FROM (
  SELECT vec_id, label, pos, x[pos * (len(x) // 4) + 1:(pos + 1) * (len(x) // 4)] AS v FROM kept, (SELECT unnest(range(4)) AS pos))),
b0 AS MATERIALIZED (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, f FROM parts QUALIFY entry < 256),
{", ".join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(m.k)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM (SELECT pos, entry, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, sha
"""


ORACLE = _oracle(ROUNDS)
