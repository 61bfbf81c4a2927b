"""Fill-in-the-middle rearrangement of texts, in DuckDB SQL inside mapInArrow.

Each batch is registered with a DuckDB connection of its task, one statement cuts, orders and joins
the texts of a slice, and Arrow goes back: no Python code runs per row. What a row becomes depends
on its id and text alone, so a repeated task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Text bytes that one statement takes at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANK = r"\x20\x09-\x0D"
TOKEN = rf"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+"

CUT = """
WITH hashed AS MATERIALIZED (
  SELECT id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{token}') AS token, sha256(concat('{seed}:', id)) AS h FROM batch
), drawn AS (
  SELECT id, text, token, CAST(len(token) AS BIGINT) AS n,
    [CAST('0x' || substr(h, p, 8) AS BIGINT) FOR p IN [1, 9, 17, 25]] AS h FROM hashed
), placed AS (
  SELECT id, text, token, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {rate} THEN 'plain'
      WHEN h[4] % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT id, text, n, form,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(token, 1, a), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(token, a + 1, b), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(token, b + 1, n), '') END AS suffix FROM placed
)
SELECT id, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
  CASE form WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
    WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle) ELSE text END AS output FROM parts
"""

RESTORE = """
SELECT {columns}, CASE form WHEN 'psm' THEN concat(part[2], part[4], part[3]) WHEN 'spm' THEN concat(part[3], part[4], part[2]) ELSE output END AS text
FROM (SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(output, '<[PSM]>') END AS part FROM ({source}))
"""

DIGEST = "SELECT id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM ({source})"


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of the column's text."""
    if batch.num_rows == 0:
        return
    size = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    at = 0
    while at < batch.num_rows:
        end = int(size.searchsorted((size[at - 1] if at else 0) + most, "right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def _by_sql(sql: str, schema: pa.Schema, column: int, slice_bytes: int):
    """Batches -> the statement's rows over each slice of them, which it knows as `batch`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for whole in batches:
                for part in _slices(whole, column, slice_bytes):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                    con.unregister("batch")

    return run


_HEAD = [("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_DDL = "id long, n long, form string, prefix_chars long, middle_chars long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _cut(seed: int, rate: int, spm: int) -> str:
    return CUT.format(token=TOKEN, seed=int(seed), rate=int(rate), spm=int(spm))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of docs: id_col, n (tokens), form, prefix_chars, middle_chars, output.

    A text is cut into prefix, middle and suffix at two tokens that its id draws. form is psm
    (`<P>`prefix`<S>`suffix`<M>`middle), spm (`<S>`suffix`<P>`prefix`<M>`middle) or plain (the text
    as it is, both lengths null); `rate` of 100 texts are cut, `spm` of 100 of those are spm. Empty
    texts and texts that contain a mark stay plain.

    A null text counts as empty, a null id draws like an empty one, rows that repeat an id draw
    alike, and a text of blanks is one token. Other columns are ignored, whatever their names. An
    empty table gives an empty result. Texts are taken in slices of slice_bytes; one that is longer
    is held with its tokens by one task. Nothing is shuffled.
    """
    run = _by_sql(_cut(seed, rate, spm), pa.schema([*_HEAD, ("output", pa.string())]), 1, slice_bytes)
    return _texts(docs, id_col, text_col).mapInArrow(run, f"{_DDL}, output string").withColumnRenamed("id", id_col)


def restore(rows: DataFrame, id_col: str = "doc_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """id_col and text of fill_in_middle's rows, rebuilt from output and form alone; a null output or form gives a null text."""
    sql = RESTORE.format(columns="id", source="SELECT * FROM batch")
    picked = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), "form", "output")
    run = _by_sql(sql, pa.schema([("id", pa.int64()), ("text", pa.string())]), 2, slice_bytes)
    return picked.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def fill_in_middle_digests(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """fill_in_middle with output_sha256 and restored_sha256 (of restore's text) instead of the output: texts reach
    Python once and do not come back. Nulls, repeats and clashes as there."""
    sql = DIGEST.format(source=RESTORE.format(columns="id, n, form, prefix_chars, middle_chars, output", source=_cut(seed, rate, spm)))
    run = _by_sql(sql, pa.schema([*_HEAD, ("output_sha256", pa.string()), ("restored_sha256", pa.string())]), 1, slice_bytes)
    return _texts(docs, id_col, text_col).mapInArrow(run, f"{_DDL}, output_sha256 string, restored_sha256 string").withColumnRenamed("id", id_col)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, sf_dir, "documents"))


#: The tokens' places instead of the tokens themselves, cut by places in the text.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
k AS (SELECT doc_id, text, [length(x) FOR x IN regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')] AS size,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, CAST(len(size) AS BIGINT) AS n, coalesce(list_sum(size[1:least(h1 % (len(size) + 1), h2 % (len(size) + 1))]), 0) AS p,
  coalesce(list_sum(size[1:greatest(h1 % (len(size) + 1), h2 % (len(size) + 1))]), 0) AS q,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (SELECT doc_id, text, n, form, p, q, left(text, CAST(p AS BIGINT)) AS prefix, substr(text, CAST(p AS BIGINT) + 1, CAST(q - p AS BIGINT)) AS middle, substr(text, CAST(q AS BIGINT) + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM s
"""
