"""Exact de-duplication by content-defined chunk recipes, in DataFrame functions only.

Each text is white-space normalised and cut where its own content says so; chunks are
de-duplicated once, which verifies that a 64-bit hash names one chunk only; then documents are
compared by their ordered lists of chunk identifiers, so a long text moves at most once, in pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table


def _residues(modulus: int, residue: int) -> str:
    """A character class of the Latin-1 code points with the given residue (a bit table in the matcher)."""
    return "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x100) if c % modulus == residue) + "]"


def chunk_pattern(least: int = 256, most: int = 4096) -> str:
    """A chunk ends at a blank whose neighbours fall into fixed residue classes (about one blank in
    32), after `least` characters at the earliest; a text without such a place,
    as in scripts beyond Latin-1, is cut every `most`."""
    edge = f"(?<={_residues(4, 1)}\\x20)(?={_residues(8, 3)})"
    return f"(?s).{{{least},{most - 1}}}?{edge}|.{{1,{most}}}"


def normalised(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """keep and t: the text with each run of blanks as one space. Most texts need byte replacement
    only; the matcher sees those that still hold two spaces in a row."""
    spaced = F.coalesce(text.cast("string"), F.lit(""))
    for blank in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    single = F.when(F.col("t").contains("  "), F.regexp_replace("t", " {2,}", " ")).otherwise(F.col("t"))
    ahead = docs.select(*keep, spaced.alias("t"))
    return ahead.select(*ahead.columns[:-1], single.alias("t"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, n_chunks.

    Null texts count as empty; all empty texts form one group. Rows that repeat an id share its
    fate, group_size counts rows. A null id never becomes keep_id unless its whole group has none.
    Other columns of docs are ignored, whatever their names. hash_bits under 64 is for tests: it
    makes chunk hashes collide, and the exact path for collisions answers.
    """
    h = lambda c: F.shiftright(F.xxhash64(c), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(c)
    cut = normalised(docs, F.col(text_col), F.col(id_col).cast("long").alias("id")).select(
        "id", "t", F.regexp_extract_all("t", F.lit(chunk_pattern()), F.lit(0)).alias("chunks")
    )
    recipes = materialise(
        cut.select("id", F.sha2(F.encode("t", "UTF-8"), 256).alias("sha"), F.transform("chunks", h).alias("recipe"))
    )
    # Identical chunks merge before they move; a hash left with two texts is a collision.
    chunks = cut.select(F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.lit(1).alias("one"))
    clash = materialise(
        chunks.groupBy(h(F.col("chunk")).alias("h")).agg(F.count("*").alias("n")).filter("n > 1").select("h")
    )
    if not clash.isEmpty():
        recipes = _verified(cut, clash, h)
    # Written, so that the join deals both sides anew and AQE may split the rows of a hot recipe.
    groups = materialise(
        recipes.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"), F.max(F.size("recipe")).alias("n_chunks"))
    )
    return recipes.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_chunks",
    )


def _verified(cut: DataFrame, clash: DataFrame, h) -> DataFrame:
    """Recipes whose colliding hashes are replaced by the colliding chunk's own SHA-256 bits.

    Only documents that hold such a chunk differ from the plain recipe: every identifier that is
    not in `clash` stays as it was, the others get the text itself appended to the comparison.
    """
    cut = materialise(cut.withColumn("row", F.monotonically_increasing_id()))
    pieces = cut.select("row", F.posexplode("chunks").alias("pos", "chunk"))
    pieces = pieces.withColumn("h", h(F.col("chunk")))
    marked = pieces.join(clash.withColumn("clashes", F.lit(True)), "h", "left")
    name = F.struct("pos", "h", F.when(F.col("clashes"), F.col("chunk")).alias("chunk"))
    lists = marked.groupBy("row").agg(F.sort_array(F.collect_list(name)).alias("recipe"))
    none = F.array().cast(lists.schema["recipe"].dataType)
    return cut.join(lists, "row", "left").select(
        "id", F.sha2(F.encode("t", "UTF-8"), 256).alias("sha"), F.coalesce("recipe", none).alias("recipe")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
