"""The text of a log document that says why something failed, found by a walk over its objects as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where reasons are looked for (of the first three every text counts), words of keys that name one, endings of
#: keys that only identify one, texts that say nothing, objects that are entered below a root, characters that are kept.
ROOTS, ERROR_ROOTS = ["error", "err", "exception", "context", "detail"], 3
KEY_WORDS = "error|err|exception|reason|cause|fault|failure"
IDENTIFIERS = "id|ids|code|status|count|url|name"
EMPTY = ["", "undefined", "null", "[object Object]", "{}"]
DEPTH, LONGEST = 4, 300


def _names_failure(key: Column) -> Column:
    k = F.lower(key)
    return k.rlike(rf"^(?:{KEY_WORDS})") | k.rlike(rf"(?:^|[^a-z0-9])(?:{KEY_WORDS})(?:[^a-z0-9]|$)")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _first_line(text: Column) -> Column:
    return F.substring(_trim(F.regexp_extract(_trim(text), r"^[^\r\n]*", 0)), 1, LONGEST)


def _rank(leaf: Column) -> Column:
    """Stack traces come last, messages first, then what a key calls an error."""
    return F.when(F.contains(leaf, F.lit("stack")), 3).when(leaf.rlike("(?:message|msg)$|^(?:reason|description)$"), 0).when(_names_failure(leaf), 1).otherwise(2)


def with_detail(rows: DataFrame, body: str, message: Column | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """rows with detail and detail_path: of the texts under the roots of a JSON document the most message-like, nearest to its root,
    and its dotted path; both null where there is none.

    fields are dotted paths that win where they hold a usable text, in that order. A text is usable if it says something and is not
    the message itself; its first line counts, 300 characters of it. Texts of context and detail count below a key that names a
    failure. Of equals the root named first and then the key first by name wins. A body that is null or no JSON has none.
    The walk goes level by level over arrays of the row itself: nothing is shuffled."""
    c = F.col
    said = _trim(F.coalesce(message, F.lit(""))) if message is not None else F.lit("")
    usable = lambda t: ~_trim(t).isin(*EMPTY) & (F.lit(message is None) | (_trim(t) != said))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    top = [F.struct(F.lit(i).alias("root"), F.lit(r).alias("path"), F.lit(r).alias("leaf"), F.lit(i < ERROR_ROOTS).alias("bad"), F.variant_get("_v", f"$.{r}", "variant").alias("v")) for i, r in enumerate(ROOTS)]
    out = rows.withColumn("_v", F.try_parse_json(body)).withColumn("_at", F.filter(F.array(*top), lambda x: x["v"].isNotNull()))
    found = F.array().cast("array<struct<rank: int, depth: int, root: int, nth: int, path: string, text: string>>")
    out = out.withColumn("_found", found)
    for depth in range(DEPTH + 1):
        texts = F.transform(F.filter("_at", lambda x: x["bad"] & (kind(x["v"]) == "STRING")), lambda x, i: F.struct(x["root"], x["path"], F.lower(x["leaf"]).alias("leaf"), F.variant_get(x["v"], "$", "string").alias("text"), i.alias("nth")))
        good = F.filter(texts, lambda x: usable(x["text"]) & ~x["leaf"].rlike(rf"^(?:{IDENTIFIERS})$|_(?:{IDENTIFIERS})$"))
        new = F.transform(good, lambda x: F.struct(_rank(x["leaf"]).alias("rank"), F.lit(depth).alias("depth"), x["root"].alias("root"), x["nth"].alias("nth"), x["path"].alias("path"), _first_line(x["text"]).alias("text")))  # noqa: B023
        out = out.withColumn("_found", F.concat("_found", new))
        if depth < DEPTH:
            inner = lambda o: F.transform(F.map_entries(o["v"].cast("map<string, variant>")), lambda e: F.struct(o["root"].alias("root"), F.concat_ws(".", o["path"], e["key"]).alias("path"), e["key"].alias("leaf"), (o["bad"] | _names_failure(e["key"])).alias("bad"), e["value"].alias("v")))
            out = out.withColumn("_at", F.flatten(F.transform(F.filter("_at", lambda x: kind(x["v"]).startswith("OBJECT")), inner)))
    best = F.array_min("_found")
    named = [F.when(F.schema_of_variant(F.variant_get("_v", f"$.{f}", "variant")) == "STRING", F.variant_get("_v", f"$.{f}", "string")) for f in fields]
    chosen = F.coalesce(*[F.when(usable(t), F.struct(F.lit(f).alias("path"), _first_line(t).alias("text"))) for f, t in zip(fields, named, strict=True)], F.when(F.size("_found") > 0, F.struct(best["path"].alias("path"), best["text"].alias("text"))))
    out = out.withColumn("_best", chosen)
    return out.select(*rows.columns, c("_best.text").alias("detail"), c("_best.path").alias("detail_path"))
