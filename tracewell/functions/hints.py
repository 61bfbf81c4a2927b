"""Text functions of hints, memories and paths as column expressions: terms, stems, codes, signatures, ids, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a hint, endings that go, in order.
STOP = (
    "the and for error failed failure incident investigation with from are not that this what how does why when keeps keep getting was were has have into after its all any can could should did work works working"
).split()
ENDINGS = ["ments", "ment", "ings", "ing", "ed", "es", "s"]
#: Tags that many unrelated incidents share.
GENERIC_TAGS = ["queue-backlog", "worker-slowdown", "external-api-latency", "deployment-regression", "retry-storm", "infrastructure"]
ENVIRONMENT_TAG = "(^|-)(prod|production|staging|dev|local)$"


def stem(word: Column) -> Column:
    """The word without its ending, if four characters at least stay."""
    out = word
    for e in reversed(ENDINGS):
        out = F.when((F.length(word) >= len(e) + 4) & word.endswith(e), F.substring(word, 1, F.length(word) - len(e))).otherwise(out)
    return out


def camel_words(token: Column) -> Column:
    """Runs of one kind: acronyms, words, capitals, digits, in order."""
    return F.regexp_extract_all(token, F.lit("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))


def hint_terms(text: Column) -> Column:
    """Distinct terms of a hint in order: # and the token for tokens with a digit or underscore, and
    the stems of the words that each token consists of."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))

    def terms(token: Column) -> Column:
        code = F.when((F.length(token) >= 4) & token.rlike("[0-9_]"), F.concat(F.lit("#"), F.lower(token)))
        words = F.transform(camel_words(token), F.lower)
        useful = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP) & ~w.rlike("^[0-9]+$"))
        return F.concat(F.filter(F.array(code), lambda c: c.isNotNull()), F.transform(useful, stem))

    return F.array_distinct(F.flatten(F.transform(tokens, terms)))


def module_area(path: Column) -> Column:
    """The first three segments of a longer path, a shorter one whole."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.when(F.size(parts) <= 3, path).otherwise(F.array_join(F.slice(parts, 1, 3), "/"))


def signature(path: Column, category: Column, queues: Column) -> Column:
    """An incident's area, leading hypothesis and sorted queues in one text."""
    named = F.array_sort(F.filter(F.coalesce(queues, F.array().cast("array<string>")), lambda q: q != ""))
    return F.concat_ws("|", F.coalesce(module_area(path), F.lit("")), F.coalesce(category, F.lit("")), F.array_join(named, ","))


def generic_tag(tag: Column) -> Column:
    return tag.isin(GENERIC_TAGS) | tag.rlike(ENVIRONMENT_TAG)


def usable_signature(sig: Column) -> Column:
    """The signature, or null if it is blank or holds generic parts only."""
    s = F.trim(F.coalesce(sig, F.lit("")))
    parts = F.filter(F.transform(F.split(s, "[|,]"), lambda x: F.trim(x)), lambda c: c != "")
    return F.when(F.exists(parts, lambda c: ~generic_tag(c)), s)


def shared_specific(a: Column, b: Column) -> Column:
    """Tags of both, without the generic ones."""
    return F.filter(F.array_intersect(a, b), lambda t: ~generic_tag(t))


def append_hint(hints: Column, hint: Column, most: int = 20) -> Column:
    """Distinct hints, the oldest first, with the new one, the latest `most`."""
    every = F.array_distinct(F.concat(F.coalesce(hints, F.array().cast("array<string>")), F.array(hint)))
    return F.slice(every, F.greatest(F.size(every) - most + 1, F.lit(1)), most)


def hint_id(memory: Column, hint: Column) -> Column:
    return F.concat(memory, F.lit("#hint:"), F.substring(F.sha2(F.encode(hint, "UTF-8"), 256), 1, 16))


def node_id(label: Column, path: Column, name: Column) -> Column:
    return F.concat_ws(":", label, path, F.coalesce(name, F.lit("")))


def _rounded(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def duration_text(ms: Column) -> Column:
    """19ms, 1.5s, 2m10s, 1h2m; ? for what is no duration."""
    sec = ms / 1000.0
    minutes = F.floor(sec / 60).cast("long")
    rest, over = _rounded(sec - 60.0 * F.floor(sec / 60)), F.pmod(minutes, F.lit(60))
    tenths = _rounded(sec * 10)
    seconds = F.concat((tenths / 10).cast("long"), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), tenths % 10)))
    part = lambda n, unit: F.when(n > 0, F.concat(n, F.lit(unit))).otherwise("")
    return (
        F.when(ms.isNull() | F.isnan(ms) | (F.abs(ms) == float("inf")) | (ms < 0), "?")
        .when(ms < 1000, F.concat(_rounded(ms), F.lit("ms"))).when(sec < 60, F.concat(seconds, F.lit("s")))
        .when(minutes < 60, F.concat(minutes, F.lit("m"), part(rest, "s")))
        .otherwise(F.concat(F.floor(minutes / 60), F.lit("h"), part(over, "m")))
    )


def age_text(hours: Column) -> Column:
    """Days from two days on, hours from one hour on, minutes below, each rounded."""
    return F.when(hours >= 48, F.concat(F.round(hours / 24).cast("long"), F.lit("d"))).when(hours >= 1, F.concat(F.round(hours).cast("long"), F.lit("h"))).otherwise(F.concat(F.round(hours * 60).cast("long"), F.lit("m")))


def qualifier(hint: Column) -> Column:
    """struct<symbol, container, is_path> of `path/to/file:symbol` or `Class.method` in a hint; null without one."""
    path = r"(?:^|[\s(])((?:[\w.@/-]*/[\w.@/-]+)|(?:[\w@/-]+\.[A-Za-z]{1,5})):([A-Za-z_$][\w$]*)"
    member = r"\b([A-Z][A-Za-z0-9_]*)\.([A-Za-z_$][\w$]*)\b"
    at = lambda p, i: F.regexp_extract(F.coalesce(hint, F.lit("")), p, i)
    container = F.regexp_replace(at(path, 1), r"^\.?/+", "")
    made = lambda s, c, p: F.when((F.length(s) >= 2) & (F.length(c) >= 2), F.struct(s.alias("symbol"), c.alias("container"), F.lit(p).alias("is_path")))
    return F.coalesce(made(at(path, 2), container, True), made(at(member, 2), at(member, 1), False))
