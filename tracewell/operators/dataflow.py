"""Data-flow mechanisms that a symbol's source text shows by itself, as a cascade of detectors over column expressions.

A symbol has name, file, signature, imports (paths), callees (names) and body. Five detectors look at the body without its
comments, the surest first; of a seed and its neighbours the nearest symbol with a finding gives the investigation's one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The shortest body that is judged, symbols beside the first seed and callees of it that are read.
SHORTEST, MORE_SEEDS, MORE_CALLEES = 40, 3, 4
#: Patterns of the detectors.
BLOCK_COMMENT, LINE_COMMENT = r"(?s)/\*.*?\*/", r"//[^\n]*"
CONFIGURED = r"process\.env|config\.|opts\.|options\.|this\.|props\.|import\.meta"
TIMER = r"\bset(?:Interval|Timeout)\s*\(\s*[^,]+,\s*[0-9_]{3,}\s*\)"
CRON = r"'(?:\*|[0-9,*/-]+)(?:\s+[0-9,*/-]+){4}'|\"(?:\*|[0-9,*/-]+)(?:\s+[0-9,*/-]+){4}\"|`(?:\*|[0-9,*/-]+)(?:\s+[0-9,*/-]+){4}`"
CADENCE = r"\b(?:pollInterval|refetchInterval|cadence|intervalMs|tickMs)\b\s*[:=]\s*[0-9_]{2,}"
SQL_EQUAL = r"(?i)\bWHERE\b[^;]*?[\"'`]?\b\w+\b[\"'`]?\s*=\s*[$?:]\w*"
SQL_NORMALISED = r"(?i)\b(?:LIKE|ILIKE|LOWER|UPPER|TRIM|SIMILAR|REGEXP)\b"
ORM_FIND = r"\.(?:find|findOne|findFirst|findUnique)\s*\(\s*\{\s*\w+\s*:"
MUTATING = r"(?i)reduc|\bslice\b|store|mutat|\bstate\b"
STATE_LIBRARY = r"(?i)redux|zustand|immer|valtio|mobx"
NEW_REFERENCE = r"return\s*\{\s*\.\.\.|=>\s*\(?\s*\{\s*\.\.\.|\.\.\.(?:state|prev|draft)\b"
ASSIGNED = r"\b(?:state|store|draft|cache|acc|accumulator)(?:\.[A-Za-z0-9_]+)+\s*=(?:=*)"
METHOD = r"\b(?:state|store|draft|cache)(?:\.[A-Za-z0-9_]+)*\.(?:push|splice|sort|reverse|pop|shift|unshift)\s*\("
ASYNC, AWAIT = r"\basync\b", r"\bawait\b"
CALL = r"^([A-Za-z_$][\w.$]*)\s*\("
STATEMENT = r"^(?:await|return|void|yield|const|let|var|if|for|while|\}|else|switch|throw|case)\b"
TALKS = r"^(?:emit|log|console|track|debug|warn|error|info|print|notify|next|push|set[A-Z])"
WRITES = r"(?i)^(?:save|write|flush|persist|commit|sync|update|insert|upsert|fetch|load|send|post)"
EQUALITY = r"\b(Object\.is|shallowEqual|isEqual)\s*\("
COMPARED = r"\b([A-Za-z_$][\w$]*)\s*(?:<=|>=|===|!==|<|>)\s*([0-9]+(?:\.[0-9]+)?)\b"
BOUNDS = r"(?i)thresh|limit|max|min|retr|attempt|backoff|count|rate|ratio|ttl|timeout|delay|capacity|tolerance|distance|score"
INDEX = r"\.length\b|\bidx\b|\bindex\b|\bi\b"
#: Base scores by pattern.
BASES = {"fixed-cadence": 0.2, "exact-match-query": 0.2, "in-place-mutation": 0.2, "unawaited-async-write": 0.19, "equality-gate": 0.18, "hardcoded-bound": 0.2}


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _match(body: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(body, f"({pattern})", 1), F.lit(""))


def _finding(pattern: str, matched: Column, length: int, about: Column, base: str | None = None) -> Column:
    """A finding where something matched: pattern, matched, about (what it is about) and base."""
    value = F.struct(F.lit(pattern).alias("pattern"), F.substring(_strip(matched), 1, length).alias("matched"), about.cast("string").alias("about"), F.lit(BASES[base or pattern]).alias("base"))
    return F.when(matched.isNotNull(), value)


def uncommented(source: Column) -> Column:
    """Source without block and line comments, each of them one blank."""
    return F.regexp_replace(F.regexp_replace(source, BLOCK_COMMENT, " "), LINE_COMMENT, " ")


def fixed_cadence(body: Column) -> Column:
    """A timer, a cron expression or an interval by a constant that no configuration gives."""
    cadence = _match(body, CADENCE)
    return F.coalesce(
        _finding("fixed-cadence", _match(body, TIMER), 48, F.lit("interval")),
        _finding("fixed-cadence", _match(body, CRON), 48, F.lit("cron")),
        _finding("fixed-cadence", F.when(~cadence.rlike(CONFIGURED), cadence), 40, F.lit("cadence")),
    )


def exact_match_query(body: Column) -> Column:
    """A look-up by equality without normalisation: in SQL, or of an object's field."""
    sql = _match(body, SQL_EQUAL)
    return F.coalesce(_finding("exact-match-query", F.when(~sql.rlike(SQL_NORMALISED), sql), 48, F.lit("sql")), _finding("exact-match-query", _match(body, ORM_FIND), 40, F.lit("field")))


def in_place_mutation(body: Column, name: Column, file: Column, signature: Column, imports: Column) -> Column:
    """A shared object changed in place, in code that keeps state and makes no new reference."""
    none = F.lit("")
    where = F.concat_ws(" ", F.coalesce(name, none), F.coalesce(file, none), F.coalesce(signature, none))
    about = where.rlike(MUTATING) | F.coalesce(F.exists(imports, lambda i: i.rlike(STATE_LIBRARY)), F.lit(False))
    assigned = F.filter(F.regexp_extract_all(body, F.lit(f"({ASSIGNED})"), F.lit(1)), lambda m: ~m.endswith("=="))
    matched = F.coalesce(F.try_element_at(assigned, F.lit(1)), _match(body, METHOD))
    return _finding("in-place-mutation", F.when(about & ~body.rlike(NEW_REFERENCE), matched), 40, F.regexp_extract(matched, r"^\w+", 0))


def unawaited_write(body: Column, callees: Column) -> Column:
    """A call that looks like a write, of a known callee, at the start of a line without await, in a body that awaits elsewhere."""
    head = lambda line: F.regexp_extract(line, CALL, 1)
    last = lambda line: F.regexp_extract(head(line), r"([^.]*)$", 1)

    def loose(line: Column) -> Column:
        chained = line.contains(".then(") | line.contains(".catch(") | line.contains("await ")
        known = F.coalesce(F.array_contains(callees, head(line)) | F.array_contains(callees, last(line)), F.lit(False))
        return line.rlike(CALL) & ~line.rlike(STATEMENT) & ~chained & ~last(line).rlike(TALKS) & (last(line).rlike(WRITES) | last(line).endswith("Async")) & known

    line = F.try_element_at(F.filter(F.transform(F.split(body, "\n"), _strip), loose), F.lit(1))
    return _finding("unawaited-async-write", F.when(body.rlike(AWAIT), line), 60, last(line))


def hardcoded_bound(body: Column) -> Column:
    """A gate by an equality function, or by a literal that a name of limits is compared with."""
    equality = _match(body, EQUALITY)
    name, number = (lambda m: F.regexp_extract(m, COMPARED, 1)), (lambda m: F.regexp_extract(m, COMPARED, 2).cast("double"))
    bound = lambda m: ~number(m).isin(0.0, 1.0) & name(m).rlike(BOUNDS) & ~name(m).rlike(INDEX)
    compared = F.try_element_at(F.filter(F.regexp_extract_all(body, F.lit(f"({COMPARED})"), F.lit(1)), bound), F.lit(1))
    return F.coalesce(_finding("hardcoded-bound", equality, 40, F.regexp_extract(equality, EQUALITY, 1), "equality-gate"), _finding("hardcoded-bound", compared, 40, name(compared)))


def finding(source: Column, name: Column, file: Column, signature: Column, imports: Column, callees: Column) -> Column:
    """struct(pattern, matched, about, base) of the surest mechanism that a symbol's source shows, or null.

    A null source and one of fewer than 40 characters show nothing; null imports and callees are none."""
    body = uncommented(source)
    found = F.coalesce(
        fixed_cadence(body), exact_match_query(body), in_place_mutation(body, name, file, signature, imports), unawaited_write(body, callees), hardcoded_bound(body)
    )
    return F.when(F.length(source) >= SHORTEST, found)


def contexts(seeds: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(inv, rank, id, name, file, signature, imports, body, callees): what an investigation reads, nearest first.

    seeds (inv, id, place) are ranked from 1: the first seed, the three after it, and four callees of the first by calls
    (source, target, seq). A symbol that comes twice counts where it comes first. symbols (id, name, file, signature, imports, body)."""
    first = seeds.filter("place = 1").select("inv", F.col("id").alias("source"))
    order = Window.partitionBy("inv").orderBy("seq", "target")
    called = first.join(calls, "source").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MORE_CALLEES)
    near = seeds.filter(F.col("place") <= 1 + MORE_SEEDS).select("inv", "id", F.col("place").alias("rank"))
    near = near.unionByName(called.select("inv", F.col("target").alias("id"), (F.col("n") + 1 + MORE_SEEDS).alias("rank")))
    near = near.groupBy("inv", "id").agg(F.min("rank").alias("rank"))
    wanted = near.select(F.col("id").alias("source")).distinct()
    names = calls.join(wanted, "source", "left_semi").join(symbols.select(F.col("id").alias("target"), "name"), "target").groupBy(F.col("source").alias("id")).agg(F.collect_set("name").alias("callees"))
    return near.join(symbols, "id").join(names, "id", "left").select("inv", "rank", "id", "name", "file", "signature", "imports", "body", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"))


def across(near: DataFrame) -> DataFrame:
    """(inv, id, rank, pattern, matched, about, base): of contexts the finding of the nearest symbol that has one."""
    c = F.col
    found = near.select("inv", "rank", "id", finding(c("body"), c("name"), c("file"), c("signature"), c("imports"), c("callees")).alias("f")).filter("f IS NOT NULL")
    return found.groupBy("inv").agg(F.min(F.struct("rank", "id", "f")).alias("x")).select("inv", "x.id", "x.rank", "x.f.*")
