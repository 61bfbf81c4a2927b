"""Personal data in texts: candidate gradient boosting, in DataFrame functions only.

Base spans follow fixed formats. Several loose generators a kind then propose further, overlapping
spans (spelled-out addresses, local telephone numbers, card numbers with odd separators, long and
defanged IP addresses); boosted trees over their form and context score them, a threshold calibrated
on held-out examples selects, and the best of overlapping ones joins the base spans. The examples
are whole invented sentences that the same generators search. The trees run as SQL expressions.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import table

KINDS = ["email", "ip", "card", "phone"]
#: Invented sentences of each kind and side to learn from; precision on held-out candidates that a threshold must reach.
TRAIN, PRECISION = 500, 0.98
#: The base formats. Possessive repeats keep the matcher from recursing on long runs, and starting
#: only at a run's first character (or where the last match ended) keeps it linear; both find the
#: same leftmost matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?[\[({<](?:at|AT)[\])}>]\x20?|\x20(?:at|AT)\x20|\x20@\x20?|@\x20)"
_DOT = r"(?:\x20?[\[({<](?:dot|DOT)[\])}>]\x20?|\x20(?:dot|DOT)\x20|\x20?\.\x20?)"
#: What proposes further spans: a kind's generators overlap, from narrow forms to almost any.
LOOSE = {
    "email": [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z]{2,24}(?![A-Za-z]))++",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9-]++" + _DOT + r"[A-Za-z]{2,24}(?![A-Za-z])",
    ],
    "ip": [
        r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
        r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])",
        r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}){3}(?![0-9.])",
    ],
    "card": [
        r"(?<![0-9])[0-9]{3,6}(?:[\x20./_-]{1,3}[0-9]{2,6}){2,5}(?![0-9])",
        r"(?<![0-9])[0-9](?:[\x20./_-]{0,3}[0-9]){12,18}(?![0-9])",
    ],
    "phone": [
        r"(?<![0-9+(])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9])",
        r"(?<![0-9+(])(?:00\x20?[0-9]{1,3}[\x20./-]?)?\(?0?[0-9]{1,5}\)?(?:[\x20./-]{0,2}[0-9]){6,12}(?![0-9])",
    ],
}


def _spans(text: str, pattern: str) -> str:
    """SQL: the leftmost matches as array<struct<at, stop, m>>; a match's place follows from the
    lengths of the parts between matches."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found, parts = f"regexp_extract_all({text}, '{p}', 0)", f"split({text}, '{p}', -1)"
    pairs = f"filter(zip_with({found}, {parts}, (m, gap) -> named_struct('m', m, 'gap', gap)), x -> x.m IS NOT NULL)"
    step = "a.at + length(x.gap)"
    return (
        f"aggregate({pairs}, named_struct('at', 0, 'spans', CAST(array() AS array<struct<at: int, stop: int, m: string>>)),"
        f" (a, x) -> named_struct('at', {step} + length(x.m), 'spans', concat(a.spans, array(named_struct('at', {step}, 'stop', {step} + length(x.m), 'm', x.m)))), a -> a.spans)"
    )


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    doubled = f"CAST(substr({digits}, length({digits}) - i, 1) AS int) * (1 + i % 2)"
    return f"(aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + CAST(({doubled}) div 10 AS int) + ({doubled}) % 10) % 10 = 0)"


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        return f"forall(split({m}, '\\\\.'), p -> length(ltrim('0', p)) <= 3 AND CAST(right(p, 3) AS int) <= 255)"
    if kind == "card":
        return f"(length({_digits(m)}) BETWEEN 13 AND 19 AND {_luhn(_digits(m))})"
    return f"(length({_digits(m)}) BETWEEN 9 AND 15)" if kind == "phone" else "true"


def _count(m: str, chars: str) -> str:
    return f"length(regexp_replace({m}, '[^{chars}]', ''))"


def _flag(what: str) -> str:
    return f"CAST({what} AS int)"


#: Form and context of a candidate c (m, before, after) as small integers.
FEATURES = [
    f"least({_count('c.m', '0-9')}, 24)",
    f"{_count('c.m', ' ')}",
    f"{_count('c.m', './')}",
    f"{_count('c.m', '-_')}",
    _flag("c.m LIKE '(%'"),
    _flag("c.m RLIKE '[\\\\[({](?:at|dot)'"),
    _flag("c.m RLIKE '^[0-9]{4}[ ./-]?[0-9]{4}[ ./-]?[0-9]{4}'"),
    _flag("c.m RLIKE '[0-9]{3}[ ./-][0-9]{4}$'"),
    _flag("c.m RLIKE '^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4})(?![0-9])'"),
    _flag("c.m RLIKE '[._/-]{2}|[0-9][ ]{2}'"),
    _flag("lower(c.before) RLIKE '(?:tel|phone|call|fax|mobile|cell|dial|whatsapp)[^a-z]{0,3}(?:no|number|us|me|at)?[^a-z0-9]{0,3}$'"),
    _flag("lower(c.before) RLIKE '(?:card|visa|mastercard|amex|credit|debit)[^a-z]{0,3}(?:no|number)?[^a-z0-9]{0,3}$'"),
    _flag("lower(c.before) RLIKE '(?:mail|contact|write|reach)[^a-z]{0,3}(?:to|at|me|us|me at)?[^a-z0-9]{0,3}$'"),
    _flag("lower(c.before) RLIKE '(?:order|invoice|version|ref|id|no|date|on|page|isbn|section)[^a-z0-9]{0,3}$'"),
    _flag("c.m RLIKE '[0-9A-Fa-f]{3}'"),
    _flag("c.after RLIKE '^[A-Za-z%$]'"),
    _flag("c.before RLIKE '[A-Za-z$#/_=-]$'"),
    f"if({_count('c.m', '0-9')} BETWEEN 13 AND 19, {_flag(_luhn(_digits('c.m')))}, 0)",
    "c.by",
    f"least({_count('c.m', 'A-Za-z')}, 24)",
    _flag("c.m RLIKE '\\\\. |\\\\.[A-Z]'"),
    _flag("c.m RLIKE '[.(\\\\[ ](?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|eu)$'"),
    _flag("c.m RLIKE '^0'"),
    _flag("c.m LIKE '%::%'"),
    _flag("lower(c.before) RLIKE '(?:host|server|client|address|from|ping|ip|node)[^a-z0-9]{0,3}$'"),
]


def examples(n: int = 400, seed: int = 7) -> list[tuple[str, str, int, int]]:
    """(text, kind, at, stop): n invented sentences a kind with a span of personal data, and as many
    with something that looks like one and is none (at = stop = -1), from rules and a seed."""
    r = random.Random(seed)
    pick = r.choice
    d = lambda k: "".join(pick("0123456789") for _ in range(k))
    word = lambda: "".join(pick(["th", "er", "an", "on", "es", "ti", "or", "la", "mi", "ka"]) for _ in range(r.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(r.randint(1, k)))

    def luhn(k: int) -> str:
        x = d(k - 1)
        return x + str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(x))) % 10)

    def cut(x: str, sizes: list[int], sep: str) -> str:
        parts = []
        for k in sizes:
            parts, x = [*parts, x[:k]], x[k:]
        return sep.join([*parts, x] if x else parts)

    def date() -> str:
        sep = pick("-./")
        return pick([f"20{d(2)}{sep}{r.randint(1, 12):02}{sep}{r.randint(1, 28):02}", f"{r.randint(1, 28):02}{sep}{r.randint(1, 12):02}{sep}20{d(2)}", f"{r.randint(0, 23):02}:{d(2)}:{d(2)}"])

    def address() -> tuple[str, str]:
        at, dot = pick([("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), ("{at}", "{dot}"), (" AT ", " DOT "), (" @ ", "."), ("@ ", " . "), (" [at] ", "."), ("<at>", "<dot>")])
        name = pick([word(), f"{word()}.{word()}", f"{word()}_{d(2)}", f"{word()}-{word()}"])
        site = dot.join([word(), *([word()] if r.random() < 0.2 else []), pick(["com", "org", "net", "de", "fr", "info"])])
        return pick(["mail ", "e-mail: ", "contact ", "write to ", "reach me at ", "address: ", "send it to "] if "(" not in at and "[" not in at and "{" not in at else ["", "mail ", "by "]), name + at + site

    def v6() -> str:
        groups = [f"{r.randrange(65536):x}" for _ in range(8)]
        return pick([":".join(groups), ":".join(groups[: r.randint(1, 3)]) + "::" + ":".join(groups[: r.randint(1, 4)])])

    sep = lambda: pick([" ", ".", "-", "/"])
    true = {
        "email": address,
        "ip": lambda: (pick(["host ", "from ", "client ", "address ", ""]), v6() if r.random() < 0.6 else pick(["[.]", "(.)", " . "]).join(str(r.randrange(256)) for _ in range(4))),
        "card": lambda: (pick(["card ", "Visa: ", "credit card number ", "paid with ", "Mastercard no. ", ""]), cut(luhn(16), [4, 4, 4], pick([".", "/", " - ", "_", "  "])) if r.random() < 0.7 else cut(luhn(15), [4, 6], pick([".", "/", " - ", "_"]))),
        "phone": lambda: (pick(["tel. ", "call ", "Phone: ", "fax ", "mobile no ", "ring us on ", "dial "]), pick([f"({d(3)}) {d(3)}-{d(4)}", sep().join([d(3), d(3), d(4)]), sep().join(["0" + d(2), d(4), d(4)]), f"00{d(2)} {d(3)} {d(6)}", f"0{d(3)}/{d(6)}", f"0{d(3)} {d(7)}"])),
    }
    prose = lambda: f"{word()} at {pick([word() + '. ' + word().title(), word() + '.' + word(), 'and. Of', 'noon. The', 'the dot ' + word(), 'once. It', word() + ' . ' + word()])}"
    labels = ["order ", "invoice ", "ref ", "page ", "version ", "id ", "on ", "section ", "no. ", "isbn ", ""]
    false = {
        "email": lambda: ("", pick([prose, prose, lambda: f"{word()} @ {d(2)}.{d(2)} {word()}", lambda: f"{word()} (at) {word()}"])()),
        "ip": lambda: (pick(["version ", "section ", "mac ", "at ", "key ", ""]), pick([":".join(pick(["aa", "00", "ff", d(2)]) for _ in range(8)), f"{d(1)} . {d(1)} . {d(2)} . {d(3)}", ":".join(d(2) for _ in range(3)) + "::" + d(2), f"{word()}::{word()}", f"{d(3)} . {d(3)} . {d(3)} . {d(3)}"])),
        "card": lambda: (pick(labels), pick([cut(d(k := pick([8, 12, 15, 16, 20])), [4] * (k // 4 - 1), pick([".", "/", " - ", " ", "_"])), date(), f"{d(3)}.{d(3)}.{d(3)}", d(pick([13, 14, 16, 18])), f"{date()} {d(5)}-{d(4)}"])),
        "phone": lambda: (pick(labels), pick([date(), f"{d(2)}.{d(2)}.{d(2)}", f"{d(4)}-{d(4)}", f"{d(2)}/{d(2)}/{d(2)}/{d(2)}", f"{d(5)}-{d(2)}-{d(3)}-{d(2)}", d(pick([7, 8, 10, 12])), f"{d(3)}.{d(3)}.{d(3)}", f"{d(2)} {d(2)} {d(2)} {d(3)}", f"{d(4)} {d(4)}"])),
    }
    out = []
    for kind in KINDS:
        for i in range(2 * n):
            lead, span = (true if i % 2 else false)[kind]()
            before = f"{words(4).capitalize()} {lead}"
            after = pick([". ", ", ", "\n", " ", "; ", ") "]) + words(4) + pick([".", "", "%"]) if r.random() < 0.8 else ""
            out.append((before + span + after, kind, *((len(before), len(before) + len(span)) if i % 2 else (-1, -1))))
    return out


def _candidates(rows: DataFrame) -> DataFrame:
    """Rows with a column t -> the same with digits, base_<kind>: the valid base spans, and free_<kind>: the
    other candidates (at, stop, m, before, after, by), which meet no base span of any kind."""
    others = rows.columns
    gates = {"email": "contains(t, '@')", "ip": "digits", "card": "digits", "phone": "contains(t, '+')"}
    none = "CAST(array() AS array<struct<at: int, stop: int, m: string>>)"
    rows = rows.select(*others, F.expr("t RLIKE '[0-9]'").alias("digits"))
    rows = rows.select(*others, "digits", *(F.expr(f"if({gates[k]}, {_spans('t', BASE[k])}, {none})").alias(f"_{k}") for k in KINDS))
    rows = rows.select(*others, "digits", *(F.expr(f"filter(_{k}, x -> {_valid(k, 'x.m')})").alias(f"base_{k}") for k in KINDS))
    wide = {"email": "(contains(t, '@') OR lower(t) RLIKE '[ \\\\[({<]at[ \\\\])}>]')", "ip": "digits AND (contains(t, ':') OR contains(t, '.'))", "card": "digits", "phone": "digits"}

    def proposed(k: str) -> str:
        found = [f"transform({_spans('t', p)}, x -> named_struct('at', x.at, 'stop', x.stop, 'm', x.m, 'by', {i}))" for i, p in enumerate(LOOSE[k])]
        return f"if({wide[k]}, concat({', '.join(found)}), CAST(array() AS array<struct<at: int, stop: int, m: string, by: int>>))"

    taken = "concat(" + ", ".join(f"base_{k}" for k in KINDS) + ")"
    rows = rows.select("*", F.expr(taken).alias("taken"), *(F.expr(proposed(k)).alias(f"loose_{k}") for k in KINDS))
    apart = "filter(loose_{k}, x -> NOT exists(taken, b -> b.at < x.stop AND x.at < b.stop))"
    context = "named_struct('at', x.at, 'stop', x.stop, 'm', x.m, 'before', substr(t, greatest(x.at - 23, 1), least(x.at, 24)), 'after', substr(t, x.stop + 1, 2), 'by', x.by)"
    return rows.select(*others, "digits", *(f"base_{k}" for k in KINDS), *(F.expr(f"transform({apart.format(k=k)}, x -> {context})").alias(f"free_{k}") for k in KINDS))


@cache
def _trained(n: int, seed: int) -> dict[str, tuple[str, float]]:
    """By kind the score as SQL and its threshold, fitted on half the examples' candidates, calibrated on
    the rest, one half of probability at least: in real texts most candidates are none. A candidate is personal if it and the example's span have over six tenths of what they cover in common."""
    spark = SparkSession.getActiveSession()
    data = _candidates(spark.createDataFrame(examples(n, seed), "t string, kind string, begin int, end int"))
    out = {}
    for i, kind in enumerate(KINDS):
        rows = data.filter(F.col("kind") == kind).select("begin", "end", F.expr(f"explode(free_{kind})").alias("c"))
        shared, both = "greatest(least(c.stop, end) - greatest(c.at, begin), 0)", "greatest(c.stop, end) - least(c.at, begin)"
        y = f"CAST(begin >= 0 AND {shared} > 0.6 * ({both}) AS int) AS y"
        a = np.array([list(r) for r in rows.selectExpr(y, *(f"{f} AS f{j}" for j, f in enumerate(FEATURES))).collect()], float)
        order = np.random.default_rng(seed + i).permutation(len(a))
        fit, held = a[order[: len(a) // 2]], a[order[len(a) // 2 :]]
        model = boosting.fit(fit[:, 1:], fit[:, 0])
        out[kind] = (boosting.sql(model, FEATURES), max(0.0, boosting.threshold(boosting.score(model, held[:, 1:]), held[:, 0], PRECISION)))
    return out


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: int = TRAIN, seed: int = 7) -> DataFrame:
    """One row per row of docs: id_col, base and spans, both array<struct<kind, at, stop>>, and t, the text they count in.

    at and stop count code points, stop is exclusive; spans are ordered by kind, then at, and hold
    all of base. A null text counts as empty and has none. Added spans never overlap base spans of
    any kind, nor each other. Rows are judged alone, so repeated rows and ids have repeated results;
    other columns are ignored, and an empty table gives an empty result. train: the number of invented
    sentences with and without a span of each kind that the trees are fitted and calibrated on.
    """
    model = _trained(train, seed)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows = _candidates(rows)
    # Score, threshold, best of overlapping.
    chosen = []
    for k in KINDS:
        scored = f"transform(free_{k}, c -> named_struct('at', c.at, 'stop', c.stop, 'score', {model[k][0]}))"
        cut = model[k][1]
        kept = f"filter({scored}, x -> x.score >= {cut:.12g}D)" if np.isfinite(cut) else f"filter({scored}, x -> false)"
        chosen.append(F.expr(f"if(size(free_{k}) = 0, CAST(array() AS array<struct<at: int, stop: int, score: double>>), {kept})").alias(f"more_{k}"))
    rows = rows.select("id", "t", *(f"base_{k}" for k in KINDS), *chosen)
    # What several candidates claim goes to the best score, then to the kind listed first, then to the first and longest.
    chosen = []
    for k in KINDS:
        rivals = []
        for o in KINDS:
            tie = "(y.at < x.at OR y.at = x.at AND y.stop > x.stop)" if o == k else "true" if KINDS.index(o) < KINDS.index(k) else "false"
            rivals.append(f"exists(more_{o}, y -> y.at < x.stop AND x.at < y.stop AND (y.score > x.score OR y.score = x.score AND {tie}))")
        chosen.append(F.expr(f"array_distinct(filter(more_{k}, x -> NOT ({' OR '.join(rivals)})))").alias(f"best_{k}"))
    rows = rows.select("id", "t", *(f"base_{k}" for k in KINDS), *chosen)
    named = lambda k, what: f"transform({what}, x -> named_struct('kind', '{k}', 'at', x.at, 'stop', x.stop))"
    both = {k: f"array_sort(concat({named(k, f'base_{k}')}, {named(k, f'best_{k}')}))" for k in KINDS}
    return rows.select(
        F.col("id").alias(id_col),
        F.expr("concat(" + ", ".join(named(k, f"base_{k}") for k in KINDS) + ")").alias("base"),
        F.expr("concat(" + ", ".join(both[k] for k in KINDS) + ")").alias("spans"),
        "t",
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and text, each span replaced by its kind in brackets.

    Overlapping spans of two kinds become the one that starts first. A null text becomes an empty
    one; ids may repeat or be null, as each row is handled alone."""
    found = personal_spans(docs, id_col, text_col).select(id_col, "t", F.expr("array_sort(spans, (a, b) -> CASE WHEN a.at < b.at THEN -1 WHEN a.at > b.at THEN 1 ELSE b.stop - a.stop END)").alias("spans"))
    start = "named_struct('at', 0, 'out', '')"
    step = "(a, x) -> if(x.at < a.at, a, named_struct('at', x.stop, 'out', concat(a.out, substr(t, a.at + 1, x.at - a.at), '[', upper(x.kind), ']')))"
    return found.select(id_col, F.expr(f"aggregate(spans, {start}, {step}, a -> concat(a.out, substr(t, a.at + 1)))").alias("text"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.at, x.stop)), ',')")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(_joined("base"), "UTF-8"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
