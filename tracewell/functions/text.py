"""Scalar text functions as column expressions: tokens, redaction, classes, numbers, hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secret formats in the order in which they are replaced, safe for log evidence.
SECRETS = [
    (r"(?i)(authorization\s*[=:]\s*)(bearer\s+)[^\s,\"')]+", "$1$2[REDACTED]"),
    (r"(?i)(authorization\s*[=:]\s*)(basic\s+)[^\s,\"')]+", "$1$2[REDACTED]"),
    (r"(?i)(\"?(?:password|passwd|secret|token|api[_-]key|apikey|x-api-key)\"?\s*[=:]\s*)\"?[^\"',\s)>]+", "$1[REDACTED]"),
    (r"(?i)((?:cookie|set-cookie)\s*[=:]\s*)[^\s\"',;>]{4,}", "$1[REDACTED]"),
    (r"(?i)((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?)://)[^:@/\s]*:[^@\s]+@", "$1[REDACTED]@"),
    (r"(?i)([a-z][a-z0-9+.-]*://)[^:@/\s,;]*:[^@/\s,;]+@", "$1[REDACTED]@"),
]
#: A UUID may look like a card number and is none.
UUID = r"\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b"
CARD = r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b"
#: Formats that go as well from what leaves the machine.
PERSONAL = [
    (r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z ]+ )?PRIVATE KEY-----", "[REDACTED-PRIVATE-KEY]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[REDACTED-JWT]"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED-AWS-KEY]"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "[REDACTED-GCP-KEY]"),
    (r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b", "[REDACTED-SLACK-TOKEN]"),
    (r"\bgh[pousr]_[0-9A-Za-z]{36,}\b", "[REDACTED-GH-TOKEN]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED-EMAIL]"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[REDACTED-IP]"),
]
#: What must not survive redaction.
RESIDUAL = [r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----", PERSONAL[1][0], PERSONAL[2][0]]
#: What a text must hold for a pattern to be tried at all, by the pattern's place.
_GATES = ["(?i)authorization", "(?i)authorization", "(?i)passw|secret|token|api[_-]?key", "(?i)cookie", "://", "://"]
_MORE_GATES = ["PRIVATE KEY", "eyJ", "AKIA|ASIA", "AIza", "xox", "gh[pousr]_", "@", r"[0-9]\.[0-9]"]
_MARK = "\ue0c4"


def _then(text: Column, step) -> Column:
    """step of a text that is worked out once, however often step names it."""
    return F.get(F.transform(F.array(text), step), F.lit(0))


def _gated(text: Column, patterns: list[tuple[str, str]], gates: list[str]) -> Column:
    """Replacements of which each runs only on texts that pass its gate."""

    def one(pattern: str, put: str, gate: str):
        return lambda t: F.when(t.rlike(gate), F.regexp_replace(t, pattern, put)).otherwise(t)

    for (pattern, put), gate in zip(patterns, gates, strict=True):
        text = _then(text, one(pattern, put, gate))
    return text


def redact(text: Column, personal: bool = True) -> Column:
    """Secrets (and with personal, provider keys, private keys, addresses) replaced by what they were."""
    # Every UUID and card gets a mark; the mark goes from the UUIDs again and is what is left of the cards.
    marked = lambda t: F.regexp_replace(F.regexp_replace(t, f"({UUID})|{CARD}", "$1" + _MARK), f"({UUID}){_MARK}", "$1")
    text = _then(_gated(text, SECRETS, _GATES), lambda t: F.when(t.rlike("[0-9]{4}[- ]?[0-9]{4}"), F.replace(marked(t), F.lit(_MARK), F.lit("[REDACTED-CARD]"))).otherwise(t))
    return _gated(text, PERSONAL, _MORE_GATES) if personal else text


def redact_or_drop(text: Column) -> Column:
    """The redacted text, or null if a high-risk format is still there."""
    return _then(redact(text), lambda t: F.when(~t.rlike("|".join(RESIDUAL)), t))


def has_secret(text: Column) -> Column:
    """Whether redaction of secrets would change the text."""
    return redact(text, personal=False) != text


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct lower-case runs of letters a-z and digits, in order of first appearance."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= least))


def camel_parts(name: Column) -> Column:
    """Words of a camelCase or snake_case name, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


#: Folders and file names that tell what a path is.
VENDORED_DIRS = ["node_modules", "vendor", "vendors", "vendored", "third_party", "third-party", "dist", "build", ".venv", "venv", ".yarn", "generated", "__generated__"]
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs", "testdata", "fixtures", "__fixtures__", "__testfixtures__", "testfixtures", "__mocks__", "e2e"]
DOCS_DIRS = ["docs", "doc", "docs_src", "website", "www", "site"]
EXAMPLE_DIRS = ["examples", "example", "samples", "sample", "demo", "demos", "bench", "benches", "benchmark", "benchmarks", "perf", "perf-measures", "runtime-tests", "sandbox", "playground", "tutorial", "tutorials"]
TEST_FILE = r"\.(?:test|spec|tst)\.[^/.]+$|^test_[^/]*\.[^/.]+$|_test\.(?:py|go|rs)$|^Test[A-Z][^/]*\.java$|Test\.java$|Spec\.(?:scala|kt)$|^conftest\.py$"
DOCS_FILE = r"(?i)\.(?:md|mdx|markdown|mdown|mkd|rst|adoc|txt)$"
CONFIG_FILE = (
    r"(?i)(?:^|/)(?:gulpfile|gruntfile|webpack[^/]*|rollup[^/]*|vite[^/]*|babel[^/]*|karma[^/]*|eslint[^/]*|prettier[^/]*|jest[^/]*|vitest[^/]*|tsup[^/]*|postcss[^/]*)\.(?:config\.)?[cm]?[jt]s$"
    r"|(?:^|/)(?:package\.json|tsconfig[^/]*\.json|pyproject\.toml|Cargo\.toml|go\.(?:mod|sum)|Dockerfile|docker-compose[^/]*\.ya?ml)$|(?:^|/)\.github/"
)


def path_class(path: Column) -> Column:
    """product, test, docs, example, vendored or config: vendored folders, then test file names, then the
    first folder that is of tests, docs or examples, then docs and config file names."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    base, dirs = F.element_at(parts, -1), F.transform(F.slice(parts, 1, F.size(parts) - 1), F.lower)
    of = lambda s: F.when(s.isin(TEST_DIRS) | s.startswith("test_"), "test").when(s.isin(DOCS_DIRS), "docs").when(s.isin(EXAMPLE_DIRS), "example")
    by_dir = F.get(F.filter(F.transform(dirs, of), lambda k: k.isNotNull()), F.lit(0))
    return F.when(path.isNotNull(), F.when(F.exists(dirs, lambda s: s.isin(VENDORED_DIRS)), "vendored").when(base.rlike(TEST_FILE), "test")
        .when(by_dir.isNotNull(), by_dir).when(base.rlike(DOCS_FILE), "docs").when(p.rlike(CONFIG_FILE), "config").otherwise("product"))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text of ASCII characters."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


#: What a statement of a read-only console must not hold.
SQL_WRITES = "INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|REPLACE|TRUNCATE|ATTACH|DETACH|PRAGMA|VACUUM|REINDEX|MERGE|GRANT|REVOKE|SET|load_extension"


#: What a scanner of a statement takes as one: literals and quoted names (kept as group 1), then comments. A line comment ends at
#: either kind of line break, a block comment at its first end; dialects that read on see less than is judged here, never more.
SQL_TOKEN = r"('[^']*'|\"[^\"]*\"|`[^`]*`)|--[^\r\n]*|/\*(?s:.*?)\*/"
#: What is left open or quoted in ways that dialects read differently: refused.
SQL_OPEN, SQL_DOUBT = r"['\"`]|/\*|\*/", r"\\['\"`]|\$[A-Za-z_]*\$"
SQL_START = r"(?i)^[(]*\s*(?:SELECT|WITH)(?:\s|$)"


def read_only(sql: Column) -> Column:
    """Whether a text is one SELECT or WITH statement that holds no word of SQL_WRITES, comments aside. Literals and comments are told
    apart by one scan from the left; words in literals count, and what is unclosed or quoted by escapes is refused."""
    text = F.coalesce(sql, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, SQL_TOKEN, "$1 "), r"^\s+|\s+$", "")
    body = F.regexp_replace(bare, r"[;]+\s*$", "")
    doubt = F.regexp_replace(text, SQL_TOKEN, " ").rlike(SQL_OPEN) | text.rlike(SQL_DOUBT)
    return ~doubt & ~F.contains(body, F.lit(";")) & ~bare.rlike(rf"(?i)\b(?:{SQL_WRITES})\b") & body.rlike(SQL_START)


def is_read_only(sql: str) -> bool:
    """read_only() for a statement at hand, such as one before it goes to spark.sql, by the same scan; words in literals do not count."""
    code = re.sub(SQL_TOKEN, lambda m: "''" if m[1] else " ", sql).strip()
    if re.search(SQL_OPEN, code.replace("''", "")) or re.search(SQL_DOUBT, sql):
        return False
    body = re.sub(r"[;]+\s*$", "", code)
    return ";" not in body and not re.search(rf"\b(?:{SQL_WRITES})\b", code, re.I) and re.match(SQL_START, body) is not None
