"""Tables of any store under an allow list: the verbs list, count, columns, newest and most frequent values.

A store is its tables as DataFrames; jdbc_tables() reads them over JDBC, so that a count or a maximum runs
as one small read of the columns it needs. MongoDB, Firestore and the like come through their own Spark
sources and are used alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of date and of status columns, in order of preference.
DATE_FIELDS = ["updatedAt", "updated_at", "lastUpdated", "createdAt", "created_at", "timestamp", "time", "date"]
STATUS_FIELDS = ["status", "last_run_status", "syncStatus", "state", "connectionStatus"]


def jdbc_tables(spark: SparkSession, url: str, names: list[str], options: dict[str, str]) -> dict[str, DataFrame]:
    """The named tables over JDBC, read only; options hold driver, user and the partition column where one is known."""
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names}


class Store:
    """Tables by name, and which of them may be read (None: all)."""

    def __init__(self, tables: dict[str, DataFrame], allowed: list[str] | None = None):
        self.tables, self.allowed = tables, allowed

    def names(self) -> list[str]:
        return sorted(n for n in self.tables if self.allowed is None or n in self.allowed)

    def table(self, name: str) -> DataFrame:
        if name not in self.names():
            raise PermissionError(f"{name} is not on the allow list")
        return self.tables[name]

    def count(self, name: str) -> DataFrame:
        return self.table(name).agg(F.count("*").alias("n"))

    def columns(self, name: str) -> list[str]:
        return self.table(name).columns

    def newest(self, name: str, column: str) -> DataFrame:
        return self.table(name).agg(F.max(f"`{column}`").alias("newest"))

    def values(self, name: str, column: str, most: int = 25) -> DataFrame:
        """(value, n): the most frequent values as text, (none) for null; ties by value."""
        value = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("(none)")).alias("value")
        return self.table(name).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)

    def overview(self) -> DataFrame:
        """(collection, n, date_field, newest, status_field): one pass over each readable table."""
        spark, parts = next(iter(self.tables.values())).sparkSession, []
        for name in self.names():
            df = self.table(name)
            date, status = pick(df.columns, DATE_FIELDS), pick(df.columns, STATUS_FIELDS)
            newest = F.max(f"`{date}`").cast("timestamp_ntz") if date else F.lit(None).cast("timestamp_ntz")
            parts.append(df.agg(F.count("*").alias("n"), newest.alias("newest")).select(F.lit(name).alias("collection"), "n", F.lit(date).cast("string").alias("date_field"), "newest", F.lit(status).cast("string").alias("status_field")))
        return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "collection string, n long, date_field string, newest timestamp_ntz, status_field string")


def pick(fields: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is among the fields."""
    return next((c for c in candidates if c in fields), None)


#: What a role's column has to be.
KINDS = {"timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType), "number": (T.NumericType,), "text": (T.StringType,)}


def field_check(df: DataFrame, roles: dict[str, tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(role, column, problem) of mapped columns, role -> (column, kind), that are missing or of another kind."""
    types = {f.name: f.dataType for f in df.schema}
    out = []
    for role, (column, kind) in roles.items():
        if column not in types:
            fit = [n for n, t in types.items() if isinstance(t, KINDS[kind])][:5]
            out.append((role, column, f"missing; of that kind: {', '.join(fit) or '(none)'}"))
        elif not isinstance(types[column], KINDS[kind]):
            out.append((role, column, f"{types[column].simpleString()} is no {kind}"))
    return out


def indices(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """(index, temporary) of the tables of the session's catalog whose name fits the pattern."""
    rows = [(t.name, t.isTemporary) for t in spark.catalog.listTables(pattern=pattern)]
    return spark.createDataFrame(rows, "index string, temporary boolean")


def minified(files: DataFrame, longest: int = 5000) -> DataFrame:
    """(path, minified) of files (path, content): whether a line is longer than `longest`."""
    return files.select("path", F.coalesce(F.exists(F.split("content", "\n"), lambda line: F.length(line) > longest), F.lit(False)).alias("minified"))


def manifest_packages(manifests: DataFrame) -> DataFrame:
    """(path, package, dev) of package.json, requirements*.txt and pyproject.toml texts (path, content).

    Versions, extras, markers and options of requirements are left out; of a pyproject the quoted entries of
    the project's dependencies count."""
    name = F.substring_index("path", "/", -1)
    deps = lambda key: F.map_keys(F.from_json(F.get_json_object("content", f"$.{key}"), "map<string, string>"))
    some = lambda xs, dev: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda p: F.struct(p.alias("package"), F.lit(dev).alias("dev")))
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.regexp_extract(F.trim(x), r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)), lambda x: x != "")
    block = F.regexp_extract("content", r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)\]\s*(?:\n|$)", 1)
    listed = F.regexp_extract_all(block, F.lit(r"[\"']([A-Za-z0-9][A-Za-z0-9._-]*)"), F.lit(1))
    found = F.when(name == "package.json", F.concat(some(deps("dependencies"), False), some(deps("devDependencies"), True))).when(name.rlike(r"^requirements.*\.txt$"), some(lines, False)).when(name == "pyproject.toml", some(listed, False))
    return manifests.select("path", F.explode(found).alias("p")).select("path", F.lower("p.package").alias("package"), "p.dev").distinct()


def environment(configured: Column, sources: list[str]) -> Column:
    """Which of the sources an environment's settings (map<string, string>) configure, in the given order."""
    return F.filter(F.array(*[F.lit(s) for s in sources]), lambda s: F.coalesce(F.element_at(configured, s) != "", F.lit(False)))
