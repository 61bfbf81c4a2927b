"""The read-only guard: literals and comments that hide each other, and what dialects read differently."""

import pytest

from tracewell.functions import text

HIDDEN = [
    "with a as (select 1 x) -- '\n insert into t select * from a -- '", "select 1 /* ' */ ; drop table t /* ' */", "select '--'; drop table x", "select 1 -- \r ; drop table x", "select '/*'; drop table x -- */",
    "select \"--\"; delete from x", "select 'a\\'' ; drop table t -- '", "select $$ ' $$ ; drop table x -- '", "select 1 /* /* */ ; drop table t */", "select 'open", "select 1 /* open", "select `'`; drop table x -- '", "select ''''; drop table x -- '",
    "insert into x values ('select 1')", "", "   ", "-- select 1", ";select 1; drop table x",
]
PLAIN = [
    "select 1 -- it's fine", "select '/*' || x || '*/' from t", "with x as (select '--' a) select * from x;", "select \"a--b\" from t /* note: don't */", "SELECT 'it''s' FROM t", "select a /* ; */ from b", "(select 1)", "select $1 from t",
]


@pytest.mark.parametrize("sql", HIDDEN)
def test_hidden_statements_are_refused(sql):
    assert not text.is_read_only(sql)


@pytest.mark.parametrize("sql", PLAIN)
def test_plain_statements_pass(sql):
    assert text.is_read_only(sql)


def test_column_form_agrees(spark):
    rows = spark.createDataFrame([(s, False) for s in HIDDEN] + [(s, True) for s in PLAIN] + [("select 'drop' from t", False), ("select ';' from t", False)], "sql string, want boolean")
    got = rows.select("sql", "want", text.read_only(rows["sql"]).alias("got")).collect()
    assert [r.sql for r in got if r.got != r.want] == []
