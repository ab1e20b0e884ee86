"""Quotes whose previous close is zero, in every vendor layout: Spark against the SQL of the same query."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry

#: value and user_id: previous close zero with a value above, below and at zero; a close above zero; below it; a change of -9.2450 %
CASES = [(2.0, 5), (-2.0, 1), (0.0, 3), (3.0, 4), (0.5, 6), (29.45, 0)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("quotes")
    rows = ", ".join(f"({4 * i + layout}, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {4 * i + layout} SECOND, {u}, 'view', {v})"
                     for i, (v, u) in enumerate(CASES) for layout in range(4))
    duckdb.sql(f"SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, '{{}}' AS props "
               f"FROM (VALUES {rows}) AS t(event_id, ts, user_id, event_type, value)").write_parquet(f"{d}/events.parquet")
    return str(d)


def rows_of(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=str)


def check(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = rows_of(con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert want and rows_of(got.collect()) == want


def test_to_numeric_keeps_prices_beside_a_zero_close(spark, folder):
    check(spark, folder, "p17_to_numeric")


def test_string_keyed_over_a_zero_close(spark, folder):
    check(spark, folder, "s08_normalise_string_keyed")


def test_all_layouts_over_a_zero_close(spark, folder):
    check(spark, folder, "s06_s09_normalise_all")


def test_defaults_over_a_zero_close(spark, folder):
    check(spark, folder, "p19_project_quote_defaults")


def test_quote_stream_over_a_zero_close(spark, folder):
    check(spark, folder, "t01_quote_stream")
