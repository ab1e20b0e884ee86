"""Streaming queries over tables that are one file and tables that are folders of files."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["file", "folder"])
def folder(request, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    for t in ("events", "conversations"):
        if request.param == "file":
            duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").write_parquet(f"{d}/{t}.parquet")
            continue
        os.makedirs(f"{d}/{t}.parquet")
        for k in range(3):
            duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet' WHERE hash({'event_id' if t == 'events' else 'conv_id'}) % 3 = {k}") \
                .write_parquet(f"{d}/{t}.parquet/part-{k}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["t04_enrich_messages_stream", "t05b_bars_from_ticks_stream", "t02b_latest_per_source_stream"])
def test_whole_table(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
