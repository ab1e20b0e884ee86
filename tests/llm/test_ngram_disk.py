"""What the n-gram join leaves on disk: steps that end give up their shuffle files, rows do not travel twice."""

from __future__ import annotations

from tsengine.llm import ngram_join


def test_entries_travel_once(spark, monkeypatch):
    seen = []

    def spy(df, what, heavy=False):
        seen.append((what, heavy, df._jdf.queryExecution().analyzed().toString()))
        return df.localCheckpoint()

    monkeypatch.setattr(ngram_join, "materialize", spy)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join([*words[:50 + i % 5], f"own{i}"])) for i in range(12)]
    rows = ngram_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80).collect()
    assert {r.component_id for r in rows} == {0}
    assert [heavy for what, heavy, _ in seen if what == "entries"] == [True, True]
    assert all(heavy for what, heavy, _ in seen if what in ("star", "rest"))
    assert any(what == "rest" for what, _, _ in seen)
    assert not any("Deduplicate" in plan.split("LogicalRDD")[0] for what, _, plan in seen if what == "rest")


def test_parities_stay_out_of_entries(spark, monkeypatch):
    seen = []

    def spy(df, what, heavy=False):
        seen.append((what, "odd" in df._jdf.queryExecution().analyzed().toString().split("LogicalRDD")[0], df.columns))
        return df.localCheckpoint()

    monkeypatch.setattr(ngram_join, "materialize", spy)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join([*words[:50 + i % 5], f"own{i}"])) for i in range(12)]
    rows = ngram_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80).collect()
    assert {r.component_id for r in rows} == {0}
    assert not any(odd or "odd" in columns for what, odd, columns in seen if what in ("entries", "star", "rest"))
    assert any(odd for what, odd, _ in seen if what == "pairs")
