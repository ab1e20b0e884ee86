"""The pipeline's stages on a small folder of tables: planted rows go, clean ones stay."""

from __future__ import annotations

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = {}, []
    for k in range(160):
        docs[k] = text(rng.randint(30, 120))
        if k % 4 == 0:
            docs[k] = " ".join(w + "###" for w in docs[k].split())
        labels.append((k, int(k % 4 > 0), 0))
    passage, item = text(55), text(40)
    docs[201], docs[202] = docs[1], docs[2] + " near"
    docs[203], docs[204] = text(40) + " " + passage + " " + text(40), text(40) + " " + passage + " " + text(40)
    docs[205], docs[206] = text(40) + " " + item + " " + text(30), None
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = df.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        assert df.columns == columns
        seen.append({r.doc_id: r for r in df.collect()})
    junk = {k for k in range(160) if k % 4 == 0}
    assert len(junk & set(seen[0])) <= 2 and len(set(docs) - junk - set(seen[0])) <= 3
    assert not {201, 202} & set(seen[1]) and set(seen[0]) - set(seen[1]) <= {201, 202}
    assert seen[2].keys() == seen[1].keys() and passage in seen[2][203].text and passage not in seen[2][204].text
    assert all(r.n_chars == len(r.text) for r in seen[2].values() if r.text is not None)
    assert set(seen[2]) - set(seen[3]) == {205}
    out = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(seen[3])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[3])


def test_names_ties_and_empty_tables(spark, tmp_path):
    """Columns named like the stages' own pass through them; equal rows, ties and empty tables work."""
    good = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdefgh"]
    rows = [(k, t, "s", "p", 7, True, 0.5, "x", len(t)) for k, t in enumerate(good)] + [(3, good[3], "s", "p", 7, True, 0.5, "x", len(good[3]))] * 2
    schema = "doc_id long, text string, score string, predicted string, _rid long, _null boolean, c1 double, row string, n_chars int"
    spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such text in any of the documents here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, table in (("all", rows), ("none", [])):
        df = spark.createDataFrame(table, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            df = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert df.columns == schema.replace(",", "").split()[::2]
        assert sorted(map(tuple, df.collect())) == sorted(set(rows) if table else [])
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == len(set(table))
