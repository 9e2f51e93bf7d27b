import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_drop_what_they_should(spark, tmp_path):
    from .conftest import DOCS, prose

    base = prose(1, 120)
    rows = [(i, prose(10 + i, 100), "en", "a", 1, "x") for i in range(60)]
    rows += [(100, base, "en", "a", 1, "x"), (101, base, "en", "a", 1, "x"), (102, base + " more", "en", "b", 1, "x"), (103, "too short", "en", "a", 1, "x"), (104, "7 " * 20 + " ".join(map(str, range(80))), None, "a", 1, None), (105, None, "en", "a", 1, "x"), (106, "same words here " * 40, "en", "a", 1, "x")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(docs.columns) == sorted(spark.read.parquet(f"{tmp_path}/documents.parquet").columns)
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == {r[0] for r in rows} - {103, 105, 106}
    assert kept[1] == kept[0] - {104}
    assert kept[2] == kept[1] - {101, 102}
    packed = pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == kept[2] and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_edge_cases_run_through_all_stages(spark, tmp_path, edge_rows):
    from .conftest import DOCS, prose

    names = ["__hot", "own_key", "host_of_doc", "failed_bits", "text_tid", "text_rk", "h", "rank", "windows", "root", "class_id"]
    more = [(200 + i, prose(300 + i, 90), "en", None if i % 2 else "b", 1, "x") for i in range(30)] + [(None, prose(777, 90), "en", "b", 1, "x")] * 2 + [(900, None, None, None, None, None)]
    rows = [(*r, *names) for r in edge_rows + more]
    spark.createDataFrame(rows, DOCS + ", " + ", ".join(f"{n} string" for n in names)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert all(tuple(r)[-len(names) :] == tuple(names) for r in kept.collect())
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(None) == 2 and ids.count(1) == 1 and not {3, 4, 7, 900} & set(ids)
    packed = pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id.dropna()) == {i for i in ids if i is not None} and packed.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a", 1, "x"), (2, "few words", None, None, None, None)]])
def test_nothing_to_pack(spark, tmp_path, rows):
    from .conftest import DOCS

    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
