import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions.scope import in_scope
from quillspan.functions.textfn import balanced, depth
from quillspan.functions.vectors import embed, hash_embedding
from quillspan.operators import corpus, graph, retrieval, select, stats
from quillspan.sources import records, sinks
from quillspan.streaming import rates


def test_scope_admits_an_end_at_the_target(spark):
    rows = spark.createDataFrame([("s", 0, 10), ("s", 5, 11), ("s", -1, 3), ("s", 4, 4), ("t", 0, 3), ("s", None, 3)], "src string, a int, b int")
    kept = rows.where(in_scope(F.col("src"), F.col("a"), F.col("b"), F.lit("s"), F.lit(10))).collect()
    assert [tuple(r) for r in kept] == [("s", 0, 10)]


def test_eligible_records_respects_all_marks(spark):
    import hashlib

    h = hashlib.sha256(b"see the figure").hexdigest()
    rows = [("a", "s", 1, "text", "instruction", "para", [], False, False, None), ("b", "s", 2, "text", "exercise_material", "para", [], False, False, None), ("c", "s", 3, "text", None, "para", [], False, False, None),
            ("d", "s", 4, "text", "instruction", "example", [], False, False, None), ("e", "s", 5, "text", "instruction", "para", ["mglyph"], False, False, None), ("f", "s", 6, "text", "instruction", "para", None, True, False, None),
            ("g", "s", 7, "see the figure", "instruction", "para", None, False, True, ("see", 0, 3, h)), ("h", "s", 8, "see the figure", "instruction", "para", None, False, True, ("sea", 0, 3, h)), ("i", "s", 9, " ", "instruction", "para", None, False, False, None),
            ("j", "s", 20, "late", "instruction", "para", None, False, False, None), ("k", "other", 1, "text", "instruction", "para", None, False, False, None)]
    r = spark.createDataFrame(rows, "id string, source_id string, position int, content string, instructional_role string, kind string, unsupported_mathml array<string>, contains_exercise_content boolean, requires_external_media boolean, excerpt struct<quote:string,start:int,end:int,parent_sha256:string>")
    targets = spark.createDataFrame([("t", "s", 20)], "target_id string, target_source string, target_position int")
    assert {(x.id, x.content) for x in corpus.eligible_records(r, targets).collect()} == {("a", "text"), ("g", "see")}


def test_paths_are_all_paths(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 1), (4, 3), (2, 4)], "src int, dst int")
    got = {tuple(r.path_ids) for r in graph.expand_back(edges, spark.createDataFrame([(2,)], "start int"), 3).collect()}
    assert got == {(2, 1), (2, 3), (2, 1, 4), (2, 3, 4), (2, 1, 4, 2), (2, 3, 4, 2)}
    loop = graph.neighbours(spark.createDataFrame([(1, 1, "x"), (1, 2, "x")], "src int, dst int, type string"), spark.createDataFrame([(1,)], "id int"))
    assert loop.count() == 2


def test_first_fit_skips_and_goes_on(spark):
    d = spark.createDataFrame([("g", 1, 6), ("g", 2, 7), ("g", 3, 4), ("g", 4, 1)], "g string, rank int, size int")
    assert [r.rank for r in select.first_fit(d, ["g"], "rank", "size", 10).orderBy("rank").collect()] == [1, 3]
    assert [r.rank for r in select.first_fit(d, ["g"], "rank", "size", 100, most=2).orderBy("rank").collect()] == [1, 2]
    assert [r.rank for r in select.prefix_fit(d, ["g"], [F.col("rank")], "size", 10).collect()] == [1]


def test_top_k_and_first_wins_over_many_partitions(spark):
    r = random.Random(0)
    rows = [(i % 3, i, r.randrange(50)) for i in range(500)]
    d = spark.createDataFrame(rows, "g int, id int, s int").repartition(7)
    want = {(g, i, k + 1) for g in range(3) for k, (_, i) in enumerate(sorted((-s, i) for q, i, s in rows if q == g)[:4])}
    assert {(x.g, x.id, x["rank"]) for x in select.top_k(d, ["g"], [F.desc("s"), F.col("id")], 4).collect()} == want
    assert {(x.g, x.id) for x in select.first_wins(d, ["g"], "id").collect()} == {(0, 0), (1, 1), (2, 2)}


def test_bootstrap_is_reproducible_and_covers_the_mean(spark):
    rows = [(f"f{i % 9}", float(i % 9 > 3) + i / 1000) for i in range(90)]
    one, two = (stats.cluster_bootstrap(spark.createDataFrame(rows, "f string, v double"), "f", "v", 200).first() for _ in range(2))
    assert one == two and one.low <= one["mean"] <= one.high and one.families == 9
    means = sorted((f, sum(v for g, v in rows if g == f) / 10) for f in {f for f, _ in rows})
    place = lambda d, j: int(hashlib.md5(f"{d}:{j}".encode()).hexdigest()[:15], 16) % 9
    assert len({place(d, j) for d in range(20) for j in range(9)}) == 9
    drawn = sorted(sum(means[place(d, j)][1] for j in range(9)) / 9 for d in range(200))
    assert one.low == pytest.approx(drawn[4]) and one.high == pytest.approx(drawn[194])


def test_contained_equals_a_plain_search(spark):
    texts = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "beta"), (3, ""), (4, None), (5, "xbeta gamma\tdelta  epsilonx"), (6, "a b c d e f g h " * 3)]
    quotes = [(1, "beta"), (2, "gamma delta epsilon"), (3, "zeta"), (4, ""), (5, "eta gamma\tdelta  epsilon"), (6, "b c d e f g"), (7, "f g h a b c d e f g h"), (8, None), (9, "lpha beta"), (10, "b c d e f g h i j")]
    want = {(d, i) for d, t in texts for i, q in quotes if t is not None and q and q in t}
    found = retrieval.contained(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, quote string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)


def test_rolling_sum_over_the_edges_of_blocks(spark):
    from datetime import datetime, timedelta

    from quillspan.streaming import rates

    r, start = random.Random(4), datetime(2024, 1, 1, 0, 58)
    rows = [(i, r.choice("ab"), start + timedelta(seconds=r.randrange(400), microseconds=r.choice([0, 1, 999999])), i) for i in range(200)] + [(900, "a", None, 1)]
    got = {x.i: x.used for x in rates.rolling_sum(spark.createDataFrame(rows, "i int, k string, ts timestamp, v long"), "k", "ts", "v").collect()}
    assert len(got) == 201
    for i, k, ts, _ in rows[:200]:
        assert got[i] == sum(v for _, q, t, v in rows[:200] if q == k and timedelta(0) <= ts - t < timedelta(seconds=61))


def test_text_functions(spark):
    d = spark.createDataFrame([("{(a", 1), ("b)", 2), ("{{}}{", 3)], "x string, i int").orderBy("i")
    assert [r.y for r in d.select(balanced(F.col("x")).alias("y")).collect()] == ["{(a})", "(b)", "{{}}{}"]
    assert [r.y for r in d.select(depth(F.col("x")).alias("y")).collect()] == [1, 0, 2]
    got = d.select(embed(F.col("x")).alias("e")).first().e
    assert got == pytest.approx(hash_embedding("{(a").tolist())


def test_records_and_unique_ids(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"id": i, "content": "c", "position": 1}) for i in ("x", "y")))
    d = records.read_records(spark, str(tmp_path / "a.jsonl"))
    assert records.require_unique(d).count() == 2 and d.schema["position"].dataType.simpleString() == "bigint"
    with pytest.raises(Exception, match="repeated or missing"):
        records.require_unique(d.union(d)).collect()


MODULE = """<document xmlns="http://cnx" xmlns:m="http://mm"><content><section><para id="p1">Half is <m:math><m:mfrac><m:mn>1</m:mn><m:mn>2</m:mn></m:mfrac></m:math>.</para>
<equation id="e1"><m:math><m:msup><m:mi>x</m:mi><m:mn>2</m:mn></m:msup><m:mglyph/></m:math></equation></section>
<section class="section-exercises"><exercise id="x1"><problem><para>Find it.</para></problem><solution><para>Secret.</para></solution></exercise></section><para id="p2"><media/></para></content></document>"""


def test_modules(spark):
    rows = records.extract_modules(spark.createDataFrame([("m1", MODULE)], "module_id string, xml string")).collect()
    assert [(r.ordinal, r.kind, r.anchor, r.content, r.role) for r in rows] == [(0, "para", "p1", "Half is ((1)/(2)).", "instruction"), (1, "equation", "e1", "(x)^(2)", "instruction"), (2, "exercise", "x1", "Find it.", "exercise_material"), (3, "para", "p2", "[unrendered-media]", "instruction")]
    assert rows[1].unsupported == ["mglyph"] and not any("Secret" in r.content for r in rows)


def test_page_regions(spark):
    xml = '<page><text left="10" top="10" width="20" height="5">a</text><text left="25" top="12" width="30" height="5">b</text><text left="90" top="90" width="5" height="5">c</text></page>'
    spans = spark.createDataFrame([(xml,)], "x string").select(F.explode(records.page_spans(F.col("x"))).alias("s")).select("s.*")
    assert {(r.content, r.state) for r in records.crop(spans, (0, 0, 50, 50)).collect()} == {("a", "inside"), ("b", "clipped")}


def test_frozen_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    path = f"{tmp_path}/t"
    assert sinks.write_frozen(d, path) and not sinks.write_frozen(d.orderBy(F.desc("i")), path)
    with pytest.raises(ValueError):
        sinks.write_frozen(d.withColumn("s", F.lit("c")), path)


def test_upsert_merges_properties(spark):
    rows = lambda *r: spark.createDataFrame(r, "id int, seq int, props map<string,string>")
    got = sinks.upsert(rows((1, 0, {"a": "x", "b": "y"}), (2, 0, {"a": "z"})), rows((1, 1, {"b": "new", "c": "w"})), "id", "seq").collect()
    assert {r.id: r.props for r in got} == {1: {"a": "x", "b": "new", "c": "w"}, 2: {"a": "z"}}


def test_rolling_window_leaves_out_its_far_edge(spark):
    d = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:01:00.999999", 2), ("k", "2024-01-01 00:01:01", 4)], "k string, ts string, v int")
    assert [r.used for r in rates.rolling_sum(d, "k", "ts", "v").orderBy("ts").collect()] == [1, 3, 6]


def test_streams(spark, tmp_path):
    src, done = tmp_path / "in", f"{tmp_path}/done"
    src.mkdir()
    put = lambda name, rows: (src / name).write_text("\n".join(json.dumps(r) for r in rows))
    stream = lambda: spark.readStream.schema("id int, ts string, v int").json(str(src))
    put("a.json", [{"id": 1, "ts": "2024-01-01 00:00:01", "v": 1}, {"id": 2, "ts": "2024-01-01 00:00:02", "v": 2}])
    run = lambda: rates.resume(stream(), done, "id", f"{tmp_path}/cp", lambda d: d.withColumn("out", F.col("v") * 10)).awaitTermination()
    run()
    put("b.json", [{"id": 2, "ts": "2024-01-01 00:00:02", "v": 9}, {"id": 3, "ts": "2024-01-01 00:02:02", "v": 3}])
    run()
    assert sorted((r.id, r.out) for r in spark.read.parquet(done).collect()) == [(1, 10), (2, 20), (3, 30)]
    q = rates.windowed_rates(stream().withColumn("k", F.lit("k")), "k", "ts", "v").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.used for r in spark.table("rates").collect()) == [3, 12]


def test_ledger_refuses_without_cost(spark):
    d = spark.createDataFrame([("k", 1, 6.0), ("k", 2, 5.0), ("k", 3, 4.0)], "k string, i int, c double")
    assert [(r.i, r.admitted, float(r.spent)) for r in rates.ledger(d, "k", "i", "c", 10).orderBy("i").collect()] == [(1, True, 6.0), (2, False, 6.0), (3, True, 10.0)]


def test_short_quotes_are_found_in_any_text(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "b", " ", "é", "\U0001f600", "word "]) for _ in range(r.randrange(60))) for _ in range(60)] + ["", None, "ab"]
    quotes = ["a", "ab", "word", "word a", "é\U0001f600", "zz", "", "b a", "a b a b", "\U0001f600"]
    found = retrieval.contained(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3), spark.createDataFrame(list(enumerate(quotes)), "j int, quote string"))
    assert sorted((x.i, x.j) for x in found.collect()) == sorted((i, j) for i, t in enumerate(texts) for j, q in enumerate(quotes) if q and t and q in t)


@pytest.mark.parametrize("blocks", [(8192, 1 << 17, 512), (3, 7, 2)])
def test_searches_by_blocks_equal_one_by_one(spark, monkeypatch, blocks):
    for name, value in zip(("QUERY_BLOCK", "VECTOR_BLOCK", "VECTORS_AT_ONCE"), blocks, strict=True):
        monkeypatch.setattr(retrieval, name, value)
    r = random.Random(2)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(5)], r.randrange(4)) for i in range(60)] + [(99, None, 0)]
    asked = rows[:20:2] + [(100, None, 1), (101, [0.0] * 5, -1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    queries = spark.createDataFrame([(i, v, c) for i, v, c in asked], "query_id long, query array<float>, chapter int")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    every = {(q, i): dot(a, b) for q, a, _ in asked if a for i, b, _ in rows if b}
    assert {(x.query_id, x.vec_id): x.score for x in retrieval.scored(vectors, queries).collect()} == every
    for limit in (None, ("label", "chapter")):
        want = {}
        for q, a, c in asked:
            if a:
                near = sorted((-dot(a, b), i) for i, b, label in rows if b and (limit is None or label <= c))[:4]
                want |= {(q, n + 1): i for n, (_, i) in enumerate(near)}
        assert {(x.query_id, x.rank): x.vec_id for x in retrieval.nearest(vectors, queries, 4, limit=limit).collect()} == want
    plan = retrieval.nearest(vectors, queries, 4)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_every_pair_of_blocks_is_a_task(spark, monkeypatch):
    """Small tables can have very many pairs, so what a task reads says nothing of how long it takes."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 100)
    vectors = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    tasks = [r["count"] for r in retrieval.scored(vectors, queries).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 20_000 and len(tasks) == 20 and max(tasks) <= 2000


def test_several_queries_share_an_index(spark):
    r = random.Random(4)
    words = "river stone light garden quiet morning letter shadow".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = spark.createDataFrame([(g, f"{g}-{i}", text(12)) for g in "ab" for i in range(8)], "g string, p string, content string")
    queries = [(g, f"q{i}", text(3)) for g in "ab" for i in range(4)]
    together = retrieval.tf_idf(passages, spark.createDataFrame(queries, "g string, q string, question string"), "g", "p", query="q")
    found = {(x.g, x.q, x.p): round(x.score, 9) for x in together.collect()}
    alone = {}
    for g, q, question in queries:
        one = retrieval.tf_idf(passages, spark.createDataFrame([(g, question)], "g string, question string"), "g", "p")
        alone |= {(g, q, x.p): round(x.score, 9) for x in one.collect()}
    assert found == alone and len(found) > 20


def test_an_index_has_parts_by_its_characters(spark, monkeypatch):
    passages = spark.range(300).select((F.col("id") % 7).alias("g"), F.col("id").alias("p"), F.concat_ws(" ", F.lit("river stone"), F.hex("id"), F.hex(F.col("id") % 5)).alias("content"))
    queries = spark.range(7).select(F.col("id").alias("g"), F.lit("stone river 2F 3").alias("question"))
    held, found = passages.agg(F.sum(F.length("content"))).first()[0], []
    for chars, parts in ((1 << 22, 4), (100, -(-held // 100))):
        monkeypatch.setattr(retrieval, "CHARS", chars)
        scores = retrieval.tf_idf(passages, queries, "g", "p", "tokens")
        assert f", {parts}), REPARTITION_BY_NUM" in scores._jdf.queryExecution().toString()
        found.append({(r.g, r.p): round(r.score, 9) for r in scores.collect()})
    assert found[0] == found[1] and len(found[0]) == 300
