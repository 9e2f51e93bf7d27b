"""Queries on rows that the test tables don't have, each against its SQL."""

import duckdb
import pytest

import __spark_entry__


@pytest.fixture
def same(spark, tmp_path):
    """Asserts that a query and its SQL return the same rows over the tables given, and returns these."""

    def run(name: str, **tables: tuple[str, list[tuple]]) -> list[tuple]:
        con = duckdb.connect()
        for table, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        found = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(found, key=repr) == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=repr)
        return found

    return run


def test_responses_of_other_blanks_and_letters(same):
    texts = [None, "", "  ", "\n", " \t", " \n", " ", "　  ", "\u0085", "Yes", "yes.", "yesé", "no³", "NO_", "nothing", "no1", "yes\nno", " yes", " yes", "nó"]
    assert len(same("scf_25_response_score", conversations=("conv_id long, turn int, text string", [(1, i, t) for i, t in enumerate(texts)]))) == len(texts)


def test_lines_that_end_in_their_own_number(same):
    texts = [None, "", " \n ", "a 0\nb 11\n 2 c\n3", "0", "1\n1\n1", "\t\n x \n", "\n".join(map(str, range(14)))]
    assert len(same("scf_28_task_spans", documents=("doc_id long, text string", list(enumerate(texts))))) == 27


def test_every_document_has_its_alias(same):
    found = same("win_11_blinding", documents=("doc_id long, text string", [(i * 3, "t") for i in range(250)] + [(None, "t")]))
    assert len({a for _, a in found}) == len(found) == 251


@pytest.mark.parametrize("name", ["src_11_crop", "scf_09_latex_normal", "scf_17_plain_text", "rul_20_equivalence", "rul_23_answers", "scf_39_bounded", "rul_14_heater"])
def test_heavy_expressions_are_dealt_out(spark, name):
    """A small file is one task to read, but not to compute from."""
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_formulas_of_repeated_parts(same):
    part = ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(1, "a", "Brand#12", "t", 3, 1.0)] * 2 + [(2, "b", "Brand#34", "t", 4, 1.0)])
    assert len(same("scf_09_latex_normal", part=part)) == 6


def test_no_spans_are_broadcast(spark, monkeypatch):
    """Spans explode from small files, whose sizes say nothing of theirs."""
    from quillspan.operators import regions

    plans = {}
    keep = regions.Rounds.keep
    monkeypatch.setattr(regions.Rounds, "keep", lambda self, name, make: (plans.update({name: make._jdf.queryExecution().executedPlan().toString()}), keep(self, name, make))[1])
    once = spark.createDataFrame([(1, i, c, 4.0 * i, 0.0, 4.0 * i + 4, 10.0) for i, c in enumerate("ab=cd")], "page long, n long, text string, x0 double, y0 double, x1 double, y1 double")
    box = spark.createDataFrame([(1, 0, 0.0, 12.0, 40.0, 22.0)], "page long, region int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.sn for r in regions.preceding(once, box).collect()) == [0, 1, 2, 3, 4]
    assert "goes-on" in plans and not any("BroadcastHashJoin" in plans[name] for name in ("goes-on", "new-0"))


def test_a_study_writes_answers_alone(spark, tmp_path):
    """Cases, not what is planned for them, are dealt out; no key is written, and nothing is joined."""
    from quillspan.operators import studies
    from quillspan.operators.rounds import Rounds

    cases = spark.createDataFrame([(i, "q", "PASS", True, [("1", "rule")], []) for i in range(9)], "case_id int, question string, expected string, complete boolean, full array<struct<id:string,text:string>>, none array<struct<id:string,text:string>>")
    found = studies.run_study(cases, ["a", "b"], ["x"], {"with": "full", "without": "none"}, lambda r: '{"status": "PASS", "citations": ["1"], "missing": []}', Rounds(spark, folder=f"file://{tmp_path}/s"))
    assert [p.name for p in (tmp_path / "s").iterdir()] == ["calls"] and spark.read.parquet(f"file://{tmp_path}/s/calls").count() == 9
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.arm, r.verdict) for r in found.collect()) == [("with", "PASS")] * 18 + [("without", "ERROR")] * 18


def test_whole_numbers_are_reckoned_as_integers(monkeypatch):
    """A column of sums of whole numbers makes no fraction, and reads its claim once."""
    from fractions import Fraction

    from quillspan.functions import kernels

    assert kernels.exact_calc("1 / 3 + 0.5", "5/6") == ("5/6", True, None) and kernels.exact_calc("6 / 3", "2") == ("2", True, None)
    kernels.claimed_value("50/2")
    made = []
    monkeypatch.setattr(kernels, "Fraction", lambda *v: made.append(v) or Fraction(*v))
    assert kernels.exact_calc("5 * (7) - 10", "50/2") == ("25", True, None) and not made


def test_definitions_are_made_once(spark, tmp_path):
    """Rounds read a written table of definitions, not the lines that it is made of."""
    from quillspan.operators import definitions
    from quillspan.operators.rounds import Rounds

    rules = spark.createDataFrame([(1, "a", "b", None, 2, True), (1, "b", None, None, 3, True)], "case int, node string, left string, right string, offset long, seen boolean")
    cases = spark.createDataFrame([(1, "a", 5, 20, False)], "case int, root string, x long, claim long, preview boolean")
    found = definitions.verdicts(rules, cases, Rounds(spark, folder=f"file://{tmp_path}/d")).collect()
    assert [tuple(r) for r in found] == [(1, "PASS", 20, ["a", "b"])]
    assert {"definitions", "cases"} <= {p.name for p in (tmp_path / "d").iterdir()}


def test_a_ranking_is_made_once(spark, tmp_path):
    """Both ends of a list read the written ranking, not the passages that it is made of."""
    from quillspan.operators import references
    from quillspan.operators.rounds import Rounds

    passages = spark.createDataFrame([(1, c, "see passage dc" if c == "a" else "") for c in "abcd"], "case int, id string, text string")
    ranking = spark.createDataFrame([(1, c, i) for i, c in enumerate("abdcx")], "case int, id string, rank int")
    found = references.follow(passages, ranking, r"passage d(\w)", rounds=Rounds(spark, folder=f"file://{tmp_path}/r"))
    assert sorted((r.place, r.id, r.how) for r in found.collect()) == [(0, "a", "ranked"), (1, "b", "ranked"), (2, "c", "referred"), (3, "d", "filled")]
    assert spark.read.parquet(f"file://{tmp_path}/r/ranking").count() == 4
