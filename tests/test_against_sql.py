"""Queries against their SQL on odd documents, and on pairs and vectors where the shape of the work counts."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from talentloom.llm import search
from talentloom.operators import matching, scoring, taxonomy

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "\n", "\t", "a\n\n\t\n\nb", "a\rb\n\n \n", "one\n\n\n\ntwo\n", "x y\n \nz", "", "plain"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with documents of odd texts."""
    root = str(tmp_path_factory.mktemp("odd"))
    ids = [i for i in range(1, 400) if all(i % p for p in (5, 7, 11, 13))]
    rows = [(ids[i], t, "en", "web", len(t)) for i, t in enumerate(TEXTS)] + [(11, "", "en", "web", 0), (13, "a", "en", "web", 1), (700, "", "fr", "web", 0), (901, "huge", "fr", "web", 1 << 30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{root}/documents.parquet")
    return root


def same_as_sql(spark, name, root, tables):
    with duckdb.connect() as con:
        for t in tables:
            con.execute(f"create view {t} as select * from read_parquet('{root}/{t}.parquet/*.parquet')")
        for t in ("part", "customer", "orders", "lineitem"):
            if t not in tables:
                con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        got = __spark_entry__.queries()[name](spark, root)
        told = con.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(told)


def test_lines_of_odd_texts(spark, odd):
    same_as_sql(spark, "line_counts", odd, ["documents"])


def test_blocks_of_odd_texts(spark, odd):
    same_as_sql(spark, "plain_text_blocks", odd, ["documents"])


def test_uploads_with_odd_sizes(spark, odd):
    same_as_sql(spark, "upload_checks", odd, ["documents"])


def test_validated_uploads_with_odd_sizes(spark, odd):
    same_as_sql(spark, "validated_uploads", odd, ["documents"])


def test_streamed_uploads_with_odd_sizes(spark, odd):
    same_as_sql(spark, "streamed_documents", odd, ["documents"])


def _pairs_plan(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["dimension_scores", "gaps", "recommendation_details"])
def test_pairs_travel_without_facts_and_demands(spark, name):
    """Of the steps that deal by candidate only one is Spark's own: that of pairs with their demands' numbers; facts are dealt as keys."""
    dealt = [x for x in _pairs_plan(spark, name).split("\n") if "Exchange hashpartitioning(candidate_id" in x]
    assert sum("ENSURE_REQUIREMENTS" in x for x in dealt) == 1


@pytest.mark.parametrize("bound", ["KINDS", "KIND_LENGTH"])
def test_pairs_with_too_many_different_demands(spark, monkeypatch, bound):
    """Where demands are too many to be held by every task, each pair carries its own, with the same results."""
    query = __spark_entry__.queries()["pair_evaluations"]
    few = Counter(map(tuple, query(spark, SF).collect()))
    monkeypatch.setattr(matching, bound, 3)
    assert Counter(map(tuple, query(spark, SF).collect())) == few


def test_grid_is_counted_without_its_pairs(spark, monkeypatch):
    assert "explode(jobs" not in _pairs_plan(spark, "eligible_grid")
    monkeypatch.setattr(scoring, "BLOCK", 2)
    rows = [(f"c{i}", "CV", "PROCESSED" if i else "FAILED") for i in range(3)] + [(f"j{i}", "JOB_OFFER", "PROCESSED" if i else "FAILED") for i in range(8)]
    docs = spark.createDataFrame(rows, "document_id string, document_type string, status string")
    pairs = Counter(r.candidate_id for r in scoring.eligible_grid(docs).collect())
    assert pairs == {"c1": 7, "c2": 7}
    assert {tuple(r) for r in scoring.eligible_counts(docs).collect()} == {(c, n, "j1") for c, n in pairs.items()}


@pytest.mark.parametrize("held", [True, False])
def test_many_plain_forms_are_looked_up_as_runs(spark, monkeypatch, held):
    """Beyond the automaton's bounds only texts that lower case alone makes ASCII go by the slow join."""
    texts = ["The Rust, rust and go1 gone", "", None, "rusty go1", "go1érust RUST", "Kelvin go1 kelvin", "x" * 50 + " go1", "go1_rust.kelvin"]
    forms = [("rust", "Rust"), ("go1", "Go"), ("kelvin", "K"), ("elvin", "E"), ("x", "X")]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, t string")
    slow, join = [], taxonomy.joined_mentions
    monkeypatch.setattr(taxonomy, "AUTOMATON_FORMS", 0)
    monkeypatch.setattr(taxonomy, "joined_mentions", lambda d, *a: slow.append(d.count()) or join(d, *a))
    monkeypatch.setattr(taxonomy, "RUN_FORMS", 100 if held else 0, raising=False)
    got = {r.document_id: r.mentions for r in taxonomy.mention_table(docs, "t", spark.createDataFrame(forms, "form string, canonical_name string")).collect()}
    made = taxonomy.form_automaton(forms)
    assert got == {i: taxonomy.mentions_of(t, made) for i, t in enumerate(texts)} and slow == [1]


def test_tasks_send_few_rows_for_pivots(spark):
    """A sample for the pivots is the same for any number of partitions, and few rows more than it are ordered."""
    rows = spark.range(0, 40_000, 1, 50).select(F.col("id").alias("num"))
    want = sorted(r.num for r in rows.orderBy(F.xxhash64(F.lit(3), "num")).limit(300).collect())
    chosen = search.lowest(rows, 300, 40_000)
    assert sorted(r.num for r in chosen.collect()) == want and search.lowest(rows, 300, 200).count() == 300
    ordered = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in ordered and 300 <= rows.filter(F.xxhash64(F.lit(3), "num") < 1600 * (1 << 64) // 40_000 - (1 << 63)).count() <= 2000


def test_analyses_meet_scores_at_their_candidates(spark):
    """The only step that deals by pair is that of the pairs without a job (none as a rule)."""
    assert len(re.findall(r"Exchange hashpartitioning\(candidate_id#\w+, job_id", _pairs_plan(spark, "run_analyses"))) == 1
