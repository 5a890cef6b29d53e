"""Taxonomy, matching rules, scores, recommendations."""

import hashlib
import random
import time

import pytest

from pyspark.sql import functions as F

from talentloom import config
from talentloom.operators import matching, recommend, scoring, semantic, taxonomy
from talentloom.functions import text as T

YEAR = 2026
EXPERIENCE = "candidate_id long, idx int, title string, company string, start_date_raw string, end_date_raw string, technologies array<string>, achievements array<string>, seniority string, description string"


def skills(spark):
    rows = [("Python", "PROGRAMMING_LANGUAGE", None, None, 0), ("Django", "FRAMEWORK", "Python", "py", 1), ("Flask", "FRAMEWORK", None, "py", 2), ("C++", "PROGRAMMING_LANGUAGE", None, None, 3), ("Kubernetes", "DEVOPS", None, None, 4), ("React Native", "MOBILE", None, None, 5), ("React", "WEB", None, None, 6)]
    return spark.createDataFrame(rows, "canonical_name string, category string, parent_skill string, ecosystem string, taxonomy_idx int")


def aliases(spark):
    return spark.createDataFrame([("py3", "Python"), ("k8s", "Kubernetes"), ("python", "Flask")], "alias string, canonical_name string")


def relations(spark):
    return spark.createDataFrame([("Kubernetes", "Flask", "USED_WITH", 0)], "from_skill string, to_skill string, relation_type string, rel_idx int")


def test_scan_mentions(spark):
    forms = taxonomy.surface_forms(skills(spark), aliases(spark))
    df = spark.createDataFrame([(0, "I know C++, PY3 and React Native."), (1, "React Natives, Pythonic"), (2, None), (3, "python Python k8s")], "n int, t string")
    got = {r.n: r.m for r in df.select("n", taxonomy.scan_mentions(F.col("t"), forms).alias("m")).collect()}
    assert got == {0: ["C++", "Python", "React Native"], 1: ["React"], 2: [], 3: ["Python", "Kubernetes"]}


def test_taxonomy_tables(spark):
    index = {r.skill_key: r.canonical_name for r in taxonomy.build_alias_index(skills(spark), aliases(spark)).collect()}
    assert index["python"] == "Python" and index["c++"] == "C++" and index["reactnative"] == "React Native"
    got = [(r.canonical_name, r.related_skill, r.relation_type, r.rel_rank) for r in taxonomy.related_skills(skills(spark), relations(spark)).collect()]
    assert set(got) == {("Django", "Python", "CHILD_OF", 1), ("Python", "Django", "PARENT_OF", 1), ("Django", "Flask", "PART_OF_ECOSYSTEM", 2), ("Flask", "Django", "PART_OF_ECOSYSTEM", 1), ("Kubernetes", "Flask", "USED_WITH", 1)}
    assert taxonomy.check_taxonomy(skills(spark), aliases(spark), relations(spark)).count() == 0
    bad = taxonomy.check_taxonomy(skills(spark), aliases(spark).unionByName(spark.createDataFrame([("x", "Nope")], "alias string, canonical_name string")), relations(spark))
    assert [r.problem for r in bad.collect()] == ["alias of unknown skill"]


def evaluate(spark, model=None):
    pairs, demands, facts = tables(spark)
    vectors = None if model is None else semantic.embedded(demands, facts, [("model", 2, model)])
    return matching.evaluate_pairs(pairs, demands, facts, YEAR, vectors)


def tables(spark, raw="py3", description="Built billing services for shops"):
    held = spark.createDataFrame([(1, 0, raw, "Python", "PROGRAMMING_LANGUAGE"), (1, 1, "Flask", "Flask", "FRAMEWORK"), (1, 2, "Juggling", None, None)], "candidate_id long, idx int, raw_text string, canonical_name string, category string")
    worked = spark.createDataFrame([
        (1, 0, "Senior Dev", "Acme", "Jan 2010", "2014", ["Flask"], [], "SENIOR", description),
        (1, 1, "Dev", "Other", "2013", None, [], [], "UNKNOWN", None), (2, 0, "Dev", None, "no date", "2014", ["Flask"], [], None, None),
    ], EXPERIENCE)
    none = lambda schema: spark.createDataFrame([], schema)
    projects = none("candidate_id long, idx int, name string, technologies array<string>")
    school = spark.createDataFrame([(1, 0, "MASTER"), (1, 1, "BACHELOR")], "candidate_id long, idx int, degree_level string")
    papers = spark.createDataFrame([(1, 0, "Cloud  Architect Professional", "Org")], "candidate_id long, idx int, name string, issuer string")
    spoken = spark.createDataFrame([(1, 0, "English", "ADVANCED")], "candidate_id long, idx int, canonical_name string, proficiency_normalized string")
    facts = matching.candidate_facts(held, worked, projects, school, papers, spoken)
    asked = [
        (7, 0, "REQUIRED_SKILL", "REQUIRED", "Python", "Python", "PROGRAMMING_LANGUAGE", None, None), (7, 1, "REQUIRED_SKILL", "REQUIRED", "Flask", "Flask", "FRAMEWORK", None, None),
        (7, 2, "PREFERRED_SKILL", "PREFERRED", "Kubernetes", "Kubernetes", "DEVOPS", None, None), (7, 3, "REQUIRED_SKILL", "REQUIRED", "C++", "C++", "PROGRAMMING_LANGUAGE", None, None),
        (7, 4, "REQUIRED_SKILL", "REQUIRED", "flas", None, None, None, None), (7, 5, "EXPERIENCE", "REQUIRED", "5+ years", None, None, 5, None), (7, 6, "EXPERIENCE", "REQUIRED", "5 years Flask", None, None, 5, "Flask"),
        (7, 7, "EDUCATION", "PREFERRED", "PhD", None, None, None, "DOCTORATE"), (7, 8, "CERTIFICATION", "REQUIRED", "cloud architect", None, None, None, None),
        (7, 9, "LANGUAGE", "REQUIRED", "English B2", None, None, None, None), (7, 10, "LANGUAGE", "PREFERRED", "German", None, None, None, None), (7, 11, "OTHER", "REQUIRED", "Patience", None, None, None, None),
    ]
    requirements = spark.createDataFrame(asked, "job_id long, idx int, requirement_type string, importance string, raw_text string, canonical_name string, category string, minimum_years int, normalized_value string")
    jobs = spark.createDataFrame([(7, "LEAD", ["Built billing services", "Sing songs"])], "job_id long, seniority_normalized string, responsibilities array<string>")
    demands = matching.job_demands(jobs, requirements, taxonomy.related_skills(skills(spark), relations(spark)))
    pairs = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "candidate_id long, job_id long")
    return pairs, demands, facts


def test_rules_of_all_dimensions(spark):
    evals = evaluate(spark).cache()
    got = {(r.candidate_id, r.dimension, r.raw_text): (r.status, r.match_signal, r.matched_skill) for r in evals.collect()}
    one = {k[1:]: v for k, v in got.items() if k[0] == 1}
    assert one["skills", "Python"] == ("MET", "ALIAS_MATCH", "Python")
    assert one["skills", "Flask"] == ("MET", "EXACT_MATCH", "Flask")
    assert one["skills", "Kubernetes"] == ("PARTIALLY_MET", "RELATED_MATCH", "Flask")
    assert one["skills", "C++"] == ("NOT_MET", "NO_EVIDENCE", None)
    assert one["skills", "flas"] == ("PARTIALLY_MET", "PARTIAL_MATCH", "Flask")
    assert one["experience", "5+ years"][0] == "MET" and one["experience", "5 years Flask"][0] == "PARTIALLY_MET"
    assert one["seniority", "LEAD"] == ("PARTIALLY_MET", "PARTIAL_MATCH", None)
    assert one["education", "PhD"][0] == "PARTIALLY_MET" and one["certifications", "cloud architect"][0] == "PARTIALLY_MET"
    assert one["languages", "English B2"][0] == "MET" and one["languages", "German"][0] == "NOT_MET"
    assert one["responsibilities", "Built billing services"][0] == "PARTIALLY_MET" and one["responsibilities", "Sing songs"][0] == "NOT_MET"
    assert one["domain", "Domain alignment"][0] == "MET"
    assert got[2, "experience", "5 years Flask"][0] == "UNKNOWN" and got[3, "experience", "5+ years"][0] == "NOT_MET"
    assert got[3, "seniority", "LEAD"][0] == "UNKNOWN" and got[3, "education", "PhD"][0] == "UNKNOWN"
    order = [r.dimension for r in evals.filter("candidate_id = 1").orderBy("eval_idx").collect()]
    assert order == sorted(order, key=config.DIMENSIONS.index) and len(order) == 15
    plan = evals._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_scores_and_gaps(spark):
    evals = evaluate(spark)
    row = scoring.score_breakdown(evals).filter("candidate_id = 1").first()
    means = {r.dimension: r.score for r in scoring.dimension_scores(evals).filter("candidate_id = 1").collect()}
    raw = sum(means[d] * w for d, w in config.WEIGHTS.items()) - 0.15
    assert row.overall == round(raw, 4) and row.mandatory_gaps == 1 and row.n_skills == 5
    assert {r.status for r in evals.join(scoring.detect_gaps(evals).select("candidate_id", "job_id", "eval_idx"), ["candidate_id", "job_id", "eval_idx"]).collect()} == {"NOT_MET", "PARTIALLY_MET", "UNKNOWN"}
    assert scoring.requirement_summary(evals).filter("candidate_id = 1").first().total == 15


def test_penalty_cap_and_empty(spark):
    rows = [(1, 7, "skills", "MANDATORY", "NOT_MET", 0.0)] * 5 + [(1, 7, "education", "PREFERRED", "MET", 1.0)] * 3
    df = spark.createDataFrame(rows, "candidate_id long, job_id long, dimension string, priority string, status string, score double")
    row = scoring.score_breakdown(df).first()
    assert row.mandatory_gap_penalty == 0.6 and row.overall == 0.0
    assert scoring.score_breakdown(df.filter(F.lit(False))).count() == 0


def test_semantic_match(spark):
    same = lambda texts: [[1.0, 1.0]] * len(texts)
    got = {(r.dimension, r.raw_text): (r.match_signal, r.match_strength, r.confidence) for r in evaluate(spark, same).filter("candidate_id = 1").collect()}
    assert got["skills", "C++"] == ("SEMANTIC_MATCH", "GOOD", 0.9) and got["responsibilities", "Sing songs"][0] == "SEMANTIC_MATCH"
    assert got["skills", "Flask"][0] == "EXACT_MATCH"
    digest = hashlib.sha256("Go".encode()).digest()
    vector = spark.createDataFrame([("Go",)], "t string").select(T.hash_embedding(F.col("t"), 40).alias("v")).first().v
    assert vector == [digest[i % 32] / 127.5 - 1 for i in range(40)]


def test_a_grid_is_evaluated_without_a_pair_table(spark):
    _, demands, facts = tables(spark)
    jobs = [7, 8, 9, 10]
    demands = demands.drop("job_id").crossJoin(spark.createDataFrame([(j,) for j in jobs], "job_id long"))
    evals = matching.evaluate_grid(demands, facts, YEAR, candidate_blocks=3, job_blocks=2)
    scores = scoring.score_breakdown(evals, keys=("tile", "candidate_id", "job_id"))
    pairs = facts.select("candidate_id").crossJoin(spark.createDataFrame([(j,) for j in jobs], "job_id long"))
    want = scoring.score_breakdown(matching.evaluate_pairs(pairs, demands, facts, YEAR))
    assert sorted(map(str, scores.drop("tile").collect())) == sorted(map(str, want.collect())) and scores.count() == 8
    plan = scores._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert "Exchange" not in above  # from the open pairs to their scores nothing is shuffled


def test_only_demands_that_read_a_changed_fact_are_judged_anew(spark):
    pairs, demands, facts = tables(spark)
    before = matching.evaluate_pairs(pairs, demands, facts, YEAR)
    for told, raw, description in (([("experience:0", True)], "py3", "Sing songs all day"), ([("skill:0", True), ("experience:0", False)], "Python", "Built billing services for shops"), ([], "py3", "Built billing services for shops")):
        changes = spark.createDataFrame([(1, f, ok) for f, ok in told], "document_id long, fact_id string, accepted boolean")
        _, _, now = tables(spark, raw, description)
        after, anew = matching.reevaluate_pairs(before, pairs, demands, now, changes, YEAR)
        want = matching.evaluate_pairs(pairs, demands, now, YEAR)
        assert sorted(map(str, after.collect())) == sorted(map(str, want.collect()))
        kinds = {(r.candidate_id, r.dimension) for r in anew.collect()}
        assert kinds == {(1, matching.READ_BY[f.split(":")[0]]) for f, ok in told if ok}
        assert anew.count() < want.count() / 3


def test_nearest_against_all_pairs():
    import numpy as np

    r = np.random.default_rng(1)
    unit = lambda n: (v := r.normal(size=n)) / np.sqrt(v @ v)
    for _ in range(50):
        own = [(p, unit(int(r.choice([3, 5])))) for p in range(int(r.integers(0, 6)))]
        asked = [(bool(r.integers(2)), None if r.random() < 0.2 else unit(3)) for _ in range(5)]
        got = semantic.nearest([None if v is None else v.tobytes() for _, v in asked], [k for k, _ in asked], [{"place": p, "unit": v.tobytes()} for p, v in own])
        for (skill, v), (score, place) in zip(asked, got, strict=True):
            fits = [] if v is None else [(float(v @ w), -p) for p, w in own if (p == 0) == skill and len(w) == len(v)]
            want = max(fits, default=(0.0, 1))
            assert (score, place) == (pytest.approx(want[0]), -want[1]) if fits and (skill or want[0] > 0) else (score, place) == (0.0, -1)


def test_each_text_is_embedded_once(spark):
    count = spark.sparkContext.accumulator(0)

    def model(texts):
        count.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    evaluate(spark, model).collect()
    assert 0 < count.value <= 8  # Python, Flask, Kubernetes, C++, two lines, a description, the skills of the two candidates


def test_stored_facts_are_not_shuffled(spark):
    facts = spark.range(100).select(F.col("id").alias("candidate_id"), F.lit("x").alias("skill_names"))
    stored = matching.store_facts(facts, "facts_by_candidate", 4)
    pairs = spark.range(300).select((F.col("id") % 100).alias("candidate_id"), F.col("id").alias("job_id"))
    joined = pairs.hint("merge").join(stored, "candidate_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and joined.count() == 300
    spark.sql("drop table facts_by_candidate")


def test_mention_table_finds_what_the_scan_finds(spark):
    forms = taxonomy.surface_forms(skills(spark), aliases(spark))
    texts = ["I know C++, PY3 and React Native.", "React Natives, Pythonic", None, "", "python Python k8s", "C++C++ C++", "React Native React", "x.Python", "pythonpy3", "(django)flask Flask"]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, t string")
    want = {r.document_id: r.m for r in df.select("document_id", taxonomy.scan_mentions(F.col("t"), forms).alias("m")).collect()}
    table = taxonomy.form_table(skills(spark), aliases(spark))
    assert {r.document_id: r.mentions for r in taxonomy.mention_table(df, "t", table).collect()} == want
    assert {r.document_id: r.mentions for r in taxonomy.joined_mentions(df, "t", table).collect()} == want


def test_mentions_of_a_hundred_thousand_forms(spark):
    """The automaton, the join, and a plain search say the same; the automaton takes one pass."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcé+.# İ") for _ in range(r.randint(1, 7))).strip()
    forms = {taxonomy.folded(f): f"N{i % 60_000}" for i, f in enumerate(x for x in (word() for _ in range(400_000)) if x)}
    assert len(forms) >= 100_000
    texts = [" ".join(word() for _ in range(25)) for _ in range(60)] + [None, "", "+", "İİ ab"]

    def plain(text):
        out, i = [], 0
        text = text or ""
        low, longest = taxonomy.folded(text), 7
        free = lambda k: k < 0 or k >= len(text) or not (text[k].isascii() and text[k].isalnum())
        while i < len(text):
            hit = next((n for n in range(longest, 0, -1) if i + n <= len(text) and low[i : i + n] in forms and free(i - 1) and free(i + n)), 0)
            if hit:
                out.append(forms[low[i : i + hit]])
            i += hit or 1
        return list(dict.fromkeys(out))

    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, t string").withColumn("mentions", F.lit("x")).withColumn("form", F.lit("y"))
    table = spark.createDataFrame(list(forms.items()), "form string, canonical_name string")
    got = {x.document_id: x.mentions for x in taxonomy.mention_table(df, "t", table).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    automaton = taxonomy.form_automaton(list(forms.items()))
    began = time.process_time()
    taxonomy.mentions_of(" ".join(word() for _ in range(200_000)), automaton)
    assert time.process_time() - began < 10


def test_recommendations(spark):
    recs = {(r.type, r.title): r for r in recommend.recommend(evaluate(spark)).filter("candidate_id = 1").collect()}
    assert recs["MISSING_REQUIREMENT", "Missing skill: C++"].priority == "CRITICAL"
    assert recs["KEYWORD_PLACEMENT", "Use the canonical name for Python"].safety == "SAFE_TO_REPHRASE"
    assert recs["UNDERREPRESENTED_SKILL", "Clarify Kubernetes experience"].priority == "MEDIUM"
    assert recs["MISSING_REQUIREMENT", "Missing education requirement: PhD"].priority == "HIGH"
    assert not [k for k in recs if "Flask" in k[1] and k[0] == "MISSING_REQUIREMENT" and "skill" in k[1]]


def test_dedupe_and_cap(spark):
    rows = [(1, 1, i, "T", f"t{i % 12}", p, "x") for i, p in enumerate(["LOW"] * 12 + ["MEDIUM"] * 6 + ["CRITICAL"] * 10)]
    df = spark.createDataFrame(rows, "candidate_id long, job_id long, related_requirement_index int, type string, title string, priority string, safety string")
    got = recommend.dedupe_and_cap(df).orderBy("rec_idx").collect()
    assert sum(r.priority == "CRITICAL" for r in got) == 10 and len(got) == 12
    assert [r.rec_idx for r in got] == list(range(12))
