"""Sections, extraction, claims, tailoring, storage, views, streaming, registry."""

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from talentloom import config
from talentloom.headings import HEADINGS
from talentloom.operators import candidate, sections, tailoring, taxonomy, truth, views
from talentloom.plans import ORACLES, QUERIES, document_queries
from talentloom.sources import documents as storage
from talentloom.sources import store
from talentloom.streaming import intake, state
from tests.test_matching import aliases, skills

CV = """Jane Doe
jane@x.org | +1 415 555 0199
Paris, France

SUMMARY
Builds things.

EXPERIENCE
Engineer at Acme
January 2020 - Present
- Did this
Technologies: Python, Go
Senior Dev Févr. - Juin 2019
Globex, Lyon
Some words.

SKILLS
Python, k8s; Unknown
"""


def found(spark, text=CV):
    docs = spark.createDataFrame([("d", text), ("empty", ""), ("null", None)], "document_id string, raw_text string")
    return docs, sections.detect_sections(docs)


def test_sections(spark):
    _, got = found(spark)
    rows = {r.section_idx: r for r in got.filter("document_id = 'd'").collect()}
    assert [rows[i].section_type for i in sorted(rows)] == ["OTHER", "SUMMARY", "EXPERIENCE", "SKILLS"] and rows[1].body_text == "Builds things."
    assert got.filter("document_id <> 'd'").count() == 0
    score = lambda t: sections.heading_score(F.struct(F.lit(t).alias("text"), F.lit(None).cast("double").alias("font_size"), F.lit(None).cast("boolean").alias("is_bold"), F.lit(False).alias("is_heading_style")), F.lit(None).cast("double"))
    row = spark.range(1).select(*[score(t).alias(f"c{i}") for i, t in enumerate(["Skills", "AWS", "5+ years of experience here", "Skills.", "x" * 46, "EDUCATION"])]).first()
    assert [round(v, 2) for v in row] == [0.85, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_experiences(spark):
    _, got = found(spark)
    rows = {r.idx: r for r in candidate.extract_experiences(got).collect()}
    assert (rows[0].title, rows[0].company, rows[0].start_date_raw, rows[0].end_date_raw, rows[0].is_current) == ("Engineer", "Acme", "January 2020", "Present", True)
    assert rows[0].achievements == ["Did this"] and rows[0].technologies == ["Python", "Go"]
    assert (rows[1].title, rows[1].company, rows[1].location, rows[1].end_date_raw, rows[1].description) == ("Senior Dev", "Globex", "Lyon", "Juin 2019", "Some words.")
    index = taxonomy.build_alias_index(skills(spark), aliases(spark))
    assert [r.canonical_name for r in candidate.extract_skills(got, index).orderBy("idx").collect()] == ["Python", "Kubernetes", None]


def test_claims(spark):
    rows = [(0, "Used Python", "Used Python and Kubernetes", [], None), (1, "AWS", "AWS certified", [], None), (2, "Worked", "Worked 5 years", [], 2.0), (3, "Worked", "Worked 2 years", [], 2.0), (4, "x", "y 3 years", [], None), (5, "x", "k8s", ["Kubernetes"], None)]
    df = spark.createDataFrame(rows, "n int, original_text string, proposed_text string, known array<string>, verified_years double").withColumns({"highest_education": F.lit(None).cast("string"), "verified_proficiency": F.lit(None).cast("string")})
    got = {r.n: [v.reason for v in r.violations] for r in truth.validate_claims(df, taxonomy.surface_forms(skills(spark), aliases(spark))).collect()}
    assert got == {0: ["UNSUPPORTED_TECHNOLOGY"], 1: ["UNSUPPORTED_CERTIFICATION"], 2: ["DURATION_INFLATION"], 3: [], 4: ["DURATION_INFLATION"], 5: []}


def test_word_diff(spark):
    row = spark.createDataFrame([("a b c", "a x c d"), (None, "")], "a string, b string").select(tailoring.word_diff(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(s.text, s.change_type) for s in row[0].d] == [("a", "UNCHANGED"), ("b", "REMOVED"), ("x", "ADDED"), ("c", "UNCHANGED"), ("d", "ADDED")] and row[1].d == []


def test_word_diffs_cover_every_line(spark, tmp_path):
    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "a\nb c"), (2, "a\nb d\ne")], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source").write.parquet(path)
    rows = document_queries.word_diffs(SimpleNamespace(documents=spark.read.parquet(path))).collect()
    assert [(r.doc_id, [(s.text, s.change_type) for s in r["diff"]]) for r in rows] == [(1, [("a b", "UNCHANGED"), ("c", "REMOVED"), ("d e", "ADDED")])]


UPLOAD = "document_id string, owner_id string, document_type string, original_filename string, mime_type string, file_size long, content binary, file_hash string, status string, created_at timestamp"


def uploads(spark, rows):
    import hashlib
    from datetime import datetime

    made = [(i, o, "CV", f"{i}.txt", "text/plain", len(b), b, hashlib.sha256(b).hexdigest(), "UPLOADED", datetime(2026, 1, 1, 0, n)) for n, (i, o, b) in enumerate(rows)]
    return spark.createDataFrame(made, UPLOAD)


def test_uploads(spark):
    new = uploads(spark, [("a", None, b"x y"), ("b", None, b"x y"), ("c", "o", b"x y"), ("d", None, b"old"), ("e", None, b""), ("f", None, b"\xff\xfe")])
    old = uploads(spark, [("z", None, b"old")]).withColumn("status", F.lit("FAILED"))
    accepted, rejected = storage.validate_uploads(new)
    assert [r.document_id for r in rejected.collect()] == ["e"]
    got = {r.document_id: (r.stored_id, r.is_new, r.needs_processing) for r in storage.dedupe_uploads(accepted, old).collect()}
    assert got == {"a": ("a", True, True), "b": ("a", False, False), "c": ("c", True, True), "d": ("z", False, True), "f": ("f", True, True)}
    parsed, blocks = storage.parse_plain_text(accepted)
    assert {r.document_id: r.status for r in parsed.collect()} == {"a": "PROCESSED", "b": "PROCESSED", "c": "PROCESSED", "d": "PROCESSED", "f": "FAILED"}
    assert blocks.count() == 4


def test_replace_and_cascade(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, v int")
    new = spark.createDataFrame([("a", 3)], "document_id string, v int")
    assert {(r.document_id, r.v) for r in storage.replaced(old, new).collect()} == {("a", 3), ("b", 2)}
    analyses = spark.createDataFrame([("x", "a", "j"), ("y", "b", "j")], "analysis_id string, candidate_document_id string, job_document_id string")
    plans = spark.createDataFrame([("p", "x"), ("q", "y")], "plan_id string, analysis_id string")
    changes = spark.createDataFrame([("p", 0), ("q", 0)], "plan_id string, op_idx int")
    left = storage.delete_documents({"profiles": old, "analyses": analyses, "plans": plans, "changes": changes}, spark.createDataFrame([("a",)], "document_id string"))
    assert {k: [r[0] for r in v.collect()] for k, v in left.items()} == {"profiles": ["b"], "analyses": ["y"], "plans": ["q"], "changes": ["q"]}


def test_project_changes_and_plan_deletion(spark):
    row = lambda column, *x: spark.createDataFrame([("d", i, t) for i, t in enumerate(x)], f"document_id string, idx int, {column} string")
    tables = {"skill": row("raw_text", "py", "go"), "project": row("name", "P"), "certification": row("name", "C"), "language": row("name", "L"), "experience": row("description", "E"), "education": row("degree", "D")}
    told = [("d", "skill:1", "Go", True), ("d", "skill:0", "Python", False), ("d", "project:0", "PP", True), ("d", "certification:0", "CC", True), ("d", "language:0", "LL", True), ("d", "experience:0", "EE", True), ("d", "education:0", "DD", True)]
    changes = spark.createDataFrame(told, "document_id string, fact_id string, final_text string, accepted boolean")
    out = tailoring.project_changes(tables, changes)
    assert {k: [r[2] for r in v.orderBy("idx").collect()] for k, v in out.items()} == {"skill": ["py", "Go"], "project": ["PP"], "certification": ["CC"], "language": ["LL"], "experience": ["EE"], "education": ["D"]}


def test_run_tailoring(spark):
    plans = spark.createDataFrame([("p", 1, 7), ("q", 2, 7)], "plan_id string, candidate_id long, job_id long")
    operations = spark.createDataFrame([("p",)], "plan_id string")
    changes = spark.createDataFrame([("p", True), ("p", False), ("p", True)], "plan_id string, accepted boolean")

    def score(changed):
        status = ["NOT_MET", "MET", "NOT_MET"] if changed is None else ["MET", "MET", "NOT_MET"]
        evals = spark.createDataFrame([(1, 7, i, s) for i, s in enumerate(status)], "candidate_id long, job_id long, eval_idx int, status string")
        return evals, spark.createDataFrame([(1, 7, 0.4 if changed is None else 0.7)], "candidate_id long, job_id long, overall double")

    rows = tailoring.run_tailoring(plans, operations, changes, score).collect()
    assert [(r.plan_id, r.before, r.after, r.improved, r.still_missing, r.unchanged, r.accepted, r.rejected) for r in rows] == [("p", 0.4, 0.7, 1, 1, 1, 2, 1)]


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    row = storage.read_documents(spark, f"file://{tmp_path}", "CV").first()
    assert (row.original_filename, row.mime_type, row.file_size, row.document_type) == ("a.txt", "text/plain", 5, "CV")


def test_applications(spark):
    docs = spark.createDataFrame([("c", "cv"), ("j", "job")], "document_id string, original_filename string")
    analyses = spark.createDataFrame([("x", "c", "j", "COMPLETED", 0.5, 1), ("y", "gone", "j", "COMPLETED", 0.5, 2)], "analysis_id string, candidate_document_id string, job_document_id string, status string, overall_score double, created_at int")
    plans = spark.createDataFrame([("p1", "x", "COMPLETED", 5), ("p2", "x", "DRAFT", 5)], "plan_id string, analysis_id string, status string, created_at int")
    got = views.build_applications(docs, docs, analyses, plans).collect()
    assert [(r.analysis_id, r.plan_id, r.stage) for r in got] == [("x", "p1", "TAILORED")]


def test_stream(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    seen = []
    for rows in ([("a", None, b"x"), ("b", None, b"x")], [("c", None, b"x"), ("d", None, b"y")]):
        uploads(spark, rows).write.mode("append").parquet(source)
        q = intake.stream_documents(spark, source, target, f"file://{tmp_path}/check", lambda df, n: seen.append(df.count()))
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(r.document_id for r in spark.read.parquet(target).collect()) == ["a", "d"] and seen == [1, 1]


def test_stream_reads_failed_uploads_again_and_keeps_rejected_ones(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    bad, seen = b"\xff\xfe", []
    for rows in ([("a", None, bad), ("b", None, b"fine"), ("e", None, b"")], [("c", None, bad), ("d", None, b"fine"), ("f", None, bad)]):
        uploads(spark, rows).write.mode("append").parquet(source)
        q = intake.stream_documents(spark, source, target, f"file://{tmp_path}/check", lambda df, n: seen.append(sorted((r.document_id, r.status) for r in df.collect())))
        q.awaitTermination(120)
        assert q.exception() is None
    assert seen == [[("a", "FAILED"), ("b", "PROCESSED")], [("a", "FAILED")]]
    now = intake.current_documents(spark.read.parquet(target)).collect()
    assert sorted((r.document_id, r.status, r.batch) for r in now) == [("a", "FAILED", 1), ("b", "PROCESSED", 0)]
    assert [(r.document_id, r.reject_reason) for r in spark.read.parquet(f"{target}-rejected").collect()] == [("e", "empty file")]


def _size(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


def test_stream_reads_nothing_that_was_stored(spark, tmp_path):
    """Stored files are spoilt between the batches: known uploads are still known."""
    source, target = f"file://{tmp_path}/in here", f"file://{tmp_path}/out"
    for n, rows in enumerate(([(f"a{i}", "o", b"x%d" % i) for i in range(50)], [(f"b{i}", "o", b"x%d" % i) for i in range(60)])):
        uploads(spark, rows).write.mode("append").parquet(source)
        q = intake.stream_documents(spark, source, target, f"file://{tmp_path}/check")
        q.awaitTermination(120)
        assert q.exception() is None
        if not n:
            for f in (tmp_path / "out").rglob("*.parquet"):
                f.write_bytes(b"spoilt")
    assert sorted(r.document_id for r in spark.read.parquet(f"{target}/batch=1").collect()) == sorted(f"b{i}" for i in range(50, 60))


def test_status_transitions_of_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    r = random.Random(4)
    start, kinds = datetime(2026, 1, 1), list(config.STATUS_MOVES)
    rows = [(f"d{r.randint(0, 9)}", start + timedelta(seconds=60 * i, microseconds=r.randint(0, 999_999)), i, r.choice(kinds)) for i in range(300)]
    schema = "document_id string, ts timestamp, event_id long, status string"
    order = sorted(rows, key=lambda x: x[1] + timedelta(minutes=r.randint(0, 50)))  # each at most 50 minutes behind
    flush = [("flush", start + timedelta(days=9), 10**6, "UPLOADED")]
    late = [("d0", start, 10**7, "FAILED")]
    for part in (order[:100], order[100:200], order[200:], flush, late, [("flush", start + timedelta(days=19), 10**6 + 1, "UPLOADED")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        with state.rocksdb(spark):
            moves = intake.stream_status_transitions(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
            q = moves.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    columns = ["document_id", "event_id", "ts", "status", "previous_status", "is_legal"]
    got = spark.read.schema(moves.schema).parquet(f"file://{tmp_path}/out").filter("document_id <> 'flush'").select(*columns)
    want = intake.check_status_transitions(spark.createDataFrame(rows, schema), tie="event_id").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_write_profiles_in_place(spark, tmp_path):
    """Rows and ids are read from the very store that is written."""
    path = f"file://{tmp_path}/profiles"
    rows = lambda *x: spark.createDataFrame(list(x), "document_id string, v int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id string")
    kept = lambda name: sorted((r.document_id, r.v) for r in storage.read_profiles(spark, path, name).collect())
    assert storage.read_profiles(spark, path, "t") is None
    storage.write_profiles({"t": rows(("a", 1), ("a", 2), ("b", 3), ("c", 4)), "u": rows(("a", 5), ("c", 6))}, ids("a", "b", "c"), path)
    before = storage.read_profiles(spark, path, "t")
    of_a = before.filter("document_id = 'a'").withColumn("v", F.col("v") * 10)
    processed = before.filter("v <> 3").select("document_id")  # of documents a and c, as the store says
    storage.write_profiles({"t": of_a, "u": of_a.filter("v = 10")}, processed, path)
    assert kept("t") == [("a", 10), ("a", 20), ("b", 3)] and kept("u") == [("a", 10)]
    assert sorted((r.document_id, r.v) for r in before.collect()) == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]  # an earlier reader goes on
    store.compact(spark, path)
    assert kept("t") == [("a", 10), ("a", 20), ("b", 3)]
    storage.write_profiles({"t": rows()}, ids("a", "b"), path)
    assert kept("t") == [] and kept("u") == [("a", 10)]


def test_a_failed_write_changes_no_table(spark, tmp_path):
    path = f"file://{tmp_path}/profiles"
    rows = lambda *x: spark.createDataFrame(list(x), "document_id string, v int")
    storage.write_profiles({"t": rows(("a", 1)), "u": rows(("a", 2))}, rows(("a", 0)), path)
    broken = rows(("a", 9)).withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        storage.write_profiles({"t": rows(("a", 8)), "u": broken}, rows(("a", 0)), path)
    read = lambda name: [(r.document_id, r.v) for r in storage.read_profiles(spark, path, name).collect()]
    assert read("t") == [("a", 1)] and read("u") == [("a", 2)]
    (tmp_path / "profiles" / "log" / f"{2:012}" / "_temporary").mkdir(parents=True)  # a writer was cut off as it committed
    assert read("t") == [("a", 1)]
    storage.write_profiles({"t": rows(("b", 3)), "u": rows()}, rows(("a", 0), ("b", 0)), path)
    assert read("t") == [("b", 3)] and read("u") == []


def test_a_commit_costs_what_it_brings(spark, tmp_path):
    path = f"file://{tmp_path}/profiles"
    many = spark.range(200_000).select(F.col("id").cast("string").alias("document_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    storage.write_profiles({"t": many}, many, path)
    full = _size(tmp_path)
    storage.write_profiles({"t": many.limit(20)}, many.limit(20), path)
    storage.delete_stored_documents(spark, path, many.filter("document_id < '10003'").select("document_id").limit(5))
    assert _size(tmp_path) - full < full / 50
    assert storage.read_profiles(spark, path, "t").count() == 199_995


def test_headings_of_all_types(spark):
    from talentloom import config

    told = {
        "PERSONAL_INFORMATION": ("Contact Details", "Coordonnées"), "SUMMARY": ("Profile", "Résumé professionnel"), "HIGHLIGHTS": ("Career Highlights",),
        "CORE_QUALIFICATIONS": ("Core Qualifications",), "EXPERIENCE": ("Work History", "Expériences professionnelles", "Internships"), "EDUCATION": ("Academic Background", "Études"),
        "PROJECTS": ("Side Projects", "Projets personnels"), "SKILLS": ("Areas of Expertise", "Compétences clés"), "TECHNICAL_SKILLS": ("Technical Skills", "Outils et technologies"),
        "CERTIFICATIONS": ("Licenses and Certifications", "Certificats"), "LANGUAGES": ("Spoken Languages", "Langues"), "ACHIEVEMENTS": ("Awards and Honors", "Réalisations"),
        "PUBLICATIONS": ("Selected Publications",), "PRESENTATIONS": ("Speaking Engagements",), "VOLUNTEER_EXPERIENCE": ("Volunteer Experience", "Bénévolat"),
        "LEADERSHIP": ("Leadership Roles",), "INTERESTS": ("Personal Interests", "Centres d'intérêt", "Hobbies & Interests"), "HOBBIES": ("Hobbies and Interests", "Loisirs"),
        "AFFILIATIONS": ("Professional Memberships",), "SCHOLARSHIPS": ("Grants and Scholarships",), "ADDITIONAL_INFORMATION": ("Additional Information", "Informations complémentaires"),
        "RESPONSIBILITIES": ("What you'll do", "Key Responsibilities"), "REQUIREMENTS": ("What we're looking for", "Required skills"), "OTHER": ("Lorem ipsum", ""),
    }
    assert set(told) == set(config.SECTION_TYPES)
    rows = [(kind, text) for kind, texts in told.items() for text in texts]
    got = spark.createDataFrame(rows, "kind string, text string").select("kind", "text", sections.section_heading(F.col("text")).alias("got")).collect()
    assert [(r.text, r.got) for r in got if r.got != r.kind] == []


def test_stream_dedupe(spark, tmp_path):
    uploads(spark, [("a", "o", b"x"), ("b", "o", b"x"), ("c", "o", b"y")]).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(UPLOAD).parquet(f"file://{tmp_path}/in")
    q = intake.stream_dedupe(stream).writeStream.format("memory").queryName("unique_uploads").start()
    q.processAllAvailable()
    time.sleep(0.1)
    q.stop()
    assert spark.sql("select count(distinct file_hash), count(*) from unique_uploads").first()[:] == (2, 2)


def test_registry():
    known = __spark_entry__.queries()
    assert set(QUERIES) <= set(known) and set(ORACLES) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(known)


@pytest.mark.parametrize("name", ["pair_scores", "years_of_experience"])
def test_same_rows_for_any_partitioning(spark, name):
    got = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


@pytest.mark.parametrize(("line", "kind"), [
    ("Work Experience", "EXPERIENCE"), ("CAREER SUMMARY", "EXPERIENCE"), ("Expérience professionnelle", "EXPERIENCE"), ("Background", "EXPERIENCE"), ("Record", "EXPERIENCE"),
    ("Credentials", "CERTIFICATIONS"), ("Qualifications", "REQUIREMENTS"), ("Core Qualifications", "CORE_QUALIFICATIONS"), ("Skills & Competencies", "SKILLS"),
    ("Co-op Experience", "EXPERIENCE"), ("Centres d'intérêt", "INTERESTS"), ("Activités extra-professionnelles", "OTHER"), ("My Technical Skills section", "TECHNICAL_SKILLS"),
    ("brand", "OTHER"), ("thousand islands", "OTHER"), ("and", "OTHER"), ("technical", "OTHER"), ("Volunteer", "OTHER"), ("", "OTHER"), ("What you'll do", "RESPONSIBILITIES"),
])
def test_headings(spark, line, kind):
    row = spark.createDataFrame([(line,)], "line string").select(sections.section_heading(F.col("line")).alias("t")).first()
    assert row.t == kind


def test_every_heading_has_its_type(spark):
    rows = [(a, kind) for kind, aliases in HEADINGS.items() for a in aliases]
    assert len({a for a, _ in rows}) == len(rows) and set(HEADINGS) | {"OTHER"} == set(config.SECTION_TYPES)
    told = spark.createDataFrame(rows, "line string, want string").withColumn("got", sections.section_heading(F.upper("line")))
    assert told.filter("got <> want").count() == 0


def test_headings_of_ones_own(spark):
    own = {"MAGIC": ("spells", "spell book"), "OTHER_MAGIC": ("spell",)}
    row = spark.createDataFrame([("The spell book of old",), ("spells",), ("a spell",), ("Skills",)], "line string")
    assert [r.t for r in row.select(sections.section_heading(F.col("line"), own).alias("t")).collect()] == ["MAGIC", "MAGIC", "OTHER_MAGIC", "OTHER"]
