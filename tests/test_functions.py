"""Column functions on the cases that matter."""

import difflib
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from talentloom import config
from talentloom.functions import diff
from talentloom.functions import text as T


def apply(spark, build, *rows, schema="a string"):
    df = spark.createDataFrame([(n, *(r if isinstance(r, tuple) else (r,))) for n, r in enumerate(rows)], f"n int, {schema}")
    return [r.v for r in df.select("n", build(*[F.col(c) for c in df.columns[1:]]).alias("v")).orderBy("n").collect()]


def test_detect_language(spark):
    got = apply(spark, T.detect_language, "", "one two three", "12345 678", "le chat et la souris dans une maison", "the cat and the mouse in the house", None, "the chat and la maison of le jour")
    assert [r.language for r in got[:6]] == ["UNKNOWN", "UNKNOWN", "UNKNOWN", "FR", "EN", "UNKNOWN"]
    assert got[3].confidence == 1.0 and got[3].secondary_language is None
    assert got[6].secondary_language is not None and got[6].confidence < config.BILINGUAL


def test_lines_and_headings(spark):
    assert apply(spark, T.split_lines, "a\r\nb\n\nc\n", "", "x") == [["a", "b", "", "c"], [], ["x"]]
    assert apply(spark, T.clean_heading, "  Expérience — Professionnelle! ", "CENTRES D'INTÉRÊT") == ["experience professionnelle", "centres d'interet"]
    assert apply(spark, T.delimited_tokens, "Java, C++ ; Go | Rust • - SQL\n\n") == [["Java", "C++", "Go", "Rust", "SQL"]]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("January 2020 - Present", ("", "January 2020", "Present")), ("2013 – 2017", ("", "2013", "2017")),
        ("Engineer Févr. - Juin 2026", ("Engineer", "Févr.", "Juin 2026")), ("Engineer at X", None), ("Dev Jan 2020 - en cours", ("Dev", "Jan 2020", "en cours")),
    ],
)
def test_date_range(spark, line, want):
    got = apply(spark, T.date_range, line)[0]
    assert (tuple(got) if got else None) == want


def test_entry_parts(spark):
    got = apply(spark, T.split_title_company, "Engineer at Acme", "Ingénieure chez Acme", "A | B", "Dev - Acme, Paris", "Solo")
    assert [tuple(r) for r in got] == [("Engineer", "Acme"), ("Ingénieure", "Acme"), ("A", "B"), ("Dev", "Acme, Paris"), ("Solo", None)]
    assert apply(spark, T.looks_like_location, "Paris, France", "Paris", "Room 5, Paris", "Technologies, many", None) == [True, False, False, False, False]
    assert apply(spark, T.is_current, "Présent", "Aujourd'hui", "2020", None) == [True, True, False, False]


def test_ladders(spark):
    assert apply(spark, T.normalize_seniority, "Senior Engineering Manager", "Sr. Dev", "Software Engineer", None, "Internal auditor") == ["MANAGER", "SENIOR", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert apply(spark, T.normalize_education_level, "Master of Arts", "Licence pro", "Ph.D", "Baccalauréat", "Course") == ["MASTER", "BACHELOR", "DOCTORATE", "HIGH_SCHOOL", "UNKNOWN"]
    assert apply(spark, T.normalize_language_name, " anglais ", "klingon l'x-y", "Deutsch") == ["English", "Klingon L'X-Y", "German"]
    assert apply(spark, T.normalize_proficiency, "B2", "Mother tongue", "so so", None) == ["UPPER_INTERMEDIATE", "NATIVE", "UNKNOWN", "UNKNOWN"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), (None, [1.0])]
    assert apply(spark, T.cosine_similarity, *rows, schema="a array<double>, b array<double>") == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_hash_embedding(spark):
    got = apply(spark, T.hash_embedding, "text")[0]
    assert got == pytest.approx([b / 127.5 - 1 for b in hashlib.sha256(b"text").digest()])


def test_years_covered(spark):
    kind = "a array<struct<`from`:int,`to`:int>>"
    rows = [([(2000, 2005), (2003, 2007)],), ([(2000, 2002), (2002, 2004)],), ([(2000, 2002), (2005, 2006)],), ([(2000, 2010), (2002, 2004)],), ([],)]
    assert apply(spark, T.years_covered, *rows, schema=kind) == [7.0, 4.0, 3.0, 10.0, 0.0]


def test_exact_round(spark):
    r = random.Random(1)
    values = [0.03125, 0.00015, 0.45625, 0.60625 - 0.15, 0.0, 1.0] + [r.random() for _ in range(300)] + [r.randint(0, 10**5) / 10**5 for _ in range(300)]
    assert apply(spark, T.exact_round, *values, schema="a double") == [round(v, 4) for v in values]


def test_parse_proposal(spark):
    assert apply(spark, T.parse_proposal, '{"proposed_text": "a b"}', 'Sure: {"proposed_text": "say \\"x\\""} done', "nothing", None) == ["a b", 'say "x"', None, None]


def _plain_segments(before, after):
    left, right = before.split(), after.split()
    out = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        out += [(left[i:j], "UNCHANGED")] if tag == "equal" else [(left[i:j], "REMOVED"), (right[k:m], "ADDED")]
    return [(" ".join(words), kind) for words, kind in out if words]


def test_differences_are_those_of_longest_runs():
    r = random.Random(5)
    for n in range(3000):
        words = "abcdefgh"[: r.randint(1, 8)]
        before = [r.choice(words) for _ in range(r.randint(0, 30))]
        after = [w for w in before if r.random() < 0.8] if n % 2 else [r.choice(words) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            after.insert(r.randint(0, len(after)), r.choice(words))
        pair = " ".join(before), " ".join(after)
        assert diff.segments(*pair) == _plain_segments(*pair)
    assert diff.segments(None, " ") == [] and diff.segments(None, "a") == [("a", "ADDED")]


def test_differences_of_long_texts():
    r = random.Random(6)
    before = [r.choice(["the", "a", "of"]) if r.random() < 0.3 else f"w{r.randint(0, 3000)}" for _ in range(20_000)]
    after = [w for w in before if r.random() < 0.95]
    began = time.process_time()
    out = diff.segments(" ".join(before), " ".join(after))
    assert time.process_time() - began < 30
    assert " ".join(t for t, k in out if k != "ADDED").split() == before and " ".join(t for t, k in out if k != "REMOVED").split() == after
    began = time.process_time()
    diff.segments("the " * 20_000, "the a " * 10_000)
    diff.segments("the of " * 10_000, "the of a " * 7_000)
    assert time.process_time() - began < 30
