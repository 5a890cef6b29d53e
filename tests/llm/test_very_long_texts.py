"""Texts of over a megabyte, and tables whose own columns have the operators' names."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from talentloom.llm import html_text, lexical, simhash, suffix_dedup
from talentloom.llm.mixing import mix_sources
from talentloom.llm.quality import filter_quality
from talentloom.llm.toxicity import score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(20_000)]
    prose = " ".join(r.choice(words) for _ in range(210_000))  # 1.3 MB
    line = "x" * 1_200_000  # one word
    rows = [(1, prose, "a"), (2, prose + " end", "a"), (3, line, "b"), (4, "short one " + line[:600], "b"), (5, "日本語 " * 150_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), {i: t for i, t, _ in rows}


def test_counts_of_very_long_texts(docs):
    df, texts = docs
    got = {r.doc_id: r.n_words for r in filter_quality(df).collect()}
    assert got == {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in mix_sources(df).collect()} == got


def test_near_copies_among_very_long_texts(docs):
    df, texts = docs
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got[1][1] == got[2][1] == 1 and got[5][1] == 5
    assert all(got[i][0] == f"{simhash.fingerprint(t):016x}" for i, t in texts.items())


def test_repeats_in_very_long_texts(docs):
    df, texts = docs
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert all(got[i].n_bytes == len(t.encode()) for i, t in texts.items())
    assert got[1].n_removed == got[1].n_bytes and got[3].n_removed == 1_200_000 and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].n_removed == got[1].n_bytes and got[2].kept_text == " end" and got[4].kept_text == "short one "


def test_toxicity_and_ranks_of_very_long_texts(spark, docs):
    df, texts = docs
    labels = spark.createDataFrame([(i, 1, i % 2) for i in texts], "doc_id long, quality int, toxic int")
    assert {r.doc_id: 0 <= r.score <= 1 for r in score_toxicity(df, labels).collect()} == dict.fromkeys(texts, True)
    items = spark.createDataFrame([(1, "w7 end"), (2, texts[3]), (3, "日本語")], "item_id long, text string")
    got = {(r.item_id, r.rank): r.doc_id for r in lexical.rank_documents(df, items).collect()}
    assert got[1, 1] == 2 and got[1, 2] == 1 and got[2, 1] == 3 and got[3, 1] == 5 and len(got) == 4


def test_pages_with_clashing_columns(spark):
    names = ("text", "n_chars", "_page", "hint", "links", "box")
    page = "<p>The story of the day is that a man in the town was with a dog and it ran to the sea for fun, and on it went until the evening.</p>"
    df = spark.createDataFrame([(1, "u", page * 9000), (2, None, None)], "page_id long, url string, html string")
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    got = {r.page_id: (r.url, r.n_chars) for r in html_text.extract_pages(df).collect()}
    assert got == {1: ("u", 9000 * (len(page) - 7) + 8999), 2: (None, 0)}
