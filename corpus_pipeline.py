"""From raw documents to packed sequences, in five stored stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``documents``. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm.common import renamed, stored, table
from talentloom.llm.mixing import mixed_documents
from talentloom.llm.packing import pack_documents
from talentloom.llm.pii import redact
from talentloom.llm.queries import WORD_BPE, WORD_END
from talentloom.llm.similar import drop_near_duplicates
from talentloom.llm.toxicity import THRESHOLD, train

#: Held against a step-by-step brute-force version in the tests: SQL can
#: express neither the trained stages nor the tokenizer.
ORACLE_SQL = None


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs``'s columns, n_chars (where there is one) following the text."""
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    plain, names = renamed(docs)
    kept = model.score(plain, names["text"], tuple(plain.columns)).filter(F.col("score") < THRESHOLD)
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()])


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest id (null ids last)."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return _same_columns(redact(docs), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated and cut to their target weights."""
    return _same_columns(mixed_documents(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents are packed into sequences of 4096 tokens."""
    return pack_documents(docs, WORD_BPE, WORD_END)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_removal),
    ("pii", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
