"""Application views over documents, analyses and tailoring plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_applications(cvs: DataFrame, jobs: DataFrame, analyses: DataFrame, plans: DataFrame) -> DataFrame:
    """analysis_id, cv and job names, overall_score, latest plan, stage, completed_stages, created_at; newest first.

    An analysis without its CV or job is left out. Of plans of the same time the
    one that was stored first (smallest plan_id) counts.
    """
    latest = F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.desc("created_at"), "plan_id"))
    newest = plans.withColumn("_r", latest).filter("_r = 1").select("analysis_id", "plan_id", F.col("status").alias("plan_status"))
    joined = (
        analyses.join(cvs.select(F.col("document_id").alias("candidate_document_id"), F.col("original_filename").alias("cv_name")), "candidate_document_id")
        .join(jobs.select(F.col("document_id").alias("job_document_id"), F.col("original_filename").alias("job_name")), "job_document_id")
        .join(newest, "analysis_id", "left")
    )
    analysed = F.col("status") == "COMPLETED"
    tailored = F.col("plan_status") == "COMPLETED"
    stage = F.when(tailored, "TAILORED").when(F.col("plan_id").isNotNull(), "TAILORING").when(analysed, "ANALYZED").otherwise("ANALYZING")
    done = F.filter(
        F.array(F.lit("UPLOADED"), F.when(analysed, F.lit("ANALYZED")), F.when(F.col("plan_id").isNotNull(), F.lit("TAILORING")), F.when(tailored, F.lit("TAILORED"))),
        lambda x: x.isNotNull(),
    )
    return joined.select(
        "analysis_id", "cv_name", "job_name", "overall_score", "plan_id", stage.alias("stage"), done.alias("completed_stages"), "created_at"
    ).orderBy(F.desc("created_at"), "analysis_id")


def orphan_documents(cvs: DataFrame, jobs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Processed documents that no analysis uses."""
    left = lambda docs, key: docs.filter("status = 'PROCESSED'").join(analyses.select(F.col(key).alias("document_id")).filter("document_id is not null"), "document_id", "left_anti")
    return left(cvs, "candidate_document_id").unionByName(left(jobs, "job_document_id"))


def list_documents(docs: DataFrame, document_type: str | None = None) -> DataFrame:
    """Documents of one type (or all), newest first."""
    chosen = docs if document_type is None else docs.filter(F.col("document_type") == document_type)
    return chosen.orderBy(F.desc("created_at"), "document_id")


def recent(docs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest documents."""
    return list_documents(docs).limit(n)
