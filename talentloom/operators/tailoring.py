"""Tailored CVs: plan, proposed texts, checks, rebuilt profiles, comparison."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .. import config
from ..functions import text as T
from ..functions.diff import segments
from . import truth
from .matching import years_of_experience
from .recommend import safe_to_tailor

DIFF = ArrayType(StructType([StructField("text", StringType()), StructField("change_type", StringType())]))


def select_recommendations(recs: DataFrame, chosen: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recommendations of sound plans, plan_id with the reason why it is rejected).

    ``chosen``: plan_id, analysis_id, rec_idx; ``recs`` has analysis_id.
    """
    picked = chosen.join(recs, ["analysis_id", "rec_idx"], "left").join(analyses.select("analysis_id", F.col("status").alias("_s")), "analysis_id", "left")
    facts = picked.groupBy("plan_id").agg(F.max("_s").alias("s"), F.count("type").alias("n"), F.count_if(F.col("type").isNotNull() & ~safe_to_tailor(F.col("safety"))).alias("bad"))
    reason = F.when(F.coalesce(F.col("s"), F.lit("")) != "COMPLETED", "analysis is not completed").when(F.col("n") == 0, "no recommendation").when(F.col("bad") > 0, "a recommendation is not safe to tailor")
    judged = facts.select("plan_id", reason.alias("reason"))
    return picked.drop("_s").join(judged.filter("reason is null").select("plan_id"), "plan_id", "left_semi"), judged.filter("reason is not null")


def build_plan(recs: DataFrame, facts: DataFrame, experiences: DataFrame) -> DataFrame:
    """plan_id, document_id, op_idx, fact_id, transformation, recommendation_title, target_state, fact columns.

    ``recs``: plan_id, document_id, rec_idx and the recommendation's columns. A
    keyword goes to the first skill fact of that text, an alignment to the first
    experience with its label; a fact is touched once, by the first
    recommendation.
    """
    wanted = recs.filter(safe_to_tailor(F.col("safety")))
    number = F.split("fact_id", ":")[1].cast("int")
    words = wanted.filter("type = 'KEYWORD_PLACEMENT'").join(facts.filter("type = 'SKILL'").select("document_id", F.col("value").alias("current_state"), "fact_id", number.alias("_n")), ["document_id", "current_state"])
    labelled = experiences.select("document_id", F.col("idx").alias("_n"), T.entry_label(F.col("title"), F.col("company"), "an experience entry").alias("source_label"))
    lines = wanted.filter("type = 'RESPONSIBILITY_ALIGNMENT'").join(labelled, ["document_id", "source_label"]).withColumn("fact_id", F.concat(F.lit("experience:"), F.col("_n").cast("string")))
    columns = ["plan_id", "document_id", "rec_idx", F.col("title").alias("recommendation_title"), "target_state", "fact_id", "_n"]
    first = F.row_number().over(Window.partitionBy("plan_id", "rec_idx").orderBy("_n"))
    hit = words.select(*columns).unionByName(lines.select(*columns)).withColumn("_r", first).filter("_r = 1")
    allowed = hit.join(facts.filter(truth.permits(F.col("allowed_transformations"), "REPHRASE")).select("document_id", "fact_id", "type", "value", "normalized_value"), ["document_id", "fact_id"])
    once = allowed.withColumn("_o", F.row_number().over(Window.partitionBy("plan_id", "fact_id").orderBy("rec_idx"))).filter("_o = 1")
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("rec_idx")) - 1
    return once.select("plan_id", "document_id", place.alias("op_idx"), "fact_id", F.lit("REPHRASE").alias("transformation"), "recommendation_title", "target_state", "type", "value", "normalized_value")


def protected_facts(plans: DataFrame, operations: DataFrame, facts: DataFrame) -> DataFrame:
    """plan_id, protected_fact_ids: the facts that no operation touches."""
    every = plans.select("plan_id", "document_id").join(facts.groupBy("document_id").agg(F.collect_list("fact_id").alias("_all")), "document_id", "left")
    used = operations.groupBy("plan_id").agg(F.collect_list("fact_id").alias("_used"))
    empty = F.array().cast("array<string>")
    return every.join(used, "plan_id", "left").select("plan_id", F.array_sort(F.array_except(F.coalesce("_all", empty), F.coalesce("_used", empty))).alias("protected_fact_ids"))


def generate_text(operations: DataFrame, mode: str, proposals: DataFrame | None = None) -> DataFrame:
    """Add original_text and proposed_text.

    Skills take their canonical name; the CONSERVATIVE mode changes nothing
    else; otherwise ``proposals`` (plan_id, op_idx, raw_response) are read, and
    what cannot be read leaves the text as it is.
    """
    skill = F.coalesce(T.blank_to_null(F.col("target_state")), T.blank_to_null(F.col("normalized_value")), F.col("value"))
    if mode == "CONSERVATIVE" or proposals is None:
        made = operations.withColumn("_p", F.lit(None).cast("string"))
    else:
        made = operations.join(proposals.select("plan_id", "op_idx", T.parse_proposal(F.col("raw_response")).alias("_p")), ["plan_id", "op_idx"], "left")
    text = F.when(F.col("type") == "SKILL", skill).otherwise(F.coalesce("_p", "value"))
    return made.withColumns({"original_text": F.col("value"), "proposed_text": text}).drop("_p")


@F.pandas_udf(DIFF)
def _diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[{"text": text, "change_type": kind} for text, kind in segments(a, b)] for a, b in zip(before, after, strict=True)])


def word_diff(before: Column, after: Column) -> Column:
    """array<struct<text, change_type>> of UNCHANGED, REMOVED and ADDED word runs."""
    return _diff(before, after)


def apply_validation(operations: DataFrame, known: DataFrame, experiences: DataFrame, education: DataFrame, forms: list[tuple[str, str]], reference_year: int) -> DataFrame:
    """plan_id, op_idx, fact_id, original_text, final_text, accepted, rejection_reasons.

    An experience is checked against that one experience's years.
    """
    one = F.array(F.struct("start_date_raw", "end_date_raw", "technologies"))
    years = years_of_experience(one, F.lit(None).cast("string"), F.lit(reference_year))
    spans = experiences.select("document_id", F.concat(F.lit("experience:"), F.col("idx").cast("string")).alias("fact_id"), years.alias("verified_years"))
    ladder = F.max(F.struct(T.rank(F.col("degree_level"), config.EDUCATION), F.col("degree_level")))
    school = education.groupBy("document_id").agg(ladder["degree_level"].alias("_school"))
    joined = operations.join(known, "document_id", "left").join(spans, ["document_id", "fact_id"], "left").join(school, "document_id", "left")
    ready = joined.withColumns({"highest_education": F.coalesce("_school", F.lit("UNKNOWN")), "verified_proficiency": F.lit(None).cast("string")})
    judged = truth.validate_claims(ready, forms)
    return judged.select(
        "plan_id", "document_id", "op_idx", "fact_id", "original_text", F.when(F.col("is_valid"), F.col("proposed_text")).otherwise(F.col("original_text")).alias("final_text"),
        F.col("is_valid").alias("accepted"), F.transform("violations", lambda v: v["reason"]).alias("rejection_reasons"),
    )


def _changed(df: DataFrame, changes: DataFrame, kind: str, column: str) -> DataFrame:
    own = changes.filter(F.col("accepted") & F.col("fact_id").startswith(f"{kind}:")).select("document_id", F.split("fact_id", ":")[1].cast("int").alias("idx"), F.col("final_text").alias("_t"))
    return df.join(own, ["document_id", "idx"], "left").withColumn(column, F.coalesce("_t", column)).drop("_t").select(*df.columns)


def rebuild_profile(skills: DataFrame, experiences: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skills and experiences with accepted changes; ``changes`` are those of one plan a document."""
    return _changed(skills, changes, "skill", "raw_text"), _changed(experiences, changes, "experience", "description")


def project_changes(tables: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """Display projection: also names of projects, certifications and languages."""
    columns = {"skill": "raw_text", "experience": "description", "project": "name", "certification": "name", "language": "name"}
    return {kind: _changed(df, changes, kind, columns[kind]) if kind in columns else df for kind, df in tables.items()}


def compare_requirements(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("candidate_id", "job_id")) -> DataFrame:
    """keys, improved, still_missing, unchanged."""
    both = before.select(*keys, "eval_idx", F.col("status").alias("_b")).join(after.select(*keys, "eval_idx", F.col("status").alias("_a")), [*keys, "eval_idx"])
    was, now = F.col("_b") == "MET", F.col("_a") == "MET"
    return both.groupBy(*keys).agg(F.count_if(now & ~was).alias("improved"), F.count_if(~now).alias("still_missing"), F.count_if(now & was).alias("unchanged"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("plan_id").agg(F.count_if(F.col("accepted")).alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def run_tailoring(plans: DataFrame, operations: DataFrame, changes: DataFrame, score: Callable[[DataFrame | None], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """plan_id, before, after, improved, still_missing, unchanged, accepted, rejected.

    ``plans``: plan_id, candidate_id, job_id. ``score(changes)`` gives (evals,
    breakdown) of the profiles as they are (None) or with the changes.
    """
    was, first = score(None)
    now, second = score(changes)
    keys = ["candidate_id", "job_id"]
    out = plans.join(first.select(*keys, F.col("overall").alias("before")), keys, "left").join(second.select(*keys, F.col("overall").alias("after")), keys, "left")
    out = out.join(compare_requirements(was, now), keys, "left").join(change_counts(changes), "plan_id", "left")
    touched = operations.select("plan_id").distinct()
    return out.join(touched, "plan_id", "left_semi")
