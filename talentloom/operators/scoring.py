"""Scores, gaps and summaries of evaluated pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T

PAIR = ("candidate_id", "job_id")
OPEN = ("NOT_MET", "PARTIALLY_MET", "UNKNOWN")


def eligible_pairs(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of a pair table, by type and status of its documents."""
    of = lambda side: docs.select(F.col("document_id").alias(f"{side}_id"), F.col("document_type").alias(f"_{side}_type"), F.col("status").alias(f"_{side}_status"))
    told = pairs.join(of("candidate"), "candidate_id", "left").join(of("job"), "job_id", "left")
    reason = (
        F.when(F.col("_candidate_type").isNull(), "candidate document not found").when(F.col("_job_type").isNull(), "job document not found")
        .when(F.col("_candidate_type") != "CV", "candidate document is not a CV").when(F.col("_job_type") != "JOB_OFFER", "job document is not a job offer")
        .when(F.col("_candidate_status") != "PROCESSED", "candidate document is not processed").when(F.col("_job_status") != "PROCESSED", "job document is not processed")
    )
    marked = told.select(*pairs.columns, reason.alias("reason"))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


#: Ids that one row of the smaller side of the bulk form holds.
BLOCK = 4096


def eligible_blocks(docs: DataFrame) -> DataFrame:
    """candidate_id, jobs, n_jobs, first_job: every processed CV with every block of processed job offers.

    The offers' ids travel as blocks (one row each, of bounded size); how many a block
    holds and its first are told once a block, so that what reads only these opens none.
    """
    ready = docs.filter("status = 'PROCESSED'")
    jobs = ready.filter("document_type = 'JOB_OFFER'").select(F.col("document_id").alias("job_id"))
    blocks = max(1, -(-jobs.count() // BLOCK))
    dealt = jobs.groupBy(F.pmod(F.xxhash64("job_id"), F.lit(blocks)).cast("int").alias("block")).agg(
        F.collect_list("job_id").alias("jobs"), F.count("job_id").alias("n_jobs"), F.min("job_id").alias("first_job")
    )
    cvs = ready.filter("document_type = 'CV'").select(F.col("document_id").alias("candidate_id"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return cvs.join(dealt, "block").select("candidate_id", "jobs", "n_jobs", "first_job")


def eligible_grid(docs: DataFrame) -> DataFrame:
    """candidate_id, job_id: every processed CV with every processed job offer, the bulk form of eligible pairs.

    A CV meets every block of offers once, and pairs appear only as blocks are
    opened. The pairs are as many as CVs times offers; give a pair table to
    ``eligible_pairs`` where that is too much, and ``eligible_counts`` where only
    their number is wanted.
    """
    return eligible_blocks(docs).select("candidate_id", F.explode("jobs").alias("job_id"))


def eligible_counts(docs: DataFrame) -> DataFrame:
    """candidate_id, n_jobs, first_job: ``eligible_grid`` counted by CV, with the smallest offer, without a row a pair."""
    met = eligible_blocks(docs).filter("n_jobs > 0")
    return met.groupBy("candidate_id").agg(F.sum("n_jobs").alias("n_jobs"), F.min("first_job").alias("first_job"))


def dimension_scores(evals: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, dimension, score (mean), evaluation_count."""
    return evals.groupBy(*keys, "dimension").agg(F.avg("score").alias("score"), F.count("*").alias("evaluation_count"))


def score_breakdown(evals: DataFrame, weights: dict[str, float] = config.WEIGHTS, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, overall, a score a dimension, mandatory_gaps, mandatory_gap_penalty, evaluations.

    overall: weighted mean over the dimensions present, less a penalty for each
    mandatory demand that is not met (capped), at least 0; rounded half-even to
    4 places. A dimension without evaluations shows 0 and count 0.
    """
    config.checked_weights(weights)
    mine = lambda d: F.col("dimension") == d
    gaps = F.count_if((F.col("priority") == "MANDATORY") & (F.col("status") == "NOT_MET"))
    sums = evals.groupBy(*keys).agg(
        *[F.avg(F.when(mine(d), F.col("score"))).alias(f"_{d}") for d in config.DIMENSIONS],
        *[F.count_if(mine(d)).alias(f"n_{d}") for d in config.DIMENSIONS],
        gaps.alias("mandatory_gaps"),
    )
    total, weight = F.lit(0.0), F.lit(0.0)
    for d in config.DIMENSIONS:  # a fixed order, for the same last digits everywhere
        total = total + F.coalesce(F.col(f"_{d}"), F.lit(0.0)) * weights[d]
        weight = weight + F.when(F.col(f"_{d}").isNotNull(), weights[d]).otherwise(0.0)
    penalty = F.least(F.lit(config.GAP_PENALTY_CAP), F.col("mandatory_gaps") * config.GAP_PENALTY)
    raw = F.greatest(F.lit(0.0), F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.0)) - penalty)
    shown = sums.select(
        *keys, raw.alias("_raw"), penalty.alias("_penalty"), *[F.coalesce(F.col(f"_{d}"), F.lit(0.0)).alias(f"_{d}") for d in config.DIMENSIONS],
        *[f"n_{d}" for d in config.DIMENSIONS], "mandatory_gaps",
    )
    exact = lambda c, name: T.exact_round(F.col(c)).alias(name)
    return shown.select(
        *keys, exact("_raw", "overall"), *[exact(f"_{d}", d) for d in config.DIMENSIONS], *[f"n_{d}" for d in config.DIMENSIONS],
        "mandatory_gaps", exact("_penalty", "mandatory_gap_penalty"),
    )


def detect_gaps(evals: DataFrame) -> DataFrame:
    """Every demand that is not fully met, with what evidence there was and the skills it came from."""
    status = F.when(F.col("match_signal") == "NO_EVIDENCE", "NO_EVIDENCE_FOUND").otherwise("PARTIAL_EVIDENCE_FOUND")
    labels = F.array_distinct(F.filter(F.transform("evidence", lambda e: e["source_label"]), lambda x: x.isNotNull()))
    related = F.when(F.size(labels) > 0, labels).when(F.col("matched_skill").isNotNull(), F.array("matched_skill")).otherwise(F.array().cast("array<string>"))
    return evals.filter(F.col("status").isin(*OPEN)).select(
        *PAIR, "eval_idx", "requirement_type", "priority", "raw_text", F.col("explanation").alias("reason"), status.alias("evidence_status"),
        related.alias("related_candidate_skills"), "confidence",
    )


def strengths(evals: DataFrame) -> DataFrame:
    return evals.filter("status = 'MET'")


def requirement_summary(evals: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return evals.groupBy(*keys).agg(
        F.count("*").alias("total"), count("MET").alias("met"), count("PARTIALLY_MET").alias("partially_met"), count("NOT_MET").alias("not_met"), count("UNKNOWN").alias("unknown")
    )


def score_band(overall: Column) -> Column:
    percent = overall * 100
    high, middle, low = config.SCORE_BANDS
    return F.when(percent >= high, "STRONG").when(percent >= middle, "GOOD").when(percent >= low, "PARTIAL").otherwise("WEAK")


def confidence_band(confidence: Column) -> Column:
    high, middle = config.CONFIDENCE_BANDS
    return F.when(confidence >= high, "High").when(confidence >= middle, "Medium").otherwise("Low")


def run_analyses(analyses: DataFrame, evals: DataFrame, profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    """analysis_id, candidate_id, job_id, status, message, engine_version, overall.

    ``profiles`` and ``jobs`` hold the ids that have profiles; a pair without
    one fails with a message instead of being dropped.
    """
    scored = score_breakdown(evals).select(*PAIR, "overall")
    marked = analyses.select("analysis_id", *PAIR).join(jobs.select("job_id", F.lit(True).alias("_j")).distinct(), "job_id", "left")
    # Analyses go to their candidates once and are grouped with the scores there; a join by pair would deal both anew.
    every = marked.select(*PAIR, F.struct("analysis_id", "_j").alias("_a")).repartition("candidate_id").unionByName(scored, True)
    met = every.groupBy(*PAIR).agg(F.collect_list("_a").alias("_a"), F.first("overall", True).alias("overall"))
    told = met.select(*PAIR, "overall", F.inline("_a")).join(profiles.select("candidate_id", F.lit(True).alias("_c")).distinct(), "candidate_id", "left")
    message = F.when(F.col("_c").isNull(), "no candidate profile").when(F.col("_j").isNull(), "no job profile")
    return told.select(
        "analysis_id", *PAIR, F.when(message.isNull(), "COMPLETED").otherwise("FAILED").alias("status"), message.alias("message"),
        F.lit(config.ENGINE_VERSION).alias("engine_version"), F.when(message.isNull(), F.coalesce("overall", F.lit(0.0))).alias("overall"),
    )
