"""Verified facts of a candidate, and checks of proposed texts against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from .taxonomy import scan_mentions

VIOLATIONS = "array<struct<reason:string,detail:string>>"


def candidate_facts(
    skills: DataFrame, experiences: DataFrame, projects: DataFrame, education: DataFrame, certifications: DataFrame, languages: DataFrame
) -> DataFrame:
    """document_id, fact_id (kind:idx), type, value, normalized_value, confidence, verification_status, allowed_transformations."""
    none = F.lit(None).cast("string")

    def part(df: DataFrame, kind: str, value: Column, normal: Column = none) -> DataFrame:
        confidence = F.col("evidence.confidence") if "evidence" in df.columns else F.lit(None).cast("double")
        return df.select(
            "document_id", F.concat(F.lit(f"{kind.lower()}:"), F.col("idx").cast("string")).alias("fact_id"), F.lit(kind).alias("type"), value.alias("value"),
            normal.cast("string").alias("normalized_value"), F.coalesce(confidence, F.lit(config.FACT_CONFIDENCE)).alias("confidence"),
            F.when(confidence.isNotNull(), "VERIFIED").otherwise("SUPPORTED").alias("verification_status"),
            F.array(*[F.lit(x) for x in config.TRANSFORMATIONS[kind]]).alias("allowed_transformations"),
        )

    degree = F.concat_ws(" - ", T.blank_to_null(F.col("degree")), T.blank_to_null(F.col("institution")))
    return (
        part(skills, "SKILL", F.col("raw_text"), F.col("canonical_name"))
        .unionByName(part(experiences, "EXPERIENCE", F.coalesce("description", F.lit(""))))
        .unionByName(part(projects, "PROJECT", F.col("name")))
        .unionByName(part(education, "EDUCATION", degree, F.col("degree_level")))
        .unionByName(part(certifications, "CERTIFICATION", F.col("name")))
        .unionByName(part(languages, "LANGUAGE", F.col("name"), F.col("proficiency_normalized")))
    )


def permits(allowed: Column, transformation: str) -> Column:
    return F.array_contains(allowed, transformation)


def known_skill_names(facts: DataFrame, forms: list[tuple[str, str]]) -> DataFrame:
    """document_id, known array<string>: skills' names and every mention in any fact."""
    own = F.when(F.col("type") == "SKILL", F.array(F.coalesce("normalized_value", "value"))).otherwise(F.array().cast("array<string>"))
    names = T.numbered(facts, F.array_union(own, scan_mentions(F.col("value"), forms)), "_i", "n", "document_id")
    return names.groupBy("document_id").agg(F.array_sort(F.collect_set("n")).alias("known"))


def _violation(test: Column, reason: str, detail: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(reason).alias("reason"), detail.alias("detail")))


def validate_technology(original: Column, proposed: Column, known: Column, forms: list[tuple[str, str]]) -> Column:
    """Violation if the proposal names a skill that is neither in the original nor known."""
    new = F.array_except(F.array_except(scan_mentions(proposed, forms), scan_mentions(original, forms)), F.coalesce(known, F.array().cast("array<string>")))
    return _violation(F.size(new) > 0, "UNSUPPORTED_TECHNOLOGY", F.concat(F.lit("Not evidenced: "), F.array_join(F.array_sort(new), ", "), F.lit(".")))


def validate_certification(original: Column, proposed: Column) -> Column:
    fresh = proposed.rlike(config.CERTIFICATION_CLAIM) & ~F.coalesce(original, F.lit("")).rlike(config.CERTIFICATION_CLAIM)
    return _violation(fresh, "UNSUPPORTED_CERTIFICATION", F.lit("Claims a certification that the original does not."))


def claimed_years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(config.YEARS_CLAIM), F.lit(1)), lambda y: y.cast("double"))


def validate_duration(original: Column, proposed: Column, verified: Column) -> Column:
    """Violation if a new number of years cannot be verified or exceeds what is verified."""
    new = F.array_except(claimed_years(proposed), claimed_years(original))
    high = F.array_max(F.filter(new, lambda y: y > verified + config.DURATION_TOLERANCE))
    detail = F.coalesce(F.concat(F.lit("Claims "), high.cast("string"), F.lit(" years, more than verified.")), F.lit("Claims years that cannot be verified."))
    return _violation((F.size(new) > 0) & (verified.isNull() | high.isNotNull()), "DURATION_INFLATION", detail)


def validate_education(proposed: Column, highest: Column) -> Column:
    """Violation if the proposal names a degree above (or without) the verified level."""
    level = T.normalize_education_level(proposed)
    claimed, held = T.rank(level, config.EDUCATION), T.rank(highest, config.EDUCATION)
    return _violation(claimed.isNotNull() & (held.isNull() | (claimed > held)), "EDUCATION_UPGRADE", F.concat(F.lit("Claims "), level, F.lit(".")))


def validate_language(proposed: Column, verified: Column) -> Column:
    level = T.detect_proficiency_claim(proposed)
    claimed, held = T.rank(level, config.PROFICIENCY), T.rank(verified, config.PROFICIENCY)
    return _violation(claimed.isNotNull() & (held.isNull() | (claimed > held)), "LANGUAGE_PROFICIENCY_UPGRADE", F.concat(F.lit("Claims "), level, F.lit(".")))


def validate_claims(df: DataFrame, forms: list[tuple[str, str]]) -> DataFrame:
    """Add violations and is_valid.

    Columns read: original_text, proposed_text, known array<string>,
    verified_years double?, highest_education string?, verified_proficiency
    string?. The last two checks run only where their column is not null.
    """
    was, text = F.col("original_text"), F.col("proposed_text")
    school, spoken = F.col("highest_education"), F.col("verified_proficiency")
    checks = F.array(
        validate_technology(was, text, F.col("known"), forms), validate_certification(was, text), validate_duration(was, text, F.col("verified_years")),
        F.when(school.isNotNull(), validate_education(text, school)), F.when(spoken.isNotNull(), validate_language(text, spoken)),
    )
    found = df.withColumn("violations", F.filter(checks, lambda v: v.isNotNull()).cast(VIOLATIONS))
    return found.withColumn("is_valid", F.size("violations") == 0)
