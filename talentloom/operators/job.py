"""Extraction of job profiles and requirements from job-offer sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from .candidate import evidence
from .taxonomy import scan_mentions


def guess_title(raw_text: Column) -> Column:
    """First line with text, unless it has a colon or is over 80 characters."""
    first = F.get(F.filter(F.transform(T.split_lines(raw_text), T.strip), lambda x: x != ""), F.lit(0))
    return F.when(~first.contains(":") & (F.length(first) <= 80), first)


def extract_labeled_fields(header: Column) -> Column:
    """struct<company, location, employment_type, seniority> of ``label: value`` lines; the last of a label wins."""
    cut = F.transform(F.filter(T.split_lines(header), lambda x: x.contains(":")), lambda x: T.split_at_first(x, (":",)))
    pairs = F.filter(F.transform(cut, lambda p: F.struct(T.fold(p["head"]).alias("label"), T.strip(p["tail"]).alias("value"))), lambda p: p["value"] != "")
    return F.struct(*[_last_labelled(pairs, labels).alias(field) for field, labels in config.JOB_LABELS.items()])


def _last_labelled(pairs: Column, labels: tuple[str, ...]) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["label"].isin(*labels)), F.lit(-1))["value"]


def unbulleted(line: Column) -> Column:
    return T.strip(F.regexp_replace(T.strip(line), "^[-•* ]+", ""))


def extract_responsibilities(sections: DataFrame) -> DataFrame:
    """document_id, responsibilities array<string>, in order."""
    lines = sections.filter("section_type = 'RESPONSIBILITIES'").select("document_id", "section_idx", F.transform(T.filled_lines(F.col("body_text")), unbulleted).alias("l"))
    return lines.groupBy("document_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("section_idx", "l")))["l"]).alias("responsibilities"))


def extract_requirements(sections: DataFrame, forms: list[tuple[str, str]], skills: DataFrame) -> DataFrame:
    """document_id, idx, requirement_type, importance, raw_text, canonical_name, category, minimum_years, normalized_value, evidence.

    Marker lines set the importance of the lines after them; every section
    starts as REQUIRED. A skill mention beats a number of years, which beats
    a degree.
    """
    own = sections.filter("section_type = 'REQUIREMENTS'")
    lines = T.numbered(own, F.split("body_text", "\n", -1), "_i", "_raw", "document_id", "section_idx", "page_number")
    bare = lines.select("*", unbulleted(F.col("_raw")).alias("raw_text")).filter("raw_text <> ''")
    mark = T.fold(F.regexp_replace("raw_text", ":+$", ""))
    marked = bare.select("*", F.when(mark.isin(*config.REQUIRED_MARKS), "REQUIRED").when(mark.isin(*config.PREFERRED_MARKS), "PREFERRED").alias("_mark"))
    order = Window.partitionBy("document_id", "section_idx").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    told = marked.select("*", F.coalesce(F.last("_mark", ignorenulls=True).over(order), F.lit("REQUIRED")).alias("importance")).filter("_mark is null")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("section_idx", "_i")) - 1
    found = told.select("*", place.alias("idx"), F.get(scan_mentions(F.col("raw_text"), forms), F.lit(0)).alias("canonical_name"))
    typed = found.select("*", classify_requirement(F.col("raw_text"), F.col("canonical_name"), F.col("importance")).alias("requirement_type"))
    known = typed.join(skills.select("canonical_name", "category"), "canonical_name", "left")
    confidence = F.when(F.col("canonical_name").isNotNull(), config.SKILL_KNOWN_CONFIDENCE).otherwise(config.SECTION_CONFIDENCE)
    return known.select(
        "document_id", "idx", "requirement_type", "importance", "raw_text", "canonical_name", "category", F.lit(None).cast("int").alias("minimum_years"),
        F.lit(None).cast("string").alias("normalized_value"), evidence(F.col("raw_text"), confidence, F.lit("REQUIREMENTS"), F.col("page_number")).alias("evidence"),
    )


def classify_requirement(line: Column, skill: Column, importance: Column) -> Column:
    return (
        F.when(skill.isNotNull(), F.when(importance == "REQUIRED", "REQUIRED_SKILL").otherwise("PREFERRED_SKILL"))
        .when(line.rlike(config.JOB_YEARS), "EXPERIENCE")
        .when(line.rlike(config.JOB_DEGREE), "EDUCATION")
        .otherwise("OTHER")
    )


def job_profiles(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """document_id, title, company, location, employment_type, seniority, summary, responsibilities."""
    marks = sections.groupBy("document_id").agg(
        F.min(F.when((F.col("section_idx") == 0) & (F.col("section_type") == "OTHER"), F.col("body_text"))).alias("_head"),
        F.min_by("body_text", F.when(F.col("section_type") == "SUMMARY", F.col("section_idx"))).alias("_summary"),
        F.max((F.col("section_type") == "SUMMARY").cast("int")).alias("_has"),
    )
    both = docs.select("document_id", "raw_text").join(marks, "document_id", "left").join(extract_responsibilities(sections), "document_id", "left")
    return both.select(
        "document_id", guess_title(F.col("raw_text")).alias("title"), extract_labeled_fields(F.coalesce("_head", F.lit(""))).alias("_f"),
        F.when(F.col("_has") == 1, T.blank_to_null(F.col("_summary"))).alias("summary"), F.coalesce("responsibilities", F.array().cast("array<string>")).alias("responsibilities"),
    ).select("document_id", "title", "_f.*", "summary", "responsibilities")
