"""Extraction of candidate profiles from CV sections.

Sections come from ``detect_sections``. Entries keep their 0-based position in
the document (``idx``); positions are what facts and enrichment refer to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from .taxonomy import normalize_skill_name

EVIDENCE_LENGTH = 500


def evidence(text: Column, confidence: Column, section: Column, page: Column | None = None) -> Column:
    """struct<source_document_id, text, extraction_method, confidence, page_number, section>."""
    return F.struct(
        F.col("document_id").alias("source_document_id"), text.alias("text"), F.lit("RULE").alias("extraction_method"),
        confidence.cast("double").alias("confidence"), (page if page is not None else F.lit(None)).cast("int").alias("page_number"), section.alias("section"),
    )


def guess_full_name(raw_text: Column) -> Column:
    """First line with text, if it reads like a name; never a later one."""
    first = F.get(F.filter(F.transform(T.split_lines(raw_text), T.strip), lambda x: x != ""), F.lit(0))
    fine = ~first.contains("@") & ~first.rlike(r"(?U)\d") & (F.size(F.split(first, r"(?U)\s+")).between(1, 5)) & (F.length(first) <= 60)
    return F.when(fine, first)


def extract_email(text: Column) -> Column:
    return T.first_found(text, config.EMAIL)


def extract_phone(text: Column) -> Column:
    """First line's number of seven digits or more, e-mail addresses set aside."""
    lines = F.transform(T.split_lines(text), lambda x: F.regexp_extract(F.regexp_replace(x, config.EMAIL, ""), config.PHONE, 0))
    return F.get(F.transform(F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 7), T.strip), F.lit(0))


def extract_links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(config.LINK), F.lit(0)))


def guess_location(text: Column) -> Column:
    """Among the first eight lines, the first short one with a comma and neither digit nor ``@``."""
    lines = F.transform(F.slice(T.split_lines(text), 1, 8), T.strip)
    fine = F.filter(lines, lambda x: x.contains(",") & (F.length(x) <= 40) & ~x.rlike(r"(?U)\d") & ~x.contains("@"))
    return F.get(fine, F.lit(0))


def candidate_profiles(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """document_id, full_name, contact struct, summary."""
    marks = sections.groupBy("document_id").agg(
        F.min(F.when((F.col("section_idx") == 0) & (F.col("section_type") == "OTHER"), F.col("body_text"))).alias("_head"),
        F.min_by("body_text", F.when(F.col("section_type") == "SUMMARY", F.col("section_idx"))).alias("_summary"),
        F.max((F.col("section_type") == "SUMMARY").cast("int")).alias("_has"),
    )
    both = docs.select("document_id", "raw_text").join(marks, "document_id", "left")
    text = F.col("raw_text")
    head_first = lambda f: F.coalesce(f(F.col("_head")), f(text))
    contact = F.struct(
        head_first(extract_email).alias("email"), head_first(extract_phone).alias("phone"),
        guess_location(F.coalesce("_head", text)).alias("location"), extract_links(text).alias("links"),
    )
    return both.select("document_id", guess_full_name(text).alias("full_name"), contact.alias("contact"), F.when(F.col("_has") == 1, T.blank_to_null(F.col("_summary"))).alias("summary"))


def document_evidence(profiles: DataFrame) -> DataFrame:
    """One row for each of name, e-mail, phone, location and summary that was found."""
    c = config
    fields = (
        ("full_name", F.col("full_name"), c.HEURISTIC_CONFIDENCE, "OTHER"), ("email", F.col("contact.email"), c.CONTACT_CONFIDENCE, "OTHER"),
        ("phone", F.col("contact.phone"), c.CONTACT_CONFIDENCE, "OTHER"), ("location", F.col("contact.location"), c.HEURISTIC_CONFIDENCE, "OTHER"),
        ("summary", F.substring("summary", 1, EVIDENCE_LENGTH), c.SECTION_CONFIDENCE, "SUMMARY"),
    )
    rows = F.array(*[F.struct(F.lit(name).alias("field"), evidence(value, F.lit(conf), F.lit(section)).alias("evidence")) for name, value, conf, section in fields])
    return profiles.select("document_id", F.explode(rows).alias("r")).select("document_id", "r.field", "r.evidence").filter("evidence.text is not null")


def _entries(sections: DataFrame, kind: str, starts_entry) -> DataFrame:
    """document_id, idx, entry, page_number of the entries in sections of one kind.

    Blank lines part entries; inside a block so does every later line for
    which ``starts_entry`` holds.
    """
    chosen = sections.filter(F.col("section_type") == kind)
    parts = F.filter(F.transform(F.split("body_text", "\n\n", -1), T.strip), lambda b: b != "")
    blocks = T.numbered(chosen, parts, "_b", "block", "document_id", "section_idx", "page_number")
    lined = blocks.select("*", F.split("block", "\n", -1).alias("_lines"))
    flagged = lined.select("*", F.transform("_lines", lambda x, i: (i == 0) | starts_entry(x)).alias("_flags"))
    started = flagged.select("*", F.filter(F.transform("_flags", lambda f, i: F.when(f, i)), lambda i: i.isNotNull()).alias("_starts"))
    each = T.numbered(started, "_starts", "_k", "_at", "*")
    stop = F.coalesce(F.get("_starts", F.col("_k") + 1), F.size("_lines"))
    entry = T.strip(F.array_join(F.slice("_lines", F.col("_at") + 1, stop - F.col("_at")), "\n"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("section_idx", "_b", "_k")) - 1
    return each.withColumn("entry", entry).filter("entry <> ''").select("document_id", place.alias("idx"), "entry", "page_number")


def split_entries(sections: DataFrame, kind: str = "EXPERIENCE") -> DataFrame:
    """Entries of dated sections: a line that ends with a date range after some text starts one."""
    return _entries(sections, kind, lambda x: F.coalesce(T.date_range(x)["prefix"] != "", F.lit(False)))


def split_project_entries(sections: DataFrame) -> DataFrame:
    """Entries of project sections: a line that ends with ``(A, B, ...)`` starts one."""
    return _entries(sections, "PROJECTS", lambda x: T.strip(x).rlike(config.PROJECT_LINE))


def _dated(entries: DataFrame) -> DataFrame:
    """Split off header, dates and the remaining lines of every entry."""
    lined = entries.select("*", T.filled_lines(F.col("entry")).alias("_l")).filter(F.size("_l") > 0)
    head, second = F.get("_l", F.lit(0)), T.strip(F.coalesce(F.get("_l", F.lit(1)), F.lit("")))
    own = T.date_range(head)
    found = lined.select("*", F.when(own["prefix"] != "", own).alias("_own"), second.rlike(config.DATE_LINE).alias("_next"), second.alias("_second"))
    led = F.col("_own").isNotNull()
    below = ~led & F.col("_next")
    part = lambda i: T.strip(F.regexp_extract("_second", config.DATE_LINE, i))
    return found.select(
        "document_id", "idx", "entry", "page_number",
        F.when(led, F.col("_own.prefix")).otherwise(head).alias("_header"),
        F.when(led, F.col("_own.start")).when(below, part(1)).alias("start_date_raw"),
        F.when(led, F.col("_own.end")).when(below, part(2)).alias("end_date_raw"),
        F.slice("_l", F.when(below, 3).otherwise(2), F.size("_l")).alias("_rest"),
    )


def _technologies(lines: Column) -> Column:
    """Tokens of the last ``Technologies:`` line."""
    named = F.filter(lines, lambda x: F.lower(x).startswith("technologies:"))
    last = F.try_element_at(named, F.lit(-1))
    return F.when(F.size(named) > 0, T.delimited_tokens(F.substring(last, F.lit(14), F.length(last))))


def extract_experiences(sections: DataFrame) -> DataFrame:
    """document_id, idx, title, company, start_date_raw, end_date_raw, description, achievements, technologies, location, is_current, evidence."""
    dated = _dated(split_entries(sections))
    named = dated.select("*", T.split_title_company(F.col("_header")).alias("_n"), F.get("_rest", F.lit(0)).alias("_first"))
    place = T.looks_like_location(F.coalesce("_first", F.lit("")))
    told = named.select("*", place.alias("_place"), T.split_at_first(F.col("_first"), (",",)).alias("_cut"))
    joint = F.col("_place") & F.col("_n.company").isNull()
    cut = told.select(
        "*", F.when(joint, T.blank_to_null(T.strip(F.col("_cut.head")))).otherwise(F.col("_n.company")).alias("company"),
        F.when(joint, T.blank_to_null(T.strip(F.col("_cut.tail")))).when(F.col("_place"), T.strip(F.col("_first"))).alias("location"),
        F.when(F.col("_place"), F.slice("_rest", 2, F.size("_rest"))).otherwise(F.col("_rest")).alias("_body"),
    )
    tech = lambda x: F.lower(x).startswith("technologies:")
    bullet = lambda x: x.rlike("^[-•*]")
    empty = F.array().cast("array<string>")
    return cut.select(
        "document_id", "idx", F.col("_n.title").alias("title"), "company", "start_date_raw", "end_date_raw",
        T.blank_to_null(F.array_join(F.filter("_body", lambda x: ~tech(x) & ~bullet(x)), " ")).alias("description"),
        F.transform(F.filter("_body", lambda x: ~tech(x) & bullet(x)), lambda x: T.strip(F.regexp_replace(x, "^[-•* ]+", ""))).alias("achievements"),
        F.coalesce(_technologies(F.col("_body")), empty).alias("technologies"), "location", T.is_current(F.col("end_date_raw")).alias("is_current"),
        evidence(F.col("entry"), F.lit(config.SECTION_CONFIDENCE), F.lit("EXPERIENCE"), F.col("page_number")).alias("evidence"),
    )


def extract_education(sections: DataFrame) -> DataFrame:
    """document_id, idx, institution, degree, field_of_study (null), dates, location, evidence."""
    dated = _dated(split_entries(sections, "EDUCATION"))
    named = dated.select("*", T.split_title_company(F.col("_header")).alias("_n"), F.get("_rest", F.lit(0)).alias("_first"))
    return named.select(
        "document_id", "idx", F.col("_n.company").alias("institution"), F.col("_n.title").alias("degree"), F.lit(None).cast("string").alias("field_of_study"),
        "start_date_raw", "end_date_raw", F.when(T.looks_like_location(F.coalesce("_first", F.lit(""))), T.strip(F.col("_first"))).alias("location"),
        evidence(F.col("entry"), F.lit(config.SECTION_CONFIDENCE), F.lit("EDUCATION"), F.col("page_number")).alias("evidence"),
    )


def extract_projects(sections: DataFrame) -> DataFrame:
    """document_id, idx, name, description, technologies, evidence."""
    lined = split_project_entries(sections).select("*", T.filled_lines(F.col("entry")).alias("_l")).filter(F.size("_l") > 0)
    head = F.get("_l", F.lit(0))
    listed = head.rlike(config.PROJECT_LINE)
    rest = F.slice("_l", 2, F.size("_l"))
    own = F.when(listed, T.delimited_tokens(F.regexp_extract(head, config.PROJECT_LINE, 2)))
    return lined.select(
        "document_id", "idx", F.when(listed, T.strip(F.regexp_extract(head, config.PROJECT_LINE, 1))).otherwise(head).alias("name"),
        T.blank_to_null(F.array_join(F.filter(rest, lambda x: ~F.lower(x).startswith("technologies:")), " ")).alias("description"),
        F.coalesce(_technologies(rest), own, F.array().cast("array<string>")).alias("technologies"),
        evidence(F.col("entry"), F.lit(config.SECTION_CONFIDENCE), F.lit("PROJECTS"), F.col("page_number")).alias("evidence"),
    )


def _section_lines(sections: DataFrame, kind: str, wanted=lambda x: x != "") -> DataFrame:
    """document_id, idx, line, page_number of the wanted lines in sections of one kind."""
    lines = T.numbered(sections.filter(F.col("section_type") == kind), T.filled_lines(F.col("body_text")), "_i", "line", "document_id", "section_idx", "page_number")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("section_idx", "_i")) - 1
    return lines.filter(wanted(F.col("line"))).select("document_id", place.alias("idx"), "line", "page_number")


def extract_certifications(sections: DataFrame) -> DataFrame:
    """document_id, idx, name, issuer, date_raw, evidence."""
    parts = F.transform(F.split("line", ",", -1), T.strip)
    lines = _section_lines(sections, "CERTIFICATIONS", lambda x: T.strip(F.split(x, ",", -1)[0]) != "")
    return lines.select(
        "document_id", "idx", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("issuer"), F.get(parts, F.lit(2)).alias("date_raw"),
        evidence(F.col("line"), F.lit(config.SECTION_CONFIDENCE), F.lit("CERTIFICATIONS"), F.col("page_number")).alias("evidence"),
    )


def extract_languages(sections: DataFrame) -> DataFrame:
    """document_id, idx, name, proficiency, evidence."""
    cut = T.split_at_first(F.col("line"), config.LANGUAGE_MARKS)
    return _section_lines(sections, "LANGUAGES").select(
        "document_id", "idx", T.strip(cut["head"]).alias("name"), T.blank_to_null(F.btrim(cut["tail"], F.lit(" )"))).alias("proficiency"),
        evidence(F.col("line"), F.lit(config.SECTION_CONFIDENCE), F.lit("LANGUAGES"), F.col("page_number")).alias("evidence"),
    )


def extract_skills(sections: DataFrame, alias_index: DataFrame, technical: bool = False) -> DataFrame:
    """document_id, idx, raw_text, canonical_name, category, evidence; unknown skills stay with nulls.

    Only SKILLS sections are read; ``technical`` adds TECHNICAL_SKILLS.
    """
    kinds = ["SKILLS", "TECHNICAL_SKILLS"] if technical else ["SKILLS"]
    own = sections.filter(F.col("section_type").isin(kinds))
    tokens = T.numbered(own, T.delimited_tokens(F.col("body_text")), "_i", "raw_text", "document_id", "section_idx", "section_type", "page_number")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("section_idx", "_i")) - 1
    known = normalize_skill_name(tokens.withColumn("idx", place), "raw_text", alias_index)
    confidence = F.when(F.col("canonical_name").isNotNull(), config.SKILL_KNOWN_CONFIDENCE).otherwise(config.SKILL_UNKNOWN_CONFIDENCE)
    return known.select("document_id", "idx", "raw_text", "canonical_name", "category", evidence(F.col("raw_text"), confidence, F.lit("SKILLS"), F.col("page_number")).alias("evidence"))
