"""Lines and sections of documents.

A document's lines stay one array, so that sections come without a shuffle from
plain texts, and with one (by document) from a table of lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T

LINE = "struct<text:string,page_number:int,font_size:double,is_bold:boolean,is_heading_style:boolean,column_index:int>"


def explode_lines(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """document_id, line_no, page_number, text: blank lines stay.

    ``pages``: document_id, page_number, text, for formats with pages.
    """
    if pages is None:
        split = docs.select("document_id", F.posexplode(T.split_lines(F.col("raw_text"))).alias("line_no", "text"))
        return split.select("document_id", "line_no", F.lit(None).cast("int").alias("page_number"), "text")
    lists = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("_p"))
    lines = F.flatten(F.transform("_p", lambda p: F.transform(T.split_lines(p["text"]), lambda x: F.struct(p["page_number"].alias("page_number"), x.alias("text")))))
    return lists.select("document_id", F.posexplode(lines).alias("line_no", "l")).select("document_id", "line_no", "l.page_number", "l.text")


def _kinds(headings: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Section type by alias."""
    return {a: kind for kind, aliases in headings.items() for a in aliases}


def trie_pattern(words: list[str]) -> str:
    """A pattern of all ``words`` as a trie: at a place it takes the longest word that starts there, in one walk."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def walk(node: dict) -> str:
        parts = [re.escape(letter) + walk(below) for letter, below in sorted(node.items()) if letter]
        if not parts:
            return ""
        inner = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return inner + ("?" if "" in node else "")

    return walk(root)


def _constant(values: list[str]) -> Column:
    """A constant array, folded by the optimizer."""
    return F.split(F.lit("\n".join(values)), "\n")


def section_heading(c: Column, headings: dict[str, tuple[str, ...]] = config.HEADINGS) -> Column:
    """Section type of a heading: exact alias, else the longest alias inside it (ties by alias), else OTHER."""
    return T.let(T.clean_heading(c), lambda clean: _heading_type(clean, headings))


def _heading_type(clean: Column, headings: dict[str, tuple[str, ...]]) -> Column:
    kinds = _kinds(headings)
    # The longest alias that starts at each place, then the longest of these.
    found = F.regexp_extract_all(clean, F.lit(f"(?=({trie_pattern(list(kinds))}))"), F.lit(1))
    inside = F.array_min(F.transform(found, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a"))))["a"]
    hit = F.when(clean.isin(*kinds), clean).otherwise(inside)
    place = F.array_position(_constant(list(kinds)), hit).cast("int") - 1
    return F.coalesce(F.get(_constant(list(kinds.values())), place), F.lit("OTHER"))


def heading_score(line: Column, typical: Column, headings: dict[str, tuple[str, ...]] = config.HEADINGS) -> Column:
    """Sum of weak signals that a line is a heading, at most 1; ``line`` is a LINE struct."""
    return T.let(T.strip(line["text"]), lambda bare: _bare_score(bare, line, typical, headings))


def _bare_score(bare: Column, line: Column, typical: Column, headings: dict[str, tuple[str, ...]]) -> Column:
    out = (bare == "") | (F.length(bare) > config.HEADING_LENGTH) | bare.rlike("[.,;]$")
    scored = T.let(T.clean_heading(bare), lambda clean: _signals(bare, clean, line, typical, headings))
    return F.when(out, 0.0).otherwise(scored)


def _signals(bare: Column, clean: Column, line: Column, typical: Column, headings: dict[str, tuple[str, ...]]) -> Column:
    parts = config.HEADING_PARTS
    kinds = _kinds(headings)
    caps = (bare == F.upper(bare)) & (bare != F.lower(bare)) & (F.length(bare) >= 5) & (F.size(F.split(bare, r"(?U)\s+")) <= 6)
    large = (line["font_size"] > 0) & (typical > 0) & (line["font_size"] >= typical * config.FONT_RATIO)
    few = F.size(F.split(clean, " ")) <= 3
    when = lambda test, part: F.when(F.coalesce(test, F.lit(False)), parts[part]).otherwise(0.0)
    total = when(line["is_heading_style"], "style") + when(clean.isin(*kinds), "alias") + when(caps, "caps") + when(large, "font")
    total = total + when(line["is_bold"], "bold") + F.when(few, when(clean.rlike(trie_pattern(list(kinds))), "contains")).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def line_arrays(docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """document_id, lines array<LINE>, typical_font_size (median of the sizes above zero)."""
    if lines is None:
        blank = lambda kind: F.lit(None).cast(kind)
        made = F.transform(
            T.split_lines(F.coalesce(F.col("raw_text"), F.lit(""))),
            lambda x: F.struct(
                x.alias("text"), blank("int").alias("page_number"), blank("double").alias("font_size"), blank("boolean").alias("is_bold"),
                F.lit(False).alias("is_heading_style"), blank("int").alias("column_index"),
            ),
        )
        return docs.select("document_id", made.alias("lines"), blank("double").alias("typical_font_size"))
    row = F.struct("line_no", F.struct("text", "page_number", "font_size", "is_bold", "is_heading_style", "column_index").cast(LINE).alias("l"))
    return lines.groupBy("document_id").agg(
        F.array_sort(F.collect_list(row))["l"].alias("lines"), F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).alias("typical_font_size")
    )


def typical_font_size(lines: DataFrame) -> DataFrame:
    """document_id, typical_font_size: median of the sizes above zero."""
    return lines.groupBy("document_id").agg(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).alias("typical_font_size"))


def detect_sections(docs: DataFrame, lines: DataFrame | None = None, headings: dict[str, tuple[str, ...]] = config.HEADINGS) -> DataFrame:
    """document_id, section_idx, section_type, heading_text, body_text, page_number, language, confidence, column_index.

    A line that scores as a heading opens a section; lines before the first
    make a leading OTHER section; one without heading and body is dropped.
    ``lines``: layout-aware lines, else the lines of ``raw_text``.
    """
    rows = line_arrays(docs, lines)
    if lines is not None:
        rows = rows.join(docs.select("document_id", "raw_text"), "document_id")
    else:
        rows = rows.withColumn("raw_text", F.array_join("lines.text", "\n"))
    scored = rows.filter(F.size("lines") > 0).select(
        "document_id", T.detect_language(F.col("raw_text"))["language"].alias("language"),
        T.let(F.struct("lines", F.transform("lines", lambda x: heading_score(x, F.col("typical_font_size"), headings)).alias("scores")), _cut).alias("_sections"),
    )
    each = T.numbered(scored, "_sections", "section_idx", "s", "document_id", "language")
    return each.select(
        "document_id", "section_idx", F.when(F.col("s.led"), section_heading(F.col("s.heading_text"), headings)).otherwise("OTHER").alias("section_type"),
        "s.heading_text", "s.body_text", "s.page_number", "language", "s.confidence", "s.column_index",
    )


def _cut(found: Column) -> Column:
    """Sections of struct<lines, scores>, cut in the row: only its own text goes with each."""
    heads = F.filter(F.transform(found["scores"], lambda s, i: F.when(s >= config.HEADING_THRESHOLD, i)), lambda i: i.isNotNull())
    texts = F.transform(found["lines"], lambda x: F.coalesce(x["text"], F.lit("")))
    bound = F.struct(F.concat(F.array(F.lit(-1)), heads, F.array(F.size(found["lines"]))).alias("edges"), texts.alias("texts"))

    def section(x: Column, k: Column) -> Column:
        at, stop = F.get(x["edges"], k), F.get(x["edges"], k + 1)
        led, head = at >= 0, F.get(found["lines"], F.greatest(at, F.lit(0)))
        return F.struct(
            led.alias("led"), F.when(led, T.strip(head["text"])).otherwise("").alias("heading_text"),
            T.strip(F.array_join(F.slice(x["texts"], at + 2, stop - at - 1), "\n")).alias("body_text"), head["page_number"].alias("page_number"),
            F.when(led, F.get(found["scores"], at)).otherwise(1.0).alias("confidence"), head["column_index"].alias("column_index"),
        )

    every = T.let(bound, lambda x: F.transform(F.sequence(F.lit(0), F.size(x["edges"]) - 2), lambda k: section(x, k)))
    return F.filter(every, lambda s: (s["heading_text"] != "") | (s["body_text"] != ""))


def section_summary(sections: DataFrame) -> DataFrame:
    """document_id, sections: what is kept on the document about its sections, in order."""
    row = F.struct("section_idx", F.struct(F.col("section_type").alias("type"), F.col("heading_text").alias("heading"), F.col("page_number").alias("page"), "language", "confidence").alias("s"))
    return sections.groupBy("document_id").agg(F.array_sort(F.collect_list(row))["s"].alias("sections"))
