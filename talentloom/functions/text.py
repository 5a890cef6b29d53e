"""Column functions over text: trimming, folding, patterns, ladders, vectors.

All are built-in expressions (no Python per row). Null gives null unless said
otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

# Latin letters with marks, and what each folds to.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
_FOLD = {a: b for a, b in zip(
    "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžćčďēėęěğńňőřśşťůűźż",
    "aaaaaaceeeeiiiinooooouuuuyyszccdeeeegnnorsstuuzz", strict=True,
)}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it in a lambda."""
    return F.transform(F.array(value), then)[0]


def numbered(df: DataFrame, array: str | Column, place: str, item: str, *keep: str) -> DataFrame:
    """The columns in ``keep``, and place and value of every element of ``array``.

    The outer form, and a filter after it: before the inner form Spark tests the
    size of the array, which computes an expensive one again.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(place, item)).filter(F.col(place).isNotNull())


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def fold(c: Column) -> Column:
    """Trimmed, lower case, marks of Latin letters removed."""
    bare = F.translate(F.lower(strip(c)), "".join(_FOLD), "".join(_FOLD.values()))
    return F.regexp_replace(bare, r"\p{M}", "")


def clean_heading(c: Column) -> Column:
    """Folded, with only ``a-z0-9'`` and single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9' ]", " "), " +", " "))


def skill_key(c: Column) -> Column:
    """Key under which spellings of a skill meet."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9+#.]", "")


def split_lines(c: Column) -> Column:
    """Lines as a text editor shows them; a final line end opens no line; blank lines stay."""
    bare = F.regexp_replace(c, f"(?:{LINE_ENDS})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(bare, LINE_ENDS, -1))


def filled_lines(c: Column) -> Column:
    """Trimmed lines that are not blank (lines end at line feeds alone)."""
    return F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")


def delimited_tokens(c: Column) -> Column:
    """Parts between ``, ; | •`` and line feeds, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[,;|•\n]", -1), lambda x: F.btrim(x, F.lit(" -\t"))), lambda x: x != "")


def first_found(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def keyword_class(c: Column, classes: Sequence[tuple[str, str]], otherwise: str = "UNKNOWN") -> Column:
    """Name of the first (name, pattern) that is found in the text."""
    out = F.lit(otherwise)
    for name, pattern in reversed(classes):
        out = F.when(F.coalesce(c, F.lit("")).rlike(f"(?iuU){pattern}"), F.lit(name)).otherwise(out)
    return out


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed mapping, null if absent."""
    out = F.lit(None).cast("string")
    groups: dict[str, list[str]] = {}
    for k, v in table.items():
        groups.setdefault(v, []).append(k)
    for v, keys in groups.items():
        out = F.when(c.isin(keys), F.lit(v)).otherwise(out)
    return out


def rank(c: Column, ladder: Sequence[str]) -> Column:
    """0-based step on a ladder, null if off it."""
    found = F.array_position(F.array(*[F.lit(x) for x in ladder]), c)
    return F.when(found > 0, (found - 1).cast("int"))


def normalize_seniority(c: Column) -> Column:
    return keyword_class(c, config.SENIORITY_WORDS)


def normalize_education_level(c: Column) -> Column:
    return keyword_class(c, config.EDUCATION_WORDS)


def detect_proficiency_claim(c: Column) -> Column:
    return keyword_class(c, config.PROFICIENCY_CLAIMS)


def normalize_proficiency(c: Column) -> Column:
    table = {alias: level for level, aliases in config.PROFICIENCY_NAMES.items() for alias in aliases}
    return F.coalesce(lookup(F.lower(strip(c)), table), F.lit("UNKNOWN"))


def title_case(c: Column) -> Column:
    """First letter of every run of letters upper, the rest lower (also after ``'`` and ``-``)."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def normalize_language_name(c: Column) -> Column:
    table = {alias: name for name, aliases in config.LANGUAGE_NAMES.items() for alias in (name.lower(), *aliases)}
    return F.coalesce(lookup(F.lower(strip(c)), table), title_case(strip(c)))


def detect_language(c: Column) -> Column:
    """struct<language, confidence, secondary_language>: FR, EN or UNKNOWN."""
    text = F.coalesce(c, F.lit(""))
    hits = lambda tokens, known: F.size(F.filter(tokens, lambda w: F.lower(w).isin(known)))
    marks = config.FR_DIACRITICS + config.FR_DIACRITICS.upper()
    diacritics = (F.length(text) - F.length(F.translate(text, marks, ""))) * config.DIACRITIC_WEIGHT
    fr_marks = F.regexp_count(text, F.lit(r"(?iuU)\b[ldjmnstc]['’]|qu['’]")) * config.MARKER_WEIGHT
    en_marks = F.regexp_count(text, F.lit(r"(?iuU)\b\w+['’](?:s|t|re|ve|ll|d|m)\b")) * config.MARKER_WEIGHT
    counted = let(
        F.regexp_extract_all(text, F.lit("[a-zA-ZÀ-ÿ']+"), F.lit(0)),
        lambda t: F.struct(F.size(t).alias("n"), (hits(t, config.FR_WORDS) + diacritics + fr_marks).alias("fr"), (hits(t, config.EN_WORDS) + en_marks).alias("en")),
    )
    return let(counted, lambda s: _language_of(s["n"], s["fr"], s["en"]))


def _language_of(n: Column, fr: Column, en: Column) -> Column:
    share = F.bround(F.greatest(fr, en) / F.nullif(fr + en, F.lit(0.0)), 4)
    told = (n >= config.MIN_SIGNAL_WORDS) & (fr + en > 0)
    other = F.when((F.least(fr, en) > 0) & (share < config.BILINGUAL), F.when(fr >= en, F.lit("EN")).otherwise("FR"))
    return F.struct(
        F.when(told, F.when(fr >= en, "FR").otherwise("EN")).otherwise("UNKNOWN").alias("language"),
        F.when(told, share).otherwise(0.0).alias("confidence"),
        F.when(told, other).alias("secondary_language"),
    )


def date_range(line: Column) -> Column:
    """struct<prefix, start, end> of a line that is, or ends with, a date range; else null."""
    bare = strip(line)
    part = lambda pattern, i: strip(F.regexp_extract(bare, pattern, i))
    return F.when(
        bare.rlike(config.DATE_LINE),
        F.struct(F.lit("").alias("prefix"), part(config.DATE_LINE, 1).alias("start"), part(config.DATE_LINE, 2).alias("end")),
    ).when(
        bare.rlike(config.DATED_LINE),
        F.struct(part(config.DATED_LINE, 1).alias("prefix"), part(config.DATED_LINE, 2).alias("start"), part(config.DATED_LINE, 3).alias("end")),
    )


def is_current(end: Column) -> Column:
    """Whether an end date says that it is still going on."""
    return F.coalesce(F.regexp_replace(fold(end), "[^a-z0-9 ]", "").isin(*config.CURRENT_MARKS), F.lit(False))


def split_at_first(text: Column, marks: Sequence[str]) -> Column:
    """struct<head, tail> around the first occurrence of the first mark that occurs; tail null without one."""
    out = F.struct(text.alias("head"), F.lit(None).cast("string").alias("tail"))
    for mark in reversed(marks):
        at = F.locate(mark, text)
        out = F.when(
            at > 0,
            F.struct(F.substring(text, F.lit(1), at - 1).alias("head"), F.substring(text, at + len(mark), F.length(text)).alias("tail")),
        ).otherwise(out)
    return out


def split_title_company(header: Column) -> Column:
    """struct<title, company> of an entry's header line."""
    parts = split_at_first(header, config.COMPANY_MARKS)
    return F.struct(blank_to_null(strip(parts["head"])).alias("title"), blank_to_null(strip(parts["tail"])).alias("company"))


def looks_like_location(line: Column) -> Column:
    bare = strip(line)
    return F.coalesce(
        (bare != "") & (F.length(bare) <= 60) & bare.contains(",") & ~bare.rlike(r"(?U)\d") & ~F.lower(bare).startswith("technologies"), F.lit(False)
    )


def entry_label(title: Column, company: Column, otherwise: str | None = None) -> Column:
    """``title at company``, from what there is."""
    joined = blank_to_null(F.concat_ws(" at ", blank_to_null(title), blank_to_null(company)))
    return F.coalesce(joined, F.lit(otherwise)) if otherwise is not None else joined


def overlap_tokens(c: Column) -> Column:
    """Distinct words that count for lexical overlap (null: none)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(config.OVERLAP_STOP)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of distinct tokens, 0 if either is empty."""
    share = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def lexical_overlap(a: Column, b: Column) -> Column:
    return jaccard(overlap_tokens(a), overlap_tokens(b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for empty ones, unequal lengths or a zero norm."""
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    fine = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.coalesce(F.when(fine, dot / (norm(a) * norm(b))), F.lit(0.0))


def hash_embedding(text: Column, dims: int = 32) -> Column:
    """Deterministic vector of a text: its SHA-256 bytes, repeated or cut, scaled to -1 .. 1."""
    digest = F.sha2(text, 256)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1,
    )


def skill_domain(category: Column) -> Column:
    return lookup(category, config.CATEGORY_DOMAIN)


def year_of(c: Column) -> Column:
    return first_found(c, config.YEAR).cast("int")


def end_year(end: Column) -> Column:
    """Year of an end date; null if it is open, missing or unreadable."""
    return F.when(~(blank_to_null(end).isNull() | end.rlike(config.OPEN_END)), year_of(end))


def year_range(begin: Column, end: Column, reference_year: Column) -> Column:
    """struct<from, to> of a first and last year (null: the reference year); null without a first year or with an end before it."""
    stop = F.coalesce(end, reference_year)
    return F.when(begin.isNotNull() & (stop >= begin), F.struct(begin.alias("from"), stop.cast("int").alias("to")))


def years_covered(ranges: Column) -> Column:
    """Years that the merged (overlapping or touching) ranges of an array cover, as a double."""
    first = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("reach"))

    def step(state: Column, r: Column) -> Column:
        fresh = state["reach"].isNull() | (r["from"] > state["reach"])
        gain = F.when(fresh, r["to"] - r["from"]).otherwise(F.greatest(r["to"] - state["reach"], F.lit(0)))
        return F.struct((state["sum"] + gain).alias("sum"), F.greatest(state["reach"], r["to"]).alias("reach"))

    return F.aggregate(F.array_sort(ranges), first, step, lambda s: s["sum"])


def parse_proposal(response: Column) -> Column:
    """The proposed text of a JSON answer, else of something like one; null without."""
    loose = F.regexp_extract(response, r'(?s)"proposed_text"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(loose, r"\\n", "\n"), r"\\t", "\t"), r'\\(["\\/])', "$1")
    return F.coalesce(F.get_json_object(response, "$.proposed_text"), F.when(response.rlike(r'(?s)"proposed_text"\s*:\s*"((?:[^"\\]|\\.)*)"'), plain))


def exact_round(x: Column, digits: int = 4) -> Column:
    """Half-even rounding of the exact binary value (``bround`` goes by the shortest decimal form).

    ``x`` should be a plain column, as it is used several times. The product
    with the power of ten is split in two parts without error, so that true
    ties are told from near ones.
    """
    scale = float(10**digits)
    wide = x * float((1 << 27) + 1)
    high = wide - (wide - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    down = F.floor(product).cast("double")
    over = (product - down - 0.5) + error
    up = (over > 0) | ((over == 0) & (down % 2 != 0))
    return F.when(up, down + 1).otherwise(down) / scale


Embedder = Callable[[list[str]], list[list[float]]]
