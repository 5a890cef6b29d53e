"""Matching candidates with jobs, one row a (candidate, job, demand).

Everything about a candidate is gathered once into a facts row, everything a job
asks for into one row of demands in order. A pair meets both once, as one row;
only then are its demands opened, and their place is their number. Where few demands
differ, a pair carries their numbers, and every task holds the demands. Every rule after
that is narrow, and scoring by pair needs no further shuffle. Facts that are stored
with ``store_facts`` are not shuffled either. Skills are looked up inside the
candidate's map, never joined on the skill, so that a skill that most people have
is no hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..sources.documents import scratch_dir
from .semantic import best_meanings, with_units

EVALUATION = ("status", "match_signal", "matched_skill", "source_label", "semantic_score", "explanation", "evidence")


# --- shared scales -------------------------------------------------------------
def priority_from_importance(c: Column) -> Column:
    return F.when(c == "REQUIRED", "MANDATORY").when(c == "PREFERRED", "PREFERRED").otherwise("OPTIONAL")


def signal_strength(signal: Column, semantic: Column | None = None) -> Column:
    score = semantic if semantic is not None else F.lit(None).cast("double")
    meaning = F.when(score >= config.SEMANTIC_STRONG, "GOOD").when(score >= config.SEMANTIC_PARTIAL, "PARTIAL").otherwise("WEAK")
    return F.when(signal == "SEMANTIC_MATCH", meaning).otherwise(T.lookup(signal, config.SIGNAL_STRENGTH))


def _numbers(c: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def strength_score(strength: Column) -> Column:
    return _numbers(strength, config.STRENGTH_SCORE)


def signal_confidence(signal: Column, semantic: Column | None = None) -> Column:
    score = semantic if semantic is not None else F.lit(None).cast("double")
    meaning = F.coalesce(F.when(score.isNotNull(), F.least(score, F.lit(config.SEMANTIC_CONFIDENCE_CAP))), F.lit(config.SEMANTIC_CONFIDENCE_DEFAULT))
    return F.when(signal == "SEMANTIC_MATCH", meaning).otherwise(_numbers(signal, config.SIGNAL_CONFIDENCE))


def skill_status(signal: Column) -> Column:
    return F.when(signal.isin("EXACT_MATCH", "ALIAS_MATCH"), "MET").when(signal == "NO_EVIDENCE", "NOT_MET").otherwise("PARTIALLY_MET")


def is_alias_surface_form(raw: Column, canonical: Column) -> Column:
    """Whether a spelling differs from the canonical name (null: no)."""
    return F.coalesce(F.lower(T.strip(raw)) != F.lower(canonical), F.lit(False))


# --- facts of candidates -------------------------------------------------------
def candidate_skill_index(skills: DataFrame, experiences: DataFrame, projects: DataFrame) -> DataFrame:
    """candidate_id, canonical_name, ord, signals array<struct<source_type, source_label, raw_text>>.

    Resolved mentions of the skills section first, then technologies of
    experiences, then of projects; ``ord`` is a name's first place.
    """
    return _skill_index(skills, experiences, projects).drop("domains")


def _skill_index(skills: DataFrame, experiences: DataFrame, projects: DataFrame) -> DataFrame:
    """``candidate_skill_index``, and the domains of a name's mentions in the skills section, so that skills are read once."""
    label = T.entry_label(F.col("title"), F.col("company"))
    none = F.lit(None).cast("string")
    row = lambda df, part, name, kind, what, raw: df.select(
        "candidate_id", name.alias("canonical_name"), F.struct(F.lit(part).alias("part"), F.col("idx"), F.col("_j").alias("j")).alias("place"),
        F.struct(F.lit(kind).alias("source_type"), what.alias("source_label"), raw.alias("raw_text")).alias("signal"),
        (T.skill_domain(F.col("category")) if part == 0 else none).alias("domain"),
    )
    mentions = row(skills.filter("canonical_name is not null").withColumn("_j", F.lit(0)), 0, F.col("canonical_name"), "SKILL_SECTION", none, F.col("raw_text"))
    worked = experiences.select("candidate_id", "idx", "title", "company", F.posexplode("technologies").alias("_j", "t"))
    built = projects.select("candidate_id", "idx", "name", F.posexplode("technologies").alias("_j", "t"))
    every = mentions.unionByName(row(worked, 1, F.col("t"), "EXPERIENCE", label, F.col("t"))).unionByName(row(built, 2, F.col("t"), "PROJECT", F.col("name"), F.col("t")))
    grouped = every.groupBy("candidate_id", "canonical_name").agg(F.array_sort(F.collect_list(F.struct("place", "signal"))).alias("_s"), F.collect_list("domain").alias("domains"))
    return grouped.select("candidate_id", "canonical_name", F.col("_s")[0]["place"].alias("place"), F.col("_s.signal").alias("signals"), "domains")


def candidate_facts(
    skills: DataFrame, experiences: DataFrame, projects: DataFrame, education: DataFrame, certifications: DataFrame, languages: DataFrame
) -> DataFrame:
    """One row a candidate: skill map and names in order, experiences, education, certifications, languages, domain counts."""
    index = _skill_index(skills, experiences, projects)
    ordered = F.array_sort(F.collect_list(F.struct("place", "canonical_name", "signals")))
    counts = T.let(F.col("_d"), lambda d: F.transform(F.array_sort(F.array_distinct(d)), lambda x: F.struct(x.alias("domain"), F.size(F.filter(d, lambda y: y == x)).cast("long").alias("n"))))
    by_skill = index.groupBy("candidate_id").agg(ordered.alias("_o"), F.flatten(F.collect_list("domains")).alias("_d")).select(
        "candidate_id", F.map_from_arrays("_o.canonical_name", "_o.signals").alias("skill_map"), F.col("_o.canonical_name").alias("skill_names"),
        F.when(F.size("_d") > 0, counts).alias("domains"),
    )
    listed = lambda df, name, *cols: df.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("idx", *cols))).alias(name))
    worked = experiences.withColumns({
        "label": T.entry_label(F.col("title"), F.col("company"), "an experience entry"),
        "tokens": T.overlap_tokens(F.concat_ws(" ", "description", F.array_join("achievements", " "))),
        "began": T.year_of(F.col("start_date_raw")), "ended": T.end_year(F.col("end_date_raw")),
    })
    parts = [
        by_skill,
        listed(worked, "experiences", "label", "began", "ended", "technologies", "seniority", "description", "tokens"),
        listed(education, "education", "degree_level"),
        listed(certifications.withColumn("folded", _collapsed(F.col("name"))), "certifications", "name", "folded"),
        listed(languages.withColumn("level", T.rank(F.col("proficiency_normalized"), config.PROFICIENCY)), "languages", "canonical_name", "level"),
    ]
    # One grouping instead of outer joins, each of which would deal all facts anew; parts that are dealt by candidate stay where they are.
    every = reduce(lambda a, b: a.unionByName(b, True), parts)
    out = every.groupBy("candidate_id").agg(*[F.first(c, True).alias(c) for c in every.columns if c != "candidate_id"])
    return out.withColumns({"peak": T.rank(peak_seniority(F.col("experiences")), config.SENIORITY), "school": T.rank(highest_education(F.col("education")), config.EDUCATION)})


def domain_counts(skills: DataFrame) -> DataFrame:
    """candidate_id, domains array<struct<domain, n>> of resolved skills-section mentions."""
    known = skills.filter("canonical_name is not null").select("candidate_id", T.skill_domain(F.col("category")).alias("domain")).filter("domain is not null")
    counted = known.groupBy("candidate_id", "domain").agg(F.count("*").alias("n"))
    return counted.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("domain", "n"))).alias("domains"))


def years_of_experience(experiences: Column, technology: Column, reference_year: Column, read: bool = False) -> Column:
    """Years that a candidate's experiences (with the technology, if not null) cover.

    0 if none is relevant; null if none of the relevant ones has readable years.
    ``read``: the experiences have their years as numbers (began, ended).
    """
    relevant = F.filter(experiences, lambda e: technology.isNull() | F.coalesce(F.array_contains(e["technologies"], technology), F.lit(False)))
    years = (lambda e: (e["began"], e["ended"])) if read else (lambda e: (T.year_of(e["start_date_raw"]), T.end_year(e["end_date_raw"])))
    ranges = F.filter(F.transform(relevant, lambda e: T.year_range(*years(e), reference_year)), lambda r: r.isNotNull())
    return T.let(F.struct(F.coalesce(F.size(relevant), F.lit(0)).alias("n"), ranges.alias("r")), lambda x: F.when(x["n"] <= 0, 0.0).when(F.size(x["r"]) > 0, T.years_covered(x["r"])))


def peak_seniority(experiences: Column) -> Column:
    """Highest step of the ladder among experiences, else UNKNOWN."""
    top = F.array_max(F.transform(experiences, lambda e: T.rank(e["seniority"], config.SENIORITY)))
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in config.SENIORITY]), top), F.lit("UNKNOWN"))


def highest_education(education: Column) -> Column:
    top = F.array_max(F.transform(education, lambda e: T.rank(e["degree_level"], config.EDUCATION)))
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in config.EDUCATION]), top), F.lit("UNKNOWN"))


# --- demands of jobs -----------------------------------------------------------
_DIMENSION = {
    "REQUIRED_SKILL": "skills", "PREFERRED_SKILL": "skills", "EXPERIENCE": "experience", "EDUCATION": "education",
    "CERTIFICATION": "certifications", "LANGUAGE": "languages",
}


def parse_language_requirement(text: Column) -> Column:
    """struct<name, level> of a line such as ``English B2``."""
    tokens = F.filter(F.split(F.regexp_replace(text, "-", " "), r"(?U)\s+"), lambda x: x != "")
    levels = F.filter(F.transform(tokens, lambda x: T.lookup(F.lower(x), config.REQUIREMENT_LEVELS)), lambda x: x.isNotNull())
    names = F.array_join(F.filter(tokens, lambda x: ~F.lower(x).isin(*config.REQUIREMENT_LEVELS)), " ")
    return F.struct(F.when(names != "", T.normalize_language_name(names)).alias("name"), F.try_element_at(levels, F.lit(-1)).alias("level"))


def job_demands(profiles: DataFrame, requirements: DataFrame, related: DataFrame) -> DataFrame:
    """All that jobs ask for: job_id, dim_rank, idx, dimension and the demand's own columns.

    ``profiles``: job_id, seniority_normalized, responsibilities. Requirements
    of other types than the eight dimensions read are left out.
    """
    rank = lambda c: F.array_position(F.array(*[F.lit(d) for d in config.DIMENSIONS]), c).cast("int") - 1
    relatives = related.groupBy("canonical_name").agg(F.array_sort(F.collect_list(F.struct("rel_rank", "related_skill", "relation_type"))).alias("relatives"))
    rows = requirements.filter(F.col("requirement_type").isin(*_DIMENSION)).join(relatives, "canonical_name", "left")
    asked = rows.select(
        "job_id", T.lookup(F.col("requirement_type"), _DIMENSION).alias("dimension"), "idx", "requirement_type",
        priority_from_importance(F.col("importance")).alias("priority"), "raw_text", "canonical_name", "minimum_years", "normalized_value", "relatives",
    )
    extra = lambda df, dimension, kind, idx, text, value: df.select(
        "job_id", F.lit(dimension).alias("dimension"), idx.alias("idx"), F.lit(kind).alias("requirement_type"),
        F.lit("PREFERRED" if kind == "SENIORITY" else "OPTIONAL").alias("priority"), text.alias("raw_text"), value.alias("normalized_value"),
    )
    level = profiles.filter("seniority_normalized is not null and seniority_normalized <> 'UNKNOWN'")
    seniority = extra(level, "seniority", "SENIORITY", F.lit(0), F.col("seniority_normalized"), F.col("seniority_normalized"))
    lines = profiles.select("job_id", F.posexplode("responsibilities").alias("i", "line"))
    duties = extra(lines, "responsibilities", "RESPONSIBILITY", F.col("i"), F.col("line"), F.lit(None).cast("string"))
    wanted = requirements.filter(F.col("requirement_type").isin("REQUIRED_SKILL", "PREFERRED_SKILL")).select("job_id", T.skill_domain(F.col("category")).alias("d"))
    domains = wanted.groupBy("job_id").agg(F.array_sort(F.collect_set("d")).alias("job_domains")).filter(F.size("job_domains") > 0)
    field = extra(domains, "domain", "OTHER", F.lit(0), F.lit("Domain alignment"), F.lit(None).cast("string")).join(domains, "job_id")
    out = asked.unionByName(seniority, True).unionByName(duties, True).unionByName(field, True)
    mine = lambda d, c: F.when(F.col("dimension") == d, c)
    out = out.withColumns({
        "dim_rank": rank(F.col("dimension")), "tokens": mine("responsibilities", T.overlap_tokens(F.col("raw_text"))),
        "step": F.coalesce(mine("seniority", T.rank(F.col("normalized_value"), config.SENIORITY)), mine("education", T.rank(F.col("normalized_value"), config.EDUCATION))),
        "needle": F.when(F.col("dimension") == "certifications", _collapsed(F.col("raw_text"))).otherwise(F.lower(T.strip(F.col("raw_text")))),
        "wanted": mine("languages", parse_language_requirement(F.col("raw_text"))),
    })
    return out.withColumn("level", T.rank(F.col("wanted.level"), config.PROFICIENCY))


# --- rules, over a demand row joined with a facts row --------------------------
def _answer(status: Column, signal: Column, explanation: Column, matched: Column | None = None, label: Column | None = None, semantic: Column | None = None, evidence: Column | None = None) -> Column:
    none = F.lit(None)
    value = lambda c, kind: (c if c is not None else none).cast(kind)
    kind = "array<struct<source_type:string,source_label:string,raw_text:string>>"
    columns = (status.cast("string"), signal.cast("string"), value(matched, "string"), value(label, "string"), value(semantic, "double"), explanation, F.coalesce(value(evidence, kind), F.array().cast(kind)))
    return F.struct(*[c.alias(n) for c, n in zip(columns, EVALUATION, strict=True)])


def _findings(reference_year: Column, semantic: bool) -> list[tuple[str, Column]]:
    """What the rules read off a demand and its candidate, each computed once, for its own dimension only."""
    mine = lambda d, c: F.when(F.col("dimension") == d, c)
    skill, names, needle = F.col("canonical_name"), F.col("skill_names"), F.col("needle")
    known = lambda n: F.coalesce(F.array_contains(names, n), F.lit(False))
    same = F.get(F.filter("certifications", lambda c: c["folded"] == needle), F.lit(0))
    part = F.get(F.filter("certifications", lambda c: c["folded"].contains(needle) | needle.contains(c["folded"])), F.lit(0))
    shared = F.filter("domains", lambda d: F.array_contains(F.col("job_domains"), d["domain"]))
    top = F.get(F.array_sort(F.transform(shared, lambda d: F.struct((-d["n"]).alias("n"), d["domain"].alias("domain")))), F.lit(0))["domain"]
    # A direct hit, else the first related skill, else (unresolved lines) the first name that contains the text.
    none = F.lit(None).cast("string")
    named = lambda name, kind: F.struct(name.alias("name"), kind.alias("kind"))
    relative = lambda: T.let(F.get(F.filter("relatives", lambda r: known(r["related_skill"])), F.lit(0)), lambda r: named(r["related_skill"], r["relation_type"]))
    hit = (
        F.when(skill.isNull(), named(F.when(needle != "", F.get(F.filter(names, lambda n: F.lower(n).contains(needle)), F.lit(0))), none))
        .when(known(skill), named(skill, none)).otherwise(relative())
    )
    by_skill = years_of_experience(F.col("experiences"), F.col("normalized_value"), reference_year, read=True)
    found = [
        ("_found", mine("skills", hit)), ("_years", mine("experience", F.when(F.col("experiences").isNull(), 0.0).when(F.col("normalized_value").isNull(), F.col("all_years")).otherwise(by_skill))),
        ("_gap", F.coalesce(mine("seniority", F.col("peak") - F.col("step")), mine("education", F.col("school") - F.col("step")))),
        ("_same", mine("certifications", same)), ("_part", mine("certifications", part)),
        ("_held", mine("languages", F.get(F.filter("languages", lambda x: x["canonical_name"] == F.col("wanted.name")), F.lit(0)))),
        ("_best", mine("responsibilities", best_lexical_match())), ("_top", mine("domain", top)),
    ]
    if semantic:
        near = F.get("_meanings", F.col("_at"))
        label = F.get("experiences", near["place"] - 1)["label"]
        found.append(("_meaning", mine("skills", F.coalesce(near["score"], F.lit(0.0)))))
        found.append(("_near", mine("responsibilities", F.when(near["score"] > 0, F.struct(near["score"].alias("score"), near["place"].alias("place"), label.alias("label"))))))
    return found


def match_skill(semantic: bool = False) -> Column:
    """Exact or alias, then the first related skill, then meaning, then text overlap for unresolved lines."""
    skill, hit, proof = F.col("canonical_name"), F.col("_found.name"), F.col("_proof")
    alias = is_alias_surface_form(F.col("raw_text"), skill) | F.exists(proof, lambda x: is_alias_surface_form(x["raw_text"], skill))
    kind = F.col("_found.kind")
    signal = (
        F.when(skill.isNull(), F.when(hit.isNotNull(), "PARTIAL_MATCH").otherwise("NO_EVIDENCE"))
        .when(hit == skill, F.when(alias, "ALIAS_MATCH").otherwise("EXACT_MATCH")).when(hit.isNotNull(), "RELATED_MATCH")
    )
    score = None
    if semantic:
        signal = signal.when(F.col("_meaning") >= config.SEMANTIC_PARTIAL, "SEMANTIC_MATCH")
        score = F.when(skill.isNotNull() & hit.isNull(), F.col("_meaning"))
    signal = signal.otherwise("NO_EVIDENCE")
    text = (
        F.when(skill.isNull(), F.coalesce(F.concat(F.lit("Not in the taxonomy; its text is part of "), hit, F.lit(".")), F.lit("Not in the taxonomy, and no skill contains its text.")))
        .when(hit == skill, F.concat(skill, F.lit(" is evidenced directly.")))
        .when(hit.isNotNull(), F.concat(skill, F.lit(" is not evidenced; "), hit, F.lit(" is ("), F.lower(F.translate(kind, "_", " ")), F.lit(").")))
        .otherwise(F.concat(F.lit("Neither "), skill, F.lit(" nor a related skill is evidenced.")))
    )
    return _answer(skill_status(signal), signal, text, hit, None, score, proof)


def evaluate_experience() -> Column:
    years, target = F.col("_years"), F.col("minimum_years")
    signal = (
        F.when(years.isNull(), "NO_EVIDENCE").when(target.isNull(), F.when(years > 0, "PARTIAL_MATCH").otherwise("NO_EVIDENCE"))
        .when(years >= target, "EXACT_MATCH").when(years > 0, "PARTIAL_MATCH").otherwise("NO_EVIDENCE")
    )
    status = F.when(years.isNull(), "UNKNOWN").when(signal == "EXACT_MATCH", "MET").when(signal == "PARTIAL_MATCH", "PARTIALLY_MET").otherwise("NOT_MET")
    shown = F.concat(years.cast("int").cast("string"), F.lit(" year(s) shown"), F.coalesce(F.concat(F.lit(", "), target.cast("string"), F.lit(" asked for")), F.lit("")), F.lit("."))
    return _answer(status, signal, F.coalesce(shown, F.lit("The years of the experiences cannot be read.")))


def evaluate_seniority() -> Column:
    gap = F.col("_gap")
    status = F.when(gap.isNull(), "UNKNOWN").when(gap >= 0, "MET").when(gap == -1, "PARTIALLY_MET").otherwise("NOT_MET")
    signal = F.when(gap >= 0, "EXACT_MATCH").when(gap == -1, "PARTIAL_MATCH").otherwise("NO_EVIDENCE")
    return _answer(status, signal, F.when(gap.isNull(), "Seniority cannot be compared.").when(gap >= 0, "Seniority as asked for, or above.").otherwise("Seniority below what is asked for."))


def evaluate_education() -> Column:
    gap = F.col("_gap")
    status = F.when(gap.isNull(), "UNKNOWN").when(gap >= 0, "MET").otherwise("PARTIALLY_MET")
    signal = F.when(gap.isNull(), "NO_EVIDENCE").when(gap >= 0, "EXACT_MATCH").otherwise("PARTIAL_MATCH")
    return _answer(status, signal, F.when(gap.isNull(), "Education cannot be compared.").when(gap >= 0, "Education as asked for, or above.").otherwise("Education below what is asked for."))


def _collapsed(c: Column) -> Column:
    return F.regexp_replace(F.lower(T.strip(c)), r"(?U)\s+", " ")


def evaluate_certification() -> Column:
    """First certification of the same name, else the first that contains the text or is contained."""
    found = F.coalesce("_same", "_part")
    signal = F.when(F.col("_same").isNotNull(), "EXACT_MATCH").when(F.col("_part").isNotNull(), "PARTIAL_MATCH").otherwise("NO_EVIDENCE")
    text = F.coalesce(F.concat(F.lit("Listed: "), found["name"], F.lit(".")), F.lit("No such certification; related skills do not count."))
    return _answer(skill_status(signal), signal, text, found["name"])


def evaluate_language() -> Column:
    held = F.col("_held")
    gap = held["level"] - F.col("level")
    signal = F.when(held.isNull(), "NO_EVIDENCE").when(gap >= 0, "EXACT_MATCH").otherwise("PARTIAL_MATCH")
    return _answer(skill_status(signal), signal, F.when(held.isNull(), "Language not listed.").when(gap.isNull(), "Listed without a known level.").when(gap >= 0, "Listed at the level or above.").otherwise("Listed below the level."))


def best_lexical_match() -> Column:
    """struct<overlap, place, label> of the experience whose words overlap most; the first on ties."""
    scored = F.transform("experiences", lambda e: F.struct(T.jaccard(F.col("tokens"), e["tokens"]).alias("overlap"), (-e["idx"]).alias("place"), e["label"].alias("label")))
    return F.array_max(F.filter(scored, lambda s: s["overlap"] > 0))


def evaluate_responsibility(semantic: bool = False) -> Column:
    best, words = F.col("_best"), F.col("_best.overlap") >= config.LEXICAL_OVERLAP
    near = F.col("_near") if semantic else F.lit(None).cast("struct<score:double,place:int,label:string>")
    close = near["score"] >= config.SEMANTIC_PARTIAL
    pick = lambda overlap, meaning, none: F.when(words, overlap).when(close, meaning).otherwise(none)
    label = pick(best["label"], near["label"], F.lit(None).cast("string"))
    text = pick(F.concat(F.lit("Words overlap with "), best["label"], F.lit(".")), F.concat(F.lit("Close in meaning to "), near["label"], F.lit(".")), F.lit("No comparable experience found."))
    score = pick(F.lit(None).cast("double"), near["score"], F.lit(None).cast("double"))
    return _answer(pick("PARTIALLY_MET", "PARTIALLY_MET", "NOT_MET"), pick("PARTIAL_MATCH", "SEMANTIC_MATCH", "NO_EVIDENCE"), text, None, label, score)


def evaluate_domain() -> Column:
    """Met if a domain of the job is among the candidate's; named by the most frequent (ties by name)."""
    top = F.col("_top")
    signal = F.when(top.isNotNull(), "EXACT_MATCH").otherwise("NO_EVIDENCE")
    text = F.coalesce(F.concat(F.lit("Skills fit the domain "), top, F.lit(".")), F.lit("Skills are of other domains."))
    return _answer(F.when(top.isNotNull(), "MET").otherwise("NOT_MET"), signal, text)


def demand_lists(demands: DataFrame, dimensions: tuple[str, ...] = config.DIMENSIONS) -> DataFrame:
    """job_id, demands: what each job asks for in ``dimensions``, in order, each with its place among all. A job's demands are one row, as large as its offer."""
    row = F.struct("dim_rank", "idx", F.struct(*_own(demands)).alias("d"))
    lists = demands.groupBy("job_id").agg(F.array_sort(F.collect_list(row))["d"].alias("demands"))
    placed = F.transform("demands", lambda d, i: d.withField("eval_idx", i))
    if set(dimensions) != set(config.DIMENSIONS):
        placed = F.filter(placed, lambda d: d["dimension"].isin(*dimensions))
    return lists.select("job_id", placed.alias("demands"))


#: Different demands, and characters of all of them, that every task holds at most; beyond that each pair carries its own.
KINDS, KIND_LENGTH = 50_000, 16 << 20


def demand_kinds(demands: DataFrame) -> DataFrame | None:
    """kind, d: the different demands, numbered in order and stored; None where they are too many to be sent to every task."""
    d = F.struct(*_own(demands)).alias("d")
    if demands.agg(F.approx_count_distinct(F.xxhash64(d))).first()[0] > KINDS:
        return None
    path = scratch_dir(demands.sparkSession)
    demands.select(d).distinct().write.parquet(path)
    kinds = demands.sparkSession.read.schema(demands.select(d).schema).parquet(path)
    size = kinds.agg(F.count("*").alias("n"), F.sum(F.length(F.to_json("d"))).alias("length")).first()
    if size["n"] > KINDS or (size["length"] or 0) > KIND_LENGTH:
        return None
    return kinds.select(F.row_number().over(Window.orderBy("d")).alias("kind"), "d")


def _own(demands: DataFrame) -> list[str]:
    return [c for c in demands.columns if c not in ("job_id", "dim_rank", "idx")]


def kind_lists(demands: DataFrame, kinds: DataFrame, dimensions: tuple[str, ...] = config.DIMENSIONS) -> DataFrame:
    """job_id, kinds: ``demand_lists`` with the demands' numbers in ``kinds``; null for those of other dimensions."""
    known = demands.join(F.broadcast(kinds), F.struct(*_own(demands)) == F.col("d"))
    chosen = F.when(F.col("dimension").isin(*dimensions), F.col("kind"))
    row = F.struct("dim_rank", "idx", "kind", chosen.alias("chosen"))
    return known.groupBy("job_id").agg(F.array_sort(F.collect_list(row))["chosen"].alias("kinds"))


def with_years(facts: DataFrame, reference_year: int) -> DataFrame:
    """``facts`` with all_years, which most demands for experience read: once a candidate."""
    none = F.lit(None).cast("string")
    return facts.withColumn("all_years", years_of_experience(F.col("experiences"), none, F.lit(reference_year), read=True))


def store_facts(facts: DataFrame, name: str, buckets: int) -> DataFrame:
    """Facts as a table cut by candidate_id, which joins on candidate_id read without a shuffle.

    ``buckets``: so many that one holds some hundred MB.
    """
    facts.write.mode("overwrite").bucketBy(buckets, "candidate_id").sortBy("candidate_id").saveAsTable(name)
    return facts.sparkSession.table(name)


def evaluate_pairs(
    pairs: DataFrame, demands: DataFrame, facts: DataFrame, reference_year: int, vectors: DataFrame | None = None, dimensions: tuple[str, ...] = config.DIMENSIONS
) -> DataFrame:
    """candidate_id, job_id, eval_idx, dimension, requirement_type, priority, raw_text, status, match_signal,
    match_strength, score, confidence, matched_skill, source_label, evidence, explanation.

    ``vectors``: text, embedding of the texts that ``semantic.texts`` names; without it, meaning is not compared.
    """
    if vectors is not None:
        demands, facts = with_units(demands, facts, vectors)
    kinds = demand_kinds(demands) if vectors is None else None
    lists = demand_lists(demands, dimensions) if kinds is None else kind_lists(demands, kinds, dimensions)
    met = pairs.join(lists, "job_id").join(with_years(facts, reference_year), "candidate_id", "left")
    return _judged(met, ("candidate_id", "job_id"), reference_year, dimensions, vectors is not None, kinds)


def evaluate_grid(
    demands: DataFrame, facts: DataFrame, reference_year: int, vectors: DataFrame | None = None, candidate_blocks: int = 64, job_blocks: int = 64
) -> DataFrame:
    """``evaluate_pairs`` of every candidate with every job, with the tile that each pair stands in.

    The grid is cut into tiles, a block of candidates by a block of jobs. Facts travel once a
    job block, demands once a candidate block; pairs appear only as a tile is evaluated, and are
    never stored. Scores by (tile, candidate_id, job_id) need no further shuffle.
    """
    if vectors is not None:
        demands, facts = with_units(demands, facts, vectors)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = demand_lists(demands).withColumns({"_c": every(candidate_blocks), "_j": part("job_id", job_blocks)})
    own = with_years(facts, reference_year).withColumns({"_c": part("candidate_id", candidate_blocks), "_j": every(job_blocks)})
    tile = lambda df: df.withColumn("tile", F.col("_c") * job_blocks + F.col("_j")).drop("_c", "_j")
    met = tile(asked).join(tile(own), "tile")
    return _judged(met, ("tile", "candidate_id", "job_id"), reference_year, config.DIMENSIONS, vectors is not None)


#: What a change of each kind of fact can alter: the dimensions whose rules read it.
READ_BY = {"skill": "skills", "experience": "responsibilities"}


def reevaluate_pairs(before: DataFrame, pairs: DataFrame, demands: DataFrame, facts: DataFrame, changes: DataFrame, reference_year: int) -> tuple[DataFrame, DataFrame]:
    """(evaluations after, those of them that were judged anew): only demands that read a changed fact are.

    ``before``: the evaluations of ``pairs``; ``facts``: those after ``changes`` (document_id, fact_id, accepted).
    """
    kind = T.lookup(F.split("fact_id", ":")[0], READ_BY)
    touched = changes.filter("accepted").select(F.col("document_id").alias("candidate_id"), kind.alias("dimension")).filter("dimension is not null").distinct()
    again = pairs.join(touched.select("candidate_id").distinct(), "candidate_id", "left_semi")
    anew = evaluate_pairs(again, demands, facts, reference_year, None, tuple(READ_BY.values())).join(touched, ["candidate_id", "dimension"], "left_semi").select(*before.columns)
    return before.join(touched, ["candidate_id", "dimension"], "left_anti").select(*before.columns).unionByName(anew), anew


def _judged(met: DataFrame, keys: tuple[str, ...], reference_year: int, dimensions: tuple[str, ...], semantic: bool, kinds: DataFrame | None = None) -> DataFrame:
    """Every demand of rows that hold a job's demands (their numbers, if ``kinds`` has them) and a candidate's facts."""
    rules = {
        "skills": match_skill(semantic), "experience": evaluate_experience(), "seniority": evaluate_seniority(), "education": evaluate_education(),
        "certifications": evaluate_certification(), "languages": evaluate_language(), "responsibilities": evaluate_responsibility(semantic), "domain": evaluate_domain(),
    }

    def verdict(field: str) -> Column:
        """A field of its own, so that what nobody reads is not made."""
        out = F.lit(None)
        for name in dimensions:
            out = F.when(F.col("dimension") == name, rules[name][field]).otherwise(out)
        return out.alias(field)

    if semantic:
        of = lambda what: F.transform("demands", what)
        found = best_meanings(of(lambda d: d["unit"]), of(lambda d: d["dimension"] == "skills"), F.col("units"))
        met = met.withColumn("_meanings", found).withColumn("demands", of(lambda d: d.dropFields("unit"))).drop("units")
    own = [c for c in met.columns if c not in (*keys, "demands", "kinds")]
    if kinds is None:
        found = met.select(*keys, *own, F.posexplode("demands").alias("_at", "d")).select("*", "d.*").drop("d")
    else:
        asked = met.select(*keys, *own, F.posexplode("kinds").alias("eval_idx", "kind")).filter("kind is not null")
        found = asked.join(F.broadcast(kinds), "kind").select(*keys, *own, "eval_idx", "d.*")
    found = found.select("*", *[c.alias(name) for name, c in _findings(F.lit(reference_year), semantic)])
    found = found.withColumn("_proof", F.when(F.col("dimension") == "skills", F.try_element_at("skill_map", F.col("_found.name"))))
    judged = found.select(*keys, "eval_idx", "dimension", "requirement_type", "priority", "raw_text", *map(verdict, EVALUATION))
    strength = signal_strength(F.col("match_signal"), F.col("semantic_score"))
    return judged.select(
        *keys, "eval_idx", "dimension", "requirement_type", "priority", "raw_text", "status", "match_signal",
        strength.alias("match_strength"), strength_score(strength).alias("score"), signal_confidence(F.col("match_signal"), F.col("semantic_score")).alias("confidence"),
        "matched_skill", "source_label", "evidence", "explanation",
    )
