"""Skill taxonomy: alias keys, mention scan, relations, domains, checks.

Tables: skills(canonical_name, category, parent_skill, ecosystem, taxonomy_idx),
skill_aliases(alias, canonical_name), skill_relations(from_skill, to_skill,
relation_type, rel_idx). A taxonomy is a dimension of bounded size; where it is
inlined into an expression its size is checked first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Surface forms that one alternation takes at most; ``mention_table`` takes any number.
MAX_FORMS = 5_000
#: Surface forms, and characters of all of them, that one automaton takes at most (some hundred bytes a character in a worker).
AUTOMATON_FORMS, AUTOMATON_LENGTH = 500_000, 4_000_000
#: The same for a table of forms that are looked up as whole runs of letters and digits (some tens of bytes a form in a worker).
RUN_FORMS, RUN_LENGTH = 4_000_000, 48_000_000
#: The one letter outside ASCII that is an ASCII letter in lower case.
KELVIN = "\u212A"


def build_alias_index(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """skill_key -> canonical_name, category; on conflicts the earlier skill wins."""
    names = skills.select("canonical_name", "category", "taxonomy_idx", F.col("canonical_name").alias("name"), F.lit(0).alias("kind"))
    others = aliases.join(skills.select("canonical_name", "category", "taxonomy_idx"), "canonical_name")
    both = names.unionByName(others.select("canonical_name", "category", "taxonomy_idx", F.col("alias").alias("name"), F.lit(1).alias("kind")))
    keyed = both.withColumn("skill_key", T.skill_key(F.col("name"))).filter("skill_key <> ''")
    order = Window.partitionBy("skill_key").orderBy("taxonomy_idx", "kind", "name")
    return keyed.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("skill_key", "canonical_name", "category")


def normalize_skill_name(df: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """Add canonical_name and category of a raw skill text; null where unknown."""
    known = index.withColumnRenamed("skill_key", "_key")
    return df.withColumn("_key", T.skill_key(F.col(column))).join(known, "_key", "left").drop("_key")


def surface_forms(skills: DataFrame, aliases: DataFrame) -> list[tuple[str, str]]:
    """(form, canonical_name), longest form first, each form once."""
    forms = skills.select(F.col("canonical_name").alias("form"), "canonical_name", "taxonomy_idx").unionByName(
        aliases.join(skills.select("canonical_name", "taxonomy_idx"), "canonical_name").select(F.col("alias").alias("form"), "canonical_name", "taxonomy_idx")
    )
    rows = forms.orderBy(F.length("form").desc(), "taxonomy_idx", "form").limit(MAX_FORMS + 1).collect()
    if len(rows) > MAX_FORMS:
        raise ValueError(f"more than {MAX_FORMS} surface forms: use mention_table instead")
    seen: dict[str, tuple[str, str]] = {}
    for r in rows:
        seen.setdefault(r["form"].lower(), (r["form"], r["canonical_name"]))
    return list(seen.values())


def scan_mentions(text: Column, forms: list[tuple[str, str]]) -> Column:
    """Distinct canonical names that a text mentions, in the order first seen.

    Longest form first, not overlapping, and never inside a longer run of ASCII
    letters or digits (so ``C++`` and ``.NET`` work). Null and blank give none.
    """
    if not forms:
        return F.array().cast("array<string>")
    quoted = "|".join("\\Q" + form.replace("\\E", "") + "\\E" for form, _ in forms)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iu)(?<![A-Za-z0-9])(?:{quoted})(?![A-Za-z0-9])"), F.lit(0))
    names = F.create_map(*[F.lit(x) for form, name in forms for x in (form.lower(), name)])
    return F.array_distinct(F.filter(F.transform(found, lambda m: F.try_element_at(names, F.lower(m))), lambda m: m.isNotNull()))


def form_table(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """form (lower case), canonical_name: every surface form once, of the earlier skill on conflicts."""
    own = skills.select(F.lower("canonical_name").alias("form"), "canonical_name", "taxonomy_idx")
    others = aliases.join(skills.select("canonical_name", "taxonomy_idx"), "canonical_name").select(F.lower("alias").alias("form"), "canonical_name", "taxonomy_idx")
    order = Window.partitionBy("form").orderBy("taxonomy_idx", "canonical_name")
    return own.unionByName(others).filter("form <> ''").withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("form", "canonical_name")


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def form_automaton(forms: list[tuple[str, str]]) -> ahocorasick.Automaton:
    """An automaton of (form, canonical_name) that finds every form in one walk over a text."""
    made = ahocorasick.Automaton()
    for form, name in forms:
        made.add_word(folded(form), (len(form), name))
    made.make_automaton()
    return made


_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def mentions_of(text: str | None, automaton: ahocorasick.Automaton) -> list[str]:
    """Distinct canonical names in the order first seen: the leftmost, then longest form at free ends, and none that overlaps it."""
    if not text or not len(automaton):
        return []
    found = []
    for end, (length, name) in automaton.iter(folded(text)):
        start = end - length + 1
        if (not start or text[start - 1] not in _LETTERS) and (end + 1 == len(text) or text[end + 1] not in _LETTERS):
            found.append((start, -length, name))
    out, until = {}, 0
    for start, negative, name in sorted(found):
        if start >= until:
            out[name] = None
            until = start - negative
    return list(out)


def mention_table(docs: DataFrame, text: str, forms: DataFrame, key: str = "document_id") -> DataFrame:
    """``key`` and mentions array<string>, as ``scan_mentions`` finds them, for a taxonomy of any size.

    ``forms``: form (lower case), canonical_name. They become one automaton, which is built once, sent
    to each executor and run over Arrow batches; forms beyond its bounds are met by a join.
    Forms of ASCII letters and digits alone are looked up as whole runs instead.
    """
    mixed = F.count_if(~F.col("form").rlike(r"^[a-z0-9]+\z"))
    size = forms.agg(F.count("*").alias("n"), F.sum(F.length("form")).alias("length"), F.min(F.length("form")).alias("least"), mixed.alias("mixed")).first()
    if size["n"] and not size["mixed"]:
        return run_mentions(docs, text, forms, size["least"], size["n"] <= RUN_FORMS and size["length"] <= RUN_LENGTH, key)
    if size["n"] > AUTOMATON_FORMS or (size["length"] or 0) > AUTOMATON_LENGTH:
        return joined_mentions(docs, text, forms, key)
    automaton = form_automaton([(r["form"], r["canonical_name"]) for r in forms.collect()])  # bounded above
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(automaton))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(shared.value)
        for batch in batches:
            found = pa.array([mentions_of(t.as_py(), automaton) for t in batch.column(1)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "mentions"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(scanned, f"`{key}` {kind}, mentions array<string>")


def run_mentions(docs: DataFrame, text: str, forms: DataFrame, least: int, held: bool, key: str = "document_id") -> DataFrame:
    """``mention_table`` for forms of ASCII letters and digits, ``least`` long at least: such a form is mentioned where it is a whole run, so nothing overlaps.

    ``held``: every task holds all forms and looks runs up in Arrow batches; else they meet by a join, for unique keys.
    Texts with the one letter that only its lower case makes an ASCII one are left to ``joined_mentions``.
    """
    odd = F.coalesce(F.contains(F.col(text), F.lit(KELVIN)), F.lit(False))
    rest = joined_mentions(docs.filter(odd), text, forms, key)
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[A-Za-z0-9]{{{least},}}"), F.lit(0))
    runs = docs.filter(~odd).select(F.col(key), F.array_distinct(found).alias("runs"))
    if not held:
        words = T.numbered(runs, "runs", "_at", "form", key).withColumn("form", F.lower("form"))
        hits = words.join(forms, "form").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "canonical_name")))["canonical_name"].alias("mentions"))
        told = runs.select(key).join(hits, key, "left").select(key, F.coalesce("mentions", F.array().cast("array<string>")).alias("mentions"))
    else:
        table = forms.select("form", "canonical_name").toArrow()  # bounded by RUN_FORMS and RUN_LENGTH
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
            known, names = table.column(0).combine_chunks(), table.column(1).combine_chunks()
            for group in grouped(batches):
                batch = pa.Table.from_batches(group).combine_chunks()
                lists = batch.column(1).combine_chunks()
                place = pc.index_in(pc.ascii_lower(lists.flatten()), value_set=known)
                hit = pc.is_valid(place)
                ends = np.concatenate(([0], np.cumsum(hit.to_numpy(zero_copy_only=False))))  # of the runs that are kept, up to each run
                offsets = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
                kept = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(place.filter(hit)))
                yield from pa.Table.from_arrays([batch.column(0), kept], [key, "mentions"]).to_batches()

        kind = docs.schema[key].dataType.simpleString()
        told = runs.mapInArrow(looked_up, f"`{key}` {kind}, mentions array<string>")
    return told.select(F.col(key), F.array_distinct("mentions").alias("mentions")).unionByName(rest)


def grouped(batches: Iterator[pa.RecordBatch], least: int = 32 << 20) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of ``least`` bytes, as the table of forms is made ready once a group."""
    group: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            group.append(batch)
        if sum(b.nbytes for b in group) >= least:
            yield group
            group = []
    if group:
        yield group


def joined_mentions(docs: DataFrame, text: str, forms: DataFrame, key: str = "document_id") -> DataFrame:
    """``mention_table`` by a join, for unique keys.

    Every place of a text where a mention can start or end gives pieces as long
    as some form is; those meet the forms by a join. Of what is found the
    leftmost, then longest stays, and nothing that overlaps it.
    """
    lengths = sorted(r[0] for r in forms.select(F.length("form")).distinct().collect())  # as many as the longest form has characters
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.array(*[F.lit(n) for n in lengths]).cast("array<int>").alias("_n"))
    inner = lambda i: F.substring("_t", i, F.lit(1)).rlike("[A-Za-z0-9]")
    starts = F.filter(F.sequence(F.lit(1), F.length("_t")), lambda i: (i == 1) | ~inner(i - 1))
    at = T.numbered(rows.filter("_t <> ''"), starts, "_i", "_at", key, "_t", "_n")
    fits = F.filter("_n", lambda n: (F.col("_at") + n - 1 == F.length("_t")) | ((F.col("_at") + n - 1 < F.length("_t")) & ~inner(F.col("_at") + n)))
    pieces = T.numbered(at, fits, "_j", "_len", key, "_at", "_t").select(key, "_at", "_len", F.lower(F.substring("_t", F.col("_at"), F.col("_len"))).alias("form"))
    hits = pieces.join(forms, "form").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", (-F.col("_len")).alias("_neg"), "canonical_name"))).alias("_h"))
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("names"))
    taken = F.aggregate(
        "_h", first,
        lambda s, h: F.when(h["_at"] <= s["end"], s).otherwise(F.struct((h["_at"] - h["_neg"] - 1).cast("int").alias("end"), F.array_append(s["names"], h["canonical_name"]).alias("names"))),
        lambda s: F.array_distinct(s["names"]),
    )
    found = hits.select(F.col(key), taken.alias("mentions"))
    return docs.select(key).join(found, key, "left").select(key, F.coalesce("mentions", F.array().cast("array<string>")).alias("mentions"))


def related_skills(skills: DataFrame, relations: DataFrame) -> DataFrame:
    """canonical_name, related_skill, relation_type, rel_rank: parent, children, ecosystem, explicit."""
    a = skills.select("canonical_name", "parent_skill", "ecosystem")
    b = skills.select(F.col("canonical_name").alias("related_skill"), F.col("parent_skill").alias("_p"), F.col("ecosystem").alias("_e"), F.col("taxonomy_idx").alias("_i"))
    row = lambda df, kind, name: df.select("canonical_name", "related_skill", F.lit(name).alias("relation_type"), F.lit(kind).alias("_k"), "_i")
    parents = row(a.join(b, a["parent_skill"] == b["related_skill"]), 0, "CHILD_OF")
    children = row(a.join(b, a["canonical_name"] == b["_p"]), 1, "PARENT_OF")
    siblings = row(a.join(b, (a["ecosystem"] == b["_e"]) & (a["canonical_name"] != b["related_skill"])).filter("ecosystem <> ''"), 2, "PART_OF_ECOSYSTEM")
    stored = relations.join(b.select("related_skill"), relations["to_skill"] == F.col("related_skill")).select(
        F.col("from_skill").alias("canonical_name"), "related_skill", "relation_type", F.lit(3).alias("_k"), F.col("rel_idx").alias("_i")
    )
    every = parents.unionByName(children).unionByName(siblings).unionByName(stored)
    rank = F.row_number().over(Window.partitionBy("canonical_name").orderBy("_k", "_i", "related_skill", "relation_type"))
    return every.select("canonical_name", "related_skill", "relation_type", rank.alias("rel_rank"))


def skill_view(skills: DataFrame, relations: DataFrame) -> DataFrame:
    """A row a skill: category, domain, parent, children, siblings, explicit relations by type."""
    related = related_skills(skills, relations)
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("relation_type") == kind, F.struct("rel_rank", "related_skill"))))["related_skill"]
    known = ("CHILD_OF", "PARENT_OF", "PART_OF_ECOSYSTEM")
    explicit = F.array_sort(F.collect_list(F.when(~F.col("relation_type").isin(*known), F.struct("relation_type", "rel_rank", "related_skill"))))
    lists = related.groupBy("canonical_name").agg(of("PARENT_OF").alias("children"), of("PART_OF_ECOSYSTEM").alias("siblings"), explicit.alias("explicit"))
    out = skills.join(lists, "canonical_name", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "canonical_name", "category", T.skill_domain(F.col("category")).alias("domain"), F.col("parent_skill").alias("parent"),
        F.coalesce("children", empty).alias("children"), F.coalesce("siblings", empty).alias("siblings"),
        F.coalesce("explicit", F.array().cast("array<struct<relation_type:string,rel_rank:int,related_skill:string>>")).alias("explicit"),
    )


def skill_domain_counts(skills: DataFrame) -> DataFrame:
    return skills.groupBy(T.skill_domain(F.col("category")).alias("domain")).agg(F.count("*").alias("n_skills"))


def check_taxonomy(skills: DataFrame, aliases: DataFrame, relations: DataFrame) -> DataFrame:
    """problem, name: what breaks the taxonomy's rules (no row: sound)."""
    names = skills.select(F.col("canonical_name").alias("_n")).distinct()
    report = lambda df, problem, name: df.select(F.lit(problem).alias("problem"), F.col(name).alias("name"))
    absent = lambda df, c: df.filter(F.col(c).isNotNull()).join(names, F.col(c) == F.col("_n"), "left_anti")
    shared = aliases.withColumn("_a", F.lower("alias")).groupBy("_a").agg(F.countDistinct("canonical_name").alias("n")).filter("n > 1")
    parts = [
        report(skills.groupBy("canonical_name").count().filter("count > 1"), "duplicate skill", "canonical_name"),
        report(absent(skills, "parent_skill"), "unknown parent", "parent_skill"),
        report(absent(aliases, "canonical_name"), "alias of unknown skill", "alias"),
        report(shared, "shared alias", "_a"),
        report(absent(relations, "to_skill"), "unknown relation target", "to_skill"),
        report(absent(relations, "from_skill"), "unknown relation source", "from_skill"),
        report(relations.filter("from_skill = to_skill"), "relation to itself", "from_skill"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def skills_by_category(mentions: DataFrame) -> DataFrame:
    """document_id, category, category_idx, names: a CV's skills by category, in the order first seen."""
    category = F.coalesce(F.col("category"), F.lit("Uncategorized"))
    name = F.coalesce(F.col("canonical_name"), F.col("raw_text"))
    grouped = mentions.groupBy("document_id", category.alias("category")).agg(
        F.min("idx").alias("_first"), F.array_sort(F.collect_list(F.struct("idx", name.alias("name"))))["name"].alias("names")
    )
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("_first", "category")) - 1
    return grouped.select("document_id", "category", place.alias("category_idx"), "names")
