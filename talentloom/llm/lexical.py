"""Ranked lexical search in a length-stratified index.

A document's score depends on its length through its normaliser m alone, so documents
of equal m are a stratum. A stratum is cut into blocks of bounded size; a block
holds its documents' ids and, a term, the postings by term frequency. Within a
stratum a term frequency has one impact, which is computed once, and the greatest
frequencies give a bound of what a block can add to an item.

An item visits the blocks with its greatest bounds first; what its k-th best
document reaches there is a score that every later block must be able to reach. The
other blocks are visited in the order of their bounds within a task, and a visit is
left out once the bound falls below that score or below the k-th best found in the
task. Equal bounds are visited, so ties go by id.

The index holds the terms of the stated items; of other terms documents keep their
number alone. Items are taken in blocks of ``ITEMS``, so that what each task holds of
them is bounded; every block reads the index anew.

Edge cases: null texts have no term; documents without a term count in no statistic
and are never ranked; items without a term, or whose terms no document has, give no
row; of items or documents with equal ids each is one of its own; documents with a
null id come last among equal scores, under a null id; items with a null id are
ranked; empty tables give empty results. Scores are 64-bit whole numbers; the
statistics allow 10^17 for 25 times terms times documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, stored

TOP = 20
#: Documents of a block at most; blocks that an item visits first; items that are ranked at a time.
BLOCK, FIRST, ITEMS = 8192, 6, 2000
_LAST = (1 << 63) - 1  # stands for a null id, behind all others

#: Bytes that part terms become blanks, A-Z become lower-case letters.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of all other non-ASCII characters, only A-Z lower-cased."""
    return (text or "").encode().translate(_PLAIN).split()


def weight(documents: int, having: int) -> int:
    """Weight of a term that ``having`` of all documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def impacts(frequency: np.ndarray, m: int) -> np.ndarray:
    """What a term frequency adds in a stratum, for a weight of one."""
    return (1_000_000_000 * frequency) // (1000 * frequency + 12 * m)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """item (a number), id, term, times; stored."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("id"), F.col(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = Counter(terms(batch.column(2)[k].as_py()))
                same = pa.array([k] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array([t.decode() for t in found], pa.string()), pa.array(found.values(), pa.int64())], names=["item", "id", "term", "times"])

    kind = dict(rows.dtypes)["id"]
    return stored(rows.mapInArrow(split, f"item long, id {kind}, term string, times long"), "item-terms")


def document_facts(docs: DataFrame, known: dict[bytes, int], key: str, text: str) -> DataFrame:
    """doc, n and the known terms (numbers) of every document with a term, and how often it has them; stored."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            lengths, found = [], []
            for t in batch.column(1):
                each = terms(t.as_py())
                lengths.append(len(each))
                found.append(Counter([numbers[x] for x in each if x in numbers]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                names=["doc", "n", "terms", "times"],
            )

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(counted, "doc long, n long, terms array<int>, times array<long>").filter("n > 0"), "document-facts")


def index(facts: DataFrame, documents: int, length: int, block: int = BLOCK) -> DataFrame:
    """Blocks of strata: block, m, docs, and postings (term, frequency, place in docs) by term and falling frequency; stored."""
    m = F.expr(f"75 + (25 * n * {documents}L) div {length}L")
    placed = facts.filter(F.size("terms") > 0).select(F.monotonically_increasing_id().alias("row"), m.alias("m"), "doc", "terms", "times")
    parts = placed.groupBy("m").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = placed.join(parts, "m").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def filled(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) for x in frame["terms"]]
        term, times = np.concatenate(list(frame["terms"])).astype(np.int32), np.concatenate(list(frame["times"])).astype(np.int64)
        place = np.repeat(np.arange(len(frame), dtype=np.int32), sizes)
        order = np.lexsort((-times, term))
        return pd.DataFrame({"m": frame["m"].iloc[:1].to_numpy(), "docs": [frame["doc"].to_numpy(np.int64)], "terms": [term[order]], "times": [times[order]], "places": [place[order]]})

    # By both, as a stratum may hold most documents: the join's partitioning by m alone would do for Spark.
    made = dealt.repartition("m", "part").groupBy("m", "part").applyInPandas(filled, "m long, docs array<long>, terms array<int>, times array<long>, places array<int>")
    return stored(made.select(F.monotonically_increasing_id().alias("block"), "*"), "lexical-index")


class Items:
    """A block of items: their terms with weights times repeats."""

    def __init__(self, numbers: list[int], wanted: list[list[tuple[int, int]]]):
        self.numbers, self.wanted = numbers, wanted

    def bounds(self, heads: dict[int, int]) -> np.ndarray:
        """What each item can reach at most, from the greatest impact of each term."""
        return np.array([sum(w * heads.get(t, 0) for t, w in x) for x in self.wanted], np.int64)


class Block:
    """A stratum's block: impacts once a term frequency, postings by term."""

    def __init__(self, m: int, docs: np.ndarray, term: np.ndarray, times: np.ndarray, places: np.ndarray):
        levels, level = np.unique(times, return_inverse=True)
        self.docs, self.places, self.impact = docs, places, impacts(levels, m)[level]
        self.terms, starts = np.unique(term, return_index=True)
        self.spans = dict(zip(self.terms.tolist(), zip(starts.tolist(), [*starts.tolist()[1:], len(term)], strict=True), strict=True))
        self.heads = dict(zip(self.terms.tolist(), self.impact[starts].tolist(), strict=True))

    def best(self, wanted: list[tuple[int, int]], top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``top`` best documents of an item that reach ``least``."""
        score = np.zeros(len(self.docs), np.int64)
        for t, w in wanted:
            if span := self.spans.get(t):
                score[self.places[slice(*span)]] += w * self.impact[slice(*span)]
        some = np.flatnonzero(score >= max(1, least))
        order = np.lexsort((self.docs[some], -score[some]))[:top]
        return self.docs[some[order]], score[some[order]]


def _blocks(frame: pd.DataFrame) -> list[Block]:
    return [Block(*row) for row in zip(frame["m"], frame["docs"], frame["terms"], frame["times"], frame["places"], strict=True)]


def _first_visits(blocks: DataFrame, items: Items, first: int) -> DataFrame:
    """block, items: the ``first`` blocks with the greatest bounds of every item."""

    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["block"].to_numpy(np.int64)
            bounds = np.array([items.bounds(b.heads) for b in _blocks(frame)]).reshape(len(ids), -1)
            if not len(ids):
                continue
            rows = np.argsort(-bounds, axis=0, kind="stable")[:first]
            who = np.broadcast_to(np.arange(bounds.shape[1]), rows.shape)
            out = pd.DataFrame({"item": who.ravel(), "block": ids[rows].ravel(), "bound": np.take_along_axis(bounds, rows, 0).ravel()})
            yield out[out["bound"] > 0]

    found = blocks.mapInPandas(bounded, "item int, block long, bound long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))
    return found.withColumn("place", place).filter(F.col("place") <= first).groupBy("block").agg(F.collect_list("item").alias("items"))


_FOUND = "item int, doc long, score long, block long"


def _rank_items(blocks: DataFrame, items: Items, top: int, first: int) -> DataFrame:
    """item, doc, score, with at least the ``top`` best of every item; stored."""

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, block, asked in zip(frame["block"], _blocks(frame), frame["items"], strict=True):
                for k in asked:
                    docs, score = block.best(items.wanted[k], top, 0)
                    yield pd.DataFrame({"item": np.int32(k), "doc": docs, "score": score, "block": number})

    chosen = stored(_first_visits(blocks, items, first), "first-visits")
    begun = stored(blocks.join(few(chosen), "block").mapInPandas(start, _FOUND), "first-ranks")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    kth = begun.withColumn("place", place).filter(F.col("place") == top).select("item", "score")
    reached = np.zeros(len(items.wanted), np.int64)
    for r in kth.collect():  # one row an item of the block
        reached[r["item"]] = r["score"]
    visited: dict[int, set[int]] = {}
    for r in chosen.collect():  # ``first`` numbers an item at most
        for k in r["items"]:
            visited.setdefault(r["block"], set()).add(k)

    def proceed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = reached.copy()
        kept: dict[int, list[int]] = {}
        for frame in frames:
            made, numbers = _blocks(frame), frame["block"].to_numpy(np.int64)
            bounds = np.array([items.bounds(b.heads) for b in made]).reshape(len(made), -1)
            rows, who = np.nonzero((bounds > 0) & (bounds >= least[None, :]))
            order = np.argsort(-bounds[rows, who], kind="stable")
            for b, k in zip(rows[order].tolist(), who[order].tolist(), strict=True):
                if bounds[b, k] < least[k] or k in visited.get(int(numbers[b]), ()):
                    continue
                docs, score = made[b].best(items.wanted[k], top, int(least[k]))
                if not len(docs):
                    continue
                scores = sorted(kept.get(k, []) + score.tolist(), reverse=True)[:top]
                kept[k] = scores
                if len(scores) == top:
                    least[k] = max(least[k], scores[-1])
                yield pd.DataFrame({"item": np.int32(k), "doc": docs, "score": score, "block": numbers[b]})

    return stored(begun.unionByName(blocks.mapInPandas(proceed, _FOUND)), "ranks")


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP, block: int = BLOCK, first: int = FIRST, at_once: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item."""
    wanted = item_terms(items, item_key, item_text)
    queries = stored(wanted.groupBy("item", "id").agg(F.collect_list(F.struct("term", "times")).alias("terms")), "items")
    blocks_of_items = -(-queries.count() // at_once)
    out = queries.select(F.col("id").alias(item_key), F.lit(0).alias("rank"), F.lit(None).cast("long").alias(key), F.lit(None).cast("long").alias("score")).limit(0)
    for part in range(blocks_of_items):
        mine = queries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks_of_items)) == part)
        # Items of a block, about ``at_once``, each with its own terms: what the driver and each task hold of them.
        asked = mine.collect()
        known = {t: k for k, t in enumerate(sorted({x["term"] for r in asked for x in r["terms"]}))}
        facts = document_facts(docs, {t.encode(): k for t, k in known.items()}, key, text)
        total = facts.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not total["documents"]:
            return out
        having = facts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()  # one row a known term
        weights = {r["term"]: weight(total["documents"], r["n"]) for r in having}
        ready = Items([r["item"] for r in asked], [[(known[x["term"]], x["times"] * weights.get(known[x["term"]], 0)) for x in r["terms"]] for r in asked])
        found = _rank_items(index(facts, total["documents"], total["length"], block), ready, top, first)
        names = docs.sparkSession.createDataFrame([(k, r["id"]) for k, r in enumerate(asked)], f"item int, id {dict(queries.dtypes)['id']}")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
        ranked = found.withColumn("rank", place).filter(F.col("rank") <= top).join(F.broadcast(names), "item")
        doc = F.when(F.col("doc") < _LAST, F.col("doc")).alias(key)
        out = out.unionByName(ranked.select(F.col("id").alias(item_key), F.col("rank").cast("int").alias("rank"), doc, "score"))
    return out
