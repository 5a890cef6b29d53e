"""SimHash near-duplicates: exact links between 64-bit fingerprints.

Tiles of all fingerprints, with only population counts to part them, would be
compared a third of all with all at two bits. So bands come first: cut into
``radius`` and some more blocks, two linked fingerprints agree exactly on all
blocks but ``radius`` of them, and the distinct fingerprints are dealt by the
value of every such choice of blocks; the more rows, the longer these values.
A value with more fingerprints than a tile is cut into tiles
by population count (and a hash where one count alone is too much), and only
tile pairs whose counts differ by at most ``radius`` get a task. In a task
numpy compares by exclusive-or and bit counts, in population order, so
comparisons stop where the counts part. A task emits a spanning forest of what
it links instead of all pairs; components are then found by stars.
``similar.py`` compares by tiles alone, at a radius where no bands help.

Copies with the same fingerprint are one row from the start and are expanded
only in the last join.

Edge cases: null and empty texts have fingerprint zero and link like any
other; repeated rows share a component; an empty table gives an empty result;
extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_groups
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
TILE = 512
_BITS_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all word shingles in order, repeats included.

    ``bytes.lower`` and ``bytes.split`` know ASCII alone: exactly A-Z, and
    exactly the six separators of the word rule.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[shingle - 1 :] or [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have (none: 0)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = hashes[at : at + _BITS_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all word shingles."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and fp long (the fingerprint as a signed number) of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=[key, "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_t")).mapInArrow(scored, f"`{key}` {kind}, fp long")


def _forest(group: np.ndarray, pop: np.ndarray, marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each group (rows sorted by group, pop), as child and parent rows."""
    root = np.arange(len(marks))
    active = np.arange(len(marks))
    for step in range(1, len(marks)):
        active = active[active + step < len(marks)]
        active = active[(group[active] == group[active + step]) & (pop[active + step] - pop[active] <= radius)]
        if not len(active):
            break
        near = active[np.bitwise_count(marks[active] ^ marks[active + step]) <= radius]
        near = near[root[near] != root[near + step]]
        for i in near.tolist():
            a, b = i, i + step
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while len(near) and (root != root[root]).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(root)))
    return child, root[child]


def blocks_for(rows: int, radius: int) -> int:
    """Blocks to cut fingerprints into, so that a value of all but ``radius`` of them holds few of ``rows`` by chance."""
    wanted = math.log2(max(2, rows)) + 4
    return next((n for n in range(radius + 1, radius + 3) if 64 * (n - radius) / n >= wanted), radius + 3)


def links(marks: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links a, b that connect all distinct ``fp`` within ``radius`` of each other."""
    blocks = blocks_for(marks.count(), radius)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (m >> 63 << 64) for m in masks]
    bands = [F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(signed)]
    dealt = marks.select("fp", F.bit_count("fp").alias("pop"), F.inline(F.array(*bands)))
    by_pop = dealt.groupBy("band", "value", "pop").agg(F.count("*").alias("n"))
    tiles = F.ceil(F.col("n") / tile).cast("int")
    keys = by_pop.groupBy("band", "value").agg(F.sum("n").alias("total"), F.collect_list(F.struct("pop", tiles.alias("tiles"))).alias("pops"))
    shared = dealt.join(keys.filter("total > 1"), ["band", "value"])
    own = F.get(F.filter("pops", lambda p: p["pop"] == F.col("pop")), F.lit(0))["tiles"]
    me = F.struct(F.col("pop").alias("pop"), F.pmod(F.xxhash64("fp"), own).cast("int").alias("tile"))
    near = F.filter("pops", lambda p: F.abs(p["pop"] - F.col("pop")) <= radius)
    others = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0), p["tiles"] - 1), lambda t: F.struct(p["pop"].alias("pop"), t.alias("tile")))))
    alone = F.array(F.struct(F.lit(0).alias("pop"), F.lit(0).alias("tile")))
    split = F.col("total") > tile
    spread = shared.select("band", "value", "fp", "pop", F.when(split, me).otherwise(alone[0]).alias("me"), F.explode(F.when(split, others).otherwise(alone)).alias("other"))
    grouped = spread.select(F.xxhash64("band", "value", F.least("me", "other"), F.greatest("me", "other")).alias("g"), "pop", "fp")
    sorted_rows = grouped.repartition("g").sortWithinPartitions("g", "pop", "fp")

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(forest_of, whole_groups(frames, "g"))

    def forest_of(frame: pd.DataFrame) -> pd.DataFrame:
        marks = frame["fp"].to_numpy(np.int64)
        child, parent = _forest(frame["g"].to_numpy(), frame["pop"].to_numpy(), marks.view(np.uint64), radius)
        return pd.DataFrame({"a": marks[child], "b": marks[parent]})

    return sorted_rows.mapInPandas(compared, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key``, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest key that is reachable over links.
    """
    marked = stored(fingerprints(df, key, text), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    found = components(links(distinct.select("fp"), radius))
    roots = distinct.join(found.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    roots = roots.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    out = marked.join(named, "fp")
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
