"""Near-duplicate texts: tiled SimHash comparison, then exact Jaccard similarity.

Texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Such sets' fingerprints (SimHash of the distinct
shingles) differ in up to ``RADIUS`` bits, with few exceptions; the README gives
the share of links found by radius. At that radius no bands help, so all tiles
are compared with all by exclusive-or and bit counts, but for tile pairs that
cannot hold a link: tiles are cut by set size and population count, and sizes
must be within 5/4 of each other, counts within ``RADIUS``.

Close fingerprints are then checked exactly, in two steps. A task emits a spanning
forest of the close pairs that the parities of their hashes do not rule out
(these differ in no more places than the sets do), and the whole sets of the
forest's pairs are compared. Where one fails, its component may hold other close
pairs, so the sets of that component's texts meet in tiles, and every close pair
that is not yet connected is compared there. Thus no task emits all pairs of a
group, and all close pairs are decided by whole sets.

Texts with equal sets are one row from the start (by 128-bit digest), and copies
are only expanded at the end.

Edge cases: texts without a word are copies of one another; a text under five
words is one shingle; letters A-Z count as lower-case ones; repeated rows are
copies; an empty table gives an empty result; extra columns are kept, clashing
ones too. Equality of shingles rests on 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, numbered, renamed, stored, whole_groups
from .components import components
from .simhash import majority, shingle_hashes

WORDS = 5
RADIUS = 14
BITS = 1024
#: Rows of a tile: a share of all, within bounds. Bytes of sets in a tile of the second check.
TILE, MOST_ROWS, TILES = 8192, 1 << 19, 64
TILE_BYTES = 8 << 20
_BLOCK = 256


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, WORDS))


def parities(marks: np.ndarray) -> bytes:
    """``BITS`` bits: the parity of how many hashes have each remainder."""
    return np.packbits((np.bincount((marks % BITS).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 4/5 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * (len(a) + len(b))


def _sketches(rows: DataFrame) -> DataFrame:
    """_row, c, d (digest of the set), fp, n (set size), bits (parities) of every text."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(1)]
            names = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found), "<i8").reshape(-1, 2)
            marks = np.fromiter(map(majority, found), np.uint64, len(found)).view(np.int64)
            columns = [batch.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(marks), pa.array([len(x) for x in found], pa.int32()), pa.array(map(parities, found), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "c", "d", "fp", "n", "bits"])

    return rows.select("_row", "_text").mapInArrow(sketched, "_row long, c long, d long, fp long, n int, bits binary")


class Forest:
    """Which of ``size`` rows are connected."""

    def __init__(self, root: np.ndarray):
        self.root = root

    def flat(self) -> np.ndarray:
        while (self.root != self.root[self.root]).any():
            self.root = self.root[self.root]
        return self.root

    def top(self, i: int) -> int:
        while self.root[i] != i:
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Connect two rows; false if they are so already."""
        i, j = self.top(i), self.top(j)
        self.root[max(i, j)] = min(i, j)
        return i != j


def close_pairs(fp: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest, radius: int) -> Iterator[tuple[int, int]]:
    """Pairs of a row in ``left`` and one in ``right`` (rows in order of ``n``) that may be alike and are in two trees.

    Both may be the same rows. The caller may join trees between two pairs.
    """
    sizes = n[right]
    same = left is right
    for at in range(0, len(left), _BLOCK):
        block = left[at : at + _BLOCK]
        lo, hi = np.searchsorted(sizes, [-(-4 * int(n[block[0]]) // 5), 5 * int(n[block[-1]]) // 4 + 1])
        lo = max(lo, at) if same else lo
        if hi <= lo:
            continue
        i, j = np.nonzero(np.bitwise_count(fp[block][:, None] ^ fp[right[lo:hi]][None, :]) <= radius)
        i, j = block[i], right[lo + j]
        root = forest.flat()
        good = (root[i] != root[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
        i, j = i[good], j[good]
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            may = 9 * apart <= n[x] + n[y]
            for a, b in zip(x[may].tolist(), y[may].tolist(), strict=True):
                if forest.top(a) != forest.top(b):
                    yield a, b


def _columns(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(-1, BITS // 64)
    return frame["fp"].to_numpy(np.int64).view(np.uint64), frame["n"].to_numpy(np.int64), bits


def tiles_of(cells: list[tuple[int, int, int]], rows: int, radius: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Cut (band of sizes, population count, texts) cells into tiles of about ``rows``.

    Returns (band, count, first tile, tiles) of each cell, and the pairs of tiles that may hold a link.
    """
    placed, tiles, filled = [], [], 0  # tiles: band, least count, greatest count
    for band, pop, n in sorted(cells):
        parts = -(-n // rows)
        if parts == 1 and tiles and tiles[-1][0] == band and filled + n <= rows:
            tiles[-1] = (band, tiles[-1][1], pop)
            filled += n
        else:
            tiles += [(band, pop, pop)] * parts
            filled = n if parts == 1 else rows
        placed.append((band, pop, len(tiles) - parts, parts))
    meet = [
        (i, j)
        for i, (band, low, high) in enumerate(tiles)
        for j, (other, least, most) in enumerate(tiles[i:], i)
        if other - band <= 1 and max(low, least) - min(high, most) <= radius
    ]
    return placed, meet


def close_links(kinds: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Pairs a, b of ``node`` that connect all close ones of kinds (node, fp, n, bits); stored."""
    spark = kinds.sparkSession
    band = F.floor(F.log("n") / math.log(1.25)).cast("int")
    rows = kinds.filter("n > 0").select("node", "fp", "n", "bits", band.alias("band"), F.bit_count("fp").alias("pop"))
    # One row a band of sizes and population count: some thousands at any size.
    cells = [(r["band"], r["pop"], r["count"]) for r in rows.groupBy("band", "pop").count().collect()]
    if not cells:
        return spark.createDataFrame([], "a long, b long")
    room = min(MOST_ROWS, max(tile, sum(c[2] for c in cells) // TILES))
    placed, meet = tiles_of(cells, room, radius)
    pairs: dict[int, list[tuple[int, int]]] = {}
    for g, (i, j) in enumerate(meet):
        pairs.setdefault(i, []).append((g, 0))
        if i != j:
            pairs.setdefault(j, []).append((g, 1))
    cell_table = F.broadcast(spark.createDataFrame(placed, "band int, pop int, first int, parts int"))
    pair_table = F.broadcast(spark.createDataFrame(list(pairs.items()), "tile int, pairs array<struct<g:int,side:int>>"))
    dealt = rows.join(cell_table, ["band", "pop"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = dealt.join(pair_table, "tile").select("node", "fp", "n", "bits", F.inline("pairs"))

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, "g"):
            for _, part in frame.groupby("g", sort=False):
                side = part["side"].to_numpy()
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                forest = Forest(np.arange(len(part)))
                found = []
                for a, b in close_pairs(*_columns(part), left, right if side.any() else left, forest, radius):
                    forest.join(a, b)
                    found.append((a, b))
                node = part["node"].to_numpy()
                edges = np.array(found, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})

    # A number of its own, so that Spark does not put these small but long tasks together.
    sorted_rows = spread.repartition(min(4096, len(meet)), "g").sortWithinPartitions("g", "side", "n")
    return stored(sorted_rows.mapInPandas(compared, "a long, b long").distinct(), "close-links")


def _texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(few(nodes), rows["_row"] == nodes["node"], "left_semi").select(F.col("_row").alias("node"), "_text")


def checked_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """a, b, good (whether the sets are alike) of links between rows (_row, _text); stored."""
    nodes = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "linked")
    texts = stored(_texts_of(rows, nodes), "linked-texts")
    both = links.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(shingles(x.as_py()), shingles(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    return stored(both.mapInArrow(judged, "a long, b long, good boolean"), "checked-links")


def remaining_links(rows: DataFrame, kinds: DataFrame, all_links: DataFrame, checked: DataFrame, good: DataFrame, radius: int = RADIUS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Further links between texts whose component of close texts has a pair that was not alike; stored.

    ``all_links``, ``good``: node and component (a, b) over the close and over the alike links.
    """
    top = lambda links, name: links.select(F.col("a").alias("node"), F.col("b").alias(name))
    close = top(all_links, "comp").unionByName(all_links.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    failed = checked.filter("not good").select(F.col("a").alias("node")).join(close, "node").select("comp").distinct()
    inside = close.join(failed, "comp").join(top(good, "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    inside = stored(inside.join(kinds.select("node", "fp", "n", "bits"), "node"), "doubtful")
    # The texts of a component's largest tree are alike already: they meet the others, not each other.
    trees = inside.groupBy("comp", "root").agg(F.count("*").alias("k"), F.sum(8 * F.col("n").cast("long")).alias("size"))
    order = Window.partitionBy("comp").orderBy(F.desc("k"), "root")
    trees = trees.select("comp", "root", "size", (F.row_number().over(order) == 1).alias("largest"))
    volume = trees.groupBy("comp").agg(F.sum(F.when(F.col("largest"), F.col("size")).otherwise(0)).alias("big"), F.sum(F.when(~F.col("largest"), F.col("size")).otherwise(0)).alias("small"))
    parts = lambda c: F.ceil(F.col(c) / tile_bytes).cast("int")
    whole = F.col("big") + F.col("small") <= tile_bytes
    volume = volume.select("comp", F.when(whole, 0).otherwise(parts("big")).alias("bigs"), F.when(whole, 1).otherwise(parts("small")).alias("smalls"))
    placed = inside.join(trees.select("comp", "root", "largest"), ["comp", "root"]).join(volume, "comp")
    among = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    me = F.when(F.col("largest") & (F.col("bigs") > 0), among(F.col("bigs"))).otherwise(F.col("bigs") + among(F.col("smalls")))
    least = F.when(F.col("largest") & (F.col("bigs") > 0), F.col("bigs")).otherwise(F.lit(0))
    placed = placed.withColumn("me", me).withColumn("other", F.explode(F.sequence(least, F.col("bigs") + F.col("smalls") - 1)))
    texts = _texts_of(rows, stored(inside.select("node"), "doubtful-nodes"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "marks"])

    sets = stored(texts.mapInArrow(listed, "node long, marks binary"), "doubtful-sets")
    spread = placed.join(sets, "node").select(F.xxhash64("comp", F.least("me", "other"), F.greatest("me", "other")).alias("g"), "node", "root", "largest", "fp", "n", "bits", "marks")

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, "g"):
            found = []
            for _, part in frame.groupby("g", sort=False):
                marks = [np.frombuffer(x, np.uint64) for x in part["marks"]]
                _, first, tree = np.unique(part["root"].to_numpy(), return_index=True, return_inverse=True)
                forest = Forest(first[tree])
                few_rows, every = np.flatnonzero(~part["largest"].to_numpy()), np.arange(len(part))
                node = part["node"].to_numpy()
                for a, b in close_pairs(*_columns(part), few_rows, every, forest, radius):
                    if alike(marks[a], marks[b]):
                        forest.join(a, b)
                        found.append((node[a], node[b]))
            yield pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    ordered = spread.repartition("g").sortWithinPartitions("g", "n")
    return stored(ordered.mapInPandas(compared, "a long, b long").distinct(), "further-links")


def first_of_each(rows: DataFrame, radius: int = RADIUS, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """_row of rows (_row, _key, _text) that are not the first of their group of near copies; stored.

    The first is that with the smallest _key, then _row (null keys last).
    """
    marks = stored(_sketches(rows), "sketches")
    rank = F.struct(F.col("_key").isNull().alias("none"), F.col("_key"), F.col("_row"))
    named = marks.join(rows.select("_row", "_key"), "_row")
    kinds = named.groupBy("c", "d").agg(F.min(rank).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    kinds = stored(kinds.select("first._row", "*").withColumnRenamed("_row", "node"), "kinds")
    links = close_links(kinds, radius, tile)
    checked = checked_links(rows, links)
    good = checked.filter("good").select("a", "b")
    found = components(good)
    if checked.filter("not good").head(1):
        more = remaining_links(rows, kinds, components(links), checked, found, radius, tile_bytes)
        found = components(good.unionByName(more))
    roots = kinds.join(found.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    firsts = roots.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first._row")
    return stored(rows.select("_row").join(firsts, "_row", "left_anti"), "copies")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each group of near copies: that with the smallest key (null keys last)."""
    plain, names = renamed(df)
    rows = numbered(plain, names[key])
    copies = first_of_each(rows.select("_row", F.col(names[key]).alias("_key"), F.col(names[text]).alias("_text")), radius)
    kept = rows.join(few(copies), "_row", "left_anti")
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()])
