"""Near-duplicate vectors: rotated binary codes decide which pairs are computed exactly.

Each distinct vector is scaled to length one, turned by a seeded random rotation
and kept as the signs of its coordinates (its code) with one correction factor:
the product of the vector with its code. Product of code and another vector, divided
by that factor, is an unbiased estimate of the cosine. The estimate is off by at
most ``width * sqrt(1 - factor^2) / factor * sqrt(1 - cosine^2)``, where ``width`` is one
(a bound that always holds) or, in many dimensions, ``CONFIDENCE`` standard
deviations of a random direction (it fails for one link in 10^13). Only pairs whose
interval reaches the similarity are computed in double precision, and only these
products decide.

Cells around pivots part the vectors first: a vector visits another cell only if the
plane halfway between the pivots is near enough. A cell's rows and visitors are cut
into tiles; a pair of tiles is a task, which returns a number of links a row and
a spanning forest, never all pairs. Vectors without clusters leave the planes
nothing to skip; then the codes of all rows meet those of all others, once.

Equal vectors are one row with a count from the start.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components
have no link and are their own component; shorter vectors are padded with zeros; of
rows with equal ids each is a row of its own; null ids are never a component's name
unless it has no other, and such rows are not kept; an empty table gives an empty
result; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

COSINE = 0.9
#: Standard deviations that the estimate may be off by, and the seed of the rotation.
CONFIDENCE, SEED = 8.0, 11
#: Rows of a tile: a share of all rows within bounds, and its bytes at most.
TILE, TILES, MOST_ROWS, TILE_BYTES = 4096, 64, 1 << 17, 64 << 20
#: Pivots at most, and sampled rows a pivot.
MOST_PIVOTS, SAMPLE_A_PIVOT, ROUNDS = 1024, 16, 4
_BLOCK, _PAIRS = 512, 1 << 15


def takes_part(vector: Column) -> Column:
    """Whether a vector (array<double>) can link."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    sound = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(sound, F.lit(False))


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scaled(points: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish."""
    return np.ldexp(points, -np.frexp(np.abs(points).max(1, initial=0.0))[1][:, None])


def unit(points: np.ndarray) -> np.ndarray:
    near = scaled(points)
    return near / np.sqrt(np.einsum("ij,ij->i", near, near))[:, None]


def rotated(points: np.ndarray) -> np.ndarray:
    """Rows turned by a random rotation: three rounds of random signs and a Hadamard transform, in the next power of two dimensions."""
    size = 1 << max(0, points.shape[1] - 1).bit_length()
    out = np.zeros((len(points), size))
    out[:, : points.shape[1]] = points
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (3, size))
    for row in signs:
        out = out * row
        step = 1
        while step < size:
            halves = out.reshape(len(out), -1, 2, step)
            out = np.stack((halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]), 2).reshape(len(out), size)
            step *= 2
        out /= math.sqrt(size)
    return out


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed signs) and correction factors of turned rows of length one."""
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def least_products(factors: np.ndarray, size: int, cosine: float, confidence: float) -> np.ndarray:
    """What the product with a code is at least, for vectors within ``cosine`` of the coded ones."""
    width = min(1.0, confidence / math.sqrt(max(1, size - 1)))
    off = np.sqrt(np.maximum(0.0, 1 - factors**2)) * math.sqrt(max(0.0, 1 - cosine**2))
    return factors * cosine - width * off - size * 2.0**-22


class Side:
    """A tile's rows as they are compared: exact vectors, norms, turned rows, codes and the least products of links."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, factors: np.ndarray, cosine: float, confidence: float):
        self.rows = rows
        self.norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        self.turned = rotated(rows / self.norms[:, None]).astype(np.float32)
        size = self.turned.shape[1]
        self.signs = (np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))
        self.least = least_products(factors, size, cosine, confidence).astype(np.float32)


def linked(left: Side, right: Side, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Linked pairs by blocks, and how many were computed exactly. Both sides may be the same."""
    for at in range(0, len(left.rows), _BLOCK):
        block = slice(at, at + _BLOCK)
        after = at if left is right else 0
        i, j = np.nonzero(left.turned[block] @ right.signs[after:].T >= right.least[None, after:])
        i, j = i + at, j + after
        if left is right:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), _PAIRS):
            a, b = i[k : k + _PAIRS], j[k : k + _PAIRS]
            good = np.einsum("ij,ij->i", left.rows[a], right.rows[b]) / (left.norms[a] * right.norms[b]) >= cosine
            yield a[good], b[good], len(a)


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Trees (each row's smallest member) after pairs a, b are joined."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def pivots_of(kinds: DataFrame, count: int, width: int) -> np.ndarray:
    """Cell centres of unit vectors, from a bounded sample."""
    chosen = kinds.orderBy(F.xxhash64(F.lit(5), "node")).select("x").limit(count * SAMPLE_A_PIVOT).toPandas()
    sample = unit(matrix(chosen["x"], width))
    pivots = sample[:count].copy()
    for _ in range(ROUNDS):
        owner = (sample @ pivots.T - np.einsum("ij,ij->i", pivots, pivots) / 2).argmax(1)
        for k in np.unique(owner):
            pivots[k] = sample[owner == k].mean(0)
    return np.unique(pivots, axis=0)


def distances(pivots: np.ndarray) -> np.ndarray:
    """Between all pivots."""
    return np.sqrt(np.array([((p - pivots) ** 2).sum(1) for p in pivots]))


def visits(points: np.ndarray, pivots: np.ndarray, between: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own cell, and which later cells (columns) hold rows that may lie within ``reach``."""
    squares = np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * points @ pivots.T
    home = squares.argmin(1)
    further = squares - squares[np.arange(len(points)), home][:, None]  # twice the gap of the pivots by the distance to the plane halfway
    near = further <= 2 * between[home] * (reach + 1e-6) + 1e-9
    return home, near & (np.arange(len(pivots))[None, :] > home[:, None])


def tile_links(kinds: DataFrame, n: int, width: int, cosine: float = COSINE, confidence: float = CONFIDENCE, tile: int = TILE) -> DataFrame:
    """node, peer, links: for each pair of tiles a row's number of linked rows (peer null), and pairs that connect all linked nodes; stored.

    ``kinds``: node, x, rows, one row for each of ``n`` distinct vectors.
    """
    spark = kinds.sparkSession
    room = max(64, min(max(tile, n // TILES), MOST_ROWS, TILE_BYTES // (8 * width)))
    pivots = pivots_of(kinds, min(MOST_PIVOTS, max(1, -(-n // (2 * room)))), width)
    between, reach = distances(pivots), math.sqrt(max(0.0, 2 - 2 * cosine))

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = scaled(matrix(frame["x"], width))
            ones = points / np.sqrt(np.einsum("ij,ij->i", points, points))[:, None]
            codes, factors = encode(rotated(ones))
            home, further = visits(ones, pivots, between, reach)
            yield pd.DataFrame(
                {
                    "node": frame["node"], "rows": frame["rows"], "factor": factors, "cell": home.astype(np.int32),
                    "further": [np.flatnonzero(x).astype(np.int32) for x in further], "code": [x.tobytes() for x in codes], "point": [x.tobytes() for x in points],
                }
            )

    kind = "node long, rows long, factor double, cell int, further array<int>, code binary, point binary"
    ready = stored(kinds.select("node", "x", "rows").mapInPandas(coded, kind), "coded")
    # One row a cell, of which there are MOST_PIVOTS at most.
    homes = {r["cell"]: r["count"] for r in ready.groupBy("cell").count().collect()}
    guests = {r["cell"]: r["count"] for r in ready.select(F.explode("further").alias("cell")).groupBy("cell").count().collect()}
    cells = [(c, -(-k // room), -(-guests.get(c, 0) // room)) for c, k in homes.items()]
    table = F.broadcast(spark.createDataFrame(cells, "cell int, homes int, guests int"))
    among = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    # Tiles of a cell: its own first, then the visitors'. A pair of tiles has one of the cell's own at least.
    meets = lambda me, other: F.struct(F.least(me, other).alias("low"), F.greatest(me, other).alias("high"))
    own = ready.join(table, "cell").withColumn("me", among(F.col("homes")))
    own = own.select("cell", "node", "rows", "factor", "code", "point", "me", F.explode(F.transform(F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1), lambda t: meets(F.col("me"), t))).alias("pair"))
    guest = ready.select("node", "rows", "factor", "code", "point", F.explode("further").alias("cell")).join(table, "cell").withColumn("me", F.col("homes") + among(F.col("guests")))
    guest = guest.select("cell", "node", "rows", "factor", "code", "point", "me", F.explode(F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda t: meets(F.col("me"), t))).alias("pair"))
    spread = own.unionByName(guest).select(F.struct("cell", "pair").alias("g"), (F.col("me") == F.col("pair.low")).alias("low"), (F.col("pair.low") == F.col("pair.high")).alias("same"), "node", "rows", "factor", "code", "point")

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        same, low = bool(frame["same"].iloc[0]), frame["low"].to_numpy(bool)
        halves = [np.flatnonzero(low), np.flatnonzero(~low)]
        if not (len(halves[0]) and (same or len(halves[1]))):  # no row fell into one of the tiles
            return pd.DataFrame({"node": [], "peer": pd.array([], "Int64"), "links": []})
        sides = []
        for half in halves[: 1 if same else 2]:
            part = frame.iloc[half]
            points = np.frombuffer(b"".join(part["point"]), float).reshape(len(part), width)
            codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
            sides.append(Side(points, codes, part["factor"].to_numpy(), cosine, confidence))
        left, right = (halves[0], halves[0]) if same else halves
        weight, counts, root = frame["rows"].to_numpy(np.int64), np.zeros(len(frame), np.int64), np.arange(len(frame))
        for a, b, _ in linked(sides[0], sides[-1], cosine):
            a, b = left[a], right[b]
            np.add.at(counts, a, weight[b])
            np.add.at(counts, b, weight[a])
            root = forest(root, a, b)
        node = frame["node"].to_numpy(np.int64)
        some, child = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
        none = pd.array([None] * len(some), "Int64")
        peers = pd.array(node[root[child]], "Int64")
        return pd.DataFrame({"node": np.concatenate((node[some], node[child])), "peer": pd.concat([pd.Series(none), pd.Series(peers)], ignore_index=True), "links": np.concatenate((counts[some], np.zeros(len(child), np.int64)))})

    pairs = sum(h * (h + 1) // 2 + h * g for _, h, g in cells)
    # A number of its own, so that Spark does not put these small but long tasks together.
    grouped = spread.repartition(min(4096, max(1, pairs)), "g").groupBy("g")
    return stored(grouped.applyInPandas(compared, "node long, peer long, links long"), "vector-links")


def near_duplicate_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, confidence: float = CONFIDENCE, tile: int = TILE) -> DataFrame:
    """``key``, n_links, component_id and kept of every row: links are pairs of rows with a cosine of at least ``cosine`` (above 0)."""
    plain = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    plain = plain.select("id", F.when(takes_part(F.col("v")), F.col("v")).alias("x"))
    counted = plain.filter(F.col("x").isNotNull()).groupBy("x").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    kinds = stored(counted.select(F.monotonically_increasing_id().alias("node"), "x", "rows", "first"), "vector-kinds")
    facts = kinds.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    alone = plain.filter(F.col("x").isNull()).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if facts["n"]:
        found = tile_links(kinds, facts["n"], facts["width"], cosine, confidence, tile)
        counts = found.filter("peer is null").groupBy("node").agg(F.sum("links").alias("links"))
        tops = components(found.filter("peer is not null").select(F.col("node").alias("a"), F.col("peer").alias("b")))
        roots = kinds.select("node", "x", "rows", "first").join(counts, "node", "left").join(tops.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
        roots = roots.select("x", "first", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
        least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
        named = roots.join(least, "root").select("x", "n_links", "component_id")
        alone = alone.unionByName(plain.join(named, "x").select(F.col("id").alias(key), "n_links", "component_id"))
    return alone.select(key, "n_links", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("kept"))
