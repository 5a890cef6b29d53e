"""Exact top-k inner products by M-trees.

Pivots from a bounded sample deal the vectors into cells of near ones; a cell is
cut into trees of bounded size. A tree is bulk-loaded in a task into paged metric
nodes with covering radii and parent distances, and stored as one row. Inner
product becomes a metric by one more coordinate that lifts all vectors of a tree
to the same norm: the nearest in that space has the highest product. Blocks of
the stated query set run best-first over a tree's nodes: a node that is beyond a
query's k-th best is skipped, and so are entries by their stored parent distances
(triangle inequality) before any distance is computed.

Each query meets the tree whose centre promises most first; with its k-th best
there it goes on only to trees whose bound (product with the centre, and norm
times covering radius) reaches that score. Vectors without clusters leave these
bounds nothing to skip; then the work is that of all queries by all rows.

Edge cases: vectors that are null, empty, or hold null or non-finite components
take no part (neither as queries nor as candidates), nor do rows without an id;
shorter vectors are padded with zeros; of rows with equal ids each asks and each
is a candidate for the others (equal rows are one row with a count, and answers
are repeated at the end); fewer than k candidates give fewer rows; an empty
table gives an empty result. Finite vectors of any size take part: where products
could pass 2^53 they are computed in whole numbers, and a score among the best
that does not fit a long is an error.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP = 5
#: Rows of a tree at least; with many rows trees grow, so that their centres, which every task holds, stay few and take
#: no more than CENTRE_BYTES (and those of a tree a pivot).
TREE_ROWS, MOST_TREES, CENTRE_BYTES = 16_384, 20_000, 32 << 20
PAGE = 128
QUERY_BLOCK = 512
SCALE = 256
#: Sampled rows a pivot, pivots at most, and rounds in which pivots move to the mean of their sample.
SAMPLE_A_PIVOT, MOST_PIVOTS, ROUNDS = 16, 1024, 4
_FAR = (1 << 63) - 1  # stands for scores that do not fit a long


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *others: str) -> DataFrame:
    """``key``, x array<double>: floor(SCALE * component), and ``others``, of the vectors that take part."""
    whole = float(1 << 53)  # from here on doubles are whole numbers
    raised = F.transform(F.col(vector).cast("array<double>"), lambda v: F.when(F.abs(v * SCALE) < whole, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE))
    wild = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    clean = df.filter(good & ~F.exists(F.col(vector).cast("array<double>"), wild))
    return clean.select(F.col(key).cast("long").alias(key), raised.alias("x"), *others)


class Node:
    """A page: its pivot, covering radius, and either child nodes or vectors."""

    __slots__ = ("pivot", "radius", "children", "pivots", "radii", "offsets", "ids", "own", "rows")

    def __getstate__(self):
        return {k: getattr(self, k) for k in self.__slots__ if hasattr(self, k)}

    def __setstate__(self, state):
        for k, v in state.items():
            setattr(self, k, v)


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Between all ``points`` (rows) and all ``to`` (columns)."""
    squares = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", to, to)[None, :] - 2 * points @ to.T
    return np.sqrt(np.maximum(squares, 0))


def build(ids: np.ndarray, own: np.ndarray, rows: np.ndarray) -> tuple[Node, float]:
    """Bulk-load a tree; returns its root and the square of the norm it lifts to.

    ``own``: the number of a row (-1 for further copies of it).
    """
    norms = np.einsum("ij,ij->i", rows, rows)
    top_norm = float(norms.max())
    lifted = np.column_stack((rows, np.sqrt(np.maximum(0.0, top_norm - norms))))

    def grow(index: np.ndarray) -> Node:
        node = Node()
        node.pivot = lifted[index[0]]
        away = _distances(lifted[index], node.pivot[None, :])[:, 0]
        node.radius = float(away.max())
        if len(index) <= PAGE:
            node.ids, node.own, node.rows, node.offsets, node.children = ids[index], own[index], rows[index], away, None
            return node
        seeds = lifted[index[np.linspace(0, len(index) - 1, min(PAGE, -(-2 * len(index) // PAGE))).astype(int)]]
        owner = (np.einsum("ij,ij->i", seeds, seeds)[None, :] - 2 * lifted[index] @ seeds.T).argmin(1)
        parts = [index[owner == s] for s in np.unique(owner)]
        if len(parts) == 1:  # equal vectors: cut them into even parts
            parts = np.array_split(index, min(PAGE, -(-len(index) // PAGE)))
        node.children = [grow(p) for p in parts]
        node.pivots = np.array([c.pivot for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.offsets = _distances(node.pivots, node.pivot[None, :])[:, 0]
        return node

    with np.errstate(over="ignore", invalid="ignore"):
        return grow(np.arange(len(ids))), top_norm


def _products(rows: np.ndarray, queries: np.ndarray, safe: bool) -> np.ndarray:
    """Whole inner products, queries by rows; what does not fit a long becomes _FAR with its sign."""
    if safe:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in rows.tolist()]
    out = np.empty((len(queries), len(rows)), np.int64)
    for i, q in enumerate(queries.tolist()):
        q = [int(v) for v in q]
        out[i] = [max(-_FAR, min(_FAR, sum(a * b for a, b in zip(q, row, strict=True)))) for row in whole]
    return out


class Best:
    """The ``top`` best (score, id) so far of each query of a block; ``least``: scores known to be reached elsewhere."""

    def __init__(self, queries: int, top: int, least: np.ndarray | None = None):
        self.score = np.full((queries, top), -_FAR - 1, np.int64)
        self.ids = np.full((queries, top), _FAR, np.int64)
        self.least = np.full(queries, -np.inf) if least is None else least

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        score = np.concatenate((self.score[who], np.where(allowed, score, -_FAR - 1)), axis=1)
        ids = np.concatenate((self.ids[who], np.where(allowed, ids[None, :], _FAR)), axis=1)
        order = np.lexsort((ids, ~score), axis=1)[:, : self.score.shape[1]]  # ~ reverses, without overflow
        self.score[who], self.ids[who] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def reached(self, who: np.ndarray) -> np.ndarray:
        """A score that each query's k-th best surely has."""
        last = self.score[who, -1]
        return np.maximum(np.where(last < -_FAR, -np.inf, last.astype(float)), self.least[who])


def search(root: Node, top_norm: float, queries: np.ndarray, own: np.ndarray, best: Best) -> int:
    """Add a tree's best candidates of a block of queries; returns how many distances and products were computed.

    ``own``: numbers of the queries' own rows, which are no candidates of theirs.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        points = np.column_stack((queries, np.zeros(len(queries))))
        squares = np.einsum("ij,ij->i", queries, queries)
        safe = bool(np.sqrt(top_norm * squares.max(initial=0.0)) < 1 << 52)
        # Squared distances come from sums of about width products, so their error is bounded by width and norms, and that
        # of a distance by its root. A test holds at most four distances (near, offset, a radius and the reach itself).
        error = (queries.shape[1] + 8) * 2.0**-50 * (squares + top_norm) + 1e-9
        room = 4 * np.sqrt(error)

        def reach(who: np.ndarray) -> np.ndarray:
            """Distance of the k-th best, with room for rounding (infinite before there is one)."""
            return np.sqrt(np.maximum(0.0, squares[who] + top_norm - 2 * best.reached(who) + error[who])) + room[who]

        everyone = np.arange(len(queries))
        near = _distances(points, root.pivot[None, :])[:, 0]
        low = np.maximum(0.0, near - root.radius)
        heap = [(float(low.min(initial=0.0)), 0, everyone, near, low, root)]
        pushed, computed = 0, len(queries)
        while heap:
            _, _, who, near, low, node = heapq.heappop(heap)
            keep = ~(low > reach(who))
            who, near = who[keep], near[keep]
            if not len(who):
                continue
            bound = reach(who)[:, None]
            if node.children is None:
                wanted = ~(np.abs(near[:, None] - node.offsets[None, :]) > bound)
                some = wanted.any(0)
                if some.any():
                    computed += len(who) * int(some.sum())
                    score = _products(node.rows[some], queries[who], safe)
                    best.add(who, score, node.ids[some], node.own[None, some] != own[who][:, None])
                continue
            wanted = ~(np.abs(near[:, None] - node.offsets[None, :]) - node.radii[None, :] > bound)
            some = np.flatnonzero(wanted.any(0))
            away = _distances(points[who], node.pivots[some])
            computed += away.size
            for column, child in enumerate(some.tolist()):
                mine = wanted[:, child] & ~(away[:, column] - node.radii[child] > bound[:, 0])
                if mine.any():
                    pushed += 1
                    near_child = away[mine, column]
                    low_child = np.maximum(0.0, near_child - node.radii[child])
                    first = float(np.nan_to_num(low_child, nan=0.0).min())
                    heapq.heappush(heap, (first, pushed, who[mine], near_child, low_child, node.children[child]))
    return computed


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * points @ pivots.T).argmin(1)


def lowest(ready: DataFrame, wanted: int, n: int) -> DataFrame:
    """The ``wanted`` rows of ``ready`` (``n`` rows) with the lowest hashes of num.

    Only hashes below a bound that some twice as many rows keep are ordered, as each task sends
    the driver its own lowest ones: without the bound ``wanted`` rows a task, however many tasks.
    """
    place = F.xxhash64(F.lit(3), "num")
    some = 2 * wanted + 1000
    if some < n:
        ready = ready.filter(place < F.lit(some * (1 << 64) // n - (1 << 63)))
    return ready.orderBy(place).limit(wanted)


def pivots_of(ready: DataFrame, n: int, width: int, tree_rows: int) -> np.ndarray:
    """Cell centres from a bounded sample: MOST_PIVOTS x SAMPLE_A_PIVOT rows at most."""
    count = min(MOST_PIVOTS, max(1, -(-n // tree_rows)))
    chosen = lowest(ready, count * SAMPLE_A_PIVOT, n).select("x").toPandas()
    sample = _matrix(chosen["x"], width)
    pivots = sample[:count].copy()
    for _ in range(ROUNDS):
        owner = _nearest(sample, pivots)
        for k in np.unique(owner):
            pivots[k] = sample[owner == k].mean(0)
    return np.nan_to_num(pivots)


def planted(ready: DataFrame, n: int, width: int, top: int, tree_rows: int) -> DataFrame:
    """tree, root (pickled, with its norm), centre and radius of every tree; stored."""
    spark = ready.sparkSession
    pivots = pivots_of(ready, n, width, tree_rows)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(cell=_nearest(_matrix(frame["x"], width), pivots).astype(np.int32))

    rows = stored(ready.mapInPandas(dealt, "num long, id long, x array<double>, rows long, cell int"), "cells")
    first, cells = 0, []
    for r in rows.groupBy("cell").count().orderBy("cell").collect():  # MOST_PIVOTS rows at most
        parts = -(-r["count"] // tree_rows)
        cells.append((r["cell"], first, parts))
        first += parts
    table = F.broadcast(spark.createDataFrame(cells, "cell int, first int, parts int"))
    tree = F.col("first") + F.pmod(F.xxhash64("num"), F.col("parts")).cast("int")

    def plant(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("num")
        points = _matrix(frame["x"], width)
        copies = np.minimum(frame["rows"].to_numpy(), top + 1)
        order = np.repeat(np.arange(len(frame)), copies)
        own = frame["num"].to_numpy()[order]
        own[1:][order[1:] == order[:-1]] = -1
        tree = build(frame["id"].to_numpy()[order], own, points[order])
        with np.errstate(over="ignore", invalid="ignore"):
            centre = points.mean(0)
            radius = float(np.sqrt(((points - centre) ** 2).sum(1)).max())
        return pd.DataFrame({"tree": [int(frame["tree"].iloc[0])], "root": [pickle.dumps(tree)], "centre": [centre.tolist()], "radius": [radius]})

    grown = rows.join(table, "cell").select(tree.alias("tree"), "num", "id", "x", "rows").groupBy("tree")
    return stored(grown.applyInPandas(plant, "tree int, root binary, centre array<double>, radius double"), "m-trees")


def top_products(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", top: int = TOP, tree_rows: int = TREE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` best candidates of every query.

    ``is_query``: a condition on ``key``. Ties go to the smaller id.
    """
    counted = quantised(df, key, vector).groupBy(key, "x").agg(F.count("*").alias("rows"))
    ready = stored(counted.select(F.monotonically_increasing_id().alias("num"), F.col(key).alias("id"), "x", "rows"), "vectors")
    facts = ready.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = facts["n"], int(facts["width"] or 1)
    out = ready.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    if not n:
        return out
    forest = planted(ready, n, width, top, max(tree_rows, -(-n // min(MOST_TREES, max(1, CENTRE_BYTES // (8 * width))))))
    about = sorted(forest.select("tree", "centre", "radius").collect())  # MOST_TREES + MOST_PIVOTS rows at most
    numbers = np.array([r["tree"] for r in about], np.int32)
    centres, radii = np.array([r["centre"] for r in about]), np.array([r["radius"] for r in about])
    asked = ready.withColumnRenamed("id", key).filter(is_query).select("num", "x", "rows", F.col(key).alias("id"))
    asked = stored(asked, "queries")

    def sent(first: bool):
        def trees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                points = _matrix(frame["x"], width)
                with np.errstate(over="ignore", invalid="ignore"):
                    promise = np.nan_to_num(points @ centres.T)
                    home = promise.argmax(1)
                    if first:
                        yield frame.assign(tree=numbers[home])
                        continue
                    norm = np.sqrt(np.einsum("ij,ij->i", points, points))
                    most = promise + norm[:, None] * radii[None, :] * (1 + 1e-9) + 1e-9 * norm[:, None] * np.sqrt(np.einsum("ij,ij->i", centres, centres))[None, :] + 1e-6
                    go = ~(most < frame["least"].fillna(-np.inf).to_numpy()[:, None])
                go[np.arange(len(frame)), home] = False
                who, where = np.nonzero(go)
                yield frame.iloc[who].assign(tree=numbers[where])

        return trees

    def answered(queries: DataFrame) -> DataFrame:
        """The best of each query in the tree that it was sent to."""
        block = F.pmod(F.xxhash64(F.lit(1), "num"), F.lit(max(1, -(-n // (50 * QUERY_BLOCK))))).cast("int")
        blocks = queries.groupBy("tree", block.alias("block")).agg(F.collect_list(F.struct("num", "x", "least")).alias("asked"))

        def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for root, queries in zip(frame["root"], frame["asked"], strict=True):
                    tree, top_norm = pickle.loads(root)
                    own = np.array([q["num"] for q in queries], np.int64)
                    least = np.array([np.nan if q["least"] is None else q["least"] for q in queries], float)
                    best = Best(len(own), top, np.nan_to_num(least, nan=-np.inf))
                    search(tree, top_norm, _matrix([q["x"] for q in queries], width), own, best)
                    who, place = np.nonzero(best.score > -_FAR - 1)
                    yield pd.DataFrame({"num": own[who], "vec_id": best.ids[who, place], "score": best.score[who, place]})

        return blocks.join(forest.select("tree", "root"), "tree").select("root", "asked").mapInPandas(answers, "num long, vec_id long, score long")

    kind = "num long, x array<double>, least double, tree int"
    start = asked.select("num", "x", F.lit(None).cast("double").alias("least"))
    found = stored(answered(start.mapInPandas(sent(True), kind)), "first-answers")
    least = found.groupBy("num").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("k")).filter(F.col("k") >= top)
    rest = asked.select("num", "x").join(least.select("num", "least"), "num", "left").select("num", "x", "least")
    found = found.unionByName(stored(answered(rest.mapInPandas(sent(False), kind)), "further-answers"))
    place = F.row_number().over(Window.partitionBy("num").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= top)
    fits = F.when(F.abs("score") < _FAR, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    again = asked.select("num", F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    return again.join(ranked, "num").select("query_id", "rank", "vec_id", fits.alias("score"))
