"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Rows are dealt to segments of bounded size; a segment is stored as one row with
its vectors and, a dimension, its rows in the order of that coordinate. An anchor
reads every list from the end that its own sign prefers, so what it has not met at some
depth cannot score more than the sum of the coordinates at that depth (the threshold).
Rows that it meets are scored at once by whole inner products. First the anchor's positives
are found (the best rows of its label); each of them opens a window of scores,
and a second pass finds the best rows of other labels in every window. A search ends
once the threshold is strictly below the k-th best found for each window, so ties,
which go to the smaller id, are complete.

A task holds one segment, and anchors stream past it. In many dimensions the threshold
falls slowly, and an anchor meets nearly all rows of a segment: the work is then that
of all anchors by all rows.

Edge cases: rows with a null id, a null label, or a vector that is null, empty, or holds
null or non-finite components take no part; shorter vectors are padded with zeros; of
rows with equal ids each is a row of its own; anchors without a positive, and windows
without a negative, give no row; fewer candidates give fewer rows; an empty table
gives an empty result. Finite vectors of any size take part; a score among the best
that does not fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .search import _FAR, _matrix, _products, quantised

POSITIVES, NEGATIVES = 5, 3
#: Bounds of a negative's score, in hundredths of its positive's.
LOW, HIGH = 50, 95
#: Rows of a segment: a share of all rows within bounds, and its bytes at most. Tasks at least. Depth of the first step.
SEGMENT, SEGMENTS, SEGMENT_BYTES, TASKS, DEPTH = 8192, 1024, 16 << 20, 24, 64


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest score with low * score <= 100 * other <= high * score, in whole numbers of any size."""
    return -(-low * score // 100), high * score // 100


class Segment:
    """Rows with their lists: ``order[d]`` are the rows by rising coordinate d."""

    def __init__(self, nums: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, order: np.ndarray):
        self.nums, self.ids, self.labels, self.rows, self.order = nums, ids, labels, rows, order
        self.sorted = np.take_along_axis(rows.T, order.astype(np.int64), 1)
        with np.errstate(over="ignore"):
            self.norm = float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0.0)))

    def thresholds(self, anchor: np.ndarray, depth: int) -> float:
        """What a row that no list has shown down to ``depth`` scores at most."""
        at = np.where(anchor > 0, self.rows.shape[0] - depth, depth - 1)
        with np.errstate(over="ignore", invalid="ignore"):
            parts = anchor * self.sorted[np.arange(len(anchor)), at]
            total = float(parts.sum())
            slack = 0.0 if self.norm * np.sqrt((anchor * anchor).sum()) < 1 << 52 else 1e-9 * float(np.abs(parts).sum()) + 1
        return np.inf if np.isnan(total + slack) else total + slack

    def shown(self, anchor: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Rows that the lists show from ``start`` to ``stop``."""
        up, down = self.order[anchor <= 0, start:stop], self.order[anchor > 0, self.rows.shape[0] - stop : self.rows.shape[0] - start]
        return np.concatenate((up.ravel(), down.ravel()))


class Best:
    """The best (score, id) of one window of scores."""

    def __init__(self, low: int, high: int, top: int):
        self.low, self.high, self.top = low, high, top
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[-1] if len(self.scores) == self.top else self.low
        some = np.flatnonzero((scores >= max(least, self.low)) & (scores <= self.high))
        if len(some):
            scores, ids = np.concatenate((self.scores, scores[some])), np.concatenate((self.ids, ids[some]))
            order = np.lexsort((ids, ~scores))[: self.top]
            self.scores, self.ids = scores[order], ids[order]

    def done(self, threshold: float) -> bool:
        return threshold < (int(self.scores[-1]) if len(self.scores) == self.top else self.low)


def search(segment: Segment, anchor: np.ndarray, fits: np.ndarray, windows: list[Best], depth: int = DEPTH) -> int:
    """Add the segment's best rows among those that ``fits`` marks to every window; returns how many rows were scored."""
    n = len(segment.ids)
    with np.errstate(over="ignore"):
        safe = bool(segment.norm * np.sqrt((anchor * anchor).sum()) < 1 << 52)
    seen, start, scored = np.zeros(n, bool), 0, 0
    while start < n:
        stop = min(n, max(depth, 2 * start))
        new = np.zeros(n, bool)
        new[segment.shown(anchor, start, stop)] = True
        new &= ~seen
        seen |= new
        rows = np.flatnonzero(new & fits)
        if len(rows):
            scored += len(rows)
            scores = _products(segment.rows[rows], anchor[None, :], safe)[0]
            for w in windows:
                w.add(scores, segment.ids[rows])
        threshold = segment.thresholds(anchor, stop)
        if all(w.done(threshold) for w in windows) or seen.all():
            break
        start = stop
    return scored


def segments(ready: DataFrame, n: int, width: int, size: int) -> tuple[DataFrame, int]:
    """seg and the stored rows and lists of every segment; how many there may be."""
    room = max(16, min(max(size, n // SEGMENTS), SEGMENT_BYTES // (12 * width)))
    count = -(-n // room)

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("num")
        rows = _matrix(frame["x"], width)
        order = np.argsort(rows.T, axis=1, kind="stable").astype(np.int32)
        parts = {c: [frame[c].to_numpy(np.int64).tobytes()] for c in ("num", "id", "label")}
        return pd.DataFrame({"seg": frame["seg"].iloc[:1].to_numpy(), "nums": parts["num"], "ids": parts["id"], "labels": parts["label"], "rows": [rows.tobytes()], "lists": [order.tobytes()]})

    dealt = ready.withColumn("seg", F.pmod(F.xxhash64(F.lit(7), "num"), F.lit(count)).cast("int"))
    made = dealt.groupBy("seg").applyInPandas(built, "seg int, nums binary, ids binary, labels binary, rows binary, lists binary")
    return stored(made, "segments"), count


def _found(parts: DataFrame, count: int, anchors: DataFrame, width: int, answer) -> DataFrame:
    """num, place, id, score that ``answer(segment, anchor row)`` yields for every anchor (num, label, x, scores) and segment; stored."""
    strips = max(1, -(-TASKS // count))
    held_by = F.transform(F.sequence(F.lit(0), F.lit(strips - 1)), lambda k: F.col("seg") * strips + k)
    base = parts.select(F.explode(held_by).alias("g"), F.lit(0).alias("kind"), "nums", "ids", "labels", "rows", "lists")
    strip = F.pmod(F.xxhash64(F.lit(9), "num"), F.lit(strips)).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: k * strips + strip)
    asked = anchors.select("*", F.explode(meets).alias("g"), F.lit(1).alias("kind"))
    stream = base.unionByName(asked, allowMissingColumns=True).repartition(min(4096, count * strips), "g").sortWithinPartitions("g", "kind")

    def passed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, held = None, -1
        for frame in frames:
            out: list[tuple[int, int, int, int]] = []
            for row in frame.itertuples(index=False):
                if row.kind == 0:
                    rows = np.frombuffer(row.rows, float).reshape(-1, width)
                    segment = Segment(*(np.frombuffer(x, np.int64) for x in (row.nums, row.ids, row.labels)), rows, np.frombuffer(row.lists, np.int32).reshape(width, -1))
                    held = row.g
                elif held == row.g:
                    out += answer(segment, row)
            yield pd.DataFrame(out, columns=["num", "place", "id", "score"])

    return stored(stream.mapInPandas(passed, "num long, place int, id long, score long"), "found")


def mine_negatives(
    df: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, segment: int = SEGMENT,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: a condition on ``key``; ``label``: the label of a row of ``df``.
    """
    mark = F.col("_label")
    named = df.select(F.col(key).alias(key), F.col(vector).alias("_vector"), label.alias("_label")).filter(mark.isNotNull())
    whole = dict(named.dtypes)["_label"] in ("tinyint", "smallint", "int", "bigint")
    named = named.withColumn("_label", mark.cast("long") if whole else F.xxhash64(mark))
    clean = quantised(named, key, "_vector", "_label")
    ready = stored(clean.select(F.monotonically_increasing_id().alias("num"), F.col(key).cast("long").alias("id"), mark.alias("label"), "x", is_anchor.alias("asks")), "labelled-vectors")
    facts = ready.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = facts["n"], int(facts["width"] or 1)
    if not n:
        long = F.lit(0).cast("long")
        return ready.select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(0).alias("rank"), F.col("id").alias("negative_id"), long.alias("positive_score"), long.alias("negative_score"))
    parts, count = segments(ready.select("num", "id", "label", "x"), n, width, segment)
    anchors = ready.filter("asks").select("num", "label", "x")

    def vector_of(row) -> np.ndarray:
        return _matrix([row.x], width)[0]

    def same_label(part: Segment, row) -> list[tuple[int, int, int, int]]:
        best = Best(-_FAR, _FAR, positives)
        search(part, vector_of(row), (part.labels == row.label) & (part.nums != row.num), [best])
        return [(int(row.num), 0, i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)]

    def other_label(part: Segment, row) -> list[tuple[int, int, int, int]]:
        windows = [Best(*window(int(s), low, high), negatives) for s in row.scores]
        search(part, vector_of(row), part.labels != row.label, windows)
        return [(int(row.num), k, i, s) for k, w in enumerate(windows) for i, s in zip(w.ids.tolist(), w.scores.tolist(), strict=True)]

    order = Window.partitionBy("num", "place").orderBy(F.desc("score"), "id")
    met = _found(parts, count, anchors.withColumn("scores", F.lit(None).cast("array<long>")), width, same_label)
    first = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    fits = lambda c: F.when(F.abs(c) < _FAR, c).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    first = stored(first.select("num", (F.col("rank") - 1).cast("int").alias("place"), F.col("id").alias("positive_id"), fits(F.col("score")).alias("positive_score")), "positives")
    scores = first.groupBy("num").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score")))["positive_score"].alias("scores"))
    met = _found(parts, count, anchors.join(scores, "num"), width, other_label)
    best = met.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives)
    out = best.join(first, ["num", "place"]).join(ready.select("num", F.col("id").alias("anchor_id")), "num")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", fits(F.col("score")).alias("negative_score"))
