"""Repeated passages by longest-previous-factor arrays over shared anchors.

A passage of ``length`` bytes that occurs twice has the same smallest anchor
(hash of 32 bytes) in both places. One scan cuts every text into clusters: runs of
window starts with the same leftmost smallest anchor. Anchors only say which texts
must meet; an anchor seen once cannot repeat and is dropped. Equal clusters (by
128-bit digest) are one kind with a number of places, so copies of texts end
there. Of anchors with several kinds, the bytes of one representative each travel to
a task. It sorts the windows' suffixes by prefix doubling, takes the common
prefixes of neighbours, and finds for each window the previous and next ones in
suffix order that stand earlier in (row, place) order. The longer of the two common
prefixes is the window's longest previous factor: from ``length`` on the window is
a later copy, and the place that it points to is an earlier one.

Kinds of one anchor that would be too many for a task (a passage in very many
texts) are cut at fixed distances from the anchor, and the pieces meet by the
bytes that all their windows share: first in steps of ``STEP`` windows, then window
by window. Equal pieces again are one kind with a number of places, so such
anchors end in small groups too, which the same arrays decide.

Matches are judged on the input and never cross texts. ``keep`` "none" removes
every occurrence; "first" keeps the first one in (row, place) order.

Edge cases: null is an empty text; texts shorter than ``length`` lose nothing;
repeated rows are copies of each other; null or repeated keys are allowed (rows
get numbers of their own then); an empty table gives an empty result; extra
columns are not carried. In the text of what is left, code points that a removal
cut are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

LENGTH = 400
ANCHOR = 32
#: Kinds of one anchor that a task gathers: about a MB at most. More are cut.
HOT = 1024
STEP = 16
SLICE_BYTES = 2 << 20
#: Fixed values of the rolling hash: an odd base and the seed of its byte table.
BASE, SEED = 0x5851F42D4C957F2D, 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_rows(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept in the worker."""
    if len(_powers[0]) < n:
        n = max(n, 2 * SLICE_BYTES)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(n, b, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch of ``data`` follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bytes_table()[data] * _power_rows(len(data))[1][: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (sums[stop] - sums[start]) * _power_rows(len(sums))[0][start]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step, now = 1, values
    while step * 2 <= width:
        now = np.minimum(now[:-step], now[step:])
        step *= 2
    n = len(values) - width + 1
    return np.minimum(now[:n], now[width - step : width - step + n])


def clusters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchor, first and last window start of each cluster of the texts in ``data``."""
    none = np.zeros(0, np.int64)
    fits = ends - starts >= length
    if not fits.any():
        return none.astype(np.uint64), none, none
    sums = prefix_hashes(data)
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = _mixed(stretch_hashes(sums, at, at + ANCHOR))
    lowest = _sliding_min(hashes, length - ANCHOR + 1)
    edge = np.zeros(len(lowest) + 1, np.int32)
    edge[starts[fits]] += 1
    np.subtract.at(edge, ends[fits] - length + 1, 1)
    inside = np.cumsum(edge)[:-1] > 0
    change = np.ones(len(lowest), bool)
    # A window that starts with its anchor is the last one of that anchor; the
    # next may have an equal one further on (texts that repeat themselves).
    change[1:] = (lowest[1:] != lowest[:-1]) | (hashes[: len(lowest) - 1] == lowest[:-1])
    change[starts[fits]] = True
    first = np.flatnonzero(change & inside)
    stops = np.append(np.flatnonzero(change | ~inside), len(lowest))
    last = stops[np.searchsorted(stops, first, side="right")] - 1
    return lowest[first], first, last


def digests(pieces: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each piece, as two signed numbers."""
    blake = hashlib.blake2b
    joined = b"".join([blake(x, digest_size=16).digest() for x in pieces])
    return tuple(np.frombuffer(joined, "<i8").reshape(-1, 2).T)


def _starts(keys: np.ndarray) -> np.ndarray:
    """For sorted keys: where the run of equal ones that holds each begins."""
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))


def _refined(order: np.ndarray, ranks: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort once more by ``second`` what still has equal ``ranks``; both per element of ``order``."""
    held = ranks[order]
    tied = np.zeros(len(order), bool)
    tied[1:] = held[1:] == held[:-1]
    tied[:-1] |= tied[1:]
    slots = np.flatnonzero(tied)
    order, ranks = order.copy(), ranks.copy()
    if len(slots):
        who = order[slots]
        key = ranks[who] * (int(second.max()) + 1) + second[who]
        turn = np.argsort(key, kind="stable")
        order[slots] = who = who[turn]
        ranks[who] = slots[_starts(key[turn])]
    return order, ranks


def prefix_ranks(data: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, 32, ... (at most ``length``) bytes, by prefix doubling."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    ranks = np.empty(n, np.int64)
    ranks[order] = _starts(key[order])
    out, size = {8: ranks}, 8
    while size * 2 <= length:
        order, ranks = _refined(order, ranks, np.concatenate((ranks[size:] + 1, np.zeros(min(size, n), np.int64))))
        size *= 2
        out[size] = ranks
    return out


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``at`` in the order of their first ``length`` bytes, and the common prefix of each with the one before.

    Every suffix has ``length`` (16 or more) bytes; longer common prefixes count as ``length``.
    """
    ranks = prefix_ranks(data, length)
    sizes = sorted(ranks, reverse=True)
    own = ranks[sizes[0]][at]
    order = np.argsort(own, kind="stable")
    done = sizes[0]
    while done < length:  # stretches may overlap
        size = next(x for x in sizes if x <= max(8, length - done))
        done = min(done, length - size)
        order, own = _refined(order, own, ranks[size][at + done])
        done += size
    a, b = at[order[:-1]], at[order[1:]]
    common = np.zeros(len(a), np.int64)
    for size in sizes:
        fits = np.flatnonzero(common + size <= length)
        common[fits] += size * (ranks[size][a[fits] + common[fits]] == ranks[size][b[fits] + common[fits]])
    for _ in range(7):
        more = np.flatnonzero(common < length)
        common[more] += data[a[more] + common[more]] == data[b[more] + common[more]]
    return order, np.concatenate((np.zeros(min(1, len(at)), np.int64), common))


def previous_smaller(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the nearest one before it with a smaller place (-1: none), and the common prefix with it.

    All elements jump at once over those with larger places that others have passed.
    """
    to, low = np.arange(-1, len(place) - 1), common.copy()
    going = np.flatnonzero(to >= 0)
    going = going[place[to[going]] > place[going]]
    while len(going):
        over = to[going]
        low[going] = np.minimum(low[going], low[over])
        to[going] = to[over]
        going = going[to[going] >= 0]
        going = going[place[to[going]] > place[going]]
    low[to < 0] = 0
    return to, low


def longest_previous_factors(data: np.ndarray, at: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix at ``at``, how many bytes (``length`` at most) also start at a suffix of smaller ``place``, and which suffix that is (-1: none)."""
    order, common = suffix_order(data, at, length)
    spot = place[order]
    before, left = previous_smaller(spot, common)
    # The next smaller ones are the previous smaller ones from the other end.
    after, right = previous_smaller(spot[::-1], np.concatenate((np.zeros(min(1, len(at)), np.int64), common[1:][::-1])))
    after, right = np.where(after < 0, -1, len(order) - 1 - after)[::-1], right[::-1]
    longest, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
    longest[order] = np.maximum(left, right)
    nearest = np.where(left >= right, before, after)
    source[order] = np.where(nearest >= 0, order[nearest], -1)
    return longest, source


def _runs(flags: np.ndarray) -> list[list[int]]:
    """[first, last] of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [[int(a), int(b) - 1] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: index of the first text, bytes, offsets."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _scan(rows: DataFrame, length: int) -> DataFrame:
    """_row, m (anchor), c, d (digest), a, b (window starts) of every cluster."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, data, offsets in _texts(batch.column(1)):
                m, first, last = clusters(data, offsets[:-1], offsets[1:], length)
                whole = data.tobytes()
                c, d = digests(whole[x:y] for x, y in zip(first.tolist(), (last + length).tolist(), strict=True))
                owner = np.searchsorted(offsets, first, side="right") - 1
                base = offsets[owner]
                columns = [ids[lo + owner], m.view(np.int64), c, d, (first - base).astype(np.int32), (last - base).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["_row", "m", "c", "d", "a", "b"])

    return rows.select("_row", "_text").mapInArrow(scanned, "_row long, m long, c long, d long, a int, b int")


_PIECE = "m long, c long, d long, row long, a int, bytes binary"
_PIECES = pa.schema([("m", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("row", pa.int64()), ("a", pa.int32()), ("bytes", pa.binary())])


def _excerpts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """m, c, d, row, a, bytes of the clusters in ``wanted``: _row, cuts array<struct<m, c, d, a, b>>."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: dict[str, list] = {k: [] for k in _PIECES.names}
                for row, text, cuts in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    body = text.encode()
                    for x in cuts:
                        for name, value in zip(out, (x["m"], x["c"], x["d"], row, x["a"], body[x["a"] : x["b"] + length]), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    return rows.select("_row", "_text").join(wanted, "_row").select("_row", "_text", "cuts").mapInArrow(cut, _PIECE)


def _gathered(pieces: DataFrame, length: int) -> DataFrame:
    """m, c, d, runs, firsts of pieces whose groups ``m`` fit a task, by longest previous factors."""

    def solved(group: pd.DataFrame) -> pd.DataFrame:
        pieces = group["bytes"].tolist()
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        base = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(pieces)), windows)
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        order = np.lexsort((group["a"].to_numpy(), group["row"].to_numpy()))
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order))  # representatives in (row, place) order
        longest, source = longest_previous_factors(data, base[owner] + inner, nth[owner] * (1 << 32) + inner, length)
        earlier = longest >= length
        found = earlier.copy()
        found[source[earlier]] = True
        stop = np.cumsum(windows)
        spans = list(zip((stop - windows).tolist(), stop.tolist(), strict=True))
        out = group[["m", "c", "d"]].reset_index(drop=True)
        return out.assign(runs=[_runs(found[a:b]) for a, b in spans], firsts=[_runs(~earlier[a:b]) for a, b in spans])

    def all_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups at a time, about SLICE_BYTES together: windows of different anchors never match."""
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            heads = np.flatnonzero(np.concatenate(([True], frame["m"].to_numpy()[1:] != frame["m"].to_numpy()[:-1])))
            volume = np.cumsum([len(b) for b in frame["bytes"]])
            lo = 0
            for head in heads[1:].tolist():
                if volume[head - 1] - (volume[lo - 1] if lo else 0) >= SLICE_BYTES:
                    yield solved(frame.iloc[lo:head])
                    lo = head
            if heads[-1] > lo:
                yield solved(frame.iloc[lo : heads[-1]])
            rest = frame.iloc[heads[-1] :]
        if rest is not None:
            yield solved(rest)

    return pieces.repartition("m").sortWithinPartitions("m", "c", "d").mapInPandas(all_groups, "m long, c long, d long, runs array<array<int>>, firsts array<array<int>>")


def _cut(pieces: DataFrame, length: int, step: int) -> DataFrame:
    """The pieces in steps of ``step`` windows at fixed distances from the anchor: m, c, d of the whole, lo (first window), and part struct of its own.

    Equal windows stand at one distance from their anchors, and a step's windows all
    hold its core; so equal windows have one core, whose hash is the part's m.
    """

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {k: [] for k in ("m", "c", "d", "lo", "pm", "row", "a", "bytes")}
            for m, c, d, row, a, body in zip(*(frame[k].tolist() for k in ("m", "c", "d", "row", "a", "bytes")), strict=True):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(length - ANCHOR + 1)
                anchor = int(_mixed(stretch_hashes(prefix_hashes(data[:length]), at, at + ANCHOR)).argmin())
                windows, lo = len(body) - length + 1, 0
                while lo < windows:
                    block = (anchor - lo) // step  # distances block * step up to (block + 1) * step - 1
                    hi = min(windows, anchor - block * step + 1)
                    core = body[max(0, anchor - block * step) : anchor - (block + 1) * step + 1 + length]
                    mark = xxhash.xxh3_64_intdigest(b"%d %d " % (m, block) + core)
                    for name, value in zip(out, (m, c, d, lo, mark - (mark >> 63 << 64), row, a + lo, body[lo : hi + length - 1]), strict=True):
                        out[name].append(value)
                    lo = hi
            out["pc"], out["pd"] = digests(out["bytes"])
            yield pd.DataFrame(out)

    schema = "m long, c long, d long, lo int, pm long, row long, a int, bytes binary, pc long, pd long"
    return pieces.mapInPandas(parts, schema)


def _solved(pieces: DataFrame, length: int, steps: tuple[int, ...]) -> DataFrame:
    """m, c, d, runs and firsts (windows, counted from the piece's start) of distinct pieces that are one place each."""
    if not steps:
        return _gathered(pieces, length)
    kinds = pieces.groupBy("m").agg(F.count("*").alias("kinds"))
    hot = stored(kinds.filter(F.col("kinds") > HOT).select("m"), "hot-anchors")
    if not hot.head(1):
        return _gathered(pieces, length)
    cold = _gathered(pieces.join(hot, "m", "left_anti"), length)
    parts = stored(_cut(pieces.join(hot, "m", "left_semi"), length, steps[0]), "parts")
    same = parts.groupBy("pm", "pc", "pd").agg(F.count("*").alias("n"), F.min(F.struct("row", "a")).alias("rep"), F.min_by("bytes", F.struct("row", "a")).alias("bytes"))
    same = stored(same, "part-kinds")
    met = same.groupBy("pm").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("pm")
    next_ones = same.join(met, "pm").select(F.col("pm").alias("m"), F.col("pc").alias("c"), F.col("pd").alias("d"), "rep.row", "rep.a", "bytes")
    deeper = _solved(stored(next_ones, "parts-that-meet"), length, steps[1:])
    deeper = deeper.select(F.col("m").alias("pm"), F.col("c").alias("pc"), F.col("d").alias("pd"), "runs", "firsts")
    known = stored(same.select("pm", "pc", "pd", "n", "rep").join(deeper, ["pm", "pc", "pd"], "left"), "known-parts")
    whole = F.array(F.array(F.lit(0), F.length("bytes") - length))
    none = F.array().cast("array<array<int>>")
    own = F.struct("row", "a") == F.col("rep")
    placed = parts.join(known, ["pm", "pc", "pd"]).select(
        "m", "c", "d", "lo",
        F.when(F.col("n") > 1, whole).otherwise(F.coalesce("runs", none)).alias("runs"),
        F.when(own, F.coalesce("firsts", whole)).otherwise(none).alias("firsts"),
    )
    shifted = lambda name: F.flatten(F.transform("all", lambda x: F.transform(x[name], lambda r: F.transform(r, lambda i: i + x["lo"]))))
    whole_pieces = placed.groupBy("m", "c", "d").agg(F.collect_list(F.struct("lo", "runs", "firsts")).alias("all"))
    return cold.unionByName(whole_pieces.select("m", "c", "d", shifted("runs").alias("runs"), shifted("firsts").alias("firsts")))


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "none") -> DataFrame:
    """_row, ``key``, _text and spans array<struct<a, drop, spare>> (windows to remove and to spare) of every row."""
    rows = numbered(df.select(F.col(key), F.col(text).alias("_text")), key)
    marks = stored(_scan(rows, length), "clusters")
    kinds = stored(marks.groupBy("m", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("_row", "a", "b")).alias("rep")), "cluster-kinds")
    anchors = kinds.groupBy("m").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    live = stored(kinds.join(anchors.filter("total > 1"), "m"), "live-clusters")
    several = live.filter("kinds > 1").select("rep._row", F.struct("m", "c", "d", "rep.a", "rep.b").alias("x"))
    excerpts = stored(_excerpts(rows, several.groupBy("_row").agg(F.collect_list("x").alias("cuts")), length), "excerpts")
    solved = stored(_solved(excerpts, length, (STEP, 1)), "solved-clusters")
    known = live.join(solved, ["m", "c", "d"], "left").select("m", "c", "d", "n", "rep", "runs", "firsts")
    # Stored, so that both sides of the next join come from a shuffle and Spark
    # can split a cluster that very many rows share.
    known = stored(known.filter((F.col("n") > 1) | (F.size("runs") > 0)), "known-clusters")
    whole = F.array(F.array(F.lit(0), F.col("b") - F.col("a")))
    placed = marks.join(known, ["m", "c", "d"])
    drop = F.when(F.col("n") > 1, whole).otherwise(F.col("runs"))
    spare = F.when(F.struct("_row", "a", "b") == F.col("rep"), F.coalesce("firsts", whole))
    found = placed.select("_row", F.col("a"), drop.alias("drop"), (spare if keep == "first" else F.lit(None).cast("array<array<int>>")).alias("spare"))
    spans = found.groupBy("_row").agg(F.collect_list(F.struct("a", "drop", "spare")).alias("spans"))
    return rows.join(spans, "_row", "left")


def removed_mask(size: int, spans: list[dict], length: int) -> np.ndarray:
    """Which bytes of a text of ``size`` bytes go."""
    windows = np.zeros(size, bool)
    for s in spans or ():
        part = np.zeros(size, bool) if s["spare"] else windows
        for lo, hi in s["drop"]:
            part[s["a"] + lo : s["a"] + hi + 1] = True
        if s["spare"]:
            for lo, hi in s["spare"]:
                part[s["a"] + lo : s["a"] + hi + 1] = False
            windows |= part
    edge = np.zeros(size + length, np.int32)
    at = np.flatnonzero(windows)
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge)[:size] > 0


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "none") -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), kept_text of every row."""
    found = repeated_passages(df, key, text, length, keep)
    kind = df.schema[key].dataType.simpleString()

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")}
                for value, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    body = (value or "").encode()
                    rest, gone, runs = body, 0, 0
                    if spans:
                        mask = removed_mask(len(body), spans, length)
                        rest = np.frombuffer(body, np.uint8)[~mask].tobytes()
                        gone, runs = int(mask.sum()), len(_runs(mask))
                    for name, x in zip(out, (len(body), gone, runs, hashlib.sha256(rest).hexdigest(), rest, rest.decode(errors="ignore")), strict=True):
                        out[name].append(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
                columns = [part.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *out])

    return found.select(key, "_text", "spans").mapInArrow(
        cleaned, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string"
    )
