"""Best-fit packing of documents into training sequences of a fixed length.

Documents are tokenized where they are read; only longer ones are cut. What
has to be packed is then one small row a piece (key, piece, start, length, checksum),
dealt by a hash into partitions of about fifty thousand pieces. Each
partition runs bounded-space online best fit in hash order: a fixed number of
open bins, found through a bitset keyed by free space (the lowest set bit at or
above a length is the best fit). When one more bin would have to be opened,
the fullest open bin closes. Memory of a task: its open bins and one batch.

Edge cases: null and empty texts give the end id alone; repeated rows are
packed each; an empty table gives an empty result; extra columns are not
carried. Ties of fit go to the bin that was opened last; any choice is valid.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokenizing import Vocabulary, encoder

SEQUENCE = 4096
OPEN_BINS = 4_096
PIECES_A_PARTITION = 50_000


def token_pieces(df: DataFrame, vocabulary: Vocabulary, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE) -> DataFrame:
    """``key``, piece int, start long, length long, ids_crc32 long of each piece."""
    schema = pa.schema([(key, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, counts = encode(part.column(1))
                raw = ids.astype("<u4").tobytes()
                stops = np.cumsum(counts).tolist()
                out: dict[str, list] = {name: [] for name in schema.names}
                for k, n, stop in zip(part.column(0).to_pylist(), counts.tolist(), stops, strict=True):
                    own = raw[4 * (stop - n) : 4 * stop] + tail
                    for number, lo in enumerate(range(0, n + 1, capacity)):
                        hi = min(lo + capacity, n + 1)
                        for name, value in zip(schema.names, (k, number, lo, hi - lo, zlib.crc32(own[4 * lo : 4 * hi])), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).alias("_t"))
    return rows.mapInArrow(pieces, f"`{key}` long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins of one partition, at most ``open_bins`` at a time."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits = 0  # bit f is set while some open bin has free space f
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece, and its offset there."""
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            if self.open > self.limit:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
        else:
            self.open -= 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return number


def pack_pieces(pieces: DataFrame, key: str = "doc_id", capacity: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id long and offset long to every piece.

    ``pieces`` should be a stored table: it is counted, then read once more.
    A sequence id is the partition's number in the upper bits and the bin's
    number in the lower ones.
    """
    parts = max(1, -(-pieces.count() // PIECES_A_PARTITION))
    names = pieces.columns
    dealt = (
        pieces.withColumn("_n", F.monotonically_increasing_id())  # parts equal or null keys
        .withColumn("_h", F.xxhash64(F.col(f"`{key}`"), "piece", "_n"))
        .repartition(parts, "_h")
        .sortWithinPartitions("_h", F.col(f"`{key}`"), "piece")
    )

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for frame in frames:
            spots = [bins.place(n) for n in frame["length"].tolist()]
            frame = frame[names]
            yield frame.assign(sequence_id=[base + b for b, _ in spots], offset=[o for _, o in spots])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.mapInPandas(placed, schema)


def pack_documents(df: DataFrame, vocabulary: Vocabulary, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack_pieces(stored(token_pieces(df, vocabulary, end_id, key, text, capacity), "pieces"), key, capacity)
