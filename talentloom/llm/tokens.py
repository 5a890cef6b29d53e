"""Token ids in binary blocks: byte-aligned variable length, separate control bytes.

A block holds whole documents in key order. Its ids are replaced by their rank
in the block's own frequency order, so the commonest 256 take one data byte
and nearly all others two. Four ranks share one control byte, two bits each
for the number of data bytes less one; control and data bytes are kept apart,
so that numpy decodes a block with one table lookup for the lengths and one
gather for the bytes.

Blocks are rows of a Parquet table in key order, written by Spark's commit
protocol, so that retried or lost tasks leave no partial files.

Layout of a block, little-endian: magic ``TLB1``; uint32 number of ranks r,
of documents d, of ids n, of data bytes b; r uint32 ids in rank order; d
uint32 id counts; ceil(n / 4) control bytes; b data bytes.

Edge cases: null and empty texts give the end id alone; null keys sort first;
repeated keys keep one row each, in any order among themselves; an empty table
gives an empty table. Extra columns are not carried.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokenizing import Vocabulary, encoder

MAGIC = b"TLB1"
BLOCK_IDS = 1 << 20
ROWS_A_PARTITION = 4_000
#: A start takes about 24 bytes, so at most some 24 MB are broadcast.
BROADCAST_BLOCKS = 1_000_000


def pack_block(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """One block of the documents whose id counts are ``counts``."""
    freq = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(freq)
    order = used[np.argsort(-freq[used], kind="stable")].astype("<u4")
    rank = np.zeros(len(freq), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank[ids].astype("<u4")
    width = np.ones(len(ranks), np.uint8)
    for limit in (1 << 8, 1 << 16, 1 << 24):
        width += ranks >= limit
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = width - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < width[:, None]]
    head = struct.pack("<4sIIII", MAGIC, len(order), len(counts), len(ranks), len(data))
    return b"".join((head, order.tobytes(), counts.astype("<u4").tobytes(), control.tobytes(), data.tobytes()))


#: The four lengths that each control byte stands for.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids (uint32) and id counts of a block."""
    magic, r, d, n, b = struct.unpack_from("<4sIIII", block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = 20
    order = np.frombuffer(block, "<u4", r, at)
    counts = np.frombuffer(block, "<u4", d, at := at + 4 * r)
    control = np.frombuffer(block, np.uint8, -(-n // 4), at := at + 4 * d)
    data = np.frombuffer(block, np.uint8, b, at + len(control))
    width = _LENGTHS[control].reshape(-1)[:n]
    start = np.cumsum(width) - width
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    ranks = padded[start]
    for k in range(1, int(width.max(initial=1))):
        ranks |= np.where(width > k, padded[start + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return order[ranks] if r else np.zeros(0, np.uint32), counts


def write_token_blocks(df: DataFrame, vocabulary: Vocabulary, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, and store blocks in ascending ``key`` order.

    Returns the stored table: part int (order of partitions), block int (order
    within), keys array<long>, n_ids long, payload binary. The texts are dealt
    by ranges of the key (one shuffle), and encoded after that, so that no id
    is shuffled.
    """
    # The row's number parts equal or null keys, which else would all fall into one range.
    rows = df.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).withColumn("_n", F.monotonically_increasing_id())
    parts = max(1, -(-df.select(key).count() // ROWS_A_PARTITION))
    dealt = rows.repartitionByRange(parts, "_k", "_n").sortWithinPartitions("_k").select("_k", "_t")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        part, number = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        counts: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            payload = pack_block(np.concatenate(held), np.array(counts))
            return pa.RecordBatch.from_pydict({"part": [part], "block": [number], "keys": [keys], "n_ids": [size], "payload": [payload]}, schema=_BLOCKS)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                ids, each = encode(piece.column(1))
                stop = np.cumsum(each)
                for k, hi, n in zip(piece.column(0).to_pylist(), stop.tolist(), each.tolist(), strict=True):
                    held += [ids[hi - n : hi], np.array([end_id], np.uint32)]
                    keys.append(k)
                    counts.append(n + 1)
                    size += n + 1
                    if size >= BLOCK_IDS:
                        yield flush()
                        keys, held, counts, size, number = [], [], [], 0, number + 1
        if keys:
            yield flush()

    made = dealt.mapInArrow(blocks, "part int, block int, keys array<long>, n_ids long, payload binary")
    return stored(made, "token-blocks")


_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, block, base long: the ids before each block.

    Two levels, so that no task holds all blocks: running sums inside a part, and
    one window over the parts' sums (one row a partition of the writing job).
    """
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    whole = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    local = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within"))
    return local.join(whole, "part").select("part", "block", (F.col("before") + F.col("within")).alias("base"))


def read_token_digests(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode stored blocks: ``key``, start, n_tokens, ids_crc32 of each document."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = unpack_block(row["payload"])
                stop = np.cumsum(counts.astype(np.int64))
                start = stop - counts
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(start + row["base"]), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=[key, "start", "n_tokens", "ids_crc32"],
                )

    starts = block_starts(blocks)
    if blocks.select("part").count() <= BROADCAST_BLOCKS:  # else Spark's own choice of join
        starts = F.broadcast(starts)
    placed = blocks.select("part", "block", "keys", "payload").join(starts, ["part", "block"])
    return placed.select("keys", "payload", "base").mapInArrow(digests, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def read_token_ids(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode stored blocks to ``key`` and its ids (array<long>)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = unpack_block(row["payload"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), lists], names=[key, "ids"])

    return blocks.select("keys", "payload").mapInArrow(decoded, f"`{key}` long, ids array<long>")
