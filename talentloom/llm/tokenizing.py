"""Exact batch encoding with a public tokenizer inside Spark tasks.

The tokenizers library takes about ten microseconds for a word it meets first,
however often it has met it before. Words repeat, so each Python worker keeps
a memo ``chunk -> ids``, bounded in bytes: a batch is cut into chunks where no token can
reach across, Arrow finds the distinct chunks, the library encodes those that
the memo lacks, and numpy lays out the ids of the batch. Long chunks (scripts without
blanks, tables, encoded data) are encoded anew each time and not kept.

Where tokens stand for bytes one to one (byte BPE), the library need not say to which
chunk a token belongs: the tokens' lengths in bytes tell. That spares its record of
places, about 40 % of its time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Bytes that a worker's memo holds, counting ``ENTRY`` for an entry beside its chunk and ids; the longest chunk that it keeps.
MEMO_BYTES, ENTRY, KEPT = 128 << 20, 200, 64
SLICE_BYTES = 4 << 20
_encoders: dict[tuple[str, bool], Encoder] = {}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file and how its texts may be cut.

    ``path``: file in the JSON format of the tokenizers library. ``drops_case``:
    the tokenizer lower-cases and drops white space (word BPE); otherwise white
    space belongs to the following word (byte BPE). ``memo_bytes``: what a worker
    may hold of chunks and their ids.
    """

    path: str
    drops_case: bool
    memo_bytes: int = MEMO_BYTES


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder for ``vocabulary``, made once in a worker."""
    key = (vocabulary.path, vocabulary.drops_case)  # one memo a tokenizer
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a new chunk may start, as a mask over the bytes.

    Before a space or line feed that follows a visible ASCII character or any
    other that is not white space, and between a letter and a full stop or
    comma, ASCII or ideographic: no pattern of either tokenizer spans or looks
    across these places.
    """
    before, here = data[:-1], data[1:]
    space = (here == 0x20) | (here == 0x0A)
    visible = (before > 0x20) & (before < 0x7F)
    latin = np.zeros(len(before), bool)
    latin[1:] = (before[1:] >= 0x80) & (data[:-2] == 0xC3)
    letter = ((before | 0x20) >= 0x61) & ((before | 0x20) <= 0x7A)
    cut = np.zeros(len(data), bool)
    cut[1:] = (space & (visible | latin)) | (letter & ((here == 0x2C) | (here == 0x2E)))
    if data.max(initial=0) > 0xC3:
        cut |= _further_cuts(data)
    return cut


def _further_cuts(data: np.ndarray) -> np.ndarray:
    """The same beyond ASCII and Latin-1, told by the first byte of the character before."""
    cut = np.zeros(len(data), bool)
    at = np.flatnonzero((data[1:] == 0x20) | (data[1:] == 0x0A)) + 1
    at = at[data[at - 1] >= 0x80]
    one, two, three, four = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3, 4))
    # White space beyond ASCII begins with C2, E1 9A, E2 80, E2 81 or is E3 80 80.
    fine = (two >= 0xC3) & (two <= 0xDF) | (three >= 0xE0) & (three != 0xE1) & (three != 0xE2) & ~((three == 0xE3) & (two == 0x80) & (one == 0x80)) | (four >= 0xF0)
    cut[at[fine]] = True
    # Ideographic full stop and comma after an ideograph (E4 to E9).
    at = np.flatnonzero((data[3:-2] == 0xE3) & (data[4:-1] == 0x80) & ((data[5:] == 0x81) | (data[5:] == 0x82))) + 3
    cut[at[(data[at - 3] >= 0xE4) & (data[at - 3] <= 0xE9)]] = True
    return cut


def _bytes_of(column: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls; ``to_pylist`` takes five times as long."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    body = column.buffers()[2].to_pybytes()
    return [body[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals in lower case, unless a combining mark may follow."""
    plain = np.ones(len(data), bool)
    plain[:-1] = (data[1:] < 0x80) | (data[1:] == 0xC3)
    capital = (data >= 0x41) & (data <= 0x5A) & plain
    return np.where(capital, data | 0x20, data).astype(np.uint8)


def _widths(tokenizer: Tokenizer) -> np.ndarray | None:
    """Bytes that each id of a byte-level tokenizer stands for; None for other tokenizers.

    There a character of a token is one byte, and every byte of a text is in a token.
    """
    settings = json.loads(tokenizer.to_str())
    if (settings["pre_tokenizer"] or {}).get("type") != "ByteLevel" or settings["pre_tokenizer"]["add_prefix_space"] or settings["normalizer"]:
        return None
    out = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out


class Encoder:
    """Encodes batches of texts; ids come as one flat uint32 array."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        self.drops_case = vocabulary.drops_case
        self.memo_bytes = vocabulary.memo_bytes
        # Added tokens match before letters are lowered, in their own case only.
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.widths = None if self.drops_case else _widths(self.tokenizer)
        # Two generations: what is met again moves to the young one, and the old
        # one goes when the young one is full, so common chunks stay.
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the young one

    def _lowered(self, data: np.ndarray) -> np.ndarray:
        """Lowered text, but what differs from an added token by case alone stays as it is."""
        out = _lowered(data)
        folded = data.tobytes().lower()
        for token in self.added:
            at = folded.find(token)
            while at >= 0:
                out[at : at + len(token)] = data[at : at + len(token)]
                at = folded.find(token, at + 1)
        return out

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new chunks."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            ids, edges = self._by_width(part) or self._by_word(part)
            flat, ends = ids.tobytes(), (edges * 4).tolist()
            out.update(zip(part, [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))
        return out

    def _by_word(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and where each chunk's begin and the last one's end, as the library tells."""
        done = self.tokenizer.encode([c.decode() for c in chunks], is_pretokenized=True, add_special_tokens=False)
        return np.asarray(done.ids, "<u4"), np.searchsorted(np.asarray(done.word_ids, np.int64), np.arange(len(chunks) + 1))

    def _by_width(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same by the tokens' widths; None where they do not add up to the chunks."""
        if self.widths is None:
            return None
        done = self.tokenizer.encode_batch_fast([[c.decode() for c in chunks]], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.asarray(done.ids, "<u4")
        reach = np.concatenate(([0], np.cumsum(self.widths[ids])))
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))))
        edges = np.searchsorted(reach, ends)
        return (ids, edges) if reach[-1] == ends[-1] and (reach[edges] == ends).all() else None

    def _keep(self, chunk: bytes, ids: bytes) -> None:
        self.memo[chunk] = ids
        self.held += len(chunk) + len(ids) + ENTRY

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text.

        Nulls count as empty texts.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        counts, ids = [], []
        sizes = np.asarray(pa.compute.binary_length(texts))
        group = np.cumsum(sizes) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                flat, count = self._slice(texts.slice(lo, hi - lo), sizes[lo:hi])
                ids.append(flat)
                counts.append(count)
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _slice(self, texts: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if len(texts) else 0
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first : first + ends[-1]]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        if self.drops_case:
            data = self._lowered(data)
        cut = _cuts(data)
        starts = ends - sizes
        cut[starts[sizes > 0]] = True
        begin = np.flatnonzero(cut)
        offsets = np.append(begin, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        distinct = _bytes_of(coded.dictionary)
        if self.held > self.memo_bytes // 2:
            self.memo, self.old, self.held = {}, self.memo, 0
        found = list(map(self.memo.get, distinct))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        missing = []
        for i in lacking:
            known = self.old.get(distinct[i])
            if known is None:
                missing.append(i)
            else:
                found[i] = known
                self._keep(distinct[i], known)
        new = self._learn([distinct[i] for i in missing])
        for i in missing:
            c = distinct[i]
            found[i] = new[c]
            if len(c) <= KEPT:
                self._keep(c, new[c])
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        source = np.frombuffer(b"".join(found), "<u4")
        place = np.cumsum(length) - length
        code = np.asarray(coded.indices)
        each = length[code]
        total = np.cumsum(each)
        shift = np.repeat(place[code] - (total - each), each)
        shift += np.arange(len(shift))
        until = np.searchsorted(begin, ends)
        total = np.concatenate(([0], total))
        counts = total[until] - total[np.searchsorted(begin, starts)]
        return source[shift], counts
