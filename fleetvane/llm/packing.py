"""Operator 10: hierarchical packing into sequences of several context sizes.

Each document goes to the smallest context size (tier) that holds it; of a longer one, whole windows of the largest size
are cut off and the rest is routed by its length. Documents of the shorter tiers wait in a bounded queue. A window that
the next document of its tier doesn't fit is closed by filling its gap: first with the longest waiting documents of
shorter tiers that fit, then with the head of the next document. Sequences therefore have exactly their tier's length,
a power of two, and are not padded; what is left at the end of a partition is put together, cut at tier lengths, and only
the last of it is padded. Sequences of a tier are numbered into step groups that hold equal numbers of tokens.

A partition is packed in one pass with a bounded state, and nothing is shuffled. A lost task repeats its own partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetvane.llm.common import raw_texts_of, slices
from fleetvane.llm.tokens import MOST_SPACED_BYTES, chunk_encoder, packed, tokenizer_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 1
TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group, and documents of a tier that may wait for gaps.
STEP_TOKENS, MOST_WAITING = 16_384, 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: A piece: (length, unique number, doc_id, start, ids, doc_tokens)
Piece = tuple[int, int, "int | None", int, np.ndarray, int]


class TierPacker:
    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, most_waiting: int = MOST_WAITING):
        self.tiers, self.step_tokens, self.most_waiting = tiers, step_tokens, most_waiting
        self.window = tiers[-1]
        self.first, self.number, self.sequences = partition << 32, count(), 0
        self.open: dict[int, list[Piece]] = {t: [] for t in tiers}
        self.filled = dict.fromkeys(tiers, 0)
        self.waiting: dict[int, list[Piece]] = {t: [] for t in tiers[:-1]}  # by length
        self.step_filled = dict.fromkeys(tiers, 0)
        self.step = {t: i for i, t in enumerate(tiers)}
        self.steps = len(tiers)
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self._close(self.window, [self._piece(doc_id, start, ids[start : start + self.window], total)])
            start += self.window
        if start < total:
            self._route(self._piece(doc_id, start, ids[start:], total))

    def _piece(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> Piece:
        return (len(ids), next(self.number), doc_id, start, ids, total)

    def _cut(self, piece: Piece, length: int) -> tuple[Piece, Piece]:
        _, _, doc_id, start, ids, total = piece
        return self._piece(doc_id, start, ids[:length], total), self._piece(doc_id, start + length, ids[length:], total)

    def _route(self, piece: Piece) -> None:
        tier = next(t for t in self.tiers if piece[0] <= t)
        if tier == self.window:
            self._put(tier, piece)
        else:
            insort(self.waiting[tier], piece, key=lambda p: p[:2])
            if len(self.waiting[tier]) > self.most_waiting:
                self._put(tier, self.waiting[tier].pop(len(self.waiting[tier]) // 2))

    def _put(self, tier: int, piece: Piece) -> None:
        """Into the tier's open sequence, whose gap is filled and which is closed if the piece is too long for it."""
        if piece[0] > tier - self.filled[tier]:
            self._fill_gap(tier)
            if gap := tier - self.filled[tier]:
                head, piece = self._cut(piece, min(gap, piece[0]))
                self._append(tier, head)
        if piece[0]:
            self._append(tier, piece)

    def _append(self, tier: int, piece: Piece) -> None:
        self.open[tier].append(piece)
        self.filled[tier] += piece[0]
        if self.filled[tier] == tier:
            self._close(tier, self.open[tier])
            self.open[tier], self.filled[tier] = [], 0

    def _fill_gap(self, tier: int) -> None:
        while gap := (tier - self.filled[tier]) % tier:
            for shorter in reversed([t for t in self.waiting if t < tier]):
                if at := bisect_right(self.waiting[shorter], gap, key=lambda p: p[0]):
                    self._append(tier, self.waiting[shorter].pop(at - 1))
                    break
            else:
                return

    def _close(self, tier: int, pieces: list[Piece]) -> None:
        sequence, offset = self.first + self.sequences, 0
        self.sequences += 1
        if self.step_filled[tier] + tier > self.step_tokens:
            self.step[tier], self.steps, self.step_filled[tier] = self.steps, self.steps + 1, 0
        self.step_filled[tier] += tier
        for length, _, doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, length, zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, sequence, offset, tier, self.first + self.step[tier]))
            offset += length

    def finish(self) -> None:
        """Fills the long windows' gaps from shorter tiers, packs the tiers, and puts the last open sequences together."""
        for tier in reversed(self.tiers):
            if self.filled[tier]:
                self._fill_gap(tier)
        for tier in reversed(self.tiers[:-1]):
            while self.waiting[tier]:
                self._put(tier, self.waiting[tier].pop())
        rest = [p for t in reversed(self.tiers) for p in self.open[t]]
        for tier in reversed(self.tiers):
            self.open[tier], self.filled[tier] = [], 0
        left = sum(p[0] for p in rest)
        for tier in reversed(self.tiers):
            while left >= tier:
                taken, need = [], tier
                while need:
                    piece = rest.pop(0)
                    if piece[0] > need:
                        piece, tail = self._cut(piece, need)
                        rest.insert(0, tail)
                    taken.append(piece)
                    need -= piece[0]
                self._close(tier, taken)
                left -= tier
        if rest:
            self._close(self.window, rest)

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 9
        self.out = []
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in PIECES.split(", ")])


def pack(docs: DataFrame, path: str | None = None, end_id: int | None = END_ID, tiers: tuple[int, ...] = TIERS, most_bytes: int = MOST_SPACED_BYTES) -> DataFrame:
    """One row per piece of a document; tier is the sequence's context size.

    A null or empty text has the end id alone. Null and repeated doc_ids are packed like any other; a document's pieces
    lie in one partition. Empty tables give no rows. Other columns of docs play no part. most_bytes is what a worker may
    remember of words; it changes the time taken, not the result.
    """
    path = path or tokenizer_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, packer = chunk_encoder(path, True, most_bytes), packed([] if end_id is None else [end_id]), TierPacker(TaskContext.get().partitionId(), tiers)
        for whole in batches:
            for batch in slices(whole, 256):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(raw_texts_of(batch, "text"), end), strict=True):
                    packer.add(doc_id, np.frombuffer(ids, "<u4"))
                yield packer.drain()
        packer.finish()
        yield packer.drain()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, PIECES)
