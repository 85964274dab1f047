"""Operator 12: best-fit packing by exact complements.

Only how many pieces there are of each length matters for a plan, and lengths are bounded by the capacity, so the plan is
made from counts (4096 numbers), not from documents. Going down from the longest length, a sequence is opened, and its gap
is filled by a single length that is just as long; then the same with pairs, then with triples, where the longest lengths
that fit go in first if the gap is too wide for a triple. Sums of singles and pairs are indexed by how many available
lengths make them, and a combination is taken as often as its counts allow. What no exact filling is left for is packed
best-fit, the longest first.

The plan is a bounded list of runs: "the pieces numbered lo to hi of this length go, so many a sequence, to sequences from
s on". Pieces are numbered within their length by prefix sums over the tasks that made them, and find their run by binary
search. So nothing is grouped by length, and a length that most pieces share is dealt like any other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.llm.common import raw_texts_of, slices, written
from fleetvane.llm.tokens import chunk_encoder, packed, tokenizer_path

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, number long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Complements:
    """Available lengths, with an index of the sums that pairs of them make."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()  # by length; place 0 is not used
        self.pairs = np.zeros(2 * len(counts), np.int64)  # by sum, how many pairs of available lengths a <= b make it
        for length in np.flatnonzero(self.left):
            self._index(int(length), 1, self.left[: length + 1] > 0)

    def _index(self, length: int, sign: int, others: np.ndarray) -> None:
        at = np.flatnonzero(others)
        if self.left[length] < 2 and sign > 0:
            at = at[at != length]
        self.pairs[at + length] += sign

    def take(self, lengths: dict[int, int], times: int) -> None:
        for length, n in lengths.items():
            before = int(self.left[length])
            after = before - n * times
            if before >= 2 and after < 2:
                self.pairs[2 * length] -= 1
            if after == 0:
                others = self.left > 0
                others[length] = False
                self._index(length, -1, others)
            self.left[length] = after

    def longest(self, most: int) -> int:
        """The longest available length up to most, or 0."""
        at = np.flatnonzero(self.left[: most + 1])
        return int(at[-1]) if len(at) else 0

    def pair(self, total: int, least: int = 1) -> tuple[int, int] | None:
        """Available a >= b with a + b = total, a as large as can be; lengths in use elsewhere are up to the caller."""
        if total < 2 or self.pairs[total] <= 0:
            return None
        a = np.arange(-(-total // 2), min(total, len(self.left)))
        fine = a[(self.left[a] > 0) & (self.left[total - a] > 0) & ((2 * a != total) | (self.left[a] > 1))]
        return (int(fine[-1]), total - int(fine[-1])) if len(fine) else None

    def exact(self, gap: int, most: int) -> tuple[int, ...] | None:
        """Up to so many available lengths, three at most, that add up to gap."""
        if gap < len(self.left) and self.left[gap] > 0:
            return (gap,)
        if most > 1 and (two := self.pair(gap)):
            return two
        if most > 2:
            a = np.flatnonzero(self.left[: min(gap - 1, len(self.left))] > 0)
            for first in a[self.pairs[gap - a] > 0][::-1].tolist():
                self.left[first] -= 1
                two = self.pair(gap - first)
                self.left[first] += 1
                if two:
                    return (first, *two)
        return None


def _fits(left: np.ndarray, lengths: dict[int, int]) -> bool:
    return all(left[length] >= n for length, n in lengths.items())


def _exactly(c: Complements, length: int, capacity: int, most: int) -> dict[int, int] | None:
    """Lengths, and how many of each, of a sequence that this length opens and that is exactly full; None if there is none."""
    chosen, gap, held = {length: 1}, capacity - length, c.left
    c.left = held.copy()
    c.left[length] -= 1
    while gap and not (more := c.exact(gap, most)):
        longest = c.longest(gap) if most > 2 else 0
        if not longest:
            break
        n = int(min(c.left[longest], max(1, gap // longest - 4)))
        chosen[longest] = chosen.get(longest, 0) + n
        c.left[longest] -= n
        gap -= n * longest
    else:
        for m in more if gap else ():
            chosen[m] = chosen.get(m, 0) + 1
        gap = 0
    c.left = held
    return chosen if gap == 0 and _fits(held, chosen) else None


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit of what is left, the longest first, in runs of equal lengths over runs of equal sequences.

    Open sequences are kept by their gap: how many there are, and what is in them.
    """
    opened: dict[int, list[tuple[int, dict[int, int]]]] = {}
    gaps: list[int] = []

    def put(gap: int, times: int, chosen: dict[int, int]) -> None:
        if gap not in opened:
            opened[gap] = []
            insort(gaps, gap)
        opened[gap].append((times, chosen))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            gap = gaps[at] if at < len(gaps) else capacity
            each = gap // length
            if at == len(gaps):
                times, chosen = max(n // each, 1), {}
            else:
                times, chosen = opened[gap].pop()
                if not opened[gap]:
                    del opened[gap], gaps[at]
            full = min(times, n // each)
            if full:
                put(gap - each * length, full, {**chosen, length: each})
            if full < times:
                rest = min(n - full * each, each)
                if rest:
                    put(gap - rest * length, 1, {**chosen, length: rest})
                if (unused := times - full - (rest > 0)) and chosen:
                    put(gap, unused, chosen)
                n -= rest
            n -= full * each
    return [x for of_gap in opened.values() for x in of_gap]


def _planned(counts: np.ndarray, capacity: int, deepest: int, shortest: int) -> list[tuple[int, dict[int, int]]]:
    """Exact fillings of up to so many lengths for sequences that a length over shortest opens, then best-fit."""
    out, c = [], Complements(counts)
    for most in range(1, deepest + 1):
        for length in range(capacity, shortest, -1):
            while c.left[length] > 0 and (chosen := _exactly(c, length, capacity, most)):
                times = int(min(c.left[n] // k for n, k in chosen.items()))
                c.take(chosen, times)
                out.append((times, chosen))
    return out + _best_fit(c.left, capacity)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number a sequence}) that use up counts, an array by length up to capacity.

    Which combinations use up lengths that other gaps would need depends on the counts, so singles, pairs and triples are
    tried for all lengths and for the longer half, and the plan with the fewest sequences is taken.
    """
    return min((_planned(counts, capacity, deepest, shortest) for deepest in (3, 2, 1) for shortest in (0, capacity // 2)), key=lambda p: sum(times for times, _ in p))


def runs(planned: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, how many a sequence, first sequence, offset), ordered by length and number."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, chosen in planned:
        offset = 0
        for length, n in chosen.items():
            out.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return sorted(out)


def pieces(docs: DataFrame, path: str, end_id: int | None = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document, with the task that made them (part) and their number among its pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = chunk_encoder(path, False), packed([] if end_id is None else [end_id]), TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64).tolist()
        for whole in batches:
            for batch in slices(whole, 256):
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(raw_texts_of(batch, "text"), end), strict=True):
                    for at in range(0, len(ids), 4 * capacity):
                        cut = ids[at : at + 4 * capacity]
                        length = len(cut) // 4
                        rows.append((doc_id, at // (4 * capacity), at // 4, length, zlib.crc32(cut), part, made[length]))
                        made[length] += 1
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, types, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, PIECES)


def place(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """made, a written table of pieces(), with the sequence and the offset of each piece."""
    per_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = written(per_part.withColumn("base", before), "bases")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in bases.groupBy("length").agg(F.sum("n")).collect():  # capacity rows at most
        counts[length] = n
    table = np.array(runs(plan(counts, capacity)), np.int64).reshape(-1, 5)
    # Bounded by the plan: each entry of it uses up a length, or all but a few of its pieces.
    held = made.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, each, sequence, offset = held.value.T
        begins = np.searchsorted(lengths, np.arange(capacity + 2))
        for batch in batches:
            length, number = np.asarray(batch.column("length")), np.asarray(batch.column("number")) + np.asarray(batch.column("base"))
            row = np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = length == n
                row[at] = begins[n] + np.searchsorted(first[begins[n] : begins[n + 1]], number[at], side="right") - 1
            rank = number - first[row]
            found = [pa.array(sequence[row] + rank // each[row]), pa.array(offset[row] + rank % each[row] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], [f.split()[0] for f in PLACED.split(", ")])

    joined = made.join(bases.select("part", "length", "base"), ["part", "length"])
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", "number", "base").mapInArrow(run, PLACED)


def pack_best_fit(docs: DataFrame, path: str | None = None, end_id: int | None = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document; documents over the capacity are cut into pieces of just that length and a rest.

    A null or empty text has the end id alone. Null and repeated doc_ids are packed like any other; which of two equal
    lengths goes where depends on how the documents are dealt to tasks, the number of sequences doesn't. An empty table
    gives no rows. Other columns of docs play no part.
    """
    return place(written(pieces(docs, path or tokenizer_path(TOKENIZER), end_id, capacity), "pieces"), capacity)
