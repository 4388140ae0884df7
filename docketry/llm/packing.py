"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are measured in ids of a byte-level vocabulary plus an end id; longer ones than a sequence are cut into whole
sequences, the first piece taking what is left over. The plan is made on the histogram of piece lengths, which has at most
`capacity` rows however large the corpus is: lengths are taken longest first, and a length's gap is filled exactly by one
available length, else by two, else by three (looked up in indexes of single, pair and triple sums under the counts that
are left); what has no exact complement is packed best-fit, whole groups of equal sequences at a time. Pieces then find
their place by their number among the pieces of their length.

Rows without doc_id are no documents. Null texts are empty (one end id); a very long text is cut as any other, all of its pieces full but the
first; an empty table gives no rows; repeated doc_ids keep all their rows. Of several complements the one that can be taken most often is,
of equals the one with the shortest length. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.byte_bpe import BATCH, END_ID, byte_bpe, default_vocabulary
from docketry.llm.common import saved, slices, texts_of

CAPACITY = 2048


def _most(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often these lengths together can be taken."""
    return min(int(counts[x]) // n for x, n in Counter(lengths).items())


def _complement(counts: np.ndarray, gap: int, pair_sums: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that fill the gap exactly; of several, those that can be taken most often."""
    if gap <= 0:
        return None
    if counts[gap]:
        return (gap,)
    low = np.arange(1, gap // 2 + 1)
    times = np.minimum(counts[low], counts[gap - low])
    if gap % 2 == 0 and gap >= 2:
        times[-1] = counts[gap // 2] // 2
    if len(times) and times.max() > 0:
        a = int(low[times.argmax()])
        return gap - a, a
    first = np.arange(1, gap - 1)
    first = first[(counts[first] > 0) & pair_sums[gap - first]][::-1]  # the longest first
    for a in first.tolist():
        rest = gap - a
        counts[a] -= 1
        low = np.arange(1, rest // 2 + 1)
        times = np.minimum(counts[low], counts[rest - low])
        if rest % 2 == 0 and len(times):
            times[-1] = counts[rest // 2] // 2
        counts[a] += 1
        if len(times) and times.max() > 0:
            b = int(low[times.argmax()])
            return a, rest - b, b
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first number, count, first sequence, offset): piece number n of a length, with first <= n < first + count,
    goes to sequence `first sequence + n - first` at `offset`. Every piece has one slot; slots of a sequence don't overlap and leave no gap."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        slots.append((length, int(used[length]), n, sequence, offset))
        used[length] += n

    left: list[tuple[int, int]] = []  # what has no exact complement
    for length in range(capacity, 0, -1):
        tries = None
        while counts[length]:
            if length == capacity:
                taken: tuple[int, ...] | None = ()
            else:
                counts[length] -= 1
                if tries is None:
                    there = (counts > 0).astype(np.float64)
                    tries = np.rint(np.convolve(there, there))[: capacity + 1] > 0  # no sum of two that isn't here can come up later
                taken = _complement(counts, capacity - length, tries)
                counts[length] += 1
            if taken is None:
                left.append((length, int(counts[length])))
                counts[length] = 0
                break
            n, offset = _most(counts, (length, *taken)), 0
            for x in (length, *taken):
                put(x, n, sequences, offset)
                counts[x] -= n
                offset += x
            sequences += n
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (sequences, first sequence)
    gaps: list[int] = []

    def open_group(gap: int, n: int, sequence: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if not groups[gap]:
            insort(gaps, gap)
        groups[gap].append((n, sequence))

    for length, n in left:
        while n:
            k = bisect_left(gaps, length)
            if k == len(gaps):  # new sequences, as many pieces in each as fit
                each = min(capacity // length, n)
                m = n // each
                for j in range(each):
                    put(length, m, sequences, j * length)
                open_group(capacity - each * length, m, sequences)
                sequences += m
                n -= m * each
                continue
            gap = gaps[k]
            m, sequence = groups[gap].pop()
            if not groups[gap]:
                gaps.pop(k)
            take = min(m, n)
            each = min(gap // length, n // take)
            for j in range(each):
                put(length, take, sequence, capacity - gap + j * length)
            n -= take * each
            open_group(gap - each * length, take, sequence)
            open_group(gap, m - take, sequence + take)
    return slots


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, with the task that cut them and their number there among those of their length."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = byte_bpe(path), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, BATCH):
            rows = []
            for doc_id, found in zip(batch["doc_id"].to_pylist(), bpe.encode_arrays(batch["text"].to_pylist()), strict=True):
                ids = np.append(found, np.uint16(END_ID)).astype("<u4")
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                start = 0
                for piece, end in enumerate(ends):
                    n = end - start
                    rows.append((doc_id, piece, start, n, zlib.crc32(ids[start:end]), part, seen[n]))
                    seen[n] += 1
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return texts_of(docs).mapInArrow(cut, _PIECES_SQL)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    The histogram has at most `capacity` rows, and so the plan that every task is sent is bounded by the capacity, not by the data.
    """
    cut = saved(pieces(docs, vocabulary, capacity))
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    keys = (slots[:, 0] << 44) + slots[:, 1]
    before = Window.partitionBy("length").orderBy("part")
    bases = by_part.select("length", "part", (F.sum("n").over(before) - F.col("n")).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch["base"].to_numpy() + batch["nth"].to_numpy()
            k = np.searchsorted(keys, (batch["length"].to_numpy() << 44) + number, "right") - 1
            slot = slots[k]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(slot[:, 3] + number - slot[:, 1]), pa.array(slot[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return cut.join(bases, ["length", "part"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
