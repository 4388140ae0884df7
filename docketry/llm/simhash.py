"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in at most 4 bits are linked, and classes are the
connected components of the links.

Every distinct fingerprint has a row of a pivot table, computed once and kept with it: its Hamming distances to fixed reference
fingerprints. By the triangle inequality two fingerprints whose rows differ by more than 4 in any coordinate can't be linked; only
pairs that pass are verified. So that pairs meet without comparing all with all, fingerprints are first dealt by blocks: of 7 blocks
of bits, at least 3 are equal in any linked pair, so each linked pair shares one of the 35 keys of three blocks.
Equal fingerprints are one row (and keep their smallest doc_id) before that, and a key's rows are compared in runs of about
RUN rows: what is longer is dealt to pieces, and each pair of pieces becomes a task-sized run of its own. From each
run only links that join two classes of it are given out, never all pairs.

Rows without doc_id are no documents. Null and empty texts have no words: fingerprint zero, linked like any other. Repeated doc_ids keep all their rows. An empty table
gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import components, saved, slices, texts_of

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 7
PIVOTS = 16
RUN = 4096
#: Runs of at most so many rows are compared together, row by row with those after it.
SHORT = 16
#: Keys whose links are contracted before the other keys are looked at.
FIRST_KEYS = 5
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 values of the text's word shingles; 0 without words."""
    data = text.encode().lower()  # of bytes, lower() changes A-Z alone
    words = data.split()  # and split() cuts at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _CHUNK):
        h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def _block_bits(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def _keys(fp: Column, radius: int, blocks: int) -> Column:
    """For each choice of blocks - radius blocks: its number and the bits of those blocks, as one long."""
    out = []
    for k, chosen in enumerate(itertools.combinations(_block_bits(blocks), blocks - radius)):
        key = F.lit(k).cast("long")
        for first, n in chosen:
            key = F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1).cast("long")))
        out.append(key)
    return F.array(*out)


#: The reference fingerprints: fixed, spread, the same for every corpus.
_PIVOT = np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(PIVOTS)], np.uint64)
_COORDINATES = [f"pivots{k}" for k in range(PIVOTS // 8)]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to every pivot."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ _PIVOT[None, :]).astype(np.int8)


def with_pivots(rows: DataFrame) -> DataFrame:
    """rows (with a column fp) and the pivot table's row of each, eight distances to a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.ascontiguousarray(pivot_table(batch["fp"].to_numpy())).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(table[:, k]) for k in range(len(_COORDINATES)))], [*batch.schema.names, *_COORDINATES])

    kinds = [*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} long" for c in _COORDINATES)]
    return rows.mapInArrow(run, ", ".join(kinds))


def _near(x: np.ndarray, y: np.ndarray, table_x: np.ndarray, table_y: np.ndarray, radius: int) -> np.ndarray:
    """Whether the rows' pairs are linked: no coordinate of the pivot tables differs by more than the radius, then the verified distance."""
    left = np.flatnonzero(np.abs(table_x - table_y).max(axis=1, initial=0) <= radius)
    out = np.zeros(len(x), bool)
    out[left] = np.bitwise_count((x[left] ^ y[left]).view(np.uint64)) <= radius
    return out


def run_links(fps: np.ndarray, nodes: np.ndarray, table: np.ndarray, radius: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the classes of one run: a breadth-first walk, each step of which compares one row with the rows not yet
    reached. With `side`, only rows of different sides are compared (each side's own links are found elsewhere)."""
    waiting, out = np.arange(len(fps)), []
    while len(waiting):
        frontier, waiting = [int(waiting[0])], waiting[1:]
        while frontier and len(waiting):
            at = frontier.pop()
            close = waiting if side is None else waiting[side[waiting] != side[at]]
            for step in range(0, PIVOTS, 8):
                close = close[np.abs(table[close, step : step + 8] - table[at, step : step + 8]).max(axis=1, initial=0) <= radius]
            close = close[np.bitwise_count((fps[close] ^ fps[at]).view(np.uint64)) <= radius]
            if len(close):
                out += [(int(nodes[at]), int(x)) for x in nodes[close]]
                waiting = waiting[~np.isin(waiting, close, assume_unique=True)]
                frontier += close.tolist()
    return out


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by key, lo and hi, as blocks of whole runs."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch[c].to_numpy() for c in ("key", "lo", "hi", "piece", "fp", "node", *_COORDINATES)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(held[0]):
            continue
        last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
        if cut := int(np.argmax(last)):
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links between the rows of each run (key, lo, hi): one piece of a key's rows, or two of them."""
    for key, lo, hi, piece, fp, node, *coordinates in _whole_runs(batches):
        table = np.stack(coordinates, 1).view(np.int8)
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        n = np.diff(np.append(start, len(key)))
        links: list[tuple[int, int]] = []
        for s, m in zip(start[n > SHORT].tolist(), n[n > SHORT].tolist(), strict=True):
            own = slice(s, s + m)
            links += run_links(fp[own], node[own], table[own], radius, None if lo[s] == hi[s] else piece[own])
        run = np.repeat(np.arange(len(n)), n)
        rows = np.flatnonzero((n[run] > 1) & (n[run] <= SHORT))
        for step in range(1, SHORT):
            left = np.arange(len(rows) - step)
            left = left[run[rows[left]] == run[rows[left + step]]]
            if not len(left):
                break
            x, y = rows[left], rows[left + step]
            ok = _near(fp[x], fp[y], table[x], table[y], radius)
            links += list(zip(node[x[ok]].tolist(), node[y[ok]].tolist(), strict=True))
        a, b = (np.array(c, np.int64) for c in (zip(*links, strict=True) if links else ((), ())))
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])


def keyed_links(keyed: DataFrame, run: int = RUN, radius: int = RADIUS) -> DataFrame:
    """(a, b) node pairs that connect the rows (key, fp, node, pivot table) with a key in common and at most `radius` bits between their fp.

    Keys with a single node have nothing to compare and go first. A key's rows beyond `run` are dealt to pieces, and each
    piece, and each two of them, are a run of their own: no task is sent all rows of a key.
    """
    several = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    rows = keyed.join(several.select("key", F.ceil(F.col("n") / run).cast("int").alias("pieces")), "key")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("fp"), "pieces").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    rows = rows.select("key", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "piece", "fp", "node", *_COORDINATES)
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(partial(_compare, radius=radius), "a long, b long")


def linked(rows: DataFrame, keys: Column, n_keys: int, run: int = RUN, radius: int = RADIUS) -> DataFrame:
    """(node, root) of the rows (fp, node, pivot table) that are linked to another: a key in common and at most `radius` bits between their fp.

    What the first FIRST_KEYS keys bring together is contracted before the others are looked at: by those, only rows of
    different components are compared, so a group of copies doesn't give its links once for each key.
    """
    first = saved(components(saved(keyed_links(rows.select(F.explode(F.slice(keys, 1, FIRST_KEYS)).alias("key"), "fp", "node", *_COORDINATES), run, radius))))
    rooted = rows.join(first, "node", "left").withColumn("node", F.coalesce("root", "node"))
    more = saved(keyed_links(rooted.select(F.explode(F.slice(keys, FIRST_KEYS + 1, n_keys - FIRST_KEYS)).alias("key"), "fp", "node", *_COORDINATES), run, radius))
    joined = saved(components(more)).select(F.col("node").alias("root"), F.col("root").alias("over"))
    alone = joined.join(first, joined["root"] == first["node"], "left_anti")  # had no link by the first keys
    moved = first.join(joined, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    return moved.unionByName(alone.select(F.col("root").alias("node"), F.col("over").alias("root")))


def links(distinct: DataFrame, run: int = RUN, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) node pairs that connect what is linked among rows (fp, node) with distinct fp."""
    table = saved(with_pivots(distinct.select("fp", "node")))
    found = linked(table, _keys(F.col("fp"), radius, blocks), comb(blocks, radius), run, radius)
    return found.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def classes(docs: DataFrame, shingle: int = SHINGLE, run: int = RUN) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable, the document's own included."""
    fps = saved(fingerprints(docs, shingle))
    distinct = saved(with_pivots(fps.groupBy("fp").agg(F.min("doc_id").alias("node"))))
    roots = linked(distinct, _keys(F.col("fp"), RADIUS, BLOCKS), comb(BLOCKS, RADIUS), run)
    known = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
