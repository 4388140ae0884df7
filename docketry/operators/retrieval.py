"""Hybrid retrieval over batches of questions: dense top-k, BM25 over each question's pool, blend, rerank, cascade.

Every statistic is of one question's pool, so everything is grouped by qid. The questions are a stated set that meets
the vectors in a grid of blocks and lots, and each cell's best of a question go on as one row; other rank filters
(row_number <= k) are pushed below the shuffle as group limits.
Only texts that are in a pool are tokenized.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from docketry.streaming.turns import shared_dir

# Pool, weight of the dense score, rerank pool, results; BM25 constants.
POOL, ALPHA, RERANK_POOL, TOP = 200, 0.2, 20, 5
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Questions of a block, vectors of a lot; of both at a time, where all scores are given out, and how many times that are in a cell.
BLOCK, LOT, SIDE, SIDES = 4096, 1 << 16, 2048, 8
#: Scores that a task works on at a time: it holds a few arrays of so many.
SCORES = 1 << 20


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the checkpoint folder that driver and executors share, and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def dense_scores(questions: DataFrame, vectors: DataFrame, keep: int | None = None) -> DataFrame:
    """(qid, doc, dense): cosine of questions(qid, embedding) with vectors(doc, embedding), 0 where either is zero.

    A grid: questions are dealt to blocks and vectors to lots by a hash of their id, and each cell of a block and a lot is some matrix
    products in a task. With `keep`, a cell gives out only its best `keep` rows a question (by score, then doc): all that can be among the best
    `keep` overall, so that what is shuffled doesn't grow with the vectors' number times the questions'. Without, a cell is a partition and gives out
    about SIDE squared scores at a time, so that it may be large: vectors go to as many cells as there are blocks.
    """
    if keep is not None:
        return _grid(questions, vectors, BLOCK, LOT).applyInArrow(_cell(keep), SCORED)
    asked, rows, blocks, lots = _dealt(questions, vectors, SIDES * SIDE, SIDES * SIDE, 3)
    cell = (F.col("block") * lots + F.col("lot")).cast("int").alias("cell")
    sides = asked.select(cell, F.col("qid").alias("id"), F.lit(True).alias("asks"), "embedding").union(rows.select(cell, "doc", F.lit(False), "vector"))
    return sides.repartitionById(blocks * lots, "cell").mapInArrow(_cells(_cell(None)), SCORED)


def nearest(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, doc, dense, rank): the best k of dense_scores for each question, by score, then doc."""
    return merged(_grid(questions, vectors, BLOCK, LOT).applyInArrow(_cell(k, lists=True), LISTS), k)


def _grid(questions: DataFrame, vectors: DataFrame, block: int, lot: int) -> PandasCogroupedOps:
    """The cells, of about `block` questions and `lot` vectors."""
    asked, rows, _, _ = _dealt(questions, vectors, block, lot)
    return asked.groupBy("block", "lot").cogroup(rows.groupBy("block", "lot"))


def _dealt(questions: DataFrame, vectors: DataFrame, block: int, lot: int, least: int = 1) -> tuple[DataFrame, DataFrame, int, int]:
    """questions(block, lot, qid, embedding) and vectors(block, lot, doc, vector), each row as often as there are cells for it; how many blocks
    and lots there are: of the latter at least `least` a core, unless they would be small."""
    asked, rows = questions.where("qid IS NOT NULL AND embedding IS NOT NULL").select("qid", "embedding"), vectors.where("doc IS NOT NULL AND embedding IS NOT NULL").select("doc", F.col("embedding").alias("vector"))  # a name of its own, as the questions may be of the same table
    n = rows.count()
    blocks, lots = max(1, -(-asked.count() // block)), max(1, -(-n // lot), min(least * questions.sparkSession.sparkContext.defaultParallelism, n // 256))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    spread = rows.withColumn("lot", F.pmod(F.xxhash64("doc"), F.lit(lots)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return dealt, spread, blocks, lots


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cosines(q: np.ndarray, v: np.ndarray, q_norm: np.ndarray, v_norm: np.ndarray) -> np.ndarray:
    norm = q_norm[:, None] * v_norm[None, :]
    return np.round(np.divide(q @ v.T, norm, out=np.zeros_like(norm), where=norm > 0), 6)


def best_of(qid: np.ndarray, q: np.ndarray, doc: np.ndarray, v: np.ndarray, keep: int | None, among: Callable[[int, int], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """qid, doc and cosine of the best `keep` (None: all) rows a question, by score, then doc. `among` says which rows questions from..to may have."""
    q_norm, v_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    step = max(1, min(64, SCORES // max(1, len(doc))))
    for at in range(0, len(qid), step):
        score = _cosines(q[at : at + step], v, q_norm[at : at + step], v_norm)
        may = np.ones(score.shape, bool) if among is None else among(at, at + len(score))
        if keep is None or keep >= len(doc):
            row, col = np.nonzero(may)
        else:
            masked = np.where(may, score, -np.inf)
            row, col = np.nonzero(may & (masked >= -np.partition(-masked, keep - 1, axis=1)[:, keep - 1 : keep]))
            order = np.lexsort((doc[col], -score[row, col], row))
            row, col = row[order], col[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < keep  # of equal scores the smaller ids
            row, col = row[first], col[first]
        yield qid[at + row], doc[col], score[row, col]


#: What a cell found for a question as one row: a row a pair would take several times the memory to sort, and tasks are dealt by what
#: cells read, which is less than they find.
LISTS = "qid long, docs array<long>, scores array<double>"


def in_lists(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """What best_of gives, in the columns of LISTS."""
    schema = pa.schema([("qid", pa.int64()), ("docs", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
    out = [schema.empty_table()]
    for qid, doc, score in found:
        start = np.flatnonzero(np.diff(qid, prepend=qid[:1] - 1))
        ends = pa.array(np.append(start, len(qid)), pa.int32())
        out.append(pa.table([pa.array(qid[start], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(doc, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(score))], schema=schema))
    return pa.concat_tables(out)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """(qid, doc, dense, rank): of LISTS the best k of each question, by score, then doc."""

    def run(group: pa.Table) -> pa.Table:
        doc, score = (pc.list_flatten(group[c].combine_chunks()).to_numpy() for c in ("docs", "scores"))
        first = np.lexsort((doc, np.where(np.isnan(score), -np.inf, -score)))[:k]
        return pa.table({"qid": np.full(len(first), group["qid"][0].as_py()), "doc": doc[first], "dense": score[first], "rank": np.arange(1, len(first) + 1, dtype=np.int32)})

    return lists.groupBy("qid").applyInArrow(run, "qid long, doc long, dense double, rank int")


#: What dense_scores gives.
SCORED = "qid long, doc long, dense double"


def _cell(keep: int | None, lists: bool = False):
    schema = pa.schema([("qid", pa.int64()), ("doc", pa.int64()), ("dense", pa.float64())])

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return in_lists(iter(())) if lists else schema.empty_table()
        sides = asked["qid"].to_numpy(), matrix(asked["embedding"]), rows["doc"].to_numpy(), matrix(rows["vector"])
        if keep is None:
            return pa.table(_by_score(*sides), schema=schema)
        found = best_of(*sides, keep)
        if lists:
            return in_lists(found)
        out = []
        for qid, doc, score in found:
            out.append(pa.table([pa.array(qid, pa.int64()), pa.array(doc, pa.int64()), pa.array(score)], schema=schema))
        return pa.concat_tables(out)

    return run


def _by_score(qid: np.ndarray, q: np.ndarray, doc: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """qid, doc and cosine of all pairs. Equal scores stand together: a column of numbers that are all different is most of what a file takes."""
    q_norm, v_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    score = np.empty((len(qid), len(doc)))
    for at in range(0, len(qid), 64):
        score[at : at + 64] = _cosines(q[at : at + 64], v, q_norm[at : at + 64], v_norm)
    key = np.rint(score.ravel() * 1e6)
    key = np.nan_to_num(key, copy=False).astype(np.int64) << 32 | np.arange(key.size)  # whole numbers, that hold the place, sort faster than places
    key.sort()
    order = (key & 0xFFFFFFFF).astype(np.int32)
    return [qid[order // len(doc)], doc[order % len(doc)], score.ravel()[order]]


def _cells(cell: Callable[[pa.Table, pa.Table], pa.Table]):
    """The cells of a partition (one), SIDE of its questions by SIDE of its vectors at a time."""
    side = SIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        sides = pa.Table.from_batches(held)
        for number in pc.unique(sides["cell"]).to_pylist():
            own = sides.filter(pc.equal(sides["cell"], number))
            asked, rows = own.filter(own["asks"]), own.filter(pc.invert(own["asks"]))
            asked, rows = asked.select(["id", "embedding"]).rename_columns(["qid", "embedding"]), rows.select(["id", "embedding"]).rename_columns(["doc", "vector"])
            for first in range(0, rows.num_rows, side):
                for at in range(0, asked.num_rows, side):
                    yield from cell(asked.slice(at, side), rows.slice(first, side)).to_batches(max_chunksize=1 << 17)

    return run


def top_k(df: DataFrame, k: int, *order: Column, by: str = "qid", rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def bm25(pool: DataFrame, questions: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(qid, doc, bm25) of pool(qid, doc, tokens) for questions(qid, tokens). A term in over half a pool gets EPSILON times the mean
    idf of the pool; repeated question terms count each time. With texts(doc, tokens), a row a text, the pool needs no tokens."""
    return scored(with_packed(pool, texts), questions).select("qid", "doc", "bm25")


def with_packed(pool: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """pool(qid, doc, ...) with dl and packed, of its own tokens or, where texts(doc, tokens) are given, of those: each packed once, however
    many pools it is in."""
    pool = pool.drop("dl")
    return packed(pool) if texts is None else pool.drop("tokens").join(packed(texts.select("doc", "tokens")), "doc", "left")


def packed(texts: DataFrame) -> DataFrame:
    """texts(tokens, ...) with dl and packed in place of the tokens: their number, and the distinct terms with their counts as one compressed value."""
    others = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in texts.schema if f.name != "tokens")
    return texts.mapInArrow(_pack, f"{others}dl int, packed binary")


def scored(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """pool(qid, doc, dl, packed, ...), without packed, with bm25 and overlap (share of the question's terms that the text has; null where
    there is no such question) for questions(qid, tokens).

    A text goes to each pool it is in as one row, packed, and a pool is scored as one group: what is shuffled and sorted grows with the
    pools' texts, compressed, and nothing of a text is needed after it. A pool is a bounded number of rows."""
    asked = questions.select(F.col("qid").cast(pool.schema["qid"].dataType).alias("qid"), "tokens")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema if f.name != "packed")
    done = pool.groupBy("qid").cogroup(asked.groupBy("qid")).applyInArrow(_score, f"{columns}, bm25 double, overlap double")
    return done.withColumn("bm25", F.round("bm25", 6)).withColumn("overlap", F.round("overlap", 6))


#: Texts that are packed at a time.
PACKED = 256


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of tokens their number, and packed: the number of distinct terms, their lengths in bytes, how often each occurs, the terms."""
    for batch in batches:
        for start in range(0, batch.num_rows, PACKED):
            texts = batch.slice(start, PACKED)
            row, terms = _flat(texts["tokens"])
            coded = terms.dictionary_encode()
            order = pc.sort_indices(coded.dictionary)  # neighbours alike compress better
            known = max(1, len(order))
            key, tf = np.unique(row * known + np.argsort(order.to_numpy())[coded.indices.to_numpy()], return_counts=True)
            found = coded.dictionary.take(order.take(pa.array(key % known)))
            length = pc.binary_length(found).to_numpy()
            chars, at = b"".join(found.cast(pa.binary()).to_pylist()), np.concatenate(([0], np.cumsum(length)))
            ends = np.searchsorted(key, np.arange(texts.num_rows + 1) * known)
            values = [zlib.compress(np.concatenate(([b - a], length[a:b], tf[a:b])).astype("<i4").tobytes() + chars[at[a] : at[b]], 1) for a, b in zip(ends, ends[1:], strict=False)]
            yield texts.drop_columns(["tokens"]).append_column("dl", pc.list_value_length(texts["tokens"]).cast(pa.int32())).append_column("packed", pa.array(values, pa.binary()))


def _unpack(values: list[bytes | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of all terms of the texts: the number of the text, the term, how often it occurs there. A text that is missing has none."""
    raw = [zlib.decompress(v) if v is not None else bytes(4) for v in values]
    many = [int.from_bytes(r[:4], "little") for r in raw]
    length, tf = (np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(r, "<i4", k, 4 + 4 * k * part) for r, k in zip(raw, many, strict=True))]) for part in (0, 1))
    chars, at = b"".join(r[4 + 8 * k :] for r, k in zip(raw, many, strict=True)), np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
    return np.repeat(np.arange(len(raw)), many), pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(at), pa.py_buffer(chars)), tf


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The values of all lists that aren't null, and the number of the list that each is from."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)


def _score(pool: pa.Table, asked: pa.Table) -> pa.Table:
    """The scores of one question's pool."""
    row, terms, tf = _unpack(pool["packed"].to_pylist())
    coded, n = terms.dictionary_encode(), pool.num_rows
    code, known = coded.indices.to_numpy(), len(coded.dictionary)
    tokens = pc.list_flatten(asked["tokens"].combine_chunks()).cast(pa.large_string())
    wanted = pc.index_in(tokens, coded.dictionary).drop_null().to_numpy()
    bm25, overlap = np.zeros(n), np.full(n, 0.0 if asked.num_rows else np.nan)
    if len(wanted):
        df, times = np.bincount(code, minlength=known), np.bincount(wanted, minlength=known)  # a text has a term once
        idf = np.log(n - df + 0.5) - np.log(df + 0.5)
        weight = times * np.where(idf < 0, EPSILON * idf.mean(), idf)
        hit = np.flatnonzero(times[code])
        dl = pool["dl"].to_numpy().astype(np.float64)
        size = dl[row[hit]] / np.nanmean(dl)
        bm25 = np.bincount(row[hit], weight[code[hit]] * tf[hit] * (K1 + 1) / (tf[hit] + K1 * (1 - B + B * size)), minlength=n)
        overlap = np.bincount(row[hit], minlength=n) / pc.count_distinct(tokens).as_py()
    return pool.drop_columns(["packed"]).append_column("bm25", pa.array(bm25)).append_column("overlap", pa.array(overlap, from_pandas=True))


def minmax(df: DataFrame, column: str, out: str, by: str = "qid") -> DataFrame:
    """Scaled to 0..1 within each group; all 0 where the span is next to nothing."""
    w = Window.partitionBy(by)
    span = F.max(column).over(w) - F.min(column).over(w)
    return df.withColumn(out, F.when(span < 1e-9, 0.0).otherwise((F.col(column) - F.min(column).over(w)) / span))


def blend(pool: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """pool(qid, dense, bm25, ...) with the blend of both, scaled within the pool."""
    both = minmax(minmax(pool, "dense", "dense_n"), "bm25", "bm25_n")
    return both.withColumn("score", F.round(alpha * F.col("dense_n") + (1 - alpha) * F.col("bm25_n"), 6))


def rescore(pool: DataFrame, questions: DataFrame, alpha: float = ALPHA, k: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """(qid, doc, place, score, dense_score, bm25_score): the best k of pool(qid, doc, dense, rank, tokens) by the blend with BM25 for
    questions(qid, tokens); equal blends stay in the pool's order. Where there is nothing to blend (alpha 1 or more, a question without
    tokens, or a pool without any) the pool keeps its order and its scores, and the two parts are null. texts: as in bm25."""
    if alpha >= 1:
        return _in_order(pool, k)
    return rescored(scored(with_packed(pool, texts), questions), questions, alpha, k)


def rescored(pool: DataFrame, questions: DataFrame, alpha: float = ALPHA, k: int = 10) -> DataFrame:
    """As rescore, alpha below 1, of a pool that is scored: it is written once, small rows without their texts."""
    pool = kept(pool)
    has = pool.groupBy("qid").agg(F.max("dl").alias("most")).where("most > 0").join(questions.where(F.size("tokens") > 0).select("qid").distinct(), "qid").select("qid")
    mixed = blend(pool, alpha).join(has, "qid", "left_semi")
    told = top_k(mixed, k, F.desc("score"), F.asc("rank"), rank="place").select("qid", "doc", "place", "score", F.col("dense").alias("dense_score"), F.col("bm25").alias("bm25_score"))
    return told.unionByName(_in_order(pool.join(has, "qid", "left_anti"), k))


def _in_order(pool: DataFrame, k: int) -> DataFrame:
    """The best k as the pool has them, in the columns of rescore."""
    nothing = F.lit(None).cast("double")
    return top_k(pool, k, F.asc("rank"), rank="place").select("qid", "doc", "place", F.col("dense").alias("score"), nothing.alias("dense_score"), nothing.alias("bm25_score"))


def lexical_overlap(a: Column, b: Column) -> Column:
    """The offline stand-in for a cross-encoder: share of the question's terms that the text has."""
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a))), F.lit(0.0)), 6)
