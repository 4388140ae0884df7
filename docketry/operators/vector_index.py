"""An inverted-file index over vectors: lists around centroids, residuals in product codes, exact cosine for the survivors.

Centroids, code books and the number of lists to probe are fitted on at most SAMPLE vectors (those of the smallest hash of the id), then every vector is assigned,
coded and written, partitioned by list. A search sends each question to its nearest lists; only those lists, and of them only the codes,
are read. Lists meet their questions in cells of about PART rows (short lists together), so that what is shuffled grows with the cells, not
with the pairs: codes give a score to every row of the lists asked for, the best REFINE a question and cell survive, and for these the vectors
themselves are read and compared; a cell gives out the best of each question. Other columns of the table (namespace, metadata) stay beside the vectors, so predicates on
them reach the scan.

Long lists are split into cells of about PART rows by a hash of the id, so a list that holds a third of all vectors is no hot group.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from docketry.operators.retrieval import LISTS, best_of, in_lists, matrix, merged

#: Vectors that centroids and code books are fitted on; most lists.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Sub-vectors of a code, values of each (a byte), k-means steps.
PIECES, VALUES, STEPS = 8, 256, 12
#: A question's lists are taken by nearness: as many as held RECALL of the sample's true neighbours of TRIALS of its vectors, and on until
#: they hold OVER times the rows that are asked for.
RECALL, TRIALS, OVER = 0.95, 256, 2
#: Survivors of a cell, as a multiple of the rows asked for, and at least one in SHARE; rows of a cell, at most about and (but for small
#: tables) at least.
REFINE, SHARE, PART, LEAST_PART = 2, 4, 1 << 16, 256
#: Questions that meet a cell in one task.
BLOCK = 4096


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point."""
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1)


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(STEPS):
        at = _near(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points[rng.choice(len(points), len(centres))])
    return centres


def _lists_needed(points: np.ndarray, centres: np.ndarray, at: np.ndarray, depth: int) -> int:
    """How many of a vector's nearest lists hold RECALL of its `depth` true neighbours, measured within the sample."""
    q = points[:TRIALS]
    near = np.argpartition(-(q @ points.T), min(depth, len(points)) - 1, axis=1)[:, :depth]
    order = np.argsort(-(2 * q @ centres.T - (centres * centres).sum(axis=1)), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    return int(np.quantile(np.take_along_axis(place, at[near], axis=1), RECALL, method="higher")) + 1


class VectorIndex:
    """An index in a folder that driver and executors share: vectors (partitioned by list), centroids, code books."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        model = spark.read.parquet(f"{path}/model").orderBy("kind", "piece", "at").collect()  # at most MOST_LISTS + PIECES * VALUES rows, and one
        self.schema, self.least = next((StructType.fromJson(json.loads(r.text)), r["at"]) for r in model if r.kind == "table")
        self.centres = np.array([r.vector for r in model if r.kind == "list"])
        self.books = [np.array([r.vector for r in model if r.kind == "code" and r.piece == m]) for m in range(PIECES)]
        self.sizes = np.zeros(len(self.centres), np.int64)
        for r in self.vectors().groupBy("list").count().collect():  # from footers; a row a list
            self.sizes[r["list"]] = r["count"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, k: int = 200, lists: int | None = None) -> VectorIndex:
        """vectors: doc, embedding, and any columns more. Rows without either are left out. k: how many neighbours will be asked for."""
        spark, rows = vectors.sparkSession, vectors.where("doc IS NOT NULL AND embedding IS NOT NULL")
        count = rows.count()
        lists = lists or int(min(MOST_LISTS, max(1, round(count**0.5))))
        sample = [r.embedding for r in rows.select("doc", "embedding").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE).collect()]
        points = _unit(np.array(sample, np.float64)) if sample else np.zeros((1, PIECES))
        rng = np.random.default_rng(0)
        centres = _kmeans(points, lists, rng)
        at = _near(points, centres)
        least = _lists_needed(points, centres, at, max(1, round(k * len(points) / max(1, count))))
        residuals = points - centres[at]
        books = [_kmeans(piece, VALUES, rng) for piece in np.array_split(residuals, PIECES, axis=1)]
        names, coded_schema = vectors.columns, StructType([*vectors.schema.fields, StructField("codes", BinaryType()), StructField("list", IntegerType())])
        model = [("list", 0, n, c.tolist(), None) for n, c in enumerate(centres)] + [("code", m, n, c.tolist(), None) for m, b in enumerate(books) for n, c in enumerate(b)]
        spark.createDataFrame([*model, ("table", 0, least, None, coded_schema.json())], "kind string, piece int, at int, vector array<double>, text string").coalesce(1).write.parquet(f"{path}/model")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _unit(_matrix(batch["embedding"])) if batch.num_rows else np.zeros((0, centres.shape[1]))
                at = _near(v, centres)
                codes = np.stack([_near(p, b) for p, b in zip(np.array_split(v - centres[at], PIECES, axis=1), books, strict=True)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], [*names, "list", "codes"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        coded = rows.mapInArrow(run, f"{fields}, list int, codes binary")
        # ranges of list and hash: a long list is written by several tasks, a short one by one
        coded.repartitionByRange("list", F.xxhash64("doc")).sortWithinPartitions("list", "doc").write.partitionBy("list").parquet(f"{path}/vectors")
        return cls(spark, path)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def probes(self, questions: DataFrame, k: int, every: bool = False) -> DataFrame:
        """qid, embedding, lists: the lists that a question is sent to."""
        centres, sizes, dim, least = self.centres, self.sizes, self.centres.shape[1], self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if sizes.any() else ():
                q = _unit(_matrix(batch["embedding"])) if batch.num_rows else np.zeros((0, dim))
                order = np.argsort(-(2 * q @ centres.T - (centres * centres).sum(axis=1)), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                sent = ((before < OVER * k) | (np.arange(len(centres)) < least) | every) & (sizes[order] > 0)
                lists = pa.array([order[n, s] for n, s in enumerate(sent)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["qid"], batch["embedding"].cast(pa.list_(pa.float64())), lists], ["qid", "embedding", "lists"])

        return questions.where("qid IS NOT NULL AND embedding IS NOT NULL").select("qid", "embedding").mapInArrow(run, "qid long, embedding array<double>, lists array<int>")

    def _cells(self, wanted: list[int]) -> list[tuple[int, int, int]]:
        """(list, cell, cells): a list is dealt to so many cells from that one; short lists share one."""
        total = int(self.sizes[wanted].sum())
        most = min(PART, max(LEAST_PART, -(-total // max(1, self.spark.sparkContext.defaultParallelism))))
        out, cell, held = [], 0, 0
        for at in wanted:
            n = int(self.sizes[at])
            if held and held + n > most:
                cell, held = cell + 1, 0
            parts = max(1, -(-n // most))
            out.append((at, cell, parts))
            cell, held = (cell, held + n) if parts == 1 else (cell + parts, 0)
        return out

    def search(self, questions: DataFrame, k: int, where: Column | None = None, every: bool = False) -> DataFrame:
        """qid, doc, dense, rank: of questions(qid, embedding) the k nearest by cosine among the rows that `where` holds for. With `every` all
        lists are probed and all their rows survive: the exact result."""
        asked = self.probes(questions, k, every)
        wanted = sorted(r["list"] for r in asked.select(F.explode("lists").alias("list")).distinct().collect())  # at most MOST_LISTS numbers
        rows = self.vectors().where(F.col("list").isin(wanted))  # partitions that nobody asks for aren't opened
        rows = rows.where(where) if where is not None else rows
        cells = self._cells(wanted)
        dealt = rows.join(F.broadcast(self.spark.createDataFrame(cells, "list int, cell int, cells int")), "list")  # a row a list
        dealt = dealt.withColumn("cell", F.col("cell") + F.pmod(F.xxhash64("doc"), "cells").cast("int"))
        # questions of a popular cell come in blocks, so that a group is at most BLOCK questions and about PART rows
        blocks = max(1, -(-questions.count() // BLOCK))
        of = {}
        for at, first, n in cells:
            for c in range(first, first + n):
                of.setdefault(c, []).append(at)
        lists = F.broadcast(self.spark.createDataFrame(sorted(of.items()), "cell int, held array<int>"))  # a number a list and its cells
        sent = asked.crossJoin(lists).withColumn("lists", F.array_intersect("lists", "held")).where(F.size("lists") > 0).drop("held").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        key, block = ["cell", "block"], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        if not every:
            coded = dealt.select("cell", "list", "doc", "codes", block)
            sent = sent.groupBy(*key).cogroup(coded.groupBy(*key)).applyInArrow(self._survivors(REFINE * k), "cell int, block int, qid long, embedding array<double>, docs array<long>")
        scored = sent.groupBy(*key).cogroup(dealt.select("cell", "doc", "embedding", block).groupBy(*key)).applyInArrow(_scores(k, every), LISTS)
        return merged(scored, k)

    def _survivors(self, keep: int):
        """Of the rows of a cell that are in lists asked for, those with the best coded score for each question."""
        centres, books = self.centres, self.books
        schema = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("qid", pa.int64()), ("embedding", pa.list_(pa.float64())), ("docs", pa.list_(pa.int64()))])

        def run(sent: pa.Table, rows: pa.Table) -> pa.Table:
            if not sent.num_rows or not rows.num_rows:
                return schema.empty_table()
            q, doc, at = _unit(matrix(sent["embedding"])), rows["doc"].to_numpy(), rows["list"].to_numpy()
            codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(doc), -1)
            tables = [x @ b.T for x, b in zip(np.array_split(q, len(books), axis=1), books, strict=True)]
            near, docs = q @ centres.T, []
            for k, lists in enumerate(sent["lists"].to_pylist()):
                chosen = np.flatnonzero(np.isin(at, lists))
                most = max(keep, len(chosen) // SHARE)
                if most < len(chosen):
                    score = sum(t[k][codes[chosen, m]] for m, t in enumerate(tables)) + near[k][at[chosen]]
                    chosen = chosen[np.argpartition(-score, most - 1)[:most]]
                docs.append(doc[chosen])
            return pa.table([sent["cell"], sent["block"], sent["qid"], sent["embedding"], pa.array(docs, schema.field("docs").type)], schema=schema)

        return run


def _scores(keep: int, every: bool):
    """The best `keep` of a cell for each question, of its survivors (or of all rows)."""

    def run(sent: pa.Table, rows: pa.Table) -> pa.Table:
        if not sent.num_rows or not rows.num_rows:
            return in_lists(iter(()))
        doc = rows["doc"].to_numpy()
        among = None
        if not every:
            known, place = np.unique(doc, return_inverse=True)
            lists = sent["docs"].combine_chunks()

            def among(start: int, stop: int) -> np.ndarray:
                may = np.zeros((stop - start, len(known)), bool)
                for k in range(start, stop):
                    may[k - start, np.searchsorted(known, lists[k].values.to_numpy())] = True
                return may[:, place]

        return in_lists(best_of(sent["qid"].to_numpy(), matrix(sent["embedding"]), doc, matrix(rows["embedding"]), keep, among))

    return run
