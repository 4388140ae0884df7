"""Ranked lexical search over a tiered index, exact.

Documents are read once into a store: for each, how many terms it has, and how often it has each of the terms that are asked for.
A posting's weight grows with its `q`, which needs nothing but the document and the corpus totals. The postings of the highest q of
every term make the upper tiers, written beside the store; each term keeps, for each tier, the highest q that is below (the
residual bound). Items start in the highest tier: what it gives is a lower score of the documents seen there; no unseen
document can exceed the sum of the residual bounds. Where that sum is under the tenth-best lower score the tier is proof: those
seen documents whose upper score reaches it are scored in full, and the item is done. Items without proof fall through to
the next tier, last to the store, where every document is scored and each task keeps the best of its documents for each item.

Items are asked in blocks of BLOCK, so what goes to every task (the terms of a block) is bounded; documents are never grouped by
a term, so a term that all documents have is no hot key.

Rows without doc_id or item_id are no documents or items. A null text has no term; a document without a term isn't counted and never
found, an item without one finds nothing. Rows that share an item_id are one item with the terms of all; rows that share a doc_id are
documents of their own. Equal scores are ordered by doc_id. A very long text is one row of the store. Empty tables give no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import discard, new_path, saved, slices

BEST = 10
#: Items of one pass over the documents.
BLOCK = 1024
#: And pairs of an item and a term, as long as that is more than one item.
PAIRS = 1 << 18
#: So many postings of a term, at most, are in a tier or a higher one. Equal steps of q stay together.
TIERS = (64, 512)
#: Steps that q (0 to a million) is counted in.
STEP = 1 << 12

#: Letters A-Z lower-cased, digits and all beyond ASCII kept, everything else a separator.
_FOLD = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each term of an item once."""
    folded = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("term")).distinct()


def _blocks(asked: DataFrame, items: int) -> Iterator[list]:
    """The (item_id, term) rows of `items` items at a time (fewer, where they have over PAIRS), in order of the ids: no more of them are ever on the driver."""
    after = None
    while True:
        rest = asked if after is None else asked.where(F.col("item_id") > after)
        sizes = rest.groupBy("item_id").count().orderBy("item_id").limit(items).collect()
        if not sizes:
            return
        whole = list(accumulate(r["count"] for r in sizes))
        after = sizes[max(1, bisect_right(whole, PAIRS)) - 1].item_id
        yield rest.where(F.col("item_id") <= after).collect()


def store(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """row (unique), doc_id, n (terms with repeats), terms, tfs (of the terms that have a number): a row a document with a term."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, rows=1024):
            made = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), pc.cast(batch["text"], pa.binary()).to_pylist(), strict=True):
                found = terms_of(text)
                if found:
                    kept = [(number[t], c) for t, c in Counter(found).items() if t in number]
                    made.append((row, doc_id, len(found), [t for t, _ in kept], [c for _, c in kept]))
                    row += 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tfs array<int>")


def _postings(rows: DataFrame, documents: int, total: int, *more: str) -> DataFrame:
    """row, doc_id, term, q (and more columns) of a store's rows."""
    each = rows.selectExpr(*more, "row", "doc_id", f"10 + (90 * n * {documents}L) div {total}L AS m", "inline(arrays_zip(terms, tfs))").withColumnsRenamed({"terms": "term", "tfs": "tf"})
    return each.selectExpr(*more, "row", "doc_id", "term", "(1000000000 * CAST(tf AS long)) div (1000 * CAST(tf AS long) + 8 * m) AS q")


def _bounds(postings: DataFrame, documents: int) -> DataFrame:
    """A row a term: w, and for each tier cut (the least q in it; null if it is empty) and below (the highest q under it, 0 if none)."""
    steps = postings.groupBy("term", F.expr(f"q div {STEP}").alias("step")).agg(F.count("*").alias("n"), F.min("q").alias("low"), F.max("q").alias("high"))
    steps = steps.withColumn("upto", F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("step"))))  # at most 1e6 / STEP rows a term
    weight = F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (2 * F.sum("n") + 1))).alias("w")
    cuts = [F.min(F.when(F.col("upto") <= size, F.col("low"))).alias(f"cut{k}") for k, size in enumerate(TIERS)]
    return steps.groupBy("term").agg(weight, *cuts, *(F.coalesce(F.max(F.when(F.col("upto") > size, F.col("high"))), F.lit(0)).alias(f"below{k}") for k, size in enumerate(TIERS)))


class _Sums:
    """The best documents of each item among those that one task scores: all are scored, the best are kept."""

    def __init__(self, items: np.ndarray, starts: np.ndarray, targets: np.ndarray, weights: np.ndarray, floors: np.ndarray, best: int) -> None:
        self.items, self.starts, self.targets, self.weights, self.floors, self.best = items, starts, targets, weights, floors.copy(), best
        self.held = [np.zeros(0, np.int64)] * 3

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, terms: np.ndarray, q: np.ndarray) -> None:
        """A batch of documents; counts has the postings of each, in order."""
        many = np.diff(self.starts)[terms]  # items that ask for the posting's term
        at = np.repeat(self.starts[terms] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        cell = np.repeat(np.repeat(np.arange(len(doc_ids)), counts) * len(self.items), many) + self.targets[at]
        sums = np.zeros(len(doc_ids) * len(self.items), np.int64)
        np.add.at(sums, cell, np.repeat(self.weights[terms] * q, many))
        sums = sums.reshape(len(doc_ids), -1)
        doc, item = np.nonzero(sums >= self.floors)
        self.held = [np.concatenate(x) for x in zip(self.held, (item, sums[doc, item], doc_ids[doc]), strict=True)]
        if len(self.held[0]) > 4 * self.best * len(self.items):
            self.settle()

    def settle(self) -> None:
        item, score, doc_id = self.held
        order = np.lexsort((doc_id, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[rank < self.best], item[rank < self.best]
        self.held = [item, score[order], doc_id[order]]
        last = np.flatnonzero(rank[rank < self.best] == self.best - 1)
        self.floors[item[last]] = np.maximum(self.floors[item[last]], self.held[1][last])


def _score_all(rows: DataFrame, pairs: list[tuple[int, int]], weights: dict[int, int], floors: dict[int, int], documents: int, total: int, best: int) -> DataFrame:
    """item_id, doc_id, score: every document scored for the items of pairs (item, term), the best of each task."""
    items = np.unique([i for i, _ in pairs])
    place = {int(i): k for k, i in enumerate(items)}
    top = max(max(weights), max(t for _, t in pairs)) + 1
    by_term = sorted((t, place[i]) for i, t in pairs)
    starts = np.searchsorted([t for t, _ in by_term], np.arange(top + 1))
    targets, weight = np.array([i for _, i in by_term]), np.zeros(top, np.int64)
    weight[list(weights)] = list(weights.values())
    least = np.array([max(1, floors.get(int(i), 1)) for i in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(items, starts, targets, weight, least, best)
        for batch in slices(batches, rows=max(16, (1 << 17) // len(items))):
            n, tf = batch["n"].to_numpy(), batch["tfs"].flatten().to_numpy().astype(np.int64)
            counts = np.diff(batch["terms"].offsets.to_numpy())
            m = np.repeat(10 + (90 * n * documents) // total, counts)
            sums.add(batch["doc_id"].to_numpy(), counts, batch["terms"].flatten().to_numpy(), (1_000_000_000 * tf) // (1000 * tf + 8 * m))
        sums.settle()
        item, score, doc_id = sums.held
        yield pa.RecordBatch.from_arrays([pa.array(items[item], pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, best: int) -> DataFrame:
    """The best of each item, numbered. (Spark keeps `best` an item in each task before the shuffle.)"""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score", "tier")


class _Block:
    """One block of items over a store: what is known of its terms, and its tiers."""

    def __init__(self, rows: DataFrame, pairs: list[tuple[int, int]], documents: int, total: int, best: int) -> None:
        self.rows, self.documents, self.total, self.best, self.spark = rows, documents, total, best, rows.sparkSession
        self.postings = _postings(rows, documents, total)
        self.bounds = {r.term: r for r in _bounds(self.postings, documents).collect()}  # a row a term of the block
        self.pairs = [(i, t) for i, t in pairs if t in self.bounds]

    def write_tiers(self, path: str) -> None:
        cuts = self._frame([(t, *(b[f"cut{k}"] for k in range(len(TIERS)))) for t, b in self.bounds.items()], ["term", *(f"cut{k}" for k in range(len(TIERS)))])
        tier = F.coalesce(*(F.when(F.col("q") >= F.col(f"cut{k}"), k) for k in range(len(TIERS))))
        high = self.postings.join(F.broadcast(cuts), "term").withColumn("tier", tier).where("tier is not null")
        high.select("tier", "term", "row", "q").repartition(16, "term").sortWithinPartitions("tier", "term").write.partitionBy("tier").parquet(path)

    def _frame(self, rows: list[tuple], names: list[str]) -> DataFrame:
        return self.spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names))

    def _exact(self, wanted: DataFrame, asked: DataFrame) -> DataFrame:
        """item_id, row, doc_id, score of the wanted (item_id, row)."""
        each = _postings(self.rows.join(wanted, "row"), self.documents, self.total, "item_id")
        return each.join(asked, ["item_id", "term"]).groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("score"))

    def ask(self, k: int, tier: DataFrame, items: set[int]) -> tuple[DataFrame | None, set[int], dict[int, int]]:
        """What tier k proves, as item_id, doc_id, score; the items without proof; a score of each item that its best documents reach."""
        pairs = [(i, t, self.bounds[t].w, self.bounds[t].w * self.bounds[t][f"below{k}"]) for i, t in self.pairs if i in items]
        if not pairs:
            return None, set(), {}
        asked = F.broadcast(self._frame(pairs, ["item_id", "term", "w", "rest"]))  # of one block
        unseen = Counter()
        for item, _, _, rest in pairs:
            unseen[item] += rest
        seen = saved(tier.join(asked, "term").groupBy("item_id", "row").agg(F.sum(F.col("w") * F.col("q")).alias("least"), F.sum("rest").alias("met")))
        rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("least"), "row"))
        first = seen.withColumn("rank", rank).where(F.col("rank") <= self.best).select("item_id", "row")
        full = self._exact(F.broadcast(first), asked).groupBy("item_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).collect()  # a row an item
        floors = {i: 1 for i in unseen} | {r.item_id: max(1, r.score) for r in full if r.n == self.best}
        proven = [(i, floors[i], rest) for i, rest in unseen.items() if rest < floors[i]]
        if not proven:
            return None, set(unseen), floors
        good = F.broadcast(self._frame(proven, ["item_id", "floor", "rest"]))
        # at most what was met, in full, and the bounds of the terms that weren't
        reach = seen.join(good, "item_id").where("least + rest - met >= floor").select("item_id", "row")
        return self._exact(reach, asked).select("item_id", "doc_id", "score"), set(unseen) - {i for i, _, _ in proven}, floors


def _search_block(docs: DataFrame, asked: list, best: int) -> DataFrame | None:
    spark = docs.sparkSession
    number = {t: k for k, t in enumerate(sorted({r.term for r in asked}))}
    path = new_path(spark, "search")
    store(docs, {t.encode(): k for t, k in number.items()}).write.parquet(f"{path}/store")
    rows = spark.read.parquet(f"{path}/store")
    documents, total = rows.agg(F.count("*"), F.sum("n")).first()
    result = None
    if documents:
        block = _Block(rows, [(r.item_id, number[r.term]) for r in asked], documents, total, best)
        block.write_tiers(f"{path}/tiers")
        found, left, floors = [], {i for i, _ in block.pairs}, {}
        for k in range(len(TIERS)):
            proven, left, floors = block.ask(k, spark.read.schema("term int, row long, q long, tier int").parquet(f"{path}/tiers").where(F.col("tier") <= k), left)
            if proven is not None:
                found.append(proven.withColumn("tier", F.lit(k)))
        if left:
            weights = {t: b.w for t, b in block.bounds.items()}
            found.append(_score_all(rows, [(i, t) for i, t in block.pairs if i in left], weights, floors, documents, total, best).withColumn("tier", F.lit(len(TIERS))))
        if found:
            result = saved(_ranked(reduce(DataFrame.unionByName, found), best))
    discard(spark, path)
    return result


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score, tier (the last is the whole store): the best documents of each item."""
    parts = [_search_block(docs, asked, best) for asked in _blocks(saved(item_terms(items)), block)]
    none = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None] or [none])


#: The same rows from DuckDB.
SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents WHERE doc_id IS NOT NULL),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term, n_docs),
scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
