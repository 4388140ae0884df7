"""Dense, lexical and hybrid retrieval: every vector whose id is divisible by 50 asks, all vectors answer; texts are the documents of the same id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import tokens
from docketry.operators import learned_rank as M
from docketry.operators import retrieval as R
from docketry.operators.vector_index import VectorIndex
from docketry.plans.base import Tables, query, tokens_sql
from docketry.streaming.turns import shared_dir

_CTE = f"""WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
v AS (SELECT vec_id AS doc, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dense AS (SELECT q.qid, v.doc, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS dense FROM q, v),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc) AS rank FROM dense) x WHERE rank <= 200),
tok AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents),
qt AS (SELECT doc_id AS qid, t FROM tok WHERE doc_id % 50 = 0),
pd AS (SELECT p.qid, p.doc, tok.t, len(tok.t) AS dl FROM pool p JOIN tok ON tok.doc_id = p.doc),
stats AS (SELECT qid, count(*) AS n, avg(dl) AS avgdl FROM pd GROUP BY qid),
tf AS (SELECT qid, doc, dl, term, count(*) AS tf FROM (SELECT qid, doc, dl, unnest(t) AS term FROM pd) x GROUP BY ALL),
idf AS (SELECT d.qid, d.term, s.avgdl, ln(s.n - d.df + 0.5) - ln(d.df + 0.5) AS idf FROM (SELECT qid, term, count(*) AS df FROM tf GROUP BY ALL) d JOIN stats s USING (qid)),
low AS (SELECT qid, 0.25 * avg(idf) AS low FROM idf GROUP BY qid),
want AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(t) AS term FROM qt) x GROUP BY ALL),
hit AS (SELECT tf.qid, tf.doc, round(sum(w.times * (CASE WHEN i.idf < 0 THEN l.low ELSE i.idf END) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / i.avgdl))), 6) AS bm25 FROM tf JOIN want w USING (qid, term) JOIN idf i USING (qid, term) JOIN low l USING (qid) GROUP BY tf.qid, tf.doc),
bm AS (SELECT pd.qid, pd.doc, coalesce(h.bm25, 0) AS bm25 FROM pd LEFT JOIN hit h USING (qid, doc)),
both_ AS (SELECT p.qid, p.doc, p.dense, p.rank, b.bm25, max(p.dense) OVER w AS dx, min(p.dense) OVER w AS dn, max(b.bm25) OVER w AS bx, min(b.bm25) OVER w AS bn FROM pool p JOIN bm b USING (qid, doc) WINDOW w AS (PARTITION BY p.qid)),
blend AS (SELECT qid, doc, rank, dense, bm25, round(0.2 * (CASE WHEN dx - dn < 1e-9 THEN 0 ELSE (dense - dn) / (dx - dn) END) + 0.8 * (CASE WHEN bx - bn < 1e-9 THEN 0 ELSE (bm25 - bn) / (bx - bn) END), 6) AS score FROM both_),
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS hrank FROM blend) x WHERE hrank <= 20),
rer AS (SELECT h.qid, h.doc, h.hrank, h.score, round(coalesce(len(list_intersect(list_distinct(qt.t), tok.t)) / nullif(len(list_distinct(qt.t)), 0), 0), 6) AS rerank FROM hyb h JOIN tok ON tok.doc_id = h.doc JOIN qt ON qt.qid = h.qid)
"""


def _questions(t: Tables, rest: int = 0) -> DataFrame:
    """The vectors whose id leaves `rest` when divided by 50."""
    return t.embeddings.where(F.col("vec_id") % 50 == rest).select(F.col("vec_id").alias("qid"), "embedding")


def _pool(t: Tables, rest: int = 0) -> DataFrame:
    return R.nearest(_questions(t, rest), t.embeddings.select(F.col("vec_id").alias("doc"), "embedding"), R.POOL)


def _texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tokens(F.col("text")).alias("tokens"))


def _question_tokens(t: Tables, rest: int = 0) -> DataFrame:
    return t.documents.where(F.col("doc_id") % 50 == rest).join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), tokens(F.col("text")).alias("tokens"))


def _pooled(t: Tables, rest: int = 0) -> tuple[DataFrame, DataFrame]:
    """(qid, doc, dense, rank, dl, packed) of the pools' rows that have a text, each text packed once, however many pools it is in; and (qid,
    tokens) of the questions. The pools are written once, as their texts are looked up by them; a task holds the ids that are looked for, and no
    texts are sorted."""
    pool = R.kept(_pool(t, rest))
    texts = t.documents.withColumnRenamed("doc_id", "doc").join(pool.select("doc").distinct().hint("shuffle_hash"), "doc", "left_semi")
    return pool.join(R.packed(texts.select("doc", tokens(F.col("text")).alias("tokens"))), "doc"), _question_tokens(t, rest)


def _best(t: Tables, rest: int = 0) -> DataFrame:
    """The rerank pools."""
    return R.top_k(R.blend(R.scored(*_pooled(t, rest))), R.RERANK_POOL, F.desc("score"), F.asc("rank"), rank="hrank")


#: Of a pool of 200, those that count as near.
NEAREST = 50


def ranked_features(t: Tables, rest: int = 0) -> DataFrame:
    """The rerank pool of each question with the features of a learned model, and whether a row counts as relevant: in the question's language
    and among the NEAREST of its pool. (The tables' labels say nothing about vectors or texts, so they teach nothing.)"""
    rows = M.features(_best(t, rest))
    langs = t.documents.select("doc_id", "lang")
    both = rows.join(langs.select(F.col("doc_id").alias("qid"), F.col("lang").alias("asked")), "qid").join(langs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("found")), "doc")
    return both.where("qid <> doc").withColumn("relevant", F.coalesce(F.col("asked") == F.col("found"), F.lit(False)) & (F.col("rank") <= NEAREST))


@query()
def learned_rerank(t: Tables) -> DataFrame:
    """The rerank pools by a model that was fitted on other questions (ids that leave 25), the best five of each."""
    model = M.fit(ranked_features(t, 25))
    return M.rerank(ranked_features(t), model, k=R.TOP).select("qid", "doc", F.col("final").cast("long").alias("final"))


def _reranked(t: Tables) -> DataFrame:
    """The rerank pools of the questions with a text, by the share of its terms that a row has."""
    return _best(t).where("overlap IS NOT NULL").withColumnRenamed("overlap", "rerank")


@query(_CTE + "SELECT qid, doc, dense FROM dense")
def cosine_bruteforce(t: Tables) -> DataFrame:
    return R.dense_scores(_questions(t), t.embeddings.select(F.col("vec_id").alias("doc"), "embedding"))


@query(_CTE + """SELECT qid, doc, CAST(place AS BIGINT) AS place, score, dense_score, bm25_score FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS place, score, dense AS dense_score, bm25 AS bm25_score FROM blend WHERE qid % 100 > 0 AND qid IN (SELECT qid FROM qt WHERE len(t) > 0)
UNION ALL SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY rank), dense, NULL, NULL FROM pd JOIN pool p USING (qid, doc) WHERE qid % 100 = 0 OR qid NOT IN (SELECT qid FROM qt WHERE len(t) > 0)) x WHERE place <= 10""")
def rescore_exits(t: Tables) -> DataFrame:
    """The best ten by the blend; every other question is made one without tokens, and its pool stays as it was, as does that of a question
    without a text. Vectors without a text aren't in the pools."""
    pooled, asked = _pooled(t)
    asked = asked.withColumn("tokens", F.when(F.col("qid") % 100 > 0, F.col("tokens")).otherwise(F.array().cast("array<string>")))
    return R.rescored(R.scored(pooled, asked), asked).withColumn("place", F.col("place").cast("long"))


_SAMPLE = 50


@query(_CTE + f"""SELECT doc, qid, rank FROM (SELECT doc, qid, rank, row_number() OVER (PARTITION BY doc ORDER BY qid, rank) AS r FROM pool WHERE rank <= greatest(1, {_SAMPLE} // (SELECT count(DISTINCT qid) FROM pool) + 1)) x WHERE r = 1 ORDER BY qid, rank LIMIT {_SAMPLE}""")
def probe_sample(t: Tables) -> DataFrame:
    """A sample of the index by probes: the best few of each question, a row only where the first probe saw it, fifty in all (the sample is the
    feature). Each probe brings so many that all of them together fill it."""
    few = max(1, _SAMPLE // max(1, _questions(t).count()) + 1)
    seen = R.nearest(_questions(t), t.embeddings.select(F.col("vec_id").alias("doc"), "embedding"), few)
    best = seen.groupBy("doc").agg(F.min(F.struct("qid", "rank")).alias("first"))
    return best.select("doc", "first.qid", F.col("first.rank").cast("long").alias("rank")).orderBy("qid", "rank").limit(_SAMPLE)


@query(_CTE + "SELECT qid, doc, dense, rank FROM pool")
def dense_topk(t: Tables) -> DataFrame:
    return _pool(t).withColumn("rank", F.col("rank").cast("long"))


def _index(t: Tables) -> VectorIndex:
    rows = t.embeddings.select(F.col("vec_id").alias("doc"), "embedding", "label", F.when(F.col("vec_id") % 3 == 0, "laws").otherwise("cases").alias("namespace"))
    return VectorIndex.build(rows, f"{shared_dir(t.spark)}/vectors-{uuid.uuid4().hex}")


@query()
def ivf_topk(t: Tables) -> DataFrame:
    """The pool through the index; the tests hold its recall against dense_topk."""
    return _index(t).search(_questions(t), R.POOL).withColumn("rank", F.col("rank").cast("long"))


@query(_CTE + "SELECT qid, doc, dense, rank FROM pool")
def ivf_every_list(t: Tables) -> DataFrame:
    """All lists probed: the exact pool."""
    return _index(t).search(_questions(t), R.POOL, every=True).withColumn("rank", F.col("rank").cast("long"))


@query(_CTE + "SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc) AS rank FROM dense d JOIN embeddings e ON e.vec_id = d.doc WHERE e.label IN (1, 2, 5) AND e.vec_id % 3 = 0) x WHERE rank <= 20")
def ivf_filtered(t: Tables) -> DataFrame:
    """A namespace and a metadata filter, pushed down to the lists' files."""
    of = (F.col("namespace") == "laws") & F.col("label").isin(1, 2, 5)
    return _index(t).search(_questions(t), 20, where=of, every=True).withColumn("rank", F.col("rank").cast("long"))


@query(_CTE + "SELECT doc_id, CAST(len(t) AS BIGINT) AS n, t[1] AS first_token, t[-1] AS last_token, md5(array_to_string(t, ' ')) AS digest FROM tok")
def tokenize(t: Tables) -> DataFrame:
    return _texts(t).select("doc_id", F.size("tokens").cast("long").alias("n"), F.get("tokens", F.lit(0)).alias("first_token"), F.try_element_at("tokens", F.lit(-1)).alias("last_token"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("SELECT doc_id, md5(translate(lower(text), 'ëç', 'ec')) AS folded FROM documents")
def fold(t: Tables) -> DataFrame:
    from docketry.functions import text

    return t.documents.select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query(_CTE + "SELECT qid, doc, bm25 FROM bm")
def bm25_rescore(t: Tables) -> DataFrame:
    return R.scored(*_pooled(t)).select("qid", "doc", "bm25")


@query(_CTE + "SELECT qid, doc, score FROM blend")
def hybrid_rescore(t: Tables) -> DataFrame:
    return R.blend(R.scored(*_pooled(t))).select("qid", "doc", "score")


@query(_CTE + "SELECT qid, doc, hrank FROM hyb")
def hybrid_rank(t: Tables) -> DataFrame:
    return _best(t).select("qid", "doc", F.col("hrank").cast("long").alias("hrank"))


@query(_CTE + "SELECT qid, doc, rerank FROM rer")
def rerank_topk(t: Tables) -> DataFrame:
    return _reranked(t).select("qid", "doc", "rerank")


@query(_CTE + "SELECT qid, doc, final FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, hrank) AS final FROM rer) x WHERE final <= 5")
def retrieval_cascade(t: Tables) -> DataFrame:
    return R.top_k(_reranked(t), R.TOP, F.desc("rerank"), F.asc("hrank"), rank="final").select("qid", "doc", F.col("final").cast("long").alias("final"))


@query("""SELECT vec_id, CAST(len(e) AS BIGINT) AS n, round(list_sum(e), 5) AS total FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_slice(CAST(embedding AS DOUBLE[]), 1, 32) ELSE list_concat(CAST(embedding AS DOUBLE[]), [0.0, 0.0]) END AS e FROM embeddings) x""")
def pad_embedding(t: Tables) -> DataFrame:
    wide = F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), 2))
    e = F.when(F.col("vec_id") % 2 == 0, F.slice(wide, 1, 32)).otherwise(wide)
    return t.embeddings.select("vec_id", e.alias("e")).select("vec_id", F.size("e").cast("long").alias("n"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_BANDS = "(SELECT doc_id, CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS score, CASE WHEN doc_id % 13 = 0 THEN 'status_verdict' WHEN doc_id % 13 = 1 THEN 'abolishing_law' ELSE 'article' END AS kind FROM documents) AS b"


@query(f"SELECT CAST(score AS DOUBLE) AS score, CASE WHEN kind = 'status_verdict' OR score >= 0.5 THEN 'strong' WHEN score >= 0.3 THEN 'moderate' WHEN score >= 0.18 THEN 'topical' ELSE 'weak' END AS band FROM {_BANDS}")
def score_band(t: Tables) -> DataFrame:
    s = F.col("score").cast("double")
    return t.made(_BANDS).select(s.alias("score"), F.when((F.col("kind") == "status_verdict") | (s >= 0.5), "strong").when(s >= 0.3, "moderate").when(s >= 0.18, "topical").otherwise("weak").alias("band"))


@query(f"SELECT a.doc_id, CAST(len(list_distinct(a.t)) AS BIGINT) AS n_distinct, md5(array_to_string(list_sort(list_distinct(a.t)), ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) a")
def distinct_tokens(t: Tables) -> DataFrame:
    return _texts(t).select("doc_id", F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"), F.md5(F.array_join(F.array_sort(F.array_distinct("tokens")), " ")).alias("digest"))
