"""Operators on small tables: expected values, and properties against plain loops."""

import math
import random
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.functions import lawnum, text
from docketry.operators import chunking, dml, parsing, retrieval
from docketry.operators.tenancy import TenantView, leaked
from docketry.plans.base import Tables
from docketry.plans.registry import queries
from docketry.plans.retrieval import _pool, _pooled
from docketry.sources.files import docx_bytes, docx_paragraphs, text_files
from tests.conftest import SF


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("çështje ligji është 5 ab Neni 42"))) == ["ceshtje", "5", "42"]
    assert one(spark, text.tokens(F.lit(""))) == []


def test_canonical(spark):
    for raw, want in {"4 l77": "04/L-77", "4 l 077": "04/L-077", "8L035": "08/L-035", " 04 / L - 079 ": "04/L-079", "2004/32": "2004/32"}.items():
        assert one(spark, lawnum.canonical(F.lit(raw))) == want


def test_sections_follow_the_loop(spark):
    rng, rows, want = random.Random(0), [], {}
    for law in range(60):
        section = highest = 0
        for k in range(rng.randint(1, 25)):
            n = rng.randint(1, 12)
            if k and n <= highest:
                section, highest = section + 1, 0
            highest = max(highest, n)
            rows.append((str(law), k, str(n)))
            want[str(law), k] = section
    got = chunking.with_sections(spark.createDataFrame(rows, "law string, start int, number string")).collect()
    assert {(r.law, r.start): r.section for r in got} == want


def test_pack_paragraphs(spark):
    rng = random.Random(1)
    for _ in range(8):
        paras = ["x" * rng.randint(1, 60) for _ in range(rng.randint(1, 20))]
        parts = one(spark, chunking.pack_paragraphs(F.lit("\n\n".join(paras)), 50))
        assert all(len(p) <= 50 for p in parts)
        assert "".join(parts).replace("\n", "") == "".join(paras)


def test_chunk_law(spark):
    body = "Teksti i nenit është mjaft i gjatë për të mbetur në korpus. " * 2
    law = f"Gazeta zyrtare\nKreu I Dispozita\nNeni 1\nLënda\n{body}\nNeni 2 - Qëllimi\n{body}\nNeni 3\nx\nKreu II Tjera\nNeni 1\n{body}"
    got = {r.chunk_id: r for r in chunking.chunk_law(spark.createDataFrame([("02/L-10", law)], "law string, text string")).collect()}
    assert set(got) == {"02_L-10_art1", "02_L-10_art2", "02_L-10_d1_art1"}
    assert (got["02_L-10_art1"].title, got["02_L-10_art1"].chapter) == ("Lënda", "I")
    assert got["02_L-10_art2"].title == "Qëllimi" and got["02_L-10_d1_art1"].chapter == "II"


def test_bm25_prefers_the_match(spark):
    pool = spark.createDataFrame([(1, d, t.split()) for d, t in enumerate(["tax law code", "animal care animal law", "code law tax", "tax code", "law"])], "qid int, doc int, tokens array<string>")
    scores = retrieval.bm25(pool, spark.createDataFrame([(1, ["animal", "animal"])], "qid int, tokens array<string>")).collect()
    assert max(scores, key=lambda r: r.bm25).doc == 1 and sum(r.bm25 > 0 for r in scores) == 1


def test_texts_stay_beside_the_pools(spark):
    """A text that is in many pools is given once: the same scores as with its tokens on every row."""
    words = [["tax", "law", "code"], ["animal", "care", "animal"], [], ["code", "law", "tax", "law"]]
    pool = spark.createDataFrame([(q, d, 1.0 - d / 10, d + 1, words[d]) for q in range(3) for d in range(4) if (q + d) % 3], "qid long, doc long, dense double, rank int, tokens array<string>")
    asked = spark.createDataFrame([(0, ["law", "law", "animal"]), (1, ["tax"]), (2, [])], "qid long, tokens array<string>")
    bare, texts = pool.withColumn("dl", F.size("tokens")).drop("tokens"), pool.select("doc", "tokens").distinct()
    assert sorted(map(tuple, retrieval.bm25(bare, asked, texts).collect())) == sorted(map(tuple, retrieval.bm25(pool, asked).collect()))
    assert sorted(map(tuple, retrieval.rescore(bare, asked, texts=texts).collect())) == sorted(map(tuple, retrieval.rescore(pool, asked).collect()))


def _okapi_by_hand(pool, asked):
    """qid -> doc -> score; pool: qid -> doc -> tokens."""
    out = {}
    for qid, texts in pool.items():
        n, avgdl = len(texts), sum(len(t) for t in texts.values()) / len(texts)
        df = Counter(term for t in texts.values() for term in set(t))
        idf = {term: math.log(n - k + 0.5) - math.log(k + 0.5) for term, k in df.items()}
        low = 0.25 * sum(idf.values()) / max(1, len(idf))
        for doc, t in texts.items():
            hits = [(t.count(w), idf[w]) for w in asked.get(qid, []) if w in t]
            out[qid, doc] = sum((low if i < 0 else i) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for tf, i in hits)
    return out


def _shuffled_rows(spark, frame):
    """The rows of frame, and how many rows its shuffles wrote."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before, rows = total(), frame().collect()
    return rows, total() - before


def test_a_text_is_one_row_in_each_pool(spark):
    """BM25 shuffles a row for each text of a pool, not for each term of it."""
    words = {d: [f"w{(d * k) % 83}" for k in range(120)] + ["rare"] * (d % 5 == 0) for d in range(30)} | {30: []}
    pool = {q: {d: words[d] for d in range(31) if (q + d) % 4} for q in range(40)}
    asked = {q: [f"w{q}", "w0", "rare", "rare", "absent"] for q in range(38)} | {37: [], 99: ["w1"]}  # 38 and 39 ask nothing, 99 has no pool
    rows = spark.createDataFrame([(q, d, len(t)) for q, ts in pool.items() for d, t in ts.items()], "qid long, doc long, dl int")
    questions = spark.createDataFrame(list(asked.items()), "qid long, tokens array<string>")
    texts = spark.createDataFrame(list(words.items()), "doc long, tokens array<string>")
    got, shuffled = _shuffled_rows(spark, lambda: retrieval.bm25(rows, questions, texts))
    want = _okapi_by_hand(pool, asked)
    assert {(r.qid, r.doc) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.bm25 - want[r.qid, r.doc]) < 2e-6 for r in got) and any(r.bm25 > 0 for r in got)
    assert shuffled <= 2 * rows.count() + texts.count() + questions.count()


@pytest.mark.parametrize("name", ["retrieval_cascade", "bm25_rescore", "hybrid_rank", "rerank_topk"])
def test_pools_of_queries_are_shuffled_by_text(spark, name):
    """A whole query writes a few rows for each text of a pool, and none for each term."""
    t = Tables(spark, SF)
    pools = _pooled(t)[0].count()
    rows, shuffled = _shuffled_rows(spark, lambda: queries()[name](spark, SF))
    assert rows and shuffled < 10 * pools


def _shuffled_bytes(spark, frame):
    """The rows of frame, and how many bytes its shuffles wrote."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before, rows = total(), frame().collect()
    return rows, total() - before


def test_reranking_shuffles_no_texts(spark):
    """The cascade writes next to nothing that the scores of its pools don't need, also where nothing is small enough to be broadcast."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, cascade = _shuffled_bytes(spark, lambda: queries()["retrieval_cascade"](spark, SF))
        _, scores = _shuffled_bytes(spark, lambda: queries()["bm25_rescore"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert rows and cascade < 1.1 * scores


def test_overlap_is_told_with_the_scores(spark):
    """As the expression has it, for missing texts and questions too."""
    pool = spark.createDataFrame([(1, 10, ["a", "b", "b"]), (1, 11, []), (1, 12, None), (2, 10, ["a", "b", "b"]), (3, 10, ["a"])], "qid long, doc long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["b", "b", "c", "ë"]), (2, [])], "qid long, tokens array<string>")  # 3 isn't asked
    got = {(r.qid, r.doc): r.overlap for r in retrieval.scored(retrieval.with_packed(pool), asked).collect()}
    wanted = asked.withColumnRenamed("tokens", "wanted")
    want = {(r.qid, r.doc): r.o for r in pool.join(wanted, "qid").select("qid", "doc", retrieval.lexical_overlap(F.col("wanted"), F.col("tokens")).alias("o")).collect()}
    assert got == want | {(3, 10): None} and got[1, 10] == 0.333333


def test_a_cell_works_on_few_scores_at_a_time():
    """Of 64 questions and 65,536 vectors there are four million scores; the arrays that a task holds of them stay under 80 MB."""
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(64, 4)), rng.normal(size=(1 << 16, 4))
    tracemalloc.start()
    got = [tuple(map(np.copy, piece)) for piece in retrieval.best_of(np.arange(64), q, np.arange(1 << 16), v, 3)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    cosine = (q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)
    score = np.concatenate([s for _, _, s in got]).reshape(64, 3)
    assert np.allclose(score, np.round(-np.sort(-cosine, axis=1)[:, :3], 6), atol=2e-6)
    assert np.array_equal(np.concatenate([k for k, _, _ in got]), np.repeat(np.arange(64), 3)) and most < 80e6


def test_texts_go_to_pools_compressed(spark):
    """A task holds and sorts its pools' texts packed, in a third of the bytes of their distinct terms and counts."""
    words = {d: [f"word{(d * k) % 997:06}" for k in range(400)] for d in range(1, 61)}
    rows = spark.createDataFrame([(q, d, 400) for q in range(50) for d in words], "qid long, doc long, dl int")
    questions = spark.createDataFrame([(q, [f"word{q:06}"]) for q in range(50)], "qid long, tokens array<string>")
    texts = spark.createDataFrame(list(words.items()), "doc long, tokens array<string>")
    got, moved = _shuffled_bytes(spark, lambda: retrieval.bm25(rows, questions, texts))
    terms = 50 * sum(len(set(t)) * (10 + 4) for t in words.values())
    assert len(got) == 3000 and any(r.bm25 > 0 for r in got) and moved < terms / 3


def test_texts_of_pools_are_not_written(spark):
    """Only the pools' rows are written to the checkpoint folder, not their texts."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before, rows = size(), queries()["hybrid_rank"](spark, SF).collect()
    written, pools = size() - before, _pooled(Tables(spark, SF))[0].count()
    assert rows and written < 100 * pools


def test_cells_give_a_row_a_question(spark):
    """What the cells find goes on as one row for each question and cell: fewer rows are shuffled than a pool has."""
    t = Tables(spark, SF)
    rows, shuffled = _shuffled_rows(spark, lambda: _pool(t))
    assert len(rows) > 500 and shuffled < len(rows)


def test_nearest_is_the_best_of_all_scores(spark):
    """Over several cells, with many equal scores, more rows wanted than there are, and a question asked twice."""
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(d, [float(x) for x in rng.integers(-1, 2, 3)]) for d in range(1100)], "doc long, embedding array<float>")
    asked = vectors.where("doc % 100 = 0").withColumnRenamed("doc", "qid")
    scores = retrieval.dense_scores(asked, vectors)
    for k in (1, 30, 2000):
        want = retrieval.top_k(scores, k, F.desc("dense"), F.asc("doc"))
        assert sorted(map(tuple, retrieval.nearest(asked, vectors, k).collect())) == sorted(map(tuple, want.collect()))
    twice = retrieval.nearest(asked.unionByName(asked.where("qid = 100")), vectors, 4).where("qid = 100").orderBy("rank").collect()
    once = retrieval.nearest(asked, vectors, 2).where("qid = 100").orderBy("rank").collect()
    assert [(r.doc, r["rank"]) for r in twice] == [(once[k // 2].doc, k + 1) for k in range(4)]
    assert retrieval.nearest(asked, vectors.where("doc < 0"), 3).collect() == [] == retrieval.nearest(asked.where("qid < 0"), vectors, 3).collect()


def test_all_scores_of_many_blocks_shuffle_few_rows(spark, monkeypatch):
    """A vector goes to few cells, however few scores are given out at a time; equal scores of a cell stand together."""
    monkeypatch.setattr(retrieval, "SIDE", 64)
    rng = np.random.default_rng(7)
    made = {d: rng.integers(-1, 2, 3).astype(float) for d in range(1100)}
    vectors = spark.createDataFrame([(d, v.tolist()) for d, v in made.items()], "doc long, embedding array<float>").repartition(3)
    asked = vectors.where("doc % 2 = 0").withColumnRenamed("doc", "qid")
    got, shuffled = _shuffled_rows(spark, lambda: retrieval.dense_scores(asked, vectors))
    length = {d: np.sqrt(v @ v) for d, v in made.items()}
    want = {(q, d): made[q] @ v / (length[q] * length[d]) if length[q] * length[d] else 0.0 for q in range(0, 1100, 2) for d, v in made.items()}
    assert len(got) == len(want) and all(abs(r.dense - want[r.qid, r.doc]) < 1e-6 for r in got)
    assert shuffled < 6 * (1100 + 550)  # with a cell for 64 by 64, it was 18 and 9 times
    assert sum(a.dense != b.dense for a, b in zip(got, got[1:], strict=False)) < len(got) / 10


def test_texts_are_not_sorted_to_be_looked_up(spark):
    """Also where nothing is small enough to be broadcast, the pools' ids are held and the texts stream by."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _pooled(Tables(spark, SF))[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("ShuffledHashJoin" in line for line in semi)


def test_dml(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = dml.upsert(old, new, "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, dml.upsert(once, new, "id").collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, dml.insert_ignore(old, new, "id").collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_no_leak(spark):
    rows = spark.createDataFrame([(k, k % 3 if k % 4 else None) for k in range(50)], "id int, office_id int")
    for office in range(3):
        assert leaked(TenantView(rows, office).rows(), office).isEmpty()
    assert TenantView(rows, 1).stamp(rows).where("office_id IS NULL").isEmpty()


def test_files(spark):
    files = docx_bytes(spark.createDataFrame([(1, "one\n\ntwo "), (2, None)], "id long, text string"))
    broken = spark.createDataFrame([(3, bytearray(b"no zip"))], "id long, content binary")
    assert sorted(map(tuple, docx_paragraphs(files.unionByName(broken)).collect())) == [(1, 0, "one"), (1, 1, "two")]
    raw = spark.createDataFrame([("p", bytearray("ë".encode() + b"\xff"))], "path string, content binary")
    assert text_files(raw).first().text == "ë�"


def test_recursive_chunks():
    """Short enough, in order, nothing but white space lost, overlaps of at most a hundred characters; single cases by hand."""
    import random

    from docketry.operators.splitting import split

    assert split("") == [] and split(" a b ") == ["a b"] and split("x" * 2500) == ["x" * 1000, "x" * 1000, "x" * 700]
    assert split("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert split("aaa\n\nbbb ccc\n\nddd", 9, 0) == ["aaa", "bbb ccc", "ddd"]
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice(["word", "a", "longerword", " ", " ", "\n", "\n\n"]) for _ in range(rng.randint(0, 900)))
        found, at = split(text), 0
        assert all(0 < len(c) <= 1000 for c in found)
        place = 0
        for chunk in found:
            at = text.find(chunk, max(0, place - 101))
            assert at >= 0 and not text[place:at].strip()
            place = max(place, at + len(chunk))
        assert not text[place:].strip()


def test_registry_of_one_document(spark, tmp_path):
    """A document over several lines, a relation without its law, and a file that is no document."""
    from docketry.sources.reports import registry

    (tmp_path / "a.json").write_text('{"relations": [\n {"abolished": "1", "abolishing": "2", "kind": "full"},\n {"abolishing": "3"}\n]}')
    assert [tuple(r) for r in registry(spark, str(tmp_path)).collect()] == [("1", "2", "full")]
    (tmp_path / "a.json").write_text("{not json")
    assert registry(spark, str(tmp_path)).collect() == []


def test_rescore_leaves_what_it_cant_blend(spark):
    rows = [(1, 10, 0.9, 1, ["a"]), (1, 11, 0.8, 2, ["b", "b"]), (1, 13, 0.7, 3, ["c"]), (2, 10, 0.7, 1, []), (2, 12, 0.6, 2, []), (3, 10, 0.5, 1, ["a"]), (3, 11, 0.4, 2, ["b"])]
    pool = spark.createDataFrame(rows, "qid long, doc long, dense double, rank int, tokens array<string>")
    asked = spark.createDataFrame([(1, ["b"]), (2, ["b"]), (3, [])], "qid long, tokens array<string>")
    got = sorted(tuple(r) for r in retrieval.rescore(pool, asked, 0.0, 5).select("qid", "place", "doc", "score", "dense_score").collect())
    assert [r[:3] for r in got if r[0] == 1] == [(1, 1, 11), (1, 2, 10), (1, 3, 13)]  # the question's word wins
    assert [r for r in got if r[0] > 1] == [(2, 1, 10, 0.7, None), (2, 2, 12, 0.6, None), (3, 1, 10, 0.5, None), (3, 2, 11, 0.4, None)]
    dense = sorted(tuple(r) for r in retrieval.rescore(pool, asked, 1.0, 1).select("qid", "doc", "score", "bm25_score").collect())
    assert dense == [(1, 10, 0.9, None), (2, 10, 0.7, None), (3, 10, 0.5, None)]
    assert retrieval.rescore(pool.where("qid = 0"), asked, 0.5, 5).count() == 0


def test_near_misses_of_small_rules(spark):
    words = spark.createDataFrame([(w,) for w in ("p€r", "n3ni", "04/L-077", "1.Në", "11km", "a|b", "mirë")], "w string")
    assert {r.w for r in words.select("w", text.corrupt_token(F.col("w")).alias("bad")).where("bad").collect()} == {"p€r", "n3ni", "a|b"}
    scans = [("Neni 1 ........ 5", "Neni 1 5"), ("a . . . . b", "a b"), ("x -------- y", "x   y"), ("a    b", "a  b"), ("ok... fine", "ok... fine")]
    clean = [r.c for r in spark.createDataFrame([(i, s) for i, (s, _) in enumerate(scans)], "i int, s string").orderBy("i").select(text.normalize_ocr(F.col("s")).alias("c")).collect()]
    assert [c.split() for c in clean] == [w.split() for _, w in scans]


def test_rows_made_of_tables_keep_braces(spark):
    from docketry.plans.base import Tables
    from tests.conftest import SF

    got = Tables(spark, SF).made("(SELECT r_regionkey AS k, '{\"a\": 1}' AS j FROM region) AS x").collect()
    assert len(got) == 5 and {r.j for r in got} == {'{"a": 1}'}


ODD = ["", " \n\t\n", "\n\n  One \n two\n\n\n body \n x \n", "One", "One\nTwo", "One\n" + "y" * 199 + "\nlast", "One\n  " + "y" * 200 + "\nlast\n\n", "z" * 300 + "\nq\n\f\nFACTS\nsome\nORDER", "T\n\nPART A\nPART B\n\n b \nlow\nEND", "T\n\nfree\nfree too\nPART A\nx\nPART B", "T\n\n\n", None]


def _parsed(text, kind):
    lines = (text or "").split("\n")
    bare = [x.strip(" \t\n\x0b\f\r") for x in lines]
    first = next((k for k, x in enumerate(bare) if x), None)
    if first is None:
        return "", "", []
    stop = next((k for k in range(first + 1, len(bare)) if not bare[k] or len(bare[k]) >= 200), len(bare))
    body = "\n".join(lines[stop:]).strip(" \t\n\x0b\f\r")
    found = [(0, "MAIN", [])] if kind == "other" else []
    for line in filter(None, (x.strip(" \t\n\x0b\f\r") for x in body.split("\n"))):
        opens = line.startswith(parsing.CASE_HEADERS) if kind == "case_law" else kind == "other" and len(line) < 100 and line == line.upper() != line.lower()
        if opens:
            found.append((found[-1][0] + 1 if found else 1, line, []))
        elif found:
            found[-1][2].append(line)
    return " ".join(bare[first:stop]), body, [(n, t, "\n".join(c)) for n, t, c in found if c or 0 < n < found[-1][0]]


def test_titles_and_sections_of_odd_texts(spark):
    kinds = ("case_law", "other", "contract")
    rows = spark.createDataFrame([(k * 3 + j, kind, text) for k, text in enumerate(ODD) for j, kind in enumerate(kinds)], "id long, kind string, text string")
    bodies = rows.select("id", "kind", parsing.title_and_body(F.col("text")).alias("p")).select("id", "kind", "p.title", "p.body")
    assert {r.id: (r.title, r.body) for r in bodies.collect()} == {k * 3 + j: _parsed(text, None)[:2] for k, text in enumerate(ODD) for j in range(3)}
    cut = parsing.sections(bodies, "id")
    got = sorted((r.id, r.section, r.title, r.content) for r in cut.collect())
    assert got == sorted((k * 3 + j, *s) for k, text in enumerate(ODD) for j, kind in enumerate(kinds) for s in _parsed(text, kind)[2])
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()


def test_a_title_takes_one_look_at_each_line(spark):
    """Fifty thousand lines before the first empty one: two and a half thousand million looks, if each line asked for the others."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda k: F.concat(F.lit(" line "), k)), "\n")
    start = time.time()
    row = spark.range(1).select(parsing.title_and_body(F.concat(text, F.lit("\n\nbody"))).alias("p")).select(F.length("p.title").alias("n"), "p.body").first()
    assert row.body == "body" and row.n > 450_000 and time.time() - start < 60
