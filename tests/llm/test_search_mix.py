"""Operators 11 to 13 against brute force, on texts with every odd case."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docketry.llm import fill_middle, lexical_search, mixing, registry
from tests.compare import connect, rows_of_spark, rows_of_sql
from tests.conftest import SF
from tests.llm.cases import TEXTS, documents, empty, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def ranking(docs, items):
    """The contract of the search, item by item and document by document. docs and items are lists of (id, text)."""
    counts = [(d, Counter(terms(t))) for d, t in docs if d is not None and terms(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    found = []
    for i, wanted in asked.items():
        scores = []
        for d, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, d))
        found += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:10], 1)]
    return sorted(found)


def searched(docs, items, **more):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(docs, items, **more).collect())


@pytest.fixture(scope="module")
def corpus(spark):
    more = {100 + k: prose(f"more{k}", 5 + 7 * k % 60) + (" Rare%d" % (k % 17)) for k in range(160)}
    copies = {400 + k: "the Same hot lines OVER and over, zebra" for k in range(90)}
    texts = TEXTS | more | copies
    return documents(spark, texts), [*texts.items(), (None, "x"), (2, TEXTS[2])]


ITEMS = [(1, "zebra Same hot"), (2, TEXTS[7]), (3, None), (4, ""), (5, "ÉTÉ grüße"), (6, "rare3 RARE4 rare5"), (7, "nowhere"), (8, "lazy dogs"), (8, "rare1 rare1"), (None, "zebra"), (9, prose(12, 900)), (10, "rare3"), (11, "日本語 テキスト -- ab")]


def test_search(spark, corpus, monkeypatch):
    docs, plain = corpus
    items = spark.createDataFrame([(i, t, 1, "n") for i, t in ITEMS], "item_id long, text string, term int, n string")
    want = ranking(plain, ITEMS)
    assert len({i for i, *_ in want}) == 8
    assert searched(docs, items) == want
    assert searched(docs, items, block=5) == want  # several passes
    assert searched(docs, items, best=3) == [r for r in want if r[1] <= 3]
    monkeypatch.setattr(lexical_search, "PAIRS", 3)
    assert searched(docs, items.where("item_id in (1, 6)")) == [r for r in want if r[0] in (1, 6)]
    monkeypatch.undo()
    monkeypatch.setattr(lexical_search, "TIERS", (2, 20))
    assert searched(docs, items) == want


def test_search_by_tier(spark, corpus, monkeypatch):
    """Items with proof stop early; others fall through to the store. The group of copies is in no upper tier, and is found."""
    docs, _ = corpus
    monkeypatch.setattr(lexical_search, "TIERS", (12, 89))
    items = spark.createDataFrame([(1, "rare3"), (2, "zebra")], "item_id long, text string")
    assert {r.item_id: r.tier for r in lexical_search.search(docs, items).collect()} == {1: 0, 2: 2}
    monkeypatch.setattr(lexical_search, "TIERS", (12, 90))
    assert {r.tier for r in lexical_search.search(docs, items.where("item_id = 2")).collect()} == {1}


def test_search_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for docs, asked in ((empty(spark), items), (documents(spark), items.limit(0)), (documents(spark).where("doc_id in (3, 4, 5)"), items)):
        found = lexical_search.search(docs, asked)
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score", "tier"]


def test_search_long_sums():
    """A task that sees its documents in many batches keeps the best of each item, ties by doc_id."""
    import numpy as np

    sums = lexical_search._Sums(np.array([7, 9]), np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([3, 5]), np.array([1, 1]), 2)
    for at in range(40):
        sums.add(np.array([100 - at]), np.array([2]), np.array([0, 1]), np.array([10, 4 + at % 3]))
    sums.settle()
    assert [x.tolist() for x in sums.held] == [[0, 0, 1, 1], [30, 30, 60, 60], [61, 62, 62, 65]]


def test_fill_middle(spark):
    more = {1000 + k: prose(f"f{k}", k % 23) + " \n\t" * (k % 3) for k in range(300)} | {50: "a <P> b", 51: "<S>", 52: "x <M>", 53: "< P> <<P S", 54: " \x0b\x0c\x1c\x85  x "}
    texts = TEXTS | more
    docs = documents(spark, texts)
    got = fill_middle.digests(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = got.collect()
    assert len(rows) == len(texts) + 1  # one is there twice, one has no doc_id
    forms = Counter()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        text = texts[r.doc_id] or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        digest = hashlib.sha256(f"42:{r.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        chars = (None, None) if form == "plain" else (len(p), len(m))
        assert tuple(r) == (r.doc_id, len(units), form, *chars, sha(output), sha(text))
        forms[form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 10
    assert fill_middle.digests(empty(spark)).count() == 0
    all_cut = fill_middle.transform(docs, seed=7, rate=100, suffix_first=0)
    assert {r.form for r in all_cut.collect()} == {"plain", "psm"}
    assert all_cut.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).where("doc_id = 12").first().t == TEXTS[12]


def aims(sizes):
    """Targets by the letter: shares, cut at twice the size, the excess dealt again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in open_)
        open_ = {s for s in open_ if target[s] < 2 * sizes[s]}
        target = {s: min(t, 2.0 * sizes[s]) for s, t in target.items()}
    return target


def mixture(spark):
    texts, sources = {}, {}
    for k in range(900):
        texts[k], sources[k] = prose(f"m{k % 400}", (k * 37) % 90), ("a" if k % 3 == 0 else ["é", "Z", "big", None, "", "tiny", "none"][k % 7])
    texts |= {901: prose("long", 4000), 902: None, 903: ""}
    sources |= {901: "Z", 902: "a", 903: "none"}
    for k in range(900):
        if sources[k] == "none":
            texts[k] = "  "
        if sources[k] == "tiny" and k > 60:
            sources[k] = "a"
    rows = [(k, texts[k], sources[k], 1, 2.0, "x") for k in texts] + [(5, texts[5], sources[5], 1, 2.0, "x"), (None, "no id", "a", 1, 2.0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double, key string").repartition(5), rows


def test_mixing(spark):
    docs, plain = mixture(spark)
    got = mixing.mix(docs)
    rows = got.collect()
    size, source = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in plain}, {r[0]: r[2] for r in plain}
    whole, count = Counter(), Counter()
    for r in plain:
        if r[0] is not None:
            whole[r[2]] += size[r[0]]
            count[r[2]] += 1
    assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in plain if r[0] is not None)
    want, taken, rated, least = aims(whole), Counter(), Counter(), {}
    for r in rows:
        assert (r["size"], r.source, r.source_size) == (size[r.doc_id], source[r.doc_id], whole[r.source])
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and 0 <= r.copies <= 2 and r.taken == r.copies * r["size"] and abs(r.copies - r.rate) < 2
        taken[r.source] += r.taken
        rated[r.source] += r.rate * r["size"]
        if r["size"]:
            least[r.source] = min(least.get(r.source, 1 << 60), r["size"])
    assert any(t == 2 * whole[s] > 0 for s, t in want.items()) and any(0 < t < whole[s] for s, t in want.items())
    for s in whole:
        assert rated[s] == pytest.approx(want[s], rel=1e-7, abs=1e-6)  # the rates meet the token constraints
        assert abs(taken[s] - want[s]) <= max(1, 2 * least.get(s, 0), 0.002 * want[s])
    # an exponential tilt: the logarithm of the rate is linear in the size, up to the cap
    for s in whole:
        points = {r["size"]: math.log(r.rate) for r in rows if r.source == s and r["size"] and r.rate < 2}
        if len(points) > 2:
            slopes = [v / k for k, v in points.items()]
            assert max(slopes) - min(slopes) < 1e-9
    again = mixing.mix(docs.repartition(2, "text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixing_hot_group(spark):
    """One size holds nearly all of a source: its copies are spread over the buckets, and come out to the number."""
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 10 < 8, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.countDistinct("rate").alias("rates"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()
    assert all(abs(r.taken - r.target) <= 3 and r.rates == 1 and r.most - r.least <= 1 for r in got)


def test_mixed_corpus(spark):
    docs, _ = mixture(spark)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    made = mixing.mixed_corpus(docs)
    assert made.columns == docs.columns
    assert Counter(r.doc_id for r in made.select("doc_id").collect()) == +want
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_corpus(empty(spark)).count() == 0
    assert mixing.mix(documents(spark)).count() == len(TEXTS) + 1
    nothing = mixing.mix(documents(spark).where("doc_id in (3, 4, 5)")).collect()
    assert [(r.taken, r.target) for r in nothing] == [(0, 0.0)] * 3


def test_native():
    """Operator 11 has DataFrame functions alone."""
    source = open(mixing.__file__).read()
    assert not re.search(r"mapIn|applyIn|udf|\.rdd|toPandas|import (numpy|pandas|pyarrow)", source)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    """The whole tables through the query and through its SQL."""
    assert rows_of_spark(registry.queries()[name](spark, SF)) == rows_of_sql(connect(SF), registry.oracle_sql()[name])
