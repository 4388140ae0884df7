"""Languages and charsets of texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import language_model
from docketry.plans.registry import queries
from docketry.sources import charsets


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    found = {r.doc_id: r for r in language_model.detect(docs.where(held), language_model.learn(docs.where(~held))).collect()}
    want = {r.doc_id: r for r in docs.where(held).select("doc_id", "lang", "text").collect()}
    assert len(found) == len(want)
    long_enough = [k for k, r in want.items() if len(r.text.strip()) >= 20]
    assert sum(found[k].lang == want[k].lang for k in long_enough) >= 0.95 * len(long_enough)
    assert {r.lang for r in found.values()} >= {"en", "de", "fr", "es"}


def test_short_strange_and_empty(spark):
    docs = spark.createDataFrame([(1, "der hund und die katze sind hier", "de"), (2, "the dog and the cat are here", "en"), (3, "short", "en"), (4, None, "en"), (5, "  " * 30, None), (6, "12345 67890 12345 67890", "en"), (7, "der hund und die katze " * 3, None)], "doc_id long, text string, lang string")
    model = language_model.learn(docs)
    got = {r.doc_id: r for r in language_model.detect(docs, model, supported=("de",)).collect()}
    assert [got[k].lang for k in range(1, 8)] == ["de", "en", None, None, None, None, "de"]
    assert [got[k].supported for k in range(1, 8)] == [True, False, False, False, False, False, True]
    assert got[3].confidence is None and 0.5 < got[7].confidence <= 1
    assert abs(sum(r.p for r in language_model.probabilities(docs, model).where("doc_id = 1").collect()) - 1) < 1e-9
    nothing = language_model.learn(docs.limit(0))
    assert {r.lang for r in language_model.detect(docs, nothing).collect()} == {None}


def test_grams_are_not_rows(spark):
    """Sums in the tasks are those of a plain loop, for texts of odd letters; nothing of the texts is exploded or shuffled before them."""
    texts = ["Ärger über İstanbul, 3 Häuser! a", "a_b__c  ǅ 𝔘𝔫𝔦 x² ½ Straße", "l'été à Éze ... où", "日本語 テキスト ひらがな 한국어 123", "één twee drie vier vijf zes", "nothing  to\tsee here at all"]
    docs = spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    exploded = F.explode(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.substring(F.concat(F.lit("_"), w, F.lit("_")), k, F.lit(3)))))
    rows = docs.select("doc_id", "lang", exploded.alias("grams")).select("doc_id", "lang", F.explode("grams").alias("gram"))
    model = language_model.learn(docs)
    assert {r.gram for r in model.collect()} == {r.gram for r in rows.collect()}
    want = rows.join(model, "gram").select("doc_id", F.explode("weights").alias("l", "w")).groupBy("doc_id", "l").agg(F.sum("w").alias("w"))
    sums = language_model._sums(model.collect(), "doc_id")
    got = docs.select("doc_id", language_model._words("text").alias("words")).mapInArrow(sums, "doc_id long, weights map<string,bigint>")
    assert {(r.doc_id, k): v for r in got.collect() for k, v in r.weights.items()} == {(r.doc_id, r.l): r.w for r in want.collect()}


@pytest.mark.parametrize("data", [b"", b"a", "é".encode(), "😀 ok".encode(), b"\xc3", b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe0\x80\x80", b"\xf0\x8f\xbf\xbf", b"a\xc3b", b"\xe2\x82", "ﬀ€".encode() * 3])
def test_automaton(data):
    try:
        data.decode()
        want = True
    except UnicodeDecodeError:
        want = False
    assert charsets.is_utf8(data) == want


def test_automaton_on_random_bytes():
    rng = random.Random(5)
    for _ in range(20000):
        data = bytes(rng.choice((0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xED, 0xF0, 0xF4, 0xA0, 0x90, rng.randrange(256))) for _ in range(rng.randrange(6)))
        try:
            data.decode()
            want = True
        except UnicodeDecodeError:
            want = False
        assert charsets.is_utf8(data) == want, data


def test_six_charsets(spark):
    """Each text in each charset, by a model of other texts; broken bytes come out as something."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    detector = charsets.Detector(charsets.learn(docs.where("doc_id % 2 = 0")))
    right = count = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        for charset in charsets.CHARSETS:
            try:
                data = r.text.encode(charset)
            except UnicodeEncodeError:
                continue
            count += 1
            right += detector.decode(data)[1] == r.text
    assert right >= 0.995 * count and count > 2500
    assert detector.decode("﻿mark".encode()) == ("utf-8-sig", "mark") and detector.decode("﻿mark".encode("utf-16-be")) == ("utf-16-be", "mark")
    files = spark.createDataFrame([("a", b"\xff\xfe\x00"), ("b", None), ("c", bytes(range(256))), ("d", b"\x81\x8d\x8f\x90\x9d ok \xff"), ("e", b"\x00\x00\x00")], "path string, content binary")
    got = {r.path: r.text for r in charsets.decoded(files, detector).collect()}
    assert got["b"] == "" and len(got) == 5 and all(t is not None for t in got.values())


def test_a_capital_after_a_full_stop(spark):
    """Bytes that are a capital in one charset and a small letter in another: what stands before the space tells which."""
    said = ["il va été là éo un éon", "la fin. Èo dit. Èon va", "mot. Èonoi. Èoto"]
    detector = charsets.Detector(charsets.learn(spark.createDataFrame([(k, said[0] if k < 30 else said[1 + k % 2]) for k in range(40)], "doc_id long, text string")))
    for t in ("es re paon. Èonoioi menti", "es re paon éonoioi menti"):
        for charset in charsets.SINGLE[:2]:
            assert detector.decode(t.encode(charset)) == (charset, t)


#: Texts that say little, often: what is repeated, or what letters are likely without regard to the language, misleads. By the charset they are written in.
_REPEATED = {
    "cp850": "Öung tezu der. Enkeit tepf gekeit, st entz.\n" + "Ensch. " * 17 + "Äen " * 17 + "enungungver " * 17,
    "windows-1252": "Ouou, " * 40 + "ouen, " * 3 + "ément. " * 38,
    "mac_roman": "den, " * 20 + "öenen. " * 102,
}


def test_repeats_and_languages(spark):
    """A word said often is evidence once; a letter of another language than what stands near is unlikely."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    detector = charsets.Detector(charsets.learn(docs))
    for text in (*_REPEATED.values(), "einver äenie."):
        for charset in charsets.SINGLE:
            assert detector.decode(text.encode(charset)) == (charset, text)


def test_txt_decode_of_repeats(spark, tmp_path):
    """The query over a table that has such texts gives them all back."""
    more = [(charsets.CHARSETS.index(c) + 6 * 10**6, t) for c, t in _REPEATED.items()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in queries()["txt_decode"](spark, str(tmp_path)).collect()}
    want = {r.doc_id: hashlib.md5(r.text.strip(" \t\n\v\f\r").encode()).hexdigest() for r in docs.collect()}
    assert got == want
