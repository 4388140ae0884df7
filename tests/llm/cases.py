"""Small document tables with every odd case, and their schema."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, b int, key string, rest string, score double"
WORDS = "the quick brown fox jumps over lazy dogs while seven wise owls watch from tall green trees near cold river banks every single morning".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


PASSAGE = prose("passage", 40)
TEXTS = {
    0: prose(0, 80),
    1: prose(0, 80),  # an exact copy
    2: prose(0, 80) + " end",  # a near copy
    3: None,
    4: "",
    5: "   \n\t ",
    6: "one",
    7: PASSAGE + "\n" + prose(7, 50),
    8: prose(8, 50) + "\n" + PASSAGE,
    9: "a" * 400,
    10: "a" * 300 + "b",
    11: "ab " * 400,
    12: prose(12, 9000),  # very long
    13: "Grüße über die Straße, çështje ë; 日本語 テキスト 😀 " * 6,
    14: "BUY NOW!! " * 60,
    15: "x | y | z\n" * 40,
    16: "\x00\x01 odd  spaces   and\r\nreturns ",
    17: "<|endoftext|> said <s> and ▁ too",
    18: prose(18, 30) + "\n" + prose(18, 30),
}


def rows(texts=None):
    return [(k, t, ("en", "de", None)[k % 3], f"s{k % 2}", len(t or ""), k, None, "r", 0.5) for k, t in (texts or TEXTS).items()]


def documents(spark, texts=None, repeated=True):
    made = rows(texts)
    made.append((None, "a row without doc_id", "en", "s0", 1, 1, None, "r", None))
    return spark.createDataFrame(made + (made[2:3] if repeated else []), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    made = [(k, int(k not in (14, 15, 11, 9)), 0) for k in TEXTS] + [(None, 1, 0), (99, None, 0)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")
