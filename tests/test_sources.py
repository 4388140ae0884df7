"""The table function and the folder source."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from docketry.functions import batches, text
from docketry.operators import chunk_function, chunking
from docketry.sources import files, folders, reports

BODY = "Teksti i nenit është mjaft i gjatë për të mbetur në korpus. "
LAW = f"Gazeta zyrtare\nNeni pa numër\nKreu I Dispozita\nNENI 1\n  \nLënda\n{BODY * 2}\nNeni 2 - Qëllimi.\n{BODY}\r\nneni 3\nx\nKreu II Tjera\nNeni 1\n1. jo titull\n{BODY}\nNeni 4\nMe pikë. brenda\n{BODY}\n\n{BODY * 3}\n \n{BODY * 9}\nNeni  5 :\n{BODY * 12}"


def test_table_function_gives_the_chunker_s_rows(spark):
    laws = spark.createDataFrame([("02/L-10", LAW), ("x y/é", LAW.replace("Neni 1", "Neni 12")), ("empty", ""), ("none", None), ("short", "Neni 1\nx")], "law string, text string")
    lines = laws.select("law", F.posexplode(F.split("text", "\n")).alias("pos", "line")).repartition(5)
    for most in (12_000, 300, 70):
        want = sorted(map(tuple, chunking.chunk_law(laws, most).select("law", "number", "title", "chapter", "chunk_id", "chunk_type", "content").collect()))
        assert want and sorted(map(tuple, chunk_function.chunk_lines(lines, most).collect())) == want
    chunk_function.register(spark)
    numbered = spark.sql("SELECT * FROM chunk_laws(TABLE(SELECT 7 AS law, pos, line FROM {lines} WHERE law = '02/L-10'))", lines=lines)
    assert dict(numbered.dtypes)["law"] == "int" and {r.law for r in numbered.collect()} == {7}  # the law's type is the caller's
    with pytest.raises(Exception, match="misses columns"):
        spark.sql("SELECT * FROM chunk_laws(TABLE(SELECT law FROM {lines}))", lines=lines).collect()


def make(path, *names):
    for name in names:
        os.makedirs(f"{path}/{name}")
        with open(f"{path}/{name}/law.txt", "w") as f:
            f.write(name)


def test_only_chosen_folders_are_planned(tmp_path):
    make(tmp_path, "04_L-1", "02_L-9", "03_L_7")
    (tmp_path / "loose.txt").write_text("no folder")
    reader = lambda limit=None: folders.FolderReader(str(tmp_path), "*.txt", limit)
    plan = lambda r: [p.name for p in r.partitions()]
    assert plan(reader()) == ["02_L-9", "03_L_7", "04_L-1"] and plan(reader(2)) == ["02_L-9", "03_L_7"]
    chosen = reader(1)
    left = list(chosen.pushFilters([In(("law",), ("04/L-1", "03/L_7")), GreaterThan(("bytes",), 1)]))
    assert left == [GreaterThan(("bytes",), 1)] and plan(chosen) == ["03_L_7"]
    none = reader()
    assert not list(none.pushFilters([EqualTo(("folder",), "04_L-1"), EqualTo(("law",), "02/L-9")])) and plan(none) == []


def test_unchosen_folders_stay_closed(spark, tmp_path):
    make(tmp_path, "04_L-1", "02_L-9")
    os.makedirs(tmp_path / "05_L-5")
    os.symlink("/nowhere/at/all", tmp_path / "04_L-1" / "broken.txt")
    folders.register(spark)
    rows = spark.read.format("law_folders").option("pattern", "*.txt").load(str(tmp_path))
    got = rows.where("law = '02/L-9'").collect()
    assert [(r.folder, r.name, r.content) for r in got] == [("02_L-9", "law.txt", bytearray(b"02_L-9"))]
    assert rows.where("law = '02/L-9'").rdd.getNumPartitions() == 1
    assert [(r.law, r.name) for r in rows.where("folder = '05_L-5' AND law LIKE '05%'").collect()] == [("05/L-5", None)]
    assert rows.where("law = 'x'").count() == 0


def test_folders_are_written_by_tasks(spark, tmp_path):
    """What the source writes, it reads: a folder a row, without a file where the row names none; a second write of the same changes nothing."""
    folders.register(spark)
    rows = spark.createDataFrame([(f"{k % 9:02d}_L-{k}", "law.txt" if k % 7 else None, f"text {k}".encode() if k != 8 else None) for k in range(300)], "folder string, name string, content binary")
    for _ in range(2):
        rows.repartition(7).write.format("law_folders").mode("append").save(f"{tmp_path}/laws")
        got = {r.law: (r.name, r.content) for r in spark.read.format("law_folders").option("pattern", "*.txt").load(f"file://{tmp_path}/laws").collect()}
        assert got == {f"{k % 9:02d}/L-{k}": (("law.txt", bytearray(f"text {k}".encode() if k != 8 else b"")) if k % 7 else (None, None)) for k in range(300)}
    assert not [x for _, _, names in os.walk(tmp_path) for x in names if x != "law.txt"]
    with pytest.raises(Exception, match="only added"):
        rows.write.format("law_folders").mode("overwrite").save(f"{tmp_path}/laws")
    with pytest.raises(Exception, match="a folder, the name"):
        rows.drop("name").write.format("law_folders").mode("append").save(f"{tmp_path}/laws")


def test_catalog_and_word_files(spark, tmp_path):
    lines = ['{"laws": [{"number": "04/L-1", "title": "a"}, {"number": null, "title": "b"}, {"title": "c"}, {"number": "04/L-1", "title": "d", "url": "u"}]}', '{"laws": [{"num', "", "[]", '{"laws": null}', '{"other": 1}', '{"laws": [{"number": "x"}]}']
    (tmp_path / "catalog.json").write_text("\n".join(lines))
    assert sorted(map(tuple, reports.catalog(spark, str(tmp_path)).collect()), key=str) == [("04/L-1", "d", "u"), ("x", None, None)]
    made = files.docx_bytes(spark.createDataFrame([(1, " a \n\n b"), (2, ""), (3, None)], "id long, text string"))
    broken = spark.createDataFrame([(4, b"no zip"), (5, None)], "id long, content binary")
    assert {r.id: r.text for r in files.docx_text(made.unionByName(broken)).collect()} == {1: "a\n\nb", 2: "", 3: "", 4: "", 5: ""}


def test_batches_come_in_pieces():
    texts = ["a" * k for k in range(600)] + [None, "é" * 3_000_000, "b", "c" * 5_000_000] + [None] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    found = list(batches.pieces(iter([batch, batch.slice(0, 0)]), "text"))
    assert [k for p in found for k in p["id"].to_pylist()] == list(range(len(texts))) and [t for p in found for t in p["text"].to_pylist()] == texts
    assert max(p.num_rows for p in found) == batches.ROWS and all(p.num_rows < 2 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= batches.BYTES for p in found)


def test_only_texts_beyond_ascii_leave_the_engine(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "plain"), (2, "ﬁn ①"), (3, ""), (4, None), (5, "é")], "id long, text string")
    assert {r.id: r.t for r in rows.select("id", text.compatible(F.col("text")).alias("t")).collect()} == {1: "plain", 2: "fin 1", 3: "", 4: None, 5: "é"}
    monkeypatch.setattr(text, "_nfkc", lambda c: F.when(c.isNotNull(), "sent"))
    assert {r.id: r.t for r in rows.select("id", text.compatible(F.col("text")).alias("t")).collect()} == {1: "plain", 2: "sent", 3: "", 4: None, 5: "sent"}
