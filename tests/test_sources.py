import json

from pyspark.sql import functions as F

from docweave.sources import files, sinks


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.doc").write_bytes(b"PK\x03\x04 zip inside")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c").write_bytes(bytes.fromhex("d0cf11e0") + b"x")
    (tmp_path / "d.html").write_text("<p>x</p>")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"a.pdf": "pdf", "b.doc": "zip", "c": "ole", "d.html": "html"}
    assert len(got["a.pdf"]["digest"]) == 64
    assert files.documents(spark, str(tmp_path), "*.pdf").count() == 1


def test_decoded(spark, tmp_path):
    (tmp_path / "u.html").write_bytes("한글 é".encode())
    (tmp_path / "k.html").write_bytes("한글".encode("cp949"))
    df = files.documents(spark, str(tmp_path), "*.html").select("path", files.decoded(F.col("content")).alias("t"))
    assert {r["path"][-6:]: r["t"] for r in df.collect()} == {"u.html": "한글 é", "k.html": "한글"}


def test_texts(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\nb")
    assert [r["text"] for r in files.texts(spark, str(tmp_path)).collect()] == ["a\nb"]


def test_catalog(spark, tmp_path):
    entries = [{"id": "1", "솔루션명": "old"}, {"id": "2", "솔루션명": "b", "강점": ["x", "y"]}, {"id": "1", "솔루션명": "new"}]
    (tmp_path / "c.json").write_text(json.dumps(entries, ensure_ascii=False))
    got = files.catalog(spark, str(tmp_path / "c.json")).orderBy("seq")
    assert [(r["id"], r["솔루션명"]) for r in got.collect()] == [("1", "new"), ("2", "b")]
    assert [r[0] for r in got.select(files.embedding_text()).collect()] == ["new", "b\nx, y"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "t1", ["a", "b"], "x"), (2, "t1", ["a"], None), (3, "t2", [], "z")], "id int, tab string, levels array<string>, note string")
    sinks.by_tab(df, str(tmp_path / "tabs"), "tab", ["id"])
    assert spark.read.parquet(str(tmp_path / "tabs")).filter("tab = 't1'").count() == 2
    deep = {r["id"]: (r["tab_depth"], r["level_1"], r["level_2"]) for r in sinks.level_columns(df, "tab", "levels").collect()}
    assert deep == {1: (2, "a", "b"), 2: (2, "a", ""), 3: (0, "", "")}
    assert [tuple(r) for r in sinks.fixed_columns(df, ["id", "note"]).orderBy("id").collect()] == [("1", "x"), ("2", ""), ("3", "z")]
    assert {r["note"] for r in sinks.masked_by_mode(df, "human", ["note"], []).collect()} == {""}
    sinks.json_rows(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert [r[0] for r in df.select(sinks.sheet_name(F.lit("a/b:" + "c" * 40))).limit(1).collect()] == ["a b " + "c" * 27]
