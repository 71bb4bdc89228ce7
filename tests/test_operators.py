"""Golden cases on small frames."""

import random

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import dedup, edit, html, joins, order, quality, search, split


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_keys_and_predicates(spark):
    assert col(spark, [" a \t b\n", "", None], tx.norm) == ["a b", "", None]
    assert col(spark, ["a-한글 1!", ""], tx.sig) == ["a한글1", ""]
    assert col(spark, ["SFR-001", "REQ_12", "long label 12", "12345"], tx.looks_like_code) == [True, True, False, True]
    assert col(spark, ["label", "", None, "a sentence.", "x" * 49], tx.valid_label) == [True, False, False, False, False]
    assert col(spark, ["- 12 -", "2024.01.02", "title ........ 12", "a real detail", "ab", None], tx.junk_detail) == [True, True, True, False, True, True]


def test_marker_pieces(spark):
    got = col(spark, ["①first\n②second\n③third", "intro\n1) a\nb\n2) c", "- x\n- y", "- x\n1. y\n- z", "", "plain"], tx.marker_pieces)
    assert got == [["①first", "②second", "③third"], ["intro", "1) a\nb", "2) c"], ["- x", "- y"], ["- x", "1. y\n- z"], [], ["plain"]]


def test_joined_lines(spark):
    assert col(spark, ["a\nb\nc.\nd", "x,\ny", "", "a\n1) b"], tx.joined_lines) == ["a b c.\nd", "x,\ny", "", "a\n1) b"]


def test_chunks(spark):
    text = "".join(random.Random(1).choices("abc \n.", k=5000))
    got = col(spark, [text, "", "short"], tx.fixed_chunks, "string")
    assert [c["text"] for c in got[0]] == [text[i : i + 1000] for i in range(0, 4001, 800)]
    assert got[1] is None and [tuple(c) for c in got[2]] == [(0, 0, "short")]
    spans = split.chunk_spans(text, 300, 60)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < e - s <= 300 for s, e in spans)
    assert all(a < c <= b < d for (a, b), (c, d) in zip(spans, spans[1:]))


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "abcd"), ("network", "netting"), ("a", "b"), ("", "x"), ("same", "same")], "a string, b string")
    got = [r[0] for r in df.select(tx.label_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.9 and abs(got[1] - 3 / 7) < 1e-9 and got[2:] == [0.0, 0.0, 1.0]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in v.select(tx.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]
    g = col(spark, ["abcd", "ab", ""], lambda c: tx.grams(c, 3))
    assert g == [["abc", "bcd"], ["ab"], []]


def test_running_across_blocks(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), i, rng.randint(-5, 5)) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(data, "g string, s int, v int").repartition(5)
    got = {(r["g"], r["s"]): (r["n"], r["m"]) for r in order.running(df, ["g"], "s", {"n": ("sum", F.lit(1)), "m": ("max", F.col("v"))}, block=16).collect()}
    for g, s, _ in data:
        upto = [v for h, t, v in data if h == g and t <= s]
        assert got[(g, s)] == (len(upto), max(upto))


def test_carry_and_islands(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "", ""), (3, "", "y"), (4, "B", ""), (5, "", "")], "s int, top string, mid string").withColumn("t", F.lit(0))
    got = [tuple(r) for r in order.fill_down(df, ["t"], "s", ["top", "mid"]).orderBy("s").select("top", "mid").collect()]
    assert got == [("A", "x"), ("A", "x"), ("A", "y"), ("B", ""), ("B", "")]
    runs = order.islands(df.withColumn("k", F.expr("CASE WHEN s < 3 THEN 'a' WHEN s = 4 THEN NULL ELSE 'b' END")), ["t"], "s", "k")
    assert [r[0] for r in runs.orderBy("s").select("run").collect()] == [1, 1, 2, 3, 4]


def test_spans(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 2), (5, 1)], "s int, level int").withColumn("d", F.lit(0))
    assert [r[0] for r in order.spans(df, ["d"], "s", "level").orderBy("s").select("end_seq").collect()] == [5, 4, 4, 5, None]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_pairs_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.randrange(50) for _ in range(30)] for _ in range(12)]
    sets = {}
    for i in range(60):
        s = list(base[i % 12])
        for _ in range(rng.randrange(4)):
            s[rng.randrange(30)] = rng.randrange(50)
        sets[i] = s
    df = spark.createDataFrame([(i, "x", [str(v) for v in s]) for i, s in sets.items()], "id int, b string, s array<string>")
    got = {(r["a"], r["b"]) for r in dedup.shingle_pairs(df, "id", "b", F.col("s")).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and round(len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])), 6) >= 0.8}
    assert got == want and want


def test_distinct_first_and_merge(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, ""), (4, None), (5, "b")], "s int, k string")
    assert sorted(r["s"] for r in dedup.distinct_first(df, ["k"], "s").collect()) == [1, 5]
    labels = spark.createDataFrame([("data", 3), ("big data", 1), ("big data lake", 1), ("x", 1)], "label string, n int")
    assert {r["label"]: r["merged"] for r in dedup.substring_merge(labels, "label", "n").collect()} == {"data": "big data", "big data": "big data lake", "big data lake": "big data lake", "x": "x"}


def test_chain_and_places(spark):
    a = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("p", "q"), ("q", "p")], "k string, t string")
    assert {r["alias"]: r["root"] for r in joins.resolved(a, "k", "t").filter("alias NOT IN ('p', 'q')").collect()} == {"b": "a", "c": "a", "d": "a", "x": "y"}
    df = spark.range(500).select((F.col("id") * 7 % 501).alias("v")).repartition(7)
    assert [r["p"] for r in joins.placed(df, ["v"], "p").orderBy("v").collect()] == list(range(1, 501))


def test_edit(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "", 2)], "id int, code string, v int")
    new = spark.createDataFrame([(9, "a", 5), (3, "", 3)], "id int, code string, v int")
    assert sorted(tuple(r) for r in edit.upsert(old, new, "code", "id").collect()) == [(2, "", 2), (3, "", 3), (9, "a", 5)]
    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z")], "g int, s int, t string")
    assert sorted(tuple(r) for r in edit.merged(rows, {2: 0}, "s", "g", "t").collect()) == [(1, 0, "x\nz"), (1, 1, "y")]


def test_versions(spark, tmp_path):
    at = str(tmp_path / "cache")
    df = spark.createDataFrame([("aa1", 1), ("bb1", 2)], "h string, v int")
    edit.save_version(df, at, 14, "h")
    edit.save_version(spark.createDataFrame([("bb2", 3)], "h string, v int"), at, 14, "h")
    assert sorted(r["v"] for r in edit.load_version(spark, at, 14).collect()) == [1, 3]
    assert edit.load_version(spark, at, 13).count() == 0


def test_html(spark):
    page = "<h1>T</h1><p>a <b>b</b></p><ul><li>x<li>y</ul><table><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr></table><script>p</script>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert [(r["tag"], r["text"]) for r in html.blocks(df).orderBy("block").collect()] == [("h1", "T"), ("p", "a b"), ("li", "x"), ("li", "y")]
    assert [[r["row"], r["col"], r["text"]] for r in html.cells(df).orderBy("row", "col").collect()] == [[0, 0, "r"], [0, 1, "1"], [1, 0, "r"], [1, 1, "2"]]
    assert html.pipe_rows(html.table_text([["a", "b"], ["1", "2"]])) == [["a", "b"], ["1", "2"]]


def test_search_top_k_and_hybrid(spark):
    scored = spark.createDataFrame([(1, i, float(i % 3)) for i in range(50)], "query int, doc int, score double")
    assert [(r["doc"], r["rank"]) for r in search.top_k(scored, "query", "score", "doc", 3).orderBy("rank").collect()] == [(2, 1), (5, 2), (8, 3)]
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, doc int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query int, doc int, rank int")
    assert [r["doc"] for r in search.hybrid(a, b, 3).orderBy("rank").collect()] == [10, 11, 12]


def test_quality(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (2, 3)], "g int, n int")
    assert sorted(tuple(r) for r in quality.numbering_gaps(rows, "g", "n", expand=True).collect()) == [(1, 3), (1, 4)]
    df = spark.createDataFrame([(" ", "x"), (None, "")], "a string, b string")
    assert quality.filled_columns(df, ["a", "b"]) == ["b"]
