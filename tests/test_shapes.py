import math
import random

from pyspark.sql import functions as F

from docweave.functions import embed
from docweave.operators import labels, scorer, states, tables
from docweave.plans import registry


def test_canonical_golden(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["데이터수집", "데이터수집", " 니터링 ", "니터링", "", None, "network core", "network core", "network cord"])], "i int, c string")
    got = labels.canonical(rows, "c", aliases={"데이터수집": "데이터 수집"}, truncations={"니터링": "모니터링"}).orderBy("i")
    assert [r["canonical"] for r in got.collect()] == ["데이터 수집"] * 2 + ["모니터링"] * 2 + ["기타"] * 2 + ["network core"] * 3


def test_tabs(spark):
    rows = spark.createDataFrame([(i, "SIP (IP-PBX)") for i in range(5)] + [(9, "SIP (Protocol)")], "i int, tab string")
    assert {r["tab"] for r in labels.consolidated(rows, "tab").collect()} == {"SIP (IP-PBX)"}
    spelled = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "ab"), (4, "c")], "i int, tab string")
    assert [r["tab"] for r in labels.common_spelling(spelled, "tab", "i").orderBy("i").collect()] == ["ab", "ab", "ab", "c"]


def test_even_sample(spark):
    rows = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("int").alias("s"))
    got = sorted(r["s"] for r in labels.even_sample(rows, "g", "s", 7).collect())
    assert got == [math.floor(k * 99 / 6 + 0.5) for k in range(7)]


def test_prefix_and_drop(spark):
    df = spark.createDataFrame([("a", "x y z"), ("a", "x y"), ("b", "q"), ("c", "m n"), ("c", "k n")], "g string, t string")
    assert {r["g"]: r["prefix"] for r in labels.common_prefix(df, "g", "t").collect()} == {"a": "x y", "b": "q", "c": ""}
    assert labels.capped_drop(df, F.col("g") == "a").count() == 5 and labels.capped_drop(df, F.col("g") == "b").count() == 4


def test_roles(spark):
    df = spark.createDataFrame([(1, "a", 0, 0.9), (1, "b", 0, 0.8), (1, "a", 1, 0.7), (1, "b", 1, 0.1), (1, "c", 2, 0.0)], "t int, role string, col int, score double")
    assert sorted(tuple(r) for r in labels.roles(df, "t").collect()) == [(1, "a", 0), (1, "b", 1)]


def test_tables(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a"],), ([],)], "r array<string>")
    assert [r[0] for r in df.select(tables.without_echo(F.col("r"))).collect()] == [["a", "b", "a"], []]
    t = spark.createDataFrame([("1) a\nb: c\nplain",), ("one",), ("A long sentence without any label here.\nAnother one ends.",), ("",)], "t string")
    assert [r[0] for r in t.select(tables.continuity(F.col("t"))).collect()] == [0.83, 0.0, 0.0, 0.0]
    assert [r[0] for r in t.select(tables.ornament(F.lit("-----"))).limit(1).collect()] == [True]
    pairs = spark.createDataFrame([(1, 0, "ID", "R1"), (1, 1, "Name", "n"), (1, 2, "Detail", "d1"), (1, 3, "Detail", "d2"), (1, 4, "ID", "R2")], "f int, s int, l string, v string")
    got = tables.form_rows(pairs, "f", "s", "l", "v", {"rid": "^ID$", "name": "^Name$", "detail": "^Detail$"}, "rid")
    assert sorted((r["rid"], r["name"], r["detail"]) for r in got.collect()) == [("R1", "n", "d1\nd2"), ("R2", "", "")]


def test_states():
    assert states.nearest([[3], [1, 5], [2, 6], [], [9]]) == [3, 5, 6, None, 9]
    assert states.nearest([[1, 3]]) == [1] and states.nearest([[4], [3, 5]]) == [4, 5]
    assert states.settled([None, 2, None, 5, 2, 3, 1], 5) == [2, 2, 2, 2, 2, 3, 3]
    assert states.settled([5, None, 1], 10) == [5, 5, 1] and states.settled([None], 0) == [None]


def test_spacing(spark):
    """Only the first bullet of a mid keeps its labels; other rows begin anew, tabs forget, one sign is no row."""
    rows = [("t", "A", "m", "- x"), ("t", "A", "m", "- y"), ("t", "A", "n", "- z"), ("t", "B", "n", "- w"), ("t", "C", "o", "plain text"), ("t", "C", "o", "- v"), ("t", "C", None, "?"), ("t", "D", "", "1) u"), ("t", "", "", "plain"), ("t", "E", "", "- s"), ("u", "E", "o", "- r"), ("u", "E", "o", "• q")]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "d int, s int, tab string, top string, mid string, detail string")
    got = [(r["top"], r["mid"]) for r in states.spacing(df, "d", "s", "tab", "top", "mid", "detail").orderBy("s").collect()]
    assert got == [("A", "m"), ("", ""), ("A", "n"), ("", ""), ("C", "o"), ("", ""), ("C", ""), ("", ""), ("", ""), ("E", ""), ("E", "o"), ("", "")]


def test_column_rules(spark):
    rows = [(["d"],), (["r", "d"],), (["i", "r", "d"],), (["i", "r", "d", "x"],), (["i", "r", "d", " "],), (["r", "a", "", "b", "c"],), (["", " "],), ([],)]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "c array<string>").select(tables.column_rules(F.col("c"))).collect()]
    assert got == [("", "", "d"), ("", "r", "d"), ("i", "r", "d"), ("i", "r", "d / x"), ("i", "r", "d"), ("", "r", "a / b / c"), None, None]


def test_spans_and_distinct(spark):
    from docweave.operators import dedup, html

    assert [html.spanned(x, 1000) for x in ("2", "²", "0", None, "x", "99999", "3 ")] == [2, 1, 1, 1, 1, 1000, 3]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("", 0)], "k string, s int")
    assert sorted(tuple(r) for r in dedup.distinct_first(df, ["k"], "s").collect()) == [("a", 1), ("b", 2)]


def test_scorer(spark):

    def flaky(texts):
        if len(texts) > 1:
            raise RuntimeError("down")
        return [None if texts[0] == "c" else texts[0].upper()]

    df = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), (None,)], "t string")
    got = sorted((str(r["t"]), r["verdict"]) for r in scorer.scored(df, "t", flaky).collect())
    assert got == [("None", ""), ("a", "A"), ("a", "A"), ("b", "B"), ("c", "keep")]
    v = spark.createDataFrame([("a b", "xx a-b yy"), ("zz", "xx")], "p string, s string")
    assert [r["p"] for r in scorer.verbatim(v, "p", "s").collect()] == ["a b"]
    assert scorer.accepted_split("one two three four", ["one two", "three  four"]) and not scorer.accepted_split("one two", ["one"])


def test_embedding(spark):
    import hashlib

    t = spark.createDataFrame([("x",), ("é y",), (None,)], "t string")
    got = [(r[0], r[1]) for r in t.select(embed.hash_vector(F.col("t")), embed.hash_vector(F.col("t"), 200)).collect()]
    assert got[2] == (None, None) and [len(x) for x in got[1]] == [64, 200] and abs(sum(x * x for x in got[1][1]) - 1) < 1e-9
    seed = hashlib.sha256(b"x").digest()
    first = hashlib.sha256(seed).digest()
    raw = [b / 255 - 0.5 for b in first + hashlib.sha256(first + seed).digest()]
    assert max(abs(a - b / sum(x * x for x in raw) ** 0.5) for a, b in zip(got[0][0], raw)) < 1e-12
    df = spark.createDataFrame([("A  b", "a b"), ("", "x"), ("abcd", "bcde")], "a string, b string")
    assert [r[0] for r in df.select(embed.sequence_ratio("a", "b")).collect()] == [1.0, 0.0, 0.75]
    assert [r[0] for r in df.select(embed.nfc(F.lit("é"))).limit(1).collect()] == ["é"]


def test_near_dup_ratio_loses_no_pair(spark, tmp_path):
    rng = random.Random(4)
    names = ["large ring", "old ring", "Old  ring", "cold plate", None, "", "blue bolt"]
    rows = [(k, rng.choice(names), f"b{rng.randrange(2)}", rng.choice(["T", "U", None]), 1) for k in range(90)] + [(90 + k, "large ring", "b0", "T", 1) for k in range(40)] + [(None, "old ring", "b0", "T", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.queries()["near_dup_ratio"](spark, str(tmp_path)).collect()
    of = {r["other"]: r["p_partkey"] for r in got if r["copy"]}
    between = {(r["p_partkey"], r["other"]): (r["ratio"], r["back"]) for r in got if not r["copy"]}
    assert len(got) == len(of) + len(between) and len(of) > 60  # a copy is in one row
    n, turned = 0, 0
    for x in rows:
        for y in rows:
            if None not in (x[0], y[0], x[3], y[3]) and x[0] < y[0] and x[2:] == y[2:]:
                a, b = of.get(x[0], x[0]), of.get(y[0], y[0])
                ratio = 1.0 if a == b else between[a, b][0] if a < b else between[b, a][1]
                assert ratio == round(embed.ratio(x[1], y[1]), 6) and (a == b) == (x[1] == y[1])
                n, turned = n + 1, turned + (a > b)
    assert n > 2 * len(got) and turned
