"""Plans that do the whole job where a query with SQL is bound to less."""

import collections
import hashlib
import math
import re

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import dedup, search
from docweave.plans import registry


def test_dup_classes_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sets = {}
    for i, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    texts, links, parent = dict(docs), collections.Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            m = len(sets[i] & sets[j])
            if texts[i] == texts[j] or (m and round(m / (len(sets[i]) + len(sets[j]) - m), 6) >= 0.8):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = sorted(tuple(r) for r in registry.queries()["dup_classes"](spark, sf).select("doc_id", "class_id", "n_links").collect())
    assert got == [(i, find(i), links[i]) for i in ids] and sum(links.values())


def test_term_cosine_sees_whole_texts(spark):
    texts = {1: "filler words " * 200 + "rare river stone", 2: "rare river", 3: "other"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(7, "rare river stone")], "item_id long, text string")
    got = {r["doc"]: r["score"] for r in search.term_cosine(docs, items, "doc_id", "text", "item_id", "text").collect()}
    q, want = collections.Counter(texts[1].split()[-3:]), {}
    for i, t in texts.items():
        c = collections.Counter(t.split())
        dot = sum(q[w] * c[w] for w in q)
        if dot:
            want[i] = round(dot / math.sqrt(sum(v * v for v in q.values())) / math.sqrt(sum(v * v for v in c.values())), 6)
    assert got == want and set(got) == {1, 2}


def test_hybrid_whole_starts_with_the_vector_list(spark, sf):
    rows = registry.queries()["hybrid_whole"](spark, sf).collect()
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    best = search.top_k(search.term_cosine(docs, items, "doc_id", "text", "item_id", "text"), "query", "score", "doc", 5)
    want = {(r["query"], r["rank"]): r["doc"] for r in best.collect()}
    assert {(r["item_id"], r["rank"]): r["doc_id"] for r in rows if r["rank"] <= 5} == want


def test_signatures_are_made_once_as_text_sig(spark, sf):
    texts = ["Ab-c 1", None, "", " .,!", "가나 다.라", "é a ü 9 힣\U0001f600x", "\x00A\x7fb_c", "ㄱ각\u3000z", "abc1 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["doc_id"]: r["s"] for r in df.select("doc_id", tx.sig(F.col("text")).alias("s")).collect() if r["s"]}
    got = {r["doc_id"]: bytes(r["digest"]) for r in dedup.signature_digests(df, "doc_id", "text").collect()}
    assert got == {i: hashlib.sha256(s.encode()).digest() for i, s in want.items()}
    assert dedup.signature(b"a\xff.b\xea\xb0") == b"ab"
    plan = registry.queries()["distinct_sig"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_replace" not in plan


def test_distinct_sig_is_one_row_a_signature(spark, tmp_path):
    rows = [(3, "A b"), (1, "Ab"), (1, "a-b"), (1, "A,b"), (None, "zz"), (7, None), (8, "..")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r["doc_id"] for r in registry.queries()["distinct_sig"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == ["1", "1", "None"]
