"""The operators on small frames: brute force, nulls, ties, repeats, empty tables, clashing names."""

import math
import random
import sys
import os

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from compare import duck, same  # noqa: E402

from docweave.llm import chat_format, classifier, decontamination, html_extract, line_dedup, mixing, queries, quality_rules, simhash, substring_dedup, token_counts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("k1", "k2", "gone", "hash", "size", "copy_no", "m", "fp", "key", "text_key", "leaks", "measured", "skey", "class", "mix", "n_words", "kept", "id")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], SCHEMA)


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, "a b c " * 30, "s"), (1, "a b c " * 30, "s"), (2, None, None), (None, "x y z", None), (None, None, None), (3, "", "s"), (4, " \n\t", "t"), (5, long, "t"), (6, long + " tail", "u"), (7, "a b c " * 30, "u")]
    df = frame(spark, rows)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ledger_and_policies(spark):
    df = awkward(spark)
    book = quality_rules.ledger(df)
    assert book.count() == df.count()
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns
    want = book.filter(~quality_rules.rejected(F.col("fail_bits"), "v1")).count()
    assert kept.count() == want
    a = {r["rule"]: (r["n_failed"], r["n_alone"]) for r in quality_rules.ablations(book, "v1").collect()}
    bits = [r[0] for r in book.select("fail_bits").collect()]
    whole = quality_rules.mask(quality_rules.POLICIES["v1"])
    assert set(a) == set(quality_rules.POLICIES["v1"])
    for k, rule in enumerate(quality_rules.RULES):
        if whole >> k & 1:
            assert a[rule.name] == (sum(b >> k & 1 for b in bits), sum(b & whole == 1 << k for b in bits))
    assert quality_rules.ledger(empty(spark)).count() == 0 and quality_rules.keep(empty(spark)).count() == 0


def test_stored_ledger_and_policy_table(spark, tmp_path):
    df = awkward(spark)
    book = quality_rules.stored(quality_rules.ledger(df), str(tmp_path / "ledger"))
    table = spark.createDataFrame([("a", "few_words"), ("a", "few_words"), ("b", "few_words"), ("b", "blob"), ("b", "no such rule"), ("c", "none")], "version string, rule string")
    got = quality_rules.verdicts(book, table).collect()
    bits = [r["fail_bits"] for r in book.collect()]
    want = {"a": quality_rules.mask(["few_words"]), "b": quality_rules.mask(["few_words", "blob"]), "c": 0}
    assert {v: sorted(r["kept"] for r in got if r["version"] == v) for v in want} == {v: sorted(b & m == 0 for b in bits) for v, m in want.items()}
    assert quality_rules.verdicts(book, table.limit(0)).count() == 0
    every = {(r["version"], r["rule"]): (r["n_failed"], r["n_alone"]) for r in quality_rules.all_ablations(book).collect()}
    for v in quality_rules.POLICIES:
        assert {r["rule"]: (r["n_failed"], r["n_alone"]) for r in quality_rules.ablations(book, v).collect()} == {r: n for (w, r), n in every.items() if w == v}


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [256, 3])
def test_links_brute_force(spark, hot):
    rng = random.Random(6)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(rng.randrange(5)):
                y ^= 1 << rng.randrange(64)
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps = sorted(fps | {0, 1, -1, 3})
    got = sorted((r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot).collect())
    want = sorted((a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    assert got == want and len(want) > 100


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice(["The", "of", "cat", "dog", "é"]) + str(rng.randrange(40)) for _ in range(200)) for _ in range(8)]
    rows = []
    for i in range(60):
        words = base[i % 8].split()
        if i % 3:
            words[rng.randrange(200)] = "edit"
        rows.append((i, " ".join(words), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, " \n", None)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = {i: simhash.fingerprint(t) for i, t, _ in rows}
    want = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    one = simhash.one_of_each(frame(spark, rows))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(want.values()))


def test_near_duplicates_awkward(spark):
    df = awkward(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 7)} == {1}
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {2}
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and len([r for r in kept.collect() if r["doc_id"] == 1]) == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        share = (total - sum(most * sizes[s] for s in capped)) / sum(w[s] for s in rest) if rest else 0
        more = {s for s in rest if most * sizes[s] < share * w[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else share * w[s] for s in names}
        capped |= more


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 80, 700, 5000])), rng.choice(["a", "b", "c", "d", "é", None] + ["a"] * 5)) for i in range(600)]
    rows += [(1000, "tiny", "zz"), (1001, None, "a"), (1002, "", "b")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, source = water(sizes), {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 3), (s, taken[s], want[s])
    again = mixing.mix(frame(spark, rows).repartition(7))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_rows_follow_the_plan(spark):
    rng = random.Random(9)
    df = frame(spark, [(i, " ".join(["w"] * rng.randrange(1, 90)), rng.choice("abc")) for i in range(200)]).withColumn("copy_no", F.lit("x")).withColumn("hash", F.lit(1))
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    rows = mixing.mixed(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in rows} == {i: c for i, c in plan.items() if c}
    assert mixing.mix(awkward(spark)).count() == 10 and mixing.mixed(awkward(spark)).columns[:-1] == awkward(spark).columns
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_balanced_solves_the_dual(spark):
    """Sources' targets exactly, length groups' shares nearly, and no rates nearer to 1 that do so."""
    rows = [("a", 1000, 1200.0, 100, 300, 600), ("b", 500, 1500.0, 400, 100, 0), ("c", 70, 20.0, 0, 30, 40), ("d", 0, 0.0, 0, 0, 0), ("e", 10**4, 3000.0, 5000, 4000, 1000)]
    got = mixing.balanced(spark.createDataFrame(rows, "skey string, source_size long, target double, tokens_0 long, tokens_1 long, tokens_2 long")).collect()
    rates = {r["skey"]: r["rates"] for r in got}
    tokens = {r[0]: r[3:] for r in rows}
    for k, _, target, *t in rows:
        assert sum(x * n for x, n in zip(rates[k], t)) == pytest.approx(target, rel=1e-6) and max(rates[k]) <= 3
    assert len({round(x, 6) for x in rates["e"]}) == 3  # not the plain ratio of target and size
    total, there = sum(r[2] for r in rows), sum(r[1] for r in rows)
    taken = [sum(rates[k][g] * tokens[k][g] for k in tokens) for g in range(3)]
    assert all(abs(taken[g] - total * sum(t[g] for t in tokens.values()) / there) < 0.01 * total for g in range(3))
    entropy = lambda rs: sum(n * (x * math.log(x) - x) for k in rs for x, n in zip(rs[k], tokens[k]) if n and x > 0)
    best = entropy(rates)
    for e1, e2 in ((1e-3, 1e-3), (-1e-3, 1e-3), (5e-4, -1e-3), (-1e-3, -5e-4)):  # moves that keep all totals
        moved = {k: list(v) for k, v in rates.items()}
        d = [e1 * 500, e2 * 500, -(e1 + e2) * 500]
        for g in range(3):
            moved["a"][g] += d[g] / tokens["a"][g]
            moved["e"][g] -= d[g] / tokens["e"][g]
        assert entropy(moved) > best - 1e-6


def test_repeated_rows_do_not_overshoot(spark):
    """A thousand equal rows, and a null id: each source near its target, mixed rows as planned."""
    rows = [(1, " ".join(["w"] * 20), "a")] * 1000 + [(i, " ".join(["w"] * 30), "b") for i in range(2, 800)] + [(None, "w x y", "c")] * 50
    df = frame(spark, rows).repartition(5)
    got = mixing.mix(df).collect()
    want = water({"a": 20000, "b": 23940, "c": 150})
    for r in (x for x in got if x["doc_id"] == 1):
        assert r["copies"] in (0, 1, 2, 3)
    for source, ids in (("a", {1}), ("b", set(range(2, 800))), ("c", {None})):
        assert abs(sum(r["taken"] for r in got if r["doc_id"] in ids) - want[source]) <= max(0.01 * want[source], 30)
    assert mixing.mixed(df).count() == sum(r["copies"] for r in got)
    assert sorted(map(str, mixing.mix(df.repartition(2)).collect())) == sorted(map(str, got))


def test_no_python_in_native_plans(spark):
    for df in (mixing.mix(awkward(spark)), line_dedup.without_recurring(awkward(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup(spark):
    rng = random.Random(10)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuvw")
    sentence = lambda: " ".join(word() for _ in range(9))
    rows = []
    for i in range(40):
        body = [sentence() for _ in range(4)]
        body.insert(rng.randrange(5), "All rights reserved by us")
        body.insert(rng.randrange(6), f"Page {i} of 40 printed")
        body.insert(rng.randrange(7), f"Posted by user {word()} on this very site")
        rows.append((i, "\n".join(body), "s"))
    copies = [sentence() for _ in range(8)]
    for i in range(20):  # near copies: each has one line of its own, somewhere
        at = rng.randrange(8)
        rows.append((100 + i, "\n".join(copies[:at] + [sentence()] + copies[at + 1 :]), "s"))
    out = {r["doc_id"]: r for r in line_dedup.without_recurring(frame(spark, rows), counts=True).collect()}
    for i, text, _ in rows:
        lines = text.split("\n")
        kept = [x for x in lines if not x.startswith(("All rights", "Page ", "Posted by"))] if i < 40 else lines
        assert out[i]["text"] == "\n".join(kept), i
        assert out[i]["n_lines"] == len(lines) and out[i]["n_dropped"] == len(lines) - len(kept)


def test_line_dedup_awkward(spark):
    df = awkward(spark)
    out = line_dedup.without_recurring(df)
    assert out.columns == df.columns
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (r["text"] for r in df.collect())))
    assert line_dedup.without_recurring(empty(spark), counts=True).count() == 0
    short = frame(spark, [(i, "same line here", "s") for i in range(30)])
    assert line_dedup.without_recurring(short).filter("text <> ''").count() == 30  # copies of one document are one document


def test_spans(spark):
    rng = random.Random(11)
    sentence = lambda n: " ".join(f"word{rng.randrange(10**7)}" for _ in range(n))
    passage = sentence(60)
    rows = [(i, sentence(40) + " " + (passage + " " if i % 5 == 0 else "") + sentence(40), "s") for i in range(30)]
    rows += [(50, sentence(80), "s"), (51, None, "s"), (52, "", None)]
    got = substring_dedup.spans(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {5, 10, 15, 20, 25} and {r["first_id"] for r in got} == {0}
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert texts[r["doc_id"]].encode()[r["start"] : r["end"]] in texts[0].encode()
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicated(frame(spark, rows)).collect()}
    assert cut[0] == texts[0] and cut[50] == texts[50] and cut[51] is None and all(len(cut[i]) < len(texts[i]) - 300 for i in (5, 10, 15, 20, 25))


def test_spans_brute_force(spark, sf):
    """Of documents that repeat 50 words of an earlier one at least 0.95 are found; all that is reported is in another place too."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    first, want = {}, set()
    for i in sorted(texts):
        words = texts[i].split(" ")
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), i) != i:
                want.add(i)
    got = substring_dedup.spans(docs).collect()
    assert len(want & {r["doc_id"] for r in got}) >= 0.95 * len(want)
    chunked = {i: substring_dedup.chunked(t) for i, t in texts.items()}
    owner = {}
    for i in sorted(chunked):
        for d in chunked[i][1]:
            owner.setdefault(d, i)
    expected = set()
    for i, (ends, digests) in chunked.items():
        run, seen = None, set()
        for a, b, d in [*zip([0, *ends], ends, digests), (None, None, None)]:
            again = d is not None and (owner[d] != i or d in seen)
            seen.add(d)
            if again:
                run = (run[0], b, run[2]) if run else (a, b, owner[d])
            elif run:
                if run[1] - run[0] >= substring_dedup.MIN_SPAN:
                    expected.add((i, *run))
                run = None
    assert {(r["doc_id"], r["start"], r["end"], r["first_id"]) for r in got} == expected


def test_spans_awkward(spark):
    df = awkward(spark)
    got = substring_dedup.spans(df).collect()
    assert {r["doc_id"] for r in got} >= {6} and 2 not in {r["doc_id"] for r in got}
    out = substring_dedup.deduplicated(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert substring_dedup.spans(empty(spark)).count() == 0


def bench(spark):
    return spark.createDataFrame([(1, "Which river runs through the old town of Brix? The river Almar runs through it."), (2, None), (3, ""), (4, "Name the tallest peak in the eastern range of Dolun. Mount Serif is the tallest.")], "item_id long, text string")


def test_decontamination(spark):
    noise = " ".join(f"n{i}" for i in range(300))
    rows = [(1, noise, "s"), (2, f"{noise} WHICH river runs through the old town of brix? the river almar runs through it. {noise}", "s"), (3, "Which river runs through the old town of Brix?", "s"), (4, None, "s"), (5, "", "s")]
    df = frame(spark, rows)
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.search(df, bench(spark)).collect()] == [(2, 1)]
    assert sorted(r["doc_id"] for r in decontamination.clean(df, bench(spark)).collect()) == [1, 3, 4, 5]
    sharded = decontamination.search(df, bench(spark), shard_chars=20).collect()
    assert [(r["doc_id"], r["item_id"]) for r in sharded] == [(2, 1)]
    assert decontamination.search(df, bench(spark).limit(0)).count() == 0
    assert decontamination.search(empty(spark), bench(spark)).count() == 0
    awk = awkward(spark)
    assert decontamination.clean(awk, bench(spark)).columns == awk.columns and decontamination.clean(awk, bench(spark)).count() == 10


def test_scores_do_not_depend_on_shards(spark):
    """Also with a text under many ids, a repeated row, and an item longer than a shard."""
    rng = random.Random(15)
    text = lambda n: " ".join(f"w{rng.randrange(200)}" for _ in range(n)) + ". so " + " ".join(f"a{rng.randrange(50)}" for _ in range(4))
    items = [(i, text(rng.randrange(6, 30))) for i in range(40)]
    items += [(100 + i, items[0][1]) for i in range(30)] + [items[1]] + [(200, text(90)), (201, None), (202, "...")]
    rows = [(i, text(40) + " " + x[1] + " " + text(40), "s") for i, x in enumerate(items[:44]) if x[1]]
    rows += [(90 + i, " ".join(w if rng.random() < 0.8 else "z" for w in items[i][1].split()), "s") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(str, decontamination.search(frame(spark, rows), bench, shard_chars=n).collect())) for n in (1000, 3000, 10**9)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 70
    clean = [sorted(r["doc_id"] for r in decontamination.clean(frame(spark, rows), bench, shard_chars=n).collect()) for n in (1000, 10**9)]
    assert clean[0] == clean[1]


def test_tokens(spark):
    df = awkward(spark)
    got = token_counts.token_counts(df).collect()
    assert len(got) == 10 and all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (2, 3))
    assert token_counts.token_counts(empty(spark)).count() == 0


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_across_partitions(spark):
    rng = random.Random(12)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "odd", None]), f"t{t}") for t in range(300)]
    rows += [(c, t, rng.choice(["user", "assistant", "human"]), f"c{c}t{t}") for c in range(2, 30) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", None), (None, 1, None, "x"), (5, None, "user", "late")]
    got = chat_format.repaired(turns(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    for c, rs in by.items():
        rs.sort(key=lambda r: (r["turn"] is None, r["turn"] or 0))
        want = chat_format.rendered([(chat_format.role_of(r["role"]), next(x[3] for x in rows if x[0] == c and x[1] == r["turn"]) or "") for r in rs])
        assert [(r["new_role"], r["action"], r["n_inserted"], r["rendered"]) for r in rs] == want, c
    assert chat_format.repaired(turns(spark, [])).count() == 0
    twice = chat_format.repaired(turns(spark, [(1, 0, "user", "a"), (1, 0, "user", "a")]).withColumn("part", F.lit(1))).collect()
    assert sorted(r["action"] for r in twice) == ["keep", "merge+insert"]  # a repeated turn does not become its own answer


def test_chat_does_not_depend_on_partitions(spark, monkeypatch):
    """Null roles in tied turns, null turns, and a long conversation of equal turns, over 1, 3 and 13 partitions."""
    monkeypatch.setattr(chat_format, "BLOCK", 2)
    rng = random.Random(14)
    rows = [(c, rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", "system", None]), f"x{rng.randrange(3)}") for c in (1, 2, None) for _ in range(30)]
    rows += [(7, 0, "user", "same")] * 40 + [(7, 1, None, "same")] * 3
    seen = []
    for parts in (1, 3, 13):
        monkeypatch.setattr(chat_format, "PART_CHARS", -(-sum(len(r[3]) for r in rows) // parts))
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = chat_format.repaired(turns(spark, rows)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        seen.append(sorted(map(str, got)))
        for c in (1, 2, None, 7):
            assert sorted(r["ordinal"] for r in got if r["conv_id"] == c) == list(range(1, 1 + sum(r[0] == c for r in rows)))
    assert seen[0] == seen[1] == seen[2]


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<article><h1>A</h1><p>b &amp; c</article><footer>f</footer>"), (2, None, None), (None, "w", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((str(r["page_id"]), r["text"]) for r in html_extract.main_text(pages).collect()) == [("1", "A b & c"), ("2", ""), ("None", "")]
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_classifier(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(300):
        bad, rude = i % 5 == 0, i % 5 == 1
        words = [f"w{rng.randrange(300)}" for _ in range(70)]
        if rude:
            words[3:3] = ["nasty", "nastier"]
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "s"))
        if i % 3:
            labels.append((i, 0 if bad else 1, int(rude)))
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in classifier.classified(df, lab).collect()}
    assert sum(got[i] == (i % 5 > 1) for i in got) >= 285
    awk = awkward(spark)
    assert classifier.classified(awk, lab.limit(0)).filter("kept").count() == 10
    assert classifier.classified(awk, spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")).count() == 10
    assert classifier.classified(empty(spark), lab).count() == 0


def test_classifier_held_out(spark):
    """Fitted on a part of the labels, right on most of the others; documents with one id many times over are sampled once."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    again = docs.unionByName(docs.filter("doc_id < 10")).unionByName(docs.filter("doc_id < 10"))
    got = classifier.classified(again, known).dropDuplicates(["doc_id"]).join(held, "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in got if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.2 * len(bad)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), duck(sf), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.count() > 0


def test_pipeline(spark, sf):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.quality(spark, docs, sf).cache()
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in docs.collect() if not any(eval_rule(quality_rules.measure(r["text"])))}
    assert {r["doc_id"] for r in kept.collect()} == good
    lined = cp.lines(spark, kept, sf).cache()
    assert lined.columns == docs.columns and lined.count() == kept.count()
    one = cp.near_duplicates(spark, lined, sf).cache()
    want = brute_components({r["doc_id"]: simhash.fingerprint(r["text"]) for r in lined.collect()})
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(want.values()))
    clean = cp.decontaminate(spark, one, sf).cache()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [r for r in clean.collect() if any(t in r["text"] for t in items)]
    index = decontamination.Index(list(enumerate(items)))
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in one.collect() if not index.search(r["text"]))
    out = cp.mix(spark, clean, sf)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: c for i, c in plan.items() if c}


def eval_rule(values):
    """The rules of policy v2."""
    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper_words, n_bangs, longest_word, n_urls, n_bullets, n_ellipses = values
    return (n_words < 5, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > 3 * n_words, n_lines >= 4 and 2 * n_dup_lines > n_lines, word_chars < 2 * n_words or word_chars > 20 * n_words, 2 * n_upper_words > n_words, 2 * n_bangs > n_words, longest_word > 2000, 5 * n_urls > n_words, n_lines >= 4 and 10 * n_bullets > 9 * n_lines, n_lines >= 4 and 10 * n_ellipses > 3 * n_lines)


def test_policies_are_masks(spark):
    """v2 lets short texts pass that v1 rejects for their length alone, and nothing else."""
    df = frame(spark, [(1, "one two three four five six", "s"), (2, "one two", "s"), (3, "# * | # * | # * |", "s"), (4, " ".join(f"w{i}" for i in range(60)), "s")])
    kept = lambda v: sorted(r["doc_id"] for r in quality_rules.keep(df, v).collect())
    assert kept("v1") == [4] and kept("v2") == [1, 4]
