"""The pipeline's near-duplicate stage against brute force: Jaccard of five-word shingles, 0.8 or more."""

import random

from docweave.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def brute(rows, least=0.8):
    """The smallest id of each component."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            m = len(sets[i] & sets[j])
            if sets[i] == sets[j] or m >= least * (len(sets[i]) + len(sets[j]) - m) - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted({find(i) for i in ids})


def stage(name):
    import corpus_pipeline as cp

    return dict(cp.STAGES)[name]


def test_stage_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(r["doc_id"] for r in stage("simhash")(spark, docs, sf).collect())
    assert got == brute(rows)
    assert len(got) < simhash.one_of_each(docs).count()  # more than identical texts


def test_hot_passage_and_edits(spark, sf):
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, rows = words(60), []
    for i in range(90):  # a common passage does not make texts similar
        rows.append((i, " ".join(words(80) + passage + words(20))))
    base = [words(120) for _ in range(6)]
    for i in range(200):  # copies with some words changed: similar, on the border, not similar
        w = list(base[i % 6])
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "One  two"), (5005, "one three")]
    got = sorted(r["doc_id"] for r in stage("simhash")(spark, frame(spark, rows), sf).collect())
    assert got == brute(rows)
    sets = spark.createDataFrame([(i, [int(x) for x in near_copies.shingles(t)]) for i, t in rows if i < 5000], "skey long, hs array<long>").selectExpr("skey", "size(hs) AS n", "hs")
    begun = sets.selectExpr("skey", "n", "slice(hs, 1, CAST(ceil(1.5 * (n - ceil(n * 0.8D - 1e-9D) + 1)) AS INT)) AS hs")
    whole = lambda keys: sets.join(keys, "skey", "left_semi")
    for given, hot, more in ((sets, 10**6, None), (begun, 3, whole)):  # where the order puts common shingles changes no result
        apart = {r["node"]: r["root"] for r in near_copies.roots(given, hot=hot, whole=more).collect()}
        assert sorted({apart.get(i, i) for i, _ in rows if i < 5000}) == brute([x for x in rows if x[0] < 5000])


def edited(rng, n=260):
    """Copies of three texts with up to eight words changed: similar, on the border, not similar."""
    base = [[f"w{rng.randrange(4000)}" for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(n):
        w = list(base[i % 3])
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_stage_links_by_simhash_first(spark, sf, monkeypatch):
    rows = edited(random.Random(5))
    calls, links = [], near_copies.similar_prints

    def seen(sims, whole, least):
        found = links(sims, whole, least)
        calls.append({(r["a"], r["b"]) for r in found.collect()})
        return found

    monkeypatch.setattr(near_copies, "similar_prints", seen)
    got = sorted(r["doc_id"] for r in stage("simhash")(spark, frame(spark, rows), sf).collect())
    assert got == brute(rows)
    sets = {near_copies.xxhash.xxh64_intdigest(h.tobytes(), simhash.SEED): h for h in (near_copies.shingles(t) for _, t in rows)}
    sets = {k - (1 << 64) if k >> 63 else k: h for k, h in sets.items()}
    sim = {k: near_copies.majority(h) & (1 << 64) - 1 for k, h in sets.items()}
    assert len(calls) == 1 and calls[0]
    for a, b in calls[0]:  # within two bits, and similar
        m = len(set(sets[a]) & set(sets[b]))
        assert (sim[a] ^ sim[b]).bit_count() <= 2 and m >= 0.8 * (len(sets[a]) + len(sets[b]) - m) - 1e-9
    leads = {}
    for k in sorted(sets):
        leads.setdefault(sim[k], k)
    must = {tuple(sorted((a, b))) for x, a in leads.items() for y, b in leads.items() if a < b and (x ^ y).bit_count() <= 2}
    must |= {(leads[sim[k]], k) for k in sets if leads[sim[k]] != k}
    similar = {(a, b) for a, b in must if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])) - 1e-9}
    assert calls[0] == similar


def test_majority_is_simhash():
    text = " ".join(f"w{i * 37 % 61}" for i in range(80))
    h = near_copies.shingles(text)
    ones = [sum(int(x) >> b & 1 for x in h) for b in range(64)]
    assert near_copies.majority(h) & (1 << 64) - 1 == sum(1 << b for b, n in enumerate(ones) if 2 * n > len(h))
    assert near_copies.majority(h[:0]) == 0


def test_parities_bound_what_sets_differ_in():
    rng = random.Random(6)
    sets = [near_copies.shingles(t) for _, t in edited(rng, 60)] + [near_copies.shingles(None), near_copies.shingles("a b")]
    bits = [near_copies.parities(h).tolist() for h in sets]
    out = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            differ = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(bits[i], bits[j]))
            assert differ <= len(set(x) ^ set(y)) and (i != j or differ == 0)
            m = len(set(x) & set(y))
            if m < 0.5 * (len(x) + len(y) - m) and i < j < 60:
                out += differ > (len(x) + len(y)) * 0.2 / 1.8
    assert out > 900  # nearly all texts of other origin are ruled out


def test_many_links_are_joined_up_on_executors(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 40) if i % 7] + [(100, 3), (100, 30)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(tuple(r) for r in simhash.components(df).collect())
    assert sorted(tuple(r) for r in near_copies.linked(df).collect()) == want
    monkeypatch.setattr(near_copies, "DRIVER_LINKS", 5)
    assert sorted(tuple(r) for r in near_copies.linked(df).collect()) == want
    assert near_copies.linked(df.limit(0)).count() == 0


def test_stage_sweeps_its_shuffles(spark, sf, monkeypatch):
    name, seen, roots = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], near_copies.roots

    def watched(*args, **kw):
        seen.append(spark.conf.get(name))
        return roots(*args, **kw)

    monkeypatch.setattr(near_copies, "roots", watched)
    before = spark.conf.get(name, None)
    assert stage("simhash")(spark, frame(spark, [(1, "a b c"), (2, "a b c"), (3, None)]), sf).count() == 2
    assert seen == ["true"] and spark.conf.get(name, None) == before
