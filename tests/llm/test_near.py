import random

import numpy as np
from helpers import SF, leaked, near_classes, odd_documents, words
from pyspark.sql import functions as F

from marginmart.llm import _text, decontam, forest, mtree
from marginmart.llm.components import components
from marginmart.llm.queries import QUERIES


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], ["zz"], [w[k], "yy"]])
    return " ".join(w)


def near_rows(df):
    return sorted(((r["doc_id"], r["class_id"], r["copy_of"], r["n_copies"], r["n_links"]) for r in df.collect()), key=str)


def test_words_follow_the_rule():
    import pyarrow as pa

    texts = ["Ab, cd_e9 É—x", None, "", "one", "Ab cd"]
    h, at = _text.words(pa.array(texts))
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    assert h[0] == h[at[4]] and len(set(h.tolist())) == len({w for t in texts for w in words(t)})


def test_forest_against_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(25)]
    base = prose(rng, 120)
    texts += [edited(rng, base, rng.randint(0, 4)) for _ in range(40)] + [base.upper() + "!"] * 3 + ["a b", "A, b", "!!", "!!", "?", "a b c"]
    docs = odd_documents(spark, texts, extra="n_links")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    want = sorted([*near_classes(rows), (None, None, None, 1, 0)], key=str)
    assert any(r[4] > 5 for r in want)
    assert near_rows(forest.near_duplicates(docs)) == want
    assert near_rows(forest.near_duplicates(docs, block=7)) == want  # groups over several blocks
    assert forest.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_id_with_other_texts(spark):
    rng = random.Random(2)
    a, b = prose(rng, 50), prose(rng, 50)
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (3, edited(rng, a, 1))], "doc_id long, text string")
    assert near_rows(forest.near_duplicates(docs)) == sorted(near_classes([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)


def test_prefix_length_follows_recall():
    assert forest.depth_for(0.8, 0.9999, 20, 8) == 4
    assert forest.depth_for(0.8, 0.5, 20, 8) == 8
    assert forest.depth_for(0.1, 0.9999, 20, 8) == 1
    for depth in range(1, 9):
        s = forest.similarity_for(depth, 0.9999)
        assert abs(1 - (1 - s**depth) ** 20 - 0.9999) < 1e-9


def test_prefixes_are_shortened_pair_by_pair():
    levels = forest.Levels(0.8, 0.9999, 20, 8)
    assert levels.shortest == 4
    sizes = np.arange(1, 200)
    for a in (1, 4, 5, 6, 9, 40, 150):
        need = levels.needed(np.int64(a), sizes)
        for b, d in zip(sizes.tolist(), need.tolist()):
            reach = [m / (a + b - m) for m in range(min(a, b) + 1) if m / (a + b - m) >= 0.8]
            if not reach:
                assert d == 9
            else:
                found = lambda k: 1 - (1 - min(reach) ** k) ** 20
                assert 4 <= d <= 8 and found(d) >= 0.9999 - 1e-12 and (d == 8 or found(d + 1) < 0.9999)
    assert len(set(levels.needed(np.int64(6), sizes).tolist())) > 2  # short sets differ


def test_trie_walk_meets_every_pair_once():
    rng = np.random.default_rng(7)
    levels, n, trees = forest.Levels(0.8, 0.9999, 20, 8), 60, 20
    hashes = rng.integers(0, 3, (n, trees, 8)).astype(np.uint64)
    hashes[:, :, :5] = rng.integers(0, 2, (n, trees, 5))
    tries = np.zeros((n, trees, 2), np.uint64)
    for d in range(8):
        tries[:, :, d // 4] |= hashes[:, :, d] << np.uint64(48 - 16 * (d % 4))
    sizes = rng.choice([5, 6, 9, 100], n)
    want, got = set(), []
    for i in range(n):
        for j in range(i + 1, n):
            need = int(levels.needed(sizes[i], sizes[j]))
            met = [t for t in range(trees) if need <= 8 and (hashes[i, t, :need] == hashes[j, t, :need]).all()]
            if met:
                want.add((i, j, met[0]))
    for t in range(trees):
        # A task gets the classes of one shortest prefix.
        for prefix in np.unique(tries[:, t, 0]):
            rows = np.flatnonzero(tries[:, t, 0] == prefix)
            side = rows % 2
            for chosen, sides in ((rows, side), (rows[side == 0], np.full((side == 0).sum(), 2)), (rows[side == 1], np.full((side == 1).sum(), 2))):
                one, two = levels.pairs(tries[chosen], t, sizes[chosen], sides)
                got += [(i, j, t) for i, j in zip(chosen[one].tolist(), chosen[two].tolist())]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_forest_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert near_rows(QUERIES["op6_jaccard"](spark, SF)) == sorted(near_classes(docs), key=str)


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(60)] + [(100, 90), (95, 100), (200, 200)] + [(300, 300 + k) for k in range(1, 30)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 95: 90, 100: 90, **{300 + k: 300 for k in range(1, 30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(15, 40))) for k in range(12)] + [(20, "two words"), (21, None), (22, ""), (0, "again " + prose(rng, 20))]
    texts = [prose(rng, 30) + " " + edited(rng, items[k % 12][1], rng.randint(0, 3)) + " " + prose(rng, rng.randint(0, 30)) for k in range(40)]
    texts += [items[3][1], items[3][1][:-8], items[4][1] + " " + items[5][1], "here two words stand", items[6][1].upper().replace(" ", " - ")]
    docs = odd_documents(spark, texts, extra="item_id")
    benchmark = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = []
    for r in docs.collect():
        distinct = sorted({(i, t) for i, t in items if t})
        for one in distinct:
            want += [(r["doc_id"], i, s, n, round(x, 9)) for i, (s, n, x) in leaked(r["text"], [one]).items()]
    rows = lambda df: sorted(((r["doc_id"], r["item_id"], r["start_word"], r["n_words"], round(r["similarity"], 9)) for r in df.collect()), key=str)
    assert len(want) > 15
    assert rows(decontam.leaks(docs, benchmark)) == sorted(want, key=str)
    assert rows(decontam.leaks(docs, benchmark, item_chars=300)) == sorted(want, key=str)  # the benchmark in several blocks
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0 == decontam.leaks(docs.limit(0), benchmark).count()
    clean = decontam.clean(docs, benchmark, item_chars=300)
    assert clean.columns == docs.columns
    assert clean.count() == docs.count() - len({r[0] for r in want})


def test_leak_query_against_brute_force(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted((r["doc_id"], i, *x[:2]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for i, x in leaked(r["text"], items).items())
    assert sorted((r["doc_id"], r["item_id"], r["start_word"], r["n_words"]) for r in QUERIES["op4_decontam"](spark, SF).collect()) == want


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    index = decontam.Index([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(30)], 0.8, 22, 5)
    for _ in range(200):
        k = int(rng.integers(30))
        flipped = index.items[k][4]
        for b in rng.choice(64, int(rng.integers(0, 23)), replace=False):
            flipped ^= 1 << int(b)
        assert k in index.near(flipped, 20)


def brute_top(rows, k, every):
    best = []
    for q, v in rows:
        if q % every == 0:
            found = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            best += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(best)


def test_mtree_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(400)] + [(400 + i, [0.5, -0.25, 0.0, 0.0, 1.0, 0.125]) for i in range(150)] + [(600 + i, [float(i), 1.0]) for i in range(4)]
    odd = [(700, None), (701, []), (702, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (703, [float("nan")] * 6), (704, [float("inf")] * 6), (None, [0.0] * 6), rows[7]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, score int")
    quantized = mtree.quantized(df, "vec_id", "embedding")
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    for page, shard in ((8, 100), (128, 16384)):
        got = mtree.top_k(quantized, quantized.where("vec_id % 20 = 0"), 5, page, shard, 10).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(whole, 5, 20)
    assert mtree.top_k(quantized.limit(0), quantized.limit(0)).count() == 0


def test_mtree_prunes_by_its_bounds():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 300, (40, 8))
    points = np.floor(np.repeat(centers, 100, 0) + rng.normal(0, 2, (4000, 8))).astype(np.int64)
    tree = mtree.MTree(np.arange(4000), points, 32)
    found, scored = tree.search(points[17], 17, 5)
    scores = points @ points[17]
    want = sorted((i for i in range(4000) if i != 17), key=lambda i: (-scores[i], i))[:5]
    assert [i for _, i in found] == want and scored < 2000
