"""Filter audit, phrase mining and byte-level BPE against brute force."""

import base64
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, odd_documents, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginmart.llm import _common, bytebpe, filteraudit, phrases
from marginmart.llm.queries import QUERIES

EMPTY = "doc_id long, text string, lang string, source string"


# ---- filter audit

def failing(text, doc_id, first):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
        "D": bool(re.search(r"[#$%&*|]", t)),
        "E": doc_id is not None and first[t] is not None and first[t] < doc_id,
    }


def brute_audit(docs, labels):
    """{(part, order, step): figures} of (doc_id, text, source) rows, order by order."""
    first = {}
    for i, t, _ in docs:
        t = t or ""
        first[t] = i if first.get(t) is None else first[t] if i is None else min(i, first[t])
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, s in docs:
        parts[s or ""].append((i, failing(t, i, first)))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [i for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                out[part, order, step] = (len(left), len(gone), sum(x[f] for _, x in rows) - len(gone), sum(x[f] and sum(x.values()) == 1 for _, x in rows), len([i for i in gone if i in good]), len([i for i in gone if i in toxic]))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels, block_rows):
    rows = filteraudit.verdicts(docs)
    flags = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x")).withColumnRenamed("doc_id", "label_id")
    rows = rows.join(flags, rows["doc_id"] == flags["label_id"], "left").selectExpr("part", "doc_id", *"ABCDE", "q = 1 as good", "x = 1 as toxic")
    got = filteraudit.audit(filteraudit.unions(filteraudit.postings(rows, list("ABCDE"), ["good", "toxic"], block_rows), 5, 2), list("ABCDE"), ["good", "toxic"])
    return {(r[0], r[1], r[2]): tuple(r)[3:] for r in got.collect()}


@pytest.mark.parametrize("block_rows", [1, 7, 1 << 16])
def test_audit_equals_order_by_order_filtering(spark, block_rows):
    rnd = random.Random(block_rows)
    bodies = ["", None, "A B C", "low $ sign", "x " * 150, " ".join(f"w{k}" for k in range(220)), "W" * 30, "a\x0bb\x0cc\xa0d", "tie\ttie\rtie\ntie"]
    docs = [(rnd.choice([None, *range(25)]), rnd.choice(bodies), rnd.choice([None, "", "hot", "hot", "s2"])) for _ in range(120)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 30)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, source string, part int, digest int, first_id int")
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(spark, df, own, block_rows) == brute_audit(docs, labels)


def test_audit_of_empty_and_long(spark):
    empty, labels = spark.createDataFrame([], EMPTY), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(spark, empty, labels, 10) == {}
    docs = [(1, "word " * 400_000, "s"), (2, "word " * 400_000, "s")]
    assert audited(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), labels, 10) == brute_audit(docs, [])


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_sorted_list_operations(a, b):
    x, y = (np.array(sorted(s), np.int32) for s in (a, b))
    assert filteraudit.union(x, y).tolist() == sorted(a | b)
    assert filteraudit.common(x, y) == len(a & b)


def test_a_large_part_has_many_blocks(spark):
    rows = spark.range(1000).selectExpr("'hot' as part", "id as doc_id", "id % 2 = 0 as A")
    blocks = filteraudit.postings(rows, ["A"], [], 64).collect()
    assert max(len(b["ids"]) for b in blocks) <= 64 and sorted(i for b in blocks for i in b["ids"]) == list(range(1000))
    assert all(b["ids"] == sorted(b["ids"]) and [b["ids"][k] % 2 for k in b["fails"][0]] == [0] * len(b["fails"][0]) for b in blocks)


# ---- phrases

def brute_phrases(docs, min_count, max_words, top=2000):
    grams, totals = defaultdict(Counter), Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for d in range(1, max_words + 1):
                for k in range(len(w) - d + 1):
                    grams[lang or "und"][tuple(w[k : k + d])] += 1
    out = []
    for lang, f in grams.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        rows = []
        for g, a in candidates.items():
            inside = lambda h: any(h[k : k + len(g)] == g for k in range(len(h) - len(g) + 1))  # noqa: E731, B023
            if any(len(h) > len(g) and 100 * b >= 50 * a and inside(h) for h, b in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("max_words,shard_words,top", [(2, 1 << 20, 2000), (3, 40, 2000), (4, 60, 2000), (3, 1 << 20, 7)])
def test_phrases_equal_brute_force(spark, max_words, shard_words, top, monkeypatch):
    rnd = random.Random(max_words)
    words = ["a", "b", "c", "Da", "é", "É", "　", "x\x1cy", "zz"]
    texts = [" ".join(rnd.choices(words, weights=[9, 5, 3, 3, 2, 2, 1, 1, 1], k=rnd.randint(0, 40))).replace("zz", rnd.choice([".", "\n", "\t", "!?"])) for _ in range(150)]
    docs = [(t, rnd.choice(["en", "en", None, "de"])) for t in texts] + [(None, "en"), ("", "fr"), ("the same row", "en"), ("the same row", "en")]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "text string, lang string, shard int, word string, g1 int").repartition(3)
    monkeypatch.setattr(phrases.counts, "__defaults__", (shard_words,))
    got = phrases.mine(df, 4, max_words, top)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(docs, 4, max_words, top)


def test_phrases_of_empty_and_long(spark):
    assert phrases.mine(spark.createDataFrame([], EMPTY)).count() == 0
    docs = [("to be or not " * 60_000 + ". again", "en"), ("once", None)]
    got = phrases.mine(spark.createDataFrame(docs, "text string, lang string"))
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(docs, 10, 3)


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    sides = (spark.createDataFrame([("en", 9 * big)], "lang string, n long"), spark.createDataFrame([("en", "u", 1, big + 1), ("en", "v", 2, big)], "lang string, word string, g long, f long"), {2: spark.createDataFrame([(1, 2, big - 1)], "g1 long, g2 long, f long")})
    monkeypatch.setattr(phrases, "counts", lambda *a: sides)
    assert [tuple(r) for r in phrases.mine(None, 10, 2).collect()] == [("en", 1, "u v", big - 1, big + 1, big, 9 * big, 10**6 * (big - 1) ** 2 // ((big + 1) * big))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
def test_extension_both_ways_keeps_intervals_in_step(ids):
    words = np.array([*ids, 0], np.int32)
    before, after = phrases.transforms(words, 2)
    counts = np.bincount(words, minlength=5)
    starts = np.concatenate([[0], np.cumsum(counts)])
    mine = np.flatnonzero(counts)
    parent, word, count, _, lesser = phrases.extensions(after, starts[mine], counts[mine], 5)
    circle = [*words.tolist(), words[0]]
    assert {(mine[p], w): c for p, w, c in zip(parent, word, count)} == Counter(zip(circle, circle[1:]))
    p3, w3, c3, first, _ = phrases.extensions(before, starts[mine[parent]] + lesser, count, 5)
    circle.append(words[1 % len(words)])
    assert {(w, mine[parent[p]], word[p]): c for p, w, c in zip(p3, w3, c3)} == Counter(zip(circle, circle[1:], circle[2:]))
    order = phrases.sorted_contexts(words, 2, 1)
    for w, p, start in zip(w3, p3, phrases.backward(before, first)):
        assert words[order[start]] == w and words[(order[start] + 1) % len(words)] == mine[parent[p]]


# ---- byte-level BPE

@pytest.fixture(scope="module")
def library():
    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(bytebpe.vocabulary_path(), bytebpe.split_pattern())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_bytes_ids_are_the_librarys(codec, library, texts):
    ids = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(pa.array(ids, pa.binary())).to_pylist() == [t.encode() for t in texts]


def test_bytes_ids_of_odd_texts(codec, library):
    texts = ["x" * 200_000, " " * 30_000, "ab" * 20_000 + "\n" * 500, "日本語" * 3000, "\x00\x1c▁ Āā<|endoftext|>", "don't I'LL 12,3  a\r\n\tb ", "\U0010ffff﻿"]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_cache_starts_anew_when_full(codec, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHE_MATCHES", 5)
    for texts in (["one two three four", "five six"], ["one seven", "two one"], [None, ""]):
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t or "") for t in texts]


def test_ranks_with_gaps_and_missing_bytes(tmp_path):
    path = tmp_path / "own.tiktoken"
    path.write_text("".join(f"{base64.b64encode(e).decode()} {r}\n" for e, r in [(b"b", 7), (b"a", 3), (b"ab", 20), (b"aab", 31)]))
    own = bytebpe.Codec(str(path), r"\S+|\s+")
    ids = own.encode(["aab", "aaba"])
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [[31], [31, 3]]
    assert own.decode(pa.array(ids, pa.binary())).to_pylist() == [b"aab", b"aaba"]
    with pytest.raises(ValueError):
        own.encode(["abc"])


def test_encode_decode_tables(spark, library):
    docs = odd_documents(spark, ["a b", " lead", "tail\n\n"], extra="ids")
    rows = bytebpe.encode(docs)
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    got = sorted(((r.doc_id, bytes(r.raw).decode()) for r in bytebpe.decode(rows).collect()), key=repr)
    assert got == sorted(((i, t or "") for i, t in want), key=repr)
    lists = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in want]
    digests = sorted((tuple(r) for r in bytebpe.digests(rows).collect()), key=repr)
    assert digests == sorted(((i, len(x), sha(" ".join(map(str, x)).encode()), sha(raw)) for i, x, raw in lists), key=repr)
    assert bytebpe.digests(bytebpe.encode(spark.createDataFrame([], EMPTY))).count() == 0


def test_query_equals_the_library(spark, library):
    rows = _common.documents(spark, SF).select("doc_id", "text").collect()
    want = sorted((r.doc_id, len(x), sha(" ".join(map(str, x)).encode()), sha(r.text.encode())) for r in rows for x in [library.encode_ordinary(r.text)])
    assert sorted(tuple(r) for r in QUERIES["op13_bytebpe"](spark, SF).collect()) == want
