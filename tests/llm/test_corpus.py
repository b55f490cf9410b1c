import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, cut_passages, leaked, near_classes, odd_documents, sha, words

import corpus_pipeline
from marginmart.llm import _common, backoff, suffixes, tokens
from marginmart.llm.queries import QUERIES


def passages(rng, n):
    shared = ["".join(rng.choice("abcé ") for _ in range(k)) for k in (99, 100, 130, 400)]
    out = []
    for _ in range(n):
        parts = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(0, 150))) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(1, 5))]
        out.append("".join(parts))
    return out + ["ab" * 200, "a" * 350, shared[3] * 3, out[0], out[0], "line one of a text that is said again and again\n" * 12]


def digests(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_against_brute_force(spark, seed):
    docs = odd_documents(spark, passages(random.Random(seed), 50), extra="start")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ordered = sorted(set(rows), key=lambda r: (r[0] is not None, r[0]))
    made = {(i, t): (i, n, n - len(kept), spans, sha(kept)) for (i, t), (_, n, kept, spans) in zip(ordered, cut_passages(ordered))}
    got = suffixes.dedup(docs)
    assert digests(got) == sorted((made[r] for r in rows), key=str)
    cut = {r["doc_id"]: r["text"] for r in suffixes.remove(docs).collect()}
    for (i, t), (_, n, kept, spans) in zip(ordered, cut_passages(ordered)):
        if spans and not kept:
            assert i not in cut
        elif not spans:
            assert cut[i] == t
        elif i is not None:
            assert "".join(c for c in cut[i] if c.isascii()) == "".join(c for c in kept.decode(errors="ignore") if c.isascii())


def test_suffixes_of_repeated_ids_and_no_rows(spark):
    rng = random.Random(7)
    a, b, c = ("".join(rng.choice("abc ") for _ in range(250)) for _ in range(3))
    docs = spark.createDataFrame([(1, a + b), (1, b + c), (2, a + c), (2, a + c)], "doc_id long, text string")
    got = digests(suffixes.dedup(docs))
    assert got[2] == got[3] and got[2][:4] == (2, 500, 500, 1)
    assert sorted(r[2] for r in got[:2]) == [0, 250]
    assert suffixes.dedup(docs.limit(0)).count() == 0 == suffixes.remove(docs.limit(0)).count()


def test_common_line_is_split_into_bounded_buckets(spark, monkeypatch):
    rng = random.Random(11)
    line = "".join(rng.choice("abcdefghij ") for _ in range(80))
    around = ["".join(rng.choice("abcdefghij ") for _ in range(60)) for _ in range(12)]
    said = [rng.choice(around) + line + rng.choice(around) for _ in range(60)]
    said += ["".join(rng.choice("abcdefghij ") for _ in range(50)) + line + "".join(rng.choice("abcdefghij ") for _ in range(50)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    rows = list(enumerate(said))
    assert digests(suffixes.dedup(docs, block=1500)) == sorted(((i, n, n - len(kept), spans, sha(kept)) for i, n, kept, spans in cut_passages(rows)), key=str)
    sent, split = [], []
    cut, sort = suffixes.spread, suffixes.sort_buckets
    monkeypatch.setattr(suffixes, "spread", lambda *a: (sent.append(a[0]), cut(*a))[1])
    monkeypatch.setattr(suffixes, "sort_buckets", lambda df, *a: (split.append(df), sort(df, *a))[1])
    suffixes.covered(docs, block=1500)

    def largest(df):
        sizes = Counter()
        for h, _, part in {(r["h"], r["lead"], bytes(r["bytes"])) for r in df.where("bytes is not null").collect()}:
            sizes[h] += len(part)
        return max(sizes.values())

    assert largest(sent[0]) > 1500 >= largest(split[0])


def test_suffix_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    want = [(i, n, n - len(kept), spans, sha(kept)) for i, n, kept, spans in cut_passages(docs)]
    assert digests(QUERIES["op5_suffixes"](spark, SF)) == sorted(want, key=str)


def test_difference_covers():
    for v in (2, 7, 16, 32, 64):
        cover = suffixes.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) < v // 2 + 2


def test_anchors_are_the_leftmost_least(monkeypatch):
    raw = np.frombuffer(("abcabcabd" * 30 + "xyz" * 40).encode(), np.uint8)
    at = np.array([0, 130, 131, len(raw)])
    h, place, first, last = suffixes.anchors(raw, at, 100, 32)
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == [s for a, b in zip(at, at[1:]) for s in range(a, b - 99)]
    for p, a, b in zip(place, first, last):
        assert a <= p <= b + 68 and p - b >= 0 or p - a <= 68
    # Equal windows have equal anchors at equal offsets.
    seen = {}
    for x, p, a, b in zip(h, place, first, last):
        for s in range(a, b + 1):
            assert seen.setdefault(raw[s : s + 100].tobytes(), (x, p - s)) == (x, p - s)


def brute_scores(docs, order, alpha):
    counts = [Counter() for _ in range(order + 1)]
    own = []
    for _, t in docs:
        w = words(t)
        mine = [Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(order + 1)]
        own.append(mine)
        for k in range(1, order + 1):
            counts[k] += mine[k]
    total = sum(counts[1].values())
    out = []
    for (i, t), mine in zip(docs, own):
        w, x = words(t), 0.0
        c = lambda g: counts[len(g)][g] - mine[len(g)][g]  # noqa: E731, B023
        for p in range(len(w)):
            most = min(order, p + 1)
            for k in range(most, 0, -1):
                g = tuple(w[p + 1 - k : p + 1])
                if c(g) > 0:
                    x += math.log(c(g) / (c(g[:-1]) if k > 1 else total - len(w))) + (most - k) * math.log(alpha)
                    break
            else:
                x += most * math.log(alpha) - math.log(total - len(w) + 1)
        out.append((i, len(w), x))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_brute_force(spark, order):
    rng = random.Random(order)
    docs = odd_documents(spark, [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40))) for _ in range(40)], extra="block")
    want = brute_scores([(r["doc_id"], r["text"]) for r in docs.collect()], order, 0.4)
    got = backoff.score(docs, order=order, block_bytes=200).collect()
    key = lambda r: (str(r[0]), r[1], round(r[2], 3))
    assert len(got) == len(want)
    for g, w in zip(sorted(((r["doc_id"], r["n_words"], r["log_score"]) for r in got), key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4
    assert all(r["mean_log"] is None for r in got if r["n_words"] == 0)
    assert backoff.score(docs.limit(0)).count() == 0


def test_trigram_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, x) for i, n, x in brute_scores(docs, 3, 0.4)}
    got = QUERIES["op7_backoff_order3"](spark, SF).collect()
    assert len(got) == len(docs) == len(want)
    assert all(r["n_words"] == want[r["doc_id"]][0] and abs(r["log_score"] - want[r["doc_id"]][1]) < 1e-4 for r in got)


def test_packed_arrays_are_whole():
    rng = np.random.default_rng(7)
    keys = np.sort(rng.integers(0, 1 << 64, 1000, dtype=np.uint64, endpoint=False))
    counts = np.array([1, 255, 256, 1 << 33, (1 << 64) - 1], np.uint64)
    assert (backoff._unpacked_keys(backoff._packed_keys(keys)) == keys).all()
    assert (backoff._unpacked(backoff._packed(counts)) == counts).all()


def test_pipeline_against_brute_force(spark):
    docs = _common.documents(spark, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    rows = {i: rows[i] for i, cls, *_ in near_classes(list(rows.items())) if i == cls}
    rows = {i: kept.decode(errors="ignore") for i, _, kept, spans in cut_passages(sorted(rows.items())) if kept or not spans}
    rows = {i: t for i, t in rows.items() if not leaked(t, items)}
    e = tokens.Encoder(tokens.vocabulary_path())
    want = sorted((i, k, 4096 * k, len(part), zlib.crc32(part.astype("<u4").tobytes())) for i, t in rows.items() for ids in [np.array([*e.whole(t), 1], np.uint32)] for k, part in enumerate(np.split(ids, range(4096, len(ids), 4096))))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_documents_without_any_named_language_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "... 12", None), (3, "слова", None), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()) == [1, 3]


def test_pipeline_stages_keep_the_columns(spark):
    docs = odd_documents(spark, passages(random.Random(3), 6) + ["... 12"], extra="n_chars").withColumnRenamed("lang", "lang")
    docs = docs.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(n_chars as bigint) as n_chars", "1 as score")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = _common.staged(stage(spark, now, SF), "test")
            assert now.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, now, SF).count()


def test_pipeline_stages_keep_the_values_of_clashing_columns(spark):
    """Columns that bear the stages' own helper names come back as they were."""
    clashes = ["ord", "own", "sub", "clash", "_ranges", "first_id", "h", "key", "class_id", "lang_pred", "score", "copy", "c0", "c5", "root", "n"]
    texts = [f"document number {i} says " + " ".join(f"word{(i * 37 + k) % 911}" for k in range(60)) for i in range(8)] + ["", "x"]
    rows = [(i, t, "en", "s", len(t), *[100 * i + k for k in range(len(clashes))]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in clashes))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = _common.staged(stage(spark, now, SF), "clash-test")
        assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
    want = {r[0]: r[5:] for r in rows}
    got = {r["doc_id"]: tuple(r)[5:] for r in now.collect()}
    assert len(got) >= 8 and all(want[i] == v for i, v in got.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(got)
