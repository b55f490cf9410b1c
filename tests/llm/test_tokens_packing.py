import random
import zlib

import numpy as np
import pytest
from helpers import SF, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from marginmart.llm import packing, tokens
from marginmart.llm.queries import QUERIES


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_ids_are_the_librarys(encoder, texts):
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.whole(text).tolist()


def test_ids_of_odd_texts(encoder):
    texts = ["", "don't I'LL 12,3 A<|endoftext|>b", "ΑΣ σας İstanbul é", "\x1c a\x1fb", "x²½ ªº ŉ Ǆ ß ẞ ﬁ 日本語 한국", "a" * 5000, "é ́x", None]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == (encoder.whole(text).tolist() if text else [])


def test_marks_of_special_tokens_keep_their_case(encoder):
    texts = ["<|ENDOFTEXT|>", "x<|EndOfText|>y", "a <|endoftext|> b"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.whole(text).tolist()


def test_all_signs_and_white_space(encoder):
    texts = [f"A {c}a{c}B's" for c in map(chr, [*range(0x251), *range(0x2000, 0x2070), 0x1680, 0x3000, 0xFEFF])]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.whole(text).tolist()


class Spy:
    """Counts what the library is asked to encode."""

    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def encode_batch_fast(self, texts, **options):
        self.asked += [p for t in texts for p in t.split()]
        return self.inner.encode_batch_fast(texts, **options)


def test_a_full_cache_keeps_the_words_of_most_batches(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    e = tokens.Encoder(tokens.vocabulary_path())
    e.plain = spy = Spy(e.plain)
    common, letters = [f"{a}{b}on" for a in "abcde" for b in "fghij"], "klmnopqrst"
    for k in range(20):
        rare = [f"zq{letters[k // 10]}{letters[k % 10]}{a}{b}" for a in letters[:4] for b in letters]
        text = " ".join([*common, *(f"{w}," for w in rare)])
        assert e.encode([text])[0].tolist() == e.whole(text).tolist()
        assert len(e.known) <= 300 + 2 * len(rare) + len(common) + 2
    assert sum(p in set(common) for p in spy.asked) == len(common)


def test_long_words_do_not_fill_the_worker(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHARS", 1000)
    e = tokens.Encoder(tokens.vocabulary_path())
    for k in range(8):
        texts = ["ab" * 400 + c * k for c in "xyz"]
        assert [x.tolist() for x in e.encode(texts)] == [e.whole(t).tolist() for t in texts]
        assert e.chars <= 1000 + 3 * 900


def test_a_batch_looks_each_different_word_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *of):
            Counted.asked += 1
            return super().get(*of)

    e = tokens.Encoder(tokens.vocabulary_path())
    e.known = Counted(e.known)
    text = "some words, some WORDS " * 2000
    assert e.encode([text, None, text])[2].tolist() == e.whole(text).tolist()
    assert Counted.asked <= 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_places_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    plan, used, rank = packing.Plan(counts, 40), {}, {}
    for n in lengths:
        k = rank[n] = rank.get(n, -1) + 1
        s, o = (int(x[0]) for x in plan.place(np.array([n]), np.array([k])))
        used.setdefault(s, []).append((o, n))
    assert len(used) == plan.sequences <= max(1, 2 * -(-sum(lengths) // 40))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 40


def test_exact_fills_with_one_two_three():
    free = np.zeros(50, int)
    free[[7, 9, 11]] = 1
    assert packing.exact(free, 9) == (9,)
    assert packing.exact(free, 18) == (11, 7)
    assert packing.exact(free, 27) == (11, 9, 7)
    assert packing.exact(free, 14) == () and packing.exact(free, 30) == ()
    free[7] = 2
    assert packing.exact(free, 14) == (7, 7)


def test_query_against_brute_force(spark, encoder):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {(r["doc_id"], r["piece"]): r for r in QUERIES["op1_packing"](spark, SF).collect()}
    total = 0
    for r in docs:
        ids = [*encoder.whole(r["text"] or "").tolist(), 1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            row = got.pop((r["doc_id"], k))
            assert (row["start"], row["length"], row["ids_crc32"]) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not got
    rows = QUERIES["op1_packing"](spark, SF).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert -(-total // 4096) <= len(rows) <= -(-total // 4096) + 1
    assert max(r[1] for r in rows) <= 4096


def test_odd_documents(spark, encoder):
    docs = odd_documents(spark, ["one text"])
    rows = packing.pack_documents(docs, capacity=16, with_ids=True)
    got = rows.collect()
    assert sum(1 for r in got if r["doc_id"] is None) == 1
    assert [r["length"] for r in got if r["doc_id"] in (900, 901)] == [1, 1]
    assert sum(r["length"] for r in got) == sum(len(encoder.encode([r["text"]])[0]) + 1 for r in docs.collect())
    sequences = packing.sequences(rows).collect()
    assert sorted(len(s["ids"]) // 4 for s in sequences) == sorted(sum(s["lengths"]) for s in sequences)
    assert max(sum(s["lengths"]) for s in sequences) <= 16
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_pack_keeps_columns_and_nulls(spark):
    random.seed(3)
    rows = [(k, random.randint(1, 12)) for k in range(300)] + [(900, None), (901, 0), (902, 13)]
    got = packing.pack(spark.createDataFrame(rows, "offset_id long, n int").repartition(5), "n", 12).collect()
    assert {(r["offset_id"], r["n"]) for r in got} == set(rows)
    assert all((r["sequence_id"] is None) == (r["offset_id"] >= 900) for r in got)
    # No more sequences than best-fit decreasing takes.
    gaps = []
    for n in sorted((n for k, n in rows if k < 900), reverse=True):
        fits = min((g for g in gaps if g >= n), default=None)
        if fits is not None:
            gaps.remove(fits)
        gaps.append((12 if fits is None else fits) - n)
    assert len({r["sequence_id"] for r in got} - {None}) <= len(gaps)


def test_a_vocabulary_with_other_rules_is_encoded_by_the_library(tmp_path):
    import json

    import public_tokenizers as public

    own = json.load(open(public.path("word_bpe_49k.json")))
    own["normalizer"]["normalizers"].pop()  # upper case stays
    path = tmp_path / "own.json"
    path.write_text(json.dumps(own))
    for file in (str(path), public.path("byte_bpe_50k.json")):
        e = tokens.Encoder(file)
        assert not e.by_words
        for text in ["Some WORDS here, 12 don't", "", None]:
            assert e.encode([text])[0].tolist() == (e.tokenizer.encode(text, add_special_tokens=False).ids if text else [])
    assert tokens.Encoder(tokens.vocabulary_path()).by_words
