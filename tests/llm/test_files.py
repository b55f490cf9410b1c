import base64
import hashlib
import zlib

import numpy as np
import pytest
from helpers import SF, odd_documents
from pyarrow import fs

from marginmart.llm import _common, tokenfile, tokens, warc
from marginmart.llm.queries import QUERIES


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    raw = tokenfile.pack_bits(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    assert (tokenfile.unpack_bits(raw, bits, 1000) == ids).all()


def test_minimum_bits():
    assert [tokenfile.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access(tmp_path):
    rng, writer = np.random.default_rng(1), tokenfile.Writer(13, block_ids=64)
    docs = [rng.integers(0, 1 << 13, n).astype(np.uint32) for n in (5, 0, 300, 64, 1)]
    for d in docs:
        writer.add(d)
    local = fs.LocalFileSystem()
    writer.save(local, str(tmp_path / "f"))
    reader = tokenfile.Reader(local, str(tmp_path / "f"))
    assert all((reader.document(k) == d).all() for k, d in enumerate(docs))
    whole = np.concatenate(docs)
    assert (reader.ids(60, 200) == whole[60:200]).all() and len(reader.ids(7, 7)) == 0


def test_token_query_against_brute_force(spark):
    e = tokens.Encoder(tokens.vocabulary_path())
    got = {r["doc_id"]: r for r in QUERIES["op3_token_files"](spark, SF).collect()}
    start = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*e.whole(r["text"] or ""), 2], "<u4")
        row = got.pop(r["doc_id"])
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_running_total_of_files_carries_no_documents(spark):
    manifest = tokenfile.write(odd_documents(spark, ["one text", "two texts"]), _common.scratch(spark, "t"), file_ids=50)
    node = tokenfile.read_digests(manifest)._jdf.queryExecution().optimizedPlan()
    seen, todo = [], [node]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Window":
            seen.append(node.output().mkString(" "))
    assert len(seen) == 1 and "doc_ids" not in seen[0]


def test_token_files_of_odd_documents(spark):
    docs = odd_documents(spark, ["one text", "two texts"])
    manifest = tokenfile.write(docs, _common.scratch(spark, "t"), file_ids=50)
    rows = sorted(tokenfile.read(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 900, 901, 902, 903, 903]
    assert manifest.count() > 1
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert tokenfile.read_digests(tokenfile.write(docs.limit(0), _common.scratch(spark, "t"))).count() == 0


def test_token_files_of_other_widths(spark):
    docs = odd_documents(spark, ["one text", "two texts"])
    for size in (1 << 16, 70_000, 1 << 30):
        manifest = tokenfile.write(docs, _common.scratch(spark, "t"), vocabulary_size=size)
        got = [bytes(r["ids"]) for r in sorted(tokenfile.read(manifest).collect(), key=lambda r: r["start"])]
        if size == 1 << 16:
            first = got
        assert got == first and tokenfile.Reader(*_common.filesystem(manifest.first()["file"])).bits == tokenfile.bits_for(size)


def test_gathered_slices_keep_all_rows():
    import pyarrow as pa

    rows = [(k, None if k % 7 == 0 else "x" * (k * 13 % 90)) for k in range(300)]
    made = [pa.RecordBatch.from_pylist([{"k": k, "t": t} for k, t in rows[a : a + 9]], pa.schema([("k", pa.int64()), ("t", pa.string())])) for a in range(0, 300, 9)]
    out = list(_common.gathered(iter([made[0].slice(0, 0), *made]), "t", 500))
    assert [(r["k"], r["t"]) for b in out for r in b.to_pylist()] == rows
    assert 10 < len(out) < 25 and not list(_common.gathered(iter([]), "t"))


def test_warc_odd_pages(spark):
    rows = [(1, "http://a/", "<p>x</p>", 7), (5, "http://b/ü \n", "<p>x</p>", 7), (5, "http://b/ü \n", "<p>x</p>", 7), (None, None, None, 0), (3, "", "", 1), (8, "u", "<p>" + "lang " * 50_000, 2), (None, "v", "<p>x</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    index = warc.write(pages, _common.scratch(spark, "w"))
    assert index.count() == len(rows)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(index).collect()), key=str)
    assert got == sorted([(1, 8, "revisit", 5), (5, 8, "response", None), (5, 8, "response", None), (None, 0, "revisit", 3), (3, 0, "response", None), (8, 250_003, "response", None), (None, 8, "revisit", 5)], key=str)
    selected = index.where("page_id = 8")
    (one,) = warc.read(selected, most=1000).collect()
    assert bytes(one["payload"]).decode() == rows[5][2]
    assert one["payload_digest"] == base64.b32encode(hashlib.sha1(rows[5][2].encode()).digest()).decode()
    kept = warc.read(warc.write(pages, _common.scratch(spark, "w"), min_bytes=5)).where("record_type = 'revisit'").count()
    assert kept == 2
    assert warc.read(warc.write(pages.limit(0), _common.scratch(spark, "w"))).count() == 0


def test_warc_refuses_a_changed_payload():
    raw = warc.record(1, "u", b"abc", warc.sha1_base32(b"abd"), None, False)
    with pytest.raises(ValueError):
        warc.parse(raw)
