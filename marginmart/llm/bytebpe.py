"""Byte-level BPE over a file of ranks, encoded and decoded through a sentencepiece model.

The model is serialised here from the vocabulary alone: entry by entry, each byte written as one
code point, scored by the negative rank, with identity normalisation. Merging the best-scored
neighbours first, leftmost among equals, is then merging by least rank. Texts are cut by the split
pattern, and each match is encoded on its own; a match that is an entry is that entry. Decoding
takes the bytes of each id back.

Defined results: a null or empty text has no ids and no bytes; null ids and repeated rows stay;
an empty table gives no rows; other columns are ignored. A text is encoded whole, however long.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmart.llm import _common

#: The code point of each byte: letters that no normaliser, space rule or marker touches.
BYTES = "".join(chr(0x100 + b) for b in range(256))
#: Matches that a worker keeps the ids of, and the longest of them in characters.
CACHE_MATCHES, CACHE_LENGTH = 600_000, 64
UNKNOWN = "<unknown>"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(bytes, rank) of each line of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
    return sorted(pairs, key=lambda x: x[1])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes | str) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def model(entries: list[bytes], ranks: list[int]) -> bytes:
    """A serialised sentencepiece BPE model; piece i is entry i, and one more piece is the unknown one."""
    # Field numbers and kinds of the public model format.
    pieces, trainer, normalizer = 1, 2, 3
    name, score, kind, kind_unknown = 1, 2, 3, 2
    model_type, bpe, unknown_id, unknown_piece = 3, 2, 40, 45
    rule, dummy_prefix, fewer_spaces, mark_spaces = 1, 3, 4, 5
    out = [_field(pieces, _field(name, codecs.charmap_decode(e, "strict", BYTES)[0]) + _field(score, -float(r))) for e, r in zip(entries, ranks, strict=True)]
    out.append(_field(pieces, _field(name, UNKNOWN) + _field(score, 0.0) + _field(kind, kind_unknown)))
    out.append(_field(trainer, _field(model_type, bpe) + _field(unknown_id, len(entries)) + _field(unknown_piece, UNKNOWN)))
    out.append(_field(normalizer, _field(rule, "identity") + _field(dummy_prefix, 0) + _field(fewer_spaces, 0) + _field(mark_spaces, 0)))
    return b"".join(out)


class Codec:
    """Encodes texts to unsigned 32-bit ids, and ids to bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        pairs = read_ranks(path)
        self.ids = np.array([r for _, r in pairs], np.uint32)
        self.whole = {e: struct.pack("<I", r) for e, r in pairs}
        self.pieces = SentencePieceProcessor(model_proto=model([e for e, _ in pairs], self.ids.tolist()))
        self.findall = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        top = int(self.ids[-1]) + 1 if pairs else 0
        place = np.full(top, -1, np.int64)
        place[self.ids] = np.arange(len(pairs))
        entries = [codecs.charmap_encode(self.pieces.id_to_piece(k), "strict", codecs.charmap_build(BYTES))[0] for k in range(len(pairs))]
        self.bytes_of = pa.array([None if k < 0 else entries[k] for k in place.tolist()], pa.large_binary())
        self.decimals = pa.array([str(i) for i in range(top)], pa.large_string())

    def _encode_matches(self, matches: list[str]) -> dict[str, bytes]:
        out, rest = {}, []
        for m in matches:
            raw = m.encode()
            entry = self.whole.get(raw)
            if entry is None:
                rest.append((m, codecs.charmap_decode(raw, "strict", BYTES)[0]))
            else:
                out[m] = entry
        for (m, _), ids in zip(rest, self.pieces.encode([x for _, x in rest], num_threads=1) if rest else []):
            if len(self.ids) in ids:
                raise ValueError("the vocabulary lacks a byte of the text")
            out[m] = self.ids[ids].tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian."""
        split = [self.findall(t) if t else [] for t in texts]
        known, long = self.known, {}
        new = {m for ms in split for m in set(ms).difference(known)}
        if new:
            if len(known) + len(new) > CACHE_MATCHES:
                known.clear()
                new = {m for ms in split for m in ms}
            got = self._encode_matches(list(new))
            long = {m: x for m, x in got.items() if len(m) > CACHE_LENGTH}
            known.update(got)
        out = [b"".join(map(known.__getitem__, ms)) for ms in split]
        for m in long:
            del known[m]
        return out

    def _lists(self, ids: pa.Array, table: pa.Array) -> pa.Array:
        """The table's values at each row's ids."""
        raw, offsets = _common.binary(ids)
        return pa.LargeListArray.from_arrays(pa.array(offsets // 4, pa.int64()), pc.take(table, pa.array(raw.view("<u4"))))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Bytes of each row of little-endian ids (null: none)."""
        return pc.binary_join(self._lists(ids, self.bytes_of), pa.scalar(b"", pa.large_binary()))

    def written(self, ids: pa.Array) -> pa.Array:
        """Decimal ids of each row, joined by one space."""
        return pc.binary_join(self._lists(ids, self.decimals), pa.scalar(" ", pa.large_string()))


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file and a split pattern."""
    cache = _common.worker_cache()
    if ("codec", path, pattern) not in cache:
        cache["codec", path, pattern] = Codec(path, pattern)
    return cache["codec", path, pattern]


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each document's whole text."""
    vocabulary, pattern = vocabulary or vocabulary_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in _common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.encode(batch.column(1).to_pylist()), pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and raw (binary): the bytes of each row's ids."""
    vocabulary, pattern = vocabulary or vocabulary_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in _common.slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column(0), own.decode(batch.column(1)).cast(pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode()'s rows as counts and digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    vocabulary, pattern = vocabulary or vocabulary_path(), pattern or split_pattern()

    def sha(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in values.cast(pa.large_binary()).to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in _common.slices(batches, "ids"):
            ids = batch.column(1)
            n = pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, sha(own.written(ids)), sha(own.decode(ids))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: one row per document."""
    return digests(encode(_common.documents(spark, sf_dir)))
