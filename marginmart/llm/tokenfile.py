"""Token-id files: fixed-width bit packing with block offsets.

A file holds the documents of one id range, in ascending id order, as one stream of ids.
Each id takes the minimum number of bits for the vocabulary; a block has a fixed number of
ids (the last may have fewer) and starts at a byte. Layout, all little-endian:

    8 bytes   magic "TOKBITS1"
    6 x u64   bits an id, ids a block, documents, ids, blocks, bytes of packed blocks
    u64 x (documents + 1)   first id of each document, and the end
    u64 x (blocks + 1)      byte offset of each block, and the end
    packed blocks

Any id range is read by seeking to its blocks alone. Texts are encoded where they are read, and
their packed ids are what is put in order. Tasks write files under names of their own
and report them in a manifest table; files of lost attempts are in no manifest and never read.

Defined results: a null or empty text has its end id alone; rows with the same id stay apart, in
order of their text's hash; null ids come first; an empty table gives no rows and no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmart.llm import _common, tokens

MAGIC = b"TOKBITS1"
HEAD = "<8s6Q"
BLOCK_IDS = 1 << 16
END_ID = 2
#: Ids of one file at most, unless one document has more.
FILE_IDS = 32 << 20


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of that many entries."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes, as unsigned 32-bit."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Collects documents' ids and writes one file; keeps only packed blocks."""

    def __init__(self, bits: int, block_ids: int = BLOCK_IDS):
        self.bits, self.block_ids = bits, block_ids
        self.starts, self.blocks, self.held, self.waiting, self.n = [0], [], [], 0, 0

    def add(self, ids: np.ndarray, lengths: np.ndarray | None = None) -> None:
        """The ids of a document, or of several with the given lengths."""
        ends = self.n + np.cumsum([len(ids)] if lengths is None else lengths)
        self.starts += ends.tolist()
        self.n += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            self._pack(self.waiting // self.block_ids * self.block_ids)

    def _pack(self, n: int) -> None:
        """Pack the first n waiting ids into blocks."""
        ids = np.concatenate(self.held)
        for at in range(0, n, self.block_ids):
            self.blocks.append(pack_bits(ids[at : min(n, at + self.block_ids)], self.bits))
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def save(self, fs, path: str) -> None:
        if self.waiting:
            self._pack(self.waiting)
        ends = np.concatenate([[0], np.cumsum([len(b) for b in self.blocks])]).astype("<u8")
        with fs.open_output_stream(path, compression=None) as out:
            out.write(struct.pack(HEAD, MAGIC, self.bits, self.block_ids, len(self.starts) - 1, self.n, len(self.blocks), int(ends[-1])))
            out.write(np.array(self.starts, "<u8").tobytes())
            out.write(ends.tobytes())
            for b in self.blocks:
                out.write(b)


class Reader:
    """Random access to a file's documents and id ranges."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        magic, self.bits, self.block_ids, self.docs, self.n, blocks, _ = struct.unpack(HEAD, self.file.read(struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a token-id file")
        self.starts = np.frombuffer(self.file.read(8 * (self.docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.file.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.data = struct.calcsize(HEAD) + 8 * (self.docs + 1 + blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop; reads only their blocks."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        self.file.seek(self.data + int(self.offsets[first]))
        raw = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        base, out = first * self.block_ids, []
        for b in range(first, last + 1):
            part = raw[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]]
            out.append(unpack_bits(part, self.bits, min(self.block_ids, self.n - b * self.block_ids)))
        return np.concatenate(out)[start - base : stop - base]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, vocabulary_size: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write documents as token-id files in ascending doc_id order.

    Returns the manifest, staged: file, part and number (files ascend by part, then number),
    n_docs, n_ids, doc_ids (list).
    """
    vocabulary = vocabulary or tokens.vocabulary_path()
    spark = docs.sparkSession

    def width(encoder) -> int:
        return bits_for(max(vocabulary_size or encoder.tokenizer.get_vocab_size(), end_id + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        bits = width(encoder)
        for batch in _common.gathered(batches, "text"):
            ids, lengths = encoder.encode_all(batch.column(2))
            ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
            if bits in (8, 16, 32):  # whole bytes an id: all documents at once
                raw, cuts = pack_bits(ids, bits), np.concatenate([[0], np.cumsum(lengths)]) * (bits // 8)
            else:
                each = [pack_bits(x, bits) for x in np.split(ids, np.cumsum(lengths)[:-1])]
                raw, cuts = b"".join(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
            packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), packed], names=["doc_id", "place", "n_ids", "packed"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _common.filesystem(folder)
        fs.create_dir(base, recursive=True)
        bits, part = width(tokens.encoder(vocabulary)), TaskContext.get().partitionId()
        writer, docs_, number = Writer(bits), [], 0

        def done() -> pa.RecordBatch:
            name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.tokbits"
            writer.save(fs, f"{base}/{name}")
            row = {"file": [f"{folder}/{name}"], "part": [part], "number": [number], "n_docs": [len(docs_)], "n_ids": [writer.n], "doc_ids": [docs_]}
            return pa.RecordBatch.from_arrays([pa.array(row["file"]), pa.array(row["part"], pa.int32()), pa.array(row["number"], pa.int32()), pa.array(row["n_docs"], pa.int64()), pa.array(row["n_ids"], pa.int64()), pa.array(row["doc_ids"], pa.list_(pa.int64()))], names=list(row))

        for batch in _common.slices(batches, "packed"):
            own, lengths = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            raw, cuts = _common.binary(batch.column(3))
            if bits in (8, 16, 32):  # whole bytes an id: all documents at once
                ids = unpack_bits(raw.tobytes(), bits, int(lengths.sum()))
            else:
                ids = np.concatenate([unpack_bits(raw[a:b].tobytes(), bits, int(n)) for a, b, n in zip(cuts, cuts[1:], lengths)])
            ends, at = np.cumsum(lengths), 0
            while at < len(own):
                # As many documents as the file still takes; one at least into an empty file.
                begun = int(ends[at - 1]) if at else 0
                to = max(at + (writer.n == 0), int(np.searchsorted(ends, begun + file_ids - writer.n)))
                if to > at:
                    writer.add(ids[begun : int(ends[to - 1])], lengths[at:to])
                    docs_ += own[at:to]
                if to < len(own):
                    yield done()
                    writer, docs_, number = Writer(bits), [], number + 1
                at = to
        if docs_:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("place"), F.col("text").cast("string").alias("text"))
    packed = _common.staged(rows.mapInArrow(encode, "doc_id long, place long, n_ids long, packed binary"), "token-ids")
    ordered = packed.repartitionByRange(_common.n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "place")
    return _common.staged(ordered.mapInArrow(save, "file string, part int, number int, n_docs long, n_ids long, doc_ids array<long>"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files, read back: doc_id, start (ids of all documents before it), ids (binary, little-endian 32-bit)."""
    return _read(manifest, False)


def read_digests(manifest: DataFrame) -> DataFrame:
    """read() with n_tokens and ids_crc32 in place of the ids."""
    return _read(manifest, True)


def _read(manifest: DataFrame, digest: bool) -> DataFrame:
    # One short row a file, so the running total over files is small; the lists of documents join later.
    bases = manifest.selectExpr("file", "coalesce(sum(n_ids) over (order by part, number rows between unbounded preceding and 1 preceding), 0) as base")
    totals = manifest.select("file", "doc_ids").join(bases, "file")
    schema = "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids binary")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _common.filesystem(row["file"])
                reader = Reader(fs, path)
                starts = reader.starts
                at = 0
                while at < reader.docs:  # runs of documents with about a million ids
                    to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 20), side="right")) - 1)
                    raw = reader.ids(int(starts[at]), int(starts[to])).astype("<u4").tobytes()
                    cuts = (4 * (starts[at : to + 1] - starts[at])).tolist()
                    parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
                    first = [pa.array(row["doc_ids"][at:to], pa.int64()), pa.array(starts[at:to] + row["base"])]
                    if digest:
                        yield pa.RecordBatch.from_arrays([*first, pa.array(np.diff(starts[at : to + 1])), pa.array([zlib.crc32(p) for p in parts], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    else:
                        yield pa.RecordBatch.from_arrays([*first, pa.array(parts, pa.binary())], names=["doc_id", "start", "ids"])
                    at = to
                reader.close()

    return totals.repartition(_common.n_partitions(manifest.sparkSession), "file").mapInArrow(load, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as bit-packed token files and read back: one row per document."""
    manifest = write(_common.documents(spark, sf_dir), _common.scratch(spark, "token-files"))
    return read_digests(manifest)
