"""Best-fit packing by exact-complement hashing.

The plan works on the counts of piece lengths, of which there are at most ``capacity``: however
many rows there are, the plan stays small. It indexes single, pair and triple length sums: for
the longest length left, it looks for one, two or three available lengths that fill the gap
exactly; failing that, it puts in the longest length that fits (the best fit) and looks again.
Each such pattern is used as often as the counts allow. Pieces then find their places by their
rank among the pieces of their length: no shuffle by sequence, no driver work that grows with
the rows.

Defined results: a null or empty text is a document of its end id alone; rows with the same id
are documents of their own; null ids stay null; an empty table gives no rows; other columns of
the input are ignored (``pack`` keeps them).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginmart.llm import _common, tokens

CAPACITY = 4096
END_ID = 1


class Plan:
    """Which sequence and offset the k-th piece of each length gets, in packed arrays."""

    def __init__(self, counts: np.ndarray, capacity: int):
        """counts: pieces of each length, at 0 to capacity."""
        left = counts.astype(np.int64).copy()
        left[0] = 0
        taken = np.zeros(capacity + 1, np.int64)  # pieces of a length that have a place
        rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        longest = capacity
        while True:
            while longest and not left[longest]:
                longest -= 1
            if not longest:
                break
            pattern = self._pattern(left, longest, capacity)
            times = min(int(left[n]) // k for n, k in pattern.items())
            offset = 0
            for n, k in pattern.items():
                rows.append((n, int(taken[n]), k, self.sequences, offset))
                taken[n] += k * times
                left[n] -= k * times
                offset += n * k
            self.sequences += times
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        #: Key of a (length, rank): ranks stay under 2**48.
        self.keys = (self.rows[:, 0] << 48) + self.rows[:, 1]

    @staticmethod
    def _pattern(left: np.ndarray, first: int, capacity: int) -> dict[int, int]:
        """How many pieces of each length fill one sequence, first among them."""
        free, used, gap = left.copy(), {first: 1}, capacity - first
        free[first] -= 1
        while gap:
            found = exact(free, gap)
            if not found:
                fits = np.flatnonzero(free[: gap + 1] > 0)
                if not len(fits):
                    break
                found = (int(fits[-1]),)
            for n in found:
                used[n] = used.get(n, 0) + 1
                free[n] -= 1
                gap -= n
        return used

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank."""
        row = self.rows[np.searchsorted(self.keys, (length << 48) + rank, side="right") - 1]
        past = rank - row[:, 1]
        return row[:, 3] + past // row[:, 2], row[:, 4] + past % row[:, 2] * length


def exact(free: np.ndarray, gap: int) -> tuple[int, ...]:
    """One, two or three available lengths whose sum is the gap, longest first; () if none."""
    if free[gap] > 0:
        return (gap,)
    have = free[: gap + 1] > 0
    found = _pair(free, have, gap)
    if found:
        return found
    for a in np.flatnonzero(have)[::-1].tolist():
        if 3 * a < gap:
            break
        free[a] -= 1
        rest = _pair(free, free[: gap + 1] > 0, gap - a, a)
        free[a] += 1
        if rest:
            return (a, *rest)
    return ()


def _pair(free: np.ndarray, have: np.ndarray, gap: int, most: int | None = None) -> tuple[int, ...]:
    """Two available lengths a >= b with a + b = gap and a at most ``most``; the longest such a."""
    low, high = (gap + 1) // 2, min(gap - 1, gap if most is None else most)
    if high < low or gap < 2:
        return ()
    both = have[low : high + 1] & have[gap - high : gap - low + 1][::-1]
    if gap % 2 == 0 and free[gap // 2] < 2:
        both[0] = False
    at = np.flatnonzero(both)
    return (low + int(at[-1]), gap - low - int(at[-1])) if len(at) else ()


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset (both long).

    Lengths are integers from 1 to the capacity; rows with a null length, or one outside, get
    nulls. The result is staged once, as ranks need fixed rows.
    """
    # A rank is the number of pieces of the length in earlier write tasks, plus that in the own task.
    schema = T.StructType([*pieces.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_rank", T.LongType())])
    at = pieces.columns.index(length)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            n = np.where((n > 0) & (n <= capacity), n, 0)
            order = np.argsort(n, kind="stable")
            sorted_n = n[order]
            first = np.searchsorted(sorted_n, sorted_n, side="left")
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - first + seen[sorted_n]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task, np.int32)), pa.array(rank)], names=[*batch.schema.names, "_task", "_rank"])

    fixed = _common.staged(pieces.mapInArrow(ranked, schema), "pieces")
    return place(fixed, length, capacity)


def place(fixed: DataFrame, length: str, capacity: int) -> DataFrame:
    """pack() for rows that hold their task and rank within it already."""
    n = F.col(length).cast("long")
    inside = n.between(1, capacity)
    by_task = fixed.where(inside).groupBy("_task", n.alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    by_task = _common.staged(by_task, "length-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("_n").agg(F.sum("_c").alias("c")).collect():  # a row for each length
        counts[r["_n"]] = r["c"]
    plan = Plan(counts, capacity)
    before = by_task.selectExpr("_task", "_n", "coalesce(sum(_c) over (partition by _n order by _task rows between unbounded preceding and 1 preceding), 0) as _before")
    joined = fixed.withColumn("_n", F.when(inside, n)).join(before, ["_task", "_n"], "left").withColumn("_rank", F.col("_before") + F.col("_rank"))
    out = [c for c in fixed.columns if c not in ("_task", "_rank")]
    schema = T.StructType([*[fixed.schema[c] for c in out], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            lengths, ranks = cols["_n"], cols["_rank"]
            ok = lengths.is_valid().to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(ok), np.int64), np.zeros(len(ok), np.int64)
            if ok.any():
                a = lengths.fill_null(0).to_numpy(zero_copy_only=False)[ok]
                b = ranks.fill_null(0).to_numpy(zero_copy_only=False)[ok]
                sequence[ok], offset[ok] = plan.place(a, b)
            yield pa.RecordBatch.from_arrays([*[cols[c] for c in out], pa.array(sequence, mask=~ok), pa.array(offset, mask=~ok)], names=[*out, "sequence_id", "offset"])

    return joined.select(*out, "_n", "_rank").mapInArrow(placed, schema)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts, with their task and rank by length: doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", _task int, _rank long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = [0] * (capacity + 1), TaskContext.get().partitionId()
        encode, end = tokens.encoder(vocabulary).encode, np.array([end_id], np.uint32)
        for batch in _common.gathered(batches, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                raw = np.concatenate([ids, end]).tobytes()
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), *([part] * with_ids), task, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] * with_ids), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids), "_task", "_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize whole documents, end each with ``end_id``, cut only longer ones, and pack the pieces."""
    cut = pieces(docs, vocabulary or tokens.vocabulary_path(), capacity, end_id, with_ids)
    return place(_common.staged(cut, "pieces"), "length", capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), doc_ids and lengths by place; needs ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).selectExpr("sequence_id", "reduce(p.ids, x'', (a, b) -> a || b) as ids", "p.doc_id as doc_ids", "p.length as lengths")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids: one row per piece."""
    return pack_documents(_common.documents(spark, sf_dir))
