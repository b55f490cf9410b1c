"""Language-model scoring by stupid backoff.

The corpus is all the documents, and a document is scored by the counts of all the others: its
own n-grams are taken off. So scores do not depend on a sample, and backing off is real.

    S(w | context) = c(context w) / c(context)      if c(context w) > 0
                   = ALPHA * S(w | shorter context)  otherwise
    S(w) = c(w) / N, or ALPHA / (N + 1) for a word that no other document has

Counts are relational: documents go to blocks of bounded size by a hash; each block counts its
distinct n-grams and sends them to buckets by the n-gram's hash, packed as arrays; a bucket sums
them over blocks and answers each block, in the order it was asked; the block then looks its
documents' n-grams up and sums their logarithms. A frequent n-gram is one entry a block. Nothing is
left out to save space: hashes go whole, as differences of ascending ones, and all arrays and texts
as zstd frames; the lengths of n-grams are counted one after the other.

Defined results: words as in the shingle module; null or empty text has 0 words, score 0 and a null
mean; null ids stay; repeated rows are documents of their own, so each sees the others' words; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmart.llm import _common, _text
from marginmart.llm.suffixes import _open

ORDER, ALPHA = 2, 0.4
#: Bytes of text of one block.
BLOCK_BYTES = 16 << 20
#: The word rule as a pattern, for counting on the JVM.
WORD = r"[A-Za-z0-9_[^\x00-\x7f]]+"


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers as a zstd frame of their byte planes: bytes that are zero in all cost nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(frame: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes, as differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(frame: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(frame), dtype=np.uint64)


def _grams(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash of the n-gram that ends at each word, for n = 1 to order (0 where the row has too few words before), and the rows' offsets."""
    words, ends = [], [np.zeros(1, np.int64)]
    n = 0
    for batch in _common.slices(iter(table.to_batches()), "z", 1 << 19):
        data, places = _open(batch.column(batch.schema.get_field_index("z")))
        h, at = _text.words(pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(places), pa.py_buffer(data)))
        words.append(h)
        ends.append(at[1:] + n)
        n += len(h)
    h, at = np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate(ends)
    place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    out = []
    for k in range(1, order + 1):
        code = np.zeros(len(h), np.uint64)
        code[k - 1 :] = _text.rolled(h, k)
        code[place < k - 1] = 0
        out.append(code)
    return out, at


def _asked(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block, ascending, and their counts."""
    distinct, counts = np.unique(grams, return_counts=True)
    return distinct[distinct != 0], counts[distinct != 0]


def _dealt(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets that have keys, each with its keys' places, ascending."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    return list(zip(used.tolist(), np.split(order, first[1:])))


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, log_score (natural logarithm, summed), mean_log."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")), F.lit(0)).alias("words")).first()
    blocks, corpus = max(1, -(-size["bytes"] // block_bytes)), size["words"]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in _common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([pack(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "block", "z"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).mapInArrow(squeeze, "doc_id long, block long, z binary")

    def ask(table: pa.Table) -> pa.Table:
        grams, _ = _grams(table, order)
        out: list[tuple] = []
        block = table.column("block")[0].as_py()
        for n, codes in enumerate(grams, 1):
            keys, counts = _asked(codes)
            for bucket, at in _dealt(keys, blocks):
                out.append((bucket, n, block, _packed_keys(keys[at]), _packed(counts[at])))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 5, kinds)], names=["bucket", "n", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [_unpacked_keys(k) for k in table.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        counts = np.concatenate([_unpacked(c) for c in table.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, weights=counts)[inverse].astype(np.uint64)
        parts = [_packed(t) for t in np.split(totals, ends[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"), "totals": pa.array(parts, pa.binary())})

    def rate(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        grams, at = _grams(table, order)
        parts = dict(zip(zip(answers.column("n").to_pylist(), answers.column("bucket").to_pylist()), answers.column("totals").to_pylist()))
        rows_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        others = []  # counts in other documents, for each order
        for k, code in enumerate(grams, 1):
            keys, _ = _asked(code)
            totals = np.zeros(len(keys), np.int64)
            for bucket, where in _dealt(keys, blocks):
                totals[where] = _unpacked(parts[k, bucket])
            valid = np.flatnonzero(code)
            place = np.searchsorted(keys, code[valid])
            # The document's own count of each of its n-grams.
            own_order = np.lexsort((rows_of[valid], place))
            p, r = place[own_order], rows_of[valid][own_order]
            new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])])) if len(p) else np.zeros(0, np.int64)
            own = np.zeros(len(p), np.int64)
            own[own_order] = np.repeat(np.diff(np.append(new, len(p))), np.diff(np.append(new, len(p))))
            left = np.zeros(len(code), np.int64)
            left[valid] = totals[place] - own
            others.append(left)
        n = np.diff(at)
        rest = (corpus - n)[rows_of].astype(float)
        place = np.arange(len(rows_of)) - np.repeat(at[:-1], n)
        most = np.minimum(order, place + 1)
        # From the shortest context up: the longest that is found stays.
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(others[0] > 0, np.log(others[0] / rest) + (most - 1) * np.log(alpha), most * np.log(alpha) - np.log(rest + 1))
            for k in range(2, order + 1):
                context = np.concatenate([[0], others[k - 2][:-1]])
                found = np.log(others[k - 1] / context) + (most - k) * np.log(alpha)
                value = np.where((others[k - 1] > 0) & (most >= k), found, value)
        total = np.bincount(rows_of, weights=value, minlength=len(n)) if len(value) else np.zeros(len(n))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n), "log_score": pa.array(total)})

    asked = dealt.groupBy("block").applyInArrow(ask, "bucket long, n int, block long, keys binary, counts binary")
    answers = asked.groupBy("bucket", "n").applyInArrow(answer, "block long, bucket long, n int, totals binary")
    rated = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, "doc_id long, n_words long, log_score double")
    return rated.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round(F.col("log_score") / F.nullif("n_words", F.lit(0)), 6).alias("mean_log"))


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the bigram and word counts of all the others."""
    return score(_common.documents(spark, sf_dir))


def op7_backoff_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the trigram, bigram and word counts of all the others."""
    return score(_common.documents(spark, sf_dir), order=3)


OP7_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10FFFF}]+') AS ws FROM documents),
p AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) > 0),
b AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM p),
n AS (SELECT count(*) AS n FROM p),
c1 AS (SELECT w, count(*) AS c FROM p GROUP BY w), d1 AS (SELECT r, w, count(*) AS c FROM p GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w), d2 AS (SELECT r, v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY r, v, w),
l AS (SELECT r, count(*) AS n FROM p GROUP BY r),
s AS (SELECT b.r, n.n - l.n AS rest, b.v IS NOT NULL AS two, c1.c - d1.c AS one, coalesce(c2.c - d2.c, 0) AS both_c, coalesce(cv.c - dv.c, 0) AS context
      FROM b JOIN l ON l.r = b.r CROSS JOIN n JOIN c1 ON c1.w = b.w JOIN d1 ON d1.r = b.r AND d1.w = b.w
      LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN d2 ON d2.r = b.r AND d2.v = b.v AND d2.w = b.w
      LEFT JOIN c1 cv ON cv.w = b.v LEFT JOIN d1 dv ON dv.r = b.r AND dv.w = b.v),
t AS (SELECT r, sum(CASE WHEN both_c > 0 THEN ln(both_c / context)
                         WHEN one > 0 THEN ln(one / rest) + CASE WHEN two THEN ln(0.4) ELSE 0 END
                         ELSE ln(0.4) * CASE WHEN two THEN 2 ELSE 1 END - ln(rest + 1) END) AS x FROM s GROUP BY r)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, round(coalesce(t.x, 0), 6) AS log_score, round(t.x / nullif(len(w.ws), 0), 6) AS mean_log
FROM w LEFT JOIN t ON t.r = w.r
"""
