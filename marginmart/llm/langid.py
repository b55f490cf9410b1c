"""Language identification by prediction by partial matching.

For each language, a variable-order byte context tree counts what follows every context of up to
``ORDER`` bytes in a bounded sample of its labelled documents. The statistics are then frozen. A
byte costs -log2 of its probability in the longest known context; where the byte is new there, an
escape (method C: distinct symbols over all counts plus distinct symbols) leads to the next shorter
context, and from the empty context to a uniform byte. The language with the shortest code for
the whole text wins. Costs depend on the last ORDER + 1 bytes alone, so a batch looks each of its
different byte strings up once per tree.

The tree reads text in lower case, with each run of white space, digits and ASCII signs as one
space, and a space before and after.

Defined results: null text, or text without any letter, is ``und`` with score 0; languages with
no labelled text in the sample are never predicted; if there is no model at all, all rows are
``und``; equal code lengths go to the language first in the alphabet; repeated rows are predicted
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginmart.llm import _common, _text

#: Longest context, in bytes.
ORDER = 4
#: The fitting sample: documents a language at most, and characters of them in all.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 300_000
UNKNOWN = "und"


def fold(texts: pa.Array) -> pa.Array:
    """Lower case; runs of white space, digits and ASCII signs become one space; a space at both ends."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    space = pa.scalar(" ", pa.large_string())
    return pc.replace_substring_regex(pc.binary_join_element_wise(space, low, space, pa.scalar("", pa.large_string())), r"[\x00-\x60\x7b-\x7f]+", " ")


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the folded texts after the first, the number of its last order + 1 bytes; and the rows' offsets.

    Near a text's start the missing bytes are spaces.
    """
    raw, at = _text.utf8(fold(texts))
    n = np.diff(at)
    out = raw.astype(np.uint64)
    back = np.arange(len(raw)) - np.repeat(at[:-1], n)
    code = out.copy()
    for k in range(1, order + 1):
        shifted = np.full(len(raw), 32, np.uint64)
        shifted[k:] = out[:-k] if k < len(raw) else out[:0]
        shifted[back < k] = 32
        code |= shifted << np.uint64(8 * k)
    keep = back > 0
    return code[keep], np.concatenate([[0], np.cumsum(n - 1)]).astype(np.int64)


class Tree:
    """Frozen counts of one language: for each order, sorted (context, byte) codes and context totals."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.levels = order, []
        for k in range(order + 1):  # contexts of k bytes
            low = codes & np.uint64((1 << (8 * (k + 1))) - 1)
            key, inverse = np.unique(low, return_inverse=True)
            c = np.bincount(inverse, weights=counts).astype(np.int64)
            context, first = np.unique(key >> np.uint64(8), return_index=True)  # the newest byte is lowest: a context's codes lie together
            total = np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64)
            distinct = np.diff(np.concatenate([first, [len(key)]]))
            self.levels.append((key, c, context, total, distinct))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the newest byte of each code."""
        cost, left = np.zeros(len(codes)), np.ones(len(codes), bool)
        for k in range(self.order, -1, -1):
            key, count, context, total, distinct = self.levels[k]
            if not len(key):
                continue
            low = codes & np.uint64((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(context, low >> np.uint64(8)), len(context) - 1)
            known = left & (context[at] == low >> np.uint64(8))
            to = np.minimum(np.searchsorted(key, low), len(key) - 1)
            seen = known & (key[to] == low)
            whole = np.log2(total[at] + distinct[at])
            cost[seen] += (whole - np.log2(count[to]))[seen]
            fails = known & ~seen
            cost[fails] += (whole - np.log2(distinct[at]))[fails]
            left &= ~seen
        cost[left] += 8
        return cost


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, order: int = ORDER) -> dict[str, Tree]:
    """Trees by language from (text, lang) rows: at most ``docs`` documents a language, the first by their text's hash, and whole ones up to ``chars`` characters.

    The driver gets that bounded sample alone.
    """
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where((F.length("text") <= chars) & F.col("lang").isNotNull()).withColumn("_h", F.xxhash64("text"))
    # First the hashes, then the texts of those few: a text that fills a third of the rows counts once.
    # Least of each of 64 parts of a language, then of those: the last step's rows are bounded.
    least = rows.select("lang", "_h").distinct().withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    for keys in (("lang", "_part"), ("lang",)):
        least = least.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= docs).drop("_r")
    least = least.drop("_part")
    texts = rows.join(F.broadcast(least), ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text"))
    picked = sorted(texts.collect(), key=lambda r: (r["lang"], r["_h"]))
    trees = {}
    by: dict[str, list[str]] = {}
    for r in picked:
        by.setdefault(r["lang"], []).append(r["text"])
    for lang in sorted(by):
        used, texts = 0, []
        for t in by[lang]:
            if used + len(t) <= chars:
                used, texts = used + len(t), [*texts, t]
        codes, counts = np.unique(grams(pa.array(texts, pa.large_string()), order)[0], return_counts=True)
        if len(codes):
            trees[lang] = Tree(codes, counts, order)
    return trees


def predict(rows: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """rows (with text) and lang_pred, score: the share of the best language among all, by mean bits a byte."""
    clash = _common.keep_columns(rows, ("lang_pred", "score"))
    rows = rows.withColumnsRenamed(clash)
    names = list(trees)
    at = rows.columns.index("text")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    order = max((t.order for t in trees.values()), default=0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            texts = batch.column(at).cast(pa.large_string())
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, share = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if names and letters.any():
                codes, offsets = grams(texts, order)
                distinct, inverse = np.unique(codes, return_inverse=True)
                total = np.empty((len(names), batch.num_rows))
                for k, name in enumerate(names):
                    run = np.concatenate([[0], np.cumsum(trees[name].bits(distinct)[inverse])])
                    total[k] = run[offsets[1:]] - run[offsets[:-1]]
                mean = total / np.maximum(1, np.diff(offsets))
                least = np.round(total, 6).argmin(0)
                # Bits a byte as exponents: a share that does not saturate with the text's length.
                odds = 2.0 ** np.clip(4 * (mean.min(0) - mean), -60, 0)
                value = 1 / odds.sum(0)
                best = [names[i] if ok else UNKNOWN for i, ok in zip(least, letters)]
                share = np.where(letters, value, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(share, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


def fit_documents(docs: DataFrame) -> dict[str, Tree]:
    """Trees from the documents that are not held out."""
    return fit(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text", "lang"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score."""
    docs = _common.documents(spark, sf_dir)
    trees = fit_documents(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, trees).select("doc_id", "held_out", "lang_pred", "score")
