"""Filter interaction audit: what each filter removes, in every order of the filters, for each part.

Each part's rows are dealt into blocks by id range. A block keeps its ids in ascending order and,
per filter, the sorted posting list of the places of its failing ids; flags (such as a label) have
lists of the same kind. Of each block the sizes of all unions of filters are taken by galloping
merges: the shorter sorted list is looked up in the longer, each search going on from the last.
Sizes add up over blocks, and every figure of every order is a difference of union sizes:

    removed by f after the filters P      |P + f| - |P|
    failing f, removed earlier            |f| - that
    failing f only                        |all| - |all but f|
    Shapley sum of f over all orders      sum over P of |P|! (n - 1 - |P|)! times removed

A part with a third of all rows has many blocks; no task sees more than one block's ids at a time.

Defined results: a null text is empty; a null part is the empty string; rows with a null id take
part, and neither repeat another row's text nor are repeated by one; repeated rows each count; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmart.llm import _common

#: Rows of a block at most.
BLOCK_ROWS = 1 << 16
#: Rows of an Arrow batch where rows are short.
SHORT_ROWS = 10_000
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"

#: A test sees (words, whole text as bytes, code points) and says whether the text fails.
TESTS: dict[str, Callable[[list[bytes], bytes, int], bool]] = {
    "A": lambda words, raw, points: len(words) < 200,
    "B": lambda words, raw, points: 100 * len(set(words)) < 50 * len(words),
    "C": lambda words, raw, points: 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 2 * points,
    "D": lambda words, raw, points: len(raw.translate(None, SIGNS)) < len(raw),
}
REPEATS = "E"


def verdicts(docs: DataFrame, tests: dict[str, Callable] = TESTS, repeats: str = REPEATS) -> DataFrame:
    """part, doc_id and a boolean column per filter (true: fails); ``repeats`` names the filter on texts that a smaller id has, table-wide. Staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            failed, digests = {name: [] for name in tests}, []
            for text in batch.column(2).to_pylist():
                raw = (text or "").encode()
                words = raw.split()  # of bytes: at the six ASCII spaces
                for name, test in tests.items():
                    failed[name].append(test(words, raw, len(text or "")))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), *(pa.array(x, pa.bool_()) for x in failed.values())], names=["part", "doc_id", "digest", *failed])

    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tested = _common.staged(rows.mapInArrow(run, "part string, doc_id long, digest binary, " + ", ".join(f"`{t}` boolean" for t in tests)), "filter-tests")
    # Of texts that stand more than once the least id, as a table: the join can then split a text that fills a third of the rows.
    first = _common.staged(tested.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "filter-repeats")
    return tested.join(first, "digest", "left").select("part", "doc_id", *tests, F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias(repeats))


def postings(rows: DataFrame, filters: list[str], flags: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per block of rows (part, doc_id, boolean filters and flags): part, ids (ascending, null first), fails and marks: a sorted list of places for each filter and flag. Staged."""
    names = [*filters, *flags]
    kinds = [("part", pa.string()), ("ids", pa.list_(pa.int64())), ("fails", pa.list_(pa.list_(pa.int32()))), ("marks", pa.list_(pa.list_(pa.int32())))]

    def block(part: str, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = [np.flatnonzero(whole.column(2 + k).to_numpy()).astype(np.int32) for k in range(len(names))]
        values = [[part], [whole.column(1).to_pylist()], [lists[: len(filters)]], [lists[len(filters) :]]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, kinds)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = None, [], 0
        for batch in batches:
            parts = batch.column(0).to_pylist()
            at = 0
            while at < len(parts):
                if held and (parts[at] != part or n == block_rows):
                    yield block(part, held)
                    held, n = [], 0
                part, to = parts[at], at + 1
                while to < len(parts) and parts[to] == part and n + to - at < block_rows:
                    to += 1
                held.append(batch.slice(at, to - at))
                n += to - at
                at = to
        if held:
            yield block(part, held)

    own = rows.select("part", "doc_id", *(F.coalesce(F.col(c), F.lit(False)).alias(f"v{k}") for k, c in enumerate(names)))
    ranged = own.repartitionByRange(_common.n_partitions(rows.sparkSession), "part", "doc_id").sortWithinPartitions("part", "doc_id")
    schema = "part string, ids array<long>, fails array<array<int>>, marks array<array<int>>"
    return _common.staged(ranged.mapInArrow(run, schema), "filter-postings", SHORT_ROWS)


def found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the ascending keys stand in the other ascending list; numpy's search of ascending keys goes on from the last place."""
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection: the shorter list gallops through the longer."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int(found(a, b).sum())


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge of two sorted lists: the shorter's own places are put between the longer's."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    fresh = b[~found(b, a)]
    return np.insert(a, np.searchsorted(a, fresh), fresh)


def unions(blocks: DataFrame, n_filters: int, n_flags: int) -> DataFrame:
    """part, subset (bits of the filters), failing (rows that fail any of them) and flagged (how many of those bear each flag), summed over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part, ids, fails, marks in zip(*(batch.column(k).to_pylist() for k in range(4))):
                lists = [np.array(x, np.int32) for x in fails]
                flags = [np.array(x, np.int32) for x in marks]
                merged = [np.zeros(0, np.int32)]
                for subset in range(1, 1 << n_filters):
                    low = subset & -subset
                    merged.append(union(merged[subset ^ low], lists[low.bit_length() - 1]))
                out += [(part, subset, len(ids), len(m), [common(m, f) for f in flags]) for subset, m in enumerate(merged)]
            if out:
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["part", "subset", "n", "failing", "flagged"])

    sizes = blocks.mapInArrow(run, "part string, subset int, n long, failing long, flagged array<long>")
    sums = [F.sum(F.col("flagged")[k]).alias(f"flag{k}") for k in range(n_flags)]
    added = sizes.groupBy("part", "subset").agg(F.sum("n").alias("n"), F.sum("failing").alias("failing"), *sums)
    return added.select("part", "subset", "n", "failing", F.array(*(f"flag{k}" for k in range(n_flags))).cast("array<long>").alias("flagged"))


def audit(sizes: DataFrame, filters: list[str], flags: list[str]) -> DataFrame:
    """The figures of every order and step from the unions' sizes: part, filter_order, step, kept, removed, redundant, unique_fails, <flag>_lost, shapley.

    Filters have one letter each; a part's 2^n sizes come together as one map.
    """
    n = len(filters)
    whole = (1 << n) - 1
    table = sizes.groupBy("part").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("subset", "failing"))).alias("u"), *(F.map_from_entries(F.collect_list(F.struct("subset", F.col("flagged")[k]))).alias(f"u_{flag}") for k, flag in enumerate(flags)))
    orders = F.array(*(F.lit("".join(o)) for o in itertools.permutations(filters)))
    steps = table.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    earlier = F.expr("substring(filter_order, 1, step - 1)")
    bits = lambda text: sum((F.when(F.instr(text, f) > 0, 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    letter = F.expr("substring(filter_order, step, 1)")
    steps = steps.withColumn("before", bits(earlier)).withColumn("own", bits(letter)).withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    size = lambda of, subset: F.element_at(of, subset)

    def shapley(k: int):
        rest = [s for s in range(1 << n) if not s >> k & 1]
        weight = lambda s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
        return sum((weight(s) * (size("u", F.lit(s | 1 << k)) - size("u", F.lit(s))) for s in rest), F.lit(0).cast("long"))

    removed = size("u", F.col("after")) - size("u", F.col("before"))
    by_filter = F.array(*(shapley(k) for k in range(n)))
    steps = steps.withColumn("by_filter", by_filter)
    return steps.select(
        "part", "filter_order", "step",
        (F.col("n") - size("u", F.col("after"))).alias("kept"),
        removed.alias("removed"),
        (size("u", F.col("own")) - removed).alias("redundant"),
        (size("u", F.lit(whole)) - size("u", F.lit(whole).bitwiseXOR(F.col("own")))).alias("unique_fails"),
        *((size(f"u_{flag}", F.col("after")) - size(f"u_{flag}", F.col("before"))).alias(f"{flag}_lost") for flag in flags),
        F.element_at("by_filter", F.instr(F.lit("".join(filters)), letter)).alias("shapley"),
    )


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders: a row per part, order and step."""
    filters, flags = [*TESTS, REPEATS], ["good", "toxic"]
    rows = verdicts(_common.documents(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.bool_or(F.expr("quality = 1")).alias("good"), F.bool_or(F.expr("toxic = 1")).alias("toxic"))
    rows = rows.join(labels, rows["doc_id"] == labels["label_id"], "left").drop("label_id")
    return audit(unions(postings(rows, filters, flags), len(filters), len(flags)), filters, flags)


OP11_SQL = r"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT part, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT part, doc_id,
        CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
      + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS m FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, m, count(*) AS c, count(*) FILTER (good) AS c_good, count(*) FILTER (toxic) AS c_toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
p AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (SELECT p1.x || p2.x || p3.x || p4.x || p5.x AS filter_order, [p1.b, p2.b, p3.b, p4.b, p5.b] AS bs
      FROM p p1, p p2, p p3, p p4, p p5 WHERE p1.b + p2.b + p3.b + p4.b + p5.b = 31
        AND (p1.b | p2.b | p3.b | p4.b | p5.b) = 31),
s AS (SELECT filter_order, step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::BIGINT AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN (m & (before | own)) = 0 THEN c ELSE 0 END) AS kept,
        sum(CASE WHEN (m & before) = 0 AND (m & own) <> 0 THEN c ELSE 0 END) AS removed,
        sum(CASE WHEN (m & before) <> 0 AND (m & own) <> 0 THEN c ELSE 0 END) AS redundant,
        sum(CASE WHEN m = own THEN c ELSE 0 END) AS unique_fails,
        sum(CASE WHEN (m & before) = 0 AND (m & own) <> 0 THEN c_good ELSE 0 END) AS good_lost,
        sum(CASE WHEN (m & before) = 0 AND (m & own) <> 0 THEN c_toxic ELSE 0 END) AS toxic_lost
      FROM g, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM x
"""
