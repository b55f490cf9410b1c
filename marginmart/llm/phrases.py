"""Phrase collocations from FM-indexes: counts of n-grams by bidirectional BWT interval extension.

Documents are dealt into shards of one language. A shard's words are numbered locally, and its
index is kept as a row of a table: the words and two transforms, the word before each context
(contexts sorted by the words that follow) and the word after it (sorted by the words that
precede), both sorted to a limited depth. An interval pair of an n-gram is extended to the right
by the words in its stretch of the second transform, and then to the left by those of the first;
interval sizes are counts. Counts are summed across shards by Spark.

Depth by depth only n-grams whose parts are frequent in the whole language are extended (no
others can be): the shards' words are counted, numbered and joined back; pairs are counted, and the
frequent ones joined back with their intervals; longer ones extend these. Nothing is dropped that
could reach the count.

Punctuation and line ends are a separator word that no n-gram spans; so a long text is cut at
separators into several shards, and only a single piece is always taken whole.

Defined results: a null text is empty, a null language is ``und``; repeated rows each count; an
empty table gives no rows; other columns and null ids are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginmart.llm import _common

#: Words of a shard, unless one piece has more, and bytes of text that are cut into words at a time.
SHARD_WORDS, CUT_BYTES = 3 << 20, 1 << 20
#: Rows of an Arrow batch where rows are short.
SHORT_ROWS = 20_000
#: No byte of a UTF-8 text.
MARK = b"\xff"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A-Z in lower case; the signs that end a piece, and line ends, as the mark.
RULE = _LOWER.translate(bytes.maketrans(b".,;:!?\n\x0b\x0c\r", MARK * 10))


def stretches(raw: bytes, limit: int = CUT_BYTES) -> Iterator[bytes]:
    """A marked text in stretches of at least ``limit`` bytes that end at marks."""
    at = 0
    while at < len(raw):
        to = raw.find(MARK, at + limit)
        to = len(raw) if to < 0 else to + 1
        yield raw[at:to]
        at = to


class Shard:
    """Collects the words of one language's texts; word 0 is the separator."""

    def __init__(self):
        self.number: dict[bytes, int] = {MARK: 0}
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, stretch: bytes) -> None:
        words = stretch.replace(MARK, b" \xff ").split()
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
        self.parts += [np.fromiter(map(number.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
        self.n += len(words) + 1

    def words(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)


def sorted_contexts(words: np.ndarray, depth: int, step: int) -> np.ndarray:
    """Places of a circular text in order of the ``depth`` words from each on, read in steps of 1 or -1."""
    wide = int(words.max()) + 1 if len(words) else 1
    order, rank = np.argsort(words), words.astype(np.int64)
    for d in range(1, depth):
        # One more word in front of what is ranked already.
        key = words.astype(np.int64) * wide + np.roll(rank, -step)
        order = np.argsort(key)
        if d < depth - 1:
            new = np.empty(len(key), np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, wide = new, int(new.max()) + 1
    return order


def transforms(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each context in order of the words from it on, and the word after each in order of the words back from it."""
    before = np.roll(words, 1)[sorted_contexts(words, depth, 1)]
    after = np.roll(words, -1)[sorted_contexts(words, depth, -1)]
    return before, after


def extensions(transform: np.ndarray, start: np.ndarray, size: np.ndarray, wide: int, places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All one-word extensions of intervals of a transform.

    Returns parent (place among the intervals), word, count, first (if ``places``: place in the
    transform of the word's first occurrence in the interval) and lesser (how many words of the
    interval are smaller: where the extension begins within its parent's interval of the other index).
    """
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    parent = np.repeat(np.arange(len(size)), size)
    place = np.arange(at[-1]) - at[parent] + start[parent]
    key = parent * wide + transform[place]
    if places:
        order = np.argsort(key, kind="stable")
        place, key = place[order], key[order]
    else:
        key.sort()
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(key)))
    own, word = key[begin] // wide, key[begin] % wide
    return own, word, count, place[begin] if places else begin, begin - at[own]


def backward(transform: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the extended intervals in the transform's own index: occurrences of a word keep their order when the transform is sorted."""
    order = np.argsort(transform, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[first]


def codes(*tables: np.ndarray) -> list[np.ndarray]:
    """A number for each row of tables of ints with equal widths; equal rows have equal numbers."""
    both = np.concatenate(tables)
    code = np.zeros(len(both), np.int64)
    for column in both.T:
        code = np.unique(code * (int(column.max(initial=0)) + 1) + column, return_inverse=True)[1].astype(np.int64)
    return np.split(code, np.cumsum([len(t) for t in tables])[:-1])


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x, "<i4").tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), "<i4").astype(np.int64)


def shards(docs: DataFrame, max_words: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index table, staged: shard, lang, size, n_words, words, counts, before, after; a task builds the shards of its rows one after the other."""
    kinds = [("shard", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("n_words", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.binary()), ("before", pa.binary()), ("after", pa.binary())]

    def row(lang: str, shard: Shard, number: int) -> pa.RecordBatch:
        words, names = shard.words(), list(shard.number)
        counts = np.bincount(words, minlength=len(names))
        before, after = transforms(words, max_words - 1)
        values = [number, lang, len(words), int(counts[1:].sum()), [w.decode() for w in names[1:]], _pack(counts), _pack(before), _pack(after)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, kinds)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, Shard] = {}
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in _common.slices(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for stretch in stretches(text.encode().translate(RULE)):
                    held.setdefault(lang, Shard()).add(stretch)
                    if held[lang].n >= shard_words:
                        yield row(lang, held.pop(lang), next(numbers))
                    elif sum(s.n for s in held.values()) >= 2 * shard_words:  # many languages
                        largest = max(held, key=lambda x: held[x].n)
                        yield row(largest, held.pop(largest), next(numbers))
        for lang, shard in held.items():
            yield row(lang, shard, next(numbers))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    schema = "shard long, lang string, size long, n_words long, words array<string>, counts binary, before binary, after binary"
    return _common.staged(rows.mapInArrow(run, schema), "phrase-shards", **{"parquet.block.size": 16 << 20})


def vocabulary(index: DataFrame) -> DataFrame:
    """shard, lang, w (local number), word, n: each shard's words and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(2).slice(k, 1).flatten()
                n = len(words)
                counts = _unpack(batch.column(3)[k].as_py(), n + 1)[1:]
                for at in range(0, n, SHORT_ROWS):
                    part = words.slice(at, SHORT_ROWS)
                    m = len(part)
                    same = lambda c: pa.repeat(batch.column(c)[k], m)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array(np.arange(at + 1, at + 1 + m, dtype=np.int32)), part, pa.array(counts[at : at + m])], names=["shard", "lang", "w", "word", "n"])

    return index.select("shard", "lang", "words", "counts").mapInArrow(run, "shard long, lang string, w int, word string, n long")


def _level(d: int) -> list[str]:
    return [f"g{k}" for k in range(1, d + 1)]


def pairs(index: DataFrame, known: DataFrame) -> DataFrame:
    """Right extensions of the frequent words by frequent words: shard, g1, g2 (global numbers), l1, l2 (local), start (in the forward index), n."""
    names = ["shard", "g1", "g2", "l1", "l2", "start", "n"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        outs = [pa.table([pa.array([], t) for t in (pa.int64(), *[pa.int64()] * 2, *[pa.int32()] * 3, pa.int64())], names=names)]
        for k in range(left.num_rows):
            shard = left.column(0)[k]
            n, counts = left.column(1)[k].as_py(), left.column(2)[k].as_py()
            after = _unpack(left.column(3)[k].as_py(), n)
            wide = left.column(4)[k].as_py() + 1
            counts = _unpack(counts, wide)
            starts = np.concatenate([[0], np.cumsum(counts)])
            number = np.full(wide, -1, np.int64)
            number[right.column(1).to_numpy()] = right.column(2).to_numpy()
            mine = np.flatnonzero(number >= 0)
            # A word's interval is the same in both indexes.
            parent, word, count, _, lesser = extensions(after, starts[mine], counts[mine], wide, False)
            good = number[word] >= 0
            l1, l2 = mine[parent[good]], word[good]
            values = [number[l1], number[l2], l1.astype(np.int32), l2.astype(np.int32), (starts[l1] + lesser[good]).astype(np.int32), count[good]]
            outs.append(pa.table([pa.repeat(shard, len(l1)), *(pa.array(v) for v in values)], names=names))
        return pa.concat_tables(outs)

    left = index.select("shard", "size", "counts", "after", F.size("words").alias("n_names"))
    schema = "shard long, g1 long, g2 long, l1 int, l2 int, start int, n long"
    return left.groupBy("shard").cogroup(known.select("shard", "w", "g").groupBy("shard")).applyInArrow(run, schema)


def longer(index: DataFrame, frequent: DataFrame, d: int, last: bool) -> DataFrame:
    """Left extensions of the frequent (d-1)-grams whose own left part is frequent too: shard, g1..gd, l1..ld, start (unless last), n."""
    names = ["shard", *_level(d), *(f"l{k}" for k in range(1, d + 1)), "start", "n"]
    m = d - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        outs = [pa.table([pa.array([], t) for t in (pa.int64(), *[pa.int64()] * d, *[pa.int32()] * (d + 1), pa.int64())], names=names)]
        for k in range(left.num_rows if right.num_rows else 0):
            shard = left.column(0)[k]
            n, wide = left.column(1)[k].as_py(), left.column(3)[k].as_py() + 1
            before = _unpack(left.column(2)[k].as_py(), n)
            globals_ = np.stack([right.column(1 + j).to_numpy() for j in range(m)], axis=1)
            locals_ = np.stack([right.column(1 + m + j).to_numpy().astype(np.int64) for j in range(m)], axis=1)
            parent, word, count, first, _ = extensions(before, right.column(1 + 2 * m).to_numpy().astype(np.int64), right.column(2 + 2 * m).to_numpy(), wide, not last)
            heads = np.concatenate([word[:, None], locals_[parent][:, : m - 1]], axis=1)
            code, have = codes(heads, locals_)
            order = np.argsort(have)
            at = np.searchsorted(have[order], code)
            at[at == len(have)] = 0
            head = order[at]
            good = have[head] == code
            parent, word, count, first, head = parent[good], word[good], count[good], first[good], head[good]
            start = np.zeros(len(word), np.int64) if last else backward(before, first)
            columns = [globals_[head, 0], *globals_[parent].T, word.astype(np.int32), *locals_[parent].astype(np.int32).T, start.astype(np.int32), count]
            outs.append(pa.table([pa.repeat(shard, len(word)), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=names))
        return pa.concat_tables(outs)

    left = index.select("shard", "size", "before", F.size("words").alias("n_names"))
    right = frequent.select("shard", *_level(m), *(f"l{k}" for k in range(1, d)), "start", "n")
    schema = "shard long, " + ", ".join(f"g{k} long" for k in range(1, d + 1)) + ", " + ", ".join(f"l{k} int" for k in range(1, d + 1)) + ", start int, n long"
    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(run, schema)


def counts(docs: DataFrame, min_count: int, max_words: int, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, dict[int, DataFrame]]:
    """(lang, n) totals; frequent words (lang, word, g, f); and for each length from 2 the frequent n-grams (g1.., f). All but the totals staged."""
    index = shards(docs, max_words, shard_words)
    totals = index.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = vocabulary(index)
    spark = docs.sparkSession
    parts = _common.n_partitions(spark)
    # Numbers of this table are fixed by writing it; rank in its partition and partition make them small.
    numbered = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count).withColumn("at", F.monotonically_increasing_id())
    numbered = numbered.withColumn("g", F.expr(f"(at & {(1 << 33) - 1}) * {4 * parts + 1000} + (at >> 33)")).drop("at")
    frequent = _common.staged(numbered, "phrase-words", SHORT_ROWS)
    known = words.join(frequent.select("lang", "word", "g"), ["lang", "word"]).select("shard", "w", "g")
    grams: dict[int, DataFrame] = {}
    found = pairs(index, known) if max_words > 1 else None
    for d in range(2, max_words + 1):
        g = _level(d)
        if d == max_words:
            summed = found.groupBy(*g).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        else:
            # The shards' rows of an n-gram meet once: those of frequent ones are what goes back to the shards.
            found = _common.staged(found.withColumn("f", F.sum("n").over(Window.partitionBy(*g))).where(F.col("f") >= min_count), "phrase-found", SHORT_ROWS)
            summed = found.groupBy(*g).agg(F.max("f").alias("f"))
            found = longer(index, found, d + 1, d + 1 == max_words)
        grams[d] = _common.staged(summed, "phrase-grams", SHORT_ROWS)
    return totals, frequent, grams


def mine(docs: DataFrame, min_count: int = 10, max_words: int = 3, top: int = 2000, covered_percent: int = 50) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase scores floor(10^6 a^2 / (l r)) at its lowest-scoring cut, first among equals. One that a
    longer candidate covers in ``covered_percent`` of its occurrences is left out.
    """
    totals, words, grams = counts(docs, min_count, max_words)
    sides = {1: words.select(F.col("g").alias("g1"), "f"), **grams}
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    levels = []
    for d, found in grams.items():
        rows = found.withColumnRenamed("f", "a")
        for k in range(1, d):
            for side, first, size in (("l", 1, k), ("r", k + 1, d - k)):
                keys = [f"g{first + j}" for j in range(size)]
                part = sides[size].toDF(*keys, f"{side}{k}")
                rows = rows.join(part, keys)
        if d + 1 in grams:
            # Counts fall with length, so candidates longer by one word suffice.
            wider = grams[d + 1].select(F.explode(F.array(*(F.struct(*(F.col(f"g{s + j}").alias(f"g{j + 1}") for j in range(d)), F.col("f").alias("wide")) for s in (1, 2)))).alias("x")).select("x.*")
            rows = rows.join(wider.groupBy(*_level(d)).agg(F.max("wide").alias("wide")), _level(d), "left")
            rows = rows.where(F.coalesce(100 * exact("wide") < covered_percent * exact("a"), F.lit(True))).drop("wide")
        cuts = [F.struct(F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000) div (cast(l{k} as decimal(18,0)) * cast(r{k} as decimal(18,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, d)]
        rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
        for j in range(1, d + 1):
            rows = rows.join(words.select(F.col("g").alias(f"g{j}"), F.col("word").alias(f"word{j}"), *([F.col("lang")] if j == 1 else [])), f"g{j}")
        levels.append(rows.select("lang", F.concat_ws(" ", *(f"word{j}" for j in range(1, d + 1))).alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    candidates = levels[0]
    for more in levels[1:]:
        candidates = candidates.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two and three words in all documents, by language."""
    return mine(_common.documents(spark, sf_dir))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id,
             unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
u AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
t AS (SELECT lang, ws[i] AS a1, ws[i + 1] AS a2, ws[i + 2] AS a3 FROM u),
n1 AS (SELECT lang, a1 AS x, count(*) AS f FROM t GROUP BY ALL),
n2 AS (SELECT lang, a1 AS x, a2 AS y, count(*) AS f FROM t WHERE a2 IS NOT NULL GROUP BY ALL),
n3 AS (SELECT lang, a1 AS x, a2 AS y, a3 AS z, count(*) AS f FROM t WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT n2.lang, n2.x || ' ' || n2.y AS phrase, n2.f AS a, l.f AS l, r.f AS r,
         ((1000000::HUGEINT * n2.f * n2.f) // (l.f::HUGEINT * r.f)) AS score
       FROM n2 JOIN n1 l ON l.lang = n2.lang AND l.x = n2.x JOIN n1 r ON r.lang = n2.lang AND r.x = n2.y
       WHERE n2.f >= 10 AND NOT EXISTS (SELECT 1 FROM n3 WHERE n3.lang = n2.lang AND n3.x = n2.x AND n3.y = n2.y AND 100 * n3.f >= 50 * n2.f)
         AND NOT EXISTS (SELECT 1 FROM n3 WHERE n3.lang = n2.lang AND n3.y = n2.x AND n3.z = n2.y AND 100 * n3.f >= 50 * n2.f)),
k3 AS (SELECT n3.lang, n3.x || ' ' || n3.y || ' ' || n3.z AS phrase, n3.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
         (1000000::HUGEINT * n3.f * n3.f) // (l1.f::HUGEINT * r1.f) AS s1, (1000000::HUGEINT * n3.f * n3.f) // (l2.f::HUGEINT * r2.f) AS s2
       FROM n3 JOIN n1 l1 ON l1.lang = n3.lang AND l1.x = n3.x JOIN n2 r1 ON r1.lang = n3.lang AND r1.x = n3.y AND r1.y = n3.z
         JOIN n2 l2 ON l2.lang = n3.lang AND l2.x = n3.x AND l2.y = n3.y JOIN n1 r2 ON r2.lang = n3.lang AND r2.x = n3.z),
c AS (SELECT lang, phrase, a, l, r, score FROM c2
      UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM k3),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c),
s AS (SELECT lang, sum(f) AS n FROM n1 GROUP BY lang)
SELECT o.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN s USING (lang) WHERE rank <= 2000
"""
