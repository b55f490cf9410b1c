"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each document is the set of its five-word shingles. Documents with equal sets are one class, and
only classes are joined. A class has a signature of ``longest`` MinHashes in each of ``trees``
tries; sorted, these signatures are a prefix trie. Two classes are candidates if they share a long
enough prefix in some trie. How long is decided pair by pair: the least similarity at or above the
threshold that sets of these two sizes can have tells the longest prefix at which such a pair is
found with the target recall (short sets need no short prefixes). The matched prefix is shortened
from full length on, and every level adds the pairs that meet first there and may be that short.
The shortest level follows from the threshold: 4 of 8 at the defaults. No stop is estimated from the
pairs already found, as it could lose a link.

Spark groups the classes by their shortest prefix in each trie; large groups are cut into blocks, by
classes and by shingles; a task sorts a pair of blocks and walks its levels. A pair belongs to the
first trie in which it meets: so every pair is looked at once. Its similarity is then exact, from the
whole texts. Pairs stay inside their task: it returns, for each class, the number of its links and
its place in a spanning forest, whose components are the groups of near copies.

Defined results: a document with fewer than five words has one shingle, all its words; documents
without words are a class only if their texts are equal, and have no links; null text is empty;
rows with a null id have null classes, 0 links and 1 copy; repeated rows are each returned and
count as copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmart.llm import _common, _text
from marginmart.llm.components import components

THRESHOLD, RECALL = 0.8, 0.9999
TREES, LONGEST = 20, 8
#: Classes, and shingles, of one block of a prefix group.
BLOCK, SHINGLES = 512, 1 << 19
#: MinHashes of a signature have 16 bits: eight fill two words.
WORD = 4


def depth_for(threshold: float, recall: float, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix at which a pair at the threshold is found with that recall."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sorted distinct shingles of each row, the rows' offsets, and a key of each set (of the text, if the set is empty)."""
    h, at = _text.shingles(texts)
    rows = [np.unique(h[a:b]) for a, b in zip(at, at[1:])]
    keys = []
    for k, r in enumerate(rows):
        raw = b"s" + r.tobytes() if len(r) else b"t" + (texts[k].as_py() or "").encode()
        keys.append(hashlib.sha256(raw).digest()[:16])
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *rows]), offsets, keys


def similarity_for(depth: int, recall: float, trees: int = TREES) -> float:
    """The least similarity of a pair that a prefix of this length finds with that recall."""
    return (1 - (1 - recall) ** (1 / trees)) ** (1 / depth)


def masks(depth: int) -> tuple[int, int]:
    """The bits of a signature's two words that its first ``depth`` MinHashes take."""
    bits = lambda n: (1 << 64) - (1 << 64 - 16 * min(max(n, 0), WORD))
    return bits(depth), bits(depth - WORD)


def signed(h: np.ndarray, at: np.ndarray, longest: int, trees: int) -> np.ndarray:
    """Rows' signatures, two words for each trie; rows without shingles have zeros."""
    out = np.zeros((len(at) - 1, trees, 2), np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    if not len(full):
        return out
    factors = _text.mix(np.arange(1, trees * longest + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for t in range(trees):
        for d in range(longest):
            least = np.minimum.reduceat((h * factors[t * longest + d]) >> np.uint64(8), at[full])
            out[full, t, d // WORD] |= _text.mix(least) >> np.uint64(48) << np.uint64(48 - 16 * (d % WORD))
    return out


def signatures(docs: DataFrame, longest: int = LONGEST, trees: int = TREES) -> DataFrame:
    """doc_id, key, n_shingles, tries (the signatures' words) of every document."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            h, at, keys = sets(batch.column(1))
            words = signed(h, at, longest, trees).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * 2 * trees), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(at)), lists], names=["doc_id", "key", "n_shingles", "tries"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, key binary, n_shingles long, tries array<long>")


class Levels:
    """How far the matched prefix of a pair may be shortened: from ``longest`` to ``shortest``."""

    def __init__(self, threshold: float, recall: float, trees: int, longest: int):
        if not 0 < longest <= 2 * WORD:
            raise ValueError("a signature has one to eight MinHashes")
        self.threshold, self.trees, self.longest = threshold, trees, longest
        self.shortest = depth_for(threshold, recall, trees, longest)
        self.least = [similarity_for(d, recall, trees) for d in range(self.shortest + 1, longest + 1)]

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The prefix length at which pairs of sets of these sizes are found; above ``longest`` where none can reach the threshold."""
        both = a + b
        shared = np.ceil(self.threshold * both / (1 + self.threshold) - 1e-9)
        similar = shared / (both - shared)
        depth = self.shortest + np.searchsorted(np.array(self.least), similar, side="right")
        return np.where(shared <= np.minimum(a, b), depth, self.longest + 1)

    def pairs(self, tries: np.ndarray, tree: int, sizes: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), by i, of a block pair that meet first in this trie.

        side: 0 or 1 for two blocks (pairs lie across), 2 for one block.
        """
        n = len(tries)
        order = np.lexsort((tries[:, tree, 1], tries[:, tree, 0]))
        tries, sizes, side = tries[order], sizes[order], side[order]
        apart = tries[1:, tree] ^ tries[:-1, tree]
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        inner = np.arange(1, n + 1)  # where each row's node one level deeper ends
        for depth in range(self.longest, self.shortest - 1, -1):
            cuts = np.append(np.flatnonzero((apart & np.array(masks(depth), np.uint64)).any(1)) + 1, n)
            ends = cuts[np.searchsorted(cuts, np.arange(n), side="right")]
            for i in np.flatnonzero(ends > inner).tolist():
                js = np.arange(inner[i], ends[i])
                if side[i] != 2:
                    js = js[side[js] != side[i]]
                need = self.needed(sizes[i], sizes[js])
                js, need = js[need <= depth], need[need <= depth]
                for d in np.unique(need).tolist() if tree else ():
                    at = np.flatnonzero(need == d)
                    first, second = (np.uint64(m) for m in masks(d))
                    gap = (tries[js[at], :tree, 0] ^ tries[i, :tree, 0]) & first
                    if d > WORD:
                        gap |= (tries[js[at], :tree, 1] ^ tries[i, :tree, 1]) & second
                    need[at[(gap == 0).any(1)]] = 0  # met in an earlier trie
                js = js[need > 0]
                one.append(np.full(len(js), i))
                two.append(js)
            inner = ends
        i, j = order[np.concatenate(one)], order[np.concatenate(two)]
        i, j = np.minimum(i, j), np.maximum(i, j)
        order = np.lexsort((j, i))
        return i[order], j[order]


def _shared(h: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Shared shingles of each pair of rows: bit sets of the shingles that two rows have at least, in stretches."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    distinct, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    common = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    row, column = row[keep], common[inverse[keep]]
    total, width = np.zeros(len(one), np.int64), 1 << 18
    starts = np.searchsorted(one, np.arange(len(at)))
    for first in range(0, int((counts > 1).sum()), width):
        inside = (column >= first) & (column < first + width)
        flags = np.zeros((len(at) - 1, min(width, int((counts > 1).sum()) - first)), bool)
        flags[row[inside], column[inside] - first] = True
        bits = np.packbits(flags, axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        for i in np.unique(one):
            pick = slice(starts[i], starts[i + 1])
            total[pick] += np.bitwise_count(bits[two[pick]] & bits[i]).sum(1, dtype=np.int64)
    return total


def _roots(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The first row of each row's component under the links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[one], root[two])
        np.minimum.at(root, one, least)
        np.minimum.at(root, two, least)
        root = root[root]
        if (root == before).all():
            return root


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, longest: int = LONGEST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(classes, forest): a row per document with its key; and per class its links and spanning edges.

    classes: doc_id, key, first_id (the class's least document), n_copies. forest: key, n_links, root.
    """
    levels = Levels(threshold, recall, trees, longest)
    rows = _common.staged(signatures(docs, longest, trees), "signatures")
    named = rows.where("doc_id is not null")
    classes = named.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("tries").alias("tries"))
    classes = _common.staged(classes, "classes")

    # Groups of two classes at least, in blocks; a block meets every other block of its group, and itself.
    one, two = (m - (1 << 64 if m >> 63 else 0) for m in masks(levels.shortest))
    nodes = [F.xxhash64(F.col("tries")[2 * t].bitwiseAND(F.lit(one)), F.col("tries")[2 * t + 1].bitwiseAND(F.lit(two))) for t in range(trees)]
    spread = classes.where("n_shingles > 0").select("key", "n_shingles", F.posexplode(F.array(*nodes)).alias("tree", "prefix"))
    groups = spread.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size")).where("n > 1")
    groups = groups.select("tree", "prefix", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / SHINGLES)).alias("blocks"))
    member = spread.drop("n_shingles").join(groups, ["tree", "prefix"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    met = member.select("key", "tree", "prefix", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", "tree", "prefix", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own")
    # Few bytes, much work: as many tasks as the session names.
    carried = met.join(classes.select("key", "n_shingles", "tries"), "key").repartition(_common.n_partitions(docs.sparkSession), "tree", "prefix", "b1", "b2")

    def wanted(table: pa.Table) -> pa.Table:
        """Classes of a block pair that have a pair of their own there."""
        keys, sizes, side, tries, tree = _block(table)
        one, two = levels.pairs(tries, tree, sizes, side)
        use = np.unique(np.concatenate([one, two]))
        return table.take(pa.array(use)).select(["tree", "prefix", "b1", "b2", "own", "key", "n_shingles", "tries"])

    schema = "tree int, prefix long, b1 long, b2 long, own long, key binary, n_shingles long, tries array<long>"
    needed = _common.staged(carried.groupBy("tree", "prefix", "b1", "b2").applyInArrow(wanted, schema), "candidates")

    def verify(table: pa.Table) -> pa.Table:
        # A repeated id with another text has another key: only the class's own text counts.
        h, at, found = sets(table.column("text").combine_chunks())
        keys = table.column("key").to_pylist()
        first: dict[bytes, int] = {}
        for k, (said, key) in enumerate(zip(keys, found, strict=True)):
            if said == key:
                first.setdefault(key, k)
        rows = np.array(sorted(first.values()), np.int64)
        table = table.take(pa.array(rows))
        h, at = np.concatenate([np.zeros(0, np.uint64), *[h[at[r] : at[r + 1]] for r in rows]]), np.concatenate([[0], np.cumsum(at[rows + 1] - at[rows])])
        keys, sizes, side, tries, tree = _block(table)
        one, two = levels.pairs(tries, tree, sizes, side)
        shared = _shared(h, at, one, two)
        alike = shared / (sizes[one] + sizes[two] - shared) >= threshold
        one, two = one[alike], two[alike]
        count = np.bincount(one, minlength=len(keys)) + np.bincount(two, minlength=len(keys))
        root = _roots(len(keys), one, two)
        linked = np.flatnonzero(count)
        return pa.table({"key": pa.array([keys[i] for i in linked], pa.binary()), "n_links": pa.array(count[linked], pa.int64()), "root": pa.array([keys[i] for i in root[linked]], pa.binary())})

    where = needed.join(classes.select("key", F.col("first_id").alias("doc_id")), "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    forest = where.join(texts, "doc_id").drop("doc_id").groupBy("tree", "prefix", "b1", "b2").applyInArrow(verify, "key binary, n_links long, root binary")
    forest = _common.staged(forest, "links")
    return named.select("doc_id", "key").join(classes.select("key", "first_id", "n_copies"), "key"), forest


def _block(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, int]:
    """keys, sizes, sides, signatures and trie of a block pair's rows."""
    n = table.num_rows
    tries = table.column("tries").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1, 2)
    own, b1, b2 = (table.column(c).to_numpy() for c in ("own", "b1", "b2"))
    side = np.where(b1 == b2, 2, (own == b2).astype(np.int64))
    return table.column("key").to_pylist(), table.column("n_shingles").to_numpy(), side, tries, int(table.column("tree")[0].as_py()) if n else 0


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its group of linked classes), copy_of (the least id with an equal set), n_copies, n_links (other classes at the threshold or above)."""
    classes, forest = links(docs, threshold, recall, trees, longest, block)
    counts = forest.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    roots = components(forest.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    rows = classes.join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # Groups' least ids: only of classes with links; others are their own group.
    linked = rows.where("n_links > 0").groupBy("root").agg(F.min("first_id").alias("group_id"))
    out = rows.join(linked, "root", "left").select("doc_id", F.coalesce("group_id", "first_id").alias("class_id"), F.col("first_id").alias("copy_of"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their classes of near copies and numbers of links."""
    return near_duplicates(_common.documents(spark, sf_dir))
