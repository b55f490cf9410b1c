"""Benchmark decontamination by SimHash over item-sized windows.

A window has as many words as a benchmark item (fewer only where a document is shorter), and it
leaks the item if their weighted five-word shingles (with their counts) are similar: the sum of
minima over the sum of maxima is at least the threshold. Windows that hold too few of an item's
shingles for that are passed over, by an exact look-up of shingles: a window at the threshold holds at
least that share of them, so none is lost. Every other window gets a 64-bit SimHash. Items stand in a
multi-index: their fingerprints are cut into ``RADIUS`` + 1 blocks, so that any fingerprint within the
radius agrees in a block at least. Items that agree in a block and lie within the radius are then
compared exactly. At similarity 0.8 two fingerprints differ in about 10 bits with a deviation of 3, so
the radius leaves out about one in ten thousand at the threshold, and fewer above it.

The look-up does most of the selection. Blocks of two or three bits agree by chance for nearly all
pairs of unrelated items, and any radius that keeps windows at 0.8 needs such blocks; fingerprints
alone would send every window to most items.

The benchmark is a query set: it goes to the documents in blocks of bounded size, as many as needed.

Defined results: words as in the shingle module, so an item of s < 5 words is its one shingle of s
words; items or texts without words, or null, match nothing; documents with a null id are reported
with it; repeated rows are each reported; an item repeated with the same id and text counts once;
of a document's windows for an item the most similar is returned, ties to the first; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmart.llm import _common, _text

THRESHOLD, RADIUS, WORDS = 0.8, 22, 5
#: Characters of benchmark text that go to the documents at once.
ITEM_CHARS = 8 << 20
RESULT = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"


def simhash(h: np.ndarray) -> int:
    """64-bit fingerprint of shingles, each as often as it occurs."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(h), bitorder="little").view(np.uint64)[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    both, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
    distinct, inverse = np.unique(both, return_inverse=True)
    x, y = np.bincount(inverse[side == 0], minlength=len(distinct)), np.bincount(inverse[side == 1], minlength=len(distinct))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Items of a block: shingles to find windows, fingerprints in a multi-index."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float, radius: int, size: int):
        self.threshold, self.radius = threshold, radius
        words, at = _text.words(pa.array([t for _, t in items], pa.large_string()))
        self.items: list[tuple[int | None, int, int, np.ndarray, int]] = []  # id, words, shingle size, shingles, fingerprint
        self.cuts = np.linspace(0, 64, radius + 2).astype(int).tolist()
        self.blocks: dict[tuple[int, int, int], list[int]] = {}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (item_id, _) in enumerate(items):
            own = words[at[k] : at[k + 1]]
            if not len(own):
                continue
            s = min(size, len(own))
            h = _text.rolled(own, s)
            number, print_ = len(self.items), simhash(h)
            self.items.append((item_id, len(own), s, h, print_))
            found.setdefault(s, []).append((np.unique(h), number))
            for key in self._keys(print_, len(own)):
                self.blocks.setdefault(key, []).append(number)
        #: By shingle size: sorted shingles, the item of each, and a table of their top bits.
        self.lookup = {}
        for s, parts in found.items():
            h, n = np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), k) for p, k in parts])
            order = np.argsort(h, kind="stable")
            top = np.zeros(1 << 20, bool)
            top[(h >> np.uint64(44)).astype(np.int64)] = True
            self.lookup[s] = (h[order], n[order], top)

    def _keys(self, fingerprint: int, words: int) -> list[tuple[int, int, int]]:
        return [(words, b, fingerprint >> lo & (1 << hi - lo) - 1) for b, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:]))]

    def near(self, fingerprint: int, words: int) -> dict[int, int]:
        """Items of that length within the radius, with their distances."""
        seen = {i for key in self._keys(fingerprint, words) for i in self.blocks.get(key, ())}
        apart = {i: (self.items[i][4] ^ fingerprint).bit_count() for i in seen}
        return {i: d for i, d in apart.items() if d <= self.radius}

    def search(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
        """(row, item, start, words, distance, similarity): each row's best window for each item that it leaks."""
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for s, (keys, owner, top) in self.lookup.items():
            h = _text.rolled(words, s)
            hit = np.flatnonzero(top[(h >> np.uint64(44)).astype(np.int64)])
            row = np.searchsorted(at, hit, side="right") - 1
            inside = hit + s <= at[row + 1]
            hit, row = hit[inside], row[inside]
            low, high = np.searchsorted(keys, h[hit], side="left"), np.searchsorted(keys, h[hit], side="right")
            n = high - low
            place, rows = np.repeat(hit, n), np.repeat(row, n)
            item = owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            # Places of each item's shingles in each row, in order.
            order = np.lexsort((place, item, rows))
            place, rows, item = place[order], rows[order], item[order]
            cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (item[1:] != item[:-1])])) if len(place) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(place)]):
                self._windows(int(rows[a]), int(item[a]), place[a:b], h, at, best)
        return [(r, i, start, n, d, x) for (r, i), (x, start, n, d) in sorted(best.items())]

    def _windows(self, row: int, item: int, place: np.ndarray, h: np.ndarray, at: np.ndarray, best: dict) -> None:
        _, words, s, own, _ = self.items[item]
        first, last = int(at[row]), int(at[row + 1])
        width = min(words, last - first)
        least = int(np.ceil(self.threshold * len(own) - 1e-9))
        if len(place) < least:
            return
        # Starts from which the window holds enough of the item's shingles: those where the window reaches the least-th place after some place.
        reach = width - s
        starts: set[int] = set()
        for x, y in zip(place, place[least - 1 :]):
            if y - x <= reach:
                starts.update(range(max(first, int(y) - reach), min(int(x), last - width) + 1))
        for start in sorted(starts):
            part = h[start : start + reach + 1]
            for i, d in self.near(simhash(part), words).items():
                x = similarity(part, self.items[i][3])
                key = (row, i)
                if x >= self.threshold and (key not in best or (x, -start) > (best[key][0], -best[key][1] - first)):
                    best[key] = (x, start - first, width, d)


def item_blocks(benchmark: DataFrame, item_chars: int = ITEM_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items, in lists of about ``item_chars`` characters; none twice. One empty list if there are none."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // item_chars))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        yield [(r["item_id"], r["text"]) for r in part.collect()]  # of bounded size


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, words: int = WORDS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, start_word, n_words, hamming, similarity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, item_chars):
        found = rows.mapInArrow(_search(items, threshold, radius, words), RESULT)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, words: int = WORDS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """The documents that hold no benchmark item."""
    for items in item_blocks(benchmark, item_chars):
        docs = docs.mapInArrow(_keep(items, threshold, radius, words, docs.columns.index("text")), docs.schema)
    return docs


def _index(items: list[tuple[int | None, str]], threshold: float, radius: int, size: int) -> Index:
    """The block's index: a worker builds it once for all its tasks, and keeps the last one alone."""
    cache, key = _common.worker_cache(), (items, threshold, radius, size)
    if cache.get("items", (None,))[0] != key:
        cache["items"] = (key, Index(items, threshold, radius, size))
    return cache["items"][1]


def _keep(items: list[tuple[int | None, str]], threshold: float, radius: int, size: int, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, threshold, radius, size)
        for batch in _common.slices(batches, "text"):
            words, at = _text.words(batch.column(at_text))
            keep = np.ones(batch.num_rows, bool)
            keep[[found[0] for found in index.search(words, at)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _search(items: list[tuple[int | None, str]], threshold: float, radius: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, threshold, radius, size)
        for batch in _common.slices(batches, "text"):
            ids = batch.column(0)
            words, at = _text.words(batch.column(1))
            found = index.search(words, at)
            if found:
                cols = list(zip(*found))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                data = [ids.take(pa.array(cols[0])).to_pylist(), [index.items[i][0] for i in cols[1]], *cols[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, kinds)], names=["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

    return run


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document."""
    return leaks(_common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
