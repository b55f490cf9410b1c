"""Suffix-array dedup: remove every byte of a long string that also starts earlier.

A window is ``length`` bytes. Two equal windows have the same anchor: the leftmost least hash of
``GRAM`` bytes in them, at the same offset. So windows are dealt by anchor, and only anchors that
occur twice matter; about one byte in thirty is an anchor. The steps:

1. Documents with equal texts: all but the first are removed whole (if long enough), and take no
   further part as originals.
2. Anchors: a task counts those of a batch; what it sees twice is known to repeat, and the others
   meet by their hash. One scan of the texts writes both as a table. Each document gets the hashes of
   its repeating anchors.
3. Segments: with its text, a document yields for each repeating anchor the bytes of all windows
   that have this anchor. Equal segments of a batch are sent once; later ones are covered already.
4. Buckets: the segments of one anchor are a suffix bucket. A task takes a bounded block of
   buckets at a time and sorts their window suffixes by bucket and first COVER bytes; longer ties
   are resolved by the ranks of a difference cover's sample positions, which are computed first,
   and at last by the window's end. Windows of one class are equal; all but the earliest are covered.
   Anchors with more different segments than a block holds (a common line between different
   neighbours) are split first, until no bucket is larger: windows with the anchor in the first or
   second half of its offsets each share more bytes, and these are dealt on by.
5. Covered windows, merged, are cut out of the texts.

Positions come in order of doc_id, then place. Defined results: null text is empty; a null id is
smaller than all; rows that repeat an id with the same text are one document, and get the same
result; rows that repeat an id with other texts are ordered by the text's hash; texts shorter than
the window are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmart.llm import _common, _text

LENGTH, GRAM = 100, 32
#: Modulus of the difference cover, and bytes of segments that are sorted at once.
COVER, BLOCK = 32, 1 << 20
#: Windows whose anchors are found at once: their arrays fit a core's cache.
STEP = 1 << 15
LEAST = -(1 << 63)


def difference_cover(v: int) -> list[int]:
    """Residues such that every difference modulo v is one of two of them; found greedily."""
    cover, missing = [0], set(range(1, v))
    while missing:
        new = lambda d: {(d - c) % v for c in cover} | {(c - d) % v for c in cover}
        best = max((d for d in range(v) if d not in cover), key=lambda d: (len(missing & new(d)), -d))
        missing -= new(best)
        cover.append(best)
    return sorted(cover)


def _slide(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold (minimum or maximum) of each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = fold(x[:-done], x[done:])
        done *= 2
    return fold(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place."""
    h, size, factor = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    total, done = None, 0
    while size <= gram:  # hash of each power of two of bytes; those of gram's bits are joined
        if gram & size:
            total = h if total is None else total[: len(h) - done] * np.uint64(factor) + h[done:] if len(h) > done else h[:0]
            done += size
        if 2 * size <= gram:
            h = h[: len(h) - size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    return _text.mix(total[: len(raw) - gram + 1])


def anchors(raw: np.ndarray, at: np.ndarray, length: int, gram: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of rows: each anchor's hash and place, and the first and last start of its windows.

    Hashes are compared without their lowest bits, where the place stands instead: so the least of a
    window's neighbours names its leftmost place. Works on ``step`` starts at a time.
    """
    none = np.zeros(0, np.int64)
    n = len(raw) - length + 1
    inside = np.ones(max(0, n), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        inside[max(a, b - length + 1) : b] = False
    if not inside.any():
        return np.zeros(0, np.uint64), none, none, none
    bits = (step + length).bit_length()
    low = np.uint64((1 << bits) - 1)
    h, place = np.empty(len(raw) - gram + 1, np.uint64), np.empty(n, np.int64)
    for begin in range(0, n, step):
        x = _gram_hashes(raw[begin : min(begin + step, n) + length - 1], gram)
        h[begin : begin + len(x)] = x
        least = _slide(x & ~low | np.arange(len(x), dtype=np.uint64), length - gram + 1, np.minimum)
        place[begin : begin + len(least)] = (least & low).astype(np.int64) + begin
    # Rows' last starts are outside, so a run of equal places never goes on into another row.
    new = place[1:] != place[:-1]
    first = np.flatnonzero(inside & np.concatenate([[True], new | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([new | ~inside[1:], [True]]))
    return h[place[first]], place[first], first, last


def _repeats(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, document, occurrences in the batch) of each batch's anchors, one for each hash and document."""
    for batch in _common.slices(batches, "text"):
        raw, at = _text.utf8(batch.column(1))
        h, place, _, _ = anchors(raw, at, length, gram)
        ids = batch.column(0).to_numpy()
        if len(h):
            row = np.searchsorted(at, place, side="right") - 1
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            begin = np.concatenate([[True], h[1:] != h[:-1]])
            count = np.diff(np.append(np.flatnonzero(begin), len(h)))[np.cumsum(begin) - 1]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            yield h[once], ids[row[once]], count[once]


def repeating(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(ord, h) of the anchors that occur more than once, of (ord, text) rows."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each hash of a batch, with its document if that is its only place; else its documents follow, with n = 0."""
        for h, ids, n in _repeats(batches, length, gram):
            first = np.concatenate([[True], h[1:] != h[:-1]])
            more = n > 1
            hashes, docs = np.concatenate([h[first], h[more]]), np.concatenate([ids[first], ids[more]])
            count = np.concatenate([np.minimum(n[first], 2), np.zeros(int(more.sum()), np.int64)]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(docs, mask=count > 1), pa.array(count)], names=["h", "ord", "n"])

    found = _common.staged(texts.mapInArrow(probe, "h long, ord long, n byte"), "anchors")
    met = found.where("n > 0").withColumn("total", F.expr("sum(n) over (partition by h)"))
    return met.where("n = 1 and total > 1").select("ord", "h").unionByName(found.where("n = 0").select("ord", "h"))


def squeezed(texts: DataFrame) -> DataFrame:
    """(ord, sub, z) of (ord, text, sub): texts as zstd frames, so that a shuffle moves less."""
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in _common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([pack(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["ord", "sub", "z"])

    return texts.select("ord", "text", "sub").mapInArrow(squeeze, "ord long, sub long, z binary")


def _open(frames: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts of zstd frames, and their offsets."""
    import zstandard

    texts = [zstandard.ZstdDecompressor().decompress(z) for z in frames.to_pylist()]
    return b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def segments(marked: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Of (ord, sub, z, hs): rows (ord, sub, start, stop, h, lead, bytes). Rows without bytes are covered already: start to stop."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "z", 1 << 19):
            data, at = _open(batch.column(2))
            ids, subs, hints = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            h, place, first, last = anchors(np.frombuffer(data, np.uint8), at, length, gram)
            row = np.searchsorted(at, place, side="right") - 1
            wanted = hints.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(hints.offsets.to_numpy()))
            # A hash and row as one number to look up: the rows' numbers are mixed in.
            key = lambda hashes, rows: _text.mix(hashes ^ _text.mix(rows.astype(np.uint64) + np.uint64(1)))
            use = np.flatnonzero(np.isin(key(h, row), key(wanted, owner)))
            use = use[np.lexsort((first[use], subs[row[use]], ids[row[use]]))]
            seen: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
            out: list[tuple] = []
            for hash_, p, a, b, r in zip(h[use].view(np.int64).tolist(), place[use].tolist(), first[use].tolist(), (last[use] + length).tolist(), row[use].tolist()):
                part = data[a:b]
                base = int(at[r])
                here = (int(ids[r]), int(subs[r]), a - base)
                first_one = seen.setdefault((hash_, p - a, part), here)
                if first_one is here:
                    out.append((*here, b - base, hash_, p - a, part))
                elif first_one != here:  # else a repeated row
                    out.append((*here, b - base, hash_, p - a, None))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["ord", "sub", "start", "stop", "h", "lead", "bytes"])

    return marked.mapInArrow(cut, "ord long, sub long, start long, stop long, h long, lead int, bytes binary")


class Block:
    """A bounded block of suffix buckets: the segments of some anchors, in order of document and place within each."""

    def __init__(self, parts: list[bytes], bucket: np.ndarray, lead: np.ndarray, length: int, cover: int):
        self.length, self.cover = length, cover
        # Segments lie so that each anchor's place is a multiple of the cover's modulus: suffixes that can be equal have equal residues.
        sizes = np.array([len(p) for p in parts], np.int64)
        pad = (-lead) % cover
        room = -(-(pad + sizes) // cover) * cover
        self.base = np.concatenate([[0], np.cumsum(room)])[:-1] + pad
        text = bytearray(int(room.sum()) + length + cover + 8)
        for b, p in zip(self.base.tolist(), parts):
            text[b : b + len(p)] = p
        self.text = np.frombuffer(bytes(text), np.uint8)
        windows = sizes - length + 1
        self.segment = np.repeat(np.arange(len(parts)), windows)
        self.offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = self.base[self.segment] + self.offset
        self.bucket, self.lead = bucket, lead

    def words(self, places: np.ndarray) -> np.ndarray:
        """Eight bytes from each place, as a number."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, 8)[places]).view(np.uint64).ravel()

    @staticmethod
    def rank(*keys: np.ndarray) -> np.ndarray:
        """Numbers that are equal where all keys are; in the order of the keys."""
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def sample_ranks(self, residues: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cover's sample, ascending, and the ranks of their next ``depth`` bytes."""
        last = len(self.text) - depth - 8
        places = (np.arange(0, max(1, last // self.cover + 1))[:, None] * self.cover + np.array(residues)).ravel()
        places = places[places <= last]
        by = len(residues)
        ranks = self.rank(*[self.words(places + k) for k in range(0, self.cover, 8)])
        done = self.cover
        while done * 2 <= depth:  # a place one modulus on is a sample place as well
            ahead = np.minimum(np.arange(len(places)) + by * (done // self.cover), len(places) - 1)
            ranks = self.rank(ranks, ranks[ahead])
            done *= 2
        if done < depth:
            ranks = self.rank(ranks, *[self.words(places + min(k, depth - 8)) for k in range(done, depth, 8)])
        return places, ranks

    def classes(self) -> np.ndarray:
        """A class number of each window; windows of one bucket, offset to the anchor and content share it."""
        key = self.rank(self.bucket[self.segment], self.lead[self.segment] - self.offset)
        alive = np.arange(len(key))
        out = -1 - alive  # classes of their own

        def refine(*more: np.ndarray) -> None:
            """Sort the windows still tied by further keys; those now alone are done."""
            nonlocal key, alive
            key = self.rank(key, *more)
            tied = np.bincount(key)[key] > 1
            key, alive = key[tied], alive[tied]

        refine(self.words(self.start[alive]))
        for k in range(8, self.cover, 8):
            refine(self.words(self.start[alive] + k))
        if len(alive):
            depth = self.length - self.cover
            residues = difference_cover(self.cover)
            ahead = np.array([min((r - x) % self.cover for r in residues) for x in range(self.cover)])
            places, ranks = self.sample_ranks(residues, depth)
            sample = self.start[alive] + ahead[self.start[alive] % self.cover]
            at = np.searchsorted(places, sample)
            refine(ranks[at])
            # The sample's ranks reach ``depth`` bytes from at most COVER - 1 in; the rest is the window's end.
            for k in range(self.length - self.cover, self.length, 8):
                refine(self.words(self.start[alive] + min(k, self.length - 8)))
            out[alive] = key
        return out

    def covered(self) -> list[tuple[int, int, int]]:
        """(segment, first, stop): runs of windows that an earlier segment has, as byte ranges of the segment."""
        number = self.classes()
        order = np.lexsort((self.segment, number))
        again = np.zeros(len(number), bool)
        again[order[1:]] = number[order[1:]] == number[order[:-1]]
        at = np.flatnonzero(again)
        if not len(at):
            return []
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (self.segment[at[1:]] != self.segment[at[:-1]])]))
        first, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
        return list(zip(self.segment[first].tolist(), self.offset[first].tolist(), (self.offset[last] + self.length).tolist()))


def sort_buckets(sent: DataFrame, length: int = LENGTH, cover: int = COVER, block: int = BLOCK) -> DataFrame:
    """(ord, sub, start, stop) ranges that earlier windows cover, of segment rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, int, tuple[int, int, int], bytes]] = []  # bucket, place of the anchor, position, bytes
        out: list[tuple[int, int, int, int]] = []
        seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        bucket, held = None, 0

        def flush() -> None:
            if kept:
                buckets, lead, who, parts = zip(*kept)
                for k, a, b in Block(list(parts), np.array(buckets, np.int64), np.array(lead, np.int64), length, cover).covered():
                    ord_, sub, start = who[k]
                    out.append((ord_, sub, start + a, start + b))
                kept.clear()

        def rows() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), (), ()))], names=["ord", "sub", "start", "stop"])
            out.clear()
            return done

        def close() -> None:
            nonlocal held
            if len(seen) == 1:  # one content: nothing to compare
                held -= len(kept.pop()[3])
            if held >= block:
                flush()
                held = 0

        for batch in batches:
            for ord_, sub, start, stop, h, lead, part in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if h != bucket:
                    close()
                    bucket, seen = h, {}
                here = (ord_, sub, start)
                before = seen.setdefault((lead, part), here)
                if before is here:
                    kept.append((h, lead, here, part))
                    held += len(part)
                elif before != here:  # else a repeated row
                    out.append((ord_, sub, start, stop))
            yield rows()
        close()
        flush()
        yield rows()

    n = _common.n_partitions(sent.sparkSession)
    ordered = sent.where("bytes is not null").select("ord", "sub", "start", "stop", "h", "lead", "bytes").repartition(n, "h").sortWithinPartitions("h", "ord", "sub", "start")
    return ordered.mapInArrow(work, "ord long, sub long, start long, stop long")


def spread(sent: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> tuple[list[DataFrame], list[DataFrame]]:
    """(known, rows) of segment rows: ranges that equal segments cover, and rows for sort_buckets of which no bucket holds more than ``block`` bytes of different segments.

    The windows of an oversized bucket have their anchor at offsets low to high. Those up to the middle
    all hold the bytes from low before the anchor to the middle's end, the others likewise; each half
    goes to the buckets of those bytes. At a single offset these are the whole window, so that a bucket
    holds one content. A bucket is a hash: others that share it are told apart by content when sorted.
    """
    columns = ["ord", "sub", "start", "stop", "h", "lead", "bytes"]
    rest = sent.select(*columns, F.lit(0).alias("low"), F.lit(length - gram).alias("high"))
    known, rows = [], []
    while True:
        parts = rest.where("bytes is not null and low < high")
        # By all segments first, without their bytes; then by different ones.
        large = rest.groupBy("h").agg(F.sum(F.col("stop") - F.col("start")).alias("size")).where(F.col("size") > block).select("h")
        different = parts.join(F.broadcast(large), "h").groupBy("h", "lead", F.xxhash64("bytes")).agg(F.max(F.octet_length("bytes")).alias("size"))
        hot = _common.staged(different.groupBy("h").agg(F.sum("size").alias("size")).where(F.col("size") > block).select("h"), "hot")
        if hot.isEmpty():
            return known, [*rows, rest.where("bytes is not null").select(*columns)]
        rows += [parts.join(F.broadcast(hot), "h", "left_anti").select(*columns), rest.where("bytes is not null and low = high").select(*columns)]
        many = parts.join(F.broadcast(hot), "h")
        # Of equal segments the first stays; rows that repeat its document are that same segment.
        first = many.groupBy("h", "lead", "bytes", "low", "high").agg(F.min(F.struct("ord", "sub", "start", "stop")).alias("at"))
        first = _common.staged(first.select("at.*", "h", "lead", "bytes", "low", "high"), "distinct")
        known.append(many.select("ord", "sub", "start", "stop").join(first.select("ord", "sub", "start", "stop"), ["ord", "sub", "start", "stop"], "left_anti"))
        middle = "cast(floor((low + high) / 2) as int)"
        halves = first.withColumn("half", F.explode(F.expr(f"array(struct(low as l, {middle} as r), struct({middle} + 1 as l, high as r))")))
        # The half's windows of the segment: those with the anchor at offsets most down to least.
        halves = halves.selectExpr("*", "least(lead, half.r) as most", f"greatest(lead - (cast(stop - start as int) - {length}), half.l) as least").where("most >= least")
        rest = halves.selectExpr("ord", "sub", "start + (lead - most) as start", f"start + (lead - least) + {length} as stop", f"xxhash64(h, half.l, half.r, substring(bytes, lead - half.l + 1, {length} - half.r + half.l)) as h", "most as lead", f"substring(bytes, lead - most + 1, most - least + {length}) as bytes", "half.l as low", "half.r as high")
        rest = _common.staged(rest, "halves")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending ranges; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(rows: DataFrame) -> DataFrame:
    """Of (ord, sub, z, ranges): n_removed, n_spans, kept_sha256."""
    schema = "ord long, sub long, n_removed long, n_spans long, kept_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "z", 1 << 19):
            out = []
            data, at = _open(batch.column(2))
            for k, ranges in enumerate(batch.column(3).to_pylist()):
                text = data[at[k] : at[k + 1]]
                spans = merged([(r["start"], r["stop"]) for r in ranges])
                edges = [0, *(x for s in spans for x in s), len(text)]
                left = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
                out.append((len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            kinds, names = [pa.int64(), pa.int64(), pa.string()], ["n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], names=["ord", "sub", *names])

    return rows.select("ord", "sub", "z", "ranges").mapInArrow(work, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ord (a null id is smaller than all) and own (the text's hash)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).withColumn("text", text).withColumn("own", F.xxhash64("text"))


def _named(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """rows with sub, which tells the texts of one id apart and is 0 where it has only one."""
    return rows.join(clashes, "ord", "left").withColumn("sub", F.when(F.col("clash"), F.col("own")).otherwise(F.lit(0).cast("long"))).drop("clash", "own")


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cover: int = COVER, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, clashes, ranges): a row per document with its text's digest; ids with several texts; and the covered byte ranges of each (ord, sub) that is no later copy of a whole text."""
    keyed = _keyed(docs.select("doc_id", "text"))
    base = _common.staged(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "ord", F.sha2("text", 256).alias("sha"), "own", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    clashes = base.groupBy("ord").agg(F.min("sha").alias("low"), F.max("sha").alias("high")).where("low <> high").select("ord", F.lit(True).alias("clash"))
    clashes = _common.staged(clashes, "clashes")
    # The first of each text; rows that repeat its id too are that same document.
    first = base.groupBy("sha").agg(F.min("ord").alias("first_ord"))
    copy = (F.col("ord") > F.col("first_ord")) & (F.col("n_bytes") >= length)
    base = _common.staged(_named(base, clashes).join(first, "sha").select("doc_id", "ord", "sub", "sha", "n_bytes", copy.alias("copy")), "firsts")
    copies = base.where("copy and sub = 0").select("ord").distinct()

    texts = _named(keyed.where(F.octet_length("text") >= length).select("ord", "text", "own"), clashes)
    hints = repeating(texts.select("ord", "text"), length, gram).join(copies, "ord", "left_anti").groupBy("ord").agg(F.collect_set("h").alias("hs"))
    sent = _common.staged(segments(squeezed(texts).join(hints, "ord").select("ord", "sub", "z", "hs"), length, gram), "segments")
    known = sent.where("bytes is null").select("ord", "sub", "start", "stop")
    equal, buckets = spread(sent, length, gram, block)
    for more in (*equal, sort_buckets(reduce(DataFrame.unionByName, buckets), length, cover, block)):
        known = known.unionByName(more)
    ranges = known.groupBy("ord", "sub").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    return base, clashes, ranges


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cover: int = COVER, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    base, clashes, ranges = covered(docs, length, gram, cover, block)
    texts = _named(_keyed(docs.select("doc_id", "text")).select("ord", "text", "own"), clashes)
    rest = cut(squeezed(texts).join(ranges, ["ord", "sub"])).dropDuplicates(["ord", "sub"])
    out = base.join(_common.staged(rest, "cut"), ["ord", "sub"], "left")
    copied = F.col("copy")
    return out.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cover: int = COVER) -> DataFrame:
    """docs with the covered bytes cut out of text; documents of which nothing is left go.

    Signs of which the cut leaves only some bytes go too. Texts that lose nothing stay as they are.
    """
    base, clashes, ranges = covered(docs, length, gram, cover)
    whole = base.where("copy").select("ord", "sub", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("ranges")).dropDuplicates(["ord", "sub"])
    ranges = ranges.unionByName(whole).groupBy("ord", "sub").agg(F.flatten(F.collect_list("ranges")).alias("_ranges"))
    # The documents' columns travel under numbers, so that none of them meets a helper column's name.
    numbers = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (F.col(numbers[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*numbers).withColumn("ord", F.coalesce(id_.cast("long"), F.lit(LEAST))).withColumn("own", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    rows = _named(rows, clashes).join(ranges, ["ord", "sub"], "left").select(*numbers, "_ranges")
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, numbers[at]):
            texts = batch.column(at).to_pylist()
            for k, ranges in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if ranges:
                    raw, place, left = texts[k].encode(), 0, []
                    for a, b in merged([(r["start"], r["stop"]) for r in ranges]):
                        left.append(raw[place:a].decode(errors="ignore"))
                        place = b
                    texts[k] = "".join(left) + raw[place:].decode(errors="ignore") or None
            gone = pa.array([t is None and bool(r) for t, r in zip(texts, batch.column(batch.num_columns - 1).to_pylist())])
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(docs_columns))]
            out = pa.RecordBatch.from_arrays(columns, names=docs_columns)
            yield out.filter(pc.invert(gone))

    docs_columns = docs.columns
    return rows.mapInArrow(work, docs.schema)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier: counts and digests."""
    return dedup(_common.documents(spark, sf_dir))
