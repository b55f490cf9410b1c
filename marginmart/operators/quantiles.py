"""Exact quantiles by selection: no sort of the column, no group in one task.

A value falls into an order-preserving bin (equal steps of its logarithm, mirrored below zero).
One scan counts the bins of every group; cumulative counts name the few bins that hold a wanted
position; a second scan takes only the rows of those bins, folded to (value, count).  Sums and
counts of the group travel in the first scan, so a summary needs no scan of its own.

Bounds: a group has at most ``2 * 1456 * BINS`` bins, whatever its rows, so the window over a
group's bins is small even for a group with a third of all rows.  Where a wanted bin holds
more than ``refine_rows`` rows, its folded values are cut into ``SUB`` equal steps between the
bin's own least and greatest value, at most three times; after that no bin has more than about a
thousand different doubles.  The wanted bins are broadcast only if they are at most
``BROADCAST_ROWS``; beyond, Spark joins by size.  ``method="approx"`` uses
``percentile_approx`` (a mergeable sketch) instead, for callers that accept its rank error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import join_on

# Quantiles are rounded to this many decimals (well below the 4-decimal money inputs), so a
# result does not depend on the last bit of the interpolation arithmetic.
DIGITS = 6
# Bins per factor of e: a bin spans about 1.6 % of its values.
BINS = 64
# Steps of one refinement, rows of a wanted bin that are refined no further, rows of a broadcast.
SUB, REFINE_ROWS, BROADCAST_ROWS = 4096, 1 << 20, 100_000


def _num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _pin(s: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared checkpoint folder.  The frame is persisted for the
    duration of the write, so checkpointing does not run the shuffle and sort twice."""
    ensure_checkpoint_dir(s.sparkSession)
    s = s.persist(StorageLevel.MEMORY_AND_DISK)
    pinned = s.checkpoint(eager=True)
    s.unpersist()
    return pinned


def value_bin(v: Column, bins: int = BINS) -> Column:
    """Order-preserving bin of a double (the logarithm is monotone by its specification); null for null.

    Magnitudes from the least to the greatest double have logarithms between -745 and 710."""
    inf = float("inf")
    step = (F.floor((F.log(F.abs(v)) + 746.0) * bins) + 1).cast("bigint")
    far = F.lit(2 * 1456 * bins).cast("bigint")
    return (F.when(v == 0, F.lit(0).cast("bigint")).when(v == inf, far).when(v == -inf, -far)
             .when(v > 0, step).when(v < 0, -step))


def _values(df: DataFrame, keys: Sequence[str], value: str | Column, extra: Sequence[Column] = ()) -> DataFrame:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select(*[F.col(k) for k in keys], F.when(~F.isnan(v), v).alias("_v"), *extra)


def fold(df: DataFrame, keys: Sequence[str], value: str | Column, sums: Mapping[str, Column] | None = None,
         bins: int = BINS) -> DataFrame:
    """The first scan: per (keys, bin) the values' count, least and greatest, and the sums.

    Missing values have a null bin of their own, which counts nothing but carries sums."""
    sums = sums or {}
    d = _values(df, keys, value, [c.alias(f"_s_{n}") for n, c in sums.items()])
    return (d.groupBy(*keys, value_bin(F.col("_v"), bins).alias("_b"))
             .agg(F.count("_v").alias("_cnt"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                  *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums]))


def _q(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def wanted(folded: DataFrame, keys: Sequence[str], probs: Mapping[str, float], sums: Sequence[str] = ()) -> DataFrame:
    """The bins that hold a wanted position, each with its positions (``_hits``) and the group's size and sums.

    A group without values keeps one row without positions."""
    group = f"over (partition by {_q(keys)})"
    own = [f"sum(`_s_{n}`) {group} as `_s_{n}`" for n in sums]
    earlier = f"over (partition by {_q(keys)} order by _b rows between unbounded preceding and 1 preceding)"
    c = folded.selectExpr(*[f"`{k}`" for k in keys], "_b", "_cnt", "_lo", "_hi", f"coalesce(sum(_cnt) {earlier}, 0L) as _before",
                          f"sum(_cnt) {group} as _n", *own)
    ends = ", ".join(f"named_struct('q', '{name}', 'end', '{end}', 'pos', {fn}({float(p)!r}d * cast(_n - 1 as double)))"
                     for name, p in probs.items() for end, fn in (("lo", "floor"), ("hi", "ceil")))
    c = c.withColumn("_hits", F.expr(f"filter(array({ends}), e -> e.pos >= _before and e.pos < _before + _cnt)"))
    return c.where("size(_hits) > 0 or (_n = 0 and _b is null)")


def runs(df: DataFrame, keys: Sequence[str], value: str | Column, open_bins: DataFrame, on: Sequence[str],
         broadcast: bool, bins: int = BINS) -> DataFrame:
    """The second scan: the values in the given (distinct) bins, folded to (keys, bin, value, count)."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    b = value_bin(F.when(~F.isnan(v), v), bins)
    d = df.select(*[F.col(k) for k in keys], v.alias("_v"), b.alias("_b"))
    kept = join_on(d, open_bins.select(*on, "_b"), [*on, "_b"], "left_semi", broadcast=broadcast)
    return kept.where("_v is not null").groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))


def _located(rows: DataFrame, opened: DataFrame, keys: Sequence[str], step: str, size: str) -> DataFrame:
    """Rows of the open bins in order of ``step``, each with the positions that fall in it.

    An open bin's own row comes first in its window (null step, size 0) and brings its positions: no join."""
    at = [*keys, "_b"]
    head = opened.select(*at, "_before", "_hits")
    both = rows.unionByName(head, allowMissingColumns=True)
    bin_ = f"partition by {_q(at)}"
    before = f"max(_before) over ({bin_}) + coalesce(sum({size}) over ({bin_} order by {step} nulls first rows between unbounded preceding and 1 preceding), 0L)"
    names = [c for c in rows.columns]
    both = both.selectExpr(*[f"`{c}`" for c in names], f"{before} as _before", f"first(_hits) over ({bin_} order by {step} nulls first) as _hits")
    both = both.withColumn("_hits", F.expr(f"filter(_hits, e -> e.pos >= _before and e.pos < _before + {size})"))
    return both.where(f"{step} is not null and size(_hits) > 0")


def pick(want: DataFrame, folded_values: DataFrame | None, keys: Sequence[str], refine_rows: int = REFINE_ROWS,
         most: int | None = None) -> DataFrame:
    """(keys, q, end, value) of every wanted position; ``most`` is the largest open bin's size, if known."""
    chosen = lambda d, v: d.selectExpr(*[f"`{k}`" for k in keys], "inline(transform(_hits, h -> named_struct('q', h.q, 'end', h.end)))", f"{v} as _v")
    sure = chosen(want.where("_lo = _hi"), "_lo")
    if folded_values is None:
        return sure
    opened, rows, at = want.where("_lo < _hi"), folded_values, [*keys, "_b"]
    for _ in range(3):
        most = opened.agg(F.max("_cnt")).first()[0] if most is None else most
        if not most or most <= refine_rows:
            break
        ranges = opened.select(*at, "_lo", "_hi")
        step = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SUB), F.lit(SUB - 1))
        cut = _pin(join_on(rows, ranges, at).select(*at, step.alias("_s"), "_v", "_c"))
        parts = cut.groupBy(*at, "_s").agg(F.sum("_c").alias("_cnt"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        deeper = F.col("_b") * SUB + F.when(F.col("_b") < 0, F.col("_s") - SUB).otherwise(F.col("_s"))
        parts = _pin(_located(parts, opened, keys, "_s", "_cnt").withColumn("_b", deeper).drop("_s"))
        sure = sure.unionByName(chosen(parts.where("_lo = _hi"), "_lo"))
        opened = parts.where("_lo < _hi")
        rows = join_on(cut.withColumn("_b", deeper).drop("_s"), opened.select(*at), at, "left_semi")
        most = None
    return sure.unionByName(chosen(_located(rows, opened, keys, "_v", "_c"), "_v"))


def interpolated(want: DataFrame, picked: DataFrame, keys: Sequence[str], probs: Mapping[str, float],
                 digits: int | None = DIGITS, sums: Sequence[str] = ()) -> DataFrame:
    """keys, one column per quantile (linear interpolation, like ``percentile`` / DuckDB ``quantile_cont``) and the sums."""
    carried = ["_n", *[f"_s_{n}" for n in sums]]
    named = want.select(*keys, *carried)
    both = named.unionByName(picked, allowMissingColumns=True)
    values = [F.max(F.when((F.col("q") == n) & (F.col("end") == e), F.col("_v"))).alias(f"_{e}_{n}") for n in probs for e in ("lo", "hi")]
    g = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried], *values)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(_round(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))), digits).alias(name))
    return g.select(*keys, *out, *[F.col(f"_s_{n}").alias(n) for n in sums])


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, probs: Mapping[str, float],
              method: str = "exact", accuracy: int = 10000, digits: int | None = DIGITS,
              sums: Mapping[str, Column] | None = None, refine_rows: int = REFINE_ROWS) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys`` group (nulls and NaN ignored).

    Returns ``keys`` + one double column per entry of ``probs`` + the sums over all of the group's
    rows.  Groups without a value are absent, unless sums are asked for; then their quantiles are
    null.  ``df`` is scanned once, and a second time for the rows of the wanted bins alone.
    """
    out_keys, sums = list(keys), sums or {}
    keys = out_keys or ["_g"]
    if method == "approx":
        aggs = [_round(F.percentile_approx("_v", p, accuracy), digits).alias(name) for name, p in probs.items()]
        d = _values(df, out_keys, value).where(F.col("_v").isNotNull())
        return d.groupBy(*out_keys).agg(*aggs) if out_keys else d.agg(*aggs)
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    if not out_keys:
        df = df.withColumn("_g", F.lit(0))
    want = _pin(wanted(fold(df, keys, value, sums), keys, probs, list(sums)))
    opened = want.where("_lo < _hi")
    n, most = opened.agg(F.count(F.lit(1)), F.max("_cnt")).first()
    rows = runs(df, keys, value, opened, keys, n <= BROADCAST_ROWS) if n else None
    if not sums:
        want = want.where("_n > 0")
    out = interpolated(want, pick(want, rows, keys, refine_rows, most), keys, probs, digits, list(sums))
    if not out_keys:
        # One row also for an empty frame, as an aggregate without keys gives.
        out = out.agg(*[F.max(c).alias(c) for c in (*probs, *sums)])
    return out


def _round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def quantile_scalar(df: DataFrame, value: str | Column, p: float, method: str = "exact") -> Column:
    """One quantile of the whole frame as a scalar-subquery Column; not rounded, as it is compared with."""
    return quantiles(df, [], value, {"q": p}, method=method, digits=None).select("q").scalar()
