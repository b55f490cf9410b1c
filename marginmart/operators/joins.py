"""Join helper for a frame joined with an aggregate of itself.

Joining ``df`` with ``df.groupBy(k).agg(..)`` by column name can resolve both sides of the
condition to the same attribute (the self-join trap), which silently turns the join into
a cross join.  ``join_on`` renames the right side's keys first and joins on explicit
equality, so the condition always compares the two sides.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ids = itertools.count()


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
            broadcast: bool = False) -> DataFrame:
    tag = next(_ids)
    renamed = {k: f"_jk{tag}_{i}" for i, k in enumerate(keys)}
    r = right.select(*[F.col(k).alias(v) for k, v in renamed.items()],
                     *[c for c in right.columns if c not in renamed])
    if broadcast:
        r = F.broadcast(r)
    cond = None
    for k, v in renamed.items():
        c = left[k].eqNullSafe(r[v]) if how != "full" else left[k] == r[v]
        cond = c if cond is None else cond & c
    if how in ("left_semi", "left_anti"):
        return left.join(r, cond, how)
    if how == "full":
        out = left.join(r, cond, "full")
        return out.select(*[F.coalesce(left[k], r[v]).alias(k) for k, v in renamed.items()],
                          *[c for c in left.columns if c not in renamed],
                          *[c for c in right.columns if c not in renamed])
    return left.join(r, cond, how).drop(*renamed.values())
