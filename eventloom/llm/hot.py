"""Give rows what their groups have, where one group may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot if it holds more than one in so many rows, so there are fewer hot groups than this.
HOT_SHARE = 1024
#: Hot groups are broadcast if their rows take no more bytes.
BROADCAST_BYTES = 64 << 20


def attached(rows: DataFrame, groups: DataFrame, keys: Sequence[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``groups`` (``keys`` that aren't null, n and more), which has a row a key.

    ``n`` says how many of the ``total`` rows have the key.  Hot groups meet their
    rows by a broadcast, which moves none of them; there are fewer than
    ``HOT_SHARE``, and their bytes are summed first.  All others are joined by a
    shuffle, in which no key has more than one in ``HOT_SHARE`` rows.  Both frames
    are read twice and should be stored.
    """
    keys = list(keys)
    is_hot = F.col("n") * HOT_SHARE > F.lit(total)
    hot = groups.filter(is_hot)
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("binary") if kind == "binary" else F.col(c).cast("string")), F.lit(0)) for c, kind in groups.dtypes), F.lit(0))
    if (hot.agg(F.sum(size)).first()[0] or 0) > BROADCAST_BYTES:
        return rows.join(groups.drop("n"), keys, how)
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(groups.filter(~is_hot).drop("n"), keys, how)
    return rows.join(F.broadcast(hot.drop("n")), keys).unionByName(cold)
