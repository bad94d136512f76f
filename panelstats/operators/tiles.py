"""All pairs of positions within a series, in tiles.

Kernel sums and segment costs need pairs of positions of one series. A series is cut
into buckets of ``BUCKET`` positions; a bucket is one row with its vectors laid end to
end, and a tile is the join of two buckets of the same series. A task holds some tiles,
never a series; how many tiles a series has follows from how far apart pairs may be.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 32
TILES_AT_ONCE = 64  # tiles that numpy works on together


def bucket_of(pos: Column | str) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / BUCKET).cast("int")


def buckets(rows: DataFrame, keys: Sequence[str], vec: str, carry: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """keys, ``by``, ``bucket``, ``places`` (positions, rising), ``flat`` (their vectors end
    to end) and the greatest of each column ``carry``. ``pos`` is unique within the keys."""
    listed = F.array_sort(F.collect_list(F.struct("pos", vec)))
    g = rows.groupBy(*keys, *by, bucket_of("pos").alias("bucket")).agg(listed.alias("_l"), *[F.max(c).alias(c) for c in carry])
    return g.select(*keys, *by, "bucket", *carry, F.transform("_l", lambda r: r["pos"]).alias("places"),
                    F.flatten(F.transform("_l", lambda r: r[vec])).alias("flat"))


def tiles(b: DataFrame, keys: Sequence[str], last: Column, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of buckets: ``a`` at or before ``b``, up to the bucket number ``last``. Columns
    keys, then ``places``, ``flat``, ``bucket`` and ``by`` once with prefix ``a_`` and once
    with ``b_``, and the other columns of the first bucket."""
    own = ["bucket", "places", "flat", *by]
    rest = [c for c in b.columns if c not in own and c not in keys]
    a = b.select(*keys, *rest, *[F.col(c).alias(f"a_{c}") for c in own],
                 F.explode(F.sequence(F.col("bucket"), F.greatest(F.col("bucket"), last.cast("int")))).alias("b_bucket"))
    return a.join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in own]), on=[*keys, "b_bucket"])


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Tiles are small before their work and large after it: deal them to all tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def pieces(n: int) -> list[tuple[int, int]]:
    """Offset and length of groups of tiles."""
    return [(i, min(TILES_AT_ONCE, n - i)) for i in range(0, n, TILES_AT_ONCE)]


def dense(lists: pa.ListArray, width: int, fill: float) -> np.ndarray:
    """(lists, BUCKET, width); lists of a bucket that is not full are filled up."""
    size = BUCKET * width
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    have = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (have == size).all():
        return flat.reshape(len(lists), BUCKET, width)
    out = np.full((len(lists), size), fill)
    out[np.arange(size)[None, :] < have[:, None]] = flat
    return out.reshape(len(lists), BUCKET, width)


def as_lists(rows: np.ndarray) -> pa.ListArray:
    """One list per row of a matrix."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
