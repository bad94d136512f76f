"""Exact order statistics per group without sorting or copying the raw rows.

``quantiles`` and ``trimmed_mean`` select: rounds of a mergeable sketch
(``percentile_approx``, rank error at most 1/ACCURACY of a bracket) narrow a bracket
around each wanted rank until few kinds of value are in it, a last aggregate counts
the rows below the bracket and the multiplicity of each distinct value inside it, and
running sums over those few values give the exact order statistic. All passes are
partial aggregates: a hot group or a hot value is reduced in every task, and no raw
row is shuffled or written. Groups of up to FEW rows need no sketch.

``rank_within`` numbers all rows of a group, for operators that need every rank
(equal-count bins, Q-Q pairs, ordered splits). It range-partitions on
``(keys, value, tie)``, so a hot group spreads over many tasks; give a ``tie``
column where values repeat. A row's position is read from
``monotonically_increasing_id`` (its low 33 bits are the row index within the
partition), and a small aggregate of (partition, group) counts gives every
partition its offset inside each group.

Quantiles follow the linear definition (R type 7, DuckDB ``quantile_cont``):
h = (n-1)p, Q = x[floor h] + (h - floor h)(x[floor h + 1] - x[floor h]).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOW33 = (1 << 33) - 1
ROWS_PER_RANGE = 2_000_000
ACCURACY = 2_000  # of the sketch: rank error at most a bracket's rows / ACCURACY
GRID = 100  # marks read from the sketch
FIRST_ACCURACY, FIRST_GRID = 10_000, 1_000  # the same for the first round, which serves all ranks
FEW = 100_000  # rows or kinds of value that the last window may see per rank


def range_partitions(df: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Number of range partitions: counted rows / ``rows_per_range``, at least
    ``spark.sql.shuffle.partitions``. AQE coalesces range partitions but never splits
    them, so the number must follow the input."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(conf, -(-df.count() // rows_per_range))


def rank_within(df: DataFrame, value: str, keys: Sequence[str] = (), tie: Sequence[str] = (),
                carry: Sequence[str] = ()) -> DataFrame:
    """keys, value, carry, ``_rank`` (1-based, ascending by value then ``tie``;
    NULL values dropped), ``_n`` (group size)."""
    keys, tie = list(keys), list(tie)
    extra = [c for c in [*tie, *carry] if c not in keys and c != value]
    d = df.select(*keys, value, *extra).filter(F.col(value).isNotNull())
    s = (d.repartitionByRange(range_partitions(d), *keys, value, *tie).sortWithinPartitions(*keys, value, *tie)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))))
    # The frame is read twice (partition offsets, then the join back). Written
    # once to the shared checkpoint folder, the range shuffle runs once — AQE
    # does not reuse a range exchange between the two branches.
    s = cut_lineage(s, "ranks")
    part = s.groupBy("_pid", *keys).agg(F.min("_idx").alias("_i0"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_pid") if keys else Window.orderBy("_pid")
    wall = Window.partitionBy(*keys) if keys else Window.partitionBy()
    part = part.select(
        "_pid", *keys, "_i0",
        (F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_off"),
        F.sum("_c").over(wall).alias("_n"),
    )
    # null-safe equality: keeps NULL group keys and adds no inferred filters,
    # so both uses of the range-partitioned frame stay identical (one exchange)
    p = part.select(*[F.col(c).alias(f"_p_{c}") for c in ["_pid", *keys]], "_i0", "_off", "_n")
    cond = [s[c].eqNullSafe(p[f"_p_{c}"]) for c in ["_pid", *keys]]
    ranked = s.join(p, on=cond)
    return ranked.select(*[s[c] for c in keys], s[value], *[s[c] for c in extra],
                         (F.col("_off") + F.col("_idx") - F.col("_i0") + 1).alias("_rank"), "_n")


def extent(df: DataFrame, value: str, keys: Sequence[str], count: str = "_n") -> DataFrame:
    """keys, number of non-null values, least and greatest: the first brackets."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias(count), F.min(v).alias("_lo"), F.max(v).alias("_hi"))


def _with_brackets(df: DataFrame, value: str, keys: Sequence[str], b: DataFrame) -> DataFrame:
    d = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        return d.crossJoin(F.broadcast(b))  # one row
    r = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    j = d.join(r, on=[d[k].eqNullSafe(r[f"_k_{k}"]) for k in keys])
    return j.drop(*[f"_k_{k}" for k in keys])


def _inside(i: int) -> Column:
    return (F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}"))


def _first_narrowed(df: DataFrame, value: str, keys: Sequence[str], b: DataFrame, m: int) -> DataFrame:
    """The first round, in which all brackets are the whole group: one sketch serves all
    ranks. Brackets stay open that may still hold more than FEW rows."""
    marks = [g / FIRST_GRID for g in range(FIRST_GRID + 1)]
    grid = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile_approx(value, marks, FIRST_ACCURACY).alias("_grid"))
    if keys:
        grid = grid.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        j = b.join(grid, on=[b[k].eqNullSafe(grid[f"_k_{k}"]) for k in keys])
    else:
        j = b.crossJoin(F.broadcast(grid))  # one row each
    out = []
    for i in range(m):
        share = F.col(f"_rank{i}") / F.col("_n")
        low, high = (F.floor((share - 2 / FIRST_ACCURACY) * FIRST_GRID), F.ceil((share + 2 / FIRST_ACCURACY) * FIRST_GRID))
        lo = F.when(F.col(f"_open{i}") & (low >= 0), F.get("_grid", low.cast("int"))).otherwise(F.col(f"_lo{i}"))
        hi = F.when(F.col(f"_open{i}") & (high <= FIRST_GRID), F.get("_grid", high.cast("int"))).otherwise(F.col(f"_hi{i}"))
        rows = (high - low + 2 * FIRST_GRID / FIRST_ACCURACY) / FIRST_GRID * F.col("_n")
        out += [F.col(f"_rank{i}"), lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}"),
                (F.col(f"_open{i}") & (rows > FEW) & (lo < hi)).alias(f"_open{i}")]
    return j.select(*keys, "_n", *out)


def _narrowed(df: DataFrame, value: str, keys: Sequence[str], b: DataFrame, m: int) -> DataFrame:
    """One round: brackets that hold more than FEW rows and kinds of value close in around
    their rank, between two marks of a sketch of the values inside them."""
    marks = [g / GRID for g in range(GRID + 1)]
    aggs = []
    for i in range(m):
        v = F.when(F.col(f"_open{i}") & _inside(i), F.col("_v"))
        aggs += [F.sum((F.col("_v") < F.col(f"_lo{i}")).cast("long")).alias(f"_below{i}"), F.count(v).alias(f"_in{i}"),
                 F.percentile_approx(v, marks, ACCURACY).alias(f"_grid{i}"), F.approx_count_distinct(v).alias(f"_kinds{i}")]
    own = [c for c in b.columns if c not in keys]
    g = _with_brackets(df, value, keys, b).groupBy(*keys).agg(*[F.first(c).alias(c) for c in own], *aggs)
    out = []
    for i in range(m):
        share = F.try_divide(F.col(f"_rank{i}") - F.col(f"_below{i}"), F.col(f"_in{i}"))
        low, high = F.floor((share - 2 / ACCURACY) * GRID), F.ceil((share + 2 / ACCURACY) * GRID)
        many = F.col(f"_open{i}") & (F.col(f"_in{i}") > FEW) & (F.col(f"_kinds{i}") > FEW)
        grid = F.col(f"_grid{i}")
        lo = F.when(many & (low >= 0), F.get(grid, low.cast("int"))).otherwise(F.col(f"_lo{i}"))
        hi = F.when(many & (high <= GRID), F.get(grid, high.cast("int"))).otherwise(F.col(f"_hi{i}"))
        moved = (lo > F.col(f"_lo{i}")) | (hi < F.col(f"_hi{i}"))
        out += [F.col(f"_rank{i}"), lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}"), (many & moved & (lo < hi)).alias(f"_open{i}")]
    return g.select(*keys, *[c for c in own if c.startswith("_n")], *out)


def order_statistics(df: DataFrame, value: str, keys: Sequence[str], ranks: Sequence[Column], count: str = "_n",
                     first: DataFrame | None = None) -> DataFrame:
    """keys, ``_n`` and ``_x`` (array): the values at 1-based ``ranks``, which are
    expressions in the group's number of non-null values, the column ``count``.

    Each rank has a bracket, at first the whole group (``first``: :func:`extent`, if the
    caller has it). Groups of more than FEW rows get one sketch, which leaves some
    thousandths of their rows in each bracket. While a bracket holds more than FEW rows
    of more than FEW kinds, a round narrows it to two hundredths of its rows; then the
    rows below are counted, and the values inside by kind. So the last window sees at
    most some FEW kinds of value per rank, however large a group is."""
    keys, m = list(keys), len(ranks)
    b = extent(df, value, keys, count) if first is None else first
    b = cut_lineage(b.select(*keys, F.col(count).alias("_n"), *[c for i, r in enumerate(ranks) for c in (
        r.cast("long").alias(f"_rank{i}"), F.col("_lo").alias(f"_lo{i}"), F.col("_hi").alias(f"_hi{i}"),
        (F.col(count) > FEW).alias(f"_open{i}"))]), "brackets")
    still = F.max(F.greatest(*[F.col(f"_open{i}").cast("int") for i in range(m)], F.lit(0)))
    if b.agg(still).first()[0]:
        b = cut_lineage(_first_narrowed(df, value, keys, b, m), "brackets")
    while b.agg(still).first()[0]:
        b = cut_lineage(_narrowed(df, value, keys, b, m), "brackets")
    j = _with_brackets(df, value, keys, b)
    inside = reduce(lambda x, y: x | y, [_inside(i) for i in range(m)])
    own = [c for c in b.columns if c not in keys and not c.startswith("_open")]
    below = [F.sum((F.col("_v") < F.col(f"_lo{i}")).cast("long")).alias(f"_s{i}") for i in range(m)]
    per = j.withColumn("_k", F.when(inside, F.col("_v"))).groupBy(*keys, "_k") \
        .agg(*[F.first(c).alias(c) for c in own], F.count(F.lit(1)).alias("_c"), *below)
    # values inside any bracket, in order; before the bracket of rank i lie _s{i} rows
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = w.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = []
    for i in range(m):
        in_i = F.col("_k").isNotNull() & (F.col("_k") >= F.col(f"_lo{i}")) & (F.col("_k") <= F.col(f"_hi{i}"))
        seen = F.sum(f"_s{i}").over(w) + F.sum(F.when(in_i, F.col("_c")).otherwise(F.lit(0))).over(run)
        out.append(F.when(in_i & (seen >= F.col(f"_rank{i}")), F.col("_k")).alias(f"_x{i}"))
    at = per.select(*keys, F.col("_n").alias(count), *out)
    return at.groupBy(*keys).agg(F.first(count).alias(count), F.array(*[F.min(f"_x{i}") for i in range(m)]).alias("_x"))


def type7_ranks(probs: Sequence[float], count: str = "_n") -> list[Column]:
    """Two ranks per probability between which its quantile lies."""
    h = [(F.col(count) - 1) * float(p) for p in probs]
    return [r for x in h for r in (F.floor(x) + 1, F.least(F.floor(x) + 2, F.col(count)))]


def type7(prob: float, at: int, count: str = "_n") -> Column:
    """The quantile from ``_x[at]`` and ``_x[at + 1]``."""
    h = (F.col(count) - 1) * float(prob)
    lo, up = F.col("_x")[at], F.col("_x")[at + 1]
    return lo + (h - F.floor(h)) * (up - lo)


def quantiles(df: DataFrame, value: str, keys: Sequence[str], probs: Sequence[float],
              names: Sequence[str] | None = None, first: DataFrame | None = None) -> DataFrame:
    """One row per group with one column per probability (exact, type 7)."""
    keys = list(keys)
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    x = order_statistics(df, value, keys, type7_ranks(probs), first=first)
    return x.select(*keys, *[type7(p, 2 * i).alias(nm) for i, (p, nm) in enumerate(zip(probs, names, strict=True))])


def trim_ranks(trim: float, count: str = "_n") -> list[Column]:
    """Ranks of the least and the greatest value that a trimmed mean keeps."""
    lo = F.floor(F.col(count) * trim) + 1
    return [lo, F.col(count) + 1 - lo]


def trimmed_mean(df: DataFrame, value: str, keys: Sequence[str], trim: float = 0.1) -> DataFrame:
    """Mean after dropping floor(n*trim) smallest and largest values (R ``mean(trim=)``):
    the sum strictly between the two outermost kept values, and their own multiplicity."""
    keys = list(keys)
    x = order_statistics(df, value, keys, trim_ranks(trim))
    return mean_between(df, value, keys, x.select(*keys, *[r.alias(n) for r, n in zip(trim_ranks(trim), ("_r", "_q"))],
                                                  F.col("_x")[0].alias("_a"), F.col("_x")[1].alias("_z")))


def mean_between(df: DataFrame, value: str, keys: Sequence[str], ends: DataFrame) -> DataFrame:
    """Mean of the values of ranks ``_r`` to ``_q``, which are ``_a`` and ``_z``."""
    keys = list(keys)
    j = _with_brackets(df, value, keys, ends)
    v, a, z = F.col("_v"), F.col("_a"), F.col("_z")
    g = j.groupBy(*keys).agg(
        F.first("_r").alias("_r"), F.first("_q").alias("_q"), F.first("_a").alias("_a"), F.first("_z").alias("_z"),
        F.sum(F.when((v > a) & (v < z), v).otherwise(F.lit(0.0))).alias("_mid"),
        F.sum((v <= a).cast("long")).alias("_upto"), F.sum((v < z).cast("long")).alias("_under"))
    kept = F.col("_q") - F.col("_r") + 1
    total = F.col("_mid") + F.col("_a") * (F.col("_upto") - F.col("_r") + 1) + F.col("_z") * (F.col("_q") - F.col("_under"))
    return g.select(*keys, F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(F.try_divide(total, kept)).alias("trimmed_mean"))
