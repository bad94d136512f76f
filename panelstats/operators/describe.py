"""Descriptive statistics (AG1–AG13, RS2, RS3).

Moments come from one hash aggregate (partial + final). Order statistics use
the exact selection of :mod:`.quantile`. Wide inputs are unpivoted to
``(keys, variable, value)`` first, so one plan serves any number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import quantile as Q
from .quantile import quantiles, rank_within

MAD_SCALE = 1.4826  # fixed value: consistency constant of the median absolute deviation


def long_values(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
                variable: str = "variable", value: str = "value") -> DataFrame:
    """RS1: wide → long, NULLs kept (``DataFrame.unpivot``)."""
    return df.unpivot(list(keys), list(cols), variable, value)


def moments(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return long.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"),
    )


def describe_basic(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """AG1: n, mean, sd, min, Q1, median, Q3, max per (keys, variable)."""
    gk = [*keys, "variable"]
    long = long_values(df, cols, keys)
    m = cut_lineage(moments(long, gk).drop("g1", "g2"), "moments")
    q = Q.quantiles(long, "value", gk, [0.25, 0.5, 0.75], ["q1", "median", "q3"], first=_extent(m))
    return m.join(q, on=gk, how="left").select(*gk, "n", "mean", "sd", "min", "q1", "median", "q3", "max")


def _extent(m: DataFrame) -> DataFrame:
    """First brackets of order statistics from the table of moments."""
    return m.where("n > 0").withColumnsRenamed({"n": "_n", "min": "_lo", "max": "_hi"})


def describe_full(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
                  trim: float = 0.1) -> DataFrame:
    """AG2: adds trimmed mean, MAD·1.4826, range, skew and kurtosis (type 3), se."""
    gk = [*keys, "variable"]
    long = long_values(df, cols, keys)
    m = cut_lineage(moments(long, gk), "moments")
    x = Q.order_statistics(long, "value", gk, [*Q.type7_ranks([0.5]), *Q.trim_ranks(trim)], first=_extent(m))
    low, high = Q.trim_ranks(trim)
    x = cut_lineage(x.select(*gk, "_n", Q.type7(0.5, 0).alias("median"), low.alias("_r"), high.alias("_q"),
                             F.col("_x")[2].alias("_a"), F.col("_x")[3].alias("_z")), "centres")
    med = x.select(*gk, "median")
    tm = Q.mean_between(long, "value", gk, x.select(*gk, "_r", "_q", "_a", "_z"))
    dev = long.join(med, on=gk).select(*gk, F.abs(F.col("value") - F.col("median")).alias("absdev"))
    widest = m.join(med, on=gk).select(*gk, F.col("n").alias("_n"), F.lit(0.0).alias("_lo"),
                                       F.greatest(F.abs(F.col("max") - F.col("median")), F.abs(F.col("min") - F.col("median"))).alias("_hi"))
    mad = Q.quantiles(dev, "absdev", gk, [0.5], ["mad_raw"], first=widest)
    n = F.col("n")
    out = (m.join(med, gk, "left").join(tm, gk, "left").join(mad, gk, "left")
           .select(*gk, "n", "mean", "sd", "median", "trimmed_mean",
                   (F.col("mad_raw") * MAD_SCALE).alias("mad"), "min", "max",
                   (F.col("max") - F.col("min")).alias("range"),
                   (F.col("g1") * F.pow((n - 1) / n, 1.5)).alias("skew"),
                   ((F.col("g2") + 3) * F.pow(1 - 1 / n, 2) - 3).alias("kurtosis"),
                   (F.col("sd") / F.sqrt(n)).alias("se")))
    return out


def describe_by_group(df: DataFrame, cols: Sequence[str], group: Column, group_name: str,
                      keys: Sequence[str] = ()) -> DataFrame:
    """AG3: mean and sd per (keys, group, variable); a NULL group is kept."""
    long = long_values(df.withColumn(group_name, group), cols, [*keys, group_name])
    return long.groupBy(*keys, group_name, "variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def null_profile(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """AG4: NULL and valid count per column (one aggregate, then unpivot)."""
    aggs = []
    for c in cols:
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__null"), F.count(c).alias(f"{c}__valid")]
    g = df.groupBy(*keys).agg(*aggs)
    st = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}__null").alias("n_null"),
                 F.col(f"{c}__valid").alias("n_valid")) for c in cols])).alias("s")
    return g.select(*keys, st).select(*keys, "s.*")


def corr_long(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
              listwise: bool = True) -> DataFrame:
    """AG5/AG6 + RS3: correlation matrix as (keys, var_a, var_b, r) triples.

    ``listwise`` drops rows with a NULL in any of ``cols`` first; otherwise each
    pair uses its own complete rows (``corr`` skips NULL pairs natively).
    """
    cols = list(cols)
    d = df.dropna(subset=cols) if listwise else df
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    g = d.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    cells = []
    for a in cols:
        for b in cols:
            if a == b:
                r = F.lit(1.0)
            else:
                x, y = (a, b) if cols.index(a) < cols.index(b) else (b, a)
                r = F.col(f"{x}__{y}")
            cells.append(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), r.alias("r")))
    return g.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def boxplot_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """AG7: quartiles, 1.5·IQR whiskers and outlier count per group."""
    d = df.filter(F.col(value).isNotNull())
    q = quantiles(d, value, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    j = d.join(q, on=list(keys))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col(value)
    inside = (v >= lo) & (v <= hi)
    return j.groupBy(*keys).agg(
        F.count(v).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count(F.when(~inside, v)).alias("n_out"),
    )


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 30) -> DataFrame:
    """AG8: equal-width bins on [min, max] per group, last bin closed."""
    d = df.filter(F.col(value).isNotNull())
    if not keys:  # one global group: a constant key keeps this an equi-join
        return histogram(d.withColumn("_all", F.lit(1)), value, ["_all"], bins).drop("_all")
    w = Window.partitionBy(*keys)
    # distinct values and their counts (a partial aggregate), then the range over them:
    # the source is scanned once
    c = d.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    c = c.withColumn("lo", F.min("_v").over(w)).withColumn("hi", F.max("_v").over(w))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col("_v") - F.col("lo")) / width), F.lit(bins - 1))
    b = F.when(width > 0, b).otherwise(F.lit(0)).cast("int")
    return c.select(*keys, b.alias("bin"), "lo", "hi", "_c").groupBy(*keys, "bin").agg(
        F.sum("_c").alias("count"),
        (F.first("lo") + F.col("bin") * (F.first("hi") - F.first("lo")) / bins).alias("bin_lo"),
    )


def density_grid(df: DataFrame, value: str, keys: Sequence[str], points: int = 512,
                 cut: float = 3.0, prebin: int | None = None) -> DataFrame:
    """AG9: Gaussian kernel density on an even grid over [min-3bw, max+3bw].

    Bandwidth: 0.9·min(sd, IQR/1.34)·n^-0.2. Rows are first collapsed to
    (value, multiplicity), then each distinct value adds its kernel to every
    grid point; the (group, grid) sums are partial-aggregated.

    ``prebin``: for very large groups, snap values to the centres of
    ``prebin`` equal-width bins on [min, max] first (a partial aggregate), so
    the kernel work per group is bounded by prebin × points instead of the
    number of distinct values (error ≤ half a bin width, ≪ bw). Default: exact.
    """
    keys = list(keys)
    d = df.filter(F.col(value).isNotNull())
    q = quantiles(d, value, keys, [0.25, 0.75], ["_q1", "_q3"])
    m = d.groupBy(*keys).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"),
                             F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    par = m.join(q, keys).select(
        *keys, "_n", "_lo", "_hi",
        (0.9 * F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
         * F.pow(F.col("_n").cast("double"), -0.2)).alias("bw"))
    par = par.select(*keys, "_n", "bw", (F.col("_lo") - cut * F.col("bw")).alias("g0"),
                     ((F.col("_hi") - F.col("_lo") + 2 * cut * F.col("bw")) / (points - 1)).alias("step"))
    if prebin:
        rng = m.select(*keys, "_lo", "_hi")
        wbin = (F.col("_hi") - F.col("_lo")) / prebin
        idx = F.least(F.floor((F.col(value) - F.col("_lo")) / wbin), F.lit(prebin - 1))
        centre = F.when(wbin > 0, F.col("_lo") + (idx + 0.5) * wbin).otherwise(F.col(value))
        d = d.join(rng, keys).select(*keys, centre.alias(value))
    vals = d.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    j = vals.join(par, keys).select(*keys, "_v", "_c", "_n", "bw", "g0", "step",
                                    F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("g0") + F.col("i") * F.col("step")
    z = F.try_divide(x - F.col("_v"), F.col("bw"))
    contrib = F.col("_c") * F.exp(-0.5 * z * z)
    return j.groupBy(*keys, "i").agg(
        F.first(x).alias("x"),
        F.try_divide(F.sum(contrib), F.first("_n") * F.first("bw") * F.lit(2.5066282746310002)).alias("density"))


def time_span(df: DataFrame, time_col: str, keys: Sequence[str]) -> DataFrame:
    """AG10: first and last time, row count per group."""
    return df.groupBy(*keys).agg(F.min(time_col).alias("t_first"), F.max(time_col).alias("t_last"),
                                 F.count(F.lit(1)).alias("n"))


def ntile_from_rank(rank: Column, n: Column, k: int) -> Column:
    """SQL ``ntile(k)`` computed from a 1-based rank and group size."""
    base = F.floor(n / k)
    extra = n % k
    big = extra * (base + 1)
    return F.when(rank <= big, F.floor((rank - 1) / (base + 1)) + 1) \
        .otherwise(extra + F.floor((rank - big - 1) / base) + 1).cast("int")


def binned_trend(df: DataFrame, x: str, y: str, keys: Sequence[str], tie: str, bins: int = 20) -> DataFrame:
    """AG12: equal-count bins of x (SQL ``ntile``; ties broken by ``tie``), mean x and y per bin.

    Ranks come from the skew-safe range-partitioned ranking, not from a window
    over the whole group.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = rank_within(d, x, keys, tie=[tie], carry=[y])
    r = r.withColumn("bin", ntile_from_rank(F.col("_rank"), F.col("_n"), bins))
    return r.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"),
                                       F.avg(y).alias("mean_y"))
