"""Linear regression for many groups at once (RG1–RG6, RG13, RG19–RG21).

Plan shape: one hash aggregate of centred moments per group (partial
aggregation on the map side, so a hot group is reduced before the shuffle),
then a batched k×k solve in an Arrow UDF on the already aggregated rows.
Spark's ``var_pop``/``covar_pop`` merge centred moments (numerically stable)
so the inputs never have to be centred in a second pass.

Rows with a NULL in any model column are left out (listwise), but the group
itself is kept: a group with no complete row yields NULL estimates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import f_pvalue_udf, t_pvalue_udf
from ..functions.linalg import solve_udf
from ..session import cut_lineage

INTERCEPT = "(Intercept)"


def complete(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True))


def terms(xs: Sequence[str]) -> list[str]:
    return [INTERCEPT, *xs]


def sufficient_stats(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, sxx (k*k), sxy (k), syy, mx (k), my — one aggregate."""
    xs = list(xs)
    ok = complete([y, *xs])
    v = {c: F.when(ok, F.col(c)) for c in [y, *xs]}
    k = len(xs)
    aggs = [F.count(F.when(ok, F.lit(1))).alias("n"), F.avg(v[y]).alias("my"),
            F.var_pop(v[y]).alias("_vyy")]
    aggs += [F.avg(v[x]).alias(f"_m{i}") for i, x in enumerate(xs)]
    aggs += [F.covar_pop(v[x], v[y]).alias(f"_cy{i}") for i, x in enumerate(xs)]
    for i in range(k):
        for j in range(i, k):
            a = F.var_pop(v[xs[i]]) if i == j else F.covar_pop(v[xs[i]], v[xs[j]])
            aggs.append(a.alias(f"_c{i}_{j}"))
    g = df.groupBy(*keys).agg(*aggs)
    n = F.col("n")
    sxx = [F.col(f"_c{min(i, j)}_{max(i, j)}") * n for i in range(k) for j in range(k)]
    return g.select(
        *keys, "n",
        F.array(*sxx).alias("sxx") if k else F.array().cast("array<double>").alias("sxx"),
        (F.array(*[F.col(f"_cy{i}") * n for i in range(k)]) if k
         else F.array().cast("array<double>")).alias("sxy"),
        (F.col("_vyy") * n).alias("syy"),
        (F.array(*[F.col(f"_m{i}") for i in range(k)]) if k
         else F.array().cast("array<double>")).alias("mx"),
        "my",
    )


def fit_from_stats(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    solved = solve_udf("n", "sxx", "sxy", "syy", "mx", "my").alias("fit")
    return stats.select(*keys, "n", "mx", "my", solved).select(*keys, "n", "mx", "my", "fit.*")


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (),
        materialize: bool = False) -> DataFrame:
    """RG1: one row per group with ``beta``/``se`` arrays in ``terms(xs)`` order.

    ``materialize``: write the (one row per group) fit once to the shared
    checkpoint folder. Use it when the fit feeds several branches over a raw
    table (residuals, then a second aggregate): AQE does not reuse the
    aggregate's exchange there, and each branch would re-scan the raw rows.
    """
    fit = fit_from_stats(sufficient_stats(df, y, xs, keys), keys)
    return cut_lineage(fit, "fit") if materialize else fit


def coef_table(fit: DataFrame, xs: Sequence[str], keys: Sequence[str] = (),
               with_p: bool = True) -> DataFrame:
    """RG4: keys, term, estimate, se, t_stat, p_value (long form)."""
    names = F.array(*[F.lit(t) for t in terms(xs)])
    ex = fit.select(*keys, "df_resid",
                    F.posexplode(F.arrays_zip("beta", "se")).alias("pos", "z"))
    out = ex.select(
        *keys, F.element_at(names, F.col("pos") + 1).alias("term"), "df_resid",
        F.col("z.beta").alias("estimate"), F.col("z.se").alias("se"),
    ).withColumn("t_stat", F.try_divide(F.col("estimate"), F.col("se")))
    if with_p:
        out = out.withColumn("p_value", t_pvalue_udf("t_stat", F.col("df_resid").cast("double")))
    return out


def fit_table(fit: DataFrame, keys: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """RG5: R², adjusted R², F with its p-value, residual df, sigma, RSS."""
    out = fit.select(*keys, "n", "k", "df_resid", "rss", "r2", "adj_r2", "sigma", "f_stat",
                     (F.col("k") - 1).alias("df_model"))
    if with_p:
        out = out.withColumn("p_f", f_pvalue_udf("f_stat", F.col("df_model").cast("double"),
                                                   F.col("df_resid").cast("double")))
    return out


def join_groups(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach per-group results (one row per group) to row-level data.

    No hint: AQE measures the aggregated side at run time and turns the join
    into a broadcast hash join when it is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; with many groups it
    stays a shuffle join and AQE's skew-join split handles a hot key.
    """
    if keys:
        return big.join(small, on=list(keys), how=how)
    # Global model: ``small`` is one row (global aggregate); a constant key keeps an equi-join.
    one = F.lit(1).alias("_all")
    return big.select("*", one).join(F.broadcast(small.select("*", one)), on="_all", how=how).drop("_all")


def fitted_expr(xs: Sequence[str], beta: str = "beta") -> Column:
    b = F.col(beta)
    return reduce(lambda acc, ix: acc + F.coalesce(b[ix[0] + 1], F.lit(0.0)) * F.col(ix[1]),
                  enumerate(xs), b[0])


def residuals(df: DataFrame, fit: DataFrame, y: str, xs: Sequence[str],
              keys: Sequence[str] = (), keep_beta: bool = False) -> DataFrame:
    """RG3: row-level fitted values and residuals (complete rows only)."""
    small = fit.select(*keys, "beta")
    j = join_groups(df.filter(complete([y, *xs])), small, keys)
    j = j.withColumn("fitted", fitted_expr(xs)).withColumn("resid", F.col(y) - F.col("fitted"))
    return j if keep_beta else j.drop("beta")
