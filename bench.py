"""Benchmark: headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.

The registered oracle queries use a 6-entity panel; here the same operators
run on inputs that grow with the scale factor: ``panel_wide`` (one monthly
series per supplier) and the row-level regression input (all of lineitem).
Each query is executed to completion through the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from panelstats.operators import breaks as B  # noqa: E402
from panelstats.operators import describe as DS  # noqa: E402
from panelstats.operators import diagnostics as DG  # noqa: E402
from panelstats.operators import models as MD  # noqa: E402
from panelstats.operators import ols as O  # noqa: E402
from panelstats.operators import windows as WN  # noqa: E402
from panelstats.session import get_spark  # noqa: E402
from panelstats.sources import views  # noqa: E402

K = ["entity"]
XS = ["x1", "x2"]


def _queries(spark, sf_dir):
    pw = lambda: views.panel_wide(spark, sf_dir, materialize=True)
    rows = lambda: views.rows(spark, sf_dir)

    def ols_panel():
        return O.ols(pw(), "y", XS, K)

    def ols_rows():
        return O.ols(rows(), "y", XS, K)

    def residual_tests():
        p = pw()
        fit = O.ols(p, "y", XS, K)
        res = DG.resid_series(p, "y", XS, K, "m", fit)
        return DG.breusch_pagan(res, XS, K).join(DG.jarque_bera(res, K), K) \
            .join(DG.durbin_watson(res, fit, XS, K, "m"), K)

    def ljung_box():
        p = pw()
        return DG.ljung_box(DG.resid_series(p, "y", XS, K, "m"), K, 12)

    def newey_west12():
        p = pw()
        fit = O.ols(p, "y", XS, K)
        return MD.robust_se(p, fit, "y", XS, K, "m", "nw", 12, True)

    def lag_model_select():
        from panelstats.plans.q_models import lag_level_models
        return lag_level_models(pw())

    def sup_f():
        return B.sup_f(B.split_path(pw(), "y", XS, K, "m"), K, "m")

    def bai_perron():
        return B.bai_perron(pw(), "y", XS, K, "m")

    def describe_full():
        return DS.describe_full(pw(), ["y", "x1", "x2"], K)

    def describe_rows():
        return DS.describe_basic(rows(), ["y", "x1"], K)

    def shift_model_joint_f():
        from panelstats.plans import literals as LIT
        from panelstats.operators import joins as J
        p = pw()
        f = J.window_flags(p, LIT.WINDOWS)
        labels = [w[0] for w in LIT.WINDOWS]
        return MD.joint_f(O.ols(f, "y", [*XS, *labels], K), O.ols(f, "y", XS, K), K)

    def asof_events():
        from panelstats.plans import literals as LIT
        from panelstats.operators import joins as J
        return J.asof_forward(pw(), LIT.EVENTS, K, "m", ["t", "y"], guard=10)

    def rec_cusum():
        return B.rec_cusum(B.recursive_residuals(pw(), "y", XS, K, "m"), K, "m")

    def fill_rolling():
        p = pw().withColumn("x2", F.when(F.month("t") == 12, F.col("x2")))
        return WN.rolling_mean(WN.fill_linear(p, "x2", K, "m", hold_edges=True), "y", K, "m", 12)

    return {
        "ols_panel": ols_panel, "ols_rows": ols_rows, "residual_tests": residual_tests,
        "ljung_box": ljung_box, "newey_west12": newey_west12, "lag_model_select": lag_model_select,
        "sup_f": sup_f, "bai_perron": bai_perron, "describe_full": describe_full,
        "describe_rows": describe_rows, "fill_rolling": fill_rolling,
        "shift_model_joint_f": shift_model_joint_f, "asof_events": asof_events, "rec_cusum": rec_cusum,
    }


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    # warm-up: JVM, Parquet reader and the Python worker for Arrow UDFs
    _run(O.ols(views.panel(spark, sf_dir), "y", XS, K))
    times = {}
    for name, build in _queries(spark, sf_dir).items():
        t0 = time.perf_counter()
        _run(build())
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
