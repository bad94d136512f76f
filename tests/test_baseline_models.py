
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.operators import models as MD
from panelstats.operators import ols as O
from panelstats.operators import windows as WN

K = ["entity"]
XS = ["x1", "x2"]


def close(a, b, tol=1e-6):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=0, atol=tol)


@pytest.fixture(scope="module")
def static_fit(ref_series):
    return O.ols(ref_series, "y", XS, K).cache()


def test_static_ols(static_fit):
    r = static_fit.collect()[0]
    close(r.beta, [1.78114251, 0.07116172, 0.49583813])
    close(r.se, [0.07446477, 0.03913244, 0.04077862])
    close([r.r2, r.adj_r2, r.f_stat, r.sigma, r.rss],
          [0.41869857, 0.41445549, 98.67806942, 1.14094957, 356.68386399], 1e-5)


def test_hc1(ref_series, static_fit):
    r = MD.robust_se(ref_series, static_fit, "y", XS, K, "m", "hc1").collect()[0]
    close(r.se, [0.07993066, 0.04861503, 0.03546719])


def test_newey_west_variants(ref_series, static_fit):
    nw6 = MD.robust_se(ref_series, static_fit, "y", XS, K, "m", "nw", 6, adjust=False).collect()[0]
    close(nw6.se, [0.20512883, 0.11695772, 0.08728092])
    nw12 = MD.robust_se(ref_series, static_fit, "y", XS, K, "m", "nw", 12, adjust=True).collect()[0]
    close(nw12.se, [0.27055111, 0.13738388, 0.11020243])
    bart = MD.robust_se(ref_series, static_fit, "y", XS, K, "m", "bartlett", 12, adjust=True).collect()[0]
    close(bart.se, [0.26172702, 0.13573569, 0.10722170])
    pw = MD.robust_se(ref_series, static_fit, "y", XS, K, "m", "nw_prewhite", 12, adjust=True).collect()[0]
    close(pw.se, [3.01986134, 0.35457731, 0.54503563], 1e-5)


def test_lag_level_model(ref_series):
    d = WN.lags(ref_series, "y", K, "m", [1])
    fit = O.ols(d, "y", [*XS, "y_l1"], K)
    r = fit.collect()[0]
    assert r.n == 276
    close(r.beta, [0.02112532, 0.03460383, 0.00016756, 0.98187398])
    nw = MD.robust_se(d, fit, "y", [*XS, "y_l1"], K, "m", "nw", 6, adjust=False).collect()[0]
    close(nw.se, [0.01682800, 0.01039028, 0.00673341, 0.01018459])


def test_aic_bic_lag_models(ref_series):
    from panelstats.plans.q_models import lag_level_models
    ic = lag_level_models(ref_series).orderBy("model").collect()
    close([r.aic for r in ic], [-309.491323, -64.776808, 103.170604, 234.407088], 1e-5)
    close([r.bic for r in ic], [-291.389319, -46.692953, 121.236246, 252.454447], 1e-5)


def test_diff_models(ref_series):
    from panelstats.plans.q_models import lag_diff_models
    ic = lag_diff_models(ref_series).orderBy("model").collect()
    close([r.n for r in ic], [275, 274, 273, 272])
    close([r.bic for r in ic], [-297.646489, -313.173953, -330.967842, -323.903331], 1e-5)
    # BASELINE lists AIC(4 lags) = -352.749707, but its own BIC(4 lags) = -323.903331
    # implies AIC = BIC - (log(272) - 2) * 8 = -352.749747; the recorded BIC is checked
    # above, and AIC is checked through that identity for every model.
    for r in ic:
        close(r.bic - r.aic, (np.log(r.n) - 2) * (r.k + 1), 1e-9)
    close([r.aic for r in ic[:3]], [-315.730344, -334.852721, -356.234144], 1e-5)
    assert ic[0].best_aic == "diff3" and ic[0].best_bic == "diff3"


def test_diff2_model_prewhitened(ref_series):
    from panelstats.plans.q_models import diff_frame
    d, xs = diff_frame(ref_series, 2)
    fit = O.ols(d, "d_y", xs, K)
    r = fit.collect()[0]
    close(r.beta, [-0.00815955, 0.01991328, -0.00685153, 0.16050037, 0.28478042])
    pw = MD.robust_se(d, fit, "d_y", xs, K, "m", "nw_prewhite", 12, adjust=True).collect()[0]
    close(pw.se, [0.01170997, 0.00755435, 0.00574306, 0.12707309, 0.08686981], 1e-6)


def test_vif(ref_series):
    r = MD.vif(ref_series, "y", XS, K).collect()
    close([x.vif for x in r], [1.1736, 1.1736], 1e-4)
