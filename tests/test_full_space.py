from visitgrain.forecast import arima
from visitgrain.registry import QUERIES


def test_fits_and_forecasts_search_every_order(spark, sf_dir):
    fits = QUERIES["FC-4"](spark, sf_dir)
    orders = {(r.p, r.d, r.q) for r in fits.select("p", "d", "q").distinct().collect()}
    assert orders == set(arima.candidates())
    best = {(r.series_key, r.p, r.d, r.q) for r in QUERIES["FC-5"](spark, sf_dir).collect()}
    ahead = QUERIES["FC-6"](spark, sf_dir)
    assert {tuple(r) for r in ahead.select("series_key", "p", "d", "q").distinct().collect()} == best
    assert ahead.count() == 20 * len(best)
