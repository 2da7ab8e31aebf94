"""Pooled gaps: fits pass over covariate combinations, and clusters leave their task only as sums of strata."""

from surveyloom.operators import impute as I
from surveyloom.operators import refits
from surveyloom.plans import saturated as P


def test_fits_do_not_pass_over_clusters(spark, sf_dir, duck, monkeypatch):
    from tests.compare import differences
    monkeypatch.setattr(refits, "ROWS", 7)  # clusters go on in the next part, strata are handed on early
    fitted, plain = [], I.fit_many
    monkeypatch.setattr(I, "fit_many", lambda cells, *a, **k: fitted.append((cells.count(), cells.columns)) or plain(cells, *a, **k))
    strata, influence = [], I.gap_influence_strata
    monkeypatch.setattr(I, "gap_influence_strata", lambda *a: strata.append(influence(*a)) or strata[-1])
    assert not differences(P.j4_saturated(spark, sf_dir), duck, P.imputed_sql())
    # waves, arms, outcomes and levels (a missing one in the first weight)
    assert all(n <= 2 * 2 * 2 * 3 and "psu" not in columns for n, columns in fitted) and len(fitted) == 2
    assert all("psu" not in totals.columns for _, totals in strata)
