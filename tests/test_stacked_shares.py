"""Shares need the inner fits only, and are those of the whole stack."""

from surveyloom.operators import nuisance as N
from surveyloom.plans import saturated as P
from surveyloom.plans.tables import cohort


def test_shares_fit_no_whole_models_and_equal_the_stack(spark, sf_dir, monkeypatch):
    asked, plain = [], N.LogitLearner.fit
    monkeypatch.setattr(N.LogitLearner, "fit", lambda self, cells, weights: asked.append(list(weights)) or plain(self, cells, weights))
    rows = lambda df: {(r["model"], r["fold"]): r for r in df.collect()}
    shares = rows(P.i18_saturated(spark, sf_dir))
    assert len(asked) == 4 and not any(w.startswith("_all") for names in asked for w in names)
    whole = rows(P.stacked_plainly(cohort(spark, sf_dir))[1])
    assert shares.keys() == whole.keys() and len(shares) == 10
    for k, r in shares.items():
        assert r["share"] == whole[k]["share"] and abs(r["log_loss"] - whole[k]["log_loss"]) < 1e-9
