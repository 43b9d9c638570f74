"""The audit of a run's document makes every check."""

from wattloom import constants as K
from wattloom.operators import audit
from wattloom.plans import model_queries, roles


def test_the_documents_audit_refits_and_sees_both_scales(spark, sf, monkeypatch):
    homes = roles.model_households(spark, sf)
    encoder, df = roles.encoded(homes)
    seen = []
    whole = audit.greedy_linear_r2
    monkeypatch.setattr(audit, "greedy_linear_r2", lambda train, columns, target, **kw: seen.append(target) or whole(train, columns, target, **kw))
    checks = {r["check"]: r for r in model_queries.document_audit(homes, encoder, df, {}).collect()}
    assert set(checks) == set("ABCDEFGH") and seen == ["y_log", K.TOTAL_COL]
    assert checks["D"].passed and checks["D"].detail == "medians_off=0;extra_levels=0"
    encoder.medians[encoder.numeric[0]] += 1.0
    checks = {r["check"]: r for r in model_queries.document_audit(homes, encoder, df, {}).collect()}
    assert not checks["D"].passed and checks["D"].detail.startswith("medians_off=1")
