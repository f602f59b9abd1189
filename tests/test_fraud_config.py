import pytest

from tidemark.operators import rules


def test_settings_change_what_they_name_and_nothing_else():
    fixed = rules.fraud_config()
    assert fixed.rules == rules.FRAUD_RULES and fixed.parameters == rules.FRAUD_PARAMETERS and (fixed.per_tier, fixed.most) == (2, 3)
    got = rules.fraud_config({"rules": [{"id": "FRAUD-VEL-001", "name": "x", "tags": ["y"], "severity": "critical", "parameters": {"max_count": 9}}, {"id": "TMP-002", "enabled": False}], "severity_escalation": {"enabled": False}})
    assert got.rules == {k: (3, 0.8, "velocity") if k == "VEL-001" else v for k, v in rules.FRAUD_RULES.items() if k != "TMP-002"}
    assert got.parameters["VEL-001"] == {"max_count": 9, "window_minutes": 10} and got.per_tier == 0
    assert rules.FRAUD_PARAMETERS["VEL-001"]["max_count"] == 5
    assert set(rules.FRAUD_PARAMETERS) == set(rules.FRAUD_RULES)


@pytest.mark.parametrize(
    "settings",
    [
        {"rules": [{"id": "FRAUD-AMT-009"}]},
        {"rules": [{"id": "AMT-001", "severity": "severe"}]},
        {"rules": [{"id": "AMT-001", "confidence": 1.5}]},
        {"rules": [{"id": "AMT-001", "parameters": {"factor": 2}}]},
        {"rules": [{"id": "AMT-001", "parameters": {"multiplier": "3"}}]},
        {"rules": [{"id": "GEO-003", "parameters": {"high_risk_countries": "NG"}}]},
        {"severity_escalation": {"rules_per_tier": 0}},
        {"severity_escalation": {"max_severity": "top"}},
    ],
)
def test_wrong_settings_are_refused(settings):
    with pytest.raises(ValueError):
        rules.fraud_config(settings)


def test_no_rules_in_force(spark):
    config = rules.fraud_config({"rules": [{"id": k, "enabled": False} for k in rules.FRAUD_RULES]})
    rows = spark.createDataFrame([(1, 2.0)], "transaction_id int, amount double")
    assert [tuple(r) for r in rules.fraud_score(rows, config).collect()] == [(1, 0, -1, 0.0, 0.0)]
