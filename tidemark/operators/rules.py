"""Declarative predicates and fraud rules, compiled to Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.risk import miles, noisy_or, raised
from . import frames

_TESTS: dict[str, Callable[[Column, Any], Column]] = {
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "ge": lambda c, v: c >= v,
    "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "modulo_equals": lambda c, v: c % v[0] == v[1],
    "regex_match": lambda c, v: c.rlike(v),
}


def condition(spec: dict[str, Any]) -> Column:
    """A tree of ``{"and": [...]}``, ``{"or": [...]}`` and ``{"field", "operator", "value"}``; null makes a test false."""
    if "and" in spec:
        return reduce(lambda a, b: a & b, map(condition, spec["and"]), F.lit(True))
    if "or" in spec:
        return reduce(lambda a, b: a | b, map(condition, spec["or"]), F.lit(False))
    column, operator = F.col(spec["field"]), spec["operator"]
    if operator in ("is_null", "is_not_null"):
        return column.isNull() if operator == "is_null" else column.isNotNull()
    if operator not in _TESTS:
        raise ValueError(f"unknown operator {operator!r}")
    return F.coalesce(_TESTS[operator](column, spec["value"]), F.lit(False))


def velocity_rule(txns: DataFrame, name: str, key: str = "account_id", max_count: int = 10, seconds: int = 300, amount_threshold: float | None = None) -> DataFrame:
    """``name``: whether the rows of ``key`` within the look-back, the current one included, are more than ``max_count``; only
    amounts up to ``amount_threshold`` count, if one is given. A missing key breaks no rule."""
    counted = F.lit(1) if amount_threshold is None else F.when(F.col("amount") <= amount_threshold, 1)
    rows = frames.sums_within(txns.drop(name), key, "us", {name: (counted.cast("bigint"), seconds)})
    return rows.withColumn(name, F.col(key).isNotNull() & (F.coalesce(F.col(name), F.lit(0)) > max_count))


def cumulative_rule(txns: DataFrame, name: str, key: str = "account_id", max_amount: float = 100_000.0, seconds: int = 86_400) -> DataFrame:
    """``name``: whether the amounts of ``key`` within the look-back add up to more than ``max_amount``."""
    if isinstance(txns.schema["amount"].dataType, (T.FloatType, T.DoubleType)):  # sums of these can't be taken back exactly
        return txns.withColumn(name, F.col(key).isNotNull() & (F.sum("amount").over(frames.history(key, "us", seconds)) > max_amount))
    rows = frames.sums_within(txns.drop(name), key, "us", {name: (F.col("amount"), seconds)})
    return rows.withColumn(name, F.col(key).isNotNull() & (F.col(name) > max_amount))


def cardinality_rule(txns: DataFrame, name: str, group_by: str, count_field: str, max_distinct: int = 3, seconds: int = 3600) -> DataFrame:
    """``name``: whether ``group_by`` met more than ``max_distinct`` values of ``count_field`` within the look-back."""
    out = frames.distinct_counts(txns, group_by, "us", {name: (count_field, seconds)})
    return out.withColumn(name, F.col(group_by).isNotNull() & (F.col(name) > max_distinct))


def geo_velocity_rule() -> Column:
    """Never met: the rule has no location store to compare with."""
    return F.lit(False)


def _minutes(clock: str) -> int:
    hour, minute = clock.split(":")
    return int(hour) * 60 + int(minute)


def in_time_window(ts: Column, active_days: list[str] | None = None, outside_hours: tuple[str, str] | None = None, timezone: str = "UTC") -> Column:
    """Whether ``ts`` (UTC) is on one of the named days (of UTC) and outside the hours of the zone, ends belonging to them."""
    out = F.lit(True)
    if active_days:
        out = out & F.lower(F.date_format(ts, "EEEE")).isin(*[d.lower() for d in active_days])
    if outside_hours:
        local = F.from_utc_timestamp(ts, timezone)
        out = out & ~(F.hour(local) * 60 + F.minute(local)).between(*map(_minutes, outside_hours))
    return out


def schedule_active(ts: Column, active_days: list[str] | None = None, start_date: str | None = None, end_date: str | None = None) -> Column:
    """Whether a rule's schedule holds at ``ts``: named days, first and last date, all inclusive."""
    out, day = in_time_window(ts, active_days), F.to_date(ts)
    if start_date:
        out = out & (day >= F.lit(start_date).cast("date"))
    if end_date:
        out = out & (day <= F.lit(end_date).cast("date"))
    return out


def rule_audit(hits: DataFrame) -> DataFrame:
    """For each rule of ``hits`` (``transaction_id``, ``rule_id``, ``matched``): evaluations, matches, their share and the
    transactions that matched."""
    matched = F.col("matched")
    n = F.count("*")
    return hits.groupBy("rule_id").agg(n.alias("evaluated"), F.count(F.when(matched, 1)).alias("triggered"), F.round(F.count(F.when(matched, 1)) / n, 9).alias("trigger_rate"), F.count_distinct(F.when(matched, F.col("transaction_id"))).alias("transactions"))


def last_audits(hits: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The ``n`` last matches of each value of ``key``, newest first (``place`` 1)."""
    w = frames.Window.partitionBy(key).orderBy(F.col("us").desc(), F.col("transaction_id").desc(), F.col("rule_id"))
    return hits.filter("matched").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


class RuleSet:
    """Rules by id in order of priority; changed sets are new objects, so plans in use are not affected."""

    def __init__(self, rules: tuple[dict[str, Any], ...]):
        self.rules = rules

    def get(self, rule_id: str) -> dict[str, Any] | None:
        """The rule, or None."""
        return next((r for r in self.rules if r["id"] == rule_id), None)

    def put(self, rule: dict[str, Any]) -> RuleSet:
        """With ``rule`` added, or in the place of the one with its id; by ``priority`` (100 if not given)."""
        condition(rule["when"])  # raises on unknown operators
        rules = [*(r for r in self.rules if r["id"] != rule["id"]), rule]
        return RuleSet(tuple(sorted(rules, key=lambda r: r.get("priority", 100))))

    def remove(self, rule_id: str) -> RuleSet:
        """Without the rule."""
        return RuleSet(tuple(r for r in self.rules if r["id"] != rule_id))

    def enable(self, rule_id: str, on: bool = True) -> RuleSet:
        """With the rule switched on or off."""
        return RuleSet(tuple(r | {"enabled": on} if r["id"] == rule_id else r for r in self.rules))

    @property
    def active(self) -> tuple[dict[str, Any], ...]:
        """The rules that are switched on."""
        return tuple(r for r in self.rules if r.get("enabled", True))


#: Business rules in order of priority: id, action and condition.
BUSINESS_RULES: tuple[dict[str, Any], ...] = (
    {"id": "BR-BLOCK", "action": "block", "severity": 3, "when": {"and": [{"field": "status", "operator": "equals", "value": "declined"}, {"field": "amount", "operator": "gt", "value": 95}]}},
    {"id": "BR-COUNTRY", "action": "flag", "severity": 2, "when": {"field": "country", "operator": "in", "value": ["NG"]}},
    {"id": "BR-ROUND", "action": "flag", "severity": 1, "when": {"or": [{"field": "merchant_id", "operator": "modulo_equals", "value": [10, 0]}, {"field": "mcc_slot", "operator": "is_null"}]}},
    {"id": "BR-CHANNEL", "action": "allow", "severity": 0, "when": {"field": "channel", "operator": "not_in", "value": ["online", "mobile"]}},
)


def business_decision(txns: DataFrame, rules: tuple[dict[str, Any], ...] = BUSINESS_RULES) -> DataFrame:
    """``triggered`` (rule ids up to the first block), ``decision`` and ``severity`` of each row.

    Rules are looked at by priority and none after the first that blocks; block outranks flag, flag outranks allow."""
    blocked = F.lit(False)
    hits = []
    for rule in rules:
        hit = condition(rule["when"]) & ~blocked
        hits.append(F.when(hit, F.struct(F.lit(rule["id"]).alias("id"), F.lit(rule["severity"]).alias("severity"), F.lit({"block": 2, "flag": 1}.get(rule["action"], 0)).alias("rank"))))
        if rule["action"] == "block":
            blocked = blocked | hit
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    rows = txns.withColumn("hits", found)
    rank = F.array_max(F.transform("hits", lambda x: x["rank"]))
    return rows.select("transaction_id", F.array_join(F.transform("hits", lambda x: x["id"]), ",").alias("triggered"), F.when(rank == 2, "block").when(rank == 1, "flag").otherwise("allow").alias("decision"), F.coalesce(F.array_max(F.transform("hits", lambda x: x["severity"])), F.lit(-1)).alias("severity"))


#: Fraud rules: id -> (tier 0..3 for low to critical, confidence, category): fixed values.
FRAUD_RULES = {
    "AMT-001": (2, 0.75, "amount"),
    "AMT-002": (3, 0.85, "amount"),
    "AMT-003": (1, 0.55, "amount"),
    "VEL-001": (2, 0.80, "velocity"),
    "VEL-002": (2, 0.85, "velocity"),
    "VEL-003": (1, 0.60, "velocity"),
    "GEO-001": (3, 0.90, "geo"),
    "GEO-002": (2, 0.70, "geo"),
    "GEO-003": (2, 0.65, "geo"),
    "PAT-001": (2, 0.75, "pattern"),
    "PAT-002": (1, 0.55, "pattern"),
    "PAT-003": (3, 0.90, "pattern"),
    "PAT-004": (2, 0.80, "pattern"),
    "PAT-005": (0, 0.45, "pattern"),
    "TMP-001": (1, 0.60, "temporal"),
    "TMP-002": (2, 0.70, "temporal"),
    "TMP-003": (1, 0.65, "temporal"),
}
#: Parameters of the fraud rules by rule, under the names of the rules' configuration: fixed values, each may be given anew.
FRAUD_PARAMETERS: dict[str, dict[str, Any]] = {
    "AMT-001": {"multiplier": 3.0, "min_history_count": 5, "fallback_average": 500.0},
    "AMT-002": {"threshold": 10000.0, "lower_bound": 9000.0},
    "AMT-003": {"min_amount": 5000.0, "modulo": 1000},
    "VEL-001": {"max_count": 5, "window_minutes": 10},
    "VEL-002": {"min_declines": 3, "window_minutes": 30},
    "VEL-003": {"min_transactions": 3, "escalation_factor": 2.0, "window_minutes": 60},
    "GEO-001": {"max_speed_mph": 500, "min_distance_miles": 100},
    "GEO-002": {"min_domestic_transactions": 10},
    "GEO-003": {"high_risk_countries": ["NG", "RU", "UA", "VN", "PH", "ID", "BR", "KP", "IR", "SY"]},
    "PAT-001": {"amount_threshold": 1000.0, "device_age_days": 1},
    "PAT-002": {"min_history_count": 10, "max_category_pct": 0.05},
    "PAT-003": {"small_amount_threshold": 5.0, "min_small_count": 3, "large_amount_threshold": 500.0, "window_minutes": 30},
    "PAT-004": {"max_accounts": 2},
    "PAT-005": {"min_history_count": 10},
    "TMP-001": {"start_hour": 0, "end_hour": 5, "amount_threshold": 2000.0},
    "TMP-002": {"dormant_days": 90},
    "TMP-003": {"silence_hours": 48, "burst_count": 5, "burst_window_minutes": 30},
}
#: Tiers of severities, lowest first: fixed values.
SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class FraudConfig:
    """Rules in force: ``rules`` (id -> tier, confidence, category), their ``parameters``, and the number of further rules
    that raise the severity by a tier (``per_tier``, 0: never) up to tier ``most``."""

    rules: dict[str, tuple[int, float, str]]
    parameters: dict[str, dict[str, Any]]
    per_tier: int = 2
    most: int = 3


def fraud_config(settings: dict[str, Any] | None = None) -> FraudConfig:
    """The rules under ``settings``, a configuration file's content as parsed: ``rules`` is a list of mappings with an
    ``id`` (with or without ``FRAUD-`` before it) and any of ``enabled``, ``severity``, ``confidence`` and ``parameters``;
    ``severity_escalation`` may have ``enabled``, ``rules_per_tier`` and ``max_severity``. Other entries, such as names and
    tags, decide nothing. What isn't given keeps its fixed value; a rule that isn't listed stays as it is.

    Unknown rules, parameters and severities, confidences outside 0 to 1, parameters of another kind than the fixed ones
    and tiers of less than one rule are refused, so that a changed file can't silently switch a rule off."""
    settings = settings or {}
    known, parameters = dict(FRAUD_RULES), {k: dict(v) for k, v in FRAUD_PARAMETERS.items()}
    for entry in settings.get("rules") or []:
        rule = str(entry["id"]).removeprefix("FRAUD-")
        if rule not in FRAUD_RULES:
            raise ValueError(f"unknown rule: {entry['id']}")
        tier, confidence, category = FRAUD_RULES[rule]
        tier, confidence = _tier(entry.get("severity", SEVERITIES[tier])), entry.get("confidence", confidence)
        if not _number(confidence) or not 0 <= confidence <= 1:
            raise ValueError(f"not a confidence: {rule} {confidence}")
        for name, value in (entry.get("parameters") or {}).items():
            fixed = FRAUD_PARAMETERS[rule].get(name)
            right = _number(value) if _number(fixed) else isinstance(fixed, list) and isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value)
            if not right:
                raise ValueError(f"not a parameter: {rule} {name} {value!r}")
            parameters[rule][name] = value
        known[rule] = (tier, float(confidence), category)
        if not entry.get("enabled", True):
            del known[rule]
    raising = settings.get("severity_escalation") or {}
    per_tier = raising.get("rules_per_tier", 2)
    if not _number(per_tier) or per_tier < 1:
        raise ValueError(f"not a number of rules: {per_tier}")
    return FraudConfig(known, parameters, int(per_tier) if raising.get("enabled", True) else 0, _tier(raising.get("max_severity", SEVERITIES[-1])))


def _tier(severity: str) -> int:
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity: {severity}")
    return SEVERITIES.index(severity)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def fraud_matches(txns: DataFrame, config: FraudConfig | None = None) -> DataFrame:
    """A boolean column for each fraud rule in force, from frames over the customer's (and the device's) transactions.

    ``txns`` has the columns of the risk view; ``config`` comes from ``fraud_config``. Frames around a row hold the others within the given minutes on both sides. A missing value breaks no rule. Rows are shuffled by customer
    and by device, once each; only the amounts of one hour are gathered."""
    config = config or fraud_config()
    p = config.parameters
    window = frames.Window
    order = window.partitionBy("customer_id").orderBy("us", "transaction_id")
    prior = frames.prior("customer_id", "us", "transaction_id")
    near = lambda minutes: frames.around("customer_id", "us", int(minutes * 60))
    same = lambda column: window.partitionBy("customer_id", column).orderBy("us", "transaction_id").rowsBetween(window.unboundedPreceding, -1)
    amount = F.col("amount").cast("double")
    burst = int(p["TMP-003"]["burst_window_minutes"] * 60) * frames.SECOND
    earlier = window.partitionBy("customer_id").orderBy("us").rangeBetween(window.unboundedPreceding, -burst - 1)
    device = window.partitionBy("device_id").orderBy("us", "transaction_id")
    so_far = device.rowsBetween(window.unboundedPreceding, 0)
    abroad = F.col("country") != "US"
    small = F.count(F.when(amount <= p["PAT-003"]["small_amount_threshold"], 1)).over(near(p["PAT-003"]["window_minutes"]))
    rows = txns.repartition("customer_id").withColumns({
        "n_prior": F.count("*").over(prior),
        "sum_prior": F.sum("amount").over(prior).cast("double"),
        "abroad_prior": F.count(F.when(abroad, 1)).over(prior),
        "rapid": F.count("*").over(near(p["VEL-001"]["window_minutes"])) - 1,
        "declines": F.count(F.when(F.col("status") == "declined", 1)).over(near(p["VEL-002"]["window_minutes"])) - (F.col("status") == "declined").cast("int"),
        "hour_amounts": F.sort_array(F.collect_list(amount).over(near(p["VEL-003"]["window_minutes"]))),
        "small": small - (amount <= p["PAT-003"]["small_amount_threshold"]).cast("int"),
        "in_burst": F.count("*").over(near(p["TMP-003"]["burst_window_minutes"])) - 1,
        "before_burst": F.max("us").over(earlier),
        "last_us": F.lag("us").over(order),
        "last_lat": F.lag("lat").over(order),
        "last_lon": F.lag("lon").over(order),
        "same_channel": F.count("*").over(same("channel")),
        "same_mcc": F.count("*").over(same("mcc")),
    }).withColumn("idle", (F.col("us") - F.col("last_us")) / frames.SECOND)
    first_use = F.row_number().over(window.partitionBy("device_id", "account_id").orderBy("us", "transaction_id")) == 1
    rows = rows.repartition("device_id").withColumn("first_use", first_use).withColumns({"device_since": F.min("us").over(so_far), "device_accounts": F.count(F.when(F.col("first_use"), 1)).over(so_far)})
    hours = F.col("idle") / 3600
    distance = miles(F.col("last_lat"), F.col("last_lon"), F.col("lat"), F.col("lon"))
    there = (F.col("lat") != 0) & (F.col("lon") != 0) & (F.col("last_lat") != 0) & (F.col("last_lon") != 0)
    top = F.slice("hour_amounts", -p["VEL-003"]["min_transactions"], p["VEL-003"]["min_transactions"])
    rising = F.forall(F.sequence(F.lit(1), F.lit(p["VEL-003"]["min_transactions"] - 1)), lambda i: F.get(top, i) >= F.get(top, i - 1) * p["VEL-003"]["escalation_factor"])
    silent = F.when(F.col("before_burst").isNotNull(), (F.col("us") - F.col("before_burst") - burst) / frames.SECOND).otherwise(F.col("idle"))
    matches = {
        "AMT-001": amount > p["AMT-001"]["multiplier"] * F.when(F.col("n_prior") < p["AMT-001"]["min_history_count"], F.lit(p["AMT-001"]["fallback_average"])).otherwise(F.try_divide("sum_prior", "n_prior")),
        "AMT-002": (amount >= p["AMT-002"]["lower_bound"]) & (amount < p["AMT-002"]["threshold"]),
        "AMT-003": (amount >= p["AMT-003"]["min_amount"]) & (amount % p["AMT-003"]["modulo"] == 0),
        "VEL-001": F.col("rapid") >= p["VEL-001"]["max_count"],
        "VEL-002": (F.col("status") == "approved") & (F.col("declines") >= p["VEL-002"]["min_declines"]),
        "VEL-003": F.when(F.size("hour_amounts") >= p["VEL-003"]["min_transactions"], (F.get(top, F.lit(0)) > 0) & rising),
        "GEO-001": there & (distance >= p["GEO-001"]["min_distance_miles"]) & (hours > 0) & (distance > p["GEO-001"]["max_speed_mph"] * hours),
        "GEO-002": abroad & (F.col("abroad_prior") == 0) & (F.col("n_prior") >= p["GEO-002"]["min_domestic_transactions"]),
        "GEO-003": F.col("country").isin(*p["GEO-003"]["high_risk_countries"]),
        "PAT-001": (F.col("us") - F.col("device_since") <= p["PAT-001"]["device_age_days"] * 86_400 * frames.SECOND) & (amount >= p["PAT-001"]["amount_threshold"]),
        "PAT-002": (F.col("n_prior") >= p["PAT-002"]["min_history_count"]) & (F.col("same_mcc") <= p["PAT-002"]["max_category_pct"] * F.col("n_prior")),
        "PAT-003": (amount >= p["PAT-003"]["large_amount_threshold"]) & (F.col("small") >= p["PAT-003"]["min_small_count"]),
        "PAT-004": F.col("device_accounts") > p["PAT-004"]["max_accounts"],
        "PAT-005": (F.col("n_prior") >= p["PAT-005"]["min_history_count"]) & (F.col("same_channel") == 0),
        "TMP-001": F.expr("us div 3600000000 % 24").between(p["TMP-001"]["start_hour"], p["TMP-001"]["end_hour"] - 1) & (amount >= p["TMP-001"]["amount_threshold"]),
        "TMP-002": F.col("idle") >= p["TMP-002"]["dormant_days"] * 86_400,
        "TMP-003": (F.col("in_burst") >= p["TMP-003"]["burst_count"] - 1) & (silent >= p["TMP-003"]["silence_hours"] * 3600),
    }
    return rows.select("transaction_id", "amount", *[F.coalesce(m, F.lit(False)).alias(k) for k, m in matches.items() if k in config.rules])


def fraud_score(matches: DataFrame, config: FraudConfig | None = None) -> DataFrame:
    """``n_rules``, ``severity`` (tier), ``confidence`` and ``score`` of each transaction."""
    config = config or fraud_config()
    if not config.rules:
        return matches.select("transaction_id", F.lit(0).alias("n_rules"), F.lit(-1).alias("severity"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("score"))
    found = F.filter(F.array(*[F.when(F.col(k), F.struct(F.lit(t).alias("tier"), F.lit(p).alias("p"), F.lit(c).alias("category"))) for k, (t, p, c) in config.rules.items()]), lambda x: x.isNotNull())
    rows = matches.select("transaction_id", found.alias("found"))
    tiers = F.transform("found", lambda x: x["tier"])
    rows = rows.select("transaction_id", F.size("found").alias("n_rules"), raised(tiers, config.per_tier, config.most).alias("severity"), noisy_or(F.transform("found", lambda x: x["p"])).alias("confidence"), F.size(F.array_distinct(F.transform("found", lambda x: x["category"]))).alias("kinds"))
    score = F.when(F.col("n_rules") > 0, 0.5 * F.col("confidence") + 0.3 * F.col("severity") / 3 + 0.2 * F.least(F.col("kinds") / 5, F.lit(1.0))).otherwise(0.0)
    return rows.select("transaction_id", "n_rules", F.coalesce("severity", F.lit(-1)).alias("severity"), "confidence", F.round(score, 6).alias("score"))


def backtest(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """TP, FP, TN, FN, precision, recall and F1 of every rule against ``labels`` (transaction_id, is_fraud)."""
    rules = [k for k in FRAUD_RULES if k in matches.columns]
    counts = [F.count(F.when(test, 1)).alias(f"{name}|{k}") for k in rules for name, test in (("tp", F.col(f"`{k}`") & F.col("is_fraud")), ("fp", F.col(f"`{k}`") & ~F.col("is_fraud")), ("fn", ~F.col(f"`{k}`") & F.col("is_fraud")), ("tn", ~F.col(f"`{k}`") & ~F.col("is_fraud")))]
    one = matches.join(labels, "transaction_id").agg(*counts)  # one pass over the rows for all rules
    out = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule_id"), *[F.col(f"`{n}|{k}`").alias(n) for n in ("tp", "fp", "fn", "tn")]) for k in rules])).alias("x")).select("x.*")
    prec, rec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return out.select("rule_id", "tp", "fp", "fn", "tn", F.round(prec, 9).alias("prec"), F.round(rec, 9).alias("rec"), F.round(f1, 9).alias("f1"))


def backtest_totals(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """``n``, the share of frauds that at least one rule matches, and that of the other transactions."""
    hit = reduce(lambda a, b: a | b, (F.col(f"`{k}`") for k in FRAUD_RULES if k in matches.columns))
    both = matches.join(labels, "transaction_id").select(hit.alias("hit"), "is_fraud")
    share = lambda of: F.round(F.try_divide(F.count(F.when(F.col("hit") & of, 1)).cast("double"), F.count(F.when(of, 1))), 9)
    return both.agg(F.count("*").alias("n"), share(F.col("is_fraud")).alias("detection_rate"), share(~F.col("is_fraud")).alias("false_positive_rate"))


def where_from(filters: dict[str, tuple[str, Any]], allowed: set[str]) -> Column:
    """All of ``filters`` (column -> comparison and value); those whose value is None are left out. Columns and comparisons
    that are not allowed are refused."""
    tests = {"=": lambda c, v: c == v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}
    out = F.lit(True)
    for column, (comparison, value) in filters.items():
        if column not in allowed or comparison not in tests:
            raise ValueError(f"not allowed: {column} {comparison}")
        if value is not None:
            out = out & tests[comparison](F.col(column), value)
    return out


#: Verbs that an expression may not hold: fixed values.
BLOCKED = ("DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE", "INSERT", "UPDATE", "MERGE", "GRANT", "REVOKE")


def transformed(rows: DataFrame, expressions: list[str]) -> DataFrame:
    """``rows`` under expressions given as text; statement ends, comments and verbs of ``BLOCKED`` are refused."""
    import re

    for text in expressions:
        if re.search(r";|--|/\*|\b(" + "|".join(BLOCKED) + r")\b", text, re.IGNORECASE):
            raise ValueError(f"not allowed: {text!r}")
    return rows.selectExpr(*expressions)
