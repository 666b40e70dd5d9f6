"""Insight and recommendation rules, evaluated on read.

A rule is a function of :class:`Facts` to a frame (subject_id, rule_id,
direction, title, text, evidence); all rules are united in their order.
Evidence lists ``kind:id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.plans.series import latest

BEFORE, AFTER_FROM, AFTER_TO = 2700, 900, 3600


@dataclass(frozen=True)
class Facts:
    """features (all names), signals, obs, the afternoon baseline and daily HRV."""

    features: DataFrame
    signals: DataFrame
    obs: DataFrame
    baseline: DataFrame
    hrv: DataFrame


Rule = Callable[[Facts], DataFrame]


def _insight(rows: DataFrame, rule: str, direction: Column, title: str, text: Column, evidence: Column) -> DataFrame:
    return rows.select("subject_id", F.lit(rule).alias("rule_id"), direction.alias("direction"), F.lit(title).alias("title"), text.alias("text"), evidence.alias("evidence"))


def _latest(facts: Facts, name: str) -> DataFrame:
    return latest(facts.features.filter(F.col("feature_id") == name))


def high_stress_period(facts: Facts) -> DataFrame:
    rows = facts.signals.filter("signal_type = 'high_stress'").groupBy("subject_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("signal:"), "signal_id"))).alias("signals"))
    seen = facts.features.filter("feature_id = 'stress_index'").select("subject_id").distinct().withColumn("more", F.array(F.lit("feature:stress_index")))
    rows = rows.join(seen, "subject_id", "left")
    evidence = F.concat("signals", F.coalesce("more", F.array().cast("array<string>")))
    return _insight(rows, "high_stress_period_v1", F.lit("up"), "Sustained high stress", F.format_string("%d sustained high stress period(s)", F.size("signals")), evidence)


def _elevated(name: str, rule: str, bound: float, title: str) -> Rule:
    def rule_(facts: Facts) -> DataFrame:
        rows = _latest(facts, name).filter(F.col("value") >= bound)
        inputs = F.transform("factors", lambda f: F.concat(F.lit("input:"), f["id"]))
        return _insight(rows, rule, F.lit("up"), title, F.format_string("latest value %.1f", "value"), F.concat(F.array(F.lit(f"feature:{name}")), inputs))

    return rule_


def focus_vs_baseline(facts: Facts) -> DataFrame:
    """The latest focus against the mean of at least two earlier afternoons."""
    base = facts.baseline.filter("confidence >= 0.3").groupBy("subject_id").agg(F.avg("focus").alias("base"), F.count("*").alias("n")).filter("n >= 2")
    rows = _latest(facts, "focus_score").filter("confidence >= 0.3").join(base, "subject_id")
    change = F.col("value") - F.col("base")
    rows = rows.withColumn("change", change).filter(F.abs(change) >= 10)
    return _insight(rows, "focus_vs_recent_baseline_v1", F.when(F.col("change") < 0, "down").otherwise("up"), "Focus against recent afternoons", F.format_string("%+.1f against a baseline of %.1f", "change", "base"), F.array(F.lit("feature:focus_score")))


def life_event_effect(facts: Facts) -> DataFrame:
    """(subject_id, kind, feature_id, events, change, confidence): focus and load
    before and after coffees and walks, averaged over events with enough samples."""
    events = facts.obs.filter((F.col("data_type") == S.LIFE_EVENT) & F.col("life_kind").isin("coffee", "walk")).select("subject_id", F.col("id").alias("event_id"), F.col("ts").alias("at"), F.col("life_kind").alias("kind"))
    samples = facts.features.filter(F.col("feature_id").isin("focus_score", "cognitive_load") & (F.col("confidence") >= 0.4)).select("subject_id", "feature_id", "w_end", "value", "confidence")
    # hours make the range join an equi join: each event meets the hours it looks at
    hour = F.floor(F.col("w_end") / 3600)
    hours = F.sequence(F.floor((F.col("at") - BEFORE) / 3600), F.floor((F.col("at") + AFTER_TO) / 3600))
    near = events.withColumn("hour", F.explode(hours)).join(samples.withColumn("hour", hour), ["subject_id", "hour"])
    before = (F.col("w_end") > F.col("at") - BEFORE) & (F.col("w_end") <= F.col("at"))
    after = F.col("w_end").between(F.col("at") + AFTER_FROM, F.col("at") + AFTER_TO)
    side = [F.avg(F.when(before, F.col("value"))).alias("before"), F.avg(F.when(after, F.col("value"))).alias("after"), F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"), F.avg(F.when(before | after, F.col("confidence"))).alias("confidence")]
    each = near.groupBy("subject_id", "kind", "feature_id", "event_id", "at").agg(*side).filter("n_before >= 2 and n_after >= 2")
    newest = F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("at", "event_id")))), lambda e: e["event_id"]), 1, 5)
    return each.groupBy("subject_id", "kind", "feature_id").agg(F.count("*").alias("events"), F.avg(F.col("after") - F.col("before")).alias("change"), F.avg("confidence").alias("confidence"), newest.alias("event_ids"))


def life_event_before_after(facts: Facts) -> DataFrame:
    rows = life_event_effect(facts).filter(F.abs("change") >= 5)
    sure = F.least(F.col("events") / 4.0, F.lit(1.0)) * F.col("confidence")
    label = F.when(sure >= 0.75, "high").when(sure >= 0.4, "medium").otherwise("low")
    text = F.format_string("%s after %s: %+.1f over %d event(s), %s confidence", "feature_id", "kind", "change", "events", label)
    return _insight(rows, "life_event_before_after_v1", F.when(F.col("change") < 0, "down").otherwise("up"), "Before and after an event", text, F.transform("event_ids", lambda e: F.concat(F.lit("observation:"), e)))


def hrv_below_baseline(facts: Facts) -> DataFrame:
    rows = facts.hrv.groupBy("subject_id").agg(F.max_by(F.struct("delta", "method"), "day").alias("h")).select("subject_id", "h.delta", "h.method").filter("delta <= -5")
    return _insight(rows, "hrv_vs_baseline_v1", F.lit("down"), "HRV below baseline", F.format_string("%s %.1f ms against the baseline", "method", "delta"), F.array(F.lit("feature:hrv_vs_baseline")))


#: The ids of the rules.
INSIGHTS: dict[str, Rule] = {
    "high_stress_period_v1": high_stress_period,
    "context_switch_elevated_v1": _elevated("context_switch_rate", "context_switch_elevated_v1", 1.0, "Frequent context switches"),
    "focus_vs_recent_baseline_v1": focus_vs_baseline,
    "cognitive_load_elevated_v1": _elevated("cognitive_load", "cognitive_load_elevated_v1", 60.0, "High combined demand"),
    "sustained_load_elevated_v1": _elevated("sustained_load", "sustained_load_elevated_v1", 60.0, "High sustained load"),
    "life_event_before_after_v1": life_event_before_after,
    "hrv_vs_baseline_v1": hrv_below_baseline,
}


def insights(facts: Facts, rules: dict[str, Rule] | None = None) -> DataFrame:
    """What the rules find, united in their order, with an id of its content."""
    out = None
    for rule in (INSIGHTS if rules is None else rules).values():
        found = rule(facts)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = _nothing(facts, _INSIGHT)
    identity = F.sha2(F.concat_ws("|", "subject_id", "rule_id", "direction", "text", F.array_join("evidence", ",")), 256)
    return out.withColumn("insight_id", identity)


_INSIGHT = "subject_id string, rule_id string, direction string, title string, text string, evidence array<string>"
_HINT = "subject_id string, rule_id string, title string, suggestion string, category string, evidence string"


def _nothing(facts: Facts, ddl: str) -> DataFrame:
    return facts.features.sparkSession.createDataFrame([], ddl)


Hint = Callable[[Facts, DataFrame], DataFrame]


def _hint(rows: DataFrame, rule: str, title: str, text: str) -> DataFrame:
    return rows.select("subject_id", F.lit(rule).alias("rule_id"), F.lit(title).alias("title"), F.lit(text).alias("suggestion"), F.lit("pace").alias("category"), F.concat(F.lit("insight:"), "insight_id").alias("evidence"))


def focus_dip(facts: Facts, found: DataFrame) -> DataFrame:
    focus = _latest(facts, "focus_score").filter("confidence >= 0.3").select("subject_id")
    dip = found.filter("rule_id = 'focus_vs_recent_baseline_v1' and direction = 'down'").join(focus, "subject_id", "left_semi")
    return _hint(dip, "focus_dip_pace_hint_v1", "Ease the pace", "Focus is under its usual level; a short break may help.")


def combined_demand(facts: Facts, found: DataFrame) -> DataFrame:
    load = found.filter("rule_id = 'cognitive_load_elevated_v1'")
    return _hint(load, "combined_demand_pace_hint_v1", "Spread demands", "Several demands meet; moving one of them may help.")


#: The ids of the rules.
HINTS: dict[str, Hint] = {"focus_dip_pace_hint_v1": focus_dip, "combined_demand_pace_hint_v1": combined_demand}


def recommendations(facts: Facts, found: DataFrame, hints: dict[str, Hint] | None = None) -> DataFrame:
    """Pace hints that follow from insights (by rule and direction)."""
    out = None
    for hint in (HINTS if hints is None else hints).values():
        made = hint(facts, found)
        out = made if out is None else out.unionByName(made)
    return _nothing(facts, _HINT) if out is None else out


class DuplicateRule(ValueError):
    """A rule of this kind is registered under this id."""


@dataclass
class RuleBook:
    """Rules of one's own, by id: insights first, then the hints that follow from
    them.  Insights and hints have ids apart; without rules nothing is found."""

    insight_rules: dict[str, Rule] = field(default_factory=dict)
    hint_rules: dict[str, Hint] = field(default_factory=dict)

    @staticmethod
    def usual() -> RuleBook:
        return RuleBook(dict(INSIGHTS), dict(HINTS))

    def register(self, rule_id: str, rule: Rule) -> None:
        if rule_id in self.insight_rules:
            raise DuplicateRule(rule_id)
        self.insight_rules[rule_id] = rule

    def register_hint(self, rule_id: str, hint: Hint) -> None:
        if rule_id in self.hint_rules:
            raise DuplicateRule(rule_id)
        self.hint_rules[rule_id] = hint

    def evaluate(self, facts: Facts) -> tuple[DataFrame, DataFrame]:
        found = insights(facts, self.insight_rules)
        return found, recommendations(facts, found, self.hint_rules)
