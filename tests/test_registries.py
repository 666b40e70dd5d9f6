"""Orders of nodes, rules under ids, and channels of a source report."""

from __future__ import annotations

import pytest

from tidelog import schema as S
from tidelog.plans import registry, report, rules, series
from tidelog.plans.features import FEATURES, Catalog


def nodes(**needs):
    out = registry.Registry()
    for name, wants in needs.items():
        out.register(registry.Node(name, lambda cat: cat["stress_index"], tuple(wants)))
    return out


def test_order_is_by_readiness_then_registration():
    assert nodes(e="bc", d="a", c="", b="a", a="").ordered() == ["c", "a", "d", "b", "e"]
    assert nodes(z="", y="z", x="", w="x", v="z").ordered() == ["z", "x", "y", "v", "w"]
    assert nodes(c="b", b="a", a="", other="").ordered(["c"]) == ["a", "b", "c"]
    assert nodes(a="", b="").ordered([]) == []
    with pytest.raises(registry.DependencyCycle, match="a"):
        nodes(a="a").ordered()
    with pytest.raises(registry.UnknownDependency, match="b needs nothing"):
        nodes(a="b", b=("nothing",)).ordered(["a"])


def test_every_dependency_of_the_catalog(spark):
    full = registry.full_catalog()
    order = full.ordered()
    assert all(order.index(n) < order.index(name) for name, node in full.nodes.items() for n in node.needs)
    assert full.ordered(["focus_score"]) == ["context_switch_rate", "focus_score"]
    assert set(full.ordered(["distraction_score"])) == {"context_switch_rate", "distraction_score"}
    assert set(FEATURES) <= set(order)


def test_only_what_is_asked_is_returned(spark):
    rows = [tuple({"id": f"{t}", "subject_id": "s", "ts": t, "provider_id": "p", "data_type": S.CONTEXT, "confidence": 1.0, "created_at": 1, "bundle_id": f"b{t % 7}"}.get(c) for c in S.COLUMNS) for t in range(900, 2400, 60)]
    cat = Catalog(spark.createDataFrame(rows, S.TYPED_DDL), 60)
    assert {r["feature_id"] for r in registry.full_catalog().run(cat, ["focus_score"]).collect()} == {"focus_score"}


def facts(spark):
    features = spark.createDataFrame([("s", "cognitive_load", 900, 90.0, 1.0)], "subject_id string, feature_id string, w_end long, value double, confidence double")
    return rules.Facts(features, features, features, features, features)


def finding(rule_id: str):
    def rule(given: rules.Facts):
        return given.features.selectExpr("subject_id", f"'{rule_id}' AS rule_id", "'up' AS direction", "'t' AS title", "'x' AS text", "array('feature:a') AS evidence")

    return rule


def test_rules_have_one_id_each(spark):
    book = rules.RuleBook()
    found, hints = book.evaluate(facts(spark))
    assert found.count() == hints.count() == 0 and "insight_id" in found.columns
    book.register("own", finding("own"))
    book.register("cognitive_load_elevated_v1", finding("cognitive_load_elevated_v1"))
    book.register_hint("own", rules.combined_demand)
    with pytest.raises(rules.DuplicateRule):
        book.register("own", finding("own"))
    with pytest.raises(rules.DuplicateRule):
        book.register_hint("own", rules.focus_dip)
    found, hints = book.evaluate(facts(spark))
    assert [r["rule_id"] for r in found.collect()] == ["own", "cognitive_load_elevated_v1"]
    assert [r["rule_id"] for r in hints.collect()] == ["combined_demand_pace_hint_v1"]
    assert hints.columns == spark.createDataFrame([], rules._HINT).columns
    assert set(rules.RuleBook.usual().insight_rules) == set(rules.INSIGHTS)
    rules.RuleBook.usual().register("own", finding("own"))
    assert "own" not in rules.INSIGHTS


def test_channels_and_their_states(spark):
    kinds = [S.HRV, S.HRV, S.CONTEXT, S.LIFE_EVENT, S.KEYSTROKES]
    obs = spark.createDataFrame([(k, 100 + i) for i, k in enumerate(kinds)] + [(S.STEPS, 5)], "data_type string, ts long")
    seen = series.source_channels(obs, 50, [*S.COMPUTER_CHANNELS, *S.WATCH_CHANNELS])
    got = {r["data_type"]: r["state"] for r in series.channel_states(seen, {S.GIT}).collect()}
    assert len(got) == 15
    assert {k for k, v in got.items() if v == "rows"} == set(kinds)
    assert got[S.GIT] == got[S.STEPS] == "none" and got[S.CALENDAR] == got[S.LIGHT] == "off"
    lines = [r["line"] for r in report.channel_lines(series.channel_states(seen, {S.GIT})).collect()]
    assert lines[0] == "- watch channels with rows: 1 of 6" and len(lines) == 16
    assert lines[1] == "- computer context_window: 1 rows, last at 102" and lines[3] == "- computer calendar_event: collection is off" and lines[12] == "- watch step_count: no rows"
