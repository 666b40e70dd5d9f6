"""Catalogs that are told which features will be asked for write no more than those use."""

from __future__ import annotations

import pytest
from tidelog import queries
from tidelog.plans.features import MADE_OF, USES, Catalog
from tidelog.sources.events import typed_observations

KEY = ("subject_id", "w_end", "value", "confidence", "factors")


@pytest.fixture(scope="module")
def obs(spark, sf_dir):
    return typed_observations(spark, sf_dir)


def test_each_feature_finds_its_columns(spark, obs):
    """A column that a feature uses and USES lacks would fail here."""
    for name in USES:
        assert Catalog(obs, 60, most=None, names=(name,), evidence=False)[name].columns


def test_other_features_are_refused(obs):
    cat = Catalog(obs, 60, names=("cognitive_load",))
    assert cat.names == {"cognitive_load", *MADE_OF["cognitive_load"]}
    with pytest.raises(KeyError):
        cat["focus_score"]


def test_values_without_evidence(obs):
    names = ("focus_score", "energy_score")
    whole, bare = Catalog(obs, 60, most=20), Catalog(obs, 60, most=20, names=names, evidence=False)
    rows = lambda cat: sorted(map(str, cat.all(*names).select("feature_id", *KEY).collect()))
    assert rows(whole) == rows(bare)
    assert bare.all(*names).filter("size(evidence) > 0").isEmpty()
    assert not [c for c in bare._windows().columns if c.startswith("i_")]


def test_insights_write_what_they_use(spark, sf_dir, monkeypatch):
    written = []
    held = Catalog._held
    monkeypatch.setattr(Catalog, "_held", lambda self, df: self.keep and written.append(df.columns) or held(self, df))
    assert queries.QUERIES["insights"](spark, sf_dir).columns == ["subject_id", "rule_id", "title", "text"]
    assert written and not [c for columns in written for c in columns if c == "evidence" or c.startswith(("i_", "lig_", "git_", "med_"))]


def test_sustained_load_reads_the_events_once(spark, sf_dir):
    """Its parts read rows and windows that are written once."""
    plan = queries.QUERIES["sustained_load"](spark, sf_dir)
    assert not [f for f in plan.inputFiles() if f.endswith("events.parquet")]
