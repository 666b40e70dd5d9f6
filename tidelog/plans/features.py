"""Window features as one lazy plan.

All features over observations share a single aggregation by panes, merged to
(subject_id, w_end); sleep and clock features use running sums over what enters
and leaves the last 24 hours; composites join or look back over the feature
frames.  Scans over a subject's history work day by day.  A feature is emitted only where its inputs
are, so no row means no evidence.

Every feature frame has (subject_id, w_end, value, confidence, evidence,
factors): evidence is the sorted array of observation ids, factors an array of
(id, share).
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from fnmatch import fnmatchcase
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.scores import Parts, add, clamp, confidence, fall, shares, switch_load, switch_stability
from tidelog.operators.stored import stored
from tidelog.plans import panes, windows as W

COLUMNS = ("subject_id", "w_end", "value", "confidence", "evidence", "factors")
_NO_FACTORS, _NO_IDS = "cast(array() as array<struct<id:string,share:double>>)", "cast(array() as array<string>)"
#: Short names of the data types that windows aggregate.
TYPES = {"ctx": S.CONTEXT, "key": S.KEYSTROKES, "brw": S.BROWSER, "med": S.MEDIA, "git": S.GIT, "lig": S.LIGHT, "ntf": S.NOTIFICATION, "hrv": S.HRV, "stp": S.STEPS, "nrg": S.ENERGY, "hr": S.HEART_RATE}
#: All groups of rows that windows count and list.
GROUPS = (*TYPES, "git_ok", "ntf_ok", "walk", "workout")
#: How distracting a browser category is.
CATEGORY_WEIGHTS = {"work": 10.0, "reference": 20.0, "communication": 45.0, "shopping": 75.0, "entertainment": 90.0}
#: Seconds of the blocks of ends that share a list of a day's ids.
LISTED = 2 * 3600
#: Columns of the windows that a feature uses: (groups, each a count, a sum of
#: confidences and a list of ids; other columns); and features it is made of.
USES: dict[str, tuple[str, str]] = {
    "context_switch_rate": ("ctx", "switches"), "focus_score": ("key hrv ctx", "switches rate rmssd"), "stress_index": ("hrv", "rmssd pnn50"),
    "fatigue_index": ("key hr ctx", "bpm"), "recovery_score": ("hrv hr", "rmssd bpm"), "distraction_score": ("brw ctx", "category_weight churn switches"),
    "media_share": ("med", "med_* n_med_known"), "git_rate": ("git_ok", "git_*"), "light_share": ("lig", "lig_*"), "activity_balance": ("stp workout", "steps"),
    "energy_score": ("nrg hr", "bpm kcal"), "notification_pressure": ("ntf_ok", "ntf_* int_* app_*"), "desk_away": ("walk stp key ctx", "steps typing bundles"),
}
MADE_OF: dict[str, tuple[str, ...]] = {
    "fatigue_index": ("focus_score",), "cognitive_load": ("meeting_density", "context_switch_rate", "notification_pressure"), "deep_work_score": ("focus_score", "context_switch_rate"),
    "attention_stability": ("focus_score", "context_switch_rate"), "sustained_load": ("stress_index", "fatigue_index", "meeting_density"),
}
#: Features that other features are made of.
SHARED = ("focus_score", "context_switch_rate", "stress_index", "fatigue_index", "meeting_density", "notification_pressure")
PLAYING_KINDS = ("music", "podcast", "other")
COUNTED_GIT = ("commit", "checkout", "sync", "other")
KNOWN_LIGHT = ("dark", "dim", "moderate", "bright")
REST_STAGES, ALL_REST = ("asleep", "in_bed"), ("asleep", "in_bed", "asleep_core", "asleep_deep", "asleep_rem")
TARGET_REST = 28800


def ids(*columns: str) -> Column:
    """Sorted ids of several id arrays."""
    return F.array_sort(F.concat(*[F.col(c) for c in columns]))


def with_changes(obs: DataFrame) -> DataFrame:
    """Adds ``changed``: whether the label (bundle or category) differs from that
    of the previous labelled row of the same type; null for rows without one.
    Only rows of the last window's length matter, so days are ordered apart,
    each with a halo of that length: a subject of any size spreads over many tasks."""
    label = F.coalesce("bundle_id", "category")
    labelled = F.col("data_type").isin(S.CONTEXT, S.BROWSER) & label.isNotNull()
    rows = panes.by_day(obs.filter(labelled), F.col("ts"), F.col("ts") + W.WINDOW)
    order = Window.partitionBy("subject_id", "data_type", "chunk").orderBy("ts", "id")
    rows = rows.withColumn("changed", F.coalesce(label != F.lag(label).over(order), F.lit(False)))
    rows = rows.filter(F.col("chunk") == panes.day_of(F.col("ts"))).drop("chunk")
    return rows.unionByName(obs.filter(~F.coalesce(labelled, F.lit(False))).withColumn("changed", F.lit(None).cast("boolean")))


def _parts(name: str) -> set[str]:
    """The features that a feature is made of, at any depth."""
    return {x for part in MADE_OF.get(name, ()) for x in (part, *_parts(part))}


class Catalog:
    """The feature frames of one set of observations at one step.

    With ``keep``, the windows and the features that others are made of are
    written once and read again: for many features at a time, whose joint plan
    would be too large.  ``most`` limits a subject's grid to its latest ends;
    None evaluates its whole history.  ``spans`` (subject_id, min_ts, max_ts)
    are those of all rows, where ``obs`` holds a part of them.

    What is written holds only what is used: with ``names`` no other features
    can be asked for than these and what they are made of; without ``evidence``
    every list of ids is empty."""

    def __init__(self, obs: DataFrame, step: int = 60, keep: bool = False, most: int | None = W.MOST_ENDS, spans: DataFrame | None = None, names: Collection[str] | None = None, evidence: bool = True):
        self.obs, self.step, self.keep, self.most, self.spans, self.evidence = obs, max(1, step), keep, most, spans, evidence
        self.names = None if names is None else {*names, *(x for n in names for x in _parts(n))}
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if self.names is not None and name not in self.names:
            raise KeyError(f"{name}: not among the features of this catalog")
        if name not in self._made:
            made = FEATURES[name](self)
            if not self.evidence:
                made = made.drop("evidence")
            made = self._held(made) if name in SHARED else made
            self._made[name] = made if self.evidence else made.withColumn("evidence", F.expr(_NO_IDS))
        return self._made[name]

    def _held(self, df: DataFrame) -> DataFrame:
        return stored(df) if self.keep else df

    @cached_property
    def bounds(self) -> DataFrame:
        return W.bounds(W.spans(self.obs) if self.spans is None else self.spans, self.step, self.most)

    @cached_property
    def ends(self) -> DataFrame:
        return W.ends(self.bounds, self.step)

    @cached_property
    def windows(self) -> DataFrame:
        made = self._held(self._windows())
        return made if self.evidence else made.withColumns({f"i_{g}": F.expr(_NO_IDS) for g in GROUPS})

    def _used(self, column: panes.Sum) -> bool:
        """Whether a column of the windows is part of a feature in ``names``."""
        if isinstance(column, panes.Listed) and not self.evidence:
            return False
        if self.names is None:
            return True
        for groups, others in (USES.get(n, ("", "")) for n in self.names):
            if column.name in {f"{p}_{g}" for g in groups.split() for p in "nci"} or any(fnmatchcase(column.name, x) for x in others.split()):
                return True
        return False

    def _windows(self) -> DataFrame:
        """One row for each window that holds an observation."""
        c, kind = F.col, F.col("data_type")

        def group(short: str, cond: Column) -> list[panes.Sum]:
            return [panes.Count(f"n_{short}", cond), panes.Sum(f"c_{short}", F.when(cond, c("confidence"))), panes.Listed(f"i_{short}", F.when(cond, c("id")))]

        columns = [x for short, name in TYPES.items() for x in group(short, kind == name)]
        for short, cond in {
            "git_ok": c("activity_kind").isin(*COUNTED_GIT),
            "ntf_ok": c("notif_count") >= 1,
            "walk": c("life_kind") == "walk",
            "workout": c("life_kind") == "workout",
        }.items():
            columns += group(short, cond)
        for name, cond, amount in (
            *[(f"med_{k}", c("is_playing") & (c("media_kind") == k), F.lit(1)) for k in PLAYING_KINDS],
            *[(f"git_{k}", c("activity_kind") == k, F.coalesce("event_count", F.lit(1))) for k in COUNTED_GIT],
            *[(f"lig_{k}", c("light_kind") == k, F.lit(1)) for k in KNOWN_LIGHT],
            *[(f"ntf_{k}", (c("notif_category") == k) & (c("notif_count") >= 1), c("notif_count")) for k in S.NOTIFICATION_CATEGORIES],
            *[(f"int_{k}", (c("interruption_level") == k) & (c("notif_count") >= 1), c("notif_count")) for k in S.INTERRUPTION_LEVELS],
            *[(f"app_{k}", (c("app_kind") == k) & (c("notif_count") >= 1), c("notif_count")) for k in S.APP_KINDS],
        ):
            columns.append(panes.Sum(name, F.when(cond, amount).cast("double")))
        weight = F.create_map(*[F.lit(x) for kv in CATEGORY_WEIGHTS.items() for x in kv])
        order = F.struct("ts", "id")
        columns += [
            panes.Changes("switches", F.when(kind == S.CONTEXT, c("changed")), order),
            panes.Changes("churn", F.when(kind == S.BROWSER, c("changed")), order),
            panes.Different("bundles", c("bundle_id")),
            panes.Mean("category_weight", F.try_element_at(weight, c("category"))),
            panes.Mean("rate", c("rate_per_min")),
            panes.Most("typing", F.coalesce(c("rate_per_min") >= 30, F.lit(False))),
            panes.Mean("rmssd", c("rmssd_ms")),
            panes.Mean("pnn50", c("pnn50")),
            panes.Mean("bpm", F.when((kind == S.HEART_RATE) & (c("bpm") > 0), c("bpm"))),
            panes.Sum("steps", c("steps")),
            panes.Sum("kcal", F.when(c("kcal") >= 0, c("kcal"))),
            panes.Sum("ntf_total", F.when(c("notif_count") >= 1, c("notif_count"))),
            panes.Count("n_med_known", c("media_kind").isin(*PLAYING_KINDS)),
        ]
        return panes.sliding(with_changes(self._in_reach()), self.bounds, self.step, [x for x in columns if self._used(x)])

    def _in_reach(self) -> DataFrame:
        """The rows that a window of the grid can hold: with ``most``, those since
        the earliest window of any subject, one second for all of them."""
        if self.most is None:
            return self.obs
        since = self.bounds.agg((F.min("first_end") - W.WINDOW).alias("_since"))
        return self.obs.crossJoin(F.broadcast(since)).filter(F.col("ts") >= F.col("_since")).drop("_since")

    def early_bpm(self, seconds: int) -> DataFrame:
        """(subject_id, base): mean heart rate of the first seconds, else 60."""
        first = W.spans(self.obs).select("subject_id", F.col("min_ts").alias("low"), (F.col("min_ts") + seconds).alias("high"))
        hr = self.obs.filter((F.col("data_type") == S.HEART_RATE) & (F.col("bpm") > 0)).select("subject_id", "ts", "bpm")
        early = panes.inside(hr, first, seconds).groupBy("subject_id").agg(F.avg("bpm").alias("mean"))
        return first.join(early, "subject_id", "left").select("subject_id", F.coalesce("mean", F.lit(60.0)).alias("base"))

    def by_days(self, facts: DataFrame) -> DataFrame:
        """``facts``, one row a subject, once for each day of its grid, as ``chunk``."""
        return W.days(self.bounds, self.step).select("subject_id", "chunk").join(facts, "subject_id")

    def with_early_bpm(self, rows: DataFrame, seconds: int) -> DataFrame:
        """``rows`` (subject_id, w_end, ...) with :meth:`early_bpm`, met day by day."""
        base = self.by_days(self.early_bpm(seconds))
        return rows.withColumn("chunk", panes.day_of(F.col("w_end"))).join(base, ["subject_id", "chunk"]).drop("chunk")

    @cached_property
    def meetings(self) -> DataFrame:
        """Busy meetings with start and end: all-day and free ones are skipped."""
        rows = self.obs.filter((F.col("data_type") == S.CALENDAR) & F.col("uid").isNotNull() & F.col("start_s").isNotNull() & F.col("end_s").isNotNull())
        return rows.filter(~F.coalesce("all_day", F.lit(False)) & F.coalesce("busy", F.lit(True))).select("subject_id", "id", "start_s", "end_s", "confidence")

    @cached_property
    def meeting_bounds(self) -> DataFrame:
        return W.bounds(W.spans(self.meetings, "start_s", "end_s"), self.step, self.most)

    def _sleep(self, stages: tuple[str, ...]) -> DataFrame:
        rows = self.obs.filter((F.col("data_type") == S.SLEEP) & (F.col("stage").isNull() | F.col("stage").isin(*stages)) & (F.col("end_s") > F.col("start_s")))
        return rows.select("subject_id", "id", "confidence", "start_s", "end_s")

    def rest_sums(self, stages: tuple[str, ...]) -> DataFrame:
        """Sleep that counts as rest in the 24 hours before every end it reaches
        into: seconds, first and last moment, and rows.  An interval
        fills the window faster from its start on, no more from its end, and
        empties it a day later: four changes of slope, which running sums follow."""
        c, day = F.col, W.DAY
        rows = panes.by_day(self._sleep(stages), c("start_s"), c("end_s") + day)
        zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")

        def event(at: Column, slope: int = 0, rows: int = 0, at_low: int = 0, at_high: int = 0, start: bool = False, finish: bool = False) -> Column:
            conf = c("confidence") * rows
            values = {"at": at, "slope": zero + slope, "level": at * slope, "rows": zero + rows, "conf": conf, "at_low": zero + at_low, "at_high": zero + at_high}
            values |= {"start": c("start_s") if start else nothing, "finish": c("end_s") if finish else nothing}
            return F.struct(*[v.alias(k) for k, v in values.items()])

        events = F.array(
            event(c("start_s"), slope=1),
            event(c("start_s") + 1, rows=1, at_high=1),
            event(c("end_s"), slope=-1, finish=True),
            event(c("end_s") + 1, at_high=-1),
            event(c("start_s") + day, slope=-1, at_low=1, start=True),
            event(c("end_s") + day, slope=1, rows=-1, at_low=-1),
        )
        events = rows.select("subject_id", "chunk", F.explode(events).alias("e")).select("subject_id", "chunk", "e.*")
        up = {f"r_{n}": F.sum(n) for n in ("slope", "level", "rows", "conf", "at_low", "at_high")} | {"r_finish": F.max("finish")}
        found = panes.running(events, self.ends, up, {"r_start": F.min("start")}).filter("r_rows > 0")
        end = c("w_end")
        low, high = F.when(c("r_at_low") > 0, end - day).otherwise(c("r_start")), F.when(c("r_at_high") > 0, end).otherwise(c("r_finish"))
        return found.select("subject_id", "w_end", (end * c("r_slope") - c("r_level")).alias("rest"), low.alias("low"), high.alias("high"), c("r_rows").alias("n_rest"), c("r_conf").alias("c_rest"))

    def rest_items(self, stages: tuple[str, ...]) -> DataFrame:
        """(subject_id, id, low, high): the ends that count a row as rest."""
        return self._sleep(stages).select("subject_id", "id", (F.col("start_s") + 1).alias("low"), (F.col("end_s") + W.DAY - 1).alias("high"))

    def rest(self, stages: tuple[str, ...]) -> DataFrame:
        """:meth:`rest_sums` with the ids of the rows."""
        return self.listed(self.rest_sums(stages), self.rest_items(stages), {"i_rest": F.lit(True)})

    def listed(self, rows: DataFrame, items: DataFrame, columns: dict[str, Column], distinct: bool = False) -> DataFrame:
        """``rows`` with ids of the items, where the catalog has evidence."""
        if not self.evidence:
            return rows.withColumns({n: F.expr(_NO_IDS) for n in columns})
        return panes.listed(rows, items, LISTED, columns, distinct)

    def all(self, *names: str) -> DataFrame:
        """UNION ALL of features with their names; only what they need is built."""
        frames = [self[n].select(F.lit(n).alias("feature_id"), *COLUMNS) for n in (names or FEATURES)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def _emit(rows: DataFrame, value: Column, conf: Column, evidence: Column, factors: Column | None = None) -> DataFrame:
    return rows.select("subject_id", "w_end", value.alias("value"), conf.alias("confidence"), evidence.alias("evidence"), (factors if factors is not None else F.expr(_NO_FACTORS)).alias("factors"))


def _total(prefix: str, *types: str) -> Column:
    return add([F.coalesce(F.col(f"{prefix}_{t}"), F.lit(0)) for t in types])


def _conf(expected: int, present: Column, *types: str) -> Column:
    return confidence(expected, present, _total("c", *types), _total("n", *types))


def context_switch_rate(cat: Catalog) -> DataFrame:
    w = cat.windows.filter("n_ctx > 0")
    return _emit(w, F.col("switches") / 15.0, _conf(1, F.lit(1), "ctx"), ids("i_ctx"))


def _rate() -> Column:
    return F.when(F.col("n_ctx") > 0, F.col("switches") / 15.0)


def focus_score(cat: Catalog) -> DataFrame:
    rate, ms = F.col("rate"), F.col("rmssd")
    typing = F.when(rate <= 0, 50.0).otherwise(F.least(rate / 80, F.lit(1.0)) * 50 + 50)
    calm = clamp(F.when(ms <= 0, 0.0).when(ms <= 45, ms / 45 * 100).otherwise((1 - (ms - 45) / 75) * 100))
    p = Parts(("typing", 0.25, F.when(rate.isNotNull(), typing)), ("stability", 0.5, switch_stability(_rate())), ("hrv", 0.25, F.when(ms.isNotNull(), calm)))
    w = cat.windows.filter(p.present() > 0)
    return _emit(w, clamp(p.value()), _conf(3, p.present(), "key", "hrv", "ctx"), ids("i_key", "i_hrv", "i_ctx"), p.factors())


def stress_index(cat: Catalog) -> DataFrame:
    p = Parts(("rmssd", 1, fall(F.col("rmssd"), 15, 70)), ("pnn50", 1, F.lit(100.0) - clamp(F.col("pnn50"))))
    w = cat.windows.filter(p.present() > 0)
    return _emit(w, clamp(p.value()), _conf(1, F.lit(1), "hrv"), ids("i_hrv"))


def high_stress(cat: Catalog) -> DataFrame:
    """Signals: runs of stress over 75 at ends exactly 60 s apart, longer than 300 s."""
    rows = cat["stress_index"].filter("value > 75").select("subject_id", "w_end", "confidence")
    runs = panes.merged_runs(rows, ["subject_id"], "w_end", lambda before, at: at - before == 60, 60, {"samples": (F.count("*"), F.sum("samples"))})
    runs = runs.withColumnsRenamed({"run_start": "start_ts", "run_end": "end_ts"}).filter("end_ts - start_ts > 300")
    sid = F.sha2(F.concat_ws("|", F.lit("high_stress"), "subject_id", F.col("start_ts").cast("string"), F.col("end_ts").cast("string")), 256)
    return runs.select(sid.alias("signal_id"), "subject_id", F.lit("high_stress").alias("signal_type"), "start_ts", "end_ts", "samples", F.lit("high").alias("severity"))


def fatigue_index(cat: Catalog) -> DataFrame:
    """Emits for every end once desk activity has begun."""
    desk = cat.obs.filter(F.col("data_type").isin(S.KEYSTROKES, S.CONTEXT))
    minutes = desk.groupBy("subject_id", F.floor(F.col("ts") / 60).alias("minute")).agg(F.min("ts").alias("at"))
    marks = minutes.select("subject_id", "at", F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("w_end"))
    points = marks.unionByName(cat.ends.select("subject_id", F.col("w_end").alias("at"), F.lit(0).alias("one"), "w_end")).withColumn("chunk", panes.day_of(F.col("at")))
    active = panes.carried(points, "one", ["at", F.desc("one")], "minutes").filter("w_end is not null").select("subject_id", "w_end", "minutes")
    focus = cat["focus_score"].select("subject_id", "w_end", F.col("value").alias("focus"), F.col("confidence").alias("focus_conf"))
    w = cat.windows.select("subject_id", "w_end", "bpm", *[f"{p}_{t}" for t in ("key", "hr", "ctx") for p in "nci"])
    rows = cat.with_early_bpm(active.join(w, ["subject_id", "w_end"], "left").join(focus, ["subject_id", "w_end"], "left"), 900)
    load = clamp(F.col("minutes") / 480.0 * 100)
    busy = (load > 0) | (_total("n", "key", "ctx") > 0)
    p = Parts(("low_focus", 0.5, clamp(F.lit(100.0) - F.col("focus"))), ("active", 0.3, F.when(busy, load)), ("heart_rate", 0.2, clamp((F.col("bpm") - F.col("base")) / 20.0 * 100)))
    rows = rows.filter(p.present() > 0)
    from_rows = _conf(3, p.present(), "key", "hr", "ctx")
    conf = F.when(_total("n", "key", "hr", "ctx") > 0, from_rows).otherwise(clamp(F.coalesce("focus_conf", F.lit(0.0)) * p.present() / 3, 0.0, 1.0))
    none = F.expr("cast(array() as array<string>)")
    evidence = F.array_sort(F.concat(*[F.coalesce(f"i_{t}", none) for t in ("key", "hr", "ctx")]))
    return _emit(rows, clamp(p.value()), conf, evidence)


def meeting_density(cat: Catalog) -> DataFrame:
    """Share of the window that meetings fill; intervals that touch are merged by
    a running maximum, so that overlaps count once.  Meetings are gathered by
    blocks of ends, where each end picks those that touch its window."""
    c, end, block = F.col, F.col("w_end"), 4 * W.WINDOW
    items = cat.meetings.withColumns({"low": c("start_s"), "high": c("end_s") + W.WINDOW})
    lists = panes.in_blocks(items, block).groupBy("subject_id", "block").agg(F.sort_array(F.collect_list(F.struct("id", "start_s", "end_s", "confidence"))).alias("items"))
    rows = W.at_ends(lists, cat.meeting_bounds, c("block") * block, (c("block") + 1) * block - 1, cat.step)
    rows = rows.withColumn("own", F.filter("items", lambda x: (x["start_s"] <= end) & (x["end_s"] + W.WINDOW >= end))).filter(F.size("own") > 0)
    within = F.sort_array(F.transform("own", lambda x: F.struct(F.greatest(x["start_s"], end - W.WINDOW).alias("low"), F.least(x["end_s"], end).alias("high"))))
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")

    def merge(acc: Column, x: Column) -> Column:
        added = F.greatest(zero, x["high"] - F.greatest(x["low"], F.coalesce(acc["covered"], x["low"])))
        return F.struct(F.greatest(acc["covered"], x["high"]).alias("covered"), (acc["filled"] + added).alias("filled"))

    filled = F.aggregate(within, F.struct(none.alias("covered"), zero.alias("filled")), merge, lambda acc: acc["filled"])
    known = F.filter(c("own")["confidence"], lambda x: x.isNotNull())
    conf = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x) / F.size(known))
    return _emit(rows, clamp(filled / float(W.WINDOW), 0.0, 1.0), conf, c("own")["id"])


def meeting_recovery(cat: Catalog) -> DataFrame:
    """Mean minutes of the gaps between consecutive meetings that touch the window."""
    order = Window.partitionBy("subject_id").orderBy("start_s", "end_s", "id")
    gaps = cat.meetings.withColumn("next", F.lead(F.struct("start_s", "id", "confidence")).over(order)).filter(F.col("next.start_s") > F.col("end_s"))
    gaps = gaps.select("subject_id", F.col("end_s").alias("gap_start"), F.col("next.start_s").alias("gap_end"), F.array(F.struct("id", "confidence"), F.struct(F.col("next.id").alias("id"), F.col("next.confidence").alias("confidence"))).alias("sides"))
    touch = W.at_ends(gaps, cat.meeting_bounds, F.col("gap_start"), F.col("gap_end") + W.WINDOW, cat.step)
    rows = touch.groupBy("subject_id", "w_end").agg(F.avg((F.col("gap_end") - F.col("gap_start")) / 60.0).alias("minutes"), F.array_distinct(F.flatten(F.collect_list("sides"))).alias("sides"))
    conf = F.aggregate("sides", F.lit(0.0), lambda acc, s: acc + s["confidence"]) / F.size("sides")
    return _emit(rows, F.col("minutes"), clamp(conf, 0.0, 1.0), F.array_sort("sides.id"))


def recovery_score(cat: Catalog) -> DataFrame:
    rows = cat.with_early_bpm(cat.windows.filter("rmssd is not null"), 900)
    strain = clamp(F.greatest(F.col("bpm") - F.col("base"), F.lit(0.0)) / 20.0 * 100)
    p = Parts(("hrv", 0.7, F.lit(100.0) - fall(F.col("rmssd"), 15, 70)), ("heart_rate", 0.3, F.when(F.col("bpm").isNotNull(), F.lit(100.0) - strain)))
    return _emit(rows, clamp(p.value()), _conf(2, p.present(), "hrv", "hr"), ids("i_hrv", "i_hr"), p.factors())


def distraction_score(cat: Catalog) -> DataFrame:
    rows = cat.windows.filter("category_weight is not null")
    p = Parts(("browser_mix", 0.55, F.col("category_weight")), ("category_churn", 0.25, F.least(F.lit(100.0), F.col("churn") * 25.0)), ("app_switches", 0.2, switch_load(_rate())))
    slots = F.when(F.col("n_ctx") > 0, 2).otherwise(1)
    return _emit(rows, clamp(p.value()), _conf(2, slots, "brw"), ids("i_brw"), p.factors())


def media_share(cat: Catalog) -> DataFrame:
    rows = cat.windows.filter("n_med_known > 0")
    playing = [(k, F.col(f"med_{k}")) for k in PLAYING_KINDS]
    value = add([F.coalesce(x, F.lit(0.0)) for _, x in playing]) * 100 / F.col("n_med")
    return _emit(rows, clamp(value), _conf(1, F.lit(1), "med"), ids("i_med"), shares(*playing))


def git_rate(cat: Catalog) -> DataFrame:
    rows = cat.windows.filter("n_git_ok > 0")
    kinds = [(k, F.col(f"git_{k}")) for k in COUNTED_GIT]
    return _emit(rows, add([F.coalesce(x, F.lit(0.0)) for _, x in kinds]), _conf(1, F.lit(1), "git_ok"), ids("i_git_ok"), shares(*kinds))


def light_share(cat: Catalog) -> DataFrame:
    kinds = [(k, F.col(f"lig_{k}")) for k in KNOWN_LIGHT]
    known = add([F.coalesce(x, F.lit(0.0)) for _, x in kinds])
    rows = cat.windows.filter(known > 0)
    return _emit(rows, clamp(known * 100 / F.col("n_lig")), _conf(1, F.lit(1), "lig"), ids("i_lig"), shares(*kinds))


def activity_balance(cat: Catalog) -> DataFrame:
    rows = cat.windows.filter("n_stp > 0")
    steps = clamp(F.coalesce("steps", F.lit(0)) * 100.0 / 750)
    workout = F.col("n_workout") > 0
    value = F.when(workout, F.greatest(steps, F.lit(70.0)) * 0.85 + 15.0).otherwise(steps)
    p = Parts(("step_count", 0.85, F.lit(1.0)), ("workout", 0.15, F.when(workout, 1.0)))
    return _emit(rows, clamp(value), _conf(2, p.present(), "stp", "workout"), ids("i_stp", "i_workout"), p.factors())


def energy_score(cat: Catalog) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    w = cat.windows.select("subject_id", "w_end", "bpm", "kcal", *[f"{p}_{t}" for t in ("nrg", "hr") for p in "nci"])
    rows = cat.with_early_bpm(w.join(cat.rest_sums(REST_STAGES), ["subject_id", "w_end"], "full"), 300)
    rise = clamp(F.greatest(F.col("bpm") - F.col("base"), F.lit(0.0)) / 25.0 * 100)
    p = Parts(("active_energy", 0.45, clamp(F.col("kcal") * 100.0 / 80)), ("sleep_interval", 0.35, clamp(F.col("rest") * 100.0 / TARGET_REST)), ("heart_rate", 0.2, F.when(F.col("bpm").isNotNull(), F.lit(100.0) - rise)))
    rows = cat.listed(rows.filter(p.present() > 0), cat.rest_items(REST_STAGES), {"i_rest": F.lit(True)})
    evidence = F.sort_array(F.concat(*[F.coalesce(c, none) for c in ("i_nrg", "i_rest", "i_hr")]))
    return _emit(rows, clamp(p.value()), _conf(3, p.present(), "nrg", "rest", "hr"), evidence, p.factors())


def sleep_debt(cat: Catalog) -> DataFrame:
    rows = cat.rest(ALL_REST)
    short = clamp((F.lit(float(TARGET_REST)) - F.col("rest")) / TARGET_REST, 0.0, 1.0)
    return _emit(rows, short * 100, _conf(1, F.lit(1), "rest"), ids("i_rest"), shares(("rest", 1 - short), ("shortfall", short)))


def notification_pressure(cat: Catalog) -> DataFrame:
    rows = cat.windows.filter("n_ntf_ok > 0")

    def by(prefix: str, kinds: tuple[str, ...]) -> Column:
        return shares(*[(k, F.col(f"{prefix}_{k}")) for k in kinds])

    options = [by("ntf", S.NOTIFICATION_CATEGORIES), by("int", S.INTERRUPTION_LEVELS), by("app", S.APP_KINDS)]
    factors = F.when(F.size(options[0]) > 0, options[0]).when(F.size(options[1]) > 0, options[1]).otherwise(options[2])
    return _emit(rows, clamp(F.col("ntf_total") * 100.0 / 20), _conf(1, F.lit(1), "ntf_ok"), ids("i_ntf_ok"), factors)


def _joined(cat: Catalog, how: str, *names: str) -> DataFrame:
    """Features side by side on their exact window end."""
    out = None
    for n in names:
        side = cat[n].select("subject_id", "w_end", *[F.col(c).alias(f"{n}_{c}") for c in ("value", "confidence", "evidence")])
        out = side if out is None else out.join(side, ["subject_id", "w_end"], how)
    return out


def _evidence(*names: str) -> Column:
    none = F.expr("cast(array() as array<string>)")
    return F.array_sort(F.concat(*[F.coalesce(f"{n}_evidence", none) for n in names]))


def _slot_confidence(expected: int, *names: str) -> Column:
    columns = [F.col(f"{n}_confidence") for n in names]
    present = add([F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    return confidence(expected, present, add([F.coalesce(c, F.lit(0.0)) for c in columns]), present)


def cognitive_load(cat: Catalog) -> DataFrame:
    names = ("meeting_density", "context_switch_rate", "notification_pressure")
    rows = _joined(cat, "full", *names)
    p = Parts(("meetings", 1, clamp(F.col("meeting_density_value") * 100)), ("switches", 1, switch_load(F.col("context_switch_rate_value"))), ("notifications", 1, F.col("notification_pressure_value")))
    return _emit(rows, clamp(p.value()), _slot_confidence(3, *names), _evidence(*names), p.factors())


def deep_work_score(cat: Catalog) -> DataFrame:
    names = ("focus_score", "context_switch_rate")
    rows = _joined(cat, "left", *names)
    p = Parts(("focus", 0.6, F.col("focus_score_value")), ("stability", 0.4, switch_stability(F.col("context_switch_rate_value"))))
    return _emit(rows, clamp(p.value()), _slot_confidence(2, *names), _evidence(*names), p.factors())


def attention_stability(cat: Catalog) -> DataFrame:
    rows = _joined(cat, "left", "focus_score", "context_switch_rate")
    focus = F.col("focus_score_value")
    rows = panes.looking_back(rows, W.WINDOW, {"highest": F.max(focus), "lowest": F.min(focus), "focus_conf": F.avg("focus_score_confidence"), "lists": F.collect_list("focus_score_evidence")})
    rows = rows.withColumn("spread", F.col("highest") - F.col("lowest")).withColumn("focus_evidence", F.flatten("lists"))
    p = Parts(("focus_stability", 0.5, clamp(F.lit(100.0) - F.col("spread"))), ("switch_stability", 0.5, switch_stability(F.col("context_switch_rate_value"))))
    slots = F.col("focus_conf") + F.coalesce("context_switch_rate_confidence", F.lit(0.0))
    evidence = F.array_sort(F.array_distinct(F.concat("focus_evidence", F.coalesce("context_switch_rate_evidence", F.expr("cast(array() as array<string>)")))))
    return _emit(rows, clamp(p.value()), confidence(2, p.present(), slots, p.present()), evidence, p.factors())


def desk_away(cat: Catalog) -> DataFrame:
    rows = cat.windows
    steps = F.coalesce("steps", F.lit(0))
    walk, moved = F.col("n_walk") > 0, steps >= 40
    typing, still = F.coalesce("typing", F.lit(False)), F.col("bundles") <= 1
    rows = rows.filter((walk | moved) & ~(typing & ~walk & (steps < 80)))
    counted = moved | (walk & (steps > 0))
    quiet = F.when(~typing, 0.15).otherwise(0.0) + F.when(still, 0.10).otherwise(0.0)
    p = Parts(("walk_event", 0.4, F.when(walk, 100.0)), ("steps", 0.35, F.when(counted, clamp(steps * 100.0 / 250))), ("input_quiet", quiet, F.when(quiet > 0, 100.0)))

    def used(prefix: str, zero: Column) -> list[Column]:
        flags = (("walk", walk), ("stp", counted), ("key", ~typing), ("ctx", still))
        return [F.when(on, F.coalesce(F.col(f"{prefix}_{t}"), zero)).otherwise(zero) for t, on in flags]

    none = F.expr("cast(array() as array<string>)")
    conf = confidence(3, p.present(), add(used("c", F.lit(0.0))), add(used("n", F.lit(0))))
    return _emit(rows, clamp(p.value()), conf, F.array_sort(F.array_distinct(F.concat(*used("i", none)))), p.factors())


def circadian_offset(cat: Catalog) -> DataFrame:
    """Sums follow what enters and leaves, by steps of the grid; ids are listed last."""
    c = F.col
    kind = c("data_type")
    desk = F.when((kind == S.KEYSTROKES) & ((c("rate_per_min") > 0) | (c("key_count") > 0)), F.greatest(F.coalesce("key_count", F.lit(1)), F.lit(1)).cast("double")).when(kind == S.CONTEXT, 1.0)
    moves = F.when((kind == S.STEPS) & (c("steps") > 0), c("steps").cast("double")).when((kind == S.ENERGY) & (c("kcal") > 0), c("kcal")).when((kind == S.LIFE_EVENT) & (c("life_kind") == "workout"), 1.0)
    timed = cat.obs.select("subject_id", "id", "ts", "confidence", desk.alias("desk"), moves.alias("move")).filter("desk is not null or move is not null")
    rows = panes.by_day(timed, c("ts"), c("ts") + W.DAY)
    # seconds from the day before: their sums stay exact
    at = c("ts") - (c("chunk") - 1) * W.DAY
    sums = {}
    for x in ("desk", "move"):
        there = c(x).isNotNull()
        sums |= {f"w_{x}": c(x), f"t_{x}": c(x) * at, f"n_{x}": F.when(there, F.lit(1).cast("bigint")), f"c_{x}": F.when(there, c("confidence"))}
    events = F.array(*[F.struct(F.lit(sign).alias("sign"), (c("ts") + after).alias("at")) for sign, after in ((1, 0), (-1, W.DAY + 1))])
    events = rows.select("subject_id", "chunk", *[v.alias(k) for k, v in sums.items()], F.explode(events).alias("e"))
    # the first end that the event is in; past the aligned ones, its own second
    edge = (F.ceil(c("e.at") / cat.step) * cat.step).cast("bigint")
    events = events.join(cat.by_days(cat.bounds.select("subject_id", "last_end")), ["subject_id", "chunk"]).withColumn("at", F.when(edge <= c("last_end"), edge).otherwise(c("e.at")))
    events = events.groupBy("subject_id", "chunk", "at").agg(*[F.sum(c(n) * c("e.sign")).alias(n) for n in sums])
    rows = panes.running(events, cat.ends, {f"r_{n}": F.sum(n) for n in sums})
    rows = rows.withColumnsRenamed({f"r_{n}": n for n in sums}).filter("n_desk > 0 or n_move > 0")
    for x in ("desk", "move"):
        rows = rows.withColumns({f"{k}_{x}": F.when(c(f"n_{x}") > 0, c(f"{k}_{x}")) for k in "wt"})
    rows = rows.join(cat.rest_sums(REST_STAGES), ["subject_id", "w_end"])
    rows = rows.withColumn("by_desk", F.coalesce("w_desk", F.lit(0.0)) > 0)
    by_desk = c("by_desk")
    asleep = cat.rest_items(REST_STAGES).select("*", F.lit(True).alias("asleep"), F.lit(False).alias("desk"), F.lit(False).alias("move"))
    items = asleep.unionByName(timed.select("subject_id", "id", c("ts").alias("low"), (c("ts") + W.DAY).alias("high"), F.lit(False).alias("asleep"), c("desk").isNotNull().alias("desk"), c("move").isNotNull().alias("move")))
    rows = cat.listed(rows, items, {"i_desk": c("asleep") | c("desk"), "i_move": c("asleep") | c("move")}, distinct=True)
    first = (panes.day_of(c("w_end")) - 1) * W.DAY
    work = first + F.when(by_desk, F.round(c("t_desk") / c("w_desk"))).otherwise(F.round(c("t_move") / c("w_move"))).cast("bigint")
    mid = c("low") + F.floor((c("high") - c("low")) / 2)
    off = F.pmod(work - (mid + W.DAY // 2), F.lit(W.DAY))
    hours = F.when(off > W.DAY // 2, F.lit(W.DAY) - off).otherwise(off) / 3600.0

    def pick(prefix: str) -> Column:
        return F.when(by_desk, c(f"{prefix}_desk")).otherwise(c(f"{prefix}_move"))

    conf = confidence(2, F.lit(2), c("c_rest") + pick("c"), c("n_rest") + pick("n"))
    factors = shares(("sleep", F.lit(0.5)), ("work", F.when(by_desk, 0.5)), ("activity", F.when(~by_desk, 0.5)))
    return _emit(rows, clamp((1 - hours / 6.0) * 100), conf, pick("i"), factors)


def sustained_load(cat: Catalog) -> DataFrame:
    names = ("stress_index", "fatigue_index", "meeting_density")
    rows = _joined(cat, "full", *names)
    means = {f"m_{n}": F.avg(f"{n}_value") for n in names}
    slots = {f"c_{n}": F.sum(f"{n}_confidence") for n in names} | {f"n_{n}": F.count(f"{n}_confidence") for n in names}
    rows = panes.looking_back(rows, 14400, means | slots)
    rows = rows.filter("stress_index_value is not null or fatigue_index_value is not null")
    p = Parts(("stress", 0.4, clamp(F.col("m_stress_index"))), ("fatigue", 0.4, clamp(F.col("m_fatigue_index"))), ("meetings", 0.2, clamp(F.col("m_meeting_density") * 100)))
    return _emit(rows, clamp(p.value()), confidence(3, p.present(), _total("c", *names), _total("n", *names)), _evidence(*names), p.factors())


#: Registration order; composites after what they depend on.
FEATURES: dict[str, Callable[[Catalog], DataFrame]] = {
    f.__name__: f
    for f in (
        context_switch_rate, focus_score, stress_index, fatigue_index, meeting_density, meeting_recovery, recovery_score,
        distraction_score, media_share, git_rate, light_share, activity_balance, energy_score, sleep_debt,
        notification_pressure, cognitive_load, deep_work_score, attention_stability, desk_away, circadian_offset, sustained_load,
    )
}
