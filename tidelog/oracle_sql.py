"""The registered queries again as SQL for another engine, written from the
definitions: range joins and window-local ordering where the plans explode and
pre-order."""

from __future__ import annotations

from tidelog import schema as S
from tidelog.plans import features as P
from tidelog.sources import events as E

#: The default grid; None: a subject's whole history instead of its latest ends.
STEP, MOST = 60, None


def _ends(bounds: str, step: int, most: int | None) -> str:
    fewer = f"CASE WHEN first_end <= last_end THEN (last_end - first_end) // {step} + 1 ELSE 0 END < {most}" if most else "true"
    return f"""SELECT subject_id, min_ts, unnest(generate_series(first_end, last_end, {step})) AS w_end FROM {bounds}
      UNION ALL SELECT subject_id, min_ts, max_ts FROM {bounds}
      WHERE last_end < max_ts AND {fewer}"""


def _bounds(span: str, step: int, most: int | None) -> str:
    first = f"CAST(ceil(min_ts / {step}) AS bigint) * {step}"
    first = f"greatest({first}, (max_ts // {step}) * {step} - {most - 1} * {step})" if most else first
    return f"SELECT *, (max_ts // {step}) * {step} AS last_end, {first} AS first_end FROM {span}"


def _buckets(rows: str, end: str, seconds: int) -> str:
    """Rows with the buckets that a look back over so many seconds touches."""
    return f"(SELECT *, unnest([{end} // {seconds}, {end} // {seconds} - 1]) AS bucket FROM {rows})"


def _typed() -> str:
    columns = ",\n      ".join(f"{sql} AS {name}" for name, sql in E.projection())
    return f"""keyed0 AS (SELECT lpad(CAST(event_id AS varchar), 12, '0') AS id, CAST(floor(epoch(ts)) AS bigint) AS t,
      CAST(json_extract_string(props, '$.k') AS bigint) AS k, user_id AS u, event_type, value FROM events),
    keyed1 AS (SELECT *, k % 4 AS r, k // 4 AS q FROM keyed0),
    keyed AS (SELECT *, {E.DATA_TYPE} AS data_type FROM keyed1),
    typed AS (SELECT {columns} FROM keyed)"""


def _base(step: int = STEP, chosen: str = "SELECT * FROM typed", most: int | None = 1440) -> str:
    return f"""{_typed()},
    obs AS ({chosen}),
    span AS (SELECT subject_id, min(ts) AS min_ts, max(ts) AS max_ts FROM obs GROUP BY 1),
    b AS ({_bounds("span", step, most)}),
    ends AS ({_ends("b", step, most)}),
    mem AS (SELECT o.*, e.w_end FROM obs o JOIN {_buckets("ends", "w_end", 900)} e ON o.subject_id = e.subject_id AND o.ts // 900 = e.bucket AND o.ts BETWEEN e.w_end - 900 AND e.w_end),
    lagged AS (SELECT *, lag(label) OVER (PARTITION BY subject_id, w_end, data_type ORDER BY ts, id) AS prev
      FROM (SELECT subject_id, w_end, data_type, ts, id, coalesce(bundle_id, category) AS label FROM mem WHERE data_type IN ('{S.CONTEXT}', '{S.BROWSER}')) WHERE label IS NOT NULL),
    moves AS (SELECT subject_id, w_end, count(*) FILTER (data_type = '{S.CONTEXT}' AND label <> prev) AS switches,
      count(*) FILTER (data_type = '{S.BROWSER}' AND label <> prev) AS churn FROM lagged GROUP BY 1, 2),
    w0 AS (SELECT subject_id, w_end, {_aggregates()} FROM mem GROUP BY 1, 2),
    w AS (SELECT w0.*, coalesce(switches, 0) AS switches, coalesce(churn, 0) AS churn,
      CASE WHEN n_ctx > 0 THEN coalesce(switches, 0) / 15.0e0 END AS csr FROM w0 LEFT JOIN moves USING (subject_id, w_end)),
    first15 AS (SELECT s.subject_id, coalesce(avg(bpm) FILTER (o.ts <= min_ts + 900), 60) AS base FROM span s LEFT JOIN obs o ON o.subject_id = s.subject_id AND data_type = '{S.HEART_RATE}' AND bpm > 0 GROUP BY 1),
    first5 AS (SELECT s.subject_id, coalesce(avg(bpm) FILTER (o.ts <= min_ts + 300), 60) AS base FROM span s LEFT JOIN obs o ON o.subject_id = s.subject_id AND data_type = '{S.HEART_RATE}' AND bpm > 0 GROUP BY 1)"""


def _group(short: str, cond: str) -> str:
    return f"count(*) FILTER ({cond}) AS n_{short}, coalesce(sum(confidence) FILTER ({cond}), 0) AS c_{short}, coalesce(list(id) FILTER ({cond}), []) AS i_{short}"


def _aggregates() -> str:
    out = [_group(k, f"data_type = '{v}'") for k, v in P.TYPES.items()]
    out += [_group("git_ok", f"activity_kind IN {P.COUNTED_GIT}"), _group("ntf_ok", "notif_count >= 1"), _group("walk", "life_kind = 'walk'"), _group("workout", "life_kind = 'workout'")]
    out += [f"sum(CASE WHEN is_playing AND media_kind = '{k}' THEN 1 END) AS med_{k}" for k in P.PLAYING_KINDS]
    out += [f"sum(CASE WHEN activity_kind = '{k}' THEN coalesce(event_count, 1) END) AS git_{k}" for k in P.COUNTED_GIT]
    out += [f"sum(CASE WHEN light_kind = '{k}' THEN 1 END) AS lig_{k}" for k in P.KNOWN_LIGHT]
    out += [f"sum(CASE WHEN notif_category = '{k}' THEN notif_count END) AS ntf_{k}" for k in S.NOTIFICATION_CATEGORIES]
    weights = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in P.CATEGORY_WEIGHTS.items())
    out += [
        f"count(DISTINCT bundle_id) AS bundles, avg(CASE category {weights} END) AS category_weight, avg(rate_per_min) AS rate",
        "coalesce(bool_or(rate_per_min >= 30), false) AS typing, avg(rmssd_ms) AS rmssd, avg(pnn50) AS pnn50",
        f"avg(bpm) FILTER (data_type = '{S.HEART_RATE}' AND bpm > 0) AS bpm, sum(steps) AS steps, sum(kcal) FILTER (kcal >= 0) AS kcal",
        f"sum(notif_count) FILTER (notif_count >= 1) AS ntf_total, count(*) FILTER (media_kind IN {P.PLAYING_KINDS}) AS n_med_known",
    ]
    return ",\n      ".join(out)


def _clamp(x: str, high: str = "100.0e0") -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0e0, least({high}, {x})) END"


def _load(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN 100 * (1 - exp(-({x}) / 1.5e0)) WHEN ({x}) IS NOT NULL THEN 0.0e0 END"


def _calm(x: str) -> str:
    return f"(100.0e0 - ({_load(x)}))"


class _Parts:
    def __init__(self, *parts: tuple[str, str, str]):
        self.parts = parts
        self.weight = " + ".join(f"CASE WHEN ({s}) IS NOT NULL THEN {w} ELSE 0 END" for _, w, s in parts)
        self.present = "(" + " + ".join(f"CASE WHEN ({s}) IS NOT NULL THEN 1 ELSE 0 END" for _, _, s in parts) + ")"
        self.value = "((" + " + ".join(f"coalesce({w} * ({s}), 0)" for _, w, s in parts) + f") / nullif({self.weight}, 0))"
        self.factors = _shares(*[(n, f"CASE WHEN ({s}) IS NOT NULL THEN {w} END") for n, w, s in parts])


def _shares(*parts: tuple[str, str]) -> str:
    total = "(" + " + ".join(f"coalesce({x}, 0)" for _, x in parts) + ")"
    return "concat_ws(',', " + ", ".join(f"CASE WHEN ({x}) > 0 THEN '{n}=' || CAST(CAST(round(10000 * ({x}) / {total}) AS bigint) AS varchar) END" for n, x in parts) + ")"


def _conf(expected: int, present: str, *types: str) -> str:
    c, n = " + ".join(f"coalesce(c_{t}, 0)" for t in types), " + ".join(f"coalesce(n_{t}, 0)" for t in types)
    return f"least(1.0e0, least({present}, {expected}) / {expected}.0e0 * coalesce(({c}) / nullif({n}, 0), 0))"


def _ids(*lists: str) -> str:
    out = f"coalesce({lists[0]}, [])"
    for x in lists[1:]:
        out = f"list_concat({out}, coalesce({x}, []))"
    return f"list_sort({out})"


def _feature(source: str, value: str, conf: str, ids: str, factors: str = "''") -> str:
    return f"SELECT subject_id, w_end, {value} AS value, {conf} AS confidence, {ids} AS evidence, {factors} AS factors FROM {source}"


def _rest(stages: tuple[str, ...]) -> str:
    return f"""(SELECT e.subject_id, e.w_end, sum(least(end_s, w_end) - greatest(start_s, w_end - 86400)) AS rest, min(greatest(start_s, w_end - 86400)) AS low,
      max(least(end_s, w_end)) AS high, count(*) AS n_rest, sum(confidence) AS c_rest, list(id) AS i_rest
      FROM obs o JOIN ends e ON o.subject_id = e.subject_id AND o.start_s < e.w_end AND o.end_s > e.w_end - 86400
      WHERE data_type = '{S.SLEEP}' AND (stage IS NULL OR stage IN {stages}) AND end_s > start_s GROUP BY 1, 2)"""


def _slots(expected: int, *names: str) -> str:
    n = "(" + " + ".join(f"CASE WHEN {x}.confidence IS NOT NULL THEN 1 ELSE 0 END" for x in names) + ")"
    c = "(" + " + ".join(f"coalesce({x}.confidence, 0)" for x in names) + ")"
    return f"least(1.0e0, {n} / {expected}.0e0 * coalesce({c} / nullif({n}, 0), 0))"


def feature_ctes(step: int = STEP, chosen: str = "SELECT * FROM typed", most: int | None = 1440) -> str:
    """All features as named tables on top of the base tables."""
    focus = _Parts(
        ("typing", "0.25e0", "CASE WHEN rate <= 0 THEN 50.0e0 WHEN rate IS NOT NULL THEN 50 + 50 * least(rate / 80, 1.0e0) END"),
        ("stability", "0.5e0", _calm("csr")),
        ("hrv", "0.25e0", "CASE WHEN rmssd <= 0 THEN 0.0e0 WHEN rmssd <= 45 THEN rmssd / 45 * 100 WHEN rmssd IS NOT NULL THEN greatest(0.0e0, least(100.0e0, 100 * (1 - (rmssd - 45) / 75))) END"),
    )
    stress = _Parts(("rmssd", "1", _clamp("100 * (70 - rmssd) / 55")), ("pnn50", "1", f"100.0e0 - ({_clamp('pnn50')})"))
    load = _clamp("minutes / 480.0e0 * 100")
    fatigue = _Parts(("low_focus", "0.5e0", "100.0e0 - f.value"), ("active", "0.3e0", f"CASE WHEN minutes > 0 OR coalesce(n_key, 0) + coalesce(n_ctx, 0) > 0 THEN {load} END"), ("heart_rate", "0.2e0", _clamp("(bpm - base) / 20.0e0 * 100")))
    recovery = _Parts(("hrv", "0.7e0", f"100.0e0 - ({_clamp('100 * (70 - rmssd) / 55')})"), ("heart_rate", "0.3e0", f"100.0e0 - ({_clamp('greatest(bpm - base, 0) / 20.0e0 * 100')})".replace("greatest(bpm - base, 0)", "CASE WHEN bpm IS NOT NULL THEN greatest(bpm - base, 0) END")))
    distraction = _Parts(("browser_mix", "0.55e0", "category_weight"), ("category_churn", "0.25e0", "least(100.0e0, 25.0e0 * churn)"), ("app_switches", "0.2e0", _load("csr")))
    steps = _clamp("100.0e0 * coalesce(steps, 0) / 750")
    balance = _Parts(("step_count", "0.85e0", "1"), ("workout", "0.15e0", "CASE WHEN n_workout > 0 THEN 1 END"))
    energy = _Parts(("active_energy", "0.45e0", _clamp("kcal * 100.0e0 / 80")), ("sleep_interval", "0.35e0", _clamp("rest * 100.0e0 / 28800")), ("heart_rate", "0.2e0", "CASE WHEN bpm IS NOT NULL THEN 100.0e0 - greatest(0.0e0, least(100.0e0, greatest(bpm - base, 0) / 25.0e0 * 100)) END"))
    short = "greatest(0.0e0, least(1.0e0, (28800.0e0 - rest) / 28800))"
    cognitive = _Parts(("meetings", "1", "m.value * 100"), ("switches", "1", _load("c.value")), ("notifications", "1", "n.value"))
    deep = _Parts(("focus", "0.6e0", "f.value"), ("stability", "0.4e0", _calm("c.value")))
    attention = _Parts(("focus_stability", "0.5e0", "100.0e0 - spread"), ("switch_stability", "0.5e0", _calm("c.value")))
    counted = "(coalesce(steps, 0) >= 40 OR (n_walk > 0 AND coalesce(steps, 0) > 0))"
    quiet = "(CASE WHEN typing THEN 0 ELSE 0.15e0 END + CASE WHEN bundles <= 1 THEN 0.1e0 ELSE 0 END)"
    away = _Parts(("walk_event", "0.4e0", "CASE WHEN n_walk > 0 THEN 100.0e0 END"), ("steps", "0.35e0", f"CASE WHEN {counted} THEN least(100.0e0, coalesce(steps, 0) * 100.0e0 / 250) END"), ("input_quiet", quiet, f"CASE WHEN {quiet} > 0 THEN 100.0e0 END"))

    def used(p: str, none: str) -> list[str]:
        return [f"CASE WHEN n_walk > 0 THEN {p}_walk ELSE {none} END", f"CASE WHEN {counted} THEN {p}_stp ELSE {none} END", f"CASE WHEN NOT typing THEN {p}_key ELSE {none} END", f"CASE WHEN bundles <= 1 THEN {p}_ctx ELSE {none} END"]

    away_conf = f"least(1.0e0, {away.present} / 3.0e0 * coalesce(({' + '.join(used('c', '0'))}) / nullif({' + '.join(used('n', '0'))}, 0), 0))"
    sustained = _Parts(("stress", "0.4e0", "sm"), ("fatigue", "0.4e0", "fm"), ("meetings", "0.2e0", "mm * 100"))
    key = "subject_id, w_end"
    return f"""{_base(step, chosen, most)},
    context_switch_rate AS ({_feature("w WHERE n_ctx > 0", "csr", _conf(1, "1", "ctx"), _ids("i_ctx"))}),
    focus_score AS ({_feature(f"w WHERE {focus.present} > 0", focus.value, _conf(3, focus.present, "key", "hrv", "ctx"), _ids("i_key", "i_hrv", "i_ctx"), focus.factors)}),
    stress_index AS ({_feature(f"w WHERE {stress.present} > 0", stress.value, _conf(1, "1", "hrv"), _ids("i_hrv"))}),
    minute0 AS (SELECT subject_id, ts // 60 AS minute, min(ts) AS at FROM obs WHERE data_type IN ('{S.KEYSTROKES}', '{S.CONTEXT}') GROUP BY 1, 2),
    active AS (SELECT e.subject_id, e.w_end, count(m.at) AS minutes FROM ends e LEFT JOIN minute0 m ON m.subject_id = e.subject_id AND m.at <= e.w_end GROUP BY 1, 2),
    fatigue_index AS (SELECT * FROM (SELECT a.subject_id, a.w_end, {_clamp(fatigue.value)} AS value,
      CASE WHEN coalesce(n_key, 0) + coalesce(n_hr, 0) + coalesce(n_ctx, 0) > 0 THEN {_conf(3, fatigue.present, "key", "hr", "ctx")} ELSE coalesce(f.confidence, 0) * {fatigue.present} / 3.0e0 END AS confidence,
      {_ids("i_key", "i_hr", "i_ctx")} AS evidence, '' AS factors
      FROM active a LEFT JOIN w USING ({key}) LEFT JOIN focus_score f USING ({key}) JOIN first15 USING (subject_id)) WHERE value IS NOT NULL),
    mtg AS (SELECT subject_id, id, start_s, end_s, confidence FROM obs WHERE data_type = '{S.CALENDAR}' AND NOT coalesce(all_day, false) AND coalesce(busy, true)),
    mspan AS (SELECT subject_id, min(start_s) AS min_ts, max(end_s) AS max_ts FROM mtg GROUP BY 1),
    mb AS ({_bounds("mspan", step, most)}),
    mends AS ({_ends("mb", step, most)}),
    mtouch AS (SELECT m.*, e.w_end, greatest(start_s, w_end - 900) AS low, least(end_s, w_end) AS high FROM mtg m JOIN mends e ON m.subject_id = e.subject_id AND m.start_s <= e.w_end AND m.end_s >= e.w_end - 900),
    medge AS (SELECT *, CASE WHEN low > max(high) OVER (PARTITION BY {key} ORDER BY low, high, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM mtouch),
    misland AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY low, high, id) AS island FROM medge),
    mlen AS (SELECT subject_id, w_end, island, max(high) - min(low) AS secs FROM misland GROUP BY 1, 2, 3),
    msum AS (SELECT subject_id, w_end, sum(secs) AS secs FROM mlen GROUP BY 1, 2),
    meeting_density AS (SELECT t.subject_id, t.w_end, least(1.0e0, any_value(s.secs) / 900.0e0) AS value, avg(confidence) AS confidence, list_sort(list(id)) AS evidence, '' AS factors FROM mtouch t JOIN msum s USING ({key}) GROUP BY 1, 2),
    mgap AS (SELECT * FROM (SELECT *, lead(start_s) OVER o AS next_start, lead(id) OVER o AS next_id, lead(confidence) OVER o AS next_conf FROM mtg WINDOW o AS (PARTITION BY subject_id ORDER BY start_s, end_s, id)) WHERE next_start > end_s),
    gtouch AS (SELECT g.*, e.w_end FROM mgap g JOIN mends e ON g.subject_id = e.subject_id AND g.end_s <= e.w_end AND g.next_start >= e.w_end - 900),
    gmean AS (SELECT subject_id, w_end, avg((next_start - end_s) / 60.0e0) AS value FROM gtouch GROUP BY 1, 2),
    gside AS (SELECT DISTINCT subject_id, w_end, id, confidence FROM gtouch UNION SELECT DISTINCT subject_id, w_end, next_id, next_conf FROM gtouch),
    gconf AS (SELECT subject_id, w_end, avg(confidence) AS confidence, list_sort(list(id)) AS evidence FROM gside GROUP BY 1, 2),
    meeting_recovery AS (SELECT subject_id, w_end, value, confidence, evidence, '' AS factors FROM gmean JOIN gconf USING ({key})),
    recovery_score AS ({_feature("w JOIN first15 USING (subject_id) WHERE rmssd IS NOT NULL", recovery.value, _conf(2, recovery.present, "hrv", "hr"), _ids("i_hrv", "i_hr"), recovery.factors)}),
    distraction_score AS ({_feature("w WHERE category_weight IS NOT NULL", distraction.value, _conf(2, "CASE WHEN n_ctx > 0 THEN 2 ELSE 1 END", "brw"), _ids("i_brw"), distraction.factors)}),
    media_share AS ({_feature("w WHERE n_med_known > 0", "100.0e0 * (" + " + ".join(f"coalesce(med_{k}, 0)" for k in P.PLAYING_KINDS) + ") / n_med", _conf(1, "1", "med"), _ids("i_med"), _shares(*[(k, f"med_{k}") for k in P.PLAYING_KINDS]))}),
    git_rate AS ({_feature("w WHERE n_git_ok > 0", "CAST(" + " + ".join(f"coalesce(git_{k}, 0)" for k in P.COUNTED_GIT) + " AS double)", _conf(1, "1", "git_ok"), _ids("i_git_ok"), _shares(*[(k, f"git_{k}") for k in P.COUNTED_GIT]))}),
    light_share AS (SELECT * FROM ({_feature("w", "100.0e0 * nullif(" + " + ".join(f"coalesce(lig_{k}, 0)" for k in P.KNOWN_LIGHT) + ", 0) / n_lig", _conf(1, "1", "lig"), _ids("i_lig"), _shares(*[(k, f"lig_{k}") for k in P.KNOWN_LIGHT]))}) WHERE value IS NOT NULL),
    activity_balance AS ({_feature("w WHERE n_stp > 0", f"CASE WHEN n_workout > 0 THEN 0.85e0 * greatest({steps}, 70) + 15 ELSE {steps} END", _conf(2, balance.present, "stp", "workout"), _ids("i_stp", "i_workout"), balance.factors)}),
    energy_score AS (SELECT * FROM ({_feature(f"w FULL JOIN {_rest(P.REST_STAGES)} s USING ({key}) JOIN first5 USING (subject_id)", energy.value, _conf(3, energy.present, "nrg", "rest", "hr"), _ids("i_nrg", "i_rest", "i_hr"), energy.factors)}) WHERE value IS NOT NULL),
    sleep_debt AS ({_feature(_rest(P.ALL_REST), f"100 * {short}", _conf(1, "1", "rest"), _ids("i_rest"), _shares(("rest", f"1 - {short}"), ("shortfall", short)))}),
    notification_pressure AS ({_feature("w WHERE n_ntf_ok > 0", "least(100.0e0, 100.0e0 * ntf_total / 20)", _conf(1, "1", "ntf_ok"), _ids("i_ntf_ok"), _shares(*[(k, f"ntf_{k}") for k in S.NOTIFICATION_CATEGORIES]))}),
    cognitive_load AS (SELECT subject_id, w_end, {_clamp(cognitive.value)} AS value, {_slots(3, "m", "c", "n")} AS confidence, {_ids("m.evidence", "c.evidence", "n.evidence")} AS evidence, {cognitive.factors} AS factors
      FROM meeting_density m FULL JOIN context_switch_rate c USING ({key}) FULL JOIN notification_pressure n USING ({key})),
    deep_work_score AS (SELECT subject_id, w_end, {deep.value} AS value, {_slots(2, "f", "c")} AS confidence, {_ids("f.evidence", "c.evidence")} AS evidence, {deep.factors} AS factors FROM focus_score f LEFT JOIN context_switch_rate c USING ({key})),
    near AS (SELECT a.subject_id, a.w_end, max(f.value) - min(f.value) AS spread, avg(f.confidence) AS confidence, flatten(list(f.evidence)) AS evidence
      FROM {_buckets("focus_score", "w_end", 900)} a JOIN focus_score f ON a.subject_id = f.subject_id AND f.w_end // 900 = a.bucket AND f.w_end BETWEEN a.w_end - 900 AND a.w_end GROUP BY 1, 2),
    attention_stability AS (SELECT subject_id, w_end, {attention.value} AS value, (near.confidence + coalesce(c.confidence, 0)) / 2 AS confidence,
      list_sort(list_distinct(list_concat(near.evidence, coalesce(c.evidence, [])))) AS evidence, {attention.factors} AS factors FROM near LEFT JOIN context_switch_rate c USING ({key})),
    desk_away AS ({_feature("w WHERE (n_walk > 0 OR coalesce(steps, 0) >= 40) AND NOT (typing AND n_walk = 0 AND coalesce(steps, 0) < 80)", away.value, away_conf, f"list_sort(list_distinct(flatten([{', '.join(used('i', '[]'))}])))", away.factors)}),
    timed AS (SELECT subject_id, id, ts, confidence,
      CASE WHEN data_type = '{S.KEYSTROKES}' AND (rate_per_min > 0 OR key_count > 0) THEN CAST(greatest(coalesce(key_count, 1), 1) AS double) WHEN data_type = '{S.CONTEXT}' THEN 1.0e0 END AS desk,
      CASE WHEN data_type = '{S.STEPS}' AND steps > 0 THEN CAST(steps AS double) WHEN data_type = '{S.ENERGY}' AND kcal > 0 THEN kcal WHEN data_type = '{S.LIFE_EVENT}' AND life_kind = 'workout' THEN 1.0e0 END AS move FROM obs),
    work AS (SELECT e.subject_id, e.w_end, coalesce(sum(desk), 0) > 0 AS by_desk, round(sum(desk * ts) / sum(desk)) AS desk_at, round(sum(move * ts) / sum(move)) AS move_at,
      count(desk) AS n_desk, count(move) AS n_move, sum(confidence) FILTER (desk IS NOT NULL) AS c_desk, sum(confidence) FILTER (move IS NOT NULL) AS c_move,
      list(id) FILTER (desk IS NOT NULL) AS i_desk, list(id) FILTER (move IS NOT NULL) AS i_move
      FROM timed t JOIN {_buckets("ends", "w_end", 86400)} e ON t.subject_id = e.subject_id AND t.ts // 86400 = e.bucket AND t.ts BETWEEN e.w_end - 86400 AND e.w_end WHERE desk IS NOT NULL OR move IS NOT NULL GROUP BY 1, 2),
    clock AS (SELECT *, CAST(CASE WHEN by_desk THEN desk_at ELSE move_at END AS bigint) - (low + (high - low) // 2 + 43200) AS apart FROM work JOIN {_rest(P.REST_STAGES)} s USING ({key})),
    folded AS (SELECT *, ((apart % 86400) + 86400) % 86400 AS off FROM clock),
    circadian_offset AS (SELECT subject_id, w_end, {_clamp("100 * (1 - CASE WHEN off > 43200 THEN 86400 - off ELSE off END / 3600.0e0 / 6.0e0)")} AS value,
      (c_rest + CASE WHEN by_desk THEN c_desk ELSE c_move END) / (n_rest + CASE WHEN by_desk THEN n_desk ELSE n_move END) AS confidence,
      list_sort(list_distinct(list_concat(i_rest, CASE WHEN by_desk THEN i_desk ELSE i_move END))) AS evidence,
      CASE WHEN by_desk THEN 'sleep=5000,work=5000' ELSE 'sleep=5000,activity=5000' END AS factors FROM folded),
    sends AS (SELECT subject_id, w_end FROM stress_index UNION SELECT subject_id, w_end FROM fatigue_index),
    slook AS (SELECT 's' AS src, subject_id, w_end, value, confidence, evidence FROM stress_index UNION ALL SELECT 'f', subject_id, w_end, value, confidence, evidence FROM fatigue_index UNION ALL SELECT 'm', subject_id, w_end, value, confidence, evidence FROM meeting_density),
    slong AS (SELECT e.subject_id, e.w_end, avg(value) FILTER (src = 's') AS sm, avg(value) FILTER (src = 'f') AS fm, avg(value) FILTER (src = 'm') AS mm, avg(confidence) AS conf,
      list_sort(flatten(list(evidence) FILTER (x.w_end = e.w_end))) AS evidence
      FROM {_buckets("sends", "w_end", 14400)} e JOIN slook x ON e.subject_id = x.subject_id AND x.w_end // 14400 = e.bucket AND x.w_end BETWEEN e.w_end - 14400 AND e.w_end GROUP BY 1, 2),
    sustained_load AS (SELECT subject_id, w_end, {_clamp(sustained.value)} AS value, {sustained.present} / 3.0e0 * conf AS confidence, evidence, {sustained.factors} AS factors FROM slong)"""


DIGEST = "subject_id, w_end, round(value + 1e-9, 6) AS value, round(confidence + 1e-9, 6) AS confidence, CAST(len(evidence) AS bigint) AS n_evidence, md5(array_to_string(evidence, ',')) AS evidence_md5, factors"


def feature(name: str, step: int = STEP, most: int | None = MOST) -> str:
    return f"WITH {feature_ctes(step, most=most)}\nSELECT {DIGEST} FROM {name}"


def observations() -> str:
    """The typed observations as the table ``obs``."""
    return f"WITH {_typed()},\n    obs AS (SELECT * FROM typed)"


def high_stress_ctes() -> str:
    return """hot AS (SELECT subject_id, w_end, w_end - 60 * row_number() OVER (PARTITION BY subject_id ORDER BY w_end) AS run FROM stress_index WHERE value > 75),
    high AS (SELECT subject_id, min(w_end) AS start_ts, max(w_end) AS end_ts, count(*) AS samples FROM hot GROUP BY subject_id, run HAVING max(w_end) - min(w_end) > 300)"""


_QUALITY = "CASE WHEN src_kind = 'apple_watch' THEN 1.0e0 WHEN src_kind = 'manual' THEN 0.3e0 ELSE 0.6e0 END"
_DAY = "({} // 86400) * 86400"
_ROUND = "round({0} + 1e-9, 6) AS {0}"


def _evidence(ts: str = "ts") -> str:
    return f"avg(confidence) * avg({_QUALITY}) AS confidence, mode(src_kind ORDER BY src_kind) AS source, md5(array_to_string(list_sort(list(id)), ',')) AS evidence_md5, max({ts}) AS last_ts"


def _baseline(daily: str, value: str, days: int, also: str = "") -> str:
    same = f" AND p.{also} = d.{also}" if also else ""
    return f"""SELECT * EXCLUDE (near, middle), CASE WHEN near >= 5 THEN middle END AS baseline, CASE WHEN near >= 5 THEN near END AS baseline_days, CASE WHEN near >= 5 THEN {value} - middle END AS delta
      FROM (SELECT d.*, count(p.day) AS near, median(p.{value}) AS middle
        FROM {daily} d LEFT JOIN {daily} p ON p.subject_id = d.subject_id{same} AND p.day >= d.day - {days} * 86400 AND p.day < d.day GROUP BY ALL)"""


def _rounded(*columns: str) -> str:
    return ", ".join(_ROUND.format(c) for c in columns)


_VITAL = "baseline_days, source, evidence_md5, " + _rounded("baseline", "delta", "confidence")


def resting_hr_daily() -> str:
    return f"""{observations()},
    daily AS (SELECT subject_id, {_DAY.format("ts")} AS day, max_by(bpm, ts || '|' || id) AS bpm, {_evidence()} FROM obs WHERE data_type = '{S.RESTING_HR}' GROUP BY 1, 2),
    based AS ({_baseline("daily", "bpm", 14)})
    SELECT subject_id, day, greatest(day, last_ts) AS w_end, bpm, {_VITAL} FROM based"""


def hrv_vs_baseline() -> str:
    return f"""{observations()},
    ms AS (SELECT *, CASE WHEN rmssd_ms IS NOT NULL THEN 'rmssd' ELSE 'sdnn' END AS method, coalesce(rmssd_ms, sdnn_ms) AS ms FROM obs WHERE data_type = '{S.HRV}'),
    daily AS (SELECT subject_id, method, {_DAY.format("ts")} AS day, avg(ms) AS ms, {_evidence()} FROM ms GROUP BY 1, 2, 3),
    based AS ({_baseline("daily", "ms", 28, "method")})
    SELECT subject_id, day, greatest(day, last_ts) AS w_end, method, {_rounded("ms")}, {_VITAL} FROM based WHERE baseline IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY subject_id, day ORDER BY last_ts DESC, method) = 1"""


def sleep_stages_daily() -> str:
    return f"""{observations()},
    sleep AS (SELECT *, {_DAY.format("end_s")} AS day, CASE WHEN stage IS NULL OR stage = 'asleep' THEN 'plain' WHEN stage IN ('asleep_core', 'asleep_deep', 'asleep_rem') THEN substr(stage, 8) END AS part FROM obs WHERE data_type = '{S.SLEEP}'),
    edge AS (SELECT *, CASE WHEN start_s > max(end_s) OVER (PARTITION BY subject_id, day, part ORDER BY start_s, end_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM sleep WHERE part IS NOT NULL),
    island AS (SELECT *, sum(opens) OVER (PARTITION BY subject_id, day, part ORDER BY start_s, end_s, id) AS island FROM edge),
    len AS (SELECT subject_id, day, part, island, max(end_s) - min(start_s) AS secs FROM island GROUP BY 1, 2, 3, 4),
    sums AS (SELECT subject_id, day, coalesce(sum(secs) FILTER (part = 'plain'), 0) AS plain, coalesce(sum(secs) FILTER (part = 'core'), 0) AS core, coalesce(sum(secs) FILTER (part = 'deep'), 0) AS deep, coalesce(sum(secs) FILTER (part = 'rem'), 0) AS rem FROM len GROUP BY 1, 2),
    night AS (SELECT subject_id, day, (min(start_s) % 86400) / 3600.0e0 AS hour, max(end_s) AS last_end, {_evidence()} FROM sleep GROUP BY 1, 2),
    regular AS (SELECT d.*, CASE WHEN count(p.day) >= 3 THEN {_clamp("100 * (1 - stddev_pop(p.hour) / 3)")} END AS bedtime_regularity
      FROM night d LEFT JOIN night p ON p.subject_id = d.subject_id AND p.day >= d.day - 14 * 86400 AND p.day < d.day GROUP BY ALL),
    both_ AS (SELECT *, core + deep + rem AS staged FROM regular JOIN sums USING (subject_id, day)),
    shares AS (SELECT *, CASE WHEN staged > 0 THEN deep / staged END AS deep_share, CASE WHEN staged > 0 THEN rem / staged END AS rem_share, CASE WHEN staged > 0 THEN core / staged END AS core_share, (staged + plain) / 60.0e0 AS total_min FROM both_ WHERE staged + plain > 0)
    SELECT subject_id, day, greatest(day, last_end) AS w_end, staged > 0 AS stages, source, evidence_md5, {_rounded("total_min", "deep_share", "rem_share", "core_share", "bedtime_regularity", "confidence")} FROM shares"""


def night_spo2() -> str:
    return f"SELECT subject_id, day, w_end, low_ AS low, mean, {_VITAL_NAMES} FROM ({nightly('spo2_percent')})"


_VITAL_NAMES = "baseline_days, source, evidence_md5, baseline, delta, confidence"
#: Stand-ins for measures that the events lack.
BREATHS, WRIST = "spo2_percent / 5.0e0", "(spo2_percent - 75) / 5.0e0"


def respiratory_nightly() -> str:
    return f"SELECT subject_id, day, w_end, round(low_ + 1e-9, 6) AS low, mean, {_VITAL_NAMES} FROM ({nightly(BREATHS)})"


def wrist_nightly() -> str:
    return f"SELECT subject_id, day, w_end, mean, {_VITAL_NAMES} FROM ({nightly(WRIST)})"


def nightly(value: str) -> str:
    """A value of the oxygen samples, taken as another nightly measure."""
    return f"""{observations()},
    night AS (SELECT subject_id, {_DAY.format("end_s")} AS day, min(start_s) AS a, max(end_s) AS b FROM obs WHERE data_type = '{S.SLEEP}' GROUP BY 1, 2),
    s AS (SELECT *, {value} AS v FROM obs WHERE data_type = '{S.SPO2}'),
    inside AS (SELECT s.*, n.day FROM s JOIN night n ON s.subject_id = n.subject_id AND s.ts BETWEEN n.a AND n.b),
    rest AS (SELECT s.*, {_DAY.format("ts")} AS day FROM s WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.subject_id = s.subject_id AND i.id = s.id)),
    every AS (SELECT * FROM inside UNION ALL SELECT * FROM rest r WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.subject_id = r.subject_id AND i.day = r.day)),
    daily AS (SELECT subject_id, day, avg(v) AS mean, min(v) AS low_, {_evidence()} FROM every GROUP BY 1, 2),
    based AS ({_baseline("daily", "mean", 14)})
    SELECT subject_id, day, greatest(day, last_ts) AS w_end, low_, {_rounded("mean")}, {_VITAL} FROM based"""


AFTERNOON_STEP = 300


def focus_afternoon_baseline() -> str:
    chosen = f"""SELECT t.* REPLACE (t.subject_id || '|' || CAST({_DAY.format("t.ts")} AS varchar) AS subject_id) FROM typed t
      JOIN (SELECT subject_id, {_DAY.format("max(ts)")} AS today FROM typed GROUP BY 1) l ON l.subject_id = t.subject_id
      WHERE {_DAY.format("t.ts")} < today AND {_DAY.format("t.ts")} >= today - 7 * 86400 AND t.ts % 86400 BETWEEN 46800 AND 61200"""
    return f"""WITH {feature_ctes(AFTERNOON_STEP, chosen)},
    good AS (SELECT subject_id, avg(value) AS focus, avg(confidence) AS confidence, md5(array_to_string(list_sort(list_distinct(flatten(list(evidence)))), ',')) AS evidence_md5 FROM focus_score WHERE confidence >= 0.3 GROUP BY 1)
    SELECT split_part(subject_id, '|', 1) AS subject_id, CAST(split_part(subject_id, '|', 2) AS bigint) AS day, evidence_md5, {_rounded("focus", "confidence")} FROM good"""


def alert_level() -> str:
    return f"""WITH {feature_ctes(60)}, {high_stress_ctes()},
    recent AS (SELECT subject_id, arg_max(value, w_end) AS v FROM stress_index GROUP BY 1 UNION ALL SELECT subject_id, arg_max(value, w_end) FROM fatigue_index GROUP BY 1)
    SELECT subject_id, CASE WHEN subject_id IN (SELECT subject_id FROM high) THEN 'red' WHEN subject_id IN (SELECT subject_id FROM recent WHERE v > 60) THEN 'yellow' ELSE 'green' END AS level FROM span"""


def _all(names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS feature_id, * FROM {n}" for n in names)


LATEST = ("focus_score", "stress_index", "fatigue_index", "sleep_debt", "cognitive_load", "energy_score")
CHART = ("focus_score", "context_switch_rate", "sleep_debt", "energy_score")
REPORTED = ("focus_score", "energy_score", "notification_pressure")


def latest_features() -> str:
    composites = "('focus_score', 'fatigue_index', 'recovery_score', 'energy_score', 'cognitive_load', 'deep_work_score', 'sustained_load')"
    return f"""WITH {feature_ctes(most=MOST)}, every AS ({_all(LATEST)})
    SELECT subject_id, feature_id, w_end, {_rounded("value", "confidence")},
      CASE WHEN confidence < 0.5 THEN 'low' WHEN feature_id IN {composites} AND factors <> '' AND factors NOT LIKE '%,%' THEN 'single_input' ELSE 'ok' END AS reliability
    FROM every QUALIFY row_number() OVER (PARTITION BY subject_id, feature_id ORDER BY w_end DESC) = 1"""


def chart_pivot() -> str:
    columns = ", ".join(f"round(max(value) FILTER (feature_id = '{n}') + 1e-9, 6) AS {n}" for n in CHART)
    return f"WITH {feature_ctes(most=MOST)}, every AS ({_all(CHART)}) SELECT subject_id, w_end, {columns} FROM every GROUP BY 1, 2"


def report_runs() -> str:
    return f"""WITH {feature_ctes(most=MOST)}, every AS ({_all(REPORTED)}),
    rows_ AS (SELECT subject_id, feature_id, w_end, w_end - 900 AS start, value, lag(w_end) OVER (PARTITION BY subject_id, feature_id ORDER BY w_end) AS prev FROM every),
    runs AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev + 120 THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, feature_id ORDER BY w_end) AS run FROM rows_),
    agg AS (SELECT subject_id, feature_id, run, min(start) AS run_start, max(w_end) AS run_end, arg_min(value, w_end) AS first, arg_max(value, w_end) AS last, min(value) AS low, max(value) AS high, count(*) AS samples FROM runs GROUP BY 1, 2, 3)
    SELECT subject_id, feature_id, run_start, run_end, samples, round(low + 1e-9, 4) AS low, round(high + 1e-9, 4) AS high, {_rounded("first", "last")},
      CASE WHEN last - first >= 5 THEN 'higher' WHEN last - first <= -5 THEN 'lower' ELSE 'flat' END AS trend FROM agg"""




def life_event_effect() -> str:
    return f"""WITH {feature_ctes(most=MOST)},
    e AS (SELECT subject_id, id, ts AS event_ts, life_kind AS kind FROM obs WHERE data_type = '{S.LIFE_EVENT}' AND life_kind IN ('coffee', 'walk')),
    s AS ({_all(("focus_score", "cognitive_load"))}),
    around_event AS (SELECT e.*, s.feature_id, s.value, s.confidence, (s.w_end > event_ts - 2700 AND s.w_end <= event_ts) AS b, (s.w_end BETWEEN event_ts + 900 AND event_ts + 3600) AS a FROM e JOIN s ON s.subject_id = e.subject_id AND s.confidence >= 0.4 AND s.w_end > event_ts - 2700 AND s.w_end <= event_ts + 3600),
    each AS (SELECT subject_id, kind, feature_id, id, avg(value) FILTER (a) - avg(value) FILTER (b) AS change, avg(confidence) FILTER (a OR b) AS confidence FROM around_event GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (b) >= 2 AND count(*) FILTER (a) >= 2),
    total AS (SELECT subject_id, kind, feature_id, count(*) AS events, avg(change) AS change, avg(confidence) AS confidence FROM each GROUP BY 1, 2, 3)
    SELECT subject_id, kind, feature_id, events, {_rounded("change", "confidence")} FROM total"""


def source_selected() -> str:
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(S.SOURCE_PRIORITY))
    from tidelog.operators.quality import CUMULATIVE, DISCRETE

    return f"""{observations()},
    ranked AS (SELECT *, CASE src_kind {ranks} ELSE 6 END AS rank, CASE WHEN data_type IN {CUMULATIVE} THEN ts // 86400 WHEN data_type IN {DISCRETE} THEN ts // 900 WHEN data_type = '{S.SLEEP}' THEN (start_s - 21600) // 86400 END AS bucket FROM obs)
    SELECT r.id, r.subject_id, r.data_type, r.src_kind FROM ranked r WHERE bucket IS NULL OR NOT EXISTS (SELECT 1 FROM ranked o WHERE o.subject_id = r.subject_id AND o.data_type = r.data_type AND o.bucket = r.bucket AND o.rank < r.rank)"""


def visible_observations() -> str:
    return f"""{observations()}
    SELECT id, subject_id, ts, provider_id, data_type FROM obs o WHERE NOT (data_type = '{S.LIFE_EVENT}' AND ts % 3 = 0) AND NOT (ts % 11 = 0 AND ts % 2 = 0)"""


def source_report() -> str:
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(S.SOURCE_PRIORITY))
    return f"""{observations()},
    lim AS (SELECT max(ts) AS now FROM obs),
    r AS (SELECT *, CASE src_kind {ranks} ELSE 6 END AS rank, CAST(timezone('Europe/Belgrade', to_timestamp(ts)) AS date) AS day FROM obs, lim WHERE ts BETWEEN now - 30 * 86400 AND now),
    l AS (SELECT *, min(rank) OVER (PARTITION BY data_type) AS lead_rank FROM r)
    SELECT src_kind, provider_id, max(ts) AS last_ts, max(created_at) AS last_received, count(*) FILTER (ts >= now - 86400) AS rows_24h, count(*) FILTER (ts >= now - 7 * 86400) AS rows_7d, count(*) AS rows_30d,
      round(least(1.0e0, count(DISTINCT day) / 30.0e0), 6) AS coverage, min(rank) AS rank, bool_or(rank = lead_rank) AS active FROM l GROUP BY 1, 2"""


def dedupe_exact() -> str:
    columns = ", ".join(("subject_id", "provider_id", "data_type", "ts", "src_kind", *S.PAYLOAD))
    return f"""{observations()},
    copies AS (SELECT * FROM obs UNION ALL SELECT * REPLACE ('x' || id AS id, created_at + 7 AS created_at) FROM obs WHERE ts % 5 = 0 UNION ALL SELECT * REPLACE (created_at + 9 AS created_at) FROM obs WHERE ts % 7 = 0)
    SELECT id, data_type, ts, created_at FROM copies QUALIFY row_number() OVER (PARTITION BY {columns} ORDER BY created_at, id) = 1"""


NORMALIZED = ("key_count", "rate_per_min", "event_count", "notif_count", "rmssd_ms", "sdnn_ms", "steps", "kcal", "spo2_percent", "bpm", "start_s", "end_s")


def normalize_by_type() -> str:
    sums = ", ".join(f"round(CAST(sum({c}) AS double), 3) AS {c}" for c in NORMALIZED)
    return f"{observations()} SELECT data_type, count(*) AS rows, count(DISTINCT bundle_id) AS bundles, count(stage) AS stages, {sums} FROM obs GROUP BY 1"


def plain(sql: str) -> str:
    return f"{observations()} {sql}"


CHANNELS = (*S.COMPUTER_CHANNELS, *S.WATCH_CHANNELS, S.RESPIRATORY)
CHANNELS_SINCE = 1705000000


def source_channels() -> str:
    known = ", ".join(f"('{t}')" for t in CHANNELS)
    return plain(f"SELECT k.data_type, count(o.id) AS rows, max(o.ts) AS last_ts FROM (VALUES {known}) k(data_type) LEFT JOIN obs o ON o.data_type = k.data_type AND o.ts >= {CHANNELS_SINCE} GROUP BY 1")


def life_events() -> str:
    return plain(f"SELECT subject_id, id, ts, life_kind FROM obs WHERE data_type = '{S.LIFE_EVENT}' ORDER BY ts DESC, id DESC LIMIT 8")


def visible_between() -> str:
    return f"{visible_observations()} AND ts BETWEEN 1704500000 AND 1705000000"


def life_event_log() -> str:
    return plain(f"SELECT subject_id, life_kind, count(*) AS events, CAST(sum(ts) AS bigint) AS ts_sum FROM obs WHERE data_type = '{S.LIFE_EVENT}' AND (ts % 3 <> 0 OR ts % 6 = 0) GROUP BY 1, 2")


def typed_scan() -> str:
    return f"{visible_observations()} AND data_type = '{S.CONTEXT}' AND ts BETWEEN 1704500000 AND 1705000000"


def several_types() -> str:
    return plain(f"SELECT id, ts, data_type FROM obs WHERE data_type IN ('{S.LIFE_EVENT}', '{S.HRV}') AND ts BETWEEN 1704500000 AND 1705000000 AND NOT (ts % 11 = 0 AND ts % 2 = 0)")


WEEK_END = 1706000000
WEEK = ("focus_score", "stress_index")


def feature_week() -> str:
    chosen = f"SELECT * FROM typed WHERE ts BETWEEN {WEEK_END} - 604800 AND {WEEK_END}"
    return f"WITH {feature_ctes(3600, chosen)}, every AS ({_all(WEEK)}) SELECT feature_id, {DIGEST} FROM every"


def window_counts() -> str:
    return plain("SELECT subject_id, data_type, w_end, count(*) AS rows, round(avg(confidence) + 1e-9, 6) AS confidence FROM (SELECT *, unnest(generate_series(((ts + 299) // 300) * 300, ts + 900, 300)) AS w_end FROM obs) WHERE w_end BETWEEN ts AND ts + 900 GROUP BY 1, 2, 3")


def wearable_report() -> str:
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(S.SOURCE_PRIORITY))
    return plain(f"""SELECT kind, app, device_model, max(ts) AS last_ts, max(created_at) AS last_received, any_value(counts) AS counts, round(least(1.0e0, count(DISTINCT day) / 30.0e0), 6) AS coverage, min(rank) AS rank, bool_or(rank = lead_rank) AS active
    FROM (SELECT *, min(rank) OVER (PARTITION BY data_type) AS lead_rank FROM (SELECT *, src_kind AS kind, CASE provider_id WHEN 'p0' THEN 'Health' WHEN 'p1' THEN 'org.example.app' ELSE 'unknown' END AS app, CASE WHEN ts % 2 = 0 THEN 'two' ELSE '' END AS device_model,
      CASE src_kind {ranks} END AS rank, CAST(timezone('Europe/Belgrade', to_timestamp(ts)) AS date) AS day FROM obs WHERE ts BETWEEN {WEARABLE_NOW} - 30 * 86400 AND {WEARABLE_NOW} AND src_kind IS NOT NULL)) r
    JOIN (SELECT kind, app, device_model, string_agg(line, ',' ORDER BY data_type) AS counts FROM (
      SELECT src_kind AS kind, CASE provider_id WHEN 'p0' THEN 'Health' WHEN 'p1' THEN 'org.example.app' ELSE 'unknown' END AS app, CASE WHEN ts % 2 = 0 THEN 'two' ELSE '' END AS device_model, data_type,
        data_type || ':' || count(*) FILTER (ts >= {WEARABLE_NOW} - 86400) || '/' || count(*) FILTER (ts >= {WEARABLE_NOW} - 7 * 86400) || '/' || count(*) AS line
      FROM obs WHERE ts BETWEEN {WEARABLE_NOW} - 30 * 86400 AND {WEARABLE_NOW} AND src_kind IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) c USING (kind, app, device_model) GROUP BY 1, 2, 3""")


WEARABLE_NOW = 1706000000
FACTS = ("focus_score", "stress_index", "context_switch_rate", "cognitive_load", "sustained_load")


def insights() -> str:
    """All rules; each one's facts in a subquery of its own."""
    sure = "least(events / 4.0e0, 1.0e0) * confidence"
    words = f"CASE WHEN {sure} >= 0.75 THEN 'high' WHEN {sure} >= 0.4 THEN 'medium' ELSE 'low' END"

    def elevated(name: str, rule: str, bound: str, title: str) -> str:
        return f"SELECT subject_id, '{rule}', '{title}', 'up', printf('latest value %.1f', value) FROM last WHERE feature_id = '{name}' AND value >= {bound}"

    return f"""WITH f AS (WITH {feature_ctes(most=MOST)} {_all(FACTS)}),
    last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY subject_id, feature_id ORDER BY w_end DESC) = 1),
    stressed AS (WITH {feature_ctes(most=MOST)}, {high_stress_ctes()} SELECT subject_id, count(*) AS n FROM high GROUP BY 1),
    usual AS (SELECT subject_id, avg(focus) AS base FROM ({focus_afternoon_baseline()}) WHERE confidence >= 0.3 GROUP BY 1 HAVING count(*) >= 2),
    hrv AS (SELECT subject_id, max_by(delta, day) AS delta, max_by(method, day) AS method FROM ({hrv_vs_baseline()}) GROUP BY 1),
    moved AS (SELECT subject_id, value - base AS change, base FROM last JOIN usual USING (subject_id) WHERE feature_id = 'focus_score' AND confidence >= 0.3 AND abs(value - base) >= 10),
    told(subject_id, rule_id, title, direction, text) AS (
      SELECT subject_id, 'high_stress_period_v1', 'Sustained high stress', 'up', printf('%d sustained high stress period(s)', n) FROM stressed
      UNION ALL {elevated("context_switch_rate", "context_switch_elevated_v1", "1.0", "Frequent context switches")}
      UNION ALL SELECT subject_id, 'focus_vs_recent_baseline_v1', 'Focus against recent afternoons', CASE WHEN change < 0 THEN 'down' ELSE 'up' END, printf('%+.1f against a baseline of %.1f', change, base) FROM moved
      UNION ALL {elevated("cognitive_load", "cognitive_load_elevated_v1", "60", "High combined demand")}
      UNION ALL {elevated("sustained_load", "sustained_load_elevated_v1", "60", "High sustained load")}
      UNION ALL SELECT subject_id, 'life_event_before_after_v1', 'Before and after an event', CASE WHEN change < 0 THEN 'down' ELSE 'up' END, printf('%s after %s: %+.1f over %d event(s), %s confidence', feature_id, kind, change, events, {words}) FROM ({life_event_effect()}) WHERE abs(change) >= 5
      UNION ALL SELECT subject_id, 'hrv_vs_baseline_v1', 'HRV below baseline', 'down', printf('%s %.1f ms against the baseline', method, delta) FROM hrv WHERE delta <= -5)
    SELECT subject_id, rule_id, title, text FROM told
    UNION ALL SELECT subject_id, 'focus_dip_pace_hint_v1', 'Ease the pace', 'Focus is under its usual level; a short break may help.' FROM told WHERE rule_id = 'focus_vs_recent_baseline_v1' AND direction = 'down'
    UNION ALL SELECT subject_id, 'combined_demand_pace_hint_v1', 'Spread demands', 'Several demands meet; moving one of them may help.' FROM told WHERE rule_id = 'cognitive_load_elevated_v1'"""
