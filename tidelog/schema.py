"""The observation frame: an envelope and one typed, nullable column for each
payload field, so that every later step stays within columnar expressions."""

from __future__ import annotations

#: Data types by role.
CONTEXT, KEYSTROKES, BROWSER, MEDIA = "context_window", "keystrokes", "browser_category", "now_playing"
GIT, LIGHT, NOTIFICATION, HRV = "git_activity", "ambient_light", "notification_event", "hrv"
STEPS, ENERGY, SLEEP, SPO2 = "step_count", "active_energy", "sleep_interval", "oxygen_saturation"
HEART_RATE, RESTING_HR, CALENDAR, LIFE_EVENT = "heart_rate", "resting_heart_rate", "calendar_event", "life_event"
RESPIRATORY, WRIST_TEMPERATURE = "respiratory_rate", "sleeping_wrist_temperature"
RETRACTION, DELETION = "life_event_retraction", "source_deletion"

#: Closed sets.
SOURCE_KINDS = ("apple_watch", "iphone", "xiaomi_mi_fitness", "zepp_life", "other_app", "manual")
SOURCE_PRIORITY = ("apple_watch", "xiaomi_mi_fitness", "zepp_life", "iphone", "other_app", "manual")
BROWSER_CATEGORIES = ("work", "communication", "entertainment", "reference", "shopping", "unknown")
MEDIA_KINDS = ("music", "podcast", "other", "none", "unknown")
LIGHT_KINDS = ("dark", "dim", "moderate", "bright", "unknown")
GIT_KINDS = ("commit", "checkout", "sync", "other", "idle", "unknown")
NOTIFICATION_CATEGORIES = ("communication", "calendar", "system", "media", "social", "other", "unknown")
INTERRUPTION_LEVELS = ("passive", "active", "time_sensitive", "critical", "unknown")
APP_KINDS = ("messaging", "mail", "calendar", "social", "system", "other", "unknown")
SLEEP_STAGES = ("asleep", "in_bed", "awake", "unknown", "asleep_core", "asleep_deep", "asleep_rem")
LIFE_KINDS = ("coffee", "walk", "lunch", "workout")

#: Channels of a source report, in its order, and those that collect
#: only when they are switched on.
COMPUTER_CHANNELS = (CONTEXT, KEYSTROKES, CALENDAR, BROWSER, MEDIA, GIT, LIGHT, NOTIFICATION, LIFE_EVENT)
WATCH_CHANNELS = (HEART_RATE, HRV, STEPS, ENERGY, SLEEP, SPO2)
SWITCHED_CHANNELS = (KEYSTROKES, CALENDAR, BROWSER, MEDIA, GIT, LIGHT, NOTIFICATION)

ENVELOPE = {
    "id": "string",
    "subject_id": "string",
    "ts": "bigint",
    "provider_id": "string",
    "data_type": "string",
    "confidence": "double",
    "created_at": "bigint",
    "src_kind": "string",
}
PAYLOAD = {
    "bundle_id": "string",
    "key_count": "bigint",
    "window_secs": "bigint",
    "rate_per_min": "double",
    "category": "string",
    "media_kind": "string",
    "is_playing": "boolean",
    "activity_kind": "string",
    "event_count": "bigint",
    "light_kind": "string",
    "level": "double",
    "notif_count": "bigint",
    "notif_category": "string",
    "interruption_level": "string",
    "app_kind": "string",
    "rmssd_ms": "double",
    "sdnn_ms": "double",
    "pnn50": "double",
    "hrv_method": "string",
    "steps": "bigint",
    "kcal": "double",
    "start_s": "bigint",
    "end_s": "bigint",
    "stage": "string",
    "spo2_percent": "double",
    "breaths_per_min": "double",
    "celsius": "double",
    "ml_kg_min": "double",
    "bpm": "double",
    "uid": "string",
    "all_day": "boolean",
    "busy": "boolean",
    "life_kind": "string",
    "logged_at": "bigint",
    "edited_from": "string",
    "target_id": "string",
}
COLUMNS = ENVELOPE | PAYLOAD

#: Raw rows as they are stored: the payload is JSON text.
RAW = {k: v for k, v in ENVELOPE.items() if k != "src_kind"} | {"payload": "string"}
RAW_DDL = ", ".join(f"{k} {v}" for k, v in RAW.items())
TYPED_DDL = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
