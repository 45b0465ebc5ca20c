"""Usage events (fixture §5): ingest a posted batch, sanitize, summarize."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions.sanitize import sanitize_json_text
from ledgerspark.operators import events as E
from ledgerspark.sources.events import read_event_batches

BASE = {"userId": "user-1", "sessionId": "sess-1", "page": "/transactions"}
EVENTS = [
    ("evt-1", "session_started", "Analytics", {"startedAt": "2026-05-19T00:00:00+00:00"}, 0),
    ("evt-2", "search_submitted", "FiltersPanel", {"query": "Coffee Beans", "queryLength": 12, "resultCount": 0}, 10),
    ("evt-3", "search_zero_results", "FiltersPanel", {"query": "Coffee Beans"}, 11),
    ("evt-4", "filter_changed", "FiltersPanel", {"filter": "provider", "value": "amex"}, 12),
    ("evt-5", "sort_changed", "TransactionTable", {"sort": "amount", "direction": "desc", "apiKey": "secret-value"}, 13),
    ("evt-6", "button_clicked", "AppLayout", {"action": "refresh_dashboard"}, 14),
    ("evt-7", "session_ended", "Analytics", {"reason": "pagehide"}, 20),
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("events")
    payload = {"events": [dict(BASE, eventId=i, eventType=t, component=c, metadata=m,
                               ts=f"2026-05-19T00:00:{s:02d}+00:00") for i, t, c, m, s in EVENTS]}
    (d / "batch1.json").write_text(json.dumps(payload))
    (d / "bad.json").write_text(json.dumps({"events": {"not": "a list"}}))
    raw, rejected = read_event_batches(spark, str(d))
    assert rejected.count() == 1
    return E.normalize_events(raw).cache()


def test_ingest_sanitizes(events):
    rows = events.orderBy("ts").collect()
    assert len(rows) == 7
    assert rows[4].event_type == "sort_changed"
    assert "secret-value" not in rows[4].metadata_json and "[redacted]" in rows[4].metadata_json
    assert json.loads(rows[1].metadata_json) == {"query": "Coffee Beans", "querylength": 12, "resultcount": 0}


def test_top_and_feature_usage(events):
    top = E.top_events(events, 3).collect()
    assert top[0].event_type in {"search_submitted", "search_zero_results", "button_clicked"}
    assert any(r.event_type == "button_clicked" for r in E.feature_usage(events, 10).collect())


def test_session_summary_and_flow(events):
    s = E.session_summary(events).first()
    assert (s.session_id, s.user_id, s.event_count, s.duration_seconds) == ("sess-1", "user-1", 7, 20.0)
    flow = E.session_flows(events, limit=1).orderBy("ts", "event_id").collect()
    assert [r.event_type for r in flow][:3] == ["session_started", "search_submitted", "search_zero_results"]
    assert flow[0].session_id == "sess-1"


def test_search_trends(events):
    t = E.search_trends(events, 5).first()
    assert (t.query, t.submitted, t.zero_results, t.zero_result_rate) == ("Coffee Beans", 1, 2, 2.0)


def test_filters_and_sorts(events):
    assert E.common_filters(events).first().filter == "provider"
    s = E.common_sorts(events).first()
    assert (s.sort, s.direction) == ("amount", "desc")


def test_dedupe_last_wins(spark, events):
    again = events.withColumn("seq", F.lit(1)).withColumn("page", F.lit("/again")).filter("event_id = 'evt-3'")
    out = E.dedupe_events(events.withColumn("seq", F.lit(0)).unionByName(again), "seq")
    assert out.count() == 7
    assert out.filter("event_id = 'evt-3'").first().page == "/again"


def test_sampling_is_per_session(events):
    kept = E.sample_sessions(events, 0.5).select("session_id").distinct().count()
    assert kept in (0, 1)
    assert E.sample_sessions(events, 1.0).count() == 7 and E.sample_sessions(events, 0.0).count() == 0


@pytest.mark.parametrize("raw,expected", [
    ('{"a":{"b":{"c":{"d":1}}}}', {"a": {"b": {"c": {}}}}),
    ('{"Contact Email":"x y@z.com","Phone":"555 123 4567","ok":"fine"}',
     {"contact_email": "[redacted]", "phone": "[redacted]", "ok": "fine"}),
    ('{"list":[1,2,3,4,5,6,7,8,9,10],"blank":"  "}', {"list": [1, 2, 3, 4, 5, 6, 7, 8]}),
    ('{"search":"ab"}', {"search": "ab"}),
    ('{"search":"call 1234567"}', {"search": "[redacted]"}),
    ('{"shipping":"x","author":"y"}', {"shipping": "[redacted]", "author": "[redacted]"}),
    ('"plain"', {"value": "plain"}),
    ("0", {}),
])
def test_sanitizer_rules(raw, expected):
    assert json.loads(sanitize_json_text(raw)) == expected


def test_sanitizer_key_limit_counts_raw_keys():
    raw = "{" + ",".join(f'"k{i}":{i}' for i in range(20)) + "}"
    assert len(json.loads(sanitize_json_text(raw))) == 16
