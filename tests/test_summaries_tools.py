"""Summaries and compact tools on fixture L2; assistant tools on L3; no rules on L4."""

from pyspark.sql import functions as F

from ledgerspark.operators import compare as C
from ledgerspark.operators import paging, patterns as X, summaries as A
from ledgerspark.plans import bundles
from ledgerspark.schema import Filters

L2_RULES = [("groceries", ["grocery"]), ("restaurants", ["restaurant"])]
L2 = [("2025-01-10", "Grocery A", "Grocery A", 10), ("2025-01-15", "Restaurant X", "Restaurant X", 20),
      ("2025-02-05", "Grocery B", "Grocery B", 30), ("2025-02-10", "Restaurant Y", "Restaurant Y", 25)]


def test_by_category(ledger_factory):
    out = {r.category: (r.total, r.transactions) for r in A.summarize_by_category(ledger_factory(L2, L2_RULES)).collect()}
    assert out == {"groceries": (40.0, 2), "restaurants": (45.0, 2)}


def test_by_period(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    rows = A.summarize_by_period(led, "month", Filters(category="groceries")).collect()
    assert [(r.period, r.total, r.transactions) for r in rows] == [("2025-01", 10.0, 1), ("2025-02", 30.0, 1)]
    rows = A.summarize_by_period(led, "quarter").collect()
    assert [(r.period, r.total, r.transactions) for r in rows] == [("2025-Q1", 85.0, 4)]


def test_by_merchant_and_unique_merchants(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    m = {r.merchant: (r.total, r.transactions) for r in A.summarize_by_merchant(led).collect()}
    assert m["Grocery B"] == (30.0, 1) and m["Restaurant X"][1] == 1
    u = {r.merchant: r.categories for r in A.unique_merchants(led).collect()}
    assert u["Grocery A"] == ["groceries"] and u["Restaurant Y"] == ["restaurants"]


def test_category_insight(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    merchants = X.insight_merchants(led, "groceries", top=3).collect()
    assert [r.merchant for r in merchants] == ["Grocery B", "Grocery A"]
    assert merchants[0].total == 30.0 and merchants[0].spend_share == 0.75
    months = X.insight_months(led, "groceries").orderBy("period").collect()
    assert [(r.period, r.total, r.transactions) for r in months] == [("2025-01", 10.0, 1), ("2025-02", 30.0, 1)]
    top = X.insight_top_transactions(led, "groceries", top=2).collect()
    assert len(top) == 2 and (top[0].date, top[0].merchant, top[0].amount) == ("2025-02-05", "Grocery B", 30.0)
    types = {r.type for r in X.insight_findings(led, "groceries").collect()}
    assert {"merchant_concentration", "recent_spike"} <= types


def test_profile(ledger_factory):
    r = A.profile(ledger_factory(L2, L2_RULES)).first()
    assert (r.transaction_count, r.category_count, r.merchant_count) == (4, 2, 4)
    r = A.profile(ledger_factory(L2, L2_RULES), approx=True).first()
    assert (r.category_count, r.merchant_count) == (2, 4)


def test_spend_summary_with_comparison(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    out = A.spend_summary(led, "category", "2025-01-01", "2025-02-28", comparison="previous_period", limit=10)
    rows = {r.label: r for r in out.collect()}
    assert sum(r.total_cents for r in rows.values()) == 8500
    assert rows["restaurants"].total_cents == 4500
    assert rows["restaurants"].delta_cents == 4500  # nothing in the previous 59 days
    assert abs(sum(r.share_pct for r in rows.values()) - 100.0) < 0.2


def test_find_page_cursor_and_fields(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    first = paging.find_page(led, "2025-01-01", "2025-02-28", limit=2, fields=["id", "date", "amountCents"]).collect()
    assert len(first) == 2 and first[0].next_cursor == "2"
    assert set(first[0].asDict()) == {"id", "date", "amountCents", "next_cursor", "total_approx"}
    second = paging.find_page(led, "2025-01-01", "2025-02-28", limit=2, cursor="2",
                              fields=["id", "date", "amountCents"]).collect()
    assert len(second) == 2 and second[0].next_cursor is None
    import pytest

    with pytest.raises(ValueError):
        paging.find_page(led, "2025-01-01", "2025-02-28", limit=500, fields=["secret"])


def test_keyset_page_matches_offset_page(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    first = paging.find_page(led, "2025-01-01", "2025-02-28", limit=2, fields=["id", "date"]).collect()
    nxt = paging.keyset_page(led, first[-1].date, first[-1].id, limit=2, start="2025-01-01", end="2025-02-28").collect()
    off = paging.find_page(led, "2025-01-01", "2025-02-28", limit=2, cursor="2", fields=["id"]).collect()
    assert [r.id for r in nxt] == [r.id for r in off]


def test_compare_periods(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    t = C.compare_periods(led, ("2025-02-01", "2025-02-28"), ("2025-01-01", "2025-01-31"), "none").first()
    assert (t.a_total_cents, t.b_total_cents, t.delta_cents) == (5500, 3000, 2500)
    drivers = C.top_drivers(led, ("2025-02-01", "2025-02-28"), ("2025-01-01", "2025-01-31"), "merchant").collect()
    reasons = {r.label: r.reason_code for r in drivers}
    assert reasons["Grocery B"] == "new" and reasons["Grocery A"] == "decrease"


def test_compare_is_antisymmetric(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    a, b = ("2025-02-01", "2025-02-28"), ("2025-01-01", "2025-01-31")
    ab = {r.key: r.delta_cents for r in C.compare_periods(led, a, b, "category").collect()}
    ba = {r.key: r.delta_cents for r in C.compare_periods(led, b, a, "category").collect()}
    assert ab == {k: -v for k, v in ba.items()}


def test_query_bundle(ledger_factory):
    import pytest

    led = ledger_factory(L2, L2_RULES)
    res = bundles.query_bundle(led, [{"name": "jan", "tool": "spend_summary",
                                      "args": {"start": "2025-01-01", "end": "2025-01-31", "group_by": "category"}}])
    assert res["jan"].agg(F.sum("total_cents")).first()[0] == 3000
    with pytest.raises(ValueError):
        bundles.query_bundle(led, [{"tool": "spend_summary", "args": {}}] * 6)


def test_insight_context_limits(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    ctx = bundles.insight_context(led, "2025-02-01", "2025-02-28", include=["totals", "top_categories", "drivers"],
                                  limits={"topCategories": 2, "drivers": 2}, persist=True)
    assert set(ctx) == {"_ledger", "totals", "top_categories", "drivers"}
    assert ctx["top_categories"].count() <= 2
    assert bundles.tall(ctx).count() >= 1
    ctx["_ledger"].unpersist()


def test_dashboard_bundle(ledger_factory):
    led = ledger_factory(L2, L2_RULES)
    d = bundles.dashboard(led, Filters.dashboard())
    assert d["overview"].first().transactions == 4
    assert d["transactions"].count() == 4


# ---- L3: assistant tools ------------------------------------------------------------------
L3_RULES = [("groceries", ["Costco", "Fresh"]), ("restaurants", ["Cafe", "Pizza"]), ("house", ["Home"])]
L3 = [("2026-01-04", "Bulk groceries", "Costco", 120), ("2026-03-08", "Bulk groceries", "Costco", 180),
      ("2026-04-01", "Dinner", "Pizza Palace", 50), ("2026-04-05", "Lunch", "Cafe Nero", 25),
      ("2026-04-08", "Groceries", "Fresh Market", 70), ("2026-05-02", "Groceries", "Fresh Market", 90)]


def test_assistant_tools(ledger_factory):
    led = ledger_factory(L3, L3_RULES)
    costco = A.group_transactions(led, "merchant", Filters(merchant="Costco")).first()
    assert (costco.merchant, costco.total) == ("Costco", 300.0)
    april = {r.category: r.total for r in A.summarize_by_category(led, Filters(start="2026-04-01", end="2026-04-30")).collect()}
    assert april["restaurants"] == 75.0
    periods = {"april": ("2026-04-01", "2026-04-30"), "may": ("2026-05-01", "2026-05-31")}
    g = {(r.period, r.category): r.total for r in C.period_breakdown(led, periods, Filters(category="groceries")).collect()}
    assert g[("april", "groceries")] == 70.0 and g[("may", "groceries")] == 90.0
    card = C.comparison_card(C.period_totals_filtered(led, periods, Filters(category="groceries")), "april", "may").first()
    assert card.trend == "up" and card.delta_value.startswith("+$20.00")


def test_assistant_raw_cap(ledger_factory):
    rows = [("2026-01-%02d" % (1 + i % 28), f"row {i}", "Shop", 1 + i) for i in range(61)]
    out = paging.get_transactions(ledger_factory(rows))
    assert out.count() == 50 and out.first().truncated is True


def test_recurring_and_unusual(ledger_factory):
    rows = [(f"2025-{m:02d}-03", "Gym", "Fitness Club", 40) for m in range(1, 7)]
    rows += [("2025-03-10", "Gym", "Fitness Club", 400)]
    led = ledger_factory(rows)
    rec = {r.merchant: r for r in X.recurring(led, "2025-01-01", "2025-06-30").collect()}
    assert rec["Fitness Club"].cadence in ("monthly", "irregular")
    months = X.recurring_months(led).first()
    assert months.transactions == 7 and len(months.months) == 6
    unusual = X.unusual_spend(led).collect()
    assert [float(r.amount) for r in unusual] == [400.0]
    spikes = X.anomalies_transactions(led, "2025-01-01", "2025-06-30").collect()
    assert [r.actual_cents for r in spikes] == [40000]


# ---- L4: no rules ----------------------------------------------------------------------------

def test_no_rules_is_misc(ledger_factory):
    led = ledger_factory([("2025-05-01", "Coffee", "Cafe", 3.5), ("2025-05-02", "Book", "Store", 12.0)], rules=[])
    assert [(r.category, r.total, r.transactions) for r in A.summarize_by_category(led).collect()] == [("misc", 15.5, 2)]
    r = A.summarize_by_category(led, Filters(start="2025-05-02")).first()
    assert (r.category, r.total, r.transactions) == ("misc", 12.0, 1)
