"""Missing stays missing, and the intervals match published figures."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import chains, text, values


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_nan_and_infinity_are_null(spark):
    r = one(spark, values.clean(F.lit(float("nan"))), values.clean(F.lit(float("-inf"))), values.clean(F.lit(2.0)))
    assert tuple(r) == (None, None, 2.0)


@pytest.mark.parametrize(
    "raw, want", [("1e2", 100.0), (" 5 ", 5.0), ("NaN", None), ("inf", None), ("1d", None), ("", None), ("true", None), (None, None)]
)
def test_number_text(spark, raw, want):
    assert one(spark, values.number(F.lit(raw).cast("string")))[0] == want


def test_guards_do_not_raise_under_ansi(spark):
    r = one(spark, values.div(F.lit(1.0), F.lit(0.0)), values.ratio(F.lit(1), F.lit(0)), values.pressure(F.lit(None), F.lit(3)), values.whole(F.lit("-3.9")))
    assert tuple(r) == (None, None, None, -3)


def test_mean_skips_missing_and_scale_keeps_null(spark):
    null = F.lit(None).cast("double")
    r = one(spark, values.mean_of(null, F.lit(4.0)), values.mean_of(null, null), values.scale(null, 0, 1), values.scale(F.lit(9.0), 0, 1))
    assert tuple(r) == (4.0, None, None, 100.0)


def test_window_ratio_flags_saturation(spark):
    a, pinned = values.window_ratio(F.lit(10.0), 1.0, F.lit(10.0), 6.0)
    b, free = values.window_ratio(F.lit(10.0), 1.0, F.lit(30.0), 6.0)
    r = one(spark, a, pinned, b, free)
    assert r[0] == pytest.approx(6.0) and r[1] is True
    assert r[2] == pytest.approx(2.0) and r[3] is False


def test_published_intervals(spark):
    low, high = values.wilson(F.lit(17), F.lit(82))
    alow, ahigh = values.auc_interval(F.lit(0.6733), F.lit(17), F.lit(65))
    r = one(spark, low, high, alow, ahigh)
    assert [round(x, 3) for x in r] == [0.134, 0.307, 0.520, 0.827]


def test_perfect_separation_has_width(spark):
    low, high = values.auc_interval(F.lit(1.0), F.lit(2), F.lit(2))
    r = one(spark, low, high)
    assert 0.4 < r[0] < 0.6 and r[1] == 1.0


def test_timestamps(spark):
    r = one(spark, values.to_ms(F.lit("2024-01-01T00:00:00Z")), values.to_ms(F.lit("2024-01-01T00:00:00")), values.to_ms(F.lit("soon")))
    assert tuple(r) == (1704067200000, 1704067200000, None)


def test_chain_names(spark):
    r = one(spark, chains.canonical(F.lit(" Binance Smart Chain ")), chains.is_evm(F.lit("nowhere")), chains.is_evm(F.lit("solana")), chains.canonical(F.lit("--")))
    assert tuple(r) == ("bnb", None, False, None)
    with pytest.raises(ValueError):
        chains.requested(spark.range(1).select(F.lit("x").alias("chain")), ["robinhood"])
    bound = {r.name: r for r in chains.bound_sources(spark, "robinhood=rh-0, junk, New = n1,=x,robinhood=rh-1,base=base").collect()}
    assert {n for n, r in bound.items() if r.offered} == {*chains.DEFAULT_NAMES, "robinhood", "new"}
    assert (bound["robinhood"].source_id, bound["robinhood"].known, bound["new"].label) == ("rh-1", True, "new")
    assert not bound["new"].known and bound["sui"].source_id == "sui"


def test_links_keep_order_and_unknown(spark):
    items = text.link_items(F.array(F.lit("https://x.com/a"), F.lit('{"label":"Telegram","url":"https://t.me/b"}'), F.lit("https://t.me/c")))
    none = text.link_items(F.lit(None).cast("array<string>"))
    r = one(spark, text.first_url(items, "telegram"), text.first_url(items, "x"), text.declares(items, "website"), text.declares(none, "x"))
    assert tuple(r) == ("https://t.me/b", "https://x.com/a", False, None)


def test_handles(spark):
    raw = ["https://t.me/abcd", "@wxyz_1", "PAIRZ", "a b", None]
    rows = spark.createDataFrame([(x,) for x in raw], "v string").select(text.handle("v")).collect()
    assert [r[0] for r in rows] == ["abcd", "wxyz_1", "PAIRZ", None, None]
