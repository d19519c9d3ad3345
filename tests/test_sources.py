import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelens.sources import events as ev
from tidelens.sources import normalise as nm

CSV = """amplitude_id,event_type,event_time,platform,event_properties
1,homepage_viewed,2024-03-01 10:00:00,IOS,
1,checkout_completed,2024-03-02T11:00:00Z,Android,"{""order_total"": 12.5, ""order_id"": ""o1""}"
2,checkout_completed,2024-03-03 11:00:00,ios,not json
"""


def test_csv_types_and_lower_case(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text(CSV)
    rows = ev.canonical(ev.load(spark, str(p))).orderBy("event_time").collect()
    assert [r["platform"] for r in rows] == ["ios", "android", "ios"]
    assert rows[1]["event_time"] == dt.datetime(2024, 3, 2, 11) and rows[1]["user_id"] == 1


def test_required_columns_and_suffix(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("amplitude_id,event_type\n1,a\n")
    with pytest.raises(ev.SchemaError):
        ev.load(spark, str(p))
    with pytest.raises(ValueError):
        ev.load(spark, str(tmp_path / "x.json"))


def test_load_multiple_names_bad_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "b.csv").write_text("x\n1\n")
    names, skipped = [str(tmp_path / n) for n in ("a.csv", "b.csv", "absent.parquet")], {}
    df = ev.load_multiple(spark, names, skipped=skipped)
    assert {r["_source_file"] for r in df.select("_source_file").distinct().collect()} == {"a.csv"}
    assert set(skipped) == set(names[1:]) and "missing required columns" in skipped[names[1]]
    with pytest.raises(ValueError, match="absent.parquet"):
        ev.load_multiple(spark, names)
    with pytest.raises(ValueError):
        ev.load_multiple(spark, [str(tmp_path / "b.csv")])


def test_date_range_is_real(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    df = ev.load_date_range(spark, str(tmp_path), "2024-03-02", "2024-03-02", "*.csv")
    assert [r["event_type"] for r in df.collect()] == ["checkout_completed"]


def test_order_frame_defaults(make_events):
    o = "checkout_completed"
    e = make_events(
        [
            (1, 0, o, '{"order_id":"1","merchant_name":"M","order_total":10,"promo_code":""}'),
            (1, 1, o, '{"merchant_name":"M","coupon_code":"C","discount_amount":2}'),
            (1, 2, o, '{"merchant_name":"Unknown","order_total":5}'),
            (1, 3, o, "broken"),
            (1, 4, o, None),
            (1, 5, o, '{"merchant_id":"m9","promo_code":"N/A","order_total":null}'),
        ]
    )
    got = {r["merchant"]: r for r in nm.orders_frame(e).orderBy("event_time").collect()}
    assert set(got) == {"M", "m9"}
    assert nm.orders_frame(e, keep_unknown=True).count() == 4
    rows = nm.orders_frame(e).orderBy("event_time").collect()
    assert [(r["has_promo"], r["promo_code"], r["order_total"]) for r in rows] == [(False, None, 10.0), (True, "C", 0.0), (True, "N/A", 0.0)]
    feats = nm.order_properties(e).orderBy("event_time").select("uses_promo").collect()
    assert [r[0] for r in feats] == [False, False, False, False, False, False]


def test_order_line_shapes(make_events):
    o = "checkout_completed"
    e = make_events(
        [
            (1, 0, o, '{"order_id":"1","products":[{"id":"p1","name":"A"},{"product_id":"p2","product_name":"B","quantity":3,"price":2.5}]}'),
            (1, 1, o, '{"order_id":"2","products":["C","D"]}'),
            (1, 2, o, '{"order_id":"3","products":[],"product_names":["E"]}'),
            (1, 3, o, '{"order_id":"4","merchant_name":"Shop","order_total":7,"products_quantity":2}'),
            (1, 4, o, "broken"),
        ]
    )
    got = sorted((r["order_id"], r["product_id"], r["product_name"], r["quantity"], r["price"]) for r in nm.order_lines_frame(e).collect())
    assert got == [
        ("1", "p1", "A", 1.0, 0.0),
        ("1", "p2", "B", 3.0, 2.5),
        ("2", "C", "C", 1.0, 0.0),
        ("2", "D", "D", 1.0, 0.0),
        ("3", "E", "E", 1.0, 0.0),
        ("4", "order_4", "Order from Shop", 2.0, 7.0),
    ]


def test_deliveries_ignore_null_ids(make_events):
    o, d = "checkout_completed", "order_delivered"
    e = make_events(
        [
            (1, 0, o, '{"order_id":"1"}'),
            (1, 0, o, "{}"),
            (2, 0, o, '{"order_id":"2"}'),
            (1, 40, d, '{"order_id":"1"}'),
            (1, 45, d, '{"order_id":"1"}'),
            (1, 50, d, "{}"),
        ]
    )
    m = nm.match_deliveries(nm.checkouts_frame(e), nm.delivered_frame(e))
    assert sorted((r["order_id"] or "", r["minutes"] or -1.0) for r in m.collect()) == [("", -1.0), ("1", 40.0), ("1", 45.0), ("2", -1.0)]


def test_search_keys(make_events):
    e = make_events(
        [
            (1, 0, "search_made", '{"query":"  Pizza ","results_count":0}'),
            (1, 1, "search_made", '{"search_term":"tea","num_results":3}'),
            (1, 2, "search_made", '{"search_query":"  "}'),
            (1, 3, "search_made", None),
        ]
    )
    got = sorted((r["query"], r["results_count"], r["zero_results"]) for r in nm.searches_frame(e).collect())
    assert got == [("pizza", 0.0, True), ("tea", 3.0, False)]


def test_order_properties_are_read_in_one_pass(spark, make_events):
    """The JSON is made once, however many columns and filters mention its properties; repeated keys keep their first value."""
    made = make_events([(1, 0, "checkout_completed")]).withColumn("event_properties", F.to_json(F.struct(F.col("event_type").alias("merchant_name"))))
    plan = nm.orders_frame(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "json_tuple" in plan.split("Generate")[1].splitlines()[0]
    assert not any("get_json_object" in line or "StructsToJson" in line for line in plan.split("Generate")[0].splitlines())
    odd = ['{"merchant_name": "a", "merchant_name": "b"}', '{"merchant_name": "a"', '[{"merchant_name": "a"}]', '{"merchant_name": {"x": 1.50}}', None]
    rows = nm.orders_frame(make_events([(i, i, "checkout_completed", p) for i, p in enumerate(odd)])).collect()
    assert sorted((r["user_id"], r["merchant"]) for r in rows) == [(0, "a"), (3, '{"x":1.5}')]
