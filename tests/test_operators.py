"""Sources, merges, streaming and decision rules on small tables."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import decisions, merge, metrics, quality
from tidemark.sources import files
from tidemark.streaming import ingest


def test_csv_with_quotes_and_breaks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Install Time,Media Source,Campaign ID,Country Code,Platform\n"2024-01-02 10:00","Face,book ""x""\nAds",7,us,iPhone\n2024-01-02 11:00,,7,usa,tv\nbad,a,b,US,ios\n')
    raw = files.read_csv(spark, str(tmp_path / "r.csv"))
    assert raw.columns == ["install_time", "media_source", "campaign_id", "country_code", "platform"]
    got = {(r["media_source"], r["country"], r["platform"]): r["installs"] for r in files.install_facts(raw).collect()}
    assert got == {('Face,book "x"\nAds', "US", "ios"): 1, (None, None, "unknown"): 1}


def test_insights_keep_what_is_not_reported_null(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"data": [{"date_start": "2024-01-01", "campaign_id": "9", "spend": "1.5", "impressions": "10", "country": "us", "account_currency": "usd"}, {"spend": "2"}]}')
    rows = files.delivery_facts(files.read_insights(spark, str(tmp_path / "p.json"))).collect()
    good = next(r for r in rows if not r["rejected"])
    assert (good["spend"], good["clicks"], good["link_clicks"], good["country"], good["currency"]) == (Decimal("1.500000"), 0, None, "US", "USD")
    assert sum(r["rejected"] for r in rows) == 1


def test_unpivot_prefers_components(spark):
    wide = spark.createDataFrame([(1, 5, 2.0, None, 9.0, 0.0, 4.0), (2, 0, None, None, 7.0, 1.0, None)], "id int, installs int, iap double, ad double, total double, iap_1d double, ad_7d double")
    got = {(r["id"], r["revenue_type"], r["age"], float(r["revenue"])) for r in files.unpivot_revenue(wide, ["id"]).collect()}
    assert got == {(1, "iap", None, 2.0), (1, "ad", 7, 4.0), (2, "total", None, 7.0)}


def test_merge_is_idempotent_and_null_is_not_zero(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", None), ("c", "x", 3)], "k string, d string, m int")
    new = spark.createDataFrame([("a", None, 1), ("b", "x", 0), ("e", None, 5)], "k string, d string, m int")
    merged = merge.merge_facts(old, new, ["k", "d"], ["m"])
    assert {(r["k"], r["outcome"]) for r in merged.collect()} == {("a", "unchanged"), ("b", "restated"), ("c", "kept"), ("e", "inserted")}
    again = merge.merge_facts(merged.select("k", "d", "m"), new, ["k", "d"], ["m"])
    assert {r["outcome"] for r in again.collect()} == {"unchanged", "kept"}


def test_human_decisions_stay(spark):
    schema = "source string, target string, status string, method string, confidence double"
    stored = spark.createDataFrame([("a", "x", "manually_verified", "manual", 1.0), ("b", "y", "matched_exact", "id", 1.0)], schema)
    computed = spark.createDataFrame([("a", "x", "ambiguous", "name", 0.2), ("c", None, "unmatched", "none", 0.0)], schema)
    got = {r["source"]: r["status"] for r in merge.merge_mappings(stored, computed).collect()}
    assert got == {"a": "manually_verified", "c": "unmatched"}


def test_daily_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = ingest.daily_counts(ingest.once_each(ingest.timed(ingest.read_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"))))
    query = stream.writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["day"], r["event_type"]): r["events"] for r in spark.table("daily").collect()}
    want = {(r["day"], r["event_type"]): r["n"] for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_anomalies_of_known_series(spark):
    start = dt.date(2024, 1, 1)
    cases = {"drop": [100] * 14 + [20], "rise": [100] * 14 + [400], "noise": [110, 90] * 7 + [130], "spike": [110, 90] * 7 + [160], "short": [100] * 5 + [500], "small": [10] * 14 + [15], "slight": [1000] * 14 + [1200], "zero": [0] * 14 + [100]}
    rows = [(k, "spend", start + dt.timedelta(i), float(v)) for k, vs in cases.items() for i, v in enumerate(vs)]
    got = {r["campaign"]: r for r in decisions.anomalies(spark.createDataFrame(rows, "campaign string, metric string, day date, value double")).collect()}
    assert set(got) == {"drop", "rise", "spike", "zero"}
    assert (got["drop"]["direction"], got["drop"]["center"], got["drop"]["deviation_pct"], got["drop"]["z"]) == ("down", 100.0, -80.0, None)
    assert got["spike"]["z"] == round(60 / 14.826, 3) and got["zero"]["deviation_pct"] is None


def test_metric_gates(spark):
    values = spark.range(1).select(F.create_map(*(F.lit(x) for x in ("clicks", 20.0, "impressions", 10.0, "spend", 5.0, "spend_currencies", 2.0))).alias("m"))
    got = {r["metric"]: r for r in metrics.evaluate(values, metrics.OPERATIONAL).collect()}
    assert len(got) == 24 and len(metrics.COHORT) == 18
    assert (got["ctr"]["value"], got["ctr"]["reason"]) == (None, "below_minimum")
    assert (got["spend"]["availability"], got["spend"]["value"]) == ("blocked", None)
    assert got["link_clicks"]["reason"] == "not_reported"


def test_names_and_platforms(spark):
    row = spark.range(1).select(
        scalars.name_key(F.lit("  FB_Reveal-Rush (US) ")).alias("key"), scalars.embedded_names(F.lit("a (b (c) ) (d)")).alias("inside"), scalars.name_key(F.lit("ﬁne Ｎame")).alias("folded"),
        F.array(*(scalars.platform(F.lit(p)) for p in ("iPad", "ANDROID_tv", "mobile_web", "studios", None))).alias("platforms"), scalars.rounded(F.lit(-2.5), 0).alias("half"), scalars.chunks(F.lit("2024-01-01").cast("date"), F.lit("2024-01-10").cast("date"), 7).alias("chunks"),
    ).first()
    assert row["key"] == "fb reveal rush us" and row["inside"] == ["c", "d"] and row["folded"] == "fine name"
    assert row["platforms"] == ["ios", "android", "web", "unknown", "unknown"] and row["half"] == -2.0
    assert [(c["from"].day, c["to"].day) for c in row["chunks"]] == [(1, 7), (8, 10)]


def test_quality_of_one_row(spark):
    rows = [("2024-01-05", "c", "USD", -1.0, 10, 30), ("2024-02-05", "", "eur", 1.0, 0, 0), ("2024-02-05", "", "eur", 1.0, 0, 0)]
    batch = spark.createDataFrame(rows, "d string, campaign string, currency string, spend double, impressions int, clicks int").withColumn("report_date", F.col("d").cast("date"))
    got = {r["check_key"]: r["n"] for r in quality.counts(quality.check_marketing(batch, "2024-01-01", "2024-01-31", ["report_date", "campaign"])).collect()}
    assert got == {"marketing.negative_measure": 1, "marketing.clicks_exceed_impressions": 1, "marketing.date_outside_window": 2, "marketing.spend_without_delivery": 2, "marketing.missing_campaign_id": 2, "marketing.invalid_currency": 2, "marketing.duplicate_dimension_tuple": 1}


def test_a_half_written_version_is_written_anew(spark, tmp_path):
    """A folder without a success marker is what a failed write left; complete versions stay, old ones can go."""
    root, rows = str(tmp_path / "table"), spark.createDataFrame([("a", 1)], "k string, m long")
    merge.save_version(rows, root, 1)
    (tmp_path / "table" / "version=0000000002").mkdir()
    (tmp_path / "table" / "version=0000000002" / "part-0.parquet").write_text("torn")
    assert merge.latest_version(spark, root)[0] == 1
    merge.save_version(rows.withColumn("m", F.lit(2).cast("long")), root, 2)
    merge.save_version(rows, root, 2)
    assert merge.latest_version(spark, root)[0] == 2 and merge.latest_version(spark, root)[1].first()["m"] == 2
    assert merge.drop_versions(spark, root, keep=1) == 1 and merge.latest_version(spark, root)[0] == 2


def test_only_touched_days_are_merged(spark):
    stored = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "2", 3)], "k string, day string, m int")
    written = spark.createDataFrame([("b", "2", 5)], "k string, day string, m int")
    got = {(r["k"], r["m"], r["outcome"]) for r in merge.restate_days(stored, written, "day", ["k", "day"], ["m"]).collect()}
    assert got == {("b", 5, "restated"), ("c", 3, "kept")}


def test_channel_filter_reads_normal_sources(spark):
    from tidemark.operators import populations

    rows = spark.createDataFrame([("Facebook Ads",), ("google adwords",), (None,), ("other",)], "media_source string")
    of = lambda c: [r[0] for r in populations.Filters(channel=c).on(rows, "day").collect()]
    assert (of("paid_social"), of("paid_search"), of("organic"), of("unknown")) == (["Facebook Ads"], ["google adwords"], [None], ["other"])


def scope(spark, **given):
    """One scope that clears every gate, but for what is given."""
    row = {
        "campaign": "c", "is_app": False, "provider_missing": False, "operational": True, "ambiguous": False, "mapping_status": "matched_exact", "mapping_confidence": 1.0, "spend_coverage": 90.0, "ambiguous_spend": 0.0, "marketing_status": "fresh",
        "attribution_status": "fresh", "sync_errors": 0, "as_of": dt.date(2024, 2, 1), "spend_currencies": ["USD"], "revenue_currencies": ["USD"], "error_findings": 0, "data_anomalies": 0, "open_anomalies": 0, "mature_days": 10, "immature_days": 2, "uncovered_days": 0,
        "mature_spend": 100.0, "mature_installs": 50, "mature_revenue": 50.0, "settled_spend": 100.0, "settled_installs": 50, "direction": "stable",
    } | given
    kinds = {bool: "boolean", str: "string", float: "double", int: "long", dt.date: "date", list: "array<string>"}
    schema = ", ".join(f"{k} {'date' if k == 'as_of' else 'string' if k.endswith('_status') else kinds[type(v)]}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


RETURN = decisions.Policy(target_d7=0.5, capabilities=frozenset({("total", 7)}))
FLOOR = decisions.Policy(target_d7=0.5, capabilities=frozenset({("iap", 7)}))
CEILING = decisions.Policy(max_cpi=2.0, currency="USD")
CASES = [
    (RETURN, {}, "hold", None), (RETURN, {"provider_missing": True}, "insufficient_data", "missing_provider"), (RETURN, {"operational": False, "ambiguous": True}, "investigate", "ambiguous_mapping"), (RETURN, {"operational": False}, "insufficient_data", "insufficient_coverage"),
    (RETURN, {"is_app": True, "spend_coverage": 79.996}, "insufficient_data", "insufficient_coverage"), (RETURN, {"is_app": True, "ambiguous_spend": 11.0}, "investigate", "ambiguous_mapping"), (RETURN, {"marketing_status": "error"}, "investigate", "provider_stale"),
    (RETURN, {"sync_errors": 1}, "investigate", "provider_stale"), (RETURN, {"attribution_status": None}, "insufficient_data", "provider_stale"), (RETURN, {"attribution_status": "delayed"}, "hold", None), (RETURN, {"as_of": None}, "insufficient_data", "provider_stale"),
    (RETURN, {"spend_currencies": ["EUR"]}, "investigate", "mixed_currency"), (RETURN, {"error_findings": 1}, "investigate", "data_quality_finding"), (RETURN, {"data_anomalies": 1}, "investigate", "anomalous_data"), (RETURN, {"open_anomalies": 1}, "investigate", "anomalous_data"),
    (RETURN, {"mature_days": 0, "uncovered_days": 1}, "insufficient_data", "provider_stale"), (RETURN, {"mature_days": 0}, "insufficient_data", "immature_cohort"), (RETURN, {"mature_days": 2}, "insufficient_data", "immature_cohort"), (RETURN, {"mature_installs": 24}, "insufficient_data", "missing_denominator"),
    (RETURN, {"mature_revenue": 57.5}, "scale", None), (RETURN, {"mature_revenue": 60.0, "direction": "deteriorating"}, "hold", "trend_contradicts"), (RETURN, {"mature_revenue": 42.5}, "reduce", None), (RETURN, {"mature_revenue": 40.0, "direction": "improving"}, "hold", "trend_contradicts"),
    (FLOOR, {"mature_revenue": 40.0}, "hold", "partial_return"), (FLOOR, {"mature_revenue": 60.0}, "scale", None), (CEILING, {"settled_installs": 50}, "hold", None), (CEILING, {"settled_installs": 60}, "scale", None), (CEILING, {"settled_installs": 40}, "reduce", None),
    (CEILING, {"settled_installs": 20}, "insufficient_data", "missing_denominator"), (CEILING, {"spend_currencies": ["EUR"], "revenue_currencies": []}, "hold", "mixed_currency"), (decisions.Policy(), {}, "hold", "no_target"), (decisions.Policy(target_d7=0.5), {}, "hold", "unsupported_metric"),
]


def test_decision_gates(spark):
    """Every gate by itself, and the bands at their edges."""
    for policy, given, signal, blocker in CASES:
        row = decisions.evaluate(scope(spark, **given), policy).first()
        assert (row["signal"], row["blocker"]) == (signal, blocker), given


def test_return_measure():
    of = lambda **p: decisions.return_measure(decisions.Policy(**p))
    both = frozenset({("total", 7), ("iap", 7), ("total", 1)})
    assert of(target_d7=0.5, target_d1=0.2, capabilities=both) == decisions.Measure(7, "total", False, 0.5)
    assert of(target_d7=0.5, capabilities=frozenset({("ad", 7), ("iap", 7)})) == decisions.Measure(7, "iap", True, 0.5)
    assert of(target_d7=0.5, target_d1=0.2, capabilities=frozenset({("total", 1)})) == decisions.Measure(1, "total", False, 0.2)
    assert of(target_d7=0.0, capabilities=both) is None and of(capabilities=both) is None
