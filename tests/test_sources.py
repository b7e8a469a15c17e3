"""Names, files, upserts, policies, streams and metric identities."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from fungo.functions import labels, names, odds
from fungo.ml import blend, metrics
from fungo.operators import decision as d
from fungo.sources import readers as r, sinks as s


@pytest.mark.parametrize("raw, want", [
    ("Rodríguez, José", "jose rodriguez"), ("Ronald Acuña Jr.", "ronald acuna"), ("Ryu, Hyun-Jin", "hyun jin ryu"), ("Michael Soroka III", "mike soroka"),
    ("  Zachary   Wheeler ", "zach wheeler"), ("JosÃ© PeÃ±a", "jose pena"), ("Rodr\\xc3\\xadguez, Andrew", "andy rodriguez"), ("Griffey Jr., Ken", "ken griffey")])
def test_person_names(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "n string")
    assert df.select(names.normalize_person_name(F.col("n"))).first()[0] == want


def test_csv_bad_rows_and_fallback(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("a,b,c\n1,2024-04-01,1.5\nx,2024-04-02,2.5\n3,,NaN\n")
    schema = T.StructType().add("a", "integer").add("b", "date").add("c", "double")
    rows = [tuple(x) for x in r.csv_scan_typed(spark, str(f), schema).orderBy("a").collect()]
    assert rows == [(None, dt.date(2024, 4, 2), 2.5), (1, dt.date(2024, 4, 1), 1.5), (3, None, None)]
    assert r.csv_scan_typed(spark, str(f), schema, keep_bad=True).filter("_corrupt_record is not null").count() == 1
    assert r.table_scan_or_fallback(spark, "absent_table", str(f), schema).count() == 3


def test_text_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "g.txt").write_text("id,NYA202404050\nplay,1,0,a,00,X,K\nid,BOS202404060\nplay,1,0,b,00,X,S8\n")
    out = r.event_file_scan(r.ordered_text(spark, str(tmp_path))).filter("record = 'play'").orderBy("line").collect()
    assert [(x["game_id"], x["f3"]) for x in out] == [("NYA202404050", "a"), ("BOS202404060", "b")]


def test_append_and_registry(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "model_id string, v int")
    for rows in ([("a", 1)], [("a", 1)]):
        s.append_log(make(rows), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    s.registry_append(spark, str(tmp_path / "r"), make([("a", 1), ("b", 2), ("b", 3)]), order=["v"])
    table = s.registry_append(spark, str(tmp_path / "r"), make([("b", 0), ("c", 4)]))
    assert sorted((r.model_id, r.v) for r in table.read().collect()) == [("a", 1), ("b", 0), ("c", 4)]


def test_bad_rows_go_to_quarantine_in_one_pass(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1, 50.0), (2, None), (3, -120.0), (4, 30.0), (5, 150.0)], "k int, ml double")
    got = s.write_checked(df.mapInArrow(count, df.schema), str(tmp_path / "t"), {"missing": F.col("ml").isNull(), "small": F.abs("ml") < 100, "even": F.col("k") % 2 == 0})
    assert got == {"rows": 5, "good": 2, "missing": 1, "small": 2, "even": 0} and read.value == 5
    assert sorted(map(tuple, s.read_checked(spark, str(tmp_path / "t")).collect())) == [(3, -120.0), (5, 150.0)]
    assert sorted((r.k, r.reason) for r in s.read_checked(spark, str(tmp_path / "t"), False).collect()) == [(1, "small"), (2, "missing"), (4, "small")]


def test_rules_never_see_the_season_they_are_for(spark):
    rows = [(s, b, 0.05 + (i % 9) / 100, 150.0, (i * 7 + s) % 10 < 6) for s in (2001, 2002, 2003) for b in ("+130:+170", "+170+") for i in range(60)]
    bets = spark.createDataFrame(rows, "season int, odds_bucket string, edge double, odds double, won boolean").withColumn("model_prob", F.lit(0.5))
    flipped = bets.withColumn("won", F.when(F.col("season") == 2003, ~F.col("won")).otherwise(F.col("won")))
    rules = lambda df: sorted(map(tuple, d.tuned_rules(d.tune_thresholds(df)).collect()))
    assert rules(bets) == rules(flipped)
    assert [r for r in rules(bets) if r[0] == 2001] == [(2001, "+130:+170", 0.06)] and len([r for r in rules(bets) if r[0] == 2003]) == 2
    out = d.walk_forward_rules(bets)
    assert out.count() == 360 and out.where("season = 2001 and odds_bucket = '+170+' and should_bet").count() == 0


@pytest.mark.parametrize("bucket, phase, want", [("x", "late", 1.0), ("x", "mid", 2.0), ("y", "early", 3.0), ("y", "mid", 4.0), (None, "mid", None)])
def test_rule_precedence(spark, bucket, phase, want):
    rules = spark.createDataFrame([("x", "late", 1.0, 0.0, 0), ("x", "late", 9.0, 0.0, 1), ("x", "all", 2.0, 0.0, 2), ("all", "early", 3.0, 0.0, 3), ("all", "all", 4.0, 0.0, 4)],
                                  "bucket string, season_phase string, min_edge double, min_model_prob double, position int")
    df = spark.createDataFrame([(bucket, phase)], "odds_bucket string, season_phase string")
    assert d.resolve_policy_rule(df, rules).first()["min_edge"] == want


def test_odds_edges(spark):
    vals = [-200.0, -180.0, -140.0, -115.0, 100.0, 130.0, 170.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "ml double")
    assert [x[0] for x in df.select(odds.odds_bucket(F.col("ml"))).collect()] == ["<-180", "-180:-140", "-140:-115", "-115:+100", "+100:+130", "+130:+170", "+170+", None]
    assert [x[0] for x in df.limit(2).select(odds.american_format(F.col("ml"))).collect()] == ["-200", "-180"]


def test_auc_identities(spark):
    df = spark.createDataFrame([("m", p, y) for p, y in ((0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.9, 0))], "model string, p double, home_win int")
    one = metrics.auc(df, ["model"]).first()["auc"]
    two = metrics.auc(df.withColumn("p", 1 - F.col("p")), ["model"]).first()["auc"]
    assert one == pytest.approx((1 + 0.5 + 1 + 1) / 6) and one + two == pytest.approx(1)
    alone = df.withColumn("b", blend.weighted_blend({"p": 0.4, "none": 0.6}, df.columns))
    assert all(x["b"] == pytest.approx(x["p"]) for x in alone.collect())


def test_labels(spark):
    df = spark.createDataFrame([("1 2 x 3 4 5 6 7 8 9 10",)], "ids string")
    assert df.select(labels.split_ids(F.col("ids"))).first()[0] == list(range(1, 10))
