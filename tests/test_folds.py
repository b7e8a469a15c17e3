"""Ledgers and base states: hand-made paths, and the same result for any batch size."""

import random
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from fungo.functions import odds
from fungo.operators import ledger as l
from fungo.plans import plays
from fungo.sources.readers import event_file_scan


@pytest.fixture()
def batch_rows(spark):
    """Sets how many rows of a group reach the fold at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.unset(key)


def test_five_bets_with_one_pending(spark):
    bets = spark.createDataFrame([("s", 1, 0.10, 150.0, True), ("s", 2, 0.10, -200.0, True), ("s", 3, 0.05, 100.0, None), ("s", 4, 0.10, -110.0, False), ("s", 5, 0.033, 120.0, True)],
                                 "season string, n int, f double, ml double, won boolean")
    out = l.ledger_fold(bets, ["season"], ["n"], F.col("f"), F.col("ml"), F.col("won")).orderBy("n").collect()
    assert [r["bankroll"] for r in out] == [Dec("115.00"), Dec("120.75"), Dec("120.75"), Dec("108.67"), Dec("112.98")]


@pytest.mark.parametrize("chunk", [1000, 37])
def test_batches_give_one_path(spark, batch_rows, chunk):
    batch_rows(chunk)
    rng = random.Random(5)
    data = [(rng.choice("ab"), i, rng.random() * 0.1, rng.choice([150.0, -120.0, 105.0]), rng.random() < 0.5) for i in range(150)]
    bets = spark.createDataFrame(data, "g string, n int, f double, ml double, won boolean")
    out = l.ledger_fold(bets, ["g"], ["n"], F.col("f"), F.col("ml"), F.col("won"))
    got = {(r["g"], r["n"]): r["bankroll"] for r in out.collect()}
    for g in "ab":
        cents = 10000
        for _, n, f, ml, won in sorted((d for d in data if d[0] == g), key=lambda d: d[1]):
            share, net = int(f * 10**8 + 0.5), int((ml / 100 if ml > 0 else 100 / -ml) * 10**6 + 0.5)
            stake = (2 * cents * share + 10**8) // (2 * 10**8)
            cents += (2 * stake * net + 10**6) // (2 * 10**6) if won else -stake
            assert got[(g, n)] == Dec(cents) / 100


@pytest.mark.parametrize("chunk", [1000, 37])
def test_paths_beyond_a_bigint(spark, batch_rows, chunk):
    """A balance that compounds past 2^63 cents goes on exactly."""
    batch_rows(chunk)
    n = 400
    bets = spark.range(n).selectExpr("cast(1998 + id % 2 as int) season", "id as n", "0.6D as model_prob", "0.1D as edge", "100.0D as odds", "id % 6 < 4 as won")
    ends = {r["season"]: r for r in l.strategy_sweep(bets, ["season"], ["n"], [("s", 0.0, 1.0, 0.5, None, None), ("t", 0.5, 1.0, 0.5, None, None)]).collect()}
    path = l.ledger_fold(bets.filter("season = 1998"), ["season"], ["n"], F.lit(0.9), F.lit(900.0), F.col("won")).orderBy("n").collect()
    for season in (1998, 1999):
        cents, staked, wins = 10000, 0, 0
        for i in range(season - 1998, n, 2):
            stake = (2 * cents * 20000000 + 10**8) // (2 * 10**8)
            won = i % 6 < 4
            cents, staked, wins = cents + (stake if won else -stake), staked + stake, wins + won
        r = ends[season]
        assert (r["bets"], r["wins"], r["final_text"], r["staked_text"], r["pnl_text"]) == (n // 2, wins, str(cents), str(staked), str(cents - 10000))
        assert r["final_bankroll"] == (Dec(cents) / 100 if cents < 2**63 else None)
    cents, seen = 10000, set()
    for r in path:
        stake = (2 * cents * 9 * 10**7 + 10**8) // (2 * 10**8)
        cents += 9 * stake if r["won"] else -stake
        assert r["bankroll"] == (Dec(cents) / 100 if cents < 2**63 else None)
        seen.add(r["bankroll"] is None)
    assert seen == {True, False}


def test_bets_of_no_season_are_one_row(spark):
    """Each starts from the first balance, as one that follows no other; they are summed."""
    rows = [(season, n, 0.6, 0.1, 100.0, n % 2 == 0) for n, season in enumerate((None, 1998, None, None, 1998))]
    bets = spark.createDataFrame(rows, "season int, n long, model_prob double, edge double, odds double, won boolean")
    got = {r["season"]: r for r in l.strategy_sweep(bets, ["season"], ["n"], [("s", 0.0, 1.0, 0.5, None, None)]).collect()}
    assert len(got) == 2
    r = got[None]  # 20 dollars each: won, won, lost
    assert (r["bets"], r["wins"], r["staked"], r["pnl"], r["final_bankroll"]) == (3, 2, Dec(60), Dec(20), Dec(80))
    r = got[1998]  # lost 20 of 100, won 16 of 80
    assert (r["bets"], r["wins"], r["staked"], r["pnl"], r["final_bankroll"]) == (2, 1, Dec(36), Dec(-4), Dec(96))


def test_money_rounds_halves_up(spark):
    row = spark.range(1).select(odds.money(F.lit(1.115)).alias("a"), odds.money(F.lit(1.005)).alias("b"), odds.pnl(F.lit(0.5).cast("decimal(18,2)"), F.lit(101.0), F.lit(True)).alias("c")).first()
    assert tuple(row) == (Dec("1.12"), Dec("1.01"), Dec("0.51"))


def lines(spark, *text):
    return spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(text)], "file string, block long, line long, value string")


HEAD = ("id,NYA202404050", "info,visteam,BOS", "info,hometeam,NYA", "info,umphome,ump1", 'start,p1,"A One",0,9,1', 'start,p2,"B Two",1,9,1')


@pytest.mark.parametrize("chunk", [1000, 3])
def test_base_states(spark, batch_rows, chunk):
    batch_rows(chunk)
    play = lambda inn, side, who, ev: f"play,{inn},{side},{who},00,X,{ev}"
    text = [*HEAD, play(1, 0, "a", "S8"), play(1, 0, "b", "W"), play(1, 0, "c", "W"), play(1, 0, "d", "W"), play(1, 0, "e", "HR/F78.1-H;2-H"), play(1, 0, "f", "PB"),
            play(1, 0, "g", "D7"), play(1, 0, "h", "SB3"), play(1, 0, "i", "CS2(26)"), play(1, 0, "j", "64(1)3/GDP"), play(1, 1, "k", "HR"), play(1, 1, "l", "E6.B-2"), play(1, 1, "m", "S7.2XH")]
    out = plays.base_states(event_file_scan(lines(spark, *text))).orderBy("line").collect()
    assert [r["runs_scored"] for r in out] == [0, 0, 0, 1, 4, 0, 0, 0, 0, 0, 1, 0, 0]
    assert [r["state_after"] for r in out] == ["0_1", "0_3", "0_7", "0_7", "0_0", "0_0", "0_2", "0_2", "1_2", "3_0", "0_0", "0_2", "0_1"]
    assert [r["half_seq"] for r in out] == [0] * 10 + [1] * 3


def test_pitcher_logs(spark):
    text = [*HEAD, "play,1,0,a,00,X,K", "play,1,0,b,00,X,HR", "sub,p3,\"C Three\",1,9,1", "play,1,0,c,00,X,64(1)3/GDP", "play,1,1,d,00,X,S8.3-H", "id,BOS202404060", "play,1,0,z,00,X,K"]
    got = {r["pitcher_id"]: (r["team_side"], r["is_starter"], r["outs_recorded"], r["runs_allowed"], r["home_team"]) for r in plays.pitcher_logs(event_file_scan(lines(spark, *text))).collect()}
    assert got == {"p1": (0, True, 0, 1, "NYY"), "p2": (1, True, 1, 1, "NYY"), "p3": (1, False, 2, 0, "NYY")}


def test_pitcher_logs_name_the_first_announcement(spark):
    """A pitcher who comes back keeps the first announcement; plays are moved without their texts."""
    text = [*HEAD, "play,1,0,a,00,X,K", "sub,p3,\"C Three\",1,9,1", "play,1,0,b,00,X,K", "sub,p2,\"Another Name\",1,9,1", "play,1,0,c,00,X,HR"]
    out = plays.pitcher_logs(event_file_scan(lines(spark, *text)))
    got = {r["pitcher_id"]: (r["pitcher_name"], r["is_starter"], r["outs_recorded"], r["runs_allowed"]) for r in out.collect()}
    assert got == {"p1": ("A One", True, 0, 0), "p2": ("B Two", True, 1, 1), "p3": ("C Three", False, 1, 0)}
    # file scan twice, games, and one join of pitchers with what games tell
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 5
