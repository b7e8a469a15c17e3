"""Typed scans of landed files and flattening of nested records.

Flatteners take a frame with a text column, so the same code serves files, tables
and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fungo.functions import teams
from fungo.functions.labels import eastern_date
from fungo.operators import ordered
from fungo.operators.project import coerce_numeric, ensure_columns
from fungo.sources.schemas import nan_to_null

CORRUPT = "_corrupt_record"


def csv_scan_typed(spark: SparkSession, path: str, schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """CSV with a header and a fixed schema; a field that does not fit is null, the rest of its row stays.

    Lines are parsed as a column, so that what is null does not depend on the columns a
    query goes on to read. With ``keep_bad`` the text of such a row is in ``CORRUPT``, from
    which a quarantine table can be written.
    """
    header = ",".join(schema.fieldNames())
    lines = spark.read.text(path).filter(F.trim(F.replace(F.col("value"), F.lit('"'), F.lit(""))) != header)
    return csv_lines_typed(lines, schema, keep_bad=keep_bad)


def csv_lines_typed(lines: DataFrame, schema: T.StructType, value: str = "value", keep_bad: bool = False) -> DataFrame:
    """The same for CSV lines without header that are already in a column."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*schema.fields, T.StructField(CORRUPT, T.StringType())])
    others = [c for c in lines.columns if c != value]
    row = F.from_csv(value, ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    df = lines.select(*others, row.alias("_r")).select(*others, "_r.*")
    return df if keep_bad else nan_to_null(df.drop(CORRUPT))


def table_scan_or_fallback(spark: SparkSession, table: str, path: str, schema: T.StructType) -> DataFrame:
    """A catalog table if it exists and has rows, else the file; both in one schema."""
    if spark.catalog.tableExists(table):
        df = spark.table(table)
        if not df.isEmpty():
            return ensure_columns(df, schema)
    return csv_scan_typed(spark, path, schema)


# 0-based fields of the header-less game log, and how many a whole line has at least.
LOG_FIELDS = {"date": 0, "away_team_raw": 3, "home_team_raw": 6, "away_sp_id": 101, "away_sp_name": 102, "home_sp_id": 103, "home_sp_name": 104}
LOG_MIN_FIELDS = 105

# Team codes of the game log and event files that differ from ours.
LOG_TEAMS = {
    "CHN": "CHC", "CHA": "CHW", "KCA": "KCR", "ANA": "LAA", "LAN": "LAD", "FLO": "MIA", "NYN": "NYM", "NYA": "NYY",
    "OAK": "ATH", "SDN": "SDP", "SFN": "SFG", "SLN": "STL", "TBA": "TBR", "WAS": "WSN",
}


def log_team(code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LOG_TEAMS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), code)


def positional_log_scan(lines: DataFrame, value: str = "value") -> DataFrame:
    """Pick fields of a quoted, header-less log by position; short lines are rejected."""
    bare = F.regexp_replace(value, '"[^"]*"', "")
    # commas inside quotes are hidden while splitting
    hidden = F.transform(F.split(F.col(value), '"'), lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(","), F.lit("\u0001"))).otherwise(x))
    parts = F.split(F.array_join(hidden, ""), ",")
    others = [c for c in lines.columns if c != value]
    picked = lines.filter(F.size(F.split(bare, ",")) >= LOG_MIN_FIELDS).select(
        *others, *[F.replace(F.trim(parts[i]), F.lit("\u0001"), F.lit(",")).alias(n) for n, i in LOG_FIELDS.items()])
    day = F.to_date(F.try_to_timestamp("date", F.lit("yyyyMMdd")))
    return picked.withColumn("game_date", day).filter("game_date is not null").select(
        *others, "game_date", F.year("game_date").alias("year"), log_team(F.col("home_team_raw")).alias("home_team"),
        log_team(F.col("away_team_raw")).alias("away_team"), "home_sp_id", "home_sp_name", "away_sp_id", "away_sp_name")


def ordered_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with a position: (file, block, line).

    Files stay splittable: the block is the split's offset, the line counts up in
    reading order inside it.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def event_file_scan(lines: DataFrame) -> DataFrame:
    """Record-typed play-by-play lines, each with its game id.

    ``lines`` has file, block, line, value. The id of a game stands on its first line
    and is carried forward in line order.
    """
    fields = F.split(F.trim("value"), ",")
    typed = lines.select("file", "block", "line", fields.alias("f")).filter(F.size("f") > 1)
    typed = typed.withColumn("record", F.col("f")[0])
    named = ordered.expanding(typed, ["file"], ["block", "line"], {"game_id": ("last", F.when(F.col("record") == "id", F.col("f")[1]))},
                              cell="block", inclusive=True)
    at = lambda i: F.try_element_at("f", F.lit(i + 1))
    strip = lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))
    return named.filter("game_id is not null").select(
        "file", "block", "line", "game_id", "record",
        F.to_date(F.try_to_timestamp(F.substring("game_id", 4, 8), F.lit("yyyyMMdd"))).alias("game_date"),
        *[strip(at(i)).alias(f"f{i}") for i in range(1, 7)])


BOXSCORE = """struct<teams: struct<
 home: struct<pitchers: array<bigint>, players: map<string, struct<person: struct<fullName: string>, stats: struct<pitching: struct<outs: int, runs: int>>>>>,
 away: struct<pitchers: array<bigint>, players: map<string, struct<person: struct<fullName: string>, stats: struct<pitching: struct<outs: int, runs: int>>>>>>>"""


def boxscore_json_flatten(df: DataFrame, column: str = "boxscore") -> DataFrame:
    """One row per pitcher who has outs and runs; the first listed pitcher of a side is its starter.

    ``team_side`` is 1 for the home team, here as everywhere.
    """
    others = [c for c in df.columns if c != column]
    box = df.select(*others, F.from_json(column, BOXSCORE).alias("b"))
    sides = box.select(*others, F.inline(F.array(
        F.struct(F.lit(1).alias("team_side"), F.col("b.teams.home.pitchers").alias("ids"), F.col("b.teams.home.players").alias("players")),
        F.struct(F.lit(0).alias("team_side"), F.col("b.teams.away.pitchers").alias("ids"), F.col("b.teams.away.players").alias("players")))))
    rows = sides.select(*others, "team_side", "players", F.posexplode("ids").alias("slot", "pitcher_id"))
    player = F.try_element_at("players", F.concat(F.lit("ID"), F.col("pitcher_id").cast("string")))
    return rows.withColumn("p", player).select(
        *others, "team_side", "pitcher_id", F.coalesce("p.person.fullName", F.lit("Unknown")).alias("pitcher_name"),
        (F.col("slot") == 0).alias("is_starter"), F.col("p.stats.pitching.outs").alias("outs_recorded"),
        F.col("p.stats.pitching.runs").alias("runs_allowed")).filter("outs_recorded is not null and runs_allowed is not null")


PLAYS = """struct<allPlays: array<struct<
 about: struct<inning: int, halfInning: string, isTopInning: boolean, isComplete: boolean>,
 matchup: struct<pitcher: struct<id: bigint, fullName: string>, postOnFirst: struct<id: bigint>, postOnSecond: struct<id: bigint>, postOnThird: struct<id: bigint>>,
 result: struct<awayScore: int, homeScore: int>, count: struct<outs: int>>>>"""


def play_by_play_json_flatten(df: DataFrame, game: str, column: str = "plays") -> DataFrame:
    """Plays of a game with score deltas and the base/out state before and after."""
    from fungo.functions.plays import base_state_key

    body = df.select(game, F.posexplode(F.from_json(column, PLAYS)["allPlays"]).alias("play", "p"))
    done = body.filter(F.coalesce(F.col("p.about.isComplete"), F.lit(True))).select(
        game, "play", F.col("p.about.inning").alias("inning"), F.col("p.about.isTopInning").alias("top"),
        F.col("p.matchup.pitcher.id").alias("pitcher_id"), F.coalesce("p.matchup.pitcher.fullName", F.lit("Unknown")).alias("pitcher_name"),
        F.col("p.result.awayScore").alias("away"), F.col("p.result.homeScore").alias("home"), F.col("p.count.outs").alias("outs_after"),
        F.col("p.matchup.postOnFirst.id").isNotNull().alias("b1"), F.col("p.matchup.postOnSecond.id").isNotNull().alias("b2"),
        F.col("p.matchup.postOnThird.id").isNotNull().alias("b3"))
    over = F.col("outs_after") >= 3
    done = done.withColumn("state_after", base_state_key(F.col("outs_after"), *[F.col(b) & ~over for b in ("b1", "b2", "b3")]))
    done = done.withColumn("_cell", F.floor(F.col("play") / 1024))
    scored = ordered.previous(done, [game], ["play"], {"a0": "away", "h0": "home"}, cell="_cell")
    half = ordered.previous(scored, [game, "inning", "top"], ["play"], {"o0": "outs_after", "s0": "state_after"}, cell="_cell")
    zero = lambda c: F.coalesce(c, F.lit(0))
    runs = F.greatest(F.lit(0), F.when(F.col("top"), zero("away") - zero("a0")).otherwise(zero("home") - zero("h0")))
    named = half.withColumn("runs_scored", runs)
    starter = ordered.first(named.filter("pitcher_id is not null"), [game, "top"], ["play"], ["pitcher_id"]).withColumnRenamed("pitcher_id", "_sp")
    return named.join(starter, [game, "top"], "left").select(
        game, "play", "inning", (~F.col("top")).cast("int").alias("batting_side"), "pitcher_id", "pitcher_name",
        (F.col("pitcher_id") == F.col("_sp")).alias("pitcher_is_starter"), F.coalesce("s0", F.lit("0_0")).alias("state_before"), "state_after",
        zero("o0").alias("outs_before"), "outs_after", "runs_scored")


QUOTES = """struct<commence_time: string, home_team: string, away_team: string,
 bookmakers: array<struct<key: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double>>>>>>>"""


def quotes_json_flatten(df: DataFrame, column: str = "quote", market: str = "h2h") -> DataFrame:
    """One row per (game, book) with both prices and the Eastern game date."""
    others = [c for c in df.columns if c != column]
    q = df.select(*others, F.from_json(column, QUOTES).alias("q")).select(*others, "q.*")
    books = q.select(*others, "commence_time", "home_team", "away_team", F.explode("bookmakers").alias("b"))
    lines = books.select(*others, "commence_time", "home_team", "away_team", F.col("b.key").alias("book"), F.explode("b.markets").alias("m")).filter(F.col("m.key") == market)
    price = lambda team: F.try_element_at(F.filter("m.outcomes", lambda o: o["name"] == F.col(team)), F.lit(1))["price"]
    has = lambda team: F.exists("m.outcomes", lambda o: o["name"] == F.col(team))
    # prices first: the names they are looked up by are rewritten after
    priced = lines.filter(has("home_team") & has("away_team")).withColumns({"home_ml": price("home_team"), "away_ml": price("away_team")})
    return priced.select(
        *others, eastern_date(F.try_to_timestamp("commence_time")).alias("game_date"),
        teams.normalize_team_name(F.col("home_team")).alias("home_team"), teams.normalize_team_name(F.col("away_team")).alias("away_team"),
        "book", "home_ml", "away_ml")


SCHEDULE = """struct<dates: array<struct<date: string, games: array<struct<gamePk: bigint, gameDate: string, status: struct<detailedState: string>,
 teams: struct<home: struct<score: int, team: struct<abbreviation: string>>, away: struct<score: int, team: struct<abbreviation: string>>>>>>>>"""


def schedule_json_flatten(df: DataFrame, column: str = "schedule") -> DataFrame:
    """One row per scheduled game with status, scores and Eastern start."""
    days = df.select(F.explode(F.from_json(column, SCHEDULE)["dates"]).alias("d"))
    games = days.select(F.col("d.date").cast("date").alias("game_date"), F.explode("d.games").alias("g"))
    code = lambda s: teams.normalize_schedule_team(F.col(f"g.teams.{s}.team.abbreviation"))
    start = F.from_utc_timestamp(F.try_to_timestamp("g.gameDate"), "America/New_York")
    return games.select(
        F.col("g.gamePk").alias("game_pk"), "game_date", code("home").alias("home_team"), code("away").alias("away_team"),
        F.col("g.status.detailedState").alias("status"), F.col("g.teams.home.score").alias("home_score"), F.col("g.teams.away.score").alias("away_score"),
        start.alias("start_eastern"), F.coalesce(F.date_format(start, "h:mm a"), F.lit("TBD")).alias("game_time"))


GAME_HOUR = 19


def hourly_arrays_flatten(df: DataFrame, time: str, values: list[str], hour: int = GAME_HOUR) -> DataFrame:
    """Parallel hourly arrays to one row per day, taken at a fixed local hour."""
    others = [c for c in df.columns if c not in (time, *values)]
    rows = df.select(*others, F.inline(F.arrays_zip(time, *values)))
    at = F.try_to_timestamp(time)
    return rows.filter(F.hour(at) == hour).select(*others, F.to_date(at).alias("date"), *values)


def json_map_scan(df: DataFrame, column: str, value_type: str = "string", key: str = "key", value: str = "value") -> DataFrame:
    """A JSON object used as a dictionary, to rows."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.from_json(column, f"map<string, {value_type}>")).alias(key, value))
