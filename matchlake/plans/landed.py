"""Inputs the given tables do not carry as such: payloads, texts, second snapshots.

Each is a row-wise projection of a given table, so it grows with that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.sources import contest


def _pick(selector: Column, *choices: Column | str | None) -> Column:
    """The choice at ``selector`` modulo the number of choices."""
    out = None
    for i, choice in enumerate(choices):
        value = F.lit(choice) if not isinstance(choice, Column) else choice
        out = (F if out is None else out).when(selector % len(choices) == i, value)
    return out


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def clock_texts(lines: DataFrame) -> DataFrame:
    """Clocks with and without decimals and other texts, periods 1 to 7."""
    part, supp, qty = F.col("part"), F.col("supp"), F.col("qty")
    full = contest.clock_text(part, supp, qty)
    return lines.select(
        "game_id",
        "play_id",
        (1 + part % 7).cast("int").alias("period"),
        _pick(qty, full, _text("PT", _two(part % 12), "M", _two(supp % 60), "S"), "12:34", full).alias(
            "clock"
        ),
    )


def number_texts(lines: DataFrame) -> DataFrame:
    part, supp = F.col("part"), F.col("supp")
    minutes = part % 48
    return lines.select(
        "game_id",
        "play_id",
        _pick(
            F.col("qty"), _text(minutes, ":", _two(supp % 60)), minutes.cast("string"), "", "abc",
            "1:2:3", "12.5", None,
        ).alias("minutes_text"),
        _pick(F.col("qty"), _text(5 + part % 3, "-", supp % 12), "6", "x-9", "").alias("height_text"),
    )


def order_texts(orders: DataFrame) -> DataFrame:
    """Ids, dates and seasons as text, good and bad."""
    key = F.col("o_orderkey")
    o = orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    cents = F.col("cents")
    id_text = _text(
        "00", key % 7, _two(F.floor(key / 7) % 100), F.lpad((key % 100000).cast("string"), 5, "0")
    )
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    year = F.year("o_orderdate")
    return o.select(
        key.alias("game_id"),
        (key % 5).alias("code"),
        id_text.alias("id_text"),
        _pick(cents, id_text, "12", _text("1", F.substring(id_text, 2, 9)), _text(id_text, "1"), None).alias(
            "any_id"
        ),
        F.date_add(F.to_date("o_orderdate"), (cents % 9000).cast("int")).alias("day"),
        F.when(cents % 7 == 0, "unknown").otherwise(_text(date, "T00:00:00")).alias("birth_text"),
        _pick(
            cents, date, F.replace(date, F.lit("-"), F.lit("/")),
            _text(year, "-", _two(cents % 15), "-", _two(F.floor(cents / 15) % 34)),
            _text(year, "-02-", _two(cents % 33)), "20241022",
        ).alias("any_date"),
        _pick(
            cents, _text(year, "-", year + 1), _text(year, "-", year + 2),
            _text(year, "-", F.substring((year + 1).cast("string"), 3, 2)), _text(year, "/", year + 1),
            _text(1000 + cents % 2000, "-", 1001 + cents % 2000),
        ).alias("any_season"),
    )


def name_texts(customers: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customers.select(
        "c_custkey",
        _pick(
            key, _text("Last", key, ", First", key), _text("First", key, " Middle Last", key),
            _text("Single", key), _text("Last", key, ", First", key, ", Jr"), None,
        ).alias("name_text"),
    )


def identifiers(customers: DataFrame) -> DataFrame:
    """Team identifiers in several spellings, some unknown."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return customers.select(
        "c_custkey",
        _pick(
            key, _text("nation_", nation), _text("Nation-Number-", nation), _text("NUMBER ", nation),
            _text("old-Team ", nation), _text("nobody ", nation),
        ).alias("identifier"),
    )


#: Elements that one made payload holds at most.
PAYLOAD_PLAYS, PAYLOAD_GAMES, PAYLOAD_PEOPLE = 4, 500, 100


def play_payloads(lines: DataFrame) -> DataFrame:
    """A document per game and page of plays, the plays in no order."""
    key, part, supp, qty = (F.col(c) for c in ("game_id", "part", "supp", "qty"))
    home, away = contest.line_scores()
    play = F.struct(
        F.when(key % 2 == 0, F.col("play_id")).alias("orderNumber"),
        F.when(key % 2 == 1, F.col("play_id")).alias("actionId"),
        contest.line_period().alias("period"),
        contest.clock_text(part, supp, qty).alias("clock"),
        home.cast("string").alias("scoreHome"),
        away.cast("string").alias("scoreAway"),
        F.when(qty % 23 != 0, _text("Shot by ", part)).alias("description"),
        part.alias("personId"),
        (qty % 40).cast("int").alias("pointsTotal"),
    )
    page = F.floor((F.col("play_id") - 1) / PAYLOAD_PLAYS)
    paged = lines.groupBy("game_id", page.alias("page")).agg(F.collect_list(play).alias("actions"))
    return paged.select(F.to_json(F.struct("game_id", F.struct("actions").alias("game"))).alias("payload"))


def two_sources(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A first source that fails for running games and has no plays for future
    ones, and a second one that answers for all."""
    key, status = F.col("o_orderkey").alias("game_id"), F.col("o_orderstatus")

    def payload(source: str) -> Column:
        return _text(
            '{"game": {"actions": [{"orderNumber": 1, "description": "', source, " ", F.col("o_custkey"),
            '"}]}}',
        )

    first = (
        F.when(status == "F", payload("first"))
        .when(status == "P", F.lit("<html>error</html>"))
        .otherwise(F.lit('{"game": {"actions": []}}'))
    )
    return (
        orders.select(key, first.alias("payload")),
        orders.select(key, payload("second").alias("payload")),
    )


def schedule_payloads(orders: DataFrame) -> DataFrame:
    """A document per season and page of games, with the games of each date together."""
    rows = order_texts(orders).select("game_id", "id_text", "code", "day")
    game = F.struct(
        F.col("id_text").alias("gameId"),
        F.col("code").alias("gameStatus"),
        _text(F.date_format("day", "yyyy-MM-dd"), "T00:00:00Z").alias("gameDateTimeEst"),
        F.struct(contest.team_code(contest.home_index(F.col("game_id"))).alias("teamTricode")).alias(
            "homeTeam"
        ),
        F.struct(contest.team_code(contest.away_index(F.col("game_id"))).alias("teamTricode")).alias(
            "awayTeam"
        ),
    )
    year = F.year("day")
    paged = rows.select(
        _text(year, "-", year + 1).alias("season"), "day", F.floor(F.col("game_id") / PAYLOAD_GAMES).alias("page"), game.alias("game")
    )
    days = paged.groupBy("season", "page", "day").agg(F.collect_list("game").alias("games"))
    dates = F.collect_list(F.struct("games")).alias("gameDates")
    seasons = days.groupBy("season", "page").agg(dates)
    return seasons.select(F.to_json(F.struct("season", F.struct("gameDates").alias("leagueSchedule"))).alias("payload"))


SECOND_PLAYER = 1_000_000_000_000


def box_payloads(orders: DataFrame, live: bool) -> DataFrame:
    """Box scores with two players per side; future games have no home players,
    running ones no home score."""
    key = F.col("o_orderkey")
    o = orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    cents = F.col("cents")

    def team(index: Column, shift: int, at_home: bool) -> Column:
        stats = F.struct(
            (80 + (cents + shift) % 60).cast("int").alias("points"),
            (30 + (cents + shift) % 20).cast("int").alias("reboundsTotal"),
            (15 + (cents + shift) % 15).cast("int").alias("assists"),
            ((cents + shift) % 100 / 100).alias("fieldGoalsPercentage"),
        )

        def player(n: int) -> Column:
            played = F.struct(
                _text(cents % 40, ":", _two(cents % 60)).alias("minutes"),
                ((cents + shift + n) % 30).cast("int").alias("points"),
                ((cents + shift + n) % 7).cast("int").alias("reboundsOffensive"),
            )
            return F.struct(
                (key * 2 + shift + n * SECOND_PLAYER).alias("personId"),
                _text("First", cents % 50).alias("firstName"),
                F.when(cents % 3 != 0, _text("Family", cents % 70)).alias("familyName"),
                F.when(cents % 5 != 0, _text("F. Family", cents % 70)).alias("name"),
                F.when(cents % 4 != 0, F.lit("G")).alias("position"),
                played.alias("statistics"),
            )

        players = F.array(player(0), player(1))
        score = (80 + (cents + shift) % 60).cast("int")
        if at_home:
            players = F.when(F.col("o_orderstatus") != "O", players).otherwise(F.slice(players, 1, 0))
            score = F.when(F.col("o_orderstatus") != "P", score)
        return F.struct(
            index.alias("teamId"),
            contest.team_code(index).alias("teamTricode"),
            score.alias("score"),
            stats.alias("statistics"),
            players.alias("players"),
        )

    body = F.struct(
        team(contest.home_index(key), 0, True).alias("homeTeam"),
        team(contest.away_index(key), 1, False).alias("awayTeam"),
    ).alias("game" if live else "boxScoreTraditional")
    return o.select(F.to_json(F.struct(key.alias("game_id"), body)).alias("payload"))


def rowset_payloads(customers: DataFrame) -> DataFrame:
    """Row sets of a page of players each, values by position."""
    key = F.col("c_custkey")
    row = _text(
        "[", key, ', "Last', key, ", First", key, '", "First', key, " Last", key, '", ',
        key % 2, ', "', 1990 + key % 10, '", "', 2000 + key % 20,
        '", null, null, null, null, null, "', F.col("c_mktsegment"), '"]',
    )
    page = F.floor(key / PAYLOAD_PEOPLE)
    paged = customers.groupBy(page.alias("page")).agg(F.array_join(F.collect_list(row), ", ").alias("rows"))
    return paged.select(_text('{"resultSets": [{"rowSet": [', F.col("rows"), "]}]}").alias("payload"))


def predicted_players(lines: DataFrame) -> DataFrame:
    """Predicted points per player, for players who partly differ from those seen."""
    side = F.when(F.col("play_id") % 2 == 1, "home").otherwise("away")
    return (
        lines.filter(F.col("qty") % 5 != 0)
        .groupBy("game_id", side.alias("side"), (F.col("part") + F.col("supp") % 2).alias("person_id"))
        .agg(F.max((F.col("qty") % 30).cast("int")).alias("pred_points"))
    )


def newer_predictions(predictions: DataFrame) -> DataFrame:
    """High ones made again an hour later, one point up."""
    high = predictions.filter(F.col("pred_home_score") > 100)
    return high.withColumns(
        {
            "prediction_ts": F.col("prediction_ts") + F.make_dt_interval(F.lit(0), F.lit(1)),
            "pred_home_score": F.col("pred_home_score") + 1,
        }
    )


def collected_again(states: DataFrame, games: DataFrame) -> DataFrame:
    """First plays of running games, one point up for home."""
    running = games.filter(F.col("status") == "In Progress")
    return (
        states.filter(F.col("play_id") <= 4)
        .join(running.select("game_id"), "game_id", "left_semi")
        .withColumn("home_score", F.col("home_score") + 1)
    )


def delivered_schedule(games: DataFrame) -> DataFrame:
    """A later delivery: pre-season games gone, evening games completed, undecided
    opponents empty, and midnight games once more under new ids."""
    evening = (F.col("status") == "In Progress") & (F.hour("start") >= 18)
    kept = games.filter(F.col("season_type") != "Pre Season").withColumns(
        {
            "status": F.when(evening, "Completed").otherwise(F.col("status")),
            "away_team": F.when(F.col("away_team") != contest.UNKNOWN_TEAM, F.col("away_team")),
        }
    )
    extra = games.filter(F.hour("start") == 0).withColumn(
        "game_id", -1 - F.col("game_id")
    )
    return kept.unionByName(extra)


def player_lists(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A player list before and after: some new, some changed."""
    old = parts.filter(F.col("p_size") < 40).select(
        F.col("p_partkey").alias("person_id"),
        (1990 + F.col("p_size") % 10).cast("string").alias("from_year"),
        F.when(F.col("p_size") % 4 != 0, (2000 + F.col("p_size")).cast("string")).alias("to_year"),
        (F.col("p_size") % 2).alias("roster_status"),
        F.col("p_brand").alias("team"),
    )
    new = parts.select(
        F.col("p_partkey").alias("person_id"),
        (1990 + F.col("p_size") % 10).cast("string").alias("from_year"),
        F.when(F.col("p_size") % 6 != 0, (2000 + F.col("p_size")).cast("string")).alias("to_year"),
        F.when(F.col("p_type") == "ECONOMY", F.lit(0)).otherwise(F.col("p_size") % 2).alias(
            "roster_status"
        ),
        F.col("p_brand").alias("team"),
    )
    return old, new


def model_list(parts: DataFrame) -> DataFrame:
    """Model runs: type, status, error (absent for some)."""
    size = F.col("p_size")
    return parts.select(
        F.col("p_partkey").alias("model_id"),
        F.col("p_brand").alias("model_type"),
        _pick(size, "active", "testing", "archived").alias("status"),
        F.when(size % 5 != 0, F.col("p_retailprice") / 100).alias("avg_score_mae"),
        size.alias("run_size"),
    )


def plays_of_raw_lines(raw: DataFrame) -> DataFrame:
    """Delivered lines as plays, batch or stream, nothing combined."""
    return contest.plays_of_lines(
        raw.select(
            F.col("l_orderkey").alias("game_id"),
            F.col("l_linenumber").cast("long").alias("play_id"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"),
            F.col("l_quantity").cast("long").alias("qty"),
        )
    )
