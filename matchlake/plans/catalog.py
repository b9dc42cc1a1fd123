"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions import clock as clocks
from matchlake.functions import labels, probability, seasons, text
from matchlake.operators import (
    audit,
    evaluate,
    features,
    history,
    models,
    predict,
    pregame,
    quality,
    quarantine,
    queues,
    repair,
    states,
    sync,
    teams,
    views,
)
from matchlake.plans import landed
from matchlake.sources import contest, payloads
from matchlake.sources.shared import materialized, new_folder
from matchlake.sources.store import BucketStore, KeyedTables, buckets_for
from matchlake.streaming import closing, live

Query = Callable[[SparkSession, str], DataFrame]

TRAIN_SEASON, TEST_SEASON = "1997-1998", "1998-1999"
CURRENT_SEASON = "2000-2001"
AS_OF = "2001-03-01 12:00:00"
TODAY, ZONE = "1998-07-01", "UTC"
PREDICTOR = "Baseline"


class Tables:
    """The contest tables of one folder, built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(contest, name)(self.spark, self.folder)

    def raw(self, name: str) -> DataFrame:
        return contest.table(self.spark, self.folder, name)


def tidy(rows: DataFrame) -> DataFrame:
    """Comparable output: six decimals, 64-bit integers, moments as text."""

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "double":
            return F.round(c, 6).alias(name)
        if kind in ("int", "smallint", "tinyint"):
            return c.cast("long").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
        if kind == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(name)
        return c

    return rows.select(*[one(n, k) for n, k in rows.dtypes])


_QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(build(Tables(spark, folder)))

        _QUERIES[name] = run
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- point-in-time history and features -------------------------------------


@query("features")
def _(t):
    return features.features(t.games, t.finals)


for _key, _names in {
    "feat_basic": features.BASIC,
    "feat_context": features.CONTEXT,
    "feat_decay": features.DECAY,
    "feat_rest": features.REST,
}.items():
    query(_key)(
        lambda t, names=_names: features.features(t.games, t.finals).select("game_id", *names)
    )


@query("prior_games")
def _(t):
    rows = history.prior_counts(t.games, t.finals)
    return rows.select("game_id", "side", "season", "team", "start", "needed")


@query("prior_states")
def _(t):
    rows = history.prior_counts(t.games, t.finals)
    return rows.select("game_id", "side", "needed", "loaded")


@query("prior_missing")
def _(t):
    return history.prior_counts(t.games, t.finals).filter("is_missing").select("game_id", "side")


@query("need_pregame")
def _(t):
    return history.games_needing_pregame(t.games)


@query("finalize_pregame")
def _(t):
    flags = queues.finalize_pregame(t.games, history.prior_counts(t.games, t.finals))
    return flags.select("game_id", "pre_game_data_finalized")


# --- states ------------------------------------------------------------------

_STATE = ["game_id", "play_id", "game_date", "home", "away", "clock", "period",
          "home_score", "away_score", "total", "home_margin", "is_final_state"]


@query("game_states")
def _(t):
    return states.game_states(t.games, t.plays).select(*_STATE)


@query("game_states_alt")
def _(t):
    told = contest.plays(t.spark, t.folder, both=False)
    return states.game_states(t.games, told).select(*_STATE)


@query("player_timeline")
def _(t):
    return states.player_timeline(t.games, t.plays)


@query("players_snapshot")
def _(t):
    return states.players_snapshot(t.games, t.plays)


@query("play_order")
def _(t):
    return states.play_order(t.plays).select("game_id", "play_id", "position")


@query("latest_state")
def _(t):
    return states.latest_state(t.states)


@query("finalize_games")
def _(t):
    return states.finalize_games(t.games, t.states).select("game_id", "game_data_finalized")


# --- work queues and lookups ---------------------------------------------------


@query("need_collect")
def _(t):
    return queues.needing_collection(t.games)


@query("in_progress")
def _(t):
    return queues.in_progress(t.games)


@query("games_on_date")
def _(t):
    return queues.on_date(t.games, TODAY)


@query("need_box")
def _(t):
    return queues.needing_box(t.games, t.player_box)


@query("need_prediction")
def _(t):
    return queues.needing_prediction(t.games, t.predictions, PREDICTOR)


def _wanted(t: Tables) -> DataFrame:
    return t.raw("customer").select((F.col("c_custkey") * 20).alias("game_id"))


@query("lookup_games")
def _(t):
    return queues.lookup(t.games, _wanted(t))


@query("lookup_missing")
def _(t):
    return queues.lookup_missing(t.games, _wanted(t))


_STORES: dict[tuple, KeyedTables] = {}


def _game_tables(t: Tables) -> KeyedTables:
    return KeyedTables(t.spark, "game_id", buckets_for(t.raw("orders").count()))


def _feature_store(t: Tables, anew: bool = False) -> KeyedTables:
    """Features, games and finals bucketed by game, built by the first reader of a folder in a session.

    Files that are rewritten under their names are not noticed: ``store_features`` builds anew.
    """
    key = (t.spark.sparkContext.applicationId, *sorted(t.raw("orders").inputFiles()))
    if anew or key not in _STORES:
        tables = _game_tables(t)
        finals = tables.save("finals", t.finals)
        games = tables.save("games", t.games)
        tables.save("features", features.side_sums(games, finals, tables.buckets), features.features_of)
        _STORES[key] = tables
    return _STORES[key]


@query("store_features")
def _(t):
    return _feature_store(t, anew=True).read("features")


@query("load_features")
def _(t):
    return _feature_store(t).read("features").join(_wanted(t), "game_id", "left_semi")


@query("features_json")
def _(t):
    """Features through their other stored form, one JSON object per game."""
    return features.widen_features(features.feature_json(_feature_store(t).read("features")))


@query("pipeline_pregame")
def _(t):
    done = pregame.refresh(t.games, t.plays, _game_tables(t))
    return pregame.predicted_games(done)


@query("prior_lists")
def _(t):
    def as_text(ids: Column) -> Column:
        return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")

    return history.prior_lists(t.games, t.finals, _wanted(t), shape=as_text)


@query("prior_ids")
def _(t):
    return history.prior_ids(t.games, _wanted(t))


@query("season_subset")
def _(t):
    allowed = t.games.filter(F.col("start") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return queues.seasons_outside(t.games, allowed.select("season"))


@query("refresh_due")
def _(t):
    log = t.games.filter(F.col("status") == "Completed").groupBy("season").agg(
        F.max("start").alias("last_update")
    ).filter(F.col("season") != "1994-1995")
    asked = t.games.select("season").distinct()
    return queues.refresh_due(asked, log, CURRENT_SEASON, "1999-06-30 18:00:00", 60 * 24 * 30)


# --- coverage and play quality ---------------------------------------------------


def _datasets(t: Tables) -> dict[str, DataFrame]:
    return {
        "plays": t.lines,
        "states": t.states,
        "player_box": t.player_box,
        "features": t.stored_features,
        "predictions": t.predictions,
    }


@query("coverage")
def _(t):
    return quality.coverage(t.games, _datasets(t))


@query("coverage_alerts")
def _(t):
    return quality.coverage_alerts(quality.coverage(t.games, _datasets(t)))


@query("report_json")
def _(t):
    folder = new_folder(t.spark, "report")
    rows = quality.coverage(t.games, _datasets(t))
    payloads.write_report(rows.select("season", "dataset", "covered", "total", "mark"), folder)
    return t.spark.read.text(folder).withColumnRenamed("value", "report")


@query("play_quality")
def _(t):
    rows = quality.play_quality(t.games, t.lines, t.states, fewest=3, most=6)
    return rows.withColumn("issues", F.array_join("issues", "; "))


@query("game_counts")
def _(t):
    return quality.game_counts(t.games, _datasets(t) | {"team_box": t.team_box})


# --- audits and repairs ------------------------------------------------------------


def _audited(t: Tables) -> dict:
    return {
        "games": t.games,
        "plays": t.plays,
        "states": t.states,
        "features": t.stored_features,
        "predictions": t.predictions,
        "teams": t.teams,
        "team_box": t.team_box,
        "as_of": "1999-01-01 00:00:00",
        "active_seasons": ["1998-1999", "1999-2000"],
    }


def _partly_scheduled(t: Tables) -> dict:
    """As if only started games had been scheduled."""
    return _audited(t) | {"games": t.games.filter(F.col("status") != "Not Started")}


def _unguarded(t: Tables) -> dict:
    return _audited(t) | {"states": t.raw_states}


def _partly_played(t: Tables) -> dict:
    """As if the plays of some games had never arrived."""
    return _audited(t) | {"plays": t.plays.filter(F.col("game_id") % 13 != 0)}


def _short_games(t: Tables) -> dict:
    """With the limits of the short games of these tables."""
    return _audited(t) | {"play_limits": (3, 6)}


def _with_gaps(t: Tables) -> dict:
    """As if a few key fields had arrived empty."""
    gone = F.col("away_team") == contest.UNKNOWN_TEAM
    return _audited(t) | {
        "games": t.games.withColumn("away_team", F.when(~gone, F.col("away_team"))),
        "states": t.states.withColumn(
            "home_score", F.when(F.col("home_score") != 100, F.col("home_score"))
        ),
    }


def _below_zero(t: Tables) -> dict:
    """As if every score had been recorded 40 too low."""
    return _audited(t) | {
        "states": t.states.withColumns(
            {c: F.col(c) - 40 for c in ("home_score", "away_score")}
        )
    }


_AUDITS = {
    "v_flag_001": ("FLAG-001", _audited),
    "v_flag_002": ("FLAG-002", _partly_played),
    "v_flag_003": ("FLAG-003", _audited),
    "v_flag_004": ("FLAG-004", _audited),
    "v_flag_005": ("FLAG-005", _audited),
    "v_flag_006": ("FLAG-006", _audited),
    "v_team_001": ("TEAM-001", _audited),
    "v_team_002": ("TEAM-002", _audited),
    "v_team_003": ("TEAM-003", _audited),
    "v_team_004": ("TEAM-004", _audited),
    "v_team_005": ("TEAM-005", _audited),
    "v_integrity_001": ("INTEGRITY-001", _partly_scheduled),
    "v_integrity_002": ("INTEGRITY-002", _partly_scheduled),
    "v_integrity_003": ("INTEGRITY-003", _partly_scheduled),
    "v_integrity_004": ("INTEGRITY-004", _partly_scheduled),
    "v_integrity_005": ("INTEGRITY-005", _with_gaps),
    "v_integrity_006": ("INTEGRITY-006", _unguarded),
    "v_score_001": ("SCORE-001", _unguarded),
    "v_score_002": ("SCORE-002", _below_zero),
    "v_score_003": ("SCORE-003", _audited),
    "v_score_004": ("SCORE-004", _audited),
    "v_volume_001": ("VOL-001", _short_games),
    "v_volume_002": ("VOL-002", _unguarded),
    "v_temp_001": ("TEMP-001", _audited),
    "v_temp_002": ("TEMP-002", _unguarded),
}
for _key, (_rule, _input) in _AUDITS.items():
    query(_key)(lambda t, rule=_rule, tables=_input: audit.RULES[rule].rows(tables(t)))


@query("validation_report")
def _(t):
    report = audit.validation_report(_audited(t))
    return report.select(
        "check_id", "severity", "category", "fixable", "count", F.size("sample").alias("samples"),
        F.array_join("sample", ";").alias("first_rows"),
    )


@query("validation_summary")
def _(t):
    return audit.severity_summary(audit.validation_report(_audited(t), ["Flag", "Team", "None"]))


@query("fix_flags")
def _(t):
    fixed = repair.fix_flags(t.games, t.states, t.lines)
    return fixed.select(
        "game_id", "pre_game_data_finalized", "game_data_finalized",
        "fixed_001", "fixed_002", "fixed_005", "fixed_006",
    )


@query("fix_orphans")
def _(t):
    kept = repair.fix_orphans(t.states, _partly_scheduled(t)["games"])
    return kept.select("game_id", "play_id", "home_score", "away_score")


@query("fix_duplicates")
def _(t):
    return repair.fix_duplicates(
        t.raw_states.select("game_id", "play_id", "home_score", "away_score", "ingest_seq")
    )


# --- predictions ------------------------------------------------------------------------


@query("pred_baseline")
def _(t):
    return predict.baseline(features.features(t.games, t.finals))


@query("pred_ensemble")
def _(t):
    return predict.ensemble(t.predictions, ["Baseline", "Linear", "Tree"])


@query("live_inputs")
def _(t):
    return predict.live_inputs(t.predictions, states.latest_state(t.states), PREDICTOR)


@query("live_predictions")
def _(t):
    inputs = predict.live_inputs(t.predictions, states.latest_state(t.states), PREDICTOR)
    return predict.live_predictions(inputs)


@query("prediction_lead")
def _(t):
    rows = t.predictions.join(t.games.select("game_id", "start"), "game_id")
    lead = labels.lead_minutes(F.col("prediction_ts"), F.col("start"))
    return rows.select(
        "game_id", "predictor", lead.alias("minutes"), labels.lead_class(lead).alias("lead")
    )


@query("predictor_eval")
def _(t):
    return evaluate.predictor_metrics(
        evaluate.scored_predictions(t.predictions, t.games, t.finals)
    )


@query("eval_metrics")
def _(t):
    return evaluate.metrics(evaluate.scored_predictions(t.predictions, t.games, t.finals))


@query("leaderboard")
def _(t):
    scored = evaluate.scored_predictions(t.predictions, t.games, t.finals)
    return evaluate.leaderboard(
        evaluate.metrics(scored.withColumnRenamed("predictor", "model"), "model")
    )


@query("best_model")
def _(t):
    return evaluate.best_models(landed.model_list(t.raw("part")))


@query("promote_model")
def _(t):
    listed = landed.model_list(t.raw("part"))
    return evaluate.promote(listed, listed.filter("run_size = 17"))


# --- modelling ------------------------------------------------------------------------------


def _modeling_table(t: Tables, seasons: list[str] | None = None) -> DataFrame:
    stored = _feature_store(t)
    return models.modeling_table(*[stored.read(x) for x in ("games", "finals", "features")], seasons)


@query("modeling_table")
def _(t):
    return _modeling_table(t)


@query("train_rows")
def _(t):
    table = _modeling_table(t, [TRAIN_SEASON, TEST_SEASON])
    whole = models.complete_rows(table)
    split = F.when(F.col("season") == TRAIN_SEASON, "train").otherwise("test")
    return whole.select(
        "game_id", split.alias("part"), *models.feature_columns(table), "home_score", "away_score"
    )


@query("score_rows")
def _(t):
    return models.fill_features(_feature_store(t).read("features"), features.FEATURES)


def _modelled(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of all games, and the complete rows of the two seasons."""
    known = _feature_store(t).read("features")
    table = models.complete_rows(_modeling_table(t, [TRAIN_SEASON, TEST_SEASON]))
    table = materialized(table, "modelling")
    return (
        known,
        table.filter(F.col("season") == TRAIN_SEASON),
        table.filter(F.col("season") == TEST_SEASON),
    )


@query("pred_linear")
def _(t):
    known, train, test = _modelled(t)
    return models.train_ridge(train, test).predict(known)


@query("pred_tree")
def _(t):
    known, train, test = _modelled(t)
    return models.train_trees(train, test).predict(known)


@query("ridge_gradient")
def _(t):
    _, train, test = _modelled(t)
    found = models.ridge_gradient(models.train_ridge(train, test), train)
    return found.withColumn("gradient", F.abs(F.round("gradient", 4)))


@query("tree_gain")
def _(t):
    """Whether few boosted trees at least cut a fifth off the error of the mean."""
    _, train, test = _modelled(t)
    gain = models.gain_over_mean(models.train_trees(train, test, maxIter=20), train)
    return gain.select("side", "n", (F.col("model_mae") < 0.8 * F.col("mean_mae")).alias("gains"))


DENSE_SIZES = (len(features.FEATURES), 64, 32, 2)


def _dense_weights() -> models.DenseWeights:
    """A network by rule, as the SQL has it too; real ones come from a training run."""
    layers = []
    for k, (a, b) in enumerate(zip(DENSE_SIZES, DENSE_SIZES[1:], strict=False)):
        i, j = np.arange(b)[:, None], np.arange(a)[None, :]
        layers.append((((31 * i + 17 * j + 7 * k) % 41 - 20) / (20 * np.sqrt(a)), (np.arange(b) % 5 - 2) / 10))
    inputs = DENSE_SIZES[0]
    return models.DenseWeights(
        layers, np.zeros(inputs), np.full(inputs, 100.0), np.full(2, 110.0), np.full(2, 12.0)
    )


@query("pred_dense")
def _(t):
    known = features.features(t.games, t.finals)
    return models.score_dense(known, features.FEATURES, _dense_weights())


# --- views -----------------------------------------------------------------------------------


def _shown(entries: str, *fields: str) -> Column:
    return F.array_join(
        F.transform(
            entries, lambda e: F.concat_ws("|", *[e.getField(f).cast("string") for f in fields])
        ),
        ";",
    )


@query("game_view")
def _(t):
    rows = views.game_view(
        t.games, t.plays, states.latest_state(t.states), predict.newest(t.predictions, PREDICTOR)
    )
    return rows.select(
        "game_id", "page", "start", "home_team", "away_team", "status", "season",
        F.coalesce(_shown("play_by_play", "play_id", "period", "clock"), F.lit("")).alias("plays"),
        F.col("state.play_id").alias("state_play_id"),
        F.col("state.home_score").alias("home_score"),
        F.col("state.away_score").alias("away_score"),
        F.col("pre_game.pred_home_score").alias("pred_home_score"),
        F.col("pre_game.pred_away_score").alias("pred_away_score"),
    )


@query("condensed_plays")
def _(t):
    rows = views.condensed_plays(t.plays)
    return rows.select(
        "game_id", "page", _shown("condensed", "time_info", "home_score", "description").alias("plays")
    )


def _board(t: Tables) -> DataFrame:
    return predict.live_player_points(
        states.players_snapshot(t.games, t.plays),
        landed.predicted_players(t.lines),
        states.latest_state(t.states),
    )


@query("player_board")
def _(t):
    return views.player_board(_board(t).fillna("", ["name"]), 5)


@query("player_points")
def _(t):
    return _board(t).fillna("", ["name"])


def _display(t: Tables) -> DataFrame:
    latest = states.latest_state(t.states)
    current = predict.live_predictions(predict.live_inputs(t.predictions, latest, PREDICTOR))
    return views.game_display(t.games, latest, current, ZONE, TODAY)


@query("game_display")
def _(t):
    return _display(t)


@query("game_pages")
def _(t):
    best = views.player_board(_board(t).fillna("", ["name"]), 5)
    rows = views.game_pages(_display(t), best, views.condensed_plays(t.plays))
    players = [
        F.coalesce(_shown(f"{side}_players", "person_id", "name", "points", "pred_points"), F.lit("")).alias(f"{side}_players")
        for side in ("home", "away")
    ]
    plays = F.coalesce(_shown("condensed", "time_info", "home_score", "description"), F.lit("")).alias("plays")
    shown = ["game_id", "page", "home", "away", "datetime_display", "home_score", "away_score", "pred_winner", "pred_win_pct"]
    return rows.select(*shown, *players, plays)


@query("player_maps")
def _(t):
    maps = states.player_maps(states.players_snapshot(t.games, t.plays))
    each = F.transform(F.map_entries("players"), lambda e: F.concat_ws("|", e["key"], e["value"]["name"], e["value"]["points"].cast("string")))
    return maps.select("game_id", "side", "page", F.array_join(each, ";").alias("players"))


def _spoilt_plays(t: Tables) -> DataFrame:
    """Plays of which a few arrived with a clock that cannot be read."""
    broken = (F.col("game_id") * 7 + F.coalesce("order_number", "action_id")) % 50 == 0
    return t.plays.withColumn("clock", F.when(broken, "12:34").otherwise(F.col("clock")))


@query("quarantine_games")
def _(t):
    return quarantine.quarantined_games(quarantine.guarded_plays(_spoilt_plays(t)))


@query("guarded_write")
def _(t):
    """What was observed while writing, beside what the two sides hold."""
    done = quarantine.guarded_plays(_spoilt_plays(t))
    held = [d.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("game_id").alias("games")).withColumn("side", F.lit(s)) for s, d in (("kept", done.kept), ("rejected", done.rejected))]
    observed = F.when(F.col("side") == "kept", done.counts["kept"]).otherwise(done.counts["rejected"])
    return held[0].unionByName(held[1]).select("side", "rows", "games", observed.cast("long").alias("observed"), F.lit(done.verdict).alias("verdict"))


# --- sources and sinks ----------------------------------------------------------------------


def _files(documents: DataFrame, schema: str) -> DataFrame:
    """The documents as landed files, one per line, read with their schema."""
    folder = new_folder(documents.sparkSession, "landed")
    documents.write.text(folder)
    return payloads.read_payloads(documents.sparkSession, folder, schema)


@query("src_plays")
def _(t):
    return payloads.flatten_plays(_files(landed.play_payloads(t.lines), f"game_id BIGINT, {payloads.PLAYS_SCHEMA}"))


@query("src_fallback")
def _(t):
    first, second = landed.two_sources(t.raw("orders"))
    both = payloads.with_fallback(
        payloads.parse_payloads(first, payloads.PLAYS_SCHEMA),
        payloads.parse_payloads(second, payloads.PLAYS_SCHEMA),
    )
    return payloads.flatten_plays(both).select("game_id", "order_number", "description")


@query("src_schedule")
def _(t):
    documents = landed.schedule_payloads(t.raw("orders"))
    return payloads.flatten_schedule(_files(documents, f"season STRING, {payloads.SCHEDULE_SCHEMA}"))


def _boxes(t: Tables, live_format: bool) -> DataFrame:
    schema = payloads.LIVE_BOX_SCHEMA if live_format else payloads.BOX_SCHEMA
    return _files(landed.box_payloads(t.raw("orders"), live_format), f"game_id BIGINT, {schema}")


@query("src_box_stats")
def _(t):
    return payloads.player_stats(_boxes(t, False))


@query("src_box_stats_teams")
def _(t):
    return payloads.team_stats(_boxes(t, False))


@query("src_box_live")
def _(t):
    return payloads.player_stats(_boxes(t, True), live=True)


@query("src_box_live_teams")
def _(t):
    return payloads.team_stats(_boxes(t, True), live=True)


@query("src_rowset")
def _(t):
    return payloads.players_from_rowset(_files(landed.rowset_payloads(t.raw("customer")), payloads.ROWSET_SCHEMA))


@query("points_allowed")
def _(t):
    return teams.points_allowed(t.team_box)


@query("resolve_team")
def _(t):
    return teams.resolve(landed.identifiers(t.raw("customer")), "identifier", t.teams)


@query("sink_replace")
def _(t):
    return sync.replace_rows(
        t.predictions, landed.newer_predictions(t.predictions), ["game_id", "predictor"], "prediction_ts"
    )


@query("sink_replace_group")
def _(t):
    kept = ["game_id", "play_id", "home_score", "away_score"]
    old = t.states.select(*kept)
    again = materialized(landed.collected_again(old, t.games), "again")
    store = BucketStore(t.spark, "states", ("game_id",))
    store.append(old, 0)
    store.replace(again, 1)
    return store.read()


@query("sync_schedule")
def _(t):
    return sync.sync_schedule(t.games, landed.delivered_schedule(t.games))


@query("sync_counts")
def _(t):
    return sync.sync_counts(t.games, landed.delivered_schedule(t.games))


@query("sync_guard")
def _(t):
    one = t.games.filter(F.col("season") == TRAIN_SEASON)
    none = t.games.filter(F.col("season") == "1900-1901")
    parts = [("all", t.games), ("one", one), ("none", none)]
    return reduce(
        DataFrame.unionByName,
        [sync.sync_guard(d).withColumn("delivery", F.lit(n)) for n, d in parts],
    )


@query("sink_quarantine")
def _(t):
    folder = new_folder(t.spark, "quarantine")
    failed = t.games.filter(F.col("away_team") == contest.UNKNOWN_TEAM).select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        "game_id",
        F.concat(F.lit("no opponent for "), "home_team").alias("error"),
    )
    payloads.append_quarantine(failed, folder)
    schema = "moment string, game_id long, error string"
    return t.spark.read.schema(schema).option("header", True).csv(folder)


@query("changed_rows")
def _(t):
    old, new = landed.player_lists(t.raw("part"))
    return sync.changed_rows(new, old, "person_id", ["from_year", "to_year", "roster_status", "team"])


@query("json_fields")
def _(t):
    return t.raw("events").select(
        "event_id",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.get_json_object("props", "$.absent").alias("absent"),
        F.get_json_object("props", "$.k").isin("9", "99").alias("is_nines"),
    )


@query("json_widen")
def _(t):
    parsed = t.raw("events").withColumn("__p", F.from_json("props", "k INT, j INT"))
    return parsed.select("event_id", "event_type", "__p.*")


# --- scalar functions ----------------------------------------------------------------------------


@query("fn_clock")
def _(t):
    rows = landed.clock_texts(t.lines)
    return rows.select("game_id", "play_id", clocks.clock_seconds(F.col("clock")).alias("seconds"))


@query("fn_progress")
def _(t):
    rows = landed.clock_texts(t.lines)
    at = (F.col("period"), F.col("clock"))
    return rows.select(
        "game_id", "play_id", "period",
        clocks.fraction_done(*at).alias("done"), clocks.minutes_left(*at).alias("minutes"),
    )


@query("fn_clock_label")
def _(t):
    rows = landed.clock_texts(t.lines)
    label = clocks.clock_label(F.col("clock"), F.col("period"))
    return rows.select("game_id", "play_id", label.alias("label"))


@query("fn_points_text")
def _(t):
    return contest.plays(t.spark, t.folder, both=False).select(
        "game_id", "action_id", text.points_in_text(F.col("description")).alias("points")
    )


@query("fn_minutes")
def _(t):
    rows = landed.number_texts(t.lines)
    return rows.select("game_id", "play_id", text.played_minutes(F.col("minutes_text")).alias("minutes"))


@query("fn_height")
def _(t):
    rows = landed.number_texts(t.lines)
    return rows.select("game_id", "play_id", text.height_inches(F.col("height_text")).alias("inches"))


@query("fn_age")
def _(t):
    as_of = F.lit("2025-03-01").cast("date")
    rows = landed.order_texts(t.raw("orders"))
    return rows.select("game_id", text.age_on(F.col("birth_text"), as_of).alias("age"))


@query("fn_name")
def _(t):
    rows = landed.name_texts(t.raw("customer"))
    name = F.col("name_text")
    return rows.select(
        "c_custkey", text.first_name(name).alias("first_name"), text.last_name(name).alias("last_name")
    )


@query("fn_season_type")
def _(t):
    rows = landed.order_texts(t.raw("orders"))
    return rows.select("game_id", seasons.season_type_of(F.col("id_text")).alias("season_type"))


@query("fn_status")
def _(t):
    rows = landed.order_texts(t.raw("orders"))
    return rows.select("game_id", seasons.status_of(F.col("code")).alias("status"))


@query("fn_id_season")
def _(t):
    rows = landed.order_texts(t.raw("orders"))
    return rows.select(
        "game_id",
        seasons.season_of_id(F.col("id_text")).alias("season"),
        seasons.season_of_id(F.col("id_text"), short=True).alias("short_season"),
    )


@query("fn_date_season")
def _(t):
    rows = landed.order_texts(t.raw("orders"))
    return rows.select("game_id", "day", seasons.season_of_date(F.col("day")).alias("season"))


@query("fn_season_short")
def _(t):
    return t.games.select("game_id", seasons.short_season(F.col("season")).alias("short_season"))


@query("fn_winprob")
def _(t):
    home, away = F.col("pred_home_score"), F.col("pred_away_score")
    minutes = F.col("game_id") % 49
    chance = probability.home_win_probability
    return t.predictions.select(
        "game_id", "predictor",
        chance(home, away).alias("pregame"),
        chance(home, away, minutes, "linear").alias("linear"),
        chance(home, away, minutes).alias("logarithmic"),
    )


@query("fn_blend")
def _(t):
    rows = t.predictions.withColumn("remaining", (F.col("game_id") % 101) / 100)
    args = (F.col("pred_home_score"), F.col("pred_away_score"), F.col("remaining"))
    return rows.select(
        "game_id", "predictor",
        *[
            probability.blended_score(*args, method=m).alias(m)
            for m in ("simple", "weighted", "logistic")
        ],
    )


@query("fn_when_label")
def _(t):
    state = states.latest_state(t.states).select("game_id", "clock", "period", "is_final_state")
    rows = t.games.join(state, "game_id", "left")
    label = labels.when_label(
        F.col("status"), F.col("start"), F.col("period"), F.col("clock"),
        F.col("is_final_state"), ZONE, F.lit(TODAY).cast("date"),
    )
    return rows.select("game_id", label.alias("label"))


@query("fn_pick")
def _(t):
    chance = F.col("pred_home_win_pct")
    return t.predictions.select(
        "game_id", "predictor",
        labels.pick_winner(chance, F.lit("home"), F.lit("away")).alias("winner"),
        labels.pick_percent(chance).alias("percent"),
    )


@query("validate_ids")
def _(t):
    rows = landed.order_texts(t.raw("orders"))
    return rows.select("game_id", "any_id", seasons.id_fault(F.col("any_id")).alias("fault"))


@query("validate_dates")
def _(t):
    rows = landed.order_texts(t.raw("orders"))
    return rows.select("game_id", "any_date", seasons.date_fault(F.col("any_date")).alias("fault"))


@query("validate_seasons")
def _(t):
    rows = landed.order_texts(t.raw("orders"))
    given = F.col("any_season")
    return rows.select(
        "game_id", "any_season",
        seasons.season_fault(given).alias("fault"),
        seasons.season_fault(given, short=True).alias("short_fault"),
    )


# --- streams ---------------------------------------------------------------------------------------


DELIVERIES = 3


#: Files of one delivery at least, all read by one micro-batch, and rows of a file.
FILES, FILE_ROWS = 4, 1 << 20


def _deliveries(t: Tables, rows: DataFrame, number: Column) -> DataFrame:
    """Rows as a stream, one micro-batch per number, in ascending order.

    A delivery has as many files as its rows ask for, the same number in each.
    """
    path = f"{new_folder(t.spark, 'deliveries')}/rows.parquet"
    held = rows.withColumn("delivery", number)
    files = max(FILES, -(-t.raw("lineitem").count() // (DELIVERIES * FILE_ROWS)))
    for k in range(DELIVERIES):  # the source reads files in the order in which they were written
        held.filter(F.col("delivery") == k).drop("delivery").repartition(files).write.mode("append").parquet(path)
    return live.read_stream(t.spark, path, files_per_batch=files)


#: Columns of lines that plays show.
_SHOWN = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def _lines_stream(t: Tables, *columns: str) -> DataFrame:
    """Lines in several deliveries, one per micro-batch; most orders come in parts.

    The order of lines within a delivery follows from their columns, all without a choice.
    """
    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(DELIVERIES))
    return _deliveries(t, t.raw("lineitem").select(*(columns or "*")), part)


def _busy(t: Tables) -> list[int]:
    return live.busy_games(t.raw("lineitem").select(F.col("l_orderkey").alias("game_id")))


def _readable(rows: DataFrame) -> DataFrame:
    return rows.filter("NOT is_spoilt").drop("is_spoilt")


@query("stream_dedup")
def _(t):
    told = _lines_stream(t).select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_linenumber").cast("long").alias("play_id"),
        F.col("l_shipdate").cast("timestamp").alias("moment"),
    )
    once = live.first_deliveries(told, "moment", "4000 days").select("game_id", "play_id")
    return live.published(t.spark, live.publish(once, "dedup", mode="append"))


def _stream_states(t: Tables) -> DataFrame:
    told = landed.plays_of_raw_lines(_lines_stream(t, *_SHOWN))
    return live.running_states(told, t.games, "4000 days", _busy(t))


@query("stream_states")
def _(t):
    return _readable(live.published(t.spark, live.publish(_stream_states(t), "states"), "game_id"))


@query("stream_players")
def _(t):
    told = landed.plays_of_raw_lines(_lines_stream(t, *_SHOWN))
    current = live.running_players(told, t.games, "4000 days", _busy(t))
    return live.published(t.spark, live.publish(current, "players"), "game_id", "side", "person_id")


@query("stream_predict")
def _(t):
    current = live.running_predictions(_stream_states(t), t.predictions, PREDICTOR)
    return live.published(t.spark, live.publish(current, "predictions"), "game_id")


@query("stream_publish")
def _(t):
    def derive(seen: DataFrame) -> DataFrame:
        told = contest.plays_of_lines(contest.keyed_lines(seen))
        return states.game_states(t.games, told).select(*_STATE)

    folder = live.publish_whole(_lines_stream(t, *_SHOWN), "published", derive, ("l_orderkey",))
    return live.published(t.spark, folder, "game_id")


#: Days that plays may be late, and days after its start that a game without an end is closed.
LATE_DAYS, HOLD_DAYS = 30, 60
#: Days that lines may be shipped before the newest line of earlier deliveries.
SHIP_DAYS = 300


@query("stream_finalize")
def _(t):
    moment = F.col("start").cast("timestamp")
    told = t.plays.select("game_id", "order_number", "description", "sub_type").join(
        t.games.select("game_id", moment.alias("start")), "game_id"
    )
    seconds = F.unix_timestamp(moment)
    cuts = t.games.agg(F.percentile_approx(seconds, [k / DELIVERIES for k in range(1, DELIVERIES)])).first()[0]
    number = reduce(lambda n, c: n + (F.unix_timestamp("start") > c).cast("int"), cuts, F.lit(0))
    stream = _deliveries(t, materialized(told.withColumn("delivery", number), "rows"), F.col("delivery"))
    keys = closing.keys_for(t.raw("orders").count())
    folder = closing.close_games(stream, "closed", f"{LATE_DAYS} days", HOLD_DAYS * 86400, keys=keys)
    done = closing.finalized(t.games, closing.closings(t.spark, folder))
    return done.select("game_id", "game_data_finalized", "reason")


def _split(t: Tables) -> BucketStore:
    told = t.raw("lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_linenumber").cast("long").alias("play_id"),
        F.col("l_shipdate").cast("timestamp").alias("moment"),
    )
    number = (F.col("game_id") + F.col("play_id")) % DELIVERIES
    return live.publish_split(_deliveries(t, told, number), "split", "moment", f"{SHIP_DAYS} days")


@query("stream_late")
def _(t):
    return live.late_rows(t.spark, _split(t)).select("game_id", "play_id", "moment", "batch")


@query("stream_repaired")
def _(t):
    return live.repaired(t.spark, _split(t)).select("game_id", "play_id")
