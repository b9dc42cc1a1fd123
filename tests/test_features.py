"""Features and histories against a game-by-game recomputation."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlake.operators import features as f
from matchlake.operators import history, queues

COUNTED = ("Regular Season", "Post Season")


def schedule(seed=5, games=260, teams=6, hot=None):
    rng = random.Random(seed)
    out = []
    for i in range(games):
        home, away = rng.sample([f"T{n}" for n in range(teams)], 2)
        if hot and rng.random() < hot:
            home, away = "T0", rng.choice([f"T{n}" for n in range(1, teams)])
        day = dt.date(2023, 10, 20) + dt.timedelta(days=rng.randint(0, 60))
        start = dt.datetime.combine(day, dt.time(rng.choice([12, 12, 18, 20])))
        kind = rng.choice(["Regular Season"] * 5 + ["Post Season", "Pre Season"])
        season = rng.choice(["2023-2024"] * 4 + ["2022-2023"])
        status = rng.choice(["Completed"] * 6 + ["In Progress", "Not Started"])
        done = status == "Completed" and rng.random() < 0.9
        score = (rng.randint(80, 99), rng.randint(80, 99)) if done else (None, None)
        out.append((i, start, home, away, season, kind, status, rng.random() < 0.3, done, *score))
    return pd.DataFrame(
        out,
        columns=["game_id", "start", "home_team", "away_team", "season", "season_type", "status",
                 "pre_game_data_finalized", "game_data_finalized", "home_score", "away_score"],
    )


def loaded(spark, pdf):
    games = spark.createDataFrame(pdf.drop(columns=["home_score", "away_score"]))
    games = games.withColumn("start", F.col("start").cast("timestamp_ntz"))
    scores = pdf.dropna(subset=["home_score"])[["game_id", "home_score", "away_score"]].astype("int64")
    return games, spark.createDataFrame(scores)


def priors(pdf, g, team, need_score=True):
    p = pdf[(pdf.start < g.start) & (pdf.season == g.season) & pdf.season_type.isin(COUNTED)]
    p = p[(p.home_team == team) | (p.away_team == team)]
    return p.dropna(subset=["home_score"]) if need_score else p


def side_values(p, team, side, day):
    home = (p.home_team == team).to_numpy()
    own = np.where(home, p.home_score, p.away_score)
    opp = np.where(home, p.away_score, p.home_score)
    days = np.array([(day - s.date()).days for s in p.start])
    weight = np.exp(-math.log(2) / 10 * days)
    here = home if side == "home" else ~home
    dates = {s.date() for s in p.start}
    before = {d for d in dates if d < day}
    begun = min(dates)
    freq = []
    for k in (5, 10, 30):
        at, n = max(day - dt.timedelta(days=k), begun), 0
        while at < day:
            n += 1 if at in before else -1
            at += dt.timedelta(days=1)
        freq.append(n)

    def form(o, q, w):
        return [np.sum((o > q) * w) / np.sum(w), np.sum(o * w) / np.sum(w), np.sum(q * w) / np.sum(w)]

    out = {"all": form(own, opp, np.ones(len(own))), "decay": form(own, opp, weight)}
    out["here"] = form(own[here], opp[here], np.ones(here.sum())) if here.any() else [0, None, None]
    out["rest"] = (day - max(before)).days if before else 0
    out["day"] = (day - begun).days
    out["freq"] = np.mean(freq)
    return out


@pytest.mark.parametrize("seed, hot", [(5, None), (6, 0.35)])
def test_features_match_recomputation(spark, seed, hot):
    pdf = schedule(seed, hot=hot)
    got = f.features(*loaded(spark, pdf)).toPandas().set_index("game_id")
    assert list(got.columns) == f.FEATURES and len(f.FEATURES) == 43
    expected = set()
    for g in pdf.itertuples():
        day = g.start.date()
        ph, pa = priors(pdf, g, g.home_team), priors(pdf, g, g.away_team)
        if ph.empty or pa.empty:
            continue
        expected.add(g.game_id)
        h, a = side_values(ph, g.home_team, "home", day), side_values(pa, g.away_team, "away", day)
        row = got.loc[g.game_id]
        for group, names in (("all", f.BASIC), ("here", f.CONTEXT), ("decay", f.DECAY)):
            (hw, hp, ho), (aw, ap, ao) = h[group], a[group]

            def net(x, y):
                return None if x is None or y is None else x - y

            want = [hw, hp, ho, net(hp, ho), aw, ap, ao, net(ap, ao), hw - aw, net(hp, ap), net(ho, ao),
                    net(net(hp, ho), net(ap, ao))]
            for name, value in zip(names, want):
                if value is None:
                    assert pd.isna(row[name]), (g.game_id, name)
                else:
                    assert row[name] == pytest.approx(value, abs=1e-9), (g.game_id, name)
        want = [(h["day"] + a["day"]) / 2, h["rest"], h["freq"], a["rest"], a["freq"],
                h["rest"] - a["rest"], h["freq"] - a["freq"]]
        assert list(row[f.REST]) == pytest.approx(want, abs=1e-9)
    assert set(got.index) == expected


@pytest.mark.parametrize("page,most", [(50, 1 << 20), (3, 8)])
def test_histories(spark, page, most):
    """Counts and lists of earlier games; pages end where they should, a busy season is cut."""
    pdf = schedule(9)
    games, finals = loaded(spark, pdf)
    counts = history.prior_counts(games, finals).toPandas().set_index(["game_id", "side"])
    wanted = games.filter("game_id IN (17, 100, 101, 102)")
    lists = {(r.game_id, r.side, r.page): r for r in history.prior_lists(games, finals, wanted, page, most).collect()}
    used = set()
    for g in pdf.itertuples():
        for side, team in (("home", g.home_team), ("away", g.away_team)):
            every, known = priors(pdf, g, team, False), priors(pdf, g, team)
            row = counts.loc[(g.game_id, side)]
            assert (row.needed, row.loaded) == (len(every), len(known))
            assert row.is_missing == (len(every) > 0 and len(known) == 0)
            if g.game_id in (17, 100, 101, 102):
                want = every.sort_values(["start", "game_id"]).game_id.tolist()
                cut = [want[k : k + page] for k in range(0, len(want), page)]
                assert [lists.pop((g.game_id, side, k)).prior_ids for k in range(len(cut))] == cut
                used |= set(want)
    assert not lists and len(used) > 3
    assert {r.game_id for r in history.prior_ids(games, wanted).collect()} == used
    flags = queues.finalize_pregame(games, history.prior_counts(games, finals)).toPandas().set_index("game_id").sort_index()
    missing = counts.groupby("game_id")["is_missing"].any().sort_index()
    assert (flags.pre_game_data_finalized == ~missing).all()


def test_games_needing_pregame(spark):
    pdf = schedule(11)
    games, _ = loaded(spark, pdf)
    want = set()
    for g in pdf[pdf.season_type.isin(COUNTED) & ~pdf.pre_game_data_finalized].itertuples():
        if g.status != "Not Started":
            want.add(g.game_id)
            continue
        earlier = pd.concat([priors(pdf, g, g.home_team, False), priors(pdf, g, g.away_team, False)])
        if earlier.game_data_finalized.all():
            want.add(g.game_id)
    got = {r.game_id for r in history.games_needing_pregame(games).collect()}
    assert got == want


def test_feature_json_round_trip(spark):
    games, finals = loaded(spark, schedule(5))
    typed = f.features(games, finals)
    back = f.widen_features(f.feature_json(typed)).toPandas().sort_values("game_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(typed.toPandas().sort_values("game_id").reset_index(drop=True), back)


@pytest.mark.parametrize("year", [1924, 2124])
def test_misdated_game_gives_no_nan(spark, year):
    pdf = schedule(5)
    wrong = pdf[(pdf.season == "2023-2024") & pdf.home_score.notna()].index[:3]
    pdf.loc[wrong, "start"] = pdf.loc[wrong, "start"].map(lambda s: s.replace(year=year))
    typed = f.features(*loaded(spark, pdf))
    odd = [F.sum((F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))).cast("int")).alias(c) for c in f.FEATURES]
    assert not any(typed.select(odd).first())
    weights = typed.filter("Time_Decay_Home_PPG IS NOT NULL")
    assert weights.count() == typed.count() > 0
    assert weights.filter("Time_Decay_Home_PPG NOT BETWEEN 80 AND 99").count() == 0


@pytest.mark.parametrize("block", [1, 2, 64])
def test_lists_take_their_shape_page_by_page(spark, monkeypatch, block):
    """Whole pages are shaped before games meet them, in blocks; the rows are those of the unshaped lists."""
    monkeypatch.setattr(history, "BLOCK_PAGES", block)
    games, finals = loaded(spark, schedule(9))
    text = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    shaped = history.prior_lists(games, finals, games, 3, 8, shape=text)
    got = sorted(tuple(r) for r in shaped.collect())
    want = {}
    pdf = schedule(9)
    for g in pdf.itertuples():
        for side, team in (("home", g.home_team), ("away", g.away_team)):
            ids = priors(pdf, g, team, False).sort_values(["start", "game_id"]).game_id.tolist()
            for k in range(0, len(ids), 3):
                want[g.game_id, side, k // 3] = ",".join(map(str, ids[k : k + 3]))
    assert {r[:3]: r[3] for r in got} == want and len(got) == len(want)
    has_final = {r.game_id for r in finals.collect()}
    assert all(r[4] == ",".join(x for x in r[3].split(",") if int(x) not in has_final) for r in got)
