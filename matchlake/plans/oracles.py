"""Reference SQL for the catalogue, in literal form.

Where the library uses running windows and prefix sums these use self-joins and
correlated subqueries, so the two sides share definitions but not methods.
"""

from __future__ import annotations

BASE = r"""
o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
games AS (
  SELECT o_orderkey AS game_id,
         o_orderdate + to_hours(CAST(cents % 24 AS INTEGER)) AS start,
         'NATION_' || (o_orderkey % 25) AS home_team,
         CASE WHEN cents % 101 = 0 THEN 'TBD'
              ELSE 'NATION_' || ((o_orderkey % 25 + 1 + (o_orderkey // 25) % 24) % 25) END AS away_team,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'In Progress'
              WHEN 'O' THEN 'Not Started' END AS status,
         CASE WHEN month(o_orderdate) < 7
              THEN (year(o_orderdate) - 1) || '-' || year(o_orderdate)
              ELSE year(o_orderdate) || '-' || (year(o_orderdate) + 1) END AS season,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Regular Season' WHEN '2-HIGH' THEN 'Regular Season'
              WHEN '3-MEDIUM' THEN 'Regular Season' WHEN '4-NOT SPECIFIED' THEN 'Post Season'
              WHEN '5-LOW' THEN 'Pre Season' END AS season_type,
         cents % 3 = 0 AS pre_game_data_finalized,
         (o_orderstatus = 'F') <> (cents % 97 = 0) AS game_data_finalized
  FROM o),
raw_lines AS (
  SELECT l_orderkey AS game_id, CAST(l_linenumber AS BIGINT) AS play_id, l_partkey AS part,
         l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem),
lines AS (
  SELECT l_orderkey AS game_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_discount, l_extendedprice, l_linestatus, l_returnflag, l_shipdate, l_tax) AS play_id,
         l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem),
ends AS (
  SELECT o_orderkey AS game_id, 900 + again AS play_id,
         CAST(85 + (cents // 100) % 61 + again AS INTEGER) AS home_score,
         CAST(85 + (cents // 7) % 59 AS INTEGER) AS away_score, cents
  FROM o, (VALUES (0), (1)) v(again)
  WHERE o_orderstatus = 'F' AND cents % 89 <> 0 AND (again = 0 OR cents % 83 = 0)),
line_plays AS (
  SELECT game_id, play_id, game_id % 2 = 0 AS running,
         CAST(1 + (play_id - 1) // 2 AS INTEGER) AS period, part, supp, qty,
         'PT' || lpad(CAST(part % 12 AS VARCHAR), 2, '0') || 'M' || lpad(CAST(supp % 60 AS VARCHAR), 2, '0')
              || '.' || lpad(CAST(qty % 100 AS VARCHAR), 2, '0') || 'S' AS clock,
         -((part % 12) * 60 + (supp % 60) + (qty % 100) / 100.0) AS clock_left,
         16 * play_id + qty % 17 AS h, 16 * play_id + supp % 17 AS a
  FROM lines),
raw_plays AS (
  SELECT game_id, play_id, game_id % 2 = 0 AS running,
         CAST(1 + (play_id - 1) // 2 AS INTEGER) AS period, part, supp, qty,
         'PT' || lpad(CAST(part % 12 AS VARCHAR), 2, '0') || 'M' || lpad(CAST(supp % 60 AS VARCHAR), 2, '0')
              || '.' || lpad(CAST(qty % 100 AS VARCHAR), 2, '0') || 'S' AS clock,
         -((part % 12) * 60 + (supp % 60) + (qty % 100) / 100.0) AS clock_left,
         16 * play_id + qty % 17 AS h, 16 * play_id + supp % 17 AS a
  FROM raw_lines),
plays AS (
  SELECT game_id, play_id, running, period, clock, clock_left,
         CASE WHEN running OR qty % 3 = 0 THEN h END AS told_home,
         CASE WHEN running OR qty % 3 = 1 THEN a END AS told_away,
         CASE WHEN qty % 23 <> 0 THEN CASE WHEN NOT running AND supp % 4 <> 0
              THEN 'Shot made by ' || part || ' (' || (qty % 40) || ' PTS)'
              ELSE 'Shot made by ' || part END END AS description,
         CASE WHEN part % 50 = 0 THEN 'XXX'
              WHEN play_id % 2 = 1 THEN 'NATION_' || (game_id % 25)
              ELSE 'NATION_' || ((game_id % 25 + 1 + (game_id // 25) % 24) % 25) END AS team_tricode,
         CASE WHEN part % 40 = 0 THEN 0 ELSE part END AS person_id,
         CASE WHEN part % 41 <> 0 THEN 'Player ' || part END AS player_name,
         CASE WHEN running THEN CASE WHEN supp % 7 <> 0 THEN qty % 40 END
              WHEN qty % 23 <> 0 AND supp % 4 <> 0 THEN qty % 40 END AS told_points,
         'made' AS sub_type
  FROM line_plays
  UNION ALL
  SELECT game_id, play_id, game_id % 2 = 0, 4, 'PT00M00.00S', 0.0, home_score, away_score, 'Game End',
         NULL, NULL, NULL, NULL, 'end' FROM ends),
plays_alt AS (
  SELECT game_id, play_id, period, clock, clock_left,
         CASE WHEN qty % 3 = 0 THEN h END AS told_home,
         CASE WHEN qty % 3 = 1 THEN a END AS told_away,
         CASE WHEN qty % 23 <> 0 THEN 'x' END AS description,
         CASE WHEN qty % 23 <> 0 AND supp % 4 <> 0 THEN qty % 40 END AS told_points, 'made' AS sub_type
  FROM line_plays
  UNION ALL
  SELECT game_id, play_id, 4, 'PT00M00.00S', 0.0, home_score, away_score, 'Game End', NULL, 'end' FROM ends),
states AS (
  SELECT game_id, play_id, 'NATION_' || (game_id % 25) AS home,
         'NATION_' || ((game_id % 25 + 1 + (game_id // 25) % 24) % 25) AS away, clock, period,
         h AS home_score, a AS away_score, false AS is_final_state, part AS ingest_seq FROM line_plays
  UNION ALL
  SELECT game_id, play_id, 'NATION_' || (game_id % 25),
         'NATION_' || ((game_id % 25 + 1 + (game_id // 25) % 24) % 25), 'PT00M00.00S', 4,
         home_score, away_score, true, 1000000000000 + cents FROM ends),
raw_states AS (
  SELECT game_id, play_id, period, h AS home_score, a AS away_score, false AS is_final_state,
         part AS ingest_seq FROM raw_plays
  UNION ALL
  SELECT game_id, play_id, 4, home_score, away_score, true, 1000000000000 + cents FROM ends),
finals AS (
  SELECT game_id, home_score, away_score FROM ends e
  WHERE play_id = (SELECT max(play_id) FROM ends f WHERE f.game_id = e.game_id)),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY play_id DESC) AS rn FROM states)
  WHERE rn = 1),
predictions AS (
  SELECT *, 1 / (1 + exp(-(-0.2504 + 0.1949 * (pred_home_score - pred_away_score)))) AS pred_home_win_pct
  FROM (
    SELECT o_orderkey AS game_id, predictor,
           o_orderdate + to_hours(CAST(cents % 24 AS INTEGER)) - to_minutes(CAST(cents % 40 - 10 AS INTEGER))
             AS prediction_ts,
           CAST(85 + (cents // 11) % 60 AS DOUBLE) + length(predictor) / 4.0::DOUBLE AS pred_home_score,
           CAST(85 + (cents // 13) % 60 AS DOUBLE) - length(predictor) / 8.0::DOUBLE AS pred_away_score
    FROM o, (VALUES ('Baseline'), ('Linear'), ('Tree')) v(predictor)
    WHERE (predictor = 'Baseline' AND o_totalprice >= 20000)
       OR (predictor = 'Linear' AND o_orderpriority <> '5-LOW')
       OR (predictor = 'Tree' AND o_orderstatus = 'F'))),
stored_features AS (
  SELECT o_orderkey AS game_id,
         CASE WHEN cents % 31 <> 0 THEN CAST(85 + (cents // 17) % 60 AS DOUBLE) END AS Home_PPG,
         CAST(85 + (cents // 19) % 60 AS DOUBLE) AS Home_OPP_PPG,
         CAST(85 + (cents // 23) % 60 AS DOUBLE) AS Away_PPG,
         CAST(85 + (cents // 29) % 60 AS DOUBLE) AS Away_OPP_PPG
  FROM o WHERE o_totalprice > 60000),
player_box AS (
  SELECT l_orderkey AS game_id, l_partkey AS player_id, CAST(sum(l_quantity) AS BIGINT) AS pts
  FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
team_box AS (
  SELECT l_orderkey AS game_id,
         CASE WHEN l_linenumber % 2 = 1 THEN 'NATION_' || (l_orderkey % 25)
              ELSE 'NATION_' || ((l_orderkey % 25 + 1 + (l_orderkey // 25) % 24) % 25) END AS team_id,
         CAST(sum(l_quantity) AS BIGINT) AS pts
  FROM lineitem GROUP BY ALL),
teams AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS team_id, n_name AS abbreviation FROM nation),
texts AS (
  SELECT o_orderkey AS game_id, cents, o_orderkey % 5 AS code,
         '00' || (o_orderkey % 7) || lpad(CAST((o_orderkey // 7) % 100 AS VARCHAR), 2, '0')
              || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS id_text,
         strftime(o_orderdate, '%Y-%m-%d') AS date_text, year(o_orderdate) AS y,
         CAST(o_orderdate AS DATE) + CAST(cents % 9000 AS INTEGER) AS day
  FROM o),
any_texts AS (
  SELECT *,
         CASE cents % 5 WHEN 0 THEN id_text WHEN 1 THEN '12' WHEN 2 THEN '1' || substr(id_text, 2, 9)
              WHEN 3 THEN id_text || '1' END AS any_id,
         CASE cents % 5 WHEN 0 THEN date_text WHEN 1 THEN replace(date_text, '-', '/')
              WHEN 2 THEN y || '-' || lpad(CAST(cents % 15 AS VARCHAR), 2, '0') || '-'
                   || lpad(CAST((cents // 15) % 34 AS VARCHAR), 2, '0')
              WHEN 3 THEN y || '-02-' || lpad(CAST(cents % 33 AS VARCHAR), 2, '0')
              ELSE '20241022' END AS any_date,
         CASE cents % 5 WHEN 0 THEN y || '-' || (y + 1) WHEN 1 THEN y || '-' || (y + 2)
              WHEN 2 THEN y || '-' || substr(CAST(y + 1 AS VARCHAR), 3, 2) WHEN 3 THEN y || '/' || (y + 1)
              ELSE (1000 + cents % 2000) || '-' || (1001 + cents % 2000) END AS any_season
  FROM texts),
clock_texts AS (
  SELECT game_id, play_id, CAST(1 + part % 7 AS INTEGER) AS period,
         CASE qty % 4 WHEN 1 THEN regexp_replace(clock, '\.\d+', '') WHEN 2 THEN '12:34' ELSE clock END
           AS clock
  FROM line_plays),
sides AS (
  SELECT g.game_id, 'home' AS side, g.home_team AS team, g.season, g.season_type, g.start,
         g.game_data_finalized, f.home_score AS own, f.away_score AS other
  FROM games g LEFT JOIN finals f USING (game_id)
  UNION ALL
  SELECT g.game_id, 'away', g.away_team, g.season, g.season_type, g.start,
         g.game_data_finalized, f.away_score, f.home_score
  FROM games g LEFT JOIN finals f USING (game_id)),
priors AS (
  SELECT t.game_id, t.side, t.season, t.team, t.start,
         count(p.game_id) AS needed, count(p.own) AS loaded
  FROM sides t LEFT JOIN sides p ON p.season = t.season AND p.team = t.team AND p.start < t.start
       AND p.season_type IN ('Regular Season', 'Post Season')
  GROUP BY ALL),
"""

FEATURES = r"""
pairs AS (
  SELECT t.game_id, t.side, CAST(t.start AS DATE) AS d, CAST(p.start AS DATE) AS pd, p.own, p.other,
         CASE WHEN p.own > p.other THEN 1.0 ELSE 0.0 END AS win, p.side = t.side AS here,
         exp(-ln(2) / 10 * date_diff('day', CAST(p.start AS DATE), CAST(t.start AS DATE))) AS w
  FROM sides t JOIN sides p ON p.season = t.season AND p.team = t.team AND p.start < t.start
  WHERE p.season_type IN ('Regular Season', 'Post Season') AND p.own IS NOT NULL),
form AS (
  SELECT game_id, side, avg(win) AS win, avg(own) AS ppg, avg(other) AS opp,
         coalesce(avg(win) FILTER (here), 0) AS cwin, avg(own) FILTER (here) AS cppg,
         avg(other) FILTER (here) AS copp,
         sum(w * win) / sum(w) AS dwin, sum(w * own) / sum(w) AS dppg, sum(w * other) / sum(w) AS dopp,
         coalesce(date_diff('day', max(pd) FILTER (pd < d), any_value(d)), 0) AS rest,
         date_diff('day', min(pd), any_value(d)) AS sday,
         (2 * count(DISTINCT pd) FILTER (pd BETWEEN d - 5 AND d - 1) - least(5, date_diff('day', min(pd), any_value(d)))
          + 2 * count(DISTINCT pd) FILTER (pd BETWEEN d - 10 AND d - 1) - least(10, date_diff('day', min(pd), any_value(d)))
          + 2 * count(DISTINCT pd) FILTER (pd BETWEEN d - 30 AND d - 1) - least(30, date_diff('day', min(pd), any_value(d)))
         ) / 3.0 AS freq
  FROM pairs GROUP BY game_id, side),
features AS (
  SELECT game_id,
    h.win AS "Home_Win_Pct", h.ppg AS "Home_PPG", h.opp AS "Home_OPP_PPG", h.ppg - h.opp AS "Home_Net_PPG",
    a.win AS "Away_Win_Pct", a.ppg AS "Away_PPG", a.opp AS "Away_OPP_PPG", a.ppg - a.opp AS "Away_Net_PPG",
    h.win - a.win AS "Win_Pct_Diff", h.ppg - a.ppg AS "PPG_Diff", h.opp - a.opp AS "OPP_PPG_Diff",
    (h.ppg - h.opp) - (a.ppg - a.opp) AS "Net_PPG_Diff",
    h.cwin AS "Home_Win_Pct_Home", h.cppg AS "Home_PPG_Home", h.copp AS "Home_OPP_PPG_Home",
    h.cppg - h.copp AS "Home_Net_PPG_Home",
    a.cwin AS "Away_Win_Pct_Away", a.cppg AS "Away_PPG_Away", a.copp AS "Away_OPP_PPG_Away",
    a.cppg - a.copp AS "Away_Net_PPG_Away",
    h.cwin - a.cwin AS "Win_Pct_Home_Away_Diff", h.cppg - a.cppg AS "PPG_Home_Away_Diff",
    h.copp - a.copp AS "OPP_PPG_Home_Away_Diff",
    (h.cppg - h.copp) - (a.cppg - a.copp) AS "Net_PPG_Home_Away_Diff",
    h.dwin AS "Time_Decay_Home_Win_Pct", h.dppg AS "Time_Decay_Home_PPG", h.dopp AS "Time_Decay_Home_OPP_PPG",
    h.dppg - h.dopp AS "Time_Decay_Home_Net_PPG",
    a.dwin AS "Time_Decay_Away_Win_Pct", a.dppg AS "Time_Decay_Away_PPG", a.dopp AS "Time_Decay_Away_OPP_PPG",
    a.dppg - a.dopp AS "Time_Decay_Away_Net_PPG",
    h.dwin - a.dwin AS "Time_Decay_Win_Pct_Diff", h.dppg - a.dppg AS "Time_Decay_PPG_Diff",
    h.dopp - a.dopp AS "Time_Decay_OPP_PPG_Diff",
    (h.dppg - h.dopp) - (a.dppg - a.dopp) AS "Time_Decay_Net_PPG_Diff",
    (h.sday + a.sday) / 2.0 AS "Day_of_Season", CAST(h.rest AS DOUBLE) AS "Home_Rest_Days",
    h.freq AS "Home_Game_Freq", CAST(a.rest AS DOUBLE) AS "Away_Rest_Days", a.freq AS "Away_Game_Freq",
    CAST(h.rest - a.rest AS DOUBLE) AS "Rest_Days_Diff", h.freq - a.freq AS "Game_Freq_Diff"
  FROM form h JOIN form a USING (game_id) WHERE h.side = 'home' AND a.side = 'away'),
"""

# Blend of a stored prediction with a state, in the weighted way.
LIVE = r"""
progress AS (
  SELECT *, CASE WHEN period <= 4 THEN 48.0 ELSE 48.0 + (period - 4) * 5 END AS expected,
         CASE WHEN period <= 4 THEN period * 12.0 ELSE 48.0 + (period - 4) * 5 END
           - coalesce(try_cast(nullif(regexp_extract(clock, 'PT(\d+)M(\d+\.\d+)S', 1), '') AS DOUBLE)
             + try_cast(nullif(regexp_extract(clock, 'PT(\d+)M(\d+\.\d+)S', 2), '') AS DOUBLE) / 60, 0) AS elapsed
  FROM live_in),
blended AS (
  SELECT *, elapsed / expected AS done,
    CASE WHEN period IS NULL THEN pred_home_score WHEN is_final_state THEN home_score
         ELSE elapsed / expected * greatest(least(CASE WHEN elapsed = 0 THEN 70 ELSE home_score / (elapsed / expected) END, 150), 70)
              + (1 - elapsed / expected) * pred_home_score END AS bh,
    CASE WHEN period IS NULL THEN pred_away_score WHEN is_final_state THEN away_score
         ELSE elapsed / expected * greatest(least(CASE WHEN elapsed = 0 THEN 70 ELSE away_score / (elapsed / expected) END, 150), 70)
              + (1 - elapsed / expected) * pred_away_score END AS ba
  FROM progress),
current AS (
  SELECT game_id, CAST(bh AS DOUBLE) AS pred_home_score, CAST(ba AS DOUBLE) AS pred_away_score,
    CAST(CASE WHEN period IS NULL THEN pred_home_win_pct
         WHEN is_final_state THEN CASE WHEN home_score > away_score THEN 1.0 ELSE 0.0 END
         ELSE 1 / (1 + exp(-(-0.2504 + 0.1949 * (1 + ln(48 / (expected - elapsed + 1))) * (bh - ba)))) END AS DOUBLE)
      AS pred_home_win_pct
  FROM blended),
"""
STORED_LIVE = r"""
live_in AS (
  SELECT p.game_id, p.pred_home_score, p.pred_away_score, p.pred_home_win_pct, p.prediction_ts,
         s.clock, s.period, s.home_score, s.away_score, s.is_final_state
  FROM predictions p LEFT JOIN latest s USING (game_id) WHERE p.predictor = 'Baseline'),
"""


def _states(source: str, running: str, described: str = "description IS NOT NULL") -> str:
    return rf"""
placed AS (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY period, clock_left, play_id) AS pos
  FROM {source} WHERE {described}),
carried AS (
  SELECT p.*, {running} AS run,
    coalesce((SELECT arg_max(q.told_home, q.pos) FROM placed q WHERE q.game_id = p.game_id AND q.pos <= p.pos
              AND q.told_home IS NOT NULL), 0) AS hs,
    coalesce((SELECT arg_max(q.told_away, q.pos) FROM placed q WHERE q.game_id = p.game_id AND q.pos <= p.pos
              AND q.told_away IS NOT NULL), 0) AS aws,
    p.pos = (SELECT max(pos) FROM placed q WHERE q.game_id = p.game_id) AS is_last
  FROM placed p),
derived AS (
  SELECT c.game_id, CAST(play_id AS BIGINT) AS play_id, strftime(g.start, '%Y-%m-%d') AS game_date,
         g.home_team AS home, g.away_team AS away, clock, CAST(period AS BIGINT) AS period,
         CAST(hs AS BIGINT) AS home_score, CAST(aws AS BIGINT) AS away_score,
         CAST(hs + aws AS BIGINT) AS total, CAST(hs - aws AS BIGINT) AS home_margin,
         CASE WHEN run THEN description = 'Game End' ELSE is_last AND sub_type = 'end' END AS is_final_state
  FROM carried c JOIN games g USING (game_id)),
"""


EVENTS = r"""
player_plays AS (
  SELECT p.*, CASE WHEN p.team_tricode = g.home_team THEN 'home' ELSE 'away' END AS side,
         row_number() OVER (PARTITION BY p.game_id ORDER BY period, clock_left, play_id) AS pos
  FROM plays p JOIN games g USING (game_id)
  WHERE description IS NOT NULL AND player_name IS NOT NULL AND (running OR person_id <> 0)),
timeline AS (
  SELECT p.game_id, CAST(p.play_id AS BIGINT) AS play_id, p.side, p.person_id,
    (SELECT arg_min(q.player_name, q.pos) FROM player_plays q
     WHERE q.game_id = p.game_id AND q.side = p.side AND q.person_id = p.person_id) AS name,
    CAST(coalesce((SELECT arg_max(q.told_points, q.pos) FROM player_plays q
     WHERE q.game_id = p.game_id AND q.side = p.side AND q.person_id = p.person_id AND q.pos <= p.pos
     AND q.told_points IS NOT NULL), 0) AS BIGINT) AS points, p.pos
  FROM player_plays p),
snapshot AS (
  SELECT game_id, side, person_id, name, points FROM timeline t
  WHERE pos = (SELECT max(pos) FROM timeline u WHERE u.game_id = t.game_id AND u.side = t.side
               AND u.person_id = t.person_id)),
predicted AS (
  SELECT game_id, CASE WHEN play_id % 2 = 1 THEN 'home' ELSE 'away' END AS side, part + supp % 2 AS person_id,
         max(qty % 30) AS pred_points
  FROM lines WHERE qty % 5 <> 0 GROUP BY ALL),
board AS (
  SELECT coalesce(s.game_id, p.game_id) AS game_id, coalesce(s.side, p.side) AS side,
         coalesce(s.person_id, p.person_id) AS person_id, coalesce(name, '') AS name,
         coalesce(points, 0) AS points, pred_points AS pre, s.points AS seen
  FROM snapshot s FULL JOIN predicted p ON s.game_id = p.game_id AND s.side = p.side AND s.person_id = p.person_id),
board_points AS (
  SELECT b.game_id, b.side, b.person_id, b.name, CAST(b.points AS BIGINT) AS points,
         CAST(coalesce(CASE WHEN l.is_final_state THEN b.seen ELSE b.pre END, 0) AS BIGINT) AS pred_points
  FROM board b LEFT JOIN latest l USING (game_id)),
"""

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {1}"
_START = _TS.format("start", "start")
_COUNTED = "season_type IN ('Regular Season', 'Post Season')"
_FINISHED = "status IN ('Completed', 'Final')"


def _rounded(columns: list[str]) -> str:
    return ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns)


def _sql(body: str, *extra: str) -> str:
    parts = (BASE + "".join(extra)).strip().rstrip(",")
    return f"WITH {parts}\n{body}"


def _feature_queries() -> dict[str, str]:
    from matchlake.operators import features as f

    groups = {
        "features": f.FEATURES,
        "feat_basic": f.BASIC,
        "feat_context": f.CONTEXT,
        "feat_decay": f.DECAY,
        "feat_rest": f.REST,
    }
    known = ", ".join(f'"{c}"' for c in f.FEATURES)
    filled = ", ".join(f'round(coalesce("{c}", 0), 6) AS "{c}"' for c in f.FEATURES)
    complete = " AND ".join(f'"{c}" IS NOT NULL' for c in f.FEATURES)
    modelled = f"""FROM games g JOIN finals f USING (game_id) JOIN (SELECT game_id, {known} FROM features) s USING (game_id)
          WHERE {_COUNTED} AND game_data_finalized AND pre_game_data_finalized"""
    stored = {
        "load_features": f"""SELECT game_id, {_rounded(f.FEATURES)} FROM features
          WHERE game_id IN (SELECT c_custkey * 20 FROM customer)""",
        "score_rows": f"SELECT game_id, {filled} FROM features",
        "modeling_table": f"""SELECT g.game_id, {_START}, home_team, away_team, season, season_type,
            CAST(home_score AS BIGINT) AS home_score, CAST(away_score AS BIGINT) AS away_score,
            CAST(home_score + away_score AS BIGINT) AS total, CAST(home_score - away_score AS BIGINT) AS home_margin,
            {_rounded(f.FEATURES)} {modelled}""",
        "train_rows": f"""SELECT g.game_id, CASE season WHEN '1997-1998' THEN 'train' ELSE 'test' END AS part,
            CAST(home_score AS BIGINT) AS home_score, CAST(away_score AS BIGINT) AS away_score,
            {_rounded(f.FEATURES)} {modelled} AND {complete} AND season IN ('1997-1998', '1998-1999')""",
    }
    names = ", ".join(f"'{c}'" for c in f.FEATURES)
    trained = f"(SELECT count(*) {modelled} AND {complete} AND season = '1997-1998') AS n"
    stored["ridge_gradient"] = f"""SELECT side, feature, {trained}, 0.0::DOUBLE AS gradient
        FROM (VALUES ('home'), ('away')) s(side), (SELECT unnest([{names}, 'intercept']) AS feature)"""
    stored["tree_gain"] = f"SELECT side, {trained}, true AS gains FROM (VALUES ('home'), ('away')) s(side)"
    inputs = ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in f.FEATURES)

    def layer(k: int, source: str, wide: int, high: int, act: str) -> str:
        weight = f"((31 * i + 17 * j + {7 * k}) % 41 - 20) / (20 * sqrt({wide}))"
        return f"""SELECT game_id, i AS j, {act.format(f"sum(x * {weight}) + (i % 5 - 2) / 10.0")} AS x
          FROM {source}, (SELECT unnest(range({high})) AS i) GROUP BY game_id, i"""

    dense = f"""
dense_0 AS (
  SELECT game_id, list_position([{names}], name) - 1 AS j, v / 100 AS x
  FROM (UNPIVOT (SELECT game_id, {inputs} FROM features) ON COLUMNS(* EXCLUDE game_id) INTO NAME name VALUE v)),
dense_1 AS ({layer(0, "dense_0", len(f.FEATURES), 64, "greatest({}, 0)")}),
dense_2 AS ({layer(1, "dense_1", 64, 32, "greatest({}, 0)")}),
dense_3 AS ({layer(2, "dense_2", 32, 2, "({}) * 12 + 110")}),
dense AS (
  SELECT game_id, max(x) FILTER (j = 0) AS pred_home_score, max(x) FILTER (j = 1) AS pred_away_score
  FROM dense_3 GROUP BY game_id),
"""
    chance = "1 / (1 + exp(-(-0.2504 + 0.1949 * (pred_home_score - pred_away_score))))"
    network = _sql(
        f"""SELECT game_id, round(pred_home_score, 6) AS pred_home_score, round(pred_away_score, 6) AS pred_away_score,
        round({chance}, 6) AS pred_home_win_pct FROM dense""",
        FEATURES,
        dense,
    )
    return {"pred_dense": network} | {
        k: _sql(f"SELECT game_id, {_rounded(names)} FROM features", FEATURES)
        for k, names in groups.items()
    } | {k: _sql(body, FEATURES) for k, body in stored.items()}


_DATASETS = {
    "plays": "lines",
    "states": "states",
    "player_box": "player_box",
    "features": "stored_features",
    "predictions": "predictions",
}
_COVERAGE = (
    "finished AS (SELECT game_id, season FROM games WHERE "
    + f"{_COUNTED} AND {_FINISHED}),\ncovered AS ("
    + " UNION ALL ".join(
        f"SELECT season, '{n}' AS dataset, count(*) FILTER (game_id IN (SELECT game_id FROM {s})) AS covered, "
        f"count(*) AS total FROM finished GROUP BY season"
        for n, s in _DATASETS.items()
    )
    + "),\ncoverage AS (SELECT *, covered * 100.0 / total AS percent, CASE WHEN covered * 100.0 / total >= 95 "
    "THEN 'good' WHEN covered * 100.0 / total >= 80 THEN 'fair' ELSE 'poor' END AS mark FROM covered),"
)

_METRICS = r"""
scored AS (
  SELECT p.predictor, p.game_id, p.pred_home_score AS ph, p.pred_away_score AS pa, p.pred_home_win_pct AS pct,
         f.home_score AS h, f.away_score AS a,
         least(greatest(1 / (1 + exp(-0.15 * (p.pred_home_score - p.pred_away_score))), 0.001), 0.999) AS c,
         CASE WHEN f.home_score > f.away_score THEN 1.0 ELSE 0.0 END AS won
  FROM predictions p JOIN games g USING (game_id) JOIN finals f USING (game_id)),
"""
_METRIC_LIST = """
  round(avg(abs(ph - h)), 3) AS home_mae, round(avg(abs(pa - a)), 3) AS away_mae,
  round((avg(abs(ph - h)) + avg(abs(pa - a))) / 2, 3) AS avg_score_mae,
  round(sqrt(avg((ph - h) * (ph - h))), 3) AS home_rmse, round(sqrt(avg((pa - a) * (pa - a))), 3) AS away_rmse,
  round(avg(abs((ph - pa) - (h - a))), 3) AS margin_mae, round(avg(abs((ph + pa) - (h + a))), 3) AS total_mae,
  round(avg(CASE WHEN (ph - pa > 0) = (h - a > 0) THEN 1.0 ELSE 0.0 END), 4) AS win_accuracy,
  round(avg((c - won) * (c - won)), 4) AS brier_score,
  round(avg(-(won * ln(c) + (1 - won) * ln(1 - c))), 4) AS log_loss, count(*) AS n_samples
"""

_AUDITS = {
    "FLAG-001": ("critical", "Flag", True, f"""SELECT game_id, status, {_START} FROM games g WHERE game_data_finalized
        AND NOT EXISTS (SELECT 1 FROM states s WHERE s.game_id = g.game_id AND s.is_final_state)"""),
    "FLAG-002": ("critical", "Flag", True, f"""SELECT game_id, status, {_START} FROM games g WHERE game_data_finalized
        AND NOT EXISTS (SELECT 1 FROM plays p WHERE p.game_id = g.game_id)"""),
    "FLAG-003": ("critical", "Flag", False, f"""SELECT game_id, home_team, away_team, {_START} FROM games g
        WHERE pre_game_data_finalized AND NOT EXISTS (SELECT 1 FROM stored_features f WHERE f.game_id = g.game_id)"""),
    "FLAG-004": ("warning", "Flag", False, f"""SELECT game_id, home_team, away_team, {_START},
          h AS home_prior_count, a AS away_prior_count FROM (
          SELECT g.*, (SELECT count(*) FROM sides p WHERE p.team = g.home_team AND p.start < g.start
                AND p.season = g.season AND p.{_COUNTED} AND p.game_data_finalized) AS h,
            (SELECT count(*) FROM sides p WHERE p.team = g.away_team AND p.start < g.start
                AND p.season = g.season AND p.{_COUNTED} AND p.game_data_finalized) AS a
          FROM games g WHERE pre_game_data_finalized) WHERE h = 0 OR a = 0"""),
    "FLAG-005": ("critical", "Flag", True, """SELECT game_id, home_team, away_team, status FROM games
        WHERE pre_game_data_finalized AND NOT game_data_finalized"""),
    "FLAG-006": ("warning", "Flag", True, f"""SELECT game_id, status, {_START} FROM games g WHERE status = 'Completed'
        AND NOT game_data_finalized
        AND EXISTS (SELECT 1 FROM states s WHERE s.game_id = g.game_id AND s.is_final_state)"""),
    "TEAM-001": ("critical", "Team", False, """SELECT g.game_id, p.team_tricode, g.home_team, g.away_team,
        count(*) AS play_count FROM plays p JOIN games g USING (game_id)
        WHERE p.team_tricode NOT IN (g.home_team, g.away_team) GROUP BY ALL"""),
    "TEAM-002": ("critical", "Team", False, """SELECT s.game_id, s.home, s.away, g.home_team, g.away_team,
        count(*) AS state_count FROM states s JOIN games g USING (game_id)
        WHERE s.home <> g.home_team OR s.away <> g.away_team GROUP BY ALL"""),
    "TEAM-003": ("warning", "Team", False, """SELECT team FROM (SELECT home_team AS team FROM games UNION
        SELECT away_team FROM games) c WHERE NOT EXISTS (SELECT 1 FROM teams t WHERE t.abbreviation = c.team)"""),
    "TEAM-004": ("critical", "Team", False, f"""SELECT team FROM (
        SELECT home_team AS team FROM games WHERE season IN ('1998-1999', '1999-2000') AND {_COUNTED} UNION
        SELECT away_team FROM games WHERE season IN ('1998-1999', '1999-2000') AND {_COUNTED}) c
        WHERE NOT EXISTS (SELECT 1 FROM teams t WHERE t.abbreviation = c.team)"""),
    "TEAM-005": ("critical", "Team", False, """SELECT b.game_id, b.team_id, g.home_team, g.away_team
        FROM team_box b JOIN games g USING (game_id) WHERE b.team_id NOT IN (g.home_team, g.away_team)"""),
    "INTEGRITY-001": ("critical", "Integrity", True, """SELECT game_id, count(*) AS log_count FROM plays p
        WHERE NOT EXISTS (SELECT 1 FROM games_seen g WHERE g.game_id = p.game_id) GROUP BY game_id"""),
    "INTEGRITY-002": ("critical", "Integrity", True, """SELECT game_id, count(*) AS state_count FROM states p
        WHERE NOT EXISTS (SELECT 1 FROM games_seen g WHERE g.game_id = p.game_id) GROUP BY game_id"""),
    "INTEGRITY-003": ("critical", "Integrity", True, """SELECT game_id FROM stored_features p
        WHERE NOT EXISTS (SELECT 1 FROM games_seen g WHERE g.game_id = p.game_id)"""),
    "INTEGRITY-004": ("warning", "Integrity", True, """SELECT game_id, predictor FROM predictions p
        WHERE NOT EXISTS (SELECT 1 FROM games_seen g WHERE g.game_id = p.game_id)"""),
    "INTEGRITY-006": ("critical", "Integrity", True, """SELECT game_id, play_id, count(*) AS dup_count
        FROM audited GROUP BY game_id, play_id HAVING count(*) > 1"""),
    "SCORE-001": ("critical", "Score", False, """SELECT DISTINCT game_id, play_id, CAST(period AS BIGINT) AS period,
        CAST(home_score AS BIGINT) AS home_score, CAST(away_score AS BIGINT) AS away_score FROM audited x
        WHERE EXISTS (SELECT 1 FROM audited y WHERE y.game_id = x.game_id AND y.period = x.period
          AND y.play_id < x.play_id AND (y.home_score > x.home_score OR y.away_score > x.away_score))"""),
    "SCORE-002": ("critical", "Score", False, """SELECT game_id, play_id, CAST(period AS BIGINT) AS period,
        CAST(home_score AS BIGINT) AS home_score, CAST(away_score AS BIGINT) AS away_score FROM audited
        WHERE home_score < 0 OR away_score < 0"""),
    "SCORE-003": ("critical", "Score", False, """SELECT DISTINCT game_id, n AS unique_finals,
        home_score || '-' || away_score AS score FROM states JOIN (
          SELECT game_id, count(DISTINCT home_score || '-' || away_score) AS n FROM states WHERE is_final_state
          GROUP BY game_id HAVING count(DISTINCT home_score || '-' || away_score) > 1) USING (game_id)
        WHERE is_final_state"""),
    "SCORE-004": ("warning", "Score", False, """SELECT game_id, play_id, CAST(hd AS BIGINT) AS home_diff,
        CAST(ad AS BIGINT) AS away_diff FROM (SELECT game_id, play_id,
          home_score - lag(home_score) OVER (PARTITION BY game_id ORDER BY play_id) AS hd,
          away_score - lag(away_score) OVER (PARTITION BY game_id ORDER BY play_id) AS ad FROM states)
        WHERE hd > 10 OR ad > 10"""),
    "VOL-001": ("warning", "Volume", False, """SELECT game_id, count(*) AS play_count FROM plays GROUP BY game_id
        HAVING count(*) < 300 OR count(*) > 800"""),
    "VOL-002": ("warning", "Volume", False, """SELECT game_id, play_count, state_count FROM (
          SELECT p.game_id, count(*) AS play_count,
            (SELECT count(*) FROM audited s WHERE s.game_id = p.game_id) AS state_count
          FROM plays p GROUP BY p.game_id) WHERE play_count <> state_count"""),
    "TEMP-001": ("warning", "Temporal", False, f"""SELECT game_id, {_START}, status FROM games
        WHERE status = 'Completed' AND start > TIMESTAMP '1999-01-01'"""),
    "TEMP-002": ("warning", "Temporal", False, """SELECT DISTINCT game_id FROM audited x WHERE EXISTS (
        SELECT 1 FROM audited y WHERE y.game_id = x.game_id AND y.play_id > x.play_id
        AND y.ingest_seq < x.ingest_seq)"""),
}
_SEEN = "games_seen AS (SELECT * FROM games WHERE status <> 'Not Started'),\n"
_ALL_SEEN = "games_seen AS (SELECT * FROM games),\n"
_RAW = "audited AS (SELECT * FROM raw_states),\n"
_KEPT = "audited AS (SELECT * FROM states),\n"
_LOW = (
    "audited AS (SELECT game_id, play_id, period, home_score - 40 AS home_score, "
    "away_score - 40 AS away_score FROM states),\n"
)


def _audit_queries() -> dict[str, str]:
    keys = {"VOL": "volume", "TEMP": "temp"}
    given = {"SCORE-002": _LOW, "SCORE-001": _RAW, "INTEGRITY-006": _RAW, "VOL-002": _RAW, "TEMP-002": _RAW}
    out = {}
    for rule, (_, _, _, body) in _AUDITS.items():
        family, number = rule.split("-")
        key = f"v_{keys.get(family, family.lower())}_{number}"
        out[key] = _sql(body, _SEEN, given.get(rule, _KEPT))
    out["v_flag_002"] = _sql(_AUDITS["FLAG-002"][3].replace("FROM plays p WHERE", "FROM plays p WHERE p.game_id % 13 <> 0 AND"))
    out["v_volume_001"] = _sql(_AUDITS["VOL-001"][3].replace("300", "3").replace("800", "6"))
    out["v_integrity_005"] = _sql(
        """SELECT * FROM (
          SELECT 'games' AS "table", 'away_team' AS field, count(*) FILTER (away_team = 'TBD') AS nulls FROM games
          UNION ALL
          SELECT 'states', 'home_score', count(*) FILTER (home_score = 100) FROM states) WHERE nulls > 0"""
    )
    counts = " UNION ALL ".join(
        f"SELECT '{r}' AS check_id, '{sev}' AS severity, '{cat}' AS category, {str(fix).lower()} AS fixable, "
        f"count(*) AS count, array_to_string((list(j ORDER BY j))[1:5], ';') AS first_rows "
        f"FROM (SELECT CAST(to_json(t) AS VARCHAR) AS j FROM ({body}) t)"
        for r, (sev, cat, fix, body) in _AUDITS.items()
    )
    out["validation_report"] = _sql(
        f"SELECT *, least(count, 5) AS samples FROM ({counts}) WHERE count > 0", _ALL_SEEN, _KEPT
    )
    out["validation_summary"] = _sql(
        f"SELECT severity, count(*) AS issues, CAST(sum(count) AS BIGINT) AS rows FROM ({counts}) "
        "WHERE count > 0 AND category IN ('Flag', 'Team') GROUP BY severity",
        _ALL_SEEN,
        _KEPT,
    )
    return out


_STATE_COLUMNS = "SELECT * FROM derived"
_RUN_OF_FIRST = (
    "(SELECT arg_min(q.running, q.pos) FROM placed q WHERE q.game_id = p.game_id)"
)

_BOX = """
box AS (
  SELECT o_orderkey AS game_id, o_orderstatus AS st, cents, 0 AS shift, o_orderkey % 25 AS idx FROM o
  UNION ALL
  SELECT o_orderkey, o_orderstatus, cents, 1, (o_orderkey % 25 + 1 + (o_orderkey // 25) % 24) % 25 FROM o),
"""
_NULL_STATS = ["stl", "blk", "tov", "pf", "fga", "fgm", "fg3a", "fg3m", "fta", "ftm", "plus_minus"]
_NULL_PCTS = ["fg3_pct", "ft_pct"]
_NULLS = ", ".join(
    [f"CAST(NULL AS BIGINT) AS {c}" for c in _NULL_STATS]
    + [f"CAST(NULL AS DOUBLE) AS {c}" for c in _NULL_PCTS]
)


def _box_players(name: str, position: str) -> str:
    return _sql(
        f"""SELECT game_id * 2 + shift + n * 1000000000000 AS player_id, game_id, CAST(idx AS VARCHAR) AS team_id, {name} AS player_name,
          {position} AS position, round(cents % 40 + (cents % 60) / 60.0, 6) AS min, (cents + shift + n) % 30 AS pts,
          CAST(NULL AS BIGINT) AS reb, CAST(NULL AS BIGINT) AS ast, CAST(NULL AS DOUBLE) AS fg_pct, {_NULLS},
          (cents + shift + n) % 7 AS oreb, CAST(NULL AS BIGINT) AS dreb
        FROM box, (VALUES (0), (1)) v(n) WHERE shift = 1 OR st <> 'O'""",
        _BOX,
    )


def _box_teams(points: str) -> str:
    return _sql(
        f"""SELECT CAST(b.idx AS VARCHAR) AS team_id, b.game_id, b.p AS pts, c.p AS pts_allowed,
          30 + (b.cents + b.shift) % 20 AS reb, 15 + (b.cents + b.shift) % 15 AS ast,
          round((b.cents + b.shift) % 100 / 100.0, 6) AS fg_pct, {_NULLS}
        FROM pts b JOIN pts c ON b.game_id = c.game_id AND b.shift <> c.shift""",
        _BOX,
        f"pts AS (SELECT *, {points} AS p FROM box),",
    )


def _fault(cases: str) -> str:
    return f"CASE {cases} END AS fault"


def oracle_sql() -> dict[str, str]:
    month = "CAST(substr(any_date, 6, 2) AS INTEGER)"
    day = "CAST(substr(any_date, 9, 2) AS INTEGER)"
    shaped = r"regexp_matches(any_date, '^\d{4}-\d{2}-\d{2}$')"

    def season_fault(shape: str, second: str, name: str) -> str:
        return f"""CASE WHEN NOT regexp_matches(any_season, '{shape}') THEN 'bad format'
          WHEN try_cast(substr(any_season, 1, 4) AS INTEGER) + 1 <> {second} THEN 'not consecutive'
          WHEN try_cast(substr(any_season, 1, 4) AS INTEGER) < 1900 OR {second} > 2100 THEN 'out of range'
          END AS {name}"""

    tail = "try_cast(split_part(any_season, '-', 2) AS INTEGER)"
    face = (
        r"CAST(CAST(regexp_extract(clock, '^PT(\d+)M(\d+)', 1) AS INTEGER) AS VARCHAR) || ':' || "
        r"lpad(regexp_extract(clock, '^PT(\d+)M(\d+)', 2), 2, '0')"
    )
    period_name = (
        "CASE period WHEN 1 THEN '1st Quarter' WHEN 2 THEN '2nd Quarter' WHEN 3 THEN '3rd Quarter' "
        "WHEN 4 THEN '4th Quarter' WHEN 5 THEN 'Overtime' WHEN 6 THEN '2nd Overtime' "
        "WHEN 7 THEN '3rd Overtime' WHEN 8 THEN '4th Overtime' WHEN 9 THEN '5th Overtime' "
        "ELSE 'Crazy Overtime' END"
    )
    when_label = f"""CASE WHEN period IS NOT NULL AND (status = 'In Progress' OR NOT is_final_state)
        THEN {face} || ' - ' || {period_name}
        ELSE CASE CAST(start AS DATE) - DATE '1998-07-01' WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow'
             WHEN -1 THEN 'Yesterday' ELSE strftime(start, '%b %d') END || ' - ' ||
             CASE WHEN status = 'Completed' THEN 'Final' ELSE ltrim(strftime(start, '%I:%M %p'), '0') END END"""
    share = "CASE WHEN p >= 0.5 THEN p ELSE 1 - p END"
    percent = (
        f"CASE WHEN {share} = 1 THEN '100%' WHEN {share} >= 0.995 THEN '>99%' "
        f"ELSE CAST(round_even({share} * 100, 0) AS INTEGER) || '%' END"
    )
    chance = "1 / (1 + exp(-(-0.2504 + 0.1949 * {0} * (pred_home_score - pred_away_score))))"
    stretched = (
        "greatest(least(CASE WHEN r = 1 THEN 70 WHEN r = 0 THEN pred_away_score "
        "ELSE pred_away_score / (1 - r) END, 150), 70)"
    )
    logistic = "(1 / (1 + exp(-10 * ((1 - r) - 0.5))))"
    sync_new = r"""
delivered AS (
  SELECT game_id, start, home_team, CASE WHEN away_team <> 'TBD' THEN away_team END AS away_team,
         CASE WHEN status = 'In Progress' AND hour(start) >= 18 THEN 'Completed' ELSE status END AS status,
         season, season_type
  FROM games WHERE season_type <> 'Pre Season'
  UNION ALL
  SELECT -1 - game_id, start, home_team, away_team, status, season, season_type FROM games WHERE hour(start) = 0),
"""
    plain = {
        "prior_games": f"SELECT game_id, side, season, team, {_START}, needed FROM priors",
        "prior_states": "SELECT game_id, side, needed, loaded FROM priors",
        "prior_lists": f"""SELECT game_id, side, CAST((n - 1) // 50 AS BIGINT) AS page,
            string_agg(CAST(prior AS VARCHAR), ',' ORDER BY n) AS prior_ids,
            coalesce(string_agg(CAST(prior AS VARCHAR), ',' ORDER BY n) FILTER (WHERE NOT told), '') AS missing_ids
          FROM (SELECT a.game_id, a.side, p.game_id AS prior, EXISTS (SELECT 1 FROM finals f WHERE f.game_id = p.game_id) AS told,
              row_number() OVER (PARTITION BY a.game_id, a.side ORDER BY p.start, p.game_id) AS n
            FROM sides a JOIN sides p ON p.season = a.season AND p.team = a.team AND p.start < a.start AND p.{_COUNTED}
            WHERE a.game_id IN (SELECT c_custkey * 20 FROM customer))
          GROUP BY ALL""",
        "prior_ids": f"""SELECT DISTINCT p.game_id
          FROM sides a JOIN sides p ON p.season = a.season AND p.team = a.team AND p.start < a.start AND p.{_COUNTED}
          WHERE a.game_id IN (SELECT c_custkey * 20 FROM customer)""",
        "prior_missing": "SELECT game_id, side FROM priors WHERE needed > 0 AND loaded = 0",
        "need_pregame": f"""SELECT game_id FROM games WHERE {_COUNTED} AND NOT pre_game_data_finalized
            AND status IN ('Completed', 'In Progress')
          UNION
          SELECT g.game_id FROM games g WHERE {_COUNTED} AND NOT pre_game_data_finalized AND status = 'Not Started'
            AND NOT EXISTS (SELECT 1 FROM sides p WHERE p.season = g.season AND p.{_COUNTED}
              AND p.team IN (g.home_team, g.away_team) AND p.start < g.start AND NOT p.game_data_finalized)""",
        "finalize_pregame": """SELECT game_id, NOT bool_or(needed > 0 AND loaded = 0) AS pre_game_data_finalized
          FROM priors GROUP BY game_id""",
        "play_order": """SELECT game_id, CAST(play_id AS BIGINT) AS play_id, row_number() OVER (
          PARTITION BY game_id ORDER BY period, clock_left, play_id) AS position FROM plays""",
        "latest_state": """SELECT game_id, CAST(play_id AS BIGINT) AS play_id, home, away, clock,
          CAST(period AS BIGINT) AS period, CAST(home_score AS BIGINT) AS home_score,
          CAST(away_score AS BIGINT) AS away_score, is_final_state, ingest_seq FROM states s
          WHERE play_id = (SELECT max(play_id) FROM states m WHERE m.game_id = s.game_id)""",
        "finalize_games": """SELECT game_id, game_data_finalized OR game_id IN (SELECT game_id FROM ends)
          AS game_data_finalized FROM games""",
        "need_collect": f"""SELECT game_id FROM games WHERE {_COUNTED} AND {_FINISHED}
          AND NOT game_data_finalized""",
        "in_progress": f"SELECT game_id FROM games WHERE {_COUNTED} AND status = 'In Progress'",
        "games_on_date": "SELECT game_id FROM games WHERE CAST(start AS DATE) = DATE '1998-07-01'",
        "need_box": f"""SELECT game_id, {_START} FROM games g WHERE {_COUNTED} AND {_FINISHED}
          AND game_data_finalized AND NOT EXISTS (SELECT 1 FROM player_box b WHERE b.game_id = g.game_id)""",
        "need_prediction": f"""SELECT g.game_id FROM games g LEFT JOIN predictions p ON g.game_id = p.game_id
          AND p.predictor = 'Baseline' WHERE {_COUNTED} AND pre_game_data_finalized AND p.game_id IS NULL""",
        "lookup_games": f"""SELECT game_id, home_team, away_team, {_START}, status, season, season_type FROM games
          WHERE game_id IN (SELECT c_custkey * 20 FROM customer)""",
        "lookup_missing": """SELECT DISTINCT c_custkey * 20 AS game_id FROM customer
          WHERE c_custkey * 20 NOT IN (SELECT game_id FROM games)""",
        "season_subset": """SELECT DISTINCT season FROM games WHERE season NOT IN (
          SELECT season FROM games WHERE start < TIMESTAMP '2000-01-01')""",
        "refresh_due": """SELECT season, season = '2000-2001' OR l.t IS NULL
            OR epoch(TIMESTAMP '1999-06-30 18:00:00') - epoch(l.t) > 60 * 60 * 24 * 30 AS is_due
          FROM (SELECT DISTINCT season FROM games) LEFT JOIN (
            SELECT season, max(start) AS t FROM games WHERE status = 'Completed' AND season <> '1994-1995'
            GROUP BY season) l USING (season)""",
        "play_quality": """SELECT game_id, p AS play_count, s AS state_count, f = 1 AS has_final_state,
            concat_ws('; ', CASE WHEN p < 3 THEN 'Low play count: ' || p || ' (expected 3-6)'
                WHEN p > 6 THEN 'High play count: ' || p || ' (expected 3-6)' END,
              CASE WHEN p <> s THEN 'Plays and states differ: ' || p || ' vs ' || s END,
              CASE WHEN f = 0 THEN 'No final state' WHEN f > 1 THEN 'Multiple final states: ' || f END,
              CASE WHEN fell IS NOT NULL THEN 'Score decreased at play ' || fell END) AS issues,
            CASE WHEN p BETWEEN 3 AND 6 AND p = s AND f = 1 AND fell IS NULL THEN 'PASS' ELSE 'FAIL' END AS quality
          FROM (SELECT g.game_id, (SELECT count(*) FROM lines l WHERE l.game_id = g.game_id) AS p,
              (SELECT count(*) FROM states t WHERE t.game_id = g.game_id) AS s,
              (SELECT count(*) FROM ends e WHERE e.game_id = g.game_id) AS f,
              (SELECT min(play_id) FROM decreases d WHERE d.game_id = g.game_id) AS fell FROM games g)""",
        "game_counts": """SELECT *, round(plays * 1.0 / nullif(plays + states + player_box + features + predictions
            + team_box, 0), 6) AS plays_share FROM (
          SELECT game_id, away_team || ' @ ' || home_team AS matchup, status,
            (SELECT count(*) FROM lines x WHERE x.game_id = g.game_id) AS plays,
            (SELECT count(*) FROM states x WHERE x.game_id = g.game_id) AS states,
            (SELECT count(*) FROM player_box x WHERE x.game_id = g.game_id) AS player_box,
            (SELECT count(*) FROM stored_features x WHERE x.game_id = g.game_id) AS features,
            (SELECT count(*) FROM predictions x WHERE x.game_id = g.game_id) AS predictions,
            (SELECT count(*) FROM team_box x WHERE x.game_id = g.game_id) AS team_box FROM games g)""",
        "fix_flags": """SELECT game_id, pre AND d2 AS pre_game_data_finalized, d2 OR s6 AS game_data_finalized,
            d AND NOT f AS fixed_001, d AND f AND NOT t AS fixed_002, pre AND NOT d2 AS fixed_005, s6 AS fixed_006
          FROM (SELECT *, d AND f AND t AS d2, status = 'Completed' AND NOT (d AND f AND t) AND f AS s6 FROM (
            SELECT game_id, status, pre_game_data_finalized AS pre, game_data_finalized AS d,
              game_id IN (SELECT game_id FROM ends) AS f, game_id IN (SELECT game_id FROM lines) AS t FROM games))""",
        "fix_orphans": """SELECT game_id, CAST(play_id AS BIGINT) AS play_id, CAST(home_score AS BIGINT) AS home_score,
          CAST(away_score AS BIGINT) AS away_score FROM states
          WHERE game_id IN (SELECT game_id FROM games WHERE status <> 'Not Started')""",
        "fix_duplicates": """SELECT game_id, CAST(play_id AS BIGINT) AS play_id, CAST(home_score AS BIGINT) AS home_score,
            CAST(away_score AS BIGINT) AS away_score, ingest_seq
          FROM (SELECT *, row_number() OVER (PARTITION BY game_id, play_id
            ORDER BY ingest_seq, home_score, away_score) AS n FROM raw_states) WHERE n = 1""",
        "pred_ensemble": f"""SELECT game_id, round(pred_home_score, 6) AS pred_home_score,
            round(pred_away_score, 6) AS pred_away_score, members, round({chance.format(1)}, 6) AS pred_home_win_pct
          FROM (SELECT game_id, avg(pred_home_score) AS pred_home_score, avg(pred_away_score) AS pred_away_score,
            count(*) AS members FROM predictions GROUP BY game_id)""",
        "prediction_lead": """SELECT game_id, predictor, round(m, 6) AS minutes,
            CASE WHEN m < 0 THEN 'late' WHEN m < 10 THEN 'tight' ELSE 'ok' END AS lead
          FROM (SELECT p.game_id, predictor, (epoch(start) - epoch(prediction_ts)) / 60.0::DOUBLE AS m
            FROM predictions p JOIN games g USING (game_id))""",
        "best_model": """SELECT p_partkey AS model_id, p_brand AS model_type, 'active' AS status,
            CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / 100, 6) END AS avg_score_mae,
            CAST(p_size AS BIGINT) AS run_size
          FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY
            CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 100 END NULLS LAST, p_partkey) AS n
            FROM part WHERE p_size % 3 = 0) WHERE n = 1""",
        "promote_model": """SELECT p_partkey AS model_id, p_brand AS model_type,
            CASE WHEN p_size = 17 THEN 'active' WHEN p_size % 3 = 0 THEN
                CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 17) THEN 'archived' ELSE 'active' END
              WHEN p_size % 3 = 1 THEN 'testing' ELSE 'archived' END AS status,
            CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / 100, 6) END AS avg_score_mae,
            CAST(p_size AS BIGINT) AS run_size FROM part""",
        "game_view": f"""SELECT g.game_id, coalesce(p.page, 0) AS page, {_START}, home_team, away_team, status, season,
            coalesce(p.plays, '') AS plays,
            CAST(l.play_id AS BIGINT) AS state_play_id, CAST(l.home_score AS BIGINT) AS home_score,
            CAST(l.away_score AS BIGINT) AS away_score, round(pred_home_score, 6) AS pred_home_score,
            round(pred_away_score, 6) AS pred_away_score
          FROM games g LEFT JOIN (SELECT game_id, (n - 1) // 1000 AS page,
              string_agg(play_id || '|' || period || '|' || clock, ';' ORDER BY play_id) AS plays
            FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY play_id) AS n FROM plays)
            GROUP BY game_id, page) p USING (game_id)
          LEFT JOIN latest l USING (game_id) LEFT JOIN predictions r ON r.game_id = g.game_id AND r.predictor = 'Baseline'""",
        "condensed_plays": f"""SELECT game_id, (n - 1) // 1000 AS page, string_agg(concat_ws('|',
              {face} || CASE WHEN period > 4 THEN ' OT' || (period - 4) ELSE ' Q' || period END,
              coalesce(CAST(told_home AS VARCHAR), ''), description), ';' ORDER BY play_id DESC) AS plays
          FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY play_id DESC) AS n FROM plays)
          GROUP BY game_id, page""",
        "src_plays": """SELECT game_id, CASE WHEN game_id % 2 = 0 THEN play_id END AS order_number,
            CASE WHEN game_id % 2 = 1 THEN play_id END AS action_id, CAST(period AS BIGINT) AS period, clock,
            CAST(h AS VARCHAR) AS score_home, CAST(a AS VARCHAR) AS score_away,
            CASE WHEN qty % 23 <> 0 THEN 'Shot by ' || part END AS description,
            CAST(NULL AS VARCHAR) AS team_tricode, part AS person_id, CAST(NULL AS VARCHAR) AS player_name,
            qty % 40 AS points_total, CAST(NULL AS VARCHAR) AS sub_type FROM line_plays""",
        "src_fallback": """SELECT o_orderkey AS game_id, 1::BIGINT AS order_number,
          CASE o_orderstatus WHEN 'F' THEN 'first ' ELSE 'second ' END || o_custkey AS description
          FROM orders WHERE o_orderstatus IN ('F', 'P')""",
        "src_schedule": """SELECT id_text AS game_id, strftime(day, '%Y-%m-%d') || 'T00:00:00Z' AS start_text,
            'NATION_' || (game_id % 25) AS home_team,
            'NATION_' || ((game_id % 25 + 1 + (game_id // 25) % 24) % 25) AS away_team,
            CASE code WHEN 1 THEN 'Not Started' WHEN 2 THEN 'In Progress' WHEN 3 THEN 'Completed'
              ELSE 'Unknown' END AS status, year(day) || '-' || (year(day) + 1) AS season,
            CASE substr(id_text, 1, 3) WHEN '001' THEN 'Pre Season' WHEN '002' THEN 'Regular Season'
              WHEN '003' THEN 'All-Star' WHEN '004' THEN 'Post Season' WHEN '005' THEN 'Post Season'
              ELSE 'Unknown' END AS season_type FROM texts""",
        "src_rowset": """SELECT c_custkey AS person_id, 'First' || c_custkey AS first_name,
            'Last' || c_custkey AS last_name, 'First' || c_custkey || ' Last' || c_custkey AS full_name,
            CAST(1990 + c_custkey % 10 AS VARCHAR) AS from_year, CAST(2000 + c_custkey % 20 AS VARCHAR) AS to_year,
            c_custkey % 2 AS roster_status, c_mktsegment AS team_name FROM customer""",
        "points_allowed": """SELECT a.game_id, a.team_id, a.pts, CASE WHEN (SELECT count(*) FROM team_box c
            WHERE c.game_id = a.game_id) = 2 THEN b.pts END AS pts_allowed
          FROM team_box a LEFT JOIN team_box b ON a.game_id = b.game_id AND a.team_id <> b.team_id""",
        "resolve_team": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'nation_' || c_nationkey
              WHEN 1 THEN 'Nation-Number-' || c_nationkey WHEN 2 THEN 'NUMBER ' || c_nationkey
              WHEN 3 THEN 'old-Team ' || c_nationkey ELSE 'nobody ' || c_nationkey END AS identifier,
            CASE WHEN c_custkey % 5 < 4 THEN CAST(c_nationkey AS VARCHAR) END AS team_id,
            CASE WHEN c_custkey % 5 < 4 THEN 'NATION_' || c_nationkey END AS team,
            CASE WHEN c_custkey % 5 < 4 THEN 'Nation Number ' || c_nationkey END AS full_name,
            CASE WHEN c_custkey % 5 < 4 THEN 'Number ' || c_nationkey END AS short_name FROM customer""",
        "sink_replace": f"""SELECT game_id, predictor,
            strftime(CASE WHEN pred_home_score > 100 THEN prediction_ts + INTERVAL 1 HOUR ELSE prediction_ts END,
              '%Y-%m-%d %H:%M:%S') AS prediction_ts,
            round(CASE WHEN pred_home_score > 100 THEN pred_home_score + 1 ELSE pred_home_score END, 6) AS pred_home_score,
            round(pred_away_score, 6) AS pred_away_score, round(pred_home_win_pct, 6) AS pred_home_win_pct
          FROM predictions""",
        "sink_replace_group": """SELECT s.game_id, CAST(s.play_id AS BIGINT) AS play_id,
            CAST(s.home_score + CASE WHEN t.game_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS home_score,
            CAST(s.away_score AS BIGINT) AS away_score
          FROM states s LEFT JOIN (SELECT DISTINCT g.game_id FROM games g JOIN states f ON g.game_id = f.game_id
            WHERE g.status = 'In Progress' AND f.play_id <= 4) t ON s.game_id = t.game_id
          WHERE t.game_id IS NULL OR s.play_id <= 4""",
        "quarantine_games": """SELECT game_id, count(*) AS plays, count(*) FILTER ((game_id * 7 + play_id) % 50 = 0) AS unreadable
          FROM plays GROUP BY game_id HAVING count(*) FILTER ((game_id * 7 + play_id) % 50 = 0) > 0""",
        "guarded_write": """SELECT side, rows, games, rows AS observed, 'broken rows' AS verdict FROM (
          SELECT CASE WHEN EXISTS (SELECT 1 FROM plays q WHERE q.game_id = p.game_id AND (q.game_id * 7 + q.play_id) % 50 = 0)
              THEN 'rejected' ELSE 'kept' END AS side, count(*) AS rows, count(DISTINCT game_id) AS games
          FROM plays p GROUP BY 1)""",
        "sync_guard": """SELECT 'all' AS delivery, count(*) AS rows, 0::BIGINT AS broken, 'mixed seasons' AS verdict FROM games
          UNION ALL SELECT 'one', count(*), 0, 'accept' FROM games WHERE season = '1997-1998'
          UNION ALL SELECT 'none', 0, 0, 'empty'""",
        "sink_quarantine": """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS moment, game_id,
          'no opponent for ' || home_team AS error FROM games WHERE away_team = 'TBD'""",
        "changed_rows": """WITH n AS (SELECT p_partkey AS person_id, CAST(1990 + p_size % 10 AS VARCHAR) AS from_year,
            CASE WHEN p_size % 6 <> 0 THEN CAST(2000 + p_size AS VARCHAR) END AS to_year,
            CAST(CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE p_size % 2 END AS BIGINT) AS roster_status, p_brand AS team,
            p_size, p_type FROM part)
          SELECT person_id, from_year, to_year, roster_status, team FROM n WHERE p_size >= 40
            OR to_year IS DISTINCT FROM CASE WHEN p_size % 4 <> 0 THEN CAST(2000 + p_size AS VARCHAR) END
            OR roster_status <> p_size % 2""",
        "json_fields": """SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, props ->> '$.absent' AS absent,
          (props ->> '$.k') IN ('9', '99') AS is_nines FROM events""",
        "json_widen": """SELECT event_id, event_type, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(NULL AS BIGINT) AS j
          FROM events""",
        "fn_clock": r"""SELECT game_id, play_id, round(try_cast(nullif(regexp_extract(clock,
            '^PT(\d+)M(\d+(?:\.\d*)?)S$', 1), '') AS DOUBLE) * 60 + try_cast(nullif(regexp_extract(clock,
            '^PT(\d+)M(\d+(?:\.\d*)?)S$', 2), '') AS DOUBLE), 6) AS seconds FROM clock_texts""",
        "fn_clock_label": f"""SELECT game_id, play_id, CASE WHEN clock LIKE 'PT%' THEN {face} ||
          CASE WHEN period > 4 THEN ' OT' || (period - 4) ELSE ' Q' || period END END AS label FROM clock_texts""",
        "fn_points_text": """SELECT game_id, CAST(play_id AS BIGINT) AS action_id, CAST(told_points AS BIGINT) AS points
          FROM plays_alt""",
        "fn_minutes": """SELECT game_id, play_id, CASE qty % 7
            WHEN 0 THEN round(part % 48 + (supp % 60) / 60.0, 6) WHEN 1 THEN part % 48 WHEN 5 THEN 12.5 END::DOUBLE
            AS minutes FROM lines""",
        "fn_height": """SELECT game_id, play_id, CASE WHEN qty % 4 = 0
          THEN CAST((5 + part % 3) * 12 + supp % 12 AS DOUBLE) END AS inches FROM lines""",
        "fn_age": """SELECT game_id, CASE WHEN cents % 7 <> 0 THEN date_diff('year', b, DATE '2025-03-01')
            - CASE WHEN month(b) > 3 OR (month(b) = 3 AND day(b) > 1) THEN 1 ELSE 0 END END AS age
          FROM (SELECT game_id, cents, CAST(date_text AS DATE) AS b FROM texts)""",
        "fn_name": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'First' || c_custkey
              WHEN 1 THEN 'First' || c_custkey || ' Middle' WHEN 2 THEN '' WHEN 3 THEN 'First' || c_custkey END
              AS first_name,
            CASE c_custkey % 5 WHEN 0 THEN 'Last' || c_custkey WHEN 1 THEN 'Last' || c_custkey WHEN 2 THEN 'Single' || c_custkey
              WHEN 3 THEN 'Last' || c_custkey END AS last_name FROM customer""",
        "fn_season_type": """SELECT game_id, CASE game_id % 7 WHEN 1 THEN 'Pre Season' WHEN 2 THEN 'Regular Season'
          WHEN 3 THEN 'All-Star' WHEN 4 THEN 'Post Season' WHEN 5 THEN 'Post Season' ELSE 'Unknown' END
          AS season_type FROM texts""",
        "fn_status": """SELECT game_id, CASE code WHEN 1 THEN 'Not Started' WHEN 2 THEN 'In Progress'
          WHEN 3 THEN 'Completed' ELSE 'Unknown' END AS status FROM texts""",
        "fn_id_season": """SELECT game_id, y || '-' || (y + 1) AS season,
            y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS short_season
          FROM (SELECT game_id, CASE WHEN (game_id // 7) % 100 < 40 THEN 2000 ELSE 1900 END
            + (game_id // 7) % 100 AS y FROM texts)""",
        "fn_date_season": """SELECT game_id, strftime(day, '%Y-%m-%d') AS day,
            CASE WHEN day BETWEEN DATE '2011-07-01' AND DATE '2012-06-30' THEN '2011-2012'
              WHEN day BETWEEN DATE '2019-07-01' AND DATE '2020-10-11' THEN '2019-2020'
              WHEN day BETWEEN DATE '2020-10-12' AND DATE '2021-07-20' THEN '2020-2021'
              WHEN month(day) > 6 THEN year(day) || '-' || (year(day) + 1)
              ELSE (year(day) - 1) || '-' || year(day) END AS season FROM texts""",
        "fn_season_short": """SELECT game_id, left(season, 5) || right(season, 2) AS short_season FROM games""",
        "fn_winprob": f"""SELECT game_id, predictor, round({chance.format(1)}, 6) AS pregame,
            round({chance.format('(1 + 48.0::DOUBLE / (game_id % 49 + 1))')}, 6) AS linear,
            round({chance.format('(1 + ln(48.0::DOUBLE / (game_id % 49 + 1)))')}, 6) AS logarithmic
          FROM predictions""",
        "fn_blend": f"""SELECT game_id, predictor, round(({stretched} + pred_home_score) / 2, 6) AS simple,
            round((1 - r) * {stretched} + r * pred_home_score, 6) AS weighted,
            round({logistic} * {stretched} + (1 - {logistic}) * pred_home_score, 6) AS logistic
          FROM (SELECT *, (game_id % 101)::DOUBLE / 100 AS r FROM predictions)""",
        "fn_when_label": f"""SELECT g.game_id, {when_label} AS label FROM games g LEFT JOIN latest l USING (game_id)""",
        "fn_pick": f"""SELECT game_id, predictor, CASE WHEN p >= 0.5 THEN 'home' ELSE 'away' END AS winner,
          {percent} AS percent FROM (SELECT game_id, predictor, pred_home_win_pct AS p FROM predictions)""",
        "validate_ids": f"""SELECT game_id, any_id, {_fault("WHEN any_id IS NULL OR length(any_id) <> 10 OR "
            "NOT starts_with(any_id, '00') THEN 'bad id'")} FROM any_texts""",
        "validate_dates": f"""SELECT game_id, any_date, {_fault(f"WHEN NOT {shaped} THEN 'bad format' "
            f"WHEN {month} < 1 OR {month} > 12 THEN 'bad month' WHEN {month} IN (4, 6, 9, 11) AND {day} > 30 "
            f"OR {month} = 2 AND {day} > 29 OR {day} < 1 OR {day} > 31 THEN 'bad day'")} FROM any_texts""",
        "validate_seasons": f"""SELECT game_id, any_season, {season_fault(r'^\d{4}-\d{4}$', tail, 'fault')},
          {season_fault(r'^\d{4}-\d{2}$', f"(try_cast(substr(any_season, 1, 4) AS INTEGER) // 100 * 100 + {tail})",
                        'short_fault')} FROM any_texts""",
        "stream_dedup": "SELECT DISTINCT game_id, play_id FROM raw_lines",
        "stream_repaired": "SELECT DISTINCT game_id, play_id FROM raw_lines",
        "stream_late": """SELECT game_id, play_id, strftime(m, '%Y-%m-%d %H:%M:%S') AS moment, k AS batch
          FROM (SELECT l_orderkey AS game_id, CAST(l_linenumber AS BIGINT) AS play_id, l_shipdate AS m,
              (l_orderkey + l_linenumber) % 3 AS k FROM lineitem) d
          JOIN (SELECT k AS after, max(hi) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS hi
            FROM (SELECT (l_orderkey + l_linenumber) % 3 AS k, max(l_shipdate) AS hi FROM lineitem GROUP BY k)) w
            ON d.k = w.after
          WHERE m <= hi - INTERVAL 300 DAY""",
        "stream_finalize": """SELECT g.game_id, game_data_finalized OR coalesce(e.ended, false) AS game_data_finalized,
            CASE WHEN e.ended THEN 'final play'
              WHEN e.game_id IS NOT NULL AND g.start + INTERVAL 60 DAY < (SELECT max(start) FROM games JOIN states USING (game_id))
                - INTERVAL 30 DAY THEN 'timer' END AS reason
          FROM games g LEFT JOIN (SELECT game_id, bool_or(is_final_state) AS ended FROM states GROUP BY game_id) e
            ON g.game_id = e.game_id""",
    }
    out = {k: _sql(v) for k, v in plain.items() if not v.startswith("WITH")}
    out |= {k: v for k, v in plain.items() if v.startswith("WITH")}
    out["play_quality"] = _sql(
        plain["play_quality"],
        """opening AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY play_id) AS n FROM states),
decreases AS (SELECT a.game_id, a.play_id FROM opening a LEFT JOIN opening b
  ON a.game_id = b.game_id AND b.n = a.n - 1 WHERE a.n <= 20
  AND (a.home_score < coalesce(b.home_score, 0) OR a.away_score < coalesce(b.away_score, 0))),
""",
    )
    out |= _feature_queries() | _audit_queries()
    out["pred_baseline"] = _sql(
        f"""SELECT game_id, round(pred_home_score, 6) AS pred_home_score, round(pred_away_score, 6) AS pred_away_score,
          round({chance.format(1)}, 6) AS pred_home_win_pct FROM (
          SELECT game_id, ("Home_PPG" + "Away_OPP_PPG") / 2 AS pred_home_score,
            ("Away_PPG" + "Home_OPP_PPG") / 2 AS pred_away_score FROM features)""",
        FEATURES,
    )
    out["store_features"] = out["features_json"] = out["features"]
    # The same definitions over finals that come from plays.
    told = BASE[BASE.index("sides AS (") :].replace("sides", "told_sides").replace("priors AS", "told_priors AS")
    out["pipeline_pregame"] = _sql(
        f"""SELECT g.game_id, g.game_data_finalized OR f.game_id IS NOT NULL AS game_data_finalized,
          (SELECT NOT bool_or(needed > 0 AND loaded = 0) FROM told_priors p WHERE p.game_id = g.game_id) AS pre_game_data_finalized,
          round(pred_home_score, 6) AS pred_home_score, round(pred_away_score, 6) AS pred_away_score,
          round({chance.format(1)}, 6) AS pred_home_win_pct
          FROM games g LEFT JOIN told_finals f ON f.game_id = g.game_id LEFT JOIN (
            SELECT game_id, ("Home_PPG" + "Away_OPP_PPG") / 2 AS pred_home_score,
              ("Away_PPG" + "Home_OPP_PPG") / 2 AS pred_away_score FROM features) b ON b.game_id = g.game_id""",
        _states("plays", _RUN_OF_FIRST),
        """told_finals AS (
  SELECT game_id, arg_max(home_score, play_id) AS home_score, arg_max(away_score, play_id) AS away_score
  FROM derived WHERE is_final_state GROUP BY game_id),
""",
        told.replace("finals f", "told_finals f"),
        FEATURES.replace("sides t", "told_sides t").replace("sides p", "told_sides p"),
    )
    out["game_states"] = _sql(_STATE_COLUMNS, _states("plays", _RUN_OF_FIRST))
    out["game_states_alt"] = _sql(_STATE_COLUMNS, _states("plays_alt", "false"))
    out["stream_publish"] = _sql(
        _STATE_COLUMNS, _states("plays", _RUN_OF_FIRST, "description <> 'Game End'")
    )
    out["player_timeline"] = _sql("SELECT * EXCLUDE (pos) FROM timeline", EVENTS)
    out["players_snapshot"] = _sql("SELECT * FROM snapshot", EVENTS)
    out["player_points"] = _sql("SELECT * FROM board_points", EVENTS)
    out["player_maps"] = _sql(
        """SELECT game_id, side, 0::BIGINT AS page,
             string_agg(concat_ws('|', person_id, name, points), ';' ORDER BY CAST(person_id AS VARCHAR)) AS players
           FROM snapshot GROUP BY game_id, side""",
        EVENTS,
    )
    out["player_board"] = _sql(
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, side
           ORDER BY pred_points DESC, person_id) AS place FROM board_points) WHERE place <= 5""",
        EVENTS,
    )
    out["coverage"] = _sql(
        "SELECT season, dataset, covered, total, round(percent, 6) AS percent, mark FROM coverage", _COVERAGE
    )
    out["coverage_alerts"] = _sql(
        """SELECT season, dataset || '_missing' AS category, total - covered AS missing FROM coverage
           WHERE (dataset = 'plays' AND covered < total) OR (dataset = 'player_box' AND covered < total * 0.95)""",
        _COVERAGE,
    )
    out["report_json"] = _sql(
        """SELECT '{"season":"' || season || '","dataset":"' || dataset || '","covered":' || covered || ',"total":'
           || total || ',"mark":"' || mark || '"}' AS report FROM coverage""",
        _COVERAGE,
    )
    out["eval_metrics"] = _sql(f"SELECT {_METRIC_LIST} FROM scored", _METRICS)
    out["leaderboard"] = _sql(
        f"""SELECT row_number() OVER (ORDER BY avg_score_mae, model) AS rank, model, avg_score_mae, margin_mae,
          win_accuracy, brier_score, home_mae, away_mae, total_mae, n_samples
          FROM (SELECT predictor AS model, {_METRIC_LIST} FROM scored GROUP BY predictor)""",
        _METRICS,
    )
    out["predictor_eval"] = _sql(
        """SELECT predictor, round(avg(-(t * ln(pct) + (1 - t) * ln(1 - pct))), 6) AS log_loss,
             round(avg(abs(ph - h)), 6) AS mae_home_score, round(avg(abs(pa - a)), 6) AS mae_away_score,
             round(avg(abs((ph - pa) - (h - a))), 6) AS mae_home_margin, count(*) AS n
           FROM (SELECT *, CASE WHEN h > a THEN 1.0 WHEN h < a THEN 0.0 ELSE 0.5 END AS t FROM scored)
           GROUP BY predictor""",
        _METRICS,
    )
    rounded = (
        "round(pred_home_score, 6) AS pred_home_score, round(pred_away_score, 6) AS pred_away_score, "
        "round(pred_home_win_pct, 6) AS pred_home_win_pct"
    )
    out["live_inputs"] = _sql(
        f"""SELECT game_id, {rounded}, {_TS.format('prediction_ts', 'prediction_ts')}, clock,
          CAST(period AS BIGINT) AS period, CAST(home_score AS BIGINT) AS home_score,
          CAST(away_score AS BIGINT) AS away_score, is_final_state FROM live_in""",
        STORED_LIVE,
    )
    out["live_predictions"] = _sql(f"SELECT game_id, {rounded} FROM current", STORED_LIVE, LIVE)
    out["fn_progress"] = _sql(
        """SELECT game_id, play_id, CAST(period AS BIGINT) AS period, round(elapsed / expected, 6) AS done,
           round(expected - elapsed, 6) AS minutes FROM progress""",
        "live_in AS (SELECT * FROM clock_texts),\n",
        LIVE[: LIVE.index("blended AS")],
    )
    out["game_display"] = _sql(
        f"""SELECT g.game_id, strftime(start, '%Y-%m-%d') AS game_date, strftime(start, '%H:%M:%S') AS game_time,
          home_team AS home, away_team AS away, status AS game_status, CAST(home_score AS BIGINT) AS home_score,
          CAST(away_score AS BIGINT) AS away_score, {when_label} AS datetime_display,
          CAST(round_even(c.pred_home_score, 0) AS BIGINT) AS pred_home_score,
          CAST(round_even(c.pred_away_score, 0) AS BIGINT) AS pred_away_score,
          CASE WHEN p >= 0.5 THEN home_team WHEN p < 0.5 THEN away_team END AS pred_winner,
          CASE WHEN p IS NOT NULL THEN {percent} END AS pred_win_pct
        FROM games g LEFT JOIN latest l USING (game_id)
        LEFT JOIN (SELECT *, pred_home_win_pct AS p FROM current) c ON c.game_id = g.game_id""",
        STORED_LIVE,
        LIVE,
    )
    shown = out["game_display"].rsplit("\nSELECT g.game_id", 1)
    place = "row_number() OVER (PARTITION BY game_id, side ORDER BY pred_points DESC, person_id) AS place"
    players = ", ".join(
        f"""coalesce((SELECT string_agg(concat_ws('|', person_id, name, points, pred_points), ';' ORDER BY place)
            FROM best b WHERE b.game_id = d.game_id AND b.side = '{side}'), '') AS {side}_players"""
        for side in ("home", "away")
    )
    out["game_pages"] = (
        f"{shown[0]},\n{EVENTS.strip().rstrip(',')},\n"
        f"best AS (SELECT * FROM (SELECT *, {place} FROM board_points) WHERE place <= 5),\n"
        f"display AS (SELECT g.game_id{shown[1]}),\n"
        f"pages AS ({plain['condensed_plays']})\n"
        f"""SELECT d.game_id, coalesce(c.page, 0) AS page, home, away, datetime_display, home_score, away_score,
          pred_winner, pred_win_pct, {players}, coalesce(c.plays, '') AS plays
        FROM display d LEFT JOIN pages c ON c.game_id = d.game_id"""
    )
    out["sync_schedule"] = _sql(
        f"""SELECT n.game_id, {_TS.format('n.start', 'start')}, n.home_team, n.away_team, n.status, n.season,
            n.season_type, coalesce(g.pre_game_data_finalized, false) AS pre_game_data_finalized,
            coalesce(g.game_data_finalized, false) AS game_data_finalized
          FROM delivered n LEFT JOIN games g USING (game_id) WHERE n.away_team IS NOT NULL
          UNION ALL
          SELECT game_id, {_TS.format('g.start', 'start')}, g.home_team, g.away_team, g.status, g.season,
            g.season_type, pre_game_data_finalized, game_data_finalized
          FROM games g WHERE game_id IN (SELECT game_id FROM delivered WHERE away_team IS NULL)""",
        sync_new,
    )
    out["sync_counts"] = _sql(
        """SELECT (SELECT count(*) FROM delivered WHERE game_id NOT IN (SELECT game_id FROM games)) AS added,
          (SELECT count(*) FROM delivered n JOIN games g USING (game_id) WHERE n.away_team IS DISTINCT FROM g.away_team
             OR n.status <> g.status) AS updated,
          (SELECT count(*) FROM games WHERE game_id NOT IN (SELECT game_id FROM delivered)) AS removed""",
        sync_new,
    )
    out["src_box_stats"] = _box_players(
        "trim('First' || cents % 50 || ' ' || CASE WHEN cents % 3 <> 0 THEN 'Family' || cents % 70 ELSE '' END)",
        "CASE WHEN cents % 4 <> 0 THEN 'G' END",
    )
    out["src_box_live"] = _box_players(
        "CASE WHEN cents % 5 <> 0 THEN 'F. Family' || cents % 70 ELSE '' END",
        "CASE WHEN cents % 4 <> 0 THEN 'G' ELSE '' END",
    )
    out["src_box_stats_teams"] = _box_teams("80 + (cents + shift) % 60")
    out["src_box_live_teams"] = _box_teams(
        "CASE WHEN shift = 0 AND st = 'P' THEN 0 ELSE 80 + (cents + shift) % 60 END"
    )
    stream = r"""
stream_plays AS (
  SELECT *, CASE WHEN running OR qty % 3 = 0 THEN h END AS told_home,
         CASE WHEN running OR qty % 3 = 1 THEN a END AS told_away FROM raw_plays WHERE qty % 23 <> 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY period DESC, clock_left DESC, play_id DESC, clock DESC) AS n
  FROM stream_plays),
stream_now AS (
  SELECT r.game_id, g.home_team AS home, g.away_team AS away, r.play_id, r.period, r.clock,
    coalesce((SELECT arg_max(told_home, (period, clock_left, play_id, told_home)) FROM stream_plays q
       WHERE q.game_id = r.game_id AND told_home IS NOT NULL), 0) AS home_score,
    coalesce((SELECT arg_max(told_away, (period, clock_left, play_id, told_away)) FROM stream_plays q
       WHERE q.game_id = r.game_id AND told_away IS NOT NULL), 0) AS away_score, false AS is_final_state
  FROM ranked r JOIN games g USING (game_id) WHERE n = 1),
"""
    out["stream_states"] = _sql(
        """SELECT game_id, home, away, play_id, CAST(period AS BIGINT) AS period, clock,
           CAST(home_score AS BIGINT) AS home_score, CAST(away_score AS BIGINT) AS away_score, is_final_state
           FROM stream_now""",
        stream,
    )
    out["stream_players"] = _sql(
        """SELECT game_id, side, person_id, arg_min(player_name, place) AS name,
             CAST(coalesce(arg_max(points, (place, points)) FILTER (points IS NOT NULL), 0) AS BIGINT) AS points
           FROM told GROUP BY game_id, side, person_id""",
        """told AS (
  SELECT p.game_id, CASE WHEN team = g.home_team THEN 'home' ELSE 'away' END AS side, person_id,
         'Player ' || part AS player_name, (period, clock_left, play_id, 'Player ' || part) AS place, points
  FROM (SELECT *, CASE WHEN part % 40 = 0 THEN 0 ELSE part END AS person_id,
          CASE WHEN part % 50 = 0 THEN 'XXX' WHEN play_id % 2 = 1 THEN 'NATION_' || (game_id % 25)
            ELSE 'NATION_' || ((game_id % 25 + 1 + (game_id // 25) % 24) % 25) END AS team,
          CASE WHEN running THEN CASE WHEN supp % 7 <> 0 THEN qty % 40 END
            WHEN supp % 4 <> 0 THEN qty % 40 END AS points
        FROM raw_plays WHERE qty % 23 <> 0 AND part % 41 <> 0) p JOIN games g USING (game_id)
  WHERE running OR person_id <> 0),
""",
    )
    out["stream_predict"] = _sql(
        f"SELECT game_id, {rounded} FROM current",
        stream,
        """live_in AS (SELECT s.game_id, p.pred_home_score, p.pred_away_score, p.pred_home_win_pct, s.clock, s.period,
             s.home_score, s.away_score, s.is_final_state
           FROM stream_now s JOIN predictions p ON p.game_id = s.game_id AND p.predictor = 'Baseline'),
""",
        LIVE,
    )
    return out
