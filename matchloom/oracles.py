"""SQL for the queries, on the given tables: the mapping of ``sources.mapping`` as common table expressions, then one select per query."""

from __future__ import annotations

from matchloom.functions.names import folded
from matchloom.functions.weapons import CLASSES, GUNS

_GUNS = ", ".join(f"'{g}'" for g in GUNS)
_CLASS_OF = " ".join(f"WHEN weapon IN ({', '.join(chr(39) + g + chr(39) for g in guns)}) THEN '{c}'" for c, guns in CLASSES.items())
_OUT = "event_type IN ('kill', 'eliminated_knocked') AND flag IS DISTINCT FROM 'NO_DROP'"

BASE = f"""WITH
b0 AS (SELECT event_id, user_id, event_type AS src, value, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, user_id % 15 AS slot, user_id // 15 AS room,
              epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events),
b1 AS (SELECT *, us // 86400000000 AS day, us % 86400000000 AS uod,
              CASE WHEN event_id % 20 = 0 THEN (slot + 1) % 15 WHEN slot < 8 THEN 8 + k % 7 ELSE k % 8 END AS vslot,
              src = 'error' AND event_id % 4 = 0 AS unseen, src = 'error' AND event_id % 4 = 2 AS zone FROM b0),
b2 AS (SELECT *, (day % 5) * 216000 + uod // 400000 AS feed,
              CASE WHEN src IN ('click', 'purchase') THEN 'knock' WHEN src = 'view' THEN 'kill' WHEN src = 'signup' THEN 'eliminated_knocked'
                   WHEN event_id % 4 < 2 THEN 'kill' WHEN event_id % 4 = 2 THEN 'knock' ELSE 'other' END AS kind FROM b1),
ev AS (SELECT event_id, (day // 5) * 1000 + room AS match_id,
              CASE WHEN event_id % 97 <> 0 THEN (day % 5) * 3 + 1 + uod // 28800000000 END AS round_no,
              CASE WHEN kind IN ('kill', 'eliminated_knocked') AND NOT unseen THEN greatest(feed - (k % 35) * 100, 0) ELSE feed END AS true_ms,
              feed AS feed_ms, kind AS event_type,
              CASE WHEN NOT unseen AND NOT zone THEN user_id END AS killer_id, CASE WHEN NOT unseen THEN room * 15 + vslot END AS victim_id,
              CASE WHEN zone THEN 'Zone' ELSE ([{_GUNS}])[CAST(floor(value) AS BIGINT) % 30 + 1] END AS weapon,
              CASE WHEN NOT (unseen AND event_id % 3 = 0) THEN CASE WHEN vslot < 8 THEN 'blue' ELSE 'red' END END AS victim_team,
              CASE WHEN NOT unseen THEN round((50 + k % 50) / 100.0, 2) END AS confidence,
              CASE WHEN src = 'error' AND event_id % 4 = 0 THEN 'NO_FEED_ROW' WHEN src = 'error' AND event_id % 4 = 1 THEN 'NO_DROP' END AS flag,
              CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS reviewed FROM b2),
mp AS (SELECT match_id, player_id, CASE WHEN player_id % 15 < 8 THEN 'blue' ELSE 'red' END AS team, player_id % 15 AS slot
       FROM (SELECT match_id, killer_id AS player_id FROM ev UNION SELECT match_id, victim_id FROM ev) WHERE player_id IS NOT NULL),
pl AS (SELECT DISTINCT player_id, 'player_' || player_id AS ign, CASE WHEN player_id % 4 = 0 THEN 'nick_' || (player_id % 100) END AS nickname FROM mp),
al AS (SELECT 'playor_' || player_id AS alias, player_id FROM pl WHERE player_id % 3 = 0),
ma AS (SELECT match_id, strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST((match_id // 1000) * 7200 + match_id % 1000 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS recorded_at,
              'room_' || (match_id % 1000) || '_' || (match_id // 1000) || '.mkv' AS source_file, 3 AS team_size, count(DISTINCT round_no) AS rounds_played,
              CASE WHEN match_id % 11 = 0 THEN '0.1.4' ELSE '1.2.0' END AS pipeline_version, CASE WHEN match_id % 9 = 0 THEN 'live' ELSE 'processed' END AS status
       FROM ev GROUP BY match_id),
ro AS (SELECT match_id, round_no, min(feed_ms) AS start_ms, max(feed_ms) AS end_ms, count(*) FILTER ({_OUT} AND victim_team = 'red') AS blue_score,
              count(*) FILTER ({_OUT} AND victim_team = 'blue') AS red_score FROM ev WHERE round_no IS NOT NULL GROUP BY match_id, round_no),
b3 AS (SELECT match_id, CASE WHEN match_id % 7 = 0 THEN coalesce(round_no, 1) END AS rn, killer_id AS player_id,
              count(*) FILTER ({_OUT}) AS e, count(*) FILTER (event_type = 'knock') AS n FROM ev WHERE killer_id IS NOT NULL GROUP BY ALL),
b4 AS (SELECT *, (match_id + player_id) % 13 = 0 AS unread FROM b3 WHERE (match_id + player_id) % 17 <> 0),
bo AS (SELECT match_id, rn AS round_no, player_id, 'eliminations' AS stat_name, CAST(CASE WHEN NOT unread THEN e + CASE WHEN (match_id + player_id) % 10 = 0 THEN 1 ELSE 0 END END AS DOUBLE) AS value FROM b4
       UNION ALL SELECT match_id, rn, player_id, 'knock_outs', CAST(CASE WHEN NOT unread THEN n END AS DOUBLE) FROM b4
       UNION ALL SELECT match_id, rn, player_id, 'damage_dealt', CAST(e * 100 + n * 37 AS DOUBLE) FROM b4),
-- what followed each knock: every later sighting of the victim in the round, by one join
sight AS (SELECT match_id, coalesce(round_no, -1) AS rnd, victim_id AS who, feed_ms, {_OUT} AS dies, event_type = 'knock' AS lives FROM ev WHERE victim_id IS NOT NULL
          UNION ALL SELECT match_id, coalesce(round_no, -1), killer_id, feed_ms, false, event_type IN ('knock', 'kill') FROM ev WHERE killer_id IS NOT NULL),
ko0 AS (SELECT k.event_id AS knock_id, any_value(k.match_id) AS match_id, any_value(k.round_no) AS round_no, any_value(k.victim_id) AS victim_id, any_value(k.killer_id) AS knocker_id,
               any_value(k.feed_ms) AS feed_ms, min(s.feed_ms) FILTER (s.dies) AS d, min(s.feed_ms) FILTER (s.lives) AS l
        FROM ev k LEFT JOIN sight s ON s.match_id = k.match_id AND s.rnd = coalesce(k.round_no, -1) AND s.who = k.victim_id AND s.feed_ms > k.feed_ms
        WHERE k.event_type = 'knock' GROUP BY k.event_id),
ko AS (SELECT knock_id, match_id, round_no, victim_id, knocker_id, feed_ms, CASE WHEN l < d OR (l IS NOT NULL AND d IS NULL) THEN 'revived' WHEN d IS NOT NULL THEN 'eliminated' ELSE 'unresolved' END AS outcome,
              CASE WHEN l < d OR (l IS NOT NULL AND d IS NULL) THEN l END AS revived_before_ms FROM ko0),
cr0 AS (SELECT e.event_id, max(struct_pack(f := o.feed_ms, i := o.knock_id)) AS o FROM ev e JOIN ko o ON o.match_id = e.match_id AND coalesce(o.round_no, -1) = coalesce(e.round_no, -1)
        AND o.victim_id = e.victim_id AND o.feed_ms < e.feed_ms AND o.outcome = 'eliminated' WHERE {_OUT} GROUP BY e.event_id),
cr AS (SELECT e.event_id, e.match_id, e.round_no, e.victim_id, e.killer_id AS finisher_id, coalesce(o.knocker_id, e.killer_id) AS credited_id
       FROM ev e LEFT JOIN cr0 USING (event_id) LEFT JOIN ko o ON o.knock_id = cr0.o.i WHERE {_OUT}),
pm0 AS (SELECT match_id, player_id, count(*) FILTER (m = 'e') AS eliminations, count(*) FILTER (m = 'f') AS finishes, count(*) FILTER (m = 'k') AS knocks, count(*) FILTER (m = 'd') AS deaths,
               count(*) FILTER (m = 't') AS times_knocked, count(*) FILTER (m = 'r') AS revives_inferred
        FROM (SELECT match_id, credited_id AS player_id, 'e' AS m FROM cr UNION ALL SELECT match_id, finisher_id, 'f' FROM cr UNION ALL SELECT match_id, killer_id, 'k' FROM ev WHERE event_type = 'knock'
              UNION ALL SELECT match_id, victim_id, 'd' FROM ev WHERE {_OUT} UNION ALL SELECT match_id, victim_id, 't' FROM ev WHERE event_type = 'knock'
              UNION ALL SELECT match_id, victim_id, 'r' FROM ko WHERE outcome = 'revived') GROUP BY match_id, player_id),
bv AS (SELECT match_id, player_id, coalesce(max(value) FILTER (stat_name = 'damage_dealt' AND round_no IS NULL), sum(value) FILTER (stat_name = 'damage_dealt' AND round_no IS NOT NULL)) AS damage_dealt,
              coalesce(max(value) FILTER (stat_name = 'eliminations' AND round_no IS NULL), sum(value) FILTER (stat_name = 'eliminations' AND round_no IS NOT NULL)) AS scoreboard_eliminations,
              max(value) FILTER (stat_name = 'knock_outs' AND round_no IS NULL) AS scoreboard_knock_outs FROM bo GROUP BY match_id, player_id),
pm AS (SELECT mp.match_id, ma.recorded_at, mp.player_id, pl.ign, pl.nickname, mp.team, coalesce(eliminations, 0) AS eliminations, coalesce(finishes, 0) AS finishes, coalesce(knocks, 0) AS knocks,
              coalesce(deaths, 0) AS deaths, coalesce(times_knocked, 0) AS times_knocked, coalesce(revives_inferred, 0) AS revives_inferred, damage_dealt, scoreboard_eliminations, scoreboard_knock_outs,
              mp.match_id IN (SELECT match_id FROM bo WHERE round_no IS NULL) AS has_match_board
       FROM mp JOIN ma USING (match_id) JOIN pl USING (player_id) LEFT JOIN pm0 ON pm0.match_id = mp.match_id AND pm0.player_id = mp.player_id LEFT JOIN bv ON bv.match_id = mp.match_id AND bv.player_id = mp.player_id),
us AS (SELECT e.*, k.team AS killer_team, v.team AS victim_team_known FROM ev e JOIN mp k ON k.match_id = e.match_id AND k.player_id = e.killer_id JOIN mp v ON v.match_id = e.match_id AND v.player_id = e.victim_id
       WHERE event_type = 'knock' AND killer_id <> victim_id AND weapon IS DISTINCT FROM 'Zone' AND k.team <> v.team),
kx AS (SELECT match_id, killer_id, victim_id, any_value(k.ign) AS kn, any_value(v.ign) AS vn, count(*) AS n, min(struct_pack(t := true_ms, f := feed_ms, i := event_id)) AS first
       FROM us JOIN pl k ON k.player_id = killer_id JOIN pl v ON v.player_id = victim_id GROUP BY match_id, killer_id, victim_id),
pr AS (SELECT x.*, coalesce(y.n, 0) AS back, y.first AS answer FROM kx x LEFT JOIN kx y ON x.match_id = y.match_id AND x.killer_id = y.victim_id AND x.victim_id = y.killer_id),
rv AS (SELECT match_id, killer_id AS x, victim_id AS y, n AS a, back AS b, row_number() OVER (PARTITION BY match_id ORDER BY least(n, back) DESC, n + back DESC, kn, vn) AS place
       FROM pr WHERE back > 0 AND first < answer QUALIFY place <= 3),
rs AS (SELECT match_id, x AS player_id, y AS opponent_id, a AS knocked, b AS knocked_by FROM rv UNION ALL SELECT match_id, y, x, b, a FROM rv),
dm AS (SELECT match_id, killer_id AS player_id, victim_id AS opponent_id, n, back, CAST(round_even(100 * n / (SELECT sum(z.n) FROM kx z WHERE z.match_id = pr.match_id AND z.victim_id = pr.victim_id), 0) AS BIGINT) AS share
       FROM pr ANTI JOIN rs ON rs.match_id = pr.match_id AND rs.player_id = pr.killer_id AND rs.opponent_id = pr.victim_id WHERE n > back
       QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY n - back DESC, n DESC, kn, vn) <= 3),
tl AS (SELECT match_id, killer_id AS player_id, CASE weapon WHEN 'Grenade' THEN 'Grenadier' WHEN 'Molotov' THEN 'Molotov specialist' ELSE 'Driver' END AS role, n,
              count(*) OVER (PARTITION BY match_id, weapon) > 1 AS joint
       FROM (SELECT match_id, killer_id, weapon, count(*) AS n, max(count(*)) OVER (PARTITION BY match_id, weapon) AS top FROM us WHERE weapon IN ('Grenade', 'Molotov', 'Car') GROUP BY match_id, killer_id, weapon)
       WHERE n = top AND n >= CASE weapon WHEN 'Car' THEN 1 ELSE 2 END),
wc AS (SELECT match_id, killer_id AS player_id, class, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY match_id, killer_id) AS BIGINT) AS read
       FROM (SELECT *, CASE {_CLASS_OF} END AS class FROM us) WHERE class IS NOT NULL GROUP BY match_id, killer_id, class),
wl AS (SELECT match_id, player_id, CASE class WHEN 'Shotgun' THEN 'Shotgun specialist' ELSE class || ' player' END AS role, n, CAST(round_even(100 * n / read, 0) AS BIGINT) AS share FROM wc JOIN pl USING (player_id)
       WHERE class IN ('AR', 'SMG', 'LMG', 'Sniper', 'Shotgun') AND n >= 3 QUALIFY row_number() OVER (PARTITION BY match_id, class ORDER BY n DESC, n / read DESC, ign) = 1),
dd AS (SELECT e.match_id, round_no, true_ms, coalesce(v.team, victim_team) AS team FROM ev e LEFT JOIN mp v ON v.match_id = e.match_id AND v.player_id = e.victim_id WHERE {_OUT} AND round_no IS NOT NULL),
cm0 AS (SELECT k.event_id, k.match_id, k.round_no, k.killer_id, k.true_ms, k.feed_ms,
               3 - (SELECT count(*) FROM dd WHERE dd.match_id = k.match_id AND dd.round_no = k.round_no AND dd.team = k.killer_team AND dd.true_ms <= k.true_ms - 3500) AS own_max,
               3 - (SELECT count(*) FROM dd WHERE dd.match_id = k.match_id AND dd.round_no = k.round_no AND dd.team IS DISTINCT FROM k.killer_team AND dd.true_ms <= k.true_ms) AS enemy_min,
               3 - (SELECT count(*) FROM dd WHERE dd.match_id = k.match_id AND dd.round_no = k.round_no AND dd.team <> k.killer_team AND dd.true_ms <= k.true_ms - 3500) AS enemy_max,
               (SELECT count(*) FROM dd WHERE dd.match_id = k.match_id AND dd.round_no = k.round_no AND dd.team IS NULL AND dd.true_ms <= k.true_ms) AS unknown,
               (SELECT count(DISTINCT o.victim_id) FROM us o WHERE o.match_id = k.match_id AND o.round_no = k.round_no AND o.killer_id = k.killer_id AND (o.true_ms, o.feed_ms, o.event_id) >= (k.true_ms, k.feed_ms, k.event_id)) AS victims
        FROM us k WHERE k.round_no IS NOT NULL),
cm AS (SELECT match_id, round_no, killer_id AS player_id, enemy_max AS enemies, CASE WHEN unknown = 0 THEN own_max END AS own_alive FROM cm0
       WHERE enemy_max >= 2 AND own_max <= enemy_min AND victims >= enemy_max QUALIFY row_number() OVER (PARTITION BY match_id, round_no, killer_id ORDER BY enemy_max DESC, true_ms, feed_ms, event_id) = 1),
cl0 AS (SELECT *, CASE WHEN coalesce(own_alive, 0) = 0 THEN 3 ELSE own_alive END AS own, count(*) OVER (PARTITION BY match_id, player_id) AS rounds FROM cm),
cl1 AS (SELECT * FROM cl0 QUALIFY row_number() OVER (PARTITION BY match_id, player_id ORDER BY enemies DESC, own, round_no) = 1),
cl AS (SELECT match_id, player_id, round_no, enemies, own_alive, rounds FROM cl1 JOIN pl USING (player_id) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY enemies DESC, own, ign) = 1),
ar AS (SELECT match_id, player_id, 'Rival' AS role FROM rs UNION ALL SELECT match_id, player_id, 'Dominating' FROM dm UNION ALL SELECT match_id, player_id, role FROM tl UNION ALL SELECT match_id, player_id, role FROM wl
       UNION ALL SELECT match_id, player_id, 'Clutch' FROM cl)
"""
OUT = _OUT

_CAREER = """SELECT player_id, ign, nickname, count(DISTINCT match_id) AS matches, CAST(sum(eliminations) AS BIGINT) AS eliminations, CAST(sum(knocks) AS BIGINT) AS knocks, CAST(sum(deaths) AS BIGINT) AS deaths,
 CAST(sum(times_knocked) AS BIGINT) AS times_knocked, CAST(sum(revives_inferred) AS BIGINT) AS revives_inferred, sum(damage_dealt) AS damage_dealt, round(sum(eliminations) / greatest(sum(deaths), 1), 2) AS elim_death_ratio
 FROM pm {where} GROUP BY player_id, ign, nickname"""

SELECTS: dict[str, str] = {
    "knock_outcomes": "SELECT * FROM ko",
    "elim_credit": "SELECT * FROM cr",
    "player_match": "SELECT * FROM pm",
    "player_career": _CAREER.format(where=""),
    "range_player_totals": _CAREER.format(where="WHERE substr(recorded_at, 1, 10) BETWEEN '2024-01-03' AND '2024-01-20'"),
    "board_or_rounds": "SELECT * FROM bv",
    "player_check": """SELECT match_id, player_id, CASE WHEN scoreboard_eliminations IS NULL AND scoreboard_knock_outs IS NULL THEN '' ELSE coalesce(nullif(concat_ws('; ',
        CASE WHEN CAST(scoreboard_eliminations AS BIGINT) <> eliminations THEN 'elims ' || eliminations || ' vs board ' || CAST(scoreboard_eliminations AS BIGINT) END,
        CASE WHEN CAST(scoreboard_knock_outs AS BIGINT) <> knocks THEN 'knocks ' || knocks || ' vs board ' || CAST(scoreboard_knock_outs AS BIGINT) END), ''), 'OK') END AS "check" FROM pm""",
    "usable_knocks": "SELECT event_id, match_id, killer_id, victim_id, killer_team, victim_team_known AS victim_team FROM us",
    "knock_matrix": "SELECT match_id, killer_id, victim_id, n FROM kx",
    "pair_reverse": "SELECT match_id, killer_id, victim_id, n, back FROM pr",
    "head_to_head": """SELECT h.match_id, h.player_id, opponent_id, mp.team AS opponent_team, CAST(sum(a) AS BIGINT) AS knocked_them, CAST(sum(b) AS BIGINT) AS knocked_by_them
        FROM (SELECT match_id, killer_id AS player_id, victim_id AS opponent_id, n AS a, 0 AS b FROM kx UNION ALL SELECT match_id, victim_id, killer_id, 0, n FROM kx) h
        LEFT JOIN mp ON mp.match_id = h.match_id AND mp.player_id = h.opponent_id GROUP BY ALL""",
    "opponent_rankings": "SELECT match_id, killer_id AS player_id, string_agg(ign || ' ' || n, ' · ' ORDER BY n DESC, lower(ign)) AS ranking FROM kx JOIN pl ON pl.player_id = kx.victim_id GROUP BY match_id, killer_id",
    "hidden_death_doubt": """SELECT knock_id, EXISTS (SELECT 1 FROM ev h WHERE h.flag = 'NO_FEED_ROW' AND h.match_id = ko.match_id AND h.round_no IS NOT DISTINCT FROM ko.round_no
        AND h.true_ms >= k.true_ms - 3500 AND (h.victim_team IS NULL OR h.victim_team = mp.team)) AS doubt
        FROM ko JOIN ev k ON k.event_id = ko.knock_id LEFT JOIN mp ON mp.match_id = ko.match_id AND mp.player_id = ko.victim_id WHERE outcome = 'unresolved' AND ko.victim_id IS NOT NULL""",
    "player_knock_lines": """, db AS (SELECT knock_id, EXISTS (SELECT 1 FROM ev h WHERE h.flag = 'NO_FEED_ROW' AND h.match_id = ko.match_id AND h.round_no IS NOT DISTINCT FROM ko.round_no
        AND h.true_ms >= k.true_ms - 3500 AND (h.victim_team IS NULL OR h.victim_team = mp.team)) AS doubt, ko.match_id, ko.victim_id, outcome
        FROM ko JOIN ev k ON k.event_id = ko.knock_id LEFT JOIN mp ON mp.match_id = ko.match_id AND mp.player_id = ko.victim_id WHERE ko.victim_id IS NOT NULL),
        made AS (SELECT match_id, killer_id, count(*) AS n FROM us GROUP BY ALL)
        SELECT mp.match_id, mp.player_id, mp.team, coalesce(any_value(made.n), 0) AS knocks, count(knock_id) AS times_knocked, count(*) FILTER (outcome = 'revived' OR (outcome = 'unresolved' AND NOT doubt)) AS revived,
        count(*) FILTER (outcome = 'revived') AS revived_confirmed, count(*) FILTER (outcome = 'unresolved' AND doubt) AS revived_unclear, count(*) FILTER (outcome = 'eliminated') AS finished
        FROM mp LEFT JOIN db ON db.match_id = mp.match_id AND db.victim_id = mp.player_id LEFT JOIN made ON made.match_id = mp.match_id AND made.killer_id = mp.player_id GROUP BY mp.match_id, mp.player_id, mp.team""",
    "rivals": "SELECT * FROM rs",
    "dominating": "SELECT * FROM dm",
    "throwable_leaders": "SELECT * FROM tl",
    "weapon_class_counts": "SELECT * FROM wc",
    "weapon_class_leaders": "SELECT * FROM wl",
    "clutch": "SELECT * FROM cl",
    "knock_basis": """, bk AS (SELECT match_id, player_id, max(value) AS v FROM bo WHERE round_no IS NULL AND stat_name = 'knock_outs' AND value IS NOT NULL GROUP BY ALL)
        SELECT e.match_id, (SELECT count(*) FROM us WHERE us.match_id = e.match_id) AS knocks_used,
        coalesce((SELECT CAST(sum(v) AS BIGINT) FROM bk WHERE bk.match_id = e.match_id), count(*) FILTER (event_type = 'knock')) AS knocks_seen,
        CASE WHEN e.match_id NOT IN (SELECT match_id FROM bk) THEN 'rows' WHEN (SELECT count(*) FROM mp WHERE mp.match_id = e.match_id) > (SELECT count(*) FROM bk WHERE bk.match_id = e.match_id) THEN 'board_partial' ELSE 'board' END AS source
        FROM ev e GROUP BY e.match_id""",
    "role_order": """, rc AS (SELECT match_id, player_id, role, count(*) AS n FROM ar GROUP BY ALL UNION ALL SELECT match_id, player_id, '-', 0 FROM mp WHERE (match_id, player_id) NOT IN (SELECT (match_id, player_id) FROM ar))
        SELECT rc.match_id, row_number() OVER (PARTITION BY rc.match_id ORDER BY role = '-', team, ign,
          list_position(['Dominating', 'Rival', 'Grenadier', 'Molotov specialist', 'Driver', 'Shotgun specialist', 'AR player', 'SMG player', 'LMG player', 'Sniper player', 'Clutch'], role)) AS place,
        rc.player_id, role, n FROM rc JOIN mp ON mp.match_id = rc.match_id AND mp.player_id = rc.player_id JOIN pl ON pl.player_id = rc.player_id""",
}

#: The inputs of the dimension jobs.
BASE_DIMS = """,
nm AS (SELECT ign AS name FROM pl UNION ALL SELECT 'playor_' || player_id FROM pl WHERE player_id % 3 = 0 UNION ALL SELECT 'PLAYER _' || player_id FROM pl WHERE player_id % 5 = 1
       UNION ALL SELECT 'ghost_' || player_id FROM pl WHERE player_id % 7 = 2),
rt AS (SELECT 'playor_' || player_id AS name FROM pl WHERE player_id % 6 = 0 UNION ALL SELECT 'new_' || player_id FROM pl WHERE player_id % 10 = 3),
sb AS (SELECT *, 1 AS batch FROM bo UNION ALL SELECT match_id, round_no, player_id, stat_name, value + 1, 2 FROM bo WHERE match_id % 3 = 0 AND player_id % 2 = 0),
mb0 AS (SELECT match_id, source_file, recorded_at, CASE WHEN match_id % 3 <> 0 THEN status END AS status FROM ma WHERE match_id % 2 = 0),
mb AS (SELECT * FROM mb0 UNION ALL SELECT match_id + 1000000, source_file, recorded_at, status FROM mb0 WHERE match_id % 10 = 0)
"""
_NORM = "translate(lower(regexp_replace({0}, '\\s+', '', 'g')), 'ø0', 'oo')"
_RESOLVE = f"""(SELECT name, coalesce((SELECT min(player_id) FROM pl WHERE ign = name), (SELECT min(player_id) FROM al WHERE alias = name), (SELECT min(player_id) FROM pl WHERE {_NORM.format('ign')} = {_NORM.format('name')})) AS player_id,
    CASE WHEN name IN (SELECT ign FROM pl) THEN 'name' WHEN name IN (SELECT alias FROM al) THEN 'alias' WHEN {_NORM.format('name')} IN (SELECT {_NORM.format('ign')} FROM pl) THEN 'norm' ELSE 'new' END AS tier FROM (SELECT DISTINCT name FROM {{0}}))"""
_CHECK = """CASE WHEN pm.player_id IS NULL THEN 'on the board, but not in this match''s player list' WHEN NOT has_match_board THEN '' WHEN b.player_id IS NULL THEN 'not on the board'
    WHEN u = '' THEN CASE WHEN d = '' THEN 'OK' ELSE d END WHEN d = '' THEN u || ' unreadable on the board' ELSE d || ' (' || u || ' unreadable)' END"""

DIM_SELECTS: dict[str, str] = {
    "known_names": "SELECT ign AS name FROM pl UNION SELECT alias FROM al",
    "players_list": "SELECT player_id, ign, nickname, coalesce((SELECT string_agg(alias, ', ' ORDER BY alias) FROM al WHERE al.player_id = pl.player_id), '') AS aliases FROM pl",
    "resolve_player": f"SELECT * FROM {_RESOLVE.format('nm')}",
    "canonical_name": "SELECT DISTINCT name, coalesce((SELECT ign FROM al JOIN pl USING (player_id) WHERE alias = name), name) AS canonical FROM nm",
    "roster_expand": f""", ids AS (SELECT player_id FROM {_RESOLVE.format('rt')} WHERE player_id IS NOT NULL)
        SELECT name FROM rt UNION SELECT ign FROM pl WHERE player_id IN (SELECT player_id FROM ids) UNION SELECT alias FROM al WHERE player_id IN (SELECT player_id FROM ids)""",
    "rename_merge_events": "SELECT event_id, CASE WHEN killer_id % 15 = 14 THEN killer_id - 1 ELSE killer_id END AS killer_id, CASE WHEN victim_id % 15 = 14 THEN victim_id - 1 ELSE victim_id END AS victim_id FROM ev",
    "rename_merge_boards": """SELECT match_id, round_no, CASE WHEN player_id % 15 = 14 THEN player_id - 1 ELSE player_id END AS player_id, stat_name, value FROM bo
        QUALIFY row_number() OVER (PARTITION BY match_id, round_no, stat_name, CASE WHEN player_id % 15 = 14 THEN player_id - 1 ELSE player_id END ORDER BY player_id) = 1""",
    "rename_merge_players": """SELECT match_id, CASE WHEN player_id % 15 = 14 THEN player_id - 1 ELSE player_id END AS player_id, team, slot FROM mp
        QUALIFY row_number() OVER (PARTITION BY match_id, CASE WHEN player_id % 15 = 14 THEN player_id - 1 ELSE player_id END ORDER BY player_id) = 1""",
    "delete_match": "SELECT event_id, match_id FROM ev WHERE match_id NOT IN (SELECT match_id FROM ma WHERE match_id % 5 = 0)",
    "drop_old_pipeline": "SELECT event_id, match_id FROM ev WHERE match_id NOT IN (SELECT match_id FROM ma WHERE pipeline_version LIKE '0.1%')",
    "prune_players": """, g AS (SELECT match_id FROM ma WHERE match_id % 1000 % 3 = 0)
        SELECT player_id, ign, nickname FROM pl WHERE player_id IN (SELECT killer_id FROM ev WHERE match_id NOT IN (SELECT * FROM g)) OR player_id IN (SELECT victim_id FROM ev WHERE match_id NOT IN (SELECT * FROM g))
        OR player_id IN (SELECT player_id FROM bo WHERE match_id NOT IN (SELECT * FROM g)) OR player_id IN (SELECT player_id FROM mp WHERE match_id NOT IN (SELECT * FROM g)) OR ign IN (SELECT name FROM rt) OR player_id % 25 = 0""",
    "apply_corrections": """SELECT event_id, CASE WHEN event_id % 100 = 0 THEN match_id % 1000 * 15 ELSE killer_id END AS killer_id, victim_id, CASE WHEN event_id % 100 = 0 THEN 'kill' ELSE event_type END AS event_type,
        CASE WHEN event_id % 100 = 0 THEN weapon WHEN event_id % 50 = 0 THEN 'AKM' ELSE weapon END AS weapon, CASE WHEN event_id % 50 = 0 THEN 1 ELSE reviewed END AS reviewed FROM ev""",
    "backfill_victim_team": "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN victim_team END, mp.team) AS victim_team FROM ev LEFT JOIN mp ON mp.match_id = ev.match_id AND mp.player_id = ev.victim_id",
    "ingest_matches": """SELECT match_id, source_file, recorded_at, coalesce(status, CASE WHEN match_id IN (SELECT match_id FROM ev WHERE flag IS NOT NULL) THEN 'needs_review' ELSE 'processed' END) AS status FROM mb
        WHERE (source_file, recorded_at) NOT IN (SELECT (source_file, recorded_at) FROM ma WHERE match_id % 4 = 0) QUALIFY row_number() OVER (PARTITION BY source_file, recorded_at ORDER BY match_id) = 1""",
    "replace_match": """SELECT match_id, source_file, recorded_at, status FROM ma WHERE match_id % 4 = 0 AND (source_file, recorded_at) NOT IN (SELECT (source_file, recorded_at) FROM mb)
        UNION ALL SELECT match_id, source_file, recorded_at, status FROM mb""",
    "upsert_stats": """SELECT match_id, round_no, player_id, stat_name, value FROM sb WHERE round_no IS NOT NULL OR batch = (SELECT max(batch) FROM sb z WHERE z.match_id = sb.match_id AND z.round_no IS NULL)
        QUALIFY row_number() OVER (PARTITION BY match_id, round_no, player_id, stat_name ORDER BY batch DESC) = 1""",
    "upsert_match_players": "SELECT match_id, player_id, CASE WHEN player_id % 7 <> 0 THEN team WHEN team = 'blue' THEN 'red' ELSE 'blue' END AS team, slot FROM mp",
    "recover_interrupted": "SELECT match_id, CASE WHEN status = 'live' THEN 'interrupted' ELSE status END AS status FROM ma",
    "v_events": """SELECT ev.event_id, ev.match_id, recorded_at, round_no, true_ms, feed_ms, round((feed_ms - true_ms) / 1000.0, 2) AS feed_delay_s, event_type, k.ign AS killer, v.ign AS victim, weapon, victim_team, confidence, flag, reviewed
        FROM ev JOIN ma USING (match_id) LEFT JOIN pl k ON k.player_id = killer_id LEFT JOIN pl v ON v.player_id = victim_id""",
    "match_counts": f"""SELECT match_id, count(*) FILTER ({OUT}) AS eliminations, count(*) FILTER ({OUT} AND killer_id IS NOT NULL AND victim_id IS NOT NULL AND flag IS NULL) AS named, count(*) FILTER (flag = 'NO_FEED_ROW') AS no_feed_row,
        count(*) FILTER (flag = 'NO_DROP') AS no_drop, count(*) FILTER (event_type = 'knock') AS knocks, count(*) FILTER (flag IS NOT NULL AND reviewed = 0) AS to_review,
        (SELECT count(*) FROM ro WHERE ro.match_id = ev.match_id) AS rounds, (SELECT count(DISTINCT player_id) FROM bo WHERE bo.match_id = ev.match_id AND bo.round_no IS NULL) AS board_players,
        (SELECT count(*) FROM bo WHERE bo.match_id = ev.match_id AND bo.round_no IS NULL AND value IS NULL) AS blank_cells FROM ev GROUP BY match_id""",
    "match_list": f"""SELECT match_id, recorded_at, source_file, status, (SELECT count(*) FROM ev WHERE ev.match_id = ma.match_id AND {OUT}) AS eliminations,
        (SELECT count(*) FROM ev WHERE ev.match_id = ma.match_id AND flag IS NOT NULL AND reviewed = 0) AS to_review, (SELECT count(*) FROM mp WHERE mp.match_id = ma.match_id) AS players FROM ma""",
    "match_list_filter": """SELECT match_id, recorded_at FROM ma WHERE substr(recorded_at, 1, 10) BETWEEN '2024-01-03' AND '2024-01-20'
        AND match_id IN (SELECT match_id FROM mp JOIN pl USING (player_id) WHERE lower(ign) LIKE '%r\\_2%' ESCAPE '\\' OR lower(nickname) LIKE '%r\\_2%' ESCAPE '\\')""",
    "to_review": "SELECT event_id FROM ev WHERE flag IS NOT NULL AND reviewed = 0",
    "board_wide": """SELECT match_id, player_id, max(value) FILTER (stat_name = 'eliminations') AS eliminations, CAST(NULL AS DOUBLE) AS assists, max(value) FILTER (stat_name = 'damage_dealt') AS damage_dealt, CAST(NULL AS DOUBLE) AS damage_taken,
        max(value) FILTER (stat_name = 'knock_outs') AS knock_outs FROM bo WHERE round_no IS NULL GROUP BY match_id, player_id""",
    "board_vs_feed": f""", b AS (SELECT match_id, player_id, max(value) FILTER (stat_name = 'eliminations') AS be, max(value) FILTER (stat_name = 'knock_outs') AS bk FROM bo WHERE round_no IS NULL GROUP BY match_id, player_id)
        SELECT coalesce(pm.match_id, b.match_id) AS match_id, coalesce(pm.player_id, b.player_id) AS player_id, be, bk, eliminations, knocks, {_CHECK} AS "check"
        FROM pm FULL JOIN b ON pm.match_id = b.match_id AND pm.player_id = b.player_id,
        LATERAL (SELECT concat_ws('; ', CASE WHEN CAST(be AS BIGINT) <> eliminations THEN 'elims ' || eliminations || ' vs board ' || CAST(be AS BIGINT) END, CASE WHEN CAST(bk AS BIGINT) <> knocks THEN 'knocks ' || knocks || ' vs board ' || CAST(bk AS BIGINT) END) AS d,
                 concat_ws(' and ', CASE WHEN be IS NULL THEN 'Eliminations' END, CASE WHEN bk IS NULL THEN 'Knock outs' END) AS u)""",
    "matches_newest_first": "SELECT match_id, recorded_at, row_number() OVER (ORDER BY recorded_at DESC, match_id) AS place FROM ma",
    "match_timeline": "SELECT match_id, event_id, row_number() OVER (PARTITION BY match_id ORDER BY true_ms, feed_ms, event_id) AS place FROM ev",
    "scoreboard_order": "SELECT match_id, round_no, player_id, stat_name, row_number() OVER (PARTITION BY match_id ORDER BY round_no NULLS FIRST, 'player_' || player_id, stat_name) AS place FROM bo",
    "rounds_order": "SELECT match_id, round_no, row_number() OVER (PARTITION BY match_id ORDER BY round_no) AS place FROM ro",
    "roster_by_team": "SELECT match_id, player_id, row_number() OVER (PARTITION BY match_id ORDER BY team, eliminations DESC, ign) AS place FROM pm",
    "round_summary": "SELECT match_id, round_no, start_ms, end_ms, blue_score, red_score, CASE WHEN blue_score > red_score THEN 'blue' WHEN red_score > blue_score THEN 'red' END AS leader FROM ro",
    "round_reconcile": f"""SELECT coalesce(e.match_id, ro.match_id) AS match_id, coalesce(e.round_no, ro.round_no) AS round_no, coalesce(n, 0) AS counted, coalesce(blue_score + red_score, 0) AS deaths, coalesce(n, 0) - coalesce(blue_score + red_score, 0) AS difference
        FROM (SELECT match_id, round_no, count(*) AS n FROM ev WHERE {OUT} AND round_no IS NOT NULL GROUP BY ALL) e FULL JOIN ro ON ro.match_id = e.match_id AND ro.round_no = e.round_no""",
    "run_notes": """SELECT match_id, string_agg(note, '; ' ORDER BY note) AS notes FROM (SELECT match_id, count(*) || ' rows are flagged ' || flag AS note FROM ev WHERE flag IS NOT NULL GROUP BY match_id, flag) GROUP BY match_id""",
    "board_progress": "SELECT mp.match_id, count(*) AS expected, count(b.player_id) AS read, count(*) = count(b.player_id) AS complete FROM mp LEFT JOIN (SELECT DISTINCT match_id, player_id FROM bo WHERE round_no IS NULL) b ON b.match_id = mp.match_id AND b.player_id = mp.player_id GROUP BY mp.match_id",
    "round_for_event": """SELECT event_id, (SELECT min(round_no) FROM ro WHERE ro.match_id = ev.match_id AND ro.start_ms <= ev.feed_ms AND ev.feed_ms <= ro.end_ms + 6000) AS found_round FROM ev""",
    "round_asof": """SELECT event_id, coalesce((SELECT max(round_no) FROM ro WHERE ro.match_id = ev.match_id AND ro.start_ms <= ev.feed_ms), 1) AS found_round FROM ev""",
}

#: The readings of ``sources.readings``.
BASE_READS = f""",
gr AS (SELECT match_id, unnest(range(0, 1080001, 500)) AS t_ms FROM ma),
de AS (SELECT match_id, feed_ms AS t_ms, feed_ms // 72000 AS part FROM ev WHERE {_OUT}),
cn AS (SELECT match_id, part, t_ms, count(*) AS n FROM de GROUP BY ALL),
al0 AS (SELECT match_id, t_ms // 72000 AS part, t_ms, 0 AS n, 1 AS g FROM gr UNION ALL SELECT match_id, part, t_ms, n, 0 FROM cn),
al1 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY match_id, part ORDER BY t_ms RANGE UNBOUNDED PRECEDING) AS BIGINT) AS dead FROM al0),
rd AS (SELECT match_id, t_ms, CASE WHEN t_ms // 500 % 37 <> 0 THEN greatest(15 - dead, 0) + CASE WHEN t_ms // 500 % 41 = 0 THEN 1 ELSE 0 END END AS value FROM al1 WHERE g = 1),
-- two equal readings in a row (unread ones skipped) confirm a value
ru0 AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS nx, row_number() OVER w AS i FROM rd WHERE value IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY t_ms)),
ok AS (SELECT *, CASE WHEN value = p THEN value END AS sure FROM ru0),
st AS (SELECT *, last_value(sure IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM ok),
ch AS (SELECT match_id, t_ms, i, was, sure AS value FROM st WHERE sure IS NOT NULL AND sure IS DISTINCT FROM was),
hm AS (SELECT c.match_id, c.i, c.was, c.value, coalesce(max(s.i) FILTER (s.value = c.was), 0) AS home FROM ch c JOIN st s ON s.match_id = c.match_id AND s.i < c.i GROUP BY ALL),
cc AS (SELECT h.match_id, CASE WHEN h.was IS NULL THEN (SELECT t_ms FROM st s WHERE s.match_id = h.match_id AND s.i = h.i - 1) ELSE (SELECT t_ms FROM st s WHERE s.match_id = h.match_id AND s.i = h.home + 1) END AS t_ms, was, value,
              CAST(coalesce(greatest(was - value, 0), 0) AS BIGINT) AS deaths,
              coalesce(value > was AND value >= max(value) OVER (PARTITION BY h.match_id ORDER BY h.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_reset FROM hm h),
si AS (SELECT match_id, event_id AS line, feed_ms + 250 * i AS t_ms, CASE WHEN (event_id + i) % 5 = 0 THEN 'kill' ELSE event_type END AS etype, CASE WHEN i % 3 <> 1 THEN weapon END AS weapon
       FROM (SELECT *, unnest(range(0, event_id % 8 + 1)) AS i FROM ev WHERE event_type <> 'other')),
sc AS (SELECT DISTINCT match_id, feed_ms AS t_ms FROM ev WHERE event_id % 3 = 0)
"""


def _islands(source: str, key: str, gap: int) -> str:
    opened = f"SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY {key} ORDER BY t_ms) <= {gap} THEN 0 ELSE 1 END AS opens FROM {source}"
    return f"(SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS no FROM ({opened}))"


READ_SELECTS: dict[str, str] = {
    "counter_debounce": "SELECT * FROM cc",
    "counter_deaths": "SELECT match_id, t_ms, unnest(range(1, deaths + 1)) AS death_no FROM cc WHERE deaths > 0",
    "board_sessions": f"""SELECT match_id, CAST(no AS BIGINT) AS board_no, min(t_ms) AS start_ms, max(t_ms) AS end_ms, count(*) AS reads,
        CASE WHEN max(t_ms) - min(t_ms) >= 5000 OR no = max(no) OVER (PARTITION BY match_id) THEN 'match' ELSE 'round' END AS kind FROM {_islands('sc', 'match_id', 2000)} GROUP BY match_id, no""",
    "sighting_sessions": f"""SELECT match_id, line, CAST(no AS BIGINT) AS session, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS seen FROM {_islands('si', 'match_id, line', 1000)}
        GROUP BY match_id, line, no HAVING max(t_ms) - min(t_ms) >= 500 AND count(*) >= 3""",
    "majority_type": "SELECT match_id, line, etype FROM si GROUP BY match_id, line, etype QUALIFY row_number() OVER (PARTITION BY match_id, line ORDER BY count(*) DESC, etype = 'kill', etype) = 1",
    "majority_weapon": "SELECT match_id, line, weapon FROM si WHERE weapon IS NOT NULL GROUP BY match_id, line, weapon QUALIFY row_number() OVER (PARTITION BY match_id, line ORDER BY count(*) DESC, weapon) = 1",
    "resample": "SELECT match_id, CAST(ceil(t_ms / 1500) AS BIGINT) AS k, min(t_ms) AS t_ms, arg_min(coalesce(value, -1), t_ms) AS value FROM rd GROUP BY match_id, ceil(t_ms / 1500)",
    "sample_readings": "SELECT match_id, line, t_ms FROM (SELECT DISTINCT match_id, line, t_ms FROM si) QUALIFY row_number() OVER (PARTITION BY match_id, line ORDER BY t_ms) <= 3",
    "skipped_spans": f"SELECT match_id, CAST(no AS BIGINT) AS span, min(t_ms) AS start_ms, max(t_ms) AS end_ms, max(t_ms) - min(t_ms) AS length_ms FROM {_islands('sc', 'match_id', 1000)} GROUP BY match_id, no",
    "reads_vs_truth": f"""SELECT match_id, count(*) FILTER (rd.value = 15 - d) AS correct, count(*) FILTER (rd.value IS NULL) AS blank, count(*) FILTER (rd.value <> 15 - d) AS wrong
        FROM (SELECT ro.match_id, ro.start_ms, ro.start_ms + 10000 AS end_ms, ro.blue_score % 5 AS d FROM ro) t JOIN rd USING (match_id) WHERE t_ms >= start_ms AND t_ms < end_ms GROUP BY match_id""",
    "late_row_round": """, fd AS (SELECT match_id, t_ms // 72000 + 1 AS r, min(t_ms) AS t FROM cc WHERE deaths > 0 GROUP BY ALL),
        pc AS (SELECT event_id, ev.match_id, feed_ms, event_type, max(ro.round_no) AS r, max(ro.start_ms) AS s FROM ev LEFT JOIN ro ON ro.match_id = ev.match_id AND ro.start_ms <= ev.feed_ms GROUP BY ALL),
        lt AS (SELECT event_id, coalesce(pc.r, 1) AS r, coalesce(pc.r >= 2 AND (feed_ms - s <= 8000 OR (feed_ms - s <= 15000 AND event_type IN ('kill', 'eliminated_knocked') AND NOT coalesce(fd.t <= feed_ms + 1000, false))), false) AS late
               FROM pc LEFT JOIN fd ON fd.match_id = pc.match_id AND fd.r = coalesce(pc.r, 1))
        SELECT event_id, r - CAST(late AS INTEGER) AS found_round, late FROM lt""",
}

ROW_SELECTS: dict[str, str] = {
    "row_type": "SELECT event_id, CASE WHEN event_type = 'knock' OR event_id % 10 = 0 THEN 'knock' WHEN event_type = 'eliminated_knocked' THEN 'eliminated_knocked' ELSE 'kill' END AS event_type FROM ev",
    "weapon_pick": f""", gs AS (SELECT event_id, weapon AS gun, 75 + event_id % 25 AS score FROM ev WHERE weapon <> 'Zone' UNION ALL
        SELECT event_id, ([{_GUNS}])[list_position([{_GUNS}], weapon) % 27 + 1], 70 + event_id % 19 FROM ev WHERE weapon <> 'Zone')
        SELECT event_id, CASE WHEN max(score) >= 80 AND max(score) - min(score) >= 5 THEN arg_max(gun, score) END AS weapon FROM gs GROUP BY event_id""",
    "row_flag": """SELECT event_id, CASE WHEN killer_id IS NULL OR victim_id IS NULL OR killer_id = victim_id THEN 'UNRESOLVED' END AS flag,
        round(CASE WHEN killer_id IS NOT NULL AND victim_id IS NOT NULL THEN least(event_id % 100, event_id * 7 % 100) ELSE greatest(event_id % 100, event_id * 7 % 100) END / 100.0, 2) AS confidence FROM ev""",
    "short_row_gate": "SELECT event_id AS line, feed_ms AS first_ms, feed_ms + event_id % 8 * 250 AS last_ms FROM ev WHERE event_id % 8 >= 2 OR (killer_id <> victim_id AND event_id % 3 >= 1 AND event_id % 8 = 1)",
    "slot_debounce": f""", s0 AS (SELECT match_id, round_no, victim_id AS slot, feed_ms AS t_ms, event_id, 'dead' AS state FROM ev WHERE victim_id IS NOT NULL AND event_type IN ('kill', 'eliminated_knocked') AND round_no IS NOT NULL
            UNION ALL SELECT match_id, round_no, killer_id, feed_ms, event_id, 'alive' FROM ev WHERE killer_id IS NOT NULL AND round_no IS NOT NULL),
        s1 AS (SELECT match_id, round_no, slot, t_ms, max(struct_pack(e := event_id, s := state)).s AS state FROM s0 GROUP BY match_id, round_no, slot, t_ms),
        s2 AS (SELECT *, lag(state) OVER w AS before, lead(state) OVER w AS after FROM s1 WINDOW w AS (PARTITION BY match_id, round_no, slot ORDER BY t_ms))
        SELECT match_id, round_no, slot, t_ms FROM s2 WHERE state = 'dead' AND before = 'alive' AND (after IS NULL OR after = 'dead')""",
    "round_winner": """, r0 AS (SELECT e.match_id, e.round_no, feed_ms AS t_ms, max(CASE WHEN event_id % 13 <> 0 THEN e.round_no + CASE WHEN e.match_id % 2 = 0 AND (feed_ms - start_ms) // 9000 >= 5 THEN 1 ELSE 0 END END) AS blue,
            max(CASE WHEN event_id % 11 <> 0 THEN e.round_no + CASE WHEN e.match_id % 3 = 0 AND (feed_ms - start_ms) // 9000 >= 4 THEN 1 ELSE 0 END END) AS red
            FROM ev e JOIN ro ON ro.match_id = e.match_id AND ro.round_no = e.round_no GROUP BY ALL),
        r1 AS (SELECT match_id, round_no, arg_min(blue, t_ms) FILTER (blue IS NOT NULL) AS b0, arg_min(red, t_ms) FILTER (red IS NOT NULL) AS r0 FROM r0 GROUP BY ALL),
        r2 AS (SELECT match_id, round_no, min(t_ms) FILTER (blue > b0) AS b, min(t_ms) FILTER (red > r1.r0) AS r FROM r0 JOIN r1 USING (match_id, round_no) GROUP BY ALL)
        SELECT match_id, round_no, CASE WHEN b <= r OR (b IS NOT NULL AND r IS NULL) THEN 'blue' WHEN r IS NOT NULL THEN 'red' END AS winner, least(b, r) AS end_ms FROM r2""",
    "room_size": """, v AS (SELECT ro.match_id, (SELECT arg_max(value, t_ms) FROM cc WHERE cc.match_id = ro.match_id AND cc.t_ms <= ro.start_ms) AS value FROM ro)
        SELECT match_id, max(value) AS players, CAST(greatest(2, max(value) // 2) AS BIGINT) AS team_size FROM v GROUP BY match_id""",
    "layout_gate": """, lr AS (SELECT match_id, t_ms, unnest(['counter', 'score', 'board']) AS landmark, unnest([t_ms // 500 % 37 <> 0, (t_ms // 500 + match_id) % 3 <> 0, (t_ms // 500 * 7 + match_id) % 10 < 4]) AS hit FROM gr),
        t AS (SELECT *, ntile(20) OVER (PARTITION BY match_id, landmark ORDER BY t_ms) AS tile FROM lr), f AS (SELECT match_id, landmark, tile, arg_min(hit, t_ms) AS hit FROM t GROUP BY ALL),
        s AS (SELECT match_id, landmark, 100 * count(*) FILTER (hit) / count(*) < CASE landmark WHEN 'counter' THEN 95 WHEN 'score' THEN 60 ELSE 50 END AS fails FROM f GROUP BY match_id, landmark)
        SELECT match_id, count(*) FILTER (fails) AS failures, count(*) FILTER (fails) <= 1 AND count(*) FILTER (fails AND landmark = 'counter') = 0 AS ok FROM s GROUP BY match_id""",
    "near_miss_seconds": f"SELECT match_id, count(*) / 2.0 AS seconds FROM ev WHERE {_OUT} AND event_id % 7 = 0 GROUP BY match_id HAVING count(*) >= 3",
    "match_end": f""", bs AS (SELECT match_id, max(t_ms) AS end_ms FROM {_islands('sc', 'match_id', 2000)} GROUP BY match_id, no),
        x AS (SELECT event_id, feed_ms, (SELECT max(end_ms) FROM bs WHERE bs.match_id = ev.match_id AND end_ms <= feed_ms) AS board, (SELECT max(t_ms) FROM cc WHERE cc.match_id = ev.match_id AND deaths > 0 AND t_ms <= feed_ms) AS sign FROM ev)
        SELECT event_id FROM x WHERE feed_ms - board > 25000 AND coalesce(sign < board, true)""",
    "pair_vote": """, v AS (SELECT event_id AS line, CASE WHEN o % 2 = 0 THEN CASE WHEN o % 7 = 0 THEN victim_id ELSE killer_id END END AS k, 60 + o % 40 AS ks, CASE WHEN o % 3 <> 0 THEN victim_id END AS v, 60 + o * 3 % 40 AS vs
            FROM (SELECT *, event_id + unnest(range(0, event_id % 6 + 1)) AS o FROM ev WHERE killer_id IS NOT NULL AND victim_id IS NOT NULL)),
        b AS (SELECT line, k, v FROM v WHERE k IS NOT NULL AND v IS NOT NULL GROUP BY line, k, v QUALIFY row_number() OVER (PARTITION BY line ORDER BY sum(least(ks, vs)) DESC, k, v) = 1),
        a1 AS (SELECT line, k FROM v WHERE k IS NOT NULL GROUP BY line, k QUALIFY row_number() OVER (PARTITION BY line ORDER BY sum(ks) DESC, k) = 1),
        a2 AS (SELECT line, v FROM v WHERE v IS NOT NULL GROUP BY line, v QUALIFY row_number() OVER (PARTITION BY line ORDER BY sum(vs) DESC, v) = 1)
        SELECT line, k AS killer_id, v AS victim_id FROM b UNION ALL
        SELECT line, CASE WHEN k IS DISTINCT FROM v THEN k END, CASE WHEN k IS DISTINCT FROM v THEN v END FROM a1 FULL JOIN a2 USING (line) WHERE line NOT IN (SELECT line FROM b)""",
    "stitch_board": """, c AS (SELECT match_id, player_id, stat_name, value + CASE WHEN (player_id + p) % 3 = 0 THEN 1 ELSE 0 END AS value FROM (SELECT *, unnest(range(0, player_id % 4 + 1)) AS p FROM bo WHERE round_no IS NULL))
        SELECT match_id, player_id, stat_name, value, round(count(*) / sum(count(*)) OVER (PARTITION BY match_id, player_id, stat_name), 2) AS share FROM c GROUP BY match_id, player_id, stat_name, value
        QUALIFY row_number() OVER (PARTITION BY match_id, player_id, stat_name ORDER BY count(*) DESC, value NULLS LAST) = 1""",
    "board_vs_truth": """, tr AS (SELECT match_id, player_id, stat_name, v FROM (SELECT match_id, player_id, UNNEST(['eliminations', 'knock_outs']) AS stat_name, UNNEST([finishes, knocks]) AS v FROM pm))
        SELECT stat_name, count(*) FILTER (value = v) AS correct, count(*) FILTER (value IS NULL) AS blank, count(*) FILTER (value <> v) AS wrong FROM bo JOIN tr USING (match_id, player_id, stat_name) WHERE round_no IS NULL GROUP BY stat_name""",
    "seen_together_dedupe": """, s AS (SELECT event_id, match_id, killer_id - killer_id % 15 AS k, victim_id - victim_id % 3 AS v, event_type, feed_ms, event_id % 4 AS n FROM ev WHERE event_type <> 'other' AND killer_id IS NOT NULL AND victim_id IS NOT NULL)
        SELECT DISTINCT a.event_id FROM s a JOIN s b ON a.match_id = b.match_id AND a.k = b.k AND a.v = b.v AND abs(a.feed_ms - b.feed_ms) <= 5000 WHERE a.n = 0 AND b.n > 0
        AND (a.event_type = b.event_type OR NOT (a.feed_ms // 1000 BETWEEN b.feed_ms // 1000 AND b.feed_ms // 1000 + b.n))""",
    "all_board_names": "SELECT match_id, player_id FROM mp UNION SELECT match_id, player_id FROM bo WHERE round_no IS NULL",
    "board_without_alias": "SELECT match_id, player_id, max(value) AS best FROM bo WHERE round_no IS NULL AND player_id NOT IN (SELECT player_id FROM al) GROUP BY match_id, player_id",
    "export_all_events": "SELECT ev.event_id, substr(recorded_at, 1, 10) AS day FROM ev JOIN ma USING (match_id) WHERE substr(recorded_at, 1, 10) BETWEEN '2024-01-03' AND '2024-01-20'",
    "scalar_functions": """SELECT player_id, translate(lower(regexp_replace(ign, '\\s+', '', 'g')), 'ø0', 'oo') AS norm, regexp_replace('*' || ign || '!', '[^\\p{L}\\p{N}_.\\-]', '', 'g') AS clean,
        lpad(CAST(player_id * 37 // 60 AS VARCHAR), CAST(greatest(2, length(CAST(player_id * 37 // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(player_id * 37 % 60 AS VARCHAR), 2, '0') || '.25' AS mmss, '2024-01-05 10-00-00' AS stamp FROM pl""",
}

ROW_SELECTS |= {
    "badge_team": """, r AS (SELECT match_id, f AS frame, player_id, 100 + slot * 80 + slot % 3 - f * 400 AS y FROM mp, (SELECT unnest([0, 1]) AS f) WHERE f = 0 OR slot >= 5),
        pit AS (SELECT match_id, frame, median(y - b) AS pitch FROM (SELECT *, lag(y) OVER (PARTITION BY match_id, frame ORDER BY y) AS b FROM r) GROUP BY ALL),
        bg AS (SELECT unnest([0, 0, 1]) AS frame, unnest([380, 980, 580]) AS badge_y, unnest([1, 2, 2]) AS number),
        n AS (SELECT r.*, badge_y, number, abs(y - badge_y) AS away FROM r JOIN bg USING (frame) QUALIFY row_number() OVER (PARTITION BY match_id, frame, player_id ORDER BY abs(y - badge_y), badge_y) = 1)
        SELECT match_id, frame, player_id, CASE WHEN away <= 4 * coalesce(pitch, 82) THEN CASE number WHEN 1 THEN 'blue' ELSE 'red' END END AS team FROM n JOIN pit USING (match_id, frame)""",
    "resolve_pending": """, p AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN killer_id END AS k0, CASE WHEN event_id % 4 <> 0 THEN victim_id END AS v0,
            CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN killer_id END AS k1, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 14 = 0 THEN killer_id ELSE victim_id END END AS v1 FROM ev),
        f AS (SELECT *, coalesce(k0, k1) <> coalesce(v0, v1) AS fits FROM p)
        SELECT event_id, CASE WHEN fits THEN coalesce(k0, k1) ELSE k0 END AS killer_id, CASE WHEN fits THEN coalesce(v0, v1) ELSE v0 END AS victim_id,
        CASE WHEN k0 IS NOT NULL AND v0 IS NOT NULL THEN NULL WHEN fits THEN NULL ELSE 'UNRESOLVED' END AS flag FROM f""",
    "round_sides": """, sr AS (SELECT match_id, feed_ms AS t_ms, 8 AS blue, max(CASE WHEN event_id % 5 = 0 THEN 6 ELSE 7 END) AS red FROM ev WHERE event_id % 3 <> 0 GROUP BY match_id, feed_ms),
        k AS (SELECT sr.*, (SELECT arg_max(value, t_ms) FROM cc WHERE cc.match_id = sr.match_id AND cc.t_ms <= sr.t_ms) AS now, (SELECT max(t_ms) FROM cc WHERE cc.match_id = sr.match_id AND deaths > 0 AND cc.t_ms <= sr.t_ms) AS died,
                     (SELECT max(start_ms) FROM ro WHERE ro.match_id = sr.match_id AND ro.start_ms <= sr.t_ms) AS s FROM sr)
        SELECT k.match_id, round_no, CAST(arg_min(blue, t_ms) AS BIGINT) AS blue, CAST(arg_min(red, t_ms) AS BIGINT) AS red FROM k JOIN ro ON ro.match_id = k.match_id AND ro.start_ms = k.s
        WHERE blue + red = now AND t_ms <= end_ms AND NOT coalesce(died >= start_ms, false) GROUP BY k.match_id, round_no""",
    "player_lines_order": """, made AS (SELECT match_id, killer_id, count(*) AS n FROM us GROUP BY ALL)
        SELECT mp.match_id, mp.player_id, row_number() OVER (PARTITION BY mp.match_id ORDER BY team, coalesce(n, 0) DESC, ign) AS place FROM mp JOIN pl USING (player_id) LEFT JOIN made ON made.match_id = mp.match_id AND made.killer_id = mp.player_id""",
}

_BOARDS = f"(SELECT match_id, CAST(no AS BIGINT) AS board_no, min(t_ms) AS start_ms, max(t_ms) AS end_ms FROM {_islands('sc', 'match_id', 2000)} GROUP BY match_id, no)"
ROW_SELECTS |= {
    "round_segments": f""", bs AS {_BOARDS},
        mk AS (SELECT match_id, feed_ms AS t_ms, 'live' AS kind FROM ev WHERE event_id % 3 = 1 UNION ALL SELECT match_id, t_ms, 'reset' FROM cc WHERE is_reset UNION ALL SELECT match_id, t_ms, 'death' FROM cc WHERE deaths > 0
            UNION ALL SELECT match_id, feed_ms, 'row' FROM ev UNION ALL SELECT match_id, end_ms, 'rise' FROM ro),
        pt AS (SELECT *, (SELECT count(*) FROM bs WHERE bs.match_id = mk.match_id AND bs.end_ms <= mk.t_ms) AS part FROM mk),
        lo AS (SELECT match_id, part, min(t_ms) FILTER (kind = 'live') AS l, min(t_ms) FILTER (kind = 'reset') AS r FROM pt GROUP BY match_id, part),
        sx AS (SELECT match_id, part, CASE WHEN EXISTS (SELECT 1 FROM pt WHERE pt.match_id = lo.match_id AND pt.part = lo.part AND ((kind = 'death' AND t_ms >= r) OR (kind = 'row' AND t_ms >= r + 8000))) THEN least(l, r) ELSE l END AS s FROM lo),
        en AS (SELECT sx.match_id, sx.part, s, min(t_ms) FILTER (kind = 'rise' AND t_ms >= s) AS rise, max(t_ms) FILTER (kind = 'live') AS gone FROM sx JOIN pt ON pt.match_id = sx.match_id AND pt.part = sx.part WHERE s IS NOT NULL GROUP BY ALL)
        SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY part) AS round_no, s AS start_ms, coalesce(rise, greatest(gone, s)) AS end_ms FROM en""",
    "missed_round": f""", bs AS {_BOARDS}, sp AS (SELECT match_id, board_no, coalesce(lag(end_ms) OVER (PARTITION BY match_id ORDER BY board_no), 0) AS f, start_ms AS t FROM bs)
        SELECT match_id, board_no, f AS start_ms, t AS end_ms FROM sp WHERE NOT EXISTS (SELECT 1 FROM ro WHERE ro.match_id = sp.match_id AND ro.start_ms >= f AND ro.start_ms < t)""",
}

#: With recursion: each kept row leads to the next one of its key that is more than 5 s later.
RECURSIVE_SELECTS: dict[str, str] = {
    "dedupe_events": """, dn AS (SELECT event_id, match_id, killer_id, victim_id, event_type, feed_ms FROM ev WHERE killer_id IS NOT NULL AND victim_id IS NOT NULL),
        kp AS (SELECT * FROM (SELECT * FROM dn QUALIFY row_number() OVER (PARTITION BY match_id, killer_id, victim_id, event_type ORDER BY feed_ms, event_id) = 1)
            UNION ALL SELECT event_id, match_id, killer_id, victim_id, event_type, feed_ms FROM (SELECT d.*, row_number() OVER (PARTITION BY d.match_id, d.killer_id, d.victim_id, d.event_type ORDER BY d.feed_ms, d.event_id) AS n
                FROM kp JOIN dn d ON d.match_id = kp.match_id AND d.killer_id = kp.killer_id AND d.victim_id = kp.victim_id AND d.event_type = kp.event_type AND d.feed_ms > kp.feed_ms + 5000) WHERE n = 1)
        SELECT event_id FROM kp""",
}

RECURSIVE_SELECTS["stream_dedupe"] = RECURSIVE_SELECTS["dedupe_events"]

_GUN_ROLE = " ".join(f"WHEN weapon IN ({', '.join(chr(39) + g + chr(39) for g in CLASSES[c])}) THEN '{r}'" for c, r in (("AR", "AR player"), ("SMG", "SMG player"), ("LMG", "LMG player"), ("Sniper", "Sniper player"), ("Shotgun", "Shotgun specialist")))
_S = "CASE WHEN {0} = 1 THEN '' ELSE 's' END"
SELECTS["role_details"] = f""", dn AS (SELECT match_id, victim_id, count(*) AS downs FROM us GROUP BY ALL),
    gu AS (SELECT match_id, killer_id AS player_id, weapon, count(*) AS c, CASE {_GUN_ROLE} END AS role FROM us WHERE weapon IN ({_GUNS}) GROUP BY ALL),
    g3 AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id, role ORDER BY c DESC, weapon) AS i, sum(c) OVER (PARTITION BY match_id, player_id) AS read FROM gu),
    gt AS (SELECT match_id, player_id, role, CAST(any_value(read) AS BIGINT) AS read, string_agg(weapon || ' x' || c, ', ' ORDER BY i) FILTER (i <= 3) AS guns FROM g3 GROUP BY ALL)
    SELECT match_id, rs.player_id, 'Rival' AS role, 'Traded knocks with ' || o.ign || ': knocked ' || o.ign || ' ' || knocked || ' time' || {_S.format('knocked')} || ', was knocked by ' || o.ign || ' ' || knocked_by || ' time' || {_S.format('knocked_by')} || '.' AS detail
      FROM rs JOIN pl o ON o.player_id = rs.opponent_id
    UNION ALL SELECT dm.match_id, dm.player_id, 'Dominating', 'Knocked ' || o.ign || ' ' || n || ' time' || {_S.format('n')} || ' (' || share || '% of the ' || downs || ' times ' || o.ign || ' was knocked)' || CASE WHEN back > 0 THEN '; ' || o.ign || ' knocked back ' || back || '.' ELSE '; never knocked back.' END
      FROM dm JOIN pl o ON o.player_id = dm.opponent_id JOIN dn ON dn.match_id = dm.match_id AND dn.victim_id = dm.opponent_id
    UNION ALL SELECT match_id, player_id, role, n || CASE role WHEN 'Grenadier' THEN ' grenade knock' WHEN 'Driver' THEN ' car knock' ELSE ' Molotov knock' END || {_S.format('n')} || CASE WHEN joint THEN ' (joint most)' ELSE ' (most in the match)' END
      || CASE role WHEN 'Driver' THEN ', credited to the driver' ELSE '' END || '.' FROM tl
    UNION ALL SELECT match_id, player_id, role, n || ' knocks with ' || CASE role WHEN 'AR player' THEN 'an AR' WHEN 'SMG player' THEN 'an SMG' WHEN 'LMG player' THEN 'an LMG' WHEN 'Sniper player' THEN 'a sniper rifle' ELSE 'a shotgun' END
      || ', ' || share || '% of their ' || read || ' with a gun read (' || guns || ').' FROM wl JOIN gt USING (match_id, player_id, role)
    UNION ALL SELECT match_id, player_id, 'Clutch', 'Round ' || round_no || ': knocked all ' || enemies || ' remaining enemies' || CASE WHEN own_alive IS NULL THEN '' ELSE ' (' || own_alive || ' alive against ' || enemies || ')' END || '.'
      || CASE WHEN rounds > 1 THEN ' Also in ' || (rounds - 1) || ' other round' || {_S.format('(rounds - 1)')} || '.' ELSE '' END FROM cl"""
SELECTS["basis_text"] = SELECTS["knock_basis"].replace("SELECT e.match_id, (SELECT count(*)", """SELECT match_id, CASE WHEN source = 'rows' THEN 'Based on ' || knocks_used || ' of ' || knocks_seen || ' knock rows seen (the end-of-match board was not read, so the true total is unknown).'
    WHEN source = 'board_partial' THEN 'Based on ' || knocks_used || ' knock rows with both names read. The end-of-match board was only partly read (some players or Knock Outs cells missing), so its total of ' || knocks_seen || ' is a lower bound.'
    WHEN knocks_used > knocks_seen THEN 'Based on ' || knocks_used || ' knock rows with both names read; the end-of-match board counts ' || knocks_seen || ' Knock Outs, so a few rows may be repeats or misreads.'
    ELSE 'Based on ' || knocks_used || ' of ' || knocks_seen || ' knocks read (' || knocks_seen || ' = Knock Outs on the end-of-match board).' END AS basis FROM (SELECT e.match_id, (SELECT count(*)""", 1) + ")"

_IN_RANGE = "substr(recorded_at, 1, 10) BETWEEN '2024-01-03' AND '2024-01-20'"
SELECTS["export_player_totals"] = SELECTS["range_player_totals"]
SELECTS["export_player_per_match"] = f"SELECT match_id, player_id, eliminations, knocks, deaths FROM pm WHERE {_IN_RANGE}"
SELECTS["export_match_players"] = SELECTS["player_knock_lines"]
SELECTS["export_match_head_to_head"] = SELECTS["head_to_head"]
SELECTS["export_match_highlights"] = SELECTS["role_order"]
DIM_SELECTS["export_match_events"] = DIM_SELECTS["v_events"]
DIM_SELECTS["export_match_scoreboard"] = DIM_SELECTS["board_vs_feed"]
DIM_SELECTS["export_matches"] = f"SELECT match_id, recorded_at, eliminations, to_review, players FROM ({DIM_SELECTS['match_list']}) WHERE {_IN_RANGE}"
DIM_SELECTS["delete_match_children"] = "SELECT match_id, player_id FROM mp WHERE match_id NOT IN (SELECT match_id FROM ma WHERE match_id % 5 = 0)"
DIM_SELECTS["delete_match_boards"] = "SELECT match_id, round_no, player_id, stat_name, value FROM bo WHERE match_id NOT IN (SELECT match_id FROM ma WHERE match_id % 5 = 0)"

_UNSEEN = f""", bk AS (SELECT match_id, start_ms AS t, kind, coalesce(lag(end_ms) OVER (PARTITION BY match_id ORDER BY start_ms), 0) AS f FROM ({READ_SELECTS['board_sessions']})),
    mi AS (SELECT match_id, coalesce((SELECT max(t_ms) FROM cc WHERE cc.match_id = bk.match_id AND is_reset AND t_ms >= f AND t_ms < t), f) AS s, t AS e FROM bk
           WHERE kind = 'round' AND NOT EXISTS (SELECT 1 FROM ro WHERE ro.match_id = bk.match_id AND ro.start_ms >= f AND ro.start_ms < t)),
    mn AS (SELECT match_id, s, e, coalesce((SELECT max(round_no) FROM ro WHERE ro.match_id = mi.match_id AND ro.start_ms <= mi.s), 0) + (SELECT count(*) FROM mi o WHERE o.match_id = mi.match_id AND o.s <= mi.s) AS no FROM mi)
"""
#: The number of a row by its time: inside an unseen round its number, else the old one and the unseen rounds before it.
_MOVED = """CASE WHEN (SELECT max(s) FROM mn WHERE mn.match_id = x.match_id AND s <= x.at) > coalesce((SELECT max(start_ms) FROM ro WHERE ro.match_id = x.match_id AND start_ms <= x.at), -1)
    THEN (SELECT arg_max(no, s) FROM mn WHERE mn.match_id = x.match_id AND s <= x.at) ELSE x.round_no + (SELECT count(*) FROM mn WHERE mn.match_id = x.match_id AND s <= x.at) END AS round_no"""
ROW_SELECTS |= {
    "missed_round_rounds": _UNSEEN + """SELECT match_id, round_no + (SELECT count(*) FROM mn WHERE mn.match_id = ro.match_id AND s < start_ms) AS round_no, start_ms, end_ms, false AS by_board, blue_score, red_score FROM ro
        UNION ALL SELECT match_id, no, s, e, true, NULL, NULL FROM mn""",
    "missed_round_events": f"{_UNSEEN} SELECT event_id, match_id, {_MOVED} FROM (SELECT *, feed_ms AS at FROM ev) x",
    "missed_round_deaths": f"""{_UNSEEN}, dt AS (SELECT match_id, t_ms, t_ms // 72000 + 1 AS round_no, t_ms AS at, unnest(range(1, deaths + 1)) AS n FROM cc WHERE deaths > 0)
        SELECT match_id, t_ms * 100 + n AS death_id, t_ms, {_MOVED} FROM dt x""",
}

def _nested(select: str) -> str:
    """A select of this module as a subquery, with the tables it defines for itself."""
    return f"(WITH {select.lstrip(', ')})" if select.lstrip().startswith(",") else f"({select})"


#: Greedy pairs, one step per record of a match: what is used so far, and the teams learnt, travel along as lists.
_GREEDY = f""", dl AS MATERIALIZED (SELECT match_id, t_ms * 100 + n AS id, t_ms AS t, t_ms // 72000 + 1 AS r FROM (SELECT match_id, t_ms, unnest(range(1, deaths + 1)) AS n FROM cc WHERE deaths > 0)),
    dls AS MATERIALIZED (SELECT match_id, list(struct_pack(id := id, t := t) ORDER BY t, id) AS ds FROM dl GROUP BY match_id),
    gs AS MATERIALIZED (SELECT match_id, t_ms * 1000 + slot % 15 AS slot_id, t_ms AS h, row_number() OVER (PARTITION BY match_id ORDER BY t_ms, t_ms * 1000 + slot % 15) AS i FROM {_nested(ROW_SELECTS['slot_debounce'])}),
    tm(match_id, i, used, slot_id, id) AS (SELECT match_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM dls
        UNION ALL SELECT match_id, i, CASE WHEN id IS NULL THEN used ELSE list_append(used, id) END, slot_id, id FROM (
            SELECT tm.match_id, gs.i, tm.used, gs.slot_id, list_filter(ds, lambda d: NOT list_contains(tm.used, d.id) AND h - d.t BETWEEN -500 AND 1500)[1].id AS id
            FROM tm JOIN gs ON gs.match_id = tm.match_id AND gs.i = tm.i + 1 JOIN dls ON dls.match_id = tm.match_id)),
    td AS MATERIALIZED (SELECT match_id, id, slot_id, CASE WHEN slot_id % 1000 < 8 THEN 'blue' ELSE 'red' END AS team FROM tm WHERE id IS NOT NULL),
    dr AS MATERIALIZED (SELECT dl.match_id, r, list(struct_pack(id := dl.id, t := t, team := team) ORDER BY t, dl.id) AS ds FROM dl LEFT JOIN td ON td.match_id = dl.match_id AND td.id = dl.id GROUP BY dl.match_id, r),
    er AS MATERIALIZED (SELECT match_id, ev.event_id, feed_ms AS f, victim_id AS v, killer_id IS NOT NULL OR victim_id IS NOT NULL AS named, late, found_round AS r,
               row_number() OVER (PARTITION BY match_id ORDER BY feed_ms, ev.event_id) AS i FROM ev JOIN {_nested(READ_SELECTS['late_row_round'])} USING (event_id) WHERE event_type IN ('kill', 'eliminated_knocked')),
    pa(match_id, i, used, teams, event_id, id, t) AS (
        SELECT DISTINCT match_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS STRUCT(v BIGINT, team VARCHAR)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM er
        UNION ALL SELECT match_id, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.id) END,
            CASE WHEN pick.team IS NOT NULL AND v IS NOT NULL AND team IS NULL THEN list_append(teams, struct_pack(v := v, team := pick.team)) ELSE teams END, event_id, pick.id, pick.t FROM (
            SELECT *, CASE WHEN f - fits[1].t <= 3500 THEN fits[1] ELSE coalesce(list_filter(fits, lambda d: d.t = list_max(list_transform(list_filter(fits, lambda e: f - e.t BETWEEN 0 AND 1500), lambda e: e.t)))[1],
                list_filter(fits, lambda d: d.t = list_max(list_transform(list_filter(fits, lambda e: f - e.t <= 1500), lambda e: e.t)))[1], fits[1]) END AS pick FROM (
            SELECT *, CASE WHEN named THEN list_filter(ds, lambda d: NOT list_contains(used, d.id) AND f - d.t BETWEEN -1000 AND CASE WHEN late THEN 25000 ELSE 12000 END AND (team IS NULL OR d.team IS NULL OR d.team = team)) END AS fits FROM (
            SELECT pa.match_id, er.i, used, teams, er.event_id, f, v, named, late, ds, list_filter(teams, lambda x: x.v = er.v)[1].team AS team
            FROM pa JOIN er ON er.match_id = pa.match_id AND er.i = pa.i + 1 LEFT JOIN dr ON dr.match_id = er.match_id AND dr.r = er.r)))),
    us0 AS MATERIALIZED (SELECT match_id, arg_max(used, i) AS used FROM pa GROUP BY match_id),
    re AS MATERIALIZED (SELECT er.match_id, er.event_id, f, r, row_number() OVER (PARTITION BY er.match_id ORDER BY f, er.event_id) AS i FROM er JOIN pa USING (event_id) WHERE pa.id IS NULL),
    se(match_id, i, used, event_id, id, t) AS (SELECT match_id, CAST(0 AS BIGINT), used, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM us0
        UNION ALL SELECT match_id, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.id) END, event_id, pick.id, pick.t FROM (
            SELECT se.match_id, re.i, used, re.event_id, list_filter(ds, lambda d: NOT list_contains(used, d.id) AND f - d.t BETWEEN -1000 AND 25000)[1] AS pick
            FROM se JOIN re ON re.match_id = se.match_id AND re.i = se.i + 1 LEFT JOIN dr ON dr.match_id = re.match_id AND dr.r = re.r)),
    pq AS MATERIALIZED (SELECT match_id, event_id, id, t, false AS settled FROM pa WHERE id IS NOT NULL UNION ALL SELECT match_id, event_id, id, t, true FROM se WHERE id IS NOT NULL)
"""
#: On top of ``BASE_READS``.
GREEDY_SELECTS: dict[str, str] = {
    "death_team": _GREEDY + "SELECT match_id, id AS death_id, slot_id FROM td",
    "align_elims": _GREEDY + "SELECT match_id, event_id, id AS death_id, t AS t_ms, settled FROM pq",
    "settle_elims": _GREEDY + "SELECT event_id, 'NO_DROP' AS flag FROM er WHERE event_id NOT IN (SELECT event_id FROM pq)",
    "unclaimed_deaths": _GREEDY + """SELECT dl.match_id, dl.id AS death_id, r AS round_no, dl.t AS true_ms, 'kill' AS event_type, CAST(NULL AS BIGINT) AS killer_id, CAST(NULL AS BIGINT) AS victim_id, team AS victim_team, 'NO_FEED_ROW' AS flag
        FROM dl LEFT JOIN td ON td.match_id = dl.match_id AND td.id = dl.id WHERE (dl.match_id, dl.id) NOT IN (SELECT (match_id, id) FROM pq)""",
}
GREEDY_SELECTS["stream_align"] = GREEDY_SELECTS["align_elims"]

#: Matches after the imports, with the number they have then.
_HISTORY = """, hi AS (SELECT match_id, CASE WHEN match_id % 6 = 0 THEN match_id + 1000000 ELSE match_id END AS id, match_id % 6 = 0 AS anew, match_id % 2 <> 0 AS second, source_file, recorded_at, CASE WHEN match_id % 3 <> 0 THEN status END AS status
        FROM ma WHERE match_id % 2 = 0 OR match_id % 5 = 0),
    he AS (SELECT event_id, ev.match_id, id, CASE WHEN second THEN 'AGAIN' ELSE flag END AS flag FROM ev JOIN hi ON hi.match_id = ev.match_id WHERE NOT anew OR event_id % 2 = 0)
"""
DIM_SELECTS |= {
    "ingest_history_matches": _HISTORY + "SELECT id AS match_id, source_file, recorded_at, coalesce(status, CASE WHEN match_id IN (SELECT match_id FROM he WHERE flag IS NOT NULL) THEN 'needs_review' ELSE 'processed' END) AS status FROM hi",
    "ingest_history_events": _HISTORY + "SELECT event_id, id AS match_id, flag FROM he",
    "ingest_history_players": _HISTORY + "SELECT id AS match_id, player_id, team FROM mp JOIN hi ON hi.match_id = mp.match_id",
}

#: New players: the smallest of the new names that are alike, numbered in order of a part of their hash.
_ADMIT = f""", nr AS (SELECT name FROM nm UNION ALL SELECT 'GHOST _' || player_id FROM pl WHERE player_id % 14 = 2 UNION ALL SELECT 'fresh_' || player_id FROM pl WHERE player_id % 20 = 1),
    rs0 AS (SELECT * FROM {_RESOLVE.format('nr')}),
    nw AS (SELECT min(name) AS ign, {_NORM.format('name')} AS norm FROM rs0 WHERE tier = 'new' GROUP BY norm),
    nn AS (SELECT ign, norm, (SELECT max(player_id) FROM pl) + row_number() OVER (ORDER BY md5(ign)[1:3], ign) AS player_id FROM nw),
    rn AS (SELECT name, coalesce(rs0.player_id, nn.player_id) AS player_id, tier, tier = 'norm' OR (tier = 'new' AND name <> nn.ign) AS also FROM rs0 LEFT JOIN nn ON tier = 'new' AND nn.norm = {_NORM.format('name')})
"""
_RENAMED = """, im AS (SELECT player_id AS o, player_id - 1 AS n FROM pl WHERE player_id % 15 = 14 AND player_id - 1 IN (SELECT player_id FROM pl)),
    to_id AS (SELECT player_id, coalesce((SELECT n FROM im WHERE o = player_id), player_id) AS id FROM pl)
"""
_FAULTY = """, fe0 AS (SELECT * REPLACE (CASE WHEN event_id % 40 = 0 THEN 'knocked' ELSE event_type END AS event_type, CASE WHEN event_id % 60 = 0 THEN killer_id + 1000000 ELSE killer_id END AS killer_id,
        CASE WHEN event_id % 70 = 0 THEN NULL WHEN event_id % 71 = 0 THEN -1 ELSE match_id END AS match_id) FROM ev),
    fe AS (SELECT * FROM fe0 UNION ALL SELECT * FROM fe0 WHERE event_id % 50 = 0),
    fm0 AS (SELECT match_id, source_file, recorded_at, CASE WHEN match_id % 6 = 0 THEN 'done' WHEN match_id % 10 = 3 THEN NULL ELSE status END AS status FROM ma),
    fm AS (SELECT * FROM fm0 UNION ALL SELECT match_id + 5000000, source_file, recorded_at, status FROM fm0 WHERE match_id % 8 = 0),
    fp AS (SELECT player_id, ign FROM pl UNION ALL SELECT player_id + 7000000, ign FROM pl WHERE player_id % 30 = 7),
    fa AS (SELECT alias, player_id FROM al UNION ALL SELECT alias, -5 FROM al WHERE player_id % 9 = 0),
    fq AS (SELECT match_id, player_id FROM mp UNION ALL SELECT match_id, player_id FROM mp WHERE player_id % 44 = 0),
    fr AS (SELECT match_id, round_no FROM ro UNION ALL SELECT match_id, round_no FROM ro WHERE round_no = 1 AND match_id % 4 = 0),
    fs AS (SELECT match_id, round_no, player_id, stat_name FROM bo UNION ALL SELECT match_id, round_no, player_id, stat_name FROM bo WHERE player_id % 33 = 0 AND stat_name = 'knock_outs')
"""
DIM_SELECTS |= {
    "admit_players_players": _ADMIT + "SELECT player_id, ign, nickname FROM pl UNION ALL SELECT player_id, ign, NULL FROM nn",
    "admit_players_aliases": _ADMIT + "SELECT alias, player_id FROM al UNION ALL SELECT name, player_id FROM rn WHERE also",
    "admit_players_names": _ADMIT + "SELECT name, player_id, tier FROM rn",
    "rename_players_players": _RENAMED + "SELECT player_id, CASE player_id % 15 WHEN 13 THEN 'champ_' || player_id WHEN 14 THEN 'player_' || (player_id - 1) ELSE ign END AS ign, nickname FROM pl WHERE player_id NOT IN (SELECT o FROM im)",
    "rename_players_aliases": _RENAMED + "SELECT alias, id AS player_id FROM al JOIN to_id USING (player_id) UNION ALL SELECT ign, id FROM pl JOIN to_id USING (player_id) WHERE player_id % 15 >= 13",
    "rename_players_events": _RENAMED + "SELECT event_id, k.id AS killer_id, v.id AS victim_id FROM ev LEFT JOIN to_id k ON k.player_id = killer_id LEFT JOIN to_id v ON v.player_id = victim_id",
    "rename_players_boards": _RENAMED + """SELECT match_id, round_no, id AS player_id, stat_name, value FROM bo JOIN to_id USING (player_id)
        QUALIFY row_number() OVER (PARTITION BY match_id, round_no, stat_name, id ORDER BY player_id) = 1""",
    "rename_players_members": _RENAMED + "SELECT match_id, id AS player_id, team, slot FROM mp JOIN to_id USING (player_id) QUALIFY row_number() OVER (PARTITION BY match_id, id ORDER BY player_id) = 1",
    "rename_players_refused": "SELECT 'player_' || player_id AS old, 'loop_' || player_id AS new, 'circle' AS reason FROM pl WHERE player_id % 15 = 5 UNION ALL SELECT 'loop_' || player_id, 'player_' || player_id, 'circle' FROM pl WHERE player_id % 15 = 5 UNION ALL SELECT 'nobody_' || player_id, 'player_' || player_id, 'unknown' FROM pl WHERE player_id % 15 = 2",
    "read_tables": _FAULTY + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {c}" for n, c in (("matches", "fm"), ("players", "fp"), ("player_aliases", "fa"), ("match_players", "fq"), ("rounds", "fr"), ("events", "fe"), ("scoreboard_stats", "fs"))),
    "read_tables_broken": _FAULTY + """SELECT 'events' AS "table", CAST(event_id AS VARCHAR) AS key, 'no match_id' AS reason FROM fe WHERE match_id IS NULL UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 'unknown event_type' FROM fe WHERE event_type = 'knocked'
        UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 'event_id not unique' FROM fe GROUP BY event_id HAVING count(*) > 1 UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 'match_id is not in matches' FROM fe WHERE match_id = -1
        UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 'killer_id is not in players' FROM fe WHERE killer_id NOT IN (SELECT player_id FROM fp)
        UNION ALL SELECT 'matches', CAST(match_id AS VARCHAR), 'no status' FROM fm WHERE status IS NULL UNION ALL SELECT 'matches', CAST(match_id AS VARCHAR), 'unknown status' FROM fm WHERE status = 'done'
        UNION ALL SELECT 'matches', source_file || '/' || recorded_at, 'source_file and recorded_at not unique' FROM fm GROUP BY source_file, recorded_at HAVING count(*) > 1
        UNION ALL SELECT 'players', ign, 'ign not unique' FROM fp GROUP BY ign HAVING count(*) > 1 UNION ALL SELECT 'player_aliases', alias, 'alias not unique' FROM fa GROUP BY alias HAVING count(*) > 1
        UNION ALL SELECT 'player_aliases', alias, 'player_id is not in players' FROM fa WHERE player_id = -5
        UNION ALL SELECT 'match_players', match_id || '/' || player_id, 'match_id and player_id not unique' FROM fq GROUP BY match_id, player_id HAVING count(*) > 1
        UNION ALL SELECT 'rounds', match_id || '/' || round_no, 'match_id and round_no not unique' FROM fr GROUP BY match_id, round_no HAVING count(*) > 1
        UNION ALL SELECT 'scoreboard_stats', match_id || '/' || coalesce(CAST(round_no AS VARCHAR), '-') || '/' || player_id || '/' || stat_name, 'match_id and round_no and player_id and stat_name not unique' FROM fs GROUP BY match_id, round_no, player_id, stat_name HAVING count(*) > 1""",
}

_OLD = """, om AS (SELECT match_id FROM ma WHERE pipeline_version LIKE '0.1%'), oe AS (SELECT * FROM ev WHERE match_id NOT IN (SELECT match_id FROM om)), ob AS (SELECT * FROM bo WHERE match_id NOT IN (SELECT match_id FROM om)),
    oq AS (SELECT * FROM mp WHERE match_id NOT IN (SELECT match_id FROM om)), op AS (SELECT * FROM pl WHERE player_id IN (SELECT killer_id FROM oe UNION SELECT victim_id FROM oe UNION SELECT player_id FROM ob UNION SELECT player_id FROM oq))
"""
DIM_SELECTS |= {
    "drop_old_members": _OLD + "SELECT match_id, player_id FROM oq", "drop_old_boards": _OLD + "SELECT match_id, round_no, player_id, stat_name, value FROM ob", "drop_old_rounds": _OLD + "SELECT match_id, round_no FROM ro WHERE match_id NOT IN (SELECT match_id FROM om)",
    "drop_old_players": _OLD + "SELECT * FROM op", "drop_old_aliases": _OLD + "SELECT alias, player_id FROM al WHERE player_id IN (SELECT player_id FROM op)",
    "upsert_nicknames": "SELECT player_id, ign, coalesce(nickname, CASE WHEN player_id % 3 = 1 THEN CASE WHEN player_id % 2 = 0 THEN 'then_' ELSE 'first_' END || player_id END) AS nickname FROM pl",
    "row_weapon": """, gi AS (SELECT event_id, weapon, event_id % 9 = 0 OR event_id % 7 = 0 AS knock, CASE WHEN weapon IS NOT NULL AND weapon <> 'Zone' THEN weapon WHEN event_id % 3 = 0 THEN 'Car' END AS gun FROM ev)
        SELECT event_id, CASE WHEN knock THEN CASE WHEN event_id % 4 <> 0 THEN weapon END WHEN 70 + (event_id + length('weapon_' || gun)) % 25 >= 80 THEN gun END AS weapon FROM gi""",
}
READ_SELECTS["skipped_summary"] = f""", sp AS (SELECT match_id, no, min(t_ms) AS a, max(t_ms) AS z FROM {_islands('sc', 'match_id', 60000)} GROUP BY match_id, no)
    SELECT match_id, count(*) AS spans, CAST(sum(z - a) AS BIGINT) AS skipped_ms, count(*) = 1 AND max(z) >= (SELECT max(feed_ms) FROM ev WHERE ev.match_id = sp.match_id) - 1000 AS reaches_end FROM sp GROUP BY match_id"""

#: Letters and digits, and the class that each is folded to.
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(regexp_replace(coalesce({{0}}, ''), '[^A-Za-z0-9]', '', 'g'), '{_ALNUM}', '{''.join(folded(c) for c in _ALNUM)}')"
#: Names of parts as readings and rosters (``sources.readings``).
_READS = """WITH RECURSIVE pn AS (SELECT p_partkey, p_name, p_partkey // 40 AS room FROM part),
    nr AS (SELECT p_partkey AS read_id, room, CASE p_partkey % 3 WHEN 0 THEN translate(p_name, 'ois', '015') WHEN 1 THEN translate(substr(p_name, 2), 'o', '0') ELSE translate(substr(p_name, 3, length(p_name) - 3), 'e', 'x') END AS raw FROM pn)
"""
#: Similarity of a and b in pairs pq(x, a, b): the longest run they share (the first of equals), then the same to its left and to its right.
_RATIO = """, sg(x, a, b, n) AS (SELECT x, a, b, 0 FROM pq UNION ALL SELECT x, s.a, s.b, s.n FROM (
        SELECT x, unnest([struct_pack(a := a[:i - 1], b := b[:strpos(b, a[i:i + k - 1]) - 1], n := k), struct_pack(a := a[i + k:], b := b[strpos(b, a[i:i + k - 1]) + k:], n := 0)]) AS s FROM (
        SELECT x, a, b, -best.k AS k, best.i AS i FROM (SELECT x, a, b, min(struct_pack(k := -k, i := i)) AS best FROM (
            SELECT x, a, b, i, unnest(range(1, least(length(a) - i + 1, length(b)) + 1)) AS k FROM (SELECT x, a, b, unnest(range(1, length(a) + 1)) AS i FROM sg WHERE a <> '' AND b <> '')) WHERE contains(b, a[i:i + k - 1]) GROUP BY x, a, b)))),
    ra AS (SELECT pq.x, 2.0 * m / (length(a) + length(b)) AS score FROM pq JOIN (SELECT x, sum(n) AS m FROM sg GROUP BY x) USING (x))
"""
#: Without the tables of matches.
NAME_SELECTS: dict[str, str] = {
    "roster_match": f"""{_READS}, rr AS (SELECT DISTINCT room, raw, {_FOLD.format('raw')} AS form FROM nr), rk AS (SELECT DISTINCT room, p_name AS name, {_FOLD.format('p_name')} AS form FROM pn),
        pq AS (SELECT row_number() OVER () AS x, rr.room, raw, name, rr.form AS a, rk.form AS b FROM rr JOIN rk USING (room) WHERE rr.form <> '')
        {_RATIO}, rd AS (SELECT room, raw, name, score, row_number() OVER w AS place, lead(score) OVER w AS second FROM pq JOIN ra USING (x) WINDOW w AS (PARTITION BY room, raw ORDER BY score DESC, name DESC))
        SELECT rr.room AS roster_id, rr.raw, name, coalesce(round(score, 2), 0.0) AS score FROM rr LEFT JOIN rd ON rd.room = rr.room AND rd.raw = rr.raw AND place = 1 AND score >= 0.55 AND (second IS NULL OR score - second >= 0.15)""",
    "roster_collisions": f"{_READS}SELECT {_FOLD.format('raw')} AS folded, string_agg(raw, '|' ORDER BY raw) AS names FROM (SELECT DISTINCT raw FROM nr) GROUP BY 1 HAVING count(*) > 1",
    "fold_name": f"{_READS}SELECT read_id, raw, {_FOLD.format('raw')} AS folded FROM nr",
    "ratio": f"""{_READS}, pq AS (SELECT read_id AS x, {_FOLD.format('raw')} AS a, {_FOLD.format('p_name')} AS b FROM nr JOIN pn ON p_partkey = read_id)
        {_RATIO} SELECT x AS read_id, a AS folded, b AS name_folded, score FROM pq JOIN ra USING (x)""",
    "row_names": f"""{_READS}, wl AS (SELECT room, read_id, [w FOR w IN [regexp_replace(v, '[^A-Za-z0-9]', '', 'g') FOR v IN regexp_split_to_array(translate(raw, ' ', '') || ' => ' || translate(reverse(raw), ' ', ''), '\\s+')] IF w <> ''] AS ws FROM nr),
        wo AS (SELECT room, read_id, unnest(ws) AS raw, unnest(range(len(ws))) AS spot FROM wl), rr AS (SELECT DISTINCT room, raw, {_FOLD.format('raw')} AS form FROM wo WHERE length(raw) >= 4),
        rk AS (SELECT DISTINCT room, translate(p_name, ' ', '') AS name FROM pn), pq AS (SELECT row_number() OVER () AS x, room, raw, name, form AS a, {_FOLD.format('name')} AS b FROM rr JOIN rk USING (room) WHERE form <> '')
        {_RATIO}, rd AS (SELECT room, raw, name, score, row_number() OVER w AS place, lead(score) OVER w AS second FROM pq JOIN ra USING (x) WINDOW w AS (PARTITION BY room, raw ORDER BY score DESC, name DESC)),
        fo AS (SELECT read_id, max(spot) AS z, min(struct_pack(spot := spot, name := name)) FILTER (name IS NOT NULL) AS f, max(struct_pack(spot := spot, name := name)) FILTER (name IS NOT NULL) AS l
            FROM wo LEFT JOIN (SELECT room, raw, name FROM rd WHERE place = 1 AND score >= 0.55 AND (second IS NULL OR score - second >= 0.15)) USING (room, raw) GROUP BY read_id)
        SELECT nr.read_id, CASE WHEN f.spot <> l.spot THEN CASE WHEN f.name <> l.name THEN f.name END WHEN f.spot = 0 AND z > 0 THEN f.name END AS killer,
            CASE WHEN f.spot <> l.spot THEN CASE WHEN f.name <> l.name THEN l.name END WHEN f.spot = z AND z > 0 THEN f.name END AS victim FROM nr LEFT JOIN fo USING (read_id)""",
    "name_consensus": f"""{_READS}, nc AS (SELECT read_id // 5 AS key, regexp_replace(trim(raw), '[^\\p{{L}}\\p{{N}}_.\\-]', '', 'g') AS raw, count(*) AS n FROM nr GROUP BY ALL),
        nt AS (SELECT *, {_FOLD.format('raw')} AS form, sum(n) OVER (PARTITION BY key) AS total FROM nc WHERE raw <> ''),
        pq AS (SELECT row_number() OVER () AS x, p.key, p.raw, q.n, p.form AS a, q.form AS b FROM nt p JOIN nt q USING (key))
        {_RATIO}, li AS (SELECT key, raw, round(sum(n * score), 9) AS alike FROM pq JOIN ra USING (x) GROUP BY key, raw),
        pk AS (SELECT *, n >= 2 AND n / total >= 0.4 AS agreed FROM nt JOIN li USING (key, raw) QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN n >= 2 AND n / total >= 0.4 THEN n ELSE 0 END DESC, alike DESC, raw) = 1)
        SELECT key, coalesce(raw, '') AS name, coalesce(round(n / total, 2), 0.0) AS share FROM (SELECT DISTINCT key FROM nc) LEFT JOIN pk USING (key)""",
}
