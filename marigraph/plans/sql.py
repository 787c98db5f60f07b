"""DuckDB SQL for the results of the catalog's queries, written independently of the operators."""

from __future__ import annotations

from ..functions import astro
from ..functions.geo import CANADA_ZONES, EARTH_KM, HOUR_ZONES, MILES_PER_KM, STATE_ZONES, WORD_ZONES
from ..functions.text import STATES
from ..operators.calendar import MOON
from ..operators.harmonics import CONSTITUENTS

STATION_CONSTITUENTS = ("M2", "S2", "N2", "K1", "O1")
NOW = "2024-01-10 00:00:00"
SEARCH_TERMS = ["ring", "brand#1"]
AUTOCOMPLETE_TERM = "gear"


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def haversine(a: str, b: str, c: str, d: str, miles: bool = False) -> str:
    root = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"(2 * {_d(EARTH_KM)} * asin(sqrt(least(1.0::DOUBLE, {root}))){f' * {_d(MILES_PER_KM)}' if miles else ''})"


def place(key: str) -> str:
    return f"(({key}) * 7919) % 16000 / 100.0::DOUBLE - 80.0::DOUBLE AS lat, (({key}) * 104729) % 36000 / 100.0::DOUBLE - 180.0::DOUBLE AS lon"


SUP = f"""sup AS (SELECT s_suppkey AS id, s_suppkey AS ord, s_name AS name, {place('s_suppkey')},
  ['noaa', 'chs', 'xtide', 'ticon', 'other'][CAST(s_suppkey % 5 AS INT) + 1] AS provider,
  CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 3 AS DOUBLE) * 10 END AS depth, 'Region ' || CAST(s_suppkey % 11 AS VARCHAR) AS region FROM supplier)"""
CUS = f"cus AS (SELECT c_custkey AS id, c_name AS name, {place('c_custkey')} FROM customer)"
SER = "ser AS (SELECT user_id AS key, ts, value, event_type AS type, event_id FROM events)"

# -- synthesis ------------------------------------------------------------------------------


def _args(ts: str, prefix: str) -> str:
    t = f"((epoch_us({ts}) - epoch_us(TIMESTAMP '{astro.EPOCH}')) / 1e6::DOUBLE)"
    c = f"({t} / {_d(astro.CENTURY_SECONDS)})"
    parts = [f"{_d(a)} + {_d(b)} * {c} + {_d(q)} * {c} * {c} + {_d(r)} * {c} * {c} * {c} AS {prefix}{k}" for k, (a, b, q, r) in astro.SERIES.items()]
    return ", ".join([*parts, f"({t} / 86400 * 360) - 360 * floor({t} / 86400) AS {prefix}tau"])


def _nodal(days: str) -> str:
    """CTEs down to ``nod``: day, name, speed, f, u, v0 for the days of a query."""
    rows = ", ".join(f"('{n}', [{', '.join(map(str, v))}], [{', '.join(map(str, u))}], {f}, {_d(s)})" for n, v, u, f, s in CONSTITUENTS)
    s, c = (lambda x: f"sin(radians({x}))"), (lambda x: f"cos(radians({x}))")
    w, i0 = _d(astro.OBLIQUITY), _d(astro.INCLINATION)
    return f"""days AS ({days}), con(name, v, u, formula, speed) AS (VALUES {rows}),
a1 AS (SELECT day, {_args("date_trunc('year', day)::TIMESTAMP", "a_")}, {_args("(day::TIMESTAMP + INTERVAL 12 HOUR)", "m_")} FROM days),
a2 AS (SELECT *, degrees(acos({c(w)} * {c(i0)} - {s(w)} * {s(i0)} * {c('m_n')})) AS i FROM a1),
a3 AS (SELECT *, degrees(asin({s(i0)} * {s('m_n')} / {s('i')})) AS nu FROM a2),
a4 AS (SELECT *, m_n - degrees(atan2({s(w)} * {s('m_n')} / {s('i')}, {c('m_n')} * {c('nu')} + {s('m_n')} * {s('nu')} * {c(w)})) AS xi,
  degrees(atan2({s('2 * i')} * {s('nu')}, {s('2 * i')} * {c('nu')} + 0.3347)) AS nu1,
  degrees(atan2(pow({s('i')}, 2) * {s('2 * nu')}, pow({s('i')}, 2) * {c('2 * nu')} + 0.0727)) AS nu2 FROM a3),
a5 AS (SELECT *, m_p - xi AS pp, tan(radians(i / 2)) AS tn FROM a4),
a6 AS (SELECT *, degrees(atan2(0.483 * {s('pp')}, {c('pp')})) AS q, 1 / sqrt(2.31 + 1.435 * {c('2 * pp')}) AS qa,
  degrees(atan2({s('2 * pp')}, 1 / (6 * tn * tn) - {c('2 * pp')})) AS r, 1 / sqrt(1 - 12 * tn * tn * {c('2 * pp')} + 36 * pow(tn, 4)) AS ra FROM a5),
nod AS (SELECT day, name, speed, CASE formula
  WHEN 75 THEN {s('i')} * pow({c('i / 2')}, 2) / 0.38 WHEN 78 THEN pow({c('i / 2')}, 4) / 0.9154
  WHEN 206 THEN {s('i')} * pow({c('i / 2')}, 2) / 0.38 / qa WHEN 215 THEN pow({c('i / 2')}, 4) / 0.9154 / ra
  WHEN 227 THEN sqrt(0.8965 * pow({s('2 * i')}, 2) + 0.6001 * {s('2 * i')} * {c('nu')} + 0.1006)
  WHEN 235 THEN sqrt(19.0444 * pow({s('i')}, 4) + 2.7702 * pow({s('i')}, 2) * {c('2 * nu')} + 0.0981) ELSE 1.0::DOUBLE END AS f,
  u[1] * xi + u[2] * nu + u[3] * nu1 + u[4] * nu2 + u[5] * q + u[6] * r + u[7] * (pp - q) AS u,
  v[1] * a_tau + v[2] * a_s + v[3] * a_h + v[4] * a_p + v[5] * a_p1 + v[6] AS v0 FROM a6 CROSS JOIN con)"""


def nodal_factors() -> str:
    turn = lambda x: f"round(fmod(round({x} - 360 * floor({x} / 360), 5), 360.0::DOUBLE), 5)"
    days = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders"
    return f"WITH {_nodal(days)} SELECT day, name, round(f, 6) AS f, {turn('u')} AS u, {turn('v0')} AS v0 FROM nod"


def predictions(step: int, begin: str, until: str, result: str, bare: tuple[str, float] | None = None) -> str:
    """Dense heights ``p`` (station_id, ts, height) of the nations, and a result from them; ``bare`` is a further constituent (name, speed) without factors."""
    parts = " UNION ALL ".join(
        f"SELECT n_nationkey AS k, '{name}' AS name, (n_nationkey * 37 + {i * 11}) % 40 / 10.0::DOUBLE + 0.1::DOUBLE AS amp, CAST((n_nationkey * 53 + {i * 71}) % 360 AS DOUBLE) AS phase FROM nation"
        for i, name in enumerate(STATION_CONSTITUENTS)
    )
    if bare:
        parts += f" UNION ALL SELECT n_nationkey, '{bare[0]}', n_nationkey % 7 / 10.0::DOUBLE + 0.2::DOUBLE, CAST(n_nationkey * 19 % 360 AS DOUBLE) FROM nation"
    speed = f"coalesce(nod.speed, {bare[1]!r}::DOUBLE)" if bare else "nod.speed"
    grid = f"SELECT unnest(generate_series(TIMESTAMP '{begin}', TIMESTAMP '{until}', INTERVAL {step} SECOND)) AS ts"
    hours = "((epoch_us(g.ts) - epoch_us(date_trunc('year', g.ts)::TIMESTAMP)) / 3600e6::DOUBLE)"
    return f"""WITH grid AS ({grid}), {_nodal("SELECT DISTINCT CAST(ts AS DATE) AS day FROM grid")}, parts AS ({parts}),
p AS (SELECT CAST(parts.k AS BIGINT) AS station_id, g.ts, sum(coalesce(nod.f, 1) * parts.amp * cos(radians({speed} * {hours} + coalesce(nod.v0 + nod.u, 0) - parts.phase))) AS height
  FROM grid g CROSS JOIN parts LEFT JOIN nod ON nod.day = CAST(g.ts AS DATE) AND parts.name = nod.name GROUP BY ALL),
w AS (SELECT *, lag(height) OVER k AS a, lead(height) OVER k AS c, lag(ts) OVER k AS before FROM p WINDOW k AS (PARTITION BY station_id ORDER BY ts)),
x AS (SELECT station_id, CASE WHEN height > a THEN 'High' ELSE 'Low' END AS type,
  CAST(round((epoch_us(ts) + (a - c) / (2 * (a - 2 * height + c)) * (epoch_us(ts) - epoch_us(before))) / 1e6) AS BIGINT) AS second,
  height - (a - c) * (a - c) / (8 * (a - 2 * height + c)) AS height FROM w WHERE (height > a AND height > c) OR (height < a AND height < c))
{result}"""


NEXT_PEAKS = "SELECT station_id, type, min(second) AS second, round(arg_min(height, second), 3) AS height FROM x WHERE second > epoch_us(TIMESTAMP '2026-02-03 06:00:00') // 1000000 GROUP BY station_id, type"
DENSE_PEAKS = "SELECT station_id, type, second, round(height, 3) AS height FROM x WHERE second BETWEEN epoch_us(TIMESTAMP '2026-02-03 00:00:00') // 1000000 AND epoch_us(TIMESTAMP '2026-02-04 00:00:00') // 1000000"
CURRENTS = """SELECT station_id, CASE WHEN round(height, 3) > 0 THEN 'flood' ELSE 'ebb' END AS type, second, round(height, 3) AS velocity FROM x
UNION ALL SELECT station_id, 'slack', CAST(round((epoch_us(before) + (epoch_us(ts) - epoch_us(before)) * abs(a) / (abs(a) + abs(height))) / 1e6) AS BIGINT), 0.0::DOUBLE
FROM w WHERE (a > 0 AND height <= 0) OR (a < 0 AND height >= 0)"""

# -- series ---------------------------------------------------------------------------------

_NEIGHBOURS = f"WITH {SER}, n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS c, lag(ts) OVER w AS before FROM ser WINDOW w AS (PARTITION BY key ORDER BY ts))"
_PEAKS = "SELECT key, CASE WHEN value > a THEN 'High' ELSE 'Low' END AS type, ts, value AS height FROM n WHERE (value > a AND value > c) OR (value < a AND value < c)"


def extrema(refine: bool) -> str:
    if not refine:
        return f"{_NEIGHBOURS} {_PEAKS}"
    den = "(a - 2 * value + c)"
    return f"""{_NEIGHBOURS} SELECT key, CASE WHEN value > a THEN 'High' ELSE 'Low' END AS type,
  ts + to_microseconds(CAST(round(((a - c) / (2 * {den}) * ((epoch_us(ts) - epoch_us(before)) / 1e6)) * 1e6) AS BIGINT)) AS ts,
  round(value - (a - c) * (a - c) / (8 * {den}), 3) AS height FROM n WHERE (value > a AND value > c) OR (value < a AND value < c)"""


SUBORDINATE = f"""{_NEIGHBOURS}, pk AS ({_PEAKS}), sub AS (SELECT s_suppkey + 1000 AS station_id, s_suppkey % 40 + 1 AS ref_key, s_suppkey % 90 * 60 AS hs, -(s_suppkey % 60) * 60 AS ls,
  0.5::DOUBLE + s_suppkey % 10 / 10.0::DOUBLE AS hm, 1.0::DOUBLE - s_suppkey % 5 / 10.0::DOUBLE AS lm FROM supplier),
m AS (SELECT station_id, type, ts + to_seconds(CASE WHEN type = 'High' THEN hs ELSE ls END) AS ts, round(height * CASE WHEN type = 'High' THEN hm ELSE lm END, 3) AS height FROM sub JOIN pk ON pk.key = ref_key)
SELECT * FROM m WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-25'"""
CROSSINGS = f"""WITH {SER}, n AS (SELECT key, ts, value - 50.0::DOUBLE AS y, lag(value - 50.0::DOUBLE) OVER w AS a, lag(ts) OVER w AS before FROM ser WINDOW w AS (PARTITION BY key ORDER BY ts))
SELECT key, before + to_microseconds(CAST(round(((epoch_us(ts) - epoch_us(before)) / 1e6::DOUBLE * abs(a) / (abs(a) + abs(y))) * 1e6) AS BIGINT)) AS ts FROM n WHERE (a > 0 AND y <= 0) OR (a < 0 AND y >= 0)"""
LAG_TYPES = f"{_NEIGHBOURS} SELECT key, ts, value, event_id, CASE WHEN value >= coalesce(a, c) THEN 'High' WHEN value < coalesce(a, c) THEN 'Low' END AS type FROM n"


def next_events(extra: str = "") -> str:
    return f"WITH {SER} SELECT key, type, min(ts) AS ts, arg_min(value, (ts, value)) AS value FROM ser WHERE ts > TIMESTAMP '{NOW}' {extra} GROUP BY key, type"


def matches(result: str) -> str:
    return f"""WITH {SER}, h AS (SELECT key % 20 AS key, CASE WHEN value >= 50 THEN 'High' ELSE 'Low' END AS type, ts, value, event_id FROM ser),
m AS (SELECT l.key, l.type, l.ts AS l_ts, l.value AS l_value, r.ts AS r_ts, r.value AS r_value, (epoch_us(r.ts) - epoch_us(l.ts)) / 1e6::DOUBLE AS seconds
  FROM (SELECT DISTINCT key, type, ts, value FROM h WHERE event_id % 2 = 0) l JOIN h r ON r.event_id % 2 = 1 AND r.key = l.key AND r.type = l.type AND abs(epoch_us(r.ts) - epoch_us(l.ts)) < 10800000000
  QUALIFY row_number() OVER (PARTITION BY l.key, l.type, l.ts, l.value ORDER BY r.ts, r.value) = 1),
st AS (SELECT key, count(*) AS n, round(avg(seconds), 1) AS mean_s, round(sqrt(avg(seconds * seconds)), 1) AS rms_s, max(abs(seconds)) AS max_s, round(avg(r_value - l_value), 3) AS mean_v,
  round(sqrt(avg((r_value - l_value) * (r_value - l_value))), 3) AS rms_v, round(max(abs(r_value - l_value)), 3) AS max_v FROM m GROUP BY key) {result}"""


ERROR_STATS = "SELECT * FROM st"
MACRO = """, pr AS (SELECT 'p' || CAST(key % 4 AS VARCHAR) AS provider, count(*) AS stations, round(avg(rms_s), 1) AS rms_s, round(avg(rms_v), 3) AS rms_v FROM st GROUP BY 1)
SELECT *, provider = (SELECT provider FROM pr ORDER BY rms_v, provider LIMIT 1) AS winner FROM pr"""


def time_text(s: str) -> str:
    m = f"CAST(round({s} / 60.0::DOUBLE) AS BIGINT)"
    sign = f"CASE WHEN {s} >= 0 THEN '+' ELSE '' END"
    return f"""CASE WHEN abs({s}) < 30 THEN '0min' WHEN abs({m}) >= 60 THEN {sign} || CAST(CAST(floor({m} / 60.0::DOUBLE) AS BIGINT) AS VARCHAR) || 'hr' ||
  CASE WHEN abs({m}) % 60 > 0 THEN CAST(abs({m}) % 60 AS VARCHAR) || 'min' ELSE '' END ELSE {sign} || CAST({m} AS VARCHAR) || 'min' END"""


def height_text(d: str, unit: str = "ft") -> str:
    return f"CASE WHEN abs({d}) < 0.05 THEN '0{unit}' ELSE CASE WHEN {d} >= 0 THEN '+' ELSE '' END || CAST({d} AS VARCHAR) || '{unit}' END"


_UPCOMING = f"up AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, type) AS idx FROM ({next_events()}))"
_COMPARE = f"""WITH {_UPCOMING}, o AS (SELECT key, idx, type, date_trunc('second', ts) AS ts, value FROM up WHERE key <> 1), p AS (SELECT idx AS p_idx, type, date_trunc('second', ts) AS p_ts, value AS p_value FROM up WHERE key = 1),
c AS (SELECT o.key, p_idx, o.type, (epoch_us(o.ts) - epoch_us(p_ts)) // 1000000 AS seconds, round(o.value - p_value, 2) AS raw_value FROM o JOIN p ON p.type = o.type
  QUALIFY row_number() OVER (PARTITION BY o.key, p_idx ORDER BY o.idx <> p_idx, o.idx) = 1),
d AS (SELECT key, CAST(p_idx AS INT) AS p_idx, type, CAST(seconds AS BIGINT) AS seconds, {time_text('seconds')} AS time, raw_value, 'ft' AS units FROM c)"""
COMPARE = f"{_COMPARE} SELECT * FROM d"
FIRST_DELTA = f"{_COMPARE} SELECT key, type, time, raw_value FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY raw_value IS NULL, p_idx) = 1"
VARIANCE = f"""WITH {_UPCOMING}, one AS (SELECT * FROM up WHERE idx = 1), p AS (SELECT ts AS p_ts, value AS p_value FROM one WHERE key = 1),
s AS (SELECT key, CAST(trunc((epoch_us(ts) - epoch_us(p_ts)) / 1e6::DOUBLE) AS BIGINT) AS s, round(value - p_value, 2) AS d FROM one CROSS JOIN p WHERE key <> 1)
SELECT key, {time_text('s')} AS time, {height_text('d')} AS height FROM s"""

# -- stations -------------------------------------------------------------------------------

_MILES = haversine("42.36::DOUBLE", "(-71.06)::DOUBLE", "lat", "lon", True)
RADIUS = f"WITH {CUS} SELECT id, name, round({_MILES}, 4) AS miles FROM cus WHERE {_MILES} <= 900"
_KM = haversine("c.lat", "c.lon", "s.lat", "s.lon")
PROXIMITY = f"WITH {SUP}, {CUS} SELECT c.id AS l_id, s.id AS r_id, round({_KM}, 4) AS km FROM cus c JOIN sup s ON {_KM} <= 350"
NEAREST_EXACT = f"WITH {SUP}, {CUS} SELECT c.id, s.region, round({_KM}, 4) AS km FROM cus c CROSS JOIN sup s QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY {_KM}, s.ord) = 1"


def _ring(reach: int) -> str:
    cell = lambda t, c: f"CAST(floor({t}.{c} / 10) AS BIGINT)"
    near = " AND ".join(f"abs({cell('s', c)} - {cell('c', c)}) <= {reach}" for c in ("lat", "lon"))
    return f"SELECT c.id, s.region, round({_KM}, 4) AS km FROM cus c JOIN sup s ON {near} QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY {_KM}, s.ord) = 1"


NEAREST_GRID = f"WITH {SUP}, {CUS}, a AS ({_ring(1)}), b AS ({_ring(2)}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)"
APPLY_REGIONS = f"""WITH {SUP}, {CUS}, m AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'United States' WHEN id % 9 <> 0 THEN region END AS region FROM sup)
SELECT c.id, coalesce(m.region, 'United States') AS region FROM cus c LEFT JOIN m ON m.id = c.id AND m.region <> 'United States'"""
FIRST_BOX = f"""WITH {SUP}, {CUS} SELECT c.id, (SELECT s.name FROM sup s WHERE abs(s.lat - c.lat) < 6 AND abs(s.lon - c.lon) < 6 ORDER BY s.ord LIMIT 1) AS name FROM cus c"""
LEADERS = f"""WITH RECURSIVE {SUP}, o AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM sup),
e AS (SELECT c.n AS n, s.n AS m FROM o c JOIN o s ON s.n < c.n AND {_KM} <= 2500),
r(n, leads) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT r.n + 1, CASE WHEN len(list_intersect(r.leads, coalesce((SELECT list(e.m) FROM e WHERE e.n = r.n + 1), CAST([] AS BIGINT[])))) > 0 THEN r.leads ELSE list_append(r.leads, r.n + 1) END FROM r WHERE r.n < (SELECT count(*) FROM o)),
l AS (SELECT unnest(leads) AS n FROM (SELECT leads FROM r ORDER BY n DESC LIMIT 1))
SELECT o.id, coalesce((SELECT x.id FROM o x WHERE x.n = (SELECT min(e.m) FROM e WHERE e.n = o.n AND e.m IN (SELECT n FROM l)) AND o.n NOT IN (SELECT n FROM l)), o.id) AS leader FROM o"""
GROUPS = f"""WITH {SUP}, g AS (SELECT *, id % 17 AS leader, CASE provider WHEN 'noaa' THEN 0 WHEN 'chs' THEN 1 WHEN 'xtide' THEN 2 WHEN 'ticon' THEN 3 ELSE 999 END AS rank FROM sup),
a AS (SELECT leader, list(id ORDER BY rank, ord) AS ids, list_sort(list_distinct(list(CAST(depth AS INT)) FILTER (WHERE depth IS NOT NULL))) AS depths, count(*) AS n FROM g GROUP BY leader)
SELECT leader, ids[1] AS primary, array_to_string(ids[2:], ',') AS alternatives, n, array_to_string(depths, ',') AS depths, len(depths) > 1 AS has_multiple_depths FROM a"""
DEDUPE_DEPTH = """SELECT id, depth, ord FROM (SELECT l_partkey AS id, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS depth, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(depth, 0.0), ord) = 1"""
TEXT_SEARCH = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE " + " AND ".join(
    f"(CAST(p_partkey AS VARCHAR) = '{t}' OR (p_partkey % 5 <> 0 AND (contains(lower(p_brand), '{t}') OR contains(lower(p_type), '{t}') OR contains(lower(p_name), '{t}') OR contains('pub' || CAST(p_partkey AS VARCHAR), '{t}'))))"
    for t in SEARCH_TERMS
)
CURRENT_SEARCH = """WITH s AS (SELECT 'ACT' || CAST(p_partkey % 300 AS VARCHAR) AS id, 'ACT' || CAST(p_partkey % 300 AS VARCHAR) || '_' || CAST(p_partkey % 7 AS VARCHAR) AS bid, p_name, p_type,
  CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 50 AS DOUBLE) END AS depth, p_partkey AS ord FROM part)
SELECT id, bid, depth, ord FROM s WHERE contains(lower(id), 'act1') OR contains(lower(p_name), 'act1') OR contains(lower(p_type), 'act1')
QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(depth, 0.0), ord) = 1"""
AUTOCOMPLETE = f"""SELECT * FROM (SELECT p_name AS name, p_brand AS region, min(p_partkey) AS ord FROM part WHERE contains(lower(p_name), '{AUTOCOMPLETE_TERM}') OR contains(lower(p_brand), '{AUTOCOMPLETE_TERM}')
GROUP BY 1, 2) ORDER BY ord LIMIT 10"""
LOOKUP = "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier WHERE s_suppkey IN (7, 9)"
COORD_IDS = f"WITH {SUP} SELECT id, 'X' || substr(sha256(printf('%.8f_%.8f', lat, lon)), 1, 7) AS coord_id FROM sup"
ROLLUP = f"""WITH r AS (SELECT l_suppkey AS id, l_orderkey * 10 + l_linenumber AS ord, {list(STATION_CONSTITUENTS)}[CAST(l_partkey % 5 AS INT) + 1] AS con, l_quantity AS amp FROM lineitem),
f AS (SELECT id, con, arg_min(amp, ord) AS amp FROM r GROUP BY id, con)
SELECT id, 'Station ' || CAST(id AS VARCHAR) AS name, string_agg(con || '=' || CAST(CAST(round(amp, 1) AS INT) AS VARCHAR), ',' ORDER BY con) AS constituents,
  round(coalesce(sum(amp) FILTER (WHERE con IN ('M2', 'S2', 'K1', 'O1')), 0.0), 4) AS datum FROM f GROUP BY id"""
STATION_IDS = "SELECT DISTINCT id FROM (SELECT CAST(s_suppkey % 60 AS VARCHAR) AS id FROM supplier UNION ALL SELECT CAST(c_custkey % 90 AS VARCHAR) FROM customer UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR) FROM nation)"
WITHOUT = "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0"
SEARCH_COUNTS = f"WITH {SUP} SELECT provider, count(*) AS n, count(depth) AS n_with_depth, round(sum(depth), 2) AS sum_depth FROM sup GROUP BY provider"

# -- scalars --------------------------------------------------------------------------------

UNITS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE round(l_quantity * 3.28084::DOUBLE, 3) END AS in_ft,
CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE round(l_quantity / 3.28084::DOUBLE, 3) END AS in_m FROM lineitem"""
TIME_TEXT = f"""SELECT event_id, {time_text('s')} AS delta, CASE WHEN s >= 0 THEN '+' ELSE '-' END || CASE WHEN abs(s) >= 60 THEN CAST(round(abs(s) / 60.0::DOUBLE, 1) AS VARCHAR) || 'min' ELSE CAST(abs(s) AS VARCHAR) || 's' END AS signed
FROM (SELECT event_id, event_id * 97 % 20011 - 10000 AS s FROM events)"""
HEIGHT_TEXT = f"""SELECT event_id, {height_text('d')} AS delta, CASE WHEN event_id % 2 = 0 THEN CAST(round(d * 0.3048::DOUBLE, 1) + 0.0::DOUBLE AS VARCHAR) || ' m' ELSE CAST(round(d, 1) AS VARCHAR) || ' ft' END AS card
FROM (SELECT event_id, (event_id * 7 % 201 - 100) / 10.0::DOUBLE AS d FROM events)"""
_STATE = "CASE " + " ".join(f"WHEN regexp_matches(bare, '(?i),\\s*({full}|{short})$') THEN '{short}'" for short, full in STATES.items()) + " END"
_FULL = "CASE state " + " ".join(f"WHEN '{short}' THEN '{full}'" for short, full in STATES.items()) + " END"
NAME_PARTS = f"""WITH n AS (SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (depth ' || CAST(p_partkey % 80 AS VARCHAR) || ' ft)' ELSE '' END || [', Maine', ', MA', '', ', Washington Current'][CAST(p_partkey % 4 AS INT) + 1] AS name FROM part),
b AS (SELECT *, regexp_replace(name, ' Current$', '') AS bare FROM n), s AS (SELECT *, {_STATE} AS state FROM b)
SELECT id, TRY_CAST(nullif(regexp_extract(name, '(?i)\\(depth (\\d+)\\s*(ft|m)\\)', 1), '') AS DOUBLE) AS depth, state,
  trim(CASE WHEN state IS NULL THEN CASE WHEN id % 4 = 3 THEN bare ELSE name END ELSE regexp_replace(CASE WHEN id % 4 = 3 THEN bare ELSE name END, '(?i),\\s*' || {_FULL} || '$', '') END) AS clean,
  CASE WHEN state IS NOT NULL AND id % 5 <> 0 THEN state || ', USA' WHEN id % 5 <> 0 THEN 'USA' ELSE 'Unknown' END AS region, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key,
  array_to_string(list_transform(string_split(translate(lower(name), '-_', '  '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM s"""
_PAD = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
OFFSETS = f"""WITH m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey * 37 % 2400 - 1200 END AS m FROM supplier),
t AS (SELECT s_suppkey, m, CASE WHEN m < 0 THEN '-' ELSE '+' END || {_PAD('abs(m) // 60')} || ':' || {_PAD('abs(m) % 60')} || ':00' AS minutes FROM m)
SELECT s_suppkey, CASE WHEN m IS NOT NULL THEN minutes END AS minutes, CASE WHEN coalesce(m, 0) = 0 THEN '00:00:00' ELSE CASE WHEN m < 0 THEN '-' ELSE '+' END || {_PAD('abs(m) // 100')} || ':' || {_PAD('abs(m) % 100')} || ':00' END AS zone,
  coalesce(m * 60.0::DOUBLE, 0.0) AS seconds, round(coalesce(m / 60.0::DOUBLE, 0.0), 6) AS hours FROM t"""
CHS = f"""WITH {CUS} SELECT id, CASE WHEN lon < -75 AND lon > -96 AND lat < 64 AND lat > 51 THEN 'Hudson''s Bay, Canada' WHEN lat > 60 THEN 'Northern Canada' WHEN lon < -120 THEN 'Pacific Canada'
WHEN lon > -75 THEN 'Atlantic Canada' ELSE 'Canada' END AS region FROM cus"""
_STATES_SQL = " ".join(f"WHEN '{s}' THEN '{zone}'" for s, zone in STATE_ZONES.items())
_CANADA = " ".join(f"WHEN '{r.replace(chr(39), chr(39) * 2)}' THEN '{z}'" for r, z in CANADA_ZONES.items())
_WORDS = " ".join(f"WHEN regexp_matches(coalesce(region, '') || ' ' || coalesce(location, ''), '(?i){p}') THEN '{z}'" for p, z in WORD_ZONES)
_HOURS = " ".join(f"WHEN {h} THEN '{z}'" for h, z in HOUR_ZONES.items())
ZONES = f"""WITH {CUS}, c AS (SELECT id, lon, ['Pacific Canada', 'Alaska coast', 'Nowhere', 'Japan'][CAST(id % 4 AS INT) + 1] AS region, CASE WHEN id % 5 = 0 THEN 'Tampa Bay, FL' WHEN id % 7 = 0 THEN 'Somewhere, ZZ' END AS location, CAST(round(lon / 15) AS INT) AS h FROM cus)
SELECT id, coalesce(CASE regexp_extract(coalesce(location, ''), ',\\s*([A-Z]{{2}})$', 1) {_STATES_SQL} END, CASE region {_CANADA} END, CASE {_WORDS} END, CASE h {_HOURS} END, 'Etc/GMT' || CASE WHEN h >= 0 THEN '-' ELSE '+' END || CAST(abs(h) AS VARCHAR)) AS tz,
  round(lon + 540 - 360 * CASE WHEN lon + 540 > 180 THEN ceil((lon + 540 - 180) / 360) ELSE 0 END, 2) AS lon FROM c"""
WINDOWS = """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS begin, CAST(CAST(last_day(o_orderdate) + INTERVAL 13 MONTH AS DATE) - INTERVAL 2 MONTH AS DATE) AS end13,
CAST(CAST(last_day(o_orderdate) + INTERVAL 12 MONTH AS DATE) - INTERVAL 2 MONTH AS DATE) AS end12, strftime(o_orderdate, '%Y%m') AS month, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter FROM orders"""
CACHE = """WITH m AS (SELECT s_suppkey AS k, CAST(2020 + s_suppkey % 8 AS VARCHAR) AS y, lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS m FROM supplier),
n AS (SELECT k, y, m, CASE k % 3 WHEN 0 THEN 'tides_v2_' || CAST(k AS VARCHAR) || '_' || y || m || '.json' WHEN 1 THEN 'stations_v1_' || y || 'Q' || CAST(k % 4 + 1 AS VARCHAR) || '.json' ELSE 'lunar_phases_' || y || '.json' END AS name FROM m)
SELECT k AS s_suppkey, name, CASE k % 3 WHEN 0 THEN y || m < '202501' WHEN 1 THEN y || 'Q' || CAST(k % 4 + 1 AS VARCHAR) < '2025Q1' ELSE y < '2025' END AS stale FROM n"""
#: Texts with the places that they mean.
GPS_CASES = (
    ("64.1466° N, 21.9426° W", 64.1466, -21.9426), ("-54.8019, -68.303", -54.8019, -68.303), ("59°54'50\"N, 10°45'8\"E", 59.913889, 10.752222),
    ("34°36'12.6\"S, 58°22'53.4\"W", -34.6035, -58.3815), ("35°41.4'N, 139°41.52'E", 35.69, 139.692), ("1 17 24.6 N, 103 51 7.2 E", 1.290167, 103.852),
    ("41°54'9\" N 12°29'47\" E", 41.9025, 12.496389), ("48,85661° N, 2,35222° E", 48.85661, 2.35222), ("18.0179s 76.8099w", -18.0179, -76.8099),
    ("91.5, 10.0", None, None), ("12.25, 190.5", 12.25, -190.5), ("N 60 10.2 E 24 56.4", 60.17, 24.94),
)
GPS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_d(a) if a is not None and abs(b) <= 180 else 'NULL'}, {_d(b) if b is not None and abs(b) <= 180 else 'NULL'})" for i, (_, a, b) in enumerate(GPS_CASES)) + ") t(i, lat, lon)"
GPS = f"SELECT i, round(lat, 5) AS lat, round(lon, 5) AS lon FROM ({GPS})"

# -- sky and calendars ----------------------------------------------------------------------


def _phase(ts: str) -> str:
    t = f"(((epoch_us({ts}) - epoch_us(TIMESTAMP '2000-01-01 12:00:00')) / 86400e6::DOUBLE + 0.5::DOUBLE) / 36525)"
    turn = lambda x: f"(({x}) - 360 * floor(({x}) / 360))"
    s = lambda x: f"sin(radians({x}))"
    sun = turn(f"280.46646::DOUBLE + 36000.76983::DOUBLE * {t} + 0.0003032::DOUBLE * {t} * {t}")
    m0 = turn(f"357.52911::DOUBLE + 35999.05029::DOUBLE * {t} - 0.0001537::DOUBLE * {t} * {t}")
    moon = turn(f"218.3165::DOUBLE + 481267.8813::DOUBLE * {t}")
    m = turn(f"134.9634::DOUBLE + 477198.8675::DOUBLE * {t} + 0.0087414::DOUBLE * {t} * {t}")
    d = turn(f"297.8502::DOUBLE + 445267.1115::DOUBLE * {t} - 0.00163::DOUBLE * {t} * {t}")
    return turn(f"{moon} - {sun} + (-6.289::DOUBLE * {s(m)} + 2.1::DOUBLE * {s(m0)} - 1.274::DOUBLE * {s(f'2 * {d} - {m}')} - 0.658::DOUBLE * {s(f'2 * {d}')} - 0.214::DOUBLE * {s(f'2 * {m}')})")


def lunar(first: int, last: int, result: str) -> str:
    years = " UNION ALL ".join(f"SELECT {y} AS y, unnest(generate_series(TIMESTAMP '{y}-01-01', TIMESTAMP '{y}-12-31 23:00:00', INTERVAL 1 HOUR)) AS ts" for y in range(first, last + 1))
    return f"""WITH hr AS ({years}), an AS (SELECT y, ts, {_phase('ts')} AS a FROM hr), lg AS (SELECT *, lag(a) OVER (PARTITION BY y ORDER BY ts) AS b FROM an),
ph AS (SELECT ts, CASE WHEN b > 270 AND a < 90 THEN 'new_moon' WHEN b < 90 AND a >= 90 THEN 'first_quarter' WHEN b < 180 AND a >= 180 THEN 'full_moon' WHEN b < 270 AND a >= 270 THEN 'last_quarter' END AS type FROM lg WHERE
  (b > 270 AND a < 90) OR (b < 90 AND a >= 90) OR (b < 180 AND a >= 180) OR (b < 270 AND a >= 270)) {result}"""


MOON_LIGHT = f"""WITH d AS (SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS ts FROM orders), a AS (SELECT ts, {_phase('ts')} AS a FROM d)
SELECT ts, round(a, 4) AS angle, round((1 - cos(radians(a))) / 2, 6) AS light, CASE WHEN a < 22.5 OR a >= 337.5 THEN 'new' WHEN a < 67.5 THEN 'waxing_crescent' WHEN a < 112.5 THEN 'first_quarter' WHEN a < 157.5 THEN 'waxing_gibbous'
WHEN a < 202.5 THEN 'full' WHEN a < 247.5 THEN 'waning_gibbous' WHEN a < 292.5 THEN 'last_quarter' ELSE 'waning_crescent' END AS phase FROM a"""


def _sun(rising: bool) -> str:
    turn = lambda x, n=360: f"(({x}) - {n} * floor(({x}) / {n}))"
    s = lambda x: f"sin(radians({x}))"
    name = "Sunrise" if rising else "Sunset"
    h = "(360 - degrees(acos(ch)))" if rising else "degrees(acos(ch))"
    return f"""SELECT id, name, '{name}' AS summary, day, ({turn(f"{h} / 15 + ra - 0.06571::DOUBLE * t - 6.622::DOUBLE", 24)} - lon / 15) AS h FROM (
  SELECT *, (cos(radians({_d(90 + 50 / 60)})) - 0.39782::DOUBLE * {s('l')} * {s('lat')}) / (cos(asin(0.39782::DOUBLE * {s('l')})) * cos(radians(lat))) AS ch, (r + floor(l / 90) * 90 - floor(r / 90) * 90) / 15 AS ra FROM (
  SELECT *, {turn("degrees(atan(0.91764::DOUBLE * tan(radians(l))))")} AS r FROM (
  SELECT *, {turn(f"m + 1.916::DOUBLE * {s('m')} + 0.020::DOUBLE * {s('2 * m')} + 282.634::DOUBLE")} AS l FROM (
  SELECT *, 0.9856::DOUBLE * t - 3.289::DOUBLE AS m FROM (SELECT *, dayofyear(day) + ({6 if rising else 18} - lon / 15) / 24 AS t FROM base))))) WHERE abs(ch) <= 1"""


SOLAR = f"""WITH {SUP}, base AS (SELECT id, name, lat, lon, unnest(generate_series(DATE '2025-06-01', DATE '2025-06-10', INTERVAL 1 DAY))::DATE AS day FROM sup),
e AS ({_sun(True)} UNION ALL {_sun(False)}) SELECT id AS station_id, summary, day::TIMESTAMP + to_microseconds(CAST(round(h * 3600) AS BIGINT) * 1000000) AS dtstart, name AS location FROM e"""
_CAL = f"""SELECT key AS station_id, type || ' Tide ' || CAST(round(round(height, 1) * 3.28084::DOUBLE, 3) AS VARCHAR) || ' ft' AS summary, CAST(NULL AS VARCHAR) AS description, ts AS dtstart, ts AS dtend, 'https://example.org/' || CAST(key AS VARCHAR) AS url, s_name AS location
FROM pk JOIN supplier ON s_suppkey = key"""
_MOONS = " ".join(f"WHEN '{k}' THEN '{n}'" for k, (n, _) in MOON.items())
_LIGHT = " ".join(f"WHEN '{k}' THEN 'Moon is {p}% illuminated'" for k, (_, p) in MOON.items())
TIDE_CALENDAR = lunar(2024, 2025, f""", {SER}, n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS c FROM ser WINDOW w AS (PARTITION BY key ORDER BY ts)), pk AS ({_PEAKS}) {_CAL}
UNION ALL SELECT s_suppkey, CASE type {_MOONS} END, CASE type {_LIGHT} END, ts, ts + INTERVAL 1 SECOND, NULL, s_name FROM ph CROSS JOIN supplier WHERE ts BETWEEN TIMESTAMP '2024-12-01' AND TIMESTAMP '2025-12-28'""")  # fmt: skip
CURRENT_CALENDAR = """SELECT user_id AS station_id, CASE event_id % 3 WHEN 2 THEN 'Ebb ' || CAST(abs(v) AS VARCHAR) || 'kts 270T ' || d || 'ft' WHEN 0 THEN 'Flood ' || CAST(v AS VARCHAR) || 'kts 90T ' || d || 'ft' ELSE 'Slack' END AS summary, ts AS dtstart,
'https://example.org/c?id=B' || CAST(user_id AS VARCHAR) || '&d=' || strftime(ts, '%Y-%m-%d') AS url, s_name || ' (B' || CAST(user_id AS VARCHAR) || ')' AS location
FROM (SELECT *, round(value / 10 - 5, 1) + 0.0::DOUBLE AS v, CASE WHEN event_id % 2 = 0 THEN '15' ELSE '' END AS d FROM events) JOIN supplier ON s_suppkey = user_id"""
