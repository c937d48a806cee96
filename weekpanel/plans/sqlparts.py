"""DuckDB SQL for the correctness oracle, built from small fragments.

Each oracle query restates the stand-in derivation and the operator
semantics independently in plain SQL (no Spark), over the pre-registered
test tables.  Kept in one module so that every query shares one statement of
the stand-in rules.
"""

from __future__ import annotations

from weekpanel.plans.standin import (
    GHOST_TEMP_NATION,
    NO_MIN_DAY,
    NULL_HUMIDITY_NATION,
    PART1_BEFORE,
    PART1_LAST_NATION,
    PART2_FIRST_NATION,
    PART2_FROM,
    STANDIN_ALIASES,
    TYPO_PRECIP_NATION,
    UNITS,
)
from weekpanel.schemas import KEEP_UPPER, LAG_WEEKS, VARIABLES

NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
PERIOD_RE = r"W([0-9]+)\s+([0-9]{4})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- expressions
def ws(d: str) -> str:
    return f"(CAST({d} AS DATE) - CAST(dayofweek(CAST({d} AS DATE)) AS INTEGER))"


def wyear(d: str) -> str:
    return f"CAST(year({ws(d)}) AS INTEGER)"


def wweek(d: str) -> str:
    return f"CAST((dayofyear({ws(d)}) - 1) // 7 + 1 AS INTEGER)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
        "lambda t: upper(t[1]) || lower(t[2:])), '')"
    )


def alias(k: str, aliases: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in sorted(aliases.items()))
    return f"(CASE {k} {whens} END)"


def std_name(x: str, aliases: dict[str, str] = STANDIN_ALIASES) -> str:
    rest = f"(CASE WHEN regexp_matches({x}, '^[0-9]+ ') THEN regexp_extract({x}, '(?s)^[0-9]+ (.*)$', 1) ELSE {x} END)"
    clean = f"upper({strip(rest)})"
    keep = ", ".join(q(k) for k in KEEP_UPPER)
    return f"coalesce({alias(clean, aliases)}, CASE WHEN {clean} IN ({keep}) THEN {clean} ELSE {title(clean)} END)"


def std_map_name(x: str, aliases: dict[str, str] = STANDIN_ALIASES) -> str:
    first = f"coalesce({alias(f'upper({strip(x)})', aliases)}, {title(strip(x))})"
    return title(strip(first))


def num(text: str) -> str:
    return f"(CASE WHEN regexp_matches({text}, {q(NUM_RE)}) THEN TRY_CAST(trim({text}) AS DOUBLE) END)"


# ---------------------------------------------------------------- CTE blocks
NATIONS = """
nat AS (
  SELECT n.n_nationkey AS nk, n.n_name AS name, r.r_name AS region,
         n.n_name || CASE WHEN r.r_name = 'MIDDLE EAST' THEN ' ' || r.r_name ELSE '' END AS base
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
nat_raw AS (
  SELECT *, CAST(100 + nk AS VARCHAR) || CASE WHEN region = 'MIDDLE EAST' THEN '  ' ELSE ' ' END || base AS raw
  FROM nat)"""

CASES = f"""
oc AS (
  SELECT 'W' || {wweek('o.o_orderdate')} || ' ' || {wyear('o.o_orderdate')} || strftime({ws('o.o_orderdate')}, '%a')
         || ' ' || {wyear('o.o_orderdate')} AS period, c.c_nationkey AS nk
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
periods AS (SELECT DISTINCT period FROM oc),
cell AS (SELECT period, nk, sum(1.0) AS cases FROM oc GROUP BY period, nk),
cases_melt AS MATERIALIZED (
  SELECT p.period, n.raw AS District, CAST(cell.cases AS DOUBLE) AS Cases
  FROM periods p CROSS JOIN nat_raw n LEFT JOIN cell ON cell.period = p.period AND cell.nk = n.nk),
cases_raw AS (
  SELECT TRY_CAST(regexp_extract(period, {q(PERIOD_RE)}, 2) AS INTEGER) AS Year,
         TRY_CAST(regexp_extract(period, {q(PERIOD_RE)}, 1) AS INTEGER) AS Week, District, Cases
  FROM cases_melt),
cases_std AS (SELECT Year, Week, {std_name('District')} AS District, Cases FROM cases_raw),
cases_m AS MATERIALIZED (
  SELECT Year, Week, District, CAST(coalesce(sum(Cases), 0) AS DOUBLE) AS Cases FROM cases_std
  WHERE Year IS NOT NULL AND Week IS NOT NULL AND District IS NOT NULL GROUP BY Year, Week, District),
yr AS (SELECT min(Year) AS lo, max(Year) AS hi FROM cases_raw),
spine AS (
  SELECT CAST(y.Year AS INTEGER) AS Year, CAST(w.Week AS INTEGER) AS Week, d.District
  FROM (SELECT DISTINCT District FROM cases_m) d
  CROSS JOIN (SELECT unnest(generate_series(lo, hi)) AS Year FROM yr) y
  CROSS JOIN (SELECT unnest(generate_series(1, 52)) AS Week) w),
base AS MATERIALIZED (
  SELECT s.Year, s.Week, s.District, coalesce(c.Cases, 0.0) AS Cases
  FROM spine s LEFT JOIN cases_m c ON c.Year = s.Year AND c.Week = s.Week AND c.District = s.District)"""

_UNIT_ROWS = ", ".join(f"({q(v)}, {q(u)})" for v, u in UNITS.items())
def _two_places(x: str) -> str:
    return f"CAST({x} // 100 AS VARCHAR) || '.' || lpad(CAST({x} % 100 AS VARCHAR), 2, '0')"


_TEXT = f"""CASE
      WHEN s.variable = 'temp_max' THEN CASE WHEN day(r.d) = 13 THEN '-' ELSE {_two_places('dl.tmax')} END
      WHEN s.variable = 'temp_min' THEN {_two_places('dl.tmin')}
      WHEN s.variable = 'precipitation' THEN
        CASE WHEN dl.rain = 0 AND dayofweek(r.d) = 0 THEN 'Trace' ELSE {_two_places('dl.rain')} END
      WHEN s.part = 2 THEN '  ' || {_two_places('dl.damp')} || ' '
      ELSE {_two_places('dl.damp')} END"""

_NO_MIN = f"\n    AND (v.variable <> 'temp_min' OR day(days.d) <> {NO_MIN_DAY})"
WEATHER = f"""
li AS (
  SELECT CAST(l.l_shipdate AS DATE) AS d, s.s_nationkey AS nk, CAST(round(l.l_quantity * 100) AS BIGINT) AS q,
         CAST(round(l.l_discount * 10000) AS BIGINT) AS c, CAST(round(l.l_tax * 10000) AS BIGINT) AS t,
         CASE WHEN l.l_returnflag = 'R' THEN CAST(round(l.l_extendedprice * 100) AS BIGINT) ELSE 0 END AS r
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey),
daily AS MATERIALIZED (
  SELECT d, nk, CAST(sum(q) AS BIGINT) // count(*) AS tmax, CAST(sum(c) AS BIGINT) // count(*) AS tmin,
         CAST(sum(r) AS BIGINT) AS rain, CAST(sum(t) AS BIGINT) // count(*) AS damp
  FROM li GROUP BY d, nk),
days AS (SELECT DISTINCT d FROM li),
vars AS (SELECT * FROM (VALUES {_UNIT_ROWS}) t(variable, unit)),
parts AS (SELECT * FROM (VALUES (1), (2)) t(part)),
sheet_rows AS MATERIALIZED (
  SELECT v.variable, p.part, days.d, CAST(date_diff('day', DATE '1970-01-01', days.d) AS BIGINT) AS src_row,
         CASE WHEN p.part = 1 THEN
           CASE WHEN day(days.d) = 31 THEN strftime(days.d, '%-d/%-m/%Y') ELSE strftime(days.d, '%d/%m/%Y %H:%M:%S') END
         ELSE strftime(days.d, '%-d/%-m/%Y') END AS time_text
  FROM vars v CROSS JOIN parts p
  JOIN days ON ((p.part = 1 AND days.d < DATE '{PART1_BEFORE}') OR (p.part = 2 AND days.d >= DATE '{PART2_FROM}')){_NO_MIN}),
fmt AS (
  SELECT variable, part,
         CASE WHEN count(try_strptime(time_text, '%d/%m/%Y %H:%M:%S')) > 0 THEN 1
              WHEN count(try_strptime(time_text, '%d/%m/%Y')) > 0 THEN 2 ELSE 0 END AS f
  FROM sheet_rows GROUP BY variable, part),
parsed AS MATERIALIZED (
  SELECT r.variable, r.part, r.d, r.src_row, r.time_text,
         CASE f.f WHEN 1 THEN try_strptime(r.time_text, '%d/%m/%Y %H:%M:%S')
                  WHEN 2 THEN try_strptime(r.time_text, '%d/%m/%Y') END AS date
  FROM sheet_rows r JOIN fmt f ON f.variable = r.variable AND f.part = r.part),
first_rows AS MATERIALIZED (
  SELECT variable, part, d, src_row, date FROM parsed WHERE date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY variable, date ORDER BY part, src_row) = 1),
stations AS (
  SELECT v.variable, p.part, n.nk, n.name || ' Obs. ' || v.unit AS station
  FROM vars v CROSS JOIN parts p
  JOIN nat n ON (p.part = 1 AND n.nk <= {PART1_LAST_NATION}) OR (p.part = 2 AND n.nk >= {PART2_FIRST_NATION})),
var_stations AS (SELECT DISTINCT variable, station FROM stations),
sheet_cells AS MATERIALIZED (
  SELECT s.variable, s.part, r.d, r.src_row, r.time_text, s.station, {_TEXT} AS text
  FROM stations s JOIN sheet_rows r ON r.variable = s.variable AND r.part = s.part
  LEFT JOIN daily dl ON dl.d = r.d AND dl.nk = s.nk),
cells AS MATERIALIZED (
  SELECT k.variable, k.date, vs.station, {num('c.text')} AS value
  FROM first_rows k JOIN var_stations vs ON vs.variable = k.variable
  LEFT JOIN sheet_cells c ON c.variable = k.variable AND c.part = k.part AND c.src_row = k.src_row AND c.station = vs.station)"""
EVERY_DAY = WEATHER.replace(_NO_MIN, "")  # the temp_min sheets with all their days


def mean_temp(key: str) -> str:
    """Mean temperature by one conditional aggregate per (key, station); ``key`` pairs max and min rows."""
    return f"""
keyed AS MATERIALIZED (
  SELECT c.variable, c.station, c.date, c.value, k.key
  FROM cells c JOIN (SELECT variable, date, {key} AS key FROM first_rows WHERE variable IN ('temp_max', 'temp_min')) k
    ON k.variable = c.variable AND k.date = c.date),
temp_cells AS MATERIALIZED (
  SELECT 'temp' AS variable, max(date) FILTER (WHERE variable = 'temp_max') AS date, station,
         CASE WHEN station IN (SELECT station FROM var_stations WHERE variable = 'temp_min')
              THEN (max(value) FILTER (WHERE variable = 'temp_max') + max(value) FILTER (WHERE variable = 'temp_min')) / 2
              ELSE max(value) FILTER (WHERE variable = 'temp_max') END AS value
  FROM keyed GROUP BY key, station HAVING count(*) FILTER (WHERE variable = 'temp_max') > 0),
all_cells AS (SELECT * FROM cells UNION ALL SELECT * FROM temp_cells)"""


BY_POSITION, BY_DATE = "row_number() OVER (PARTITION BY variable ORDER BY date)", "date"
MEAN_TEMP = mean_temp(BY_POSITION)

_LAGS = ", ".join(f"lag(value, {k}) OVER w AS lag{k}" for k in LAG_WEEKS if k)
WEEKLY = f"""
weekly AS MATERIALIZED (
  SELECT variable, station, {wyear('date')} AS year, {wweek('date')} AS week,
         CASE WHEN variable = 'precipitation' THEN coalesce(CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE), 0.0)
              ELSE CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) / nullif(count(value), 0) END AS value
  FROM all_cells GROUP BY 1, 2, 3, 4),
lagged AS (
  SELECT variable, station, year, week, value AS lag0, {_LAGS}
  FROM weekly WINDOW w AS (PARTITION BY variable, station ORDER BY year, week))"""

MAPPING = f"""
map_raw AS (
  SELECT ' ' || CAST(100 + nk AS VARCHAR) AS district_code,
         CASE WHEN nk % 2 = 1 THEN lower(base) ELSE base END AS district_name,
         CASE WHEN nk = {GHOST_TEMP_NATION} THEN 'Ghost Obs. (°C)' ELSE name || ' Obs. (°C)' END AS temp_station,
         CASE WHEN nk = {NULL_HUMIDITY_NATION} THEN NULL ELSE name || ' Obs. (%)(Avg)' END AS humidity_station,
         CASE WHEN nk = {TYPO_PRECIP_NATION} THEN name || ' Obs (mm)' ELSE name || ' Obs. (mm)' END AS precipitation_station,
         CAST(nk AS BIGINT) AS src_row
  FROM nat),
map_std AS (
  SELECT {strip('district_code')} AS district_code, {std_map_name('district_name')} AS district_name,
         temp_station, humidity_station, precipitation_station, src_row
  FROM map_raw),
map_dedup AS (SELECT * FROM map_std QUALIFY row_number() OVER (PARTITION BY district_name ORDER BY src_row) = 1),
map_long AS (
  SELECT district_code, district_name, 'humidity_station' AS station_group, humidity_station AS station FROM map_dedup
  UNION ALL SELECT district_code, district_name, 'precipitation_station', precipitation_station FROM map_dedup
  UNION ALL SELECT district_code, district_name, 'temp_station', temp_station FROM map_dedup),
vg AS (
  SELECT * FROM (VALUES ('temp', 'temp_station'), ('temp_max', 'temp_station'), ('temp_min', 'temp_station'),
                        ('humidity', 'humidity_station'), ('precipitation', 'precipitation_station')) t(variable, station_group))"""

_LAGCOLS = ", ".join(f"l.lag{k}" for k in LAG_WEEKS)
FEATURES = f"""
feats AS MATERIALIZED (
  SELECT l.variable, {title(strip('m.district_name'))} AS district_name, l.year, l.week, {_LAGCOLS}
  FROM lagged l JOIN vg ON vg.variable = l.variable
  JOIN map_long m ON m.station_group = vg.station_group AND m.station = l.station)"""

FEATURE_COLS = [f"{v}_lag{k}" for v in VARIABLES for k in LAG_WEEKS]
_FW = ",\n         ".join(f"max(CASE WHEN variable = '{v}' THEN lag{k} END) AS {v}_lag{k}" for v in VARIABLES for k in LAG_WEEKS)
_FILL = ",\n         ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in FEATURE_COLS)
PANEL = f"""
fw AS (
  SELECT district_name AS District, year AS Year, week AS Week,
         {_FW}
  FROM feats GROUP BY 1, 2, 3),
joined AS (
  SELECT b.Year, b.Week, b.District, b.Cases, {', '.join('fw.' + c for c in FEATURE_COLS)}
  FROM base b LEFT JOIN fw ON fw.Year = b.Year AND fw.Week = b.Week AND fw.District = b.District),
panel AS MATERIALIZED (
  SELECT Year, Week, District, Cases,
         {_FILL}
  FROM joined WINDOW w AS (PARTITION BY District ORDER BY Year, Week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def with_ctes(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip("\n") for b in blocks) + "\n"


ALL = (NATIONS, CASES, WEATHER, MEAN_TEMP, WEEKLY, MAPPING, FEATURES, PANEL)
