"""The same results in plain SQL over the test tables, for comparison by another engine."""

from __future__ import annotations

import re

from tidemark import schema as S
from tidemark.functions.student import EPS, tail_coefficients
from tidemark.plans import workload as w

START, END = "1996-01-01", "2000-12-31"


def _places() -> str:
    ok = "n_nationkey NOT IN (7, 19)"
    return f"""SELECT s_suppkey, n_nationkey, n_regionkey, 'C' || CAST(n_nationkey % 5 AS VARCHAR) AS county,
      n_name AS waterbody, CAST(s_suppkey AS VARCHAR) AS station, s_name AS name,
      CASE WHEN {ok} THEN 'R' || CAST(n_regionkey AS VARCHAR) END AS WBID,
      CASE WHEN {ok} THEN r_name END AS WATERBODY_NAME,
      CAST(-86.8 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (s_suppkey % 100) AS lon,
      CAST(30.30 AS DOUBLE) + CAST(0.01 AS DOUBLE) * ((s_suppkey * 7) % 80) AS lat
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _physical() -> str:
    def one(p: str, u: str, e: str) -> str:
        e = e.replace("1000D", "CAST(1000 AS DOUBLE)")
        return f"""SELECT 'physical' AS type, county, waterbody, station, CAST(l_shipdate AS DATE) AS date, '{p}' AS parameter,
      CASE WHEN l_linestatus = 'O' THEN 'surf' ELSE 'bott' END AS location, '{u}' AS units,
      CASE WHEN l_orderkey % 50 <> 0 THEN {e} END AS val, CAST(NULL AS VARCHAR) AS notes
    FROM lineitem JOIN places ON l_suppkey = s_suppkey"""

    return " UNION ALL ".join(one(p, u, e) for p, (u, e) in w.PARAMETERS.items())


def _polygon_edges() -> str:
    rows = []
    for i, n, rings in w.POLYGONS:
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
                rows.append(f"('{i}', '{n}', {x1}, {y1}, {x2}, {y2})")
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("x1", "y1", "x2", "y2"))
    return f"SELECT id, nm, {cols} FROM (VALUES {', '.join(rows)}) AS v(id, nm, x1, y1, x2, y2)"


def _dirty_number(k: str, v: str) -> str:
    return f"""CASE {k} % 7 WHEN 0 THEN {v} || 'broken' WHEN 1 THEN '_' || {v} WHEN 2 THEN '.' WHEN 3 THEN ''
      WHEN 4 THEN 'Not Reported' ELSE {v} END"""


VIEWS = {
    "places": _places(),
    "stations": "SELECT waterbody, station, name, WBID, WATERBODY_NAME, lon, lat FROM places",
    "listed": "SELECT * FROM stations WHERE WBID IS NOT NULL",
    "regions": "SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS WBID, r_name AS WATERBODY_NAME FROM region",
    "physical": _physical(),
    "discrete": """SELECT 'discrete' AS type, county, waterbody, station, CAST(ts AS DATE) AS date, event_type AS parameter,
      'surf' AS location, 'ct' AS units, value AS val, CASE WHEN event_id % 10 = 0 THEN 'on bottom' END AS notes
    FROM events JOIN places ON user_id % (SELECT count(*) FROM supplier) = s_suppkey""",
    "samples": "SELECT * FROM physical UNION ALL SELECT * FROM discrete",
    "rain_daily": """SELECT 'G' || substr(o_orderpriority, 1, 1) AS station, o_orderpriority AS name,
      CAST(o_orderdate AS DATE) AS date, o_totalprice / CAST(100000 AS DOUBLE) AS precip_inches FROM orders""",
    "rain_months": """SELECT station, name, CAST(date_trunc('month', date) AS DATE) AS date, sum(precip_inches) AS precip_inches
    FROM rain_daily GROUP BY ALL""",
    "rain_gaps": """SELECT 'G' || substr(o_orderpriority, 1, 1) AS station, o_orderpriority AS name, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE o_totalprice / CAST(100000 AS DOUBLE) END AS precip_inches FROM orders""",
    "gauge_ids": """SELECT DISTINCT 'G' || substr(o_orderpriority, 1, 1) AS station, o_orderpriority AS name,
      CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) < 5 THEN
        'R' || CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS VARCHAR) END AS WBID FROM orders""",
    "gauges": "SELECT g.station, g.name, g.WBID, r.WATERBODY_NAME FROM gauge_ids g LEFT JOIN regions r ON g.WBID = r.WBID",
    "criteria": """SELECT waterbody, station, WBID, 'tp' AS parameter, CAST(0.02 AS DOUBLE) * (1 + n_regionkey % 3) AS value FROM places
    UNION ALL SELECT waterbody, station, WBID, 'tn', CAST(0.02 AS DOUBLE) * (1 + s_suppkey % 3) FROM places
    UNION ALL SELECT waterbody, station, WBID, 'chl', CAST(0.02 AS DOUBLE) * (1 + n_nationkey % 3) FROM places WHERE n_regionkey <> 4""",
    "region_criteria": """SELECT WBID, parameter, min(value) AS value FROM criteria GROUP BY ALL
    HAVING count(DISTINCT value) = 1""",
    "station_criteria": """SELECT waterbody, station, parameter, min(value) AS value FROM criteria GROUP BY ALL
    HAVING count(DISTINCT value) = 1""",
    "readings": """SELECT waterbody, station, ts AS timestamp, event_id, value AS temp_f, value / CAST(15 AS DOUBLE) AS sal_ppt
    FROM events JOIN places ON user_id % (SELECT count(*) FROM supplier) = s_suppkey""",
    "label_rows": "SELECT * FROM (VALUES "
    + ", ".join(f"('{p}', {repr(u) if u else 'NULL'}, '{a}', '{b}')" for p, u, a, b in S.PARAMETER_LABELS)
    + ") AS v(p, u, label, labelnouni)",
    "catalogue": """SELECT type, units, location, parameter, datestr, dateend, label, labelnouni FROM (
      SELECT type, units, location, parameter, min(date) AS datestr, max(date) AS dateend FROM samples
      WHERE val IS NOT NULL GROUP BY ALL) LEFT JOIN label_rows ON parameter = p AND (u IS NULL OR u = units)""",
    "edges": _polygon_edges(),
    "hits": """SELECT waterbody, station, lon, lat, id, nm FROM (
      SELECT s.waterbody, s.station, s.lon, s.lat, e.id, e.nm,
        sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) AS crossings,
        sum(CASE WHEN (lon - x1) * (y2 - y1) = (lat - y1) * (x2 - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
          AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) AS touches
      FROM stations s, edges e GROUP BY ALL) WHERE crossings % 2 = 1 OR touches > 0""",
    "located": "SELECT s.waterbody, s.station, s.lon, s.lat, s.WBID AS listed_id, h.id AS WBID, h.nm AS WATERBODY_NAME FROM stations s LEFT JOIN hits h USING (waterbody, station)",
    "dirty": f"""SELECT p_partkey AS key, {_dirty_number('p_partkey', 'CAST(p_retailprice AS VARCHAR)')} AS number,
      CASE p_partkey % 5 WHEN 0 THEN 'Bottom (' || CAST(p_size AS VARCHAR) || '.5)' WHEN 1 THEN 'Weeds' WHEN 2 THEN 'S' WHEN 3 THEN 'Not Reported' END AS note,
      CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS depth,
      (['Swift creek', 'FT. walton beach', 'GAP Redfish', 'Bass Lake', 'Tky Bass Lake'])[p_partkey % 5 + 1] AS waterbody,
      (['okaloosa', 'walton', 'Bay'])[p_partkey % 3 + 1] AS county, (['959F', '46', '570'])[p_partkey % 3 + 1] AS WBID,
      upper(p_type) || ' ' || lower(p_name) || ' (upper/lower)' AS title,
      CAST(p_partkey % 14 AS VARCHAR) || '/' || CAST(p_partkey % 28 + 1 AS VARCHAR) || '/2001' AS day,
      CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 1000 END AS ms, p_retailprice AS us FROM part""",
}


def _sql(body: str) -> str:
    """Prefix a query with the views it uses."""
    need: set[str] = set()
    texts = [body]
    while texts:
        text = texts.pop()
        for name, view in VIEWS.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                texts.append(view)
    # views refer to earlier ones only
    order = [n for n in VIEWS if n in need]
    head = ",\n".join(f"{n} AS (\n  {VIEWS[n]}\n)" for n in order)
    return f"WITH {head}\n{body}" if head else body


def r6(expr: str, name: str) -> str:
    return f"round({expr} + 1e-9, 6) + 0.0 AS {name}"


def day(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"


def stamp(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def count_text(n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN '1 station' ELSE CAST({n} AS VARCHAR) || ' stations' END"


def t_quantile(df: str) -> str:
    table = ", ".join(f"CAST({v} AS DOUBLE)" for v in S.T_975)
    tail = "CAST(0 AS DOUBLE)"
    for c in reversed(tail_coefficients()):
        tail = f"(({tail} + CAST('{c!r}' AS DOUBLE)) / CAST({df} AS DOUBLE))"
    return f"CASE WHEN {df} <= {len(S.T_975)} THEN ([{table}])[{df}] ELSE CAST('{S.Z_975!r}' AS DOUBLE) + {tail} END"


def with_bounds(grouped: str, keys: str, more: str = "") -> str:
    """``grouped`` yields the keys, date, n, m, v (sample variance)."""
    return f"""SELECT {keys}, {day('date', 'date')}, n, {r6('m', 'val')},
      {r6('CASE WHEN ok THEN m - t * se END', 'lovl')}, {r6('CASE WHEN ok THEN m + t * se END', 'hivl')} FROM (
      SELECT *, n > 1 AND se > 0 AND se >= CAST('{10 * EPS!r}' AS DOUBLE) * abs(m) AS ok FROM (
      SELECT *, sqrt(v / n) AS se, CASE WHEN n > 1 THEN {t_quantile('(n - 1)')} END AS t FROM ({grouped}))){more}"""


PICK = "val IS NOT NULL AND parameter = '{}' AND location = '{}'"


def _pick(p: str, loc: str, ranged: bool = False) -> str:
    s = PICK.format(p, loc)
    return s + (f" AND date BETWEEN DATE '{START}' AND DATE '{END}'" if ranged else "")


WET = "CASE WHEN month({}) IN (6, 7, 8, 9) THEN 'wet' ELSE 'dry' END"
SEASON = (
    "CASE WHEN month({0}) IN (12, 1, 2) THEN 'winter' WHEN month({0}) IN (3, 4, 5) THEN 'spring'"
    " WHEN month({0}) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END"
)


def _runs(rows: str, keys: str, label: str) -> str:
    """Readings with their run and its first month; ordered by date within a series."""
    lab = label.format("date")
    return f"""SELECT *, CAST(date_trunc('month', min(date) OVER (PARTITION BY {keys}, run)) AS DATE) AS start FROM (
      SELECT *, sum(step) OVER (PARTITION BY {keys} ORDER BY date RANGE UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY {keys} ORDER BY date) THEN 0 ELSE 1 END AS step
      FROM (SELECT *, {lab} AS label FROM ({rows}))))"""


REGION_DAILY = "SELECT WBID AS waterbody, WBID AS station, '{0}' AS parameter, '{1}' AS location, date, avg(val) AS val FROM samples JOIN stations USING (waterbody, station) WHERE {2} AND WBID IS NOT NULL GROUP BY ALL"
STATION_ROWS = "SELECT waterbody, station, parameter, location, date, val FROM samples WHERE {2}"
SERIES = "waterbody, station, parameter, location"


def _rows(by: str, p: str, loc: str) -> str:
    return (REGION_DAILY if by == "region" else STATION_ROWS).format(p, loc, _pick(p, loc))


def _period(by: str, p: str, loc: str, period: str) -> str:
    rows = _rows(by, p, loc)
    stats = "count(val) AS n, avg(val) AS m, var_samp(val) AS v"
    if period == "year":
        g = f"SELECT {SERIES}, CAST(date_trunc('year', date) AS DATE) AS date, {stats} FROM ({rows}) GROUP BY 1, 2, 3, 4, 5"
    else:
        label = WET if period.endswith(" season") else SEASON
        want = period.removesuffix(" season")
        cond = "" if want == "season" else f" WHERE label = '{want}'"
        g = f"SELECT {SERIES}, start AS date, {stats} FROM (SELECT {SERIES}, start, label, val FROM ({_runs(rows, SERIES, label)})){cond} GROUP BY 1, 2, 3, 4, 5"
    return with_bounds(g, SERIES)


RAIN_REGION = "SELECT WBID AS waterbody, WBID AS station, 'rain' AS parameter, 'surf' AS location, r.date, avg(precip_inches) AS val FROM rain_months r JOIN gauges g USING (station, name) WHERE WBID IS NOT NULL GROUP BY ALL"


def _summary(by: str, where: str, extra: str = "", out_extra: str = "") -> str:
    e = f", {extra}" if extra else ""
    if by == "region":
        return f"""SELECT WBID, WATERBODY_NAME{e}, avg(val) AS val, count(DISTINCT waterbody || '_' || station) AS n_stations
        FROM samples JOIN stations USING (waterbody, station) JOIN regions USING (WBID, WATERBODY_NAME) WHERE {where} GROUP BY WBID, WATERBODY_NAME{e}"""
    return f"""SELECT waterbody, station, WATERBODY_NAME, lon, lat{e}, avg(val) AS val
        FROM samples JOIN stations USING (waterbody, station) WHERE {where} GROUP BY waterbody, station, WATERBODY_NAME, lon, lat{e}"""


def _pair(*choices: tuple[str, str]) -> str:
    ors = " OR ".join(f"(parameter = '{p}' AND location = '{loc}')" for p, loc in choices)
    return f"val IS NOT NULL AND ({ors}) AND date BETWEEN DATE '{START}' AND DATE '{END}'"


def _trend(rows: str, keys: str, lo: str = "min(date) OVER w", hi: str = "max(date) OVER w") -> str:
    """Fitted value per row inside [lo, hi], NULL outside; a flat line when all dates are equal."""
    x = "CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE)"
    return f"""SELECT *, CASE WHEN cnt > 1 AND inside THEN coalesce(
        regr_slope(CASE WHEN inside THEN val END, CASE WHEN inside THEN x END) OVER w * x
        + regr_intercept(CASE WHEN inside THEN val END, CASE WHEN inside THEN x END) OVER w,
        avg(CASE WHEN inside THEN val END) OVER w) END AS trend FROM (
      SELECT *, coalesce(date BETWEEN lo AND hi, FALSE) AS inside FROM (
      SELECT *, {x} AS x, count(*) OVER w AS cnt, {lo} AS lo, {hi} AS hi FROM ({rows}) WINDOW w AS (PARTITION BY {keys})))
      WINDOW w AS (PARTITION BY {keys})"""


def _recent(years: int) -> tuple[str, str]:
    since = f"CAST(max(date) OVER w - INTERVAL {years} YEAR AS DATE)"
    return f"CASE WHEN {since} >= min(date) OVER w THEN {since} END", "max(date) OVER w"


def _area_daily(by: str, p: str, loc: str = "surf") -> str:
    if by == "region":
        return f"SELECT WBID, date, avg(val) AS val FROM samples JOIN stations USING (waterbody, station) WHERE {_pick(p, loc)} AND WBID IS NOT NULL GROUP BY ALL"
    return f"SELECT waterbody, station, date, avg(val) AS val FROM samples WHERE {_pick(p, loc)} GROUP BY ALL"


def _gauge(by: str, p: str, select: str) -> str:
    keys = "WBID" if by == "region" else "waterbody, station"
    view = "region_criteria" if by == "region" else "station_criteria"
    return _sql(f"""SELECT {select} FROM (
      SELECT a.*, c.value AS criterion, greatest(max(a.val) OVER (), c.value) AS top FROM ({_summary(by, _pick(p, 'surf', True))}) a
      LEFT JOIN (SELECT {keys}, value FROM {view} WHERE parameter = '{p[:3]}') c USING ({keys}))""")


def _wide_field() -> str:
    ok, surf = "l_orderkey % 50 <> 0", "l_linestatus = 'O'"
    return f"""SELECT county, waterbody, station, CAST(l_shipdate AS DATE) AS date,
      CASE WHEN {surf} AND {ok} THEN l_quantity END AS temp_surf_f, CASE WHEN NOT ({surf}) AND {ok} THEN l_quantity END AS temp_bott_f,
      CASE WHEN {ok} THEN l_discount END AS tn_mgl FROM lineitem JOIN places ON l_suppkey = s_suppkey"""


def _long_field() -> str:
    return " UNION ALL ".join(
        f"SELECT county, waterbody, station, date, '{c}' AS var, {c} AS val FROM ({_wide_field()})"
        for c in ("temp_surf_f", "temp_bott_f", "tn_mgl")
    )


def _number(expr: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({expr}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST(trim({expr}) AS DOUBLE) END"


def _tokens(expr: str) -> str:
    return f"CASE WHEN trim({expr}) NOT IN ('NA', '', '.') THEN {expr} END"


def _chain(expr: str, fixes) -> str:
    for a, b in fixes:
        expr = f"regexp_replace({expr}, '{a}', '{b}', 'g')"
    return expr


def _depth(depth: str, note: str) -> str:
    return f"coalesce({depth}, {_number(f'''regexp_replace({note}, '{S.DEPTH_NOTE_JUNK}', '', 'g')''')})"


def _mdy(expr: str) -> str:
    return f"CAST(try_strptime({expr}, '%m/%d/%Y') AS DATE)"


def _missing_keys(rows: str, known: str, keys: str = "waterbody, station") -> str:
    return _sql(f"SELECT DISTINCT {keys} FROM ({rows}) EXCEPT SELECT DISTINCT {keys} FROM ({known})")


def _mismatch(column: str, expected: tuple[str, ...]) -> str:
    want = ", ".join(f"('{v}')" for v in expected)
    found, wanted = f"SELECT DISTINCT {column} AS value FROM samples WHERE {column} IS NOT NULL", f"SELECT value FROM (VALUES {want}) AS v(value)"
    return _sql(f"""SELECT value, 'unexpected' AS problem FROM ({found} EXCEPT {wanted})
    UNION ALL SELECT value, 'missing' AS problem FROM ({wanted} EXCEPT {found})""")


def _region_problems(places: str, known: str, expected: tuple[str, ...], bare: int) -> str:
    want = ", ".join(f"('{v}')" for v in expected)
    ids = f"SELECT DISTINCT WBID AS value FROM {places} WHERE WBID IS NOT NULL"
    return _sql(f"""SELECT value, 'unexpected' AS problem FROM ({ids} EXCEPT SELECT value FROM (VALUES {want}) AS v(value))
    UNION ALL SELECT value, 'unknown' FROM ({ids} EXCEPT SELECT WBID FROM regions WHERE {known})
    UNION ALL SELECT CAST(n AS VARCHAR), 'without region' FROM (SELECT count(*) AS n FROM {places} WHERE WBID IS NULL) WHERE n <> {bare}""")


def _cont(period: str) -> str:
    floor = {
        "day": "CAST(timestamp AS DATE)",
        "week": "CAST(timestamp AS DATE) - CAST(dayofweek(timestamp) AS INT)",
    }.get(period, f"CAST(date_trunc('{period}', timestamp) AS DATE)")
    g = f"""SELECT waterbody, station, 'temp_f' AS variable, {floor} AS date, count(temp_f) AS n, avg(temp_f) AS m, var_samp(temp_f) AS v
      FROM readings WHERE temp_f IS NOT NULL GROUP BY 1, 2, 3, 4"""
    return _sql(with_bounds(g, "waterbody, station, variable"))


def _box(daily: str) -> str:
    return f"""SELECT station, count(*) AS n, quantile_cont(precip_inches, 0.25) AS q1, quantile_cont(precip_inches, 0.5) AS q2,
      quantile_cont(precip_inches, 0.75) AS q3 FROM ({daily}) WHERE precip_inches > 0 GROUP BY station"""


def _full_samples() -> str:
    """The tidy build over the whole sheets of the workload."""
    k = "(l_orderkey + l_linenumber)"
    cells = []
    for i, name in enumerate(w.FIELD_COLUMNS.values()):
        p, loc, u = name.split("_")
        cells.append(f"""SELECT 'physical' AS type, county, 'Red Fish Creek ' || waterbody AS waterbody, station,
        CASE WHEN {k} % 31 <> 0 THEN CAST(l_shipdate AS DATE) END AS date, '{p}' AS parameter, '{loc}' AS location, '{u}' AS units, l_quantity + {i} AS val,
        CAST(NULL AS VARCHAR) AS notes FROM lineitem JOIN places ON l_suppkey = s_suppkey WHERE ({k} + {i}) % 9 <> 0""")
    field = " UNION ALL ".join(cells).replace("county, 'Red", "CASE county WHEN 'okaloosa' THEN 'Okaloosa' ELSE county END AS county, 'Red")
    v = "CAST(value AS VARCHAR)"
    scrub = lambda c: _number(f"regexp_replace({_tokens(c)}, '{S.LAB_JUNK}', '', 'g')")
    raw = f"""SELECT county, waterbody, station, CASE WHEN event_id % 31 <> 0 THEN CAST(ts AS DATE) END AS date, event_id AS k, value, {_dirty_number('event_id', v)} AS tp_text,
      {_dirty_number('(event_id + 1)', 'CAST(value + 1 AS VARCHAR)')} AS chl_text,
      CASE event_id % 5 WHEN 0 THEN 'Bottom, "soft" (' || {v} || ')' WHEN 1 THEN 'Weeds, "dense"' WHEN 2 THEN 'S' WHEN 3 THEN 'Not Reported' END AS note
      FROM events JOIN places ON user_id % (SELECT count(*) FROM supplier) = s_suppkey"""
    lab = f"""SELECT county, waterbody, station, date, {scrub('tp_text')} / 1000 AS tp, value / 1000 AS tn, {scrub('chl_text')} AS chluncorr, value + 2 AS chlcorr, value + 3 AS color,
      {_depth('CASE WHEN k % 3 = 0 THEN value END', 'note')} AS secchi, CASE WHEN k % 4 = 0 THEN CAST(0.5 AS DOUBLE) ELSE value / 1000 END AS cond,
      CASE WHEN regexp_matches(note, 'Weeds|Bottom') THEN 'on bottom' END AS notes FROM ({raw})"""
    long = " UNION ".join(
        f"""SELECT 'discrete' AS type, county, 'GAP ' || waterbody AS waterbody, station, date, '{p}' AS parameter, 'surf' AS location,
        '{u}' AS units, {p} AS val, {'notes' if p == 'secchi' else 'CAST(NULL AS VARCHAR) AS notes'} FROM ({lab}) WHERE {p} IS NOT NULL"""
        for p, u in (("tp", "mgl"), ("tn", "mgl"), ("chluncorr", "ugl"), ("chlcorr", "ugl"), ("secchi", "ft"), ("color", "ptco"), ("cond", "mscm"))
    )
    return f"""SELECT type, county, waterbody, parameter, location, units, count(*) AS n, {r6('sum(val)', 'total')}, count(notes) AS n_notes, count(date) AS n_dates,
      {day('min(date)', 'first')}, {day('max(date)', 'last')} FROM ({field} UNION ALL ({long})) GROUP BY 1, 2, 3, 4, 5, 6"""


def _built_tables() -> str:
    """The saved tables of the workload's whole build."""
    points = " UNION ALL ".join(f"SELECT '{s}' AS station, '{S.RAIN_STATIONS[s]}' AS name, CAST({lon} AS DOUBLE) AS lon, CAST({lat} AS DOUBLE) AS lat" for s, lat, lon in S.RAIN_STATION_COORDS)
    crossing = "(y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1"
    nice = f"replace(replace(replace({_words('nm')}, 'lower', 'Lower'), 'upper', 'Upper'), 'middle', 'Middle')"
    names = "CASE CAST(substr(station, 2, 1) AS INT) % 3 " + " ".join(f"WHEN {i} THEN '{{{i}}}'" for i in range(3)) + " END"
    ids = list(S.RAIN_STATIONS)
    station, name = names.format(*ids), names.format(*[S.RAIN_STATIONS[i] for i in ids])
    resolved = f"""SELECT waterbody, station, lon, WBID, CASE WHEN listed_id = 'R1' THEN 'P1' ELSE 'P2' END AS orig, WATERBODY_NAME AS nm,
      count(*) OVER (PARTITION BY waterbody, station) AS n FROM located"""
    in_gauge = f"SELECT g.station, id, count(*) FILTER ({crossing}) AS c FROM ({points}) g, edges GROUP BY g.station, id HAVING c % 2 = 1"
    return f"""SELECT 'stations' AS tab, waterbody || '_' || station AS a, WBID AS b, CASE WHEN nm IS NOT NULL THEN {nice} END AS c, {r6('lon', 'v')} FROM ({resolved}) WHERE NOT (n > 1 AND WBID <> orig)
      UNION ALL SELECT 'regions', id, {nice}, NULL, round(min(x1) + 1e-9, 6) + 0.0 FROM edges WHERE id IN (SELECT id FROM hits) GROUP BY id, nm
      UNION ALL SELECT 'gauges', g.station, g.name, id, round(lon + 1e-9, 6) + 0.0 FROM ({points}) g LEFT JOIN ({in_gauge}) h ON h.station = g.station
      UNION ALL SELECT 'rain', {station}, {name}, strftime(date, '%Y-%m-%d'), round(sum(precip_inches) + 1e-9, 6) + 0.0 FROM rain_months GROUP BY 1, 2, 3, 4"""


def _build_samples() -> str:
    """The tidy build over the raw sheets of the workload, written as SQL."""
    ok, surf = "l_orderkey % 50 <> 0", "l_linestatus = 'O'"
    cols = (
        ("temp", "surf", "f", "l_quantity", surf), ("temp", "bott", "f", "l_quantity", f"NOT ({surf})"),
        ("sal", "surf", "ppt", "l_discount", surf), ("sal", "bott", "ppt", "l_discount", f"NOT ({surf})"),
        ("ph", "surf", "su", "l_tax", surf),
    )
    field = " UNION ALL ".join(
        f"""SELECT 'physical' AS type, CASE county WHEN 'C1' THEN 'Okaloosa' WHEN 'C2' THEN 'Walton' ELSE county END AS county,
        'Red Fish Creek ' || waterbody AS waterbody, station, CAST(l_shipdate AS DATE) AS date, '{p}' AS parameter, '{loc}' AS location,
        '{u}' AS units, {e} AS val, CAST(NULL AS VARCHAR) AS notes FROM lineitem JOIN places ON l_suppkey = s_suppkey WHERE {ok} AND {at}"""
        for p, loc, u, e, at in cols
    )
    v = "CAST(value AS VARCHAR)"
    scrubbed = f"regexp_replace({_tokens('tp_text')}, '{S.LAB_JUNK}', '', 'g')"
    raw = f"""SELECT county, waterbody, station, CAST(ts AS DATE) AS date, event_id AS k, value, {_dirty_number('event_id', v)} AS tp_text,
      CASE event_id % 5 WHEN 0 THEN 'Bottom (' || {v} || ')' WHEN 1 THEN 'Weeds' WHEN 2 THEN 'S' WHEN 3 THEN 'Not Reported' END AS note
      FROM events JOIN places ON user_id % (SELECT count(*) FROM supplier) = s_suppkey WHERE WBID IS NOT NULL"""
    lab = f"""SELECT county, waterbody, station, date, {_number(scrubbed)} / 1000 AS tp, value / 1000 AS tn,
      {_depth('CASE WHEN k % 3 = 0 THEN value END', 'note')} AS secchi, CASE WHEN k % 4 = 0 THEN CAST(0.5 AS DOUBLE) ELSE value / 1000 END AS cond,
      CASE WHEN regexp_matches(note, 'Weeds|Bottom') THEN 'on bottom' END AS notes FROM ({raw})"""
    long = " UNION ".join(
        f"""SELECT 'discrete' AS type, county, 'GAP ' || waterbody AS waterbody, station, date, '{p}' AS parameter, 'surf' AS location,
        '{u}' AS units, {p} AS val, {'notes' if p == 'secchi' else 'CAST(NULL AS VARCHAR) AS notes'} FROM lab WHERE {p} IS NOT NULL"""
        for p, u in (("tp", "mgl"), ("tn", "mgl"), ("secchi", "ft"), ("cond", "mscm"))
    )
    return f"""SELECT type, county, waterbody, parameter, location, units, count(*) AS n, {r6('sum(val)', 'total')}, count(notes) AS n_notes,
      {day('min(date)', 'first')}, {day('max(date)', 'last')} FROM ({field} UNION ALL ({long.replace('FROM lab', f'FROM ({lab})')})) GROUP BY 1, 2, 3, 4, 5, 6"""


def _words(expr: str) -> str:
    """Each space-separated word with a capital first letter."""
    cap = "upper(substr(x, 1, 1)) || substr(x, 2)"
    return f"array_to_string(list_transform(string_split(lower({expr}), ' '), lambda x: {cap}), ' ')"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    temp = _pick("temp", "surf", True)
    count = count_text("n_stations")

    q["region_summary"] = _sql(f"""SELECT WBID, WATERBODY_NAME, {r6('val', 'val')}, n_stations, {count} AS stas,
      WATERBODY_NAME || ' (' || WBID || '), Value: ' || regexp_replace(format('{{:.2f}}', round(val, 2)), '\\.?0+$', '') || ', ' || {count} AS hover FROM ({_summary('region', temp)})""")
    q["station_summary"] = _sql(f"""SELECT waterbody || '_' || station AS stas, waterbody, station, {r6('val', 'val')}, WATERBODY_NAME, {r6('lon', 'lon')},
      {r6('lat', 'lat')}, waterbody || ' ' || station || ', Value: ' || regexp_replace(format('{{:.2f}}', round(val, 2)), '\\.?0+$', '') AS hover FROM ({_summary('station', temp)})""")
    two = _pair(("temp", "surf"), ("tp", "bott"))
    q["compare_region"] = _sql(f"SELECT WBID, WATERBODY_NAME, parameter, {r6('val', 'val')}, n_stations, {count} AS stas FROM ({_summary('region', two, 'parameter')})")
    both = _pair(("temp", "surf"), ("temp", "bott"))
    q["compare_region_blended"] = _sql(f"SELECT WBID, parameter, {r6('val', 'val')}, {count} AS stas FROM ({_summary('region', both, 'parameter')})")
    q["compare_region_by_location"] = _sql(f"SELECT WBID, parameter, location, {r6('val', 'val')}, {count} AS stas FROM ({_summary('region', both, 'parameter, location')})")
    q["compare_station"] = _sql(f"""SELECT waterbody || '_' || station AS stas, waterbody, station, parameter, {r6('val', 'val')}, {r6('lon', 'lon')}, {r6('lat', 'lat')}
      FROM ({_summary('station', two, 'parameter')})""")
    in_range = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
    q["compare_region_rain"] = _sql(f"""SELECT WBID, WATERBODY_NAME, parameter, {r6('val', 'val')}, n_stations, {count} AS stas FROM (
      {_summary('region', _pair(('temp', 'surf')), 'parameter')} UNION ALL
      SELECT WBID, WATERBODY_NAME, 'rain', avg(precip_inches), count(DISTINCT name || '_' || station) FROM rain_months
      JOIN gauges USING (station, name) JOIN regions USING (WBID, WATERBODY_NAME) WHERE {in_range} GROUP BY 1, 2)""")
    q["compare_station_rain"] = _sql(f"""SELECT waterbody || '_' || station AS stas, waterbody, station, parameter, {r6('val', 'val')} FROM (
      SELECT waterbody, station, parameter, val FROM ({_summary('station', _pair(('tn', 'bott')), 'parameter')}) UNION ALL
      SELECT name, station, 'rain', avg(precip_inches) FROM rain_months WHERE {in_range} GROUP BY 1, 2)""")

    q["region_daily"] = _sql(f"""SELECT WBID, {day('date', 'date')}, {r6('avg(val)', 'val')} FROM samples JOIN stations USING (waterbody, station)
      WHERE {temp} AND WBID IS NOT NULL GROUP BY WBID, samples.date""")
    q["station_daily"] = _sql(f"SELECT waterbody, station, {day('date', 'date')}, {r6('avg(val)', 'val')} FROM samples WHERE {temp} GROUP BY waterbody, station, samples.date")
    q["region_daily_by_param"] = _sql(f"""SELECT WBID, {day('date', 'date')}, parameter, location, {r6('avg(val)', 'val')} FROM samples
      JOIN stations USING (waterbody, station) WHERE val IS NOT NULL AND WBID IS NOT NULL GROUP BY WBID, samples.date, parameter, location""")
    q["rain_monthly"] = _sql(f"SELECT station, name, {day('date', 'date')}, {r6('precip_inches', 'precip_inches')} FROM rain_months")
    q["rain_month_parts"] = _sql(f"""SELECT station, year(date) AS year, month(date) AS month, {r6('precip_inches', 'monthly_total')}, {day('date', 'date')}
      FROM rain_months""")
    q["rain_by_choice"] = _sql(f"""SELECT station, name, {day('date', 'date')}, {r6('precip_inches', 'precip_inches')}, WBID, WATERBODY_NAME
      FROM rain_months JOIN gauges USING (station, name) WHERE name = 'R1' OR WBID = 'R1'""")
    q["rain_region_series"] = _sql(f"SELECT waterbody, {day('date', 'date')}, {r6('val', 'val')}, station, parameter, location FROM ({RAIN_REGION})")

    for name, args in {
        "period_year_ci": ("region", "temp", "surf", "year"),
        "period_station_raw_ci": ("station", "temp", "surf", "year"),
        "period_season_ci": ("station", "temp", "surf", "season"),
        "period_one_season": ("region", "tp", "bott", "winter"),
        "period_wet": ("region", "temp", "surf", "wet season"),
        "period_dry": ("station", "tn", "bott", "dry season"),
    }.items():
        q[name] = _sql(_period(*args))
    nulls = "CAST(NULL AS DOUBLE) AS lovl, CAST(NULL AS DOUBLE) AS hivl"
    q["period_rain_year"] = _sql(f"""SELECT name AS waterbody, station, 'rain' AS parameter, 'surf' AS location, {day("date_trunc('year', date)", 'date')},
      count(*) AS n, {r6('sum(precip_inches)', 'val')}, {nulls} FROM rain_months GROUP BY 1, 2, 3, 4, 5""")
    q["period_rain_season"] = _sql(f"""SELECT {SERIES}, {day('start', 'date')}, count(*) AS n, {r6('sum(val)', 'val')}, {nulls}
      FROM ({_runs(RAIN_REGION, SERIES, SEASON)}) GROUP BY {SERIES}, start""")
    months = f"SELECT DISTINCT waterbody, station, CAST(date_trunc('month', date) AS DATE) AS date FROM samples WHERE {_pick('temp', 'surf')}"
    q["season_runs"] = _sql(f"SELECT waterbody, station, {day('date', 'month')}, label, CAST(run AS BIGINT) AS run, {day('start', 'start')} FROM ({_runs(months, 'waterbody, station', SEASON)})")

    def trend_out(keys: str, inner: str) -> str:
        return _sql(f"SELECT {keys}, {day('date', 'date')}, {r6('val', 'val')}, {r6('trend', 'trend')} FROM ({inner})")

    q["trend_complete"] = trend_out("WBID", _trend(_area_daily("region", "temp"), "WBID"))
    q["trend_recent"] = trend_out("waterbody, station", _trend(_area_daily("station", "temp"), "waterbody, station", *_recent(3)))
    q["trend_recent_too_short"] = trend_out("WBID", _trend(_area_daily("region", "tp"), "WBID", *_recent(9)))
    shorter = "date_diff('day', olo, ohi) < date_diff('day', min(date) OVER w, max(date) OVER w)"
    other = f"SELECT waterbody, station, min(date) AS olo, max(date) AS ohi FROM ({_rows('station', 'temp', 'bott')}) GROUP BY 1, 2"
    rows = f"SELECT * FROM ({_rows('station', 'temp', 'surf')}) LEFT JOIN ({other}) USING (waterbody, station)"
    q["trend_shortest"] = trend_out(
        "waterbody, station",
        _trend(rows, "waterbody, station", f"CASE WHEN {shorter} THEN olo ELSE min(date) OVER w END", f"CASE WHEN {shorter} THEN ohi ELSE max(date) OVER w END"),
    )
    q["moments_complete"], q["moments_recent"] = q["trend_complete"], q["trend_recent"]
    near = f"SELECT * FROM ({_area_daily('station', 'temp')}) LEFT JOIN ({other}) USING (waterbody, station)"
    ends = (f"CASE WHEN {shorter} THEN {o} ELSE {m}(date) OVER w END" for o, m in (("olo", "min"), ("ohi", "max")))
    q["moments_shortest"] = trend_out("waterbody, station", _trend(near, "waterbody, station", *ends))
    four = "waterbody, station, other_waterbody, other_station"
    ends = [f"CASE WHEN {shorter} THEN {o} ELSE {m}(date) OVER w END" for o, m in (("olo", "min"), ("ohi", "max"))]

    def paired(pairs: str, spans: str) -> str:
        rows = f"""SELECT r.waterbody, r.station, other_waterbody, other_station, r.date, r.val, olo, ohi FROM ({_rows('station', 'temp', 'surf')}) r JOIN ({pairs}) USING (waterbody, station)
          LEFT JOIN ({spans}) s ON s.waterbody = other_waterbody AND s.station = other_station"""
        return trend_out(four, _trend(rows, four, *ends))

    following = "SELECT a.waterbody, a.station, b.waterbody AS other_waterbody, b.station AS other_station FROM stations a JOIN stations b ON CAST(b.station AS BIGINT) = CAST(a.station AS BIGINT) + 1"
    q["pair_stations"] = paired(following, other)
    gauge = "SELECT a.waterbody, a.station, g.name AS other_waterbody, g.station AS other_station FROM stations a JOIN gauges g ON g.station = 'G' || CAST(CAST(a.station AS BIGINT) % 7 AS VARCHAR)"
    rained = "SELECT name AS waterbody, station, min(date) AS olo, max(date) AS ohi FROM rain_months WHERE date BETWEEN DATE '1994-07-01' AND DATE '1995-12-31' GROUP BY 1, 2"
    q["pair_station_gauge"] = paired(gauge, rained)
    rain_span = f"SELECT waterbody, min(date) AS olo, max(date) AS ohi FROM ({RAIN_REGION}) GROUP BY 1"
    rows = f"SELECT * FROM ({_rows('region', 'temp', 'surf')}) LEFT JOIN ({rain_span}) USING (waterbody)"
    q["trend_shortest_region"] = trend_out(
        "waterbody",
        _trend(rows, "waterbody", f"CASE WHEN {shorter} THEN olo ELSE min(date) OVER w END", f"CASE WHEN {shorter} THEN ohi ELSE max(date) OVER w END"),
    )

    def chosen(inner: str, waterbody: str, station: str) -> str:
        return _sql(f"SELECT * FROM ({inner}) WHERE waterbody = '{waterbody}' AND station = '{station}'")

    q["selected_station"] = chosen(_period("station", "temp", "surf", "year"), "NATION_15", "0")
    q["selected_region"] = chosen(_period("region", "tn", "bott", "season"), "R1", "R1")
    q["selected_none"] = _sql(f"SELECT * FROM ({_period('region', 'tn', 'bott', 'year')}) WHERE FALSE")
    yearly = f"SELECT waterbody, CAST(date_trunc('year', date) AS DATE) AS date, avg(val) AS val FROM ({_rows('region', 'temp', 'surf')}) GROUP BY 1, 2"
    q["trend_period"] = _sql(f"""SELECT waterbody, {day('date', 'date')}, {r6('val', 'val')}, {r6('trend', 'trend')}, {r6('c.value', 'criterion')}
      FROM ({_trend(yearly, 'waterbody')}) t LEFT JOIN region_criteria c ON c.WBID = t.waterbody AND c.parameter = 'tem'""")

    q["criteria_lookup"] = _sql(f"""SELECT WBID AS area, parameter, {r6('value', 'value')} FROM region_criteria UNION ALL
      SELECT waterbody || '_' || station, parameter, round(value + 1e-9, 6) + 0.0 FROM station_criteria""")
    q["series_with_criterion"] = _sql(f"""SELECT d.WBID, {day('date', 'date')}, {r6('val', 'val')}, {r6('c.value', 'criterion')} FROM ({_area_daily('region', 'chlcorr')}) d
      LEFT JOIN region_criteria c ON c.WBID = d.WBID AND c.parameter = 'chl'""")
    figures = f"{r6('round(val, 2)', 'shown')}, {r6('CAST(0 AS DOUBLE)', 'scale_min')}, {r6('top', 'scale_max')}, {r6('criterion', 'criterion')}, 'mg/L' AS unit"
    q["gauge"] = _gauge("region", "tn", f"WBID, {figures}")
    q["gauge_station"] = _gauge("station", "tp", f"waterbody || '_' || station AS stas, {figures}")
    q["gauge_celsius"] = _gauge("region", "temp", f"WBID, {r6('round(val, 2)', 'shown')}, {r6('round((val - 32) * CAST(5 AS DOUBLE) / 9, 2)', 'shown_celsius')}, {r6('top', 'scale_max')}, 'F / C' AS unit")

    q["param_catalogue"] = _sql(f"SELECT type, units, location, parameter, {day('datestr', 'datestr')}, {day('dateend', 'dateend')}, label, labelnouni FROM catalogue")
    q["station_span"] = _sql(f"""SELECT st.waterbody, st.station, {day('min(date)', 'datestr')}, {day('max(date)', 'dateend')} FROM stations st
      LEFT JOIN samples s ON s.waterbody = st.waterbody AND s.station = st.station GROUP BY 1, 2""")
    q["overview"] = _sql("""SELECT format('{:,}', count(*)) AS samples, count(DISTINCT parameter) AS n_parameters,
      (SELECT count(*) FROM stations) AS n_stations, count(DISTINCT waterbody) AS n_waterbodies,
      CAST(year(min(date)) AS VARCHAR) || ' to ' || CAST(year(max(date)) AS VARCHAR) AS years FROM samples""")
    q["param_choices"] = _sql("""SELECT parameter || '_' || location AS choice, regexp_replace(coalesce(labelnouni, 'NA') || ': ' || CASE WHEN location = 'surf' AND cnt = 2 THEN 'Surface'
        WHEN location = 'bott' THEN 'Bottom' WHEN location = 'surf' AND cnt = 1 THEN '' ELSE location END, ': $', '') AS label FROM (
        SELECT p.parameter, p.location, c.labelnouni, count(*) OVER (PARTITION BY p.parameter) AS cnt FROM (
          SELECT DISTINCT parameter, location FROM samples WHERE date BETWEEN DATE '1996-01-01' AND DATE '2024-12-31') p
        LEFT JOIN (SELECT DISTINCT parameter, labelnouni FROM catalogue) c ON c.parameter = p.parameter)
      UNION ALL SELECT 'rain', 'Rainfall' WHERE EXISTS (SELECT 1 FROM rain_months WHERE date BETWEEN DATE '1996-01-01' AND DATE '2024-12-31')""")
    q["parameter_list"] = _sql("SELECT DISTINCT parameter, labelnouni FROM catalogue")
    q["location_choices"] = _sql("""SELECT DISTINCT parameter, CASE location WHEN 'surf' THEN 'Surface' ELSE 'Bottom' END AS label, location,
      CAST(CASE location WHEN 'surf' THEN 1 ELSE 2 END AS BIGINT) AS place FROM catalogue WHERE location IN ('surf', 'bott')""")
    ends = "SELECT min(date) AS a, max(date) AS b FROM samples WHERE parameter IN ('temp', 'tp') AND location = 'surf'"
    q["date_choices"] = _sql(f"""SELECT {day('d', 'date')} FROM (SELECT a AS d FROM ({ends}) UNION SELECT b FROM ({ends}) UNION
      SELECT CAST(unnest(generate_series(date_trunc('month', a) + INTERVAL 1 MONTH, date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) FROM ({ends}))""")
    q["waterbody_list"] = _sql("SELECT DISTINCT waterbody FROM samples")
    q["axis_labels"] = _sql(f"""SELECT parameter, location, 'Mean ' || coalesce(label, 'NA') || CASE WHEN k = 1 THEN '' WHEN location = 'surf' THEN ': Surface' ELSE ': Bottom' END AS axis_label
      FROM (SELECT DISTINCT parameter, location, label FROM catalogue) JOIN (SELECT parameter, count(DISTINCT location) AS k FROM catalogue GROUP BY 1) USING (parameter)
      UNION ALL SELECT 'rain', 'rain', '{S.RAIN_SERIES_LABEL}'""")
    q["titles"] = _sql("""SELECT DISTINCT WBID AS id, WATERBODY_NAME || ' (' || WBID || ')' AS title FROM stations WHERE WBID IS NOT NULL UNION ALL
      SELECT DISTINCT waterbody || '_' || station, waterbody || ' (' || station || ')' FROM stations""")
    q["export_filtered"] = _sql(f"""SELECT county, waterbody, station, {day('date', 'date')}, parameter, location, units, {r6('val', 'val')}, notes FROM samples
      WHERE waterbody IN ('NATION_1', 'NATION_3', 'NATION_20') AND parameter IN ('temp', 'tn') AND {in_range}""")
    q["table_view"] = _sql(f"""SELECT county, waterbody, station, {day('date', 'date')}, parameter, location, units, {r6('round(val, 3)', 'val')} FROM samples
      WHERE waterbody IN ('NATION_1', 'NATION_3', 'NATION_20') AND parameter = 'tp' AND {in_range}""")
    number = "regexp_replace(CAST(round(v + 1e-9, 6) AS VARCHAR), '\\.0$', '')"
    q["export_csv"] = _sql(f"""SELECT '"' || WBID || '",' || strftime(date, '%Y-%m-%d') || ',' || {number} || ',NA' AS line FROM (
      SELECT WBID, samples.date AS date, avg(val) AS v FROM samples JOIN stations USING (waterbody, station) WHERE {temp} AND WBID IS NOT NULL GROUP BY 1, 2)""")
    q["table_round_trip"] = _sql(f"""SELECT type, parameter, location, count(*) AS n, count(val) AS n_val, {r6('sum(val)', 'total')}, {day('min(date)', 'first')}
      FROM samples GROUP BY 1, 2, 3""")

    q["unpivot_samples"] = _sql(f"SELECT county, waterbody, station, {day('date', 'date')}, var, {r6('val', 'val')} FROM ({_long_field()})")
    q["split_names"] = _sql(f"""SELECT string_split(var, '_')[1] AS parameter, string_split(var, '_')[2] AS location, string_split(var, '_')[3] AS units, count(*) AS n,
      {r6('sum(val)', 'total')} FROM ({_long_field()}) WHERE val IS NOT NULL GROUP BY 1, 2, 3""")
    q["tagged_union"] = _sql(f"""SELECT type, county, parameter, location, units, count(*) AS n, count(notes) AS n_notes, {r6('sum(val)', 'total')} FROM samples
      WHERE val IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")
    keys = "county, waterbody, station, date, parameter, val"
    q["notes_join"] = _sql(f"""SELECT county, waterbody, station, {day('date', 'date')}, parameter, {r6('val', 'val')}, location, units, notes FROM
      (SELECT DISTINCT {keys}, location, units FROM discrete) LEFT JOIN (SELECT DISTINCT {keys}, notes FROM discrete) USING ({keys})""")
    scrubbed = f"regexp_replace({_tokens('number')}, '{S.LAB_JUNK}', '', 'g')"
    q["clean_scrub"] = _sql(f"SELECT key, {r6(_number(scrubbed), 'number')} FROM dirty")
    q["clean_waterbody"] = _sql(f"SELECT key, {_chain('waterbody', S.WATERBODY_FIXES)} AS waterbody FROM dirty")
    q["clean_units"] = _sql(f"""SELECT key, {r6('coalesce(ms, us / 1000)', 'cond')}, {r6('us / 1000', 'mgl')}, {r6('round((us - 32) * CAST(5 AS DOUBLE) / 9, 2)', 'celsius')},
      {r6('greatest(us - 1000, CAST(0 AS DOUBLE))', 'clamped')}, 'mg/L' AS unit FROM dirty""")
    flag = "coalesce(regexp_matches(note, 'Weeds|Bottom'), FALSE)"
    q["note_depth"] = _sql(f"SELECT key, {r6(_depth('depth', 'note'), 'depth')}, {flag} AS flag, CASE WHEN {flag} THEN 'on bottom' END AS notes FROM dirty")
    q["recode"] = _sql("""SELECT key, CASE county WHEN 'okaloosa' THEN 'Okaloosa' WHEN 'walton' THEN 'Walton' ELSE county END AS county,
      CASE WBID WHEN '959F' THEN '959C' WHEN '46' THEN '49F' ELSE WBID END AS WBID FROM dirty""")
    q["capitalise"] = _sql(f"""SELECT key, replace(replace(replace({_words('title')}, 'lower', 'Lower'), 'upper', 'Upper'), 'middle', 'Middle') AS title FROM dirty""")
    q["dates_typed"] = _sql(f"""SELECT key, {day('d', 'date')}, {day("date_trunc('month', d)", 'month')}, {day("date_trunc('year', d)", 'year')},
      {day('d - CAST(dayofweek(d) AS INT)', 'week')}, CASE WHEN d IS NOT NULL THEN {WET.format('d')} END AS wetdry,
      CASE WHEN d IS NOT NULL THEN {SEASON.format('d')} END AS season, epoch_us(CAST(d AS TIMESTAMP)) // 1000 AS ms FROM (SELECT key, {_mdy('day')} AS d FROM dirty)""")
    q["exclude_stations"] = _sql("""SELECT s.waterbody, count(*) AS n, count(DISTINCT s.station) AS n_stations FROM samples s JOIN listed USING (waterbody, station)
      WHERE parameter = 'temp' GROUP BY 1""")
    q["build_samples"] = _sql(_build_samples())
    q["sheets_to_samples"] = q["build_samples"]
    q["full_sheets"], q["built_tables"] = _sql(_full_samples()), _sql(_built_tables())
    q["station_sheet"] = _sql(f"SELECT waterbody, station, name, WBID AS WBIDorig, {r6('lon', 'lon')}, {r6('lat', 'lat')} FROM stations")
    q["criteria_sheet"] = _sql(f"SELECT waterbody, station, WBID, parameter, {r6('value', 'value')} FROM criteria")
    q["criteria_long"] = _sql(f"SELECT waterbody, station, WBID, parameter, {r6('value', 'value')} FROM criteria")
    q["key_build"] = _sql("SELECT waterbody || '_' || station AS stas, coalesce(WBID, 'NA') || '_' || station AS other FROM stations")
    q["key_split"] = _sql("SELECT waterbody || '_' || station AS key, waterbody, station FROM stations")
    q["pivot_wide"] = _sql(f"""SELECT waterbody, station, {day('CAST(timestamp AS DATE)', 'date')}, {r6('max(temp_f)', 'temp_f')}, {r6('max(sal_ppt)', 'sal_ppt')}
      FROM readings GROUP BY 1, 2, CAST(timestamp AS DATE)""")

    q["point_region_join"] = _sql(f"SELECT waterbody, station, {r6('lon', 'lon')}, {r6('lat', 'lat')}, WBID, WATERBODY_NAME FROM located")
    nice = f"replace(replace(replace({_words('nm')}, 'lower', 'Lower'), 'upper', 'Upper'), 'middle', 'Middle')"
    rings = "CASE WHEN id = 'P3' THEN 2 ELSE 1 END"
    q["regions_hit"] = _sql(f"""SELECT id AS WBID, {nice} AS WATERBODY_NAME, {rings} AS n_rings, {r6('min(x1)', 'xmin')}, {r6('max(y1)', 'ymax')} FROM edges
      WHERE id IN (SELECT id FROM hits) GROUP BY id, nm""")
    resolved = "SELECT waterbody, station, WBID, CASE WHEN listed_id = 'R1' THEN 'P1' ELSE 'P2' END AS orig, count(*) OVER (PARTITION BY waterbody, station) AS n FROM located"
    q["resolve_multi_region"] = _sql(f"SELECT waterbody, station, WBID FROM ({resolved}) WHERE NOT (n > 1 AND WBID <> orig)")
    q["unresolved_stations"] = _sql("""SELECT waterbody, station FROM located GROUP BY 1, 2 HAVING count(*) > 1 AND count(CASE WHEN WBID = 'P3' THEN 1 END) = 0""")
    b = w.BOX
    box = f"lon BETWEEN CAST({b['xmin']} AS DOUBLE) AND CAST({b['xmax']} AS DOUBLE) AND lat BETWEEN CAST({b['ymin']} AS DOUBLE) AND CAST({b['ymax']} AS DOUBLE)"
    q["in_bbox"] = _sql(f"SELECT waterbody, station, {r6('lon', 'lon')}, {r6('lat', 'lat')} FROM stations WHERE {box}")
    two = "CASE WHEN CAST(station AS BIGINT) % 5 = 0 OR CAST(station AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END"
    right = "lon + CASE WHEN CAST(station AS BIGINT) % 5 = 0 THEN CAST(0.03 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END"
    q["geojson_regions"] = _sql(f"""SELECT station AS WBID, name AS WATERBODY_NAME, {two} AS n_rings, 4 * {two} AS n_points, {r6('lon', 'xmin')},
      {r6(right, 'xmax')}, {r6('lat', 'ymin')}, {r6('lat + 0.01', 'ymax')} FROM stations""")
    q["json_rain"] = _sql(f"""SELECT station, CASE station WHEN 'G1' THEN 'first' WHEN 'G2' THEN 'second' WHEN 'G3' THEN 'third' WHEN 'G4' THEN 'fourth' END AS name,
      {day('date', 'date')}, {r6('precip_inches', 'precip_inches')} FROM rain_months""")

    q["dq_physical_stations"] = _missing_keys("SELECT * FROM physical", "SELECT * FROM listed")
    q["dq_discrete_stations"] = _missing_keys("SELECT * FROM discrete", "SELECT * FROM listed")
    q["dq_continuous_stations"] = _missing_keys("SELECT * FROM readings", "SELECT * FROM listed")
    q["dq_time_steps"] = f"""SELECT station, count(*) AS n, {stamp('min(t)', 'first')} FROM (SELECT CAST(l_suppkey AS VARCHAR) AS station, l_shipdate AS t,
      lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS p FROM lineitem) WHERE t <= p GROUP BY 1"""
    q["dq_counties"] = _mismatch("county", ("C0", "C1", "C2", "C9"))
    q["dq_dates"] = _sql(f"SELECT {day('samples.date', 'date')}, count(*) AS n FROM samples WHERE date < DATE '1995-06-01' OR date > DATE '2023-12-31' GROUP BY samples.date")
    q["dq_locations_box"] = _sql(f"SELECT waterbody, station FROM stations WHERE NOT ({box})")
    q["dq_criteria_stations"] = _missing_keys("SELECT * FROM samples", "SELECT * FROM criteria WHERE parameter = 'chl'")
    q["dq_criteria_regions"] = _missing_keys("SELECT * FROM criteria", "SELECT * FROM regions WHERE WBID <> 'R3'", "WBID")
    q["dq_parameters"] = _missing_keys("SELECT * FROM samples", "SELECT * FROM catalogue WHERE label IS NOT NULL", "parameter")
    q["dq_rain_values"] = _sql(f"SELECT station, name, {day('date', 'date')}, {r6('precip_inches - 0.1', 'precip_inches')} FROM rain_daily WHERE precip_inches - CAST(0.1 AS DOUBLE) < 0")
    q["dq_rain_dates"] = _sql(f"SELECT {day('r.date', 'date')}, count(*) AS n FROM rain_months r WHERE date < DATE '1995-03-01' OR date > DATE '2001-05-31' GROUP BY r.date")
    q["dq_rain_gauges"] = _missing_keys("SELECT * FROM rain_daily", "SELECT * FROM gauges WHERE WBID IS NOT NULL", "station")
    q["dq_gauge_regions"] = _region_problems("gauges", "WBID <> 'R2'", ("R0", "R1", "R2"), 2)
    q["dq_sample_locations"] = _sql("SELECT 'bottom' AS location, count(*) AS n FROM samples WHERE location = 'bott'")
    q["dq_waterbodies"] = _mismatch("waterbody", ("NATION_0", "NATION_1", "NATION_99"))
    q["dq_station_regions"] = _region_problems("stations", "WBID <> 'R4'", ("R0", "R1", "R2"), 2)
    q["dq_without_region"] = _sql("""SELECT count(DISTINCT s.waterbody || '_' || s.station) AS n_stations, count(*) AS n_samples FROM samples s
      JOIN stations st ON st.waterbody = s.waterbody AND st.station = s.station WHERE st.WBID IS NULL""")
    audited = {
        "physical stations": "dq_physical_stations", "discrete stations": "dq_discrete_stations", "continuous stations": "dq_continuous_stations",
        "time steps": "dq_time_steps", "counties": "dq_counties", "sample dates": "dq_dates", "station box": "dq_locations_box",
        "station criteria": "dq_criteria_stations", "criteria regions": "dq_criteria_regions", "parameters": "dq_parameters",
        "rain values": "dq_rain_values", "rain dates": "dq_rain_dates", "rain gauges": "dq_rain_gauges", "gauge regions": "dq_gauge_regions",
        "sample locations": "dq_sample_locations", "waterbodies": "dq_waterbodies", "station regions": "dq_station_regions",
    }
    counted = " UNION ALL ".join(f"SELECT '{name}' AS \"check\", count(*) AS violations FROM ({q[key]})" for name, key in audited.items())
    q["dq_audit"] = f'SELECT "check", violations, violations = 0 AS passed FROM ({counted})'

    q["cont_station_mean"] = _sql(f"""SELECT r.waterbody, r.station, 'temp_f' AS variable, {r6('avg(temp_f)', 'val')}, WATERBODY_NAME, {r6('lon', 'lon')}, {r6('lat', 'lat')}
      FROM readings r LEFT JOIN stations s ON s.waterbody = r.waterbody AND s.station = r.station
      WHERE timestamp >= TIMESTAMP '2024-01-02' AND timestamp <= TIMESTAMP '2024-01-25' GROUP BY r.waterbody, r.station, WATERBODY_NAME, lon, lat""")
    q["cont_gauge"] = _sql(f"""SELECT waterbody || '_' || station AS stas, {r6('round(m, 2)', 'shown')}, {r6('CAST(0 AS DOUBLE)', 'scale_min')},
      {r6('round(max(m) OVER (), 2)', 'scale_max')}, 'F' AS unit FROM (SELECT waterbody, station, avg(temp_f) AS m FROM readings GROUP BY 1, 2)""")
    daily = "SELECT waterbody, station, CAST(timestamp AS DATE) AS date, avg(temp_f) AS val FROM readings GROUP BY 1, 2, 3"
    q["cont_day_trend"] = trend_out("waterbody, station", _trend(daily, "waterbody, station"))
    wave = "cos((hour(timestamp) - 16) * pi() / 12)"
    left = f"greatest(regr_syy(temp_f, {wave}) - regr_sxy(temp_f, {wave}) * regr_slope(temp_f, {wave}), 0)"
    q["cont_cycle"] = _sql(f"""SELECT waterbody, station, 'temp_f' AS variable, count(temp_f) AS n, {r6(f'regr_intercept(temp_f, {wave})', 'level')},
      {r6(f'regr_slope(temp_f, {wave})', 'amplitude')}, CASE WHEN count(temp_f) > 2 THEN round(sqrt({left} / (count(temp_f) - 2)) + 1e-9, 6) + 0.0 END AS spread
      FROM readings WHERE temp_f IS NOT NULL GROUP BY 1, 2""")
    for p in ("day", "week", "month", "quarter", "year"):
        q[f"cont_{p}"] = _cont(p)
    x = "(epoch_us(timestamp) / CAST(1000 AS DOUBLE))"
    q["cont_trend"] = _sql(f"""SELECT waterbody, station, {stamp('timestamp', 'timestamp')}, {r6('sal_ppt', 'val')}, {r6(f'''CASE WHEN count(*) OVER w > 1 THEN
      coalesce(avg(sal_ppt) OVER w + regr_slope(sal_ppt, {x}) OVER w * ({x} - regr_avgx(sal_ppt, {x}) OVER w), avg(sal_ppt) OVER w) END''', 'trend')} FROM readings
      WHERE sal_ppt IS NOT NULL WINDOW w AS (PARTITION BY waterbody, station)""")
    reach = "CAST(1.5 AS DOUBLE) * (q3 - q1)"
    figures = f"""SELECT b.station, b.n, b.q1, b.q2, b.q3, min(precip_inches) FILTER (precip_inches >= q1 - {reach}) AS wl,
      max(precip_inches) FILTER (precip_inches <= q3 + {reach}) AS wh,
      count(*) FILTER (precip_inches < q1 - {reach} OR precip_inches > q3 + {reach}) AS outside
      FROM ({{0}}) d JOIN ({{1}}) b ON b.station = d.station WHERE precip_inches > 0 GROUP BY ALL"""
    plain = "SELECT station, date, precip_inches FROM rain_daily"
    q["rain_distribution"] = _sql(f"""SELECT station, n, {r6('q1', 'q25')}, {r6('q2', 'median')}, {r6('q3', 'q75')}, {r6('wl', 'whisker_low')}, {r6('wh', 'whisker_high')},
      outside AS n_outliers FROM ({figures.format(plain, _box(plain))})""")
    q["rain_gaps_parts"] = _sql(f"""SELECT station, year(date) AS year, month(date) AS month, {r6('coalesce(sum(CASE WHEN NOT isnan(precip_inches) THEN precip_inches END), 0)', 'monthly_total')},
      {day("date_trunc('month', min(date))", 'date')} FROM rain_gaps GROUP BY 1, 2, 3""")
    whole = "SELECT station, date, precip_inches FROM rain_gaps WHERE NOT isnan(precip_inches)"
    q["rain_gaps_distribution"] = _sql(f"""SELECT station, n, {r6('q1', 'q25')}, {r6('q2', 'median')}, {r6('q3', 'q75')}, {r6('wl', 'whisker_low')}, {r6('wh', 'whisker_high')},
      outside AS n_outliers FROM ({figures.format(whole, _box(whole))})""")
    q["dq_rain_gaps"] = _sql(f"""SELECT {day('date', 'date')}, count(*) AS n, nullif(count(*) FILTER (precip_inches IS NULL OR isnan(precip_inches) OR precip_inches < 0), 0) AS n_bad FROM rain_gaps
      WHERE date IS NULL OR date < DATE '1995-03-01' OR date > DATE '2001-05-31' GROUP BY date""")
    q["dq_missing_dates"] = _sql(f"""SELECT {day('d', 'date')}, count(*) AS n FROM (SELECT CASE WHEN day(date) <> 29 THEN date END AS d FROM samples WHERE parameter = 'temp')
      WHERE d IS NULL OR d < DATE '1995-06-01' OR d > DATE '1998-01-31' GROUP BY d""")
    q["dates_spelled"] = _sql(f"SELECT p_partkey AS key, CASE WHEN p_partkey % 14 < {len(w.DATE_SPELLINGS)} THEN strftime(DATE '1999-01-01' + CAST(p_partkey % 20000 AS INT), '%Y-%m-%d') END AS date FROM part")
    cubed = "SELECT station, date, pow(precip_inches, 3) AS precip_inches FROM rain_daily"
    q["rain_outliers"] = _sql(f"""SELECT d.station, {day('d.date', 'date')}, {r6('d.precip_inches', 'precip_inches')} FROM ({cubed}) d
      JOIN ({figures.format(cubed, _box(cubed))}) b ON b.station = d.station WHERE d.precip_inches < wl OR d.precip_inches > wh""")

    q["station_grid"] = _sql("SELECT DISTINCT waterbody, station, type FROM stations, (VALUES ('temp_f'), ('sal_ppt')) AS v(type)")
    q["running_totals"] = _sql(f"""SELECT station, {day('date', 'date')}, {r6('inches', 'inches')}, {r6('sum(inches) OVER (PARTITION BY station ORDER BY date)', 'so_far')}
      FROM (SELECT station, date, sum(precip_inches) AS inches FROM rain_daily GROUP BY 1, 2)""")

    q["stream_dedupe"] = _sql(f"""SELECT waterbody, station, variable, count(*) AS n, {r6('sum(val)', 'total')} FROM (
      SELECT DISTINCT waterbody, station, 'temp_f' AS variable, timestamp, temp_f AS val FROM readings UNION ALL
      SELECT DISTINCT waterbody, station, 'sal_ppt', timestamp, sal_ppt FROM readings) GROUP BY 1, 2, 3""")
    window = """SELECT waterbody, station, 'temp_f' AS variable, time_bucket(INTERVAL 15 MINUTE, timestamp) AS date, count(temp_f) AS n, avg(temp_f) AS m,
      var_samp(temp_f) AS v FROM readings GROUP BY 1, 2, 3, 4"""
    bounds = with_bounds(window, "waterbody, station, variable").replace(day("date", "date"), stamp("date", "start"))
    q["stream_window_mean"] = _sql(bounds)
    q["stream_enriched"] = _sql(f"""SELECT {stamp('r.date', 'start')}, r.waterbody, r.station, n, {r6('m', 'val')}, s.WBID, {r6('c.value * 1000', 'criterion')}, m > c.value * 1000 AS above
      FROM ({window}) r JOIN stations s ON s.waterbody = r.waterbody AND s.station = r.station
      LEFT JOIN station_criteria c ON c.waterbody = r.waterbody AND c.station = r.station AND c.parameter = 'tn'""")
    q["stream_dq"] = _sql("SELECT r.waterbody, r.station, count(*) AS n FROM readings r JOIN stations s ON s.waterbody = r.waterbody AND s.station = r.station WHERE s.WBID IS NULL GROUP BY 1, 2")
    q["stream_steps"] = _sql("""SELECT waterbody, station, count(*) AS n FROM (SELECT waterbody, station, timestamp AS t,
      lag(timestamp) OVER (PARTITION BY waterbody, station ORDER BY event_id DESC) AS p FROM readings) WHERE t <= p GROUP BY 1, 2""")
    q["stream_gaps"] = _sql(f"""SELECT waterbody, station, {stamp('gap_start', 'gap_start')}, {stamp('first', 'gap_end')}, {r6('(epoch_us(first) - epoch_us(gap_start)) / CAST(1000000 AS DOUBLE)', 'seconds')} FROM (
      SELECT *, lag(last) OVER (PARTITION BY waterbody, station ORDER BY first) AS gap_start FROM (
        SELECT waterbody, station, min(timestamp) AS first, max(timestamp) AS last FROM (
          SELECT *, sum(CASE WHEN timestamp > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY waterbody, station ORDER BY timestamp) AS run FROM (
            SELECT *, lag(timestamp) OVER (PARTITION BY waterbody, station ORDER BY timestamp) AS p FROM readings))
        GROUP BY waterbody, station, run)
      WHERE last + INTERVAL 6 HOUR <= (SELECT max(timestamp) FROM readings) - INTERVAL 1 HOUR) WHERE gap_start IS NOT NULL""")
    arriving = """SELECT *, (a - min(a) OVER ()) * 4 // (max(a) OVER () - min(a) OVER () + 1) AS part FROM (
      SELECT *, epoch_us(timestamp) + CAST({0} + after AS BIGINT) * 60000000 AS a FROM (SELECT *, unnest({1}) AS after FROM readings))"""
    sent = arriving.format("CASE WHEN event_id % 10 = 0 THEN 720 ELSE 0 END", "CASE WHEN event_id % 7 = 0 THEN [0, 5] ELSE [0] END")
    q["stream_late"] = _sql(f"""SELECT waterbody, station, variable, kind, count(*) AS n FROM (
      SELECT *, CASE WHEN late THEN 'late' WHEN row_number() OVER (PARTITION BY waterbody, station, variable, timestamp, late ORDER BY part) > 1 THEN 'repeated' ELSE 'kept' END AS kind FROM (
        SELECT r.*, variable, coalesce(timestamp < before - INTERVAL 1 HOUR, FALSE) AS late FROM ({sent}) r
        JOIN (SELECT part, lag(newest) OVER (ORDER BY part) AS before FROM (
          SELECT part, max(max(timestamp)) OVER (ORDER BY part) AS newest FROM ({sent}) GROUP BY part)) USING (part), (VALUES ('temp_f'), ('sal_ppt')) AS v(variable)))
      GROUP BY ALL""")
    sent = arriving.format("CASE WHEN event_id % 10 = 0 THEN 720 WHEN event_id % 3 = 0 THEN 30 ELSE 0 END", "[0]")
    q["stream_late_steps"] = _sql(f"""SELECT waterbody, station, {stamp('timestamp', 'timestamp')}, {stamp('previous', 'previous')} FROM (
      SELECT *, lag(timestamp) OVER w AS previous, max(timestamp) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ({sent}) WINDOW w AS (PARTITION BY waterbody, station ORDER BY a))
      WHERE timestamp <= previous AND timestamp < newest - INTERVAL 1 HOUR""")
    q["stream_snapshot"] = q["stream_window_mean"]
    q["stream_rain_month"] = _sql(f"SELECT station, name, {day('date', 'date')}, {r6('precip_inches', 'precip_inches')} FROM rain_months")
    return q
