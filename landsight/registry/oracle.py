"""DuckDB oracle SQL for every registered query (run on the same parquet tables).

Written independently of the Spark code: the test-table adapters and the
cleaning rules are plain SQL CTEs here, and every statement is the literal
reading of the semantics (left joins over the boundary x group grid, window
ranks), not the aggregated plans the Spark side uses.
"""

from __future__ import annotations

from ..config import DEFAULT_MODEL_CONFIG

# Python whitespace set (str.isspace) as an RE2 class.
_WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(expr: str) -> str:
    return f"regexp_replace(CAST({expr} AS VARCHAR), '^{_WS}+|{_WS}+$', '', 'g')"


def _num(expr: str) -> str:
    t = _strip(expr)
    return (
        f"(CASE WHEN isnan(TRY_CAST({t} AS DOUBLE)) THEN NULL "
        f"ELSE TRY_CAST({t} AS DOUBLE) END)"
    )


_NCODE = "'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')"

ADAPTERS = f"""
boundary AS (
  SELECT CASE WHEN n_nationkey >= 23 THEN '-99' ELSE {_NCODE} END AS ISO_A3,
         n_name AS ADMIN
  FROM nation
),
observation AS (
  SELECT CASE l_linenumber % 3 WHEN 0 THEN 'annual_deforestation'
              WHEN 1 THEN 'share_degraded_land' ELSE 'share_protected_land' END AS dataset,
         n_name AS Entity,
         CASE WHEN l_linenumber = 7 THEN NULL
              WHEN l_linenumber = 6 THEN 'OWID_WRL'
              WHEN n_nationkey > 20 THEN 'US'
              WHEN l_linenumber = 5 THEN chr(9) || {_NCODE} || ' '
              ELSE {_NCODE} END AS Code,
         CASE WHEN l_quantity = 50 THEN 'n/a' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS Year,
         CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN 'nan'
              WHEN l_quantity = 3 THEN 'abc' ELSE CAST(l_extendedprice AS VARCHAR) END AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
                JOIN nation ON s_nationkey = n_nationkey
),
indicator_raw AS (
  SELECT dataset, 'value' AS metric, Entity AS entity, {_strip('Code')} AS code,
         {_num('Year')} AS year_number, {_num('value')} AS value
  FROM observation
),
indicator AS (
  SELECT dataset, metric, entity, code, year_number,
         CASE WHEN year_number = floor(year_number) AND abs(year_number) < 2147483647
              THEN CAST(year_number AS INTEGER) END AS year,
         value
  FROM indicator_raw
),
clean AS (
  SELECT * FROM indicator
  WHERE code IS NOT NULL AND length(code) = 3 AND NOT starts_with(code, 'OWID_')
),
datasets AS (SELECT DISTINCT dataset FROM indicator),
latest AS (
  SELECT dataset, CAST(trunc(max(year_number)) AS INTEGER) AS latest_year
  FROM indicator WHERE year_number IS NOT NULL GROUP BY dataset
),
avail AS (
  SELECT DISTINCT dataset, CAST(trunc(year_number) AS INTEGER) AS year
  FROM indicator WHERE value IS NOT NULL AND year_number IS NOT NULL
),
avail_ranked AS (
  SELECT dataset, year, row_number() OVER (PARTITION BY dataset ORDER BY year DESC) AS year_rank
  FROM avail
)
"""


def _mean(sum_expr: str, n_expr: str) -> str:
    """Canonical mean (see ``exact_mean`` on the Spark side)."""
    return f"(CASE WHEN {n_expr} > 0 THEN round({sum_expr}, 2) / {n_expr} END)"


def _q(body: str) -> str:
    return "WITH " + ADAPTERS.strip() + "\n" + body.strip()


ORACLE: dict[str, str] = {}

ORACLE["p2_clean_indicator"] = _q(
    """
SELECT dataset, metric, entity, code, year_number, CAST(year AS DOUBLE) AS year, value FROM clean
"""
)

ORACLE["j1_merge"] = _q(
    """
SELECT b.ISO_A3, b.ADMIN, c.dataset, c.metric, c.entity, c.code, c.year_number, CAST(c.year AS DOUBLE) AS year, c.value
FROM boundary b LEFT JOIN clean c ON b.ISO_A3 = c.code
"""
)

ORACLE["a1_latest_year"] = _q("SELECT dataset, latest_year FROM latest")

ORACLE["a2_available_years"] = _q("SELECT dataset, year, year_rank FROM avail_ranked")

ORACLE["s6_latest_merged"] = _q(
    """
SELECT d.dataset, b.ISO_A3, b.ADMIN, c.metric, c.entity, c.code, c.year_number, CAST(c.year AS DOUBLE) AS year, c.value
FROM datasets d CROSS JOIN boundary b
LEFT JOIN (
  SELECT c.* FROM clean c JOIN latest l
    ON c.dataset = l.dataset AND c.year_number = CAST(l.latest_year AS DOUBLE)
) c ON c.dataset = d.dataset AND c.code = b.ISO_A3
"""
)

ORACLE["d5_kpis"] = _q(
    f"""
SELECT g.dataset, g.year,
       CAST(count(*) AS BIGINT) AS countries,
       CAST(count(c.value) AS BIGINT) AS with_data,
       {_mean('sum(c.value)', 'count(c.value)')} AS mean_value,
       max(c.value) AS max_value,
       min(c.value) AS min_value
FROM avail g CROSS JOIN boundary b
LEFT JOIN clean c
  ON c.dataset = g.dataset AND c.year_number = CAST(g.year AS DOUBLE) AND c.code = b.ISO_A3
GROUP BY g.dataset, g.year
"""
)

_MATCHED = f"""
m AS (SELECT c.*, b.ISO_A3, b.ADMIN FROM clean c JOIN boundary b ON c.code = b.ISO_A3),
yrs AS (
  SELECT dataset, metric, year_number,
         row_number() OVER (PARTITION BY dataset, metric ORDER BY year_number DESC) AS r
  FROM (SELECT DISTINCT dataset, metric, year_number FROM m WHERE year_number IS NOT NULL)
),
two AS (
  SELECT dataset, metric, max(CASE WHEN r = 2 THEN year_number END) AS prev_year,
         max(CASE WHEN r = 1 THEN year_number END) AS last_year
  FROM yrs WHERE r <= 2 GROUP BY dataset, metric HAVING max(CASE WHEN r = 2 THEN year_number END) IS NOT NULL
),
piv AS (
  SELECT m.dataset, m.metric, m.ADMIN, t.prev_year, t.last_year,
         avg(CASE WHEN m.year_number = t.prev_year THEN m.value END) AS prev_mean,
         avg(CASE WHEN m.year_number = t.last_year THEN m.value END) AS last_mean,
         sum(CASE WHEN m.year_number = t.prev_year THEN m.value END) AS prev_sum,
         sum(CASE WHEN m.year_number = t.last_year THEN m.value END) AS last_sum,
         count(CASE WHEN m.year_number = t.prev_year THEN m.value END) AS prev_n,
         count(CASE WHEN m.year_number = t.last_year THEN m.value END) AS last_n
  FROM m JOIN two t ON m.dataset = t.dataset AND m.metric = t.metric
  WHERE m.year_number IN (t.prev_year, t.last_year) AND m.ADMIN IS NOT NULL AND m.value IS NOT NULL
  GROUP BY m.dataset, m.metric, m.ADMIN, t.prev_year, t.last_year
),
chg AS (
  SELECT dataset, metric, ADMIN, last_mean - prev_mean AS value,
         {_mean('last_sum', 'last_n')} - {_mean('prev_sum', 'prev_n')} AS canon,
         'Annual Change in ' || metric || ' (' || CAST(CAST(trunc(prev_year) AS BIGINT) AS VARCHAR)
           || ' → ' || CAST(CAST(trunc(last_year) AS BIGINT) AS VARCHAR) || ')' AS label
  FROM piv WHERE prev_mean IS NOT NULL AND last_mean IS NOT NULL
),
series AS (
  SELECT * FROM chg
  UNION ALL
  SELECT dataset, metric, ADMIN, avg(value) AS value, {_mean('sum(value)', 'count(value)')} AS canon,
         metric AS label
  FROM m
  WHERE ADMIN IS NOT NULL AND value IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM chg WHERE chg.dataset = m.dataset AND chg.metric = m.metric)
  GROUP BY dataset, metric, ADMIN
),
means AS (
  SELECT dataset, year, ADMIN, avg(value) AS mean_value, {_mean('sum(value)', 'count(value)')} AS canon
  FROM m WHERE ADMIN IS NOT NULL AND value IS NOT NULL AND year IS NOT NULL
  GROUP BY dataset, year, ADMIN
),
lm AS (
  SELECT d.dataset, b.ISO_A3, b.ADMIN, c.metric, c.entity, c.code, c.year_number, c.year, c.value
  FROM datasets d CROSS JOIN boundary b
  LEFT JOIN (
    SELECT c.* FROM clean c JOIN latest l
      ON c.dataset = l.dataset AND c.year_number = CAST(l.latest_year AS DOUBLE)
  ) c ON c.dataset = d.dataset AND c.code = b.ISO_A3
)
"""


def _qm(body: str) -> str:
    return "WITH " + ADAPTERS.strip() + ",\n" + _MATCHED.strip() + "\n" + body.strip()


# Bodies that start with ", name AS (...)" extend the CTE list.

ORACLE["a6_country_mean"] = _qm("SELECT dataset, year, ADMIN, canon AS mean_value FROM means")

ORACLE["a7_year_pivot"] = _qm(
    f"""
SELECT dataset, metric, ADMIN, prev_year, last_year,
       {_mean('prev_sum', 'prev_n')} AS prev_mean, {_mean('last_sum', 'last_n')} AS last_mean,
       prev_n, last_n
FROM piv
"""
)

ORACLE["i1_yoy_change"] = _qm("SELECT dataset, metric, ADMIN, label, canon AS value FROM chg")

ORACLE["i2_insight_series"] = _qm("SELECT dataset, metric, ADMIN, label, canon AS value FROM series")

ORACLE["i3_top_bottom"] = _qm(
    """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, year ORDER BY mean_value DESC, ADMIN ASC) AS rt,
            row_number() OVER (PARTITION BY dataset, year ORDER BY mean_value ASC, ADMIN ASC) AS rb
  FROM means
)
SELECT dataset, year, ADMIN, 'top' AS side, rt AS rank, canon AS mean_value FROM ranked WHERE rt <= 5
UNION ALL
SELECT dataset, year, ADMIN, 'bottom' AS side, rb AS rank, canon AS mean_value FROM ranked WHERE rb <= 5
"""
)

ORACLE["i3_insight_top_bottom"] = _qm(
    """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, metric, label ORDER BY value DESC, ADMIN ASC) AS rt,
            row_number() OVER (PARTITION BY dataset, metric, label ORDER BY value ASC, ADMIN ASC) AS rb
  FROM series
)
SELECT dataset, metric, label, ADMIN, 'top' AS side, rt AS rank, canon AS value FROM ranked WHERE rt <= 5
UNION ALL
SELECT dataset, metric, label, ADMIN, 'bottom' AS side, rb AS rank, canon AS value FROM ranked WHERE rb <= 5
"""
)

ORACLE["i4_preview"] = _qm(
    """
, ranked AS (
  SELECT dataset, year, ADMIN, value,
         row_number() OVER (PARTITION BY dataset, year ORDER BY ADMIN, value) AS "row"
  FROM m WHERE ADMIN IS NOT NULL AND value IS NOT NULL AND year IS NOT NULL
)
SELECT * FROM ranked WHERE "row" <= 20
"""
)

ORACLE["d4_choropleth"] = _qm(
    """
, ext AS (SELECT dataset, min(value) AS mn, max(value) AS mx, bool_or(value IS NOT NULL) AS has_data
          FROM lm GROUP BY dataset)
SELECT lm.dataset, ISO_A3, ADMIN, year_number, value, value IS NULL AS no_data,
       round(CASE WHEN mx - mn > 0 THEN (value - mn) / (mx - mn) END, 6) AS scaled_value, has_data
FROM lm JOIN ext ON lm.dataset = ext.dataset
"""
)

ORACLE["a8_profile"] = _qm(
    """
, t AS (
  SELECT dataset, 'ISO_A3' AS column_name, ISO_A3 AS v FROM lm
  UNION ALL SELECT dataset, 'ADMIN', ADMIN FROM lm
  UNION ALL SELECT dataset, 'entity', entity FROM lm
  UNION ALL SELECT dataset, 'code', code FROM lm
),
tv AS (SELECT dataset, column_name, v, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY dataset, column_name ORDER BY n DESC, v ASC) AS r FROM tv),
ts AS (
  SELECT n.dataset, n.column_name,
         CAST(coalesce((SELECT sum(n) FROM tv WHERE tv.dataset = n.dataset AND tv.column_name = n.column_name), 0) AS BIGINT) AS count,
         (SELECT count(*) FROM tv WHERE tv.dataset = n.dataset AND tv.column_name = n.column_name) AS cnt_unique,
         tr.v AS top, tr.n AS freq
  FROM (SELECT DISTINCT dataset, column_name FROM t) n
  LEFT JOIN tr ON tr.dataset = n.dataset AND tr.column_name = n.column_name AND tr.r = 1
),
nl AS (
  SELECT dataset, 'year_number' AS column_name, year_number AS v FROM lm
  UNION ALL SELECT dataset, 'value', value FROM lm
)
SELECT dataset, column_name, count, CAST(cnt_unique AS DOUBLE) AS "unique", top,
       CAST(freq AS DOUBLE) AS freq,
       CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min,
       CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75,
       CAST(NULL AS DOUBLE) AS max
FROM ts
UNION ALL
SELECT dataset, column_name, CAST(count(v) AS BIGINT), NULL, NULL, NULL,
       round(avg(v), 4), round(stddev_samp(v), 4), round(min(v), 4),
       round(quantile_cont(v, 0.25), 4), round(quantile_cont(v, 0.5), 4), round(quantile_cont(v, 0.75), 4),
       round(max(v), 4)
FROM nl GROUP BY dataset, column_name
"""
)

ORACLE["p10_metric_profile"] = _q(
    f"""
, t AS (
  SELECT 'dataset' AS column_name, dataset AS v FROM observation
  UNION ALL SELECT 'Entity', Entity FROM observation
  UNION ALL SELECT 'Code', Code FROM observation
  UNION ALL SELECT 'Year', Year FROM observation
  UNION ALL SELECT 'value', value FROM observation
)
SELECT column_name, count(v) AS non_null, count({_num('v')}) AS numeric FROM t GROUP BY column_name
"""
)


# ---- tiles, verdicts, history, cache, workflow -------------------------------------------

_LOG = """
log AS (
  SELECT event_id AS id, ts AS timestamp,
         CAST(((event_id // 25) * 37) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE)
           + CAST((event_id // 25) // 612000 AS DOUBLE) / CAST((event_id // 25) // 612000 + 1 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
         CAST(((event_id // 25) * 91) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS longitude,
         CAST(1 + (event_id // 25) % 20 AS INTEGER) AS zoom,
         event_type || ' ' || props AS image_description,
         'llava:7b' AS image_model,
         event_type AS text_description,
         'mistral:7b' AS text_model,
         CASE event_type WHEN 'error' THEN 'Y' WHEN 'purchase' THEN 'YES'
              WHEN 'signup' THEN NULL ELSE 'N' END AS danger
  FROM events
),
request AS (
  SELECT event_id AS request_id,
         CAST((((event_id * 2) // 25) * 37) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE)
           + CAST(((event_id * 2) // 25) // 612000 AS DOUBLE) / CAST(((event_id * 2) // 25) // 612000 + 1 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
         CAST((((event_id * 2) // 25) * 91) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS longitude,
         CAST(1 + ((event_id * 2) // 25) % 20 AS INTEGER) AS zoom
  FROM events
),
reply AS (
  SELECT doc_id, CASE doc_id % 8
         WHEN 0 THEN '{"danger": "y", "justification": ' || quoted || '}'
         WHEN 1 THEN '```json' || chr(10) || '{"danger": "N", "justification": ' || quoted || '}' || chr(10) || '```'
         WHEN 2 THEN '{"danger": null, "justification": ' || quoted || '}'
         WHEN 3 THEN '{"danger": "Y"} ' || text
         WHEN 4 THEN 'Some concern about soil in ' || text
         WHEN 5 THEN 'all calm in ' || text
         WHEN 6 THEN '{"justification": ' || quoted || '}'
         ELSE text END AS raw
  FROM (SELECT doc_id, text, '"' || regexp_replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), '[\\x00-\\x1F]', ' ', 'g') || '"' AS quoted
        FROM documents) d
)
"""


def _tile_cte(name: str, source: str, cols: str) -> str:
    """Tile x, y (F1) of every row of ``source``: truncation, clamps, +-90 clamp."""
    latc = "greatest(-90.0, least(90.0, latitude))"
    return f"""
{name} AS (
  SELECT {cols}, zoom AS z,
         CAST(greatest(0, least(CAST(pow(2, zoom) AS BIGINT) - 1,
              CAST(trunc((longitude + 180) / 360 * pow(2, zoom)) AS BIGINT))) AS INTEGER) AS x,
         CAST(greatest(0, least(CAST(pow(2, zoom) AS BIGINT) - 1,
              CAST(trunc((1 - ln(tan(radians({latc})) + 1 / cos(radians({latc}))) / pi()) / 2 * pow(2, zoom))
                   AS BIGINT))) AS INTEGER) AS y
  FROM {source}
)"""


def _tile_file(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return (f"'esri_' || CAST({p}z AS VARCHAR) || '_' || CAST({p}x AS VARCHAR) || '_' "
            f"|| CAST({p}y AS VARCHAR) || '.png'")


_URL = ("'https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/' "
        "|| CAST(z AS VARCHAR) || '/' || CAST(y AS VARCHAR) || '/' || CAST(x AS VARCHAR)")


def _label(expr: str, pos: str, neg: str, decimals: int) -> str:
    return (f"(CASE WHEN {expr} >= 0 THEN '{pos}' ELSE '{neg}' END || ' ' || "
            f"printf('%.{decimals}f', abs({expr})) || '°')")


def _ql(body: str, *ctes: str) -> str:
    extra = "".join("," + c for c in ctes)
    return "WITH " + _LOG.strip() + extra + "\n" + body.strip()


ORACLE["f1_tiles"] = _ql(
    f"SELECT request_id, z, x, y, {_tile_file()} AS file_name, {_URL} AS url FROM rt",
    _tile_cte("rt", "request", "request_id, latitude, longitude, zoom"),
)

_ZOOM_LABEL = """CASE WHEN zoom BETWEEN 1 AND 4 THEN 'Continental view'
  WHEN zoom BETWEEN 5 AND 8 THEN 'Country / region' WHEN zoom BETWEEN 9 AND 11 THEN 'City level'
  WHEN zoom BETWEEN 12 AND 14 THEN 'District level' WHEN zoom BETWEEN 15 AND 17 THEN 'Neighbourhood'
  WHEN zoom BETWEEN 18 AND 20 THEN 'Building level' ELSE '' END"""

_RING = ", ".join(
    f"round({lo}, 9) AS ring{i}_lon, round({la}, 9) AS ring{i}_lat"
    for i, (lo, la) in enumerate(
        [("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max"),
         ("lon_min", "lat_min")]
    )
)

ORACLE["d6_tile_preview"] = _ql(
    f"""
, b AS (
  SELECT *, x / pow(2, zoom) * 360 - 180 AS lon_min, (x + 1) / pow(2, zoom) * 360 - 180 AS lon_max,
         degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, zoom))))) AS lat_min,
         degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, zoom))))) AS lat_max
  FROM rt
)
SELECT request_id, z, x, y, round(lon_min, 9) AS lon_min, round(lat_min, 9) AS lat_min,
       round(lon_max, 9) AS lon_max, round(lat_max, 9) AS lat_max,
       round((lat_min + lat_max) / 2, 9) AS center_lat, round((lon_min + lon_max) / 2, 9) AS center_lon,
       {_RING},
       {_ZOOM_LABEL} AS zoom_label, greatest(0, zoom - 2) AS preview_zoom,
       {_label('latitude', 'N', 'S', 5)} AS lat_label, {_label('longitude', 'E', 'W', 5)} AS lon_label
FROM b
""",
    _tile_cte("rt", "request", "request_id, latitude, longitude, zoom"),
)

_STEMS = "risk|danger|deforest|erosion|pollut|degrad|threat|alarm|concern"

ORACLE["f22_verdicts"] = _ql(
    f"""
, s AS (SELECT doc_id, {_strip('raw')} AS stripped FROM reply),
c AS (
  SELECT doc_id, stripped,
         CASE WHEN contains(stripped, '```')
              THEN regexp_replace(split_part(stripped, '```', 2), '^json', '') ELSE stripped END AS cleaned
  FROM s
),
v0 AS (
  SELECT *, coalesce(CASE WHEN json_valid(cleaned) THEN json_type(cleaned) = 'OBJECT' END, false) AS ok,
         CASE WHEN regexp_matches(lower(stripped), '{_STEMS}') THEN 'Y' ELSE 'N' END AS kw
  FROM c
),
v AS (SELECT doc_id, stripped, ok, kw, CASE WHEN ok THEN cleaned END AS cleaned FROM v0)
SELECT doc_id,
  CASE WHEN NOT ok THEN kw
       WHEN NOT json_exists(cleaned, '$.danger') THEN 'N'
       WHEN json_type(cleaned, '$.danger') = 'NULL' THEN 'NONE'
       WHEN json_type(cleaned, '$.danger') = 'VARCHAR' THEN upper(json_extract_string(cleaned, '$.danger'))
       ELSE upper(CAST(json_extract(cleaned, '$.danger') AS VARCHAR)) END AS danger,
  CASE WHEN NOT ok THEN stripped
       WHEN NOT json_exists(cleaned, '$.justification') THEN stripped
       WHEN json_type(cleaned, '$.justification') = 'NULL' THEN NULL
       WHEN json_type(cleaned, '$.justification') = 'VARCHAR' THEN json_extract_string(cleaned, '$.justification')
       ELSE CAST(json_extract(cleaned, '$.justification') AS VARCHAR) END AS justification
FROM v
"""
)

ORACLE["a9_risk_kpis"] = _ql(
    """
, k AS (SELECT count(*) AS total, count(*) FILTER (WHERE danger = 'Y') AS y,
               count(*) FILTER (WHERE danger = 'N') AS n FROM log)
SELECT total AS total_analyses, y AS at_risk, total - y AS safe,
       CAST(CASE WHEN total = 0 THEN 0 ELSE round_even(y / total * 100, 0) END AS BIGINT) AS risk_rate_pct,
       y AS showing_at_risk, n AS showing_safe
FROM k
"""
)


ORACLE["a9_daily_risk_kpis"] = _ql(
    """
, k AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE danger = 'Y') AS y,
               count(*) FILTER (WHERE danger = 'N') AS n FROM log GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, total AS total_analyses, y AS at_risk, total - y AS safe,
       CAST(round_even(y / total * 100, 0) AS BIGINT) AS risk_rate_pct,
       y AS showing_at_risk, n AS showing_safe
FROM k
"""
)


def _history(where: str) -> str:
    return _ql(
        f"""
SELECT strftime(timestamp, '%Y-%m-%d %H:%M UTC') AS "Timestamp",
       {_label('latitude', 'N', 'S', 4)} AS "Latitude", {_label('longitude', 'E', 'W', 4)} AS "Longitude",
       zoom AS "Zoom", CASE WHEN danger = 'Y' THEN '🚨 At Risk' ELSE '✅ Safe' END AS "Risk",
       image_model AS "Vision Model", text_model AS "Text Model"
FROM log {where}
"""
    )


ORACLE["d1_history_table"] = _history("")
ORACLE["p14_history_at_risk"] = _history("WHERE danger = 'Y'")
ORACLE["p14_history_safe"] = _history("WHERE danger = 'N'")

ORACLE["d2_risk_points"] = _ql(
    """
SELECT latitude AS lat, longitude AS lon, danger,
       CASE WHEN danger = 'Y' THEN 220 ELSE 22 END AS color_r,
       CASE WHEN danger = 'Y' THEN 38 ELSE 163 END AS color_g,
       CASE WHEN danger = 'Y' THEN 38 ELSE 74 END AS color_b,
       200 AS color_a
FROM log
"""
)

ORACLE["d3_detail_records"] = _ql(
    f"""
, inv AS (SELECT DISTINCT {_tile_file()} AS f FROM rt)
SELECT id,
       CASE WHEN danger = 'Y' THEN '🚨' ELSE '✅' END || ' ' || strftime(timestamp, '%Y-%m-%d %H:%M UTC')
         || '  ·  ' || {_label('latitude', 'N', 'S', 4)} || ', ' || {_label('longitude', 'E', 'W', 4)}
         || '  ·  Zoom ' || CAST(zoom AS VARCHAR) AS headline,
       coalesce(danger = 'Y', false) AS at_risk,
       {_tile_file('lt')} AS tile_file,
       {_tile_file('lt')} IN (SELECT f FROM inv) AS tile_cached,
       text_description AS justification, image_model, text_model, image_description
FROM lt
""",
    _tile_cte("rt", "request", "request_id, latitude, longitude, zoom"),
    _tile_cte("lt", "log", "*"),
)

_FIRST = """
first AS (
  SELECT latitude, longitude, zoom, image_description, danger, text_description FROM (
    SELECT *, row_number() OVER (PARTITION BY latitude, longitude, zoom
                                 ORDER BY timestamp IS NULL, timestamp, id) AS r
    FROM log) WHERE r = 1
)"""

ORACLE["j2_cache_lookup"] = _ql(
    """
SELECT q.request_id, q.latitude, q.longitude, q.zoom, f.latitude IS NOT NULL AS hit,
       f.image_description, f.danger, f.text_description
FROM request q LEFT JOIN first f
  ON q.latitude = f.latitude AND q.longitude = f.longitude AND q.zoom = f.zoom
""",
    _FIRST,
)

ORACLE["j3_tile_worklist"] = _ql(
    f"""
SELECT DISTINCT z, x, y, {_tile_file()} AS file_name, {_URL} AS url FROM rt
WHERE {_tile_file()} NOT IN (SELECT DISTINCT {_tile_file('lt')} FROM lt)
""",
    _tile_cte("rt", "request", "request_id, latitude, longitude, zoom"),
    _tile_cte("lt", "log", "latitude, longitude"),
)

_MODEL = f"""
w AS (
  SELECT q.request_id, q.latitude, q.longitude, q.zoom, f.latitude IS NOT NULL AS hit, f.image_description, f.danger, f.text_description,
         {_tile_file('q')} AS tile_file, length({_URL}) AS n
  FROM rt q LEFT JOIN first f
    ON q.latitude = f.latitude AND q.longitude = f.longitude AND q.zoom = f.zoom
),
answered AS (
  SELECT request_id, latitude, longitude, zoom, hit,
         CASE WHEN hit THEN 'cache' ELSE 'model' END AS source,
         CASE WHEN hit THEN image_description ELSE 'tile ' || tile_file || ' of ' || n || ' bytes' END AS image_description,
         CASE WHEN hit THEN danger WHEN n % 2 = 0 THEN 'Y' ELSE 'N' END AS danger,
         CASE WHEN hit THEN text_description WHEN n % 2 = 0 THEN 'eroded banks near ' || tile_file
              ELSE 'no visible change near ' || tile_file END AS justification,
         CAST(NULL AS VARCHAR) AS error, tile_file, true AS tile_fetched
  FROM w
)"""

_WORKFLOW = [_FIRST, _tile_cte("rt", "request", "request_id, latitude, longitude, zoom"), _MODEL]

ORACLE["w1_process_requests"] = _ql("SELECT * EXCLUDE (hit) FROM answered", *_WORKFLOW)

ORACLE["j2_stored_lookup"] = ORACLE["j2_cache_lookup"].replace(
    "ORDER BY timestamp IS NULL, timestamp, id", "ORDER BY id"
)

ORACLE["s1_catalogue"] = _q(
    """
, cat(seq, display_name, file_name, dataset, slug) AS (VALUES
  (0, 'Annual Change in Forest Area', 'annual_change_forest_area.csv', 'annual_change_forest_area', 'annual-change-forest-area'),
  (1, 'Annual Deforestation', 'annual_deforestation.csv', 'annual_deforestation', 'annual-deforestation'),
  (2, 'Share of Protected Land', 'share_protected_land.csv', 'share_protected_land', 'terrestrial-protected-areas'),
  (3, 'Share of Degraded Land', 'share_degraded_land.csv', 'share_degraded_land', 'share-degraded-land'),
  (4, 'Share of Forest-Covered Land', 'share_covered_forest_land.csv', 'share_covered_forest_land', 'forest-area-as-share-of-land-area')
)
SELECT c.seq, c.display_name, c.file_name, c.dataset, c.slug,
       'https://ourworldindata.org/grapher/' || c.slug || '.csv?v=1' AS url,
       coalesce(o.n, 0) AS observed_rows
FROM cat c LEFT JOIN (SELECT dataset, count(*) AS n FROM observation GROUP BY dataset) o ON c.dataset = o.dataset
"""
)

ORACLE["p7_default_selection"] = _q(
    """
, newest AS (SELECT dataset, year FROM avail_ranked WHERE year_rank = 1)
SELECT d.dataset, b.ISO_A3, b.ADMIN, c.metric, c.entity, c.code, c.year_number,
       CAST(c.year AS DOUBLE) AS year, c.value
FROM datasets d CROSS JOIN boundary b
LEFT JOIN (SELECT c.* FROM clean c JOIN newest n ON c.dataset = n.dataset AND c.year = n.year) c
  ON c.dataset = d.dataset AND c.code = b.ISO_A3
"""
)

ORACLE["s4_csv_scan"] = _q(
    """
SELECT dataset,
  CASE dataset WHEN 'annual_deforestation' THEN 'Deforestation (ha)'
    WHEN 'share_degraded_land' THEN 'Degraded land, share' ELSE 'Protected' END AS metric,
  entity, code, year_number, CAST(year AS DOUBLE) AS year, value
FROM indicator
"""
)

ORACLE["s4_csv_records"] = _q(
    f"""
SELECT dataset,
  CASE dataset WHEN 'annual_deforestation' THEN 'Deforestation (ha)'
    WHEN 'share_degraded_land' THEN 'Degraded land, share' ELSE 'Protected' END AS metric,
  CASE WHEN Code IS NULL OR Code = 'US' THEN Entity || chr(10) || '"' || dataset || '",' || chr(10) || chr(10) || 'end' ELSE Entity END AS entity,
  {_strip('Code')} AS code, {_num('Year')} AS year_number, {_num('Year')} AS year, {_num('value')} AS value
FROM observation
WHERE value IS NULL OR value <> 'abc'
"""
)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_LOG_FULL = f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
       CAST(((event_id // 25) * 37) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE)
           + CAST((event_id // 25) // 612000 AS DOUBLE) / CAST((event_id // 25) // 612000 + 1 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
       CAST(((event_id // 25) * 91) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS longitude,
       CAST(1 + (event_id // 25) % 20 AS INTEGER) AS zoom,
       event_type || ' ' || props AS image_description,
       {_sql_text(DEFAULT_MODEL_CONFIG.image_prompt.strip())} AS image_prompt,
       'llava:7b' AS image_model,
       event_type AS text_description,
       {_sql_text(DEFAULT_MODEL_CONFIG.text_prompt.strip())} AS text_prompt,
       'mistral:7b' AS text_model,
       CASE event_type WHEN 'error' THEN 'Y' WHEN 'purchase' THEN 'YES'
            WHEN 'signup' THEN NULL ELSE 'N' END AS danger
FROM events
"""

ORACLE["k1_log_append_read"] = _LOG_FULL.strip()
ORACLE["k3_log_csv_export_read"] = _LOG_FULL.strip()

ORACLE["s9_tile_fetch"] = _ql(
    f"""
, w AS (
  SELECT DISTINCT z, x, y, {_tile_file()} AS file_name, {_URL} AS url FROM rt
  WHERE {_tile_file()} NOT IN (SELECT DISTINCT {_tile_file('lt')} FROM lt)
)
SELECT file_name, z, x, y, CAST(octet_length(encode(url)) AS BIGINT) AS length FROM w
""",
    _tile_cte("rt", "request", "request_id, latitude, longitude, zoom"),
    _tile_cte("lt", "log", "latitude, longitude, zoom"),
)

ORACLE["s5_boundaries_geojson"] = _q(
    """
SELECT CASE WHEN s_nationkey >= 23 THEN '-99'
            ELSE 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') END AS ISO_A3,
       s_name AS ADMIN,
       '{"coordinates":[' || CAST(s_suppkey AS VARCHAR) || ',' || CAST(s_nationkey AS VARCHAR)
         || '],"type":"Point"}' AS geometry
FROM supplier
"""
)

# ---- display text (F5, F11, F12) -----------------------------------------------------------

ORACLE["f11_kpi_text"] = (
    "SELECT dataset, year, format('{:,}', countries) AS countries_text, "
    "format('{:,}', with_data) AS with_data_text, "
    "CASE WHEN with_data > 0 THEN format('{:,.2f}', mean_value) END AS mean_value_text, "
    "CASE WHEN with_data > 0 THEN format('{:,.2f}', max_value) END AS max_value_text, "
    "CASE WHEN with_data > 0 THEN format('{:,.2f}', min_value) END AS min_value_text\n"
    "FROM (" + ORACLE["d5_kpis"] + ") k"
)

ORACLE["f12_bar_labels"] = (
    "SELECT *, format('{:,.1f}', mean_value) AS bar_label\nFROM (" + ORACLE["i3_top_bottom"] + ") t"
)

ORACLE["f5_coordinate_entry"] = _ql(
    f"""
, e AS (
  SELECT request_id, abs(latitude) AS lat_abs, CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END AS lat_dir,
         abs(longitude) AS lon_abs, CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END AS lon_dir, zoom
  FROM request
), s AS (
  SELECT request_id, lat_dir, lon_dir, zoom,
         CASE WHEN lat_dir = 'N' THEN lat_abs ELSE -lat_abs END AS latitude,
         CASE WHEN lon_dir = 'E' THEN lon_abs ELSE -lon_abs END AS longitude
  FROM e
)
SELECT request_id, lat_dir, lon_dir, latitude, longitude, zoom,
       {_label('latitude', 'N', 'S', 5)} AS lat_label, {_label('longitude', 'E', 'W', 5)} AS lon_label
FROM s
"""
)

# The streaming workflow gives the batch workflow's answers.
ORACLE["w1_request_stream"] = ORACLE["w1_process_requests"]
ORACLE["w1_batched_requests"] = ORACLE["w1_process_requests"]

# The streaming report holds every day, late rows included.
ORACLE["a9_daily_risk_stream"] = ORACLE["a9_daily_risk_kpis"]

ORACLE["k2_new_log_rows"] = _ql(
    f"""
SELECT DISTINCT '2024-06-01 12:00:00.000000' AS timestamp, latitude, longitude, zoom, image_description,
       {_sql_text(DEFAULT_MODEL_CONFIG.image_prompt.strip())} AS image_prompt, 'llava:7b' AS image_model,
       justification AS text_description, {_sql_text(DEFAULT_MODEL_CONFIG.text_prompt.strip())} AS text_prompt,
       'mistral:7b' AS text_model, danger
FROM answered WHERE NOT hit
""",
    *_WORKFLOW,
)

ORACLE["f18_prompts"] = f"""
SELECT event_id AS id, {_sql_text(DEFAULT_MODEL_CONFIG.text_prompt)} || chr(10) || chr(10) || 'Image description:' || chr(10)
       || event_type || ' ' || props AS prompt
FROM events
""".strip()

ORACLE["o2_ranked_history"] = """
SELECT event_id AS id,
       row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id) AS newest_place,
       row_number() OVER (ORDER BY ts ASC NULLS LAST, event_id) AS oldest_place
FROM events
""".strip()

ORACLE["a9_replayed_risk_stream"] = ORACLE["a9_daily_risk_kpis"]

ORACLE["p11_country_means"] = ORACLE["a6_country_mean"]
