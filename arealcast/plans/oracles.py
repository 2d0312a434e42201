"""The registered queries as plain SQL over the driver's tables."""

from __future__ import annotations

# Shared table expressions: name -> SQL. Later ones may use earlier ones.
VIEWS = {
    "fc1": """
        SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS geo_id,
               l_shipdate AS valid_time, l_shipdate - l_linenumber * 24 * INTERVAL '1' HOUR AS init_time,
               CAST(l_linenumber * 24 AS INTEGER) AS lead_time, avg(2.7315e2 + l_quantity) AS t2m
        FROM lineitem GROUP BY l_suppkey, l_shipdate, l_linenumber""",
    "fc2": """
        SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS geo_id,
               l_shipdate AS valid_time, l_shipdate - l_linenumber * 24 * INTERVAL '1' HOUR AS init_time,
               CAST(l_linenumber * 24 AS INTEGER) AS lead_time,
               avg(2.7315e2 + 9e-1 * l_quantity + 1e1 * l_discount) AS t2m
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'
        GROUP BY l_suppkey, l_shipdate, l_linenumber""",
    "an": """
        SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS geo_id,
               o_orderdate AS time, avg(2.7315e2 + l_quantity) AS t2m
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_orderdate""",
    "area": """
        SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS geo_id,
               s_nationkey AS statefp, 1e6 * (100 + abs(s_acctbal)) AS aland_m2 FROM supplier""",
    "land": "SELECT geo_id, aland_m2 / 1e6 AS aland FROM area",
    "bias1": """
        SELECT f.geo_id, f.valid_time, f.init_time, f.lead_time, f.t2m AS t2m_fc, a.t2m AS t2m_an,
               f.t2m - a.t2m AS bias, abs(f.t2m - a.t2m) AS abs_error, l.aland
        FROM fc1 f JOIN an a ON f.geo_id = a.geo_id AND f.valid_time = a.time LEFT JOIN land l ON f.geo_id = l.geo_id""",
    "bias2": """
        SELECT f.geo_id, f.valid_time, f.init_time, f.lead_time, f.t2m AS t2m_fc, a.t2m AS t2m_an,
               f.t2m - a.t2m AS bias, abs(f.t2m - a.t2m) AS abs_error, l.aland
        FROM fc2 f JOIN an a ON f.geo_id = a.geo_id AND f.valid_time = a.time LEFT JOIN land l ON f.geo_id = l.geo_id""",
    "daily": "SELECT * FROM an WHERE NOT (month(time) = 2 AND day(time) = 29)",
    "clim": """
        SELECT geo_id, {doy:time} AS day_of_year, avg(t2m) AS t2m_clim FROM daily GROUP BY 1, 2""",
    "anom": """
        SELECT b.*, c.day_of_year, c.t2m_clim, b.t2m_fc - c.t2m_clim AS fc_anom, b.t2m_an - c.t2m_clim AS an_anom
        FROM bias1 b JOIN clim c ON b.geo_id = c.geo_id AND {doy:b.valid_time} = c.day_of_year""",
    "cells": """
        SELECT CAST(floor(p_partkey / 800) AS INTEGER) AS grid_id,
               1.25e-1 * floor((p_partkey % 800) / 50) AS lat, -1.25e2 + 1.25e-1 * (p_partkey % 50) AS lon,
               CASE WHEN p_partkey % 37 <> 0 THEN 2.5e2 + p_size END AS value,
               CASE WHEN p_partkey % 41 <> 0 THEN CAST(p_size % 6 AS INTEGER) END AS category
        FROM part""",
    "obs": """
        SELECT CAST(floor(l_partkey / 800) AS INTEGER) AS grid_id,
               1.25e-1 * floor((l_partkey % 800) / 50) AS lat, -1.25e2 + 1.25e-1 * (l_partkey % 50) AS lon,
               l_shipdate + 3 * l_linenumber * INTERVAL '1' HOUR AS time,
               2.7315e2 + l_quantity AS f, 2.7315e2 + 9e-1 * l_quantity + 1e1 * l_discount AS a,
               2.7e2 + 1e1 * l_tax AS c, CAST(l_linenumber * 24 AS INTEGER) AS lead_time
        FROM lineitem""",
    "obs_wide": """
        SELECT CAST(floor(l_partkey / 20000) AS INTEGER) AS grid_id,
               1.25e-1 * floor((l_partkey % 20000) / 50) AS lat, -1.25e2 + 1.25e-1 * (l_partkey % 50) AS lon,
               l_shipdate + 3 * l_linenumber * INTERVAL '1' HOUR AS time,
               2.7315e2 + l_quantity AS f, 2.7315e2 + 9e-1 * l_quantity + 1e1 * l_discount AS a,
               2.7e2 + 1e1 * l_tax AS c, CAST(l_linenumber * 24 AS INTEGER) AS lead_time
        FROM lineitem""",
    "mobs": """
        SELECT grid_id, lat, lon, time, avg(f) AS f, avg(a) AS a, avg(c) AS c FROM obs GROUP BY 1, 2, 3, 4""",
    "polys": """
        SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS geo_id,
               CAST(floor(s_suppkey / 10) AS INTEGER) AS grid_id, s_nationkey AS statefp,
               -1.252e2 + 1.27e0 * (s_suppkey % 10 % 5) AS x0, -1.252e2 + 1.27e0 * (s_suppkey % 10 % 5 + 1) AS x1,
               -1e-1 + 1.03e0 * floor((s_suppkey % 10) / 5) AS y0,
               -1e-1 + 1.03e0 * (floor((s_suppkey % 10) / 5) + 1) AS y1
        FROM supplier""",
    "polys_wide": """
        SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS geo_id,
               CAST(floor(s_suppkey / 245) AS INTEGER) AS grid_id, s_nationkey AS statefp,
               -1.252e2 + 1.27e0 * (s_suppkey % 245 % 5) AS x0, -1.252e2 + 1.27e0 * (s_suppkey % 245 % 5 + 1) AS x1,
               -1e-1 + 1.03e0 * floor((s_suppkey % 245) / 5) AS y0,
               -1e-1 + 1.03e0 * (floor((s_suppkey % 245) / 5) + 1) AS y1
        FROM supplier""",
    "lats": """
        SELECT grid_id, lat, lat - coalesce(lat - p, n - lat, 1e0) / 2 AS lat_lo, lat + coalesce(n - lat, lat - p, 1e0) / 2 AS lat_hi
        FROM (SELECT grid_id, lat, lag(lat) OVER w AS p, lead(lat) OVER w AS n FROM (SELECT DISTINCT grid_id, lat FROM cells)
              WINDOW w AS (PARTITION BY grid_id ORDER BY lat))""",
    "lons": """
        SELECT grid_id, lon, lon - coalesce(lon - p, n - lon, 1e0) / 2 AS lon_lo, lon + coalesce(n - lon, lon - p, 1e0) / 2 AS lon_hi
        FROM (SELECT grid_id, lon, lag(lon) OVER w AS p, lead(lon) OVER w AS n FROM (SELECT DISTINCT grid_id, lon FROM cells)
              WINDOW w AS (PARTITION BY grid_id ORDER BY lon))""",
    "bounds": """
        SELECT c.grid_id, c.lat, c.lon, lat_lo, lat_hi, lon_lo, lon_hi FROM (SELECT DISTINCT grid_id, lat, lon FROM cells) c
        JOIN lats ON c.grid_id = lats.grid_id AND c.lat = lats.lat JOIN lons ON c.grid_id = lons.grid_id AND c.lon = lons.lon""",
    "weights": """
        SELECT b.grid_id, p.geo_id, b.lat, b.lon,
               (least(x1, lon_hi) - greatest(x0, lon_lo))
               * (sin(radians(least(y1, lat_hi))) - sin(radians(greatest(y0, lat_lo)))) AS w
        FROM bounds b JOIN polys p ON b.grid_id = p.grid_id
         AND lon_lo < x1 AND lon_hi > x0 AND lat_lo < y1 AND lat_hi > y0""",
    "shares": """
        SELECT geo_id, category, sum(w) / sum(sum(w)) OVER (PARTITION BY geo_id) AS fraction
        FROM cells c JOIN weights w ON c.grid_id = w.grid_id AND c.lat = w.lat AND c.lon = w.lon GROUP BY geo_id, category""",
    "top2": """
        SELECT geo_id, max(CASE WHEN r = 1 THEN category END) AS category_1,
               coalesce(max(CASE WHEN r = 1 AND category IS NOT NULL THEN fraction * 100 END), 0e0) AS category_1_pct,
               max(CASE WHEN r = 2 THEN category END) AS category_2,
               coalesce(max(CASE WHEN r = 2 AND category IS NOT NULL THEN fraction * 100 END), 0e0) AS category_2_pct
        FROM (SELECT geo_id, category, fraction, row_number() OVER (PARTITION BY geo_id
                ORDER BY category IS NULL, fraction DESC, category DESC) AS r
              FROM (SELECT geo_id, category, round(fraction, 9) AS fraction FROM shares)) GROUP BY geo_id""",
    "boxes": """
        SELECT grid_id, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM cells GROUP BY grid_id""",
    "region_polys": """
        SELECT * FROM polys WHERE statefp IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""",
    "census": """
        SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS geo_id,
               'Area ' || l_suppkey AS NAME, sum(l_quantity) AS B01001_001E, count(*) * 1e0 AS B01001_001M,
               sum(l_quantity) AS B17001_001E,
               sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS B17001_002E,
               CASE WHEN l_suppkey % 17 = 0 THEN -6.66666666e8 ELSE max(l_extendedprice) END AS B19013_001E
        FROM lineitem GROUP BY l_suppkey""",
    "income": """
        SELECT geo_id, B01001_001E AS population, B17001_002E AS poor,
               CASE WHEN B19013_001E >= 0 THEN B19013_001E END AS income FROM census""",
    "files": """
        SELECT concat('/fc/0.125/2t/0000/', CAST(l_linenumber * 24 AS VARCHAR), '/m1_fc_2t_0000_',
                      CAST(l_linenumber * 24 AS VARCHAR), '_', strftime(l_shipdate, '%Y%m%d'), '.nc') AS path,
               l_shipdate AS init_time, CAST(l_linenumber * 24 AS INTEGER) AS lead_time
        FROM lineitem GROUP BY l_linenumber, l_shipdate""",
    "anfiles": """
        SELECT concat('/an/0.125/2t/m1_an_2t_', strftime(o_orderdate, '%Y%m%d'), '.nc') AS path, o_orderdate AS time
        FROM orders GROUP BY o_orderdate""",
    "leads": "SELECT CAST(24 * k AS INTEGER) AS lead_time FROM range(1, 8) t(k)",
    "months": """
        SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(count(*) AS INTEGER) AS n_days
        FROM (SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS d FROM an) GROUP BY 1, 2""",
    "fc_slots": """
        SELECT init_time, lead_time FROM (SELECT unnest(generate_series(min(init_time), max(init_time), INTERVAL 1 DAY)) AS init_time FROM files), leads""",
    "fmonths": """
        SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(count(*) AS INTEGER) AS n_days
        FROM (SELECT unnest(generate_series(min(valid_time), max(valid_time), INTERVAL 1 DAY)) AS d FROM fc1) GROUP BY 1, 2""",
    "odays": "SELECT DISTINCT o_orderdate FROM orders",
    "gaps": """
        SELECT m.year, m.month, m.n_days - coalesce(n, 0) AS n_missing, m.year * 12 + m.month >= 1998 * 12 + 1 AS affects_second
        FROM fmonths m LEFT JOIN (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM odays GROUP BY 1, 2) p
          ON m.year = p.year AND m.month = p.month WHERE m.n_days - coalesce(n, 0) > 0""",
    "corners_wide": """
        SELECT geo_id, grid_id, round(x, 9) AS x, round(y, 9) AS y FROM (
          SELECT geo_id, grid_id, x0 AS x, y0 AS y FROM polys_wide UNION ALL SELECT geo_id, grid_id, x0, y1 FROM polys_wide
          UNION ALL SELECT geo_id, grid_id, x1, y0 FROM polys_wide UNION ALL SELECT geo_id, grid_id, x1, y1 FROM polys_wide)""",
    "nbrs_wide": """
        SELECT DISTINCT a.geo_id, b.geo_id AS neighbour FROM corners_wide a
        JOIN corners_wide b ON a.grid_id = b.grid_id AND a.x = b.x AND a.y = b.y AND a.geo_id <> b.geo_id""",
    "nodes": "SELECT geo_id, CAST(row_number() OVER (ORDER BY geo_id) - 1 AS INTEGER) AS node_idx FROM polys",
    "model": """
        SELECT b.geo_id, b.lead_time, b.day_of_year, b.mean_bias, b.n_obs, t.category_1 AS koppen_class,
               c.B01001_001E AS demo_B01001_001E, c.B17001_002E AS demo_B17001_002E
        FROM (SELECT geo_id, lead_time, CAST(dayofyear(valid_time) AS INTEGER) AS day_of_year, avg(bias) AS mean_bias, count(*) AS n_obs
              FROM bias1 GROUP BY 1, 2, 3) b
        LEFT JOIN top2 t ON b.geo_id = t.geo_id LEFT JOIN census c ON b.geo_id = c.geo_id""",
}
NEEDS = {
    "land": ["area"], "bias1": ["fc1", "an", "land"], "bias2": ["fc2", "an", "land"], "daily": ["an"],
    "clim": ["daily"], "anom": ["bias1", "clim"], "mobs": ["obs"], "lats": ["cells"], "lons": ["cells"],
    "bounds": ["cells", "lats", "lons"], "weights": ["bounds", "polys"], "shares": ["cells", "weights"],
    "top2": ["shares"], "boxes": ["cells"], "region_polys": ["polys"], "income": ["census"], "months": ["an"],
    "fc_slots": ["files", "leads"], "gaps": ["fmonths", "odays"], "fmonths": ["fc1"],
    "corners_wide": ["polys_wide"], "nbrs_wide": ["corners_wide"],
    "nodes": ["polys"], "model": ["bias1", "top2", "census"],
}


def noleap(t: str) -> str:
    leap = f"(year({t}) % 4 = 0 AND (year({t}) % 100 <> 0 OR year({t}) % 400 = 0))"
    return f"CAST(dayofyear({t}) - CASE WHEN {leap} AND month({t}) > 2 THEN 1 ELSE 0 END AS INTEGER)"


def season(t: str) -> str:
    return (
        f"CASE WHEN month({t}) IN (12, 1, 2) THEN 'DJF' WHEN month({t}) IN (3, 4, 5) THEN 'MAM' "
        f"WHEN month({t}) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
    )


def season_of_doy(d: str) -> str:
    return (
        f"CASE WHEN {d} BETWEEN 60 AND 151 THEN 'MAM' WHEN {d} BETWEEN 152 AND 243 THEN 'JJA' "
        f"WHEN {d} BETWEEN 244 AND 334 THEN 'SON' ELSE 'DJF' END"
    )


def r(expr: str, name: str = "") -> str:
    """Rounded like the registered query."""
    return f"floor(round({expr}, 9) * 1e6 + 5e-1) / 1e6 AS {name or expr.split('.')[-1]}"


def rs(names: str, prefix: str = "") -> str:
    return ", ".join(r(prefix + n) for n in names.split())


def ym(t: str) -> str:
    return f"CAST(year({t}) AS INTEGER) AS year, CAST(month({t}) AS INTEGER) AS month"


def _expand(sql: str) -> str:
    while "{doy:" in sql:
        start = sql.index("{doy:")
        stop = sql.index("}", start)
        sql = sql[:start] + noleap(sql[start + 5 : stop]) + sql[stop + 1 :]
    return sql


def sql(body: str, *views: str) -> str:
    """``body`` with the table expressions it needs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in views:
        visit(name)
    if not order:
        return _expand(body)
    heads = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    glue = ",\n" if body.lstrip().upper().startswith("WITH ") else "\n"
    body = body.lstrip()[5:] if glue == ",\n" else body
    return _expand(f"WITH {heads}{glue}{body}")


BIAS = "geo_id, valid_time, init_time, lead_time, " + rs("t2m_fc t2m_an bias abs_error aland")
SKILL = ", ".join([r("avg(bias)", "mean_bias"), r("sqrt(avg(bias * bias))", "rmse"), r("avg(abs_error)", "mae"), "count(*) AS n_obs"])
ACC_SKILL = ", ".join(
    [
        r("sum(aland * bias) / sum(aland)", "mean_bias"),
        r("sqrt(sum(aland * bias * bias) / sum(aland))", "rmse"),
        r("sum(aland * abs_error) / sum(aland)", "mae"),
        "count(*) AS n_obs",
    ]
)
BOTH = "(SELECT 'ifs' AS model, * FROM bias1 UNION ALL SELECT 'aifs' AS model, * FROM bias2)"


def describe(value: str) -> str:
    return ", ".join(
        [
            f"count({value}) AS count", r(f"avg({value})", "mean"), r(f"stddev_samp({value})", "std"), r(f"min({value})", "min"),
            r(f"quantile_cont({value}, 0.25)", "q25"), r(f"quantile_cont({value}, 0.5)", "q50"),
            r(f"quantile_cont({value}, 0.75)", "q75"), r(f"max({value})", "max"),
        ]
    )


def box(value: str, key: str, whis: float) -> str:
    return f"""
    WITH src AS (SELECT {key} AS k, {value} AS v FROM bias1),
    q AS (SELECT k, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM src GROUP BY k),
    j AS (SELECT src.k, v, q1, median, q3, v BETWEEN q1 - {whis}e0 * (q3 - q1) AND q3 + {whis}e0 * (q3 - q1) AS inside FROM src JOIN q ON src.k = q.k)
    SELECT k AS KEY, {r("min(q1)", "q1")}, {r("min(median)", "median")}, {r("min(q3)", "q3")},
      {r("min(CASE WHEN inside THEN v END)", "whisker_lo")}, {r("max(CASE WHEN inside THEN v END)", "whisker_hi")},
      count(CASE WHEN NOT inside THEN 1 END) AS n_outliers FROM j GROUP BY k"""


def hist(key: str, density: bool) -> str:
    keys, keys_select = (f"{key}, ", f"t.{key}, ") if key else ("", "")
    on = f"t.{key} = n.{key} AND " if key else ""
    dens = ", " + r("coalesce(n, 0) / (total * (hi - lo) / 30)", "density") if density else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""
    WITH e AS (SELECT min(bias) - pad AS lo, max(bias) + pad AS hi FROM bias1,
               (SELECT CASE WHEN max(bias) = min(bias) THEN 1e-1 ELSE 2e-2 * (max(bias) - min(bias)) END AS pad FROM bias1) GROUP BY pad),
    n AS (SELECT {keys}CAST(least(floor((bias - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM bias1, e GROUP BY {keys}bin),
    t AS (SELECT {keys}count(*) AS total FROM bias1 {group})
    SELECT {keys_select}CAST(b.bin AS INTEGER) AS bin, {r("lo + b.bin * ((hi - lo) / 30)", "bin_lo")},
      {r("lo + (b.bin + 1) * ((hi - lo) / 30)", "bin_hi")}, coalesce(n, 0) AS n{dens}
    FROM e, t CROSS JOIN range(0, 30) b(bin) LEFT JOIN n ON {on}n.bin = b.bin"""


def kde(gridsize: int, common: bool) -> str:
    total = "(SELECT count(*) FROM bias1)" if common else "n"
    return f"""
    WITH src AS (SELECT {season("valid_time")} AS season, bias AS v FROM bias1),
    s AS (SELECT season, count(*) AS n, stddev_samp(v) * pow(count(*), -2e-1) AS h, min(v) AS lo, max(v) AS hi FROM src GROUP BY season),
    g AS (SELECT season, n, h, CAST(i AS INTEGER) AS grid_index, (lo - 3 * h) + i * ((hi + 3 * h - (lo - 3 * h)) / {gridsize - 1}) AS x
          FROM s, range(0, {gridsize}) t(i)),
    c AS (SELECT season, v, count(*) AS m FROM src GROUP BY 1, 2)
    SELECT g.season, grid_index, {r("x")}, {r(f"sum(m * exp(-pow((x - v) / h, 2) / 2)) / ({total} * h * sqrt(2 * pi()))", "density")}
    FROM g JOIN c ON g.season = c.season GROUP BY g.season, grid_index, x, n, h"""


TWENTIETHS = "(SELECT k, k * 5 / 1e2 AS p FROM range(0, 21) t(k))"
QUANTILE_EDGES = "[" + ", ".join(f"quantile_cont(income, {round(0.05 * k, 2)})" for k in range(21)) + "]"

ORACLES: dict[str, str] = {
    # ---------------------------------------------------------------- tables
    "summary_stats": sql(f"SELECT geo_id, lead_time, {SKILL} FROM bias1 GROUP BY geo_id, lead_time", "bias1"),
    "bias_table": sql(f"SELECT {BIAS} FROM bias1", "bias1"),
    "query_bias_filtered": sql(
        f"""SELECT {BIAS} FROM bias1 WHERE lead_time IN (24, 72) AND valid_time >= TIMESTAMP '1997-01-01'
        AND valid_time <= TIMESTAMP '1999-12-31' AND geo_id IN ('00001', '00003', '00007')""", "bias1"),
    "anomaly_table": sql(f"SELECT {BIAS}, day_of_year, {rs('t2m_clim fc_anom an_anom')} FROM anom", "anom"),
    "climatology": sql(f"SELECT geo_id, day_of_year, {r('t2m_clim')} FROM clim", "clim"),
    "climatology_incremental": sql(f"SELECT geo_id, day_of_year, {r('t2m_clim')} FROM clim", "clim"),
    "climatology_stream": f"""
        SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS geo_id,
        {noleap('l_shipdate')} AS day_of_year, {r('avg(2.7315e2 + l_quantity)', 't2m_clim')}
        FROM lineitem WHERE NOT (month(l_shipdate) = 2 AND day(l_shipdate) = 29) GROUP BY 1, 2""",
    "daily_series_without_leap_days": sql(f"SELECT geo_id, time, {r('t2m')}, {{doy:time}} AS day_of_year FROM daily", "daily"),
    "model_comparison": sql(
        f"""SELECT a.geo_id, a.valid_time, a.lead_time, {r('a.bias', 'bias_ifs')}, {r('a.abs_error', 'abs_error_ifs')},
        {r('b.bias', 'bias_aifs')}, {r('b.abs_error', 'abs_error_aifs')}, {r('b.bias - a.bias', 'bias_diff')},
        {r('b.abs_error - a.abs_error', 'abs_error_diff')}, {r('a.aland', 'aland')}
        FROM bias1 a JOIN bias2 b ON a.geo_id = b.geo_id AND a.valid_time = b.valid_time AND a.lead_time = b.lead_time""", "bias1", "bias2"),
    "stored_anomalies": sql(f"SELECT {BIAS}, day_of_year, {rs('t2m_clim fc_anom an_anom')} FROM anom", "anom"),
    "stored_comparison": sql(
        f"""SELECT a.geo_id, a.valid_time, a.lead_time, {r('a.bias', 'bias_ifs')}, {r('a.abs_error', 'abs_error_ifs')},
        {r('b.bias', 'bias_aifs')}, {r('b.abs_error', 'abs_error_aifs')}, {r('b.bias - a.bias', 'bias_diff')},
        {r('b.abs_error - a.abs_error', 'abs_error_diff')}
        FROM bias1 a JOIN bias2 b ON a.geo_id = b.geo_id AND a.valid_time = b.valid_time AND a.lead_time = b.lead_time""", "bias1", "bias2"),
    "relaid_by_month": f"""
        SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(DISTINCT o_orderdate) AS n_days,
        {r('sum(o_totalprice)', 'total')} FROM orders GROUP BY 1, 2""",
    "file_heads": """
        WITH f AS (
            SELECT c_nationkey AS k, min(line) AS first, sum(length(line) + 1)::BIGINT AS length FROM (
                SELECT c_nationkey, CASE c_nationkey % 3 WHEN 0 THEN 'CDF' WHEN 1 THEN 'GRIB' ELSE 'CD' END || c_name AS line FROM customer
            ) GROUP BY 1
        )
        SELECT k, length, left(first, 4) AS head, length < 10000 AS too_small, k % 3 <> 0 AS wrong_magic, length < 10000 OR k % 3 <> 0 AS suspect FROM f""",
    "spill_over_month": sql(
        f"""SELECT geo_id, valid_time, init_time, lead_time, {r('t2m')}, {ym('init_time')} FROM fc1
        WHERE valid_time >= TIMESTAMP '1998-03-01' AND valid_time < TIMESTAMP '1998-04-01'""", "fc1"),
    "stored_chunks": sql(f"SELECT geo_id, valid_time, init_time, {r('t2m')}, {ym('init_time')}, lead_time FROM fc1", "fc1"),
    "workspace_sql": sql(
        f"""SELECT b.lead_time, count(*) AS n_rows, {r('avg(b.bias)', 'mean_bias')}, {r('max(a.t2m)', 'warmest')}
        FROM bias1 b JOIN an a ON b.geo_id = a.geo_id AND b.valid_time = a.time GROUP BY b.lead_time""", "bias1", "an"),
    "workspace_views": sql(
        """SELECT 'ifs_bias' AS view, count(*) AS n_rows FROM bias1 UNION ALL SELECT 'ifs_an', count(*) FROM an
        UNION ALL SELECT 'ifs_an_monthly', count(*) FROM an""", "bias1", "an"),
    "consolidated_chunks": sql(f"SELECT geo_id, valid_time, init_time, lead_time, {r('t2m')} FROM fc1", "fc1"),
    "appended_batches": sql(f"SELECT geo_id, valid_time, init_time, lead_time, {rs('t2m_fc t2m_an bias abs_error aland')} FROM bias1", "bias1"),
    "written_once": sql(
        f"""SELECT geo_id, time, {r('t2m + CASE WHEN forced THEN 1 ELSE 0 END', 't2m')}, forced FROM an, (SELECT unnest([false, true]) AS forced) k""", "an"),
    "table_metadata": sql(
        """SELECT 'geo_id' AS name, 'string' AS type, '1' AS units, count(geo_id) AS n_values FROM bias1
        UNION ALL SELECT 'valid_time', 'timestamp_ntz', 'UTC', count(valid_time) FROM bias1 UNION ALL SELECT 'init_time', 'timestamp_ntz', 'UTC', count(init_time) FROM bias1
        UNION ALL SELECT 'lead_time', 'int', 'hours', count(lead_time) FROM bias1 UNION ALL SELECT 't2m_fc', 'double', 'K', count(t2m_fc) FROM bias1
        UNION ALL SELECT 't2m_an', 'double', 'K', count(t2m_an) FROM bias1 UNION ALL SELECT 'bias', 'double', 'K', count(bias) FROM bias1
        UNION ALL SELECT 'abs_error', 'double', 'K', count(abs_error) FROM bias1 UNION ALL SELECT 'aland', 'double', 'km2', count(aland) FROM bias1""", "bias1"),
    "csv_round_trip": sql(f"SELECT geo_id, statefp, {r('aland_m2')} FROM area", "area"),
    "layer_round_trip": sql(
        f"""SELECT p.geo_id, CAST(p.statefp AS VARCHAR) AS statefp, {r('aland_m2')}, {r('x0', 'west')}, {r('y1', 'north')}
        FROM polys p JOIN area a ON p.geo_id = a.geo_id""", "polys", "area"),
    "stored_cube": sql(f"SELECT grid_id, {rs('lat lon')}, time, {r('f - a', 'error')}, {ym('time')} FROM mobs", "mobs"),
    "tolerant_scan": sql("SELECT count(*) AS n_rows, count(value) AS n_values, CAST(1 AS BIGINT) AS n_skipped FROM cells", "cells"),
    "streamed_chunks": sql(f"SELECT geo_id, time, {r('t2m')}, {ym('time')} FROM an", "an"),
    "skill_by_lead": sql(f"SELECT model, lead_time, {SKILL} FROM {BOTH} GROUP BY model, lead_time", "bias1", "bias2"),
    "skill_by_lead_area_weighted": sql(f"SELECT model, lead_time, {ACC_SKILL} FROM {BOTH} WHERE aland IS NOT NULL GROUP BY model, lead_time", "bias1", "bias2"),
    "bias_month_lead": sql(f"SELECT CAST(month(valid_time) AS INTEGER) AS month, lead_time, {r('avg(bias)', 'mean_bias')} FROM bias1 GROUP BY 1, 2", "bias1"),
    "bias_month_lead_pivot": sql(
        "SELECT lead_time, " + ", ".join(r(f"avg(CASE WHEN month(valid_time) = {m} THEN bias END)", f"m{m:02d}") for m in range(1, 13))
        + " FROM bias1 GROUP BY lead_time", "bias1"),
    "anom_month_lead": sql(
        f"""SELECT CAST(month(valid_time) AS INTEGER) AS month, lead_time, {r('avg(fc_anom)', 'mean_fc_anom')},
        {r('avg(an_anom)', 'mean_an_anom')} FROM anom GROUP BY 1, 2""", "anom"),
    "anom_month_lead_area_weighted": sql(
        f"""SELECT CAST(month(valid_time) AS INTEGER) AS month, lead_time, {r('sum(aland * fc_anom) / sum(aland)', 'mean_fc_anom')},
        {r('sum(aland * an_anom) / sum(aland)', 'mean_an_anom')} FROM anom WHERE aland IS NOT NULL GROUP BY 1, 2""", "anom"),
    "county_mean_bias": sql(
        f"""SELECT geo_id, {r('avg(bias)', 'mean_bias')} FROM bias1 WHERE lead_time = 48 AND valid_time >= TIMESTAMP '1996-01-01'
        AND valid_time <= TIMESTAMP '2000-12-31' GROUP BY geo_id""", "bias1"),
    "mean_of_means": sql(
        f"""SELECT lead_time, {r('avg(b)', 'mean_mean_bias')}, {r('avg(q)', 'mean_rmse')}, {r('avg(m)', 'mean_mae')}, count(*) AS n_areas
        FROM (SELECT geo_id, lead_time, avg(bias) AS b, sqrt(avg(bias * bias)) AS q, avg(abs_error) AS m FROM bias1 GROUP BY 1, 2)
        GROUP BY lead_time""", "bias1"),
    "doy_lead_bias": sql(
        f"""SELECT geo_id, lead_time, CAST(dayofyear(valid_time) AS INTEGER) AS day_of_year, {r('avg(bias)', 'mean_bias')}, count(*) AS n_obs
        FROM bias1 GROUP BY 1, 2, 3""", "bias1"),
    "weighted_acc": sql(
        f"""WITH src AS (SELECT valid_time, fc_anom AS x, an_anom AS y, aland AS w FROM anom WHERE aland IS NOT NULL),
        m AS (SELECT valid_time, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my,
              max(x) - min(x) <= 1e-12 * greatest(abs(max(x)), abs(min(x)))
              OR max(y) - min(y) <= 1e-12 * greatest(abs(max(y)), abs(min(y))) AS flat FROM src GROUP BY 1)
        SELECT s.valid_time, {r('''CASE WHEN NOT max(flat) THEN sum(w * (x - mx) * (y - my))
          / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))) END''', 'acc')}, count(*) AS n_areas
        FROM src s JOIN m ON s.valid_time = m.valid_time GROUP BY 1""", "anom"),
    "seasonal_climatology": sql(
        f"""SELECT geo_id, {season_of_doy('day_of_year')} AS season, {r('avg(t2m_clim - 2.7315e2)', 't2m_c')} FROM clim GROUP BY 1, 2
        UNION ALL SELECT geo_id, 'annual', {r('avg(t2m_clim - 2.7315e2)', 't2m_c')} FROM clim GROUP BY 1""", "clim"),
    "doy_anomaly": sql(
        f"""WITH s AS (SELECT valid_time AS time, {{doy:valid_time}} AS day_of_year, avg(abs_error) AS mae FROM bias1 GROUP BY 1, 2)
        SELECT day_of_year, time, {r('mae')}, {r('avg(mae) OVER (PARTITION BY day_of_year)', 'doy_mean')},
        {r('mae - avg(mae) OVER (PARTITION BY day_of_year)', 'doy_anom')} FROM s""", "bias1"),
    "anomaly_range": sql(
        f"""SELECT {r('greatest(max(abs(fc_anom)), max(abs(an_anom)))', 'max_abs')}, {r('least(min(fc_anom), min(an_anom))', 'joint_min')},
        {r('greatest(max(fc_anom), max(an_anom))', 'joint_max')} FROM anom""", "anom"),
    "celsius_columns": sql(
        f"""SELECT geo_id, valid_time, lead_time, {r('t2m_fc - 2.7315e2', 't2m_fc_c')}, {r('t2m_an - 2.7315e2', 't2m_an_c')},
        {r('CASE WHEN abs_error > 0 THEN ln(abs_error) END', 'ln_abs_error')} FROM bias1""", "bias1"),
    "time_parts": sql(
        f"""WITH d AS (SELECT DISTINCT valid_time, lead_time FROM fc1)
        SELECT valid_time, lead_time, valid_time AS valid_again, {{doy:valid_time}} AS doy_noleap,
        CAST(dayofyear(valid_time) AS INTEGER) AS doy_calendar, {ym('valid_time')}, strftime(valid_time, '%Y%m') AS year_month,
        {season('valid_time')} AS season, {season_of_doy('{doy:valid_time}')} AS season_doy,
        CAST(date_trunc('month', valid_time) AS TIMESTAMP) AS month_first,
        CAST(date_trunc('month', valid_time) + INTERVAL 1 MONTH AS TIMESTAMP) AS next_month,
        CAST(date_trunc('month', valid_time) - INTERVAL 1 MONTH AS TIMESTAMP) AS previous_month,
        valid_time + INTERVAL 252 HOUR AS extended, CAST(day(last_day(valid_time)) AS INTEGER) AS n_days,
        CAST(least(day(last_day(valid_time)), CASE WHEN month(valid_time) = 2 THEN 28 ELSE 31 END) AS INTEGER) AS n_days_noleap FROM d""", "fc1"),
    "asof_nearest": """
        WITH req AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
        obs AS (SELECT user_id, ts, max(event_id) AS oid FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
        p AS (SELECT q.event_id, q.user_id, q.ts, o.ts AS pt, o.oid AS pid FROM req q ASOF LEFT JOIN obs o ON q.user_id = o.user_id AND q.ts >= o.ts),
        n AS (SELECT q.event_id, o.ts AS nt, o.oid AS nid FROM req q ASOF LEFT JOIN obs o ON q.user_id = o.user_id AND q.ts <= o.ts)
        SELECT user_id, ts, event_id, CASE WHEN later THEN nt ELSE pt END AS matched_time, CASE WHEN later THEN nid ELSE pid END AS matched_event_id
        FROM (SELECT p.*, nt, nid, nt IS NOT NULL AND (pt IS NULL OR nt - ts <= ts - pt) AS later FROM p JOIN n ON p.event_id = n.event_id)
        WHERE pt IS NOT NULL OR nt IS NOT NULL""",
    "analysis_nearest_step": sql(
        f"""WITH req AS (SELECT DISTINCT geo_id, valid_time + INTERVAL 12 HOUR AS time FROM fc1),
        p AS (SELECT q.geo_id, q.time, o.time AS pt, o.t2m AS pv FROM req q ASOF LEFT JOIN an o ON q.geo_id = o.geo_id AND q.time >= o.time),
        n AS (SELECT q.geo_id, q.time, o.time AS nt, o.t2m AS nv FROM req q ASOF LEFT JOIN an o ON q.geo_id = o.geo_id AND q.time <= o.time)
        SELECT geo_id, time, CASE WHEN later THEN nt ELSE pt END AS matched_time, {r('CASE WHEN later THEN nv ELSE pv END', 't2m')}
        FROM (SELECT p.*, nt, nv, nt IS NOT NULL AND (pt IS NULL OR nt - p.time <= p.time - pt) AS later
              FROM p JOIN n ON p.geo_id = n.geo_id AND p.time = n.time) WHERE pt IS NOT NULL OR nt IS NOT NULL""", "fc1", "an"),
    # ---------------------------------------------------------------- statistics
    "describe_overall": sql(f"SELECT {describe('abs_error')} FROM bias1", "bias1"),
    "describe_by_year": sql(f"SELECT CAST(year(valid_time) AS INTEGER) AS year, {describe('abs_error')} FROM bias1 GROUP BY 1", "bias1"),
    "describe_by_month": sql(f"SELECT CAST(month(valid_time) AS INTEGER) AS month, {describe('abs_error')} FROM bias1 GROUP BY 1", "bias1"),
    "describe_by_season": sql(f"SELECT {season('valid_time')} AS season, {describe('abs_error')} FROM bias1 GROUP BY 1", "bias1"),
    "describe_by_area": sql(f"SELECT geo_id, {describe('abs_error')} FROM bias1 GROUP BY 1", "bias1"),
    "describe_by_valid_time": sql(f"SELECT valid_time, {describe('bias')} FROM bias1 GROUP BY 1", "bias1"),
    "polygon_mean_std": sql(f"SELECT geo_id, {r('avg(abs_error)', 'mean')}, {r('stddev_samp(abs_error)', 'std')} FROM bias1 GROUP BY 1", "bias1"),
    "season_pivot": sql(
        "SELECT geo_id, " + ", ".join(
            r(f"{f}(CASE WHEN {season('valid_time')} = '{s}' THEN abs_error END)", f"{n}_{s.lower()}")
            for s in ("DJF", "MAM", "JJA", "SON") for n, f in (("mean", "avg"), ("std", "stddev_samp")))
        + " FROM bias1 GROUP BY geo_id", "bias1"),
    "histogram_bias": sql(hist("", False), "bias1"),
    "histogram_density_by_lead": sql(hist("lead_time", True), "bias1"),
    "box_stats": sql(box("abs_error", season("valid_time"), 5).replace("KEY", "season"), "bias1"),
    "box_stats_by_year": sql(box("bias", "CAST(year(valid_time) AS INTEGER)", 1.5).replace("KEY", "year"), "bias1"),
    "kde_rows": sql(kde(200, False), "bias1"),
    "kde_common_norm": sql(kde(50, True), "bias1"),
    "quantile_vector": sql(
        f"SELECT p AS prob, {r('q[k + 1]', 'value')} FROM (SELECT {QUANTILE_EDGES} AS q FROM income), {TWENTIETHS}", "income"),
    "population_bands": sql(
        f"""WITH s AS (SELECT min(income) AS lo0, max(income) AS hi0, sum(population) AS tp, sum(poor) AS tq FROM income),
        e AS (SELECT CAST(trunc(lo0) AS DOUBLE) AS lo, CAST(trunc(hi0) AS DOUBLE) AS hi, CAST(greatest(ceil((hi0 - lo0) / 500), 2) AS INTEGER) AS n, tp, tq FROM s),
        b AS (SELECT CAST(i AS INTEGER) AS band, lo + i * ((hi - lo) / (n - 1)) AS lo, lo + (i + 1) * ((hi - lo) / (n - 1)) AS hi, tp, tq
              FROM (SELECT e.*, unnest(range(0, n - 1)) AS i FROM e))
        SELECT band, {r('lo')}, {r('hi')}, {r('sum(population) / tp', 'share_population')}, {r('sum(poor) / tq', 'share_poor')}
        FROM b JOIN income ON income >= lo AND income <= hi GROUP BY band, lo, hi, tp, tq""", "income"),
    "population_bands_quantile": sql(
        f"""WITH e AS (SELECT {QUANTILE_EDGES} AS q FROM income),
        b AS (SELECT CAST(i AS INTEGER) AS band, q[i + 1] AS lo, CASE WHEN i < 20 THEN q[i + 2] END AS hi FROM e, range(0, 21) t(i))
        SELECT band, {r('lo')}, {r('hi')}, {r('sum(population) / (SELECT sum(population) FROM income)', 'share_population')},
        {r('sum(poor) / (SELECT sum(poor) FROM income)', 'share_poor')}
        FROM b JOIN income ON income >= lo AND income <= coalesce(hi, income) GROUP BY band, lo, hi""", "income"),
    "quartile_labels": sql(
        f"""WITH e AS (SELECT quantile_cont(income, 0.25) AS a, quantile_cont(income, 0.5) AS b, quantile_cont(income, 0.75) AS c FROM income)
        SELECT geo_id, {r('income')}, CASE WHEN income IS NULL THEN NULL WHEN income <= a THEN 'Q1' WHEN income <= b THEN 'Q2'
        WHEN income <= c THEN 'Q3' ELSE 'Q4' END AS quartile FROM income, e""", "income"),
    "rank_by_bias": sql(
        f"""WITH m AS (SELECT geo_id, {r('avg(bias)', 'mean_bias')} FROM bias1 WHERE lead_time = 24 GROUP BY geo_id)
        SELECT geo_id, mean_bias, row_number() OVER (ORDER BY mean_bias, geo_id) AS rank FROM m""", "bias1"),
    "zscore": sql(
        f"""SELECT geo_id, {r('population')}, {r('poor')}, {r('(population - mp) / (sp + 1e-8)', 'z_population')}, {r('(poor - mq) / (sq + 1e-8)', 'z_poor')}
        FROM income, (SELECT avg(population) AS mp, stddev_pop(population) AS sp, avg(poor) AS mq, stddev_pop(poor) AS sq FROM income)""", "income"),
    "min_max": sql(
        f"""SELECT grid_id, {rs('lat lon value')}, {r('(lat - la) / (lb - la)', 'scaled_lat')}, {r('(value - va) / (vb - va)', 'scaled_value')}
        FROM cells, (SELECT min(lat) AS la, max(lat) AS lb, min(value) AS va, max(value) AS vb FROM cells)""", "cells"),
    "mean_range": sql(
        f"""SELECT grid_id, {rs('lat lon value')}, {r('(lon - lm) / lr', 'scaled_lon')}, {r('(value - vm) / vr', 'scaled_value')}
        FROM cells, (SELECT avg(lon) AS lm, max(lon) - min(lon) AS lr, avg(value) AS vm, max(value) - min(value) AS vr FROM cells)""", "cells"),
    "cyclic_features": sql(
        f"""SELECT time, {r('lon')}, {r('sin(2 * pi() * d / 365)', 'doy_sin')}, {r('cos(2 * pi() * d / 365)', 'doy_cos')},
        {r('(sin(d / 365e0 * 2 * pi()) + 1) / 2', 'doy_01')}, {r('(sin(hour(time) / 24e0 * 2 * pi()) + 1) / 2', 'hour_01')},
        {r('(cos(lon / 360e0 * 2 * pi()) + 1) / 2', 'lon_01')} FROM (SELECT DISTINCT time, lon, {{doy:time}} AS d FROM obs)""", "obs"),
    "split_counts": """
        SELECT CASE WHEN h < 1e-1 THEN 'test' WHEN h < 1.9e-1 THEN 'valid' ELSE 'train' END AS split, event_type, count(*) AS n
        FROM (SELECT event_type, CAST('0x' || substr(md5(concat_ws('|', CAST(event_id AS VARCHAR), '42')), 1, 8) AS BIGINT) / 4294967296e0 AS h FROM events)
        GROUP BY 1, 2""",
    "random_times": sql(
        """SELECT valid_time FROM (SELECT DISTINCT valid_time FROM bias1) ORDER BY md5(concat_ws('|', CAST(valid_time AS VARCHAR), '7')), valid_time LIMIT 4""", "bias1"),
    # ---------------------------------------------------------------- census
    "census_estimates": sql(
        f"""SELECT geo_id, NAME, {r('B01001_001E', 'B01001_001')}, {r('B17001_001E', 'B17001_001')}, {r('B17001_002E', 'B17001_002')},
        {r('B19013_001E', 'B19013_001')} FROM census""", "census"),
    "census_margins": sql(f"SELECT geo_id, NAME, {r('B01001_001M', 'B01001_001')} FROM census", "census"),
    "wide_split_est_moe": sql(
        f"""SELECT geo_id, variable, {r('estimate')}, {r('margin')} FROM (
        SELECT geo_id, 'B01001_001' AS variable, B01001_001E AS estimate, B01001_001M AS margin FROM census
        UNION ALL SELECT geo_id, 'B17001_001', B17001_001E, NULL FROM census
        UNION ALL SELECT geo_id, 'B17001_002', B17001_002E, NULL FROM census
        UNION ALL SELECT geo_id, 'B19013_001', B19013_001E, NULL FROM census)""", "census"),
    "census_estimate_columns": sql(f"SELECT geo_id, NAME, {rs('B01001_001E B17001_001E B17001_002E B19013_001E')} FROM census", "census"),
    "census_rates": sql(
        f"""SELECT c.geo_id, {r('CASE WHEN B17001_001E <> 0 THEN B17001_002E / B17001_001E * 100 END', 'poverty_rate')},
        {r('CASE WHEN B17001_001E <> 0 THEN B17001_002E / B17001_001E END', 'poverty_ratio')},
        {r('B01001_001E / aland_m2 / 1000 * 1e9', 'density_1e9')}, {r('CASE WHEN B19013_001E >= 0 THEN B19013_001E END', 'income')}
        FROM census c JOIN area a ON c.geo_id = a.geo_id""", "census", "area"),
    "census_glued": sql(f"SELECT geo_id, {rs('B01001_001E B17001_002E B19013_001E')}, NAME FROM census", "census"),
    "tables_outer_aligned": sql(
        f"""SELECT coalesce(m.geo_id, i.geo_id, l.geo_id) AS geo_id, {rs('mean_bias population poor income aland')}
        FROM (SELECT geo_id, avg(bias) AS mean_bias FROM bias1 WHERE lead_time = 24 GROUP BY 1) m
        FULL JOIN income i ON m.geo_id = i.geo_id FULL JOIN land l ON coalesce(m.geo_id, i.geo_id) = l.geo_id""", "bias1", "income"),
    "map_layer": sql(
        f"""SELECT a.geo_id, a.statefp, {r('mean_bias')} FROM area a LEFT JOIN (SELECT geo_id, avg(bias) AS mean_bias FROM bias1
        WHERE lead_time = 24 GROUP BY 1) m ON a.geo_id = m.geo_id""", "bias1"),
    "fips_ids": """
        SELECT s_suppkey, a || b AS county_id, a || b || c AS tract_id, d AS geo_id, right(a || b, 5) AS tail_id FROM (
        SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), CAST(greatest(2, length(CAST(s_nationkey AS VARCHAR))) AS INTEGER), '0') AS a,
          lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS b,
          lpad(CAST(s_suppkey * 7 AS VARCHAR), CAST(greatest(6, length(CAST(s_suppkey * 7 AS VARCHAR))) AS INTEGER), '0') AS c,
          lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS d FROM supplier)""",
    "json_rows_to_table": """
        SELECT s_name AS NAME, CAST(s_nationkey AS VARCHAR) AS state,
        CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(s_suppkey * 3 AS DOUBLE) END AS population FROM supplier""",
    "contiguity_edges": sql(
        """SELECT a.node_idx AS src, b.node_idx AS dst FROM nbrs_wide n JOIN nodes a ON n.geo_id = a.geo_id
        JOIN nodes b ON n.neighbour = b.geo_id WHERE a.node_idx < b.node_idx""", "nbrs_wide", "nodes"),
    "node_order": sql("SELECT geo_id, node_idx FROM nodes", "nodes"),
    "contiguity_stats": sql(
        f"""SELECT count(*) AS n_nodes, count(CASE WHEN coalesce(d, 0) = 0 THEN 1 END) AS n_islands, {r('avg(coalesce(d, 0))', 'mean_neighbours')},
        CAST(sum(coalesce(d, 0)) AS BIGINT) AS n_nonzero FROM nodes LEFT JOIN (SELECT geo_id, count(*) AS d FROM nbrs_wide GROUP BY 1) n ON nodes.geo_id = n.geo_id""", "nbrs_wide", "nodes"),
    "edge_energy": sql(
        f"""WITH m AS (SELECT geo_id, avg(bias) AS v FROM bias1 WHERE lead_time = 24 GROUP BY 1)
        SELECT {r('-5e-1 * sum(pow(a.v - b.v, 2))', 'energy')}, count(*) AS n_edges FROM nbrs_wide n JOIN m a ON n.geo_id = a.geo_id
        JOIN m b ON n.neighbour = b.geo_id WHERE n.geo_id < n.neighbour""", "bias1", "nbrs_wide"),
    "model_input": sql(
        f"""SELECT geo_id, lead_time, day_of_year, {r('mean_bias')}, n_obs, koppen_class, {rs('demo_B01001_001E demo_B17001_002E')} FROM model""", "model"),
    "model_rows_for_lead": sql(
        f"""WITH d AS (SELECT m.*, n.node_idx FROM model m JOIN nodes n ON m.geo_id = n.geo_id WHERE lead_time = 24),
        s AS (SELECT avg(demo_B01001_001E) AS ma, stddev_pop(demo_B01001_001E) AS sa, avg(demo_B17001_002E) AS mb, stddev_pop(demo_B17001_002E) AS sb FROM d)
        SELECT geo_id, lead_time, day_of_year, {r('mean_bias')}, n_obs, koppen_class, {rs('demo_B01001_001E demo_B17001_002E')}, node_idx,
        {r('sin(2 * pi() * day_of_year / 365)', 'season_sin')}, {r('cos(2 * pi() * day_of_year / 365)', 'season_cos')},
        {r('(demo_B01001_001E - ma) / (sa + 1e-8)', 'z_demo_B01001_001E')}, {r('(demo_B17001_002E - mb) / (sb + 1e-8)', 'z_demo_B17001_002E')} FROM d, s""", "model", "nodes"),
    "ols_fixed_effects": sql(
        f"""WITH d AS (SELECT * FROM model WHERE lead_time = 24),
        s AS (SELECT avg(demo_B01001_001E) AS ma, stddev_pop(demo_B01001_001E) AS sa, avg(demo_B17001_002E) AS mb, stddev_pop(demo_B17001_002E) AS sb FROM d),
        x AS (SELECT mean_bias AS y, sin(2 * pi() * day_of_year / 365) AS x1, cos(2 * pi() * day_of_year / 365) AS x2,
                (demo_B01001_001E - ma) / (sa + 1e-8) AS x3, (demo_B17001_002E - mb) / (sb + 1e-8) AS x4 FROM d, s
              WHERE mean_bias + demo_B01001_001E + demo_B17001_002E IS NOT NULL),
        e2 AS (SELECT *, x2 - regr_slope(x2, x1) OVER () * x1 AS r2 FROM x),
        e3 AS (SELECT *, x3 - regr_slope(x3, x1) OVER () * x1 - regr_slope(x3, r2) OVER () * r2 AS r3 FROM e2),
        e4 AS (SELECT *, x4 - regr_slope(x4, x1) OVER () * x1 - regr_slope(x4, r2) OVER () * r2 - regr_slope(x4, r3) OVER () * r3 AS r4 FROM e3),
        s4 AS (SELECT *, regr_slope(y, r4) OVER () AS b4 FROM e4),
        s3 AS (SELECT *, regr_slope(y - b4 * x4, r3) OVER () AS b3 FROM s4),
        s2 AS (SELECT *, regr_slope(y - b4 * x4 - b3 * x3, r2) OVER () AS b2 FROM s3),
        s1 AS (SELECT *, regr_slope(y - b4 * x4 - b3 * x3 - b2 * x2, x1) OVER () AS b1 FROM s2),
        b AS (SELECT avg(y - b4 * x4 - b3 * x3 - b2 * x2 - b1 * x1) AS b0, max(b1) AS b1, max(b2) AS b2, max(b3) AS b3, max(b4) AS b4 FROM s1)
        SELECT term, {r('coefficient')} FROM (
          SELECT 'intercept' AS term, b0 AS coefficient FROM b UNION ALL SELECT 'season_sin', b1 FROM b UNION ALL SELECT 'season_cos', b2 FROM b
          UNION ALL SELECT 'z_demo_B01001_001E', b3 FROM b UNION ALL SELECT 'z_demo_B17001_002E', b4 FROM b)""", "model"),
    # ---------------------------------------------------------------- grid
    "cell_bounds": sql(f"SELECT grid_id, {rs('lat lon lat_lo lat_hi lon_lo lon_hi')} FROM bounds", "bounds"),
    "cell_polygon_weights": sql(f"SELECT grid_id, geo_id, {rs('lat lon')}, {r('w * 1000', 'w')} FROM weights", "weights"),
    "area_weighted_mean": sql(
        f"""SELECT geo_id, {r('sum(w * value) / sum(w)', 'value')} FROM cells c JOIN weights w ON c.grid_id = w.grid_id AND c.lat = w.lat AND c.lon = w.lon
        WHERE value IS NOT NULL GROUP BY 1""", "cells", "weights"),
    "area_weighted_series": sql(
        f"""SELECT geo_id, time, {r('sum(w * f) / sum(w)', 'f')} FROM obs c JOIN weights w ON c.grid_id = w.grid_id AND c.lat = w.lat AND c.lon = w.lon GROUP BY 1, 2""", "obs", "weights"),
    "area_forecasts": sql(
        f"""SELECT geo_id, time AS valid_time, time - lead_time * INTERVAL '1' HOUR AS init_time, lead_time, {r('sum(w * a) / sum(w)', 't2m')}
        FROM obs c JOIN weights w ON c.grid_id = w.grid_id AND c.lat = w.lat AND c.lon = w.lon GROUP BY 1, 2, 3, 4""", "obs", "weights"),
    "area_daily_means": sql(
        f"""WITH d AS (SELECT grid_id, lat, lon, date_trunc('day', time) AS time, avg(f) AS f FROM obs
          WHERE NOT (month(time) = 2 AND day(time) = 29) GROUP BY 1, 2, 3, 4)
        SELECT geo_id, CAST(time AS TIMESTAMP) AS time, {r('sum(w * f) / sum(w)', 'f')}
        FROM d c JOIN weights w ON c.grid_id = w.grid_id AND c.lat = w.lat AND c.lon = w.lon GROUP BY 1, 2""", "obs", "weights"),
    "category_fractions": sql(f"SELECT geo_id, category, {r('fraction')} FROM shares", "shares"),
    "category_fractions_known": sql(
        f"""SELECT geo_id, category, {r('fraction')} FROM (SELECT geo_id, category, sum(w) / sum(sum(w)) OVER (PARTITION BY geo_id) AS fraction
        FROM cells c JOIN weights w ON c.grid_id = w.grid_id AND c.lat = w.lat AND c.lon = w.lon WHERE category IS NOT NULL GROUP BY geo_id, category)""", "cells", "weights"),
    "category_top2": sql(f"SELECT geo_id, category_1, {r('category_1_pct')}, category_2, {r('category_2_pct')} FROM top2", "top2"),
    "daily_mean": sql(
        f"SELECT grid_id, {rs('lat lon')}, {r('avg(f)', 'f')}, CAST(date_trunc('day', time) AS TIMESTAMP) AS time FROM obs GROUP BY grid_id, lat, lon, date_trunc('day', time)", "obs"),
    "regular_grid": sql(
        f"""SELECT grid_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('south + i * 3e-1', 'lat')}, {r('west + j * 3e-1', 'lon')} FROM (
        SELECT *, unnest(range(0, CAST(floor((east - west) / 3e-1 + 1e-9) AS BIGINT) + 1)) AS j FROM (
        SELECT *, unnest(range(0, CAST(floor((north - south) / 3e-1 + 1e-9) AS BIGINT) + 1)) AS i FROM boxes))""", "boxes"),
    "regrid_nearest": sql(
        f"""WITH t AS (SELECT grid_id, i, j, south + i * 3e-1 AS lat, west + j * 3e-1 AS lon FROM (
          SELECT *, unnest(range(0, CAST(floor((east - west) / 3e-1 + 1e-9) AS BIGINT) + 1)) AS j FROM (
          SELECT *, unnest(range(0, CAST(floor((north - south) / 3e-1 + 1e-9) AS BIGINT) + 1)) AS i FROM boxes)))
        SELECT t.grid_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('t.lat')}, {r('t.lon')}, {r('value')} FROM t
        LEFT JOIN cells c ON t.grid_id = c.grid_id AND ceil(t.lat / 1.25e-1 - 5e-1) = round(c.lat / 1.25e-1)
          AND ceil((t.lon + 1.25e2) / 1.25e-1 - 5e-1) = round((c.lon + 1.25e2) / 1.25e-1)""", "cells", "boxes"),
    "regrid_bilinear": sql(
        f"""WITH t AS (SELECT grid_id, south + i * 5e-2 AS lat, west + j * 5e-2 AS lon FROM (
          SELECT *, unnest(range(0, CAST(floor((east - west) / 5e-2 + 1e-9) AS BIGINT) + 1)) AS j FROM (
          SELECT *, unnest(range(0, CAST(floor((north - south) / 5e-2 + 1e-9) AS BIGINT) + 1)) AS i FROM boxes))),
        g AS (SELECT *, lat / 1.25e-1 AS y, (lon + 1.25e2) / 1.25e-1 AS x FROM t),
        k AS (SELECT grid_id, lat, lon, CAST(floor(y) AS INTEGER) + di AS ci, CAST(floor(x) AS INTEGER) + dj AS cj,
          (CASE WHEN di = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dj = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
          FROM g, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(di, dj)),
        s AS (SELECT grid_id, CAST(round(lat / 1.25e-1) AS INTEGER) AS ci, CAST(round((lon + 1.25e2) / 1.25e-1) AS INTEGER) AS cj, value FROM cells)
        SELECT k.grid_id, {r('k.lat')}, {r('k.lon')}, {r('CASE WHEN count(value) = count(*) THEN sum(w * value) END', 'value')}
        FROM k LEFT JOIN s ON k.grid_id = s.grid_id AND k.ci = s.ci AND k.cj = s.cj WHERE w > 1e-9 GROUP BY k.grid_id, k.lat, k.lon""", "cells", "boxes"),
    "cos_lat_mean": sql(f"SELECT grid_id, time, {r('sum(cos(radians(lat)) * f) / sum(cos(radians(lat)))', 'f')} FROM obs GROUP BY 1, 2", "obs"),
    "cell_rmse_components": sql(
        f"""SELECT grid_id, {rs('lat lon')}, {r('avg((f - c) * (f - c))', 'fc_variance')}, {r('avg((a - c) * (a - c))', 'an_variance')},
        {r('avg((f - c) * (a - c))', 'covariance')}, {r('sqrt(avg(pow(f - a, 2)))', 'rmse')} FROM mobs GROUP BY grid_id, lat, lon""", "mobs"),
    "cell_mae": sql(f"SELECT grid_id, {rs('lat lon')}, {r('avg(abs(f - a))', 'mae')} FROM mobs GROUP BY grid_id, lat, lon", "mobs"),
    "cell_mae_season": sql(f"SELECT grid_id, {rs('lat lon')}, {season('time')} AS season, {r('avg(abs(f - a))', 'mae')} FROM mobs GROUP BY grid_id, lat, lon, {season('time')}", "mobs"),
    "cube_marginals": sql(
        f"""SELECT 'lat' AS margin, CAST(NULL AS TIMESTAMP) AS time, {r('lat')}, {r('avg(f)', 'mean')}, count(f) AS n FROM obs_wide GROUP BY lat
        UNION ALL SELECT 'time', time, NULL, floor(round(avg(f), 9) * 1e6 + 5e-1) / 1e6, count(f) FROM obs_wide GROUP BY time
        UNION ALL SELECT 'time_lat', time, floor(round(lat, 9) * 1e6 + 5e-1) / 1e6, floor(round(avg(f), 9) * 1e6 + 5e-1) / 1e6, count(f) FROM obs_wide GROUP BY time, lat
        UNION ALL SELECT 'all', NULL, NULL, floor(round(avg(f), 9) * 1e6 + 5e-1) / 1e6, count(f) FROM obs_wide""", "obs_wide"),
    "reconstruction_rmse": sql(f"SELECT {r('sqrt(avg(pow(f - a, 2)))', 'rmse')} FROM obs", "obs"),
    "reconstruction_rmse_cell": sql(f"SELECT grid_id, {rs('lat lon')}, {r('sqrt(avg(pow(f - a, 2)))', 'rmse')} FROM obs GROUP BY grid_id, lat, lon", "obs"),
    "lat_profile": sql(
        f"""SELECT time, lat_idx, {r('lat')}, {r('f')} FROM (SELECT time, lat, avg(f) AS f FROM obs_wide GROUP BY 1, 2)
        JOIN (SELECT lat, CAST(row_number() OVER (ORDER BY lat) - 1 AS INTEGER) AS lat_idx FROM (SELECT DISTINCT lat FROM obs_wide)) USING (lat)""", "obs_wide"),
    "detrend_linear": sql(
        f"""WITH ax AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t FROM (SELECT DISTINCT time FROM mobs)),
        d AS (SELECT m.*, ax.t FROM mobs m JOIN ax ON m.time = ax.time),
        l AS (SELECT grid_id, lat, lon, regr_slope(f, t) AS s, regr_intercept(f, t) AS i, count(*) AS n, min(t) = max(t) AS single FROM d GROUP BY 1, 2, 3)
        SELECT d.grid_id, {r('d.lat')}, {r('d.lon')}, d.time, {r('f')}, t, {r('CASE WHEN single THEN 0 ELSE f - (i + s * t) END', 'detrended')}
        FROM d JOIN l ON d.grid_id = l.grid_id AND d.lat = l.lat AND d.lon = l.lon""", "mobs"),
    "series_trend": sql(
        f"""WITH s AS (SELECT time, avg(f) AS f FROM obs GROUP BY time), d AS (SELECT f, row_number() OVER (ORDER BY time) - 1 AS t FROM s)
        SELECT {r('regr_slope(f, t) * 1e6', 'slope')}, {r('regr_intercept(f, t)', 'intercept')}, {r('regr_r2(f, t)', 'r2')}, count(*) AS n FROM d""", "obs"),
    "grid_anomaly": sql(
        f"""WITH o AS (SELECT *, {{doy:time}} AS day_of_year FROM mobs WHERE NOT (month(time) = 2 AND day(time) = 29)),
        k AS (SELECT grid_id, lat, lon, day_of_year, avg(c) AS clim FROM o GROUP BY 1, 2, 3, 4)
        SELECT o.grid_id, {r('o.lat')}, {r('o.lon')}, o.day_of_year, o.time, {r('f')}, {r('clim')}, {r('f - clim', 'anom')}
        FROM o JOIN k ON o.grid_id = k.grid_id AND o.lat = k.lat AND o.lon = k.lon AND o.day_of_year = k.day_of_year""", "mobs"),
    "bounding_box": sql(f"SELECT grid_id, {rs('lat lon value')} FROM cells WHERE lat BETWEEN 0.5 AND 3.5 AND lon BETWEEN -124 AND -120", "cells"),
    "level_mean_height": sql(
        f"""SELECT grid_id, {rs('lat lon')}, {r('avg(f * 196) / 9.80665e0', 'height')} FROM obs
        WHERE lead_time = 120 AND lat BETWEEN 0 AND 45 AND lon BETWEEN -124.5 AND -119.5 GROUP BY grid_id, lat, lon""", "obs"),
    "point_in_polygon": sql(
        f"""SELECT grid_id, {rs('lat lon')} FROM cells c WHERE EXISTS (SELECT 1 FROM region_polys p
        WHERE p.grid_id = c.grid_id AND c.lon >= x0 AND c.lon < x1 AND c.lat >= y0 AND c.lat < y1)""", "cells", "region_polys"),
    "cells_within_polygon": sql(
        f"""SELECT b.grid_id, {rs('lat lon')}, geo_id FROM bounds b JOIN polys p ON b.grid_id = p.grid_id
        AND lon_lo >= x0 AND lon_hi <= x1 AND lat_lo >= y0 AND lat_hi <= y1""", "bounds", "polys"),
    "cells_intersecting_polygon": sql(
        f"""SELECT b.grid_id, {rs('lat lon')}, geo_id FROM bounds b LEFT JOIN polys p ON b.grid_id = p.grid_id
        AND lon_lo <= x1 AND lon_hi >= x0 AND lat_lo <= y1 AND lat_hi >= y0""", "bounds", "polys"),
    "cell_attribute_means": sql(
        f"""SELECT b.grid_id, {rs('lat lon')}, {r('avg(aland)', 'aland')}, count(p.geo_id) AS n_polygons FROM bounds b
        LEFT JOIN polys p ON b.grid_id = p.grid_id AND lon_lo <= x1 AND lon_hi >= x0 AND lat_lo <= y1 AND lat_hi >= y0
        LEFT JOIN land l ON p.geo_id = l.geo_id GROUP BY b.grid_id, lat, lon""", "bounds", "polys", "land"),
    "polygon_text_area": sql(f"SELECT geo_id, {r('(x1 - x0) * (y1 - y0)', 'area')} FROM polys", "polys"),
    "weight_table_key": sql(
        """SELECT grid_id, substr(sha256(concat_ws('|', 'polygons.parquet', '2024-01-01',
        array_to_string(list_sort(list(DISTINCT lat)), ','), array_to_string(list_sort(list(DISTINCT lon)), ','))), 1, 16) AS key FROM cells GROUP BY 1""", "cells"),
    "stored_weights": sql(f"SELECT grid_id, geo_id, {rs('lat lon')}, {r('w * 1000', 'w')} FROM weights", "weights"),
    "gridded_scan": sql(f"SELECT grid_id, {rs('lat lon')}, time, {r('CASE WHEN f <= 320 THEN f END', 'f')} FROM obs", "obs"),
    "area_attributes": sql(f"SELECT geo_id, {r('aland')} FROM land", "land"),
    "cell_error_cube": sql(f"SELECT grid_id, {rs('lat lon')}, time, {r('f - a', 'error')} FROM mobs", "mobs"),
    # ---------------------------------------------------------------- catalogues and reports
    "file_dates": sql("SELECT path, init_time AS init_date, '0000' AS init_hour, lead_time, init_time FROM files", "files"),
    "forecast_catalogue": sql("SELECT init_time, lead_time, path FROM files", "files"),
    "analysis_catalogue": sql(
        """SELECT t.time, a.path FROM (SELECT unnest(generate_series(min(time), max(time), INTERVAL 6 HOUR)) AS time FROM anfiles) t
        JOIN anfiles a ON date_trunc('day', t.time) = a.time""", "anfiles"),
    "reanalysis_catalogue": """
        WITH f AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS ym FROM orders)
        SELECT time, concat('/ra/', ym, '/e5_an_sfc_167_', ym, '0100.nc') AS path
        FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS time FROM orders)
        JOIN f ON strftime(time, '%Y%m') = ym WHERE NOT (month(time) = 2 AND day(time) = 29)""",
    "align_semi": sql(
        """SELECT path, init_time, lead_time, init_time + lead_time * INTERVAL '1' HOUR AS valid_time FROM files
        WHERE init_time + lead_time * INTERVAL '1' HOUR IN (SELECT time FROM anfiles)""", "files", "anfiles"),
    "align_analyses": sql(
        "SELECT time, path FROM anfiles WHERE time IN (SELECT init_time + lead_time * INTERVAL '1' HOUR FROM files)", "files", "anfiles"),
    "init_time_check": """
        SELECT path, min(i) AS first_init, max(i) AS last_init, max(i <> l_shipdate) AS differs FROM (
          SELECT concat(strftime(l_shipdate, '%Y%m%d'), '_', l_linenumber * 24) AS path, l_shipdate,
                 l_shipdate + (CASE WHEN l_quantity > 49 THEN 6 ELSE 0 END) * INTERVAL '1' HOUR AS i FROM lineitem)
        GROUP BY path HAVING max(i <> l_shipdate)""",
    "grid_mismatches": sql(
        """WITH ref AS (SELECT DISTINCT grid_id, lat, lon FROM cells WHERE value IS NOT NULL), s AS (SELECT DISTINCT strftime(time, '%Y%m%d') AS path, grid_id, lat, lon FROM obs)
        SELECT path, (SELECT count(*) FROM ref) - count(k.lat) AS n_missing, count(*) - count(k.lat) AS n_extra
        FROM s LEFT JOIN ref k ON s.grid_id = k.grid_id AND s.lat = k.lat AND s.lon = k.lon GROUP BY path
        HAVING (SELECT count(*) FROM ref) - count(k.lat) > 0 OR count(*) - count(k.lat) > 0""", "cells", "obs"),
    "common_times": sql("SELECT valid_time AS time FROM fc1 INTERSECT SELECT valid_time FROM fc2 INTERSECT SELECT time FROM an", "fc1", "fc2", "an"),
    "distinct_leads": sql("SELECT DISTINCT lead_time FROM fc1 ORDER BY lead_time", "fc1"),
    "completeness_by_date": sql("SELECT init_time AS init_date, count(DISTINCT lead_time) AS n_pairs, count(DISTINCT lead_time) = 7 AS complete FROM files GROUP BY 1", "files"),
    "missing_slots": sql("SELECT init_time, lead_time FROM fc_slots EXCEPT SELECT init_time, lead_time FROM files", "fc_slots"),
    "source_completeness": sql(
        """WITH f AS (SELECT year(d) AS y, month(d) AS m, lead, count(*) AS n, count(CASE WHEN bad THEN 1 END) AS c FROM (
          SELECT l_shipdate AS d, l_linenumber * 24 AS lead, max(l_tax) >= 8e-2 AS bad FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2, 3)
        SELECT s.year, s.month, lead_time, n_days AS n_expected, coalesce(n, 0) AS n_found, coalesce(c, 0) AS n_corrupt,
          CASE WHEN coalesce(n, 0) = 0 THEN 'MISSING' WHEN c > 0 THEN 'CORRUPT' WHEN n <> n_days THEN 'INCOMPLETE' ELSE 'OK' END AS status
        FROM (SELECT * FROM months, leads) s LEFT JOIN f ON s.year = y AND s.month = m AND s.lead_time = lead""", "months", "leads"),
    "gap_report": sql("SELECT * FROM gaps", "gaps"),
    "gap_details": sql("SELECT *, greatest((SELECT count(*) FROM gaps) - 20, 0) AS n_more FROM gaps ORDER BY year, month LIMIT 20", "gaps"),
    "missing_dates": sql(
        """SELECT d AS o_orderdate FROM (SELECT unnest(generate_series(min(valid_time), max(valid_time), INTERVAL 1 DAY)) AS d FROM fc1) EXCEPT SELECT o_orderdate FROM odays""", "fc1", "odays"),
    "daily_staleness": sql(
        """SELECT m.year, m.month, coalesce(n, 0) AS n_days, e AS n_expected, CASE WHEN coalesce(n, 0) = 0 THEN 'MISSING' WHEN n <> e THEN 'STALE' ELSE 'OK' END AS status
        FROM (SELECT year, month, CAST(CASE WHEN month = 2 THEN 28 ELSE day(last_day(make_date(year, month, 1))) END AS INTEGER) AS e FROM months) m
        LEFT JOIN (SELECT year(time) AS y, month(time) AS mm, count(DISTINCT time) AS n FROM daily GROUP BY 1, 2) d ON m.year = y AND m.month = mm""", "months", "daily"),
    "chunk_completeness": sql(
        """WITH f AS (SELECT year(init_time) AS y, month(init_time) AS m, lead_time AS l, count(DISTINCT valid_time) AS n FROM fc1 GROUP BY 1, 2, 3),
        e AS (SELECT year, month, lead_time, CAST(2 * day(last_day(make_date(year, month, 1))) AS INTEGER) AS n_expected FROM months, leads)
        SELECT year, month, lead_time, n_expected, coalesce(n, 0) AS n_times, CASE WHEN coalesce(n, 0) = 0 THEN 'MISSING' WHEN n < n_expected THEN 'INCOMPLETE' ELSE 'OK' END AS status
        FROM e LEFT JOIN f ON year = y AND month = m AND lead_time = l""", "months", "leads", "fc1"),
    "analysis_chunk_completeness": sql(
        """WITH f AS (SELECT year(time) AS y, month(time) AS m, count(DISTINCT time) AS n FROM obs GROUP BY 1, 2)
        SELECT year, month, n_days * 4 AS n_expected, coalesce(n, 0) AS n_times, CASE WHEN coalesce(n, 0) = 0 THEN 'MISSING' WHEN n < n_days * 4 THEN 'INCOMPLETE' ELSE 'OK' END AS status
        FROM months LEFT JOIN f ON year = y AND month = m""", "months", "obs"),
    "clim_check": sql(
        """SELECT count(*) AS n_rows, min(day_of_year) AS doy_min, max(day_of_year) AS doy_max, count(DISTINCT day_of_year) AS n_doys, '' AS missing_columns,
        CASE WHEN min(day_of_year) = 1 AND max(day_of_year) = 365 AND count(DISTINCT day_of_year) = 365 THEN 'OK' ELSE 'PARTIAL' END AS status FROM clim""", "clim"),
    "cleanup_plan": sql(
        """WITH f AS (SELECT year(init_time) AS y, month(init_time) AS m, lead_time AS l, count(DISTINCT valid_time) AS n FROM fc1 GROUP BY 1, 2, 3),
        e AS (SELECT year, month, lead_time, CAST(day(last_day(make_date(year, month, 1))) AS INTEGER) AS x FROM months, leads),
        d AS (SELECT year, month, x, coalesce(n, 0) AS n FROM (SELECT year, month, CAST(CASE WHEN month = 2 THEN 28 ELSE day(last_day(make_date(year, month, 1))) END AS INTEGER) AS x FROM fmonths)
              LEFT JOIN (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM odays GROUP BY 1, 2) ON year = y AND month = m),
        c AS (SELECT count(DISTINCT day_of_year) AS n, min(day_of_year) AS a, max(day_of_year) AS b FROM clim)
        SELECT 'chunk' AS kind, year, month, lead_time, CAST(NULL AS VARCHAR) AS path, concat('INCOMPLETE ', n, '/', x) AS reason FROM e JOIN f ON year = y AND month = m AND lead_time = l WHERE n < x
        UNION ALL SELECT 'daily', year, month, NULL, NULL, concat('STALE ', n, '/', x) FROM d WHERE n <> x AND n > 0
        UNION ALL SELECT 'climatology', NULL, NULL, NULL, NULL, 'PARTIAL' FROM c WHERE NOT (n = 365 AND a = 1 AND b = 365) AND (SELECT count(*) FROM d WHERE n <> x) > 0""",
        "months", "leads", "fc1", "fmonths", "odays", "clim"),
    "table_presence": sql(
        """SELECT 'bias' AS "table", count(*) AS n_rows, 'OK' AS status FROM bias1 UNION ALL SELECT 'second_bias', count(*), 'OK' FROM bias2
        UNION ALL SELECT 'koppen', NULL, 'MISSING' UNION ALL SELECT 'census', count(*), 'OK' FROM census""", "bias1", "bias2", "census"),
    "chunk_groups": sql(f"SELECT lead_time, {ym('init_time')}, count(*) AS n_files FROM files GROUP BY 1, 2, 3", "files"),
    "chunk_names": sql(
        f"""SELECT concat('ifs_fc_2t_county_', year, '_', lpad(CAST(month AS VARCHAR), 2, '0'), '_lead', lpad(CAST(lead_time AS VARCHAR), 3, '0'), '.parquet') AS name,
        'ifs_fc' AS tag, year, month, lead_time FROM (SELECT DISTINCT lead_time, {ym('init_time')} FROM files)""", "files"),
    "expected_calendar": sql(
        """SELECT init_time, lead_time, init_time + lead_time * INTERVAL '1' HOUR AS valid_time
        FROM (SELECT unnest(generate_series(min(init_time), max(init_time), INTERVAL 12 HOUR)) AS init_time FROM fc1), leads""", "fc1", "leads"),
    "stream_states": sql(
        f"""SELECT stream, {ym('t')}, count(*) AS n_rows, count(DISTINCT t) AS n_times FROM (
        SELECT 'ifs_fc' AS stream, init_time AS t FROM fc1 UNION ALL SELECT 'aifs_fc', init_time FROM fc2 UNION ALL SELECT 'ifs_an', time FROM an) GROUP BY 1, 2, 3""", "fc1", "fc2", "an"),
}
