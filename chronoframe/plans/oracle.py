"""DuckDB SQL oracles for the SQL-expressible registered queries (same output
column names; doubles rounded to 6 decimals)."""

from __future__ import annotations

VARS = ["click", "error", "purchase", "signup", "view"]


def _pivot(src: str, val: str = "v") -> str:
    return ", ".join(f"max(CASE WHEN event_type = '{v}' THEN {val} END) AS {v}" for v in VARS)


HOURLY = f"""
hb AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS b, event_type, avg(value) AS v
       FROM events GROUP BY ALL),
rng AS (SELECT min(b) AS lo, max(b) AS hi FROM hb),
grid AS (SELECT CAST(g.idx AS BIGINT) AS idx FROM rng, generate_series(0, rng.hi - rng.lo) AS g(idx)),
hbi AS (SELECT hb.b - rng.lo AS idx, event_type, v FROM hb, rng),
hourly AS (SELECT grid.idx, {_pivot('hbi')} FROM grid LEFT JOIN hbi ON hbi.idx = grid.idx GROUP BY grid.idx)
"""

_FILL = ", ".join(
    f"coalesce(last_value({v} IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({v} IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {v}"
    for v in VARS)

FILLED = HOURLY + f""",
filled AS (SELECT idx, {_FILL} FROM hourly),
flong AS (SELECT idx, variable, value FROM (UNPIVOT filled ON {', '.join(VARS)} INTO NAME variable VALUE value))
"""

DIFF = FILLED + """,
dlong AS (SELECT variable, idx - 1 AS idx, value FROM (
            SELECT variable, idx, value - lag(value) OVER (PARTITION BY variable ORDER BY idx) AS value FROM flong)
          WHERE idx >= 1)
"""

Z975 = "1.959963984540054"


def _acf(src: str) -> str:
    return f""",
st AS (SELECT variable, count(*) AS n, avg(value) AS m FROM {src} GROUP BY variable),
ce AS (SELECT s.variable, s.idx, s.value - st.m AS xc FROM {src} s JOIN st USING (variable)),
nl AS (SELECT greatest(0, least(50, (min(n) // 2) - 1)) AS nl FROM st),
lags AS (SELECT CAST(g.lag AS BIGINT) AS lag FROM nl, generate_series(0, nl.nl) AS g(lag)),
prod AS (SELECT a.variable, lags.lag, sum(a.xc * b.xc) AS s
         FROM ce a CROSS JOIN lags JOIN ce b ON b.variable = a.variable AND b.idx = a.idx - lags.lag
         GROUP BY a.variable, lags.lag),
ac AS (SELECT p.variable, p.lag, p.s / z.s AS acf, st.n
       FROM prod p JOIN prod z ON z.variable = p.variable AND z.lag = 0 JOIN st ON st.variable = p.variable),
res AS (SELECT variable, lag, acf,
          CASE WHEN lag = 0 THEN 0.0 ELSE {Z975} * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag >= 1 THEN acf * acf END)
            OVER (PARTITION BY variable ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS band
        FROM ac)
SELECT variable, lag, round(acf, 6) AS acf, round(band, 6) AS band FROM res
"""


def _r(cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


LD = """
ld AS (SELECT user_id, ts, event_id,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS visit
       FROM events)
"""

DAILY = """
daily AS (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS idx, t, total, n FROM (
            SELECT o_orderdate AS t, sum(o_totalprice) AS total, CAST(count(*) AS BIGINT) AS n
            FROM orders GROUP BY o_orderdate))
"""


def _profile(src: str, cols) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""SELECT '{c}' AS variable, CAST({i} AS INTEGER) AS ordinal, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
  round((count(*) - count({c})) / count(*), 6) AS missing_share,
  CASE WHEN count(*) - count({c}) = 0 THEN 'none'
       WHEN (count(*) - count({c})) / count(*) <= 0.2 THEN 'moderate' ELSE 'high' END AS tier
FROM {src}""")
    return "\nUNION ALL\n".join(parts)


def _fill_subject(col: str, nocb: bool) -> str:
    f = (f"last_value({col} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY visit "
         f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    if nocb:
        b = (f"first_value({col} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY visit "
             f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
        return f"coalesce({f}, {b})"
    return f


def _interp(v: str) -> str:
    # order-1 interpolation: interior gaps linear between neighbours, trailing
    # gap extrapolated from the last two observations, leading gap missing
    return f"""
o_{v} AS (SELECT idx, {v} AS y, CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS r FROM hourly WHERE {v} IS NOT NULL),
m_{v} AS (SELECT count(*) AS m FROM o_{v}),
g_{v} AS (SELECT h.idx, (SELECT count(*) FROM o_{v} WHERE o_{v}.idx < h.idx) - 1 AS rp FROM hourly h WHERE h.{v} IS NULL),
s_{v} AS (SELECT g.idx, greatest(0, least(g.rp, m.m - 2)) AS s FROM g_{v} g, m_{v} m WHERE g.rp >= 0 AND m.m >= 2),
f_{v} AS (SELECT s.idx, a.y + (b.y - a.y) * (s.idx - a.idx) / (b.idx - a.idx) AS fill
          FROM s_{v} s JOIN o_{v} a ON a.r = s.s JOIN o_{v} b ON b.r = s.s + 1)"""


def _tie_safe(sql: str) -> str:
    """Rewrite every ``round(x, 6)`` as ``round(x + sign(x) * 1e-9, 6) + 0.0``
    (same rounding rule as the Spark side; ``+ 0.0`` maps -0.0 to 0.0)."""
    out, i = [], 0
    key = "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        comma = None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = _tie_safe(sql[j + len(key):comma])
        digits = sql[comma + 1:k - 1].strip()
        out.append(sql[i:j])
        out.append(f"(round(({inner}) + sign({inner}) * 1e-9, {digits}) + CAST(0 AS DOUBLE))")
        i = k


def oracle_sql() -> dict[str, str]:
    return {k: _tie_safe(v) for k, v in _oracle_sql().items()}


def _oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["flagship_diff_acf"] = "WITH " + DIFF + _acf("dlong")
    q["acf_bartlett"] = "WITH " + FILLED + _acf("flong")
    q["hourly_resample"] = "WITH " + HOURLY + f"SELECT idx, {_r(VARS)} FROM hourly"
    q["csv_roundtrip"] = "WITH " + HOURLY + f"SELECT idx, {_r(VARS)} FROM hourly"
    q["ld_csv_roundtrip"] = "WITH " + LD + "SELECT user_id, visit, event_type, round(value, 6) AS value, k FROM ld"
    onehot = []
    for col, n in (("lang", 4), ("source", 20)):
        onehot += [f"CAST(CASE WHEN (SELECT count(DISTINCT x.{col}) FROM docs x WHERE x.{col} < d.{col}) = {i} "
                   f"THEN 1 ELSE 0 END AS DOUBLE) AS {col}_{i}" for i in range(n)]
    q["rbm_encode"] = ("WITH docs AS (SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)) "
                       "SELECT d.doc_id, " + ", ".join(onehot) +
                       ", CAST(CASE WHEN d.quality = (SELECT max(quality) FROM docs) THEN 1 ELSE 0 END AS DOUBLE) AS quality"
                       ", CAST(CASE WHEN d.toxic = (SELECT max(toxic) FROM docs) THEN 1 ELSE 0 END AS DOUBLE) AS toxic FROM docs d")
    q["replace_values"] = "WITH " + LD + "SELECT user_id, visit, CASE WHEN k = 42 THEN -1 ELSE k END AS k FROM ld"
    q["subjects"] = "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL"
    q["ld_nearest_mean"] = "WITH " + LD + """SELECT user_id, visit, round(coalesce(value, avg(value) OVER (
  PARTITION BY user_id ORDER BY visit RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)), 6) AS value FROM ld"""
    q["ld_difference"] = "WITH " + LD + """SELECT user_id, visit - 1 AS visit, CAST(k - lag(k) OVER (PARTITION BY user_id ORDER BY visit) AS DOUBLE) AS k
FROM ld QUALIFY visit >= 1"""
    q["ld_acf"] = "WITH " + LD + f""",
s AS (SELECT user_id, visit AS idx, CAST(k AS DOUBLE) AS value FROM ld),
st AS (SELECT user_id, count(*) AS n, avg(value) AS m FROM s GROUP BY user_id),
ce AS (SELECT s.user_id, s.idx, s.value - st.m AS xc FROM s JOIN st USING (user_id)),
lags AS (SELECT st.user_id, CAST(g.lag AS BIGINT) AS lag, st.n FROM st,
         generate_series(0, greatest(0, least(50, (st.n // 2) - 1))) AS g(lag)),
prod AS (SELECT l.user_id, l.lag, l.n, sum(a.xc * b.xc) AS s
         FROM lags l JOIN ce a ON a.user_id = l.user_id JOIN ce b ON b.user_id = l.user_id AND b.idx = a.idx - l.lag
         GROUP BY l.user_id, l.lag, l.n),
ac AS (SELECT p.user_id, p.lag, p.n, p.s / z.s AS acf FROM prod p JOIN prod z ON z.user_id = p.user_id AND z.lag = 0)
SELECT user_id, 'k' AS variable, lag, round(acf, 6) AS acf,
  round(CASE WHEN lag = 0 THEN 0.0 ELSE {Z975} * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag >= 1 THEN acf * acf END)
    OVER (PARTITION BY user_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END, 6) AS band
FROM ac"""
    q["seasonal_decompose_mult"] = "WITH " + FILLED + """,
tr2 AS (SELECT variable, idx, value,
          (CAST(0.5 AS DOUBLE) / 4) * lag(value, 2) OVER w + (CAST(1 AS DOUBLE) / 4) * lag(value, 1) OVER w
          + (CAST(1 AS DOUBLE) / 4) * value + (CAST(1 AS DOUBLE) / 4) * lead(value, 1) OVER w
          + (CAST(0.5 AS DOUBLE) / 4) * lead(value, 2) OVER w AS trend
        FROM flong WINDOW w AS (PARTITION BY variable ORDER BY idx)),
ph AS (SELECT variable, idx % 4 AS phase, avg(value / trend) AS pm FROM tr2 GROUP BY ALL),
pc AS (SELECT variable, phase, pm / avg(pm) OVER (PARTITION BY variable) AS seasonal FROM ph)
SELECT t.variable, t.idx, round(t.value, 6) AS observed, round(t.trend, 6) AS trend, round(pc.seasonal, 6) AS seasonal,
  round(t.value / pc.seasonal / t.trend, 6) AS resid
FROM tr2 t JOIN pc ON pc.variable = t.variable AND pc.phase = t.idx % 4"""
    q["ld_interpolate"] = "WITH " + LD + """,
o AS (SELECT user_id, visit, value AS y,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY visit) - 1 AS BIGINT) AS r FROM ld WHERE value IS NOT NULL),
m AS (SELECT user_id, count(*) AS m FROM o GROUP BY user_id),
g AS (SELECT l.user_id, l.visit,
        (SELECT count(*) FROM o WHERE o.user_id = l.user_id AND o.visit < l.visit) - 1 AS rp
      FROM ld l WHERE l.value IS NULL),
s AS (SELECT g.user_id, g.visit, greatest(0, least(g.rp, m.m - 2)) AS s FROM g JOIN m USING (user_id)
      WHERE g.rp >= 0 AND m.m >= 2),
f AS (SELECT s.user_id, s.visit, a.y + (b.y - a.y) * (s.visit - a.visit) / (b.visit - a.visit) AS fill
      FROM s JOIN o a ON a.user_id = s.user_id AND a.r = s.s JOIN o b ON b.user_id = s.user_id AND b.r = s.s + 1)
SELECT l.user_id, l.visit, round(coalesce(l.value, f.fill), 6) AS value
FROM ld l LEFT JOIN f ON f.user_id = l.user_id AND f.visit = l.visit"""
    # chi^2 upper tail = 1 - P(df/2, q/2), P the regularised lower incomplete
    # gamma by its power series x^a e^-x sum_k x^k / Gamma(a+k+1), in logs
    q["ljung_box_naive"] = "WITH " + DIFF + """,
st AS (SELECT variable, count(*) AS n, avg(value) AS m FROM dlong GROUP BY variable),
ce AS (SELECT d.variable, d.idx, d.value - st.m AS xc FROM dlong d JOIN st USING (variable)),
c0 AS (SELECT variable, sum(xc * xc) AS c0 FROM ce GROUP BY variable),
lags AS (SELECT CAST(g.lag AS BIGINT) AS lag FROM generate_series(1, 10) AS g(lag)),
prod AS (SELECT a.variable, lags.lag, sum(a.xc * b.xc) AS s
         FROM ce a CROSS JOIN lags JOIN ce b ON b.variable = a.variable AND b.idx = a.idx - lags.lag
         GROUP BY a.variable, lags.lag),
r AS (SELECT p.variable, p.lag, p.s / c0.c0 AS acf, st.n FROM prod p JOIN c0 USING (variable) JOIN st USING (variable)),
qs AS (SELECT variable, lag, n * (n + 2) * sum(acf * acf / (n - lag)) OVER (
         PARTITION BY variable ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q_stat FROM r),
terms AS (SELECT variable, lag, q_stat, sum(exp((lag / 2.0 + k) * ln(q_stat / 2.0) - q_stat / 2.0
            - lgamma(lag / 2.0 + k + 1))) AS lower_p
          FROM qs, generate_series(0, 3999) AS t(k) GROUP BY variable, lag, q_stat)
SELECT variable, lag, round(q_stat, 6) AS q_stat, round(greatest(0.0, 1.0 - lower_p), 6) AS p_value FROM terms"""
    q["bh_ljung_box"] = q["ljung_box_naive"].replace(
        "SELECT variable, lag, round(q_stat, 6) AS q_stat, round(greatest(0.0, 1.0 - lower_p), 6) AS p_value FROM terms",
        """, pv AS (SELECT variable, lag, greatest(0.0, 1.0 - lower_p) AS p_value FROM terms),
rk AS (SELECT variable, lag, p_value, row_number() OVER (ORDER BY p_value, variable, lag) AS r, count(*) OVER () AS m FROM pv)
SELECT variable, lag, round(p_value, 6) AS p_value,
  round(least(1.0, min(p_value * m / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q_value
FROM rk""")
    q["daily_series"] = "WITH " + DAILY + "SELECT idx, round(total, 6) AS total, n FROM daily"
    q["hourly_missing_profile"] = "WITH " + HOURLY + _profile("hourly", VARS)
    q["ld_missing_profile"] = "WITH " + LD + _profile("ld", ["event_type", "value", "k"])
    q["missing_indices"] = "WITH " + HOURLY + "SELECT idx FROM hourly WHERE " + " OR ".join(
        f"{v} IS NULL" for v in VARS)
    li = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    q["column_summary"] = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS variable, CAST(count(*) AS BIGINT) AS observations,
  CAST(count(*) - count({c}) AS BIGINT) AS n_missing, round((count(*) - count({c})) / count(*), 6) AS missing_share,
  CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, round(count(DISTINCT {c}) / count(*), 6) AS distinct_share
FROM lineitem""" for c in li)
    q["subject_missing"] = "WITH " + LD + """SELECT user_id, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) - count(event_type) AS BIGINT) AS n_missing_event_type,
  CAST(count(*) - count(value) AS BIGINT) AS n_missing_value,
  bool_or(event_type IS NULL OR value IS NULL) AS any_missing
FROM ld GROUP BY user_id"""
    for name, nocb in (("locf", False), ("locf_nocb", True)):
        q[name] = "WITH " + LD + f"""SELECT user_id, visit, {_fill_subject('event_type', nocb)} AS event_type,
  round({_fill_subject('value', nocb)}, 6) AS value FROM ld"""
    q["nearest_mean"] = "WITH " + HOURLY + "SELECT idx, " + ", ".join(
        f"round(coalesce({v}, avg({v}) OVER (ORDER BY idx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)), 6) AS {v}"
        for v in VARS) + " FROM hourly"
    q["linear_interpolate"] = "WITH " + HOURLY + "," + ",".join(_interp(v) for v in VARS) + \
        "\nSELECT h.idx, " + ", ".join(f"round(coalesce(h.{v}, f_{v}.fill), 6) AS {v}" for v in VARS) + \
        " FROM hourly h " + " ".join(f"LEFT JOIN f_{v} ON f_{v}.idx = h.idx" for v in VARS)
    q["imputation_sets"] = "WITH " + HOURLY + """, s AS (
  SELECT idx, click, coalesce(lag(click, 1) OVER w, 0.0) AS click_lag1, coalesce(lag(click, 2) OVER w, 0.0) AS click_lag2,
    lead(click, 1) OVER w AS click_next, lead(1, 1) OVER w IS NULL AS last
  FROM hourly WINDOW w AS (ORDER BY idx))
SELECT idx, round(click, 6) AS click, round(click_lag1, 6) AS click_lag1, round(click_lag2, 6) AS click_lag2,
  round(click_next, 6) AS click_next,
  CASE WHEN click IS NOT NULL AND click_next IS NOT NULL THEN 'train' WHEN click IS NOT NULL THEN 'test'
       WHEN click_next IS NULL THEN 'both' END AS set
FROM s WHERE NOT last AND NOT (click IS NULL AND click_next IS NOT NULL)"""
    q["difference2"] = "WITH " + FILLED + "SELECT idx - 2 AS idx, " + ", ".join(
        f"round({v} - 2 * lag({v}, 1) OVER w + lag({v}, 2) OVER w, 6) AS {v}" for v in VARS) + \
        " FROM filled WINDOW w AS (ORDER BY idx) QUALIFY idx >= 2"
    q["reverse_difference"] = "WITH " + FILLED + "SELECT idx, round(click, 6) AS click FROM filled"
    q["minmax_scale"] = "WITH " + FILLED + ", mm AS (SELECT " + ", ".join(
        f"min({v}) AS lo_{v}, max({v}) AS hi_{v}" for v in VARS) + " FROM filled)\nSELECT idx, " + ", ".join(
        f"round(CASE WHEN hi_{v} = lo_{v} THEN {v} * 2.0 + (-1.0 - lo_{v} * 2.0) "
        f"ELSE {v} * (2.0 / (hi_{v} - lo_{v})) + (-1.0 - lo_{v} * (2.0 / (hi_{v} - lo_{v}))) END, 6) AS {v}"
        for v in VARS) + " FROM filled, mm"
    q["bin_equal_width"] = """WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
edges AS (SELECT CAST(i AS BIGINT) AS i, CASE WHEN i = 10 THEN hi ELSE i * ((hi - lo) / 10) + lo END AS e
          FROM mm, generate_series(0, 10) AS g(i)),
edges2 AS (SELECT i, CASE WHEN i = 0 THEN e - (hi - lo) * 0.001 ELSE e END AS e FROM edges, mm),
coded AS (SELECT l.l_extendedprice AS x, (SELECT CAST(count(*) AS INTEGER) FROM edges2 WHERE i BETWEEN 1 AND 9 AND l.l_extendedprice > e) AS code
          FROM lineitem l)
SELECT code, CAST(count(*) AS BIGINT) AS n_rows, round(min(x), 6) AS min_value, round(max(x), 6) AS max_value,
  round(any_value(lo.e), 6) AS edge_lo, round(any_value(hi.e), 6) AS edge_hi
FROM coded JOIN edges2 lo ON lo.i = code JOIN edges2 hi ON hi.i = code + 1 GROUP BY code"""
    q["label_encode"] = "WITH " + LD + """, cls AS (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT coalesce(event_type, 'NaN') AS c FROM ld))
SELECT user_id, visit, event_type, CAST(CASE WHEN event_type IS NULL THEN NULL ELSE cls.code END AS DOUBLE) AS code
FROM ld LEFT JOIN cls ON cls.c = coalesce(ld.event_type, 'NaN')"""
    q["one_hot"] = """WITH lv AS (SELECT role, CAST(row_number() OVER (ORDER BY role) - 1 AS INTEGER) AS r
  FROM (SELECT DISTINCT role FROM conversations WHERE role IS NOT NULL))
SELECT conv_id, turn, """ + ", ".join(f"CAST(CASE WHEN lv.r = {i} THEN 1 ELSE 0 END AS DOUBLE) AS role_{i}" for i in range(3)) + \
        " FROM conversations c JOIN lv USING (role)"
    q["subject_windows"] = "WITH " + LD + """, mm AS (SELECT min(value) AS lo, max(value) AS hi FROM ld),
sc AS (SELECT user_id, visit, value * (2.0 / (hi - lo)) + (-1.0 - lo * (2.0 / (hi - lo))) AS value FROM ld, mm)
SELECT user_id, visit, round(value, 6) AS value,
  round(coalesce(lag(value, 1) OVER w, 0.0), 6) AS value_lag1, round(coalesce(lag(value, 2) OVER w, 0.0), 6) AS value_lag2
FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY visit)"""
    q["supervised_windows"] = "WITH " + DAILY + """, w AS (
  SELECT idx, total, coalesce(lag(total, 1) OVER o, 0.0) AS total_lag1, coalesce(lag(total, 2) OVER o, 0.0) AS total_lag2,
    coalesce(lag(total, 3) OVER o, 0.0) AS total_lag3, lead(total, 1) OVER o AS total_lead1, lead(total, 2) OVER o AS total_lead2
  FROM daily WINDOW o AS (ORDER BY idx)),
sp AS (SELECT CAST(floor(0.8 * (count(*) - 2)) AS BIGINT) AS split FROM daily)
SELECT idx, round(total, 6) AS total, round(total_lag1, 6) AS total_lag1, round(total_lag2, 6) AS total_lag2,
  round(total_lag3, 6) AS total_lag3, round(total_lead1, 6) AS total_lead1, round(total_lead2, 6) AS total_lead2,
  CASE WHEN idx < split THEN 'train' ELSE 'test' END AS set
FROM w, sp WHERE total_lead2 IS NOT NULL"""
    q["temporal_split"] = "WITH " + DAILY + """, sp AS (SELECT CAST(floor(0.8 * count(*)) AS BIGINT) AS split FROM daily)
SELECT CASE WHEN idx < split THEN 'train' ELSE 'test' END AS set, CAST(count(*) AS BIGINT) AS n_rows,
  round(sum(total), 2) AS total, min(idx) AS first_idx, max(idx) AS last_idx FROM daily, sp GROUP BY 1"""
    q["subject_split"] = "WITH " + LD + """, s AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS r,
  count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM ld))
SELECT ld.user_id, visit, CASE WHEN s.r >= s.n - s.n // 5 THEN 'test' ELSE 'train' END AS set
FROM ld JOIN s USING (user_id)"""
    q["seasonal_decompose"] = "WITH " + FILLED + """,
tr2 AS (SELECT variable, idx, value, (CAST(1 AS DOUBLE) / 3) * lag(value, 1) OVER w + (CAST(1 AS DOUBLE) / 3) * value + (CAST(1 AS DOUBLE) / 3) * lead(value, 1) OVER w AS trend
        FROM flong WINDOW w AS (PARTITION BY variable ORDER BY idx)),
ph AS (SELECT variable, idx % 3 AS phase, avg(value - trend) AS pm FROM tr2 GROUP BY ALL),
pc AS (SELECT variable, phase, pm - avg(pm) OVER (PARTITION BY variable) AS seasonal FROM ph)
SELECT t.variable, t.idx, round(t.value, 6) AS observed, round(t.trend, 6) AS trend, round(pc.seasonal, 6) AS seasonal,
  round(t.value - t.trend - pc.seasonal, 6) AS resid
FROM tr2 t JOIN pc ON pc.variable = t.variable AND pc.phase = t.idx % 3"""
    q["fisher_g"] = "WITH " + FILLED + """,
nn AS (SELECT variable, count(*) AS n FROM flong GROUP BY variable),
fr AS (SELECT variable, n, CAST(f AS BIGINT) AS f FROM nn,
       generate_series(CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN n % 2 = 0 THEN n // 2 - 1 ELSE (n - 1) // 2 END) AS g(f)),
cs AS (SELECT fr.variable, fr.f, fr.n, sum(x.value * cos(2 * pi() * fr.f * (x.idx + 1) / fr.n)) AS c,
         sum(x.value * sin(2 * pi() * fr.f * (x.idx + 1) / fr.n)) AS s
       FROM fr JOIN flong x ON x.variable = fr.variable GROUP BY ALL),
pi_ AS (SELECT variable, CASE WHEN n % 2 = 0 THEN n * (c / n) * (c / n)
                          ELSE n / 2.0 * ((2 * c / n) * (2 * c / n) + (2 * s / n) * (2 * s / n)) END AS I FROM cs)
SELECT variable, round(max(I) / sum(I), 6) AS g, CAST(count(*) AS BIGINT) AS n_freq FROM pi_ GROUP BY variable"""
    q["durbin_watson"] = "WITH " + DIFF + """,
d2 AS (SELECT variable, value, value - lag(value) OVER (PARTITION BY variable ORDER BY idx) AS d FROM dlong)
SELECT variable, round(sum(d * d) / sum(value * value), 6) AS dw FROM d2 GROUP BY variable"""
    q["residual_histogram"] = "WITH " + DIFF + """,
r AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM dlong GROUP BY variable),
b AS (SELECT d.variable, r.lo, (r.hi - r.lo) / 10.0 AS w,
        CAST(CASE WHEN (r.hi - r.lo) / 10.0 = 0 THEN 0 ELSE least(floor((d.value - r.lo) / ((r.hi - r.lo) / 10.0)), 9) END AS INTEGER) AS bin
      FROM dlong d JOIN r USING (variable))
SELECT variable, bin, CAST(count(*) AS BIGINT) AS count, round(any_value(lo + bin * w), 6) AS bin_lo,
  round(any_value(lo + (bin + 1) * w), 6) AS bin_hi FROM b GROUP BY variable, bin"""
    q["mae_naive"] = "WITH " + FILLED + """, sp AS (SELECT CAST(floor(0.8 * count(*)) AS BIGINT) AS split FROM filled),
l AS (SELECT variable, idx, value, lag(value) OVER (PARTITION BY variable ORDER BY idx) AS p FROM flong)
SELECT variable, round(avg(abs(p - value)), 6) AS mae FROM l, sp WHERE idx >= split GROUP BY variable"""
    q["overlap_average"] = "WITH " + DAILY + """, e AS (SELECT idx + 1 + CAST(h AS BIGINT) AS idx, total AS p FROM daily, generate_series(0, 2) AS g(h))
SELECT 'total' AS variable, idx, round(avg(p), 6) AS predicted, CAST(count(*) AS BIGINT) AS n_predictions FROM e GROUP BY idx"""
    q["big_key_index"] = """SELECT event_id, CAST(key AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY key ORDER BY event_id) - 1 AS BIGINT) AS pos
FROM (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN user_id + 9007199254740992 END AS key FROM events)"""
    q["one_hot_levels"] = """WITH li AS (SELECT l_orderkey * 10 + l_linenumber AS row,
  CASE WHEN l_linenumber <> 3 THEN l_partkey END AS part, l_returnflag AS flag FROM lineitem),
p AS (SELECT part, CAST(row_number() OVER (ORDER BY part NULLS LAST) - 1 AS BIGINT) AS level, CAST(count(*) OVER () AS BIGINT) AS n
      FROM (SELECT DISTINCT part FROM li)),
f AS (SELECT flag, CAST(row_number() OVER (ORDER BY flag NULLS LAST) - 1 AS BIGINT) AS level, CAST(count(*) OVER () AS BIGINT) AS n
      FROM (SELECT DISTINCT flag FROM li))
SELECT row, 'part' AS variable, level, n AS n_levels FROM li JOIN p ON li.part IS NOT DISTINCT FROM p.part
UNION ALL SELECT row, 'flag', level, n FROM li JOIN f ON li.flag IS NOT DISTINCT FROM f.flag"""
    q["adf_users"] = "WITH " + LD + """,
d AS (SELECT user_id, coalesce(value, 0.0) AS y, lag(coalesce(value, 0.0)) OVER (PARTITION BY user_id ORDER BY visit) AS y1,
        count(*) OVER (PARTITION BY user_id) AS len FROM ld),
g AS (SELECT user_id, any_value(len) AS len, regr_count(y - y1, y1) AS n, regr_slope(y - y1, y1) AS b, regr_sxx(y - y1, y1) AS sxx,
        regr_syy(y - y1, y1) AS syy, regr_sxy(y - y1, y1) AS sxy FROM d GROUP BY user_id)
SELECT user_id, CASE WHEN len >= 6 THEN round(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) END AS adf_stat,
  CAST(CASE WHEN len >= 6 THEN 0 END AS INTEGER) AS used_lag, CAST(CASE WHEN len >= 6 THEN n END AS BIGINT) AS nobs FROM g"""
    q["granger_lag1"] = "WITH " + DIFF + """,
l AS (SELECT variable, idx, value, lag(value) OVER (PARTITION BY variable ORDER BY idx) AS v1 FROM dlong),
s AS (SELECT t.variable AS target, x.variable AS source, count(*) AS n, regr_sxx(t.value, t.v1) AS s11, regr_sxx(t.value, x.v1) AS s22,
        regr_sxy(t.v1, x.v1) AS s12, regr_syy(t.value, t.v1) AS yy, regr_sxy(t.value, t.v1) AS y1, regr_sxy(t.value, x.v1) AS y2
      FROM l t JOIN l x ON x.idx = t.idx AND x.variable <> t.variable WHERE t.v1 IS NOT NULL GROUP BY ALL),
r AS (SELECT target, source, n, yy - y1 * y1 / s11 AS own,
        yy - (y1 * y1 * s22 - 2 * y1 * y2 * s12 + y2 * y2 * s11) / (s11 * s22 - s12 * s12) AS joint FROM s)
SELECT target, source, round(n * (own - joint) / joint, 6) AS chi2 FROM r"""
    q["segment_ar1"] = """WITH day AS (SELECT c_mktsegment AS segment, o_orderdate AS t, sum(o_totalprice) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT segment, CAST(row_number() OVER w - 1 AS BIGINT) AS idx, total, lag(total) OVER w AS y1,
        floor(count(*) OVER (PARTITION BY segment) * 0.8::DOUBLE) AS start FROM day WINDOW w AS (PARTITION BY segment ORDER BY t)),
f AS (SELECT *, regr_slope(total, y1) OVER e AS b, regr_avgx(total, y1) OVER e AS mx, regr_avgy(total, y1) OVER e AS my FROM s WHERE idx >= 1
  WINDOW e AS (PARTITION BY segment ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT segment, idx, round(total, 4) AS observed, round(my + b * (y1 - mx), 4) AS predicted,
  round(total - (my + b * (y1 - mx)), 4) AS residual FROM f WHERE idx >= start AND start > 3"""
    q["user_ar1_forecast"] = "WITH " + LD + f""",
v AS (SELECT user_id, visit AS idx, value, lag(value) OVER (PARTITION BY user_id ORDER BY visit) AS y1
      FROM (SELECT user_id, visit, {_fill_subject("value", True)} AS value FROM ld) WHERE value IS NOT NULL),
b AS (SELECT user_id, count(y1) AS n, sum(value * y1) / sum(y1 * y1) AS b, max(idx) AS last, arg_max(value, idx) AS y
      FROM v GROUP BY user_id HAVING count(y1) > 3),
e AS (SELECT b.user_id, n, b, last, y, sum((value - b * y1) * (value - b * y1) / n) AS s2
      FROM v JOIN b USING (user_id) WHERE y1 IS NOT NULL GROUP BY ALL),
h AS (SELECT *, unnest([1, 2, 3]) AS h FROM e),
m AS (SELECT user_id, last + h AS idx, pow(b, h) * y AS mean,
        {Z975} * sqrt(s2 * (1 + CASE WHEN h > 1 THEN b * b ELSE 0 END + CASE WHEN h > 2 THEN pow(b, 4) ELSE 0 END)) AS half FROM h)
SELECT user_id, CAST(idx AS BIGINT) AS idx, round(mean, 4) AS mean, round(mean - half, 4) AS lower, round(mean + half, 4) AS upper FROM m"""
    q["user_model_impute"] = "WITH " + LD + """,
p AS (SELECT user_id, visit, value, lead(value) OVER (PARTITION BY user_id ORDER BY visit) AS nxt FROM ld),
b AS (SELECT user_id, regr_slope(nxt, value) AS b, regr_intercept(nxt, value) AS a FROM p GROUP BY user_id HAVING regr_count(nxt, value) >= 2),
l AS (SELECT user_id, visit, value, last_value(value IGNORE NULLS) OVER w AS x,
        visit - last_value(CASE WHEN value IS NOT NULL THEN visit END IGNORE NULLS) OVER w AS h
      FROM ld WINDOW w AS (PARTITION BY user_id ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, visit AS idx, round(coalesce(value, pow(b, h) * x + a * (pow(b, h) - 1) / (b - 1)), 4) AS value
FROM l LEFT JOIN b USING (user_id)"""
    q["complete_columns"] = "WITH " + LD + """, m AS (
  SELECT count(*) AS n, count(*) - count(user_id) AS user_id, count(*) - count(event_type) AS event_type, count(*) - count(value) AS value,
    count(*) - count(k) AS k, count(*) - count(visit) AS visit FROM ld)
SELECT variable, n AS n_rows, user_id + event_type + value + k + visit > 0 AS others_missing
FROM (SELECT *, unnest(['user_id', 'event_type', 'value', 'k', 'visit']) AS variable, unnest([user_id, event_type, value, k, visit]) AS gaps FROM m)
WHERE gaps = 0"""
    # p < 0.05 with one degree of freedom
    edges = "FROM (" + q["granger_lag1"] + ") WHERE chi2 > 3.841458820694124"
    q["granger_edges"] = "SELECT source, target " + edges
    q["granger_causes"] = "SELECT target, source, 1::INTEGER AS best_lag " + edges + " AND target = 'click'"
    q["lag_links"] = "SELECT variable AS source, variable AS target, bool_or(abs(acf) > band) AS edge, round(min(abs(acf)), 6) AS q_value FROM (WITH " \
        + DIFF + _acf("dlong") + ") WHERE lag BETWEEN 1 AND 12 GROUP BY variable"
    verdicts = """SELECT variable, round(count(*) FILTER (p_value < 0.05) / count(*), 6) AS share,
  floor(count(*) FILTER (p_value < 0.05) / count(*))::INTEGER AS all_lags_below FROM (""" + q["ljung_box_naive"] + ") GROUP BY variable"
    q["residual_verdicts"] = verdicts
    q["naive_leaderboard"] = "SELECT 'naive - ' || variable AS label, 'naive' AS model, variable, mae, all_lags_below, " \
        "CASE WHEN all_lags_below = 1 THEN 'red' ELSE 'green' END AS colour FROM (" + q["mae_naive"] + ") LEFT JOIN (" + verdicts + ") USING (variable)"
    q["order_walk"] = """WITH g AS (SELECT (month(o_orderdate) - 1)::INTEGER AS p, (isodow(o_orderdate) - 1)::INTEGER AS q, avg(o_totalprice) AS price
  FROM orders GROUP BY ALL),
m AS (SELECT *, min(price) OVER (ORDER BY p + q, -greatest(p, q), -p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT 'price' AS criterion, p, q, round(price, 4) AS value FROM m WHERE before IS NULL OR price < before"""
    q["band_table"] = "SELECT CAST(hour(ts) AS BIGINT) AS idx, " + ", ".join(
        f"round(avg(value) FILTER (event_type = '{v}'), 6) AS {v}, round(min(value) FILTER (event_type = '{v}'), 6) AS {v}_lower_conf, "
        f"round(max(value) FILTER (event_type = '{v}'), 6) AS {v}_upper_conf" for v in VARS) + \
        " FROM events WHERE event_type IS NOT NULL GROUP BY 1"
    q["stored_results"] = """WITH r AS (SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS model, o_orderstatus AS variable,
  avg(o_totalprice) AS mae, count(DISTINCT isodow(o_orderdate)) AS test_size FROM orders GROUP BY ALL),
t AS (SELECT max(year) AS last FROM r),
n AS (SELECT r.* FROM r, t WHERE year = last AND variable <> 'F'),
c AS (SELECT r.* FROM r, t WHERE year = last - 1 AND abs(test_size - (SELECT max(test_size) FROM n)) <= 1)
SELECT year, model, variable, round(mae, 4) AS mae, test_size FROM (SELECT c.* FROM c ANTI JOIN n USING (model, variable) UNION ALL SELECT * FROM n)"""
    levels = []
    for col, n in (("lang", 4), ("source", 20), ("quality", 3), ("toxic", 3)):
        levels += [f"CAST(CASE WHEN (SELECT count(DISTINCT x.{col}) FROM docs x WHERE x.{col} < d.{col}) = {i} THEN 1 ELSE 0 END AS DOUBLE) AS {col}_{i}"
                   for i in range(n)]
    q["rbm_encode_all"] = """WITH docs AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
  coalesce(CAST(quality AS VARCHAR), 'none') AS quality, coalesce(CAST(toxic AS VARCHAR), 'none') AS toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT d.doc_id, """ + ", ".join(levels) + " FROM docs d"
    q["joined_bands"] = """SELECT event_type, CAST(hour(ts) AS BIGINT) AS idx, round(avg(value), 6) AS mean, round(min(value), 6) AS lower,
  round(max(value), 6) AS upper FROM events WHERE event_type IS NOT NULL GROUP BY ALL"""
    q["observed_fitted"] = "WITH " + DAILY + """SELECT d.idx, round(d.total, 4) AS total, round(w.total, 4) AS fitted
FROM daily d LEFT JOIN daily w ON w.idx + 7 = d.idx"""
    q["type_pairs"] = """WITH v AS (SELECT DISTINCT event_type AS v FROM events WHERE event_type IS NOT NULL)
SELECT a.v AS source, b.v AS target FROM v a, v b"""
    q["forecast_input"] = "WITH " + FILLED + ", w AS (SELECT idx, max(idx) OVER () AS last, " + ", ".join(
        f"round({v}, 6) AS {v}, " + ", ".join(f"round(lag({v}, {k}, 0) OVER (ORDER BY idx), 6) AS {v}_lag{k}" for k in (1, 2, 3)) for v in VARS) + \
        " FROM filled) SELECT * EXCLUDE (last) FROM w WHERE idx > last - 5"
    q["user_options"] = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS option, false AS is_all FROM events WHERE user_id IS NOT NULL UNION ALL SELECT 'all', true"
    q["active_customers"] = "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT o_custkey FROM orders)"
    q["csv_names"] = """SELECT doc_id, 'dir.d/' || source || CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.tar.csv' ELSE '.txt' END AS path,
  regexp_full_match(source || CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.tar.csv' ELSE '.txt' END, '[^.]+\\.csv') AS valid
FROM documents"""
    q["minmax_roundtrip"] = "WITH " + FILLED + f"SELECT idx, {_r(VARS)} FROM filled"
    q["acf_display"] = "SELECT variable, lag, acf, CAST(0.5 AS DOUBLE) AS gap FROM (WITH " + DIFF + _acf("dlong") + ")"
    q["naive_residuals"] = "WITH " + FILLED + """,
l AS (SELECT variable, idx, value, lag(value) OVER (PARTITION BY variable ORDER BY idx) AS p FROM flong)
SELECT variable, idx, round(value, 6) AS observed, round(p, 6) AS predicted, round(value - p, 6) AS residual FROM l WHERE p IS NOT NULL"""
    q["accepted_imputation"] = "WITH " + LD + "SELECT user_id, visit, round(" + _fill_subject("value", False) + ", 6) AS value, k FROM ld"
    q["drop_sparse_columns"] = "WITH " + LD + "SELECT user_id, visit, event_type, k FROM ld"
    q["incomplete_columns"] = "WITH " + LD + """SELECT * FROM (
  SELECT 'event_type' AS variable, CAST(count(*) - count(event_type) AS BIGINT) AS n_missing FROM ld
  UNION ALL SELECT 'value', count(*) - count(value) FROM ld UNION ALL SELECT 'k', count(*) - count(k) FROM ld) WHERE n_missing > 0"""
    q["event_value_bands"] = """SELECT event_type, round(avg(value), 6) AS mean, round(avg(value) - 2 * stddev_pop(value), 6) AS lower,
  round(avg(value) + 2 * stddev_pop(value), 6) AS upper FROM events GROUP BY event_type"""
    q["record_lows"] = """WITH day AS (SELECT c_mktsegment AS segment, o_orderdate AS t, sum(o_totalprice) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT segment, CAST(row_number() OVER (PARTITION BY segment ORDER BY t) - 1 AS BIGINT) AS idx, total FROM day),
m AS (SELECT *, min(total) OVER (PARTITION BY segment ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM s)
SELECT segment, 'total' AS criterion, idx, round(total, 6) AS value FROM m WHERE low IS NULL OR total < low"""
    q["observed_and_predicted"] = "WITH " + FILLED + """
SELECT variable, idx, 'observed' AS kind, round(value, 6) AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM flong
UNION ALL SELECT variable, idx + 1, 'predicted', round(value, 6), NULL, NULL FROM flong"""
    q["transposed_days"] = "WITH " + DAILY + """SELECT CAST(0 AS BIGINT) AS idx, idx AS series, round(total, 6) AS value FROM daily
UNION ALL SELECT CAST(1 AS BIGINT), idx, CAST(n AS DOUBLE) FROM daily"""
    return q
