"""SQL each registered query is compared with, written independently of the library.

Part scores here are full leave-one-out dot products and the model algebra is spelled
out for two coefficients; the library takes shorter or batched routes.
"""

from __future__ import annotations

import math

from . import settings as S

# Names of measures, drivers, effects and parts as in the report tables.
MEASURES = [(a, b) for a in ("blended", "non_promo", "promo")
            for b in ("total", "regular", "redline")]
DRIVERS = ["num_colors_log", "inventory_qty_log", "bts_ind", "holiday_thanksgiving",
           "holiday_easter", "holiday_xmas", "holiday_pre_xmas", "price_log", "promo_pct",
           "redline_pct"]
PLANNED = ["num_colors", "price", "promo_pct", "redline_pct"]
EFFECTS = [0.45, 0.30, 0.12, 0.20, 0.08, 0.25, 0.10, -0.15, 0.35, 0.22]
PARTS = {"decomp_bts": "bts_ind", "decomp_thanksgiving": "holiday_thanksgiving",
         "decomp_easter": "holiday_easter", "decomp_xmas": "holiday_xmas",
         "decomp_pre_xmas": "holiday_pre_xmas", "decomp_promo": "promo_pct",
         "decomp_redline": "redline_pct"}
SEASON = list(PARTS)[:5]
CHART = ["base_sales", "decomp_seasonality", "decomp_promo", "decomp_redline"]
MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST",
          "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]
PERIOD = {"all": [], "quarter": ["quarter"], "month": ["fiscal_month"]}


def names(columns) -> str:
    return ", ".join(columns)


QUOTED_MONTHS = names(f"'{m}'" for m in MONTHS)


def rounded(x: str, digits: int = 4) -> str:
    return f"round(CAST({x} AS DOUBLE) + {S.EPS * 10.0 ** -digits:.17f}, {digits}) + 0.0"


DATES = {"week", "old_week", "first_week", "last_week", "day", "first", "last"}


def shown(column: str) -> str:
    kind = "VARCHAR" if column in DATES else "BIGINT" if column == "iter" else ""
    return f"CAST({column} AS {kind}) AS {column}" if kind else column


def out(keep: list[str], doubles: list[str], source: str, digits: int = 4) -> str:
    cols = [*map(shown, keep), *[f"{rounded(c, digits)} AS {c}" for c in doubles]]
    return f"SELECT {names(cols)} FROM ({source}) AS result"


def half_up(x: str, digits: int) -> str:
    """Rounding of the shortest decimal form of a double, halves away from 0."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 22)), {digits}) AS DOUBLE)"


def sunday(d: str) -> str:
    return f"({d} - CAST(dayofweek({d}) AS INTEGER))"


# ---- report tables -----------------------------------------------------------

def _facts() -> str:
    promo = {"blended": None, "non_promo": "NOT promo", "promo": "promo"}
    redline = {"total": None, "regular": "NOT redline", "redline": "redline"}
    sums = []
    for a, b in MEASURES:
        cond = " AND ".join(c for c in (promo[a], redline[b]) if c) or "TRUE"
        for name, col in (("q", "qty"), ("a", "amount"), ("l", "list_amount")):
            sums.append(f"coalesce(sum({col}) FILTER (WHERE {cond}), 0.0) AS {name}_{a}_{b}")
    cols = []
    for a, b in MEASURES:
        m = f"{a}_{b}"
        cols += [f"q_{m} AS {a}_units_{b}", f"a_{m} / nullif(q_{m}, 0) AS {a}_price_{b}",
                 f"l_{m} / nullif(q_{m}, 0) AS {a}_price_{b}_smooth_supsmu"]
    number = "CAST(split_part(dept, '#', 2) AS INTEGER)"

    def flag(cond):
        return f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"

    return f"""
lines AS (
  SELECT p_brand AS dept, c_mktsegment AS type,
         {sunday('CAST(l_shipdate AS DATE)')} AS week, l_partkey AS part, l_quantity AS qty,
         l_extendedprice AS amount, l_quantity * p_retailprice AS list_amount, p_size AS stock,
         l_discount > 0.05 AS promo, l_returnflag = 'R' AS redline
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
cells AS (
  SELECT dept, type, week, {names(sums)},
         CAST(count(DISTINCT part) AS DOUBLE) AS num_colors,
         CAST(sum(stock) AS DOUBLE) AS inventory_qty,
         avg(CASE WHEN promo THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS promo_pct,
         avg(CASE WHEN redline THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS redline_pct
  FROM lines GROUP BY dept, type, week),
facts AS (
  SELECT dept, type, week, CASE WHEN {number} % 2 = 1 THEN 'A' ELSE 'B' END AS brand,
         CASE WHEN {number} <= 12 THEN 'F' ELSE 'M' END AS gender,
         'Q' || quarter(week) AS quarter, ([{QUOTED_MONTHS}])[month(week)] AS fiscal_month,
         {names(cols)}, num_colors, inventory_qty, a_blended_total / q_blended_total AS price,
         {flag("month(week) = 8")} AS bts_ind,
         {flag("month(week) = 11 AND day(week) BETWEEN 22 AND 28")} AS holiday_thanksgiving,
         {flag("month(week) = 4 AND day(week) <= 21")} AS holiday_easter,
         {flag("month(week) = 12 AND day(week) BETWEEN 19 AND 25")} AS holiday_xmas,
         {flag("month(week) = 12 AND day(week) < 19")} AS holiday_pre_xmas,
         promo_pct, redline_pct
  FROM cells),
every_week AS (
  SELECT dept, type, CAST(unnest(range(min(week), max(week) + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS DATE) AS week
  FROM facts GROUP BY dept, type),
plain AS (
  SELECT dept, type, week, CASE WHEN {number} % 2 = 1 THEN 'A' ELSE 'B' END AS brand,
      CASE WHEN {number} <= 12 THEN 'F' ELSE 'M' END AS gender, {names(f"coalesce({a}_units_{b}, 0) AS {a}_units_{b}" for a, b in MEASURES)},
      {names(f"{a}_price_{b}_smooth_supsmu" for a, b in MEASURES)}, {names(
      f"last_value(nullif({a}_price_{b}, 0) IGNORE NULLS) OVER by_week AS {a}_price_{b}_smooth"
      for a, b in MEASURES)},
      {flag("month(week) = 12 AND day(week) BETWEEN 19 AND 25")} AS holiday_xmas, 'Q' || quarter(week) AS quarter
  FROM every_week AS w LEFT JOIN (SELECT * EXCLUDE (quarter, holiday_xmas) FROM facts) USING (dept, type, week) WINDOW by_week AS (PARTITION BY dept, type ORDER BY week
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
model AS (
  SELECT DISTINCT dept, type, 3.0::DOUBLE + 0.01::DOUBLE * {number} AS c0,
         {names(f"{e}::DOUBLE AS c{i + 1}" for i, e in enumerate(EFFECTS))}
  FROM facts)"""


LOG_DRIVERS = {"num_colors_log": "ln(num_colors + 1)", "inventory_qty_log": "ln(inventory_qty + 1)",
               "price_log": "ln(price + 1)"}


def _transform(source: str) -> str:
    cols = [f"{LOG_DRIVERS[d]} AS {d}" if d in LOG_DRIVERS else d for d in DRIVERS]
    keys = ["dept", "type", "week", "quarter", "fiscal_month"]
    every = [*keys, "blended_units_total_log", *DRIVERS]
    return f"""SELECT * FROM (
      SELECT {names(keys)}, ln(blended_units_total + 1) AS blended_units_total_log, {names(cols)}
      FROM {source}) AS t WHERE {' AND '.join(f'{c} IS NOT NULL' for c in every)}"""


def score(without: str = "") -> str:
    return "c0 + " + " + ".join(
        f"c{i + 1} * {'0' if d == without else d}" for i, d in enumerate(DRIVERS))


def _scored(source: str, whole: bool = False) -> str:
    y_hat = f"exp({score()}) - 1"
    return f"""SELECT *, {score()} AS score, exp(blended_units_total_log) - 1 AS y,
      {f'round({y_hat})' if whole else y_hat} AS y_hat
      FROM ({source}) AS t JOIN model USING (dept, type)"""


def _raw(source: str) -> str:
    parts = [f"y_hat - (exp({score(d)}) - 1) AS {p}" for p, d in PARTS.items()]
    return f"""SELECT dept, type, week, quarter, fiscal_month, year(week) AS year, y_hat,
      exp(c0 + c8 * price_log + c1 * num_colors_log + c2 * inventory_qty_log) AS base_sales,
      {names(parts)} FROM {source}"""


def _sums(source: str, period: str) -> str:
    keys = names(["dept", "type", *PERIOD[period], "year"])
    cols = [f"sum({c}) AS {c}_sum" for c in ("y_hat", "base_sales", *PARTS)]
    cols += ["count(*) AS weeks", "count(*) FILTER (WHERE y_hat IS NULL) AS weeks_without_model"]
    return f"SELECT {keys}, {names(cols)} FROM ({source}) AS r GROUP BY {keys}"


def _corrected(source: str, period: str) -> str:
    keys = names(["dept", "type", *PERIOD[period], "year"])
    total = " + ".join(f"{p}_sum" for p in PARTS)
    cols = [f"round({p}_sum + CASE WHEN total = 0 THEN 0 ELSE err * {p}_sum / total END) AS {p}"
            for p in PARTS]
    return f"""SELECT {keys}, round(base_sales_sum) AS base_sales, {names(cols)} FROM (
      SELECT *, {total} AS total, y_hat_sum - (base_sales_sum + {total}) AS err
      FROM ({_sums(source, period)}) AS s) AS t"""


def _pct(source: str, period: str) -> str:
    keys = names(["dept", "type", *PERIOD[period], "year"])
    every = ["base_sales", *PARTS]
    share = "coalesce(greatest({p} / nullif(total, 0), 0), 0)"
    cols = [f"{half_up(share.format(p=p), 2)} AS {p}_pct" for p in every]
    return f"""SELECT {keys}, {names(cols)} FROM (
      SELECT *, {' + '.join(every)} AS total FROM ({_corrected(source, period)}) AS c) AS t"""


def _merged(source: str, period: str, suffix: str = "") -> str:
    keys = names(["dept", "type", *PERIOD[period], "year"])
    return f"""SELECT {keys}, base_sales{suffix},
      {' + '.join(p + suffix for p in SEASON)} AS decomp_seasonality{suffix},
      decomp_promo{suffix}, decomp_redline{suffix} FROM ({source}) AS c"""


def _labelled(source: str, period: str) -> str:
    code = f"list_position([{QUOTED_MONTHS}], fiscal_month)"
    label = {"all": ("dept || '-' || type", "0"),
             "quarter": ("year || '-' || quarter",
                         "year * 100 + CAST(substr(quarter, 2, 1) AS INTEGER)"),
             "month": (f"year || '-' || lpad(CAST({code} AS VARCHAR), 2, '0')",
                       f"year * 100 + {code}")}[period]
    return (f"SELECT *, {label[0]} AS labels, CAST({label[1]} AS BIGINT) AS label_order "
            f"FROM ({source}) AS w")


def _long(wide: str, ids: list[str], values: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {names(ids)}, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM ({wide}) AS w"
        for v in values)


def _chart(wide: str, period: str) -> str:
    ids = ["dept", "type", "labels", "label_order"]
    order = names(f"'{c}'" for c in CHART)
    return f"""SELECT *, sum(value) OVER (PARTITION BY dept, type, labels
        ORDER BY list_position([{order}], variable) ROWS UNBOUNDED PRECEDING) - value / 2 AS pos,
      {half_up('value / sum(value) OVER (PARTITION BY dept, type, labels) * 100', 2)} AS pct
      FROM ({_long(_labelled(wide, period), ids, CHART)}) AS l WHERE value > 2"""


def _scenario(planned: str = "") -> str:
    """``planned``: changes of the levers; the standard ones if empty."""
    start, end = (f"DATE '{d}'" for d in S.SCENARIO)
    first = f"({sunday(start)} - 364)"  # each week corresponds to that 52 weeks before
    weeks = f"CAST(({sunday(end)} - {sunday(start)}) / 7 AS INTEGER)"
    raw = ["num_colors", "inventory_qty", "bts_ind", "holiday_thanksgiving", "holiday_easter",
           "holiday_xmas", "holiday_pre_xmas", "price", "promo_pct", "redline_pct"]
    shifted = {} if planned == "none" else {
        "price": f"price + ({S.PRICE_SHIFT})", "promo_pct": f"promo_pct + {S.PROMO_SHIFT}"}
    cols = names(f"{shifted[c]} AS {c}" if c in shifted else c for c in raw)
    new = _transform("planned")
    return f"""{_facts()},
past AS (SELECT * FROM facts WHERE week BETWEEN {first} AND {first} + 7 * {weeks}),
ranked AS (SELECT * RENAME (week AS old_week),
           CAST((week - {first}) / 7 AS BIGINT) AS pos FROM past),
grid AS (SELECT dept, type, i AS pos, CAST({sunday(start)} + CAST(7 * i AS INTEGER) AS DATE) AS week
         FROM (SELECT DISTINCT dept, type FROM past) AS p
         CROSS JOIN range(0, {weeks} + 1) AS r(i)),
aligned AS (SELECT * FROM grid LEFT JOIN ranked USING (dept, type, pos)),
planned AS (SELECT DISTINCT dept, type, week, quarter, fiscal_month, blended_units_total, {cols}
            FROM aligned),
new AS ({_scored(new, whole=True)}),
old AS ({_scored(_transform('past'), whole=True)})"""


PAIRS = """SELECT n.dept, n.type, n.week, n.y_hat, o.week AS old_week, o.y_hat AS old_y_hat
  FROM {new} AS n JOIN {old} AS o ON n.dept = o.dept AND n.type = o.type
  AND n.week = CAST(date_trunc('week', o.week + 365) AS DATE) - 1"""


# ---- the two-coefficient model -----------------------------------------------

def unit(key: str, first: int) -> str:
    return (f"((CAST(('0x' || substr(md5({key}), {first}, 8)) AS BIGINT) + 0.5::DOUBLE) "
            f"/ 4294967296.0::DOUBLE)")


def normal(key: str) -> str:
    return f"(sqrt(-2 * ln({unit(key, 1)})) * cos({2 * math.pi!r} * {unit(key, 9)}))"


def key(*parts: str) -> str:
    return " || '|' || ".join(parts)


def inverse(a, b, c) -> tuple[str, str, str]:
    det = f"(({a}) * ({c}) - ({b}) * ({b}))"
    return f"(({c}) / {det})", f"(-({b}) / {det})", f"(({a}) / {det})"


def factor(a, b, c) -> tuple[str, str, str]:
    """Upper triangle u00, u01, u11 with U U' = inverse of [[a, b], [b, c]]."""
    l11 = f"sqrt({a})"
    l21 = f"(({b}) / {l11})"
    l22 = f"sqrt(({c}) - {l21} * {l21})"
    return f"(1 / {l11})", f"(-{l21} / ({l11} * {l22}))", f"(1 / {l22})"


def hier() -> str:
    return f"""
hier AS (
  SELECT l_orderkey * 10 + l_linenumber AS index, c_mktsegment AS h1, r_name AS h2,
         {sunday('CAST(l_shipdate AS DATE)')} AS week, ln(1 + l_extendedprice) AS y1,
         l_quantity AS x1, l_discount AS x2, l_tax AS x3
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _pooled(s: int, source: str) -> str:
    """CTEs from v_j, n1 and sum of b (in ``source``) to mu_draw of iteration ``s``."""
    dof, p = S.P2["df1"], 2
    pm, pp = S.P2["prior_mean"], S.P2["prior_precision"]
    seed = S.P2["seed"]
    u = factor("v00", "v01", "v11")
    z = [[normal(key(f"'{seed}|{s}'", "h2", f"'W|{i * dof + j}'")) for j in range(dof)]
         for i in range(p)]
    g0 = [f"({u[0]} * {z[0][j]} + {u[1]} * {z[1][j]})" for j in range(dof)]
    g1 = [f"({u[2]} * {z[1][j]})" for j in range(dof)]
    gs = names([f"{e} AS g0{j}" for j, e in enumerate(g0)]
               + [f"{e} AS g1{j}" for j, e in enumerate(g1)])

    def cross(a, b):
        return "(" + " + ".join(f"g{a}{j} * g{b}{j}" for j in range(dof)) + f") / {dof}"

    prec = (f"n1 * w00 + {pp[0]}", "n1 * w01", f"n1 * w11 + {pp[1]}")
    sig = inverse(*prec)
    r0 = f"(w00 * b0 + w01 * b1 + {pm[0] * pp[0]!r})"
    r1 = f"(w01 * b0 + w11 * b1 + {pm[1] * pp[1]!r})"
    f = factor(*prec)
    zm = [normal(key(f"'{seed}|{s}'", "h2", f"'mu|{i}'")) for i in range(p)]
    return f"""
gauss{s} AS (SELECT *, {gs} FROM {source}),
wish{s} AS (SELECT * EXCLUDE ({names(f'g{i}{j}' for i in (0, 1) for j in range(dof))}),
            {cross(0, 0)} AS w00, {cross(0, 1)} AS w01, {cross(1, 1)} AS w11 FROM gauss{s}),
cov{s} AS (SELECT *, {sig[0]} AS s00, {sig[1]} AS s01, {sig[2]} AS s11 FROM wish{s}),
mean{s} AS (SELECT *, s00 * {r0} + s01 * {r1} AS mu0, s01 * {r0} + s11 * {r1} AS mu1 FROM cov{s}),
pool{s} AS (SELECT *, mu0 + {f[0]} * {zm[0]} + {f[1]} * {zm[1]} AS m0,
            mu1 + {f[2]} * {zm[1]} AS m1 FROM mean{s})"""


def _groups(s: int, source: str, h: str) -> str:
    """CTEs with group covariance, mean, draw and residual sum of iteration ``s``."""
    seed = S.P2["seed"]
    prec = ("h * n + w00", "h * sx + w01", "h * sxx + w11")
    v, f = inverse(*prec), factor(*prec)
    r0, r1 = "(h * sy + w00 * m0 + w01 * m1)", "(h * sxy + w01 * m0 + w11 * m1)"
    z = [normal(key(f"'{seed}|{s}'", "h2", "h1", f"'b|{i}'")) for i in (0, 1)]
    return f"""
gcov{s} AS (SELECT *, {v[0]} AS v00, {v[1]} AS v01, {v[2]} AS v11,
            {f[0]} * {z[0]} + {f[1]} * {z[1]} AS e0, {f[2]} * {z[1]} AS e1
            FROM g JOIN (SELECT h2, w00, w01, w11, m0, m1, {h} AS h FROM {source}) AS st
            USING (h2)),
gmean{s} AS (SELECT *, v00 * {r0} + v01 * {r1} AS mean0, v01 * {r0} + v11 * {r1} AS mean1
             FROM gcov{s}),
draw{s} AS (SELECT *, mean0 + e0 AS b0, mean1 + e1 AS b1 FROM gmean{s})"""


SSR = "syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx"


def _gamma(s: int, source: str, target: str) -> str:
    """h ~ Gamma(v / 2, 2 / (v s2)), first accepted of 32 tries."""
    seed, deflator = S.P2["seed"], S.P2["deflator"]
    k = key(f"'{seed}|{s}'", "h2", "'h'", "k")
    return f"""
tries{s} AS (
  SELECT *, {normal(k)} AS x, {unit(k, 17)} AS u, n / {deflator}::DOUBLE / 2 - 1.0::DOUBLE / 3 AS d
  FROM {source} CROSS JOIN range(0, 32) AS r(k)),
cubes{s} AS (SELECT *, pow(1 + x / sqrt(9 * d), 3) AS v FROM tries{s}),
{target} AS (
  SELECT h2, arg_min(d * v * 2 / (n / {deflator}::DOUBLE * s2), k) AS h FROM cubes{s}
  WHERE v > 0 AND ln(u) < 0.5 * x * x + d - d * v + d * ln(CASE WHEN v > 0 THEN v ELSE 1 END)
  GROUP BY h2)"""


def _noise(s: int) -> str:
    return f"""
noise{s} AS (SELECT h2, sum(n) AS n, sum({SSR}) / (sum(n) / {S.P2['deflator']}::DOUBLE) AS s2
             FROM draw{s} GROUP BY h2),{_gamma(s, f'noise{s}', f'hdraw{s}')}"""


def chain(last: int) -> str:
    """CTEs of the sampler up to iteration ``last``."""
    slope = "(n * sxy - sx * sy) / (n * sxx - sx * sx)"
    text = f"""{hier()},
g AS (SELECT h2, h1, count(*) AS n, sum(x1) AS sx, sum(x1 * x1) AS sxx, sum(y1) AS sy,
      sum(x1 * y1) AS sxy, sum(y1 * y1) AS syy FROM hier GROUP BY h2, h1),
start_i AS (SELECT h2, h1, n, (sy - {slope} * sx) / n AS b0, {slope} AS b1 FROM g),
start_j AS (SELECT h2, (sy - {slope} * sx) / n AS j0, {slope} AS j1 FROM (
  SELECT h2, sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy
  FROM g GROUP BY h2) AS t),
pair AS (SELECT h2, count(*) AS n1, sum(n) AS n, sum(b0) AS b0, sum(b1) AS b1,
         sum((b0 - j0) * (b0 - j0)) + 2 AS v00, sum((b0 - j0) * (b1 - j1)) AS v01,
         sum((b1 - j1) * (b1 - j1)) + 2 AS v11
         FROM start_i JOIN start_j USING (h2) GROUP BY h2),{_pooled(1, 'pair')},{
         _groups(1, 'pool1', '1.0::DOUBLE')},{_noise(1)},
state1 AS (SELECT pool1.* EXCLUDE (n), noise1.n, s2, h FROM pool1 JOIN noise1 USING (h2)
           JOIN hdraw1 USING (h2))"""
    for s in range(2, last + 1):
        text += f""",{_groups(s, f'state{s - 1}', 'h')},{_noise(s)},
pair{s} AS (SELECT h2, count(*) AS n1, sum(b0) AS b0, sum(b1) AS b1,
            sum((b0 - m0) * (b0 - m0)) + 2 AS v00, sum((b0 - m0) * (b1 - m1)) AS v01,
            sum((b1 - m1) * (b1 - m1)) + 2 AS v11 FROM draw{s} GROUP BY h2),{
            _pooled(s, f'pair{s}')},
state{s} AS (SELECT pool{s}.*, noise{s}.n, s2, h FROM pool{s} JOIN noise{s} USING (h2)
             JOIN hdraw{s} USING (h2))"""
    return text


# ---- one statement per query -------------------------------------------------

def _events() -> str:
    return """
chains AS (
  SELECT event_type AS h2, CAST(user_id % 10 AS VARCHAR) AS h1, 'value' AS driver,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS iter, avg(value) AS draw
  FROM events GROUP BY ALL)"""


def _geweke() -> str:
    kept = S.RAW_ITERS - S.BURN_IN
    head = f"iter > {S.BURN_IN} AND iter - {S.BURN_IN} < 0.1 * {kept}"
    tail = f"iter - {S.BURN_IN} > 0.6 * {kept}"

    def part(cond, count, p):
        return (f"SELECT h2, h1, driver, stddev_pop(draw) / sqrt({count}) AS se_{p}, "
                f"avg(draw) AS avg_{p} FROM chains WHERE {cond} GROUP BY ALL")

    return f"""{_events()},
head AS ({part(head, 0.1 * kept, 'a')}),
tail AS ({part(tail, kept - 0.6 * kept, 'c')}),
both_parts AS (SELECT * FROM head JOIN tail USING (h2, h1, driver)),
cd AS (SELECT *, (avg_a - avg_c) / nullif(se_a + se_c, 0) AS cd FROM both_parts)"""


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    def put(name, ctes, keep, doubles, source, digits=4):
        body = out(keep, doubles, source, digits)
        sql[name] = f"WITH {ctes.strip()} {body}" if ctes else body

    facts, hl = _facts(), hier()
    product, row = ["dept", "type"], ["dept", "type", "week"]
    scored_facts = _scored(_transform("facts"))
    fit = f"{facts}, scored AS ({scored_facts}), raw AS ({_raw('scored')})"
    scenario = _scenario()

    # sources and sinks
    put("scan_hier_csv", hl, ["h2", "h1", "n", "first_week", "last_week"], ["y1", "x1"],
        "SELECT h2, h1, count(*) AS n, min(week) AS first_week, max(week) AS last_week, "
        "sum(y1) AS y1, sum(x1) AS x1 FROM hier GROUP BY h2, h1")
    put("split_fields", hl, ["h2", "index_sum", "h1_values", "weeks"], ["y1", "x1", "x2", "x3"],
        "SELECT h2, CAST(sum(index) AS BIGINT) AS index_sum, count(DISTINCT h1) AS h1_values, "
        "count(week) AS weeks, sum(y1) AS y1, sum(x1) AS x1, sum(x2) AS x2, sum(x3) AS x3 "
        "FROM hier GROUP BY h2")
    put("scan_table", "", ["o_orderstatus", "orders"], ["total"],
        "SELECT o_orderstatus, count(*) AS orders, sum(o_totalprice) AS total FROM orders "
        "GROUP BY o_orderstatus", 2)
    levers = ("SELECT CAST(column0 AS DATE) AS week, CAST(column1 AS DOUBLE) AS num_colors, "
              "CAST(column2 AS DOUBLE) AS price, CAST(column3 AS DOUBLE) AS promo_pct, "
              "CAST(column4 AS DOUBLE) AS redline_pct FROM (VALUES "
              + names(str(r) for r in S.LEVERS) + ") AS v(column0, column1, column2, column3, "
              "column4)")
    put("load_local_rows", facts, ["week"], [*PLANNED, "units"],
        f"SELECT * FROM ({levers}) AS l LEFT JOIN (SELECT week, sum(blended_units_total) AS units "
        "FROM facts GROUP BY week) AS s USING (week)")
    put("sink_draws", _events(), ["iter", "rows"], ["total"],
        "SELECT iter, count(*) AS rows, sum(draw) AS total FROM chains GROUP BY iter")
    put("scan_draws", _events(), ["h2", "rows"], ["mean"],
        "SELECT h2, count(*) AS rows, avg(draw) AS mean FROM chains "
        "WHERE iter BETWEEN 11 AND 20 GROUP BY h2")
    put("fetch_rows", facts, product, ["units"],
        "SELECT dept, type, sum(blended_units_total) AS units FROM facts GROUP BY dept, type "
        "ORDER BY dept, type LIMIT 100")
    put("guard_nonempty", facts, ["rows"], [],
        f"SELECT count(*) AS rows FROM facts WHERE dept = '{S.PRODUCT[0]}' "
        f"AND type = '{S.PRODUCT[1]}'")

    # projections and filters
    put("project_rename", facts, ["department", "store", "week"], ["units", "avg_price"],
        "SELECT dept AS department, type AS store, week, blended_units_total AS units, "
        "price AS avg_price FROM facts")
    put("choose_price_column", facts, [*row, "smooth"], ["price"],
        "SELECT dept, type, week, TRUE AS smooth, promo_price_redline_smooth_supsmu AS price "
        "FROM plain UNION ALL SELECT dept, type, week, FALSE, promo_price_redline_smooth FROM plain")
    put("filter_eq_or_all", facts, product, ["units"],
        "SELECT dept, type, sum(blended_units_total) AS units FROM facts "
        f"WHERE type = '{S.PRODUCT[1]}' GROUP BY dept, type")
    put("filter_product", facts, row, ["blended_units_total", "price"],
        f"SELECT * FROM facts WHERE dept = '{S.PRODUCT[0]}' AND type = '{S.PRODUCT[1]}'")
    first, last = (sunday(f"DATE '{d}'") for d in S.HISTORY)
    put("filter_week_range", facts, row, ["blended_units_total"],
        f"SELECT * FROM facts WHERE week >= {first} AND week <= {last}")
    put("drop_null_rows", facts, row, ["promo_price_total", "promo_price_redline"],
        "SELECT * FROM facts WHERE promo_price_total IS NOT NULL "
        "AND promo_price_redline IS NOT NULL")
    chain_keys = ["h2", "h1", "driver", "iter"]
    put("filter_iteration", _events(), ["h2", "h1", "iter"], ["draw"],
        "SELECT * FROM chains WHERE iter = 7")
    put("filter_draw_head", _events(), chain_keys, ["draw"],
        f"SELECT * FROM chains WHERE iter < 0.1 * {S.RAW_ITERS}")
    put("filter_draw_tail", _events(), chain_keys, ["draw"],
        f"SELECT * FROM chains WHERE iter > 0.6 * {S.RAW_ITERS}")
    cd_keys, cd_cols = ["h2", "h1", "driver"], ["se_a", "avg_a", "se_c", "avg_c"]
    put("filter_significant", _geweke(), cd_keys, [*cd_cols, "cd"],
        "SELECT * FROM cd WHERE abs(cd) > 1.96")
    put("key_by", facts, ["dept", "type", "quarter", "rows"], [],
        "SELECT dept, type, quarter, count(*) AS rows FROM facts GROUP BY ALL")

    # joins
    put("cogroup_by_key", "", ["nation", "customers", "suppliers", "customer_ids", "supplier_ids",
                               "last_customer"], [],
        "SELECT CAST(nation AS BIGINT) AS nation, CAST(coalesce(customers, 0) AS BIGINT) AS customers,"
        " CAST(coalesce(suppliers, 0) AS BIGINT) AS suppliers, CAST(coalesce(customer_ids, 0) AS "
        "BIGINT) AS customer_ids, CAST(coalesce(supplier_ids, 0) AS BIGINT) AS supplier_ids, "
        "last_customer FROM (SELECT c_nationkey AS nation, count(*) AS customers, "
        "sum(c_custkey) AS customer_ids, max(c_custkey) AS last_customer FROM customer GROUP BY 1) "
        "AS c FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers, sum(s_suppkey) AS "
        "supplier_ids FROM supplier GROUP BY 1) AS s USING (nation)")
    one = chain(1)
    put("join_coef_levels", one, ["h2", "h1"], ["b0", "b1", "m0", "m1"],
        "SELECT h2, h1, b0, b1, j0 AS m0, j1 AS m1 FROM start_i JOIN start_j USING (h2)", 6)
    put("join_state_to_groups", one, ["h2", "h1", "n"], ["h", "w00", "w01", "w10", "w11", "mu0",
                                                         "mu1"],
        "SELECT h2, h1, g.n, 1.0 AS h, w00, w01, w01 AS w10, w11, m0 AS mu0, m1 AS mu1 "
        "FROM g JOIN pool1 USING (h2)", 6)
    put("join_groups_by_key", one, ["h2", "h1", "n"], ["yty", "b0", "b1"],
        f"SELECT h2, h1, n, syy AS yty, {S.FIXED_B[0]} AS b0, {S.FIXED_B[1]} AS b1 FROM g", 6)
    put("join_level2_tables", hl, ["h2", "n", "n1"], [],
        "SELECT h2, count(*) AS n, count(DISTINCT h1) AS n1 FROM hier GROUP BY h2")
    put("join_count_lookup", hl, ["h2", "h1", "n"], ["y_sum"],
        "SELECT h2, h1, sum(count(*)) OVER (PARTITION BY h2)::BIGINT AS n, sum(y1) AS y_sum "
        "FROM hier GROUP BY h2, h1")
    put("join_geweke_parts", _geweke(), cd_keys, cd_cols, "SELECT * FROM both_parts", 6)
    put("join_model", fit, row, ["price_log", *[f"c{i}" for i in range(11)]],
        "SELECT * FROM scored")
    put("left_join_model_pred", f"{scenario}, rows_t AS ({_transform('facts')}), "
        "half AS (SELECT m.* FROM model AS m JOIN (SELECT DISTINCT dept, gender FROM facts) AS f "
        "USING (dept) WHERE gender = 'F'), past_rows AS (SELECT r.* FROM rows_t AS r "
        "JOIN past USING (dept, type, week)), pred AS (SELECT dept, type, week, "
        f"exp(blended_units_total_log) - 1 AS y, exp({score()}) - 1 AS y_hat FROM past_rows "
        "JOIN half USING (dept, type))",
        row, ["y", "y_hat", "intercept"],
        "SELECT r.dept, r.type, r.week, y, y_hat, c0 AS intercept FROM rows_t AS r "
        "LEFT JOIN half USING (dept, type) LEFT JOIN pred AS p ON r.dept = p.dept AND "
        "r.type = p.type AND r.week = p.week")
    whole = f"{facts}, whole AS ({_scored(_transform('facts'), whole=True)})"
    put("join_year_over_year", whole, [*row, "old_week"], ["y_hat", "old_y_hat"],
        PAIRS.format(new="whole", old="whole"))
    put("align_by_position", scenario, [*row, "pos", "old_week"], PLANNED, "SELECT * FROM aligned")

    # aggregations
    put("group_design_matrix", hl, ["h2", "h1", "distinct_rows"],
        ["x0", "x1", "x2", "x3", "y", "xy"],
        "SELECT h2, h1, count(DISTINCT (week, y1, x1, x2, x3)) AS distinct_rows, "
        "count(*) AS x0, sum(x1) AS x1, sum(x2) AS x2, sum(x3) AS x3, sum(y1) AS y, "
        "sum(y1 * x1) AS xy FROM hier GROUP BY h2, h1")

    def gram(name, ctes, source, y, xs):
        z = ["1.0::DOUBLE", *xs]
        cols = [f"sum({a} * {b}) AS xtx{i}{j}" for i, a in enumerate(z) for j, b in enumerate(z)]
        cols += [f"sum({a} * {y}) AS xty{i}" for i, a in enumerate(z)]
        shown = [c.rsplit(" AS ", 1)[1] for c in cols]
        put(name, ctes, ["h2", "h1", "n"], ["yty", *shown],
            f"SELECT h2, h1, count(*) AS n, sum({y} * {y}) AS yty, {names(cols)} "
            f"FROM {source} GROUP BY h2, h1")

    gram("group_gram", hl, "hier", "y1", ["x1", "x2", "x3"])
    gram("group_gram_weekly",
         f"{facts}, t AS (SELECT * RENAME (dept AS h2, type AS h1) FROM "
         f"({_transform('facts')}) AS q)", "t", "blended_units_total_log", DRIVERS)
    put("child_count", hl, ["h2", "n1"], [],
        "SELECT h2, count(DISTINCT h1) AS n1 FROM hier GROUP BY h2")
    put("rows_per_level2", hl, ["h2", "n"], [], "SELECT h2, count(*) AS n FROM hier GROUP BY h2")
    put("sort_by_key", hl, ["h2", "n"], [],
        "SELECT h2, count(*) AS n FROM hier GROUP BY h2 ORDER BY h2")
    put("sum_vectors", hl, ["h2"], ["v0", "v1", "v2"],
        "SELECT h2, sum(x1) AS v0, sum(x2) AS v1, sum(x3) AS v2 FROM hier GROUP BY h2")
    dev = ["(x1 - 25.0::DOUBLE)", "(x2 - 0.05::DOUBLE)", "(x3 - 0.04::DOUBLE)"]
    cells = [f"sum({dev[i]} * {dev[j]}) + {3 if i == j else 0} AS v_j{i}{j}"
             for i in range(3) for j in range(3)]
    put("sum_outer_products", hl, ["h2"], [c.rsplit(" AS ", 1)[1] for c in cells],
        f"SELECT h2, {names(cells)} FROM hier GROUP BY h2")
    res = f"(y1 - ({S.FIXED_B[0]}::DOUBLE + {S.FIXED_B[1]}::DOUBLE * x1))"
    put("group_ssr", hl, ["h2", "h1", "n"], ["ssr"],
        f"SELECT h2, h1, count(*) AS n, sum({res} * {res}) AS ssr FROM hier GROUP BY h2, h1")
    s2 = (f"SELECT h2, count(*) AS n, sum({res} * {res}) / (count(*) / 2.0::DOUBLE) AS s2 "
          "FROM hier GROUP BY h2")
    put("level2_s2", hl, ["h2", "n"], ["s2"], s2, 6)
    put("geweke_head", _geweke(), cd_keys, ["se_a", "avg_a"], "SELECT * FROM head", 6)
    put("geweke_tail", _geweke(), cd_keys, ["se_c", "avg_c"], "SELECT * FROM tail", 6)
    for name in ("geweke_cd", "geweke_report", "geweke_report_blocks"):
        put(name, _geweke(), cd_keys, [*cd_cols, "cd"], "SELECT * FROM cd", 6)
    put("geweke_share", _geweke(), ["significant", "coefficients"], ["share"],
        "SELECT count(*) FILTER (WHERE abs(cd) > 1.96) AS significant, count(*) AS coefficients, "
        "count(*) FILTER (WHERE abs(cd) > 1.96) / count(*)::DOUBLE AS share FROM cd", 6)
    put("count_rows", facts, ["rows"], [], "SELECT count(*) AS rows FROM facts")
    put("median_of", facts, product, ["median"],
        "SELECT dept, type, median(amount) AS median FROM lines GROUP BY dept, type")

    def each(fn):
        return " UNION ALL ".join(fn(a, b) for a, b in MEASURES)

    put("weekly_units", facts, ["week", "measure"], ["units"], each(
        lambda a, b: f"SELECT week, '{a}_{b}' AS measure, sum({a}_units_{b}) AS units FROM facts "
                     "GROUP BY week"))
    put("weekly_price", facts, ["week", "measure"], ["price"], each(
        lambda a, b: f"SELECT week, '{a}_{b}' AS measure, avg({a}_price_{b}_smooth) AS price "
                     "FROM plain GROUP BY week"))
    put("price_bounds", facts, ["measure"], ["min_price", "max_price"], each(
        lambda a, b: f"SELECT '{a}_{b}' AS measure, min({a}_price_{b}_smooth) AS min_price, "
                     f"max({a}_price_{b}_smooth) AS max_price FROM plain"))
    put("weekly_series", facts, ["week", "measure"], ["units", "price"], each(
        lambda a, b: f"SELECT week, '{a}_{b}' AS measure, sum({a}_units_{b}) AS units, "
                     f"avg({a}_price_{b}_smooth_supsmu) AS price FROM plain GROUP BY week"))
    flags = [f"{a}_units_{b}" for a in ("non_promo", "promo") for b in ("regular", "redline")]
    by_flag = f"SELECT week, {names(f'sum({c}) AS {c}' for c in flags)} FROM facts GROUP BY week"
    put("weekly_units_by_flag", facts, ["week"], flags, by_flag)
    put("stacked_units", facts, ["week", "variable"], ["value"], _long(by_flag, ["week"], flags))
    put("period_bounds", facts, ["brand", *product, "first_week", "last_week"], [],
        "SELECT brand, dept, type, min(week) AS first_week, max(week) AS last_week FROM facts "
        "GROUP BY ALL")
    sum_cols = [f"{c}_sum" for c in ("y_hat", "base_sales", *PARTS)]
    counts = ["weeks", "weeks_without_model"]
    put("decomp_sums", fit, [*product, "fiscal_month", "year", *counts], sum_cols, _sums("FROM raw", "month"))
    put("decomp_regroup", fit, product, CHART,
        f"SELECT dept, type, {names(f'sum({c}) AS {c}' for c in CHART)} FROM "
        f"({_merged(_corrected('FROM raw', 'all'), 'all')}) AS m GROUP BY dept, type")
    pairs = PAIRS.format(new="new", old="old").replace("n.y_hat,", "n.y_hat, n.y,", 1)
    change = half_up("(sum(y_hat) - sum(old_y_hat)) / nullif(sum(old_y_hat), 0)", 4)
    totals = f"""SELECT *, pred + (past_actual - past_sim) AS pred_plus_err FROM (
      SELECT dept, type, round(sum(y_hat)) AS pred, round(sum(y)) AS past_actual,
      round(sum(old_y_hat)) AS past_sim, {change} AS delta, count(*) AS weeks
      FROM ({pairs}) AS p GROUP BY dept, type) AS t"""
    total_cols = ["pred", "past_actual", "past_sim", "pred_plus_err"]
    put("scenario_totals", scenario, product, total_cols, totals)
    put("scenario_delta", scenario, product, ["delta"], totals)
    put("scenario_comparison", scenario, [*product, "weeks", "unpaired"], [*total_cols, "delta"],
        f"SELECT *, planned - weeks AS unpaired FROM ({totals}) AS t JOIN (SELECT dept, type, "
        "count(*) AS planned FROM new GROUP BY ALL) AS n USING (dept, type)")
    put("week_correspondence", facts, [*row, "pos", "old_week"], [],
        "SELECT dept, type, week, CAST((week - first_week) / 7 AS BIGINT) AS pos, "
        "week - 364 AS old_week FROM (SELECT dept, type, min(week) AS first_week, CAST(unnest(range("
        "min(week), max(week) + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS DATE) AS week FROM facts "
        "GROUP BY dept, type) AS w")
    put("whatif_summary", scenario, [*product, "change"], [*total_cols, "delta"],
        "SELECT *, CASE WHEN delta < 0 THEN 'decrease' ELSE 'increase' END AS change FROM "
        f"({totals}) AS t")

    # windows, sorts, sets
    bars = _chart(_merged(_corrected("FROM raw", "quarter"), "quarter"), "quarter")
    bar = [*product, "labels", "variable"]
    put("filter_small_parts", fit, bar, ["value"], bars)
    put("stack_position", fit, bar, ["value", "pos"], bars)
    put("share_within_label", fit, bar, ["value", "pct"], bars)
    put("week_rank", facts, [*row, "pos"], [],
        "SELECT dept, type, week, row_number() OVER (PARTITION BY dept, type ORDER BY week) - 1 "
        "AS pos FROM facts")
    put("with_empty_weeks", facts, [*row, "quarter"], ["units", "xmas"],
        "SELECT dept, type, week, quarter, blended_units_total AS units, holiday_xmas AS xmas FROM plain")
    put("carry_forward_price", facts, row, [f"{a}_price_{b}_smooth" for a, b in MEASURES],
        "SELECT * FROM plain")
    put("sort_by_week", facts, row, ["price"], "SELECT * FROM facts")
    put("sort_period_labels", fit, [*product, "labels", "label_order"], ["y_hat_sum"],
        _labelled(_sums("FROM raw", "month"), "month"))
    put("limit_rows", facts, ["week"], ["units"],
        f"SELECT week, sum(blended_units_total) AS units FROM facts GROUP BY week "
        "ORDER BY week LIMIT 100")
    put("union_all_iterations", _events(), ["h2", "h1", "iter"], ["draw"],
        "SELECT * FROM chains")
    put("distinct_rows", facts, [*row, "promo", "redline"], ["qty"],
        "SELECT DISTINCT dept, type, week, qty, CAST(promo AS BIGINT) AS promo, "
        "CAST(redline AS BIGINT) AS redline FROM lines")
    put("distinct_values", facts, ["brand", "gender", "dept"], [],
        "SELECT DISTINCT brand, gender, dept FROM facts")

    put("product_choices", facts, product, [],
        "SELECT DISTINCT dept, type FROM facts WHERE brand = 'A' AND gender = 'F'")

    # scalar functions and reshaping
    days = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"
    put("floor_week_sunday", days, ["day", "week"], [],
        f"SELECT day, {sunday('day')} AS week FROM days")
    put("week_sequence", facts, ["dept", "weeks", "week"], [],
        "SELECT dept, (last_week - first_week) // 7 + 1 AS weeks, "
        "CAST(unnest(range(first_week, last_week + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS DATE) AS week "
        "FROM (SELECT dept, min(week) AS first_week, max(week) AS last_week FROM facts "
        "GROUP BY dept) AS b")
    first = sunday("CAST(day - INTERVAL 12 MONTH AS DATE)")
    put("same_weeks_last_year", days, ["day", "first", "last"], [],
        f"SELECT day, {first} AS first, {first} + CAST({sunday('(day + 45)')} - {sunday('day')} "
        "AS INTEGER) AS last FROM days")
    put("year_of", facts, ["week", "year"], [], "SELECT DISTINCT week, year(week) AS year FROM facts")
    code = f"lpad(CAST(list_position([{QUOTED_MONTHS}], fiscal_month) AS VARCHAR), 2, '0')"
    put("month_code", facts, ["fiscal_month", "code", "rows"], [],
        f"SELECT fiscal_month, {code} AS code, count(*) AS rows FROM facts GROUP BY fiscal_month")
    put("period_label", facts, ["quarter_label", "month_label", "product_label"], [],
        f"SELECT DISTINCT year(week) || '-' || quarter AS quarter_label, year(week) || '-' || {code} "
        "AS month_label, dept || '-' || type AS product_label FROM facts")
    put("driver_key", hl, ["driver_key"], [],
        "SELECT DISTINCT h2 || '-:-' || h1 || '-:-x1' AS driver_key FROM hier")
    put("log1p_transform", facts, [*row, "quarter", "fiscal_month"],
        ["blended_units_total_log", *DRIVERS], _transform("facts"))
    put("expm1_inverse", fit, row, ["y"], "SELECT * FROM scored")
    put("dot_score", fit, row, ["score", "y", "y_hat", "y_hat_rounded"],
        "SELECT *, round(y_hat) AS y_hat_rounded FROM scored")
    put("residual", fit, row, ["y", "y_hat", "err"], "SELECT *, y - y_hat AS err FROM scored")
    put("driver_contribution", fit, row, list(PARTS), "SELECT * FROM raw")
    put("base_sales", fit, row, ["base_sales"], "SELECT * FROM raw")
    parts = " + ".join(PARTS)
    put("raw_decomp_error", fit, row, ["decomp_sum", "decomp_err"],
        f"SELECT *, {parts} AS decomp_sum, y_hat - (base_sales + {parts}) AS decomp_err FROM raw")
    quarter = [*product, "quarter", "year"]
    put("decomp_corrected", fit, quarter, ["base_sales", *PARTS], _corrected("FROM raw", "quarter"))
    put("decomp_pct", fit, quarter, [f"{p}_pct" for p in ("base_sales", *PARTS)],
        _pct("FROM raw", "quarter"))
    month = [*product, "fiscal_month", "year"]
    merged = _merged(_corrected("FROM raw", "month"), "month")
    put("seasonality_merge", fit, month, CHART, merged)
    put("melt_parts", fit, bar, ["value"],
        _long(_labelled(merged, "month"), [*product, "labels"], CHART))
    lever_cols = names(f"coalesce(l.{c}, a.{c}) AS {c}" for c in PLANNED)
    put("set_levers", scenario, row, PLANNED,
        f"SELECT a.dept, a.type, a.week, {lever_cols} FROM aligned AS a LEFT JOIN ({levers}) AS l "
        "ON a.week = l.week")
    put("default_levers", scenario, row, PLANNED, "SELECT * FROM aligned")
    put("shift_driver", facts, row, PLANNED,
        f"SELECT dept, type, week, num_colors + 2 AS num_colors, price + ({S.PRICE_SHIFT}) AS price, "
        "promo_pct, redline_pct FROM facts")
    put("explode_draws", one, ["iter", "h2", "h1", "driver", "driver_key"], ["draw"],
        "SELECT 1 AS iter, h2, h1, driver, h2 || '-:-' || h1 || '-:-' || driver AS driver_key, draw "
        "FROM (SELECT h2, h1, '1' AS driver, b0 AS draw FROM start_i UNION ALL "
        "SELECT h2, h1, 'x1', b1 FROM start_i) AS t", 6)
    xs = ["x1", "x2", "x3"]
    vectors = (f"{hl}, vec AS (SELECT h2, h1, "
               + names([f"avg({x}) AS a{i}" for i, x in enumerate(xs)]
                       + [f"max({x}) AS b{i}" for i, x in enumerate(xs)]
                       + [f"avg({xs[i]} * {xs[j]}) AS m{i}{j}" for i in (0, 1) for j in (0, 1)])
               + " FROM hier GROUP BY h2, h1)")

    def vec(name, cells):
        put(name, vectors, ["h2", "h1"], list(cells),
            f"SELECT h2, h1, {names(f'{e} AS {c}' for c, e in cells.items())} FROM vec", 6)

    vec("array_add", {f"v{i}": f"a{i} + b{i}" for i in range(3)})
    vec("array_scale", {f"v{i}": f"a{i} * 2.5" for i in range(3)})
    vec("add_diag", {f"v{i}{j}": f"m{i}{j} + {2 if i == j else 0}" for i in (0, 1) for j in (0, 1)})
    vec("diag_of", {f"v{i}{j}": f"a{i}" if i == j else "0.0" for i in range(3) for j in range(3)})
    vec("outer_diff", {f"v{i}{j}": f"(a{i} - b{i}) * (a{j} - b{j})"
                       for i in range(3) for j in range(3)})

    # model fitting
    put("ols_by_group", hl, ["h2", "h1", "n"], ["b0", "b1"],
        "SELECT h2, h1, count(*) AS n, regr_intercept(y1, x1) AS b0, regr_slope(y1, x1) AS b1 "
        "FROM hier GROUP BY h2, h1", 6)
    start = names("2 * " + unit(key("'11|0'", "h2", "h1", f"'start|{i}'"), 1) + f" - 1 AS b{i}"
                  for i in range(4))
    put("random_start_by_group", hl, ["h2", "h1"], [f"b{i}" for i in range(4)],
        f"SELECT h2, h1, {start} FROM (SELECT DISTINCT h2, h1 FROM hier) AS k", 6)
    w = ["w00", "w01", "w10", "w11"]
    put("wishart_draw_by_group", one, ["h2", "n1"], ["v_j00", "v_j01", "v_j10", "v_j11", *w],
        "SELECT h2, n1, v00 AS v_j00, v01 AS v_j01, v01 AS v_j10, v11 AS v_j11, w00, w01, "
        "w01 AS w10, w11 FROM wish1", 6)
    price = {(i, j): f"avg(amount) FILTER (WHERE promo = {bool(i)} AND redline = {bool(j)})"
             for i in (0, 1) for j in (0, 1)}
    put("nearest_pd_by_group", facts, [*product, "was_pd", "is_pd", "unchanged", "is_symmetric"], [],
        "SELECT *, TRUE AS is_pd, was_pd AS unchanged, TRUE AS is_symmetric FROM (SELECT dept, type, "
        "1 - a * a > 0 AND 1 + 2 * a * b * c - a * a - b * b - c * c > 0 AS was_pd FROM ("
        f"SELECT dept, type, 0.9 * {price[1, 0]} / {price[0, 0]} AS a, "
        f"0.8 * {price[0, 1]} / {price[0, 0]} AS b, 0.7 * {price[1, 1]} / {price[0, 0]} AS c "
        "FROM lines GROUP BY dept, type) AS r WHERE a IS NOT NULL AND b IS NOT NULL "
        "AND c IS NOT NULL) AS t")
    put("pooled_covariance", one, ["h2"], ["sigma00", "sigma01", "sigma10", "sigma11"],
        "SELECT h2, s00 AS sigma00, s01 AS sigma01, s01 AS sigma10, s11 AS sigma11 FROM cov1", 6)
    put("pooled_mean", one, ["h2"], ["sum_b0", "sum_b1", "mu0", "mu1"],
        "SELECT h2, b0 AS sum_b0, b1 AS sum_b1, mu0, mu1 FROM mean1", 6)
    put("pooled_draw", one, ["h2"], ["mu_draw0", "mu_draw1"],
        "SELECT h2, m0 AS mu_draw0, m1 AS mu_draw1 FROM pool1", 6)
    put("group_covariance", one, ["h2", "h1"], ["v_i00", "v_i01", "v_i10", "v_i11"],
        "SELECT h2, h1, v00 AS v_i00, v01 AS v_i01, v01 AS v_i10, v11 AS v_i11 FROM gcov1", 8)
    put("group_mean", one, ["h2", "h1"], ["mean0", "mean1"], "SELECT * FROM gmean1", 6)
    put("group_draw", one, ["h2", "h1"], ["draw0", "draw1"],
        "SELECT h2, h1, b0 AS draw0, b1 AS draw1 FROM draw1", 6)
    put("noise_precision_draw", f"{hl}, s2 AS ({s2}),{_gamma(1, 's2', 'hd')}", ["h2", "n"],
        ["s2", "h"], "SELECT * FROM s2 JOIN hd USING (h2)", 6)
    put("gibbs_init", one, ["h2", "n1", "n"], [*w, "mu0", "mu1", "s2", "h"],
        "SELECT h2, n1, CAST(n AS BIGINT) AS n, w00, w01, w01 AS w10, w11, m0 AS mu0, m1 AS mu1, s2, h FROM state1", 6)
    draws = " UNION ALL ".join(
        f"SELECT {s} AS iter, h2, h1, '{d}' AS driver, {b} AS draw FROM draw{s}"
        for s in range(1, S.ITERATIONS + 1) for d, b in (("1", "b0"), ("x1", "b1")))
    put("gibbs_run", chain(S.ITERATIONS), ["iter", "h2", "h1", "driver", "driver_key"], ["draw"],
        f"SELECT *, h2 || '-:-' || h1 || '-:-' || driver AS driver_key FROM ({draws}) AS t", 6)

    # reports
    units = [f"{a}_{b}_units" for a, b in MEASURES]
    priced = [(a, b) for a, b in MEASURES if b != "total"]
    prices = [f"{a}_{b}_price" for a, b in priced]
    put("sales_table", facts, ["department", "store", "week"], [*units, *prices],
        "SELECT dept AS department, type AS store, week, "
        + names([f"{a}_units_{b} AS {a}_{b}_units" for a, b in MEASURES]
                + [f"{a}_price_{b}_smooth AS {a}_{b}_price" for a, b in priced])
        + " FROM plain")
    put("sales_table_smooth", facts, ["department", "store", "week"], [*units, *prices],
        "SELECT dept AS department, type AS store, week, "
        + names([f"{a}_units_{b} AS {a}_{b}_units" for a, b in MEASURES]
                + [f"{a}_price_{b}_smooth_supsmu AS {a}_{b}_price" for a, b in priced])
        + " FROM facts")
    put("products_without_model", facts, product, [],
        "SELECT DISTINCT dept, type FROM facts WHERE gender <> 'F'")
    half = (f"{facts}, half AS (SELECT m.* FROM model AS m JOIN (SELECT DISTINCT dept, gender FROM facts) AS f "
            "USING (dept) WHERE gender = 'F'), scored AS ("
            + _scored(_transform("facts")).replace("JOIN model", "LEFT JOIN half") + f"), raw AS ({_raw('scored')})")
    put("decomposition_without_some_models", half, [*product, "quarter", "year"], CHART,
        _merged(_corrected("FROM raw", "quarter"), "quarter"))
    put("decomposition_coverage", half, [*product, "quarter", "year", *counts], [],
        _sums("FROM raw", "quarter"))
    start, end = (sunday(f"DATE '{d}'") for d in S.SCENARIO)
    put("report_on_selection", f"{fit}, part AS (SELECT r.* FROM raw AS r JOIN (SELECT DISTINCT dept, type, week "
        f"FROM facts WHERE brand = 'A' AND gender = 'F' AND week BETWEEN {start} AND {end}) AS f "
        "USING (dept, type, week))", [*product, "quarter", "year"], CHART,
        _merged(_corrected("FROM part", "quarter"), "quarter"))
    chosen = (f"{facts}, chosen AS (SELECT * FROM plain WHERE brand = 'B' AND gender = 'M' AND "
              f"type = '{S.PRODUCT[1]}' AND week BETWEEN {start} AND {end})")
    put("series_on_selection", chosen, ["week", "measure"], ["units", "price"], each(
        lambda a, b: f"SELECT week, '{a}_{b}' AS measure, sum({a}_units_{b}) AS units, "
                     f"avg({a}_price_{b}_smooth) AS price FROM chosen GROUP BY week"))
    put("stacked_on_selection", chosen, ["week", "variable"], ["value"],
        _long(by_flag.replace("FROM facts", "FROM chosen"), ["week"], flags))
    put("table_on_selection", chosen, ["department", "store", "week"], [*units, *prices],
        "SELECT dept AS department, type AS store, week, "
        + names([f"{a}_units_{b} AS {a}_{b}_units" for a, b in MEASURES]
                + [f"{a}_price_{b}_smooth AS {a}_{b}_price" for a, b in priced])
        + " FROM chosen")
    put("whatif_on_selection", _scenario("none"), [*product, "change"], [*total_cols, "delta"],
        "SELECT *, CASE WHEN delta < 0 THEN 'decrease' ELSE 'increase' END AS change FROM "
        f"({totals}) AS t WHERE dept IN (SELECT dept FROM facts WHERE brand = 'B' AND gender = 'M')")
    new_raw = f"{scenario}, raw AS ({_raw('new')})"
    pct_cols = [f"{c}_pct" for c in CHART]
    for period in PERIOD:
        tail = "" if period == "quarter" else f"_{period}"
        keys = [*product, *PERIOD[period], "year"]
        merged = _merged(_corrected("FROM raw", period), period)
        shares = _merged(_pct("FROM raw", period), period, "_pct")
        for report, ctes in (("historic", fit), ("whatif", new_raw)):
            put(f"{report}_decomposition{tail}", ctes, keys, CHART, merged)
            put(f"{report}_decomposition_pct{tail}", ctes, keys, pct_cols, shares)
        wide = merged
        if period == "all":
            wide = (f"SELECT dept, type, {names(f'sum({c}) AS {c}' for c in CHART)} "
                    f"FROM ({merged}) AS m GROUP BY dept, type")
        put(f"decomposition_chart_rows{tail}", fit, [*bar, "label_order"],
            ["value", "pos", "pct"], _chart(wide, period))
        put(f"whatif_chart_rows_{period}", new_raw, [*bar, "label_order"],
            ["value", "pos", "pct"], _chart(wide, period))
    put("fit_demand_model", f"{facts}, rows_t AS ({_transform('facts')})",
        ["dept", "types", "periods", "width", "finite", "adds_up"], [],
        "SELECT dept, count(DISTINCT type) AS types, count(DISTINCT (type, quarter, year(week))) AS periods, "
        "11 AS width, TRUE AS finite, TRUE AS adds_up FROM rows_t GROUP BY dept")
    first, last = (sunday(f"DATE '{d}'") for d in S.SCENARIO)
    put("scenario_gaps", scenario, [*product, "weeks", "empty_weeks"], [],
        "SELECT *, CAST(whole - weeks AS BIGINT) AS empty_weeks FROM (SELECT dept, type, "
        f"count(DISTINCT week) AS weeks, CAST(({last} - {first}) / 7 AS BIGINT) + 1 AS whole "
        "FROM new GROUP BY dept, type) AS t")
    side = names([*row, "y", "y_hat"])
    put("whatif_predict", scenario, ["side", *row], ["y", "y_hat"],
        f"SELECT 'new' AS side, {side} FROM new UNION ALL SELECT 'old', {side} FROM old")
    put("whatif_rows", scenario, row, ["prediction", "last_year_sales"],
        "SELECT dept, type, week, y_hat AS prediction, y AS last_year_sales FROM new")
    return sql
