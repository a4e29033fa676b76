"""Common table expressions of the check SQL, parallel to the adapters."""

from __future__ import annotations

from panelmark.sources import reference


def values(name: str, columns: list[str], rows, types: dict[str, str] | None = None) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    types = types or {}
    cols = ", ".join(f"CAST({c} AS {types[c]}) AS {c}" if c in types else c for c in columns)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT {cols} FROM (VALUES {body}) AS t({', '.join(columns)}))"


def code(k: str) -> str:
    return f"'N' || chr(65 + CAST(floor({k} / 26) AS INT)) || chr(65 + {k} % 26)"


FACTS = f"""
om AS (SELECT c_nationkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS rev, CAST(count(*) AS DOUBLE) AS cnt
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
lm AS (SELECT s_nationkey AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CAST(sum(CAST(l_discount * 100 AS DECIMAL(18,2))) AS DOUBLE) AS disc,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, CAST(count(*) AS DOUBLE) AS cnt
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
facts AS (
  SELECT 'orders' AS source, 'ORD.REV' AS indicator_code, {code('k')} AS entity, date, rev AS value FROM om
  UNION ALL SELECT 'orders', 'ORD.CNT', {code('k')}, date, cnt FROM om
  UNION ALL SELECT 'orders', 'ORD.AOV', {code('k')}, date,
    CASE WHEN (year(date) * 12 + month(date) + k) % 23 = 0 THEN NULL ELSE rev / cnt END FROM om
  UNION ALL SELECT 'lines', 'LIN.DISC', {code('k')}, date, disc / cnt FROM lm
  UNION ALL SELECT 'lines', 'LIN.QTY', {code('k')}, date, qty FROM lm
  UNION ALL SELECT 'lines', 'ORD.CNT', {code('k')}, date, cnt FROM lm)"""

EVENTS = """
efacts AS (SELECT 'events' AS source, event_type AS indicator_code, CAST(user_id AS VARCHAR) AS entity,
             CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
           FROM events GROUP BY 2, 3, 4)"""

PROFILES = f"""
profiles AS (SELECT {code('n_nationkey')} AS entity,
    chr(65 + CAST(floor(n_nationkey / 26) AS INT)) || chr(65 + n_nationkey % 26) AS iso2,
    n_name AS entity_name, r_name AS region, n_nationkey
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
#: The same without one economy.
PROFILES_SOME = PROFILES[:-1] + f" WHERE {code('n_nationkey')} <> 'NAY')"

_CATALOG_COLUMNS = [part.strip().split(" ")[0] for part in reference.CATALOG_SCHEMA.split(",")]
CATALOG = values("catalog", _CATALOG_COLUMNS, reference.CATALOG_ROWS)
SOURCES = values("srcs", ["source", "base_url", "is_active", "last_run"], reference.SOURCES_ROWS,
                 {"last_run": "TIMESTAMP"})

LATEST = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, indicator_code
             ORDER BY date DESC, source) AS rn FROM facts WHERE value IS NOT NULL) WHERE rn = 1)"""

OBSERVATIONS = """
obs AS (SELECT f.*, c.indicator_name, c.unit, c.frequency, c.concept, c.is_primary, s.is_active,
          p.entity_name, p.region
        FROM facts f JOIN catalog c USING (source, indicator_code) JOIN srcs s USING (source)
        LEFT JOIN profiles p USING (entity) WHERE f.value IS NOT NULL)"""

META = """
meta AS (SELECT c.*, f.country_count, f.observation_count, f.earliest_date, f.latest_date
         FROM catalog c JOIN (SELECT source, indicator_code, count(DISTINCT entity) AS country_count,
           count(value) AS observation_count, min(date) AS earliest_date, max(date) AS latest_date
           FROM facts GROUP BY ALL) f USING (source, indicator_code))"""


def anomalies(facts: str = "facts", name: str = "anomalies", keys: str = "source, indicator_code, entity",
              threshold: float = 2.0, window: int = 12, min_obs: int = 8) -> str:
    on = " AND ".join(f"c.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    ck = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_s AS (SELECT {keys}, date, value, row_number() OVER w AS i, abs(value - lag(value) OVER w) AS step
      FROM {facts} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY {keys} ORDER BY date)),
{name}_p AS (SELECT {ck}, c.date, c.value AS cur, c.i, p.value AS v, p.i - greatest(c.i - {window}, 1) AS x,
        min(p.value) OVER (PARTITION BY {ck}, c.i) > 0 AS islog
      FROM {name}_s c JOIN {name}_s p ON {on} AND p.i < c.i AND p.i >= c.i - {window} WHERE c.i > {min_obs}),
{name}_y AS (SELECT *, CASE WHEN islog THEN ln(CASE WHEN islog THEN v ELSE 1 END) ELSE v END AS y FROM {name}_p),
{name}_f AS (SELECT {keys}, i, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n
      FROM {name}_y GROUP BY ALL),
{name}_r AS (SELECT {keys}, date, cur, i, islog, n, a + b * n AS ahead, y - (a + b * x) AS r
      FROM {name}_y JOIN {name}_f USING ({keys}, i)),
{name}_g AS (SELECT {keys}, date, cur, i, islog, n, ahead, median(abs(r)) AS mad, stddev_pop(r) AS sd,
        list(r ORDER BY r) AS rs FROM {name}_r GROUP BY ALL),
{name}_q AS (SELECT *, CASE WHEN islog THEN exp(ahead) ELSE ahead END AS pred,
        CASE WHEN mad > 0 THEN mad * 1.4826 ELSE sd END AS sigma,
        list_aggregate(rs[1:n//2], 'median') AS q1, list_aggregate(rs[n - n//2 + 1:n], 'median') AS q3 FROM {name}_g),
{name}_z AS (SELECT *, sigma <= (CASE WHEN islog THEN 1.0 ELSE greatest(abs(pred), 1.0) END) * 1e-6 AS flat,
        CASE WHEN islog AND cur > 0 AND pred > 0
             THEN ln(CASE WHEN cur > 0 THEN cur ELSE 1 END) - ln(CASE WHEN pred > 0 THEN pred ELSE 1 END)
             ELSE cur - pred END AS residual FROM {name}_q),
{name} AS (SELECT {keys}, date, cur AS value,
        CASE WHEN flat THEN NULL ELSE round(residual / sigma, 4) END AS z_score,
        CASE WHEN flat THEN 'structural_break' WHEN residual / sigma > 0 THEN 'spike' ELSE 'drop' END AS deviation_type
      FROM {name}_z c WHERE
        (NOT flat AND abs(residual / CASE WHEN flat THEN 1 ELSE sigma END) >= {threshold}
         AND (residual < q1 - 1.5 * (q3 - q1) OR residual > q3 + 1.5 * (q3 - q1)))
        OR (flat AND abs(cur - pred) > greatest(abs(pred), 1.0) * 1e-9
            AND abs(cur - pred) >= 3.0 * coalesce((SELECT median(step) FROM {name}_s p
               WHERE {on} AND p.i < c.i AND p.step > 0), 0)))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
