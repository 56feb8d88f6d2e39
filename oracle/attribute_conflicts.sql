WITH e AS (
  SELECT l_orderkey, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS statuses
  FROM lineitem GROUP BY l_orderkey),
y AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS total_rows,
         count(*) FILTER (WHERE flags > 1) AS f, count(*) FILTER (WHERE statuses > 1) AS s
  FROM lineitem JOIN e USING (l_orderkey) GROUP BY 1)
SELECT ship_year, total_rows, f AS l_returnflag_conflict, s AS l_linestatus_conflict,
       round(100 * f / total_rows, 2) AS l_returnflag_pct, round(100 * s / total_rows, 2) AS l_linestatus_pct
FROM y
