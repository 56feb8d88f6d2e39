WITH k AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, month(o_orderdate) AS m, o_custkey, count(*) AS n
  FROM orders GROUP BY ALL)
SELECT year, count(*) AS total_keys, count(*) FILTER (WHERE n > 1) AS repeated_keys,
       round(100 * (count(*) FILTER (WHERE n > 1)) / count(*), 2) AS repeated_pct
FROM k GROUP BY year
