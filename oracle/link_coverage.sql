WITH j AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, n_lines AS a, nullif(c_mktsegment, 'BUILDING') AS b
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
g AS (
  SELECT order_year, count(*) AS total_rows, count(a) AS lines, count(b) AS customer,
         count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS all_links
  FROM j GROUP BY order_year)
SELECT order_year, total_rows, lines, round(100 * lines / total_rows, 2) AS lines_pct,
       customer, round(100 * customer / total_rows, 2) AS customer_pct,
       all_links, round(100 * all_links / total_rows, 2) AS all_links_pct
FROM g
