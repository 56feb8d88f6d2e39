WITH s AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT o_orderkey, strftime(o_orderdate, '%m%y') AS mmyy, CAST(year(o_orderdate) AS INTEGER) AS year,
       '35' || substr(right('00000000' || CAST(c_custkey AS VARCHAR), 8), 3) AS site,
       round(q, 4) AS "TT_quantity", round(coalesce(r, 0), 4) AS "TOT_returned",
       CAST(day(last_day(o_orderdate)) AS INTEGER) AS "TOTAL_DAYS",
       round(coalesce(r, 0) / day(last_day(o_orderdate)), 4) AS "RATE",
       c_mktsegment, n_name, n_regionkey, r_name
FROM orders JOIN s ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
