WITH o AS (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_date FROM orders)
SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year,
       strftime(first_date, '%Y-%m-%d') AS first_day,
       CAST(year(o_orderdate) - year(first_date) AS INTEGER) AS tenure, 0 AS age
FROM o
