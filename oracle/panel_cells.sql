WITH so AS (
  SELECT o.*, CAST(year(o_orderdate) AS INTEGER) AS order_year, nullif(o_orderstatus, 'P') AS contract,
         c_acctbal, c_mktsegment, n_name, r_name
  FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey),
sums AS (
  SELECT order_year, n_name, r_name, count(DISTINCT o_custkey) AS n_customers, count(*) AS n,
         CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS total_price,
         CAST(sum(CAST(c_acctbal AS DECIMAL(12, 2))) AS DOUBLE) AS total_balance,
         avg(CAST(o_totalprice >= 250000 AS DOUBLE)) AS share_large,
         count(DISTINCT CASE WHEN contract = 'O' THEN o_custkey END) AS n_open,
         count(DISTINCT CASE WHEN contract = 'O' THEN o_custkey END) + max(CAST(contract IS NULL AS INTEGER)) AS n_open_na,
         avg(CAST(contract = 'O' AS DOUBLE)) AS share_open,
         avg(CAST(o_orderpriority = '1-URGENT' AS DOUBLE)) AS share_urgent
  FROM so GROUP BY 1, 2, 3),
cells AS (
  SELECT order_year, n_name, r_name, n_customers, total_price, total_price / 365 AS price_per_day,
         total_price / n_customers AS price_per_customer, share_large, n_open, n_open_na, share_open, share_urgent,
         total_balance / n AS mean_balance, total_price / n AS mean_price
  FROM sums)
SELECT * FROM cells
