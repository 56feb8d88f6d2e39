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
SELECT row_no, section, variable, round(asia, 4) AS asia, round(europe, 4) AS europe, round(diff, 4) AS diff, round(se_diff, 4) AS se_diff FROM (
SELECT 1 AS row_no, 'Customers' AS section, 'Number of customers' AS variable, m_a AS asia, m_b AS europe, m_b - m_a AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(n_customers) FILTER (WHERE r_name = 'ASIA') AS m_a, avg(n_customers) FILTER (WHERE r_name = 'EUROPE') AS m_b,
             stddev_samp(n_customers) FILTER (WHERE r_name = 'ASIA') AS s_a, stddev_samp(n_customers) FILTER (WHERE r_name = 'EUROPE') AS s_b,
             count(*) FILTER (WHERE r_name = 'ASIA') AS n_a, count(*) FILTER (WHERE r_name = 'EUROPE') AS n_b FROM cells)
UNION ALL
SELECT 2 AS row_no, 'Customers' AS section, 'Open orders' AS variable, m_a AS asia, m_b AS europe, m_b - m_a AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(share_open) FILTER (WHERE r_name = 'ASIA') AS m_a, avg(share_open) FILTER (WHERE r_name = 'EUROPE') AS m_b,
             stddev_samp(share_open) FILTER (WHERE r_name = 'ASIA') AS s_a, stddev_samp(share_open) FILTER (WHERE r_name = 'EUROPE') AS s_b,
             count(*) FILTER (WHERE r_name = 'ASIA') AS n_a, count(*) FILTER (WHERE r_name = 'EUROPE') AS n_b FROM cells)
UNION ALL
SELECT 3 AS row_no, 'Orders' AS section, 'Price' AS variable, m_a AS asia, m_b AS europe, m_b - m_a AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(mean_price) FILTER (WHERE r_name = 'ASIA') AS m_a, avg(mean_price) FILTER (WHERE r_name = 'EUROPE') AS m_b,
             stddev_samp(mean_price) FILTER (WHERE r_name = 'ASIA') AS s_a, stddev_samp(mean_price) FILTER (WHERE r_name = 'EUROPE') AS s_b,
             count(*) FILTER (WHERE r_name = 'ASIA') AS n_a, count(*) FILTER (WHERE r_name = 'EUROPE') AS n_b FROM cells)
UNION ALL
SELECT 4 AS row_no, 'Orders' AS section, 'Price per customer' AS variable, m_a AS asia, m_b AS europe, m_b - m_a AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(price_per_customer) FILTER (WHERE r_name = 'ASIA') AS m_a, avg(price_per_customer) FILTER (WHERE r_name = 'EUROPE') AS m_b,
             stddev_samp(price_per_customer) FILTER (WHERE r_name = 'ASIA') AS s_a, stddev_samp(price_per_customer) FILTER (WHERE r_name = 'EUROPE') AS s_b,
             count(*) FILTER (WHERE r_name = 'ASIA') AS n_a, count(*) FILTER (WHERE r_name = 'EUROPE') AS n_b FROM cells))
