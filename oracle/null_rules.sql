WITH o AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, nullif(o_orderstatus, 'P') AS contract, o_totalprice,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS person,
         CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS amount
  FROM orders)
SELECT order_year, count(*) AS n_rows, count(amount) AS n_amounts, count(DISTINCT person) AS people,
       count(DISTINCT person) + max(CAST(person IS NULL AS INTEGER)) AS people_na,
       count(DISTINCT CASE WHEN contract = 'O' THEN person END) AS open_people,
       count(DISTINCT CASE WHEN contract = 'O' THEN person END)
         + max(CAST(contract IS NULL OR (contract = 'O' AND person IS NULL) AS INTEGER)) AS open_people_na,
       count(*) FILTER (WHERE contract IS NULL OR contract <> 'O') AS kept_rows,
       round(avg(CAST(contract = 'O' AS DOUBLE)), 4) AS share_known,
       round(avg(CAST(coalesce(contract = 'O', false) AS DOUBLE)), 4) AS share_all,
       round(avg(o_totalprice), 4) AS mean_of_means,
       round(stddev_samp(amount) / sqrt(count(*)), 4) AS error
FROM o GROUP BY order_year
