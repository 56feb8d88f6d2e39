SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderstatus AS status, o_orderpriority
FROM orders
WHERE nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 1000 AND o_custkey <> 0
  AND o_orderpriority IN ('1-URGENT', '2-HIGH')
