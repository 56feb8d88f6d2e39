SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderstatus
FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) = 7)
