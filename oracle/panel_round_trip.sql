SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS "YEAR"
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998
