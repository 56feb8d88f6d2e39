SELECT strftime(o_orderdate, '%m%y') AS date,
       CAST('20' || strftime(o_orderdate, '%y') AS INTEGER) AS year,
       o_orderkey, o_custkey,
       CASE WHEN month(o_orderdate) % 2 = 0 THEN 'class "' || o_orderpriority || '", as told' END AS o_orderpriority,
       o_totalprice
FROM orders
