SELECT strftime(o_orderdate, '%m%y') AS date,
       CAST('20' || strftime(o_orderdate, '%y') AS INTEGER) AS year,
       o_orderkey, o_custkey,
       'class "' || o_orderpriority || '", as told' AS o_orderpriority,
       o_totalprice
FROM orders
