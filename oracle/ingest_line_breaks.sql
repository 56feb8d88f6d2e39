SELECT strftime(o_orderdate, '%m%y') AS date, CAST('20' || strftime(o_orderdate, '%y') AS INTEGER) AS year, o_orderkey, o_custkey,
       'class "' || o_orderpriority || '", as told' || chr(10) || chr(10) || '"' || o_custkey || '",' || chr(10)
         || repeat('so on' || chr(10), CAST(o_orderkey % 5 AS INTEGER)) || '.' AS o_orderpriority, o_totalprice
FROM orders
