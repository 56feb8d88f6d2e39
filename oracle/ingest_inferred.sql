SELECT strftime(o_orderdate, '%m%y') AS date,
       CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey END AS order_key,
       CASE WHEN month(o_orderdate) % 2 = 0 AND o_orderkey % 5 > 0 THEN o_orderstatus = 'O' END AS is_open,
       strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day,
       2 * CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice ELSE floor(o_totalprice) END AS twice,
       CASE WHEN o_orderkey % 1000 = 1 THEN 'none' ELSE CAST(o_custkey AS VARCHAR) END || '!' AS customer
FROM orders
