SELECT nullif(o_orderpriority, '5-LOW') AS priority, count(*) AS n
FROM orders
WHERE nullif(o_orderpriority, '5-LOW') IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
GROUP BY 1
