SELECT nullif(o_orderstatus, 'P') AS status, o_orderpriority, count(*) AS n
FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F' GROUP BY 1, 2
