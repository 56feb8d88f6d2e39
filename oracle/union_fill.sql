SELECT 'order' AS kind, o_orderkey AS key, round(o_totalprice, 2) AS amount, NULL AS segment FROM orders
UNION ALL
SELECT 'customer', c_custkey, NULL, c_mktsegment FROM customer
