SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1)
