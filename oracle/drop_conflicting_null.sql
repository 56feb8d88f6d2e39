WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_linestatus, 'O') AS status, l_returnflag FROM lineitem)
SELECT * FROM l
WHERE l_orderkey IN (
  SELECT l_orderkey FROM l GROUP BY 1 HAVING count(DISTINCT status) = 1 AND count(DISTINCT l_returnflag) = 1)
