SELECT DISTINCT l_orderkey, l_linenumber, nullif(l_returnflag, 'A') AS flag, nullif(l_linestatus, 'F') AS status, l_quantity
FROM lineitem
