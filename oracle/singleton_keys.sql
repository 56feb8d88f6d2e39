SELECT l_orderkey, l_linenumber, any_value(l_partkey) AS l_partkey, any_value(l_quantity) AS l_quantity,
       any_value(l_returnflag) AS l_returnflag
FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1
