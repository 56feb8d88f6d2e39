SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_returnflag,
       round(fsum(CASE WHEN l_linenumber <> 4 THEN l_extendedprice * (1 - l_discount) END), 5) AS income,
       round(fsum(CASE WHEN l_orderkey % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END / 3), 5) AS signed,
       round(fsum(l_tax / 7) / count(l_tax), 12) AS mean_tax,
       round(fsum(CASE WHEN l_linenumber <> 4 THEN l_extendedprice * (1 - l_discount) END) / (fsum(l_tax / 7) / count(l_tax)), 3) AS per_tax
FROM lineitem GROUP BY 1, 2
