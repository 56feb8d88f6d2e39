SELECT l_orderkey, l_linenumber,
       round(coalesce(nullif(l_discount, 0), 0), 4) AS "TT_discount",
       round(coalesce(nullif(l_tax, 0), 0), 4) AS "TOT_tax",
       nullif(l_linenumber, 1) AS other,
       round(coalesce(nullif(l_discount, 0), 0) + coalesce(nullif(l_tax, 0), 0), 4) AS "TOTAL"
FROM lineitem
