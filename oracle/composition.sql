WITH so AS (
  SELECT o.*, CAST(year(o_orderdate) AS INTEGER) AS order_year, nullif(o_orderstatus, 'P') AS contract,
         c_acctbal, c_mktsegment, n_name, r_name
  FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey)
SELECT row_no, section, variable, round(building, 4) AS building, round(machinery, 4) AS machinery FROM (
SELECT 1 AS row_no, 'Motives' AS section, '1-URGENT' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '1-URGENT') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so WHERE o_totalprice > 2000
UNION ALL
SELECT 2 AS row_no, 'Motives' AS section, '2-HIGH' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '2-HIGH') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '2-HIGH') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so WHERE o_totalprice > 2000
UNION ALL
SELECT 3 AS row_no, 'Motives' AS section, '3-MEDIUM' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '3-MEDIUM') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '3-MEDIUM') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so WHERE o_totalprice > 2000
UNION ALL
SELECT 4 AS row_no, 'Motives' AS section, '4-NOT SPECIFIED' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '4-NOT SPECIFIED') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '4-NOT SPECIFIED') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so WHERE o_totalprice > 2000
UNION ALL
SELECT 5 AS row_no, 'Motives' AS section, '5-LOW' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '5-LOW') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '5-LOW') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so WHERE o_totalprice > 2000)
