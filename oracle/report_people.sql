WITH so AS (
  SELECT o.*, CAST(year(o_orderdate) AS INTEGER) AS order_year, nullif(o_orderstatus, 'P') AS contract,
         c_acctbal, c_mktsegment, n_name, r_name
  FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey)
SELECT part_no, row_no, section, variable, round(building, 4) AS building, round(machinery, 4) AS machinery, round(diff, 4) AS diff, round(se_diff, 4) AS se_diff FROM (
SELECT 1 AS part_no, * FROM (SELECT 1 AS row_no, 'General' AS section, 'Balance' AS variable, m_a AS building, m_b AS machinery, m_a - m_b AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS m_a, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m_b,
             stddev_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS s_a, stddev_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS s_b,
             count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_a, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS n_b FROM so)
UNION ALL
SELECT 2 AS row_no, 'General' AS section, 'Price' AS variable, m_a AS building, m_b AS machinery, m_a - m_b AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS m_a, avg(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m_b,
             stddev_samp(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS s_a, stddev_samp(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS s_b,
             count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_a, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS n_b FROM so)
UNION ALL
SELECT 3 AS row_no, 'Contract' AS section, 'Open' AS variable, m_a AS building, m_b AS machinery, m_a - m_b AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(CAST(coalesce(contract = 'O', false) AS DOUBLE)) FILTER (WHERE c_mktsegment = 'BUILDING') AS m_a, avg(CAST(coalesce(contract = 'O', false) AS DOUBLE)) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m_b,
             stddev_samp(CAST(coalesce(contract = 'O', false) AS DOUBLE)) FILTER (WHERE c_mktsegment = 'BUILDING') AS s_a, stddev_samp(CAST(coalesce(contract = 'O', false) AS DOUBLE)) FILTER (WHERE c_mktsegment = 'MACHINERY') AS s_b,
             count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_a, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS n_b FROM so)
UNION ALL
SELECT 4 AS row_no, 'Contract' AS section, 'Pressing' AS variable, m_a AS building, m_b AS machinery, m_a - m_b AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE)) FILTER (WHERE c_mktsegment = 'BUILDING') AS m_a, avg(CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE)) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m_b,
             stddev_samp(CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE)) FILTER (WHERE c_mktsegment = 'BUILDING') AS s_a, stddev_samp(CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE)) FILTER (WHERE c_mktsegment = 'MACHINERY') AS s_b,
             count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_a, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS n_b FROM so))
UNION ALL
SELECT 2, *, NULL, NULL FROM (SELECT 1 AS row_no, 'Motives' AS section, '1-URGENT' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '1-URGENT') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so
UNION ALL
SELECT 2 AS row_no, 'Motives' AS section, '2-HIGH' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '2-HIGH') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '2-HIGH') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so
UNION ALL
SELECT 3 AS row_no, 'Motives' AS section, '3-MEDIUM' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '3-MEDIUM') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '3-MEDIUM') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so
UNION ALL
SELECT 4 AS row_no, 'Motives' AS section, '4-NOT SPECIFIED' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '4-NOT SPECIFIED') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '4-NOT SPECIFIED') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so
UNION ALL
SELECT 5 AS row_no, 'Motives' AS section, '5-LOW' AS variable,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '5-LOW') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '5-LOW') / sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM so)
UNION ALL
SELECT 3, 1, 'Motives', 'N (customers)', count(DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN o_custkey END),
       count(DISTINCT CASE WHEN c_mktsegment = 'MACHINERY' THEN o_custkey END), NULL, NULL FROM so)
