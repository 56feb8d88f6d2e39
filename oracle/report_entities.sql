SELECT 1 AS row_no, CAST(NULL AS VARCHAR) AS section, 'N (customers)' AS variable,
       CAST(count(DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END) AS DOUBLE) AS building,
       CAST(count(DISTINCT CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey END) AS DOUBLE) AS machinery,
       CAST(NULL AS DOUBLE) AS diff, CAST(NULL AS DOUBLE) AS se_diff
FROM customer
