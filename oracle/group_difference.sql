SELECT row_no, variable, round(finished, 4) AS finished, round(open, 4) AS open, round(diff, 4) AS diff, round(se_diff, 4) AS se_diff FROM (
SELECT 1 AS row_no, 'Quantity' AS variable, m_a AS finished, m_b AS open, m_a - m_b AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS m_a, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS m_b,
             stddev_samp(l_quantity) FILTER (WHERE l_linestatus = 'F') AS s_a, stddev_samp(l_quantity) FILTER (WHERE l_linestatus = 'O') AS s_b,
             count(*) FILTER (WHERE l_linestatus = 'F') AS n_a, count(*) FILTER (WHERE l_linestatus = 'O') AS n_b FROM lineitem)
UNION ALL
SELECT 2 AS row_no, 'Price' AS variable, m_a AS finished, m_b AS open, m_a - m_b AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS m_a, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS m_b,
             stddev_samp(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS s_a, stddev_samp(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS s_b,
             count(*) FILTER (WHERE l_linestatus = 'F') AS n_a, count(*) FILTER (WHERE l_linestatus = 'O') AS n_b FROM lineitem)
UNION ALL
SELECT 3 AS row_no, 'Discount when given' AS variable, m_a AS finished, m_b AS open, m_a - m_b AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(nullif(l_discount, 0)) FILTER (WHERE l_linestatus = 'F') AS m_a, avg(nullif(l_discount, 0)) FILTER (WHERE l_linestatus = 'O') AS m_b,
             stddev_samp(nullif(l_discount, 0)) FILTER (WHERE l_linestatus = 'F') AS s_a, stddev_samp(nullif(l_discount, 0)) FILTER (WHERE l_linestatus = 'O') AS s_b,
             count(*) FILTER (WHERE l_linestatus = 'F') AS n_a, count(*) FILTER (WHERE l_linestatus = 'O') AS n_b FROM lineitem)
UNION ALL
SELECT 4 AS row_no, 'Returned' AS variable, m_a AS finished, m_b AS open, m_a - m_b AS diff, sqrt(s_a * s_a / n_a + s_b * s_b / n_b) AS se_diff
FROM (SELECT avg(CAST(l_returnflag = 'R' AS DOUBLE)) FILTER (WHERE l_linestatus = 'F') AS m_a, avg(CAST(l_returnflag = 'R' AS DOUBLE)) FILTER (WHERE l_linestatus = 'O') AS m_b,
             stddev_samp(CAST(l_returnflag = 'R' AS DOUBLE)) FILTER (WHERE l_linestatus = 'F') AS s_a, stddev_samp(CAST(l_returnflag = 'R' AS DOUBLE)) FILTER (WHERE l_linestatus = 'O') AS s_b,
             count(*) FILTER (WHERE l_linestatus = 'F') AS n_a, count(*) FILTER (WHERE l_linestatus = 'O') AS n_b FROM lineitem))
