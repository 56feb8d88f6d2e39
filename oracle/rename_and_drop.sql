SELECT s_suppkey AS "SUPPLIER", s_nationkey AS "NATION", round(s_acctbal, 2) AS "S_ACCTBAL",
       s_nationkey * 2 AS "S_NATIONKEY_twice", round(s_acctbal * 2, 2) AS "S_ACCTBAL_twice"
FROM supplier
