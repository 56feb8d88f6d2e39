WITH c AS (SELECT c_custkey, CAST(c_custkey * 1000003 AS VARCHAR) AS raw_code FROM customer)
SELECT c_custkey, raw_code, '35' || substr(right('00000000' || raw_code, 8), 3) AS site_code FROM c
