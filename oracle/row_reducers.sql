WITH l AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round(coalesce(d, 0) + coalesce(t, 0), 4) AS sum_known,
       round(CASE WHEN d IS NULL AND t IS NULL THEN NULL
             ELSE (coalesce(d, 0) + coalesce(t, 0)) / (CAST(d IS NOT NULL AS INTEGER) + CAST(t IS NOT NULL AS INTEGER)) END, 4) AS mean_known,
       round(greatest(d, t), 4) AS max_known
FROM l
