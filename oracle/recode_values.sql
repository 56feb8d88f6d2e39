WITH o AS (SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)
SELECT o_orderkey,
       CASE WHEN status IN ('O', '') THEN 'S/INFO' WHEN status = 'F' THEN 'P' ELSE status END AS kept,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'top'
            WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'mid'
            WHEN o_orderpriority = '5-LOW' THEN 'low' END AS band,
       coalesce(status = 'F', false) AS is_f,
       NOT coalesce(status = 'F', false) AS not_f,
       CASE WHEN status IS NULL THEN NULL WHEN status = 'F' THEN 'yes' ELSE 'no' END AS choice,
       CAST(status = 'F' AS DOUBLE) AS flag_f
FROM o
