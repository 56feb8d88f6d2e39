WITH s AS (
  SELECT o_orderkey, regexp_extract('orders_' || strftime(o_orderdate, '%m%y') || '.csv', '\d{4}') AS mmyy FROM orders)
SELECT o_orderkey, mmyy, CAST(NULL AS VARCHAR) AS no_stamp,
       CAST('20' || substr(mmyy, 3, 2) AS INTEGER) AS stamp_year,
       strftime(strptime('01' || mmyy, '%d%m%y'), '%Y-%m-%d') AS month_start,
       CAST(day(last_day(strptime('01' || mmyy, '%d%m%y'))) AS INTEGER) AS month_days
FROM s
