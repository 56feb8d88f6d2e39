WITH l AS (
  SELECT l_suppkey, strftime(l_shipdate, '%m%y') AS mmyy, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
         l_orderkey, l_linenumber, l_quantity
  FROM lineitem),
k AS (SELECT l_suppkey FROM l GROUP BY 1 HAVING count(DISTINCT mmyy) = (SELECT count(DISTINCT mmyy) FROM l)),
b AS (SELECT * FROM l WHERE l_suppkey IN (SELECT l_suppkey FROM k))
SELECT ship_year, count(DISTINCT l_suppkey) AS suppliers FROM b GROUP BY 1
