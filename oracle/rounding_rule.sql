WITH l AS (
  SELECT l_orderkey, l_linenumber, l_quantity / 8 AS e, -l_quantity / 40 AS f, l_extendedprice * (1 - l_discount) AS p,
         l_extendedprice * (1 - l_discount) / 7 AS w
  FROM lineitem)
SELECT l_orderkey, l_linenumber,
  (CASE WHEN e < 0 THEN -1 ELSE 1 END) * CASE
    WHEN abs(e) - (floor(abs(e) * 100.0::DOUBLE) / 100.0::DOUBLE) < (ceil(abs(e) * 100.0::DOUBLE) / 100.0::DOUBLE) - abs(e) OR (abs(e) - (floor(abs(e) * 100.0::DOUBLE) / 100.0::DOUBLE) = (ceil(abs(e) * 100.0::DOUBLE) / 100.0::DOUBLE) - abs(e) AND floor(abs(e) * 100.0::DOUBLE)::BIGINT % 2 = 0)
    THEN (floor(abs(e) * 100.0::DOUBLE) / 100.0::DOUBLE) ELSE (ceil(abs(e) * 100.0::DOUBLE) / 100.0::DOUBLE) END + 0.0 AS eighths,
  (CASE WHEN f < 0 THEN -1 ELSE 1 END) * CASE
    WHEN abs(f) - (floor(abs(f) * 10.0::DOUBLE) / 10.0::DOUBLE) < (ceil(abs(f) * 10.0::DOUBLE) / 10.0::DOUBLE) - abs(f) OR (abs(f) - (floor(abs(f) * 10.0::DOUBLE) / 10.0::DOUBLE) = (ceil(abs(f) * 10.0::DOUBLE) / 10.0::DOUBLE) - abs(f) AND floor(abs(f) * 10.0::DOUBLE)::BIGINT % 2 = 0)
    THEN (floor(abs(f) * 10.0::DOUBLE) / 10.0::DOUBLE) ELSE (ceil(abs(f) * 10.0::DOUBLE) / 10.0::DOUBLE) END + 0.0 AS fortieths,
  (CASE WHEN p < 0 THEN -1 ELSE 1 END) * CASE
    WHEN abs(p) - (floor(abs(p) * 10.0::DOUBLE) / 10.0::DOUBLE) < (ceil(abs(p) * 10.0::DOUBLE) / 10.0::DOUBLE) - abs(p) OR (abs(p) - (floor(abs(p) * 10.0::DOUBLE) / 10.0::DOUBLE) = (ceil(abs(p) * 10.0::DOUBLE) / 10.0::DOUBLE) - abs(p) AND floor(abs(p) * 10.0::DOUBLE)::BIGINT % 2 = 0)
    THEN (floor(abs(p) * 10.0::DOUBLE) / 10.0::DOUBLE) ELSE (ceil(abs(p) * 10.0::DOUBLE) / 10.0::DOUBLE) END + 0.0 AS price,
  (CASE WHEN w < 0 THEN -1 ELSE 1 END) * CASE
    WHEN abs(w) - (floor(abs(w) * 1000.0::DOUBLE) / 1000.0::DOUBLE) < (ceil(abs(w) * 1000.0::DOUBLE) / 1000.0::DOUBLE) - abs(w) OR (abs(w) - (floor(abs(w) * 1000.0::DOUBLE) / 1000.0::DOUBLE) = (ceil(abs(w) * 1000.0::DOUBLE) / 1000.0::DOUBLE) - abs(w) AND floor(abs(w) * 1000.0::DOUBLE)::BIGINT % 2 = 0)
    THEN (floor(abs(w) * 1000.0::DOUBLE) / 1000.0::DOUBLE) ELSE (ceil(abs(w) * 1000.0::DOUBLE) / 1000.0::DOUBLE) END + 0.0 AS weekly
FROM l
