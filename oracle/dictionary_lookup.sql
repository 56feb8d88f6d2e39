SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'STANDARD' THEN 'usual' WHEN 'PROMO' THEN 'cheap' END AS price_band
FROM part
