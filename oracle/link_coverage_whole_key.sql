WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, value FROM events),
j AS (
  SELECT v.day, c.value AS a, p.value AS b
  FROM (SELECT * FROM e WHERE event_type = 'view') v
  LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON c.user_id = v.user_id AND c.day = v.day
  LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') p ON p.user_id = v.user_id AND p.day = v.day),
g AS (
  SELECT day, count(*) AS total_rows, count(a) AS click, count(b) AS buy,
         count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS click_and_buy
  FROM j GROUP BY day)
SELECT day, total_rows, click, round(100 * click / total_rows, 2) AS click_pct,
       buy, round(100 * buy / total_rows, 2) AS buy_pct,
       click_and_buy, round(100 * click_and_buy / total_rows, 2) AS click_and_buy_pct
FROM g
