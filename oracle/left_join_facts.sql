WITH e AS (
  SELECT event_id, user_id, CAST(year(ts) AS INTEGER) AS year, strftime(ts, '%Y-%m-%d') AS day,
         CASE WHEN hour(ts) < 12 THEN 'am' WHEN hour(ts) < 18 THEN 'pm' END AS hour_band,
         event_type, round(value, 2) AS value
  FROM events),
c AS (
  SELECT user_id, year, day, hour_band, any_value(value) AS value FROM e WHERE event_type = 'click'
  GROUP BY ALL HAVING count(*) = 1),
p AS (
  SELECT user_id, year, day, hour_band, any_value(value) AS value FROM e WHERE event_type = 'purchase'
  GROUP BY ALL HAVING count(*) = 1)
SELECT e.event_id, e.user_id, e.year, e.day, e.hour_band, e.value AS value_x, c.value AS value_y, p.value AS bought
FROM e
LEFT JOIN c ON c.user_id = e.user_id AND c.year = e.year AND c.day = e.day AND c.hour_band IS NOT DISTINCT FROM e.hour_band
LEFT JOIN p ON p.user_id = e.user_id AND p.year = e.year AND p.day = e.day AND p.hour_band IS NOT DISTINCT FROM e.hour_band
WHERE e.event_type = 'view'
