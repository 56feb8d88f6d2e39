WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events)
SELECT * FROM e
WHERE user_id IN (SELECT user_id FROM e GROUP BY 1 HAVING count(DISTINCT day) = (SELECT count(DISTINCT day) FROM e))
