-- Product-quantised codes: 4 parts, 256 entries, 4 rounds, squared distances in whole numbers.
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT)) - 1 AS id,
    vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS whole, len(embedding) // 4 AS width
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS (
  SELECT id, part, place, whole[part * width + place + 1] AS v
  FROM (SELECT id, whole, width, part, unnest(range(width)) AS place FROM (SELECT id, whole, width, unnest(range(4)) AS part FROM kept))),
book0 AS (SELECT id AS entry, part, place, v FROM parts WHERE id < 256),
far0 AS (
  SELECT p.id, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v))::BIGINT AS d
  FROM parts p JOIN book0 b ON p.part = b.part AND p.place = b.place GROUP BY ALL),
near0 AS (SELECT id, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM far0 GROUP BY id, part),
mean0 AS (
  SELECT entry, part, place, floor_div AS v
  FROM (SELECT n.entry, p.part, p.place, (sum(p.v) - ((sum(p.v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM parts p JOIN near0 n ON p.id = n.id AND p.part = n.part GROUP BY ALL)),
book1 AS (
  SELECT b.entry, b.part, b.place, coalesce(m.v, b.v)::BIGINT AS v
  FROM book0 b LEFT JOIN mean0 m ON b.entry = m.entry AND b.part = m.part AND b.place = m.place),
far1 AS (
  SELECT p.id, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v))::BIGINT AS d
  FROM parts p JOIN book1 b ON p.part = b.part AND p.place = b.place GROUP BY ALL),
near1 AS (SELECT id, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM far1 GROUP BY id, part),
mean1 AS (
  SELECT entry, part, place, floor_div AS v
  FROM (SELECT n.entry, p.part, p.place, (sum(p.v) - ((sum(p.v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM parts p JOIN near1 n ON p.id = n.id AND p.part = n.part GROUP BY ALL)),
book2 AS (
  SELECT b.entry, b.part, b.place, coalesce(m.v, b.v)::BIGINT AS v
  FROM book1 b LEFT JOIN mean1 m ON b.entry = m.entry AND b.part = m.part AND b.place = m.place),
far2 AS (
  SELECT p.id, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v))::BIGINT AS d
  FROM parts p JOIN book2 b ON p.part = b.part AND p.place = b.place GROUP BY ALL),
near2 AS (SELECT id, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM far2 GROUP BY id, part),
mean2 AS (
  SELECT entry, part, place, floor_div AS v
  FROM (SELECT n.entry, p.part, p.place, (sum(p.v) - ((sum(p.v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM parts p JOIN near2 n ON p.id = n.id AND p.part = n.part GROUP BY ALL)),
book3 AS (
  SELECT b.entry, b.part, b.place, coalesce(m.v, b.v)::BIGINT AS v
  FROM book2 b LEFT JOIN mean2 m ON b.entry = m.entry AND b.part = m.part AND b.place = m.place),
far3 AS (
  SELECT p.id, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v))::BIGINT AS d
  FROM parts p JOIN book3 b ON p.part = b.part AND p.place = b.place GROUP BY ALL),
near3 AS (SELECT id, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM far3 GROUP BY id, part),
mean3 AS (
  SELECT entry, part, place, floor_div AS v
  FROM (SELECT n.entry, p.part, p.place, (sum(p.v) - ((sum(p.v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM parts p JOIN near3 n ON p.id = n.id AND p.part = n.part GROUP BY ALL)),
book4 AS (
  SELECT b.entry, b.part, b.place, coalesce(m.v, b.v)::BIGINT AS v
  FROM book3 b LEFT JOIN mean3 m ON b.entry = m.entry AND b.part = m.part AND b.place = m.place),
far4 AS (
  SELECT p.id, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v))::BIGINT AS d
  FROM parts p JOIN book4 b ON p.part = b.part AND p.place = b.place GROUP BY ALL),
near4 AS (SELECT id, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM far4 GROUP BY id, part),
codes AS (
  SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY id),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS s FROM book4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM kept JOIN codes USING (id), digest
