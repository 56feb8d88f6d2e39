WITH levels(word, level, pos) AS (VALUES
  ('small', 'plain', 1), ('large', 'plain', 1), ('blue', 'coloured', 2), ('red', 'coloured', 2),
  ('widget', 'coloured', 2), ('gizmo', 'notable', 3), ('anvil', 'notable', 3)),
p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
r AS (
  SELECT p_partkey, w1, w2, greatest(a.pos, b.pos) AS rank
  FROM p LEFT JOIN levels a ON a.word = w1 LEFT JOIN levels b ON b.word = w2)
SELECT p_partkey, w1 AS p_name_1, w2 AS p_name_2, 'extra' AS p_name_3, rank,
       CASE rank WHEN 1 THEN 'plain' WHEN 2 THEN 'coloured' WHEN 3 THEN 'notable' END AS level
FROM r
