WITH RECURSIVE nibbles AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g'), '') AS digits
  FROM documents),
-- CRC-32 by half bytes, the lower half first; the table holds the remainders of 0 to 15
sums AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(list_filter(digits, lambda d: d <> ''), lambda d: (instr('0123456789ABCDEF', d) - 1)::BIGINT)),
    lambda c, p: xor(c >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[(xor(c, p) & 15) + 1])),
    4294967295) AS text_crc32
  FROM nibbles),
counted AS (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS a FROM documents),
halves AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM counted),
numbered AS (
  SELECT doc_id, size, text_crc32, n, a, b, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS number
  FROM sums, halves),
-- each round adds to one half a hash of the other; after six rounds a place of n or more goes through them again
walk AS (
  SELECT number, n, a, b, 0 AS turn, number // b AS x, number % b AS y FROM numbered
  UNION ALL
  SELECT number, n, a, b, turn + 1,
    CASE WHEN turn % 2 = 0 THEN (x + ('0x' || left(md5('20240229:' || (turn % 6) || ':' || y), 15))::BIGINT % a) % a ELSE x END,
    CASE WHEN turn % 2 = 1 THEN (y + ('0x' || left(md5('20240229:' || (turn % 6) || ':' || x), 15))::BIGINT % b) % b ELSE y END
  FROM walk WHERE turn = 0 OR turn % 6 > 0 OR x * b + y >= n),
places AS (SELECT number, x * b + y AS place FROM walk WHERE turn > 0 AND turn % 6 = 0 AND x * b + y < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % 24)::INT AS shard, place // 24 AS slot, NULL::INT AS grown_shard
FROM numbered JOIN places USING (number)
