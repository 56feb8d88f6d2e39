WITH co AS (
  SELECT o.*, c_nationkey, c_acctbal, c_mktsegment, strftime(o_orderdate, '%m%y') AS "DATE",
         CAST(year(o_orderdate) AS INTEGER) AS "YEAR", 'T' || o_custkey AS "ID_INTERNO",
         'U' || c_nationkey AS "UNIT", left(o_orderpriority, 1) AS prio
  FROM orders o JOIN customer ON c_custkey = o_custkey),
raw_active AS (
  SELECT "DATE", "YEAR", "ID_INTERNO", "UNIT" AS "UAC",
         CASE prio WHEN '1' THEN 'A' WHEN '2' THEN 'O' WHEN '3' THEN 'O' WHEN '4' THEN 'P'
              ELSE CASE WHEN o_orderstatus <> 'F' THEN 'D' END END AS "CATEG_E",
         CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'F' ELSE 'M' END END AS "SEXO",
         CASE WHEN o_totalprice > 499000 THEN 'N' ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'D' WHEN 'AUTOMOBILE' THEN ''
              WHEN 'MACHINERY' THEN 'N' ELSE 'B' END END AS race,
         DATE '1950-01-01' + CAST(o_custkey % 12000 AS INTEGER) AS "DATA_NASCIMENTO",
         CASE WHEN o_totalprice >= 2000 THEN CAST(o_orderdate AS DATE) END AS started
  FROM co
  WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')),
dated AS (SELECT *, min(started) OVER (PARTITION BY "ID_INTERNO") AS "DATA_INICIO_EXERCICIO_E" FROM raw_active),
active_records AS (
  SELECT DISTINCT "DATE", "YEAR", "ID_INTERNO", "UAC", "CATEG_E", "SEXO",
         CASE WHEN race IN ('', 'D') THEN 'S/INFO' WHEN race = 'N' THEN 'P' ELSE race END AS "ID_COR",
         "DATA_NASCIMENTO", "DATA_INICIO_EXERCICIO_E",
         "YEAR" - CAST(year("DATA_INICIO_EXERCICIO_E") AS INTEGER) AS "ANOS_ATIVIDADE",
         "YEAR" - CAST(year("DATA_NASCIMENTO") AS INTEGER) AS "IDADE"
  FROM dated),
traits AS (
  SELECT "ID_INTERNO", count(DISTINCT "ID_COR") AS races, count(DISTINCT "SEXO") AS sexes,
         count(DISTINCT "DATA_NASCIMENTO") AS births
  FROM active_records GROUP BY 1),
active AS (
  SELECT active_records.*,
         CASE WHEN "CATEG_E" = 'A' THEN 'Efetivo' WHEN "CATEG_E" IN ('P', 'F', 'N') THEN 'Estável'
              WHEN "CATEG_E" = 'O' THEN 'Temporário' WHEN "CATEG_E" IN ('D', 'C') THEN 'NI' END AS "CATEG_corr"
  FROM active_records JOIN traits USING ("ID_INTERNO")
  WHERE races = 1 AND sexes = 1 AND births = 1)
SELECT * REPLACE (CAST("DATA_NASCIMENTO" AS VARCHAR) AS "DATA_NASCIMENTO", CAST("DATA_INICIO_EXERCICIO_E" AS VARCHAR) AS "DATA_INICIO_EXERCICIO_E") FROM active
