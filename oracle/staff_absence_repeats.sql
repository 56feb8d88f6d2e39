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
  WHERE races = 1 AND sexes = 1 AND births = 1),
education_records AS (
  SELECT DISTINCT "YEAR", "DATE", "ID_INTERNO", CAST(c_nationkey AS BIGINT) AS "CIE_ESCOLA", "UNIT" AS "UA_EXERC",
         CASE prio WHEN '1' THEN 'LICENCIATURA-PLENA' WHEN '2' THEN 'ENSINO MÉDIO' WHEN '3' THEN 'BACHARELADO/TECNÓLOGO'
              WHEN '5' THEN 'CURSO LIVRE' END AS "FORMACAO_1",
         CASE prio WHEN '1' THEN 'MESTRADO' WHEN '3' THEN 'ESPECIALIZAÇÃO' WHEN '5' THEN 'DOUTORADO' END AS "FORMACAO_2",
         CAST(NULL AS VARCHAR) AS "FORMACAO_3", CAST(NULL AS VARCHAR) AS "FORMACAO_4", CAST(NULL AS VARCHAR) AS "FORMACAO_5",
         CASE prio WHEN '1' THEN 4 WHEN '2' THEN 1 WHEN '3' THEN 3 WHEN '5' THEN 5 END AS "NIVEL_FORMACAO_RANK",
         CASE prio WHEN '1' THEN 'mestrado' WHEN '2' THEN 'sem ensino superior' WHEN '3' THEN 'especialização'
              WHEN '5' THEN 'doutorado' END AS "NIVEL_FORMACAO"
  FROM co WHERE c_nationkey <> 0),
education_keys AS (SELECT "YEAR", "DATE", "ID_INTERNO", "CIE_ESCOLA", count(*) AS n FROM education_records GROUP BY ALL),
education AS (
  SELECT e."YEAR", e."DATE", e."ID_INTERNO", e."CIE_ESCOLA", "UA_EXERC" AS "UAC", "FORMACAO_1", "FORMACAO_2", "FORMACAO_3",
         "FORMACAO_4", "FORMACAO_5", "NIVEL_FORMACAO_RANK", "NIVEL_FORMACAO"
  FROM education_records e JOIN education_keys USING ("YEAR", "DATE", "ID_INTERNO", "CIE_ESCOLA")
  WHERE n = 1 AND "FORMACAO_1" IS NOT NULL),
per_order AS (
  SELECT l_orderkey,
         sum(l_linenumber) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS "TT_DIAS_FALTA_MEDICA",
         sum(l_linenumber) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS "TT_DIAS_FALTA_JUST",
         sum(l_linenumber) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F') AS "TT_DIAS_FALTA_INJUST",
         sum(l_linenumber) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS "TT_DIAS_LIC_PREMIO",
         sum(l_linenumber) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS "TT_DIAS_LIC_GESTANTE",
         sum(l_linenumber) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS "TT_DIAS_LIC_ACID_TRAB",
         count(*) FILTER (WHERE l_quantity > 45) AS "TT_DIAS_LIC_INTER_PARTIC",
         sum(l_linenumber) AS "TOT_DIAS_AUSENCIAS"
  FROM lineitem GROUP BY 1),
absence_records AS (
  SELECT DISTINCT "YEAR", "DATE", "ID_INTERNO", "UNIT" AS "UA_EXERC", CAST(c_nationkey AS BIGINT) AS "CIE_ESCOLA",
         per_order.* EXCLUDE (l_orderkey), 30 AS "TOTAL_DIAS_MES"
  FROM co JOIN per_order ON l_orderkey = o_orderkey
  WHERE o_orderstatus <> 'P' AND c_nationkey <> 0),
absence_keys AS (SELECT "YEAR", "DATE", "ID_INTERNO", "CIE_ESCOLA", count(*) AS n FROM absence_records GROUP BY ALL)
SELECT "YEAR", count(*) AS total_keys, count(*) FILTER (WHERE n > 1) AS repeated_keys,
       round(100 * (count(*) FILTER (WHERE n > 1)) / count(*), 2) AS repeated_pct
FROM absence_keys GROUP BY 1
