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
absence_keys AS (SELECT "YEAR", "DATE", "ID_INTERNO", "CIE_ESCOLA", count(*) AS n FROM absence_records GROUP BY ALL),
absences AS (
  SELECT a.* RENAME ("UA_EXERC" AS "UAC")
  FROM (SELECT r.* FROM absence_records r JOIN absence_keys USING ("YEAR", "DATE", "ID_INTERNO", "CIE_ESCOLA") WHERE n = 1) a),
schools AS (
  SELECT "YEAR", CAST(35000000 + c_nationkey AS VARCHAR) AS "CIE_ESCOLA", n_nationkey, n_regionkey, r_name,
         count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS p
  FROM co JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
rates AS (
  SELECT *, CASE WHEN n_nationkey <> 5 THEN f / 100 END AS fun,
         CASE WHEN n_nationkey <> 5 AND n_regionkey <> 0 THEN p / 100 END AS med FROM schools),
dropout AS (
  SELECT "YEAR", n_regionkey + 100 AS "CO_MUNICIPIO", "CIE_ESCOLA",
         CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'Rural' ELSE 'Urbana' END AS "NO_CATEGORIA",
         'Estadual' AS "NO_DEPENDENCIA", fun AS "3_CAT_FUN", med AS "3_CAT_MED",
         CASE WHEN fun IS NULL THEN med WHEN med IS NULL THEN fun ELSE (fun + med) / 2 END AS drop_mean
  FROM rates WHERE n_nationkey <> 24),
census AS (
  SELECT "YEAR", "CIE_ESCOLA", orders AS "QT_MAT_FUND", CASE WHEN n_regionkey <> 1 THEN p END AS "QT_MAT_MED",
         o AS "QT_MAT_BAS_PRETA", orders + CASE WHEN n_regionkey <> 1 THEN p ELSE 0 END AS "QT_MAT_FUND_MED"
  FROM schools WHERE n_nationkey <> 3),
idx AS (
  SELECT CAST(35000000 + n_nationkey AS VARCHAR) AS "CIE_ESCOLA", n_regionkey + 4.5 AS "INSE_VALOR_ABSOLUTO_2019" FROM nation),
linked AS (
  SELECT a.* EXCLUDE ("CATEG_E", "UAC"), '35' || substr(right('00000000' || e."CIE_ESCOLA", 8), 3) AS "CIE_ESCOLA",
         "FORMACAO_1", "FORMACAO_2", "FORMACAO_3", "FORMACAO_4", "FORMACAO_5", "NIVEL_FORMACAO_RANK", "NIVEL_FORMACAO",
         b.* EXCLUDE ("YEAR", "DATE", "ID_INTERNO", "UAC", "CIE_ESCOLA")
  FROM active a
  JOIN education e ON e."ID_INTERNO" = a."ID_INTERNO" AND e."YEAR" = a."YEAR" AND e."DATE" = a."DATE" AND e."UAC" = a."UAC"
  LEFT JOIN absences b ON b."ID_INTERNO" = a."ID_INTERNO" AND b."YEAR" = a."YEAR" AND b."DATE" = a."DATE" AND b."UAC" = a."UAC"),
teachers AS (
  SELECT l.* REPLACE (
           coalesce("TT_DIAS_FALTA_MEDICA", 0) AS "TT_DIAS_FALTA_MEDICA", coalesce("TT_DIAS_FALTA_JUST", 0) AS "TT_DIAS_FALTA_JUST",
           coalesce("TT_DIAS_FALTA_INJUST", 0) AS "TT_DIAS_FALTA_INJUST", coalesce("TT_DIAS_LIC_PREMIO", 0) AS "TT_DIAS_LIC_PREMIO",
           coalesce("TT_DIAS_LIC_GESTANTE", 0) AS "TT_DIAS_LIC_GESTANTE", coalesce("TT_DIAS_LIC_ACID_TRAB", 0) AS "TT_DIAS_LIC_ACID_TRAB",
           coalesce("TT_DIAS_LIC_INTER_PARTIC", 0) AS "TT_DIAS_LIC_INTER_PARTIC", coalesce("TOT_DIAS_AUSENCIAS", 0) AS "TOT_DIAS_AUSENCIAS",
           CAST(day(last_day(strptime('01' || l."DATE", '%d%m%y'))) AS INTEGER) AS "TOTAL_DIAS_MES"),
         coalesce("TOT_DIAS_AUSENCIAS", 0) / day(last_day(strptime('01' || l."DATE", '%d%m%y'))) AS "ABS_RATE",
         d.* EXCLUDE ("YEAR", "CIE_ESCOLA"), c.* EXCLUDE ("YEAR", "CIE_ESCOLA"), "INSE_VALOR_ABSOLUTO_2019"
  FROM linked l JOIN dropout d ON d."CIE_ESCOLA" = l."CIE_ESCOLA" AND d."YEAR" = l."YEAR"
  JOIN census c ON c."CIE_ESCOLA" = l."CIE_ESCOLA" AND c."YEAR" = l."YEAR" JOIN idx ON idx."CIE_ESCOLA" = l."CIE_ESCOLA"),
school_panel AS (
  SELECT "YEAR", "CIE_ESCOLA", "CO_MUNICIPIO", "NO_CATEGORIA", count(DISTINCT "ID_INTERNO") AS n_prof,
         sum("TOT_DIAS_AUSENCIAS") AS dias_aus_totais, sum("TOT_DIAS_AUSENCIAS") / 365 AS dias_aus_medio_ano,
         sum("TOT_DIAS_AUSENCIAS") / count(DISTINCT "ID_INTERNO") AS dias_aus_por_prof,
         avg(CAST("TOT_DIAS_AUSENCIAS" >= 10 AS DOUBLE)) AS prop_prof_10dias, avg("ABS_RATE") AS abs_rate_medio,
         count(DISTINCT "ID_INTERNO") FILTER (WHERE "CATEG_corr" = 'Temporário') AS n_temp,
         count(DISTINCT "ID_INTERNO") FILTER (WHERE "CATEG_corr" = 'Efetivo') AS n_efet,
         avg(CAST("CATEG_corr" = 'Temporário' AS DOUBLE)) AS prop_temp, avg(CAST("CATEG_corr" = 'Efetivo' AS DOUBLE)) AS prop_efetivo,
         avg("IDADE") AS idade_media, avg("ANOS_ATIVIDADE") AS exp_media, avg(CAST("SEXO" = 'F' AS DOUBLE)) AS perc_prof_fem,
         avg(CAST("ID_COR" = 'P' AS DOUBLE)) AS perc_prof_pretos,
         avg(CAST("NIVEL_FORMACAO" = 'com ensino superior' AS DOUBLE)) AS perc_prof_ens_sup,
         avg(CAST("NIVEL_FORMACAO" = 'mestrado' AS DOUBLE)) AS perc_prof_mes,
         avg(CAST("NIVEL_FORMACAO" = 'doutorado' AS DOUBLE)) AS perc_prof_dou, avg(drop_mean) AS drop_mean,
         avg("QT_MAT_FUND_MED") AS qt_mat, avg("QT_MAT_BAS_PRETA") AS qt_mat_preta,
         avg("QT_MAT_BAS_PRETA") / avg("QT_MAT_FUND_MED") AS per_alu_pretos, avg("INSE_VALOR_ABSOLUTO_2019") AS inse
  FROM teachers GROUP BY 1, 2, 3, 4)
SELECT * REPLACE (round(dias_aus_medio_ano, 4) AS dias_aus_medio_ano, round(dias_aus_por_prof, 4) AS dias_aus_por_prof, round(prop_prof_10dias, 4) AS prop_prof_10dias, round(abs_rate_medio, 4) AS abs_rate_medio, round(prop_temp, 4) AS prop_temp, round(prop_efetivo, 4) AS prop_efetivo, round(idade_media, 4) AS idade_media, round(exp_media, 4) AS exp_media, round(perc_prof_fem, 4) AS perc_prof_fem, round(perc_prof_pretos, 4) AS perc_prof_pretos, round(perc_prof_ens_sup, 4) AS perc_prof_ens_sup, round(perc_prof_mes, 4) AS perc_prof_mes, round(perc_prof_dou, 4) AS perc_prof_dou, round(drop_mean, 4) AS drop_mean, round(qt_mat, 4) AS qt_mat, round(qt_mat_preta, 4) AS qt_mat_preta, round(per_alu_pretos, 4) AS per_alu_pretos, round(inse, 4) AS inse)
FROM school_panel
