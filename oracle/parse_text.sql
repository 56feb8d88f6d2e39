SELECT o_orderkey,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed_day,
       CASE WHEN o_orderpriority <> '5-LOW' THEN round(o_totalprice, 2) END AS parsed_number
FROM orders
