"""Scalar function families, each as one query over whole tables."""

from __future__ import annotations

from tessera.plans.relational import QUERIES as _all
from tessera.plans.relational import SQL as _sql
from tessera.plans.relational import both

_before = set(_all)

both("string_functions", """
SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, substring(p_name, 2, 4) AS sub, replace(p_brand, 'Brand', 'B') AS rep,
       lpad(CAST(p_size AS STRING), 4, '0') AS lp, rpad(p_brand, 12, '.') AS rp, reverse(p_type) AS rev, repeat('x', p_size % 4) AS r,
       instr(p_name, 'a') AS pos, left(p_type, 3) AS l3, right(p_type, 2) AS r2, levenshtein(p_name, p_brand) AS lev, ascii(p_type) AS asc_,
       split_part(p_name, ' ', 1) AS first_word, concat_ws('-', p_brand, p_type) AS joined, md5(p_name) AS m, translate(p_name, 'aeiou', 'AEIOU') AS tr,
       starts_with(p_type, 'S') AS st, p_name LIKE '%e%' AS has_e, trim(concat('  ', p_brand, ' ')) AS tm
FROM {part}""".replace("starts_with", "startswith"), "part", """
SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, substring(p_name, 2, 4) AS sub, replace(p_brand, 'Brand', 'B') AS rep,
       lpad(CAST(p_size AS VARCHAR), 4, '0') AS lp, rpad(p_brand, 12, '.') AS rp, reverse(p_type) AS rev, repeat('x', p_size % 4) AS r,
       instr(p_name, 'a') AS pos, left(p_type, 3) AS l3, right(p_type, 2) AS r2, levenshtein(p_name, p_brand) AS lev, ascii(p_type) AS asc_,
       split_part(p_name, ' ', 1) AS first_word, concat_ws('-', p_brand, p_type) AS joined, md5(p_name) AS m, translate(p_name, 'aeiou', 'AEIOU') AS tr,
       starts_with(p_type, 'S') AS st, p_name LIKE '%e%' AS has_e, trim(concat('  ', p_brand, ' ')) AS tm
FROM {part}""")
both("pattern_functions", """
SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word, regexp_count(text, '[0-9]+') AS n_numbers, size(regexp_extract_all(text, '[A-Z][a-z]+', 0)) AS n_capital,
       length(regexp_replace(text, '[^a-z]', '')) AS n_lower, size(split(text, '\\n')) AS n_lines, text RLIKE 'password|token' AS has_secret
FROM {documents}""".replace("\\\\n", "\\n"), "documents", """
SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word, len(regexp_extract_all(text, '[0-9]+'))::INT AS n_numbers, len(regexp_extract_all(text, '[A-Z][a-z]+'))::INT AS n_capital,
       length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower, len(string_split(text, chr(10)))::INT AS n_lines, regexp_matches(text, 'password|token') AS has_secret
FROM {documents}""")
both("date_functions", """
SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS w,
       dayofweek(o_orderdate) - 1 AS dow, CAST(last_day(o_orderdate) AS DATE) AS ld, date_add(CAST(o_orderdate AS DATE), 45) AS later, datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01') AS days,
       CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS tm, date_format(o_orderdate, 'yyyy/MM/dd') AS f, add_months(CAST(o_orderdate AS DATE), 1) AS am
FROM {orders}""", "orders", """
SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS w,
       dayofweek(o_orderdate) AS dow, last_day(o_orderdate) AS ld, (o_orderdate::DATE + 45) AS later, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS days,
       date_trunc('month', o_orderdate)::DATE AS tm, strftime(o_orderdate, '%Y/%m/%d') AS f, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS am
FROM {orders}""")
both("time_functions", """
SELECT event_id, hour(ts) AS h, minute(ts) AS mi, CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS th, unix_micros(CAST(ts AS TIMESTAMP)) AS us, ts + INTERVAL 90 MINUTES AS later
FROM {events}""", "events", "SELECT event_id, hour(ts) AS h, minute(ts) AS mi, date_trunc('hour', ts) AS th, epoch_us(ts) AS us, ts + INTERVAL 90 MINUTE AS later FROM {events}")
both("math_functions", """
SELECT l_orderkey, l_linenumber, l_extendedprice, abs(l_tax - 0.04) AS a, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, round(sqrt(l_quantity), 9) AS sq, round(ln(l_quantity), 9) AS lg,
       round(exp(l_discount), 9) AS ex, round(power(l_quantity, 1.5), 6) AS pw, round(sin(l_quantity), 9) AS sn, round(atan2(l_tax, l_discount + 1), 9) AS at, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le,
       bit_count(l_partkey) AS bc, l_partkey % 7 AS md, CAST(sign(l_tax - 0.04) AS INT) AS sg, round(degrees(l_discount), 6) AS dg, try_divide(l_quantity, l_linenumber - 3) AS td
FROM {lineitem}""", "lineitem", """
SELECT l_orderkey, l_linenumber, l_extendedprice, abs(l_tax - 0.04) AS a, ceil(l_extendedprice)::BIGINT AS c, floor(l_extendedprice)::BIGINT AS f, round(sqrt(l_quantity), 9) AS sq, round(ln(l_quantity), 9) AS lg,
       round(exp(l_discount), 9) AS ex, round(power(l_quantity, 1.5), 6) AS pw, round(sin(l_quantity), 9) AS sn, round(atan2(l_tax, l_discount + 1), 9) AS at, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le,
       bit_count(l_partkey)::INT AS bc, l_partkey % 7 AS md, sign(l_tax - 0.04)::INT AS sg, round(degrees(l_discount), 6) AS dg, CASE WHEN l_linenumber <> 3 THEN l_quantity / (l_linenumber - 3) END AS td
FROM {lineitem}""")
both("array_functions", """
SELECT o_custkey, array_join(transform(keys, k -> CAST(k AS STRING)), ',') AS all_keys, size(keys) AS n, array_max(keys) AS mx, array_min(keys) AS mn, element_at(keys, 1) AS f, array_contains(keys, 10) AS has10,
       size(filter(keys, k -> k % 2 = 0)) AS evens, aggregate(keys, CAST(0 AS BIGINT), (a, k) -> a + k) AS total, array_join(transform(slice(keys, 1, 2), k -> CAST(k * 2 AS STRING)), '|') AS doubled, exists(keys, k -> k > 1000) AS big
FROM (SELECT o_custkey, array_sort(collect_list(o_orderkey)) AS keys FROM {orders} GROUP BY o_custkey)""", "orders", """
SELECT o_custkey, array_to_string(keys, ',') AS all_keys, len(keys)::INT AS n, list_max(keys) AS mx, list_min(keys) AS mn, keys[1] AS f, list_contains(keys, 10) AS has10,
       len(list_filter(keys, lambda k: k % 2 = 0))::INT AS evens, list_sum(keys)::BIGINT AS total, array_to_string(list_transform(keys[1:2], lambda k: k * 2), '|') AS doubled, list_max(keys) > 1000 AS big
FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM {orders} GROUP BY o_custkey)""")
both("map_struct_functions", """
SELECT c_custkey, m['seg'] AS seg, size(map_keys(m)) AS n, s.a AS a, element_at(map_filter(m, (k, v) -> k = 'nat'), 'nat') AS nat, array_join(array_sort(map_keys(m)), ',') AS ks
FROM (SELECT c_custkey, map('seg', c_mktsegment, 'nat', CAST(c_nationkey AS STRING)) AS m, named_struct('a', c_nationkey + 1, 'b', c_name) AS s FROM {customer})""", "customer",
     "SELECT c_custkey, c_mktsegment AS seg, 2 AS n, c_nationkey + 1 AS a, CAST(c_nationkey AS VARCHAR) AS nat, 'nat,seg' AS ks FROM {customer}")
both("json_round_trip", "SELECT event_id, from_json(props, 'k INT').k AS k, json_array_length(concat('[', props, ',1]')) AS n, get_json_object(to_json(named_struct('v', event_type)), '$.v') AS v FROM {events}", "events",
     "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 2 AS n, event_type AS v FROM {events}")
both("explode_words", "SELECT lang, word, count(*) AS n FROM (SELECT lang, explode(split(text, ' ')) AS word FROM {documents}) WHERE length(word) = 2 GROUP BY lang, word", "documents",
     "SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM {documents}) WHERE length(word) = 2 GROUP BY lang, word")

QUERIES = {k: _all[k] for k in _all if k not in _before}
SQL = {k: _sql[k] for k in QUERIES}
