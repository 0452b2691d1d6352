"""More function families, query syntax and aggregates, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.relational import QUERIES as _all
from tessera.plans.relational import SQL as _sql
from tessera.plans.relational import both, query
from tessera.sources.tables import read_table

_before = set(_all)

both("pipe_syntax", "FROM {orders} |> WHERE o_orderstatus <> 'P' |> EXTEND year(o_orderdate) AS y |> AGGREGATE count(*) AS n, round(sum(o_totalprice), 2) AS total GROUP BY y, o_orderpriority |> WHERE n > 0", "orders",
     "SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY ALL")
both("group_by_all", "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS q FROM {lineitem} GROUP BY ALL", "lineitem")
both("string_functions_more", """
SELECT p_partkey, substring_index(p_name, ' ', 1) AS si, sha2(p_name, 256) AS sh, hex(p_name) AS hx, base64(CAST(p_name AS BINARY)) AS b64, octet_length(p_name) AS ol, bit_length(p_name) AS bl,
       find_in_set(substring(p_brand, 7, 1), '5,3,1') AS fs, ltrim(concat('  ', p_name)) AS lt, rtrim(concat(p_name, '  ')) AS rt, btrim(concat(' ', p_name, ' ')) AS bt,
       regexp_replace(p_name, '([a-z])([a-z])', '$2$1') AS sw, regexp_substr(p_name, '[aeiou][aeiou]') AS vs, regexp_like(p_name, '^[a-m]') AS rl, position('a' IN p_name) AS po, locate('e', p_name) AS lo,
       overlay(p_name PLACING '##' FROM 2 FOR 2) AS ov, char(65 + p_size % 26) AS ch, contains(p_name, 'e') AS ce, endswith(p_type, 'S') AS es, p_name ILIKE '%A%' AS il, lower(p_type) AS lw,
       format_string('%05d|%s', p_partkey, p_brand) AS fm, nullif(p_brand, 'Brand#11') AS nb, concat(p_brand, p_type) AS cc, CAST(unhex(hex(p_type)) AS STRING) AS un
FROM {part}""", "part", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS si, sha256(p_name) AS sh, hex(p_name) AS hx, base64(encode(p_name)) AS b64, strlen(p_name)::INT AS ol, bit_length(p_name)::INT AS bl,
       coalesce(list_position(['5', '3', '1'], substring(p_brand, 7, 1)), 0)::INT AS fs, p_name AS lt, p_name AS rt, p_name AS bt,
       regexp_replace(p_name, '([a-z])([a-z])', '\\2\\1', 'g') AS sw, nullif(regexp_extract(p_name, '[aeiou][aeiou]'), '') AS vs, regexp_matches(p_name, '^[a-m]') AS rl, position('a' IN p_name)::INT AS po, instr(p_name, 'e')::INT AS lo,
       left(p_name, 1) || '##' || substring(p_name, 4) AS ov, chr(65 + p_size % 26) AS ch, contains(p_name, 'e') AS ce, ends_with(p_type, 'S') AS es, p_name ILIKE '%A%' AS il, lower(p_type) AS lw,
       printf('%05d|%s', p_partkey, p_brand) AS fm, nullif(p_brand, 'Brand#11') AS nb, concat(p_brand, p_type) AS cc, p_type AS un
FROM {part}""")
both("date_functions_more", """
SELECT o_orderkey, to_date(date_format(o_orderdate, 'yyyy-MM-dd')) AS td, make_date(year(o_orderdate), month(o_orderdate), 1) AS md, next_day(CAST(o_orderdate AS DATE), 'MON') AS nd, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn,
       weekday(o_orderdate) AS wd, CAST(extract(WEEK FROM o_orderdate) AS INT) AS wk, date_sub(CAST(o_orderdate AS DATE), 10) AS ds, CAST(months_between(trunc(CAST(o_orderdate AS DATE), 'MM'), DATE'1995-01-01') AS INT) AS mb,
       unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS ut, CAST(timestamp_seconds(86400 * o_custkey) AS TIMESTAMP_NTZ) AS ts, to_timestamp_ntz(concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 01:02:03')) AS tn,
       timestampdiff(HOUR, TIMESTAMP_NTZ'1995-01-01 00:00:00', o_orderdate) AS th, CAST(date_trunc('QUARTER', o_orderdate) AS DATE) AS tq, CAST(date_trunc('WEEK', o_orderdate) AS DATE) AS tw, o_orderdate + make_dt_interval(1, 2, 3) AS di, add_months(DATE'1996-01-31', o_custkey % 12) AS am
FROM {orders}""", "orders", """
SELECT o_orderkey, o_orderdate::DATE AS td, make_date(year(o_orderdate), month(o_orderdate), 1) AS md, (o_orderdate::DATE + (8 - isodow(o_orderdate))::INT) AS nd, left(dayname(o_orderdate), 3) AS dn, left(monthname(o_orderdate), 3) AS mn,
       (isodow(o_orderdate) - 1)::INT AS wd, week(o_orderdate)::INT AS wk, (o_orderdate::DATE - 10) AS ds, datediff('month', DATE '1995-01-01', o_orderdate)::INT AS mb,
       epoch(o_orderdate)::BIGINT AS ut, make_timestamp(86400000000 * o_custkey) AS ts, (o_orderdate::DATE + INTERVAL '1 hour 2 minutes 3 seconds') AS tn,
       datediff('hour', TIMESTAMP '1995-01-01', o_orderdate) AS th, date_trunc('quarter', o_orderdate)::DATE AS tq, date_trunc('week', o_orderdate)::DATE AS tw, o_orderdate + INTERVAL '1 day 2 hours 3 minutes' AS di, (DATE '1996-01-31' + to_months((o_custkey % 12)::INT))::DATE AS am
FROM {orders}""")
both("math_functions_more", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(cbrt(l_quantity), 9) AS cb, round(log10(l_quantity), 9) AS lt, round(log2(l_quantity), 9) AS l2, round(cos(l_quantity), 9) AS co, round(tan(l_tax), 9) AS tn, round(asin(l_tax), 9) AS an, round(acos(l_tax), 9) AS ac,
       round(atan(l_quantity), 9) AS at, round(sinh(l_tax), 9) AS sh, round(cosh(l_tax), 9) AS ch, round(tanh(l_tax), 9) AS th, round(radians(l_quantity), 9) AS ra, round(cot(l_quantity), 6) AS ct, factorial(l_linenumber) AS fa, pmod(l_linenumber - 5, 3) AS pm,
       l_partkey & 255 AS ba, l_partkey | 7 AS bo, l_partkey ^ l_suppkey AS bx, shiftleft(l_partkey, 3) AS sl, shiftright(l_partkey, 2) AS sr, bin(l_linenumber) AS bi, conv(CAST(l_partkey AS STRING), 10, 16) AS cv, width_bucket(l_quantity, 0, 50, 5) AS wb,
       hypot(l_linenumber, 0) AS hy, try_add(l_partkey, 1) AS ta, try_subtract(l_partkey, 1) AS tb, try_multiply(l_partkey, 2L) AS tm, positive(l_tax) AS po, negative(l_linenumber) AS ne, nanvl(l_tax, 0.0D) AS nv
FROM {lineitem}""", "lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(cbrt(l_quantity), 9) AS cb, round(log10(l_quantity), 9) AS lt, round(log2(l_quantity), 9) AS l2, round(cos(l_quantity), 9) AS co, round(tan(l_tax), 9) AS tn, round(asin(l_tax), 9) AS an, round(acos(l_tax), 9) AS ac,
       round(atan(l_quantity), 9) AS at, round(sinh(l_tax), 9) AS sh, round(cosh(l_tax), 9) AS ch, round(tanh(l_tax), 9) AS th, round(radians(l_quantity), 9) AS ra, round(cot(l_quantity), 6) AS ct, factorial(l_linenumber)::BIGINT AS fa, (((l_linenumber - 5) % 3) + 3) % 3 AS pm,
       l_partkey & 255 AS ba, l_partkey | 7 AS bo, xor(l_partkey, l_suppkey) AS bx, l_partkey << 3 AS sl, l_partkey >> 2 AS sr, bin(l_linenumber) AS bi, to_base(l_partkey, 16) AS cv, (floor(l_quantity / 10) + 1)::BIGINT AS wb,
       l_linenumber::DOUBLE AS hy, l_partkey + 1 AS ta, l_partkey - 1 AS tb, l_partkey * 2 AS tm, l_tax AS po, -l_linenumber AS ne, l_tax AS nv
FROM {lineitem}""")
both("array_functions_more", """
SELECT o_custkey, array_join(sort_array(keys, false), ',') AS de, size(flatten(array(keys, keys))) AS fl, array_join(array_sort(array_union(keys, array(1L, 2L))), ',') AS un, array_join(array_except(keys, array(keys[0])), ',') AS ex,
       array_join(array_intersect(keys, slice(keys, 1, 2)), ',') AS it, array_position(keys, keys[size(keys) div 2]) AS po, array_join(array_repeat('x', size(keys)), '') AS re, array_join(sequence(1, size(keys)), ',') AS se, array_join(array_append(keys, 0L), ',') AS ap,
       array_join(array_prepend(keys, 0L), ',') AS pr, array_join(array_remove(keys, keys[0]), ',') AS rm, arrays_overlap(keys, array(10 * o_custkey, 10 * o_custkey + 1)) AS ov, array_join(zip_with(keys, keys, (a, b) -> a + b), ',') AS zw, forall(keys, k -> k % 7 <> 3) AS fa,
       array_join(reverse(keys), ',') AS rv, array_join(concat(keys, keys), ',') AS co, array_join(transform(arrays_zip(keys, reverse(keys)), s -> s['keys'] - s['1']), ',') AS az, try_element_at(keys, 1000) AS te, array_join(array_distinct(concat(keys, keys)), ',') AS di,
       array_join(array_insert(keys, 1, 9L), ',') AS ai, size(array_compact(transform(keys, k -> nullif(k % 3, 0)))) AS ac, cardinality(keys) AS ca
FROM (SELECT o_custkey, array_sort(collect_list(o_orderkey)) AS keys FROM {orders} GROUP BY o_custkey)""", "orders", """
SELECT o_custkey, array_to_string(list_reverse_sort(keys), ',') AS de, (2 * len(keys))::INT AS fl, array_to_string(list_sort(list_distinct(keys || [1, 2])), ',') AS un, array_to_string(list_filter(keys, lambda k: k <> keys[1]), ',') AS ex,
       array_to_string(keys[1:2], ',') AS it, list_position(keys, keys[len(keys) // 2 + 1])::BIGINT AS po, repeat('x', len(keys)) AS re, array_to_string(generate_series(1, len(keys)), ',') AS se, array_to_string(list_append(keys, 0), ',') AS ap,
       array_to_string(list_prepend(0, keys), ',') AS pr, array_to_string(keys[2:], ',') AS rm, list_has_any(keys, [10 * o_custkey, 10 * o_custkey + 1]) AS ov, array_to_string(list_transform(keys, lambda k: 2 * k), ',') AS zw, len(list_filter(keys, lambda k: k % 7 = 3)) = 0 AS fa,
       array_to_string(list_reverse(keys), ',') AS rv, array_to_string(keys || keys, ',') AS co, array_to_string(list_transform(list_zip(keys, list_reverse(keys)), lambda z: z[1] - z[2]), ',') AS az, keys[1000] AS te, array_to_string(keys, ',') AS di,
       array_to_string(list_prepend(9, keys), ',') AS ai, len(list_filter(keys, lambda k: k % 3 <> 0))::INT AS ac, len(keys)::INT AS ca
FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM {orders} GROUP BY o_custkey)""")
both("posexploded_keys", "SELECT o_custkey, pos, k FROM (SELECT o_custkey, posexplode(array_sort(collect_list(o_orderkey))) AS (pos, k) FROM {orders} GROUP BY o_custkey)", "orders",
     "SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS pos, o_orderkey AS k FROM {orders}")
both("map_functions_more", """
SELECT c_custkey, map_concat(m, map('x', c_name))['x'] AS mc, transform_values(m, (k, v) -> concat(v, '!'))['seg'] AS tv, transform_keys(m, (k, v) -> upper(k))['SEG'] AS tk, map_from_arrays(array('a', 'b'), array(c_nationkey, 2))['a'] AS fa,
       array_join(transform(array_sort(map_entries(m)), e -> concat(e.key, '=', e.value)), ';') AS en, map_contains_key(m, if(c_nationkey % 2 = 0, 'nat', 'none')) AS ck, str_to_map(concat('k:', c_mktsegment), ',', ':')['k'] AS sm, map_zip_with(m, m, (k, a, b) -> concat(a, b))['nat'] AS mz,
       map_from_entries(array(struct('p', c_name)))['p'] AS fe, array_join(array_sort(map_values(m)), '|') AS vs
FROM (SELECT *, map('seg', c_mktsegment, 'nat', CAST(c_nationkey AS STRING)) AS m FROM {customer})""", "customer", """
SELECT c_custkey, c_name AS mc, c_mktsegment || '!' AS tv, c_mktsegment AS tk, c_nationkey AS fa, 'nat=' || c_nationkey || ';seg=' || c_mktsegment AS en, c_nationkey % 2 = 0 AS ck, c_mktsegment AS sm, c_nationkey::VARCHAR || c_nationkey AS mz, c_name AS fe,
       array_to_string(list_sort([c_mktsegment, c_nationkey::VARCHAR]), '|') AS vs
FROM {customer}""")
both("semi_structured", """
SELECT event_id, from_csv(to_csv(named_struct('a', user_id, 'b', event_type)), 'a BIGINT, b STRING').b AS cb, from_xml(concat('<r><u>', user_id, '</u></r>'), 'u BIGINT').u AS xu, xpath_string(concat('<r><t>', event_type, '</t></r>'), 'r/t') AS xp,
       variant_get(parse_json(props), '$.k', 'int') AS vk, json_object_keys(props)[0] AS jk, try_variant_get(parse_json(props), '$.none', 'int') AS vn, variant_get(to_variant_object(named_struct('q', user_id)), '$.q', 'bigint') AS vq, get_json_object(props, if(event_id % 2 = 0, '$.k', '$.none')) AS jn
FROM {events}""", "events", "SELECT event_id, event_type AS cb, user_id AS xu, event_type AS xp, json_extract_string(props, '$.k')::INT AS vk, 'k' AS jk, NULL::INT AS vn, user_id AS vq, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS jn FROM {events}")
both("json_tuples", "SELECT event_id, t.k FROM {events} LATERAL VIEW json_tuple(props, 'k') t AS k", "events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}")
both("conditional_functions", """
SELECT o_orderkey, nvl(nullif(o_orderstatus, 'F'), 'none') AS nv, nvl2(nullif(o_orderstatus, 'F'), 'set', 'unset') AS n2, ifnull(nullif(o_orderpriority, '1-URGENT'), '?') AS ifn, zeroifnull(nullif(o_custkey, 1L)) AS z, nullifzero(o_custkey % 2) AS nz, isnull(nullif(o_orderstatus, 'O')) AS isn,
       isnotnull(nullif(o_custkey % 3, 0)) AS nn, equal_null(nullif(o_orderstatus, 'P'), NULL) AS en, if(o_totalprice > 1000, 'big', 'small') AS i, coalesce(NULL, o_orderstatus) AS c, typeof(o_orderkey) AS ty, decode(o_orderstatus, 'F', 'final', 'O', 'open', 'other') AS d
FROM {orders}""", "orders", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS nv, CASE WHEN o_orderstatus <> 'F' THEN 'set' ELSE 'unset' END AS n2, coalesce(nullif(o_orderpriority, '1-URGENT'), '?') AS ifn, CASE WHEN o_custkey = 1 THEN 0 ELSE o_custkey END AS z, nullif(o_custkey % 2, 0) AS nz, o_orderstatus = 'O' AS isn,
       o_custkey % 3 <> 0 AS nn, o_orderstatus = 'P' AS en, CASE WHEN o_totalprice > 1000 THEN 'big' ELSE 'small' END AS i, o_orderstatus AS c, 'bigint' AS ty, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS d
FROM {orders}""")
both("collected_values", """
SELECT o_orderpriority, array_join(array_sort(collect_set(o_orderstatus)), ',') AS statuses, array_join(array_sort(collect_list(o_custkey % 3)), '') AS thirds, listagg(DISTINCT o_orderstatus, '|') WITHIN GROUP (ORDER BY o_orderstatus) AS la, bit_and(o_custkey) AS ba, bit_or(o_custkey) AS bo,
       bool_or(o_totalprice > 400000) AS bo2, count_if(o_orderstatus = 'F') AS ci, every(o_totalprice > 0) AS ev, mode(o_orderstatus) IS NOT NULL AS mo, try_sum(o_custkey) AS ts, max(struct(o_totalprice, o_orderkey)).o_orderkey AS top
FROM {orders} GROUP BY o_orderpriority""", "orders", """
SELECT o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, array_to_string(list_sort(list(o_custkey % 3)), '') AS thirds, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS la, bit_and(o_custkey) AS ba, bit_or(o_custkey) AS bo,
       bool_or(o_totalprice > 400000) AS bo2, count_if(o_orderstatus = 'F')::BIGINT AS ci, bool_and(o_totalprice > 0) AS ev, mode(o_orderstatus) IS NOT NULL AS mo, sum(o_custkey)::BIGINT AS ts, max(struct_pack(p := o_totalprice, k := o_orderkey)).k AS top
FROM {orders} GROUP BY o_orderpriority""")
both("regressions", """
SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ic, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2,
       round(regr_sxx(l_extendedprice, l_quantity) / 1e6, 4) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1e9, 4) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1e12, 4) AS syy, round(covar_pop(l_quantity, l_tax), 8) AS cp, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs,
       round(percentile(l_quantity, 0.3), 6) AS p3
FROM {lineitem} GROUP BY l_returnflag""", "lineitem", """
SELECT l_returnflag, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ic, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2,
       round(regr_sxx(l_extendedprice, l_quantity) / 1e6, 4) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1e9, 4) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1e12, 4) AS syy, round(covar_pop(l_quantity, l_tax), 8) AS cp, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs,
       round(quantile_cont(l_quantity, 0.3), 6) AS p3
FROM {lineitem} GROUP BY l_returnflag""")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replaced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").replace({"F": "final", "O": "open"}, subset=["o_orderstatus"])


@query("SELECT l_shipdate::DATE AS d, l_returnflag, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((d, l_returnflag), (l_returnflag))")
def grouping_sets_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"), "l_returnflag")
    return lines.groupingSets([["d", "l_returnflag"], ["l_returnflag"]], "d", "l_returnflag").agg(F.count("*").alias("n"))


QUERIES = {k: _all[k] for k in _all if k not in _before}
SQL = {k: _sql[k] for k in QUERIES}
