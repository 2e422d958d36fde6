"""DuckDB SQL for the queries in queries.py, by name."""

ORACLE_SQL = {
    "scan_project_rename": 'select c_custkey as station_id, c_name as station, c_acctbal as water_level_m from customer',
    "unit_convert": 'select l_orderkey, l_linenumber, l_quantity as ec, l_quantity * cast(0.64 as double) as salinity from lineitem',
    "month_floor_and_part": "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month_start, cast(month(o_orderdate) as int) as month_num from orders",
    "exclude_by_substring": "select p_partkey, p_name from part where not (p_name like '%small%' or p_name like '%ring%')",
    "monthly_mean": (
        "select l_returnflag as station, cast(date_trunc('month', l_shipdate) as date) as month_start, cast(sum(cast(l_extendedprice as decimal(18,2))) as "
        'double) / count(l_extendedprice) as mean_value from lineitem group by 1, 2'
    ),
    "monthly_multi_agg": (
        "select l_returnflag as station, cast(date_trunc('month', l_shipdate) as date) as month_start, cast(sum(cast(l_quantity as decimal(18,2))) as double) "
        'as precipitation_sum, cast(sum(cast(l_discount as decimal(18,2))) as double) / count(l_discount) as temperature_mean, max(l_extendedprice) as '
        'temperature_max, min(l_extendedprice) as temperature_min from lineitem group by 1, 2'
    ),
    "sum_null_as_zero": (
        "select l_returnflag as station, coalesce(cast(sum(cast(case when l_returnflag = 'A' then null else l_quantity end as decimal(18,2))) as double), "
        '0.0e0) as total from lineitem group by 1'
    ),
    "group_drops_null_keys": "select k, count(*) as n from (select nullif(l_returnflag, 'A') as k from lineitem) t where k is not null group by k",
    "per_file_agg_then_union": (
        "select l_linestatus as src, l_returnflag as station, cast(date_trunc('month', l_shipdate) as date) as month_start, max(l_extendedprice) as v from "
        "lineitem where l_linestatus = 'F' group by 1, 2, 3 union all select l_linestatus, l_returnflag, cast(date_trunc('month', l_shipdate) as date), "
        "max(l_extendedprice) from lineitem where l_linestatus = 'O' group by 1, 2, 3"
    ),
    "mean_of_means": (
        "with per_file as (select l_linestatus as src, cast(date_trunc('month', l_shipdate) as date) as month_start, cast(sum(cast(l_quantity as "
        'decimal(18,2))) as double) / count(l_quantity) as m from lineitem group by 1, 2) select month_start, round(avg(m), 6) as discharge from per_file group '
        'by month_start'
    ),
    "outer_join_two_keys": (
        "with a as (select l_returnflag as station, cast(date_trunc('month', l_shipdate) as date) as month_start, max(l_quantity) as cond from lineitem group "
        "by 1, 2), b as (select o_orderstatus as station, cast(date_trunc('month', o_orderdate) as date) as month_start, max(o_totalprice) as meteo from orders "
        'group by 1, 2) select coalesce(a.station, b.station) as station, coalesce(a.month_start, b.month_start) as month_start, a.cond, b.meteo from a full '
        'outer join b on a.station = b.station and a.month_start = b.month_start'
    ),
    "outer_join_null_safe": (
        "with a as (select nullif(l_returnflag, 'A') as k, max(l_quantity) as x from lineitem group by 1), b as (select nullif(o_orderstatus, 'P') as k, "
        "max(o_totalprice) as y from orders group by 1) select coalesce(a.k, b.k) as k, a.x, b.y from a full outer join b on coalesce(a.k, '~') = coalesce(b.k, "
        "'~')"
    ),
    "outer_join_chain": (
        "with a as (select cast(date_trunc('month', l_shipdate) as date) as m, max(l_quantity) as cond from lineitem where l_shipdate < timestamp '1999-01-01 "
        "00:00:00' group by 1), b as (select cast(date_trunc('month', o_orderdate) as date) as m, max(o_totalprice) as meteo from orders group by 1), c as "
        "(select cast(date_trunc('month', ts) as date) as m, max(value) as water from events group by 1), d as (select cast(date_trunc('month', l_shipdate) as "
        "date) as m, min(l_extendedprice) as disch from lineitem where l_shipdate > timestamp '1997-06-15 00:00:00' group by 1), ab as (select coalesce(a.m, "
        'b.m) as m, cond, meteo from a full outer join b on a.m = b.m), abc as (select coalesce(ab.m, c.m) as m, cond, meteo, water from ab full outer join c '
        'on ab.m = c.m) select coalesce(abc.m, d.m) as month_start, cond, meteo, water, disch from abc full outer join d on abc.m = d.m'
    ),
    "missing_source_null_column": 'select n_name as station, cast(null as double) as water_level_m from nation',
    "lag_features": (
        "with m as (select cast(date_trunc('month', o_orderdate) as date) as d, count(*) as v from orders group by 1) select d, v, lag(v, 1) over (order by d) "
        'as v_lag_1, lag(v, 2) over (order by d) as v_lag_2, cast(month(d) as int) as month_num from m'
    ),
    "feature_pipeline": (
        "with q as (select cast(date_trunc('month', l_shipdate) as date) as d, cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(l_quantity) as "
        "discharge from lineitem group by 1), s as (select cast(date_trunc('month', o_orderdate) as date) as d, max(o_totalprice) as ec, max(o_totalprice) * "
        "cast(0.64 as double) as salinity from orders where o_orderstatus = 'F' group by 1), j as (select coalesce(q.d, s.d) as d, discharge, ec, salinity from "
        'q full outer join s on q.d = s.d), f as (select d, discharge, ec, salinity, lag(discharge, 1) over (order by d) as discharge_lag_1, lag(discharge, 2) '
        'over (order by d) as discharge_lag_2, lag(salinity, 1) over (order by d) as salinity_lag_1, cast(month(d) as int) as month_num from j) select * from f '
        'where discharge is not null and ec is not null and salinity is not null and discharge_lag_1 is not null and discharge_lag_2 is not null and '
        'salinity_lag_1 is not null'
    ),
    "date_range_report": (
        "select l_returnflag as station, min(cast(date_trunc('month', l_shipdate) as date)) as min_month, max(cast(date_trunc('month', l_shipdate) as date)) as "
        'max_month, count(l_shipdate) as n from lineitem group by 1'
    ),
    "bbox_range_join": (
        'select n.n_nationkey, s.s_suppkey from nation n join supplier s on s.s_suppkey between n.n_nationkey - 2 and n.n_nationkey + 2 and s.s_nationkey '
        'between n.n_regionkey - 2 and n.n_regionkey + 2'
    ),
    "nearest_target_topk": (
        "with c as (select n.n_nationkey, s.s_suppkey, case when lower(s.s_name) like '%7%' then 1 else 0 end as preferred, sqrt((s.s_suppkey - n.n_nationkey) "
        '* (s.s_suppkey - n.n_nationkey) * 1.0e0 + (s.s_nationkey - n.n_regionkey) * (s.s_nationkey - n.n_regionkey)) * 111 as dist_km from nation n cross join '
        'supplier s where s.s_acctbal > 0), r as (select *, row_number() over (partition by n_nationkey order by preferred desc, dist_km, s_suppkey) as rn from '
        'c) select n_nationkey, s_suppkey, round(dist_km, 6) as dist_km from r where rn = 1'
    ),
    "first_n_preview": 'select s_suppkey, s_name from supplier order by s_suppkey limit 15',
    "resume_anti_join": 'select o.o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)',
    "fallback_source": (
        "select o.o_orderkey, case when l.k is not null then 'consolidated' else 'intermediate' end as product_type from orders o left join (select distinct "
        'l_orderkey as k from lineitem where l_linenumber = 1) l on o.o_orderkey = l.k'
    ),
    "coalesce_falsy_id": 'select c_custkey, coalesce(nullif(c_nationkey, 0), cast(c_custkey as int)) as target_id from customer',
    "request_grid": (
        "select y, g.name, lpad(cast(m as varchar), 2, '0') as mm, lpad(cast(d as varchar), 2, '0') as dd, concat('glofas_', cast(y as varchar), '_', g.name, "
        "'.nc') as out_file from (select distinct cast(year(o_orderdate) as int) as y from orders) cross join (select name, unnest(ms) as m, lim from (values ('31days', "
        "[1,3,5,7,8,10,12], 31), ('30days', [4,6,9,11], 30), ('29days', [2], 29)) v(name, ms, lim)) g cross join lateral (select unnest(range(1, g.lim + 1)) as "
        'd)'
    ),
    "explode_cross_product": 'select vec_id, label, unnest(embedding) as x from embeddings',
    "json_field": "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
    "key_value_split": (
        "select page_id, trim(split_part(url, '=', 1)) as k, trim(substring(url, instr(url, '=') + 1)) as v from pages where instr(url, '=') > 0 and not "
        "starts_with(trim(url), '#')"
    ),
    "valid_combinations": "select distinct label as l, cast(floor(x * 10) as int) as x from (select label, cast(unnest(embedding) as double) as x from embeddings)",
    "spatial_mean_by_time": "select l_shipdate as time, cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(l_quantity) as value from lineitem group by 1",
    "first_and_last_date": "select cast(min(o_orderdate) as date) as first, cast(max(o_orderdate) as date) as last, count(*) as n from orders",
    "table_shapes": (
        "select 'nation' as name, (select count(*) from nation) as n_rows, cast(3 as int) as n_columns union all select 'region', (select count(*) from region), 2 "
        "union all select 'supplier', (select count(*) from supplier), 4"
    ),
    "stacked_sources": "select c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_name, s_acctbal, null from supplier",
    "target_or_nearest": (
        "with c as (select s_nationkey as k, min(s_suppkey) as id from supplier where s_acctbal < -900 group by 1), f as (select s_nationkey as k, min(s_suppkey) as id "
        "from supplier where s_acctbal > 9000 group by 1) select n_name as station, cast(coalesce(c.id, f.id) as int) as dahiti_id, case when c.id is not null then "
        "'chosen' else 'nearest' end as target_name from nation left join c on n_nationkey = c.k left join f on n_nationkey = f.k where coalesce(c.id, f.id) is not null"
    ),
    "csv_by_name": "select o_orderkey, o_orderstatus as station, cast(o_orderdate as date) as date, case when o_orderstatus <> 'P' then o_totalprice end as value from orders",
    "csv_quarantine": (
        "select o_orderkey, case when o_orderpriority <> '1-URGENT' then o_totalprice end as value, case when o_orderpriority = '1-URGENT' then o_orderkey || ',not read' end as line from orders"
    ),
    "named_file_round_trip": "select c_name, c_custkey, c_acctbal, 'waterlevel_nation_id' || c_nationkey || '.csv' as file from customer",
    "gridded_monthly_mean": (
        "with cells as (select l_returnflag as f, l_shipdate as t, l_linenumber, l_suppkey, max(l_quantity) as v from lineitem group by 1, 2, 3, 4), "
        "steps as (select f, t, avg(v) as v from cells where t >= timestamp '1994-03-10 00:00:00' and t < timestamp '1997-06-15 00:00:00' group by 1, 2), "
        "months as (select f, cast(date_trunc('month', t) as date) as month_start, avg(v) as v from steps group by 1, 2) "
        "select 'lines' as station, month_start, round(avg(v), 6) as mean_value from months group by month_start"
    ),
    "valid_requests": (
        "with c as (select c_custkey, c_nationkey as n, c_mktsegment as s, cast(floor(c_acctbal / 1000) as int) as b from customer) "
        "select c_custkey from c a where exists (select 1 from c r where r.n = a.n % 24 and r.s = a.s) and exists (select 1 from c r where r.n = a.n % 24 and r.b = a.b * 2 - 3)"
    ),
    "lags_by_range": (
        "select event_id, ts, value, lag(value, 1) over w as value_lag_1, lag(value, 2) over w as value_lag_2, lag(value, 7) over w as value_lag_7 "
        "from events window w as (order by ts nulls last, event_id)"
    ),
    "incremental_rollup": (
        "select o_orderpriority as station, cast(date_trunc('month', o_orderdate) as date) as month_start, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, "
        "cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice) as mean_value, max(o_totalprice) as highest, min(o_totalprice) as lowest, "
        "count(o_totalprice) as n from orders group by 1, 2"
    ),
    "public_targets": (
        "select cast(s_suppkey as int) as input_pos, cast(case when s_suppkey % 3 > 0 then s_suppkey else s_suppkey + 1000 end as int) as dahiti_id, "
        "case when s_nationkey > 5 then s_name else '' end as target_name, 'River' as type, case when s_nationkey > 3 then cast(s_nationkey as double) else 0.0e0 end as latitude, "
        "0.0e0 as longitude from supplier where s_acctbal > 2000"
    ),
    "outlier_flag": "select c_custkey, c_acctbal, coalesce(c_acctbal > 8000, false) as is_outlier from customer",
    "first_file": "select s_name, s_suppkey from supplier where s_nationkey = (select min(s_nationkey) from supplier)",
    "water_level_answers": (
        "select cast(user_id as varchar) as station, cast(user_id as int) as dahiti_id, 'user ' || user_id as target_name, '' as target_lat, value as water_level_m, "
        "cast(null as double) as water_level_err_m, cast(date_trunc('second', ts) as timestamp) as date from events where user_id % 7 <> 0"
    ),
}
