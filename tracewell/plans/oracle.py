"""SQL that gives the same rows as the registered queries."""

from __future__ import annotations

_EVENTS = """
t0 AS (
  SELECT event_id + 1 AS vtime, CAST(floor(epoch(ts)) AS BIGINT) AS clock_time, user_id AS obj_id, greatest(1, CAST(floor(value) AS BIGINT)) AS obj_size,
         CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'gets' WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'invalid' END AS op,
         60 * k AS ttl, k % 8 AS ns
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""
_SKEW = _EVENTS.replace("user_id AS obj_id", "(user_id * 100 + k) % (1 + (event_id * 7919) % 1000) AS obj_id")
_ORDERS = """
t0 AS (
  SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS vtime, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS clock_time, o_custkey AS obj_id,
         greatest(1, CAST(floor(o_totalprice / 1000) AS BIGINT)) AS obj_size, 'get' AS op, NULL AS ttl, 0 AS ns FROM orders
)"""
_ANNOTATED = """,
t AS (SELECT *, clock_time - min(clock_time) OVER () AS t FROM t0),
l AS (
  SELECT *, lag(vtime) OVER w AS pv, lag(t) OVER w AS pt, lag(obj_size) OVER w AS ps, lead(vtime) OVER w AS nv, lead(op) OVER w AS nop,
         first_value(t) OVER w AS create_rtime, first_value(vtime) OVER w AS fv, first_value(obj_size) OVER w AS fs FROM t WINDOW w AS (PARTITION BY obj_id ORDER BY vtime)
),
a AS (
  SELECT *, pv IS NULL AS cold, coalesce(vtime - pv, -1) AS dv, coalesce(t - pt, -1) AS dt, pv IS NOT NULL AND op IN ('set', 'replace', 'cas') AS overwrite,
         pv IS NULL OR pt // 3600 <> t // 3600 AS seen_w FROM l
)"""


def sql(body: str, trace: str = "events") -> str:
    base = {"events": _EVENTS, "skew": _SKEW, "orders": _ORDERS}[trace]
    return f"WITH RECURSIVE {base}{_ANNOTATED}{body}"


_OBJ = ", o AS (SELECT obj_id, count(*) AS freq, arg_min(obj_size, vtime) AS first_size, min(t) AS create_t, max(t) AS last_t, sum(obj_size) AS bytes FROM a GROUP BY 1)"
_STACK = """, sd AS (
  SELECT i.vtime, i.obj_id, i.pv, i.nv, CASE WHEN i.pv IS NULL THEN -1 ELSE (SELECT count(*) FROM a j WHERE j.vtime > i.pv AND j.vtime < i.vtime AND coalesce(j.pv, 0) <= i.pv) END AS d FROM a i
)"""
#: Cells of objects in a sketch of m cells.
_CELLS = ", spread AS (SELECT DISTINCT o.obj_id, (h1 % m + k * (1 + h2 % (m - 1))) % m AS cell FROM (SELECT *, CAST('0x' || substr(md5(CAST(obj_id AS VARCHAR)), 1, 15) AS BIGINT) AS h1, CAST('0x' || substr(md5(CAST(obj_id AS VARCHAR)), 17, 15) AS BIGINT) AS h2 FROM o) o, size, range(0, {hashes}) z(k))"
_BLOOM_SIZE = ", size AS (SELECT CAST(greatest(2, ceil(-count(DISTINCT obj_id) * ln(0.05) / (ln(2.0) * ln(2.0)))) AS BIGINT) AS m FROM a WHERE {which})"
_IN_SAMPLE = "CAST('0x' || substr(md5(CAST(obj_id AS VARCHAR)), 1, 15) AS BIGINT) % 10 = 0"
_LOG = "CAST(greatest(floor(ln(greatest({0}, 1)) / ln(1.5)), 0) AS BIGINT)"
_REUSE_V = "CASE WHEN dv < 0 THEN -1 ELSE " + _LOG.format("dv") + " END"
_RATE = """, per AS (SELECT t // 3600 AS win, count(*) AS n, sum(obj_size) AS b, count(*) FILTER (seen_w) AS o, count(*) FILTER (cold) AS f FROM a GROUP BY 1),
spine AS (SELECT unnest(range(0, (SELECT max(t) // 3600 FROM a))) AS win),
rate AS (SELECT win, coalesce(n, 0) AS n_req, coalesce(n, 0) // 3600 AS req_rate, CAST(coalesce(b, 0) // 3600 AS BIGINT) AS byte_rate, coalesce(o, 0) // 3600 AS obj_rate, coalesce(f, 0) // 3600 AS first_seen_rate
  FROM spine LEFT JOIN per USING (win))"""
_DECAY = """, d AS (
  SELECT t // 86400 AS win, create_rtime // 86400 AS create_win, count(DISTINCT obj_id) AS n_obj FROM a
  WHERE t >= 86400 AND create_rtime >= 86400 AND t // 86400 < (SELECT max(t) // 86400 FROM a) GROUP BY 1, 2)"""
_RANKED = ", r AS (SELECT freq, row_number() OVER (ORDER BY freq DESC) AS rank FROM o)"
_ZIPF = _OBJ + _RANKED + " SELECT round(-regr_slope(ln(freq), ln(rank)), 6) AS alpha, round(regr_r2(ln(freq), ln(rank)), 6) AS r2, count(*) >= 200 AS fit_ok, max(freq) < 200 AS warn_low_freq FROM r"
_COUNTS = "count(*) AS n_req, count(*) FILTER (NOT hit) AS n_miss, round(avg(CASE WHEN hit THEN 0.0 ELSE 1.0 END), 6) AS miss_ratio, round(sum(CASE WHEN hit THEN 0 ELSE fs END) / sum(fs), 6) AS byte_miss_ratio"
_MRC = """, hist AS (SELECT d, count(*) AS n FROM sd GROUP BY 1), tot AS (SELECT sum(n) AS total, sum(n) FILTER (d < 0) AS cold FROM hist),
curve AS (SELECT c AS cache_size, round(1 - coalesce((SELECT sum(n) FROM hist WHERE d >= 0 AND d + 1 <= c), 0) / (SELECT total FROM tot), 6) AS miss_ratio FROM (SELECT unnest(range(0, (SELECT CAST(cold AS BIGINT) + 1 FROM tot))) AS c))"""


def lru_sql(policy: str, sizes: list[int], trace: str) -> str:
    """An LRU cache of c objects misses what is colder than c - 1 other objects."""
    grid = ", ".join(f"({c})" for c in sizes)
    return sql(f"{_STACK}, g AS (SELECT * FROM (VALUES {grid}) v(cache_size)), r AS (SELECT cache_size, d >= 0 AND d < cache_size AS hit, fs FROM sd JOIN a USING (vtime), g) SELECT '{policy}' AS policy, CAST(cache_size AS BIGINT) AS cache_size, {_COUNTS} FROM r GROUP BY 2", trace)


def byte_sql(overhead: int) -> str:
    """An LRU cache of c bytes holds what fits in with all objects since that fit in alone."""
    return sql(f"""{_OBJ}, g AS (SELECT greatest(1, CAST(floor(f * (SELECT sum(first_size) FROM o)) AS BIGINT)) AS c FROM (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE, 0.8::DOUBLE]) AS f) UNION ALL SELECT 40),
r0 AS (SELECT *, fs + {overhead} AS w FROM a),
r AS (SELECT c, i.fs, i.pv IS NOT NULL AND i.w <= c AND i.w + (SELECT coalesce(sum(j.w), 0) FROM r0 j WHERE j.w <= c AND j.vtime > i.pv AND j.vtime < i.vtime AND coalesce(j.pv, 0) <= i.pv) <= c AS hit FROM r0 i, g)
SELECT CAST(c AS BIGINT) AS cache_size, count(*) AS n_req, count(*) FILTER (NOT hit) AS n_miss, round(count(*) FILTER (NOT hit) / count(*), 6) AS miss_ratio, round(coalesce(sum(fs) FILTER (NOT hit), 0) / sum(fs), 6) AS byte_miss_ratio FROM r GROUP BY 1""", "skew")


#: Residencies: runs of hits after a miss; each ends at the request that brings the objects since its last access over the cache's size.
_HELD = """, r0 AS (SELECT *, {room} AS w FROM a WHERE {room} <= {size}),
m0 AS (SELECT i.*, i.pv IS NULL OR i.w + (SELECT coalesce(sum(j.w), 0) FROM r0 j WHERE j.vtime > i.pv AND j.vtime < i.vtime AND coalesce(j.pv, 0) <= i.pv) > {size} AS miss FROM r0 i),
m1 AS (SELECT *, count(*) FILTER (miss) OVER (PARTITION BY obj_id ORDER BY vtime) AS life FROM m0),
h0 AS (SELECT obj_id, life, min(vtime) AS from_vtime, max(vtime) AS last_vtime, count(*) AS n_access, any_value(w) AS room FROM m1 GROUP BY 1, 2),
h1 AS (SELECT h.obj_id, h.life, j.vtime, h.room + sum(j.w) OVER (PARTITION BY h.obj_id, h.life ORDER BY j.vtime) AS s FROM h0 h JOIN r0 j ON j.vtime > h.last_vtime AND coalesce(j.pv, 0) <= h.last_vtime AND j.obj_id <> h.obj_id),
held AS (SELECT h0.*, evicted_at FROM h0 LEFT JOIN (SELECT obj_id, life, min(vtime) AS evicted_at FROM h1 WHERE s > {size} GROUP BY 1, 2) e USING (obj_id, life))"""
_HELD_100 = _HELD.format(room="1", size=100)

ORACLE: dict[str, str] = {
    "annotate": sql(" SELECT vtime, obj_id, t, cold AS compulsory_miss, dv AS vtime_since_last, dt AS rtime_since_last, create_rtime, coalesce(ps, -1) AS prev_size, overwrite, seen_w AS first_seen_in_window FROM a"),
    "oracle_annotate": sql(" SELECT vtime, clock_time, obj_id, fs AS obj_size, coalesce(nv, -1) AS next_access_vtime FROM a"),
    "write_aware_next": sql(" SELECT vtime, obj_id, CASE WHEN nv IS NULL OR nop IN ('set', 'replace', 'cas', 'delete') THEN -1 ELSE nv END AS next_access_vtime FROM a"),
    "orders_trace": sql(" SELECT vtime, clock_time, obj_id, obj_size FROM t0", "orders"),
    "trace_stat": sql(_OBJ + " SELECT CAST(sum(freq) AS BIGINT) AS n_req, count(*) AS n_obj, CAST(sum(bytes) AS BIGINT) AS req_bytes, CAST(sum(first_size) AS BIGINT) AS obj_bytes, round(count(*) / sum(freq), 6) AS cold_miss_ratio, round(sum(first_size) / sum(bytes), 6) AS byte_cold_miss_ratio, CAST(floor(sum(bytes) / sum(freq)) AS BIGINT) AS mean_req_size, CAST(floor(sum(first_size) / count(*)) AS BIGINT) AS mean_obj_size, round(sum(freq) / count(*), 6) AS mean_freq, max(last_t) - min(create_t) AS time_span FROM o"),
    "x_hit": sql(_OBJ + ", h AS (SELECT freq, count(*) AS n FROM o GROUP BY 1) SELECT x AS freq, coalesce(n, 0) AS n_obj, round(coalesce(n, 0) / (SELECT count(*) FROM o), 6) AS ratio FROM (SELECT unnest(range(1, 9)) AS x) LEFT JOIN h ON h.freq = x", "skew"),
    "top_popular": sql(_OBJ + " SELECT obj_id, freq, round(freq / (SELECT count(*) FROM a), 6) AS ratio FROM o ORDER BY freq DESC, obj_id LIMIT 8", "skew"),
    "op_stat": sql(" SELECT op, count(*) AS cnt, count(*) FILTER (op IN ('set', 'replace', 'cas')) AS n_write, count(*) FILTER (overwrite) AS n_overwrite, count(*) FILTER (op = 'delete') AS n_delete, round(count(*) / (SELECT count(*) FROM a), 6) AS ratio FROM a GROUP BY 1"),
    "op_rollup": sql(" SELECT ns, op, count(*) AS cnt, CAST(sum(obj_size) AS BIGINT) AS bytes FROM a GROUP BY ROLLUP (ns, op)"),
    "req_rate": sql(_RATE + " SELECT * FROM rate"),
    "req_rate_shifted": sql(", s AS (SELECT coalesce(lag(t) OVER (ORDER BY vtime), 0) // 3600 AS win FROM a), h AS (SELECT win, count(*) AS n FROM s GROUP BY 1) SELECT x AS win, coalesce(n, 0) AS cnt FROM (SELECT unnest(range(0, (SELECT max(t) // 3600 FROM a))) AS x) LEFT JOIN h ON h.win = x"),
    "req_rate_trimmed": sql(_RATE + ", z AS (SELECT n_req, row_number() OVER (ORDER BY win) AS rn, count(*) OVER () AS n FROM rate) SELECT count(*) AS n_rows, count(*) FILTER (rn > 2 AND rn <= n - 1) AS n_kept, round(coalesce(avg(n_req) FILTER (rn > 2 AND rn <= n - 1), 0), 6) AS mean, round(coalesce(stddev_pop(n_req) FILTER (rn > 2 AND rn <= n - 1), 0), 6) AS std, round(coalesce(median(n_req), 0), 6) AS median FROM z"),
    "req_rate_summary": sql(_RATE + " SELECT count(*) AS n_windows, min(req_rate) AS min_req_rate, max(req_rate) AS max_req_rate, min(byte_rate) AS min_byte_rate, max(byte_rate) AS max_byte_rate, min(obj_rate) AS min_obj_rate, max(obj_rate) AS max_obj_rate, count(*) < 10 AS few_windows FROM rate"),
    "size_dist": sql(" SELECT obj_size AS size, count(*) AS n_req, count(*) FILTER (cold) AS n_obj FROM a GROUP BY 1"),
    "size_heatmap": sql(" SELECT t // 3600 AS win, " + _LOG.format("obj_size") + " AS bucket, count(*) AS n_req, count(*) FILTER (seen_w) AS n_obj FROM a GROUP BY 1, 2"),
    "reuse_rt": sql(" SELECT CASE WHEN dt < 0 THEN -1 ELSE dt // 5 END AS bucket, count(*) AS cnt FROM a GROUP BY 1"),
    "reuse_vt": sql(" SELECT " + _REUSE_V + " AS bucket, count(*) AS cnt FROM a GROUP BY 1"),
    "reuse_heatmap": sql(" SELECT t // 86400 AS win, 'rtime' AS kind, dt // 300 AS bucket, count(*) AS cnt FROM a WHERE NOT cold GROUP BY 1, 3 UNION ALL SELECT t // 86400, 'vtime', " + _REUSE_V + " AS b, count(*) FROM a WHERE NOT cold GROUP BY 1, 3"),
    "access_pattern": sql(" SELECT obj_id, fv AS first_vtime, vtime, t FROM a WHERE obj_id % 101 = 0"),
    "popularity": sql(_OBJ + " SELECT freq, count(*) AS n_obj FROM o GROUP BY 1", "skew"),
    "zipf_alpha": sql(_ZIPF, "skew"),
    "zipf_fit": sql(_ZIPF, "orders"),
    "popularity_decay": sql(_DECAY + " SELECT * FROM d"),
    "popularity_decay_norm": sql(_DECAY + " SELECT create_win, win - create_win AS age, round(n_obj / first_value(n_obj) OVER (PARTITION BY create_win ORDER BY win), 6) AS share FROM d", "skew"),
    "ttl_dist": sql(" SELECT ttl, count(*) AS cnt, count(*) > 0.01 * (SELECT count(*) FROM a) AS frequent FROM a WHERE ttl > 0 GROUP BY 1"),
    "lifetime": sql(", p AS (SELECT max(t) - min(t) AS rt, max(vtime) - min(vtime) AS vt FROM a WHERE create_rtime < 86400 GROUP BY obj_id) SELECT 'rtime' AS kind, rt // 10 * 10 AS bucket, count(*) AS cnt FROM p GROUP BY 2 UNION ALL SELECT 'vtime', vt // 100 * 100 AS b, count(*) FROM p GROUP BY 2"),
    "prob_at_age": sql(" SELECT greatest(dt, 0) // 86400 AS access_age, (t - create_rtime) // 86400 AS create_age, count(*) AS cnt FROM a WHERE t >= 86400 GROUP BY 1, 2"),
    "create_future_reuse": sql(", m AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY vtime) AS rn, t - create_rtime AS g FROM a WHERE create_rtime BETWEEN 86400 AND 172800) SELECT CASE WHEN g < 3600 THEN g ELSE g // 5 * 5 END AS age, nv IS NOT NULL AS reused, count(*) AS cnt, CAST(sum(rn) AS BIGINT) AS sum_freq, CAST(sum(greatest(dt, 0)) AS BIGINT) AS sum_access_age FROM m GROUP BY 1, 2", "skew"),
    "size_change": sql(", c AS (SELECT obj_size - ps AS d, ps FROM a WHERE overwrite) SELECT 'relative' AS kind, CAST(greatest(-10, least(20, floor(10 * d / ps))) AS BIGINT) AS bucket, count(*) AS cnt FROM c GROUP BY 2 UNION ALL SELECT 'absolute', CAST(sign(d) * CASE WHEN d = 0 THEN 0 ELSE 1 + floor(ln(abs(d)) / ln(2.0) + 1e-9) END AS BIGINT) AS b, count(*) FROM c GROUP BY 2"),
    "size_change_fine": sql(", c AS (SELECT obj_size - ps AS d, (obj_size - ps) / ps AS r FROM a WHERE overwrite), e AS (SELECT unnest([0.0001, 0.0002, 0.0005, 0.0008, 0.001, 0.002, 0.005, 0.008, 0.01, 0.02, 0.05, 0.08, 0.1]) AS edge), b AS (SELECT CAST(CASE WHEN d = 0 OR abs(r) < 0.00001 THEN 0 ELSE sign(d) * (1 + (SELECT count(*) FROM e WHERE CAST(edge AS DOUBLE) <= abs(r))) END AS BIGINT) AS bucket FROM c) SELECT bucket, count(*) AS cnt FROM b GROUP BY 1"),
    "write_future_reuse": sql(", f AS (SELECT *, count(*) FILTER (op IN ('get', 'gets', 'incr', 'decr')) OVER b AS reads, max(CASE WHEN op IN ('set', 'replace', 'delete') THEN vtime END) OVER b AS ev, max(CASE WHEN op IN ('get', 'gets', 'incr', 'decr') THEN vtime END) OVER b AS rv FROM a WINDOW b AS (PARTITION BY obj_id ORDER BY vtime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT f.*, f.t - e.t AS age0, f.op IN ('set', 'replace') AS put, f.reads - e.reads AS fr, CASE WHEN f.rv > f.ev THEN f.t - r.t ELSE 0 END AS ag FROM f JOIN f e ON e.vtime = f.ev AND e.op IN ('set', 'replace') LEFT JOIN f r ON r.vtime = f.rv) SELECT CASE WHEN age0 < 3600 THEN age0 ELSE age0 // 5 * 5 END AS age, op NOT IN ('set', 'replace', 'delete') AND coalesce(nop NOT IN ('set', 'replace', 'cas', 'delete'), false) AS reused, count(*) AS cnt, CAST(sum(CASE WHEN put THEN 0 ELSE fr END) AS BIGINT) AS sum_freq, CAST(sum(CASE WHEN put THEN 0 ELSE ag END) AS BIGINT) AS sum_access_age FROM g GROUP BY 1, 2", "skew"),
    "write_reuse": sql(", w AS (SELECT *, last_value(CASE WHEN op IN ('set', 'replace', 'cas') THEN t END IGNORE NULLS) OVER (PARTITION BY obj_id ORDER BY vtime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wrote FROM a) SELECT CASE WHEN op IN ('set', 'replace', 'cas') THEN 'overwrite' WHEN op = 'delete' THEN 'remove' ELSE 'read' END AS kind, (t - wrote) // 3600 AS bucket, count(*) AS cnt FROM w WHERE wrote IS NOT NULL GROUP BY 1, 2"),
    "hist_cdf": sql(_OBJ + ", h AS (SELECT freq, count(*) AS n FROM o GROUP BY 1) SELECT freq, round(sum(n) OVER (ORDER BY freq) / sum(n) OVER (), 6) AS cdf FROM h", "skew"),
    "one_hit_ratio": sql(", c AS (SELECT vtime, cold, CASE WHEN cold THEN 1 WHEN pv = fv THEN -1 ELSE 0 END AS ch FROM a), s AS (SELECT vtime, cold, sum(ch) OVER (ORDER BY vtime) AS ones, sum(CAST(cold AS INT)) OVER (ORDER BY vtime) AS n FROM c) SELECT CAST(n AS BIGINT) AS n_obj, vtime, round(ones / n, 6) AS ratio FROM s WHERE cold AND n % 100 = 0", "skew"),
    "obj_reuse_stat": sql(" SELECT obj_id, min(vtime) AS first_vtime, count(*) - 1 AS n_reuse, round((max(t) - min(t)) / greatest(count(*) - 1, 1), 6) AS mean_reuse_time FROM a GROUP BY 1"),
    "group_compare": sql(_OBJ + ", wd AS (SELECT max(create_t) // 16 + 1 AS w FROM o) SELECT 'created' AS kind, create_t // (SELECT w FROM wd) AS grp, count(*) AS cnt, round(avg(freq), 6) AS mean_freq, round(stddev_pop(freq), 6) AS std_freq FROM o GROUP BY 2 UNION ALL SELECT 'id', obj_id % 16 AS g, count(*), round(avg(freq), 6), round(stddev_pop(freq), 6) FROM o GROUP BY 2", "skew"),
    "dist_last_access": sql(" SELECT vtime, dv AS dist_last FROM a"),
    "dist_first_access": sql(" SELECT vtime, CASE WHEN cold THEN -1 ELSE vtime - fv END AS dist_first FROM a"),
    "dist_cnt": sql(" SELECT dv AS dist, count(*) AS cnt FROM a GROUP BY 1", "skew"),
    "stack_dist": sql(_STACK + " SELECT vtime, obj_id, d AS stack_dist FROM sd", "skew"),
    "future_stack_dist": sql(_STACK + " SELECT s.vtime, coalesce(n.d, -1) AS future_stack_dist FROM sd s LEFT JOIN sd n ON n.vtime = s.nv", "skew"),
    "lru_mrc": sql(_STACK + _MRC + " SELECT * FROM curve"),
    "lru_mrc_orders": sql(_STACK + _MRC + " SELECT * FROM curve", "orders"),
    "heatmap_stack_dist": sql(_STACK + " SELECT (vtime - 1) // 1000 AS interval, " + _LOG.format("d + 1") + " AS bucket, count(*) AS cnt FROM sd WHERE d >= 0 GROUP BY 1, 2", "skew"),
    "heatmap_hit_ratio_window": sql(_STACK + ", r AS (SELECT (vtime - 1) // ((SELECT max(vtime) + 9 FROM a) // 10) AS iv, (pv - 1) // ((SELECT max(vtime) + 9 FROM a) // 10) AS ip, d FROM sd), k AS (SELECT DISTINCT iv FROM r) SELECT s.iv AS start_interval, e.iv AS end_interval, round(count(*) FILTER (d >= 0 AND d < 100 AND ip >= s.iv) / count(*), 6) AS hit_ratio FROM k s JOIN k e ON e.iv >= s.iv JOIN r ON r.iv BETWEEN s.iv AND e.iv GROUP BY 1, 2", "skew"),
    "heatmap_hit_ratio_size": sql(_STACK + " SELECT c AS cache_size, (vtime - 1) // ((SELECT max(vtime) + 9 FROM a) // 10) AS interval, round(count(*) FILTER (d >= 0 AND d < c) / count(*), 6) AS hit_ratio FROM sd, range(0, 201, 20) z(c) GROUP BY 1, 2", "skew"),
    "heatmap_reuse_time": sql(" SELECT (vtime - 1) // 1000 AS interval, " + _LOG.format("dt + 1") + " AS bucket, count(*) AS cnt FROM a WHERE dt >= 0 GROUP BY 1, 2"),
    "wss": sql(_OBJ + " SELECT count(*) AS wss_obj, CAST(sum(first_size) AS BIGINT) AS wss_byte FROM o"),
    "sample_spatial": sql(" SELECT vtime, obj_id FROM t0 WHERE obj_id % 10 = 0"),
    "sample_temporal": sql(" SELECT vtime, obj_id FROM t0 WHERE vtime % 10 = 0"),
    "first_last": sql(" SELECT arg_min(obj_id, vtime) AS first_obj, arg_max(obj_id, vtime) AS last_obj, count(*) AS n_req FROM t0"),
    "seek_half": sql(" SELECT vtime, obj_id FROM t0 WHERE vtime > (SELECT max(vtime) // 2 FROM t0)"),
    "sim_lru": lru_sql("lru", [10, 50, 100], "events"),
    "adm_size": sql(f", r0 AS (SELECT vtime, obj_id, fs, row_number() OVER (ORDER BY vtime) AS v FROM a WHERE fs < 100), r1 AS (SELECT *, lag(v) OVER (PARTITION BY obj_id ORDER BY v) AS p FROM r0), sd AS (SELECT i.vtime, CASE WHEN i.p IS NULL THEN -1 ELSE (SELECT count(*) FROM r1 j WHERE j.v > i.p AND j.v < i.v AND coalesce(j.p, 0) <= i.p) END AS d FROM r1 i), g AS (SELECT * FROM (VALUES (10), (50), (100)) v(cache_size)), r AS (SELECT cache_size, coalesce(d >= 0 AND d < cache_size, false) AS hit, fs FROM a LEFT JOIN sd USING (vtime), g) SELECT 'lru' AS policy, CAST(cache_size AS BIGINT) AS cache_size, {_COUNTS} FROM r GROUP BY 2", "skew"),
    "adm_second": sql(f", r0 AS (SELECT vtime, obj_id, row_number() OVER (ORDER BY vtime) AS v FROM a WHERE pv IS NOT NULL), r1 AS (SELECT *, lag(v) OVER (PARTITION BY obj_id ORDER BY v) AS p FROM r0), sd AS (SELECT i.vtime, CASE WHEN i.p IS NULL THEN -1 ELSE (SELECT count(*) FROM r1 j WHERE j.v > i.p AND j.v < i.v AND coalesce(j.p, 0) <= i.p) END AS d FROM r1 i), g AS (SELECT * FROM (VALUES (10), (50), (100)) v(cache_size)), r AS (SELECT cache_size, coalesce(d >= 0 AND d < cache_size, false) AS hit, fs FROM a LEFT JOIN sd USING (vtime), g) SELECT 'lru' AS policy, CAST(cache_size AS BIGINT) AS cache_size, {_COUNTS} FROM r GROUP BY 2", "skew"),
    "lru_warmup": sql(f"{_STACK}, g AS (SELECT * FROM (VALUES (10), (50), (100)) v(cache_size)), r AS (SELECT cache_size, d >= 0 AND d < cache_size AS hit, fs FROM sd JOIN a USING (vtime), g WHERE vtime > (SELECT max(vtime) // 5 FROM a) AND t >= 172800) SELECT 'lru' AS policy, CAST(cache_size AS BIGINT) AS cache_size, {_COUNTS} FROM r GROUP BY 2", "skew"),
    "lru_mrc_bytes": byte_sql(0),
    "lru_mrc_bytes_overhead": byte_sql(16),
    "lru_residencies": sql(_HELD_100 + " SELECT obj_id, from_vtime, last_vtime, evicted_at, n_access FROM held", "skew"),
    "lru_residencies_bytes": sql(_HELD.format(room="(fs + 16)", size=5000) + " SELECT obj_id, from_vtime, last_vtime, evicted_at, n_access, room FROM held", "skew"),
    "eviction_statistics": sql(_HELD_100 + ", k AS (SELECT unnest([{'kind': 'age', 'bucket': CAST(ceil(ln(evicted_at - from_vtime) / ln(1.08)) AS BIGINT)}, {'kind': 'idle', 'bucket': CAST(ceil(ln(evicted_at - last_vtime) / ln(1.08)) AS BIGINT)}, {'kind': 'freq', 'bucket': n_access}]) AS k FROM held WHERE evicted_at IS NOT NULL) SELECT k.kind AS kind, k.bucket AS bucket, count(*) AS cnt FROM k GROUP BY 1, 2", "skew"),
    "cache_shares": sql(_HELD_100 + ", e AS (SELECT unnest(range(0, (SELECT (max(vtime) - 1) // 1000 + 1 FROM a))) AS interval), s AS (SELECT DISTINCT ns AS source FROM held JOIN t0 ON t0.vtime = from_vtime), x AS (SELECT interval, source, (SELECT CAST(coalesce(sum(room), 0) AS BIGINT) FROM held JOIN t0 ON t0.vtime = from_vtime WHERE ns = source AND from_vtime <= 1000 * (interval + 1) AND (evicted_at IS NULL OR evicted_at > 1000 * (interval + 1))) AS cached, (SELECT CAST(coalesce(sum(room), 0) AS BIGINT) FROM held JOIN t0 ON t0.vtime = from_vtime WHERE ns = source AND from_vtime <= 1000 * (interval + 1) AND last_vtime > 1000 * (interval + 1)) AS useful FROM e, s) SELECT interval, source, cached, useful, round(cached / nullif(sum(cached) OVER (PARTITION BY interval), 0), 6) AS share FROM x", "skew"),
    "lru_ttl": sql(_STACK + ", g AS (SELECT * FROM (VALUES (10), (50), (100)) v(c)), lv AS (SELECT c, vtime, obj_id, sum(CASE WHEN d < 0 OR d >= c THEN 1 ELSE 0 END) OVER (PARTITION BY c, obj_id ORDER BY vtime) AS life, d < 0 OR d >= c AS cold FROM sd, g), p AS (SELECT k.vtime, min(m.vtime) AS nx FROM a k JOIN a m ON m.obj_id = k.obj_id AND m.vtime > k.vtime AND m.t > k.t + 60 * k.ttl WHERE k.ttl > 0 GROUP BY 1), j AS (SELECT x.c, x.vtime, y.vtime AS nx FROM p JOIN lv x ON x.vtime = p.vtime JOIN lv y ON y.vtime = p.nx AND y.c = x.c AND y.life = x.life), reach AS (SELECT c, vtime FROM lv WHERE cold UNION SELECT j.c, j.nx FROM reach r JOIN j ON j.c = r.c AND j.vtime = r.vtime) SELECT CAST(c AS BIGINT) AS cache_size, n_req, n_miss, n_miss - n_cold AS n_expired, round(n_miss / n_req, 6) AS miss_ratio FROM (SELECT c, count(*) AS n_req, count(*) FILTER (cold) AS n_cold FROM lv GROUP BY 1) JOIN (SELECT c, count(*) AS n_miss FROM reach GROUP BY 1) USING (c)", "skew"),
    "prefetch_graph": sql(", e AS (SELECT x.obj_id, y.obj_id AS next_id, count(*) AS weight FROM a x, range(1, 21) z(k) JOIN a y ON y.vtime = x.vtime + k WHERE x.vtime + 20 <= (SELECT max(vtime) FROM a) GROUP BY 1, 2), s AS (SELECT obj_id, sum(weight) AS total FROM e GROUP BY 1) SELECT obj_id, next_id, weight, round(weight / total, 6) AS probability FROM e JOIN s USING (obj_id) WHERE 100 * weight > 5 * total", "skew"),
    "associations": sql(", o AS (SELECT obj_id, list(vtime ORDER BY vtime) AS ts, min(vtime) AS f, count(*) AS n FROM a GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8), p AS (SELECT x.obj_id, y.obj_id AS next_id, row_number() OVER (PARTITION BY x.obj_id ORDER BY y.f) AS rn, list_transform(range(2, least(x.n, y.n) + 1), lambda k: abs(x.ts[k] - y.ts[k])) AS gaps FROM o x JOIN o y ON y.f > x.f AND y.f <= x.f + 20 AND abs(x.n - y.n) <= 1), q AS (SELECT *, len(list_filter(gaps, lambda g: g > 20)) AS n_far FROM p) SELECT obj_id, next_id, n_far FROM q WHERE (rn = 1 OR list_contains(gaps, 1)) AND n_far <= 1", "skew"),
    "bloom_first_sightings": sql(_OBJ + _BLOOM_SIZE.format(which="true") + _CELLS.format(hashes=4) + ", f AS (SELECT obj_id, cell, fv FROM spread JOIN (SELECT DISTINCT obj_id, fv FROM a) USING (obj_id)), s AS (SELECT cell, min(fv) AS since FROM f GROUP BY 1) SELECT obj_id, fv AS first_vtime, max(since) < fv AS let_through FROM f JOIN s USING (cell) GROUP BY 1, 2", "skew"),
    "bloom_error": sql(", h AS (SELECT max(vtime) // 2 AS half FROM a), o AS (SELECT obj_id, min(vtime) <= (SELECT half FROM h) AS held, max(vtime) > (SELECT half FROM h) AS asked FROM a GROUP BY 1)" + _BLOOM_SIZE.format(which="vtime <= (SELECT half FROM h)") + _CELLS.format(hashes=4) + ", b AS (SELECT DISTINCT cell FROM spread JOIN o USING (obj_id) WHERE held), q AS (SELECT obj_id, held, bool_and(b.cell IS NOT NULL) AS maybe FROM spread JOIN o USING (obj_id) LEFT JOIN b USING (cell) WHERE asked GROUP BY 1, 2) SELECT count(*) AS n_asked, count(*) FILTER (held) AS n_held, count(*) FILTER (maybe) AS n_maybe, count(*) FILTER (maybe AND NOT held) AS n_false FROM q", "skew"),
    "frequency_sketch": sql(_OBJ + ", size AS (SELECT 2 * count(*) + 2 AS m FROM o), o2 AS (SELECT obj_id, freq FROM o), hs AS (SELECT obj_id, freq, m, CAST('0x' || substr(md5(CAST(obj_id AS VARCHAR)), 1, 15) AS BIGINT) AS h1, CAST('0x' || substr(md5(CAST(obj_id AS VARCHAR)), 17, 15) AS BIGINT) AS h2 FROM o2, size), f AS (SELECT obj_id, freq, (h1 % m + k * (1 + h2 % (m - 1))) % m AS cell FROM hs, range(0, 3) z(k)), c AS (SELECT cell, sum(freq) AS n FROM f GROUP BY 1) SELECT obj_id, freq AS n, CAST(min(c.n) AS BIGINT) AS estimate FROM f JOIN c USING (cell) GROUP BY 1, 2", "skew"),
    "wss_sampled": sql(f"{_OBJ}, z AS (SELECT first_size AS x FROM o WHERE {_IN_SAMPLE}) SELECT 10 * count(*) AS wss_obj, round(sqrt(90.0 * count(*)), 6) AS wss_obj_error, CAST(coalesce(10 * sum(x), 0) AS BIGINT) AS wss_byte, round(sqrt(90.0 * coalesce(sum(CAST(x AS DOUBLE) * x), 0)), 6) AS wss_byte_error, (SELECT count(*) FROM o) AS exact_obj, (SELECT CAST(sum(first_size) AS BIGINT) FROM o) AS exact_byte FROM z", "skew"),
    "lru_mrc_sampled": sql(f"{_STACK}, r0 AS (SELECT obj_id, row_number() OVER (ORDER BY vtime) AS v FROM a WHERE {_IN_SAMPLE}), r1 AS (SELECT *, lag(v) OVER (PARTITION BY obj_id ORDER BY v) AS p FROM r0), rd AS (SELECT i.obj_id, CASE WHEN i.p IS NULL THEN -1 ELSE (SELECT count(*) FROM r1 j WHERE j.v > i.p AND j.v < i.v AND coalesce(j.p, 0) <= i.p) END AS d FROM r1 i), g AS (SELECT * FROM (VALUES (50), (100), (200), (400)) w(c)), m AS (SELECT c, obj_id, CAST(count(*) FILTER (d < 0 OR 10 * d >= c) AS DOUBLE) AS m FROM rd, g GROUP BY 1, 2), x AS (SELECT c, round(count(*) FILTER (d < 0 OR d >= c) / count(*), 6) AS exact FROM sd, g GROUP BY 1), n AS (SELECT count(*) AS n FROM a) SELECT CAST(c AS BIGINT) AS cache_size, round(10 * sum(m) / min(n), 6) AS miss_ratio, round(sqrt(90.0 * sum(m * m)) / min(n), 6) AS std_error, min(exact) AS exact FROM m JOIN x USING (c), n GROUP BY 1", "skew"),
    "interval_report": sql(_STACK + ", p AS (SELECT (vtime - 1) // 1000 AS interval, count(*) AS n, count(*) FILTER (d < 0 OR d >= 100) AS m FROM sd GROUP BY 1) SELECT interval, round(m / n, 6) AS miss_ratio, round(sum(m) OVER (ORDER BY interval) / sum(n) OVER (ORDER BY interval), 6) AS miss_ratio_so_far FROM p", "skew"),
    "miss_trace": sql(_STACK + " SELECT vtime, obj_id FROM sd WHERE d < 0 OR d >= 100", "skew"),
    "topo_hierarchy": sql(""", s1 AS (SELECT i.vtime, i.obj_id, i.pv, CASE WHEN i.pv IS NULL THEN -1 ELSE (SELECT count(*) FROM a j WHERE j.obj_id % 4 = i.obj_id % 4 AND j.vtime > i.pv AND j.vtime < i.vtime AND coalesce(j.pv, 0) <= i.pv) END AS d FROM a i),
m0 AS (SELECT obj_id, row_number() OVER (ORDER BY vtime) AS v FROM s1 WHERE d < 0 OR d >= 16), m1 AS (SELECT *, lag(v) OVER (PARTITION BY obj_id ORDER BY v) AS p FROM m0),
sd AS (SELECT CASE WHEN i.p IS NULL THEN -1 ELSE (SELECT count(*) FROM m1 j WHERE j.v > i.p AND j.v < i.v AND coalesce(j.p, 0) <= i.p) END AS d FROM m1 i)""" + _MRC + " SELECT * FROM curve", "skew"),
    "topo_cluster": sql(""", srv AS (SELECT DISTINCT ns AS server FROM t0),
pts AS (SELECT CAST('0x' || substr(md5(server || '-' || k), 1, 8) AS BIGINT) AS place, min(server) AS server FROM srv, (SELECT unnest(range(0, 160)) AS k) GROUP BY 1),
ob AS (SELECT DISTINCT obj_id, CAST('0x' || substr(md5(CAST(obj_id AS VARCHAR)), 1, 8) AS BIGINT) AS place FROM t0),
wh AS (SELECT ob.obj_id, coalesce(pts.server, (SELECT arg_min(server, place) FROM pts)) AS server FROM ob ASOF LEFT JOIN pts ON ob.place <= pts.place)
SELECT server, count(*) AS n_req, CAST(sum(obj_size) AS BIGINT) AS bytes, count(DISTINCT obj_id) AS n_obj FROM t0 JOIN wh USING (obj_id) GROUP BY 1""", "skew"),
    "merge_traces": sql(" SELECT row_number() OVER (ORDER BY clock_time, CASE WHEN ns < 4 THEN 0 ELSE 1 END, vtime) AS vtime, CASE WHEN ns < 4 THEN 0 ELSE 1 END AS trace_no, vtime AS own_vtime, obj_id FROM t0"),
    "trace_round_trip": sql(" SELECT vtime, clock_time, obj_id, fs AS obj_size, coalesce(nv, -1) AS next_access_vtime FROM a"),
    "trace_skip_limit": sql(" SELECT vtime - 100 AS vtime, clock_time, obj_id, CAST(1 AS BIGINT) AS obj_size, coalesce(nv, -1) AS next_access_vtime FROM a WHERE vtime > 100 AND vtime <= 9100"),
    "source_round_trip": sql(" SELECT vtime, clock_time, obj_id, fs AS obj_size, coalesce(nv, -1) AS next_access_vtime FROM a"),
    "source_window": sql(" SELECT vtime, obj_id FROM a WHERE vtime > (SELECT count(*) // 3 FROM a) AND vtime <= (SELECT 2 * count(*) // 3 FROM a)"),
    "source_header": sql(_OBJ + " SELECT (SELECT count(*) FROM a) AS n_req, count(*) AS n_obj, (SELECT CAST(sum(fs) AS BIGINT) FROM a) AS n_req_byte, CAST(sum(first_size) AS BIGINT) AS n_obj_byte, (SELECT count(*) FROM a) AS n_read, (SELECT CAST(sum(fs) AS BIGINT) FROM a) AS n_read_byte FROM o"),
    "text_twin": sql(" SELECT concat_ws(',', clock_time, obj_id, fs, coalesce(nv, -1)) AS line FROM a"),
    "trace_print": sql(" SELECT vtime, concat_ws(',', clock_time, obj_id, fs, coalesce(nv, -1)) AS line FROM a"),
    "split_tenants": sql(" SELECT ns, vtime, obj_id FROM t0"),
}
