"""Filters, joins, aggregates, set operations, values and checks over the fixture tables, as SQL that Catalyst plans.

Company stands for nation, shared rows for the segment BUILDING, expiry for the order date plus a number of days.
"""

from __future__ import annotations

from docquarry.plans.query import Catalog

Q = Catalog()
sql = Q.sql

# Filters and projections
sql("b1_tenant_scope", "SELECT c_custkey, c_name FROM @customer WHERE c_nationkey = 7 OR c_mktsegment = 'BUILDING'")
sql("b2_usable_asof", "SELECT o_orderkey FROM @orders WHERE o_orderstatus <> 'P' AND (o_orderdate IS NULL OR CAST(o_orderdate AS DATE) + INTERVAL 90 DAY >= DATE '1996-01-01')")
sql("b3_current_only", "SELECT o_orderkey, o_orderstatus FROM @orders WHERE o_orderstatus <> 'P'")
sql("b4_level_cap", "SELECT p_partkey, p_size FROM @part WHERE p_size <= 4")
sql("b5_ilike_search", "SELECT p_partkey FROM @part WHERE p_name ILIKE '%RE%' OR p_brand ILIKE '%RE%' OR p_type ILIKE '%RE%'")
sql("b6_in_list", "SELECT s_suppkey FROM @supplier WHERE s_suppkey IN (1, 3, 5, 8) OR s_nationkey IN (2, 4)")
sql("b7_prefix", "SELECT DISTINCT p_type FROM @part WHERE p_type LIKE 'STANDARD%' OR p_brand LIKE 'Brand#1%'")
sql("b8_derived", "SELECT l_orderkey, l_linenumber, greatest(0, coalesce(CAST(l_quantity AS BIGINT), 0) - 10) AS span, round(coalesce(l_tax, 0) + coalesce(l_discount, 0), 4) AS visual FROM @lineitem")
sql("b9_pruned", "SELECT l_orderkey, l_quantity FROM @lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01 00:00:00'")
sql("b11_owner_filter", "SELECT event_id, ts FROM @events WHERE user_id = 11")
sql("b12_complete_rows", "SELECT doc_id FROM @documents WHERE coalesce(trim(text), '') <> '' AND coalesce(lang, '') <> '' AND coalesce(source, '') <> ''")
sql("b16_unselected_options", "SELECT page_id FROM @pages WHERE NOT (html LIKE '%[X]%' OR html LIKE '%(X)%')")
sql("b19_trust_gate", "SELECT source, CASE WHEN count(*) >= 3 AND avg(CASE WHEN length(text) > 500 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'keep' WHEN count(*) < 3 THEN 'ask' ELSE 'review' END AS gate FROM @documents GROUP BY source")
sql("b20_limit_clamp", "SELECT event_id FROM @events ORDER BY ts DESC, event_id LIMIT 500")

# Joins
sql("c1_hydrate", "SELECT o.o_orderkey, coalesce(nullif(c.c_mktsegment, ''), 'none') AS segment FROM @orders o LEFT JOIN @customer c ON o.o_custkey = c.c_custkey")
sql(
    "c2_resolve_priority",
    "SELECT o_orderkey, label FROM (SELECT o_orderkey, label, row_number() OVER (PARTITION BY o_orderkey ORDER BY p, label) AS n FROM ("
    "SELECT o_orderkey, c_name AS label, 1 AS p FROM @orders JOIN @customer ON o_custkey = c_custkey WHERE c_acctbal > 0 UNION ALL SELECT o_orderkey, o_orderpriority, 2 FROM @orders) u) r WHERE n = 1",
)
sql("c3_dual_key", "SELECT s.s_suppkey, coalesce(a.n_name, b.r_name) AS place FROM @supplier s LEFT JOIN @nation a ON s.s_nationkey = a.n_nationkey AND a.n_nationkey < 15 LEFT JOIN @region b ON s.s_nationkey % 5 = b.r_regionkey")
sql(
    "c4_lookup_topn",
    "SELECT c_custkey, o_orderkey, n FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n, least(greatest(c_nationkey, 1), 8) AS most FROM @customer JOIN @orders ON c_custkey = o_custkey) r WHERE n <= most",
)
sql(
    "c9_anti_add",
    "SELECT doc_id, 'label' AS origin FROM @labels UNION ALL SELECT doc_id, 'document' AS origin FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM @documents d WHERE NOT EXISTS (SELECT 1 FROM @labels l WHERE l.doc_id = d.doc_id)) r WHERE n = 1",
)
sql("c10_semi_validate", "SELECT l_orderkey, l_linenumber FROM @lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM @supplier WHERE s_acctbal > 0)")
sql("c11_override_merge", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'chosen' END, d.lang) AS assigned FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id")
sql(
    "c13_rekey",
    "SELECT new.p_brand, new.p_partkey, old.latest FROM @part new JOIN (SELECT lower(p_brand) AS k, max(p_partkey) AS latest FROM @part WHERE p_size > 25 GROUP BY lower(p_brand)) old ON lower(new.p_brand) = old.k",
)
sql(
    "c14_asof_label",
    "SELECT event_id, label FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM @events) e WHERE event_type = 'purchase' AND label IS NOT NULL",
    "SELECT event_id, label FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM events) e WHERE event_type = 'purchase' AND label IS NOT NULL",
)
sql(
    "c15_next_bounded",
    "SELECT event_id, min(CASE WHEN event_type = 'click' THEN n END) OVER (PARTITION BY user_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 80 FOLLOWING) AS next_click FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM @events) e",
)
sql("c17_tuple_range", "SELECT n_nationkey FROM @nation WHERE (n_regionkey > 1 OR (n_regionkey = 1 AND n_nationkey >= 2)) AND (n_regionkey < 3 OR (n_regionkey = 3 AND n_nationkey <= 20))")
sql(
    "c18_preceding_mentions",
    "SELECT event_id, before FROM (SELECT a.event_id, b.event_id AS before, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS n FROM @events a JOIN @events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 2 DAY) r WHERE n <= 8",
)
sql(
    "c26_prefer_own",
    "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size = 7 THEN 0 ELSE 1 END, p_partkey) AS n FROM @part) r WHERE n = 1",
)
sql("j_range_join", "SELECT o.o_orderkey, count(*) AS n FROM @orders o JOIN @lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 60 DAY GROUP BY o.o_orderkey")

# Aggregates
sql("d1_scalar_count", "SELECT count(o_orderkey) AS n, count_if(o_orderstatus = 'F') AS done FROM @orders")
sql("d2_category_counts", "SELECT c_mktsegment, count(*) AS n FROM @customer GROUP BY c_mktsegment HAVING coalesce(c_mktsegment, '') <> '' ORDER BY n DESC, c_mktsegment")
sql("d3_distinct", "SELECT DISTINCT o_orderpriority FROM @orders")
sql("d4_category_stats", "SELECT coalesce(nullif(source, 'src0'), 'format') AS category, count(*) AS n FROM @documents GROUP BY coalesce(nullif(source, 'src0'), 'format')")
sql("d5_passed", "SELECT d.lang, count_if(l.toxic = 1) AS fatal, count_if(l.quality = 0) AS issues, count_if(l.toxic = 1) = 0 AS passed FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
sql(
    "d6_conflicts",
    "SELECT o_custkey, array_join(sort_array(collect_set(o_orderstatus)), ',') AS vals FROM @orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1",
    "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS vals FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1",
)
sql("d7_role_names", "SELECT role, count(DISTINCT conv_id) AS n FROM @conversations GROUP BY role HAVING count(DISTINCT conv_id) > 1")
sql(
    "d9_scoring_rollup",
    "SELECT coalesce(l_returnflag, '') AS grp, round(sum(CASE WHEN l_linestatus <> 'O' THEN l_extendedprice END), 3) AS subtotal, 0 AS is_total FROM @lineitem GROUP BY l_returnflag UNION ALL SELECT 'total', round(sum(CASE WHEN l_linestatus <> 'O' THEN l_extendedprice END), 3), 1 FROM @lineitem WHERE l_returnflag IN ('A', 'R')",
)
sql("d10_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT doc_id, explode(split(trim(concat(lang, ' ', source)), ' ')) AS tag FROM @documents) t GROUP BY tag", "SELECT tag, count(*) AS n FROM (SELECT doc_id, unnest(string_split(trim(concat(lang, ' ', source)), ' ')) AS tag FROM documents) t GROUP BY tag")
sql("d11_retrieval_summary", "SELECT user_id, count(*) AS facts, count_if(value >= 50) AS strong, count_if(event_type = 'purchase') AS assigned, max(CASE WHEN event_type = 'purchase' THEN greatest(value, 1.0) ELSE value END) AS confidence FROM @events GROUP BY user_id")
sql("d12_outline_stats", "SELECT p_size AS level, count(*) AS n, count_if(p_name LIKE '%e%') AS with_template FROM @part GROUP BY p_size")
sql("d13_provenance", "SELECT source, CASE WHEN count_if(l.doc_id IS NOT NULL) = 0 THEN 'llm' WHEN count_if(l.doc_id IS NULL) = 0 THEN 'source_backed' ELSE 'mixed' END AS label FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id GROUP BY source")
sql("d16_fact_groups", "SELECT g.name, count(e.event_id) AS n FROM (SELECT 'view' AS name UNION ALL SELECT 'click' UNION ALL SELECT 'refund') g LEFT JOIN @events e ON e.event_type = g.name GROUP BY g.name")
sql(
    "d18_corpus_concat",
    "SELECT conv_id, lower(array_join(transform(array_sort(collect_list(struct(turn, role, trim(text) AS t))), x -> x.t), '\n')) AS corpus FROM @conversations GROUP BY conv_id",
    "SELECT conv_id, lower(string_agg(trim(text), chr(10) ORDER BY turn, role)) AS corpus FROM conversations GROUP BY conv_id",
)
sql("d20_sibling_groups", "SELECT p_partkey, members FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, left(p_type, 5), p_size) AS members FROM @part) p WHERE members >= 2")
sql("d21_preamble_bounds", "SELECT user_id, min(n) AS lo, max(n) AS hi FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM @events) e WHERE seen = 0 GROUP BY user_id")
sql("d24_max_timestamp", "SELECT user_id, max(ts) AS updated_at FROM @events GROUP BY user_id")

# Sequences
sql("e5_suffix", "SELECT c_custkey, CASE WHEN n > 1 THEN concat(c_mktsegment, '_', CAST(n AS STRING)) ELSE c_mktsegment END AS name FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM @customer) c")
sql("e6_next_start", "SELECT o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_start FROM @orders")
sql("e10_neighbour_fill", "SELECT event_id, coalesce(p, last_value(p) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lead(p) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS page FROM (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN event_id END AS p FROM @events) e",
    "SELECT event_id, coalesce(p, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lead(p) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS page FROM (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN event_id END AS p FROM events) e")
sql("e11_context", "SELECT event_id FROM (SELECT event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM @events) e WHERE near = 1")
sql("e12_gap_close", "SELECT user_id, n AS lo, nxt AS hi FROM (SELECT user_id, n, lead(n) OVER (PARTITION BY user_id ORDER BY n) AS nxt FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM @events) a WHERE event_type = 'click') b WHERE nxt - n BETWEEN 2 AND 3")
sql("e17_fill_down", "SELECT event_id, last_value(kind) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM (SELECT *, nullif(event_type, 'view') AS kind FROM @events) e",
    "SELECT event_id, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM (SELECT *, nullif(event_type, 'view') AS kind FROM events) e")
sql("e20_until_stop", "SELECT event_id FROM (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stops FROM @events) e WHERE stops = 0")

# Sorts and limits
sql("f1_topk", "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM @events) e WHERE n <= 8")
sql("f3_dedupe_limit", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM (SELECT p_brand, min(p_partkey) AS p_partkey FROM @part GROUP BY p_brand, p_size) d) r WHERE n <= 4")
sql("f5_matched_top", "SELECT l_orderkey, l_linenumber FROM @lineitem WHERE l_discount > 0.09 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 12")
sql("f7_best_candidate", "SELECT p_type, min_by(p_partkey, struct(-p_size, p_partkey)) AS best FROM @part GROUP BY p_type", "SELECT p_type, arg_min(p_partkey, (-p_size, p_partkey)) AS best FROM part GROUP BY p_type")
sql("f10_count_cap", "SELECT s.s_suppkey, greatest(1, least(s.s_nationkey, coalesce(c.cap, 3))) AS allowed FROM @supplier s LEFT JOIN (SELECT 1 AS k, 10 AS cap UNION ALL SELECT 2, 5) c ON s.s_nationkey % 4 = c.k")

# Set operations
sql("g2_id_union", "SELECT doc_id FROM @documents UNION SELECT doc_id FROM @labels")
sql(
    "g3_jaccard",
    "SELECT a.c_nationkey AS a, b.c_nationkey AS b, round(size(array_intersect(a.s, b.s)) / size(array_union(a.s, b.s)), 6) AS jaccard FROM (SELECT c_nationkey, collect_set(cast(c_acctbal AS BIGINT) % 97) AS s FROM @customer GROUP BY c_nationkey) a JOIN (SELECT c_nationkey, collect_set(cast(c_acctbal AS BIGINT) % 97) AS s FROM @customer GROUP BY c_nationkey) b ON a.c_nationkey % 5 = b.c_nationkey % 5 AND a.c_nationkey < b.c_nationkey",
    "WITH s AS (SELECT DISTINCT c_nationkey, trunc(c_acctbal)::BIGINT % 97 AS x FROM customer), n AS (SELECT c_nationkey, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.c_nationkey AS a, b.c_nationkey AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.c_nationkey % 5 = b.c_nationkey % 5 AND a.c_nationkey < b.c_nationkey GROUP BY 1, 2) SELECT na.c_nationkey AS a, nb.c_nationkey AS b, round(coalesce(common, 0) / (na.n + nb.n - coalesce(common, 0)), 6) AS jaccard FROM n na JOIN n nb ON na.c_nationkey % 5 = nb.c_nationkey % 5 AND na.c_nationkey < nb.c_nationkey LEFT JOIN p ON p.a = na.c_nationkey AND p.b = nb.c_nationkey",
)
sql("g4_difference", "SELECT c_custkey FROM @customer EXCEPT SELECT o_custkey FROM @orders")
sql("g5_ordered_distinct", "SELECT user_id, array_join(array_distinct(transform(array_sort(collect_list(struct(ts, event_id, event_type))), x -> x.event_type)), ',') AS types FROM @events GROUP BY user_id",
    "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS types FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) e WHERE n = 1 GROUP BY user_id")
sql("g7_max_keyed", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM @lineitem) l WHERE n = 1")
sql("g8_fingerprint", "SELECT min(doc_id) AS doc_id, concat(md5(text), ':', CAST(length(text) AS STRING)) AS fingerprint, count(*) AS copies FROM @documents GROUP BY md5(text), length(text)")
sql("g9_issue_keys", "SELECT min(event_id) AS event_id FROM @events GROUP BY event_type, left(props, 80), user_id")
sql("g10_snippets", "SELECT min(doc_id) AS doc_id FROM @documents WHERE length(translate(text, ' \n', '')) >= 8 GROUP BY left(translate(text, ' \n', ''), 120)", "SELECT min(doc_id) AS doc_id FROM documents WHERE length(translate(text, ' ' || chr(10), '')) >= 8 GROUP BY left(translate(text, ' ' || chr(10), ''), 120)")

# Text scalars
sql("h19_slug", "SELECT c_custkey, left(regexp_replace(lower(c_name), '[^a-z0-9]+', '-'), 24) AS slug FROM @customer", "SELECT c_custkey, left(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), 24) AS slug FROM customer")
sql("h25_enum", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'P0' WHEN o_orderpriority LIKE '2%' THEN 'P1' WHEN o_orderpriority LIKE '3%' THEN 'P2' ELSE 'P3' END AS severity FROM @orders")
sql("h26_capture", "SELECT doc_id, regexp_extract(text, '([A-Z][A-Z]+-?[A-Z0-9-][A-Z0-9-][A-Z0-9-][A-Z0-9-]+)', 1) AS project_no FROM @documents")

# Dates, scores and JSON
sql("i3_event_order", "SELECT l_orderkey, l_linenumber FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
sql("i4_locked_mismatch", "SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS dates FROM @orders o JOIN (SELECT o_custkey AS k, min(o_orderdate) AS locked FROM @orders GROUP BY o_custkey) f ON o.o_custkey = f.k WHERE o_orderdate <> locked GROUP BY o_custkey")
sql("i5_iso_parse", "SELECT event_id, try_cast(concat('2024-', lpad(CAST(1 + event_id % 14 AS STRING), 2, '0'), '-31') AS DATE) AS d FROM @events")
sql("i6_backfill", "SELECT user_id, max_by(value, struct(ts, event_id)) FILTER (WHERE event_type = 'click') AS last_click FROM @events GROUP BY user_id", "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS last_click FROM events GROUP BY user_id")
sql("k5_json_field", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM @events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
sql("k7_keywords", "SELECT doc_id, size(filter(split(text, '[,\n]'), x -> trim(x) <> '')) AS n FROM @documents", "SELECT doc_id, len(list_filter(string_split_regex(text, '[,\\n]'), lambda x: trim(x) <> '')) AS n FROM documents")
sql("k12_alias", "SELECT doc_id, CASE source WHEN 'src0' THEN 'main' ELSE source END AS source FROM @documents")

# Additive: what the reference lacks but its kind of engine offers
sql("z_rollup", "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM @lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("z_tumbling", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, event_type, count(*) AS n FROM @events GROUP BY date_trunc('hour', ts), event_type", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type")
sql("z_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM @lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")

# Reports
sql(
    "m13_consistency",
    "SELECT fact, n FROM (SELECT 'status' AS fact, count(*) AS n FROM (SELECT o_custkey FROM @orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1) a UNION ALL SELECT 'order', count(*) FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate) u WHERE n > 0",
)
sql("m11_fact_table", "SELECT 'event' AS grp, event_id AS id, event_type AS label FROM @events UNION ALL SELECT 'order', o_orderkey, o_orderpriority FROM @orders UNION ALL SELECT 'part', p_partkey, p_brand FROM @part")
sql("o6_recovery", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P') THEN 'failed' ELSE o_orderstatus END AS status FROM @orders")
sql("t7_client_groups", "SELECT l_linestatus, round(coalesce(sum(CASE WHEN l_tax > 0.07 THEN l_quantity END), 0), 2) AS total FROM @lineitem GROUP BY l_linestatus")
sql("t9_counters", "SELECT count_if(trim(text) <> '') AS edited, count(*) - count_if(trim(text) <> '') AS todo FROM @documents")
