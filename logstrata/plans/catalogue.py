"""The registered queries over the driver's tables: for each its text in the dialect, and in DuckDB's for comparison."""

from __future__ import annotations

_LINE = "SELECT l_orderkey, l_linenumber"

#: name: text, or texts of both where the dialects differ (times are whole microseconds here; a whole division is // there).
TEXTS: dict[str, str | tuple[str, str]] = {
    "prj_star": "SELECT * FROM region",
    "prj_columns_alias": "SELECT n_name AS nation, n_regionkey AS rk FROM nation",
    "prj_qualified": ("SELECT n.n_name, nation.n_nationkey FROM nation AS n", "SELECT n_name, n_nationkey FROM nation"),
    "prj_literal": ("SELECT n_nationkey, 1 AS one FROM nation", "SELECT n_nationkey, 1::BIGINT AS one FROM nation"),
    "prj_default_alias": ("SELECT n_nationkey, n_nationkey * 2 FROM nation", 'SELECT n_nationkey, n_nationkey::BIGINT * 2 AS "n_nationkey * 2" FROM nation'),
    "scl_add_sub_mul": (
        f"{_LINE}, l_quantity + 1 AS q1, l_extendedprice - l_tax AS p1, l_quantity * 2 AS q2 FROM lineitem",
        f"{_LINE}, l_quantity + 1 AS q1, l_extendedprice - l_tax AS p1, l_quantity * 2 AS q2 FROM lineitem",
    ),
    "scl_int_div_mod": ("SELECT o_orderkey, o_orderkey / 7 AS d, o_orderkey % 7 AS m FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m FROM orders"),
    "scl_float_div": f"{_LINE}, l_extendedprice / l_quantity AS unit_price FROM lineitem",
    "scl_float_div_zero": (
        "SELECT o_orderkey, o_totalprice / 0.0 AS up, o_totalprice % 0.0 AS none FROM orders",
        "SELECT o_orderkey, 'inf'::DOUBLE AS up, 'nan'::DOUBLE AS none FROM orders",
    ),
    "scl_div_by_zero_null": (
        "SELECT n_nationkey, n_nationkey / n_regionkey AS d FROM nation",
        "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey::BIGINT // n_regionkey END AS d FROM nation",
    ),
    "scl_overflow_null": ("SELECT n_nationkey, n_nationkey * 9223372036854775807 AS v FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey <= 1 THEN n_nationkey * 9223372036854775807 END AS v FROM nation"),
    "scl_unary_minus": "SELECT s_suppkey, -s_acctbal AS neg FROM supplier",
    "scl_mixed_promote": f"{_LINE}, l_linenumber * l_discount AS v FROM lineitem",
    "scl_nested": ("SELECT p_partkey, (p_size + 1) * (p_size - 1) % 7 AS v FROM part", "SELECT p_partkey, ((p_size + 1) * (p_size - 1) % 7)::BIGINT AS v FROM part"),
    "scl_text_operand_null": ("SELECT n_nationkey, n_name * 2 AS v FROM nation", "SELECT n_nationkey, NULL::BIGINT AS v FROM nation"),
    "scl_time_bucket": ("SELECT event_id, ts - ts % 3600000000 AS hour_bucket FROM events", "SELECT event_id, epoch_us(ts) - epoch_us(ts) % 3600000000 AS hour_bucket FROM events"),
    "flt_eq": "SELECT event_id FROM events WHERE event_type = 'error'",
    "flt_ne": "SELECT event_id FROM events WHERE event_type <> 'error'",
    "flt_lt": "SELECT o_orderkey FROM orders WHERE o_totalprice < 20000.0",
    "flt_le": f"{_LINE} FROM lineitem WHERE l_quantity <= 5",
    "flt_gt": "SELECT c_custkey FROM customer WHERE c_acctbal > 5000.0",
    "flt_ge": "SELECT p_partkey FROM part WHERE p_size >= 40",
    "flt_negative_literal": "SELECT s_suppkey FROM supplier WHERE s_acctbal < -500.0",
    "flt_string_range": "SELECT c_custkey FROM customer WHERE c_mktsegment >= 'H' AND c_mktsegment < 'N'",
    "flt_is_null": "SELECT event_id FROM events WHERE props IS NULL",
    "flt_is_not_null": "SELECT event_id FROM events WHERE props IS NOT NULL",
    "flt_and": f"{_LINE} FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 30 AND l_discount >= 0.05",
    "flt_or_nested": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice >= 400000.0) AND o_custkey < 500",
    "flt_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "flt_not_in": "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'click')",
    "flt_timestamp_epoch": ("SELECT event_id FROM events WHERE ts >= 1705276800000000", "SELECT event_id FROM events WHERE epoch_us(ts) >= 1705276800000000"),
    "flt_timestamp_range": (
        "SELECT event_id FROM events WHERE ts >= 1705276800000000 AND ts < 1706000000000000",
        "SELECT event_id FROM events WHERE epoch_us(ts) >= 1705276800000000 AND epoch_us(ts) < 1706000000000000",
    ),
    "flt_eq_null_empty": "SELECT event_id FROM events WHERE event_type = NULL",
    "agg_count_star": "SELECT COUNT(*) AS count FROM lineitem",
    "agg_default_alias": ("SELECT COUNT(*), MIN(l_linenumber) FROM lineitem", "SELECT count(*) AS count, min(l_linenumber) AS min_l_linenumber FROM lineitem"),
    "agg_count_col": "SELECT COUNT(props) AS count_props FROM events",
    "agg_sum_int_as_double": ("SELECT SUM(l_linenumber) FROM lineitem", "SELECT sum(l_linenumber)::DOUBLE AS sum_l_linenumber FROM lineitem"),
    "agg_sum_double": ("SELECT SUM(l_extendedprice) AS total FROM lineitem", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem"),
    "agg_sum_empty_zero": ("SELECT SUM(l_quantity) AS s FROM lineitem WHERE l_quantity < 0", "SELECT coalesce(sum(l_quantity), 0.0)::DOUBLE AS s FROM lineitem WHERE l_quantity < 0"),
    "agg_min_empty_null": ("SELECT MIN(l_quantity) AS lo, AVG(l_quantity) AS mid FROM lineitem WHERE l_quantity < 0", "SELECT min(l_quantity) AS lo, avg(l_quantity) AS mid FROM lineitem WHERE l_quantity < 0"),
    "agg_avg_min_max": (
        "SELECT AVG(value) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value FROM events",
        "SELECT round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events",
    ),
    "agg_min_max_string": "SELECT MIN(p_brand) AS lo, MAX(p_brand) AS hi FROM part",
    "agg_min_max_timestamp": ("SELECT MIN(ts) AS lo, MAX(ts) AS hi FROM events", "SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events"),
    "agg_group_one": "SELECT event_type, COUNT(*) AS total FROM events GROUP BY event_type",
    "agg_group_multi": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "agg_group_no_aggregate": "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment",
    "agg_group_key_not_projected": "SELECT COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "agg_group_int_key": "SELECT user_id, COUNT(*) AS total FROM events GROUP BY user_id",
    "agg_group_timestamp_key": ("SELECT l_shipdate, COUNT(*) AS n FROM lineitem GROUP BY l_shipdate", "SELECT epoch_us(l_shipdate) AS l_shipdate, count(*) AS n FROM lineitem GROUP BY 1"),
    "agg_topk_count": "SELECT user_id, COUNT(*) AS total FROM events WHERE value >= 50.0 GROUP BY user_id ORDER BY total DESC, user_id LIMIT 25",
    "agg_group_empty_input": "SELECT event_type, COUNT(*) AS n FROM events WHERE value < -1.0 GROUP BY event_type",
    "srt_multi_term": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 50",
    "srt_limit_zero": "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 0",
    "srt_limit_negative": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT -1", "SELECT n_nationkey FROM nation ORDER BY n_nationkey"),
    "srt_by_alias": "SELECT p_partkey, p_retailprice * 2 AS doubled FROM part ORDER BY doubled DESC, p_partkey LIMIT 20",
    "eval_scalar": ("SELECT 2 + 3 * 4 AS a, 5 * (3 - 2) AS b, 10 % 3 AS c", "SELECT (2 + 3 * 4)::BIGINT AS a, (5 * (3 - 2))::BIGINT AS b, (10 % 3)::BIGINT AS c"),
    "eval_float": ("SELECT 7 / 2 AS whole, 7.0 / 2 AS real, -1.5 AS neg", "SELECT 3::BIGINT AS whole, 3.5::DOUBLE AS real, (-1.5)::DOUBLE AS neg"),
    "bench_q1_errors_by_user": (
        "SELECT user_id, COUNT(*) AS errors FROM events WHERE ts >= 1705276800000000 AND event_type = 'error' GROUP BY user_id ORDER BY errors DESC, user_id LIMIT 5",
        "SELECT user_id, count(*) AS errors FROM events WHERE epoch_us(ts) >= 1705276800000000 AND event_type = 'error' GROUP BY user_id ORDER BY errors DESC, user_id LIMIT 5",
    ),
    "bench_q2_avg_by_type": (
        "SELECT event_type, AVG(value) AS avg_value FROM events WHERE value >= 20.0 GROUP BY event_type",
        "SELECT event_type, round(avg(value), 6) AS avg_value FROM events WHERE value >= 20.0 GROUP BY event_type",
    ),
    "bench_q3_slow_count": "SELECT COUNT(*) AS slow FROM lineitem WHERE l_extendedprice >= 50000.0",
    "bench_q4_projection_heavy": f"{_LINE}, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30 AND l_discount >= 0.05 ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_suppkey LIMIT 25",
    "bench_q5_high_cardinality": "SELECT l_partkey, COUNT(*) AS total FROM lineitem WHERE l_quantity >= 10 GROUP BY l_partkey ORDER BY total DESC, l_partkey LIMIT 25",
    "bench_q6_string_group": "SELECT p_type, COUNT(*) AS total FROM part WHERE p_size >= 10 GROUP BY p_type ORDER BY total DESC, p_type LIMIT 10",
}

#: Sums of doubles depend on the order of adding; these columns are compared rounded to so many places.
ROUNDED = {"agg_sum_double": {"total": 2}, "agg_avg_min_max": {"avg_value": 6}, "agg_group_multi": {"qty": 2}, "bench_q2_avg_by_type": {"avg_value": 6}}


def dialect(name: str) -> str:
    found = TEXTS[name]
    return found if isinstance(found, str) else found[0]


def duckdb(name: str) -> str:
    found = TEXTS[name]
    return found if isinstance(found, str) else found[1]
