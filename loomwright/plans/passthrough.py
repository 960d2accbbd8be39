"""Queries in SQL as it stands: what a statement sent to the SQL entry point may use."""

from __future__ import annotations

from ..sources import tables
from .registry import query

#: name: (tables, statement) of statements that Spark and the oracle take alike, or (tables, statement, oracle's statement).
STATEMENTS = {
    "sql_join_inner": ("orders customer", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "sql_join_left": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "sql_join_full": ("supplier customer", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, sum(CASE WHEN s_suppkey IS NULL THEN 1 ELSE 0 END) AS no_supplier, count(*) AS n FROM supplier FULL OUTER JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal GROUP BY coalesce(s_nationkey, c_nationkey)"),
    "sql_join_semi": ("customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", "SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F') USING (c_custkey)"),
    "sql_join_anti": ("customer orders", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "sql_join_theta": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey"),
    "sql_agg_distinct": ("lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag"),
    "sql_agg_having": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "sql_agg_grouping_sets": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "sql_agg_cube": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "sql_agg_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "sql_agg_pricing": ("lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "sql_agg_filter": ("events", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(max(value) FILTER (WHERE event_type = 'purchase'), 4) AS most FROM events GROUP BY user_id"),
    "sql_win_rank": ("orders", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders", "SELECT o_custkey, o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority))::INTEGER AS r, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority))::INTEGER AS dr FROM orders"),
    "sql_win_lag_lead": ("events", "SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events"),
    "sql_win_frame": ("events", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS total FROM events"),
    "sql_set_union": ("supplier customer", "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer"),
    "sql_set_union_all": ("supplier customer", "SELECT s_nationkey AS nation FROM supplier UNION ALL SELECT c_nationkey FROM customer"),
    "sql_set_intersect": ("part lineitem", "SELECT p_partkey AS k FROM part WHERE p_size > 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 25"),
    "sql_set_except": ("customer orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"),
    "sql_set_except_all": ("orders", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"),
    "sql_topk_groups": ("orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n <= 3"),
    "sql_topk_limit": ("part", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20"),
    "sql_fn_string": ("part", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_brand, 7) AS b, replace(p_type, 'O', '0') AS t, concat(p_brand, '-', p_type) AS c FROM part", "SELECT p_partkey, upper(p_name) AS u, length(p_name)::INTEGER AS n, substring(p_brand, 7) AS b, replace(p_type, 'O', '0') AS t, concat(p_brand, '-', p_type) AS c FROM part"),
    "sql_fn_date": ("orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, cast(date_trunc('quarter', o_orderdate) AS timestamp_ntz) AS q, date_add(cast(o_orderdate AS date), 30) AS due FROM orders", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q, (o_orderdate::DATE + 30)::DATE AS due FROM orders"),
    "sql_fn_math": ("lineitem", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS s, floor(l_discount * 100) AS f, round(ln(l_extendedprice), 6) AS l, abs(l_tax - l_discount) < 0.03 AS close FROM lineitem", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS s, floor(l_discount * 100)::BIGINT AS f, round(ln(l_extendedprice), 6) AS l, abs(l_tax - l_discount) < 0.03::DOUBLE AS close FROM lineitem"),
    "sql_fn_json": ("events", "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"),
    "sql_fn_array": ("embeddings", "SELECT vec_id, size(embedding) AS n, round(array_max(embedding), 5) AS most FROM embeddings", "SELECT vec_id, len(embedding)::INTEGER AS n, round(list_max(embedding), 5) AS most FROM embeddings"),
    "sql_fn_case": ("customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS class, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer"),
    "sql_subq_scalar": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)"),
    "sql_subq_in": ("lineitem part", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)"),
    "sql_subq_exists": ("customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "sql_subq_correlated": ("orders", "SELECT o_custkey, o_orderkey FROM orders a WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)"),
    "sql_subq_cte": ("orders nation customer", "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), rich AS (SELECT o_custkey FROM spent WHERE total > 2000000) SELECT n_name, count(*) AS n FROM rich JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
}


def _register(name, names, statement, oracle=None):
    @query(name, oracle or statement)
    def run(spark, d):
        tables.register_tables(spark, d, names.split())
        return tables.run_sql(spark, statement)


for _name, _parts in STATEMENTS.items():
    _register(_name, *_parts)


@query("sql_asof_events", """
SELECT c.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, max_by(event_id, event_id) AS event_id, ts FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON c.user_id = p.user_id AND c.ts >= p.ts
""")
def sql_asof_events(spark, d):
    tables.register_tables(spark, d, ["events"])
    return tables.run_sql(spark, """
        SELECT event_id, purchase_id FROM (
          SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END, true)
            OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id) AS purchase_id
          FROM events WHERE event_type IN ('click', 'purchase'))
        WHERE event_type = 'click'""")
