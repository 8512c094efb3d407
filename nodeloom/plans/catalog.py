"""Registry of all queries of the core, with their SQL."""

from __future__ import annotations

from nodeloom.operators import orphans
from nodeloom.plans import analyze_queries, build_queries, data_queries, search_queries
from nodeloom.plans.view import norm
from nodeloom.session import table


def _fold(spark, d):
    return orphans.fold_history(table(spark, d, "graph_edges"), table(spark, d, "graph_nodes"))


QUERIES = {
    "p3_found": lambda s, d: _fold(s, d).found(),
    "p3_report": lambda s, d: _fold(s, d).changes(),
    "p3_waiting": lambda s, d: _fold(s, d).waiting(),
}
SQL = {
    "p3_found": f"""WITH refs AS (SELECT edge_seq, 'source' AS endpoint, {norm("source")} AS id, arrived_at FROM graph_edges UNION ALL SELECT edge_seq, 'target', {norm("target")}, arrived_at FROM graph_edges),
there AS (SELECT {norm("id")} AS id, arrived_at, removed_at FROM graph_nodes)
SELECT edge_seq, endpoint FROM refs r WHERE id <> '' AND NOT EXISTS (SELECT 1 FROM there t WHERE t.id = r.id AND t.arrived_at <= r.arrived_at AND (t.removed_at IS NULL OR t.removed_at > r.arrived_at))""",
}
SQL["p3_report"] = f"""WITH refs AS (SELECT 'source' AS endpoint, {norm("source")} AS id, arrived_at AS t FROM graph_edges WHERE {norm("source")} <> '' UNION ALL SELECT 'target', {norm("target")}, arrived_at FROM graph_edges WHERE {norm("target")} <> ''),
there AS (SELECT {norm("id")} AS id, arrived_at AS a, removed_at AS z FROM graph_nodes WHERE {norm("id")} <> '' AND (removed_at IS NULL OR removed_at > arrived_at)),
dl AS (SELECT id, t, sum(d)::BIGINT AS d FROM (SELECT id, a AS t, 1 AS d FROM there UNION ALL SELECT id, z, -1 FROM there WHERE z IS NOT NULL) GROUP BY id, t),
tr AS (SELECT id, t, d, sum(d) OVER (PARTITION BY id ORDER BY t) AS now FROM dl),
ch AS (SELECT id, t, CASE WHEN now - d = 0 AND now > 0 THEN 'up' WHEN now - d > 0 AND now = 0 THEN 'down' END AS way FROM tr),
ev AS (SELECT r.endpoint, strftime(ch.t, '%Y-%m') AS period, ch.way, count(*) AS k FROM ch JOIN refs r ON r.id = ch.id AND r.t < ch.t WHERE ch.way IS NOT NULL GROUP BY 1, 2, 3),
nw AS (SELECT endpoint, strftime(t, '%Y-%m') AS period, count(*) AS k FROM refs r WHERE NOT EXISTS (SELECT 1 FROM there x WHERE x.id = r.id AND x.a <= r.t AND (x.z IS NULL OR x.z > r.t)) GROUP BY 1, 2),
m AS (SELECT endpoint, period FROM (SELECT DISTINCT strftime(t, '%Y-%m') AS period FROM (SELECT t FROM refs UNION ALL SELECT t FROM dl)), (SELECT unnest(['source', 'target']) AS endpoint)),
x AS (SELECT m.endpoint, m.period, coalesce(nw.k, 0) AS new_orphans, coalesce(u.k, 0) AS resolved, coalesce(w.k, 0) AS reopened FROM m LEFT JOIN nw ON nw.endpoint = m.endpoint AND nw.period = m.period
  LEFT JOIN ev u ON u.endpoint = m.endpoint AND u.period = m.period AND u.way = 'up' LEFT JOIN ev w ON w.endpoint = m.endpoint AND w.period = m.period AND w.way = 'down')
SELECT 'graph_edges' AS table_name, *, (sum(new_orphans - resolved + reopened) OVER (PARTITION BY endpoint ORDER BY period))::BIGINT AS pending FROM x"""
SQL["p3_waiting"] = f"""WITH refs AS (SELECT edge_seq, 'source' AS endpoint, {norm("source")} AS id, arrived_at AS since FROM graph_edges UNION ALL SELECT edge_seq, 'target', {norm("target")}, arrived_at FROM graph_edges)
SELECT edge_seq, endpoint, since FROM refs r WHERE id <> '' AND NOT EXISTS (SELECT 1 FROM graph_nodes t WHERE {norm("t.id")} = r.id AND t.removed_at IS NULL)"""
FLAGSHIP = "q17_query_graph"
for _part in (build_queries, search_queries, analyze_queries, data_queries):
    QUERIES.update(_part.QUERIES)
    SQL.update(_part.SQL)
