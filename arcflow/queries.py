"""Queries over the driver's tables and the same computations in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcflow import views
from arcflow.functions.rng import uniform_sql
from arcflow.graph import Graph
from arcflow.operators import active, fixed, layout, walk
from arcflow.plans.cut import cut
from arcflow.plans.rounds import delete, shared_folder
from arcflow.sources import coo
from arcflow.sources import edges as edge_source

Query = Callable[[SparkSession, str], DataFrame]


def graph_of(spark: SparkSession, sf_dir: str, view: str) -> Graph:
    found = views.VIEWS[view](spark, sf_dir)
    return Graph(edge_source.remap(found, edge_source.dense_ids(found)) if view in views.NAMED else found)


def _rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round("value", 9).alias("value"))


def _over(view: str, compute: Callable[[Graph], DataFrame]) -> Query:
    """Compute over a view's graph; loops write their ranks before what the graph keeps goes."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = graph_of(spark, sf_dir, view)
        out = compute(graph)
        graph.release()
        return out

    return query


def _raw(view: str, compute: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: compute(views.VIEWS[view](spark, sf_dir))


def _remapped(found: DataFrame) -> DataFrame:
    return edge_source.by_destination(edge_source.remap(found, edge_source.dense_ids(found)))


def _adjacency(graph: Graph) -> DataFrame:
    return graph.adjacency().select("src", F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"), F.col("deg").cast("long").alias("deg"))


def _messages(graph: Graph) -> DataFrame:
    return fixed.messages(graph, fixed.start(graph)).select("src", "dst", F.round("message", 9).alias("message"))


def _there_and_back(spark: SparkSession, write_and_read: Callable[[str], DataFrame]) -> DataFrame:
    """What is read of a new place in the shared folder, which goes once the rows are written."""
    path = shared_folder(spark, "edges")
    try:
        return cut(write_and_read(path))
    finally:
        delete(spark, path)


def _coo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written to a binary file and read again."""
    found = graph_of(spark, sf_dir, "part_chain").edges
    return _there_and_back(spark, lambda path: coo.read_coo(spark, path, coo.write_coo(found, path)))


def _text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as text and read again, with dense ids."""

    def run(path: str) -> DataFrame:
        edge_source.write_edge_text(graph_of(spark, sf_dir, "part_chain").edges, path)
        found = edge_source.read_edge_text(spark, path)
        return edge_source.remap(found, edge_source.dense_ids(found))

    return _there_and_back(spark, run)


def _parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written by destination and read again."""

    def run(path: str) -> DataFrame:
        edge_source.write_edge_parquet(graph_of(spark, sf_dir, "part_chain").edges, path)
        return edge_source.read_edge_parquet(spark, path)

    return _there_and_back(spark, run)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "out_degree": _over("part_chain", Graph.out_degree),
        "in_degree": _over("cust_supp", Graph.in_degree),
        "dense_ids": _raw("cust_supp", edge_source.dense_ids),
        "remapped_edges": _raw("cust_supp", _remapped),
        "csr_offsets": _over("part_chain", layout.row_offsets),
        "csc_offsets": _over("cust_supp", layout.column_offsets),
        "adjacency": _over("part_chain", _adjacency),
        "edge_messages": _over("part_chain", _messages),
        "sync_step1": _over("part_chain", lambda g: _rounded(fixed.rank_sync(g, iterations=1))),
    }
    for view in views.VIEWS:
        out[f"sync_{view}"] = _over(view, lambda g: _rounded(fixed.rank_sync(g)))
    return out | {
        "sync_repeat10_nation_trade": _over("nation_trade", lambda g: _rounded(fixed.rank_sync(g, repeats=10))),
        "linf_part_chain": _over("part_chain", lambda g: _rounded(fixed.rank_linf(g))),
        "async_part_chain": _over("part_chain", lambda g: _rounded(active.rank_async(g))),
        "async_cust_supp": _over("cust_supp", lambda g: _rounded(active.rank_async(g))),
        "async_repeat10_nation_trade": _over("nation_trade", lambda g: _rounded(active.rank_async(g, repeats=10))),
        "async_active_counts": _over("part_chain", lambda g: active.settle(g).counts.select("round", "active")),
        "frontier_positions": _over("part_chain", active.frontier_positions),
        "mc_event_type_flow": _over("event_type_flow", lambda g: _rounded(walk.rank_monte_carlo(g))),
        "mc_part_chain": _over("part_chain", lambda g: _rounded(walk.rank_monte_carlo(g))),
        "mc_cust_supp": _over("cust_supp", lambda g: _rounded(walk.rank_monte_carlo(g))),
        "mc_replicas3_nation_trade": _over("nation_trade", lambda g: _rounded(walk.rank_monte_carlo(g, replicas=3))),
        "mc_expected_part_chain": _over("part_chain", lambda g: _rounded(walk.rank_expected(g))),
        "mc_expected_cust_supp": _over("cust_supp", lambda g: _rounded(walk.rank_expected(g))),
        # The same by joins of rows.
        "sync_broadcast_part_chain": _over("part_chain", lambda g: _rounded(fixed.rank_sync(g, strategy="broadcast"))),
        "sync_shuffle_part_chain": _over("part_chain", lambda g: _rounded(fixed.rank_sync(g, strategy="shuffle"))),
        "linf_shuffle_part_chain": _over("part_chain", lambda g: _rounded(fixed.rank_linf(g, strategy="shuffle"))),
        "async_broadcast_part_chain": _over("part_chain", lambda g: _rounded(active.rank_async(g, strategy="broadcast"))),
        "async_shuffle_part_chain": _over("part_chain", lambda g: _rounded(active.rank_async(g, strategy="shuffle"))),
        "mc_lockstep_part_chain": _over("part_chain", lambda g: _rounded(walk.rank_monte_carlo(g))),
        "mc_expected_shuffle_cust_supp": _over("cust_supp", lambda g: _rounded(walk.rank_expected(g, strategy="shuffle"))),
        "coo_roundtrip": _coo_roundtrip,
        "text_roundtrip": _text_roundtrip,
        "parquet_roundtrip": _parquet_roundtrip,
        "node_rank_lookup": _over("part_chain", lambda g: _rounded(layout.rank_of(fixed.rank_sync(g), 1))),
        "rank_top10": _over("part_chain", lambda g: layout.top_ranks(_rounded(fixed.rank_sync(g)))),
    }


def _prelude(view: str) -> str:
    """Common table expressions: raw, ids, edges, nodes, deg, w."""
    raw = f"with recursive raw as materialized ({views.SQL[view]})"
    if view in views.NAMED:
        raw += ", ids as materialized (select raw_id, row_number() over (order by raw_id) - 1 as id from (select distinct unnest([src, dst]) raw_id from raw)), edges as materialized (select a.id src, b.id dst from raw join ids a on a.raw_id = raw.src join ids b on b.raw_id = raw.dst)"
    else:
        raw += ", edges as materialized (select src, dst from raw)"
    return raw + (
        ", nodes as materialized (select distinct unnest([src, dst])::bigint id from edges)"
        ", deg as materialized (select src, count(*) d from edges group by src)"
        ", w as materialized (select e.src, e.dst, count(*)::double / any_value(d) w from edges e join deg using (src) group by e.src, e.dst)"
    )


def _sync_sql(view: str, rounds: int, tail: str = "select id, round(v, 9) as value from pr where it = {n}") -> str:
    return _prelude(view) + f", pr(it, id, v) as (select 0, id, 0.85::double from nodes union all select it + 1, id, 0.15 + 0.85 * sum(m) from (select pr.it, w.dst id, pr.v * w.w m from pr join w on w.src = pr.id where pr.it < {rounds} union all select it, id, 0.0 from pr where it < {rounds}) group by it, id) " + tail.format(n=rounds)


def _linf_sql(view: str) -> str:
    going = "exists (select 1 from pr where d > 0.0015)"
    return _prelude(view) + f", pr(it, id, v, d) as (select 0, id, 0.85::double, 1.0::double from nodes union all select it + 1, id, 0.15 + 0.85 * sum(m), abs(0.15 + 0.85 * sum(m) - max(ov)) from (select pr.it, w.dst id, pr.v * w.w m, null::double ov from pr join w on w.src = pr.id where {going} union all select it, id, 0.0, v from pr where {going}) group by it, id) select id, round(v, 9) as value from pr where it = (select max(it) from pr)"


def _async_sql(view: str, repeats: int = 1, tail: str = "select id, round(v, 9) as value from pr where it = (select max(it) from pr)") -> str:
    going = "exists (select 1 from pr where act)"
    return (
        _prelude(view)
        + f", pr(it, call, id, v, act) as (select 0, 1, id, 0.85::double, true from nodes union all (select it + 1, call, id, case when act then nv else v end, act and abs(nv - v) > 0.0015 from (select it, call, id, 0.15 + 0.85 * sum(m) nv, max(ov) v, bool_or(oa) act from (select pr.it, pr.call, w.dst id, pr.v * w.w m, null::double ov, false oa from pr join w on w.src = pr.id where {going} union all select it, call, id, 0.0, v, act from pr where {going}) group by it, call, id) union all select it + 1, call + 1, id, v, true from pr where call < {repeats} and not {going})) "
        + tail
    )


def _walk_sql(view: str, replicas: int = 1, length: int = 100) -> str:
    draw = lambda slot: uniform_sql(42, "r", "source", "t", slot)
    return (
        _prelude(view)
        + ", adj as materialized (select src, list(dst order by dst) nbrs, count(*) d from edges group by src)"
        + f", wk(t, r, source, cur) as (select 0, r, id, id from nodes, range({replicas}) x(r) union all select t + 1, r, source, case when {draw(0)} < 0.85 then coalesce(nbrs[floor({draw(1)} * d)::bigint + 1], cur) else source end from wk left join adj on adj.src = wk.cur where t < {length})"
        + f" select id, round(count(t)::double / {length * replicas}, 9) as value from nodes left join (select * from wk where t > 0) on cur = id group by id"
    )


def _expected_sql(view: str, length: int = 100) -> str:
    return (
        _prelude(view)
        + ", w2 as materialized (select src, dst, w from w union all select id, id, 1.0 from nodes where id not in (select src from deg))"
        + f", pr(it, id, v) as (select 0, id, 1.0::double from nodes union all select it + 1, id, 0.15 + 0.85 * sum(m) from (select pr.it, w2.dst id, pr.v * w2.w m from pr join w2 on w2.src = pr.id where pr.it < {length} union all select it, id, 0.0 from pr where it < {length}) group by it, id) select id, round(sum(v) / {length}, 9) as value from pr where it > 0 group by id"
    )


def oracle_sql() -> dict[str, str]:
    degree = " select id, count({end})::bigint as degree from nodes left join edges on {end} = id group by id"
    offsets = ", g as (select id, count({end})::bigint degree from nodes left join edges on {end} = id group by id) select id, degree, coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint as first from g"
    out = {
        "out_degree": _prelude("part_chain") + degree.format(end="src"),
        "in_degree": _prelude("cust_supp") + degree.format(end="dst"),
        "dense_ids": _prelude("cust_supp") + " select raw_id, id::bigint as id from ids",
        "remapped_edges": _prelude("cust_supp") + " select src::bigint as src, dst::bigint as dst from edges",
        "csr_offsets": _prelude("part_chain") + offsets.format(end="src"),
        "csc_offsets": _prelude("cust_supp") + offsets.format(end="dst"),
        "adjacency": _prelude("part_chain") + " select src, array_to_string(list(dst order by dst), ',') as nbrs, count(*)::bigint as deg from edges group by src",
        "edge_messages": _prelude("part_chain") + " select e.src, e.dst, round(0.85::double * 0.85 / d, 9) as message from edges e join deg using (src)",
        "sync_step1": _sync_sql("part_chain", 1),
    }
    for view in views.VIEWS:
        out[f"sync_{view}"] = _sync_sql(view, 50)
    after = _async_sql("part_chain", tail="select it::bigint as round, count(*) filter (act) as active from pr where it > 0 group by it")
    first = _async_sql("part_chain", tail="select id, row_number() over (order by id) - 1 as position from pr where it = 1 and act")
    return out | {
        "sync_repeat10_nation_trade": _sync_sql("nation_trade", 500),
        "linf_part_chain": _linf_sql("part_chain"),
        "async_part_chain": _async_sql("part_chain"),
        "async_cust_supp": _async_sql("cust_supp"),
        "async_repeat10_nation_trade": _async_sql("nation_trade", 10),
        "async_active_counts": after,
        "frontier_positions": first,
        "mc_event_type_flow": _walk_sql("event_type_flow"),
        "mc_part_chain": _walk_sql("part_chain"),
        "mc_cust_supp": _walk_sql("cust_supp"),
        "mc_replicas3_nation_trade": _walk_sql("nation_trade", 3),
        "mc_expected_part_chain": _expected_sql("part_chain"),
        "mc_expected_cust_supp": _expected_sql("cust_supp"),
        "sync_broadcast_part_chain": out["sync_part_chain"],
        "sync_shuffle_part_chain": out["sync_part_chain"],
        "linf_shuffle_part_chain": _linf_sql("part_chain"),
        "async_broadcast_part_chain": _async_sql("part_chain"),
        "async_shuffle_part_chain": _async_sql("part_chain"),
        "mc_lockstep_part_chain": _walk_sql("part_chain"),
        "mc_expected_shuffle_cust_supp": _expected_sql("cust_supp"),
        "coo_roundtrip": _prelude("part_chain") + " select src, dst from edges",
        "text_roundtrip": _prelude("part_chain") + ", dense as (select id as raw, row_number() over (order by id) - 1 as id from nodes) select a.id::bigint as src, b.id::bigint as dst from edges join dense a on a.raw = src join dense b on b.raw = dst",
        "parquet_roundtrip": _prelude("part_chain") + " select src, dst from edges",
        "node_rank_lookup": _sync_sql("part_chain", 50, "select id, round(v, 9) as value from pr where it = {n} and id = 1"),
        "rank_top10": _sync_sql("part_chain", 50, "select id, round(v, 9) as value from pr where it = {n} order by round(v, 9) desc, id limit 10"),
    }
