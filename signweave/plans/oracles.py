"""DuckDB statements for the queries, put together from named steps."""

from __future__ import annotations

from signweave.functions.mixhash import draw_np
from signweave.operators.states import KEYS

from .queries import CONSENSUS_ITERATIONS, ITERATIONS, STEPS

_FLAG = "case l_returnflag when 'R' then -1 when 'A' then 1 else 0 end"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"
_LONG = f"{_ORDER}, l_extendedprice, l_discount, l_tax, l_shipdate"

RAW = {
    "events": """select seq, src, dst, sign from (select row_number() over (order by ts, event_id) - 1 as seq, user_id as src,
        lead(user_id) over (order by ts, event_id) as dst,
        case event_type when 'error' then -1 when 'signup' then 2 when 'view' then 0 else 1 end as sign from events) where dst is not null""",
    "custpart": f"""select row_number() over (order by {_ORDER}) - 1 as seq, o_custkey * 2 as src, l_partkey * 2 + 1 as dst, {_FLAG} as sign
        from lineitem join orders on l_orderkey = o_orderkey where l_quantity >= 45 and l_discount >= 0.07""",
    "nation": f"""select row_number() over (order by {_LONG}) - 1 as seq, c_nationkey as src, s_nationkey as dst, {_FLAG} as sign
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey""",
    "custsupp": f"""select row_number() over (order by {_LONG}) - 1 as seq, o_custkey * 2 as src, l_suppkey * 2 + 1 as dst,
        cast(floor((l_quantity - 1) / 10) as integer) - 2 as sign from lineitem join orders on l_orderkey = o_orderkey""",
}


def mix(x: str) -> str:
    """The 32-bit mix hash of an expression."""
    for _ in range(2):
        x = f"((xor(({x}) >> 16, ({x})) * 73244475) & 4294967295)"
    return f"xor(({x}) >> 16, ({x}))"


def steps(name: str, iterations: int) -> dict[str, str]:
    """Named steps in order; each uses those before it."""
    return {
        "raw": RAW[name],
        "valid": "select seq, least(src, dst) as u, greatest(src, dst) as v, sign from raw where src <> dst and sign between -1 and 1",
        "firsts": "select u, v, min(seq) as seq, arg_min(sign, seq) as sign from valid group by u, v",
        "reach": """select u as node, u as low from firsts union select v, v from firsts
            union select e.b, r.low from reach r join (select u as a, v as b from firsts union all select v, u from firsts) e on e.a = r.node where r.low < e.b""",
        "labels": "select node, min(low) as component from reach group by node",
        "sizes": "select component, count(*) as nodes from labels group by component",
        "largest": """select component from sizes join (select component, min(seq) as seq from firsts join labels on u = node group by component) using (component)
            order by nodes desc, seq limit 1""",
        "kept": "select f.* from firsts f join labels on u = node join largest using (component)",
        "seen": "select u as orig_id, row_number() over (order by u, v) * 2 as place from kept union all select v, row_number() over (order by u, v) * 2 + 1 from kept",
        "nodes": "select row_number() over (order by min(place)) - 1 as nid, orig_id from seen group by orig_id",
        "edges": """select least(a.nid, b.nid) as u, greatest(a.nid, b.nid) as v, case when sign = -1 then -1 else 1 end as sign
            from kept join nodes a on u = a.orig_id join nodes b on v = b.orig_id""",
        "adj": "select u as src, v as dst, sign from edges union all select v, u, sign from edges",
        "degrees": "select src as nid, count(*) as degree from adj group by src",
        "roots": "select row_number() over (order by degree desc, nid) - 1 as k, nid from degrees",
        "starts": f"select iter, nid from (select unnest(range({iterations})) as iter) join roots on k = iter % (select count(*) from nodes)",
        "walk": "select iter, nid, 0 from starts union select w.iter, a.dst, w.level + 1 from walk w join adj a on a.src = w.node left join recurring.walk r on r.iter = w.iter and r.node = a.dst where r.node is null",
        "levels": "select iter, node, level from walk",
        "offers": """select c.iter, c.node, p.node as parent, a.sign, c.level, (p.node << 2) | ((p.level & 1) | 2) as tag,
            (c.iter + 17) * (c.iter + 17) + (c.iter + 17) as seed2 from levels c join adj a on a.src = c.node join levels p on p.iter = c.iter and p.node = a.dst and p.level = c.level - 1""",
        "hashed": f"select *, {mix('xor(xor(tag, node), seed2) & 4294967295')} as h from offers",
        "parents": "select iter, node, parent, sign, level from (select *, row_number() over (partition by iter, node order by case when h >= 2147483648 then h - 4294967296 else h end desc, tag desc) as best from hashed) where best = 1",
        # the queue of shuffled neighbours
        "drawn_iter": f"select iter, {mix('xor(' + mix('17') + ', ' + mix('(iter + 1)') + ')')} as h from starts",
        "drawn_src": f"select iter, nid as src, {mix('xor(h, ' + mix('(nid + 1)') + ')')} as h from drawn_iter, nodes",
        "shuffled": f"select iter, src, dst, sign, {mix('xor(h, ' + mix('(dst + 1)') + ')')} as h from adj join drawn_src using (src)",
        "queued": """select iter, nid as node, 0::bigint as level, 1::bigint as s, 0::bigint as place from starts
            union all select iter, node, level, s, row_number() over (partition by iter order by above, h, node) from (select q.iter, t.dst as node, q.level + 1 as level, q.s * t.sign as s, q.place as above, t.h,
            row_number() over (partition by q.iter, t.dst order by q.place) as best from queued q join shuffled t on t.iter = q.iter and t.src = q.node join levels l on l.iter = q.iter and l.node = t.dst and l.level = q.level + 1) where best = 1""",
        "signs": "select iter, nid as node, 1 as s, 0 as level from starts union all select p.iter, p.node, p.sign * s.s, p.level from signs s join parents p on p.iter = s.iter and p.parent = s.node",
        "states": "select a.iter, u, v, sign, a.s as su, b.s as sv, a.s <> b.s as minus from edges join signs a on a.node = u join signs b on b.node = v and b.iter = a.iter",
        "switches": "select iter, sum(case when minus <> (sign = -1) then 1 else 0 end) as switches from states group by iter",
        # ids are below 2^32 here, so the draw of their upper half is a constant
        "node_mixed": f"select nid, {mix('(nid + 1)')} as m from nodes",
        "node_draws": "select nid, " + ", ".join(f"{mix(f'xor({int(draw_np(k, 0))}, m)')} as d{k}" for k in KEYS) + " from node_mixed",
        "keys": "select iter, concat_ws('-', " + ", ".join(f"sum(case when s <> s0 then d{k} else 0 end)::bigint" for k in KEYS) + ") as state_key from signs join (select iter, s as s0 from signs where node = 0) using (iter) join node_draws on nid = node group by iter",
        "cloud": "select state_key, count(*) as frequency, min(switches) as switches from keys join switches using (iter) group by state_key",
        "same": "select iter, u as a, v as b from states where not minus union all select iter, v, u from states where not minus",
        "joined": "select iter, node, node as low from signs union select j.iter, e.b, j.low from joined j join same e on e.iter = j.iter and e.a = j.node where j.low < e.b",
        "components": "select iter, node, min(low) as component from joined group by iter, node",
        "quotient": "select distinct iter, least(a.component, b.component) as a, greatest(a.component, b.component) as b from states join components a using (iter) join components b using (iter) where minus and a.node = u and b.node = v",
        "source": "select iter, component from (select iter, component, row_number() over (partition by iter order by count(*) desc, component) as best from components group by iter, component) where best = 1",
        "hopped": """select iter, component, 0 from source union select h.iter, q.b, h.hops + 1 from hopped h
            join (select iter, a, b from quotient union all select iter, b, a from quotient) q on q.iter = h.iter and q.a = h.component
            left join recurring.hopped r on r.iter = h.iter and r.component = q.b where r.component is null""",
        "hops": "select iter, component, hops from hopped",
        "sides": "select iter, node, hops % 2 = 0 as side from components join hops using (iter, component)",
        "marks": """select u, v, sum(case when a.side and b.side then 1 else 0 end) as agreement, sum(case when minus = (sign = -1) then 1 else 0 end) as resolution
            from states t join sides a on a.iter = t.iter and a.node = u join sides b on b.iter = t.iter and b.node = v group by u, v""",
        "status": "select node, sum(case when side then 1 else 0 end) as on_side from sides group by node",
    }


#: Recursive steps that keep the first row of each key.
KEYED = {"walk": "(iter, node, level) using key (iter, node)", "hopped": "(iter, component, hops) using key (iter, component)"}


def statement(select: str, upto: str, name: str = "events", iterations: int = ITERATIONS, more: dict[str, str] | None = None) -> str:
    """The select over the steps up to the one named; graphs known to hang together still
    go through the component steps."""
    chosen = {}
    for step, body in steps(name, iterations).items():
        chosen[step] = body
        if step == upto:
            break
    chosen |= more or {}
    # only what is used, directly or through another step
    used, text = set(), [select]
    while text:
        part = text.pop()
        for step in chosen:
            if step not in used and step in part.replace("(", " ").replace(")", " ").replace(",", " ").split():
                used.add(step)
                text.append(chosen[step])
    return "with recursive " + ",\n".join(f"{step}{KEYED.get(step, '')} as ({body})" for step, body in chosen.items() if step in used) + "\n" + select


_C = {"iterations": CONSENSUS_ITERATIONS}
_ITER = "cast(iter as integer) as iter"

ORACLES = {
    "frustration_index": statement("select cast(min(switches) as bigint) as frustration_index from switches", "switches"),
    "edge_classes": statement(
        """select r.seq, r.src, r.dst, r.sign, case when r.src = r.dst then 'self' when r.sign not between -1 and 1 then 'range'
        when r.seq = f.seq then 'kept' when r.sign = f.sign then 'dup' else 'inconsistent' end as class
        from raw r left join firsts f on f.u = least(r.src, r.dst) and f.v = greatest(r.src, r.dst)""",
        "firsts",
    ),
    "clean_edges": statement("select seq, u, v, sign from firsts", "firsts"),
    "undirected_degree": statement("select nid, degree from degrees", "degrees"),
    "negative_share": statement("select cast(sum(case when sign = -1 then 1 else 0 end) as bigint) as negative, count(*) as edges, sum(case when sign = -1 then 1 else 0 end)::double / count(*) as share from edges", "edges"),
    "adjacency_lists": statement("select src as nid, string_agg(dst::varchar, ',' order by dst) as neighbours, string_agg(sign::varchar, ',' order by dst) as signs from adj group by src", "adj"),
    "root_order": statement(f"select k, nid from roots where k < {ITERATIONS}", "roots"),
    "component_labels": statement("select node, component from labels", "labels", "custpart"),
    "component_sizes": statement("select component, nodes from sizes", "sizes", "custpart"),
    "largest_component": statement("select u, v, sign from kept", "kept", "custpart"),
    "dense_ids": statement("select nid, orig_id from nodes", "nodes"),
    "edges_dense": statement("select u, v, sign from edges", "edges"),
    "bfs_levels": statement(f"select {_ITER}, node, cast(level as integer) as level from levels", "levels"),
    "bfs_parents": statement(f"select {_ITER}, node, parent from parents", "parents"),
    "bfs_signs": statement(f"select {_ITER}, node, cast(s as integer) as s from signs", "signs"),
    "bfs_switches": statement(f"select {_ITER}, cast(switches as bigint) as switches from switches", "switches"),
    "nation_bfs_switches": statement(f"select {_ITER}, cast(switches as bigint) as switches from switches", "switches", "nation"),
    "custpart_bfs_switches": statement(f"select {_ITER}, cast(switches as bigint) as switches from switches", "switches", "custpart"),
    "min_states": statement("select count(*) as states, cast(min(switches) as bigint) as switches from cloud where switches = (select min(switches) from cloud)", "cloud"),
    "cloud": statement("select state_key, frequency, cast(switches as bigint) as switches from cloud", "cloud"),
    "cloud_best": statement("select state_key, frequency, cast(switches as bigint) as switches from cloud order by switches, state_key limit 5", "cloud"),
    "states_csv": statement("""select cast(row_number() over (order by state_key) as integer) as "Balanced State ID", frequency as "Frequency", cast(switches as bigint) as "Frustration Index" from cloud""", "cloud"),
    "report_lines": statement(
        f"""select 1::bigint as line_no, 'Frustration Index ({ITERATIONS} iterations): ' || min(switches)::bigint as line from cloud
        union all select 2, '# of Unique Balanced States With Minimum Number of Switches: ' || count(*) from cloud where switches = (select min(switches) from cloud)
        union all select 3, '' union all select 4, 'Detailed Analysis:'
        union all select row_number() over (order by state_key) + 4, '# of Switches of Balanced State #' || row_number() over (order by state_key) || ': ' || switches::bigint from cloud
        union all select count(*) + 5, 'Minimum # of Switches after {ITERATIONS} iteration(s): ' || min(switches)::bigint from cloud""",
        "cloud",
    ),
    "tree_edge_counts": statement(
        "select e.u, e.v, count(p.iter) as in_tree from edges e left join parents p on (p.node = e.u and p.parent = e.v) or (p.node = e.v and p.parent = e.u) group by e.u, e.v", "parents"
    ),
    "neg_edge_counts": statement("select u, v, cast(sum(case when minus then 1 else 0 end) as bigint) as negative from states group by u, v", "states"),
    "subtree_sizes": statement(
        f"select {_ITER}, over_node as node, count(*) as size from above group by iter, over_node",
        "parents",
        more={"above": "select iter, node, node as over_node from levels union all select a.iter, a.node, p.parent from above a join parents p on p.iter = a.iter and p.node = a.over_node"},
    ),
    "preorder_ranges": statement(
        f"select {_ITER}, node, begin_at::bigint as begin, (begin_at + size - 1)::bigint as finish from begins join sizes_below using (iter, node)",
        "parents",
        more={
            "above": "select iter, node, node as over_node from levels union all select a.iter, a.node, p.parent from above a join parents p on p.iter = a.iter and p.node = a.over_node",
            "sizes_below": "select iter, over_node as node, count(*) as size from above group by all",
            "steps_down": "select iter, p.node, 1 + coalesce(sum(size) over (partition by iter, parent order by p.node rows between unbounded preceding and 1 preceding), 0) as step from parents p join sizes_below using (iter, node)",
            "begins": "select a.iter, a.node, coalesce(sum(step), 0) as begin_at from above a left join steps_down s on s.iter = a.iter and s.node = a.over_node group by all",
        },
    ),
    "states_by_edge_string": statement(
        """select row_number() over (order by state_key)::integer as "Balanced State ID", frequency as "Frequency", switches::bigint as "Frustration Index"
        from (select state_key, count(*) as frequency, min(switches) as switches from texts join switches using (iter) group by state_key)""",
        "switches",
        more={"texts": "select iter, string_agg(a.orig_id || '-->' || b.orig_id || ':' || minus::integer || ' | ', '' order by a.orig_id, b.orig_id) as state_key from states join nodes a on a.nid = u join nodes b on b.nid = v group by iter"},
    ),
    "pos_components": statement(f"select {_ITER}, node, component from components", "components", **_C),
    "cc_quotient": statement(f"select {_ITER}, a, b from quotient", "quotient", **_C),
    "cc_hops": statement(f"select {_ITER}, component, cast(hops as integer) as hops from hops", "hops", **_C),
    "sides": statement(f"select {_ITER}, node, side from sides", "sides", **_C),
    "consensus_edges": statement(
        f"""select least(a.orig_id, b.orig_id) as u, greatest(a.orig_id, b.orig_id) as v, agreement::double / {CONSENSUS_ITERATIONS} as agreement,
        (x.on_side + y.on_side)::double / {2 * CONSENSUS_ITERATIONS} as authority, resolution::double / {CONSENSUS_ITERATIONS} as resolution
        from marks m join nodes a on a.nid = m.u join nodes b on b.nid = m.v join status x on x.node = m.u join status y on y.node = m.v""",
        "status",
        **_C,
    ),
    "consensus_nodes": statement(
        f"""select orig_id, on_side::double / {CONSENSUS_ITERATIONS} as status, a::double / (degree * {CONSENSUS_ITERATIONS}) as influence, r::double / (degree * {CONSENSUS_ITERATIONS}) as strength
        from nodes join status on node = nid join degrees using (nid)
        join (select nid, sum(agreement) as a, sum(resolution) as r from (select u as nid, agreement, resolution from marks union all select v, agreement, resolution from marks) group by nid) using (nid)""",
        "status",
        **_C,
    ),
    "enhanced_history": statement(
        f"select {_ITER}, cast(switches as bigint) as frustration from switches", "switches", more={"starts": f"select iter, iter % (select count(*) from nodes) as nid from (select unnest(range({ITERATIONS})) as iter)", "signs": "select iter, node, s, level from queued"}
    ),
}
for _name, _graph in (("load_stats", "events"), ("load_stats_custsupp", "custsupp")):
    ORACLES[_name] = statement(
        """select class, count(*) as n from (select case when r.src = r.dst then 'self' when r.sign not between -1 and 1 then 'range'
        when r.seq = f.seq then 'kept' when r.sign = f.sign then 'dup' else 'inconsistent' end as class
        from raw r left join firsts f on f.u = least(r.src, r.dst) and f.v = greatest(r.src, r.dst)) group by class""",
        "firsts",
        _graph,
    )
for _name, _graph in (("gradient_history", "events"), ("gradient_history_nation", "nation")):
    ORACLES[_name] = statement(
        f"""select cast(a.iter as integer) as iter, sum(case when (case when a.x >= 0 then 1 else -1 end) * (case when b.x >= 0 then 1 else -1 end) * sign = -1 then 1 else 0 end)::bigint as frustration
        from edges join relaxed a on a.node = u join relaxed b on b.node = v and b.iter = a.iter group by a.iter""",
        "adj",
        _graph,
        more={
            "relaxed": f"""select 0 as iter, nid as node, 2.0::double * {mix('(nid + 1)')} / 4294967296::double - 1 as x from nodes
            union all select x.iter + 1, x.node, x.x + 0.0005::double * sum(y.x * a.sign) from relaxed x join adj a on a.src = x.node join relaxed y on y.node = a.dst
            where x.iter < {STEPS - 1} group by x.iter, x.node, x.x"""
        },
    )
_W = {
    "drawn_u": f"select iter, u, v, {mix('xor(xor(' + mix('17') + ', 0), ' + mix('(iter + 1)') + ')')} as h from edges, (select unnest(range(2)) as iter)",
    "drawn_uv": f"select iter, u, v, {mix('xor(h, ' + mix('(u + 1)') + ')')} as hu, {mix('xor(h, ' + mix('(v + 1)') + ')')} as hv from drawn_u",
    "weighted": f"select iter, u, v, least({mix('xor(hu, ' + mix('(v + 1)') + ')')} % (2 * (select count(*) from edges)), {mix('xor(hv, ' + mix('(u + 1)') + ')')} % (2 * (select count(*) from edges))) + 1 as w from drawn_uv",
    "placed": "select *, row_number() over (partition by iter order by w, u, v) as place from weighted",
    # an edge is in the tree unless lighter edges already join its ends
    "lighter": "select iter, place, u as node from placed union select l.iter, l.place, case when p.u = l.node then p.v else p.u end from lighter l join placed p on p.iter = l.iter and p.place < l.place and (p.u = l.node or p.v = l.node)",
    "mst": "select p.iter, p.u, p.v, p.w from placed p where not exists (select 1 from lighter l where l.iter = p.iter and l.place = p.place and l.node = p.v)",
}
ORACLES["kruskal_tree"] = statement(f"select {_ITER}, u, v, w from mst", "edges", "nation", more=_W)
ORACLES["mst_weight"] = statement(f"select {_ITER}, cast(sum(w) as bigint) as weight from mst group by iter", "edges", "nation", more=_W)
