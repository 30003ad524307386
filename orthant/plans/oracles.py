"""The registered queries in DuckDB's SQL, written from the definitions and not from the plans."""

from __future__ import annotations

ITEMS = """
items as (
  select l_partkey as object_id, l_orderkey || '-' || l_linenumber as instance_id, 1e0 / count(*) over (partition by l_partkey) as p,
         (l_partkey % 4)::int as part, l_quantity / 50e0 as a0, l_extendedprice / 100000e0 as a1, l_discount * 10e0 as a2, l_orderkey, l_linenumber
  from lineitem)"""
HIDDEN = """
rows2 as (
  select object_id, instance_id, p, part, a0, case when (l_orderkey * 7 + l_linenumber) % 5 = 0 then null else a1 end as a1,
         'q0' as query_id, l_orderkey, l_linenumber from items)"""
POINTS = {1: "points(query_id, q0, q1, q2) as (values ('q0', 0.2e0, 0.25e0, 0.5e0))", 2: "points(query_id, q0, q1, q2) as (values ('q0', 0.2e0, 0.25e0, 0.5e0), ('q1', 0.35e0, 0.4e0, 0.5e0))"}


def six(x: str) -> str:
    """Six digits by way of nine, in decimals."""
    return f"round(round({x}, 9)::decimal(38, 9), 6)::double"


def dist(source: str = "items") -> str:
    return f"inst as (select points.query_id, x.* exclude (query_id), abs(a0 - q0) as d0, abs(a1 - q1) as d1, abs(a2 - q2) as d2 from (select *, null as query_id from {source}) x, points)"


def dist2(source: str) -> str:
    return f"inst as (select points.query_id, x.object_id, x.instance_id, x.p, x.part, a0, a1, abs(a0 - q0) as d0, abs(a1 - q1) as d1 from {source} x, points)"


def dom(a: str, b: str, dims: int = 2, left: str = "d", right: str = "d") -> str:
    le = " and ".join(f"{a}.{left}{d} <= {b}.{right}{d}" for d in range(dims))
    lt = " or ".join(f"{a}.{left}{d} < {b}.{right}{d}" for d in range(dims))
    return f"({le} and ({lt}))"


def scored(dims: int = 2) -> str:
    return f"""
objects as (select query_id, object_id, count(*) as n_inst, sum(p) as mass, min(part) as part from inst group by all),
won as (select a.query_id, a.object_id, fsum(a.p * b.p) as score,
               fsum(a.p * b.p) filter (where a.part = b.part) as local
        from inst a join inst b on a.query_id = b.query_id and a.object_id <> b.object_id and {dom("a", "b", dims)} group by all),
exact as (select o.*, coalesce(w.score, 0) as score, coalesce(w.local, 0) as local from objects o left join won w using (query_id, object_id))"""


def top(source: str = "exact", columns: str = "query_id, object_id, n_inst, score", k: int = 10) -> str:
    return f"""select {columns}, rank from (
  select *, row_number() over (partition by query_id order by score desc, object_id) as rank
  from (select * replace ({six("score")} as score) from {source})) where rank <= {k}"""


BOUNDS = f"""
masses as (select query_id, part, part_mass, sum(part_mass) over (partition by query_id) as all_mass
           from (select query_id, part, sum(p) as part_mass from inst group by all)),
bounds as (select e.query_id, e.object_id, e.part, e.n_inst, e.mass, e.score, {six("e.local")} as lb,
                  {six("e.local + e.mass * (m.all_mass - m.part_mass)")} as ub
           from exact e join masses m using (query_id, part))"""
TAU = """
tau as (select query_id, part, tau_local, tau_global, greatest(tau_local, tau_global) as tau from
  (select distinct query_id, part from bounds)
  left join (select query_id, part, lb as tau_local from bounds qualify row_number() over (partition by query_id, part order by lb desc) = 10) using (query_id, part)
  left join (select query_id, lb as tau_global from bounds qualify row_number() over (partition by query_id order by lb desc) = 10) using (query_id)),
marked as (select b.*, tau, (tau is null or ub >= tau) as survives from bounds b join tau using (query_id, part))"""


def q(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


BASE1, BASE2 = (ITEMS, POINTS[1], dist()), (ITEMS, POINTS[2], dist())
EXACT2 = (*BASE2, scored())
TOP2 = q(*EXACT2, select=top())

RULES = [(0.15, 0.75, 0.45), (0.18, 0.73, 0.5)]
EXPANDED = """
select object_id, instance_id || '#r' || i as instance_id, round(p * share, 9) as p, round(a0, 9) as a0, round(a1, 9) as a1"""

PAIRS = """
pairs as (select query_id, 1 as target, a1 as y, 0 as determinant, a0 as x from {t} where a0 is not null and a1 is not null
          union all select query_id, 0, a0, 1, a1 from {t} where a0 is not null and a1 is not null),
ranges as (select query_id, target, determinant, count(*) as support, min(x) as lo, max(x) as hi from pairs group by all having count(*) >= 2),
binned as (select p.*, r.support, r.lo, r.hi, case when hi <= lo then 0 else greatest(0, least(7, floor((x - lo) / (hi - lo) * 8)::int)) end as bucket
           from pairs p join ranges r using (query_id, target, determinant)),
observed as (select query_id, 0 as target, a0 as y from {t} where a0 is not null union all select query_id, 1, a1 from {t} where a1 is not null),
tried as (select query_id, target, determinant, lo, hi, support::double / count(distinct bucket) as estimate from binned group by query_id, target, determinant, lo, hi, support
          union all select query_id, target, -1, 0, 1, count(*) from observed group by all),
chosen as (select * from tried qualify row_number() over (partition by query_id, target order by estimate, determinant) = 1),
grouped as (select b.query_id, b.target, b.bucket, b.y from binned b join chosen c using (query_id, target, determinant)
            union all select query_id, target, -1, y from observed),
placed as (select *, row_number() over (partition by query_id, target, bucket order by y) as i, count(*) over (partition by query_id, target, bucket) as n from grouped),
buckets as (select query_id, target, bucket, count(*) as n, avg(y) filter (where i <= greatest(1, n // 2)) as lo_mean, avg(y) filter (where i > greatest(1, n // 2)) as hi_mean,
                   (count(*) filter (where i <= greatest(1, n // 2)))::double / count(*) as p_lo from placed group by query_id, target, bucket)"""
# a0 is never missing here, so only dimension 1 is expanded.
OFFERED = """
offered as (select r.*, coalesce(own.lo_mean, al.lo_mean) as lo_mean, case when own.lo_mean is null then al.hi_mean else own.hi_mean end as hi_mean,
                   coalesce(own.p_lo, al.p_lo) as p_lo
  from {t} r join chosen c on c.query_id = r.query_id and c.target = 1
  left join buckets own on own.query_id = r.query_id and own.target = 1 and c.determinant = 0
       and own.bucket = case when c.hi <= c.lo then 0 else greatest(0, least(7, floor((r.a0 - c.lo) / (c.hi - c.lo) * 8)::int)) end
  join buckets al on al.query_id = r.query_id and al.target = 1 and al.bucket = -1)"""
IMPUTED = """
imputed as (
  select object_id, instance_id || '#r0' as instance_id, p as p, part, a0, a1 from offered where a1 is not null
  union all select object_id, instance_id || '#r0', p * p_lo, part, a0, lo_mean from offered where a1 is null
  union all select object_id, instance_id || '#r1', p * (1 - p_lo), part, a0, hi_mean from offered where a1 is null and hi_mean is not null)"""

EVENTS = """
happened as (select event_id, user_id as object_id, event_id::varchar as instance_id, 1e0 as p, (user_id % 4)::int as part, value / 100e0 as a0,
                    json_extract_string(props, '$.k')::double / 100e0 as a1, event_type, ts from events)"""

BOXES = """
objs as (select object_id, part, min(a0) as lo0, max(a0) as hi0, min(a1) as lo1, max(a1) as hi1, sum(p) as mass, count(*) over (partition by part) as n
         from items group by object_id, part),
cut as (select *, greatest(1, ceil(sqrt(ceil(n / 16.0)))) as slices from objs),
cap as (select *, ceil(n / slices)::bigint as cap from cut),
sl as (select *, (row_number() over (partition by part order by (lo0 + hi0) / 2, object_id) - 1) // cap as slice from cap),
leaves as (select *, (slice * ceil(cap / 16.0) + (row_number() over (partition by part, slice order by (lo1 + hi1) / 2, object_id) - 1) // 16)::bigint as leaf from sl),
node0 as (select part, leaf as node, 0 as level, sum(mass) as mass, count(*) as n_objects, min(lo0) as lo0, max(hi0) as hi0, min(lo1) as lo1, max(hi1) as hi1 from leaves group by all)"""
NODE_DIST = """
boxes as (select query_id, part, level, node, mass, n_objects,
   greatest(lo0 - q0, q0 - hi0, 0) as m0, greatest(abs(lo0 - q0), abs(hi0 - q0)) as x0, greatest(lo1 - q1, q1 - hi1, 0) as m1, greatest(abs(lo1 - q1), abs(hi1 - q1)) as x1
   from {nodes}, points)"""
MET = f"""
met as (select a.query_id, a.object_id, a.instance_id, a.p, b.part as node_part, b.node, b.mass as node_mass, {dom("a", "b", right="m")} as is_full
        from inst a join boxes b on a.query_id = b.query_id and a.part <> b.part and {dom("a", "b", right="x")})"""
INDEX = (*BASE2, BOXES, NODE_DIST.format(nodes="node0"), MET)


def pack(level: int) -> str:
    """The level above, packed from nodes as leaves are from objects."""
    below = f"node{level - 1}"
    return f"""
cut{level} as (select *, greatest(1, ceil(sqrt(ceil(n / 16.0)))) as slices from (select *, count(*) over (partition by part) as n from {below})),
sl{level} as (select *, (row_number() over (partition by part order by (lo0 + hi0) / 2, node) - 1) // ceil(n / slices)::bigint as slice, ceil(n / slices)::bigint as cap from cut{level}),
up{level} as (select *, (slice * ceil(cap / 16.0) + (row_number() over (partition by part, slice order by (lo1 + hi1) / 2, node) - 1) // 16)::bigint as parent from sl{level}),
node{level} as (select part, parent as node, {level} as level, sum(mass) as mass, sum(n_objects) as n_objects, min(lo0) as lo0, max(hi0) as hi0, min(lo1) as lo1, max(hi1) as hi1
                from up{level} where (select max(n) from cut{level}) > 1 group by all)"""


CENTRES = f"""
centres as (select query_id, object_id, part, round(abs(avg(a0) - q0), 9) as d0, round(abs(avg(a1) - q1), 9) as d1 from items, points group by query_id, object_id, part, q0, q1),
over_it as (select a.query_id, a.object_id, count(*) as dominators from centres a join centres b
            on a.query_id = b.query_id and a.part = b.part and a.object_id <> b.object_id and {dom("b", "a")} group by all)"""

# The names of the treatments.
TREATMENT_NAMES = ("baseline", "dscp-only", "aes-only", "aes-dscp", "improved-baseline", "improved-dscp-only", "improved-aes-only", "improved-aes-dscp")

JAVA_HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split(c_name, ''), lambda c: unicode(c)::bigint)), lambda h, c: ((h * 31 + c + 2147483648) & 4294967295) - 2147483648)"


def live(where: str) -> str:
    return q(EVENTS, POINTS[2], f"last_one as (select * from happened where {where} qualify row_number() over (partition by object_id order by ts desc, event_id desc) = 1)", "alive as (select * from last_one where event_type <> 'error')", dist2("alive"), scored(), select=top())


EMBEDDING_DIMS = 64
EMBEDDED = f"inst as (select 'q0' as query_id, label::bigint as object_id, label % 4 as part, 1e0 / count(*) over (partition by label) as p, {', '.join(f'abs(embedding[{d + 1}]::double) as d{d}' for d in range(EMBEDDING_DIMS))} from embeddings)"

# The marks of the improved engine, and what each treatment emits.
IMPROVED = f"""
kept as (select c.query_id, c.object_id from centres c left join over_it using (query_id, object_id) where coalesce(dominators, 0) < 10),
first as (select query_id, lb as tau_star from bounds join kept using (query_id, object_id) qualify row_number() over (partition by query_id order by lb desc, object_id) = 10),
corners as (select query_id, object_id, sum(p) as mass, min(d0) as m0, max(d0) as x0, min(d1) as m1, max(d1) as x1 from inst group by all),
box as (select a.query_id, a.object_id, round(a.mass * sum(b.mass), 6) as box_ub from corners a join corners b on a.query_id = b.query_id and {dom("a", "b", left="m", right="x")} group by a.query_id, a.object_id, a.mass),
reach as (select b.* from bounds b join box using (query_id, object_id) left join first using (query_id) where tau_star is null or box_ub >= tau_star),
tau2 as (select query_id, part, greatest(tau_local, tau_global) as tau from
  (select distinct query_id, part from reach)
  left join (select query_id, part, lb as tau_local from reach qualify row_number() over (partition by query_id, part order by lb desc) = 10) using (query_id, part)
  left join (select query_id, lb as tau_global from reach qualify row_number() over (partition by query_id order by lb desc) = 10) using (query_id)),
marked2 as (select r.*, (tau_star is null or ub >= tau_star) as above, (tau_star is null or ub >= tau_star) and (tau is null or ub >= tau) as survives from reach r join tau2 using (query_id, part) left join first using (query_id)),
counted as (select query_id, part, count(*) as part_objects from objects group by all),
left_over as (
  select query_id, object_id, part, false as dscp, false as improved from bounds
  union all select query_id, object_id, part, true, false from marked where survives
  union all select query_id, object_id, part, false, true from marked2 where above
  union all select query_id, object_id, part, true, true from marked2 where survives),
treated(treatment, dscp, aes, improved) as (values ('baseline', false, false, false), ('dscp-only', true, false, false), ('aes-only', false, true, false), ('aes-dscp', true, true, false),
  ('improved-baseline', false, false, true), ('improved-dscp-only', true, false, true), ('improved-aes-only', false, true, true), ('improved-aes-dscp', true, true, true)),
sizes as (select query_id, count(*) as objects from objects group by all),
metrics as (
  select t.treatment, s.query_id, s.objects, s.objects - count(*) as pruned, count(*) as refined, round((s.objects - count(*)) / s.objects, 6) as prune_ratio,
         (case when t.aes then sum(o.n_inst) else sum(o.n_inst * (c.part_objects - 1)) end)::bigint as emissions
  from treated t join left_over l on l.dscp = t.dscp and l.improved = t.improved join objects o using (query_id, object_id)
  join counted c on c.query_id = l.query_id and c.part = l.part join sizes s on s.query_id = l.query_id group by t.treatment, t.aes, s.query_id, s.objects)"""


def oracle_sql() -> dict[str, str]:
    flat = f"select query_id, object_id, n_inst, {six('score')} as score from exact"
    return {
        "ptd_exact_topk": q(*BASE1, scored(), select=top()),
        "ptd_multi_query_topk": TOP2,
        "ptd_ndim_topk": q(*BASE2, scored(3), select=top()),
        "ptd_score_all_objects": q(*EXACT2, select=flat),
        "ptd_grid_scores": q(*EXACT2, select=flat),
        "ptd_embedding_topk": q(EMBEDDED, scored(EMBEDDING_DIMS), select=top()),
        "dominance_pairs": q(*BASE2, "n as (select query_id, object_id, count(*) as n_inst from inst group by all)", f"w as (select a.query_id, a.object_id, count(*) as c from inst a join inst b on a.query_id = b.query_id and a.object_id <> b.object_id and {dom('a', 'b')} group by all)", select="select query_id, object_id, n_inst, coalesce(c, 0) as n_pairs from n left join w using (query_id, object_id)"),
        "object_mbr_mass": q(ITEMS, select="select object_id, part, count(*) as n_inst, round(sum(p), 6) as mass, min(a0) as lo0, max(a0) as hi0, min(a1) as lo1, max(a1) as hi1, round(round(avg(a0), 12)::decimal(18, 12), 9)::double as c0, round(round(avg(a1), 12)::decimal(18, 12), 9)::double as c1 from items group by object_id, part"),
        "partition_index": q(ITEMS, select="select part, count(distinct object_id) as n_objects, count(*) as n_inst, min(a0) as lo0, max(a0) as hi0, min(a1) as lo1, max(a1) as hi1 from items group by part"),
        "probability_audit": q(*BASE2, select="select query_id, object_id, round(sum(p), 6) as mass, count(distinct part) as n_parts, abs(sum(p) - 1) > 1e-6 as bad_mass, count(distinct part) > 1 as bad_parts from inst group by all"),
        "csv_profile": q(ITEMS, HIDDEN, select="select count(*) as n_rows, count(distinct object_id) as n_objects, count(*) - count(a0) as missing_a0, min(a0) as min_a0, max(a0) as max_a0, count(*) - count(a1) as missing_a1, min(a1) as min_a1, max(a1) as max_a1 from rows2"),
        "missing_profile": q(ITEMS, HIDDEN, select="select part, count(*) as n_rows, count(distinct object_id) as n_objects, count(*) - count(a0) as missing_a0, count(*) - count(a1) as missing_a1, (count(*) - count(a1)) / count(*) as missing_rate from rows2 group by part"),
        "impute_rule_expand": q(ITEMS, HIDDEN, "x as (select object_id, instance_id, p, a0, a1, 0 as i, 1e0 as share from rows2 where a1 is not null union all select object_id, instance_id, p, a0, 0.18e0, 0, 0.5e0 from rows2 where a1 is null union all select object_id, instance_id, p, a0, 0.73e0, 1, 0.5e0 from rows2 where a1 is null)", select=EXPANDED + " from x"),
        "synopsis_determinant_choice": q(ITEMS, HIDDEN, PAIRS.format(t="rows2"), select="select query_id, target, determinant, round(lo, 6) as lo, round(hi, 6) as hi, round(estimate, 6) as estimate from chosen"),
        "synopsis_bucket_candidates": q(ITEMS, HIDDEN, PAIRS.format(t="rows2"), select="select query_id, target, bucket, n, round(lo_mean, 6) as lo, round(hi_mean, 6) as hi, round(p_lo, 6) as p_lo from buckets"),
        "impute_synopsis_expand": q(ITEMS, HIDDEN, PAIRS.format(t="rows2"), OFFERED.format(t="rows2"), IMPUTED, select="select object_id, instance_id, round(p, 9) as p, round(a0, 9) as a0, round(a1, 9) as a1 from imputed"),
        "imputation_mae_holdout": q(
            ITEMS, HIDDEN, "split as (select *, row_number() over (partition by query_id order by l_orderkey, l_linenumber, object_id, a0) % 5 = 0 as held from rows2)", "train as (select * from split where not held)", PAIRS.format(t="train"),
            "cand as (select query_id, target, bucket, lo_mean * p_lo + coalesce(hi_mean, 0) * (1 - p_lo) as expected from buckets)",
            "cells as (select query_id, 0 as target, a0 as actual, a1 as other from split where held union all select query_id, 1, a1, a0 from split where held)",
            "errors as (select s.query_id, abs(actual - coalesce(own.expected, al.expected)) as error from cells s join chosen c using (query_id, target) left join cand own on own.query_id = s.query_id and own.target = s.target and c.determinant >= 0 and s.other is not null and own.bucket = case when c.hi <= c.lo then 0 else greatest(0, least(7, floor((s.other - c.lo) / (c.hi - c.lo) * 8)::int)) end join cand al on al.query_id = s.query_id and al.target = s.target and al.bucket = -1 where actual is not null)",
            select="select query_id, count(*) as n_values, round(avg(error), 6) as mae from errors group by query_id",
        ),
        "ptd_imputed_topk": q(ITEMS, HIDDEN, PAIRS.format(t="rows2"), OFFERED.format(t="rows2"), IMPUTED, POINTS[2], dist2("imputed"), scored(), select=top()),
        "bounds_no_mbr": q(*EXACT2, BOUNDS, select="select query_id, object_id, part, n_inst, round(mass, 6) as mass, lb, ub from bounds"),
        "kth_lower_bound_tau": q(*EXACT2, BOUNDS, TAU, select="select * from tau"),
        "dscp_survivors": q(*EXACT2, BOUNDS, TAU, select="select query_id, object_id, part, lb, ub, tau, survives from marked"),
        "dscp_topk": q(*EXACT2, BOUNDS, select=top("bounds", "query_id, object_id, n_inst, score, lb, ub")),
        "partition_scope_topk": TOP2,
        "object_traces": q(*EXACT2, BOUNDS, TAU, select="select query_id, object_id, part, lb, ub, tau, case when survives then 'survived' else 'pruned-by-dscp' end as decision from marked qualify row_number() over (partition by query_id order by object_id) <= 25"),
        "false_prune_audit": q(*EXACT2, BOUNDS, TAU, "best as (select query_id, object_id from (select *, row_number() over (partition by query_id order by round(score, 6) desc, object_id) as r from exact) where r <= 10)", select="select query_id, count(*) as objects, count(*) filter (where not survives) as pruned, count(*) filter (where survives) as refined, count(*) filter (where not survives and (query_id, object_id) in (select (query_id, object_id) from best)) as false_prunes from marked group by query_id"),
        "emission_counts_aer": q(*BASE2, "g as (select query_id, object_id, part, count(*) as n from inst group by all)", "o as (select *, count(*) over (partition by query_id, part) as others from g)", select="select query_id, sum(n * (others - 1))::bigint as baseline_emissions, sum(n)::bigint as aes_emissions, round(sum(n) / sum(n * (others - 1)), 6) as aer from o group by query_id"),
        "certified_bounds_topk": q(*EXACT2, "best as (select query_id, object_id, max(p) as best from inst group by all)", "c as (select e.query_id, object_id, n_inst, score, round(greatest(score - best, 0), 6) as lb, round(least(sum(mass) over (partition by e.query_id) - mass, score + best), 6) as ub from exact e join best using (query_id, object_id))", select=top("c", "query_id, object_id, n_inst, score, lb, ub")),
        "proxy_candidate_topk": q(*EXACT2, "prox as (select query_id, object_id, round(sum(p * (2 - (d0 + d1))), 6) as proxy from inst group by all)", "near as (select query_id, object_id from prox qualify row_number() over (partition by query_id order by proxy desc, object_id) <= 40)", "few as (select e.* from exact e join near using (query_id, object_id))", select=top("few")),
        "partitioned_candidate_precision": q(*EXACT2, "prox as (select query_id, object_id, part, round(sum(p * (2 - (d0 + d1))), 6) as proxy from inst group by all)", "near as (select query_id, object_id from prox qualify row_number() over (partition by query_id, part order by proxy desc, object_id) <= 10)", "best as (select query_id, object_id from (select *, row_number() over (partition by query_id order by round(score, 6) desc, object_id) as r from exact) where r <= 10)", "guess as (select query_id, object_id from (select e.*, row_number() over (partition by query_id order by round(score, 6) desc, object_id) as r from exact e join near using (query_id, object_id)) where r <= 10)", select="select b.query_id, count(*) as n_exact, count(g.object_id) as hits, round(count(g.object_id) / count(*), 6) as precision from best b left join guess g using (query_id, object_id) group by b.query_id"),
        "str_leaf_assignment": q(ITEMS, BOXES, select="select object_id, part, leaf from leaves"),
        "node_full_partial_mass": q(*INDEX, select="select query_id, object_id, round(coalesce(sum(p * node_mass) filter (where is_full), 0), 6) as full_mass, round(coalesce(sum(p * node_mass) filter (where not is_full), 0), 6) as partial_mass, count(*) filter (where not is_full) as partial_refs from met group by all"),
        "node_emission_counts": q(*INDEX, "partial as (select * from met where not is_full)", select="select query_id, count(*) as baseline_emissions, count(distinct (object_id, instance_id, node_part)) as aes_emissions, round(count(distinct (object_id, instance_id, node_part)) / count(*), 6) as aer from partial group by query_id"),
        "leaf_upper_bounds": q(*INDEX, select=f"select a.query_id, a.part, a.node, round(sum(b.mass), 6) as leaf_ub from boxes a join boxes b on a.query_id = b.query_id and {dom('a', 'b', left='m', right='x')} group by all"),
        "export_level_cost": q(
            *BASE2, BOXES, pack(1), pack(2), pack(3), "every as (select * from node0 union all select * from node1 union all select * from node2 union all select * from node3)", NODE_DIST.format(nodes="every"),
            "numbered as (select *, row_number() over (partition by query_id order by object_id, instance_id) - 1 as nr, ceil(count(*) over (partition by query_id) / 256.0) as step from inst)",
            f"refs as (select b.query_id, b.level, count(*) as partial_refs, sum(b.n_objects)::bigint as objects_under from numbered a join boxes b on a.nr % a.step = 0 and a.query_id = b.query_id and a.part <> b.part and {dom('a', 'b', right='x')} and not {dom('a', 'b', right='m')} group by all)",
            "sizes as (select query_id, level, count(*) as nodes from boxes group by all)",
            "cost as (select query_id, level, nodes, coalesce(partial_refs, 0) as partial_refs, coalesce(objects_under, 0) as objects_under, coalesce(partial_refs, 0) + nodes + coalesce(objects_under, 0) as cost from sizes left join refs using (query_id, level))",
            select="select *, row_number() over (partition by query_id order by cost, level) = 1 as chosen from cost",
        ),
        "indexed_topk": TOP2,
        "centroid_skyline": q(ITEMS, POINTS[2], CENTRES, select="select query_id, object_id, part, coalesce(dominators, 0) as dominators, coalesce(dominators, 0) < 10 as kept from centres left join over_it using (query_id, object_id)"),
        "hgtp_topk": TOP2,
        "treatment_matrix": q(*BASE1, scored(), f"best as ({top()})", select=f"select treatment, query_id, object_id, score, rank from best, (values {', '.join(f'({t!r})' for t in TREATMENT_NAMES)}) t(treatment)"),
        "treatment_emissions": q(*EXACT2, BOUNDS, TAU, CENTRES, IMPROVED, select="select * from metrics"),
        "run_averages": q(*EXACT2, BOUNDS, TAU, CENTRES, IMPROVED, select="select treatment, count(*) as queries, round(avg(objects), 6) as avg_objects, round(avg(pruned), 6) as avg_pruned, round(avg(refined), 6) as avg_refined, round(avg(prune_ratio), 6) as avg_prune_ratio, round(avg(emissions), 6) as avg_emissions from metrics where treatment in ('baseline', 'aes-dscp') group by treatment"),
        "best_first_survivors": q(
            *EXACT2, BOUNDS, BOXES, NODE_DIST.format(nodes="node0"),
            f"reached as (select a.query_id, a.part, a.node, sum(b.mass) as leaf_ub from boxes a join boxes b on a.query_id = b.query_id and {dom('a', 'b', left='m', right='x')} group by all)",
            "heavy as (select part, leaf as node, max(mass) as heaviest, count(*) as n_objects from leaves group by all)",
            "kth as (select query_id, lb as tau from bounds qualify row_number() over (partition by query_id order by lb desc, object_id) = 10)",
            "bounded as (select r.query_id, part, node, n_objects, round(leaf_ub * heaviest, 6) as bound from reached r join heavy using (part, node))",
            select="select b.query_id, part, node, n_objects, bound, tau, (tau is null or bound >= tau) as visited from bounded b left join kth using (query_id)",
        ),
        "impute_with_deletes": q(EVENTS, "r as (select *, case when event_id % 5 = 0 then null else a1 end as b1, event_type = 'error' as gone from happened)", select="select object_id, instance_id || '#r0' as instance_id, 'UPSERT' as op_type, p, round(a0, 9) as a0, round(b1, 9) as a1 from r where not gone and b1 is not null union all select object_id, instance_id || '#r0', 'UPSERT', p * 0.5e0, round(a0, 9), 0.18e0 from r where not gone and b1 is null union all select object_id, instance_id || '#r1', 'UPSERT', p * 0.5e0, round(a0, 9), 0.73e0 from r where not gone and b1 is null union all select object_id, instance_id, 'DELETE', null, null, null from r where gone"),
        "own_query_instances": q(ITEMS, POINTS[2], "mine as (select p2.query_id, x.object_id, x.p, abs(x.a0 - p2.q0) as d0, abs(x.a1 - p2.q1) as d1 from items x join points p2 on x.l_orderkey % 3 = 0 or p2.query_id = 'q' || (x.l_orderkey % 3 - 1))", select="select query_id, object_id, count(*) as n_inst, round(sum(p), 6) as mass, min(d0) as m0, max(d1) as x1 from mine group by all"),
        "csv_events_scan": "select 'q' || (event_id % 2) as query_id, case when event_type = 'error' then 'DELETE' else 'UPSERT' end as op_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n_rows, count(distinct user_id) as n_objects, count(*) filter (where event_id % 5 = 0) as missing_a1, min(value) as min_a0, max(value) as max_a0 from events group by all",
        "sql_dominates": q(ITEMS, "t as (select *, a0 <= 0.5 and a1 <= 0.4 and a2 <= 0.5 and (a0 < 0.5 or a1 < 0.4 or a2 < 0.5) as below, a0 >= 0.5 and a1 >= 0.4 and a2 >= 0.5 and (a0 > 0.5 or a1 > 0.4 or a2 > 0.5) as above from items)", select="select object_id, count(*) as n_inst, count(*) filter (where below) as n_below, count(*) filter (where above) as n_above from t group by object_id"),
        "latest_upsert_topk": live("true"),
        "window_live_topk": live("ts >= (select max(ts) from happened) - interval 30 days"),
        "events_json_decode": "select event_id, user_id::varchar as object_id, 'q0' as query_id, case when event_type = 'error' then 'DELETE' else 'UPSERT' end as op_type, 1e0 as p, -1 as server_partition, epoch_us(ts) // 1000 as millis, value as a0, case when event_type <> 'view' then json_extract_string(props, '$.k')::double end as a1, (event_type = 'view' or json_extract_string(props, '$.k') is null) as missing_a1 from events",
        "default_query_points": "select 'q' || n_nationkey as query_id, round(least(1, greatest(0, 0.2e0 + n_nationkey * 0.15e0)), 9) as q0, round(least(1, greatest(0, 0.2e0 + n_nationkey * 0.15e0 + 0.05e0)), 9) as q1, round(least(1, greatest(0, 0.2e0 + n_nationkey * 0.15e0 + 0.1e0)), 9) as q2 from nation",
        "java_hash_partition": f"select c_custkey, {JAVA_HASH} as hash, ((({JAVA_HASH}) % 8 + 8) % 8)::int as part from customer",
    }
