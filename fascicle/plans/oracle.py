"""SQL for the queries of :mod:`fascicle.plans.queries`, from common parts."""

from __future__ import annotations

L = """lat as (
    select vec_id as sid, "label" as src, cast(embedding[1:32] as double[]) as z_fwd, cast(embedding[33:64] as double[]) as z_rev from embeddings
)"""
#: Means by dimension, put together again in order.
C = """dims as (
    select src, d, avg(z_fwd[d]) as f, avg(z_rev[d]) as r from lat, range(1, 33) t(d) group by src, d
), cen as (
    select cast(row_number() over (order by src) as int) as "label", list(f order by d) as c, list(r order by d) as cr from dims group by src
)"""


def d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"


S = f"""dist as (
    select sid, "label", {d2("z_fwd", "c")} as f, {d2("z_rev", "c")} as r from lat, cen
), best as (
    select sid, min(f) as f, min(r) as r, arg_min("label", (f, "label")) as lf, arg_min("label", (r, "label")) as lr from dist group by sid
), scored as (
    select sid, sqrt(case when f < r then f else r end) * 0.08 as score, case when f < r then lf else lr end as "label", f < r as forward from best
)"""
P = """pts as (
    select l_orderkey as sid, l_quantity as x, l_extendedprice / 1000 as y, l_discount * 100 as z,
           row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos,
           count(*) over (partition by l_orderkey) as n
    from lineitem
)"""
R6 = "round({0}, 6) + 0.0"


def r6(x: str) -> str:
    return R6.format(x)


XYZ = ", ".join(f"{r6(c)} as {c}" for c in "xyz")

#: Arc-length resampling to 16 points: the segment that holds each target length.
RES = """seg as (
    select sid, pos, n, x, y, z, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2 from pts window w as (partition by sid order by pos)
), run as (
    select *, coalesce(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) + (z2 - z) * (z2 - z)), 0) as len from seg
), cum as (
    select *, sum(len) over (partition by sid order by pos) - len as s0, sum(len) over (partition by sid) as total from run
), tgt as (
    select c.sid, g as pos, c.total, c.total * g / 15 as t, c.x as fx, c.y as fy, c.z as fz from cum c, range(0, 16) q(g) where c.pos = 0
), hit as (
    select t.sid, t.pos, t.total, t.fx, t.fy, t.fz, t.t, max(c.pos) as seg
    from tgt t left join cum c on c.sid = t.sid and c.len > 0 and c.s0 <= t.t group by all
), res as (
    select h.sid, h.pos,
           case when h.total > 0 then c.x + (c.x2 - c.x) * least((h.t - c.s0) / c.len, 1) else h.fx end as x,
           case when h.total > 0 then c.y + (c.y2 - c.y) * least((h.t - c.s0) / c.len, 1) else h.fy end as y,
           case when h.total > 0 then c.z + (c.z2 - c.z) * least((h.t - c.s0) / c.len, 1) else h.fz end as z
    from hit h left join cum c on c.sid = h.sid and c.pos = h.seg
)"""
ENC = """axes as (
    select sid, pos, 0 as a, x as v from res union all select sid, pos, 1, y from res union all select sid, pos, 2, z from res
), enc as (
    select sid, a, k, sum(v * cos(pi() * (2 * pos + 1) * k / 32)) * case when k = 0 then sqrt(1.0 / 16) else sqrt(2.0 / 16) end as c
    from axes, range(0, 5) q(k) group by sid, a, k
)"""
DEC = """dec as (
    select sid, a, j as pos, sum(c * cos(pi() * (2 * j + 1) * k / 32) * case when k = 0 then sqrt(1.0 / 16) else sqrt(2.0 / 16) end) as v
    from enc, range(0, 16) q(j) group by sid, a, j
), back as (
    select sid, pos, max(v) filter (a = 0) as x, max(v) filter (a = 1) as y, max(v) filter (a = 2) as z from dec group by sid, pos
)"""


def threes(e: str) -> str:
    return f"list_transform(range(0, 21), lambda i: [{e}[3 * i + 1], {e}[3 * i + 2], {e}[3 * i + 3]])"


def p2(a: str, b: str) -> str:
    return f"sqrt(({a}[1] - {b}[1]) * ({a}[1] - {b}[1]) + ({a}[2] - {b}[2]) * ({a}[2] - {b}[2]) + ({a}[3] - {b}[3]) * ({a}[3] - {b}[3]))"


LP = f"""latp as (
    select a.sid as i, b.sid as j,
           sqrt(least({d2("a.z_fwd", "b.z_fwd")}, {d2("a.z_fwd", "b.z_rev")})) as one_sided,
           sqrt(least({d2("a.z_fwd", "b.z_fwd")}, {d2("a.z_fwd", "b.z_rev")}, {d2("a.z_rev", "b.z_fwd")}, {d2("a.z_rev", "b.z_rev")})) as two_sided
    from lat a join lat b on a.sid > b.sid
)"""
TRI = f"""tri as (
    select vec_id as sid, {threes("cast(embedding as double[])")} as p, list_reverse({threes("cast(embedding as double[])")}) as q from embeddings
)"""
GEO = f"""geo as (
    select a.sid as i, b.sid as j,
           greatest(list_max(list_transform(a.p, lambda u: list_min(list_transform(b.p, lambda v: {p2("u", "v")})))),
                    list_max(list_transform(b.p, lambda u: list_min(list_transform(a.p, lambda v: {p2("u", "v")}))))) as hausdorff,
           least(list_avg(list_transform(list_zip(a.p, b.p), lambda w: {p2("w[1]", "w[2]")})),
                 list_avg(list_transform(list_zip(a.p, b.q), lambda w: {p2("w[1]", "w[2]")}))) as mdf
    from tri a join tri b on a.sid > b.sid
)"""
GP = f"{TRI}, {GEO}"
REPORT = f"""{r6('corr(hausdorff, one_sided)')} as r_hausdorff, {r6('corr(mdf, one_sided)')} as r_mdf, {r6('corr(hausdorff, two_sided)')} as r_hausdorff_two, {r6('corr(mdf, two_sided)')} as r_mdf_two,
               {r6('avg(hausdorff / nullif(one_sided, 0))')} as scale_hausdorff, {r6('avg(mdf / nullif(one_sided, 0))')} as scale_mdf,
               count(*) filter (one_sided = 0) as skipped, count(*) as pairs"""


def in_order(quota: str) -> str:
    """Rows with their batch and their place in the order of all."""
    return f"""cnt as (
        select src, count(*) as n from lat group by src
    ), base as (
        select src, n, greatest(1, n * {quota} // (select count(*) from lat)) as q, row_number() over (order by src) as nth from cnt
    ), quo as (
        select src, q + case when nth <= {quota} - (select sum(q) from base) then 1 else 0 end as q from base
    ), ord as (
        select sid, z_fwd, z_rev, b, row_number() over (order by b, src, sid) as k from (
            select l.*, (row_number() over (partition by l.src order by sid) - 1) // q as b from lat l join quo using (src))
    )"""


def leader_in_splits(quota: int, size: int) -> str:
    """As ``leader``, but the rows of a batch that centres of earlier batches leave open are cut into splits of ``size``, and L holds within a split only.

    ``s`` is the place at which the split of the row began, ``n`` the open rows of its batch so far.
    """
    return f"""with recursive {L}, {in_order(str(quota))}, firsts as (
        select b, min(k) as first from ord group by b
    ), adj as (
        select i.k, any_value(f.first) as first, coalesce(list(c.k) filter (list_distance(i.z_fwd, c.z_fwd) < 0.85 or list_distance(i.z_rev, c.z_fwd) < 0.85), []::bigint[]) as g,
               coalesce(list(c.k) filter (list_distance(i.z_fwd, c.z_fwd) < 0.85 or list_distance(i.z_fwd, c.z_rev) < 0.85), []::bigint[]) as l
        from ord i join firsts f using (b) left join ord c on c.k < i.k group by i.k
    ), walk as (
        select 0::bigint as k, []::bigint[] as kept, 0::bigint as n, 0::bigint as s
        union all
        select k, case when covered or len(list_filter(list_intersect(kept, l), lambda x: x >= s2)) > 0 or len(list_filter(list_intersect(kept, g), lambda x: x < s2)) > 0 then kept else list_append(kept, k) end,
               n0 + case when covered then 0 else 1 end, s2
        from (select *, case when not covered and n0 % {size} = 0 then k else s end as s2 from (
            select a.k, a.g, a.l, w.kept, w.s, case when a.k = a.first then 0 else w.n end as n0, len(list_filter(list_intersect(w.kept, a.g), lambda x: x < a.first)) > 0 as covered
            from walk w join adj a on a.k = w.k + 1))
    ), last as (
        select kept from walk order by k desc limit 1
    )
    select cast(list_position(kept, o.k) as int) as "label", {r6("list_sum(z_fwd)")} as sum_fwd, {r6("list_sum(z_rev)")} as sum_rev
    from ord o, last where list_contains(kept, o.k)"""


def leader(quota: str) -> str:
    """Rows in batch order one by one; a row stays unless an earlier one that stayed matches it, by L within its batch and by G across batches."""
    m = lambda a, b: d2(a, b) + " < 0.85 * 0.85"
    return f"""with recursive {L}, {in_order(quota)}, adj as (
        select i.k, list(c.k) filter (c.k is not null) as near from ord i left join ord c on c.k < i.k and case when c.b = i.b
            then {m("i.z_fwd", "c.z_fwd")} or {m("i.z_fwd", "c.z_rev")}
            else {m("i.z_fwd", "c.z_fwd")} or {m("i.z_rev", "c.z_fwd")} end
        group by i.k
    ), walk as (
        select 0::bigint as k, []::bigint[] as kept
        union all
        select a.k, case when len(list_intersect(w.kept, coalesce(a.near, []::bigint[]))) > 0 then w.kept else list_append(w.kept, a.k) end
        from walk w join adj a on a.k = w.k + 1
    ), last as (
        select kept from walk order by k desc limit 1
    )
    select cast(list_position(kept, o.k) as int) as "label", {r6("list_sum(z_fwd)")} as sum_fwd, {r6("list_sum(z_rev)")} as sum_rev
    from ord o, last where list_contains(kept, o.k)"""


SCORES = "thr as (select o_orderkey as sid, case when o_totalprice / 1000 <= 150.0 then 0.0 else o_totalprice / 1000 end as score, length(o_orderpriority) / 10.0 as weight from orders)"
VOX = f"""segs as (
    select p.sid, p.pos, x / 5 as px, y / 5 as py, z / 5 as pz, x2 / 5 as qx, y2 / 5 as qy, z2 / 5 as qz, len, score * weight as s
    from (select *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) + (z2 - z) * (z2 - z)) as len from (
        select *, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2 from pts window w as (partition by sid order by pos)) where x2 is not null) p
    join thr using (sid)
), cuts as (
    select sid, pos, unnest(list_concat([0.0, 1.0], {{x}}, {{y}}, {{z}})) as t from segs
), parts as (
    select sid, pos, t, lead(t) over (partition by sid, pos order by t) as t2 from cuts
), cells as (
    select cast(floor(px + (t + t2) / 2 * (qx - px)) as int) as i, cast(floor(py + (t + t2) / 2 * (qy - py)) as int) as j,
           cast(floor(pz + (t + t2) / 2 * (qz - pz)) as int) as k, (t2 - t) * len as len, s
    from parts join segs using (sid, pos) where t2 - t > 1e-9
), vox as (
    select i, j, k, sum(len) as length, sum(s * len) as sl from cells group by i, j, k
), img as (
    select i, j, k, case when length <> 0 then sl / length else sl end as value from vox
)""".format(**{c: f"list_transform(range(cast(floor(least(p{c}, q{c})) as bigint) + 1, cast(ceil(greatest(p{c}, q{c})) as bigint)), lambda m: (m - p{c}) / (q{c} - p{c}))" for c in "xyz"})  # fmt: skip
#: Places in voxels, along the axes and on a grid turned a quarter around z.
ON_AXES = "x / 5 as px, y / 5 as py, z / 5 as pz, x2 / 5 as qx, y2 / 5 as qy, z2 / 5 as qz"
ON_TURNED = "(y + 2) / 5 + 0.5 as px, (3 - x) / 5 + 0.5 as py, (z - 1) / 5 + 0.5 as pz, (y2 + 2) / 5 + 0.5 as qx, (3 - x2) / 5 + 0.5 as qy, (z2 - 1) / 5 + 0.5 as qz"
NEAR = """near as (
    select i + a as i, j + b as j, k + c as k, value from img, range(-1, 2) q(a), range(-1, 2) r(b), range(-1, 2) s(c)
    where i + a between 0 and 10 and j + b between 0 and 21 and k + c between 0 and 2
), spots as (
    select i, j, k, list(value) as v, sum(value) as total,
           (least(i + 1, 10) - greatest(i - 1, 0) + 1) * (least(j + 1, 21) - greatest(j - 1, 0) + 1) * (least(k + 1, 2) - greatest(k - 1, 0) + 1) as inside
    from near group by i, j, k
)"""
CHAIN = f"{P}, {RES}, {ENC}"
#: Distances between what was coded and what came back.
ERR = f"""a as (select sid, list([x, y, z] order by pos) as p from res group by sid), b as (select sid, list([x, y, z] order by pos) as p from back group by sid),
        d as (select greatest(list_max(list_transform(a.p, lambda u: list_min(list_transform(b.p, lambda v: {p2("u", "v")})))), list_max(list_transform(b.p, lambda u: list_min(list_transform(a.p, lambda v: {p2("u", "v")}))))) as h,
            least(list_avg(list_transform(list_zip(a.p, b.p), lambda w: {p2("w[1]", "w[2]")})), list_avg(list_transform(list_zip(a.p, list_reverse(b.p)), lambda w: {p2("w[1]", "w[2]")}))) as m
            from a join b using (sid))"""
#: Embeddings in threes as points, coded and compared.
MODEL = f"""pts as (
    select vec_id as sid, i as pos, 21 as n, embedding[3 * i + 1]::double as x, embedding[3 * i + 2]::double as y, embedding[3 * i + 3]::double as z from embeddings, range(0, 21) q(i)
), {RES}, {ENC}, {DEC}, {ERR}, lat as (
    select sid, list(c order by a, k) as z_fwd, list(c * case when k % 2 = 0 then 1 else -1 end order by a, k) as z_rev from enc group by sid
), tri as (
    select sid, p, list_reverse(p) as q from a
), {LP}, {GEO}"""


def found(distance: str, where: str, centres: str = C, those: str = "true") -> str:
    """Centres by their distance from each row, nearest first."""
    return f"""with {L}, {centres}, near as (select sid, "label", {distance} as d from lat, cen where {those}), nth as (select *, row_number() over (partition by sid order by d, "label") as n from near)
        select sid, cast(n as int) as nth, "label", {r6('d')} as distance from nth where {where}"""


def rounds(nodes: str, matches: str, number: str) -> str:
    """Rounds: of the open rows of ``nodes`` those without an open earlier match stay, and what they match goes; earlier is less by ``number``."""
    return f"""{nodes}, edges as materialized (
    select a.{number} as c, b.{number} as i from nodes a join nodes b on a.{number} < b.{number} where {matches}
), state as (
    select {number} as id, 0 as s from nodes
    union all (
        with open_ as (select id from state where s = 0),
        blocked as (select distinct e.i as id from edges e join open_ o on o.id = e.c),
        stay as (select id from open_ where id not in (select id from blocked)),
        gone as (select distinct e.i as id from edges e join stay k on k.id = e.c)
        select id, case when s <> 0 then s when id in (select id from stay) then 1 when id in (select id from gone) then 2 else 0 end from state where exists (select 1 from open_))
)"""


ORDERS = f"""with recursive {rounds("nodes as (select o_orderkey as id, o_totalprice / 1000 as x, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) / 10.0 as y from orders)",
    "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9 or (b.x - a.y) * (b.x - a.y) + (b.y - a.x) * (b.y - a.x) < 9", "id")}
select cast(row_number() over (order by id) as int) as "label", {r6("x + y")} as sum_fwd, {r6("y + x")} as sum_rev
from nodes where id in (select id from state where s = 1)"""  # fmt: skip
#: By G across the batches, which are the classes, and by L within.
STREAM = f"""with recursive {L}, {rounds("nodes as (select *, row_number() over (order by src, sid) as k from lat)",
    f"case when a.src = b.src then {d2('b.z_fwd', 'a.z_fwd')} < 0.85 * 0.85 or {d2('b.z_fwd', 'a.z_rev')} < 0.85 * 0.85 else {d2('b.z_fwd', 'a.z_fwd')} < 0.85 * 0.85 or {d2('b.z_rev', 'a.z_fwd')} < 0.85 * 0.85 end", "k")}
select cast(row_number() over (order by k) as int) as "label", {r6("list_sum(z_fwd)")} as sum_fwd, {r6("list_sum(z_rev)")} as sum_rev
from nodes where k in (select id from state where s = 1)"""  # fmt: skip
#: A centre from the middle of each embedding, and its class.
MIDDLES = 'cen as (select cast(vec_id + 1 as int) as "label", cast(embedding[17:48] as double[]) as c, "label" as class from embeddings)'

L1 = "list_sum(list_transform(list_zip(z_fwd, c), lambda q: abs(q[1] - q[2])))"
SO2 = "least(abs(z_fwd[-1] - c[-1]), abs(2 * pi() - abs(z_fwd[-1] - c[-1])))"

ORACLE_SQL: dict[str, str] = {
    "latent_split": f"with {L} select sid, cast(len(z_fwd) as int) as n_fwd, cast(len(z_rev) as int) as n_rev, {r6('list_sum(z_fwd)')} as sum_fwd, {r6('list_sum(z_rev)')} as sum_rev from lat",
    "score_nearest": f'with {L}, {C}, {S} select sid, {r6("score")} as score, "label" from scored',
    "score_two_sided_choice": f"with {L}, {C}, {S} select forward, count(*) as n, {r6('avg(score)')} as mean_score from scored group by forward",
    "score_many_centres": f"""with {L}, {MIDDLES}, {S}
        select sid, {r6("score")} as score, "label" from scored""",
    "stored_index_knn": found(d2("z_fwd", "c"), "n <= 3", MIDDLES),
    "dynamic_index_knn": found(d2("z_fwd", "c"), "n <= 2", MIDDLES, "class <> 3"),
    "knn_centres": found(d2("z_fwd", "c"), "n <= 3"),
    "radius_centres": found(L1, "d < 3.3"),
    "knn_within_radius": found(SO2, "d < 0.05 and n <= 2"),
    "cluster_sizes": f'with {L}, {C}, {S} select "label", count(*) as n from scored group by "label"',
    "assign_global_anti": f"with {L}, {C} select sid from lat where not exists (select 1 from cen where {d2('z_fwd', 'c')} < 0.55 * 0.55 or {d2('z_rev', 'c')} < 0.55 * 0.55)",
    "cluster_leader": leader("1000000").replace("order by b, src, sid", "order by sid"),
    "cluster_multi_batch": leader("200"),
    "cluster_splits": leader_in_splits(200, 30),
    "cluster_orders": ORDERS,
    "cluster_stream": STREAM,
    "batch_quota": f"""with {L}, cnt as (select src, count(*) as n from lat group by src),
        base as (select src, greatest(1, n * 100 // (select count(*) from lat)) as q, row_number() over (order by src) as nth from cnt),
        quo as (select src, q + case when nth <= 100 - (select sum(q) from base) then 1 else 0 end as q from base)
        select cast(b as int) as batch_id, src, count(*) as n, min(sid) as first_sid
        from (select l.*, (row_number() over (partition by l.src order by sid) - 1) // q as b from lat l join quo using (src)) group by b, src""",
    "random_blocks": f"""with {L}, ranked as (select sid, row_number() over (order by sid) - 1 as rank, count(*) over () as total from lat),
        wanted as (select b, r, i, (cast('0x' || substr(md5('7:' || b || ':' || r), 1, 15) as bigint) % (select max(total) from ranked) + i) % (select max(total) from ranked) as rank
            from range(3) x(b), range(3) y(r), range(50) z(i) where r * 50 + i < 120)
        select cast(b as int) as batch_id, cast(r as int) as run, cast(i as int) as i, sid from wanted join ranked using (rank)""",
    "latent_pair_distances": f"with {L}, {LP} select i, j, {r6('one_sided')} as one_sided, {r6('two_sided')} as two_sided from latp",
    "geometric_pair_distances": f"with {GP} select i, j, {r6('hausdorff')} as hausdorff, {r6('mdf')} as mdf from geo",
    "evaluation_report": f"""with {L}, {LP}, {GP}, b as (select * from latp join geo using (i, j))
        select {REPORT} from b""",
    "streamline_length": f"""with {P}, seg as (select sid, coalesce(sqrt(power(lead(x) over w - x, 2) + power(lead(y) over w - y, 2) + power(lead(z) over w - z, 2)), 0) as len, n from pts window w as (partition by sid order by pos))
        select sid, {r6('sum(len)')} as length, cast(max(n) as int) as n from seg group by sid""",
    "bounding_box": f"with {P} select " + ", ".join(f"{f}({c}) as {f}_{c}" for c in "xyz" for f in ("min", "max")) + " from pts",
    "resample_16": f"with {P}, {RES} select sid, cast(pos as int) as pos, {XYZ} from res",
    "flip_points": f"with {P} select sid, cast(n - 1 - pos as int) as pos, {XYZ} from pts",
    "flatten_points": f"with {P} " + " union all ".join(f"select sid, cast({i} * n + pos as int) as pos, {r6(c)} as v from pts" for i, c in enumerate("xyz")),
    "dct_encode": f"with {CHAIN} select sid, cast(a * 5 + k as int) as pos, {r6('c')} as z_fwd, {r6('c * case when k % 2 = 0 then 1 else -1 end')} as z_rev from enc",
    "dct_decode": f"with {CHAIN}, {DEC} select sid, cast(pos as int) as pos, {XYZ} from back",
    "reconstruction_error": f"""with {CHAIN}, {DEC}, {ERR}
        select {r6('avg(h)')} as error_hausdorff, {r6('avg(m)')} as error_mdf, count(*) as n from d""",
    "model_test": f"""with {MODEL}, both_ as (select * from latp join geo using (i, j)), rep as (select {REPORT} from both_), err as (select {r6('avg(h)')} as error_hausdorff, {r6('avg(m)')} as error_mdf from d)
        select * from rep, err""",
    "annotate_score_label": f'with {L}, {C}, {S} select sid, 21 as n, {r6("score")} as score, "label" from scored',
    "count_guard": """with l as (select distinct l_orderkey as k from lineitem), o as (select o_orderkey as k from orders)
        select (select count(*) from l) as n_left, (select count(*) from o) as n_right, (select count(*) from l where k not in (select k from o)) as only_left, (select count(*) from o where k not in (select k from l)) as only_right""",
    "threshold_scores": f"with {SCORES} select sid, {r6('score')} as score from thr",
    "weighted_scores": f"with {SCORES} select sid, {r6('score * weight')} as score from thr",
    "voxel_lengths": f"with {P}, {SCORES}, {VOX} select i, j, k, {r6('length')} as length from vox",
    "voxel_turned": f"with {P}, thr as (select distinct l_orderkey as sid, 1.0 as score, 1.0 as weight from lineitem), {VOX.replace(ON_AXES, ON_TURNED)} select i, j, k, {r6('length')} as length from vox",
    "voxel_mean_score": f"with {P}, {SCORES}, {VOX} select i, j, k, {r6('value')} as value from img",
    "voxel_mean27": f"with {P}, {SCORES}, {VOX}, {NEAR} select cast(i as int) as i, cast(j as int) as j, cast(k as int) as k, {r6('total / inside')} as value from spots",
    "voxel_median27": f"""with {P}, {SCORES}, {VOX}, {NEAR}, full_ as (select i, j, k, inside, list_sort(list_concat(v, list_transform(range(0, inside - len(v)), lambda q: 0.0::double))) as v from spots)
        select cast(i as int) as i, cast(j as int) as j, cast(k as int) as k, {r6('(v[(inside + 1) // 2] + v[inside // 2 + 1]) / 2')} as value from full_""",
}
