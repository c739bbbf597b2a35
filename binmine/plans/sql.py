"""DuckDB SQL of the queries that SQL can express, and the constants that both sides share."""

from __future__ import annotations

from binmine.operators.sketch import band_sizes, coefficients, modulus

P, DOC_P, CLASSES, MINSUP = 64, 1024, 10, 0.15
BIT_COEFS, DOC_COEFS = coefficients(20, P), coefficients(20, DOC_P)

OBS = "obs as (select vec_id as id, label + 1 as orig, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as v from embeddings)"
CELLS = OBS + ", cells as (select id, orig, unnest(range(1, 65)) as j, unnest(v) as b from obs)"
LABELLED = OBS + ", lab as (select id, orig, v[1] * 4 + v[2] * 2 + v[3] as result from obs), tab as (select orig, result, count(*)::bigint as n from lab group by all)"
BASKETS = (
    "brands as (select p_brand, dense_rank() over (order by p_brand) as j from (select distinct p_brand from part)), "
    "bk as (select distinct l_orderkey as id, j from lineitem join part on l_partkey = p_partkey join brands using (p_brand)), "
    "lb as (select distinct id, (id % 8 + 1)::int as cluster from bk), "
    "sup as (select cluster, j, count(*)::bigint as occ from bk join lb using (id) group by all), "
    "sz as (select cluster, count(*)::bigint as n from lb group by all), "
    "ft as (select cluster, n, sum(occ)::bigint as s, count(*)::bigint as w, sum(occ * occ)::bigint as occ2 from sup join sz using (cluster) group by all), "
    "px as (select id, j from bk), ps as (select id, count(*)::bigint as size from px group by all)"
)
SHINGLES = (
    "words as (select distinct doc_id as id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) as w from documents), "
    f"sh as (select distinct id, ('0x' || substr(md5(w), 1, 6))::bigint % {DOC_P} + 1 as j from words)"
)
HAM = "list_sum(list_transform(list_zip({0}, {1}), lambda z: case when z[1] <> z[2] then 1 else 0 end))::int"


def _sigs(src: str, coefs: list, p: int) -> str:
    cols = ", ".join(f"coalesce(min((j * {a} + {b}) % {modulus(p)} % {p + 1}), -1)::bigint" for a, b in coefs)
    return f"sg as (select id, [{cols}] as sig from {src} group by id)"


DOC_SIGS = f"{SHINGLES}, si as (select d.doc_id as id, j from documents d left join sh on sh.id = d.doc_id), {_sigs('si', DOC_COEFS, DOC_P)}"
BIT_SIGS = f"{CELLS}, one as (select o.id, c.j from obs o left join cells c on c.id = o.id and c.b = 1), {_sigs('one', BIT_COEFS, P)}"


def _buckets(n: int, bands: int) -> str:
    at, parts = 1, []
    for k, size in enumerate(band_sizes(n, bands), 1):
        parts.append(f"select {k} as band, array_to_string(sig[{at}:{at + size - 1}], ',') as h, id from sg")
        at += size
    return "bu as (" + " union all ".join(parts) + ")"


def _pairs(src: str) -> str:
    return f"pr as (select distinct a.id as id1, b.id as id2 from {src} a join {src} b on a.band = b.band and a.h = b.h and a.id < b.id)"


def _lsh_metrics(n: str) -> str:
    return (
        f"k as (select {n}::double as n), c as (select count(*) filter (a.orig = b.orig) as tp, count(*) filter (a.orig <> b.orig) as fp from pr join obs a on a.id = id1 join obs b on b.id = id2), "
        f"m as (select tp, fp, power(n / {CLASSES}, {CLASSES}) - fp as tn, n / {CLASSES} * (n / {CLASSES} - 1) / 2 * {CLASSES} - tp as fn, n from c, k), "
        "q as (select tp / nullif(tp + fn, 0) as recall, tp / nullif(tp + fp, 0) as precision, (tp + tn) / (n * (n - 1) / 2) as rand from m) "
        "select round(recall, 6) as recall, round(precision, 6) as precision, round(2 * precision * recall / nullif(precision + recall, 0), 6) as f1, round(rand, 6) as rand from q"
    )


def _f1(lone: str) -> str:
    return (
        f"with {LABELLED}, r as (select orig, sum(n) as rn, sum(n * (n - 1) / 2) as tp, count(*) filter (n = 1) as ones from tab group by orig), "
        "cl as (select result, sum(n) as n from tab group by result), "
        f"t as (select sum(tp)::double as tp, sum(rn * (rn - 1) / 2 - tp - {lone})::double as fn, (select sum(n * (n - 1) / 2) from cl)::double as found from r), "
        "q as (select tp / nullif(tp + fn, 0) as recall, tp / nullif(found, 0) as precision from t) "
        "select round(recall, 6) as recall, round(precision, 6) as precision, round(2 * recall * precision / nullif(recall + precision, 0), 6) as f1 from q"
    )


def _xlnx(a: str, n: str) -> str:
    return f"(case when {a} > 0 then {a} * ln({a}) else 0 end + case when {n} > {a} then ({n} - {a}) * ln({n} - {a}) else 0 end)"


def _gain(rows: str, name: str) -> str:
    """gain of every bit for each node of rows (node, id, j, b)."""
    return (
        f"{name}_co as (select x.node, x.j, x.b as side, y.j as i, sum(y.b)::double as a, count(*)::double as n from {rows} x join {rows} y on x.id = y.id and x.j <> y.j group by all), "
        f"{name}_br as (select node, j, sum(n * ln(n) - {_xlnx('a', 'n')}) as branches from {name}_co group by all), "
        f"{name}_su as (select node, j, sum(b)::double as s, count(*)::double as n from {rows} group by all), "
        f"{name}_wh as (select node, sum(n * ln(n) - {_xlnx('s', 'n')}) as whole from {name}_su group by all), "
        f"{name} as (select node, j, whole - branches as gain from {name}_br join {name}_wh using (node))"
    )


def _large(added: str) -> str:
    """Costs of adding features (id, j, occ, n) to each cluster, and alone (target 0)."""
    return (
        f"with {BASKETS}, {added}, xs as (select distinct id, n as xn from ad), tg as (select cluster as target, n as tn from sz union all select 0, 0), "
        "al as (select x.id, t.target, s.cluster, s.j, s.occ::bigint as occ, z.n::bigint as n, false as own from xs x, tg t, sup s join sz z using (cluster) where s.cluster <> t.target "
        "union all select id, target, target, j, sum(occ)::bigint, any_value(n)::bigint, true from ("
        "select x.id, t.target, s.j, s.occ, t.tn + x.xn as n from xs x, tg t join sup s on s.cluster = t.target "
        "union all select a.id, t.target, a.j, a.occ, t.tn + a.n from ad a, tg t) group by id, target, j), "
        f"st as (select *, occ >= n * {MINSUP} as lg from al), "
        "ag as (select id, target, count(*) filter (lg and not own) as old_large, count(*) filter (lg and own) as new_large, count(distinct case when not own then cluster end) as others, "
        "count(distinct case when not lg then j end) as small, count(distinct case when lg then j end) as large from st group by id, target), "
        "co as (select id, target, small + case when others = 0 then 0 else old_large + new_large * others - large end as cost from ag) "
    )


ROW_ADDED = "ad as (select id, j, 1 as occ, 1 as n from px)"
FEATURE_ADDED = "gr as (select id % 5 as g, id, j from bk), gn as (select g, count(distinct id) as n from gr group by g), ad as (select g as id, j, count(*) as occ, any_value(n) as n from gr join gn using (g) group by g, j)"
REPS = OBS + ", rp as (select row_number() over (partition by orig order by id) as cand, orig as cluster, v from obs)"
NEAREST = f"ds as (select o.id, r.cluster, {HAM.format('o.v', 'r.v')} as d, row_number() over (partition by o.id order by {HAM.format('o.v', 'r.v')}, r.cluster) as k from obs o, {{0}} r)"
SORTED = OBS + ", so as (select id, v, row_number() over (order by list_sum(v), id) as rn from obs), nb as (select b.id as a, a.id as b, " + HAM.format("a.v", "b.v") + " as d, row_number() over (partition by b.id order by " + HAM.format("a.v", "b.v") + ", a.rn) as k from so a join so b on a.rn between b.rn - 30 and b.rn - 1)"
BLOCK = (
    CELLS
    + ", ps as (select id, row_number() over (order by id) as pos, count(*) over () as n from obs), "
    + "rw as (select id, case when pos <= n // 5 then 1 when pos <= n * 2 // 5 then 2 when pos <= n * 3 // 5 then 3 when pos <= n * 4 // 5 then 4 else 5 end as rowcluster from ps), "
    + "bc as (select id, j, b, rowcluster, (j - 1) // 16 + 1 as colcluster from cells join rw using (id)), "
    + "mn as (select rowcluster, colcluster, case when sum(b) = 0 then 1e-8 else sum(b)::double / count(*) end as mean, count(*)::bigint as n from bc group by all)"
)
PATTERNS = CELLS + f", pt as (select orig as cluster, list(bit order by j) as v from (select orig, j, case when sum(b) * {CLASSES} > count(*) then 1 else 0 end as bit from cells group by all) group by orig)"

#: Rows left before each centre, which is the first of them in seeded order; a row's canopy is the one that takes it, the last it meets.
CANOPY = (
    f"with recursive {OBS}, st(k, id, v, h) as (select 1, id, v, md5('1-' || id) from obs union all "
    f"select k + 1, id, v, h from (select st.*, {HAM.format('st.v', 'c.v')} as d from st, (select arg_min(v, h) as v from st) c) where d >= 0.4 * 64) "
    "select id, max(k)::int as cluster from st group by id"
)


def _neighbourhood(seed: int) -> str:
    """Links nb{seed} (a, b) to the nearest of the 30 rows before, in seeded order, below the threshold in tr."""
    d = HAM.format("a.v", "b.v")
    return (
        f"o{seed} as (select id, v, row_number() over (order by md5('{seed}-' || id), id) as rn from obs), "
        f"c{seed} as (select b.id as a, a.id as b, {d} as d, row_number() over (partition by b.id order by {d}, a.rn) as k from o{seed} a join o{seed} b on a.rn between b.rn - 30 and b.rn - 1), "
        f"nb{seed} as (select a, b from c{seed}, tr where k = 1 and d < t * 64)"
    )


def _neighbourhoods(t: str) -> str:
    return (
        f"with recursive {OBS}, sm as (select v from obs order by md5('1-' || id), id limit 100), tr as ({t}), "
        + ", ".join(_neighbourhood(r) for r in (1, 2, 3))
        + ", un as (select a, b from nb1 union select a, b from nb2 union select a, b from nb3), ed as (select a, b from un union select b, a from un), "
        "up(id, top) as (select id, id from obs union select up.id, ed.b from up join ed on ed.a = up.top) select id, min(top) as cluster from up group by id"
    )


#: Every level's parts; a part that is split has rows on the next level, so a row's part is that of its last level.
MBT = (
    f"with recursive {OBS}, st(level, id, v, part) as (select 0, id, v, '' from obs union all select level + 1, st.id, st.v, st.part || st.v[p.j]::varchar from st join ("
    "select part, j from (select part, j, abs(2 * sum(b) - count(*)) as off, count(*) as n, any_value(level) as level, row_number() over (partition by part order by abs(2 * sum(b) - count(*)), j) as k "
    "from (select level, part, unnest(range(1, 65)) as j, unnest(v) as b from st) group by part, j) where k = 1 and off < n and (n > 50 or level < 2)) p on p.part = st.part) "
    "select id, arg_max(part, level) as part from st group by id"
)

#: Rows' clusters after each round; a round follows while the objective falls, and the last one counts.
BINMODEL = (
    f"with recursive {OBS}, ks as (select unnest(range(1, {CLASSES + 1})) as cluster), "
    f"st(r, id, v, cluster, now, last) as (select 0, id, v, (('0x' || substr(md5('1-' || id), 1, 8))::bigint % {CLASSES} + 1)::int, 1::bigint << 40, 1::bigint << 41 from obs union all "
    f"select r + 1, id, v, (best % 1000)::int, sum(best // 1000) over ()::bigint, now from (select st.r, st.id, any_value(st.v) as v, any_value(st.now) as now, min({HAM.format('st.v', 'p.v')}::bigint * 1000 + p.cluster) as best from st, ("
    "select cluster, coalesce(v, list_transform(range(64), lambda x: 0)) as v from ks left join (select cluster, list(bit order by j) as v from ("
    f"select cluster, j, case when sum(b) * {CLASSES} > count(*) then 1 else 0 end as bit from (select cluster, unnest(range(1, 65)) as j, unnest(v) as b from st) group by cluster, j) group by cluster) using (cluster)) p "
    "where st.now < st.last group by st.r, st.id)) select id, cluster from st where r = (select max(r) from st)"
)

#: Blocks of rows and columns after each round; the last round whose objective is lower counts.
BLOCKMODEL = (
    f"with recursive {CELLS}, rw as (select id, case when pos <= n // 5 then 1 when pos <= n * 2 // 5 then 2 when pos <= n * 3 // 5 then 3 when pos <= n * 4 // 5 then 4 else 5 end as rc from (select id, row_number() over (order by id) as pos, count(*) over () as n from obs)), "
    "st(r, id, j, b, rc, cc, now, last) as (select 0, id, j, b, rc::int, ((j - 1) // 16 + 1)::int, 1e300::double, 'inf'::double from cells join rw using (id) union all ("
    "with go as (select * from st where now < last - 1e-12), mn as (select rc, cc, case when sum(b) = 0 then 1e-8 else sum(b)::double / count(*) end as mean from go group by all), "
    "nr as (select id, arg_min(rc, (round(c, 9), rc)) as rc from (select id, mn.rc, sum(s * (1 - 2 * mean) + m * mean * mean) as c from (select id, cc, sum(b) as s, count(*) as m from go group by all) join mn using (cc) group by all) group by id), "
    "nc as (select j, arg_min(cc, (round(c, 9), cc)) as cc from (select j, mn.cc, sum(s * (1 - 2 * mean) + m * mean * mean) as c from (select go.j, nr.rc, sum(b) as s, count(*) as m from go join nr using (id) group by all) join mn using (rc) group by all) group by j), "
    "nw as (select go.r, go.id, go.j, go.b, nr.rc, nc.cc, go.now from go join nr using (id) join nc using (j)), "
    "nm as (select rc, cc, case when sum(b) = 0 then 1e-8 else sum(b)::double / count(*) end as mean from nw group by all) "
    "select r + 1, id, j, b, rc, cc, sqrt(sum(b * (1 - 2 * mean) + mean * mean) over ()), now from nw join nm using (rc, cc))) "
    "select distinct id, rc as cluster from st where r = (select max(r) from st where now < last - 1e-12)"
)

ORACLE_SQL = {
    "pair_metrics": _f1("ones * (ones - 1) / 2"),
    "pair_metrics_exact": _f1("0"),
    "cluster_entropy": f"with {LABELLED}, z as (select n, sum(n) over (partition by result) as size from tab) select round(sum(-n * log2(n / size)) / sum(n), 6) as entropy from z",
    "rand_index": f"with {LABELLED} select round(1 + ((select sum(n * n) from tab) - ((select sum(n * n) from (select sum(n) as n from tab group by orig)) + (select sum(n * n) from (select sum(n) as n from tab group by result))) / 2) / (select sum(n) * (sum(n) - 1) / 2 from tab), 6) as rand",
    "purity_blocks": f"with {LABELLED}, r as (select result, row_number() over (order by id) as rn, count(*) over () as n from lab), k as (select unnest(range(1, 1 + least(7, (select count(distinct result) from lab)))) as b), w as (select b, result, count(*) as c, any_value(n) as n from k join r on rn between floor(n / 7.0 * (b - 1)) + 1 and floor(n / 7.0 * (b - 1)) + floor(n / 7.0) group by all) select round(sum(m)::double / any_value(n), 6) as purity from (select b, max(c) as m, any_value(n) as n from w group by b)",
    "purity": f"with {LABELLED} select round(sum(m)::double / sum(n), 6) as purity from (select max(n) as m, sum(n) as n from tab group by result)",
    "popcount_rows": f"with {OBS} select id, list_sum(v)::bigint as ones from obs",
    "item_support": f"with {CELLS} select j::int as j, sum(b)::bigint as s, count(*)::bigint as n from cells group by j",
    "balanced_variable": f"with {CELLS} select 'V' || j as variable from (select j, abs(2 * sum(b) - count(*)) as off from cells group by j) order by off, j limit 1",
    "minhash_signature": f"with {DOC_SIGS} select id, array_to_string(sig, ',') as sig from sg",
    "minhash_clusters": f"with {DOC_SIGS}, f as (select id, min(id) over (partition by sig) as first from sg) select id, dense_rank() over (order by first)::bigint as cluster from f",
    "minhash_bits": f"with {BIT_SIGS} select id, array_to_string(sig, ',') as sig from sg",
    "lsh_buckets": f"with {DOC_SIGS}, {_buckets(20, 5)} select band::int as band, h, id from bu",
    "lsh_candidate_pairs": f"with {DOC_SIGS}, {_buckets(20, 5)}, {_pairs('bu')} select id1, id2 from pr",
    "lsh_pair_metrics": f"with {BIT_SIGS}, {_buckets(20, 10)}, {_pairs('bu')}, {_lsh_metrics('(select count(*) from obs)')}",
    "lsh_eval_sample": f"with {BIT_SIGS}, {_buckets(20, 10)}, rk as (select id, ceil(row_number() over (order by id) * {CLASSES}.0 / count(*) over ()) as run from obs), sm as (select id from (select id, row_number() over (partition by run order by md5('1-' || id), id) as k from rk) where k <= {200 // CLASSES}), sb as (select * from bu where id in (select id from sm)), {_pairs('sb')}, {_lsh_metrics('200')}",
    "hamming_topk": f"with {OBS}, d as (select q.id as query, o.id, {HAM.format('o.v', 'q.v')} as d from obs o, obs q where q.id % 20 = 0 and q.id <> o.id) select * from (select *, row_number() over (partition by query order by d, id)::int as rank from d) where rank <= 5",
    "nearest_medoid": f"with {REPS}, r1 as (select * from rp where cand = 1), {NEAREST.format('r1')} select id, cluster::int as cluster, d from ds where k = 1",
    "medoid_cost": f"with {REPS}, r1 as (select * from rp where cand = 1), {NEAREST.format('r1')} select sum(d)::bigint as cost from ds where k = 1",
    "clarans_candidate_cost": f"with {REPS} select cand::int as cand, sum(d)::bigint as cost from (select o.id, cand, min({HAM.format('o.v', 'r.v')}) as d from obs o, rp r where cand <= 5 group by all) group by cand",
    "cluster_medoid": f"with {OBS}, s as (select a.orig as cluster, a.id, sum({HAM.format('a.v', 'b.v')})::bigint as total from obs a join obs b using (orig) group by all) select cluster::int as cluster, id, total from (select *, row_number() over (partition by cluster order by total, id) as k from s) where k = 1",
    "canopy_first_pass": f"with {OBS}, c as (select v from obs order by md5('1-' || id), id limit 1) select id, d from (select o.id, {HAM.format('o.v', 'c.v')} as d from obs o, c) where d < 0.45 * 64",
    "canopy": CANOPY,
    "sorted_neighborhood": _neighbourhoods(f"select avg({HAM.format('a.v', 'b.v')} / 64.0::double) as t from sm a, sm b"),
    "sorted_neighborhood_near": _neighbourhoods("select 0.36::double as t"),
    "mbt_parts": MBT,
    "binmodel": BINMODEL,
    "blockmodel": BLOCKMODEL,
    "sn_edges": f"with {SORTED} select a, b, d from nb where k = 1 and d < 0.45 * 64",
    "sn_clusters": f"with recursive {SORTED}, e as (select a, b from nb where k = 1 and d < 0.42 * 64), up(id, top) as (select id, id from obs union select up.id, e.b from up join e on e.a = up.top), rt as (select id, top from up where top not in (select a from e)) select id, min(id) over (partition by top) as cluster from rt",
    "clope_features": f"with {BASKETS} select cluster, n, s, w, occ2 from ft",
    "clope_delta_add": f"with {BASKETS}, cm as (select p.id, s.cluster, count(*) as common from px p join sup s using (j) group by all) select p.id, f.cluster, round((s + size) * (n + 1) / power(w + size - coalesce(common, 0), 2.0) - s * n / power(w, 2.0), 6) as delta from ft f cross join ps p left join cm on cm.id = p.id and cm.cluster = f.cluster",
    "clope_merge_delta": f"with {BASKETS}, cm as (select a.cluster as c1, b.cluster as c2, count(*) as common from sup a join sup b on a.j = b.j and a.cluster < b.cluster group by all) select a.cluster as c1, b.cluster as c2, round((a.s + b.s) * (a.n + b.n) / power(a.w + b.w - coalesce(common, 0), 2.0) - a.s * a.n / power(a.w, 2.0), 6) as delta from ft a join ft b on a.cluster < b.cluster left join cm on c1 = a.cluster and c2 = b.cluster",
    "clope_profit": f"with {BASKETS} select round(sum(s * n / power(w, 2.0)) / sum(n), 6) as profit from ft",
    "largeitem_cost_add": _large(ROW_ADDED) + "select id, target::int as target, round(cost::double, 6) as cost from co where target > 0",
    "largeitem_cost_new": _large(ROW_ADDED) + "select id, round(cost::double, 6) as cost from co where target = 0",
    "largeitem_cost_merge": _large(FEATURE_ADDED) + "select id, target::int as target, round(cost::double, 6) as cost from co where target > 0",
    "largeitem_cost_merge_new": _large(FEATURE_ADDED) + "select id, round(cost::double, 6) as cost from co where target = 0",
    "largeitem_total": f"with {BASKETS}, t as (select *, occ >= n * {MINSUP} as lg from sup join sz using (cluster)) select round((count(distinct case when not lg then j end) + count(*) filter (lg) - count(distinct case when lg then j end))::double, 6) as cost from t",
    "scale_wcd": f"with {BASKETS} select cluster, n, s, round(occ2 / (s * n)::double, 6) as wcd from ft",
    "scale_ewcd_add": f"with {BASKETS}, wh as (select sum(occ2::double / s) as whole, sum(n) as total from ft), hi as (select p.id, s.cluster, sum(occ) as hits from px p join sup s using (j) group by all) select p.id, f.cluster, round((whole - occ2::double / s + (occ2 + 2 * coalesce(hits, 0) + size)::double / (s + size)) / total, 6) as ewcd from ft f cross join ps p cross join wh left join hi on hi.id = p.id and hi.cluster = f.cluster",
    "scale_batch_features": f"with {BASKETS}, l2 as (select id, cluster * 100 + (id % 3)::int as cluster from lb), s2 as (select cluster, j, count(*)::bigint as occ from bk join l2 using (id) group by all) select cluster::int as cluster, n::bigint as n, sum(occ)::bigint as s, sum(occ * occ)::bigint as occ2 from s2 join (select cluster, count(*) as n from l2 group by all) using (cluster) group by all",
    "mbt_level_partitions": f"with {CELLS}, a as (select j from (select j, abs(2 * sum(b) - count(*)) as off from cells group by j) order by off, j limit 1), l1 as (select o.id, o.v, o.v[a.j]::varchar as part from obs o, a), c1 as (select part, id, unnest(range(1, 65)) as j, unnest(v) as b from l1), b1 as (select part, j from (select part, j, row_number() over (partition by part order by abs(2 * sum(b) - count(*)), j) as k from c1 group by part, j) where k = 1) select id, l1.part || l1.v[b1.j]::varchar as part from l1 join b1 using (part)",
    "mona_information_gain": f"with {CELLS}, r0 as (select 1 as node, id, j, b from cells), {_gain('r0', 'g0')} select j::int as j, round(gain, 6) as gain from g0",
    "mona": f"with {CELLS}, r0 as (select 1::bigint as node, id, j, b from cells), {_gain('r0', 'g0')}, s0 as (select j from g0 order by round(gain, 9) desc, j limit 1), "
    f"n1 as (select c.id, 2 + c.b as node from cells c join s0 on c.j = s0.j), r1 as (select n1.node, c.id, c.j, c.b from cells c join n1 using (id)), {_gain('r1', 'g1')}, "
    "s1 as (select node, j from (select node, j, row_number() over (partition by node order by round(gain, 9) desc, j) as k from g1 where j not in (select j from s0)) where k = 1), "
    f"n2 as (select r1.id, 2 * r1.node + r1.b as node from r1 join s1 on r1.node = s1.node and r1.j = s1.j), r2 as (select n2.node, c.id, c.j, c.b from cells c join n2 using (id)), {_gain('r2', 'g2')}, "
    "s2 as (select node, j from (select g2.node, g2.j, row_number() over (partition by g2.node order by round(gain, 9) desc, g2.j) as k from g2 join s1 on s1.node = g2.node // 2 where g2.j <> s1.j and g2.j not in (select j from s0)) where k = 1), "
    "n3 as (select r2.id, 2 * r2.node + r2.b as node from r2 join s2 on r2.node = s2.node and r2.j = s2.j), f as (select id, min(id) over (partition by node) as first from n3) select id, dense_rank() over (order by first)::int as cluster from f",
    "mona_splits": f"with {CELLS}, r0 as (select 1::bigint as node, id, j, b from cells), {_gain('r0', 'g0')}, s0 as (select 1::bigint as node, j from g0 order by round(gain, 9) desc, j limit 1), n1 as (select c.id, 2 + c.b as node from cells c join s0 on c.j = s0.j), r1 as (select n1.node, c.id, c.j, c.b from cells c join n1 using (id)), {_gain('r1', 'g1')}, s1 as (select node, j from (select g1.node, g1.j, row_number() over (partition by g1.node order by round(gain, 9) desc, g1.j) as k from g1 where g1.j not in (select j from s0)) where k = 1) select node::bigint as node, j::int as j from s0 union all select node::bigint, j::int from s1",
    "binmodel_patterns": f"with {PATTERNS} select cluster::int as cluster, array_to_string(v, ',') as v from pt",
    "binmodel_assign": f"with {PATTERNS}, {NEAREST.format('pt')} select id, cluster::int as cluster, d from ds where k = 1",
    "binmodel_objective": f"with {PATTERNS} select sum({HAM.format('o.v', 'p.v')})::bigint as objective from obs o join pt p on p.cluster = o.orig",
    "blockmodel_means": f"with {BLOCK} select rowcluster::int as rowcluster, colcluster::int as colcluster, round(mean, 6) as mean, n from mn",
    "blockmodel_step": f"with {BLOCK}, c as (select id, m.rowcluster, sum(power(b - mean, 2)) as c from bc join mn m using (colcluster) group by all) select id, rowcluster::int as cluster from (select *, row_number() over (partition by id order by round(c, 9), rowcluster) as k from c) where k = 1",
    "blockmodel_columns": f"with {BLOCK}, c as (select j, m.colcluster, sum(power(b - mean, 2)) as c from bc join mn m using (rowcluster) group by all) select j::int as j, colcluster::int as colcluster from (select *, row_number() over (partition by j order by round(c, 9), colcluster) as k from c) where k = 1",
    "blockmodel_objective": f"with {BLOCK} select round(sqrt(sum(power(b - mean, 2))), 6) as objective from bc join mn using (rowcluster, colcluster)",
    "stratified_sample": f"with {OBS}, r as (select id, orig, row_number() over (partition by orig order by md5('1-' || id), id) as k from obs) select id, orig from r where k <= round_even(200.0 * orig / {CLASSES}, 0) - round_even(200.0 * (orig - 1) / {CLASSES}, 0)",
    "chunk_assign": f"with {OBS} select id, ntile(7) over (order by id)::int as chunk from obs",
    "label_union": f"with {LABELLED}, c as (select id, result, ntile(3) over (order by id) as chunk from lab), f as (select id, min(id) over (partition by chunk, result) as first from c) select id, dense_rank() over (order by first)::bigint as cluster from f",
}
