"""The same queries in SQL, spelled out in arithmetic."""

from __future__ import annotations

from terrane.sources.fixtures import DEGREES_SQL, LINES_SQL, NESTED_SQL, POINTS_SQL, POLYGONS_SQL

P, L, G, D = f"with {POINTS_SQL}", f"with {LINES_SQL}", f"with {POLYGONS_SQL}", f"with {DEGREES_SQL}"
#: Steps of lines: consecutive vertices.
STEPS = """steps as (select * from (select fid, v s, x x0, y y0, lead(x) over w x1, lead(y) over w y1, last_v from verts window w as (partition by fid order by v)) q where x1 is not null),
lens as (select fid, sum(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))) len from steps group by fid)"""
ENDS = """ends as (select fid, max(case when v = 0 then x end) ax, max(case when v = 0 then y end) ay, max(case when v = last_v then x end) bx, max(case when v = last_v then y end) by_, max(o_totalprice) price from verts group by fid),
az as (select fid, case when ax = bx and ay = by_ then null else (degrees(atan2(bx-ax, by_-ay)) + 360e0) % 180e0 end endpt_az from ends)"""
BINS = """b as (select cast(trunc(min(easting)) as bigint) minx, cast(trunc(max(easting)) as bigint)+1 maxx, cast(trunc(min(northing)) as bigint) miny, cast(trunc(max(northing)) as bigint)+1 maxy from points),
cells as (select p.*, b.minx, b.miny, cast(floor((easting-minx)/5000e0) as bigint) cx, cast(floor((northing-miny)/5000e0) as bigint) cy,
 sin(radians(dip))*sin(radians(dip_dir)) l, sin(radians(dip))*cos(radians(dip_dir)) m, cos(radians(dip)) z from points p, b where easting >= minx and easting < maxx and northing >= miny and northing < maxy),
sums as (select cx, cy, minx, miny, count(*) n, sum(l) l, sum(m) m, sum(z) z, sqrt(sum(l)*sum(l)+sum(m)*sum(m)+sum(z)*sum(z)) r from cells group by all),
means as (select cx, cy, cast(trunc(minx+(cx+0.5e0)*5000e0) as bigint) easting, cast(trunc(miny+(cy+0.5e0)*5000e0) as bigint) northing, n,
 case when r >= 1e-12 then cast(trunc(round(90e0-degrees(asin(greatest(-1e0, least(1e0, z/r)))), 9)) as bigint) end dip,
 case when r >= 1e-12 then cast(trunc(round((720e0+degrees(atan2(l/r, m/r))) % 360e0, 9)) as bigint) end dip_dir from sums)"""
AREAS = "areas as (select fid, abs(sum(x0*y1-x1*y0))/2 area, sum(length) perimeter, max(strat1) strat1, max(strat2) strat2, max(lith) lith from segs group by fid)"
N = f"with {NESTED_SQL}"
NAREAS = """nareas as (select fid, sum(sign*area) area, count(*) filter (sign > 0) members, count(*) filter (sign < 0) holes, sum(perimeter) perimeter from (select fid, sign, part, abs(sum(x0*y1-x1*y0))/2 area, sum(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))) perimeter
 from (select *, case when fid >= 10000000 then cast(floor(x0/2500e0) as bigint)*1000000 + cast(floor(y0/2500e0) as bigint) else 0 end part from nsegs) p group by fid, sign, part) q group by fid)"""
PAIRS = "pairs as (select a.fid fid1, b.fid fid2, sum(a.length) shared from segs a join segs b on a.seg_key = b.seg_key and a.fid < b.fid group by all)"
NET = """net as (select fid*2 line_id, x0, y0, x1, y1 from psteps where s = 0 and fid % 7 <> 0
 union all select a.fid*2+1, a.x x0, a.y y0, b.x x1, b.y y1 from pverts a join pverts b on a.fid = b.fid and a.v = 0 and b.v = 3 where a.fid % 5 <> 0),
nedges as (select x, y, x2, y2, max(line_id) line_id, max(sqrt((x-x2)*(x-x2)+(y-y2)*(y-y2))) length from (select line_id,
 case when x0 < x1 or (x0 = x1 and y0 <= y1) then x0 else x1 end x, case when x0 < x1 or (x0 = x1 and y0 <= y1) then y0 else y1 end y,
 case when x0 < x1 or (x0 = x1 and y0 <= y1) then x1 else x0 end x2, case when x0 < x1 or (x0 = x1 and y0 <= y1) then y1 else y0 end y2 from net) q group by x, y, x2, y2),
nnodes as (select x, y, count(*) degree from (select x, y from nedges union all select x2, y2 from nedges) q group by x, y),
ntypes as (select *, case when degree = 0 then 'I' when degree = 1 then 'Z' when degree = 2 then 'Y' else 'X' end node_type from nnodes)"""
_NEAR = """segaz as (select fid seg_fid, s, x0, y0, x1, y1, (degrees(atan2(x1-x0, y1-y0))+360e0) % 180e0 azimuth from psteps),
near as (select p.fid, p.dip_dir, g.seg_fid, g.s, g.azimuth, t.dist from points p join segaz g on least(x0,x1)-500 <= easting and greatest(x0,x1)+500 >= easting and least(y0,y1)-500 <= northing and greatest(y0,y1)+500 >= northing,
 lateral (select greatest(0e0, least(1e0, ((easting-x0)*(x1-x0)+(northing-y0)*(y1-y0))/((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) k) u,
 lateral (select sqrt((easting-(x0+k*(x1-x0)))*(easting-(x0+k*(x1-x0)))+(northing-(y0+k*(y1-y0)))*(northing-(y0+k*(y1-y0)))) dist) t where t.dist <= 500),
best as (select * from (select *, row_number() over (partition by fid order by round(dist, 9), seg_fid, s) rn from near) q where rn = 1)"""
_PROBES = """cum as (select fid, s, x0, y0, x1, y1, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) n from steps),
cum2 as (select *, sum(n) over (partition by fid order by s) - n before, sum(n) over (partition by fid) total from cum),
shares as (select * from (values ('p0', 0e0), ('p01', 0.01e0), ('p49', 0.49e0), ('p5', 0.5e0), ('p51', 0.51e0), ('p99', 0.99e0), ('p1', 1e0)) t(name, share)),
spots as (select fid, name, x, y from (select fid, name, x0+(total*share-before)/n*(x1-x0) x, y0+(total*share-before)/n*(y1-y0) y, row_number() over (partition by fid, name order by s) rn
 from cum2, shares where n > 0 and (before + n >= total*share or abs(before + n - total*share) < 1e-6)) q where rn = 1),
pr as (select c.fid, t.location, c.x cx, c.y cy, b.x-a.x dx, b.y-a.y dy from (values ('start','p0','p0','p01'), ('midpoint','p5','p49','p51'), ('end','p1','p99','p1')) t(location, pc, pa, pb)
 join spots c on c.name = t.pc join spots a on a.name = t.pa and a.fid = c.fid join spots b on b.name = t.pb and b.fid = c.fid),
probes as (select fid, location, side, cx - k*dy/sqrt(dx*dx+dy*dy)*50 x, cy + k*dx/sqrt(dx*dx+dy*dy)*50 y from pr, (values ('side1', 1e0), ('side2', -1e0)) t(side, k) where dx*dx+dy*dy > 0)"""
_UNITS = """boxes as (select fid, min(x) bx0, max(x) bx1, min(y) by0, max(y) by1 from pverts group by fid),
inside as (select p.fid, location, side, min(b.fid) poly from probes p join boxes b on x >= bx0 and x <= bx1 and y >= by0 and y <= by1
 where (select count(*) from psteps s where s.fid = b.fid and (s.y0 > p.y) <> (s.y1 > p.y) and p.x < s.x0 + (p.y-s.y0)*(s.x1-s.x0)/(s.y1-s.y0)) % 2 = 1 group by all),
units as (select i.fid, location, side, strat1, strat2, lith from inside i join polys on polys.fid = i.poly),
sides as (select fid, location, count(distinct side) n, max(case when side='side1' then strat1 end) a1, max(case when side='side2' then strat1 end) b1, max(case when side='side1' then strat2 end) a2,
 max(case when side='side2' then strat2 end) b2, max(case when side='side1' then lith end) a3, max(case when side='side2' then lith end) b3 from units group by fid, location),
levels as (select *, case when n < 2 then -1 when a3 <> b3 then 3 when a2 <> b2 then 2 when a1 <> b1 then 1 else 0 end offset_level from sides),
ranked as (select *, row_number() over (partition by fid order by offset_level desc, location) rn from levels)"""
_DESC = "case {} when -1 then 'Fault at edge of map' when 0 then 'No offset - same at all levels' when 1 then 'Offset at strat1 level (priority 1)' when 2 then 'Offset at strat2 level (priority 2)' when 3 then 'Offset at lith level (priority 3)' end"
_SHARED = """select min(case when f then x0 else x1 end) ax, min(case when f then y0 else y1 end) ay, min(case when f then x1 else x0 end) bx, min(case when f then y1 else y0 end) "by", count(distinct fid) polygons, round(max(length), {}) length
 from (select *, x0 < x1 or (x0 = x1 and y0 <= y1) f from segs) q group by seg_key"""
_QX = "cast(round_even(x/0.1e0, 0) as bigint) qx, cast(round_even(y/0.1e0, 0) as bigint) qy"

ORACLE: dict[str, str] = {
    "pt_setup_strike": f"{P} select fid, easting, northing, dip, (dip_dir + 270e0) % 360e0 dip_dir from points",
    "pt_standardise": f"{P} select fid, easting, northing, dip, (dip_dir + 90e0) % 360e0 dip_dir from points where kind = 'click'",
    "pt_cosines": f"{P} select fid, round(sin(radians(dip))*sin(radians(dip_dir)), 6)+0e0 l, round(sin(radians(dip))*cos(radians(dip_dir)), 6)+0e0 m, round(cos(radians(dip)), 6)+0e0 n, round(dip, 4) dip, round(dip_dir, 4) dip_dir from points where dip > 0",
    "pt_bounds": f"{P}, {BINS} select * from b",
    "pt_decimation": f"{P} select fid, easting, northing from (select *, row_number() over (order by fid) - 1 k from points) q where k % 5 = 0",
    "pt_stochastic_exact": f"{P} select fid, easting, northing from (select *, row_number() over (order by ((fid+42)*48271) % 2147483647, fid) k, count(*) over () n from points) q where k <= round_even(n*0.3e0, 0)",
    "pt_grid_average": f"{P}, {BINS} select easting, northing, dip, dip_dir, n from means",
    "pt_first_order": f"{P}, {POLYGONS_SQL}, {_NEAR} select fid, round(dist, 6) distance, round(azimuth, 6) azimuth from best, lateral (select abs(azimuth - (dip_dir + 270e0) % 180e0) % 180e0 dd) t where least(dd, 180e0-dd) <= 15",
    "pt_target_n_probe": f"""{P}, {BINS} select size, count(*) cells from (select distinct size, floor((easting-minx)/size) a, floor((northing-miny)/size) c from points, b, (values (2500e0), (5000e0), (10000e0), (20000e0)) t(size)
 where easting >= minx and easting < maxx and northing >= miny and northing < maxy) q group by size""",
    "tp_counts": f"""{P}, rs as (select unnest([0.9e0, 0.8e0, 0.7e0, 0.6e0, 0.5e0, 0.4e0, 0.3e0, 0.2e0, 0.1e0]) ratio), k as (select kind, count(*) n from points group by kind)
 select kind, n, ratio, cast(greatest(1, round_even(n*pow(ratio, 0.5e0), 0)) as bigint) points, cast(greatest(1, round_even(n*ratio, 0)) as bigint) lines, cast(greatest(1, round_even(n*pow(ratio, 1.5e0), 0)) as bigint) areas from k, rs""",
    "tp_lines_length": f"{L}, {STEPS} select fid, round(len, 6) length from (select *, row_number() over (order by round(len, 6) desc, fid) k, count(*) over () n from lens) q where k <= round_even(n*0.1e0, 0)",
    "tp_lines_graph": f"""{L}, {STEPS} select fid, coalesce(et, '') edge_type from (select *, row_number() over (order by case when et is null then 2 when et = 'X-X' then 0 when et = 'Z-Z' then 3 else 1 end, round(len, 6) desc, fid) k, count(*) over () n
 from (select *, case fid % 4 when 0 then 'X-X' when 1 then 'Y-Z' when 2 then 'Z-Z' end et from lens) p) q where k <= round_even(n*0.3e0, 0)""",
    "tp_lines_offset": f"{L}, {STEPS} select fid, mo max_offset from (select *, row_number() over (order by abs(mo) desc nulls last, round(len, 6) desc, fid) k, count(*) over () n from (select *, case when fid % 3 > 0 then fid % 7 - 3 end mo from lens) p) q where k <= round_even(n*0.2e0, 0)",
    "tp_lines_clusters": f"{L}, {STEPS} select fid, cluster from (select *, row_number() over (order by size desc, round(len, 6) desc, fid) k from (select *, count(*) over (partition by cluster) size, count(*) over () n from (select *, cast(floor(sqrt(fid % 50)) as bigint) cluster from lens) p) o) q where k <= round_even(n*0.2e0, 0)",
    "tp_points_scaled": f"""{P}, f as (select *, greatest(0.001e0, greatest(1, round_even(n*pow(0.1e0, 0.5e0), 0))/n) frac from (select count(*) n from points) q)
 select fid, easting, northing from (select p.*, row_number() over (order by ((fid+42)*48271) % 2147483647, fid) k, round_even(n*frac, 0) want from points p, f) q where k <= want""",
    "ln_length": f"{L}, {STEPS} select fid, round(len, 6) m, round(len*0.001e0, 6) km, round(len*3.28084e0, 4) ft, round(len*0.000621371e0, 6) mi from lens",
    "ln_min_filter": f"{L}, {STEPS} select fid from lens where len >= 2000",
    "ln_min_parts": f"{L}, {STEPS}, parts as (select fid, case when s = 0 then 0 else 1 end p, sum(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))) len from steps group by all) select fid, count(*) parts from parts where len >= 900 group by fid",
    "ln_filter_statistics": f"""{L}, {STEPS} select count(*) original_count, count(*) filter (len >= 2000) filtered_count, count(*) filter (len < 2000) removed_count, round(sum(len), 2) original_length,
 round(sum(len) filter (len >= 2000), 2) filtered_length, round(count(*) filter (len < 2000)*100e0/count(*), 6) removed_percent from lens""",
    "ln_azimuth": f"{L}, {ENDS} select fid, round(endpt_az, 6) endpt_az from az",
    "ln_explode_parts": f"{L} select fid, cast(p as bigint) part_no, count(*) vertices from (select fid, v, unnest(case when v = 1 then [0, 1] when v = 0 then [0] else [1] end) p from verts) q group by fid, p",
    "cl_rose": f"{L}, {ENDS} select cast(least(floor(endpt_az/10), 17)*10 as bigint) bin_start, count(*) n, cast(least(floor(endpt_az/10), 17)*10 + 180 as bigint) opposite_start from az where endpt_az is not null group by all",
    "net_edges": f"{G}, {NET} select x, y, x2, y2, line_id, round(length, 6) length from nedges",
    "net_node_types": f"{G}, {NET} select x, y, degree, node_type from ntypes",
    "net_edge_types": f"{G}, {NET} select least(a.node_type, b.node_type)||'-'||greatest(a.node_type, b.node_type) edge_type, count(*) n, round(sum(length), 3) length from nedges e join ntypes a on e.x = a.x and e.y = a.y join ntypes b on e.x2 = b.x and e.y2 = b.y group by 1",
    "so_probe_points": f"{L}, {STEPS}, {_PROBES} select fid, location, side, round(x, 4) x, round(y, 4) y from probes",
    "so_pip_join": f"""{G}, {POINTS_SQL}, boxes as (select fid, min(x) bx0, max(x) bx1, min(y) by0, max(y) by1 from pverts group by fid), q as (select fid pid, easting+0.25e0 px, northing+0.25e0 py from points)
 select pid, b.fid from q join boxes b on px >= bx0 and px <= bx1 and py >= by0 and py <= by1 where (select count(*) from psteps s where s.fid = b.fid and (s.y0 > py) <> (s.y1 > py) and px < s.x0 + (py-s.y0)*(s.x1-s.x0)/(s.y1-s.y0)) % 2 = 1""",
    "so_offset_level": f"""{L}, {STEPS}, {POLYGONS_SQL}, {_PROBES}, {_UNITS} select fid, location, cast(offset_level as integer) offset_level, case when n = 2 then concat_ws(',', a1, a2, a3) else '' end side1_units, case when n = 2 then concat_ws(',', b1, b2, b3) else '' end side2_units from levels""",
    "so_fault_offsets": f"""{L}, {STEPS}, {POLYGONS_SQL}, {_PROBES}, {_UNITS} select fid, cast(max(offset_level) as integer) max_offset, max(location) filter (rn = 1) max_location, {_DESC.format('max(offset_level)')} max_description,
 cast(max(offset_level) filter (location = 'start') as integer) start_offset, cast(max(offset_level) filter (location = 'midpoint') as integer) midpoint_offset, cast(max(offset_level) filter (location = 'end') as integer) end_offset from ranked group by fid""",
    "so_fault_summary": f"{L}, {STEPS}, {POLYGONS_SQL}, {_PROBES}, {_UNITS} select cast(offset_level as integer) max_offset, location max_location, count(*) n from ranked where rn = 1 group by all",
    "pg_area": f"{G}, {AREAS} select fid, round(area, 6) area from areas",
    "pg_large": f"{G}, {AREAS} select fid from areas where area >= 5e6",
    "pg_adjacency": f"{G}, {PAIRS} select fid1, fid2, round(shared, 6) shared from pairs",
    "pg_merge_target": f"""{G}, {AREAS}, {PAIRS}, both_ as (select fid1 fid, fid2 nbr, shared from pairs union all select fid2, fid1, shared from pairs),
 t as (select b.fid, nbr, shared, case when a.strat1 = n.strat1 then 0 when a.strat2 = n.strat2 then 1 when a.lith = n.lith then 2 else 3 end tier from both_ b join areas a on a.fid = b.fid join areas n on n.fid = b.nbr where a.area < 5e6)
 select fid, nbr target, round(shared, 6) shared, case tier when 0 then 'same_strat1' when 1 then 'same_strat2' when 2 then 'same_lith' else 'fallback_boundary_length' end reason
 from (select *, row_number() over (partition by fid order by tier, round(shared, 6) desc, nbr) rn from t) q where rn = 1""",
    "pg_small_holes": f"""{G}, {AREAS} select fid, cast(0 as bigint) ring_no, round(area, 6) area from areas union all select fid, 1, 40000e0 from areas where fid % 100 = 0""",
    "pg_triangle_areas": f"{G}, {AREAS} select fid, round(area, 3) area from areas",
    "tz_junctions": f"""{G}, q as (select fid, v, {_QX} from pverts), nb as (select fid, v, qx, qy, lag(qx||','||qy) over w a, lead(qx||','||qy) over w b from q window w as (partition by fid order by v)),
 firsts as (select * from (select *, row_number() over (partition by fid, qx, qy order by v) rn from nb) p where rn = 1)
 select qx, qy from (select qx, qy, count(distinct case when a is null then b when b is null then a when a = b then a else least(a, b)||';'||greatest(a, b) end) k from firsts group by qx, qy) p where k > 1""",
    "tz_shared_segments": f"{G} {_SHARED.format(6)}",
    "tz_shared_segments_degrees": f"{D} {_SHARED.format(9)}",
    "tz_exterior_vertices_degrees": f"""{D}, u as (select seg_key, count(distinct fid) n from segs group by seg_key), e as (select seg_key, x0 x, y0 y from segs union all select seg_key, x1, y1 from segs)
 select qx, qy from (select cast(round_even(x/1e-6, 0) as bigint) qx, cast(round_even(y/1e-6, 0) as bigint) qy, n from e join u using (seg_key)) q group by qx, qy having max(n) = 1""",
    "pg_adjacency_degrees": f"{D}, {PAIRS} select fid1, fid2, round(shared, 9) shared from pairs",
    "tz_exterior_vertices": f"""{G}, u as (select seg_key, count(distinct fid) n from segs group by seg_key), e as (select seg_key, x0 x, y0 y from segs union all select seg_key, x1, y1 from segs)
 select qx, qy from (select {_QX}, n from e join u using (seg_key)) q group by qx, qy having max(n) = 1""",
    "tz_box_vertices": f"{G}, b as (select min(x) a, max(x) b, min(y) c, max(y) d from pverts) select distinct {_QX} from pverts, b where abs(x-a) <= 0.1e0 or abs(x-b.b) <= 0.1e0 or abs(y-c) <= 0.1e0 or abs(y-d) <= 0.1e0",
    "tz_thin_bodies": f"{G}, {AREAS} select fid, round(area, 6) area, round(perimeter, 6) perimeter from areas where 2*area/perimeter < 0.5e0*sqrt(5.2e6)",
    "tz_contacts": f"""{G}, c as (select a.fid f1, b.fid f2, least(a.strat1, b.strat1) code_a, greatest(a.strat1, b.strat1) code_b, a.x0, a.y0, a.x1, a.y1, a.length from segs a join segs b on a.seg_key = b.seg_key and a.fid < b.fid and a.strat1 <> b.strat1),
 firsts as (select * from (select code_a, code_b, f1, f2, row_number() over (partition by code_a, code_b order by f1, f2) rn from (select distinct code_a, code_b, f1, f2 from c) q) p where rn = 1),
 own as (select c.* from c join firsts using (code_a, code_b, f1, f2)), mid as (select code_a, code_b, f1, f2, sum(length) length, sum(length*(x0+x1)/2)/sum(length) cx, sum(length*(y0+y1)/2)/sum(length) cy from own group by all),
 e as (select distinct code_a, code_b, x, y from (select code_a, code_b, x0 x, y0 y from own union all select code_a, code_b, x1, y1 from own) q),
 r as (select m.*, x, y, count(*) over (partition by code_a, code_b) vertices, row_number() over (partition by code_a, code_b order by round((x-cx)*(x-cx)+(y-cy)*(y-cy), 6), x, y) rn from e join mid m using (code_a, code_b))
 select code_a, code_b, f1, f2, round(length, 6) length, vertices, x, y from r where rn = 1""",
    "sv_decimate": f"{L} select fid, count(*) vertices, round(sum(x+y), 3) total from verts where v = 0 or v = last_v or v % greatest(least(2, (last_v+1)//2), 1) = 0 group by fid",
    "sv_bend": f"""{L}, w as (select fid, v, last_v, x, y, lag(x) over o ax, lag(y) over o ay, lead(x) over o cx, lead(y) over o cy from verts window o as (partition by fid order by v)),
 k as (select *, 4*pi()*abs((x-ax)*(cy-ay)-(cx-ax)*(y-ay))/2/pow(sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay))+sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y))+sqrt((ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)), 2) c from w)
 select fid, count(*) vertices, round(sum(x+y), 3) total from k where v = 0 or v = last_v or last_v < 3 or c >= 0.05e0 group by fid""",
}

_KENT = """m2 as (select cx, cy, count(*) n, sum(l) l, sum(m) m, sum(z) z, sum(l*l) ll, sum(m*m) mm, sum(z*z) zz, sum(l*m) lm, sum(l*z) lz, sum(m*z) mz from cells group by all),
k1 as (select *, sqrt(l*l+m*m+z*z) r from m2), k2 as (select *, acos(greatest(-1e0, least(1e0, z/r))) t, case when abs(l/r) > 1e-12 then atan((m/r)/(l/r)) when m >= 0 then pi()/2 else -pi()/2 end p from k1 where r >= 1e-12),
k3 as (select *, cos(t)*cos(p) a1, -sin(p) a2, sin(t)*cos(p) a3, cos(t)*sin(p) b1, cos(p) b2, sin(t)*sin(p) b3 from k2),
k4 as (select *, (a1*a1*ll+a2*a2*mm+a3*a3*zz+2*a1*a2*lm+2*a1*a3*lz+2*a2*a3*mz)/n aa, (b1*b1*ll+b2*b2*mm+b3*b3*zz+2*b1*b2*lm+2*b1*b3*lz+2*b2*b3*mz)/n bb,
 (a1*b1*ll+a2*b2*mm+a3*b3*zz+(a1*b2+a2*b1)*lm+(a1*b3+a3*b1)*lz+(a2*b3+a3*b2)*mz)/n ab from k3),
k5 as (select *, case when abs(aa-bb) > 1e-12 then atan(2*ab/(aa-bb)) else 0e0 end w from k4), k6 as (select *, cos(w)*(aa-bb)+2*sin(w)*ab q from k5),
k7 as (select *, case when abs(2-2*r-q) > 1e-12 then 1/(2-2*r-q) else 'inf'::double end i, case when abs(2-2*r+q) > 1e-12 then 1/(2-2*r+q) else 'inf'::double end j from k6),
k8 as (select *, case when isnan(i+j) or i+j < 1e-6 then 1e-6 else i+j end kappa from k7),
kent as (select cx, cy, n, kappa, case when isnan(i-j) then 0e0 else greatest(0e0, least((i-j)*0.5e0, kappa/2-1e-9)) end beta from k8)"""
_CLUSTERS = """cs as (select fid, endpt_az, cos(radians(2*(endpt_az % 180e0))) x, sin(radians(2*(endpt_az % 180e0))) y from az),
far as (select *, round((x-1)*(x-1)+y*y, 12) d0, round((x+0.5e0)*(x+0.5e0)+(y-0.8660254e0)*(y-0.8660254e0), 12) d1, round((x+0.5e0)*(x+0.5e0)+(y+0.8660254e0)*(y+0.8660254e0), 12) d2 from cs),
labels as (select fid, endpt_az, case when endpt_az is null then null when d0 <= d1 and d0 <= d2 then 0 when d1 <= d2 then 1 else 2 end cluster from far)"""
_HEALTH = """f as (select * from segs), both_ as (select 0 part, * from f union all select 1, * from f where fid % 3 <> 0),
c as (select a.part, a.fid f1, b.fid f2, least(a.strat1, b.strat1) code_a, greatest(a.strat1, b.strat1) code_b, a.x0, a.y0, a.x1, a.y1 from both_ a join both_ b on a.part = b.part and a.seg_key = b.seg_key and a.fid < b.fid and a.strat1 <> b.strat1),
firsts as (select * from (select part, code_a, code_b, f1, f2, row_number() over (partition by part, code_a, code_b order by f1, f2) rn from (select distinct part, code_a, code_b, f1, f2 from c) q) p where rn = 1),
own as (select c.* from c join firsts using (part, code_a, code_b, f1, f2)),
vs as (select part, code_a, code_b, count(*) n from (select distinct part, code_a, code_b, x, y from (select part, code_a, code_b, x0 x, y0 y from own union all select part, code_a, code_b, x1, y1 from own) q) p group by all)"""

ORACLE |= {
    "pt_kent": f"{P}, {BINS}, {_KENT} select easting, northing, dip, dip_dir, means.n, round(kappa, 5)+0e0 kappa, round(beta, 5)+0e0 beta from means join kent using (cx, cy)",
    "cl_assign": f"{L}, {ENDS}, {_CLUSTERS} select fid, cluster from labels",
    "cl_stats": f"""{L}, {ENDS}, {_CLUSTERS} select cluster, count(*) n, round(stddev_pop(endpt_az), 4) std, round(min(endpt_az), 4) least, round(max(endpt_az), 4) most, round(count(*)*100e0/(select count(*) from labels where cluster is not null), 4) percentage
 from labels where cluster is not null group by cluster""",
    "tz_contact_health": f"""{G}, {_HEALTH} select a.code_a, a.code_b, case when b.n >= 3 then 'preserved' when b.n = 2 then 'minimal' when b.n = 1 then 'shape_lost' else 'boundary_diverged' end health
 from (select * from vs where part = 0) a left join (select * from vs where part = 1) b on a.code_a = b.code_a and a.code_b = b.code_b""",
    "tz_grid_snap": f"""{L}, q as (select fid, x/7 x, y/7 y, round_even(x/7, 2) rx, round_even(y/7, 2) ry from verts) select fid, bool_or(x <> rx or y <> ry) changed, round(sum(rx+ry), 2)+0e0 total from q group by fid""",
    "tz_significance": f"""{G}, {NET}, nk as (select concat_ws('|', x, y, x2, y2) seg_key from
 (select case when x0 < x1 or (x0 = x1 and y0 <= y1) then x0 else x1 end x, case when x0 < x1 or (x0 = x1 and y0 <= y1) then y0 else y1 end y, case when x0 < x1 or (x0 = x1 and y0 <= y1) then x1 else x0 end x2, case when x0 < x1 or (x0 = x1 and y0 <= y1) then y1 else y0 end y2 from net) q),
 n as (select seg_key, sum(p) p, sum(f) f from (select seg_key, 1 p, 0 f from segs union all select seg_key, 0, 1 from nk) q group by seg_key having sum(p)+sum(f) >= 2)
 select case when p > 0 and f > 0 then 'fault_polygon' when p >= 2 then 'polygon_polygon' else 'other' end kind, count(*) segments from n group by 1""",
    "tp_lines_chain": f"""{L}, {STEPS}, c as (select count(*) n from lens), n1 as (select round_even(n*0.75e0, 0) a, round_even(round_even(n*0.75e0, 0)*(0.5e0/0.75e0), 0) b from c),
 k as (select fid, row_number() over (order by round(len, 6) desc, fid) k from lens) select 1e0 ratio, fid from k union all select 0.75e0, fid from k, n1 where k <= a union all select 0.5e0, fid from k, n1 where k <= b""",
    "ln_merge_candidates": f"""{L}, e as (select a.fid, 'start' en, a.x, a.y, b.x ix, b.y iy, atan2(b.y-a.y, b.x-a.x) angle from verts a join verts b on a.fid = b.fid and a.v = 0 and b.v = 1
 union all select a.fid, 'end', a.x, a.y, b.x, b.y, atan2(a.y-b.y, a.x-b.x) from verts a join verts b on a.fid = b.fid and a.v = a.last_v and b.v = a.last_v - 1),
 p as (select a.fid fid1, a.en end1, b.fid fid2, b.en end2, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) distance, abs(a.angle-b.angle) d1, abs(a.angle-(b.angle+pi())) d2,
 (a.ix-a.x)*(b.ix-b.x)+(a.iy-a.y)*(b.iy-b.y) dot, sqrt((a.ix-a.x)*(a.ix-a.x)+(a.iy-a.y)*(a.iy-a.y))*sqrt((b.ix-b.x)*(b.ix-b.x)+(b.iy-b.y)*(b.iy-b.y)) mag from (select *, cast(floor(x/200) as bigint) gx, cast(floor(y/200) as bigint) gy from e) a join (select e.*, cast(floor(x/200) as bigint) + i gx, cast(floor(y/200) as bigint) + j gy from e, (values (-1), (0), (1)) s(i), (values (-1), (0), (1)) t(j)) b on a.gx = b.gx and a.gy = b.gy and a.fid < b.fid),
 q as (select *, degrees(least(least(d1, 2*pi()-d1), least(d2, 2*pi()-d2))) bend, case when mag > 0 then degrees(acos(greatest(-1e0, least(1e0, dot/mag)))) else 180e0 end joint from p where distance <= 200)
 select fid1, end1, fid2, end2, round(distance, 6) distance, round(distance + bend/30*200 + (180-joint)/60*200, 4) score from q where bend <= 30 and joint >= 120""",
}

_REACH = """nid as (select x, y, row_number() over (order by x, y) id from nnodes),
link as (select a.id u, b.id v from nedges e join nid a on e.x = a.x and e.y = a.y join nid b on e.x2 = b.x and e.y2 = b.y),
both_ways as (select u, v from link union all select v, u from link)"""
#: Nodes with the least node that they reach; the relation is closed step by step.
_COMPONENTS = f"with recursive {POLYGONS_SQL}, {NET}, {_REACH}, reach as (select id, id c from nid union select b.v, r.c from reach r join both_ways b on b.u = r.id), comp as (select id, min(c) c from reach group by id)"
_CHAINS = f"""with recursive {POLYGONS_SQL}, {NET}, eid as (select *, row_number() over (order by x, y, x2, y2) id from nedges),
touch as (select id, x, y from eid union all select id, x2, y2 from eid), two as (select x, y from nnodes where degree = 2),
near as (select a.id u, b.id v from touch a join two using (x, y) join touch b using (x, y) where a.id <> b.id),
reach as (select id, id c from eid union select n.v, r.c from reach r join near n on n.u = r.id), chain as (select id, min(c) c from reach group by id),
open_ends as (select c, min(node_type) a, max(node_type) b from chain join touch using (id) join ntypes using (x, y) where degree <> 2 group by c),
body as (select c, min(line_id) line_id, sum(length) length, count(*) segments from chain join eid using (id) group by c)"""


def _kent(sums: str, name: str, keys: str) -> str:
    """The estimator over a table of sums with the given keys."""
    return f"""{name}1 as (select *, sqrt(l*l+m*m+z*z) r from {sums}), {name}2 as (select *, acos(greatest(-1e0, least(1e0, z/r))) t, case when abs(l/r) > 1e-12 then atan((m/r)/(l/r)) when m >= 0 then pi()/2 else -pi()/2 end p from {name}1 where r >= 1e-12),
{name}3 as (select *, cos(t)*cos(p) a1, -sin(p) a2, sin(t)*cos(p) a3, cos(t)*sin(p) b1, cos(p) b2, sin(t)*sin(p) b3 from {name}2),
{name}4 as (select *, (a1*a1*ll+a2*a2*mm+a3*a3*zz+2*a1*a2*lm+2*a1*a3*lz+2*a2*a3*mz)/n aa, (b1*b1*ll+b2*b2*mm+b3*b3*zz+2*b1*b2*lm+2*b1*b3*lz+2*b2*b3*mz)/n bb,
 (a1*b1*ll+a2*b2*mm+a3*b3*zz+(a1*b2+a2*b1)*lm+(a1*b3+a3*b1)*lz+(a2*b3+a3*b2)*mz)/n ab from {name}3),
{name}5 as (select *, case when abs(aa-bb) > 1e-12 then atan(2*ab/(aa-bb)) else 0e0 end w from {name}4), {name}6 as (select *, cos(w)*(aa-bb)+2*sin(w)*ab q from {name}5),
{name}7 as (select *, case when abs(2-2*r-q) > 1e-12 then 1/(2-2*r-q) else 'inf'::double end i, case when abs(2-2*r+q) > 1e-12 then 1/(2-2*r+q) else 'inf'::double end j from {name}6),
{name} as (select {keys}, case when isnan(i+j) or i+j < 1e-6 then 1e-6 else i+j end kappa from {name}7)"""


_TERMS = "n l m z ll mm zz lm lz mz".split()
_OUTLIER = f"""c2 as (select fid, cx, cy, minx, miny, 1 n, l, m, z, l*l ll, m*m mm, z*z zz, l*m lm, l*z lz, m*z mz from cells),
all_ as (select cx, cy, {', '.join(f'sum({c}) {c}' for c in _TERMS)} from c2 group by cx, cy having count(*) > 3),
rest as (select c2.fid, cx, cy, minx, miny, {', '.join(f'a.{c} - c2.{c} {c}' for c in _TERMS)} from c2 join all_ a using (cx, cy)),
{_kent('all_', 'whole', 'cx, cy')}, {_kent('rest', 'less_', 'fid, cx, cy')},
picked as (select * from (select rest.*, less_.kappa, row_number() over (partition by rest.cx, rest.cy order by round(coalesce(less_.kappa, 1e-6) - coalesce(whole.kappa, 1e-6), 9) desc, rest.fid) rn
 from rest left join less_ on less_.fid = rest.fid and less_.cx = rest.cx and less_.cy = rest.cy left join whole on whole.cx = rest.cx and whole.cy = rest.cy) q where rn = 1 and kappa is not null),
dir as (select *, sqrt(l*l+m*m+z*z) r from picked)"""
_FILL = f"""{G}, {AREAS}, gone as (select * from segs where fid % 50 = 25), there as (select * from segs where fid % 50 <> 25),
met as (select g.fid gap, t.fid, sum(g.length) shared, count(*) sides from gone g join there t on g.seg_key = t.seg_key group by all),
inner_ as (select gap from met group by gap having sum(sides) = 4),
filler as (select gap, fid from (select *, row_number() over (partition by gap order by round(shared, 6) desc, fid) rn from met join inner_ using (gap)) q where rn = 1)"""
ORACLE |= {
    "net_components": f"{_COMPONENTS} select n.x, n.y, count(*) nodes from comp join nid n on n.id = comp.c group by all",
    "net_stats": f"""{_COMPONENTS}, size as (select c, count(*) n from comp group by c) select (select count(*) from nnodes) nodes, (select count(*) from nedges) edges, (select count(*) from size) components, (select max(n) from size) largest_component,
 (select round(avg(degree), 6) from nnodes) mean_degree, (select max(degree) from nnodes) max_degree, (select count(*) from nnodes where degree > 2) branching, (select count(*) from nnodes where degree = 1) dead_ends, cast(0 as bigint) isolated, (select round(sum(length), 3) from nedges) total_length""",
    "net_contract": f"{_CHAINS} select line_id, round(length, 6) length, segments, case when a is not null then a||'-'||b end edge_type from body left join open_ends using (c)",
    "net_chain_lines": f"{_CHAINS} select line_id fid, segments + 1 vertices, round(length, 6) length from body",
    "pt_outlier_single": f"""{P}, {BINS}, {_OUTLIER} select cast(trunc(minx+(cx+0.5e0)*5000e0) as bigint) easting, cast(trunc(miny+(cy+0.5e0)*5000e0) as bigint) northing,
 case when r >= 1e-12 then cast(trunc(round(90e0-degrees(asin(greatest(-1e0, least(1e0, z/r)))), 9)) as bigint) end dip, case when r >= 1e-12 then cast(trunc(round((720e0+degrees(atan2(l/r, m/r))) % 360e0, 9)) as bigint) end dip_dir, cast(n as bigint) n, fid removed_fid from dir""",
    "pt_methods": f"""{P}, {BINS}, {POLYGONS_SQL}, {_NEAR} select 'decimation' method, cast(ceil(count(*)/4e0) as bigint) n from points union all select 'stochastic', cast(round_even(count(*)*0.25e0, 0) as bigint) from points union all select 'gridcell', count(*) from means
 union all select 'firstorder', count(*) from best, lateral (select abs(azimuth - (dip_dir + 270e0) % 180e0) % 180e0 dd) t where least(dd, 180e0-dd) <= 15""",
    "tz_gaps": f"{_FILL} select f.fid filler, round(a.area, 6) area from filler f join areas a on a.fid = f.gap",
    "tz_gap_fill": f"{_FILL} select a.fid, round(a.area + coalesce(sum(b.area), 0), 6) area from areas a left join filler f on f.fid = a.fid left join areas b on b.fid = f.gap where a.fid % 50 <> 25 group by a.fid, a.area",
    "tz_gap_fill_rings": f"{_FILL} select a.fid, round(a.area + coalesce(sum(b.area), 0), 6) area, cast(0 as bigint) holes from areas a left join filler f on f.fid = a.fid left join areas b on b.fid = f.gap where a.fid % 50 <> 25 group by a.fid, a.area",
    "tz_midpoint_snap": f"""{L}, {POLYGONS_SQL}, f as (select fid, v, case when v = 0 then round(x, -2) else x end x, case when v = 0 then round(y, -2) else y end y from verts where v < 2),
 g as (select x, y, min(struct_pack(fid := fid, v := v)) o from f group by x, y), p as (select distinct x, y from pverts),
 b as (select g.x, g.y, p.x px, p.y py, row_number() over (partition by g.x, g.y order by round(sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)), 12), p.x, p.y) rn from g join p on p.x between g.x-300 and g.x+300 and p.y between g.y-300 and g.y+300 where sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)) <= 300)
 select x, y, round((x+px)/2, 4) mx, round((y+py)/2, 4) my from b where rn = 1""",
    "schema_candidates": f"""{G}, c as (select fid, unnest(['strat1', 'strat2', 'lith']) "column", unnest([strat1, strat2, lith]) v from polys), f as (select "column", v, min(fid) seen from c where v is not null and trim(v) <> '' group by all),
 k as (select *, row_number() over (partition by "column" order by seen) rn from f) select "column", 'string' "type", string_agg(v, ',' order by seen) samples, true candidate from k where rn <= 5 group by "column" """,
    "sv_matrix": f"""{L}, w as (select fid, v, last_v, x, y, lag(x) over o ax, lag(y) over o ay, lead(x) over o cx, lead(y) over o cy from verts window o as (partition by fid order by v)),
 k as (select *, 4*pi()*abs((x-ax)*(cy-ay)-(cx-ax)*(y-ay))/2/pow(sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay))+sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y))+sqrt((ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)), 2) c from w),
 m(method, tolerance) as (values ('decimation', 2e0), ('decimation', 0.1e0), ('bend', 2e0), ('bend', 0.1e0))
 select method, tolerance, count(distinct fid) features, count(*) "before", count(*) filter (v = 0 or v = last_v or (method = 'decimation' and v % greatest(case when tolerance >= 1 then least(2, (last_v+1)//2) else 10 end, 1) = 0) or (method = 'bend' and (last_v < 3 or c >= tolerance))) "after" from k, m group by all""",
    "sv_faults": f"{G}, {NET} select line_id fid, cast(2 as bigint) vertices, round(x0+y0+x1+y1, 3) total from net",
    "pg_triangulate_holes": f"{G}, {AREAS} select fid, round(area, 3) area from areas where not (fid % 50 = 0 and lith = 'BUILDING')",
    "pg_filler": f"""{G}, h as (select fid, ((fid + 42)*48271 % 2147483647) % 100000 + 1 h, ((fid + 7)*48271 % 2147483647) % 100000 + 1 g from polys) select fid, h whole, round(h/1000e0, 3) small, 's' || g "text" from h""",
    "tp_polygons_chain": f"""{N}, {NAREAS} select ratio, count(*) originals, round(sum(area), 3) area, true drawn, true few from nareas, (values (1e0), (0.9e0), (0.8e0)) t(ratio) group by ratio""",
    "pg_clean_series": f"""{N}, {NAREAS} select threshold, count(*) originals, round(sum(area), 3) area, true drawn, cast(0 as bigint) under from nareas, (values (50000e0), (5e6)) t(threshold) group by threshold""",
    "pg_lineage_fields": f"""{G}, t as (select cast(floor(fid/40e0) as bigint) fid, string_agg(cast(fid as varchar), ',' order by fid) t from polys group by 1)
 select fid, substr(t, 1, 100) inherit, substr(t, 101, 100) inherit1, substr(t, 201, 100) inherit2, substr(t, 301, 100) inherit3 from t""",
    "pg_thresholds": f"{G}, {AREAS}, s as (select cast(k as integer) step, pi()*(k*0.5e0/2)*(k*0.5e0/2)*1e6 threshold from range(0, 7) t(k)) select step, round(threshold, 3)+0e0 threshold, count(*) filter (area < threshold) under from s, areas group by all",
    "src_wkt": f"{D} select fid, cast(1 as integer) parts, cast(count(*) as integer) vertices, round(sum(x+y), 9) total from pverts group by fid",
    "cl_trends": "select o_orderkey fid, cast(o_orderkey % 360 as double) trend from orders where o_orderkey % 3 <> 0",
    "tp_points_chain": f"{P} select ratio, cast(case when ratio = 1 then count(*) else round_even(count(*)*pow(ratio, 0.5e0), 0) end as bigint) n from points, (values (1e0), (0.75e0), (0.5e0)) t(ratio) group by ratio",
    "tp_prepared_offset": f"""{L}, {STEPS}, {POLYGONS_SQL}, {_PROBES}, {_UNITS}, one as (select fid, max(offset_level) mo from ranked group by fid)
 select fid, cast(mo as integer) max_offset from (select l.fid, mo, row_number() over (order by abs(mo) desc nulls last, round(len, 6) desc, l.fid) k, count(*) over () n from lens l left join one on one.fid = l.fid) q where k <= round_even(n*0.2e0, 0)""",
    "tp_prepared_graph": f"{_CHAINS}, types as (select line_id, min(case when a is not null then a||'-'||b end) et from body left join open_ends using (c) group by line_id) select net.line_id fid, et edge_type from net left join types on types.line_id = net.line_id",
    "tz_invalid": f"{G} select fid, case fid % 20 when 3 then 'crosses itself' when 7 then 'open' else 'too short' end reason from polys where fid % 20 in (3, 7, 9)",
}
ORACLE["tz_boundary_pins"] = ORACLE["tz_exterior_vertices"]  # the mosaic's outline is no rectangle

#: Lines as lists of coordinates, for the two recursive simplifications.
_LISTS = f"{L.replace('with', 'with recursive', 1)}, lists as (select fid, list(x order by v) xs, list(y order by v) ys from verts group by fid)"
ORACLE |= {
    "sv_dp": f"""{_LISTS}, parts(fid, i, j) as (select fid, cast(1 as bigint), cast(len(xs) as bigint) from lists union all
 select fid, unnest([i, mid]), unnest([mid, j]) from (select fid, i, j, i + list_position(far, list_max(far)) mid, list_max(far) farthest from (
  select p.fid, i, j, list_transform(range(i+1, j), lambda k: case when xs[i] = xs[j] and ys[i] = ys[j] then sqrt((xs[k]-xs[i])**2 + (ys[k]-ys[i])**2)
   else abs((xs[j]-xs[i])*(ys[i]-ys[k]) - (xs[i]-xs[k])*(ys[j]-ys[i])) / sqrt((xs[j]-xs[i])**2 + (ys[j]-ys[i])**2) end) far from parts p join lists l on p.fid = l.fid where j > i+1) q) q where farthest > 100),
kept as (select distinct fid, unnest([i, j]) k from parts)
 select fid, count(*) vertices, round(sum(xs[k] + ys[k]), 3) total from kept join lists using (fid) group by fid""",
    "sv_vw": f"""{_LISTS}, left_over(fid, ks) as (select fid, range(1, len(xs)+1) from lists union all
 select fid, list_filter(ks, lambda k, t: t <> 1 + list_position(corners, list_min(corners))) from (
  select r.fid, ks, list_transform(range(2, len(ks)), lambda t: abs((xs[ks[t]]-xs[ks[t-1]])*(ys[ks[t+1]]-ys[ks[t-1]]) - (xs[ks[t+1]]-xs[ks[t-1]])*(ys[ks[t]]-ys[ks[t-1]]))/2) corners
  from left_over r join lists l on r.fid = l.fid where len(ks) > 2) q where list_min(corners) < 20000),
kept as (select fid, unnest(arg_min(ks, len(ks))) k from left_over group by fid)
 select fid, count(*) vertices, round(sum(xs[k] + ys[k]), 3) total from kept join lists using (fid) group by fid""",
    "ln_length_degrees": f"""{L}, small as (select fid, v, x/1e5 x, y/1e5-30 y from verts), d as (select fid, v, y, lead(y) over w y1, sqrt(power(lead(x) over w - x, 2) + power(lead(y) over w - y, 2)) len from small window w as (partition by fid order by v)),
 t as (select fid, sum(len) len, sum(len*(y+y1)/2)/sum(len) lat from d where y1 is not null group by fid) select fid, round(len*111139e0*cos(radians(lat)), 3) length, round(lat, 6) centroid_lat from t""",
    "net_shipped": f"""{G}, {NET}, named as (select *, row_number() over (order by x, y) - 1 node_id from ntypes)
 select a.node_id start_node, b.node_id end_node, round(length, 6) length, line_id, a.node_type start_type, b.node_type end_type, least(a.node_type, b.node_type)||'-'||greatest(a.node_type, b.node_type) edge_type
 from nedges e join named a on e.x = a.x and e.y = a.y join named b on e.x2 = b.x and e.y2 = b.y""",
    # members are neighbours in one row of the mosaic, so a group has one ring
    "tz_overlap_fix": f"{G} select fid, (case when i > 0 then 2500e0 else 3000e0 end)*(case when j > 0 then 2500e0 else 3000e0 end) area, cast(1 as bigint) members, cast(0 as bigint) holes from polys",
    "sv_map_sound": f"""{N}, e as (select *, x1-x0 dx, y1-y0 dy, (((cast((x0+x1)*7 + (y0+y1)*3 as bigint) % 11) + 11) % 11 - 5)/200e0 k, x0 > x1 or (x0 = x1 and y0 > y1) t from nsegs),
 w as (select *, case when t then -1e0 else 1e0 end g, k*case when t then 0.5e0 else 1e0 end a, k*case when t then 1e0 else 0.5e0 end b from e),
 v as (select *, x0+dx*0.25e0-dy*g*a px, y0+dy*0.25e0+dx*g*a py, x0+dx*0.75e0-dy*g*b qx, y0+dy*0.75e0+dx*g*b qy from w),
 z as (select sign, fid, case when fid >= 10000000 then cast(floor(x0/2500e0) as bigint)*1000000 + cast(floor(y0/2500e0) as bigint) else 0 end part, abs(sum(x0*py-px*y0 + px*qy-qx*py + qx*y1-x1*qy))/2 area from v group by all)
 select count(distinct fid) features, count(*) filter (sign > 0) members, count(*) filter (sign < 0) holes, round(sum(sign*area), 0) area, cast(0 as bigint) own_crossings, cast(0 as bigint) crossings, cast(0 as bigint) invalid from z""",
    "pg_area_rings": f"""{N}, {NAREAS} select fid, round(area, 6) area, members, holes, round(perimeter, 6) perimeter from nareas""",
    "pg_centroids": f"""{N}, c as (select fid, min(x0) ox, min(y0) oy from nsegs group by fid), m as (select n.fid, n.sign, x0-ox ax, y0-oy ay, x1-ox bx, y1-oy by_, ox, oy from nsegs n join c on c.fid = n.fid)
 select fid, round(any_value(ox) + sum(sign*(ax+bx)*(ax*by_-bx*ay))/(3*sum(sign*(ax*by_-bx*ay))), 4) x, round(any_value(oy) + sum(sign*(ay+by_)*(ax*by_-bx*ay))/(3*sum(sign*(ax*by_-bx*ay))), 4) y from m group by fid""",
    "pg_adjacency_rings": f"{G}, {PAIRS} select fid1, fid2, round(shared, 6) shared from pairs union all select fid, 10000000 + fid//100, 800e0 from polys where fid % 50 = 0",
    "pg_dissolve_rings": f"""{N}, {NAREAS}, {PAIRS}, inside_ as (select fid1//4 g, sum(shared) shared from pairs where fid1//4 = fid2//4 group by 1), t as (select fid//4 g, sum(area) area, sum(holes) holes, sum(perimeter) perimeter from nareas where fid < 10000000 group by 1)
 select t.g fid, round(area, 6) area, cast(1 as bigint) members, cast(holes as bigint) holes, round(perimeter - 2*coalesce(shared, 0), 6) perimeter from t left join inside_ i on i.g = t.g""",
    "src_members": f"""{G}, {AREAS} select fid, cast(0 as bigint) member, cast(0 as bigint) ring_no, cast(5 as bigint) vertices, round(area, 6) area from areas union all select fid, 0, 1, 5, 40000e0 from polys where fid % 50 = 0
 union all select 10000000 + fid//100, (fid//50) % 2, 0, 5, 40000e0 from polys where fid % 50 = 0""",
    "so_pip_rings": f"""{N}, {POINTS_SQL}, q as (select fid pid, easting+0.25e0 px, northing+0.25e0 py from points union all select 10000000 + fid, i*2500 + 1250.5e0, j*2500 + 1250.5e0 from polys where fid % 25 = 0),
 boxes as (select fid, min(x0) bx0, max(x0) bx1, min(y0) by0, max(y0) by1 from nsegs group by fid)
 select pid, b.fid from q join boxes b on px >= bx0 and px <= bx1 and py >= by0 and py <= by1 where (select count(*) from nsegs s where s.fid = b.fid and (s.y0 > py) <> (s.y1 > py) and px < s.x0 + (py-s.y0)*(s.x1-s.x0)/(s.y1-s.y0)) % 2 = 1""",
    "pg_dissolve": f"{G}, {AREAS} select cast(floor(fid/4e0) as bigint) fid, cast(1 as bigint) rings, round(sum(area), 6) area from areas group by 1",
}
_PLACED = f"""b as (select cast(trunc(min(easting)) as bigint) minx, cast(trunc(max(easting)) as bigint)+1 maxx, cast(trunc(min(northing)) as bigint) miny, cast(trunc(max(northing)) as bigint)+1 maxy from points),
own as (select p.*, b.*, cast(floor((easting-minx)/5000e0) as bigint) ox, cast(floor((northing-miny)/5000e0) as bigint) oy from points p, b),
touched as (select own.*, ox-i cx, oy-j cy, sin(radians(dip))*sin(radians(dip_dir)) l, sin(radians(dip))*cos(radians(dip_dir)) m, cos(radians(dip)) z from own, (values (0), (1)) a(i), (values (0), (1)) c(j)
 where (i = 0 or easting-minx = ox*5000) and (j = 0 or northing-miny = oy*5000) and ox-i between 0 and floor((maxx-minx-1e-9)/5000e0) and oy-j between 0 and floor((maxy-miny-1e-9)/5000e0)),
c2 as (select fid, cx, cy, minx, miny, 1 n, l, m, z, l*l ll, m*m mm, z*z zz, l*m lm, l*z lz, m*z mz from touched),
all_ as (select cx, cy, {', '.join(f'sum({c}) {c}' for c in _TERMS)} from c2 group by cx, cy having count(*) > 3 and sqrt(sum(l)**2+sum(m)**2+sum(z)**2) >= 1e-12),
far as (select c2.*, round(degrees(acos(greatest(-1e0, least(1e0, (c2.l*a.l+c2.m*a.m+c2.z*a.z)/sqrt(a.l**2+a.m**2+a.z**2))))), 9) away from c2 join all_ a using (cx, cy)),
gone as (select fid, cx, cy, minx, miny, row_number() over w step, {', '.join(f'sum({c}) over w {c}' for c in _TERMS)} from far window w as (partition by cx, cy order by away desc, fid desc rows unbounded preceding)),
rest as (select g.fid, cx, cy, minx, miny, step, {', '.join(f'a.{c} - g.{c} {c}' for c in _TERMS)} from gone g join all_ a using (cx, cy) where step <= floor(a.n/2)),
{_kent('all_', 'whole', 'cx, cy')}, {_kent('rest', 'less_', 'fid, cx, cy')},
rises as (select rest.cx, rest.cy, minx, miny, step, rest.n, less_.kappa, whole.kappa k0, a.n n0,
 round(coalesce(less_.kappa, 1e-6) - coalesce(lag(coalesce(less_.kappa, 1e-6)) over (partition by rest.cx, rest.cy order by step), whole.kappa, 1e-6), 9) rise
 from rest join all_ a using (cx, cy) left join less_ on less_.fid = rest.fid and less_.cx = rest.cx and less_.cy = rest.cy left join whole on whole.cx = rest.cx and whole.cy = rest.cy),
best as (select * from (select *, row_number() over (partition by cx, cy order by rise desc, step) rn from rises) q where rn = 1)"""
ORACLE["pt_outlier_carmichael"] = f"""{P}, {_PLACED} select cast(trunc(minx+cx*5000e0+2500e0) as bigint) easting, cast(trunc(miny+cy*5000e0+2500e0) as bigint) northing,
 cast(case when rise > 0 then n else n0 end as bigint) n, cast(case when rise > 0 then step else 0 end as integer) n_removed from best where case when rise > 0 then kappa else k0 end is not null"""
