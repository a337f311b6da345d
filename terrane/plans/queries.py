"""One query for each operator over layers derived from the shipped tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import scalar as S
from terrane.operators import clusters, lines, network, offsets, points, polygons, rings, selection, simplify, spatial, topology
from terrane.sources import fixtures as X

SIZE = 5000.0
SMALL = 5e6
STRATA = ["strat1", "strat2", "lith"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# ---------------------------------------------------------------- points
@query
def pt_setup_strike(spark, d):
    rows = X.points(spark, d)
    return points.set_up(rows, strike="dip_dir").select("fid", "easting", "northing", "dip", "dip_dir")


@query
def pt_standardise(spark, d):
    return points.standardise(X.points(spark, d), strike="dip_dir", equals=("kind", "click"))


@query
def pt_cosines(spark, d):
    l, m, n = S.direction_cosines(F.col("dip"), F.col("dip_dir"))  # noqa: E741
    dip, direction = S.dip_and_direction(l, m, n)
    return X.points(spark, d).where("dip > 0").select("fid", r(l).alias("l"), r(m).alias("m"), r(n).alias("n"), r(dip, 4).alias("dip"), r(F.pmod(F.round(direction, 4), F.lit(360.0)), 4).alias("dip_dir"))


@query
def pt_bounds(spark, d):
    return points.bounds(X.points(spark, d))


@query
def pt_decimation(spark, d):
    return points.decimate(X.points(spark, d), 5).select("fid", "easting", "northing")


@query
def pt_stochastic_exact(spark, d):
    return points.stochastic(X.points(spark, d), 0.3, 42).select("fid", "easting", "northing")


@query
def pt_grid_average(spark, d):
    return points.grid_average(X.points(spark, d), SIZE)


@query
def pt_kent(spark, d):
    return points.spherical_kent(X.points(spark, d), SIZE).select("easting", "northing", "dip", "dip_dir", "n", r("kappa", 5).alias("kappa"), r("beta", 5).alias("beta"))


@query
def pt_outlier_single(spark, d):
    return points.remove_outlier(X.points(spark, d), SIZE).select("easting", "northing", "dip", "dip_dir", "n", "removed_fid")


@query
def pt_outlier_carmichael(spark, d):
    return points.remove_outliers_by_break(X.points(spark, d), SIZE).select("easting", "northing", "n", "n_removed")


@query
def pt_first_order(spark, d):
    contacts = spatial.segment_azimuths(X.polygons(spark, d), "ring")
    return points.first_order(X.points(spark, d), contacts, 500.0, 15.0).select("fid", r("distance").alias("distance"), r("azimuth").alias("azimuth"))


@query
def pt_target_n_probe(spark, d):
    return points.cell_counts(X.points(spark, d), [2500.0, 5000.0, 10000.0, 20000.0]).select("size", "cells")


@query
def pt_target_n_grid(spark, d):
    rows = X.points(spark, d)
    return points.grid_average(rows, points.grid_size_for(rows, 100))


@query
def pt_methods(spark, d):
    contacts = spatial.segment_azimuths(X.polygons(spark, d), "ring")
    return points.run_methods(X.points(spark, d), {"decimation": {"n": 4}, "stochastic": {"fraction": 0.25}, "gridcell": {"size": SIZE}, "firstorder": {"buffer": 500.0, "tolerance": 15.0}}, contacts)


# ---------------------------------------------------------------- selection
@query
def tp_counts(spark, d):
    ratios = F.explode(F.array(*(F.lit(v) for v in selection.ratio_schedule(0.1, 0.1)))).alias("ratio")
    n = X.points(spark, d).groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", ratios)
    of = lambda x: F.greatest(F.lit(1), F.bround(F.col("n") * F.pow("ratio", F.lit(x / 2)))).cast("bigint")
    return n.select("kind", "n", "ratio", of(1).alias("points"), of(2).alias("lines"), of(3).alias("areas"))


@query
def tp_lines_length(spark, d):
    return selection.select_lines(X.lines(spark, d), 0.1).select("fid", r(S.line_length(F.col("geom"))).alias("length"))


@query
def tp_lines_graph(spark, d):
    kinds = F.when(F.col("fid") % 4 == 0, "X-X").when(F.col("fid") % 4 == 1, "Y-Z").when(F.col("fid") % 4 == 2, "Z-Z")
    return selection.select_lines(X.lines(spark, d).withColumn("edge_type", kinds), 0.3, "graph").select("fid", F.coalesce("edge_type", F.lit("")).alias("edge_type"))


@query
def tp_lines_offset(spark, d):
    return selection.select_lines(X.lines(spark, d).withColumn("max_offset", F.when(F.col("fid") % 3 > 0, F.col("fid") % 7 - 3)), 0.2, "strat_offset").select("fid", "max_offset")


@query
def tp_lines_clusters(spark, d):
    return selection.select_lines(X.lines(spark, d).withColumn("cluster", F.floor(F.sqrt(F.col("fid") % 50))), 0.2, "clusters").select("fid", "cluster")


@query
def tp_points_scaled(spark, d):
    return selection.scale_points(X.points(spark, d), 0.1, "stochastic").select("fid", "easting", "northing")


@query
def tp_lines_chain(spark, d):
    steps = selection.multi_scale_lines(X.lines(spark, d), 0.5, 0.25)
    out = None
    for ratio, rows in steps.items():
        one = rows.select(F.lit(ratio).alias("ratio"), "fid")
        out = one if out is None else out.union(one)
    return out


# ---------------------------------------------------------------- lines
@query
def ln_length(spark, d):
    rows = lines.add_length(lines.add_length(X.lines(spark, d), "m"), "mi", "miles")
    return lines.add_length(lines.add_length(rows, "ft", "feet"), "km", "kilometers").select("fid", r("m").alias("m"), r("km").alias("km"), r("ft", 4).alias("ft"), r("mi").alias("mi"))


@query
def ln_length_degrees(spark, d):
    small = X.lines(spark, d).withColumn("geom", F.transform("geom", lambda p: F.struct((p["x"] / 1e5).alias("x"), (p["y"] / 1e5 - 30).alias("y"))))
    return lines.add_length(small, "length", "degrees").select("fid", r("length", 3).alias("length"), r("centroid_lat").alias("centroid_lat"))


@query
def ln_min_filter(spark, d):
    return lines.min_length(X.lines(spark, d), 2000.0).select("fid")


@query
def ln_min_parts(spark, d):
    two = X.lines(spark, d).withColumn("parts", F.array(F.slice("geom", 1, 2), F.slice("geom", 2, 10)))
    return lines.min_length_parts(two, 900.0).select("fid", F.size("parts").cast("bigint").alias("parts"))


@query
def ln_filter_statistics(spark, d):
    got = lines.length_statistics(X.lines(spark, d), 2000.0)
    return got.select("original_count", "filtered_count", "removed_count", r("original_length", 2).alias("original_length"), r("filtered_length", 2).alias("filtered_length"), r("removed_percent").alias("removed_percent"))


@query
def ln_azimuth(spark, d):
    return lines.add_azimuth(X.lines(spark, d)).select("fid", r("endpt_az").alias("endpt_az"))


@query
def ln_explode_parts(spark, d):
    two = X.lines(spark, d).withColumn("parts", F.array(F.slice("geom", 1, 2), F.slice("geom", 2, 10)))
    return lines.explode_parts(two).select("fid", F.col("part_no").cast("bigint").alias("part_no"), F.size("geom").cast("bigint").alias("vertices"))


@query
def ln_merge_candidates(spark, d):
    return lines.merge_candidates(X.lines(spark, d), 200.0, 30.0, 120.0).select("fid1", "end1", "fid2", "end2", r("distance").alias("distance"), r("score", 4).alias("score"))


def _cut_lines(spark, d):
    """Lines of the layer cut at their second vertex, so that merging puts them together."""
    rows = X.lines(spark, d)
    return rows.select((F.col("fid") * 2).alias("fid"), F.slice("geom", 1, 2).alias("geom")).union(rows.select((F.col("fid") * 2 + 1).alias("fid"), F.slice("geom", 2, 10).alias("geom")))


@query
def ln_merge(spark, d):
    return lines.merge_lines(_cut_lines(spark, d), 1.0, 30.0, 150.0).select("fid", F.size("geom").alias("vertices"), "members")


@query
def cl_rose(spark, d):
    return lines.rose(lines.add_azimuth(X.lines(spark, d)), "endpt_az").select(F.col("bin_start").cast("bigint").alias("bin_start"), "n", F.col("opposite_start").cast("bigint").alias("opposite_start"))


CENTRES = [(1.0, 0.0), (-0.5, 0.8660254), (-0.5, -0.8660254)]


@query
def cl_assign(spark, d):
    return clusters.assign(lines.add_azimuth(X.lines(spark, d)), "endpt_az", CENTRES).select("fid", "cluster")


@query
def cl_stats(spark, d):
    got = clusters.cluster_statistics(clusters.assign(lines.add_azimuth(X.lines(spark, d)), "endpt_az", CENTRES), "endpt_az")
    return got.select("cluster", "n", r("std", 4).alias("std"), r("least", 4).alias("least"), r("most", 4).alias("most"), r("percentage", 4).alias("percentage"))


@query
def cl_kmeans(spark, d):
    rows = lines.add_azimuth(X.lines(spark, d))
    return clusters.assign(rows, "endpt_az", clusters.fit(rows, "endpt_az", 3)).groupBy("cluster").agg(F.count("*").alias("n"), F.first("cluster_center").alias("center"))


@query
def cl_best_k(spark, d):
    rows = lines.add_azimuth(X.lines(spark, d))
    k, scores = clusters.best_k(rows, "endpt_az")
    return spark.createDataFrame([(n, s, n == k) for n, s in scores.items()], "k int, silhouette double, best boolean")


# ---------------------------------------------------------------- network
def _network(spark, d):
    return network.build(X.cells_network(spark, d))


@query
def net_edges(spark, d):
    _, edges = _network(spark, d)
    return edges.select("a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), "line_id", r("length").alias("length"))


@query
def net_node_types(spark, d):
    return network.degrees(*_network(spark, d)).select("x", "y", "degree", "node_type")


@query
def net_edge_types(spark, d):
    return network.edge_types(*_network(spark, d)).groupBy("edge_type").agg(F.count("*").alias("n"), r(F.sum("length"), 3).alias("length"))


@query
def net_components(spark, d):
    got = network.node_components(*_network(spark, d))
    return got.groupBy(F.col("component.x").alias("x"), F.col("component.y").alias("y")).agg(F.count("*").alias("nodes"))


@query
def net_stats(spark, d):
    got = network.statistics(*_network(spark, d))
    return got.select("nodes", "edges", "components", "largest_component", r("mean_degree").alias("mean_degree"), "max_degree", "branching", "dead_ends", "isolated", r("total_length", 3).alias("total_length"))


@query
def net_contract(spark, d):
    got = network.contract(*_network(spark, d))
    return got.select("line_id", r("length").alias("length"), "segments", "edge_type")


@query
def net_chain_lines(spark, d):
    got = network.chain_lines(*_network(spark, d))
    return got.select("fid", F.size("geom").cast("bigint").alias("vertices"), r(S.line_length(F.col("geom"))).alias("length"))


@query
def net_paths(spark, d):
    return network.sample_paths(*_network(spark, d))


@query
def net_betweenness(spark, d):
    return network.centrality(*_network(spark, d))


@query
def net_shipped(spark, d):
    return network.shipped(*_network(spark, d))[1].withColumn("length", r("length"))


# ---------------------------------------------------------------- offsets
@query
def so_probe_points(spark, d):
    return offsets.probe_points(X.lines(spark, d), 50.0).select("fid", "location", "side", r("x", 4).alias("x"), r("y", 4).alias("y"))


@query
def so_pip_join(spark, d):
    p = X.points(spark, d).select(F.col("fid").alias("pid"), (F.col("easting") + 0.25).alias("x"), (F.col("northing") + 0.25).alias("y"))
    return spatial.points_in_polygons(p, X.polygons(spark, d), 2500.0)


@query
def so_pip_rings(spark, d):
    p = X.points(spark, d).select(F.col("fid").alias("pid"), (F.col("easting") + 0.25).alias("x"), (F.col("northing") + 0.25).alias("y"))
    middle = X.polygons(spark, d).where("fid % 25 = 0").select((F.col("fid") + 10_000_000).alias("pid"), ((F.col("fid") % 40) * 2500 + 1250.5).alias("x"), (F.floor(F.col("fid") / 40.0) * 2500 + 1250.5).alias("y"))
    return spatial.points_in_polygons(p.union(middle), X.nested_mosaic(spark, d))


def _offset(spark, d):
    return offsets.fault_offsets(X.lines(spark, d), X.polygons(spark, d), ["strat1", "strat2", "lith"])


@query
def so_offset_level(spark, d):
    probes = offsets.units_inside(offsets.probe_points(X.lines(spark, d)), X.polygons(spark, d), STRATA)
    return offsets.location_offsets(probes, STRATA).select("fid", "location", "offset_level", F.concat_ws(",", "side1_units").alias("side1_units"), F.concat_ws(",", "side2_units").alias("side2_units"))


@query
def so_fault_offsets(spark, d):
    return _offset(spark, d).where("max_offset is not null").select("fid", "max_offset", "max_location", "max_description", "start_offset", "midpoint_offset", "end_offset")


@query
def so_fault_summary(spark, d):
    return offsets.offset_summary(_offset(spark, d))


# ---------------------------------------------------------------- polygons
@query
def pg_area(spark, d):
    return polygons.with_area(X.polygons(spark, d)).select("fid", r("area").alias("area"))


@query
def pg_large(spark, d):
    return polygons.large(X.polygons(spark, d), SMALL).select("fid")


@query
def pg_adjacency(spark, d):
    return polygons.adjacency(X.polygons(spark, d)).select("fid1", "fid2", r("shared").alias("shared"))


@query
def pg_adjacency_degrees(spark, d):
    return polygons.adjacency(X.in_degrees(X.polygons(spark, d))).select("fid1", "fid2", r("shared", 9).alias("shared"))


@query
def pg_merge_target(spark, d):
    p = polygons.with_area(X.polygons(spark, d))
    return polygons.merge_targets(p.where(F.col("area") < SMALL), p, polygons.adjacency(p), STRATA).select("fid", "target", r("shared").alias("shared"), "reason")


@query
def pg_clean_small(spark, d):
    got, _ = polygons.clean_small(X.polygons(spark, d), SMALL, STRATA)
    return got.select("fid", r("area").alias("area"), F.concat_ws(" ", F.transform("inherit", lambda x: x.cast("string"))).alias("inherit"))


@query
def pg_clean_reasons(spark, d):
    return polygons.clean_small(X.polygons(spark, d), SMALL, STRATA)[1]


@query
def pg_merge_to_count(spark, d):
    p = X.polygons(spark, d)
    got = polygons.merge_to_count(p, max(1, p.count() * 3 // 4), ["lith", "strat1", "strat2"])
    return got.select("fid", r("area").alias("area"), F.size("inherit").alias("members"))


@query
def pg_scaled(spark, d):
    return polygons.scale_polygons(X.polygons(spark, d), 0.8, ["lith", "strat1", "strat2"]).select("fid", r("area").alias("area"), F.size("inherit").alias("members"))


@query
def pg_dissolve(spark, d):
    p = X.polygons(spark, d)
    return polygons.dissolve(p, p.select(F.col("fid").alias("member"), F.floor(F.col("fid") / 4).alias("group"))).groupBy("fid").agg(F.count("*").alias("rings"), r(F.sum(S.ring_area(F.col("ring")))).alias("area"))


def _with_holes(spark, d):
    p = X.polygons(spark, d)
    cx, cy = (F.col("ring")[0]["x"] + F.col("ring")[2]["x"]) / 2, (F.col("ring")[0]["y"] + F.col("ring")[2]["y"]) / 2
    half = F.when(F.col("fid") % 100 == 0, 100.0).otherwise(20.0)
    hole = F.array(*(F.struct((cx + i * half).alias("x"), (cy + j * half).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    return p.select("fid", F.lit(0).alias("ring_no"), "ring").union(p.where("fid % 50 = 0").select("fid", F.lit(1), hole))


@query
def pg_area_rings(spark, d):
    got = rings.areas(X.nested_mosaic(spark, d))
    return got.select("fid", r("area").alias("area"), "members", "holes", r("perimeter").alias("perimeter"))


@query
def pg_centroids(spark, d):
    return rings.centroids(X.nested_mosaic(spark, d)).select("fid", r("x", 4).alias("x"), r("y", 4).alias("y"))


@query
def pg_adjacency_rings(spark, d):
    return polygons.adjacency(X.nested_mosaic(spark, d)).select("fid1", "fid2", r("shared").alias("shared"))


@query
def pg_dissolve_rings(spark, d):
    """Blocks of four polygons with their holes and without the islands: an island's place stays a hole."""
    p = X.nested_mosaic(spark, d).where("fid < 10000000")
    got = rings.areas(polygons.dissolve(p, p.select(F.col("fid").alias("member"), F.floor(F.col("fid") / 4).alias("group")).distinct()))
    return got.select("fid", r("area").alias("area"), "members", "holes", r("perimeter").alias("perimeter"))


@query
def src_members(spark, d):
    """The nested mosaic as text of several members, and back."""
    from terrane.sources import layers

    text = layers.to_wkt(rings.to_members(X.nested_mosaic(spark, d)), "members", "POLYGON")
    back = rings.from_members(layers.from_wkt(text).select("fid", "members"))
    return back.select("fid", F.col("member").cast("bigint").alias("member"), F.col("ring_no").cast("bigint").alias("ring_no"), F.size("ring").cast("bigint").alias("vertices"), r(S.ring_area(F.col("ring"))).alias("area"))


@query
def pg_small_holes(spark, d):
    return polygons.without_small_holes(_with_holes(spark, d), 10_000.0).select("fid", F.col("ring_no").cast("bigint").alias("ring_no"), r(S.ring_area(F.col("ring"))).alias("area"))


@query
def pg_triangulate(spark, d):
    return polygons.triangulate(X.polygons(spark, d), ["BUILDING"], "lith", 1e9).select("fid", "rec_type", "tri_id", r("area").alias("area"))


@query
def pg_triangle_areas(spark, d):
    return polygons.triangulate(X.polygons(spark, d), ["BUILDING"], "lith", 1e9).groupBy("fid").agg(r(F.sum("area"), 3).alias("area"))


@query
def pg_triangulate_holes(spark, d):
    """Dykes whose middle is a hole lose the triangles that it takes more than a tenth of."""
    p = X.polygons(spark, d)
    cx, cy = ((F.col("ring")[0][c] + F.col("ring")[2][c]) / 2 for c in ("x", "y"))
    hole = F.array(*(F.struct((cx + i * 800).alias("x"), (cy + j * 800).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    holes = p.where("fid % 50 = 0").select("fid", hole.alias("ring"))
    got = polygons.triangulate(p, ["BUILDING"], "lith", 1e9, holes)
    return got.groupBy("fid").agg(r(F.sum("area"), 3).alias("area"))


@query
def pg_filler(spark, d):
    return X.polygons(spark, d).select("fid", polygons.filler("int").cast("bigint").alias("whole"), r(polygons.filler("float"), 3).alias("small"), polygons.filler("text", 7).alias("text"))


def _layers(found, names):
    """One row for each layer of a series: its features, all members, area, and whether every feature's area is that of its rings."""
    out = None
    for key, layer in found.items():
        own = rings.areas(layer).withColumnRenamed("area", "drawn").join(layer.select("fid", "area", F.size("inherit").alias("n")).distinct(), "fid")
        one = own.agg(F.count("*").alias("features"), F.sum("n").alias("originals"), r(F.sum("area"), 3).alias("area"), F.bool_and(F.abs(F.col("drawn") - F.col("area")) < 1e-3).alias("drawn")).select(F.lit(key).alias(names), "features", "originals", "area", "drawn")
        out = one if out is None else out.union(one)
    return out


@query
def tp_polygons_chain(spark, d):
    p = X.nested_mosaic(spark, d)
    got = _layers(polygons.multi_scale_polygons(p, 0.8, 0.1, ["lith", "strat1", "strat2"]), "ratio")
    # cleaning takes all under the threshold, so a step may go below its count
    most = F.round(F.lit(p.select("fid").distinct().count()) * F.pow("ratio", F.lit(1.5)))
    return got.select("ratio", "originals", "area", "drawn", (F.col("features") <= most + 1).alias("few"))


@query
def pg_clean_series(spark, d):
    """A cleaned layer for each threshold: nothing is lost, and nothing under the threshold is left."""
    found = polygons.clean_series(X.nested_mosaic(spark, d), [50_000.0, SMALL], STRATA)
    under = {t: layer.where(F.col("area") < t).count() for t, layer in found.items()}
    return _layers(found, "threshold").select("threshold", "originals", "area", "drawn", F.element_at(F.create_map(*(F.lit(v) for pair in under.items() for v in pair)), F.col("threshold")).alias("under"))


@query
def pg_lineage_fields(spark, d):
    """Lineage of blocks of forty polygons cut into fields of a narrow sink."""
    text = F.concat_ws(",", F.array_sort(F.collect_list(F.col("fid"))))
    blocks = X.polygons(spark, d).groupBy(F.floor(F.col("fid") / 40).alias("fid")).agg(text.alias("t"))
    return blocks.select("fid", *polygons.overflow(F.col("t"), width=100))


@query
def pg_thresholds(spark, d):
    """Polygons under each area threshold of the series, the map's scale being a tenth."""
    steps = polygons.threshold_series(3.0, 0.5)
    p = polygons.with_area(X.polygons(spark, d))
    return p.select(F.posexplode(F.array(*(F.lit(v) for v in steps))).alias("step", "threshold"), "area").groupBy("step", r("threshold", 3).alias("threshold")).agg(F.count_if(F.col("area") < F.col("threshold")).alias("under"))


# ---------------------------------------------------------------- sources
@query
def src_wkt(spark, d):
    """Polygons as text and back."""
    from terrane.sources import layers

    text = layers.to_wkt(X.in_degrees(X.polygons(spark, d)).select("fid", "ring"), "ring", "POLYGON")
    return layers.from_wkt(text).select("fid", F.size("parts").alias("parts"), F.size("geom").alias("vertices"), r(F.aggregate("geom", F.lit(0.0), lambda s, v: s + v["x"] + v["y"]), 9).alias("total"))


@query
def cl_trends(spark, d):
    odd = X.lines(spark, d).select("fid", F.when(F.col("fid") % 3 == 0, "none").otherwise((F.col("fid") % 360).cast("string")).alias("trend"))
    return clusters.trends(odd, "trend").select("fid", "trend")


@query
def tp_points_chain(spark, d):
    steps = selection.multi_scale_points(X.points(spark, d), 0.5, 0.25)
    out = None
    for ratio, rows in steps.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(ratio).alias("ratio"), "n")
        out = one if out is None else out.union(one)
    return out


@query
def tp_prepared_offset(spark, d):
    """Lines without the column that the method needs get it first."""
    rows = X.lines(spark, d).select("fid", "geom")
    ready = selection.prepare_lines(rows, "strat_offset", polygons=X.polygons(spark, d), columns=STRATA)
    return selection.select_lines(ready, 0.2, "strat_offset", "max_offset").select("fid", "max_offset")


@query
def tp_prepared_graph(spark, d):
    """Lines of the network with the edge type that selection by graph needs."""
    return selection.prepare_lines(X.cells_network(spark, d), "graph").select("fid", "edge_type")


# ---------------------------------------------------------------- topology
@query
def tz_invalid(spark, d):
    """Every twentieth ring with two corners exchanged crosses itself, every twentieth is cut open."""
    p = X.polygons(spark, d)
    g = F.col("ring")
    bad = F.when(F.col("fid") % 20 == 3, F.array(g[0], g[2], g[1], g[3], g[0])).when(F.col("fid") % 20 == 7, F.slice(g, 1, 4)).when(F.col("fid") % 20 == 9, F.slice(g, 1, 3)).otherwise(g)
    return topology.invalid_rings(p.withColumn("ring", bad))


@query
def tz_grid_snap(spark, d):
    odd = X.lines(spark, d).withColumn("geom", F.transform("geom", lambda p: F.struct((p["x"] / 7).alias("x"), (p["y"] / 7).alias("y"))))
    got = topology.snap_to_grid(odd, 2, "geom")
    return got.select("fid", "changed", r(F.aggregate("geom", F.lit(0.0), lambda s, p: s + p["x"] + p["y"]), 2).alias("total"))


@query
def tz_midpoint_snap(spark, d):
    f = X.lines(spark, d).withColumn("geom", F.array(F.struct(F.round(F.col("geom")[0]["x"], -2).alias("x"), F.round(F.col("geom")[0]["y"], -2).alias("y")), F.col("geom")[1]))
    return topology.midpoint_snaps(f, X.polygons(spark, d), 300.0)[0].select("x", "y", r("mx", 4).alias("mx"), r("my", 4).alias("my"))


@query
def tz_junctions(spark, d):
    return topology.junctions(X.polygons(spark, d))


@query
def tz_shared_segments(spark, d):
    return topology.shared_segments(X.polygons(spark, d)).select("seg_key.*", "polygons", r("length").alias("length"))


@query
def tz_shared_segments_degrees(spark, d):
    return topology.shared_segments(X.in_degrees(X.polygons(spark, d))).select("seg_key.*", "polygons", r("length", 9).alias("length"))


@query
def tz_exterior_vertices_degrees(spark, d):
    return topology.exterior_vertices(X.in_degrees(X.polygons(spark, d)), 1e-6)


@query
def tz_significance(spark, d):
    return topology.significance(X.polygons(spark, d), X.cells_network(spark, d))


@query
def tz_exterior_vertices(spark, d):
    return topology.exterior_vertices(X.polygons(spark, d))


@query
def tz_box_vertices(spark, d):
    return topology.box_vertices(X.polygons(spark, d))


@query
def tz_contacts(spark, d):
    return topology.contacts(X.polygons(spark, d), "strat1").select("code_a", "code_b", "f1", "f2", r("length").alias("length"), "vertices", "x", "y")


@query
def tz_contact_health(spark, d):
    before = topology.contacts(X.polygons(spark, d), "strat1")
    after = topology.contacts(X.polygons(spark, d).where("fid % 3 <> 0"), "strat1")
    return topology.contact_health(before, after).select("code_a", "code_b", "health")


@query
def tz_thin_bodies(spark, d):
    return topology.thin_bodies(X.polygons(spark, d), 5.2e6).select("fid", r("area").alias("area"), r("perimeter").alias("perimeter"))


@query
def tz_overlaps(spark, d):
    moved = X.polygons(spark, d).withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] + F.when(F.col("fid") % 10 == 0, 120.0).otherwise(0.0)).alias("x"), p["y"].alias("y"))))
    return topology.overlaps(moved).select("fid1", "fid2", r("overlap", 3).alias("overlap"))


@query
def tz_gaps(spark, d):
    return topology.gap_rings(X.polygons(spark, d).where("fid % 50 <> 25")).select("filler", r("area").alias("area"))


@query
def tz_gap_fill(spark, d):
    holed = X.polygons(spark, d).where("fid % 50 <> 25")
    return rings.areas(topology.fill_gaps(holed)).select("fid", r("area").alias("area"))


@query
def tz_gap_fill_rings(spark, d):
    """The nested mosaic without its islands and some polygons: both kinds of gap are filled, other rings stay."""
    holed = X.nested_mosaic(spark, d).where("fid < 10000000 and fid % 50 <> 25")
    return rings.areas(topology.fill_gaps(holed)).select("fid", r("area").alias("area"), "holes")


@query
def tz_overlap_fix(spark, d):
    """A square for every polygon, wider than its step, so that it overlaps those beside, above and below it."""
    i, j = F.col("fid") % 40 * 2500.0, F.floor(F.col("fid") / 40.0) * 2500.0
    squares = X.polygons(spark, d).select("fid", F.array(*(F.struct((i + x).alias("x"), (j + y).alias("y")) for x, y in ((0.0, 0.0), (3000.0, 0.0), (3000.0, 3000.0), (0.0, 3000.0), (0.0, 0.0)))).alias("ring"))
    return rings.areas(topology.fix_overlaps(squares)).select("fid", r("area", 3).alias("area"), "members", "holes")


@query
def tz_boundary_pins(spark, d):
    return topology.boundary_pins(X.polygons(spark, d))


@query
def schema_candidates(spark, d):
    return topology.unit_candidates(X.polygons(spark, d).select("fid", "strat1", "strat2", "lith")).select("column", "type", F.concat_ws(",", "samples").alias("samples"), "candidate")


# ---------------------------------------------------------------- simplification
def _total(geom: str) -> list[Column]:
    return [F.size(geom).cast("bigint").alias("vertices"), r(F.aggregate(geom, F.lit(0.0), lambda s, p: s + p["x"] + p["y"]), 3).alias("total")]


@query
def sv_decimate(spark, d):
    return simplify.simplify(X.lines(spark, d), "decimation", 2.0).select("fid", *_total("geom"))


@query
def sv_bend(spark, d):
    return simplify.simplify(X.lines(spark, d), "bend", 0.05).select("fid", *_total("geom"))


@query
def sv_dp(spark, d):
    return simplify.simplify(X.lines(spark, d), "douglas_peucker", 100.0).select("fid", *_total("geom"))


@query
def sv_vw(spark, d):
    return simplify.simplify(X.lines(spark, d), "visvalingam", 20_000.0).select("fid", *_total("geom"))


def _dense(spark, d):
    return _denser(X.polygons(spark, d))


def _denser(df):
    """A mosaic with two more vertices on each side, placed by the side alone."""
    def points(e: Column) -> Column:
        turned = (e["x0"] > e["x1"]) | ((e["x0"] == e["x1"]) & (e["y0"] > e["y1"]))
        k = F.pmod((e["x0"] + e["x1"]) * 7 + (e["y0"] + e["y1"]) * 3, F.lit(11.0)) - 5
        sign = F.when(turned, -1.0).otherwise(1.0)
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        at = lambda t, q: F.struct((e["x0"] + dx * t - dy * sign * q).alias("x"), (e["y0"] + dy * t + dx * sign * q).alias("y"))
        return F.array(F.struct(e["x0"].alias("x"), e["y0"].alias("y")), at(0.25, k / 200 * F.when(turned, 0.5).otherwise(1.0)), at(0.75, k / 200 * F.when(turned, 1.0).otherwise(0.5)))

    ring = F.concat(F.flatten(F.transform(S.steps(F.col("ring")), points)), F.slice("ring", 1, 1))
    return df.withColumn("ring", ring)


@query
def sv_mvw(spark, d):
    return simplify.simplify_mosaic(_dense(spark, d), 20_000.0).select("fid", *_total("ring"))


@query
def sv_soft_boundary(spark, d):
    dense = _dense(spark, d)
    return simplify.simplify_mosaic(dense, 20_000.0, soft=topology.soft_boundary(dense)).select("fid", *_total("ring"))


@query
def sv_faults(spark, d):
    return simplify.simplify_faults(X.cells_network(spark, d), 1000.0, X.polygons(spark, d)).select("fid", *_total("geom"))


@query
def sv_map(spark, d):
    got = simplify.simplify_map(_dense(spark, d), 20_000.0, "strat1", X.cells_network(spark, d))
    return got["polygons"].select("fid", *_total("ring"))


@query
def sv_map_sound(spark, d):
    """The nested mosaic with dense sides, simplified: no feature, member or hole is lost, the area inside the outer boundary stays, and no two sides cross or coincide."""
    done = simplify.simplify_map(_denser(X.nested_mosaic(spark, d)), 20_000.0, "strat1")
    one = rings.areas(done["polygons"]).agg(F.count("*").alias("features"), F.sum("members").alias("members"), F.sum("holes").alias("holes"), r(F.sum("area"), 0).alias("area"))
    apart = topology.crossings(rings.ring_key(done["polygons"])).where("fid1 = fid2").agg(F.count("*").alias("own_crossings"))
    both = topology.crossings(_sides(done["polygons"]), "side").agg(F.count("*").alias("crossings"))
    return one.crossJoin(apart).crossJoin(both).crossJoin(done["invalid"].agg(F.count("*").alias("invalid")))  # one row each


def _sides(rings_):
    """Each side of a noded mosaic once, as a line of its own."""
    once = spatial.segments(rings_).groupBy("seg_key").agg(F.count("*").alias("n"))
    end = lambda a: F.struct(F.col(f"seg_key.{a}x").alias("x"), F.col(f"seg_key.{a}y").alias("y"))
    return once.select(F.xxhash64("seg_key").alias("fid"), F.array(end("a"), end("b")).alias("side"))


@query
def sv_matrix(spark, d):
    return simplify.method_matrix(X.lines(spark, d), ["decimation", "bend"], [2.0, 0.1]).select("method", "tolerance", "features", F.col("before").cast("bigint").alias("before"), F.col("after").cast("bigint").alias("after"))
