"""From building outlines to edges, their overlaps, and groups of buildings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from plumbline.functions import geo
from plumbline.operators.graph import connected_components
from plumbline.operators.keys import numbered, shuffled
from plumbline.operators.spatial import box_join
from plumbline.plans.scratch import Scratch

EDGE_ORDER = ["cleabs", "idx_polygon", "idx_ring", "idx_edge"]


def polygons(buildings: DataFrame) -> DataFrame:
    return buildings.select("cleabs", F.posexplode("geometry").alias("idx_polygon", "polygon"))


def rings(polys: DataFrame) -> DataFrame:
    """Ring 0 is the exterior."""
    return polys.select("cleabs", "idx_polygon", F.posexplode("polygon").alias("idx_ring", "ring"))


def edges(all_rings: DataFrame) -> DataFrame:
    out = all_rings.select("cleabs", "idx_polygon", "idx_ring", F.posexplode(geo.ring_edges(F.col("ring"))).alias("idx_edge", "e"))
    ends = [F.col(f"e.{a}.{c}").alias(f"{n}_{c}") for a, n in (("a", "start"), ("b", "end")) for c in "xyz"]
    return out.select("cleabs", "idx_polygon", "idx_ring", "idx_edge", *ends)


def keyed_edges(spark: SparkSession, buildings: DataFrame) -> DataFrame:
    """All edges with edge_key, numbered from 1 in outline order."""
    return numbered(spark, edges(rings(polygons(buildings))), EDGE_ORDER, "edge_key")


def edge_overlaps(keyed: DataFrame, cell: float = 8.0) -> DataFrame:
    """Pairs of edges (a before b) that share a piece of one line, and its length; touching ends do not count.

    Level and upright edges meet only others of their own line, and slanted ones only slanted ones: no two of different
    kinds share a piece.
    """
    level, upright = F.col("start_y") == F.col("end_y"), F.col("start_x") == F.col("end_x")
    line = F.xxhash64(F.when(level, 0).when(upright, 1).otherwise(2), F.when(level, F.col("start_y")).when(upright, F.col("start_x")).otherwise(0.0) + F.lit(0.0))
    ends = ("start_x", "start_y", "end_x", "end_y")

    def side(p: str) -> DataFrame:
        box = {f"{p}_x0": F.least("start_x", "end_x"), f"{p}_y0": F.least("start_y", "end_y"), f"{p}_x1": F.greatest("start_x", "end_x"), f"{p}_y1": F.greatest("start_y", "end_y")}
        return keyed.select(F.col("edge_key").alias(f"edge_key_{p}"), F.col("cleabs").alias(f"cleabs_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in ends], *[v.alias(k) for k, v in box.items()], line.alias(f"{p}_line"))

    shared = geo.collinear_overlap(*[F.col(f"{p}_{c}") for p in "ab" for c in ends])
    box = lambda p: (f"{p}_x0", f"{p}_y0", f"{p}_x1", f"{p}_y1")
    met = box_join(side("a"), side("b"), cell, box("a"), box("b"), shared > 0, same=("a_line", "b_line"))
    # Most that meet are an edge and itself or touch only, which is told before the longer formula.
    longer = lambda c: F.least(f"a_{c}1", f"b_{c}1") > F.greatest(f"a_{c}0", f"b_{c}0")
    met = met.where(F.col("edge_key_a") < F.col("edge_key_b")).where(longer("x") | longer("y"))
    return met.select("edge_key_a", "edge_key_b", "cleabs_a", "cleabs_b", shared.alias("length"))


def building_links(overlaps: DataFrame) -> DataFrame:
    return overlaps.select(F.col("cleabs_a").alias("src"), F.col("cleabs_b").alias("dst")).where("src < dst").distinct()


#: Ways of several links that a building keeps, and those of them that lead farthest.
WAYS, FAR = 4, 2
#: Buildings whose roots a task has at hand at once, and passes before ways are used.
WINDOW, PASSES = 200_000, 4


def _handed_down(window: int, schema: pa.Schema):
    """Rows (dst, via, offer), sorted by dst, to each dst's root and the links from buildings whose roots are not at hand.

    A root is the least offer to its building, links offering the root of theirs. As links lead to larger ids, the root that
    a link offers is known when it comes, if its building is in the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, best = {}, None, None
        for batch in batches:
            out = []
            for dst, via, offer in zip(*[batch.column(c).to_pylist() for c in ("dst", "via", "offer")], strict=True):
                if dst != at:
                    if at is not None:
                        if len(known) >= window:
                            known.clear()
                        known[at] = best
                        out.append((at, best, False))
                    at = best = dst
                if via != dst:
                    if via in known:
                        offer = known[via]
                    else:
                        out.append((dst, via, True))
                best = min(best, offer)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), schema.types, strict=True)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((at, best, False), schema.types, strict=True)], schema=schema)

    return run


def reachable_roots(spark: SparkSession, buildings: DataFrame, links: DataFrame, window: int = WINDOW, passes: int = PASSES) -> DataFrame:
    """(cleabs, root_id): the least building from which a chain of src -> dst links leads here.

    These are not connected components: of a -> c and b -> c, b stays alone. Links are dealt and sorted by the building that
    they lead to, and a task hands roots down all chains among those that it has in its window. Links that come from elsewhere
    hand theirs on between passes, until none has a new one. Chains through many windows are left to ``_by_ways`` after a few passes.
    """
    scratch = Scratch(spark, "reach")
    links = scratch.keep(links.where("src <> dst").select("src", "dst").distinct(), "links")
    rows = links.select("dst", F.col("src").alias("via"), F.col("src").alias("offer"))
    kind = links.schema["dst"].dataType
    schema = StructType([StructField("cleabs", kind), StructField("other", kind), StructField("open", BooleanType())])
    handed = _handed_down(window, to_arrow_schema(schema))
    roots = None
    for k in range(passes):
        told = rows if roots is None else rows.unionByName(roots.select(F.col("cleabs").alias("dst"), F.col("cleabs").alias("via"), F.col("root_id").alias("offer")))
        done = scratch.keep(told.repartitionByRange("dst").sortWithinPartitions("dst").mapInArrow(handed, schema), f"pass-{k}")
        roots = done.where("not open").select("cleabs", F.col("other").alias("root_id"))
        come = done.where("open").select("cleabs", F.col("other").alias("src")).join(shuffled(roots.select(F.col("cleabs").alias("src"), F.col("root_id").alias("offer"))), "src")
        news = come.groupBy("cleabs").agg(F.min("offer").alias("offer")).join(shuffled(roots), "cleabs").where("offer < root_id").select("cleabs", "offer")
        news = scratch.keep(news, f"news-{k}")
        if news.isEmpty():
            break
        roots = roots.join(shuffled(news), "cleabs", "left").select("cleabs", F.least("root_id", "offer").alias("root_id"))
    else:
        roots = _by_ways(links, roots, scratch)
    found = roots.select("cleabs", F.col("root_id").alias("found"))
    return buildings.select("cleabs").join(shuffled(found), "cleabs", "left").select("cleabs", F.coalesce("found", "cleabs").alias("root_id"))


def _by_ways(links: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """``roots`` (of all buildings that links lead to, no link without its src's offer) when no link hands on a new one.

    In each round a building takes the least root of those before it that have a new one, and of a few buildings farther up, to
    which it keeps ways. Ways are put end to end in each round, so they double in length, and roots come down a chain in
    logarithmically many rounds, whatever joins it on the way. Ways only hasten what links do anyway: roots only fall.
    """
    roots = scratch.keep(roots.withColumn("new", F.lit(True)), "roots-0")
    links = scratch.keep(links.join(shuffled(roots.select(F.col("cleabs").alias("src"))), "src", "left_semi"), "inner-links")

    def chosen(ways: DataFrame, k: int) -> DataFrame:
        """The farthest ways of each building, and some of the others, not the same ones each round."""
        ways = ways.groupBy("dst", "via").agg(F.max("hops").alias("hops"))
        far = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("hops"), F.xxhash64("via")))
        other = F.row_number().over(Window.partitionBy("dst").orderBy(F.xxhash64("via", F.lit(k))))
        ranked = ways.select("*", far.alias("far"), other.alias("other"))
        return ranked.where((F.col("far") <= FAR) | (F.col("other") <= WAYS - FAR)).select("dst", "via", "hops")

    ways = scratch.keep(chosen(links.select("dst", F.col("src").alias("via"), F.lit(1).alias("hops")), 0), "ways-0")
    k = 0
    while True:
        k += 1
        news = roots.where("new").select(F.col("cleabs").alias("src"), F.col("root_id").alias("offer"))
        along = links.join(shuffled(news), "src").select("dst", "offer")
        far = ways.join(shuffled(roots.select(F.col("cleabs").alias("via"), F.col("root_id").alias("offer"))), "via").select("dst", "offer")
        offers = along.unionByName(far).groupBy(F.col("dst").alias("cleabs")).agg(F.min("offer").alias("offer"))
        now = roots.join(shuffled(offers), "cleabs", "left")
        roots = scratch.keep(now.select("cleabs", F.least("root_id", "offer").alias("root_id"), F.coalesce(F.col("offer") < F.col("root_id"), F.lit(False)).alias("new")), f"roots-{k}")
        if k > 1:
            scratch.remove(f"roots-{k - 2}")
            scratch.remove(f"ways-{k - 2}")
        if roots.where("new").isEmpty():
            break
        on = ways.select(F.col("dst").alias("via"), F.col("via").alias("farther"), F.col("hops").alias("more"))
        longer = ways.join(shuffled(on), "via").select("dst", F.col("farther").alias("via"), (F.col("hops") + F.col("more")).alias("hops"))
        ways = scratch.keep(chosen(ways.unionByName(longer), k), f"ways-{k}")
    return roots.select("cleabs", "root_id")


def component_roots(spark: SparkSession, buildings: DataFrame, links: DataFrame) -> DataFrame:
    """(cleabs, root_id) by true connected components."""
    found = connected_components(spark, links, Scratch(spark, "building-groups"))
    joined = buildings.select("cleabs").join(shuffled(found), F.col("cleabs") == F.col("id"), "left")
    return joined.select("cleabs", F.coalesce("component", "cleabs").alias("root_id"))


def building_groups(spark: SparkSession, buildings: DataFrame, roots: DataFrame) -> DataFrame:
    """group_id (in order of the root), cleabs_list (sorted) and the extent of its buildings."""
    of = buildings.select("cleabs", F.explode("geometry").alias("polygon")).select("cleabs", geo.bounds(F.col("polygon")).alias("b"))
    groups = of.join(shuffled(roots), "cleabs").groupBy("root_id").agg(
        F.array_sort(F.collect_set("cleabs")).alias("cleabs_list"), F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax")
    )
    return numbered(spark, groups, ["root_id"], "group_id").drop("root_id")


def crop(groups: DataFrame, keyed: DataFrame, overlaps: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups that the box covers whole, their edges, and the overlaps of which both edges are kept."""
    x0, y0, x1, y1 = box
    kept = groups.where((F.col("xmin") >= x0) & (F.col("ymin") >= y0) & (F.col("xmax") <= x1) & (F.col("ymax") <= y1))
    own = keyed.join(shuffled(kept.select(F.explode("cleabs_list").alias("cleabs"))), "cleabs", "left_semi")
    keys = own.select("edge_key")
    both = overlaps.join(shuffled(keys.withColumnRenamed("edge_key", "edge_key_a")), "edge_key_a", "left_semi").join(shuffled(keys.withColumnRenamed("edge_key", "edge_key_b")), "edge_key_b", "left_semi")
    return kept, own, both


def hilbert_order(df: DataFrame, box: tuple[str, str, str, str], bits: int = 16) -> DataFrame:
    """``df`` with the place of each box's centre on a Hilbert curve over the bounds of all boxes.

    Write with ``repartitionByRange("hilbert").sortWithinPartitions("hilbert")`` to cluster files in space.
    """
    x0, y0, x1, y1 = box
    around = F.broadcast(df.agg(F.min(x0).alias("__low_x"), F.min(y0).alias("__low_y"), F.max(x1).alias("__high_x"), F.max(y1).alias("__high_y")))  # one row
    side = (1 << bits) - 1
    at = lambda a, b, low, high: F.floor(((F.col(a) + F.col(b)) / 2 - F.col(low)) / F.coalesce(F.nullif(F.col(high) - F.col(low), F.lit(0.0)), F.lit(1.0)) * side)
    return df.join(around).withColumn("hilbert", geo.hilbert(at(x0, x1, "__low_x", "__high_x"), at(y0, y1, "__low_y", "__high_y"), bits)).drop("__low_x", "__low_y", "__high_x", "__high_y")


def rebuild(keyed: DataFrame) -> DataFrame:
    """Edges back to (cleabs, geometry); an index that is missing in a ring raises."""
    point = F.struct(F.col("start_x").alias("x"), F.col("start_y").alias("y"), F.col("start_z").alias("z"))
    made = keyed.groupBy("cleabs", "idx_polygon", "idx_ring").agg(F.array_sort(F.collect_list(F.struct("idx_edge", point.alias("p")))).alias("e"))
    dense = F.element_at("e", -1)["idx_edge"] == F.size("e") - 1
    made = made.withColumn("ok", F.assert_true(dense, F.lit("a ring lacks an edge")))
    closed = F.transform("e", lambda x: x["p"])
    made = made.where(F.col("ok").isNull()).select("cleabs", "idx_polygon", "idx_ring", F.concat(closed, F.slice(closed, 1, 1)).alias("ring"))
    polys = made.groupBy("cleabs", "idx_polygon").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx_ring", "ring"))), lambda x: x["ring"]).alias("polygon"))
    return polys.groupBy("cleabs").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx_polygon", "polygon"))), lambda x: x["polygon"]).alias("geometry"))
