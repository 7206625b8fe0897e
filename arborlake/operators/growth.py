"""Radius and geometry passes over finished trees, and expansion of terminals into branching tables."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.functions import domains, draws, geometry as g
from arborlake.functions.vectors import cross, norm, perpendicular, sub, triple
from arborlake.operators import trees
from arborlake.plans.cut import cut, cut_counted
from arborlake.plans.hierarchy import Fold, path_fold
from arborlake.plans.runs import by_level, single_runs


def scaled_prefix(segs: DataFrame, n_fixed: int, root_diameter_um: Column) -> DataFrame:
    """(tree, id, target_mm): radii of the first rows of every tree, scaled so that the root has a given diameter."""
    root = segs.where(~(F.coalesce("parent_id", F.lit(-1)) > 0)).select("tree", F.col("radius_mm").alias("_r"), root_diameter_um.alias("_goal"))
    fixed = segs.where(F.col("id") <= n_fixed)
    scaled = fixed.join(root, "tree")
    return scaled.select("tree", "id", (F.col("radius_mm") * (F.col("_goal") / 2000 / F.col("_r"))).alias("target_mm"))


def blend_prefix(segs: DataFrame, targets: DataFrame, alpha: float) -> DataFrame:
    """Radius moved towards its target where there is one."""
    joined = segs.join(targets, ["tree", "id"], "left")
    mixed = (1 - alpha) * F.col("radius_mm") + alpha * F.col("target_mm")
    return joined.withColumn("radius_mm", F.coalesce(mixed, F.col("radius_mm"))).drop("target_mm")


def ranked_siblings(segs: DataFrame, by: Column, tie: str) -> DataFrame:
    """Rank of every child among its siblings, 1 for the largest; a parent has at most three children."""
    w = Window.partitionBy("tree", "parent_id").orderBy(by, tie)
    return segs.where(F.col("parent_id") > 0).withColumn("rank", F.row_number().over(w))


def terminal_flows(segs: DataFrame, root_pa: float, terminal_pa: float) -> DataFrame:
    """(tree, id, flow_m3_s): the tree's whole flow shared among its terminals by the volume each serves, summed upwards."""
    from arborlake.operators.spatial import nearest_other_terminal

    typed = cut(trees.with_children(segs), "typed")
    weights = nearest_other_terminal(typed.where("is_terminal"))
    root = trees.subtree_resistance(segs).join(
        segs.where(~(F.coalesce("parent_id", F.lit(-1)) > 0)).select("tree", "id"), ["tree", "id"])
    total = root.select("tree", ((root_pa - terminal_pa) / F.col("r_sub")).alias("_total"))
    own = weights.join(total, "tree").select("tree", "id", (F.col("weight") * F.col("_total")).alias("_own"))
    ready = typed.join(own, ["tree", "id"], "left").withColumn("_own", F.coalesce("_own", F.lit(0.0)))
    return trees.subtree_sums(ready, {"flow_m3_s": F.col("_own")})


def radii_from_flow(segs: DataFrame, gamma: float) -> DataFrame:
    """Leaf radius = flow^(1/g), summed upwards with the power law."""
    leaf = trees.with_children(segs).withColumn(
        "radius_mm", F.when(F.col("is_terminal"), F.pow("flow_m3_s", 1 / gamma)).otherwise(F.col("radius_mm")))
    return trees.power_radii(leaf, gamma)


def redrawn_radii(segs: DataFrame, gamma: float, seed: int, alpha: float = 2.5, beta: float = 0.8, floor_mm: float = 0.004) -> DataFrame:
    """(tree, id, radius_mm) after a top-down redraw of daughter ratios, larger radius to the larger subtree.

    A junction maps the radius above to max(factor * radius, floor), and such maps
    compose to the same form, so the whole way down is one path fold.
    """
    sizes = trees.subtree_sums(segs, {"_size": F.lit(1.0)})
    typed = cut(trees.with_children(segs).join(sizes, ["tree", "id"]), "sized")
    kids = typed.where(F.col("parent_id") > 0)
    w = Window.partitionBy("tree", "parent_id").orderBy(F.desc("_size"), "id")
    ranked = kids.withColumn("_rank", F.row_number().over(w)).withColumn(
        "_sibs", F.count("*").over(Window.partitionBy("tree", "parent_id")))
    junction = [F.col("tree"), F.col("parent_id")]
    a1 = draws.beta(draws.uniform(junction, seed, 1), alpha, beta)
    a2 = draws.beta(draws.uniform(junction, seed, 2), alpha, beta)
    ranked = ranked.withColumns({"_a1": a1, "_a2": a2})
    one = F.lit(1.0)
    large, small = g.split_radii(one, F.col("_a1"), gamma)
    first, second = g.split_radii(large, F.col("_a2"), gamma)
    three = F.array_sort(F.array(first, second, small))
    factor = (
        F.when(F.col("_sibs") == 2, F.when(F.col("_rank") == 1, large).otherwise(small))
        .when(F.col("_sibs") == 3, F.get(three, 3 - F.col("_rank")))
    )
    # A single child, like the root, keeps its own radius whatever lies above.
    drawn = ranked.withColumn("_factor", factor).select("tree", "id", "_factor")
    maps = cut(typed.join(drawn, ["tree", "id"], "left").withColumns({
        "_a": F.coalesce("_factor", F.lit(0.0)),
        "_b": F.when(F.col("_factor").isNull(), F.col("radius_mm")).otherwise(F.lit(floor_mm)),
        "_ptr": trees.parent_or_null()}), "maps")
    # low after up: max(a max(A x, B), b) = max(a A x, max(a B, b))
    folds = [
        Fold("_a", F.col("_a"), lambda up, low: low("_a") * up("_a")),
        Fold("_b", F.col("_b"), lambda up, low: F.greatest(low("_a") * up("_b"), low("_b"))),
    ]
    # The root's map has factor 0, so the constant is the radius.
    down = path_fold(maps, ["tree"], "id", "_ptr", folds).select("tree", "id", F.col("_b").alias("_r"))
    redrawn = cut(segs.join(down, ["tree", "id"]).withColumn("radius_mm", F.col("_r")).drop("_r"), "redrawn")
    risen = trees.power_radii(redrawn, gamma)
    return risen.withColumn("radius_mm", F.greatest("radius_mm", F.lit(floor_mm)))


def valid_child_radii(segs: DataFrame, params: DataFrame, rates: DataFrame, gamma: float) -> DataFrame:
    """(tree, id, radius_mm) with child orders that the reference never pairs moved to the nearest order it does.

    ``segs`` carries artery and strahler_order.  Only two-way junctions are looked
    at; trees in which something moved get their inner radii from the power law again.
    """
    typed = trees.with_children(segs)
    edges = trees.parent_child(typed, ["strahler_order", "n_children", "artery"], ["strahler_order"])
    edges = edges.where("p_n_children = 2 AND p_strahler_order >= 1 AND c_strahler_order >= 0")
    known = rates.where("rate > 0").groupBy("artery", "parent_order").agg(F.collect_set("child_order").alias("_valid"))
    met = edges.join(F.broadcast(known), (F.col("p_artery") == F.col("artery")) & (F.col("p_strahler_order") == F.col("parent_order")))
    own = F.col("c_strahler_order")
    # Nearest valid order, the lower one first.
    near = F.array_min(F.transform("_valid", lambda o: F.struct(F.abs(o - own).alias("d"), o.alias("o"))))["o"]
    moved = met.where(~F.array_contains("_valid", own)).withColumn("ord", near)
    goal = F.broadcast(params.select("artery", "ord", (F.col("d_mean") / 2000).alias("_new")))
    moved = cut(moved.join(goal, ["artery", "ord"]).select("tree", F.col("child_id").alias("id"), "_new"), "moved")
    changed = segs.join(moved, ["tree", "id"], "left").withColumn("radius_mm", F.coalesce("_new", "radius_mm"))
    touched = moved.select("tree").distinct()
    risen = trees.power_radii(changed.join(touched, "tree", "left_semi").drop("_new"), gamma)
    same = changed.join(touched, "tree", "left_anti").select("tree", "id", "radius_mm")
    return risen.unionByName(same)


def junction_geometry(segs: DataFrame, gamma: float, rho_th: float = g.RHO_TH) -> DataFrame:
    """Segments with daughters turned to the angles of their junction, top down, lengths kept.

    A single child keeps its direction and follows its parent's end, so a run of them is one rigid body that hangs on
    its first row: only first rows are placed level by level, from the end and the last direction of the run above.
    """
    slotted = trees.with_child_slot(segs.drop("child_slot"))
    w = Window.partitionBy("tree", "parent_id")
    sibs = slotted.withColumns({
        "_n": F.count("*").over(w), "_r": F.array_sort(F.collect_list(F.struct("child_slot", "radius_mm")).over(w))["radius_mm"]})
    r = [F.get("_r", F.lit(i)) for i in range(3)]
    first_large = r[0] >= r[1]
    big, little = g.junction_angles(g.radius_ratio(F.least(r[0], r[1]), F.greatest(r[0], r[1])), gamma, rho_th)
    is_large = F.when(F.col("child_slot") == 1, first_large).otherwise(~first_large)
    three = g.three_way_angles(r)
    slot3 = F.when(F.col("child_slot") == 1, three[0]).when(F.col("child_slot") == 2, three[1]).otherwise(three[2])
    p, d = triple("px", "py", "pz"), triple("dx", "dy", "dz")
    held = ["px", "py", "pz", "_vx", "_vy", "_vz", "_angle", "_turn"]
    turned = sibs.withColumns({
        "_angle": F.when(F.col("_n") == 2, F.when(is_large, big).otherwise(little)).when(F.col("_n") == 3, slot3),
        "_turn": F.when(F.col("_n") == 2, F.when(is_large, 0.0).otherwise(math.pi)).otherwise((F.col("child_slot") - 1) * (2 * math.pi / 3)),
        **{f"_v{c}": v for c, v in zip("xyz", sub(d, p))}})
    rows, levels = single_runs(turned, held, longest=1 << 62, sums={f"_o{c}": F.col(f"_v{c}") for c in "xyz"})
    last = rows.groupBy("tree", "run").agg(
        F.max_by(F.struct(*[F.when(F.col("pos") > 1, F.col(f"_v{c}")).alias(c) for c in "xyz"]), "pos").alias("_last"), F.max_by(F.struct("_ox", "_oy", "_oz"), "pos").alias("_off"))
    table = by_level(rows.where("pos = 1").select("tree", "run", "up_run", "level", *held).join(last, ["tree", "run"]))
    own = triple("_vx", "_vy", "_vz")
    out = above = None
    for level in range(levels):
        met = table.where(F.col("level") == level)
        if above is None:
            met, start, way = met, p, own
        else:
            met = met.join(above, ["tree", "up_run"])
            met = met.withColumns({"_al": norm(triple("_ax", "_ay", "_az")), "_len": norm(own)})
            met = met.withColumns({f"_u{c}": F.col(f"_a{c}") / F.col("_al") for c in "xyz"})
            u = triple("_ux", "_uy", "_uz")
            met = met.withColumns({f"_p{c}": v for c, v in zip("xyz", perpendicular(u))})
            perp = triple("_px", "_py", "_pz")
            ca, sa, ct, st = F.cos("_angle"), F.sin("_angle"), F.cos("_turn"), F.sin("_turn")
            still = F.col("_angle").isNull() | ~(F.col("_al") > 0)
            way = tuple(F.when(still, o).otherwise((a * ca + (b * ct + c * st) * sa) * F.col("_len")) for o, a, b, c in zip(own, u, perp, cross(u, perp)))
            start = triple("_ex", "_ey", "_ez")
        done = cut(met.select("tree", "run", "_last", "_off", *[s.alias(f"_s{c}") for c, s in zip("xyz", start)], *[v.alias(f"_w{c}") for c, v in zip("xyz", way)]), "placed")
        above = done.select("tree", F.col("run").alias("up_run"), *[F.coalesce(F.col(f"_last.{c}"), F.col(f"_w{c}")).alias(f"_a{c}") for c in "xyz"],
                            *[(F.col(f"_s{c}") + F.col(f"_w{c}") + F.col(f"_off._o{c}")).alias(f"_e{c}") for c in "xyz"])
        part = done.drop("_last", "_off")
        out = part if out is None else out.unionByName(part)
    rest = segs.drop("px", "py", "pz", "dx", "dy", "dz", "length_mm")
    if out is None:
        return segs.limit(0)
    inner = F.col("pos") > 1
    ends = rows.join(out, ["tree", "run"]).select(
        "tree", "id", *[F.when(inner, F.col(f"_s{c}") + F.col(f"_w{c}") + F.col(f"_o{c}") - F.col(f"_v{c}")).otherwise(F.col(f"_s{c}")).alias(f"p{c}") for c in "xyz"],
        *[(F.col(f"_s{c}") + F.col(f"_w{c}") + F.col(f"_o{c}")).alias(f"d{c}") for c in "xyz"])
    return rest.join(ends, ["tree", "id"]).withColumn("length_mm", g.segment_length(p, d))


def pulled_inside(segs: DataFrame, domain: domains.Domain, passes: int | None = None) -> DataFrame:
    """Segments whose ends lie in the domain: outside ends are projected and children follow their parent.

    In a shell an outside end is first turned along the wall.  Stops when a pass moves nothing.
    """
    shell = isinstance(domain, domains.EllipsoidShell)
    p, d = triple("px", "py", "pz"), triple("dx", "dy", "dz")
    state = segs
    for _ in range(passes or (5 if shell else 3)):
        out_p, out_d = ~domain.inside(p), ~domain.inside(d)
        moved = state.withColumns({"_op": out_p, "_od": out_d})
        moved = moved.withColumns({f"p{c}": F.when(F.col("_op"), v).otherwise(F.col(f"p{c}")) for c, v in zip("xyz", domain.project(p))})
        goal = d
        if shell:
            span = sub(d, p)
            moved = moved.withColumns({**{f"_v{c}": v for c, v in zip("xyz", span)}, "_l": norm(span)})
            unit = tuple(F.col(f"_v{c}") / F.col("_l") for c in "xyz")
            along = tuple(a + t * F.col("_l") for a, t in zip(p, domain.tangent(p, unit)))
            moved = moved.withColumns({f"_t{c}": F.when(F.col("_l") > 1e-15, v).otherwise(F.col(f"d{c}")) for c, v in zip("xyz", along)})
            goal = triple("_tx", "_ty", "_tz")
        moved = moved.withColumns({f"d{c}": F.when(F.col("_od"), v).otherwise(F.col(f"d{c}")) for c, v in zip("xyz", domain.project(goal))})
        moved = moved.drop("_vx", "_vy", "_vz", "_l", "_tx", "_ty", "_tz")
        moved, tally = cut_counted(moved, "pulled", n=F.count_if(F.col("_op") | F.col("_od")))
        ends = moved.where("_od").select("tree", F.col("id").alias("parent_id"), *[F.col(f"d{c}").alias(f"_n{c}") for c in "xyz"])
        state = moved.drop("_op", "_od").join(ends, ["tree", "parent_id"], "left")
        state = state.withColumns({f"p{c}": F.coalesce(f"_n{c}", f"p{c}") for c in "xyz"}).drop("_nx", "_ny", "_nz")
        if tally["n"] == 0:
            break
    return state.withColumn("length_mm", g.segment_length(p, d))
