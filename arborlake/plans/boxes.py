"""Joins by distance over boxes: k nearest and within range, exact for any density.

Items (points or segments) are grouped by nested cells of their midpoint, and
every cell keeps the tight box and the number of its items.  Queries go down the
cells level by level: a cell is dropped when it cannot hold an answer, that is
when its box is farther than an upper bound already proven by other cells (k
nearest) or than the radius (range).  Only cells that survive the finest level
are joined with their items.  So a dense spot never meets queries it cannot
answer, and no group of items is paired with all queries of its neighbourhood.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.functions.vectors import Triple, triple
from arborlake.functions.geometry import box_gap_sq, box_reach_sq
from arborlake.plans.cut import cut, cut_counted

STEP = 2  # bits per axis and level: a cell has at most 64 children, or 8 where these would leave cells nearly empty
MAX_BITS = 20
LEAF_ROWS = 48  # stop refining when no cell holds more
CROWD = 16  # searches of few queries: when the cell of an item holds no more on average, and none more than this many times as much
SMALL_LEVEL = 20_000  # cells; a level up to this size is broadcast (about 2 MB)
FEW_QUERIES = 100_000  # up to this many, the queries' cells are broadcast and neither cells nor items are shuffled
SMALL_FRONT = 500_000  # (query, cell) rows of such a search that are broadcast (about 40 MB)

# The score of a (query, item) row: a Column, or a step that adds d_sq where the
# expression is too large to write without intermediate columns.
Score = Column | Callable[[DataFrame], DataFrame]

_BOX = ("x0", "y0", "z0", "x1", "y1", "z1")


@dataclass
class BoxIndex:
    items: DataFrame
    scope: list[str]
    levels: list[tuple[DataFrame, int]]  # cells per level, coarse to fine, with their number
    crowded: bool  # some finest cell still holds many items


def _code(ix: Column, iy: Column, iz: Column) -> Column:
    return F.shiftleft(ix, 40) + F.shiftleft(iy, 20) + iz


def _parent(code: Column, bits: int = STEP) -> Column:
    mask = (1 << 20) - 1
    ix, iy, iz = F.shiftright(code, 40), F.shiftright(code, 20).bitwiseAND(F.lit(mask)), code.bitwiseAND(F.lit(mask))
    return _code(*(F.shiftright(v, bits) for v in (ix, iy, iz)))


def build(
    items: DataFrame, lo: Triple, hi: Triple, scope: list[str] = (), extras: dict[str, Column] | None = None,
    leaf_rows: int = LEAF_ROWS, crowd: int = 1, space: tuple | None = None,
) -> BoxIndex:
    """Cells over ``items``; ``extras`` are further aggregates kept per cell (min or max only).

    With ``crowd`` = CROWD cells stay larger, as few queries need not many cells; many queries meet fewer items in small ones.
    ``space`` is the least and the largest x, y, z to lay the cells over, if not those of the items.
    """
    scope, extras = list(scope), extras or {}
    boxed = items.withColumns(dict(zip(("_x0", "_y0", "_z0", "_x1", "_y1", "_z1"), (*lo, *hi))))
    ends = space or boxed.agg(
        *[F.min(f"_{a}0") for a in "xyz"], *[F.max(f"_{a}1") for a in "xyz"]
    ).first()
    low = [v or 0.0 for v in ends[:3]]
    extent = max([(b or 0.0) - a for a, b in zip(low, ends[3:])]) or 1.0
    top = 1 << MAX_BITS

    def index(a: str, start: float) -> Column:
        at = F.floor(((F.col(f"_{a}0") + F.col(f"_{a}1")) / 2 - start) / extent * top)
        return F.least(F.greatest(at, F.lit(0)), F.lit(top - 1)).cast("bigint")

    fine = cut(boxed.withColumn("_fine", _code(*(index(a, s) for a, s in zip("xyz", low)))), "items")
    sizes = {f"b_{n}": (F.min if n.endswith("0") else F.max)(f"_{n}") for n in _BOX}
    levels, bits, crowded, step, held, least = [], 0, True, STEP, None, None
    while bits < MAX_BITS and crowded:
        bits = min(MAX_BITS, bits + step)
        cells = fine.groupBy(*scope, _parent(F.col("_fine"), MAX_BITS - bits).alias("code")).agg(
            F.count("*").alias("b_n"),
            *[c.alias(n) for n, c in sizes.items()],
            *[c.alias(n) for n, c in extras.items()],
        )
        # ``up`` is the cell's number a level above.
        cells, tally = cut_counted(cells.withColumn("up", _parent(F.col("code"), step)), "cells",
                                   cells=F.count("*"), most=F.coalesce(F.max("b_n"), F.lit(0)), **_crowding())
        levels.append((cells, tally["cells"]))
        before, held = held, _held(tally)
        crowded = held > leaf_rows or tally["most"] > crowd * leaf_rows
        if crowded and least is None and before is not None and held > 0.7 * before:
            # Cells did not get emptier: many items may share a spot, which no level can tell apart.
            spots = fine.groupBy(*scope, "_fine").agg(F.count("*").alias("b_n"))
            least = _held(spots.agg(*[c.alias(n) for n, c in _crowding().items()]).first().asDict())
        if least is not None and held <= 2 * least:
            break
        step = STEP if crowd == 1 or held > 8 * leaf_rows else 1
    keyed = fine.withColumn("code", _parent(F.col("_fine"), MAX_BITS - bits)).drop(
        "_fine", "_x0", "_y0", "_z0", "_x1", "_y1", "_z1"
    )
    return BoxIndex(keyed, scope, levels, crowded)


# How many items the cell of an item holds, on average: from the sums of the counts and of their squares.
def _crowding() -> dict[str, Column]:
    n = F.col("b_n").cast("double")
    return {"rows": F.sum(n), "squares": F.sum(n * n)}


def _held(tally: dict) -> float:
    return (tally["squares"] or 0.0) / (tally["rows"] or 1.0)


def cell_box() -> tuple[Triple, Triple]:
    """Low and high corner of a cell's tight box."""
    return triple("b_x0", "b_y0", "b_z0"), triple("b_x1", "b_y1", "b_z1")


def _first_level(queries: DataFrame, index: BoxIndex) -> DataFrame:
    cells, n = index.levels[0]
    cells = cells.drop("up")
    if index.scope:
        return queries.join(F.broadcast(cells) if n <= SMALL_LEVEL else cells, index.scope)
    # One scope: at most 64 cells, written into the plan as a constant.
    rows = cells.collect()
    names = [f for f in cells.schema.fields]
    packed = F.array(*[
        F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in names]) for r in rows
    ])
    return queries.withColumn("_cell", F.explode(packed)).select(*queries.columns, "_cell.*")


def _descend(
    queries: DataFrame, q_keys: list[str], q_lo: Triple, q_hi: Triple, index: BoxIndex,
    keep: Callable[[DataFrame], DataFrame], usable: Column | None, thin: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pairs of a query and an item of a cell it keeps; ``thin`` leaves out items that cannot be answers.

    Few queries are written level by level and broadcast to the cells, and at last to the items, of which only those in
    their cells are thinned; so what is shuffled follows the answers.  Of many queries the cells are shuffled.
    """
    q_cols = queries.columns
    few = index.levels[-1][1] > SMALL_LEVEL or index.crowded
    few = few and queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES
    front = _first_level(queries, index)
    for depth in range(len(index.levels)):
        if usable is not None:
            front = front.where(usable)
        front = keep(front)
        if depth + 1 < len(index.levels):
            cells, n = index.levels[depth + 1]
            front = front.select(*q_cols, F.col("code").alias("up"))
            if n <= SMALL_LEVEL:
                cells = F.broadcast(cells)
            elif few:
                front, _ = _small(front)
            front = front.join(cells, [*index.scope, "up"]).drop("up")
    front, items = front.select(*q_cols, "code"), index.items
    if few:
        front, small = _small(front)
        if thin is not None and small:
            items = items.join(F.broadcast(front.select(*index.scope, "code").distinct()), [*index.scope, "code"], "left_semi")
    return front.join(items if thin is None else thin(items), [*index.scope, "code"]).drop("code")


def _small(front: DataFrame) -> tuple[DataFrame, bool]:
    """The (query, cell) rows written, and marked for a broadcast when they are few."""
    written, seen = cut_counted(front, "front", n=F.count(F.lit(1)))
    small = (seen["n"] or 0) <= SMALL_FRONT
    return (F.broadcast(written) if small else written), small


def _scored(pairs: DataFrame, score: Score) -> DataFrame:
    return pairs.withColumn("d_sq", score) if isinstance(score, Column) else score(pairs)


def k_nearest(
    queries: DataFrame, q_keys: list[str], q_lo: Triple, q_hi: Triple, index: BoxIndex, k: int,
    distance_sq: Score, order: list[str], usable: Column | None = None, admit: Column | None = None,
    least: Column | None = None, most: Column | None = None, limit_sq: float | None = None,
    owner: list[str] | None = None, spot: list[str] | None = None,
) -> DataFrame:
    """The ``k`` nearest items of every query, ties by ``order``; adds d_sq and rank.

    ``usable`` tells whether a cell holds at least one item the query may take
    (k = 1 only); ``admit`` tells the same for single items.  A score other than
    the squared distance needs its bounds over a cell: ``least`` and ``most``.
    Where ``admit`` only rules out the items of one owner, ``owner`` names the columns that tell owners apart and
    ``spot`` those that place an item: of items on one spot the first ones of two owners are enough (k = 1 only).
    With ``limit_sq`` only items of at most that score count, and cells beyond it are dropped from the first level on.
    """
    if k > 1 and usable is not None:
        raise ValueError("cells can only be ruled out for k = 1")
    lo, hi = cell_box()
    per_query = Window.partitionBy(*q_keys)

    def keep(front: DataFrame) -> DataFrame:
        near = box_gap_sq(q_lo, q_hi, lo, hi) if least is None else least
        if limit_sq is not None:
            front = front.where(near <= limit_sq * (1 + 1e-9))
        reach = front.withColumns({
            "_near": near,
            "_far": box_reach_sq(q_lo, q_hi, lo, hi) if most is None else most,
        })
        if k == 1:
            bound = F.min("_far").over(per_query)
        else:
            reach = reach.withColumn("_cum", F.sum("b_n").over(
                per_query.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)))
            bound = F.min(F.when(F.col("_cum") >= k, F.col("_far"))).over(per_query)
        reach = reach.withColumn("_bound", F.coalesce(bound, F.lit(float("inf"))))
        return reach.where(F.col("_near") <= F.col("_bound") * (1 + 1e-9)).drop("_near", "_far", "_bound", "_cum")

    thin = None
    if index.crowded and admit is None:
        thin = lambda items: _thin(items, k, order)
    elif index.crowded and owner is not None and k == 1:
        thin = lambda items: _two_owners(items, index.scope, order, owner, spot)
    pairs = _descend(queries, q_keys, q_lo, q_hi, index, keep, usable, thin)
    if admit is not None:
        pairs = pairs.where(admit)
    pairs = _scored(pairs, distance_sq)
    if limit_sq is not None:
        pairs = pairs.where(F.col("d_sq") <= limit_sq)
    ranked = pairs.withColumn(
        "rank", F.row_number().over(per_query.orderBy("d_sq", *order))
    )
    return ranked.where(F.col("rank") <= k)


def nearest_of(pairs: DataFrame, q_keys: list[str], score: Score | None, order: list[str]) -> DataFrame:
    """Of the pairs of ``passes`` the nearest of every query, ties by ``order``; adds d_sq and rank.  A missing score is the last.

    Without ``score`` d_sq is what the pairs were ranked by.
    """
    first = Window.partitionBy(*q_keys).orderBy(F.col("_score").asc_nulls_last(), *order)
    best = pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") == 1)
    return best.withColumnRenamed("_score", "d_sq") if score is None else _scored(best.drop("_score"), score)


def _thin(items: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Of items that agree in every column but the tie order only the first k can be among the k nearest."""
    same = [c for c in items.columns if c not in order]
    w = Window.partitionBy(*same).orderBy(*order)
    return items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def _two_owners(items: DataFrame, scope: list[str], order: list[str], owner: list[str], spot: list[str]) -> DataFrame:
    """Of items on one spot the first one of each of the first two owners.

    Both steps are limits per group, which every task applies to its own rows before anything is shuffled.
    """
    same = [*scope, "code", *spot]
    for keys, most in (([*same, *owner], 1), (same, 2)):
        w = Window.partitionBy(*dict.fromkeys(keys)).orderBy(*order)
        items = items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
    return items


def within(
    queries: DataFrame, q_keys: list[str], q_lo: Triple, q_hi: Triple, index: BoxIndex, radius: Column,
    distance_sq: Score, strict: bool = False, usable: Column | None = None,
) -> DataFrame:
    """All pairs of a query and an item at most (or less than) ``radius`` apart; adds d_sq."""
    lo, hi = cell_box()
    pairs = _scored(_descend(
        queries, q_keys, q_lo, q_hi, index,
        lambda front: front.where(box_gap_sq(q_lo, q_hi, lo, hi) <= radius * radius * (1 + 1e-9)), usable,
    ), distance_sq)
    limit = radius * radius
    return pairs.where(F.col("d_sq") < limit if strict else F.col("d_sq") <= limit)
