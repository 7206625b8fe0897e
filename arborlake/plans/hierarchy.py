"""Builders for folds along parent pointers.

``path_fold`` combines a value from the root down to every row by pointer
doubling: round k joins every row with the row 2^k steps above it, so a chain
of length L takes log2(L) rounds and no level loop is needed.

``roll_up`` combines values from the leaves up by tree contraction.  Each round
resolves all leaves of what is left and, with ``path_fold``, every run of rows
with one open child that ends in such a leaf.  At most half of the branching
rows survive a round, so the work is linear and the number of rounds is the
largest stream order, however deep the tree is.

``roll_sum`` is the form for plain sums.  After round k a row holds the sum over
the rows less than 2^k below it and a pointer to the row 2^k above it, to which
it hands that sum in the next round: one table a round, log2(depth) rounds.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.plans.cut import cut, cut_counted, discard
from arborlake.plans.lookup import lookup


@dataclass(frozen=True)
class Fold:
    """One value folded along a path: its own part and how an upper part meets a lower part."""

    name: str
    own: Column
    combine: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def add(name: str, own: Column) -> Fold:
    return Fold(name, own, lambda up, low: up(name) + low(name))


def times(name: str, own: Column) -> Fold:
    return Fold(name, own, lambda up, low: up(name) * low(name))


def first(name: str, own: Column) -> Fold:
    """Value of the topmost row of the path."""
    return Fold(name, own, lambda up, low: up(name))


def listed(name: str, own: Column) -> Fold:
    """Array of the values from the topmost row down."""
    return Fold(name, F.array(own), lambda up, low: F.concat(up(name), low(name)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _max_rounds(rows: int) -> int:
    return int(math.log2(rows + 1)) + 2


def path_fold(
    df: DataFrame, scope: list[str], id_col: str, pointer: str, folds: list[Fold], carry: list[str] = (),
    n_active: int | None = None,
) -> DataFrame:
    """Fold along ``pointer`` until it is null; rows that never get there (cycles, orphans) drop out.

    ``n_active`` is the number of rows with a pointer, where the caller knows it and ``df`` is a written table;
    otherwise the start is written once, so that no round replays the source.
    """
    names = [f.name for f in folds]
    state = df.select(
        *scope, id_col, *carry, F.col(pointer).alias("_up"), *[f.own.alias(f.name) for f in folds]
    )
    if n_active is None:
        state, tally = cut_counted(state, "start", going=F.count("_up"))
        n_active = tally["going"]
    done = [state.where(F.col("_up").isNull()).drop("_up")]
    active = state.where(F.col("_up").isNotNull())
    keys = [*scope, "_up"]
    for _ in range(_max_rounds(n_active)):
        if n_active == 0:
            break
        seen = _union([d.select(*scope, id_col, *names).withColumn("_up", F.lit(None).cast("long")) for d in done]
                      + [active.select(*scope, id_col, *names, "_up")])
        above = seen.select(
            *scope,
            F.col(id_col).alias("_at"),
            F.col("_up").alias("_next"),
            *[F.col(n).alias(f"_a_{n}") for n in names],
        )
        met = lookup(active.withColumnRenamed("_up", "_at"), above, [*scope, "_at"], n_active)
        stepped = met.select(
            *scope,
            id_col,
            *carry,
            F.col("_next").alias("_up"),
            *[f.combine(lambda c: F.col(f"_a_{c}"), F.col).alias(f.name) for f in folds],
        )
        stepped, seen_now = cut_counted(stepped, "path", going=F.count("_up"))
        n_active = seen_now["going"]
        done.append(stepped.where(F.col("_up").isNull()).drop("_up"))
        active = stepped.where(F.col("_up").isNotNull())
    return _union(done)


@dataclass(frozen=True)
class Rise:
    """A value rising from the leaves.

    With ``g`` = sum of ``push`` over the children already known, a row with no
    open child has value ``leaf(own, g)``; a row with one open child of value x
    has value (a x + b) / (c x + 1) with (a, b, c) = ``chain(own, g)``.
    """

    name: str
    own: Column
    push: Callable[[Column], Column]
    leaf: Callable[[Column, Column], Column]
    chain: Callable[[Column, Column], tuple[Column, Column, Column]]


def rise_series_parallel(name: str, own: Column) -> Rise:
    """Own resistance in series with the children in parallel."""
    return Rise(
        name,
        own,
        lambda x: 1 / x,
        lambda own, g: own + F.when(g > 0, 1 / g).otherwise(F.lit(0.0)),
        # own + 1/(g + 1/x) = ((1 + own g) x + own) / (g x + 1)
        lambda own, g: (1 + own * g, own, g),
    )


def _moebius(name: str) -> list[Fold]:
    """The map of a run, upper map after lower map, scaled to a last entry of 1."""
    a, b, c = f"{name}_a", f"{name}_b", f"{name}_c"

    # Along the open-child pointer the row "above" in path_fold is the deeper one.
    def last(deep, own):
        return own(c) * deep(b) + 1

    return [
        Fold(a, F.col(a), lambda deep, own: (own(a) * deep(a) + own(b) * deep(c)) / last(deep, own)),
        Fold(b, F.col(b), lambda deep, own: (own(a) * deep(b) + own(b)) / last(deep, own)),
        Fold(c, F.col(c), lambda deep, own: (own(c) * deep(a) + deep(c)) / last(deep, own)),
    ]


def roll_up(
    df: DataFrame, scope: list[str], id_col: str, parent: str, rises: list[Rise], order: str = "_order"
) -> DataFrame:
    """Values of all ``rises`` per row, plus the stream order (round in which the row is resolved)."""
    owns = [f"_own_{r.name}" for r in rises]
    sums = [f"_g_{r.name}" for r in rises]
    rest = df.select(
        *scope,
        id_col,
        F.col(parent).alias("_parent"),
        *[r.own.cast("double").alias(o) for r, o in zip(rises, owns)],
        *[F.lit(0.0).alias(g) for g in sums],
    )
    rest = cut(rest, "rest")
    resolved: list[DataFrame] = []
    folds = [F_ for r in rises for F_ in _moebius(r.name)]
    end_folds = [first(f"_end_{r.name}", F.col(f"_end_{r.name}")) for r in rises] + [
        first("_ends", F.col("_ends"))
    ]
    level = 0
    while True:
        level += 1
        kids = (
            rest.where(F.col("_parent").isNotNull())
            .groupBy(*scope, F.col("_parent").alias(id_col))
            .agg(F.count("*").alias("_kids"), F.min(id_col).alias("_kid"))
        )
        staged = rest.join(kids, [*scope, id_col], "left").withColumn("_kids", F.coalesce("_kids", F.lit(0)))
        one = F.col("_kids") == 1
        cols = []
        for r, o, g in zip(rises, owns, sums):
            a, b, c = r.chain(F.col(o), F.col(g))
            cols += [
                F.when(one, a).otherwise(F.lit(1.0)).alias(f"{r.name}_a"),
                F.when(one, b).otherwise(F.lit(0.0)).alias(f"{r.name}_b"),
                F.when(one, c).otherwise(F.lit(0.0)).alias(f"{r.name}_c"),
                F.when(F.col("_kids") == 0, r.leaf(F.col(o), F.col(g))).alias(f"_end_{r.name}"),
            ]
        staged = staged.select(
            *scope,
            id_col,
            "_parent",
            *owns,
            *sums,
            *cols,
            (F.col("_kids") == 0).alias("_ends"),
            F.when(one, F.col("_kid")).alias("_open"),
        )
        staged, tally = cut_counted(
            staged, "rise", ends=F.count_if("_ends"), runs=F.count("_open"), rows=F.count("*")
        )
        if tally["ends"] == 0:
            break  # nothing but cycles left
        folded = path_fold(
            staged, scope, id_col, "_open", folds + end_folds, ["_parent", *owns, *sums], tally["runs"]
        )
        known = folded.where("_ends").select(
            *scope,
            id_col,
            "_parent",
            F.lit(level).alias(order),
            *[
                (
                    (F.col(f"{r.name}_a") * F.col(f"_end_{r.name}") + F.col(f"{r.name}_b"))
                    / (F.col(f"{r.name}_c") * F.col(f"_end_{r.name}") + 1)
                ).alias(r.name)
                for r in rises
            ],
        )
        known = cut(known, "known")
        resolved.append(known)
        if tally["ends"] + tally["runs"] == tally["rows"]:
            break  # without a branching row every run ends in a leaf
        open_rows = folded.where(~F.col("_ends"))
        pushed = (
            known.where(F.col("_parent").isNotNull())
            .groupBy(*scope, F.col("_parent").alias(id_col))
            .agg(*[F.sum(r.push(F.col(r.name))).alias(f"_in_{r.name}") for r in rises], F.lit(1).alias("_hit"))
        )
        grown = open_rows.join(pushed, [*scope, id_col], "left")
        after = cut(grown.select(
            *scope,
            id_col,
            "_parent",
            *owns,
            *[
                (F.col(g) + F.coalesce(F.col(f"_in_{r.name}"), F.lit(0.0))).alias(g)
                for r, g in zip(rises, sums)
            ],
        ), "rest")
        discard(rest, staged)
        rest = after
    return _union(resolved).drop("_parent")


def roll_sum(df: DataFrame, scope: list[str], id_col: str, parent: str, sums: dict[str, Column]) -> DataFrame:
    """(scope, id, sums): each column summed up over a row and all rows below it; rows on a cycle drop out."""
    keys = [*scope, id_col]
    start = df.select(*keys, F.col(parent).alias("_up"), *[c.cast("double").alias(n) for n, c in sums.items()])
    state, tally = cut_counted(start, "sums", going=F.count("_up"), rows=F.count(F.lit(1)))
    for _ in range(_max_rounds(tally["rows"])):
        if not tally["going"]:
            return state.select(*keys, *sums)
        going = state.where(F.col("_up").isNotNull())
        handed = going.groupBy(*scope, F.col("_up").alias(id_col)).agg(*[F.sum(n).alias(f"_in_{n}") for n in sums])
        above = going.select(*scope, F.col(id_col).alias("_at"), F.col("_up").alias("_next"))
        # Rows that have arrived look up places that nobody has, so they do not meet in one task.
        asked = state.withColumn("_at", F.coalesce("_up", -1 - F.abs(F.xxhash64(id_col) / 2).cast("long")))
        met = asked.join(above, [*scope, "_at"], "left").join(handed, keys, "left")
        stepped, tally = cut_counted(met.select(
            *keys, F.when(F.col("_up").isNotNull(), F.col("_next")).alias("_up"),
            *[(F.col(n) + F.coalesce(F.col(f"_in_{n}"), F.lit(0.0))).alias(n) for n in sums]), "sums", going=F.count("_up"), rows=F.count(F.lit(1)))
        discard(state)
        state = stepped
    # Every pointer that is left stands on a cycle, and the pointers of its rows stand on all of them.
    looped = state.where(F.col("_up").isNotNull()).select(*scope, F.col("_up").alias(id_col)).distinct()
    return state.join(looped, keys, "left_anti").select(*keys, *sums)
