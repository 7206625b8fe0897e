"""Nearest items and items within a radius in one pass, where one side is small enough to travel to every task.

Up to ``HELD`` items travel, and every task settles its own queries; up to ``PLACES`` queries travel, and every task sends
what its own items answer, one row of each query.  So items are neither written nor shuffled: as long as there are fewer
queries than a task has items, fewer rows meet again than an exchange of the items would move.  Inside a task pairs come
from nested boxes over at most ``CHUNK`` items; a query that found something drops what is farther in the next chunk.

What is found are pairs that can be an answer; ``boxes.nearest_of`` ranks them.  Of items that agree in
all that the score reads only the first one is kept.  An item with a missing place answers only where its scope has no
other; a query with a missing place is as far from every item and takes the first one.
"""

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

from arborlake.plans.blocks import curve, new_spots, point_segment_sq, spot_names

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = 262_144  # items that travel
PLACES = 500_000  # queries that travel
CHUNK = 1 << 19  # items that a task looks at together
ASKED = 4_096  # queries looked at together
FRONT = 1 << 18  # (query, box) pairs looked at together
SENT = 65_536  # rows of a batch
SCORE = "_score"
LEAF, FAN = 8, 8
BEAM = 8  # boxes of a level, and items, that are looked at first
_SLACK = 1 + 1e-9


@dataclass
class Measure:
    """How items are scored.  ``ends`` are the columns of a point (3) or of both ends (6), ``extras`` those read besides.

    ``reach`` gives the least and the largest score from queries (3, n) to boxes, whose rows are x, y, z and the extras;
    ``score`` that from queries to items, whose rows are the ends and the extras.  ``kind`` numbers the items that are
    kept in boxes of their own.  A ``costly`` score is taken only of items that their own box does not rule out.
    """

    ends: list[str]
    reach: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    extras: tuple[str, ...] = ()
    kind: Callable[[np.ndarray], np.ndarray] | None = None
    costly: bool = False


def box_reach_sq(q: np.ndarray, mins: np.ndarray, maxs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances that points of a box have at least and at most."""
    below, above = mins[:3] - q, q - maxs[:3]
    gap, far = np.maximum(np.maximum(below, above), 0.0), np.maximum(-below, -above)
    gap *= gap
    far *= far
    return gap[0] + gap[1] + gap[2], far[0] + far[1] + far[2]


def point_point_sq(q: np.ndarray, items: np.ndarray) -> np.ndarray:
    away = q - items[:3]
    return away[0] * away[0] + away[1] * away[1] + away[2] * away[2]


def point_ends_sq(q: np.ndarray, items: np.ndarray) -> np.ndarray:
    return point_segment_sq(q, items[:3], items[3:6])


class Nested:
    """Nested boxes over items, ``LEAF`` neighbours a leaf and ``FAN`` boxes below each box."""

    def __init__(self, values: np.ndarray, measure: Measure):
        n = len(measure.ends)
        lo, hi = values[:3], values[n - 3 : n]
        lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
        low = lo.min(1)
        code = curve((lo + hi) / 2, low, float((hi.max(1) - low).max()) or 1.0)
        self.order = np.argsort(code, kind="stable") if measure.kind is None else np.lexsort((code, measure.kind(values)))
        self.measure, self.values = measure, values[:, self.order]
        mins, maxs = (np.concatenate([x, values[n:]])[:, self.order] for x in (lo, hi))
        self.levels, width = [(mins, maxs, None, None)], LEAF
        while len(self.levels) == 1 or mins.shape[1] > FAN:
            heads = np.arange(0, mins.shape[1], width)
            sizes = np.diff(np.append(heads, mins.shape[1]))
            mins, maxs, width = np.minimum.reduceat(mins, heads, axis=1), np.maximum.reduceat(maxs, heads, axis=1), FAN
            self.levels.append((mins, maxs, heads, sizes))

    def _below(self, depth: int, a: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads, sizes = self.levels[depth][2:]
        n = sizes[node]
        return np.repeat(a, n), np.repeat(heads[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def _leaves(self, q: np.ndarray, bound: np.ndarray, shrink: bool):
        """Yields (query, leaf, least score) within the bound, all leaves of a query at once; the bound shrinks."""
        n, top = len(self.levels) - 1, self.levels[-1][0].shape[1]
        todo = [(n, np.repeat(np.arange(q.shape[1]), top), np.tile(np.arange(top), q.shape[1]))]
        while todo:
            depth, a, node = todo.pop()
            if len(a) > FRONT and a[0] != a[-1]:
                middle = a[len(a) // 2]
                at = np.searchsorted(a, middle) or np.searchsorted(a, middle, "right")
                todo += [(depth, a[at:], node[at:]), (depth, a[:at], node[:at])]
                continue
            a, node, least = self._kept(depth, q, bound, a, node, shrink)
            if depth > 1 and len(a):
                todo.append((depth - 1, *self._below(depth, a, node)))
            elif len(a):
                yield a, node, least

    def _kept(self, depth: int, q, bound, a, node, shrink: bool):
        mins, maxs = self.levels[depth][:2]
        least, most = self.measure.reach(*(np.take(x, y, 1) for x, y in ((q, a), (mins, node), (maxs, node))))
        ok = least <= bound[a] * _SLACK
        a, node, least, most = a[ok], node[ok], least[ok], most[ok]
        if not shrink or not len(a):
            return a, node, least
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        bound[a[starts]] = np.minimum(bound[a[starts]], np.minimum.reduceat(most, starts) * _SLACK)
        ok = least <= bound[a] * _SLACK
        return a[ok], node[ok], least[ok]

    def _promise(self, q: np.ndarray, bound: np.ndarray) -> None:
        """Lowers the bound to the best of a few items in the most promising boxes."""
        n, top = len(self.levels) - 1, self.levels[-1][0].shape[1]
        a, node = np.repeat(np.arange(q.shape[1]), top), np.tile(np.arange(top), q.shape[1])
        for depth in range(n, -1, -1):
            a, node, least = self._kept(depth, q, bound, a, node, False)
            by = np.lexsort((least, a))
            a, node = a[by], node[by]
            starts = np.flatnonzero(np.diff(a, prepend=-1))
            few = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < BEAM
            a, node = (a[few], node[few]) if depth == 0 else self._below(depth, a[few], node[few])
        if len(a):
            d = self.measure.score(np.take(q, a, 1), np.take(self.values, node, 1))
            starts = np.flatnonzero(np.diff(a, prepend=-1))
            bound[a[starts]] = np.minimum(bound[a[starts]], np.fmin.reduceat(d, starts))

    def nearest(self, q: np.ndarray, bound: np.ndarray):
        """Yields (query, item, score) of the items of the least score, if it is within the bound."""
        for at in range(0, q.shape[1], ASKED):
            some, held = q[:, at : at + ASKED], bound[at : at + ASKED].copy()
            if self.measure.costly and np.isinf(held).any():
                self._promise(some, held)
            for asked, leaf, least in self._leaves(some, held, True):
                found = []

                def meet(which, asked=asked, leaf=leaf, found=found, some=some, held=held):
                    a, i = self._below(1, asked[which], leaf[which])
                    if self.measure.costly:
                        a, i, _ = self._kept(0, some, held, a, i, True)
                    if len(a):
                        d = self.measure.score(np.take(some, a, 1), np.take(self.values, i, 1))
                        starts = np.flatnonzero(np.diff(a, prepend=-1))
                        held[a[starts]] = np.minimum(held[a[starts]], np.fmin.reduceat(d, starts))
                        good = d <= held[a]
                        found.append((a[good], i[good], d[good]))

                by = np.lexsort((least, asked))
                first = np.zeros(len(by), bool)
                first[by[np.flatnonzero(np.diff(asked[by], prepend=-1))]] = True
                meet(first)  # the nearest leaf of each query, then the leaves that can still hold a nearer item
                meet(~first & (least <= held[asked] * _SLACK))
                if found:
                    a, i, d = (np.concatenate(x) for x in zip(*found))
                    good = d <= held[a]
                    yield a[good] + at, self.order[i[good]], d[good]

    def within(self, q: np.ndarray, limit: float):
        """Yields (query, item) of the items with a score of at most ``limit``, give or take the last digits."""
        for at in range(0, q.shape[1], ASKED):
            some = q[:, at : at + ASKED]
            for asked, leaf, _ in self._leaves(some, np.full(some.shape[1], limit), False):
                a, i = self._below(1, asked, leaf)
                near = self.measure.score(np.take(some, a, 1), np.take(self.values, i, 1)) <= limit * _SLACK
                yield a[near] + at, self.order[i[near]]


def _matrix(table: pa.Table, names) -> np.ndarray:
    return np.array([pc.fill_null(table.column(c).cast(pa.float64()), np.nan).to_numpy() for c in names]).reshape(len(names), table.num_rows)


def _rank(table: pa.Table, order: list[str]) -> np.ndarray:
    """Place of each row in the order, a missing value first."""
    keys = table.select(order).combine_chunks()
    by = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in order], null_placement="at_start").to_numpy()
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by))
    return out


def _firsts(values: np.ndarray, rank: Callable[[], np.ndarray]) -> np.ndarray:
    """Of columns that are equal the one of least rank."""
    name = spot_names(values)
    if len(np.unique(name)) == len(name):
        return np.arange(len(name))
    by = np.lexsort((rank(), name))
    return np.sort(by[new_spots(values, name, by)])


class Scope:
    """The items of one scope in a table: nested boxes of the places, and the first item without one."""

    def __init__(self, table: pa.Table, rows: np.ndarray, measure: Measure, order: list[str], thin: bool):
        values = _matrix(table, [*measure.ends, *measure.extras])[:, rows]
        ranks = []
        self.rank = lambda: ranks[0] if ranks else ranks.append(_rank(table, order)) or ranks[0]
        known = np.flatnonzero(~np.isnan(values).any(0))
        if thin and len(known):
            known = known[_firsts(values[:, known], lambda: self.rank()[rows[known]])]
        self.rows = rows[known]
        self.tree = Nested(values[:, known], measure) if len(known) else None
        lost = rows[np.isnan(values).any(0)]
        self.first = lambda: int(rows[np.argmin(self.rank()[rows])])
        self.lost = int(lost[np.argmin(self.rank()[lost])]) if thin and len(lost) and not len(known) else None

    def nearest(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row of the table, score), one for each query that finds something within the bound."""
        found = list(self.tree.nearest(q, bound))
        if not found:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        a, i, d = (np.concatenate(x) for x in zip(*found))
        i = self.rows[i]
        by = np.argsort(a, kind="stable")
        if (a[by[1:]] == a[by[:-1]]).any():  # as near: the first one
            by = np.lexsort((self.rank()[i], a))
        by = by[np.diff(a[by], prepend=-1) != 0]
        return a[by], i[by], d[by]


def _grouped(column, known: pa.Array | None, n: int) -> list[tuple[int, np.ndarray]]:
    """(number of the scope, its rows); rows of no known scope are left out."""
    if known is None:
        return [(0, np.arange(n))] if n else []
    code = pc.fill_null(pc.index_in(column, known), -1).to_numpy(zero_copy_only=False)
    by = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[by])) + 1
    return [(int(code[rows[0]]), rows) for rows in np.split(by, cuts) if len(rows) and code[rows[0]] >= 0]


class Search:
    """One search: columns, measure and limit, and what a task does with its batches."""

    def __init__(self, queries: DataFrame, items: DataFrame, scope: str | None, order: list[str], measure: Measure, limit: float | None, places: list[str]):
        self.scope, self.order, self.measure, self.limit, self.places = scope, order, measure, limit, places
        self.q_cols = queries.columns
        self.i_cols = [c for c in items.columns if c != scope]
        fields = {f.name: f for f in [*items.schema.fields, *queries.schema.fields]}
        self.schema = T.StructType([T.StructField(c, fields[c].dataType) for c in [*self.q_cols, *self.i_cols]])
        if limit is None:
            self.schema.add(SCORE, T.DoubleType())

    def sent(self, queries: pa.Table, q: np.ndarray, items: pa.Table, i: np.ndarray, d: np.ndarray | None = None):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        for at in range(0, len(q), SENT):
            a, b = pa.array(q[at : at + SENT]), pa.array(i[at : at + SENT])
            found = [t.column(c).take(x) for t, x, names in ((queries, a, self.q_cols), (items, b, self.i_cols)) for c in names]
            if self.limit is None:
                found.append(pa.nulls(len(a), pa.float64()) if d is None else pa.array(d[at : at + SENT]))
            table = pa.table([c.cast(f.type) for c, f in zip(found, kinds)], names=kinds.names)
            yield from table.combine_chunks().to_batches()

    def _places(self, queries: pa.Table, known: pa.Array | None):
        """(number of the scope, rows with a place, their places, rows without one) of queries."""
        q = _matrix(queries, self.places)
        lost = np.isnan(q).any(0)
        for k, rows in _grouped(self.scope and queries.column(self.scope), known, queries.num_rows):
            yield k, rows[~lost[rows]], q[:, rows[~lost[rows]]], rows[lost[rows]]

    def _known(self, table: pa.Table) -> pa.Array | None:
        return pc.drop_null(pc.unique(table.column(self.scope))) if self.scope else None

    def by_items(self, held: pa.Table):
        """Each task settles its own queries."""
        def run(batches):
            known = self._known(held)
            thin = self.limit is None
            scopes = {k: Scope(held, rows, self.measure, self.order, thin) for k, rows in _grouped(self.scope and held.column(self.scope), known, held.num_rows)}
            for queries in _chunks(batches, SENT):
                for k, rows, q, lost in self._places(queries, known):
                    found = scopes[k]
                    if self.limit is not None:
                        for a, i in found.tree.within(q, self.limit) if found.tree else ():
                            yield from self.sent(queries, rows[a], held, found.rows[i])
                        continue
                    if found.tree:
                        a, i, d = found.nearest(q, np.full(q.shape[1], np.inf))
                        yield from self.sent(queries, rows[a], held, i, d)
                    elif found.lost is not None:
                        yield from self.sent(queries, rows, held, np.full(len(rows), found.lost))
                    if len(lost):
                        yield from self.sent(queries, lost, held, np.full(len(lost), found.first()))
        return run

    def by_queries(self, held: bytes):
        """Each task sends what its own items answer."""
        def run(batches):
            queries = pa.ipc.open_stream(held.value).read_all()
            known = self._known(queries)
            asked = {k: x for k, *x in self._places(queries, known)}
            bound = {k: np.full(len(x[0]), np.inf) for k, x in asked.items()}
            best, lost = {}, {}  # of each scope: rows of queries, their scores and items; the first item, the first without a place
            for items in _chunks(batches, CHUNK):
                for k, rows in _grouped(self.scope and items.column(self.scope), known, items.num_rows):
                    found = Scope(items, rows, self.measure, self.order, self.limit is None)
                    places, q, without = asked[k]
                    if self.limit is not None:
                        for a, i in found.tree.within(q, self.limit) if found.tree else ():
                            yield from self.sent(queries, places[a], items, found.rows[i])
                        continue
                    for name, i in (("any", found.first() if len(without) else None), ("lost", found.lost)):
                        if i is not None:
                            here = items.slice(i, 1) if (k, name) not in lost else pa.concat_tables([lost[k, name], items.slice(i, 1)])
                            lost[k, name] = here.take(pc.sort_indices(here, sort_keys=[(c, "ascending") for c in self.order], null_placement="at_start")[:1])
                    if not found.tree:
                        continue
                    a, i, d = found.nearest(q, bound[k])
                    bound[k][a] = d
                    best.setdefault(k, []).append((a, d, items.take(pa.array(i))))
                    if len(best[k]) > 1:
                        best[k] = [_joined([(x, y, t) if (y <= bound[k][x]).all() else _taken(x, y, t, y <= bound[k][x]) for x, y, t in best[k]])]
            for k, (places, _, without) in asked.items():
                for a, d, items in best.get(k, []):
                    yield from self.sent(queries, places[a], items, np.arange(len(a)), d)
                if k not in best and (k, "lost") in lost:
                    yield from self.sent(queries, places, lost[k, "lost"], np.zeros(len(places), np.int64))
                if (k, "any") in lost:
                    yield from self.sent(queries, without, lost[k, "any"], np.zeros(len(without), np.int64))
        return run


def _taken(a, d, items, keep):
    return a[keep], d[keep], items.filter(pa.array(keep))


def _joined(found):
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), pa.concat_tables([x[2] for x in found]).combine_chunks()


def _chunks(batches, rows: int):
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            held.append(part)
            n += part.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs(queries: DataFrame, items: DataFrame, scope: str | None, order: list[str], measure: Measure,
          limit: float | None = None, places: tuple[str, ...] = ("x", "y", "z")) -> DataFrame | None:
    """Pairs of a query and an item (the columns of both) that can be the nearest, with ``SCORE``, or within ``limit``.

    None if both sides are too many to travel.  The nearest is that of least score, then the first one by ``order``.
    """
    search = Search(queries, items, scope, order, measure, limit, list(places))
    context = queries.sparkSession.sparkContext
    if _few(items, HELD):
        held = context.broadcast(_packed(items))
        return queries.mapInArrow(_told(search.by_items, held), search.schema)
    if _few(queries, PLACES):
        held = context.broadcast(_packed(queries))
        return items.mapInArrow(search.by_queries(held), search.schema)
    return None


def travels(queries: DataFrame, items: DataFrame) -> bool:
    """Can the items or the queries travel?"""
    return _few(items, HELD) or _few(queries, PLACES)


def _few(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def _told(work, held):
    def run(batches):
        yield from work(pa.ipc.open_stream(held.value).read_all())(batches)
    return run


def _packed(rows: DataFrame) -> bytes:
    table, sink = rows.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()
