"""Triangular solves over units: contiguous pieces of permuted rows, one task each.

A unit's solution is an affine function of the values it needs of other units.  Only the
interface counts between units, the values that others refer to: q = c + M q, where c is
what a unit finds if all it needs were 0, and M holds a dense map for each pair of units.
M maps lower units to higher ones (or the reverse), so q = ... (I + M^4)(I + M^2)(I + M) c:
maps are composed pairwise once, and a solve takes as many steps as the longest chain
of units has binary digits, between two passes over the triangle; where interfaces are
small in all, the sum of all powers of M is made once and a solve takes one step.

Where maps would be large (`MAP_VALUES`) units are solved in rounds if they are few
(`FEW_UNITS`): a round solves all units whose needs are there, each in a task.  Where they
are many the triangle is solved in steps of joins: x = d^-1 (b - T x), T being the entries
off the diagonal, from x = d^-1 b on until every value stands still.  T is nilpotent, so
values are right after as many steps as the longest chain of entries, and far earlier where
pivots dominate.  If the change of the first steps says that more than `STEPS` are needed,
units are solved in rounds after all.  All give the solution of the same triangle.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import block_of, first_row
from ..sources.shared import written
from . import kernels

#: Rows of a unit: at most, and at least where that makes more than UNITS of them.
MOST_ROWS, LEAST_ROWS, UNITS = 65_536, 1024, 4
#: Values of a map between two units, and of a unit's rows by the values it needs, that a task may hold.
MAP_VALUES, SPREAD_VALUES = 4_000_000, 20_000_000
#: Interface values in all up to which one task makes the sum of all powers (at most half the square of this).
CLOSED = 4000
#: Pairs of units that the driver orders itself; beyond, rounds are found in Spark.
DRIVER_PAIRS = 100_000
#: Units (interior and separator ones) that are solved in rounds rather than in steps, at most, and rows of one, at least.
FEW_UNITS, ROUND_ROWS = 16, 1024
#: Steps that solving by joins may take, and those after which it says how many it needs.
STEPS, TRIAL = 64, 6
#: What a term may add to the difference between two orders of a sum, as a part of the sum of sizes.
ROUNDING = 2.0**-52
MAPS = "unit long, of_unit long, inner int, values array<double>"
SOLVED = "unit long, ids array<long>, x array<double>, seconds double"


def _pairs_of(entries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(entries.column(x).to_numpy() for x in ("row", "col", "val"))


@dataclass(frozen=True)
class Triangle:
    """Entries (unit, row, col, val) of a triangle, cut in units, and what leads from unit to unit.

    unit_of gives the unit of an id; links are the pairs (unit, of_unit) of units that need
    others.  With maps: interface has (unit, ids, places), the ids of a unit that others
    refer to and their places in it; maps are the powers 1, 2, 4, ... of M as (unit,
    of_unit, values); closure is the sum of all powers, where that is small.  With steps:
    step is d^-1 T, kept by column in the executors, pivots are (row, d), None where all
    are 1, and by_rounds makes what solves if steps don't.  With rounds:
    units and numbers of the rounds they need, and need (unit, col).
    """

    upper: bool
    missing_diag: str
    folder: str
    unit_of: Callable[[DataFrame], DataFrame]
    entries: DataFrame
    links: DataFrame | None = None
    interface: DataFrame | None = None
    maps: tuple[DataFrame, ...] = ()
    closure: DataFrame | None = None
    step: DataFrame | None = None
    pivots: DataFrame | None = None
    by_rounds: Callable[[], Triangle] | None = None
    _made: list[Triangle] = field(default_factory=list, repr=False, compare=False)
    need: DataFrame | None = None
    rounds: tuple[tuple[DataFrame, tuple[int, ...]], ...] = ()

    def solve(self, vector: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """(id, x) of every row for right sides (id, x), and the steps' tables (unit, seconds and more).

        `vector` is read more than once: it should be a table.
        """
        if self.step is not None:
            if not self._made and (found := self._by_steps(vector)) is not None:
                return found, []
            if not self._made:
                self._made.append(self.by_rounds())
            return self._made[0].solve(vector)
        right = self.unit_of(vector).select("unit", "id", "x")
        return self._by_rounds(right) if self.rounds else self._by_maps(right)

    def _pass(self, right: DataFrame, known: DataFrame | None, entries: DataFrame) -> DataFrame:
        """SOLVED rows, one for each unit of `right`, given the values it needs: (unit, ids, x) or (unit, id, x); None: all are 0."""
        upper, missing, zero = self.upper, self.missing_diag, known is None

        def run(entries: pa.Table, values: pa.Table) -> pa.Table:
            began = time.perf_counter()
            unit = values.column("v_unit")[0].as_py()
            own, told = values.filter(pc.field("own")), values.filter(pc.field("v_id").is_valid() & ~pc.field("own"))
            order = np.argsort(ids := own.column("v_id").to_numpy())
            rows, x = ids[order].tolist(), own.column("v_x").to_numpy()[order].tolist()
            have = dict(zip(rows, x, strict=True))
            have.update(zip(told.column("v_id").to_pylist(), told.column("v_x").to_pylist(), strict=True))
            whole = values.filter(pc.field("ids").is_valid())
            for others, y in zip(whole.column("ids").to_pylist(), whole.column("y").to_pylist(), strict=True):
                have.update(zip(others, y, strict=True))
            row, col, val = _pairs_of(entries)
            if zero:  # what the unit needs of others counts as 0
                inside = np.isin(col, ids)
                row, col, val = row[inside], col[inside], val[inside]
            lines = kernels.rows_of(row, col, val)
            found = kernels.backward(lines, have, rows, missing) if upper else kernels.forward(lines, have, rows)
            return pa.table({"unit": pa.array([unit], pa.int64()), "ids": [rows], "x": [[found[i] for i in rows]], "seconds": [time.perf_counter() - began]})

        none = lambda kind: F.lit(None).cast(kind)
        single = lambda df, own: df.select(F.col("unit").alias("v_unit"), F.lit(own).alias("own"), F.col("id").alias("v_id"), F.col("x").alias("v_x"), none("array<long>").alias("ids"), none("array<double>").alias("y"))
        mine = single(right, True)
        if known is not None:
            lists = known.select(F.col("unit").alias("v_unit"), F.lit(False).alias("own"), none("long").alias("v_id"), none("double").alias("v_x"), "ids", F.col("x").alias("y")) if "ids" in known.columns else single(known, False)
            mine = mine.unionByName(lists)
        return entries.groupBy("unit").cogroup(mine.groupBy("v_unit")).applyInArrow(run, SOLVED)

    def _by_maps(self, right: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        alone = written(self._pass(right, None, self.entries), "alone", self.folder)
        if self.interface is None:
            return _values(alone), [alone]
        picked = F.transform("places", lambda i: F.get("x", i.cast("int")))
        q = alone.join(self.interface.select("unit", "places"), "unit").select("unit", picked.alias("x"))
        for k, power in enumerate((self.closure,) if self.closure is not None else self.maps):
            if k:
                q = written(q, "interface-values", self.folder)
            met = power.join(q.select(F.col("unit").alias("of_unit"), "x"), "of_unit").select("unit", "values", "x")
            both = met.unionByName(q.select("unit", F.lit(None).cast("array<double>").alias("values"), "x"))
            q = both.groupBy("unit").applyInArrow(_applied, "unit long, x array<double>")
        told = self.interface.select(F.col("unit").alias("of_unit"), "ids").join(q.select(F.col("unit").alias("of_unit"), "x"), "of_unit")
        solved = written(self._pass(right, self.links.join(told, "of_unit"), self.entries), "solved", self.folder)
        return _values(solved), [alone, solved]

    def _by_steps(self, vector: DataFrame) -> DataFrame | None:
        """(id, x), or None where more than STEPS steps are needed."""
        start = vector.select("id", F.col("x").alias("b"))
        if self.pivots is not None:
            start = start.join(self.pivots, F.col("id") == F.col("row")).select("id", (F.col("b") / F.col("d")).alias("b"))
        x, last = written(start.select("id", "b", F.col("b").alias("x")), "step", self.folder), None
        for k in range(STEPS + 1):
            term = F.col("val") * F.col("x")
            sums = self.step.join(x.select("id", "x"), F.col("col") == F.col("id")).groupBy("row").agg(F.sum(term).alias("s"), F.sum(F.abs(term)).alias("size"), F.count("*").alias("terms"))
            new = F.col("b") - F.coalesce("s", F.lit(0.0))
            size = F.abs("b") + F.coalesce("size", F.lit(0.0))
            change = F.abs(new - F.col("x"))
            still = F.coalesce((change <= (F.coalesce("terms", F.lit(0)) + 1) * ROUNDING * size) & ~F.isnan(new), F.lit(False))
            seen = Observation()
            after = x.join(sums, F.col("id") == F.col("row"), "left").select("id", "b", F.when(still, F.col("x")).otherwise(new).alias("x"), F.when(~still, F.try_divide(change, size)).alias("change"), (~still).alias("moved"))
            after = after.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved"), F.max("change").alias("change")).select("id", "b", "x")
            x = written(after, "step", self.folder)
            got = seen.get
            if not got["moved"]:
                return x.select("id", "x")
            now = got["change"] or 0.0
            if k >= TRIAL and last is not None and not _ends(now, last, STEPS - k):
                return None
            last = now
        return None

    def _by_rounds(self, right: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        spark, paths, call = right.sparkSession, [], uuid.uuid4().hex
        right = written(right, "right", self.folder)
        for units, before in self.rounds:
            known = None
            if before:
                done = _values(spark.read.schema(SOLVED).parquet(*[paths[r] for r in before]))
                known = self.need.join(units, "unit", "left_semi").select("unit", F.col("col").alias("id")).join(done, "id")
            got = self._pass(right.join(units, "unit", "left_semi"), known, self.entries.join(units, "unit", "left_semi"))
            paths.append(f"{self.folder}/solved-{call}/{len(paths)}")
            got.write.parquet(paths[-1])
        solved = spark.read.schema(SOLVED).parquet(*paths)
        return _values(solved), [solved]


def _ends(now: float, last: float, steps: int) -> bool:
    """Whether a change that went from `last` to `now` in a step is at the rounding of a double after `steps` more."""
    if not 0 < now < float("inf"):
        return now == 0
    return now < last and log(now / ROUNDING) <= steps * log(last / now)


def _values(solved: DataFrame) -> DataFrame:
    return solved.select(F.explode(F.arrays_zip("ids", "x")).alias("v")).select(F.col("v.ids").alias("id"), F.col("v.x").alias("x"))


def _applied(table: pa.Table) -> pa.Table:
    """A unit's values: its own and what maps make of others'."""
    total = None
    for values, x in zip(table.column("values"), table.column("x"), strict=True):
        x = np.array(x.values)
        made = x if not values.is_valid else np.array(values.values).reshape(-1, len(x)) @ x
        total = made if total is None else total + made
    return pa.table({"unit": table.column("unit").slice(0, 1).cast(pa.int64()), "x": pa.array([total], pa.list_(pa.float64()))})


def _map_table(found: dict[tuple[int, int], tuple[int, np.ndarray]]) -> pa.Table:
    """Maps by (unit, of_unit), each with the number of its columns."""
    return pa.table(
        {
            "unit": pa.array([u for u, _ in found], pa.int64()), "of_unit": pa.array([v for _, v in found], pa.int64()), "inner": pa.array([n for n, _ in found.values()], pa.int32()),
            "values": pa.array([m.reshape(-1) for _, m in found.values()], pa.list_(pa.float64())),
        }
    )


def _composed(table: pa.Table) -> pa.Table:
    """The sum of products of maps that lead from one unit to another."""
    total = 0.0
    mid, inner = table.column("mid_inner").to_pylist(), table.column("inner")[0].as_py()
    for one, two, n in zip(table.column("one"), table.column("two"), mid, strict=True):
        total = total + np.array(one.values).reshape(-1, n) @ np.array(two.values).reshape(n, -1)
    unit, of_unit = (table.column(c)[0].as_py() for c in ("unit", "of_unit"))
    return _map_table({(unit, of_unit): (inner, total)})


def _closed(upper: bool) -> Callable[[pa.Table], pa.Table]:
    """The sum of all powers: a unit's map of another, and what leads there by units between."""

    def run(table: pa.Table) -> pa.Table:
        maps: dict[int, dict[int, np.ndarray]] = {}
        for u, v, n, m in zip(*(table.column(c).to_pylist() for c in ("unit", "of_unit", "inner")), table.column("values"), strict=True):
            maps.setdefault(u, {})[v] = np.array(m.values).reshape(-1, n)
        for u in sorted(maps, reverse=upper):  # all that a unit refers to is done
            whole = dict(maps[u])
            for w, m in maps[u].items():
                for v, rest in maps.get(w, {}).items():
                    whole[v] = m @ rest + (whole[v] if v in whole else 0.0)
            maps[u] = whole
        return _map_table({(u, v): (m.shape[1], m) for u, row in maps.items() for v, m in row.items()})

    return run


def _cut(n: int, num_blocks: int) -> tuple[Column, int]:
    """The unit of a permuted id, pieces of a block in order, and how many unit numbers there are."""
    size = max(LEAST_ROWS, min(MOST_ROWS, -(-n // UNITS)))
    pieces = -(-(-(-n // num_blocks)) // size)
    block = block_of("id", n, num_blocks).cast("long")
    start = F.expr(f"(cast((((id + 1) * {num_blocks}L - 1) div {n}L) as long) * {n}L) div {num_blocks}L")
    return block * pieces + F.floor((F.col("id") - start) / size), num_blocks * pieces


def _first_id(n: int, num_blocks: int) -> Column:
    """The first permuted id of a unit."""
    size = max(LEAST_ROWS, min(MOST_ROWS, -(-n // UNITS)))
    pieces = -(-(-(-n // num_blocks)) // size)
    return F.expr(f"((unit div {pieces}L) * {n}L) div {num_blocks}L + (unit % {pieces}L) * {size}L")


def _maps(triangle: Triangle, interface: DataFrame, links: DataFrame, count: int, total: int) -> Triangle:
    """The triangle with the powers of its maps or their sum; `total` ids are in interfaces."""
    upper, missing, folder = triangle.upper, triangle.missing_diag, triangle.folder
    # beside its entries a unit gets its own interface ids, and those of units that it needs
    own = interface.select(F.col("unit").alias("to"), F.col("unit").alias("of"), "ids")
    others = links.toDF("to", "of").join(interface.select(F.col("unit").alias("of"), "ids"), "of").select("to", "of", "ids")

    def spread(entries: pa.Table, sets: pa.Table) -> pa.Table:
        unit = sets.column("to")[0].as_py() if sets.num_rows else -1
        known = dict(zip(sets.column("of").to_pylist(), sets.column("ids").to_pylist(), strict=True))
        mine, needed = known.pop(unit, []), sorted(known)
        found: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        if mine and needed:
            at = {c: i for i, c in enumerate(c for v in needed for c in known[v])}
            lines = kernels.spread(kernels.rows_of(*_pairs_of(entries)), at, upper, missing)
            whole = np.stack([lines.get(i, np.zeros(len(at))) for i in mine])
            for v, part in zip(needed, np.split(whole, np.cumsum([len(known[v]) for v in needed])[:-1], axis=1), strict=True):
                if part.any():
                    found[unit, v] = part.shape[1], part
        return _map_table(found)

    latest = written(triangle.entries.groupBy("unit").cogroup(own.unionByName(others).groupBy("to")).applyInArrow(spread, MAPS), "maps", folder)
    made = replace(triangle, links=links, interface=interface)
    if total <= CLOSED:
        return replace(made, closure=written(latest.groupBy().applyInArrow(_closed(upper), MAPS), "closure", folder))
    powers: list[DataFrame] = []
    while 2 ** len(powers) < count and latest.limit(1).count():  # units are strictly ordered: the power of their number is 0
        powers.append(latest)
        if 2 ** len(powers) < count:
            one = latest.select("unit", F.col("of_unit").alias("mid"), F.col("inner").alias("mid_inner"), F.col("values").alias("one"))
            two = latest.select(F.col("unit").alias("mid"), "of_unit", "inner", F.col("values").alias("two"))
            latest = written(one.join(two, "mid").groupBy("unit", "of_unit").applyInArrow(_composed, MAPS), "maps", folder)
    return replace(made, maps=tuple(powers))


def _rounds(units: DataFrame, need: DataFrame) -> tuple[tuple[DataFrame, tuple[int, ...]], ...]:
    """Units in rounds, each with the rounds its needs come from.

    Where units refer to each other in few ways the driver orders them; else levels rise
    in Spark until none does, and a round may read all rounds before it.
    """
    pairs = need.select("unit", "of_unit").distinct()
    few = pairs.limit(DRIVER_PAIRS + 1).collect()
    if len(few) > DRIVER_PAIRS:
        level, changed = units.select("unit", F.lit(0).alias("level")), True
        while changed:
            least = pairs.join(level.select(F.col("unit").alias("of_unit"), "level"), "of_unit").groupBy("unit").agg((F.max("level") + 1).alias("after"))
            level = written(level.join(least, "unit", "left").select("unit", F.coalesce("after", F.lit(0)).alias("level"), (F.coalesce("after", F.lit(0)) > F.col("level")).alias("up")), "levels")
            changed = bool(level.where("up").limit(1).count())
        most = level.agg(F.max("level")).first()[0]
        return tuple((level.where(F.col("level") == k).select("unit"), tuple(range(k))) for k in range(most + 1))
    on: dict[int, set[int]] = {}
    for p in few:
        on.setdefault(p.unit, set()).add(p.of_unit)
    level: dict[int, int] = {}
    left = on.keys() | set().union(*on.values()) if on else set()
    while left:  # those whose needs are all placed
        ready = {u: 1 + max((level[v] for v in on.get(u, ())), default=-1) for u in left if on.get(u, set()) <= level.keys()}
        if not ready:
            raise ValueError("units need each other in a circle")
        level |= ready
        left -= ready.keys()
    rest = units.where(~F.col("unit").isin(list(level)))  # units without any link
    found = []
    for k in range(max(level.values(), default=0) + 1):
        mine = [u for u, x in level.items() if x == k]
        ready = units.where(F.col("unit").isin(mine))
        found.append((ready.union(rest) if k == 0 else ready, tuple(sorted({level[v] for u in mine for v in on.get(u, ())}))))
    return tuple(found)


def triangle(lu: DataFrame, perm: DataFrame, n: int, num_blocks: int, upper: bool, missing_diag: str, folder: str, by: str = "auto") -> Triangle:
    """What solves with one triangle of `lu` need, made once; by is "maps", "steps", "rounds" or "auto" (maps where they are small, else rounds of few units, else steps)."""
    inside = F.col("col") >= F.col("row") if upper else F.col("col") < F.col("row")
    own = lu.where(inside).select("row", "col", "val")
    if by in ("maps", "auto"):
        unit, count = _cut(n, num_blocks)
        unit_of = lambda df: df.withColumn("unit", unit)
        placed = unit_of(unit_of(own.withColumn("id", F.col("col"))).withColumnsRenamed({"unit": "of_unit"}).withColumn("id", F.col("row"))).drop("id")
        made = Triangle(upper, missing_diag, folder, unit_of, placed.drop("of_unit"))
        need = written(placed.where("unit <> of_unit").select("unit", "col", "of_unit").distinct(), "need", folder)
        ids = need.groupBy(F.col("of_unit").alias("unit")).agg(F.array_sort(F.collect_set("col")).alias("ids"))
        interface = written(ids.select("unit", "ids", F.transform("ids", lambda i: i - _first_id(n, num_blocks)).alias("places")), "interface", folder)
        q, total = interface.agg(F.coalesce(F.max(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
        if not q:
            return made
        links = written(need.select("unit", "of_unit").distinct(), "links", folder)
        rows = max(LEAST_ROWS, min(MOST_ROWS, -(-n // UNITS)))
        small = q * q <= MAP_VALUES
        if small and rows * (count - 1) * q > SPREAD_VALUES:
            small = rows * q * links.groupBy("unit").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] <= SPREAD_VALUES
        if by == "maps" or small:
            return _maps(made, interface, links, count, total)
    by_rounds = lambda: _in_rounds(own, perm, n, num_blocks, upper, missing_diag, folder)
    size = max(LEAST_ROWS, min(MOST_ROWS, -(-n // UNITS)))
    few = size >= ROUND_ROWS and 2 * num_blocks * -(-(-(-n // num_blocks)) // size) <= FEW_UNITS
    return by_rounds() if by == "rounds" or by == "auto" and few else _in_steps(own, perm, upper, missing_diag, folder, by_rounds)


def _in_steps(own: DataFrame, perm: DataFrame, upper: bool, missing_diag: str, folder: str, by_rounds: Callable[[], Triangle]) -> Triangle:
    """The entries off the diagonal over their row's pivot, dealt by column once and kept in the executors."""
    spark, pivots, step = own.sparkSession, None, own.where("row <> col")
    if upper:
        given = own.where("row = col").select("row", F.col("val").alias("d"))
        absent = 1.0 if missing_diag == "one" else 0.0
        pivots = written(perm.select(F.col("new_id").alias("row")).join(given, "row", "left").select("row", F.coalesce("d", F.lit(absent)).alias("d")), "pivots", folder)
        if zero := pivots.where("d = 0").head(1):
            raise ZeroDivisionError(f"the factors are singular: row {zero[0]['row']} has no pivot")
        step = step.join(pivots, "row").select("row", "col", (F.col("val") / F.col("d")).alias("val"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = step.select("row", "col", "val").repartition(parts, "col").persist()
    return Triangle(upper, missing_diag, folder, lambda df: df, own, step=kept, pivots=pivots, by_rounds=by_rounds)


def _in_rounds(own: DataFrame, perm: DataFrame, n: int, num_blocks: int, upper: bool, missing_diag: str, folder: str) -> Triangle:
    """Units of interior rows or separators only: interior rows of all blocks are one round."""
    size = max(LEAST_ROWS, min(MOST_ROWS, -(-n // UNITS)))
    pieces = -(-n // size) + 1
    piece = F.floor((F.col("new_id") - first_row("block", n, num_blocks)) / size)
    rows = written(perm.select(F.col("new_id").alias("id"), ((F.col("block") * 2 + F.col("is_sep").cast("int")) * pieces + piece).cast("long").alias("unit")), "units", folder)
    side = lambda c: rows.select(F.col("id").alias(c), F.col("unit").alias(f"{c}_unit"))
    placed = own.join(side("row"), "row").join(side("col"), "col")
    placed = written(placed.select(F.col("row_unit").alias("unit"), "row", "col", "val", F.col("col_unit").alias("of_unit")), "triangle", folder)
    need = written(placed.where("unit <> of_unit").select("unit", "col", "of_unit").distinct(), "need", folder)
    units = written(rows.select("unit").distinct(), "unit-numbers", folder)
    return Triangle(upper, missing_diag, folder, lambda df: df.join(rows, "id"), placed.drop("of_unit"), need=need, rounds=_rounds(units, need))
