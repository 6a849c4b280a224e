"""Registered queries over the star schema and events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.selection import medians
from .operators import blocks, verify
from .operators.factor import factorize
from .operators.matrix import SparseMatrix
from .plans import logs, runs
from .sources import generators
from .sources import mtx_source as mtx_source_
from .sources.mtx import read_mtx, write_mtx
from .sources.shared import new_path, table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- the part graph: parts that follow each other in an order -------------------------

_ADJ = """
pairs AS (
  SELECT a.l_partkey AS r, b.l_partkey AS c, -sum(b.l_quantity) AS v FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2
), sums AS (
  SELECT r, sum(abs(v)) AS s FROM pairs GROUP BY r
), adj AS (
  SELECT r, c, v FROM pairs
  UNION ALL SELECT p_partkey, p_partkey, coalesce(s, 0) + 1 FROM part LEFT JOIN sums ON r = p_partkey
), size AS (
  SELECT count(*) AS n FROM part
)"""
_P = 4


def _adj(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    return generators.part_adjacency(spark, sf_dir)


def _out(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("val").cast("long").alias("v"))


@query("adj_entries", f"WITH {_ADJ} SELECT r, c, CAST(v AS BIGINT) AS v FROM adj")
def adj_entries(spark, sf_dir):
    return _out(_adj(spark, sf_dir).entries)


@query("row_nnz", f"WITH {_ADJ} SELECT r, count(*) AS nnz FROM adj GROUP BY r")
def row_nnz(spark, sf_dir):
    return _adj(spark, sf_dir).row_counts().select(F.col("row").alias("r"), "nnz")


@query("abs_row_sum", f"WITH {_ADJ} SELECT r, CAST(sum(abs(v)) AS BIGINT) AS abs_sum, CAST(sum(CASE WHEN r <> c THEN abs(v) ELSE 0 END) AS BIGINT) AS off_sum FROM adj GROUP BY r")
def abs_row_sum(spark, sf_dir):
    return _adj(spark, sf_dir).row_sums().select(F.col("row").alias("r"), F.col("abs_sum").cast("long").alias("abs_sum"), F.col("off_sum").cast("long").alias("off_sum"))


@query("matrix_stats", f"""WITH {_ADJ}, rows_ AS (
  SELECT r, count(*) AS c, max(CASE WHEN r = c THEN abs(v) END) AS d, sum(CASE WHEN r <> c THEN abs(v) ELSE 0 END) AS o, max(abs(v)) AS m FROM adj GROUP BY r)
  SELECT CAST(n AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS nnz, CAST(max(m) AS BIGINT) AS max_abs, CAST(sum(CASE WHEN d <= o THEN 1 ELSE 0 END) AS BIGINT) AS not_dominant FROM rows_, size GROUP BY n""")
def matrix_stats(spark, sf_dir):
    return _adj(spark, sf_dir).stats().select("n", "nnz", F.col("max_abs").cast("long").alias("max_abs"), "not_dominant")


@query("row_pointers", f"WITH {_ADJ} SELECT r, CAST(sum(k) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) - k AS BIGINT) AS first FROM (SELECT r, count(*) AS k FROM adj GROUP BY r) t")
def row_pointers(spark, sf_dir):
    return _adj(spark, sf_dir).row_pointers().select(F.col("row").alias("r"), "first")


def _product_sql(r: str, c: str) -> str:
    return f"""WITH {_ADJ} SELECT p_partkey AS id, CAST(coalesce(x, 0) AS BIGINT) AS x FROM part
      LEFT JOIN (SELECT {r} AS k, sum(v * ({c} % 100)) AS x FROM adj GROUP BY 1) t ON k = p_partkey"""


def _hundreds(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", (F.col("id") % 100).cast("double").alias("x"))


@query("spmv", _product_sql("r", "c"))
def spmv(spark, sf_dir):
    a = _adj(spark, sf_dir)
    return a.times(_hundreds(spark, a.n)).select("id", F.col("x").cast("long").alias("x"))


@query("spmv_ordered", _product_sql("r", "c"))
def spmv_ordered(spark, sf_dir):
    a = _adj(spark, sf_dir)
    return a.times(_hundreds(spark, a.n), ordered=True).select("id", F.col("x").cast("long").alias("x"))


@query("spmv_transpose", _product_sql("c", "r"))
def spmv_transpose(spark, sf_dir):
    a = _adj(spark, sf_dir)
    return a.transpose().times(_hundreds(spark, a.n)).select("id", F.col("x").cast("long").alias("x"))


@query("tri_lower", f"WITH {_ADJ} SELECT r, c, CAST(v AS BIGINT) AS v FROM adj WHERE c < r")
def tri_lower(spark, sf_dir):
    return _out(_adj(spark, sf_dir).lower())


@query("tri_upper", f"WITH {_ADJ} SELECT r, c, CAST(v AS BIGINT) AS v FROM adj WHERE c >= r")
def tri_upper(spark, sf_dir):
    return _out(_adj(spark, sf_dir).upper())


@query("diag", f"WITH {_ADJ} SELECT r AS id, CAST(v AS BIGINT) AS x FROM adj WHERE c = r")
def diag(spark, sf_dir):
    return _adj(spark, sf_dir).diagonal().select("id", F.col("x").cast("long").alias("x"))


# ---- blocks ----------------------------------------------------------------------------

_BLOCKS = f"""blocks AS (
  SELECT p_partkey AS r, ((p_partkey + 1) * {_P} - 1) // n AS block FROM part, size
), classes AS (
  SELECT b.r, b.block, coalesce(min(c) < (b.block * n) // {_P}, false) AS is_sep FROM blocks b JOIN size ON true LEFT JOIN adj ON adj.r = b.r GROUP BY b.r, b.block, n
), perm AS (
  SELECT r AS old_id, CAST((block * n) // {_P} + row_number() OVER (PARTITION BY block ORDER BY is_sep, r) - 1 AS BIGINT) AS new_id, CAST(block AS INTEGER) AS block, is_sep FROM classes, size
)"""


@query("block_of_row", f"SELECT p_partkey AS id, CAST(((p_partkey + 1) * {_P} - 1) // (SELECT count(*) FROM part) AS INTEGER) AS block FROM part")
def block_of_row(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return parts.select("id", blocks.block_of("id", parts.count(), _P).alias("block"))


@query("block_sizes", f"WITH {_ADJ}, {_BLOCKS} SELECT CAST(block AS INTEGER) AS block, count(*) AS n_rows, CAST(sum(CASE WHEN is_sep THEN 1 ELSE 0 END) AS BIGINT) AS n_separators FROM classes GROUP BY block")
def block_sizes(spark, sf_dir):
    return blocks.classify(_adj(spark, sf_dir), _P).groupBy("block").agg(F.count("*").alias("n_rows"), F.sum(F.col("is_sep").cast("long")).alias("n_separators"))


@query("row_class", f"WITH {_ADJ}, {_BLOCKS} SELECT r, CAST(block AS INTEGER) AS block, is_sep FROM classes")
def row_class(spark, sf_dir):
    return blocks.classify(_adj(spark, sf_dir), _P).withColumnRenamed("row", "r")


@query("row_class_closure", f"""WITH RECURSIVE {_ADJ}, {_BLOCKS}, reached AS (
  SELECT r, block FROM classes WHERE is_sep
  UNION SELECT adj.r, reached.block FROM reached JOIN adj ON adj.c = reached.r AND adj.c < adj.r JOIN blocks b ON b.r = adj.r AND b.block = reached.block)
  SELECT c.r, CAST(c.block AS INTEGER) AS block, reached.r IS NOT NULL AS is_sep FROM classes c LEFT JOIN reached ON reached.r = c.r""")
def row_class_closure(spark, sf_dir):
    return blocks.classify(_adj(spark, sf_dir), _P, "closure").withColumnRenamed("row", "r")


def _perm(a: SparseMatrix) -> DataFrame:
    return blocks.permutation(blocks.classify(a, _P), a.n, _P)


@query("block_perm", f"WITH {_ADJ}, {_BLOCKS} SELECT old_id, new_id, block, is_sep FROM perm")
def block_perm(spark, sf_dir):
    return _perm(_adj(spark, sf_dir))


_PERMUTED = "SELECT pr.new_id AS r, pc.new_id AS c, CAST(v AS BIGINT) AS v, pr.block AS block FROM adj JOIN perm pr ON pr.old_id = adj.r JOIN perm pc ON pc.old_id = adj.c"


@query("permuted_entries", f"WITH {_ADJ}, {_BLOCKS} {_PERMUTED}")
def permuted_entries(spark, sf_dir):
    a = _adj(spark, sf_dir)
    found = blocks.permuted(a, _perm(a))
    return found.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("val").cast("long").alias("v"), "block")


@query("ghost_need", f"WITH {_ADJ}, {_BLOCKS}, moved AS ({_PERMUTED}) SELECT DISTINCT block, c FROM moved, size WHERE c < (block * n) // {_P}")
def ghost_need(spark, sf_dir):
    a = _adj(spark, sf_dir)
    return blocks.needs(blocks.permuted(a, _perm(a)), a.n, _P).withColumnRenamed("col", "c")


@query("ghost_need_upper", f"WITH {_ADJ}, {_BLOCKS}, moved AS ({_PERMUTED}) SELECT DISTINCT block, c FROM moved, size WHERE c >= ((block + 1) * n) // {_P}")
def ghost_need_upper(spark, sf_dir):
    a = _adj(spark, sf_dir)
    return blocks.needs(blocks.permuted(a, _perm(a)), a.n, _P, upper=True).withColumnRenamed("col", "c")


# ---- factorization ---------------------------------------------------------------------


def _how(p: int) -> str:
    """A single block isn't left to a single task."""
    return "entries" if p == 1 else "blocks"


def _round_trip(spark: SparkSession, sf_dir: str, p: int) -> DataFrame:
    a = _adj(spark, sf_dir)
    fact = factorize(a, p, method=_how(p))
    found = verify.round_trip(fact, _hundreds(spark, a.n))
    return found.select("id", F.round("back").cast("long").alias("x"))


def _rebuilt(spark: SparkSession, sf_dir: str, p: int) -> DataFrame:
    a = _adj(spark, sf_dir)
    return verify.reconstruct(factorize(a, p, method=_how(p)), a).select(F.col("row").alias("r"), F.col("col").alias("c"), F.round("made").cast("long").alias("v"))


for _p in (1, 4):
    query(f"ilu_roundtrip_p{_p}", "SELECT p_partkey AS id, p_partkey % 100 AS x FROM part")(lambda spark, sf_dir, p=_p: _round_trip(spark, sf_dir, p))
    query(f"ilu_reconstruct_p{_p}", f"WITH {_ADJ} SELECT r, c, CAST(v AS BIGINT) AS v FROM adj")(lambda spark, sf_dir, p=_p: _rebuilt(spark, sf_dir, p))


@query("ilu_multiply_p4", f"""WITH {_ADJ} SELECT p_partkey AS id, CAST(1 AS BIGINT) AS ok FROM part""")
def ilu_multiply_p4(spark, sf_dir):
    """multiply(solve(v)) against v: 1 where they agree to 1e-4."""
    a = _adj(spark, sf_dir)
    fact, v = factorize(a, _P), generators.test_vector(spark, a.n, "wave")
    back = fact.multiply(fact.solve(v)).withColumnRenamed("x", "y")
    return v.join(back, "id").select("id", (F.abs(F.col("x") - F.col("y")) < 1e-4).cast("long").alias("ok"))


@query("tridiag_pivots", """WITH RECURSIVE part_ AS (SELECT p_partkey AS id, 4.0 + p_size % 3 AS d FROM part), u AS (
  SELECT id, CAST(d AS DOUBLE) AS d FROM part_ WHERE id = 0
  UNION ALL SELECT p.id, p.d - 1.0 / u.d FROM u JOIN part_ p ON p.id = u.id + 1)
  SELECT id, CAST(round(u.d * 1e9) AS BIGINT) AS pivot_e9 FROM u""")
def tridiag_pivots(spark, sf_dir):
    fact = factorize(generators.part_chain(spark, sf_dir), 1, method="entries")
    return fact.pivots().select("id", F.round(F.col("pivot") * 1e9).cast("long").alias("pivot_e9"))


@query("ilu_round_trip", "SELECT p_partkey AS id, p_partkey % 100 AS x FROM part")
def ilu_round_trip(spark, sf_dir):
    """Four blocks, by entries: the factors don't depend on the size of the data or the cluster."""
    a = _adj(spark, sf_dir)
    found = verify.round_trip(factorize(a, _P, method="entries"), _hundreds(spark, a.n))
    return found.select("id", F.round("back").cast("long").alias("x"))


@query("tridiag_factor_p4", f"""WITH RECURSIVE size AS (SELECT count(*) AS n FROM part), p AS (
  SELECT p_partkey AS id, CAST(4 + p_size % 3 AS DOUBLE) AS a, ((p_partkey + 1) * {_P} - 1) // n AS block, p_partkey > 0 AND p_partkey = ((((p_partkey + 1) * {_P} - 1) // n) * n) // {_P} AS is_sep FROM part, size
), inner_ AS (
  SELECT id, a, row_number() OVER (ORDER BY id) = 1 OR lag(is_sep) OVER (ORDER BY id) AS head, is_sep FROM p
), u AS (
  SELECT id, a AS d FROM inner_ WHERE head AND NOT is_sep
  UNION ALL SELECT i.id, i.a - 1.0 / u.d FROM u JOIN inner_ i ON i.id = u.id + 1 AND NOT i.is_sep AND NOT i.head
), pivots AS (
  SELECT id, d FROM u UNION ALL SELECT p.id, p.a - 1.0 / l.d - 1.0 / r.d FROM p JOIN u l ON l.id = p.id - 1 JOIN u r ON r.id = p.id + 1 WHERE is_sep
), entries AS (
  SELECT id AS r, id AS c, d AS v FROM pivots
  UNION ALL SELECT p.id, p.id - 1, CASE WHEN q.is_sep THEN -1.0 ELSE -1.0 / d END FROM p JOIN p q ON q.id = p.id - 1 JOIN pivots ON pivots.id = q.id
  UNION ALL SELECT p.id, p.id + 1, CASE WHEN p.is_sep THEN -1.0 / d ELSE -1.0 END FROM p JOIN pivots ON pivots.id = p.id + 1)
  SELECT r, c, CAST(round(v * 1e9) AS BIGINT) AS v_e9 FROM entries""")
def tridiag_factor_p4(spark, sf_dir):
    """Raw factors over blocks: separators (a block's first rows) are eliminated by both neighbours."""
    found = factorize(generators.part_chain(spark, sf_dir), _P).unpermuted()
    return found.select(F.col("row").alias("r"), F.col("col").alias("c"), F.round(F.col("val") * 1e9).cast("long").alias("v_e9"))


_CHAIN = """size AS (SELECT count(*) AS n FROM part), adj AS (
  SELECT p_partkey AS r, p_partkey + d AS c FROM part, (VALUES (-1), (0), (1)) s(d), size WHERE p_partkey + d BETWEEN 0 AND n - 1
)"""


@query("ilu_sweep_count", f"""WITH RECURSIVE {_CHAIN}, {_BLOCKS}, deps AS (
  SELECT DISTINCT a.block AS block, b.block AS lower FROM adj JOIN classes a ON a.r = adj.r JOIN classes b ON b.r = adj.c WHERE a.is_sep AND b.is_sep AND b.block < a.block
), depth AS (
  SELECT DISTINCT block, 1 AS d FROM classes WHERE is_sep UNION SELECT deps.block, d + 1 FROM depth JOIN deps ON deps.lower = depth.block)
  SELECT {_P} AS num_blocks, CAST(coalesce(max(d), 0) + 1 AS INTEGER) AS sweeps FROM depth""")
def ilu_sweep_count(spark, sf_dir):
    """Of the chain: a sweep for each step of the longest chain of separators over blocks, and one that changes nothing."""
    sweeps = factorize(generators.part_chain(spark, sf_dir), _P).sweeps
    return spark.range(1).select(F.lit(_P).alias("num_blocks"), F.lit(sweeps).alias("sweeps"))


@query("ilu_split_p4", f"WITH {_ADJ}, {_BLOCKS} SELECT pr.new_id AS r, pc.new_id AS c, pc.new_id < pr.new_id AS lower FROM adj JOIN perm pr ON pr.old_id = adj.r JOIN perm pc ON pc.old_id = adj.c")
def ilu_split_p4(spark, sf_dir):
    """The pattern of the two triangular factors, in new ids."""
    low, up = factorize(_adj(spark, sf_dir), _P).split()
    return low.withColumn("lower", F.lit(True)).unionByName(up.withColumn("lower", F.lit(False))).select(F.col("row").alias("r"), F.col("col").alias("c"), "lower")


@query("ilu_sweeps")
def ilu_sweeps(spark, sf_dir):
    a = _adj(spark, sf_dir)
    found = {p: factorize(a, p).sweeps for p in (1, 4)}
    rows = ", ".join(f"({p}, {s})" for p, s in found.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(num_blocks, sweeps)")


#: Rounds of the oracle: values have long settled by then.
_ORACLE_ROUNDS = 40


def _settled_sql() -> str:
    """The fixed point of the factors, each round a table of its own."""
    parts = [f"""{_ADJ}, {_BLOCKS}, e0 AS MATERIALIZED (
  SELECT pr.new_id AS r, pc.new_id AS c, CAST(v AS DOUBLE) AS a, CAST(v AS DOUBLE) AS w FROM adj JOIN perm pr ON pr.old_id = adj.r JOIN perm pc ON pc.old_id = adj.c
), wedges AS MATERIALIZED (
  SELECT l.r AS i, u.c AS j, l.c AS k FROM e0 l JOIN e0 u ON u.r = l.c AND u.c > u.r JOIN e0 t ON t.r = l.r AND t.c = u.c WHERE l.c < l.r
)"""]
    for n in range(_ORACLE_ROUNDS):
        parts.append(f"""e{n + 1} AS MATERIALIZED (SELECT r, c, a, a - coalesce(s, 0) AS w FROM e{n} LEFT JOIN (
  SELECT i, j, sum(l.w * u.w / p.w) AS s FROM wedges JOIN e{n} l ON l.r = i AND l.c = k JOIN e{n} u ON u.r = k AND u.c = j JOIN e{n} p ON p.r = k AND p.c = k GROUP BY i, j) ON i = r AND j = c)""")
    return ", ".join(parts)


@query("ilu_factor_values", f"""WITH {_settled_sql()} SELECT pr.old_id AS r, pc.old_id AS c, CAST(round(1e3 * e.w / CASE WHEN e.c < e.r THEN p.w ELSE 1 END) AS BIGINT) AS v_e3
  FROM e{_ORACLE_ROUNDS} e JOIN e{_ORACLE_ROUNDS} p ON p.r = e.c AND p.c = e.c JOIN perm pr ON pr.new_id = e.r JOIN perm pc ON pc.new_id = e.c""")
def ilu_factor_values(spark, sf_dir):
    """Raw factors of the part graph over four blocks, by blocks and sweeps."""
    found = factorize(_adj(spark, sf_dir), _P).unpermuted()
    return found.select(F.col("row").alias("r"), F.col("col").alias("c"), F.round(F.col("val") * 1e3).cast("long").alias("v_e3"))


@query("ilu_entries_values", SQL["ilu_factor_values"])
def ilu_entries_values(spark, sf_dir):
    """The same by entries, as a fixed point of joins."""
    found = factorize(_adj(spark, sf_dir), _P, method="entries").unpermuted()
    return found.select(F.col("row").alias("r"), F.col("col").alias("c"), F.round(F.col("val") * 1e3).cast("long").alias("v_e3"))


# ---- generators, sized by the tables ---------------------------------------------------


def _side(spark: SparkSession, sf_dir: str, axes: int) -> int:
    """A grid side so that the grid has about as many points as there are parts."""
    return max(3, int(round(table(spark, sf_dir, "part").count() ** (1 / axes))))


def _grid(axes: int) -> str:
    """A row for each point of the grid, as many as there are."""
    side = "sqrt(count(*))" if axes == 2 else "pow(count(*), 1.0 / 3)"
    return f"""grid AS (SELECT k, unnest(range({" * ".join("k" * axes)})) AS id FROM (SELECT greatest(3, CAST(round({side}) AS BIGINT)) AS k FROM part) t)"""


_STEP2 = "(VALUES (-1, 0, 1.0), (1, 0, 1.0), (0, -1, 2.0), (0, 1, 2.0)) s(dy, dx, w)"


@query("lap2d", f"""WITH {_grid(2)}, g AS (SELECT k, id, id // k AS y, id % k AS x FROM grid),
  e AS (SELECT id AS r, (y + dy) * k + x + dx AS c, -1 AS v FROM g, {_STEP2} WHERE y + dy BETWEEN 0 AND k - 1 AND x + dx BETWEEN 0 AND k - 1)
  SELECT r, c, CAST(v AS BIGINT) AS v FROM e UNION ALL SELECT r, r, count(*) + 1 FROM e GROUP BY r""")
def lap2d(spark, sf_dir):
    k = _side(spark, sf_dir, 2)
    return _out(generators.laplacian(spark, (k, k), diag_shift=1.0).entries)


@query("lap3d", f"""WITH {_grid(3)}, g AS (SELECT k, id, id // (k * k) AS z, id // k % k AS y, id % k AS x FROM grid),
  s(dz, dy, dx) AS (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)),
  e AS (SELECT id AS r, ((z + dz) * k + y + dy) * k + x + dx AS c, -1 AS v FROM g, s WHERE z + dz BETWEEN 0 AND k - 1 AND y + dy BETWEEN 0 AND k - 1 AND x + dx BETWEEN 0 AND k - 1)
  SELECT r, c, CAST(v AS BIGINT) AS v FROM e UNION ALL SELECT r, r, count(*) FROM e GROUP BY r""")
def lap3d(spark, sf_dir):
    k = _side(spark, sf_dir, 3)
    return _out(generators.laplacian(spark, (k, k, k)).entries)


@query("lap_periodic", f"""WITH {_grid(2)}, g AS (SELECT k, id, id // k AS y, id % k AS x FROM grid),
  e AS (SELECT id AS r, (y + dy + k) % k * k + (x + dx + k) % k AS c FROM g, {_STEP2})
  SELECT r, c, CAST(-count(*) AS BIGINT) AS v FROM e GROUP BY r, c UNION ALL SELECT r, r, count(*) FROM e GROUP BY r""")
def lap_periodic(spark, sf_dir):
    k = _side(spark, sf_dir, 2)
    return _out(generators.laplacian(spark, (k, k), periodic=True).entries)


@query("lap_aniso", f"""WITH {_grid(2)}, g AS (SELECT k, id, id % k AS y, id // k AS x FROM grid),
  e AS (SELECT id AS r, y + dy + (x + dx) * k AS c, -w AS v FROM g, {_STEP2} WHERE y + dy BETWEEN 0 AND k - 1 AND x + dx BETWEEN 0 AND k - 1)
  SELECT r, c, CAST(v AS BIGINT) AS v FROM e UNION ALL SELECT r, r, CAST(sum(-v) AS BIGINT) FROM e GROUP BY r""")
def lap_aniso(spark, sf_dir):
    k = _side(spark, sf_dir, 2)
    return _out(generators.laplacian(spark, (k, k), axis_order=(1, 0), anisotropy=(1.0, 2.0)).entries)


@query("banded", """WITH size AS (SELECT count(*) AS n FROM part), d(d) AS (VALUES (0), (-1), (1), (-2), (2), (-16), (16))
  SELECT p_partkey AS r, p_partkey + d AS c, CASE WHEN d = 0 THEN 6100 ELSE -1000 END AS v FROM part, d, size WHERE p_partkey + d BETWEEN 0 AND n - 1""")
def banded(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    found = generators.banded(spark, n, 16).entries
    return found.select(F.col("row").alias("r"), F.col("col").alias("c"), F.round(F.col("val") * 1000).cast("int").alias("v"))


@query("random_dominant")
def random_dominant(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    return generators.random_dominant(spark, n, 8.0 / n, seed=7).entries.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("val").alias("v"))


@query("random_cells", "SELECT 8 * count(*) AS cells, 8 * count(*) AS different, true AS inside FROM part")
def random_cells(spark, sf_dir):
    """Cells drawn without repeats: exactly 8 for each part."""
    n = table(spark, sf_dir, "part").count()
    cells = generators.random_cells(spark, n, 8 * n, seed=7).groupBy("row", "col").agg(F.count("*").alias("k"))
    inside = F.min((F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)).cast("int")) == 1
    return cells.agg(F.sum("k").alias("cells"), F.count("*").alias("different"), inside.alias("inside"))


@query("row_class_closure_p1", "SELECT p_partkey AS r, CAST(0 AS INTEGER) AS block, false AS is_sep FROM part")
def row_class_closure_p1(spark, sf_dir):
    """One block has no row before it, so nothing depends on a separator."""
    return blocks.classify(_adj(spark, sf_dir), 1, "closure").withColumnRenamed("row", "r")


@query("random_dominant_rows", "SELECT p_partkey AS r, true AS inside, true AS few, true AS dominated, true AS again FROM part")
def random_dominant_rows(spark, sf_dir):
    """Of each row: values within bounds, few entries, a diagonal above the others' sum, and the same matrix again."""
    n = table(spark, sf_dir, "part").count()
    one, two = (generators.random_dominant(spark, n, 8.0 / n, seed=7).entries for _ in range(2))
    off = F.col("row") != F.col("col")
    rows = one.groupBy("row").agg(
        (F.max(F.when(off, F.abs("val")).otherwise(0.0)) < 100).alias("inside"), (F.count("*") <= 64).alias("few"),
        (F.sum(F.when(~off, F.col("val"))) > F.sum(F.when(off, F.abs("val")).otherwise(0.0))).alias("dominated"),
        F.bit_xor(F.xxhash64("col", "val")).alias("hash"),
    )
    same = two.groupBy("row").agg(F.bit_xor(F.xxhash64("col", "val")).alias("other"))
    return rows.join(same, "row").select(F.col("row").alias("r"), "inside", "few", "dominated", (F.col("hash") == F.col("other")).alias("again"))


# ---- files -----------------------------------------------------------------------------


@query("mtx_round_trip", f"WITH {_ADJ} SELECT r, c, CAST(v AS BIGINT) AS v FROM adj")
def mtx_round_trip(spark, sf_dir):
    """The part graph written as a MatrixMarket file of several parts and read back."""
    path = new_path(spark, "adj.mtx")
    write_mtx(_adj(spark, sf_dir), path)
    return _out(read_mtx(spark, path).entries)


@query("mtx_source", f"WITH {_ADJ} SELECT r, c, CAST(v AS BIGINT) AS v FROM adj, size WHERE r >= n // 4 AND c < n // 2")
def mtx_source(spark, sf_dir):
    """The part graph through format("mtx"): written with its entries counted at the commit, read back within bounds."""
    mtx_source_.register(spark)
    a, path = _adj(spark, sf_dir), new_path(spark, "adj.mtx")
    entries = written(a.entries, "entries")
    entries.write.format("mtx").option("n", a.n).option("entries", entries.count()).mode("append").save(path)
    return _out(spark.read.format("mtx").load(path).where((F.col("row") >= a.n // 4) & (F.col("col") < a.n // 2)))


@query("mtx_lines", f"""WITH {_ADJ} SELECT CAST(r + 1 AS VARCHAR) || ' ' || (c + 1) || ' ' || CAST(v AS BIGINT) || '.0' AS line FROM adj
  UNION ALL SELECT '%%MatrixMarket matrix coordinate real general' UNION ALL SELECT CAST(n AS VARCHAR) || ' ' || n || ' ' || (SELECT count(*) FROM adj) FROM size""")
def mtx_lines(spark, sf_dir):
    """The lines of that file."""
    path = new_path(spark, "adj.mtx")
    write_mtx(_adj(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# ---- benchmark logs: events as log lines -----------------------------------------------


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a log: views are matrix markers, the others timed phases."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    file = F.concat(F.lit("u"), F.col("user_id"), F.lit(".out"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marker = F.concat(F.lit(">> RUNNING_MATRIX=band_m"), F.col("event_id") % 5, F.lit(".mtx"))
    perf = F.concat(F.lit("PERF,phase="), F.col("event_type"), F.lit(",N=100,P="), F.col("user_id") % 4 + 1, F.lit(",time="), F.col("value"))
    body = events.select(file.alias("file"), F.row_number().over(order).alias("line_no"), F.when(F.col("event_type") == "view", marker).otherwise(perf).alias("value"))
    head = events.select(file.alias("file"), F.lit(0).alias("line_no"), F.concat(F.lit("WORKERS="), F.col("user_id") % 4 + 1).alias("value")).distinct()
    return body.unionByName(head)


_SAMPLES = """filled AS (
  SELECT user_id, event_type, value, event_id, coalesce('band_m' || CAST(last_value(CASE WHEN event_type = 'view' THEN event_id % 5 END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) || '.mtx', '<unknown>') AS matrix FROM events
), samples AS (
  SELECT 'u' || user_id || '.out' AS file, matrix, event_type AS phase, CAST(user_id % 4 + 1 AS INTEGER) AS workers, value AS time_s FROM filled WHERE event_type <> 'view'
), files AS (
  SELECT file, matrix, phase, workers, median(time_s) AS t, count(*) AS k FROM samples GROUP BY ALL
), summary AS (
  SELECT matrix, phase, workers, min(t) AS median_time_s, CAST(arg_max(k, file) AS BIGINT) AS n_repeats FROM files GROUP BY ALL
)"""


@query("marker_fill", f"WITH {_SAMPLES} SELECT file, matrix, phase, workers, time_s FROM samples")
def marker_fill(spark, sf_dir):
    return logs.samples(event_lines(spark, sf_dir)).select("file", "matrix", "phase", "workers", "time_s")


@query("phase_median", f"WITH {_SAMPLES} SELECT * FROM summary")
def phase_median(spark, sf_dir):
    rows = logs.summary(logs.samples(event_lines(spark, sf_dir)))
    return rows.select("matrix", "phase", "workers", "median_time_s", "n_repeats")


@query("file_medians", f"WITH {_SAMPLES} SELECT file, matrix, phase, workers, t AS median_time_s, k AS n_repeats FROM files")
def file_medians(spark, sf_dir):
    """Exact medians by order over the cluster: a configuration may have any number of samples."""
    keys = ["file", "matrix", "phase", "workers"]
    found = medians(logs.samples(event_lines(spark, sf_dir)), keys, "time_s", "median_time_s")
    return found.withColumnRenamed("n", "n_repeats")


_SPEEDUP = f"""{_SAMPLES}, base AS (
  SELECT matrix, CASE WHEN bool_or(workers = 1) THEN 1 ELSE min(workers) END AS base_workers FROM summary GROUP BY matrix
), gains AS (
  SELECT s.matrix, s.phase, s.workers, s.median_time_s, b.median_time_s / s.median_time_s AS speedup, (b.median_time_s / s.median_time_s) / (CAST(s.workers AS DOUBLE) / base_workers) AS efficiency
  FROM summary s JOIN base ON base.matrix = s.matrix LEFT JOIN summary b ON b.matrix = s.matrix AND b.phase = s.phase AND b.workers = base_workers
)"""


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.summary(logs.samples(event_lines(spark, sf_dir)))
    return logs.speedup(rows, 1, None)


@query("speedup", f"WITH {_SPEEDUP} SELECT matrix, phase, workers, CAST(round(speedup * 1e6) AS BIGINT) AS speedup FROM gains")
def speedup(spark, sf_dir):
    return _gains(spark, sf_dir).select("matrix", "phase", "workers", F.round(F.col("speedup") * 1e6).cast("long").alias("speedup"))


@query("efficiency", f"WITH {_SPEEDUP} SELECT matrix, phase, workers, CAST(round(efficiency * 1e6) AS BIGINT) AS efficiency FROM gains")
def efficiency(spark, sf_dir):
    return _gains(spark, sf_dir).select("matrix", "phase", "workers", F.round(F.col("efficiency") * 1e6).cast("long").alias("efficiency"))


@query("offset_order", f"""WITH {_SAMPLES} SELECT matrix, CAST(nullif(regexp_extract(matrix, '_m(\\d+)\\.mtx$', 1), '') AS BIGINT) AS off,
  CAST(row_number() OVER (ORDER BY regexp_extract(matrix, '_m(\\d+)\\.mtx$', 1) = '', TRY_CAST(regexp_extract(matrix, '_m(\\d+)\\.mtx$', 1) AS BIGINT), matrix) AS INTEGER) AS place
  FROM (SELECT DISTINCT matrix FROM samples) m""")
def offset_order(spark, sf_dir):
    names = logs.samples(event_lines(spark, sf_dir)).select("matrix").distinct().withColumn("off", logs.offset())
    return names.withColumn("place", F.row_number().over(Window.orderBy(F.col("off").isNull(), "off", "matrix")))


@query("log_issues", f"""WITH {_SAMPLES}, ranked AS (
  SELECT file, matrix, phase, workers, row_number() OVER (PARTITION BY matrix, phase, workers ORDER BY file) AS k FROM files)
  SELECT file, 'no PASSED line seen' AS message FROM (SELECT DISTINCT file FROM samples) s
  UNION ALL SELECT 'u' || user_id || '.out', 'no PERF lines found' FROM events GROUP BY user_id HAVING bool_and(event_type = 'view')
  UNION ALL SELECT file, 'duplicate result for ' || matrix || '/' || phase || ' at P=' || workers || ', keeping the faster one' FROM ranked WHERE k > 1""")
def log_issues(spark, sf_dir):
    return logs.issues(written(event_lines(spark, sf_dir), "lines"))


@query("strict_summary", f"""WITH {_SAMPLES} SELECT matrix, phase, workers AS ranks, CAST(100 AS BIGINT) AS n, median(time_s) AS median_time, count(*) AS n_samples
  FROM samples WHERE matrix <> '<unknown>' GROUP BY matrix, phase, workers""")
def strict_summary(spark, sf_dir):
    return logs.strict_summary(event_lines(spark, sf_dir)).select("matrix", "phase", "ranks", "n", "median_time", "n_samples")


# ---- reports ---------------------------------------------------------------------------

#: Phases that reports have columns for.
PHASES = ("click", "purchase", "signup")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.summary(logs.samples(event_lines(spark, sf_dir)))


def _cell_sql(phase: str) -> str:
    return f"coalesce(max(CASE WHEN phase = '{phase}' THEN printf('%.4f', median_time_s) || CASE WHEN n_repeats < 3 THEN '~' || n_repeats ELSE '' END END), '-')"


@query("report_by_matrix", f"""WITH {_SAMPLES} SELECT workers, matrix, CAST(nullif(regexp_extract(matrix, '_m(\\d+)\\.mtx$', 1), '') AS BIGINT) AS off,
  coalesce(nullif(regexp_extract(matrix, '_m(\\d+)\\.mtx$', 1), ''), matrix) AS label, {", ".join(f"{_cell_sql(p)} AS {p}" for p in PHASES)}
  FROM summary WHERE phase IN {PHASES} GROUP BY workers, matrix""")
def report_by_matrix(spark, sf_dir):
    """A row for each worker count and matrix; times of fewer than three repeats are marked."""
    return logs.by_matrix(_summary(spark, sf_dir), PHASES).select("workers", "matrix", F.col("offset").alias("off"), "label", *PHASES)


_REPORT_COLUMNS = ", ".join(
    f"coalesce(max(CASE WHEN phase = '{p}' THEN printf('%.4f', median_time_s) || CASE WHEN n_repeats < 3 THEN '~' || n_repeats ELSE '' END END), '-') AS {p}_time, "
    f"coalesce(max(CASE WHEN phase = '{p}' THEN printf('%.2fx', s) END), '-') AS {p}_speedup, coalesce(max(CASE WHEN phase = '{p}' THEN printf('%.0f%%', 100 * s / (CAST(workers AS DOUBLE) / base_workers)) END), '-') AS {p}_eff"
    for p in PHASES
)


@query("report_by_workers", f"""WITH {_SAMPLES}, chosen AS (SELECT * FROM summary WHERE phase IN {PHASES}), base AS (
  SELECT matrix, CASE WHEN bool_or(workers = 1) THEN 1 ELSE min(workers) END AS base_workers FROM chosen GROUP BY matrix
), gains AS (
  SELECT s.*, base_workers, b.median_time_s / s.median_time_s AS s FROM chosen s JOIN base ON base.matrix = s.matrix
  LEFT JOIN chosen b ON b.matrix = s.matrix AND b.phase = s.phase AND b.workers = base_workers
) SELECT matrix, workers, {_REPORT_COLUMNS} FROM gains GROUP BY matrix, workers""")
def report_by_workers(spark, sf_dir):
    """A row for each matrix and worker count: time, speedup and efficiency of each phase."""
    return logs.by_workers(_summary(spark, sf_dir), 1, PHASES)


@query("worker_counts", f"WITH {_SAMPLES} SELECT DISTINCT matrix, workers FROM summary")
def worker_counts(spark, sf_dir):
    return logs.worker_counts(_summary(spark, sf_dir))


@query("repetition_means", f"""WITH {_SAMPLES} SELECT matrix, phase, workers, CAST(round(avg(time_s) * 1e6) AS BIGINT) AS mean_e6, max(time_s) AS slowest_time_s, count(*) AS n_samples
  FROM samples GROUP BY ALL""")
def repetition_means(spark, sf_dir):
    """Mean and slowest of all repetitions."""
    rows = logs.repetitions(logs.samples(event_lines(spark, sf_dir)))
    return rows.select("matrix", "phase", "workers", F.round(F.col("mean_time_s") * 1e6).cast("long").alias("mean_e6"), "slowest_time_s", "n_samples")


@query("results_table", f"WITH {_SAMPLES} SELECT file, matrix, phase, workers, time_s FROM samples UNION ALL SELECT file, matrix, phase, workers, time_s FROM samples")
def results_table(spark, sf_dir):
    """Samples appended to a results table twice."""
    rows = logs.samples(event_lines(spark, sf_dir)).select("file", "matrix", "phase", "workers", "nodes", "n", "nnz", "time_s")
    path = new_path(spark, "results")
    for _ in range(2):
        runs.append(rows, path)
    return spark.read.parquet(path).select("file", "matrix", "phase", "workers", "time_s")


@query("strict_times", f"""WITH {_SAMPLES.replace("SELECT user_id, event_type, value, event_id,", "SELECT user_id, ts, event_type, value, event_id,").replace("value AS time_s FROM filled", "value AS time_s, ts, event_id FROM filled")}
  SELECT matrix, phase, workers AS ranks, string_agg(printf('%.6f', time_s), ';' ORDER BY file, ts, event_id) AS all_times FROM samples WHERE matrix <> '<unknown>' GROUP BY matrix, phase, workers""")
def strict_times(spark, sf_dir):
    """All times of a configuration in order of file and line."""
    return logs.strict_summary(event_lines(spark, sf_dir)).select("matrix", "phase", "ranks", "all_times")


def runtime_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a log of runtimes: clicks are reconstructions, purchases vector times, signups other lines."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase", "signup"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tail = F.concat(F.lit("_"), F.col("event_id") % 2 * 90 + 10, F.lit("_0.1="), F.format_string("%.2f", "value"))
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("RUNTIME_RECONSTRUCT"), tail)).when(F.col("event_type") == "purchase", F.concat(F.lit("RUNTIME_VECTOR"), tail)).otherwise("noise")
    file = F.concat(F.lit("u"), F.col("user_id"), F.lit(".out"))
    body = events.select(file.alias("file"), F.row_number().over(order).alias("line_no"), line.alias("value"))
    head = events.select(file.alias("file"), F.lit(0).alias("line_no"), F.concat(F.lit("Workers (MPI Ranks): "), F.col("user_id") % 4 + 1).alias("value")).distinct()
    return body.unionByName(head)


_RUNTIMES = """timed AS (
  SELECT user_id, event_type, event_id % 2 * 90 + 10 AS size, value, lag(event_type) OVER w AS last_type, lag(event_id % 2 * 90 + 10) OVER w AS last_size, lag(value) OVER w AS last_value
  FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), runtimes AS (
  SELECT CAST(user_id % 4 + 1 AS INTEGER) AS workers, CAST(size AS INTEGER) AS size, CAST(0.1 AS DOUBLE) AS density, CAST(round((value + last_value) * 1e6) AS BIGINT) AS runtime_e6
  FROM timed WHERE event_type = 'purchase' AND last_type = 'click' AND size = last_size
)"""


@query("runtime_pairs", f"WITH {_RUNTIMES} SELECT workers, size, density, runtime_e6 FROM runtimes")
def runtime_pairs(spark, sf_dir):
    """Reconstruction and vector times of neighbouring timing lines."""
    return logs.runtimes(runtime_lines(spark, sf_dir)).select("workers", "size", "density", F.round(F.col("runtime") * 1e6).cast("long").alias("runtime_e6"))


@query("runtime_means", f"WITH {_RUNTIMES} SELECT workers, size, density, CAST(round(avg(runtime_e6)) AS BIGINT) AS mean_e6, count(*) AS completed_tests FROM runtimes GROUP BY workers, size, density")
def runtime_means(spark, sf_dir):
    """Mean runtime and number of tests by size, density and workers."""
    rows = logs.runtime_summary(logs.runtimes(runtime_lines(spark, sf_dir)))
    return rows.select("workers", "size", "density", F.round(F.col("mean_runtime") * 1e6).cast("long").alias("mean_e6"), "completed_tests")


@query("test_vectors", """SELECT p_partkey AS id, CAST((p_partkey * a + 42) % n AS DOUBLE) AS permuted, CAST(p_partkey = 3 AS DOUBLE) AS unit, CAST(round((1 + 0.5 * sin(0.01 * p_partkey)) * 1e9) AS BIGINT) AS wave_e9
  FROM part, (SELECT n, min(a) AS a FROM (SELECT count(*) AS n FROM part) s, (SELECT unnest(range(1, 2 * count(*) + 9)) AS a FROM part) c WHERE a >= n // 2 + 1 AND gcd(a, n) = 1 GROUP BY n) t""")
def test_vectors(spark, sf_dir):
    """The vectors that checks use, side by side."""
    n = table(spark, sf_dir, "part").count()
    one, two, three = (generators.test_vector(spark, n, kind, unit=3) for kind in ("permutation", "unit", "wave"))
    both = one.withColumnRenamed("x", "permuted").join(two.withColumnRenamed("x", "unit"), "id").join(three, "id")
    return both.select("id", "permuted", "unit", F.round(F.col("x") * 1e9).cast("long").alias("wave_e9"))
