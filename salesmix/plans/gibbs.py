"""The two-level Gibbs sampler as a chain of small Spark jobs.

The facts are reduced once to per-group moments.  All random numbers are functions
of (seed, iteration, group), so the state of the chain is one row per h2, and the
per-group draws of any iteration can be rebuilt from that row and the moments.  An
iteration therefore writes only its h2 rows; draws go out in one job per block of
iterations, and a lost executor or a restart repeats the same numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed_random as rnd
from ..functions import linalg as la
from ..functions.arrays import upper_triangle
from ..operators import posterior as post
from ..operators.moments import vector_sum
from ..operators.relational import join_with_nulls
from ..sources.draws import filter_iteration, scan_draws, sink_draws

# Groups in a cell, the unit that an h2 state is sent to, and in a bucket of the moments.
CELL_GROUPS, BUCKET_GROUPS, MOST_BUCKETS = 4096, 16384, 100_000
STATE = ["h2", "n1", "n", "v_j", "w", "sigma", "mu", "mu_draw", "s2", "h"]


@dataclass(frozen=True)
class FitSpec:
    """Model settings: p coefficients per group, priors, and the random seed.

    ``prior_mean`` and ``prior_precision`` default to 0 and to a negligible 1e-6;
    ``df1`` to p + 1.  ``start`` is "ols" or "random".
    """

    p: int
    df1: int = 0
    prior_mean: list[float] = field(default_factory=list)
    prior_precision: list[float] = field(default_factory=list)
    deflator: float = 1.0
    seed: int = 1
    start: str = "ols"
    draw_every: int = 10

    def __post_init__(self):
        for name, value in (("df1", self.df1 or self.p + 1),
                            ("prior_mean", self.prior_mean or [0.0] * self.p),
                            ("prior_precision", self.prior_precision or [1e-6] * self.p)):
            object.__setattr__(self, name, value)
        post.check_dof(self.df1, self.p)
        if len(self.prior_mean) != self.p or len(self.prior_precision) != self.p:
            raise ValueError("priors need one value per coefficient")
        if self.start not in ("ols", "random"):
            raise ValueError("start must be 'ols' or 'random'")


def join_state_to_groups(stats: DataFrame, state: DataFrame) -> DataFrame:
    """Attach the h2 state to each group's moments."""
    return join_with_nulls(stats, state.select("h2", "w", "mu_draw", "h"), ["h2"])


def _level1_sums(joined: DataFrame, spec: FitSpec, iteration: int) -> DataFrame:
    """Per h2: [groups, rows, squared residuals, sum of b, triangle of deviations].

    Draws every group's coefficients and adds up, inside each Arrow batch, what the
    h2 level needs; only these partial sums are shuffled.
    """
    p = spec.p
    upper = np.triu_indices(p)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            xtx, xty = la.stack(c["xtx"], p, p), la.stack(c["xty"], p)
            mu = la.stack(c["mu_draw"], p)
            _, _, b = la.group_posterior(xtx, xty, la.stack(c["w"], p, p), mu,
                                         la.scalars(c["h"]), la.stack(c["z"], p))
            ssr = la.ssr_centred(la.scalars(c["n"]), la.stack(c["mean"], p),
                                 la.stack(c["centred"], p * (p + 1) // 2), b)
            dev = b - mu
            rows = np.column_stack([np.ones(len(b)), la.scalars(c["n"]), ssr, b,
                                    dev[:, upper[0]] * dev[:, upper[1]]])
            coded = c["h2"].dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            sums = np.add.reduceat(rows[order], starts, axis=0)
            names = coded.dictionary.take(pa.array(codes[order][starts]))
            yield pa.RecordBatch.from_arrays([names, la.list_array(sums)], names=["h2", "part"])

    key = post.group_key(spec.seed, iteration)
    rows = joined.select("h2", "n", "xtx", "xty", "mean", "centred", "w", "mu_draw", "h",
                         rnd.normals(key, p).alias("z"))
    h2 = joined.schema["h2"].dataType.simpleString()
    part = rows.mapInArrow(partials, f"h2 {h2}, part array<double>")
    return vector_sum(part, ["h2"], "part", 3 + p + p * (p + 1) // 2)


def _pooled_step(sums: DataFrame, spec: FitSpec, iteration: int) -> DataFrame:
    """Pooled deviations, precision, covariance, mean and draw from the summed groups."""
    p, dof = spec.p, spec.df1
    upper = np.triu_indices(p)
    mean, precision = np.asarray(spec.prior_mean), np.asarray(spec.prior_precision)

    @F.arrow_udf("struct<v_j:array<double>,w:array<double>,sigma:array<double>,"
                 "mu:array<double>,mu_draw:array<double>>")
    def step(total: pa.Array, z_w: pa.Array, z_mu: pa.Array) -> pa.Array:
        t = la.stack(total, 3 + p + len(upper[0]))
        v = np.zeros((len(t), p, p))
        v[:, upper[0], upper[1]] = t[:, 3 + p:]
        v[:, upper[1], upper[0]] = t[:, 3 + p:]
        v += p * np.eye(p)
        out = la.pooled(v, t[:, 0], t[:, 3:3 + p], la.stack(z_w, p, dof), la.stack(z_mu, p),
                        mean, precision, dof)
        return pa.StructArray.from_arrays([la.list_array(m) for m in (v, *out)],
                                          names=["v_j", "w", "sigma", "mu", "mu_draw"])

    z_w = rnd.normals(post.wishart_key(spec.seed, iteration), p * dof)
    z_mu = rnd.normals(post.pooled_key(spec.seed, iteration), p)
    return sums.select(
        "h2", F.expr("CAST(total[0] AS BIGINT)").alias("n1"),
        F.expr("CAST(total[1] AS BIGINT)").alias("n"), _s2(spec).alias("s2"),
        step("total", z_w, z_mu).alias("o")).select("h2", "n1", "n", "s2", "o.*")


def _s2(spec: FitSpec):
    return F.expr(f"total[2] / (total[1] / {float(spec.deflator)!r}D)")


def _with_noise(state: DataFrame, spec: FitSpec, iteration: int) -> DataFrame:
    return post.noise_precision_draw(state, spec.deflator, spec.seed, iteration).select(*STATE)


def _write_state(state: DataFrame, folder: str, iteration: int) -> DataFrame:
    path = f"{folder}/level2/iter={iteration}"
    state.write.mode("overwrite").parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """All h2 states written so far, with their iteration."""
    return spark.read.parquet(f"{folder}/level2")


def start_values(stats: DataFrame, spec: FitSpec) -> DataFrame:
    """Start coefficients per group, with those of their h2 beside them."""
    p = spec.p
    groups = stats.select("h2", "h1", "n")
    if spec.start == "random":
        beta_i = post.random_start_by_group(groups, ["h2", "h1"], p, spec.seed)
        beta_j = post.random_start_by_group(stats.select("h2").distinct(), ["h2"], p, spec.seed)
    else:
        beta_i = post.ols_by_group(stats, p).select("h2", "h1", "n", "beta")
        both = stats.select("h2", F.concat("xtx", "xty").alias("m"))
        pooled = vector_sum(both, ["h2"], "m", p * p + p).select(
            "h2", F.slice("total", 1, p * p).alias("xtx"),
            F.slice("total", p * p + 1, p).alias("xty"))
        beta_j = post.ols_by_group(pooled, p)
    return join_coef_levels(beta_i, beta_j)


def join_coef_levels(beta_i: DataFrame, beta_j: DataFrame) -> DataFrame:
    """Group coefficients with the coefficients of their h2."""
    return join_with_nulls(beta_i, beta_j.select("h2", F.col("beta").alias("beta_j")), ["h2"])


def _start_sums(start: DataFrame, spec: FitSpec) -> DataFrame:
    """The sums of ``_level1_sums`` for start values, deviations taken from beta_j."""
    p = spec.p
    diff = F.expr("zip_with(beta, beta_j, (b, m) -> b - m)")
    head = F.expr("concat(array(1D, CAST(n AS DOUBLE), 0D), beta)")
    rows = start.select("h2", head.alias("head"), diff.alias("diff")).select(
        "h2", F.concat("head", upper_triangle("diff", p)).alias("part"))
    return vector_sum(rows, ["h2"], "part", 3 + p + p * (p + 1) // 2)


def join_level2_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = join_with_nulls(out, table, ["h2"])
    return out


def _store_moments(stats: DataFrame, folder: str) -> None:
    """Write the moments in buckets of cells, and the cells of each h2.

    A cell holds about ``CELL_GROUPS`` groups of one h2, so a large h2 is many cells; its
    state is sent to each.  Iterations join on the cell, for which the moments lie ready.
    """
    spark = stats.sparkSession
    stats.write.mode("overwrite").parquet(f"{folder}/moments")
    stats = spark.read.schema(stats.schema).parquet(f"{folder}/moments")
    sizes = stats.groupBy("h2").agg(F.count(F.lit(1)).alias("groups"))
    chunks = F.ceil(F.col("groups") / CELL_GROUPS)
    pool = F.coalesce(F.concat(F.lit("="), F.col("h2").cast("string")), F.lit("null"))
    cells = sizes.select("h2", "groups", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), chunks.alias("chunks"))
    cells.select("h2", "groups", "chunks", F.concat_ws("|", "chunk", pool).alias("cell")).write.mode("overwrite").parquet(f"{folder}/cells")
    groups = stats.count()
    buckets = max(1, min(MOST_BUCKETS, -(-groups // BUCKET_GROUPS)))
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{folder}/layout")
    placed = join_with_nulls(stats, sizes.select("h2", chunks.alias("chunks")), ["h2"])
    chunk = F.pmod(F.xxhash64("h1"), F.col("chunks"))
    placed = placed.withColumn("cell", F.concat_ws("|", chunk, pool)).drop("chunks")
    name = _table_name(folder)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (placed.repartition(buckets, "cell").sortWithinPartitions("cell").write.mode("overwrite")
     .bucketBy(buckets, "cell").sortBy("cell").option("path", f"{folder}/stats").saveAsTable(name))


def _table_name(folder: str) -> str:
    return f"salesmix_moments_{hashlib.md5(folder.encode()).hexdigest()}"


@contextmanager
def _moments(spark: SparkSession, folder: str) -> Iterator[DataFrame]:
    """The stored moments with their buckets, which only a named table keeps; the name goes again."""
    name = _table_name(folder)
    if not spark.catalog.tableExists(name):
        plain = spark.read.parquet(f"{folder}/stats")
        buckets = spark.read.parquet(f"{folder}/layout").first().buckets
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cell) SORTED BY (cell) "
                  f"INTO {buckets} BUCKETS LOCATION '{folder}/stats'")
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay


def _in_cells(state: DataFrame, folder: str) -> DataFrame:
    """h2 rows repeated for each of their cells, without h2."""
    cells = state.sparkSession.read.parquet(f"{folder}/cells").select("h2", "cell")
    return join_with_nulls(cells, state, ["h2"]).drop("h2")


def _with_state(stats: DataFrame, state: DataFrame, folder: str) -> DataFrame:
    """``join_state_to_groups`` on the cells: the moments stay where they lie."""
    return stats.join(_in_cells(state.select("h2", "w", "mu_draw", "h"), folder), "cell")


def gibbs_init(stats: DataFrame, spec: FitSpec, folder: str) -> DataFrame:
    """Persist the moments, make iteration 1 and return its h2 state."""
    spark = stats.sparkSession
    _store_moments(stats, folder)
    with _moments(spark, folder) as stats:
        start = _start_sums(start_values(stats, spec), spec)
        _pooled_step(start, spec, 1).drop("s2").write.mode("overwrite").parquet(f"{folder}/start")
        pooled = spark.read.parquet(f"{folder}/start")

        first = _with_state(stats, pooled.withColumn("h", F.lit(1.0)), folder)
        s2 = _level1_sums(first, spec, 1).select("h2", _s2(spec).alias("s2"))
        state = _write_state(_with_noise(join_with_nulls(pooled, s2, ["h2"]), spec, 1), folder, 1)
        sink_draws(_level1_draws(stats, state.withColumn("iter", F.lit(1)), spec, folder, first=True),
                   f"{folder}/level1")
    return state


def _level1_draws(stats: DataFrame, states: DataFrame, spec: FitSpec, folder: str,
                  first: bool = False, covariance: bool = False) -> DataFrame:
    """Group means and draws that follow from the given h2 states.

    The draws of iteration s use the state of s - 1; those of iteration 1 use their
    own state and noise precision 1.
    """
    p = spec.p
    iteration, h = (F.col("iter"), F.lit(1.0)) if first else (F.col("iter") + 1, F.col("h"))
    state = states.select(iteration.cast("int").alias("iter"), "h2", "w", "mu_draw", h.alias("h"))
    names = ["mean", "draw"] + ["v_i"] * covariance

    @F.arrow_udf("struct<" + ",".join(f"{n}:array<double>" for n in names) + ">")
    def draw(xtx: pa.Array, xty: pa.Array, w: pa.Array, mu: pa.Array, h: pa.Array,
             z: pa.Array) -> pa.Array:
        cov, mean, b = la.group_posterior(
            la.stack(xtx, p, p), la.stack(xty, p), la.stack(w, p, p), la.stack(mu, p),
            la.scalars(h), la.stack(z, p))
        arrays = [la.list_array(m) for m in (mean, b, cov)[:len(names)]]
        return pa.StructArray.from_arrays(arrays, names=names)

    z = rnd.normals(post.group_key(spec.seed, "iter"), p)
    rows = stats.join(_in_cells(state, folder), "cell")
    return rows.select("iter", "h2", "h1",
                       draw("xtx", "xty", "w", "mu_draw", "h", z).alias("o")).select(
        "iter", "h2", "h1", "o.*")


def group_states(spark: SparkSession, folder: str, spec: FitSpec, first: int,
                 last: int, covariance: bool = False) -> DataFrame:
    """Rebuild group means, draws and, if asked, covariances of iterations >= 2."""
    return _group_states(spark.read.parquet(f"{folder}/stats"), folder, spec, first, last, covariance)


def _group_states(stats: DataFrame, folder: str, spec: FitSpec, first: int, last: int,
                  covariance: bool = False) -> DataFrame:
    states = scan_draws(stats.sparkSession, f"{folder}/level2", first - 1, last - 1)
    return _level1_draws(stats, states, spec, folder, covariance=covariance)


def gibbs_run(spark: SparkSession, folder: str, spec: FitSpec, begin: int, end: int) -> DataFrame:
    """Run iterations begin..end on the state in ``folder``; returns all draws so far.

    The chain may be continued later with begin = last iteration + 1.
    """
    if begin < 2:
        raise ValueError("iteration 1 is made by gibbs_init")
    state = filter_iteration(read_state(spark, folder), begin - 1)
    done = begin
    with _moments(spark, folder) as stats:
        for s in range(begin, end + 1):
            sums = _level1_sums(_with_state(stats, state, folder), spec, s)
            state = _write_state(_with_noise(_pooled_step(sums, spec, s), spec, s), folder, s)
            if s % spec.draw_every == 0 or s == end:
                sink_draws(_group_states(stats, folder, spec, done, s), f"{folder}/level1")
                done = s + 1
    return scan_draws(spark, f"{folder}/level1", last=end)
