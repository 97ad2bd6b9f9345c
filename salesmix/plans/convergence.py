"""From draws to a convergence report and to a model table for the sales reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geweke, scoring
from ..operators.moments import group_gram
from ..sources.draws import scan_draws
from .gibbs import FitSpec, gibbs_init, gibbs_run


def geweke_report(long: DataFrame, raw_iters: int, burn_in: int = 0) -> dict[str, DataFrame]:
    """Diagnostic per coefficient, and the share that looks non-stationary."""
    cd = geweke.geweke_cd(long, raw_iters, burn_in)
    return {"detail": cd, "share": geweke.geweke_share(cd)}


def update_draw_blocks(spark: SparkSession, folder: str, drivers: list[str], first: int, last: int,
                       size: int = geweke.BLOCK_ITERATIONS) -> None:
    """Store the statistics of the chain in ``folder`` for the blocks that ``first``..``last`` complete.

    Reads the new draws, and the few old ones of a block that was not complete before.
    """
    begin, end = (first - 1) // size * size + 1, last // size * size
    if begin > end:
        return
    draws = scan_draws(spark, f"{folder}/level1", begin, end)
    blocks = geweke.draw_blocks(geweke.explode_draws(draws, drivers), size)
    (blocks.hint("rebalance", F.col("block")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("block").parquet(f"{folder}/draw_blocks"))


def stored_geweke_report(spark: SparkSession, folder: str, drivers: list[str], raw_iters: int, burn_in: int = 0,
                         size: int = geweke.BLOCK_ITERATIONS) -> dict[str, DataFrame]:
    """``geweke_report`` of a stored chain from its draw blocks."""
    long = geweke.explode_draws(scan_draws(spark, f"{folder}/level1"), drivers)
    cd = geweke.geweke_from_blocks(spark.read.parquet(f"{folder}/draw_blocks"), long, raw_iters, burn_in, size)
    return {"detail": cd, "share": geweke.geweke_share(cd)}


def posterior_model(draws: DataFrame, p: int, burn_in: int = 0, shift: float = 0.0) -> DataFrame:
    """Model table (dept, type, coef): mean of the draws after burn-in.

    ``shift`` is what the moments took from the response; it goes back to the intercept.
    """
    kept = draws.where(F.col("iter") > burn_in)
    means = F.array(F.avg(F.col("draw")[0]) + F.lit(float(shift)),
                    *[F.avg(F.col("draw")[i]) for i in range(1, p)])
    return kept.groupBy(F.col("h2").alias("dept"), F.col("h1").alias("type")).agg(
        means.alias("coef"))


def model_rows(facts: DataFrame) -> DataFrame:
    """Weekly facts as hierarchy rows: dept pools its types."""
    rows = scoring.drop_null_rows(scoring.log1p_transform(facts))
    return rows.withColumnsRenamed({"dept": "h2", "type": "h1"})


def fit_demand_model(facts: DataFrame, folder: str, iterations: int = 20, burn_in: int = 10,
                     seed: int = 1) -> DataFrame:
    """Fit the sampler on weekly facts and return the model table the reports use."""
    stats = group_gram(model_rows(facts), "blended_units_total_log", scoring.DRIVERS)
    spec = FitSpec(p=len(scoring.COEF_ORDER), seed=seed)
    gibbs_init(stats, spec, folder)
    draws = gibbs_run(facts.sparkSession, folder, spec, 2, iterations)
    return posterior_model(draws, spec.p, burn_in)
