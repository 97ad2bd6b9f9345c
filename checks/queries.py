"""One Spark query per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmix.functions import arrays as arr
from salesmix.functions import calendar as cal
from salesmix.operators import decomposition as dec
from salesmix.operators import geweke as gw
from salesmix.operators import moments as mom
from salesmix.operators import posterior as post
from salesmix.operators import relational as rel
from salesmix.operators import scenario as scn
from salesmix.operators import scoring as sc
from salesmix.operators import weekly as wk
from salesmix.plans import convergence as conv
from salesmix.plans import gibbs
from salesmix.plans import reports as rep
from salesmix.session import stored, tune, work_dir
from salesmix.sources import draws as store
from salesmix.sources import retail
from salesmix.sources import tables as src

from . import settings as S

GROUP = ["h2", "h1"]
PRODUCT = sc.PRODUCT
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def fixed(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded off the .5 boundary, counts widened, dates as text: one form for
    comparing engines."""
    step = S.EPS * 10.0 ** -digits
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + F.lit(step), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, digits: int = 4):
    """Register a query under its operator name."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fixed(fn(tune(spark), sf_dir), digits)
        REGISTRY[name] = run
        return fn
    return wrap


def spread(df: DataFrame, column: str, p: int, name: str | None = None,
           square: bool = False) -> DataFrame:
    """An array column as scalar columns."""
    name = name or column
    keep = [c for c in df.columns if c != column]
    if square:
        cells = [F.col(column)[i * p + j].alias(f"{name}{i}{j}")
                 for i in range(p) for j in range(p)]
    else:
        cells = [F.col(column)[i].alias(f"{name}{i}") for i in range(p)]
    return df.select(*keep, *cells)


def facts_of(spark, sf_dir, start=None, end=None):
    return retail.weekly_facts(spark, sf_dir, start, end)


def plain_prices(spark, sf_dir):
    return wk.carry_forward_price(facts_of(spark, sf_dir))


def transformed(spark, sf_dir):
    return sc.drop_null_rows(sc.log1p_transform(facts_of(spark, sf_dir)))


def modelled(spark, sf_dir):
    """Transformed facts with the stand-in model; the fact join is computed once."""
    facts = stored(facts_of(spark, sf_dir), "facts")
    return sc.join_model(sc.drop_null_rows(sc.log1p_transform(facts)), retail.demand_model(facts))


def scored(spark, sf_dir, rounded=False):
    return sc.dot_score(modelled(spark, sf_dir), rounded)


def lines2(spark, sf_dir):
    return retail.hier_lines(spark, sf_dir)


def stats2(spark, sf_dir):
    return mom.group_gram(lines2(spark, sf_dir), "y1", ["x1"])


SPEC2 = gibbs.FitSpec(**S.P2)


def first_pooled(stats):
    """The first pooled draw, one operator at a time; the sampler does this in one pass."""
    start = stored(gibbs.start_values(stats, SPEC2), "start")
    v = mom.sum_outer_products(start, "beta", "beta_j", 2)
    total = mom.sum_vectors(start, "beta", 2).withColumnRenamed("sum_beta", "sum_b")
    sizes = start.groupBy("h2").agg(F.count(F.lit(1)).alias("n1"))
    pooled = gibbs.join_level2_tables(v, total, sizes)
    pooled = post.wishart_draw_by_group(pooled, 2, SPEC2.df1, SPEC2.seed, 1)
    pooled = post.pooled_covariance(pooled, 2, SPEC2.prior_precision)
    pooled = post.pooled_mean(pooled, 2, SPEC2.prior_mean, SPEC2.prior_precision)
    return post.pooled_draw(pooled, 2, SPEC2.prior_precision, SPEC2.seed, 1)


def pooled2(spark, sf_dir):
    return first_pooled(stats2(spark, sf_dir))


def grouped2(spark, sf_dir):
    """Moments with the first pooled state and noise precision 1."""
    stats = stored(stats2(spark, sf_dir), "stats")
    pooled = first_pooled(stats)
    return gibbs.join_state_to_groups(stats, pooled.withColumn("h", F.lit(1.0)))


def posterior2(spark, sf_dir):
    rows = post.group_covariance(grouped2(spark, sf_dir), 2)
    return post.group_draw(post.group_mean(rows, 2), 2, SPEC2.seed, 1)


def fixed_draws(df):
    return df.select(*GROUP).distinct().withColumn("draw", F.array(*[F.lit(b) for b in S.FIXED_B]))


def chains(spark, sf_dir):
    d = retail.event_draws(spark, sf_dir)
    return d.withColumn("driver", F.lit("value"))


# ---- sources and sinks -------------------------------------------------------

def _hier_file(spark, sf_dir):
    path = work_dir(spark, "hier-csv")
    rows = lines2(spark, sf_dir).select("index", "h1", "h2", "week", "y1", "x1", "x2", "x3")
    rows.write.option("header", True).option("quoteAll", True).csv(path)
    return src.scan_hier_csv(spark, path, n_drivers=3)


@query("scan_hier_csv")
def scan_hier_csv(spark, sf_dir):
    return _hier_file(spark, sf_dir).groupBy(*GROUP).agg(
        F.count("index").alias("n"), F.min("week").alias("first_week"),
        F.max("week").alias("last_week"), F.sum("y1").alias("y1"), F.sum("x1").alias("x1"))


@query("split_fields")
def split_fields(spark, sf_dir):
    d = _hier_file(spark, sf_dir)
    return d.groupBy("h2").agg(
        F.sum("index").alias("index_sum"), F.count_distinct("h1").alias("h1_values"),
        F.count("week").alias("weeks"), *[F.sum(c).alias(c) for c in ("y1", "x1", "x2", "x3")])


@query("scan_table", digits=2)
def scan_table(spark, sf_dir):
    return src.scan_table(spark, f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))


def hand_levers(spark):
    rows = src.load_local_rows(
        spark, S.LEVERS, "week string, num_colors double, price double, promo_pct double, "
                         "redline_pct double")
    return rows.withColumn("week", F.to_date("week"))


@query("load_local_rows")
def load_local_rows(spark, sf_dir):
    levers = hand_levers(spark)
    sold = facts_of(spark, sf_dir).groupBy("week").agg(
        F.sum("blended_units_total").alias("units"))
    return levers.join(sold, "week", "left")


@query("sink_draws")
def sink_draws(spark, sf_dir):
    path = work_dir(spark, "draws")
    draws = retail.event_draws(spark, sf_dir)
    store.sink_draws(draws, path)
    store.sink_draws(draws.where(F.col("iter") > 20), path)
    return store.scan_draws(spark, path).groupBy("iter").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("draw").alias("total"))


@query("scan_draws")
def scan_draws(spark, sf_dir):
    path = work_dir(spark, "draws")
    store.sink_draws(retail.event_draws(spark, sf_dir), path)
    return store.scan_draws(spark, path, first=11, last=20).groupBy("h2").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("draw").alias("mean"))


@query("fetch_rows")
def fetch_rows(spark, sf_dir):
    products = facts_of(spark, sf_dir).groupBy(*PRODUCT).agg(
        F.sum("blended_units_total").alias("units"))
    return src.fetch_rows(products.orderBy(*PRODUCT), 100)


@query("guard_nonempty")
def guard_nonempty(spark, sf_dir):
    dept, type_ = S.PRODUCT
    chosen = rel.filter_product(facts_of(spark, sf_dir), dept, type_)
    return rel.count_rows(src.guard_nonempty(chosen))


# ---- projections and filters -------------------------------------------------

@query("project_rename")
def project_rename(spark, sf_dir):
    return rel.project_rename(facts_of(spark, sf_dir), {
        "dept": "department", "type": "store", "week": "week",
        "blended_units_total": "units", "price": "avg_price"})


@query("choose_price_column")
def choose_price_column(spark, sf_dir):
    facts = plain_prices(spark, sf_dir)
    both = [facts.select(*PRODUCT, "week", F.lit(smooth).alias("smooth"),
                         rel.choose_price_column("promo_redline", smooth))
            for smooth in (True, False)]
    return both[0].unionByName(both[1])


@query("filter_eq_or_all")
def filter_eq_or_all(spark, sf_dir):
    facts = rel.filter_eq_or_all(facts_of(spark, sf_dir), dept=rel.ALL, type=S.PRODUCT[1])
    return facts.groupBy(*PRODUCT).agg(F.sum("blended_units_total").alias("units"))


@query("filter_product")
def filter_product(spark, sf_dir):
    return rel.filter_product(facts_of(spark, sf_dir), *S.PRODUCT).select(
        *PRODUCT, "week", "blended_units_total", "price")


@query("filter_week_range")
def filter_week_range(spark, sf_dir):
    facts = rel.filter_week_range(facts_of(spark, sf_dir, *S.HISTORY), *S.HISTORY)
    return facts.select(*PRODUCT, "week", "blended_units_total")


@query("drop_null_rows")
def drop_null_rows(spark, sf_dir):
    columns = ["promo_price_total", "promo_price_redline"]
    return sc.drop_null_rows(facts_of(spark, sf_dir), columns).select(*PRODUCT, "week", *columns)


@query("filter_iteration")
def filter_iteration(spark, sf_dir):
    return store.filter_iteration(retail.event_draws(spark, sf_dir), 7)


@query("filter_draw_head")
def filter_draw_head(spark, sf_dir):
    return gw.filter_draw_head(chains(spark, sf_dir), S.RAW_ITERS, S.BURN_IN)


@query("filter_draw_tail")
def filter_draw_tail(spark, sf_dir):
    return gw.filter_draw_tail(chains(spark, sf_dir), S.RAW_ITERS, S.BURN_IN)


@query("filter_significant")
def filter_significant(spark, sf_dir):
    return gw.filter_significant(gw.geweke_cd(chains(spark, sf_dir), S.RAW_ITERS, S.BURN_IN))


@query("filter_small_parts")
def filter_small_parts(spark, sf_dir):
    return dec.filter_small_parts(_long_parts(spark, sf_dir))


@query("key_by")
def key_by(spark, sf_dir):
    keyed = rel.key_by(facts_of(spark, sf_dir), "dept", "type", "quarter")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).select("key.*", "rows")


# ---- joins -------------------------------------------------------------------

@query("cogroup_by_key")
def cogroup_by_key(spark, sf_dir):
    customer = src.scan_table(spark, f"{sf_dir}/customer.parquet").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    supplier = src.scan_table(spark, f"{sf_dir}/supplier.parquet").select(
        F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    both = rel.cogroup_by_key(customer, supplier, "nation", "id", chunk_rows=64)
    return both.groupBy("nation").agg(
        F.sum(F.size("left_values")).alias("customers"),
        F.sum(F.size("right_values")).alias("suppliers"),
        F.sum(F.aggregate("left_values", F.lit(0).cast("bigint"), lambda a, x: a + x))
        .alias("customer_ids"),
        F.sum(F.aggregate("right_values", F.lit(0).cast("bigint"), lambda a, x: a + x))
        .alias("supplier_ids"),
        F.max(F.array_max("left_values")).alias("last_customer"))


@query("join_coef_levels", digits=6)
def join_coef_levels(spark, sf_dir):
    start = gibbs.start_values(stored(stats2(spark, sf_dir), "stats"), SPEC2)
    return spread(spread(start, "beta", 2, "b"), "beta_j", 2, "m").drop("n")


@query("join_state_to_groups", digits=6)
def join_state_to_groups(spark, sf_dir):
    df = grouped2(spark, sf_dir).select(*GROUP, "n", "h", "w", "mu_draw")
    return spread(spread(df, "w", 2, square=True), "mu_draw", 2, "mu")


@query("join_groups_by_key", digits=6)
def join_groups_by_key(spark, sf_dir):
    stats = stored(stats2(spark, sf_dir), "stats").select(*GROUP, "n", "yty")
    draws = fixed_draws(stats)
    return spread(rel.join_groups_by_key(stats, draws), "draw", 2, "b")


@query("join_level2_tables")
def join_level2_tables(spark, sf_dir):
    d = stored(lines2(spark, sf_dir).select(*GROUP), "lines")
    return gibbs.join_level2_tables(mom.rows_per_level2(d), mom.child_count(d))


@query("join_count_lookup")
def join_count_lookup(spark, sf_dir):
    d = stored(lines2(spark, sf_dir).select(*GROUP, "y1"), "lines")
    groups = d.groupBy(*GROUP).agg(F.sum("y1").alias("y_sum"))
    return rel.join_count_lookup(groups, mom.rows_per_level2(d))


@query("join_geweke_parts", digits=6)
def join_geweke_parts(spark, sf_dir):
    return gw.join_geweke_parts(chains(spark, sf_dir), S.RAW_ITERS, S.BURN_IN)


@query("join_model")
def join_model(spark, sf_dir):
    rows = modelled(spark, sf_dir)
    return spread(rows.select(*PRODUCT, "week", "price_log", "coef"), "coef", 11, "c")


@query("left_join_model_pred")
def left_join_model_pred(spark, sf_dir):
    facts = stored(facts_of(spark, sf_dir), "facts")
    rows = sc.drop_null_rows(sc.log1p_transform(facts))
    model = retail.demand_model(facts).where(retail.gender_of(F.col("dept")) == "F")
    pred = sc.dot_score(sc.join_model(scn.last_year(rows, *S.SCENARIO), model))
    both = sc.left_join_model_pred(rows, model, pred)
    return both.select(*PRODUCT, "week", "y", "y_hat", F.col("coef")[0].alias("intercept"))


@query("join_year_over_year")
def join_year_over_year(spark, sf_dir):
    s = stored(scored(spark, sf_dir, rounded=True), "scored")
    return scn.join_year_over_year(s, s)


@query("align_by_position")
def align_by_position(spark, sf_dir):
    facts = _past_facts(spark, sf_dir)
    return scn.align_by_position(facts, *S.SCENARIO).select(
        *PRODUCT, "pos", "week", "old_week", *sc.DRIVERS_PLANNED)


# ---- aggregations ------------------------------------------------------------

@query("group_design_matrix")
def group_design_matrix(spark, sf_dir):
    blocks = mom.group_design_matrix(lines2(spark, sf_dir), "y1", ["x1", "x2", "x3"],
                                     chunk_rows=512)
    rows = F.arrays_zip("x_rows", "y", "copies")

    def total(f):
        return F.aggregate(rows, F.lit(0.0), lambda a, r: a + f(r))

    x = [total(lambda r, i=i: r["x_rows"][i] * r["copies"]) for i in range(4)]
    sums = blocks.select(
        *GROUP, F.size("y").alias("distinct_rows"), *[x[i].alias(f"x{i}") for i in range(4)],
        total(lambda r: r["y"] * r["copies"]).alias("y"),
        total(lambda r: r["y"] * r["x_rows"][1] * r["copies"]).alias("xy"))
    return sums.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in sums.columns[2:]])


@query("group_gram")
def group_gram(spark, sf_dir):
    stats = mom.group_gram(lines2(spark, sf_dir), "y1", ["x1", "x2", "x3"])
    return spread(spread(stats.drop("mean", "centred"), "xtx", 4, square=True), "xty", 4)


@query("group_gram_weekly")
def group_gram_weekly(spark, sf_dir):
    rows = conv.model_rows(facts_of(spark, sf_dir))
    stats = mom.group_gram(rows, "blended_units_total_log", sc.DRIVERS)
    return spread(spread(stats.drop("mean", "centred"), "xtx", 11, square=True), "xty", 11)


@query("child_count")
def child_count(spark, sf_dir):
    return mom.child_count(lines2(spark, sf_dir))


@query("rows_per_level2")
def rows_per_level2(spark, sf_dir):
    return mom.rows_per_level2(lines2(spark, sf_dir))


@query("sum_vectors")
def sum_vectors(spark, sf_dir):
    rows = lines2(spark, sf_dir).select("h2", F.array("x1", "x2", "x3").alias("v"))
    return spread(mom.sum_vectors(rows, "v", 3), "sum_v", 3, "v")


@query("sum_outer_products")
def sum_outer_products(spark, sf_dir):
    mean = F.array(F.lit(25.0), F.lit(0.05), F.lit(0.04))
    rows = lines2(spark, sf_dir).select("h2", F.array("x1", "x2", "x3").alias("v"),
                                        mean.alias("m"))
    return spread(mom.sum_outer_products(rows, "v", "m", 3), "v_j", 3, square=True)


@query("group_ssr")
def group_ssr(spark, sf_dir):
    stats = stored(stats2(spark, sf_dir), "stats")
    return mom.group_ssr(stats, fixed_draws(stats), 2)


@query("level2_s2", digits=6)
def level2_s2(spark, sf_dir):
    d = stored(lines2(spark, sf_dir).select(*GROUP, "y1", "x1"), "lines")
    ssr = mom.group_ssr_rows(d, fixed_draws(d), "y1", ["x1"])
    return mom.level2_s2(ssr, deflator=2.0)


@query("geweke_head", digits=6)
def geweke_head(spark, sf_dir):
    return gw.geweke_head(chains(spark, sf_dir), S.RAW_ITERS, S.BURN_IN)


@query("geweke_tail", digits=6)
def geweke_tail(spark, sf_dir):
    return gw.geweke_tail(chains(spark, sf_dir), S.RAW_ITERS, S.BURN_IN)


@query("geweke_cd", digits=6)
def geweke_cd(spark, sf_dir):
    return gw.geweke_cd(chains(spark, sf_dir), S.RAW_ITERS, S.BURN_IN)


@query("geweke_share", digits=6)
def geweke_share(spark, sf_dir):
    return gw.geweke_share(gw.geweke_cd(chains(spark, sf_dir), S.RAW_ITERS, S.BURN_IN))


@query("count_rows")
def count_rows(spark, sf_dir):
    return rel.count_rows(facts_of(spark, sf_dir))


@query("median_of")
def median_of(spark, sf_dir):
    return rel.median_of(retail.sales_lines(spark, sf_dir), PRODUCT, "amount")


@query("weekly_units")
def weekly_units(spark, sf_dir):
    return wk.weekly_units(facts_of(spark, sf_dir), *wk.measure_names())


@query("weekly_price")
def weekly_price(spark, sf_dir):
    return wk.weekly_price(plain_prices(spark, sf_dir), *wk.measure_names(), smooth=False)


@query("price_bounds")
def price_bounds(spark, sf_dir):
    return wk.price_bounds(plain_prices(spark, sf_dir), *wk.measure_names())


@query("weekly_units_by_flag")
def weekly_units_by_flag(spark, sf_dir):
    return wk.weekly_units_by_flag(facts_of(spark, sf_dir))


@query("period_bounds")
def period_bounds(spark, sf_dir):
    return wk.period_bounds(facts_of(spark, sf_dir), "brand", "dept", "type")


@query("decomp_sums")
def decomp_sums(spark, sf_dir):
    return dec.decomp_sums(sc.raw_decomps(scored(spark, sf_dir)), "month")


def _history(spark, sf_dir, period):
    facts = stored(facts_of(spark, sf_dir), "facts")
    return rep.historic_decomposition(facts, retail.demand_model(facts), period)


@query("decomp_regroup")
def decomp_regroup(spark, sf_dir):
    return dec.decomp_regroup(_history(spark, sf_dir, "all")["corrected"])


def _past_facts(spark, sf_dir):
    """Facts of the weeks a scenario is laid over."""
    return stored(facts_of(spark, sf_dir, *cal.old_week_bounds(*S.SCENARIO)), "facts")


def _scenario(spark, sf_dir):
    facts = _past_facts(spark, sf_dir)
    levers = rep.default_levers(facts, *S.SCENARIO)
    levers = scn.shift_driver(levers, "price", S.PRICE_SHIFT)
    levers = scn.shift_driver(levers, "promo_pct", S.PROMO_SHIFT)
    both = rep.whatif_predict(facts, retail.demand_model(facts), levers, *S.SCENARIO)
    return {name: stored(df, name) for name, df in both.items()}


@query("scenario_comparison")
def scenario_comparison(spark, sf_dir):
    return scn.scenario_comparison(**_scenario(spark, sf_dir))


@query("week_correspondence")
def week_correspondence(spark, sf_dir):
    """For every product, the weeks from its first to its last, each with its week a year back."""
    span = wk.period_bounds(facts_of(spark, sf_dir), *PRODUCT)
    return span.select(*PRODUCT, F.inline(cal.week_correspondence(F.col("first_week"), F.col("last_week"))))


@query("scenario_gaps")
def scenario_gaps(spark, sf_dir):
    return scn.scenario_gaps(_scenario(spark, sf_dir)["new"], *S.SCENARIO)


def _whatif_chart(period):
    def run(spark, sf_dir):
        corrected = rep.whatif_decomposition(_scenario(spark, sf_dir)["new"], period)["corrected"]
        return rep.decomposition_chart_rows(corrected, period)
    return run


for _period in ("all", "quarter", "month"):
    query(f"whatif_chart_rows_{_period}")(_whatif_chart(_period))


@query("scenario_totals")
def scenario_totals(spark, sf_dir):
    return scn.scenario_totals(**_scenario(spark, sf_dir))


@query("scenario_delta")
def scenario_delta(spark, sf_dir):
    return scn.scenario_delta(**_scenario(spark, sf_dir))


# ---- windows, sorts, sets ----------------------------------------------------

def _long_parts(spark, sf_dir, period="quarter"):
    wide = dec.seasonality_merge(_history(spark, sf_dir, period)["corrected"])
    wide = dec.with_period_label(wide, period)
    return dec.melt_parts(wide, [*PRODUCT, "labels"], dec.CHART_PARTS)


BAR = [*PRODUCT, "labels"]


@query("stack_position")
def stack_position(spark, sf_dir):
    return dec.stack_position(dec.filter_small_parts(_long_parts(spark, sf_dir)), BAR)


@query("share_within_label")
def share_within_label(spark, sf_dir):
    return dec.share_within_label(dec.filter_small_parts(_long_parts(spark, sf_dir)), BAR)


@query("week_rank")
def week_rank(spark, sf_dir):
    return scn.week_rank(facts_of(spark, sf_dir)).select(*PRODUCT, "week", "pos")


@query("with_empty_weeks")
def with_empty_weeks(spark, sf_dir):
    return wk.with_empty_weeks(facts_of(spark, sf_dir)).select(
        *PRODUCT, "week", "quarter", F.col("blended_units_total").alias("units"), F.col("holiday_xmas").alias("xmas"))


@query("carry_forward_price")
def carry_forward_price(spark, sf_dir):
    return plain_prices(spark, sf_dir).select(
        *PRODUCT, "week", *[rel.price_column(m, smooth=False) for m in wk.measure_names()])


@query("sort_by_week")
def sort_by_week(spark, sf_dir):
    return rel.sort_by_week(facts_of(spark, sf_dir).select(*PRODUCT, "week", "price"), *PRODUCT)


@query("sort_by_key")
def sort_by_key(spark, sf_dir):
    return rel.sort_by_key(mom.rows_per_level2(lines2(spark, sf_dir)), "h2")


@query("sort_period_labels")
def sort_period_labels(spark, sf_dir):
    wide = dec.decomp_sums(sc.raw_decomps(scored(spark, sf_dir)), "month")
    rows = dec.with_period_label(wide, "month").select(*PRODUCT, "labels", "label_order",
                                                       "y_hat_sum")
    return dec.sort_period_labels(rows)


@query("limit_rows")
def limit_rows(spark, sf_dir):
    series = wk.weekly_units(facts_of(spark, sf_dir), S.MEASURE).select("week", "units")
    return rel.limit_rows(series, "week", n=100)


@query("union_all_iterations")
def union_all_iterations(spark, sf_dir):
    d = retail.event_draws(spark, sf_dir)
    history, new = d.where(F.col("iter") < S.RAW_ITERS), d.where(F.col("iter") >= S.RAW_ITERS)
    return store.union_all_iterations(history, new)


@query("distinct_rows")
def distinct_rows(spark, sf_dir):
    return rel.distinct_rows(retail.sales_lines(spark, sf_dir).select(
        "dept", "type", "week", "qty", "promo", "redline"))


@query("product_choices")
def product_choices(spark, sf_dir):
    return rep.product_choices(facts_of(spark, sf_dir), brand="A", gender="F")


@query("distinct_values")
def distinct_values(spark, sf_dir):
    return rel.distinct_values(facts_of(spark, sf_dir), "brand", "gender", "dept")


# ---- scalar functions and reshaping ------------------------------------------

def _order_days(spark, sf_dir):
    return src.scan_table(spark, f"{sf_dir}/orders.parquet").select(
        F.to_date("o_orderdate").alias("day")).distinct()


@query("floor_week_sunday")
def floor_week_sunday(spark, sf_dir):
    return _order_days(spark, sf_dir).withColumn("week", cal.floor_week_sunday(F.col("day")))


@query("week_sequence")
def week_sequence(spark, sf_dir):
    span = wk.period_bounds(facts_of(spark, sf_dir), "dept")
    weeks = cal.week_sequence(F.col("first_week"), F.col("last_week"))
    return span.select("dept", F.size(weeks).alias("weeks"), F.explode(weeks).alias("week"))


@query("same_weeks_last_year")
def same_weeks_last_year(spark, sf_dir):
    end = F.date_add("day", 45)
    first, last = cal.same_weeks_last_year(F.col("day"), end)
    return _order_days(spark, sf_dir).select("day", first.alias("first"), last.alias("last"))


@query("year_of")
def year_of(spark, sf_dir):
    return facts_of(spark, sf_dir).select("week").distinct().withColumn(
        "year", cal.year_of(F.col("week")))


@query("month_code")
def month_code(spark, sf_dir):
    return facts_of(spark, sf_dir).groupBy("fiscal_month").agg(
        F.count(F.lit(1)).alias("rows")).withColumn("code", cal.month_code(F.col("fiscal_month")))


@query("period_label")
def period_label(spark, sf_dir):
    facts = facts_of(spark, sf_dir)
    year = F.year("week")
    return facts.select(
        cal.period_label(year, F.col("quarter")).alias("quarter_label"),
        cal.period_label(year, cal.month_code(F.col("fiscal_month"))).alias("month_label"),
        cal.period_label(F.col("dept"), F.col("type")).alias("product_label")).distinct()


@query("driver_key")
def driver_key(spark, sf_dir):
    return lines2(spark, sf_dir).select(
        cal.driver_key(F.col("h2"), F.col("h1"), F.lit("x1")).alias("driver_key")).distinct()


@query("log1p_transform")
def log1p_transform(spark, sf_dir):
    return sc.log1p_transform(facts_of(spark, sf_dir))


@query("expm1_inverse")
def expm1_inverse(spark, sf_dir):
    return transformed(spark, sf_dir).select(
        *PRODUCT, "week", sc.expm1_inverse(F.col("blended_units_total_log")).alias("y"))


@query("dot_score")
def dot_score(spark, sf_dir):
    plain = scored(spark, sf_dir)
    return plain.select(*PRODUCT, "week", "score", "y", "y_hat",
                        F.round("y_hat").alias("y_hat_rounded"))


@query("residual")
def residual(spark, sf_dir):
    return sc.residual(scored(spark, sf_dir)).select(*PRODUCT, "week", "y", "y_hat", "err")


@query("driver_contribution")
def driver_contribution(spark, sf_dir):
    return sc.raw_decomps(scored(spark, sf_dir)).select(*PRODUCT, "week", *sc.PARTS)


@query("base_sales")
def base_sales(spark, sf_dir):
    return scored(spark, sf_dir).select(*PRODUCT, "week", sc.base_sales().alias("base_sales"))


@query("raw_decomp_error")
def raw_decomp_error(spark, sf_dir):
    return sc.raw_decomp_error(sc.raw_decomps(scored(spark, sf_dir))).select(
        *PRODUCT, "week", "decomp_sum", "decomp_err")


@query("decomp_corrected")
def decomp_corrected(spark, sf_dir):
    return _history(spark, sf_dir, "quarter")["corrected"]


@query("decomp_pct")
def decomp_pct(spark, sf_dir):
    return dec.decomp_pct(_history(spark, sf_dir, "quarter")["corrected"], "quarter")


@query("seasonality_merge")
def seasonality_merge(spark, sf_dir):
    return _history(spark, sf_dir, "month")["data"]


@query("melt_parts")
def melt_parts(spark, sf_dir):
    return _long_parts(spark, sf_dir, "month")


@query("set_levers")
def set_levers(spark, sf_dir):
    facts = _past_facts(spark, sf_dir)
    aligned = scn.align_by_position(facts, *S.SCENARIO)
    return scn.set_levers(aligned, hand_levers(spark)).select(
        *PRODUCT, "week", *sc.DRIVERS_PLANNED)


@query("shift_driver")
def shift_driver(spark, sf_dir):
    facts = facts_of(spark, sf_dir).select(*PRODUCT, "week", *sc.DRIVERS_PLANNED)
    return scn.shift_driver(scn.shift_driver(facts, "price", S.PRICE_SHIFT), "num_colors", 2)


@query("explode_draws", digits=6)
def explode_draws(spark, sf_dir):
    start = gibbs.start_values(stored(stats2(spark, sf_dir), "stats"), SPEC2)
    draws = start.select(F.lit(1).alias("iter"), *GROUP, F.col("beta").alias("draw"))
    return gw.explode_draws(draws, ["1", "x1"])


def _vectors(spark, sf_dir):
    return lines2(spark, sf_dir).groupBy(*GROUP).agg(
        F.array(F.avg("x1"), F.avg("x2"), F.avg("x3")).alias("a"),
        F.array(F.max("x1"), F.max("x2"), F.max("x3")).alias("b"),
        F.array(*[F.avg(F.col(x) * F.col(y)) for x in ("x1", "x2") for y in ("x1", "x2")])
        .alias("m"))


def _shown(spark, sf_dir, column, p, square=False):
    return spread(_vectors(spark, sf_dir).select(*GROUP, column.alias("v")), "v", p, square=square)


@query("array_add", digits=6)
def array_add(spark, sf_dir):
    return _shown(spark, sf_dir, arr.array_add(F.col("a"), F.col("b")), 3)


@query("array_scale", digits=6)
def array_scale(spark, sf_dir):
    return _shown(spark, sf_dir, arr.array_scale(F.col("a"), F.lit(2.5)), 3)


@query("add_diag", digits=6)
def add_diag(spark, sf_dir):
    return _shown(spark, sf_dir, arr.add_diag(F.col("m"), F.lit(2.0), 2), 2, square=True)


@query("diag_of", digits=6)
def diag_of(spark, sf_dir):
    return _shown(spark, sf_dir, arr.diag_of(F.col("a")), 3, square=True)


@query("outer_diff", digits=6)
def outer_diff(spark, sf_dir):
    return _shown(spark, sf_dir, arr.outer_diff(F.col("a"), F.col("b")), 3, square=True)


# ---- model fitting -----------------------------------------------------------

@query("ols_by_group", digits=6)
def ols_by_group(spark, sf_dir):
    fit = post.ols_by_group(stats2(spark, sf_dir), 2).select(*GROUP, "n", "beta")
    return spread(fit, "beta", 2, "b")


@query("random_start_by_group", digits=6)
def random_start_by_group(spark, sf_dir):
    groups = lines2(spark, sf_dir).select(*GROUP).distinct()
    return spread(post.random_start_by_group(groups, GROUP, 4, 11), "beta", 4, "b")


@query("wishart_draw_by_group", digits=6)
def wishart_draw_by_group(spark, sf_dir):
    df = pooled2(spark, sf_dir).select("h2", "n1", "v_j", "w")
    return spread(spread(df, "v_j", 2, square=True), "w", 2, square=True)


@query("nearest_pd_by_group")
def nearest_pd_by_group(spark, sf_dir):
    """Matrices of price ratios, many of them indefinite, repaired and tested."""
    price = {(i, j): F.avg(F.when((F.col("promo") == i) & (F.col("redline") == j),
                                  F.col("amount"))) for i in (0, 1) for j in (0, 1)}
    r = [F.lit(0.9) * price[1, 0] / price[0, 0], F.lit(0.8) * price[0, 1] / price[0, 0],
         F.lit(0.7) * price[1, 1] / price[0, 0]]
    one = F.lit(1.0)
    m = F.array(one, r[0], r[1], r[0], one, r[2], r[1], r[2], one)
    rows = retail.sales_lines(spark, sf_dir).groupBy(*PRODUCT).agg(m.alias("m"))
    rows = rows.where(~F.exists("m", lambda x: x.isNull()))

    def minors(a):
        second = a[0] * a[4] - a[1] * a[3]
        third = (a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6])
                 + a[2] * (a[3] * a[7] - a[4] * a[6]))
        return (a[0] > 0) & (second > 0) & (third > 0)

    fixed_up = post.nearest_pd_by_group(rows, "m", 3)
    a, b = F.col("m"), F.col("m_pd")
    return fixed_up.select(
        *PRODUCT, minors(a).alias("was_pd"), minors(b).alias("is_pd"),
        (a == b).alias("unchanged"),
        ((b[1] == b[3]) & (b[2] == b[6]) & (b[5] == b[7])).alias("is_symmetric"))


@query("pooled_covariance", digits=6)
def pooled_covariance(spark, sf_dir):
    return spread(pooled2(spark, sf_dir).select("h2", "sigma"), "sigma", 2, square=True)


@query("pooled_mean", digits=6)
def pooled_mean(spark, sf_dir):
    df = pooled2(spark, sf_dir).select("h2", "sum_b", "mu")
    return spread(spread(df, "sum_b", 2), "mu", 2)


@query("pooled_draw", digits=6)
def pooled_draw(spark, sf_dir):
    return spread(pooled2(spark, sf_dir).select("h2", "mu_draw"), "mu_draw", 2)


@query("group_covariance", digits=8)
def group_covariance(spark, sf_dir):
    return spread(posterior2(spark, sf_dir).select(*GROUP, "v_i"), "v_i", 2, square=True)


@query("group_mean", digits=6)
def group_mean(spark, sf_dir):
    return spread(posterior2(spark, sf_dir).select(*GROUP, "mean"), "mean", 2)


@query("group_draw", digits=6)
def group_draw(spark, sf_dir):
    return spread(posterior2(spark, sf_dir).select(*GROUP, "draw"), "draw", 2)


@query("noise_precision_draw", digits=6)
def noise_precision_draw(spark, sf_dir):
    stats = stored(stats2(spark, sf_dir), "stats")
    s2 = mom.level2_s2(mom.group_ssr(stats, fixed_draws(stats), 2), SPEC2.deflator)
    return post.noise_precision_draw(s2, SPEC2.deflator, SPEC2.seed, 1)


@query("gibbs_init", digits=6)
def gibbs_init(spark, sf_dir):
    state = gibbs.gibbs_init(stats2(spark, sf_dir), SPEC2, work_dir(spark, "gibbs"))
    state = state.select("h2", "n1", "n", "w", "mu_draw", "s2", "h")
    return spread(spread(state, "w", 2, square=True), "mu_draw", 2, "mu")


@query("gibbs_run", digits=6)
def gibbs_run(spark, sf_dir):
    folder = work_dir(spark, "gibbs")
    gibbs.gibbs_init(stats2(spark, sf_dir), SPEC2, folder)
    draws = gibbs.gibbs_run(spark, folder, SPEC2, 2, S.ITERATIONS)
    return gw.explode_draws(draws, ["1", "x1"])


# ---- reports -----------------------------------------------------------------

@query("weekly_series")
def weekly_series(spark, sf_dir):
    facts = plain_prices(spark, sf_dir)
    return rep.weekly_series(facts, *wk.measure_names(), smooth=True)["series"]


@query("stacked_units")
def stacked_units(spark, sf_dir):
    return rep.stacked_units(facts_of(spark, sf_dir))


@query("sales_table")
def sales_table(spark, sf_dir):
    return rep.sales_table(plain_prices(spark, sf_dir), smooth=False)


@query("sales_table_smooth")
def sales_table_smooth(spark, sf_dir):
    return rep.sales_table(facts_of(spark, sf_dir), smooth=True)


@query("products_without_model")
def products_without_model(spark, sf_dir):
    facts = stored(facts_of(spark, sf_dir), "facts")
    model = retail.demand_model(facts).where(retail.gender_of(F.col("dept")) == "F")
    return rep.products_without_model(facts, model)


def _partial_history(spark, sf_dir):
    """Quarterly decomposition with models for one gender only."""
    facts = stored(facts_of(spark, sf_dir), "facts")
    model = retail.demand_model(facts).where(retail.gender_of(F.col("dept")) == "F")
    return rep.historic_decomposition(facts, model, "quarter")


@query("decomposition_without_some_models")
def decomposition_without_some_models(spark, sf_dir):
    return _partial_history(spark, sf_dir)["data"]


@query("decomposition_coverage")
def decomposition_coverage(spark, sf_dir):
    return _partial_history(spark, sf_dir)["coverage"]


@query("geweke_report_blocks", digits=6)
def geweke_report_blocks(spark, sf_dir):
    """The report from statistics of blocks of four days, stored in two goes."""
    long = stored(chains(spark, sf_dir), "draws")
    half = S.RAW_ITERS // 2 // 4 * 4
    stored_blocks = [stored(gw.draw_blocks(long.where(part), 4), "draw-blocks")
                     for part in (F.col("iter") <= half, F.col("iter") > half)]
    blocks = stored_blocks[0].unionByName(stored_blocks[1])
    return gw.geweke_from_blocks(blocks, long, S.RAW_ITERS, S.BURN_IN, 4)


@query("report_on_selection")
def report_on_selection(spark, sf_dir):
    """One brand and gender over the scenario's weeks, through the selection to the report."""
    facts = stored(facts_of(spark, sf_dir, *S.SCENARIO), "facts")
    chosen = rep.select_facts(facts, brand="A", gender="F", start=S.SCENARIO[0], end=S.SCENARIO[1])
    return rep.historic_decomposition(chosen, retail.demand_model(facts), "quarter")["data"]


def _chosen(spark, sf_dir):
    facts = stored(plain_prices(spark, sf_dir), "facts")
    return rep.selected_reports(facts, retail.demand_model(facts), brand="B", gender="M", type_=S.PRODUCT[1],
                                start=S.SCENARIO[0], end=S.SCENARIO[1])


@query("series_on_selection")
def series_on_selection(spark, sf_dir):
    return _chosen(spark, sf_dir)["series"]["series"]


@query("stacked_on_selection")
def stacked_on_selection(spark, sf_dir):
    return _chosen(spark, sf_dir)["stacked"]


@query("table_on_selection")
def table_on_selection(spark, sf_dir):
    return _chosen(spark, sf_dir)["table"]


@query("whatif_on_selection")
def whatif_on_selection(spark, sf_dir):
    """Last year's drivers laid on the scenario, for one brand and gender."""
    facts = _past_facts(spark, sf_dir)
    both = rep.selected_whatif(facts, retail.demand_model(facts), None, *S.SCENARIO, brand="B", gender="M")
    return rep.whatif_summary(**{name: stored(df, name) for name, df in both.items()})


def _named(name, fn):
    query(name)(fn)


for _period in ("all", "quarter", "month"):
    _tail = "" if _period == "quarter" else f"_{_period}"
    _named(f"historic_decomposition{_tail}",
           lambda spark, sf_dir, p=_period: _history(spark, sf_dir, p)["data"])
    _named(f"historic_decomposition_pct{_tail}",
           lambda spark, sf_dir, p=_period: _history(spark, sf_dir, p)["pct"])
    _named(f"decomposition_chart_rows{_tail}",
           lambda spark, sf_dir, p=_period: rep.decomposition_chart_rows(
               _history(spark, sf_dir, p)["corrected"], p))
    _named(f"whatif_decomposition{_tail}",
           lambda spark, sf_dir, p=_period: rep.whatif_decomposition(
               _scenario(spark, sf_dir)["new"], p)["data"])
    _named(f"whatif_decomposition_pct{_tail}",
           lambda spark, sf_dir, p=_period: rep.whatif_decomposition(
               _scenario(spark, sf_dir)["new"], p)["pct"])


@query("default_levers")
def default_levers(spark, sf_dir):
    return rep.default_levers(_past_facts(spark, sf_dir), *S.SCENARIO)


@query("whatif_predict")
def whatif_predict(spark, sf_dir):
    both = _scenario(spark, sf_dir)
    columns = [*PRODUCT, "week", "y", "y_hat"]
    return both["new"].select(F.lit("new").alias("side"), *columns).unionByName(
        both["old"].select(F.lit("old").alias("side"), *columns))


@query("whatif_rows")
def whatif_rows(spark, sf_dir):
    return rep.whatif_rows(_scenario(spark, sf_dir)["new"])


@query("whatif_summary")
def whatif_summary(spark, sf_dir):
    return rep.whatif_summary(**_scenario(spark, sf_dir))


@query("geweke_report", digits=6)
def geweke_report(spark, sf_dir):
    return conv.geweke_report(chains(spark, sf_dir), S.RAW_ITERS, S.BURN_IN)["detail"]


@query("fit_demand_model")
def fit_demand_model(spark, sf_dir):
    """Sampler on weekly facts, then what any fitted model's decomposition must fulfil."""
    facts = stored(facts_of(spark, sf_dir), "facts")
    model = stored(conv.fit_demand_model(facts, work_dir(spark, "fit"), iterations=6, burn_in=2), "model")
    parts = rep.historic_decomposition(facts, model, "quarter")
    keys = [*PRODUCT, "quarter", "year"]
    whole = sum((F.col(p) for p in sc.PARTS), F.col("base_sales"))
    # Nine roundings at most lie between the parts and the predicted units.
    fits = (F.abs(whole - F.col("y_hat_sum")) <= 5) | (F.abs(whole - F.col("y_hat_sum")) <= 1e-6 * F.abs(whole))
    rows = parts["corrected"].join(parts["sums"].select(*keys, "y_hat_sum"), keys).join(model, PRODUCT)
    return rows.groupBy("dept").agg(
        F.countDistinct("type").alias("types"), F.count(F.lit(1)).alias("periods"),
        F.max(F.size("coef")).alias("width"),
        F.bool_and(F.forall("coef", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))).alias("finite"),
        F.bool_and(fits).alias("adds_up"))
