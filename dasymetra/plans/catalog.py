"""Queries of the reference operators on the star-schema tables: weights, travel times, results, diagnostics, spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from dasymetra.functions import breaks as brk
from dasymetra.functions import text
from dasymetra.operators import diagnostics as dg
from dasymetra.operators import fit as ft
from dasymetra.operators import geometry as geo
from dasymetra.operators import od as times
from dasymetra.operators import proximity
from dasymetra.operators import result as res
from dasymetra.operators import spatial as sp
from dasymetra.operators import weights as wt
from dasymetra.plans import proxies as px
from dasymetra.plans.common import cut_lineage, table
from dasymetra.plans.proxies import ALPHA, FIT, OD, POP, SRC, W, ZONES, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


r4 = lambda c, name=None: F.round(c, 4).alias(name or c)
BRACKET_FIT = """SELECT zone_id, bracket, round(sum(w * voters), 4) AS fitted FROM (
  SELECT *, k / sum(k) OVER (PARTITION BY source_id, bracket) AS w FROM ({k})) JOIN src USING (source_id, bracket) GROUP BY ALL"""


@query(sql("SELECT zone_id, bracket, round(fitted, 4) AS fitted FROM fit", OD, SRC, W, FIT))
def idw_flagship(s, d):
    brackets = wt.active_brackets(px.population(s, d), px.voters(s, d))
    w = wt.bracket_weights(px.od(s, d), 2.0, brackets)
    return wt.fitted(w, px.voters(s, d)).select("zone_id", "bracket", r4("fitted"))


@query(sql(BRACKET_FIT.format(k="SELECT zone_id, source_id, bracket, exp(-0.05 * minutes) AS k FROM od CROSS JOIN (SELECT DISTINCT bracket FROM src) WHERE minutes IS NOT NULL"), OD, SRC))
def idw_exponential(s, d):
    brackets = wt.active_brackets(px.population(s, d), px.voters(s, d))
    w = wt.bracket_weights(px.od(s, d), 0.05, brackets, "exponential")
    return wt.fitted(w, px.voters(s, d)).select("zone_id", "bracket", r4("fitted"))


@query(sql(BRACKET_FIT.format(k="SELECT zone_id, source_id, bracket, pow(minutes + 1, -alpha) AS k FROM od JOIN alpha USING (zone_id) WHERE minutes IS NOT NULL"), OD, SRC, POP, ALPHA))
def idw_zone_bracket_alpha(s, d):
    brackets = wt.active_brackets(px.population(s, d), px.voters(s, d))
    w = wt.bracket_weights(px.od(s, d), px.alpha(s, d), brackets)
    return wt.fitted(w, px.voters(s, d)).select("zone_id", "bracket", r4("fitted"))


WB = """wb AS (SELECT zone_id, source_id, bracket, k / sum(k) OVER (PARTITION BY source_id, bracket) AS w FROM (
  SELECT zone_id, source_id, bracket, pow(minutes + 1, -alpha) AS k FROM od JOIN alpha USING (zone_id) WHERE minutes IS NOT NULL)),
  shares AS (SELECT source_id, bracket, voters / sum(voters) OVER (PARTITION BY source_id) AS share FROM src),
  wa AS (SELECT zone_id, source_id, sum(w * share) AS w FROM wb JOIN shares USING (source_id, bracket) GROUP BY ALL)"""


def _matrix(s, d):
    return wt.weight_matrix(px.od(s, d), px.alpha(s, d), px.population(s, d), px.voters(s, d))


@query(sql("SELECT zone_id, source_id, round(w, 6) AS w FROM wa", OD, SRC, POP, ALPHA, WB))
def weight_matrix_agg(s, d):
    return _matrix(s, d).select("zone_id", "source_id", F.round("w", 6).alias("w"))


@query(sql("SELECT source_id, round(sum(w), 6) AS total FROM wa GROUP BY ALL", OD, SRC, POP, ALPHA, WB))
def weight_column_sums(s, d):
    return _matrix(s, d).groupBy("source_id").agg(F.round(F.sum("w"), 6).alias("total"))


@query(sql("""SELECT zone_id, source_id, round(CASE WHEN t = 0 THEN 0 ELSE k / t END, 6) AS w FROM (
  SELECT *, sum(k) OVER (PARTITION BY source_id) AS t FROM (SELECT zone_id, source_id, CASE WHEN source_id % 7 = 0 THEN 0.0 ELSE 1 / (minutes + 1) END AS k FROM od WHERE minutes IS NOT NULL))""", OD))
def column_standardize(s, d):
    k = F.when(F.col("source_id") % 7 == 0, 0.0).otherwise(1 / (F.col("minutes") + 1))
    out = wt.column_standardised(px.od(s, d).filter("minutes IS NOT NULL").withColumn("k", k))
    return out.select("zone_id", "source_id", F.round("w", 6).alias("w"))


def _values(s, d):
    lines = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_discount").alias("discount"), F.count(F.lit(1)).cast("double").alias("lines"))
    return lines.unpivot("source_id", ["quantity", "discount", "lines"], "variable", "value")


VALUES = """vals AS (UNPIVOT (SELECT l_suppkey AS source_id, sum(l_quantity) AS quantity, sum(l_discount) AS discount, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY ALL)
  ON quantity, discount, lines INTO NAME variable VALUE value)"""


@query(sql("SELECT zone_id, variable, round(sum(w * value), 4) AS value FROM w JOIN vals USING (source_id) GROUP BY ALL", OD, W, VALUES))
def interpolate_variables(s, d):
    return wt.interpolated(px.source_weights(s, d), _values(s, d)).select("zone_id", "variable", r4("value"))


@query(sql("""SELECT z.zone_id, v.variable, round(x.value, 4) AS value FROM zones z CROSS JOIN (SELECT DISTINCT variable FROM vals) v
  LEFT JOIN (SELECT zone_id, variable, sum(w * value) AS value FROM w JOIN vals USING (source_id) WHERE zone_id % 6 <> 0 GROUP BY ALL) x USING (zone_id, variable)""", OD, W, VALUES, ZONES))
def unreachable_zone_reinsert(s, d):
    w = px.source_weights(s, d).filter("zone_id % 6 <> 0")
    return wt.interpolated(w, _values(s, d), px.zones(s, d)).select("zone_id", "variable", r4("value"))


@query(sql("SELECT zone_id, CAST(sum(pop) AS BIGINT) AS pop FROM pop GROUP BY ALL HAVING sum(pop) >= 60", POP))
def min_pop_filter(s, d):
    return wt.populated(px.population(s, d), 60)


@query(sql("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(minutes) AS BIGINT) AS n_known, sum(minutes) AS minutes FROM od", OD))
def od_dense_matrix(s, d):
    routes = px.od(s, d).filter("minutes IS NOT NULL")
    return times.dense(px.zones(s, d), px.sources(s, d), routes).agg(F.count(F.lit(1)).alias("n"), F.count("minutes").alias("n_known"), F.sum("minutes").alias("minutes"))


@query(sql("SELECT zone_id, source_id, coalesce(minutes, CASE WHEN source_id % 2 = 0 THEN 99.0 END) AS minutes FROM od", OD))
def od_retry_upsert(s, d):
    retry = px.od(s, d).filter("source_id % 2 = 0").withColumn("minutes", F.lit(99.0))
    return times.retried(px.od(s, d), retry)


@query(sql("""SELECT zone_id, source_id, CASE WHEN (SELECT avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END) FROM (SELECT zone_id, count(CASE WHEN zone_id % 3 > 0 THEN minutes END) AS n FROM od GROUP BY 1)) >= 0.2
  THEN minutes / 4 ELSE CASE WHEN zone_id % 3 > 0 THEN minutes END END AS minutes FROM od""", OD))
def od_auto_mode(s, d):
    walk = px.od(s, d).withColumn("minutes", F.when(F.col("zone_id") % 3 > 0, F.col("minutes")))
    car = px.od(s, d).withColumn("minutes", F.col("minutes") / 4)
    return times.auto_mode(walk, car, 0.2).select("zone_id", "source_id", "minutes")


@query(sql("SELECT zone_id, arg_min(source_id, minutes * 1000000 + source_id) AS source_id, min(minutes) AS minutes FROM od WHERE minutes IS NOT NULL GROUP BY ALL", OD))
def nearest_source_baseline(s, d):
    return times.nearest(px.od(s, d))


@query(sql("SELECT bracket, round(sum(pow(f - pop, 2)), 2) AS sse FROM (SELECT bracket, sum(voters) / (SELECT count(*) FROM nation) AS f FROM src GROUP BY 1) JOIN pop USING (bracket) GROUP BY ALL", SRC, POP))
def uniform_baseline(s, d):
    both = wt.uniform_fit(px.population(s, d), px.voters(s, d)).join(px.population(s, d), ["zone_id", "bracket"])
    return both.groupBy("bracket").agg(F.round(F.sum(F.pow(F.col("fitted") - F.col("pop"), 2)), 2).alias("sse"))


@query(sql("""SELECT model, round(sqrt(avg(pow(fitted - pop, 2))), 4) AS rmse, round(2 * sum(fitted - pop * ln(greatest(fitted, 1e-30))) + 2 * sum(CASE WHEN pop > 0 THEN pop * ln(pop) ELSE 0 END - pop), 3) AS deviance FROM (
  SELECT 'idw' AS model, zone_id, bracket, fitted FROM fit UNION ALL
  SELECT 'uniform', zone_id, bracket, v / (SELECT count(DISTINCT zone_id) FROM pop) FROM pop JOIN (SELECT bracket, sum(voters) AS v FROM src GROUP BY 1) USING (bracket) UNION ALL
  SELECT 'nearest', zone_id, bracket, sum(voters * share) FROM (SELECT zone_id, source_id, 1.0 / count(*) OVER (PARTITION BY source_id) AS share FROM (
    SELECT zone_id, arg_min(source_id, minutes * 1000000 + source_id) AS source_id FROM od WHERE minutes IS NOT NULL GROUP BY 1)) JOIN src USING (source_id) GROUP BY ALL) JOIN pop USING (zone_id, bracket) GROUP BY ALL""", OD, SRC, W, FIT, POP))
def baselines(s, d):
    """The fit against equal shares and against the nearest source of each zone, by error and deviance."""
    pop, voters = px.population(s, d), px.voters(s, d)
    near = times.nearest(px.od(s, d))
    share = near.join(near.groupBy("source_id").agg((1 / F.count(F.lit(1))).alias("share")), "source_id")
    nearest = share.join(voters, "source_id").groupBy("zone_id", "bracket").agg(F.sum(F.col("voters") * F.col("share")).alias("fitted"))
    out = wt.compared([("idw", px.fitted(s, d)), ("uniform", wt.uniform_fit(pop, voters)), ("nearest", nearest)], pop)
    return out.select("model", r4("rmse"), F.round("deviance", 3).alias("deviance"))


@query(sql("""SELECT source_id, round(sqrt(avg(pow(t.fitted - w * voters - t.pop, 2))), 4) AS rmse FROM (SELECT zone_id, bracket, fitted, pop FROM fit JOIN pop USING (zone_id, bracket)) t
  JOIN w USING (zone_id) JOIN src USING (source_id, bracket) GROUP BY ALL""", OD, SRC, W, FIT, POP))
def loo_rmse(s, d):
    """Error over the zones and brackets that a source reaches when its own share is taken away."""
    base = px.fitted(s, d).join(px.population(s, d), ["zone_id", "bracket"])
    own = px.source_weights(s, d).join(px.voters(s, d), "source_id").select("zone_id", "bracket", "source_id", (F.col("w") * F.col("voters")).alias("own"))
    err = F.col("fitted") - F.col("own") - F.col("pop")
    return own.join(base, ["zone_id", "bracket"]).groupBy("source_id").agg(F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse"))


@query(sql("SELECT zone_id, round(sum(pop) / sum(sum(pop)) OVER () * (SELECT count(*) FROM supplier), 6) AS target FROM pop GROUP BY ALL", POP))
def row_targets(s, d):
    out = wt.row_targets(px.population(s, d), px.sources(s, d).agg(F.count(F.lit(1)).alias("n")))
    return out.select("zone_id", F.round("target", 6).alias("target"))


DEV = "CASE WHEN pop > 0 THEN pop * ln(pop) ELSE 0 END"


@query(sql(f"SELECT bracket, round(2 * sum(fitted - pop * ln(greatest(fitted, 1e-30))) + 2 * sum({DEV} - pop), 3) AS deviance FROM fit JOIN pop USING (zone_id, bracket) GROUP BY ALL", OD, SRC, W, FIT, POP))
def poisson_deviance(s, d):
    both = px.fitted(s, d).join(px.population(s, d), ["zone_id", "bracket"])
    return both.groupBy("bracket").agg(F.round(wt.poisson_deviance(F.col("fitted"), F.col("pop")), 3).alias("deviance"))


@query(sql("SELECT round(-sum(ln(greatest(f, 1e-30))), 6) AS barrier FROM (SELECT zone_id, sum(fitted) AS f FROM fit GROUP BY 1)", OD, SRC, W, FIT))
def log_barrier(s, d):
    return wt.log_barrier(px.fitted(s, d)).select(F.round("barrier", 6).alias("barrier"))


ENTROPY = "ent AS (SELECT zone_id, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h, sum(p * p) AS hhi FROM (SELECT zone_id, w / sum(w) OVER (PARTITION BY zone_id) AS p FROM w) GROUP BY ALL)"


@query(sql("SELECT round(sum(h), 6) AS entropy, round(exp(avg(h)), 6) AS mean_sources, round(exp(median(h)), 6) AS median_sources FROM ent", OD, W, ENTROPY))
def entropy_penalty(s, d):
    h = wt.row_entropy(px.source_weights(s, d))
    return h.agg(F.round(F.sum("entropy"), 6).alias("entropy"), F.round(F.exp(F.avg("entropy")), 6).alias("mean_sources"), F.round(F.exp(F.median("entropy")), 6).alias("median_sources"))


@query("""SELECT epoch, cycle, round(0.05 * pow(0.7, cycle) * (0.01 + 0.99 * 0.5 * (1 + cos(pi() * (epoch - 1 - 500 * (pow(2, cycle) - 1)) / (500 * pow(2, cycle))))), 8) AS lr
  FROM (SELECT CAST(epoch AS BIGINT) AS epoch, CAST(floor(log2((epoch - 1) / 500.0 + 1 + 1e-12)) AS INTEGER) AS cycle FROM range(1, 2001) t(epoch))""")
def sgdr_schedule(s, d):
    return dg.learning_rates(s.range(1, 2001).toDF("epoch"), 0.05).select("epoch", "cycle", F.round("lr", 8).alias("lr"))


def _history(s):
    return s.range(1, 1001).toDF("epoch").withColumn("loss", 1000 / F.col("epoch") + 5 * F.sin(F.col("epoch") / 20))


HISTORY = "hist AS (SELECT CAST(epoch AS BIGINT) AS epoch, 1000 / epoch + 5 * sin(epoch / 20) AS loss FROM range(1, 1001) t(epoch))"


@query(sql("SELECT arg_min(epoch, loss) AS epoch, round(min(loss), 6) AS loss FROM hist", HISTORY))
def history_best_epoch(s, d):
    return dg.best_epoch(_history(s)).select("epoch", F.round("loss", 6).alias("loss"))


@query(sql("""SELECT epoch, round(before, 6) AS before, round(avg(loss) OVER (ORDER BY epoch ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mean_100, round(abs(loss - before) / abs(before), 6) AS change
  FROM (SELECT *, lag(loss, 50) OVER (ORDER BY epoch) AS before FROM hist)""", HISTORY))
def history_lookback(s, d):
    return dg.lookback(_history(s), 50).select("epoch", *[F.round(c, 6).alias(c) for c in ("before", "mean_100", "change")])


# results


def _zone_values(s, d):
    lines = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("zone_id"))
    k = F.col("c_custkey")
    return lines.agg(F.count_if(k % 3 == 0).alias("v"), F.count(F.lit(1)).alias("turnout"), F.count_if(k % 11 == 0).alias("blank"), F.count_if(k % 13 == 0).alias("null_votes"), (F.count(F.lit(1)) + F.count_if(k % 4 == 0)).alias("eligible"))


ZV = """zv AS (SELECT c_nationkey AS zone_id, count(*) FILTER (c_custkey % 3 = 0) AS v, count(*) AS turnout, count(*) FILTER (c_custkey % 11 = 0) AS blank,
  count(*) FILTER (c_custkey % 13 = 0) AS null_votes, count(*) + count(*) FILTER (c_custkey % 4 = 0) AS eligible FROM customer GROUP BY ALL)"""
FORMS = {
    "absolute": "v", "pct_tract": "100.0 * v / nullif(turnout, 0)", "pct_muni": "100.0 * v / sum(v) OVER ()", "pct_valid": "100.0 * v / CASE WHEN turnout - blank - null_votes > 0 THEN turnout - blank - null_votes END",
    "pct_eligible": "100.0 * v / nullif(eligible, 0)", "density": "v / nullif(zone_id % 4 * 1.5, 0)",
}


def _quantity(kind):
    def run(s, d):
        more = {"turnout": F.col("turnout"), "blank": F.col("blank"), "null": F.col("null_votes"), "eligible": F.col("eligible"), "km2": F.col("zone_id") % 4 * 1.5}
        return res.with_quantity(_zone_values(s, d), "v", kind, "q", **more).select("zone_id", F.round(F.col("q").cast("double"), 4).alias("q"))

    run.__name__ = f"quantity_{kind}"
    return run


for _kind, _form in FORMS.items():
    query(sql(f"SELECT zone_id, round(CAST({_form} AS DOUBLE), 4) AS q FROM zv", ZV))(_quantity(_kind))

EPS = res.EPS
RESIDUAL = {
    "raw": "fitted - pop", "pearson": f"(fitted - pop) / sqrt(greatest(fitted, {EPS}))",
    "deviance": f"sign(fitted - pop) * sqrt(2 * greatest(pop * ln(greatest(pop / greatest(fitted, {EPS}), {EPS})) - (pop - fitted), 0))",
}


def _residuals(kind):
    def run(s, d):
        return res.residuals(px.fitted(s, d), px.population(s, d), kind).select("zone_id", "bracket", r4("residual"))

    run.__name__ = f"residuals_{kind}"
    return run


for _kind, _form in RESIDUAL.items():
    query(sql(f"SELECT zone_id, bracket, round({_form}, 4) AS residual FROM pop LEFT JOIN fit USING (zone_id, bracket)", OD, SRC, W, FIT, POP))(_residuals(_kind))

RES = "res AS (SELECT zone_id, bracket, fitted - pop AS r FROM pop LEFT JOIN fit USING (zone_id, bracket))"
_raw = lambda s, d: res.residuals(px.fitted(s, d), px.population(s, d))


@query(sql("""SELECT bracket, round(avg(r), 4) AS mean, round(sqrt(avg(r * r)), 4) AS rmse, round(max(abs(r)), 4) AS max_abs, round(100 * avg(CASE WHEN abs(r) > 2 * sd THEN 1.0 ELSE 0.0 END), 4) AS pct_beyond
  FROM (SELECT *, stddev_samp(r) OVER (PARTITION BY bracket) AS sd FROM res) GROUP BY ALL""", OD, SRC, W, FIT, POP, RES))
def residual_per_bracket(s, d):
    return res.residuals_by_bracket(_raw(s, d)).select("bracket", *[r4(c) for c in ("mean", "rmse", "max_abs", "pct_beyond")])


@query(sql("""SELECT zone_id, round(avg(r), 4) AS mean, round(sqrt(avg(r * r)), 4) AS rmse, (list(bracket ORDER BY abs(r) DESC, bracket))[1] AS worst_bracket FROM res GROUP BY ALL""", OD, SRC, W, FIT, POP, RES))
def residual_per_zone(s, d):
    return res.residuals_by_zone(_raw(s, d)).select("zone_id", r4("mean"), r4("rmse"), "worst_bracket")


@query(sql("SELECT round(sqrt(avg(r * r)), 4) AS rmse, round(avg(r), 4) AS bias, CAST(count(*) - count(r) AS BIGINT) AS n_null FROM res", OD, SRC, W, FIT, POP, RES))
def residual_overall(s, d):
    x = F.col("residual")
    return _raw(s, d).agg(F.round(F.sqrt(F.avg(x * x)), 4).alias("rmse"), F.round(F.avg(x), 4).alias("bias"), F.count_if(x.isNull()).alias("n_null"))


COLLAPSE = {"median": "median({0})", "mean": "avg({0})", "min": "min({0})", "max": "max({0})", "range": "max({0}) - min({0})", "rmse": "sqrt(avg({0} * {0}))", "mean_abs": "avg(abs({0}))", "max_abs": "max(abs({0}))"}


def _collapse(name, rows, value, how, weight=None):
    def run(s, d):
        return res.collapsed(rows(s, d), value, how, weight).select("zone_id", r4(how))

    run.__name__ = name
    return run


for _how in ("median", "mean", "min", "max", "range"):
    query(sql(f"SELECT zone_id, round({COLLAPSE[_how].format('alpha')}, 4) AS \"{_how}\" FROM alpha GROUP BY ALL", POP, ALPHA))(_collapse(f"collapse_alpha_{_how}", px.alpha, "alpha", _how))
for _how in ("rmse", "mean_abs", "max_abs", "mean"):
    query(sql(f"SELECT zone_id, round({COLLAPSE[_how].format('r')}, 4) AS \"{_how}\" FROM res GROUP BY ALL", OD, SRC, W, FIT, POP, RES))(_collapse(f"collapse_residuals_{_how}", _raw, "residual", _how))
query(sql('SELECT zone_id, round(sum(alpha * pop) / sum(pop), 4) AS weighted FROM alpha JOIN pop USING (zone_id, bracket) GROUP BY ALL', POP, ALPHA))(
    _collapse("collapse_alpha_pop_weighted", lambda s, d: px.alpha(s, d).join(px.population(s, d), ["zone_id", "bracket"]), "alpha", "weighted", "pop"))


@query(sql("SELECT zone_id, bracket, round(fitted / greatest(pop, 1), 6) AS rate FROM pop LEFT JOIN fit USING (zone_id, bracket)", OD, SRC, W, FIT, POP))
def implied_turnout(s, d):
    return res.implied_turnout(px.fitted(s, d), px.population(s, d)).select("zone_id", "bracket", F.round("rate", 6).alias("rate"))


@query(sql("SELECT bracket, round(avg(rate), 6) AS mean, round(median(rate), 6) AS median, round(max(rate), 6) AS max, round(avg(CASE WHEN rate > 1 THEN 1.0 ELSE 0.0 END), 6) AS above_1 FROM (SELECT bracket, fitted / greatest(pop, 1) AS rate FROM pop JOIN fit USING (zone_id, bracket)) GROUP BY ALL", OD, SRC, W, FIT, POP))
def turnout_by_bracket(s, d):
    r = F.col("rate")
    out = res.implied_turnout(px.fitted(s, d), px.population(s, d)).groupBy("bracket").agg(F.avg(r).alias("mean"), F.median(r).alias("median"), F.max(r).alias("max"), F.avg((r > 1).cast("double")).alias("above_1"))
    return out.select("bracket", *[F.round(c, 6).alias(c) for c in ("mean", "median", "max", "above_1")])


@query(sql("""SELECT "check", value, CASE WHEN value IS NULL THEN 'skip' WHEN "check" = 'alpha_variation' AND value < 0.1 THEN 'warn' WHEN "check" IN ('population_voter_gap') AND value > 20 OR "check" = 'unreachable_pairs' AND value > 10 THEN 'fail'
    WHEN "check" IN ('alpha_distribution', 'population_voter_gap', 'implied_turnout') AND value > 5 OR "check" = 'unreachable_pairs' AND value > 1 OR "check" = 'convergence' AND value > 0 OR "check" = 'representative_points' AND value > 50
    OR "check" = 'residual_bias' AND value / (SELECT sqrt(avg(r * r)) FROM res) > 0.1 THEN 'warn' ELSE 'pass' END AS status FROM (
  SELECT 'alpha_distribution' AS "check", round(100 * avg(CASE WHEN a > 2 THEN 1.0 ELSE 0.0 END), 4) AS value FROM zone_alpha
  UNION ALL SELECT 'residual_rmse', round(sqrt(avg(r * r)), 4) FROM res
  UNION ALL SELECT 'residual_bias', round(max(abs(m)), 4) FROM (SELECT avg(r) AS m FROM res GROUP BY bracket)
  UNION ALL SELECT 'population_voter_gap', round(100 * abs(p - c) / greatest(p, c), 4) FROM (SELECT sum(pop) AS p FROM pop), (SELECT sum(voters) AS c FROM src)
  UNION ALL SELECT 'unreachable_pairs', round(100 * avg(CASE WHEN minutes IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM od
  UNION ALL SELECT 'alpha_variation', round(stddev_samp(a) / avg(a), 4) FROM zone_alpha
  UNION ALL SELECT 'implied_turnout', round(100 * avg(CASE WHEN f / p > 1.1 THEN 1.0 ELSE 0.0 END), 4) FROM (SELECT sum(fitted) AS f, sum(pop) AS p FROM pop LEFT JOIN fit USING (zone_id, bracket) GROUP BY zone_id)
  UNION ALL SELECT 'convergence', 0.0
  UNION ALL SELECT 'representative_points', round(100 * avg(CASE WHEN n_nationkey % 4 = 0 THEN 0.0 ELSE 1.0 END), 4) FROM nation)""", OD, SRC, W, FIT, POP, ALPHA, RES, "zone_alpha AS (SELECT zone_id, median(alpha) AS a FROM alpha GROUP BY 1)"))
def diagnostics_checks(s, d):
    """All nine checks, with a history whose last epoch converged and clusters of which one zone in four has roads."""
    history = _history(s).select("epoch", (F.col("epoch") == 1000).alias("converged"))
    clusters = px.zones(s, d).select("zone_id", (F.col("zone_id") % 4 == 0).alias("has_roads"))
    out = dg.checks(px.fitted(s, d), px.population(s, d), px.voters(s, d), px.od(s, d), px.alpha(s, d), history, clusters, 2.0)
    return out.select("check", r4("value"), "status")


@query(sql("SELECT variable, round(sum(value), 3) AS total, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most FROM (SELECT zone_id, variable, sum(w * value) AS value FROM w JOIN vals USING (source_id) GROUP BY ALL) GROUP BY ALL", OD, W, VALUES))
def variable_summary(s, d):
    return res.summary(wt.interpolated(px.source_weights(s, d), _values(s, d))).select("variable", F.round("total", 3).alias("total"), *[r4(c) for c in ("mean", "least", "most")])


@query(sql("SELECT round(quantile_cont(alpha, 0), 4) AS q0, round(quantile_cont(alpha, 0.25), 4) AS q25, round(quantile_cont(alpha, 0.5), 4) AS q50, round(quantile_cont(alpha, 0.75), 4) AS q75, round(quantile_cont(alpha, 1), 4) AS q100 FROM alpha", POP, ALPHA))
def alpha_quantiles(s, d):
    return px.alpha(s, d).agg(*[F.round(F.percentile("alpha", F.lit(q / 100)), 4).alias(f"q{q}") for q in (0, 25, 50, 75, 100)])


def _income(s, d):
    return table(s, d, "customer").groupBy(F.col("c_nationkey").alias("zone_id")).agg(F.avg("c_acctbal").alias("income"))


INCOME = "income AS (SELECT c_nationkey AS zone_id, avg(c_acctbal) AS income FROM customer GROUP BY ALL)"
TOTALS = "tot AS (SELECT zone_id, sum(fitted) AS y FROM fit GROUP BY ALL)"
_totals = lambda s, d: px.fitted(s, d).groupBy("zone_id").agg(F.sum("fitted").alias("y"))


@query(sql("""SELECT round(corr(income, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM (
  SELECT income, y, rank() OVER (ORDER BY income) + (count(*) OVER (PARTITION BY income) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry
  FROM tot JOIN income USING (zone_id) WHERE income > 0)""", OD, SRC, W, FIT, INCOME, TOTALS))
def income_correlation(s, d):
    both = _totals(s, d).join(_income(s, d), "zone_id", "left").filter("income > 0")
    return sp.correlations(both, "income", "y").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "n")


@query(sql("SELECT round(regr_slope(y, income), 6) AS slope, round(regr_intercept(y, income), 3) AS intercept FROM tot JOIN income USING (zone_id)", OD, SRC, W, FIT, INCOME, TOTALS))
def regression_line(s, d):
    both = _totals(s, d).join(_income(s, d), "zone_id")
    return both.agg(F.round(F.regr_slope("y", "income"), 6).alias("slope"), F.round(F.regr_intercept("y", "income"), 3).alias("intercept"))


def _by_status(s, d, status):
    values = table(s, d, "lineitem").filter(F.col("l_linestatus") == status).groupBy(F.col("l_suppkey").alias("source_id")).agg(F.sum("l_quantity").alias("value")).withColumn("variable", F.lit("v"))
    out = wt.interpolated(px.source_weights(s, d), values)
    return out.join(F.broadcast(out.agg(F.sum("value").alias("all"))), how="cross").select("zone_id", (F.col("value") / F.col("all")).alias(f"share_{status}".lower()))


def _share_sql(status):
    return f"""sh_{status} AS (SELECT zone_id, sum(w * v) / sum(sum(w * v)) OVER () AS share_{status} FROM w JOIN (SELECT l_suppkey AS source_id, sum(l_quantity) AS v FROM lineitem WHERE l_linestatus = '{status.upper()}' GROUP BY 1) USING (source_id) GROUP BY ALL)"""


@query(sql("SELECT round(corr(share_o, share_f), 6) AS pearson, count(*) AS n FROM sh_o JOIN sh_f USING (zone_id)", OD, W, _share_sql("o"), _share_sql("f")))
def cross_election(s, d):
    return _by_status(s, d, "O").join(_by_status(s, d, "F"), "zone_id").agg(F.round(F.corr("share_o", "share_f"), 6).alias("pearson"), F.count(F.lit(1)).alias("n"))


# travel time and weight tables


@query(sql("""SELECT CAST(least(50, floor((minutes - lo) / (hi - lo) * 50) + 1) AS INTEGER) AS bin, count(*) AS n FROM od, (SELECT min(minutes) AS lo, max(minutes) AS hi FROM od) WHERE minutes IS NOT NULL GROUP BY ALL""", OD))
def travel_time_histogram(s, d):
    return times.histogram(px.od(s, d), F.col("minutes"), 50)


@query(sql("SELECT count(*) - count(minutes) AS n_null, max(minutes) AS most, count(*) FILTER (minutes >= (SELECT max(minutes) FROM od) - 0.1) AS n_near_most FROM od", OD))
def travel_time_stats(s, d):
    return times.extremes(px.od(s, d))


def _rounded_weights(s, d):
    """Weights rounded so that ties are ties in every engine."""
    return px.source_weights(s, d).withColumn("w", F.round("w", 10))


WR = "wr AS (SELECT zone_id, source_id, round(w, 10) AS w FROM w)"
RANKED = "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY zone_id ORDER BY w DESC, source_id) AS INTEGER) AS rank FROM wr)"


@query(sql("""SELECT zone_id, max(source_id) FILTER (rank = 1) AS dominant_source, round(max(w) FILTER (rank = 1), 6) AS dominant_weight, round(sum(w) FILTER (rank <= 3), 6) AS top3_weight,
  round(sum(w * minutes), 4) AS weighted_minutes, round(sum(w * minutes) / sum(w), 4) AS weighted_minutes_norm, round(any_value(h), 6) AS entropy, round(exp(any_value(h)), 4) AS effective_n, round(any_value(hhi), 6) AS herfindahl
  FROM ranked JOIN od USING (zone_id, source_id) JOIN ent USING (zone_id) GROUP BY ALL""", OD, W, WR, RANKED, ENTROPY))
def weight_summary(s, d):
    out = dg.weight_summary(_rounded_weights(s, d), px.od(s, d))
    digits = {"dominant_weight": 6, "top3_weight": 6, "weighted_minutes": 4, "weighted_minutes_norm": 4, "entropy": 6, "effective_n": 4, "herfindahl": 6}
    return out.select("zone_id", "dominant_source", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(sql("SELECT zone_id, source_id, rank, round(w, 6) AS w FROM ranked WHERE w > 0.001 AND rank <= 4", OD, W, WR, RANKED))
def connections_topk(s, d):
    return dg.connections(_rounded_weights(s, d), 0.001, 4).select("zone_id", "source_id", "rank", F.round("w", 6).alias("w"))


@query(sql("SELECT zone_id, source_id FROM ranked WHERE rank = 1", OD, W, WR, RANKED))
def connections_dominant(s, d):
    return dg.connections(_rounded_weights(s, d), 0.0, 1).select("zone_id", "source_id")


@query(sql("SELECT zone_id, source_id, rank, round(sum(w) OVER (PARTITION BY zone_id ORDER BY rank ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM ranked QUALIFY rank <= 5", OD, W, WR, RANKED))
def cumulative_top5(s, d):
    return dg.cumulative(_rounded_weights(s, d)).select("zone_id", "source_id", "rank", F.round("cumulative", 6).alias("cumulative"))


@query("SELECT n_nationkey AS zone_id, CAST(CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY v IS NULL ORDER BY v DESC) END AS INTEGER) AS rank FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 7 > 0 THEN n_nationkey % 5 END AS v FROM nation)")
def rank_min_ties(s, d):
    v = F.when(F.col("zone_id") % 7 > 0, F.col("zone_id") % 5)
    return dg.min_ranks(px.zones(s, d).withColumn("v", v), "v").select("zone_id", "rank")


@query("""WITH c AS (SELECT CAST(l_suppkey % 53 AS VARCHAR) AS dominant, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT dominant FROM c ORDER BY n DESC, dominant LIMIT 19)
  SELECT CASE WHEN dominant IN (SELECT dominant FROM t) THEN dominant ELSE 'Other' END AS dominant, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def dominant_top19_other(s, d):
    return dg.frequent_or_other(table(s, d, "lineitem").select((F.col("l_suppkey") % 53).alias("dominant")), "dominant")


@query(sql("SELECT zone_id, place, source_id, minutes FROM od JOIN places USING (zone_id)", OD, "places AS (SELECT n_nationkey AS zone_id, CAST(row_number() OVER (ORDER BY n_nationkey // 5, n_nationkey) AS INTEGER) AS place FROM nation)"))
def heatmap_order(s, d):
    """Tiles of all zones and sources, zones in order of the latitude of their centre."""
    order = px.unit_squares(s, d).select("zone_id", sp.centroid(F.col("ring"))["y"].alias("lat"), F.lit(1).alias("one"))
    place = dg.running(order, [F.col("lat"), F.col("zone_id")], "one", "before").select("zone_id", (F.col("before") + 1).cast("int").alias("place"))
    return px.od(s, d).join(place, "zone_id").select("zone_id", "place", "source_id", "minutes")


@query(sql("""SELECT source_id, round(sum(w), 6) AS total, count(*) FILTER (rank = 1) AS n_dominant, round(sum(w * minutes) / sum(w), 4) AS mean_minutes, round(sum(w) / sum(sum(w)) OVER (), 6) AS share
  FROM ranked JOIN od USING (zone_id, source_id) GROUP BY ALL""", OD, W, WR, RANKED))
def station_summary(s, d):
    out = dg.source_summary(_rounded_weights(s, d), px.od(s, d))
    return out.select("source_id", F.round("total", 6).alias("total"), "n_dominant", r4("mean_minutes"), F.round("share", 6).alias("share"))


@query(sql("SELECT zone_id FROM ent ORDER BY round(h, 9) DESC, zone_id LIMIT 1", OD, W, ENTROPY))
def default_catchment(s, d):
    return dg.default_zone(px.source_weights(s, d))


@query(sql("""SELECT zone_id, '{"source_id":' || source_id || ',"w":"' || printf('%.6f', w) || '","minutes":' || CASE WHEN minutes IS NULL THEN 'null' ELSE '"' || printf('%.1f', minutes) || '"' END || ',"rank":' || rank || '}' AS json
  FROM ranked JOIN od USING (zone_id, source_id) WHERE w > 0 AND rank <= 3""", OD, W, WR, RANKED))
def connections_json(s, d):
    rows = dg.connections(_rounded_weights(s, d), 0.0, 3).join(px.od(s, d), ["zone_id", "source_id"])
    return rows.select("zone_id", dg.json_row("source_id", w=F.format_string("%.6f", "w"), minutes=F.when(F.col("minutes").isNotNull(), F.format_string("%.1f", "minutes")), rank=F.col("rank")).alias("json"))


@query(sql("SELECT source_id, rank, zone_id, round(w, 6) AS w, minutes FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY w DESC, zone_id) AS INTEGER) AS rank FROM wr) JOIN od USING (zone_id, source_id) WHERE rank <= 10", OD, W, WR))
def station_top_zones(s, d):
    return dg.top_zones(_rounded_weights(s, d), px.od(s, d)).select("source_id", "rank", "zone_id", F.round("w", 6).alias("w"), "minutes")


SPREAD = "q AS (SELECT bracket, count(alpha) AS n, quantile_cont(alpha, [0, 0.25, 0.5, 0.75, 1]) AS q FROM alpha GROUP BY 1)"


@query(sql("""SELECT bracket, any_value(n) AS n, any_value(q[1]) AS q0, any_value(q[2]) AS q25, any_value(q[3]) AS q50, any_value(q[4]) AS q75, any_value(q[5]) AS q100, min(alpha) FILTER (ok) AS low, max(alpha) FILTER (ok) AS high,
  count(*) FILTER (NOT ok) AS n_outside FROM (SELECT *, alpha BETWEEN q[2] - 1.5 * (q[4] - q[2]) AND q[4] + 1.5 * (q[4] - q[2]) AS ok FROM alpha JOIN q USING (bracket)) GROUP BY bracket""", POP, ALPHA, SPREAD))
def alpha_spread(s, d):
    """What the box plot of alpha by bracket shows."""
    return times.spread(px.alpha(s, d), F.col("alpha"), ["bracket"])


@query("""WITH v AS (SELECT CAST(c_nationkey AS DOUBLE) AS v FROM customer), s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM v),
  p AS (SELECT lo - 3 * h + i / 49.0 * (hi - lo + 6 * h) AS x, h, n FROM s, range(0, 50) t(i))
  SELECT round(x, 6) AS x, round(sum(c * exp(-pow((x - v) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM p, (SELECT v, count(*) AS c FROM v GROUP BY 1) GROUP BY x""")
def value_density(s, d):
    """A density curve over values that repeat, each in a bin of its own."""
    out = times.density(table(s, d, "customer"), F.col("c_nationkey"), 50)
    return out.select(F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


# spatial statistics on the grid of unit squares

NB = """nb AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey
  AND abs(a.n_nationkey % 5 - b.n_nationkey % 5) <= 1 AND abs(a.n_nationkey // 5 - b.n_nationkey // 5) <= 1)"""
LAG = f"""val AS (SELECT c_nationkey AS zone_id, CAST(count(*) AS DOUBLE) AS value FROM customer GROUP BY 1),
  zs AS (SELECT zone_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM val), {NB},
  lg AS (SELECT zs.zone_id, any_value(zs.z) AS z, avg(o.z) AS lag FROM zs JOIN nb ON zs.zone_id = nb.a JOIN zs o ON nb.b = o.zone_id GROUP BY zs.zone_id)"""


def _lag(s, d):
    values = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("zone_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return sp.lagged(values, sp.neighbours(px.unit_squares(s, d)))


@query(sql("SELECT a, b FROM nb", NB))
def queen_neighbours(s, d):
    return sp.neighbours(px.unit_squares(s, d))


@query(sql("SELECT round(sum(z * lag) / sum(z * z), 6) AS moran_i, count(*) AS n FROM lg", LAG))
def morans_i(s, d):
    return sp.morans_i(_lag(s, d)).select(F.round("moran_i", 6).alias("moran_i"), "n")


@query(sql("SELECT zone_id, round(z * lag, 6) + 0.0 AS local_i, CASE WHEN round(z, 12) >= 0 AND round(lag, 12) >= 0 THEN 'HH' WHEN round(z, 12) < 0 AND round(lag, 12) < 0 THEN 'LL' WHEN round(z, 12) >= 0 THEN 'HL' ELSE 'LH' END AS quadrant FROM lg", LAG))
def lisa_quadrants(s, d):
    return sp.quadrants(_lag(s, d)).select("zone_id", (F.round("local_i", 6) + 0.0).alias("local_i"), "quadrant")


@query()
def lisa_permutation(s, d):
    return sp.permutation_p(_lag(s, d))


@query("SELECT n_nationkey AS zone_id, n_nationkey % 5 + 0.5 AS x, CAST(n_nationkey // 5 + 0.5 AS DOUBLE) AS y, 1.0 AS area FROM nation".replace("n_nationkey % 5 + 0.5", "CAST(n_nationkey % 5 + 0.5 AS DOUBLE)").replace("1.0 AS", "CAST(1 AS DOUBLE) AS"))
def rep_point_centroid(s, d):
    c = sp.centroid(F.col("ring"))
    return px.unit_squares(s, d).select("zone_id", F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"), F.round(F.abs(sp.signed_area(F.col("ring"))), 6).alias("area"))


ROADS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "residential", "living_street", "unclassified", "service", "track", "path", "footway"]


@query(f"""SELECT highway, CAST(CASE WHEN highway IN ('primary', 'primary_link', 'secondary', 'secondary_link', 'tertiary', 'tertiary_link', 'residential', 'living_street') THEN 1 WHEN highway IN ('unclassified', 'service') THEN 2 ELSE 3 END AS INTEGER) AS tier,
  count(*) AS n FROM (SELECT ({ROADS})[p_partkey % 17 + 1] AS highway FROM part) GROUP BY ALL""")
def road_tier(s, d):
    highway = F.element_at(F.array(*[F.lit(r) for r in ROADS]), (F.col("p_partkey") % len(ROADS) + 1).cast("int"))
    return table(s, d, "part").groupBy(highway.alias("highway")).agg(F.count(F.lit(1)).alias("n")).select("highway", sp.road_tier(F.col("highway")).alias("tier"), "n")


def _cells(s, d):
    """Populated cells: a grid of 20 by 20 for each nation, empty where a rule says so."""
    k = F.col("c_custkey")
    cells = table(s, d, "customer").select(F.col("c_nationkey").alias("zone_id"), (k % 20).cast("int").alias("cx"), (F.floor(k / 20) % 20).cast("int").alias("cy"))
    return cells.groupBy("zone_id", "cx", "cy").agg(F.count(F.lit(1)).cast("double").alias("pop"))


CELLS = "cells AS (SELECT c_nationkey AS zone_id, c_custkey % 20 AS cx, c_custkey // 20 % 20 AS cy, CAST(count(*) AS DOUBLE) AS pop FROM customer GROUP BY ALL)"
def _whole_patches(sql_text):
    """The recursive parts go first: every pair of cells that reach each other, and the least of them."""
    closure = """WITH RECURSIVE cells AS (SELECT c_nationkey AS zone_id, c_custkey % 20 AS cx, c_custkey // 20 % 20 AS cy, CAST(count(*) AS DOUBLE) AS pop FROM customer GROUP BY ALL),
  reach AS (SELECT zone_id, cx, cy, cy * 20 + cx AS root FROM cells UNION SELECT c.zone_id, c.cx, c.cy, r.root FROM reach r JOIN cells c ON c.zone_id = r.zone_id AND abs(c.cx - r.cx) <= 1 AND abs(c.cy - r.cy) <= 1),
  labelled AS (SELECT zone_id, cx, cy, CAST(dense_rank() OVER (PARTITION BY zone_id ORDER BY min(root)) AS INTEGER) AS patch FROM reach GROUP BY zone_id, cx, cy) """
    return closure + sql_text


@query(_whole_patches("SELECT zone_id, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy, pop, patch FROM labelled JOIN cells USING (zone_id, cx, cy)"))
def patch_label(s, d):
    return sp.patches(_cells(s, d))


@query(_whole_patches("""SELECT zone_id, patch, total AS patch_pop, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy FROM (
  SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY total DESC, patch, pop DESC, cy, cx) AS n FROM (SELECT *, sum(pop) OVER (PARTITION BY zone_id, patch) AS total FROM labelled JOIN cells USING (zone_id, cx, cy))) WHERE n = 1"""))
def best_patch(s, d):
    return sp.best_cells(sp.patches(_cells(s, d)))


STEP = 0.001


def _placed_cells(s, d):
    return _cells(s, d).withColumns({"x": F.col("zone_id") + F.col("cx") * STEP, "y": F.col("cy") * STEP})


def _road_segments(s, d):
    """Of each zone but every fourth a road along a row of cells and one along a column, each of a tier."""
    z = F.col("zone_id")
    east = px.zones(s, d).filter(z % 4 > 0).select("zone_id", (z % 3 + 1).cast("int").alias("tier"), (z - 0.01).alias("x1"), (z % 20 * STEP).alias("y1"), (z + 0.03).alias("x2"), (z % 20 * STEP).alias("y2"))
    x = z + z * 7 % 20 * STEP
    north = px.zones(s, d).filter(z % 4 > 0).select("zone_id", ((z + 1) % 3 + 1).cast("int").alias("tier"), x.alias("x1"), F.lit(-0.01).alias("y1"), x.alias("x2"), F.lit(0.03).alias("y2"))
    return east.unionByName(north)


@query(_whole_patches("""SELECT zone_id, patch, total AS patch_pop, n_patches, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy, pop, tier IS NOT NULL AS near_road, CAST(tier AS INTEGER) AS tier FROM (
  SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY total DESC, patch, coalesce(tier, 9), pop DESC, cy, cx) AS n FROM (
    SELECT *, sum(pop) OVER (PARTITION BY zone_id, patch) AS total, max(patch) OVER (PARTITION BY zone_id) AS n_patches,
      CASE WHEN zone_id % 4 > 0 THEN least(CASE WHEN abs(cy - zone_id % 20) <= 1 THEN zone_id % 3 + 1 END, CASE WHEN abs(cx - zone_id * 7 % 20) <= 1 THEN (zone_id + 1) % 3 + 1 END) END AS tier
    FROM labelled JOIN cells USING (zone_id, cx, cy))) WHERE n = 1"""))
def rep_point_weighted(s, d):
    """The cell that stands for each zone: of the most populous patch, near a road of the best tier, the most populous. Cells are 111 m apart and roads reach 200 m."""
    cells = _placed_cells(s, d)
    out = geo.weighted_points(sp.patches(cells), geo.near_roads(cells, _road_segments(s, d)))
    return out.select("zone_id", "patch", "patch_pop", "n_patches", "cx", "cy", "pop", "near_road", "tier")


_EDGES = """edges AS (SELECT code_tract, unnest(list_transform(range(1, len(r) + 1), lambda i: {'a': r[i], 'b': r[CASE WHEN i = len(r) THEN 1 ELSE i + 1 END]})) AS e FROM (SELECT code_tract, unnest(rings) AS r FROM tracts_sf)),
  ends AS (SELECT DISTINCT code_tract, e.a.y AS y FROM edges),
  lev AS (SELECT code_tract, (max(y) FILTER (y <= m) + min(y) FILTER (y > m)) / 2 AS y FROM (SELECT *, (min(y) OVER (PARTITION BY code_tract) + max(y) OVER (PARTITION BY code_tract)) / 2 AS m FROM ends) GROUP BY 1),
  hits AS (SELECT code_tract, lev.y, (e.b.x - e.a.x) * (lev.y - e.a.y) / (e.b.y - e.a.y) + e.a.x AS x FROM edges JOIN lev USING (code_tract) WHERE (e.a.y > lev.y) <> (e.b.y > lev.y)),
  stretch AS (SELECT *, row_number() OVER (PARTITION BY code_tract ORDER BY x) AS n, lead(x) OVER (PARTITION BY code_tract ORDER BY x) AS x2 FROM hits)"""


@query(sql("SELECT code_tract, round((x + x2) / 2, 6) AS x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY code_tract ORDER BY x2 - x DESC, x) AS best FROM stretch WHERE n % 2 = 1) WHERE best = 1", _EDGES))
def rep_point_surface(s, d):
    """A point inside every tract: the middle of the widest stretch inside along its middle level."""
    out = geo.representative_points(table(s, d, "tracts_sf"), "point_on_surface", key="code_tract")
    return out.select("code_tract", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _lines(s, d):
    """A line of two segments for each supplier, somewhere over the grid of unit squares."""
    k = F.col("s_suppkey")
    at = lambda a, b: F.struct((k * a % 611 / 100.0 - 0.5003).alias("x"), (k * b % 617 / 100.0 - 0.5007).alias("y"))
    return table(s, d, "supplier").select(k.alias("line_id"), F.array(at(7, 11), at(13, 17), at(19, 23)).alias("points"))


@query("""WITH p AS (SELECT s_suppkey AS line_id, unnest([{'a': {'x': s_suppkey * 7 % 611 / 100.0 - 0.5003, 'y': s_suppkey * 11 % 617 / 100.0 - 0.5007}, 'b': {'x': s_suppkey * 13 % 611 / 100.0 - 0.5003, 'y': s_suppkey * 17 % 617 / 100.0 - 0.5007}},
    {'a': {'x': s_suppkey * 13 % 611 / 100.0 - 0.5003, 'y': s_suppkey * 17 % 617 / 100.0 - 0.5007}, 'b': {'x': s_suppkey * 19 % 611 / 100.0 - 0.5003, 'y': s_suppkey * 23 % 617 / 100.0 - 0.5007}}]) AS s FROM supplier),
  z AS (SELECT n_nationkey AS region, n_nationkey % 5 AS x0, n_nationkey // 5 AS y0 FROM nation),
  c AS (SELECT line_id, region, s.a.x AS ax, s.a.y AS ay, s.b.x - s.a.x AS dx, s.b.y - s.a.y AS dy, x0, y0 FROM p, z),
  t AS (SELECT *, CASE WHEN dx = 0 THEN CASE WHEN ax BETWEEN x0 AND x0 + 1 THEN 0.0 ELSE 2.0 END ELSE least((x0 - ax) / dx, (x0 + 1 - ax) / dx) END AS tx0, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((x0 - ax) / dx, (x0 + 1 - ax) / dx) END AS tx1,
    CASE WHEN dy = 0 THEN CASE WHEN ay BETWEEN y0 AND y0 + 1 THEN 0.0 ELSE 2.0 END ELSE least((y0 - ay) / dy, (y0 + 1 - ay) / dy) END AS ty0, CASE WHEN dy = 0 THEN 1.0 ELSE greatest((y0 - ay) / dy, (y0 + 1 - ay) / dy) END AS ty1 FROM c)
  SELECT DISTINCT line_id, region FROM t WHERE greatest(tx0, ty0, 0) <= least(tx1, ty1, 1)""")
def roads_in_zones(s, d):
    cover = cut_lineage(proximity.cover_regions(px.unit_squares(s, d), "zone_id", "rings"))
    return geo.lines_in_regions(_lines(s, d), cover)


@query(sql("""SELECT zone_id, round(share, 6) AS share, round(pop * share, 6) AS pop FROM (SELECT zone_id, pop, greatest(least(x + 1, 3.5) - greatest(x, 0.5), 0) * greatest(least(y + 1, 4.6) - greatest(y, 0.25), 0)
  - greatest(least(x + 1, 2.7) - greatest(x, 1.2), 0) * greatest(least(y + 1, 3.3) - greatest(y, 1.1), 0) AS share FROM (SELECT n_nationkey AS zone_id, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation) JOIN (SELECT zone_id, sum(pop) AS pop FROM pop GROUP BY 1) USING (zone_id)) WHERE share > 1e-9""", POP))
def zones_clipped(s, d):
    """Zones clipped to a town's outline with a hole, their people by the share of their area that stays."""
    ring = lambda a, b, c, e: [(a, b), (c, b), (c, e), (a, e)]
    zones = px.unit_squares(s, d).join(px.population(s, d).groupBy("zone_id").agg(F.sum("pop").cast("double").alias("pop")), "zone_id")
    out = geo.clipped(zones, [ring(0.5, 0.25, 3.5, 4.6), ring(1.2, 1.1, 2.7, 3.3)], ["pop"])
    return out.filter("share > 1e-9").select("zone_id", F.round("share", 6).alias("share"), F.round("pop", 6).alias("pop"))


@query("SELECT n_nationkey AS region, count(*) AS n FROM nation, (SELECT c_custkey, (c_custkey * 7 % 1000) / 200.0 + 0.0005 AS x, (c_custkey * 13 % 1000) / 200.0 + 0.0005 AS y FROM customer) WHERE floor(x) = n_nationkey % 5 AND floor(y) = n_nationkey // 5 GROUP BY ALL")
def point_in_zone(s, d):
    k = F.col("c_custkey")
    points = table(s, d, "customer").select(k.alias("id"), ((k * 13 % 1000) / 200 + 0.0005).alias("lat"), ((k * 7 % 1000) / 200 + 0.0005).alias("lon"))
    cover = cut_lineage(proximity.cover_regions(px.unit_squares(s, d), "zone_id", "rings"))
    return proximity.points_in_regions(points, cover).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(min(x) - 20 / 111.0 / cos(radians((min(y) + max(y)) / 2)), 6) AS x0, round(min(y) - 20 / 111.0, 6) AS y0, round(max(x) + 20 / 111.0 / cos(radians((min(y) + max(y)) / 2)), 6) AS x1, round(max(y) + 20 / 111.0, 6) AS y1 FROM (SELECT long AS x, lat AS y FROM geocode_locs WHERE lat <> -1 AND long <> -1)")
def bbox_buffer(s, d):
    points = table(s, d, "geocode_locs").filter("lat <> -1 AND long <> -1").select(F.col("long").alias("x"), F.col("lat").alias("y"))
    return sp.buffered_box(points, 20).select(*[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(sql("""SELECT zone_id, CAST(CASE WHEN pop <= q[2] THEN 1 WHEN pop <= q[3] THEN 2 WHEN pop <= q[4] THEN 3 WHEN pop <= q[5] THEN 4 ELSE 5 END AS INTEGER) AS class FROM (SELECT zone_id, sum(pop) AS pop FROM pop GROUP BY 1),
  (SELECT arg_min(r, n) AS q FROM (SELECT n, list_transform(q, lambda x: round(x, CAST(n - 1 - floor(log10(abs(x))) AS INTEGER))) AS r, q FROM (SELECT quantile_cont(pop, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM (SELECT sum(pop) AS pop FROM pop GROUP BY zone_id)), range(3, 9) t(n))
    WHERE len(list_distinct(r)) = len(list_distinct(q)))""", POP))
def quantile_bins(s, d):
    totals = px.population(s, d).groupBy("zone_id").agg(F.sum("pop").alias("pop"))
    return totals.select("zone_id", brk.classed(F.col("pop"), brk.breaks(totals, "pop", "quantile", 5)).cast("int").alias("class"))


# fits


def _problems(s, d):
    """One problem per region: its nations as zones, and their suppliers."""
    nation = table(s, d, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("problem_id"))
    home = px.sources(s, d).join(nation.withColumnRenamed("zone_id", "s_nationkey"), "s_nationkey").select("source_id", F.col("problem_id").alias("p"))
    o = px.od(s, d).join(nation, "zone_id").join(home, "source_id").filter("p = problem_id").drop("p")
    return o, px.population(s, d).join(nation, "zone_id"), px.voters(s, d).join(home.withColumnRenamed("p", "problem_id"), "source_id")


@query()
def fit_alpha(s, d):
    return ft.fit_problems(*_problems(s, d), ft.Control()).select("problem_id", "zone_id", "bracket", r4("alpha"), "epochs", "converged")


@query()
def fit_target_eff_src(s, d):
    return ft.fit_problems(*_problems(s, d), ft.Control(target_sources=4.0)).select("problem_id", "zone_id", "bracket", r4("alpha"), "epochs", "converged")


@query(sql("SELECT 'minutes' AS table_name, count(*) - count(minutes) AS n_null, count(*) FILTER (isnan(minutes)) AS n_nan, count(*) FILTER (minutes < 0) AS n_negative FROM od", OD))
def input_validation(s, d):
    od = px.od(s, d)
    wt.check_od(od, "power", 1.0)
    return wt.faults(od).select(F.lit("minutes").alias("table_name"), "n_null", "n_nan", "n_negative")


@query(sql("SELECT zone_id, source_id, minutes + 1 AS minutes FROM od", OD))
def offset_apply(s, d):
    return wt.with_offset(px.od(s, d), 1.0).select("zone_id", "source_id", "minutes")


@query(sql("SELECT zone_id, name, round(sum(fitted), 4) AS fitted FROM fit JOIN zones USING (zone_id) GROUP BY ALL", OD, SRC, W, FIT, ZONES))
def export_table(s, d):
    flat = px.unit_squares(s, d).drop("ring", "rings")
    return flat.join(px.fitted(s, d).groupBy("zone_id").agg(F.round(F.sum("fitted"), 4).alias("fitted")), "zone_id")


@query("SELECT r_name AS region, round(sum(c_acctbal), 2) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def areal_aggregation(s, d):
    """Zone values summed to larger areas."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    values = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("v"))
    return values.join(n, "n_nationkey").join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("region")).agg(F.round(F.sum("v"), 2).alias("value"))


@query("SELECT n_nationkey AS zone_id, CASE WHEN n_nationkey % 2 = 0 THEN 'pop_hom_18_20' ELSE 'pop_mul_60_mais' END AS bracket, CASE WHEN n_nationkey % 2 = 0 THEN 'Male 18-20' ELSE 'Female 60+' END AS label FROM nation")
def bracket_labels(s, d):
    b = F.when(F.col("zone_id") % 2 == 0, "pop_hom_18_20").otherwise("pop_mul_60_mais")
    return px.zones(s, d).select("zone_id", b.alias("bracket")).withColumn("label", text.bracket_label(F.col("bracket")))
