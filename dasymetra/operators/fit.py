"""Fitting distance decay: one zone-by-bracket alpha per problem, by Adam on the Poisson deviance."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Control:
    """Settings of a fit. alpha_min None: 1 for the power kernel, 0 for the exponential one. target_sources sets the entropy weight by dual ascent."""

    max_epochs: int = 50_000
    rate: float = 0.05
    tol: float = 1e-6
    patience: int = 50
    alpha_init: float = 2.0
    alpha_min: float | None = None
    barrier: float = 1.0
    entropy: float = 0.0
    target_sources: float | None = None
    kernel: str = "power"
    offset: float = 1.0
    seed: int = 1

    def __post_init__(self):
        if self.kernel not in ("power", "exponential"):
            raise ValueError("kernel must be power or exponential")
        for name in ("max_epochs", "rate", "tol", "patience"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be above 0")
        if self.barrier < 0 or self.entropy < 0 or self.offset < 0:
            raise ValueError("barrier, entropy and offset must not be negative")
        if self.target_sources is not None and self.target_sources < 1:
            raise ValueError("target_sources must be 1 or more")

    @property
    def lowest(self) -> float:
        return self.alpha_min if self.alpha_min is not None else 1.0 if self.kernel == "power" else 0.0


#: Numbers of zones times sources times brackets that one problem may have in a single task.
MOST_ELEMENTS = 25_000_000
#: Problems whose sizes the driver holds; of more, the smaller ones go to tasks by a hash.
MOST_APART = 10_000
HISTORY = ["epoch", "loss", "deviance", "gradient", "sources", "entropy", "converged"]


def weights_of(alpha: np.ndarray, phi: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Weights (bracket, zone, source) that sum to 1 over zones; 0 where a pair has no time."""
    w = np.multiply(-alpha.T[:, :, None], phi)
    if not mask.all():
        w[:, ~mask] = -np.inf
    top = w.max(axis=1, keepdims=True)
    np.subtract(w, np.where(np.isfinite(top), top, 0.0), out=w)
    np.exp(w, out=w)
    total = w.sum(axis=1, keepdims=True)
    np.divide(w, np.where(total > 0, total, 1.0), out=w)
    return w


def times_sources(w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(zone, bracket) sums over sources of weights times a number for each (bracket, source)."""
    return np.matmul(w, c[:, :, None])[:, :, 0].T


def forward(alpha: np.ndarray, phi: np.ndarray, mask: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bracket, zone, source) that sum to 1 over zones, and fitted (zone, bracket)."""
    w = weights_of(alpha, phi, mask)
    return w, times_sources(w, c)


def backward(w: np.ndarray, phi: np.ndarray, c: np.ndarray, dv: np.ndarray, share: np.ndarray | None = None, dagg: np.ndarray | None = None) -> np.ndarray:
    """Gradient by alpha (zone, bracket) of a loss that changes by dv (zone, bracket) with what is fitted, and by dagg (zone, source) with the weights aggregated by share.

    A weight's change spreads over its source as w (d - mean d), so the sums over sources are products of matrices; no array of the weights' changes is made.
    """
    mean = np.matmul(dv.T[:, None, :], w)[:, 0, :] * c
    if dagg is not None:
        mean = mean + np.einsum("bij,ij->bj", w, dagg, optimize=True) * share
    np.multiply(w, phi, out=w)
    both = np.matmul(w, np.stack([c, mean], axis=2))
    grad = dv * both[:, :, 0].T - both[:, :, 1].T
    if dagg is not None:
        grad = grad + np.einsum("bij,ij,bj->ib", w, dagg, share, optimize=True)
    return -grad


def loss_and_gradient(alpha, phi, mask, c, pop, barrier, entropy, pull=None):
    """(loss, deviance, gradient by alpha, effective sources): the gradient is exact, the entropy's share included.

    pull: (strength, target) of a quadratic penalty on the mean entropy's distance from the target.
    """
    return evaluator(phi, mask, c, pop, barrier)(alpha, entropy, pull)


def _columns(phi: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(column, slot) of each source, how many columns, how many slots each has: a column holds sources with the same times to all zones.

    The number of slots is the one that makes columns, of which each has weights of its own, and empty slots cheap together.
    """
    place = np.unique(np.vstack([phi, mask]), axis=1, return_inverse=True)[1].ravel()
    sizes = np.bincount(place)
    width = min({int(k) for k in np.geomspace(1, sizes.max(initial=1), 100)}, key=lambda k: (int(-(-sizes // k).sum()) * (8 + k), k))
    order, taken = np.argsort(place, kind="stable"), -(-sizes // width)
    rank = np.empty(len(place), dtype=int)
    rank[order] = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (np.cumsum(taken) - taken)[place] + rank // width, rank % width, int(taken.sum()), width


def evaluator(phi: np.ndarray, mask: np.ndarray, c: np.ndarray, pop: np.ndarray, barrier: float):
    """``evaluate(alpha, entropy, pull)`` of one problem, see ``loss_and_gradient``.

    Sources with the same times have the same weights, so weights (zone, bracket, column) are made once for each column of
    such sources, and voters are added up in it. The entropy is of the single sources: what a zone takes of each is a product
    of weights with the source's shares, and sums over sources with its logarithm are products with the shares again.
    """
    open_ = mask.any(axis=0)
    phi, mask, c = phi[:, open_], mask[:, open_], c[:, open_]
    column, slot, n, width = _columns(phi, mask)
    first = np.zeros(n, dtype=int)
    first[column[slot == 0]] = np.flatnonzero(slot == 0)
    minus = np.ascontiguousarray(-phi[:, first])
    closed = None if mask.all() else np.where(mask[:, first], 0.0, -np.inf)[:, None, :]
    shares = np.zeros((n, len(c), width))
    shares[column, :, slot] = (c / np.maximum(c.sum(axis=0), 1e-30)).T
    back, total = np.ascontiguousarray(shares.transpose(0, 2, 1)), np.ascontiguousarray(shares.sum(axis=2).T)
    c = np.stack([np.bincount(column, weights=row, minlength=n) for row in c])
    const = 2 * np.where(pop > 0, pop * np.log(np.maximum(pop, 1e-300)) - pop, 0.0).sum()

    def evaluate(alpha, entropy, pull):
        w = np.multiply(alpha[:, :, None], minus[:, None, :])
        if closed is not None:
            w += closed
        w -= w.max(axis=0)
        np.exp(w, out=w)
        w /= w.sum(axis=0)
        v = np.einsum("ibj,bj->ib", w, c)
        f = np.maximum(v, 1e-30)
        rows = np.maximum(v.sum(axis=1), 1e-30)
        deviance = 2 * (f - pop * np.log(f)).sum() + const
        agg = np.matmul(np.ascontiguousarray(w.transpose(2, 0, 1)), shares) if width > 1 else np.einsum("ibj,bj->ij", w, total)
        np.log(np.maximum(agg, 1e-300, out=agg), out=agg)
        d = np.ascontiguousarray(np.matmul(agg, back).transpose(1, 2, 0)) if width > 1 else agg[:, None, :] * total
        sums = np.einsum("ibj,bj->i", w, total)
        held = np.where(sums > 0, sums, 1.0)
        logs = np.log(held)
        h = np.where(sums > 0, logs - np.einsum("ibj,ibj->i", w, d) / held, 0.0)
        penalty, entropy = _entropy_penalty(h, entropy, pull)
        loss = deviance - barrier * np.log(rows).sum() + penalty
        dv = 2 * (1 - pop / f) - (barrier / rows)[:, None]
        if entropy:
            pulled = np.where(sums > 0, -entropy / held, 0.0)
            d *= pulled[:, None, None]
            pulled *= h - logs
        for b in range(len(c)):
            own = np.multiply.outer(dv[:, b], c[b])
            d[:, b] = d[:, b] + own + np.multiply.outer(pulled, total[b]) if entropy else own
        # a weight's change spreads over its source as w (d - mean d)
        d *= w
        w *= d.sum(axis=0)
        d -= w
        return loss, deviance, np.einsum("ibj,ij->ib", d, minus), float(np.exp(h.mean()))

    return evaluate


def _entropy_penalty(h: np.ndarray, entropy: float, pull) -> tuple[float, float]:
    """What entropies by zone add to the loss, and the weight of each in the gradient."""
    if pull is None:
        return entropy * h.sum(), entropy
    strength, target = pull
    gap = h.mean() - target
    return entropy * h.sum() + strength / 2 * len(h) * gap * gap, entropy + strength * gap


def _prepared(pop: np.ndarray, source_totals: np.ndarray) -> np.ndarray:
    """Which brackets both sides hold at least one half of."""
    return (pop.sum(axis=0) >= 0.5) & (source_totals >= 0.5)


def fit_arrays(t: np.ndarray, pop: np.ndarray, src: np.ndarray, control: Control):
    """(alpha, history, converged). t: (zone, source) minutes with NaN for unreachable; pop: (zone, bracket); src: (source, bracket)."""
    mask = np.isfinite(t)
    phi = np.where(mask, _phi(np.where(mask, t, 0.0), control), 0.0)
    active = _prepared(pop, src.sum(axis=0))
    c, p = src[:, active].T.astype(float), pop[:, active].astype(float)
    return _descend(pop, active, control, evaluator(phi, mask, c, p, control.barrier) if active.any() else None, len(src))


def _phi(t: np.ndarray, control: Control) -> np.ndarray:
    return np.log(t + control.offset) if control.kernel == "power" else t


def _descend(pop: np.ndarray, active: np.ndarray, control: Control, evaluate, n_sources: int):
    """Adam on what ``evaluate(alpha, entropy, pull)`` gives: loss, deviance, gradient and effective sources.

    Without target_sources the rate falls in cycles and restarts, and the epoch of least loss is the result. With it
    the rate is constant, the entropy weight follows an augmented Lagrangian, and the result is the last epoch if the
    fit converged, else the one of least deviance near the target. Converged: ten epochs with a relative gradient
    below 1e-4, or no change over ``patience`` epochs once the rate is below a tenth of the first; both only while
    the loss, the entropy weight and the trend of the deviance are steady.
    """
    alpha = np.ones_like(pop, dtype=float)
    if not active.any():
        return alpha, [], True
    p = pop[:, active]
    lowest, target = control.lowest, control.target_sources
    start = max(control.alpha_init - lowest, 1e-3)
    rng = np.random.default_rng(control.seed + len(pop) * 7919 + int(active.sum()) * 104729)
    theta = np.log(np.expm1(start)) + rng.normal(0, 0.1, p.shape)
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    adaptive = target is not None
    pull = (n_sources, np.log(target)) if adaptive else None
    entropy = control.entropy if control.entropy > 0 or not adaptive else n_sources / target
    smooth, history, weights, a = None, [], [], None
    best, best_value, converged, calm = None, np.inf, False, 0
    least_epochs, back = max(3 * control.patience, 500), control.patience
    cycle_start, cycle_length, peak = 0, 500, control.rate
    steady = lambda now, before: abs(before) > 1e-10 and abs(now - before) / abs(before) < np.sqrt(control.tol)
    for epoch in range(1, control.max_epochs + 1):
        tried = lowest + np.logaddexp(0, theta)
        loss, deviance, grad, sources = evaluate(tried, entropy, pull)
        if not np.isfinite(loss):
            break
        a = tried
        g = grad / (1 + np.exp(-theta))
        norm = float(np.sqrt((g * g).sum()))
        near = not adaptive or abs(sources - target) < 0.2 * target
        value = deviance if adaptive else loss
        if near and value < best_value:
            best, best_value = a, value
        history.append((epoch, float(loss), float(deviance), norm, sources, float(entropy)))
        if norm > 1:
            g = g / norm
        rate = control.rate if adaptive else _rate(peak, epoch - 1 - cycle_start, cycle_length)
        step += 1
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if adaptive:
            smooth = sources if smooth is None else 0.95 * smooth + 0.05 * sources
            entropy = float(np.clip(entropy + n_sources / cycle_length * (np.log(sources) - np.log(target)), 0.01, 1000.0))
        elif epoch >= cycle_start + cycle_length:
            cycle_start, cycle_length, peak, calm = cycle_start + cycle_length, cycle_length * 2, peak * 0.7, 0
            m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
        weights.append(entropy)
        if epoch < least_epochs or epoch <= back:
            continue
        before = history[-1 - back]
        off = abs(smooth - target) / target if adaptive else 0.0
        gates = steady(loss, before[1]) and (not adaptive or (steady(entropy, weights[-1 - back]) and _falling(history)))
        calm = calm + 1 if gates and off < 0.05 and norm / (1 + np.sqrt((theta * theta).sum())) < 1e-4 else 0
        fine = adaptive or _rate(peak, epoch - cycle_start, cycle_length) < 0.1 * control.rate
        then, now = (before[2], deviance) if adaptive else (before[1], loss)
        still = abs(then) > 1e-10 and abs(then - now) / abs(then) < control.tol
        if calm >= 10 or (gates and fine and off < 0.2 and still):
            converged = True
            break
    if (adaptive and converged) or best is None:
        best = a if a is not None else lowest + np.logaddexp(0, theta)
    alpha[:, active] = best
    alpha[~np.isfinite(alpha)] = 1.0
    return alpha, history, converged


def _rate(peak: float, done: int, length: int) -> float:
    return peak * (0.01 + 0.99 * 0.5 * (1 + np.cos(np.pi * done / length)))


def _falling(history: list[tuple]) -> bool:
    """Whether the mean deviance of the last 100 epochs is not above that of 400 epochs before."""
    if len(history) <= 500:
        return True
    mean = lambda rows: sum(r[2] for r in rows) / len(rows)
    return mean(history[-100:]) <= 1.01 * mean(history[-500:-400])


def fit_problems(od: DataFrame, population: DataFrame, voters: DataFrame, control: Control = Control(), trace: bool = False) -> DataFrame:
    """(problem_id, zone_id, bracket, alpha, epochs, deviance, converged): each problem fitted in a task of its own, all problems at once.

    od, population and voters carry problem_id besides their keys. Zones without a reachable source have no alpha.
    A problem of more than MOST_ELEMENTS is not given to one task but spread, see ``fit_large``. With ``trace``
    rows of HISTORY follow, one per epoch, without a zone.
    """
    counts = lambda df, *c: df.groupBy("problem_id").agg(*[F.count_distinct(x).alias(x) for x in c])
    sizes = counts(od, "zone_id", "source_id").join(counts(population, "bracket"), "problem_id")
    sizes = sizes.select("problem_id", (F.col("zone_id") * F.col("source_id") * F.col("bracket")).alias("n")).orderBy(F.desc("n"), "problem_id").limit(MOST_APART).collect()
    large = [r.problem_id for r in sizes if r.n > MOST_ELEMENTS]
    if large:
        # each is spread over sources and all cores; the others follow as ever
        parts = []
        for k in large:
            alpha, history, converged = fit_large(*[t.filter(F.col("problem_id") == F.lit(k)).drop("problem_id") for t in (od, population, voters)], control)
            last = history[-1][2] if history else 0.0
            one = alpha.select(F.lit(k).alias("problem_id"), F.col("zone_id").cast("string"), F.col("bracket").cast("string"), "alpha", F.lit(len(history)).alias("epochs"), F.lit(float(last)).alias("deviance"), F.lit(converged).alias("converged"))
            if trace and history:
                rows = od.sparkSession.createDataFrame(_history(history, converged)[["epoch", "loss", "deviance", "gradient", "sources", "entropy", "converged"]].astype({"epoch": int}))
                one = one.unionByName(rows.withColumn("problem_id", F.lit(k)), allowMissingColumns=True)
            parts.append(one)
        rest = F.col("problem_id").isin(large) == F.lit(False)
        small = fit_problems(od.filter(rest), population.filter(rest), voters.filter(rest), control, trace)
        for one in parts:
            small = small.unionByName(one.select([F.col(c).cast(small.schema[c].dataType) if c in one.columns else F.lit(None).cast(small.schema[c].dataType).alias(c) for c in small.columns]))
        return small
    s, d = "string", "double"
    rows = od.select("problem_id", F.lit("t").alias("kind"), F.col("zone_id").cast(s).alias("a"), F.col("source_id").cast(s).alias("b"), F.col("minutes").cast(d).alias("x"))
    rows = rows.unionByName(population.select("problem_id", F.lit("p").alias("kind"), F.col("zone_id").cast(s).alias("a"), F.col("bracket").cast(s).alias("b"), F.col("pop").cast(d).alias("x")))
    rows = rows.unionByName(voters.select("problem_id", F.lit("s").alias("kind"), F.col("source_id").cast(s).alias("a"), F.col("bracket").cast(s).alias("b"), F.col("voters").cast(d).alias("x")))
    settings = asdict(control)
    kind = od.schema["problem_id"].dataType.simpleString()
    fields = f"problem_id {kind}, zone_id string, bracket string, alpha double, epochs int, deviance double, converged boolean"
    if trace:
        fields += ", epoch int, loss double, gradient double, sources double, entropy double"
    names = [f.split()[0] for f in fields.split(", ")]

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        part = {k: g for k, g in frame.groupby("kind")}
        if set(part) != {"t", "p", "s"}:
            return pd.DataFrame(columns=names)
        t = part["t"].pivot_table(index="a", columns="b", values="x", aggfunc="first")
        pop = part["p"].pivot_table(index="a", columns="b", values="x", aggfunc="sum").reindex(t.index).fillna(0.0)
        src = part["s"].pivot_table(index="a", columns="b", values="x", aggfunc="sum").reindex(index=t.columns, columns=pop.columns).fillna(0.0)
        alpha, history, converged = fit_arrays(t.to_numpy(float), pop.to_numpy(float), src.to_numpy(float), Control(**settings))
        out = pd.DataFrame(alpha, index=t.index, columns=pop.columns).rename_axis(index="zone_id", columns="bracket").stack().rename("alpha").reset_index()
        out = out.assign(problem_id=key[0], epochs=len(history), deviance=history[-1][2] if history else 0.0, converged=converged)
        if trace:
            out = pd.concat([out, _history(history, converged).assign(problem_id=key[0])]) if history else out
        return out.reindex(columns=names)

    # dealt out from the largest on: few problems would meet in a task by their hashes, or when small partitions are put together
    session = od.sparkSession
    tasks = max(min(len(sizes), max(8 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))), 1)
    places = session.createDataFrame([(r.problem_id, k % tasks) for k, r in enumerate(sizes)], f"problem_id {kind}, task int")
    rows = rows.join(F.broadcast(places), "problem_id", "left").withColumn("task", F.coalesce("task", F.pmod(F.hash("problem_id"), F.lit(tasks))))
    return rows.repartitionById(tasks, "task").groupBy("problem_id", "task").applyInPandas(solve, fields)


def _history(history: list[tuple], converged: bool) -> pd.DataFrame:
    """One row per epoch; converged only in the last, if the fit did."""
    out = pd.DataFrame(history, columns=HISTORY[:-1])
    return out.assign(converged=(out["epoch"] == len(history)) & converged)


#: Numbers of zones times brackets of a problem spread over sources: alpha and its gradient pass through the driver.
MOST_ALPHAS = 20_000_000


def fit_large(od: DataFrame, population: DataFrame, voters: DataFrame, control: Control = Control(), partitions: int | None = None) -> tuple[DataFrame, list[tuple], bool]:
    """(alpha table, history, converged) of one problem too large for a task: the same fit, spread over sources.

    A source's weights are normalised over zones, so whole sources are dealt out to partitions, once, and kept
    as blocks. An epoch is two jobs: alpha goes out and fitted sums by zone come back, then what the loss
    changes with those goes out and the gradient comes back, both added up in a tree. Only arrays of
    zones times brackets, checked against MOST_ALPHAS, reach the driver. A lost block is built again from od.
    """
    spark = od.sparkSession
    people = population.groupBy("zone_id", "bracket").agg(F.sum("pop").alias("pop"))
    if people.count() > MOST_ALPHAS:
        raise ValueError(f"more than {MOST_ALPHAS} zones times brackets")
    reach = od.filter(F.col("minutes").isNotNull()).select("zone_id").distinct()
    table = people.join(reach, "zone_id", "left_semi").toPandas()
    pop = table.pivot_table(index="zone_id", columns="bracket", values="pop", aggfunc="sum").fillna(0.0).sort_index()
    names = list(pop.columns)
    voters = voters.join(od.filter(F.col("minutes").isNotNull()).select("source_id").distinct(), "source_id", "left_semi")
    totals = {r.bracket: r.v for r in voters.groupBy("bracket").agg(F.sum("voters").alias("v")).collect()}
    active = _prepared(pop.to_numpy(float), np.array([float(totals.get(b) or 0.0) for b in names]))
    used = [b for b, on in zip(names, active) if on]
    zones = spark.sparkContext.broadcast({z: i for i, z in enumerate(pop.index)})
    kept, shape = control, (len(pop), len(used))
    held = voters.filter(F.col("bracket").isin(*used)).groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("bracket", F.col("voters").cast("double")))).alias("c"))
    pairs = od.filter(F.col("minutes").isNotNull()).select("source_id", "zone_id", F.col("minutes").cast("double").alias("t"))
    n_sources = pairs.select("source_id").distinct().count()
    by_source = pairs.groupBy("source_id").agg(F.collect_list("zone_id").alias("z"), F.collect_list("t").alias("t")).join(held, "source_id", "left")
    by_source = by_source.repartition(partitions or spark.sparkContext.defaultParallelism, "source_id")

    def block(rows):
        place, columns, shares = zones.value, [], []
        for r in rows:
            t = np.full(shape[0], np.nan)
            t[[place[z] for z in r.z]] = r.t
            columns.append(t)
            shares.append([(r.c or {}).get(b) or 0.0 for b in used])
        if columns:
            t, c = np.array(columns).T, np.array(shares).T
            mask = np.isfinite(t)
            yield np.where(mask, _phi(np.where(mask, t, 0.0), kept), 0.0), mask, c

    blocks = by_source.rdd.mapPartitions(block).persist()
    p = pop.to_numpy(float)[:, active]
    const = 2 * np.where(p > 0, p * np.log(np.maximum(p, 1e-300)) - p, 0.0).sum()

    def aggregate(w, c):
        share = c / np.maximum(c.sum(axis=0), 1e-30)
        return share, (w * share[:, None, :]).sum(axis=0)

    def evaluate(alpha, entropy, pull):
        sent = spark.sparkContext.broadcast(alpha)

        def sums(b):
            w, v = forward(sent.value, *b)
            _, agg = aggregate(w, b[2])
            return np.column_stack([v, agg.sum(axis=1), (agg * np.log(np.maximum(agg, 1e-300))).sum(axis=1)])

        out = blocks.map(sums).treeReduce(np.add)
        v, rows, q = out[:, :-2], out[:, -2], out[:, -1]
        f, reached = np.maximum(v, 1e-30), np.maximum(v.sum(axis=1), 1e-30)
        h = np.where(rows > 0, np.log(np.maximum(rows, 1e-300)) - q / np.maximum(rows, 1e-300), 0.0)
        deviance = 2 * (f - p * np.log(f)).sum() + const
        penalty, entropy = _entropy_penalty(h, entropy, pull)
        loss = deviance - kept.barrier * np.log(reached).sum() + penalty
        change = spark.sparkContext.broadcast((2 * (1 - p / f) - (kept.barrier / reached)[:, None], rows, h))

        def gradient(b):
            phi, mask, c = b
            dv, rows, h = change.value
            w = weights_of(sent.value, phi, mask)
            if not entropy:
                return backward(w, phi, c, dv)
            share, agg = aggregate(w, c)
            part = np.where(rows[:, None] > 0, agg / np.maximum(rows[:, None], 1e-300), 0.0)
            return backward(w, phi, c, dv, share, -entropy * (np.log(np.maximum(part, 1e-300)) + h[:, None]) / np.maximum(rows[:, None], 1e-300))

        grad = blocks.map(gradient).treeReduce(np.add)
        sent.unpersist()
        change.unpersist()
        return loss, deviance, grad, float(np.exp(h.mean()))

    try:
        alpha, history, converged = _descend(pop.to_numpy(float), active, control, evaluate, n_sources)
    finally:
        blocks.unpersist()
    out = pd.DataFrame(alpha, index=pop.index, columns=names).rename_axis(index="zone_id", columns="bracket").stack().rename("alpha").reset_index()
    return spark.createDataFrame(out), history, converged


def fit_one(od: DataFrame, population: DataFrame, voters: DataFrame, control: Control = Control(), keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(zone_id, bracket, alpha) of one problem and its HISTORY: in one task if it has at most MOST_ELEMENTS, else spread over sources.

    Both come from one table, which ``keep`` may hold on to, so that the fit is not repeated.
    """
    n = lambda df, c: df.select(F.count_distinct(c)).first()[0]
    if n(od, "zone_id") * n(od, "source_id") * n(population, "bracket") > MOST_ELEMENTS:
        alpha, history, converged = fit_large(od, population, voters, control)
        kinds = "epoch int, loss double, deviance double, gradient double, sources double, entropy double, converged boolean"
        return keep(alpha), od.sparkSession.createDataFrame(_history(history, converged), kinds)
    one = lambda df: df.withColumn("problem_id", F.lit(0))
    out = keep(fit_problems(one(od), one(population), one(voters), control, trace=True))
    kinds = {c: population.schema[c].dataType for c in ("zone_id", "bracket")}
    return out.filter("epoch IS NULL").select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], "alpha"), out.filter("epoch IS NOT NULL").select(*HISTORY)
