"""Count-regression models fitted together: Poisson and negative binomial, log link.

All models share each pass over the data.  A pass folds every Arrow batch into
per-model moments (score, information, log-likelihood), which are summed by model
on the cluster; only those moments, a handful of numbers per model, reach the
driver, which takes the Newton step.  Rows are never copied per model.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.special import digamma, log_gamma, trigamma
from ..functions.tails import normal_p, student_p

CHUNK = 512
PHI_RANGE = (-9.0, 14.0)


@dataclass(frozen=True)
class Model:
    """One regression: ``family`` is ``poisson`` or ``negbin`` (``theta=None``: estimated).

    ``group`` restricts the model to rows whose group column equals it.
    """
    id: str
    response: str
    terms: tuple[str, ...] = ()
    family: str = "negbin"
    theta: float | None = None
    group: str | None = None

    @property
    def free_theta(self) -> bool:
        return self.family == "negbin" and self.theta is None

    @property
    def size(self) -> int:
        return len(self.terms) + 1 + int(self.free_theta)


@dataclass
class _State:
    model: Model
    current: np.ndarray | None = None
    trial: np.ndarray | None = None
    step: np.ndarray | None = None
    loglik: float = -math.inf
    grad: np.ndarray | None = None
    info: np.ndarray | None = None
    n: int = 0
    pearson: float = 0.0
    null_mean: float = 0.0
    iterations: int = 0
    done: bool = False
    converged: bool = False
    status: str = "iteration limit"
    poisson_limit: bool = False     # theta has no finite maximum: fitted as its Poisson limit

    @property
    def fitted_model(self) -> Model:
        m = self.model
        return Model(m.id, m.response, m.terms, "poisson", None, m.group) if self.poisson_limit else m


def _start_moments(y: np.ndarray) -> np.ndarray:
    return np.array([len(y), y.sum(), (y * y).sum()])


def _pass_moments(y, hist, x, m: Model, par: np.ndarray) -> np.ndarray:
    """n, log-likelihood, Pearson chi-square, score and information of one batch.

    ``hist`` holds the batch's distinct responses and their counts: the gamma
    functions depend on a row only through its response.
    """
    k = x.shape[1]
    val, cnt = hist
    eta = x @ par[:k]
    with np.errstate(over="ignore"):
        mu = np.exp(eta)        # infinite only far outside the data; such a trial has no likelihood and is refused
    p = m.size
    info = np.zeros((p, p))
    score = np.zeros(p)
    ll = -(cnt @ log_gamma(val + 1))
    if m.family == "poisson":
        ll += y @ eta - mu.sum()
        w, r, var = mu, y - mu, mu
    else:
        th = math.exp(par[k]) if m.free_theta else m.theta
        one = np.array([th])
        # Shares of mu + theta and its logarithm stay finite whatever the linear predictor is.
        odds = eta - math.log(th)
        log_tot = np.logaddexp(eta, math.log(th))
        high, low = np.exp(eta - log_tot), np.exp(math.log(th) - log_tot)      # mu / tot, theta / tot
        grow = np.logaddexp(0.0, odds).sum()
        ll += cnt @ (log_gamma(val + th) - log_gamma(one)[0]) - th * grow + y @ (eta - log_tot)
        r, var = y * low - th * high, mu / low
        if m.free_theta:
            ratio = (y / th + 1.0) * low
            w = th * high * ratio  # observed information
            s = cnt @ (digamma(val + th) - digamma(one)[0]) - grow + (high - y * low / th).sum()
            h = cnt @ (trigamma(val + th) - trigamma(one)[0]) + len(y) / th + ((ratio - 2) * low / th).sum()
            score[k] = th * s
            info[k, k] = -(th * th * h + th * s)
            cross = -(x.T @ (r * high))
            info[k, :k] = cross
            info[:k, k] = cross
        else:
            w = th * high  # expected information
    score[:k] = x.T @ r
    info[:k, :k] = (x * w[:, None]).T @ x
    return np.concatenate([[len(y), ll, ((y - mu) ** 2 / var).sum()], score, info.ravel()])


def _gather(df: DataFrame, models: Sequence[Model], params: Sequence[np.ndarray | None],
            group_col: str | None) -> list[np.ndarray]:
    """Sum each model's batch moments over the whole table."""
    models, params = list(models), list(params)
    place = {c: i for i, c in enumerate(c for c in df.columns if c != group_col)}

    def fold(batches: Iterable[pa.RecordBatch]):
        acc: list[np.ndarray | None] = [None] * len(models)
        for batch in batches:
            every = np.column_stack([np.ones(batch.num_rows)] + [
                batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in place])
            group = batch.column(group_col).to_numpy(zero_copy_only=False) if group_col else None
            rows, counted = {None: every}, {}
            for i, m in enumerate(models):
                if m.group not in rows:
                    rows[m.group] = every[group == m.group]
                used = [0, *(1 + place[t] for t in m.terms)]
                x, y = rows[m.group][:, used], rows[m.group][:, 1 + place[m.response]]
                bad = np.isnan(y) | np.isnan(x).any(axis=1)
                if bad.any():
                    x, y = x[~bad], y[~bad]
                if not len(y):
                    continue
                if params[i] is None:
                    v = _start_moments(y)
                else:
                    # Models without dropped rows share one histogram per response and group.
                    key = i if bad.any() else (m.response, m.group)
                    if key not in counted:
                        counted[key] = np.unique(y, return_counts=True)
                    v = _pass_moments(y, counted[key], x, m, params[i])
                acc[i] = v if acc[i] is None else acc[i] + v
        for i, v in enumerate(acc):
            if v is not None:
                yield pa.RecordBatch.from_pydict({"m": np.full(len(v), i, dtype=np.int32),
                                                  "k": np.arange(len(v), dtype=np.int32), "v": v})

    sums = df.mapInArrow(fold, "m int, k int, v double").groupBy("m", "k").agg(F.sum("v").alias("v"))
    out: list[dict[int, float]] = [{} for _ in models]
    for m, k, v in sums.collect():  # moments only: (terms + 2)^2 numbers per model
        out[m][k] = v
    return [np.array([d[k] for k in sorted(d)]) if d else None for d in out]


def _newton(st: _State) -> np.ndarray:
    info = st.info
    lam = 0.0
    scale = np.maximum(np.abs(np.diag(info)), 1e-8)
    for _ in range(40):
        try:
            np.linalg.cholesky(info + lam * np.diag(scale))
            break
        except np.linalg.LinAlgError:
            lam = max(1e-6, lam * 4)
    step = np.linalg.solve(info + lam * np.diag(scale), st.grad)
    big = np.abs(step).max()
    return step if big < 5 else step * (5 / big)


def _advance(st: _State, v: np.ndarray, tol: float) -> None:
    m = st.fitted_model
    p, k = m.size, len(m.terms) + 1
    n, ll, pearson = v[0], v[1], v[2]
    st.iterations += 1
    if ll >= st.loglik - 1e-10 * abs(ll):
        gain = ll - st.loglik
        st.current, st.loglik, st.n, st.pearson = st.trial, float(ll), int(n), float(pearson)
        st.grad, st.info = v[3:3 + p], v[3 + p:].reshape(p, p)
        st.step = _newton(st)
        phi = st.current[k] if m.free_theta else 0.0
        if m.free_theta and phi >= PHI_RANGE[1] and st.grad[k] > 0:
            # The likelihood still rises: the counts are not overdispersed and the fit is its Poisson limit.
            st.poisson_limit, st.loglik = True, -math.inf
            st.trial = st.current[:k].copy()
            return
        if np.abs(st.grad @ st.step) < tol * (1 + abs(ll)) * 1e-4:
            st.done, st.converged = True, True
            st.status = "poisson limit" if st.poisson_limit else "converged"
        elif m.free_theta and phi <= PHI_RANGE[0] and gain < 1e-6:
            st.done, st.status = True, "theta at its lower edge"
    else:
        st.step = st.step / 2
        if np.abs(st.step).max() < 1e-10:
            st.done, st.status = True, "line search stalled"
    st.trial = st.current + st.step
    if m.free_theta:
        st.trial[k] = min(max(st.trial[k], PHI_RANGE[0]), PHI_RANGE[1])


@dataclass
class Fit:
    """Fitted models; ``coefficients()`` and ``summary()`` are one row per term and per model."""
    spark: SparkSession
    states: list[_State] = field(default_factory=list)

    def covariance(self, st: _State) -> np.ndarray:
        return np.linalg.pinv(st.info)

    def coefficients(self, digits: int | None = None, quasi: bool = False) -> DataFrame:
        rows = []
        for st in self.states:
            if st.current is None:      # no estimate: one row per term all the same
                rows += [(st.model.id, st.model.response, st.model.group, term, None, None, None, None)
                         for term in ("(Intercept)", *st.model.terms)]
                continue
            se = np.sqrt(np.maximum(np.diag(self.covariance(st)), 0))
            df = st.n - len(st.model.terms) - 1
            stretch = (math.sqrt(st.pearson / df) if df > 0 else math.nan) if quasi else 1.0
            for i, term in enumerate(("(Intercept)", *st.model.terms)):
                est, s = float(st.current[i]), float(se[i]) * stretch
                z = est / s if s > 0 else None
                p = None if z is None else (student_p(z, df) if quasi else normal_p(z))
                vals = (est, s, z, p)
                if digits is not None:
                    vals = tuple(None if v is None else round(v, digits) for v in vals)
                rows.append((st.model.id, st.model.response, st.model.group, term, *vals))
        return self.spark.createDataFrame(
            rows, "model_id string, response string, model_group string, term string, estimate double, se double, stat double, p double")

    def summary(self) -> DataFrame:
        rows = []
        for st in self.states:
            if st.current is None:
                rows.append((st.model.id, st.model.response, st.model.group, ",".join(st.model.terms), st.n, st.model.size,
                             *[None] * 6, st.iterations, False, st.status, len(st.model.terms)))
                continue
            k, n = st.model.size, st.n
            theta = self._theta(st)
            aic = -2 * st.loglik + 2 * k
            aicc = aic + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else None
            df = n - len(st.model.terms) - 1
            rows.append((st.model.id, st.model.response, st.model.group, ",".join(st.model.terms), n, k, st.loglik,
                         theta, aic, aicc, st.pearson, st.pearson / df if df > 0 else None, st.iterations, st.converged, st.status,
                         len(st.model.terms)))
        return self.spark.createDataFrame(
            rows, "model_id string, response string, model_group string, terms string, n bigint, k int, loglik double, "
                  "theta double, aic double, aicc double, pearson double, dispersion double, iterations int, converged boolean, "
                  "status string, n_terms int")

    def fitted(self, df: DataFrame, model_id: str, group_col: str | None = None, name: str = "mu") -> DataFrame:
        """Rows of one model with their fitted mean."""
        st = next(s for s in self.states if s.model.id == model_id)
        eta = F.lit(float(st.current[0]))
        for b, t in zip(st.current[1:], st.model.terms):
            eta = eta + F.lit(float(b)) * F.col(f"`{t}`")
        if st.model.group is not None:
            df = df.filter(F.col(group_col) == F.lit(st.model.group))
        return df.withColumn(name, F.exp(eta))

    @staticmethod
    def _theta(st: _State) -> float | None:
        if st.poisson_limit:
            return math.inf
        return math.exp(st.current[-1]) if st.model.free_theta else st.model.theta

    def theta(self, model_id: str) -> float | None:
        """Dispersion of one model; infinite at the Poisson limit."""
        return self._theta(next(s for s in self.states if s.model.id == model_id))


def fit_models(df: DataFrame, models: Sequence[Model], group_col: str | None = None, max_iter: int = 60,
               tol: float = 1e-8, chunk: int = CHUNK, min_partitions: int | None = None) -> Fit:
    """Fit every model; each has a row in the results, with its ``status``.

    Models without rows or with only zero responses have null estimates; a negative-binomial model
    of counts that are not overdispersed is reported as its Poisson limit (theta infinite).
    ``min_partitions`` spreads the cached design when its files hold fewer splits.
    """
    need = dict.fromkeys(c for m in models for c in (m.response, *m.terms))
    cols = [F.col(f"`{c}`").cast("double").alias(c) for c in need]
    data = df.select(*([group_col] if group_col else []), *cols)
    if min_partitions and data.rdd.getNumPartitions() < min_partitions:
        data = data.repartition(min_partitions)
    data = data.persist()
    fit = Fit(df.sparkSession, [_State(m) for m in models])
    try:
        for at in range(0, len(models), chunk):
            states = fit.states[at:at + chunk]
            for st, v in zip(states, _gather(data, [s.model for s in states], [None] * len(states), group_col)):
                if v is None or v[1] <= 0:
                    st.done, st.n = True, 0 if v is None else int(v[0])
                    st.status = "no rows" if v is None else "all responses zero"
                    continue
                n, mean = v[0], v[1] / v[0]
                var = v[2] / n - mean * mean
                st.null_mean = float(mean)
                st.trial = np.zeros(st.model.size)
                st.trial[0] = math.log(mean)
                if st.model.free_theta:
                    guess = mean * mean / (var - mean) if var > mean else 1e3
                    st.trial[-1] = min(max(math.log(guess), PHI_RANGE[0]), PHI_RANGE[1])
            for _ in range(max_iter):
                live = [s for s in states if not s.done]
                if not live:
                    break
                for st, v in zip(live, _gather(data, [s.fitted_model for s in live], [s.trial for s in live], group_col)):
                    _advance(st, v, tol)
    finally:
        data.unpersist()
    return fit


def with_null_models(models: Sequence[Model]) -> list[Model]:
    """Each model followed by its intercept-only counterpart ``<id>|null``."""
    return [m for model in models for m in
            (model, Model(model.id + "|null", model.response, (), model.family, model.theta, model.group))]


def likelihood_r2(summary: DataFrame) -> DataFrame:
    """Likelihood-ratio R squared, raw and scaled to its attainable maximum."""
    full = summary.filter(~F.col("model_id").endswith("|null"))
    null = summary.filter(F.col("model_id").endswith("|null")).select(
        F.regexp_replace("model_id", "\\|null$", "").alias("model_id"), F.col("loglik").alias("loglik_null"))
    r = full.join(null, "model_id").select("model_id", "n", "loglik", "loglik_null", "theta", "converged")
    raw = 1 - F.exp(F.lit(-2.0) / F.col("n") * (F.col("loglik") - F.col("loglik_null")))
    top = 1 - F.exp(F.lit(2.0) / F.col("n") * F.col("loglik_null"))
    return r.withColumn("r2_raw", raw).withColumn("r2", F.try_divide(F.col("r2_raw"), top))


def overdispersion(summary: DataFrame) -> DataFrame:
    """Pearson chi-square over residual degrees of freedom, per model."""
    return summary.filter(~F.col("model_id").endswith("|null")).select(
        "model_id", "pearson", (F.col("n") - F.col("n_terms") - 1).alias("df_residual"),
        F.col("dispersion").alias("chat"))


def count_checks(fit: Fit, df: DataFrame, model_id: str, row_id: Sequence[str], group_col: str | None = None,
                 sims: int = 250, seed: int = 1) -> DataFrame:
    """Simulation checks of a negative-binomial fit: dispersion, zero share, residual uniformity.

    Rows are dealt by id hash into buckets of about 4,096; a bucket's draws are
    seeded by its number, so results repeat under any partitioning.  Copies of
    one row are counted first and dealt in chunks, so they cannot pile up in a
    bucket.  A bucket emits one sum per replicate and a 20-bin histogram of
    scaled residuals.
    """
    deal = 4096
    st = next(s for s in fit.states if s.model.id == model_id)
    theta = fit.theta(model_id)
    rows = fit.fitted(df, model_id, group_col).filter(F.col("mu").isNotNull()).select(
        F.xxhash64(*row_id).alias("id"), F.col(st.model.response).cast("double").alias("y"), "mu").filter("y is not null")
    rows = rows.groupBy("id", "y", "mu").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.col("c") - 1) / deal).cast("int"))))
    rows = rows.select("y", "mu", "id", "chunk", F.least(F.lit(deal), F.col("c") - F.col("chunk") * deal).cast("int").alias("c"),
                       F.pmod(F.xxhash64("id", "chunk"), F.lit(max(1, st.n // deal))).alias("bucket"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "chunk", "y", "mu"])
        y, mu = np.repeat(pdf["y"].to_numpy(), pdf["c"]), np.repeat(pdf["mu"].to_numpy(), pdf["c"])
        rng = np.random.default_rng([seed, int(pdf["bucket"].iloc[0])])
        mean = np.broadcast_to(mu[:, None], (len(y), sims))
        sim = rng.poisson(mean if math.isinf(theta) else rng.gamma(theta, mean / theta))
        var = np.concatenate([[((y - mu) ** 2).sum()], ((sim - mu[:, None]) ** 2).sum(axis=0)])
        zero = np.concatenate([[(y == 0).sum()], (sim == 0).sum(axis=0)])
        below, tied = (sim < y[:, None]).mean(axis=1), (sim == y[:, None]).mean(axis=1)
        scaled = below + rng.random(len(y)) * tied
        hist = np.bincount(np.minimum((scaled * 20).astype(int), 19), minlength=20)
        return pd.DataFrame({"kind": ["var"] * (sims + 1) + ["zero"] * (sims + 1) + ["bin"] * 20,
                             "k": [*range(sims + 1), *range(sims + 1), *range(20)],
                             "v": np.concatenate([var, zero, hist]).astype(float)})

    s = rows.groupBy("bucket").applyInPandas(draw, "kind string, k int, v double").groupBy("kind", "k").agg(
        F.sum("v").alias("v"))
    test = s.filter("kind <> 'bin'").groupBy("kind").agg(
        F.max(F.when(F.col("k") == 0, F.col("v"))).alias("observed"),
        F.avg(F.when(F.col("k") > 0, F.col("v"))).alias("expected"),
        F.collect_list(F.when(F.col("k") > 0, F.col("v"))).alias("sims"))
    hi = F.size(F.filter("sims", lambda v: v >= F.col("observed"))) / F.lit(float(sims))
    lo = F.size(F.filter("sims", lambda v: v <= F.col("observed"))) / F.lit(float(sims))
    name = F.when(F.col("kind") == "var", "dispersion").otherwise("zero_inflation")
    out = test.select(name.alias("check"), F.try_divide("observed", "expected").alias("ratio"),
                      F.least(F.lit(1.0), 2 * F.least(hi, lo)).alias("p"))
    h = s.filter("kind = 'bin'").agg(F.sum("v").alias("n"), F.sum(F.col("v") * F.col("v")).alias("q"))
    from ..functions.tails import chi2_tail
    chi = F.try_divide(F.col("q") * 20, F.col("n")) - F.col("n")
    uniform = h.select(F.lit("uniform_residuals").alias("check"), F.try_divide(chi, F.lit(19.0)).alias("ratio"),
                       chi2_tail(chi, F.lit(19)).alias("p"))
    return out.unionByName(uniform).withColumn("model_id", F.lit(model_id))
