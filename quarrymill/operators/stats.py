"""Statistical operators: least squares from aggregated sums, ridge and lasso, variance
inflation, bootstrap calibration.  Sums of products are aggregated in Spark, so the driver
solves systems of a few features whatever the rows; only a pilot sample whose size is checked is
collected, and a larger one is resampled where its rows are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pilot rows up to which the driver resamples them; beyond, each row draws its own counts.
PILOT_ROWS = 100_000


def ols(y: str, x: str) -> list[Column]:
    """slope, intercept and residual deviation (n - 2) of y on x, as aggregates."""
    n = F.regr_count(y, x)
    slope = F.regr_slope(y, x)
    rest = F.greatest(F.regr_syy(y, x) - slope * F.regr_sxy(y, x), F.lit(0.0))
    fits = (n >= 2) & (F.regr_sxx(y, x) != 0)
    return [
        F.when(fits, slope).alias("slope"), F.when(fits, F.regr_intercept(y, x)).alias("intercept"),
        F.when(fits, F.when(n > 2, F.sqrt(rest / (n - 2))).otherwise(0.0)).alias("resid_sd"),
    ]


# The t quantile at 0.90 by degrees of freedom (up to each bound; beyond, the normal one).
T90 = {1: 3.078, 2: 1.886, 3: 1.638, 4: 1.533, 5: 1.476, 6: 1.440, 7: 1.415, 8: 1.397, 9: 1.383, 10: 1.372, 12: 1.356, 15: 1.341, 20: 1.325, 30: 1.310}
NORMAL90 = 1.282


def t90(df: Column) -> Column:
    """The t quantile at 0.90 from a step table: of the first degrees of freedom that are enough; the
    normal quantile above the table and below 1."""
    out = F.lit(NORMAL90)
    for bound in sorted(T90, reverse=True):
        out = F.when(df <= bound, T90[bound]).otherwise(out)
    return F.when(df < 1, NORMAL90).otherwise(out)


def half_width(x: Column, n: Column, mean_x: Column, sxx: Column, resid_sd: Column) -> Column:
    """Half of the 80 % prediction interval of a line at x: t * s * sqrt(1 + 1/n + (x - mean)^2 / sxx);
    null where the line has no spread."""
    wide = t90(n - 2) * resid_sd * F.sqrt(1 + 1 / n + (x - mean_x) * (x - mean_x) / sxx)
    return F.when((n > 2) & (sxx > 0) & (resid_sd > 0), wide)


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means, and the matrix of centred second moments, from one aggregate."""
    k = len(columns)
    sums = [F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]
    pairs = [F.covar_pop(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *sums, *pairs).first()
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(k)])
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return r["n"], mean, cov


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean by their population deviation; 0 where that is 0."""
    r = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    scaled = {c: ((F.col(c) - (r[f"m{i}"] or 0.0)) / r[f"s{i}"]) if r[f"s{i}"] else F.lit(0.0) for i, c in enumerate(columns)}
    return df.withColumns(scaled)


def _solve(cov: np.ndarray, xy: np.ndarray, n: int, kind: str, alpha: float) -> np.ndarray:
    if kind == "lasso":
        w = np.zeros(len(xy))
        for _ in range(2000):
            old = w.copy()
            for j in range(len(w)):
                if cov[j, j] > 0:
                    r = xy[j] - cov[j] @ w + cov[j, j] * w[j]
                    w[j] = np.sign(r) * max(abs(r) - alpha, 0) / cov[j, j]
            if np.abs(w - old).max(initial=0) < 1e-12:
                break
        return w
    ridge = 0.0 if kind == "ols" else alpha / max(1, n)
    return np.linalg.pinv(cov + ridge * np.eye(len(xy))) @ xy


def linear(df: DataFrame, y: str, features: Sequence[str], kind: str = "ridge", alpha: float = 1.0) -> tuple[float, list[float]]:
    """Intercept and coefficients of ridge, lasso or ols (an unknown kind is ridge)."""
    n, mean, cov = moments(df, [*features, y])
    w = _solve(cov[:-1, :-1], cov[:-1, -1], n, kind.lower(), alpha)
    return float(mean[-1] - mean[:-1] @ w), [float(v) for v in w]


def vif(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Variance inflation of each feature; infinite from R^2 = 0.999, rounded to 3 places."""
    n, _, cov = moments(df, features)
    out = {}
    for j, f in enumerate(features):
        rest = [i for i in range(len(features)) if i != j]
        if cov[j, j] == 0 or not rest:
            out[f] = 1.0
            continue
        w = np.linalg.pinv(cov[np.ix_(rest, rest)]) @ cov[rest, j]
        r2 = float(w @ cov[rest, j] / cov[j, j])
        out[f] = float("inf") if r2 >= 0.999 else round(1 / (1 - r2), 3)
    return out


def _fit(total: np.ndarray, kind: str, alpha: float) -> np.ndarray:
    """Coefficients and intercept from the sums of products of (features, y, 1)."""
    n, k = total[-1, -1], len(total) - 2
    mean = total[-1, :-1] / n
    cov = total[:-1, :-1] / n - np.outer(mean, mean)
    w = _solve(cov[:k, :k], cov[:k, k], int(round(n)), kind.lower(), alpha)
    return np.append(w, mean[k] - mean[:k] @ w)


def _resampled(pilot: DataFrame, y: str, features: Sequence[str], mean: np.ndarray, sd: np.ndarray, times: int, seed: int) -> np.ndarray:
    """Sums of products of each of ``times`` resamples, and of all rows (the last), without gathering
    rows: a row stands in a resample as often as a Poisson draw from a hash of it and the
    resample's number says, which is what drawing with replacement comes to for many rows."""
    k = len(features) + 2

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((times + 1, k, k))
        for b in batches:
            raw = b[[*features, y]].to_numpy(float)
            x = np.hstack([np.divide(raw[:, :-1] - mean, sd, out=np.zeros_like(raw[:, :-1]), where=sd > 0), raw[:, -1:], np.ones((len(raw), 1))])
            own = np.array([np.random.default_rng([seed, int(h) & (1 << 63) - 1]).poisson(1.0, times) for h in b["own"]])
            for r in range(times):
                total[r] += (x * own[:, r : r + 1]).T @ x
            total[times] += x.T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    # A row is told from its equals by its place in the scan.
    rows = pilot.select(*(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, y]))).withColumn("own", F.xxhash64(F.monotonically_increasing_id(), *features, y))
    parts = rows.mapInPandas(sums, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # (times + 1) * k * k numbers
    out = np.zeros((times + 1) * k * k)
    for r in parts:
        out[r["at"]] = r["v"]
    return out.reshape(times + 1, k, k)


def bootstrap(objects: DataFrame, pilot: DataFrame, key: str, y: str, features: Sequence[str], kind: str = "ridge", alpha: float = 1.0, times: int = 200, seed: int = 42, gathered: int = PILOT_ROWS) -> DataFrame:
    """key, estimate, p50, p90: predictions of the model on all pilot rows and quantiles over
    refits on resampled pilot rows, none below 0.1.  Up to ``gathered`` rows the driver resamples."""
    total, mean, cov = moments(pilot, features)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    if total <= gathered:
        rows = pilot.select(y, *features).toPandas().astype(float)
        raw, target = rows[list(features)].to_numpy(), rows[y].to_numpy()
        scaled = np.hstack([np.divide(raw - mean, sd, out=np.zeros_like(raw), where=sd > 0), target[:, None], np.ones((len(raw), 1))])
        rng = np.random.default_rng(seed)
        whole = _fit(scaled.T @ scaled, kind, alpha)
        takes = (scaled[rng.integers(0, total, total)] for _ in range(times))
        fits = np.stack([_fit(x.T @ x, kind, alpha) for x in takes])
    else:
        *sums, every = _resampled(pilot, y, features, mean, sd, times, seed)
        whole, fits = _fit(every, kind, alpha), np.stack([_fit(s, kind, alpha) for s in sums])
    held = objects.sparkSession.sparkContext.broadcast((whole, fits, mean, sd))
    kind_of = objects.schema[key].dataType.simpleString()

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, many, m, s = held.value
        for b in batches:
            x = b[list(features)].to_numpy(float)
            z = np.hstack([np.divide(x - m, s, out=np.zeros_like(x), where=s > 0), np.ones((len(x), 1))])
            spread = z @ many.T
            low = lambda v: np.maximum(v, 0.1)
            yield pd.DataFrame({key: b[key], "estimate": low(z @ w), "p50": low(np.quantile(spread, 0.5, axis=1)), "p90": low(np.quantile(spread, 0.9, axis=1))})

    return objects.select(key, *features).mapInPandas(predict, f"{key} {kind_of}, estimate double, p50 double, p90 double")
