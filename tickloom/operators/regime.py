"""Market regimes and the rules that follow from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import full

C = F.col


def sma_regime(index: DataFrame) -> DataFrame:
    """Bull or bear where the index is over 2 % from its 200-bar mean, else sideways; bull while there is no mean."""
    far = C("close") / full("close", 200, F.avg) - 1
    return index.withColumn("far", far).select("d", "close", F.when(C("far").isNull() | (C("far") > 0.02), "bull").when(C("far") < -0.02, "bear").otherwise("sideways").alias("regime"))


def vix_override(regimes: DataFrame, vix: DataFrame) -> DataFrame:
    """Bear with half sizes where the volatility index is over 40; a date without one is left as it is."""
    both = regimes.join(vix, "d", "left")
    stressed = F.coalesce(C("vix") > 40, F.lit(False))
    return both.select("d", F.when(stressed, "bear").otherwise(C("regime")).alias("regime"), F.when(stressed, 0.5).otherwise(1.0).alias("size_mult"))


def drawdown_multiplier(drawdown: Column) -> Column:
    return F.when(drawdown < 5, 1.0).when(drawdown < 10, 0.75).when(drawdown < 15, 0.5).otherwise(0.0)


def should_trade(kind: Column, regime: Column) -> Column:
    """Swing momentum trades only in a bull regime; kinds without a rule always do."""
    return F.when(kind == "swing_momentum", regime == "bull").otherwise(True)


def gaussian_log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of the rows of ``x`` under each state."""
    out = np.empty((len(x), len(mean)))
    for k in range(len(mean)):
        lower = np.linalg.cholesky(cov[k])
        z = np.linalg.solve(lower, (x - mean[k]).T)
        out[:, k] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(lower)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def forward_backward(likely: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of the states at each row, and the expected moves between them.

    The series is cut into about as many blocks as a block has rows, and all blocks step
    together: first each block's effect from every state it may begin in, then what each
    block begins (or ends) with, then the rows.  So a series of n rows takes some
    multiple of the root of n array steps.
    """
    rows, states = likely.shape
    length = max(1, math.isqrt(rows))
    blocks = -(-rows // length)
    # rows that fill the last block say nothing: they change no belief before them
    at = np.vstack([likely, np.ones((blocks * length - rows, states))]).reshape(blocks, length, states)
    effect, size = np.broadcast_to(np.eye(states), (blocks, states, states)), np.zeros((blocks, states))
    with np.errstate(divide="ignore"):
        for k in range(length):
            effect = (effect @ move if k else effect) * at[:, k, None, :]
            total = effect.sum(axis=2)
            size += np.log(total)
            effect = effect / np.where(total > 0, total, 1)[:, :, None]
        before = np.empty((blocks, states))
        before[0] = start
        for b in range(1, blocks):
            weight = np.log(before[b - 1]) + size[b - 1]
            last = np.exp(weight - weight.max()) @ effect[b - 1]
            before[b] = last / last.sum() @ move
    ahead, scale = np.empty_like(at), np.empty((blocks, length))
    for k in range(length):
        now = at[:, k] * (ahead[:, k - 1] @ move if k else before)
        scale[:, k] = now.sum(axis=1)
        ahead[:, k] = now / scale[:, k, None]
    told = at / scale[:, :, None]
    effect = np.broadcast_to(np.eye(states), (blocks, states, states))
    for k in range(1, length):
        effect = effect @ move * told[:, k, None, :]
    behind = np.empty_like(at)
    behind[-1, -1] = 1
    for b in range(blocks - 2, -1, -1):
        behind[b, -1] = move @ (told[b + 1, 0] * (effect[b + 1] @ behind[b + 1, -1]))
    for k in range(length - 2, -1, -1):
        behind[:, k] = (told[:, k + 1] * behind[:, k + 1]) @ move.T
    ahead, reached = ahead.reshape(-1, states)[:rows], (told * behind).reshape(-1, states)[:rows]
    belief = ahead * behind.reshape(-1, states)[:rows]
    return belief / belief.sum(axis=1, keepdims=True), move * (ahead[:-1].T @ reached[1:])


def fit_hmm(x: np.ndarray, states: int = 3, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Full-covariance Gaussian HMM by EM from equal chunks of the series: start, transition, means, covariances."""
    chunks = np.array_split(x, states)
    mean = np.array([c.mean(axis=0) for c in chunks])
    eye = np.eye(x.shape[1])
    cov = np.array([np.cov(c.T) + 1e-4 * eye for c in chunks])
    start, move = np.full(states, 1 / states), np.full((states, states), 1 / states)
    for _ in range(rounds):
        logs = gaussian_log_density(x, mean, cov)
        belief, pairs = forward_backward(np.exp(logs - logs.max(axis=1, keepdims=True)), start, move)
        start, move = belief[0], pairs / pairs.sum(axis=1, keepdims=True)
        weight = belief.sum(axis=0)
        mean = belief.T @ x / weight[:, None]
        for k in range(states):
            far = x - mean[k]
            cov[k] = (belief[:, k, None] * far).T @ far / weight[k] + 1e-5 * eye
    return start, move, mean, cov


def best_path(x: np.ndarray, start, move, mean, cov) -> np.ndarray:
    """Most likely states (Viterbi)."""
    logs, steps = gaussian_log_density(x, mean, cov), np.log(move + 1e-300)
    score, back = np.log(start + 1e-300) + logs[0], []
    for t in range(1, len(x)):
        options = score[:, None] + steps
        back.append(options.argmax(axis=0))
        score = options.max(axis=0) + logs[t]
    path = [int(score.argmax())]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return np.array(path[::-1])


FEATURES = ["return_20", "vol_20", "vix_norm", "breadth_20"]


def _by_series(features: DataFrame) -> DataFrame:
    """Features with the series that each row is of; without a column ``ticker`` there is one."""
    return features if "ticker" in features.columns else features.withColumn("ticker", F.lit("INDEX"))


def hmm_regime(features: DataFrame, recent: int = 120) -> DataFrame:
    """Regime of the last ``recent`` dates of each series by a three-state HMM; states are named by ascending mean return.

    A series (``ticker``: an index, with a row per date) is a group of its own.
    """

    def label(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("d")
        x, last = rows[FEATURES].to_numpy(), rows.tail(recent)
        if len(x) < 30:
            return pd.DataFrame({"ticker": key[0], "d": last["d"], "regime": "bull"})
        model = fit_hmm(x)
        return pd.DataFrame({"ticker": key[0], "d": last["d"], "regime": _named(last, model)})

    return _by_series(features).groupBy("ticker").applyInPandas(label, "ticker string, d date, regime string")


def _named(rows: pd.DataFrame, model: tuple) -> list[str]:
    names = dict(zip(np.argsort(model[2][:, 0]).tolist(), ("bear", "sideways", "bull"), strict=True))
    return [names[s] for s in best_path(rows[FEATURES].to_numpy(), *model)]


MODEL = "ticker string, fit_rows int, start array<double>, move array<array<double>>, mean array<array<double>>, cov array<array<array<double>>>"


def hmm_models(features: DataFrame, every: int = 63) -> DataFrame:
    """The parameters of each fit of a series: on its first ``every`` dates, and anew on all dates so far whenever ``every`` have come since.

    Every fit of every series is a task of its own.  A fit is a full one, as a state that
    a series has not met before changes what its earlier dates count as: a date takes part
    in all later fits, which a series of one row a date allows.
    """
    n = F.row_number().over(Window.partitionBy("ticker").orderBy("d"))
    total = F.count("*").over(Window.partitionBy("ticker"))
    rows = _by_series(features).withColumns({"n": n, "fits": F.floor(total / every).cast("int")}).withColumn("first", F.ceil(C("n") / every).cast("int"))
    rows = rows.where("first <= fits").withColumn("fit_rows", F.explode(F.sequence(C("first") * every, C("fits") * every, F.lit(every))))

    def fit(key: tuple, dates: pd.DataFrame) -> pd.DataFrame:
        model = fit_hmm(dates.sort_values("d")[FEATURES].to_numpy())
        return pd.DataFrame({"ticker": [key[0]], "fit_rows": [key[1]], **{name: [part.tolist()] for name, part in zip(("start", "move", "mean", "cov"), model, strict=True)}})

    return rows.groupBy("ticker", "fit_rows").applyInPandas(fit, MODEL)


def hmm_stored_regime(features: DataFrame, models: DataFrame, recent: int = 120) -> DataFrame:
    """Regime of the last ``recent`` dates of each series by the newest of its stored models; "bull" while there is none."""
    late = Window.partitionBy("ticker")
    newest = models.groupBy("ticker").agg(F.max_by(F.struct("fit_rows", "start", "move", "mean", "cov"), "fit_rows").alias("m")).select("ticker", "m.*")
    last = _by_series(features).withColumn("_n", F.row_number().over(late.orderBy(F.desc("d")))).where(C("_n") <= recent)

    def label(key: tuple, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("d")
        if model.empty or rows.empty:
            return pd.DataFrame({"ticker": key[0], "d": rows["d"], "regime": "bull", "fit_rows": 0})
        stored = model.iloc[0]
        parts = [np.array([np.array([np.array(x) for x in y]) for y in stored[n]]) if n == "cov" else np.array([np.array(y) for y in stored[n]]) for n in ("start", "move", "mean", "cov")]
        return pd.DataFrame({"ticker": key[0], "d": rows["d"], "regime": _named(rows, parts), "fit_rows": stored["fit_rows"]})

    return last.groupBy("ticker").cogroup(newest.groupBy("ticker")).applyInPandas(label, "ticker string, d date, regime string, fit_rows int")
