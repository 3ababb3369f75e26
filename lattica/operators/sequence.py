"""A hidden Markov model over ordered rows: Gaussian emissions, Viterbi decoding by group.

Parameters are small (states by features) and fitted by moments from weakly labelled rows, so that
fitting is one aggregation; decoding runs in Arrow batches, a group at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model:
    def __init__(self, mean: np.ndarray, variance: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.mean, self.variance = mean, np.maximum(variance, 1e-6)
        self.start, self.step = np.log(np.maximum(start, 1e-12)), np.log(np.maximum(step, 1e-12))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.mean[None]
        return -0.5 * ((d * d / self.variance) + np.log(2 * np.pi * self.variance)).sum(2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most probable states of a sequence."""
        e = self.emissions(x)
        score, back = self.start + e[0], np.zeros(e.shape, int)
        for t in range(1, len(x)):
            way = score[:, None] + self.step
            back[t] = way.argmax(0)
            score = way.max(0) + e[t]
        path = [int(score.argmax())]
        for t in range(len(x) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return np.array(path[::-1])


def fit(df: DataFrame, label: str, features: list[str], states: int, stay: float = 0.8) -> Model:
    """Moments of each labelled state; transitions keep a state with probability `stay`."""
    aggs = [a for c in features for a in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
    rows = {r[label]: r for r in df.where(F.col(label).between(0, states - 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *aggs).collect()}  # a row a state
    n = np.array([rows[s]["n"] if s in rows else 0 for s in range(states)], float)
    mean = np.array([[rows[s][f"m_{c}"] if s in rows else 0.0 for c in features] for s in range(states)])
    var = np.array([[rows[s][f"v_{c}"] if s in rows else 1.0 for c in features] for s in range(states)])
    step = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(step, stay)
    return Model(mean, var + 1e-3, (n + 1) / (n.sum() + states), step)


def decode(df: DataFrame, model: Model, group: str, order: list[str], features: list[str]) -> DataFrame:
    """df's group and order columns with the decoded state."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        frame["state"] = model.decode(frame[features].to_numpy(float))
        return frame[[group, *order, "state"]]

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (group, *order)) + ", state long"
    return df.select(group, *order, *(F.col(c).cast("double").alias(c) for c in features)).groupBy(group).applyInPandas(run, schema)
