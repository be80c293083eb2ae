"""The label optimizer: labels evolve so that cross-validated neighbours predict them well.

One run is sequential over its cycles and works on at most the landmarks of the run, so it is one task;
runs are independent and are as many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import TooLarge, prepare


@dataclass
class Options:
    cycles: int = 100
    evolutionary: bool = False
    diversity: bool = False
    absorption: bool = False
    coarsening: bool = False
    adaptive_size: bool = True
    guidance: bool = True
    stochastic: bool = True
    classifier: str = "knn"
    k: int = 30
    folds: int = 10
    components: int = 10
    seed: int = 1


@dataclass
class Result:
    labels: np.ndarray
    predicted: np.ndarray
    accuracy: float
    score: float
    trace: list[float] = field(default_factory=list)  # best accuracy so far, by cycle
    scores: list[float] = field(default_factory=list)
    evaluations: int = 1
    accepted: int = 0
    cycles: list[tuple] = field(default_factory=list)  # of each: groups relabelled, classes, accepted, as it improves, by temperature


def objective_score(labels: np.ndarray, acc: float, o: Options) -> float:
    """The accuracy; times the root of the chance that two rows differ in class (diversity), minus infinity for
    one class; less (1 - accuracy) times the cost of many or uneven classes (coarsening, but for KNN)."""
    fragments = o.classifier != "knn" and o.coarsening
    n = np.unique(labels, return_counts=True)[1]
    p = n / max(1, n.sum())
    if not len(p) or not (o.diversity or fragments):
        return acc
    if o.diversity and len(p) < 2:
        return -np.inf
    score = acc * float(np.sqrt(max(0.0, 1 - np.square(p).sum()))) if o.diversity else acc
    if fragments and len(p) > 1:
        h = float(-(p * np.log(p)).sum())
        f = max(0.0, float(np.log(len(p) / max(1.0, np.exp(h)))))
        score -= (1 - acc) * max(min(1.0, max(0.0, h / np.log(len(labels)))), f / (1 + f))
    return score


def knn_predictor(near: np.ndarray, score: np.ndarray, fold: np.ndarray):
    """near: rows x k, -1 for none, of other folds. Votes by count, score sum (9 digits), smaller label; without any, the other folds' majority."""

    def predict(labels: np.ndarray) -> np.ndarray:
        classes, own = np.unique(labels, return_inverse=True)
        ok = near >= 0
        row = np.nonzero(ok)[0]
        voted = own[near[ok]]
        n, c = len(labels), len(classes)
        key = row * c + voted
        if n * c <= 20_000_000:
            count = np.bincount(key, minlength=n * c).reshape(n, c)
            total = np.round(np.bincount(key, score[ok], n * c), 9).reshape(n, c)
            best = np.where(count == count.max(axis=1, keepdims=True), total, -np.inf)
            out = classes[best.argmax(axis=1)]
        else:
            used, at = np.unique(key, return_inverse=True)
            count, total = np.bincount(at), np.round(np.bincount(at, score[ok]), 9)
            r = used // c
            order = np.lexsort((used % c, -total, -count, r))
            first = order[np.concatenate([[True], np.diff(r[order]) > 0])]
            out = classes[np.zeros(n, int)]
            out[r[first]] = classes[used[first] % c]
        bare = ~ok.any(axis=1)
        if bare.any():
            for f in np.unique(fold[bare]):
                rest = own[fold != f] if (fold != f).any() else own
                out[bare & (fold == f)] = classes[np.bincount(rest, minlength=c).argmax()]
        return out

    return predict


def plslda_predictor(x: np.ndarray, fold: np.ndarray, components: int):
    from .linalg import Moments, discriminant

    def predict(labels: np.ndarray) -> np.ndarray:
        classes = np.unique(labels).tolist()
        out = np.empty(len(labels), labels.dtype)
        for f in np.unique(fold):
            test = fold == f
            train = ~test if (~test).any() else test
            parts = {}
            for i, c in enumerate(classes):
                own = x[train & (labels == c)]
                if len(own):
                    parts[i] = Moments(float(len(own)), own.sum(axis=0), own.T @ own)
            m = discriminant(parts, classes, components)
            out[test] = np.array(m.classes)[(x[test] @ m.a + m.b).argmax(axis=1)]
        return out

    return predict


def _transitions(labels: np.ndarray, predicted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    classes, own = np.unique(labels, return_inverse=True)
    known = np.isin(predicted, classes)
    table = np.zeros((len(classes), len(classes)), np.int64)
    np.add.at(table, (own[known], np.searchsorted(classes, predicted[known])), 1)
    return classes, table


def absorb(labels: np.ndarray, predicted: np.ndarray, fixed: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """Several classes into one: sources whose rows go elsewhere beyond chance and more often than they stay; targets that more than one source prefers come first; one target is drawn by surplus."""
    classes, table = _transitions(labels, predicted)
    size = np.bincount(np.searchsorted(classes, labels), minlength=len(classes))
    surplus = table - np.outer(size, size) / len(labels)
    np.fill_diagonal(surplus, -np.inf)
    surplus[table <= np.diag(table)[:, None]] = -np.inf
    best = surplus.argmax(axis=1)
    gain = surplus[np.arange(len(classes)), best]
    sources = np.flatnonzero(gain > 0)
    if not len(sources):
        return None
    by = {t: sources[best[sources] == t] for t in np.unique(best[sources])}
    many = {t: s for t, s in by.items() if len(s) > 1} or by
    weight = np.array([gain[s].sum() for s in many.values()])
    target = list(many)[rng.choice(len(weight), p=weight / weight.sum())]
    moved = labels.copy()
    moved[np.isin(labels, classes[many[target]]) & ~fixed] = classes[target]
    left = len(np.unique(moved))
    return moved if 1 < left < len(classes) else None


def coarsen(labels: np.ndarray, predicted: np.ndarray, fixed: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """The least stable classes into the class that their rows are predicted as: as many as the fragmentation and the entropy of the predictions allow."""
    classes, table = _transitions(labels, predicted)
    if len(classes) < 3:
        return None
    size = np.maximum(table.sum(axis=1), 1)
    p = np.unique(labels, return_counts=True)[1] / len(labels)
    h = float(-(p * np.log(p)).sum())
    fragments = 1 - np.exp(h) / len(classes)
    q = table / size[:, None]
    entropy = float((-np.where(q > 0, q * np.log(np.where(q > 0, q, 1)), 0).sum(axis=1) * size).sum() / size.sum() / np.log(len(classes)))
    budget = int(np.floor((len(classes) - 2) * max(fragments, entropy) * rng.random()))
    if budget < 1:
        return None
    movable = np.array([(~fixed[labels == c]).sum() for c in classes])
    unstable = (1 - np.diag(table) / size) / np.sqrt(np.maximum(movable, 1))
    off = table.copy()
    np.fill_diagonal(off, -1)
    to = off.argmax(axis=1)
    moved = labels.copy()
    for s in np.argsort(-unstable, kind="stable")[:budget]:
        if movable[s] and off[s, to[s]] > 0:
            moved[(labels == classes[s]) & ~fixed] = classes[to[s]]
    left = len(np.unique(moved))
    return moved if 1 < left < len(classes) else None


def maximize(predict, labels: np.ndarray, groups: np.ndarray, fixed: np.ndarray, o: Options) -> Result:
    """Cycles of proposals: some groups are relabelled by their own predictions, classes may merge; the best
    state is kept, and the current one moves uphill, or downhill with a chance that cools."""
    rng = np.random.default_rng(o.seed)
    best, pred = labels.copy(), predict(labels)
    acc = float((pred == best).mean())
    out = Result(best, pred, acc, objective_score(best, acc, o))
    current, current_pred, current_score, current_acc = best, pred, out.score, acc
    groups = np.unique(groups, return_inverse=True)[1]
    order = np.argsort(groups, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(groups))])
    total = len(cuts) - 1
    for cycle in range(o.cycles):
        base, guide = (current, current_pred) if o.evolutionary else (out.labels, out.predicted)
        cl = base.copy()
        t = (cycle + 1) / (o.cycles + 1)
        span = int((total - 1) * (1 - t * t * (3 - 2 * t))) if o.adaptive_size else total - 1
        size = int(rng.integers(1, span + 2))
        for g in rng.choice(total, size, replace=False):
            own = order[cuts[g] : cuts[g + 1]]
            own = own[~fixed[own]]
            if len(own):
                cl[own] = rng.choice(guide[own] if o.guidance else base)
        for on, step in ((o.coarsening and o.classifier != "knn", coarsen), (o.absorption, absorb)):
            if on and (moved := step(cl, guide, fixed, rng)) is not None:
                cl = moved
        pred = predict(cl)
        out.evaluations += 1
        acc = float((pred == cl).mean())
        score = objective_score(cl, acc, o)
        up, warm = score > out.score, False
        if up:
            out.labels, out.predicted, out.accuracy, out.score = cl, pred, acc, score
        if o.evolutionary:
            heat = max(1e-9, 0.1 * max(0.0, 1 - current_acc) * (1 - (cycle + 1) / o.cycles))
            up = score >= current_score
            warm = bool(not up and o.stochastic and heat > 1e-9 and np.isfinite(score) and rng.random() < np.exp((score - current_score) / heat))
            if up or warm:
                current, current_pred, current_score, current_acc = cl, pred, score, acc
                out.accepted += 1
        out.cycles.append((size, len(np.unique(current if o.evolutionary else out.labels)), bool(up or warm), bool(up), warm))
        out.trace.append(out.accuracy)
        out.scores.append(out.score)
    return out


RUN = "run int, id long, label long, pred long, best boolean, cycle int, accuracy double, score double, proposal_size int, active_classes int, accepted boolean, improving boolean, temperature boolean"
#: What a run tells of each cycle.
CYCLE = ("run", "cycle", "accuracy", "score", "proposal_size", "active_classes", "accepted", "improving", "temperature")


#: Bytes that a run's rows may come to in its task, and what a neighbour and a number of a vector come to there (as measured at its peak).
MOST_BYTES, NEIGHBOUR_BYTES, VALUE_BYTES = 4 << 30, 180, 32


def optimize(rows: DataFrame, neighbours: DataFrame, o: Options, run: str = "run", most: int | None = None) -> DataFrame:
    """One optimisation for each run: rows(run, id, label, grp, fixed, fold), neighbours(run, i, rank, j, dist) of other folds.

    Returns two kinds of rows: best = true: (run, id, label, pred) of the best state, with its accuracy and
    score; best = false: CYCLE, with the best accuracy and score so far after each cycle, the groups that the
    cycle proposed to relabel, the classes after it, and whether the proposal was accepted, as it improves or by
    temperature. Run r is seeded with
    seed + r, so replays are equal. A run's rows meet in one task; what they come to is checked against MOST_BYTES, their number against `most` if that is given.
    """
    prepare(rows.sparkSession)
    knn = o.classifier == "knn"
    wide = neighbours.agg(F.max("rank")).first()[0] if knn else rows.agg(F.max(F.size("vec"))).first()[0]
    largest = rows.groupBy(run).count().agg(F.max("count")).first()[0] or 0
    most = MOST_BYTES // (100 + (NEIGHBOUR_BYTES if knn else VALUE_BYTES) * (wide or 1)) if most is None else most
    if largest > most:
        raise TooLarge(f"{largest} rows in one run; take fewer landmarks")

    def one(key: tuple, r: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("id")
        ids = r["id"].to_numpy()
        if not len(ids):
            return pd.DataFrame(columns=[c.split()[0] for c in RUN.split(", ")])
        width = int(e["rank"].max()) if len(e) else 1
        near, score = np.full((len(ids), width), -1, np.int32), np.zeros((len(ids), width))
        i, j = np.searchsorted(ids, e["i"].to_numpy()), np.searchsorted(ids, e["j"].to_numpy())
        near[i, e["rank"].to_numpy() - 1] = j
        score[i, e["rank"].to_numpy() - 1] = -np.square(e["dist"].to_numpy())
        own = Options(**{**o.__dict__, "seed": o.seed + int(key[0])})
        predict = knn_predictor(near, score, r["fold"].to_numpy()) if o.classifier == "knn" else plslda_predictor(np.array(r["vec"].tolist(), float), r["fold"].to_numpy(), o.components)
        found = maximize(predict, r["label"].to_numpy(), r["grp"].to_numpy(), r["fixed"].to_numpy(bool), own)
        last = pd.DataFrame({"run": int(key[0]), "id": ids, "label": found.labels, "pred": found.predicted, "best": True, "cycle": o.cycles, "accuracy": found.accuracy, "score": found.score} | dict.fromkeys(CYCLE[4:]))
        trace = pd.DataFrame({"run": int(key[0]), "id": -1, "label": 0, "pred": 0, "best": False, "cycle": range(1, o.cycles + 1), "accuracy": found.trace, "score": found.scores} | dict(zip(CYCLE[4:], zip(*found.cycles))) if o.cycles else {})
        last, trace = ((d.reindex(columns=[c.split()[0] for c in RUN.split(", ")])).astype(object) for d in (last, trace))
        return pd.concat([last, trace]) if len(trace) else last

    neighbours = neighbours.toDF(*neighbours.columns)  # apart from rows, which may stem from the same tables
    return rows.groupBy(run).cogroup(neighbours.groupBy(run)).applyInPandas(one, RUN)

