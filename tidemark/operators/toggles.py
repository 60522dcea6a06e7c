"""Fits of many candidate sets that differ from one base set by one variable.

The panel is one row per variable, an array of calendar length; it is never
copied per set.  A set is the base with one variable put in or taken out, so a
variable's row knows by its name which sets it belongs to.

What an expectation-maximisation round needs of the variables are sums over a
set's members.  Every variable adds its own part of every date's sums to all
sets it is in (``SetSums``); a set's total without a variable is the total minus
its part.  Where the rows have a checked, small size they are broadcast and a
set's rounds run in one task of many; otherwise each round is one job: rows add
up their parts inside their tasks, the parts of a set meet by set, and the
factors that follow, of bounded size, go back to the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import dynamics
from tidemark.session import cut_lineage

#: Bytes of variable rows that are broadcast whole, and of the factors of the sets fitted together otherwise.
PANEL_BYTES, FACTOR_BYTES = 64 << 20, 64 << 20
#: Extra columns of the subspace, its rounds, and the relative change at which it rests.
EXTRA, MOST_STEPS, REST = 16, 200, 1e-13
KEYS = ("n", "c", "b", "c0", "b0", "s0", "ld")
DOUBLES = T.ArrayType(T.DoubleType())


@dataclass
class Rows:
    """Variables of one panel: names, centred values (NaN missing), values
    standardised on the training dates (those dates only), deviations."""

    names: list[str]
    y: np.ndarray
    z: np.ndarray
    sigma: np.ndarray


@dataclass
class Panel:
    """Variable rows ``(variable, y, z, sigma)`` of one panel and its calendar."""

    rows: DataFrame
    dates: list
    train: np.ndarray
    held: object = None  # the rows as a broadcast, where they are small


@dataclass
class Fit:
    """How every set is fitted."""

    k: int
    order: int = 1
    max_iter: int = 30
    tolerance: float = 1e-6


def panel_rows(panel: DataFrame, train_start, train_end, panel_bytes: int | None = None) -> Panel:
    """Rows of ``panel(variable, d, v)``; every variable has the same dates."""
    day = lambda x: F.lit(x).cast("date")
    train = F.col("d").between(day(train_start), day(train_end))
    v = F.when(train, F.col("v"))
    flat = F.coalesce(F.min(v) == F.max(v), F.lit(True)) | (F.count(v) < 2)
    cells = F.array_sort(F.collect_list(F.struct("d", F.col("v").alias("x"))))
    made = panel.groupBy("variable").agg(F.avg(v).alias("mu"), F.when(flat, 1.0).otherwise(F.stddev_samp(v)).alias("sigma"), cells.alias("cells"))
    centred = F.transform("cells", lambda c: c["x"] - F.col("mu"))
    scaled = F.transform(F.filter("cells", lambda c: c["d"].between(day(train_start), day(train_end))),
                         lambda c: F.coalesce((c["x"] - F.col("mu")) / F.col("sigma"), F.lit(0.0)))
    rows = cut_lineage(made.select("variable", centred.alias("y"), scaled.alias("z"), "sigma", F.transform("cells", lambda c: c["d"]).alias("dates")))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min("dates").alias("dates"), F.max("dates").alias("others")).first()
    if seen["dates"] != seen["others"]:
        raise ValueError("the variables of a panel must have the same dates")
    dates = list(seen["dates"] or [])
    mark = np.array([str(train_start) <= d.isoformat() <= str(train_end) for d in dates], bool)
    out = Panel(rows.drop("dates"), dates, mark)
    if seen["n"] * len(dates) * 16 <= (PANEL_BYTES if panel_bytes is None else panel_bytes):
        out.held = panel.sparkSession.sparkContext.broadcast(_rows(out.rows.orderBy("variable").toPandas(), len(dates), int(mark.sum())))
    return out


def _rows(pdf: pd.DataFrame, size: int, train: int) -> Rows:
    grid = lambda c, n: np.array([np.asarray(r, float) for r in pdf[c]], float).reshape(len(pdf), n)
    return Rows(list(pdf["variable"]), grid("y", size), grid("z", train), pdf["sigma"].to_numpy(float))


def members(names: list[str], base: frozenset, toggled: str | None) -> np.ndarray:
    return np.array([(v in base) != (v == toggled) for v in names], bool)


def _started(f0: np.ndarray, fit: Fit) -> dict:
    a, q = dynamics.first_dynamics(f0, fit.order)
    m = fit.k * fit.order
    return {"a": a, "q": q, "x0": np.zeros(m), "p0": np.eye(m), "last": None, "done": False, "rounds": 0, "f": None, "f0": f0}


def _advance(state: dict, info: dict, fit: Fit) -> dict:
    out = dynamics.recursion(info, state["a"], state["q"], state["x0"], state["p0"], state["last"], state["done"], fit.k, fit.order, fit.tolerance)
    return {**state, **{n: out[n] for n in ("a", "q", "x0", "p0", "last", "done", "f")}, "rounds": state["rounds"] + 1}


def set_parts(rows: Rows, train: np.ndarray, state: dict, mine: np.ndarray) -> dict[str, np.ndarray]:
    """The member rows' part of a set's sums, with the loadings that follow from
    its factors of the round before."""
    y = rows.y[mine]
    h, r = dynamics.first_parameters(rows.z[mine], y[:, train], rows.sigma[mine], state["f0"])
    if state["f"] is not None:
        h, r = dynamics.later_parameters(y, state["f"], h, r)
    return dynamics.information(y, h, r)


def _result(names: list[str], states: list[dict], dates: list) -> pd.DataFrame:
    t = len(dates)
    f = np.concatenate([s["f"] for s in states])
    return pd.DataFrame({"candidate_id": np.repeat(names, t), "d": dates * len(states), "f": list(f),
                         "rounds": np.repeat([s["rounds"] for s in states], t), "converged": np.repeat([bool(s["done"]) for s in states], t)})


RESULT = "candidate_id string, d date, f array<double>, rounds int, converged boolean"


def fit_sets(panel: Panel, base: list[str], toggled: dict[str, str | None], fit: Fit) -> DataFrame:
    """Factors of every set on every date, with its rounds and convergence.

    ``toggled`` names for each set the variable that is put into ``base`` or
    taken out of it, or None.  Values equal those of a fit per set."""
    spark = panel.rows.sparkSession
    if panel.held is not None:
        base_set, held, dates, train = frozenset(base), panel.held, panel.dates, panel.train

        def run(batches):
            rows = held.value
            for pdf in batches:
                for name, change in zip(pdf["candidate_id"], pdf["toggled"]):
                    mine = members(rows.names, base_set, change)
                    state = _started(dynamics.leading(rows.z[mine], fit.k), fit)
                    while not state["done"] and state["rounds"] < fit.max_iter:
                        state = _advance(state, set_parts(rows, train, state, mine), fit)
                    yield _result([name], [state], dates)

        sets = spark.createDataFrame(list(toggled.items()), "candidate_id string, toggled string")
        # Each set is few bytes and long work: a task for each, as far as there are any.
        tasks = min(len(toggled), 4 * spark.sparkContext.defaultParallelism)
        return sets.repartition(max(1, tasks), "candidate_id").mapInPandas(run, RESULT)
    size = max(1, len(panel.dates)) * (fit.k + min(len(base) + 1, fit.k + EXTRA)) * 8
    together, names, out = max(1, FACTOR_BYTES // size), list(toggled), None
    for i in range(0, len(names), together):
        block = {n: toggled[n] for n in names[i:i + together]}
        part = spark.createDataFrame(_result(list(block), _fit_by_jobs(panel, base, block, fit), panel.dates), RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def _sum_by_set(panel: Panel, part, combine, schema: str) -> list:
    """One job: ``part(rows)`` gives (set number, vector) of the rows of a task,
    vectors are added by set, ``combine(number, vector)`` gives the set's row."""
    size, train = len(panel.dates), int(panel.train.sum())

    def parts(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for number, vector in part(_rows(pdf, size, train)):
                sums[number] = sums[number] + vector if number in sums else vector
        for number, vector in sums.items():
            yield pd.DataFrame({"number": [number], "vector": [vector]})

    def total(pdf):
        # Sorted, so that a repeated task adds in the same order.
        vectors = sorted(pdf["vector"], key=lambda v: tuple(v[:8]))
        return combine(int(pdf["number"].iloc[0]), np.sum(vectors, axis=0))

    return panel.rows.mapInPandas(parts, "number int, vector array<double>").groupBy("number").applyInPandas(total, schema).collect()


def _shared(panel: Panel, value):
    return panel.rows.sparkSession.sparkContext.broadcast(value)


def leading_by_jobs(panel: Panel, base: list[str], toggled: dict[str, str | None], k: int) -> list[np.ndarray]:
    """``dynamics.leading`` of every set by block subspace iteration.

    Each step is two sums of a few columns, one over a date's variables and one
    over the variables' products, and a small decomposition per set."""
    base_set, changes, t = frozenset(base), list(toggled.values()), int(panel.train.sum())
    width = min(t, k + EXTRA)
    start = np.linalg.qr(np.random.default_rng(1).standard_normal((t, width)))[0]
    blocks, ritz, before, resting = [start] * len(changes), [None] * len(changes), [None] * len(changes), set()
    for _ in range(MOST_STEPS):
        shared = _shared(panel, {i: b for i, b in enumerate(blocks) if i not in resting})

        def part(rows):
            for i, q in shared.value.items():
                z = rows.z[members(rows.names, base_set, changes[i])]
                w = z @ q
                yield i, np.concatenate([(w.T @ w).ravel(), (z.T @ w).ravel()])

        def combine(i, vector):
            values, vecs = np.linalg.eigh(vector[:width * width].reshape(width, width))
            values, vecs = np.maximum(values[::-1], 0.0), vecs[:, ::-1]
            here = shared.value[i] @ vecs[:, :k] * np.sqrt(values[:k])
            block = np.linalg.qr(vector[width * width:].reshape(t, width) @ vecs)[0]
            return pd.DataFrame({"number": [i], "values": [values[:k]], "ritz": [here.ravel()], "block": [block.ravel()]})

        for row in _sum_by_set(panel, part, combine, "number int, values array<double>, ritz array<double>, block array<double>"):
            i, values = row["number"], np.array(row["values"])
            if before[i] is not None and np.all(np.abs(values - before[i]) <= REST * values[0]):
                resting.add(i)
            before[i], blocks[i], ritz[i] = values, np.reshape(row["block"], (t, width)), np.reshape(row["ritz"], (t, k))
        shared.unpersist()
        if len(resting) == len(changes):
            break
    return [dynamics.oriented(f) for f in ritz]


def _fit_by_jobs(panel: Panel, base: list[str], toggled: dict[str, str | None], fit: Fit) -> list[dict]:
    base_set, changes, size, k, m = frozenset(base), list(toggled.values()), len(panel.dates), fit.k, fit.k * fit.order
    states = [_started(f, fit) for f in leading_by_jobs(panel, base, toggled, k)]
    shapes = {"n": (size,), "c": (size, k, k), "b": (size, k), "c0": (size, k, k), "b0": (size, k), "s0": (size,), "ld": (size,)}
    cuts = np.cumsum([int(np.prod(shapes[n])) for n in KEYS])[:-1]
    train = panel.train
    for _ in range(fit.max_iter):
        now = {i: s for i, s in enumerate(states) if not s["done"]}
        if not now:
            break
        shared = _shared(panel, now)

        def part(rows):
            for i, state in shared.value.items():
                info = set_parts(rows, train, state, members(rows.names, base_set, changes[i]))
                yield i, np.concatenate([info[n].ravel() for n in KEYS])

        def combine(i, vector):
            info = {n: x.reshape(shapes[n]) for n, x in zip(KEYS, np.split(vector, cuts))}
            out = _advance(shared.value[i], info, fit)
            return pd.DataFrame({"number": [i], "f": [out["f"].ravel()], "a": [out["a"].ravel()], "q": [out["q"].ravel()], "x0": [out["x0"]],
                                 "p0": [out["p0"].ravel()], "last": [out["last"]], "done": [bool(out["done"])], "rounds": [out["rounds"]]})

        schema = "number int, f array<double>, a array<double>, q array<double>, x0 array<double>, p0 array<double>, last double, done boolean, rounds int"
        for row in _sum_by_set(panel, part, combine, schema):
            states[row["number"]] |= {
                "f": np.reshape(row["f"], (size, k)), "a": np.reshape(row["a"], (m, m)), "q": np.reshape(row["q"], (m, m)), "x0": np.array(row["x0"]),
                "p0": np.reshape(row["p0"], (m, m)), "last": row["last"], "done": row["done"], "rounds": row["rounds"]}
        shared.unpersist()
    return states
