"""Factor extraction, regression on factors, and the dynamic factor model.

Panels are long: ``(model_id, d, variable, v)``, dense over each model's dates.
Sums over variables and over dates are ordinary aggregations; only recursions
over a model's dates in the small factor dimension run in a grouped map, on
one row per date."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import dynamics, toggles, window
from tidemark.operators.dynamics import GAIN_JITTER, MIN_EIGENVALUE, MIN_VARIANCE
from tidemark.session import cut_lineage

MODEL = ["model_id"]
VARIABLE = ["model_id", "variable"]

DOUBLES = T.ArrayType(T.DoubleType())


def vectors(factors: DataFrame, value: str = "v") -> DataFrame:
    """Long factors ``(model_id, d, factor, v)`` to one array per date."""
    ordered = F.array_sort(F.collect_list(F.struct("factor", F.col(value).alias("x"))))
    return factors.groupBy("model_id", "d").agg(ordered.alias("_f")).select(
        "model_id", "d", F.transform("_f", lambda s: s["x"]).alias("f"))


def scores(rows: DataFrame, k: int, column: str = "f") -> DataFrame:
    """Factor arrays back to long rows, factors numbered from 1."""
    keep = [c for c in ("model_id", "d") if c in rows.columns]
    return rows.select(*keep, F.posexplode(column).alias("factor", "v")).withColumn("factor", F.col("factor") + 1)


def _item(c: str, i: int) -> Column:
    return F.col(c)[i]


@F.pandas_udf(DOUBLES)
def _solve(gram: pd.Series, moment: pd.Series) -> pd.Series:
    """Least-squares coefficients from stacked normal equations."""
    b = np.stack(moment.to_numpy()).astype(float)
    g = np.stack(gram.to_numpy()).astype(float).reshape(len(b), b.shape[1], b.shape[1])
    return pd.Series(list((np.linalg.pinv(g) @ b[:, :, None])[:, :, 0]))


def regress(rows: DataFrame, keys: list[str], k: int, min_extra: int = 2) -> DataFrame:
    """No-intercept regression of ``y`` on the factor array ``f`` per key.

    One partial aggregation of the normal equations, whatever the number of
    dates; then a k-by-k solve per row.  Coefficients are null with fewer than
    ``k + min_extra`` rows.  ``variance`` is that of the residuals."""
    usable = rows.filter(F.col("y").isNotNull())
    f = [_item("f", i) for i in range(k)]
    sums = [F.sum(f[i] * f[j]) for i in range(k) for j in range(k)]
    agg = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.array(*sums).alias("gram"), F.array(*[F.sum(x * F.col("y")) for x in f]).alias("moment"),
        F.array(*[F.sum(x) for x in f]).alias("sf"))
    solved = agg.withColumn("h", _solve("gram", "moment"))
    dot = lambda a, b: sum((F.col(a)[i] * F.col(b)[i] for i in range(k)), F.lit(0.0))
    quad = sum((F.col("h")[i] * F.col("h")[j] * F.col("gram")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))
    mean = (F.col("sy") - dot("h", "sf")) / F.col("n")
    variance = (F.col("syy") - 2 * dot("h", "moment") + quad) / F.col("n") - mean * mean
    enough = F.col("n") >= k + min_extra
    return solved.select(*keys, "n", F.when(enough, F.col("h")).alias("h"),
                         F.when(enough, F.greatest(variance, F.lit(0.0))).alias("variance"))


def estimate_loadings(panel: DataFrame, factors: DataFrame, k: int, train_end=None) -> DataFrame:
    """Loading of every variable on long factors, optionally on training dates."""
    f = vectors(factors)
    if train_end is not None:
        f = f.filter(F.col("d") <= F.lit(train_end).cast("date"))
    rows = panel.join(f, ["model_id", "d"]).select(*VARIABLE, "f", F.col("v").alias("y"))
    out = regress(rows, VARIABLE, k)
    return out.select(*VARIABLE, "n", F.posexplode_outer("h").alias("factor", "loading")).withColumn("factor", F.col("factor") + 1)


def _standardized(panel: DataFrame, start, end) -> DataFrame:
    """Training-window standardised values (null to 0), centred values, deviation."""
    train = F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    v = F.when(train, F.col("v"))
    flat = F.coalesce(F.min(v) == F.max(v), F.lit(True)) | (F.count(v) < 2)
    scaler = panel.groupBy(*VARIABLE).agg(F.avg(v).alias("mu"), F.when(flat, 1.0).otherwise(F.stddev_samp(v)).alias("sigma"))
    y = F.col("v") - F.col("mu")
    return panel.join(scaler, VARIABLE).select(
        *VARIABLE, "d", y.alias("y"), F.coalesce(y / F.col("sigma"), F.lit(0.0)).alias("z"), "sigma", train.alias("train"))


#: Models whose smaller side, variables or dates, is at most this have all their
#: components; larger ones have their leading ones, by subspace iteration.
FULL_SIDE, LEADING = 2000, 100
#: Bytes of date-by-date sums that a task holds before it hands them on.
HELD_BYTES = 64 << 20


def _components(train: DataFrame, k: int, centre: bool, listed: int | None = None) -> DataFrame:
    """Leading date vectors times singular values ``f`` of each model and date,
    its eigenvalues ``eigen`` (all of them, or the ``listed`` leading ones of a
    very large model), their ``total`` and number of variables ``n``.

    A variable is one array of calendar length.  The products are taken over
    the smaller side: variable by variable in one task of a model with few
    variables, date by date in sums that every task adds up first, and of a few
    columns at a time where both sides are large.  The sign of each factor
    makes its largest entry positive."""
    z = F.transform("a", lambda x: x["z"])
    if centre:
        z = F.transform(z, lambda x: x - F.col("mean"))
    rows = cut_lineage(train.groupBy(*VARIABLE).agg(F.array_sort(F.collect_list(F.struct("d", "z"))).alias("a"), F.avg("z").alias("mean")).select(
        *VARIABLE, F.transform("a", lambda x: x["d"]).alias("dates"), z.alias("z")))
    sizes = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("z")).alias("t"))
    side = F.when(F.least("n", "t") > FULL_SIDE, "neither").when(F.col("n") <= F.col("t"), "variables").otherwise("dates")
    tagged = sizes.select("model_id", side.alias("side"))
    found = {r["side"]: r["models"] for r in tagged.groupBy("side").agg(
        F.collect_list(F.when(F.col("side") == "neither", F.col("model_id"))).alias("models")).collect()}
    of_side = lambda s: rows if set(found) == {s} else rows.join(tagged.filter(F.col("side") == s), "model_id", "left_semi")
    parts = []
    if "variables" in found or not found:
        parts.append(_by_variables(of_side("variables") if found else rows, k))
    if "dates" in found:
        parts.append(_by_dates(of_side("dates"), k))
    for model in found.get("neither", []):
        parts.append(_by_columns(rows.filter(F.col("model_id") == model), k, listed or k))
    return reduce(lambda x, y: x.unionByName(y), parts)


def _component_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["model_id"], T.StructField("d", T.DateType()), T.StructField("f", DOUBLES),
                         T.StructField("eigen", DOUBLES), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])


def _component_rows(model, dates, f, values, total, n) -> pd.DataFrame:
    return pd.DataFrame({"model_id": model, "d": list(dates), "f": list(f), "eigen": [values] * len(dates), "total": float(total), "n": int(n)})


def _by_variables(rows: DataFrame, k: int) -> DataFrame:
    def solve(pdf):
        z = np.stack(pdf.sort_values("variable")["z"].to_numpy()).astype(float)
        values = np.maximum(np.linalg.eigvalsh(z @ z.T)[::-1], 0.0)
        return _component_rows(pdf["model_id"].iloc[0], pdf["dates"].iloc[0], dynamics.leading(z, k), values, values.sum(), len(z))
    return rows.groupBy("model_id").applyInPandas(solve, _component_schema(rows))


def _by_dates(rows: DataFrame, k: int) -> DataFrame:
    """Date-by-date products, summed over variables: what is shuffled is one
    table per task and model, independent of the number of variables."""
    def partial(batches):
        sums, dates, count = {}, {}, {}

        def flush():
            for model, g in sums.items():
                yield pd.DataFrame({"model_id": model, "d": dates[model], "row": list(g), "n": count[model]})
            for held in (sums, dates, count):
                held.clear()

        for pdf in batches:
            for model, part in pdf.groupby("model_id"):
                z = np.stack(part["z"].to_numpy()).astype(float)
                sums[model] = sums.get(model, 0) + z.T @ z
                count[model] = count.get(model, 0) + len(z)
                dates.setdefault(model, part["dates"].iloc[0])
                if sum(g.nbytes for g in sums.values()) > HELD_BYTES:
                    yield from flush()
        yield from flush()

    def total(pdf):
        return pd.DataFrame({"model_id": [pdf["model_id"].iloc[0]], "d": [pdf["d"].iloc[0]],
                             "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)], "n": [pdf["n"].sum()]})

    def solve(pdf):
        pdf = pdf.sort_values("d")
        values, vecs = np.linalg.eigh(np.stack(pdf["row"].to_numpy()))
        values, vecs = np.maximum(values[::-1], 0.0), vecs[:, ::-1][:, :k]
        keep = int(min(pdf["n"].iloc[0], len(pdf)))
        return _component_rows(pdf["model_id"].iloc[0], pdf["d"], dynamics.oriented(vecs * np.sqrt(values[:k])), values[:keep], values[:keep].sum(), pdf["n"].iloc[0])

    schema = T.StructType([rows.schema["model_id"], T.StructField("d", T.DateType()), T.StructField("row", DOUBLES), T.StructField("n", T.LongType())])
    gram = rows.mapInPandas(partial, schema).groupBy("model_id", "d").applyInPandas(total, schema)
    return gram.groupBy("model_id").applyInPandas(solve, _component_schema(rows))


def _by_columns(rows: DataFrame, k: int, listed: int) -> DataFrame:
    """Leading components of one large model by block subspace iteration."""
    first = rows.select("model_id", "dates").first()
    names = [r[0] for r in rows.select("variable").collect()]
    panel = toggles.Panel(rows.select("variable", F.col("z").alias("y"), "z", F.lit(1.0).alias("sigma")), list(first["dates"]), np.ones(len(first["dates"]), bool))
    f = toggles.leading_by_jobs(panel, names, {"all": None}, min(max(k, listed), len(first["dates"]), len(names)))[0]
    total = rows.agg(F.sum(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    made = _component_rows(first["model_id"], first["dates"], f[:, :k], (f * f).sum(axis=0), total, len(names))
    return rows.sparkSession.createDataFrame(made, _component_schema(rows))


def spectrum(panel: DataFrame, train_start, train_end) -> DataFrame:
    """Eigenvalue, explained share and cumulative share of each component.

    Principal components of the training-standardised panel, nulls at the
    mean, variables without spread left out."""
    std = _standardized(panel, train_start, train_end).filter("train")
    moving = std.groupBy(*VARIABLE).agg(F.min("z").alias("lo"), F.max("z").alias("hi")).filter("lo < hi")
    train = std.join(moving, VARIABLE, "left_semi")
    one = _components(train, 1, True, LEADING).groupBy("model_id").agg(
        F.first("eigen").alias("eigen"), F.count(F.lit(1)).alias("t"), F.first("n").alias("n_variables"), F.first("total").alias("total"))
    rows = one.select("model_id", "t", "n_variables", "total", "eigen", F.posexplode("eigen").alias("i", "e"))
    running = F.aggregate(F.slice("eigen", F.lit(1), F.col("i") + 1), F.lit(0.0), lambda a, x: a + x)
    return rows.select("model_id", (F.col("i") + 1).alias("component"), F.try_divide("e", F.col("t") - 1).alias("eigenvalue"),
                       F.try_divide("e", "total").alias("ratio"), F.try_divide(running, F.col("total")).alias("cumulative"), "n_variables")


def choose_factors(components: DataFrame, method: str = "cumulative", fixed: int = 4, threshold: float = 0.9,
                   elbow: float = 0.1, kaiser: float = 1.0) -> DataFrame:
    """Number of factors per model by one rule, between 1 and variables - 1.

    A model that does not meet the rule has no number but a ``problem``."""
    from pyspark.sql import Window
    step = F.lead("ratio").over(Window.partitionBy("model_id").orderBy("component")) - F.col("ratio")
    components = components.withColumn("n_variables", F.col("n_variables").cast("int"))
    marked = components.withColumn("step", step)
    k = {"fixed": F.when(F.max("component") >= fixed, F.lit(fixed)),
         "cumulative": F.min(F.when(F.col("cumulative") >= threshold - 1e-12, F.col("component"))),
         "elbow": F.min(F.when(F.col("step") < elbow, F.col("component"))),
         "kaiser": F.nullif(F.count_if(F.col("eigenvalue") > kaiser), F.lit(0))}[method]
    clamped = F.greatest(F.lit(1), F.least("k", F.col("m") - 1)).cast("int")
    return marked.groupBy("model_id").agg(k.cast("int").alias("k"), F.max("n_variables").alias("m")).select(
        "model_id", F.when(F.col("k").isNotNull(), clamped).alias("k"),
        F.when(F.col("k").isNull(), F.lit(f"no number of factors meets the rule {method}")).alias("problem"))


def static_factors(panel: DataFrame, k: int, train_start, train_end) -> tuple[DataFrame, DataFrame]:
    """Initial factors on the training dates, and per variable its component
    weights, loading on centred values and idiosyncratic variance."""
    std = cut_lineage(_standardized(panel, train_start, train_end))
    train = std.filter("train")
    factors = cut_lineage(_components(train, k, False).select("model_id", "d", "f"))
    joined = train.join(factors, ["model_id", "d"])
    weights = regress(joined.select(*VARIABLE, "f", F.col("z").alias("y")), VARIABLE, k)
    loads = regress(joined.select(*VARIABLE, "f", "y"), VARIABLE, k)
    sigma = std.groupBy(*VARIABLE).agg(F.first("sigma").alias("sigma"))
    params = (weights.select(*VARIABLE, F.col("h").alias("w"), F.col("variance").alias("psi"))
              .join(loads.select(*VARIABLE, "h"), VARIABLE).join(sigma, VARIABLE)
              .select(*VARIABLE, "w", "h", F.greatest(F.col("psi") * F.col("sigma") * F.col("sigma"), F.lit(MIN_VARIANCE)).alias("r")))
    return factors, params


def _first_dynamics(factors: DataFrame, k: int, order: int) -> DataFrame:
    def fit(pdf):
        f = np.stack(pdf.sort_values("d")["f"].to_numpy())
        a, q = dynamics.first_dynamics(f, order)
        return pd.DataFrame({"model_id": [pdf["model_id"].iloc[0]], "a": [a.ravel()], "q": [q.ravel()], "x0": [np.zeros(k * order)],
                             "p0": [np.eye(k * order).ravel()], "last": [None], "done": [False], "rounds": [0]})
    return factors.groupBy("model_id").applyInPandas(fit, _dynamics_schema(factors))


def _dynamics_schema(df: DataFrame) -> T.StructType:
    return T.StructType([df.schema["model_id"], *[T.StructField(n, DOUBLES) for n in ("a", "q", "x0", "p0")],
                         T.StructField("last", T.DoubleType()), T.StructField("done", T.BooleanType()),
                         T.StructField("rounds", T.IntegerType())])


def _information(panel: DataFrame, params: DataFrame, k: int) -> DataFrame:
    """What one date's observations say about the factors, summed over variables.

    With uncorrelated measurement errors the update of any number of variables
    needs only sums of ``h h'/r`` and ``h y/r``, so the wide innovation matrix
    is never formed.  Gains use a slightly enlarged r, the likelihood the plain one."""
    rows = panel.join(params.select(*VARIABLE, "h", "r"), VARIABLE)
    seen, y, h = F.col("y").isNotNull(), F.col("y"), [_item("h", i) for i in range(k)]

    def total(e):
        return F.coalesce(F.sum(F.when(seen, e)), F.lit(0.0))

    soft, hard = F.col("r") + GAIN_JITTER, F.col("r")
    grid = lambda r: F.array(*[total(h[i] * h[j] / r) for i in range(k) for j in range(k)])
    line = lambda r: F.array(*[total(h[i] * y / r) for i in range(k)])
    return rows.groupBy("model_id", "d").agg(
        F.count_if(seen).alias("n"), grid(soft).alias("c"), line(soft).alias("b"), grid(hard).alias("c0"),
        line(hard).alias("b0"), total(y * y / hard).alias("s0"), total(F.ln(hard)).alias("ld"))


def _filter_and_smooth(k: int, order: int, tolerance: float):
    """Recursions over one model's dates, and the next dynamics from the result."""
    def run(pdf):
        pdf = pdf.sort_values("d").reset_index(drop=True)
        stack = lambda c: np.stack(pdf[c].to_numpy())
        info = {"n": pdf["n"].to_numpy(), "s0": pdf["s0"].to_numpy(), "ld": pdf["ld"].to_numpy(), "b": stack("b"), "b0": stack("b0"),
                "c": stack("c").reshape(-1, k, k), "c0": stack("c0").reshape(-1, k, k)}
        first, m, size = pdf.iloc[0], k * order, len(pdf)
        out = dynamics.recursion(info, np.reshape(first["a"], (m, m)), np.reshape(first["q"], (m, m)), np.asarray(first["x0"]),
                                 np.reshape(first["p0"], (m, m)), first["last"], bool(first["done"]), k, order, tolerance)
        same = lambda name: [np.ravel(out[name])] * size
        return pd.DataFrame({"model_id": pdf["model_id"], "d": pdf["d"], "f": list(out["f"]), "xp": list(out["xp"]),
                             "pf": list(out["pf"].reshape(size, -1)), "a": same("a"), "q": same("q"), "x0": same("x0"), "p0": same("p0"),
                             "last": out["last"], "done": out["done"], "rounds": int(first["rounds"]) + (not first["done"]), "first": [i == 0 for i in range(size)]})
    return run


def fit(panel: DataFrame, k: int, train_start, train_end, max_iter: int = 30, tolerance: float = 1e-6, order: int = 1) -> dict[str, DataFrame]:
    """Dynamic factor model of every panel at once, by expectation-maximisation.

    Each round is two aggregations and one short grouped map, for all models in
    the same jobs: observations are summed per date, the factor recursions run
    on one row per date, and loadings and error variances are regressed per
    variable.  A converged model keeps its values while others go on.  Rounds
    are materialised, so plans stay short and a lost executor costs one round.
    The random control input of some implementations is fixed at zero.  The
    factors follow an autoregression on ``order`` lags, as a companion state in
    the recursions.

    Returns ``factors``, ``predicted`` (prior states), ``loadings``, ``gains``
    and ``log`` (rounds of each model, likelihood, convergence)."""
    factors, params = static_factors(panel, k, train_start, train_end)
    motion = cut_lineage(_first_dynamics(factors, k, order))
    params = cut_lineage(params.select(*VARIABLE, F.coalesce("h", "w").alias("h"), "r"))
    centred = cut_lineage(_standardized(panel, train_start, train_end).select(*VARIABLE, "d", "y"))
    schema = T.StructType([panel.schema["model_id"], T.StructField("d", T.DateType()),
                           *[T.StructField(n, DOUBLES) for n in ("f", "xp", "pf", "a", "q", "x0", "p0")],
                           T.StructField("last", T.DoubleType()), T.StructField("done", T.BooleanType()),
                           T.StructField("rounds", T.IntegerType()), T.StructField("first", T.BooleanType())])
    step = _filter_and_smooth(k, order, tolerance)
    for _ in range(max_iter):
        facts = _information(centred, params, k).join(motion, "model_id")
        states = cut_lineage(facts.groupBy("model_id").applyInPandas(step, schema))
        used = params
        motion = states.filter("first").select("model_id", "a", "q", "x0", "p0", "last", "done", "rounds")
        active = motion.filter(~F.col("done")).count()
        if active == 0:
            break
        rows = centred.join(states.select("model_id", "d", "f"), ["model_id", "d"])
        new = regress(rows.select(*VARIABLE, "f", "y"), VARIABLE, k)
        moved = used.join(new.select(*VARIABLE, F.col("h").alias("h2"), F.col("variance").alias("r2")), VARIABLE, "left").join(
            motion.select("model_id", "done"), "model_id")
        move = ~F.col("done") & F.col("h2").isNotNull()
        params = cut_lineage(moved.select(*VARIABLE, F.when(move, F.col("h2")).otherwise(F.col("h")).alias("h"),
                                          F.when(move, F.greatest("r2", F.lit(MIN_EIGENVALUE))).otherwise(F.col("r")).alias("r")))
    loadings = params.select(*VARIABLE, F.posexplode("h").alias("factor", "loading")).withColumn("factor", F.col("factor") + 1)
    log = motion.select("model_id", "rounds", F.col("last").alias("loglik"), F.col("done").alias("converged"))
    return {"factors": scores(states, k), "predicted": scores(states, k, "xp").withColumnRenamed("v", "state"),
            "loadings": loadings, "variances": params.select(*VARIABLE, "r"),
            "gains": _gains(centred, used, states, k), "log": log}


def _gains(centred: DataFrame, params: DataFrame, states: DataFrame, k: int) -> DataFrame:
    """Gain of each observed variable on each factor: filtered covariance times
    loading over error variance.  The first date has no update."""
    rows = centred.filter(F.col("y").isNotNull()).join(params, VARIABLE).join(
        states.filter(~F.col("first")).select("model_id", "d", "pf"), ["model_id", "d"])
    row = lambda i: sum((F.col("pf")[i * k + j] * F.col("h")[j] for j in range(k)), F.lit(0.0)) / (F.col("r") + GAIN_JITTER)
    gains = F.array(*[row(i) for i in range(k)])
    return rows.select("model_id", "d", "variable", F.posexplode(gains).alias("factor", "gain")).withColumn("factor", F.col("factor") + 1)


def forecast(factors: DataFrame, target: DataFrame, k: int, train_start, train_end) -> tuple[DataFrame, DataFrame]:
    """Nowcast of the target on every factor date, and its factor loadings.

    The target is standardised on the training period and regressed on the
    factors there without intercept; predictions return to the target's scale.
    ``target`` may be common to all models (no ``model_id``)."""
    f = vectors(factors)
    keys = [c for c in ("model_id", "d") if c in target.columns]
    train = F.col("d").between(F.lit(train_start).cast("date"), F.lit(train_end).cast("date"))
    joined = f.join(target.select(*keys, F.col("v").alias("t")), keys, "left")
    v = F.when(train, F.col("t"))
    moments = joined.groupBy("model_id").agg(F.avg(v).alias("mu"), F.stddev_samp(v).alias("sd"))
    rows = joined.filter(train).join(moments, "model_id").select("model_id", "f", F.try_divide(F.col("t") - F.col("mu"), F.col("sd")).alias("y"))
    beta = regress(rows, MODEL, k, min_extra=0).select("model_id", "h").join(moments, "model_id")
    dot = sum((F.col("f")[i] * F.col("h")[i] for i in range(k)), F.lit(0.0))
    nowcast = f.join(beta, "model_id").select("model_id", "d", (dot * F.col("sd") + F.col("mu")).alias("v"))
    loading = beta.select("model_id", F.col("sd").alias("target_std"), F.posexplode("h").alias("factor", "loading")).withColumn(
        "factor", F.col("factor") + 1)
    return nowcast, loading


def save_model(model: dict[str, DataFrame], path: str) -> None:
    """Write every model table as Parquet, one folder each, keyed by model."""
    for name, df in model.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
