"""Saving and loading of aggregates, models and experiments: Parquet tables and JSON, never pickles or code."""

from __future__ import annotations

import json
from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from crosstally.operators.dictionary import Dictionaries
from crosstally.operators.mrf import Model, Params
from crosstally.operators.models import Logistic
from crosstally.plans.grammar import Pair, QuerySet, Single


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One small JSON document as a one-row text table, through Spark, so that any store it knows will do."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path).first()[0])


def queries_to_dict(queries: QuerySet) -> dict:
    return {"features": list(queries.features), "sizes": dict(queries.sizes), "queries": [{"kind": type(q).__name__, **{f.name: getattr(q, f.name) for f in fields(q)}} for q in queries.queries]}


def queries_from_dict(value: dict) -> QuerySet:
    made = tuple((Pair if q.pop("kind") == "Pair" else Single)(**q) for q in [dict(q) for q in value["queries"]])
    return QuerySet(tuple(value["features"]), value["sizes"], made)


def save_aggregate(path: str, table: DataFrame, queries: QuerySet, dictionaries: Dictionaries | None = None, noise: dict | None = None) -> None:
    """The long table, the dictionaries and a manifest that also keeps the noise's law."""
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{path}/cells")
    if dictionaries is not None:
        dictionaries.table.write.mode("overwrite").parquet(f"{path}/dictionaries")
    write_json(spark, f"{path}/manifest", {"queries": queries_to_dict(queries), "noise": noise, "types": dict(dictionaries.types) if dictionaries else None, "sizes": dict(dictionaries.sizes) if dictionaries else None})


def load_aggregate(spark: SparkSession, path: str) -> tuple[DataFrame, QuerySet, Dictionaries | None, dict | None]:
    m = read_json(spark, f"{path}/manifest")
    known = Dictionaries(spark.read.parquet(f"{path}/dictionaries"), m["sizes"], m["types"]) if m["types"] else None
    return spark.read.parquet(f"{path}/cells"), queries_from_dict(m["queries"]), known, m["noise"]


def _vectors(spark: SparkSession, **vectors: np.ndarray) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"param": np.arange(len(next(iter(vectors.values())))), **{k: np.asarray(v, float) for k, v in vectors.items()}}))


def save_model(spark: SparkSession, path: str, model: Model) -> None:
    _vectors(spark, mu=model.mu, theta=model.theta, displays=model.displays, clicks=model.clicks, mask=model.click_mask).write.mode("overwrite").parquet(f"{path}/parameters")
    for name in ("samples", "noise_samples"):
        if getattr(model, name) is not None:
            getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")
    write_json(spark, f"{path}/manifest", {"queries": queries_to_dict(model.queries), "params": model.params.to_dict(), "n": model.n, "c": model.c, "bias": model.bias, "mu0": model.mu0, "iteration": model.iteration, "history": model.history, "samples": [x for x in ("samples", "noise_samples") if getattr(model, x) is not None]})


def load_model(spark: SparkSession, path: str) -> Model:
    m = read_json(spark, f"{path}/manifest")
    v = spark.read.parquet(f"{path}/parameters").orderBy("param").toPandas()
    model = Model(queries_from_dict(m["queries"]), Params(**m["params"]), v["displays"].to_numpy(), v["clicks"].to_numpy(), m["n"], m["c"], v["mu"].to_numpy(), v["theta"].to_numpy(), m["bias"], m["mu0"], v["mask"].to_numpy() > 0, iteration=m["iteration"], history=m["history"])
    for name in m["samples"]:
        setattr(model, name, spark.read.parquet(f"{path}/{name}"))
    return model


def save_logistic(spark: SparkSession, path: str, model: Logistic) -> None:
    _vectors(spark, theta=model.theta).write.mode("overwrite").parquet(f"{path}/parameters")
    write_json(spark, f"{path}/manifest", {"queries": queries_to_dict(model.queries), "bias": model.bias})


def load_logistic(spark: SparkSession, path: str) -> Logistic:
    m = read_json(spark, f"{path}/manifest")
    return Logistic(queries_from_dict(m["queries"]), spark.read.parquet(f"{path}/parameters").orderBy("param").toPandas()["theta"].to_numpy(), m["bias"])


def run_experiment(spark: SparkSession, path: str, model: Model, step: int, rounds: int, validate: object) -> list[dict]:
    """Fit some iterations, save, validate, log; a run that starts again goes on from what it saved."""
    from crosstally.operators.mrf import fit

    try:
        log = list(read_json(spark, f"{path}/log"))
        model = load_model(spark, f"{path}/model-{log[-1]['iteration']}")
    except Exception as error:  # nothing saved yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        log = []
    while len(log) < rounds:
        model = fit(model, step)
        save_model(spark, f"{path}/model-{model.iteration}", model)
        log.append({"iteration": model.iteration, **validate(model)})  # type: ignore[operator]
        write_json(spark, f"{path}/log", log)
    return log
