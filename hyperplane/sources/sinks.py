"""Models, predictions and results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def model_path(folder: str, dataset: str, kernel: str, solver: str) -> str:
    return f"{folder.rstrip('/')}/{dataset}_{kernel}_{solver}.model"


def write_model_text(model: DataFrame, path: str, c: float, parameters: list[float] | None = None) -> None:
    """The model as lines: a summary, C, kernel parameters, ``#``, then one alpha per support row in order of ids."""
    head = model.agg(F.count("sv_id").alias("n_sv"), F.first("rho").alias("rho"), F.first("objective").alias("objective"), F.max("iterations").alias("iterations"))
    text = F.concat_ws("\n", F.concat(F.lit("iterations="), "iterations", F.lit(" objective="), "objective", F.lit(" rho="), "rho", F.lit(" nSV="), "n_sv"), F.lit(f"C={c}"), F.lit("Kernel Params=" + ";".join(map(str, parameters or []))), F.lit("#"))
    top = head.select(F.lit(-1).cast("long").alias("at"), text.alias("value"))
    rows = model.where("sv_id is not null").select(F.col("sv_id").alias("at"), F.col("alpha").cast("string").alias("value"))
    top.unionByName(rows).orderBy("at").select("value").write.mode("overwrite").text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One integer a line, in order of ids; files follow the order."""
    predictions.orderBy("id").select(F.col("pred").cast("int").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)
