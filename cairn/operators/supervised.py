"""Supervised evaluation with Spark ML: preparation learned on the training split, candidates against a baseline, one report on the test split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.guards import col, finite, is_numeric, kind_of
from cairn.operators import scoring

#: Categories of a feature that have a place of their own; rarer ones share one.
CATEGORIES = 32
#: Rows with a target below which nothing is fitted.
LEAST = 30


@dataclass(frozen=True)
class Report:
    """Validation errors of all candidates, which one was taken, its test scores and those of the baseline, and a recommendation."""

    validation: dict[str, float]
    chosen: str
    test: dict[str, float]
    baseline: dict[str, float]
    model: PipelineModel


def _prepared(df: DataFrame, target: str, features: list[str], task: str) -> DataFrame:
    """Target as double label, numbers as doubles with NaN for null (what Imputer fills), categories as text with the 32 most frequent kept."""
    out = []
    for f in features:
        if is_numeric(kind_of(df, f)):
            out.append(F.coalesce(finite(df, f).cast("double"), F.lit(float("nan"))).alias(f))
        else:
            out.append(F.coalesce(col(f).cast("string"), F.lit("")).alias(f))
    label = finite(df, target).cast("double") if task == "regression" else col(target).cast("int").cast("double")
    return df.select(*[c for c in ("split",) if c in df.columns], label.alias("label"), *out).where("label is not null")


def _stages(df: DataFrame, features: list[str], train: DataFrame) -> list:
    numbers = [f for f in features if is_numeric(kind_of(df, f))]
    texts = [f for f in features if f not in numbers]
    stages, inputs = [], []
    if numbers:
        stages += [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{f}_filled" for f in numbers]), VectorAssembler(inputCols=[f"{f}_filled" for f in numbers], outputCol="_numbers"), StandardScaler(withMean=True, inputCol="_numbers", outputCol="_scaled")]
        inputs.append("_scaled")
    for f in texts:
        stages += [StringIndexer(inputCol=f, outputCol=f"{f}_at", handleInvalid="keep"), OneHotEncoder(inputCol=f"{f}_at", outputCol=f"{f}_hot", handleInvalid="keep")]
        inputs.append(f"{f}_hot")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def _folded(df: DataFrame, train: DataFrame, texts: list[str]) -> DataFrame:
    """Categories beyond the CATEGORIES most frequent of the training rows become one."""
    for f in texts:
        top = [r[0] for r in train.groupBy(col(f)).count().orderBy(F.desc("count"), col(f)).limit(CATEGORIES).collect()]
        df = df.withColumn(f, F.when(col(f).isin(*top), col(f)).otherwise("other"))
    return df


def _candidates(task: str) -> dict:
    if task == "regression":
        return {"ridge_1": LinearRegression(regParam=1.0, elasticNetParam=0.0), "ridge_0.1": LinearRegression(regParam=0.1, elasticNetParam=0.0), "forest": RandomForestRegressor(numTrees=20, maxDepth=6, seed=42)}
    return {"logistic_0.01": LogisticRegression(regParam=0.01), "logistic_0.1": LogisticRegression(regParam=0.1), "forest": RandomForestClassifier(numTrees=20, maxDepth=6, seed=42)}


def _scores(task: str, df: DataFrame) -> dict[str, float]:
    if task == "regression":
        return scoring.regression_scores(df, "label", "prediction").first().asDict()
    out = scoring.classification_scores(df, "label", "prediction").first().asDict()
    return out | scoring.ranking_scores(df, "label", "p").drop("n").first().asDict() if "p" in df.columns else out


def evaluate(df: DataFrame, target: str, features: list[str], task: str, split: str = "split") -> Report:
    """Fits the candidates on rows with split train, chooses on validation, reports on test against a constant baseline.

    Features that copy the target are an error. task: regression or
    classification (0/1). All fitting runs in Spark ML over all rows.
    """
    if task not in ("regression", "classification"):
        raise ValueError(f"no task {task!r}")
    copies = [r.feature for r in scoring.leakage(df, target, features).where("verdict = 'copy'").collect()]
    if copies:
        raise ValueError(f"{copies} copy the target")
    rows = _prepared(df.withColumnRenamed(split, "split"), target, features, task)
    train = rows.where("split = 'train'")
    if train.count() < LEAST:
        raise ValueError(f"fewer than {LEAST} training rows")
    texts = [f for f in features if not is_numeric(kind_of(df, f))]
    rows = _folded(rows, train, texts)
    train = rows.where("split = 'train'")
    prepared = Pipeline(stages=_stages(df, features, train)).fit(train)
    parts = {s: prepared.transform(rows.where(F.col("split") == s)).select("label", "features").persist() for s in ("train", "validation", "test")}
    measure, sign = ("mae", 1) if task == "regression" else ("macro_f1", -1)
    fitted, validation = {}, {}

    def guessed(model, part):
        out = model.transform(part)
        return out.select("label", "prediction", vector_to_array("probability")[1].alias("p")) if task == "classification" else out.select("label", "prediction")

    for name, estimator in _candidates(task).items():
        fitted[name] = estimator.fit(parts["train"])
        validation[name] = _scores(task, guessed(fitted[name], parts["validation"]))[measure]
    chosen = min(validation, key=lambda n: (sign * validation[n], n))
    constant = parts["train"].agg(F.avg("label") if task == "regression" else F.mode("label", True)).first()[0]
    test = _scores(task, guessed(fitted[chosen], parts["test"]))
    baseline = _scores(task, parts["test"].withColumn("prediction", F.lit(float(constant))))
    for part in parts.values():
        part.unpersist()
    return Report(validation, chosen, test, baseline, PipelineModel(stages=[*prepared.stages, fitted[chosen]]))


def task_suitability(profile: DataFrame, kinds: dict[str, str], n_rows: int) -> list[dict]:
    """Which tasks a table's profile (column_name, n_null, n_distinct) admits: forecasting, regression, classification, anomaly, descriptive.

    Constant columns and likely identifiers (20 or more values of which 98 per
    cent differ) are no targets. The profile has one row a column.
    """
    numbers, classes, times = [], [], []
    for r in profile.select("column_name", "n_null", "n_distinct").collect():
        valid = n_rows - r.n_null
        if kinds[r.column_name] in ("date", "timestamp"):
            times.append(r.column_name)
        elif r.n_distinct < 2 or (valid >= 20 and r.n_distinct / max(valid, 1) >= 0.98 and kinds[r.column_name] != "number"):
            continue
        elif kinds[r.column_name] == "number":
            numbers.append(r.column_name)
        if 2 <= r.n_distinct <= CATEGORIES:
            classes.append(r.column_name)
    found = {"forecasting": bool(times and numbers), "regression": len(numbers) >= 2, "classification": bool(classes), "anomaly_detection": bool(numbers) and n_rows >= 8, "descriptive": n_rows > 0}
    enough = {"forecasting": 15, "regression": LEAST, "classification": LEAST, "anomaly_detection": 8, "descriptive": 1}
    return [{"task": t, "suitable": ok and n_rows >= enough[t]} for t, ok in sorted(found.items())]
