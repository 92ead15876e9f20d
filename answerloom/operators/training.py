"""Training and tuning of a three-class text classifier with Spark ML.

The text is the same model input that grading uses; the model is logistic
regression over hashed words, so that training runs on the executors. It is
not a language model and makes no claim to the accuracy of one.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from answerloom.operators import confusion as cm, metrics as mt
from answerloom.operators.leaderboard import best_runs
from answerloom.session import settle


def pipeline(features: int = 1 << 14, iterations: int = 20, regularization: float = 0.01) -> Pipeline:
    """Words to hashed counts to logistic regression; columns text and labels."""
    return Pipeline(
        stages=[
            Tokenizer(inputCol="text", outputCol="words"),
            HashingTF(inputCol="words", outputCol="features", numFeatures=features),
            LogisticRegression(
                labelCol="labels", family="multinomial", maxIter=iterations, regParam=regularization
            ),
        ]
    )


def train(train_rows: DataFrame, **options) -> PipelineModel:
    return pipeline(**options).fit(train_rows.select("text", F.col("labels").cast("double").alias("labels")))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add y_pred; a label column, if there is one, becomes y_true."""
    scored = model.transform(df).withColumn("y_pred", F.col("prediction").cast("int"))
    if "labels" in df.columns:
        scored = scored.withColumn("y_true", F.col("labels").cast("int"))
    return scored.drop("words", "features", "rawPrediction", "probability", "prediction")


def param_grid(model: Pipeline, regularization, iterations) -> list:
    regression = model.getStages()[-1]
    return (
        ParamGridBuilder()
        .addGrid(regression.regParam, list(regularization))
        .addGrid(regression.maxIter, list(iterations))
        .build()
    )


def grid_search(
    train_rows: DataFrame, val_rows: DataFrame, grid: list, base: Pipeline, metric: str = "macro_f1", parallel: int = 4,
) -> tuple[DataFrame, list]:
    """Metrics per combination on the validation rows, and the fitted models.

    Models are fitted on the training rows and compared on the given
    validation rows only. The feature stages are fitted once and their output
    is written; combinations fit the regression alone, `parallel` of them at a time, so that the cluster has work
    while a fit waits for its slowest task. One scan of the validation rows scores all of them: every model adds its
    prediction to the row, and the predictions are counted together, keyed by combination.
    """
    data = train_rows.select("text", F.col("labels").cast("double").alias("labels"))
    features = Pipeline(stages=base.getStages()[:-1]).fit(data)
    ready = settle(features.transform(data).select("features", "labels"), "features")
    with ThreadPoolExecutor(parallel) as pool:
        fitted = list(pool.map(lambda params: base.getStages()[-1].fit(ready, params), grid))
    models = [PipelineModel([*features.stages, model]) for model in fitted]
    scored = features.transform(val_rows.select("text", "labels")).select("features", "labels")
    for i, model in enumerate(fitted):
        alone = model.copy({model.predictionCol: f"_{i}", model.rawPredictionCol: "", model.probabilityCol: ""})
        scored = alone.transform(scored)
    together = scored.select(
        F.col("labels").cast("int").alias("y_true"),
        F.inline(F.array(*[
            F.struct(
                F.lit(i + 1).alias("combination_idx"),
                F.lit(", ".join(f"{p.name}={x}" for p, x in params.items())).alias("params"),
                F.col(f"_{i}").cast("int").alias("y_pred"),
            )
            for i, params in enumerate(grid)
        ])),
    )
    keys = ["combination_idx", "params"]
    results = mt.summary(cm.cells(together, keys), keys)
    return results.withColumn("metric_value", F.col(metric)), models


def best_combination(results: DataFrame) -> DataFrame:
    """The best row; among equals the first combination."""
    return best_runs(results, [], "metric_value", "combination_idx")
