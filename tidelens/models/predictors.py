"""Trainable predictors: assemble, scale, fit, evaluate, score, persist.

The hold-out split hashes the key by MD5, so it is repeatable, needs no shuffle and keeps class shares.
The training frame is checkpointed before the iterative fit: a lost executor re-reads it instead of
recomputing the event aggregates.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.functions.columns import count_if, literal_rows, ratio, round_half_even
from tidelens.functions.distributed import percentile_ranks
from tidelens.models import features as feats
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary
from tidelens.session import checkpoint_dir

SEED = 42
KEYS = ("user_id", "session_key", "label", "weight")


def numeric_columns(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (*KEYS, *drop)]


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL, NaN and infinities become 0."""
    out = {}
    for c in columns:
        v = F.col(c).cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        out[c] = F.when(bad, 0.0).otherwise(v)
    return df.withColumns(out)


def hold_out(df: DataFrame, key: str, test_size: float) -> tuple[DataFrame, DataFrame]:
    part = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    limit = int(test_size * 10_000)
    return df.where(part >= limit), df.where(part < limit)


class Predictor:
    """Shared training and scoring; subclasses choose the estimator."""

    def __init__(self, model_type: str, vocab: Vocabulary = DEFAULT_VOCABULARY, rounds: int = 100):
        """``rounds``: trees of a forest or of a boosted model."""
        self.model_type = model_type
        self.rounds = rounds
        self.vocab = vocab
        self.columns: list[str] = []
        self.model: PipelineModel | None = None

    def estimator(self):
        raise NotImplementedError

    def _pipeline(self) -> Pipeline:
        return Pipeline(
            stages=[
                VectorAssembler(inputCols=self.columns, outputCol="raw"),
                StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                self.estimator(),
            ]
        )

    def _prepared(self, df: DataFrame) -> DataFrame:
        checkpoint_dir(df.sparkSession)
        return clean(df, self.columns).checkpoint()

    def feature_importance(self, top_n: int = 20) -> DataFrame:
        """Tree importances or absolute coefficients, largest first (one row per feature column)."""
        last = self.model.stages[-1]
        values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
        rows = [(c, float(abs(v))) for c, v in zip(self.columns, values.toArray())]
        return literal_rows(SparkSession.getActiveSession(), ["feature", "importance"], rows).orderBy(F.desc("importance"), "feature").limit(top_n)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Predictor:
        self.model = PipelineModel.load(path)
        self.columns = self.model.stages[0].getInputCols()
        return self


class Classifier(Predictor):
    def train(self, df: DataFrame, key: str = "user_id", test_size: float = 0.2) -> DataFrame:
        """Fits on a frame with a 0/1 ``label``; returns one row of hold-out metrics."""
        self.columns = numeric_columns(df)
        data = self._prepared(df)
        if self.model_type in ("random_forest", "logistic"):
            # balanced weights: rows / (2 * rows of the class); two counts, one small job
            n, pos = data.agg(F.count(F.lit(1)), F.sum("label")).first()
            w1, w0 = n / (2.0 * max(pos or 0, 1)), n / (2.0 * max(n - (pos or 0), 1))
            data = data.withColumn("weight", F.when(F.col("label") == 1, w1).otherwise(w0))
        else:
            data = data.withColumn("weight", F.lit(1.0))
        train, test = hold_out(data, key, test_size)
        self.model = self._pipeline().fit(train)
        scored = self.model.transform(test)
        auc = BinaryClassificationEvaluator(labelCol="label").evaluate(scored)
        y, p = F.col("label") == 1, F.col("prediction") == 1
        m = scored.agg(
            count_if(y & p).alias("tp"),
            count_if(~y & p).alias("fp"),
            count_if(y & ~p).alias("fn"),
            count_if(~y & ~p).alias("tn"),
        )
        zero = F.lit(0.0)
        tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
        precision, recall = F.coalesce(ratio(tp, tp + fp), zero), F.coalesce(ratio(tp, tp + fn), zero)
        return m.select(
            ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
            precision.alias("precision"),
            recall.alias("recall"),
            F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero).alias("f1"),
            F.lit(float(auc)).alias("auc_roc"),
            "tp",
            "fp",
            "fn",
            "tn",
            (tp + fp + fn + tn).alias("test_size"),
        )

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        """Adds ``<name>_probability`` and ``<name>_prediction``."""
        scored = self.model.transform(clean(df, self.columns).withColumn("weight", F.lit(1.0)))
        keys = [k for k in ("user_id", "session_key") if k in df.columns]
        return scored.select(
            *keys,
            vector_to_array("probability")[1].alias(f"{name}_probability"),
            F.col("prediction").cast("int").alias(f"{name}_prediction"),
        )

    def estimator(self):
        depth, leaf = self.tree_depth, self.tree_leaf
        if self.model_type == "random_forest":
            return RandomForestClassifier(
                labelCol="label", weightCol="weight", numTrees=self.rounds, maxDepth=depth, minInstancesPerNode=leaf, seed=SEED
            )
        if self.model_type == "gradient_boosting":
            return GBTClassifier(labelCol="label", maxIter=self.rounds, maxDepth=5, stepSize=0.1, seed=SEED)
        if self.model_type == "logistic":
            return LogisticRegression(labelCol="label", weightCol="weight", maxIter=1000)
        raise ValueError(f"unknown model type: {self.model_type}")


class ChurnPredictor(Classifier):
    tree_depth, tree_leaf = 10, 10

    def __init__(self, model_type: str = "random_forest", vocab: Vocabulary = DEFAULT_VOCABULARY, rounds: int = 100):
        super().__init__(model_type, vocab, rounds)

    def run(self, history: DataFrame, future: DataFrame, test_size: float = 0.2) -> dict[str, DataFrame]:
        f = feats.churn_features(history, self.vocab)
        labelled = f.join(feats.churn_labels(history, future), "user_id")
        metrics = self.train(labelled, "user_id", test_size)
        return {
            "metrics": metrics,
            "feature_importance": self.feature_importance(15),
            "predictions": self.predict(f, "churn"),
        }


def at_risk_users(predictions: DataFrame, threshold: float = 0.7) -> DataFrame:
    return predictions.where(F.col("churn_probability") >= threshold).orderBy(F.desc("churn_probability"), "user_id")


class ConversionPredictor(Classifier):
    tree_depth, tree_leaf = 8, 20

    def __init__(self, model_type: str = "gradient_boosting", vocab: Vocabulary = DEFAULT_VOCABULARY, rounds: int = 100):
        super().__init__(model_type, vocab, rounds)

    def run(self, events: DataFrame, level: str = "user", test_size: float = 0.2) -> dict[str, DataFrame]:
        labelled = feats.conversion_labels(feats.conversion_features(events, level, self.vocab), self.vocab)
        leaks = {self.vocab.order, self.vocab.checkout_button, self.vocab.payment}
        kept = feats.without_leaks(labelled)
        kept = kept.drop(*[c for c in kept.columns if any(x in c for x in leaks)])
        key = "user_id" if level == "user" else "session_key"
        metrics = self.train(kept, key, test_size)
        return {
            "metrics": metrics,
            "feature_importance": self.feature_importance(15),
            "predictions": self.predict(kept, "conversion"),
        }


class LtvPredictor(Predictor):
    def __init__(self, model_type: str = "gradient_boosting", vocab: Vocabulary = DEFAULT_VOCABULARY, drop_leaky: bool = False, rounds: int = 100):
        super().__init__(model_type, vocab, rounds)
        self.drop_leaky = drop_leaky

    def estimator(self):
        if self.model_type == "random_forest":
            return RandomForestRegressor(labelCol="label", numTrees=self.rounds, maxDepth=10, seed=SEED)
        if self.model_type == "gradient_boosting":
            return GBTRegressor(labelCol="label", maxIter=self.rounds, maxDepth=5, stepSize=0.1, seed=SEED)
        if self.model_type == "ridge":
            return LinearRegression(labelCol="label", regParam=1.0, elasticNetParam=0.0)
        raise ValueError(f"unknown model type: {self.model_type}")

    def train(self, df: DataFrame, key: str = "user_id", test_size: float = 0.2) -> DataFrame:
        """Fits total revenue; predictions are clipped at 0 before they are measured."""
        self.columns = numeric_columns(df, ("total_revenue",))
        data = self._prepared(df.withColumn("label", F.col("total_revenue").cast("double")))
        train, test = hold_out(data, key, test_size)
        self.model = self._pipeline().fit(train)
        scored = self.model.transform(test).withColumn("prediction", F.greatest("prediction", F.lit(0.0)))
        ev = RegressionEvaluator(labelCol="label")
        values = {m: float(ev.setMetricName(m).evaluate(scored)) for m in ("mae", "rmse", "r2")}
        return scored.agg(
            F.avg("label").alias("mean_actual"), F.avg("prediction").alias("mean_predicted"), F.count(F.lit(1)).alias("test_size")
        ).select(*[F.lit(v).alias(k) for k, v in values.items()], "*")

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(clean(df, [c for c in self.columns]))
        return scored.select(
            "user_id", "total_revenue", F.greatest("prediction", F.lit(0.0)).alias("predicted_ltv"), F.col("order_count").cast("long").alias("order_count")
        )

    def run(self, events: DataFrame, test_size: float = 0.2) -> dict[str, DataFrame]:
        f = feats.ltv_features(events, self.vocab, self.drop_leaky).where(F.col("order_count") > 0)
        metrics = self.train(f, "user_id", test_size)
        return {"metrics": metrics, "feature_importance": self.feature_importance(15), "predictions": self.predict(f)}


# Lifetime-value tiers by percentile rank.
LTV_TIERS = (("Diamond", 0.9), ("Gold", 0.7), ("Silver", 0.4))


def segment_by_ltv(predictions: DataFrame) -> DataFrame:
    """Tiers by percentile rank.

    Ranks are joined back on the predicted value, so the predictions are checkpointed first: a second
    evaluation of the model features could differ in the last digit.
    """
    checkpoint_dir(predictions.sparkSession)
    ranked = percentile_ranks(predictions.checkpoint(), {"predicted_ltv": "ltv_percentile"})
    tier = None
    for name, bound in LTV_TIERS:
        cond = F.col("ltv_percentile") >= bound
        tier = F.when(cond, name) if tier is None else tier.when(cond, name)
    return ranked.withColumn("ltv_tier", tier.otherwise("Bronze"))


def ltv_tier_summary(segmented: DataFrame) -> DataFrame:
    def r(c):
        return round_half_even(c, 2)

    return segmented.groupBy("ltv_tier").agg(
        F.count(F.lit(1)).alias("users"),
        r(F.avg("predicted_ltv")).alias("avg_predicted_ltv"),
        r(F.sum("predicted_ltv")).alias("total_predicted_ltv"),
        r(F.avg("total_revenue")).alias("avg_revenue"),
        r(F.sum("total_revenue")).alias("total_revenue"),
        r(F.avg("order_count")).alias("avg_orders"),
    )
