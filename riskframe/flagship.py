"""The minimum slice end to end: "which loans go bad, and how well do we rank them?"

loans_raw -> P1, P2, P5, P6, P8, P9, P10 (loans_model) -> R1 split ->
R3 upsample the training split -> M1 + M2 + M5 pipeline -> E1/E2/E4 per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import evaluate as ev
from riskframe.operators import models, resample
from riskframe.session import cut_lineage
from riskframe.sources import fixtures as fx


def features_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("loan_id", "label", "split", "draw")]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the modelling table is read by the split, the upsampling, the fit and the
    # scoring: persist it once (the reference caches its train/test frames too)
    m = fx.loans_model(spark, sf_dir)
    feats = features_of(m)
    split = resample.train_test_split(m, "loan_id").persist()
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    up = resample.upsample(train, "loan_id").drop("draw").persist()
    model = models.fit(up, feats, models.logistic(max_iter=100), scaler="minmax")
    scored = (models.score(model, train, feats).withColumn("split", F.lit("train"))
              .unionByName(models.score(model, test, feats).withColumn("split", F.lit("test")))).persist()
    out = cut_lineage(ev.evaluation_matrix(scored, ["split"]))  # a row per split
    for held in (scored, up, split):
        held.unpersist()
    return out
