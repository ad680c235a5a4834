import os
import tempfile

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskmap.streaming.scoring import score_stream, write_scores


def test_stream_scoring_matches_batch(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select(
        "event_id", "value", (F.col("event_type") == "purchase").cast("double").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["value"], outputCol="features"),
                             LogisticRegression(maxIter=20)]).fit(ev)
    base = tempfile.mkdtemp(prefix="riskmap-stream-", dir="/tmp")
    raw = spark.read.parquet(f"{sf_small}/events.parquet")
    raw.write.parquet(os.path.join(base, "in"))          # a file source reads a directory
    stream = spark.readStream.schema(raw.schema).parquet(os.path.join(base, "in"))
    scored = score_stream(model, stream.select("event_id", "value"), ["event_id"])
    q = write_scores(scored, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(base, "out")).select("event_id", "p")
    ref = score_stream(model, ev.select("event_id", "value"), ["event_id"])
    assert got.count() == ev.count()
    assert got.join(ref.withColumnRenamed("p", "p2"), "event_id").where(
        F.abs(F.col("p") - F.col("p2")) > 1e-12).count() == 0
