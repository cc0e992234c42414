"""A fitted model scores a streaming DataFrame (memory sink, in-process)."""

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import SF_SMALL
from seedgrow import SelfTraining
from seedgrow.sources import embedding_samples
from seedgrow.streaming import score_stream


def test_score_stream(spark):
    df = embedding_samples(spark, SF_SMALL).withColumn("label", F.when(F.col("row_id") % 10 == 0, F.col("label")))
    model = SelfTraining(NaiveBayes(modelType="gaussian"), maxIter=1).fit(df)
    raw = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    stream = (
        spark.readStream.schema(raw.schema).option("pathGlobFilter", "embeddings.parquet").parquet(SF_SMALL)
        .select(F.col("vec_id").alias("row_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    )
    q = (
        score_stream(model, stream).select("row_id", "prediction", "confidence")
        .writeStream.format("memory").queryName("scored_embeddings").outputMode("append").start()
    )
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT * FROM scored_embeddings")
    batch = model.transform(df).select("row_id", "prediction")
    assert got.count() == raw.count()
    assert got.select("row_id", "prediction").subtract(batch).count() == 0
