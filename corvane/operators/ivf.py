"""Vector lane through inverted lists: k-means centres, and only the lists whose centres are nearest to a question."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators.lanes import pairwise, top_k


def ivf_lane(questions: DataFrame, rows: DataFrame, lists: int, probes: int, k: int, seed: int = 1) -> DataFrame:
    """questions (qid, qv), rows (id, v) -> qid, id, score, rnk. The join is on the list, so only probed lists meet."""
    spark = rows.sparkSession
    model = KMeans(k=lists, seed=seed, maxIter=10, featuresCol="f", predictionCol="list").fit(rows.select(array_to_vector("v").alias("f")))
    listed = model.transform(rows.withColumn("f", array_to_vector("v"))).select("id", "v", "list")
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, c array<double>")
    near = pairwise(questions, centres).withColumn("s", V.cosine(F.col("qv"), F.col("c")))
    order = Window.partitionBy("qid").orderBy(F.desc("s"), "list")
    probed = near.withColumn("p", F.row_number().over(order)).where(F.col("p") <= probes).select("qid", "qv", "list")
    return top_k(listed.join(probed, "list").select("qid", "id", F.round(V.cosine(F.col("qv"), F.col("v")), 6).alias("score")), k)
