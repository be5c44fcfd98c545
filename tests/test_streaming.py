import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from tessera.streaming import row_features, start_cleaning_stream


def test_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="tessera-stream-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.repartition(3, "doc_id").write.mode("overwrite").parquet(f"{root}/in")
    q = start_cleaning_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", max_files_per_trigger=1)
    q.awaitTermination()
    streamed = spark.read.parquet(f"{root}/out")
    batch = row_features(docs)
    assert streamed.count() == docs.count()
    assert streamed.select(*batch.columns).exceptAll(batch).count() == 0
    # a second availableNow run finds nothing new (checkpointed progress)
    q2 = start_cleaning_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt")
    q2.awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == docs.count()
