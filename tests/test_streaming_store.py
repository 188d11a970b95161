import os
import tempfile

from pyspark.sql import functions as F

from flagstone.operators import flagging
from flagstone.plans import catalog as C
from flagstone.sources import review_store
from flagstone.sources.fixtures import fixture
from flagstone.sources.seeds import seed_reviews
from flagstone.streaming import start_flagging
from tests.conftest import SF001


def test_stream_flags_equal_batch_flags(spark):
    base = fixture(spark, SF001, "assisted_orders").drop("order_month")
    src = tempfile.mkdtemp(prefix="flagstone-stream-src-")
    base.write.mode("overwrite").parquet(src + "/in")
    reviews = seed_reviews(spark, SF001, params=C.PARAMS)
    stream = spark.readStream.schema(base.schema).parquet(src + "/in")
    q = start_flagging(stream, reviews, src + "/out", src + "/ckpt", C.PARAMS)
    assert q.awaitTermination(240)
    got = spark.read.parquet(src + "/out").select("rule_id", "case_key")
    want = flagging.unreviewed(flagging.flag_all(base, params=C.PARAMS), reviews).select("rule_id", "case_key")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_review_store_versions_and_partition_filter(spark):
    root = tempfile.mkdtemp(prefix="flagstone-reviews-")
    seeds = seed_reviews(spark, SF001, ["3", "7"], params=C.PARAMS)
    review_store.write_reviews_version(seeds, root, version="a")
    only3 = review_store.read_reviews(spark, root, "3")
    assert only3.count() == seeds.where("rule_id = '3'").count()
    assert "PartitionFilters: [isnotnull(rule_id" in only3._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert os.path.isdir(f"{root}/v=a/rule_id=3")


def test_stream_reads_the_newest_review_version_per_batch(spark):
    base = fixture(spark, SF001, "assisted_orders").drop("order_month")
    work = tempfile.mkdtemp(prefix="flagstone-stream-rev-")
    base.write.mode("overwrite").parquet(work + "/in")
    seeds = seed_reviews(spark, SF001, params=C.PARAMS)
    review_store.write_reviews_version(seeds.limit(0), work + "/reviews", version="a")
    review_store.write_reviews_version(seeds, work + "/reviews", version="b")  # newest, resolved per batch
    stream = spark.readStream.schema(base.schema).parquet(work + "/in")
    q = start_flagging(stream, lambda: review_store.read_reviews(spark, work + "/reviews"), work + "/out",
                       work + "/ckpt", C.PARAMS)
    assert q.awaitTermination(240)
    got = spark.read.parquet(work + "/out").select("rule_id", "case_key")
    want = flagging.unreviewed(flagging.flag_all(base, params=C.PARAMS), seeds).select("rule_id", "case_key")
    assert got.count() == want.count()
