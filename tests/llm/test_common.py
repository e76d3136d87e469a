from pyspark.sql import functions as F

from loomtext.llm import common


def test_written_tables_leave_no_shuffle_files(spark):
    kept = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before, setting = kept(), spark.conf.get(common.RELEASE, None)
    df = spark.range(1000).repartition(3).groupBy((F.col("id") % 10).alias("k")).count()
    out = common.written(df, "released")
    assert kept() <= before and spark.conf.get(common.RELEASE, None) == setting
    assert out.agg(F.sum("count")).first()[0] == 1000
