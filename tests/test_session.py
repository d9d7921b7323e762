"""Where intermediate results go."""

import pytest
from compframe import session
from compframe.catalog import extraction, words
from pyspark.sql import functions as F


class Stub:
    def __init__(self, master, folder=None):
        self.sparkContext, self.conf, self.master, self.folder = self, self, master, folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        self.folder = path


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_folder(Stub(master))
        assert session.shared_folder(Stub(master, "hdfs://x/y")) == "hdfs://x/y"
    for master in ("local", "local[4]", "local[*]", "local[2, 3]"):
        assert session.shared_folder(Stub(master))


def test_staged_results_lie_in_one_folder_and_can_be_removed(spark):
    df = session.staged(spark.range(5), "numbers")
    assert df.staged_at.startswith(session.job_folder(spark)) and df.count() == 5
    session.unstage(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.staged_at)


def test_rows_of_one_file_are_spread_over_all_cores(spark, small, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS v").coalesce(1).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    out = session.spread(df)
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert df.rdd.getNumPartitions() == 1 and len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) < 3 * 1000 / len(sizes)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    pages = extraction.extract_auctions(spark, small)  # pages are dealt out before their fields are looked for
    assert pages.rdd.getNumPartitions() == len(sizes)


def test_the_district_fill_is_spread_over_all_cores(spark, small):
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert words.filled(spark, small).rdd.getNumPartitions() >= tasks
