"""Rows are generated by many tasks, however few splits the keys have."""

from pyspark.sql import functions as F

from furrow.plans.generate_pack import generated


def test_rows_are_generated_by_many_tasks_from_one_file(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = generated(spark, str(tmp_path), "products").where("length(name) > 2")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.where("row_id < 100").count() == 100
