"""K10 over Spark's bundled embedded in-memory Derby (in-process, no port)."""

from furrow.sources.generate import generate
from furrow.sources.jdbc import read_jdbc, write_jdbc
from furrow.sources.schemas import get_schema

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_round_trip(spark):
    url = "jdbc:derby:memory:furrowtest;create=true"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    write_jdbc(df, url, "T1", mode="overwrite", driver=DRIVER)
    assert sorted(tuple(r) for r in read_jdbc(spark, url, "T1", driver=DRIVER).collect()) == [(1, "a"), (2, "b")]


def test_generated_table_with_declared_varchar_sizes(spark):
    url = "jdbc:derby:memory:furrowseed;create=true"
    contacts = generate(spark, "contacts", 50, start="2024-01-01", end="2024-03-01")
    s = get_schema("contacts")
    assert "first_name VARCHAR(100)" in s.jdbc_column_types()
    write_jdbc(contacts.drop("row_id"), url, "CONTACTS", mode="overwrite", column_types=s.jdbc_column_types(), driver=DRIVER)
    assert read_jdbc(spark, url, "CONTACTS", driver=DRIVER).count() == 50
