import os

from tallyloom.llm import common


def test_tables_live_in_the_shared_folder_until_cleaned(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    df = common.materialize(spark.range(5).withColumnRenamed("id", "n"), "five")
    assert df.count() == 5 and df.inputFiles()[0].split("file:")[-1].lstrip("/").startswith(base.lstrip("/"))
    folder = common.own_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    common.clean(spark)
    assert not os.path.exists(folder)


def test_sink_flushes():
    sink = common.Sink(common.arrow_schema("a long, b string"), 3)
    assert [sink.add((i, "x")) for i in range(3)] == [False, False, True]
    assert [b.num_rows for b in sink.flush()] == [3] and list(sink.flush()) == []
