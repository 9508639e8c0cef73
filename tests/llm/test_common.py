import threading

from pagetide.llm.common import removed, scratch, shared_dir, written


def test_scratch_removes_its_own_tables_only(spark):
    """Two queries at once: what one writes while the other's scratch() is open stays."""
    opened, wrote, tables = threading.Event(), threading.Event(), {}

    def other():
        opened.wait(60)
        tables["other"] = written(spark.range(5))
        wrote.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        opened.set()
        wrote.wait(60)
        with scratch(spark):
            tables["inner"] = written(spark.range(3))
            path = tables["inner"].inputFiles()[0]
        tables["own"] = written(spark.range(4))
        assert tables["own"].count() == 4
    thread.join()
    assert tables["other"].count() == 5
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert not fs(path) and not any(map(fs, tables["own"].inputFiles()))
    kept = written(spark.range(2))
    assert kept.count() == 2


def test_removed(spark):
    path = shared_dir(spark)
    spark.range(1).write.parquet(path)
    removed(spark, [path, path])
    assert not spark._jvm.java.io.File(path.removeprefix("file://")).exists()
