import os

from trawlspark.storage import cut, remove, scratch


def folders(spark):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {name for name in os.listdir(root) if name.startswith("rdd-")}


def test_scratch_removes_what_is_cut_inside(spark, tmp_path):
    outer = cut(spark.range(5))
    before = folders(spark)
    with scratch(spark):
        first = cut(spark.range(10).repartition(3))
        with scratch(spark):
            assert cut(first.where("id > 3")).count() == 6
            assert len(folders(spark) - before) == 2
        assert len(folders(spark) - before) == 1
        first.write.parquet(str(tmp_path / "out"))
    assert folders(spark) == before and outer.count() == 5
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    remove(spark, str(tmp_path / "out"))
    remove(spark, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_scratch_of_another_thread(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as other:
        with scratch(spark):
            before = folders(spark)
            held = other.submit(lambda: cut(spark.range(7))).result()
            assert len(folders(spark) - before) == 1
        assert held.count() == 7
