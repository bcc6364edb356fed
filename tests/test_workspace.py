import os
import time

from stintworks import workspace
from stintworks.operators.merge import merge_by_key


def folders(spark):
    top = f"{workspace.shared_dir(spark)}/stintworks/{spark.sparkContext.applicationId}".removeprefix("file:")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_a_closed_scope_leaves_nothing_behind(spark):
    before = folders(spark)
    with workspace.scope(spark):
        rows = workspace.materialize(spark.range(10).toDF("id"), "ten")
        with workspace.scope(spark):
            workspace.materialize(rows.filter("id > 5"), "few")
            assert len(folders(spark) - before) == 2
        assert len(folders(spark) - before) == 1
        assert rows.count() == 10  # lazy results stay readable until then
    assert folders(spark) == before


def test_tables_of_an_operator_go_with_the_scope(spark):
    from stintworks.operators.resolve import substring_matches

    before = folders(spark)
    texts, names = spark.createDataFrame([("an",)], "text string"), spark.createDataFrame([("ana",), ("bob",)], "name string")
    with workspace.scope(spark):
        assert [tuple(r) for r in substring_matches(texts, names).collect()] == [("an", "ana")]
        assert folders(spark) > before
    assert folders(spark) == before


def test_an_error_closes_the_scope(spark):
    before = folders(spark)
    try:
        with workspace.scope(spark):
            workspace.materialize(spark.range(3).toDF("id"), "gone")
            merge_by_key(spark.range(1), spark.range(1), ["id"], [], mode="no such mode")
    except ValueError:
        pass
    assert folders(spark) == before


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_") and f.endswith(".data")}

    rows = spark.range(20_000).repartition(3, "id")
    before = shuffled()
    moved = workspace.materialize(rows, "moved")
    left = shuffled() - before
    for _ in range(50):  # files go beside the driver's work
        if not left:
            break
        time.sleep(0.1)
        left &= shuffled()
    assert not left
    assert moved.count() == rows.count() == 20_000  # the frame itself can still be run
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
