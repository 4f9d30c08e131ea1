import threading

from docquarry.llm import common


def test_scopes_of_other_threads_keep_their_tables(spark):
    """Tables written by a thread aren't deleted by another's scope that ends meanwhile; those of an inner scope that are kept go to the outer one."""
    there, done, seen = threading.Event(), threading.Event(), []

    def other():
        with common.scratch():
            there.wait(60)
            x = common.written(spark.range(7).toDF("x"), "other")
            done.wait(60)
            seen.append(x.count())

    t = threading.Thread(target=other)
    t.start()
    with common.scratch() as keep:
        mine = keep(common.written(spark.range(3).toDF("x"), "mine"))
        gone = common.written(spark.range(4).toDF("x"), "gone")
        there.set()
        with common.scratch() as inner:
            kept = inner(common.written(spark.range(5).toDF("x"), "kept"))
    done.set()
    t.join()
    assert seen == [7] and mine.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    exists = lambda x: path(x._folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(x._folder))
    assert exists(mine) and not exists(gone) and not exists(kept)
