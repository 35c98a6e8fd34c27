from tideline import runtime


def test_written_tables_and_their_removal(spark, tmp_path):
    runtime.clean(spark)
    df = runtime.written(spark.range(10))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert runtime.clean(spark) == 1 and runtime.clean(spark) == 0


def test_groups_follow_the_rows(spark):
    assert runtime.groups_for(spark, 0, 10) == runtime.slots(spark)
    assert runtime.groups_for(spark, 10_000, 10) == 1000
