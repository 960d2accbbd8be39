from loomwright import staging


def test_stage_and_clear(spark):
    held = staging.stage(spark.range(5), "five")
    assert held.count() == 5 and "/loomwright/" in held.inputFiles()[0]
    paths = {staging.fresh_dir(spark, "x") for _ in range(3)}
    assert len(paths) == 3
    staging.clear(spark)
    assert staging.stage(spark.range(2), "two").count() == 2
