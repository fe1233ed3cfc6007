import os

from tertulia.plans.staging import discard, new_folder, release, settle, stage, staging


def folders(spark):
    """What is staged now, next to where a new table would go."""
    top = os.path.dirname(new_folder(spark).removeprefix("file://"))
    return {f for f in os.listdir(top) if f.startswith("tertulia-")} if os.path.isdir(top) else set()


def test_discard_deletes_its_table_alone(spark):
    with staging(spark):
        first, second = stage(spark.range(10)), settle(spark.range(20).repartition(3, "id"))
        before = folders(spark)
        discard(first)
        after = folders(spark)
        assert len(before - after) == 1
        assert second.count() == 20
        discard(second)
        assert len(before - folders(spark)) == 2


def test_release_passes_over_what_was_discarded(spark):
    with staging(spark):
        table = settle(spark.range(0))
        assert (table.count(), table.columns) == (0, ["id"])
        discard(table)
    release(spark, 10**6)
