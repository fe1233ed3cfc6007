"""The physical plans: what is read, what is shuffled, and what becomes of a hot key."""

import re
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from samples.queries import QUERIES
from samples.views import Samples
from tertulia import SCHEMAS, load_tables
from tertulia.operators import lookups, registrations, reports, rosters, updates
from tertulia.plans import staging
from tertulia.plans.joins import COPIES_PER_ARRAY, drop_keys, repeat_rows
from tertulia.plans.session import cluster_settings
from tertulia.sources import append_rows, write_snapshot

SF = "/root/testdata/sf0.001"
HOT_ROWS = 30_000


def plan_of(df, final=False) -> str:
    if final:
        df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@contextmanager
def settings(spark, **values):
    old = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    for key, value in values.items():
        spark.conf.set(key.replace("__", "."), value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}
SMALL_PARTITIONS = {
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "4KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "8KB",
    "spark__sql__shuffle__partitions": "16",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    samples = Samples(spark, SF)
    for name in SCHEMAS:
        write_snapshot(samples.view(name), f"{path}/{name}")
    return path


@pytest.fixture(scope="module")
def stored(spark, folder):
    return load_tables(spark, folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_nested_loops_when_nothing_is_small(spark, stored, name):
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(QUERIES[name](Samples(spark, SF, stored)))
    assert not re.search(r"NestedLoop|Cartesian|Python|Pandas", plan)
    # The one broadcast asked for is the table of at most 4096 id buckets.
    assert plan.count("BroadcastHashJoin") <= (1 if name.startswith("add_") else 0)
    # Task-local aggregation state of unbounded size appears in the pasted sample texts only.
    texts = "correos_" if "string_agg" in plan or "listagg" in plan else None
    assert texts or "collect_" not in plan


def test_filter_and_columns_reach_the_scan(stored):
    plan = rosters.session_invitees(stored, 1)._jdf.queryExecution().explainString(
        rosters.session_invitees(stored, 1)._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "EqualTo(id_sesion,1)" in plan
    plan = plan_of(reports.popular_courses(stored))
    assert "ReadSchema: struct<id_curso:bigint,id_usuario:bigint>" in plan
    assert "TakeOrderedAndProject" in plan


def test_facts_of_one_member_are_not_shuffled(spark, stored):
    with settings(spark, **NO_BROADCAST):
        df = rosters.member_sessions(stored, "customer.000000001@example.com")
        plan = df._jdf.queryExecution().executedPlan().toString()
    fact = re.search(r"Filter .*id_usuario#\d+L = Subquery subquery", plan)
    # The one shuffle, by session, is above that filter.
    assert fact and plan[: fact.start()].count("Exchange hashpartitioning(id_sesion") == 1
    assert plan.count("Exchange hashpartitioning(id_usuario") == 0


def test_a_small_batch_does_not_shuffle_the_table(spark, stored):
    batch = spark.createDataFrame([(1, "customer.000000001@example.com")], "id_sesion bigint, texto string")
    plan = plan_of(registrations.register_session_attendance(stored, batch).added["asistencia_sesion"])
    below_scan = plan[: plan.index("/asistencia_sesion")].splitlines()
    semi = max(i for i, line in enumerate(below_scan) if "BroadcastHashJoin" in line and "LeftSemi" in line)
    assert not any("Exchange hashpartitioning" in line for line in below_scan[semi:])


def test_counts_over_several_tables_take_one_shuffle(spark, stored):
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(reports.member_dependents(stored, strict=True))
    assert plan.count("Exchange") == 1


@pytest.fixture(scope="module")
def skewed(spark, folder, tmp_path_factory):
    """One member has a third of the invitations, one class a third of the attendance."""
    path = str(tmp_path_factory.mktemp("skewed"))
    third = F.col("id") % 3 == 0
    one_or = lambda n: F.when(third, F.lit(1).cast("long")).otherwise(F.col("id") % n)
    facts = spark.range(0, HOT_ROWS, 1, 8)
    append_rows(facts.select((F.col("id") % 997).alias("id_sesion"), one_or(5000).alias("id_usuario")), f"{path}/i")
    append_rows(facts.select(one_or(1400).alias("id_clase"), (F.col("id") % 5003).alias("id_usuario")), f"{path}/a")
    members = spark.range(5003).select(
        F.col("id").alias("id_usuario"), F.lit("n").alias("nombre"), F.lit("a").alias("apellido"),
        F.concat(F.lit("m"), "id").alias("correo"), F.lit(True).alias("status"),
    )
    append_rows(members, f"{path}/m")
    paths = {"invitacion_sesion": f"{path}/i", "asistencia_clase": f"{path}/a", "comunidad": f"{path}/m"}
    return load_tables(spark, folder, paths=paths)


@pytest.mark.parametrize("report", [rosters.session_invitees, reports.class_attendance])
def test_a_hot_key_is_split(spark, skewed, report):
    with settings(spark, **NO_BROADCAST, **SMALL_PARTITIONS):
        df = report(skewed)
        plan = plan_of(df, final=True)
        split = df.count()
    assert "skew=true" in plan
    assert split == report(skewed).count()


def test_a_hot_key_is_split_when_dropped(spark):
    third = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    rows = spark.range(0, HOT_ROWS, 1, 8).select(third.alias("k"), F.col("id").alias("v"))
    gone = spark.range(1, 5000).select(F.col("id").alias("k"))
    left = HOT_ROWS - 4999 + 4999 // 3
    assert drop_keys(rows, gone, ["k"]).count() == left
    with settings(spark, **NO_BROADCAST, **SMALL_PARTITIONS):
        df = drop_keys(rows, gone, ["k"])
        assert "skew=true" in plan_of(df, final=True)
        assert df.count() == left


def test_top_per_area_is_cut_before_the_shuffle(spark, stored):
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(reports.top_participants_by_area(stored))
    assert re.search(r"WindowGroupLimit.*Final.*Exchange hashpartitioning\(area.*WindowGroupLimit.*Partial", plan, re.S)


def test_copies_come_back_in_bounded_arrays(spark):
    many = COPIES_PER_ARRAY * 2 + 3
    counted = spark.createDataFrame([("a", 1), ("b", many)], "k string, copias bigint")
    back = repeat_rows(counted)
    assert {r.k: (r.n, r.top) for r in back.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.max("_copy").alias("top")
    ).collect()} == {"a": (1, 0), "b": (many, many - 1)}
    assert back.select("_copy").distinct().count() == many


def test_copies_of_one_row_are_made_by_several_tasks(spark):
    counted = spark.createDataFrame([("b", COPIES_PER_ARRAY * 20)], "k string, copias bigint")
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        tasks = repeat_rows(counted).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2
    assert sum(r["count"] for r in tasks) == COPIES_PER_ARRAY * 20


def test_facts_are_cut_to_the_area_before_they_are_shuffled(spark, stored):
    plan = plan_of(reports.top_participants(stored, area="IT"))
    for fact in ("asistencia_sesion", "registrados_curso"):
        above = plan[: plan.index(f"/{fact}")].splitlines()
        semi = max(i for i, line in enumerate(above) if "LeftSemi" in line)
        distinct = max(i for i, line in enumerate(above) if "Exchange hashpartitioning(id_usuario" in line and "_id" in line)
        assert distinct < semi


def test_a_small_change_is_broadcast_to_the_table(spark, stored):
    batch = spark.createDataFrame([(1, 1, True, True)], "id_curso bigint, id_usuario bigint, status boolean, curso_aprobado boolean")
    plan = plan_of(updates.set_registrant_status(stored, batch).changed["registrados_curso"])
    assert "BroadcastHashJoin" in plan
    table = plan[: plan.index("/registrados_curso")].splitlines()
    join = max(i for i, line in enumerate(table) if "BroadcastHashJoin" in line)
    assert not any("Exchange hashpartitioning" in line for line in table[join:])


def test_changes_are_settled_before_they_meet_the_table(spark, stored):
    """No aggregate of the changes is held in memory beside the rows of the table."""
    batch = spark.createDataFrame([(1, 1, True, True)], "id_curso bigint, id_usuario bigint, status boolean, curso_aprobado boolean")
    change = updates.set_registrant_status(stored, batch)
    for df in (change.tables, change.changed, change.replaced):
        assert "Aggregate" not in plan_of(df["registrados_curso"])


def test_links_that_replace_others_are_made_once(spark, stored, tmp_path):
    spark.createDataFrame([(1, "S"), (1, "S"), (2, None)], "id_curso long, nombre_sesion string").write.parquet(f"{tmp_path}/entrada")
    change = updates.replace_course_sessions(stored, spark.read.parquet(f"{tmp_path}/entrada"))
    for df in (change.tables, change.added, change.removed):
        assert "/entrada" not in plan_of(df["tiene_sesion"])


def test_each_fact_is_shuffled_by_member_once(spark, stored):
    with settings(spark, **NO_BROADCAST):
        df = reports.engagement_summary(stored)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    # The distinct sessions and runs are counted from the shuffle by member that the counts made.
    reused = re.findall(r"ReusedExchange \[([^]]*)\], Exchange hashpartitioning\(id_usuario", plan)
    for key in ("id_sesion", "id_curso"):
        assert any(key in columns for columns in reused)
        distinct = plan[plan.index(f"Exchange hashpartitioning({key}") :]
        assert distinct.index("ReusedExchange") < distinct.index("Initial Plan")


def test_building_a_report_runs_no_job(spark, stored):
    spark.sparkContext.setJobGroup("building", "")
    try:
        for report in (reports.top_participants, reports.top_participants_by_area, reports.engagement_summary):
            report(stored)
        reports.top_participants(stored, area="IT")
        reports.class_attendance(stored, 1)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_labels_are_read_once_while_shared(spark, stored):
    with staging.shared(lookups.course_labels(stored)) as labels:
        first = labels.where("nombre_curso = 'Brand#1'")
        assert "InMemoryTableScan" in plan_of(first)
        assert first.count() + labels.where("nombre_curso <> 'Brand#1'").count() == stored.curso.count()
    assert not labels.is_cached
    assert "InMemoryTableScan" not in plan_of(lookups.course_labels(stored))


def test_staged_folders_are_released(spark):
    folder = Path(staging._folder(spark).removeprefix("file://"))
    held = lambda: {p.name for p in folder.rglob("tertulia-*")}
    before = held()
    with staging.staging(spark):
        assert staging.stage(spark.range(3)).count() == 3
        assert len(held() - before) == 1
        kept = staging.stage_result(spark, lambda: staging.stage(spark.range(5)).where("id > 1"))
        assert len(held() - before) == 2
        assert kept.count() == 3
    assert held() == before


def test_snapshots_are_never_overwritten(spark, stored, tmp_path):
    path = str(tmp_path / "s")
    write_snapshot(stored.sesion, path, cluster_by=["id_sesion"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_snapshot(stored.sesion, path)
    append_rows(stored.sesion, path)
    again = load_tables(spark, "unused", paths={"sesion": path})
    assert again.sesion.count() == 2 * stored.sesion.count()


def test_warehouse_tables_are_cast_to_the_declared_types(spark, tmp_path):
    columns = ["CAST(7 AS DECIMAL(38, 0)) AS ID_CURSO", "CAST(8 AS DECIMAL(38, 0)) AS ID_SESION", "1 AS MORE"]
    table = spark.range(1).selectExpr(*columns)
    table.write.option("path", str(tmp_path / "t")).saveAsTable("default.tiene_sesion")
    try:
        found = load_tables(spark, "default", fmt="table").tiene_sesion
        assert found.schema == SCHEMAS["tiene_sesion"]
        assert found.first() == (7, 8)
    finally:
        spark.sql("DROP TABLE default.tiene_sesion")


def test_text_that_is_no_date_has_no_date(spark, tmp_path):
    rows = [(1, 1, "soon", "2024-02-28", "P", True, "c"), (2, 1, "2024-02-01", "2024-02-28", "P", True, "c")]
    table = spark.createDataFrame(rows, "id_curso int, id_catalogo int, fecha_inicio string, fecha_fin string, proveedor string, requiere_caso_uso boolean, correo_contacto string")
    table.write.option("path", str(tmp_path / "c")).saveAsTable("default.curso")
    spark.createDataFrame([(1, "SQL")], SCHEMAS["catalogo_cursos"]).write.option("path", str(tmp_path / "k")).saveAsTable("default.catalogo_cursos")
    try:
        labels = lookups.course_labels(load_tables(spark, "default", fmt="table")).collect()
        assert {r.id_curso: r.etiqueta for r in labels} == {1: "SQL (Fecha no disponible)", 2: "SQL (01/02/2024 - 28/02/2024)"}
    finally:
        spark.sql("DROP TABLE default.curso")
        spark.sql("DROP TABLE default.catalogo_cursos")


def test_large_tables_need_partition_options_over_jdbc(spark):
    with pytest.raises(ValueError, match="numPartitions"):
        load_tables(spark, "jdbc:x", fmt="jdbc").asistencia_clase  # noqa: B018


def test_staging_needs_a_shared_folder():
    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

    class Session:
        conf = {"spark.master": "local[8]"}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging._folder(Session)
    Context.folder = "file:/ck"
    assert staging._folder(Session) == "file:/ck"
    Session.conf = {"spark.checkpoint.dir": "hdfs:///ck"}
    assert staging._folder(Session) == "hdfs:///ck"


def test_cluster_settings_grow_with_the_input():
    assert cluster_settings(1, "s3a://x/ck")["spark.sql.shuffle.partitions"] == "200"
    large = cluster_settings(100 * 1024, "s3a://x/ck")
    assert large["spark.sql.shuffle.partitions"] == "409600"
    assert large["spark.checkpoint.dir"] == "s3a://x/ck"
