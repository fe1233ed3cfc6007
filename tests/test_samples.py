"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as driver
from samples.oracle import ORACLE
from samples.queries import QUERIES
from samples.views import Samples
from tests.check import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = differences(spark, duck, SF, name)
    # At this scale every session of the samples may be named by a batch with an unknown address.
    assert not [f for f in found if f != "no rows"]


def test_entry(spark):
    assert driver.entry(spark).count() == 10


def test_documented_summary(spark):
    """The figures of FIXTURES.md, found by joining the raw facts."""
    summary = driver.queries()["engagement_summary"](spark, SF).first()
    assert (summary.total_usuarios, summary.usuarios_participantes) == (175, 142)
    assert (summary.sesiones_asistidas, summary.cursos_inscritos) == (9, 200)
    assert (summary.cursos_completados, summary.cursos_completados_unicos) == (8081, 1216)


def test_documented_counts(spark):
    samples = Samples(spark, SF)
    counts = {"comunidad": 175, "clase": 1473, "registrados_curso": 2432, "asistencia_clase": 6874}
    assert {name: samples.view(name).count() for name in counts} == counts
