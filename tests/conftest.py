import pytest

from tesserae.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 2, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__codegen__wholeStage="false")
    yield session
    session.stop()


@pytest.fixture(scope="module")
def as_in_production(spark):
    """Small fixtures run without whole-stage code, which takes long to compile; registered queries run with it."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield spark
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.fixture
def rows():
    """A frame's rows as a sorted list of tuples."""
    return lambda df, *columns: sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
