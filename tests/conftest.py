import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    more = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(warehouse)}
    session = local_session(4, 4, **more)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
