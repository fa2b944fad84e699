import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from landsight.session import checkpoint_dir, get_session

    s = get_session(
        "local[4]",
        shuffle_partitions=4,
        extra_conf={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
                    "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in (
        "region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations"
    ).split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
