import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from meterline.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="meterline-tests", shuffle_partitions=4,
                  conf={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmp_logs():
    return tempfile.mkdtemp(prefix="meterline-test-")


SF_SMALL = "/root/testdata/sf0.001"
