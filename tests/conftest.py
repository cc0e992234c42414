import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from seedgrow.session import ensure_checkpoint_dir

    s = (
        SparkSession.builder.master("local[*]")
        .appName("seedgrow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    # Set a checkpoint folder only where the session has none (tests only).
    ensure_checkpoint_dir(s, str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()


def vec_df(spark, rows, ddl):
    """``createDataFrame`` with a DDL-like schema where ``vector`` means
    ``VectorUDT`` (not a SQL type name)."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    fields = []
    for part in ddl.split(","):
        name, typ = part.split()
        dt = VectorUDT() if typ == "vector" else _parse_datatype_string(typ)
        fields.append(StructField(name, dt, True))
    return spark.createDataFrame(rows, StructType(fields))
