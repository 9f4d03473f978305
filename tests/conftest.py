import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loanloom.schemas import LOANS  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"
AS_OF = dt.date(2015, 9, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("loanloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.ui.retainedStages", "100000")
        .config("spark.ui.retainedJobs", "100000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_loans(spark):
    """Typed loans from dictionaries; what is not given is NULL, ids are numbered."""

    def build(*rows):
        names = [f.name for f in LOANS.fields]
        money = {f.name for f in LOANS.fields if f.dataType.simpleString() == "decimal(15,2)"}
        data = []
        for i, row in enumerate(rows):
            full = dict.fromkeys(names) | {"loan_id": f"L{i}"} | row
            data.append(
                tuple(
                    Decimal(str(full[n])) if n in money and full[n] is not None else full[n]
                    for n in names
                )
            )
        return spark.createDataFrame(data, LOANS)

    return build
