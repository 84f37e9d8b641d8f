from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from roster.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]").appName("roster-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    from roster.sources.seed import tables_from_rows
    from tests.seed_rows import SEED
    return tables_from_rows(spark, SEED)


@pytest.fixture(scope="session")
def star001(spark):
    from roster.sources.adapter import star_schema_tables
    return star_schema_tables(spark, SF0001)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="roster-test-")
