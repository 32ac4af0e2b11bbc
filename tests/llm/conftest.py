from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs_dir():
    if not SF.exists():
        pytest.skip("no test tables")
    return str(SF)


@pytest.fixture(scope="session")
def doc_rows(spark, docs_dir):
    return [tuple(r) for r in spark.read.parquet(f"{docs_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
