import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strataudit import schemas as S  # noqa: E402
from strataudit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, "6g")


class Maker:
    """Small tables with the declared schemas; columns that are not given are null."""

    def __init__(self, spark):
        self.spark = spark

    def _table(self, schema, rows):
        names = schema.fieldNames()
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    def apps(self, *rows):
        return self._table(S.APPLICATIONS, [{"snapshot_date": "1", "snapshot_hour": "0", **r} for r in rows])

    def stores(self, *rows):
        return self._table(S.DATA_STORES, [dict(zip(("application_name", "store_id", "store_name", "technology",
                                                     "has_sensitive_data"), r)) for r in rows])

    def objects(self, *rows):
        return self._table(S.DATA_OBJECTS, [dict(zip(("application_name", "data_store_id", "object_id", "object_name",
                                                      "has_sensitive_data", "retention_days", "technology"), r)) for r in rows])

    def fields(self, *rows):
        return self._table(S.OBJECT_FIELDS, [dict(zip(("application_name", "object_id", "field_name",
                                                       "field_description", "field_type"), r)) for r in rows])


@pytest.fixture(scope="session")
def make(spark):
    return Maker(spark)
