import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from changeflow.schemas import CHANGE_EVENT, TXN_HEADER  # noqa: E402
from changeflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    yield session
    session.stop()


EVENT_FIELDS = [part.strip().split()[0] for part in CHANGE_EVENT.replace("map<string,string>", "m").replace(
    "array<struct<name:string,old_value:string,new_value:string>>", "a").split(",")]


@pytest.fixture(scope="session")
def events(spark):
    """Change events from keyword rows; unnamed fields are NULL."""

    def build(*rows):
        filled = []
        for number, row in enumerate(rows):
            base = {"source_name": "shop", "slot_name": "s", "seq": number, "operation": "insert", "namespace": "public",
                    "entity": "orders", "metadata": {}, "transaction_id": "1", "sequence_number": number}
            base.update(row)
            filled.append(tuple(base.get(field) for field in EVENT_FIELDS))
        return spark.createDataFrame(filled, CHANGE_EVENT)

    return build


@pytest.fixture(scope="session")
def headers(spark):
    fields = ["source_name", "slot_name", "group_seq", "transaction_id", "transport_lsn", "commit_lsn", "committed_at", "metadata"]

    def build(*rows):
        filled = []
        for number, row in enumerate(rows):
            base = {"source_name": "shop", "slot_name": "s", "group_seq": number, "transaction_id": "1", "metadata": {}}
            base.update(row)
            filled.append(tuple(base.get(field) for field in fields))
        return spark.createDataFrame(filled, TXN_HEADER)

    return build
