import datetime
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chainalerts import schemas  # noqa: E402
from tools.check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("4")


START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def make_ops(spark):
    """Operations from (block, op_type, value) or (block, op_type, body text)."""
    def make(rows, first_id=0):
        table = []
        for number, (block, op_type, value) in enumerate(rows, start=first_id):
            body = value if isinstance(value, str) or value is None else json.dumps(
                {"type": "x_operation", "value": value}
            )
            table.append((
                number, op_type, block, START + datetime.timedelta(seconds=3 * block), None, body
            ))
        return spark.createDataFrame(table, schemas.OPS)

    return make


def amount(raw, nai="@@000000013", precision=3):
    return {"amount": raw, "precision": precision, "nai": nai}


def preference(account, payload, text=False):
    return {
        "required_auths": [], "required_posting_auths": [account], "id": "gns",
        "json": json.dumps(payload) if text else payload,
    }


def enabled(account, data, text=False):
    return preference(account, [[1, "app"], "enabled", data], text)


def transfer(to, sender="bob", raw="1000", nai="@@000000013"):
    return {"from": sender, "to": to, "amount": amount(raw, nai), "memo": ""}
