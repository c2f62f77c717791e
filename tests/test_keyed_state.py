"""Account state in the state store."""

import tempfile

import pytest

from chainalerts.operators.hooks import Catalog
from chainalerts.plans.jobs import preload_state
from chainalerts.plans.notifications import AlertPlan
from chainalerts.sources.block_source import publish_range
from chainalerts.streaming.keyed_state import KeyedAlertStream
from chainalerts.streaming.sync import read_output
from tests.conftest import enabled, preference, transfer


@pytest.fixture(scope="module")
def log(make_ops):
    limits = {"currency": {"trn": {"min_hbd": 2}}}
    rows = [(1, 18, enabled("carol", {"currency": ["trn"], "social": []}))]
    for n in range(2, 12):
        rows += [
            (n, 2, transfer("alice")), (n, 18, enabled("alice", {"currency": ["trn"] if n % 2 else []})),
            (n, 18, enabled("alice", {"social": ["vot"]})), (n, 2, transfer("alice")),
            (n, 18, preference("bob", [[1, "a"], "options", limits if n % 3 else {}])), (n, 2, transfer("bob")),
            (n, 18, enabled("carol", {"currency": []}) if n == 6 else "broken"), (n, 2, transfer("carol")),
        ]
    return make_ops(rows).persist()


def keys(frame):
    return sorted(r["notif_key"] for r in frame.collect())


def state_rows(spark, folder):
    states = spark.read.format("statestore").option("stateVarName", "held").load(f"{folder}/checkpoint")
    return states.count()


def test_stream_equals_batch_and_state_stays_small(spark, log):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    stream = KeyedAlertStream(f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint")
    sizes = []
    for blocks in ((1, 1), (2, 5), (6, 6), (7, 8), (9, 11)):
        publish_range(log, f"{folder}/landing", *blocks, 11)
        stream.start(spark).awaitTermination()
        sizes.append(state_rows(spark, folder))
    assert keys(read_output(spark, f"{folder}/out")) == keys(AlertPlan(log).notifications()) != []
    # Alice and carol set two modules, bob's document sets each of the four.
    assert sizes[0] == 2 and set(sizes[1:]) == {2 + 2 + len(Catalog.default().modules)}
    stream.start(spark).awaitTermination()
    assert stream.store(spark).progress().count() == 5
    assert KeyedAlertStream("x", "y", "z", sync_enabled=False).start(spark) is None


def test_initial_state_and_replay(spark, log):
    """State of a preload comes first; a batch that was committed and runs again changes nothing."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    state = preload_state(log, Catalog.default(), 1, 5)
    stream = KeyedAlertStream(f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint", initial_state=state)
    publish_range(log, f"{folder}/landing", 6, 11, 11)
    stream.start(spark).awaitTermination()
    whole = keys(AlertPlan(log).notifications().where("block_num > 5"))
    assert keys(read_output(spark, f"{folder}/out")) == whole
    again = KeyedAlertStream(f"{folder}/landing", f"{folder}/out", f"{folder}/other", initial_state=state)
    again.start(spark).awaitTermination()
    assert keys(read_output(spark, f"{folder}/out")) == whole
