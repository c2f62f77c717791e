import random

from pyspark.sql import functions as F

from chainalerts.operators.asof import asof_state
from chainalerts.plans.notifications import AlertPlan
from tests.conftest import enabled, transfer

CHANGES = ("account string, module string, codes array<string>, "
           "opts map<string,map<string,string>>, block_num int, op_id bigint, hook_ord int")


def random_log(seed):
    """Rows and changes over few accounts; one account holds a third of everything."""
    rng = random.Random(seed)
    rows, changes = [], []
    for op_id in range(600):
        block = op_id // 6
        account = "hot" if rng.random() < 0.34 else f"a{rng.randrange(8)}"
        module = rng.choice(["social", "currency"])
        if rng.random() < 0.3:
            codes = [rng.choice(["x", "y"])] if rng.random() < 0.7 else None
            opts = {"c": {"k": str(op_id)}} if codes is None or rng.random() < 0.3 else None
            changes.append((account, module, codes, opts, block, op_id, 1))
        else:
            rows.append((account, module, block, op_id, rng.randrange(2, 5)))
    return rows, changes


def replay(rows, changes):
    """The state each row met, by walking the log in order."""
    state, expected = {}, {}
    log = [(c[4], c[5], c[6], c) for c in changes] + [(r[2], r[3], r[4], r) for r in rows]
    for block, op_id, hook, item in sorted(log, key=lambda entry: entry[:3]):
        key = (item[0], item[1])
        codes, opts = state.get(key, (None, None))
        if len(item) == 7:
            state[key] = (item[2] if item[2] is not None else codes,
                          item[3] if item[3] is not None else opts)
        else:
            expected[op_id] = (codes, opts)
    return expected


def test_equals_a_replay(spark):
    for seed in (1, 2):
        rows, changes = random_log(seed)
        expected = replay(rows, changes)
        left = spark.createDataFrame(
            rows, "gate_account string, module string, block_num int, op_id bigint, hook_ord int")
        right = spark.createDataFrame(changes, CHANGES)
        for bucket in (1, 7, 100, 10_000):
            got = asof_state(left, right, bucket).collect()
            assert len(got) == len(rows)
            assert {r["op_id"]: (r["codes"], r["opts"]) for r in got} == expected


def test_state_within_one_block(make_ops):
    ops = make_ops([
        (5, 2, transfer("alice")), (5, 18, enabled("alice", {"currency": []})),
        (5, 2, transfer("alice")), (5, 18, enabled("alice", {"currency": ["trn"]}, text=True)),
        (5, 2, transfer("alice")), (5, 2, transfer("unseen")),
    ])
    for bucket in (1, 10_000):
        got = AlertPlan(ops, bucket_ops=bucket).notifications().orderBy("op_id").collect()
        assert [row["op_id"] for row in got] == [0, 4, 5]


def test_planning_runs_no_job(spark, make_ops):
    ops = make_ops([(1, 2, transfer("alice"))])
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    text = AlertPlan(ops).notifications()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in text and "Broadcast" not in text
    assert len(tracker.getJobIdsForGroup()) == before


def test_snapshot_is_the_opening_state(spark, make_ops):
    snapshot = spark.createDataFrame(
        [("alice", "currency", [], None)],
        "account string, module string, codes array<string>, opts map<string,map<string,string>>")
    ops = make_ops([(1, 2, transfer("alice")), (1, 2, transfer("bob"))])
    got = AlertPlan(ops, snapshot=snapshot).notifications().select(F.col("account")).collect()
    assert [row["account"] for row in got] == ["bob"]
