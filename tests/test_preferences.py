import json

from chainalerts.operators.accounts import current_accounts, discover, read_marks, with_read_marks
from chainalerts.operators.hooks import Catalog
from chainalerts.operators.preferences import option_history, pref_history, preference_log
from chainalerts.plans import account_queries as ask
from chainalerts.plans.notifications import AlertPlan, candidates
from tests.conftest import enabled, preference, transfer

CATALOG = Catalog.default()


def verdicts(make_ops, values):
    log = preference_log(make_ops([(1, 18, value) for value in values]), CATALOG)
    return {row["op_id"]: row for row in log.collect()}


def test_envelopes(make_ops):
    cases = [
        ('[[1,"a"],"enabled",{"social":["vot"]}]', True, True),
        ('[[1.5,"a"],"enabled",{}]', True, True),
        ('["enabled",{"social":["vot"]}]', False, False),
        ('[[1,"a","b"],"enabled",{}]', False, False),
        ('[["1","a"],"enabled",{}]', False, False),
        ('[[1,"a"],"enabled",[]]', False, False),
        ('[[1,"a"],"enabled"]', True, False),
        ('[[1,"a"],"read",{}]', True, False),
        ('{"a":1}', True, False),
        ("[]", False, False),
        ("[[]]", False, False),
        ('[{"a":1},"enabled",{}]', False, False),
        ('[[1,"a"],5,{}]', False, False),
        ("7", False, False),
        ("not json", False, False),
    ]
    values = []
    for payload, *_ in cases:
        values.append(preference("alice", None) | {"json": payload})
    # The same payloads as nested nodes instead of text.
    for payload, *_ in cases[:-1]:
        values.append(preference("alice", json.loads(payload)))
    got = verdicts(make_ops, values)
    for number, (payload, valid, effective) in enumerate(cases + cases[:-1]):
        assert (got[number]["valid"], got[number]["effective"]) == (valid, effective), payload
    assert got[len(cases) - 1]["reason"] == "malformed json"


def test_enabled_rules(make_ops):
    cases = [
        ({"social": ["vot", "men"]}, "accepted"),
        ({"currency": ["*", "zzz"]}, "accepted"),
        ({"nosuch": ["*"]}, "broken"),
        ({"nosuch": []}, "accepted"),
        ({"nosuch": ["trn"]}, "rejected"),
        ({"currency": ["zzz"], "social": ["vot"]}, "rejected"),
        ({"currency": "trn"}, "broken"),
        ({"currency": None}, "broken"),
        ({"currency": [None]}, "rejected"),
        ({"core": ["*"]}, "accepted"),
        ({}, "accepted"),
    ]
    ops = make_ops([(1, 18, enabled("alice", data)) for data, _ in cases])
    log = preference_log(ops, CATALOG)
    assert [row["outcome"] for row in log.orderBy("op_id").collect()] == [c[1] for c in cases]
    history = {(r["op_id"], r["module"]): sorted(r["codes"]) for r in pref_history(log).collect()}
    assert history == {
        (0, "social"): ["men", "vot"],
        (1, "currency"): ["arw", "brw", "crw", "del", "fcr", "trn"],
        (3, "nosuch"): [], (9, "core"): ["gns"],
    }


def test_option_rules(make_ops):
    cases = [
        ({"currency": {"trn": {"min_hbd": 1, "min_hive": 0.01}}}, "accepted"),
        ({"currency": {"trn": {}}}, "accepted"),
        ({"currency": {"del": {}}}, "accepted"),
        ({"currency": {"trn": {"min_hbd": "1"}}}, "rejected"),
        ({"currency": {"trn": {"other": 1}}}, "rejected"),
        ({"currency": {"del": {"min_hbd": 1}}}, "rejected"),
        ({"currency": {"zzz": {}}}, "rejected"),
        ({"nosuch": {"trn": {}}}, "rejected"),
        ({"nosuch": {}}, "accepted"),
        ({"currency": ["trn"]}, "broken"),
        ({"currency": {"trn": 5}}, "broken"),
        ({}, "accepted"),
    ]
    ops = make_ops([
        (1, 18, preference("alice", [[1, "a"], "options", data])) for data, _ in cases
    ])
    log = preference_log(ops, CATALOG)
    assert [row["outcome"] for row in log.orderBy("op_id").collect()] == [c[1] for c in cases]
    first = option_history(log).orderBy("op_id").first()["options"]
    assert json.loads(first) == cases[0][0]


def test_signers_without_authority(make_ops):
    no_auth = enabled("x", {"social": []}) | {"required_posting_auths": []}
    long_name = enabled("a" * 17, {"social": []})
    got = verdicts(make_ops, [no_auth, long_name])
    assert got[0]["reason"] == "no posting authority"
    assert got[1]["reason"] == "account is longer than 16"


def test_accounts(spark, make_ops):
    ops = make_ops([
        (1, 2, transfer("alice")),
        (2, 18, enabled("alice", {"currency": []})),
        (3, 18, enabled("alice", {"currency": ["zzz"]})),
        (4, 18, enabled("carol", {"currency": ["zzz"]})),
        (5, 18, preference("alice", [[1, "a"], "options", {"currency": {"trn": {"min_hbd": 5}}}])),
        (6, 18, preference("alice", [[1, "a"], "options", {"social": {"vot": {}}}])),
        (7, 18, preference("dave", ["enabled", {"currency": []}])),
        (8, 18, preference("alice", ["read", ["currency.trn"]])),
    ])
    log = preference_log(ops, CATALOG)
    accounts = current_accounts(discover(candidates(ops, CATALOG), log), log, CATALOG)
    rows = {row["account"]: row for row in accounts.collect()}
    # A rejected operation still makes the account known, a bad envelope does not.
    assert set(rows) == {"alice", "carol"}
    assert rows["alice"]["prefs"] == {"social": ["vot", "men"], "currency": []}
    assert json.loads(rows["alice"]["options"]) == {"social": {"vot": {}}}
    assert rows["alice"]["last_reads"]["all"].startswith("2023-12-02 00:00:03")
    assert rows["carol"]["prefs"] == {"social": ["vot", "men"], "currency": ["trn"]}
    assert rows["carol"]["prefs_updated"] is None
    pairs = {tuple(r) for r in ask.enabled_pairs(accounts, "alice").collect()}
    assert pairs == {("alice", "social:vot"), ("alice", "social:men")}


def test_read_marks_move_questions(spark, make_ops):
    ops = make_ops([
        (1, 2, transfer("alice", raw="1000")),
        (2, 18, preference("alice", ["read", ["currency.trn"]])),
        (3, 2, transfer("alice", raw="2000")),
        (3, 2, transfer("carol", raw="3000")),
    ])
    log = preference_log(ops, CATALOG)
    accounts = current_accounts(discover(candidates(ops, CATALOG), log), log, CATALOG)
    marked = with_read_marks(accounts, read_marks(ops, CATALOG))
    notes = AlertPlan(ops).notifications()
    as_of = "2024-01-02 00:00:00"
    count = lambda accounts: {
        (r["account"], r["remark"]) for r in ask.transfers(notes, accounts, as_of).collect()}
    assert len(count(accounts)) == 3
    assert count(marked) == {
        ("alice", "you have received 2 HBD from bob"), ("carol", "you have received 3 HBD from bob")}
    assert ask.unread_count(notes, accounts, "alice").first()["unread"] == 2
    assert ask.unread_count(notes, accounts, "nobody").first()["unread"] == 0


def test_read_marks_cannot_stop_a_run(make_ops):
    ops = make_ops([
        (1, 18, preference("alice", ["read", ["all"]])), (2, 18, preference("alice", ["read", [None]])),
        (3, 18, preference("alice", ["read", ["no.such", "social.vot", "social.vot"]])),
        (4, 18, preference("bob", ["read", "all"])), (5, 18, preference("bob", ["read"])),
        (6, 18, enabled("alice", {f"unknown{n}": [] for n in range(50)})),
    ])
    log = preference_log(ops, CATALOG)
    accounts = current_accounts(discover(candidates(ops, CATALOG), log), log, CATALOG)
    marked = with_read_marks(accounts, read_marks(ops, CATALOG)).collect()
    assert {r["account"]: set(r["last_reads"]) for r in marked} == {"alice": {"all", "social.vot"}}
    assert marked[0]["last_reads"]["all"] == "2024-01-01 00:00:03"
    assert set(marked[0]["prefs"]) == {"social", "currency"}


def test_module_that_an_account_does_not_have(make_ops):
    ops = make_ops([(1, 18, enabled("alice", {"splinterlands": ["trn"]})), (2, 2, transfer("carol"))])
    log = preference_log(ops, CATALOG)
    accounts = current_accounts(discover(candidates(ops, CATALOG), log), log, CATALOG)
    rows = {r["account"]: r for r in ask.preferences(accounts, module="splinterlands").collect()}
    assert rows["alice"]["prefs"] == ["trn"] and rows["alice"]["all_prefs"] is None
    assert rows["carol"]["prefs"] is None and set(rows["carol"]["all_prefs"]) == {"social", "currency"}
