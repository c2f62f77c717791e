import json

import pytest

from chainalerts.operators.handlers import parse_declared, recipient, register_handler
from chainalerts.operators.hooks import Catalog
from chainalerts.plans.notifications import AlertPlan
from tests.conftest import amount, enabled, preference, transfer

HIVE, HP, VESTS = "@@000000021", "@@000000037", "@@000000037"
EVERYTHING = {"currency": ["*"], "social": ["*"], "splinterlands": ["*"]}


def sent(make_ops, rows, who=(), **options):
    """Notifications of operations after the given accounts switched everything on."""
    prefs = [(0, 18, enabled(name, EVERYTHING)) for name in who]
    plan = AlertPlan(make_ops(prefs + [(1, op, value) for op, value in rows]), **options)
    order = ["op_id", "hook_ord", "account"]
    return [
        (r["account"], r["notif_code"], r["remark"], r["link"], r["verified"])
        for r in plan.notifications().orderBy(*order).collect()
    ], plan


SITE = "https://hive.blog/"


def test_transfers(make_ops):
    rows = [
        (2, transfer("orinoco", "ksmith7", "110000")),
        (2, transfer("orinoco", "ksmith7", "12500", HIVE)),
        (2, transfer("orinoco", "ksmith7", "10", HP)),
        (2, transfer("orinoco", "ksmith7", "10", "@@000000099")),
        (2, transfer("orinoco") | {"from": None}),
        (2, transfer("orinoco") | {"to": None}),
        (2, transfer("orinoco") | {"amount": {"amount": "5"}}),
        (2, transfer("orinoco", "ksmith7") | {"amount": json.dumps(amount("7"))}),
    ]
    got, _ = sent(make_ops, rows)
    link = f"{SITE}@ksmith7"
    assert got == [
        ("orinoco", "trn", "you have received 110 HBD from ksmith7", link, True),
        ("orinoco", "trn", "you have received 12.5 HIVE from ksmith7", link, True),
        ("orinoco", "trn", "you have received 1e-05 HP from ksmith7", link, True),
        ("orinoco", "trn", "you have received   from ksmith7", link, True),
        ("orinoco", "trn", "you have received 0.007 HBD from ksmith7", link, True),
    ]


def test_transfer_limits(make_ops):
    limits = {"currency": {"trn": {"min_hbd": 1, "min_hive": 2.5}}}
    ops = make_ops([
        (0, 18, preference("alice", [[1, "a"], "options", limits])),
        (1, 2, transfer("alice", raw="1000")), (1, 2, transfer("alice", raw="999")),
        (1, 2, transfer("alice", raw="2499", nai=HIVE)), (1, 2, transfer("alice", raw="2500", nai=HIVE)),
        (1, 2, transfer("alice", raw="1", nai=HP)),
        (2, 18, preference("alice", [[1, "a"], "options", {"social": {}}])),
        (3, 2, transfer("alice", raw="1")),
    ])
    for bucket in (2, 10_000):
        rows = AlertPlan(ops, bucket_ops=bucket).notifications().collect()
        assert sorted(r["op_id"] for r in rows) == [1, 4, 5, 7]


def test_delegation_and_rewards(make_ops):
    def deleg(raw):
        return {"delegator": "whale", "delegatee": "nyc925", "vesting_shares": amount(raw, VESTS, 6)}

    rows = [
        (40, deleg("24000000000")), (40, deleg("0")),
        (40, {"delegator": "whale", "delegatee": "nyc925"}),
        (51, {"author": "dbooster", "permlink": "re-x", "hbd_payout": amount("8"),
              "hive_payout": amount("0", HIVE), "vesting_payout": amount("12856764", VESTS, 6)}),
        (63, {"benefactor": "benny", "author": "dbooster", "permlink": "re-x",
              "hbd_payout": amount("8"), "hive_payout": amount("0", HIVE),
              "vesting_payout": amount("25", VESTS, 6)}),
        (52, {"curator": "jagoe", "reward": amount("62447195", VESTS, 6),
              "comment_author": "lacausa", "comment_permlink": "oathvaay"}),
    ]
    got, _ = sent(make_ops, rows, ["nyc925", "dbooster", "benny", "jagoe"])
    assert got == [
        ("nyc925", "del", "whale is now delegating 24000.000000 VESTS to you", f"{SITE}@whale", True),
        ("nyc925", "del", "whale removed their vesting delegation", f"{SITE}@whale", True),
        ("nyc925", "del", "whale removed their vesting delegation", f"{SITE}@whale", True),
        ("dbooster", "arw",
         "You received a reward for your post. 0.008 HBD, 0 HIVE, 12.856764 VESTS",
         f"{SITE}@dbooster/re-x", True),
        ("benny", "brw",
         "You received a benefactor reward from dbooster: 0.008 HBD, 0 HIVE, 2.5e-05 VESTS",
         f"{SITE}@dbooster/re-x", True),
        ("jagoe", "crw", "You received a curation reward of 62.447195 VESTS",
         f"{SITE}@lacausa/oathvaay", True),
    ]
    assert sent(make_ops, rows)[0] == []


def test_semantics_modes_differ_in_two_handlers(make_ops):
    rows = [
        (50, {"owner": "ua-eth", "requestid": 6, "amount_in": amount("1022"),
              "amount_out": amount("872", HIVE)}),
        (1, {"parent_author": "paul", "parent_permlink": "post", "author": "anna",
             "permlink": "re", "body": "", "title": "", "json_metadata": ""}),
        (2, transfer("paul")),
    ]
    who = ["ua-eth", "paul"]
    reference, _ = sent(make_ops, rows, who)
    fixed, _ = sent(make_ops, rows, who, semantics="fixed")
    assert reference[0][2] == "Successfully converted 1.022 HIVE to 0.872 HBD"
    assert fixed[0][2] == "Successfully converted 1.022 HBD to 0.872 HIVE"
    assert reference[1] == ("anna", "com", "paul commented on your post", f"{SITE}@anna/re", True)
    assert fixed[1] == ("paul", "com", "anna commented on your post", f"{SITE}@anna/re", True)
    assert reference[2:] == fixed[2:]
    with pytest.raises(ValueError):
        sent(make_ops, rows, semantics="other")


def test_votes(make_ops):
    def vote(weight, total, raw):
        return {"voter": "bob", "author": "anna", "permlink": "p", "weight": weight,
                "total_vote_weight": total, "pending_payout": amount(raw)}

    rows = [
        (72, vote(50, 100, "30")), (72, vote(149, 1000, "100")), (72, vote(50, None, "30")),
        (72, vote(0, 100, "30")), (72, vote(1, 3, "1000000")), (72, vote(0, None, None)),
        (72, vote(1, 1, "99999999999999")),
    ]
    got, plan = sent(make_ops, rows)
    assert [row[2] for row in got] == [
        "bob voted on your post ($0.02)", "bob voted on your post ($333.33)"]
    assert [r["reason"] for r in plan.rejects().collect()] == ["value is out of range"]


def test_mentions(make_ops):
    def post(body, parent="", author="bob"):
        return {"parent_author": parent, "parent_permlink": "pp", "author": author,
                "permlink": "pl", "title": "", "body": body, "json_metadata": ""}

    rows = [(1, post("hi @bob @Bob @anna @anna")), (1, post("see @anna", "paul")),
            (1, post(None))]
    got, _ = sent(make_ops, rows)
    own = f"{SITE}@bob/pl"
    assert sorted(got) == sorted([
        ("Bob", "men", "bob mentioned you in a post", own, True),
        ("anna", "men", "bob mentioned you in a post", own, True),
        ("anna", "men", "bob mentioned you in a comment", f"{SITE}@paul/pp#@bob/pl", True),
    ])


def test_token_transfers(make_ops):
    def token(payload, identifier="sm_token_transfer"):
        return {"required_auths": ["bob"], "required_posting_auths": [], "id": identifier,
                "json": payload}

    rows = [
        (18, token({"to": "anna", "qty": 12.5, "token": "DEC", "memo": ""})),
        (18, token(json.dumps({"to": "anna", "qty": "3", "token": "SPS"}))),
        (18, token({"qty": 1, "token": "DEC"})), (18, token({"to": "anna", "qty": 1}, "other")),
        (18, token({"to": "carl", "qty": 1, "token": "DEC"})),
    ]
    got, _ = sent(make_ops, rows, ["anna"])
    assert got == [
        ("anna", "trn", "you have received 12.5 DEC from bob", f"{SITE}@bob", None),
        ("anna", "trn", "you have received 3 SPS from bob", f"{SITE}@bob", None),
    ]


def test_rejects_keep_the_run_going(make_ops):
    rows = [
        (40, {"delegator": "whale", "vesting_shares": amount("5")}),
        (2, transfer("a" * 17)),
        (2, transfer("alice", raw="abc")),
        (40, {"delegator": "w", "delegatee": "n", "vesting_shares": amount("1.5")}),
        (51, {"author": "alice", "permlink": "p", "hbd_payout": amount("x")}),
        (51, {"author": "nobody-on", "permlink": "p", "hbd_payout": amount("x")}),
        (2, transfer("alice")),
        (72, "not json"),
    ]
    got, plan = sent(make_ops, rows, ["alice"])
    assert [row[2] for row in got] == ["you have received 1 HBD from bob"]
    reasons = {r["op_id"]: r["reason"] for r in plan.rejects().collect()}
    assert reasons == {
        1: "account is null", 2: "from or to is longer than 16", 3: "amount is not a number",
        4: "amount is not an integer", 5: "hbd_payout is not a number", 8: "account is null",
    }
    with pytest.raises(ValueError, match="block 1"):
        plan.fail_on_rejects()


def test_custom_handler(make_ops):
    register_handler("watch_deletes", lambda semantics: "array({})".format(recipient(
        "v['author']", "concat('your post ', v['permlink'], ' is gone')", "'https://x/'")))
    catalog = Catalog.default().register({"social": {
        "enabled": True, "module_category": "Social",
        "deleted": {"op_id": 17, "description": "Deleted", "function": "app.watch_deletes",
                    "notif_code": "dlt", "filter": {"permlink": "old"}, "options": {}},
    }})
    ops = make_ops([
        (0, 18, enabled("anna", {"social": ["dlt"]})),
        (1, 17, {"author": "anna", "permlink": "old"}),
        (1, 17, {"author": "anna", "permlink": "new"}),
    ])
    rows = AlertPlan(ops, catalog).notifications().collect()
    assert [(r["account"], r["remark"]) for r in rows] == [("anna", "your post old is gone")]
    unknown = catalog.register({"social": {
        "enabled": True, "module_category": "Social",
        "x": {"op_id": 17, "description": "", "function": "nothing", "notif_code": "xxx"}}})
    with pytest.raises(ValueError, match="nothing"):
        AlertPlan(ops, unknown).candidates()


def test_nodes_are_parsed_where_a_handler_asks(spark):
    register_handler(
        "node_reader", lambda semantics: f"array({recipient('nodes.json.to', 'NULL', 'NULL')})",
        nodes={"json": "`to` STRING"}, when="v['id'] = 'wanted'",
    )
    matched = spark.sql("""SELECT 'node_reader' AS funct, map('id', id, 'json', '{"to": "a"}') AS v
                           FROM VALUES ('wanted'), ('other'), (CAST(NULL AS STRING)) AS t(id)""")
    found = parse_declared(matched, ["node_reader"]).selectExpr("v['id'] AS id", "nodes.json.to AS named").collect()
    assert {r["id"]: r["named"] for r in found} == {"wanted": "a", "other": None, None: None}
