"""Declared schemas: tables as DDL text, operation bodies by operation type."""

from __future__ import annotations

OPS = (
    "op_id BIGINT, op_type_id SMALLINT, block_num INT, ts TIMESTAMP_NTZ, "
    "trx_in_block INT, body STRING"
)
TRANSACTIONS = "block_num INT, trx_in_block INT, trx_hash BINARY"
BLOCKS = "num INT"
MODULES = "module STRING, module_category STRING, enabled BOOLEAN"
HOOKS = (
    "module STRING, notif_name STRING, notif_code STRING, description STRING, "
    "funct STRING, op_id SMALLINT, notif_filter STRING, options MAP<STRING,STRING>, "
    "hook_ord INT"
)
PREF_HISTORY = (
    "account STRING, module STRING, codes ARRAY<STRING>, created TIMESTAMP_NTZ, "
    "block_num INT, op_id BIGINT"
)
OPTION_HISTORY = (
    "account STRING, options STRING, created TIMESTAMP_NTZ, block_num INT, op_id BIGINT"
)
# One row per account and module; what a later block range needs to know of earlier ones.
STATE = (
    "account STRING, module STRING, codes ARRAY<STRING>, "
    "opts MAP<STRING,MAP<STRING,STRING>>"
)
NOTIFICATIONS = (
    "notif_key STRING, block_num INT, op_id BIGINT, hook_ord INT, trx_id BINARY, "
    "account STRING, module_name STRING, notif_code STRING, created TIMESTAMP_NTZ, "
    "remark STRING, payload STRING, link STRING, verified BOOLEAN, created_date DATE"
)
REJECTS = "block_num INT, op_id BIGINT, notif_name STRING, account STRING, reason STRING"

# {"type": ..., "value": {...}} with each value as a scalar's text or a node's raw JSON.
BODY = "type STRING, value MAP<STRING,STRING>"

AMOUNT = "STRUCT<amount: STRING, precision: INT, nai: STRING>"
AUTH = (
    "STRUCT<weight_threshold: INT, account_auths: ARRAY<ARRAY<STRING>>, "
    "key_auths: ARRAY<ARRAY<STRING>>>"
)

# The documented operation bodies, operation type -> (name, value schema).
OPERATIONS = {
    1: (
        "comment",
        "parent_author STRING, parent_permlink STRING, author STRING, permlink STRING, "
        "title STRING, body STRING, json_metadata STRING",
    ),
    2: ("transfer", f"`from` STRING, `to` STRING, amount {AMOUNT}, memo STRING"),
    3: ("transfer_to_vesting", f"`from` STRING, `to` STRING, amount {AMOUNT}"),
    4: ("withdraw_vesting", f"account STRING, vesting_shares {AMOUNT}"),
    5: (
        "limit_order_create",
        f"owner STRING, orderid BIGINT, amount_to_sell {AMOUNT}, min_to_receive {AMOUNT}, "
        "fill_or_kill BOOLEAN, expiration STRING",
    ),
    6: ("limit_order_cancel", "owner STRING, orderid BIGINT"),
    7: (
        "feed_publish",
        f"publisher STRING, exchange_rate STRUCT<base: {AMOUNT}, quote: {AMOUNT}>",
    ),
    8: ("convert", f"owner STRING, requestid BIGINT, amount {AMOUNT}"),
    9: (
        "account_create",
        f"fee {AMOUNT}, creator STRING, new_account_name STRING, owner {AUTH}, "
        f"active {AUTH}, posting {AUTH}, memo_key STRING, json_metadata STRING",
    ),
    10: (
        "account_update",
        f"account STRING, posting {AUTH}, memo_key STRING, json_metadata STRING",
    ),
    11: (
        "witness_update",
        "owner STRING, url STRING, block_signing_key STRING, "
        f"props STRUCT<account_creation_fee: {AMOUNT}, maximum_block_size: INT, "
        f"hbd_interest_rate: INT>, fee {AMOUNT}",
    ),
    12: ("account_witness_vote", "account STRING, witness STRING, approve BOOLEAN"),
    13: ("account_witness_proxy", "account STRING, proxy STRING"),
    17: ("delete_comment", "author STRING, permlink STRING"),
    18: (
        "custom_json",
        "required_auths ARRAY<STRING>, required_posting_auths ARRAY<STRING>, "
        "id STRING, json STRING",
    ),
    19: (
        "comment_options",
        f"author STRING, permlink STRING, max_accepted_payout {AMOUNT}, percent_hbd INT, "
        "allow_votes BOOLEAN, allow_curation_rewards BOOLEAN, extensions STRING",
    ),
    20: (
        "set_withdraw_vesting_route",
        "from_account STRING, to_account STRING, percent INT, auto_vest BOOLEAN",
    ),
    22: ("claim_account", f"creator STRING, fee {AMOUNT}, extensions STRING"),
    23: (
        "create_claimed_account",
        f"creator STRING, new_account_name STRING, owner {AUTH}, active {AUTH}, "
        f"posting {AUTH}, memo_key STRING, json_metadata STRING, extensions STRING",
    ),
    24: (
        "request_account_recovery",
        "recovery_account STRING, account_to_recover STRING, "
        f"new_owner_authority {AUTH}, extensions STRING",
    ),
    25: (
        "recover_account",
        f"account_to_recover STRING, new_owner_authority {AUTH}, "
        f"recent_owner_authority {AUTH}, extensions STRING",
    ),
    26: (
        "change_recovery_account",
        "account_to_recover STRING, new_recovery_account STRING, extensions STRING",
    ),
    32: ("transfer_to_savings", f"`from` STRING, `to` STRING, amount {AMOUNT}, memo STRING"),
    33: (
        "transfer_from_savings",
        f"`from` STRING, request_id BIGINT, `to` STRING, amount {AMOUNT}, memo STRING",
    ),
    34: ("cancel_transfer_from_savings", "`from` STRING, request_id BIGINT"),
    39: (
        "claim_reward_balance",
        f"account STRING, reward_hive {AMOUNT}, reward_hbd {AMOUNT}, reward_vests {AMOUNT}",
    ),
    40: (
        "delegate_vesting_shares",
        f"delegator STRING, delegatee STRING, vesting_shares {AMOUNT}",
    ),
    42: (
        "witness_set_properties",
        "owner STRING, props ARRAY<ARRAY<STRING>>, extensions STRING",
    ),
    43: (
        "account_update2",
        "account STRING, json_metadata STRING, posting_json_metadata STRING, "
        "extensions STRING",
    ),
    45: (
        "update_proposal_votes",
        "voter STRING, proposal_ids ARRAY<INT>, approve BOOLEAN, extensions STRING",
    ),
    48: ("collateralized_convert", f"owner STRING, requestid BIGINT, amount {AMOUNT}"),
    49: (
        "recurrent_transfer",
        f"`from` STRING, `to` STRING, amount {AMOUNT}, memo STRING, recurrence INT, "
        "executions INT, extensions STRING",
    ),
    50: (
        "fill_convert_request",
        f"owner STRING, requestid BIGINT, amount_in {AMOUNT}, amount_out {AMOUNT}",
    ),
    51: (
        "author_reward",
        f"author STRING, permlink STRING, hbd_payout {AMOUNT}, hive_payout {AMOUNT}, "
        f"vesting_payout {AMOUNT}, curators_vesting_payout {AMOUNT}, "
        "payout_must_be_claimed BOOLEAN",
    ),
    52: (
        "curation_reward",
        f"curator STRING, reward {AMOUNT}, comment_author STRING, "
        "comment_permlink STRING, payout_must_be_claimed BOOLEAN",
    ),
    63: (
        "comment_benefactor_reward",
        f"benefactor STRING, author STRING, permlink STRING, hbd_payout {AMOUNT}, "
        f"hive_payout {AMOUNT}, vesting_payout {AMOUNT}",
    ),
    72: (
        "vote",
        "voter STRING, author STRING, permlink STRING, weight BIGINT, "
        f"total_vote_weight BIGINT, pending_payout {AMOUNT}",
    ),
}
