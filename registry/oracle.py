"""The same answers in SQL, from the raw columns: no body is built or parsed here."""

from __future__ import annotations


def _decimal(n: str, digits: int) -> str:
    """Text of the integer ``n`` / 10^digits by integer arithmetic."""
    one = 10**digits
    plain = (
        f"CAST({n} // {one} AS VARCHAR) || CASE WHEN {n} % {one} = 0 THEN '' ELSE "
        f"'.' || rtrim(lpad(CAST({n} % {one} AS VARCHAR), {digits}, '0'), '0') END"
    )
    if digits < 6:
        return f"({plain})"
    return (
        f"(CASE WHEN {n} BETWEEN 1 AND 9 THEN {n} || 'e-06' "
        f"WHEN {n} BETWEEN 10 AND 99 THEN ({n} // 10) || CASE WHEN {n} % 10 = 0 THEN '' "
        f"ELSE '.' || ({n} % 10) END || 'e-05' ELSE {plain} END)"
    )


EVENTS = """
ev AS (
  SELECT event_id, ts, event_type, value, k,
         CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents,
         'u' || CAST(1000 + user_id AS VARCHAR) AS u,
         'u' || CAST(1001 + user_id + k AS VARCHAR) AS p,
         event_id // 10 AS block,
         CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 72 WHEN 'view' THEN 1
              WHEN 'signup' THEN 18
              ELSE CASE event_id % 5 WHEN 0 THEN 40 WHEN 1 THEN 51 WHEN 2 THEN 63
                   WHEN 3 THEN 52 ELSE 50 END END AS op
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""

HOOKS = """
hooks(hook_ord, module, notif_name, code, op, category, description) AS (VALUES
  (1, 'core', 'gns', 'gns', 18, 'GNS', 'GNS Core Operations'),
  (2, 'currency', 'author_reward', 'arw', 51, 'Currency', 'Author rewards'),
  (3, 'currency', 'comment_benefactor_reward', 'brw', 63, 'Currency', 'Comment benefactor rewards'),
  (4, 'currency', 'core_transfer', 'trn', 2, 'Currency', 'Hive/HBD transfers'),
  (5, 'currency', 'curation_reward', 'crw', 52, 'Currency', 'Curation rewards'),
  (6, 'currency', 'deleg', 'del', 40, 'Currency', 'Delegations'),
  (7, 'currency', 'fill_convert_request', 'fcr', 50, 'Currency', 'Fill convert requests'),
  (8, 'social', 'comment', 'com', 1, 'Social', 'Comment on post'),
  (9, 'social', 'mention', 'men', 1, 'Social', 'Mention in post or comment'),
  (10, 'social', 'vote', 'vot', 72, 'Social', 'Vote on post or comment'),
  (11, 'splinterlands', 'sm_token_transfer', 'trn', 18, 'Splinterlands', 'DEC transfers'))"""

STATE = EVENTS + """,
sg AS (SELECT *, event_id % 10 AS c FROM ev WHERE op = 18 AND event_id % 10 <> 9),
pref AS (
  SELECT u AS account, 'currency' AS module,
         CASE c WHEN 2 THEN ['arw','brw','crw','del','fcr','trn'] WHEN 3 THEN []
                WHEN 4 THEN ['arw','del'] ELSE ['trn'] END AS codes, event_id, block, ts
  FROM sg WHERE c <= 4
  UNION ALL
  SELECT u, 'social', CASE c WHEN 2 THEN ['vot'] ELSE ['com','men'] END, event_id, block, ts
  FROM sg WHERE c IN (2, 4)),
opt AS (SELECT u AS account, k AS lim, event_id, block, ts FROM sg WHERE c = 6)"""


def _candidates(semantics: str = "reference") -> str:
    hbd_in, other_in = ("HIVE to", "HBD"), ("HBD to", "HIVE")
    if semantics == "fixed":
        hbd_in, other_in = other_in, hbd_in
    reply_to, reply_name = ("p", "u") if semantics == "reference" else ("u", "p")
    payouts = (
        f"{_decimal('cents', 3)} || ' HBD, 0 HIVE, ' || {_decimal('cents', 6)} || ' VESTS'"
    )
    site = "'https://hive.blog/@'"
    money = f"""CASE event_id % 4 WHEN 0 THEN {_decimal('(cents * 10)', 3)} || ' HBD'
        WHEN 1 THEN {_decimal('(cents * 10)', 3)} || ' HIVE'
        WHEN 2 THEN {_decimal('(cents * 10)', 6)} || ' HP' ELSE ' ' END"""
    hundredths = "((k * cents + 500) // 1000)"
    return f"""
cand AS (
  SELECT event_id, block, ts, op, 4 AS hook_ord, 'currency' AS module, 'trn' AS code,
         u AS account, u AS gate, true AS ok, 'you have received ' || {money} || ' from ' || p AS remark,
         {site} || p AS link, true AS verified,
         CASE event_id % 4 WHEN 0 THEN cents - 0 WHEN 1 THEN cents * 2 END AS limited
  FROM ev WHERE op = 2
  UNION ALL
  SELECT event_id, block, ts, op, 6, 'currency', 'del', u, u, true,
         CASE WHEN k >= 20 AND cents > 0 THEN p || ' is now delegating ' || CAST(cents // 100 AS VARCHAR)
              || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || '0000 VESTS to you'
              ELSE p || ' removed their vesting delegation' END, {site} || p, true, NULL
  FROM ev WHERE op = 40
  UNION ALL
  SELECT event_id, block, ts, op, 2, 'currency', 'arw', u, u, true,
         'You received a reward for your post. ' || {payouts},
         {site} || u || '/p' || event_id, true, NULL
  FROM ev WHERE op = 51
  UNION ALL
  SELECT event_id, block, ts, op, 3, 'currency', 'brw', u, u, true,
         'You received a benefactor reward from ' || p || ': ' || {payouts},
         {site} || p || '/p' || event_id, true, NULL
  FROM ev WHERE op = 63
  UNION ALL
  SELECT event_id, block, ts, op, 5, 'currency', 'crw', u, u, true,
         'You received a curation reward of ' || {_decimal('cents', 6)} || ' VESTS',
         {site} || p || '/p' || event_id, true, NULL
  FROM ev WHERE op = 52
  UNION ALL
  SELECT event_id, block, ts, op, 7, 'currency', 'fcr', u, u, true,
         'Successfully converted ' || {_decimal('cents', 3)} || ' ' ||
         CASE WHEN k % 2 = 0 THEN '{hbd_in[0]}' ELSE '{other_in[0]}' END || ' ' ||
         {_decimal('cents', 3)} || ' ' ||
         CASE WHEN k % 2 = 0 THEN '{hbd_in[1]}' ELSE '{other_in[1]}' END,
         {site} || u, true, NULL
  FROM ev WHERE op = 50
  UNION ALL
  SELECT event_id, block, ts, op, 10, 'social', 'vot', u, u, {hundredths} > 1,
         p || ' voted on your post ($' || CAST({hundredths} // 100 AS VARCHAR) || '.' ||
         lpad(CAST({hundredths} % 100 AS VARCHAR), 2, '0') || ')',
         {site} || u || '/p' || event_id, true, NULL
  FROM ev WHERE op = 72
  UNION ALL
  SELECT event_id, block, ts, op, 8, 'social', 'com', {reply_to}, u, true,
         {reply_name} || ' commented on your post', {site} || p || '/c' || event_id, true, NULL
  FROM ev WHERE op = 1 AND k < 50
  UNION ALL
  SELECT event_id, block, ts, op, 9, 'social', 'men', who, who, true,
         p || ' mentioned you in a ' || CASE WHEN k < 50 THEN 'comment' ELSE 'post' END,
         CASE WHEN k < 50 THEN {site} || u || '/p' || k || '#@' || p || '/c' || event_id
              ELSE {site} || p || '/c' || event_id END, true, NULL
  FROM (SELECT *, unnest([u, 'mail' || CAST(k % 10 AS VARCHAR)]) AS who FROM ev WHERE op = 1)
  UNION ALL
  SELECT event_id, block, ts, op, 11, 'splinterlands', 'trn', u, u, true,
         'you have received ' || {_decimal('cents', 2)} || ' DEC from ' || p,
         {site} || p, NULL, NULL
  FROM ev WHERE op = 18 AND event_id % 10 = 9)"""


def _resolved(semantics: str = "reference", tokens: bool = False) -> str:
    on_by_default = "(c.module = 'social' AND c.code IN ('vot','men')) OR (c.module = 'currency' AND c.code = 'trn')"
    if tokens:
        on_by_default = "c.module = 'splinterlands'"
    return "WITH " + STATE + "," + _candidates(semantics) + f""",
resolved AS (
  SELECT c.*, o.lim,
         CASE WHEN p.event_id IS NULL THEN ({on_by_default})
              ELSE list_contains(p.codes, c.code) END AS subscribed
  FROM cand c
  ASOF LEFT JOIN pref p ON c.gate = p.account AND c.module = p.module AND c.event_id > p.event_id
  ASOF LEFT JOIN opt o ON c.gate = o.account AND c.event_id > o.event_id),
judged AS (
  SELECT *, ok AND subscribed AND NOT coalesce(limited < lim * 100, false) AS passes FROM resolved),
notif AS (
  SELECT block || ':' || event_id || ':' || hook_ord || ':' || account AS notif_key,
         block AS block_num, event_id AS op_id, CAST(hook_ord AS BIGINT) AS hook_ord,
         CASE WHEN op < 50 THEN md5(CAST(event_id AS VARCHAR)) END AS trx_id, account,
         module AS module_name, code AS notif_code, ts AS created, remark, link, verified, cents
  FROM judged JOIN (SELECT event_id, cents FROM ev) USING (event_id)
  WHERE passes)
"""


SHOWN = "notif_key, block_num, op_id, hook_ord, trx_id, account, module_name, notif_code, created, remark, link, verified"
NOTIF = _resolved()
TOKENS = _resolved(tokens=True)
AS_OF = "TIMESTAMP '2024-02-10 00:00:00'"


def _of_code(hook_ord: int, base: str = NOTIF) -> str:
    return f"{base} SELECT {SHOWN} FROM notif WHERE hook_ord = {hook_ord}"


def _ranked(condition: str, limit: int, base: str = NOTIF) -> str:
    return f"""{base}, ranked AS (
  SELECT row_number() OVER (PARTITION BY account ORDER BY op_id DESC, hook_ord DESC) AS rank,
         account, created, remark, link FROM notif WHERE {condition})
SELECT rank, account, created, remark, link FROM ranked WHERE rank <= {limit}"""


# Accounts anyone refers to, from all candidates and from preference operations with a
# proper envelope.
REFERENCED = "WITH " + STATE + "," + _candidates() + """,
refs AS (
  SELECT account, ts, event_id, block FROM cand UNION ALL SELECT gate, ts, event_id, block FROM cand
  UNION ALL SELECT u, ts, event_id, block FROM sg WHERE c < 8),
found AS (
  SELECT account, min(ts) AS first_seen, min(block) AS first_block, min(event_id) AS first_op_id
  FROM refs GROUP BY account),
own AS (SELECT account, module, arg_max(codes, event_id) AS codes FROM pref GROUP BY account, module),
merged AS (
  SELECT f.account, d.module, CASE WHEN o.account IS NULL THEN d.codes ELSE o.codes END AS codes
  FROM found f
  JOIN (VALUES ('currency', ['trn']), ('social', ['men', 'vot'])) d(module, codes) ON true
  LEFT JOIN own o ON o.account = f.account AND o.module = d.module),
acc AS (
  SELECT f.*, (SELECT string_agg(module || ':' || array_to_string(list_sort(codes), ','), ';' ORDER BY module)
               FROM merged m WHERE m.account = f.account) AS prefs,
         pu.prefs_updated, ou.options_updated, ou.lim
  FROM found f
  LEFT JOIN (SELECT account, max(ts) AS prefs_updated FROM pref GROUP BY account) pu USING (account)
  LEFT JOIN (SELECT account, max(ts) AS options_updated, arg_max(lim, event_id) AS lim
             FROM opt GROUP BY account) ou USING (account))
"""

DISPATCHED = "WITH " + EVENTS + "," + HOOKS + """,
hit AS (SELECT e.*, CAST(h.hook_ord AS BIGINT) AS hook_ord, h.module, h.notif_name, h.code,
               h.category, h.description FROM ev e JOIN hooks h ON h.op = e.op)
"""


# Marks of the sign-up events by ``event_id div 10 mod 6``.
READ_MARKS = "WITH " + EVENTS + """,
marks AS (
  SELECT u AS account, pair, max(ts) AS read_at FROM (
    SELECT u, ts, unnest(CASE block % 6 WHEN 0 THEN ['currency.trn'] WHEN 1 THEN ['all'] WHEN 2 THEN ['social.vot']
      WHEN 3 THEN ['currency.trn'] WHEN 4 THEN ['social.vot'] ELSE [] END) AS pair
    FROM ev WHERE event_type = 'signup') GROUP BY 1, 2)"""

# The documented operation types in order, their number of fields, their first
# text field, and whether they have an amount.
DOCUMENTED = """comment 7 parent_author 0; transfer 4 from 1; transfer_to_vesting 3 from 1; withdraw_vesting 2 account 1;
limit_order_create 6 owner 1; limit_order_cancel 2 owner 0; feed_publish 2 publisher 0; convert 3 owner 1;
account_create 8 creator 1; account_update 4 account 0; witness_update 5 owner 1; account_witness_vote 3 account 0;
account_witness_proxy 2 account 0; delete_comment 2 author 0; custom_json 4 id 0; comment_options 7 author 1;
set_withdraw_vesting_route 4 from_account 0; claim_account 3 creator 1; create_claimed_account 8 creator 0;
request_account_recovery 4 recovery_account 0; recover_account 4 account_to_recover 0;
change_recovery_account 3 account_to_recover 0; transfer_to_savings 4 from 1; transfer_from_savings 5 from 1;
cancel_transfer_from_savings 2 from 0; claim_reward_balance 4 account 1; delegate_vesting_shares 3 delegator 1;
witness_set_properties 3 owner 0; account_update2 4 account 0; update_proposal_votes 4 voter 0;
collateralized_convert 3 owner 1; recurrent_transfer 7 from 1; fill_convert_request 4 owner 1; author_reward 7 author 1;
curation_reward 5 curator 1; comment_benefactor_reward 6 benefactor 1; vote 6 voter 1"""


def _documented() -> str:
    rows = [entry.split() for entry in DOCUMENTED.split(";")]
    values = ", ".join(f"({i}, '{n}', {k}, '{a}', {m})" for i, (n, k, a, m) in enumerate(rows))
    return "WITH " + EVENTS + f""" SELECT event_id AS op_id, name AS op_name, n::BIGINT AS n_fields,
        actor || event_id AS actor, CASE WHEN m = 1 THEN cents END AS amount
        FROM ev JOIN (VALUES {values}) d(i, name, n, actor, m) ON event_id % {len(rows)} = i"""


def all_oracles() -> dict[str, str]:
    sql = {
        "ops_range": "WITH " + EVENTS + """ SELECT event_id AS op_id, CAST(op AS BIGINT) AS op_type_id,
            block AS block_num, CASE WHEN op < 50 THEN event_id % 10 END AS trx_in_block, ts AS created,
            CASE op WHEN 18 THEN 'custom_json' WHEN 2 THEN 'transfer' END AS family FROM ev""",
        "ops_by_type": "WITH " + EVENTS + """ SELECT CAST(op AS BIGINT) AS op_type_id, count(*) AS ops,
            min(event_id) AS first_op_id, max(event_id) AS last_op_id FROM ev GROUP BY op""",
        "head_markers": "WITH " + EVENTS + """ SELECT max(block) AS head_block, max(event_id) AS head_op_id,
            max(block) - 201600 AS start_block FROM ev""",
        "first_ops_of_blocks": "WITH " + EVENTS + """ SELECT block AS block_num, min(event_id) AS first_op_id
            FROM ev GROUP BY block""",
        "typed_ops": "WITH " + EVENTS + """ SELECT event_id AS op_id,
            CASE op WHEN 1 THEN 'comment' WHEN 2 THEN 'transfer' WHEN 18 THEN 'custom_json'
              WHEN 40 THEN 'delegate_vesting_shares' WHEN 50 THEN 'fill_convert_request'
              WHEN 51 THEN 'author_reward' WHEN 52 THEN 'curation_reward'
              WHEN 63 THEN 'comment_benefactor_reward' ELSE 'vote' END AS op_name,
            CASE WHEN op IN (1, 72) THEN p
                 WHEN op = 18 THEN CASE WHEN event_id % 10 = 9 THEN 'sm_token_transfer' ELSE 'gns' END
                 ELSE u END AS actor,
            CASE WHEN op IN (1, 18) THEN NULL WHEN op = 2 THEN cents * 10
                 WHEN op = 40 THEN CASE WHEN k < 20 THEN 0 ELSE cents * 10000 END
                 ELSE cents END AS amount FROM ev""",
        "ops_with_trx": "WITH " + EVENTS + """ SELECT event_id AS op_id, block AS block_num,
            CASE WHEN op < 50 THEN md5(CAST(event_id AS VARCHAR)) END AS trx_hash FROM ev""",
        "range_split": "WITH " + EVENTS + """, b AS (SELECT min(block) AS f, max(block) AS l FROM ev),
            r AS (SELECT CASE WHEN n = 1 THEN f ELSE f + (n - 1) * 100 + 1 END AS range_first,
                         least(f + n * 100, l) AS range_last
                  FROM (SELECT f, l, unnest(range(1, greatest((l - f + 99) // 100, 1) + 1)) AS n FROM b))
            SELECT range_first, range_last, (SELECT count(*) FROM ev WHERE block BETWEEN range_first AND range_last) AS ops
            FROM r""",
        "hook_registry": "WITH " + EVENTS + "," + HOOKS + """ SELECT module, notif_name, code AS notif_code,
            CASE notif_name WHEN 'deleg' THEN 'Delegations to you' ELSE description END AS description,
            category AS module_category, CAST(hooks.op AS BIGINT) AS op_id, n AS ops
            FROM hooks LEFT JOIN (SELECT op, count(*) AS n FROM ev GROUP BY op) USING (op)""",
        "hook_dispatch": DISPATCHED + """ SELECT event_id AS op_id, hook_ord, module, notif_name,
            code AS notif_code FROM hit""",
        "hook_dispatch_disabled": DISPATCHED + """ SELECT event_id AS op_id, hook_ord, module, notif_name,
            code AS notif_code FROM hit WHERE module <> 'social'""",
        "hook_filter": DISPATCHED + """ SELECT event_id AS op_id, module, notif_name FROM hit
            WHERE (notif_name <> 'gns' OR event_id % 10 <> 9)
              AND (notif_name <> 'sm_token_transfer' OR event_id % 10 = 9)
              AND (notif_name <> 'vote' OR k = 50)""",
        "hook_filter_many": DISPATCHED + """ SELECT event_id AS op_id, module, notif_name FROM hit WHERE op = 2
            UNION ALL SELECT event_id, 'wide', 'to_' || lpad(CAST(n AS VARCHAR), 5, '0')
            FROM ev JOIN range(10000) r(n) ON u = 'u' || CAST(1000 + n AS VARCHAR)
            WHERE op = 2 AND (n % 2 = 0 OR p = 'u' || CAST(1001 + n + n % 100 AS VARCHAR))""",
        "field_filter": "WITH " + EVENTS + """ SELECT event_id AS op_id, 'id' AS kind FROM ev
            WHERE op = 18 AND event_id % 10 <> 9
            UNION ALL SELECT event_id, 'to' FROM ev WHERE op = 2 AND u = 'u1005'""",
        "module_catalog": DISPATCHED + """, e AS (SELECT module, string_agg(t, ';' ORDER BY t) AS entries FROM
            (SELECT module, category || '|' || description || '|' || module || '|' || code AS t
             FROM hooks WHERE module <> 'core') GROUP BY module)
            SELECT module, entries, matches FROM e LEFT JOIN
            (SELECT module, count(*) AS matches FROM hit GROUP BY module) USING (module)""",
        "category_catalog": DISPATCHED + """ SELECT category AS module_category, description,
            module || ':' || code AS pair, count(*) AS matches FROM hit
            WHERE module <> 'core' GROUP BY ALL""",
        "hook_options": "WITH " + STATE + """ SELECT o.name AS option_name, 'number' AS option_type,
            (SELECT count(*) FROM opt) AS times_set FROM (VALUES ('min_hbd'), ('min_hive')) o(name)""",
        "pref_ops_valid": "WITH " + STATE + """ SELECT event_id AS op_id, u AS account,
            CASE WHEN c < 6 THEN 'enabled' WHEN c < 8 THEN 'options' END AS op_name,
            c < 8 AS valid, c < 8 AS effective,
            CASE WHEN c IN (5, 7) THEN 'rejected' WHEN c < 8 THEN 'accepted' ELSE 'invalid' END AS outcome
            FROM sg""",
        "pref_history": "WITH " + STATE + """ SELECT account, module,
            array_to_string(list_sort(codes), ',') AS codes, ts AS created, block AS block_num,
            event_id AS op_id FROM pref""",
        "option_history": "WITH " + STATE + """ SELECT account, CAST(lim AS DECIMAL(10,1)) AS min_hbd,
            CAST(CAST(lim AS DECIMAL(10,1)) / 2 AS DECIMAL(10,1)) AS min_hive, ts AS created,
            block AS block_num, event_id AS op_id FROM opt""",
        "accounts_discovered": REFERENCED + " SELECT account, first_seen, first_block, first_op_id FROM found",
        "accounts_current": REFERENCED + """ SELECT account, first_seen - INTERVAL 30 DAYS AS read_all, prefs,
            CAST(lim AS DECIMAL(10,1)) AS min_hbd, prefs_updated, options_updated FROM acc""",
        "state_preload": "WITH " + STATE + """,
            own AS (SELECT account, module, arg_max(codes, event_id) AS codes FROM pref GROUP BY ALL),
            lims AS (SELECT account, module, arg_max(lim, event_id) AS lim FROM opt,
                     (VALUES ('core'), ('currency'), ('social'), ('splinterlands')) m(module) GROUP BY ALL)
            SELECT coalesce(o.account, l.account) AS account, coalesce(o.module, l.module) AS module,
                   array_to_string(list_sort(codes), ',') AS codes, l.account IS NOT NULL AS has_options,
                   CASE WHEN l.module = 'currency' THEN CAST(lim AS DECIMAL(10,1)) END AS min_hbd
            FROM own o FULL JOIN lims l ON o.account = l.account AND o.module = l.module""",
        "asof_prefs": NOTIF + """ SELECT event_id AS op_id, CAST(hook_ord AS BIGINT) AS hook_ord, account,
            gate AS gate_account, subscribed,
            CASE WHEN module = 'currency' THEN CAST(lim AS DECIMAL(10,1)) END AS min_hbd, passes FROM judged""",
        "notifications_all": f"{NOTIF} SELECT {SHOWN} FROM notif",
        "notifications_shuffled": f"{NOTIF} SELECT {SHOWN} FROM notif",
        "stream_notifications": f"{NOTIF} SELECT {SHOWN} FROM notif",
        "notifications_fixed": f"{_resolved('fixed')} SELECT {SHOWN} FROM notif",
        "notif_token_transfer": _of_code(11, TOKENS),
        "mentions_documents": """SELECT DISTINCT doc_id, name FROM (SELECT doc_id,
            unnest(regexp_extract_all(text, '@([a-zA-Z0-9-]{1,16})', 1)) AS name FROM documents)""",
        "notif_retained": f"{NOTIF} SELECT {SHOWN} FROM notif WHERE created > {AS_OF} - INTERVAL 30 DAYS",
        "blocks_retained": "WITH " + EVENTS + " SELECT DISTINCT block AS num FROM ev WHERE block > 50",
        "verification_pending": f"{TOKENS} SELECT notif_key, trx_id FROM notif WHERE hook_ord = 11",
        "verification_applied": f"""{TOKENS} SELECT notif_key, account,
            CASE op_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verified FROM notif WHERE hook_ord = 11""",
        "latest_notifications": _ranked("true", 50),
        "notifications_by_pairs": _ranked(
            "(module_name = 'currency' AND notif_code = 'trn') OR (module_name = 'social' AND notif_code = 'com')", 50),
        "notifications_by_category": _ranked("module_name = 'social'", 5),
        "transfers_filtered": _ranked(
            f"hook_ord = 4 AND created > {AS_OF} - INTERVAL 30 DAYS AND op_id % 4 = 0 "
            "AND cents * 10 BETWEEN 5000 AND 400000 AND created >= TIMESTAMP '2024-01-05 00:00:00' "
            "AND created <= TIMESTAMP '2024-01-29 00:00:00'", 50),
        "votes_filtered": _ranked(
            f"hook_ord = 10 AND created > {AS_OF} - INTERVAL 30 DAYS "
            "AND created >= TIMESTAMP '2024-01-12 00:00:00' AND created <= TIMESTAMP '2024-01-28 12:00:00'", 50),
        "token_transfers_filtered": _ranked(
            f"hook_ord = 11 AND created > {AS_OF} - INTERVAL 30 DAYS AND cents BETWEEN 500 AND 10000", 50, TOKENS),
        "unread_counts": f"""{NOTIF}, known AS (
            SELECT account FROM cand UNION SELECT gate FROM cand UNION SELECT u FROM sg WHERE c < 8)
            SELECT account, count(n.account) AS unread FROM known LEFT JOIN
            (SELECT account FROM notif WHERE created > {AS_OF} - INTERVAL 30 DAYS) n USING (account)
            GROUP BY account""",
        "preferences": REFERENCED + """ SELECT a.account, array_to_string(list_sort(m.codes), ',') AS prefs,
            a.prefs_updated FROM acc a JOIN merged m ON m.account = a.account AND m.module = 'currency'""",
        "options": REFERENCED + """ SELECT account, CAST(lim AS DECIMAL(10,1)) AS min_hbd,
            CAST(CAST(lim AS DECIMAL(10,1)) / 2 AS DECIMAL(10,1)) AS min_hive, options_updated FROM acc""",
        "enabled_pairs": REFERENCED + """ SELECT account, module || ':' || unnest(codes) AS pair FROM merged""",
        "module_progress": DISPATCHED + """ SELECT module, category AS module_category, true AS enabled,
            max(event_id) AS latest_op_id, max(block) AS latest_block_num
            FROM hit WHERE module <> 'core' GROUP BY ALL""",
        "system_status": "WITH " + EVENTS + f""" SELECT max(block) AS block_num, max(event_id) AS latest_op_id,
            arg_max(ts, event_id) AS block_time, {AS_OF} AS last_updated, true AS sync_enabled,
            false AS state_preloaded, CAST(max(block) + 1 AS DECIMAL(18,4)) AS progress,
            strftime(arg_max(ts, event_id), '%Y-%m-%dT%H:%M:%S') AS block_time_text FROM ev""",
        "health": "WITH " + EVENTS + """, h AS (SELECT max(block) AS block_num FROM ev)
            SELECT c AS "case", block_num, verdict AS health FROM h,
            (VALUES ('preloading', 'BAD - State not preloaded.'), ('behind', 'BAD - 31 blocks behind... '),
                    ('late', 'BAD - 61.0 seconds behind...'), ('good', 'GOOD')) v(c, verdict)""",
        "account_name_valid": """WITH n AS (
            SELECT DISTINCT 'u' || CAST(1000 + user_id AS VARCHAR) AS u FROM events),
            forms AS (SELECT unnest([u, u[1:3], upper(u), '1' || u, u || '.a-b', rpad(u, 17, 'x'),
                                     rpad(u, 18, 'x')]) AS name FROM n
              UNION ALL SELECT unnest(regexp_extract_all(text, '@([a-zA-Z0-9-]{1,16})', 1)) FROM documents)
            SELECT DISTINCT name, regexp_matches(name, '^[a-z][a-z0-9.-]{3,16}$') AS valid FROM forms""",
        "formatted_columns": "WITH " + EVENTS + f""" SELECT event_id,
            strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_text,
            CASE WHEN cents >= 10000 THEN '##.##%' ELSE lpad(CAST(cents // 100 AS VARCHAR), 2, '0') || '.' ||
                 lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || '%' END AS percent_text,
            {_decimal('cents', 3)} AS thousandths, {_decimal('cents', 6)} AS millionths,
            {_decimal('cents', 2)} AS value_text,
            CASE WHEN event_id % 2 = 0 THEN ts ELSE {AS_OF} - INTERVAL 30 DAYS END AS read_until FROM ev""",
    }
    preloaded = sql["state_preload"]
    ranges = sql["range_split"]
    marks = READ_MARKS + " SELECT account, pair, read_at FROM marks"
    sql |= {
        "landed_range": "WITH " + EVENTS + """ SELECT event_id AS op_id, block AS block_num, ts AS created
            FROM ev WHERE block BETWEEN 20 AND 61""",
        "range_split_late": ranges.replace("FROM ev)", "FROM ev WHERE block >= 57)", 1),
        "preload_core_off": preloaded, "state_preload_escaped": preloaded,
        "hooks_from_files": sql["hook_dispatch"],
        "notifications_written": sql["notifications_all"],
        "notifications_replayed": sql["notifications_all"],
        "accounts_stored": sql["accounts_discovered"],
        "stream_keyed_state": sql["stream_notifications"],
        "unread_counts_stored": sql["unread_counts"],
        "verification_stored": sql["verification_applied"],
        "stream_resumed": f"""{NOTIF} SELECT {SHOWN} FROM notif, (SELECT max(block) AS l FROM ev)
            WHERE block_num > l // 3 AND block_num <= l - 7""",
        "stream_retained": sql["notif_retained"],
        "verification_repeated": f"""{TOKENS} SELECT notif_key, account,
            op_id % 3 <> 1 AS verified FROM notif WHERE hook_ord = 11""",
        "rejects": "WITH " + EVENTS + """ SELECT block AS block_num, event_id AS op_id,
            'core_transfer' AS notif_name, repeat('u', 20) || u[2:] AS account, 'from or to is longer than 16' AS reason
            FROM ev WHERE op = 2 AND event_id % 7 = 3
            UNION ALL SELECT block, event_id, 'gns', u, 'malformed json' FROM ev WHERE op = 18 AND event_id % 10 = 0""",
        "custom_handler": "WITH " + EVENTS + """ SELECT block || ':' || event_id || ':8:' || p AS notif_key,
            block AS block_num, event_id AS op_id, 8::BIGINT AS hook_ord, NULL::VARCHAR AS trx_id, p AS account,
            'custom' AS module_name, 'str' AS notif_code, ts AS created, 'you voted with ' || k AS remark,
            'https://hive.blog/@' || u AS link, true AS verified FROM ev WHERE op = 72 AND k >= 90""",
        "typed_ops_documented": _documented(),
        "read_marks": marks,
        "transfers_unread_by_code": _ranked(
            f"""hook_ord = 4 AND created > coalesce((SELECT read_at FROM marks m
                WHERE m.account = notif.account AND pair = 'currency.trn'), {AS_OF} - INTERVAL 30 DAYS)""",
            50, NOTIF + READ_MARKS.replace("WITH " + EVENTS, "", 1)),
        "unread_counts_marked": f"""{NOTIF}{READ_MARKS.replace("WITH " + EVENTS, "", 1)}, known AS (
            SELECT account FROM cand UNION SELECT gate FROM cand UNION SELECT u FROM sg WHERE c < 8)
            SELECT account, count(n.account) AS unread FROM known LEFT JOIN
            (SELECT n.account FROM notif n LEFT JOIN marks m ON m.account = n.account AND m.pair = 'all'
             WHERE created > coalesce(m.read_at, {AS_OF} - INTERVAL 30 DAYS)) n USING (account)
            GROUP BY account""",
        "preferences_module_absent": REFERENCED + " SELECT account, NULL::VARCHAR AS prefs, prefs AS all_prefs FROM acc",
    }
    sql["rejects_replayed"] = sql["rejects"]
    sql["landed_heads"] = "WITH " + EVENTS + """, l AS (SELECT max(block) AS last, max(block) // 4 + 1 AS size FROM ev),
        ends AS (SELECT unnest(range(0, last + 1, size)) AS first_block, size, last FROM l),
        ranges AS (SELECT first_block, least(first_block + size - 1, last) AS last_block FROM ends
            UNION ALL SELECT 0, last FROM l)
        SELECT first_block, last_block, count(*) AS ops, max(event_id) AS head_op_id,
            arg_max(ts, event_id) AS block_time
        FROM ranges JOIN ev ON block BETWEEN first_block AND last_block GROUP BY first_block, last_block"""
    sql["ops_with_trx_colocated"] = sql["ops_with_trx"] + " WHERE block BETWEEN 20 AND 61"
    sql["notifications_colocated"] = sql["notifications_all"]
    sql["notifications_shredded"] = sql["notifications_all"]
    sql["typed_ops_shredded"] = sql["typed_ops_documented"]
    sql["handler_sql_file"] = sql["custom_handler"]
    sql["handler_sql_function"] = "WITH " + EVENTS + """, ends AS (
        SELECT *, p AS account, 'given to ' || u AS remark FROM ev WHERE op = 72 AND k >= 90
        UNION ALL SELECT *, u, 'got from ' || p FROM ev WHERE op = 72 AND k >= 90)
        SELECT block || ':' || event_id || ':8:' || account AS notif_key, block AS block_num, event_id AS op_id,
            8::BIGINT AS hook_ord, NULL::VARCHAR AS trx_id, account, 'custom' AS module_name, 'str' AS notif_code,
            ts AS created, remark, k::VARCHAR AS link, true AS verified FROM ends
        WHERE account IN (SELECT u FROM ev)"""
    hook_of = {
        "notif_transfer": 4, "notif_delegation": 6, "notif_author_reward": 2,
        "notif_benefactor_reward": 3, "notif_curation_reward": 5, "notif_convert": 7,
        "notif_vote": 10, "notif_comment": 8, "notif_mention": 9,
    }
    return sql | {name: _of_code(hook_ord) for name, hook_ord in hook_of.items()}
