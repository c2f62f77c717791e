"""Fixed values shared by the whole package.

Fixed values: the codes, texts, patterns and limits below must be equal to those
users of the alert rules already know, so they are stated here once, as text.
"""

# Assets: id -> (currency printed in remarks, divisor of the raw integer amount).
ASSETS = {
    "@@000000013": ("HBD", 1_000),
    "@@000000021": ("HIVE", 1_000),
    "@@000000037": ("HP", 1_000_000),
}
ASSET_IDS = {currency: asset for asset, (currency, _) in ASSETS.items()}
HBD = "@@000000013"

# Preferences an account has until it names a module itself.
DEFAULT_PREFS = {"social": ["vot", "men"], "currency": ["trn"]}
ALL_CODES = "*"

# custom_json ids
PREFERENCE_ID = "gns"
TOKEN_TRANSFER_ID = "sm_token_transfer"

# Function of the hook that takes preference operations; it sends nothing.
PREFERENCE_FUNCTION = "core_gns"

# Operation types the rules look at.
OP_COMMENT = 1
OP_TRANSFER = 2
OP_CUSTOM_JSON = 18
OP_DELEGATION = 40
OP_CONVERSION = 50
OP_AUTHOR_REWARD = 51
OP_CURATION_REWARD = 52
OP_BENEFACTOR_REWARD = 63
OP_VOTE = 72

LINK_BASE = "https://hive.blog/"
MENTION_PATTERN = "@([a-zA-Z0-9-]{1,16})"
ACCOUNT_PATTERN = "^[a-z][a-z0-9-.]{3,16}$"
MODULE_PATTERN = "^[a-z]+[_]*$"

# Declared lengths: a longer value is an error.
MAX_ACCOUNT = 16
MAX_TEXT = 500
MAX_MEMO = 2048
MAX_ASSET = 11

# Operating constants.
MAX_LIMIT = 50
RETENTION_DAYS = 30
BLOCKS_PER_DAY = 20 * 60 * 24
START_DISTANCE_BLOCKS = 7 * BLOCKS_PER_DAY
BLOCK_RETENTION = 30 * BLOCKS_PER_DAY
SYNC_BLOCKS = 1_000
HEALTH_MAX_BLOCKS = 30
HEALTH_MAX_SECONDS = 60
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

# The rules: one entry per module, one hook per notification.
RULES = {
    "core": {
        "enabled": True,
        "module_category": "GNS",
        "gns": {
            "op_id": 18,
            "description": "GNS Core Operations",
            "function": "core_gns",
            "notif_code": "gns",
            "filter": "",
            "options": {},
        },
    },
    "currency": {
        "enabled": True,
        "module_category": "Currency",
        "core_transfer": {
            "op_id": 2,
            "description": "Hive/HBD transfers",
            "function": "core_transfer",
            "notif_code": "trn",
            "filter": "",
            "options": {"min_hbd": "number", "min_hive": "number"},
        },
        "deleg": {
            "op_id": 40,
            "description": "Delegations",
            "function": "core_deleg",
            "notif_code": "del",
            "filter": "",
            "options": {},
        },
        "author_reward": {
            "op_id": 51,
            "description": "Author rewards",
            "function": "core_author_reward",
            "notif_code": "arw",
            "filter": "",
            "options": {},
        },
        "curation_reward": {
            "op_id": 52,
            "description": "Curation rewards",
            "function": "core_curation_reward",
            "notif_code": "crw",
            "filter": "",
            "options": {},
        },
        "comment_benefactor_reward": {
            "op_id": 63,
            "description": "Comment benefactor rewards",
            "function": "core_comment_benefactor_reward",
            "notif_code": "brw",
            "filter": "",
            "options": {},
        },
        "fill_convert_request": {
            "op_id": 50,
            "description": "Fill convert requests",
            "function": "core_fill_convert_request",
            "notif_code": "fcr",
            "filter": "",
            "options": {},
        },
    },
    "social": {
        "enabled": True,
        "module_category": "Social",
        "vote": {
            "op_id": 72,
            "description": "Vote on post or comment",
            "function": "core_vote",
            "notif_code": "vot",
            "filter": "",
            "options": {},
        },
        "comment": {
            "op_id": 1,
            "description": "Comment on post",
            "function": "core_comment",
            "notif_code": "com",
            "filter": "",
            "options": {},
        },
        "mention": {
            "op_id": 1,
            "description": "Mention in post or comment",
            "function": "core_mention",
            "notif_code": "men",
            "filter": "",
            "options": {},
        },
    },
    "splinterlands": {
        "enabled": True,
        "module_category": "Splinterlands",
        "sm_token_transfer": {
            "op_id": 18,
            "description": "DEC transfers",
            "function": "sm_token_transfer",
            "notif_code": "trn",
            "filter": "",
            "options": {},
        },
    },
}
