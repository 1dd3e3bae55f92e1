"""Rules and parameters of the registered queries."""

MAX_BYTES = 50_000

# sink, facility_spec, include_malformed, write_text, write_jsonl, max_bytes, max_files
ROUTES = [
    ("main", "*", True, True, True, MAX_BYTES, 10),
    ("auth", "auth, AuthPriv,security", False, True, True, MAX_BYTES, 5),
    ("mail", "mail", True, True, False, 10_000, 3),
    ("jobs", "Cron,clock2", True, False, True, 20_000, 0),
    ("bulk", "local0,local1,local2,local3", False, True, True, None, 10),
    ("clean", None, False, False, True, 100_000, 2),
]

# target, enabled, facility_spec, max_message_size
FORWARD_RULES = [
    ("archive", True, "*", 0),
    ("siem", True, "auth,authpriv,audit", 80),
    ("pager", True, "kern,local7", 12),
    ("off", False, "*", 0),
]

PAGE_AT = 100_000
PAGE_SINCE = 50_000
POSITIONS = (0, 1, 49_999, 50_200, 100_000, 123_456, 10**12)

CONSOLE_INCLUDE = ("Purchase", "signup", "text 1")
CONSOLE_EXCLUDE = ("value=3", 'K": 7')

#: Bytes of log in a data file of the queried stores, so that pages and searches have several to choose from.
STORE_FILE_BYTES = 1 << 20
RARE = "PLAIN text 9998"
POLLED = "auth"
