"""Fixed values of the syslog record: names, codes, field orders and patterns.

Everything in this module must equal the published formats exactly; nothing here is computed.
"""

# Severity names by code 0-7.
SEVERITY_NAMES = (
    "EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG",
)

# Short severity spellings by code 0-7, as log viewers print them.
SEVERITY_SHORT_NAMES = (
    "EMERG", "ALERT", "CRIT", "ERR", "WARN", "NOTICE", "INFO", "DEBUG",
)

# Facility names a parsed record carries, by code 0-23.
FACILITY_NAMES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news",
    "uucp", "clock", "authpriv", "ftp", "ntp", "audit", "alert", "cron",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)

# Facility labels used when a record stores the numeric code; only code 15 differs.
FACILITY_LABELS = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news",
    "uucp", "clock", "authpriv", "ftp", "ntp", "audit", "alert", "clock2",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)

# Facility names accepted in a routing rule. "cron" routes code 9 and "clock2" code 15,
# although a parsed record with code 15 is *named* "cron".
FACILITY_CODES = {
    "kern": 0, "kernel": 0, "user": 1, "mail": 2, "daemon": 3, "system": 3,
    "auth": 4, "security": 4, "syslog": 5, "lpr": 6, "news": 7, "uucp": 8,
    "clock": 9, "cron": 9, "authpriv": 10, "ftp": 11, "ntp": 12, "audit": 13,
    "logaudit": 13, "alert": 14, "logalert": 14, "clock2": 15,
    "local0": 16, "local1": 17, "local2": 18, "local3": 19,
    "local4": 20, "local5": 21, "local6": 22, "local7": 23,
}

MAX_PRI = 191

# Month abbreviations of an RFC 3164 timestamp, case-sensitive.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Record fields in JSONL order.
RECORD_FIELDS = (
    "rcv", "src", "proto", "facility", "severity", "hostname", "app", "pid", "msgid",
    "msg_time", "message",
)

# (field, label) of the one-record detail view.
DETAIL_LABELS = (
    ("rcv", "Rcv Time"), ("src", "Source"), ("proto", "Proto"), ("facility", "Facility"),
    ("severity", "Severity"), ("hostname", "Hostname"), ("app", "App"), ("pid", "PID"),
    ("msgid", "Msg ID"), ("msg_time", "Msg Time"), ("message", "Message"),
)

# Columns of the grid view and those hidden by default.
GRID_COLUMNS = ("time", "rcv", "src", "hostname", "app", "pid", "sev", "proto", "msgid", "message")
GRID_HIDDEN = ("rcv", "hostname", "pid", "proto", "msgid")

# Columns of a formatted console line.
LINE_COLUMNS = ("rcv", "facility", "severity", "hostname", "app", "pid", "message")

# Page sizes: web page, console tail, rows kept in a live view, new lines per poll.
PAGE_LINES = 200
TAIL_LINES = 10
LIVE_ROWS = 2000
POLL_LINES = 200
