"""Small independent models the Spark operators are compared with: whole-message regular
expressions for the parser, a codec error handler for UTF-8 repair, plain loops for the rest."""

import codecs
import json
import re

from logweir.functions import fixed

_PRI = r"<([0-9]{1,2}|1[0-8][0-9]|19[01]|0[0-9]{2})>"
_R5 = re.compile(
    r"\A" + _PRI + r"0?1 ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*)(?:( )([\s\S]*))?\Z"
)
_R3 = re.compile(
    r"\A" + _PRI + r"((?:" + "|".join(fixed.MONTHS) + r") +(?:0?[1-9]|[12][0-9]|3[01]) +"
    r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]) ?([^ ]*)(?:( )([\s\S]*))?\Z"
)
_BOX = re.compile(r"\A([^\[]*)\[([\s\S]*)\]\Z")

codecs.register_error("one-per-byte", lambda e: ("�", e.start + 1))


def repair(data: bytes) -> str:
    return data.decode("utf-8", errors="one-per-byte")


def parse(payload: bytes) -> dict:
    raw = payload.rstrip(b"\r\n")
    view = raw.decode("latin-1")
    out = dict.fromkeys(
        ("pri", "version", "hostname", "app", "pid", "msgid", "msg_time"), None
    )
    nil = lambda t: None if t == "-" else t
    if m := _R5.match(view):
        pri, ts, host, app, pid, msgid, sp, rest = m.groups()
        out |= dict(proto="RFC5424", pri=int(pri), version=1, msg_time=nil(ts), hostname=nil(host),
                    app=nil(app), pid=nil(pid), msgid=nil(msgid), message=rest or "")
        if msgid == "" and not sp:
            out["msgid"] = None
    elif m := _R3.match(view):
        pri, ts, host, sp, rest = m.groups()
        rest = rest or ""
        if ":" in rest:
            tag, text = rest.split(":", 1)
            text = text[1:] if text.startswith(" ") else text
        else:
            tag, _, text = rest.partition(" ")
        box = _BOX.match(tag)
        app, pid = box.groups() if box else (tag.rstrip(" "), "")
        out |= dict(proto="RFC3164", pri=int(pri), msg_time=ts, app=app or None, pid=pid or None,
                    hostname=None if host == "" and not sp else host, message=text)
    else:
        out |= dict(proto="UNKNOWN", message=view)
    for key in ("hostname", "app", "pid", "msgid", "msg_time", "message"):
        if out[key] is not None:
            out[key] = repair(out[key].encode("latin-1"))
    return out | {"raw": raw}


def greedy(sizes, limit, text=0, json_=0, generation=0):
    out = []
    for t, j in sizes:
        if text >= limit or json_ >= limit:
            generation, text, json_ = generation + 1, 0, 0
        out.append(generation)
        text, json_ = text + t, json_ + j
    return out


def record(message, severity="INFO", facility="daemon", **extra):
    return json.dumps(
        {"severity": severity, "facility": facility, "message": message, **extra},
        separators=(",", ":"), ensure_ascii=False,
    )
