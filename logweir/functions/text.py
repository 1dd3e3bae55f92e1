"""Byte and text columns: payload views, UTF-8 repair, nullable tokens."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# One well-formed multi-byte UTF-8 sequence, written over the ISO-8859-1 view (1 char = 1 byte).
_UTF8_2 = r"[\xC2-\xDF][\x80-\xBF]"
_UTF8_3 = (
    r"(?:\xE0[\xA0-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]|\xED[\x80-\x9F])[\x80-\xBF]"
)
_UTF8_4 = r"(?:\xF0[\x90-\xBF]|[\xF1-\xF3][\x80-\xBF]|\xF4[\x80-\x8F])[\x80-\xBF]{2}"

# UTF-8 is self-synchronising, so a byte is bad exactly when no well-formed sequence starts at it
# or up to three bytes before it and covers it. Look-arounds only: constant work per byte.
_BAD_BYTE = (
    rf"(?!{_UTF8_2}|{_UTF8_3}|{_UTF8_4})"
    rf"(?<!(?={_UTF8_2}|{_UTF8_3}|{_UTF8_4})[\s\S])"
    rf"(?<!(?={_UTF8_3}|{_UTF8_4})[\s\S]{{2}})"
    rf"(?<!(?={_UTF8_4})[\s\S]{{3}})"
    r"[\x80-\xFF]"
)

_REPLACEMENT_BYTES = "ï¿½"  # U+FFFD in UTF-8, as ISO-8859-1 characters


def byte_view(data: Column) -> Column:
    """Binary as a string in which every character is one byte."""
    return F.decode(data, "ISO-8859-1")


def view_bytes(view: Column) -> Column:
    """Inverse of :func:`byte_view`."""
    return F.encode(view, "ISO-8859-1")


def is_utf8(data: Column) -> Column:
    """True where the binary is well-formed UTF-8 as a whole."""
    return F.is_valid_utf8(data.cast("string"))


def strip_eol(view: Column) -> Column:
    """Text without its trailing CR and LF characters; embedded ones stay."""
    return F.rtrim(view, F.lit("\r\n"))


def repair_view(view: Column) -> Column:
    """Byte view to text, every byte outside a well-formed sequence becoming U+FFFD."""
    repaired = F.regexp_replace(view, _BAD_BYTE, _REPLACEMENT_BYTES)
    return view_bytes(repaired).cast("string")


def sanitize_utf8(data: Column) -> Column:
    """Binary to valid text with one U+FFFD per bad byte; well-formed input takes the short way."""
    return F.when(is_utf8(data), data.cast("string")).otherwise(repair_view(byte_view(data)))


def nilable(token: Column) -> Column:
    """Header token whose "-" means null; an empty token stays empty."""
    return F.when(token != "-", token)


def rcv_iso(rcv: Column) -> Column:
    """Receive time as UTC ISO text in whole seconds (the session time zone must be UTC)."""
    return F.date_format(rcv, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def octets(text: Column) -> Column:
    """Stored size in bytes of a line, newline included."""
    return (F.octet_length(text) + F.lit(1)).cast("long")
