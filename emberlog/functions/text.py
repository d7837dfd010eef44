"""Text helpers for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TITLE_CHARS = 160
EXAMPLE_BYTES = 2048
ELLIPSIS = "…"
NO_TIME = "—"
MASK = "***"
HTML_ENTITIES = (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"))
# Unicode white space
SPACES = "\t\n\u000b\u000c\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_line(text: Column | str) -> Column:
    """First line without outer white space; over 160 bytes it is cut to 160
    characters and an ellipsis is added, even where no character was cut."""
    line = F.btrim(F.substring_index(_col(text), "\n", 1), F.lit(SPACES))
    return F.when(
        F.octet_length(line) > TITLE_CHARS, F.concat(F.left(line, F.lit(TITLE_CHARS)), F.lit(ELLIPSIS))
    ).otherwise(line)


def truncate_example(text: Column | str, limit: int = EXAMPLE_BYTES) -> Column:
    """Text of at most ``limit`` bytes, the ellipsis included, cut between
    characters: a cut falls inside a character where the next byte continues
    one (hex 80 to BF), and a character has at most four bytes."""
    text = _col(text)
    room = limit - len(ELLIPSIS.encode())
    raw = F.encode(text, "UTF-8")

    def splits_a_character(at: int) -> Column:
        return F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")

    size = F.lit(room - 3)
    for at in (room - 2, room - 1, room):
        size = F.when(~splits_a_character(at), at).otherwise(size)
    head = F.decode(raw.substr(F.lit(1), size), "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(head, F.lit(ELLIPSIS)))


def html_escape(text: Column | str) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), HTML_ENTITIES, _col(text))


def mask_secrets(text: Column | str, secrets) -> Column:
    """Replace every secret by ``***``, in the order given; blanks are ignored."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(MASK)), [s for s in secrets if s], _col(text))


def _zoned(t: Column | str, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(t))


def fmt_time(t: Column | str, tz: str = "UTC") -> Column:
    """``2026-04-22 08:00:00`` in the report zone; a dash for a missing time."""
    return F.coalesce(F.date_format(_zoned(t, tz), "yyyy-MM-dd HH:mm:ss"), F.lit(NO_TIME))


def fmt_time_short(t: Column | str, tz: str = "UTC") -> Column:
    """``22.04.2026 08:00`` in the report zone."""
    return F.coalesce(F.date_format(_zoned(t, tz), "dd.MM.yyyy HH:mm"), F.lit(NO_TIME))


def report_date(window_to: Column | str, tz: str = "UTC") -> Column:
    return F.date_format(_zoned(window_to, tz), "yyyy-MM-dd")


def report_file(host: Column | str, window_to: Column | str, tz: str = "UTC", ext: str = "md") -> Column:
    return F.concat(_col(host), F.lit("_"), report_date(window_to, tz), F.lit(f".{ext}"))
