"""Links into a log explorer and the selector texts they carry."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass
from urllib.parse import parse_qsl, quote_plus, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.windows import Window

# Characters that JSON inside the link escapes.
JSON_ESCAPES = (
    ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class LinkTarget:
    """Explorer address and data source of the links."""

    base_url: str
    org_id: int
    source_uid: str
    source_type: str

    def __post_init__(self):
        problems = []
        parts = urlsplit(self.base_url.strip())
        if not self.base_url.strip():
            problems.append("base_url is empty")
        elif not parts.scheme or not parts.netloc:
            problems.append(f"base_url {self.base_url!r} is not a URL")
        if self.org_id < 1:
            problems.append(f"org_id {self.org_id} must be at least 1")
        if not self.source_uid.strip():
            problems.append("source_uid is empty")
        if not self.source_type.strip():
            problems.append("source_type is empty")
        if problems:
            raise ValueError("; ".join(problems))


def url_query_escape(text: Column | str) -> Column:
    """Form encoding: space as ``+``, ``*`` encoded, ``~`` kept."""
    return F.replace(F.replace(F.url_encode(_col(text)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def explore_link(target: LinkTarget, expr: Column, start: Column, end: Column) -> Column:
    """Link that opens ``expr`` over a time range; null for a blank expression
    or a range without length."""
    source = F.struct(F.lit(target.source_uid).alias("uid"), F.lit(target.source_type).alias("type"))
    query = F.struct(F.lit("A").alias("refId"), source.alias("datasource"), expr.alias("expr"))

    def millis(t: Column) -> Column:
        return F.unix_millis(t.cast("timestamp")).cast("string")

    pane = F.struct(
        F.lit(target.source_uid).alias("datasource"),
        F.array(query).alias("queries"),
        F.struct(millis(start).alias("from"), millis(end).alias("to")).alias("range"),
    )
    panes = F.to_json(F.struct(pane.alias("a")))
    for char, escaped in JSON_ESCAPES:
        panes = F.replace(panes, F.lit(char), F.lit(escaped))

    parts = urlsplit(target.base_url.strip())
    path = posixpath.normpath(posixpath.join("/", parts.path.lstrip("/"), "explore"))
    # parameters of the base address stay; all are sorted by name
    fixed = [(k, v) for k, v in parse_qsl(parts.query) if k not in ("orgId", "panes", "schemaVersion")]
    fixed += [("orgId", str(target.org_id)), ("schemaVersion", "1")]
    before = "".join(f"{quote_plus(k)}={quote_plus(v)}&" for k, v in sorted(fixed) if k < "panes")
    after = "".join(f"&{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(fixed) if k > "panes")
    head = f"{parts.scheme}://{parts.netloc}{path}?{before}panes="
    return F.when(
        (F.btrim(expr) != "") & (start < end),
        F.concat(F.lit(head), url_query_escape(panes), F.lit(after)),
    )


def _levels_clause(levels) -> str:
    names = ["level:=" + lv.strip() for lv in levels if lv.strip()]
    if len(names) > 1:
        return " (" + " OR ".join(names) + ")"
    return "".join(" " + n for n in names)


# Short escapes of control characters in a quoted text.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
_PRINTABLE = r"\p{L}\p{M}\p{N}\p{P}\p{S} "


def _escaped(c: Column) -> Column:
    code, out = F.ascii(c), F.when(F.lit(False), c)
    for raw, short in _ESCAPES.items():
        out = out.when(c == raw, F.lit(short))
    return (
        out.when(c.rlike(f"^[{_PRINTABLE}]$"), c)
        .when(code < 0x80, F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(code)), 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(F.lower(F.hex(code)), 8, "0")))
    )


def _quoted(text: Column) -> Column:
    """Text in double quotes; quotes, backslashes and what cannot be printed
    are escaped. Texts without the latter take the short way."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = F.array_join(F.transform(F.split(text, ""), _escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike(f"[^{_PRINTABLE}]"), full).otherwise(plain), F.lit('"'))


def host_expr(host: Column | str, levels=()) -> Column:
    """``{host="x"} (level:=a OR level:=b)``"""
    return F.concat(F.lit("{host="), _quoted(_col(host)), F.lit("}" + _levels_clause(levels)))


def all_hosts_expr(hosts, levels=()) -> str:
    """``{host=~"x|y"} (level:=a OR level:=b)``"""
    return ('{host=~"' + "|".join(hosts) + '"}' if hosts else "{}") + _levels_clause(levels)


def incident_expr(host="host", level="level", app="app") -> Column:
    """Selector of one incident's records; an empty app is left out."""
    level, app = F.btrim(_col(level)), _col(app)
    return F.concat(
        host_expr(host),
        F.when(level != "", F.concat(F.lit(" level:="), level)).otherwise(""),
        F.when(app != "", F.concat(F.lit(" app:="), _quoted(app))).otherwise(""),
    )


def link_range(window: Window, first_seen="first_seen", last_seen="last_seen") -> tuple[Column, Column]:
    """One minute around the incident, kept inside the window; the window
    itself where nothing is left."""
    lo, hi = window.bounds
    minute = F.expr("INTERVAL 1 MINUTE")
    start = F.greatest(_col(first_seen) - minute, lo)
    end = F.least(_col(last_seen) + minute, hi)
    usable = start < end
    return F.when(usable, start).otherwise(lo), F.when(usable, end).otherwise(hi)
