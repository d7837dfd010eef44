"""Message normalisation: an ordered list of regex rules as one Column.

Profiles are written in RE2 syntax. Java's engine differs in a few places, so
each pattern is translated once, when the expression is built:

* ``\\b`` and ``\\B`` are ASCII-only in RE2 but Unicode-aware in Java;
* ``\\s`` excludes the vertical tab in RE2;
* ``.`` stops only at ``\\n`` and ``$`` matches only at the end of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``needs`` lists texts that every match contains; where a message lacks
    one of them the regex is skipped. It changes cost only, never the result."""

    name: str
    pattern: str
    replace: str
    needs: tuple[str, ...] = ()


# The default profile. Order matters.
DEFAULT_PROFILE = (
    Rule("ts_iso8601", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})?", "<ts>", ("-", ":")),
    Rule("ts_ru", r"\d{2}\.\d{2}\.\d{4}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s*[+\-]\d{2}:\d{2})?", "<ts>", (".", ":")),
    Rule("uuid", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>", ("-",)),
    Rule("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<ip>", (".",)),
    Rule("hex16plus", r"\b[0-9a-fA-F]{16,}\b", "<hex>"),
    Rule("numbers", r"\b\d+(?:\.\d+)?\b", "<N>"),
)

# Wider profile for texts with mail addresses, paths, short hex tokens and
# order numbers. Levels and service names stay as they are.
EXTENDED_PROFILE = (
    DEFAULT_PROFILE[0],
    DEFAULT_PROFILE[1],
    Rule("unix_millis", r"\b1\d{12}\b", "<ts>"),
    DEFAULT_PROFILE[2],
    Rule("email", r"[0-9A-Za-z._%+\-]+@[0-9A-Za-z\-]+(?:\.[0-9A-Za-z\-]+)+", "<email>", ("@",)),
    Rule("ipv6_port", r"\[[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}\]:\d+", "[<ipv6>]:<port>", ("]:",)),
    Rule("ipv6", r"\b[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}\b|\b(?:[0-9a-fA-F]{1,4}:)+(?::[0-9a-fA-F]{1,4})+\b", "<ipv6>"),
    Rule("ipv4_port", r"\b(?:\d{1,3}\.){3}\d{1,3}:\d+\b", "<ip>:<port>", (".", ":")),
    Rule("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>", (".",)),
    Rule("business_id", r"(?i)\b(trade|order|deal)(_id=|[ _#\-]+)(?:[A-Za-z]+-)?\d+(?:-[0-9A-Za-z]+)*", "${1}${2}<id>"),
    Rule("path", r"(?:/[0-9A-Za-z._\-]+){2,}", "<path>", ("/",)),
    Rule("hex8plus", r"\b[0-9a-fA-F]{8,}\b", "<hex>"),
    Rule("numbers", r"\b\d+(?:\.\d+)?", "<num>"),
    Rule("trailing_space", r"\s+$", ""),
)

_WORD = r"\w"  # ASCII-only in Java unless UNICODE_CHARACTER_CLASS is set
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_EDGE = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_TOKEN = re.compile(
    r"\\.|\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\]|\(\?(?:P<|<[=!]|[=!])|.", re.DOTALL
)
# Where a digit or hex class stands inside a \b, only the outer side of the
# edge needs a check, which is much cheaper.
_DIGIT = r"(?:\\d|\[0-9a-fA-F\])"
_REPEAT = r"(?:\+|\{[1-9]\d*(?:,\d*)?\})?"
_GROUP = r"(?:\(\?:(?=[^()|]*\)))?"
_OPENING = re.compile(rf"\\b(?={_GROUP}{_DIGIT}(?:[^*?{{]|\{{[1-9]|$))")
_CLOSING = re.compile(rf"{_DIGIT}{_REPEAT}(?:\(\?:[^()|]*{_DIGIT}{_REPEAT}\)\?)?(\\b)")


def java_pattern(pattern: str) -> str:
    """RE2 pattern -> Java pattern with the same matches."""
    if not pattern.strip():
        raise ValueError("empty pattern")
    opening = {m.start() for m in _OPENING.finditer(pattern)}
    closing = {m.start(1) for m in _CLOSING.finditer(pattern)}
    multiline = bool(re.match(r"\(\?[a-z]*m[a-z]*\)", pattern))
    out = []
    for m in _TOKEN.finditer(pattern):
        tok = m.group()
        if tok == r"\b":
            at = m.start()
            tok = f"(?<!{_WORD})" if at in opening else f"(?!{_WORD})" if at in closing else _EDGE
        elif tok == r"\B":
            tok = _NO_EDGE
        elif tok == r"\s":
            tok = r"[\t\n\f\r ]"
        elif tok == r"\S":
            tok = r"[^\t\n\f\r ]"
        elif tok == "[0-9a-fA-F]":
            tok = r"\p{XDigit}"
        elif tok == "$" and not multiline:
            tok = r"\z"
        elif tok.startswith("(?P"):
            tok = "(?" + tok[3:]
        elif tok.startswith(("(?=", "(?!", "(?<=", "(?<!")) or re.fullmatch(r"\\[1-9]", tok):
            raise ValueError(f"look-around and back-references are not allowed: {pattern!r}")
        elif tok.startswith("[") and len(tok) > 1:
            tok = _java_class(tok)
        out.append(tok)
    java = "".join(out)
    # Python's engine checks the syntax; it lacks \z, \p{..} and (?<name>
    check = re.sub(r"\\[pP](?:\{\w+\}|\w)", r"\\w", java.replace(r"\z", r"\Z"))
    try:
        re.compile(re.sub(r"\(\?<(?=\w)", "(?P<", check))
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e
    return "(?d)" + java


def _java_class(tok: str) -> str:
    body = re.sub(r"\[:(\^?)(\w+):\]", lambda m: ("\\P{" if m[1] else "\\p{") + m[2].capitalize() + "}", tok[1:-1])
    # '[' and '&&' have a special meaning only in Java's classes
    body = re.sub(r"\\.|\[|&&", lambda m: {r"\s": r"\t\n\f\r ", "[": r"\[", "&&": r"&\&"}.get(m[0], m[0]), body)
    return f"[{body}]"


def java_replacement(text: str, groups: int = 0, names: frozenset[str] = frozenset()) -> str:
    """``$1`` / ``${1}`` templates -> Java replacement text.

    A name is the longest run of word characters, so ``$1_x`` names the
    group "1_x"; names without a group give ''. ``$$`` is a dollar sign.
    """

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[3]
        if name is None:
            return "\\" + m[0]
        digit = "\\" + m[2] if m[2] else ""  # must not join the group number
        if name.isdigit():
            return (f"${name}" if int(name) <= groups else "") + digit
        return ("${%s}" % name if name in names else "") + digit

    return re.sub(r"\$\$|\$\{(\w+)\}(\d?)|\$(\w+)|[\\$]", one, text)


def compile_profile(rules) -> list[tuple[str, str, tuple[str, ...]]]:
    """Check the rules and translate them; order is kept.

    ``rules`` holds ``Rule`` objects, (name, pattern, replace) tuples or
    mappings with those keys, as read from a configuration file.
    """
    out = []
    for i, r in enumerate(rules):
        rule = r if isinstance(r, Rule) else Rule(**r) if isinstance(r, dict) else Rule(*r)
        try:
            java = java_pattern(rule.pattern)
            names = frozenset(re.findall(r"\(\?P?<(\w+)>", rule.pattern))
            groups = len(names) + len(re.findall(r"(?<!\\)\((?!\?)", rule.pattern))
            out.append((java, java_replacement(rule.replace, groups, names), rule.needs))
        except ValueError as e:
            raise ValueError(f"profile entry {rule.name!r}, number {i + 1}: {e}") from e
    return out


def normalize(msg: Column | str, profile=DEFAULT_PROFILE) -> Column:
    """Template of a message. An empty profile changes nothing.

    Each rule is applied to the bound variable of a one-element ``transform``.
    That way a rule can look at its input before it decodes it for the regex
    engine, while the whole stays one expression whose size is linear in the
    number of rules, also when a filter on it is pushed down.
    """
    text = F.array(F.col(msg) if isinstance(msg, str) else msg)
    for rule in compile_profile(profile):
        text = F.transform(text, _step(*rule))
    return F.element_at(text, 1)


def _step(pattern: str, replacement: str, needs: tuple[str, ...]):
    def apply(t: Column) -> Column:
        replaced = F.regexp_replace(t, F.lit(pattern), F.lit(replacement))
        if not needs:
            return replaced
        return F.when(reduce(Column.__and__, [t.contains(n) for n in needs]), replaced).otherwise(t)

    return apply
