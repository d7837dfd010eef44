import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.functions.fingerprint import fingerprint, level_rank, short_fingerprint
from emberlog.functions.normalize import (
    DEFAULT_PROFILE, EXTENDED_PROFILE, Rule, compile_profile, java_pattern, java_replacement, normalize,
)


def apply(spark, texts, profile=DEFAULT_PROFILE):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, msg string")
    out = rows.select("i", normalize("msg", profile).alias("n")).orderBy("i").collect()
    return [r["n"] for r in out]


def re2(texts, rules):
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"i": range(len(texts)), "s": texts}))
    col = "s"
    for pattern, repl in rules:
        q = pattern.replace("'", "''")
        col = f"regexp_replace({col}, '{q}', '{repl}', 'g')"
    return [r[0] for r in con.execute(f"SELECT {col} FROM t ORDER BY i").fetchall()]


CASES = {
    "31.12.2025 23:59:59.000001 +03:00 | W | unit:a_t7-2:10 | сбой": "<ts> | W | unit:a_t7-<N>:<N> | сбой",
    "begin 2025-01-02T03:04:05Z end 2025-01-02 03:04:06.7+0300": "begin <ts> end <ts>",
    "id 123E4567-e89b-12d3-A456-426614174000.": "id <uuid>.",
    "dial 192.168.0.17:443 and 8.8.8.8": "dial <ip> and <ip>",
    "token deadbeefdeadbeef00 short deadbeef": "token <hex> short deadbeef",
    "took 17 of 3.25 units": "took <N> of <N> units",
    "12ms t5 1.5a": "12ms t5 <N>.5a",
    "ошибка5 é7 x8": "ошибка<N> é<N> x8",
    "": "",
    "no digits here": "no digits here",
}


def test_default_cases(spark):
    assert apply(spark, list(CASES)) == list(CASES.values())


EXTENDED = {
    "REQ 550E8400-E29B-41D4-A716-446655440000": "REQ <uuid>",
    "refused by 172.16.0.9": "refused by <ip>",
    "172.16.0.9:8443": "<ip>:<port>",
    "[fe80::1]:443": "[<ipv6>]:<port>",
    "2001:db8:0:0:0:0:0:1 is up": "<ipv6> is up",
    "ts=1745298000000": "ts=<ts>",
    "req=a3f9c1e2": "req=<hex>",
    "trade #12345": "trade #<id>",
    "order_id=ABC-1234-DEF": "order_id=<id>",
    "retry=42": "retry=<num>",
    "latency=12.34ms": "latency=<num>ms",
    "file:/var/log/t5/app.log:42": "file:<path>:<num>",
    "mail ops@example.org now": "mail <email> now",
    "level=error": "level=error",
    "service=order-svc": "service=order-svc",
    "spaces at the end  \t": "spaces at the end",
}


def test_extended_cases(spark):
    assert apply(spark, list(EXTENDED), EXTENDED_PROFILE) == list(EXTENDED.values())


def random_texts(n, seed=7):
    rnd = random.Random(seed)
    atoms = ["2025-01-02T03:04:05", "2025-01-02 03:04:05.123", "Z", "+03:00", "-0500", "01.02.2025", " 10:11:12",
             ".55", "10.0.0.1", ":80", "a1b2c3d4e5f60718", "550e8400-e29b-41d4-a716-446655440000", "7", "42", "3.14",
             " ", "\t", "\v", "\n", "é", "я", "_", "-", ".", ":", "x", "A", "f", "0", " ", " ", "٣", "９"]
    return ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_same_as_re2_on_random_texts(spark):
    texts = random_texts(4000)
    assert apply(spark, texts) == re2(texts, [(r.pattern, r.replace) for r in DEFAULT_PROFILE])


def test_idempotent(spark):
    once = apply(spark, random_texts(4000, 11) + list(CASES))
    assert apply(spark, once) == once


@pytest.mark.parametrize("pattern", [
    r"\bx\d+", r"\d+\b", r"x\b.", r"\B\d", r"\s+$", r"^\s*x", r".+", r"[\s_]+", r"\S+", r"(?i)A\b", r"[^\s]7",
    r"\b(?:\d|-)", r"\b\d?x", r"(?:\d+|[.])\b", r"[[:alpha:]]+", r"\w+\b", r"x{2,}|\bf", r"\b[0-9a-fA-F]{0,2}x",
])
def test_translated_patterns_match_like_re2(spark, pattern):
    texts = random_texts(1500, 3)
    assert apply(spark, texts, [("r", pattern, "<>")]) == re2(texts, [(pattern, "<>")])


def test_bad_profiles():
    for bad in ("", "  ", "[", "(", r"(?=x)", r"(?<!x)y", r"(a)\1"):
        with pytest.raises(ValueError, match="number 2"):
            compile_profile([("ok", "x", ""), ("bad", bad, "")])


def test_empty_profile_changes_nothing(spark):
    assert apply(spark, ["any 42 text"], []) == ["any 42 text"]


def test_order_is_kept(spark):
    rules = [Rule("a", "x", "y"), {"name": "b", "pattern": "y", "replace": "z"}]
    assert apply(spark, ["xy"], rules) == ["zz"]


def test_replacement_templates(spark):
    rules = [("r", r"(?P<word>[a-z]+)=(\d)", "${word}:${2}0$$ $1_x $nope")]
    assert apply(spark, ["k=5"], rules) == ["k:50$  "]
    assert java_replacement(r"a\b") == r"a\\b"
    assert java_pattern("[0-9a-fA-F]+") == r"(?d)\p{XDigit}+"


def test_fingerprint(spark):
    rows = spark.createDataFrame(
        [("foo", "bar", "m"), ("foobar", "", "m"), ("foo", "bar", "n"), ("foo", "bar", "m")],
        "host string, app string, normalized_msg string",
    )
    fps = [r[0] for r in rows.select(fingerprint()).collect()]
    assert fps[0] == fps[3] and len(set(fps)) == 3
    assert all(len(f) == 40 and f == f.lower() for f in fps)
    short = rows.select(short_fingerprint(fingerprint())).first()[0]
    assert short == fps[0][:12]


def test_level_rank(spark):
    levels = ["critical", "error", "warn", "warning", "info", "debug", "trace", "", None]
    rows = spark.createDataFrame([(lv,) for lv in levels], "level string")
    assert [r[0] for r in rows.select(level_rank()).collect()] == [40, 30, 20, 20, 10, 5, 0, 0, 0]


def test_guards_follow_from_patterns():
    """A rule's needed texts are literal parts of everything it matches."""
    samples = {
        "ts_iso8601": "2025-01-02T03:04:05", "ts_ru": "01.02.2025 10:11:12", "ipv4": "1.2.3.4",
        "uuid": "550e8400-e29b-41d4-a716-446655440000", "email": "a@b.c", "ipv6_port": "[::1]:8",
        "ipv6": "a::b", "ipv4_port": "1.2.3.4:5", "path": "/a/b",
    }
    for r in (*DEFAULT_PROFILE, *EXTENDED_PROFILE):
        if r.needs:
            assert all(n in samples[r.name] for n in r.needs)
