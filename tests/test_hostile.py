"""Texts made to be slow, and the same counts as the patterns on random text."""

import random
import re
import time

from pyspark.sql import functions as F

from textwarden.fixed_values import DETECTORS, INDICATORS, QUICK_PACK, REDACTIONS
from textwarden.functions.delimiters import possessive
from textwarden.functions.detectors import INDEXED, java_pattern
from textwarden.functions.entropy import shannon_entropy
from textwarden.functions.regex import java_plain
from textwarden.functions.text import quote
from textwarden.operators.evaluate import quick_detect
from textwarden.operators.policies import STORE_SCHEMA, malformed_policies, rules_from
from textwarden.operators.redact import redact
from textwarden.operators.scan import detect, scan

SPEC = {d[0]: d for d in DETECTORS}


def test_linear_patterns_count_what_the_patterns_count(spark):
    rng = random.Random(6)
    pieces = ["a", "B", "9", ".", ".", "-", "_", "%", "+", "@", "@", " ", "é", ".com", "b.org", "eyJ", "eyJab", "\n", "x.y"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 24))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("EMAIL", "JWT_TOKEN"):
        plain = java_plain(*SPEC[name][5:])
        counts = df.selectExpr("t", f"regexp_count(t, {quote(java_pattern(name))}) AS ours", f"regexp_count(t, {quote(plain)}) AS theirs")
        assert counts.filter("ours <> theirs").limit(3).collect() == [] and counts.filter("theirs > 0").count() > 100
    lines = ["ABC=1", "A_B9 = x y", "lower=1", "", "AB=1", "ABCD", "XYZ = \t 5", "KEY= "]
    envs = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in envs], "t string")
    plain = java_plain(SPEC["ENV_FILE"][5], "m")
    found = df.selectExpr("t", f"t RLIKE {quote(java_pattern('ENV_FILE'))} AS ours", f"t RLIKE {quote(plain)} AS theirs")
    assert found.filter("ours <> theirs").limit(3).collect() == [] and found.filter("theirs").count() > 50


def random_texts(seed, pieces, n=12_000, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, longest))) for _ in range(n)]


STRINGS = ["postgres://", "postgresql://", "POSTGRES://", "mongodb+srv://", "mongodb://", "mysql://", "redis://", "rediss://", "mssql://",
           "sqlserver://", ":", ":", "@", "@", "@", " ", "\n", "'", '"', "u", "pw", "host.x/db", "a@b", "1234567", "\ufdd0", "//", "://"]
SERVERS = ["Server", "Server=", "server = x", "SERVER=a;", ";", ";", "; ", ";\n", "\n", "\r\n", " ", "=", "Password", "Password=", "Password = p",
           "password\n=\n", "x", "\ufdd1", "\ufdd2", "mssql://u:p@h", "sqlserver=", "é"]


def test_connection_strings_are_counted_as_the_patterns_count(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(8, STRINGS) + random_texts(9, SERVERS)], "_plain string").repartition(8)
    for name, text in INDEXED.items():
        plain = quote(java_plain(*SPEC[name][5:]))
        counts = df.selectExpr("_plain", f"regexp_count({text}, {quote(java_pattern(name))}) AS ours", f"regexp_count(_plain, {plain}) AS theirs")
        rows = counts.filter("ours > 0 OR theirs > 0").collect()
        assert [r for r in rows if r.ours != r.theirs][:3] == [] and len(rows) > 100, name


def test_possessive_blanks_count_what_the_patterns_count(spark):
    pieces = ["passport", "passport no", "pass\tno", "AB123456", "A1234567", " ", "  ", "\n", ":", "=", "revenue", "expected revenue", "budget",
              "annual target", "$", "€ ", "1,200", "5.25", " million", "M", "x"]
    df = spark.createDataFrame([(t,) for t in random_texts(10, pieces)], "t string").repartition(8)
    patterns = [SPEC[n][5:] for n in ("PASSPORT_NUMBER", "FINANCIAL_AMOUNT")] + [(next(i[5] for i in INDICATORS if i[0] == "REVENUE_PROJECTION"), "i")]
    for pattern, flags in patterns:
        ours, theirs = quote(java_plain(possessive(pattern), flags)), quote(java_plain(pattern, flags))
        rows = df.selectExpr("t", f"regexp_count(t, {ours}) AS ours", f"regexp_count(t, {theirs}) AS theirs").filter("theirs > 0 OR ours > 0").collect()
        assert [r for r in rows if r.ours != r.theirs][:3] == [] and len(rows) > 100


def test_quick_pack_finds_what_its_patterns_find(spark):
    pieces = STRINGS + ["BEGIN", "BEGIN ", "PRIVATE KEY", "\r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(11, pieces, 6000))], "id int, text string").repartition(8)
    plain = {q[0]: q for q in QUICK_PACK}
    for name in ("Private Key", "DB Connection"):
        want = {r.id for r in df.filter(f"text RLIKE {quote(java_plain(*plain[name][3:5]))}").collect()}
        assert {r.id for r in quick_detect(df).filter(f"array_contains(found, '{name}')").collect()} == want and want


def test_redaction_equals_the_plain_rules(spark):
    """Running text and log against Python's engine, rule by rule."""
    pieces = ["a", "B9", ".", ".", "-", "_", "%", "+", "@", "@", " ", "b.org", ".com", "eyJ", "eyJab", "\n", "x.y", ":", "'", "\ufdd3", "\ufdd31",
              "postgres://", "mysql://", "mongodb+srv://", "redis://", "é", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----",
              "-----END PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"]
    values = random_texts(12, pieces, 12_000, 18)
    rules = [r for r in REDACTIONS if r[0] in ("EMAIL", "JWT", "DB_URI", "PRIVATE_KEY")]
    df = spark.createDataFrame(list(enumerate(values)), "id int, text string").repartition(8)
    hits = 0
    for r in redact(df).collect():
        text, log = values[r.id], []
        if text.strip():
            for rule, label, _, pattern, flags in rules:
                seen = []

                def name(m):
                    seen.append(m[0])
                    return f"[{label}_{len(seen)}]"

                text = re.sub(pattern, name, text, flags=re.ASCII | (re.I if "i" in flags else 0))
                log += [(m[:8] + "***", f"[{label}_{k}]", rule) for k, m in enumerate(seen, 1)]
        assert (r.redacted, [tuple(x) for x in r.replacements]) == (text, log), values[r.id]
        hits += len(log)
    assert hits > 2000


MEGABYTE = {
    "no end": "postgres://a" * 87_000 + ":b",
    "bad end": "mysql://a" * 100_000 + ":b@ ",
    "short end": "redis://a" * 100_000 + ":b@x@y z",
    "far colon": "mongodb://" * 100_000,
    "many ends": "mssql://u:p@ " * 80_000,
    "servers": "Server=a;" * 110_000 + " Password",
    "servers without end": "Server=a" * 120_000 + " Password=x",
    "server lines": "Server=a;\n" * 100_000 + "Password=x",
    "key marks": "-----BEGIN RSA PRIVATE KEY-----\n" * 31_000,
    "dots": "a." * 500_000 + "@",
    "ats": "a@" * 500_000,
    "jwt": "eyJ-" * 250_000 + ".a",
    "blanks": "passport" + " " * 500_000 + "expected revenue" + " " * 500_000,
}


def test_megabyte_rows_are_detected_and_redacted_in_time(texts):
    rows = texts(list(MEGABYTE.values()))
    detect(texts(["postgres://a:b@c Server=x;Password=y"])).collect(), redact(texts(["a@b.co"])).collect()
    for job in (detect, redact):
        for i, name in enumerate(MEGABYTE):
            start = time.monotonic()
            assert job(rows.filter(f"id = {i}")).count() == 1 and len(job(rows.filter(f"id = {i}")).collect()) == 1
            assert time.monotonic() - start < 20, (job, name)  # two runs


def test_long_hostile_rows_finish(spark, texts):
    rows = ["KEY_ONE=value\n" * 100_000, "a." * 500_000 + " x@y.z", "eyJ-" * 250_000 + ".a"]
    start = time.monotonic()
    out = detect(texts(rows)).collect()
    assert len(out) == 3 and time.monotonic() - start < 60


def test_entropy_of_many_kinds_of_character(spark):
    rng = random.Random(1)
    text = "".join(chr(0x4E00 + rng.randint(0, 6000)) for _ in range(300_000))
    small = text[:3000]
    df = spark.createDataFrame([(text,), (small,)], "t string")
    start = time.monotonic()
    got = [r[0] for r in df.selectExpr(f"{shannon_entropy('t')} AS h").collect()]
    assert time.monotonic() - start < 30
    import math
    from collections import Counter

    for h, t in zip(got, (text, small)):
        assert abs(h - -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())) < 1e-9


def test_malformed_rules_are_set_aside(spark, texts):
    bad = ["{bad", '{"maxRiskScore": "40"}', '{"detectedCategories": "CREDENTIAL"}']
    store = spark.createDataFrame([(i, "r", c, "BLOCK", 1, "") for i, c in enumerate(
        [*bad, '{"maxRiskScore": 40.5}', '{"maxRiskScore": null, "detectedCategories": ["SOURCE_CODE"]}'])], STORE_SCHEMA)
    assert sorted(r.id for r in malformed_policies(store).collect()) == [0, 1, 2]
    code = texts(["let a = 1; let b = 2"])
    row = scan(code, rules=rules_from(store)).first()
    assert (row.risk_score > 40.5, row.policy_id) == (True, "4")
    row = scan(code, rules=rules_from(store.filter("id < 4"))).first()
    assert row.policy_id not in ("0", "1", "2", "3")
