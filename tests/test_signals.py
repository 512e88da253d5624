import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textwarden.functions import destination, entropy, linear, risk
from textwarden.functions.text import plain_blanks, utf16_length
from textwarden.operators.scan import detect, scan
from textwarden.options import ScanOptions


def value(spark, expression):
    return spark.sql(f"SELECT {expression} AS x").first().x


@pytest.mark.parametrize("text, want", [("''", 0.0), ("'abcd'", 2.0), ("'aaaaaaaaaa'", 0.0), ("'aab'", 0.9183)])
def test_shannon_entropy(spark, text, want):
    assert round(value(spark, entropy.shannon_entropy(text)), 4) == want


def test_entropy_uses_utf16_length(spark):
    # four code points, two of them two units wide: shares of 1/6
    assert value(spark, entropy.shannon_entropy("'ab😀😁'")) == pytest.approx(-4 * (1 / 6) * math.log2(1 / 6))
    assert value(spark, utf16_length("'a😀é'")) == 4


def secrets(df, **options):
    return {r.id: r.secrets for r in detect(df, options=ScanOptions(**options)).select("id", "secrets").collect()}


def test_token_length_limits(texts):
    hexes = ["0123456789abcdef0123456789abcdef0123456", "0123456789abcdef0123456789abcdef01234567"]
    base64 = ["AbCdEfGhIjKlMnOpAbCdEfGhIjKlMnO", "AbCdEfGhIjKlMnOpAbCdEfGhIjKlMnOp"]
    found = secrets(texts(["see " + t + " end" for t in hexes + base64]))
    assert [f.reason for f in found[1]] == ["HIGH_ENTROPY_HEX_TOKEN"]
    assert [f.reason for f in found[3]] == ["BASE64_ENCODED_BLOB"]
    # one shorter: base64-looking, but only from 32 characters on
    assert [f.reason for f in found[0]] == ["BASE64_ENCODED_BLOB"]
    assert found[2] == []


def test_secret_is_masked_and_threshold_is_an_option(texts):
    df = texts(["key f8Kp2!mX9vTq#Rj5@Yw7&Nz3Ls6$Vc0Gh4"])
    (found,) = secrets(df)[0]
    assert found.token == "f8Kp2!***" and found.reason.startswith("HIGH_ENTROPY (H=")
    assert secrets(df, entropy_threshold=6.0)[0] == []


def test_short_tokens_never_qualify():
    assert entropy.shortest_secret(4.2) == 19
    assert entropy.shortest_secret(6.0) == 32
    assert entropy.shortest_secret(3.0) == 12


def test_low_threshold_finds_short_tokens(texts):
    assert len(secrets(texts(["x aB3$eF7!kL9# y"]), entropy_threshold=3.5)[0]) == 1


def brute_force_secrets(text, threshold):
    import re
    found = []
    for t in re.split(r"""[\s=:"'`,;\[\]{}()]+""", text):
        if len(t) < 12:
            continue
        h = -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values())
        d = min(100, sum(p for r, p in entropy.DENSITY if re.search(r, t)))
        if (re.fullmatch(r"[0-9a-fA-F]{24,}", t) and len(t) >= 40) or (
                re.fullmatch(r"[A-Za-z0-9+/]{20,}={0,2}", t) and len(t) >= 32) or (h >= threshold and d >= 40):
            found.append(t[:6] + "***")
    return found


def test_secrets_equal_brute_force(texts):
    rng = random.Random(3)
    alphabet = "abcXYZ0189+/=_-!. ,:'\n"
    samples = ["x" + "".join(rng.choices(alphabet, weights=[9] * 12 + [1] * 10, k=400)) for _ in range(200)]
    for threshold in (3.0, 4.2):
        found = secrets(texts(samples), entropy_threshold=threshold)
        assert [[f.token for f in found[i]] for i in range(200)] == [brute_force_secrets(s, threshold) for s in samples]


def test_narrative_weights(texts):
    rows = [
        "codename: Falcon is the plan", "expected revenue: 42M is the plan", "launch date: Q1 2025, pricing: $5/seat",
        "codename: A", "codename: Falcon and codename: Heron",
    ]
    out = {r.id: r.narrative for r in detect(texts(rows)).collect()}
    assert (out[0].score, out[0].detected, out[0].categories) == (40, False, ["CONFIDENTIAL_PROJECT"])
    assert (out[1].score, out[1].detected, out[1].sensitivity) == (45, True, 65)
    assert (out[2].score, out[2].detected, out[2].sensitivity) == (70, True, 70)
    assert out[3].score == 0  # 11 characters: too short to judge
    assert (out[4].score, out[4].detected) == (80, True)


def test_linear_features_and_penalty(texts):
    plain = "nothing here at all"
    out = {r.id: r.classifier for r in detect(texts([plain, plain * 20, "API_KEY=1 api_key=2 AKIA"])).collect()}
    assert out[0].probability == round(1 / (1 + math.exp(3.0)), 4)
    assert out[1].probability == round(1 / (1 + math.exp(3.4)), 4)
    factor = lambda w, n: w * (1 + abs(w) / 5) * math.log(1 + n)
    score = -3 + factor(3.8, 2) + factor(4.0, 2) + factor(4.2, 1)
    assert out[2].probability == pytest.approx(1 / (1 + math.exp(-score)), abs=1e-4)
    assert out[2].top_features[:2] == ["API_KEY=", "api_key="] and out[2].confidence == "HIGH"
    assert len(linear.feature_rows()) == 107


@pytest.mark.parametrize("host, root, tier", [
    ("chat.openai.com", "openai.com", "EXTERNAL_AI"), ("openai.azure.com", "azure.com", "APPROVED_AI"),
    ("gemini.google.com", "google.com", "EXTERNAL_AI"), ("www.docs.google.com", "google.com", "APPROVED_SAAS"),
    ("login.microsoftonline.com", "microsoftonline.com", "APPROVED_AI"), ("localhost", "localhost", "INTERNAL"),
    ("172.31.0.1", "0.1", "INTERNAL"), ("172.32.0.1", "0.1", "UNKNOWN_SAAS"), ("db.corp", "db.corp", "INTERNAL"),
    ("WWW", "www", "UNKNOWN_SAAS"), ("", "", "UNKNOWN_SAAS"), ("files.wetransfer.com", "wetransfer.com", "SUSPICIOUS"),
    ("copilot.github.com", "github.com", "EXTERNAL_AI"), ("localhost.evil.com", "evil.com", "UNKNOWN_SAAS"),
])
def test_destinations(spark, host, root, tier):
    assert value(spark, destination.root_domain(f"'{host}'")) == root
    assert value(spark, destination.tier_of(f"'{host}'", f"'{root}'")) == tier


def test_host_sources(spark):
    assert value(spark, destination.host_of("'https://Sub.Example.com:8443/x'")) == "sub.example.com"
    assert value(spark, destination.host_of("'not a url'", "'Go to Chat.Example.ORG now'")) == "chat.example.org"
    assert value(spark, destination.host_of("cast(null AS string)")) == ""


@pytest.mark.parametrize("n, want", [(100, 10), (101, 25), (500, 25), (501, 45), (2000, 45), (2001, 65), (5000, 65),
                                     (5001, 80), (20000, 80), (20001, 95)])
def test_volume_steps(spark, n, want):
    assert value(spark, risk.volume_factor(str(n))) == want


@pytest.mark.parametrize("score, want", [(25, "ALLOW"), (26, "WARN"), (59, "WARN"), (60, "BLOCK")])
def test_decision_bands(spark, score, want):
    assert value(spark, risk.risk_decision(str(score))) == want


def test_score_formula(spark):
    assert value(spark, risk.risk_score("100", "75", "25", "70", "100")) == 80
    assert value(spark, risk.risk_score("0", "75", "25", "70", "30")) == 4
    assert value(spark, risk.risk_score("80", "75", "10", "70", "30")) == 62
    assert value(spark, risk.risk_score("0", "95", "95", "70", "95")) == 9


SCENARIOS = [  # text, score, risk decision, rule, final decision; to an external AI by paste
    ("What does a hash map do, and when is a tree the better choice?", 4, "ALLOW", None, "ALLOW"),
    ("aGFyYm91ciBsZWRnZXIsIHNlY29uZCBkcmFmdCwga2VwdCBieSB0aGUgbmlnaHQgY2xlcmsgMTk=", 62, "BLOCK", None, "ALLOW"),
    ("Write to maria.lopez@example.com about it", 63, "BLOCK", "POLICY_011", "WARN"),
    ("invoice: $ 12,500.00 is due", 66, "BLOCK", None, "BLOCK"),
    ("AKIA" + "ABCD1234EFGH5678", 77, "BLOCK", "POLICY_001", "BLOCK"),
    ("strategic acquisition and codename: Falcon", 72, "BLOCK", "POLICY_006", "BLOCK"),
]


def test_scenarios(texts):
    out = {r.id: r for r in scan(texts([s[0] for s in SCENARIOS])).collect()}
    got = [(s[0], out[i].risk_score, out[i].risk_decision, out[i].policy_id, out[i].final_decision)
           for i, s in enumerate(SCENARIOS)]
    assert got == SCENARIOS


def test_internal_destination_allows(texts):
    out = scan(texts([SCENARIOS[4][0]], host="console.cloud.internal")).first()
    assert (out.final_decision, out.policy_id, out.policy_override) == ("ALLOW", "POLICY_021", True)


def test_codename_watchlist(texts):
    options = ScanOptions(codenames=("Aurora-X", "Project-Titan"))
    out = {r.id: r.narrative.categories for r in detect(
        texts(["we ship aurora-x soon", "aurora-xy is other", "Project-Titan."]), options=options).collect()}
    assert out == {0: ["CONFIDENTIAL_PROJECT"], 1: [], 2: ["CONFIDENTIAL_PROJECT"]}


def test_extra_rules_win_within_an_action(texts):
    rule = ("X1", "Own", "BLOCK", ["CREDENTIAL"], [], [], None, "own reason")
    out = scan(texts([SCENARIOS[4][0]]), options=ScanOptions(extra_rules=(rule,))).first()
    assert (out.policy_id, out.reason) == ("X1", "own reason")


def test_plain_blanks_keep_length(spark):
    text = "a\u2003b\u2028c\ufeffd"
    want = "a\u00a0b\rc\u00a0d"
    assert spark.createDataFrame([(text,)], "t string").select(F.expr(plain_blanks("t"))).first()[0] == want
