"""Network indicators and secrets."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from cargolens import schema
from cargolens.functions.network import is_private_ip, trusted_domain
from cargolens.operators.network import extract_urls, network_findings
from cargolens.operators.secrets import (
    SECRET_RULES,
    SecretRule,
    secret_findings,
    secret_matches,
)
from cargolens.plans.text import CORPUS_RULES


@pytest.fixture(scope="module")
def found(spark, table):
    def run(*values, error=None, **options):
        strings = table(
            [("a", i, i * 100, v) for i, v in enumerate(values)], schema.STRINGS
        )
        artifacts = table([("a", "m.pkl", error)], "artifact_id string, path string, error string")
        rows = network_findings(strings, artifacts, **options)
        return sorted(
            (r["code"], r["severity"], r["confidence"], r["location"]) for r in rows.collect()
        )

    return run


def test_trusted_host_and_its_subdomain(found):
    codes = found("https://huggingface.co/x", "https://cdn.HuggingFace.co./y")
    assert [c[:3] for c in codes] == [("MLS-NET-001", "info", "high")] * 2


def test_lookalike_of_trusted_host_is_unknown(found):
    assert found("https://evilhuggingface.co/x")[0][:3] == ("MLS-NET-002", "medium", "medium")


def test_unknown_host_escalates_with_the_policy(found):
    assert found("http://x.example/a", escalate=True)[0][1] == "high"


@pytest.mark.parametrize("url", ["file:///etc/passwd", "javascript:alert(1)",
                                 "data:text/html,x", "VBScript:x"])
def test_dangerous_schemes(found, url):
    assert found(url)[0][:3] == ("MLS-NET-006", "high", "high")


def test_inline_image_is_harmless(found):
    assert found("data:image/png;base64,AAAA")[0][:3] == ("MLS-NET-007", "info", "high")


def test_schemes_without_word_boundary(found):
    assert [c[0] for c in found("metadata:x profile:y")] == ["MLS-NET-006"] * 2


def test_url_hosts_that_are_addresses(found):
    codes = found("http://8.8.8.8/x http://10.0.0.1/y")
    assert [c[:2] for c in codes] == [("MLS-NET-003", "info"), ("MLS-NET-004", "high")]


def test_private_addresses_alone_give_nothing(found):
    assert found("192.168.1.1 and 127.0.0.1:8080 and 01.2.3.4") == []


def test_address_inside_a_url_is_reported_once(found):
    assert [c[0] for c in found("http://8.8.8.8/x", "8.8.8.8")] == ["MLS-NET-004"]


def test_address_before_its_url_is_reported_twice(found):
    assert [c[0] for c in found("8.8.8.8", "http://8.8.8.8/x")] == [
        "MLS-NET-004", "MLS-NET-005",
    ]


def test_one_finding_per_value_at_its_first_place(found):
    assert found("a", "http://x.example/", "http://x.example/") == [
        ("MLS-NET-002", "medium", "medium", "m.pkl (offset 100)")
    ]


def test_failed_artifacts_give_nothing(found):
    assert found("http://x.example/", error="broken") == []


def test_trailing_punctuation_and_stop_characters(table):
    strings = table([("a", 0, 0, "(see http://a.b/c).,; <http://d.e> x")], schema.STRINGS)
    assert [r["url"] for r in extract_urls(strings).collect()] == ["http://a.b/c", "http://d.e"]


def test_private_predicate_equals_the_standard_library(table):
    rng = random.Random(7)
    ips = [".".join(str(rng.choice((0, 10, 127, 169, 172, 192, 198, 203, 224, 240, 255,
                                    rng.randrange(256)))) if i == 0
                    else str(rng.randrange(256)) for i in range(4)) for _ in range(4000)]
    for net in ("172.15.0.1", "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.0.0.9",
                "192.0.0.10", "192.0.0.8", "192.0.1.1", "192.0.2.255", "198.17.1.1",
                "198.19.255.255", "198.51.100.7", "100.64.0.1", "169.254.9.9"):
        ips.append(net)
    rows = table([(i,) for i in ips], "ip string").select(
        "ip", is_private_ip(F.col("ip")).alias("p")
    ).collect()

    def expected(ip):
        a = ipaddress.ip_address(ip)
        return a.is_private or a.is_loopback or a.is_link_local

    assert [r["ip"] for r in rows if r["p"] != expected(r["ip"])] == []


SECRETS = {
    "openai_api_key": "sk-" + "a1" * 24,
    "huggingface_token": "hf_" + "a" * 37,
    "aws_access_key": "AKIA" + "A1" * 8,
    "github_token": "ghp_" + "a" * 36,
    "google_api_key": "AIza" + "a" * 35,
    "slack_token": "xoxb-" + "1" * 12,
    "generic_api_key": "API_KEY = 'abcdefghij0123456789'",
    "generic_secret": "PassWord: hunter2hunter2",
    "private_key_header": "-----BEGIN RSA PRIVATE KEY-----",
    "jwt_token": "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12,
    "database_url": "Postgres://user:pw@host/db",
    "telegram_bot_token": "123456789:" + "a" * 35,
    "aws_secret_key": "AWS_secret_access_key = " + "a" * 40,
}


@pytest.mark.parametrize("rule", sorted(SECRETS))
def test_each_rule_finds_its_secret(table, rule):
    strings = table([("a", 0, 7, f"x {SECRETS[rule]} y")], schema.STRINGS)
    rows = [r for r in secret_findings(strings).collect() if r["details"]["rule"] == rule]
    severity = next(r.severity for r in SECRET_RULES if r.name == rule)
    assert [(r["severity"], r["location"]) for r in rows] == [(severity, "a (offset 7)")]


def test_secret_in_metadata_and_masking(table):
    secret = SECRETS["huggingface_token"]
    strings = table([], schema.STRINGS)
    metadata = table([("a", "note", secret)], schema.METADATA)
    (row,) = secret_findings(strings, metadata).collect()
    assert row["location"] == "a (metadata key: 'note')"
    assert secret not in str(row) and row["details"]["match"] == "hf_a…aa"


def test_equal_secrets_give_one_finding(table):
    s = SECRETS["aws_access_key"]
    strings = table([("a", 0, 0, f"{s} {s}"), ("a", 1, 100, s), ("b", 0, 0, s)], schema.STRINGS)
    rows = secret_findings(strings).collect()
    assert sorted((r["artifact_id"], r["location"]) for r in rows) == [
        ("a", "a (offset 0)"), ("b", "b (offset 0)"),
    ]


def test_rules_without_hints_and_failed_artifacts(table):
    strings = table([("a", 0, 0, "id 4711"), ("b", 0, 0, "id 4712")], schema.STRINGS)
    artifacts = table([("a", "a", None), ("b", "b", "broken")],
                      "artifact_id string, path string, error string")
    rules = (SecretRule("id", r"id [0-9]{4}", "low"),)
    assert [r["artifact_id"] for r in secret_findings(strings, None, artifacts, rules).collect()] == ["a"]


@pytest.mark.parametrize("n", [0, 300])
def test_trusted_domains_alike_for_any_length_of_the_list(table, n):
    domains = ("Good.org", "a+b.net.", *[f"d{i}.example" for i in range(n)])
    hosts = ["good.org", "x.GOOD.org..", "notgood.org", "a+b.net", "aab.net", "org", ""]
    rows = table([(h,) for h in hosts], "host string")
    got = {r[0]: r[1] for r in rows.select("host", trusted_domain(F.col("host"), domains)).collect()}
    assert [h for h in hosts if got[h]] == ["good.org", "x.GOOD.org..", "a+b.net"]


#: The JVM never compiles a longer method.
_COMPILED_BYTES = 8000


def test_the_search_for_all_rules_is_compiled(table):
    strings = table([("a", 0, 0, f"x {s}") for s in SECRETS.values()], schema.STRINGS)
    found = secret_matches(strings, None, CORPUS_RULES)
    assert {r["rule"] for r in found.collect()} >= set(SECRETS)
    stages = found._jdf.queryExecution().debug().codegenToSeq().iterator()
    sizes = []
    while stages.hasNext():
        sizes.append(stages.next()._3().maxMethodCodeSize())
    assert sizes and max(sizes) <= _COMPILED_BYTES


_MORE = {
    "openai_org_key": "sk-org-" + "a1" * 24,
    "slack_webhook": "https://hooks.slack.com/services/" + "A" * 9 + "/" + "B" * 9 + "/" + "c" * 24,
    "hex_token": 'token = "' + "a1" * 20 + '"',
    "email_address": "some.one@mail.example",
}


def test_every_match_has_a_mark_of_its_rule(table):
    texts = SECRETS | _MORE
    without = [
        (f"no {r.name}", 0, 0, "".join(" " if c in r.marks else c for c in texts[r.name]))
        for r in CORPUS_RULES
    ]
    rows = [(name, 0, 0, text) for name, text in texts.items()]
    strings = table([*rows, *without, ("x", 0, 0, "x" * 99), ("null", 0, 0, None)], schema.STRINGS)
    assert all(len(set(r.marks)) == len(r.marks) > 0 for r in CORPUS_RULES)
    found = secret_matches(strings, None, CORPUS_RULES).select("artifact_id", "rule").collect()
    own = {(a.removeprefix("no "), a) for a, rule in found if a.removeprefix("no ") == rule}
    assert own == {(r.name, r.name) for r in CORPUS_RULES}


def test_first_pass_by_marks_or_by_characters(table):
    rules = (
        SecretRule("a", "k[.]1", "low", hints=("k.1",), marks="."),
        SecretRule("b", r"u\^2|v_3|w\\4|Q", "low", marks="^_\\Q"),
    )
    texts = ["k.1", "k1", "u^2", "v_3", "w\\4", "Q", "q", "", "é."]
    strings = table([(t, 0, 0, t) for t in texts], schema.STRINGS)
    plain = tuple(SecretRule(r.name, r.pattern, r.severity) for r in rules)
    got = [
        sorted((r["artifact_id"], r["rule"]) for r in secret_matches(strings, None, x).collect())
        for x in (rules, plain)
    ]
    assert got[0] == got[1] == sorted(
        [("k.1", "a"), ("u^2", "b"), ("v_3", "b"), ("w\\4", "b"), ("Q", "b")]
    )
