"""Signatures on the curve by the standards' vectors, and answers of providers with their time to live."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from headerloom.config import EngineConfig, read_settings
from headerloom.functions import ed25519
from headerloom.operators import answers, dkim, intel

#: RFC 8032, 7.1, tests 1 to 3: seed, key, message, signature.
VECTORS = (
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
)
#: RFC 8463, appendix A.
SIGNED = """DKIM-Signature: v=1; a=ed25519-sha256; c=relaxed/relaxed;
 d=football.example.com; i=@football.example.com;
 q=dns/txt; s=brisbane; t=1528637909; h=from : to :
 subject : date : message-id : from : subject : date;
 bh=2jUSOH9NhtVGCQWNr9BrIAPreKQjO6Sn7XIkfJVOzv8=;
 b=/gCrinpcQOoIfuHNQIbq4pgh9kyIK3AQUdt9OdqQehSwhEIug4D11Bus
 Fa3bT3FY5OsU7ZbnKELq+eXdp1Q1Dw==
From: Joe SixPack <joe@football.example.com>
To: Suzie Q <suzie@shopping.example.net>
Subject: Is dinner ready?
Date: Fri, 11 Jul 2003 21:00:37 -0700 (PDT)
Message-ID: <20030712040037.46341.5F8J@football.example.com>"""
BODY = "Hi.\n\nWe lost the game.  Are you hungry yet?\n\nJoe.\n"
KEY = "v=DKIM1; k=ed25519; p=11qYAYKxCrfVS/7TyWQHOg7hcvPapiMlrwIaaPcHURo="


def test_curve_by_the_standards_vectors():
    for seed, key, message, signature in ([bytes.fromhex(x) for x in v] for v in VECTORS):
        assert ed25519.public(seed) == key
        assert ed25519.sign(seed, message) == signature
        assert ed25519.verifies(key, message, signature)
        assert not ed25519.verifies(key, message + b"x", signature)
        assert not ed25519.verifies(key, message, signature[:32] + (int.from_bytes(signature[32:], "little") + ed25519.ORDER).to_bytes(32, "little"))
        assert not any(ed25519.verifies(k, message, signature) for k in (b"", b"\xff" * 32, key[:31], bytes(31) + b"\x80"))
    assert not any(ed25519.verifies(key, b"", s) for s in (b"", b"\0" * 63, b"\xff" * 64))


def test_signature_of_the_standard_with_kinds_of_keys(spark):
    rows = spark.createDataFrame([("good", SIGNED, BODY), ("fields", SIGNED, None), ("added", SIGNED.replace("dinner", "lunch"), BODY), ("short", SIGNED.replace("Fa3bT3FY5OsU7ZbnKELq+eXdp1Q1Dw==", ""), BODY)], "msg_id string, raw_header string, body string")
    for value, passed in ((KEY, {"good", "fields"}), (KEY.replace("k=ed25519; ", ""), set()), ("v=DKIM1; k=ed25519; p=", set()), ("v=DKIM1; k=ed25519; p=AAAA", set())):
        keys = spark.createDataFrame([("brisbane._domainkey.football.example.com", 0, value, False)], "name string, seq int, value string, unavailable boolean")
        got = {r.msg_id: r.outcome for r in dkim.verify_dkim(rows, keys).collect()}
        assert got == {k: "verified_pass" if k in passed else "verified_fail" for k in ("good", "fields", "added", "short")}


NOW = datetime(2025, 2, 3, 12)
RIGHT = '{"reputation": "low", "suspicious": true}'


def kept_rows(spark, *rows):
    return spark.createDataFrame([("emailrep", "email", ioc, NOW - timedelta(seconds=age), status, True, "low", True) for ioc, age, status in rows], answers.KEPT)


def test_only_what_is_new_failed_or_expired_is_asked(spark):
    kept = kept_rows(spark, ("a", 3599, "success"), ("b", 3600, "success"), ("c", 1, "timeout"), ("d", -1, "success"), ("e", 0, "success"), ("a", 10, "success"))
    wanted = spark.createDataFrame([("emailrep", "email", i) for i in (*"abcdefa", None)], "provider string, kind string, ioc string")
    now = F.lit(NOW)
    assert sorted(r.ioc for r in answers.to_ask(wanted, kept, now).collect()) == ["b", "c", "d", "f"]
    fresh = spark.createDataFrame([("emailrep", "email", "b", NOW, "success", False, "high", False), ("emailrep", "email", "c", NOW, "rate_limited", None, None, None), ("emailrep", "email", "a", NOW, "success", False, "high", False)], answers.KEPT)
    held = {r.ioc: (r.asked_at, r.malicious) for r in answers.renewed(kept, fresh, now).collect()}
    assert held == {"a": (NOW, False), "b": (NOW, False), "e": (NOW, True)}
    got = {r.ioc: (r.status, r.malicious, r.cached) for r in answers.answered(wanted, kept, fresh, now).collect()}
    assert got == {"a": ("success", True, True), "b": ("success", False, False), "c": ("rate_limited", None, False), "d": ("disabled", None, False), "e": ("success", True, True), "f": ("disabled", None, False)}
    fixtures = spark.createDataFrame([("emailrep", "email", "f", False, "high", False)], "provider string, kind string, ioc string, malicious boolean, reputation string, suspicious boolean")
    marked = {r.ioc: r.status for r in answers.answered(wanted, kept, fresh, now, fixtures=fixtures).collect()}
    assert marked == {"a": "success", "b": "disabled", "c": "disabled", "d": "disabled", "e": "success", "f": "demo_fixture"}
    nothing = kept.limit(0)
    assert answers.to_ask(wanted, nothing, now).count() == 6 and answers.answered(wanted.limit(0), nothing, nothing, now).count() == 0


def test_stream_asks_again_after_a_failure_and_after_the_time_to_live(spark, tmp_path):
    log = str(tmp_path / "log")
    time_, broken = [NOW], str(tmp_path / "broken")

    def call(provider, kind, ioc):
        with open(log, "a") as f:
            f.write(ioc + "\n")
        if ioc == "down" and os.path.exists(broken):
            raise TimeoutError
        return 200, RIGHT

    def run(name, iocs):
        spark.createDataFrame([("emailrep", "email", i) for i in iocs], "provider string, kind string, ioc string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema("provider string, kind string, ioc string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        open(log, "w").close()
        answers.stream_answers(stream, call, str(tmp_path / "kept"), str(tmp_path / "check"), lambda: time_[0]).awaitTermination(120)
        return sorted(open(log).read().split())

    open(broken, "w").close()
    assert run("1", ["up", "down", "up"]) == ["down", "up"]
    os.remove(broken)
    time_[0] = NOW + timedelta(seconds=3000)
    assert run("2", ["up", "down", "new"]) == ["down", "new"]
    time_[0] = NOW + timedelta(seconds=3600)
    assert run("3", ["up", "down", "new"]) == ["up"]
    assert {r.ioc for r in spark.read.parquet(str(tmp_path / "kept" / "batch=2")).collect()} == {"up", "down", "new"}


def test_lookups_without_an_answer_are_told_by_status(spark):
    rows = [("m", "p", "domain", f"i{i}", 0, s, None, None, None) for i, s in enumerate(("timeout", "disabled", "unknown", "timeout", "success"))] + [("n", "p", "domain", "i", 0, "success", False, None, None)]
    found = spark.createDataFrame(rows, "msg_id string, provider string, kind string, ioc string, first int, status string, malicious boolean, reputation string, suspicious boolean")
    assert {r.msg_id: (r.n_unanswered, r.unanswered) for r in intel.message_intel(found).collect()} == {"m": (3, "1 disabled, 2 timeout"), "n": (0, "")}


def test_settings_come_from_names_and_files(tmp_path):
    (tmp_path / "settings").write_text("# ours\nHEADERLOOM_TRUSTED_DOMAINS = a.example, ,b.example\n\nexport HEADERLOOM_LOOKUPS='url=7'\nHEADERLOOM_ENRICHMENT_ENABLED=off\nHEADERLOOM_MAX_HEADER_BYTES=\"99\"\nPATH=/bin\n")
    config = EngineConfig.from_settings(read_settings(str(tmp_path / "settings")))
    assert (config.trusted_domains, config.lookups["url"], config.lookups["ipv4"], config.enrichment_enabled, config.verification_enabled, config.max_header_bytes) == (("a.example", "b.example"), 7, 10, False, True, 99)
    assert EngineConfig.from_settings({}) == EngineConfig()
    for bad in ({"HEADERLOOM_TRUSTED": "a"}, {"HEADERLOOM_ENRICHMENT_ENABLED": "maybe"}, {"HEADERLOOM_LOOKUPS": "fax=1"}, {"HEADERLOOM_MAX_HEADER_BYTES": ""}, {"HEADERLOOM_SUFFIXES": "com"}):
        with pytest.raises(ValueError):
            EngineConfig.from_settings(bad)
