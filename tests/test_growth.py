"""Work that was done more often than needed, and the same results without it."""

import ipaddress
import re
import time

from pyspark.sql import functions as F

from headerloom.functions import net, suffixes
from headerloom.operators import headers, ioc, lookalike, route
from headerloom.plans import generator
from headerloom.plans.queries import QUERIES
from headerloom.plans.generator import order_messages


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_refanged_once_and_only_kinds_asked_for_are_looked_for(spark):
    text = "x: a@b.example. hxxp://c[.]example/d 192.0.2.1 (2001:DB8::1) mail[.]E.example _f@g.example a@h.example_i@j.example"
    rows = spark.createDataFrame([("m", text), ("n", None), ("o", "plain words")], "k string, t string")
    found = ioc.hits(rows, "k", "t", [])
    assert {(r.kind, r.normalized) for r in found.collect()} == {
        ("ipv4", "192.0.2.1"), ("ipv6", "2001:db8::1"), ("email", "a@b.example"), ("email", "_f@g.example"), ("email", "a@h.example"), ("url", "http://c.example/d"), ("domain", "mail.e.example"), ("domain", "j.example"),
    }
    assert _plan(found).count("bhxxp") == 1
    only = ioc.hits(rows, "k", "t", [], ("ip",))
    assert {r.kind for r in only.collect()} == {"ipv4", "ipv6"} and "a-zA-Z]{2,63}" not in _plan(only)


def test_addresses_of_all_networks_have_their_class(spark):
    edges = []
    for name, networks in net.IPV4_CLASSES:
        for n in map(ipaddress.ip_network, networks):
            edges += [int(n[0]), int(n[-1]), int(n[0]) - 1, int(n[-1]) + 1]
    ips = [str(ipaddress.ip_address(e)) for e in edges if 0 <= e < 1 << 32]

    def told(ip: str) -> str:
        return next((name for name, networks in net.IPV4_CLASSES if any(ipaddress.ip_address(ip) in ipaddress.ip_network(n) for n in networks)), "public")

    expected = {ip: told(ip) for ip in ips} | {"1.2.3": "invalid", "01.2.3.4": "invalid", "256.1.1.1": "invalid", "": "invalid"}
    rows = spark.createDataFrame([(ip,) for ip in expected], "ip string").select("ip", net.classify_ipv4(F.col("ip")).alias("c"))
    assert {r.ip: r.c for r in rows.collect()} == expected
    # Patterns only: nothing is evaluated row by row outside compiled code.
    assert "lambda" not in _plan(rows)


def test_flat_numbers_are_dealt_and_lines_are_written_afterwards(spark, tiny):
    plan = _plan(order_messages(spark, tiny))
    assert "hashpartitioning(cast(l_orderkey" in plan and plan.count("Exchange hashpartitioning") == 2
    assert "lambda" not in plan.split("Exchange hashpartitioning(cast(l_orderkey")[1]


def test_hosts_after_numbers_are_still_found(spark):
    line = "Received: from 12 345 6mail.example (helo=77 real.example [192.0.2.7]) by 9 mx.example with SMTP id 1; Mon, 6 May 2024 10:00:00 +0000"
    messages = spark.createDataFrame([("m", line)], "msg_id string, raw_header string")
    hop = route.parse_received(headers.parse_fields(messages)).first()
    assert (hop.from_host, hop.from_rdns, hop.by_host, hop.primary_ip) == ("6mail.example", "real.example", "mx.example", "192.0.2.7")


def test_a_signature_costs_a_bounded_number_of_products():
    m = 3**325 % generator._P
    for prime, bits in ((generator._P, 521), (generator._Q, 607)):
        e = pow(generator._E, -1, prime - 1)
        began = time.process_time()
        assert generator._power(m, e, bits) == pow(m, e, prime)
        assert time.process_time() - began < 0.5


def test_parts_grow_with_the_messages(spark, tiny, monkeypatch):
    least = generator.dealt_parts(spark, tiny)
    monkeypatch.setattr(generator, "PART", 100)
    assert generator.dealt_parts(spark, tiny) == 15 > least
    assert "hashpartitioning(cast(l_orderkey" in _plan(order_messages(spark, tiny)) and ", 15)" in _plan(order_messages(spark, tiny))


def test_fields_are_read_once_for_encoded_words(spark):
    rows = spark.createDataFrame([("m", "Subject: =?utf-8?B?w6Q=?=\nFrom: a@b.example\nTo: =?x")], "msg_id string, raw_header string")
    found = headers.with_decoded(headers.parse_fields(rows))
    assert {(r.name_lc, r.decoded_value) for r in found.collect()} == {("subject", "\u00e4"), ("from", None), ("to", "=?x")}
    assert "Union" not in _plan(found)


def test_names_are_taken_apart_once_for_all_watched(spark):
    watched = ["nation_7.example", "nation_12.example"]
    rows = spark.createDataFrame([("nation_1.example",), ("nat1on_7.example",), ("nation_7.example",), ("x.nation_12x.example",), (None,)], "d string")
    found = rows.select("d", net.lookalike(F.col("d"), watched)["matched"].alias("m"))
    assert {r.d: r.m for r in found.collect()} == {"nation_1.example": "nation_7.example", "nat1on_7.example": "nation_7.example", "nation_7.example": "nation_12.example", "x.nation_12x.example": "nation_12.example", None: None}
    assert _plan(found).count("_accentless_names") <= 8


def test_encoded_words_are_cut_in_one_pass(spark, tmp_path):
    texts = [(1, "\u00e4b\n" * 7), (2, ""), (3, None), (4, "\U0001f600" * 21), (5, "0123456789"), (6, "a\r\nb")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["rfc2047"](spark, str(tmp_path))
    assert {r.doc_id: r.decoded for r in found.collect()} == {1: "\u00e4b " * 6 + "\u00e4b", 2: "", 3: None, 4: "\U0001f600" * 21, 5: "0123456789", 6: "a b"}
    assert "sequence(" not in _plan(found)


def test_forms_are_made_only_for_lengths_that_the_other_side_has(spark):
    words = spark.createDataFrame([("abcdefgh",), ("abcdefg",), ("abcdefghijkl",), ("a",), ("",)], "w string")
    lengths = F.array(F.lit(8))
    filed = words.select("w", lookalike._filed(F.col("w"), False, (lengths, F.lit(True)), (lengths, F.lit(True)))).groupBy("w").count()
    # One character masked, one left out, two masked; and of one character less, one masked of what is left as it is.
    assert {r.w: r["count"] for r in filed.collect()} == {"abcdefgh": 8 + 8 + 28, "abcdefg": 1 + 7}


def test_lookalikes_are_those_of_comparing_all_where_shapes_and_labels_differ_in_length(spark):
    labels = ["paypal", "päypal", "xn--pypal-4ve", "paypa1", "paypa", "aypal", "lumenbank", "lumnbank", "1umenbank", "lumenbnak", "xlumenbanky", "lumenlumenbank", "abc", "abcd", "abdc", "xabcdx", "bücher", "xn--bcher-kva", "bucher", "buecher", "aaaaaaaa", "aaaaaa", "aaaaaaaaaa", ""]
    names = [f"{x}.{s}" for x in labels for s in ("example", "com")] + ["a.b.paypal.example", "c.paypal.example"]
    watched = [(f"{x}.{s}", (i * 7) % 5) for i, x in enumerate(labels) for s in ("example", "com") if x]
    table = spark.createDataFrame(watched, "domain string, rank long")
    rows = spark.createDataFrame([(n,) for n in names], "domain string")
    found = {r.domain: (r.matched, r.technique) for r in lookalike.lookalikes(rows, table).collect()}
    org = {r.domain: (r.org, r.rank) for r in table.select("domain", suffixes.organizational_domain(F.col("domain")).alias("org"), "rank").collect()}
    in_order = [d for d in sorted(org, key=lambda d: (org[d][1], org[d][0]))]
    hit = net.lookalike(F.col("domain"), in_order)
    every = {r.domain: (r.h.matched, r.h.technique) for r in rows.select("domain", hit.alias("h")).where("h is not null").collect()}
    assert found == every and len(found) > 30


def test_rules_are_compiled_in_methods_that_the_jvm_compiles_and_nothing_is_dealt(spark, tiny, capsys):
    found = QUERIES["risk_exits"](spark, tiny)
    assert "Exchange" not in _plan(found) and "step_" not in _plan(found)
    capsys.readouterr()
    found.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    # Longer methods are interpreted.
    assert sizes and max(sizes) <= 8000
