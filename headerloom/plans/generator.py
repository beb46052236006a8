"""Messages and lookup tables made from the order tables.

Each order becomes a raw header block whose values follow from its columns, so
that what an analysis reads out of the text can be computed from the columns
again by other means.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerloom.functions import ed25519

#: The line of a line item.
_HOP = r"""
concat('Received: from h', l_suppkey, '.example.net (r', l_suppkey, '.example.org. [',
 case l_suppkey % 4 when 0 then concat('10.1.2.', l_suppkey % 200) when 1 then concat('93.184.', l_suppkey % 100, '.', l_suppkey % 250) when 2 then concat('203.0.113.', l_suppkey % 250) else concat('192.168.1.', l_suppkey % 250) end,
 '])\n\tby mx', l_partkey % 5, if(l_partkey % 3 = 0, '.corp.example', '.relay.example'), ' with ', element_at(array('SMTP', 'ESMTPS (TLS1.3 cipher=X (a; b))', 'ESMTP'), cast(l_linenumber % 3 as int) + 1),
 ' id q', l_partkey, '\n\tfor <u', l_suppkey, '@to.example>; ', date_format(timestampadd(SECOND, (l_partkey * 7919) % 86400, date_trunc('DAY', l_shipdate)), 'EEE, d MMM yyyy HH:mm:ss'), ' ',
 element_at(array('+0000', '+0300', '-0500'), cast(l_quantity as int) % 3 + 1), if(l_linenumber % 2 = 0, ' (zone; note)', ''))
"""


def messages(orders: DataFrame, lineitem: DataFrame, parts: int | None = None) -> DataFrame:
    """(msg_id, raw_header, body): one message for each order, dealt out by msg_id in ``parts``.

    What is dealt are the columns that a text follows from; texts are made where their message belongs.
    """
    dealt = lambda rows, key: rows.repartition(*([parts] if parts else []), F.col(key).cast("string")).withColumn("msg_id", F.col(key).cast("string"))
    place = ["l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    # Flat rows with keys as numbers are dealt; a line is written before its message's lines are put in order, where one compiled expression does it.
    items = dealt(lineitem.select("l_orderkey", *place), "l_orderkey").selectExpr("msg_id", f"struct({', '.join(place)}, {_HOP} as line) as place")
    hops = items.groupBy("msg_id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    orders = dealt(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"), "o_orderkey")
    rows = orders.join(hops, "msg_id", "left").selectExpr(
        "msg_id", "o_orderkey as k", "array_join(places.line, '\n') as received", "o_orderstatus as st", "cast(substring(o_orderpriority, 1, 1) as int) as pri", "o_custkey",
        "concat(if(o_orderkey % 4 = 0, 'mail.', ''), 'c', o_custkey % 40, '.example') as fd", "concat('c', o_custkey % 40, '.example') as org",
    )
    parts = [
        "received",
        r"case k % 3 when 0 then concat('From: \"Customer, No. ', o_custkey, '\" <u', o_custkey, '@', fd, '>') when 1 then concat('From: u', o_custkey, '@', fd) else concat('FROM:\n Customer ', o_custkey, '\n\t<u', o_custkey, '@', upper(fd), '>') end",
        "case k % 5 when 0 then concat('Reply-To: <x@r', k % 7, '.example>') when 1 then concat('Reply-To: x@reply.', org) end",
        "case when k % 6 = 0 then 'Return-Path: <>' when k % 6 = 1 then concat('Return-Path: <b@', fd, '>') when k % 6 = 2 then concat('Return-Path: <b@bounce.', org, '>') else concat('Return-Path: <b@sender', k % 9, '.example>') end",
        "if(k % 2 = 0, concat('Message-ID: <', k, '@ids', k % 3, '.example>'), concat('Message-ID: <', k, '@', fd, '>'))",
        "'Subject: order'",
        "if(k % 11 = 0, 'subject: again', null)",
        "if(k % 13 = 0, 'this line has no colon', null)",
        r"""case when k % 17 <> 0 then concat('Authentication-Results: mx.', if(k % 3 = 0, 'elsewhere', 'corp'), '.example;\n\tspf=', case st when 'F' then 'pass' when 'O' then 'fail' else 'softfail' end, ' (checked; ', if(k % 29 = 0, '((((deep; dkim=pass)) \\) "))', 'here'), ') smtp.mailfrom=', if(k % 23 = 0, '"x; dmarc=pass y"', 'b'), '@', fd, ';\n dkim=', element_at(array('pass', 'fail', 'neutral', 'none', 'wat'), pri), if(k % 19 = 0, ' reason="odd; spf=pass \\"here\\""', ''), ' header.d=', if(pri % 2 = 1, fd, concat('other', k % 5, '.example')), '; dmarc=', if(st = 'F', 'pass', 'none'), ' header.from=', fd) end""",
        "if(k % 3 >= 1, 'ARC-Seal: i=1; a=rsa-sha256; cv=none; d=arc.example', null)",
        "if(k % 3 = 2, concat('ARC-Seal: i=2; cv=', if(k % 2 = 0, 'pass', 'fail'), '; d=arc.example'), null)",
        "concat('DKIM-Signature: v=1; d=', if(pri % 2 = 1, fd, concat('other', k % 5, '.example')), '; s=s1;\n b=ab cd')",
        "concat('X-Forefront-Antispam-Report: CIP:203.0.113.', k % 250, ';SCL:', element_at(array('-1', '0', '1', '5', '6', '9', '7'), cast(k % 7 as int) + 1), ';CAT:', if(k % 2 = 0, 'PHSH', 'NONE'), ';SFV:', if(k % 4 = 0, 'NSPM', 'ODD'), ';')",
    ]
    text = rows.selectExpr("msg_id", f"concat_ws('\n', {', '.join(parts)}) as raw_header")
    return text.withColumn("body", F.lit(None).cast("string"))


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages dealt out by msg_id: taking texts apart costs far more than their bytes suggest, and what follows stays where its message is."""
    return messages(spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet"), dealt_parts(spark, sf_dir))


#: Messages in one part, about: what a task sorts and groups stays in memory, however many messages there are.
PART = 50_000


def dealt_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts over which messages are dealt: a task's work is bounded, their number grows with the messages (counted from the files' footers)."""
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-spark.read.parquet(f"{sf_dir}/orders.parquet").count() // PART))


def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id) of the same messages, where they are, without making their texts."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("msg_id")).repartition(dealt_parts(spark, sf_dir), "msg_id")


def dns_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Records of the domains c0 to c39: by n % 4 a network, an include, an address record, nothing; every tenth lookup fails."""
    n = spark.range(40).withColumnRenamed("id", "n")
    name = "concat('c', n, '.example')"
    txt = n.where("n % 4 <> 3").selectExpr(f"{name} as name", "0 as seq", "case n % 4 when 0 then 'v=spf1 ip4:93.184.0.0/16 -all' when 1 then concat('v=spf1 include:_spf.c', n, '.example ~all') else concat('v=spf1 a:host', n, '.example ?all') end as value", "n % 10 = 4 as unavailable")
    inner = n.where("n % 4 = 1").selectExpr("concat('_spf.c', n, '.example') as name", "0 as seq", "'v=spf1 -ip4:203.0.113.0/25 ip4:203.0.113.0/24 -all' as value", "false as unavailable")
    dmarc = n.where("n % 3 <> 2").selectExpr("concat('_dmarc.c', n, '.example') as name", "0 as seq", "concat('v=DMARC1; p=', if(n % 2 = 0, 'reject', 'quarantine'), if(n % 3 = 1, '; aspf=s', '')) as value", "n % 10 = 6 as unavailable")
    a = n.where("n % 4 = 2").selectExpr("concat('host', n, '.example') as name", "concat('93.184.', n, '.', n) as value", "false as unavailable")
    suppliers = spark.range(100_000).withColumnRenamed("id", "s").where("s % 4 = 1 and s % 3 <> 0").selectExpr("concat('93.184.', s % 100, '.', s % 250) as ip", "s % 100 as x", "s % 250 as y").distinct()
    ptr = suppliers.selectExpr("ip", "concat('p', x, '-', y, '.example') as value", "false as unavailable")
    back = suppliers.where("y % 2 = 0").selectExpr("concat('p', x, '-', y, '.example') as name", "ip as value", "false as unavailable")
    listed = suppliers.where("y % 5 = 0").selectExpr("concat(y, '.', x, '.184.93.', if(y % 2 = 0, 'zen.spamhaus.org', 'bl.spamcop.net')) as name")
    return {"dns_txt": txt.unionByName(inner).unionByName(dmarc), "dns_a": a.unionByName(back), "dns_ptr": ptr, "dns_listed": listed}


#: A key for tests that anybody can make again: its primes are two Mersenne primes.
_P, _Q, _E = 2**521 - 1, 2**607 - 1, 65537


def public_key() -> str:
    """The key as a DNS record holds it."""

    def der(tag: int, content: bytes) -> bytes:
        size = len(content)
        width = (size.bit_length() + 7) // 8
        return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x80 | width]) + size.to_bytes(width, "big")) + content

    number = lambda n: der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))
    bare = der(0x30, number(_P * _Q) + number(_E))
    rsa = der(0x30, bytes.fromhex("06092a864886f70d0101010500"))
    return base64.b64encode(der(0x30, rsa + der(3, b"\0" + bare))).decode()


def _power(m: int, e: int, bits: int) -> int:
    """m to the power of e modulo the Mersenne prime of so many bits: what stands above these is added to what stands below."""
    prime = (1 << bits) - 1
    powers = [1]
    for _ in range(31):
        powers.append(powers[-1] * m % prime)
    x = 1
    for place in range((e.bit_length() - 1) // 5 * 5, -1, -5):
        for _ in range(5):
            x *= x
            # Added twice: once leaves a few bits above, and each square would double these.
            x = (x & prime) + (x >> bits)
            x = (x & prime) + (x >> bits)
        x *= powers[e >> place & 31]
        x = (x & prime) + (x >> bits)
        x = (x & prime) + (x >> bits)
    return x % prime


@F.pandas_udf(T.StringType())
def _raised(digests: pd.Series) -> pd.Series:
    """Signatures of SHA-256 digests in hex; null for null."""
    n, at_p, at_q, inverse = _P * _Q, pow(_E, -1, _P - 1), pow(_E, -1, _Q - 1), pow(_Q, -1, _P)
    size = (n.bit_length() + 7) // 8
    start = "0001" + "ff" * (size - 54) + "00" + "3031300d060960864801650304020105000420"

    def raised(m: int) -> int:
        """m to the private exponent: modulo each prime, then put together."""
        by_q = _power(m % _Q, at_q, 607)
        return by_q + (_power(m % _P, at_p, 521) - by_q) * inverse % _P * _Q

    return digests.map(lambda h: base64.b64encode(raised(int(start + h, 16)).to_bytes(size, "big")).decode(), na_action="ignore")


#: A seed that anybody can write down; its key is made of it.
_SEED = bytes(range(32))


@F.pandas_udf(T.StringType())
def _signed_on_curve(digests: pd.Series) -> pd.Series:
    """Ed25519 signatures of SHA-256 digests in hex; null for null."""
    return digests.map(lambda h: base64.b64encode(ed25519.sign(_SEED, bytes.fromhex(h))).decode(), na_action="ignore")


def signed_messages(orders: DataFrame) -> DataFrame:
    """(msg_id, raw_header, body): one signed message for each order; what is wrong with it follows from o_orderkey % 7.

    1 another subject, 2 another body, 3 an unknown key, 4 no signature, 5 missing tags, 6 Ed25519, of these every second
    with another subject and every fifth with the name of an RSA key; every third has no body. The canonical forms are written out here, they are not computed from the messages.
    """
    rows = orders.selectExpr("o_orderkey as k", "o_orderkey % 7 as kind", "case when o_orderkey % 7 = 3 then 'k2' when o_orderkey % 7 = 6 and o_orderkey % 5 > 0 then 'e1' else 'k1' end as selector", "o_custkey % 2 = 0 as rh", "o_custkey % 4 < 2 as rb")
    rows = rows.selectExpr(
        "*",
        "base64(unhex(sha2(if(rb, concat('Hello ', k, '\r\n'), concat('Hello  ', k, ' \r\n')), 256))) as bh",
        "concat('v=1; a=', if(kind = 6, 'ed25519', 'rsa'), '-sha256; c=', if(rh, 'relaxed', 'simple'), '/', if(rb, 'relaxed', 'simple'), '; d=s.example;') as t1",
        "concat('s=', selector, '; h=From:Subject:To; bh=') as t2",
    )
    relaxed = r"concat('from:Signer <u', k, '@s.example>\r\nsubject:order ', k, '\r\ndkim-signature:', t1, ' ', t2, bh, '; b=')"
    simple = r"concat('From:  Signer\r\n\t<u', k, '@s.example>\r\nSubject : order   ', k, '\r\nDKIM-Signature: ', t1, '\r\n ', t2, bh, ';\r\n b=')"
    # What shows no signature isn't signed.
    digest, curve = F.sha2(F.expr(f"if(kind in (4, 5), null, if(rh, {relaxed}, {simple}))"), 256), F.col("kind") == 6
    rows = rows.withColumn("b", F.coalesce(_signed_on_curve(F.when(curve, digest)), _raised(F.when(~curve, digest))))
    signature = r"case kind when 4 then null when 5 then 'DKIM-Signature: v=1; d=s.example; s=k1;\n b=ab cd' else concat('DKIM-Signature: ', t1, '\n ', t2, bh, ';\n b=', substring(b, 1, 60), '\n\t', substring(b, 61)) end"
    head = rf"concat_ws('\n', {signature}, concat('From:  Signer\n\t<u', k, '@s.example>'), concat('Subject : order   ', k, if(kind = 1 or kind = 6 and k % 2 = 0, '!', '')), 'X-Other: unsigned')"
    return rows.selectExpr("cast(k as string) as msg_id", f"{head} as raw_header", r"if(k % 3 = 0, null, concat('Hello  ', k, ' \n', if(kind = 2, 'more', '\n\n'))) as body")


def signing_keys(spark: SparkSession) -> DataFrame:
    curve = base64.b64encode(ed25519.public(_SEED)).decode()
    return spark.createDataFrame([("k1._domainkey.s.example", 0, f"v=DKIM1; p={public_key()}", False), ("e1._domainkey.s.example", 0, f"v=DKIM1; k=ed25519; p={curve}", False)], "name string, seq int, value string, unavailable boolean")


def spf_checks(orders: DataFrame) -> DataFrame:
    """(msg_id, ip, domain, sender, helo): a check for each order; the domain, and with it what is tested, follows from o_orderkey % 12."""
    ip = "if(o_orderkey % 12 = 4, concat('2001:db8:', o_orderkey % 3, '::', o_orderkey % 250), concat('93.184.', o_custkey % 100, '.', o_orderkey % 250))"
    return orders.selectExpr("o_orderkey as msg_id", f"{ip} as ip", "concat('k', o_orderkey % 12, '.example') as domain", "concat('u', o_orderkey % 2, '@k', o_orderkey % 12, '.example') as sender", "'greeting.example' as helo")


def spf_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """DNS tables for ``spf_checks``: chains of ten and eleven includes, a cycle, macros, IPv6, reverse names, names that find nothing, redirections, errors, mail hosts."""
    chain = lambda start, n: [(f"{start}.example", f"v=spf1 include:{start}-1.example -all"), *((f"{start}-{i}.example", f"v=spf1 include:{start}-{i + 1}.example -all" if i < n else "v=spf1 +all") for i in range(1, n + 1))]
    records = [
        *chain("k0", 10), *chain("k1", 11), ("k2.example", "v=spf1 include:k2.example -all"), ("k3.example", "v=spf1 exists:%{ir}.%{v}.%{d1r}-%{l}.listed.example -all"), ("k4.example", "v=spf1 ip4:93.184.0.0/16 ip6:2001:db8:1::/48 ~all"),
        ("k5.example", "v=spf1 ptr:named.example -all"), ("k6.example", "v=spf1 a:nowhere1.example a:nowhere2.example a:nowhere3.example +all"), ("k7.example", "v=spf1 redirect=_%{d}"), ("_k7.example", "v=spf1 ip4:93.184.0.0/17 ?all"),
        ("k8.example", "v=spf1" + " include:k8.example" * 10 + " -all"), ("k9.example", "v=spf1 +all ip4:300.1.1.1"), ("k10.example", "v=spf1 a:host.k10.example/24//64 -all"), ("k11.example", "v=spf1 mx:k11.example/24 ~all"),
    ]
    txt = spark.createDataFrame([(n, 0, v, False) for n, v in records], "name string, seq int, value string, unavailable boolean")
    ips = spark.range(25_000).selectExpr("id % 100 as x", "id div 100 as y")
    listed = ips.where("y % 2 = 0").selectExpr("concat(y, '.', x, '.184.93.in-addr.example-u1.listed.example') as name", "'127.0.0.2' as value", "false as unavailable")
    named = ips.selectExpr("concat('93.184.', x, '.', y) as ip", "concat('h', x, '-', y, if(x % 2 = 0, '.named.example', '.other.example')) as value", "false as unavailable")
    back = ips.where("y % 3 = 0").selectExpr("concat('h', x, '-', y, '.named.example') as name", "concat('93.184.', x, '.', y) as value", "false as unavailable")
    hosts = spark.createDataFrame([("host.k10.example", "93.184.5.200", False), ("in.k11.example", "93.184.7.1", False), ("in2.k11.example", "93.184.9.1", False)], "name string, value string, unavailable boolean")
    mx = spark.createDataFrame([("k11.example", 10, "in.k11.example", False), ("k11.example", 20, "in2.k11.example", False)], "name string, preference int, value string, unavailable boolean")
    return {"dns_txt": txt, "dns_a": listed.unionByName(back).unionByName(hosts), "dns_ptr": named, "dns_mx": mx}


#: Rules for tests, of each kind; the names under them are made of pages' hosts.
SUFFIX_RULES = ("com", "net", "org", "uk", "co.uk", "ar", "com.ar", "*.ck", "!www.ck", "jp", "*.kobe.jp")


def suffix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*((r, False) for r in SUFFIX_RULES), ("example.net", True)], "rule string, private boolean")


def provider_responses(lineitem: DataFrame) -> DataFrame:
    """(l_orderkey, l_linenumber, l_suppkey, l_partkey, provider, kind, ioc, code, body, asked_at): what a provider said for each line item; every ninth code is missing, line 7 has a body that can't be read."""
    body = """case when l_linenumber = 7 then 'no json' when p = 1 then concat('{"data": {"abuseConfidenceScore": ', cast(l_quantity as int) * 2, ', "totalReports": 3}}')
     when p = 2 then concat('{"reputation": "', if(l_quantity < 25, 'low', 'high'), '", "suspicious": ', l_linestatus = 'O', ', "details": {"malicious_activity": ', l_returnflag = 'R', '}}')
     else concat('{"data": {"attributes": {"reputation": 1, "last_analysis_stats": {"malicious": ', l_linenumber % 3, ', "suspicious": 0, "harmless": 60}}}}') end"""
    rows = lineitem.selectExpr("*", "l_suppkey % 3 + 1 as p", "element_at(array(200, 200, 200, 200, 404, 401, 429, 500, null), cast(l_orderkey % 9 as int) + 1) as code")
    return rows.selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "element_at(array('abuseipdb', 'emailrep', 'virustotal'), cast(p as int)) as provider", "element_at(array('ipv4', 'email', 'domain'), cast(p as int)) as kind", "concat('i', l_partkey % 400) as ioc", "code", f"if(code = 200, {body}, null) as body", "cast(l_shipdate as timestamp) as asked_at")


def assessment_rows(orders: DataFrame) -> DataFrame:
    """Rows for ``rules.assess``, one for each order: what is odd about a message follows from bits of o_orderkey and o_custkey.

    By o_orderkey % 6: 0 nothing odd and nothing recorded, 1 nothing odd and all checked, 2 and 3 an eighth, 4 and 5 a quarter of all oddities.
    """
    bit = lambda word, i: f"((shiftright({word}, {i}) & 1) = 1)"
    on = lambda i: bit("odd", i)
    two = lambda word, i, values: f"element_at(array({values}), cast(shiftright({word}, {i}) & 3 as int) + 1)"
    checked = lambda i, good: f"case when not verified then null when {good} then 'verified_pass' when {on(i)} then 'verified_fail' when {bit('v', i + 11)} then 'verified_pass' else 'not_possible' end"
    said, aligned = "'pass', 'fail', 'softfail', 'none'", "'exact', 'organizational', 'mismatch', 'unknown'"
    listed = lambda i, value: f"if({on(i)}, array('{value}'), cast(array() as array<string>))"
    org = lambda i: f"case when {on(i)} then 'b.example' when {bit('x', i)} then 'a.example' end"
    rows = orders.selectExpr("o_orderkey as k", "o_orderkey % 6 as m", "o_orderkey * 2654435761 % 4294967296 as v", "(o_orderkey + o_custkey) * 2246822519 % 4294967296 as w", "(o_orderkey + 3 * o_custkey) * 3266489917 % 4294967296 as x")
    # All oddities of a row in one number, so that what is compiled stays short.
    rows = rows.selectExpr("*", "if(m > 1, v & w & if(m > 3, -1L, x), 0L) as odd")
    rows = rows.selectExpr("*", f"{bit('v', 8)} or m in (1, 2) as verified", f"if(m = 0 or {on(12)}, 0, 3) as n_evidence", f"if({bit('v', 27)}, 3, 0) as n_hops")
    return rows.selectExpr(
        "cast(k as string) as msg_id", "verified", "n_evidence", "n_hops", "'a.example' as from_domain", "'a.example' as from_org", "'e.example' as envelope_domain", "'192.0.2.1' as connecting_ip", "0 as least_delay", "'3 timeout' as unanswered",
        f"{checked(9, 'm = 1')} as spf_outcome", f"{checked(10, 'm = 1')} as dmarc_outcome", f"{checked(11, 'false')} as dkim_outcome",
        *[f"if(n_evidence > 0, {two('w', i, said)}, null) as asserted_{n}" for n, i in (("spf", 20), ("dkim", 22), ("dmarc", 24))],
        f"if(m = 1, 'exact', {two('v', 23, aligned)}) as spf_alignment", f"if(m = 1, 'subdomain', {two('v', 25, aligned)}) as dkim_alignment", f"{listed(13, 'spf')} as untrusted_passes", f"{on(14)} as dmarc_no_record",
        *[f"{org(i)} as {n}_org" for n, i in (("reply_to", 15), ("return_path", 16), ("message_id", 17), ("display", 18))], f"{bit('w', 26)} as message_id_on_route", f"{listed(19, 'subject')} as duplicates",
        f"if({on(27)}, named_struct('matched', 'c.example', 'technique', 'homoglyph'), null) as lookalike", f"if({on(28)}, array('punycode'), array('deep')) as from_flags", f"if({on(29)}, 1, 0) as n_skews",
        f"if(n_hops = 0 or {on(30)}, null, 1) as trusted_hop", f"if({on(31)}, 2, 0) as n_plain_hops", f"{on(8)} as fcrdns_checked", f"{bit('x', 10)} as fcrdns_confirmed", f"{listed(25, 'zone.example')} as listed_zones",
        *[f"if({on(i)}, {n}, 0) as n_{c}" for c, i, n in (("agreed", 20, 1), ("single", 21, 2), ("unanswered", 22, 3))], *[f"if({on(i)}, '{c}@a.example', null) as {c}_email" for c, i in (("poor", 23), ("good", 24))],
    )
