"""DuckDB SQL of the engine's queries.

The expected values come straight from the columns that the messages are made
of; no text is parsed here.
"""

from __future__ import annotations

from headerloom.plans.generator import SUFFIX_RULES

_HOPS = """
WITH h AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS hop,
    CASE l_suppkey % 4 WHEN 0 THEN '10.1.2.' || l_suppkey % 200 WHEN 1 THEN '93.184.' || l_suppkey % 100 || '.' || l_suppkey % 250 WHEN 2 THEN '203.0.113.' || l_suppkey % 250 ELSE '192.168.1.' || l_suppkey % 250 END AS ip,
    CASE l_suppkey % 4 WHEN 1 THEN 'public' WHEN 2 THEN 'documentation' ELSE 'private' END AS ip_class,
    CASE CAST(floor(l_quantity) AS INT) % 3 WHEN 0 THEN '+0000' WHEN 1 THEN '+0300' ELSE '-0500' END AS zone,
    CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) + l_partkey * 7919 % 86400 - CASE CAST(floor(l_quantity) AS INT) % 3 WHEN 0 THEN 0 WHEN 1 THEN 10800 ELSE -18000 END AS sec,
    CASE l_linenumber % 3 WHEN 0 THEN 'SMTP' WHEN 1 THEN 'ESMTPS' ELSE 'ESMTP' END AS protocol
  FROM lineitem l),
p AS (SELECT *, lag(hop) OVER w AS b_hop, lag(sec) OVER w AS b_sec, lag(ip_class) OVER w AS b_class FROM h WINDOW w AS (PARTITION BY l_orderkey ORDER BY hop DESC))
"""

_MAIL = """
mail AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS msg_id, o_custkey AS cust, o_orderstatus AS st, CAST(substring(o_orderpriority, 1, 1) AS INT) AS pri,
    'c' || o_custkey % 40 || '.example' AS org, CASE WHEN o_orderkey % 4 = 0 THEN 'mail.' ELSE '' END || 'c' || o_custkey % 40 || '.example' AS fd
  FROM orders),
m AS (
  SELECT *, CASE k % 5 WHEN 0 THEN 'r' || k % 7 || '.example' WHEN 1 THEN 'reply.' || org END AS reply_to,
    CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN fd WHEN 2 THEN 'bounce.' || org ELSE 'sender' || k % 9 || '.example' END AS return_path,
    CASE WHEN k % 2 = 0 THEN 'ids' || k % 3 || '.example' ELSE fd END AS message_id,
    CASE WHEN pri % 2 = 1 THEN fd ELSE 'other' || k % 5 || '.example' END AS d,
    CASE WHEN k % 17 <> 0 THEN CASE st WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'softfail' END END AS spf,
    CASE WHEN k % 17 <> 0 THEN CASE pri WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' WHEN 3 THEN 'neutral' WHEN 4 THEN 'none' ELSE 'unknown' END END AS dkim,
    CASE WHEN k % 17 <> 0 THEN CASE WHEN st = 'F' THEN 'pass' ELSE 'none' END END AS dmarc,
    k % 3 = 0 AS elsewhere
  FROM mail)
"""
_M = "WITH " + _MAIL.strip()

_ENVELOPE = "coalesce(return_path, CASE WHEN k % 17 <> 0 THEN fd END)"
_ORG_OF = "regexp_extract({0}, '[^.]+\\.[^.]+$')"


def _compare(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'unknown' WHEN {a} = {b} THEN 'exact' WHEN ends_with({a}, '.' || {b}) OR ends_with({b}, '.' || {a}) THEN 'subdomain' WHEN {_ORG_OF.format(a)} = {_ORG_OF.format(b)} THEN 'organizational' ELSE 'mismatch' END"


_RULES = f"""
{_HOPS},
{_MAIL.strip()},
r AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE sec < b_sec) AS skews, bool_or(l_partkey % 3 = 0) AS trusted, bool_or(protocol <> 'ESMTPS') AS plain FROM p GROUP BY 1),
x AS (
  SELECT m.*, coalesce(n, 0) AS n, coalesce(skews, 0) AS skews, coalesce(trusted, false) AS trusted, coalesce(plain, false) AS plain,
    {_compare(_ENVELOPE, "fd")} AS spf_al, {_compare("d", "fd")} AS dkim_al
  FROM m LEFT JOIN r ON l_orderkey = k),
f AS (
  SELECT msg_id, unnest([
    CASE WHEN elsewhere AND (coalesce(spf = 'pass', false) OR coalesce(dkim = 'pass', false) OR coalesce(dmarc = 'pass', false)) THEN {{'id': 'AUTH-004', 'c': 'authentication', 's': 3, 'w': 20}} END,
    CASE WHEN k % 17 = 0 THEN {{'id': 'AUTH-005', 'c': 'authentication', 's': 2, 'w': 12}} END,
    CASE WHEN spf = 'pass' AND spf_al = 'mismatch' THEN {{'id': 'AUTH-006', 'c': 'domain_alignment', 's': 2, 'w': 15}} END,
    CASE WHEN dkim = 'pass' AND dkim_al = 'mismatch' THEN {{'id': 'AUTH-007', 'c': 'domain_alignment', 's': 2, 'w': 15}} END,
    CASE WHEN k % 5 = 0 THEN {{'id': 'IDN-001', 'c': 'sender_identity', 's': 2, 'w': 18}} END,
    CASE WHEN k % 6 >= 3 THEN {{'id': 'IDN-002', 'c': 'sender_identity', 's': 1, 'w': 8}} END,
    CASE WHEN k % 2 = 0 THEN {{'id': 'IDN-003', 'c': 'header_anomalies', 's': 1, 'w': 8}} END,
    CASE WHEN k % 11 = 0 THEN {{'id': 'IDN-005', 'c': 'header_anomalies', 's': 2, 'w': 14}} END,
    CASE WHEN skews > 0 THEN {{'id': 'RTE-001', 'c': 'mail_route', 's': 0, 'w': 3}} END,
    CASE WHEN n > 0 AND NOT trusted THEN {{'id': 'RTE-002', 'c': 'mail_route', 's': 2, 'w': 10}} END,
    CASE WHEN plain THEN {{'id': 'RTE-004', 'c': 'mail_route', 's': 0, 'w': 3}} END,
    CASE WHEN st = 'F' AND k % 17 <> 0 AND k % 5 = 0 THEN {{'id': 'BEC-001', 'c': 'possible_bec', 's': 3, 'w': 28}} END]) AS f
  FROM x),
g AS (SELECT msg_id, f.id AS rule_id, f.c AS category, f.s AS s, f.w AS w FROM f WHERE f IS NOT NULL)
"""

_CAPS = "CASE category WHEN 'authentication' THEN 45 WHEN 'sender_identity' THEN 30 WHEN 'domain_alignment' THEN 25 WHEN 'mail_route' THEN 20 WHEN 'header_anomalies' THEN 15 WHEN 'possible_bec' THEN 30 END"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def _registered(names: str) -> str:
    """o_<names>: the registrable name of each host, from the rules in ``rules``: the longest that fits, an exception before all others."""
    return f"""
l_{names} AS (SELECT *, string_split(host, '.') AS x FROM {names}),
c_{names} AS (SELECT host, len(x) - i + 1 AS n, array_to_string(x[i:], '.') AS s, array_to_string(x[i + 1:], '.') AS above FROM (SELECT host, x, unnest(range(1, len(x) + 1)) AS i FROM l_{names})),
s_{names} AS (SELECT host, coalesce(max(n - 1) FILTER (WHERE '!' || s IN (FROM rules)), max(n) FILTER (WHERE s IN (FROM rules) OR '*.' || above IN (FROM rules))) AS n FROM c_{names} GROUP BY host),
o_{names} AS (SELECT l_{names}.*, n IS NOT NULL AS known, array_to_string(CASE WHEN n IS NULL OR n >= len(x) THEN x[-2:] ELSE x[-(n + 1):] END, '.') AS org FROM l_{names} JOIN s_{names} USING (host))"""


def _suffixed(rules: tuple) -> str:
    values = ", ".join(f"('{r}')" for r in rules)
    ends = "list_extract(['', '.co.uk', '.com.ar', '.www.ck', '.ck', '.x.kobe.jp', '.unknown'], CAST(page_id % 7 + 1 AS INT))"
    return f"WITH rules AS (SELECT * FROM (VALUES {values}) r(rule)), p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || {ends} AS host FROM pages), h AS (SELECT DISTINCT host FROM p), {_registered('h')}, o AS (SELECT page_id, o_h.* FROM p JOIN o_h USING (host))"


_SUFFIXED, _SUFFIXED_PRIVATE = _suffixed(SUFFIX_RULES), _suffixed((*SUFFIX_RULES, "example.net"))

_IPS = """
WITH n AS (SELECT o_orderkey, CAST(o_orderkey::HUGEINT * 2654435761 % 4294967296 AS BIGINT) AS v FROM orders),
ips AS (
  SELECT o_orderkey, v FROM n UNION ALL
  SELECT o_orderkey, CAST(list_extract([167772160, 2130706432, 2851995904, 3758096384, 3221225984, 3325256704, 3232235520, 2886991872, 1681915904, 4026531840, 3221225472, 3323068416], CAST(o_orderkey % 12 + 1 AS INT)) + o_orderkey % 256 AS BIGINT) FROM orders),
t AS (SELECT o_orderkey, v, (v // 16777216) || '.' || (v // 65536 % 256) || '.' || (v // 256 % 256) || '.' || (v % 256) AS ip FROM ips)
"""

_SAID = """
WITH r AS (SELECT *, l_suppkey % 3 AS p, list_extract([200, 200, 200, 200, 404, 401, 429, 500, NULL], CAST(l_orderkey % 9 + 1 AS INT)) AS code FROM lineitem),
s AS (
  SELECT *, list_extract(['abuseipdb', 'emailrep', 'virustotal'], CAST(p + 1 AS INT)) AS provider, list_extract(['ipv4', 'email', 'domain'], CAST(p + 1 AS INT)) AS kind, 'i' || l_partkey % 400 AS ioc,
    CASE WHEN code IS NULL THEN 'timeout' WHEN code = 200 AND l_linenumber <> 7 THEN 'success' WHEN code = 404 AND p > 0 THEN 'unknown' WHEN code = 401 THEN 'invalid_key' WHEN code = 429 THEN 'rate_limited' ELSE 'provider_error' END AS status
  FROM r),
t AS (
  SELECT *, CASE WHEN status = 'success' THEN CASE p WHEN 0 THEN CAST(floor(l_quantity) AS INT) * 2 >= 50 WHEN 1 THEN l_linestatus = 'O' OR l_returnflag = 'R' ELSE l_linenumber % 3 > 0 END END AS malicious,
    CASE WHEN status = 'success' AND p = 1 THEN CASE WHEN l_quantity < 25 THEN 'low' ELSE 'high' END END AS reputation, CASE WHEN status = 'success' AND p = 1 THEN l_linestatus = 'O' END AS suspicious
  FROM s),
w AS (SELECT DISTINCT provider, kind, ioc FROM t),
early AS (
  SELECT *, row_number() OVER (PARTITION BY provider, kind, ioc ORDER BY l_shipdate DESC, malicious, reputation, suspicious NULLS FIRST) AS n FROM t
  WHERE status = 'success' AND l_shipdate <= DATE '1995-06-17' AND l_shipdate > DATE '1995-06-17' - INTERVAL 400 DAY),
kept AS (SELECT * FROM early WHERE n = 1),
late AS (SELECT *, row_number() OVER (PARTITION BY provider, kind, ioc ORDER BY status <> 'success', status, malicious NULLS FIRST, reputation NULLS FIRST, suspicious NULLS FIRST) AS n FROM t WHERE l_shipdate > DATE '1995-06-17')
"""

_BITS = "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS msg_id, o_orderkey % 6 AS m, o_orderkey::BIGINT * 2654435761 % 4294967296 AS v, (o_orderkey + o_custkey)::BIGINT * 2246822519 % 4294967296 AS w, (o_orderkey + 3 * o_custkey)::BIGINT * 3266489917 % 4294967296 AS x FROM orders)"


def _bit(word: str, i: int) -> str:
    return f"({word} // {2**i} % 2 = 1)"


def _on(i: int) -> str:
    """Whether an oddity is there: the bits in all words, or, for m over 3, in two."""
    return f"(m > 1 AND {_bit('v', i)} AND {_bit('w', i)} AND (m > 3 OR {_bit('x', i)}))"


#: (id, category, strength, weight, condition over the columns of ``c``).
_EVERY_RULE = (
    ("AUTH-001", "authentication", 4, 35, "dmarc = 'f'"), ("AUTH-002", "authentication", 3, 25, "spf = 'f'"), ("AUTH-003", "authentication", 3, 22, "dkim = 'f'"), ("AUTH-004", "authentication", 3, 20, _on(13)), ("AUTH-005", "authentication", 2, 12, "silent"),
    ("AUTH-006", "domain_alignment", 2, 15, "(a_spf = 0 OR spf = 'p') AND al_spf = 2"), ("AUTH-007", "domain_alignment", 2, 15, "(a_dkim = 0 OR dkim = 'p') AND al_dkim = 2"),
    ("AUTH-008", "authentication", 3, 25, " OR ".join(f"(a_{n} = 0 AND {n} = 'f') OR (a_{n} IN (1, 2) AND {n} = 'p')" for n in ("spf", "dkim", "dmarc"))), ("AUTH-009", "authentication", 1, 5, _on(14)),
    ("AUTH-010", "authentication", 0, -18, "spf = 'p' AND dmarc = 'p' AND (al_spf < 2 OR al_dkim < 2)"), ("IDN-001", "sender_identity", 2, 18, _on(15)), ("IDN-002", "sender_identity", 1, 8, _on(16)),
    ("IDN-003", "header_anomalies", 1, 8, f"{_on(17)} AND NOT {_bit('w', 26)}"), ("IDN-004", "impersonation", 3, 25, _on(18)), ("IDN-005", "header_anomalies", 2, 14, _on(19)), ("IMP-001", "impersonation", 3, 30, _on(27)), ("IMP-002", "impersonation", 2, 18, _on(28)),
    ("RTE-001", "mail_route", 0, 3, _on(29)), ("RTE-002", "mail_route", 2, 10, f"hops AND {_on(30)}"), ("RTE-003", "mail_route", 1, 7, f"{_on(8)} AND NOT {_bit('x', 10)}"), ("RTE-004", "mail_route", 0, 3, _on(31)),
    ("TI-001", "threat_intelligence", 3, 25, _on(25)), ("TI-002", "threat_intelligence", 4, 35, _on(20)), ("TI-003", "threat_intelligence", 2, 15, _on(21)), ("TI-004", "threat_intelligence", 0, 0, _on(22)),
    ("REP-001", "email_reputation", 2, 18, _on(23)), ("REP-002", "email_reputation", 0, -10, _on(24)), ("BEC-001", "possible_bec", 3, 28, f"(a_dmarc = 0 OR dmarc = 'p' OR a_spf = 0 OR spf = 'p') AND ({_on(15)} OR {_on(27)} OR {_on(18)})"),
)
_EVERY_CAP = "CASE category WHEN 'authentication' THEN 45 WHEN 'threat_intelligence' THEN 40 WHEN 'impersonation' THEN 35 WHEN 'sender_identity' THEN 30 WHEN 'possible_bec' THEN 30 WHEN 'domain_alignment' THEN 25 WHEN 'header_anomalies' THEN 15 ELSE 20 END"


def _outcome(i: int, good: str) -> str:
    return f"CASE WHEN NOT verified THEN '-' WHEN {good} THEN 'p' WHEN {_on(i)} THEN 'f' WHEN {_bit('v', i + 11)} THEN 'p' ELSE '-' END"


def _exits() -> str:
    rows = ", ".join(f"CASE WHEN {when} THEN {{'id': '{i}', 'c': '{c}', 's': {s}, 'w': {w}}} END" for i, c, s, w, when in _EVERY_RULE)
    claim = lambda i: f"CASE WHEN silent THEN 9 ELSE w // {2**i} % 4 END"
    has = lambda *ids: " OR ".join(f"bool_or(id = '{i}')" for i in ids)
    return f"""{_BITS},
b AS (SELECT *, {_bit("v", 8)} OR m IN (1, 2) AS verified, m = 0 OR {_on(12)} AS silent, {_bit("v", 27)} AS hops FROM o),
c AS (SELECT *, {_outcome(9, "m = 1")} AS spf, {_outcome(10, "m = 1")} AS dmarc, {_outcome(11, "false")} AS dkim, {claim(20)} AS a_spf, {claim(22)} AS a_dkim, {claim(24)} AS a_dmarc,
  CASE WHEN m = 1 THEN 0 ELSE v // {2**23} % 4 END AS al_spf, CASE WHEN m = 1 THEN 1 ELSE v // {2**25} % 4 END AS al_dkim FROM b),
f AS (SELECT msg_id, unnest([{rows}]) AS f FROM c),
g AS (SELECT msg_id, f.id AS id, f.c AS category, f.s AS s, f.w AS w FROM f WHERE f IS NOT NULL),
k AS (SELECT msg_id, category, least(coalesce(sum(w) FILTER (WHERE w > 0), 0), {_EVERY_CAP}) AS up, coalesce(sum(w) FILTER (WHERE w < 0), 0) AS down, coalesce(bool_or(w > 0), false) AS any_up FROM g GROUP BY msg_id, category),
t AS (SELECT msg_id, least(100, greatest(0, sum(up) + sum(down))) AS score, count(*) FILTER (WHERE any_up) AS n FROM k GROUP BY 1),
h AS (SELECT msg_id, string_agg(id, ',' ORDER BY id) AS rules, {has("AUTH-001", "AUTH-002", "AUTH-003", "AUTH-004")} AS bad, {has("TI-001", "TI-002", "TI-003")} AS known, {has("TI-002")} AS agreed, {has("IMP-001", "IDN-004")} AS posing, {has("AUTH-010")} AS clean, {has("BEC-001")} AS bec,
  bool_or(s > 1) AS loud, bool_or(s > 1 AND id NOT IN ('AUTH-005', 'AUTH-009', 'RTE-002', 'TI-004')) AS solid FROM g GROUP BY 1),
e AS (SELECT msg_id, coalesce(CAST(score AS INT), 0) AS score, coalesce(n, 0) AS n, coalesce(rules, '') AS rules, verified, CASE
  WHEN silent AND NOT verified AND NOT hops AND NOT coalesce(solid, false) THEN 'inconclusive insufficient-evidence' WHEN bec THEN 'possible_bec authenticated-but-inconsistent-identity' WHEN bad AND (known OR posing) THEN 'likely_phishing auth-failure-with-corroboration'
  WHEN agreed AND NOT clean THEN 'likely_phishing multi-provider-consensus' WHEN clean AND known THEN 'suspicious trusted-auth-with-adverse-intel-dampened' WHEN clean AND NOT loud THEN 'likely_legitimate verified-aligned-and-clean'
  WHEN score >= 50 THEN 'likely_phishing' WHEN score >= 25 THEN 'suspicious' WHEN silent AND NOT verified THEN 'inconclusive nothing-established' ELSE 'likely_legitimate' END AS way
  FROM c LEFT JOIN t USING (msg_id) LEFT JOIN h USING (msg_id))
SELECT msg_id, score, string_split(way, ' ')[1] AS verdict, string_split(way, ' ')[2] AS pattern, CASE WHEN verified AND n >= 3 THEN 'high' WHEN n >= 3 OR verified AND n >= 1 THEN 'medium' ELSE 'low' END AS confidence, rules FROM e"""


ORACLE_SQL: dict[str, str] = {
    "risk_exits": _exits(),
    "route_transit": f"{_HOPS} SELECT CAST(o_orderkey AS VARCHAR) AS msg_id, count(hop) AS n_hops, CAST(sum(sec - b_sec) FILTER (WHERE sec >= b_sec) AS DOUBLE) AS transit, count(*) FILTER (WHERE sec < b_sec) AS n_skews FROM orders LEFT JOIN p ON l_orderkey = o_orderkey GROUP BY 1",
    "route_hops": f"{_HOPS} SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, hop AS hop_idx, 'h' || l_suppkey || '.example.net' AS from_host, 'r' || l_suppkey || '.example.org' AS from_rdns, 'mx' || l_partkey % 5 || CASE WHEN l_partkey % 3 = 0 THEN '.corp.example' ELSE '.relay.example' END AS by_host, protocol, 'q' || l_partkey AS queue_id, '<u' || l_suppkey || '@to.example>' AS for_recipient, ip AS primary_ip, ip_class AS primary_ip_class, sec AS unix_seconds, zone AS original_offset FROM h",
    "route_tls": f"{_HOPS} SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, count(*) FILTER (WHERE protocol = 'ESMTPS') AS n_tls, count(*) FILTER (WHERE protocol <> 'ESMTPS') AS n_plain FROM h GROUP BY 1",
    "route_delays": f"{_HOPS} SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, b_hop AS from_hop, hop AS to_hop, CAST(sec - b_sec AS DOUBLE) AS seconds, sec < b_sec AS is_clock_skew, sec - b_sec > 3600 AS is_late FROM p WHERE b_sec IS NOT NULL",
    "route_trust_boundary": f"{_HOPS}, t AS (SELECT l_orderkey, max(hop) FILTER (WHERE l_partkey % 3 = 0) AS hop, arg_max(ip, hop) FILTER (WHERE l_partkey % 3 = 0) AS ip, arg_max(ip, hop) AS first_ip FROM h GROUP BY 1) SELECT CAST(o_orderkey AS VARCHAR) AS msg_id, coalesce(hop, -1) AS trusted_hop, CASE WHEN hop IS NULL THEN 'low' ELSE 'high' END AS boundary_confidence, coalesce(ip, first_ip) AS connecting_ip FROM orders LEFT JOIN t ON l_orderkey = o_orderkey",
    "route_internal_to_public": f"{_HOPS} SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, count(*) AS n_crossings FROM p WHERE b_class = 'private' AND ip_class = 'public' GROUP BY 1",
    "header_fields": f"{_HOPS}, {_MAIL.strip()}, r AS (SELECT l_orderkey, count(*) AS n FROM h GROUP BY 1) SELECT msg_id, coalesce(n, 0) + 6 + (k % 5 < 2)::INT + (k % 11 = 0)::INT + (k % 13 = 0)::INT + (k % 17 <> 0)::INT + k % 3 AS n_fields, coalesce(n, 0) AS n_received, CASE k % 3 WHEN 0 THEN '\"Customer, No. ' || cust || '\" <u' || cust || '@' || fd || '>' WHEN 1 THEN 'u' || cust || '@' || fd ELSE 'Customer ' || cust || ' <u' || cust || '@' || upper(fd) || '>' END AS from_value, 'v=1; d=' || d || '; s=s1; b=ab cd' AS signature FROM m LEFT JOIN r ON l_orderkey = k",
    "header_duplicates": f"{_M} SELECT msg_id, 'subject' AS name_lc, CAST(2 AS BIGINT) AS n FROM m WHERE k % 11 = 0",
    "header_unparsable": f"{_M} SELECT msg_id, 'no_colon' AS kind, 'this line has no colon' AS normalized_value FROM m WHERE k % 13 = 0",
    "auth_evidence": f"""{_M}, e AS (SELECT *, unnest(['spf', 'dkim', 'dmarc']) AS method FROM m WHERE k % 17 <> 0) SELECT msg_id, method, CASE method WHEN 'spf' THEN spf WHEN 'dkim' THEN dkim ELSE dmarc END AS result, CASE WHEN elsewhere THEN 'mx.elsewhere.example' ELSE 'mx.corp.example' END AS asserted_by, CASE WHEN elsewhere THEN 'untrusted' ELSE 'trusted' END AS trust, CASE method WHEN 'spf' THEN CASE WHEN k % 23 = 0 THEN '"x; dmarc=pass y"' ELSE 'b' END || '@' || fd END AS mailfrom, CASE method WHEN 'dkim' THEN d END AS header_d, CASE method WHEN 'dmarc' THEN fd END AS header_from, CASE method WHEN 'spf' THEN CASE WHEN k % 29 = 0 THEN 'checked; ((((deep; dkim=pass)) \\) "))' ELSE 'checked; here' END WHEN 'dkim' THEN CASE WHEN k % 19 = 0 THEN 'odd; spf=pass "here"' END END AS reason FROM e""",
    "auth_trust": f"{_M}, e AS (SELECT *, unnest(['spf', 'dkim', 'dmarc']) AS method FROM m WHERE k % 17 <> 0) SELECT CASE WHEN elsewhere THEN 'untrusted' ELSE 'trusted' END AS trust, method, CASE method WHEN 'spf' THEN spf WHEN 'dkim' THEN dkim ELSE dmarc END AS result, count(*) AS n FROM e GROUP BY ALL",
    "auth_alignment": f"{_M} SELECT msg_id, fd AS from_domain, {_ENVELOPE} AS envelope_domain, {_compare(_ENVELOPE, 'fd')} AS spf_alignment, {_compare('d', 'fd')} AS dkim_alignment, d AS dkim_domains FROM m",
    "auth_arc_latest": f"{_M} SELECT msg_id, k % 3 AS n_seals, CAST(k % 3 AS INT) AS newest, CASE WHEN k % 3 = 1 THEN 'none' WHEN k % 2 = 0 THEN 'pass' ELSE 'fail' END AS cv FROM m WHERE k % 3 > 0",
    "dkim_domains": f"{_M} SELECT msg_id, d FROM m",
    "identity_compare": f"{_M}, i AS (SELECT msg_id, fd, unnest(['return-path', 'reply-to', 'message-id']) AS header, unnest([return_path, reply_to, message_id]) AS other FROM m) SELECT msg_id, header, fd AS left_domain, other AS right_domain, {_compare('fd', 'other')} AS result FROM i WHERE other IS NOT NULL",
    "vendor_decode": f"""{_M}, v AS (SELECT msg_id, unnest(['CIP', 'SCL', 'CAT', 'SFV']) AS code, unnest(['203.0.113.' || k % 250, list_extract(['-1', '0', '1', '5', '6', '9', '7'], CAST(k % 7 + 1 AS INT)), CASE WHEN k % 2 = 0 THEN 'PHSH' ELSE 'NONE' END, CASE WHEN k % 4 = 0 THEN 'NSPM' ELSE 'ODD' END]) AS value FROM m)
SELECT msg_id, code, value, CASE code WHEN 'CIP' THEN '' WHEN 'SCL' THEN CASE value WHEN '-1' THEN 'spam filtering was skipped' WHEN '0' THEN 'not spam' WHEN '1' THEN 'not spam' WHEN '5' THEN 'spam' WHEN '6' THEN 'spam' WHEN '9' THEN 'high-confidence spam' ELSE 'unrecognised SCL value' END WHEN 'CAT' THEN CASE value WHEN 'PHSH' THEN 'phishing' ELSE 'no category' END ELSE CASE value WHEN 'NSPM' THEN 'clean' ELSE 'unrecognised SFV value' END END AS meaning FROM v""",
    "ioc_dedupe": f"{_HOPS} SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, ip AS normalized, count(*) AS occurrences, any_value(ip_class) AS ip_class, any_value(ip_class) = 'public' AS eligible, replace(ip, '.', '[.]') AS defanged FROM h GROUP BY ALL",
    "ip_extract": f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\w.]+')) AS ip FROM documents) SELECT DISTINCT doc_id, ip FROM t WHERE regexp_full_match(ip, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')",
    "ip_classify": f"""{_IPS} SELECT o_orderkey, ip, CASE WHEN v = 0 THEN 'unspecified' WHEN v // 16777216 = 127 THEN 'loopback' WHEN v // 65536 = 43518 THEN 'link_local' WHEN v // 268435456 = 14 THEN 'multicast' WHEN v // 256 IN (12582914, 12989284, 203 * 65536 + 113) THEN 'documentation'
 WHEN v IN (3221225481, 3221225482) THEN 'public' WHEN v // 16777216 IN (0, 10) OR v // 1048576 = 2753 OR v // 256 = 12582912 OR v // 65536 = 49320 OR v // 131072 = 25353 OR v // 268435456 = 15 THEN 'private' WHEN v // 4194304 = 401 THEN 'reserved' ELSE 'public' END AS class FROM t""",
    "rfc2047": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS decoded FROM documents",
    "auth_spoofed_name": "SELECT CAST(o_orderkey AS VARCHAR) AS msg_id, 'other' || o_orderkey % 7 || '.example' AS from_domain, CASE o_orderkey % 3 WHEN 0 THEN 'bounce' || o_orderkey % 5 || '.example' END AS envelope_domain, CASE WHEN o_orderkey % 3 = 0 THEN 'mismatch' ELSE 'unknown' END AS spf_alignment FROM orders",
    "dnsbl_name": f"{_IPS} SELECT o_orderkey, ip, (v % 256) || '.' || (v // 256 % 256) || '.' || (v // 65536 % 256) || '.' || (v // 16777216) || '.zen.spamhaus.org' AS name FROM t",
    "url_host": f"SELECT page_id, lower({_HOST}) AS host FROM pages",
    "domain_normalize": f"SELECT page_id, lower({_HOST}) AS domain FROM pages",
    "domain_org": f"{_SUFFIXED} SELECT page_id, host, org, known, len(x) - len(string_split(org, '.')) AS depth FROM o",
    "domain_compare": f"""{_SUFFIXED_PRIVATE},
b AS (SELECT page_id, host AS a, CASE page_id % 6 WHEN 0 THEN host WHEN 1 THEN 'x.' || host WHEN 2 THEN 'y.' || array_to_string(x[-2:], '.') WHEN 3 THEN 'y.' || array_to_string(x[-3:], '.') WHEN 4 THEN array_to_string(x[-2:], '.') ELSE 'other.example' END AS b FROM o),
n AS (SELECT DISTINCT host FROM (SELECT a AS host FROM b UNION SELECT b FROM b)), {_registered("n")}
SELECT page_id, a, b, CASE WHEN a = b THEN 'exact' WHEN l.org <> r.org THEN 'mismatch' WHEN ends_with(a, '.' || b) OR ends_with(b, '.' || a) THEN 'subdomain' ELSE 'organizational' END AS result FROM b JOIN o_n l ON l.host = a JOIN o_n r ON r.host = b""",
    "domain_skeleton": "WITH n AS (SELECT n_nationkey, lower(replace(n_name, ' ', '')) AS x FROM nation), f AS (SELECT n_nationkey, unnest(range(5)) AS form, unnest([x, x[1] || x, x || '-pay', translate(x, 'ols', '015'), 'x' || x || 'yz']) AS label FROM n) SELECT n_nationkey, form, translate(label || '.example', '015', 'ols') AS skeleton FROM f",
    "domain_lookalike": """WITH n AS (SELECT lower(replace(n_name, ' ', '')) AS x FROM nation), f AS (SELECT DISTINCT unnest([x, x[1] || x, x || '-pay', translate(x, 'ols', '015'), 'x' || x || 'yz']) AS raw FROM n),
w AS (SELECT unnest([1, 2, 3]) AS o, unnest(['nation_7', 'nation_12', 'nation_21']) AS t), s AS (SELECT raw, translate(raw, '015', 'ols') AS a, o, t, translate(t, '015', 'ols') AS b FROM f, w WHERE raw <> t),
k AS (SELECT raw, o, t, CASE WHEN a = b THEN 'homoglyph' WHEN levenshtein(a, b) = 1 OR levenshtein(a, b) = 2 AND length(b) >= 7 THEN 'edit-distance' WHEN contains(raw, t) THEN 'embedded-brand' END AS technique FROM s)
SELECT raw || '.example' AS domain, arg_min(t, o) || '.example' AS matched, arg_min(technique, o) AS technique FROM k WHERE technique IS NOT NULL GROUP BY raw""",
    "domain_watched": """WITH e AS (SELECT n_nationkey AS rank, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS x FROM nation UNION ALL SELECT s_suppkey + 100, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') FROM supplier),
f AS (SELECT DISTINCT unnest([x, x[1] || x, x || '-pay', translate(x, 'ols', '015'), 'x' || x || 'yz', x[2:] || 'q']) AS raw FROM e),
s AS (SELECT raw, translate(raw, '015', 'ols') AS a, rank, x AS t, translate(x, '015', 'ols') AS b FROM f, e WHERE raw <> x),
k AS (SELECT raw, rank, t, CASE WHEN a = b THEN 'homoglyph' WHEN length(t) >= 4 AND levenshtein(a, b) = 1 OR length(t) >= 7 AND levenshtein(a, b) = 2 THEN 'edit-distance' WHEN length(t) >= 4 AND contains(raw, t) THEN 'embedded-brand' END AS technique FROM s)
SELECT 'mail.' || raw || '.example' AS domain, arg_min(t, rank) || '.example' AS matched, arg_min(technique, rank) AS technique FROM k WHERE technique IS NOT NULL GROUP BY raw""",
    "ioc_email": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\w.+-])([a-zA-Z0-9._%+-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+)', 1)) AS e FROM documents) SELECT doc_id, lower(e) AS email, count(*) AS n FROM t GROUP BY ALL",
    "ioc_url": "WITH t AS (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, '(?i)(?:https?|hxxps?)://[^\\s<>\"''\\])]+')) AS u FROM pages) SELECT page_id, u AS url, count(*) AS n FROM t GROUP BY ALL",
    "ioc_defang": "SELECT page_id, 'hxxp' || substring(replace(url, '.', '[.]'), 5) AS defanged FROM pages",
    "intel_topk": "WITH i AS (SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, list_extract(['url', 'email', 'domain'], l_linenumber % 3 + 1) AS kind, 'i' || l_partkey % 50 AS normalized, min(l_partkey % 50) AS place, bool_and(l_suppkey % 5 <> 0) AS ok FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY msg_id, kind ORDER BY place) AS n FROM i WHERE ok) SELECT msg_id, kind, normalized FROM r WHERE n <= CASE kind WHEN 'email' THEN 2 ELSE 1 END",
    "intel_consensus": "SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, 'domain' AS kind, 'i' || l_partkey % 3 AS ioc, count(DISTINCT l_suppkey % 3) AS n_providers, string_agg(DISTINCT list_extract(['abuseipdb', 'emailrep', 'virustotal'], CAST(l_suppkey % 3 + 1 AS INT)), ',' ORDER BY list_extract(['abuseipdb', 'emailrep', 'virustotal'], CAST(l_suppkey % 3 + 1 AS INT))) AS providers FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' GROUP BY 1, 2, 3",
    "intel_responses": f"{_SAID} SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, provider, status, CAST(malicious AS VARCHAR) AS malicious, reputation, CAST(suspicious AS VARCHAR) AS suspicious FROM t",
    "intel_reuse": f"{_SAID} SELECT w.provider, w.kind AS ioc_type, w.ioc, coalesce(k.status, l.status, 'disabled') AS status, CAST(CASE WHEN k.status IS NOT NULL THEN k.malicious ELSE l.malicious END AS VARCHAR) AS malicious, k.status IS NOT NULL AS cached FROM w LEFT JOIN kept k ON k.provider = w.provider AND k.kind = w.kind AND k.ioc = w.ioc LEFT JOIN late l ON l.provider = w.provider AND l.kind = w.kind AND l.ioc = w.ioc AND l.n = 1",
    "intel_to_ask": f"{_SAID} SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.provider = w.provider AND k.kind = w.kind AND k.ioc = w.ioc)",
    "spf_verify": """WITH c AS (SELECT o_orderkey AS msg_id, o_custkey % 40 AS n, o_orderkey % 3 AS i, o_orderkey % 256 AS x FROM orders),
r AS (SELECT msg_id, CASE WHEN n % 10 = 4 AND n % 4 <> 3 THEN 'temperror' WHEN n % 4 = 3 THEN 'none' WHEN n % 4 = 0 THEN CASE WHEN i = 0 THEN 'pass' ELSE 'fail' END WHEN n % 4 = 1 THEN CASE WHEN i = 1 AND x >= 128 THEN 'pass' ELSE 'softfail' END ELSE CASE WHEN i = 0 THEN 'pass' ELSE 'neutral' END END AS result FROM c)
SELECT msg_id, result, CASE result WHEN 'pass' THEN 'verified_pass' WHEN 'temperror' THEN 'error' WHEN 'none' THEN 'not_possible' WHEN 'neutral' THEN 'not_possible' ELSE 'verified_fail' END AS outcome FROM r""",
    "spf_budget": """WITH c AS (SELECT o_orderkey AS msg_id, o_orderkey % 12 AS kind, o_custkey % 100 AS x, o_orderkey % 250 AS y, o_orderkey % 3 AS z, o_orderkey % 2 AS u FROM orders)
SELECT msg_id, CASE WHEN kind = 0 THEN 'pass' WHEN kind IN (1, 2, 6, 8, 9) THEN 'permerror' WHEN kind = 3 THEN CASE WHEN y % 2 = 0 AND u = 1 THEN 'pass' ELSE 'fail' END WHEN kind = 4 THEN CASE WHEN z = 1 THEN 'pass' ELSE 'softfail' END
 WHEN kind = 5 THEN CASE WHEN x % 2 = 0 AND y % 3 = 0 THEN 'pass' ELSE 'fail' END WHEN kind = 7 THEN CASE WHEN x < 128 THEN 'pass' ELSE 'neutral' END WHEN kind = 10 THEN CASE WHEN x = 5 THEN 'pass' ELSE 'fail' END ELSE CASE WHEN x IN (7, 9) THEN 'pass' ELSE 'softfail' END END AS result FROM c""",
    "header_warnings": "SELECT CAST(o_orderkey AS VARCHAR) AS msg_id, 'header' AS part, 'duplicate' AS code, 'subject' AS detail FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'field', 'no_colon', 'this line has no colon' FROM orders WHERE o_orderkey % 13 = 0",
    "dkim_verify": "WITH c AS (SELECT o_orderkey AS k, o_orderkey % 7 AS kind, o_orderkey % 3 <> 0 AS body FROM orders) SELECT CAST(k AS VARCHAR) AS msg_id, CASE WHEN kind <> 4 THEN 's.example' END AS domain, CASE WHEN kind = 3 THEN 'k2' WHEN kind = 6 AND k % 5 > 0 THEN 'e1' WHEN kind <> 4 THEN 'k1' END AS selector, CASE WHEN kind = 4 THEN NULL WHEN body THEN 'fields and body' ELSE 'fields' END AS scope, CASE WHEN kind = 4 THEN 'not_possible' WHEN kind = 5 THEN 'error' WHEN kind IN (1, 3) OR kind = 2 AND body OR kind = 6 AND (k % 2 = 0 OR k % 5 = 0) THEN 'verified_fail' ELSE 'verified_pass' END AS outcome FROM c",
    "dmarc_verify": "WITH c AS (SELECT o_orderkey AS msg_id, o_custkey % 40 AS n, o_orderstatus = 'F' AS spf, o_orderkey % 3 AS al FROM orders), r AS (SELECT *, n % 3 <> 2 AS has, n % 3 <> 2 AND n % 10 = 6 AS failed FROM c) SELECT msg_id, CASE WHEN has AND NOT failed THEN CASE WHEN n % 2 = 0 THEN 'reject' ELSE 'quarantine' END END AS policy, CASE WHEN failed THEN 'error' WHEN NOT has THEN 'not_possible' WHEN spf AND (al = 0 OR al = 1 AND n % 3 <> 1) THEN 'verified_pass' ELSE 'verified_fail' END AS outcome FROM r",
    "fcrdns": f"{_HOPS}, s AS (SELECT DISTINCT ip, ip_class, l_suppkey % 100 AS x, l_suppkey % 250 AS y FROM h), k AS (SELECT DISTINCT s % 100 AS x, s % 250 AS y FROM range(100000) t(s) WHERE s % 4 = 1 AND s % 3 <> 0) SELECT DISTINCT s.ip, ip_class = 'public' AS checked, ip_class = 'public' AND k.x IS NOT NULL AND s.y % 2 = 0 AS confirmed FROM s LEFT JOIN k ON s.x = k.x AND s.y = k.y",
    "dnsbl": f"{_HOPS}, s AS (SELECT DISTINCT ip, l_suppkey % 100 AS x, l_suppkey % 250 AS y FROM h WHERE ip_class = 'public'), k AS (SELECT DISTINCT s % 100 AS x, s % 250 AS y FROM range(100000) t(s) WHERE s % 4 = 1 AND s % 3 <> 0) SELECT ip, CASE WHEN y % 2 = 0 THEN 'zen.spamhaus.org' ELSE 'bl.spamcop.net' END AS zones FROM s JOIN k USING (x, y) WHERE y % 5 = 0",
    "rule_findings": f"{_RULES} SELECT msg_id, rule_id, CAST(w AS INT) AS weight, CASE s WHEN 3 THEN 'medium' ELSE 'low' END AS confidence FROM g",
    "risk_score": f"""{_RULES}, c AS (SELECT msg_id, category, least(sum(w), {_CAPS}) AS w FROM g GROUP BY msg_id, category), t AS (SELECT msg_id, least(100, sum(w)) AS score, count(*) AS cats FROM c GROUP BY 1),
b AS (SELECT msg_id, bool_or(rule_id = 'BEC-001') AS bec, bool_or(s >= 2 AND rule_id NOT IN ('AUTH-005', 'RTE-002')) AS substantive FROM g GROUP BY 1)
SELECT x.msg_id, CAST(coalesce(score, 0) AS INT) AS score, CASE WHEN x.k % 17 = 0 AND x.n = 0 AND NOT coalesce(substantive, false) THEN 'inconclusive' WHEN coalesce(bec, false) THEN 'possible_bec' WHEN coalesce(score, 0) >= 50 THEN 'likely_phishing' WHEN coalesce(score, 0) >= 25 THEN 'suspicious' WHEN x.k % 17 = 0 THEN 'inconclusive' ELSE 'likely_legitimate' END AS verdict, CASE WHEN coalesce(cats, 0) >= 3 THEN 'medium' ELSE 'low' END AS confidence
FROM x LEFT JOIN t USING (msg_id) LEFT JOIN b USING (msg_id)""",
    "fleet_findings": f"{_RULES}, n AS (SELECT msg_id, category, list_extract(['informational', 'weak', 'moderate', 'strong'], s + 1) AS strength FROM g) SELECT category, strength, count(*) AS n, count(DISTINCT msg_id) AS n_messages FROM n GROUP BY CUBE (category, strength)",
}
