"""URLs, messages, addresses and headers on known examples."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from threatlake import fixed_values_phishing as P
from threatlake.functions.patterns import required_literals
from threatlake.functions.signals import signal_ids
from threatlake.operators.domains import with_registrable
from threatlake.operators.emails import assess_emails, extract_emails
from threatlake.operators.headers import header_risk
from threatlake.operators.text import scan_text
from threatlake.operators.urls import scan_urls
from threatlake.operators.headers import mail_links
from threatlake.sources.mail import parse_messages, read_mail

URLS = {
    "https://www.google.com": (None, 0),
    "https://secure-paypal-login-example.com/verify": ("brand-credential-lure", 87),
    "http://example.com": ("no-https", 10),
    "https://paypa1.com": ("homoglyph", 50),
    "https://payapl.com": ("typosquat", 45),
    "https://pay-pal-security.com": ("brand-in-domain", 50),
    "https://paypal.com": (None, 0),
    "https://paypal.com.tr": ("brand-wrong-domain", 45),
    "https://paypal.github.io": ("brand-wrong-domain", 45),
    "https://раypal.com": ("mixed-script", None),
    "https://example.com/%ZZ": ("malformed-encoding", 30),
    "https://example.com/%0d%0a%00": ("suspicious-characters", 25),
    "https://example.com/out/https%3A%2F%2Fevil.example%2Flogin": ("external-redirect", None),
    "https://mail.google.com/mail/u/0/?view=cm&to=a%40b.com&body=see+https%3A%2F%2Fexample.org%2Flogin": (None, None),
    "not a valid URL": ("invalid-url", 30),
    "https://a.b.c.d.e.example.com": ("many-subdomains", 25),
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: (r.ids.split(","), r.score) for r in scan_urls(df).select("url", signal_ids("signals").alias("ids"), "score").collect()}
    for url, (signal, score) in URLS.items():
        if signal:
            assert signal in got[url][0], url
        if score is not None:
            assert got[url][1] == score, url
    assert "external-redirect" not in got["https://mail.google.com/mail/u/0/?view=cm&to=a%40b.com&body=see+https%3A%2F%2Fexample.org%2Flogin"][0]


def test_registrable(spark):
    want = {"login.paypal.com.tr": "paypal.com.tr", "paypal.github.io": "paypal.github.io", "a.b.co.uk": "b.co.uk", "10.0.0.1": "10.0.0.1", "www.ck": "www.ck", "x.y.foo.ck": "y.foo.ck"}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: r.registrable for r in with_registrable(df, "host").collect()} == want


MESSAGES = {
    "Your OTP is 482913. Do not share this OTP with anyone.": (set(), "safe"),
    "Do not ignore this. Share your OTP now.": ({"otp-share"}, None),
    "Y0ur acc0unt will be bl0cked. Share y0ur 0TP n0w": ({"obfuscation-leet", "account-threat", "otp-share"}, None),
    "Your account is blocked. Share the o t p now": ({"obfuscation-spaced-letters", "otp-share"}, None),
    "Verify yоur ОТP immediately": ({"obfuscation-mixed-script", "credential-request"}, None),
    "Ver​ify your O​T​P": ({"obfuscation-hidden-chars", "credential-request"}, None),
    "Your SBI account will be blocked. Update now: http://secure-update.example.xyz/kyc": ({"brand-link-mismatch"}, None),
    "URGENT: your account will be suspended. Call 1800 123 4567 immediately": ({"pressure-plus-callback"}, None),
    "Dear customer, your SBI KYC is pending. Update immediately or your account will be blocked. Share OTP to verify: http://sbi-kyc-update.top/login": ({"multi-tactic"}, "dangerous"),
    "Hey, are we still meeting for lunch tomorrow?": (set(), "safe"),
}


def test_messages(spark):
    df = spark.createDataFrame(list(enumerate(MESSAGES)), "id long, text string")
    for r in scan_text(df, "id").select("text", signal_ids("signals").alias("ids"), "level").collect():
        signals, level = MESSAGES[r.text]
        assert signals <= set(r.ids.split(",")), r.text
        assert level in (None, r.level), r.text


def test_required_literals_lose_no_match():
    """Every sample that a rule matches passes its substring test."""
    samples = [m for m in MESSAGES] + ["act now", "within 2 hours", "you've won a prize", "kyc is pending", "gift cards: buy them", "earn 5,000 per day"]
    for _, _, _, _, hindi, pattern in P.SCAM_RULES:
        for s in samples:
            if re.search(pattern, s, 0 if hindi else re.I):
                assert all(any(x in s.lower() for x in group) for group in required_literals(pattern))


EMAILS = [
    ("john [at] example [dot] com", "example.com", "obfuscated", "suspicious"),
    ("Reach support@example.com", "www.example.com", "", "matches-site"),
    ("jane.doe@gmail.com", "example.com", "", "external"),
    ("x@mailinator.com", "example.com", "disposable-domain", "suspicious"),
    ("john@gmial.com", "example.com", "freemail-typo", "suspicious"),
    ("help@examplee.com", "www.example.com", "resembles-this-site", "suspicious"),
    ("contact foo@bar", "example.com", "invalid-format", "suspicious"),
    ("paypal.support@gmail.com", "e.com", "brand-in-local-part", "suspicious"),
    ('"PayPal Support" <alerts@random-mail.xyz>', "e.com", "display-name-impersonation", "suspicious"),
]


def test_email_addresses(spark):
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _, _) in enumerate(EMAILS)], "id long, text string, page string")
    found = extract_emails(df, "id").join(df.select("id", "page"), "id")
    rows = assess_emails(found, "page").select("id", signal_ids("signals").alias("ids"), "status").collect()
    assert len(rows) == len(EMAILS)
    for r in rows:
        assert EMAILS[r.id][2] in r.ids and r.status == EMAILS[r.id][3]


def test_headers(spark):
    mails = [
        "From: sender@example.com\nReceived-SPF: softfail (mx.receiver.example: no)\nReceived-SPF: softfail (mx.receiver.example: again)\n",
        "From: noreply@example.com\r\nReturn-Path: <noreply@example.com>\r\nReceived-SPF: softfail (google.com: no)\r\n"
        "Authentication-Results: mx.google.com; spf=softfail smtp.mailfrom=example.com; dmarc=fail header.from=example.com",
    ]
    df = parse_messages(spark.createDataFrame(list(enumerate(mails)), "msg_id long, raw string"))
    assert {r.msg_id: r.risk_score for r in header_risk(df).collect()} == {0: 8, 1: 36}


@pytest.mark.parametrize("raw, error", [
    ("From: a@b.co\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\nnot base64!", "invalid base64 data"),
    ("From: a@b.co\nContent-Type: multipart/mixed\n\nx", "missing MIME boundary"),
    ("From: a@b.co\n\n" + "x" * 1_200_000, None),
])
def test_broken_and_long_mail(spark, raw, error):
    row = parse_messages(spark.createDataFrame([(1, raw)], "msg_id long, raw string")).first()
    assert row.error == error and (error or len(row.plain_text) == 1_200_000)


NESTED = """From: a@b.co\r
Content-Type: multipart/mixed;\r
 boundary="out er"\r
\r
preamble\r
--out er\r
Content-Type: multipart/alternative; boundary=inner\r
\r
--inner\r
Content-Type: text/plain; charset=iso-8859-1\r
Content-Transfer-Encoding: quoted-printable\r
\r
caf=E9 =3D soft=\r
 break\r
--inner\r
Content-Type: text/html\r
\r
<p>hi</p>\r
--inner--\r
--out er  \r
Content-Type: application/pdf; name="a \\"b\\".PDF"\r
Content-Transfer-Encoding: base64\r
\r
YQ\r
--out er\r
\r
no headers\r
--out er--\r
epilogue\r
"""


def test_nested_mail(spark):
    row = parse_messages(spark.createDataFrame([(1, NESTED)], "msg_id long, raw string")).first()
    assert row.error is None
    assert row.plain_text == "café = soft break\nno headers" and row.html == "<p>hi</p>"
    (found,) = row.attachments
    assert (found.filename, found.extension, found.mime_type, found.size) == ('a "b".PDF', "pdf", "application/pdf", 1)
    assert found.sha256 == hashlib.sha256(b"a").hexdigest()


def test_mail_files(spark, tmp_path):
    (tmp_path / "one.eml").write_bytes(NESTED.encode())
    (row,) = parse_messages(read_mail(spark, str(tmp_path))).collect()
    assert row.msg_id.endswith("one.eml") and row.html == "<p>hi</p>"


def test_links_are_compared_in_normal_form(spark):
    html = (
        '<a href="https://example.com">https://example.com/</a><a href="HTTPS://Example.com:443/a">https://example.com/a</a>'
        '<a href="https://example.com/a">other text</a><a href="https://evil.test/">https://example.com/</a>'
    )
    mail = spark.createDataFrame([(1, "From: a@b.co\nContent-Type: text/html\n\n" + html)], "msg_id long, raw string")
    rows = [r for r in mail_links(parse_messages(mail)).collect() if r.source == "href"]
    assert {r.url: r.mismatch for r in rows} == {"https://example.com/": False, "https://example.com/a": False, "https://evil.test/": True}


def test_whole_messages_are_read(spark):
    late = "x " * 15_000 + "Your account is suspended, verify now. Call 1800 123 4567 urgently!!!"
    links = " ".join(f"https://site{i}.example.com/" for i in range(10)) + " http://paypa1.com@192.168.0.1/login"
    df = spark.createDataFrame([(1, late), (2, links)], "id long, text string")
    found = {r.id: r for r in scan_text(df, "id").select("id", signal_ids("signals").alias("ids"), "level").collect()}
    assert "exclamation-spam" in found[1].ids and "risky-link" in found[2].ids


def test_charsets_and_deeply_nested_parts(spark):
    import base64

    from threatlake.sources.mail import attachment_inventory, mime_parts

    def part(charset, data):
        return f"Content-Type: text/plain; charset={charset}\r\nContent-Transfer-Encoding: base64\r\n\r\n{base64.b64encode(data).decode()}"

    said = {"koi8-r": "привет", "windows-1252": "“quoted” – €", "iso-8859-1": "“quoted”", "shift_jis": "日本語", "utf-8": "naïve ☃", "gb2312": "中文"}
    code = {"iso-8859-1": "cp1252"}
    rows = [(c, part(c, t.encode(code.get(c, c)))) for c, t in said.items()]
    rows.append(("unheard-of", part("x-unheard-of", b"plain")))
    deep = part("koi8-r", "глубоко".encode("koi8-r"))
    for i in range(25):
        deep = f'Content-Type: multipart/mixed; boundary="b{i}"\r\n\r\n--b{i}\r\n{deep}\r\n--b{i}\r\nContent-Type: application/pdf; name="f{i}.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\nUERG\r\n--b{i}--\r\n'
    rows.append(("deep", deep))
    df = spark.createDataFrame(rows, "msg_id string, raw string")
    parsed = mime_parts(df)
    got = {r.msg_id: r for r in parsed.collect()}
    assert {c: got[c].plain_text for c in said} == said and all(got[c].mime_error is None for c in said)
    assert (got["unheard-of"].plain_text, got["unheard-of"].mime_error) == ("plain", "unknown charset")
    assert got["deep"].plain_text == "глубоко" and len(got["deep"].attachments) == 25 and got["deep"].mime_error is None
    one = attachment_inventory(parsed).first()
    assert (one.copies, one.messages) == (25, 1)
