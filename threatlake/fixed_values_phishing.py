"""Fixed values of the phishing analytics: lists, weights and patterns that decide results.

They must equal the published rule set for equal scores, so they are stated as plain text in
their natural order; where order decides (first brand wins) the order is part of the value.
Patterns are written in the ECMAScript dialect; ``functions.patterns`` translates them.
"""

# --- URL lists -----------------------------------------------------------------------------------
BRANDS = [
    ("google", ["google.com", "google.co.in", "googleusercontent.com", "gstatic.com"]),
    ("microsoft", ["microsoft.com", "live.com", "office.com", "outlook.com", "microsoftonline.com"]),
    ("apple", ["apple.com", "icloud.com"]),
    ("amazon", ["amazon.com", "amazon.in", "amazon.co.uk"]),
    ("paypal", ["paypal.com"]),
    ("facebook", ["facebook.com", "fb.com"]),
    ("instagram", ["instagram.com"]),
    ("whatsapp", ["whatsapp.com", "whatsapp.net"]),
    ("telegram", ["telegram.org", "t.me"]),
    ("netflix", ["netflix.com"]),
    ("spotify", ["spotify.com"]),
    ("linkedin", ["linkedin.com"]),
    ("github", ["github.com", "github.io"]),
    ("dropbox", ["dropbox.com"]),
    ("adobe", ["adobe.com"]),
    ("zoom", ["zoom.us"]),
    ("binance", ["binance.com"]),
    ("coinbase", ["coinbase.com"]),
    ("fedex", ["fedex.com"]),
    ("dhl", ["dhl.com"]),
    ("chase", ["chase.com"]),
    ("wellsfargo", ["wellsfargo.com"]),
    ("bankofamerica", ["bankofamerica.com"]),
    ("sbi", ["sbi.co.in", "onlinesbi.sbi"]),
    ("hdfcbank", ["hdfcbank.com"]),
    ("icicibank", ["icicibank.com"]),
    ("axisbank", ["axisbank.com"]),
    ("kotak", ["kotak.com"]),
    ("pnbindia", ["pnbindia.in"]),
    ("bankofbaroda", ["bankofbaroda.in", "bankofbaroda.com"]),
    ("paytm", ["paytm.com"]),
    ("phonepe", ["phonepe.com"]),
    ("flipkart", ["flipkart.com"]),
    ("swiggy", ["swiggy.com"]),
    ("zomato", ["zomato.com"]),
    ("jio", ["jio.com"]),
    ("airtel", ["airtel.in"]),
    ("irctc", ["irctc.co.in"]),
    ("uidai", ["uidai.gov.in"]),
    ("incometax", ["incometax.gov.in"]),
]
SUSPICIOUS_TLDS = [
    "zip", "mov", "top", "xyz", "click", "link", "work", "support", "country",
    "gq", "tk", "ml", "cf", "ga", "rest", "cam", "icu", "monster", "buzz",
]
URL_SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly",
    "rebrand.ly", "cutt.ly", "shorturl.at", "tiny.cc", "rb.gy",
]
SUSPICIOUS_KEYWORDS = [
    "login", "signin", "verify", "secure", "account", "update", "confirm",
    "banking", "password", "wallet", "suspend", "unlock", "billing", "invoice", "kyc",
    "payment", "checkout", "refund", "payout",
]
REDIRECT_KEYS = [
    "callback", "continue", "continue_to", "dest", "destination", "destination_url", "forward",
    "forward_url", "go", "goto", "link", "next", "out", "redirect", "redirect_uri", "redirect_url",
    "redirecturl", "return", "return_to", "return_url", "returnto", "returnurl", "target",
    "target_url", "to", "u", "url",
]
SENSITIVE_QUERY_KEYS = [
    "account", "card", "code", "email", "login", "otp", "pass", "password", "payment", "pin",
    "user", "username",
]
SENSITIVE_PATH = (
    r"(?:^|[\/_-])(?:account|billing|checkout|confirm|login|payment|password|signin|verify)(?:$|[\/_-])"
)
FEATURE_ORDER = [
    "length", "hostLength", "subdomains", "specialChars", "hyphens", "digitRatio", "hostEntropy",
    "pathDepth", "queryParams", "hasIp", "hasAt", "isHttps", "hasPunycode", "suspiciousTld",
    "isShortener", "keywordCount",
]

# --- look-alike folding ----------------------------------------------------------------------------
FOLD_UNICODE = ("асеіорѕхуαεικορτυχ", "aceiopsxyaeikoptux")
FOLD_DIGITS = ("03457$", "oeasts")
JARO_WINKLER_FLOOR = 0.93

# --- message de-obfuscation --------------------------------------------------------------------------
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
SCRIPT_CONFUSABLES = (
    "аеорсхуіѕјһԁοαν"
    "АВЕКМНОРСТХ",
    "aeopcxyisjhdoav" "ABEKMHOPCTX",
)
LEET = ("03457@$", "oeastas")
SCAM_VOCABULARY = [
    "otp", "pin", "cvv", "kyc", "upi", "verify", "verification", "account", "block", "blocked",
    "suspend", "suspended", "password", "urgent", "urgently", "immediately", "bank", "prize",
    "refund", "click", "login", "update", "confirm", "expire", "expired", "expires", "lottery",
    "winner", "claim", "reward", "cashback", "aadhaar", "netbanking", "card", "debit", "credit",
    "unlock", "security", "alert",
]
OBFUSCATION_WEIGHTS = {"hidden-chars": 15, "mixed-script": 25, "spaced-letters": 25, "leet": 25}

# --- scam language: id, tactic, weight, negatable, Hindi, pattern ---------------------------------------
SCAM_RULES = [
    ("urgency", "urgency", 20, False, False,
     r"\b(urgent(ly)?|immediately|act now|final notice|last warning|within \d+ (hours?|minutes?)|expires? (today|soon))\b"),
    ("account-threat", "fear", 25, False, False,
     r"(account|card|sim|number|wallet).{0,40}(suspend|block|lock|deactivat|clos(e|ed|ure))"),
    ("credential-request", "credential", 35, True, False,
     r"(verify|confirm|update|enter|provide).{0,30}(password|pin|otp|cvv|card number|aadhaar|pan\b|ssn|bank details)"),
    ("otp-share", "credential", 35, True, False,
     r"(share|send|tell|give|read out).{0,20}(otp|pin|cvv|verification code)"),
    ("upi-pin", "credential", 35, True, False,
     r"(enter|share|give).{0,15}upi pin|upi pin.{0,30}(receive|refund|cashback|credit)"),
    ("prize", "reward", 25, False, False,
     r"(you('ve| have)? won|lottery|lucky draw|prize|claim your|congratulations)"),
    ("kyc", "fear", 30, False, False,
     r"(\bkyc\b.{0,40}(update|expire|pending|verify|suspend))|((update|pending|expire|verify).{0,20}\bkyc\b)"),
    ("pay-to-receive", "payment", 30, False, False,
     r"(pay|send|transfer).{0,30}(fee|charges|tax|deposit).{0,40}(release|claim|receive|unlock)"),
    ("gift-crypto", "payment", 30, False, False,
     r"(gift ?cards?|bitcoin|usdt|crypto(currency)?).{0,40}(pay|send|buy|transfer)"),
    ("remote-access", "remote", 35, False, False,
     r"(anydesk|teamviewer|quicksupport|remote access)"),
    ("authority-threat", "authority", 25, False, False,
     r"(irs|income tax|customs|police|cbi|fedex|dhl|courier).{0,50}(fine|penalty|arrest|parcel|held|legal action)"),
    ("job-scam", "reward", 25, False, False,
     r"(work from home|part[- ]?time job|earn).{0,50}\d[\d,]*\s*(per day|daily|per hour|a day|\/day)"),
    ("bill-disconnect", "fear", 25, False, False,
     r"(electricity|power|gas|water|bill).{0,40}(disconnect|cut off|discontinu)"),
    ("refund-lure", "lure", 20, False, False,
     r"(refund|cashback).{0,40}(click|link|claim|process)"),
    ("digital-arrest", "authority", 35, False, False,
     r"(digital arrest|cyber ?crime (branch|police)|narcotics|money laundering).{0,60}(case|arrest|warrant|parcel|aadhaar)"),
    ("tech-support", "fear", 30, False, False,
     r"(virus|malware|infected|hacked|security alert).{0,50}(call|contact|support|helpline|toll[- ]?free)"),
    ("investment-scam", "reward", 30, False, False,
     r"(guaranteed|assured|risk[- ]?free).{0,30}(returns?|profits?|income)|(double|triple|10x).{0,20}(your )?(money|investment)|\b(crypto|forex|stock)s? (signals?|tips?)\b"),
    ("loan-fee", "payment", 30, False, False,
     r"(instant|pre[- ]?approved|guaranteed).{0,20}loan.{0,40}(no (documents?|cibil|credit check)|processing fee|advance fee)"),
    ("collect-request", "payment", 30, False, False,
     r"(collect request|payment request).{0,40}(approve|accept)|(approve|accept).{0,20}(collect request|payment request)"),
    ("secrecy-demand", "fear", 25, False, False,
     r"(?:do not|don'?t|dont).{0,15}(?:tell|inform|discuss).{0,20}(?:anyone|anybody|family|bank|police)|keep (?:this|it) (?:confidential|secret|private)"),
    ("delivery-fee", "lure", 20, False, False,
     r"(parcel|package|delivery|courier).{0,50}(address (is )?(incomplete|invalid)|undeliverable|unable to deliver|reschedule|redeliver|customs fee|held at)"),
    ("chat-invite", "lure", 20, False, False,
     r"(join|add).{0,30}(whatsapp|telegram).{0,20}(group|channel)|\b(wa\.me|t\.me)\/"),
    ("urgency-hinglish", "urgency", 20, False, False,
     r"\b(turant|jaldi|abhi (karein|karo|kare)|aaj hi|der mat)\b"),
    ("account-threat-hinglish", "fear", 25, False, False,
     r"(khata|khaata).{0,30}\b(band|block|suspend)\b|\b(band|block)\b.{0,10}\bho (jayega|jaega|jayegi|jaye)\b"),
    ("otp-hinglish", "credential", 35, True, False,
     r"\b(?:otp|pin|cvv).{0,20}\b(?:batao|batayein|bataye|bhejo|bhejein|dijiye)\b|\b(?:batao|batayein|bhejo|bhejein|dijiye)\b.{0,15}\b(?:otp|pin|cvv)\b"),
    ("prize-hinglish", "reward", 25, False, False,
     r"\b(inaam|inam|lottery lagi|jeet(a|e|ey)? hai|jeet liya)\b"),
    ("urgency-hindi", "urgency", 20, False, True, "तुरंत"),
    ("account-threat-hindi", "fear", 25, False, True,
     "खाता.{0,30}बंद"),
    ("kyc-hindi", "fear", 30, False, True, "केवाईसी"),
    ("otp-hindi", "credential", 35, True, True,
     "ओटीपी.{0,25}(?:साझा|बताएं|बताइए|भेजें)"),
    ("prize-hindi", "reward", 25, False, True,
     "इनाम|लॉटरी"),
]
PRESSURE_TACTICS = ["urgency", "fear", "authority", "reward"]
NEGATION_BEFORE = (
    r"\b(?:do not|don'?t|dont|never|won'?t|will not|should not|must not|avoid|mat)\b[\s\w'-]{0,15}$"
)
NEGATION_LOOKBACK = 40
PROTECTIVE = (
    r"\b(?:(?:will|would|shall) never (?:ask|call|request|message|email|send)"
    r"|never (?:ask|share|disclose|reveal)|(?:do not|don'?t) (?:share|disclose|reveal)"
    r"|beware of|fraud alert|scam alert|stay (?:alert|safe|vigilant)|be careful of)\b"
)
PROTECTIVE_WINDOW = 140
HINDI_NEGATION = "(?:^|\\s)(?:न|मत)(?:\\s|$)"
LINK_PATTERN = r"(?:https?:\/\/|www\.)[^\s<>\"')]+"
PHONE_PATTERN = (
    r"(?:\+?91[\s-]?)?\b[6-9]\d{9}\b|\b1800[\s-]?\d{3}[\s-]?\d{3,4}\b|\+\d{1,3}[\s-]?\d{6,12}\b"
)
CALL_VERB = r"\b(?:call|contact|whatsapp|dial|ring|helpline|customer care)\b"
CALL_LOOKBACK = 40

# --- e-mail ------------------------------------------------------------------------------------------------
EMAIL_BRANDS = [
    ("paypal", ["paypal.com"], []),
    ("amazon", ["amazon.com", "amazon.in", "amazon.co.uk", "amazonpay.in"], []),
    ("apple", ["apple.com", "icloud.com"], []),
    ("microsoft", ["microsoft.com", "outlook.com", "live.com", "office.com", "microsoftonline.com"], []),
    ("google", ["google.com"], []),
    ("netflix", ["netflix.com"], []),
    ("facebook", ["facebook.com", "facebookmail.com", "fb.com"], []),
    ("instagram", ["instagram.com"], []),
    ("whatsapp", ["whatsapp.com"], []),
    ("linkedin", ["linkedin.com"], []),
    ("dropbox", ["dropbox.com"], []),
    ("binance", ["binance.com"], []),
    ("coinbase", ["coinbase.com"], []),
    ("fedex", ["fedex.com"], []),
    ("dhl", ["dhl.com"], []),
    ("usps", ["usps.com"], []),
    ("chase", ["chase.com"], []),
    ("wellsfargo", ["wellsfargo.com"], ["wells fargo"]),
    ("bankofamerica", ["bankofamerica.com"], ["bank of america"]),
    ("sbi", ["sbi.co.in", "onlinesbi.sbi", "sbicard.com"], ["state bank of india"]),
    ("hdfcbank", ["hdfcbank.com", "hdfcbank.net"], ["hdfc bank"]),
    ("icicibank", ["icicibank.com"], ["icici bank"]),
    ("axisbank", ["axisbank.com"], ["axis bank"]),
    ("kotak", ["kotak.com"], []),
    ("paytm", ["paytm.com", "paytmbank.com"], []),
    ("phonepe", ["phonepe.com"], []),
    ("flipkart", ["flipkart.com"], []),
    ("irctc", ["irctc.co.in"], []),
    ("uidai", ["uidai.gov.in"], ["aadhaar"]),
    ("incometax", ["incometax.gov.in"], ["income tax"]),
    ("jio", ["jio.com"], []),
    ("airtel", ["airtel.in", "airtel.com"], []),
]
FREE_PROVIDERS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "yahoo.co.uk", "yahoo.in", "ymail.com",
    "outlook.com", "hotmail.com", "hotmail.co.uk", "live.com", "msn.com", "icloud.com", "me.com", "aol.com",
    "proton.me", "protonmail.com", "pm.me", "zoho.com", "zohomail.com", "gmx.com", "gmx.net", "mail.com",
    "email.com", "rediffmail.com", "yandex.com", "yandex.ru", "tutanota.com", "fastmail.com", "hey.com",
]
FREEMAIL_TYPO_TARGETS = [
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "protonmail.com",
    "rediffmail.com", "yandex.com",
]
DISPOSABLE_DOMAINS = [
    "mailinator.com", "guerrillamail.com", "guerrillamail.net", "guerrillamail.org", "sharklasers.com",
    "10minutemail.com", "10minutemail.net", "tempmail.com", "temp-mail.org", "temp-mail.io", "yopmail.com",
    "trashmail.com", "trashmail.net", "getnada.com", "nada.email", "throwawaymail.com", "maildrop.cc",
    "dispostable.com", "fakeinbox.com", "mohmal.com", "emailondeck.com", "mintemail.com", "spamgourmet.com",
    "mailnesia.com", "tempail.com", "burnermail.io", "moakt.com", "mytemp.email", "inboxkitten.com",
    "discard.email",
]
EMAIL_TLDS = [
    "zip", "mov", "top", "xyz", "click", "link", "work", "support", "country", "gq", "tk", "ml", "cf", "ga",
    "rest", "cam", "icu", "monster", "buzz", "loan", "download", "review",
]
AUTHORITY_WORDS = [
    "support", "security", "billing", "helpdesk", "helpline", "verify", "verification", "refund", "kyc",
    "customercare", "service", "alert", "alerts", "admin", "accounts", "account", "payments", "payment",
    "fraud", "recovery", "compliance", "noreply", "official",
]
EMAIL_PLAIN = r"[^\s<>()\[\]{}\"',;]+@[^\s<>()\[\]{}\"',;]+"
EMAIL_BRACKET_WORDS = (
    r"\b([a-z0-9.!#$%&'*+/=?^_`{|}~-]+)\s*(?:\[at\]|\(at\)|\{at\})\s*"
    r"([a-z0-9.-]+(?:(?:\s*\[dot\]\s*|\s*\(dot\)\s*|\s*\{dot\}\s*)[a-z0-9-]+)+)"
)
EMAIL_BRACKET_AT = r"\b([a-z0-9._%+-]+)\s*(?:\[@\]|\(@\))\s*([a-z0-9-]+(?:\.[a-z0-9-]+)+)"
EMAIL_SPOKEN = r"\b([a-z0-9._%+-]+)\s+at\s+([a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)+)\b"
EMAIL_MAILTO = r"mailto:([^?\s\"'<>]*)(?:\?([^\s\"'<>]*))?"
EMAIL_DISPLAY = (
    r"(?:\"([^\"\n]{1,80})\"|\b([A-Za-z][A-Za-z0-9 .,'&_-]{0,60}?))\s*<\s*([^<>\s,;]+@[^<>\s,;]+?)\s*>"
)
AUTH_FAILURE_WEIGHTS = {
    "spf": {"fail": 20, "permerror": 12, "softfail": 8},
    "dkim": {"fail": 20, "permerror": 12, "softfail": 8},
    "dmarc": {"fail": 30, "permerror": 15, "softfail": 10},
}
AUTH_RESULTS = ["pass", "fail", "softfail", "neutral", "none", "temperror", "permerror"]

# --- online intelligence -------------------------------------------------------------------------------------
# First MX host with a known provider, first provider in this order.
MX_PROVIDERS = [
    (r"(^|\.)(google|googlemail)\.com$", "Google Workspace / Gmail"),
    (r"(^|\.)outlook\.com$", "Microsoft 365 / Outlook"),
    (r"(^|\.)pphosted\.com$", "Proofpoint"),
    (r"(^|\.)mimecast\.com$", "Mimecast"),
    (r"(^|\.)zoho\.(com|in|eu)$", "Zoho Mail"),
    (r"(^|\.)secureserver\.net$", "GoDaddy"),
    (r"(^|\.)(privateemail\.com|registrar-servers\.com)$", "Namecheap"),
    (r"(^|\.)yahoodns\.net$", "Yahoo Mail"),
    (r"(^|\.)icloud\.com$", "iCloud"),
    (r"(^|\.)(protonmail\.ch|proton\.ch)$", "Proton Mail"),
    (r"(^|\.)messagingengine\.com$", "Fastmail"),
]
REPUTATION_FLAGS = [
    ("malicious_activity", "Reported malicious activity"),
    ("malicious_activity_recent", "Recent malicious activity"),
    ("blacklisted", "Listed on a blocklist"),
    ("spam", "Associated with spam"),
    ("credentials_leaked", "Credentials reported leaked"),
    ("disposable", "Disposable email provider"),
    ("new_domain", "Recently registered domain"),
]
URL_PROVIDERS = ["googleSafeBrowsing", "virusTotal", "urlhaus", "phishTank"]
ENRICH_FROM, ENRICH_BELOW = 15, 60
BLOCK_THRESHOLDS = {"high": 45, "low": 75, "medium": 60}
HISTORY_ITEMS = 50
EXPLAIN_FROM = 30
MODEL_BANDS = (0.30, 0.70)
