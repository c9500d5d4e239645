"""Span detectors: pattern detectors over JVM expressions, and a pluggable detector for everything else.

Every detector takes files (fileId, content) and gives rows (fileId, location_start, location_end, value, piiType,
detectedBy). Defined results: null and empty contents hold no spans; a file delivered twice counts once; texts are
read whole; an unknown type is a ValueError; columns besides fileId and content are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import CLOSE, FLAGS, OPEN, spans, window

IPV4 = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){3}"
H = r"[0-9a-fA-F]{1,4}"


def ipv6_forms() -> list[str]:
    """The written forms of an address of eight groups: all of them, or `::` in the place of one or more."""
    tail = [rf"(?:{H}:){{1,{8 - k}}}(?::{H}){{1,{k}}}" for k in range(1, 7)]
    short = rf"(?:25[0-5]|(?:2[0-4]|1?[0-9])?[0-9])"
    quad = rf"(?:{short}\.){{3}}{short}"
    return [rf"(?:{H}:){{7}}{H}", rf"(?:{H}:){{1,7}}:", rf"(?:{H}:){{1,6}}:{H}", *tail[1:], rf"{H}:(?::{H}){{1,6}}", rf":(?:(?::{H}){{1,7}}|:)", rf"fe80:(?::[0-9a-fA-F]{{0,4}}){{0,4}}%[0-9a-zA-Z]+", rf"::(?:ffff(?::0{{1,4}})?:)?{quad}", rf"(?:{H}:){{1,4}}:{quad}"]


EDGE = r"\x08\s@?,!;:'\")(.\p{IsHan}"
EDGE_AFTER = r"\s@,?!;:'\"(.\p{IsHan}"
IP = rf"(^|[{EDGE}])({IPV4}|{'|'.join(ipv6_forms())})($|[{EDGE_AFTER}])"
EMAIL = (
    rf"((?<=^|[\x08\s@,?!;:)('\".\p{{IsHan}}<]))([^\x08\s@?!;,:)('\"<]+@[^\x08\s@!?;,/]*[^\x08\s@?!;,/:)('\">.]\.\p{{L}}\w+)"
    rf"((?=$|[\x08\s@,?!;:)('\".\p{{IsHan}}>]))"
)

#: Provider, kind of secret and public format of its keys.
KEY_FORMATS = [
    ("Meta", "facebook_access_token", r"EAACEdEose0cBA[0-9A-Za-z]+"),
    ("Slack", "slack_api_token", r"xox[p|b|o|a]-[0-9]{12}-[0-9]{12}-[0-9]{12}-[a-z0-9]{32}"),
    ("Slack", "slack_incoming_webhook_url", r"https:\/\/hooks.slack.com\/services\/[A-Za-z0-9+\/]{44,46}"),
    ("Sendinblue", "sendinblue_api_key", r"xkeysib-[a-f0-9]{64}-[a-zA-Z0-9]{16}"),
    ("Alibaba Cloud", "alibaba_cloud_access_key_id", r"LTAI[a-zA-Z0-9]{20}"),
    ("Amazon Web Services (AWS)", "aws_access_key_id", r"AKIA[0-9A-Z]{16}"),
    ("Tencent Cloud", "tencent_cloud_secret_id", r"AKID[0-9a-zA-Z]{32}"),
    ("Google", "google_api_key", r"AIza[0-9A-Za-z\-_]{35}"),
    ("Google", "google_oauth_client_id", r"[0-9]{11,13}-[a-z0-9]{32}\.apps\.googleusercontent\.com"),
    ("Google", "google_oauth_client_secret", r"GOCSPX-[a-zA-Z0-9]{28}"),
    ("Midtrans", "midtrans_sandbox_server_key", r"SB-Mid-server-[0-9a-zA-Z_-]{24}"),
    ("Flutterwave", "flutterwave_live_secret_key", r"FLWPUBK_TEST-[0-9a-f]{32}-X"),
    ("Flutterwave", "flutterwave_test_api_secret_key", r"FLWSECK_TEST-[0-9a-f]{32}-X"),
    ("Stripe", "stripe_live_secret_key", r"sk_live_[0-9a-zA-Z]{24}"),
    ("Stripe", "stripe_test_secret_key", r"sk_test_[0-9a-zA-Z]{24}"),
    ("eBay", "ebay_production_client_id", r"[a-zA-Z0-9_\-]{8}-[a-zA-Z0-9_\-]{8}PRD-[a-z0-9]{9}-[a-z0-9]{8}"),
    ("GitHub", "github_personal_access_token", r"ghp_[0-9a-zA-Z]{36}"),
    ("GitHub", "github_oauth_access_token", r"gho_[0-9a-zA-Z]{36}"),
]
#: Number ranges of card issuers.
CARD_FORMATS = [
    ("Visa", r"4[0-9]{12}(?:[0-9]{3})?"),
    ("MasterCard", r"5[1-5][0-9]{14}|2(?:2[2-9][0-9]{12}|[3-7][0-9]{13})"),
    ("American Express", r"3[47][0-9]{13}"),
    ("Diners Club", r"3(?:0[0-5]|[68][0-9])[0-9]{11}"),
    ("Discover", r"6(?:011|5[0-9]{2})[0-9]{12}"),
    ("JCB", r"(?:2131|1800|35[0-9]{3})[0-9]{11}"),
]
#: Words for gender.
GENDER_WORDS = ["male", "female", "man", "woman", "boy", "girl", "non[- ]?binary", "gender[- ]?queer", "trans(?:gender)?", "cis(?:gender)?"]

KEY = "()(" + "|".join(f"(?:{form})" for _, _, form in KEY_FORMATS) + ")()"
CARD = r"(\b)(" + "|".join(f"(?:{form})" for _, form in CARD_FORMATS) + r")(\b)"
GENDER = r"(?i)(\b)(" + "|".join(GENDER_WORDS) + r")(\b)"
#: Assignments to names that speak of secrets or accounts, for the rule-based detector.
ASSIGNED = r"(?i)(\b{name}[\w.-]*[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"'])([^\"'\s]{{4,80}})([\"'])"
RULES = {"password": ASSIGNED.format(name="(?:password|passwd|pwd)"), "username": ASSIGNED.format(name="(?:user_?name|login)"), "key": ASSIGNED.format(name="(?:token|api_?key|secret)")}

PATTERNS = {"email": EMAIL, "ip_address": IP, "key": KEY, "credit_card": CARD, "gender": GENDER}
#: Each match of a pattern holds at least one of these; texts without any aren't searched.
HINTS = {
    "email": ["@"],
    "ip_address": [".", ":"],
    "key": [
        "EAACEdEose0cBA", "xox", "hooks", "xkeysib-", "LTAI", "AKIA", "AKID", "AIza", "googleusercontent", "GOCSPX-", "SB-Mid-server-", "FLWPUBK_TEST-",
        "FLWSECK_TEST-", "sk_live_", "sk_test_", "PRD-", "ghp_", "gho_",
    ],
}
#: The same as a cheap pattern, where no literal tells.
FIRST_LOOK = {"ip_address": r"\d\.\d{1,3}\.\d|[0-9a-fA-F:]:[0-9a-fA-F:]", "credit_card": r"\d{13}"}
#: The pattern detectors that a search enables, in order.
ENABLED = ["email", "ip_address", "key"]

_D = r"[\p{Pd}/.]"
#: Dates and years that look like addresses; they match from the beginning of the value.
DATES = [
    r"[1-2][0-9]{3}[\p{Pd}/][1-2][0-9]{3}",
    rf"[1-2][0-9]{{3}}{_D}[0-3][0-9]{_D}[0-3][0-9]",
    rf"[0-3][0-9]{_D}[0-3][0-9]{_D}(?:[0-9]{{2}}|[1-2][0-9]{{3}})",
    r"[0-3][0-9][\p{Pd}/](?:[0-9]{2}|[1-2][0-9]{3})",
    r"[1-2][0-9]{3}-[0-3][0-9]",
]


def has_digit(value: Column) -> Column:
    return value.rlike(r"(?U)\d")


def like_date(value: Column) -> Column:
    """Whether a value begins like a date that a separator or its end follows."""
    any_date = F.lit(False)
    for form in DATES:
        any_date = any_date | value.rlike(rf"{FLAGS}\A(?:[{EDGE}])?{form}(?:$|[{EDGE_AFTER}])")
    return any_date


def parses_as_ip(value: Column) -> Column:
    """Whether a value of either pattern is an address: no number of a dotted quad has a zero in front."""
    quad = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"
    return value.rlike(rf"\A{quad}\z") | (value.contains(":") & (~value.contains(".") | value.rlike(rf":{quad}\z")))


def like_version(value: Column, around: Column) -> Column:
    """Four single digits with dots are a version number unless something near speaks of servers."""
    short = (F.length(value) == 7) & (F.length(value) - F.length(F.replace(value, F.lit("."), F.lit(""))) == 3)
    return short & ~F.lower(around).rlike("dns|server")


def keep(kind: str, value: Column, around: Column) -> Column:
    """The filters behind each pattern."""
    if kind == "ip_address":
        return has_digit(value) & ~like_date(value) & ~like_version(value, around) & parses_as_ip(value)
    return F.call_function("luhn_check", value) if kind == "credit_card" else F.lit(True)


def find_spans(files: DataFrame, kind: str) -> DataFrame:
    """Spans of one pattern detector. Around an address near the beginning of a file the context begins with the file."""
    if kind not in PATTERNS:
        raise ValueError(f"no pattern for type {kind!r}; there are {sorted(PATTERNS)}")
    worth = F.lit(False)
    for hint in HINTS.get(kind, [""]):
        worth = worth | F.contains("content", F.lit(hint))
    if kind in FIRST_LOOK:
        worth = worth & F.col("content").rlike(FIRST_LOOK[kind])
    return _rows(files.filter(worth), PATTERNS[kind], kind, "regex", lambda v, around: keep(kind, v, around), 100)


def _rows(files: DataFrame, pattern: str, kind: str, by: str, good: Callable[[Column, Column], Column], reach: int) -> DataFrame:
    found = files.select("fileId", "content", F.explode(spans(F.col("content"), pattern)).alias("s"))
    value, start, end = F.col("s.value"), F.col("s.start"), F.col("s.end")
    rows = found.filter(good(value, window(F.col("content"), start, end, reach)) & (value != ""))
    return rows.select("fileId", start.alias("location_start"), end.alias("location_end"), value.alias("value"), F.lit(kind).alias("piiType"), F.lit(by).alias("detectedBy")).distinct()


def rule_spans(files: DataFrame) -> DataFrame:
    """The default of the model-backed detector: values assigned to telling names."""
    found = [_rows(files, pattern, kind, "rule", lambda v, _: F.lit(True), 0) for kind, pattern in RULES.items()]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def search(files: DataFrame, backend: Callable[[DataFrame], DataFrame] = rule_spans, kinds: list[str] = ENABLED) -> DataFrame:
    """All spans of each file, numbered from 0 (piiId): the pattern detectors in order, then those of the backend. Files
    without spans give no rows."""
    rank = {"regex": {k: i for i, k in enumerate(kinds)}}
    parts = [find_spans(files, kind).withColumn("detector", F.lit(rank["regex"][kind])) for kind in kinds]
    parts.append(backend(files).withColumn("detector", F.lit(len(kinds))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("fileId").orderBy("detector", "location_start", "location_end", "piiType")
    return out.withColumn("piiId", F.row_number().over(order) - 1).drop("detector")


def only_language(files: DataFrame, subset: str) -> DataFrame:
    """The gate of a search: files of one of the languages it is made for."""
    if subset.lower() not in ("java", "python"):
        raise ValueError(f"subset must be java or python, not {subset!r}")
    return files.filter(F.lower("language") == subset.lower())


def chunks(files: DataFrame, size: int = 512, stride: int | None = None, reserve: int = 10) -> DataFrame:
    """(fileId, chunk, char_start, char_end) windows of size - reserve tokens every stride tokens (half a window without
    one), up to the one that reaches the end; tokens are runs of word characters and single marks."""
    step, width = stride or size // 2, size - reserve
    clean = F.translate("content", OPEN + CLOSE, "  ")
    pieces = F.split(F.regexp_replace(clean, F.lit(FLAGS + r"(\w+|[^\w\s])"), F.lit(f"{OPEN}$1{CLOSE}")), OPEN)
    none = F.expr("cast(array() as array<int>)")

    # only the tokens at which a window begins or ends are kept, so that long texts stay linear
    def read(acc, piece):
        end = acc["at"] + F.length(F.substring_index(piece, CLOSE, 1))
        begins, closes = acc["k"] % step == 0, (acc["k"] >= width - 1) & ((acc["k"] - (width - 1)) % step == 0)
        return F.struct(
            (acc["k"] + 1).alias("k"),
            (acc["at"] + F.length(piece) - 1).alias("at"),
            end.alias("end"),
            F.when(begins, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"),
            F.when(closes, F.array_append(acc["ends"], end)).otherwise(acc["ends"]).alias("ends"),
        )

    zero = F.lit(0)
    first = F.struct(zero.alias("k"), F.length(F.element_at("p", 1)).alias("at"), zero.alias("end"), none.alias("starts"), none.alias("ends"))
    rest = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, zero))
    have = files.select("fileId", pieces.alias("p")).filter("size(p) > 1").select("fileId", F.aggregate(rest, first, read).alias("t"))
    # windows up to the first that reaches the end
    count = F.expr(f"cast(greatest(ceil((t.k - {width}) / {step}), 0) + 1 as int)")
    rows = have.select("fileId", "t", F.posexplode(F.slice("t.starts", F.lit(1), count)).alias("chunk", "char_start"))
    return rows.select("fileId", "chunk", "char_start", F.coalesce(F.get("t.ends", "chunk"), F.col("t.end")).alias("char_end")).distinct()


def remap(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """Spans of chunks (fileId, chunk, start, end, value) as spans of their files; those that touch the end of a chunk are
    left to the next one."""
    joined = found.join(pieces, ["fileId", "chunk"]).filter(F.col("end") != F.col("char_end") - F.col("char_start"))
    return joined.select("fileId", (F.col("char_start") + F.col("start")).alias("location_start"), (F.col("char_start") + F.col("end")).alias("location_end"), "value").distinct()


def validators(value: Column) -> dict[str, Column]:
    """Optional checks of types that no detector enables."""
    return {
        "phone_number": value.rlike(r"\b(?:\+?1[-\s]?)?\(?[0-9]{3}\)?[-\s]?[0-9]{3}[-\s]?[0-9]{4}\b"),
        "ssn": value.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"),
        "gender": value.rlike(r"(?i)\b(?:" + "|".join(GENDER_WORDS) + r")\b"),
        "date_of_birth": value.rlike(r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)?[0-9]{2}\b"),
    }


def detector_stats(records: DataFrame) -> DataFrame:
    """Spans per type and detector."""
    return records.groupBy("piiType", "detectedBy").agg(F.count("*").alias("n"))
