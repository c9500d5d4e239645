"""Rule checks of values by type: a value is trimmed, its span moved along, and judged by form.

Every check takes records (content, value, location_start, location_end) and adds `checked` (the value or null),
`checked_start`, `checked_end`. Defined results: a null or empty value fails every check; a null content has no quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import BLANKS, entropy, let
from spanloom.operators.detect import parses_as_ip

MARKS = BLANKS[:-1] + r":：;,.。'\"<>\[\](){}]"
LETTERS_AND_MARKS = r"[!-~]"

#: Values that stand for a password or an account in examples.
FALSE_PASSWORDS = [
    "password", "admin", "123456", "123456789", "12345678", "12345", "1234", "111111", "000000", "password1", "password123", "passw0rd", "qwerty", "qwerty123",
    "abc123", "1q2w3e", "123123", "user", "letmein", "welcome", "default", "changeme", "test", "test123", "asdf", "asdfgh", "iloveyou", "secret", "my_password",
    "yourpassword", "<password>", "pwd", "toor", "root", "guest", "login", "access", "temp123",
]
FALSE_USERNAMES = ["admin", "root", "user", "guest", "test", "testuser", "username", "administrator", "nickname", "getusername", "name"]
#: Address blocks that aren't public (first address, last address).
NOT_PUBLIC = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
]


def as_number(address: str) -> int:
    return sum(int(part) << shift for part, shift in zip(address.split("."), (24, 16, 8, 0)))


def found(value: Column | None, start: Column, end: Column) -> Column:
    """A value with its span; null where there is none."""
    value = F.lit(None).cast("string") if value is None else value
    return F.struct(value.alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def strip(value: Column, start: Column, end: Column, blanks_only: Column) -> Column:
    """Without marks (or only without blanks) at both ends; null if nothing but blanks is left."""
    without = lambda text, at: F.when(blanks_only, F.regexp_replace(text, at.format(BLANKS), "")).otherwise(F.regexp_replace(text, at.format(MARKS), ""))

    def trimmed(ahead: Column) -> Column:
        a, b = start + F.length(value) - F.length(ahead), end - F.length(value) + F.length(without(value, r"{}+\z"))
        return let(found(without(ahead, r"{}+\z"), a, b), lambda x: F.when((x["start"] >= 0) & (x["end"] > x["start"]) & x["value"].rlike(rf"[^{BLANKS[1:-1]}]"), x).otherwise(found(None, start, end)))

    return let(without(value, r"\A{}+"), trimmed)


def quotes(content: Column, x: Column, quoted: Column, reach: int = 10) -> Column:
    """The last quote from ten characters before to the middle, the first from the middle to ten after; if they are the
    same mark, the value is what stands between them."""
    half = F.floor(F.length(x["value"]) / 2).cast("int")
    low, mid = F.greatest(x["start"] - reach, F.lit(0)), x["start"] + half
    right_at, high = x["end"] - half, F.least(F.length(content), x["end"] + reach)
    back = F.reverse(F.substring(content, low + 1, F.greatest(mid - low, F.lit(0))))
    right = F.substring(content, F.greatest(right_at, F.lit(0)) + 1, F.greatest(high - right_at, F.lit(0)))
    mark = F.lit("['\"]")
    sides = F.struct(back.alias("back"), right.alias("right"), F.regexp_instr(back, mark).alias("l"), F.regexp_instr(right, mark).alias("r"), low.alias("low"), right_at.alias("right_at"))

    def inside(q: Column) -> Column:
        same = (q["l"] > 0) & (q["r"] > 0) & (F.substring(q["back"], q["l"], F.lit(1)) == F.substring(q["right"], q["r"], F.lit(1)))
        a, b = q["low"] + F.length(q["back"]) - q["l"] + 1, q["right_at"] + q["r"] - 1
        return F.when(same, found(F.substring(content, a + 1, F.greatest(b - a, F.lit(0))), a, b)).otherwise(x)

    return F.when(quoted & x["value"].isNotNull(), let(sides, inside)).otherwise(x)


def good_email(v: Column, tlds: list[str] | None = None) -> Column:
    """C2. tlds are the known top-level domains; without them any is accepted."""
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    good = ~v.contains("..") & ~v.startswith(".") & ~v.endswith(".") & (F.length(v) - F.length(F.replace(v, F.lit("@"), F.lit(""))) == 1)
    good = good & (local != "") & (domain != "") & ~domain.startswith(".") & ~domain.endswith(".") & ~v.rlike("[ /()]")
    return good & F.lower(F.substring_index(domain, ".", -1)).isin(tlds) if tlds else good


def good_ip(v: Column) -> Column:
    """A public address."""
    number = F.aggregate(F.split(v, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + F.coalesce(x.try_cast("long"), F.lit(0)))
    blocks = F.lit([list(map(as_number, block)) for block in NOT_PUBLIC])
    private = let(number, lambda n: F.exists(blocks, lambda block: n.between(block[0], block[1])))
    six = v.contains(":")
    local_six = F.lower(v).rlike(r"\A(?:::1?|fe[89ab].*|f[cd].*|2001:db8:.*|::ffff:.*|100::.*|2001:0?:.*|2002:.*)\z")
    return parses_as_ip(v) & F.when(six, ~local_six).otherwise(~private)


def good_key(v: Column) -> Column:
    """C4."""
    return ~v.rlike(rf"[\\/,;'\"<>{{}}\[\](){BLANKS[1:-1]}]") & (F.length(v) >= 16) & (F.size(F.array_distinct(F.split(v, ""))) >= 8) & (entropy(v) >= 3.0)


def good_name(v: Column) -> Column:
    """Two parts or more of English letters."""
    return v.rlike(r"\A(?:[a-zA-Z]+|[a-zA-Z]\.)(?:(?:[ .-]|, )(?:[a-zA-Z]+\.?|[a-zA-Z]\.))+\z") & v.rlike(r"\A(?:[a-zA-Z]\.?|[a-zA-Z]+)(?:(?:[ .-]|, )(?:[a-zA-Z]\.?|[a-zA-Z]+))+\z")


def good_password(v: Column) -> Column:
    """C6."""
    return v.rlike(rf"\A{LETTERS_AND_MARKS}{{8,}}\z") & ~F.lower(v).isin(FALSE_PASSWORDS)


def good_username(v: Column) -> Column:
    """C7."""
    return v.rlike(r"\A[A-Za-z0-9_-]{6,}\z") & ~F.lower(v).isin(FALSE_USERNAMES)


#: Type: (marks that are stripped, whether quotes are looked for, check).
CHECKS = {
    "email": (MARKS, False, good_email),
    "ip_address": (MARKS, False, good_ip),
    "key": (MARKS, True, good_key),
    "name": (MARKS, False, good_name),
    "password": (BLANKS, True, good_password),
    "username": (BLANKS, False, good_username),
}


def quick_check(records: DataFrame) -> DataFrame:
    """`checked` (value, start, end) of each record by the check of its type, all in one expression; the value is null where
    the check fails. Types without a check pass unchanged (C9)."""
    kind, content, value = F.coalesce("piiType", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce("value", F.lit(""))
    start, end = F.col("location_start"), F.col("location_end")
    of = lambda flag: kind.isin([k for k, v in CHECKS.items() if flag(v)])

    def judged(x: Column) -> Column:
        good = F.lit(True)
        for name, (_, _, form) in CHECKS.items():
            good = F.when(kind == name, form(x["value"])).otherwise(good)
        return F.when(good, x).otherwise(found(None, x["start"], x["end"]))

    checked = let(strip(value, start, end, of(lambda v: v[0] == BLANKS)), lambda x: let(quotes(content, x, of(lambda v: v[1])), judged))
    return records.withColumn("checked", F.when(kind.isin(list(CHECKS)), checked).otherwise(found(F.col("value"), start, end)))


def passed(records: DataFrame) -> DataFrame:
    """The records that pass, with what the check made of value and span."""
    rest = [c for c in records.columns if c not in ("value", "location_start", "location_end")]
    ok = F.explode(F.filter(F.array("checked"), lambda x: x["value"].isNotNull())).alias("c")
    return quick_check(records).select(*rest, ok).select(*rest, F.col("c.value").alias("value"), F.col("c.start").alias("location_start"), F.col("c.end").alias("location_end"))
