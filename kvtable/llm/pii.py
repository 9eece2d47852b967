"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Patterns of what may be personal data; each find is validated before it is replaced.
#: All repeats are bounded or possessive, so that no text makes a pattern try a run again and again.
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}"
#: Marks and spaces that may stand between the words of one find, as in lists and tables.
BETWEEN = r"[^\w(=:+]{0,5}"
SECRET_NAME = r"(?i:(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)" + BETWEEN + r"[=:])"
SECRET = (
    SECRET_NAME + r"(?i:" + BETWEEN + r"[A-Za-z0-9_+/-]{16,}+[\"']?+)"
    r"|\"[0-9A-Fa-f]{32,64}\""
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\d.-])(?:19|20)\d\d-\d\d-\d\d(?![\d-])|(?<![\d./])\d\d/\d\d/(?:19|20)\d\d(?![\d/])"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)"
#: Two numbers side by side read as one long one; groups of digits without separators are tried by themselves.
PLAIN_CARD = r"(?<!\d)\d{13,19}(?!\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}" + BETWEEN + r")?\(\d{2,4}\)" + BETWEEN + r"\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
GROUPED_CARD = r"(?<!\d)(?<!\d-)\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?![\d]|-\d)"
PATTERN = "|".join([EMAIL, SECRET, IBAN, DATE, IP, SSN, PLAIN_CARD, GROUPED_CARD, CARD, PHONE])
#: What every find has: a digit, an @, 32 letters in quotes or the name of a secret. The single characters are tried first, as most texts with finds have them.
ANY_FIND = r"[0-9@]"
NO_DIGIT_FIND = SECRET_NAME + r"|\"[A-Fa-f]{32}"
#: Country calling codes have one digit (1, 7), two (those listed) or else three.
COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Setting that holds the key of the registered query.
KEY_SETTING = "spark.kvtable.pseudonym.key"
#: Days from 1900-01-01 to 2099-12-31; 17 x 4297.
DAYS = 73_049


def keyed(key: str, kind: str, *parts: Column) -> Column:
    """A number below 2^60 that only the key's holder can compute."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def once(value: Column, use) -> Column:
    """use(value), with the value computed a single time."""
    return F.transform(F.array(value), use)[0]


def network(halves: Column, a: Column, b: Column, key: str, kind: str, rounds: int = 4) -> Column:
    """A Feistel network over pairs (l below a, r below b): each half in turn is shifted, modulo its size, by a keyed hash of the other."""

    def round_(i: int):
        # A factory, as a second parameter of a lambda would be taken for the array index.
        return lambda s: once(
            F.pmod(s["l"] + F.pmod(keyed(key, f"{kind}{2 * i}", a, b, s["r"]), a), a),
            lambda left: F.struct(left.alias("l"), F.pmod(s["r"] + F.pmod(keyed(key, f"{kind}{2 * i + 1}", a, b, left), b), b).alias("r")),
        )

    for i in range(rounds):
        halves = once(halves, round_(i))
    return halves


def feistel(x: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Permutes 0 .. a*b-1."""
    halves = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    return once(network(halves, a, b, key, kind), lambda s: s["l"] * b + s["r"])


def power(n: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), n)).cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (1 to 18); one value for one value."""
    high = F.floor((F.length(digits) + 1) / 2).cast("int")
    low = F.length(digits) - high
    halves = F.struct(F.substr(digits, F.lit(1), high).cast("long").alias("l"), F.when(low > 0, F.substr(digits, high + 1, low).cast("long")).otherwise(F.lit(0).cast("long")).alias("r"))
    moved = network(halves, power(high), power(low), key, kind)
    return once(moved, lambda s: F.concat(F.lpad(s["l"].cast("string"), high, "0"), F.when(low > 0, F.lpad(s["r"].cast("string"), low, "0")).otherwise(F.lit(""))))


def permuted_letters(letters: Column, key: str, kind: str) -> Column:
    """Another string of as many letters A to Z (1 to 26); one value for one value."""
    high = F.floor((F.length(letters) + 1) / 2).cast("int")
    low = F.length(letters) - high
    size = lambda n: F.round(F.pow(F.lit(26.0), n)).cast("long")
    number = lambda text: F.aggregate(F.filter(characters(text), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s * 26 + F.ascii(c) - 65)
    halves = F.struct(number(F.substr(letters, F.lit(1), high)).alias("l"), number(F.substr(letters, high + 1)).alias("r"))
    letter = lambda x, place: F.char(F.pmod(F.floor(x / size(place)), F.lit(26)) + 65)
    places = lambda n: F.when(n > 0, F.reverse(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))).otherwise(F.array().cast("array<int>"))
    written = lambda x, n: F.array_join(F.transform(places(n), lambda place: letter(x, place)), "")
    return once(network(halves, size(high), size(low), key, kind), lambda s: F.concat(written(s["l"], high), written(s["r"], low)))


def permuted_runs(text: Column, key: str) -> Column:
    """The text of digits and capitals with every run of at most 18 of one kind permuted within its own alphabet."""
    runs = F.regexp_extract_all(text, F.lit("([0-9]{1,18}|[A-Z]{1,18})"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), permuted_digits(F.when(x.rlike("^[0-9]"), x).otherwise(F.lit("0")), key, "iban")).otherwise(permuted_letters(x, key, "iban"))), "")


def spaced(shape: Column, text: Column) -> Column:
    """The text with spaces put where the shape has them."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    step = lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))).otherwise(
        F.struct(F.concat(s["out"], F.substr(text, s["i"] + 1, F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))
    )
    return F.aggregate(characters(shape), start, step, lambda s: s["out"])


def characters(text: Column) -> Column:
    return F.split(text, "")


def refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, in order, by the given ones."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    step = lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["i"] + 1, F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))
    return F.aggregate(characters(shape), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Digit sum in which every second digit counts double (less 9 where above 9), the first one too if doubled_first."""
    start = F.struct(F.lit(0).alias("sum"), doubled_first.alias("double"))
    d = lambda c: c.cast("int")
    step = lambda s, c: F.struct(
        (s["sum"] + F.when(~s["double"], d(c)).when(d(c) > 4, d(c) * 2 - 9).otherwise(d(c) * 2)).alias("sum"), (~s["double"]).alias("double")
    )
    return F.aggregate(characters(digits), start, step, lambda s: s["sum"])


def luhn_valid(digits: Column) -> Column:
    return (luhn_sum(digits, F.length(digits) % 2 == 0) % 10 == 0) & ~digits.rlike("^(.)\\1*$")


def mod97(text: Column) -> Column:
    """The remainder of a number in which letters stand for 10 to 35."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("long")).otherwise(F.ascii(c) - 55)
    return F.aggregate(characters(text), F.lit(0).cast("long"), lambda s, c: F.pmod(F.when(c.rlike("^[0-9]$"), s * 10 + value(c)).otherwise(s * 100 + value(c)), F.lit(97)))


def pseudonym(m: Column, key: str) -> Column:
    """kind and replacement of one find; kind is null where validation fails, and the find then stays."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    made = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    stays = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))

    body = once(digits, lambda d: permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"))
    check = lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(b, F.length(b) % 2 == 1) % 10, F.lit(10)).cast("string"))
    card = refill(m, once(body, check))

    octets = F.split(m, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    half = F.lit(65_536)
    dotted = lambda x: F.concat_ws(".", *(F.pmod(F.shiftright(x, 8 * i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)))
    ip = once(once(number, lambda x: feistel(x, half, half, key, "ip")), dotted)

    area = F.substring(digits, 1, 3).cast("long")
    rank = area - 1 - (area > 666).cast("long")
    serial = (rank * 99 + F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1
    a, b = F.lit(898 * 99), F.lit(9999)
    as_ssn = lambda x: once(
        F.floor(x / (99 * 9999)).cast("long"),
        lambda r: F.concat_ws("-", F.lpad((r + 1 + (r >= 665).cast("long")).cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(x / 9999), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(x, b) + 1).cast("string"), 4, "0")),
    )
    ssn = once(once(serial, lambda x: feistel(x, a, b, key, "ssn")), as_ssn)
    ssn_valid = (area > 0) & (area < 900) & (area != 666) & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")

    iso = m.rlike("^.{4}-")
    as_date = lambda fmt: F.try_to_timestamp(m, F.lit(fmt)).cast("date")
    day = F.when(iso, as_date("yyyy-MM-dd")).otherwise(F.coalesce(as_date("dd/MM/yyyy"), as_date("MM/dd/yyyy")))
    moved = once(F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long"), lambda x: feistel(x, F.lit(17), F.lit(4297), key, "date"))
    new_day = F.date_add(F.lit("1900-01-01").cast("date"), moved.cast("int"))
    date = F.when(iso, F.date_format(new_day, "yyyy-MM-dd")).when(as_date("dd/MM/yyyy").isNotNull(), F.date_format(new_day, "dd/MM/yyyy")).otherwise(F.date_format(new_day, "MM/dd/yyyy"))

    compact = F.regexp_replace(m, " ", "")
    rearranged = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    new_bban = permuted_runs(F.substr(compact, F.lit(5)), key)
    iban = once(new_bban, lambda x: F.concat(F.substring(compact, 1, 2), F.lpad((F.lit(98) - mod97(F.concat(x, F.substring(compact, 1, 2), F.lit("00")))).cast("string"), 2, "0"), x))
    iban = once(iban, lambda x: spaced(m, x))

    local = F.substring_index(m, "@", 1)
    email = F.concat(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(local), F.lower(F.substring_index(m, "@", -1))), 256), 1, 32), F.lit("@mail.invalid"))
    value = F.regexp_extract(m, f"(?:[=:]{BETWEEN}|^\")([A-Za-z0-9_+/-]{{16,}})[\"']?$", 1)
    hashed = F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"secret{i}"), value), 256) for i in range(4)))
    secret = F.replace(m, value, F.substr(hashed, F.lit(1), F.least(F.length(value), F.lit(256))))

    kept = F.regexp_extract(m, f"^({COUNTRY})", 1)
    own = F.substr(digits, F.greatest(F.length(kept), F.lit(1)))
    phone = F.concat(kept, refill(F.substr(m, F.length(kept) + 1), permuted_digits(own, key, "phone")))

    return (
        F.when(m.contains("@"), made("email", email))
        .when(value != "", made("secret", secret))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), F.when(mod97(rearranged) == 1, made("iban", iban)).otherwise(stays))
        .when(m.rlike(f"^(?:{DATE})$"), F.when(day.isNotNull(), made("date", date)).otherwise(stays))
        .when(m.rlike(f"^(?:{IP})$"), F.when(F.forall(octets, lambda x: x.cast("int") < 256), made("ip", ip)).otherwise(stays))
        .when(m.rlike(f"^(?:{SSN})$"), F.when(ssn_valid, made("ssn", ssn)).otherwise(stays))
        .when(m.rlike("^[0-9]([ -]?[0-9]){12,18}$"), F.when(luhn_valid(digits), made("card", card)).otherwise(stays))
        .when(n.between(7, 17), made("phone", phone))
        .otherwise(stays)
    )


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: str) -> DataFrame:
    """One row per row of docs: doc_id, text (with pseudonyms), found: array of (kind, original, text).

    Card numbers (13 to 19 digits that pass the Luhn check), IBANs (mod 97), social security
    numbers, IPv4 addresses, phone numbers and dates (1900 to 2099) are permuted by a keyed Feistel
    network within their own format: the result passes the same validation, separators stay where they
    are, and so do the country codes of phone numbers and IBANs. One key maps equal values to equal pseudonyms
    and different values to different ones, in every document; only its holder can compute them.
    E-mail addresses and secrets (token = "...") have no number format; they become keyed hashes of 128 bits and more.
    What fails its validation stays as it is. An address has at most 64 characters before the @ and
    9 labels of at most 63 after it.

    Only built-in functions over the scan; no shuffle. Texts without a digit, an @ or the name of a
    secret are passed on unread by the patterns. Null text stays null, and null and empty texts have no finds; repeated rows
    each give a row; texts of any length are read whole, in time that grows with their length; an empty table gives an
    empty result; other columns are ignored.
    """
    none = F.array().cast("array<struct<kind:string,original:string,text:string>>")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    finds = F.when(F.col("text").rlike(ANY_FIND) | F.col("text").rlike(NO_DIGIT_FIND), F.regexp_extract_all("text", F.lit(f"({PATTERN})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = source.withColumn("finds", F.coalesce(finds, F.array().cast("array<string>")))
    replaced = F.when(F.size("finds") > 0, F.transform("finds", lambda m: once(pseudonym(m, key), lambda p: F.struct(p["kind"].alias("kind"), m.alias("original"), p["text"].alias("text"))))).otherwise(none)
    found = found.select("doc_id", "text", replaced.alias("replaced"))
    gaps = F.split("text", PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(gaps, "replaced", lambda gap, p: F.concat(gap, F.coalesce(p["text"], F.lit("")))), "")
    return found.select(
        "doc_id",
        F.when(F.size("replaced") > 0, rebuilt).otherwise(F.col("text")).alias("text"),
        F.filter("replaced", lambda p: p["kind"].isNotNull()).alias("found"),
    )


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING. Where it is unset, a random one for this session: its pseudonyms are linked, but with no other session's."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents"), key=session_key(spark))
    return done.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds"))
