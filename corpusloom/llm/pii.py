"""Pseudonyms for personal data, with DataFrame functions only.

Numbers and dates are validated, then permuted within their format by a keyed Feistel network, so that
equal values get equal pseudonyms in all documents, different values different ones, and the holder of
the key can undo it. The two halves of a value are numbers modulo A and B; in each round one half gets a
keyed hash of the other added. This permutes all A * B values without a search. A pseudonym is valid in
the way its value is; numbers that only look like one stay as they are.

- Card numbers: an issuer's range and length, and the Luhn check. The first four digits, which name the
  issuer, stay, those up to the last are permuted, the check digit is set anew.
- IBANs, with or without single spaces: the country's length and the check digits modulo 97. The digits
  after them are permuted, letters stay, check digits are set anew.
- Social security numbers (3-2-4 digits): area, group and serial in use, permuted among those.
- Dates of the calendar (Y-M-D, D.M.Y, D/M/Y with four-digit years from 400 on): permuted among the days
  of the Gregorian cycle of 400 years that they are in.
- IPv4 addresses: four bytes, permuted among all but those of four single digits, which, like numbers after a word
  for versions, count as version numbers.
- Telephone numbers: with a plus sign 8 to 15 digits after ITU E.164, of which the national ones are permuted; else 3-3-4
  digits whose area and exchange begin with 2 to 9, permuted among those. Separators and country code stay.
Values without a numeric format, e-mail addresses and secrets (hexadecimal keys of 32 digits or more,
access tokens of well-known prefixes), get a keyed digest of their own length class: an address keeps
the form of an address, a secret its length, a token its prefix too.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The Spark setting that holds the key.
KEY_SETTING = "spark.corpusloom.pii.secret"  # settings with this word are redacted in Spark's UI and logs
ROUNDS = 8
#: Days of the Gregorian cycle, 400 years; the product of the two moduli that dates are permuted by.
CYCLE_DAYS = 146_097
DATE_HALVES = (189, 773)
#: North American area codes, or exchanges, and the numbers of a line.
CODES, LINES = 800, 10_000
#: How often an address that has become four single digits is permuted again; each time one in 430,000 does.
WALK = 5
#: Social security numbers in use: areas 1 to 899 but 666, groups 1 to 99, serials 1 to 9999.
SSN_HALVES = (898 * 99, 9999)

#: Lengths of IBANs by country. Fixed values.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO FK GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Issuers' ranges of card numbers with their lengths. Fixed values.
ISSUERS = "|".join(
    (
        r"4[0-9]{12}(?:[0-9]{3}){0,2}",
        r"5[1-5][0-9]{14}",
        r"2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}",
        r"3[47][0-9]{13}",
        r"3(?:0[0-5][0-9]|[689][0-9]{2})[0-9]{10,15}",
        r"6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12,15}",
        r"35(?:2[89]|[3-8][0-9])[0-9]{12,15}",
        r"62[0-9]{14,17}",
        r"(?:50|5[6-8]|63|67)[0-9]{11,17}",
    )
)
#: Country codes of the telephone network, by their lengths. Fixed values.
COUNTRY_CODE = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
#: Prefixes of access tokens that well-known services give out, and what follows them. Fixed values.
TOKENS = {
    r"(?:AKIA|ASIA)": r"[A-Z0-9]{16}",
    r"gh[pousr]_": r"[A-Za-z0-9]{36,}",
    r"github_pat_": r"[A-Za-z0-9_]{22,}",
    r"glpat-": r"[A-Za-z0-9_-]{20,}",
    r"sk-(?:ant-|proj-)?": r"[A-Za-z0-9_-]{20,}",
    r"[sr]k_(?:live|test)_": r"[A-Za-z0-9]{16,}",
    r"xox[abeprs]-": r"[A-Za-z0-9-]{10,}",
    r"AIza": r"[A-Za-z0-9_-]{35}",
    r"eyJ": r"[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}",
}

EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}"
#: Four numbers of one digit each, or after a word for versions, are a version number.
IPV4 = r"(?<![0-9.])(?<!\b(?i:v|ver|version|release|rev|build)[ .:=]{0,2})(?![0-9](?:\.[0-9]){3}(?![0-9]))(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
NATIONAL = r"(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
#: Without a country code, area and exchange are those that the North American plan gives out.
AMERICAN = r"(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}"
PHONE = rf"(?<![0-9A-Za-z])(?:\+[0-9]{{1,3}}[ .-]?{NATIONAL}|{AMERICAN}|\+(?=(?:[ ().-]{{0,2}}[0-9]){{8,15}}(?![ .-]?[0-9]))[1-9][0-9]{{0,14}}(?:[ .-]?(?:\([0-9]{{1,5}}\)|[0-9]{{1,14}})){{0,7}})(?![0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])"
DATE = r"(?<![0-9.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])"
TOKEN = "(?<![0-9A-Za-z_-])(?:" + "|".join(a + b for a, b in TOKENS.items()) + ")(?![0-9A-Za-z_-])"
#: In this order: of the kinds that match at one place, the first takes it.
KINDS = {"email": EMAIL, "secret": SECRET, "token": TOKEN, "iban": IBAN, "ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())
#: What a text with any value has: a token's prefix, or a digit or @, without which no other kind matches.
MAYBE = "[0-9@]|" + "|".join(TOKENS)


def session_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING. Where it is unset, one is drawn for the session: values are then linked
    within its results, and nobody can undo them or link them with those of another session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """One row with the key as `secret`: a plan shows the column's name, not what it holds."""
    return spark.sql("SELECT * FROM VALUES (:key) AS held(secret)", {"key": key})


def _round(key: Column | str, tweak: Column, i: Column, half: Column, modulus: Column) -> Column:
    """A keyed hash of one half, below a modulus of at most 10 to the 15th."""
    hexes = F.sha2(F.concat_ws("|", _held(key), tweak, i.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(hexes, 1, 15), 16, 10).cast("bigint"), modulus)


def _held(key: Column | str) -> Column:
    return key if isinstance(key, Column) else F.lit(key)


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column | str, tweak: Column, undo: bool = False) -> Column:
    """(l, r) of the permuted pair of left (modulo a) and right (modulo b)."""
    steps = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS))])
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    sign = F.lit(-1 if undo else 1)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        l2 = F.when(even, F.pmod(s["l"] + sign * _round(key, tweak, i, s["r"], a), a)).otherwise(s["l"])
        r2 = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * _round(key, tweak, i, s["l"], b), b))
        return F.struct(l2.cast("bigint").alias("l"), r2.cast("bigint").alias("r"))

    return F.aggregate(steps, start, step)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(digits: Column, key: Column | str, tweak: Column, undo: bool = False) -> Column:
    """A string of 2 to 30 digits, permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("bigint")
    left, right = F.substring(digits, F.lit(1), half).cast("bigint"), F.substring(digits, half + 1, rest).cast("bigint")
    made = feistel(left, right, power(half), power(rest), key, F.concat(tweak, F.length(digits).cast("string")), undo)
    return F.when(F.length(digits) < 2, digits).otherwise(_let(made, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0"))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(template: Column, filling: Column, places: str = "[0-9]") -> Column:
    """template with its digits (or what else the class says) replaced, in turn, by the filling's characters."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        here = c.rlike(f"^{places}$")
        return F.struct(F.concat(s["out"], F.when(here, F.substring(filling, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + here.cast("int")).alias("at"))

    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def luhn(payload: Column) -> Column:
    """The Luhn check digit of a string of digits."""
    each = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, F.pmod(2 * c.cast("int") - 1, F.lit(9)) + F.when(c == "0", -8).otherwise(1)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda s, x: s + x), F.lit(10))


def _valid_card(value: Column) -> Column:
    return _let(_digits(value), lambda d: d.rlike(f"^(?:{ISSUERS})$") & (F.substring(d, -1, 1).cast("int") == luhn(F.substring(d, F.lit(1), F.length(d) - 1))))


def _card(value: Column, key: Column | str, undo: bool) -> Column:
    def body(d: Column) -> Column:
        issuer, own = F.substring(d, 1, 4), F.substring(d, F.lit(5), F.length(d) - 5)
        payload = F.concat(issuer, permute_digits(own, key, F.concat(F.lit("card"), issuer), undo))
        return _let(payload, lambda p: F.concat(p, luhn(p).cast("string")))

    return refill(value, _let(_digits(value), body))


def _phone(value: Column, key: Column | str, undo: bool) -> Column:
    def american(d: Column) -> Column:
        part = lambda at, n: F.substring(d, at, n).cast("bigint")
        a, b = (F.lit(x).cast("bigint") for x in (CODES * CODES, LINES))
        made = feistel((part(1, 3) - 200) * CODES + part(4, 3) - 200, part(7, 4), a, b, key, F.lit("phone"), undo)
        code = lambda x: (x.cast("bigint") + 200).cast("string")
        return _let(made, lambda p: F.concat(code(F.floor(p["l"] / CODES)), code(F.pmod(p["l"], F.lit(CODES))), F.lpad(p["r"].cast("string"), 4, "0")))

    def body(d: Column) -> Column:
        return F.when(value.startswith("+"), abroad(d)).otherwise(american(d))

    def abroad(d: Column) -> Column:
        code = F.when(value.startswith("+"), F.regexp_extract(d, f"^({COUNTRY_CODE})", 1)).otherwise("")
        return _let(code, lambda c: F.concat(c, permute_digits(F.substring(d, F.length(c) + 1, F.length(d)), key, F.concat(F.lit("phone"), c), undo)))

    return refill(value, _let(_digits(value), body))


def _ssn(value: Column, key: Column | str, undo: bool) -> Column:
    part = lambda d, at, n: F.substring(d, at, n).cast("bigint")

    def body(d: Column) -> Column:
        area = part(d, 1, 3) - 1 - (part(d, 1, 3) > 666).cast("int")
        a, b = (F.lit(x).cast("bigint") for x in SSN_HALVES)
        return _let(feistel(area * 99 + part(d, 4, 2) - 1, part(d, 6, 4) - 1, a, b, key, F.lit("ssn"), undo), made)

    def made(p: Column) -> Column:
        area = F.floor(p["l"] / 99)
        pad = lambda x, n: F.lpad(x.cast("bigint").cast("string"), n, "0")
        return F.concat(pad(area + 1 + (area >= 665).cast("int"), 3), pad(F.pmod(p["l"], F.lit(99)) + 1, 2), pad(p["r"] + 1, 4))

    return refill(value, _let(_digits(value), body))


def _ipv4(value: Column, key: Column | str, undo: bool) -> Column:
    part = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("bigint")
    size = F.lit(65536).cast("bigint")
    single = lambda s: (F.pmod(s["l"], F.lit(256)) < 10) & (s["l"] < 2560) & (F.pmod(s["r"], F.lit(256)) < 10) & (s["r"] < 2560)
    permuted = lambda l, r: feistel(l, r, size, size, key, F.lit("ipv4"), undo)
    first = permuted(part(1) * 256 + part(2), part(3) * 256 + part(4))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda s, i: F.when(single(s), permuted(s["l"], s["r"])).otherwise(s))
    byte = lambda x, i: (F.floor(x / 256) if i == 0 else F.pmod(x, F.lit(256))).cast("bigint").cast("string")
    return _let(made, lambda p: F.concat_ws(".", byte(p["l"], 0), byte(p["l"], 1), byte(p["r"], 0), byte(p["r"], 1)))


def _parsed_date(value: Column) -> Column:
    year_first = value.rlike("^[0-9]{4}-")
    iso = F.when(year_first, value).otherwise(F.concat(F.substring(value, 7, 4), F.lit("-"), F.substring(value, 4, 2), F.lit("-"), F.substring(value, 1, 2)))
    return F.when(iso >= "0400", F.try_to_date(iso, "yyyy-MM-dd"))


def _date(value: Column, key: Column | str, undo: bool) -> Column:
    start = F.lit("2000-01-01").cast("date")

    def body(day: Column) -> Column:
        cycle = F.floor(day / CYCLE_DAYS).cast("bigint")
        within = F.pmod(day, F.lit(CYCLE_DAYS))
        a, b = (F.lit(x).cast("bigint") for x in DATE_HALVES)
        made = feistel(F.floor(within / DATE_HALVES[1]), F.pmod(within, b), a, b, key, F.lit("date"), undo)
        new = _let(made, lambda p: F.date_add(start, (cycle * CYCLE_DAYS + p["l"] * DATE_HALVES[1] + p["r"]).cast("int")))
        dot = F.when(value.contains("."), F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
        return F.when(value.rlike("^[0-9]{4}-"), F.date_format(new, "yyyy-MM-dd")).otherwise(dot)

    return F.coalesce(_let(F.datediff(_parsed_date(value), start).cast("bigint"), body), value)


def _numeric(letters: Column) -> Column:
    """Letters as their two-digit numbers, A = 10."""
    return F.array_join(F.transform(F.split(letters, ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def _mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda s, c: F.pmod(s * 10 + c.cast("int"), F.lit(97)))


def _check_digits(rest: Column, country: Column) -> Column:
    return 98 - _mod97(F.concat(_numeric(F.concat(rest, country)), F.lit("00")))


def _valid_iban(value: Column) -> Column:
    return _let(F.replace(value, F.lit(" "), F.lit("")), lambda v: F.substring(v, 3, 2).cast("int") == _check_digits(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 2)))


def _iban(value: Column, key: Column | str, undo: bool) -> Column:
    def body(v: Column) -> Column:
        country, rest = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.length(v))
        new = refill(rest, permute_digits(_digits(rest), key, F.concat(F.lit("iban"), country, F.regexp_replace(rest, "[0-9]", "0")), undo))
        return _let(new, lambda r: F.concat(country, F.lpad(_check_digits(r, country).cast("string"), 2, "0"), r))

    return refill(value, _let(F.replace(value, F.lit(" "), F.lit("")), body), "[A-Z0-9]")


def _hashed(value: Column, kind: str, key: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", _held(key), F.lit(kind), F.lower(value)), 256)


def _email(value: Column, key: Column | str) -> Column:
    return F.concat(F.lit("user"), F.substring(_hashed(value, "email", key), 1, 12), F.lit("@example.invalid"))


def _secret(value: Column, key: Column | str) -> Column:
    whole = F.concat(_hashed(value, "secret", key), _hashed(value, "secret+", key))
    return F.substring(F.repeat(whole, F.ceil(F.length(value) / 128).cast("int")), F.lit(1), F.length(value))


def _token(value: Column, key: Column | str) -> Column:
    prefix = F.regexp_extract(value, f"^({'|'.join(TOKENS)})", 1)
    whole = F.concat(_hashed(value, "token", key), _hashed(value, "token+", key))
    return _let(prefix, lambda p: F.concat(p, F.substring(F.repeat(whole, F.ceil(F.length(value) / 128).cast("int")), F.lit(1), F.length(value) - F.length(p))))


def kind_of(value: Column) -> Column:
    """The kind that the whole of a value has the form of and is valid by; null if there is none."""
    is_a = lambda kind: value.rlike(f"^(?:{KINDS[kind]})$")
    valid = {"iban": _valid_iban(value), "date": _parsed_date(value).isNotNull(), "card": _valid_card(value)}
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(is_a(kind), F.when(valid[kind], kind) if kind in valid else kind).otherwise(out)
    return out


def pseudonym(value: Column, key: Column | str, undo: bool = False) -> Column:
    """The pseudonym of one value, by the kind whose whole form it has; other values stay.

    undo gives a number's or a date's value back; digests can't be undone and stay.
    """
    made = {"iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    digest = {"email": _email, "secret": _secret, "token": _token}

    def body(kind: Column) -> Column:
        out = F.when(kind.isNull(), value)
        for name, f in made.items():
            out = out.when(kind == name, f(value, key, undo))
        for name, f in digest.items():
            out = out.when(kind == name, value if undo else f(value, key))
        return out.otherwise(value)

    return _let(kind_of(value), body)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with every value found in the text replaced by its pseudonym; optionally their number.

    Null texts stay null with 0 values, empty texts empty. Columns and rows are kept as they are,
    repeated rows too; the count takes the place of a column of its name. Texts are cut at the values,
    so a text of any length is worked through once. An empty key is refused.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    col = F.col(f"`{text}`")
    names = set(docs.columns)
    v, held = (next(f"__{name}{i}" for i in range(len(names) + 1) if f"__{name}{i}" not in names) for name in ("values", "held"))
    out = docs.withColumn(held, key_table(docs.sparkSession, key).scalar()).withColumn(v, F.when(col.rlike(MAYBE), F.regexp_extract_all(col, F.lit(f"({ANY})"), F.lit(1))))
    new = F.transform(F.col(v), lambda x: pseudonym(x, F.col(held)))
    pieces = F.zip_with(F.split(col, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    out = out.withColumn(text, F.when(F.size(v) > 0, F.array_join(pieces, "")).otherwise(col))
    if count:
        out = out.withColumn(count, F.greatest(F.coalesce(F.size(F.filter(v, lambda x: kind_of(x).isNotNull())), F.lit(0)), F.lit(0)).cast("bigint"))
    return out.drop(v, held)
