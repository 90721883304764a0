"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers and dates are permuted within their format by a keyed Feistel network: the same value gets the same
pseudonym in every document, however it is written, different values get different ones, and the result is again a value
of that kind. Values that are no numbers (mail addresses, keys and tokens) get keyed hashes of their form.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS) + ")"
#: Each kind with the pattern that finds it; where two fit, the earlier one counts. Runs of any length are character classes
#: (possessive where nothing is given back) and groups repeat a few times at most, so that no text is too long to match.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|xox[abprs]-[0-9A-Za-z-]{10,72})(?![0-9A-Za-z_-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-])"
    rf"|(?<![A-Za-z]){_MONTH} \d{{1,2}}, \d{{4}}(?!\d)|(?<![\d.])\d{{1,2}} {_MONTH} \d{{4}}(?!\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\.?\d)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[-.]\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])|(?<![\w.+-])0\d{2,4}[ /]\d{5,8}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
}
PATTERN = "|".join(KINDS.values())
#: What each kind can begin with: one look tells whether its pattern is tried at a place.
_BEGINS = {"email": "[A-Za-z0-9._%+-]", "secret": "[0-9A-Fa-f]", "token": "[Agsx]", "iban": "[A-Z]", "date": "[0-9JFMASOND]", "ip": r"\d", "phone": "[+(0-9]", "ssn": r"\d", "card": r"\d"}
_SEARCH = "|".join(f"(?={_BEGINS[k]})(?:{p})" for k, p in KINDS.items())
_SEARCH_WITHOUT_AT = "|".join(f"(?={_BEGINS[k]})(?:{p})" for k, p in KINDS.items() if k != "email")
#: Stands around what is found while a text is taken apart; texts that hold it themselves are searched twice instead.
_MARK = "\ue000"
#: Days from 1800-01-01 to 2199-12-31, one full calendar cycle: 189 * 773.
_DAYS = (189, 773)
#: Country calling codes of one and of two digits (fixed values); all others have three.
CODES_OF_ONE = ("1", "7")
CODES_OF_TWO = tuple(
    "20 27 28 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, tag: Column | str) -> Column:
    """A keyed permutation of pairs (left < a, right < b) as a struct (l, r): each round adds a hash of the other half."""
    wide = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("bigint")
    tag = F.lit(tag) if isinstance(tag, str) else tag

    def noise(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")

    def step(s: Column, i: Column) -> Column:
        turned = lambda half, other, size: ((half + noise(i, other)) % wide(size)).cast("bigint")
        even = F.struct(turned(s["l"], s["r"], a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), turned(s["r"], s["l"], b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(wide(left).alias("l"), wide(right).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def permute_digits(number: Column, key: str, kind: str, first_nonzero: bool = False) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 36, or of those whose first digit is no zero."""

    def permuted(number: Column) -> Column:
        n = F.length(number)
        half = F.floor(n / 2).cast("int")
        size = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("bigint")
        low = size(half - 1) if first_nonzero else F.lit(0).cast("bigint")
        sides = feistel(
            F.substr(number, F.lit(1), half).cast("bigint") - low, F.substr(number, half + 1, n).cast("bigint"),
            size(half) - low, size(n - half), key, F.concat(F.lit(kind), n.cast("string")),
        )
        show = lambda s: F.concat(F.lpad((s["l"] + low).cast("string"), half, F.lit("0")), F.lpad(s["r"].cast("string"), n - half, F.lit("0")))
        return let(sides, show)

    return let(number, permuted)


def luhn_sum(number: Column) -> Column:
    """The Luhn sum of a digit string, its last digit being the check digit."""

    def summed(number: Column) -> Column:
        n = F.length(number)

        def value(i: Column) -> Column:
            return let(F.substr(number, n - i, F.lit(1)).cast("int") * (i % 2 + 1), lambda d: F.when(d > 9, d - 9).otherwise(d))

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + value(i))

    return let(number, summed)


def refill(shape: Column, number: Column) -> Column:
    """``shape`` with its digits replaced in order by those of ``number``."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def filled(both: Column) -> Column:
        def put(s: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            shown = F.when(is_digit, F.substr(both["number"], s["k"], F.lit(1))).otherwise(c)
            return F.struct(F.concat(s["o"], shown).alias("o"), (s["k"] + is_digit.cast("int")).alias("k"))

        chars = F.transform(F.sequence(F.lit(1), F.length(both["shape"])), lambda i: F.substr(both["shape"], i, F.lit(1)))
        return F.aggregate(chars, start, put, lambda s: s["o"])

    return let(F.struct(shape.alias("shape"), number.alias("number")), filled)


def _card(value: Column, key: str) -> Column:
    def shown(number: Column) -> Column:
        body = permute_digits(F.substr(number, F.lit(1), F.length(number) - 1), key, "card")
        whole = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(number) % 10 == 0, refill(value, whole)).otherwise(value)

    return let(digits(value), shown)


def permute_american(number: Column, key: str) -> Column:
    """A keyed permutation of ten digits of the North American plan. Area and exchange begin with 2 to 9; where one begins with 0 or
    1 it does so afterwards, so that right numbers and others never meet."""

    def permuted(number: Column) -> Column:
        part = lambda at, n: F.substr(number, F.lit(at), F.lit(n)).cast("bigint")
        low = lambda x: F.when(x < 200, 0).otherwise(200).cast("bigint")
        size = lambda x: F.when(x < 200, 200).otherwise(800).cast("bigint")
        area, exchange, line = part(1, 3), part(4, 3), part(7, 4)
        tag = F.concat(F.lit("phone"), size(area).cast("string"), F.lit("/"), size(exchange).cast("string"))
        sides = feistel(area - low(area), (exchange - low(exchange)) * 10_000 + line, size(area), size(exchange) * 10_000, key, tag)
        show = lambda s: F.concat(F.lpad((s["l"] + low(area)).cast("string"), 3, "0"), F.lpad((s["r"] + low(exchange) * 10_000).cast("string"), 7, "0"))
        return let(sides, show)

    return let(number, permuted)


def _phone(value: Column, key: str) -> Column:
    """Country codes and the zeros that numbers begin with stay, and no other number begins with one; numbers of the North American
    plan stay in it. One number is one pseudonym with or without separators, an American one also with or without its code."""
    second, third = F.substring(digits(value), 1, 1), F.substring(digits(value), 1, 2)
    code = F.when(second.isin(*CODES_OF_ONE), 1).when(third.isin(*CODES_OF_TWO), 2).otherwise(3)
    kept = F.when(F.startswith(value, F.lit("+")), code).otherwise(0)
    american = F.when(F.startswith(value, F.lit("+")), second == "1").otherwise(~value.rlike(r"^0\d{2,4}[ /]"))

    def shown(x: Column) -> Column:
        head = F.substr(x["number"], F.lit(1), x["kept"])

        def moved(y: Column) -> Column:
            zeros = F.regexp_extract(y["rest"], "^0*", 0)
            tail = F.substr(y["rest"], F.length(zeros) + 1, F.length(y["rest"]))
            plain = F.concat(zeros, F.when(F.length(tail) < 2, tail).otherwise(permute_digits(tail, key, "phone", first_nonzero=True)))
            return F.when(x["american"] & (F.length(y["rest"]) == 10), permute_american(y["rest"], key)).otherwise(plain)

        rest = F.struct(F.substr(x["number"], x["kept"] + 1, F.length(x["number"])).alias("rest"))
        return refill(value, F.concat(head, let(rest, moved)))

    return let(F.struct(digits(value).alias("number"), kept.alias("kept"), american.alias("american")), shown)


#: Social security numbers that can be given: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def _ssn(value: Column, key: str) -> Column:
    """A keyed permutation of the numbers that can be given; others stay, and none becomes one of them."""
    area, group, serial = (F.substring(value, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    at = F.when(area > 666, area - 2).otherwise(area - 1)
    sides = feistel(at, (group - 1) * _SERIALS + serial - 1, _AREAS, _GROUPS * _SERIALS, key, "ssn")

    def show(s: Column) -> Column:
        shown = F.when(s["l"] >= 665, s["l"] + 2).otherwise(s["l"] + 1)
        return F.format_string("%03d-%02d-%04d", shown, F.floor(s["r"] / _SERIALS) + 1, s["r"] % _SERIALS + 1)

    return F.when(value.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)"), let(sides, show)).otherwise(value)


def iban_rest(text: Column) -> Column:
    """What an IBAN without spaces leaves by 97, its letters counting as 10 to 35; a right one leaves 1."""
    turned = F.concat(F.substring(text, 5, 60), F.substring(text, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return let(turned, lambda t: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(t, i, F.lit(1))), F.lit(0), step))


def _iban(value: Column, key: str) -> Column:
    """The digits after the check digits are permuted, letters stay, and the check digits follow."""

    def shown(plain: Column) -> Column:
        body = digits(F.substring(plain, 5, 60))
        moved = let(permute_digits(body, key, "iban"), lambda n: refill(F.substring(plain, 5, 60), n))
        check = lambda b: F.lpad((98 - iban_rest(F.concat(F.substring(plain, 1, 2), F.lit("00"), b))).cast("string"), 2, "0")
        number = let(moved, lambda b: F.concat(check(b), digits(b)))
        return F.when((iban_rest(plain) == 1) & (F.length(body) >= 2), refill(value, number)).otherwise(value)

    return let(F.replace(value, F.lit(" ")), shown)


def _ip(value: Column, key: str) -> Column:
    def shown(parts: Column) -> Column:
        part = lambda i: F.element_at(parts, i).cast("int")
        sides = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "ip")
        return let(sides, lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))

    return let(F.split(value, r"\."), shown)


def _date(value: Column, key: str) -> Column:
    """Dates from 1800 to 2199 in their own layout; day-first where both orders are valid. Days and months keep their zeros
    where they have any; a short layout may gain or lose a digit."""

    def moved(layout: str) -> Column:
        day = F.datediff(F.try_to_timestamp(value, F.lit(layout)).cast("date"), F.lit("1800-01-01").cast("date"))

        def shown(day: Column) -> Column:
            sides = feistel(F.floor(day / _DAYS[1]), day % _DAYS[1], *_DAYS, key, "date")
            show = lambda s: F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), (s["l"] * _DAYS[1] + s["r"]).cast("int")), layout)
            return F.when((day >= 0) & (day < _DAYS[0] * _DAYS[1]), let(sides, show))

        return let(day, shown)

    slashes = F.coalesce(moved("dd/MM/yyyy"), moved("MM/dd/yyyy"), moved("d/M/yyyy"), moved("M/d/yyyy"))
    dots = F.coalesce(moved("dd.MM.yyyy"), moved("d.M.yyyy"))
    named = F.coalesce(*(moved(x) for x in ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")))
    by_layout = F.when(value.contains("/"), slashes).when(value.contains("."), dots).when(value.contains(" "), named).otherwise(moved("yyyy-MM-dd"))
    return F.coalesce(by_layout, value)


def _email(value: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256)
    return F.concat(F.lit("user-"), F.substring(digest, 1, 16), F.lit("@example.invalid"))


def _secret(value: Column, key: str) -> Column:
    digest = F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(value)), 256), F.lit(1), F.length(value))
    return F.when(value == F.upper(value), F.upper(digest)).otherwise(digest)


def _token(value: Column, key: str) -> Column:
    """The prefix that tells the token's maker stays; the rest is hexadecimal."""
    prefix = F.regexp_extract(value, r"^(?:A[KS]IA|[a-z]+[_-])", 0)
    hashed = lambda s: F.sha2(F.concat_ws("|", F.lit(key), F.lit(s), value), 256)
    digest = F.substr(F.concat(hashed("token"), hashed("token, second part")), F.lit(1), F.length(value) - F.length(prefix))
    return F.concat(prefix, F.when(F.startswith(value, F.lit("A")), F.upper(digest)).otherwise(digest))


_PSEUDONYM: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "secret": _secret, "token": _token, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card,
}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that its kind's validation rejects is left as it is."""
    out = None
    for kind, pattern in KINDS.items():
        is_kind, shown = value.rlike(rf"^(?:{pattern})$"), _PSEUDONYM[kind](value, key)
        out = F.when(is_kind, shown) if out is None else out.when(is_kind, shown)
    return out.otherwise(value)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` pseudonymised, and n_pseudonyms, the number of values replaced; other columns as they are.

    Kinds: mail addresses, hexadecimal secrets of 32 to 64 digits, tokens of some well-known makers, IBANs with a right check
    number, dates from 1800 to 2199, IPv4 addresses, phone numbers, social security numbers, card numbers with a right check
    digit. Null texts stay null with 0 replaced; empty texts, repeated rows and empty tables need no special care, and texts
    of any length are matched without recursion; a column n_pseudonyms of ``docs`` itself is replaced. ``key`` decides the
    permutations; keep it secret.
    """
    text, none = F.col("text").cast("string"), F.array().cast("array<string>")
    # Only texts with a digit or an at sign can hold any kind; those without an at sign are searched for fewer.
    marked = F.regexp_replace(text, f"({_SEARCH})", f"{_MARK}$1{_MARK}")
    marked = F.when(F.contains(text, F.lit("@")), marked).otherwise(F.regexp_replace(text, f"({_SEARCH_WITHOUT_AT})", f"{_MARK}$1{_MARK}"))
    cut = F.when(text.rlike("[0-9@]") & ~F.contains(text, F.lit(_MARK)), F.split(marked, _MARK, -1))
    odd = F.when(text.rlike("[0-9@]") & F.contains(text, F.lit(_MARK)), F.regexp_extract_all(text, F.lit(f"({_SEARCH})"), F.lit(0)))
    parts, shown = (f"{c}_{uuid4().hex[:8]}" for c in ("parts", "shown"))
    # Of the parts, every second one was found.
    found = F.when(F.size(F.col(parts)["cut"]) > 1, F.filter(F.col(parts)["cut"], lambda _, i: i % 2 == 1)).otherwise(F.coalesce(F.col(parts)["odd"], none))
    rest = F.when(F.col(parts)["odd"].isNotNull(), F.split(text, _SEARCH, -1)).otherwise(F.filter(F.col(parts)["cut"], lambda _, i: i % 2 == 0))
    rows = docs.drop("n_pseudonyms").withColumn(parts, F.struct(cut.alias("cut"), odd.alias("odd")))
    rows = rows.withColumn(shown, F.transform(found, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new"))))
    joined = F.array_join(F.zip_with(rest, shown, lambda s, v: F.concat(s, F.coalesce(v["new"], F.lit("")))), "")
    any_found = F.size(shown) > 0
    columns = [F.when(any_found, joined).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns if c != "n_pseudonyms"]
    changed = F.when(any_found, F.size(F.filter(shown, lambda p: p["old"] != p["new"]))).otherwise(0)
    return rows.select(*columns, changed.alias("n_pseudonyms"))
