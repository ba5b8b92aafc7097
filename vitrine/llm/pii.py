"""Format-preserving pseudonyms for personal numbers and dates, in SQL functions alone.

A keyed Feistel network permutes the values of a format among themselves: payment cards keep
their length and a right check digit, bank accounts (IBAN) their country, letters and a right
check number, telephone numbers their country and punctuation, social security numbers, IPv4
addresses and calendar dates stay valid ones. The permutation depends on the key
and the value only, so equal values stay equal across documents and whoever holds the key can
reverse it. Mail addresses and hexadecimal secrets, which have no range to permute, become
keyed digests of the same use. Whatever fails its validation is no personal number and stays.

A text is split at the candidates of one pattern; each is judged and replaced within an array
expression, and the pieces are joined again. There is no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.binding import let
from vitrine.llm.tables import fresh

ROUNDS = 10
#: Stands in where no key is configured, as in tests.
TEST_KEY = "vitrine-test-key"
KEY_SETTING = "spark.vitrine.pii.key"

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DOT_DATE = r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])"
SLASH_DATE = r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
# a number does not begin within another
_APART = r"(?<![0-9]|[0-9][.-])"
#: Three, three and four digits, with or without a country.
PHONE = (
    rf"(?:\+[0-9]{{1,3}}[ .-]?|{_APART}1[ .-]|{_APART}(?=[0-9])|(?=\())"
    r"(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-]?[0-9]{3}[ .-][0-9]{4})(?![0-9]|-[0-9])"
)
#: Ten digits without punctuation, which as an area code does not begin with 0 or 1.
BARE_PHONE = r"(?<![0-9A-Za-z_]|[0-9][.-])1?[2-9][0-9]{9}(?![0-9A-Za-z_]|[.-][0-9])"
_DATED = rf"{ISO_DATE}|{DOT_DATE}|{SLASH_DATE}|{SSN}|{IP}"
_OTHER = rf"{_DATED}|[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}|[0-9]{{13}}|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}"
#: 8 to 15 digits after a plus, grouped or not; it ends where another number begins.
WORLD_PHONE = rf"\+(?!{_DATED})[1-9](?:(?:(?:(?<![0-9]{{6}}) |[./-])(?!{_OTHER}))?\(?[0-9]\)?){{7,14}}(?![0-9])"
#: Calling codes, the rest having three digits.
CODES = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Lengths of the registered IBANs.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH",
    22: "BH BG CR GE DE IE ME RS GB VA", 23: "GI IQ IL OM SO TL AE", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MR MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_ACCOUNTS = "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[ -]?[0-9A-Z]{{4}}){{{n // 4 - 1}}}" + (f"[ -]?[0-9A-Z]{{{n % 4}}}" if n % 4 else "")
    for n, c in IBAN_COUNTRIES.items()
)
IBAN = rf"(?<![0-9A-Za-z])(?=[A-Za-z]{{2}}[0-9]{{2}})(?i:{_ACCOUNTS})(?![0-9A-Za-z])"
# most places are told from a number's beginning by one look
NUMBERS = f"{SECRET}|{IBAN}|(?=[0-9+(])(?:{'|'.join((IP, ISO_DATE, DOT_DATE, SLASH_DATE, SSN, PHONE, WORLD_PHONE, BARE_PHONE, CARD))})"
PATTERN = f"{EMAIL}|{NUMBERS}"
#: What a text without any candidate lacks.
TRACE = "[0-9@]|[a-fA-F]{32}"

FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days end on 2099-12-31
AREAS, SERIALS = 898, 99 * 9999
MONTHS, LATE_DAYS = 2400, 44249  # of the same years: days of a month from the 13th


def _round(key: str, kind: Column, turn: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def bound(body: Callable[..., Column], /, **values: Column) -> Column:
    """``body`` of named values, each evaluated once per candidate and not at every use."""
    whole = F.struct(*(v.alias(name) for name, v in values.items()))
    return let(whole, lambda s: body(**{name: s[name] for name in values}))


def feistel(value: Column, left: Column, right: Column, kind: Column, key: str, back: bool = False) -> Column:
    """``value`` below ``left * right`` permuted within that range; ``back`` reverses it."""
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def run(value: Column, left: Column, right: Column, kind: Column) -> Column:
        half = F.struct(F.floor(value / right).cast("long").alias("a"), F.pmod(value, right).alias("b"))

        def size(turn: Column) -> Column:
            return F.when(turn % 2 == 0, left).otherwise(right)

        def ahead(s: Column, i: Column) -> Column:
            return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _round(key, kind, i, s["b"]) % size(i), size(i)).alias("b"))

        def behind(s: Column, i: Column) -> Column:
            return F.struct(F.pmod(s["b"] - _round(key, kind, i, s["a"]) % size(i), size(i)).alias("a"), s["a"].alias("b"))

        return F.aggregate(turns, half, behind if back else ahead, lambda s: s["a"] * right + s["b"])

    return bound(run, value=value, left=left.cast("long"), right=right.cast("long"), kind=kind)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permute_digits(digits: Column, kind: str | Column, key: str, back: bool) -> Column:
    """A string of at most 18 digits, permuted among those of its length."""

    named = F.lit(kind) if isinstance(kind, str) else kind

    def power(size: Column) -> Column:
        return F.rpad(F.lit("1"), size + 1, "0").cast("long")

    def run(digits: Column, n: Column) -> Column:
        head = F.floor(n / 2).cast("int")
        moved = feistel(digits.cast("long"), power(head), power(n - head), F.concat(named, n.cast("string")), key, back)
        return F.lpad(moved.cast("string"), n, "0")

    return bound(run, digits=digits, n=F.length(digits))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""

    def run(shape: Column, digits: Column) -> Column:
        filled = F.aggregate(
            F.split(shape, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(
                c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
            ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        )
        return filled["out"]

    return bound(run, shape=shape, digits=digits)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, whose last digit counts once."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((s["sum"] + F.when(s["once"], d).otherwise(doubled)).alias("sum"), (~s["once"]).alias("once"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("once"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add)["sum"]


def _card(m: Column, key: str, back: bool) -> Column:
    def checked(m: Column, body: Column) -> Column:
        check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
        return _refill(m, F.concat(body, check.cast("string")))

    def run(m: Column, digits: Column) -> Column:
        body = _permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key, back)
        return F.when(luhn_sum(digits) % 10 == 0, bound(checked, m=m, body=body))

    return bound(run, m=m, digits=_digits(m))


def _mod97(text: Column) -> Column:
    """Remainder of digits and capitals, which count 10 to 35."""

    def add(s: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(letter < 10, s * 10 + letter + 7).otherwise(s * 100 + letter) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _permute_halves(digits: Column, kind: str, key: str, back: bool) -> Column:
    """As ``_permute_digits`` for 2 to 36 digits: each half is permuted in a way the other decides."""

    def run(head: Column, tail: Column) -> Column:
        def by(half: Column, other: Column) -> Column:
            return _permute_digits(half, F.concat(F.lit(f"{kind}|"), other, F.lit("|")), key, back)

        if back:
            return bound(lambda head, tail: F.concat(by(head, tail), tail), head=head, tail=by(tail, head))
        return bound(lambda head, tail: F.concat(head, by(tail, head)), head=by(head, tail), tail=tail)

    half = F.floor(F.length(digits) / 2).cast("int")
    return bound(run, head=F.substring(digits, F.lit(1), half), tail=F.substring(digits, half + 1, F.length(digits)))


def _iban(m: Column, key: str, back: bool) -> Column:
    def run(m: Column, country: Column, check: Column, account: Column) -> Column:
        def shown(digits: Column) -> Column:
            rest = _mod97(F.concat(_refill(account, digits), country, F.lit("00")))
            return _refill(m, F.concat(F.lpad((98 - rest).cast("string"), 2, "0"), digits))

        digits = _digits(account)
        fine = (F.length(digits) > 1) & (_mod97(F.concat(account, country, check)) == 1)
        return F.when(fine, bound(shown, digits=_permute_halves(digits, "iban", key, back)))

    plain = F.regexp_replace(F.upper(m), "[ -]", "")
    return bound(run, m=m, country=F.substring(plain, 1, 2), check=F.substring(plain, 3, 2), account=F.substring(plain, 5, 40))


def _phone(m: Column, key: str, back: bool) -> Column:
    """The digits after the country, permuted; bare ones among those that begin like them."""

    def run(m: Column, digits: Column, code: Column) -> Column:
        number = F.substring(digits, code + 1, F.length(digits))
        lead = F.lit(2 * 10**9)
        bare = feistel(number.cast("long") - lead, F.lit(80_000), F.lit(100_000), F.lit("bare"), key, back) + lead
        moved = F.when(m.rlike(r"^1?[2-9][0-9]{9}$"), bare.cast("string")).otherwise(_permute_digits(number, "phone", key, back))
        return _refill(m, F.concat(F.substring(digits, F.lit(1), code), moved))

    world = m.startswith("+") & ~m.rlike(f"^(?:{PHONE})$")
    digits = _digits(m)
    code = F.when(world, F.length(F.regexp_extract(digits, CODES, 0))).otherwise(F.length(digits) - 10)
    return bound(run, m=m, digits=digits, code=code)


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    number = (area - 1 - F.when(area > 666, 1).otherwise(0)) * SERIALS + (group - 1) * 9999 + serial - 1
    fine = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

    def shown(moved: Column) -> Column:
        rank, rest = F.floor(moved / SERIALS) + 1, F.pmod(moved, F.lit(SERIALS))
        parts = ((rank + F.when(rank >= 666, 1).otherwise(0), 3), (F.floor(rest / 9999) + 1, 2), (F.pmod(rest, F.lit(9999)) + 1, 4))
        return F.concat_ws("-", *(F.lpad(p.cast("string"), n, "0") for p, n in parts))

    return F.when(fine, bound(shown, moved=feistel(number, F.lit(AREAS), F.lit(SERIALS), F.lit("ssn"), key, back)))


def _ip(m: Column, key: str, back: bool) -> Column:
    def shown(moved: Column) -> Column:
        return F.concat_ws(".", *(F.pmod(F.shiftright(moved, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))

    def run(octets: Column) -> Column:
        number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
        fine = F.forall(octets, lambda o: (o.cast("int") < 256) & ((F.length(o) == 1) | ~o.startswith("0")))
        return F.when(fine, bound(shown, moved=feistel(number, F.lit(1 << 16), F.lit(1 << 16), F.lit("ip"), key, back)))

    return bound(run, octets=F.split(m, r"\."))


def _date(form: str) -> Callable[[Column, str, bool], Column]:
    def apply(m: Column, key: str, back: bool) -> Column:
        def run(number: Column) -> Column:
            moved = feistel(number, *(F.lit(n) for n in DAYS), F.lit("date"), key, back)
            fine = number.between(0, DAYS[0] * DAYS[1] - 1)
            return F.when(fine, F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), form))

        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        return bound(run, number=F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long"))

    return apply


def _late_day(m: Column, key: str, back: bool) -> Column:
    """Day-first dates that cannot be read month first, permuted among each other.

    Their number is no product, so the network moves all but the last, twice, around a shift.
    """
    first = F.lit(FIRST_DAY).cast("date")

    def earlier(month: Column) -> Column:
        return F.datediff(F.add_months(first, month), first) - 12 * month

    def most(x: Column, turn: str) -> Column:
        moved = feistel(x, F.lit(8), F.lit((LATE_DAYS - 1) // 8), F.lit(f"late{turn}"), key, back)
        return F.when(x < LATE_DAYS - 1, moved).otherwise(x)

    def shown(rank: Column, near: Column) -> Column:
        month = near + F.when(earlier(near + 1) <= rank, 1).when(earlier(near) > rank, -1).otherwise(0)
        return F.date_format(F.date_add(first, (rank + 12 * (month + 1)).cast("int")), "dd/MM/yyyy")

    def placed(rank: Column) -> Column:
        return bound(shown, rank=rank, near=F.floor(rank * MONTHS / LATE_DAYS).cast("int"))

    def run(day: Column) -> Column:
        months = (F.year(day) - 1900) * 12 + F.month(day)
        shift = LATE_DAYS // 2
        rank = (F.datediff(day, first) - 12 * months).cast("long")
        turns = ("2", "1") if back else ("1", "2")
        half = F.pmod(most(rank, turns[0]) + (-shift if back else shift), F.lit(LATE_DAYS))
        fine = (F.dayofmonth(day) > 12) & F.year(day).between(1900, 2099)
        return F.when(fine, bound(lambda half: bound(placed, rank=most(half, turns[1])), half=half))

    return bound(run, day=F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).cast("date"))


def _slash_date(m: Column, key: str, back: bool) -> Column:
    return F.when(F.substring(m, 1, 2) > "12", _late_day(m, key, back)).otherwise(_date("MM/dd/yyyy")(m, key, back))


def _mail(m: Column, key: str, back: bool) -> Column:
    if back:
        return m
    return F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(m)), 256), 1, 12), F.lit("@example.invalid"))


def _secret(m: Column, key: str, back: bool) -> Column:
    if back:
        return m
    digests = F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"secret{i}"), m), 256) for i in range(2)))
    hidden = F.substring(digests, F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(hidden)).otherwise(hidden)


#: Kinds in the order of the pattern's alternatives, each with what its whole match looks like.
KINDS: list[tuple[str, str, Callable[[Column, str, bool], Column]]] = [
    ("mail", "@", _mail),
    ("secret", r"^[0-9A-Fa-f]{32,128}$", _secret),
    ("iban", r"^[A-Za-z]", _iban),
    ("ip", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", _ip),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", _date("yyyy-MM-dd")),
    ("date", r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", _date("dd.MM.yyyy")),
    ("date", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", _slash_date),
    ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _ssn),
    ("phone", r"^[+(]|^1[ .-]\(|^(1[ .-])?[0-9]{3}[ .-]?[0-9]{3}[ .-][0-9]{4}$|^1?[2-9][0-9]{9}$", _phone),
    ("card", r"^[0-9]", _card),
]


def _replacement(m: Column, key: str, back: bool) -> Column:
    """The pseudonym of one candidate, or null if it is not valid."""
    found = F
    for _, shape, apply in KINDS:
        found = found.when(m.rlike(shape), apply(m, key, back))
    return found


def _rewritten(text: Column, key: str, back: bool) -> Column:
    """``text`` and ``n``, the number of replacements, of a text that has candidates.

    The pieces between candidates and the candidates alternate in one array, which keeps every
    expression of weight in one place.
    """
    found = F.transform(
        F.regexp_extract_all(text, _pattern(text), F.lit(0)), lambda m: F.struct(m.alias("m"), _replacement(m, key, back).alias("to"))
    )
    pieces = F.split(text, _pattern(text), -1)
    return let(
        F.struct(found.alias("found"), pieces.alias("pieces")),
        lambda s: F.struct(
            F.array_join(
                F.flatten(F.transform(s["pieces"], lambda p, i: F.array(p, _shown(F.get(s["found"], i))))), ""
            ).alias("text"),
            F.size(F.filter(s["found"], lambda e: e["to"].isNotNull())).cast("long").alias("n"),
        ),
    )


def _pattern(text: Column) -> Column:
    """The pattern a text needs: looking for mail addresses costs most, and few texts have one."""
    return F.when(text.contains("@"), F.lit(PATTERN)).otherwise(F.lit(NUMBERS))


def _shown(e: Column) -> Column:
    return F.coalesce(e["to"], e["m"], F.lit(""))


def configured_key(docs: DataFrame) -> str:
    """The session's key; the test key where none is set."""
    return docs.sparkSession.conf.get(KEY_SETTING, TEST_KEY)


def _applied(docs: DataFrame, key: str, back: bool, count: str | None) -> DataFrame:
    text, done = F.col("text"), fresh(docs, "rewritten")
    hit = text.rlike(TRACE) & F.rlike(text, _pattern(text))
    out = docs.withColumn(done, F.when(hit, _rewritten(text, key, back)))
    changes = {"text": F.coalesce(F.col(done)["text"], text)}
    if count:
        changes[count] = F.coalesce(F.col(done)["n"], F.lit(0).cast("long"))
    return out.withColumns(changes).drop(done)


def pseudonymized(docs: DataFrame, key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, and their number as ``count``.

    All other columns stay as they are; a null or empty text stays so, and rows are rewritten
    one by one, whatever their ids. Overlapping candidates are taken from left to right.
    """
    return _applied(docs, key or configured_key(docs), False, count)


def revealed(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with the permuted values restored; digests of addresses and secrets remain."""
    return _applied(docs, key or configured_key(docs), True, None)
