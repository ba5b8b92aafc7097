"""Pseudonyms against the same rules in plain Python."""

import datetime
import hashlib
import re

from vitrine.llm.pii import AREAS, DAYS, PATTERN, ROUNDS, SERIALS, pseudonymized, revealed

KEY = "k1"


def permute(value, left, right, kind, back=False):
    def f(i, half):
        return int(hashlib.sha256(f"{KEY}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16)

    a, b = divmod(value, right)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        size = left if i % 2 == 0 else right
        a, b = ((b - f(i, a)) % size, a) if back else (b, (a + f(i, b)) % size)
    return a * right + b


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def with_check(body):
    return next(body + c for c in "0123456789" if luhn(body + c))


def digits(text, kind):
    n = len(text)
    return str(permute(int(text), 10 ** (n // 2), 10 ** (n - n // 2), f"{kind}{n}")).zfill(n)


def refill(shape, new):
    out = iter(new)
    return "".join(next(out) if c.isdigit() else c for c in shape)


def by_hand(m):
    if "@" in m:
        return "user" + hashlib.sha256(f"{KEY}|mail|{m.lower()}".encode()).hexdigest()[:12] + "@example.invalid"
    if re.fullmatch("[0-9A-Fa-f]{32,128}", m):
        new = "".join(hashlib.sha256(f"{KEY}|secret{i}|{m}".encode()).hexdigest() for i in range(2))[: len(m)]
        return new.upper() if m == m.upper() else new
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        parts = m.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return m
        v = 0
        for p in parts:
            v = v * 256 + int(p)
        new = permute(v, 1 << 16, 1 << 16, "ip")
        return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
    for shape, form in ((r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"\d\d\.\d\d\.\d{4}", "%d.%m.%Y"), (r"\d\d/\d\d/\d{4}", "%m/%d/%Y")):
        if re.fullmatch(shape, m):
            try:
                n = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
            except ValueError:
                return m
            if not 0 <= n < DAYS[0] * DAYS[1]:
                return m
            return (datetime.date(1900, 1, 1) + datetime.timedelta(permute(n, *DAYS, "date"))).strftime(form)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return m
        new = permute((area - 1 - (area > 666)) * SERIALS + (group - 1) * 9999 + serial - 1, AREAS, SERIALS, "ssn")
        rank, rest = new // SERIALS + 1, new % SERIALS
        return f"{rank + (rank >= 666):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    plain = re.sub(r"\D", "", m)
    if re.fullmatch(r"(\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}", m):
        return refill(m, plain[:-10] + digits(plain[-10:], "phone"))
    return refill(m, with_check(digits(plain[:-1], "card"))) if luhn(plain) else m


VALUES = ["4539 1488 0343 6467", "4539148803436467", "4539148803436468", "3782-822463-10005", "6011000990139424", "1234567890123",
          "+1 (017) 555-7713", "212-555-0187", "(212) 555-0187", "+44 212.555.0187", "123-45-6789", "000-45-6789", "666-12-1234",
          "899-99-9999", "667-01-0001", "665-01-0001", "1.2.3.4", "255.255.255.255", "256.1.1.1", "01.2.3.4", "2020-02-29",
          "2021-02-29", "1900-01-01", "2099-12-31", "1899-12-31", "31.12.1999", "12/31/1999", "13/31/1999", "die.19@mail8.example.com",
          "Éa.b+c@x-y.org", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "a@b", "12345", "3.14",
          "1" * 400, "x" * 3000]


def test_every_format_by_hand(spark):
    texts = [f"é {v}, then {v}." for v in VALUES] + [" ".join(VALUES), "", None, "no numbers", "@", "7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS m")
    found = {r.doc_id: r for r in pseudonymized(docs, KEY, "n_replaced").collect()}
    import regex

    for i, text in enumerate(texts):
        new = [by_hand(m) for m in (x.group() for x in regex.finditer(PATTERN, text or ""))]
        old = [x.group() for x in regex.finditer(PATTERN, text or "")]
        it = iter(new)
        assert found[i].text == (None if text is None else regex.sub(PATTERN, lambda m: next(it), text)), text
        assert found[i].n_replaced == sum(a != b or "@" in a for a, b in zip(old, new)), text
    assert {"4539148803436468", "256.1.1.1", "666-12-1234", "2021-02-29"} <= set(re.findall(r"[\d.-]*\d", found[len(VALUES)].text))


def test_who_holds_the_key_reverses_it(spark):
    kept = [v for v in VALUES if "@" not in v and not re.search("[a-fA-F]", v)]
    docs = spark.createDataFrame([(i, f"{v} and é{v}") for i, v in enumerate(kept)], "doc_id long, text string")
    hidden = pseudonymized(docs, KEY)
    assert sorted(tuple(r) for r in revealed(hidden, KEY).collect()) == sorted(tuple(r) for r in docs.collect())
    other = {r.doc_id: r.text for r in pseudonymized(docs, "k2").collect()}
    changed = [r for r in hidden.collect() if kept[r.doc_id] not in r.text]
    assert len(changed) > 12 and all(other[r.doc_id] != r.text for r in changed)


def test_plan_holds_no_python(spark):
    docs = spark.createDataFrame([(1, "a 1.2.3.4")], "doc_id long, text string")
    plan = pseudonymized(docs, KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert pseudonymized(docs.limit(0), KEY).count() == 0


def test_permutations_cover_their_range():
    assert len({permute(v, *DAYS, "date") for v in range(DAYS[0] * DAYS[1])}) == DAYS[0] * DAYS[1] == 73049
    assert all(permute(permute(v, 7, 10, "x"), 7, 10, "x", True) == v for v in range(70))


WRITTEN = ["+1-555-123-4567", "+1.555.123.4567", "1-800-555-1234", "+15551234567", "5551234567", "+44 20 7946 0958", "+49 30 1234567",
           "+442079460958", "+33 6 12 34 56 78", "+44 (0)20 7946 0958", "(555) 1234567", "25/12/1999", "31/01/1900", "31/12/2099",
           "9233a8ECF7c5b09fe5949719b6b82bc4", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32",
           "FR14 2004 1010 0505 0001 3M02 606", "BE68 5390 0754 7034"]


def test_other_ways_to_write_them(spark):
    docs = spark.createDataFrame(list(enumerate(f"Call {v}, or {v}." for v in WRITTEN)), "doc_id long, text string")
    hidden = pseudonymized(docs, KEY, "n")
    found = {r.doc_id: r for r in hidden.collect()}
    for i, v in enumerate(WRITTEN):
        a, b = re.fullmatch("Call (.*), or (.*)[.]", found[i].text).groups()
        assert a == b != v and found[i].n == 2, v
        assert re.sub("[0-9a-fA-F]" if i == 14 else "[0-9]", "#", a) == re.sub("[0-9a-fA-F]" if i == 14 else "[0-9]", "#", v)
        if v[:2].isalpha():
            turned = re.sub(" ", "", a)[4:] + a[:4]
            assert int("".join(str(int(c, 36)) for c in turned)) % 97 == 1
    back = {r.doc_id: r.text for r in revealed(hidden.select("doc_id", "text"), KEY).collect()}
    assert all(back[i] == f"Call {v}, or {v}." for i, v in enumerate(WRITTEN) if i != 14)


def test_what_stands_beside_a_telephone_number(spark):
    kept = ["1700000000", "DE88 3704 0044 0532 0130 00", "32/12/1999", "31/02/1999", "+1 apple", "id_5551234567", "3.5551234567"]
    docs = spark.createDataFrame(list(enumerate([*kept, "+49 30 1234567 4539 1488 0343 6467", "+49 30 1234567 24 hours"])), "doc_id long, text string")
    found = {r.doc_id: r.text for r in pseudonymized(docs, KEY).collect()}
    assert [found[i] for i in range(len(kept))] == kept
    alone = spark.createDataFrame([(0, "+49 30 1234567"), (1, "4539 1488 0343 6467")], "doc_id long, text string")
    phone, card = (r.text for r in pseudonymized(alone, KEY).orderBy("doc_id").collect())
    assert found[len(kept)] == f"{phone} {card}" and found[len(kept) + 1] == f"{phone} 24 hours"


def test_late_days_are_permuted(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(n) for n in range(73049)]
    late = [(i, d.strftime("%d/%m/%Y")) for i, d in enumerate(days) if d.day > 12]
    docs = spark.createDataFrame(late, "doc_id long, text string")
    hidden = pseudonymized(docs, KEY)
    rows = hidden.collect()
    assert {r.text for r in rows} == {t for _, t in late} and len(rows) == len(late) == 44249
    assert revealed(hidden, KEY).exceptAll(docs).count() == 0
