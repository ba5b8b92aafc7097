"""Operators on texts against plain Python, on rows with every odd shape."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from vitrine.llm.decontam import contamination, drop_contaminated
from vitrine.llm.licenses import LICENSES, license_scan
from vitrine.llm.neardup import _exact_links, band_count, drop_near_duplicates, near_duplicates, sketch_limit
from vitrine.llm.substring import remove_repeats

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def corpus(seed=1, n=60):
    """Texts that share passages, with copies, near copies, short, long, empty and null ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "The", "ß x", "a\x1cb"]

    def prose(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passage, rows = prose(25), []
    for i in range(n):
        text = prose(rng.choice([0, 1, 4, 5, 12, 13, 40, 90]))
        if i % 5 == 0:
            text[len(text) // 2 : len(text) // 2] = passage[: rng.choice([12, 13, 25])]
        rows.append((i, " ".join(text)))
    base = prose(150)
    rows += [(n + i, " ".join(base[:j] + ["x"] * (i % 3) + base[j:])) for i, j in enumerate([10, 50, 90, 140, 20, 70])]
    rows += [(n + 20, None), (n + 21, ""), (n + 22, " \n\t"), (n + 23, rows[7][1]), (n + 24, " ".join(["for"] * 300))]
    rows.append((n + 25, " ".join(prose(30_000))))
    rows.append((n + 26, " ".join(base) + "\n" + " ".join(passage)))
    rng.shuffle(rows)
    return rows


def cut_by_hand(rows, width=13):
    first = {}
    for doc_id, text in rows:
        ws = words(text)
        for i in range(len(ws) - width + 1):
            key = tuple(ws[i : i + width])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        ws = words(text)
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        out.append((doc_id, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_substring_removal(spark, buckets):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = remove_repeats(docs, buckets=buckets).collect()
    assert sorted((tuple(r) for r in found), key=str) == cut_by_hand(rows)


def test_substring_removal_of_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(20))
    docs = spark.createDataFrame([(1, long), (1, long), (1, "z " + long), (None, long), (2, long)], SCHEMA)
    found = sorted(((r.doc_id, r.n_removed) for r in remove_repeats(docs).collect()), key=str)
    assert found == [(1, 0), (1, 0), (1, 0), (2, 20), (None, 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(empty).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 AS mark", "2 AS answers", "3 AS bucket")
    assert remove_repeats(clash).count() == 5


def alnum(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def hits_by_hand(rows, items, width=10):
    out = []
    for doc_id, text in rows:
        ws, hit, found = alnum(text), set(), set()
        for item, body in items:
            own = alnum(body)
            size = min(width, len(own))
            for j in range(len(own) - size + 1 if own else 0):
                window = own[j : j + size]
                for i in range(len(ws) - size + 1):
                    if ws[i : i + size] == window:
                        hit.update(range(i, i + size))
                        found.add(str(item))
        out.append((doc_id, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


def bench_case():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([10, 14, 30])))) for i in range(12)]
    items += [(50, "Seven-Words, of ONE short item here"), (51, "two words"), (52, None), (53, "?!"), (54, items[0][1])]
    rows = []
    for i in range(40):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 80]))]
        own = items[rng.randrange(12)][1].split()
        start = rng.randrange(len(own) - 9)
        if i % 3 == 0:
            text[len(text) // 2 : len(text) // 2] = own[start : start + 10]
        if i % 3 == 1:
            text += own[start : start + 9]
        rows.append((i, ", ".join(text).upper() if i % 2 else " ".join(text)))
    rows += [(100, None), (101, ""), (102, "seven words of one SHORT item here and two words"), (103, "two, words" * 3000)]
    return rows, items


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_contamination(spark, monkeypatch, few):
    import vitrine.llm.decontam as module

    monkeypatch.setattr(module, "FEW_PRINTS", few)
    rows, items = bench_case()
    docs, bench = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in contamination(docs, bench).collect()), key=str)
    assert found == hits_by_hand(rows, items)
    clean = {r[0] for r in found if not r[2]}
    clash = docs.selectExpr("doc_id", "text", "1 AS found_id", "2 AS row", "3 AS n_hit")
    left = drop_contaminated(clash, bench)
    assert left.columns == clash.columns
    assert {r.doc_id for r in left.collect()} == clean


def test_contamination_of_empty_tables(spark):
    rows, items = bench_case()
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in contamination(docs, bench).collect()} == {0}
    some = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(docs.limit(0), some).count() == 0


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = words(low)
    return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()


def groups_by_hand(rows, num, den):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, len(s), least[root(i)], d == least[root(i)]) for i, (d, s) in enumerate(sets))


def near_corpus(seed=3):
    rng = random.Random(seed)
    rows = corpus(seed, 30)
    base = [f"n{rng.randrange(900)}" for _ in range(120)]
    for i in range(80):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            text[rng.randrange(len(text))] = f"edit{rng.randrange(40)}"
        rows.append((200 + i, " ".join(text).title() if i % 7 == 0 else " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("num", "part"), [(85, 512), (80, 16), (60, 512)])
def test_near_duplicates(spark, monkeypatch, num, part):
    import vitrine.llm.neardup as module

    monkeypatch.setattr(module, "PART_TEXTS", part)
    rows = near_corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = sorted(tuple(r) for r in near_duplicates(docs, (num, 100)).collect())
    assert found == groups_by_hand(rows, num, 100)


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(3, text), (3, text), (5, text), (None, text), (7, None), (8, ""), (9, "a b"), (10, "A  b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert found == sorted([(3, 26, 3, True), (3, 26, 3, True), (5, 26, 3, False), (None, 26, None, True), (7, 0, 7, True),
                            (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False)], key=str)
    clash = docs.selectExpr("doc_id", "text", "1 AS copy_id", "2 AS node", "3 AS kept")
    left = drop_near_duplicates(clash)
    assert left.columns == clash.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [3, 7, 8, 9, None]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_exact_links_count_blocks(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, 6000).astype(np.uint64)) for _ in range(9)]
    sets[4] = np.unique(np.r_[sets[2][:-20], sets[4][:15]])
    table = pa.table({"node": pa.array(range(9), pa.int64()), "hashes": pa.array([s.tobytes() for s in sets])})
    links = _exact_links((9, 10))(table).to_pylist()
    assert links == [{"a": 4, "b": 2}]


def test_sketch_and_bands_are_set_for_the_threshold():
    for num in (60, 80, 85, 95):
        bands = band_count((num, 100))
        assert (1 - (num / 100) ** 4) ** bands <= 1e-8
        assert 0 < sketch_limit((num, 100), 4 * bands) < 256


def test_license_scan(spark):
    mit = LICENSES[0][1]
    odd = "Copyright (c) 2020 Some One\n\n" + mit.replace(", ", " ,\n").upper().replace("SUBLICENSE", "SUB-LICENCE")
    rows = [(1, mit), (2, "(C) 2001 A\n" + odd), (3, mit + " more"), (4, None), (5, ""),
            (6, "prose\n  released under the M.I.T. license\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    found = {r.doc_id: (r.license, r.notices) for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: ("MIT", []), 2: ("MIT", []), 3: (None, []), 4: (None, []), 5: (None, []), 6: (None, ["CC-BY-NC-4.0", "MIT"])}
    digests = {r.doc_id: r.digest for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert digests[1] == digests[2] and digests[4] is None and digests[5] == hashlib.sha256(b"").hexdigest()
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS digest", "2 AS license", "3 AS notices")
    assert license_scan(clash).count() == 6
    assert license_scan(clash.limit(0)).count() == 0


def test_licenses_of_any_width(spark):
    import textwrap

    head = "Copyright (c) 2020 Some One\nCopyright The Authors\n© 2021 B\nCopyright holders: 2019 C\n"
    rows = [(1000 * n + width, head + textwrap.fill(text, width, break_long_words=False, break_on_hyphens=False))
            for n, (_, text) in enumerate(LICENSES) for width in range(40, 101)]
    found = {r.doc_id: r.license for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: LICENSES[i // 1000][0] for i, _ in rows}


def test_contaminated_rows_go_one_by_one(spark):
    named, unnamed = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    rows = [(1, f"x {named} y"), (1, "clean text"), (2, f"{unnamed} z"), (3, "clean too"), (3, "clean too")]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([("i", named), (None, unnamed)], "item_id string, text string")
    found = sorted((r.doc_id, r.n_hit, r["items"]) for r in contamination(docs, bench).collect())
    assert found == [(1, 0, []), (1, 10, ["i"]), (2, 10, []), (3, 0, []), (3, 0, [])]
    assert sorted(tuple(r) for r in drop_contaminated(docs, bench).collect()) == [rows[1], rows[3], rows[3]]
