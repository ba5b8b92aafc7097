"""Chat formatting against a tree built by hand."""

import hashlib
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.llm.chat import LEARNED, MARKS, digests, escaped, format_conversations, parsed, read_back, unescaped, with_position_ids

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROLS = ["[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]", "[TURN]", "<s>", "</s>"]
pieces = st.sampled_from([*CONTROLS, "\\", "[", "<", " ", "a", "[\\INST]", "<\\\\/s>", "INST]", "é🙂", "\n"])
texts = st.lists(pieces, max_size=8).map("".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), texts), texts), min_size=60, max_size=120))
def test_escape_and_parse(spark, turns):
    rows = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(turns)], "i long, role string, text string")
    back = rows.select("i", escaped(F.col("text")).alias("e"), unescaped(escaped(F.col("text"))).alias("u")).collect()
    for r in back:
        assert r["u"] == turns[r["i"]][1]
        assert not any(c in r["e"] for c in CONTROLS)
    found = format_conversations(rows.select(F.col("i").alias("conv_id"), F.lit(0).alias("turn"), "role", "text"))
    told = {r["conv_id"]: (r["role"], r["text"], r["learned"]) for r in read_back(found).collect()}
    assert told == {i: (r, t, t if r == LEARNED else None) for i, (r, t) in enumerate(turns)}


class Node:
    def __init__(self, text):
        self.text, self.next, self.convs = text, {}, 0

    def total(self):
        return len(self.text) + sum(c.total() for c in self.next.values())


def spelled(role, text):
    for c in CONTROLS:  # fixtures hold no backslashes
        role, text = role.replace(c, c[0] + "\\" + c[1:]), text.replace(c, c[0] + "\\" + c[1:])
    before, behind = MARKS.get(role, (f"[ROLE] {role} [/ROLE] ", " [/TURN]"))
    return before + text + behind


def forest(rows):
    roots = {}
    ordered = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0), spelled(r[2] or "", r[3] or "").encode()))
    for _, turns in groupby(ordered, key=lambda r: r[0]):
        level = roots
        for _, _, role, text in turns:
            text = spelled(role or "", text or "")
            node = level.setdefault(text, Node(text))
            node.convs += 1
            level = node.next
    return roots


def check(found, rows):
    """Nodes are the trie's, each tree is a depth-first sequence, and intervals are the paths."""
    nodes = {r["node"]: r for r in with_position_ids(found.nodes).collect()}
    children = {}
    for r in nodes.values():
        children.setdefault(r["parent"], []).append(r)

    def same(level, parent, path, tree):
        own = {r["text"]: r for r in children.get(parent, [])}
        assert set(own) == set(level) and len(own) == len(children.get(parent, []))
        place = None
        for r in sorted(own.values(), key=lambda r: r["start"]):
            node = level[r["text"]]
            top = tree or r["node"]
            assert (r["tree"], r["n_conversations"], r["depth"], r["n_chars"]) == (top, node.convs, len(path), len(r["text"]))
            if parent is None:
                assert r["start"] == 0
            else:
                # the longest subtree first, each behind the one before, the first behind the parent
                before = path[-1]["start"] + path[-1]["n_chars"] if place is None else place[0]
                assert r["start"] == before and (place is None or node.total() <= place[1])
                place = (r["start"] + node.total(), node.total())
            want = [i for q in [*path, r] for i in range(q["start"], q["start"] + q["n_chars"])]
            assert [i for x in r["attends"] for i in range(x["first"], x["behind"])] == want
            assert all(a["behind"] < b["first"] for a, b in zip(r["attends"], r["attends"][1:]))
            assert r["position_ids"] == list(range(len(want) - r["n_chars"], len(want)))
            same(node.next, r["node"], [*path, r], top)

    same(forest(rows), None, [], None)


def by_hand(rows):
    out = {}
    ordered = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), spelled(r[2] or "", r[3] or "").encode()))
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in ordered if r[0] == conv]
        said = "".join(t for r, t in own if r == LEARNED)
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(said),
                     hashlib.sha256(said.encode()).hexdigest(), sum(len(spelled(r, t)) for r, t in own))
    return out


def sample():
    rows = []
    for conv in range(60):
        rows += [(conv, 0, "system", "common start"), (conv, 1, "user", f"question {conv % 7}")]
        rows += [(conv, 2 + i, "assistant" if i % 2 else "user", f"{'long ' * (conv % 3)}answer {(conv // 7) % (i + 1)}") for i in range(conv % 9)]
    rows += [(100, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(300)]  # one very long conversation
    rows += [(101, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(150)] + [(101, 150, "user", "other end")]
    rows += [(102, 0, "user", None), (102, None, None, "no turn, no role"), (103, 0, "user", "x" * 200_000), (104, 0, "tool", "</s>[INST] hm")]
    rows += [(105, 0, "user", "tie"), (105, 0, "assistant", "tie"), (106, 0, "user", "again"), (106, 0, "user", "again"), (107, 0, "", "")]
    rows += [(None, 0, "user", "a conversation without an id"), (None, 1, "assistant", "yes")]
    return rows


@pytest.mark.parametrize("parts", ["4", "23"])
def test_layout_and_digests(spark, parts):
    rows = sample()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        table = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", node string, place int").repartition(5)
        found = format_conversations(table)
        check(found, rows)
        told = {r["conv_id"]: tuple(r)[1:] for r in digests(read_back(found)).collect()}
        assert told == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_intervals_stay_few(spark):
    """Conversations that each leave a long one at another turn: paths follow it."""
    rows = [(c, i, "user", f"turn {i}" if i < c else f"end of {c}") for c in range(60) for i in range(c + 1)]
    found = format_conversations(spark.createDataFrame(rows, SCHEMA))
    assert found.nodes.agg(F.max(F.size("attends"))).first()[0] <= 3


def test_empty_table(spark):
    found = format_conversations(spark.createDataFrame([], SCHEMA))
    assert found.nodes.collect() == [] and digests(read_back(found)).collect() == []
