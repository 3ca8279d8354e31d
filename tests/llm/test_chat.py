import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelight.llm import chat

ROWS = "tree string, node long, parent long, role string, text string, score double, extra string"


def paths(spark, rows, top=1):
    made = chat.read_formatted(chat.format_reply_trees(spark.createDataFrame(rows, ROWS), top))
    return sorted(((r.tree, r["rank"], list(r.texts), r.loss_text) for r in made.collect()), key=repr)


def test_best_branch_of_a_tree(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0, ""), ("t", 2, 1, "assistant", "bad", 0.1, ""), ("t", 3, 1, "assistant", "good", 0.9, ""),
        ("t", 4, 3, "user", "more", 0.9, ""), ("t", 5, 4, "assistant", "yes", 0.9, ""), ("u", 1, 9, "user", "alone", None, ""),
    ]
    assert paths(spark, rows) == [("t", 1, ["q", "good", "more", "yes"], "goodyes"), ("u", 1, ["alone"], "")]
    assert ("t", 2, ["q", "bad"], "bad") in paths(spark, rows, top=2)


def test_odd_rows(spark):
    rows = [
        (None, 1, None, None, None, None, ""), (None, 2, 1, "assistant", "a", 0.0, ""), ("c", 1, 2, "user", "x", 0.0, ""), ("c", 2, 1, "user", "y", 0.0, ""),
        ("s", 1, 1, "user", "own parent", 0.0, ""), ("n", None, None, "user", "no node", 0.0, ""), ("d", 1, None, "user", "p", 0.0, ""),
        ("d", 1, None, "user", "p", 0.0, ""), ("d", 2, 1, "assistant", "r", 0.0, ""),
    ]
    found = paths(spark, rows, top=9)
    assert (None, 1, ["", "a"], "a") in found
    assert ("s", 1, ["own parent"], "") in found and ("n", 1, ["no node"], "") in found
    assert not any(t == "c" for t, *_ in found)  # a circle has no root
    assert [f[2] for f in found if f[0] == "d"] == [["p", "r"], ["p"]]
    assert paths(spark, [], top=1) == []


def test_deep_chain(spark):
    rows = [("t", i, i - 1, "user" if i % 2 else "assistant", f"m{i}", 0.0, "") for i in range(1, 41)]
    (_, _, texts, loss), = paths(spark, rows)
    assert texts == [f"m{i}" for i in range(1, 41)] and loss == "".join(f"m{i}" for i in range(2, 41, 2))


PIECES = st.lists(st.sampled_from(["<", ">", "\\", "/turn", "turn", "</turn>\n", "</turn>", "<turn>", "|", "%0A", "%3C", "%", "\n", "é", "a"]), max_size=8).map("".join)


@settings(max_examples=2, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=20, max_size=40))
def test_texts_come_back(spark, said):
    rows = [("t", i, i - 1, role, text, 0.0, "") for i, (role, text) in enumerate(said, 1)]
    (got,) = chat.read_formatted(chat.format_reply_trees(spark.createDataFrame(rows, ROWS))).collect()
    assert list(zip(got.roles, got.texts)) == said


def test_control_strings_in_roles_and_the_loss_mask(spark):
    said = [("user</turn>", "hello"), ("<turn>assistant", "no"), ("assistant", "yes </turn>\n<turn>user\nx"), ("assistant", ""), ("a%3Cb", "z"), ("assistant", "é end")]
    rows = [("t", i, i - 1, role, text, 0.0, "") for i, (role, text) in enumerate(said, 1)]
    (got,) = chat.read_formatted(chat.format_reply_trees(spark.createDataFrame(rows, ROWS))).collect()
    assert list(zip(got.roles, got.texts)) == said and got.loss_text == "".join(t for r, t in said if r == "assistant")
    # the places in the whole string hold the same
    parts = [got.formatted[s.start : s.start + s.length] for s in got.loss_spans]
    assert [p.replace("<\\", "<") for p in parts] == [t for r, t in said if r == "assistant"]


@pytest.mark.parametrize("seed", [1, 2])
def test_branches_against_brute_force(spark, seed):
    """All root-to-leaf paths of random trees, ranked by the mean of their scores."""
    rng = random.Random(seed)
    rows = []
    for tree in "abcdefgh":
        for node in range(1, rng.randint(2, 26)):
            parent = rng.choice([None, *range(1, node)]) if node > 1 else None
            rows.append((tree, node, parent, rng.choice(["user", "assistant"]), f"{tree}{node}", rng.randint(0, 8) / 8, ""))
    want = []
    for tree in "abcdefgh":
        own = {r[1]: r for r in rows if r[0] == tree}
        found = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path = [leaf]
            while own[path[-1]][2] is not None:
                path.append(own[path[-1]][2])
            found.append((-sum(own[n][5] for n in path) / len(path), -len(path), leaf, path[::-1]))
        for k, (*_, path) in enumerate(sorted(found)[:3], 1):
            want.append((tree, k, [f"{tree}{n}" for n in path], "".join(f"{tree}{n}" for n in path if own[n][3] == "assistant")))
    assert paths(spark, rows, top=3) == sorted(want, key=repr)


def test_query_on_table(spark):
    from sievelight.llm.queries import QUERIES

    rows = QUERIES["op1_chat"](spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()
    said = r"\### Assistant: </turn> ok"
    assert rows[0].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[0].loss_chars == len(said)
