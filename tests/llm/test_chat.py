"""Windows read back, budgets, and a conversation that holds most rows."""

import hashlib
from collections import defaultdict

import pytest

from tests.llm import helpers as H
from tributary.llm import chat, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ODD = [
    (1, 0, "system", "be <s> brief [INST]"), (1, 1, "user", None), (1, 2, None, "who\\"), (1, 3, "assistant", "</s>[INST] ok [/INST]"),
    (1, None, "user", "first"), (1, 3, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "assistant", "a"), (None, 0, "assistant", "é😀\n<|x|>\\<s>"),
    (2, 5, "ro\nle\\n<s>", "<" * 5), (2, 6, "assistant", ""), (3, 0, "user", "\\" * 7 + "<s>" * 5), (3, 10**12, "assistant", H.prose(1, 3000)),
    (4, 0, "user", H.prose(2, 400)), (4, 1, "system", "late"), (4, 2, "assistant", H.prose(3, 9)), (4, 3, "user", "x"),
]


def _expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        targets = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(targets), hashlib.sha256(targets.encode()).hexdigest())
    return out


def _read(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(df).collect()}


def test_query_matches_plain_python(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in H.corpus(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = _expected(rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    found = queries.op1_chat_windows(spark, H.SF_DIR).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found} == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in found)


@pytest.mark.parametrize("budget,history", [(1024, 128), (60, 20), (12, 4), (1, 0), (300, 290)])
def test_odd_conversations_read_back(spark, budget, history):
    turns = spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("nothing", "x")
    assert _read(chat.windows(turns, budget, history)) == _expected(ODD)


def test_windows_hold_their_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "be brief and kind")] + [
        (1, i, "assistant" if i % 2 else "user", H.prose(i, 5 + i % 17)) for i in range(1, 600)
    ]
    found = sorted(chat.windows(spark.createDataFrame(rows, SCHEMA), 120, 30).collect(), key=lambda r: r["window"])
    assert len(found) > 50
    for r in found:
        turns = chat.read_turns(r["text"])
        assert turns[0] == ("system", "be brief and kind")
        assert r["n_tokens"] <= 120 and len(turns) > r["n_repeated"]
        assert "</s><s>" not in r["text"].replace("</s><s>", "", len(turns) - 1)
        targets = [chat.unescaped(r["text"][s["start"] : s["end"]]) for s in r["targets"]]
        assert targets == [t for role, t in turns[r["n_repeated"] :] if role == "assistant"]
    assert sum(r["n_repeated"] > 1 for r in found) > len(found) / 2
    assert _read(chat.windows(spark.createDataFrame(rows, SCHEMA), 120, 30)) == _expected(rows)


def _greedy(sizes, system, budget, history, span):
    """Windows of one conversation as lists of new turns, filled one after another."""
    out, start, part, held, room = [], 0, None, 0, 0
    for i, size in enumerate(sizes):
        if start // (span * budget) != part or held + size > room:
            part, held = start // (span * budget), 0
            room = max(budget - history - system, 1) if start else budget
            out.append([])
        out[-1].append(i)
        held += size
        start += size
    return out


def test_windows_are_full(spark, monkeypatch):
    """Against filling by hand: fitting conversations are whole, longer ones fill their windows."""
    monkeypatch.setattr(chat, "SPAN", 3)
    talks = {c: [5 + (7 * c + 13 * i) % 40 for i in range(1 + c * c % 70)] for c in range(40)}
    rows = [(c, i, "assistant" if i % 2 else "user", " ".join(f"w{c}x{i}" for _ in range(n - 4))) for c, ns in talks.items() for i, n in enumerate(ns)]
    found = defaultdict(list)
    for r in sorted(chat.windows(spark.createDataFrame(rows, SCHEMA), 200, 40).collect(), key=lambda r: (r["conv_id"], r["window"])):
        found[r["conv_id"]].append(r)
    fills = []
    for c, ns in talks.items():
        want = _greedy(ns, 0, 200, 40, 3)
        assert [len(chat.read_turns(r["text"])) - r["n_repeated"] for r in found[c]] == [len(w) for w in want]
        if sum(ns) <= 200:
            assert len(found[c]) == 1
        for r, w in zip(found[c], want):
            before, k = 0, w[0]
            while k and before + ns[k - 1] <= 40:
                k -= 1
                before += ns[k]
            assert r["n_repeated"] == w[0] - k and r["n_tokens"] == before + sum(ns[i] for i in w) <= 200
        fills += [r["n_tokens"] / 200 for r in found[c][:-1]]
    assert sum(fills) / len(fills) > 0.8
    assert _read(chat.windows(spark.createDataFrame(rows, SCHEMA), 200, 40)) == _expected(rows)


def test_texts_hold_no_control_strings(spark):
    found = chat.windows(spark.createDataFrame(ODD, SCHEMA)).collect()
    for r in found:
        for piece in r["text"].split("</s>")[:-1]:
            assert piece.startswith("<s>") and "<s>" not in piece[3:] and "[INST]" not in piece and "[/INST]" not in piece


def test_empty_table_and_clashing_columns(spark):
    empty = chat.digests(chat.windows(spark.createDataFrame([], SCHEMA)))
    assert empty.collect() == []
    turns = spark.createDataFrame(ODD, SCHEMA)
    more = turns.selectExpr("*", "1 as conv", "2 as start", "3 as own", "4 as k", "5 as system", "6 as head", "7 as tokens", "8 as c")
    assert _read(chat.windows(more)) == _expected(ODD)
