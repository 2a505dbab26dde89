"""The prefix trie against SQL and plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from checks import compare
from tests.llm import helpers as H
from tributary.llm import prefix_trie, queries

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(paths):
    """The nodes of ``conv -> turns``."""
    members = defaultdict(list)
    for conv, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    done = {}

    def told(node):
        if node not in done:
            leaves, saved = (0 if below[node] else 1), (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
            for c in below[node]:
                leaves, saved = leaves + told(c)[0], saved + told(c)[1]
            done[node] = leaves, saved
        return done[node]

    out = []
    for node in sorted(members, key=len, reverse=True):
        ends = ",".join(str(c) for c in sorted(members[node]) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below[node]), *told(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    """``conv -> turns`` of (conv, turn, role, text) rows whose turns differ or whose texts are equal where they do not."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    return {c: own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + t[h:] for c, t in own.items()}


def _rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def _talks(seed, convs, longest, words):
    rng = random.Random(seed)
    return [
        (c, None if i == 0 and c % 7 == 0 else i, rng.choice(["user", "assistant", None]), rng.choice([*words, None]))
        for c in convs
        for i in range(rng.randint(1, longest))
    ]


def test_query_matches_sql(spark):
    con = compare.database(H.SF_DIR)
    found = queries.op12_prefix_trie(spark, H.SF_DIR)
    assert _rows(found) == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.SQL['op12_prefix_trie']})").fetchall(), key=repr)


@pytest.mark.parametrize("chunk, shard", [(512, 65_536), (5, 8), (6, 1)])
def test_levels_and_shards_do_not_change_nodes(spark, chunk, shard):
    rows = _talks(1, range(0, 120), 12, ["a", "é", "日本"]) + [(c, i, "user", "hot") for c in range(200, 240) for i in range(c % 11 + 1)]
    rows += [(500, i, "user", "long") for i in range(14)]
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, TURNS).repartition(5), chunk, shard)
    assert _rows(got) == brute(rebuilt(rows))


def test_conversations_of_the_table(spark):
    rows = [tuple(r) for r in H.corpus(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert _rows(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, TURNS), 2, 10)) == brute(rebuilt(rows))


def test_a_hot_beginning_and_a_hot_conversation_are_spread(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 3000, 5)] + [(c, 1, "user", f"own {c}") for c in range(0, 3000, 5)]
    rows += [(7, i, "user", f"turn {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, TURNS)
    assert _rows(prefix_trie.rebuilt_trie(df, 700, 100)) == brute(rebuilt(rows))
    places = prefix_trie.numbered(df.repartition(4))
    assert sorted(r["pos"] for r in places.where("conv = 7").collect()) == list(range(1, 2001))
    lengths = places.groupBy("conv").agg(F.max("pos").alias("n"))
    paths = prefix_trie.levels(places, lengths, 700)[0][1]
    sizes = [r["count"] for r in prefix_trie.sharded(paths, 100).groupBy("part").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 200


def test_odd_rows_and_clashing_columns(spark):
    long = H.prose(1, 5_000)
    rows = [
        (1, None, None, None), (1, None, None, None), (1, 3, "user", long), (2, 0, "", ""), (2, 0, "", ""), (None, 0, "user", "x"), (None, None, None, None),
        (-3, 0, "a\nb", "c"), (-4, 0, "a", "b\nc"), (0, 0, "user", "éÈ \U0001f600 \x00"), (9, 2**62, "user", None), (9, -(2**62), None, "y"),
    ]
    df = spark.createDataFrame(rows, TURNS)
    paths = {c: t for c, t in rebuilt([r for r in rows if r[0] is None or r[0] >= 0]).items()}
    for c, turn in ((-3, ("a\nb", "c")), (-4, ("a", "b\nc"))):  # c - c % 5 is 0 here: the remainder has the sign of c
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = [("user", "éÈ \U0001f600 \x00")][:h] + [turn][h:]
    assert _rows(prefix_trie.rebuilt_trie(df)) == brute(paths)
    wide = df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(["conv", "pos", "n", "size", "part", "path", "root", "at", "head", "h"])])
    assert _rows(prefix_trie.rebuilt_trie(wide)) == brute(paths)


def test_empty_table(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_blocks_of_ids_are_joined_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 2)
    ends = spark.createDataFrame([(p, c) for p in "ab" for c in range(-9, 40) if (p == "a") or c % 3 == 0], "path string, conv bigint").repartition(6)
    want = {p: ",".join(str(c) for c in range(-9, 40) if p == "a" or c % 3 == 0) for p in "ab"}
    assert {r["path"]: r["ends_sha256"] for r in prefix_trie.ends_digests(ends).collect()} == {p: hashlib.sha256(t.encode()).hexdigest() for p, t in want.items()}


def test_double_array_holds_its_paths_and_no_others():
    rng = random.Random(3)
    paths = sorted({tuple(rng.randint(1, 30) for _ in range(rng.randint(1, 6))) for _ in range(2000)})
    trie = prefix_trie.DoubleArray([list(p) for p in paths])
    slots = {p[:i]: s for p in paths for i, s in enumerate(trie.walk(list(p)), 1)}
    assert len(set(slots.values())) == len(slots) == len(trie.order) - 1
    assert all(trie.check[s] == (slots[p[:-1]] if len(p) > 1 else 1) for p, s in slots.items())
    for _ in range(2000):
        p = tuple(rng.randint(1, 30) for _ in range(rng.randint(1, 6)))
        if p not in slots:
            with pytest.raises((KeyError, IndexError)):
                trie.walk(list(p))
