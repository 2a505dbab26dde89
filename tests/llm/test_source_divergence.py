"""Source divergence against SQL and plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from checks import compare
from tests.llm import helpers as H
from tributary.llm import queries, source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    """The audit of (text, lang, source) rows."""
    counts, spread, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall(text.translate(H.LOWER))
        counts[lang, source].update(terms)
        spread[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in spread[lang].items() if n >= least]

        def shares(n):
            below = sum(n[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 2) // below for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            f = lambda p, q: (p - q) ** 2 // (p + q)
            pair = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(own[s][t], whole[t])) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def _rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_matches_sql(spark):
    con = compare.database(H.SF_DIR)
    found = queries.op13_source_divergence(spark, H.SF_DIR)
    assert _rows(found) == sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.SQL['op13_source_divergence']})").fetchall())


def test_odd_rows_and_clashing_columns(spark):
    want = brute([(r[1], r[2], r[3]) for r in H.odd_rows()], 2, 3)
    assert _rows(source_divergence.audit(H.odd(spark), least=2, top=3)) == want
    assert _rows(source_divergence.audit(H.wide(H.odd(spark)), least=2, top=3)) == want
    none = brute([(r[1], r[2], r[3]) for r in H.odd_rows()], 1000, 3)
    assert {r[2] for r in none} == {"pair"} and _rows(source_divergence.audit(H.odd(spark), least=1000, top=3)) == none


def test_empty_table(spark):
    assert source_divergence.audit(spark.createDataFrame([], H.DOCS)).collect() == []


@pytest.mark.parametrize("nodes, sent", [(200_000, 20_000), (7, 0)])
def test_many_sources_small_trees_and_joined_groups(spark, monkeypatch, nodes, sent):
    monkeypatch.setattr(source_divergence, "NODES", nodes)
    monkeypatch.setattr(source_divergence, "SENT", sent)
    rng = random.Random(13)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}É" for i in range(60)]
    rows = [
        (i, " ".join(rng.choice(words[: 5 + i % 55]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{rng.randint(0, 25)}", 1)
        for i in range(400)
    ]
    found = source_divergence.audit(spark.createDataFrame(rows, H.DOCS), least=4)
    assert _rows(found) == brute([(r[1], r[2], r[3]) for r in rows], 4, 10)


def test_shared_paths_are_shared():
    tree = source_divergence._Tree()
    for n, times in ((1, 5), (2, 1), (1, 2)):
        tree.insert([0, 1, 2], [3, 3, n], [(40, 10), (30, 9), (n * 10, 8)], times)
    assert len(tree.parent) == 4 and tree.times == [8, 8, 7, 1]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    change = lambda p, p0, q, q0: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    want = {(0, 1): 8 * change(40, 10, 30, 9)}
    for a, p, p0 in ((0, 40, 10), (1, 30, 9)):
        want[a, 2] = 7 * change(p, p0, 10, 8) + change(p, p0, 20, 8)
    assert {(int(a), int(b)): int(c) for a, b, c in zip(*tree.changes())} == want
    assert all(isinstance(x, np.ndarray) for x in source_divergence._Tree().changes())


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10, 37), (9_000_000_001, 9_000_000_011), (10**15, 10**15 + 3)]
    df = spark.createDataFrame(rows, "n bigint, below bigint").select("n", "below", source_divergence.share_of(F.col("n"), F.col("below")).alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (n + 2) // below for n, below in rows]
