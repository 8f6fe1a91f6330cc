"""The conversation trie against a plain one, and running sums over keys that span tasks."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from factgraph.llm import prefix_trie
from factgraph.llm import queries as registered
from factgraph.llm.running import running

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v, key=lambda x: (*x[:3], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(convs.get(c - c % 20, [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        words = len(re.findall("[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        saved[path] = sum(saved[k] for k in children[path]) + (len(members[path]) - 1) * words
        out.append((members[path][0], len(path), members[path[:-1]][0] if path else None, len(members[path]), len(children[path]), leaves[path], saved[path], hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query_against_plain_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(registered.op13_prefix_trie(spark, SF)) == plain(rows)


def test_odd_and_branching_conversations(spark):
    rng = np.random.default_rng(5)
    rows = [(None, 0, "user", "nobody's"), (40, None, "user", "no turn"), (40, 3, None, None), (40, 3, None, None), (41, 1, "user", "a\tb  c"), (80, 1, "", ""), (2**53 + 1, 2**60 + 1, "u", "x"), (2**53 + 1, 2**60, "u", "y")]
    for c in range(0, 39):  # few different turns, so that conversations branch in many places; some end early
        rows += [(c, t, ("user", "assistant")[t % 2], f"w{rng.integers(0, 2)} " * int(rng.integers(1, 3))) for t in range(int(rng.integers(0, 12)))]
    rows += [(c, 0, "user", "the same turn") for c in range(100, 160)]
    rows += [(200, t, "user", f"turn {t // 2}") for t in range(300)] + [(201, t, "user", f"turn {t // 2}") for t in range(250)]
    rows += [(300, 0, "user", "very long " * 30000)]
    extra = "depth long, conv int, words int, block int, p string, digest int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "5", 6) for r in rows], f"conv_id long, turn long, role string, text string, {extra}").repartition(3)
    want = plain(rows)
    assert result(prefix_trie.trie(df)) == want
    assert result(prefix_trie.trie(df, size=1)) == want
    assert prefix_trie.trie(df.limit(0)).count() == 0


def test_running_sums(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id") % 5 * 100).cast("long").alias("k"), F.col("id").alias("o"), (F.lit((1 << 62) + 1) + F.col("id")).alias("x"))
    got = running(df.repartition(5), "k", [F.asc("o")], {"before": "x"}, ["k", "o", "x"]).collect()
    assert len(got) == 3000
    total = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["k"], r["o"])):
        assert r["before"] == (total[r["k"]] + (1 << 63)) % (1 << 64) - (1 << 63)
        total[r["k"]] += r["x"]
