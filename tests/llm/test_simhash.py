"""SimHash near-duplicates against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import xxhash

from factgraph.llm import queries as registered
from factgraph.llm import simhash

SF = "/root/testdata/sf0.001"


def mark(text):
    words = "".join(c.lower() if c < "\x80" else c for c in (text or "")).encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(len(words) - 3, 1))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(marks, ids):
    up = list(range(len(marks)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    u = np.array(marks, dtype=np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def want(rows):
    marks = [mark(t) for _, t in rows]
    return sorted(((d, f"{m:016x}", c) for (d, _), m, c in zip(rows, marks, components(marks, [d for d, _ in rows]))), key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(registered.op12_simhash(spark, SF)) == want(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "One two"), (4, "one TWO"), (None, "one two"), (None, "alone in its null id here"), (7, "tick tock " * 60000), (8, "Ünï cödé 漢字 🙂 no break here"), (9, None)]
    df = spark.createDataFrame([(d, t, "x", 1, "m", 0) for d, t in rows], "doc_id long, text string, key string, mark int, low string, root int")
    assert result(simhash.near_duplicates(df)) == want(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_of_dense_groups(spark):
    """Fingerprints a few bits apart, in short, long and very long intersections, give the components of brute force."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    marks = []
    for c in centres:
        for _ in range(40):
            m = int(c)
            for b in rng.choice(64, int(rng.integers(0, 9)), replace=False):
                m ^= 1 << int(b)
            marks.append(m)
    marks += [int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)]
    marks = sorted(set(marks))
    df = spark.createDataFrame([(int(np.uint64(m).view(np.int64)),) for m in marks], "mark long")
    expected = components(marks, list(range(len(marks))))
    at = {m: i for i, m in enumerate(int(np.uint64(m).view(np.int64)) for m in marks)}
    for long in (2048, 12, 2):
        up = list(range(len(marks)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        rows = simhash.links(df, long=long).collect()
        for r in rows:
            a, b = find(at[r["a"]]), find(at[r["b"]])
            up[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(marks))] == expected
        assert len(rows) < 7 * 15 * len(marks)


def test_any_four_positions_hold_a_pair():
    from itertools import combinations

    assert all(any(set(p) <= set(four) for p in simhash.PAIRS) for four in combinations(range(8), 4))
