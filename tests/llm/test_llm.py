"""Corpus operators against brute force, exact round trips and held-out accuracy, with the odd cases of every contract."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import bpe, common, components, decontaminate, exact_dedup, language_model, near_dedup, quality, repeats, substring_dedup, suffix_dedup, textkit, token_files, url_filter
from factgraph.llm import queries as registered

SF = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string"
#: Null id, null and empty text, blank text, repeated rows, a very long text, and extra columns with clashing names.
ODD_SCHEMA = "doc_id long, text string, id string, key int, digest string, tag string, spans int, h int, w int, n int"


def odd(spark):
    base = [(1, "the cat sat on the mat and then it ran off"), (2, None), (3, ""), (4, " \n\t "), (5, "Ünïcödé words 漢字 here 🙂 ok then"), (5, "Ünïcödé words 漢字 here 🙂 ok then"), (None, "no id at all here in this row"), (7, "tick tock " * 9000), (8, "THE cat sat on the mat and then it ran off"), (None, None)]
    return spark.createDataFrame([(i, t, "x", 1, "d", "t", 0, 0, 0, 0) for i, t in base], ODD_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- shared parts


def test_word_hashes_depend_on_content_only():
    a = textkit.words([b"", b"b aa  b", b" aa"])
    b = textkit.words([b"aa b"])
    assert len(a[0]) == 4 and list(a[3]) == [0, 0, 3, 4]
    assert a[0][1] == a[0][3] == b[0][0] and a[0][0] == a[0][2] == b[0][1] and a[0][0] != a[0][1]


def test_span_hashes_do_not_depend_on_place():
    x = textkit.mix(np.array([5, 1, 2, 3, 9, 1, 2, 3], dtype=np.uint64))
    h = textkit.Spans(x).at(np.array([1, 5, 2]), np.array([4, 8, 5]))
    assert h[0] == h[1] != h[2]
    assert textkit.Spans(x[1:4]).at(np.array([0]), np.array([3]))[0] == h[0]


def test_whole_groups():
    import pandas as pd

    x = pd.DataFrame({"k": [1, 1, 2, 2, 2, 3, 4, 4]})
    got = list(common.whole_groups([x[:3], x[3:6], x[6:]], ["k"], 2))
    assert pd.concat(got)["k"].tolist() == x["k"].tolist()
    assert sum(len(set(g["k"])) for g in got) == 4


def test_components(spark):
    rng = np.random.default_rng(0)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3), (500, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = registered.op1_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    test = got[got["held_out"]]
    good, bad = test[test.quality == 1].score.to_numpy(), test[test.quality == 0].score.to_numpy()
    assert ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.9
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    want = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]}
    assert dict(zip(got["doc_id"], got["held_out"])) == want


def test_isotonic():
    knots, values = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert values.tolist() == [0, 0.5, 1] and knots.tolist() == [1, 2.5, 4]


def test_quality_fit_against_plain_sums(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs(spark), labels)
    drawn = lambda k, n: F.pmod(F.xxhash64("doc_id", F.lit(7 + k)), F.lit(n))
    rows = docs(spark).join(labels, "doc_id").where(drawn(0, 1_000_000) / 1e6 < 1.0).select("text", "quality", (drawn(1, 1000) < 250).alias("c")).collect()
    x, y, c = quality.statistics([(r["text"] or "").encode() for r in rows]), np.array([float(r["quality"]) for r in rows]), np.array([r["c"] for r in rows])
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -5, 5)
    z = np.column_stack([np.ones(len(z)), z, np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.wave + model.phase)])
    p, fit = z.shape[1], ~c
    # ridge as least squares with rows for the penalty
    penalty = np.sqrt(quality.RIDGE * fit.sum() / 100 + 1e-9) * np.eye(p)
    penalty[0, 0] = math.sqrt(1e-9)
    weight = np.linalg.lstsq(np.vstack([z[fit], penalty]), np.concatenate([y[fit], np.zeros(p)]), rcond=None)[0]
    assert np.allclose(z @ model.weight, z @ weight, atol=1e-6)
    # isotonic regression by its formula: the largest over starts of the smallest mean over ends
    order = np.argsort(z[c] @ weight, kind="stable")
    v = y[c][order]
    sums = np.concatenate(([0], np.cumsum(v)))
    mean = lambda a, b: (sums[b + 1] - sums[a]) / (b + 1 - a)
    want = [max(min(mean(a, b) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    assert np.allclose(sorted(set(np.round(want, 9))), np.unique(np.round(model.values, 9)))


def test_quality_odd_cases(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (8, None), (7, 0)], "doc_id long, quality int")
    model = quality.fit(odd(spark), labels)
    assert quality.score(odd(spark), model).count() == 10
    assert quality.score(empty(spark), model).count() == 0
    none = quality.fit(odd(spark), labels.limit(0))
    assert {r["score"] for r in quality.score(odd(spark), none).collect()} == {0.5}
    assert quality.accepted(odd(spark), none, 0.4).columns == odd(spark).columns


# ---------------------------------------------------------------- 2


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        sets.append(Counter(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))) if w else Counter())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((sets[i] & sets[j]).values())
            total = sum(sets[i].values()) + sum(sets[j].values()) - shared
            if (rows[i][1] or "") == (rows[j][1] or "") or total and shared / total >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def near_cases():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    out = []
    for g in range(12):
        base = list(rng.choice(words, 120))
        for c in range(int(rng.integers(1, 9))):
            t = list(base)
            for _ in range(int(rng.integers(0, 5))):
                t[int(rng.integers(len(t)))] = "edit"
            out.append(" ".join(t))
    return out + ["one two", "one two", "three", "", None, "a b c d e", "a b c d f"]


def test_near_duplicates(spark):
    rows = list(enumerate(near_cases()))
    root = brute_classes(rows)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, TEXT)).collect()}
    assert {i: got[i]["class_id"] for i, _ in rows} == {i: min(j for j in range(len(rows)) if root[j] == root[i]) for i, _ in rows}
    assert all(got[i]["kept"] == (got[i]["class_id"] == i) for i, _ in rows)


def test_near_pairs_in_mixed_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16, raising=False)
    monkeypatch.setattr(near_dedup, "PASSING", 50, raising=False)
    template, own = [f"t{i}" for i in range(150)], lambda i: [f"o{i}x{k}" for k in range(20)]
    texts = [own(i) for i in range(160)]
    for i in range(0, 40, 2):
        texts[i + 1][:2] = texts[i][:2]  # a similarity of 0.804 with this text, 0.785 with the rest
    rows = [(i, " ".join(template + t)) for i, t in enumerate(texts)]
    root = brute_classes(rows)
    assert len(set(root)) == 140
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == dict(enumerate(root))


def test_dart_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    a, b = Counter(rng.integers(0, 300, 400).tolist()), Counter(rng.integers(0, 300, 400).tolist())
    for x in range(120):
        a[1000 + x] += 3
        b[1000 + x] += 2
    k = 2000
    h = [textkit.mix(np.array(list(c.elements()), dtype=np.uint64)) for c in (a, b)]
    sig, _ = near_dedup.signatures(np.concatenate(h), np.repeat([0, 1], [len(x) for x in h]), 2, k)
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / k)


def test_near_odd_cases(spark):
    got = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(got) == 10
    by = {(r["doc_id"], r["class_id"]) for r in got}
    assert (8, 1) in by and (5, 5) in by and (2, 2) in by and (3, 2) in by and (None, 2) in by
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


# ---------------------------------------------------------------- 3


def test_exact_dedup_with_clashing_digests(spark):
    rows = [(1, "Aa"), (2, "aA"), (3, "ab"), (4, None), (5, ""), (6, "É"), (7, "é"), (7, "é"), (None, "ab"), (None, "zz")]
    df = spark.createDataFrame(rows, TEXT)
    for digest in (lambda c: F.sha2(c, 256), lambda c: F.length(c).cast("string")):
        got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df, digest=digest).collect()}
        assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True), (7, 7, 2, True), (None, 3, 2, False), (None, None, 1, True)}


def test_exact_dedup_keeps_state(spark):
    state = common.new_dir(spark, "test-state")
    first = exact_dedup.exact_dedup(spark.createDataFrame([(9, "a"), (1, "b")], TEXT), state_dir=state)
    assert {(r["doc_id"], r["kept"]) for r in first.collect()} == {(9, True), (1, True)}
    second = exact_dedup.exact_dedup(spark.createDataFrame([(2, "A"), (3, "c")], TEXT), state_dir=state)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in second.collect()} == {(2, 9, 2), (3, 3, 1)}


def test_a_digest_that_clashes_with_an_earlier_call(spark):
    state, length = common.new_dir(spark, "test-state"), lambda c: F.length(c).cast("string")
    exact_dedup.exact_dedup(spark.createDataFrame([(9, "aa"), (1, "b")], TEXT), state_dir=state, digest=length)
    second = exact_dedup.exact_dedup(spark.createDataFrame([(2, "bb"), (3, "AA")], TEXT), state_dir=state, digest=length)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in second.collect()} == {(2, 2, 1), (3, 9, 2)}


@pytest.mark.parametrize("broken", ["before the stream", "inside a batch"])
def test_a_call_that_failed_counts_once(spark, monkeypatch, broken):
    from pyspark.sql import DataFrameWriter
    from pyspark.sql.streaming import DataStreamWriter

    state = common.new_dir(spark, "test-state")
    first, second = spark.createDataFrame([(9, "a"), (1, "b"), (1, "b")], TEXT), spark.createDataFrame([(2, "A"), (3, "c")], TEXT)
    exact_dedup.exact_dedup(first, state_dir=state)

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if broken == "before the stream":
            m.setattr(DataStreamWriter, "start", fail)
        else:
            whole = DataFrameWriter.parquet
            m.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: fail() if "/groups/batch=" in path else whole(self, path, *a, **b))
        with pytest.raises(Exception, match="lost"):
            exact_dedup.exact_dedup(second, state_dir=state)
    other = exact_dedup.exact_dedup(spark.createDataFrame([(4, "b")], TEXT), state_dir=state)
    assert [(r["keep_id"], r["group_size"]) for r in other.collect()] == [(4, 3)]
    again = exact_dedup.exact_dedup(second, state_dir=state)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in again.collect()} == {(2, 9, 2), (3, 3, 1)}
    named = exact_dedup.exact_dedup(second, state_dir=state, call="once more")
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in named.collect()} == {(2, 9, 3), (3, 3, 2)}


def test_bytes_of_earlier_texts_are_read_at_their_locators(spark, monkeypatch):
    """Two texts with the same digests in different calls are told apart by the earlier text's bytes."""
    monkeypatch.setattr(exact_dedup, "_other", lambda norm: F.lit("same"))
    state, length = common.new_dir(spark, "test-state"), lambda c: F.length(c).cast("string")
    calls = [common.staged(spark.createDataFrame(rows, TEXT), "calls") for rows in ([(9, "aa"), (5, "Aa"), (1, "b")], [(20, "bb"), (3, "AA"), (21, "bb"), (2, "B")])]
    exact_dedup.exact_dedup(calls[0], state_dir=state, digest=length)
    got = exact_dedup.exact_dedup(calls[1], state_dir=state, digest=length)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()} == {(20, 21, 2, False), (21, 21, 2, True), (3, 9, 3, False), (2, 2, 2, True)}


def test_exact_odd_cases(spark):
    assert exact_dedup.exact_dedup(odd(spark)).count() == 10
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# ---------------------------------------------------------------- 4 and 7


def brute_words(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def brute_bytes(rows, window):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[s : s + window] for s in range(len(b) - window + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def repeat_cases():
    rng = np.random.default_rng(11)
    word = lambda n, k: [f"v{x}" for x in rng.integers(0, k, n)]
    shared = [word(int(n), 40) for n in (6, 8, 9, 30, 80)]
    out = []
    for i in range(40):
        t = word(int(rng.integers(0, 60)), 5 if i % 3 else 60)
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(len(t) + 1))
            t[at:at] = shared[int(rng.integers(len(shared)))]
        out.append(" ".join(t))
    return out + ["a " * 200, "a " * 150 + "b", "ab " * 90, "ab " * 100, "", None, out[5], out[5]]


@pytest.mark.parametrize("hot", [1, 4, 4000])
def test_repeated_words(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(3 * i % 97, t) for i, t in enumerate(repeat_cases())]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, TEXT), window=8).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_words(rows, 8)


@pytest.mark.parametrize("hot", [1, 4000])
def test_repeated_bytes(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = list(enumerate(repeat_cases()))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, TEXT), window=40).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute_bytes(rows, 40)


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_repeats_odd_cases(spark, module):
    got = {(r["doc_id"], r["n_removed"]) for r in module.remove_repeats(odd(spark), window=5).collect()}
    assert len(module.remove_repeats(odd(spark), window=5).collect()) == 10
    assert (2, 0) in got and (3, 0) in got
    if module is substring_dedup:
        assert {x for x in got if x[0] in (None, 1, 5, 8)} == {(None, 0), (1, 0), (5, 0), (8, 10)}
    assert module.remove_repeats(empty(spark), window=5).count() == 0


def test_rows_that_repeat_cost_what_one_costs(spark):
    text = " ".join(f"w{i % 37} x{i % 11}" for i in range(500))
    df = spark.createDataFrame([(1, text)] * 400 + [(None, text)] * 400 + [(2, text[:900]), (3, "short"), (3, "short")], TEXT)
    got = Counter((r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == {(1, 0): 400, (None, 0): 400, (2, 0): 1, (3, 5): 2}
    n = len(text.split())
    got = Counter((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == {(1, 0): 400, (None, 0): 400, (2, len(text[:900].split()) - 1 + text[:900].endswith(" ")): 1, (3, 0): 2} and n == 1000


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_long_texts_are_looked_at_in_segments(spark, module, monkeypatch):
    monkeypatch.setattr(repeats, "LONG", 64)
    rows = [(i, t) for i, t in enumerate(repeat_cases())]
    brute, window = (brute_words, 8) if module is substring_dedup else (brute_bytes, 40)
    got = module.remove_repeats(spark.createDataFrame(rows, TEXT), window=window).collect()
    assert {r["doc_id"]: tuple(bytes(x) if isinstance(x, bytearray) else x for x in tuple(r)[1:-1]) for r in got} == brute(rows, window)


# ---------------------------------------------------------------- 5


def test_url_rules_and_aliases(spark):
    html = lambda url: f'<html><head><link href="{url}" rel="canonical"></head></html>'
    pages = [
        (1, "http://A.net/x?y", None), (2, "https://b.example.net/en/1", None), (3, "no scheme", None), (4, None, ""), (5, "http://good.org/p", html("https://bad.example.com/de/1#f")),
        (6, "http://alias.org/q", None), (7, "http://x.example.net/en/2", html("http://spam.net/z")), (8, "http://y.org/r", html("http://x.example.net/en/2")), (9, "http://net", None), (9, "http://net", None), (10, "http://examplenet/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://alias.org/q", "http://good.org/p"), (None, "http://z/"), ("http://lone.org/", "http://lone.org/2")], "source string, target string")
    rules = url_filter.rules_of(spark, block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules, moved).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[9] == ("net", "", None, "allow") and got[10][3] == "allow"
    assert got[5][2:] == (None, "block") and got[6][2:] == (None, "block")  # aliases of a blocked url, over two steps
    assert got[7][3] == "allow" and got[8][2:] == (None, "allow")  # an allowed url speaks for its group
    assert url_filter.judge(df.limit(0), rules, moved).count() == 0 and url_filter.judge(df, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_url_groups_against_union_find(spark):
    rng = np.random.default_rng(21)
    hosts = ["a.net", "b.org", "example.com", "sub.example.com", "example.net", "x.info"]
    url = lambda i: f"http://{hosts[i % 6]}/{['en', 'de', 'fr', 'p'][i // 6 % 4]}/{i}"
    n = 400
    chain = [(i, i + 1) for i in range(120)] + [(121, 300 + k) for k in range(60)]  # a long chain and a hub
    moved = chain + [(int(a), int(b)) for a, b in rng.integers(121, n, (80, 2))]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in moved:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

    def own(i):
        host, path = url(i).split("//")[1].split("/", 1)
        fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and ("/" + path).startswith("/" + r.split("/", 1)[1])]
        return rules[max(fit, key=len)] if fit else None

    groups = {}
    for i in range(n):
        groups.setdefault(find(i), set()).add(own(i))
    want = {i: own(i) or ("allow" if "allow" in groups[find(i)] else "block" if "block" in groups[find(i)] else "allow") for i in range(n)}
    half = len(moved) // 2  # half of the links are redirects, half canonical links of the pages
    html = {}
    for a, b in moved[half:]:
        html.setdefault(a, []).append(f'<link rel="canonical" href="{url(b)}">')
    pages = spark.createDataFrame([(i, url(i), "".join(html.get(i, []))) for i in range(n)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(url(a), url(b)) for a, b in moved[:half]], "source string, target string")
    table = url_filter.rules_of(spark, [r for r in rules if rules[r] == "block"], [r for r in rules if rules[r] == "allow"])
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, table, redirects).collect()} == want
    assert len(set(want.values())) == 2 and sum(own(i) is None and want[i] == "block" for i in range(n)) > 10


def test_url_links_of_every_form(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b/c?x=1#f", "https://h.org/", "http://h.org/d/"]
    targets = ["/en/page", "//other.net/p", "/new?a=1&b=2", "x/y", "../up", "../../../up", "./", "..", "?q=2", "http://z.net/w", "go?u=http://z.net/"]
    form = {"link": '<link data-href="no" href="{}" rel=\'shortlink canonical\'>', "meta": '<meta http-equiv="refresh" content="0; url={}">'}
    cases = [(b, t, f) for b in bases for t in targets for f in form]
    pages = [(b, form[f].format(t.replace("&", "&amp;"))) for b, t, f in cases] + [("http://h.org/q", '<base target="x"><base href="/in/"><link rel=canonical href=p>'), ("http://h.org/q", '<link rel="canonical" href="mailto:a">')]
    got = sorted(tuple(r) for r in url_filter.links_of(spark.createDataFrame(pages, "url string, html string")).collect())
    assert got == sorted([(b, urljoin(b, t)) for b, t, _ in cases] + [("http://h.org/q", "http://h.org/in/p")])


# ---------------------------------------------------------------- 6 and 10


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registered.vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


TRICKY = ["", "a", "Hello  world\n\n\tit's 2024!", "<|endoftext|> in <|startoftext|>text", "x" * 3000, "漢字かな交じり文 🙂🙃 ‍👩‍👩‍👧", "İSTANBUL ΣΑΣ ﬁ é ́x", "a b c\u0085d\x1ce\x1ff\x0bg", "  lead", "tail   ", "don't we'll I'M", "1234567 ٣٤٥", "​﻿", "aaaaaaaa" * 40 + " " + "ab" * 200]


def test_token_files_round_trip(spark):
    texts = TRICKY + [t for _, t in pairs(docs(spark))[:60]]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)] + [(5000, None)]
    path = common.new_dir(spark, "test-tokens")
    token_files.write(spark.createDataFrame(rows, TEXT), path, registered.vocabulary("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["ids_crc32"]) for r in token_files.read(spark, path).collect()}
    tool, start = library("word_bpe_49k.json"), 0
    for i, t in sorted(rows):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes())), (i, t)
        start += len(ids)


def test_token_codes():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.int64), np.array([7]), rng.integers(0, 70_000, 200_001), np.arange(70_000)):
        assert (token_files.unpack(*token_files.pack(ids), len(ids)) == ids).all()


def test_texts_without_spaces_are_not_remembered(spark):
    encoder = token_files.Encoder(registered.vocabulary("word_bpe_49k.json"))
    import pyarrow as pa

    texts = ["漢字かな" * 40_000, "abcdefgh" * 30_000, "A" * 100 + ", " + "b" * 65, None]
    ids, n = encoder.ids(pa.array(texts), 2)
    want = [encoder.library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [x for e in want for x in e] and n.tolist() == [len(e) for e in want]
    assert sum(map(len, encoder.known)) < 1000


def test_files_of_another_kind_are_encoded_whole(spark):
    import pyarrow as pa

    assert token_files.Encoder(registered.vocabulary("word_bpe_49k.json")).in_pieces
    encoder = token_files.Encoder(registered.vocabulary("byte_bpe_50k.json"))
    assert not encoder.in_pieces
    texts = ["Two  spaces, here\n\nand THERE", "", None, "x"]
    ids, n = encoder.ids(pa.array(texts), 7)
    assert ids.tolist() == [x for t in texts for x in [*encoder.library.encode(t or "", add_special_tokens=False).ids, 7]]


def test_token_odd_cases(spark):
    for df, n in ((odd(spark), 10), (empty(spark), 0)):
        path = common.new_dir(spark, "test-tokens")
        token_files.write(df, path, registered.vocabulary("word_bpe_49k.json"))
        got = token_files.read(spark, path, with_ids=False).collect()
        assert len(got) == n and sum(r["doc_id"] is None for r in got) == (2 if n else 0)
        ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_bpe_matches_the_library(spark):
    tool, own = library("byte_bpe_50k.json"), bpe.load(registered.vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    noise = ["".join(chr(c) for c in rng.choice([32, 10, 39, 97, 115, 49, 33, 0xE9, 0x4E00, 0x301, 0x85, 0xA0, 0x200B, 0x1F600], 40)) for _ in range(200)]
    for t in TRICKY + noise:
        ids = tool.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, repr(t)
        assert own.decode(own.encode(t)) == tool.decode(ids, skip_special_tokens=False)
    assert own._merge_long([own.byte_id[b] for b in b"then another thing" * 3]) == own.merge(b"then another thing" * 3)


def test_bpe_table(spark):
    path = registered.vocabulary("byte_bpe_50k.json")
    back = {r["id"]: r["text"] for r in bpe.decode(bpe.encode(odd(spark), path), path).where("id is not null").collect()}
    assert back == {i: t or "" for i, t in pairs(odd(spark)) if i is not None}
    assert bpe.digests(odd(spark), path).count() == bpe.round_trip(odd(spark), path).where("ids is not null").count() == 10
    assert bpe.digests(empty(spark), path).count() == 0


# ---------------------------------------------------------------- 8


def lm_rows():
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(80)]
    p = 1 / np.arange(1, 81)
    return [(i, " ".join(rng.choice(words, int(rng.integers(1, 80)), p=p / p.sum()))) for i in range(120)]


@pytest.mark.parametrize("head", [5, 1 << 15])
def test_language_model(spark, head, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", head)
    rows = lm_rows() + [(200, None), (201, "NEVER seen t1"), (None, "t1 t2"), (5, "t1"), (202, "t1"), (202, "t1")]
    df = spark.createDataFrame(rows, TEXT)
    got = language_model.score(df, df.where("doc_id < 100")).collect()
    assert len(got) == len(rows)
    tokens = {(i, t): [*(t or "").lower().split(), None] for i, t in rows}
    train = Counter(w for (i, t), ws in tokens.items() if i is not None and i < 100 for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted((i or -1, len(ws), sum(train[w] > 0 for w in ws), round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, t), ws in [((i, t), tokens[i, t]) for i, t in rows])
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and r["perplexity"] > 1 for r in got)
    assert language_model.score(df.limit(0), df).count() == 0 and language_model.score(df, df.limit(0)).count() == len(rows)


def test_tokens_travel_in_bundles():
    rng = np.random.default_rng(6)
    columns = [(rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(-(1 << 63), 1 << 63, n), rng.integers(-(1 << 63), 1 << 63, n), rng.integers(0, language_model.CHILDREN, n), rng.integers(1, 1 << 20, n)) for n in (7_000, 1, 3_000)]
    rows = language_model._bundled(columns, 16)
    assert len(rows) == 16 and rows["n"].sum() == 10_001
    got = language_model._unbundled(rows)
    assert sorted(zip(*(c.tolist() for c in got.values()))) == sorted(x for part in columns for x in zip(*(c.tolist() for c in part)))
    assert ((got["w"] & np.uint64(15)) == np.repeat(rows["bucket"].to_numpy(), rows["n"])).all()


def test_scores_are_the_same_by_any_bundles(spark, monkeypatch):
    rows = lm_rows() + [(200, None), (201, "NEVER seen t1"), (202, "t1"), (202, "t1")]
    df = spark.createDataFrame(rows, TEXT).repartition(3)
    asked = lambda: sorted((r["doc_id"], round(r["score"], 6), r["n_known"]) for r in language_model.score(df, df.where("doc_id < 100")).collect())
    by_broadcast = asked()
    monkeypatch.setattr(language_model, "HEAD", 2)
    for buckets, held, batch in ((32, 500_000, 300_000), (1, 10, 5), (3, 1, 40)):
        monkeypatch.setattr(language_model, "BUCKETS", buckets)
        monkeypatch.setattr(language_model, "HELD", held)
        monkeypatch.setattr(language_model, "ROWS", batch)
        assert asked() == by_broadcast


def test_shares_come_back_in_bundles(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * 31 + 7 * j) % 5003}" for j in range(30))) for i in range(400)]
    df = spark.createDataFrame(docs, TEXT).repartition(4)
    for name, value in (("HEAD", 2), ("BUCKETS", 1), ("ROWS", 1_000)):
        monkeypatch.setattr(language_model, name, value)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = language_model.score(df, df)
        got.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    made, plans = [], [got._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "MapInPandas":
            made.append(plan.metrics().apply("pythonNumRowsReceived").value())
    # a row for each text, and at most one for each task and bucket, of which there are 16
    assert made and max(made) <= len(docs) + 4 * 16


def test_large_ids_among_nulls(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 2)
    ids = [(1 << 60) + i for i in range(20)] + [None, None, (1 << 60) + 7]
    df = spark.createDataFrame([(i, f"a b c{i}") for i in ids], TEXT)
    got = [r["doc_id"] for r in language_model.score(df, df).collect()]
    assert sorted(got, key=lambda i: i or 0) == sorted(ids, key=lambda i: i or 0)


def test_predictive_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(lm_rows(), TEXT)
    words, model = language_model.train(df.select("text"))
    x = language_model._words(words.toPandas().sort_values("w").reset_index(drop=True), model)
    k = len(x.names)
    for child in (3, 77, language_model.CHILDREN - 1):
        y = language_model._words(words.toPandas().sort_values("w").reset_index(drop=True), model)
        p = y.predictive(np.append(np.arange(k), -1), np.full(k + 1, child))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def stirling(n, d):
    """The ways to sit at t tables, with the tables' discounts: S(n, t) for t from 0 to n."""
    row = np.array([1.0])
    for k in range(n):
        row = np.concatenate((row, [0.0])) * np.maximum(k - d * np.arange(len(row) + 1), 0) + np.concatenate(([0.0], row))
    return row


@pytest.mark.parametrize(("others", "p", "gain"), [(0.7, 0.5, 0.0), (3.0, 0.02, 0.01), (40.0, 0.3, 0.2)])
def test_redrawn_tables_have_their_exact_distribution(others, p, gain):
    n, d, copies = 7, 0.4, 40_000
    full = lambda x: np.full(copies, float(x))
    t = language_model.redraw(full(n), d, full(others), full(p), full(gain), textkit.mix(np.arange(copies, dtype=np.uint64)), 5)
    number = stirling(n, d)
    weight = np.array([number[k] * math.prod((others + d * j) * (p + gain * j) for j in range(1, k)) for k in range(1, n + 1)])
    assert np.abs(np.bincount(t.astype(int), minlength=n + 1)[1:] / copies - weight / weight.sum()).max() < 0.01


def test_three_levels_against_enumeration():
    """One dish in two restaurants of one parent: the sampler's mean numbers of tables are those over all seatings at three levels."""
    n, d, s, copies = (4, 6), (0.5, 0.4, 0.6), (1.2, 0.8, 1.5), 4000
    size = language_model.CHILDREN
    c = {"n2": np.full(size, 5000.0), "t2": np.full(size, 2000.0), "n1": np.full(language_model.PARENTS, 3000.0), "t1": np.full(language_model.PARENTS, 1200.0), "n0": 2500.0, "t0": 1000.0}
    model = {"counts": [c, c], "strength": s, "discount": d, "first_discount": d, "base": 0.05}
    weights = {}
    for a in range(1, n[0] + 1):
        for b in range(1, n[1] + 1):
            for m in range(1, a + b + 1):
                for t in range(1, m + 1):
                    rise = lambda level, total, own, k: math.prod(s[level] + d[level] * (total - own + j) for j in range(k))
                    w = stirling(n[0], d[2])[a] * stirling(n[1], d[2])[b] * rise(2, 2000, a, a) * rise(2, 2000, b, b)
                    w *= stirling(a + b, d[1])[m] * rise(1, 1200, m, m) / (s[1] + 3000) ** (a + b)
                    weights[a, b, m, t] = w * stirling(m, d[0])[t] * rise(0, 1000, t, t) * 0.05**t / (s[0] + 2500) ** m
    total = sum(weights.values())
    want = [sum(w * k[i] for k, w in weights.items()) / total for i in range(4)]
    x = language_model.Words(np.repeat(np.arange(copies), 2), np.tile([3, 5], copies), np.tile(n, copies), textkit.mix(np.arange(copies, dtype=np.uint64)), model)
    got = np.zeros(4)
    for k in range(40):
        x.sweep(k)
        got += np.array([x.t2[::2].mean(), x.t2[1::2].mean(), x.t1.mean(), x.t0.mean()]) * (k >= 10) / 30
    print(want, got)
    assert np.abs(got - want).max() < 0.25


@pytest.mark.parametrize(("others", "gain"), [(4.0, 0.01), (60.0, 0.02), (400.0, 0.0)])
def test_many_customers_sit_as_one_after_another(others, gain):
    # expected tables by the recurrence over the exact distribution
    d, n, copies = 0.3, 400, 4000
    k = np.arange(n + 1)
    a = (others + d * k) * (0.3 + gain * k)
    p = np.zeros(n + 1)
    p[1] = 1.0
    for i in range(1, n):
        opens = np.where(p > 0, a / np.maximum(a + i - d * k, 1e-9), 0.0)
        p = p * (1 - opens) + np.concatenate(([0], (p * opens)[:-1]))
    full = lambda x: np.full(copies, float(x))
    got = language_model.seat(full(n), d, full(others), full(0.3), full(gain), textkit.mix(np.arange(copies, dtype=np.uint64)), 5)
    mean = (p * k).sum()
    spread = math.sqrt((p * k**2).sum() - mean**2)
    assert abs(got.mean() - mean) < 0.02 * mean + 5 * spread / math.sqrt(copies) and abs(got.std() - spread) < 0.15 * spread


def test_sweeps_keep_customers_and_tables_in_step(spark):
    words, model = language_model.train(spark.createDataFrame(lm_rows(), TEXT).select("text"))
    x = language_model._words(words.toPandas().sort_values("w").reset_index(drop=True), model)
    seen = set()
    for k in x.samples():
        assert (np.bincount(x.pair, weights=x.t2, minlength=len(x.pair_key)) == x.n1).all()
        assert (np.bincount(x.pair_of, weights=x.t1, minlength=len(x.names)) == x.n0).all()
        assert (x.t2 <= x.n).all() and (x.t1 <= x.n1).all() and (x.t0 <= x.n0).all() and (x.t0 >= 1).all() and (x.t2 >= 1).all() and (x.t1 >= 1).all()
        assert np.allclose(x.numbers(), np.concatenate((model["counts"][2 + k]["t2"], model["counts"][2 + k]["t1"], [model["counts"][2 + k]["t0"]])))
        seen.add(x.t2.sum())
    assert len(seen) > 1


def test_language_model_on_odd_rows(spark):
    got = language_model.score(odd(spark), odd(spark).where("doc_id < 6")).collect()
    assert len(got) == 10 and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    by = {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"]}
    assert by[2] == by[3] == by[4] == 1 and by[7] == 18_001
    assert language_model.score(empty(spark), odd(spark)).count() == 0


def test_language_model_beats_single_tokens(spark):
    got = registered.op8_language_model(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# ---------------------------------------------------------------- 9


def test_containment(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"z{x}" for x in rng.integers(0, 3000, n)]
    items = [(i, " ".join(word(int(n)))) for i, n in enumerate([5, 6, 12, 30, 60, 3])] + [(50, None), (51, "")]
    rows = []
    for i in range(60):
        t = word(int(rng.choice([0, 20, 300, 4000])))
        own = items[int(rng.integers(6))][1].split()
        cut = own[: max(1, int(len(own) * rng.choice([1, 0.95, 0.85, 0.5])))]
        at = int(rng.integers(len(t) + 1))
        t[at:at] = [w.upper() for w in cut] if i % 5 else []
        rows.append((i, " ".join(t)))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()

    want = {(d, i, len(shingles(t) & shingles(q))) for d, t in rows for i, q in items if shingles(q) and len(shingles(t) & shingles(q)) >= 0.8 * len(shingles(q))}
    got = decontaminate.contaminated(spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_shared"]) for r in got.collect()} == want and len(want) > 10


def test_short_items_in_a_long_text(spark):
    words = [f"v{i}" for i in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words))], TEXT)
    items = spark.createDataFrame([(i, " ".join(words[i : i + 5])) for i in range(2996)], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 2996


def test_no_item_is_lost(spark):
    rng = np.random.default_rng(12)
    rows, items, want = [], [], set()
    for i in range(1500):
        n = int(rng.integers(5, 40))
        own = [f"q{x}" for x in rng.integers(0, 10**6, n)]
        size = max(n - 4, 1)
        broken = list(own)
        if size >= 5:  # one word short at an end: a shingle less of five or more
            broken[-1] = "other"
        text = [f"p{x}" for x in rng.integers(0, 10**6, int(rng.integers(0, 300)))]
        at = int(rng.integers(len(text) + 1))
        rows.append((i, " ".join(text[:at] + broken + text[at:])))
        items.append((i, " ".join(own)))
        want.add((i, i, size - (size >= 5)))
    got = decontaminate.contaminated(spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_shared"]) for r in got.collect()} == want


def test_decontamination_odd_cases(spark):
    items = spark.createDataFrame([(1, "cat sat on the mat and"), (2, None), (None, "no id at all here in this row")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd(spark), items).collect()}
    assert got == {(1, 1), (8, 1), (None, None)}
    assert decontaminate.contaminated(empty(spark), items).count() == decontaminate.contaminated(odd(spark), items.limit(0)).count() == 0
    assert decontaminate.clean(odd(spark), items).columns == odd(spark).columns
    assert {r["doc_id"] for r in decontaminate.clean(odd(spark), items).collect()} == {2, 3, 4, 5, 7}


def test_many_items_in_one_text(spark):
    """Every item of a text is found, rows that repeat an id or have none keep their own counts, and a text is cut into shingles once for all items."""
    rng = np.random.default_rng(8)
    w = [f"w{x}" for x in rng.integers(0, 10**6, 3000)]
    items = [(k, " ".join(w[5 * k : 5 * k + 12])) for k in range(400)]
    long, half = " ".join(w), " ".join(w[:1000])
    rows = [(1, long), (1, long), (2, half), (2, " ".join(w[1000:])), (None, half), (None, long), (3, "nothing of that kind in here")]
    d, i = spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontaminate.contaminated(d, i).collect()}
    shingled = lambda t: {" ".join(t.split()[a : a + 5]) for a in range(max(len(t.split()) - 4, 1))}
    want = {}
    for doc, text in rows:
        own = shingled(text)
        for k, t in items:
            if (n := len(own & shingled(t))) >= 0.8 * len(shingled(t)):
                want[doc, k] = max(n, want.get((doc, k), 0))
    assert got == want and len(got) > 1000


def test_decontamination_runs_no_python(spark):
    plan = decontaminate.contaminated(docs(spark), spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- queries and pipeline


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registered.ORACLE.items():
        df = registered.QUERIES[name](spark, SF)
        rel = con.sql(sql)
        cols = sorted(df.columns)
        assert sorted(rel.columns) == cols
        at = [list(rel.columns).index(c) for c in cols]
        assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in rel.fetchall()), name


def test_pipeline(spark):
    import corpus_pipeline as p

    rows = dict(pairs(docs(spark)))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs(spark), labels.where(~quality.held_out(F.col("doc_id"), 4, 2)))
    rows = {i: t for i, t in rows.items() if model.score([(t or "").encode()])[0] >= 0.7}
    last = {}
    lower = {c: c + 32 for c in range(65, 91)}
    for i, t in sorted(rows.items()):
        last[(t or "").translate(lower)] = i
    rows = {i: rows[i] for i in last.values()}
    ordered = sorted(rows.items())
    root = brute_classes(ordered)
    rows = {i: t for k, (i, t) in enumerate(ordered) if root[k] == k}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()

    items = [s for (_, t) in [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()] if (s := shingles(t))]
    rows = {i: t for i, t in rows.items() if not any(len(s & shingles(t)) >= 0.8 * len(s) for s in items)}
    tool = library("byte_bpe_50k.json")
    want = {i: (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows.items() for e in [tool.encode(t, add_special_tokens=False)]}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in p.run(spark, SF).collect()}
    assert got == want
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs(spark).limit(0), SF).columns == docs(spark).columns


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    clash = odd(spark).withColumns({"__id": F.lit(1), "__digest": F.lit("x"), "__hit": F.lit(1)})
    for name, want in (("exact_dedup", {3, 4, 5, None, 7, 8}), ("near_dedup", {1, 2, 4, 5, None, 7})):
        got = dict(p.STAGES)[name](spark, clash, SF)
        assert got.columns == clash.columns and {r["doc_id"] for r in got.collect()} == want, name
    assert dict(p.STAGES)["decontamination"](spark, clash, SF).columns == clash.columns
    assert dict(p.STAGES)["bpe"](spark, clash, SF).count() == 10
