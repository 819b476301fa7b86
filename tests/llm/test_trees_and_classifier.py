"""Merkle manifest, conversation trie and quality classifier against brute force, and the cases that every operator has to take."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placelens.llm import classifier, conversation_trie, merkle
from placelens.llm.batches import text_bytes

SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def leaf_of(row):
    return SHA("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climbed(nodes):
    """Root of a list of digests, and of each the siblings (left, right) on its way."""
    ways, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, members = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k in range(len(run)):
                for leaf in own[a + k]:
                    ways[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(SHA("".join(run)))
            members.append([x for k in range(len(run)) for x in own[a + k]])
        nodes, own = up, members
    return nodes[0], ways


def merkle_by_hand(docs):
    groups = defaultdict(list)
    for row in docs:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, upper = climbed([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        for (_, _, leaf, row), way in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            path = way + above
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            h = leaf_of((*row[:4], row[4].replace("\n", ""))) if tampered else leaf
            for a, b in path:
                h = SHA(a + h + b)
            out.append((row[0], leaf, trees[s][0], root, SHA("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def merkle_of(df):
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    broken = F.when(chosen, merkle.leaf(*[F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS]))
    found = merkle.manifest(df, {"broken": broken}).withColumn("folded", merkle.folded(F.coalesce("broken", "leaf"), F.col("path")))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    rows = found.select("doc_id", text("leaf"), text("subroot"), text("root"), F.sha2(merkle.siblings(F.col("path")), 256).alias("proof"), text("folded"), (F.col("folded") == F.col("root")).alias("ok"))
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1, 1, 1], [3, 10, 27, 28, 1], [90, 4]])
def test_merkle_equals_a_walk_by_hand(spark, sizes):
    r = random.Random(len(sizes))
    docs = []
    for g, n in enumerate(sizes):
        name = [None, "", "ü:1", "src", "-"][g]
        docs += [(r.choice([None, *range(40)]), name, r.choice([None, "en", ""]), r.choice([None, -3, 12]), r.choice([None, "", "a\nb", "né\n", "x" * 5000])) for _ in range(n)]
    docs += docs[:1]  # a repeated row is a leaf of its own
    assert merkle_of(spark.createDataFrame(docs, DOCS).repartition(3)) == merkle_by_hand(docs)


def test_merkle_of_other_tables(spark):
    assert merkle_of(spark.createDataFrame([], DOCS)) == []
    docs = [(i, "s", "en", 1, f"t\n{i}") for i in range(7)]
    clashing = spark.createDataFrame(docs, DOCS)
    for c in ("key", "place", "size", "digest", "at", "part", "level", "path", "top", "id", "parent", "run", "left", "up"):
        clashing = clashing.withColumn(c, F.lit("x"))
    assert merkle_of(clashing) == merkle_by_hand(docs)
    hot = [(i, "hot" if i % 3 else f"s{i}", None, None, "t") for i in range(200)]
    assert merkle_of(spark.createDataFrame(hot, DOCS).repartition(8)) == merkle_by_hand(hot)


def trie_by_hand(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - c % 20, [])[:h] + v[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole)))
    words = lambda node: len(node[-1][1].encode().split()) if node else 0
    out = []
    for node, m in members.items():
        below = [(x, n) for x, n in members.items() if x[: len(node)] == node]
        kids = [x for x, _ in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in members) for x, _ in below)
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        ends = ",".join(str(c) for c in sorted(c for c, n in m if n == len(node)))
        out.append((min(c for c, _ in m), len(node), parent, len(m), len(kids), leaves, sum((len(n) - 1) * words(x) for x, n in below), SHA(ends)))
    return sorted(out, key=str)


def trie_of(df):
    return sorted(map(tuple, conversation_trie.prefix_trie(conversation_trie.rebuilt(df)).collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block, fan", [(2, 2), (5, 3), (1 << 11, 64)])
def test_trie_equals_prefixes_by_hand(spark, monkeypatch, block, fan):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    r = random.Random(block)
    turns = []
    for c in range(90):
        c = c * (1 if c % 3 else 7) + (5 if c % 2 else 0)
        turns += [(c, t, r.choice(["user", "user", None]), r.choice(["a b", "c", "", None, "a b"])) for t in range(r.choice([0, 1, 1, 2, 3, 6]))]
    turns += [(1000 + c, t, "user", "same") for c in range(40, 60) for t in range(5)]  # copies
    turns += [(2000 + c, t, "user", "deep") for c in range(20) for t in range(c + 1)]  # each a prefix of the next
    turns += [(None, 0, "user", "nobody"), (3001, None, "user", "x y"), (3001, 0, None, None), turns[-1]]
    assert trie_of(spark.createDataFrame(turns, TURNS).repartition(3)) == trie_by_hand(turns)


def test_trie_of_other_tables(spark):
    assert trie_of(spark.createDataFrame([], TURNS)) == []
    turns = [(4, 0, "user", "only its first turn, which is its group's")]  # crc32 of 4 leaves it without turns
    assert trie_of(spark.createDataFrame(turns, TURNS)) == trie_by_hand(turns)
    turns = [(c, t, "user", "hi") for c in range(20, 23) for t in range(1500)]
    clashing = spark.createDataFrame(turns, TURNS).withColumns({c: F.lit("x") for c in ("turns", "keys", "words", "last", "pos", "lcp", "n", "left", "block")})
    got = trie_of(clashing)
    assert len(got) == 1501 and max(x[1] for x in got) == 1500 and {x[3] for x in got} == {3}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.integers(1, 7))
def test_nearest_smaller_values_in_blocks(values, block):
    values = [-1, *values]
    row = lambda i, v: (v, i, i, 1, 0, *conversation_trie._NONE, i, 1, 0, 0)
    rows, nodes, size = [row(i, v) for i, v in enumerate(values)], [], block
    while True:
        end = len(values) if size >= len(values) else None
        groups, still = defaultdict(list), []
        for x in rows:
            groups[x[1] // size].append(x)
        for x in groups.values():
            new, left = conversation_trie.nearest_smaller(x, end)
            nodes += new
            still += left
        if end is not None:
            break
        rows, size = sorted(still, key=lambda x: x[1]), size * 2
    want = set()
    for i, v in enumerate(values[1:], 1):
        left = max(j for j in range(i) if values[j] < v)
        right = min((j for j in range(i, len(values)) if values[j] < v), default=len(values))
        want.add((left, v, right, sum(values[j] == v for j in range(left + 1, right)), left, right - left))
    assert {(x[0], x[2], x[3], x[4], x[5], x[6]) for x in nodes} == want and len(nodes) == len(want)


def test_measures_equal_plain_counts():
    import pyarrow as pa

    texts = ["", None, " \n ", "The cat. The cat. The cat sat!", "AB cd\nAB cd\n\nx 12 é", "a#b $$ % é\t" * 30, "one\ntwo words\nthree more words here\none"]
    got = classifier.measures(*text_bytes(pa.array(texts)))
    name = {c: i for i, c in enumerate(classifier.FEATURES)}
    for text, row in zip(texts, got):
        words = (text or "").encode().split()
        n = max(len(words), 1)
        lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
        triples = list(zip(words, words[1:], words[2:]))
        want = {
            "words": np.log1p(len(words)), "longest_word": np.log1p(max(map(len, words), default=0)), "ends": sum((text or "").count(x) for x in ".!?") / n,
            "distinct_words": len(set(words)) / n, "stutters": sum(a == b for a, b in zip(words, words[1:])) / n,
            "repeated_runs": 1 - len(set(triples)) / len(triples) if triples else 0, "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0,
            "short_lines": sum(len(x.split()) <= 3 for x in lines) / max(len(lines), 1), "short_words": sum(len(x) <= 3 for x in words) / n,
            "digits": sum(x.isdigit() for x in text or "") / max(len("".join((text or "").split())), 1),
        }
        for c, x in want.items():
            assert row[name[c]] == pytest.approx(x), (text, c)


def plain_and_noisy(n, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(200)]
    out = []
    for i in range(n):
        words = [r.choice(pool) for _ in range(r.randint(20, 80))]
        bad = i % 4 == 0
        if bad and i % 8:
            words = [w + r.choice(["###", "$$$"]) for w in words]
        elif bad:
            words = words[:2] * 20
        out.append((i, " ".join(words) + ".", int(not bad)))
    return out


def test_classifier_learns_and_holds_out(spark):
    rows = plain_and_noisy(900, 3)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classifier.quality_scores(docs, labels).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert all(got[x[0]]["held_out"] == (x in held) for x in rows)
    assert np.mean([got[x[0]]["predicted"] == x[2] for x in held]) > 0.97
    # labels of rows held out, columns beside the text and the order of rows change nothing
    wrong = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    more = docs.withColumns({"x": F.lit("x"), "id": F.lit(1), "score": F.lit(2), "lang": F.lit("en"), "label": F.col("doc_id")}).repartition(5)
    again = {r["doc_id"]: r["score"] for r in classifier.quality_scores(more, wrong.repartition(2)).collect()}
    assert all(again[k] == pytest.approx(r["score"], abs=1e-9) for k, r in got.items())


def test_classifier_takes_odd_rows(spark):
    docs = [(None, "a b"), (1, None), (2, ""), (2, ""), (3, "word " * 50_000), (4, "é"), (4, "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.quality_scores(df, none).collect()} == {0.5}
    labels = spark.createDataFrame([(2, 1), (2, None), (3, 0), (4, 0), (4, 1), (None, 1), (5, 1), (6, 7)], "doc_id long, quality int")
    got = classifier.quality_scores(df, labels).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert classifier.quality_scores(df.limit(0), labels).count() == 0
