"""Fill-in-the-middle cuts, the conversation trie and source mixing, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regrove.llm import fill_middle, mixing, prefix_trie, running

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# fill in the middle

def plain_middle(key, text):
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_plain_cuts_and_restores(spark):
    rng = random.Random(5)
    alphabet = ["a", "bé", "中文字", "x" * 40, " ", "  \n", "\t", "<", "<P", "S>", "👍🏽", " ", "\x1f", "<M>"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for i in range(1500)]
    rows += [(5000 + i, " ".join(f"w{j}é" for j in range(40_000)) + " ") for i in range(4)] + [(6000, None), (None, "some words here now"), (6001, "")]
    rows += [(6002, "same row"), (6002, "same row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restore()).collect()
    want = sorted((str(k), *plain_middle(k, t), t or "") for k, t in rows)
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_skip_list_reaches_every_rank():
    texts = pa.array(["a b  c ", "", None, "é" * 9, " ".join("中é" * (i % 5 + 1) for i in range(3000))])
    doc, points = fill_middle.tokens_of(texts)
    lanes = fill_middle.skip_list(doc, points, len(texts))
    assert len(lanes) > 3 and all(len(a.units) > len(b.units) for a, b in zip(lanes, lanes[1:]))
    for i, text in enumerate(texts.to_pylist()):
        units = TOKEN.findall(text or "")
        ends = np.cumsum([0] + [len(u) for u in units])
        ranks = np.arange(len(units) + 1)
        assert fill_middle.descend(lanes, np.full(len(ranks), i), ranks).tolist() == ends.tolist()


def test_middle_odd_tables(spark, odd_docs, no_docs):
    got = fill_middle.fill_in_middle(odd_docs.drop("n"))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()) == sorted(
        (str(r.doc_id), *plain_middle(r.doc_id, r.text)) for r in odd_docs.collect())
    assert fill_middle.fill_in_middle(odd_docs, keep=("doc_id", "score", "slot")).count() == odd_docs.count()
    assert fill_middle.fill_in_middle(no_docs).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(odd_docs, keep=("n",))


# conversation trie

def plain_trie(rows, openings):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    if openings:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - c % 20, [])[:h[c]] + v[h[c]:] for c, v in turns.items()}
    nodes = defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        own = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += own
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(str(c) for c in sorted(m) if len(turns[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
                   r.ends_sha256) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("local", [9, 1024])
def test_trie_equals_plain_trie(spark, tmp_path, local):
    rng = random.Random(local)
    rows = []
    for c in range(0, 220):
        words = [f"say {rng.randint(0, 2)} x" for _ in range(rng.randint(1, 6))]
        rows += [(c, i, rng.choice(["user", "assistant"]), w) for i, w in enumerate(words)]
        if c % 3 == 0:
            rows.append((c, -1, "system", "be kind to all"))
    rows += [(500 + c, i, "user", f"turn {i}") for c in range(3) for i in range(60 + 5 * c)]
    rows += [(7, None, None, None), (7, None, "user", None), (8, 0, "user", "tie b"), (8, 0, "user", "tie a"), (8, 0, "user", "tie a"), (None, 0, "user", "x"),
             (-3, 0, "user", "below zero"), (900, 0, "", ""), (901, 0, None, "")]
    spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).repartition(5).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    for openings in ([False, True] if local == 9 else [True]):
        if openings:
            table, kept = table.filter("conv_id is null or conv_id >= 0"), [r for r in rows if r[0] is None or r[0] >= 0]
        else:
            kept = rows
        assert trie_rows(prefix_trie.conversation_trie(table, openings, local)) == plain_trie(kept, openings)


def test_long_and_hot_conversations(spark, tmp_path):
    rows = [(1, i, "user", f"t {i % 50}") for i in range(1100)] + [(2, i, "user", f"t {i % 50}") for i in range(1050)]
    rows += [(10 + c, 0, "user", "hello there") for c in range(3000)]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/t")
    got = prefix_trie.conversation_trie(spark.read.parquet(f"{tmp_path}/t"), local=400)
    assert trie_rows(got) == plain_trie(rows, False)


def test_empty_trie(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA), True).count() == 0


def test_component_totals_of_random_trees():
    rng = random.Random(1)
    for size in (1, 2, 3, 50, 400):
        parent = [None] + [rng.randint(max(0, i - rng.choice([1, 3, 400])), i - 1) for i in range(1, size)]
        depth = [0] * size
        for i in range(1, size):
            depth[i] = depth[parent[i]] + 1
        order = sorted(range(size), key=lambda i: depth[i])
        rows = [{"a": i, "b": 0, "pa": parent[i], "pb": 0, "v": i + 1, "sum_v": 100} for i in order]
        want = [100] * size
        for i in range(size):
            j = i
            while j is not None:
                want[j] += i + 1
                j = parent[j]
        assert {a: s for a, _, s in prefix_trie.component_totals(rows, ["v"])} == dict(enumerate(want))


def test_running_totals_of_hot_groups(spark, tmp_path):
    spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', if(id % 3 = 1, null, cast(id % 50 as string))) as g", "id % 11 as o", "id % 7 as v").write.parquet(f"{tmp_path}/t")
    rows = running.range_sorted(spark.read.parquet(f"{tmp_path}/t"), ["g", "o"], ["g", "o", "v"])
    seen, want = defaultdict(list), defaultdict(list)
    for r in running.total_before(rows, ["g"], "v", "before").collect():
        seen[r.g].append((r.before, r.v, r.o))
    for g, found in seen.items():
        found.sort(key=lambda x: (x[2], x[0], x[1]))
        total = 0
        for before, v, _ in sorted(found, key=lambda x: (x[0], x[2], x[1])):
            assert before == total
            total += v
        assert total == sum(v for _, v, _ in found)
    assert sum(map(len, seen.values())) == 20_000


# mixing

def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left, share = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / share for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def mix_table(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def test_mix_equals_plain_sampling(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice(["a", "a", "a", "a", "b", "ß", "Z", None])) for i in range(1200)]
    rows += [(5000, "one two three", "tiny"), (5001, "", "empty"), (5002, None, "empty"), (None, "no id here", "b"), (7, "again", "b"), (7, "again", "b"),
             (5003, "word " * 30_000, "long")]
    docs = mix_table(spark, f"{tmp_path}/t", rows)
    weight = F.sqrt(prefix_trie.word_count())
    got = mixing.mix_sources(docs, importance=weight).collect()
    drawn = {(r.doc_id, r.text): r.u for r in docs.withColumn("h", F.xxhash64("text")).withColumn("u", mixing.uniform(42, "doc_id", "h")).collect()}
    by = defaultdict(list)
    for k, t, s in rows:
        n = len((t or "").split())
        m = 2 ** (math.floor(math.log2(math.sqrt(n)) * 8 + 0.5) / 8) if n else 1.0
        by[s].append((k, n, m, drawn[k, t]))
    target = plain_targets({s: sum(r[1] for r in v) for s, v in by.items()})
    assert sum(target.values()) == pytest.approx(sum(r.size for r in got))
    want = []
    for s, docs_of in by.items():
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(3, mid * m) for _, n, m, _ in docs_of) < target[s] else (low, mid)
        expected = [min(3.0, high * m) if target[s] < 3 * sum(r[1] for r in docs_of) else 3.0 for _, _, m, _ in docs_of]
        missing = round(target[s] - sum(math.floor(e + 1e-12) * r[1] for e, r in zip(expected, docs_of)))
        ranked = sorted((((u / (1 - u)) * (1 - (e % 1)) / (e % 1), str(k), k, n, math.floor(e)) for e, (k, n, _, u) in zip(expected, docs_of) if e % 1 > 1e-12))
        want += [(str(r[0]), s, r[1], math.floor(e + 1e-12) * r[1]) for e, r in zip(expected, docs_of) if not e % 1 > 1e-12]
        for _, _, k, n, copies in ranked:
            extra = max(0, min(n, missing))
            missing -= n
            want.append((str(k), s, n, copies * n + extra))
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.doc_id), r.source, r.size, r.taken) for r in got), key=key) == sorted(want, key=key)
    for s in by:
        of = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size for r in of)
        assert abs(sum(r.taken for r in of) - target[s]) <= 1
    assert {r.copies for r in got} >= {0, 1, 2, 3}


def test_mix_reruns_agree_and_chances_hold(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 40), "ab"[i % 3 == 0]) for i in range(3000)]
    docs = mix_table(spark, f"{tmp_path}/t", rows)
    plain = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    once = plain(mixing.mix_sources(docs))
    assert once == plain(mixing.mix_sources(mix_table(spark, f"{tmp_path}/u", rows[::-1])))
    assert once != plain(mixing.mix_sources(docs, seed=7))
    got = mixing.mix_sources(docs, importance=F.when(F.col("doc_id") < 1500, 2.0).otherwise(1.0)).filter("source = 'a'").collect()
    early = np.mean([r.taken / r.size for r in got if r.doc_id < 1500])
    late = np.mean([r.taken / r.size for r in got if r.doc_id >= 1500])
    assert 1.6 < early / late < 2.5


def test_mix_odd_tables(spark, tmp_path, odd_docs, no_docs):
    assert mixing.mix_sources(no_docs).count() == 0
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    same = mix_table(spark, f"{tmp_path}/t", [(1, "a b c", "x")] * 500 + [(2, "d e", "y")])
    got = mixing.mix_sources(same).collect()
    assert sum(r.taken for r in got if r.source == "x") == 1496 and sum(r.taken for r in got if r.source == "y") == 6
    blank = mix_table(spark, f"{tmp_path}/b", [(1, "", "x"), (2, None, None)])
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.mix_sources(blank).collect()] == [(0, 0, 0.0, 0)] * 2
