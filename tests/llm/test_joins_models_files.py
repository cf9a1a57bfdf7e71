"""Near duplicates, templates, models and id files against brute force, and the pipeline as a whole."""

import collections
import math
import pathlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regrove.llm import brown, components, elias_fano, language, partenum, ranking, registry, templates, token_files, words

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = "piece_bpe_32k.model"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def brute_components(rows):
    sets = {}
    for i, (key, t) in enumerate(rows):
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    best = {g: min((k for k in ks if k is not None), default=None) for g, ks in least.items()}
    return [(rows[i][0], len(sets[i]), best[find(i)]) for i in range(len(rows))]


def as_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(seed, n):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = random.choices(vocab, k=30)
    docs = []
    while len(docs) < n:
        base = random.choices(vocab, k=random.choice([1, 3, 5, 6, 8, 12, 20, 45, 80, 150]))
        if random.random() < 0.4:
            base[3:3] = passage
        for _ in range(random.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 30))):
                copy[random.randrange(len(copy))] = random.choice(vocab)
            if random.random() < 0.3:
                copy += random.choices(vocab, k=random.randint(1, 1 + len(base) // 5))
            docs.append(" ".join(copy))
    return docs[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_partenum_equals_brute_force(spark, seed):
    rows = list(enumerate(near_copies(seed, 260)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(partenum.similar_groups(df)) == sorted(brute_components(rows), key=str)


def test_partenum_with_frequent_features(spark, monkeypatch):
    """With almost every feature left out, sets are signed over the whole domain or by prefixes."""
    monkeypatch.setattr(partenum, "LOCALLY", 1)
    monkeypatch.setattr(partenum, "OVERALL", 2)
    rows = list(enumerate(near_copies(4, 200)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(partenum.similar_groups(df)) == sorted(brute_components(rows), key=str)


def test_linked_sets_share_a_signature():
    """The guarantee itself: any pair at the limit shares a signature."""
    rng = np.random.default_rng(7)
    none = partenum.Frequent(np.zeros(1, np.uint64))
    for size in [*range(1, 40), 75, 133, 400, 1000]:
        for _ in range(6):
            a = np.unique(rng.integers(1, 1 << 63, size, dtype=np.int64).view(np.uint64))
            gone, new = 0, 0
            while True:         # one more difference would break the limit
                more = (gone + 1, new) if rng.random() < 0.5 else (gone, new + 1)
                common, union = len(a) - more[0], len(a) + more[1]
                if 100 * common < 75 * union:
                    break
                gone, new = more
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(1, 1 << 63, new, dtype=np.int64).view(np.uint64)]))
            sets = object.__new__(partenum.Sets)
            sets.size = np.array([len(a), len(b)])
            sets.start = np.array([0, len(a), len(a) + len(b)])
            sets.value = np.concatenate([a, b])
            sets.doc = np.repeat([0, 1], sets.size)
            sig, row, _ = partenum.signatures(sets, none)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (size, gone, new)


def test_two_levels_and_parities_keep_every_link():
    """Sets of frequent elements only, so that all are signed over subsets of sub-parts or by prefixes."""
    rng = np.random.default_rng(12)
    for _ in range(250):
        n = int(rng.choice([1, 2, 4, 7, 12, 18, 24, 25, 40, 90, 300]))
        a = rng.choice(2**62, n, replace=False).astype(np.uint64)
        drop = rng.integers(0, n // 4 + 1)
        room = int((n - drop) * 4 / 3 - n)          # additions that keep the similarity at 3 / 4
        b = np.concatenate([rng.permutation(a)[drop:], rng.choice(2**62, max(0, room), replace=False).astype(np.uint64)])
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * common < 75 * union:
            continue
        every = partenum.Frequent(np.sort(np.concatenate([a, b])))
        sets = object.__new__(partenum.Sets)
        values = [np.unique(a), np.unique(b)]
        sets.size = np.array([len(v) for v in values])
        sets.start = np.concatenate([[0], np.cumsum(sets.size)])
        sets.value, sets.doc = np.concatenate(values), np.repeat([0, 1], sets.size)
        sig, row, _ = partenum.signatures(sets, every)
        assert np.intersect1d(sig[row == 0], sig[row == 1]).size, (n, drop, room)
        bits = sets.parities()
        assert int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum()) <= union - common


def test_partenum_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert as_rows(partenum.similar_groups(odd_docs)) == sorted(brute_components(rows), key=str)
    assert partenum.similar_groups(no_docs).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_words_match_the_pattern():
    texts = ["", "a  b", "Ünï\tcode\nx", None, " ", "x" * 2_000_000 + " y", "A b A"]
    w = words.words_of(pa.array(texts), lower=False)
    got = [[] for _ in texts]
    for d, s, e in zip(w.doc, w.start, w.end):
        got[d].append(w.data[s:e].tobytes().decode())
    assert got == [WORD.findall(t or "") for t in texts]
    h = w.hash[w.doc == 6]
    assert h[0] == h[2] != h[1]


def test_templates_find_changed_questions(spark):
    item = "A train leaves Paris with 3 wagons and 3 drivers and travels 120 km before it stops near the old stone bridge for tea"
    other = item.replace("3", "8").replace("120 km", "75 miles").replace("Paris", "London")
    mixed = item.replace("3 drivers", "5 drivers").replace("3 wagons", "9 wagons")
    docs = spark.createDataFrame([
        (1, "Some words first. " + item + " and last"), (2, other.upper().replace("LONDON", "London")), (3, "so then " + other), (4, mixed),
        (5, "A train leaves early and nobody travels near the bridge"), (6, None), (7, ""), (None, item), (1, item)],
        "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, item), (12, "too short"), (13, None)], "item_id long, text string")
    got = templates.template_matches(docs, bench).collect()
    found = {r.doc_id: r for r in got}
    assert set(found) == {1, 2, 3, None} and {r.item_id for r in got} == {10}
    assert found[3].n_changed > 0 and found[2].n_changed > 0 and found[1].n_changed == 0
    kept = templates.without_matches(docs, templates.template_matches(docs, bench)).collect()
    assert {r.doc_id for r in kept} == {4, 5, 6, 7}


def test_template_classes_stand_for_their_items(spark):
    ask = "A train leaves the station with {} wagons and travels {} km before it stops near the old stone bridge for tea"
    bench = spark.createDataFrame([(i, ask.format(i + 3, 2 * i + 500)) for i in range(300)] + [(900, ask.format(7, 7))], "item_id long, text string")
    docs = spark.createDataFrame([(i, "so " + ask.format(i + 3, 2 * i + 500)) for i in range(300)] + [(900, ask.format(1001, 1001))], "doc_id long, text string")
    got = templates.template_matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(i, 0) for i in range(300)} | {(900, 900)} and len(got) <= 602
    members = templates.item_classes(bench).collect()
    assert {(r.item_id, r.representative) for r in members} == {(i, 0) for i in range(300)} | {(900, 900)}


@pytest.mark.parametrize("limit", [templates.BROADCAST_WINDOWS, 0])
def test_verbatim_copies_of_short_and_dense_items(spark, monkeypatch, limit):
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", limit)
    dense = "On 3 May 1912 Anna Berg paid 12 km 40 kg 7 dollars 99 cents to Karl Holm in Oslo 1913 1914 1915"
    named = "He told Anna Berg that Karl Holm met Lena Falk and Olaf Lund near Oslo before the Winter"
    bench = spark.createDataFrame([(1, "What is 17 times 23?"), (2, dense), (3, named), (4, "..."), (5, "yes")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Tell me: what is 17 times 23? Thanks."), (2, "Table 4. " + dense + " End of it."), (3, "and " + named.upper()),
        (4, "What is 18 times 23?"), (5, "... nothing"), (None, "what is 17 times 23"), (6, None), (7, "Oh YES indeed"), (8, "yesterday"),
        (9, "Some answer:\n YES!\nand more")],
        "doc_id long, text string")
    found = templates.template_matches(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 2), (3, 3), (None, 1), (9, 5)}
    assert {r.doc_id for r in templates.without_matches(docs, found).collect()} == {4, 5, 6, 7, 8}


def test_templates_without_a_broadcast(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = sorted((r.doc_id, r.item_id, r.matched) for r in templates.template_matches(docs, bench).collect())
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", 0)
    assert sorted((r.doc_id, r.item_id, r.matched) for r in templates.template_matches(docs, bench).collect()) == want


def test_templates_on_odd_rows(spark, odd_docs, no_docs):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert templates.template_matches(odd_docs, bench).count() == 0
    assert templates.template_matches(no_docs, bench).count() == 0
    assert templates.template_matches(odd_docs, bench.limit(0)).count() == 0


def segmentations(word, table):
    """Sum over all segmentations, letter by letter."""
    if not word:
        return 1.0
    return sum(table[word[:n]] * segmentations(word[n:], table) for n in range(1, len(word) + 1) if word[:n] in table) + (
        0 if word[0] in table else language.FLOOR * segmentations(word[1:], table))


def test_forward_sums_all_segmentations():
    vocab = language.Vocabulary(["▁", "a", "b", "ab", "▁a", "ba", "aba", "Upper", "1"])
    rng = np.random.default_rng(3)
    p = rng.random((len(vocab), 2))
    for w in ["a", "ab", "abab", "bbab", "axb", "x", "abxba"]:
        got = language.word_scores([w], vocab, p)[0]
        for lang in (0, 1):
            table = dict(zip(vocab.pieces, p[:, lang]))
            assert got[lang] == pytest.approx(math.log(segmentations("▁" + w, table)))


def test_long_words_and_numerals(spark):
    vocab = language.Vocabulary(["▁", "a", "b", "ab", "▁a", "ba", "abab"])
    p = np.random.default_rng(8).random((len(vocab), 2)) / 3
    for w in ["ab" * 20 + "xba", "b", "a" * 48]:
        assert language.long_word_score(w, vocab, p, block=7) == pytest.approx(language.word_scores([w], vocab, p)[0])
    w = "abba" * 3000
    assert language.word_scores([w], vocab, p)[0] == pytest.approx(language.long_word_score(w, vocab, p, block=100_000))
    assert language.letters_only("x²") == "x" and language.letters_only("²") == ""
    docs = spark.createDataFrame([(1, "²²² ½"), (2, "word² here"), (3, "y" * 200_000)], "doc_id long, text string")
    model = language.Pieces(["en"], np.full((len(vocab), 1), 0.1))
    assert [r.lang_pred for r in language.identify(docs, model, vocab.pieces).orderBy("doc_id").collect()] == ["und", "en", "en"]
    kept = language.identify(docs, model, vocab.pieces, keep=("text", "doc_id"))
    assert kept.columns == ["text", "doc_id", "lang_pred", "score"] and kept.filter("length(text) > 4").count() == 3


def test_expected_counts_are_the_gradient():
    vocab = language.Vocabulary(["▁", "a", "b", "ab", "▁a", "ba"])
    p = np.random.default_rng(4).random((len(vocab), 1))
    ws, n = ["abab", "bab"], np.array([[2.0], [3.0]])
    got = language.expected(ws, n, vocab, p)
    for i in range(len(vocab)):
        q = p.copy()
        q[i] *= 1 + 1e-6
        change = (n * (language.word_scores(ws, vocab, q) - language.word_scores(ws, vocab, p))).sum() / 1e-6
        assert got[i, 0] == pytest.approx(change, rel=1e-3, abs=1e-6)


def test_languages_of_held_out_documents(spark):
    rows = registry.queries()["op9_marginal_unigrams"](spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_rare_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 40)
    common = [(i, f"the house number {i} stands near the old stone bridge and the river", "en") for i in range(4000)]
    rare = [(10_000 + i, "sa bahay na malaki ay may pusa at aso kasama ang bata", "tl") for i in range(4)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    pieces = language.public_pieces(registry.vocabulary_path(PIECES))[:3000]
    model = language.learn(docs, "text", "lang", pieces)
    assert model.languages == ["en", "tl"]
    got = language.identify(docs.filter("doc_id >= 9990 or doc_id < 5"), model, pieces).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: "tl" if i >= 10_000 else "en" for i in [*range(5), *range(10_000, 10_004)]}


def test_languages_on_odd_rows(odd_docs, no_docs):
    pieces = language.public_pieces(registry.vocabulary_path(PIECES))[:3000]
    model = language.learn(odd_docs, "text", "lang", pieces)
    got = language.identify(odd_docs, model, pieces).collect()
    assert {r.doc_id: r.lang_pred for r in got}[4] == "und" and {r.doc_id: r.lang_pred for r in got}[10] == "und"
    empty = language.learn(no_docs, "text", "lang", pieces)
    assert {r.lang_pred for r in language.identify(odd_docs, empty, pieces).collect()} == {"und"}


def test_workers_hold_nothing_of_earlier_stages(spark):
    """Workers are used again: a later stage must not carry the words that language identification remembered."""
    docs = spark.createDataFrame([(i, f"some words of text {i} and more of it") for i in range(40)], "doc_id long, text string").repartition(4)
    vocab = language.Vocabulary([chr(0x2581), *"abcdefghijklmnopqrstuvwxyz"])
    model = language.Pieces(["en"], np.full((len(vocab), 1), 1 / len(vocab)))

    def held(batches):
        memos = {k: len(v) for k, v in words.memos().items()}
        yield from ()
        yield pa.RecordBatch.from_arrays([pa.array([memos.get("language", 0) + memos.get("vocabulary", 0)])], ["n"])

    count = lambda: sum(r.n for r in docs.mapInArrow(held, "n long").collect())
    assert language.identify(docs, model, vocab.pieces).count() == 40 and count() > 0
    for _ in range(3):      # the tasks of a stage need not use every worker
        assert partenum.describe(docs, "text", ("doc_id",)).filter("feature is null").count() == 40
    before = docs.mapInArrow(words.lean(held), "n long").collect()
    assert sum(r.n for r in before) == 0


def test_class_bigrams(spark):
    rows = registry.queries()["op8_class_bigrams"](spark, FOLDER).collect()
    texts = {r.doc_id: WORD.findall(lower(r.text or "")) + [None] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    seen = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            seen.update(t)
    n, v = sum(seen.values()), len(seen)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(seen[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_raises_the_likelihood_and_finds_classes(spark):
    random.seed(8)
    a, b = [f"x{i}" for i in range(12)], [f"y{i}" for i in range(12)]
    texts = [" ".join(random.choice(a if i % 2 else b) for i in range(60)) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    known = words.words_of(pa.array(a + b)).hash.view(np.int64)
    classes, history = brown.exchange(brown.symbol_bigrams(df, known), len(known), classes=2, rounds=8)
    assert max(history) > history[0]
    assert len(set(classes[:12])) == len(set(classes[12:24])) == 1 and classes[0] != classes[12]


def test_best_move_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(2)
    n, kinds = 9, 5
    pair = rng.integers(0, 30, (n, n)).astype(float)
    cls = np.concatenate([rng.integers(0, 4, n - 1), [4]])

    def context(c):
        hot = np.eye(kinds)[c]
        return pair @ hot, pair.T @ hot, np.diag(pair)

    target, gain, base = brown.best_moves(*context(cls), cls, n - 1, 4)
    for w in range(n - 1):
        moved = cls.copy()
        moved[w] = target[w]
        assert brown.best_moves(*context(moved), moved, 0, 4)[2] - base == pytest.approx(gain[w], abs=1e-6)


def test_class_bigrams_on_odd_rows(odd_docs, no_docs):
    model, counts = brown.train(odd_docs)
    got = brown.score(odd_docs, model, counts).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r.score) for r in got)
    model, counts = brown.train(no_docs)
    assert all(r.base_score == pytest.approx(0) for r in brown.score(odd_docs, model, counts).collect())


def test_ranking_orders_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = registry.queries()["op5_pairwise_ranking"](spark, folder).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)
    assert sum(q == p for _, q, p in held) >= 0.85 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_pairs_use_every_row_of_the_larger_side(spark):
    rows = [(i, 1 if i % 5 else 0, [float(i % 5 > 0)] + [0.0] * (len(ranking.FEATURES) - 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, label int, features array<double>")
    pairs = ranking.preference_pairs(df, "label", "doc_id")
    assert pairs.count() == 160 and all(r[0][0] == 1.0 for r in pairs.collect())


def test_pairs_use_rare_labels_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 50)
    d = len(ranking.FEATURES)
    rows = [(i, 0 if i in (7, 700, 901) else 1, [float(i)] + [0.0] * (d - 1)) for i in range(1000)] + [(2000, 3, [0.0] * d), (2001, None, [0.0] * d)]
    df = spark.createDataFrame(rows, "doc_id long, label int, features array<double>")
    got = [r[0][0] for r in ranking.preference_pairs(df, "label", "doc_id").collect()]
    assert len(got) == 997
    # Every good row is in one pair, every bad one in a third of them.
    assert sum(got) == pytest.approx(sum(i for i in range(1000) if i not in (7, 700, 901)) - 332 * (7 + 700 + 901), abs=1000)


def test_fit_minimises_the_pairwise_loss(spark):
    rng = np.random.default_rng(3)
    d = len(ranking.FEATURES)
    x = np.zeros((300, d))
    x[:, :3] = rng.normal(size=(300, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(300)], "doc_id long, label int, features array<double>")
    z = np.array([r[0] for r in ranking.preference_pairs(df, "label", "doc_id").collect()])
    scale = np.sqrt((z * z).mean(axis=0))
    z = np.where(scale > 0, z / np.where(scale > 0, scale, 1), 0)
    w = np.zeros(d)
    for _ in range(4000):       # plain gradient descent on the same loss
        w += 0.3 * (z.T @ (1 / (1 + np.exp(z @ w))) / len(z) - ranking.PENALTY * w)
    assert ranking.fit(df).weights[:3] == pytest.approx((w / np.where(scale > 0, scale, 1))[:3], abs=2e-3)


def test_ranking_on_odd_rows(spark, odd_docs, no_docs):
    rows = ranking.featured(odd_docs, "text", ("doc_id",))
    labelled = rows.withColumn("label", (F.coalesce("doc_id", F.lit(0)) % 2).cast("int"))
    got = ranking.score(rows, ranking.fit(labelled)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    none = ranking.fit(labelled.limit(0))
    assert all(r.score == pytest.approx(0.3) for r in ranking.score(rows, none).collect())
    assert ranking.featured(no_docs, "text", ("doc_id",)).count() == 0


@pytest.mark.parametrize("n,universe", [(0, 0), (1, 0), (5, 5), (1000, 10 ** 6), (3000, 3000), (700, 10 ** 12), (2000, 20)])
def test_elias_fano_round_trip(n, universe):
    x = np.sort(np.random.default_rng(n).integers(0, universe + 1, n))
    code = elias_fano.EliasFano(elias_fano.encode(x, universe))
    assert (code.all() == x).all() and [code.select(i) for i in range(n)] == x.tolist()
    for first in range(0, n, 97):
        for count in (1, 255, 256, 300):
            assert (code.block(first, count) == x[first:first + count]).all()
    if n >= 1000:
        assert 8 * len(elias_fano.encode(x, universe)) < n * (3 + math.log2(max(universe / n, 1)) + 1)


def test_remembered_pieces_give_the_library_ids():
    tool = token_files.Encoder(registry.vocabulary_path("byte_bpe_50k.json"))
    random.seed(2)
    texts = ["a  b", "a \n b", "\n \n x", "a <|endoftext|> b", "don't  'll", "　 　", "a\x85 b", "\x1c \x1c a", " ", ""]
    texts += ["".join(random.choice(" \n\tab.1'é中  \x85!") for _ in range(random.randint(0, 14))) for _ in range(2000)]
    for _ in range(2):
        for t, ids in zip(texts, tool.encode(texts)):
            assert np.frombuffer(ids, tool.kind).tolist() == tool.tool.encode(t, add_special_tokens=False).ids, t


def test_id_files(spark):
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(registry.vocabulary_path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in registry.queries()["op10_elias_fano_ids"](spark, FOLDER).collect()}
    start = 0
    for r in sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array(tool.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        got = rows[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_number_of_id_files_follows_the_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    path = registry.vocabulary_path("byte_bpe_50k.json")
    files = token_files.write_token_files(docs, path, file_bytes=4_000)
    total = files.agg(F.sum(F.col("n_ids") * F.col("width"))).first()[0]
    assert files.count() > 2 * spark.sparkContext.defaultParallelism and files.count() <= -(-total // 4_000)
    few = token_files.write_token_files(docs, path)
    assert few.count() <= 2 * spark.sparkContext.defaultParallelism
    assert token_files.read_token_files(few).exceptAll(token_files.read_token_files(files)).count() == 0


def test_id_files_of_odd_rows(odd_docs, no_docs):
    path = registry.vocabulary_path("byte_bpe_50k.json")
    got = sorted(token_files.read_token_files(token_files.write_token_files(odd_docs, path)).collect(), key=lambda r: r.start)
    assert len(got) == odd_docs.count() and got[0].doc_id is None and [r.n_tokens for r in got if r.doc_id == 4] == [1]
    assert token_files.read_token_files(token_files.write_token_files(no_docs, path)).count() == 0


def plain_pipeline(spark, folder):
    """The filters of the pipeline by plain rules: which documents are left, with which text."""
    from regrove.llm import personal_data
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = [x for x, c in zip(rows, brute_components(rows)) if c[2] == x[0]]
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [flat(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(f" {x} " in f" {flat(t)} " for x in items)]
    tree = personal_data.automaton()
    return {i: personal_data.redact(t, personal_data.find_spans(t, tree)) for i, t in rows}


def test_pipeline(spark):
    import corpus_pipeline
    want = plain_pipeline(spark, FOLDER)
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(WORD.findall(t)) + 1 for i, t in want.items()}


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs_out = stage(spark, docs, FOLDER)
            assert docs_out.columns == docs.columns and docs_out.count() <= docs.count(), name
        corpus_pipeline.pack_buckets(spark, docs, FOLDER).count()
    kept = corpus_pipeline.drop_near_duplicates(spark, odd_docs, FOLDER).collect()
    assert sum(r.doc_id == 1 for r in kept) == 1 and not any(r.doc_id in (2, 8) for r in kept)


def test_best_classes_agree_with_best_moves():
    rng = np.random.default_rng(5)
    n, kinds = 30, 7
    pair = rng.integers(0, 9, (n, n)) * (rng.random((n, n)) < 0.2)
    cls = np.concatenate([rng.integers(0, 4, 20), rng.integers(4, 6, n - 21), [6]])
    hot = np.eye(kinds)[cls]
    after, before, own = pair @ hot, pair.T @ hot, np.diag(pair).astype(float)
    _, gain, likelihood = brown.best_moves(after, before, own, cls, 20, 4)      # these are in open classes
    target, found = brown.best_classes(after, before, own, cls, hot.T @ pair @ hot, 4)
    assert found[:20] == pytest.approx(gain[:20], abs=1e-8)
    for w in range(n - 1):
        moved = cls.copy()
        moved[w] = target[w]
        hot = np.eye(kinds)[moved]
        assert brown.likelihood_of(hot.T @ pair @ hot) - likelihood == pytest.approx(found[w], abs=1e-8)


def test_rare_words_join_the_classes_of_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(brown, "VOCABULARY", 30)
    monkeypatch.setattr(brown, "HEAD", 40)
    rng = random.Random(3)
    nouns, verbs = [f"noun{i:02}" for i in range(15)], [f"verb{i:02}" for i in range(15)]
    rare = [f"thing{i:03}" for i in range(60)], [f"doing{i:03}" for i in range(60)]
    texts = [" ".join(w for _ in range(20) for w in (rng.choice(nouns), rng.choice(verbs))) for _ in range(300)]
    texts += [f"{rng.choice(nouns)} {v} {n} {rng.choice(verbs)}" for n, v in zip(*rare) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(brown, "CLASSES", 2)
    monkeypatch.setattr(brown, "KINDS", 2 + brown.LENGTHS + 1)
    monkeypatch.setattr(brown.exchange, "__defaults__", (2, brown.ROUNDS))
    model, rest = brown.train(docs)
    table = {r.word: (r.c, r.cls) for r in rest.collect()}
    hashes = lambda ws: words.words_of(pa.array([" ".join(ws)])).hash.view(np.int64)
    of = lambda ws: [model.head_class[np.searchsorted(model.head, h)] if h in model.head else table[int(h | brown.TAIL)][1] for h in hashes(ws)]
    assert len(model.head) + len(table) == 150 and len(table) >= 110
    assert len(set(of(nouns + rare[0]))) == len(set(of(verbs + rare[1]))) == 1 and of(nouns)[0] != of(verbs)[0]
    assert max(table[w][1] for w in table) < 2

    # The score is that of plain class bigrams, also across words outside the head and unseen ones.
    held = ["noun01 doing001 thing002 verb03", "unseenword thing001 doing002 doing003 noun01 nowhere", "", "thing005", None]
    got = {r.doc_id: r for r in brown.score(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), model, rest).collect()}
    n_of = collections.Counter(w for t in texts for w in t.split())
    for i, t in enumerate(held):
        at, value = brown.KINDS - 1, 0.0
        for w in (t or "").split():
            c = of([w])[0] if w in n_of else model.unseen[min((len(w) - 1) // 4, brown.LENGTHS - 1)]
            value += model.transition[at, c] + math.log10(n_of[w] + brown.ADD) - model.class_total[c]
            at = c
        assert got[i].score == pytest.approx(value + model.transition[at, -1])
        assert got[i].n_known == 1 + sum(w in n_of for w in (t or "").split())
    share = {c: 0.0 for c in set(of(list(n_of))) | set(model.unseen.tolist())}
    for w, c in zip(n_of, of(list(n_of))):
        share[c] += 10 ** (math.log10(n_of[w] + brown.ADD) - model.class_total[c])
    for c in model.unseen.tolist():
        share[c] += brown.ADD / 10 ** model.class_total[c]
    assert all(s == pytest.approx(1) for s in share.values())


def test_pairs_are_pruned_by_size_and_parity_in_compiled_code(spark):
    rng = np.random.default_rng(4)
    words_ = partenum.PARITY // 64
    base = rng.integers(-1 << 62, 1 << 62, words_)
    rows = []
    for i in range(60):
        flips = np.zeros(words_, np.int64)
        for bit in rng.integers(0, partenum.PARITY if i % 2 else 700, i):
            flips[bit // 64] ^= np.int64(1) << np.int64(bit % 64)
        rows.append((i, 100 + 3 * i, (base ^ flips).tolist()))
    facts = spark.createDataFrame([(1, *r) for r in rows], "sig int, cls long, n long, parity array<long>")
    side = lambda e: facts.select("sig", F.col("cls").alias(e), F.col("n").alias(f"n_{e}"), F.col("parity").alias(f"parity_{e}"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):
            spark.conf.set(k, v)
        met = side("a").join(side("b"), "sig").filter((F.col("a") < F.col("b")) & partenum.possible()).select("a", "b")
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(met._jdf.queryExecution().executedPlan())
        assert all(stages.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(stages.size()))
        got = {tuple(r) for r in met.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    differ = lambda x, y: sum(((u ^ v) & 0xFFFFFFFFFFFFFFFF).bit_count() for u, v in zip(x, y))
    want = {(i, j) for i, n, x in rows for j, m, y in rows if i < j and 100 * min(n, m) >= 75 * max(n, m) and 7 * differ(x, y) <= n + m}
    assert got == want and 0 < len(want) < 1770


def test_ids_are_staged_and_shuffled_packed(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = token_files.encoded(docs, registry.vocabulary_path("byte_bpe_50k.json"), "text", "doc_id", 2).agg(
        F.sum(F.octet_length("ids")).alias("held"), F.sum("size").alias("size")).first()
    assert 0 < got.held < 0.8 * got["size"]


def test_texts_are_encoded_on_their_way_into_the_shuffle(spark, monkeypatch):
    def refuse(self, path, *rest, **more):
        raise AssertionError(f"{path} is staged")

    rows = [(None if i % 7 == 0 else f"k{i % 50:02}", None if i % 11 == 0 else f"text {i % 90} " * (i % 40)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    path = registry.vocabulary_path("byte_bpe_50k.json")
    monkeypatch.setattr(type(docs.write), "parquet", refuse)
    files = token_files.write_token_files(docs, path, file_bytes=1_000)
    assert files.count() > 2 * spark.sparkContext.defaultParallelism
    got = sorted(token_files.read_token_files(files, "doc_id", "string").collect(), key=lambda r: r.start)
    keys = [r.doc_id or "" for r in got]
    assert keys == sorted(keys) and [a.start + a.n_tokens for a in got[:-1]] == [b.start for b in got[1:]]
    tool = token_files.Encoder(path)
    ids = lambda t: np.append(np.frombuffer(tool.encode([t or ""])[0], tool.kind), [2]).astype("<u4")
    want = collections.Counter((k, len(ids(t)), zlib.crc32(ids(t).tobytes())) for k, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_shuffle_files_go_when_a_table_is_staged(spark):
    from regrove.session import staged
    manager = spark._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {p for d in manager.localDirsString() for p in pathlib.Path(d).rglob("shuffle_*")}
    before = files()
    dealt = spark.range(10_000).repartition(5, "id")
    assert staged(dealt, "dealt").count() == 10_000
    for _ in range(50):
        left = {p for p in files() - before if p.name.endswith(".data") and p.stat().st_size > 10_000}
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert dealt.filter("id < 10").count() == 10        # and may be run again


def test_only_texts_that_may_have_a_verdict_are_shuffled(spark):
    import corpus_pipeline
    docs = spark.createDataFrame([(i, f"some words {i % 300} of text {i % 300} with five and more") for i in range(400)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and "ArrowEvalPython" in plan[plan.index("LeftAnti"):]
        assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    some = docs.limit(40).select(F.xxhash64("text").alias("cls"))
    named = partenum.may_be_among(some)
    hits = docs.filter(named(F.xxhash64("text")))
    assert some.join(hits, some.cls == F.xxhash64(hits.text), "left_anti").count() == 0 and hits.count() < 150


def test_pipeline_stages_pass_texts_in_small_batches(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.redact_personal_data):
            spark.conf.set(key, "10000")
            out = stage(spark, docs, FOLDER)
            assert int(spark.conf.get(key)) <= 1000 and out.count() > 0
    finally:
        spark.conf.set(key, before)


def test_counts_beside_words_are_shuffled_packed(spark, monkeypatch):
    """What is shuffled in a round are arrays, a few for each task and bucket whatever the words, and they add up to the counts of all pairs."""
    monkeypatch.setattr(brown, "HEAD", 40)
    random.seed(5)
    texts = [" ".join(f"w{int(random.paretovariate(0.7)) % 300}" for _ in range(80)) for _ in range(120)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    seen = collections.Counter(w for t in texts for w in t.split())
    hash_of = dict(zip(seen, words.words_of(pa.array(list(seen))).hash.view(np.int64).tolist()))
    head = np.sort(np.array([hash_of[w] for w, _ in seen.most_common(40)], np.int64))
    name = {w: int(np.searchsorted(head, h)) if h in head else int(h | brown.TAIL) for w, h in hash_of.items()}
    found = brown.word_bigrams(docs, head, 2).collect()
    chains = [[40, *map(name.get, t.split()), 40] for t in texts]
    pairs = collections.Counter(p for c in chains for p in zip(c, c[1:]))
    got, swapped = collections.Counter(), collections.Counter()
    for r in found:
        if r.blob is None:
            got[r.a, r.b] += r.n
        else:
            key, n = brown.unpacked(r.blob, 2)
            for k, m in zip(np.cumsum(key).tolist(), n.tolist()):
                if r.kind == 0:
                    got[divmod(k, 41)] += m
                else:
                    swapped[divmod(k, 41)[::-1]] += m
    assert got == pairs
    assert swapped == {p: n for p, n in pairs.items() if min(p) >= 0}
    assert sum(r.blob is not None for r in found) <= 2 * 2 * 2


def test_a_round_counts_classes_beside_words_in_their_buckets(spark, monkeypatch):
    """No row for a word or a pair and no join: rows follow the buckets, and hold the classes beside every word, in the head or not."""
    monkeypatch.setattr(brown, "HEAD", 40)
    random.seed(6)
    texts = [" ".join(f"w{int(random.paretovariate(0.7)) % 300:0{random.choice((1, 9))}}" for _ in range(80)) for _ in range(120)]
    texts += ["twice twice twice rare1 rare2", "rare2 rare1", "alone", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    seen = collections.Counter(w for t in texts for w in t.split())
    hash_of = dict(zip(seen, words.words_of(pa.array(list(seen))).hash.view(np.int64).tolist()))
    common = [w for w, _ in seen.most_common(40)]
    head = np.sort(np.array([hash_of[w] for w in common], np.int64))
    name = {w: int(np.searchsorted(head, h)) if w in common else int(h | brown.TAIL) for w, h in hash_of.items()}
    band = {name[w]: min((len(w) - 1) // 4, brown.LENGTHS - 1) for w in seen}
    head_class = np.append(np.arange(40) % 7, brown.KINDS - 1)
    cls = {w: int(head_class[w]) if w >= 0 else brown.CLASSES + b for w, b in band.items()} | {40: brown.KINDS - 1}
    width, want, grid = 2 * brown.KINDS + 1, collections.Counter(), np.zeros((brown.KINDS, brown.KINDS))
    for t in texts:
        chain = [40, *(name[w] for w in t.split()), 40]
        for a, b in zip(chain, chain[1:]):
            want[a, cls[b]] += 1
            want[b, brown.KINDS + cls[a]] += 1
            grid[cls[a], cls[b]] += 1
            if a == b:
                want[a, width - 1] += 1

    bigrams = brown.dealt_bigrams(docs, head, 2).cache()
    beside = brown.neighbours(bigrams, head_class, bigrams.filter("words is not null"), 2)
    assert "Join" not in beside._jdf.queryExecution().optimizedPlan().toString()
    rows = beside.collect()
    assert bigrams.count() <= 3 * 4 and len(rows) <= 2 * 4 + 2
    got = collections.Counter()
    for r in rows:
        if r.grid is None:
            key, n = brown.unpacked(r.common or r.rare, 2)
            key = np.cumsum(key)
            names = key // width if r.rare is None else brown.tail_words(r.words)[0][key // width]
            for w, at, m in zip(names.tolist(), (key % width).tolist(), n.tolist()):
                got[w, at] += m
    assert got == want and any(w < 0 and at == width - 1 for w, at in got)
    assert (brown.class_grid(beside) == grid).all()
    assert {(r.word, r.c, r.cls) for r in brown.tail_table(beside).collect()} == {(name[w], n, cls[name[w]]) for w, n in seen.items() if name[w] < 0}

    clustered = np.array([hash_of[w] for w in common[:25]], np.int64)
    symbol = np.append([band[i] for i in range(40)], brown.LENGTHS) + 25
    symbol[np.searchsorted(head, clustered)] = np.arange(25)
    plain = {(r.a, r.b, r.n) for r in brown.symbol_bigrams(docs, clustered).collect()}
    assert {(r.a, r.b, r.n) for r in brown.seed_bigrams(bigrams, symbol, 25).collect()} == plain
    bigrams.unpersist()


def test_best_classes_of_large_counts_agree_with_best_moves():
    """Gains of counts up to ``FEW`` are looked up, those of larger ones computed."""
    rng = np.random.default_rng(11)
    n, kinds = 40, 9
    pair = rng.integers(1, 4 * brown.FEW, (n, n)) * (rng.random((n, n)) < 0.3)
    cls = np.concatenate([rng.integers(0, 6, 30), rng.integers(6, 8, n - 31), [8]])
    hot = np.eye(kinds)[cls]
    after, before, own = pair @ hot, pair.T @ hot, np.diag(pair).astype(float)
    assert ((after > 0) & (after <= brown.FEW)).any() and (after > brown.FEW).any()
    grid = hot.T @ pair @ hot
    target, found = brown.best_classes(after, before, own, cls, grid, 6, brown.few_more(grid, 6))
    assert found[:30] == pytest.approx(brown.best_moves(after, before, own, cls, 30, 6)[1][:30], abs=1e-8)
    for w in range(n - 1):
        moved = cls.copy()
        moved[w] = target[w]
        hot = np.eye(kinds)[moved]
        assert brown.likelihood_of(hot.T @ pair @ hot) - brown.likelihood_of(grid) == pytest.approx(found[w], abs=1e-8)


def test_head_words_are_found_by_their_leading_bits():
    found = words.words_of(pa.array([" ".join(f"w{i}" for i in range(5000))]))
    every = found.hash.view(np.int64)
    for size in (0, 1, 2, 3, 1000, 5000):
        head = np.sort(every[:size])
        want = [int(np.searchsorted(head, h)) if i < size else int(h | brown.TAIL) for i, h in enumerate(every.tolist())]
        assert brown.Head(head).symbols(found).tolist() == want
    for x in (np.zeros(0, np.int64), np.array([0, 255, 256, 1 << 40]), np.array([-1 << 63, 5, -3])):
        assert [y.tolist() for y in brown.unpacked(brown.packed(x, x[::-1]), 2)] == [x.tolist(), x[::-1].tolist()]
