"""Compression bands, personal data, virtual slots and length buckets against plain rules."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from regrove.llm import packing, personal_data, quality_bands, registry, shards

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def plain_counts(t):
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_base_counts(spark):
    texts = docs_of(spark)
    for r in registry.queries()["op1_compression_bands"](spark, FOLDER).collect():
        want = plain_counts(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.verdict == "fits")


def test_bands_tell_repetition_and_noise_from_prose():
    press = quality_bands.Press(quality_bands.Bands())
    random.seed(3)
    words = ["".join(random.choices("etaoinshrdlu", k=random.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(random.choices(words, k=1500)).encode()
    assert press.judge(prose)[-1] == "fits"
    assert press.judge(b"all work and no play " * 400)[-1] == "repetitive"
    assert press.judge(random.randbytes(9000))[-1] == "incompressible"
    assert press.judge(prose[:8192] + b"spam and eggs " * 900)[-1] in ("repetitive", "uneven")
    assert press.judge(b"")[-1] == "empty"


def test_bands_on_odd_rows(odd_docs, no_docs):
    got = quality_bands.compression_bands(odd_docs).collect()
    assert len(got) == odd_docs.count()
    null = [r for r in got if r.doc_id == 4]
    assert null[0].n_words == 0 and null[0].base_failed and not null[0].kept and null[0].ratio is None
    assert quality_bands.compression_bands(no_docs).count() == 0


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def base_only(spans):
    return [s for s in spans if s[1] < 4]


def test_spans_equal_the_patterns():
    tree = personal_data.automaton()
    random.seed(5)
    texts = ["a@b.c@d.e f@g", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (2) 345-67.89 +", "é@x.de 256.1.1.1", "0001.2.3.4"]
    for _ in range(20000):
        texts.append("".join(random.choices(["1", "4", "0", "9", " ", "-", ".", "@", "+", "a", "(", ")", "é", "255.", "4111111111111111", "x.y"],
                                            k=random.randint(0, 18))))
    for t in texts:
        assert base_only(personal_data.find_spans(t, tree)) == plain_spans(t), t


def test_spans_of_documents(spark):
    texts = docs_of(spark)
    tree = personal_data.automaton()
    for t in texts.values():
        assert base_only(personal_data.find_spans(t or "", tree)) == plain_spans(t or "")


def test_added_kinds_and_redaction():
    tree = personal_data.automaton()
    t = 'mail a.b@c.org, see https://x.org/p?q=1. token = "04dbebab91ab85687d33" iban DE89 3704 0044 0532 0130 00 account no: 12345678'
    spans = personal_data.find_spans(t, tree)
    assert [(personal_data.KINDS[k], t[s:e]) for s, k, e in spans if k > 3] == [
        ("url", "https://x.org/p?q=1"), ("secret", "04dbebab91ab85687d33"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]
    clean = personal_data.redact(t, spans)
    assert "a.b@c.org" not in clean and "04dbeb" not in clean and clean.count("<ACCOUNT>") == 2


def test_spans_on_odd_rows(odd_docs, no_docs):
    got = personal_data.personal_spans(odd_docs, redacted=True).collect()
    assert len(got) == odd_docs.count() and all(r.redacted is None for r in got if r.doc_id == 4)
    assert personal_data.personal_spans(no_docs).count() == 0


def test_shards_are_even_and_gapless(spark):
    rows = registry.queries()["op3_virtual_slots"](spark, FOLDER).collect()
    texts = docs_of(spark)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load, places = Counter(), defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(load) == set(range(16))
    assert max(load.values()) - min(load.values()) < 0.1 * sum(load.values()) / 16


def test_rebalance_edits_little_and_serves_a_grown_count():
    rng = np.random.default_rng(1)
    weight = rng.integers(0, 1000, 4096)
    weight[7] = 20_000
    first = shards.first_map(4096, 16)
    second = shards.rebalance(first, weight, 16)
    load = np.bincount(second, weights=weight)
    assert load.max() - load.min() <= 4 and (first != second).mean() < 0.05
    grown = shards.rebalance(second, weight, 17)
    assert np.bincount(grown, weights=weight).std() < 50


def test_map_versions(spark):
    a = np.array([0, 1, 0, 1])
    b = np.array([0, 1, 1, 1])
    table = shards.map_table(spark, [a, b])
    assert table.filter("version = 2").count() == 1
    assert {r[0]: r.shard for r in shards.owners(table, 1).collect()} == dict(enumerate(a.tolist()))
    assert {r[0]: r.shard for r in shards.owners(table, 2).collect()} == dict(enumerate(b.tolist()))


def test_shards_on_odd_rows(odd_docs, no_docs):
    docs = odd_docs.select("doc_id", F.lit(5).cast("long").alias("size"), "text")
    got = shards.shard_records(docs, ("doc_id", "text"), "size", 4).collect()
    assert len(got) == odd_docs.count()
    assert shards.shard_records(docs.limit(0), ("doc_id", "text"), "size", 4).count() == 0


def test_shards_replace_clashing_columns(odd_docs):
    docs = odd_docs.withColumn("size", F.when(F.col("doc_id") > 4, 5).cast("long")).withColumn("Virtual_Slot", F.lit("x"))
    got = shards.shard_records(docs, ("doc_id", "text"), "size", 4)
    assert [c.lower() for c in got.columns].count("shard") == 1 and dict(got.dtypes)["virtual_slot"] == "int"
    assert got.select("shard", "slot", "virtual_slot").distinct().count() > 1 and got.count() == odd_docs.count()
    with pytest.raises(ValueError):
        shards.shard_records(odd_docs, ("shard",), "n_chars", 4)


def test_stored_map_is_loaded_and_edited(spark, tmp_path):
    path, rng = str(tmp_path / "map"), np.random.default_rng(5)
    weight = rng.integers(1, 1000, 64)
    first = shards.first_map(64, 4)
    shards.save_version(spark, path, first)
    version, owner = shards.rebalance_stored(spark, path, weight, 4)
    assert version == 2 and (owner == shards.rebalance(first, weight, 4)).all()
    again = shards.rebalance_stored(spark, path, weight, 4)
    assert again[0] == 2 and (again[1] == owner).all()             # nothing to edit: no new version
    grown, wider = shards.rebalance_stored(spark, path, weight, 5)
    assert grown == 3 and (shards.latest(shards.load_map(spark, path), 64)[1] == wider).all() and wider.max() == 4
    assert shards.load_map(spark, path).filter("version = 3").count() == (wider != owner).sum() < 64
    with pytest.raises(ValueError):
        shards.rebalance_stored(spark, path, weight, 4)
    with pytest.raises(ValueError):
        shards.latest(shards.load_map(spark, path), 65)


def cost(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(12))
def test_buckets_are_optimal(seed):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.choice(60, rng.integers(1, 9), replace=False) + 1)
    c = rng.integers(1, 50, len(x))
    for k in (1, 2, 3, 5):
        best = min(cost(x, c, {*chosen, x[-1]}) for n in range(k) for chosen in itertools.combinations(x, n))
        got = packing.optimal_buckets(x, c, k)
        assert len(got) <= k and cost(x, c, got) == best


def test_packing_of_documents(spark):
    rows = registry.queries()["op4_length_buckets"](spark, FOLDER).collect()
    words = {i: len(WORD.findall(t or "")) + 1 for i, t in docs_of(spark).items()}
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
        assert r.length <= r.padded and r.start == r.piece * 4096
    assert total == words
    edges = {r.bucket: r.padded for r in rows}
    assert all(r.bucket == 0 or edges[r.bucket - 1] < r.length for r in rows if r.bucket - 1 in edges)
    batches = Counter((r.bucket, r.batch) for r in rows)
    for b, edge in edges.items():
        sizes = [batches[b, i] for i in range(sum(k[0] == b for k in batches))]
        room = max(1, 65536 // edge)
        assert all(s == room for s in sizes[:-1]) and 0 < sizes[-1] <= room


def test_packing_of_odd_rows(odd_docs, no_docs):
    got = packing.pack(odd_docs, packing.token_length(), window=64, budget=256).collect()
    assert sum(r.length for r in got if r.doc_id == 4) == 1 and max(r.length for r in got) == 64
    assert packing.pack(no_docs, packing.token_length()).count() == 0
