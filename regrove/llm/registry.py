"""The text queries on the shared tables and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staged
from . import (brown, fill_middle, language, mixing, packing, partenum, personal_data, prefix_trie, quality_bands, ranking, shards, templates,
               token_files)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(fn):
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, zstandard ratios and verdict of every document."""
    return quality_bands.compression_bands(read(spark, folder, "documents"))


@query
def op2_anchor_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data of every document."""
    found = personal_data.personal_spans(read(spark, folder, "documents")).drop("redacted")
    return found.withColumn("base_sha256", personal_data.base_digest()).drop("base_spans")


@query
def op3_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes, by the stored map of 4096 slots.

    The id takes part in the hash, so equal texts may lie in several shards: a group of copies that holds a
    third of all bytes would otherwise fill one slot, and shards of equal bytes could not be had.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = shards.shard_records(docs, ("doc_id", "text_crc32"), "size", 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query
def op4_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Bucket and batch of every piece of every document."""
    return packing.pack(read(spark, folder, "documents"), packing.token_length())


@query
def op7_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    """Size, copies and near-duplicate component of every document."""
    found = partenum.similar_groups(read(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


_ORACLES["op7_partenum_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
      WHERE 100 * c >= 75 * (len(a.sh) + len(b.sh) - c)),
both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = s.doc_id
"""


@query
def op6_template_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, by template windows."""
    found = templates.template_matches(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).cast("long").alias(c) for c in ("n_windows", "matched", "n_slots", "n_changed")])


def _raw_sql(text: str) -> str:
    t = f"coalesce({text}, '')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}},;:] )(\p{{Lu}}\p{{Ll}}+)', '\1' || chr(1) || '\2', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '([0-9])[.,:/]([0-9])', '\1_\2', 'g')"
    return rf"trim(lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}_\x01]+', ' ', 'g')))"


_TEMPLATE_SQL = (r"regexp_replace(regexp_replace(regexp_replace(r, '\x01[\p{L}\p{N}_]+', '#name', 'g'), "
                 r"'(^| )[0-9][\p{L}\p{N}_]*', '\1#num', 'g'), "
                 rf"'(#num )({templates.UNITS})( |$)', '\1#unit\3', 'g')")

_ORACLES["op6_template_windows"] = rf"""
WITH d0 AS (SELECT doc_id, {_raw_sql('text')} AS r FROM documents),
d1 AS (SELECT doc_id, string_split(r, ' ') AS raw, string_split({_TEMPLATE_SQL}, ' ') AS t FROM d0 WHERE r <> ''),
d AS (SELECT doc_id, p, raw[p + 1:p + 8] AS raw, array_to_string(t[p + 1:p + 8], ' ') AS win
      FROM (SELECT *, unnest(range(0, len(t) - 7)) AS p FROM d1)),
b0 AS (SELECT item_id, string_split(r, ' ') AS raw, string_split({_TEMPLATE_SQL}, ' ') AS t
       FROM (SELECT item_id, {_raw_sql('text')} AS r FROM benchmark) WHERE r <> ''),
b1 AS (SELECT item_id, raw, t FROM b0
       QUALIFY row_number() OVER (PARTITION BY t, list_transform(raw, lambda x: list_position(raw, x)) ORDER BY item_id NULLS LAST, raw) = 1),
b AS (SELECT item_id, p, raw[p + 1:p + 8] AS raw, array_to_string(t[p + 1:p + 8], ' ') AS win, count(*) OVER (PARTITION BY item_id) AS n_windows
      FROM (SELECT *, unnest(range(0, len(t) - 7)) AS p FROM b1)
      WHERE len(list_filter(t[p + 1:p + 8], lambda x: x[1] <> '#')) >= 5),
h AS (SELECT doc_id, item_id, d.p - b.p AS shift, b.p AS place, n_windows, d.raw AS dr, b.raw AS br FROM d JOIN b ON d.win = b.win),
z AS (SELECT DISTINCT doc_id, item_id, shift, br[k] AS x, dr[k] AS y
      FROM (SELECT *, unnest(range(1, 9)) AS k FROM h)
      WHERE br[k] <> dr[k] OR regexp_matches(br[k], '^[\x010-9]')),
j AS (SELECT doc_id, item_id, shift, count(*) AS pairs, count(DISTINCT x) AS vals, count(*) FILTER (x <> y) AS changed FROM z GROUP BY ALL),
f AS (SELECT h.doc_id, h.item_id, place, n_windows, coalesce(pairs, 0) AS pairs, coalesce(changed, 0) AS changed
      FROM (SELECT DISTINCT doc_id, item_id, shift, place, n_windows FROM h) h LEFT JOIN j USING (doc_id, item_id, shift)
      WHERE coalesce(pairs, 0) = coalesce(vals, 0))
SELECT doc_id, item_id, CAST(max(n_windows) AS BIGINT) AS n_windows, CAST(count(DISTINCT place) AS BIGINT) AS matched,
       CAST(max(pairs) AS BIGINT) AS n_slots, CAST(min(changed) AS BIGINT) AS n_changed
FROM f GROUP BY doc_id, item_id HAVING count(DISTINCT place) >= 0.5 * max(n_windows)
"""


def fold(key: str = "doc_id", of: int = 1):
    """crc32 of the key as text, modulo ``of``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op9_marginal_unigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from two thirds of them."""
    docs = read(spark, folder, "documents")
    pieces = language.public_pieces(vocabulary_path("piece_bpe_32k.model"))
    model = language.learn(docs.filter(fold(of=3) != 1), "text", "lang", pieces)
    return language.identify(docs, model, pieces).withColumn("held_out", fold(of=3) == 1)


@query
def op8_class_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Class-bigram and smoothed unigram score of every document, learnt from nine tenths of them."""
    docs = read(spark, folder, "documents")
    held_out = fold(of=10) == 0
    model, counts = brown.train(docs.filter(~held_out))
    return brown.score(docs, model, counts).withColumn("held_out", held_out).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


@query
def op10_elias_fano_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Boundaries and checksum of every document's token ids, read back from the written files."""
    docs = read(spark, folder, "documents")
    files = token_files.write_token_files(docs, vocabulary_path("byte_bpe_50k.json"))
    return token_files.read_token_files(files, "doc_id", dict(docs.dtypes)["doc_id"])


@query
def op5_pairwise_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from preference pairs of four fifths of the labels."""
    rows = staged(ranking.featured(read(spark, folder, "documents"), "text", ("doc_id",)), "features")
    marks = (read(spark, folder, "labels").filter("quality is not null").groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    train = rows.filter(fold(of=5) != 0).join(marks, "doc_id")
    model = ranking.fit(staged(train, "labelled"))
    return ranking.score(rows, model).withColumn("held_out", fold(of=5) == 0)


@query
def op11_skip_list_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Form, cuts and digests of every document's fill-in-the-middle output."""
    made = fill_middle.fill_in_middle(read(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(fill_middle.restore().cast("binary"), 256).alias("restored_sha256"))


_ORACLES["op11_skip_list_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x,
             regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || s[8 * k + 1:8 * k + 8] AS BIGINT)) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
             WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE x END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
"""


@query
def op12_centroid_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.conversation_trie(read(spark, folder, "conversations"), openings=True)


_ORACLES["op12_centroid_trie"] = r"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT c FROM o),
digits AS (SELECT c, CAST(c AS VARCHAR) AS s FROM k),
crc AS (WITH RECURSIVE r AS (SELECT c, s, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM digits
          UNION ALL
          SELECT c, s, i + 1, list_reduce(list_prepend(xor(v, CAST(ascii(s[i + 1:i + 1]) AS BIGINT)), range(0, 8)),
            lambda x, z: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT))) FROM r WHERE i < length(s))
        SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 4 AS h FROM r WHERE i = length(s)),
n AS (SELECT c, c - c % 20 AS base, h FROM crc),
t AS (SELECT n.c, 0 AS own, p, role, text FROM n JOIN o ON o.c = n.base AND p <= h
      UNION ALL SELECT n.c, 1, p, role, text FROM n JOIN o ON o.c = n.c AND p > h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, role, text FROM t),
w AS (SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS path FROM d),
l AS (SELECT k.c, count(d) AS turns FROM k LEFT JOIN d USING (c) GROUP BY k.c),
m AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words,
        string_agg(CASE WHEN turns = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM w JOIN l USING (c) GROUP BY path, d
      UNION ALL SELECT [], 0, min(c), count(*), 0, string_agg(CASE WHEN turns = 0 THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) FROM l HAVING count(*) > 0),
f AS (SELECT m.*, (SELECT count(*) FROM m x WHERE x.depth = m.depth + 1 AND x.path[1:m.depth] = m.path) AS n_children FROM m),
s AS (SELECT a.path, a.depth, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved
      FROM f a JOIN f b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path, a.depth)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s ON s.path = f.path AND s.depth = f.depth LEFT JOIN f u ON f.depth > 0 AND u.depth = f.depth - 1 AND u.path = f.path[1:f.depth - 1]
"""


@query
def op13_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document; longer documents are preferred by the square root of their length."""
    docs = read(spark, folder, "documents")
    mixed = mixing.mix_sources(docs, importance=F.sqrt(prefix_trie.word_count()))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "chance")
