"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Every stage works on all rows the one before it kept.  Rows with null keys, repeated rows, empty
texts and extra columns pass like others; what each stage decides about them is in its docstring.
No stage can be written in SQL as a whole (the first learns a model), so there is no ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regrove.llm import language, packing, partenum, personal_data, templates
from regrove.llm.words import small_batches
from regrove.session import staged

LEAST_CONFIDENCE = 0.5
VOCABULARY = "piece_bpe_32k.model"


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns under neutral names, so that none can clash with an operator's own."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _few_rows_a_batch(spark: SparkSession) -> None:
    """Small Arrow batches for the rest of the session: stages that pass whole texts through Python are written after they return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language is recognised.

    Rejected: null texts, texts without a letter, and texts whose best language has a posterior under
    ``LEAST_CONFIDENCE``.  If no row names a language, nothing can be recognised and nothing is kept.
    """
    import public_tokenizers
    pieces = language.public_pieces(public_tokenizers.path(VOCABULARY))
    rows, at = _plain(docs)
    with small_batches(spark, 10_000):      # learning passes single words
        model = language.learn(rows, at["text"], at["lang"], pieces, at["doc_id"])
    _few_rows_a_batch(spark)
    found = language.identify(rows, model, pieces, at["text"], tuple(at.values()))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CONFIDENCE)).select(
        *[F.col(v).alias(k) for k, v in at.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the least id, then the least hash of the text.

    Of equal rows one stays.  Null ids come after others.  Texts without a word belong to no group and stay.
    """
    rows, at = _plain(docs)
    key, text = at["doc_id"], at["text"]
    hashed = rows.withColumn("h", F.xxhash64(text))
    groups = staged(partenum.similar_groups(hashed, text, key, ("h",)).filter("group is not null").select(
        F.col(key).alias("k"), "h", "group"), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("k").isNull().alias("n"), F.col("k"), F.col("h"))).alias("s"))
    best = groups.alias("g").join(first.alias("f"), "group").withColumn(
        "stays", F.col("g.k").eqNullSafe(F.col("f.s.k")) & (F.col("g.h") == F.col("f.s.h")))
    verdict = best.groupBy(F.col("g.k").alias("k"), F.col("g.h").alias("h")).agg(
        F.max("stays").alias("stays"), F.count(F.lit(1)).alias("copies")).filter("not stays or copies > 1")
    verdict = staged(verdict, "verdict")
    # Only texts that may have a verdict are shuffled to meet it; most rows stay where they are.
    named = partenum.may_be_among(verdict.select(F.col("h").alias("cls")))
    met = rows.filter(named(F.xxhash64(text)))
    same = lambda v: met[key].eqNullSafe(v["k"]) & (F.xxhash64(met[text]) == v["h"])
    kept = rows.filter(~named(F.xxhash64(text))).union(met.join(verdict, same(verdict), "left_anti"))
    repeated = verdict.filter("stays")
    if not repeated.isEmpty():
        one = met.join(repeated, same(repeated), "left_semi").withColumn("h", F.xxhash64(text)).dropDuplicates([key, "h"])
        kept = kept.union(one.drop("h"))
    return kept.toDF(*at.keys())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a benchmark item, also with other numbers, names or units."""
    rows, at = _plain(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = staged(templates.template_matches(rows, benchmark, at["doc_id"], at["text"]), "matches")
    return templates.without_matches(rows, found, at["doc_id"], at["text"]).toDF(*at.keys())


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by placeholders; ``n_chars`` follows the new text.  No row is dropped."""
    rows, at = _plain(docs)
    kinds = dict(docs.dtypes)
    rest = tuple(v for k, v in at.items() if k != "text")
    clean = personal_data.personal_spans(rows, at["text"], rest, redacted=True)
    columns = {"text": F.col("redacted"), "n_chars": F.length(F.coalesce("redacted", F.lit(""))).cast(kinds.get("n_chars", "long"))}
    _few_rows_a_batch(spark)
    return clean.select(*[columns.get(k, F.col(v)).alias(k) for k, v in at.items()])


def pack_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, padded length and batch of every piece of every document."""
    return packing.pack(docs, packing.token_length())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack_buckets),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
