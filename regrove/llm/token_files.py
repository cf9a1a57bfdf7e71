"""Token ids in binary files: concatenated ids, and document boundaries as an Elias-Fano code.

Texts are encoded with a public tokenizer and written in ascending key order.  File ``part-N.ids``
holds the ids of a key range as little-endian integers (16 bits where the vocabulary allows),
``part-N.ef`` the end of every document among them, and ``part-N.keys`` the keys (Arrow).  Files lie
in the folder that all machines share and are written under a name of the attempt before they get
theirs, so a task that runs twice leaves whole files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder
from .elias_fano import EliasFano, encode
from .words import worker_memo

END_ID = 2
REMEMBERED = 1_000_000      # pieces of text whose ids a worker remembers
TOGETHER = 512              # texts whose unknown pieces are encoded at once
JOINED = 512                # unknown pieces that are encoded as one text
SPACE = "\u0120"            # how byte-level vocabularies spell a space
FILE_BYTES = 128 << 20      # ids of one file, about
EVERY = 128                 # one row of so many is sampled, from which the key ranges are drawn
SAMPLED = 100               # but so many for each of the least number of files
SAMPLED_ALL = 1_000_000     # and so many of all rows at most
TOKEN_BYTES = 4             # bytes of text that make a token, about
GROUPED = 32                # ends of key ranges that are compared together
#: Characters that no tokenizer takes for white space.
INK = "!-~¡-ᙿ"
STARTS_INKED = re.compile(f"[{INK}]")
APART = re.compile(f"(?<=[{INK}]) | (?=[{INK}])")


class Encoder:
    """Ids of whole texts, the library's work remembered for pieces that recur.

    Byte-level BPE first cuts a text into words that take one space in front.  A single space beside an
    inked character therefore always starts a new word, and a text may be cut there without any change of
    ids.  Other kinds of tokenizers, and texts that spell a special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        self.tool = Tokenizer.from_file(path)
        plan = json.loads(self.tool.to_str())
        cut = plan.get("pre_tokenizer") or {}
        self.by_pieces = (plan["model"]["type"] == "BPE" and plan.get("normalizer") is None and cut.get("type") == "ByteLevel"
                          and not cut.get("add_prefix_space") and cut.get("use_regex", True))
        special = [t["content"] for t in plan.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kind = np.dtype("<u2" if self.tool.get_vocab_size() <= 1 << 16 else "<u4")
        names = self.tool.get_vocab()
        self.spaced = np.zeros(max(names.values(), default=0) + 1, bool)         # ids whose token starts with a space
        self.spaced[[i for name, i in names.items() if name.startswith(SPACE)]] = True
        self.joins = not any(" " in t for t in special)
        self.known: dict[str, bytes] = {}       # pieces behind a space
        self.odd: dict[str, bytes] = {}         # pieces as they are

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def behind_space(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that each follow a space and hold none: many make one text, cut where a token starts with a space."""
        out = []
        for i in range(0, len(pieces), JOINED):
            part = pieces[i:i + JOINED]
            ids = np.array(self.tool.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            start = np.flatnonzero(self.spaced[ids])
            if len(start) != len(part) or not self.joins:
                out += self.raw([" " + p for p in part])
                continue
            data, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
            cut = [*(start * size).tolist(), len(data)]
            out += [data[a:b] for a, b in zip(cut[:-1], cut[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) + len(self.odd) > REMEMBERED:
            self.known.clear()
            self.odd.clear()
        plans, fresh, odd = [], set(), set()
        for text in texts:
            if not self.by_pieces or self.special is not None and self.special.search(text):
                plans.append(None)
                continue
            first, *rest = text.split(" ")
            got = list(map(self.known.get, rest))
            missing = {p for p, ids in zip(rest, got) if ids is None} if None in got else ()
            if all(map(STARTS_INKED.match, missing)):
                fresh.update(missing)
                odd.add(first)
                plans.append((first, rest, got, bool(missing)))
            else:       # white space on both sides of a space somewhere
                first, *rest = APART.split(text)
                parts = [first, *(" " + p for p in rest)]
                odd.update(parts)
                plans.append(parts)
        for table, new, ids_of in ((self.known, list(fresh), self.behind_space), (self.odd, list(odd - self.odd.keys()), self.raw)):
            if new:
                table.update(zip(new, ids_of(new)))
        whole = iter(self.raw([t for t, p in zip(texts, plans) if p is None]))
        known, out = self.known, []
        for p in plans:
            if p is None:
                out.append(next(whole))
            elif isinstance(p, list):
                out.append(b"".join(map(self.odd.__getitem__, p)))
            else:
                first, rest, got, lacks = p
                if lacks:       # few pieces are looked up again
                    got = [known[piece] if ids is None else ids for piece, ids in zip(rest, got)]
                out.append(self.odd[first] + b"".join(got))
        return out


def encoder(path: str) -> Encoder:
    memo = worker_memo("encoders")
    if path not in memo:
        memo.clear()
        memo[path] = Encoder(path)
    return memo[path]


def packed(ids: list[bytes]) -> list[bytes]:
    """Ids of documents, compressed one by one: neither the staged table nor the shuffle holds them plain."""
    import zstandard
    return list(map(zstandard.ZstdCompressor(level=1).compress, ids))


def _open(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def key_ranges(docs: DataFrame, text: str, key: str, tie: Column, file_bytes: int, width: int, least: int) -> tuple[DataFrame, int]:
    """Ranges of (``key``, ``tie``) that hold about as many bytes of text each: a row with their ends, ``GROUPED`` at a time, and their number.

    There is one for every ``file_bytes`` of ids, as far as the bytes of sampled texts tell, and ``least`` at least.
    The sample only decides how even files are; it is read in one scan, and every row gets its range.
    """
    spark = docs.sparkSession
    rows = docs.count()
    share = min(1.0, min(max(SAMPLED * least, rows // EVERY), SAMPLED_ALL) / max(rows, 1))
    some = docs.sample(share, seed=7) if share < 1 else docs
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    light = some.select(F.col(key).alias("key"), tie.alias("tie"), size.alias("size"))
    drawn = (light.groupBy("key", "tie").agg(F.sum("size").alias("size"))
             .orderBy(F.col("key").asc_nulls_first(), "tie").collect())         # at most SAMPLED_ALL rows, about
    total = int(sum(r["size"] for r in drawn) / share)
    parts = max(-(-total * width // (TOKEN_BYTES * file_bytes)), least)
    filled = np.cumsum([r["size"] for r in drawn])
    at = np.unique(np.searchsorted(filled, filled[-1] * np.arange(1, parts) / parts)) if drawn else []
    ends = [(drawn[i]["key"], drawn[i]["tie"]) for i in at]
    kind = dict(light.dtypes)["key"]
    return spark.createDataFrame([([ends[i:i + GROUPED] for i in range(0, len(ends), GROUPED)],)],
                                 f"__groups array<array<struct<key: {kind}, tie: bigint>>>"), parts


def range_of(key: Column, tie: Column) -> Column:
    """Number of the range of a row: how many ends lie before it."""
    own = F.struct(key.alias("key"), tie.alias("tie"))
    group = F.size(F.filter("__groups", lambda g: g[0] < own))
    inside = F.size(F.filter(F.get("__groups", group - 1), lambda e: e < own))
    return F.when(group > 0, (group - 1) * GROUPED + inside).otherwise(0)


def encoded(docs: DataFrame, tokenizer: str, text: str, key: str, end_id: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``ids`` (packed, with the end), ``width``, the bytes of one id, ``size``, those of all, and the columns ``keep``."""
    kinds = dict(docs.select(key, *keep).dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        end = np.array([end_id], tool.kind).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                ids = [x + end for x in tool.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed(ids), pa.binary()), pa.array([tool.kind.itemsize] * len(ids), pa.int32()),
                                                  pa.array(list(map(len, ids)), pa.int64()), *part.columns[2:]], ["key", "ids", "width", "size", *keep])

    return docs.select(F.col(key).alias("key"), text, *keep).mapInArrow(
        scan, f"key {kinds[key]}, ids binary, width int, size long" + "".join(f", `{c}` {kinds[c]}" for c in keep))


def write_token_files(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", folder: str | None = None,
                      end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode and write all texts; one row per file with its number of documents and ids, in key order.

    A null text is empty; every document ends with ``end_id``.  Null keys come first; equal keys are
    in the order of their texts' hashes, so a key with very many rows spreads over files; equal rows keep
    one file.  The number of files follows the bytes of ids, as estimated from those of the texts.  Long texts are written as they are encoded, whole.
    Other columns are not read, whatever their names.  An empty table gives no file.  ``folder`` defaults to a
    new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    # Ranges are drawn from keys and hashes, so texts are encoded once, on their way into the shuffle, and only packed ids are in it.
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    ranges, parts = key_ranges(docs, "text", "key", tie, file_bytes, encoder(tokenizer).kind.itemsize, 2 * spark.sparkContext.defaultParallelism)
    placed = docs.crossJoin(F.broadcast(ranges)).select("key", "text", tie.alias("tie"), range_of(F.col("key"), tie).alias("range"))
    ids = encoded(placed, tokenizer, "text", "key", end_id, ("tie", "range"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpacker = zstandard.ZstdDecompressor()
        context = TaskContext.get()
        store, base = _open(folder)
        part, attempt = context.partitionId(), context.taskAttemptId()
        name, trial = f"{base}/part-{part:05d}", f"{base}/_try-{attempt}-{part:05d}"
        counts, out, keys, width = [], None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                width = batch.column(2)[0].as_py()
                out, key_file = store.open_output_stream(f"{trial}.ids"), store.open_output_stream(f"{trial}.keys")
                keys = pa.ipc.new_file(key_file, pa.schema([("key", batch.column(0).type)]))
            keys.write_batch(pa.RecordBatch.from_arrays([batch.column(0)], ["key"]))
            for x in batch.column(1):
                out.write(unpacker.decompress(x.as_py()))
            counts.append(batch.column(3).to_numpy() // width)
        if out is None:
            return
        for file in (out, keys, key_file):
            file.close()
        ends = np.cumsum(np.concatenate(counts).astype(np.int64))
        with store.open_output_stream(f"{trial}.ef") as out:
            out.write(encode(ends, int(ends[-1])))
        for kind in ("ids", "ef", "keys"):
            store.move(f"{trial}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([part]), pa.array([len(ends)]), pa.array([int(ends[-1])]),
                                          pa.array([width])], ["folder", "part", "n_docs", "n_ids", "width"])

    ordered = ids.repartitionById(parts, F.col("range")).sortWithinPartitions(F.col("key").asc_nulls_first(), "tie")
    written = ordered.mapInArrow(write, "folder string, part long, n_docs long, n_ids long, width long").toArrow().to_pylist()
    return _parts(spark, sorted(written, key=lambda r: r["part"]))


def _parts(spark: SparkSession, files: list[dict]) -> DataFrame:
    start = 0
    rows = []
    for f in files:         # one row per file
        rows.append((f["folder"], f["part"], f["n_docs"], f["n_ids"], f["width"], start))
        start += f["n_ids"]
    frame = spark.createDataFrame(rows, "folder string, part long, n_docs long, n_ids long, width long, start long")
    return frame.repartition(max(len(rows), 1))


def read_token_files(files: DataFrame, key: str = "doc_id", key_type: str = "long") -> DataFrame:
    """Documents of the files: key, start among all ids, ``n_tokens``, ``ids_crc32`` of the ids as 32-bit integers."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                store, base = _open(f["folder"])
                name = f"{base}/part-{f['part']:05d}"
                with store.open_input_file(f"{name}.ef") as src:
                    bounds = EliasFano(src.read())
                first, begin = 0, 0
                with store.open_input_file(f"{name}.ids") as src, store.open_input_file(f"{name}.keys") as key_src:
                    keys = pa.ipc.open_file(key_src)
                    for k in range(keys.num_record_batches):
                        key_part = keys.get_batch(k).column(0)
                        ends = bounds.block(first, len(key_part))
                        begins = np.concatenate([[begin], ends[:-1]])
                        crc = np.empty(len(ends), np.int64)
                        for i, n in enumerate((ends - begins).tolist()):
                            ids = np.frombuffer(src.read(n * f["width"]), f"<u{f['width']}")
                            crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
                        yield pa.RecordBatch.from_arrays([key_part, pa.array(begins + f["start"]), pa.array(ends - begins), pa.array(crc)],
                                                         [key, "start", "n_tokens", "ids_crc32"])
                        first, begin = first + len(ends), int(ends[-1])

    return files.mapInArrow(read, f"`{key}` {key_type}, start long, n_tokens long, ids_crc32 long")
