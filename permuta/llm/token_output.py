"""Token-id output: documents compressed one by one against a shared zstandard dictionary.

A dataset is a folder of two tables.  ``dictionary`` holds the zstandard dictionary, trained on
serialized id arrays, with its SHA-256.  ``shards`` holds one row for each run of documents in
ascending order: the dictionary's hash, the documents' ids, the offset index, token counts and the
frames end to end.  A frame is one document's ids as little-endian unsigned 32-bit integers,
compressed alone, so one short document is read by its offset without touching its neighbours.
Both are written and read by Spark's Parquet source, so they live wherever Spark can write.
"""

from __future__ import annotations

import hashlib
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permuta.llm import _text
from permuta.llm._store import arrow_rows

END = 0
#: Documents that the dictionary is trained on, about, and of each so many bytes of ids.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 2000, 4096, 65536
#: Bytes of frames after which a shard row ends.
SHARD_BYTES = 4 << 20
#: Pieces remembered by a worker process, at about 40 bytes each.
CACHE = 1_500_000

_ALL = np.arange(256)
_WHITE = (_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13))
#: First bytes of characters that may be white space outside ASCII.
_WIDE2, _WIDE3 = _ALL == 0xC2, (_ALL >= 0xE1) & (_ALL <= 0xE3)
_EVERY = np.ones(256, bool)

SHARDS = "dict_sha256 string, range int, first_token long, first_doc long, last_doc long, n_docs long, n_tokens long, doc_ids binary, offsets binary, counts binary, frames binary"


def cut_points(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start bytes of the pieces of all texts: text starts, and spaces with no white space beside them.

    Byte-level pre-tokenization begins a new pre-token at such a space whatever else the text holds,
    so the pieces encode alone as they do in the text.
    """
    n = len(data)
    white = _WHITE[data]
    cut = data == 32
    # What stands before: ASCII white space, or the last byte of a character that may be white.
    cut[1:] &= ~white[:-1]
    cut[2:] &= ~_WIDE2[data[:-2]]
    cut[3:] &= ~_WIDE3[data[:-3]]
    cut[:-1] &= ~(white | _WIDE2[data] | _WIDE3[data])[1:]
    starts = off[:-1][off[:-1] < off[1:]]
    last = off[1:][off[:-1] < off[1:]] - 1
    cut[last] = False
    cut[starts] = True
    return np.flatnonzero(cut) if n else np.zeros(0, np.int64)


class Encoder:
    """The library's ids of whole texts; each distinct piece is encoded once and known by its 64-bit hash.

    ``special``: a special token's text has its id, as the library has it unless told otherwise.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self._clear()

    def _clear(self) -> None:
        # Two sorted runs of hashes with the places of their ids; the short one is merged as it grows.
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.ids = np.zeros(1 << 20, "<u4")
        self.used = 0

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted hashes: whether known, and where their ids are."""
        known, at, size = np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for keys, places, sizes in self.runs:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                on = keys[i] == h
                known |= on
                at[on], size[on] = places[i[on]], sizes[i[on]]
        return known, at, size

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        places, sizes = [], []
        for i in range(0, len(pieces), 5000):
            for e in self.tokenizer.encode_batch_fast(pieces[i : i + 5000], add_special_tokens=False):
                x = e.ids
                if self.used + len(x) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(x)), "<u4")])
                self.ids[self.used : self.used + len(x)] = x
                places.append(self.used)
                sizes.append(len(x))
                self.used += len(x)
        new = (h, np.array(places, np.int64), np.array(sizes, np.int64))
        merge = len(self.runs[1][0]) + len(h) > len(self.runs[0][0]) // 8
        into = [self.runs[1], new] + ([self.runs[0]] if merge else [])
        joined = [np.concatenate(x) for x in zip(*into, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        self.runs[0 if merge else 1] = tuple(x[order] for x in joined)
        if merge:
            self.runs[1] = tuple(x[:0] for x in self.runs[1])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the offsets of the texts' ids."""
        if sum(len(keys) for keys, _, _ in self.runs) > CACHE:
            self._clear()
        starts = cut_points(data, off)
        h, first, back = np.unique(_text.word_hashes(data, starts, _EVERY, _ALL), return_index=True, return_inverse=True)
        known, at, size = self._find(h)
        if not known.all():
            raw, ends = data.tobytes(), np.append(starts[1:], len(data))
            new = first[~known]
            self._learn(h[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new], ends[new], strict=True)])
            known, at, size = self._find(h)
        count = size[back]
        text = np.searchsorted(starts, off)
        before = np.concatenate([[0], np.cumsum(count)])
        bounds = before[text] + np.arange(len(off))
        out = np.full(bounds[-1], END, "<u4")
        # Each piece's ids go after those before it and one end id for each text before.
        target = before[:-1] + np.repeat(np.arange(len(off) - 1), np.diff(text))
        shift = np.arange(before[-1]) - np.repeat(before[:-1], count)
        out[np.repeat(target, count) + shift] = self.ids[np.repeat(at[back], count) + shift]
        return out, bounds


def encoder(path: str, special: bool = False) -> Encoder:
    """The process's encoder for a tokenizer file: later tasks of a worker go on with what it knows."""
    kept = sys.modules.setdefault("_permuta_encoders", types.ModuleType("_permuta_encoders")).__dict__
    if (path, special) not in kept:
        kept[path, special] = Encoder(path, special)
    return kept[path, special]


def train_dictionary(docs: DataFrame, tokenizer: str, doc_id: str, text: str, special: bool = False) -> bytes:
    """A dictionary from ``SAMPLE_BYTES`` of ids of about ``SAMPLE_DOCS`` documents, twice as many at most.

    The documents are chosen by a hash of their id and text, and so is the place in a long text that is taken.
    Where they are too few or too short to train on, their ids themselves are the dictionary (raw content);
    it is empty only if there are no ids.  The tokenizer is loaded where the sample is encoded, in one task.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    h = F.xxhash64(doc_id, text)
    # So many characters are taken; their ids are cut to as many bytes below.
    start = F.pmod(F.xxhash64(h), F.greatest(F.length(t) - SAMPLE_BYTES, F.lit(0)) + F.lit(1)) + F.lit(1)
    pick = docs.select(h.alias("h"), F.substring(t, start.cast("int"), F.lit(SAMPLE_BYTES)).alias("t"))
    n = docs.count()
    if n > SAMPLE_DOCS:
        pick = pick.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * SAMPLE_DOCS / n))
    pick = pick.orderBy("h", "t").limit(2 * SAMPLE_DOCS)

    def train(batches):
        texts = [t.encode() for batch in batches for t in batch.column("t").to_pylist()]
        x, at = encoder(tokenizer, special).encode(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        ids = [x[a:b].tobytes()[:SAMPLE_BYTES] for a, b in zip(at[:-1], at[1:], strict=True)]
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, ids).as_bytes()
        except zstandard.ZstdError:
            trained = b"".join(ids)[-DICT_BYTES:]
        yield pa.RecordBatch.from_arrays([pa.array([trained], pa.binary())], ["dictionary"])

    return b"".join(bytes(r["dictionary"]) for r in pick.select("t").coalesce(1).mapInArrow(train, "dictionary binary").collect())


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", level: int = 3, special: bool = False) -> None:
    """Encode every whole text and write the dataset; ``path`` must be in a store that all executors share.

    Documents are in ascending order of ``doc_id``, null first; rows of one id are ordered by text.
    With ``special``, the text of a special token is that token, as in the library's plain ``encode``.
    Null text is empty: its ids are the end id alone.  An empty table writes an empty dictionary and no shard.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dictionary = train_dictionary(d, tokenizer, "doc_id", "text", special)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "dict_sha256 string, dictionary binary").write.parquet(f"{path}/dictionary")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), d.rdd.getNumPartitions())
    d = d.repartitionByRange(ranges, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").withColumn("range", F.spark_partition_id())

    def shards(batches):
        own = encoder(tokenizer, special)
        zstd = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        frames, ids, counts, size, part, before = [], [], [], 0, 0, 0

        def row():
            sizes = np.cumsum([0] + [len(f) for f in frames]).astype("<i8")
            # A null id is kept as the smallest long.
            values = [digest, part, before, ids[0], ids[-1], len(ids), int(sum(counts)), np.array([-(2**63) if i is None else i for i in ids], "<i8").tobytes(), sizes.tobytes(), np.array(counts, "<u4").tobytes(), b"".join(frames)]
            return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, values, strict=True))], SCHEMA)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("range")[0].as_py()
            keys = batch.column("doc_id").to_pylist()
            for a, b, data, off in _text.chunks(*_text.flat(batch.column("text"))):
                x, at = own.encode(data, off)
                for i in range(b - a):
                    frames.append(zstd.compress(x[at[i] : at[i + 1]].tobytes()))
                    ids.append(keys[a + i])
                    counts.append(int(at[i + 1] - at[i]))
                    size += len(frames[-1])
                    if size >= SHARD_BYTES:
                        yield row()
                        before += sum(counts)
                        frames, ids, counts, size = [], [], [], 0
        if ids:
            yield row()

    with arrow_rows(spark, 1000):
        d.mapInArrow(shards, SHARDS).write.parquet(f"{path}/shards")


SCHEMA = pa.schema(
    [("dict_sha256", pa.string()), *[(c, t) for c, t in (("range", pa.int32()), ("first_token", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()))], *[(c, pa.binary()) for c in ("doc_ids", "offsets", "counts", "frames")]]
)


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """The dataset's one dictionary, at most ``DICT_BYTES``; a hash that doesn't fit raises."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["dict_sha256"]:
        raise ValueError(f"the dictionary of {path} doesn't have the hash it was written with")
    return row["dict_sha256"], data


def _decoder(data: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids, binary)."""
    digest, data = _dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards")
    # A running sum over the ranges' totals: one row for each range.
    totals = shards.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    run = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("range", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("base"))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def decode(batches):
        zstd = _decoder(data)
        for batch in batches:
            for s in batch.to_pylist():
                if s["dict_sha256"] != digest:
                    raise ValueError("a shard was written with another dictionary")
                offsets = np.frombuffer(s["offsets"], "<i8")
                docs, counts = np.frombuffer(s["doc_ids"], "<i8"), np.frombuffer(s["counts"], "<u4").astype(np.int64)
                start = s["base"] + s["first_token"] + np.cumsum(counts) - counts
                raw = [zstd.decompress(s["frames"][offsets[i] : offsets[i + 1]]) for i in range(len(docs))]
                if [len(x) // 4 for x in raw] != counts.tolist():
                    raise ValueError("a frame doesn't hold the ids that its shard counts")
                out = [pa.array(docs, mask=docs == -(2**63)), pa.array(start), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(raw, pa.binary())] * ids, names=columns)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    return shards.join(F.broadcast(base), "range").select("dict_sha256", "first_token", "base", "doc_ids", "offsets", "counts", "frames").mapInArrow(decode, kinds)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the rows of one document: only its frames are decompressed."""
    digest, data = _dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id) | F.col("first_doc").isNull())
    found = []
    for s in shards.orderBy("range", "first_token").toLocalIterator():
        offsets = np.frombuffer(s["offsets"], "<i8")
        for i in np.flatnonzero(np.frombuffer(s["doc_ids"], "<i8") == doc_id):
            found.append(np.frombuffer(_decoder(data).decompress(bytes(s["frames"][offsets[i] : offsets[i + 1]])), "<u4").tolist())
    return found
