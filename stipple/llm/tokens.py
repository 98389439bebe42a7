"""Token ids as length-delimited binary records, with a separate offset index.

A shard is a sequence of records: payload length (u64), masked checksum of those eight bytes (u32), payload, masked
checksum of the payload (u32); all little-endian. The checksum is CRC-32 (as in zlib), masked by a rotation of 15 bits
and a constant, so that checksums of data that holds checksums stay useful. A payload is: document id (i64), flags (u8;
1: the id was null, 2: ids are u32 rather than u16), ids. The index of a shard has one entry of 24 bytes per record:
offset (u64), document id (i64), number of ids (u32), flags (u32); it serves reads in any order.

Shards ascend by document id: documents are range-partitioned and sorted on it, each task writes its own shards under
temporary names and renames them, so a task that runs again replaces its files by equal ones. Shards roll at a size.

Defined cases: texts of any length are encoded whole; a null or empty text has the end id only; a null doc_id sorts first and stays null; rows that share a
doc_id are records of their own, ordered by text; an empty table gives no shard and no row. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, materialize, n_partitions, scratch_dir, table

HEAD, CRC, META, ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB"), struct.Struct("<QqII")
NULL_ID, WIDE = 1, 2
SHARD_BYTES = 256 << 20
#: Pieces kept in a worker's cache before the older half goes.
CACHE_PIECES = 500_000


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


class PieceCache(dict):
    """Ids of pieces without white space, as bytes. Two generations bound the memory.

    The tokenizer drops white space before anything else, so a text's ids are those of its pieces in a row. Pieces of
    letters only go straight to the model, byte by byte as its byte-level step maps them; all others take the whole path.
    """

    PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, tokenizer, dtype: str, limit: int = CACHE_PIECES):
        self.tokenizer, self.model, self.dtype, self.limit, self.old = tokenizer, tokenizer.model, dtype, limit, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = self.encode(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, piece: str) -> bytes:
        low = piece.lower()
        if low.isalpha() and "Σ" not in piece:
            if not low.isascii():
                low = unicodedata.normalize("NFC", low)
                if not low.isalpha() or len(low) > 64:
                    return self.whole(piece)
                low = "".join(map(self.byte_chars.__getitem__, low.encode()))
            return np.array([t.id for t in self.model.tokenize(low)], self.dtype).tobytes()
        letters = piece.rstrip(self.PUNCTUATION)
        # the marks after a word are one piece to the tokenizer, if the word ends in a letter for it too
        if letters != piece and letters.isalpha() and unicodedata.normalize("NFC", letters).lower().isalpha():
            return self[letters] + self[piece[len(letters) :]]
        return self.whole(piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    #: White space to str.split() but not to the tokenizer.
    SEPARATORS = "\x1c\x1d\x1e\x1f"

    def text(self, text: str) -> bytes:
        if any(c in text for c in self.SEPARATORS):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_caches: dict[bytes, PieceCache] = {}


def piece_cache(data: bytes, dtype: str) -> PieceCache:
    """The worker's cache for a tokenizer file; it outlives a task, so the next one needn't learn its pieces again."""
    key = hashlib.sha256(data).digest() + dtype.encode()
    if key not in _caches:
        from tokenizers import Tokenizer

        _caches.clear()
        _caches[key] = PieceCache(Tokenizer.from_buffer(data), dtype)
    return _caches[key]


def lower_case_words(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind that PieceCache splits: white space dropped, letters lower-cased."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [x["type"] for x in normal.get("normalizers", [normal])]
    return kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and "\\s" in str(pre)


class ShardWriter:
    """Writes records to shards of bounded size; ``rows`` describes the finished ones."""

    def __init__(self, uri: str, task: int, attempt: int):
        self.fs, self.dir = filesystem(uri)
        self.task, self.attempt, self.part, self.out = task, attempt, 0, None
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes, wide: bool) -> None:
        if self.out is None:
            self.name = f"{self.task:07d}-{self.part:04d}"
            self.temp = f"{self.dir}/.{self.name}.{self.attempt}"
            self.out, self.at, self.n_tokens, self.index = self.fs.open_output_stream(self.temp + ".rec", buffer_size=1 << 20), 0, 0, []
        flags = NULL_ID * (doc_id is None) | WIDE * wide
        payload = META.pack(doc_id or 0, flags) + ids
        head = HEAD.pack(len(payload))
        self.out.write(b"".join((head, CRC.pack(masked_crc(head)), payload, CRC.pack(masked_crc(payload)))))
        n = len(ids) // (4 if wide else 2)
        self.index.append(ENTRY.pack(self.at, doc_id or 0, n, flags))
        self.at += len(payload) + 16
        self.n_tokens += n
        if self.at >= SHARD_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(self.temp + ".idx") as f:
            f.write(b"".join(self.index))
        for kind in (".rec", ".idx"):
            self.fs.move(self.temp + kind, f"{self.dir}/{self.name}{kind}")
        self.rows.append((self.name, len(self.index), self.n_tokens, self.at))
        self.part, self.out = self.part + 1, None


def write_shards(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shards under ``uri``. The manifest: shard, n_docs, n_tokens, n_bytes, start."""
    import json

    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    spec = json.loads(data)
    pieces = lower_case_words(spec)
    wide = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id]) > 0xFFFF
    model = spark.sparkContext.broadcast(data)
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        cache = piece_cache(model.value, "<u4" if wide else "<u2")
        encode = cache.text if pieces else cache.whole
        end = np.array([end_id], cache.dtype).tobytes()
        out = ShardWriter(uri, context.partitionId(), context.taskAttemptId())
        for batch in batches:
            texts = batch.column("text")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = texts[i].as_py()
                out.add(doc_id, (encode(text) if text else b"") + end, wide)
        out.close()
        if out.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out.rows)], ["shard", "n_docs", "n_tokens", "n_bytes"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions or n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(write, "shard string, n_docs long, n_tokens long, n_bytes long"), "shard-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def framed_bytes(ids_bytes: int) -> int:
    """Length of a record with so many bytes of ids."""
    return ids_bytes + META.size + 16


def records(f, offset: int, end: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of the records up to ``end`` of a shard that is open at ``offset``; raises on a wrong checksum."""
    while offset < end:
        head = f.read(12)
        (n,) = HEAD.unpack(head[:8])
        if CRC.unpack(head[8:])[0] != masked_crc(head[:8]):
            raise ValueError(f"damaged length at {offset}")
        body = f.read(n + 4)
        payload = body[:n]
        if len(body) != n + 4 or CRC.unpack(body[n:])[0] != masked_crc(payload):
            raise ValueError(f"damaged record at {offset}")
        doc_id, flags = META.unpack_from(payload)
        yield None if flags & NULL_ID else doc_id, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=META.size)
        offset += n + 16


def read_index(uri: str, shard: str) -> np.ndarray:
    fs, path = filesystem(uri)
    with fs.open_input_stream(f"{path}/{shard}.idx") as f:
        return np.frombuffer(f.read(), np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("n_tokens", "<u4"), ("flags", "<u4")]))


def read_shuffled(uri: str, shard: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a shard in an order drawn from ``seed``, each found by the index."""
    index = read_index(uri, shard)
    fs, path = filesystem(uri)
    with fs.open_input_file(f"{path}/{shard}.rec") as f:
        for i in np.random.default_rng(seed).permutation(len(index)):
            at = int(index["offset"][i])
            f.seek(at)
            yield next(records(f, at, at + 1))


def read_shards(manifest: DataFrame, uri: str, partitions: int | None = None) -> DataFrame:
    """One row per record, read from the shards: doc_id, start, n_tokens, ids_crc32, shard, offset."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(uri)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{path}/{row['shard']}.rec", buffer_size=1 << 20) as f:
                    start, at, rows = row["start"], 0, []
                    for doc_id, ids in records(f, 0, row["n_bytes"]):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"], at))
                        start += len(ids)
                        at += framed_bytes(ids.nbytes)
                        if len(rows) == 8192:
                            yield as_batch(rows)
                            rows = []
                    if rows:
                        yield as_batch(rows)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.string()), ("offset", pa.int64())])
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    spread = manifest.select("shard", "start", "n_bytes").repartition(partitions or n_partitions(manifest.sparkSession), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, offset long")


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None, uri: str | None = None) -> DataFrame:
    """Writes ``docs`` as token shards and returns what the shards hold, one row per document."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    uri = uri or scratch_dir(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, uri, tokenizer_path), uri)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
