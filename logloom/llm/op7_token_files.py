"""Token ids as bit-plane shuffled, zstandard compressed files with a chunk index.

File image, integers little-endian:

    magic "PLN1" | u32 planes (4: byte planes, 32: bit planes) | u32 ids a chunk
    u32 documents | u64 ids | u32 chunks | u64 bytes of the document table
    document table, one zstandard frame: i64 document ids, u8 whether null, u64 numbers of ids
    chunk index: for each chunk, u64 offset and one u32 compressed length a plane
    the planes' frames, chunk by chunk

A chunk holds a fixed number of ids (the last one fewer). Byte plane p is byte p of each
id; bit plane p is bit p of each id, packed. A plane of zeros has length 0 and no frame.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, shared_dir, utf8
from .pieces import Pieces

MAGIC = b"PLN1"
HEAD = struct.Struct("<4sIIIQIQ")
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CHUNK_IDS = 65_536
#: A file ends after the document that brings it to so many ids.
FILE_IDS = 1 << 20
#: Bytes of rows that are encoded together: the more, the more pieces are found again.
GATHERED = 16 << 20
#: Pieces that are joined for one call of the library.
JOINED = 1_024


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [octets[:, p].tobytes() for p in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, p]).tobytes() for p in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        octets = np.stack([np.frombuffer(x, np.uint8) if x else np.zeros(n, np.uint8) for x in parts], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n) if x else np.zeros(n, np.uint8) for x in parts], 1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


def write_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, planes: int = 4, chunk: int = CHUNK_IDS, level: int = 3) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=level).compress
    docs = squeeze(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes() + np.array(lengths, "<u8").tobytes())
    starts = range(0, len(ids), chunk)
    frames = [[squeeze(p) if p.strip(b"\0") else b"" for p in to_planes(ids[i : i + chunk], planes)] for i in starts]
    at = HEAD.size + len(docs) + len(frames) * (8 + 4 * planes)
    index = b""
    for f in frames:
        index += struct.pack(f"<Q{planes}I", at, *map(len, f))
        at += sum(map(len, f))
    return b"".join([HEAD.pack(MAGIC, planes, chunk, len(doc_ids), len(ids), len(frames), len(docs)), docs, index, *[p for f in frames for p in f]])


class Image:
    """A file image; ``ids(i, j)`` opens only the chunks that hold those ids."""

    def __init__(self, image: bytes):
        magic, self.planes, self.chunk, n, self.n_ids, self.chunks, size = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.image = memoryview(image)
        docs = zstandard.ZstdDecompressor().decompress(self.image[HEAD.size : HEAD.size + size])
        nulls = docs[8 * n : 9 * n]
        self.doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(docs, "<i8", n), nulls, strict=True)]
        self.lengths = np.frombuffer(docs, "<u8", n, 9 * n).astype(np.int64)
        self.index_at = HEAD.size + size

    def read_chunk(self, k: int) -> np.ndarray:
        at, *sizes = struct.unpack_from(f"<Q{self.planes}I", self.image, self.index_at + k * (8 + 4 * self.planes))
        n, parts, expand = min(self.chunk, self.n_ids - k * self.chunk), [], zstandard.ZstdDecompressor().decompress
        for size in sizes:
            parts.append(expand(self.image[at : at + size]) if size else b"")
            at += size
        return from_planes(parts, n)

    def ids(self, i: int = 0, j: int | None = None) -> np.ndarray:
        j = self.n_ids if j is None else j
        if i >= j:
            return np.empty(0, "<u4")
        first = i // self.chunk
        got = np.concatenate([self.read_chunk(k) for k in range(first, -(-j // self.chunk))])
        return got[i - first * self.chunk : j - first * self.chunk]


class Encoder:
    """The library's ids of pieces of texts, by its default call: the string of an added token
    in a text is that token.

    Pieces that are a word, with or without a space before it, are joined to long strings,
    those without after a newline, and the library encodes these at less cost a piece. It
    never merges across the beginning of such a piece, so the ids part where the bytes of
    their tokens add up to those of the pieces.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocab = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)  # one character of a token's name is one byte
        self.pieces = Pieces(self.encode, public_tokenizers.PATTERN, special=special)

    def encode(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(parts)
        plain, other = [], []
        for i, p in enumerate(parts):
            word = p[1:] if p[:1] == " " else p
            (plain if word.isalpha() else other).append(i)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([parts[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        for k in range(0, len(plain), JOINED):
            group = plain[k : k + JOINED]
            joined = [parts[i] if parts[i][0] == " " else "\n" + parts[i] for i in group]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.size[ids])
            goals = np.cumsum([len(p.encode()) for p in joined])
            stops = np.searchsorted(ends, goals)
            if not (ends[stops] == goals).all():
                raise ValueError("a token crosses pieces: the tokenizer isn't byte-level with this pattern")
            data, stops = ids.tobytes(), (4 * (stops + 1)).tolist()
            for i, p, a, b in zip(group, joined, [0, *stops[:-1]], stops, strict=True):
                out[i] = data[a + 4 * (p[0] == "\n") : b]
        return out


@cache
def encoder(name: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(name)


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHERED) -> Iterator[pa.Table]:
    """Batches put together to tables of one chunk and about ``size`` bytes, without empty ones."""
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, planes: int = 4, files_ids: int = FILE_IDS) -> None:
    """Encode every document and write file images, in ascending order of id, under ``path``.

    Null texts are empty, null ids come first; rows of one id are ordered by their text's
    hash. Rows are dealt by ranges of id, text hash and row, so that many rows of one id
    don't meet in one task. Each image is a row (part, before: ids of the
    part before it, n_ids, image) of a Parquet
    table: executors reach a shared store through Spark alone, and its commit survives lost ones.
    """

    def each(batches):
        encode, names, sizes, parts, n, before, part = encoder(tokenizer).pieces.each, [], [], [], 0, 0, 0
        end = np.array([end_id], "<u4")

        def image():
            data = write_image(names, sizes, np.concatenate(parts), planes)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([n], pa.int64()), "image": pa.array([data], pa.binary())})

        for batch in gathered(batches):
            keys, part = batch.column("id").to_pylist(), batch.column("part")[0].as_py()
            for name, ids in zip(keys, encode(batch.column("text").chunk(0)), strict=True):
                names.append(name)
                sizes.append(len(ids) + 1)
                parts += [ids, end]
                n += sizes[-1]
                if n >= files_ids:
                    yield image()
                    names, sizes, parts, n, before = [], [], [], 0, before + n
        if names:
            yield image()

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, "id", "h", "row").sortWithinPartitions("id", "h", "row")
    dealt.select("id", "text", F.spark_partition_id().alias("part")).mapInArrow(each, "part int, before long, n_ids long, image binary").write.option("compression", "none").mode("error").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    images = spark.read.parquet(path)
    # one row a task that wrote: few, whatever the data, so it is summed in one place and broadcast
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = cut(parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first")))

    def each(batches):
        for batch in batches:
            for begin, data in zip(batch.column("begin").to_pylist(), batch.column("image"), strict=True):
                image = Image(data.as_buffer().to_pybytes())
                ids, ends = image.ids(), np.cumsum(image.lengths)
                starts = ends - image.lengths
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(image.doc_ids, pa.int64()), "start": pa.array(starts + begin, pa.int64()), "n_tokens": pa.array(image.lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    located = images.join(F.broadcast(first), "part")
    return located.select((F.col("first") + F.col("before")).alias("begin"), "image").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write token files (to a fresh folder of the shared one by default) and read them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, **how)
    return read_token_files(spark, path)
