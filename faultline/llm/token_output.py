"""Token ids as compressed planes, written and read back by Spark.

Texts are encoded (each followed by an end id) in ascending id order and the
ids of a shard are cut into blocks of ``block`` ids.  A block is transposed
into planes (byte planes: all lowest bytes, then all second bytes, ...; or bit
planes), planes of zeros at the top are left out, and each plane is compressed
with zstandard by itself.

Format (two Parquet tables under one folder, written by Spark's committer, so
a lost task leaves nothing behind)::

    blocks/  one folder a shard: block, first (place of the block's first id in
             its shard), n, kind, planes array<binary>,
             pieces array<struct<id, ordinal, part, last, at, n>>  the documents,
             or parts of documents (``last``: the last of its parts), in the block
    index/   shard, block, start (place of the first id of all), n, bytes,
             first_id, last_id

Shards are the ranges of a range partitioning by id, so shard order is id
order; a document's place of all is its place in the shard plus the ids of
the shards before (one number per shard goes through the driver).  Readers take
those from the index: ``read_range`` looks up which blocks hold a range of places
and opens these alone.

Words are looked up in a memory of words; a new word goes to the library's merges.
A tokenizer file whose rules are not those that the fast path knows (``_RULES``)
is used through the library alone.

Edge cases: a null text counts as empty and holds the end id alone; null ids
come first; rows that repeat an id follow each other by a hash of the text and
then the text; a text longer than a block spans blocks; an empty table gives
empty tables; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import checkpoint_dir

from .common import checkpointed
from .vocab import MEMORY, NOT_SIMPLE, Pieces, Vocabulary, kept, read_file

BLOCK = 1 << 16
LEVEL = 3
#: The pattern of the word-level vocabulary, for lower-case texts of simple characters.
_PATTERN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_SPACES = re.compile("[\t-\r ]+")
#: ---- fixed values: the rules in a tokenizer file that the fast path follows ----
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
# -----------------------------------------------------------------------------


class WordBPE(Vocabulary):
    """Encodes word by word: white space is dropped, so no piece crosses it."""

    def __init__(self, text: str):
        super().__init__(text)
        config = json.loads(text)
        if any(config.get(k) != v for k, v in _RULES.items()) or config["model"].get("ignore_merges"):
            self.encode = self.encode_whole
        self.words, self.marks = Pieces(self._word, 2 * MEMORY), Pieces(self.merge)

    def merge(self, piece: str) -> bytes:
        if not piece.isascii():
            return super().merge(piece)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self.merge(word)
        # letters are remembered with the words, so that "word," costs no second merge
        return b"".join([(self.words if piece.isalpha() else self.marks)[piece] for piece in _PATTERN.findall(word)])

    def encode(self, text: str) -> bytes:
        if NOT_SIMPLE.search(text) or self.added_re.search(text):
            return b"".join(map(self._odd, _SPACES.split(text)))
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def _odd(self, word: str) -> bytes:
        if NOT_SIMPLE.search(word) or self.added_re.search(word):
            return self.encode_whole(word)
        return self.words[word.lower()] if word else b""


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Uncompressed planes of unsigned 32-bit ids, lowest first, zero planes at the top left out."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        top = int(ids.max(initial=0)).bit_length()
        return [np.packbits(rows[:, i]).tobytes() for i in range(top)]
    return [np.ascontiguousarray(rows[:, i]).tobytes() for i in range((int(ids.max(initial=0)).bit_length() + 7) // 8)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    out = np.zeros(n, "<u4")
    for i, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        out |= (np.unpackbits(raw, count=n) if kind == "bit" else raw).astype("<u4") << np.uint32(i if kind == "bit" else 8 * i)
    return out


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id",
                 end_id: int = 1, block: int = BLOCK, kind: str = "byte") -> None:
    """Write ``folder``/blocks and ``folder``/index."""
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(read_file(tokenizer_path))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(shards, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    piece = f"struct<id:{id_type},ordinal:bigint,part:int,last:boolean,at:int,n:int>"
    schema = f"shard int, block int, first long, n int, kind string, planes array<binary>, pieces array<{piece}>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = kept(file.value, WordBPE), np.array([end_id], "<u4").tobytes()
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        shard, number, first, ordinal = TaskContext.get().partitionId(), 0, 0, 0
        held, size, pieces = [], 0, []
        types = pa.schema([("id", pa.int64())])

        def row(ids: np.ndarray) -> pa.RecordBatch:
            planes = [squeeze.compress(p) for p in to_planes(ids, kind)]
            names = ["id", "ordinal", "part", "last", "at", "n"]
            kinds = [types.field("id").type, pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
            fields = [pa.array([p[i] for p in pieces], kind) for i, kind in enumerate(kinds)]
            structs = pa.StructArray.from_arrays(fields, names=names)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([len(ids)], pa.int32()), pa.array([kind]), pa.array([planes], pa.list_(pa.binary())),
                 pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)],
                names=["shard", "block", "first", "n", "kind", "planes", "pieces"])

        for batch in batches:
            types = batch.schema
            for id_, text_ in zip(batch.column("id"), batch.column("text"), strict=True):
                ids = np.frombuffer(bpe.encode(text_.as_py()) + end, "<u4")
                id_, part, at = id_.as_py(), 0, 0
                while at < len(ids):
                    n = min(block - size, len(ids) - at)
                    pieces.append((id_, ordinal, part, at + n == len(ids), size, n))
                    held.append(ids[at:at + n])
                    size, at, part = size + n, at + n, part + 1
                    if size == block:
                        yield row(np.concatenate(held))
                        number, first, held, size, pieces = number + 1, first + size, [], 0, []
                ordinal += 1
        if size:
            yield row(np.concatenate(held))

    # a row group a block, so that a reader of one block reads no other
    (dealt.mapInArrow(pack, schema).write.option("compression", "none").option("parquet.block.size", 1 << 16)
     .option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).partitionBy("shard").parquet(f"{folder}/blocks"))
    blocks = _read_blocks(spark, folder, piece)
    totals = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    sizes = [totals.get(i, 0) for i in range(max(totals, default=-1) + 1)]
    starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).tolist()
    before = F.from_json(F.lit(str(starts)), "array<bigint>")[F.col("shard")]
    size = F.aggregate(F.transform("planes", F.octet_length), F.lit(0).cast("long"), lambda a, b: a + b)
    (blocks.select("shard", "block", (F.col("first") + before).alias("start"), "n", size.alias("bytes"),
                   F.col("pieces")[0]["id"].alias("first_id"), F.element_at("pieces", -1)["id"].alias("last_id"))
     .write.parquet(f"{folder}/index"))


def _read_blocks(spark: SparkSession, folder: str, piece: str) -> DataFrame:
    # the schema is named: no shard, no folder to learn it from
    schema = f"block int, first long, n int, kind string, planes array<binary>, pieces array<{piece}>, shard int"
    return spark.read.schema(schema).parquet(f"{folder}/blocks")


def shard_starts(index: DataFrame) -> Column:
    """Place of the first id of each shard, by shard: one number per shard, from the index."""
    found = {r.shard: r.start for r in index.where("block = 0").select("shard", "start").collect()}
    return F.from_json(F.lit(str([found.get(i, 0) for i in range(max(found, default=-1) + 1)])), "array<bigint>")


def read_pieces(spark: SparkSession, folder: str, with_ids: bool = True, blocks: list[tuple[int, int]] | None = None) -> DataFrame:
    """The documents, or parts of them, from the files: ``id, shard, ordinal,
    part, last, start`` (place among all ids), ``n, crc32`` and, if asked,
    ``ids``; only those in ``blocks`` (shard, block), if given."""
    index = spark.read.parquet(f"{folder}/index")
    id_type = index.schema["first_id"].dataType.simpleString()
    rows = _read_blocks(spark, folder, f"struct<id:{id_type},ordinal:bigint,part:int,last:boolean,at:int,n:int>")
    if blocks is not None:
        by_shard: dict[int, list[int]] = {}
        for shard, block in blocks:
            by_shard.setdefault(shard, []).append(block)
        wanted = F.lit(False)
        for shard, some in sorted(by_shard.items()):
            wanted = wanted | ((F.col("shard") == shard) & F.col("block").between(min(some), max(some)))
        rows = rows.where(wanted)
    rows = rows.withColumn("first", F.col("first") + shard_starts(index)[F.col("shard")])
    schema = f"id {id_type}, shard int, ordinal long, part int, last boolean, start long, n long, crc32 long" + ", ids array<int>" * with_ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i, batch=batch: batch.column(name)[i]
                pieces = get("pieces").values
                ids = from_planes([grow.decompress(p.as_py()) for p in get("planes")], get("n").as_py(), get("kind").as_py())
                at, n = pieces.field("at").to_numpy().astype(np.int64), pieces.field("n").to_numpy().astype(np.int64)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                columns = [pieces.field("id"), pa.array(np.full(len(at), get("shard").as_py(), np.int32)), pieces.field("ordinal"),
                           pieces.field("part"), pieces.field("last"), pa.array(at + get("first").as_py()), pa.array(n), pa.array(crc, pa.int64())]
                names = ["id", "shard", "ordinal", "part", "last", "start", "n", "crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + n[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("shard", "first", "n", "kind", "planes", "pieces").mapInArrow(unpack, schema)


def read_range(spark: SparkSession, folder: str, start: int, n: int) -> DataFrame:
    """The ids at places ``start`` to ``start + n`` of all, cut at document and
    block ends: ``id, start, n, ids``.  The index tells the blocks, which are all
    that is opened; places past the end give nothing."""
    stop = start + n
    index = spark.read.parquet(f"{folder}/index").where((F.col("start") < stop) & (F.col("start") + F.col("n") > start))
    some = read_pieces(spark, folder, blocks=[(r.shard, r.block) for r in index.select("shard", "block").collect()])
    some = some.where((F.col("start") < stop) & (F.col("start") + F.col("n") > start))
    first = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
    last = F.least(F.lit(stop) - F.col("start"), F.col("n")).cast("int")
    return some.select("id", (F.col("start") + first).alias("start"), (last - first).cast("long").alias("n"), F.slice("ids", first + 1, last - first).alias("ids"))


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc32_join(crcs: list[tuple[int, int]]) -> int:
    """crc32 of bytes strung together, from (crc32, number of bytes) of each:
    a crc is linear over bits, so zeros are appended by squared matrices."""
    total = 0
    for crc, size in crcs:
        one = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
        bits = 8 * size
        while bits:
            if bits & 1:
                total = _times(one, total)
            one = [_times(one, row) for row in one]
            bits >>= 1
        total ^= crc
    return total


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``id, start, n_tokens, crc32`` of each document, from the files, which
    are read once (what is returned no longer needs them).  Only documents that
    span blocks are gathered."""
    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([crc32_join([(x["crc32"], 4 * x["n"]) for x in p]) for p in parts])

    pieces = checkpointed(read_pieces(spark, folder, with_ids=False))
    whole = F.col("last") & (F.col("part") == 0)
    docs = pieces.where(~whole).groupBy("shard", "ordinal").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("part", "n", "crc32"))).alias("parts"))
    return (pieces.where(whole).select("id", "start", F.col("n").alias("n_tokens"), "crc32")
            .unionByName(docs.select("id", "start", "n_tokens", joined("parts").alias("crc32"))))


def new_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
