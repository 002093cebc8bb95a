"""Byte-level BPE encoding and decoding, long texts by tree concatenation.

A text of more than ``leaf_chars`` code points is cut into halves, quarters
and so on, each leaf a row that Spark deals out, so that one long text is
encoded by many tasks.  The leaves of a text are then joined two by two.  A
join re-encodes a window around the cut and puts ``left | window | right``
together where the window agrees with both sides; it doubles the window until
both sides agree exactly (at last it is the whole of both).

Why agreement is exact.  The pattern cuts a text into pieces from left to
right and looks one character beyond a piece at most, so a piece start that
lies clear of an edge is a piece start of the whole text when the scan that
found it began at one; from a common piece start two scans go on alike.
Inside one piece (a run with no place to cut), a sequence of tokens is the
encoding when each two neighbours are; where the window shares a whole token
with each side, every pair of neighbours stems from one of the three
encodings.  Added tokens are matched before the pattern: starts within
``margin`` (the longest added token) of a cut are not used.

Edge cases: a null text counts as empty and has no ids; repeated rows keep
their rows; an empty table gives an empty result; extra columns are ignored
(``keep`` names those to return).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .vocab import NOT_SIMPLE, Pieces, Vocabulary, kept, read_file

#: Code points of a leaf at most; the rows of one piece of work hold about CHUNK.
LEAF_CHARS = 1 << 15
CHUNK_BYTES = 4 << 20
WINDOW = 64
#: Pieces that a worker remembers; it holds ids, text and decoded text beside them.
PIECES = 200_000
#: The byte-level pattern, for texts of simple characters only.
_PATTERN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Encoded(NamedTuple):
    raw: bytes
    ids: np.ndarray
    ends: np.ndarray  # in bytes, after each token
    first: np.ndarray  # whether the token is the first of its piece


class ByteBPE(Vocabulary):
    def __init__(self, text: str):
        super().__init__(text)
        self.pieces = Pieces(self.merge, PIECES)
        self.sizes = np.array([len(b) for b in self.token_bytes], dtype=np.int64)
        self.margin = max([4, *(len(t.encode()) for t in self.added)])

    def encode(self, text: str) -> bytes:
        """The ids, as bytes of little-endian unsigned 32-bit integers."""
        if NOT_SIMPLE.search(text):
            return self.encode_whole(text)
        if self.added_re.search(text):
            return b"".join(map(bytes, (x for _, x in self._parts(text))))
        return b"".join(map(self.pieces.__getitem__, _PATTERN.findall(text)))

    def _parts(self, text: str) -> Iterator[tuple[bool, bytes]]:
        """(whether it is an added token, ids) of each piece of a simple text."""
        at = 0
        for m in [*self.added_re.finditer(text), None]:
            for piece in _PATTERN.findall(text[at:m.start() if m else len(text)]):
                yield False, self.pieces[piece]
            if m:
                yield True, np.array([self.added[m[0]]], "<u4").tobytes()
                at = m.end()

    def marked(self, raw: bytes) -> Encoded:
        """The encoding of a leaf or a window, with its pieces marked."""
        text = raw.decode("utf-8", "surrogatepass")
        if NOT_SIMPLE.search(text):
            whole = self.tokenizer.encode(text, add_special_tokens=False)
            ids = np.array(whole.ids, "<u4")
            words = np.array([-1 if w is None else w for w in whole.word_ids], dtype=np.int64)
            first = np.ones(len(ids), dtype=bool)
            # words are numbered anew after an added token
            first[1:] = (np.diff(words) != 0) | np.isin(ids[1:], list(self.added.values())) | np.isin(ids[:-1], list(self.added.values()))
        else:
            parts = [x for _, x in self._parts(text)]
            ids = np.frombuffer(b"".join(parts), "<u4")
            first = np.zeros(len(ids), dtype=bool)
            first[np.cumsum([0, *(len(x) // 4 for x in parts)])[:-1]] = True
        return Encoded(raw, ids, np.cumsum(self.sizes[ids]), first)

    def join(self, left: Encoded, right: Encoded, window: int = WINDOW) -> Encoded:
        """The encoding of both texts together."""
        if not len(left.raw) or not len(right.raw):
            return right if len(right.raw) else left
        cut, end = len(left.raw), len(left.raw) + len(right.raw)
        raw = left.raw + right.raw
        starts = np.concatenate(([0], left.ends[:-1]))
        r_starts = cut + np.concatenate(([0], right.ends[:-1]))
        whole = lambda at: at == end or raw[at] & 0xC0 != 0x80  # noqa: E731  a place between characters
        while True:
            # from a token start of the left ...
            i = int(np.searchsorted(starts, cut - window, "right")) - 1
            while i > 0 and not whole(int(starts[i])):
                i -= 1
            i = max(i, 0)
            # ... to a token start of the right
            k = int(np.searchsorted(r_starts, cut + window))
            while k < len(r_starts) and not whole(int(r_starts[k])):
                k += 1
            begin, stop = int(starts[i]), int(r_starts[k]) if k < len(r_starts) else end
            middle = self.marked(raw[begin:stop])
            m_starts = begin + np.concatenate(([0], middle.ends[:-1]))
            if self._agrees_left(left, starts, i, middle, m_starts, cut):
                if stop == end:
                    return self._put(raw, left, i, middle, len(middle.ids), right, len(right.ids))
                if at := self._agrees_right(right, r_starts, middle, m_starts, cut, stop):
                    return self._put(raw, left, i, middle, at[0], right, at[1])
            window *= 2

    def _agrees_left(self, left, starts, i, middle, m_starts, cut) -> bool:
        if i == 0:
            return True
        edge = cut - self.margin
        if left.first[i]:
            return starts[i] <= edge
        # inside a piece: the first token is the left's, and either both have one piece start or it is one run to the cut
        if middle.ids[0] != left.ids[i]:
            return False
        ours = starts[i + 1:][left.first[i + 1:]]
        theirs = m_starts[1:][middle.first[1:]]
        ours, theirs = ours[ours <= edge], theirs[theirs <= edge]
        if len(ours) == 0 and len(theirs) == 0:
            return True
        n = min(len(left.ids) - i, len(middle.ids))
        same = np.flatnonzero(left.ids[i:i + n] != middle.ids[:n])
        n = int(same[0]) if len(same) else n
        return len(ours) > 0 and len(theirs) > 0 and ours[0] == theirs[0] and m_starts[min(n, len(m_starts) - 1)] >= ours[0]

    def _agrees_right(self, right, r_starts, middle, m_starts, cut, stop):
        """(token of the window, token of the right) at which the right goes on."""
        low, high = cut + self.margin, stop - self.margin
        starts = np.intersect1d(m_starts[middle.first], r_starts[right.first])
        starts = starts[(starts >= low) & (starts <= high)]
        if len(starts):
            at = starts[0]
            return int(np.searchsorted(m_starts, at)), int(np.searchsorted(r_starts, at))
        run = m_starts[middle.first][-1]  # the window's last piece, a run that goes on in the right
        after = r_starts[right.first]
        if np.any((after > low) & (after <= stop)):
            return None
        common, m, r = np.intersect1d(m_starts, r_starts, return_indices=True)
        good = (common >= max(low, run)) & (common <= high)
        good[good] = middle.ids[m[good]] == right.ids[r[good]]
        where = np.flatnonzero(good)
        return (int(m[where[0]]), int(r[where[0]])) if len(where) else None

    def _put(self, raw, left, i, middle, m, right, r) -> Encoded:
        first = middle.first[:m].copy()
        if m:
            first[0] = left.first[i] if i else True
        after = right.first[r:].copy()
        if len(after) and m < len(middle.first):
            after[0] = middle.first[m]
        ids = np.concatenate((left.ids[:i], middle.ids[:m], right.ids[r:]))
        return Encoded(raw, ids, np.cumsum(self.sizes[ids]), np.concatenate((left.first[:i], first, after)))

    def tree(self, leaves: list[Encoded]) -> Encoded:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i:i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids`` (array of int) and ``decoded``
    (the text that the ids decode to) for every row of ``docs``."""
    file = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    out = rows.select(*keep).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def packed(bpe: ByteBPE, columns: list, encoded: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) // 4 for x in encoded], dtype=np.int64)
        flat = np.frombuffer(b"".join(encoded), "<u4")
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
        decoded = [bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sizes), ids, pa.array(decoded, pa.string())], names=[*keep, "n_tokens", "ids", "decoded"])

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(file.value, ByteBPE)
        for batch in batches:
            at, size, encoded = 0, 0, []
            texts = batch.column("_text")
            for n, text_ in enumerate(texts):
                text_ = text_.as_py()
                encoded.append(bpe.encode(text_))
                size += len(text_)
                if size >= CHUNK_BYTES or n + 1 == len(texts):
                    yield packed(bpe, [batch.column(c).slice(at, len(encoded)) for c in keep], encoded)
                    at, size, encoded = n + 1, 0, []

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(file.value, ByteBPE)
        for batch in batches:
            for i in range(batch.num_rows):  # a leaf at a time: a marked leaf is several times its text
                leaf = bpe.marked(batch.column("_leaf")[i].as_py().encode("utf-8", "surrogatepass"))
                columns = [*batch.slice(i, 1).columns, pa.array([leaf.ids.astype("<u4").tobytes()], pa.binary()),
                           pa.array([np.packbits(leaf.first).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "ids", "first"])

    def join_leaves(group: pd.DataFrame) -> pd.DataFrame:
        bpe, leaves = kept(file.value, ByteBPE), []
        for r in group.sort_values("_at").itertuples(index=False):
            ids = np.frombuffer(r.ids, "<u4")
            leaves.append(Encoded(r[group.columns.get_loc("_leaf")].encode("utf-8", "surrogatepass"), ids, np.cumsum(bpe.sizes[ids]),
                                  np.unpackbits(np.frombuffer(r.first, np.uint8), count=len(ids)).astype(bool)))
        whole = bpe.tree(leaves)
        row = {c: group[c].iloc[0] for c in keep}
        return pd.DataFrame([row | {"n_tokens": len(whole.ids), "ids": whole.ids.astype(np.int32), "decoded": bpe.decode(whole.ids)}])

    short = rows.where(F.length("_text") <= leaf_chars).mapInArrow(encode_short, out)
    # halves until a part has leaf_chars at most: 2 ** levels equal parts
    levels = F.ceil(F.log2(F.length("_text") / F.lit(leaf_chars)))
    part = F.ceil(F.length("_text") / F.pow(F.lit(2), levels)).cast("int")
    cut = rows.where(F.length("_text") > leaf_chars).withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", part)
    cut = cut.withColumn("_at", F.explode(F.sequence(F.lit(0), F.ceil(F.length("_text") / F.col("_part")).cast("int") - 1)))
    cut = cut.select(*keep, "_row", "_at", F.substring("_text", F.col("_at") * F.col("_part") + 1, F.col("_part")).alias("_leaf"))
    leaves = cut.repartition("_row", "_at").mapInArrow(encode_leaves, cut.schema.add("ids", "binary").add("first", "binary"))
    return short.unionByName(leaves.groupBy("_row").applyInPandas(join_leaves, out))
