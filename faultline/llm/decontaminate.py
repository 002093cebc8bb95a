"""Benchmark decontamination with an Aho-Corasick automaton.

Test items are normalised (A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) and cut into windows of
``window`` consecutive words; an item of fewer words, but not none, is one
window.  All windows go into one automaton, which every task builds once from
the broadcast items.  A document is normalised once and scanned once; matches
are mapped back to word numbers and to code points of the original text.

Normalising works on UTF-8 bytes: every separator is one ASCII byte and every
byte of another character is a word byte, so a 256-entry table is exact.

Bounds: the test items are broadcast, and their size is checked against
``max_benchmark_bytes`` first (a larger set is refused, never cut).  An
automaton holds windows of at most ``AUTOMATON_CHARS`` characters; more items
than that are dealt over several automata, of which a task holds one at a
time, with the same result.

Edge cases: null and empty texts have no words, no hits and are clean; items
without words never occur; a null item id is listed as ``null``; items that
repeat an id count once; an empty benchmark leaves every document clean;
repeated documents each keep their row; a column of the operator's output
replaces an input column of that name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of windows in one automaton (about 50 bytes of memory each).
AUTOMATON_CHARS = 4_000_000
MAX_BENCHMARK_BYTES = 256 << 20
RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"

#: Digits, letters and all bytes of non-ASCII characters make words.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_KEPT: dict = {}


def normalise(text: str) -> bytes:
    """Same length in bytes as the text in UTF-8; separators are spaces."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def windows(words: list[bytes], window: int) -> set[bytes]:
    if len(words) <= window:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i:i + window]) for i in range(len(words) - window + 1)}


def slices(items: list[tuple[str, str]], window: int) -> list[list[tuple[str, str]]]:
    """Items dealt, in order, so that the windows of a part fit one automaton."""
    out, size = [[]], 0
    for item in items:
        n = sum(map(len, windows(normalise(item[1]).split(), window)))
        if out[-1] and size + n > AUTOMATON_CHARS:
            out.append([])
            size = 0
        out[-1].append(item)
        size += n
    return out


def build(items: list[tuple[str, str]], window: int) -> ahocorasick.Automaton:
    """Key: a window between spaces; value: its number of words and its item ids."""
    owners: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for w in windows(normalise(text).split(), window):
            owners.setdefault(w, set()).add(item_id)
    automaton = ahocorasick.Automaton()
    for w, ids in owners.items():
        automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(ids)))
    automaton.make_automaton()
    return automaton


def _automata(key: str, parts: list, window: int) -> Iterator[ahocorasick.Automaton]:
    """One automaton stays in the worker; of several, one at a time is held."""
    if len(parts) > 1:
        yield from (build(part, window) for part in parts)
    elif parts[0]:
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = build(parts[0], window)
        yield _KEPT[key]


class _Document:
    def __init__(self, text: str | None):
        self.norm = normalise(text or "")
        words = self.norm.split()
        self.n_words = len(words)
        self.line = f" {b' '.join(words).decode('latin-1')} "
        self.cover, self.spaces, self.items = None, None, set()

    def scan(self, automaton) -> None:
        for end, (n, ids) in automaton.iter(self.line):
            if self.cover is None:
                self.cover = np.zeros(self.n_words + 1, dtype=np.int32)
                self.spaces = np.flatnonzero(np.frombuffer(self.line.encode("latin-1"), np.uint8) == 0x20)
            last = int(np.searchsorted(self.spaces, end))  # the space that ends the window's last word
            self.cover[last - n] += 1
            self.cover[last] -= 1
            self.items.update(ids)

    def result(self) -> tuple:
        if self.cover is None:
            return self.n_words, 0, [], []
        hit = np.cumsum(self.cover[:-1]) > 0
        raw = np.frombuffer(self.norm, np.uint8)
        edge = np.diff(np.concatenate(([0], (raw != 0x20).astype(np.int8), [0])))
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
        starts, ends = points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]
        runs = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
        spans = [{"start": int(s), "end": int(e)} for s, e in zip(starts[first], ends[last], strict=True)]
        return self.n_words, int(hit.sum()), sorted(self.items), spans


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = 13, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """``docs`` with ``n_words, n_hit, item_ids`` (sorted as strings)``, spans``
    (code points of runs of hit words) and ``contaminated`` (n_hit > 0 and
    20 * n_hit >= n_words)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    if size > max_benchmark_bytes:
        raise ValueError(f"the test items hold {size} bytes; max_benchmark_bytes is {max_benchmark_bytes}")
    sc = docs.sparkSession.sparkContext
    parts = sc.broadcast(slices([(r.i, r.t) for r in items.collect()], window))
    key = uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = None
            if len(parts.value) == 1:  # a document at a time
                rows = []
                kept = list(_automata(key, parts.value, window))
                for text_ in texts:
                    doc = _Document(text_)
                    for automaton in kept:
                        doc.scan(automaton)
                    rows.append(doc.result())
            else:  # an automaton at a time
                held = [_Document(text_) for text_ in texts]
                for automaton in _automata(key, parts.value, window):
                    for doc in held:
                        doc.scan(automaton)
                rows = [doc.result() for doc in held]
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "spans"])

    found = docs.withColumn("_found", scan(F.col(text)))
    return (found.withColumns({c: F.col(f"_found.{c}") for c in ("n_words", "n_hit", "item_ids", "spans")})
            .drop("_found").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))
