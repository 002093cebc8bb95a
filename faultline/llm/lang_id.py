"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from a fixed seed by a
hash of its code point, so no alphabet is fixed).  An n-gram's vector binds
(multiplies) the vectors of its letters, each permuted (rotated) by its place;
a text's vector bundles (adds) those of all its n-grams.  A language's
prototype bundles the texts that carry its label, each scaled to the same
length.  A text gets the language whose prototype has the largest cosine with
its vector; the cosine, floored at 0, is the score.

Text: lower-cased, every run of characters that are no letters is one space,
one space at both ends.

Training takes at most about ``max_docs_per_lang`` texts of a language, chosen
by a hash of id and text, where rows equal in both count once; of a language
with no more rows than that it takes all rows.  Sums are of integers, so
the prototypes do not depend on the order of rows or tasks.

Edge cases: a null text, or one without a letter, gets ``und`` with score 0;
with no labelled text every text gets ``und``; equal cosines go to the first
language in order; very long texts are bundled block by block; an empty table
gives an empty result; an input column of an output's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMENSIONS = 512
ORDER = 3
SEED = 20
#: Letter vectors; code points are hashed into so many.
SYMBOLS = 1024
MAX_DOCS_PER_LANG = 4000
_SCALE = 10_000
_BLOCK = 1 << 20
_NO_LETTERS = re.compile(r"[\W\d_]+")


class Space:
    """The letter vectors, one rotated copy for each place in an n-gram."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
        self.places = [np.roll(letters, order - 1 - i, axis=1) for i in range(order)]
        self.order, self.dimensions = order, dimensions

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return ((points * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The vector of a text; None where it has no letter."""
        clean = _NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
        if not any(map(str.isalpha, clean)):
            return None
        out, clean = np.zeros(self.dimensions), f" {clean} "
        for at in range(0, len(clean), _BLOCK):
            letters = self.symbols(clean[at:at + _BLOCK + self.order - 1])
            n = len(letters) - self.order + 1
            if n <= 0:
                continue
            codes = letters[:n].copy()
            for i in range(1, self.order):
                codes = codes * SYMBOLS + letters[i:n + i]
            codes, counts = np.unique(codes, return_counts=True)
            for part in range(0, len(codes), 8192):
                rest, bound = codes[part:part + 8192], None
                for i in reversed(range(self.order)):
                    place = self.places[i][rest % SYMBOLS]
                    bound = place if bound is None else np.multiply(bound, place, out=bound)
                    rest = rest // SYMBOLS
                out += counts[part:part + 8192].astype(np.float32) @ bound.astype(np.float32)
        return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          max_docs_per_lang: int = MAX_DOCS_PER_LANG, **space) -> dict[str, np.ndarray]:
    """Language to prototype, from the rows with a label.

    The result holds one vector per language, summed in the cluster."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("id")).where("lang is not null")
    key = F.xxhash64("id", "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(key).alias("different")).collect()
    shares = {r["lang"]: min(1.0, max_docs_per_lang / max(r["different"], 1)) if r["n"] > max_docs_per_lang else None for r in counts}
    if not shares:
        return {}
    chosen = rows.where(F.col("lang").isin([x for x, share in shares.items() if share is None])).select("lang", "text")
    sampled = {x: share for x, share in shares.items() if share is not None}
    if sampled:
        share = F.create_map(*[F.lit(x) for pair in sampled.items() for x in pair])
        some = rows.where(F.pmod(key, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
        chosen = chosen.unionByName(some.dropDuplicates(["lang", "id", "text"]).select("lang", "text"))

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, sums = Space(**space), {}
        for batch in batches:
            for name, text_ in zip(batch["lang"], batch["text"], strict=True):
                v = vectors.bundle(text_)
                if v is not None and (norm := np.linalg.norm(v)):
                    sums[name] = sums.get(name, 0) + np.rint(v / norm * _SCALE).astype(np.int64)
        for name, v in sums.items():
            yield pd.DataFrame({"lang": name, "i": np.arange(len(v), dtype=np.int32), "v": v})

    parts = chosen.mapInPandas(bundles, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in parts.collect():
        out.setdefault(r.lang, np.zeros(space.get("dimensions", DIMENSIONS)))[r.i] = r.v
    return dict(sorted(out.items()))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text",
             out: str = "lang_pred", score: str = "score", **space) -> DataFrame:
    """``docs`` with ``out`` and ``score``."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names]) if names else np.zeros((0, 1))
    model = docs.sparkSession.sparkContext.broadcast((names, matrix))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, matrix = model.value
        vectors = Space(**space)
        for texts in batches:
            rows = []
            for text_ in texts:
                v = vectors.bundle(text_) if names else None
                norm = 0 if v is None else np.linalg.norm(v)
                if v is None:
                    rows.append((UNKNOWN, 0.0))
                else:
                    cosines = matrix @ v / (norm or 1)
                    best = int(np.argmax(cosines))
                    rows.append((names[best], float(min(1.0, max(0.0, cosines[best])))))
            yield pd.DataFrame(rows, columns=["lang", "score"])

    found = docs.withColumn("_found", predict(F.col(text)))
    return found.withColumns({out: F.col("_found.lang"), score: F.col("_found.score")}).drop("_found")
