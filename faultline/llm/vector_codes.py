"""Vector code compression: product quantisation on integers, entries searched
with LAESA pivots.

A vector's components become integers ``floor(scale * x)`` and are cut into
equal consecutive parts.  Each part position has a codebook, which starts as
that part of the first vectors by id and is moved ``rounds`` times to the
componentwise floor of the mean of the parts that it is nearest to.

Nearest entries are found with pivots that never move: a few entries of the
first codebook, far from each other.  The distances of every part to its pivots
are computed once and written with the integers.  In a round, the distances of
entries and pivots are compared with them: ``|d(x, p) - d(e, p)| <= d(x, e)``, the
largest over the pivots is a lower bound for the pair.  A part's entries are
tried by ascending bound; each trial is an exact evaluation on integers, and a
part is done when the next bound is above its best distance.  Bounds are lowered
by more than what their rounding can be, so nothing is lost, ties included.

A round is one pass over the written table: tasks add up the parts of each entry,
and sums (a number per component of the codebooks, whatever the table) go to the
driver, as does nothing else but the first vectors.  Codebooks go out with the
task; they hold ``parts * entries`` parts.

Edge cases: vectors that are null, empty, or hold a null or non-finite component
take no part; neither do those whose length is not the commonest (ties: the
smaller) length that ``parts`` divides.  Repeated ids are rows of their own;
null ids come last among the first vectors, equal ids in order of their
components.  With fewer vectors than entries, every vector is an entry.  An
unused entry stays where it was.  An empty table gives an empty result.
Integers must lie within +-2**26 and parts may have 256 components, so that
squared distances are exact; a larger component is an error that names it.
Other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 8, 16, 6, 4096, 4
#: integers beyond this are refused
LIMIT = 1 << 26
#: part of a distance by which bounds are lowered, far above what rounding gives
_SLACK = 1e-12


def to_integers(vectors: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """(rows, parts, width) integers of float vectors."""
    low = np.floor(vectors.astype(np.float64) * scale)
    if low.size and np.abs(low).max() > LIMIT:
        raise ValueError(f"a component times {scale} is beyond {LIMIT}: {vectors.flat[np.abs(low).argmax()]}")
    return low.astype(np.int64).reshape(len(vectors), parts, -1)


def distant(book: np.ndarray, pivots: int) -> np.ndarray:
    """Indexes of entries of each part (parts, pivots) that are far from each
    other: the first entry, then the one farthest from those chosen."""
    chosen = []
    for entries in book:
        near = ((entries - entries[0]) ** 2).sum(axis=1)
        picked = [0]
        while len(picked) < min(pivots, len(entries)):
            picked.append(int(near.argmax()))
            near = np.minimum(near, ((entries - entries[picked[-1]]) ** 2).sum(axis=1))
        chosen.append(picked)
    return np.array(chosen)


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, parts, pivots) Euclidean distances of (rows, parts, width) to (parts, pivots, width)."""
    out = np.empty((*parts.shape[:2], pivots.shape[1]))
    for j in range(pivots.shape[1]):
        out[:, :, j] = np.sqrt(((parts - pivots[None, :, j]) ** 2).sum(axis=2))
    return out


def nearest(parts: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each part the nearest entry (ties: the lower), its exact squared
    distance, and the number of exact evaluations that it took in all."""
    codes, errors = np.zeros(parts.shape[:2], np.int64), np.zeros(parts.shape[:2], np.int64)
    evaluated = 0
    for p in range(parts.shape[1]):
        x, entries, dx = parts[:, p], book[p], to_pivots[:, p]
        de = pivot_distances(entries[:, None], pivots[None, p])[:, 0]
        bound = np.zeros((len(x), len(entries)))
        for j in range(de.shape[1]):
            gap = np.abs(dx[:, j, None] - de[None, :, j]) - _SLACK * (dx[:, j, None] + de[None, :, j])
            np.maximum(bound, gap, out=bound)
        bound = bound * bound * (1 - _SLACK)
        order = np.argsort(bound, axis=1, kind="stable")
        best, code = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
        active = np.arange(len(x))
        for rank in range(len(entries)):
            entry = order[active, rank]
            going = bound[active, entry] <= best[active]
            active, entry = active[going], entry[going]
            if not len(active):
                break
            evaluated += len(active)
            d = ((x[active] - entries[entry]) ** 2).sum(axis=1)
            better = (d < best[active]) | ((d == best[active]) & (entry < code[active]))
            best[active[better]], code[active[better]] = d[better], entry[better]
        codes[:, p], errors[:, p] = code, best
    return codes, errors, evaluated


@dataclass
class Codes:
    """``rows``: the kept columns, ``code`` (two hex digits a part) and ``error``
    (squared distances over all parts); ``book``: (parts, entries, width);
    ``evaluated``: exact evaluations per part of each round and of the last pass
    (a plain search makes one per entry)."""
    rows: DataFrame
    book: np.ndarray
    evaluated: list[float]


def usable(rows: DataFrame, vector: str, parts: int) -> tuple[DataFrame, int]:
    """The vectors that take part, as doubles, and their length."""
    whole = F.col(vector).cast("array<double>")
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.coalesce((F.size(whole) > 0) & (F.size(whole) % parts == 0) & fine, F.lit(False)))
    sizes = good.groupBy(F.size(whole).alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    length = sizes["n"] if sizes else 0
    return good.where(F.size(whole) == length).withColumn(vector, whole), length


def compress(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", keep: tuple[str, ...] = (), parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS) -> Codes:
    """Codes of all usable vectors."""
    columns = [vec_id, *[c for c in keep if c != vec_id]]
    # named by place from here on, so that no kept column can clash
    plain = rows.select(F.col(vec_id).alias("_0"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns) if i], F.col(vector).alias("_vector"))
    good, length = usable(plain, "_vector", parts)
    first = good.orderBy(F.col("_0").asc_nulls_last(), "_vector").select("_vector").limit(entries).collect()
    vectors = np.array([r[0] for r in first], np.float64).reshape(len(first), length)
    book = np.ascontiguousarray(to_integers(vectors, scale, parts).transpose(1, 0, 2)) if first else np.zeros((parts, 0, 0), np.int64)
    fixed = np.stack([book[p][c] for p, c in enumerate(distant(book, pivots))]) if first else book
    names = [f"_{i}" for i in range(len(columns))]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in good.select(*names).schema]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("_vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
            whole = to_integers(vectors, scale, parts)
            binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], binary(whole.astype("<i4")), binary(pivot_distances(whole, fixed).astype("<f8"))],
                                             names=[*names, "integers", "distances"])

    table = checkpointed(good.select(*names, "_vector").mapInArrow(measure, ", ".join([*kept, "integers binary", "distances binary"])))

    def found(batch: pa.RecordBatch, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
        whole = read("integers", "<i4").astype(np.int64).reshape(batch.num_rows, parts, -1)
        return whole, *nearest(whole, read("distances", "<f8").reshape(batch.num_rows, parts, -1), book, fixed)

    def add_up(batches: Iterator[pa.RecordBatch], book: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums, counts, tries = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64), 0
        for batch in batches:
            if batch.num_rows:
                whole, codes, _, n = found(batch, book)
                tries += n
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=book.shape[1])
                    np.add.at(sums[p], codes[:, p], whole[:, p])
        values = np.concatenate((sums.ravel(), counts.ravel(), [tries]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])

    def assign(batches: Iterator[pa.RecordBatch], book: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, codes, errors, n = found(batch, book)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array([bytes(r).hex() for r in codes.astype(np.uint8)]),
                                                  pa.array(errors.sum(axis=1)), pa.array([n] + [0] * (batch.num_rows - 1), pa.int64())],
                                                 names=[*names, "code", "error", "evaluated"])

    evaluated = []
    for _ in range(rounds if first else 0):
        got = table.mapInArrow(lambda batches, book=book: add_up(batches, book), "place long, value long")
        got = got.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        values = [0] * (book.size + book.shape[0] * book.shape[1] + 1)
        for r in got:
            values[r["place"]] = int(r["value"])
        counts = np.array(values[book.size:-1], object).reshape(book.shape[:2])
        evaluated.append(values[-1] / max(1, counts.sum()))
        sums = np.array(values[:book.size], object).reshape(book.shape)
        means = sums // np.maximum(counts, 1)[:, :, None]
        book = np.where((counts > 0)[:, :, None], means, book).astype(np.int64)
    coded = checkpointed(table.mapInArrow(lambda batches, book=book: assign(batches, book), ", ".join([*kept, "code string", "error long", "evaluated long"])))
    if first:
        tries, n = coded.agg(F.sum("evaluated"), F.count(F.lit(1))).first()
        evaluated.append(tries / (n * parts))
    return Codes(coded.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)], "code", "error"), book, evaluated)
