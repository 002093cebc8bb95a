"""Mixing, vector codes and the manifest: against plain-Python versions, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import manifest, mixing, vector_codes
from faultline.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use themselves
CLASHING = ["group", "key", "digest", "claimed", "place", "lo", "hi", "s", "e", "g", "idx", "path", "k", "size", "copies", "shard", "cell", "all", "at",
            "target", "spans", "code", "error", "integers", "distances", "_0", "_vector", "evaluated", "label_error"]


def with_clashes(df):
    return df.withColumns({c: F.lit("mine") for c in CLASHING if c not in df.columns})


def odd_docs():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["Aa", "bé", "\x0bc", "D\t"]) for _ in range(rng.randint(0, 90))), rng.choice(["de", "en", None, "Z", "é"]),
             rng.choice(["web", "books", None, "\U0001f600", "�"]), i) for i in range(120)]
    rows += [(None, "null Id", "de", "web", None), (None, "null Id", "de", "web", None), (7, None, "en", "books", 0), (8, "", "en", "books", 0),
             (500, "LONG " * 20000, "de", "web", 100000), (501, " \t\n", "x", "blank", 3), (501, " \t\n", "x", "blank", 3), (502, "One", "solo", "solo", 3)]
    return rows + [(9, "Same again", "en", "web", 10)] * 25


# --- manifest --------------------------------------------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes, fanout):
    """The node left, and of each first node its siblings level by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // fanout * fanout
            paths[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1:run + fanout])))
        nodes, at = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)], [a // fanout for a in at]
    return nodes[0], paths


def plain_manifest(rows, fanout=8):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = own, *climb([leaf_of(r) for r in own], fanout)
    root, above = climb([trees[g][1] for g in order], fanout)
    out = []
    for g, rest in zip(order, above, strict=True):
        own, subroot, paths = trees[g]
        for row, path in zip(own, paths, strict=True):
            touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded = leaf_of(row, touched)
            for left, right in path + rest:
                folded = h(left, folded, right)
            out.append((row[0], leaf_of(row), subroot, root, h(*[x for p in path + rest for x in p]), folded, folded == root))
    return Counter(out)


def test_manifest_equals_plain_version(spark, tmp_path):
    for rows in (odd_docs(), odd_docs()[:1], odd_docs()[:9], []):
        folder = str(tmp_path / f"docs{len(rows)}")
        with_clashes(spark.createDataFrame(rows, DOCS)).write.parquet(f"{folder}/documents.parquet")
        got = QUERIES["op13_manifest"](spark, folder)
        assert Counter(map(tuple, got.collect())) == (plain_manifest(rows) if rows else Counter())


def test_manifest_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = QUERIES["op13_manifest"](spark, SMALL).collect()
    assert Counter(map(tuple, got)) == plain_manifest(rows)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_labels_nest(spark, fanout):
    rows = [(i, "x", str(i % 3) if i % 5 else None, "s", 1) for i in range(70)]
    built = manifest.build(spark.createDataFrame(rows, DOCS), ["doc_id", "text"], "lang", "doc_id", fanout=fanout)
    nodes = defaultdict(list)
    for r in built.nodes().collect():
        nodes[r.tree, r.level].append((r.lo, r.hi))
    for (tree, level), spans in nodes.items():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))  # no overlap
        for lo, hi in spans:
            inside = [x for x in nodes.get((tree, level - 1), []) if lo <= x[0] and x[1] <= hi]
            assert not level or 1 <= len(inside) <= fanout and inside[0][0] == lo and max(x[1] for x in inside) == hi


def test_manifest_of_any_claim(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "a", "s", 1) for i in range(20)], DOCS)
    built = manifest.build(docs, ["text"], "lang", "doc_id", claimed=F.when(F.col("doc_id") == 3, F.sha2(F.lit("forged"), 256)).otherwise(manifest.leaf_digest(F.col("text"))))
    wrong = built.proofs().where(manifest.fold(F.col("claimed"), F.col("path")) != F.lit(built.root)).collect()
    assert [r.key for r in wrong] == [3]


# --- mixing ----------------------------------------------------------------------------------------------------------

def plain_targets(sizes, weights, share, most):
    """As the contract tells it: hand out by weight, cut at the cap, hand the excess out again."""
    got, rest = [0.0] * len(sizes), share * sum(sizes)
    while rest > 1e-6:
        free = [i for i, n in enumerate(sizes) if got[i] < most * n - 1e-9]
        if not free:
            break
        whole, out = sum(weights[i] for i in free), 0.0
        for i in free:
            got[i] += rest * weights[i] / whole
            out += max(0.0, got[i] - most * sizes[i])
            got[i] = min(got[i], most * sizes[i])
        rest = out
    return got


def test_targets_and_quotients():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 5, rng.randint(0, 1000)]) for _ in range(rng.randint(0, 12))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, weights, 1.5, 2)
        assert got == pytest.approx(plain_targets(sizes, weights, 1.5, 2), abs=1e-3)
        assert sum(got) == pytest.approx(1.5 * sum(sizes))
        votes = [rng.choice([0, 1, 7, 7, rng.randint(0, 10**6)]) for _ in range(rng.randint(0, 12))]
        most, seats = [rng.choice([0, 2, 10, 500]) for _ in votes], rng.randint(0, 400)
        all_quotients = sorted((-(v / (2 * k + 1)), i) for i, (v, m) in enumerate(zip(votes, most, strict=True)) if v for k in range(m))
        naive = Counter(i for _, i in all_quotients[:seats])
        assert mixing.highest_quotients(votes, most, seats) == [naive[i] for i in range(len(votes))]


def plain_mix(rows, block=mixing.BLOCK, shards=mixing.SHARDS, seed=mixing.SEED):
    """Every word as an element of a list."""
    md5 = lambda *p: int(hashlib.md5("|".join("" if x is None else str(x) for x in p).encode()).hexdigest()[:15], 16)
    docs = [(d, s, len(re.findall(r"[^ \t-\r]+", t or ""))) for d, t, _, s, _ in rows]
    order = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, s, n in docs if s == o) for o in order]
    aims = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2)
    laid = {o: defaultdict(list) for o in order}
    hashed = [(md5(seed, d, n), i) for i, (d, s, n) in enumerate(docs)]
    for hash_, i in sorted(hashed, key=lambda x: (x[0] // shards, docs[x[1]][0] is not None, docs[x[1]][0] or 0, docs[x[1]][2])):
        laid[docs[i][1]][hash_ % shards] += [i] * docs[i][2]
    blocks = {o: {k: max(1, (2 * len(w) + block) // (2 * block)) for k, w in laid[o].items() if w} for o in order}
    votes = [int(t * sum(blocks[o].values()) / n * 65536) if n else 0 for o, t, n in zip(order, aims, sizes, strict=True)]
    given = mixing.highest_quotients(votes, [2 * sum(blocks[o].values()) for o in order], (sum(votes) + 32768) // 65536)
    took = Counter()
    for o, seats in zip(order, given, strict=True):
        keys = sorted(blocks[o])
        own = [blocks[o][k] for k in keys]
        for k, m, quota in zip(keys, own, mixing.highest_quotients(own, [2 * b for b in own], seats), strict=True):
            words, at = laid[o][k], 0
            for j in range(m):
                width = len(words) // m + (j < len(words) % m)
                step = mixing._STEPS[0] if m == 1 or m % mixing._STEPS[0] else mixing._STEPS[1]
                times = quota // m + ((j * step + md5(seed, o, k) % m) % m < quota % m)
                for i in words[at:at + width]:
                    took[i] += times
                at += width
    at = {o: i for i, o in enumerate(order)}
    return [(d, n, sizes[at[s]], aims[at[s]], took[i]) for i, (d, s, n) in enumerate(docs)]


@pytest.mark.parametrize("copies", [mixing._COPIES, 4])
def test_mix_equals_plain_version(spark, tmp_path, monkeypatch, copies):
    monkeypatch.setattr(mixing, "_COPIES", copies)
    rows = odd_docs()
    with_clashes(spark.createDataFrame(rows, DOCS)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_mixing"](spark, str(tmp_path)).collect()]
    plain = plain_mix(rows)
    # rows equal in id, source and size may swap what they took
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in plain)
    assert Counter(got) == Counter(plain)


def test_mix_cells_do_not_show(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = Counter(map(tuple, QUERIES["op11_mixing"](spark, SMALL).collect()))
    monkeypatch.setattr(mixing, "_CELL", 1)
    mixed = mixing.mix(docs.repartition(7), weights=(3, 1, 2), share=1.5, most=2)
    cut = mixed.select("doc_id", "size", "source_size", "target", mixing.taken(F.col("spans")).alias("taken"))
    assert Counter(map(tuple, cut.collect())) == whole


def test_mix_meets_targets(spark):
    for size in ("sf0.001", "sf0.01"):
        rows = QUERIES["op11_mixing"](spark, f"/root/testdata/{size}").withColumn("d", F.struct("source_size", "target"))
        assert not rows.where("taken > 2 * size OR taken < 0").count()
        for r in rows.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect():
            assert abs(r.taken * r.source_size / r["size"] - r.target) <= max(0.02 * r.target, 200), r


def test_mix_spans_are_parts_of_the_document(spark):
    docs = spark.createDataFrame(odd_docs(), DOCS)
    for r in mixing.mix(docs, weights=(1, 5), share=0.7).collect():
        ends = [x for s in r.spans for x in (s.first, s.last)]
        assert ends == sorted(ends) and all(0 <= x <= r.size for x in ends) and all(1 <= s.times <= 2 and s.first < s.last for s in r.spans)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- vector codes ----------------------------------------------------------------------------------------------------

def plain_codes(rows, parts=8, entries=16, rounds=6):
    width = Counter(len(v) for _, v, _ in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v))
    length = min(width, key=lambda n: (-width[n], n)) if width else 0
    kept = [(i, v, c) for i, v, c in rows if v and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    size = length // parts
    cut = [[tuple(math.floor(x * 4096) for x in v[p * size:(p + 1) * size]) for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    book = [[cut[i][p] for i in first] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min((distance(x, e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[best(p, v[p])[1]].append(v[p])
            book[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k], strict=True)) if own[k] else e for k, e in enumerate(book[p])]
    coded = [[best(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in c) for c in coded]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in c), e, labels[label], sha) for (i, _, label), c, e in zip(kept, coded, errors, strict=True))


def odd_vectors():
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([0, 1, None])) for i in range(90)]
    rows += [(90, None, 0), (91, [], 0), (92, [1.0] * 15 + [None], 0), (93, [float("nan")] * 16, 1), (94, [float("inf")] * 16, 1), (95, [0.0] * 24, 2),
             (96, [0.0] * 3, 2), (97, [0.0] * 16, 3), (97, [0.0] * 16, 3), (None, [0.5] * 16, None), (3, [-2.5] * 16, 4), (98, [-1e-9] * 16, 4), (99, [900.0, -900.0] * 8, 5)]
    return rows + [(200, rows[5][1], 1)] * 40


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors()[:5], odd_vectors()[90:93], [], [(i, [float(i % 3)] * 8, 0) for i in range(40)]],
                         ids=["odd", "few", "none usable", "empty", "ties"])
def test_codes_equal_plain_version(spark, tmp_path, rows):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    folder = str(tmp_path)
    with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).write.parquet(f"{folder}/embeddings.parquet")
    got = Counter(map(tuple, QUERIES["op12_vector_codes"](spark, folder).collect()))
    assert got == plain_codes(rows)


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    for spread in (3, 300, 1 << 25):
        parts = rng.integers(-spread, spread, (400, 4, 6))
        book = np.concatenate((parts[:12].transpose(1, 0, 2), parts[:4].transpose(1, 0, 2)), axis=1)  # repeats: ties
        pivots = np.stack([book[p][c] for p, c in enumerate(vector_codes.distant(book, 3))])
        codes, errors, evaluated = vector_codes.nearest(parts, vector_codes.pivot_distances(parts, pivots), book, pivots)
        all_pairs = ((parts[:, :, None, :] - book[None]) ** 2).sum(axis=3)
        assert (codes == all_pairs.argmin(axis=2)).all() and (errors == all_pairs.min(axis=2)).all()
        assert evaluated < 0.9 * all_pairs.size


def test_codes_keep_and_refuse(spark):
    rows = spark.createDataFrame([(1, [0.5] * 8, "a"), (2, [0.25] * 8, None)], "vec_id long, code array<double>, error string")
    found = vector_codes.compress(rows, "code", keep=("vec_id",), parts=4, entries=1, rounds=2)
    assert found.rows.columns == ["vec_id", "code", "error"] and found.rows.count() == 2 and found.book.shape == (4, 1, 2)
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8)], "vec_id long, embedding array<double>"))
