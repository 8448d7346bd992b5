import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ferngraph.llm import hard_negatives, simhash, vector_codes

ODD = [(1000, 1, None), (1020, 1, [float("nan")] * 16), (1040, 2, [None] * 16), (1060, 2, [float("inf")] * 16), (1080, 0, [1.0] * 3), (1100, 1, [])]


def vectors(spark, rows, kind="float"):
    """With columns that clash with the operators' own names."""
    table = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    return table.withColumns({"v": F.lit(1), "error": F.lit(2), "row": F.lit(3), "score": F.lit(4), "cell": F.lit(5), "of": F.lit(6)}).repartition(3)


def sample(n=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, dim)).astype(np.float32)
    x[50:150] = x[50]  # a third are copies of one vector
    label = rng.integers(0, 4, n)
    return [(k, None if k % 41 == 0 else int(label[k]), x[k].tolist()) for k in range(n)]


# vector codes


def coded(rows, parts=4, entries=256, rounds=4, scale=1024.0):
    """By brute force, in Python's integers."""
    rows = sorted(((i, lab, [int(np.floor(float(np.float32(c)) * scale)) for c in e]) for i, lab, e in rows), key=lambda r: (r[0] is None, r[0], r[2]))
    w = len(rows[0][2]) // parts
    cut = [[r[2][p * w : (p + 1) * w] for p in range(parts)] for r in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(p, s):
        return min((sum((a - b) ** 2 for a, b in zip(s, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(p, c[p])[1], []).append(c[p])
            for k, members in own.items():
                books[p][k] = [sum(m) // len(members) for m in zip(*members, strict=True)]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(rows, error, strict=True):
        by[r[1]] = by.get(r[1], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    cap = (1 << 63) - 1
    return sorted((repr(r[0]), "".join(f"{k:02x}" for _, k in f), min(cap, e), min(cap, by[r[1]]), sha) for r, f, e in zip(rows, found, error, strict=True))


def got_codes(table, **options):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(table, **options).collect())


def test_vector_codes(spark):
    rows = sample()
    assert got_codes(vectors(spark, rows + ODD)) == coded(rows)
    assert got_codes(vectors(spark, rows), entries=7, rounds=2) == coded(rows, entries=7, rounds=2)


def test_vector_codes_of_few_repeated_and_unnamed_rows(spark):
    x = [0.5, -0.25, 0.0, 1.0]
    rows = [(3, 1, x), (3, 1, [0.1, 0.2, 0.3, 0.4]), (3, None, x), (None, 2, x), (1, None, [-1.0, 0.0, 0.0, 0.0])]
    assert got_codes(vectors(spark, rows)) == coded(rows)
    assert vector_codes.vector_codes(vectors(spark, ODD[:2])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [])).count() == 0
    with pytest.raises(ValueError):
        vector_codes.vector_codes(vectors(spark, rows), entries=300)


def test_vector_codes_of_large_components(spark):
    rows = [(k, k % 2, [float(np.float32(v)) for v in (3e7 * k, -2e12, 1e15 + 1e9 * k, 5.0)]) for k in range(9)] + [(20, 0, [3e38, -3e38, 1.0, 0.0])]
    assert got_codes(vectors(spark, rows), entries=3) == coded(rows, entries=3)


def test_only_the_annulus_is_evaluated():
    rng = np.random.default_rng(1)
    entries = rng.integers(-50, 50, (256, 8)) * rng.integers(1, 40, (256, 1))
    x = (entries[rng.integers(0, 256, 2000)] + rng.integers(-3, 4, (2000, 8))).astype(float)
    book = vector_codes.Codebook(entries.astype(float))
    code, error = book.nearest(x)
    d = ((x[:, None, :] - entries) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    assert book.evaluated < 0.5 * d.size


# hard negatives


def mined(rows, anchor, positives=5, negatives=10, scale=256.0):
    x = {k: (i, lab, [int(np.floor(float(np.float32(c)) * scale)) for c in e]) for k, (i, lab, e) in enumerate(rows)}
    out = []
    for k, (a, lab, v) in x.items():
        if not anchor(a):
            continue
        score = {j: sum(p * q for p, q in zip(v, w, strict=True)) for j, (_, _, w) in x.items()}
        best = lambda js: sorted(js, key=lambda j: (-score[j], x[j][0]))
        for p in best(j for j in x if x[j][1] == lab and x[j][0] != a)[:positives]:
            fit = best(j for j in x if x[j][1] != lab and 30 * score[p] <= 100 * score[j] <= 90 * score[p])[:negatives]
            out += [(a, x[p][0], n + 1, x[j][0], score[p], score[j]) for n, j in enumerate(fit)]
    return sorted(out)


def got_negatives(table, is_anchor, **options):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in cols) for r in hard_negatives.hard_negatives(table, is_anchor, **options).collect())


@pytest.mark.parametrize("blocks", [(512, 8192), (4, 32)])
def test_hard_negatives(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(hard_negatives, "ROWS", blocks[1])
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 40)
    rows = sample(n=400, seed=2)
    kept = [r for r in rows if r[1] is not None]
    assert got_negatives(vectors(spark, rows + ODD), F.col("vec_id") % 10 == 0) == mined(kept, lambda i: i % 10 == 0)


def test_hard_negatives_by_bounds(spark, monkeypatch):
    """Clustered vectors: cells are served by few candidates, and none is lost."""
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 1, (12, 16))
    of = rng.integers(0, 12, 600)
    x = (centre[of] + rng.normal(0, 0.05, (600, 16))).astype(np.float32)
    rows = [(k, int(rng.integers(0, 3)), x[k].tolist()) for k in range(600)]
    served = []
    joined = hard_negatives._served

    def counted(space, bounds):
        d = space.to_pivots(space.augmented(np.floor(x.astype(float) * 256)))
        served.append(np.mean([(d[:, b.cell] >= b.low) & (d[:, b.cell] <= b.high) for b in bounds]))
        return joined(space, bounds)

    monkeypatch.setattr(hard_negatives, "_served", counted)
    assert got_negatives(vectors(spark, rows), F.col("vec_id") % 20 == 0) == mined(rows, lambda i: i % 20 == 0)
    assert min(served) < 0.9


def test_hard_negatives_of_odd_tables(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [0.5, 0.5]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 0, [0.5, 0.0]), (2, 2, [0.5, 0.0]), (3, 0, [-1.0, 0.0]), (0, 3, [0.5, 0.1])]
    assert got_negatives(vectors(spark, rows), F.col("vec_id") == 0) == mined(rows, lambda i: i == 0)
    assert got_negatives(vectors(spark, rows[6:7] + rows[:1]), F.lit(True)) == []  # no positives
    assert got_negatives(vectors(spark, rows), F.col("vec_id") == 99) == got_negatives(vectors(spark, ODD), F.lit(True)) == got_negatives(vectors(spark, []), F.lit(True)) == []
    huge = [(k, k % 2, [3e15 + 1e10 * k, 1.0 + k]) for k in range(6)] + [(10, 1, [2e15, 3.0]), (12, 1, [1.2e15, 1.0])]
    want = mined(huge, lambda i: i == 0, scale=1.0)
    cut = lambda s: min(s, (1 << 63) - 1)
    got = got_negatives(vectors(spark, huge), F.col("vec_id") == 0, scale=1.0)
    assert all(r[4] == (1 << 63) - 1 for r in got) and want and all(cut(r[4]) == (1 << 63) - 1 for r in want)


# SimHash


def majority(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def grouped(nodes):
    """Components of (doc_id, fingerprint) by all pairs."""
    low = {d: d for d, _ in nodes}
    changed = True
    while changed:
        changed = False
        for a, x in nodes:
            for b, y in nodes:
                if (x ^ y).bit_count() <= 3 and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return low


def test_simhash(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words, 400)) for _ in range(12)]
    texts = []
    for k, b in enumerate(base):
        texts.append(b)
        for j in range(k):
            w = b.split()
            w[int(rng.integers(0, 400))] = "other"
            texts.append(("\n\t" if j % 2 else " ").join(w).upper() if j % 3 else b)
    texts += [None, "", " \n ", "One", "one two", "ÄÖ ß Ω " * 3, "a b c", base[0]]
    rows = [(7 * k % 1009, t) for k, t in enumerate(texts)] + [(5, texts[3]), (5, texts[60]), (None, "gone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "rep": F.lit("x"), "list": F.lit(None)}).repartition(3)
    got = simhash.simhash(docs).collect()
    nodes = [(d, majority(t)) for d, t in rows if d is not None]
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((d, f"{f:016x}") for d, f in nodes)
    low = grouped(nodes)
    assert {r.doc_id: r.component_id for r in got} == low and len(set(low.values())) < len(low)
    assert simhash.simhash(docs.where("false")).count() == 0


def test_simhash_of_a_long_text():
    rng = np.random.default_rng(4)
    text = " ".join(map(str, rng.integers(0, 5000, 300_000)))
    assert len(text) > 1 << 20 and simhash.fingerprint(text.encode()) == majority(text)
    assert simhash.fingerprint(b"x" * (1 << 20)) == majority("x" * (1 << 20))


@pytest.mark.parametrize("most", [4096, 16, 4])
def test_simhash_links_of_long_lists(spark, monkeypatch, tmp_path, most):
    """A third of all fingerprints near one another, lists cut at several lengths."""
    monkeypatch.setattr(simhash, "LONG_LIST", most)
    rng = np.random.default_rng(6)
    near = [0x123456789ABCDEF0 ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (60, 3))]
    same = [0x5555AAAA00000000 | int(x) for x in rng.integers(0, 1 << 20, 80)]  # five bytes alike
    far = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = sorted(set(near + same + far))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(k, signed(f)) for k, f in enumerate(fps)], "rep long, fp long")
    links = simhash.links(classes, f"file://{tmp_path}").collect()
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 3 for r in links)
    from ferngraph.llm.components import components

    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), f"file://{tmp_path}/parts").collect()}
    low = grouped(list(enumerate(fps)))
    assert {k: got.get(k, k) for k in low} == low
    assert len(links) < 60 * 59 // 2
