"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and, of longer words, their first 2, 3, 4
and 6 bytes, hashed to 2^20 places. The model adds a weight for each term and
the inner product of two factor vectors for each pair of terms, so that two
terms can say together what neither says alone. It is fitted on a bounded sample
of labelled rows; weights and factors go to the terms whose presence there
depends on the label, alone or together with another term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import discard, give_back, lean, ship, workdir, written
from ferngraph.llm.textblocks import BLOCK, U, Hasher, blocks, mix, segments, word_spans

BITS = 20
PREFIXES = (2, 3, 4, 6)
#: Labelled rows that a model is fitted on at most, those of the smallest hashes
#: of doc_id, and how many terms they may have in all: 4 bytes each on the driver.
SAMPLE_ROWS, SAMPLE_TERMS = 12_000, 32_000_000
#: A term needs so many sampled rows, and this log likelihood ratio (2 ln) of its
#: presence and the label (1 degree of freedom: by chance once in 2,000 terms).
LEAST_ROWS, ALONE = 3, 12.0
#: Rows of one label that a pair needs at least, and its deviance (2 ln): of its rows' labels
#: from the share that the two terms alone explain, taken SURE standard errors towards
#: what is seen. By chance once in a thousand million pairs, if that share is known.
PAIR_ROWS, TOGETHER, SURE = 8, 36.0, 3.0
#: Terms whose pairs are counted at once.
PAIR_BLOCK = 1024


def _terms(buf: np.ndarray, bounds: np.ndarray, active: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the distinct terms of a block, by text and place."""
    if len(buf) > 2 * BLOCK:  # one long text
        parts = [_terms(x, np.array([0, len(x)]), active)[1] for x in segments(buf)]
        place = np.unique(np.concatenate(parts))
        return np.zeros(len(place), np.int64), place
    s, t, start = word_spans(buf, bounds) if len(buf) else (np.empty(0, np.int64),) * 2 + (np.zeros(len(bounds), np.int64),)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hasher, doc = Hasher(buf), np.repeat(np.arange(len(bounds) - 1), np.diff(start))
    found = []
    for width in (0, *PREFIXES):
        long = np.flatnonzero(t - s > width) if width else slice(None)
        place = ((hasher(s[long], t[long] if not width else s[long] + width) * U(2 * width + 1)) >> U(64 - BITS)).astype(np.int64)
        of = doc[long]
        if active is not None:
            keep = active[place]
            place, of = place[keep], of[keep]
        found.append(of << BITS | place)
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class FactorizationMachine:
    """bias, weight per place, factors per place."""

    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def logits(self, doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(doc, self.weight[place], n)
        v = self.factors[place]
        for k in range(v.shape[1]):
            z += 0.5 * (np.bincount(doc, v[:, k], n) ** 2 - np.bincount(doc, v[:, k] ** 2, n))
        return z


def _ratio(toxic: np.ndarray, rows: np.ndarray, share: float) -> np.ndarray:
    """2 ln of the likelihood of so many toxic rows of a cell by its own share
    over that by the share of all rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.nan_to_num(toxic * np.log(toxic / (rows * share)))
        return 2 * (own + np.nan_to_num((rows - toxic) * np.log((rows - toxic) / (rows * (1 - share)))))


def _chunks(places: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows in runs of 1,024: which, their places, and the row of each place within the run."""
    for at in range(0, len(places), 1024):
        own = places[at : at + 1024]
        yield slice(at, at + len(own)), np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of truth values as bits of whole 64-bit words."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 64) * 64), bool)
    padded[:, : rows.shape[1]] = rows
    return np.packbits(padded, axis=1).view(U)


class _Postings:
    """Rows by term, toxic ones first: sets of rows as bits, pairs counted by
    block of terms."""

    def __init__(self, places: list[np.ndarray], y: np.ndarray, terms: np.ndarray):
        self.terms, self.n_toxic, self.n = terms, int(y.sum()), len(y)
        rank = np.full(1 << BITS, -1, np.int32)
        rank[terms] = np.arange(len(terms))
        number = np.empty(self.n, np.int32)
        number[np.argsort(-y, kind="stable")] = np.arange(self.n)
        own = [r[r >= 0] for r in (rank[p] for p in places)]
        term, row = np.concatenate([*own, np.empty(0, np.int32)]), np.repeat(number, [len(x) for x in own])
        order = np.lexsort((row, term))
        self.row, self.start = row[order], np.searchsorted(term[order], np.arange(len(terms) + 1))

    def rows(self, low: int, high: int) -> np.ndarray:
        """Whether each of some terms is in each row."""
        out = np.zeros((high - low, self.n), bool)
        out[np.repeat(np.arange(high - low), np.diff(self.start[low : high + 1])), self.row[self.start[low] : self.start[high]]] = True
        return out

    def pairs(self, toxic: bool, enough) -> Iterator[tuple[np.ndarray, ...]]:
        """(a, b, toxic rows, rows) of pairs of terms, by place, with PAIR_ROWS
        rows of one label and as many as enough(a, b) says."""
        side = slice(0, self.n_toxic) if toxic else slice(self.n_toxic, self.n)
        other = slice(self.n_toxic, self.n) if toxic else slice(0, self.n_toxic)
        cuts = range(0, len(self.terms), PAIR_BLOCK)
        for i in cuts:
            left = self.rows(i, min(i + PAIR_BLOCK, len(self.terms)))
            for j in range(i, len(self.terms), PAIR_BLOCK):
                right = left if i == j else self.rows(j, min(j + PAIR_BLOCK, len(self.terms)))
                count = left[:, side].astype(np.float32) @ right[:, side].astype(np.float32).T
                if i == j:
                    count = np.triu(count, 1)
                a, b = np.nonzero(count >= np.maximum(PAIR_ROWS, enough(slice(i, i + len(left)), slice(j, j + len(right)))))
                bits = [_words(x[:, other]) for x in (left, right)]
                for at in range(0, len(a), 1 << 14):
                    x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                    own, rest = count[x, y].astype(float), np.bitwise_count(bits[0][x] & bits[1][y]).sum(1, dtype=np.int64).astype(float)
                    yield x + i, y + j, own if toxic else rest, own + rest


def _logit(toxic: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the label in a cell, and their variance."""
    return np.log((toxic + 0.5) / (rows - toxic + 0.5)), 1 / (toxic + 0.5) + 1 / (rows - toxic + 0.5)


def _says_more(toxic: bool, bt: np.ndarray, b: np.ndarray, ta, ra, tb, rb, t: float, n: float) -> np.ndarray:
    """Whether a pair's rows have a label more often than both terms explain,
    whose log odds add up where they don't interact."""
    cells = [_logit(*x) for x in ((ta - bt, ra - b), (tb - bt, rb - b), (t - ta - tb + bt, n - ra - rb + b))]
    sign = 1.0 if toxic else -1.0
    expected = cells[0][0] + cells[1][0] - cells[2][0] + sign * SURE * np.sqrt(sum(v for _, v in cells))
    p = 1 / (1 + np.exp(-np.clip(expected, -30, 30)))
    seen = bt / b
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = 2 * (np.nan_to_num(bt * np.log(seen / p)) + np.nan_to_num((b - bt) * np.log((1 - seen) / (1 - p))))
    return (deviance > TOGETHER) & (sign * (seen - p) > 0)


def _joint(places: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Those terms that say with another what they don't say alone. A pair that
    says toxic has PAIR_ROWS toxic rows, so each of its terms has; every term
    that has takes part. A pair that clears needs so many clean rows that they
    are unlikely by its more toxic term, whose share is taken a standard error
    higher: terms without take no part in these."""
    n, t = float(len(y)), float(y.sum())
    toxic, rows = _counts(places, y)
    good = np.zeros(1 << BITS, bool)
    log_odds, spread = _logit(toxic, rows)
    most = log_odds + np.sqrt(spread)
    clears = (rows - toxic) * np.log1p(np.exp(np.clip(most, -30, 30))) >= TOGETHER / 2
    for says, terms in ((True, np.flatnonzero(toxic >= PAIR_ROWS)), (False, np.flatnonzero((rows - toxic >= PAIR_ROWS) & clears))):
        if len(terms) < 2:
            continue
        own = most[terms]
        least = lambda a, b, own=own: TOGETHER / 2 / np.log1p(np.exp(np.clip(np.maximum.outer(own[a], own[b]) + 1, -30, 30)))
        none = lambda a, b: 0.0
        for a, b, bt, both in _Postings(places, y, terms).pairs(says, none if says else least):
            x, z = terms[a], terms[b]
            more = _says_more(says, bt, both, toxic[x], rows[x], toxic[z], rows[z], t, n)
            good[x[more]] = good[z[more]] = True
    return np.flatnonzero(good)


def _distinct(places: list[np.ndarray]) -> np.ndarray:
    """Rows without copies and near copies of earlier ones, whose pairs would
    count as often as they were copied: those that share 8 least hashes of terms
    in one of 4 bands."""
    seen: set[tuple] = set()
    out = []
    for k, p in enumerate(places):
        if not len(p):
            continue
        least = [int(mix(p.astype(U) + U(i << BITS)).min()) for i in range(1, 33)]
        bands = [(i, *least[i : i + 8]) for i in range(0, 32, 8)]
        if seen.isdisjoint(bands):
            out.append(k)
        seen.update(bands)
    return np.array(out, np.int64)


def _counts(places: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic rows, and all rows, of each place."""
    toxic, rows = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for run, flat, row in _chunks(places):
        rows += np.bincount(flat, minlength=1 << BITS)
        toxic += np.bincount(flat, y[run][row], 1 << BITS)
    return toxic, rows


def chosen_terms(places: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The places that get weights and factors."""
    n, share = len(y), y.mean()
    toxic, rows = _counts(places, y)
    alone = _ratio(toxic, rows, share) + _ratio(y.sum() - toxic, n - rows, share)
    own = _distinct(places)
    return np.union1d(np.flatnonzero((rows >= LEAST_ROWS) & (alone > ALONE)), _joint([places[k] for k in own], y[own]))


def fit(places: list[np.ndarray], toxic: np.ndarray, factors: int = 8, rounds: int = 10, l2: float = 1e-3, seeds: tuple[int, ...] = (7, 8, 9)) -> FactorizationMachine:
    """Fit by AdaGrad on the log loss, once a seed; the mean of these models'
    logits is a factorization machine again. Of one class only, or of no rows, the
    model is the share of label 1 alone; so it is where no term tells anything."""
    n, y = len(toxic), np.asarray(toxic, float)
    size = 1 << BITS
    none = FactorizationMachine(float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))), np.zeros(size, np.float32), np.zeros((size, factors * len(seeds)), np.float32))
    if y.sum() in (0, n):
        return none
    chosen = chosen_terms(places, y)
    if not len(chosen):
        return none
    rank = np.full(size, -1, np.int32)
    rank[chosen] = np.arange(len(chosen))
    own = [r[r >= 0] for r in (rank[p] for p in places)]
    found = [_descend(own, y, len(chosen), none.bias, factors, rounds, l2, np.random.default_rng(seed)) for seed in seeds]
    out = FactorizationMachine(float(np.mean([b for b, _, _ in found])), none.weight, none.factors)
    out.weight[chosen], out.factors[chosen] = np.mean([w for _, w, _ in found], 0), np.concatenate([v for _, _, v in found], 1) / np.sqrt(len(seeds))
    return out


def _descend(own: list[np.ndarray], y: np.ndarray, terms: int, bias: float, factors: int, rounds: int, l2: float, rng: np.random.Generator) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of the terms 0, 1, ... that rows hold."""
    n = len(y)
    w, v, b = np.zeros(terms), rng.normal(0, 0.02, (terms, factors)), bias
    gw, gv, gb = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(n), max(1, n // 128)):
            i = np.concatenate([own[d] for d in batch])
            lengths = np.array([len(own[d]) for d in batch])
            of, some = np.repeat(np.arange(len(batch)), lengths), lengths > 0
            total, square = np.zeros((len(batch), factors)), np.zeros((len(batch), factors))
            vi, starts = v[i], (np.cumsum(lengths) - lengths)[some]
            if len(i):
                total[some], square[some] = np.add.reduceat(vi, starts), np.add.reduceat(vi**2, starts)
            z = b + np.bincount(of, w[i], len(batch)) + 0.5 * (total**2 - square).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            db = g.sum()
            gb += db**2
            b -= 0.2 * db / np.sqrt(gb)
            if not len(i):
                continue
            order = np.argsort(i, kind="stable")
            first = np.flatnonzero(np.diff(i[order], prepend=-1))
            u = i[order][first]
            dw = np.add.reduceat(g[of][order], first) + l2 * w[u] / len(batch)
            dv = np.add.reduceat((g[of, None] * (total[of] - vi))[order], first) + l2 * v[u] / len(batch)
            gw[u] += dw**2
            gv[u] += dv**2
            w[u] -= 0.2 * dw / np.sqrt(gw[u])
            v[u] -= 0.03 * dv / np.sqrt(gv[u])
    return float(b), w, v


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists: list[np.ndarray] = []
        for _, buf, bounds in blocks(batch.column(0)):  # text, h, toxic
            doc, place = _terms(buf, bounds, None)
            lists += np.split(place.astype(np.int32), np.searchsorted(doc, np.arange(1, len(bounds) - 1)))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([len(x) for x in lists], pa.int64()), pa.array([x.tobytes() for x in lists], pa.binary())], ["h", "toxic", "n", "places"])


MODEL = "bias double, k int, used binary, weight binary, factors binary"


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the whole bounded sample, in one task, so that the driver
    doesn't hold the sample."""
    rows = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    if rows:
        rows.sort()
        model = fit([np.frombuffer(p, np.int32) for _, p in rows], np.array([t for t, _ in rows]))
        used = np.flatnonzero((model.weight != 0) | model.factors.any(1))
        cols = [pa.array([model.bias]), pa.array([model.factors.shape[1]], pa.int32())]
        cols += [pa.array([x.tobytes()], pa.binary()) for x in (used.astype(np.int32), model.weight[used], model.factors[used])]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in MODEL.split(", ")])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on labelled documents that aren't held out, at most sample_rows of
    them and with at most SAMPLE_TERMS terms. A doc_id labelled several times counts as toxic if one label says so;
    of several texts of a doc_id the first in order teaches; null labels, and
    labels without a document, teach nothing."""
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", F.xxhash64("doc_id").alias("h"), "toxic")
    work = workdir(docs.sparkSession, "toxicity")
    sample = written(rows.mapInArrow(lean(_places), "h long, toxic double, n long, places binary"), f"{work}/sample")
    sizes = sample.select("h", "n").orderBy("h").collect()  # a number for each sampled row
    within = np.searchsorted(np.cumsum([r.n for r in sizes]), SAMPLE_TERMS, "right")
    rows = (sample if within == len(sizes) else sample.where(F.col("h") < sizes[within].h)).select("toxic", "places")
    got = rows.repartition(1).mapInArrow(lean(_fitted), MODEL).collect()
    discard(docs.sparkSession, work)
    if not got:
        return fit([], np.empty(0))
    used, weight = np.frombuffer(got[0].used, np.int32), np.frombuffer(got[0].weight, np.float32)
    model = FactorizationMachine(got[0].bias, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, got[0].k), np.float32))
    model.weight[used], model.factors[used] = weight, np.frombuffer(got[0].factors, np.float32).reshape(-1, got[0].k)
    return model


def scorer(docs: DataFrame, model: FactorizationMachine):
    """A Column function: the score, 0 to 1, of whole texts. Only texts go to
    Python and only scores come back, whatever the rows hold besides; null and
    empty texts get the score of no term."""
    ship(docs.sparkSession)
    used = np.flatnonzero((model.weight != 0) | model.factors.any(1))
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, used, model.weight[used], model.factors[used]))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bias, used, weight, factors = shared.value
        size = 1 << BITS
        rank = np.zeros(size, np.int32)
        rank[used] = np.arange(len(used))
        active = np.zeros(size, bool)
        active[used] = True
        fm = FactorizationMachine(bias, weight, factors)
        for batch in texts:
            scores = [np.empty(0)]
            for _, buf, bounds in blocks(batch):
                doc, place = _terms(buf, bounds, active)
                z = fm.logits(doc, rank[place], len(bounds) - 1)
                scores.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.array(np.concatenate(scores))
            give_back()

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= threshold) of
    every row; repeated rows are scored each, a null doc_id is not held out,
    and an empty table gives an empty result."""
    score = scorer(docs, train(docs, labels))
    out = docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows whose score is below the threshold, with their columns. Rows
    of null and empty texts and repeated rows are judged each like any other;
    an empty table stays empty."""
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # so that no name meets the score's
    score = scorer(docs, train(docs, labels))
    rows = rows.withColumn("score", score(F.col(f"c{docs.columns.index('text')}").cast("string")))
    return rows.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)
