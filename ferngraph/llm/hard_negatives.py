"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

Inner products become distances: every vector c gets one more component,
sqrt(M^2 - |c|^2), where M is the largest norm, and anchors get zero. Then
|a - c|^2 = |a|^2 + M^2 - 2 a.c, so the highest scores are the nearest vectors.

Anchors are assigned to the nearest of a set of pivots. An anchor's scores with
a bounded sample of rows bound its k-th best score from below, hence the radius
within which its true neighbours lie; a band of scores is a ring between two
radii. From the anchors of a cell follow the least and largest distance to the
cell's pivot that a vector they might need can have (triangle inequality), and a
candidate is copied only to cells whose bounds hold its own distance to that
pivot. Cells of many anchors are split into blocks, candidates are dealt out by
hash, and each pair of blocks is joined exactly in one task; their short lists
are merged.

The join runs twice: positives are searched among rows of an anchor's label
(cells are kept by label bucket, so rows only go where their label may be), then
negatives within the rings that the positives' scores allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferngraph.llm.common import lean, workdir, written
from ferngraph.llm.vectors import ROWS, matrix, usable

#: Rows, those of the smallest hashes of vec_id, that give pivots and first bounds.
SAMPLE_ROWS = 2048
#: Anchors for each pivot; pivots at least and at most.
PER_PIVOT, PIVOTS = 128, (8, 1024)
#: Anchors of one task.
ANCHORS = 512
#: Buckets of labels by which cells are kept apart.
BUCKETS = 16
#: Doubles hold whole numbers below this exactly.
_EXACT = 1 << 52
_LONG = (1 << 63) - 1


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole doubles, exactly: as doubles where they
    hold them, else as Python's integers."""
    if float(np.abs(x).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * x.shape[1] < _EXACT:
        return x @ q.T
    ints = [np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (x, q)]
    return ints[0] @ ints[1].T


def _whole(s: np.ndarray) -> list[int]:
    return [max(-_LONG - 1, min(_LONG, int(v))) for v in s]


class Space:
    """The augmented space: what is shared by all tasks, of bounded size."""

    def __init__(self, sample: list, longest: float, pivots: int):
        self.ids = np.array([r.vec_id for r in sample], np.int64)
        self.labels = np.array([r.label for r in sample], object)
        self.x = np.array([r.v for r in sample], float)
        self.longest = longest
        _, first = np.unique(self.x, axis=0, return_index=True)
        self.pivots = self.augmented(self.x[np.sort(first)[:pivots]])
        #: What rounding may take from a distance.
        self.slack = 1e-6 * (1.0 + longest)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))
        return np.concatenate((x, last[:, None]), 1)

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of augmented vectors to the pivots."""
        d = (x * x).sum(1)[:, None] - 2 * (x @ self.pivots.T) + (self.pivots**2).sum(1)
        return np.sqrt(np.maximum(0.0, d))

    def anchors_to_pivots(self, x: np.ndarray) -> np.ndarray:
        return self.to_pivots(np.concatenate((x, np.zeros((len(x), 1))), 1))

    def radius(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far a vector of this score is from an anchor."""
        return np.sqrt(np.maximum(0.0, (x * x).sum(1) + self.longest**2 - 2 * score))


def band(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and largest score n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


CELLS = "row long, vec_id long, label {}, v array<double>, cell int, dist double, near double, far double"


def _cells(space: Space, k: int):
    """Anchors with their cell, the distance to its pivot, and the radii between
    which their k best rows of the same label lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, labels = matrix(pa.chunked_array([batch.column(3)]), batch.num_rows), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            d = space.anchors_to_pivots(x)
            cell = d.argmin(1) if len(x) else np.empty(0, np.int64)
            s = _products(x, space.x)
            far = np.full(len(x), np.inf)
            for i, (own, label) in enumerate(zip(ids, labels, strict=True)):
                same = np.sort(s[i, (space.labels == label) & (space.ids != own)])
                if len(same) >= k:
                    far[i] = space.radius(x[i : i + 1], np.array([float(same[-k])]))[0]
            cols = [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), pa.array(np.zeros(len(x))), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), *cols], ["row", "vec_id", "label", "v", "cell", "dist", "near", "far"])

    return run


def _rings(space: Space, k: int, low: int, high: int):
    """Anchors with positives (scores): the radii between which their negatives lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, labels = matrix(pa.chunked_array([batch.column(3)]), batch.num_rows), batch.column(2).to_pylist()
            s = _products(x, space.x)
            near, far = np.full(len(x), np.inf), np.full(len(x), -np.inf)
            for i, (label, scores) in enumerate(zip(labels, batch.column(6).to_pylist(), strict=True)):
                other = np.sort(s[i, space.labels != label])
                for p in scores:
                    least, most = band(p, low, high)
                    if least > most:
                        continue
                    known = other[(other >= least) & (other <= most)]
                    bound = float(known[-k]) if len(known) >= k else float(least)
                    radii = space.radius(x[[i, i]], np.array([float(most), bound]))
                    near[i], far[i] = min(near[i], radii[0]), max(far[i], radii[1])
            cols = [pa.array(near), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(6)), *cols, batch.column(6)], ["row", "vec_id", "label", "v", "cell", "dist", "near", "far", "scores"])

    return run


def cell_bounds(anchors: DataFrame, bucketed: bool) -> list:
    """Of each cell (and label bucket): blocks of anchors, and the least and
    largest distance to its pivot that a vector any of them needs can have. At
    most PIVOTS x BUCKETS rows."""
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int") if bucketed else F.lit(0)
    least = F.greatest(F.col("near") - F.col("dist"), F.col("dist") - F.col("far"))
    rows = anchors.where("near <= far").withColumn("bucket", bucket)
    return rows.groupBy("cell", "bucket").agg(F.min(least).alias("low"), F.max(F.col("dist") + F.col("far")).alias("high"), F.ceil(F.count("*") / ANCHORS).cast("int").alias("blocks")).collect()


def _served(space: Space, bounds: list):
    """Each candidate once for every block of anchors that it might serve."""
    by_bucket: dict[int, list] = {}
    for b in bounds:
        by_bucket.setdefault(b.bucket, []).append(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.to_pivots(space.augmented(matrix(pa.chunked_array([batch.column(3)]), batch.num_rows)))
            bucket = batch.column(4).to_numpy()
            for of, cells in by_bucket.items():
                for b in cells:
                    near = d[:, b.cell]
                    rows = np.flatnonzero((bucket == of) & (near >= b.low - space.slack) & (near <= b.high + space.slack))
                    if not len(rows):
                        continue
                    part = batch.take(pa.array(rows)).select(["vec_id", "label", "v", "c"])
                    for k in range(b.blocks):
                        group = [pa.array(np.full(len(rows), x, np.int32)) for x in (b.cell, of, k)]
                        yield pa.RecordBatch.from_arrays([*group, *part.columns], ["cell", "bucket", "block", "vec_id", "label", "v", "c"])

    return run


def _best_positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """Of each anchor its k best rows of the same label."""
        out: list[list] = [[], [], []]
        if anchors.num_rows and rows.num_rows:
            ids, labels = rows["vec_id"].to_numpy(), np.array(rows["label"].to_pylist(), object)
            s = _products(matrix(anchors["v"], anchors.num_rows), matrix(rows["v"], rows.num_rows))
            for i, (row, own, label) in enumerate(zip(anchors["row"].to_pylist(), anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), strict=True)):
                of = np.flatnonzero((labels == label) & (ids != own))
                of = of[np.lexsort((ids[of], -s[i, of]))[:k]]
                for column, values in zip(out, ([row] * len(of), ids[of].tolist(), _whole(s[i, of])), strict=True):
                    column += values
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "positive_id", "positive_score"), out, strict=True)})

    return run


def _best_negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """Of each anchor and positive the k best rows of other labels in the band."""
        out: list[list] = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            ids, labels = rows["vec_id"].to_numpy(), np.array(rows["label"].to_pylist(), object)
            s = _products(matrix(anchors["v"], anchors.num_rows), matrix(rows["v"], rows.num_rows))
            for i, (row, label, scores) in enumerate(zip(anchors["row"].to_pylist(), anchors["label"].to_pylist(), anchors["scores"].to_pylist(), strict=True)):
                other = np.flatnonzero(labels != label)
                other = other[np.lexsort((ids[other], -s[i, other]))]
                falling = -s[i, other]
                for positive, p in enumerate(scores):
                    least, most = band(p, low, high)
                    start, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    of = other[start : min(end, start + k)] if least <= most else other[:0]
                    for column, values in zip(out, ([row] * len(of), [positive] * len(of), ids[of].tolist(), _whole(s[i, of])), strict=True):
                        column += values
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("row", "place", "negative_id", "negative_score"), out, kinds, strict=True)})

    return run


def _joined(rows: DataFrame, anchors: DataFrame, space: Space, n: int, bucketed: bool, local, schema: str) -> DataFrame:
    """Every block of anchors with every block of the candidates that it may need."""
    bounds = cell_bounds(anchors, bucketed)
    if not bounds:
        return rows.sparkSession.createDataFrame([], schema)
    blocks = max(1, -(-n // ROWS))
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int") if bucketed else F.lit(0)
    kind = rows.schema["label"].dataType.simpleString()
    candidates = rows.select("row", "vec_id", "label", "v", bucket.alias("bucket"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("c"))
    candidates = candidates.mapInArrow(lean(_served(space, bounds)), f"cell int, bucket int, block int, vec_id long, label {kind}, v array<double>, c int")
    ways = F.create_map(*[F.lit(x) for b in bounds for x in (b.cell * BUCKETS + b.bucket, b.blocks)])
    group = ["cell", "bucket", "block", "c"]
    anchors = anchors.where("near <= far").withColumn("bucket", bucket)
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("row"), ways[F.col("cell") * BUCKETS + F.col("bucket")]).cast("int"))
    anchors = anchors.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return anchors.groupBy(*group).cogroup(candidates.groupBy(*group)).applyInArrow(local, schema)


def hard_negatives(table: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score: for every row where is_anchor holds, its best `positives`
    rows of the same label (all, if fewer), and for each of these the best
    `negatives` rows of other labels whose score is low to high percent of the
    positive's. Scores are integer inner products of floor(scale * x); ties go to
    the smaller vec_id.

    Rows without id or label, null vectors, vectors with null or non-finite
    components and those of an unusual length take no part. A row is no
    positive of an anchor with its own id; rows that repeat an id are anchors and
    candidates each. A positive of a negative score has no negatives. Scores
    beyond a long are cut to it after ranking, and bands follow the scores as cut.
    An empty table, or one without anchors, gives an empty result. Other columns
    are not read.
    """
    spark = table.sparkSession
    work = workdir(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    known = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("e")).where("label is not null")
    cut = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole
    rows = usable(known, "vec_id", "e", "label").select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", lambda x: cut(x * scale)).alias("v"))
    rows = written(rows, f"{work}/vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, longest, wanted = rows.agg(F.count("*"), F.sqrt(F.max(square)), F.count(F.when(is_anchor, 1))).first()
    if not wanted:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE_ROWS).select("vec_id", "label", "v").collect()
    space = Space(sample, longest * (1 + 1e-12), min(PIVOTS[1], max(PIVOTS[0], -(-wanted // PER_PIVOT))))

    kind = rows.schema["label"].dataType.simpleString()
    anchors = written(rows.where(is_anchor).mapInArrow(lean(_cells(space, positives)), CELLS.format(kind)), f"{work}/anchors")
    found = _joined(rows, anchors, space, n, True, _best_positives(positives), "row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    found = written(found, f"{work}/positives")

    scores = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score")))["positive_score"].alias("scores"))  # `positives` of them at most
    rings = anchors.drop("near", "far").join(scores, "row").select("row", "vec_id", "label", "v", "cell", "dist", "scores")
    ringed = written(rings.mapInArrow(lean(_rings(space, negatives, low, high)), CELLS.format(kind) + ", scores array<long>"), f"{work}/rings")
    got = _joined(rows, ringed, space, n, False, _best_negatives(negatives, low, high), "row long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return got.join(found, ["row", "place"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND (c.vec_id <> a.vec_id OR c.label <> a.label)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
