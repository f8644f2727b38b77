"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a pair of codewords is a cell. A half's score of a codeword is the anchor's inner
product with it plus the anchor's length times the largest distance of a member from it, so the sum of both halves' scores bounds what any row of the cell can score.
A heap visits cells by falling sums (multi-sequence), and an anchor is done once no unvisited cell can change its positives or one of its windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.llm.shared import small_batches, stash, table

LONG = np.iinfo(np.int64)
#: Largest size of a scaled component; scores that pass the range of a long are held at its ends, so larger ones would change nothing.
HUGE = 1e300


def scaled(vectors: pd.Series, dim: int, scale: float) -> np.ndarray:
    """Whole-number vectors, those of fewer than ``dim`` components filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * out), -HUGE, HUGE) + 0.0  # -0.0 is 0.0


def codebook(x: np.ndarray, size: int, steps: int = 12) -> np.ndarray:
    """At most ``size`` codewords of a sample: Lloyd's steps from rows spread over it."""
    words = np.unique(x[np.linspace(0, len(x) - 1, min(size, len(x))).astype(int)], axis=0)
    with np.errstate(all="ignore"):
        for _ in range(steps):
            near = nearest(x, words)
            for i in range(len(words)):
                if (mine := x[near == i]).size:
                    words[i] = mine.mean(0)
    return np.nan_to_num(words)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.argmin(np.nan_to_num((words * words).sum(1) - 2 * (x @ words.T)), axis=1)


class Cells:
    """Rows of one shard by cell, for one label or for all. ``codes`` are the rows' nearest codewords of both halves."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], codes: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, codes[:, 1], codes[:, 0]))
        self.ids, self.labels, self.x, codes = ids[order], labels[order], x[order], codes[order]
        self.books, self.half, self.largest = books, books[0].shape[1], float(np.abs(self.x).max(initial=0.0))
        self.small = self.x.astype(np.float32) if self.largest < 2.0**24 else self.x
        named = codes[:, 0].astype(np.int64) * len(books[1]) + codes[:, 1]
        cells, first = np.unique(named, return_index=True)
        self.cells, self.stops = codes[first], np.append(first, len(codes))
        self.place = {(a, b): i for i, (a, b) in enumerate(self.cells.tolist())}
        self.used, self.radius, self.own = [], [], []
        with np.errstate(all="ignore"):
            for k, half in enumerate((self.x[:, : self.half], self.x[:, self.half :])):
                far = np.nan_to_num(np.sqrt(((half - books[k][codes[:, k]]) ** 2).sum(1)), nan=np.inf)
                radius = np.zeros(len(books[k]))
                np.maximum.at(radius, codes[:, k], far)
                self.used.append(np.unique(codes[:, k]))
                self.radius.append(radius)
                self.own.append(np.maximum.reduceat(far, first))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact whole-number inner products, held within the range of a long. Sums of whole numbers are exact in single precision below 2^24, in double below 2^53."""
        most = self.largest * float(np.abs(query).max(initial=0.0)) * max(1, len(query))
        if most < 2.0**24:
            return (self.small[rows] @ query.astype(np.float32)).astype(np.int64)
        if most < 2.0**53:
            return (self.x[rows] @ query).astype(np.int64)
        whole = [int(v) for v in query]
        sums = (sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in self.x[rows].tolist())
        return np.array([min(max(s, LONG.min), LONG.max) for s in sums], np.int64)

    def visit(self, query: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(bound of this and all later cells, bound of this cell, its number) of the occupied cells, by falling first bound: a heap over both
        halves' codewords, each by falling half-score."""
        sums, own, order = [], np.zeros(len(self.cells)), []
        with np.errstate(all="ignore"):
            for k, q in enumerate((query[: self.half], query[self.half :])):
                size, words = float(np.sqrt((q * q).sum())), self.books[k]
                dots = words @ q
                slack = 1e-9 * (np.abs(dots) + size * (np.sqrt((words * words).sum(1)) + self.radius[k])) + 1e-6
                half = np.nan_to_num(dots + size * self.radius[k] + slack, nan=np.inf)
                own = own + (dots + slack)[self.cells[:, k]] + size * self.own[k]
                by = self.used[k][np.argsort(-half[self.used[k]], kind="stable")]
                sums.append(half[by].tolist())
                order.append(by.tolist())
        own, (u, v), (a, b) = np.nan_to_num(own, nan=np.inf).tolist(), sums, order
        heap, pop, push, place, last = [(-(u[0] + v[0]), 0, 0)], heapq.heappop, heapq.heappush, self.place, len(v) - 1
        while heap:
            bound, i, j = pop(heap)
            if j < last:
                push(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                push(heap, (-(u[i + 1] + v[0]), i + 1, 0))
            n = place.get((a[i], b[j]))
            if n is not None:
                yield -bound, own[n], n


class Best:
    """The first ``size`` of (score, id) pairs: higher scores first, then smaller ids."""

    def __init__(self, size: int):
        self.size, self.rows = size, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.rows) == self.size:
            good = scores >= self.rows[-1][0]
            scores, ids = scores[good], ids[good]
        if len(scores) > self.size:
            order = np.lexsort((ids, ~scores))[: self.size]
            scores, ids = scores[order], ids[order]
        if len(scores):
            self.rows = sorted(self.rows + list(zip(scores.tolist(), ids.tolist(), strict=True)), key=lambda r: (-r[0], r[1]))[: self.size]

    def floor(self, low: float = -np.inf) -> float:
        """Rows that score less than this change nothing."""
        return self.rows[-1][0] if len(self.rows) == self.size else low


def _in_runs(cells: Cells, query: np.ndarray, need, rows: int = 256) -> Iterator[np.ndarray]:
    """Rows of the cells that may hold what ``need()`` still asks for, some cells at a time, more each time; ends when no unvisited cell can."""
    low, high = cells.stops[:-1].tolist(), cells.stops[1:].tolist()
    held, count, floor = [], 0, need()
    for bound, own, n in cells.visit(query):
        if bound < floor:
            break
        if own >= floor:
            held.append(n)
            count += high[n] - low[n]
        if count >= rows:
            yield np.concatenate([np.arange(low[i], high[i]) for i in held])
            held, count, rows, floor = [], 0, 2 * rows, need()
    if held:
        yield np.concatenate([np.arange(low[i], high[i]) for i in held])


def add_positives(cells: Cells, anchor: int, query: np.ndarray, best: Best) -> None:
    """Adds the rows of ``cells``, which are of the anchor's label, to its best ones; the anchor's own row is none."""
    for rows in _in_runs(cells, query, best.floor):
        rows = rows[~((cells.ids[rows] == anchor) & (cells.x[rows] == query).all(1))]
        best.add(cells.scores(rows, query), cells.ids[rows])


def add_negatives(cells: Cells, label: int, query: np.ndarray, windows: list[tuple[int, int, Best]]) -> None:
    """Adds rows of other labels to each window (lowest, highest score, best rows in between)."""
    need = lambda: min(best.floor(low) for low, _, best in windows)
    for rows in _in_runs(cells, query, need):
        rows = rows[cells.labels[rows] != label]
        scores = cells.scores(rows, query)
        for low, high, best in windows:
            fits = (scores >= low) & (scores <= high)
            if fits.any():
                best.add(scores[fits], cells.ids[rows[fits]])


# Tasks: shards and blocks of anchors are packed, a row each


def _packer(name: str, dim: int, scale: float, books=None):
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x = scaled(part["vec"], dim, scale)
        ids, labels = part["id"].to_numpy("<i8"), part["label"].to_numpy("<i8")
        codes = _codes(x, books).astype("<u2") if books else np.empty(0, "<u2")
        return pd.DataFrame([(part[name].iloc[0], ids.tobytes(), labels.tobytes(), x.tobytes(), codes.tobytes())], columns=[name, "ids", "labels", "vectors", "codes"])

    return pack


def _unpacked(row, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8"), np.frombuffer(row.vectors, "<f8").reshape(-1, dim)


def _codes(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = books[0].shape[1]
    return np.column_stack([nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])])


def _positives(books, dim: int, most: int):
    def search(shards: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block in blocks.itertuples(index=False):
            anchors, labels, queries = _unpacked(block, dim)
            best = [Best(most) for _ in anchors]
            for shard in shards.itertuples(index=False):
                ids, of, x = _unpacked(shard, dim)
                codes, order = np.frombuffer(shard.codes, "<u2").reshape(-1, 2), np.argsort(of, kind="stable")
                for label in np.unique(labels):
                    mine = order[np.searchsorted(of, label, "left", order) : np.searchsorted(of, label, "right", order)]
                    if len(mine):
                        cells = Cells(books, codes[mine], ids[mine], of[mine], x[mine])
                        for i in np.flatnonzero(labels == label):
                            add_positives(cells, int(anchors[i]), queries[i], best[i])
            out += [(block.block, i, int(anchors[i]), score, one) for i, b in enumerate(best) for score, one in b.rows]
        return pd.DataFrame(out, columns=["block", "i", "anchor_id", "positive_score", "positive_id"])

    return search


def _windows(books, dim: int, most: int, share: int):
    def search(shards: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block in blocks.itertuples(index=False):
            _, labels, queries = _unpacked(block, dim)
            at, tops = np.frombuffer(block.at, "<i8"), np.frombuffer(block.tops, "<i8")
            windows = {}
            for i, top in sorted(set(zip(at.tolist(), tops.tolist(), strict=True))):
                if (low := -(-share * top // 100)) <= top:
                    windows.setdefault(i, []).append((low, top, Best(most)))
            for shard in shards.itertuples(index=False):
                ids, of, x = _unpacked(shard, dim)
                cells = Cells(books, np.frombuffer(shard.codes, "<u2").reshape(-1, 2), ids, of, x)
                for i, own in windows.items():
                    add_negatives(cells, int(labels[i]), queries[i], own)
            out += [(block.block, i, top, score, one) for i, own in windows.items() for _, top, best in own for score, one in best.rows]
        return pd.DataFrame(out, columns=["block", "i", "positive_score", "negative_score", "negative_id"])

    return search


def _tops(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(part["block"].iloc[0], part["i"].to_numpy("<i8").tobytes(), part["positive_score"].to_numpy("<i8").tobytes())], columns=["block", "at", "tops"])


def mine_negatives(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    share: int = 80,
    scale: float = 256.0,
    codewords: int = 16,
    train_rows: int = 4096,
    shard_rows: int = 16_384,
    anchor_rows: int = 4096,
    run_bytes: int = 64 << 20,
    tasks: int = 64,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which ``anchors`` (on ``id``) holds and each of the first ``positives`` other rows of
    its label, the first ``negatives`` rows of other labels that score at most what the positive does and at least ``share`` percent of it. Components count as floor(``scale`` * x), scores are
    inner products; higher ones come first, then smaller ids.

    All rows are indexed and results are exact: bounds only leave out cells that cannot change them. The codebooks (``codewords`` a half) are fitted on the ``train_rows`` rows of smallest hash, and are all
    that tasks are sent beside their groups. Rows are dealt by hash into shards of about ``shard_rows``, whatever their label; anchors into blocks of at most about ``anchor_rows``, smaller ones
    while there are fewer than ``tasks`` tasks. A task holds one block and a run of shards of ``run_bytes`` at most, so its size is bounded; the number of tasks grows with rows times
    anchors. The first pass finds positives in cells of the anchor's label, the second one fills the windows below them; each sends on at most as many rows an anchor and run as it returns.

    Defined cases: rows with a null id, label or vector, or with null or non-finite components, take no part; shorter vectors are filled up with zeros; rows alike in id, label and scaled vector (by a hash of 64 bits) count
    once, and other rows of one id count as other rows; scores beyond the range of a long are held at its ends; a positive of negative score has an empty window and one of score 0 those of 0; an empty table gives no rows; extra columns are ignored, whatever their names."""
    spark = rows.sparkSession
    vec = F.col("vec")
    fits = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    every = small_batches(rows).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    whole = F.transform(vec, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-1e18)), F.lit(1e18))))
    every = every.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(fits).withColumn("__hash", F.xxhash64("id", "label", whole))
    every = stash(every.groupBy("id", "label", "__hash").agg(F.first("vec").alias("vec")), "mined-vectors")  # rows that are alike, before they are dealt to one task
    asked = every.where(anchors)
    n, n_anchors, dim = every.agg(F.count(F.lit(1)), F.count(F.when(anchors, 1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not 0 < codewords <= 65_535:
        raise ValueError("codewords: 1 to 65535")
    if not n_anchors:
        return spark.createDataFrame([], schema)
    dim = max(2, dim)
    sample = scaled(every.orderBy("__hash", "id", "label").limit(train_rows).select("vec").toPandas()["vec"], dim, scale)
    books = (codebook(sample[:, : dim // 2], codewords), codebook(sample[:, dim // 2 :], codewords))
    n_shards = -(-n // shard_rows)
    run = max(1, run_bytes // (8 * shard_rows * dim))
    n_runs = -(-n_shards // run)
    n_blocks = max(-(-n_anchors // anchor_rows), min(-(-n_anchors // 128), -(-tasks // n_runs)))

    kind = "{} long, ids binary, labels binary, vectors binary, codes binary"
    deal = lambda frame, name, count, books=None: frame.withColumn(name, F.pmod(F.xxhash64("__hash"), F.lit(count))).groupBy(name).applyInPandas(_packer(name, dim, scale, books), kind.format(name))
    shards = stash(deal(every, "shard", n_shards, books), "shards")
    blocks = stash(deal(asked, "block", n_blocks), "anchors")
    runs = shards.withColumn("run", F.floor(F.col("shard") / run)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).groupBy("block", "run")
    meet = lambda frame: runs.cogroup(frame.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_runs - 1).cast("long")))).groupBy("block", "run"))
    first = lambda frame, most, score, one, *key: frame.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(score).desc(), one))).where(F.col("rank") <= most)

    found = meet(blocks).applyInPandas(_positives(books, dim, positives), "block long, i long, anchor_id long, positive_score long, positive_id long")
    found = stash(first(found, positives, "positive_score", "positive_id", "block", "i").drop("rank"), "positives")
    tops = found.select("block", "i", "positive_score").groupBy("block").applyInPandas(_tops, "block long, at binary, tops binary")
    below = meet(blocks.join(tops, "block")).applyInPandas(_windows(books, dim, negatives, share), "block long, i long, positive_score long, negative_score long, negative_id long")
    below = first(below, negatives, "negative_score", "negative_id", "block", "i", "positive_score")
    return found.join(below, ["block", "i", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector, with every seventh label moved on by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = ((F.col("label").cast("decimal(20,0)") + 1) % 10).cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label").cast("long")))
    return mine_negatives(rows, F.col("id") % 100 == 0)


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 5
"""
