"""Quality rules with line labels: a linear-chain conditional random field marks each line as content or
boilerplate (Viterbi decoding), and the share of content decides whether a document stays.

The field learns from lines, not from whole documents: a line's label is that of most labelled documents that hold it, so that a
sentence which good pages share stays content inside a bad one; and half of its chains are spliced of runs of lines from a good
and a bad document, so that it learns where labels change.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.text_stats import SYMBOLS, base_counts
from parcelworks.llm.shared import SPACES, labelled_sample, lower_ascii, small_batches, stash, table

N_FEATURES = 9
CONTENT, BOILERPLATE = 0, 1


def line_features(lines: list[list[bytes]]) -> np.ndarray:
    """A row for each line (its words, at least one): constant, shares of symbols, exclamation marks,
    capitals, bars and digits, of words that repeat the word before, mean word length, and length."""
    out = np.empty((len(lines), N_FEATURES))
    for i, words in enumerate(lines):
        solid = b"".join(words)
        n = len(solid)
        out[i] = (
            1.0,
            (n - len(solid.translate(None, SYMBOLS))) / n,
            solid.count(b"!") / n,
            (n - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / n,
            solid.count(b"|") / n,
            (n - len(solid.translate(None, b"0123456789"))) / n,
            sum(map(operator.eq, words, words[1:])) / len(words),
            min(n / len(words), 20) / 20,
            min(np.log1p(len(words)), 6) / 6,
        )
    return out


def split_lines(data: bytes) -> list[list[bytes]]:
    return [w for line in data.split(b"\n") if (w := line.split())]


@dataclass
class Crf:
    """Scores: ``emit`` (2, features), ``move`` (2, 2) from the label above, ``start`` (2,)."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """Best labels of a chain of lines. Ties go to content."""
        scores = (features @ self.emit.T).tolist()
        (cc, cb), (bc, bb) = self.move.tolist()
        back = []
        c, b = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        for sc, sb in itertools.islice(scores, 1, None):
            back.append((c + cc < b + bc, c + cb < b + bb))
            c, b = max(c + cc, b + bc) + sc, max(c + cb, b + bb) + sb
        label = int(b > c)
        out = [label]
        for came in reversed(back):
            label = int(came[label])
            out.append(label)
        return np.array(out[::-1])


def fit_crf(chains: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 500, rate: float = 0.1, penalty: float = 1e-4) -> Crf:
    """Conditional maximum likelihood by Adam on full batches; chains are (features, labels of the lines, kind), and all kinds weigh the same.
    Forward-backward runs over all chains at once, position by position."""
    n, most = len(chains), max(len(x) for x, _, _ in chains)
    x = np.zeros((n, most, N_FEATURES))
    live = np.zeros((n, most), bool)
    gold = np.zeros((n, most, 2))
    for i, (f, y, _) in enumerate(chains):
        x[i, : len(f)], live[i, : len(f)] = f, True
        gold[i, np.arange(len(f)), y] = 1
    spread = x[live].std(0)
    spread[spread < 1e-6] = 1.0  # a feature that does not vary
    x /= spread
    kind = np.array([k for _, _, k in chains])
    weight = 1.0 / (len(np.unique(kind)) * np.bincount(kind)[kind])
    flat = np.zeros(2 * N_FEATURES + 6)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    after = live[:, 1:]
    for step in range(1, steps + 1):
        emit, move, start = flat[: 2 * N_FEATURES].reshape(2, -1), flat[2 * N_FEATURES : -2].reshape(2, 2), flat[-2:]
        s = x @ emit.T
        a, b = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        a[:, 0] = s[:, 0] + start
        for t in range(1, most):
            a[:, t] = np.where(live[:, t, None], s[:, t] + np.logaddexp(a[:, t - 1, :1] + move[0], a[:, t - 1, 1:] + move[1]), a[:, t - 1])
        for t in range(most - 2, -1, -1):
            nxt = b[:, t + 1] + s[:, t + 1]
            b[:, t] = np.where(live[:, t + 1, None], np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:]), 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - z[:, None, None]) * live[..., None]
        pair = np.exp(a[:, :-1, :, None] + move + (b[:, 1:] + s[:, 1:])[:, :, None, :] - z[:, None, None, None]) * after[..., None, None]
        d = (gold - p) * weight[:, None, None]
        both = gold[:, :-1, :, None] * gold[:, 1:, None, :] - pair
        grad = np.concatenate([np.einsum("ntk,ntf->kf", d, x).ravel(), np.einsum("ntij,n->ij", both, weight).ravel(), d[:, 0].sum(0)]) - penalty * flat
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        flat = flat + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(flat[: 2 * N_FEATURES].reshape(2, -1) / spread, flat[2 * N_FEATURES : -2].reshape(2, 2), flat[-2:])


def labelled_chains(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_docs: int, chain: int, max_chains: int) -> DataFrame:
    """(quality, x, y): line features and labels of chains of at most ``chain`` lines, ``max_chains`` // 2 of either quality, those of the
    smallest hashes. Everything up to here is made on the executors; of several rows of one id the one of the smallest text hash counts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    sample = rows.join(F.broadcast(labelled_sample(labels, "quality", max_docs)), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    lines = sample.select("doc_id", "label", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    lines = stash(lines.withColumn("key", F.xxhash64(F.trim(lower_ascii(F.col("line")), F.lit(SPACES)))), "labelled-lines")
    votes = lines.groupBy("key").agg((F.avg("label") < 0.5).cast("int").alias("y"))  # ties are content
    placed = lines.join(votes, "key").withColumn("no", F.floor(F.col("pos") / chain))
    chains = placed.groupBy("doc_id", "label", "no").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "y"))).alias("lines"))
    halves = [chains.where(F.col("label") == q).orderBy(F.xxhash64("doc_id", "no"), "doc_id", "no").limit(max_chains // 2) for q in (0, 1)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for lines in batch.column(1).to_pylist():
                x.append(line_features([r["line"].encode().split() for r in lines]).astype("<f4").tobytes())
                y.append(bytes(r["y"] for r in lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["quality", "x", "y"])

    return halves[0].unionByName(halves[1]).select("label", "lines").mapInArrow(make, "quality int, x binary, y binary")


def spliced(good: list[tuple], bad: list[tuple], chain: int, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains made of runs of one to eight lines of a good and a bad chain in turn."""
    rng, out = np.random.default_rng(seed), []
    for i in range(max(len(good), len(bad))):
        two, at = (good[i % len(good)], bad[i % len(bad)]), [0, 0]
        side, x, y = int(rng.integers(2)), [], []
        while sum(map(len, y)) < chain and (at[0] < len(two[0][1]) or at[1] < len(two[1][1])):
            run = slice(at[side], at[side] + int(rng.integers(1, 9)))
            x.append(two[side][0][run])
            y.append(two[side][1][run])
            at[side], side = run.stop, 1 - side
        out.append((np.concatenate(x)[:chain], np.concatenate(y)[:chain]))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2000, chain: int = 32, max_chains: int = 4000) -> Crf:
    """Fits on at most ``max_docs`` labelled documents, half of each quality, those of the smallest hashes of
    their ids, cut into chains of ``chain`` lines, at most ``max_chains`` of them, half of each quality; and on as many spliced ones. The driver
    holds their features, ``max_chains`` * ``chain`` rows at most, and no text. Without labels of both kinds, a plain rule
    stands in: lines of symbols, capitals or bars are boilerplate."""
    both: tuple[list, list] = ([], [])
    for row in labelled_chains(docs, labels, id_col, text_col, max_docs, chain, max_chains).collect():
        both[row.quality].append((np.frombuffer(row.x, "<f4").reshape(-1, N_FEATURES).astype(float), np.frombuffer(row.y, np.uint8).astype(int)))
    bad, good = (sorted(part, key=lambda c: (c[0].tobytes(), c[1].tobytes())) for part in both)  # whatever order they come in
    if not bad or not good:
        emit = np.zeros((2, N_FEATURES))
        emit[1] = (-3, 20, 30, 6, 30, 0, 0, 0, 0)
        return Crf(emit, np.eye(2), np.zeros(2))
    order = np.random.default_rng(5).permutation
    mixed = spliced([good[i] for i in order(len(good))], [bad[i] for i in order(len(bad))], chain)
    return fit_crf([(x, y, k) for k, part in enumerate((good, bad, mixed)) for x, y in part])


def judged(model: Crf, min_words: int, max_repeat: int, min_content: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                words = data.split()
                counts = base_counts(data, words)
                failed = len(words) < min_words or 100 * counts[3] > max_repeat * len(words)
                lines = split_lines(data)
                content = 0
                if lines:
                    label = model.viterbi(line_features(lines))
                    content = int(np.array([len(x) for x in lines])[label == CONTENT].sum())
                share = content / len(words) if words else 0.0
                rows.append((len(words), *counts, failed, share, not failed and share >= min_content))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=NAMES)

    return judge


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge_quality(
    docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat: int = 30, min_content: float = 0.5
) -> DataFrame:
    """(doc_id, base counts, base_failed, content_share, kept), a row for each row of ``docs``: the share of
    words in lines that the field marks as content decides, unless the base rules fail the document.

    Defined cases: a null, empty or blank text has no words, fails the base rules, and has share 0. Lines
    without words are no part of the chain. Ids may be null or repeat. Extra columns are ignored. One scan, no
    shuffle; a text is held once, whatever its length."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judged(model, min_words, max_repeat, min_content), SCHEMA)


def op5_line_quality(spark, sf_dir):
    """Base rules and line labels of all documents; the field is fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, train(docs, table(spark, sf_dir, "labels")))
