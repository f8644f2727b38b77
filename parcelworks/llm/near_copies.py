"""Near copies by word shingles: MinHash bands find candidates, their signatures are compared in blocks, and links are verified on the whole shingle sets.

Beside SimHash groups, whose three bits find only texts that differ in few of many words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.shared import small_batches, stash
from parcelworks.llm.simhash import shingle_hashes

#: Bands and values a band: of texts alike to 0.8, one pair in 5,000 shares no band.
BANDS, ROWS = 16, 4
_DRAW = np.random.default_rng(20)
_FACTORS = (_DRAW.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFTS = _DRAW.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each of 64 rearrangements of a set of hashes, as the upper 32 bits of it."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for low in range(0, len(hashes), 2048):  # bounded memory for very long texts
            least = np.minimum(least, (hashes[low : low + 2048, None] * _FACTORS + _SHIFTS).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, bands, signs = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingle_hashes(text.as_py(), words)
                if len(hashes):
                    values = signature(hashes)
                    keys.append(node)
                    bands.append([xxhash.xxh64_intdigest(values[i : i + ROWS].tobytes(), i) - 2**63 for i in range(0, len(values), ROWS)])
                    signs.append(values.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["node", "bands", "sign"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])

    return run


def strongest_links(left: np.ndarray, right: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Which links form a forest of greatest weight: heavier ones first, each only where it joins two trees."""
    tree, kept = np.arange(size), []
    for level in np.unique(weight)[::-1]:
        at = np.flatnonzero(weight == level)
        while len(at := at[tree[left[at]] != tree[right[at]]]):
            some = at[np.unique(tree[left[at]], return_index=True)[1]]  # one link a tree, so few at a time
            for i in some.tolist():
                a, b = tree[left[i]], tree[right[i]]
                if a != b:
                    tree[tree == max(a, b)] = min(a, b)
                    kept.append(i)
    return np.array(kept, int)


def _candidates(least: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        nodes, part, own = group["node"].to_numpy(), group["part"].to_numpy(), group["i"].iloc[0] == group["j"].iloc[0]
        signs = np.stack([np.frombuffer(s, np.uint16) for s in group["sign"]])
        left, right, weight = [], [], []
        for low in range(0, len(nodes), 64):
            alike = (signs[low : low + 64, None] == signs[None]).sum(2)
            a, b = np.nonzero(alike >= least * signs.shape[1])
            w = alike[a, b]
            a = a + low
            good = (a < b) & (own | (part[a] != part[b]))  # pairs inside a part are compared in its own group
            left.append(a[good])
            right.append(b[good])
            weight.append(w[good])
        left, right, weight = (np.concatenate(x) for x in (left, right, weight))
        kept = strongest_links(left, right, weight, len(nodes))
        return pd.DataFrame({"u": nodes[left[kept]], "v": nodes[right[kept]]})

    return compare


def near_links(texts: DataFrame, words: int = 5, similarity: float = 0.8, margin: float = 0.15, part_rows: int = 1024) -> DataFrame:
    """(u, v): links between texts (node: long, text; rows of one node hold one text) whose sets of ``words``-word shingles are alike to ``similarity`` or more (Jaccard), enough to join what such links join.

    Candidates share one of 16 bands; a bucket of more than ``part_rows`` is split into parts, and each pair of parts is a group of its own. In a group, pairs whose signatures agree to
    ``similarity - margin`` are cut down to a forest of the most alike, and its links verified on whole sets. What is shuffled are signatures, and
    the sets of texts that are candidates; texts without words link with nothing."""
    signs = stash(small_batches(texts).select("node", "text").mapInArrow(_signatures(words), "node long, bands array<long>, sign binary").dropDuplicates(["node"]), "minhash")
    buckets = signs.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = stash(buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-buckets")
    member = buckets.join(sizes, ["band", "key"]).withColumn("c", F.ceil(F.col("n") / part_rows).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda x: F.struct(F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j")))
    dealt = member.select("band", "key", "node", "part", F.explode(pairs).alias("p")).select("band", "key", "node", "part", "p.i", "p.j").join(signs.select("node", "sign"), "node")
    found = stash(dealt.groupBy("band", "key", "i", "j").applyInPandas(_candidates(similarity - margin), "u long, v long").distinct(), "near-candidates")
    needed = found.select(F.col("u").alias("node")).union(found.select("v")).distinct()
    sets = stash(small_batches(texts).select("node", "text").join(needed, "node", "left_semi").mapInArrow(_sets(words), "node long, items array<long>").dropDuplicates(["node"]), "near-sets")
    both = found.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", shared.alias("s"), (F.size("a") + F.size("b")).alias("t")).where(F.col("s") >= similarity * (F.col("t") - F.col("s")) - 1e-9).select("u", "v")
