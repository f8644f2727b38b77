"""SimHash near-dedup with bit-sliced comparison.

Method: 64-bit fingerprints; those within three bits share two of five bit ranges, so ten tables of two
ranges each hold every pair. Inside a bucket, fingerprints are stored as bit planes, 64 of them a machine
word; the distances of a query to a whole block grow in carry-save bitwise counters, plane by plane, and a
block is abandoned once all its members are beyond the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.llm.components import connected_components, star_links
from parcelworks.llm.shared import NO_ID, small_batches, stash, table

RADIUS = 3
#: Bit ranges (start, width); any two of them are the key of a table.
RANGES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MASKS = tuple(((1 << a[1]) - 1) << a[0] | ((1 << b[1]) - 1) << b[0] for a, b in itertools.combinations(RANGES, 2))
_ONES = np.uint64(2**64 - 1)


def shingle_hashes(text: str | None, words_in: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only the six ASCII spaces split
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    one = xxhash.xxh64_intdigest
    if len(words) <= words_in:
        return np.array([one(joined, 42)], np.uint64)
    return np.fromiter((one(joined[s : e - 1], 42) for s, e in zip(starts, ends[words_in - 1 :], strict=False)), np.uint64, len(words) - words_in + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *others, texts = batch.columns
        prints = np.array([fingerprint(shingle_hashes(t.as_py())) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([*others, pa.array(prints.view(np.int64), pa.int64())], names=[*batch.schema.names[:-1], "__fp"])


def close_pairs(fp: np.ndarray, start: np.ndarray, radius: int = RADIUS, slots: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group at ``radius`` bits or less, in pieces of bounded size. ``fp``: uint64, the
    rows of a group next to each other; ``start``: the first row of each group."""
    size = np.diff(np.append(start, len(fp)))
    blocks = (size + 63) // 64
    group = np.repeat(np.arange(len(start)), blocks)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = start[group] + 64 * number  # the first row of each block of 64 lanes
    last = np.minimum(first + 64, start[group] + size[group])
    lane = (np.arange(len(fp)) - np.repeat(first, last - first)).astype(np.uint64)
    planes = np.stack([np.bitwise_or.reduceat(((fp >> np.uint64(b)) & np.uint64(1)) << lane, first) for b in range(64)])
    live = _ONES >> (np.uint64(64) - (last - first).astype(np.uint64))
    queries = last - start[group] - 1  # of a block: the rows of its group before its last row
    total = np.cumsum(queries)
    for low in range(0, int(total[-1]) if len(total) else 0, slots):
        slot = np.arange(low, min(low + slots, int(total[-1])))
        block = np.searchsorted(total, slot, side="right")
        query = start[group[block]] + slot - (total[block] - queries[block])
        ones = twos = over = np.zeros(len(slot), np.uint64)
        for bit in range(64):
            differ = planes[bit][block] ^ (np.uint64(0) - ((fp[query] >> np.uint64(bit)) & np.uint64(1)))
            carry = ones & differ
            ones = ones ^ differ
            over = over | (twos & carry)
            twos = twos ^ carry
            if bit % 8 == 7 and bit < 63:
                stay = (~over & live[block]) != 0
                if not stay.all():  # the other blocks are beyond the radius in all lanes
                    block, query, ones, twos, over = (x[stay] for x in (block, query, ones, twos, over))
        beyond = (over, over | (twos & ones), over | twos, over | twos | ones)[RADIUS - radius]
        hit = ~beyond & live[block]
        found = np.flatnonzero(hit)
        bits = np.unpackbits(hit[found].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lanes = np.nonzero(bits)
        a, b = query[found[at]], first[block[found[at]]] + lanes
        yield a[a < b], b[a < b]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (group key..., __fp, __rep) rows: from each member to the smallest row it is linked to
    in its bucket. A bucket cut by the end of a batch waits for the next one."""
    kept = None

    def linked(rows: pa.Table) -> pa.RecordBatch:
        fp = rows.column("__fp").to_numpy().view(np.uint64)
        rep = rows.column("__rep").to_numpy()
        start = np.flatnonzero(np.append(True, _changes(rows)))
        left, right = np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b in close_pairs(fp, start):
            left, right = np.append(left, a), np.append(right, b)
            if len(left) > 1 << 20:  # memory stays bounded: a star says as much as its pairs
                left, right = star_links(left, right, len(fp))
        left, right = star_links(left, right, len(fp))
        return pa.RecordBatch.from_arrays([pa.array(rep[left]), pa.array(rep[right])], names=["u", "v"])

    for batch in batches:
        rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])]).combine_chunks()
        cuts = np.flatnonzero(_changes(rows)) + 1
        cut = int(cuts[-1]) if len(cuts) else 0
        if cut:
            yield linked(rows.slice(0, cut))
        kept = rows.slice(cut)
    if kept is not None and kept.num_rows:
        yield linked(kept)


def _changes(rows: pa.Table) -> np.ndarray:
    keys = [rows.column(c).to_numpy() for c in ("__t", "__key", "__i", "__j")]
    return np.logical_or.reduce([k[1:] != k[:-1] for k in keys])


def link_fingerprints(prints: DataFrame, chunk: int = 2048) -> DataFrame:
    """(u, v) links between representatives, enough of them to join all fingerprints that are within three
    bits through chains, from (__fp, __rep), one row a fingerprint.

    A bucket of more than ``chunk`` rows is split by a hash into parts; each pair of parts is a group of its
    own, so that a task holds 2 * ``chunk`` rows whatever the bucket's size, and no pair is lost. The sizes of large buckets are
    written first, so that the join with them is broadcast, or split by AQE where a bucket is hot."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("__fp").bitwiseAND(F.lit(m - 2**64 if m >> 63 else m)).alias("key")) for i, m in enumerate(MASKS)]))
    rows = prints.select("__fp", "__rep", keys.alias("k")).select("__fp", "__rep", F.col("k.t").alias("__t"), F.col("k.key").alias("__key"))
    large = stash(rows.groupBy("__t", "__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk), "large-buckets")
    parts = rows.join(large, ["__t", "__key"], "left").withColumn("__c", F.coalesce(F.ceil(F.col("__n") / chunk), F.lit(1)).cast("int"))
    part = F.pmod(F.xxhash64("__fp"), F.col("__c")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("__c") - 1), lambda x: F.struct(F.least(x, F.col("__p")).alias("i"), F.greatest(x, F.col("__p")).alias("j")))
    dealt = parts.withColumn("__p", part).withColumn("__ij", F.explode(pairs))
    dealt = dealt.select("__t", "__key", F.col("__ij.i").alias("__i"), F.col("__ij.j").alias("__j"), "__fp", "__rep")
    together = F.count(F.lit(1)).over(Window.partitionBy("__t", "__key", "__i", "__j"))
    groups = dealt.withColumn("__size", together).where("__size > 1").drop("__size")
    return groups.mapInArrow(_links, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """(__id, keys, __fp, __group, __component), a row for each row of ``docs``; ``keys`` are long columns that are
    passed on. __group is the smallest fingerprint that a chain of links reaches, so groups stay apart whatever their
    ids are; __component is the smallest id of the group. In both id columns NO_ID stands for null.
    """
    sized = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"), *keys, F.col(text_col).alias("__text"))
    prints = stash(sized.mapInArrow(_fingerprints, ", ".join(f"{c} long" for c in ("__id", *keys, "__fp"))), "simhash")
    distinct = stash(prints.groupBy("__fp").agg(F.min("__id").alias("__least")), "simhash-distinct")
    found = connected_components(link_fingerprints(distinct.select("__fp", F.col("__fp").alias("__rep"))))
    grouped = distinct.join(found, distinct["__fp"] == found["node"], "left").select("__fp", F.coalesce("component", "__fp").alias("__group"), "__least")
    grouped = stash(grouped, "simhash-groups")
    names = stash(grouped.groupBy("__group").agg(F.min("__least").alias("__component")), "simhash-names")
    named = stash(grouped.join(names, "__group").select("__fp", "__group", "__component"), "simhash-named")
    return prints.join(named, "__fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id), a row for each row of ``docs``; component_id is the
    smallest id among all rows that a chain of links (three differing bits or fewer) joins.

    Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other. Rows of
    one id are fingerprinted one by one. A null id takes part and names a component only when all its
    members have none (then the name is null). Extra columns are ignored. An empty table gives none.

    Texts are read once, without a shuffle; what is shuffled are fingerprints. Equal fingerprints, and so
    exact copies, are one row before the search.
    """
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return simhash_groups(docs, id_col, text_col).select(
        real("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), real("__component").alias("component_id")
    )


def op9_simhash(spark, sf_dir):
    """SimHash groups of all documents."""
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
