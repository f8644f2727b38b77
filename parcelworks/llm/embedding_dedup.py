"""Embedding near-dedup: HNSW graphs by shard, every shard queried, cosines verified, components united."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.components import connected_components, star_links
from parcelworks.llm.hnsw import Hnsw, near_links
from parcelworks.llm.shared import NO_ID, stash, table


def _scaled(vectors: pd.Series) -> np.ndarray:
    """Vectors, each times the power of two that brings its largest component between a half and one: squares neither overflow nor vanish, and
    ordinary values keep all their digits, so their cosines stay what they are."""
    x = np.stack(vectors.to_numpy()).astype("<f8")
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))


def _unit(data: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, "<f8").reshape(rows, -1)
    return x, x / np.sqrt((x * x).sum(1))[:, None]


def _build(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["__rep", "__h1", "__h2"], kind="stable")
    x = _scaled(part["__vec"])
    graph = Hnsw(x / np.sqrt((x * x).sum(1))[:, None]).to_bytes()
    first = part.iloc[0]
    return pd.DataFrame([(first["__label"], first["__dim"], first["__shard"], len(part), part["__node"].to_numpy("<i8").tobytes(), x.tobytes(), graph)], columns=["label", "dim", "shard", "rows", "reps", "vectors", "graph"])


def _searcher(threshold: float, beam: int, audits: int):
    def search(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        """Links of one shard's graph with a run of query shards, and a row of what each audit asked and found."""
        row = own.iloc[0]
        x, unit = _unit(row["vectors"], row["rows"])
        graph, reps, out = Hnsw.from_bytes(row["graph"], unit), np.frombuffer(row["reps"], "<i8"), []
        for q in others.itertuples(index=False):
            same = q.q_shard == row["shard"]
            y, queries = (x, unit) if same else _unit(q.q_vectors, q.q_rows)
            left, right, asked, found = near_links(graph, queries, same, threshold, beam, audits)
            norms = np.sqrt((y * y).sum(1))[left] * np.sqrt((x * x).sum(1))[right]
            sure = np.concatenate([np.einsum("ij,ij->i", y[left[i : i + 65536]], x[right[i : i + 65536]]) for i in range(0, len(left), 65536)] or [norms]) / norms >= threshold
            left, right = left[sure], right[sure]
            names = reps
            if not same:
                right = right + len(y)
                names = np.concatenate([np.frombuffer(q.q_reps, "<i8"), reps])
            u, v = star_links(left, right, len(names))  # a star joins what its links join
            out.append(pd.DataFrame({"label": row["label"], "dim": row["dim"], "u": names[u], "v": names[v], "asked": 0, "found": 0}))
            out.append(pd.DataFrame([(row["label"], row["dim"], -1, -1, asked, found)], columns=["label", "dim", "u", "v", "asked", "found"]))
        return pd.concat(out)

    return search


def _counter(threshold: float):
    def count(group: pd.DataFrame) -> pd.DataFrame:
        x, n = _scaled(group["__vec"]), group["__n"].to_numpy(float)
        own, i, j = group["__p"].to_numpy(), group["__i"].iloc[0], group["__j"].iloc[0]
        links = np.zeros(len(x))
        for low in range(0, len(x), 1024):
            near = _cosines(x[low : low + 1024], x) >= threshold
            if i != j:  # links inside a part are counted in its own group
                near &= own[low : low + 1024, None] != own[None, :]
            else:
                near[np.arange(len(near)), np.arange(low, low + len(near))] = False
            links[low : low + 1024] += near @ n
        return pd.DataFrame({"__key": group["__key"], "__links": links.astype(np.int64)})

    return count


def link_embeddings(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    shard_rows: int = 8192,
    part_rows: int = 2048,
    run_bytes: int = 64 << 20,
    beam: int = 64,
    audits: int = 128,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall), a row for each row of ``rows``.

    Equal vectors of a label become one node with a count. The nodes of a label are dealt by hash into shards of
    about ``shard_rows``; each shard's graph is built in one task and written to the shared folder. A graph meets a run of
    query shards, of ``run_bytes`` of vectors at most, in one task, so a large label makes more tasks, not larger ones; every shard's
    vectors are searched in its own graph and in those of all later shards. Found links are verified in double precision and reach the
    shuffle as stars. After the components are united, links are counted exactly inside each component, in pairs of parts of
    ``part_rows`` nodes; no pair is emitted. Both the pairs of shards of a label and those of parts of a component
    grow with the square of their number. ``audit_recall`` is what the audits of the row's label found of the links and ten
    nearest neighbours they looked for (null without a label, or without vectors).

    Columns of ``rows`` whose names begin with ``__`` are not read. Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a
    null label, link with nothing: n_links 0, their own component. Vectors of other length never link. Rows of
    one id and equal vectors link with each other like any; rows of one id with other vectors share a
    component. A null id names a component only where nothing else does (null then). Extra columns are ignored.
    """
    vec = F.col(vector_col).cast("array<double>")
    fits = F.col("__label").isNotNull() & (F.size("__vec") > 0) & F.forall("__vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("__vec", lambda x: x != 0)
    every = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"), F.col(label_col).alias("__label"), vec.alias("__vec"))
    every = every.withColumn("__ok", F.coalesce(fits, F.lit(False))).withColumn("__vec", F.transform("__vec", lambda x: x + 0.0))  # -0.0 equals 0.0
    every = every.withColumns({"__h1": F.xxhash64("__vec"), "__h2": F.xxhash64(F.lit("vector"), "__vec")})
    nodes = every.where("__ok").groupBy("__label", "__h1", "__h2").agg(F.min("__id").alias("__rep"), F.count(F.lit(1)).alias("__n"), F.first("__vec").alias("__vec"))
    nodes = stash(nodes.withColumns({"__dim": F.size("__vec"), "__node": F.monotonically_increasing_id()}), "vectors")  # numbers are fixed once written

    sizes = nodes.groupBy("__label", "__dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("__shards"))
    dealt = nodes.join(sizes, ["__label", "__dim"]).withColumn("__shard", F.pmod(F.col("__h2"), F.col("__shards")))
    label = nodes.schema["__label"].dataType.simpleString()
    index = dealt.select("__label", "__dim", "__shard", "__node", "__rep", "__h1", "__h2", "__vec").groupBy("__label", "__dim", "__shard").applyInPandas(
        _build, f"label {label}, dim int, shard long, rows int, reps binary, vectors binary, graph binary"
    )
    index = stash(index, "graphs")
    runs = F.greatest(F.lit(1), F.floor(F.lit(run_bytes) / (F.lit(8 * shard_rows) * F.col("dim"))))  # query shards a task
    spread = index.join(sizes.select(F.col("__label").alias("label"), F.col("__dim").alias("dim"), "__shards"), ["label", "dim"]).withColumn("__run", runs)
    graphs = spread.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor(F.col("shard") / F.col("__run")))))
    queries = spread.select(
        *[F.col(c).alias(f"q_{c}") for c in ("label", "dim", "shard", "rows", "reps", "vectors")], F.explode(F.sequence(F.col("shard"), F.col("__shards") - 1)).alias("to_shard"), F.floor(F.col("shard") / F.col("__run")).alias("q_run")
    )
    graphs = graphs.select("label", "dim", "shard", "run", "rows", "reps", "vectors", "graph").groupBy("label", "dim", "shard", "run")
    met = graphs.cogroup(queries.groupBy("q_label", "q_dim", "to_shard", "q_run")).applyInPandas(_searcher(threshold, beam, audits), f"label {label}, dim int, u long, v long, asked long, found long")
    met = stash(met, "vector-links")
    audit = met.where("u < 0").groupBy("label").agg((F.sum("found") / F.sum("asked")).alias("__recall"))
    found = connected_components(met.where("u >= 0").select("u", "v"))

    member = nodes.join(found, nodes["__node"] == found["node"]).select("__label", "__dim", "component", F.struct("__label", "__h1", "__h2").alias("__key"), "__n", "__vec", "__h1")
    parts = stash(member.groupBy("__label", "__dim", "component").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("__c")), "component-parts")
    split = member.join(parts, ["__label", "__dim", "component"]).withColumn("__p", F.pmod("__h1", "__c").cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("__c") - 1), lambda x: F.struct(F.least(x, F.col("__p")).alias("i"), F.greatest(x, F.col("__p")).alias("j")))
    groups = split.withColumn("__ij", F.explode(both)).select("__label", "__dim", "component", F.col("__ij.i").alias("__i"), F.col("__ij.j").alias("__j"), "__p", "__key", "__n", "__vec")
    key = f"struct<__label:{label},__h1:bigint,__h2:bigint>"
    counted = groups.groupBy("__label", "__dim", "component", "__i", "__j").applyInPandas(_counter(threshold), f"__key {key}, __links long")
    counted = counted.groupBy("__key").agg(F.sum("__links").alias("__links"))
    counted = counted.select(*[F.col(f"__key.{c}").alias(c) for c in ("__label", "__h1", "__h2")], "__links")

    grouped = nodes.drop("__vec").join(found, nodes["__node"] == found["node"], "left").withColumn("__group", F.coalesce("component", "__node"))
    grouped = stash(grouped.select("__label", "__h1", "__h2", "__rep", "__n", "__group"), "vector-groups")
    names = stash(grouped.groupBy("__group").agg(F.min("__rep").alias("__component")), "vector-names")
    named = grouped.join(names, "__group").join(counted, ["__label", "__h1", "__h2"], "left")
    named = named.select("__label", "__h1", "__h2", "__component", (F.coalesce("__links", F.lit(0)) + F.col("__n") - 1).alias("__total"), F.lit(True).alias("__ok"))
    out = every.select("__id", "__label", "__h1", "__h2", "__ok").join(named, ["__label", "__h1", "__h2", "__ok"], "left")
    out = out.join(stash(audit, "vector-audit").withColumnRenamed("label", "__label"), "__label", "left")
    component = F.coalesce("__component", "__id")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("__id")).alias(id_col), F.coalesce("__total", F.lit(0)).cast("long").alias("n_links"), real(component).alias("component_id"), (component == F.col("__id")).alias("kept"), F.col("__recall").alias("audit_recall"))


def op4_embedding_dedup(spark, sf_dir):
    """Links and components of all vectors."""
    return link_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
"""
