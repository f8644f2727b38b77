"""Line dedup: lines that many documents share stay in one document only.

Method: explode normalised lines, hash, count distinct documents per hash, drop lines over the
threshold, reassemble by position. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.shared import NO_ID, SPACES, lower_ascii, stash


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line with a key: document, position, 128-bit hash of the key."""
    lines = docs.select("__did", "__th", F.posexplode(_lines(F.col("__text"))).alias("__pos", "__line"))
    key = F.trim(lower_ascii(F.col("__line")), F.lit(SPACES))
    lines = lines.select("__did", "__th", "__pos", key.alias("__key")).where(F.char_length("__key") >= min_chars)
    return lines.select("__did", "__th", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("line"), F.col("__key")).alias("__h2"))


def _repeated(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys in at least ``min_docs`` distinct documents, and the smallest document that holds each."""
    if min_docs == 2:  # two different documents exist when smallest and largest differ: one pass of partial aggregates
        found = lines.groupBy("__h1", "__h2").agg(F.min("__did").alias("__first"), F.max("__did").alias("__last"))
        return found.where("__first < __last").drop("__last")
    found = lines.groupBy("__h1", "__h2", "__did").agg(F.lit(1).alias("__one")).groupBy("__h1", "__h2")
    return found.agg(F.min("__did").alias("__first"), F.count(F.lit(1)).alias("__docs")).where(F.col("__docs") >= min_docs).drop("__docs")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with every column kept, ``text_col`` without its dropped lines, and two more columns,
    ``n_lines`` (before dropping) and ``n_dropped``; existing columns of these names are replaced.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents keep their lines only in
    the document with the smallest id that holds them (all of them, if it holds several).

    Column names that begin with two underscores are reserved.

    Defined cases: a null or empty text is one empty line and comes back as an empty text. Rows of
    null id count as one document that comes last. Rows of the same id count as one document; each
    is cleaned by itself. An empty table gives an empty table.

    At scale: the counts are pre-aggregated on the map side, and the repeated keys are written to the shared folder. The
    (document, position, hash) rows are then joined with that table, so that a hot line comes straight out of a shuffle on
    both sides and AQE's skew join splits it (an aggregated side it would not split). The dropped positions are written as
    well, for the same reason; texts are shuffled once, by document, for reassembly.
    """
    base = docs.withColumns({"__did": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__text": F.coalesce(F.col(text_col), F.lit(""))}).withColumn("__th", F.xxhash64("__text"))
    lines = _keyed(base, min_chars)
    repeated = stash(_repeated(lines, min_docs), "repeated-lines")
    gone = lines.join(repeated, ["__h1", "__h2"]).where("__did > __first")
    dropped = stash(gone.groupBy("__did", "__th").agg(F.collect_set("__pos").alias("__gone")), "dropped-lines")
    whole = base.withColumn("__all", _lines(F.col("__text"))).drop("__text", *[text_col] * (text_col != "__text"))
    joined = whole.join(dropped, ["__did", "__th"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.coalesce("__gone", F.array().cast("array<int>")))
    return joined.withColumns(
        {
            text_col: F.array_join(F.transform(stay, lambda i: F.get(F.col("__all"), i)), "\n"),
            "n_lines": F.size("__all").cast("long"),
            "n_dropped": F.size(F.coalesce("__gone", F.array().cast("array<int>"))).cast("long"),
        }
    ).select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op3_line_dedup(spark, sf_dir):
    """Line dedup of all documents: counts of lines and a digest of what is kept."""
    from parcelworks.llm.shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
lines AS (
  SELECT row_id, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM base),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
many AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.*, many.k IS NOT NULL AND keyed.doc_id > many.first_doc AS gone FROM keyed LEFT JOIN many ON keyed.k = many.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id, doc_id
"""
