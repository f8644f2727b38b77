"""Fill-in-middle transformation by a piece table.

A document is a list of descriptors (buffer, start, length) over immutable buffers: buffer 0 is its text, buffers 1 to 3 are the three
sentinels. Cutting splits a descriptor, an arrangement permutes descriptors, the inverse permutation restores the text, and hashes
stream the bytes that descriptors name; no text is copied until one is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.shared import small_batches, table

#: Sentinels of prefix, suffix and middle, as bytes; they are buffers 1, 2 and 3.
PREFIX, SUFFIX, MIDDLE = SENTINELS = (b"<P>", b"<S>", b"<M>")
#: Order in which each form lays its pieces: sentinels by buffer, and parts of the text (0 prefix, 1 middle, 2 suffix).
LAYOUT = {"psm": ((1, 0), (2, 2), (3, 1)), "spm": ((2, 2), (1, 0), (3, 1))}
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

#: (buffer, start, length)
Piece = tuple[int, int, int]


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits for a document, from a hash of the seed and its id; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def split(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and after byte ``at`` of what they name together."""
    left, right = [], []
    for buffer, start, length in pieces:
        take = min(length, max(0, at))
        if take:
            left.append((buffer, start, take))
        if take < length:
            right.append((buffer, start + take, length - take))
        at -= length
    return left, right


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """Pieces of the output: each part of the text behind its sentinel."""
    return [piece for sentinel, part in LAYOUT[form] for piece in ((sentinel, 0, len(SENTINELS[sentinel - 1])), *parts[part])]


def restore(pieces: list[Piece], form: str) -> list[Piece]:
    """Pieces of the text from those of an output: what stands behind each sentinel is put back in its place."""
    if form == "plain":
        return pieces
    order, parts, at = [part for _, part in LAYOUT[form]], [[], [], []], -1
    for piece in pieces:
        if piece[0]:
            at += 1
        else:
            parts[order[at]].append(piece)
    return [piece for part in parts for piece in part]


def pieces_of(output: bytes, form: str) -> list[Piece]:
    """Pieces of an output that is at hand as bytes: its sentinels are found in it, the rest is buffer 0. No part of the text holds a
    sentinel, so the first of each kind is it."""
    if form == "plain":
        return [(0, 0, len(output))]
    found, at = [], 0
    for sentinel, _ in LAYOUT[form]:
        place = output.index(SENTINELS[sentinel - 1], at)
        if place > at:
            found.append((0, at, place - at))
        found.append((sentinel, 0, len(SENTINELS[sentinel - 1])))
        at = place + len(SENTINELS[sentinel - 1])
    return found + ([(0, at, len(output) - at)] if at < len(output) else [])


def stream(pieces: list[Piece], text) -> Iterator[memoryview]:
    """The bytes that pieces name, a view a piece."""
    buffers = (memoryview(text), *map(memoryview, SENTINELS))
    for buffer, start, length in pieces:
        yield buffers[buffer][start : start + length]


def sha256(pieces: list[Piece], text) -> str:
    digest = hashlib.sha256()
    for view in stream(pieces, text):
        digest.update(view)
    return digest.hexdigest()


def cut(text, doc_id: int | None, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[int, str, list[list[Piece]]]:
    """(units, form, parts) of a text (bytes): pieces of its prefix, middle and suffix, all in the first part if it stays plain. Units are
    lines with their ends; both cuts lie between units."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    n, whole = len(ends), [(0, 0, len(data))] if len(data) else []
    a, b, how, which = draws(seed, doc_id)
    if not len(data) or how % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", [whole, [], []]
    low, high = (int(ends[i - 1]) if i else 0 for i in sorted((a % (n + 1), b % (n + 1))))
    before, suffix = split(whole, high)
    return n, "spm" if which % 100 < spm else "psm", [*split(before, low), suffix]


def _chars(parts: list[Piece], data: np.ndarray) -> int:
    """Code points of pieces of the text: bytes that do not continue one."""
    return sum(int(np.count_nonzero((data[s : s + n] & 0xC0) != 0x80)) for _, s, n in parts)


def transformer(seed: int, rate: int, spm: int, texts: bool, most: int = 500, size: int = 8 << 20):
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string()}
    if texts:
        kinds["output"] = pa.string()

    def transformed(doc_id: int | None, text: bytes) -> tuple:
        n, form, parts = cut(text, doc_id, seed, rate, spm)
        plain = form == "plain"
        pieces, data = parts[0] if plain else arrange(parts, form), np.frombuffer(text, np.uint8)
        chars = (None, None) if plain else (_chars(part, data) for part in parts[:2])
        row = (doc_id, n, form, *chars, sha256(pieces, text), sha256(restore(pieces, form), text))
        return (*row, b"".join(stream(pieces, text)).decode()) if texts else row

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), pc.fill_null(batch.column(1), "").cast(pa.binary()), strict=True):
                rows.append(transformed(doc_id.as_py(), text.as_py()))
                held += len(rows[-1][-1])
                if len(rows) == most or held > size:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return transform


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, texts: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) and, with ``texts``, output: each document cut at two
    places between its lines and laid out as form says: psm, spm (``spm`` of 100), or plain (the text as it is; all but ``rate`` of 100).

    No shuffle: each row is worked on where it is read, from its own bytes and descriptors. Defined cases: a null text is
    empty; empty texts, and those that hold a sentinel, stay plain, with null prefix_chars and middle_chars; a null id draws as if it
    had no digits; rows of one id draw alike; ties of both cuts give an empty middle; an empty table gives no rows; extra columns are
    ignored, whatever their names."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(transformer(seed, rate, spm, texts), FORMS + (", output string" if texts else ""))


def restored(outputs: DataFrame, text_col: str = "output", form_col: str = "form") -> DataFrame:
    """``outputs`` with ``restored``: the text that stood there before, rebuilt from output and form. Null where either is null."""

    def back(texts, forms):
        import pandas as pd

        rebuilt = []
        for text, form in zip(texts, forms, strict=True):
            if text is None or form is None:
                rebuilt.append(None)
                continue
            data = text.encode()
            rebuilt.append(b"".join(stream(restore(pieces_of(data, form), form), data)).decode())
        return pd.Series(rebuilt, dtype=object)

    return small_batches(outputs).withColumn("restored", F.pandas_udf(back, "string")(text_col, form_col))


def op11_fill_in_middle(spark, sf_dir):
    """All documents cut and arranged, with hashes of the output and of the text restored from it."""
    return fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


_DRAW = "CAST(CAST('0x' || substr(h, {}, 8) AS UBIGINT) AS BIGINT)"
OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, h, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR right(t, 1) = chr(10) THEN 0 ELSE 1 END AS n,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain, string_split(t, chr(10)) AS parts FROM d),
c AS (
  SELECT *, least({_DRAW.format(1)} % (n + 1), {_DRAW.format(9)} % (n + 1)) AS a, greatest({_DRAW.format(1)} % (n + 1), {_DRAW.format(9)} % (n + 1)) AS b, {_DRAW.format(25)} % 100 < 50 AS s FROM u),
l AS (
  SELECT *, list_transform(parts, lambda x, i: CASE WHEN i < len(parts) THEN x || chr(10) ELSE x END) AS lines FROM c),
p AS (
  SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS pre, coalesce(array_to_string(lines[a + 1:b], ''), '') AS mid, coalesce(array_to_string(lines[b + 1:], ''), '') AS suf FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN s THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN plain THEN NULL ELSE CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN plain THEN NULL ELSE CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN s THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
