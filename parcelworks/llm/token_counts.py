"""Token counts, with huge documents encoded in overlapping chunks.

A document longer than a chunk becomes rows of chunks, each of which runs on into the next one. A chunk's encoding tells where its words
end and how many tokens lie before each end. Two neighbours are spliced where both end a word at one place of what they share; documents with a
pair that has no such place are cut again into chunks and overlaps four times as wide.

Why such a place is stable: the byte-level pre-tokenizer goes from left to right without looking back, none of its alternatives takes a sign
that is no white space and then white space, and no special string holds white space. So every place between such two is a border of words
in the whole text as well, and what lies before it and after it is encoded alike with and without the other side. Other kinds of
vocabulary are refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.llm.shared import small_batches, stash, table
from parcelworks.llm.token_files import _byte_letters as byte_letters

#: White space of Unicode (property White_Space) apart from the blank, and four controls that some libraries count as well; for a class of signs.
OTHER_SPACE = "\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White_Space as the pre-tokenizer has it: without those controls.
SPACE = " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the white space before it, or white space at the end of a text.
WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_LETTERS, _SIGNS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+", rb"[!-/:;=-@\[-`{-~]+"
#: Words of letters (ASCII or up to U+00FF) and ASCII punctuation but for <, alone or on both sides of a line end: each group is one word of the pre-tokenizer.
PARTS = re.compile(b"( ?%b)(%b)?(?:(\n)(%b)(%b)?)?" % (_LETTERS, _SIGNS, _LETTERS, _SIGNS)).fullmatch


class WordCounter:
    """Numbers of tokens of words, kept between tasks of one Python worker in two generations of bounded size. A key of the cache is a word
    with the white space before it."""

    def __init__(self, vocabulary: str, most: int = 200_000):
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            parts = json.load(f)
        split = parts.get("pre_tokenizer") or {}
        specials = [t["content"] for t in parts.get("added_tokens") or []]
        fits = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not parts.get("normalizer")
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in parts.get("added_tokens") or [])
        if not fits or not plain or not all(WORD.fullmatch(s) for s in specials) or any("<" not in s for s in specials):
            raise ValueError("the vocabulary is not byte-level, or its special strings are not of one word with a <")
        self.tokenizer, self.most, self.new, self.old, self.letters = Tokenizer.from_file(vocabulary), most, {}, {}, byte_letters()
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _add(self, need: set[bytes]) -> None:
        """Counts words and keeps the numbers: those that ``PARTS`` knows are the sum of their parts, which go straight to the library's model; the others go
        to the library whole."""
        new, old, tokenize, letters = self.new, self.old, self.tokenizer.model.tokenize, self.letters
        other = []
        for word in need:
            if word in old:
                new[word] = old[word]
            elif found := PARTS(word):
                total = 0
                for part in found.groups():
                    if part is not None:
                        n = new.get(part) or old.get(part)
                        if n is None:
                            n = len(tokenize(part.decode("latin-1").translate(letters)))
                        new[part] = n
                        total += n
                new[word] = total
            else:
                other.append(word)
        for low in range(0, len(other), 4096):
            part = other[low : low + 4096]
            for word, one in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                new[word] = len(one)

    def counts(self, words: list[bytes]) -> list[int]:
        """Tokens of each word."""
        found = list(map(self.new.get, words))
        if None in found:
            places = [i for i, n in enumerate(found) if n is None]
            self._add({words[i] for i in places})
            for i in places:
                found[i] = self.new[words[i]]
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        return found

    def ends(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stops, ends, before) of texts: how many words there are up to each text's end, at which code point of its text each word ends, and the
        tokens of the text up to there. Texts in which a blank follows other white space are cut by ``WORD``, the others at blanks."""
        rough = pc.match_substring_regex(texts, f"^[ {OTHER_SPACE}]? |[ {OTHER_SPACE}] | $")
        smooth = texts.filter(pc.invert(rough))
        split = pc.split_pattern(smooth, " ")
        words = split.flatten()
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        spaced = np.ones(len(words), bool)
        spaced[first] = False
        words = pc.binary_join_element_wise(pa.array([" ", ""]).take(pa.array((~spaced).astype(np.int8))), words, "")
        coded = words.dictionary_encode()
        number = np.array(self.counts(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()), np.int64)
        tokens, size = number[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64), pc.utf8_length(words).to_numpy().astype(np.int64)
        a = iter(_cut(tokens, size, np.append(first, len(words))))
        out = []
        for text, odd in zip(texts, rough.to_pylist(), strict=True):
            if odd:
                own = WORD.findall(text.as_py())
                out.append((np.cumsum([len(w) for w in own]), np.cumsum(self.counts([w.encode() for w in own]))))
            else:
                out.append(next(a))
        stops = np.cumsum([len(x) for x, _ in out])
        return stops, *(np.concatenate([o[k] for o in out] or [np.empty(0)]).astype(np.int64) for k in (0, 1))


def _cut(tokens: np.ndarray, size: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        yield np.cumsum(size[low:high]), np.cumsum(tokens[low:high])


_COUNTERS: dict[str, WordCounter] = {}


def _counter(vocabulary: str) -> WordCounter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _COUNTERS.get(vocabulary) or _COUNTERS.setdefault(vocabulary, WordCounter(vocabulary))


def _runs(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Texts in runs of ``most`` bytes together, or of one text if that is longer."""
    low = held = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if i > low and held + size > most:
            yield texts[low:i]
            low, held = i, 0
        held += size
    if low < len(texts):
        yield texts[low:]


def _totals(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            totals = []
            for texts in _runs(batch.column(1)):
                stops, _, before = counter.ends(texts)
                starts = np.append(0, stops[:-1])
                totals += [int(before[b - 1]) if b > a else 0 for a, b in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return count


CHUNK = "row long, no long, total long, early map<long,long>, late map<long,long>"


def _chunks(vocabulary: str, chunk: int, overlap: int):
    """For each chunk its tokens, and the tokens before each place where a word ends in the part shared with the chunk before (``early``) and after it (``late``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, kind = _counter(vocabulary), pa.map_(pa.int64(), pa.int64())
        for batch in batches:
            numbers, out, done = batch.column(1).to_pylist(), [], 0
            for texts in _runs(batch.column(2)):
                stops, ends, before = counter.ends(texts)
                for text, low, high in zip(texts, np.append(0, stops[:-1]), stops, strict=True):
                    at, n, size = ends[low:high], before[low:high], len(text.as_py())
                    here = at < size  # a word that the chunk's end may have cut is none
                    start = numbers[done] * chunk
                    zones = (here & (at <= overlap), here & (at >= chunk))
                    out.append((int(n[-1]) if len(n) else 0, *(list(zip((at[z] + start).tolist(), n[z].tolist(), strict=True)) for z in zones)))
                    done += 1
            columns = list(zip(*out, strict=True)) or [[], [], []]
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), kind, kind), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["row", "no", "total", "early", "late"])

    return encode


def _pieces(text: Column, chunk: int, overlap: int) -> Column:
    """Chunks of a text with their numbers; the last one is never shorter than the overlap that it shares."""
    last = F.greatest(F.lit(0), F.ceil((F.char_length(text) - overlap) / F.lit(chunk)) - 1)
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.struct(i.alias("no"), F.substring(text, (i * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("piece")))


def _spliced(chunks: DataFrame) -> DataFrame:
    """(row, n_tokens): tokens of each document, null where two of its chunks share no place where a word ends."""
    after = F.lead("early").over(Window.partitionBy("row").orderBy("no"))
    place = F.array_max(F.array_intersect(F.map_keys("late"), F.map_keys("__after")))
    pairs = chunks.withColumn("__after", after).withColumn("__at", place)
    own = F.when(F.col("__after").isNull(), F.col("total")).otherwise(F.element_at("late", F.col("__at")) - F.element_at("__after", F.col("__at")))
    sums = pairs.withColumn("__own", own).groupBy("row").agg(F.sum("__own").alias("n_tokens"), F.max(F.col("__own").isNull()).alias("__open"))
    return sums.select("row", F.when(~F.col("__open"), F.col("n_tokens")).alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 512, widen: int = 4) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), a row for each row: the UTF-8 bytes of the text and its tokens as the tokenizers library gives them for a
    byte-level vocabulary file, without added ones; special strings in the text count as special tokens.

    Documents of at most ``chunk`` code points are encoded where they are read. Longer ones are written once to the shared folder with a number
    each; their chunks, ``overlap`` code points longer than ``chunk``, are dealt over all tasks and encoded apart, so one huge document is many rows. Chunks meet by a window over one
    document's chunks, which hold numbers and places, no text. Documents whose chunks do not all align are taken again with ``widen`` times the chunk and
    overlap, until a chunk holds them whole, so a run without white space ends as one chunk.

    Defined cases: a null text is empty and has no tokens; rows of one id, or of none, are counted apart; an empty table
    gives no rows; extra columns are ignored, whatever their names."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    huge = F.char_length("text") > chunk
    short = rows.where(~huge).mapInArrow(_totals(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    long = stash(rows.where(huge).withColumn("row", F.monotonically_increasing_id()), "huge-texts")
    todo, done = long, []
    while True:
        parts = todo.select("row", F.explode(_pieces(F.col("text"), chunk, overlap)).alias("__p")).select("row", "__p.*").repartition("row", "no")
        spliced = stash(_spliced(parts.mapInArrow(_chunks(vocabulary, chunk, overlap), CHUNK)), "huge-counts")
        done.append(spliced.where("n_tokens IS NOT NULL"))
        open_ = spliced.where("n_tokens IS NULL")
        if open_.isEmpty():
            break
        todo, chunk, overlap = long.join(open_.select("row"), "row", "left_semi"), chunk * widen, overlap * widen
    counted = done[0]
    for more in done[1:]:
        counted = counted.unionByName(more)
    told = long.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(counted, "row")
    return short.unionByName(told.select("doc_id", "n_bytes", "n_tokens"))


def op12_token_counts(spark, sf_dir):
    """Tokens of all documents, and which of them have more than 512."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
