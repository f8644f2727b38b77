"""Token-ID output: documents as token ids in ORC files.

Format: files of (doc_id, text_hash, ids array<int>), rows in ascending order of doc_id (nulls first) and text_hash within and across
files; text_hash is a 64-bit hash of the text, so that rows of one doc_id have an order, too. ORC stores the ids in stripes with integer run-length encoding; each stripe has row indexes (smallest and
largest doc_id of every ``row_index_stride`` rows) and Bloom filters on doc_id, so a reader takes stripes
in parallel and skips those that its doc_id predicate excludes.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelworks.llm.shared import shared_dir, small_batches, stash, table

#: Id appended to each document.
END_ID = 1
END_IDS = np.array([END_ID], "<u4").tobytes()
FORMAT = "doc_id long, text_hash long, ids array<int>"
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Words that the vocabulary's normalizer leaves as they are and that are one run of letters: a-z, and ß to ÿ but for the division sign.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Words that end in a letter of ASCII or up to U+017F and then ASCII punctuation. U+0130 is none of these letters: its lower case ends in a mark, which belongs to what follows.
PUNCTUATED = re.compile(rb"((?:[^<]*)(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf]))([" + re.escape(PUNCTUATION.replace(b"<", b"")) + rb"]+)").fullmatch


def _byte_letters() -> str:
    """The letter that the vocabulary writes for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(other)) for b in range(256))


class WordCache:
    """Token ids of white-space separated words, kept between tasks of one Python worker in two
    generations of bounded size. The vocabulary's normalizer makes every white-space run one blank that no
    token holds, so a text's ids are its words' ids in order."""

    def __init__(self, vocabulary: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.most, self.new, self.old, self.letters = most, {}, {}, _byte_letters()
        self.marker, self.marker_id = self._marker()

    def _marker(self) -> tuple[str, int]:
        """A word of one rare token: the last of the vocabulary that is encoded as itself."""
        for i in range(self.tokenizer.get_vocab_size(with_added_tokens=False) - 1, 0, -1):
            word = (self.tokenizer.id_to_token(i) or "").removesuffix("</w>")
            if word.isascii() and word.isalpha() and self.tokenizer.encode(word, add_special_tokens=False).ids == [i]:
                return word, i
        raise ValueError("no token is a word")

    def encode(self, words: list[bytes]) -> None:
        """Adds words that are not plain. They are encoded 200 a call with a rare word between them; if its token turns up in a word,
        too, the words of that call are encoded alone."""
        alone, between = [], f" {self.marker} "
        parts = [words[low : low + 200] for low in range(0, len(words), 200)]
        for part, encoded in zip(parts, self.tokenizer.encode_batch_fast([between.join([w.decode() for w in x]) for x in parts], add_special_tokens=False), strict=True):
            ids = array("I", encoded.ids)
            cuts = [i for i, x in enumerate(ids) if x == self.marker_id]
            if len(cuts) != len(part) - 1:
                alone += part
                continue
            for word, low, high in zip(part, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True):
                self.new[word] = ids[low:high].tobytes()
        for low in range(0, len(alone), 256):
            part = alone[low : low + 256]
            for word, one in zip(part, self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.new[word] = array("I", one.ids).tobytes()

    def _add(self, need: set[bytes]) -> None:
        """Adds the ids of words. A plain word goes straight to the library's model; a word that ends in punctuation is made of its two parts,
        since letters and other signs are never in one token; words that may hold a special token stay whole."""
        new, old = self.new, self.old
        cut, plain, other = [], [], []
        for word in need:
            if word in old:
                new[word] = old[word]
            elif PLAIN(word):
                plain.append(word)
            elif found := PUNCTUATED(word):
                cut.append((word, *found.groups()))
            else:
                other.append(word)
        for part in {x for c in cut for x in c[1:]}.difference(new, need):
            if part in old:
                new[part] = old[part]
            else:
                (plain if PLAIN(part) else other).append(part)
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for word in plain:
            text = word.decode() if word.isascii() else word.decode("latin-1").translate(letters)
            new[word] = array("I", [t.id for t in tokenize(text)]).tobytes()
        self.encode(other)
        for word, stem, tail in cut:
            new[word] = new[stem] + new[tail]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids) of texts: the ids of all of them in a row, ``END_ID`` after each, and where each ends. Each distinct word is
        looked up once.

        The vocabulary is of lower case; A-Z are lowered here so that more words are alike, unless a mark may follow one of them and
        join it, or a special token, which is of lower case, may come of it."""
        special = reduce(pc.or_, [pc.match_substring(texts, x) for x in ("<|",)] + [pc.match_substring(texts.cast(pa.binary()), x) for x in (b"\xcc", b"\xcd")])  # first bytes of U+0300 to U+037F
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.new.get, words))
        if None in found:
            places = [i for i, x in enumerate(found) if x is None]
            self._add({words[i] for i in places})
            for i in places:
                found[i] = self.new[words[i]]
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        stops = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        which = np.insert(coded.indices.to_numpy(), stops, len(found))
        out = pa.array([*found, END_IDS], pa.binary()).take(pa.array(which))
        ends = np.frombuffer(out.buffers()[1], np.int32)[1:][stops + np.arange(len(stops))] // 4
        return ends, np.frombuffer(out.buffers()[2], "<u4", ends[-1] if len(ends) else 0)


def _parts(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of ``most`` bytes together, or of one text if that is longer."""
    size, low, total = pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist(), 0, 0
    for i, n in enumerate(size):
        if i > low and total + n > most:
            yield low, i
            low, total = i, 0
        total += n
    if size:
        yield low, len(size)


_CACHES: dict[str, WordCache] = {}


def encoder(vocabulary: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = _CACHES.get(vocabulary) or _CACHES.setdefault(vocabulary, WordCache(vocabulary))
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for low, high in _parts(texts):
                ends, ids = cache.ids(texts[low:high])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(2)[low:high], lists], names=["doc_id", "text_hash", "ids"])

    return encode


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 64 << 20,
    row_index_stride: int = 10_000,
    bloom_fpp: float = 0.01,
) -> None:
    """Writes ORC files of (doc_id, text_hash, ids) in ascending order of the first two, nulls first; ids end with ``END_ID``.

    Texts are shuffled once, by ranges of (doc_id, text_hash), so that rows of one id may be spread over files, and encoded after it,
    batch by batch. A null text is empty; an empty table gives files without rows. Rows that are alike in both columns are alike in
    their ids, too. Extra columns are not written."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc()]
    tokens = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encoder(vocabulary), FORMAT)
    options = {
        "compression": "zstd",
        "orc.stripe.size": str(stripe_bytes),
        "orc.row.index.stride": str(row_index_stride),
        "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(bloom_fpp),
    }
    tokens.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text_hash, ids) of files written by ``write_tokens``. A filter on doc_id is pushed to the ORC reader."""
    return spark.read.schema(FORMAT).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        data, ends = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["file", "doc_id", "text_hash", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files: ``start`` is the number of
    ids of all documents before it. Sums run inside each file, and over one row a file between them."""
    rows = read_tokens(spark, path).select(F.col("_metadata.file_path").alias("file"), "doc_id", "text_hash", "ids")
    rows = stash(rows.mapInArrow(_digest, "file string, doc_id long, text_hash long, n_tokens long, ids_crc32 long"), "token-index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("__n"), F.min(F.struct("doc_id", "text_hash", "file")).alias("__at"))
    earlier = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "file")
    return placed.select("doc_id", (F.col("__before") + F.col("__inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark, sf_dir):
    """All documents written as token files, and what the files hold."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_index(spark, path)
