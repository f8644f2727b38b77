"""SentencePiece encoding with N-best segmentation, and decoding.

Method: the pieces of a public SentencePiece model that occur in a text span a lattice. Forward Viterbi
scores are the exact cost of the best way from the start to every node, so a backward A* search from the
end that uses them as its heuristic pops complete segmentations in order of score. Pieces never cross a
word boundary (a blank begins a piece), so a text's lattice is a chain of word lattices: the Viterbi scores
of a text are sums, and its N best segmentations differ from the best one in the N - 1 words of the
smallest loss only; A* runs in those.

Scores: the model's pieces are ranked (byte-pair merges), not weighted; by Zipf's law a piece of rank r gets
the log probability -ln(r + 2), in whole ten-thousandths so that sums and ties are exact. A character that
is no piece is spelled in byte pieces, each 10 below the worst piece.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.shared import small_batches, table

BLANK = "▁"
FAR = 1 << 60


class PieceLattice:
    def __init__(self, model: str, most: int = 100_000, keep: int = 256):
        """Words of more than ``keep`` characters are not kept in the cache, whose size so is bounded in bytes, too."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = [p.type for p in proto.pieces]
        normal = [i for i, k in enumerate(kinds) if k in (1, 4)]
        self.steps: dict[str, tuple[int, int] | None] = {}  # every beginning of a piece; (id, score) if it is one
        for rank, i in enumerate(normal):
            piece = proto.pieces[i].piece
            for end in range(1, len(piece)):
                self.steps.setdefault(piece[:end], None)
            self.steps[piece] = (i, -round(10_000 * math.log(rank + 2)))
        self.byte_ids = {int(proto.pieces[i].piece[3:5], 16): i for i, k in enumerate(kinds) if k == 6}
        self.byte_score = min(x[1] for x in self.steps.values() if x) - 100_000
        texts = [proto.pieces[i].piece for i in normal]
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in texts) or len(self.byte_ids) < 256:
            raise ValueError("pieces that cross words, or no byte pieces: not this kind of model")
        self.pieces = [b""] * len(kinds)
        for i in normal:
            self.pieces[i] = proto.pieces[i].piece.replace(BLANK, " ").encode()
        for byte, i in self.byte_ids.items():
            self.pieces[i] = bytes([byte])
        self._tables(texts)
        self.most, self.keep, self.new, self.old = most, keep, {}, {}
        self.longest = max(map(len, texts))
        self.lists: dict[tuple[str, int], list[tuple[int, tuple[int, ...]]]] = {}

    def best(self, word: str) -> tuple[bytes, int, int]:
        """(ids as little-endian integers, score, loss of the second-best segmentation) by forward Viterbi.
        Of equal scores the longer last piece wins."""
        n, steps = len(word), self.steps
        score, gap, came = [-FAR] * (n + 1), [FAR] * (n + 1), [None] * (n + 1)
        score[0] = 0
        for i in range(n):
            at = score[i]
            if steps.get(word[i]) is None:
                raw = word[i].encode()
                value = at + len(raw) * self.byte_score
                if value > score[i + 1]:
                    gap[i + 1], score[i + 1], came[i + 1] = value - score[i + 1], value, (i, tuple(self.byte_ids[b] for b in raw))
                else:
                    gap[i + 1] = min(gap[i + 1], score[i + 1] - value)
            for j in range(i + 1, n + 1):
                part = word[i:j]
                if part not in steps:
                    break
                found = steps[part]
                if found is not None:
                    value = at + found[1]
                    top = score[j]
                    if value > top:
                        score[j], came[j], gap[j] = value, (i, found[0]), value - top
                    elif top - value < gap[j]:
                        gap[j] = top - value
        ids, loss, j = [], FAR, n
        while j:
            loss = min(loss, gap[j])
            j, one = came[j]
            ids += one[::-1] if isinstance(one, tuple) else (one,)
        return np.array(ids[::-1], "<u4").tobytes(), score[n], min(loss, FAR)

    def _tables(self, texts: list[str]) -> None:
        """The beginnings of pieces as a table of transitions, for the characters below U+0180 and the blank
        that are pieces themselves."""
        chars = sorted(c for c in texts if len(c) == 1 and (c < "\u0180" or c == BLANK))
        self.kind = np.zeros(0x110000, np.int16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        known = set(chars)
        state = {"": 1} | {x: i for i, x in enumerate((x for x in self.steps if known.issuperset(x)), 2)}
        self.turn = np.zeros((len(state) + 2, len(chars) + 1), np.int32)
        self.piece = np.zeros((len(state) + 2, 2), np.int64)  # id and score; a score of 0 is none
        for text, i in state.items():
            if text:
                self.turn[state[text[:-1]], self.kind[ord(text[-1])]] = i
                self.piece[i] = self.steps[text] or (0, 0)

    def learn(self, words: list[str], width: int = 48) -> None:
        """``best`` of many words at once, into the cache: the same Viterbi steps on columns of words.
        Words of other characters, and long ones, go one by one."""
        words = sorted(words, key=len)
        for low in range(0, len(words), 4096):
            part = words[low : low + 4096]
            long = len(part[-1])
            if long <= width:
                codes = np.frombuffer("".join([w.ljust(long, "\0") for w in part]).encode("utf-32-le"), np.uint32).reshape(-1, long)
                codes, size = self.kind[codes], np.array([len(w) for w in part])
                fits = (codes > 0).sum(1) == size
                if fits.any():
                    own = [w for w, ok in zip(part, fits.tolist(), strict=True) if ok]
                    self.new.update(zip(own, self._columns(codes[fits], size[fits]), strict=True))
                part = [w for w, ok in zip(part, fits.tolist(), strict=True) if not ok]
            for word in part:
                self.new[word] = self.best(word)

    def _columns(self, codes: np.ndarray, size: np.ndarray) -> list[tuple[bytes, int, int]]:
        n, long = codes.shape
        score, gap = np.full((long + 1, n), -FAR), np.full((long + 1, n), FAR)
        start, which = np.zeros((long + 1, n), np.int64), np.zeros((long + 1, n), np.int64)
        score[0] = 0
        for i in range(long):
            rows = np.flatnonzero(size > i)
            state = np.ones(len(rows), np.int32)
            for j in range(i, long):
                state = self.turn[state, codes[rows, j]]
                alive = state > 0
                if not alive.all():
                    rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                found = self.piece[state]
                at = np.flatnonzero(found[:, 1])
                if not len(at):
                    continue
                r = rows[at]
                value, top = score[i, r] + found[at, 1], score[j + 1, r]
                better = value > top
                gap[j + 1, r] = np.where(better, value - top, np.minimum(gap[j + 1, r], top - value))
                b = r[better]
                score[j + 1, b], start[j + 1, b], which[j + 1, b] = value[better], i, found[at[better], 0]
        node, loss, steps = size.copy(), np.full(n, FAR), []
        every = np.arange(n)
        while (node > 0).any():
            live = node > 0
            loss = np.where(live, np.minimum(loss, gap[node, every]), loss)
            steps.append(np.where(live, which[node, every], -1))
            node = np.where(live, start[node, every], 0)
        ids = np.stack(steps[::-1], axis=1)  # each row ends with its last piece
        count = (ids >= 0).sum(1)
        data, ends = ids[ids >= 0].astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
        return [(data[e - 4 * c : e], s, x) for e, c, s, x in zip(ends, count.tolist(), score[size, every].tolist(), loss.tolist(), strict=True)]

    def into(self, word: str, end: int) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(start, ids, score) of all pieces of a word that end at ``end``, the longest first."""
        for i in range(max(0, end - self.longest), end):
            if found := self.steps.get(word[i:end]):
                yield i, (found[0],), found[1]
        if self.steps.get(word[end - 1]) is None:
            raw = word[end - 1].encode()
            yield end - 1, tuple(self.byte_ids[b] for b in raw), len(raw) * self.byte_score

    def n_best(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best (score, ids) by backward A* over the lattice, best first; of equal scores, one whose way is nearer the start goes on first.

        The forward scores make the estimate of an open way the exact score of its best completion, and the completions of open ways
        are all different; so no more than the ``n`` best open ways are ever needed, and the rest is let go. A way is its last piece
        and a pointer to the way before it: memory grows with the word's length, not with its square."""
        if (word, n) in self.lists:
            return self.lists[word, n]
        size = len(word)
        ahead = [-FAR] * (size + 1)
        ahead[0] = 0
        for j in range(1, size + 1):
            ahead[j] = max(ahead[i] + value for i, _, value in self.into(word, j) if ahead[i] > -FAR)
        ways, out = [(-ahead[size], size, 0, 0, None)], []  # (cost, node, number, score behind, way)
        made = 0
        while ways and len(out) < n:
            cost, node, _, behind, way = ways.pop(0)
            if node == 0:
                out.append((-cost, _spelled(way)))
                continue
            for start, ids, value in self.into(word, node):
                if ahead[start] > -FAR:
                    made += 1
                    insort(ways, (-(ahead[start] + value + behind), start, made, behind + value, (ids, way)))
            del ways[n - len(out) :]
        if size <= self.keep:
            if len(self.lists) > 50_000:
                self.lists.clear()
            self.lists[word, n] = out
        return out

    def words(self, text: str) -> list[str]:
        return re.findall(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+", BLANK + text.replace(" ", BLANK)) if text else []

    def encode_all(self, texts: list[str], n: int = 4) -> Iterator[list[tuple[int, bytes]]]:
        """``encode`` of every text; their new words are learnt together."""
        split = [self.words(t) for t in texts]
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        need = set().union(*split).difference(self.new)
        self.learn([w for w in need if w not in self.old])
        for w in need.intersection(self.old):
            self.new[w] = self.old[w]
        for words in split:
            yield self._ways(words, n)
        for word in need:
            if len(word) > self.keep:
                del self.new[word]

    def encode(self, text: str, n: int = 4) -> list[tuple[int, bytes]]:
        """The ``n`` best (score, ids as bytes) of a text, fewer if it has fewer; the first is the encoding."""
        return list(self.encode_all([text], n))[0]

    def _ways(self, words: list[str], n: int) -> list[tuple[int, bytes]]:
        found = list(map(self.new.__getitem__, words))
        total = sum([x[1] for x in found])
        out = [(total, b"".join([x[0] for x in found]))]
        if n == 1 or not words:
            return out
        losses = np.array([x[2] for x in found])
        places = np.flatnonzero(losses < FAR // 2)
        if len(places) > n - 1:
            places = places[np.argsort(losses[places], kind="stable")[: n - 1]]
        ways: list[tuple[int, tuple]] = [(0, ())]  # (loss, ((place, ids), ...))
        for place in sorted(places.tolist()):
            top = found[place]
            turns = [(0, ())] + [(top[1] - s, ((place, ids),)) for s, ids in self.n_best(words[place], n + 1) if np.array(ids, "<u4").tobytes() != top[0]]
            ways = heapq.nsmallest(n, [(a + b, x + y) for a, x in ways for b, y in turns])
        for loss, changes in ways[1:]:
            data = [x[0] for x in found]
            for place, ids in changes:
                data[place] = np.array(ids, "<u4").tobytes()
            out.append((total - loss, b"".join(data)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Ids of control pieces give nothing; bytes that are no UTF-8 give U+FFFD."""
        data = b"".join(map(self.pieces.__getitem__, ids))
        return data[data[:1] == b" " :].decode(errors="replace")


def _spelled(way: tuple | None) -> tuple[int, ...]:
    """The ids of a way, whose first piece is its last link."""
    out: list[int] = []
    while way is not None:
        ids, way = way
        out += ids
    return tuple(out)


_LATTICES: dict[str, PieceLattice] = {}


def lattice(model: str) -> PieceLattice:
    return _LATTICES.get(model) or _LATTICES.setdefault(model, PieceLattice(model))


def _encoded(model: str, n: int, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        pieces = lattice(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows, best = [], []
                texts = [value or "" for value in part.column(1).to_pylist()]
                for text, ways in zip(texts, pieces.encode_all(texts, n), strict=True):
                    ids = np.frombuffer(ways[0][1], "<i4")
                    decoded = pieces.decode(ids.tolist())
                    best.append(ids)
                    rows.append(
                        (len(ids), ways[0][0], zlib.crc32(ways[0][1]), [w[0] for w in ways], [zlib.crc32(w[1]) for w in ways], hashlib.sha256(decoded.encode()).hexdigest(), decoded == text)
                    )
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.bool_()]
                columns = [part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]]
                names = ["doc_id", "n_pieces", "score", "ids_crc32", "nbest_scores", "nbest_crc32", "decoded_sha256", "round_trip"]
                if with_ids:
                    offsets = np.cumsum([0, *map(len, best)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(best))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return encode


SCHEMA = "doc_id long, n_pieces long, score long, ids_crc32 long, nbest_scores array<long>, nbest_crc32 array<long>, decoded_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, model: str, n: int = 4, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``n`` best segmentations of every text: (doc_id, n_pieces, score, ids_crc32, nbest_scores,
    nbest_crc32, decoded_sha256, round_trip[, ids]), a row for each row of ``docs``. ``ids`` is the best one;
    crc32 are of ids as little-endian 32-bit integers; the decoded text is made from the ids.

    Defined cases: a null or empty text has no pieces, score 0 and one segmentation, and decodes to the empty
    text (``round_trip`` compares with the empty text for null); a text that holds U+2581 decodes with
    blanks in its place, so its ``round_trip`` is false; every other text comes back exactly. Ids may be null or
    repeat. Extra columns are ignored. One scan, no shuffle; words seen before are kept in a bounded cache."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(model, n, with_ids), SCHEMA + (", ids array<int>" if with_ids else ""))


def decode_documents(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [lattice(model).decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(decode, "doc_id long, text string")


def op2_sentencepiece(spark, sf_dir):
    """The four best segmentations of every document, and what the best one decodes to."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
