"""Fill-in-middle, token counts and hard negatives on rows that are hard to handle, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelworks.llm import entry, fill_in_middle, hard_negatives, token_counts
from tests.compare import same

random.seed(11)
SIGNS = ["a", "b", " ", " ", "\n", "\t", "'s", "'re", "'", "é", "ß", "日", "🙂", "<|endoftext|>", "<|", "|>", "　", " ", "\x1c", "\x85", "9", "12", ".", "!?", "́", "A", "The ", "\xa0", "word\nWord", "x,"]
ODD = ["".join(random.choice(SIGNS) for _ in range(random.randrange(30))) for _ in range(400)]
TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc\n", "a\nb\nc", "has <S> inside\nx", "<P>", "ends <M", "\r\n mixed \r\n", " ", "x" * 5000, "日本語\n" * 300, "no end " * 900]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(TEXTS + ODD)] + [(3, "twice"), (3, "twice"), (3, "other\ntext"), (-5, "below\nzero\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n", "form", "row", "n_tokens", "no", "output", "id", "__hash", "restored"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(3)


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Fill-in-middle


def plain_transform(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (8, 60, 0), (9, 0, 100)])
def test_fill_in_middle(docs, seed, rate, spm):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in docs.collect():
        n, form, p, m, out = plain_transform(r.doc_id, r.text, seed, rate, spm)
        want.append((r.doc_id, n, form, p, m, sha(out), sha(r.text or ""), out))
    got = [tuple(r) for r in fill_in_middle.fill_in_middle(docs, seed=seed, rate=rate, spm=spm).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} >= ({"plain", "psm", "spm"} if rate == 100 else {"plain"})


def test_outputs_give_their_texts_back(docs):
    made = fill_in_middle.fill_in_middle(docs)
    back = fill_in_middle.restored(made).collect()
    assert all(hashlib.sha256(r.restored.encode()).hexdigest() == r.restored_sha256 for r in back)
    assert fill_in_middle.restored(made.withColumn("form", F.lit(None).cast("string"))).where("restored IS NOT NULL").isEmpty()


def test_pieces_are_cut_and_permuted_without_copies():
    text = "añb\ncd\nef".encode()
    whole = [(0, 0, len(text))]
    left, right = fill_in_middle.split(whole, 5)
    assert left == [(0, 0, 5)] and right == [(0, 5, 5)]
    assert fill_in_middle.split(left + right, 7) == ([(0, 0, 5), (0, 5, 2)], [(0, 7, 3)])
    assert fill_in_middle.split(whole, 0) == ([], whole) and fill_in_middle.split(whole, 99) == (whole, [])
    for form in ("psm", "spm"):
        for parts in ([left, [], right], [[], whole, []], [[], [], whole], [left, right, []]):
            pieces = fill_in_middle.arrange(parts, form)
            output = b"".join(fill_in_middle.stream(pieces, text))
            assert b"".join(fill_in_middle.stream(fill_in_middle.restore(pieces, form), text)) == text
            assert b"".join(fill_in_middle.stream(fill_in_middle.restore(fill_in_middle.pieces_of(output, form), form), output)) == text


def test_fill_in_middle_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle.fill_in_middle(empty).count() == 0


# Token counts


def test_words_are_counted_as_the_library_does(vocabulary):
    from tokenizers import Tokenizer

    library, counter = Tokenizer.from_file(vocabulary), token_counts.WordCounter(vocabulary, most=50)  # generations change all the time
    texts = ODD + [t for t in TEXTS if t is not None]
    for _ in range(2):
        stops, ends, before = counter.ends(pa.array(texts))
        for text, low, high in zip(texts, np.append(0, stops[:-1]), stops, strict=True):
            for end, n in zip(ends[low:high], before[low:high], strict=True):
                assert len(library.encode(text[:end], add_special_tokens=False).ids) == n
            assert (ends[high - 1] if high > low else 0) == len(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 512), (40, 12), (7, 2), (1, 1)])
def test_token_counts(docs, vocabulary, chunk, overlap):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    got = [tuple(r) for r in token_counts.count_tokens(docs, vocabulary, chunk=chunk, overlap=overlap).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_overlaps_widen_until_chunks_align(spark, vocabulary):
    """A run of 3,000 signs without white space between words: chunks of 100 find no place to meet at first."""
    from tokenizers import Tokenizer

    text = "some words " * 100 + "ab9." * 750 + " and more words" * 100
    docs = spark.createDataFrame([(1, text), (2, "a b " * 500)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, vocabulary, chunk=100, overlap=10).collect()}
    assert got[1] == len(Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).ids) and got[2] == len(Tokenizer.from_file(vocabulary).encode("a b " * 500, add_special_tokens=False).ids)
    parts = docs.select("doc_id", F.explode(token_counts._pieces(F.col("text"), 100, 10)).alias("p")).select(F.col("doc_id").alias("row"), "p.*")
    spliced = token_counts._spliced(parts.mapInArrow(token_counts._chunks(vocabulary, 100, 10), token_counts.CHUNK))
    assert {r.row: r.n_tokens for r in spliced.collect()} == {1: None, 2: got[2]}  # the first document is the one taken again


def test_token_counts_of_no_rows(spark, vocabulary):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        token_counts.WordCounter(public_tokenizers.path("word_bpe_49k.json"))


# Hard negatives


def plain_mining(rows, scale=256, most=5, share=80):
    """By exact whole numbers over all pairs. ``rows``: (id, label, vector), each once."""
    def score(a, b):
        total = sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
        return min(max(total, -(2**63)), 2**63 - 1)

    rows = [(i, label, [float(np.floor(scale * x)) for x in v]) for i, label, v in rows]
    rows = list(dict.fromkeys((i, label, tuple(x + 0.0 for x in v)) for i, label, v in rows))
    out = []
    for a in rows:
        if a[0] % 100:
            continue
        scores = [(-score(a[2], b[2]), b[0], b[1]) for b in rows if b is not a]
        for p, pid, _ in sorted(s for s in scores if s[2] == a[1])[:most]:
            below = sorted((s, i) for s, i, label in scores if label != a[1] and share * -p <= 100 * -s <= 100 * -p)
            out += [(a[0], pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(below[:most])]
    return sorted(out)


def vectors(n, dim, labels, spread=0.35, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(3, labels // 2), dim))
    x = centres[r.integers(len(centres), size=n)] + spread * r.normal(size=(n, dim))
    x /= np.sqrt((x * x).sum(1))[:, None]
    return [(i, int(r.integers(labels)), [float(v) for v in row]) for i, row in enumerate(x)]


SCHEMA = "vec_id long, label long, embedding array<double>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(frame, **options):
    got = hard_negatives.mine_negatives(frame, F.col("id") % 100 == 0, **options)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("options", [{}, {"shard_rows": 90, "anchor_rows": 2, "run_bytes": 1, "codewords": 5}, {"shard_rows": 40, "codewords": 64, "train_rows": 100, "run_bytes": 30_000}])
def test_hard_negatives_are_those_of_all_pairs(spark, options):
    rows = vectors(1200, 12, 4)
    rows += [(2000 + i, i % 4, rows[5][2]) for i in range(150)]  # a vector that many rows share, under several labels: ties
    rows += [(3000, 1, [0.0] * 12), (3100, 2, [-v for v in rows[7][2]])]
    want = plain_mining(rows)
    assert len(want) > 100
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3), **options) == want


def test_hard_negatives_of_hard_rows(spark):
    rows = vectors(300, 5, 3, seed=4)
    kept = rows + [(100, 1, rows[8][2]), (401, 1, rows[100][2][:3]), (500, 2, []), (600, 0, [1e200, 1e200, 0.0, 0.0, 0.0]), (601, 0, [1e200, -1e190, 1.0, 0.0, 0.0]), (602, 1, [1e160, 0.0, 0.0, 0.0, 0.0]), (700, 2, [-1e150] * 5), (-100, 0, rows[9][2])]
    odd = [(None, 1, rows[0][2]), (800, None, rows[0][2]), (900, 1, None), (1000, 1, [None, 1.0]), (1100, 1, [float("nan"), 1.0]), (1200, 2, [float("inf")])] + rows[:7]
    frame = spark.createDataFrame(kept + odd, SCHEMA)
    for name in ("id", "vec", "rank", "shard", "block", "__hash", "negative_id"):
        frame = frame.withColumn(name, F.lit("clash"))
    assert mined(frame, shard_rows=60, codewords=4) == plain_mining(kept)


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], SCHEMA)) == []  # no anchor
    assert mined(spark.createDataFrame([(100, 1, [1.0])], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])], SCHEMA)) == [(100, 1, 1, 2, 65536, 256 * 230)]


def test_cells_are_left_out_only_where_they_cannot_matter():
    """On clustered vectors most cells are not scored, and every bound holds."""
    rows = vectors(4000, 16, 4, spread=0.05, seed=6)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    books = (hard_negatives.codebook(x[:, :8], 16), hard_negatives.codebook(x[:, 8:], 16))
    cells = hard_negatives.Cells(books, hard_negatives._codes(x, books), np.arange(4000), np.zeros(4000, int), x)
    query, seen, scored, last = x[0], 0, 0, np.inf
    for bound, own, n in cells.visit(query):
        low, high = cells.stops[n], cells.stops[n + 1]
        best = (cells.x[low:high] @ query).max()
        assert best <= own <= bound + 1e-3 and bound <= last
        last, seen = bound, seen + high - low
    assert seen == 4000
    best = hard_negatives.Best(5)
    for part in hard_negatives._in_runs(cells, query, best.floor, 1):
        best.add(cells.scores(part, query), cells.ids[part])
        scored += len(part)
    assert [i for _, i in best.rows] == np.lexsort((np.arange(4000), -(x @ query)))[:5].tolist()
    assert scored < 2000


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_hard_negatives"])
def test_queries_equal_sql(spark, name):
    same(spark, entry.QUERIES[name], entry.ORACLES[name])


def test_op12_counts_all_documents(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((r.doc_id, len(r.text.encode()), n := len(library.encode(r.text, add_special_tokens=False).ids), n > 512) for r in docs)
    assert sorted(tuple(r) for r in entry.QUERIES["op12_token_counts"](spark, sf_dir).collect()) == want


# Embedding near-dedup


def test_very_large_and_very_small_vectors_link(spark):
    """Parallel vectors of any size are one group; nearly opposite or orthogonal ones are none of it."""
    from parcelworks.llm import embedding_dedup

    sizes = [1.0, 1e200, 1e-200, 1.7e308, 5e-324]
    rows = [(i + 1, [s, s], 1) for i, s in enumerate(sizes)] + [(8, [-1e200, 1e200], 1), (9, [1e300, 1e-300], 1), (10, [1e-310, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_embeddings(frame).collect()}
    assert got == {i: (4, 1, i == 1) for i in range(1, 6)} | {8: (0, 8, True), 9: (1, 9, True), 10: (1, 9, False)}


# Near copies in the pipeline


def edited(rng, words, share):
    """A copy with some words replaced, taken out or put in."""
    out = []
    for w in words:
        x = rng.random()
        out += [w] if x > share else [f"new{rng.randrange(10**6)}"] if x > share / 2 else [] if x > share / 4 else [w, "more"]
    return " ".join(out)


def near_copy_texts():
    rng = random.Random(21)
    texts = [None, "", " \n ", "one", "one two three four", "One two  three four", "a b c d e", "a b c d e"]
    for n in (8, 30, 120, 400, 3000):
        for _ in range(6):
            words = [f"w{rng.randrange(4000)}" for _ in range(n)]
            texts += [" ".join(words)] + [edited(rng, words, share) for share in (0.002, 0.01, 0.02, 0.03, 0.05, 0.3)]
    base = [f"b{i}" for i in range(300)]
    return texts + [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 300, 2)]  # many copies of one text


@pytest.mark.parametrize("part_rows", [1024, 20])
def test_near_links_join_what_all_pairs_do(spark, part_rows):
    from parcelworks.llm import near_copies
    from tests.llm.test_methods import alike, shingles

    texts = near_copy_texts()
    sets = [shingles(t) for t in texts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "node long, text string").repartition(5)
    links = [(r.u, r.v) for r in near_copies.near_links(frame, part_rows=part_rows).collect()]
    assert all(alike(sets[u], sets[v]) for u, v in links)
    name = list(range(len(texts)))
    for u, v in links:
        low, high = sorted((name[u], name[v]))
        name = [low if x == high else x for x in name]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    found = sum(name[i] == name[j] for i, j in pairs)
    assert len(pairs) > 9000 and found >= 0.99 * len(pairs)
    few = [(i, j) for i, j in pairs if not (texts[i].startswith("b") and texts[j].startswith("b"))]
    assert len(few) > 60 and sum(name[i] == name[j] for i, j in few) >= 0.95 * len(few)
    assert near_copies.near_links(frame.limit(0)).count() == 0


def test_forest_takes_the_heaviest_links():
    from parcelworks.llm.near_copies import strongest_links

    rng = np.random.default_rng(3)
    for n in (2, 10, 60):
        left, right = np.triu_indices(n, 1)
        weight = rng.integers(40, 65, len(left))
        kept = strongest_links(left, right, weight, n)
        name, total = list(range(n)), 0
        for w, a, b in sorted(zip(-weight, left, right, strict=True)):
            if name[a] != name[b]:
                total -= w
                name = [name[a] if x == name[b] else x for x in name]
        assert len(kept) == n - 1 and weight[kept].sum() == total
