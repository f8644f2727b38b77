"""Each operator on rows that are hard to handle, against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelworks.llm import (
    components, embedding_dedup, entry, hnsw, line_crf, line_dedup, mixing, quality, secrets, sentencepiece_nbest, simhash, text_stats, token_files, url_filter,
)
from tests.compare import same

SPACE = re.compile("[^\x20\x09-\x0d]+")
random.seed(5)
WORDS = ["the", "of", "Straße", "été", "corazón", "map", "parcel", "stone", "and", "river", "x"]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(9) for _ in range(3000))
BASE = prose(60)
DOCS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " end", None, None), (4, "", "en", "a"), (5, None, "de", "b"), (None, None, None, None),
    (None, prose(30) + "\n  Shared Line Here \n", "en", "b"), (6, "shared line here\nshared line here\nown", "en", "b"), (7, LONG, "fr", None), (8, "x \t\x0b\x0c\r\n\n ÄÖ 🙂", "de", "b"),
    (9, "one two", "en", "c"), (10, "SHARED LINE HERE", "en", "c"), (11, "日本語" * 30, None, "c"), (12, prose(5), "en", "c"), (12, prose(40), "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    frame = spark.createDataFrame(DOCS, SCHEMA)
    for name in ("n_lines", "kept", "evidence", "component_id", "ids", "size", "label", "value"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return s.encode().lower().decode()


def test_line_dedup(docs, empty):
    ids = lambda d: 2**63 - 1 if d is None else d
    key = lambda x: lower(x).strip(" \t\n\x0b\x0c\r")
    holders = {}
    for d, t, *_ in DOCS:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(ids(d))
    want = []
    for d, t, *_ in DOCS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == ids(d)]
        want.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.dedup_lines(docs)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in out.collect()) == sorted(want)
    assert "kept" in out.columns and line_dedup.dedup_lines(empty).count() == 0
    three = line_dedup.dedup_lines(docs, min_docs=3)
    assert sum(r.n_dropped for r in three.collect()) < sum(w[2] for w in want)


def brute_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    prints = [brute_print(t) for _, t, *_ in DOCS]
    out = simhash.simhash_components(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in out) == sorted((str(d[0]), f"{p:016x}") for d, p in zip(DOCS, prints, strict=True))
    group = {r.doc_id: r.component_id for r in out}
    assert group[1] == group[2] == 1 and group[4] == group[5] == 4
    assert {r.component_id for r in out if r.doc_id is None} == {4, None}  # a blank text, and one alone
    assert simhash.simhash_components(empty).count() == 0


def test_bit_sliced_pairs():
    rng = np.random.default_rng(1)
    fp = np.sort(rng.integers(0, 2**64, 300, dtype=np.uint64))
    fp[1::2] = fp[::2] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    start = np.array([0, 2, 3, 100, 290])
    for radius in range(4):
        found = {(a, b) for x, y in simhash.close_pairs(fp, start, radius, slots=37) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        ends = [*start[1:], len(fp)]
        want = {(i, j) for s, e in zip(start, ends, strict=True) for i in range(s, e) for j in range(i + 1, e) if int(fp[i] ^ fp[j]).bit_count() <= radius}
        assert found == want


def test_simhash_hot_bucket(spark):
    """Parts of a bucket lose no link."""
    rng = np.random.default_rng(2)
    fps = {(7 << 40) ^ int(rng.integers(0, 2**14)) for _ in range(400)}
    frame = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(fps))], "__fp long, __rep long")
    whole = {r.node: r.component for r in components.connected_components(simhash.link_fingerprints(frame, chunk=100_000)).collect()}
    parts = {r.node: r.component for r in components.connected_components(simhash.link_fingerprints(frame, chunk=16)).collect()}
    assert whole == parts and len(whole) > 300


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, x) for x in range(201, 260)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 260)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(spark, docs, empty):
    sizes = spark.createDataFrame([(i, random.choice(["a", "b", "c", None]), random.randint(0, 300)) for i in range(2000)] + [(None, "a", None), (5, "a", 10), (5, "a", 10)], "doc_id long, source string, size long")
    first = mixing.mix_to_weights(sizes, unit_rows=20).collect()
    again = mixing.mix_to_weights(sizes.repartition(7), unit_rows=20).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 2003
    assert all(r.taken <= 2 * r.size for r in first)
    totals = {}
    for r in first:
        t = totals.setdefault(r.source, [0, 0, r.target, r.source_size])
        t[0] += r.size
        t[1] += r.taken
    whole = sum(t[0] for t in totals.values())
    weights = dict(zip(sorted(s for s in totals if s), (5, 2, 1), strict=True)) | {None: 5}
    target, free = dict.fromkeys(totals, 0.0), set(totals)
    rest = 1.5 * whole
    while True:
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * totals[s][0]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2 * totals[s][0]
            rest -= target[s]
        free -= over
    for s, (size, taken, goal, source_size) in totals.items():
        assert size == source_size and abs(goal - target[s]) < 1e-6 * whole and abs(taken - goal) <= 300
    assert mixing.mix_to_weights(empty.select("doc_id", "source", F.lit(1).alias("size"))).count() == 0
    assert mixing.mix_to_weights(docs.select("doc_id", "source", F.lit(0).alias("size"))).where("taken <> 0").count() == 0


def test_mixing_rates_solve_the_dual(spark):
    """The multipliers make each source's exponentially tilted words its target."""
    rows = [("a", s, 1 + s % 3) for s in range(1, 200)] + [("b", s, 2) for s in range(1, 50)]
    counts = spark.createDataFrame(rows, "source string, size long, n long")
    target = {"a": 0.7, "b": 1.6}
    total = {x: sum(s * n for y, s, n in rows if y == x) for x in target}
    goals = spark.createDataFrame([(x, total[x], target[x] * total[x]) for x in target], "source string, source_size long, target double")
    for r in mixing.balance(counts, goals).collect():
        words = sum(n * s * min(2.0, np.exp(r["__lambda"] * s / r["__mean"])) for y, s, n in rows if y == r.source)
        assert abs(words / r.target - 1) < 1e-6


def test_url_filter(spark):
    urls = [
        (1, "http://www.example.com/en/71?q"), (2, "https://EXAMPLE.com/en/8"), (3, "x"), (4, None), (None, "http://a.b.org/es/1#z"), (5, "http://net/de/1"), (6, "http://mynet/de/1"),
        (7, "http://q.example.net/de/81"), (8, "http://h?x/en/"), (9, "://h.com"), (9, "://h.com"), (10, "http://bad.example.org/x"), (11, "http://a://b.com/en/"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(10, 1)] + [(i, 0) for i in (1, 2, 3)] + [(None, 1), (2, None), (99, 1)], "page_id long, bad int")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, outcomes).collect()}
    assert (1, "www.example.com", "/en/71", "example.com/en/7", "allow") in got
    assert (2, "example.com", "/en/8", "com/en/", "block") in got
    assert {(3, "", "", None, "allow"), (4, "", "", None, "allow")} <= got
    assert (None, "a.b.org", "/es/1", "org/es/", "block") in got and (5, "net", "/de/1", "net/de/", "block") in got
    assert (7, "q.example.net", "/de/81", "example.net/de/8", "allow") in got and (8, "h", "", None, "allow") in got
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0
    assert url_filter.judge_urls(pages, outcomes.limit(0)).count() == len(urls)
    many = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'good'}.example.org/{i}") for i in range(400)], "page_id long, url string")
    labels = many.select("page_id", (F.col("page_id") % 2).alias("bad")).where("page_id < 300")
    assert {(r.host, r.verdict) for r in url_filter.judge_urls(many, labels).collect()} == {("spam.example.org", "block"), ("good.example.org", "allow")}


def test_base_counts():
    for text in [t or "" for _, t, *_ in DOCS] + ["a b c d e f g h i " * 3, "a a a a a a a a a a", "#*$ %&\n|<>\n\n|<>\n"]:
        words = SPACE.findall(text)
        seen, marked = {}, [0] * len(words)
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for at in seen.values():
            for i in at if len(at) > 1 else []:
                marked[i : i + 8] = [1] * 8
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        want = (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(marked))
        assert text_stats.base_counts(text.encode(), text.encode().split()) == want


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(20):
        model = line_crf.Crf(rng.normal(size=(2, line_crf.N_FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(6, line_crf.N_FEATURES))
        score = lambda y: model.start[y[0]] + sum(model.emit[y[t]] @ x[t] for t in range(6)) + sum(model.move[y[t - 1], y[t]] for t in range(1, 6))  # noqa: E731,B023
        best = max(([*map(int, f"{i:06b}")] for i in range(64)), key=score)
        assert model.viterbi(x).tolist() == best


def labelled(spark, n=240):
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = "\n".join(" ".join(w + ("###" if bad else "") for w in prose(12).split()) for _ in range(4))
        rows.append((i, text, "en", f"s{i % 3}"))
        marks.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_line_quality(spark, docs, empty):
    known, labels = labelled(spark)
    model = line_crf.train(known, labels.where("doc_id < 160"))
    out = {r.doc_id: r.kept for r in line_crf.judge_quality(known, model).collect()}
    assert all(out[i] == (i % 4 != 0) for i in range(160, 240))  # held out
    rows = line_crf.judge_quality(docs, model).collect()
    assert len(rows) == len(DOCS) and all(not r.kept for r in rows if r.n_words < 20)
    assert line_crf.judge_quality(empty, model).count() == 0
    assert line_crf.judge_quality(docs, line_crf.train(docs, labels.limit(0))).count() == len(DOCS)


def test_quality(spark, docs, empty):
    known, labels = labelled(spark)
    out = {r.doc_id: r.kept for r in quality.classify(known, labels.where("doc_id < 160")).collect()}
    assert all(out[i] == (i % 4 != 0) for i in range(160, 240))
    assert quality.classify(docs, labels).count() == len(DOCS)
    assert quality.classify(docs, labels.limit(0)).count() == len(DOCS)
    assert quality.classify(empty, labels).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, "t", "p", "big") for i in range(200)] + [(1000 + i, "t", "p", f"mid{i % 10}") for i in range(200)] + [(5000, "t", "p", "lone")]
    sites = spark.createDataFrame(rows, "doc_id long, text string, path string, host string")
    labels = spark.createDataFrame([(i, 0) for i in range(200)] + [(1000 + i, 1) for i in range(200)] + [(5000, 0)], "doc_id long, quality int")
    rate = {r.host: r.path_rate for r in quality.site_rates(sites, labels)[0].collect()}
    assert rate["big"] < 0.1 < rate["lone"] < rate["mid0"]


def test_token_files(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(vocabulary)
    token_files.write_tokens(docs, f"file://{tmp_path}/t", vocabulary)
    read = token_files.read_tokens(spark, f"file://{tmp_path}/t")
    want = sorted((str(d), plain.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, *_ in DOCS)
    assert sorted((str(r.doc_id), r.ids) for r in read.collect()) == want
    index = sorted(token_files.token_index(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.start for r in index] == np.cumsum([0] + [r.n_tokens for r in index])[:-1].tolist()
    known = [-1 if r.doc_id is None else r.doc_id for r in index]
    assert known == sorted(known)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in index) == sorted((d, zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in read.where("doc_id = 7")._jdf.queryExecution().toString()
    token_files.write_tokens(empty, f"file://{tmp_path}/e", vocabulary)
    assert token_files.token_index(spark, f"file://{tmp_path}/e").count() == 0
    cache = token_files.WordCache(vocabulary)
    texts = ["a <|endoftext|>b<|ENDOFTEXT|>", "x.. z!'s it's don't! é,! x€, <b>.", "İ ΣΑΣ ﬁ e\u0301 K\u030c", "|>x <|", cache.marker * 2, f"a {cache.marker} b"]
    texts += ["İ. İ, x i\u0307.", "H\u0331 T\u0308. J\u030c, Ǆ. ŉ! ÿ) Ÿ) ß... Straße. ÷. ×! naïve' Été", "a'S it'Sb. ''s", "x\u00a0y\u3000z.\t."]
    signs = [*map(chr, range(33, 127)), *"aAeEiIzZ", *map(chr, range(0xC0, 0x250)), *map(chr, range(0x300, 0x340)), *"ΣσςϊﬁǅẞK日語🙂\u200d٣²Ⅷ"]
    chosen = random.Random(8)
    texts += [" ".join("".join(chosen.choice(signs) for _ in range(chosen.randint(1, 6))) for _ in range(40)) for _ in range(200)]
    texts += [" ".join(chosen.choice(signs) + chosen.choice(".,!)<'") for _ in range(300)) for _ in range(5)]
    ends, ids = cache.ids(pa.array([*texts, "", " \n"]))
    for text, one in zip([*texts, "", " \n"], np.split(ids, ends[:-1]), strict=True):
        assert one.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], text


def test_token_files_keep_positions_and_skip_stripes(spark, tmp_path):
    """Rows of one id have places in the files that ``start`` agrees with; stripes have Bloom filters and are skipped."""
    import public_tokenizers
    from pyarrow import orc

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7, prose(n)) for n in range(1, 60)] + [(None, prose(n)) for n in range(1, 9)] + [(i, prose(3)) for i in range(40)]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), f"file://{tmp_path}/t", vocabulary)
    files = [orc.read_table(p).to_pydict() for p in sorted(tmp_path.glob("t/*.orc"))]
    files = sorted((f for f in files if f["ids"]), key=lambda f: (f["doc_id"][0] is not None, f["doc_id"][0] or 0, f["text_hash"][0]))
    ids = [x for f in files for x in f["ids"]]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    want = sorted((s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for s, x in zip(starts, ids, strict=True))
    index = token_files.token_index(spark, f"file://{tmp_path}/t")
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in index.collect()) == want and len(want) == len(rows)
    many = spark.range(0, 60_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.lit("x")).alias("text")).coalesce(1)
    token_files.write_tokens(many, f"file://{tmp_path}/m", vocabulary, stripe_bytes=1 << 16, row_index_stride=1000)
    paths = sorted(tmp_path.glob("m/*.orc"))
    assert sum(orc.ORCFile(p).nstripes for p in paths) > len(paths)
    read = token_files.read_tokens(spark, f"file://{tmp_path}/m").where("doc_id = 31234")
    assert len(read.collect()) == 1
    scanned = read._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert 1 <= scanned <= 1000  # one row group; the other stripes and groups are skipped


def n_best_by_hand(pieces, text, n):
    word = "▁" + text.replace(" ", "▁") if text else ""
    best = [[] for _ in range(len(word) + 1)]
    best[0] = [(0, ())]
    into = {}
    for j in range(1, len(word) + 1):
        for i in range(j):
            if found := pieces.steps.get(word[i:j]):
                into.setdefault(j, []).append((i, (found[0],), found[1]))
            elif j == i + 1:
                raw = word[i].encode()
                into.setdefault(j, []).append((i, tuple(pieces.byte_ids[b] for b in raw), len(raw) * pieces.byte_score))
    for j in range(1, len(word) + 1):
        best[j] = sorted(((a + s, x + ids) for i, ids, s in into.get(j, []) for a, x in best[i]), key=lambda z: (-z[0], z[1]))[:n]
    return best[-1]


def test_sentencepiece(docs, empty):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces, library = sentencepiece_nbest.lattice(model), sentencepiece.SentencePieceProcessor(model_file=model)
    for text in ["", "a", "  two  blanks ", "é\n\nx 語🙂 end", "The quick brown fox. And\tmore", "ab ab ab"] + [prose(20) for _ in range(20)]:
        ways, want = pieces.encode(text, 5), n_best_by_hand(pieces, text, 5)
        assert [w[0] for w in ways] == [w[0] for w in want] and len({w[1] for w in ways}) == len(ways)
        assert all(library.decode(np.frombuffer(w[1], "<i4").tolist()) == text for w in ways)
    for text in ["aaaaaaaaaaaaaaaaaaaa", "abababababababab日", "☃☃☃"]:  # many ways of equal scores
        assert [w[0] for w in pieces.encode(text, 12)] == [w[0] for w in n_best_by_hand(pieces, text, 12)]
    word = "".join(random.Random(3).choice("abcdefghinorstu") for _ in range(300_000))
    began = time.process_time()
    ways = pieces.encode(word + " " + "a" * 100_000, 4)  # time and memory grow with the length only
    assert time.process_time() - began < 60 and len({w[1] for w in ways}) == 4 and not any(len(w) > pieces.keep for w in pieces.new)
    assert all(library.decode(np.frombuffer(w[1], "<i4").tolist()) == word + " " + "a" * 100_000 for w in ways)
    out = sentencepiece_nbest.encode_documents(docs, model).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in out) == sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in DOCS)
    assert all(r.round_trip for r in out)
    texts = sentencepiece_nbest.decode_documents(sentencepiece_nbest.encode_documents(docs, model), model).collect()
    assert sorted((str(r.doc_id), r.text) for r in texts) == sorted((str(d), t or "") for d, t, *_ in DOCS)
    assert sentencepiece_nbest.encode_documents(empty, model).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        v = rng.normal(size=16)
        for _ in range(1 + i % 3):
            rows.append((len(rows), (v + 0.08 * rng.normal(size=16)).astype(np.float32).tolist(), i % 2))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (901, rows[0][1], 0), (902, None, 0), (903, [], 0), (904, [0.0] * 16, 0), (905, [float("nan")] * 16, 0)]
    rows += [(906, [None] * 16, 0), (907, rows[0][1], None), (908, [1.0, 2.0], 0), (909, [2.0, 4.0], 0), (None, rows[3][1], 1)]
    return rows


@pytest.mark.parametrize("shard_rows,part_rows", [(8192, 2048), (60, 4)])
def test_embeddings(spark, shard_rows, part_rows):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embedding_dedup.link_embeddings(frame, shard_rows=shard_rows, part_rows=part_rows).collect())
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and y is not None for _, v, y in rows]
    links, name = [0] * len(rows), [r[0] for r in rows]
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    near[i].append(j)
    links = [len(x) for x in near]
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        name[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    assert got == sorted((str(r[0]), n, c) for r, n, c in zip(rows, links, name, strict=True))
    assert embedding_dedup.link_embeddings(frame.limit(0)).count() == 0


def test_graph_finds_near_vectors():
    x = np.random.default_rng(6).normal(size=(1500, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    graph = hnsw.Hnsw.from_bytes(hnsw.Hnsw(x).to_bytes(), x)
    hits = [len(set(graph.search(x[i], 128)[0][:10]) & set(np.argsort(-(x @ x[i]))[:10])) for i in range(0, 1500, 20)]
    assert np.mean(hits) >= 9


def test_secrets(spark, docs, empty):
    hexa = lambda n: "".join(random.choice("0123456789abcdef") for _ in range(n - 1)) + "a"
    rows = []
    for i in range(300):
        kind = i % 3
        extra = f"password={hexa(18)}" if kind == 0 else f"{random.randint(10**15, 10**16 - 1)}" if kind == 1 else 'token = "' + hexa(40) + '"'
        rows.append((i, f"{prose(8)} {extra} {prose(5)}", "en", "s"))
    out = {r.doc_id: r.is_secret for r in secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: i % 3 != 1 for i in range(300)}
    assert secrets.scan_secrets(empty).count() == 0
    assert all(r.is_secret for r in secrets.scan_secrets(docs).collect())
    twice = spark.createDataFrame([(1, None, None, None), (2, "passwordpassword=abc123def456abc1 x", None, None), (2, "passwordpassword=abc123def456abc1 x", None, None)], SCHEMA)
    assert secrets.scan_secrets(twice).count() == 2


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, entry.QUERIES[name], entry.ORACLES[name])


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.good_quality(spark, docs, sf_dir)
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").collect()}
    assert good.columns == docs.columns and not bad & {r.doc_id for r in good.collect()}
    lines = corpus_pipeline.unique_lines(spark, good, sf_dir)
    assert lines.count() == good.count() and lines.columns == docs.columns
    one = corpus_pipeline.one_of_each_group(spark, lines, sf_dir)
    prints = [r.fingerprint for r in simhash.simhash_components(one).collect()]
    assert all(int(a, 16) ^ int(b, 16) and (int(a, 16) ^ int(b, 16)).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    mixed = corpus_pipeline.target_weights(spark, one, sf_dir)
    assert mixed.columns == docs.columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    assert corpus_pipeline.encoded(spark, mixed, sf_dir).where("NOT round_trip").count() == 0


def near_texts(n):
    """Two texts whose fingerprints differ by one to three bits."""
    while True:
        words = prose(n).split()
        other = [*words[:-1], "changed"]
        if 0 < (brute_print(" ".join(words)) ^ brute_print(" ".join(other))).bit_count() <= 3:
            return " ".join(words), " ".join(other)


def test_missing_and_repeated_ids_bridge_nothing(spark):
    """Groups stay apart where their fingerprints are held by rows of null ids, or of one id, only."""
    import corpus_pipeline

    (a, near_a), (b, near_b), (c, d) = near_texts(150), near_texts(150), (prose(90), prose(95))
    rows = [(1, a), (None, near_a), (500, b), (None, near_b), (None, c), (7, d), (7, prose(99)), (7, d)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(frame).collect()}
    want = {(i, t): n for (i, t), n in zip(rows, [1, 1, 500, 500, None, 7, 7, 7], strict=True)}
    assert got == {(i, f"{brute_print(t):016x}"): n for (i, t), n in want.items()}
    one = corpus_pipeline.one_of_each_group(spark, frame, "")
    assert sorted(map(str, ((r.doc_id, r.text) for r in one.collect()))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5], rows[6]]))
    assert corpus_pipeline.one_of_each_group(spark, frame.where("doc_id IS NULL"), "").count() == 3
    nulls = spark.createDataFrame([(None, prose(n), "en", "s", n) for n in range(1, 81)] * 2, frame.schema)
    words = sum(len(r.text.split()) for r in corpus_pipeline.target_weights(spark, nulls, "").collect())
    assert abs(words - 1.5 * 2 * sum(range(1, 81))) <= 80


def test_embeddings_missing_ids_bridge_nothing(spark):
    base = np.eye(4)
    close = lambda i: [float(x) for x in base[i] + 0.1 * base[3]]
    rows = [(1, [1.0, 0, 0, 0], 0), (None, close(0), 0), (500, [0, 1.0, 0, 0], 0), (None, close(1), 0), (900, [0, 0, 1.0, 0], 1), (None, close(2), 1), (None, [0, 0, 0, 1.0], 1)]
    rows += [(7, [1.0, 1, 0, 0], 2), (7, [0, 0, 1.0, 1], 2), (8, [1.0, 1, 0.1, 0], 2), (9, [0, 0.1, 1.0, 1], 2)]
    rows = [(i, [float(x) for x in v], y) for i, v, y in rows]
    out = embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == sorted(
        [("1", 1, "1"), ("None", 1, "1"), ("500", 1, "500"), ("None", 1, "500"), ("900", 1, "900"), ("None", 1, "900"), ("None", 0, "None")]
        + [("7", 1, "7"), ("7", 1, "7"), ("8", 1, "7"), ("9", 1, "7")]
    )
