"""The methods of the operators against brute force, on whole tables and on rows that are hard to handle."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.llm import components, embedding_dedup, hnsw, line_crf, line_dedup, mixing, quality, secrets, simhash, url_filter
from parcelworks.llm.shared import NO_ID
from tests.compare import SMALL
from tests.llm.test_operators import DOCS, SCHEMA, brute_print, docs, empty, labelled, lower, prose  # noqa: F401

SPACE = re.compile("[^\x20\x09-\x0d]+")


# Line labels


def mixed_documents(spark, n=240):
    """Good, bad and half-and-half documents; every document begins with a sentence that all share."""
    rng, rows, marks, truth = random.Random(11), [], [], {}
    junk = lambda: " ".join(w.upper() + "!!" for w in prose(9).split())
    for i in range(n):
        kind = i % 3  # good, bad, both
        lines = [(junk() if kind == 1 or (kind == 2 and j >= 8) else prose(9), kind == 1 or (kind == 2 and j >= 8)) for j in range(16)]
        lines = [("shared by all of them as it is", False), *lines]
        rows.append((i, "\n".join(x for x, _ in lines), "en", f"s{rng.randint(0, 2)}"))
        truth[i] = [int(b) for _, b in lines]
        if kind < 2:
            marks.append((i, 1 - kind, 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), truth


def test_lines_are_told_apart_inside_a_document(spark):
    frame, labels, truth = mixed_documents(spark)
    model = line_crf.train(frame, labels.where("doc_id < 120"))
    right = total = 0
    for row in frame.where("doc_id >= 120").collect():  # held out; no document of both kinds is ever labelled
        got = model.viterbi(line_crf.line_features(line_crf.split_lines(row.text.encode()))).tolist()
        right += sum(a == b for a, b in zip(got, truth[row.doc_id], strict=True))
        total += len(got)
    assert right / total > 0.97
    shares = {r.doc_id: r.content_share for r in line_crf.judge_quality(frame, model).collect()}
    assert all(0.4 < shares[i] < 0.7 for i in shares if i % 3 == 2) and all(shares[i] < 0.2 for i in shares if i % 3 == 1)


def test_kept_by_hand(spark, docs):  # noqa: F811
    """``content_share`` and ``kept`` from features counted character by character and a plain dynamic programme."""
    known, labels = labelled(spark)
    frame, more, _ = mixed_documents(spark, 30)
    model = line_crf.train(known, labels)

    def features(words):
        solid = "".join(words)
        n = len(solid.encode())
        return np.array([
            1.0, sum(c in "#*$%&|<>" for c in solid) / n, solid.count("!") / n, sum("A" <= c <= "Z" for c in solid) / n, solid.count("|") / n, sum("0" <= c <= "9" for c in solid) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), min(n / len(words), 20) / 20, min(math.log1p(len(words)), 6) / 6,
        ])

    def judged(text):
        lines = [w for line in text.split("\n") if (w := SPACE.findall(line))]
        best = {}
        for t, words in enumerate(lines):
            e = model.emit @ features(words)
            if not t:
                best = {y: (model.start[y] + e[y], [y]) for y in (0, 1)}
            else:
                best = {y: max(((best[x][0] + model.move[x, y] + e[y], [*best[x][1], y]) for x in (0, 1)), key=lambda b: (b[0], -b[1][-2])) for y in (0, 1)}
        marks = max(best.values(), key=lambda b: (b[0], -b[1][-1]))[1] if lines else []
        words = SPACE.findall(text)
        seen, again = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for at in seen.values():
            again |= {i + k for i in at if len(at) > 1 for k in range(8)}
        share = sum(len(w) for w, y in zip(lines, marks, strict=True) if not y) / len(words) if words else 0.0
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        return failed, share, not failed and share >= 0.5

    rows = [(d, t) for d, t, *_ in DOCS] + [(r.doc_id, r.text) for r in frame.collect()] + [(r.doc_id, r.text) for r in known.limit(40).collect()]
    rows += [(1000, None), (1001, "\n\n"), (1002, prose(25) + "\n" * 50 + "#$% " * 30)]
    got = line_crf.judge_quality(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = sorted((str(d), *judged(t or "")) for d, t in rows)
    assert [(w[0], w[1], round(w[2], 9), w[3]) for w in want] == [(a, b, round(c, 9), d) for a, b, c, d in sorted((str(r.doc_id), r.base_failed, r.content_share, r.kept) for r in got)]
    assert len({w[3] for w in want}) == 2


def test_line_sample_takes_one_row_an_id(spark):
    rows = [(1, prose(9) + "\n" + prose(9), "en", "a")] * 300 + [(1, prose(30), "en", "a")] * 300 + [(2, "A!! B!!\nC!!", "en", "a"), (3, None, "en", "a")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 0), (2, None)], "doc_id long, quality int")
    chains = line_crf.labelled_chains(spark.createDataFrame(rows, SCHEMA), labels, "doc_id", "text", 2000, 32, 4000).collect()
    assert sorted(r.quality for r in chains) == [0, 1]


def test_few_labels_give_few_chains(spark):
    frame, labels, _ = mixed_documents(spark, 60)
    assert len(line_crf.labelled_chains(frame, labels, "doc_id", "text", 2000, 4, 10).collect()) == 10


# Quality


def shrunk_by_hand(rows, marks):
    """(host, path) -> rates of beta-binomial shrinkage, level by level."""
    votes = {}
    for d, q in marks:
        if d is not None and q is not None:
            votes.setdefault(d, []).append(q)
    label = {d: int(sum(v) / len(v) >= 0.5) for d, v in votes.items()}
    paths = {}
    for d, host, path in rows:
        n = paths.setdefault((host, path), [0, 0])
        if d in label:
            n[0] += 1
            n[1] += label[d]
    hosts = {}
    for (host, _), (n, k) in paths.items():
        h = hosts.setdefault(host, [0, 0])
        h[0] += n
        h[1] += k

    def strength(cells):
        cells = [(n, k, m) for n, k, m in cells if n and 0 < m < 1]
        noise = sum(m * (1 - m) for _, _, m in cells)
        extra = sum(n * m * (1 - m) for n, _, m in cells) - noise
        rho = (sum(n * (k / n - m) ** 2 for n, k, m in cells) - noise) / extra if extra > 0 else 0
        return min(1000.0, max(2.0, 1 / rho - 1)) if rho > 0 else 1000.0

    mean = (sum(k for _, k in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    s = strength([(n, k, mean) for n, k in hosts.values()])
    host_rate = {h: (k + s * mean) / (n + s) for h, (n, k) in hosts.items()}
    s = strength([(n, k, host_rate[h]) for (h, _), (n, k) in paths.items()])
    return {(h, p): (host_rate[h], (k + s * host_rate[h]) / (n + s)) for (h, p), (n, k) in paths.items()}


@pytest.mark.parametrize("case", ["small table", "hard rows"])
def test_quality_by_hand(spark, docs, case):  # noqa: F811
    """Site rates and p_good of every document; the evidence is the fitted model's on features counted here."""
    if case == "small table":
        frame, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    else:
        frame = docs
        labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (2, 1), (3, None), (None, 0), (7, 1), (12, 0), (99, 1)], "doc_id long, quality int")
    rows, marks = frame.select("doc_id", "text", "source", "lang").collect(), [(r.doc_id, r.quality) for r in labels.collect()]
    rate = shrunk_by_hand([(r.doc_id, r.source, r.lang) for r in rows], marks)
    model = quality.fit_evidence(frame.select("doc_id", "text"), labels)
    want = []
    for r in rows:
        z = (np.array(quality.text_features(r.text)) - model.mean) / model.spread
        evidence = min(30.0, max(-30.0, float(z @ model.w[1:] + model.w[0])))
        host, path = rate[r.source, r.lang]
        p = 1 / (1 + math.exp(-evidence) * (1 - path) / path)
        want.append((str(r.doc_id), round(host, 9), round(path, 9), round(p, 7), p >= 0.5))
    got = quality.classify(frame, labels).collect()
    assert sorted((str(r.doc_id), round(r.host_rate, 9), round(r.path_rate, 9), round(r.p_good, 7), r.kept) for r in got) == sorted(want)


def test_text_features_by_hand():
    for text in [t for _, t, *_ in DOCS] + ["A!! A!! |\nb 12\nb 12", "x x y"]:
        words = SPACE.findall(text or "")
        solid, lines = "".join(words), [x for x in (text or "").split("\n") if SPACE.search(x)]
        n, w = max(1, len(solid.encode())), max(1, len(words))
        want = [
            sum(c in "#*$%&|<>" for c in solid) / n, solid.count("!") / n, sum("A" <= c <= "Z" for c in solid) / n, solid.count("|") / n, sum("0" <= c <= "9" for c in solid) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, 1 - len(set(lines)) / max(1, len(lines)), min(20, len(solid.encode()) / w) / 20, min(10, math.log1p(len(words))) / 10,
        ]
        assert np.allclose(quality.text_features(text), want)


# Secrets


def candidates_by_hand(text):
    for no, word in enumerate(re.split("[ \t\n\x0b\f\r]+", text or "")):
        for m in re.finditer("[A-Za-z0-9+/_-]+", word):
            if len(m[0]) >= 12 and (re.search("[0-9]", m[0]) or re.search("[a-z][A-Z]", m[0]) or re.search("[A-Z]{16}", m[0])):
                yield no, m[0]


def test_candidates_by_hand(spark, docs):  # noqa: F811
    texts = [t for _, t, *_ in DOCS] + ["x" * 50, "aB" * 9, "ABCDEFGHIJKLMNOP", "abcdefghijkl", "a-b_c/d+e12345 token=abc123def456ghi=zz9999999999999", "é" * 20 + "1", "-" * 11 + "1 " * 3]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    got = sorted((r.doc_id, r.word_no, r.value) for r in secrets.candidates(frame).collect())
    assert got == sorted((i, no, v) for i, t in enumerate(texts) for no, v in candidates_by_hand(t)) and len(got) > 4
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted((r.doc_id, no, v) for r in small.collect() for no, v in candidates_by_hand(r.text))
    assert sorted((r.doc_id, r.word_no, r.value) for r in secrets.candidates(small).collect()) == want


def test_long_runs_take_time_in_proportion(spark):
    rows = [(1, "a" * 1_000_000), (2, "a" * 1_000_000 + "1"), (3, "A" * 500_000 + "é" + "b" * 500_000)]
    began = time.time()
    found = secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))).select("doc_id", F.length("value").alias("n")).collect()
    assert sorted((r.doc_id, r.n) for r in found) == [(2, 1_000_001), (3, 500_000)] and time.time() - began < 30


def test_forest_on_held_out_findings(spark):
    """Trained on strings planted in some documents, judged on others planted in others."""
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    known, fresh = secrets.planted_findings(small, most=600).cache(), secrets.planted_findings(small, most=400, seed="other").cache()
    cover = secrets.dictionary_cover(known.unionByName(fresh).drop("label"), small).cache()
    model = secrets.train(secrets.features(known, cover))
    out = model.transform(secrets._typed(secrets.features(fresh, cover))).select("label", F.col("__y").cast("int").alias("y")).collect()
    hits = sum(r.label and r.y for r in out)
    assert len(out) > 300 and hits / sum(r.label for r in out) > 0.9 and hits / sum(r.y for r in out) > 0.9


def test_own_findings_decide(spark):
    rows = [(i, f"{prose(5)} {'order' if i % 2 else 'pin'} {10**14 + i * 7919}{'x' if i % 2 else ''} {prose(5)}", None, None) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = secrets.candidates(frame).select("value", F.pmod("doc_id", F.lit(2)).cast("int").alias("label"))
    out = {r.doc_id: r.is_secret for r in secrets.scan_secrets(frame, found.where("value < '100000000001000'").unionByName(found.limit(120))).collect()}
    assert sum(out[i] == bool(i % 2) for i in out) > 190


# Near duplicates


def shingles(text, n=5):
    words = lower(text or "").split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    return bool(a & b) and len(a & b) >= 0.8 * len(a | b)


def groups_by_hand(prints, sets=None):
    """Smallest row of the group of each, by all pairs: three bits, or sets alike to 0.8."""
    name = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3 or sets and alike(sets[i], sets[j]):
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    return name


def test_simhash_components_by_all_pairs(spark):
    rng, rows = random.Random(12), []
    for _ in range(60):
        words = prose(rng.randint(40, 200)).split()
        for _ in range(rng.randint(1, 6)):
            other = list(words)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] = rng.choice(["edit", "change", "other"])
            rows.append((len(rows), " ".join(other)))
            words = other if rng.random() < 0.5 else words  # chains
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one", "one two", "one two three"])]
    name = groups_by_hand([brute_print(t) for _, t in rows])
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == dict(enumerate(name)) and 20 < len(set(name)) < len(rows) - 40


def test_an_id_like_the_null_stand_in_counts_as_null(spark):
    frame = spark.createDataFrame([(NO_ID, prose(30)), (None, prose(40)), (3, prose(50))], "doc_id long, text string")
    assert {r.doc_id for r in simhash.simhash_components(frame).collect()} == {None, 3}
    assert line_dedup.dedup_lines(frame).count() == 3


def skewed(plan):
    return plan.count("skew=true")


@pytest.fixture
def low_thresholds(spark):
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8000", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.files.maxPartitionBytes": "50000", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_line_is_split(spark, low_thresholds, monkeypatch):
    """The join of lines with repeated keys splits the tasks of a line that a third of all documents hold."""
    plans = []
    real = line_dedup.stash

    def watched(df, name):
        if name == "dropped-lines":
            plans.append(final_plan(df))
        return real(df, name)

    monkeypatch.setattr(line_dedup, "stash", watched)
    frame = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a very common line\n"), F.sha2(F.col("id").cast("string"), 256)).alias("text")).repartition(6)
    assert line_dedup.dedup_lines(frame).where("n_dropped = 1").count() == 59_999
    assert skewed(plans[0]) == 1


def test_a_hub_is_split(spark, low_thresholds, monkeypatch):
    plans = []
    real = components.stash

    def watched(df, name):
        if name == "large":
            plans.append(final_plan(df))
        return real(df, name)

    monkeypatch.setattr(components, "stash", watched)
    star = spark.range(1, 60_000).select((F.col("id") * 0 + 5).alias("u"), (F.col("id") + 10).alias("v"))
    other = spark.range(1, 20_000).select((F.col("id") + 200_000).alias("u"), (F.col("id") + 300_000).alias("v"))
    found = components.connected_components(star.unionByName(other))
    assert found.where("component = 5").count() == 60_000 and max(map(skewed, plans)) >= 1


def test_a_graph_in_pieces_is_scanned_exactly():
    """Where beams cannot reach a part of the shard, no link is lost."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[200:] = x[:200] + 0.01 * rng.normal(size=(200, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    graph = hnsw.Hnsw(x)
    graph.links = [np.full_like(a, -1) for a in graph.links]  # no node leads to another
    left, right, asked, found = hnsw.near_links(graph, x, True, 0.93, beam=8)
    near = x.astype(np.float32) @ x.astype(np.float32).T >= 0.93 - 1e-5
    assert len(left) == near.sum() and near[left, right].all() and asked == found


def test_pairs_of_shards_are_dealt_in_runs(spark):
    """Whatever the number of query shards a task takes, the result is the same; audits reach their recall."""
    rng = np.random.default_rng(10)
    base = rng.normal(size=(150, 8))
    rows = [(i, (base[i % 150] + 0.05 * rng.normal(size=8)).tolist(), "a") for i in range(450)] + [(900, None, None), (901, [1.0] * 8, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    outs = [embedding_dedup.link_embeddings(frame, shard_rows=40, run_bytes=b).collect() for b in (1, 40 * 8 * 8 * 3, 1 << 30)]
    assert len({tuple(sorted((r.vec_id, r.n_links, r.component_id) for r in out)) for out in outs}) == 1
    assert all(r.audit_recall >= 0.95 for r in outs[0] if r.vec_id < 900) and all(r.audit_recall is None for r in outs[0] if r.vec_id >= 900)


# Mixing and urls


def test_mixing_with_a_cap_in_between(spark):
    rows = [(i, "a", 100) for i in range(20)] + [(100 + i, "b", 50) for i in range(400)]
    out = mixing.mix_to_weights(spark.createDataFrame(rows, "doc_id long, source string, size long"), cap=2.5).collect()
    for s in "ab":
        taken, target = sum(r.taken for r in out if r.source == s), next(r.target for r in out if r.source == s)
        assert abs(taken - target) <= 100
    assert next(r.target for r in out if r.source == "a") == 5000 and max(r.copies for r in out) == 3
    counts = spark.createDataFrame([("a", s, 5) for s in range(1, 9)], "source string, size long, n long")
    with pytest.raises(RuntimeError):
        mixing.balance(counts, spark.createDataFrame([("a", 180, 90.0)], "source string, source_size long, target double"), max_steps=1)


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.com:8080", "me@y.x.com", "com", "", "b.co.uk", "deep.er.example.org", "1.2.3.4:"]
    frame = spark.createDataFrame([(h, 1) for h in hosts], "host string, bad int")
    got = {r.host: (r.domain, r.suffix) for r in url_filter.host_counts(frame).collect()}
    assert got == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com:8080": ("x.com", "com"), "me@y.x.com": ("x.com", "com"), "com": ("com", "com"), "": ("", ""),
        "b.co.uk": ("b.co.uk", "co.uk"), "deep.er.example.org": ("example.org", "org"), "1.2.3.4:": ("3.4", "4"),
    }


# Pipeline


def test_pipeline_stages_on_hard_rows(spark):
    """Nulls in any column, repeated rows, ties, an empty table, columns more than there should be."""
    import corpus_pipeline

    rows = [(d, t, lang, source, None if t is None else len(t)) for d, t, lang, source in DOCS] * 2
    frame = spark.createDataFrame(rows, SCHEMA + ", n_chars long").withColumns({"kept": F.lit("clash"), "copies": F.lit("clash")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SMALL)
        assert out.columns == corpus_pipeline.COLUMNS and stage(spark, frame.limit(0), SMALL).count() == 0
        assert out.count() == stage(spark, frame.repartition(7), SMALL).count()
    one = corpus_pipeline.one_of_each_group(spark, frame, SMALL).collect()
    name = groups_by_hand([brute_print(t) for _, t, *_ in DOCS], [shingles(t) for _, t, *_ in DOCS])
    assert len(one) == len(set(name))
    assert corpus_pipeline.encoded(spark, frame, SMALL).count() == len(rows) and corpus_pipeline.encoded(spark, frame.limit(0), SMALL).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = spark.createDataFrame([(i, f"http://www.{rule}1") for i, rule in enumerate(words)], "page_id long, url string")
    outcomes = spark.createDataFrame([(0, 1)], "page_id long, bad int")
    assert {r.rule: r.verdict for r in url_filter.judge_urls(pages, outcomes).collect()} == words
