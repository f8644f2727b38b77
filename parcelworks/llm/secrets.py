"""Secret scan: candidates by shape, false positives removed by a random forest.

The forest reads a candidate's length, its character transitions, how much of it the corpus's own words
cover, the path (source) it lies under and its neighbouring words. It is trained from labelled findings: real ones where there are
any, else planted ones, whose labels are known because they were put there.
DataFrame functions and spark.ml's forest only.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.shared import stash, table

SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
#: What a candidate must hold: a digit, a change of case, or sixteen capitals.
MARKS = "[0-9]|[a-z][A-Z]|[A-Z]{16}"
KEYWORDS = r"(?i)(passw|secret|token|api|key|auth|credential)"
PATHS = 16
FEATURES = (
    "f_length", "f_switches", "f_digits", "f_upper", "f_vowels", "f_consonants", "f_covered", "f_path", "f_keyword", "f_assigned", "f_before", "f_after",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", min_chars: int = 12) -> DataFrame:
    """(doc_id, path, word_no, value, key, before, after): a row for each candidate in each word: a whole run of at least ``min_chars`` of
    A-Z, a-z, 0-9, +, /, _ and -, that holds one of ``MARKS``. ``key`` is what precedes it in the word; before and after are the words
    beside it. Time grows with the length of a run, whatever it holds."""
    run = "([A-Za-z0-9+/_\\-]{%d,})" % min_chars
    words = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.split(F.coalesce(F.col(text_col), F.lit("")), SPLIT).alias("__words"))
    each = words.select("doc_id", "path", "__words", F.posexplode("__words").alias("word_no", "__word")).where((F.octet_length("__word") >= min_chars) & F.col("__word").rlike(MARKS))
    # regular expressions only, which Spark compiles together with the explode, so that no row carries a copy of all words
    each = each.select("doc_id", "path", "__words", "word_no", "__word", F.explode(F.regexp_extract_all("__word", F.lit(run), F.lit(1))).alias("__value")).where(F.col("__value").rlike(MARKS))
    value = F.col("__value")
    near = lambda i: F.coalesce(F.get(F.col("__words"), i), F.lit(""))
    return each.select(
        "doc_id", "path", F.col("word_no").cast("long").alias("word_no"), value.alias("value"),
        F.call_function("substring_index", F.col("__word"), value, F.lit(1)).alias("key"),
        F.concat_ws(" ", near(F.col("word_no") - 2), near(F.col("word_no") - 1)).alias("before"), near(F.col("word_no") + 1).alias("after"),
    )


def _letters(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit("([a-z]{3,})"), F.lit(1)))


def dictionary_cover(found: DataFrame, docs: DataFrame, text_col: str = "text", share: float = 1e-5) -> DataFrame:
    """(value, f_covered): the share of a candidate's characters in letter runs that are words of the corpus: at least ``share`` of all its
    runs of three letters or more, so that the dictionary is the same however large the corpus is. Words are counted before they are
    joined."""
    values = found.select("value").distinct()
    runs = stash(values.select("value", F.explode(_letters(F.col("value"))).alias("run")), "secret-runs")
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")).alias("run")).where(F.length("run") >= 3)
    counts = stash(words.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = counts.where(F.col("n") >= share * total).join(runs.select("run").distinct(), "run", "left_semi").select("run")
    covered = runs.join(known, "run").groupBy("value").agg(F.sum(F.length("run")).alias("__c"))
    return values.join(covered, "value", "left").select("value", F.least(F.lit(1.0), F.coalesce("__c", F.lit(0)) / F.length("value")).alias("f_covered"))


def features(found: DataFrame, cover: DataFrame) -> DataFrame:
    v = F.col("value")
    n = F.length(v).cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern))
    switches = count("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]")
    longest = F.array_max(F.transform(F.regexp_extract_all(F.lower(v), F.lit("([b-df-hj-np-tv-z]+)"), F.lit(1)), lambda x: F.length(x)))
    return found.join(cover, "value").withColumns(
        {
            "f_length": n,
            "f_switches": switches / n,
            "f_digits": count("[0-9]") / n,
            "f_upper": count("[A-Z]") / n,
            "f_vowels": count("[aeiouAEIOU]") / n,
            "f_consonants": F.coalesce(longest, F.lit(0)).cast("double"),
            "f_path": F.pmod(F.xxhash64(F.coalesce("path", F.lit(""))), F.lit(PATHS)).cast("double"),
            "f_keyword": F.concat_ws(" ", "before", "key").rlike(KEYWORDS).cast("double"),
            "f_assigned": F.concat("before", "key").rlike("[=:]['\"]?$").cast("double"),
            "f_before": F.col("before").rlike("^[\\p{L} ,.]*$").cast("double"),
            "f_after": F.col("after").rlike("^[\\p{L},.]*$").cast("double"),
        }
    )


def _kinds(h: Column, word: Column, other: Column) -> list[tuple[int, Column, Column, Column]]:
    """(label, what precedes a planted string, the string, what follows), all derived from a hash (64 hexadecimal digits) and two words of the text."""
    digits = F.translate(h, "abcdef", "123456")
    mixed = F.translate(F.base64(F.unhex(h)), "=", "")
    capitals = F.upper(F.translate(h, "0189", "GKQZ"))
    part = lambda c, i, n: F.substring(c, i, n)
    uuid = F.concat_ws("-", part(h, 1, 8), part(h, 9, 4), part(h, 13, 4), part(h, 17, 4), part(h, 21, 12))
    name = F.initcap(word), F.initcap(other)
    none = F.lit("")
    return [
        (1, F.lit('token = "'), part(h, 1, 40), F.lit('"')),
        (1, F.lit("password="), part(mixed, 1, 18), none),
        (1, F.lit("api_key: "), mixed, none),
        (1, F.lit("AWS key "), F.concat(F.lit("AKIA"), part(capitals, 1, 16)), none),
        (1, none, F.concat(F.lit("ghp_"), part(F.translate(mixed, "+/", "aZ"), 1, 36)), none),
        (1, F.lit("secret "), part(h, 5, 32), none),
        (1, F.lit("password="), part(h, 3, 18), none),
        (1, none, F.concat(F.lit("AKIA"), part(capitals, 7, 16)), none),
        (0, none, part(digits, 1, 16), none),
        (0, F.lit("commit "), part(h, 1, 40), none),
        (0, F.lit("sha256:"), h, none),
        (0, F.lit("id "), uuid, none),
        (0, F.lit("see "), F.concat(*name, *name, part(digits, 1, 1)), none),
        (0, F.lit("file "), F.concat_ws("_", word, other, F.lit("report"), part(digits, 1, 4)), none),
        (0, F.lit("call +"), part(digits, 1, 13), none),
        (0, F.lit("https://example.com/"), F.concat_ws("/", word, other, F.lit("2024"), F.lit("index")), F.lit(".html")),
        (0, none, F.upper(F.concat(word, other, word, other, F.lit("abcdefgh"))), none),
        (0, F.lit("on "), F.concat(F.lit("20240"), part(digits, 1, 3), F.lit("T"), part(digits, 4, 6), F.lit("Z-"), word), none),
    ]


def planted_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", most: int = 2000, each: int = 4, seed: str = "planted") -> DataFrame:
    """``candidates`` with ``label``: strings derived from hashes, secrets (1) and harmless ones (0), each put at a place of a real document
    that its hash chooses; at most ``most`` documents, those of the smallest hashes of their ids, a row an id, take ``each`` of them, one at
    a time. The documents' own candidates are not labelled and not returned."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).alias("path")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
    one = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "path"), F.xxhash64("text", "path")).alias("d")).select("doc_id", "d.*")
    words = one.withColumn("__words", F.split("text", SPLIT)).withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(each))))
    words = words.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(seed), "__n", "doc_id"), 256))
    number = F.pmod(F.xxhash64("__h"), F.lit(1 << 30))
    at = F.pmod(number, F.size("__words") + 1).cast("int")
    plain = F.filter(F.transform(F.col("__words"), lambda w: F.regexp_extract(F.lower(w), "([a-z]{3,12})", 1)), lambda w: w != "")
    pick = lambda i: F.coalesce(F.get(plain, F.pmod(number + i, F.greatest(F.size(plain), F.lit(1))).cast("int")), F.lit("word"))
    words = words.select("doc_id", "path", "__n", "__words", "__h", at.alias("__at"), pick(0).alias("__a"), pick(7).alias("__b"))
    kinds = _kinds(F.col("__h"), F.col("__a"), F.col("__b"))
    chosen = F.get(F.array(*[F.struct(F.lit(y).alias("label"), a.alias("a"), v.alias("v"), z.alias("z")) for y, a, v, z in kinds]), F.pmod(F.xxhash64(F.lit("kind"), "__h"), F.lit(len(kinds))).cast("int"))
    rows = words.withColumn("__p", chosen)
    text = F.concat_ws(" ", F.slice("__words", F.lit(1), F.col("__at")), F.concat("__p.a", "__p.v", "__p.z"), F.slice("__words", F.col("__at") + 1, F.size("__words")))
    planted = stash(rows.select(F.struct("doc_id", "__n").alias("doc_id"), "path", text.alias("text"), "__p.v", "__p.label"), "planted")
    return candidates(planted, path_col="path").join(planted.select("doc_id", F.col("v").alias("value"), "label"), ["doc_id", "value"]).withColumn("doc_id", F.col("doc_id.doc_id"))


def _typed(rows: DataFrame) -> DataFrame:
    """``rows`` whose path feature is known as a category to the forest."""
    return rows.withColumn("f_path", F.col("f_path").alias("f_path", metadata={"ml_attr": {"type": "nominal", "num_vals": PATHS, "name": "f_path"}}))


def train(findings: DataFrame, most: int = 8000, trees: int = 30, depth: int = 8) -> PipelineModel | None:
    """A forest from labelled findings (features and ``label``, 0 or 1), ``most`` // 2 of either label at most, those of the
    smallest hashes. None with fewer than ``PATHS`` findings of either kind: the forest splits no category wider than its sample."""
    half = lambda y: findings.where(F.col("label") == y).orderBy(F.xxhash64("value", "doc_id", "word_no"), "doc_id", "word_no").limit(most // 2)
    sample = stash(half(0).unionByName(half(1)).select("label", *FEATURES).coalesce(1), "secret-sample")
    if sample.groupBy("label").count().where(F.col("count") >= PATHS).count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__x")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y")
    return PipelineModel([vectors, forest.fit(vectors.transform(_typed(sample.coalesce(1))))])


def scan_secrets(
    docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", min_chars: int = 12, planted: int = 2000
) -> DataFrame:
    """(doc_id, word_no, value_sha256, length, p_secret, is_secret): every candidate and the forest's verdict.
    ``findings`` are labelled ones, (value, label); without them, ``planted_findings`` of at most ``planted`` documents stand in.

    Defined cases: a null or empty text has no candidate; a null path is a path of its own; rows of one id are
    scanned one by one, repeated rows give repeated findings. With fewer than ``PATHS`` findings of either kind, p_secret is null and every candidate is reported as a secret, since none
    can be called a false positive. Extra columns are ignored. Texts are read twice and never shuffled, but for the sample."""
    found = stash(candidates(docs, id_col, text_col, path_col, min_chars), "secret-candidates")
    known = stash(planted_findings(docs, id_col, text_col, path_col, planted), "secret-planted") if findings is None else found
    cover = stash(dictionary_cover(found.unionByName(known.select(found.columns)), docs.select(F.col(text_col).alias("text"))), "secret-cover")
    rows = stash(features(found, cover), "secret-features")
    if findings is None:
        labelled = features(known, cover)
    else:
        labelled = rows.join(findings.where("label IS NOT NULL").groupBy("value").agg((F.avg("label") >= 0.5).cast("int").alias("label")), "value")
    model = train(labelled)
    p = F.lit(None).cast("double")
    if model is not None:
        rows, p = model.transform(_typed(rows)), F.round(F.get(vector_to_array("__p"), F.lit(1)), 9)
    verdict = F.coalesce(p >= threshold, F.lit(True))
    return rows.select("doc_id", "word_no", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("length"), p.alias("p_secret"), verdict.alias("is_secret"))


def op1_secret_scan(spark, sf_dir):
    """Candidates for secrets in all documents, with the forest's verdicts."""
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
