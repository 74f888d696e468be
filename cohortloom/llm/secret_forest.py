"""Secret scan with a random forest against false positives (operator 6), in DataFrame functions only.

Candidates are all runs of 12 or more signs of keys with a digit, in whole texts, several per word where it has several,
and values of four or more signs of any kind that an assignment or, up to three words back, a key word stands before, or
that are the password in a URL. Each has its length, its character classes and the changes
between them, the share of its letters that dictionary words cover, its document's path, and the words around it. A
random forest trained on labelled findings turns these into a score. The dictionary is counted over all documents.
Without labelled findings of one's own, those of ``planted_findings`` are used: texts with a planted value each, whose
labels do not come from the features.

Defined results: null and empty texts have no candidates. A null path has no path features. Repeated rows give repeated
findings. If the labelled findings lack one of the two labels, the score is the label of all (0 without any). An empty
table gives an empty result. Findings with equal features have equal scores; a score of exactly 0.5 is a secret. Words of any
length are read whole, and only the named columns. Values are returned as hashes, so that a result does not spread secrets.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.labels import first_match
from cohortloom.llm.common import WHITE, cut, text_or_empty
from cohortloom.llm.planted_findings import planted

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_changes", "f_distinct", "f_signs", "f_covered", "f_path_depth",
            "f_path_test", "f_key_before", "f_key_after", "f_assigned", "f_quoted", "f_in_url", "f_key_distance"]
# Words that name a secret, paths that hold examples, and how keys of providers start.
KEY_WORDS = "key|token|secret|passw|pwd|auth|api|credential|bearer"
TEST_PATHS = "test|example|sample|doc|fixture|mock"


STARTS = "AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_(?:live|test)_|AIza"
# User and password of a URL; a value that is assigned to a name; a run of signs of keys.
BEFORE = "\x01"
MATCH = (r"([A-Za-z][A-Za-z0-9+.-]*)://[^\s:/@]*:([^\s@/]+)@"
         r"|([A-Za-z_\x01][A-Za-z0-9_.-]*)[\"'`\]]*(?:=>|[=:]+)(?!//)[\"'`\[(]*([^\s\"'`,;&<>(){}\[\]|]{4,})"
         r"|([A-Za-z0-9_+/-]{12,}={0,2})")


def candidates(df: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """One row per candidate: id, path, place (word from 0), nth (candidate of the word, from 0), key, value, and the
    words before and after. A value after a word that assigns, or at most three words after one that names a key, is
    read as if it were assigned."""
    words = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{path}`").cast("string").alias("path"),
                      F.filter(F.split(text_or_empty(text), WHITE), lambda x: x != "").alias("w"))
    # Per word: whether it assigns (2) or names a key (1); looked up three words back, one for what assigns.
    words = words.withColumn("k", F.transform("w", lambda x: F.when(F.lower(x).rlike(KEY_WORDS), F.lit(1)).when(x.rlike("[=:]$"), F.lit(2)).otherwise(F.lit(0))))
    after_key = lambda i: F.coalesce(F.get("k", i - 1) > 0, F.lit(False)) | (F.get("k", i - 2) == 1).eqNullSafe(True) | (F.get("k", i - 3) == 1).eqNullSafe(True)
    found = F.filter(F.transform("w", lambda x, i: F.when(
        ((F.length(x) >= 12) & x.rlike(f"[0-9]|{STARTS}")) | x.rlike("[=:]") | after_key(i),
        F.struct(i.alias("place"), x.alias("raw"), F.get("w", i - 1).alias("b1"), F.get("w", i - 2).alias("b2"), F.get("w", i - 3).alias("b3"), F.get("w", i + 1).alias("a1"),
                 F.when(after_key(i), F.concat(F.lit(f"{BEFORE}="), x)).otherwise(x).alias("read")))),
        lambda s: s.isNotNull())
    rows = words.select("id", "path", F.explode_outer(found).alias("s")).where(F.col("s").isNotNull()).select("id", "path", "s.*")
    parts = F.arrays_zip(*[F.regexp_extract_all("read", F.lit(MATCH), F.lit(k)).alias(f"m{k}") for k in range(1, 6)])
    rows = rows.select("id", "path", "place", "raw", "b1", "b2", "b3", "a1", F.posexplode_outer(parts).alias("nth", "m")).where(F.col("m").isNotNull())
    key = F.replace(F.concat("m.m1", "m.m3"), F.lit(BEFORE), F.lit(""))
    # The signs that end a sentence do not belong to a value.
    value = F.regexp_replace(F.concat("m.m2", "m.m4", "m.m5"), r"[.,;:?]+$", "")
    rows = rows.withColumn("key", key).withColumn("value", value).where((F.length("value") >= 4) | (F.col("m.m2") != ""))
    rows = rows.where((F.col("value") != "") & ((F.col("m.m5") == "") | F.col("raw").rlike(f"[0-9]|{STARTS}"))).withColumn("in_url", F.col("m.m2") != "")
    return rows.select("id", "path", F.col("place").cast("long").alias("place"), F.col("nth").cast("long").alias("nth"), "raw", "key", "value", "in_url", "b1", "b2", "b3", "a1")


def dictionary(df: DataFrame, text: str, least: int) -> DataFrame:
    """Words of three or more letters that at least ``least`` documents hold, counted over all documents."""
    words = F.array_distinct(F.filter(F.split(F.lower(text_or_empty(text)), r"[^a-zß-ÿ]+"), lambda x: F.length(x) >= 3))
    counts = df.select(F.explode_outer(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= least) & F.col("word").isNotNull()).select("word")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the columns of :data:`FEATURES`."""
    parts = found.select("value").distinct().select("value", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{3,})"), F.lit(1)))).alias("word"))
    covered = parts.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered")).withColumnRenamed("value", "c_value")
    rows = found.join(covered, F.col("value") == F.col("c_value"), "left").drop("c_value")
    number = lambda c: c.cast("double")
    without = lambda pattern: number(F.length("value") - F.length(F.regexp_replace("value", pattern, "")))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    around = F.lower(F.concat_ws(" ", "key", "b3", "b2", "b1"))
    return rows.select(
        "id", "path", "place", "nth", "raw", "key", "value", "in_url", "b1", "b2", "b3", "a1", number(F.length("value")).alias("f_length"), without("[0-9]").alias("f_digits"), without("[A-Z]").alias("f_upper"),
        without("[a-z]").alias("f_lower"), number(F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1).alias("f_changes"),
        number(F.size(F.array_distinct(F.split("value", "")))).alias("f_distinct"),
        without("[^A-Za-z0-9]").alias("f_signs"),
        (F.coalesce("covered", F.lit(0)) / F.length("value")).cast("double").alias("f_covered"),
        number(F.coalesce(F.size(F.split("path", "/")), F.lit(0))).alias("f_path_depth"),
        number(F.coalesce(F.lower("path").rlike(TEST_PATHS).cast("int"), F.lit(0))).alias("f_path_test"),
        number(around.rlike(KEY_WORDS).cast("int")).alias("f_key_before"),
        number(F.coalesce(F.lower("a1").rlike(KEY_WORDS).cast("int"), F.lit(0))).alias("f_key_after"),
        number(((F.col("key") != "") | F.coalesce(F.col("b1").rlike("[=:]$"), F.lit(False))).cast("int")).alias("f_assigned"),
        number(F.col("raw").rlike("[\"'`]").cast("int")).alias("f_quoted"), number(F.col("in_url").cast("int")).alias("f_in_url"),
        number(first_match([(F.lower(F.concat_ws(" ", "key", "b1")).rlike(KEY_WORDS), F.lit(0)), (F.lower("b2").rlike(KEY_WORDS), F.lit(1)),
                            (F.lower("b3").rlike(KEY_WORDS), F.lit(2))], F.lit(5))).alias("f_key_distance"))


def labelled_findings(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Features and ``label`` of the values planted in ``texts`` (see ``planted_findings``); what else stands there has no label."""
    own = texts.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") >= 3).groupBy("word").count()
    known = words.union(own.where("count >= 5").select("word")).distinct()  # the surroundings are a language of their own
    found = with_features(candidates(texts, "doc_id", "text", "source"), known)
    labels = texts.select(F.col("doc_id").alias("l_id"), F.col("value").alias("l_value"), "label")
    # A candidate may end before the last signs of what was planted, or hold quotes around it.
    return found.join(labels, (F.col("id") == F.col("l_id")) & (F.col("l_value").contains(F.col("value")) | F.col("value").contains(F.col("l_value")))).drop("l_id", "l_value")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", labelled: DataFrame | None = None,
         sample: int = 20_000, least_documents: int = 5, trees: int = 40, depth: int = 10, seed: int = 5) -> DataFrame:
    """Every candidate: id, place, key, value_hash, n_chars, score and is_secret (score at least 0.5).

    ``labelled`` holds findings with features and ``label``; without it, planted ones are used. The fit takes at most
    ``sample`` of each label, the first by a hash; of equal hashes those with smaller features.
    """
    words = cut(dictionary(df, text, least_documents))
    found = cut(with_features(cut(candidates(df, doc_id, text, path)), words))
    if labelled is None:
        labelled = cut(labelled_findings(cut(planted(df.sparkSession)), words))
    known = labelled.where(F.col("label").isNotNull())
    known = known.select(*FEATURES, "label", F.xxhash64("value", "id", "place", "nth").alias("at"))
    part = [known.where(F.col("label") == y).orderBy("at", *FEATURES).limit(sample) for y in (0.0, 1.0)]
    train = cut(part[0].union(part[1]).drop("at"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(sizes) == 2:
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
        model = forest.fit(assembler.transform(train))
        rows = model.transform(assembler.transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        rows = found.withColumn("score", F.lit(float(next(iter(sizes), 0.0))))
    return rows.select("id", "place", "key", F.sha2("value", 256).alias("value_hash"), F.length("value").cast("long").alias("n_chars"), "score",
                       (F.col("score") >= 0.5).alias("is_secret"))
