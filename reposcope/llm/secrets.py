"""Secret scan: a random forest removes the false positives of a broad pattern.

A candidate is a long run of letters, digits and a few signs that holds a
digit, any value assigned to a name that announces a secret, or a string in the
format of an issuer. Its features are its length and make-up, the likelihood of its character
transitions and the share of it that dictionary words cover (transitions and
dictionary are counted over all texts), its path, and the words beside it. The
forest is trained on labelled findings. Everything runs in DataFrame functions
and Spark's own forest; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import NO_ID, checkpointed, read, real_id

#: Long runs: at least 12 letters, digits, +, /, _ or - in a row, one digit among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}+"
#: Characters of text kept on either side of a candidate.
BESIDE = 48
#: Occurrences that make a word of the corpus a dictionary word.
COMMON = 10
#: Labelled findings of each class that the forest is trained on at most; its trees and depth.
SAMPLE, TREES, DEPTH = 10_000, 20, 6
THRESHOLD = 0.5

#: Words that announce a secret, and path parts that belong to tests and examples.
ANNOUNCING = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"
EXAMPLES = r"(?i)(^|[/_.\-])(tests?|specs?|examples?|samples?|fixtures?|docs?|mocks?|vendor|dist)([/_.\-]|$)"

#: Formats of issuers; digits need not be among them.
ISSUER = r"(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,})"
#: A name that announces a secret up to the value's quote; its parts are bounded, as it is looked for backward.
_NAME = ANNOUNCING.replace("(?i)(", "(?i:") + r"[\w\-]{0,40}[\"'`]?\s{0,4}[:=]{1,2}>?\s{0,4}"
#: Any value assigned to such a name: up to the closing quote, or unquoted without the punctuation at its end.
ASSIGNED = "|".join([rf"(?<={q})(?<=[:=]>?\s{{0,4}}{q})(?<={_NAME}{q})[^{q}\n]+(?={q})" for q in "\"'`"] + [rf"(?<=[\s:=>])(?<=[:=]>?\s{{0,4}})(?<={_NAME})(?![:=>])[^\s\"'`,;]+?(?=[.)\]}}]*(?:[\s\"'`,;]|$))"])
FOUND = rf"{ASSIGNED}|(?<![A-Za-z0-9+/_\-]){ISSUER}(?![A-Za-z0-9+/_\-])|{CANDIDATE}"

FEATURES = ["length", "digits", "uppers", "hex", "changes", "kinds", "transitions", "coverage", "example_path", "depth", "announced", "assigned", "quoted", "words_before", "words_after"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, path, position, candidate, before, after): every candidate with the text beside it.

    `position` counts the candidates of a row from 0. Null and empty texts have
    none, a null path is empty, rows that repeat give their candidates again.
    """
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), path.alias("path"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).filter(F.col("text").rlike(FOUND))
    found = rows.select("id", "path", F.split("text", FOUND, -1).alias("pieces"), F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)).alias("hits"))
    beside = F.transform(
        "hits",
        lambda h, i: F.struct(
            h.alias("candidate"),
            F.right(F.get("pieces", i), F.lit(BESIDE)).alias("before"),
            F.left(F.get("pieces", i + 1), F.lit(BESIDE)).alias("after"),
        ),
    )
    return found.select("id", "path", F.posexplode(beside).alias("position", "c")).select("id", "path", "position", "c.*")


def corpus_words(docs: DataFrame, text_col: str = "text", common: int = COMMON) -> DataFrame:
    """(word, n): the dictionary, words of 3 to 16 letters that occur `common` times or more in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(f"`{text_col}`").cast("string")), "[^a-z]+")).alias("word"))
    return words.filter(F.length("word").between(3, 16)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= common)


def _letter(c: Column) -> Column:
    """1 to 26 for a to z, 0 for any other character."""
    code = F.ascii(F.lower(c)) - 96
    return F.when(code.between(1, 26), code).otherwise(0)


def transition_table(words: DataFrame) -> list[float]:
    """log P(next letter | letter) at 27 * letter + next, from the dictionary and its counts; 729 numbers."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i")
    pairs = words.select("word", "n", at).select(_letter(F.expr("substring(word, i, 1)")).alias("a"), _letter(F.expr("substring(word, i + 1, 1)")).alias("b"), "n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    by_a = counts.groupBy("a").agg(F.sum("n").alias("all"))
    rows = counts.join(F.broadcast(by_a), "a").select("a", "b", F.log((F.col("n") + 1) / (F.col("all") + 27)).alias("p")).collect()
    table = [-9.0] * 729
    for r in rows:
        table[27 * r["a"] + r["b"]] = r["p"]
    return table


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The columns of `found` and FEATURES."""
    c = F.col("candidate")
    n = F.length(c)

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(c, pattern, "")) / n

    def count(column: str, pattern: str) -> Column:
        return F.regexp_count(F.col(column), F.lit(pattern)).cast("double")

    letters = F.transform(F.sequence(F.lit(1), n), lambda i: _letter(F.substr(c, i, F.lit(1))))
    table = F.array(*[F.lit(p) for p in transition_table(words)])
    numbered = found.withColumn("row", F.monotonically_increasing_id())
    runs = numbered.select("row", F.explode(F.split(F.lower("candidate"), "[^a-z]+")).alias("word")).filter(F.length("word") >= 3)
    covered = runs.join(words.select("word"), "word").groupBy("row").agg(F.sum(F.length("word")).alias("covered"))
    shaped = numbered.withColumn("letters", letters).withColumn("pairs", F.zip_with(F.slice("letters", F.lit(1), n - 1), F.slice("letters", F.lit(2), n - 1), lambda a, b: 27 * a + b))
    total = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + F.get(table, p))
    return (
        shaped.join(covered, "row", "left")
        .withColumns(
            {
                "length": n.cast("double"),
                "digits": share("[^0-9]"),
                "uppers": share("[^A-Z]"),
                "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
                "changes": count("candidate", r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]"),
                "kinds": F.size(F.array_distinct(F.split(F.lower(c), ""))) / n,
                "transitions": total / F.greatest(n - 1, F.lit(1)),
                "coverage": F.coalesce(F.col("covered"), F.lit(0)) / n,
                "example_path": F.col("path").rlike(EXAMPLES).cast("double"),
                "depth": count("path", "/"),
                "announced": F.col("before").rlike(ANNOUNCING + r"\W*$").cast("double"),
                "assigned": F.col("before").rlike(r"[:=]\s*[\"'`]?$").cast("double"),
                "quoted": F.col("before").rlike(r"[\"'`]$").cast("double"),
                "words_before": count("before", r"[^\s\d\W]{2,}"),
                "words_after": count("after", r"[^\s\d\W]{2,}"),
            }
        )
        .drop("row", "letters", "pairs", "covered")
    )


#: Planted findings (label, path, text around {v}, value); {h} 40 hex digits, {m} 64, {b} base64, {u} a UUID, {n} 16 digits,
#: {d} 6 digits, {w} and {x} words of the corpus, {l} 16 letters at random, {A} 16 capitals and digits, {g} 36 letters and digits.
PLANTS = [
    (1, "src/app.py", 'token = "{v}"', "{h}"), (1, "config/prod.env", "API_KEY={v}", "{b}"), (1, "deploy/values.yaml", "secret: {v}", "{m}"),
    (1, "src/db/connect.js", "password: '{v}',", "{w}{d}{x}"), (1, "src/mail.php", "$pwd = '{v}';", "{l}"), (1, "src/a.py", 'set password = "{v}" now', "{l}"),
    (1, "lib/aws.rb", "key {v} of", "AKIA{A}"), (1, "ci/run.sh", "clone with ghp_{v}", "{g}"), (1, "src/pay.ts", "sk_live_{v}", "{g}"),
    (1, "", "use {v} to log in", "{h}"), (1, "notes.md", "Authorization: Bearer {v}", "{b}"), (1, "src/client.go", "auth({v})", "{b}"), (1, "", 'token = "{v}"', "{h}"),
    (0, "", "card {v} paid", "{n}"), (0, "", "at {v} and", "{n}"), (0, "", "{v}", "{n}"), (0, "CHANGELOG", "commit {v} of build", "{h}"), (0, "package.lock", 'integrity "sha512-{v}"', "{b}"),
    (0, "tests/x.py", "commit {v} of build", "{h}"), (0, "tests/login.py", 'password = "{v}"', "{w}{d}"), (0, "docs/setup.md", "token = {v}", "your_{w}_here"),
    (0, "examples/app.py", 'api_key = "{v}"', "xxxxxxxxxxxx{d}"), (0, "src/form.js", 'password = "{v}"', "enter_{w}_{x}_2"), (0, "src/user.java", 'token = "{v}"', "get{w}Token{d}"),
    (0, "src/db.sql", 'id = "{v}"', "{u}"), (0, "src/app.py", "import {v}", "src/{w}/{x}_v2/{w}"), (0, "", "file {v}.png", "{w}-{x}-{d}{d}"), (0, "", "sum {v}", "{m}"),
    (0, "src/theme.css", "class={v}", "{w}-{x}-{d}"), (0, "src/config.ts", "secret: '{v}'", "process.env.{w}_{d}"),
]


def planted_findings(docs: DataFrame, words: DataFrame, per_plant: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled findings (id, path, candidate, before, after, label, held_out): PLANTS among words of the corpus.

    Positives are values that give access; the negatives look like them or
    stand where they stand: placeholders, checksums, numbers, names. The text
    around them is cut from `per_plant` documents, in the order of a hash. A
    third is held out, by the document.
    """
    carriers = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.translate(F.left(F.col(f"`{text_col}`").cast("string"), F.lit(4000)), "\n=:\"'`", " ").alias("text"))
    carriers = carriers.filter("id IS NOT NULL AND length(text) > 0").orderBy(F.xxhash64("id"), "id", "text").limit(per_plant)
    common = words.orderBy(F.desc("n"), "word").limit(1000).agg(F.sort_array(F.collect_list("word")).alias("vocabulary"))
    plants = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(x).alias(c) for c, x in zip(("label", "path", "around", "value"), plant)]) for k, plant in enumerate(PLANTS)])
    rows = carriers.crossJoin(F.broadcast(common)).select("id", "text", "vocabulary", F.explode(plants).alias("p")).select("id", "text", "vocabulary", "p.*")

    def number(salt: int) -> Column:
        return F.pmod(F.xxhash64("id", "k", F.lit(salt)), F.lit(2**31))

    def digest(salt: int) -> Column:
        return F.sha2(F.concat_ws("/", "id", "k", F.lit(salt)), 256)

    def word(salt: int) -> Column:
        return F.coalesce(F.get("vocabulary", F.pmod(number(salt), F.greatest(F.size("vocabulary"), F.lit(1))).cast("int")), F.lit("name"))

    mixed_case = F.translate(F.base64(F.unhex(digest(1))), "+/=", "aB7")
    h = digest(2)
    fills = {
        "{h}": F.left(digest(3), F.lit(40)), "{m}": digest(4), "{b}": F.regexp_replace(F.base64(F.unhex(digest(5))), "=", ""), "{w}": word(6), "{x}": word(7),
        "{u}": F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
        "{n}": F.concat(F.lit("4"), F.lpad(number(8).cast("string"), 10, "7"), F.lpad((number(9) % 100000).cast("string"), 5, "3")),
        "{d}": F.lpad((number(10) % 1000000).cast("string"), 6, "1"), "{l}": F.translate(F.left(digest(11), F.lit(16)), "0123456789", "qrstuvwxyz"),
        "{A}": F.upper(F.left(digest(12), F.lit(16))), "{g}": F.left(mixed_case, F.lit(36)),
    }
    value = F.col("value")
    for mark, fill in fills.items():
        value = F.replace(value, F.lit(mark), fill)
    at = F.pmod(number(13), F.greatest(F.length("text") - 100, F.lit(1))).cast("int") + 1
    said = F.concat_ws(" ", F.substr("text", at, F.lit(50)), F.replace(F.col("around"), F.lit("{v}"), value), F.substr("text", at + 50, F.lit(50)))
    made = rows.select((F.xxhash64("id", "k")).alias("plant"), "id", "label", "path", value.alias("value"), said.alias("text"))
    found = candidates(made.select("plant", "text", "path"), "plant", "text", "path").withColumnRenamed("id", "plant").drop("path")
    known = found.join(made.drop("text"), "plant").filter(F.col("candidate").contains(F.col("value")) | F.col("value").contains(F.col("candidate")))
    return known.select("id", "path", "candidate", "before", "after", "label", (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(3)) == 0).alias("held_out"))


def verdicts(findings: DataFrame, words: DataFrame) -> dict[str, float]:
    """Precision and recall on the held-out findings, with the forest and (all candidates reported) without it."""
    shaped = checkpointed(features(checkpointed(findings), words))
    scored = judged(shaped.filter("held_out"), train_forest(shaped.filter("NOT held_out")))
    hit = (F.col("score") >= THRESHOLD).cast("int")
    r = scored.agg(F.sum("label").alias("true"), F.count(F.lit(1)).alias("all"), F.sum(hit).alias("found"), F.sum(hit * F.col("label")).alias("right")).first()
    return {"precision": r["right"] / max(r["found"], 1), "recall": r["right"] / max(r["true"], 1), "precision_without": r["true"] / max(r["all"], 1), "recall_without": 1.0}


def train_forest(findings: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest from findings with FEATURES and a label of 0 or 1; None if a class is missing.

    At most `sample` findings per class are used, in the order of a hash.
    """
    known = findings.filter("label IN (0, 1)")
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("candidate", "before", "after"), "candidate").limit(sample) for k in (0, 1)]
    chosen = checkpointed(reduce(DataFrame.unionByName, parts).select(*FEATURES, F.col("label").cast("double").alias("label")))
    if chosen.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(chosen)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt")
    return forest.fit(vectors.select("x", "label"))


def judged(found: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """The columns of `found` and score; 0.5 without a forest."""
    if forest is None:
        return found.withColumn("score", F.lit(0.5))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found)
    return forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, path, position, candidate, score, finding.

    `findings` are labelled candidates: path, candidate, before, after, label;
    without them `planted_findings` of this corpus are used. Without both
    classes nothing can be learned and every candidate scores 0.5 and is
    reported. Null ids stay null; an empty table gives no rows; other columns of
    the table are not read.
    """
    words = checkpointed(corpus_words(docs, text_col))
    found = features(checkpointed(candidates(docs, id_col, text_col, path_col)), words)
    known = planted_findings(docs, words, id_col=id_col, text_col=text_col) if findings is None else findings
    scored = judged(found, train_forest(features(checkpointed(known), words)))
    return scored.select(real_id("id").alias("doc_id"), "path", "position", "candidate", "score", (F.col("score") >= THRESHOLD).alias("finding"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all candidates of all documents with the forest's verdict."""
    found = scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "position", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "finding")
