"""Secret scan: candidates by pattern, false positives removed by a random forest over features of the candidate.

Candidates, features, training and scoring are DataFrame operations and Spark's own forest; no Python runs on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

# Words that stand beside secrets, words that stand beside other long strings, and everyday pieces of words.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "auth", "credential", "private_key", "private key", "bearer")
HARMLESS_WORDS = ("sha1", "sha256", "md5", "checksum", "commit", "revision", "version", "isbn", "uuid", "order", "phone", "tel", "card", "call", "http", "https", "example", "id")
DICTIONARY = (
    "about", "access", "account", "admin", "after", "algorithm", "application", "before", "change", "change me", "changeme", "class", "config", "country", "data", "default", "demo",
    "document", "dummy", "example", "experiment", "file", "function", "hello", "house", "image", "index", "letmein", "library", "machine", "mail", "message", "model", "name", "network",
    "number", "page", "pass", "password", "placeholder", "program", "public", "result", "sample", "secret", "server", "service", "string", "system", "table", "test", "text", "token",
    "update", "user", "value", "version", "water", "welcome", "winter", "word", "world", "your", "tion", "ment", "ing", "the", "and", "com", "www",
)
SHAPED = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}"
# What strings that scans mistake for secrets look like: addresses, numbers, identifiers, versions.
HARMLESS = r"[^@\s]+@[^@\s]+|[0-9.,:+()-]+|(?i:https?://\S+|www\.\S+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|v?[0-9]+(?:\.[0-9]+)+\S*)"
# a secret's name and = or :, the same with a value behind it, and a part of a word: a value between marks, with its name
ASSIGN = rf"(?i)(?:{'|'.join(SECRET_WORDS)})(?![a-z])[a-z0-9_-]{{0,30}}[\"'\\]*\s*[=:]"
VALUE = ASSIGN + r"+>?\s*[^\sA-Za-z0-9]*[A-Za-z0-9]\S*$"
PART = r"(?:[A-Za-z_][A-Za-z_-]{1,29}[\"'\\]*[=:][\"'\\]*)?[^\s\"'`,;&=:?<>{}()\[\]|]+=*"
# user and password in an address: what stands before the password, and the password
LOGIN = r"([A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@]{0,100}):([^\s/@]{1,200})@"
CANDIDATES = "array<struct<before: string, word: string, after: string>>"
FEATURES = ("length", "changes", "different", "digits", "upper", "hex", "shaped", "covered", "test_path", "assigned", "secret_near", "harmless_near", "words_near", "punctuated")


def candidates(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """Words and parts of words that could be secrets: doc_id, word_no, path, before, word, after.

    A candidate is a white-space separated word of 10 characters or more that holds a digit, a shaped key or the
    assignment of a secret's name, or a word of any length that follows such a name and = or :. A word of several parts
    (see PART) gives each part that is such by itself, too, and each shaped key within it; its length doesn't count.
    The password of an address (see LOGIN) is one whatever it looks like. What holds no letter and no digit is none.
    ``before`` is the two words before it, or the part before it (for an address's password the user and ``password:``),
    ``after`` the next word. Null and empty texts have none; rows that repeat have theirs each; a null doc_id or path stays null or empty.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    words = words.filter(F.col("text").rlike("[0-9]") | F.col("text").rlike(ASSIGN) | F.col("text").rlike(SHAPED) | F.col("text").rlike(LOGIN)).withColumn("words", F.split("text", r"\s+"))
    fits = lambda w: (F.length(w) >= 10) & (w.rlike("[0-9]") | w.rlike(SHAPED) | w.rlike(ASSIGN))
    word = lambda no: F.coalesce(F.get("words", no), F.lit(""))
    follows = lambda w, i: F.concat(word(i - 1), w).rlike("[=:]") & w.rlike("[A-Za-z0-9]") & F.concat_ws(" ", word(i - 2), word(i - 1), w).rlike(VALUE)
    tried = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("no"), w.alias("word"), follows(w, i).alias("follows"))), lambda x: fits(x["word"]) | x["follows"] | x["word"].rlike(LOGIN))
    hits = words.withColumn("hit", F.explode(tried))
    at = lambda k: word(F.col("hit.no") + k)
    whole = hits.select(
        "doc_id", F.col("hit.no").alias("word_no"), "path", F.concat_ws(" ", at(-2), at(-1)).alias("before"), F.col("hit.word").alias("word"), at(1).alias("after"), F.col("hit.follows").alias("follows"),
        F.regexp_extract_all("hit.word", F.lit(PART), F.lit(0)).alias("parts"),
    )
    made = lambda before, w, after: F.struct(before.alias("before"), w.alias("word"), after.alias("after"))
    near = lambda j: F.when(j == 0, F.col("before")).otherwise(F.substring(F.coalesce(F.get("parts", j - 1), F.lit("")), -60, 60))
    held = F.transform("parts", lambda p, j: F.struct(made(near(j), p, F.when(j == F.size("parts") - 1, F.col("after")).otherwise(F.lit(""))).alias("c"), (fits(p) | p.rlike(VALUE) | ((j == 0) & F.col("follows"))).alias("fits")))
    several = F.when(F.size("parts") > 1, F.transform(F.filter(held, lambda x: x["fits"]), lambda x: x["c"])).otherwise(F.array().cast(CANDIDATES))
    keys = F.array_distinct(F.regexp_extract_all("word", F.lit(f"({SHAPED})"), F.lit(0)))
    alone = lambda k: (value_of(F.col("word")) != k) & ~F.exists("parts", lambda p: value_of(p) == k)
    shaped = F.when(F.col("word").rlike(SHAPED), F.transform(F.filter(keys, alone), lambda k: made(F.col("before"), k, F.lit("")))).otherwise(F.array().cast(CANDIDATES))
    users, passwords = (F.regexp_extract_all("word", F.lit(LOGIN), F.lit(k)) for k in (1, 2))
    logins = F.zip_with(users, passwords, lambda u, p: made(F.concat(F.substring(u, -60, 60), F.lit(" password:")), p, F.lit("")))
    logins = F.when(F.col("word").rlike(LOGIN), logins).otherwise(F.array().cast(CANDIDATES))
    found = whole.select("doc_id", "word_no", "path", F.inline(F.concat(F.array(made(F.col("before"), F.col("word"), F.col("after"))), several, shaped, logins)))
    return found.filter(value_of(F.col("word")) != "")


def value_of(word: Column) -> Column:
    """The word without an assigned name before it and marks around it."""
    bare = F.regexp_replace(word, r"^[^A-Za-z0-9]*(?:[A-Za-z_-]{2,30}[\"'\\]*[=:])?[^A-Za-z0-9]*", "")
    return F.regexp_replace(bare, r"[^A-Za-z0-9=]+$", "")


def features(found: DataFrame) -> DataFrame:
    """``found`` with the value and its features, all of them numbers."""
    f = found.withColumn("value", value_of(F.col("word")))
    v, low = F.col("value"), F.lower("value")
    length = F.greatest(F.length(v), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / length
    near = F.lower(F.concat_ws(" ", "before", F.regexp_extract("word", r"^([^0-9]*?[=:])", 1)))
    mentions = lambda names: reduce(Column.__or__, [near.contains(n) for n in names]).cast("double")
    return f.select(
        "*", F.length(v).cast("double").alias("length"),
        ((F.size(F.regexp_extract_all(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))) - 1) / length).alias("changes"),
        (F.size(F.array_distinct(F.split(v, ""))) / length).alias("different"),
        share("[^0-9]").alias("digits"), share("[^A-Z]").alias("upper"), v.rlike("^[0-9a-f]+$").cast("double").alias("hex"), v.rlike(f"^({SHAPED})$").cast("double").alias("shaped"),
        (1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / length).alias("covered"),
        F.lower("path").rlike("test|example|sample|mock|fixture|doc/").cast("double").alias("test_path"),
        F.concat_ws(" ", "before", "word").rlike(r"[=:]\s*[\"']?[A-Za-z0-9+/_=.-]+[^A-Za-z0-9]*$").cast("double").alias("assigned"),
        mentions(SECRET_WORDS).alias("secret_near"), mentions(HARMLESS_WORDS).alias("harmless_near"),
        F.lower("after").rlike("^[a-z]+[,.]?$").cast("double").alias("words_near"), share("[A-Za-z0-9]").alias("punctuated"),
    )


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled findings made by rule: path, before, word, after, label. Fixed for a given ``n``.

    Half are secrets (hex and base-64 tokens, passwords with and without digits, short ones, those of addresses, shaped keys) beside a secret's name, half are what
    scans mistake for them: hashes under their names, numbers, addresses, placeholders, words with digits or behind a name.
    """
    kinds = 28
    r = spark.range(n).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).withColumn("k", (F.col("id") % kinds).cast("int"))
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("id") / kinds % len(xs) + 1).cast("int"))
    part = lambda s, n: F.substring("h", s, n)
    number = lambda s, n: F.translate(part(s, n), "abcdef", "012345")
    name = pick("password", "token", "secret", "api_key", "passwd", "auth")
    text = pick("the", "and of", "is then", "la de", "und", "was with")
    b64 = F.substring(F.base64(F.unhex("h")), 1, 32)
    upper = F.upper(F.translate(part(1, 16), "0123456789", "ghjkmnpqrs"))
    letters = lambda s, n: F.translate(part(s, n), "0123456789abcdef", "aeioustrnlmcdhpb")
    cat = F.concat
    rows = [  # before, word, label
        (cat(name, F.lit(" =")), cat(F.lit('"'), part(1, 40), F.lit('"')), 1), (text, cat(name, F.lit("="), part(3, 18)), 1), (text, cat(F.lit("AKIA"), upper), 1),
        (cat(name, F.lit(" :")), cat(F.lit("'"), b64, F.lit("'")), 1), (text, cat(name, F.lit("="), b64), 1), (text, cat(F.lit("ghp_"), part(1, 36)), 1),
        (cat(text, F.lit(" "), name, F.lit(":")), cat(part(1, 20)), 1), (cat(name, F.lit(" =")), cat(F.lit('"'), part(5, 32), F.lit('"')), 1),
        (pick("sha1", "md5", "commit", "checksum", "revision of"), part(1, 40), 0), (text, number(1, 16), 0),
        (text, cat(number(1, 2), F.lit("."), number(3, 2), F.lit("."), number(5, 3), F.lit("."), number(8, 2)), 0), (text, cat(part(1, 4), F.lit("."), number(1, 2), F.lit("@mail"), number(4, 1), F.lit(".example.com")), 0),
        (cat(name, F.lit(" =")), pick('"changeme123"', '"your-token-here-1"', '"example_password1"', '"placeholder-secret-0"', '"test-user-password-1"'), 0),
        (text, cat(pick("documentation", "experiment", "configuration", "application"), number(1, 2)), 0),
        (cat(name, F.lit(" =")), cat(F.lit('"'), F.substring(b64, 3, 16), F.lit('1"')), 1), (text, cat(name, F.lit("="), F.substring(b64, 5, 12), F.lit("7")), 1),
        (text, F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), 0), (cat(text, F.lit(" version")), cat(F.lit("v"), number(1, 1), F.lit("."), number(2, 2), F.lit(".0-beta"), number(5, 2)), 0),
        (text, cat(F.lit("https://www.example.com/page/"), number(1, 6)), 0), (cat(text, F.lit(" order")), cat(number(1, 4), F.lit("-"), number(5, 4), F.lit("-"), number(9, 6)), 0),
        (cat(name, F.lit(" =")), cat(F.lit('"'), letters(1, 19), F.lit('"')), 1), (text, cat(name, F.lit("="), letters(3, 14)), 1),
        (cat(text, F.lit(" "), name, F.lit(":")), pick("the", "is", "please", "required", "which", "and", "string", "none,", "see", "a", "placeholder", "example"), 0),
        (cat(name, F.lit(" =")), pick('"changeme"', "None", "get_password()", '"your-password"', "null;", '"example-token"', "os.environ", '"password"', "request.token", '"placeholder"', "config.secret", '""'), 0),
        (F.lit("PRIVATE KEY-----"), cat(b64, F.base64(F.unhex(F.reverse("h")))), 1),
        (cat(text, F.lit(" "), name, F.lit(":")), cat(letters(7, 6), number(2, 1)), 1), (cat(pick("postgres", "https", "mysql", "amqp"), F.lit("://"), letters(1, 5), F.lit(" password:")), cat(letters(9, 5), upper.substr(1, 2), number(4, 2)), 1),
        (cat(pick("postgres", "https", "mysql", "amqp"), F.lit("://user password:")), pick("password", "changeme", "your-password", "example", "secret", "test", "pass"), 0),
    ]
    case = lambda i: reduce(lambda acc, x: acc.when(F.col("k") == x[0], x[1][i] if i < 2 else F.lit(x[1][i])), enumerate(rows), F)
    return r.select(pick("src/app.py", "src0", "conf/site.yaml", "tests/test_a.py", "docs", "src1").alias("path"), case(0).alias("before"), case(1).alias("word"), text.alias("after"), case(2).cast("double").alias("label"))


def findings_in(docs: DataFrame, sample_rows: int = 20_000, path_col: str = "source") -> DataFrame:
    """Labelled findings in the documents themselves: path, before, word, after, label, as labelled_findings() has them.

    Labels are those that need no model: a shaped key, or a value of 12 characters or more with several kinds of them
    that is assigned to a secret's name, is a secret; addresses, numbers, identifiers and versions under no secret's name, and
    what stands behind a harmless name, are none. Other candidates teach nothing. At most ``sample_rows`` different
    findings are taken, first by a hash of the finding, so copies count once.
    """
    found = candidates(docs, path_col).withColumn("value", value_of(F.col("word")))
    v, near = F.col("value"), F.lower(F.concat_ws(" ", "before", F.regexp_extract("word", r"^([^0-9]*?[=:])", 1)))
    named = F.concat_ws(" ", "before", "word").rlike(VALUE)
    mixed = (F.length(v) >= 12) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(f"^(?:{HARMLESS})$")
    behind = near.rlike(r"\b(?:" + "|".join(HARMLESS_WORDS) + r")\b[\s=:]*(?:of\s*)?$")
    label = F.when(v.rlike(f"^({SHAPED})$") | (named & mixed), 1.0).when(~named & ~near.rlike("|".join(SECRET_WORDS)) & (v.rlike(f"^(?:{HARMLESS})$") | behind), 0.0)
    rows = found.withColumn("label", label).filter("label IS NOT NULL").select("path", "before", "word", "after", "label")
    key = F.xxhash64("before", "word", "after")
    # written, as a forest reads its sample several times
    return stage(rows.groupBy(key.alias("h")).agg(*[F.min(c).alias(c) for c in rows.columns]).orderBy("h").limit(sample_rows).drop("h"), "findings")


def rated(findings: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> dict[str, float | None]:
    """n, precision and recall of the model on labelled findings; None where nothing is found or nothing is a secret."""
    rows = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings)))
    said, true = vector_to_array("probability").getItem(1) >= threshold, F.col("label") > 0.5
    n, hits, named, secrets = rows.agg(F.count("*"), F.count_if(said & true), F.count_if(said), F.count_if(true)).first()
    return {"n": n, "precision": hits / named if named else None, "recall": hits / secrets if secrets else None}


def fit(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 11) -> RandomForestClassificationModel:
    """A forest over labelled findings (before, word, after, path, label); nulls in them count as empty."""
    findings = findings.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("path", "before", "word", "after")], "label")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.select("features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, path_col: str = "source") -> DataFrame:
    """Every candidate with its score: doc_id, word_no, value, score double, is_secret boolean.

    Null and empty texts have no candidates, an empty table gives none, rows that repeat have theirs each, ties don't
    matter; a null doc_id stays null. Only doc_id, text and the path's column (if there) are read, so further columns can have
    any name. Long texts are read whole.
    """
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(candidates(docs, path_col)))
    score = vector_to_array("probability").getItem(1)
    return model.transform(rows).select("doc_id", "word_no", "value", score.alias("score"), (score >= threshold).alias("is_secret"))
