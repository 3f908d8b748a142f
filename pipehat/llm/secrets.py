"""Secret scans: candidates by pattern, false positives removed by a random forest, all of it native.

Candidates are, in this order: private key blocks, signed tokens of three parts, whatever is assigned to a name that says secret (``SHORTEST`` characters or
more, of any kind but white space, quotes and separators), and runs of key characters that hold a digit and have ``LEAST`` characters or more. Their
features are length, characters and the changes between their kinds, how likely their letters follow one another in the corpus, the share of them that
words of the corpus cover, their path and the words beside them. Letter pairs and words are counted over all documents. The forest is grown by Spark's own library from
labelled findings (any table of candidate, before, after, path and label; generated ones where there is none) and becomes plain column
expressions, so scoring is part of the scan's plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, written

LEAST, SHORTEST, LONGEST = 16, 6, 200
# Fixed lists: names of things that are secret, words that speak for or against a secret, known prefixes.
ASSIGNED = "passw(?:or)?d|passwd|passphrase|pwd|secret|token|api[_-]?key|auth[_-]?key|access[_-]?key|private[_-]?key|credentials?|signing[_-]?key|key"
#: Every run starts behind a character that no run holds, and nothing is tried twice: linear time.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{14}[A-Za-z0-9+/_=-]{2})[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*+={0,2}+"
BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=,:\s-]{0,20000}?-----END [A-Z ]{0,30}PRIVATE KEY-----"
SIGNED = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+(?:\.[A-Za-z0-9_-]*+)?"
VALUE = r"(?<=[:=\s\"'])(?<=(?i:" + ASSIGNED + r")[\"']?\s{0,2}[:=]\s{0,2}[\"']?)(?![\"'\s:=])[^\s\"'`,;<>()\[\]{}]{" + f"{SHORTEST},{LONGEST}" + "}+"
CANDIDATE = f"{BLOCK}|{SIGNED}|{VALUE}|{RUN}"
#: What the kinds before the last need somewhere in a text; without it, runs are all there is, and the shorter pattern finds the same.
NAMED = f"(?i)(?:{ASSIGNED})[\"']?\\s{{0,2}}[:=]"
CONTEXT = 48
TREES, DEPTH, SEED = 24, 7, 5
TRAINING_ROWS = 12_000
TAKEN = 0.5

SECRET_WORDS = "token|secret|passw|passphrase|pwd|api_?key|apikey|auth|bearer|credential|private|access|signing|^key$"
PLAIN_WORDS = "commit|sha|md5|sum|hash|uuid|guid|version|href|src|build|etag|serial|order|isbn|invoice"
PREFIXES = "^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|eyJ|AIza|glpat-|-----BEGIN)"
PLACEHOLDERS = r"(?i)^[\W_]*(x{4,}|\*{3,}|\.{3,}|0{6,}|(your|my|some|the)[_-]?\w*|changeme|example\w*|placeholder|none|null|true|false|undefined|required|optional|\$\{?\w+\}?|%\w+%?)"
TEST_PATHS = "(test|example|sample|fixture|mock|docs?/)"
#: Words of the generated findings where no vocabulary is given.
WORDS = ("about", "after", "book", "code", "data", "edition", "file", "first", "guide", "home", "image", "index", "large", "model", "name", "news", "number", "page", "report", "search", "series", "text", "thumb", "user", "video")
#: The words that cover a candidate: those of LETTERS letters or more that occur OFTEN times or more in the corpus.
LETTERS, OFTEN = 3, 3

FEATURES = ("n_length", "digits", "uppers", "lowers", "symbols", "changes", "distinct", "hex", "numeric", "covered", "likely", "letters_only", "strange", "placeholder", "parts", "prefix", "said_password", "said_secret", "said_plain", "assigned", "quoted", "test_path", "after_plain")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the lower-case runs of the letters a to z in all texts, and how often they occur."""
    found = F.split(F.lower("text"), "[^a-z]+")
    return docs.where("text is not null").select(F.explode(found).alias("word")).where("length(word) between 2 and 40").groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(vocable) of ``word_counts``."""
    return counts.where((F.length("word") >= LETTERS) & (F.col("n") >= OFTEN)).select(F.col("word").alias("vocable"))


def transitions(counts: DataFrame) -> list[float]:
    """For each pair of letters the logarithm of the chance that the second follows the first, over all words: 676 numbers, whatever the corpus."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    pairs = counts.select("word", "n", at.alias("k")).groupBy(F.expr("substring(word, k, 2)").alias("pair")).agg(F.sum("n").alias("n"))
    table = [[1.0] * 26 for _ in range(26)]
    for r in pairs.collect():  # 676 rows at most
        table[ord(r["pair"][0]) - 97][ord(r["pair"][1]) - 97] += r["n"]
    return [math.log(x / sum(row)) for row in table for x in row]


def likelihood(candidate: Column, table: list[float]) -> Column:
    """The mean of ``transitions`` over neighbouring letters of a candidate; the least of them if it has none."""
    letters, values = F.lower(candidate), F.array(*map(F.lit, table))
    code = lambda k: F.ascii(F.substring(letters, k, 1)) - 97
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(candidate), F.lit(LONGEST)) - 1, F.lit(1))), lambda k: F.struct(code(k).alias("a"), code(k + 1).alias("b")))
    steps = F.filter(steps, lambda x: x["a"].between(0, 25) & x["b"].between(0, 25))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + F.get(values, x["a"] * 26 + x["b"]))
    return F.when(F.size(steps) > 0, total / F.size(steps)).otherwise(min(table))


def covered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (candidate, ...) with ``covered``: the share of the candidate that whole words of ``words`` (vocable) cover."""
    parts = F.split(F.lower(F.regexp_replace("candidate", "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    each = rows.select("candidate").distinct().select("candidate", F.explode(parts).alias("part")).where(F.length("part") >= LETTERS)
    share = each.join(words, F.col("part") == F.col("vocable")).groupBy(F.col("candidate").alias("of")).agg(F.sum(F.length("part")).alias("letters"))
    out = rows.join(share, F.col("candidate") == F.col("of"), "left")
    return out.withColumn("covered", F.coalesce("letters", F.lit(0)) / F.length("candidate")).drop("of", "letters")


def features(candidate: Column, before: Column, after: Column, path: Column, table: list[float]) -> dict[str, Column]:
    """The features of a candidate between the texts ``before`` and ``after`` it, as doubles; the column ``covered`` is one of them."""
    n = F.length(candidate)
    without = lambda chars: F.length(F.translate(candidate, chars, ""))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = F.translate(candidate, lower + upper + digit + "+/_=-", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5)
    said = F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z]{0,6}$", 1))
    following = F.lower(F.regexp_extract(after, r"^[^A-Za-z]{0,6}([A-Za-z_]+)", 1))
    flag = lambda c: c.cast("double")
    return {
        "n_length": n.cast("double"),
        "digits": (n - without(digit)) / n,
        "uppers": (n - without(upper)) / n,
        "lowers": (n - without(lower)) / n,
        "symbols": (n - without("+/_=-")) / n,
        "changes": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(40)),
        "hex": flag(candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "numeric": flag(candidate.rlike("^[0-9/_=+-]+$")),
        "covered": F.col("covered"),
        "likely": likelihood(candidate, table),
        "letters_only": flag(candidate.rlike("^[A-Za-z]+$")),
        "strange": (n - F.length(F.regexp_replace(candidate, "[^A-Za-z0-9+/_=-]", ""))) / n,
        "placeholder": flag(candidate.rlike(PLACEHOLDERS)),
        "parts": F.size(F.split(candidate, "[^A-Za-z]+")).cast("double"),
        "prefix": flag(candidate.rlike(PREFIXES)),
        "said_password": flag(said.rlike("pass|pwd")),
        "said_secret": flag(said.rlike(SECRET_WORDS)),
        "said_plain": flag(said.rlike(f"({PLAIN_WORDS}|^id)$")),
        "assigned": flag(before.rlike("[:=]\\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"'`]$")),
        "test_path": flag(F.lower(path).rlike(TEST_PATHS)),
        "after_plain": flag(following.rlike(f"^({PLAIN_WORDS})")),
    }


def labelled_findings(spark: SparkSession, n: int = TRAINING_ROWS, seed: int = SEED, words: tuple[str, ...] = WORDS) -> DataFrame:
    """(candidate, before, after, path, label): generated findings of 29 kinds, 17 of them secrets, with ``words`` of the corpus."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    g = F.sha2(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string")), 256)
    b = F.base64(F.unhex(F.concat(h, g)))
    plain = F.translate(b, "+/=", "xYz")
    part = lambda c, k, size: F.substring(c, k, size)
    pick = lambda at, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.conv(F.substring(g, at, 4), 16, 10).cast("int") % len(xs)) + 1)
    word = lambda k: pick(k, *words)
    key = lambda k: pick(k, "token = \"", "TOKEN = \"", "secret: ", "api_key=", "password: '", "Authorization: Bearer ", "access_key = ", "PRIVATE_TOKEN=", "key: ", "key = '", "passwd=\"")
    bare = lambda k: pick(k, "the ", "of ", "see ", "and, ", "in ", "")
    kinds = [
        (part(h, 1, 40), key(1), 1),
        (part(h, 1, 64), key(1), 1),
        (F.upper(part(h, 1, 40)), key(1), 1),
        (part(b, 1, 40), key(1), 1),
        (part(plain, 1, 32), key(1), 1),
        (F.concat(F.lit("AKIA"), F.upper(part(h, 1, 16))), pick(2, "key ", "access_key = ", "", "id="), 1),
        (F.concat(F.lit("ghp_"), part(plain, 1, 36)), bare(2), 1),
        (F.concat(F.lit("sk_live_"), part(plain, 1, 24)), bare(2), 1),
        (part(h, 1, 32), key(1), 1),
        (F.concat(F.lit("eyJ"), part(plain, 1, 60)), pick(2, "auth: ", "jwt=", "bearer "), 1),
        (F.concat(word(1), part(F.conv(part(h, 1, 4), 16, 10), 1, 3), pick(9, "!", "", "$", "#x")), key(17), 1),
        (F.concat(word(1), part(F.conv(part(h, 1, 4), 16, 10), 1, 2), word(9)), key(17), 1),
        (F.concat_ws("-", word(1), word(5), word(9), word(13)), pick(17, "password: ", "passphrase=\"", "PASSWORD: '", "pwd="), 1),
        (F.concat(part(plain, 1, 5), pick(1, "!", "@", "%", "^&"), part(plain, 7, 5)), key(17), 1),
        (F.concat(F.lit("eyJ"), part(plain, 1, 17), F.lit(".eyJ"), part(plain, 20, 24), F.lit("."), part(b, 30, 30)), bare(2), 1),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b, F.lit("\n-----END RSA PRIVATE KEY-----")), bare(2), 1),
        (part(plain, 1, 16), pick(17, "key: ", "key=", "key = \""), 1),
        (word(1), pick(17, "password: ", "the token: ", "secret: ", "key: ", "key="), 0),
        (F.concat(word(1), F.lit("."), word(5)), pick(17, "key: ", "token = ", "key="), 0),
        (F.concat(word(1), F.lit("_"), word(5)), pick(17, "key: ", "token = ", "key=", "api_key = "), 0),
        (pick(1, "${PASSWORD}", "your_token", "xxxxxxxx", "********", "changeme", "<token>", "example", "$TOKEN_1", "YOUR_API_KEY"), key(17), 0),
        (part(h, 1, 40), pick(1, "commit ", "sha ", "build=", "etag: \"", "revision of ", "the "), 0),
        (part(h, 1, 32), pick(1, "md5 ", "checksum: ", "hash = ", "sum=", "of "), 0),
        (F.concat_ws("-", part(h, 1, 8), part(h, 9, 4), part(h, 13, 4), part(h, 17, 4), part(h, 21, 12)), pick(1, "uuid ", "id=", "guid: ", "the "), 0),
        (F.concat(word(1), pick(40, "-", "_", ""), word(5), pick(40, "-", "_", ""), word(9), part(F.conv(part(h, 1, 4), 16, 10), 1, 4), word(13)), pick(2, "the ", "href=", "name: ", "token of "), 0),
        (F.concat(F.conv(part(h, 1, 10), 16, 10), F.conv(part(h, 11, 8), 16, 10)), pick(1, "order ", "isbn ", "invoice: ", "at ", "number ", "= "), 0),
        (F.concat(F.lit("/"), word(1), F.lit("/2020/"), word(5), F.lit("-"), word(9), F.lit("/"), word(13)), pick(1, "href=\"", "src=\"", "the "), 0),
        (F.concat(pick(1, "XXXXXXXXXXXX", "xxxxxxxxxxxxxxxx", "000000000000", "EXAMPLEEXAMPLE"), F.lit("0000")), key(5), 0),
        (F.concat(pick(1, "--------------", "+-+-+-+-+-+-+-", "______________"), F.lit("1"), pick(9, "--------------", "______________")), bare(2), 0),
    ]
    assert all(len(k) == 3 for k in kinds)
    chosen = lambda i: F.element_at(F.array(*(k[i] if isinstance(k[i], Column) else F.lit(k[i]) for k in kinds)), (F.col("id") % len(kinds) + 1).cast("int"))
    rows = spark.range(0, n, 1, 1).select("id", chosen(0).alias("candidate"), chosen(1).alias("before"), chosen(2).alias("label"))
    path = F.when(F.col("label") == 1, pick(21, "src/config", "app/settings", "deploy", "src0", "docs/setup")).otherwise(pick(21, "src/config", "tests/data", "examples", "src0", "docs/guide", "web"))
    after = F.when(F.substring(F.col("before"), -1, 1) == '"', F.lit('" ')).otherwise(F.lit(" "))
    return rows.select("candidate", "before", F.concat(after, pick(30, "the", "of", "and", "checksum", "version", "")).alias("after"), path.alias("path"), "label")


def _expression(node, names: tuple[str, ...]) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= float(split.threshold()), _expression(node.leftChild(), names)).otherwise(_expression(node.rightChild(), names))


def forest(findings: DataFrame, words: DataFrame, table: list[float], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Column]:
    """One expression over FEATURES for each tree of a forest grown from labelled findings (candidate, before, after, path, label 0 or 1).

    ``words`` and ``table`` are the corpus's ``vocabulary`` and ``transitions``.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    found = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), table)
    rows = written(covered(findings, words).select(F.col("label").cast("double"), *(c.alias(k) for k, c in found.items())), "training")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    model = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(table)
    forget(rows)
    return [_expression(t._call_java("rootNode"), FEATURES) for t in model.trees]


def _starts(sizes: Column, block: int = 256) -> Column:
    """The sum of the sizes before each place of an array, by the sums of whole blocks: no shuffle, and no array that grows step by step."""
    add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int"))
    sums = F.transform(blocks, lambda b: add(F.slice(sizes, b * block + 1, F.lit(block))))
    ahead = F.transform(blocks, lambda b: add(F.slice(sums, F.lit(1), b)))
    place = lambda k: F.get(ahead, F.floor(k / block).cast("int")) + add(F.slice(sizes, k - k % block + 1, k % block))
    return F.transform(sizes, lambda x, k: place(k))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, start, candidate, before, after) for the candidates of ``docs`` (doc_id, path, text); offsets in code points."""
    text = F.col("text")
    named = text.contains("eyJ") | text.contains("PRIVATE KEY") | ((text.contains(":") | text.contains("=")) & text.rlike(NAMED))
    found = F.when(named, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))
    # generators over one-row arrays, so that each step is evaluated once and not written into the next
    once = lambda rows, **columns: rows.select("doc_id", "path", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
    rows = once(docs.where(F.col("text").isNotNull()), text=F.col("text"), found=found, named=named).where(F.size("found") > 0)
    rows = once(rows, found=F.col("found"), between=F.when(F.col("named"), F.split("text", CANDIDATE, -1)).otherwise(F.split("text", RUN, -1)))
    sizes = F.zip_with("found", F.slice("between", F.lit(1), F.size("found")), lambda c, g: F.length(c) + F.length(g))
    rows = once(rows, found=F.col("found"), between=F.col("between"), sizes=sizes)
    rows = once(rows, found=F.col("found"), between=F.col("between"), ahead=_starts(F.col("sizes")))
    zipped = F.arrays_zip(
        F.col("found").alias("candidate"),
        F.zip_with("ahead", F.slice("between", F.lit(1), F.size("found")), lambda a, g: a + F.length(g)).alias("start"),
        F.transform("between", lambda s: F.right(s, F.lit(CONTEXT))).alias("before"),
        F.transform(F.slice("between", F.lit(2), F.size("between")), lambda s: F.left(s, F.lit(CONTEXT))).alias("after"),
    )
    each = rows.select("doc_id", "path", F.inline(zipped)).where(F.col("candidate").isNotNull())
    fits = (F.length("candidate") >= LEAST) | F.col("before").rlike(r"(?i)(" + ASSIGNED + r")[\"']?\s{0,2}[:=]\s{0,2}[\"']?$")
    return each.where(fits).select("doc_id", "path", F.col("start").cast("long").alias("start"), "candidate", "before", "after")


def secrets(docs: DataFrame, trees: list[Column], words: DataFrame, table: list[float]) -> DataFrame:
    """(doc_id, path, start, end, secret_sha256, score) of the secrets in ``docs`` (doc_id, path, text).

    ``score`` is the share of trees that hold a candidate for a secret; it is returned from TAKEN on.
    The secret itself is only given as a digest. Null and empty texts hold none, a null path counts as
    empty, repeated rows give their findings again, where candidates tie for a place the kind that comes first in the module's list is taken, very long
    texts are scanned whole, and an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    rows = candidates(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "text"))
    # a generator, so that the optimiser keeps the features as columns and doesn't write them into every tree
    found = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), table)
    rows = covered(rows, words).withColumnRenamed("covered", "share").withColumn("covered", F.col("share"))
    rows = rows.select("doc_id", "path", "start", "candidate", F.inline(F.array(F.struct(*(c.alias(k) for k, c in found.items())))))
    votes = trees[0]
    for t in trees[1:]:
        votes = votes + t
    rows = rows.withColumn("score", F.round(votes / len(trees), 6)).where(F.col("score") >= TAKEN)
    end = (F.col("start") + F.length("candidate")).alias("end")
    return rows.select("doc_id", "path", "start", end, F.sha2("candidate", 256).alias("secret_sha256"), "score")


def fitted(docs: DataFrame) -> tuple[list[Column], DataFrame, list[float]]:
    """The forest of generated findings, and the corpus's words and letter pairs, from all texts of ``docs``."""
    counts = written(word_counts(docs), "words")
    words, table = written(vocabulary(counts), "vocabulary"), transitions(counts)
    common = [r["word"] for r in counts.where(F.length("word").between(4, 12)).orderBy(F.desc("n"), "word").limit(200).collect()]
    findings = written(labelled_findings(docs.sparkSession, words=tuple(common) or WORDS), "findings")
    trees = forest(findings, words, table)
    forget(findings, counts)
    return trees, words, table


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all texts of ``documents``; see ``secrets`` for nulls, empty and very long texts, ties and repeated rows."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    return secrets(docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("path"), "text"), *fitted(docs))
