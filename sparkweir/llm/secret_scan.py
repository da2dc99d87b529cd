"""Secret scans with a random forest against false positives, in DataFrame functions only.

One pattern finds candidates; the text between them gives each candidate's
neighbourhood and place. Features of the candidate: its kind and length,
transitions between classes of characters, distinct characters, the share that
words of a dictionary cover, the share of runs that look like words, signs of
code, whether it stands in a path or address, and which words are near. A random forest, trained on labelled findings, votes; it is
turned into nested conditions, so that texts are scanned and cleared within
their rows, without a shuffle.

Labelled findings: a table (value, before, after, kind, label). Without one,
training_findings() makes it by rule: random values, and placeholders, prose,
code, counters and digests. Both stand among the same neighbouring words, the
ones of their own sort more often; only digests always have words for digests
near them, as nothing else tells them from hexadecimal secrets.

Texts: null ones stay null and have no findings, as have empty ones; long ones
are scanned whole, in time in proportion to their length. Where candidates overlap, the first is taken. Rows come one
to one, repeated rows and null ids included; an empty table gives an empty
result. All columns pass by untouched; a result that would take the name of
one of them is refused. The results are long expressions: write or store them
before a filter on them, which the optimizer would else repeat them for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

#: Characters of names, and what stands in the name of a secret, whatever is around it, as in DB_PASSWORD_OLD.
NAME, KEYWORD = r"A-Za-z0-9_.\-", r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)"
#: Where a value without quotes ends before a blank: at a separator with another name or secret after it.
NEXT = rf"""[,;&](?:["']?[A-Za-z_][{NAME}]*+["']?[=:]|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|sk_live_|sk-|eyJ|-----BEGIN)"""
PEM = "(?:[A-Z]{2,10} )?PRIVATE KEY(?: BLOCK)?-----"
#: What candidates look like, by kind. Each begins where a token begins, gives nothing back once it has run on,
#: and runs on over characters that no other of its beginnings stands in, so that a text takes time in proportion to its length.
KINDS = {
    "assignment": rf"""(?<![{NAME}])(?=[{NAME}]++["']?\s{{0,3}}[=:])(?=[{NAME}]*?{KEYWORD})[{NAME}]++["']?\s{{0,3}}[=:]\s{{0,3}}(?:"[^"\r\n]{{8,}}+(?<!\\)"|'[^'\r\n]{{8,}}+(?<!\\)'|["']?(?:(?!{NEXT})\S){{8,}}+)""",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "vendor_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_\-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_\-]{35,}+|sk_live_[A-Za-z0-9]{24,}+|sk-[A-Za-z0-9_\-]{20,}+)",
    "web_token": r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+",
    "bearer": r"\b(?i:bearer)\s{1,3}[A-Za-z0-9._~+/\-]{16,}+=*+",
    "url_password": r"""://[^\s:/@"'<>]*+:[^\s/@"'<>]{3,}+@""",
    "private_key": rf"-----BEGIN {PEM}(?:\s{{0,8}}+[A-Za-z][A-Za-z0-9\-]{{0,64}}+:[^\r\n]{{0,200}}+(?=[\r\n]|\z)){{0,16}}+[A-Za-z0-9+/=\s]{{16,}}+(?:-----END {PEM})?",
}
#: Kinds whose value is named or addressed by what stands before it.
NAMED = ("assignment", "bearer", "url_password")
PATTERN = "|".join(KINDS.values())
#: Words that placeholders are made of, and words near secrets and near other things.
DICTIONARY = ("example", "sample", "dummy", "test", "fake", "placeholder", "changeme", "change", "your", "here", "password", "passwd", "secret", "token", "value", "key", "admin", "user", "none", "null", "true", "false", "xxxx", "redacted", "insert", "default", "string", "foo", "bar", "abcd", "1234", "qwerty", "access", "api", "name", "my", "the")
NEAR_SECRETS = r"(?i)\b(?:password|passwd|secret|token|key|auth|bearer|credential|login)\b"
NEAR_OTHERS = r"(?i)\b(?:example|sample|e\.g|placeholder|dummy|fake|test|commit|revision|sha|sha1|sha256|md5|checksum|digest|hash|uuid|guid|id|build|version)\b"
#: Characters of text on each side that count as the neighbourhood.
AROUND = 48
#: Trees and depth of the forest, share of votes that makes a secret, labelled findings made for training.
TREES, DEPTH, VOTES, FINDINGS = 25, 6, 0.5, 4000

FEATURES = ("length", "transitions", "distinct", "digits", "upper", "dictionary", "in_path", "near_secrets", "near_others", "hexadecimal", "assignment", "run", "wordlike", "code")


def _features(value: Column, before: Column, after: Column, kind: Column) -> dict[str, Column]:
    length = F.greatest(F.length(value), F.lit(1)).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    lower = F.lower(value)
    words = F.length(value) - F.length(F.regexp_replace(lower, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return {
        "length": length,
        "transitions": (F.size(F.regexp_extract_all(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))) - 1) / length,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(length, F.lit(24.0)),
        "digits": (F.length(value) - without("[0-9]")) / length,
        "upper": (F.length(value) - without("[A-Z]")) / length,
        "dictionary": words / length,
        "in_path": (before.rlike(r"[/\\][^\s]{0,40}$") | after.rlike(r"^[/\\]")).cast("double"),
        "near_secrets": before.rlike(NEAR_SECRETS).cast("double"),
        "near_others": (before.rlike(NEAR_OTHERS) | F.left(after, F.lit(16)).rlike(NEAR_OTHERS)).cast("double"),
        "hexadecimal": value.rlike("^[0-9a-f]+$").cast("double"),
        "assignment": kind.isin(*NAMED).cast("double"),
        "run": value.rlike(r"(.)\1{4}|(?i)abcdef|123456|987654").cast("double"),
        "wordlike": (F.length(value) - without("[A-Za-z][a-z]{3,}")) / length,
        "code": (value.rlike(r"[(){}<>\[\]]|^[$%&]|\s") & ~kind.isin("private_key")).cast("double"),
    }


def _value(candidate: Column, kind: Column) -> Column:
    """What is secret in a candidate of a kind that names it; of other kinds the whole."""
    assigned = F.regexp_extract(candidate, rf"""(?s)^[{NAME}]++["']?\s{{0,3}}[=:]\s{{0,3}}["']?(.*?)["']?$""", 1)
    return (
        F.when(kind == "assignment", assigned)
        .when(kind == "bearer", F.regexp_extract(candidate, r"^\S+\s+(.*)$", 1))
        .when(kind == "url_password", F.regexp_extract(candidate, r"^://[^:]*+:(.*)@$", 1))
        .otherwise(candidate)
    )


def _kind(candidate: Column) -> Column:
    """Names come first: what follows may begin like any other kind."""
    out = F.when(candidate.rlike(rf"""^(?=[{NAME}]*?{KEYWORD})[{NAME}]++["']?\s{{0,3}}[=:]"""), "assignment")
    for kind, start in (("access_key", "^A[KS]IA"), ("web_token", "^eyJ"), ("bearer", r"^(?i:bearer)\s"), ("url_password", "^://"), ("private_key", "^-----")):
        out = out.when(candidate.rlike(start), kind)
    return out.otherwise("vendor_token")


def training_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n labelled findings made by rule, the same ones each time."""
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (draw(salt, len(options)) + 1).cast("int"))
    noise = lambda salt: F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(salt)), 512)
    number = lambda salt, low, high: (draw(salt, high - low + 1) + low).cast("int")
    cut = lambda value, salt, low, high: F.substring(value, F.lit(1), number(salt, low, high))
    base = F.regexp_replace(F.concat(*[F.base64(F.unhex(noise(x))) for x in ("b", "c", "d")]), "[^A-Za-z0-9]", "")
    upper = F.upper(F.translate(noise("u"), "0123456789abcdef", "QW7ERT2YUP5ADSFG"))
    signs = F.translate(base, "aAbBcC", "!#%@*+")
    letters = lambda salt, low, high: cut(F.translate(noise(salt), "0123456789", "nioertashl"), salt + "n", low, high)
    word = lambda salt: pick(salt, DICTIONARY)
    plain = lambda salt: F.when(draw(salt + "?", 2) == 0, word(salt)).otherwise(letters(salt, 3, 9))
    name = lambda salt: F.when(draw(salt + "!", 3) == 0, F.upper(plain(salt))).when(draw(salt + "!", 3) == 1, F.initcap(plain(salt))).otherwise(plain(salt))
    between = lambda salt: pick(salt, ("_", "-", "."))
    made = lambda value, kind="assignment": F.struct(value.alias("value"), F.lit(kind).alias("kind"))
    sort = number("sort", 0, 9)
    secret = (
        F.when(sort == 0, made(cut(noise("h"), "hl", 12, 64)))
        .when(sort == 1, made(cut(base, "bl", 8, 40)))
        .when(sort == 2, made(F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), "access_key"))
        .when(sort == 3, made(F.concat(pick("v", ("ghp_", "gho_", "sk_live_", "xoxb-", "AIza", "github_pat_", "glpat-", "sk-")), cut(base, "vl", 36, 120)), "vendor_token"))
        .when(sort == 4, made(F.concat(F.lit("eyJ"), F.substring(base, 1, 20), F.lit("."), F.substring(base, 20, 30), F.lit("."), F.substring(base, 5, 40)), "web_token"))
        .when(sort == 5, made(F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), base, F.lit("\n-----END PRIVATE KEY-----")), "private_key"))
        .when(sort.isin(6, 7), made(cut(signs, "sl", 8, 24)))
        .when(sort == 8, made(F.repeat(base, number("rl", 1, 12))))
        .otherwise(made(F.concat(F.lit("eyJ"), base, F.lit("."), base)))
    )
    other = (
        F.when(sort == 0, made(F.concat(word("w1"), between("j"), word("w2"), between("j2"), word("w3"))))
        .when(sort == 1, made(F.concat(word("w4"), F.repeat(pick("r", ("x", "0", "*", "-", "1")), 12))))
        .when(sort == 2, made(F.concat(F.lit("AKIA"), F.substring(upper, 1, 9), F.lit("EXAMPLE")), "access_key"))
        .when((sort == 3) & (draw("v2", 2) == 0), made(F.concat(F.lit("ghp_"), F.repeat(pick("r2", ("x", "0", "a")), 36)), "vendor_token"))
        .when(sort == 3, made(F.concat_ws("-", F.lit("sk"), letters("k1", 4, 9), plain("k2"), letters("k3", 4, 9), plain("k4"), letters("k5", 3, 9)), "vendor_token"))
        .when(sort == 4, made(F.substring(noise("c"), F.lit(1), pick("cl", (32, 40, 64)))))
        .when(sort == 5, made(F.concat(word("w5"), F.lit("_1234567890"), word("w6"))))
        .when(sort == 6, made(F.concat(pick("o1", ("", "(", "the-")), letters("p1", 8, 14), pick("o2", ("", ",", ".", "),", ";")))))
        .when(sort == 7, made(F.concat_ws(" ", letters("p2", 3, 8), name("p3"), letters("p4", 3, 9), name("p5"))))
        .when(sort == 8, made(F.concat(pick("o3", ("${", "<", "{{", "$(", "%(", "[")), name("p6"), between("j3"), name("p7"), pick("o4", ("}", ">", "}}", ")", ")s", "]")))))
        .otherwise(made(F.concat(letters("p8", 2, 7), pick("j4", ("_", "-", ".", "")), name("p9"), pick("o5", ("[", "(", "_", ".", "['", "(&")), name("p10"), pick("j5", ("_", "-", ".", "")), name("p11"), pick("o6", ("]", ")", "", "()", "']", ");")))))
    )
    real = F.pmod(F.col("id"), F.lit(2)) == 0
    of_secrets, of_others = ("the", "login with", "set", "bearer", "auth", "secret"), ("for example", "sample", "placeholder", "e.g", "see docs/config/", "version")
    digests = ("commit", "sha256 checksum", "md5", "revision", "digest")
    likely = F.when(real, pick("n1", of_secrets)).otherwise(pick("n2", of_others))
    unlikely = F.when(real, pick("n3", of_others + digests)).otherwise(pick("n4", of_secrets))
    near = F.when(~real & (sort == 4), pick("n5", digests)).when(draw("n", 20) < 12, "").when(draw("n", 20) < 18, likely).otherwise(unlikely)
    filler = F.concat_ws(" ", letters("f", 2, 7), letters("g", 2, 9))
    return spark.range(n).select(F.when(real, secret).otherwise(other).alias("s"), F.concat_ws(" ", filler, near, F.lit("")).alias("before"), F.lit(" ").alias("after"), real.cast("double").alias("label")).select("s.value", "before", "after", "s.kind", "label")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list:
    """The forest as nested tuples: (feature, threshold, left, right), or the vote of a leaf."""
    rows = findings.where(F.col("label").isNotNull()).select(F.col("label").cast("double").alias("label"), *[c.cast("double").alias(n) for n, c in _features(F.col("value"), F.col("before"), F.col("after"), F.col("kind")).items()])
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(assembled)

    def nested(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        split = node.split()
        return int(split.featureIndex()), float(split.threshold()), nested(node.leftChild()), nested(node.rightChild())

    return [nested(tree._call_java("rootNode")) for tree in model.trees]


def votes(forest: list, value_of) -> Column:
    """Share of the trees that vote for a secret. value_of: column of a feature by name."""

    def vote(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, threshold, left, right = node
        return F.when(value_of(FEATURES[feature]) <= threshold, vote(left)).otherwise(vote(right))

    return reduce(lambda a, b: a + b, [vote(tree) for tree in forest]) / float(len(forest))


#: Steps that a running sum takes at a time, so that its cost stays far from the square of their number.
TOGETHER = 64


def _sums(steps: Column) -> Column:
    """Running sums of a short array of integers."""
    return F.aggregate(steps, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x)))


def scan(df: DataFrame, forest: list, text_col: str = "text", least: float = VOTES, findings_col: str = "findings", cleared_col: str = "cleared") -> DataFrame:
    """df with findings_col (candidates with start, end, kind, votes, secret; places in characters from 0) and cleared_col, the text with [kind] for each secret."""
    if clash := {findings_col.lower(), cleared_col.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has columns {sorted(clash)}")
    text = F.col(text_col)
    empty = F.array().cast("array<string>")
    found, between, candidates, measured, vote, blocks, ends, findings = names = unused(df, "_found", "_between", "_candidates", "_measured", "_votes", "_blocks", "_ends", "_results")
    columns = df.columns
    # Arrays meet by zip_with alone: the optimizer may put an array's expression where its column is read, which must not be within a function of elements.
    df = df.withColumn(found, F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), empty))
    df = df.withColumn(between, F.when(F.size(found) > 0, F.split(text, PATTERN, -1)).otherwise(empty))
    # What stands before the keyword of a name stays as text.
    name = lambda v: F.when(_kind(v) == "assignment", F.regexp_extract(v, rf"^[{NAME}]*?(?={KEYWORD})", 0)).otherwise("")
    df = df.withColumn(found, F.transform(found, lambda v: F.struct(name(v).alias("name"), v.alias("found"))))
    df = df.withColumn(between, F.zip_with(between, found, lambda b, v: F.concat(b, F.coalesce(v["name"], F.lit("")))))
    df = df.withColumn(found, F.transform(found, lambda v: F.substring(v["found"], F.length(v["name"]) + 1, F.length(v["found"]))))

    def candidate(value, around):
        before, after = around["before"], around["after"]
        return F.struct(value.alias("found"), _value(value, _kind(value)).alias("value"), _kind(value).alias("kind"), F.right(before, F.lit(AROUND)).alias("before"), F.left(after, F.lit(AROUND)).alias("after"), (F.length(before) + F.length(value)).alias("step"), F.length(value).alias("length"))

    count = F.size(found)
    around = F.zip_with(F.slice(between, F.lit(1), count), F.slice(between, F.lit(2), count), lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    df = df.withColumn(candidates, F.zip_with(found, around, candidate))
    df = df.withColumn(measured, F.transform(candidates, lambda c: F.struct(*[f.cast("double").alias(n) for n, f in _features(c["value"], c["before"], c["after"], c["kind"]).items()])))
    df = df.withColumn(vote, F.transform(measured, lambda m: votes(forest, lambda name: m[name])))
    # Where candidates end: running sums within blocks, and of the blocks' totals.
    starts = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)), F.lit(TOGETHER))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(blocks, F.transform(starts, lambda b: _sums(F.transform(F.slice(candidates, b, F.lit(TOGETHER)), lambda c: c["step"]))))
    before = F.concat(F.array(F.lit(0)), _sums(F.transform(blocks, lambda b: F.try_element_at(b, F.lit(-1)))))
    df = df.withColumn(ends, F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, o: F.transform(b, lambda x: x + o))))
    place = F.zip_with(ends, vote, lambda e, v: F.struct(e.alias("end"), v.alias("votes")))
    result = lambda c, p: F.struct((p["end"] - c["length"]).alias("start"), p["end"].alias("end"), c["kind"].alias("kind"), p["votes"].alias("votes"), (p["votes"] >= least).alias("secret"))
    df = df.withColumn(findings, F.zip_with(candidates, place, result))
    shown = F.zip_with(found, findings, lambda v, f: F.when(f["secret"], F.concat(F.lit("["), f["kind"], F.lit("]"))).otherwise(v))
    cleared = F.when(count > 0, F.array_join(F.zip_with(between, shown, lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")).otherwise(text)
    return df.withColumn(findings_col, F.col(findings)).withColumn(cleared_col, cleared).drop(*names).select(*columns, findings_col, cleared_col)
