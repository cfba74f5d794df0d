"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions only.

A candidate is, in this order: what is assigned to a name with a word of ASSIGNED (`db_password = "..."`, `Authorization: Bearer ...`), MIN_VALUE
characters or more, in quotes up to the closing quote on the line; the password of a URL; a private key block; a JSON web token; a whole run of at least
MIN_CHARS of [A-Za-z0-9_+/-], with up to two = behind it, that holds a digit or a capital behind a small letter. None has an upper bound. Its features: length; shares of digits, capitals, small letters and signs; runs of one kind of character,
that is transitions; distinct characters; kinds of characters; its shape (hexadecimal, decimal, UUID, key block or web token, issuer's
prefix, placeholder, piece of code); how much of it dictionary words cover; the words of both kinds before and after it; an assignment in front; a
path around it or in the path column. Lengths count up to 512 and distinct characters are held against 64 at most; the candidate itself is never cut.

The forest is trained on a table of labelled findings (candidate, before, after, path, label), which `scan` and
`redact` take as `findings`, of any size; without one, once in an application on `labelled_findings`, TRAIN_ROWS made findings whose labels are known by construction.

Texts are whole; null and empty ones have no findings. Findings carry their place (start_at, in code points from
0), so equal candidates of one text stay apart; repeated rows repeat their findings, null ids are kept. An empty
table has none. Every finding of a row is on one row of its own, so hot sources and long texts need no grouping, and a text costs time in
proportion to its length and findings. The control characters U+0001 and U+0002 count as spaces, and are spaces in what `redact` masks. Extra columns don't reach `scan`'s result;
`redact` keeps them, and adds none.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settle

MIN_CHARS, MIN_VALUE = 16, 6
AROUND = 96
TRAIN_ROWS = 3_000
TREES, DEPTH, SEED = 24, 7, 11
#: Rows of labelled findings that one task of the fit reads.
FIT_ROWS = 100_000
THRESHOLD = 0.5
MASK = "[SECRET]"

_RUN = "[A-Za-z0-9_+/\\-]"
_OPEN, _CLOSE = "\u0001", "\u0002"
#: Names that secrets are assigned to, as parts of patterns.
ASSIGNED = "token secret passwo?r?d passwd pwd passphrase api[_-]?key access[_-]?key auth bearer credential private[_-]?key signing[_-]?key session[_-]?key encryption[_-]?key".split()
# Loops are possessive and without bounds, so each text is read in time in proportion to its length and no long finding is lost.
_BLOCK = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----(?:[^\-]++|-(?!----))*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
_TOKEN = r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]*+)?"
_NAME = r"(?i:(?<![a-z0-9_\-])(?=[a-z0-9_\-]*?(?<![a-z])(?:" + "|".join(ASSIGNED) + r"))[a-z0-9_\-]++)[\"'`\]]{0,2}\s*+(?::=|=>|[:=])\s*+(?i:(?:bearer|basic)\s++)?+[\"'`]?+"
_QUOTED = "|".join(rf"(?<={q})(?!-----BEGIN)[^{q}\n]{{{MIN_VALUE},}}+(?={q})" for q in "\"'`")
_VALUE = rf"{_QUOTED}|(?!-----BEGIN)[^\s\"'`<>(){{}}\[\],;]{{{MIN_VALUE},}}+(?<![.:])|(?!-----BEGIN)[^\s\"'`<>(){{}}\[\],;]{{{MIN_VALUE - 1},}}[^\s\"'`<>(){{}}\[\],;.:]"
CANDIDATE = rf"({_NAME})({_VALUE})|(://[^\s/:@\"'<>]++:)([^\s/@\"'<>]{{3,}}+)(?=@)|({_BLOCK})|({_TOKEN})|((?<!{_RUN})(?={_RUN}*?(?:[0-9]|[a-z][A-Z])){_RUN}{{{MIN_CHARS},}}+={{0,2}})"
_MARKED = f"$1$3{_OPEN}$2$4$5$6$7{_CLOSE}"
#: Words that stand near secrets, words that stand near what merely looks like one, and words of which names are made. Fixed values.
NEAR = "token secret password passwd pwd passphrase apikey api_key api-key api key access_key accesskey auth authorization bearer credential credentials private_key client_secret signing_key session".split()
FAR = "sha sha1 sha256 sha512 md5 hash checksum digest commit revision rev uuid guid etag integrity fingerprint version build example sample placeholder dummy fake test isbn issn doi phone order invoice tracking card account number serial page image img png jpg css charset".split()
DICTIONARY = "about above after again air all also and animal answer any are ask back because been before began being below between book both boy build but call came can change city close come could country cross data day did different does done down each earth eat end enough even every example eye face family far father feet few file find first follow food for form found four from get girl give good got great group grow had hand hard has have head hear help her here high him his home house how idea image index into its just keep kind know land large last late learn leave left letter life light like line list little live long look made main make man many may mean men might mile more most mother mountain move much must name near need never new next night not note now number off often old one only open order other our out over own page paper part people picture place plant play point put question quick read real right river run said same saw say school sea second see seem sentence set she should show side small some something sometimes song soon sound spell start state still stop story study such take talk tell test than that the their them then there these they thing think this those thought three through time together too took tree try turn two under until use user value very walk want was watch water way well went were what when where which while white who why will with without word work world would write year you young your".split()

#: How tokens of well-known issuers begin; what stands where a secret will be; what is code. Fixed values.
ISSUED = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|[sr]k_(?:live|test)_|sk-|xox[abprs]-|glpat-|AIza|SG[.0-9]|npm_|pypi-|hf_|ya29\.|dop_v1_|shpat_)"
HOLDER = r"(?i)change.?me|replace|example|your.|placeholder|dummy|sample|redacted|xxxx|\*\*\*|\.\.\.|todo|^(?:none|null|true|false|string|required|optional|undefined|password|passwd|secret|token|default)$|^test"
CODE = r"^[$%{]|^(?:os|env|process|self|this|config|settings|request|req|args|options|params|ctx|data|user|form)\.|^get|\w\.\w+\.\w|://|->|::|^/|\(\)?$"

FEATURES = "n_chars digits capitals small signs transitions distinct classes hexadecimal decimal uuid_like block issued holder code in_url dictionary near_words far_words assigned named quoted in_path odd_path repeated".split()


def _any(words: list[str]) -> str:
    return "(?i)(?<![a-z])(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")(?![a-z])"


def _share(c: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{chars}]", "")) / F.length(c)


def with_features(findings: DataFrame) -> DataFrame:
    """Adds FEATURES to findings(candidate, before, after, path)."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    runs = reduce(lambda x, p: F.regexp_replace(x, f"[{p}]+", p[0]), ("0-9", "a-z", "A-Z"), c)
    words = "(?i)" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    flag = lambda x: x.cast("double")
    n = F.length(c)
    made = {
        "n_chars": F.least(n, F.lit(512)),
        "digits": _share(c, "0-9"),
        "capitals": _share(c, "A-Z"),
        "small": _share(c, "a-z"),
        "signs": _share(c, "_+/=\\-"),
        "transitions": (F.length(runs) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "classes": sum((flag(c.rlike(x)) for x in ("[a-z]", "[A-Z]", "[^A-Za-z0-9_\\-]")), flag(c.rlike("[0-9]"))),
        "block": flag(c.startswith("-----BEGIN") | c.rlike("^eyJ[^.]+[.][^.]+")),
        "issued": flag(c.rlike(ISSUED)),
        "holder": flag(c.rlike(HOLDER)),
        "code": flag(c.rlike(CODE)),
        "in_url": flag(before.rlike("://[^\\s/:@]+:$") & after.startswith("@")),
        "named": flag(before.rlike(_NAME + "$")),
        "hexadecimal": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
        "decimal": flag(c.rlike("^[0-9_\\-]+$")),
        "uuid_like": flag(c.rlike("(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")),
        "dictionary": (n - F.length(F.regexp_replace(c, words, ""))) / n,
        "near_words": flag(before.rlike(_any(NEAR)) | after.rlike(_any(NEAR))),
        "far_words": flag(before.rlike(_any(FAR)) | after.rlike("^\\W{0,3}" + _any(FAR))),
        "assigned": flag(before.rlike("[:=]>?\\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "in_path": flag(before.rlike("[/\\\\.@]$") | c.rlike("^/|/.*/") | after.rlike("^\\.[a-z]{2,4}\\b")),
        "odd_path": flag(F.coalesce(F.col("path"), F.lit("")).rlike("(?i)test|spec|sample|example|fixture|mock|doc|vendor|lock")),
        "repeated": flag(c.rlike("(.)\\1{5}|(..)\\2{4}|0123456789|123456789|abcdef0")),
    }
    return findings.withColumns({k: v.cast("double") for k, v in made.items()})


_BLOCK_SIZE = 256


def _sums_before(lengths: Column) -> Column:
    """For each item the sum of those before it, in blocks, so that no long list is copied for each of its items."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK_SIZE).cast("int")), lambda b: F.slice(lengths, b * _BLOCK_SIZE + 1, F.lit(_BLOCK_SIZE)))
    grow = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    inner = F.transform(blocks, grow)
    both = F.struct(inner.alias("inner"), grow(F.transform(inner, lambda p: F.element_at(p, -1))).alias("outer"))
    # a one-item list, so that both are made once
    return F.flatten(F.element_at(F.transform(F.array(both), lambda x: F.transform(x["inner"], lambda p, i: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda v: v + F.element_at(x["outer"], i + 1)))), 1))


def _parts(text: Column) -> Column:
    """The text cut before each candidate; what follows a candidate stands behind _CLOSE."""
    return F.split(F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "  "), CANDIDATE, _MARKED), _OPEN)


def candidates(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """The candidates of docs(doc_id, text): doc_id, place, start_at, candidate, before, after, path."""
    return _findings(docs.select("doc_id", (path if path is not None else F.lit(None).cast("string")).alias("path"), _parts(F.col("text")).alias("parts")))


def _findings(cut: DataFrame) -> DataFrame:
    """The candidates of cut(doc_id, path, parts)."""
    cut = cut.where(F.size("parts") > 1)
    item = lambda i: F.struct(
        F.element_at("so_far", i + 1).alias("start_at"),
        F.substring_index(F.element_at("parts", i + 1), _CLOSE, 1).alias("candidate"),
        F.right(F.element_at("parts", i), F.lit(AROUND + 1)).alias("before"),
        F.left(F.substring_index(F.element_at("parts", i + 1), _CLOSE, -1), F.lit(AROUND)).alias("after"),
    )
    rows = cut.withColumn("ends", F.transform("parts", lambda p, i: F.length(p) - (i > 0).cast("int"))).withColumn("so_far", _sums_before(F.col("ends")))
    rows = rows.select("doc_id", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), item)).alias("place", "f"))
    before = F.right(F.translate("f.before", _CLOSE, ""), F.lit(AROUND))
    return rows.select("doc_id", "place", F.col("f.start_at").alias("start_at"), F.col("f.candidate").alias("candidate"), before.alias("before"), F.col("f.after").alias("after"), "path")


def labelled_findings(spark: SparkSession, n: int = TRAIN_ROWS, seed: int = SEED) -> DataFrame:
    """n made findings with labels: random keys where keys stand, and what is mistaken for them. The same for every call; a bounded table that is written."""
    r = random.Random(seed)
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    of = lambda chars, a, b=None: "".join(r.choices(chars, k=r.randint(a, b or a)))
    word = lambda: r.choice(DICTIONARY)
    coined = lambda: "".join(r.choice("bcdfglmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    plain, base = low + up + num, low + up + num + "+/"
    cased = lambda text: text.upper() if r.random() < 0.12 else text
    digest = lambda: cased(of(hexa, r.choice((20, 24, 32, 40, 40, 40, 48, 64))))
    key64 = lambda: of(base, r.choice((20, 24, 32, 40, 40, 48, 64))) + r.choice(("", "", "=", "=="))
    issued = lambda: r.choice((
        lambda: r.choice(("AKIA", "ASIA")) + of(up + num, 16),
        lambda: f"{r.choice(('xoxb-', 'xoxp-'))}{of(num, 11)}-{of(num, 12)}-{of(plain, 24)}",
        lambda: r.choice(("ghp_", "gho_", "sk_live_", "glpat-", "npm_", "hf_", "pypi-", "ghs_")) + of(plain, 36),
        lambda: r.choice(("AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "SG7", "npm_")) + of(plain, 32),
    ))()
    leet = lambda: word().translate(str.maketrans("aeos", "4305")) if r.random() < 0.5 else word().capitalize()
    mark = lambda: r.choice("!@#$&_.-%*?+")
    human = lambda: r.choice((f"{leet()}{mark()}{of(num, 1, 4)}{word().capitalize()}", f"{leet()}{of(num, 1, 2)}{mark()}{word()[:2].capitalize()}{of(num, 1, 2)}", f"{mark()}{word()}{leet().capitalize()}{mark()}{of(num, 1, 3)}")).ljust(8, "9")
    phrase = lambda: " ".join(r.choice((coined, coined, word))() for _ in range(r.randint(4, 6)))
    web = lambda: f"eyJ{of(plain, 33)}.{of(plain, 50)}.{of(plain + '_-', 43)}"

    def block() -> str:
        kind = r.choice(("", "RSA ", "EC ", "OPENSSH "))
        head = "" if r.random() < 0.7 else f"Comment: {word()}.{word()}\n"
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{head}" + "".join(of(base, 64) + "\n" for _ in range(r.randint(2, 5))) + f"-----END {kind}PRIVATE KEY-----"

    uuid = lambda: "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12))
    digits = lambda: r.choice("123456789") + of(num, 15, 23)
    slug = lambda: "-".join(word() for _ in range(4)) + "-" + of(num, 1, 4)
    camel = lambda: "".join(word().capitalize() for _ in range(4)) + of(num, 1, 2)
    mixed = lambda: word() + "".join(word().capitalize() for _ in range(r.randint(3, 6)))
    pathlike = lambda: "/".join([*(word() for _ in range(3)), "".join(word().capitalize() for _ in range(2))])
    filler = lambda: r.choice(("xxxxxxxxxxxxxxxxxxxx1", "0000000000000000000000", "1234567890123456789012", "aaaaaaaaaaaaaaaaaaa111", "abcdef0123456789abcdef")) + of(num, 1)
    holder = lambda: r.choice(("changeme", "your_api_key_here", "xxxxxxxx", "********", "example-token", "REPLACE_ME_NOW", "placeholder", "dummy_secret", "<password>", "required", "undefined", "string", "password", "secret", "test-token", "todo-set-this", "your-password"))
    code = lambda: r.choice(("os.environ", "process.env.TOKEN", "self.token", "config.password", "getToken()", "request.form.password", "settings.SECRET_KEY", "${TOKEN}", "$PASSWORD", "args.password", "user.password", "data.token", "form.password.value", "https://example.org/login", "/etc/app/secret.txt", "./keys/id", "function", "input.value"))
    prose = lambda: r.choice((word() + word(), word().ljust(6, "g")))
    says = lambda: r.choice(("must be ", "is the ", "enter your ", "should not be ", "please type the ")) + " ".join(word() for _ in range(r.randint(2, 5)))
    dotted = lambda: f"{word()}.{word()}.{word()}"
    secrets = [  # how often, what, where
        (3, digest, "near"), (2, key64, "near"), (8, issued, "bare"), (2, issued, "near"), (1, web, "near"), (1, web, "bare"), (1, block, "bare"), (1, human, "url"), (3, human, "near"),
        (2, lambda: of(low + up, 16, 40), "near"), (1, lambda: of(low, 8, 26) + of(up, 4, 16), "near"), (1, lambda: of(low + up, 24, 44), "bare"), (3, lambda: leet() + of(num, 2, 4), "url"), (2, lambda: of(plain, 8, 18), "near"), (1, lambda: of(plain, 8, 30), "url"), (1, lambda: of(plain, 64, 320), "url"), (1, phrase, "quoted"),
    ]
    others = [
        (2, digest, "far"), (2, uuid, "far"), (1, uuid, "none"), (2, digits, "none"), (1, slug, "none"), (1, camel, "none"), (2, mixed, "none"), (1, pathlike, "none"), (1, lambda: "_".join((word(), word(), word(), "v2", word())), "none"), (1, filler, "near"),
        (1, lambda: "/".join((word(), word(), word(), digits())), "none"), (2, prose, "near"), (2, holder, "near"), (2, code, "near"), (1, slug, "near"), (1, dotted, "near"), (1, camel, "near"), (1, mixed, "near"), (1, says, "quoted"),
    ]
    dealt = [(make, where, y) for own, y in ((secrets, 1.0), (others, 0.0)) for k, make, where in own for _ in range(k)]
    keys = "token secret password api_key auth_token access_key client_secret TOKEN api-key credential private_key db_password SECRET_KEY passwd pwd passphrase auth".split()
    apart = "sha256 commit checksum md5 digest uuid etag build revision integrity hash order tracking".split()
    rows = []
    for i in range(n):
        make, where, y = dealt[i % len(dealt)]
        quote = r.choice("\"'") if where == "quoted" else r.choice(('"', "'", "", ""))
        lead, trail = f"{word()} {word()} {word()} ", f" {word()} {word()}"
        key = r.choice(apart if where == "far" else keys)
        if where in ("near", "far", "quoted"):
            before, after = f"{lead}{key}{'' if r.random() < 0.8 else '_' + word() + '_' + word()}{r.choice((' = ', '=', ': ', ' := ', ' => ', '='))}{quote}", quote + trail
        elif where == "url":
            before, after = f"{lead}{r.choice(('postgres', 'mysql', 'https', 'amqp', 'redis'))}://{word()}:", f"@{word()}.{word()}"
        else:
            before, after = lead, trail
        rows.append((make(), before[-AROUND:], after, r.choice(("src0", "src1", "src2", "config/app.yml", "tests/data/sample.txt", "docs/example.md")), y))
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label double")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A random forest (JVM) on the features of labelled findings; rows are dealt and ordered by their values, so that the same findings give the same forest.

    The features are written first: the passes of the fit read them, and don't plan or make them again.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = settle(with_features(findings).select(*FEATURES, "label"), "labelled-features")
    parts = 1 + made.count() // FIT_ROWS
    rows = made.repartition(parts, *FEATURES).sortWithinPartitions(*FEATURES, "label")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(ready)
    discard(made)
    return forest


_FORESTS: dict[str, object] = {}


def own_forest(spark: SparkSession):
    """The forest of `labelled_findings`, fitted once in an application: its rows are made by a rule and never change."""
    app = spark.sparkContext.applicationId
    if app not in _FORESTS:
        _FORESTS.clear()
        _FORESTS[app] = train(labelled_findings(spark))
    return _FORESTS[app]


def score(findings: DataFrame, forest) -> DataFrame:
    """Adds the forest's probability of a secret as `score`."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings))
    return forest.transform(ready).withColumn("score", F.round(vector_to_array("probability")[1], 9)).drop("features", "rawPrediction", "probability", "prediction", *FEATURES)


def scan(docs: DataFrame, forest=None, threshold: float = THRESHOLD, path: Column | None = None, findings: DataFrame | None = None) -> DataFrame:
    """All candidates with score and secret: doc_id, place, start_at, candidate, before, after, path, score, secret. findings: labelled ones to train on."""
    return _judged(candidates(docs, path), forest, threshold, findings)


def _judged(found: DataFrame, forest, threshold: float, labelled: DataFrame | None) -> DataFrame:
    if forest is None:
        forest = train(labelled) if labelled is not None else own_forest(found.sparkSession)
    return score(found, forest).withColumn("secret", F.col("score") >= threshold)


def redact(docs: DataFrame, forest=None, threshold: float = THRESHOLD, path: Column | None = None, findings: DataFrame | None = None) -> DataFrame:
    """docs with every secret in the text, by its place, replaced by MASK and n_chars, if there is one, of the new text.

    Texts meet their verdicts by a digest of the text and its path, so null and repeated ids do no harm; texts without a candidate aren't moved.
    """
    has = F.coalesce(F.translate("text", _OPEN + _CLOSE, "  ").rlike(CANDIDATE), F.lit(False))
    own = (path if path is not None else F.lit(None)).cast("string")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    some = docs.where(has).select(whole.alias("row"), F.md5(F.concat_ws(_OPEN, "text", own)).alias("key"), own.alias("path"), _parts(F.col("text")).alias("parts"))
    some = settle(some, "with-candidates")
    found = _judged(_findings(some.select(F.col("key").alias("doc_id"), "path", "parts")), forest, threshold, findings)
    found = settle(found.select(F.col("doc_id").alias("key"), "place", "secret").distinct(), "verdicts")
    flags = found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "secret"))), lambda x: x["secret"]).alias("flags"))  # of one text
    flags = settle(flags.where(F.exists("flags", lambda x: x)), "secrets")
    rest = lambda p: F.substring_index(p, _CLOSE, -1)
    masked = F.transform("parts", lambda p, i: F.when(i == 0, p).when(F.element_at("flags", F.greatest(i, F.lit(1))), F.concat(F.lit(MASK), rest(p))).otherwise(F.translate(p, _CLOSE, "")))
    text = F.when(F.col("flags").isNull(), F.col("row.text")).otherwise(F.array_join(masked, ""))
    new = {"text": text, "n_chars": F.when(F.col("flags").isNull(), F.col("row.n_chars")).otherwise(F.length(text)) if "n_chars" in docs.columns else None}
    out = [new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]
    return docs.where(~has).unionByName(some.join(flags, "key", "left").select(*out))
