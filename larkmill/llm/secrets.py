"""Secret scan: pattern candidates, false positives removed by a random forest.

Candidates are private key blocks, values right after a key-like word (and a sign or a space), and long runs of key characters,
with or without digits. A forest judges each by its length, character transitions, dictionary coverage, the document's path and
the neighbouring words on both sides. It is trained at run time on labelled findings made from a hash sequence: keys of the common
shapes, pass phrases and short passwords in the contexts they stand in, and what is often taken for them (digests, identifiers,
card numbers, paths, placeholders, long words, plain words after a key-like one). The forest is then written out as one column
expression, so that scanning happens within the row, without a join or a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, free, table

TREES, TREE_DEPTH = 15, 6
#: Labelled findings that the forest is trained on.
FINDINGS = 6000
MASK = "[SECRET]"

#: Noncharacters that mark candidates in a text; texts that hold them themselves are escaped before.
MARK, ESCAPE = "\ufdd0", "\ufdd1"

_NAMES = "secret|token|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer"
_BLOCK = "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\\s:,]|-(?!----))*+(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?"
_LONG = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
_VALUE = "[A-Za-z0-9+/_.!@#-]"
_BEFORE = rf"(?i:{_NAMES})[\"']?(?:\s*[:=]>?\s*|\s+)[\"']?"
#: What stands ahead in group 1 (a key-like word and a sign), the candidate in group 2 or 3.
CANDIDATE = rf"({_BEFORE})(?!-----BEGIN )({_VALUE}{{8,}}+={{0,2}})|({_BLOCK}|{_LONG})"
#: Characters of the neighbouring words, on either side, in one line.
NEAR = 40

# Words around keys, words around what only looks like one, and dictionary words.
KEY_WORDS = f"(?i)({_NAMES}|key|aws|akia|ghp|login)"
OTHER_WORDS = "(?i)(commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|etag|revision|integrity|id|card|isbn|order|image|base64|href|src|url|http|version|build|phone)"
PREFIX = "^(AKIA|ASIA|AIza|ghp_|gho_|glpat-|sk_live_|xox[abp]-)"
PLACEHOLDER = "(?i)(example|sample|your|dummy|changeme|placeholder|xxxx|test|todo|redacted|secret_here)"
DICTIONARY = "account action address admin after application archive array auto base before block body book build button cache call card case category change channel check class client code color column comment common component config connection content context control copy core count create current custom data database date default delete detail device directory display document domain double down download edit element email enable error event example export feature field file filter first folder font form format forward frame from full function gallery general global graph group handler header height help hidden home host html icon image import index info input insert install integer item java javascript label language last layout left level library light line link list load local login long main manager master media member menu message method mobile mode model module month more name navigation network next node note number object offset open option order output package page panel parent password path payment people photo phone place player plugin point policy position post power price primary print private process product profile project property public query question queue random rate read record region release remote remove report request reset resource response"

NAMES = ("length", "case_turns", "kind_turns", "digits", "uppers", "hex", "kinds", "covered", "vowels", "block", "prefix", "key_before", "sign_before", "quoted", "other_before", "closed", "other_after", "key_after", "placeholder", "path_test", "path_code", "only_digits")


def _marked(text: Column) -> Column:
    """Pieces of a text: what lies between candidates at even places, candidates at odd ones. One place without a candidate.

    The next candidate of either kind is taken, so that none is passed over as what stands ahead of another.
    """
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}b")), F.lit(MARK), F.lit(f"{ESCAPE}a"))
    return F.split(F.regexp_replace(safe, CANDIDATE, f"$1{MARK}$2$3{MARK}"), MARK)


def _joined(pieces: Column) -> Column:
    """The text of pieces."""
    return F.replace(F.replace(F.array_join(pieces, ""), F.lit(f"{ESCAPE}a"), F.lit(MARK)), F.lit(f"{ESCAPE}b"), F.lit(ESCAPE))


def candidates(pieces: Column) -> Column:
    """Candidates of a text's pieces, in order: array of structs (before, value, after, at), with up to NEAR characters of the same
    line on either side, and the piece's place."""
    last = F.size(pieces) - 1
    line_end = lambda x: F.element_at(F.split(x, "\n"), -1)
    ahead = lambda i: F.right(line_end(F.get(pieces, i - 1)), F.lit(NEAR))
    behind = lambda i: F.left(F.split(F.get(pieces, i + 1), "\n")[0], F.lit(NEAR))
    places = F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(ahead(i).alias("before"), F.get(pieces, i).alias("value"), behind(i).alias("after"), i.alias("at")))


def _share(value: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kind}]", "")) / F.length(value)


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """Numbers that the forest sees, in the order of NAMES."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    runs = lambda x: F.length(F.regexp_replace(x, r"(.)\1*", "$1")) - 1
    parts = F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1-$2")), "[^a-z]+")
    known = F.aggregate(F.filter(parts, lambda x: F.length(x) >= 4), F.lit(0), lambda a, x: a + F.when(F.instr(F.lit(f" {DICTIONARY} "), F.concat(F.lit(" "), x, F.lit(" "))) > 0, F.length(x)).otherwise(0))
    truth = lambda c: c.cast("double")
    path = F.coalesce(path, F.lit(""))
    made = [
        F.length(value), runs(F.regexp_replace(kinds, "[0-]", "")) / F.length(value), runs(kinds) / F.length(value), _share(value, "0-9"), _share(value, "A-Z"),
        truth(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")), F.length(F.array_join(F.array_distinct(F.split(kinds, "")), "")), known / F.length(value), _share(value, "aeiouAEIOU"), truth(F.startswith(value, F.lit("-----BEGIN "))), truth(value.rlike(PREFIX)),
        truth(before.rlike(KEY_WORDS)), truth(before.rlike("[:=]\\s*[\"']?$")), truth(before.rlike("[\"']$")), truth(before.rlike(OTHER_WORDS)), truth(after.rlike("^[\"']")), truth(after.rlike(OTHER_WORDS)), truth(after.rlike(KEY_WORDS)),
        truth(value.rlike(PLACEHOLDER)), truth(path.rlike("(?i)(test|example|mock|fixture|doc)")), truth(path.rlike("(?i)\\.(py|js|java|go|env|ya?ml|json|conf|ini)$")), truth(value.rlike("^[0-9]+$")),
    ]
    return [F.coalesce(m.cast("double"), F.lit(0.0)) for m in made]


def labelled_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """(value, before, after, path, secret): findings of the ids from first on with their labels, drawn from a fixed hash sequence."""
    r = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    digest = lambda salt: F.sha2(F.concat_ws("/", F.col("id").cast("string"), F.lit(salt)), 512)
    text = lambda salt, n: F.left(F.regexp_replace(F.base64(F.unhex(digest(salt))), "[+/=]", ""), F.lit(n))
    hexes = lambda salt, n: F.left(digest(salt), F.lit(n) if isinstance(n, int) else n)
    pick = lambda salt, *options: F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), r(salt, len(options)) + 1)
    code = lambda salt, n: F.left(F.upper(F.regexp_replace(F.base64(F.unhex(digest(salt))), "[+/=01]", "")), F.lit(n))
    number = lambda salt, m: r(salt, m).cast("string")
    words = F.array(*map(F.lit, DICTIONARY.split()))
    word = lambda salt: F.element_at(words, r(salt, len(DICTIONARY.split())) + 1)
    syllable = lambda salt: pick(salt, *"ba ce di fo gu le mi no pra sto tru ver wal ken zin der tha ing ous ent sch heit tion pfg".split())
    letters = F.concat(*(F.translate(hexes(f"l{k}", 20), "0123456789abcdef", a) for k, a in enumerate(("QgRhSiTjUkVlWmXn", "aBcDeFgHiJkLmNoP"))))
    # what findings are put together from, each drawn once
    parts = {
        "name": pick("n", "token", "secret", "password", "api_key", "apikey", "API_KEY", "access_key", "auth", "TOKEN", "client_secret", "private_key", "passwd", "pwd"),
        "quote": pick("s2", '"', '"', "'"), "equals": pick("s", " = ", " = ", ": ", "=", ":"), "bare": pick("s3", "=", ": ", " = "),
        "filler": pick("f", "", "", "the value of ", "and then ", "x ", "see ", "const ", "export ", "with this ", "of "),
        "follows": pick("a", "", "", " and more of it", " then the", ", as it", " for the next", ". Then"),
        "short": F.concat(*(syllable(f"p{k}") for k in range(4)), pick("p4", "", "", "s", "nesting", "ationally")), "long": F.concat(*(syllable(f"q{k}") for k in range(6))),
        "stem": F.concat(syllable("p5"), syllable("p6"), syllable("p7")), "digits": number("num", 10000), "sum": hexes("i", pick("l", F.lit(40), F.lit(32), F.lit(64))),
        "w1": word("w1"), "w2": word("w2"), "w3": word("w3"), "joint": pick("j", "-", "_", "/", ""), "letters": letters,
        "other": pick("o", "commit ", "sha256: ", "sha1=", "md5 ", "checksum: ", "digest ", "uuid ", "id: ", 'id="', 'etag: "', "revision ", "integrity="),
        "shaped": pick("p", F.concat(pick("p1", "AKIA", "AKIA", "ASIA"), code("e", 16)), F.concat(pick("p2", "ghp_", "gho_"), text("e", 36)), F.concat(F.lit("sk_live_"), text("e", 24)), F.concat(F.lit("AIza"), text("e", 35)), F.concat(F.lit("xoxb-"), text("e", 30))), "code": code("z", 20), "hexed": hexes("a", 64), "mixed": text("b", 40),
    }
    # half of the findings come with a path; keys stand in sources and settings more often, others in tests and documents
    path = F.when(r("has", 2) > 0, F.lit("")).when((F.col("secret") == 1) != (r("odd", 12) == 0), pick("path", "src/app.py", "config/prod.env", "web/site.js", "deploy/values.yaml")).otherwise(pick("path2", "docs/readme.md", "tests/test_app.py", "examples/demo.txt", "fixtures/a.json"))
    drawn = spark.range(first, first + n).withColumn("secret", (r("label", 2) == 0).cast("double")).select("id", "secret", path.alias("path"), *(v.alias(k) for k, v in parts.items()))
    c = {k: F.col(k) for k in parts}
    join = lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    finding = lambda value, before, after=c["follows"]: F.struct(value.alias("value"), before.alias("before"), after.alias("after"))
    named, closed = join(c["filler"], c["name"], c["equals"], c["quote"]), join(c["quote"], c["follows"])
    key = pick("k", F.left("hexed", F.lit(40)), F.left("hexed", F.lit(32)), F.upper(F.left("hexed", F.lit(40))), c["mixed"], F.left("mixed", F.lit(24)), F.left("mixed", F.lit(20)), c["hexed"], F.left("letters", F.lit(40)), F.left("letters", F.lit(24)), c["shaped"], F.left("mixed", F.lit(12)), F.left("mixed", F.lit(16)))
    phrase = pick("ph", join(c["stem"], c["short"]), join(c["short"], c["digits"]), join(c["stem"], c["digits"], "!"), join(F.left("mixed", F.lit(4)), F.left("hexed", F.lit(6)), "1"), join("abcd", F.left("hexed", F.lit(10))))
    block = join("-----BEGIN ", pick("b1", "RSA ", "EC ", "", "OPENSSH "), "PRIVATE KEY-----\n", F.left(F.base64(F.unhex(digest("b2"))), 8 + r("b4", 70)), "\n", pick("b5", F.lit(""), F.base64(F.unhex(digest("b3"))), F.left("mixed", F.lit(9))), pick("b6", "", "\n-----END PRIVATE KEY-----", "\n-----END RSA PRIVATE KEY-----"))
    compound = join(c["w1"], c["joint"], c["w2"], c["joint"], c["w3"], c["joint"], pick("cn", F.left("digits", F.lit(2)), F.lit("")))
    numbers = F.left(F.regexp_replace(F.concat(F.conv(hexes("g", 15), 16, 10), F.conv(hexes("h", 15), 16, 10)), "[^0-9]", ""), 16 + r("len", 3))
    uuid = F.regexp_replace(hexes("u", 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    cased = lambda salt, x: pick(salt, x, F.initcap(x), F.initcap(x), F.upper(x))
    said = pick("o2", " is the checksum", " (sha1)", " is the commit", " as digest", " of the image")
    positive = pick("shape", finding(c["shaped"], c["filler"]), finding(c["shaped"], c["filler"]), finding(c["shaped"], F.lit("")), finding(key, named, closed), finding(key, named, closed), finding(key, join(c["filler"], c["name"], c["bare"])), finding(phrase, named, closed), finding(join(phrase, F.left("digits", F.lit(1))), join(c["filler"], c["name"], c["bare"])), finding(block, join(c["filler"], pick("b7", F.lit(""), F.lit(""), join(c["name"], c["bare"])))), finding(block, c["filler"], F.lit("")), finding(block, named, F.lit("")))
    negative = pick(
        "q",
        finding(numbers, join(c["filler"], pick("c", "", "card ", "", "of ", "number ", "the "))),
        finding(c["sum"], join(c["filler"], c["other"])),
        finding(c["sum"], c["filler"], said),
        finding(uuid, join(c["filler"], c["other"])),
        finding(F.left("code", 16 + r("cl", 5)), join(c["filler"], pick("co", "part ", "order ", "", "", "number ", "model "))),
        finding(compound, join(c["filler"], pick("t", F.lit(""), c["name"], c["other"], F.lit("class ")), pick("v", "", '="', " "))),
        finding(pick("h", "your_token_here_1", "xxxxxxxxxxxxxxxx0", "example-secret-123", "changeme12345678", "test_password_1234", "dummy-api-key-0000", "placeholder", "your-password"), named, closed),
        finding(join(c["w1"], "/", compound), join(c["filler"], pick("g", 'href="/', 'src="/', "http://host/", "path "))),
        finding(join(c["w1"], F.left("digits", F.lit(1))), join(c["filler"], pick("z", "token ", "the key ", "auth ", "password "))),
        finding(join(cased("u1", c["short"]), pick("x5", "", "", ".", "-")), join(c["filler"], pick("z2", "token ", "the secret ", "auth ", "password ", "no credential "))),
        finding(cased("u2", c["long"]), join(c["filler"], pick("z3", "", "", "the ", "a "))),
        finding(cased("u3", join(c["stem"], c["short"])), join(c["filler"], pick("z4", "", "", "the ", ". "))),
        finding(join(c["w1"], pick("x6", "_", "-", ""), c["w2"]), join(c["filler"], c["name"], c["bare"])),
    )
    return drawn.select("secret", "path", F.when(F.col("secret") == 1, positive).otherwise(negative).alias("x")).select("x.value", "x.before", "x.after", "path", "secret")


def train(spark: SparkSession, rows: DataFrame | None = None) -> list:
    """The forest, trained on labelled findings: trees as a leaf's value or (feature, threshold, left, right)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = rows if rows is not None else labelled_findings(spark)
    made = rows.select("secret", *(c.alias(n) for n, c in zip(NAMES, features(F.col("value"), F.col("before"), F.col("after"), F.col("path")), strict=True))).coalesce(1)
    ready = VectorAssembler(inputCols=list(NAMES), outputCol="v").transform(made).select("secret", "v").cache()
    model = RandomForestClassifier(featuresCol="v", labelCol="secret", numTrees=TREES, maxDepth=TREE_DEPTH, featureSubsetStrategy="0.5", seed=11).fit(ready)
    ready.unpersist()

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        return node.split().featureIndex(), node.split().threshold(), read(node.leftChild()), read(node.rightChild())

    return [read(t._java_obj.rootNode()) for t in model.trees]


def votes(trees: list, f: Column) -> Column:
    """Share of the trees that take the findings of a feature array for secrets."""

    def column(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        i, edge, left, right = node
        return F.when(f[i] <= edge, column(left)).otherwise(column(right))

    return reduce(lambda a, b: a + b, map(column, trees)) / float(len(trees))


def with_findings(documents: DataFrame, trees: list, text: str = "text", path: str | None = None, names: tuple[str, str] = ("pieces", "found")) -> DataFrame:
    """documents, all columns, and two more of the names: the text's pieces, and an array of structs (value, votes, at) of what at
    least half of the trees judge a secret, in order; at is the piece's place. Null and empty texts have none."""
    at = F.lit("") if path is None else F.col(path)
    pieces, found = names
    docs = bound(documents, pieces, _marked(F.coalesce(F.col(text), F.lit(""))))

    def judged(c):
        share = F.transform(F.array(F.array(*features(c["value"], c["before"], c["after"], at))), lambda f: votes(trees, f))[0]
        return F.struct(c["value"].alias("value"), share.alias("votes"), c["at"].alias("at"))

    return bound(docs, found, F.filter(F.transform(candidates(F.col(pieces)), judged), lambda x: x["votes"] >= 0.5))


def scan_secrets(documents: DataFrame, trees: list, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, place, value, votes) of every finding; place counts a document's findings from 0.

    Null and empty texts give no row, repeated rows give rows each, and rows of a null id count too. Other columns are not read.
    """
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), (F.lit("") if path is None else F.col(path)).alias("path"))
    found = with_findings(docs, trees, path="path").select("doc_id", F.posexplode("found").alias("place", "x"))
    return found.select("doc_id", "place", "x.value", "x.votes")


def mask_secrets(documents: DataFrame, trees: list, text: str = "text", path: str | None = None) -> DataFrame:
    """documents, all columns, with the secrets in the texts replaced by MASK where they stand; all else is left as it is.

    Null and empty texts stay as they are, repeated rows are masked alike. Columns of any other name do not matter.
    """
    pieces, found = free(documents, "pieces"), free(documents, "found")
    gone = F.transform(found, lambda x: x["at"])
    masked = _joined(F.transform(pieces, lambda x, i: F.when(F.array_contains(gone, i), F.lit(MASK)).otherwise(x)))
    done = with_findings(documents, trees, text, path, (pieces, found))
    return done.withColumn(text, F.when(F.size(found) > 0, masked).otherwise(F.col(text))).drop(pieces, found)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents; values as digests."""
    found = scan_secrets(table(spark, sf_dir, "documents"), train(spark))
    return found.select("doc_id", "place", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), F.round("votes", 6).alias("votes"))
