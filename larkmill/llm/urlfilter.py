"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression; the literal tokens that any match must hold are read off the expression. Token frequencies
are counted over all URLs; each rule is filed under its rarest token only. The tokens of a URL fetch candidate rules by an
equi-join, and regular expressions run for those pairs alone. Rules without such a token are tried on every address.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from re import _constants as op
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table

#: Rows of the token index up to which it is broadcast; larger rule sets are joined by shuffle.
BROADCAST_RULES = 50_000
#: Bytes of matched addresses up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Rules without a token that are accepted: each costs one regular expression on every address.
MOST_WITHOUT_TOKEN = 200

_ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"


def _outside(items) -> bool:
    """Whether a character class holds no letter or digit."""
    held, negated = set(), False
    for kind, value in items:
        if kind is op.NEGATE:
            negated = True
        elif kind is op.LITERAL:
            held.add(chr(value))
        elif kind is op.RANGE:
            held |= {c for c in _ALNUM if value[0] <= ord(c) <= value[1]}
        else:
            return False
    return held >= set(_ALNUM) if negated else not held & set(_ALNUM)


def _elements(parsed) -> list[tuple]:
    """An expression as ("literal", character), ("edge",) or ("part", begins with an edge, ends with one, may be missing)."""
    out: list[tuple] = []
    for kind, value in parsed:
        if kind is op.LITERAL and chr(value) in _ALNUM:
            out.append(("literal", chr(value)))
        elif kind is op.LITERAL or kind is op.AT and value in (op.AT_BEGINNING, op.AT_END) or kind is op.IN and _outside(value):
            out.append(("edge",))
        elif kind is op.SUBPATTERN and not value[1] and not value[2]:
            out += _elements(value[3])
        elif kind is op.BRANCH:
            ends = [_ends(_elements(x)) for x in value[1]]
            out.append(("part", all(x[0] for x in ends), all(x[1] for x in ends), False))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            out.append(("part", *_ends(_elements(value[2])), value[0] == 0))
        else:
            out.append(("part", False, False, False))
    return out


def _ends(elements: list[tuple]) -> tuple[bool, bool]:
    return _edge(elements, 0, 1), _edge(elements, len(elements) - 1, -1)


def _edge(elements: list[tuple], k: int, way: int) -> bool:
    """Whether what stands at place k, seen in a direction, can be no letter or digit; what may be missing is looked past, too."""
    while 0 <= k < len(elements):
        kind, *more = elements[k]
        if kind != "part" or not more[2]:
            return kind == "edge" or kind == "part" and more[0 if way > 0 else 1]
        if not more[0 if way > 0 else 1]:
            return False
        k += way
    return False


def literal_tokens(regex: str) -> tuple[str, ...]:
    """Whole tokens (runs of a-z and 0-9) that every match of an expression holds."""
    elements = _elements(_parser.parse(regex))
    found, k = [], 0
    while k < len(elements):
        end = k
        while end < len(elements) and elements[end][0] == "literal":
            end += 1
        if end > k and _edge(elements, k - 1, -1) and _edge(elements, end, 1):
            found.append("".join(x[1] for x in elements[k:end]))
        k = max(end, k + 1)
    return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class Rule:
    """name; verdict; regex over host + path, with A-Z of the path lower-cased if fold (those of the host always are); rank: a
    rule of higher rank wins, then the smaller name; reported: whether the verdict names the rule."""

    name: str
    verdict: str
    regex: str
    rank: int = 0
    fold: bool = True
    reported: bool = False
    tokens: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        # tokens are lower case; a literal capital is no token, as in a path that is not folded
        object.__setattr__(self, "tokens", literal_tokens(self.regex))


def site_rule(verdict: str, site: str) -> Rule:
    """A rule host/path: fits the host, its subdomains and every path that starts with the rule's; longest wins."""
    host, slash, path = site.partition("/")
    return Rule(site, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", 1000 + len(site), fold=False, reported=True)


def listed_rules(lines: Iterable[str], rank: int = 1) -> tuple[Rule, ...]:
    """Rules of a public block list: ||host^, |start, end|, * and ^ as wildcards, /expression/, @@ for exceptions, which win.

    Comments, element rules and rules with options ($...) are left out: they ask for more than an address.
    """
    found = []
    for line in map(str.strip, lines):
        allow, body = line.startswith("@@"), line.removeprefix("@@")
        expression = len(body) > 2 and body[0] == body[-1] == "/"
        if not body or line[0] in "![" or "##" in line or "#@#" in line or "$" in body and not expression:
            continue
        if expression:
            regex = body[1:-1]
        else:
            start = next((x for x in ("||", "|") if body.startswith(x)), "")
            end = "|" if body.endswith("|") and len(body) > len(start) else ""
            middle = body[len(start) : len(body) - len(end)].lower()
            regex = {"||": r"^([^/]*\.)?", "|": "^", "": ""}[start] + "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in middle) + "$" * bool(end)
        found.append(Rule(line, "allow" if allow else "block", regex, rank + allow))
    return tuple(found)


SITE_RULES = (site_rule("block", "net/"), site_rule("allow", "example.net/en/"), site_rule("block", "example.com/de/"), site_rule("allow", "org/fr/"))

#: Patterns of advertising, tracking, adult, gambling and malware addresses.
PATTERN_RULES = (
    Rule("ad server", "block", r"^ads\.[^/]*/"),
    Rule("tracker image", "block", r"/(track|pixel)\.gif$"),
    Rule("click tracker", "block", r"^click\.[^/]*/"),
    Rule("adult host", "block", r"^([^/]*\.)?porn\.[^/]*/"),
    Rule("casino host", "block", r"^([^/]*\.)?casino\.[^/]*/"),
    Rule("phishing login", "block", r"/(secure|verify)/login(/|$)"),
    Rule("executable", "block", r"/[^/]+\.exe$"),
)

_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def parts(url):
    """(host, path) of a URL: host up to / ? # with A-Z lower-cased, path up to ? #; both empty without ://."""
    has = F.instr(url, "://") > 0
    host = F.translate(F.regexp_extract(url, _HOST, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(url, _PATH, 1)).otherwise("")


def _lower(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict for every row.

    A URL that no rule matches is allowed and has a null rule. Null or odd URLs have empty parts and are allowed. Repeated
    keys give a row each. Other columns of the input are not read. An address is judged once, however many rows have it; rows
    without an address are dealt out one by one. More than MOST_WITHOUT_TOKEN rules without a literal token are refused.
    """
    spark = pages.sparkSession
    host, path = parts(F.col(url))
    base = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    # the path is empty or begins with a slash, which no host holds, so that host and path joined are the address
    seen = base.where("host <> '' or path <> ''").groupBy(F.concat("host", "path").alias("address")).agg(F.count("*").alias("n"))
    seen = seen.withColumn("folded", _lower(F.col("address"))).withColumn("tokens", F.array_distinct(F.split("folded", "[^a-z0-9]+")))
    token_rows = [(i, t) for i, r in enumerate(rules) for t in r.tokens]
    few = F.broadcast if len(token_rows) <= BROADCAST_RULES else lambda x: x
    rule_tokens = spark.createDataFrame(token_rows, "rule_no int, token string")
    counts = seen.select(F.explode("tokens").alias("token"), "n").join(few(rule_tokens.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("n"))
    index = rule_tokens.join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    text = spark.createDataFrame([(i, r.name if r.reported else None, r.name, r.verdict, r.regex, r.rank, r.fold) for i, r in enumerate(rules)], "rule_no int, rule string, name string, verdict string, regex string, rank int, fold boolean")
    judged = F.struct((-F.col("rank")).alias("rank"), "name", "rule", "verdict")
    hits = seen.select("address", "folded", F.explode("tokens").alias("token")).join(few(index.join(few(text), "rule_no")), "token").where(F.expr("if(fold, folded, address) rlike regex")).select("address", judged.alias("hit"))
    loose = [r for r in rules if not r.tokens]
    if len(loose) > MOST_WITHOUT_TOKEN:
        raise ValueError(f"{len(loose)} rules have no literal token, e.g. {loose[0].name}")
    if loose:
        tried = [F.when(F.col("folded" if r.fold else "address").rlike(r.regex), F.struct(F.lit(-r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.name if r.reported else None).cast("string").alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in loose]
        hits = hits.union(seen.select("address", F.array_min(F.array(*tried)).alias("hit")).where("hit is not null"))
    best = staged(hits.groupBy("address").agg(F.min("hit").alias("hit")).select(F.col("address").alias("look"), "hit.rule", "hit.verdict"), "judged")
    small = (best.agg(F.sum(F.octet_length("look") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    look = F.when((F.col("host") == "") & (F.col("path") == ""), F.concat(F.lit("?"), F.monotonically_increasing_id())).otherwise(F.concat("host", "path"))
    joined = base.withColumn("look", look).join(F.broadcast(best) if small else best, "look", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """filter_urls over all pages."""
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """DuckDB: every rule against every page, without an index."""
    q = lambda x: "'" + str(x).replace("'", "''") + "'"
    quoted = ", ".join(f"({q(r.name)}, {q(r.verdict)}, {q(r.regex)}, {r.rank}, {r.fold}, {r.reported})" for r in SITE_RULES + PATTERN_RULES)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT page_id,
    CASE WHEN contains(url, '://') THEN {lower("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")} ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
r(name, verdict, regex, rank, fold, reported) AS (VALUES {quoted}),
m AS (SELECT p.page_id, r.name, r.verdict, r.reported, row_number() OVER (PARTITION BY p.page_id ORDER BY r.rank DESC, r.name) AS k
      FROM p JOIN r ON regexp_matches(CASE WHEN fold THEN {lower("p.host || p.path")} ELSE p.host || p.path END, r.regex))
SELECT p.page_id, p.host, p.path, CASE WHEN m.reported THEN m.name END AS rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1"""
