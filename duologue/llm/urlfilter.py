"""URL filtering by pattern rules that are indexed by their rarest literal token.

Every rule is a regular expression over ``host || path`` together with the literal tokens any
matching URL must hold. The corpus decides which of those tokens is rarest; the rule is filed
under it. A URL's own tokens then fetch the few candidate rules, and only those run their
expressions. All of it is DataFrame expressions.

The index is a hash table: an array of buckets, addressed by a checksum of the token, so a look-up
costs the same with ten rules and with a hundred thousand. Up to ``TABLE_BYTES`` it is one literal
of the plan, and filtering is a projection without a shuffle. A longer rule list stays a table:
the tokens of the distinct URLs meet it in a join, and the verdicts come back by host and path.
Both ways give the same rows. Any number of rules is taken.

Null URLs, URLs without ``://`` and empty tables: host and path are empty strings, no rule fits,
the verdict is the default's. Of fitting rules the highest tier wins, then the longest name, then
the last name in order of characters. Repeated rows each get their verdict. Columns of the input that
clash with result columns are replaced by the result's.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A token is a longest run of these; a rule may only be filed under a token that its expression bounds on both sides.
TOKEN = "[a-z0-9]+"
#: Bytes of the rules, as JSON, up to which their index travels in the plan.
TABLE_BYTES = 8 << 20
RULE = "tier:int,len:int,name:string,verdict:string,regex:string"


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str
    #: rules of a higher tier win over all of a lower one; within a tier the longest name wins
    tier: int = 0


def prefix_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    path = slash + path
    tokens = re.findall(TOKEN, host.lower())
    tokens += [m[0].lower() for m in re.finditer("[A-Za-z0-9]+", path) if m.end() < len(path)]
    return Rule(rule, rf"^(?:[^/]*\.)?{_quote(host)}{_quote(path)}", tuple(tokens), verdict, 1)


def host_word_rule(word: str) -> Rule:
    """Blocks hosts that hold the given hyphenated words as whole tokens."""
    return Rule(f"||{word}^", rf"^[^/]*(?<![a-z0-9]){_quote(word)}(?![a-z0-9])[^/]*(?:/|$)", tuple(re.findall(TOKEN, word)), "block")


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


SITE_RULES = (
    prefix_rule("allow", "org/"),
    prefix_rule("block", "example.org/es/"),
    prefix_rule("block", "example.org/en/1"),
    prefix_rule("allow", "com/fr/"),
    prefix_rule("block", "com/de/"),
)
SPAM_WORDS = (
    "cheap-pills spam-farm casino free-money adult porn xxx payday-loan replica-watches betting "
    "viagra cialis online-pharmacy weight-loss-pills poker roulette slots jackpot sportsbook bookmaker lottery-winner "
    "sex escort escorts webcam-girls hentai nude nudes milf camgirls hookup "
    "fast-cash quick-loan get-rich-quick earn-money-online forex-signals binary-options crypto-doubler bitcoin-doubler "
    "fake-rolex replica-handbags cheap-jordans essay-writing buy-followers buy-likes buy-backlinks link-farm "
    "warez crackz keygen serialz nulled torrentz"
).split()
DEFAULT_RULES = SITE_RULES + tuple(host_word_rule(w) for w in SPAM_WORDS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.concat(host, path), UPPER, LOWER), F.lit(f"({TOKEN})"), 1))


def _buckets(entries: dict[str, list[dict]], value: str) -> Column:
    """A literal hash table: token -> list of values, as an array of short buckets."""
    table: list[list[dict]] = [[] for _ in range(max(1, len(entries)))]
    for token, values in sorted(entries.items()):
        table[zlib.crc32(token.encode()) % len(table)].append({"token": token, "values": values})
    # parsed once, when the plan is optimised: the expression is constant
    return F.from_json(F.lit(json.dumps(table)), f"array<array<struct<token:string,values:array<{value}>>>>")


def _look_up(table: Column, size: int, token: Column) -> Column:
    bucket = F.element_at(table, (F.crc32(token.cast("binary")) % F.lit(max(1, size)) + 1).cast("int"))
    return F.flatten(F.transform(F.filter(bucket, lambda e: e["token"] == token), lambda e: e["values"]))


def _in_plan(rules: Sequence[Rule], limit: int) -> bool:
    return sum(len(r.name) + len(r.regex) + len(r.verdict) + sum(map(len, r.tokens)) + 64 for r in rules) <= limit


def rarest_tokens(pages: DataFrame, url_col: str, rules: Sequence[Rule], limit: int = TABLE_BYTES) -> dict[str, int]:
    """In how many URLs each literal token of the rules occurs; one row per rule token reaches the driver, which holds the rules too."""
    literal = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(literal, 0)
    if literal:
        host, path = host_and_path(F.col(f"`{url_col}`"))
        tokens = _tokens(host, path)
        if _in_plan(rules, limit):
            table = _buckets({t: [{"n": 1}] for t in literal}, "struct<n:int>")
            used = pages.select(F.explode(F.filter(tokens, lambda t: F.size(_look_up(table, len(literal), t)) > 0)).alias("token"))
        else:
            used = pages.select(F.explode(tokens).alias("token")).join(pages.sparkSession.createDataFrame([(t,) for t in literal], "token string"), "token", "left_semi")
        counts |= {r["token"]: r["n"] for r in used.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return counts


def filter_urls(pages: DataFrame, url_col: str = "url", rules: Sequence[Rule] = DEFAULT_RULES, default: str = "allow", limit: int = TABLE_BYTES) -> DataFrame:
    """Adds host, path, rule (of the prefix rules, else null), pattern (any rule that decided) and verdict."""
    counts = rarest_tokens(pages, url_col, rules, limit)
    filed: dict[str, list[dict]] = {}
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name} has no literal token to be filed under")
        row = {"tier": r.tier, "len": len(r.name), "name": r.name, "verdict": r.verdict, "regex": r.regex}
        filed.setdefault(min(r.tokens, key=lambda t: (counts[t], t)), []).append(row)

    host, path = host_and_path(F.col(f"`{url_col}`"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "pattern", "verdict")]
    located = pages.select(*(F.col(f"`{c}`") for c in kept), host.alias("host"), path.alias("path"))
    if not filed:
        return located.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("pattern"), F.lit(default).alias("verdict"))
    where, tokens = F.concat(F.col("host"), F.col("path")), _tokens(F.col("host"), F.col("path"))
    if _in_plan(rules, limit):
        table = _buckets(filed, f"struct<{RULE}>")
        candidates = F.flatten(F.transform(tokens, lambda t: _look_up(table, len(filed), t)))
        best = located.withColumn("__best", F.array_max(F.filter(candidates, lambda r: F.regexp_like(where, r["regex"]))))
    else:
        index = pages.sparkSession.createDataFrame([(t, v) for t, vs in filed.items() for v in vs], f"token string, value struct<{RULE}>")
        asked = located.select("host", "path").distinct().select("host", "path", F.explode(tokens).alias("token"))
        fits = asked.join(index, "token").filter(F.regexp_like(where, F.col("value.regex")))
        found = fits.groupBy("host", "path").agg(F.max("value").alias("__best"))
        best = located.join(found, ["host", "path"], "left")
    return best.select(
        *(F.col(f"`{c}`") for c in kept),
        "host",
        "path",
        F.when(F.col("__best.tier") == 1, F.col("__best.name")).alias("rule"),
        F.col("__best.name").alias("pattern"),
        F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _sql() -> str:
    def case(value, rules):
        order = sorted(rules, key=lambda r: (r.tier, len(r.name), r.name), reverse=True)
        tests = {r.name: (f"(host = '{r.name.partition('/')[0]}' OR ends_with(host, '.{r.name.partition('/')[0]}')) AND starts_with(path, '/{r.name.partition('/')[2]}')" if r.tier else f"regexp_matches(host, '(^|[^a-z0-9]){r.name[2:-1]}($|[^a-z0-9])')") for r in order}
        return "CASE " + " ".join(f"WHEN {tests[r.name]} THEN '{value(r)}'" for r in order) + " END"

    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, {case(lambda r: r.name, SITE_RULES)} AS rule,
       coalesce({case(lambda r: r.verdict, DEFAULT_RULES)}, 'allow') AS verdict,
       {case(lambda r: r.name, DEFAULT_RULES)} AS pattern
FROM parts"""


SQL = _sql()
