"""URL filters: rules indexed by their rarest literal token.

Two kinds of rules. A site rule is a host and a path (``example.com/en/``): it fits the
host and its subdomains when the URL's path starts with the rule's path; among the site
rules that fit, the longest decides (at equal length block before allow). A pattern rule
is a wildcard pattern over host, path and query in the customary notation: ``*`` is any
run of characters, ``^`` one separator or the end. A URL no site rule fits is blocked if
a blocking pattern fits and no allowing pattern does, else allowed.

Every rule becomes a regular expression and is filed under one of its literal tokens:
the one in fewest URLs of the corpus, counted over all of them. The tokens of a URL fetch
candidate rules, and only those are run. Rules without a whole literal token are tried on
every URL. Rules are shipped in chunks of ``RULES_PER_PASS``; each chunk is another narrow
pass, so no shipped index outgrows that bound and nothing is shuffled.

Defined cases: null URL, or one without ``://``: host and path are empty, no rule,
allowed. Other columns pass through; those named like a result column are replaced.
Repeated rows are judged alike, and very long URLs whole. Empty table or no rules: no
rows, or all allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES_PER_PASS = 50_000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class UrlRule:
    """``kind`` is site or pattern, ``verdict`` allow or block."""

    text: str
    verdict: str
    kind: str = "site"

    def regex(self) -> str:
        if self.kind == "site":
            return r"(?s)(?:[^/?#]*\.)?" + re.escape(self.text)
        return "(?s).*?" + "".join(".*" if c == "*" else r"(?:[^a-zA-Z0-9._%-]|$)" if c == "^" else re.escape(c) for c in self.text)

    def tokens(self) -> set[str]:
        """Tokens that any URL the rule fits has whole: nothing may extend them at either end."""
        text = self.text.translate(str.maketrans(UPPER, LOWER))
        found = set()
        for m in TOKEN.finditer(text):
            left = text[m.start() - 1] if m.start() else ("." if self.kind == "site" else "*")
            right = text[m.end()] if m.end() < len(text) else "*"
            if "*" not in (left, right):
                found.add(m[0])
        return found


#: Patterns of referral links and of gambling, adult and piracy sites.
DEFAULT_PATTERNS = tuple(UrlRule(p, "block", "pattern") for p in ("?ref=", "&ref=", "?affid=", "&affid=", ".casino.", "-casino-", "/casino/", ".porn.", "/porn/", ".xxx^", "/torrent/", "/warez/"))


def url_parts(urls: DataFrame, url_col: str) -> DataFrame:
    url = F.col(url_col)
    return urls.withColumns({
        "host": F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit("")),
        "path": F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")),
        "__rest": F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit("")),
    })


def rarest_tokens(parts: DataFrame, rules: list[UrlRule]) -> dict[str, int]:
    """In how many URLs each token of the rules is; the result is as large as the rules."""
    wanted = sorted(set().union(*(r.tokens() for r in rules)))
    spark = parts.sparkSession
    text = F.translate(F.concat("host", "path", "__rest"), UPPER, LOWER)
    tokens = parts.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1))).alias("token"))
    counted: dict[str, int] = {}
    for i in range(0, len(wanted), RULES_PER_PASS):
        some = spark.createDataFrame([(t,) for t in wanted[i : i + RULES_PER_PASS]], "token string")
        counted |= {r["token"]: r["count"] for r in tokens.join(F.broadcast(some), "token").groupBy("token").count().collect()}
    return {t: counted.get(t, 0) for t in wanted}


def _stage(index: dict[str, list[int]], always: list[int], rules: list[UrlRule]):
    compiled: dict[int, re.Pattern] = {}

    def fit(text: str, host: str) -> Iterator[UrlRule]:
        tokens = set(TOKEN.findall(text.translate(str.maketrans(UPPER, LOWER))))
        for n in [i for t in tokens for i in index.get(t, ())] + always:
            pattern = compiled.get(n) or compiled.setdefault(n, re.compile(rules[n].regex()))
            if pattern.match(text):
                yield rules[n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            sites, blocks, allows = (columns[k].to_pylist() for k in ("__site", "__block", "__allow"))
            for i, (host, path, rest) in enumerate(zip(*(columns[k].to_pylist() for k in ("host", "path", "__rest")), strict=True)):
                for rule in fit(host + path + rest, host):
                    if rule.kind == "site":
                        best = sites[i] and (len(sites[i]["text"]), sites[i]["verdict"], sites[i]["text"])
                        if not best or (len(rule.text), rule.verdict, rule.text) > best:
                            sites[i] = {"text": rule.text, "verdict": rule.verdict}
                    elif rule.verdict == "block":
                        blocks[i] = min(blocks[i] or rule.text, rule.text)
                    else:
                        allows[i] = min(allows[i] or rule.text, rule.text)
            for k, v in (("__site", sites), ("__block", blocks), ("__allow", allows)):
                columns[k] = pa.array(v, columns[k].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def filter_urls(urls: DataFrame, rules: list[UrlRule], *, url_col: str = "url") -> DataFrame:
    """The input with ``host``, ``path``, ``rule`` (a site rule or null), ``pattern`` and ``verdict``."""
    parts = url_parts(urls.drop(*({"host", "path", "rule", "pattern", "verdict"} - {url_col})), url_col)
    rules = list(dict.fromkeys(rules))
    rare = rarest_tokens(parts, rules) if rules else {}
    out = parts.withColumns({"__site": F.lit(None).cast("struct<text:string,verdict:string>"), "__block": F.lit(None).cast("string"), "__allow": F.lit(None).cast("string")})
    for at in range(0, len(rules), RULES_PER_PASS):
        some, index, always = rules[at : at + RULES_PER_PASS], {}, []
        for n, rule in enumerate(some):
            if tokens := rule.tokens():
                index.setdefault(min(tokens, key=lambda t: (rare[t], t)), []).append(n)
            else:
                always.append(n)
        out = out.mapInArrow(_stage(index, always, some), T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema]))
    verdict = F.coalesce(F.col("__site.verdict"), F.when(F.col("__block").isNotNull() & F.col("__allow").isNull(), "block").otherwise("allow"))
    out = out.withColumns({"rule": F.col("__site.text"), "pattern": F.coalesce("__allow", "__block"), "verdict": verdict})
    return out.drop("__rest", "__site", "__block", "__allow")
