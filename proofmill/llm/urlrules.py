"""URL filters [native]: pattern rules indexed by their rarest literal token.

A rule is `host/path` text: it fits its host and every subdomain when the url's path starts
with the rule's path; `*` in the path stands for any run of characters, an empty host for
every host. Literal tokens are the host's labels and the path segments that a slash closes.
Each rule is filed under the one of its tokens that the fewest rules have. The tokens of a
url fetch candidate rules; only those run their regular expression; the longest rule wins
(equal lengths: the greater rule text).

Defined cases: null url or no `://`: empty host and path, which no rule with a host fits.
Null rules are ignored; of rules repeated with other verdicts `block` < `allow` by text
order loses. Empty tables give empty results. Rules without a token run on every url. A very
long url is read whole; repeated page rows stay, each judged; extra columns are kept, those named
like a result column are replaced.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import ascii_lower, small

#: Up to this many rules the index is one literal inside the plan; beyond it, a join on the token.
INLINE_RULES = 64
_CANDIDATE = "array<struct<size:int,rule:string,verdict:string,regex:string>>"


def parse_rule(rule: str) -> tuple[str, list[str], str]:
    """(normalized rule, its literal tokens, its regular expression)."""
    host, slash, path = rule.partition("/")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    segments = (slash + path).split("/")[1:-1]
    tokens = [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in segments if x and "*" not in x]
    quote = lambda s: re.sub(r"([^\w])", r"\\\1", s, flags=re.ASCII)
    front = r"(?s)^(?:[^/]*\.)?" + quote(host) if host else "(?s)^[^/]*"
    tail = ".*".join(quote(x) for x in (slash + path).split("*"))
    return rule, tokens, front + ("(?=/|$)" if not slash else "") + tail


def rule_rows(rules: list[tuple[str, str]]) -> list[dict]:
    """One row per distinct rule with the token it is filed under (None: no literal token)."""
    kept = {r: v for r, v in sorted((r, v) for r, v in rules if r is not None and v is not None)}
    parsed = [(parse_rule(r), v) for r, v in kept.items()]
    common = Counter(t for (_, tokens, _), _ in parsed for t in set(tokens))
    return [
        {"token": min(tokens, key=lambda t: (common[t], t), default=None), "size": len(rule), "rule": rule, "verdict": verdict, "regex": regex}
        for (rule, tokens, regex), verdict in parsed
    ]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url, by the rules in the module's docstring."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(
        F.concat(
            F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x)),
        )
    )


def _best(candidates: Column, key: Column) -> Column:
    fits = F.filter(candidates, lambda c: F.rlike(key, c["regex"]))
    return F.array_max(F.transform(fits, lambda c: F.struct(c["size"], c["rule"], c["verdict"])))


def judge_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (the winning rule's, else `default`).

    Columns of pages with one of these four names are replaced. `rules` is a list of
    (rule, verdict) or a DataFrame with these columns; a large one is joined, never collected.
    """
    host, path = url_parts(F.col(f"`{url}`"))
    base = pages.withColumns({"host": host, "path": path})
    rows = rules if isinstance(rules, list) else small(rules.select("rule", "verdict"), INLINE_RULES)
    if rows is not None and len(rows) <= INLINE_RULES:
        found = _judge_inline(base, [tuple(r) for r in rows])
    else:
        found = _judge_joined(base, rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(rules, "rule string, verdict string"))
    return found.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))}).drop("_best")


def _judge_inline(base: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    rows = rule_rows(rules)
    index: dict[str, list[dict]] = {}
    for r in rows:
        index.setdefault(r["token"] or "", []).append({k: r[k] for k in ("size", "rule", "verdict", "regex")})
    always = F.from_json(F.lit(json.dumps(index.pop("", []))), _CANDIDATE)
    table = F.from_json(F.lit(json.dumps(index)), f"map<string,{_CANDIDATE}>")
    fetched = F.flatten(F.transform(url_tokens(F.col("host"), F.col("path")), lambda t: F.coalesce(F.try_element_at(table, t), F.from_json(F.lit("[]"), _CANDIDATE))))
    return base.withColumn("_best", _best(F.concat(fetched, always), F.concat("host", "path")))


def _judge_joined(base: DataFrame, rules: DataFrame) -> DataFrame:
    """The index as a table: distinct (host, path) rows meet rules on the token.

    Token counts are a pre-aggregated groupBy; a hot token is an inner equi-join key, which
    adaptive execution splits.
    """
    clean = rules.where("rule is not null and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    host = ascii_lower(F.regexp_extract("rule", r"(?s)^([^/]*)", 1))
    tail = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(tail, "/")
    closed = F.when(F.size(parts) > 2, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(closed, lambda x: (x != "") & ~F.contains(x, F.lit("*"))), lambda x: F.concat(F.lit("p:"), x))
    quote = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")
    front = F.when(host != "", F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quote(host))).otherwise(F.lit("(?s)^[^/]*"))
    middle = F.when(tail == "", F.lit("(?=/|$)")).otherwise(F.lit(""))
    regex = F.concat(front, middle, F.regexp_replace(quote(tail), r"\\\*", ".*"))
    parsed = clean.select("rule", "verdict", F.length("rule").alias("size"), regex.alias("regex"), F.array_distinct(F.concat(labels, segments)).alias("tokens"))
    filed = parsed.select("rule", F.explode("tokens").alias("token"))
    counts = filed.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = filed.join(counts, "token").groupBy("rule").agg(F.min(F.struct("n", "token")).alias("r")).select("rule", F.col("r.token").alias("token"))
    indexed = parsed.drop("tokens").join(rarest, "rule", "left")
    keys = base.select("host", "path").distinct()
    key = F.concat("host", "path")
    urls = keys.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    hits = urls.join(indexed.where("token is not null"), "token").where(F.rlike(key, F.col("regex")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("_best"))
    bare = small(indexed.where("token is null").select("rule", "verdict"), 1000)
    if bare is None:
        raise ValueError("more than 1000 rules hold no literal token: they would run on every url")
    out = base.join(best, ["host", "path"], "left")
    if bare:
        rows = [{k: r[k] for k in ("size", "rule", "verdict", "regex")} for r in rule_rows([tuple(r) for r in bare])]
        out = out.withColumn("_best", F.greatest("_best", _best(F.from_json(F.lit(json.dumps(rows)), _CANDIDATE), key)))
    return out
