"""URL filter: a weighted vocabulary matched by Aho-Corasick, and host and path rules.

Terms of the vocabulary count only between boundaries (no ASCII letter or digit beside them). One
strict term rejects a url, or distinct soft terms whose weights add up to enough. Rules for hosts
and paths go before.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import ascii_lower, stored

#: The vocabulary and the rules of production.
STRICT = ("adult", "casino", "escort", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bonus", "cheap", "click", "coupon", "deal", "farm", "free", "loan", "lucky", "prize", "promo", "track", "win")
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Weight of distinct soft terms that rejects (a term without a weight of its own weighs 1), and rules up to which they are one expression; more are joined.
SOFT_HITS, MOST_RULES = 2, 500
#: Bytes of hosts and paths with their rule up to which they are broadcast.
BROADCAST_BYTES = 48 << 20


@lru_cache(8)
def automaton(terms: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def terms_in(url: str, terms: tuple[str, ...]) -> set[str]:
    """The distinct terms of the vocabulary that stand in a url between boundaries."""
    if not terms:
        return set()
    text = "".join(c.lower() if c.isascii() else c for c in url) if not url.isascii() else url.lower()
    word = lambda k: 0 <= k < len(text) and text[k].isascii() and text[k].isalnum()
    return {t for end, t in automaton(terms).iter(text) if not word(end + 1) and not word(end - len(t))}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty for null or without `://`."""
    rest = F.coalesce(F.when(url.contains("://"), F.regexp_replace(url, r"^[\s\S]*?://", "")), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def read_vocabulary(lines: Sequence[str]) -> tuple[list[str], dict[str, float]]:
    """Strict terms and weighted soft terms of lines `strict term` or `soft term [weight]`; empty lines and those from # on are left out."""
    strict, soft = [], {}
    for line in lines:
        kind, *rest = line.split("#")[0].split() or [""]
        if kind == "strict":
            strict.append(rest[0].lower())
        elif kind == "soft":
            soft[rest[0].lower()] = float(rest[1]) if len(rest) > 1 else 1.0
        elif kind:
            raise ValueError(f"neither strict nor soft: {line}")
    return strict, soft


def _by_expression(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """`rows` with `rule` and `what`, null where none fits, as one expression."""
    name, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for w, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):  # the last one put on decides
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, what = F.when(fits, h + p).otherwise(name), F.when(fits, w).otherwise(what)
    return rows.withColumns({"rule": name, "what": what})


def _by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins of the suffixes of each distinct host and path with the hosts of any number of rules."""
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("what").alias("what"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = rows.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = fitting.groupBy("host", "path").agg(F.min(F.struct((-F.length(name)).alias("n"), name.alias("rule"), "what")).alias("best"))
    best = stored(best.select("host", "path", "best.rule", "best.what"), "ruled")
    size = best.agg(F.sum(F.length("host") + F.length("path") + F.length("rule") + 100)).first()[0] or 0
    return rows.join(F.broadcast(best) if size <= BROADCAST_BYTES else best, ["host", "path"], "left")


def url_filter(
    pages: DataFrame,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] | Mapping[str, float] = SOFT,
    rules: Sequence[tuple[str, str, str]] | DataFrame = RULES,
    soft_hits: float = SOFT_HITS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, strict_terms array, soft_terms array) of each row.

    The longest rule that fits decides, of equally long ones the first by name; without a rule the
    vocabulary does. Rules are (verdict, host, path prefix), or a table (what, rule_host, rule_path)
    of any size; of two verdicts for one host and path `block` wins. A null url has an empty host and
    path, no terms and the verdict allow; so has any url that nothing matches. Ids may be null or
    repeat, each row gives a row; other columns are left out.
    """
    weights = dict(soft) if isinstance(soft, Mapping) else dict.fromkeys(soft, 1.0)
    hard, weak = tuple(sorted(set(strict))), tuple(sorted(weights))

    @F.pandas_udf("strict_terms array<string>, soft_terms array<string>, weight double")
    def vocabulary(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in urls:
            found = [terms_in(u or "", hard + weak) for u in batch]
            near = [sorted(f.intersection(weak)) for f in found]
            yield pd.DataFrame({"strict_terms": [sorted(f.intersection(hard)) for f in found], "soft_terms": near, "weight": [float(sum(weights[t] for t in n)) for n in near]})

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("terms", vocabulary("url")).select("id", host.alias("host"), path.alias("path"), "terms.*")
    if isinstance(rules, DataFrame):
        ruled = _by_join(rows, rules)
    else:
        rules = [(w, h, p) for (h, p), w in {(h, p): w for w, h, p in sorted(rules)}.items()]  # "block" comes after "allow"
        ruled = _by_expression(rows, rules) if len(rules) <= MOST_RULES else _by_join(rows, pages.sparkSession.createDataFrame(rules, "what string, rule_host string, rule_path string"))
    verdict = F.coalesce("what", F.when((F.size("strict_terms") > 0) | (F.col("weight") >= soft_hits), "block").otherwise("allow"))
    return ruled.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "strict_terms", "soft_terms")
