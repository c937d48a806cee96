"""URL verdicts: a blocked Bloom filter passes possible hits to an exact hash join.

The list has two kinds of entries, both canonical (scheme, query and fragment
dropped, host lower-cased): rules of a host and a path prefix with a verdict, which
hold for the host and all its subdomains, and single listed URLs, which are
blocked.  Every URL is expanded to the keys that could fit: each suffix of its
host with each prefix of its path that has the length of some rule, and its own
canonical form.  The filter holds all listed keys in a fixed size and drops nearly
all expanded keys without a shuffle; the keys it lets through meet the list in a
hash join, which removes the false positives.  The longest rule wins; without a
rule the listed URL decides; without that the URL is allowed.

URLs are judged once per distinct host and path, so a URL that fills a third of
the table is one row of the join; verdicts go back to the rows by a join that the
adaptive planner may split.

Defined cases: a NULL url, or one without ``://``, has an empty host and path, no
rule, and is allowed; an empty list allows everything; entries with a NULL host or
path are ignored; of equal rules ``block`` wins; repeated rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm import bloom
from weekpanel.llm.text import ascii_lower
from weekpanel.session import materialize

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """A listed URL's key; ``=`` keeps it apart from the rules' keys."""
    return F.concat(F.lit("="), host, F.regexp_replace(path, "/+$", ""))


def _listed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``(key, rule, verdict)``, one row per key."""
    by_rule = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        F.concat(ascii_lower(F.col("host")), F.col("path")).alias("key"), "verdict"
    ).groupBy("key").agg(F.max("verdict").alias("verdict")).select("key", F.col("key").alias("rule"), "verdict")
    single = urls.filter("url IS NOT NULL").select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key"))
    single = single.filter("key <> '='").distinct().select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    return by_rule.union(single)


def judge_urls(pages: DataFrame, rules: DataFrame, urls: DataFrame, url_col: str = "url", blocks: int = bloom.BLOCKS) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (columns of these names are
    replaced); ``rules`` has ``host, path, verdict`` and ``urls`` has ``url``."""
    listed = materialize(_listed(rules, urls), "listed")
    lengths = [r[0] for r in listed.filter("rule IS NOT NULL").select(F.length(F.regexp_replace("rule", "^[^/]*", "")).alias("n")).distinct().collect()]
    seen = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]).cast("array<string>")
    fitting = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(h, p))))
    keys = F.array_union(fitting, F.array(canonical(F.col("host"), F.col("path"))))
    expanded = seen.filter("host <> ''").select("host", "path", F.explode(keys).alias("key"))
    passed = expanded.filter(bloom.maybe_listed(pages, bloom.build(listed, "key", blocks), F.col("key")))
    order = F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("n"), F.col("rule"), F.col("verdict"))
    hits = passed.join(listed, "key").groupBy(F.col("host").alias("url_filter_h"), F.col("path").alias("url_filter_p")).agg(F.max(order).alias("url_filter_b"))
    parted = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    joined = parted.join(hits, (F.col("host") == F.col("url_filter_h")) & (F.col("path") == F.col("url_filter_p")), "left")
    best = F.col("url_filter_b")
    judged = joined.withColumns({"rule": best["rule"], "verdict": F.coalesce(best["verdict"], F.lit("allow"))})
    return judged.drop("url_filter_h", "url_filter_p", "url_filter_b")
