"""URL filter: listed rules first, mined association rules for the rest.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased, the path
what follows up to `?`, `#` or the end; NULL URLs and those without `://` have neither. A
listed rule fits its host and all subdomains if the path starts with the rule's; the longest
fitting one decides.

FP-growth mines combinations of URL tokens from labelled URLs: host names, the host's parts, path
segments, file endings and names of query arguments. Combinations that lead to a label with
enough support and confidence, and with more of it than without one of their tokens, become rules. They are
matched through an inverted index by each rule's rarest token. The rule of highest confidence
decides, of equals the one of more tokens, then of higher support, then the first in order; a URL that fits none is
allowed.

NULL and odd URLs have no tokens and are allowed. Without labels there are no mined
rules. Repeated rows are judged alike; an empty table gives an empty result.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from answerloom.llm.linking import small_side
from answerloom.llm.rows import ascii_lower
from answerloom.session import settle

#: The listed rules: verdict, host, path.
LISTED = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.9
VERDICT = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.char_length(host) + 1)
    return ascii_lower(host), F.regexp_extract(after, r"^[^?#]*", 0)


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits; NULL if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, sorted; none for a URL without host."""
    host, path = host_and_path(url)
    part = lambda name: lambda x: F.concat(F.lit(name), x)
    labels = F.split(host, r"\.", -1)
    segments = F.filter(F.split(path, "/", -1), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&", -1), lambda x: F.substring_index(x, "=", 1))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    tokens = F.concat(
        F.array(part("host:")(host)), F.transform(labels, part("part:")),
        F.transform(segments, part("path:")), F.transform(names, part("arg:")), F.array(part("end:")(ending)),
    )
    used = F.filter(tokens, lambda x: ~x.isin("arg:", "end:", "part:"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(used)))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, verdict, confidence, support, anchor) from (tokens, verdict).

    A rule goes if without one of its tokens it leads to the same verdict with at least its
    confidence. The anchor is its rarest token.
    """
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(VERDICT), "verdict")).alias("items"))
    items = settle(items, "transactions")
    kind = "tokens array<string>, verdict string, confidence double, support double, anchor string"
    if items.isEmpty():
        return labelled.sparkSession.createDataFrame([], kind)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    consequent = F.col("consequent")[0]
    found = settle(
        model.associationRules.filter(consequent.startswith(VERDICT)).select(
            F.array_sort("antecedent").alias("tokens"), F.substr(consequent, F.lit(len(VERDICT) + 1)).alias("verdict"),
            "confidence", "support",
        ), "mined",
    )
    singles = settle(
        model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("anchor"), "freq"), "singles"
    )
    # Rules one token shorter: each rule meets those it contains through its own shortened forms.
    shorter = found.select(
        "tokens", "verdict", "confidence", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.filter("tokens", lambda x, k: k != i)
        )).alias("part"),
    )
    known = found.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("less"))
    needless = shorter.join(known, ["part", "verdict"]).filter(F.col("less") >= F.col("confidence")).select(
        "tokens", "verdict"
    ).distinct()
    kept = found.join(needless, ["tokens", "verdict"], "left_anti")
    rarest = (
        kept.select("tokens", F.explode("tokens").alias("anchor")).distinct().join(singles, "anchor")
        .groupBy("tokens").agg(F.min(F.struct("freq", "anchor"))["anchor"].alias("anchor"))
    )
    return settle(kept.join(rarest, "tokens").select("tokens", "verdict", "confidence", "support", "anchor"), "url-rules")


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_key, mined) for each distinct (url_key, tokens) that fits a mined rule."""
    index = rules.select(F.col("anchor"), F.col("tokens").alias("need"), "verdict", "confidence", "support")
    met = urls.select("url_key", "tokens", F.explode("tokens").alias("anchor")).join(small_side(index, 512), "anchor")
    fits = F.size(F.array_except("need", "tokens")) == 0
    order = F.struct("confidence", F.size("need").alias("n"), "support", F.array_join("need", " ").alias("text"), "verdict")
    return met.filter(fits).groupBy("url_key").agg(F.max(order)["verdict"].alias("mined"))


def judge(pages: DataFrame, labelled: DataFrame, listed=LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; `labelled` has (url, verdict) to mine from."""
    host, path = host_and_path(F.col("url"))
    rules = mine_rules(
        labelled.select(url_tokens(F.col("url")).alias("tokens"), "verdict").filter(F.size("tokens") > 0), min_support, min_confidence
    )
    mine = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path")
    ).withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    # The mined rules run on the distinct URLs that no listed rule judges.
    open_urls = mine.filter("listed is null and url is not null").select("url").distinct().select(
        F.col("url").alias("url_key"), url_tokens(F.col("url")).alias("tokens")
    )
    mined = settle(mined_verdicts(open_urls, rules).filter(F.col("mined") != "allow").select("url_key"), "blocked-urls")
    judged = mine.join(mined, F.col("url") == F.col("url_key"), "left")
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("url_key").isNotNull(), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"))


def listed_labels(pages: DataFrame, listed=LISTED) -> DataFrame:
    """(url, verdict) of the pages that listed rules judge."""
    host, path = host_and_path(F.col("url"))
    return pages.select(F.col("url").cast("string").alias("url"), listed_rule(host, path, listed)["verdict"].alias("verdict")).filter(
        "verdict is not null"
    )
