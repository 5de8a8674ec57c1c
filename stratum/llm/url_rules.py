"""Operator 3: URL filter by mined association rules (DataFrame functions and MLlib only).

A URL becomes a set of tokens: host suffixes and labels, path segments, extension, query
keys and whether it has a fragment; numbers are one token, so that no token names a single
page. FP-growth mines token combinations of the labelled pages together with their class;
rules "tokens -> block" of any length stay that reach the least support and confidence and
are not implied by a shorter rule. A rule is filed under its rarest token (an inverted
index), so a URL meets a rule only through that token, and then has its token set compared.
Longer rules find the shorter ones that imply them in the same way.

Fixed allow and block rules on host and path come first; the longest wins. Rules are mined on
pages that no fixed rule decides, which are those that mined rules judge.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import read_table, stage

#: Fixed rules (host, path, verdict): values of the query's contract.
FIXED_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
               ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
#: Rules that are handed to every task at most; beyond, they are dealt out like the pages.
BROADCAST_RULES = 100_000
CLASS = "class:block"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lowered), path, and what follows the path; all empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.translate(host, upper, upper.lower()), path,
            F.substring(after, F.length(path) + 1, F.length(after)))


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, tail: Column) -> Column:
    """The distinct tokens of a URL."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = F.concat(F.lit("host:"), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."))
    general = lambda s: F.regexp_replace(s, r"[0-9]+", "9")
    segments = F.filter(F.split(general(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")), "/"), lambda s: s != "")
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    query = F.regexp_extract(tail, r"^\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda s: F.concat(F.lit("key:"), general(F.regexp_extract(s, r"^([^=]*)", 1))))
    one = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        one(host != "", suffix),
        F.transform(F.filter(labels, lambda s: s != ""), lambda s: F.concat(F.lit("label:"), s)),
        F.transform(segments, lambda s: F.concat(F.lit("path:"), s)),
        one(ext != "", F.concat(F.lit("ext:"), ext)),
        F.when(query != "", keys).otherwise(F.array().cast("array<string>")),
        one(F.contains(tail, F.lit("#")), F.lit("fragment"))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Block rules from (tokens, bad): ``rule_id, tokens, confidence, support``.

    The least support is a share, so the number of frequent tokens is at most the tokens of
    a URL divided by it, whatever the number of pages.
    """
    items = F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(CLASS)))).otherwise(F.col("tokens"))
    baskets = stage(labelled.select(items.alias("items")).where(F.size("items") > 0))
    parts = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence,
                     numPartitions=parts).fit(baskets)
    rules = stage(model.associationRules.where(F.col("consequent") == F.array(F.lit(CLASS))).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    rules = rules.withColumn("rule_id", F.array_join("tokens", " & "))
    # a rule of which some tokens are a rule already adds nothing
    met = _met(rules.select(F.col("rule_id").alias("row"), "tokens"), rules)
    return rules.join(met.where("size(need) < size(tokens)").select(F.col("row").alias("rule_id")), "rule_id", "left_anti")


def _met(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``row, tokens, rule_id, confidence, need`` of the rules all of whose tokens a row has.

    A rule is filed under the token that fewest rows have, and rows find it there. Only the
    rules' side is handed out, where there are few enough of them."""
    spread = rows.select("row", "tokens", F.explode("tokens").alias("token"))
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    # how often the rules' tokens stand in the rows: one row per such token
    seen = spread.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = stage(rules.select("rule_id", "confidence", F.col("tokens").alias("need"), F.explode("tokens").alias("token"))
                  .join(seen, "token")
                  .groupBy("rule_id", "confidence", "need").agg(F.min_by("token", F.struct("n", "token")).alias("token")))
    filed = F.broadcast(filed) if filed.count() <= BROADCAST_RULES else filed.hint("merge")
    return spread.join(filed, "token").where(F.size(F.array_except("need", "tokens")) == 0)


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``row, method_rule, confidence``: each URL's strongest matching rule, through the inverted index."""
    hit = _met(urls, rules)
    return hit.groupBy("row").agg(F.max(F.struct("confidence", "rule_id")).alias("best")).select(
        "row", F.col("best.rule_id").alias("method_rule"), F.col("best.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
               doc_of: str | None = None, fixed=FIXED_RULES, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, method_rule``.

    A page is labelled by the row of ``labels`` whose ``doc_id`` is its document: the SQL
    expression ``doc_of`` over page_id, host and path, by default the page's id. It is bad
    when the quality is 0 or it is toxic (any of several rows says so). Without a fixed rule
    the verdict is block when a mined rule matches, else allow.

    Defined cases: a null url or one without ``://`` has empty host and path, no rule and
    no tokens, so it is allowed; null ids and null labels label nothing; repeated rows are
    judged each; without labelled pages there are no mined rules; an empty table gives an
    empty result; further columns are ignored.
    """
    host, path, tail = url_parts(pages[url_col])
    urls = pages.select(F.monotonically_increasing_id().alias("row"), pages[id_col].alias("page_id"),
                        host.alias("host"), path.alias("path"), tail.alias("tail"))
    urls = stage(urls.withColumns({"tokens": tokens(F.col("host"), F.col("path"), F.col("tail")),
                                   "fixed": fixed_rule(F.col("host"), F.col("path"), fixed)}).drop("tail"))
    bad = F.max((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    marks = (labels.where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(bad.alias("bad")))
    # labels and hits grow with the pages, so neither is handed out whole
    open_ones = urls.where("fixed is null").select("tokens", F.expr(doc_of or "page_id").alias("doc_id"))
    labelled = open_ones.join(marks.hint("merge"), "doc_id")
    rules = stage(mine_rules(labelled.select("tokens", "bad"), min_support, min_confidence))
    return urls.join(matches(urls, rules).hint("merge"), "row", "left").select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), F.when(F.col("method_rule").isNotNull(), "block").otherwise("allow"))
        .alias("verdict"), "method_rule")


#: The pages' urls hold the number of the document they show.
DOC_IN_PATH = r"try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)"


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"), doc_of=DOC_IN_PATH)
