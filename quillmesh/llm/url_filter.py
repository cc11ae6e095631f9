"""URL filters by association rules.

Given rules (host and path, allow or block) come first; the longest that fits
decides. Any other URL is judged by mined rules: Spark's FP-growth finds
combinations of URL tokens (host labels, path words, query keys) that go with the label
of the labelled URLs. Rules are pruned by support, by confidence and by each other:

- a rule's confidence must be ``min_confidence``, and above the share that its label has
  anyway by ``min_lift`` and by ``sureness`` standard errors (Wilson's lower bound): among thousands
  of combinations some are pure by chance, and a label that most URLs have is no rule;
- a rule whose tokens include those of a rule of its label at least as strong is redundant;
- an allowing rule is kept only if it is stronger than the weakest blocking rule: without
  one to overrule it changes no verdict.

A rule's strength is the lower bound of its confidence over its label's share. A URL is
blocked if the strongest rule that fires blocks (ties: allows); without any it is allowed.
Labels that URLs say nothing about therefore give no rules, and all is allowed.

Rules are matched by an inverted index: each rule is listed under its rarest token
only, URLs' tokens are joined with it, and a rule fires if the URL has all its tokens.

Scale: labelled URLs are counted by FP-growth (distributed by item groups); rules are
written once. URLs are judged once per distinct URL; a frequent token is in the index
only if all of a rule's tokens are as frequent, so few rows are made; Spark broadcasts
the index if it is small, and only rules that fire are exchanged.

Nulls: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is allowed. Empty paths fit only rules with an empty path. Repeated rows
give repeated results; extra columns are ignored; an empty table gives no rows, and
labels of one kind, or none, no rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut

#: The given rules, (verdict, rule), a rule being host and path.
GIVEN_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(rest, _PARTS, 2)


def given_rule(host: Column, path: Column, rules=GIVEN_RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Ties of
    length go to the rule that blocks."""
    fitted = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        rule_host, slash, rule_path = rule.partition("/")
        rule_host = rule_host.translate(str.maketrans(_UPPER, _LOWER))
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rule_path))
        fitted = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitted)
    return fitted


def tokens(url: Column, host: Column, path: Column) -> Column:
    """A URL's distinct tokens: host labels, the words of hyphened labels, path words,
    the names of its query keys; runs of digits are one token."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    hyphened = F.filter(F.split(host, r"\."), lambda x: F.contains(x, F.lit("-")))
    words = F.transform(F.flatten(F.transform(hyphened, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("w:"), x))
    parts = F.transform(F.split(path, r"[/.\-_]"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), r"\d+", "0")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.filter(F.concat(labels, words, parts, keys), lambda t: F.length(t) > 2))


RULES = "tokens array<string>, verdict string, confidence double, support double, strength double"


def lower_bound(hits: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share, ``hits`` of ``n``, ``z`` standard errors down."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(
    labelled: DataFrame,
    url_col: str = "url",
    label_col: str = "bad",
    min_support: float = 0.005,
    min_confidence: float = 0.7,
    min_lift: float = 1.2,
    sureness: float = 4.0,
    max_tokens: int | None = None,
) -> DataFrame:
    """(tokens, verdict, confidence, support, strength): rules of any length (or of up to
    ``max_tokens`` tokens), pruned; ``label_col`` true means block. Rows with null url or label are left out."""
    host, path = host_and_path(F.col(url_col))
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    label = F.when(F.col(label_col).cast("boolean"), "=block").otherwise("=allow")
    baskets = cut(rows.select(F.concat(tokens(F.col(url_col), host, path), F.array(label)).alias("items")))
    shares = {r.label[1:]: r["count"] for r in baskets.select(F.element_at("items", -1).alias("label")).groupBy("label").count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return labelled.sparkSession.createDataFrame([], RULES)
    mined = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    rules = mined.where(F.element_at("consequent", 1).isin("=block", "=allow")).where(~F.exists("antecedent", lambda t: F.startswith(t, F.lit("="))))
    if max_tokens is not None:
        rules = rules.where(F.size("antecedent") <= max_tokens)
    verdict = F.substring(F.element_at("consequent", 1), 2, 5)
    share = F.when(verdict == "block", shares["block"] / total).otherwise(shares["allow"] / total)
    hits = F.col("support") * total
    bound = lower_bound(hits, hits / F.col("confidence"), sureness)
    rules = rules.where((F.col("confidence") >= min_lift * share) & (bound > share)).select(
        F.array_sort("antecedent").alias("tokens"), verdict.alias("verdict"), "confidence", "support", (bound / share).alias("strength")
    )
    rules = cut(rules)
    # a rule is redundant if some of its tokens give a rule at least as strong: the
    # parts are looked for through one of their tokens, among rules and not subsets
    longer = rules.select("tokens", "verdict", "strength", F.explode("tokens").alias("token"))
    part = rules.select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("strength").alias("c"))
    found = longer.join(part, (F.col("token") == F.element_at("part", 1)) & (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("strength")))
    whole = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
    rules = rules.join(found.where(whole).select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    weakest = rules.where("verdict = 'block'").agg(F.min("strength").alias("weakest"))
    return cut(rules.join(F.broadcast(weakest)).where((F.col("verdict") == "block") | (F.col("strength") >= F.col("weakest"))).drop("weakest"))


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, verdict) of the distinct URLs for which a rule fires."""
    distinct = urls.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    if rules.isEmpty():
        return distinct.limit(0).withColumn("verdict", F.lit("allow"))
    host, path = host_and_path(F.col("url"))
    own = distinct.select("url", tokens(F.col("url"), host, path).alias("own"))
    # how many URLs have each of the rules' tokens; each rule goes under its rarest
    named = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = own.select(F.explode("own").alias("token")).join(named, "token", "left_semi").groupBy("token").count()
    listed = rules.select("tokens", "verdict", "strength", F.explode("tokens").alias("token")).join(counts, "token")
    index = cut(
        listed.groupBy("tokens", "verdict", "strength").agg(F.min(F.struct("count", "token")).alias("rarest"), F.count(F.lit(1)).alias("met"))
        .where(F.col("met") == F.size("tokens"))
        .select(F.col("rarest.token").alias("token"), "tokens", "verdict", "strength")
    )
    met = own.select("url", "own", F.explode("own").alias("token")).join(index, "token")
    fired = met.where(F.size(F.array_except("tokens", "own")) == 0)
    sure = fired.groupBy("url").agg(
        F.max(F.when(F.col("verdict") == "block", F.col("strength"))).alias("block"),
        F.max(F.when(F.col("verdict") == "allow", F.col("strength"))).alias("allow"),
    )
    verdict = F.when(F.col("block") > F.coalesce("allow", F.lit(0.0)), "block").otherwise("allow")
    return sure.select("url", verdict.alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", given=GIVEN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, method) of every row; method: given,
    mined or default."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), given))
    fired = match_rules(rows.where("given IS NULL"), rules, "_url").select(F.col("url").alias("_u"), F.col("verdict").alias("mined"))
    joined = rows.join(fired, F.col("given").isNull() & (F.col("_url") == F.col("_u")), "left")
    method = F.when(F.col("given").isNotNull(), "given").when(F.col("mined").isNotNull(), "mined").otherwise("default")
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "mined", F.lit("allow")).alias("verdict"),
        method.alias("method"),
    )
