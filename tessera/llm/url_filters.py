"""URL filters: fixed host and path rules, then association rules that FP-growth mines from labelled pages.

A URL becomes a set of tokens (host labels with their level, path words, file extension, query keys). Labelled pages are
transactions of their tokens and a class item. FP-growth finds the frequent sets; rules `tokens -> class` are pruned by
support, confidence and lift, and a rule goes if a part of its tokens already gives its class as surely. Matching uses an
inverted index: each rule is posted under its rarest token and only compared with URLs that hold that token.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, arrow_column, bound_batches, checkpointed

#: Mining parameters. A transaction holds all tokens of its page; a token, set or rule must hold for MIN_PAGES labelled
#: pages, a number and not a share, so that rare hosts can have rules. Rules are fitted on all labelled pages up to about
#: MAX_LABELLED, beyond that on so many chosen by a hash of their ids; every page is judged.
MIN_PAGES = 20
MAX_LABELLED = 2_000_000
#: By class, since most pages are good: least share of the class among the pages of a rule, and least ratio to its share
#: among all labelled pages.
MIN_CONFIDENCE = {"block": 0.6, "allow": 0.8}
MIN_LIFT = {"block": 1.5, "allow": 1.1}

BLOCK, ALLOW = "!block", "!allow"

# Fixed values: (rule, verdict). A rule fits its host and all subdomains, if the path starts with the rule's path.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end; the path then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`url`"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return host, path


def fixed_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest fixed rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        name, slash, below = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & F.startswith(path, F.lit(slash + below))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: ``h0:com``, ``h1:example`` from the right of the host, path words, extension and query keys."""
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.filter(F.split(ascii_lower(path), r"[/._\-]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    keys = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "[&;]"), lambda x: x != "")
    tokens = F.concat(
        F.filter(hosts, lambda x: ~x.endswith(":")),
        F.transform(words, lambda x: F.concat(F.lit("p:"), x)),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), F.split_part(x, F.lit("="), F.lit(1)))),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>")))


def parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    return rows.withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("url")))


class RuleIndex:
    """Rules posted under their rarest token; the surest matching rule decides."""

    def __init__(self, rules: list[tuple[list[str], str, float, float]]) -> None:
        #: (tokens, verdict, confidence, support)
        self.rules = rules
        often: dict[str, int] = defaultdict(int)
        for tokens, *_ in rules:
            for t in tokens:
                often[t] += 1
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, (tokens, *_) in enumerate(rules):
            self.postings[min(tokens, key=lambda t: (often[t], t))].append(i)

    def match(self, tokens: list[str]) -> tuple[str, float] | None:
        held = set(tokens)
        found = [self.rules[i] for t in held for i in self.postings.get(t, ()) if held.issuperset(self.rules[i][0])]
        if not found:
            return None
        # A tie between equally sure rules goes to the one with more support, then to block, then by tokens.
        _, verdict, confidence, _ = max(found, key=lambda r: (r[2], r[3], r[1] == "block", r[0]))
        return verdict, confidence


def prune(rules: list[tuple[list[str], str, float, float]]) -> list[tuple[list[str], str, float, float]]:
    """Drops a rule if a proper part of its tokens gives the same verdict with at least its confidence."""
    best: dict[tuple[frozenset[str], str], float] = {(frozenset(t), v): c for t, v, c, _ in rules}
    by_size = sorted(rules, key=lambda r: (len(r[0]), r[0]))
    kept: list[tuple[list[str], str, float, float]] = []
    strongest: dict[tuple[frozenset[str], str], float] = {}
    for tokens, verdict, confidence, support in by_size:
        parts = [frozenset(tokens) - {t} for t in tokens]
        below = max((strongest.get((p, verdict), 0.0) for p in parts), default=0.0)
        strongest[frozenset(tokens), verdict] = max(below, best[frozenset(tokens), verdict])
        if confidence > below:
            kept.append((sorted(tokens), verdict, confidence, support))
    return kept


def labelled(tagged: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens and bad (low quality or toxic) of the pages that have labels, joined by number: labels.doc_id is the page.

    A page with several labels counts as bad if any label says so; null labels say nothing.
    """
    said = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    said = said.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    return tagged.join(said, "page_id").select("page_id", "tokens", "bad")


def mine_rules(tagged: DataFrame, labels: DataFrame, min_pages: int = MIN_PAGES, max_labelled: int = MAX_LABELLED) -> list[tuple[list[str], str, float, float]]:
    """(tokens, verdict, confidence, support) of the pruned rules."""
    pages = labelled(tagged, labels)
    n, bad = pages.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if n > max_labelled:
        pages = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
        n, bad = pages.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    item = F.array(F.when(F.col("bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_pages / max(n, 1))).fit(pages.select(F.concat("tokens", item).alias("items")))
    sets = checkpointed(model.freqItemsets.filter(F.col("freq") >= min_pages))
    rules: list[tuple[list[str], str, float, float]] = []
    for mark, verdict, share in ((BLOCK, "block", bad / max(n, 1)), (ALLOW, "allow", 1 - bad / max(n, 1))):
        # A rule's tokens are a frequent set too, as they hold for all of its pages.
        of_class = sets.filter(F.array_contains("items", mark) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", mark)).alias("tokens"), F.col("freq").alias("both"))
        met = of_class.join(sets.select(F.array_sort("items").alias("tokens"), "freq"), "tokens").withColumn("confidence", F.col("both") / F.col("freq"))
        sure = met.filter((F.col("confidence") >= MIN_CONFIDENCE[verdict]) & (F.col("confidence") >= MIN_LIFT[verdict] * share))
        rules += [(r["tokens"], verdict, r["confidence"], r["both"] / n) for r in sure.collect()]
    return prune(rules)


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Iterable[tuple[str, str]] = tuple(RULES), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and confidence for every page.

    ``rule`` is the longest fixed rule that fits, else null; ``verdict`` is that rule's, else that of the surest mined
    rule, else allow. A null URL or one without ``://`` has an empty host and path and is judged by its tokens (none:
    allow). Repeated rows and ids keep a row each; without labels nothing is mined; an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession, 10_000)
    rules = list(rules)
    tagged = parsed(pages, id_col, url_col)
    index = RuleIndex(mine_rules(tagged, labels))
    kind = pa.struct([("verdict", pa.string()), ("confidence", pa.float64())])

    def match(tokens: pa.Array) -> pa.Array:
        found = [index.match(t) for t in tokens.to_pylist()]
        return pa.array([None if f is None else {"verdict": f[0], "confidence": f[1]} for f in found], kind)

    if index.rules:
        mined = arrow_column(match, "verdict string, confidence double", F.col("tokens"))
    else:
        mined = F.lit(None).cast("struct<verdict:string,confidence:double>")
    judged = tagged.select("page_id", "host", "path", fixed_rule(F.col("host"), F.col("path"), rules).alias("rule"), mined.alias("mined"))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.col("mined.verdict"), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("mined.confidence").alias("confidence"))
