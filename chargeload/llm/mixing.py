"""Source mixing to target weights over a domain - language - source tree.

A token budget flows down the tree. Under each node it is shared by weight; a child that
has fewer tokens (times `max_epochs`) than its share gives what it has, and its siblings share the
rest by weight. Only what all siblings together lack is missed by the parent, and so goes to the
parent's siblings. Each level's shares come from window sums over the siblings in the
order of tokens per weight: a child is exhausted if, with all children before it exhausted, its
share is not below what it has. The rest is divided without rounding loss.

A leaf (source) takes whole seeded epochs of its documents, then the prefix of one more until
its tokens are reached: documents in the order of md5(seed|epoch|doc_id), up to and with the one that
crosses the budget. The prefix sums run in two steps, over 4,096 hash ranges of each leaf and then
inside a range, so that no task sorts a whole leaf.

Defined cases: null domain, language or source is a node of its own named ''; blank texts have no tokens and are
never selected; rows of one id in one leaf are selected together; weights are positive integers,
unlisted nodes weigh 1. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, without

LEVELS = ("domain", "lang", "source")
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "es": 2, "fr": 2},
    "source": {},
}
MAX_EPOCHS = 2
SEED = 11


def source_domain(source: str = "source") -> Column:
    """Domain of a source: its number modulo four, 'other' without one."""
    number = f"right(regexp_extract(coalesce(`{source}`, ''), '([0-9]+)$', 1), 18)"
    return F.expr(f"CASE WHEN {number} = '' THEN 'other' ELSE concat('d', cast(cast({number} AS bigint) % 4 AS string)) END")


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("bigint")


def share(children: DataFrame, parents: list[str], node: str) -> DataFrame:
    """Adds `granted`: the part of `budget` (the parent's) that each child (with `weight`, `capacity`) gets."""
    by = Window.partitionBy(*parents)
    order = by.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(node).asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = children.withColumn("_taken", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("bigint"))
    df = df.withColumn("_weights", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    df = df.withColumn("_full", big("capacity") * big("_weights") <= big("weight") * (F.col("budget") - F.col("_taken")).cast("decimal(19,0)"))
    df = df.withColumn("_left", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(by))
    df = df.withColumn("_open", F.when(F.col("_full"), 0).otherwise(F.col("weight")))
    df = df.withColumn("_all", F.sum("_open").over(by)).withColumn("_upto", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = lambda c: F.expr(f"(cast(_left as decimal(19,0)) * cast({c} as decimal(19,0))) div cast(_all as decimal(19,0))")
    df = df.withColumn("granted", F.when(F.col("_full"), F.col("capacity")).otherwise(part("_upto") - part("(_upto - _open)")).cast("bigint"))
    return df.drop("_taken", "_weights", "_full", "_left", "_open", "_all", "_upto")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int = MAX_EPOCHS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """(domain, lang, source, tokens, granted) of every leaf with tokens; `budget` is an expression over `total`, the tokens of all leaves."""
    domain, lang, source = LEVELS
    leaves = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    langs = leaves.groupBy(domain, lang).agg(F.sum("capacity").alias("capacity"))
    domains = leaves.groupBy(domain).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    root = domains.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0)))).withColumn("_cap", F.sum("capacity").over(Window.partitionBy(F.lit(0))))
    root = root.withColumn("budget", F.least(budget.cast("bigint"), F.col("_cap"))).withColumn("weight", weight_of(domain, weights)).withColumn("_root", F.lit(0))
    top = share(root, ["_root"], domain).select(domain, F.col("granted").alias("budget"))
    middle = share(langs.join(top, domain).withColumn("weight", weight_of(lang, weights)), [domain], lang).select(domain, lang, F.col("granted").alias("budget"))
    return share(leaves.join(middle, [domain, lang]).withColumn("weight", weight_of(source, weights)), [domain, lang], source).select(*LEVELS, "tokens", "granted")


def select_epochs(docs: DataFrame, budget: Column | None = None, domain: Column | None = None, max_epochs: int = MAX_EPOCHS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per selected document and epoch of `docs` (doc_id, text, lang, source): doc_id, domain, lang, source, n_tokens, epoch (from 0)."""
    names = {f: F.coalesce(c, F.lit("")) for f, c in (("domain", source_domain() if domain is None else domain), ("lang", F.col("lang")), ("source", F.col("source")))}
    items = docs.select("doc_id", *[c.alias(n) for n, c in names.items()], F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens")).where("n_tokens > 0")
    items = staged(items, "mixing-items")  # texts are read once; the leaves' sums and the selection read this
    leaves = items.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    granted = leaf_budgets(leaves, F.expr("total div 5 * 4") if budget is None else budget, max_epochs, weights)
    granted = granted.select(*LEVELS, F.expr("granted div tokens").alias("whole"), F.expr("granted % tokens").alias("rest"))
    items = items.join(granted, list(LEVELS))
    items = items.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))).withColumn("_range", F.substring("_key", 1, 3))
    ranges = items.groupBy(*LEVELS, "_range").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*LEVELS, "_range", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*LEVELS, "_range")
    upto = F.sum("n_tokens").over(inside.orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "_range", "_key"))
    items = items.join(ranges, [*LEVELS, "_range"]).withColumn("_before", F.col("_base") + upto - peers)
    items = items.withColumn("_copies", F.col("whole") + F.when(F.col("_before") < F.col("rest"), 1).otherwise(0)).where("_copies > 0")
    return items.select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0), F.col("_copies").cast("int") - 1)).alias("epoch"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The selected rows of `docs`, each as often as its epochs take it; rows that share an id and a leaf go together."""
    chosen = select_epochs(docs, **options).select("doc_id", F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("epoch").alias("_epoch")).distinct()
    keyed = without(docs, "_lang", "_source", "_epoch")
    on = keyed["doc_id"].eqNullSafe(chosen["doc_id"]) & (F.coalesce(keyed["lang"], F.lit("")) == chosen["_lang"]) & (F.coalesce(keyed["source"], F.lit("")) == chosen["_source"])
    # a row without words is never selected, even where it shares an id with one that is
    with_words = F.regexp_count(F.coalesce(keyed["text"], F.lit("")), F.lit(WORD)) > 0
    return keyed.where(with_words).join(chosen, on).select(*[keyed[c] for c in keyed.columns])
