"""Quality rules: base rules, and a learned decision list as an ordered Spark conditional.

Statistics of every whole text are DataFrame expressions. The decision list is learned from labelled texts by
sequential covering: a rule is a conjunction of thresholds, grown one condition at a time by
information gain on the texts that no rule covers yet, then pruned from its end on a third of the labels kept aside. A
rule is kept if its precision on both parts reaches `precision`. The rules become one `CASE WHEN`.

Learning reads at most `train_rows` labelled texts (those with the least hashes of their ids); Spark reduces them to
counts by cell of the threshold grid, and only those counts reach the driver. Everything else covers all rows.

Defined cases: null and blank texts have no words and fail the base rules; rows without a label teach nothing;
without labels of both kinds there are no rules and the base rules decide alone; repeated rows
are judged alike.
"""

from __future__ import annotations

from collections import Counter
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged, without

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
TRAIN_ROWS = 4000
PRECISION = 0.95
MIN_COVER = 12
MAX_RULES, MAX_CONDITIONS = 12, 3
# Fixed grid of thresholds of the learned statistics (shares are per cent).
GRID: dict[str, tuple[float, ...]] = {
    "n_words": (15, 20, 30, 40, 60, 100, 200),
    "mean_word": (2, 3, 3.5, 4, 5, 6, 7, 8, 10, 12),
    "symbol_share": (1, 2, 5, 10, 20, 30, 50, 80),
    "dup_line_share": (5, 10, 20, 30, 40, 50, 60, 80),
    "repeat_share": (1, 2, 5, 10, 15, 20),
    "upper_share": (5, 10, 20, 40, 60, 80),
    "mark_share": (5, 10, 20, 30, 50, 80),
    "end_share": (1, 2, 5, 10, 20, 40, 80),
}


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of `width` words that occur at least twice: windows by hash, sorted next to their equals; runs of
    covered positions are added up. Only texts with a repeat sort positions too."""
    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(pairs, lambda p: F.filter(_equal_neighbours(p), lambda x: x.isNotNull()))
        return let(F.sort_array(at), lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1) - x, F.lit(width)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    def counted(found: Column) -> Column:
        any_twice = let(F.sort_array(found), lambda s: F.exists(F.sequence(F.lit(1), F.size(s)), lambda k: F.get(s, k) == F.get(s, k - 1)))
        return F.when(any_twice, covered(found)).otherwise(F.lit(0).cast("bigint"))

    return F.when(F.size(words) <= width, F.lit(0).cast("bigint")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), counted)))


def _equal_neighbours(pairs: Column) -> Column:
    return F.transform(pairs, lambda e, k: F.when(F.get(pairs, k - 1)["h"].eqNullSafe(e["h"]) | F.get(pairs, k + 1)["h"].eqNullSafe(e["h"]), e["i"]))


def text_statistics(docs: DataFrame) -> DataFrame:
    """`docs` (with a text column) and its statistics: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint), n_lines, n_upper, n_marks, n_ends."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_ends")
    docs = without(docs, *names, "_s")
    text = F.coalesce("text", F.lit(""))
    stats = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: let(
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)),
        lambda lines: F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
            F.regexp_count(text, F.lit("[!?]")).cast("bigint").alias("n_marks"),
            F.regexp_count(text, F.lit("[.]")).cast("bigint").alias("n_ends"),
        )))
    return docs.withColumn("_s", stats).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_s.{n}").alias(n) for n in names])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learned_statistics() -> dict[str, Column]:
    per = lambda a, b: 100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        "symbol_share": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "mark_share": per("n_marks", "n_words"),
        "end_share": per("n_ends", "n_words"),
    }


# ---- sequential covering over cell counts ---------------------------------------------------

Condition = tuple[str, bool, int]  # statistic, True: at or above / False: below, index of the threshold


def _holds(cell: tuple[int, ...], condition: Condition, place: dict[str, int]) -> bool:
    name, above, k = condition
    return (cell[place[name]] > k) == above


def learn_rules(cells: Counter, names: list[str], precision: float = PRECISION) -> list[list[Condition]]:
    """Rules for rejecting, from counts of (cell, bad, kept aside) triples; a cell has for each statistic the number of thresholds at or below it."""
    place = {n: i for i, n in enumerate(names)}
    left = dict(cells)
    rules: list[list[Condition]] = []

    def counts(rows, rule):
        bad = good = 0
        for (cell, is_bad, _), n in rows:
            if all(_holds(cell, c, place) for c in rule):
                bad, good = bad + n * is_bad, good + n * (not is_bad)
        return bad, good

    while len(rules) < MAX_RULES:
        grow = [(k, n) for k, n in left.items() if not k[2]]
        aside = [(k, n) for k, n in left.items() if k[2]]
        rule: list[Condition] = []
        rows = grow
        while len(rule) < MAX_CONDITIONS:
            bad, good = counts(rows, [])
            if not bad or not good:
                break
            best = max(((_gain(counts(rows, [c]), bad, good), c) for c in ((n, up, k) for n in names for k in range(len(GRID[n])) for up in (True, False))), key=lambda x: (x[0], str(x[1])))
            if best[0] <= 0:
                break
            rule.append(best[1])
            rows = [(k, n) for k, n in rows if _holds(k[0], best[1], place)]
        # drop last conditions while the texts kept aside don't get worse for it
        while len(rule) > 1 and _worth(counts(aside, rule[:-1])) >= _worth(counts(aside, rule)):
            rule.pop()
        (bad, good), (aside_bad, aside_good) = counts(grow, rule), counts(aside, rule)
        if not rule or bad < MIN_COVER or bad < precision * (bad + good) or aside_bad < precision * (aside_bad + aside_good) or not aside_bad:
            break
        rules.append(rule)
        left = {k: n for k, n in left.items() if not all(_holds(k[0], c, place) for c in rule)}
    return rules


def _gain(found: tuple[int, int], bad: int, good: int) -> float:
    b, g = found
    return b * (log2(b / (b + g)) - log2(bad / (bad + good))) if b else 0.0


def _worth(found: tuple[int, int]) -> float:
    return (found[0] - found[1]) / (found[0] + found[1]) if sum(found) else -1.0


def rules_column(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; 0 without one."""
    stats, out = learned_statistics(), None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, above, k in rule:
            limit = F.lit(float(GRID[name][k]))
            test = test & ((stats[name] >= limit) if above else (stats[name] < limit))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, precision: float = PRECISION) -> list[list[Condition]]:
    """Decision list from `labels` (doc_id, quality 0 or 1) of `docs`."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows ids; written first, or the optimiser judges all texts before it joins
    texts = staged(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "training-texts")
    stats = learned_statistics()
    cells = [sum((F.when(stats[n] >= F.lit(float(t)), 1).otherwise(0) for t in GRID[n]), F.lit(0)).alias(f"c_{n}") for n in GRID]
    judged = text_statistics(texts).where(~base_failed())
    rows = judged.select((F.col("_quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("aside"), *cells)
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).collect()
    return learn_rules(Counter({(tuple(r[2:-1]), r.bad, r.aside): r.n for r in counted}), list(GRID), precision)


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """`docs` with its statistics, base_failed, rule (the first learned rule that holds, 0: none) and kept."""
    return text_statistics(without(docs, "base_failed", "rule", "kept")).withColumn("base_failed", base_failed()).withColumn("rule", rules_column(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
