"""Learned decision lists over text statistics, as ordered Spark conditional expressions.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the labelled rows until it
covers no good text, pruned on the last third, and accepted if it is precise there; the rows it covers leave the
set and the next rule is learned. Each step is one aggregate over binned statistics; the driver sees only counts
per (statistic, bin, label).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import SPACE, read_table, text_of
from tremorframe.session import durable

#: Statistics that the rules may test. A rule names them.
RATIOS = ("mean_word_chars", "symbol_share", "mark_share", "upper_share", "pipe_share", "dup_line_share", "repeat_share", "n_words")


@dataclass(frozen=True)
class Learning:
    """Size of the model and of its candidate search; none of these limits the rows."""

    bins: int = 48           #: candidate thresholds per statistic
    max_conditions: int = 4  #: per rule
    max_rules: int = 12
    min_precision: float = 0.9  #: on the pruning rows
    min_cover: int = 3          #: rows of the class on the pruning rows


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    bin: int
    threshold: float

    def on_values(self) -> Column:
        return F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold

    def on_bins(self) -> Column:
        b = F.col(f"b_{self.name}")
        return b > self.bin if self.above else b <= self.bin


def word_array(text: Column) -> Column:
    """Maximal runs of other characters than white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that the text has twice or more.

    Windows are 64-bit hashes; equal neighbours after a sort are repeats, and the sorted starts of the repeated
    windows give the size of their union. Texts without a repeat skip the sort.
    """
    keys = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def starts(k: Column) -> Column:
        ordered = F.sort_array(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.transform(F.array(ordered), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: (
            F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))),
            lambda x: x["i"])))[0]

    def union(p: Column) -> Column:
        widths = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(k: Column) -> Column:
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")) \
            .otherwise(F.transform(F.array(starts(k)), union)[0])

    return F.transform(F.array(keys), counted)[0]


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id`` and the counts of the whole text.

    A null text counts as empty. Repeated rows are counted each by itself. Other columns are ignored.
    """
    base = docs.select("doc_id", text_of().alias("t")).withColumn("w", word_array(F.col("t")))
    points = F.char_length("t")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = base.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (points - F.char_length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0].alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        (points - F.char_length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (points - F.char_length(F.replace(F.col("t"), F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        (points - F.char_length(F.replace(F.col("t"), F.lit("|"), F.lit("")))).cast("long").alias("n_pipes"),
        F.size(lines).cast("long").alias("n_lines"))
    return out


def with_ratios(stats: DataFrame) -> DataFrame:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return stats.withColumns({
        "mean_word_chars": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "mark_share": share("n_marks", "word_chars"), "upper_share": share("n_upper", "word_chars"),
        "pipe_share": share("n_pipes", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words")})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _all(conditions: list[Condition], bins: bool = False) -> Column:
    return reduce(lambda a, b: a & b, [c.on_bins() if bins else c.on_values() for c in conditions], F.lit(True))


def _bin(name: str, cuts: list) -> Column:
    """How many cuts lie below the value; bin > j is the same as value > cut j."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c < F.col(name)))


def learn_rules(stats: DataFrame, labels: DataFrame, how: Learning = Learning()) -> list[list[Condition]]:
    """Rules for the rejected class, in order.

    ``labels``: ``doc_id, quality`` (1 good, 0 bad); rows with a null id or label teach nothing, repeated labels of
    one id count once, as bad if any says so. Without bad rows there are no rules.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # a third of the rows, by a hash of the id, is for pruning
    train = durable(with_ratios(stats).filter(~base_failed()).join(marks, "doc_id").select(
        *RATIOS, (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("prune")))
    asked = [i / (how.bins + 1) for i in range(how.bins + 2)]
    # bad texts are the minority: their own quantiles bring the cuts to where they are
    cuts_of = train.agg(*[F.percentile_approx(n, asked, 10_000).alias(n) for n in RATIOS],
                        *[F.percentile_approx(F.when(F.col("bad"), F.col(n)), asked, 10_000).alias(f"bad_{n}") for n in RATIOS]).first()
    seen = {n: sorted({*(cuts_of[n] or ()), *(cuts_of[f"bad_{n}"] or ())}) for n in RATIOS}
    # halfway between values: a gap between good and bad texts is cut in its middle
    cuts = {n: [(a + b) / 2 for a, b in zip(v, v[1:])] for n, v in seen.items()}
    binned = [_bin(n, cuts[n]).alias(f"b_{n}") for n in RATIOS]
    cells = durable(train.select("bad", "prune", *binned).groupBy("bad", "prune", *[f"b_{n}" for n in RATIOS])
                    .agg(F.count("*").alias("n")))

    rules: list[list[Condition]] = []
    left = cells
    while len(rules) < how.max_rules:
        rule = _grow(left.filter("NOT prune"), cuts, how)
        rule, precise = _prune(left.filter("prune"), rule, how)
        if not precise:
            break
        rules.append(rule)
        left = left.filter(~_all(rule, bins=True))
    return rules


def _grow(rows: DataFrame, cuts: dict, how: Learning) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < how.max_conditions:
        counts = rows.filter(_all(rule, bins=True)).select("bad", "n", F.posexplode(F.array(*[f"b_{n}" for n in RATIOS])).alias("f", "b")) \
            .groupBy("f", "b", "bad").agg(F.sum("n").alias("n")).collect()  # statistics x bins x 2
        total = [sum(r.n for r in counts if r.f == 0 and r.bad == bad) for bad in (True, False)]
        if not total[0] or not total[1]:
            break
        now, best = math.log2(total[0] / sum(total)), (0.0, None)
        for f, name in enumerate(RATIOS):
            below = [[0, 0] for _ in range(len(cuts[name]) + 1)]
            for r in counts:
                if r.f == f:
                    below[r.b][0 if r.bad else 1] += r.n
            p = n = 0
            for b, threshold in enumerate(cuts[name]):
                p, n = p + below[b][0], n + below[b][1]
                for above, (bad, good) in ((False, (p, n)), (True, (total[0] - p, total[1] - n))):
                    if bad:
                        gain = bad * (math.log2(bad / (bad + good)) - now)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, b, threshold))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: list[Condition], how: Learning) -> tuple[list[Condition], bool]:
    """The prefix of the rule that does best on the pruning rows, and whether it may enter the list."""
    if not rule:
        return rule, False
    sums = []
    for k in range(1, len(rule) + 1):
        holds = _all(rule[:k], bins=True)
        sums += [F.sum(F.when(holds & F.col("bad"), F.col("n")).otherwise(0)).alias(f"p{k}"),
                 F.sum(F.when(holds & ~F.col("bad"), F.col("n")).otherwise(0)).alias(f"n{k}")]
    got = rows.agg(*sums).first()
    scored = [((p - n) / (p + n) if p + n else -1.0, -k, p, n)
              for k in range(1, len(rule) + 1) for p, n in [(got[f"p{k}"] or 0, got[f"n{k}"] or 0)]]
    _, k, p, n = max(scored)
    return rule[:-k], p >= how.min_cover and p >= how.min_precision * (p + n)


def verdict(rules: list[list[Condition]]) -> tuple[Column, Column]:
    """(kept, rule number or null): the first rule that holds rejects."""
    kept, number = F.lit(True), F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        kept, number = F.when(_all(rule), F.lit(False)).otherwise(kept), F.when(_all(rule), F.lit(i)).otherwise(number)
    return kept, number


def quality_rules(docs: DataFrame, labels: DataFrame, how: Learning = Learning()) -> DataFrame:
    """One row per input row: statistics, ``base_failed``, ``rule`` (number of the rejecting rule) and ``kept``.

    Null and empty texts have no words and fail the base rule. An empty table gives an empty result.
    """
    stats = durable(text_statistics(docs))
    kept, number = verdict(learn_rules(stats, labels, how))
    return with_ratios(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        F.when(base_failed(), False).otherwise(kept).alias("kept"), F.when(~base_failed(), number).alias("rule"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
