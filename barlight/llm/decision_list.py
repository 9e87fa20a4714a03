"""Quality rules: ordered threshold conjunctions learned by sequential covering, run as one conditional expression.

Text statistics are built-in functions over the whole text. Learning sees the labelled documents' statistics alone, cut
at quantiles: to grow a rule, one aggregate gives for each statistic the labels on either side of each cut, and the
condition with the best information gain is added; a held-back third then prunes the rule's last conditions and
decides whether it stays. Documents that a rule covers leave before the next one is grown. Every count is an aggregate of
all labelled rows; the driver sees one small histogram at a time.

Defined cases: null or empty text has no words and fails the base rule; documents without label, or with a null one, are
not learned from; if only one label occurs no rule is learned and the base rule alone decides; rows with one id and several
labels count once for each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.shared import bind, written
from barlight.llm.url_filter import may_have
from barlight.sources.scratch import cleared

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WIDTH = 5


def repeat_words(codes: Column, width: int = WIDTH) -> Column:
    """codes: an array of word hashes. Words inside windows of `width` words that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(codes) - width), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(width)]))

    def covered(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bind(marked, lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + width).alias("end"), (a["n"] + i + width - F.greatest(i, a["end"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    return F.when(F.size(codes) < width + 1, F.lit(0)).otherwise(bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def base_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the learned rules read."""

    def of_text(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE + "+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
        size = F.length(t)
        without = lambda chars: size - F.length(F.translate(t, chars, ""))
        upper = F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}", ""))
        counted = bind(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda codes: F.struct(F.size(codes).alias("n_words"), F.size(F.array_distinct(codes)).alias("n_distinct"), repeat_words(codes).alias("n_repeat_words")),
        )
        lined = bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
        return F.struct(
            counted.alias("w"),
            lined.alias("l"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
            without(SYMBOLS).alias("n_symbols"),
            without("!?").alias("n_marks"),
            without("0123456789").alias("n_digits"),
            upper.alias("n_upper"),
        )

    return bind(F.coalesce(text, F.lit("")), of_text)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LEARNED = ["n_words", "n_lines", "mean_word", "symbol_share", "mark_share", "digit_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base statistics and those that rules may read (doubles), under names that start with an underscore."""
    s = F.col("_s")
    words = F.greatest(s["w"]["n_words"], F.lit(1))
    share = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    made = {
        "_n_words": s["w"]["n_words"].cast("long"),
        "_word_chars": s["word_chars"].cast("long"),
        "_n_symbols": s["n_symbols"].cast("long"),
        "_n_dup_lines": s["l"]["n_dup_lines"].cast("long"),
        "_n_repeat_words": s["w"]["n_repeat_words"].cast("long"),
        "_n_lines": s["l"]["n_lines"].cast("double"),
        "_mean_word": share(s["word_chars"], words),
        "_symbol_share": share(s["n_symbols"], s["word_chars"]),
        "_mark_share": share(s["n_marks"], s["word_chars"]),
        "_digit_share": share(s["n_digits"], s["word_chars"]),
        "_upper_share": share(s["n_upper"], s["word_chars"]),
        "_dup_line_share": share(s["l"]["n_dup_lines"], s["l"]["n_lines"]),
        "_repeat_share": share(s["w"]["n_repeat_words"], words),
        "_distinct_share": share(s["w"]["n_distinct"], words),
    }
    # A generator of one row: filters on the statistics stay above it, so that they are computed once for each text.
    once = F.explode(F.array(base_statistics(F.col(text).cast("string")))).alias("_s")
    return docs.select("*", once).withColumns(made).drop("_s")


def base_failed() -> Column:
    return (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))


Rule = list[tuple[str, str, float]]  # conditions (statistic, > or <=, cut)


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col("_" + n) > F.lit(c) if op == ">" else F.col("_" + n) <= F.lit(c) for n, op, c in rule], F.lit(True))


def learn(labelled: DataFrame, most_rules: int = 6, most_conditions: int = 3, precision: float = 0.9, cuts: int = 40, least: int = 5) -> list[Rule]:
    """labelled: the statistics, label (1 good, 0 bad) and fold (0 to 2; 2 prunes). Ordered rules for bad documents."""
    shares = [i / cuts for i in range(1, cuts)] + [0.001, 0.005, 0.01, 0.99, 0.995, 0.999]
    names = LEARNED
    found = labelled.agg(*[F.percentile_approx("_" + n, shares, 10_000).alias(n) for n in names]).first()  # 45 numbers a statistic
    at = {n: sorted({float(x) for x in found[n] or []}) for n in names}
    bins = {n: reduce(lambda a, b: a + b, [(F.col("_" + n) > F.lit(c)).cast("int") for c in at[n]], F.lit(0)) for n in names}
    table = written(labelled.select("label", "fold", *["_" + n for n in names], *[b.cast("int").alias("b_" + n) for n, b in bins.items()]), "statistics")
    bad, good = F.count_if(F.col("label") == 0).alias("p"), F.count_if(F.col("label") == 1).alias("n")
    bits = lambda p, n: math.log2(p / (p + n)) if p else -math.inf
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = reduce(lambda a, r: a & ~holds(r), rules, F.lit(True))
        rule: Rule = []
        while len(rule) < most_conditions:
            rows = table.where((F.col("fold") < 2) & left & holds(rule))
            sides = rows.select("label", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col("b_" + n).alias("b")) for i, n in enumerate(names)])).alias("x"))
            counts = {(r.f, r.b): (r.p, r.n) for r in sides.groupBy("x.f", "x.b").agg(bad, good).collect()}  # statistics x cuts
            total = [sum(v[k] for (f, _), v in counts.items() if f == 0) for k in (0, 1)]
            if not total[0] or not total[1]:
                break
            best = None
            for f, n in enumerate(names):
                low = [0, 0]
                for b, cut in enumerate(at[n]):
                    low = [low[k] + counts.get((f, b), (0, 0))[k] for k in (0, 1)]
                    for op, (p, q) in (("<=", low), (">", [total[k] - low[k] for k in (0, 1)])):
                        if p >= least and (gain := p * (bits(p, q) - bits(*total))) > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, (n, op, cut), q)
            if best is None:
                break
            rule.append(best[1])
            if best[2] == 0:
                break
        if not rule:
            break
        held = table.where((F.col("fold") == 2) & left)
        heads = [rule[: i + 1] for i in range(len(rule))]
        sums = held.agg(*[F.count_if(holds(h) & (F.col("label") == k)).alias(f"c{i}_{k}") for i, h in enumerate(heads) for k in (0, 1)]).first()
        worth = [((sums[f"c{i}_0"] - sums[f"c{i}_1"]) / max(1, sums[f"c{i}_0"] + sums[f"c{i}_1"]), -i) for i in range(len(heads))]
        i = -max(worth)[1]
        p, q = sums[f"c{i}_0"], sums[f"c{i}_1"]
        if p < 2 or p < precision * (p + q):
            break
        rules.append(heads[i])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if the document passes."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(holds(rule), F.lit(i)).otherwise(out)
    return out


def labelled_statistics(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Statistics of the labelled documents, with label and fold."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).distinct()
    own = [c for c in stats.columns if c[0] == "_"]
    return stats.select(F.col(doc_id).alias("_id"), *own).join(marks, "_id").withColumn("fold", F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(3)).cast("int"))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **learning) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and rule (which one rejects)."""
    stats = written(statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text").drop("_text"), "statistics")
    with cleared(docs.sparkSession):
        rule = verdict(learn(labelled_statistics(stats, labels), **learning))
    return stats.select("doc_id", *[F.col("_" + c).alias(c) for c in BASE], base_failed().alias("base_failed"), (~base_failed() & rule.isNull()).alias("kept"), rule.alias("rule"))


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **learning) -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    marked = labels.where("doc_id is not null").select("doc_id").distinct()
    near = may_have(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id", marked, "doc_id")
    seen = near.where("maybe").select("row.*")  # statistics meet their labels below, so no text is shuffled
    with cleared(docs.sparkSession):
        known = written(labelled_statistics(statistics(seen, "_text").drop("_text"), labels), "labelled")
        rule = verdict(learn(known, **learning))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("_text"))
    return statistics(rows, "_text").where(~base_failed() & rule.isNull()).select("row.*")
