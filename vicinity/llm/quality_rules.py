"""Quality rules: a decision list learned by sequential covering, applied as one Spark expression.

Everything here is DataFrame operations. The statistics of each text are computed in one scan without a shuffle;
labelled rows, at most `sample_rows` of them, are binned once, and each step of growing or pruning a rule is a count
over those bins, so the driver only sees counts by feature and bin.

Defined cases: a null or empty text has no words (all counts 0, so it fails the base rule); repeated rows are judged
each on its own; a document with several labels counts by their mean; without labels of both kinds, or with empty
tables, no rule is learned and the verdict of the method is "keep"; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_SPACE = "[\\x20\\x09-\\x0D]"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The statistics that conditions may test, all in [0, inf) and 0 for a text without words.
FEATURES = ["f_mean_word", "f_symbols", "f_dup_lines", "f_repeat", "f_distinct", "f_upper", "f_digits", "f_marks", "f_words"]


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts for every whole text, in one narrow pass: `keep`, the five counts and FEATURES."""
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", f"{_SPACE}+"), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    count = lambda pattern: F.char_length("_t") - F.char_length(F.regexp_replace("_t", pattern, ""))
    kept = lambda pattern: F.char_length(F.regexp_replace("_t", pattern, ""))
    w = F.col("_w")
    d = d.select(
        *keep, "_w",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.size(F.array_distinct(w)).alias("_distinct"),
        kept("[^\\p{Lu}]+").alias("_upper"),
        kept("[^0-9]+").alias("_digits"),
        kept("[^!?]+").alias("_marks"),
        F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    # Only texts in which some hash of a window occurs again pay for the sort that finds where; the words decide there.
    h, word = F.col("_h"), lambda i: F.get("_w", i)
    d = d.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("p")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,a:string,b:string,c:string,p:int>>")),
    ).drop("_h", "_w")
    s = F.col("_s")
    same = lambda x, y: x["h"].eqNullSafe(y["h"]) & x["a"].eqNullSafe(y["a"]) & x["b"].eqNullSafe(y["b"]) & x["c"].eqNullSafe(y["c"])
    d = d.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))),
                lambda x: x["p"],
            )
        ),
    ).drop("_s")
    # A window at p covers words p, p+1 and p+2; those that the one before it covers don't count again.
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-9).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).cast("long").alias("n")),
        lambda a: a["n"],
    )
    d = d.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_l").alias("_lines"), "_distinct", "_upper", "_digits", "_marks",
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return d.select(
        *keep, *_COUNTS,
        share("word_chars", "n_words").alias("f_mean_word"),
        share("n_symbols", "n_words").alias("f_symbols"),
        share("n_dup_lines", "_lines").alias("f_dup_lines"),
        share("n_repeat_words", "n_words").alias("f_repeat"),
        share("_distinct", "n_words").alias("f_distinct"),
        share("_upper", "word_chars").alias("f_upper"),
        share("_digits", "word_chars").alias("f_digits"),
        share("_marks", "n_words").alias("f_marks"),
        F.col("n_words").cast("double").alias("f_words"),
    )


def _bin(name: str, cuts: list[float]) -> Column:
    """How many of the cuts the value is above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: F.col(name) > t)).cast("short")


@dataclass
class Rule:
    """All conditions hold -> reject. A condition is (feature, "<=" or ">", threshold)."""

    conditions: list[tuple[str, str, float]]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & (F.col(name) <= F.lit(at) if op == "<=" else F.col(name) > F.lit(at))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {op} {at:.6g}" for n, op, at in self.conditions)


@dataclass
class DecisionList:
    """Rules in order; what none of them rejects is kept."""

    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """The place of the first rule that fires, from 1; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn(
    labelled: DataFrame, bad: str = "bad", key: str = "doc_id", features: list[str] = FEATURES, *, sample_rows: int = 100_000,
    levels: int = 40, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.95, min_covered: int = 10,
) -> DecisionList:
    """Sequential covering over rows with a boolean `bad`.

    sample_rows bounds the rows it is fitted on (taken by a hash of the key). Two thirds of them grow each rule,
    condition by condition, by information gain; the last third prunes it, from its end, and decides whether it is
    precise enough to stay. Rows that a rule covers leave both parts before the next rule is grown.
    """
    rows = labelled.select(F.xxhash64(F.col(key), F.lit("rules")).alias("_k"), F.col(bad).cast("int").alias("_bad"), *features).dropna()
    total = rows.count()
    if total > sample_rows:
        rows = rows.where(F.pmod("_k", F.lit(1_000_003)) < int(1_000_003 * sample_rows / total))
    marks = [i / levels for i in range(1, levels)]
    ask = lambda name, of: F.percentile_approx(F.when(of, F.col(name)), marks, 2000).alias(name)
    of_all = rows.agg(*[ask(n, F.lit(True)) for n in features]).first()
    of_bad = rows.agg(*[ask(n, F.col("_bad") == 1) for n in features]).first()
    if of_all is None or any(of_all[n] is None or of_bad[n] is None for n in features):
        return DecisionList()
    cuts = {n: sorted({*of_all[n], *of_bad[n]}) for n in features}
    binned = rows.select(
        (F.pmod("_k", F.lit(3)) == 0).alias("_prune"), "_bad",
        *[_bin(n, cuts[n]).alias(n) for n in features],
    )
    binned = written(binned.coalesce(2), "rules-binned")

    def counts(part: DataFrame) -> dict[str, dict[int, list[int]]]:
        """By feature and bin: rows that are bad and rows that aren't."""
        pairs = F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in features])
        got = part.select("_bad", F.explode(pairs).alias("x")).groupBy("x.f", "x.b", "_bad").count().collect()
        out: dict[str, dict[int, list[int]]] = {n: {} for n in features}
        for r in got:
            out[r["f"]].setdefault(r["b"], [0, 0])[1 - r["_bad"]] += r["count"]
        return out

    def holds(c: tuple[str, str, int]) -> Column:
        return F.col(c[0]) <= c[2] if c[1] == "<=" else F.col(c[0]) > c[2]

    found = DecisionList()
    left = binned
    while len(found.rules) < max_rules:
        chosen: list[tuple[str, str, int]] = []
        part, (p0, n0) = left.where("NOT _prune"), (None, None)
        while len(chosen) < max_conditions:
            table = counts(part)
            if p0 is None:
                p0, n0 = (sum(x[i] for x in table[features[0]].values()) for i in (0, 1))
            if p0 < min_covered or not n0:
                break
            best, gain = None, 1e-9
            for name in features:
                p = n = 0
                for b in range(len(cuts[name])):
                    x = table[name].get(b, (0, 0))
                    p, n = p + x[0], n + x[1]
                    for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if pp >= min_covered:
                            g = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            if g > gain:
                                best, gain, after = (name, op, b), g, (pp, nn)
            if best is None:
                break
            chosen.append(best)
            (p0, n0), part = after, part.where(holds(best))
        if not chosen:
            break
        # One count over the pruning part for every cut-back form of the rule.
        forms = [chosen[: k + 1] for k in range(len(chosen))]
        sums = []
        for k, form in enumerate(forms):
            hit = F.lit(True)
            for c in form:
                hit = hit & holds(c)
            sums += [F.count_if(hit & (F.col("_bad") == 1)).alias(f"p{k}"), F.count_if(hit & (F.col("_bad") == 0)).alias(f"n{k}")]
        got = left.where("_prune").agg(*sums).first()
        score = lambda k: (got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"])  # noqa: B023, E731
        k = max(range(len(forms)), key=lambda k: (score(k), -k))
        p, n = got[f"p{k}"], got[f"n{k}"]
        if p < max(1, min_covered // 3) or p / (p + n) < min_precision:
            break
        found.rules.append(Rule([(f, op, float(cuts[f][b])) for f, op, b in forms[k]], p / (p + n), p + n))
        fires = F.lit(True)
        for c in forms[k]:
            fires = fires & holds(c)
        left = left.where(~fires)
    return found


def base_failed() -> Column:
    """Whether a text is too short, or repeats itself too much, for any rule to be asked."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, **fit) -> tuple[DataFrame, DecisionList]:
    """Statistics of every document with base_failed, rule (0: none fired) and kept; and the list itself.

    labels: doc_id and quality (1 good, 0 bad). The statistics are written once to the shared folder, since learning
    and judging both need them.
    """
    stats = written(text_statistics(docs), "text-statistics")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    rules = learn(stats.join(marks, "doc_id"), **fit)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.column())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
