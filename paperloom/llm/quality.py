"""Quality rules as a learned decision list.

Statistics of every text are Spark expressions. Sequential covering learns from labelled rows: a rule starts empty and
grows by the threshold condition with the highest gain in information about bad texts, is pruned back on the held part
of the rows, and is kept if enough of what it catches there is bad; the rows it covers go and the next rule is grown.
All counts are Spark aggregates, one job for each condition added; the result is one ordered ``CASE WHEN`` expression.

Cases: null or blank text has no words and fails the base rule; very long texts are taken whole; equal lines and windows
are counted by whole content (windows by 64-bit hash); an empty or one-sided label table gives an empty list, by which
every row is kept; repeated rows get equal results; further columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import bind, words, written

WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that the rules may use, each from the statistics of one row.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "shout_share": "n_shout / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _repeat_words(w: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more. ``w`` must be a bound array."""
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        # Equal windows lie side by side once sorted with their places.
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        # Each window adds the words up to the next one's start.
        union = F.aggregate(
            bind(pairs, places),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
            lambda acc, p: F.struct((acc["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), acc["end"] - p)).alias("n"), (p + WINDOW).alias("end")),
        )
        return union["n"]

    return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(
        bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds one struct column ``_stats`` with the base statistics and those behind ``FEATURES``."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def measured(w: Column) -> Column:
        plain = F.array_join(w, "")
        lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            bind(
                plain,
                lambda p: F.struct(
                    F.length(p).alias("word_chars"),
                    (F.length(p) - F.length(F.regexp_replace(p, r"[#*$%&|<>]+", ""))).alias("n_symbols"),
                    (F.length(p) - F.length(F.replace(p, F.lit("!"), F.lit("")))).alias("n_shout"),
                    (F.length(p) - F.length(F.regexp_replace(p, r"\p{Lu}+", ""))).alias("n_upper"),
                ),
            ).alias("c"),
            bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    df = df.withColumn("_m", bind(words(text), measured))
    return df.withColumn(
        "_stats",
        F.struct(
            F.col("_m.n_words").alias("n_words"),
            F.col("_m.c.word_chars").cast("long").alias("word_chars"),
            F.col("_m.c.n_symbols").cast("long").alias("n_symbols"),
            F.col("_m.l.dup").cast("long").alias("n_dup_lines"),
            F.col("_m.n_repeat_words").alias("n_repeat_words"),
            F.col("_m.l.n").cast("long").alias("n_lines"),
            F.col("_m.c.n_shout").cast("long").alias("n_shout"),
            F.col("_m.c.n_upper").cast("long").alias("n_upper"),
        ),
    ).drop("_m")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


@dataclass(frozen=True)
class Learning:
    """``max_rows`` bounds the labelled sample; the rows with the least hashed key are taken."""

    max_rows: int = 20_000
    bins: int = 16
    max_rules: int = 6
    max_conditions: int = 3
    #: Of what a rule catches among the rows held for pruning, so much must be bad.
    precision: float = 0.98
    min_covered: int = 5
    #: Every third row, by hash, is held for pruning.
    held: int = 3


class DecisionList:
    """Ordered rules; the first that holds names the verdict, and rows without one are kept."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    def fired(self) -> Column:
        """Number of the first rule that holds, null if none does; over columns named like ``FEATURES``."""
        if not self.rules:
            return F.lit(None).cast("int")
        out = F.when(F.expr(self.rules[0].sql()), 0)
        for i, r in enumerate(self.rules[1:], 1):
            out = out.when(F.expr(r.sql()), i)
        return out

    @classmethod
    def learn(cls, rows: DataFrame, how: Learning) -> DecisionList:
        """``rows``: columns named like ``FEATURES``, ``bad`` (boolean) and ``_held`` (boolean); a written, bounded table."""
        cuts = rows.agg(
            *[F.array_distinct(F.percentile_approx(f, [i / how.bins for i in range(1, how.bins)], 10_000)).alias(f) for f in FEATURES]
        ).first()
        literals = [Condition(f, up, float(t)) for f in FEATURES for t in (cuts[f] or []) for up in (True, False)]
        rules: list[Rule] = []
        left = rows
        while len(rules) < how.max_rules and literals:
            grown = cls._grow(left.where("NOT _held"), literals, how)
            rule = cls._prune(left.where("_held"), grown, how) if grown else None
            if rule is None:
                break
            rules.append(rule)
            left = left.where(f"NOT ({rule.sql()})")
        return cls(rules)

    @staticmethod
    def _counts(rows: DataFrame, tests: list[str]) -> list[tuple[int, int]]:
        """(bad, all) rows for each test, in one aggregate."""
        if not tests:
            return []
        got = rows.agg(*[x for i, t in enumerate(tests) for x in (F.expr(f"count_if(bad AND {t})").alias(f"b{i}"), F.expr(f"count_if({t})").alias(f"n{i}"))]).first()
        return [(got[f"b{i}"], got[f"n{i}"]) for i in range(len(tests))]

    @classmethod
    def _grow(cls, rows: DataFrame, literals: list[Condition], how: Learning) -> list[Condition]:
        import math

        got: list[Condition] = []
        (bad, n), = cls._counts(rows, ["true"])
        while len(got) < how.max_conditions and bad and bad < n:
            base = " AND ".join(c.sql() for c in got) or "true"
            counts = cls._counts(rows, [f"({base}) AND {c.sql()}" for c in literals])
            gains = [b * (math.log2(b / m) - math.log2(bad / n)) if b >= how.min_covered else 0.0 for b, m in counts]
            best = max(range(len(gains)), key=lambda i: (gains[i], -i))
            if gains[best] <= 0:
                break
            chosen = literals[best]
            # Midway between the threshold and the nearest bad row that it covers: as many bad rows, and good ones no more.
            nearest = F.min if chosen.above else F.max
            edge = rows.where(f"bad AND {base} AND {chosen.sql()}").agg(nearest(chosen.feature)).first()[0]
            got.append(replace(chosen, threshold=(chosen.threshold + edge) / 2))
            (bad, n), = cls._counts(rows, [" AND ".join(c.sql() for c in got)])
        return got

    @classmethod
    def _prune(cls, held: DataFrame, grown: list[Condition], how: Learning) -> Rule | None:
        """The prefix of the conditions with the best (bad - good) / covered on held rows; shorter wins ties."""
        prefixes = [grown[: i + 1] for i in range(len(grown))]
        counts = cls._counts(held, [" AND ".join(c.sql() for c in p) for p in prefixes])
        best = max(range(len(prefixes)), key=lambda i: ((2 * counts[i][0] - counts[i][1]) / max(1, counts[i][1]), -i))
        b, n = counts[best]
        if n < how.min_covered or b < how.precision * n:
            return None
        return Rule(tuple(prefixes[best]), b / n, n)


def features(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.expr(_over(x)).cast("double").alias(f) for f, x in FEATURES.items()])


def _over(expression: str) -> str:
    import re

    return re.sub(r"\b(n_\w+|word_chars)\b", r"_stats.\1", expression)


def learn(docs: DataFrame, labels: DataFrame, how: Learning = Learning(), key: str = "doc_id") -> DecisionList:
    """Learns from the labelled rows with ``quality`` 0 (bad) or 1. The sample is bounded, so its keys are broadcast."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull())
        .groupBy(key).agg(F.min("quality").alias("quality"))
        .select(F.col(key).alias("_key"), (F.col("quality") == 0).alias("bad"), F.xxhash64(key).alias("_h"))
        .orderBy("_h", "_key").limit(how.max_rows)
    )
    sample = written(sample, "labelled")
    rows = features(stats(docs.select(key, "text").join(F.broadcast(sample), F.col(key) == F.col("_key"))))
    rows = rows.select(*FEATURES, "bad", (F.pmod("_h", F.lit(how.held)) == 0).alias("_held"))
    return DecisionList.learn(written(rows, "labelled-stats"), how)


def apply(df: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Adds the statistics, ``base_failed``, ``rule`` (number of the rule that fired) and ``kept``."""
    new = (*STATS, "base_failed", "rule", "kept", *FEATURES)
    df = features(stats(df.drop(*[c for c in new if c in df.columns and c != text]), text))
    df = df.withColumn("rule", rules.fired()).drop(*FEATURES)
    for c in STATS:
        df = df.withColumn(c, F.col(f"_stats.{c}"))
    df = df.drop("_stats").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
