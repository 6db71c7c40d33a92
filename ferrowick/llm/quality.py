"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the votes of all documents that pass the base test
estimates each rule's accuracies and the share of good ones; a document's posterior probability of being
good decides, instead of all rules having to pass. The votes of a corpus are one histogram of at most
3 ** rules rows, whatever its size, and only that histogram reaches the driver.

Defined results: null text has no words; with fewer than MIN_WORDS words, or mostly repeated words, a document
fails the base test; a document on which all rules abstain has the posterior of the corpus; repeated
rows vote each; an empty table gives no rows. All of it is DataFrame functions, one row for one document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words_of

# The characters counted as symbols, and the base test.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.5
#: A rule's least accuracy on good documents.
LEAST_ON_GOOD = 0.99


@dataclass(frozen=True)
class Rule:
    """Votes good at or beyond `good`, bad at or beyond `bad`, else abstains; also where the feature is null."""

    name: str
    feature: str
    good: float
    bad: float

    def vote(self) -> Column:
        value = F.expr(self.feature)
        good, bad = (value <= self.good, value >= self.bad) if self.good < self.bad else (value >= self.good, value <= self.bad)
        return F.coalesce(F.when(good, 1).when(bad, -1), F.lit(0)).cast("tinyint")


# The rules' features and thresholds.
RULES = (
    Rule("length", "n_words", 100, 30),
    Rule("symbols", "try_divide(n_symbols, n_words)", 0.02, 0.15),
    Rule("capitals", "try_divide(n_upper, n_letters)", 0.2, 0.5),
    Rule("letters", "try_divide(n_letters, word_chars)", 0.85, 0.65),
    Rule("exclamations", "try_divide(n_exclaim, n_words)", 0.02, 0.2),
    Rule("repeated_lines", "try_divide(n_dup_lines, n_lines)", 0.1, 0.4),
    Rule("repeated_words", "try_divide(n_repeat_words, n_words)", 0.2, 0.45),
    Rule("long_words", "try_divide(word_chars, n_words)", 9, 14),
)


def repeated_windows(words: Column, width: int = 3) -> Column:
    """Array of (hash, position) of the width-word windows, sorted, so that equal windows are neighbours."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width))
    one = lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"), i.alias("i"))
    return F.sort_array(F.coalesce(F.transform(starts, one), F.array().cast("array<struct<h:bigint,i:int>>")))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts that the rules and the base test need, one row for each document.

    The sorted windows are columns of their own so that Spark computes them once for each row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), body.alias("body"), words_of(F.col(text)).alias("words"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("body") - F.length(F.translate("body", "!", ""))).cast("long").alias("n_exclaim"),
        F.length(F.regexp_replace("body", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("body", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        lines.alias("lines"),
        repeated_windows(F.col("words")).alias("windows"),
    )
    again = F.filter("windows", lambda e, k: F.coalesce(F.get("windows", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("windows", k + 1)["h"] == e["h"], F.lit(False)))
    at = F.sort_array(F.transform(again, lambda e: e["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_exclaim", "n_letters", "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(at, start, step, lambda acc: acc["total"]).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and each rule's accuracy on good and on bad documents where it votes."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds of being good: the prior's, and for each rule those of a good and of a bad vote."""
        votes = [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad, strict=True)]
        return math.log(self.good / (1 - self.good)), votes

    def posterior(self, votes: list[Column]) -> Column:
        prior, weights = self.weights()
        total = F.lit(prior)
        for (up, down), vote in zip(weights, votes, strict=True):
            total = total + F.when(vote > 0, up).when(vote < 0, down).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(histogram: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 50) -> VoteModel:
    """Expectation-maximisation over (votes, documents) pairs.

    It starts from rules that rarely reject a good document and find half of the bad ones; a few pseudo-documents
    hold it there where a corpus has no bad ones. What tells the two classes apart is that a rule, by its making, is
    right on LEAST_ON_GOOD of the good documents; how many bad ones it finds is learnt. A vote for good never counts
    against a document, nor a bad one for it.
    """
    model = VoteModel(0.8, (LEAST_ON_GOOD,) * n_rules, (0.5,) * n_rules)
    pseudo = 5.0
    for _ in range(rounds if histogram else 0):
        prior, weights = model.weights()
        good, total = 0.8 * pseudo, pseudo
        right = [[0.98 * pseudo, 0.5 * pseudo] for _ in range(n_rules)]  # on good, on bad
        voted = [[pseudo, pseudo] for _ in range(n_rules)]
        for votes, n in histogram:
            odds = prior + sum(w[0] if v > 0 else w[1] for w, v in zip(weights, votes, strict=True) if v)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good, total = good + n * p, total + n
            for k, v in enumerate(votes):
                if v:
                    voted[k][0] += n * p
                    voted[k][1] += n * (1 - p)
                    right[k][v < 0] += n * (p if v > 0 else 1 - p)
        on_good = [min(max(r[0] / v[0], LEAST_ON_GOOD), 0.9999) for r, v in zip(right, voted, strict=True)]
        on_bad = [min(max(r[1] / v[1], 1.001 - g), 0.9999) for r, v, g in zip(right, voted, on_good, strict=True)]
        model = VoteModel(min(max(good / total, 0.5), 0.999), tuple(on_good), tuple(on_bad))
    return model


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, votes, the base test, the posterior probability `quality` and the verdict `kept` of each document."""
    votes = [f"vote_{r.name}" for r in RULES]
    voted = features(docs, key, text).withColumns({name: rule.vote() for name, rule in zip(votes, RULES, strict=True)})
    voted = stored(voted, "votes")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    counted = voted.where(~failed).groupBy(*votes).agg(F.count("*").alias("n")).collect()  # 3 ** rules rows at most
    model = fit([(tuple(r[v] for v in votes), r["n"]) for r in counted], len(RULES))
    return voted.withColumns({"base_failed": failed, "quality": model.posterior([F.col(v) for v in votes])}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)
    )
