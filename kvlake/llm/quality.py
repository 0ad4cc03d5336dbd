"""Quality rules by weak supervision, with DataFrame functions only.

Each rule looks at one measure of a text and votes good (1) inside its healthy range, bad (-1) outside, and abstains
(0) in between or where the measure tells nothing. Expectation-maximisation over the counts of vote patterns estimates
how often each rule votes each way on good and on bad texts; the posterior probability of `good` decides, in place of a
test that all rules must pass. Patterns number 3 to the power of the rules at most, however many documents there are.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.shared import WORD_GAP, keep

WINDOW = 5
_GAPS = "\x20\x09\x0a\x0b\x0c\x0d"


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts over each whole text, one row per row of docs; a null text counts as an empty one, and an empty table gives no rows.

    n_repeat_words: words in any 5-word window that the text has twice or more. Windows are compared by
    64-bit hash. Texts without a repeated window, most of them, skip the sort that finds their places.
    """
    text, count = F.col("text"), lambda n: n.cast("long")
    inner = F.btrim(text, F.lit(_GAPS))
    # Each step keeps no more than the next ones read, as steps with lambdas copy their rows.
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select(
        "doc_id",
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP)).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_GAPS)) != "").alias("l"),
        count(F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))).alias("n_symbols"),
        count(F.length(F.regexp_replace(text, "[^A-Z]+", ""))).alias("n_capitals"),
        count(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"), F.lit("")))).alias("n_calls"),
    )
    counted = ["doc_id", "n_symbols", "n_capitals", "n_calls", "n_words", "word_chars", "n_distinct_words", "n_lines", "n_dup_lines"]
    # Windows begin at every word but the last four: words side by side with those after them, hashed as one.
    spread = F.arrays_zip(*[F.slice("w", k + 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))) for k in range(WINDOW)])
    base = base.select(
        *counted[:4],
        count(F.size("w")).alias("n_words"),
        count(F.length(F.array_join("w", ""))).alias("word_chars"),
        count(F.size(F.array_distinct("w"))).alias("n_distinct_words"),
        count(F.size("l")).alias("n_lines"),
        count(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.transform(spread, lambda x: F.xxhash64(x)).alias("g"),
    )
    # Of a text that has a window twice: windows with their places in order of hash, then the places of equal neighbours.
    placed = F.sort_array(F.arrays_zip(F.col("g").alias("x"), F.sequence(F.lit(0), F.size("g") - 1).alias("i")))
    base = base.select(*counted, F.when(F.size(F.array_distinct("g")) < F.size("g"), placed).alias("p"))
    side = lambda of, start: F.slice(F.col("p")[of], start, F.size("p") - 1)
    pairs = F.arrays_zip(side("x", 1).alias("a"), side("x", 2).alias("b"), side("i", 1).alias("i"), side("i", 2).alias("j"))
    base = base.select(*counted, F.filter(pairs, lambda s: s["a"] == s["b"]).alias("z"))
    base = base.select(*counted, F.sort_array(F.array_union(F.col("z")["i"], F.col("z")["j"])).alias("q"))
    gaps = F.arrays_zip(F.slice("q", 1, F.size("q") - 1).alias("i"), F.slice("q", 2, F.size("q") - 1).alias("j"))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda n, s: n + F.least(F.lit(WINDOW), s["j"] - s["i"]))
    return base.select(*counted, count(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The rules: each a measure of its own, with a healthy range, an unhealthy one and a gap between them where it abstains."""
    c = F.col
    n, chars = c("n_words"), c("word_chars")
    return {
        "length": _vote(n >= 50, n < 20),
        "word_length": _vote((chars >= n * 3) & (chars <= n * 7), (chars < n * 2) | (chars > n * 9)),
        "symbols": _vote(c("n_symbols") * 100 <= n, c("n_symbols") * 10 > n),
        "symbol_chars": _vote(c("n_symbols") * 500 <= chars, c("n_symbols") * 50 > chars),
        "capitals": _vote(c("n_capitals") * 10 <= chars, c("n_capitals") * 3 > chars),
        "calls": _vote(c("n_calls") * 50 <= n, c("n_calls") * 5 > n),
        "lines": _vote((c("n_lines") >= 2) & (c("n_dup_lines") * 10 <= c("n_lines")), (c("n_lines") >= 2) & (c("n_dup_lines") * 10 > c("n_lines") * 3)),
        "repeats": _vote((n >= 2 * WINDOW) & (c("n_repeat_words") * 20 <= n), c("n_repeat_words") * 100 > n * 15),
        # Distinct words over the root of all words hardly depend on a text's length.
        "variety": _vote(c("n_distinct_words") * c("n_distinct_words") >= n * 9, (n >= 20) & (c("n_distinct_words") * c("n_distinct_words") < n * 4)),
    }


#: How often a rule votes bad, abstains or votes good on bad (0) and good (1) texts, before any are seen.
_START = {0: {-1: 0.3, 0: 0.1, 1: 0.6}, 1: {-1: 0.02, 0: 0.08, 1: 0.9}}


class Votes:
    """What EM has learned: the share of good texts, and how often each rule votes each way on bad (0) and good (1) texts."""

    def __init__(self, rules: int, prior: float):
        self.prior = prior
        self.rate = {c: [dict(_START[c]) for _ in range(rules)] for c in (0, 1)}

    def weight(self, j: int, vote: int) -> float:
        """What a vote of rule j adds to the log odds of `good`."""
        return log(self.rate[1][j][vote] / self.rate[0][j][vote])

    def good(self, pattern: tuple[int, ...]) -> float:
        odds = log(self.prior / (1 - self.prior)) + sum(self.weight(j, x) for j, x in enumerate(pattern))
        return 1 / (1 + exp(-max(-500.0, min(500.0, odds))))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = 0.8, smooth: float = 10.0) -> Votes:
    """EM over vote patterns and their counts.

    A rule's accuracy is how often it votes bad, abstains or votes good on either class, which includes what its silence
    says. Rates start better than chance, which fixes which class is which, and are smoothed by `smooth` made-up texts of
    each class that vote as at the start; the share of good texts is kept within 0.05 and 0.95. No patterns: the start.
    """
    out = Votes(len(patterns[0][0]) if patterns else 0, prior)
    total, before = sum(n for _, n in patterns), None
    for _ in range(rounds if patterns else 0):
        good = [out.good(v) for v, _ in patterns]
        if before and max(abs(a - b) for a, b in zip(good, before, strict=True)) < 1e-9:
            break
        before = good
        out.prior = min(0.95, max(0.05, sum(n * g for (_, n), g in zip(patterns, good, strict=True)) / total))
        for c in (0, 1):
            of = [n * (g if c else 1 - g) for (_, n), g in zip(patterns, good, strict=True)]
            for j in range(len(patterns[0][0])):
                for x in (-1, 0, 1):
                    seen = sum(m for (v, _), m in zip(patterns, of, strict=True) if v[j] == x)
                    out.rate[c][j][x] = (seen + smooth * _START[c][x]) / (sum(of) + smooth)
    return out


def judge(docs: DataFrame, keep_at: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """features() of every row, with each rule's vote as vote_<rule>, p_good, base_failed and kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated windows; such a text
    is never kept, and takes no part in learning. Ties at keep_at are kept. Null and empty texts fail the base rule. Rows
    with a null or repeated id are judged each by itself, equal texts alike; an empty table gives no rows; other columns are
    not read.
    """
    rules = votes()
    named = [f"vote_{r}" for r in rules]
    seen = keep(features(docs, id_col), "quality")
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    seen = seen.withColumns({**dict(zip(named, rules.values(), strict=True)), "base_failed": base_failed})
    counted = seen.filter("NOT base_failed").groupBy(*named).count().collect()  # 3 to the power of the rules at most
    learned = fit(sorted((tuple(r[v] for v in named), r["count"]) for r in counted))
    odds = F.lit(log(learned.prior / (1 - learned.prior)))
    for j, v in enumerate(named if counted else []):
        odds = odds + F.when(F.col(v) < 0, learned.weight(j, -1)).when(F.col(v) > 0, learned.weight(j, 1)).otherwise(learned.weight(j, 0))
    judged = seen.withColumn("p_good", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds)))))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))
