"""Quality by weak supervision: rules vote or abstain, and their accuracies are learned from agreement alone.

Each rule looks at one statistic of a whole text and votes good, votes bad or abstains. Documents are counted by their pattern
of votes, which leaves at most 3 ** rules rows however many documents there are. Expectation maximisation runs on these
counts: given the documents' posteriors, a rule's chance of each vote among good and among bad documents is re-estimated,
and the other way round, until nothing moves. A document is kept when its posterior probability of being good is at least one half and
the two base rules do not fail it.

Everything on the way is a DataFrame expression. Repeats of word windows are found by sorting a text's window hashes
within its row, so no word ever leaves its document.

Defined results: null and empty texts have no words, all counts 0 and fail the base rule; very long texts are handled whole;
a null id is a row like any other; repeated rows each count and each get a row; an empty table gives no rows; columns other than id and text are not
read; a posterior of exactly one half keeps; a rule that abstains everywhere keeps its first accuracies and changes nothing.
"""

from __future__ import annotations

import math
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import saved

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 3
LEAST_WORDS = 50
REPEAT_PERCENT = 50

#: Rules: a statistic, and the bounds up to which it votes good (null: it never does) and from which it votes bad.
#: Between them it abstains. A rule that finds one kind of junk says nothing about texts without that kind.
RULES: dict[str, tuple[float | None, float]] = {
    "symbols_per_100_words": (None, 20.0),
    "words_without_letters_percent": (None, 20.0),
    "repeated_words_percent": (None, 35.0),
    "repeated_lines_percent": (None, 40.0),
    "upper_case_percent": (None, 40.0),
    "word_length_off": (None, 6.0),
    "letters_off_percent": (6.0, 30.0),
    "stops_off": (9.0, 45.0),
}
USUAL_STOPS = 14  # stops per 100 words of prose
USUAL_LENGTH = 5.5  # characters of a word of prose
PRIOR = 0.5
FIRST_GOOD = [0.02, 0.38, 0.6]  # chances of a bad vote, an abstention and a good vote of any rule, before the first round
FIRST_BAD = [0.3, 0.5, 0.2]
SMOOTHING = 1.0
MAX_ROUNDS = 40
TOLERANCE = 1e-4


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _window_hashes(words: Column) -> Column:
    """Hash of every window of three words, in place order; words are given by their hashes."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))


def _placed(windows: Column) -> Column:
    """(hash, place) of all windows, equal hashes side by side; empty for a text that repeats no window, as most texts."""
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _repeated_starts(placed: Column) -> Column:
    """Places, in order, of the windows whose hash occurs more than once."""
    def again(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(placed, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed, i + 1)["h"] == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(placed, again), lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Number of words under windows of three at the given places."""
    step = lambda x, i: F.least(F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
    return F.coalesce(F.aggregate(F.transform(starts, step), F.lit(0).cast("bigint"), lambda total, x: total + x), F.lit(0).cast("bigint"))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each whole text that the base contract and the rules use."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    removed = lambda c, pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("bigint")
    rows = rows.withColumns({"_words": _words(F.col("_text")), "_lines": lines, "_rest": F.regexp_replace("_text", r"\p{L}+", "")})
    rows = rows.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "_marks": F.regexp_replace("_rest", SPACE, "")})
    rows = rows.withColumn("_windows", _window_hashes(F.col("_hashes")))
    rows = rows.withColumn("_placed", _placed(F.col("_windows")))
    rows = rows.withColumn("_starts", _repeated_starts(F.col("_placed")))
    return rows.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        (F.length("_text") - F.length("_rest") + F.length("_marks")).cast("bigint").alias("word_chars"),
        removed("_marks", r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _covered(F.col("_starts")).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.length("_text") - F.length("_rest")).cast("bigint").alias("n_letters"),
        removed("_text", r"\p{Lu}+").alias("n_upper"),
        F.size(F.filter("_words", lambda w: ~F.rlike(w, F.lit(r"\p{L}")))).cast("bigint").alias("n_no_letter"),
        removed("_marks", r"[.!?:;,]+").alias("n_stops"),
    )


def rule_values(stats: DataFrame) -> DataFrame:
    """Add the statistic of each rule, null where there is nothing to divide by."""
    part = lambda a, b: F.try_divide(F.col(a) * 100.0, F.col(b))
    values = {
        "symbols_per_100_words": part("n_symbols", "n_words"),
        "repeated_words_percent": part("n_repeat_words", "n_words"),
        "repeated_lines_percent": part("n_dup_lines", "n_lines"),
        "upper_case_percent": part("n_upper", "n_letters"),
        "words_without_letters_percent": part("n_no_letter", "n_words"),
        "letters_off_percent": 100.0 - part("n_letters", "word_chars"),
        "word_length_off": F.abs(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words")) - USUAL_LENGTH),
        "stops_off": F.abs(part("n_stops", "n_words") - USUAL_STOPS),
    }
    return stats.withColumns(values)


def votes(values: DataFrame, rules: dict[str, tuple[float | None, float]] = RULES) -> DataFrame:
    """Add `votes`: per rule 1 (good), -1 (bad) or 0 (abstains)."""
    def vote(name: str, good: float | None, bad: float) -> Column:
        cast = F.when(F.col(name) >= bad, -1)
        return (cast if good is None else cast.when(F.col(name) <= good, 1)).otherwise(0).cast("int")

    return values.withColumn("votes", F.array(*[vote(name, *bounds) for name, bounds in rules.items()]))


class Accuracies:
    """Share of good documents, and per rule the chances of the votes -1, 0, 1 among good and among bad documents."""

    def __init__(self, prior: float, good: list[list[float]], bad: list[list[float]]) -> None:
        self.prior, self.good, self.bad = prior, good, bad

    def posterior(self, votes: Column) -> Column:
        """Probability of being good. A rule may lose its say, but a good vote never counts against a text, nor a bad one for it."""
        gains = []
        for good, bad in zip(self.good, self.bad, strict=True):
            against, abstains, for_it = (math.log(g / b) for g, b in zip(good, bad, strict=True))
            gains += [min(against, 0.0), abstains, max(for_it, 0.0)]
        table = F.array(*[F.lit(g) for g in gains])
        cast = F.transform(votes, lambda vote, rule: F.get(table, rule * 3 + vote + 1))
        return 1 / (1 + F.exp(-F.aggregate(cast, F.lit(math.log(self.prior / (1 - self.prior))), add)))

    def distance(self, other: Accuracies) -> float:
        """Largest change of any chance."""
        flat = lambda x: [x.prior, *(c for side in (x.good, x.bad) for rule in side for c in rule)]
        return max(abs(a - b) for a, b in zip(flat(self), flat(other), strict=True))


def fit_accuracies(voted: DataFrame, rules: int = len(RULES)) -> Accuracies:
    """Expectation maximisation over the counts of vote patterns, until nothing moves. A round brings back 3 rows per rule."""
    patterns = saved(voted.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    now = Accuracies(PRIOR, [FIRST_GOOD] * rules, [FIRST_BAD] * rules)
    for _ in range(MAX_ROUNDS):
        each = patterns.select("n", now.posterior(F.col("votes")).alias("p"), F.posexplode("votes").alias("rule", "vote"))
        sums = each.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad"))
        seen = {(r["rule"], r["vote"]): (r["good"], r["bad"]) for r in sums.collect()}
        if not seen:
            break
        totals = [sum(seen.get((0, v), (0.0, 0.0))[side] for v in (-1, 0, 1)) for side in (0, 1)]
        chances = [
            [[(seen.get((i, v), (0.0, 0.0))[side] + SMOOTHING) / (totals[side] + 3 * SMOOTHING) for v in (-1, 0, 1)] for i in range(rules)]
            for side in (0, 1)
        ]
        new = Accuracies((totals[0] + SMOOTHING) / (sum(totals) + 2 * SMOOTHING), *chances)
        moved = new.distance(now)
        now = new
        if moved < TOLERANCE:
            break
    return now


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: dict[str, tuple[float | None, float]] = RULES) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, good (posterior), votes."""
    stats = saved(text_statistics(docs, id_col, text_col), "statistics")
    voted = votes(rule_values(stats), rules)
    good = fit_accuracies(voted, len(rules)).posterior(F.col("votes"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return voted.withColumn("good", good).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("good") >= 0.5)).alias("kept"), "good", F.array_join("votes", ",").alias("votes"),
    )


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns. Rows are joined by id and text key; rows equal in both share one verdict."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.withColumn("_key", key)
    kept = judge_quality(marked, "_key", text_col).where("kept").select(F.col("doc_id").alias("_key")).distinct()
    return marked.join(kept, "_key", "left_semi").select(*docs.columns)
