"""Quality rules by weak supervision, in DataFrame expressions only.

Seven rules look at counts of a text and vote good (+1), bad (-1) or abstain (0).
Nobody says how far a rule can be trusted: expectation-maximisation over the
vote patterns of *all* documents estimates, for each rule, how often its votes
are right on good and on bad documents. The posterior probability of "good" then replaces
an all-rules-must-pass filter.

The statistics EM needs are the counts of vote patterns: at most ``3**7`` rows
however large the corpus is. They are folded in one row by a higher-order
``aggregate``; the resulting pattern table (again at most 2187 rows) is joined
back by broadcast. The text is scanned once, narrow, without a shuffle.

Defined results: a null text counts as empty; an empty text has zero counts and
fails the base rule; repeated rows are judged alike, each for itself; other
columns, whatever their names, pass through only in :func:`filter_quality`; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import let, materialize, named

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RULES = ("v_length", "v_symbols", "v_symbol_chars", "v_lines", "v_repeats", "v_variety", "v_clean")
EM_ROUNDS = 20
#: Weight of the belief, before any data, that a rule is right on this share of its votes.
PRIOR_VOTES, PRIOR_RIGHT = 10.0, 0.9
PRIOR_GOOD = 0.8


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by windows that stand in the text twice or more; O(n log n) a text.

    Windows of equal hashes are neighbours after sorting; they count as equal if their words are.
    """

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), p - F.get(at, i - 1)), F.lit(WINDOW)))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        def same(x, y):
            return (y["h"] == x["h"]) & (F.slice(words, y["p"] + 1, WINDOW) == F.slice(words, x["p"] + 1, WINDOW))

        def twin(x, i):
            return F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))

        return let(F.sort_array(F.transform(F.filter(s, twin), lambda x: x["p"])), covered)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), repeated))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, SPACES, "")
    trimmed = F.btrim(t, F.lit(SPACES))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+", -1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    out = df.withColumns({"_words": words, "_lines": lines, "_bare": F.length(bare), "_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, ""))})
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("_words"), i, F.lit(WINDOW)))))
    out = out.withColumn("_hashes", F.coalesce(windows, F.array().cast("array<bigint>")))
    counts = {
        "n_words": n,
        "word_chars": F.col("_bare"),
        "n_symbols": F.col("_symbols"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_words"), F.col("_hashes")),
        "n_lines": F.size("_lines"),
        "n_distinct": F.size(F.array_distinct("_words")),
    }
    # A generator is a barrier: filters on the counts are not pushed into it, which would
    # put the expensive expressions, inlined, into the filter.
    packed = F.array(F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(packed))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The rules, in integers only, so that every engine votes alike.

    Four can vote both ways. They vote good only where no count speaks against the text, so
    that a text of one plain fault is not outvoted by rules that do not look at it.
    """
    n, c = F.col("n_words"), F.col
    never = F.lit(False)
    few_symbols, no_symbols = 10 * c("n_symbols") <= n, 100 * c("n_symbols") <= n
    return {
        "v_length": _vote(n < 30, never),
        "v_symbols": _vote(~few_symbols, no_symbols & (c("n_dup_lines") == 0) & (n >= 30)),
        "v_symbol_chars": _vote(20 * c("n_symbols") > c("word_chars"), never),
        "v_lines": _vote(4 * c("n_dup_lines") > c("n_lines"), never),
        "v_repeats": _vote(20 * c("n_repeat_words") > 3 * n, (c("n_repeat_words") == 0) & few_symbols & (n >= 30)),
        "v_variety": _vote((n >= 60) & (5 * c("n_distinct") < n), (n >= 60) & (3 * c("n_distinct") >= n) & few_symbols & (20 * c("n_repeat_words") <= n)),
        "v_clean": _vote((c("word_chars") < 2 * n) | (c("word_chars") > 14 * n), no_symbols & (c("n_repeat_words") == 0) & (n >= 20)),
    }


def _posterior(pattern: Column, params: Column) -> Column:
    """P(good | votes) under the prior and the rules' accuracies in ``params``; an abstention says nothing."""
    odds = F.log(params["prior"]) - F.log(1 - params["prior"])
    for k in range(len(RULES)):
        vote, good, bad = F.get(pattern, F.lit(k)), F.get(params["good"], F.lit(k)), F.get(params["bad"], F.lit(k))
        odds = odds + F.when(vote == 1, F.log(good) - F.log(1 - bad)).when(vote == -1, F.log(1 - good) - F.log(bad)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def fit_posteriors(patterns: DataFrame) -> DataFrame:
    """EM over ``(v, n)`` rows (vote pattern, documents with it) -> ``(v, posterior)``.

    A rule has two accuracies: how often it votes good on good documents, and bad on bad
    ones, where it votes. So a rule that votes good on nearly everything says little when
    it does, and much when it does not. Everything happens in one row of at most
    ``3**len(RULES)`` patterns, in sorted order, so the sums are the same on every run.
    """
    start = F.struct(F.lit(PRIOR_GOOD).alias("prior"), *[F.array(*[F.lit(PRIOR_RIGHT)] * len(RULES)).alias(k) for k in ("good", "bad")])

    def total(rows, value):
        return F.aggregate(rows, F.lit(0.0), lambda a, x: a + value(x))

    def em_round(params, _):
        def maximise(scored):
            def right(k, way, share):
                # Votes that are right, over votes, of documents of one kind, with the prior's votes added.
                vote = lambda x: F.get(x["v"], F.lit(k))
                agreed = total(scored, lambda x: F.when(vote(x) == way, x["n"] * share(x)).otherwise(F.lit(0.0)))
                cast = total(scored, lambda x: F.when(vote(x) != 0, x["n"] * share(x)).otherwise(F.lit(0.0)))
                return (agreed + PRIOR_VOTES * PRIOR_RIGHT) / (cast + PRIOR_VOTES)

            prior = (total(scored, lambda x: x["n"] * x["p"]) + PRIOR_VOTES * PRIOR_GOOD) / (total(scored, lambda x: x["n"]) + PRIOR_VOTES)
            good = F.array(*[right(k, 1, lambda x: x["p"]) for k in range(len(RULES))])
            bad = F.array(*[right(k, -1, lambda x: 1 - x["p"]) for k in range(len(RULES))])
            return F.struct(prior.alias("prior"), good.alias("good"), bad.alias("bad"))

        return let(F.transform(F.col("rows"), lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), _posterior(x["v"], params).alias("p"))), maximise)

    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("rows"))
    fitted = one.withColumn("params", F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, em_round))
    return fitted.select("params", F.explode("rows").alias("r")).select(F.col("r.v").alias("v"), F.round(_posterior(F.col("r.v"), F.col("params")), 6).alias("posterior"))


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, votes, posterior, base_failed, kept."""
    slim = docs.select(named(id_col).alias("doc_id"), named(text).alias("text"))
    feats = with_features(slim).drop("text").withColumn("v", F.array(*votes().values()))
    feats = materialize(feats, "quality")
    posterior = fit_posteriors(feats.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    # At most 3**len(RULES) = 2187 rows: the broadcast is bounded by construction.
    out = feats.join(F.broadcast(posterior), "v")
    failed = base_failed()
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior",
        *[F.get("v", F.lit(k)).alias(name) for k, name in enumerate(RULES)],
    )


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names.

    The verdict is computed beside each row, so that ids may repeat or be null. Features
    are computed once, and the rows written with their votes; no row is shuffled.
    """
    cols = docs.columns
    whole = docs.select(F.struct(*map(named, cols)).alias("row"))
    slim = whole.select("row", F.col("row").getField(text).alias("text"))
    feats = with_features(slim).select("row", F.array(*votes().values()).alias("v"), base_failed().alias("failed"))
    feats = materialize(feats, "quality-rows")
    counts = feats.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    kept = feats.where("not failed").join(F.broadcast(fit_posteriors(counts)), "v").where(F.col("posterior") >= 0.5)
    return kept.select("row.*")
