"""Quality rules as weak supervision, in DataFrame expressions only.

Every rule votes good (1), bad (-1) or abstains (0). How far a rule can be trusted is estimated without
labels: expectation-maximisation over the counts of vote patterns alternates between the posterior
probability that a pattern is of good quality and, per rule, how often it is right on good and on bad
texts when it votes. The posterior replaces "all rules must pass". There are at most 3^rules patterns,
however many documents there are, so every round is one aggregation of a table of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import table
from peakloom.plans.durable import discard, stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition within a text is counted.
WINDOW = 3
LEAST_WORDS, MOST_REPEATED = 50, 50

#: A word of letters, hyphens or apostrophes inside, with quotes, brackets and punctuation around it.
PLAIN_WORD = r"\A[\"'“‘«(]*\p{L}+(?:['’-]\p{L}+)*[.,;:!?…\"'”’»)]*\z"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_closed", "n_plain", "n_distinct")
#: Each rule as (name, votes good if, votes bad if), in SQL both engines read, over COUNTS.
RULES = (
    ("length", "n_words >= 100", "n_words < 50"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "2 * word_chars < 5 * n_words OR word_chars > 14 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "100 * n_symbols > 10 * n_words"),
    ("line_copies", "n_lines >= 3 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("repetition", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    ("letters", "100 * n_letters >= 85 * word_chars", "100 * n_letters < 65 * word_chars"),
    ("capitals", "100 * n_upper <= 20 * n_letters", "100 * n_upper > 50 * n_letters"),
    ("closed_lines", "2 * n_closed >= n_lines", "10 * n_closed < n_lines"),
    ("plain_words", "100 * n_plain >= 85 * n_words", "100 * n_plain < 60 * n_words"),
    ("variety", "100 * n_distinct >= 40 * n_words", "100 * n_distinct < 15 * n_words"),
)
#: Starting values, and the weight they keep as pseudo-counts against the rows seen. A rule seldom
#: fails a good text, and passes most bad ones, because each looks for one kind of them.
START_GOOD, START_RIGHT, PSEUDO = 0.8, (0.99, 0.25), 10.0
TOLERANCE, MOST_ROUNDS = 1e-6, 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that occurs twice or more in the array.

    Windows are compared by 64-bit hash: sorted with their positions, equal ones are neighbours; the
    positions found, sorted again, cover their words without counting one twice.
    """
    n = F.size(words)
    hashed = lambda w: F.transform(
        F.sequence(F.lit(1), n - (window - 1)),
        lambda i: F.struct(F.xxhash64(*[F.element_at(w, i + k) for k in range(window)]).alias("h"), i.alias("i")),
    )
    same = lambda pairs, p, j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
    doubled = lambda pairs: F.filter(pairs, lambda p, j: same(pairs, p, j - 1) | same(pairs, p, j + 1))
    starts = let(F.sort_array(hashed(words)), lambda pairs: F.sort_array(F.transform(doubled(pairs), lambda p: p["i"])))
    steps = let(starts, lambda s: F.transform(s, lambda p, j: F.least(F.lit(window), F.get(s, j + 1) - p)))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(n > window, covered).otherwise(F.lit(0).cast("bigint"))


def counted(text: Column) -> Column:
    """The COUNTS of a text as a struct; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c, name: c.cast("bigint").alias(name)
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    by_line = let(lines, lambda x: F.struct(
        long(F.size(x), "n"), long(F.size(x) - F.size(F.array_distinct(x)), "dup"),
        long(F.size(F.filter(x, lambda y: F.rlike(y, F.lit(r"[.!?…][\x20\x09-\x0D]*\z")))), "closed"),
    ))
    by_word = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        long(F.size(w), "n"), long(repeated_words(w), "repeat"), long(F.size(F.array_distinct(w)), "distinct"),
        long(F.size(F.filter(w, lambda x: F.rlike(x, F.lit(PLAIN_WORD)))), "plain"),
    ))
    return let(F.struct(by_line.alias("line"), by_word.alias("word")), lambda s: F.struct(
        s["word"]["n"].alias("n_words"),
        long(F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")), "word_chars"),
        long(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")), "n_symbols"),
        s["line"]["n"].alias("n_lines"), s["line"]["dup"].alias("n_dup_lines"), s["word"]["repeat"].alias("n_repeat_words"),
        long(left(r"\P{L}+"), "n_letters"), long(left(r"\P{Lu}+"), "n_upper"), s["line"]["closed"].alias("n_closed"),
        s["word"]["plain"].alias("n_plain"), s["word"]["distinct"].alias("n_distinct"),
    ))


def with_counts(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus COUNTS; columns of the same names are replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    return docs.select(*kept, counted(F.col("text")).alias("__counts")).select(*kept, "__counts.*")


def votes_of(rules=RULES) -> Column:
    """The votes of all rules as one array, from the columns COUNTS."""
    return F.array(*[F.expr(f"CAST(CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END AS int)") for _, good, bad in rules])


@dataclass(frozen=True)
class Model:
    """Share of good texts and, per rule, how often its votes are right on (good, bad) texts."""

    good: float
    right: dict[str, tuple[float, float]]
    rounds: int = 0
    converged: bool = False


def posterior(votes: Column, model: Model) -> Column:
    """Probability of good quality given the votes; rounded, so that sums in another order agree.

    The weights are one array literal, looked up by rule and vote: no round needs code of its own.
    """
    weights, prior = [], math.log(model.good / (1 - model.good))
    for good, bad in model.right.values():
        weights += [math.log((1 - good) / bad), 0.0, math.log(good / (1 - bad))]
    told = F.transform(votes, lambda v, j: F.get(F.lit(weights), 3 * j + 1 + v))
    odds = F.aggregate(told, F.lit(prior), lambda acc, x: acc + x)
    return F.round(1 / (1 + F.exp(-odds)), 9)


def fit(votes: DataFrame, names: list[str], tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> Model:
    """Accuracies of the rules by expectation-maximisation over all rows of ``votes`` (votes).

    Rows are first counted per vote pattern; without rows the starting values come back. A rule whose
    votes would count against themselves (right on good and on bad texts less than once in all) is
    held where they count nothing. ``converged`` says whether no value moved by ``tolerance`` any more.
    """
    patterns = stored(votes.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1))
    bounded = patterns.coalesce(1)  # 3^rules rows at most: one task, no exchange
    model = Model(START_GOOD, {n: START_RIGHT for n in names})
    smooth = lambda hit, all_, start: (hit + PSEUDO * start) / (all_ + PSEUDO)
    for k in range(1, rounds + 1):
        q = bounded.select("n", (F.col("n") * posterior(F.col("votes"), model)).alias("good"), F.posexplode("votes").alias("rule", "vote"))
        sums = {(r["rule"], r["vote"]): (r["good"], r["n"] - r["good"]) for r in q.groupBy("rule", "vote").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()}
        told = lambda i, vote, y: sums.get((i, vote), (0.0, 0.0))[y]
        right = {}
        for i, n in enumerate(names):
            a = smooth(told(i, 1, 0), told(i, 1, 0) + told(i, -1, 0), START_RIGHT[0])
            b = smooth(told(i, -1, 1), told(i, 1, 1) + told(i, -1, 1), START_RIGHT[1])
            lift = max(0.0, 1 - a - b) / 2
            right[n] = (a + lift, b + lift)
        every = [sum(told(0, v, y) for v in (-1, 0, 1)) for y in (0, 1)]
        new = Model(smooth(every[0], sum(every), START_GOOD), right, k)
        moved = max([abs(new.good - model.good)] + [abs(x - y) for n in names for x, y in zip(right[n], model.right[n])])
        model = new
        if moved < tolerance:
            model = Model(new.good, right, k, True)
            break
    discard(patterns)
    return model


def judge(counts: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """``counts`` (COUNTS and any other columns) plus quality, base_failed and kept.

    quality is the posterior; kept takes 0.5 or more, and never a text that fails the base rules:
    under 50 words, or over half of its words repeated. A tie at 0.5 is kept.
    """
    own = [c for c in counts.columns if c not in ("quality", "base_failed", "kept")]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    plain = [F.col(f"`{c}`") for c in own]
    voted = counts.select(*plain, posterior(votes_of(rules), model).alias("quality"), failed.alias("base_failed"))
    return voted.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def rate(docs: DataFrame, rules=RULES) -> tuple[DataFrame, Model]:
    """(``docs`` without text plus COUNTS, quality, base_failed and kept; the model behind them).

    A null or empty text has no words and fails the base rules. Every row counts in the estimate and
    is judged by its text alone, so rows that repeat agree. The counts are written once and read
    for both; they hold a few numbers a document.
    """
    counts = stored(with_counts(docs).drop("text"))
    model = fit(counts.select(votes_of(rules).alias("votes")), [r[0] for r in rules])
    return judge(counts, model, rules), model


def op11(spark, sf_dir: str) -> DataFrame:
    out, _ = rate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same in SQL: counts, votes, patterns, and the estimate as a recursion of MOST_ROUNDS steps."""
    ks = range(len(RULES))
    votes = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END AS v{k}" for k, (_, good, bad) in enumerate(RULES))
    names = ", ".join(f"v{k}" for k in ks)
    odds = "ln(g / (1 - g))" + "".join(f" + CASE v{k} WHEN 1 THEN ln(a{k} / (1 - b{k})) WHEN -1 THEN ln((1 - a{k}) / b{k}) ELSE 0 END" for k in ks)
    q = f"round(1 / (1 + exp(-({odds}))), 9)"
    soft = lambda hit, all_, start: f"(coalesce(sum({hit}), 0) + {PSEUDO * start}) / (coalesce(sum({all_}), 0) + {PSEUDO})"
    sums = ", ".join(
        f"{soft(f'CASE WHEN v{k} = 1 THEN n * q END', f'CASE WHEN v{k} <> 0 THEN n * q END', START_RIGHT[0])} AS a{k}, "
        f"{soft(f'CASE WHEN v{k} = -1 THEN n * (1 - q) END', f'CASE WHEN v{k} <> 0 THEN n * (1 - q) END', START_RIGHT[1])} AS b{k}"
        for k in ks
    )
    lifted = ", ".join(f"a{k} + greatest(0, 1 - a{k} - b{k}) / 2 AS a{k}, b{k} + greatest(0, 1 - a{k} - b{k}) / 2 AS b{k}" for k in ks)
    start = ", ".join(f"{START_RIGHT[0]}::DOUBLE AS a{k}, {START_RIGHT[1]}::DOUBLE AS b{k}" for k in ks)
    return rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), listed AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT rid, i, words[i:i + 2] AS w FROM listed, unnest(range(1, len(words) - 1)) AS u(i)
), repeats AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1
), steps AS (
  SELECT rid, least(3, lead(i) OVER (PARTITION BY rid ORDER BY i) - i) AS step FROM repeats
), covered AS (
  SELECT rid, sum(coalesce(step, 3))::BIGINT AS n FROM steps GROUP BY rid
), counts AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper,
    len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…][\x20\x09-\x0D]*\z'))) AS n_closed,
    len(list_filter(words, lambda x: regexp_matches(x, '{PLAIN_WORD.replace("'", "''")}'))) AS n_plain, len(list_distinct(words)) AS n_distinct
  FROM listed LEFT JOIN covered USING (rid)
), votes AS (
  SELECT *, {votes} FROM counts
), patterns AS (
  SELECT {names}, count(*)::DOUBLE AS n FROM votes GROUP BY ALL
), em AS (
  SELECT 0 AS it, {START_GOOD}::DOUBLE AS g, {start}
  UNION ALL
  SELECT it, g, {lifted} FROM (
    SELECT it + 1 AS it, {soft('n * q', 'n', START_GOOD)} AS g, {sums}
    FROM (SELECT *, {q} AS q FROM em, patterns WHERE it < {MOST_ROUNDS}) GROUP BY it
  )
), judged AS (
  SELECT votes.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {q} AS quality
  FROM votes, em WHERE it = {MOST_ROUNDS}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept FROM judged
"""


OP11_SQL = _oracle()
