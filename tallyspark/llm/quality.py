"""Quality rules with risk-controlled thresholds (dealt operator 8).

Each rule compares one feature of a text with a cutoff.  Cutoffs come from
labelled documents, separately for each stratum (language): a cutoff is
*certified* if an exact binomial test shows that it rejects at most ``alpha``
of the good documents.  With ``k`` of ``n`` good documents beyond it, the test
is P(Bin(n, alpha) <= k) <= level, which is the same as an upper
Clopper-Pearson bound of at most ``alpha``.

Multiple testing: the error probability ``delta`` is shared equally by all
strata and rules (Bonferroni); inside one, cutoffs are tested from the most
lenient on and testing stops at the first failure (fixed sequence), which needs
no further correction.  So with probability 1 - delta all certified cutoffs
keep their promise together, and any choice among them is safe.  The choice is
the cutoff that rejects most bad documents beyond ``price`` times the good
ones; where none gains, the rule rejects nothing in that stratum.  A document
beyond any of its stratum's cutoffs is rejected, so at most ``rules * alpha``
of the good documents of a stratum are.

Only counts reach the driver: strata (at most ``MAX_STRATA``; smaller ones are
pooled as "other"), rules and steps of a grid bound them.  All labelled
documents count.  Repeated labels of a document count each; documents without
a label are judged like all others.

Null texts have no words: ``base_failed``, not kept.  A null or unseen stratum
is part of "other".  Empty tables give no rows, and without labels no rule
rejects anything.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_batches, process_cache, written

#: Share of good documents that one rule may reject, probability that any promise fails, good documents a rejected bad one outweighs.
ALPHA, DELTA, PRICE = 0.01, 0.05, 0.5
MAX_STRATA, OTHER = 256, "other"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Characters that are neither letters nor digits, and Latin, Greek and Cyrillic capitals.
MARKS, CAPITALS = re.compile(r"[\W_]"), re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de\u0391-\u03a9\u0410-\u042f]")
#: Cutoffs of every rule, from lenient to strict: shares of 1 from high to low.
GRID = [1 - i / 100 for i in range(1, 100)] + [0.0075, 0.005, 0.0025]
#: Rules: feature names whose high values speak against a text, all from 0 to 1.
RULES = ("symbol_share", "mark_share", "capital_share", "dup_line_share", "repeat_share", "short_word_share", "long_word_share")

FEATURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            + ", ".join(f"{r} double" for r in RULES))


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words in ``window``-word windows that stand in the text twice or more, the first one included."""
    if len(words) <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    # exact numbers of ever longer windows: pairs of numbered parts are numbered again
    part, size = ids, 1
    while size < window:
        step = min(size, window - size)
        other = ids if step == 1 else part
        n = len(words) - size - step + 1
        part = np.unique(part[:n] * len(words) + other[size:size + n], return_inverse=True)[1].astype(np.int64)
        size += step
    twice = np.bincount(part)[part] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def features(text: str) -> tuple:
    """One row of ``FEATURES``."""
    # ASCII white space only: bytes split there, and nowhere inside a character
    words = [w.decode() for w in text.encode().split()]
    n = len(words)
    joined = "".join(words)
    chars = len(joined)
    symbols = len(SYMBOLS.findall(text))
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    if not n:
        return n, chars, symbols, dup, repeat, *[0.0] * len(RULES)
    marks, capitals = len(MARKS.findall(joined)), len(CAPITALS.findall(joined))
    sizes = np.fromiter(map(len, words), np.int64, n)
    return (n, chars, symbols, dup, repeat, min(1.0, symbols / chars), marks / chars,
            capitals / max(1, chars - marks), dup / max(1, len(lines)), repeat / n, float((sizes <= 2).mean()), float((sizes > 20).mean()))


def with_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``FEATURES`` of each row, without a shuffle."""
    arrow_batches(docs.sparkSession)
    names = [c.split()[0] for c in FEATURES.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.float64()] * len(RULES)

    @F.arrow_udf(FEATURES)
    def run(texts: pa.Array) -> pa.Array:
        process_cache("quality")  # nothing is kept, nor what the worker kept before
        rows = [features(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else
                                          [pa.array([], k) for k in kinds], names)

    return docs.select(*keep, run(F.coalesce(F.col(text), F.lit(""))).alias("__f")).select(*keep, "__f.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed in logarithms."""
    if n == 0 or k >= n:
        return 1.0
    log = n * math.log1p(-p)
    total, ratio = log, math.log(p) - math.log1p(-p)
    for i in range(1, k + 1):
        log += math.log(n - i + 1) - math.log(i) + ratio
        total = max(total, log) + math.log1p(math.exp(-abs(total - log)))
    return min(1.0, math.exp(total))


def certified(good: list[int], n_good: int, alpha: float, level: float) -> int:
    """How many cutoffs, from the lenient end, pass the sequence of tests; ``good[i]``: good documents beyond cutoff i."""
    for i, k in enumerate(good):
        if k > alpha * n_good or binomial_tail(k, n_good, alpha) > level:
            return i
    return len(good)


def thresholds(labelled: DataFrame, stratum: str = "stratum", good: str = "quality", alpha: float = ALPHA,
               delta: float = DELTA, price: float = PRICE) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule) from rows with the rules' features; a feature above its cutoff rejects."""
    def step(value: Column) -> Column:  # number of cutoffs that reject
        return F.size(F.filter(F.array(*map(F.lit, GRID)), lambda g: g < value))

    rows = (labelled.filter(f"{good} is not null")
            .select(stratum, good, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), step(F.col(r)).alias("step"))
                                                       for r in RULES])).alias("x"))
            .groupBy(stratum, good, "x.rule", "x.step").agg(F.count("*").alias("n")).collect())
    strata = sorted({r[stratum] for r in rows})
    level = delta / max(1, len(strata) * len(RULES))
    out = {}
    for s in strata:
        for rule in RULES:
            beyond = {0: [0] * len(GRID), 1: [0] * len(GRID)}
            total = {0: 0, 1: 0}
            for r in rows:
                if r[stratum] == s and r["rule"] == rule and r[good] in total:
                    total[r[good]] += r["n"]
                    # strict cutoffs stand last: a row beyond `step` cutoffs is beyond the last ones
                    for i in range(len(GRID) - r["step"], len(GRID)):
                        beyond[r[good]][i] += r["n"]
            sound = certified(beyond[1], total[1], alpha, level)
            gain = [beyond[0][i] - price * beyond[1][i] for i in range(sound)]
            if gain and max(gain) > 0:
                # among equals the most lenient
                out[s, rule] = GRID[gain.index(max(gain))]
    return out


def strata(labelled: DataFrame, column: str) -> list[str]:
    """The most common values of a column, at most ``MAX_STRATA - 1``."""
    top = labelled.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(MAX_STRATA - 1)
    return [r[column] for r in top.collect()]


def judged(featured: DataFrame, cutoffs: dict[tuple[str, str], float], stratum: str = "stratum") -> DataFrame:
    """Adds ``base_failed``, ``beyond`` (names of the rules that reject) and ``kept``."""
    broken = [F.lit(None).cast("string")]
    for rule in RULES:
        test = F.lit(False)
        for (s, r), cut in cutoffs.items():
            if r == rule:
                test = test | ((F.col(stratum) == s) & (F.col(rule) > cut))
        broken.append(F.when(test, F.lit(rule)))
    return (featured.withColumn("base_failed", base_failed())
            .withColumn("beyond", F.filter(F.array(*broken), lambda x: x.isNotNull()))
            .withColumn("kept", ~F.col("base_failed") & (F.size("beyond") == 0)))


def in_stratum(column: str, own: list[str]) -> Column:
    named = F.when(F.col(column).isin(own), F.col(column)) if own else F.lit(None)
    return F.coalesce(named.cast("string"), F.lit(OTHER)).alias("stratum")


def learn(featured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA):
    """Strata and cutoffs from ``featured`` (doc_id, stratum column, features) and ``labels`` (doc_id, quality).

    Labelled texts that fail the base rules never reach the cutoffs.
    """
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    holdout = featured.filter(~base_failed()).join(marks, "doc_id")
    own = strata(holdout, stratum)
    return own, thresholds(holdout.withColumn("stratum", in_stratum(stratum, own)), alpha=alpha, delta=delta)


def rate(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", alpha: float = ALPHA,
         delta: float = DELTA) -> DataFrame:
    """Features, ``base_failed``, ``beyond`` and ``kept`` of every row; texts are read once and never shuffled."""
    featured = written(with_features(docs, ("doc_id", stratum), text), "quality")
    own, cutoffs = learn(featured, labels, stratum, alpha, delta)
    return judged(featured.withColumn("stratum", in_stratum(stratum, own)), cutoffs)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", alpha: float = ALPHA,
              delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Features are computed twice, for learning and for judging, so that texts
    need no join with their verdicts.
    """
    narrow = written(with_features(docs, ("doc_id", stratum), text), "quality")
    own, cutoffs = learn(narrow, labels, stratum, alpha, delta)
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text"), in_stratum(stratum, own))
    rated = judged(with_features(whole, ("__row", "stratum"), "__text"), cutoffs)
    return rated.filter("kept").select("__row.*")
