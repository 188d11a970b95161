"""Mixing by iterative proportional fitting: weights raked to marginals, then calibrated sampling.

Documents are counted into cells (source, language, topic) with their tokens. The cells' weights
are scaled to the target of each marginal in turn until all hold. As no document can be kept more
than once, both targets and rates are bounded: a value's target is at most what all its tokens come to
at the wanted share, the others of its dimension taking the rest, and a full cell leaves what it cannot
give to the other cells of its marginals in the next sweep. If the marginals contradict each other all
the same, the closest rates are used and the gaps are told by :func:`gaps`. A document is then kept
with the probability of its cell, by a hash of its id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import WORD, ship, written

DIMENSIONS = ("source", "lang", "topic")
#: What stands for null in a dimension.
MISSING = "(none)"
#: Cells that the task which rakes them takes; the counts of cells, not documents, go there.
MAX_CELLS = 1_000_000
#: A marginal holds if its shares are this near to their targets. Sweeps end when all hold, when
#: nothing moves any more, or after so many.
TOLERANCE, MAX_SWEEPS = 2e-3, 3000


def measures(text: Column) -> Column:
    """Struct of a text's words, characters, marks of code and digits; all 0 for null."""
    text = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return F.struct(
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.length(text).alias("chars"),
        without("{}[]()<>=;#$%&*|_/\\").alias("marks"),
        without("0123456789").alias("digits"),
    )


def topic_of(m: Column) -> Column:
    """A coarse topic from the make of a text (its measures): none, code, figures, notes, essay or book."""
    return (
        F.when(m["words"] == 0, "none")
        .when(20 * m["marks"] > m["chars"], "code")
        .when(20 * m["digits"] > m["chars"], "figures")
        .when(m["words"] < 200, "notes")
        .when(m["words"] < 1000, "essay")
        .otherwise("book")
    )


def chance(ident: Column, seed: int) -> Column:
    """A number in [0, 1) by the id alone, the same in any SQL: from the first 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(MISSING))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def target_shares(tokens: np.ndarray, values: np.ndarray, explicit: dict[str, float] | None, flatten: float) -> np.ndarray:
    """Share of each value of a dimension, adding up to 1 over the values that occur.

    Explicit weights if given (values without one share nothing), else the values' own shares
    raised to ``flatten``.
    """
    if explicit is None:
        wanted = np.where(tokens > 0, np.maximum(tokens, 1e-300) ** flatten, 0.0)
    else:
        wanted = np.array([float(explicit.get(v, 0.0)) for v in values])
        wanted = np.where(tokens > 0, wanted, 0.0)  # nothing can stand for a value without tokens
    total = wanted.sum()
    return wanted / total if total > 0 else wanted


def attainable(target: np.ndarray, tokens: np.ndarray, kept: float) -> np.ndarray:
    """``target`` where no value has more than all its tokens at the ``kept`` share of all; the others take the rest in proportion."""
    most = tokens / tokens.sum() / kept
    got, full = target.copy(), np.zeros(len(target), bool)
    while (over := ~full & (got > most)).any():
        full |= over
        rest = target[~full].sum()
        left = 1 - most[full].sum()
        got = np.where(full, most, target * (left / rest if rest > 0 else 0.0))
    return got


def raked(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], kept: float) -> tuple[np.ndarray, float]:
    """Rates in [0, 1] of the cells whose kept tokens fit ``kept`` of all times the targets, and the largest gap left.

    ``places`` gives each cell's value in each dimension. A rate is a product of one factor a value,
    cut at 1; each sweep scales the factors of every dimension to its targets.
    """
    goals = [kept * tokens.sum() * t for t in targets]
    factor, before = np.full(len(tokens), kept), None
    for _ in range(MAX_SWEEPS):
        for place, goal in zip(places, goals, strict=True):
            have = np.bincount(place, tokens * np.minimum(factor, 1.0), len(goal))
            scale = np.divide(goal, have, out=np.zeros(len(goal)), where=have > 0)
            factor = np.minimum(factor * scale[place], 1e12)
        rate = np.minimum(factor, 1.0)
        gap = largest_gap(tokens, places, targets, rate)
        if gap <= TOLERANCE / 20 or (before is not None and np.abs(rate - before).max(initial=0) < 1e-9):
            break
        before = rate
    return rate, gap


def largest_gap(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rate: np.ndarray) -> float:
    """The largest distance of a value's share of the kept tokens to its target."""
    kept = tokens * rate
    total = kept.sum()
    if total <= 0:
        return 1.0
    return max(float(np.abs(np.bincount(p, kept, len(t)) / total - t).max(initial=0)) for p, t in zip(places, targets, strict=True))


def keep_rates(cells: DataFrame, targets: dict[str, dict[str, float] | None], flatten: float, kept_share: float) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``rate``, what part of a cell's tokens stays, ``fits``, whether all
    marginals hold, and for each dimension ``target_<dimension>``, the target of the cell's value.

    Cells without tokens keep all their documents. One task takes all cells, which are as few as the
    values of the dimensions allow and do not grow with the documents; their number is checked.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(DIMENSIONS), ignore_index=True)
        tokens = pdf["tokens"].to_numpy(float)
        rate, gap, places, shares = np.ones(len(pdf)), 0.0, [], []
        for d in DIMENSIONS:
            values, place = np.unique(pdf[d].to_numpy(str), return_inverse=True)
            sums = np.bincount(place, tokens, len(values))
            share = target_shares(sums, values, targets.get(d), flatten)
            places.append(place)
            shares.append(attainable(share, sums, kept_share) if tokens.sum() > 0 else share)
            pdf[f"target_{d}"] = shares[-1][place]
        if tokens.sum() > 0:
            rate, gap = raked(tokens, places, shares, kept_share)
        pdf["rate"] = np.where(tokens > 0, rate, 1.0)
        pdf["fits"] = gap <= TOLERANCE
        return pdf[[*DIMENSIONS, "tokens", "rate", "fits", *[f"target_{d}" for d in DIMENSIONS]]]

    if (count := cells.count()) > MAX_CELLS:
        raise ValueError(f"{count} cells of source, language and topic; at most {MAX_CELLS}: give coarser values")
    schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", tokens long, rate double, fits boolean, " + ", ".join(f"target_{d} double" for d in DIMENSIONS)
    ship(cells.sparkSession)
    return cells.select(*DIMENSIONS, "tokens", F.lit(0).alias("one")).groupBy("one").applyInPandas(fit, schema)


def gaps(rates: DataFrame) -> DataFrame:
    """(dimension, value, target, share) of the kept tokens of :func:`keep_rates`: what the rates make of each target."""
    whole = rates.agg(F.sum(F.col("tokens") * F.col("rate")).alias("all"))  # one row
    out = None
    for d in DIMENSIONS:
        kept = rates.groupBy(F.col(d).alias("value")).agg(F.max(f"target_{d}").alias("target"), F.sum(F.col("tokens") * F.col("rate")).alias("k"))
        part = kept.join(F.broadcast(whole)).select(F.lit(d).alias("dimension"), "value", "target", F.try_divide("k", "all").alias("share"))
        out = part if out is None else out.union(part)
    return out


def measured(docs: DataFrame, keep: list[str], text: str = "text", topic: Column | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the struct ``__cell``: source, lang, topic and n_tokens (words).

    Nulls of a dimension count as the value '(none)'; a null or empty text has no tokens.
    """
    marked = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(d).alias(f"__{d}") for d in ("source", "lang")], measures(F.col(text)).alias("__m"), *([] if topic is None else [topic.alias("__topic")]))
    about = topic_of(F.col("__m")) if topic is None else F.col("__topic")
    part = lambda c, d: F.coalesce(c, F.lit(MISSING)).alias(d)
    cell = F.struct(part(F.col("__source"), "source"), part(F.col("__lang"), "lang"), part(about, "topic"), F.col("__m.words").alias("n_tokens"))
    return marked.select(*[F.col(f"`{c}`") for c in keep], cell.alias("__cell"))


def mix_measured(
    rows: DataFrame,
    targets: dict[str, dict[str, float] | None] | None = None,
    flatten: float = 0.5,
    kept_share: float = 0.7,
    seed: int = 7,
    ident: str = "doc_id",
) -> DataFrame:
    """The rows of :func:`measured` with the struct ``mix`` in place of ``__cell``; see :func:`mix`."""
    counted = rows.select("__cell.*").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    cells = written(keep_rates(written(counted, "counts"), targets or {}, flatten, kept_share), "rates")
    # one row per cell; Spark broadcasts them when it measures them small
    rates = cells.select(F.struct(*DIMENSIONS).alias("__key"), F.col("rate").alias("__rate"), F.col("fits").alias("__fits"))
    both = rows.withColumn("__key", F.struct(*[F.col(f"__cell.{d}").alias(d) for d in DIMENSIONS])).join(rates, "__key")
    out = F.struct(
        F.col("__cell.topic").alias("topic"),
        F.col("__cell.n_tokens").alias("n_tokens"),
        F.col("__rate").alias("rate"),
        F.when(F.col("__rate") > 0, 1 / F.col("__rate")).alias("weight"),
        (chance(F.col(ident), seed) < F.col("__rate")).alias("sampled"),
        F.col("__fits").alias("fits"),
    )
    return both.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("__cell", "mix")], out.alias("mix"))


def mix(docs: DataFrame, text: str = "text", topic: Column | None = None, **settings) -> DataFrame:
    """``docs`` with the struct column ``mix``: topic, n_tokens (words), rate, weight (1 / rate), sampled, fits.

    Marginals of source, lang and topic: ``targets`` per dimension, or the shares raised to
    ``flatten`` (1: as they are, 0: all alike), in both cases no more than all tokens of a value come to
    when ``kept_share`` of all stay. If the marginals contradict each other, ``fits`` is false on all
    rows and the rates are the closest. Cells without tokens keep all their documents.
    Repeated rows and rows with the same id share their fate. All rows come back; ``sampled`` tells
    which stay. Other columns are untouched, whatever their names; one named
    ``mix`` is replaced.
    ``settings`` are those of :func:`mix_measured`. The texts are scanned twice, for the counts and
    for the rows; a caller who needs no texts can write the rows of :func:`measured` instead.
    """
    return mix_measured(measured(docs, docs.columns, text, topic), **settings)
