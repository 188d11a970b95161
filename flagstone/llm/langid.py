"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Inverse document frequencies are counted over all training documents. The weights are learnt by
follow-the-regularised-leader with elastic-net penalties on a bounded sample per language, and the
temperature of the probabilities on a part of it that the weights have not seen. Prediction scans
the whole texts once with the model broadcast; its size is that of the feature space.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagstone.llm.common import in_arrow, ship, written

#: Hashed features and the lengths of n-grams.
FEATURES, GRAMS = 1 << 15, (1, 2, 3)
#: Training documents per language, and languages; more languages are an error.
SAMPLE_PER_LANG, MAX_LANGS = 1000, 512
#: Bits of the order by which a step counts a language's rows: at most 256 counts a language and step.
RANGE_BITS = 8
#: Every so many-th sampled document sets the temperature instead of the weights.
CALIBRATION_EVERY = 5
#: What a text without a letter is said to be.
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole lower-cased text, each once, and 1 + log of their counts."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    digest, counts = np.zeros(len(chars), np.uint64), np.zeros(FEATURES)
    for n in range(1, max(GRAMS) + 1):
        digest = digest[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(n)
        if n in GRAMS and len(digest):
            mixed = (digest ^ (digest >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            counts += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, 1 + np.log(counts[found])


@dataclass
class Model:
    """Inverse document frequencies, weights per feature and language, and the temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Features with TF-IDF values of length 1."""
        found, tf = features(text)
        value = tf * self.idf[found]
        return found, value / max(np.linalg.norm(value), 1e-12)

    def scores(self, text: str) -> np.ndarray:
        found, value = self.vector(text)
        return value @ self.weights[found] + self.bias

    def probabilities(self, text: str) -> np.ndarray:
        return softmax(self.scores(text) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


@dataclass
class Ftrl:
    """Follow-the-regularised-leader for all languages at once; ``l1`` and ``l2`` make up the elastic net."""

    langs: int
    rate: float = 1.0
    smooth: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z = np.zeros((FEATURES + 1, self.langs))  # the last row is the bias, without penalties
        self.n = np.zeros((FEATURES + 1, self.langs))

    def weights(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        pull = np.where((rows == FEATURES)[:, None], 0.0, 1.0)
        w = -(z - np.sign(z) * self.l1 * pull) / ((self.smooth + np.sqrt(n)) / self.rate + self.l2 * pull)
        return np.where(np.abs(z) <= self.l1 * pull, 0.0, w)

    def learn(self, found: np.ndarray, value: np.ndarray, lang: int) -> None:
        rows, x = np.append(found, FEATURES), np.append(value, 1.0)
        w = self.weights(rows)
        slope = softmax(x @ w)
        slope[lang] -= 1
        g = x[:, None] * slope
        grown = self.n[rows] + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(self.n[rows])) / self.rate * w
        self.n[rows] = grown


def fit(sample: pd.DataFrame, idf: np.ndarray, passes: int = 3, seed: int = 3) -> Model:
    """The model of a bounded sample (text, lang, calibrate)."""
    langs = sorted(sample["lang"].unique())
    model = Model(langs, idf, np.zeros((FEATURES, len(langs))), np.zeros(len(langs)))
    number = {x: i for i, x in enumerate(langs)}
    seen = [(*model.vector(t), number[x]) for t, x in zip(sample["text"][~sample["calibrate"]], sample["lang"][~sample["calibrate"]], strict=True)]
    ftrl, rng = Ftrl(len(langs)), np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(seen)):
            ftrl.learn(*seen[i])
    every = ftrl.weights(np.arange(FEATURES + 1))
    model.weights, model.bias = every[:FEATURES], every[FEATURES]
    held = sample[sample["calibrate"]]
    if len(held):
        scores = np.stack([model.scores(t) for t in held["text"]])
        right = held["lang"].map(number).to_numpy()
        model.temperature = best_temperature(scores, right)
    return model


def best_temperature(scores: np.ndarray, right: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm.

    The right answer counts for (n + 1) / (n + 2), so that n right ones don't make the model certain.
    """
    n, langs = scores.shape
    target = np.full((n, langs), 1 / (n + 2) / max(langs - 1, 1))
    target[np.arange(n), right] = (n + 1) / (n + 2)

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - (target * s).sum(1)))

    low, high, part = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (feature, n), one row per feature and task: in how many texts it occurs; -1: the texts."""
    counts, texts = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts[features(text.as_py())[0]] += 1
            texts += 1
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(counts[found], texts))], names=["feature", "n"])


def sample_ends(rows: DataFrame) -> dict[str, int]:
    """For each language the value of ``order`` up to which its first SAMPLE_PER_LANG rows (lang, order) reach, or little more.

    Counts per range of ``order`` tell in which range the last of them lies; ranges that hold more
    than SAMPLE_PER_LANG rows are counted anew by finer ones. So no task gets the rows of a language, only
    their counts, and what is left of one is at most twice the sample, unless rows have equal orders.
    """
    # the order without its sign: as unsigned bits it sorts alike
    rows = rows.select("lang", F.col("order").bitwiseXOR(F.lit(-(2**63))).alias("bits"))
    ends: dict[str, int] = {}
    open_: dict[str, tuple[int, int]] | None = None  # language: range that holds the last row, rows wanted of it
    for width in range(RANGE_BITS, 65, RANGE_BITS):
        part = F.shiftrightunsigned("bits", 64 - width)
        if open_ is None:
            held, need = rows, F.lit(SAMPLE_PER_LANG).cast("long")
        else:
            wanted = rows.sparkSession.createDataFrame([(k, *v) for k, v in open_.items()], "lang string, range long, need long")
            held = rows.join(F.broadcast(wanted), "lang").filter(F.shiftrightunsigned("bits", 64 - width + RANGE_BITS) == F.col("range"))
            need = F.col("need")
        counts = held.groupBy("lang", part.alias("part"), need.alias("need")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("lang").orderBy("part"))
        reached = counts.withColumn("upto", upto).withColumn("enough", F.col("upto") >= F.col("need"))
        # the first range with enough rows, else the last one
        best = F.min(F.struct(~F.col("enough"), F.when(F.col("enough"), F.col("part")).otherwise(-F.col("part")), "part", "n", (F.col("need") - F.col("upto") + F.col("n")).alias("need")))
        found = reached.groupBy("lang").agg(best.alias("b")).select("lang", "b.part", "b.n", "b.need").limit(MAX_LANGS + 1).collect()
        if len(found) > MAX_LANGS:
            raise ValueError(f"over {MAX_LANGS} languages")
        open_ = {r["lang"]: (r["part"], r["need"]) for r in found if r["n"] > SAMPLE_PER_LANG and width + RANGE_BITS <= 64}
        ends |= {r["lang"]: (r["part"] + 1 << 64 - width) - 1 - 2**63 for r in found if r["lang"] not in open_}
        if not open_:
            break
    return ends


def train(labelled: DataFrame, order: Column) -> Model | None:
    """The model of ``labelled`` (text, lang); None if no text with a language has a letter.

    The sample are those with a letter of the first SAMPLE_PER_LANG rows of each language by
    ``order``, a long that spreads them evenly. How far that reaches is found without the texts.
    """
    ship(labelled.sparkSession)
    known = labelled.filter(F.col("lang").isNotNull()).select("lang", "text", order.alias("order"))
    counted = in_arrow(known.select("text").filter(F.col("text").rlike(r"\p{L}")), document_counts, "feature long, n long")
    counted = counted.groupBy("feature").agg(F.sum("n").alias("n"))
    last = sample_ends(known.select("lang", "order"))
    near = known.filter(F.col("text").rlike(r"\p{L}"))
    ends = known.sparkSession.createDataFrame(list(last.items()), "lang string, last long")
    near = near.join(F.broadcast(ends), "lang").filter(F.col("order") <= F.col("last"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    ranked = near.withColumn("place", place).filter(F.col("place") <= SAMPLE_PER_LANG)
    sample = written(ranked.select("text", "lang", (F.col("place") % CALIBRATION_EVERY == 0).alias("calibrate")), "sample")
    frequencies = written(counted, "frequencies").groupBy(F.lit(0).alias("one"))

    def fitted(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"model": []})
        total, counts = right["n"][right["feature"] < 0].sum(), np.zeros(FEATURES)
        known = right[right["feature"] >= 0]
        counts[known["feature"].to_numpy()] = known["n"].to_numpy()
        return pd.DataFrame({"model": [pickle.dumps(fit(left, np.log((1 + total) / (1 + counts)) + 1))]})

    # one task: the sample and the features are bounded by the parameters above
    models = sample.groupBy(F.lit(0).alias("one")).cogroup(frequencies).applyInPandas(fitted, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all, if None) with lang_pred and score, the probability of the prediction.

    A text that is null or has no letter is 'und' with score 1, and so is any text without a model,
    with score 0. Rows are judged one by one; only ``text`` is read. Columns
    named lang_pred or score are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            langs, scores = [], []
            for value in batch.column(len(names)):
                text = value.as_py()
                if not text or not _LETTER.search(text):
                    langs.append(UNKNOWN)
                    scores.append(1.0)
                elif model is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = model.probabilities(text)
                    langs.append(model.langs[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return in_arrow(rows, predicted, f"{fields}, lang_pred string, score double")
