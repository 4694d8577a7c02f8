"""Toxicity by non-negative positive-unlabelled learning.

The training set has two parts: confirmed toxic texts, and unlabelled texts of unknown kind. With the share of
toxic texts (the class prior) known, the risk on clean texts equals the risk of calling unlabelled texts toxic
less the prior times that of calling confirmed ones toxic. This difference may become negative on a finite
sample; whenever it does, the step goes the other way instead, so the estimate stays non-negative. The classifier
is linear and trained in numpy: its features are words and their first letters (4 to 6), hashed.

Only confirmed toxic texts, the unlabelled texts and the prior are used; labels 0 enter through the prior alone.
Fitting takes bounded samples (``most_positive``, ``most_unlabelled``, drawn by a hash of the id); every whole text
is scored. The sample's slots stay in a table: Spark counts them, the slots that tell the two parts apart are chosen from
the counts, and only these (at most ``MOST_USED``, the clearest first) come to the driver, as one number a text and slot.
What comes is bounded by the two samples and ``MOST_USED``, whatever the length of the texts.

Defined cases: a null, empty or wordless text gets the score of the bias alone, which is 0 where no confirmed
toxic text is at hand; of several labels for one document, any toxic one counts; labels without a document and
documents without a label are fine; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import chunks, crc_mod, materialise, table

SLOTS = 1 << 21
#: Most features of the classifier; a bound of the fit, as the sample's is.
MOST_USED = 20_000
#: ASCII characters that are no letters become spaces.
TO_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def words_of(text: str) -> set[str]:
    """The distinct words of a text, lower case."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(TO_SPACES)
    return set(data.decode("utf-8", "surrogatepass").split())


def features_of(word: str) -> list[int]:
    """Slots of a word: itself, and its first 4, 5 and 6 letters where it has more."""
    return [crc32(f"{n}|{word[:n]}".encode("utf-8", "surrogatepass")) % SLOTS for n in (4, 5, 6) if len(word) > n] + [
        crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
    ]


@dataclass
class Classifier:
    weights: np.ndarray  # float32, by slot
    bias: float

    def scorer(self, most: int = 300_000):
        """A function from texts to scores, with a table of word weights of bounded size."""
        known: dict[str, float] = {}
        weights = self.weights

        def weight(word: str) -> float:
            if len(known) >= most:
                known.clear()
            value = known[word] = float(weights[features_of(word)].sum())
            return value

        def score(texts: list[str | None]) -> list[float]:
            get = known.get
            sums = [self.bias + sum(v if (v := get(w)) is not None else weight(w) for w in words_of(t or "")) for t in texts]
            return [float(1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0)))) for z in sums]

        return score


def nnpu_step(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Derivatives of the non-negative risk by the outputs on confirmed and on unlabelled texts, and the risk.

    The loss is logistic: log(1 + exp(-y z)).
    """
    p, u = 1.0 / (1.0 + np.exp(-z_p)), 1.0 / (1.0 + np.exp(-z_u))
    as_clean = lambda z: np.logaddexp(0.0, z).mean() if z.size else 0.0
    clean = as_clean(z_u) - prior * as_clean(z_p)
    toxic = prior * (np.logaddexp(0.0, -z_p).mean() if z_p.size else 0.0)
    d_p, d_u = -prior * p / max(len(p), 1), u / max(len(u), 1)
    if clean < 0.0:
        return -d_p, -d_u, toxic
    return d_p + prior * (p - 1.0) / max(len(p), 1), d_u, toxic + clean


def telling(df_p: np.ndarray, df_u: np.ndarray, n_p: int, n_u: int, most: int = MOST_USED) -> np.ndarray:
    """Places of the features clearly more common among confirmed texts than chance has it, from the texts of each part
    that have them; the ratio can reach 1 / prior. Of more than ``most``, those furthest from chance are taken."""
    expected = (df_u + 0.5) * (n_p / max(n_u, 1))
    use = np.flatnonzero((df_p >= 3.0 * expected) & (df_p >= expected + 3.0 * np.sqrt(expected + 1.0) + 1.0))
    if use.size > most:
        far = (df_p[use] - expected[use]) / np.sqrt(expected[use] + 1.0)
        use = np.sort(use[np.argsort(-far, kind="stable")[:most]])
    return use


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400) -> Classifier:
    """Train on slots of confirmed toxic and of unlabelled texts (a slot stands once for each word that has it)."""
    df = [np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)]
    for part, count in zip((positive, unlabelled), df):
        for slots in part:
            count[slots] += 1  # once for each text, however often a slot stands in it
    n_p, n_u = len(positive), len(unlabelled)
    return descend(telling(*df, n_p, n_u), positive, unlabelled, prior, rounds)


def descend(
    use: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400
) -> Classifier:
    """Minimise the risk over the weights of the slots in ``use``."""
    weights = np.zeros(SLOTS, np.float32)
    if not positive or not unlabelled:
        return Classifier(weights, -500.0)
    n_p, n_u = len(positive), len(unlabelled)
    if not use.size:
        return Classifier(weights, float(np.log(prior / (1 - prior))))
    place = np.full(SLOTS, -1, np.int32)
    place[use] = np.arange(use.size)
    parts = []
    for part in (positive, unlabelled):
        kept = [at[at >= 0] for at in (place[slots] for slots in part)]
        parts.append((np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(x) for x in kept])))
    theta, bias = np.zeros(use.size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(use.size + 1), np.zeros(use.size + 1)
    for t in range(1, rounds + 1):
        z_p, z_u = (
            np.bincount(r, theta[f], n) + bias for (f, r), n in zip(parts, (n_p, n_u))
        )
        d_p, d_u, _ = nnpu_step(z_p, z_u, prior)
        grad = np.empty(use.size + 1)
        grad[:-1] = sum(np.bincount(f, d[r], use.size) for (f, r), d in zip(parts, (d_p, d_u))) + 1e-5 * theta
        grad[-1] = d_p.sum() + d_u.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta, bias = theta - step[:-1], bias - step[-1]
    weights[use] = theta
    return Classifier(weights, float(bias))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of each text, one for each word that has it; of one text at most ``SLOTS``, so a row has a bound."""
    for batch in chunks(batches):
        out = [_of_text(text or "").tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["confirmed", "slots"])


def _of_text(text: str) -> np.ndarray:
    found = np.array([x for w in words_of(text) for x in features_of(w)], np.int32)
    found.sort()
    return found if len(found) <= SLOTS else np.unique(found)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of confirmed and of unlabelled texts that have each slot, by task."""
    counts = np.zeros((2, SLOTS), np.int64)
    for batch in batches:
        for flag, of in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[0 if flag else 1][np.frombuffer(of.as_buffer(), np.int32)] += 1
    some = np.flatnonzero(counts.any(axis=0))
    for k in range(0, len(some), 1 << 16):
        at = some[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], ["slot", "p", "u"]
        )


def train(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    most_positive: int = 4000,
    most_unlabelled: int = 8000,
) -> Classifier:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both without the rows held out.

    ``prior`` defaults to the share of toxic ones among the labelled documents.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    if not toxic:
        return Classifier(np.zeros(SLOTS, np.float32), -500.0)
    prior = min(max(toxic / n, 1e-3), 0.9) if prior is None else prior
    n_docs = docs.agg(F.count(F.lit(1))).first()[0]
    drawn = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    confirmed = known.where("toxic > 0").where(drawn("p") < min(1.0, most_positive / toxic)).select("doc_id")
    cols = ["confirmed", "text"]
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(confirmed), "doc_id", "left_semi")  # at most about most_positive ids
        .select(F.lit(True).alias("confirmed"), "text")
        .unionByName(
            docs.where(drawn("u") < min(1.0, most_unlabelled / max(n_docs, 1))).select(F.lit(False).alias("confirmed"), "text")
        )
        .select(*cols)
    )
    slots = materialise(sample.mapInArrow(_slots, "confirmed boolean, slots binary"), "toxicity-sample")
    n_p, n_u = (int(x or 0) for x in slots.agg(*[F.count_if(F.col("confirmed") == flag) for flag in (True, False)]).first())
    counts = (
        slots.mapInArrow(_counted, "slot int, p bigint, u bigint").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    )
    # a feature of the model has at least 2 confirmed texts, and there are SLOTS slots at most
    got = counts.where("p >= 2").orderBy("slot").toArrow()
    slot, df_p, df_u = (got.column(k).to_numpy() for k in range(3))
    use = slot[telling(df_p, df_u, n_p, n_u)]
    shared = docs.sparkSession.sparkContext.broadcast(use)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            of = (np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(1))
            out = [x[np.isin(x, shared.value)].tobytes() for x in of]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["confirmed", "slots"])

    rows = [
        (flag, np.frombuffer(batch.column(1)[i].as_buffer(), np.int32))
        for batch in slots.mapInArrow(used, "confirmed boolean, slots binary").toArrow().to_batches()
        for i, flag in enumerate(batch.column(0).to_pylist())
    ]
    # the order in which tasks end must not matter to sums of floating-point numbers
    rows.sort(key=lambda row: row[1].tobytes())
    found = {flag: [of for kept, of in rows if kept is flag] for flag in (True, False)}
    return descend(use, found[True], found[False], prior)


def score_column(spark: SparkSession, model: Classifier, text: Column) -> Column:
    """Score of a text column; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for part in parts:
            yield pd.Series(score(part.tolist()), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def learn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Classifier:
    """Learn from the rows of ``docs`` and of the labels table whose crc32 of the id modulo 5 is not 0."""
    return train(
        docs.where(crc_mod("doc_id", 5) != 0),
        table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(spark, docs, sf_dir)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out.alias("held_out"),
        score_column(spark, model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns as they are."""
    return docs.where(score_column(spark, learn(spark, docs, sf_dir), docs["text"]) < 0.5)
