"""Toxicity: a linear classifier whose scores must not change when identity terms are swapped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.llm.arrow_columns import text_slices, with_text_columns
from faultscope.llm.names import fresh

# Terms for groups of people, by what can be swapped. A neutral word is in each list, so that a mere
# mention must score as a text without one.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "transgender"),
    ("person", "woman", "man", "girl", "boy"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("people", "gays", "lesbians", "heterosexuals", "bisexuals"),
    ("straight", "gay", "lesbian", "heterosexual", "bisexual", "queer"),
    ("human", "black", "white", "asian", "african", "european", "american", "latino", "arab"),
    ("people", "immigrants", "refugees", "foreigners", "natives"),
    ("person", "immigrant", "refugee", "foreigner", "native"),
    ("abled", "disabled", "blind", "deaf", "autistic"),
    ("aged", "old", "young", "elderly"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
# Beginnings and ends of words that are features of their own, by length.
BEGINNINGS = (4, 5, 6)
ENDS = (5,)


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the sample of labelled rows in expectation; if there are fewer, all are used."""

    max_rows: int = 20_000
    max_features: int = 3_000
    min_strength: float = 2.2
    shrinkage: float = 1e-4
    swap_penalty: float = 2.0
    rounds: int = 400
    seed: int = 5


def word_set(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features_of(words: set[str]) -> set[tuple[int, str]]:
    """Features of a set of words: (0, word), (n, its first n letters), (-n, its last n letters)."""
    found = {(0, w) for w in words}
    for n in BEGINNINGS:
        found.update((n, w[:n]) for w in words if len(w) > n)
    for n in ENDS:
        found.update((-n, w[-n:]) for w in words if len(w) > n)
    return found


def swapped_sentences(text: str | None, groups: Sequence[Sequence[str]]) -> Iterator[tuple[set[str], set[str]]]:
    """Word sets of each sentence that names a group of people, before and after each swap of its terms."""
    lists = {term: group for group in groups for term in group[1:]}
    for sentence in SENTENCE.split(text.lower()) if text else ():
        words = set(WORD.findall(sentence))
        for term in sorted(words & lists.keys()):
            for other in lists[term]:
                if other != term:
                    yield words, words - {term} | {other}


class Lexicon:
    """Feature numbers, looked up kind by kind."""

    def __init__(self, features: Sequence[tuple[int, str]]):
        self.words = {f: i for i, (kind, f) in enumerate(features) if kind == 0}
        self.beginnings = [(n, {f: i for i, (kind, f) in enumerate(features) if kind == n}) for n in BEGINNINGS]
        self.ends = [(n, {f: i for i, (kind, f) in enumerate(features) if kind == -n}) for n in ENDS]

    def present(self, words: set[str]) -> list[int]:
        found = {i for i in map(self.words.get, words) if i is not None}
        for n, table in self.beginnings:
            if table:
                found.update(table[p] for p in {w[:n] for w in words if len(w) > n} & table.keys())
        for n, table in self.ends:
            if table:
                found.update(table[p] for p in {w[-n:] for w in words if len(w) > n} & table.keys())
        return sorted(found)


@dataclass(frozen=True)
class Model:
    features: tuple[tuple[int, str], ...]
    weights: tuple[float, ...]
    bias: float

    def scorer(self):
        """Function from texts to scores between 0 and 1."""
        lexicon, weights = Lexicon(self.features), self.weights

        def score(texts: list[str | None]) -> list[list[float]]:
            sums = [self.bias + sum(weights[i] for i in lexicon.present(word_set(t))) for t in texts]
            return [[1 / (1 + np.exp(-min(max(s, -40.0), 40.0))) for s in sums]]

        return score


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: crc32 of the key as text is divisible by five."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, label, text) of labelled rows that may be learned from, ``max_rows`` in expectation.

    The sample's ids go to all tasks, as their number is bounded. Of rows that share an id one teaches, the
    one with the least hash of its text; they collapse before they meet, so the bound holds for rows.
    """
    named = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    named = named.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("label"))
    named = named.filter(~held_out(F.col("labelled")))
    n = named.count()
    if n > settings.max_rows:
        draw = F.pmod(F.xxhash64("labelled", F.lit(settings.seed)), F.lit(1_000_000)) / 1_000_000
        named = named.filter(draw < settings.max_rows / n)
    texts = documents.select("doc_id", "text")
    met = texts.join(F.broadcast(named), F.col("doc_id") == F.col("labelled"))
    first = F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")).alias("text")
    return met.groupBy("doc_id").agg(F.max("label").alias("label"), first).select("doc_id", "label", "text")


def select_features(sample: DataFrame, settings: Settings) -> list[tuple[int, str]]:
    """The features whose log odds between both labels are farthest from 0, in units of their error."""
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = iter(batch.column("label").to_pylist())
            for part in text_slices(batch.column("text").to_pylist()):
                found = (Counter(), Counter())
                for text in part:
                    found[next(labels)].update(features_of(word_set(text)))
                rows = [(kind, f, found[1][kind, f], found[0][kind, f]) for kind, f in found[0].keys() | found[1].keys()]
                if rows:
                    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
                    arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["kind", "feature", "toxic", "clean"])

    each = sample.select("label", "text").mapInArrow(run, "kind int, feature string, toxic long, clean long")
    each = each.groupBy("kind", "feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    c, d = F.lit(toxic + 0.5) - F.col("a"), F.lit(clean + 0.5) - F.col("b")
    strength = (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    each = each.withColumn("strength", F.abs(strength)).filter(F.col("strength") >= settings.min_strength)
    best = each.orderBy(F.desc("strength"), "kind", "feature").limit(settings.max_features)
    return [(r["kind"], r["feature"]) for r in best.collect()]


def _encoded(sample: DataFrame, features: list[tuple[int, str]], groups: Sequence[Sequence[str]]) -> list:
    """(doc_id, label, feature numbers, feature numbers before and after each swap) of the sample's rows."""

    def start():
        lexicon = Lexicon(features)

        def encode(texts: list[str | None]) -> list[list]:
            present = [lexicon.present(word_set(t)) for t in texts]
            swaps = []
            for text in texts:
                changes = Counter()
                for before, after in swapped_sentences(text, groups):
                    old, new = set(lexicon.present(before)), set(lexicon.present(after))
                    if old != new:
                        changes[tuple(sorted(old - new)), tuple(sorted(new - old))] += 1
                swaps.append([{"lost": x, "won": y, "n": n} for (x, y), n in sorted(changes.items())])
            return [present, swaps]

        return encode

    numbers = T.ArrayType(T.IntegerType())
    swap = T.StructType([T.StructField("lost", numbers), T.StructField("won", numbers), T.StructField("n", T.LongType())])
    fields = [T.StructField("present", numbers), T.StructField("swaps", T.ArrayType(swap))]
    rows = with_text_columns(sample, "text", fields, start).select("doc_id", "label", "present", "swaps").collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["present"]))


def _rows_and_columns(lists: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.array([i for x in lists for i in x], np.int64)


def fit_weights(
    present: list[Sequence[int]], labels: Sequence[int], swaps: list[tuple], n_features: int, settings: Settings
) -> tuple[np.ndarray, float]:
    """Weights and bias with the least logistic loss plus shrinkage plus the squared score changes of swaps.

    Both labels count alike. Each swap is (feature numbers lost, won, how often). Adam over all rows.
    """
    y = np.array(labels, float)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    rows, columns = _rows_and_columns(present)
    often = np.array([n for *_, n in swaps], float)
    often = often / often.sum() if len(often) else often
    lost, lost_columns = _rows_and_columns([s[0] for s in swaps])
    won, won_columns = _rows_and_columns([s[1] for s in swaps])
    w = np.zeros(n_features + 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, settings.rounds + 1):
        z = w[-1] + np.bincount(rows, w[columns], len(y))
        off = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        slope = np.append(np.bincount(columns, off[rows], n_features), off.sum())
        slope[:-1] += settings.shrinkage * w[:-1]
        if len(often):
            change = np.bincount(won, w[won_columns], len(often)) - np.bincount(lost, w[lost_columns], len(often))
            pull = 2 * settings.swap_penalty * often * change
            slope[:-1] += np.bincount(won_columns, pull[won], n_features) - np.bincount(lost_columns, pull[lost], n_features)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    documents: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> Model:
    """A classifier from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Features are words and the beginnings and ends of words, each once per text, chosen by their
    log odds. The loss adds the squared change of the score of every sentence of the sample that
    names a group of people, when the term is swapped for another of its list. Only the bounded
    sample's feature numbers reach the driver. Without labels of both kinds the model is a constant
    that rejects nothing. Rows with null or other labels or null ids teach nothing; a document labelled twice
    is toxic if one of its labels says so.
    """
    sample = training_sample(documents, labels, settings)
    features = select_features(sample, settings)
    rows = _encoded(sample, features, groups)
    if len({r["label"] for r in rows}) < 2:
        return Model((), (), -3.0)
    swaps = [(s["lost"], s["won"], s["n"]) for r in rows for s in r["swaps"]]
    weights, bias = fit_weights([r["present"] for r in rows], [r["label"] for r in rows], swaps, len(features), settings)
    return Model(tuple(features), tuple(float(w) for w in weights), bias)


def score_texts(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the toxicity score (0 to 1) of every whole text; null texts count as empty. No shuffle."""
    return with_text_columns(documents, text, [T.StructField(name, T.DoubleType())], model.scorer)


def drop_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    [name] = fresh(documents, "toxicity")
    scored = score_texts(documents, model, name=name)
    return scored.filter(F.col(name) < threshold).select(*documents.columns)
