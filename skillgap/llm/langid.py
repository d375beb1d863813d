"""Language identification by a mixture of languages.

A model is one n-gram distribution per language, over byte trigrams of the
letters (A-Z lower-cased; digits, marks and control characters count as spaces,
which stand once between words) hashed into ``BUCKETS`` buckets. It is counted
over all labelled rows given.

A text's n-grams are taken as drawn from a mixture of the languages. Expectation
maximisation finds the proportions; the set of languages is the one of best
penalised likelihood, each further language costing ``PENALTY * log(n)``, with
candidates taken in order of their proportions. The prediction is the set's
largest proportion, of equals the first name; its score is that proportion.

A null text or one without a letter is ``und`` with score 0, and so is any text
if no language was learnt. Repeated rows and null ids give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 15
ROUNDS = 25
PENALTY = 4.0
UNKNOWN = "und"
#: Languages that a model may have: each has an array of ``BUCKETS`` numbers in every task.
MOST_LANGUAGES = 512
#: Bytes that count as spaces: everything ASCII but letters.
_MAP = np.arange(256, dtype=np.uint8)
_MAP[:128] = 32
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)


def codes(data: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of UTF-8 bytes, with a space before and behind."""
    b = np.empty(len(data) + 2, np.uint8)
    b[0] = b[-1] = 32
    b[1:-1] = _MAP[data]
    space = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    b = b[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    mixed = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(17)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and bucket, one row per task and pair."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, np.int64)
            found = codes(np.frombuffer(text.as_buffer(), np.uint8))
            counts[lang] += np.bincount(found, minlength=BUCKETS)
    for lang, found in counts.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], names=["lang", "bucket", "n"]
        )


class Model:
    """Names of the languages, in order, and log probabilities by bucket and language."""

    def __init__(self, counts: dict[str, np.ndarray], smooth: float = 0.5):
        self.names = sorted(counts)
        table = np.array([counts[n] for n in self.names], np.float64).reshape(len(self.names), BUCKETS) + smooth
        self.p = np.ascontiguousarray((table / table.sum(axis=1, keepdims=True)).T)

    def proportions(self, text: str) -> tuple[np.ndarray, float]:
        """The proportions over the chosen set, and the likelihood a n-gram, as a logarithm."""
        found = np.bincount(codes(np.frombuffer(text.encode(), np.uint8)), minlength=BUCKETS)
        at = np.flatnonzero(found)
        weight = found[at].astype(np.float64)
        n = weight.sum()
        p = self.p[at]
        share, _ = _em(p, weight, np.full(len(self.names), 1 / len(self.names)))
        order = np.lexsort((np.arange(len(share)), -share))
        best, out = -np.inf, share
        for size in range(1, len(order) + 1):
            if size > 1 and share[order[size - 1]] < 1e-3:
                break
            chosen = order[:size]
            part, likelihood = _em(p[:, chosen], weight, share[chosen] / share[chosen].sum())
            value = likelihood - (size - 1) * PENALTY * np.log(n)
            if value <= best:
                break
            best, out = value, np.zeros(len(share))
            out[chosen] = part
        return out, best / n


def _em(p: np.ndarray, weight: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    n = weight.sum()
    if p.shape[1] > 1:
        for _ in range(ROUNDS):
            after = share * ((weight / (p @ share)) @ p) / n
            moved = np.abs(after - share).max()
            share = after
            if moved < 1e-3:
                break
    return share, float(weight @ np.log(p @ share))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of every language in the rows; null texts and languages are left out.

    More than ``MOST_LANGUAGES`` languages are refused.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    counted = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS rows a language, whatever the number of texts.
    counts: dict[str, np.ndarray] = {}
    for r in counted.toArrow().to_batches():
        for name, bucket, n in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_pylist()):
            counts.setdefault(name, np.zeros(BUCKETS, np.int64))[bucket] = n
    return Model(counts)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predict(names: list[str], p: np.ndarray, at: int, added: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model({})
        model.names, model.p = names, p
        for batch in batches:
            langs, scores = [], []
            for value in batch.column(at):
                text = value.as_py()
                if not names or not text or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                share, _ = model.proportions(text)
                best = int(share.argmax())
                langs.append(names[best])
                scores.append(min(1.0, float(share[best])))
            arrays = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *added])

    return run


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the columns ``lang`` and ``score``."""
    schema = T.StructType([*df.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return df.mapInArrow(_predict(model.names, model.p, df.columns.index(text), (lang, score)), schema)


def _mixtures(names: list[str], p: np.ndarray, at: int, added: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model({})
        model.names, model.p = names, p
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            found = []
            for value in batch.column(at):
                text = value.as_py()
                share = model.proportions(text)[0] if names and text and has_letter(text) else np.zeros(0)
                order = np.lexsort((np.arange(len(share)), -share)).tolist()
                found.append([{"lang": names[i], "share": float(share[i])} for i in order if share[i] > 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, added])

    return run


def mixtures(df: DataFrame, model: Model, text: str = "text", name: str = "languages") -> DataFrame:
    """``df`` with each text's set of languages and their proportions, the largest first; empty where ``predict`` says ``und``."""
    kind = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    return df.mapInArrow(_mixtures(model.names, model.p, df.columns.index(text), name), schema)


def held_out(key: Column, parts: int, left: int) -> Column:
    """Rows kept from learning; a null id is never among them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == left, F.lit(False))


def language_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` per row; learns from the rows not held out."""
    out = held_out(F.col(key), 4, 2)
    model = learn(docs.filter(~out), text, lang)
    rows = docs.select(F.col(key).alias("doc_id"), out.alias("held_out"), F.col(text).alias("__text"))
    return predict(rows, model, "__text").select("doc_id", "held_out", "lang_pred", "score")
