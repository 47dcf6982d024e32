"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's vector is the mean of the embeddings of its words' hashed character n-grams; a linear
layer and a softmax give the languages' chances. Embeddings and layer are trained together by
stochastic gradient descent on a bounded sample of labelled documents; a parameter's steps shrink
with the gradients it has had, so that neither frequent nor rare subwords run away. A temperature
fitted on short windows of held-back rows calibrates the chances, and a threshold that parts known
from left-out languages rejects what none of the languages explains. As everything after the embeddings is linear, a word is worth one row of
sums, which is what predictions add up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm.common import holds

#: Labelled documents of each language that a model is trained on, about, by a hash of doc_id.
PER_LANG = 150
BUCKETS = 1 << 15
DIM = 16
UNKNOWN = "und"
#: Words of the windows that the temperature is fitted on, and of those that the threshold sees
#: beside whole texts.
SHORT, PART = 4, 12
#: Share of held-back rows and windows of known languages that has to pass at least.
PASS = 0.999
#: Groups of languages that are left out in turn at most, and windows a language these models learn from.
FOLDS, FOLD_WINDOWS = 8, 400
#: Words that a worker's cache holds before it starts anew.
CACHE = 1 << 18
_LETTERS = regex.compile(r"\p{L}+")


def subwords(word: str) -> list[int]:
    """Buckets of a word: its 3- and 4-grams between marks, and the word itself."""
    w = f"<{word}>"
    data = [w, *[w[i : i + 3] for i in range(len(w) - 2)], *[w[i : i + 4] for i in range(len(w) - 3)]]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in data]


def window_ids(text: str, size: int = 60) -> list[np.ndarray]:
    """Subword buckets of the windows of words that a whole text is cut into."""
    words = _LETTERS.findall(text.lower())
    return [np.array([b for w in words[i : i + size] for b in subwords(w)], np.int32) for i in range(0, len(words), size)]


@dataclass
class LanguageModel:
    langs: list[str]
    rows: np.ndarray  # for each bucket its embedding times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def chances(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Calibrated chances of texts, from their sums of bucket rows and numbers of buckets."""
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _fitted(fit: list[tuple[np.ndarray, int]], n_langs: int, seed: int, epochs: int, rate: float, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's embedding times the layer, and the bias, by gradient descent on windows."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((n_langs, DIM), np.float32), np.zeros(n_langs, np.float32)
    # sums of squared gradients: of each bucket's row, of the layer and the bias
    seen, seen_layer, seen_bias = np.full(BUCKETS, 1e-10, np.float32), np.full_like(layer, 1e-6), np.full_like(bias, 1e-6)
    done, total = 0, epochs * len(fit)
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for at in range(0, len(fit), batch):
            rows = [fit[i] for i in order[at : at + batch]]
            ids = np.concatenate([r[0] for r in rows])
            sizes = np.array([len(r[0]) for r in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(emb[ids], starts, axis=0) / sizes[:, None].astype(np.float32)
            z = hidden @ layer.T + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), [r[1] for r in rows]] -= 1
            error /= len(rows)
            step = np.float32(rate * (1 - done / total))
            back = (error @ layer / sizes[:, None]).astype(np.float32)
            slope, shift = error.T @ hidden, error.sum(axis=0)
            seen_layer += slope**2
            seen_bias += shift**2
            layer -= step * slope / np.sqrt(seen_layer)
            bias -= step * shift / np.sqrt(seen_bias)
            sort = np.argsort(ids, kind="stable")
            unique, first = np.unique(ids[sort], return_index=True)
            slopes = np.add.reduceat(np.repeat(back, sizes, axis=0)[sort], first, axis=0)
            seen[unique] += (slopes**2).mean(axis=1)
            emb[unique] -= step * slopes / np.sqrt(seen[unique])[:, None]
            done += len(rows)
    emb[seen <= np.float32(1e-10)] = 0  # subwords that no row has speak for no language
    return emb @ layer.T, bias.astype(np.float64)


def _sums(model: LanguageModel, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([model.rows[x].sum(axis=0) for x in ids], np.float64).reshape(len(ids), -1), np.array([len(x) for x in ids])


def train(examples: list[tuple[str, str]], seed: int = 1, epochs: int = 4, rate: float = 0.1, batch: int = 16) -> LanguageModel | None:
    """A model of (text, lang) rows; None without any usable row.

    All words of a row are learned from, in windows. Every fifth row calibrates, whole and in short
    windows: the temperature makes the chances of windows of ``SHORT`` words true, as whole rows are
    nearly all certain. For the threshold, languages are left out in turn: what a model without
    them says of their held-back rows is what an unknown language looks like, and the threshold is
    the median of that, but lets nearly all held-back rows and windows of known languages pass
    (``PASS``). Of text that is further from all languages than they are from each other less
    passes. With two languages none can be left out: what is a third of the way from a guess to
    certainty passes; with one every text with a letter is of it.
    """
    langs = sorted({lang for _, lang in examples})
    if not langs:
        return None
    index = {lang: i for i, lang in enumerate(langs)}
    fit, held = [], []
    for k, (text, lang) in enumerate(examples):
        own, y = window_ids(text), index[lang]
        if own and k % 5 == 4:
            held.append((text, y))
        elif own:
            fit.extend((ids, y) for ids in own)
    if not fit:
        return None
    rows, bias = _fitted(fit, len(langs), seed, epochs, rate, batch)
    model = LanguageModel(langs, rows, bias, 1.0, 0.0)
    held = held or [(text, index[lang]) for text, lang in examples if window_ids(text)]
    short = [(ids, y) for text, y in held for ids in window_ids(text, SHORT)]
    sums, n = _sums(model, [ids for ids, _ in short])
    y = np.array([k for _, k in short])

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(np.maximum(model.chances(sums, n)[np.arange(len(y)), y], 1e-12)).mean())

    model.temperature = min(np.geomspace(1 / 16, 16, 65).tolist(), key=loss)
    best = lambda m, texts, size: m.chances(*_sums(m, [ids for t in texts for ids in window_ids(t, size)])).max(axis=1)
    texts = [t for t, _ in held]
    parts, whole = best(model, texts, PART), best(model, texts, 1 << 30)
    most = min(float(np.quantile(whole, 1 - PASS)), float(np.quantile(parts, 1 - PASS)))
    unknown = []
    folds = min(len(langs), FOLDS) if len(langs) > 2 else 0
    for f in range(folds):
        kept = [k for k in range(len(langs)) if k % folds != f]
        place = {k: i for i, k in enumerate(kept)}
        some = [(ids, place[k]) for ids, k in fit if k in place]
        some = some[:: max(1, len(some) // (FOLD_WINDOWS * len(kept)))]
        other = LanguageModel([langs[k] for k in kept], *_fitted(some, len(kept), seed, 2, rate, batch), model.temperature, 0.0)
        strange = [t for t, k in held if k not in place]
        unknown += [best(other, strange, 1 << 30)] if strange else []
    guess = 1 / len(langs)
    if unknown:
        model.threshold = min(most, float(np.median(np.concatenate(unknown))))
    else:
        model.threshold = min(most, guess + (1 - guess) / 3) if len(langs) > 1 else 0.0
    return model


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """(text, lang) of about ``per_lang`` labelled documents a language, at most twice as many.

    Only documents whose crc32 of doc_id (as text) leaves 0 or 2 by 3 are taken, in the order of
    a hash of doc_id and text.
    """
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    known = known.where(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * per_lang / n))])
    turn = F.xxhash64(F.lit(11), "doc_id", "text")
    rows = known.where((F.pmod(turn, F.lit(1 << 30)) / F.lit(float(1 << 30))) < share[F.col("lang")])
    return [(r["text"], r["lang"]) for r in rows.orderBy(turn, "doc_id", "text").limit(2 * per_lang * len(sizes)).select("text", "lang").collect()]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; null doc_ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


class Predictor:
    """A model with its cache of words; one in each worker."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._new()

    def _new(self) -> None:
        self.place: dict[str, int] = {}
        self.values = np.zeros((1 << 12, len(self.model.langs) + 1), np.float32)

    def _learn(self, chunks: list[str]) -> None:
        ids, sizes = [], []
        for c in chunks:
            own = [b for w in _LETTERS.findall(c) for b in subwords(w)]
            ids.extend(own)
            sizes.append(len(own))
        first = len(self.place)
        while first + len(chunks) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        size = np.array(sizes)
        some = np.flatnonzero(size)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])[some]
            self.values[first + some, :-1] = np.add.reduceat(self.model.rows[np.array(ids)], starts, axis=0)
        self.values[first : first + len(chunks), -1] = size
        self.place.update(zip(chunks, range(first, first + len(chunks)), strict=True))

    def sums(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(len(self.model.langs) + 1)
        if len(self.place) > CACHE:
            self._new()
        chunks = text.lower().split()
        place = self.place.__getitem__
        try:
            at = list(map(place, chunks))
        except KeyError:
            self._learn([c for c in set(chunks) if c not in self.place])
            at = list(map(place, chunks))
        return self.values[at].sum(axis=0, dtype=np.float64) if at else np.zeros(len(self.model.langs) + 1)


_PREDICTORS: dict[int, Predictor] = {}


def predictor(token: int, shared: Broadcast) -> Predictor:
    """The predictor of this process, kept from task to task while the model is the same."""
    if token not in _PREDICTORS:
        _PREDICTORS.clear()
        _PREDICTORS[token] = Predictor(shared.value)
    return _PREDICTORS[token]


_TYPE = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predict_column(docs: DataFrame, model: LanguageModel | None) -> Column:
    """Struct (lang_pred, score, rejected) of ``docs.text``; the model is broadcast (2 MB)."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = zlib.crc32(model.rows.tobytes()) << 8 | len(model.langs)

    @F.arrow_udf(_TYPE)
    def predict(texts: pa.Array) -> pa.Array:
        holds("langid", _PREDICTORS.clear)
        own = predictor(token, shared)
        rows = np.array([own.sums(t.as_py()) for t in texts]).reshape(len(texts), -1)
        p = own.model.chances(rows[:, :-1], rows[:, -1])
        best, none = p.argmax(axis=1), rows[:, -1] == 0
        score = np.where(none, 0.0, p.max(axis=1))
        langs = [UNKNOWN if z else own.model.langs[b] for b, z in zip(best.tolist(), none.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(none | (score < own.model.threshold))], ["lang_pred", "score", "rejected"])

    return predict(F.col("text"))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document.

    Texts that are null or have no letter are ``und`` with score 0 and rejected, as is every text
    without a model (nothing to learn from). One row per row, repeated rows too; an empty table
    gives an empty result; further columns are left out. No shuffle.
    """
    return docs.select("doc_id", predict_column(docs, model).alias("p"), held_out(F.col("doc_id")).alias("held_out")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def drop_unknown(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents that the model does not reject, with all their columns, whatever their names.

    Texts that are null or without a letter are rejected, as is everything without a model; repeated
    rows all stay or go; an empty table stays empty. No shuffle.
    """
    return docs.where(~predict_column(docs, model)["rejected"])
