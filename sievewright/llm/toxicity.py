"""Toxic spans by a linear-chain conditional random field, toxicity of documents from its marginals.

Labels are of documents, so tokens are labelled from a distance: a token is
toxic where it stands in a toxic text and its word, or a beginning of it, is
seen in toxic texts far more often than elsewhere. On such sentences a
two-state chain is trained by gradient ascent on its likelihood. Forward and
backward passes over every sentence of a text, however long, give each token's
marginal; their noisy-or and their sum, through a logistic curve fitted on other
labelled texts and moved to the labels' true shares, give the score of the
document, and the tokens over one half give its offending offsets.

Everything is learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, documents, fields, mix64, table, tidy
from .compression import fit_logistic, label_share, labelled_sample, remainder, to_share

SCORED = T.StructType(fields(("doc_id", T.LongType()), ("score", T.DoubleType())).fields + [T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])
#: Lengths of the beginnings of a word that are features.
BEGINNINGS = (3, 4, 5, 6)
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TOKEN = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
#: Added to the weight of a token that ends a sentence, so that one look-up gives both.
_END = 1000.0


def word_of(segment: bytes) -> str:
    return segment.strip(_SIGNS).decode("utf-8", "replace").lower()


def word_features(word: str) -> list[str]:
    if not word:
        return []
    return [f"={word}", *(word[:k] for k in BEGINNINGS if len(word) >= k), f"-{word[-3:]}"]


@dataclass(frozen=True)
class ToxicityModel:
    """weights: of features for the toxic state against the clean one; bias; moves: log potentials of a step from one state to the other; curve: of the document score."""

    weights: dict[str, float]
    bias: float
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    curve: list[float] = field(default_factory=lambda: [0.0] * 3)


def chains(ends: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where chains begin: at a document's first token and behind a sentence's end. stops: tokens up to the end of each document."""
    begin = np.zeros(len(ends) + 1, bool)
    begin[0] = True
    begin[np.flatnonzero(ends) + 1] = True
    begin[stops] = True
    return np.flatnonzero(begin[:-1])


def forward_backward(emission: np.ndarray, starts: np.ndarray, moves: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the marginal of the toxic state, its filtered probability, and the ratio of the backward messages. Chains go side by side, a step of all of them at a time."""
    m00, m01, m10, m11 = np.exp(np.asarray(moves))
    weight = np.exp(np.clip(emission, -30, 30))
    lengths = np.diff(np.append(starts, len(emission)))
    order = np.argsort(-lengths, kind="stable")
    first, lengths = starts[order], lengths[order]
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]) + 1)] if len(lengths) else []
    filtered, ratio = np.empty(len(emission)), np.ones(len(emission))
    for t in range(len(active) - 1):
        at = first[: active[t]] + t  # of chains with more than t tokens
        if t == 0:
            up = weight[at]
            filtered[at] = up / (1 + up)
        else:
            before = filtered[at - 1]
            up = ((1 - before) * m01 + before * m11) * weight[at]
            filtered[at] = up / ((1 - before) * m00 + before * m10 + up)
    for t in range(len(active) - 2, 0, -1):
        at = first[: active[t]] + t
        later = weight[at] * ratio[at]
        ratio[at - 1] = (m10 + m11 * later) / (m00 + m01 * later)
    marginal = filtered * ratio / (1 - filtered + filtered * ratio)
    return marginal, filtered, ratio


class Emissions(dict):
    """A segment's weight for the toxic state, plus _END where it ends a sentence; kept for a bounded number of segments."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self._weights, self._bias = model.weights, model.bias

    def __missing__(self, segment: bytes) -> float:
        if len(self) > 400_000:
            self.clear()
        get = self._weights.get
        w = self._bias + sum(get(f, 0.0) for f in word_features(word_of(segment)))
        w = min(30.0, max(-30.0, w)) + (_END if segment[-1] in b".!?" else 0.0)
        self[segment] = w
        return w


def document_features(marginal: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Per document: 1, log odds of the noisy-or of its tokens, sum of its marginals over the root of their number. A document without tokens has the least log odds and no sum."""
    x = np.zeros((len(stops), 3))
    x[:, 0] = 1
    x[:, 1] = -12
    lengths = np.diff(stops, prepend=0)
    some = np.flatnonzero(lengths)
    if len(some):
        begin = (stops - lengths)[some]
        p = np.clip(marginal, 1e-12, 1 - 1e-12)
        none = np.add.reduceat(np.log1p(-p), begin)
        x[some, 1] = np.clip(np.log(np.maximum(-np.expm1(none), 1e-12)) - none, -12, 12)
        x[some, 2] = np.add.reduceat(p, begin) / np.sqrt(lengths[some] + 1)
    return x


def read(texts: list[bytes], emissions: Emissions, moves: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens, and the number of tokens up to the end of each text."""
    cut = [t.split() for t in texts]
    stops = np.cumsum([len(c) for c in cut])
    get = emissions.__getitem__
    raw = np.concatenate([np.fromiter(map(get, c), float, len(c)) for c in cut]) if texts else np.zeros(0)
    if not len(raw):
        return raw, stops
    ends = raw > _END / 2
    return forward_backward(raw - _END * ends, chains(ends, stops), moves)[0], stops


def span_offsets(text: bytes, toxic: np.ndarray) -> list[list[int]]:
    """Start and end of toxic tokens in characters; neighbours are one span."""
    wanted = set(toxic.tolist())
    out: list[list[int]] = []
    last, chars, at = -2, 0, 0
    for k, m in enumerate(_TOKEN.finditer(text)):
        if k in wanted:
            start = chars + len(text[at : m.start()].decode("utf-8", "replace"))
            end = start + len(m[0].decode("utf-8", "replace"))
            chars, at = end, m.end()
            if k == last + 1:
                out[-1][1] = end
            else:
                out.append([start, end])
            last = k
    return out


def token_markers(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Features that toxic texts hold far more often than others do."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in zip(texts, toxic.tolist(), strict=True):
        seen[y].update({f for w in set(words) for f in word_features(w) if f[0] != "-"})
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    least = max(3, n_bad // 75)
    return {f for f, n in seen[1].items() if n >= least and (n / n_bad) / ((seen[0][f] + 1) / n_good) >= 20}


def without_near_copies(texts: list[list[bytes]]) -> list[int]:
    """Places of texts that share none of three least hashes of 5-word runs with an earlier one: words of a text with many copies are no sign of toxicity."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, words in enumerate(texts):
        h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        runs = sum(h[k : len(h) - 4 + k] * np.uint64(2 * k + 1) for k in range(5)) if len(h) >= 5 else h.sum(keepdims=True)
        least = {(k, int(mix64(runs + np.uint64(k)).min())) for k in range(3)}
        if seen.isdisjoint(least):
            kept.append(i)
        seen |= least
    return kept


def fit_chain(texts: list[list[bytes]], toxic: np.ndarray, max_sentences: int = 12_000, steps: int = 60) -> ToxicityModel:
    """The chain alone: features of labelled tokens, trained by gradient ascent with a ridge."""
    kept = without_near_copies(texts)
    texts, toxic = [texts[i] for i in kept], toxic[kept]
    words = [[word_of(s) for s in t] for t in texts]
    markers = token_markers(words, toxic)
    sentences: tuple[list, list] = ([], [])
    for segments, named, y in zip(texts, words, toxic.tolist(), strict=True):
        start = 0
        for i, s in enumerate(segments):
            if s[-1] in b".!?" or i == len(segments) - 1:
                run = named[start : i + 1]
                tags = [int(bool(y) and not markers.isdisjoint(word_features(w))) for w in run]
                sentences[any(tags)].append((run, tags))
                start = i + 1
    rng = np.random.default_rng(7)
    take = []
    for part in sentences:
        pick = rng.permutation(len(part))[: max_sentences // 2]
        take += [part[i] for i in np.sort(pick)]
    if not sentences[1]:
        return ToxicityModel({}, -6.0)
    counts = Counter(f for run, _ in take for w in run for f in word_features(w))
    names = [f for f, n in counts.items() if n >= 2]
    place = {f: i + 2 for i, f in enumerate(names)}  # 0: no feature, 1: bias
    width = len(BEGINNINGS) + 3
    index = np.zeros((sum(len(r) for r, _ in take), width), np.int64)
    index[:, 0] = 1
    for row, w in enumerate(w for run, _ in take for w in run):
        got = [place[f] for f in word_features(w) if f in place]
        index[row, 1 : 1 + len(got)] = got
    tags = np.array([t for _, ts in take for t in ts], float)
    starts = np.cumsum([0, *(len(r) for r, _ in take)])[:-1]
    inner = np.ones(len(tags), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    theta, moves = np.zeros(len(names) + 2), np.zeros(4)
    theta[1] = -3.0
    speed, drift = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4)
    seen_moves = np.bincount((2 * tags[inner - 1] + tags[inner]).astype(int), minlength=4)
    for step in range(1, steps + 1):
        emission = theta[index].sum(1)
        marginal, filtered, ratio = forward_backward(emission, starts, tuple(moves))
        gradient = np.bincount(index.ravel(), np.repeat(tags - marginal, width), minlength=len(theta)) - 0.05 * theta
        gradient[0] = 0
        before, now = filtered[inner - 1], np.exp(np.clip(emission[inner], -30, 30)) * ratio[inner]
        both = np.stack([(1 - before), (1 - before) * now, before, before * now]) * np.exp(moves)[:, None]
        both /= both.sum(0)
        whole = np.concatenate([gradient, seen_moves - both.sum(1) - 0.05 * moves])
        drift = 0.9 * drift + 0.1 * whole
        speed = 0.99 * speed + 0.01 * whole**2
        change = 0.3 * (drift / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
        theta, moves = theta + change[:-4], moves + change[-4:]
    kept = {f: round(float(theta[i]), 4) for f, i in place.items() if abs(theta[i]) >= 0.02}
    return ToxicityModel(kept, float(theta[1]), tuple(moves.tolist()))


def fit_sample(sample: list[tuple[int, bytes]], max_sentences: int = 12_000, share: float | None = None) -> ToxicityModel:
    """A model from (label, text): three of five texts train the chain, the others the curve. share: of label 1 where the model is used, that of the sample if None."""
    y = np.array([label for label, _ in sample], int)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return ToxicityModel({}, -12.0, curve=[float(np.log(p / (1 - p))), 0.0, 0.0])
    held = np.arange(len(sample)) % 5 >= 3
    if y[held].min(initial=1) == y[held].max(initial=0) or y[~held].min(initial=1) == y[~held].max(initial=0):
        held = np.ones(len(sample), bool)
    chain = fit_chain([sample[i][1].split() for i in (np.flatnonzero(~held) if not held.all() else range(len(sample)))], y[~held] if not held.all() else y, max_sentences)
    texts = [sample[i][1] for i in np.flatnonzero(held)]
    marginal, stops = read(texts, Emissions(chain), chain.moves)
    curve = to_share(fit_logistic(document_features(marginal, stops), y[held].astype(float), ridge=0.1), y[held], share)
    return ToxicityModel(chain.weights, chain.bias, chain.moves, curve.tolist())


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", usable: Column | None = None, per_label: int = 2500, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 32_768, max_sentences: int = 12_000) -> ToxicityModel:
    """A model from at most per_label labelled texts of each label, of a longer text the max_bytes in its middle, and at most max_sentences sentences, half of them with offending words and half without (documented bounds; scoring has none). An offence outside a long text's middle is not learned from."""
    usable = F.lit(True) if usable is None else usable
    sample = labelled_sample(docs, labels, label_col, usable, per_label, id_col, text_col, max_bytes)
    return fit_sample([(label, text) for _, label, text in sample], max_sentences, label_share(labels, label_col, usable, id_col))


def _scored(broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        emissions = Emissions(model)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            marginal, stops = read(texts, emissions, model.moves)
            scores = 1 / (1 + np.exp(-np.clip(document_features(marginal, stops) @ np.array(model.curve), -30, 30)))
            spans: list[list[list[int]]] = [[] for _ in texts]
            toxic = np.flatnonzero(marginal >= 0.5)
            owner = np.searchsorted(stops, toxic, side="right")
            for d in np.unique(owner).tolist():
                spans[d] = span_offsets(texts[d], toxic[owner == d] - (int(stops[d - 1]) if d else 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=SCORED.names)

    return score


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score (0 to 1), spans (start and end of offending words, in characters of the text). Whole texts count. A null or empty text has no token: its score is the curve's value for that, without spans. Repeated rows are scored one by one; other columns are not read; an empty table gives an empty result."""
    return chosen(docs, id_col, text_col).mapInArrow(tidy(_scored(docs.sparkSession.sparkContext.broadcast(model)), 256), SCORED)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans, and spans: start-end of each offending stretch, in characters, with commas between."""
    docs = documents(spark, sf_dir)
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 4) != 2)
    scored = toxicity(docs, model)
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s[0].cast("string"), s[1].cast("string"))), ",")
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), offsets.alias("spans"))
