"""Quality by compression: how much better a text shrinks with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from a bounded sample of labelled texts,
one for each label. A text is cut into blocks and every block is compressed
with each dictionary. The difference of the two sums over the text's bytes is
its normalised difference. A logistic curve fitted on other labelled rows of
the bounded sample, and moved from the sample's shares of the labels to their
shares among all labelled rows, turns it into a score from 0 to 1: an estimate
of the probability of a good text. As the difference says nothing of a text of
a few bytes, it counts less the shorter a text is, and how short it is is the
curve's other term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, documents, fields, table, tidy

SCORED = fields(("doc_id", T.LongType()), ("score", T.DoubleType()))
#: Bytes of a block, each compressed by itself, so that the dictionaries count as much at the end of a long text as at its start.
BLOCK = 256
#: Bytes of a piece of text in a dictionary; bytes of a text whose difference counts half.
PIECE, HALF = 500, 64


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: list[float] = field(default_factory=lambda: [0.0] * 3)

    def score(self, sizes: np.ndarray) -> np.ndarray:
        """sizes: [text, (n_bytes, good, bad)]."""
        return 1 / (1 + np.exp(-np.clip(features(sizes) @ np.array(self.weights), -30, 30)))


def features(sizes: np.ndarray) -> np.ndarray:
    """1, the normalised difference (in tenths), and how short the text is."""
    n, good, bad = np.asarray(sizes, float).reshape(-1, 3).T
    return np.column_stack([np.ones_like(n), 10 * (bad - good) / (n + HALF), HALF / (n + HALF)])


class Sizer:
    """Compressed sizes of texts under a model's dictionaries."""

    def __init__(self, model: CompressionModel, level: int = 9):
        import zstandard

        flags = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}

        def by(data: bytes):
            if not data:
                return zstandard.ZstdCompressor(**flags).compress
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=level)
            return zstandard.ZstdCompressor(dict_data=dictionary, **flags).compress

        self._good, self._bad = by(model.good), by(model.bad)

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        good = bad = 0
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            good += len(self._good(block))
            bad += len(self._bad(block))
        return len(text), good, bad


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """A raw dictionary of at most size bytes: as many pieces of each text, from places spread by a fixed seed."""
    texts = [t for t in texts if t]
    if not texts:
        return b""
    rng = np.random.default_rng(1)
    share = max(1, size // PIECE // len(texts))
    parts = []
    for i in rng.permutation(len(texts)):
        t = texts[i]
        for at in rng.integers(0, max(1, len(t) - PIECE), min(share, -(-len(t) // PIECE))):
            parts.append(t[at : at + PIECE])
    return b"\n".join(parts)[-size:]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60, weights: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for a logistic curve with a small ridge; weights of rows, if they are not all one."""
    w = np.zeros(x.shape[1])
    each = np.ones(len(y)) if weights is None else weights
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (each * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _known(labels: DataFrame, label_col: str, usable: Column, id_col: str) -> DataFrame:
    return labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna().filter(usable).groupBy("doc_id").agg(F.min("label").alias("label"))


def label_share(labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id") -> float | None:
    """The share of label 1 among the ids with a label 0 or 1, None without any."""
    n = {r["label"]: r["count"] for r in _known(labels, label_col, usable, id_col).filter("label IN (0, 1)").groupBy("label").count().collect()}
    return n.get(1, 0) / sum(n.values()) if n else None


def to_share(curve: np.ndarray, y: np.ndarray, share: float | None) -> np.ndarray:
    """A curve fitted where y has some share of ones, for a share as given: the log odds move by the difference of the two."""
    own = float(np.mean(y))
    if share is None or not 0 < share < 1 or not 0 < own < 1:
        return curve
    return np.concatenate([curve[:1] + np.log(share / (1 - share)) - np.log(own / (1 - own)), curve[1:]])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, per_label: int, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 16_384) -> list[tuple[int, int, bytes]]:
    """(id, label, text) of at most per_label rows of each label, those whose id hashes lowest; of a longer text max_bytes from its middle, so the whole sample has a size bound. An id with more than one label takes the smallest, an id with more than one text the one whose middle sorts first: a row of each id comes to the driver. Rows without an id, label or text are left out."""
    known = _known(labels, label_col, usable, id_col)
    order = F.xxhash64("doc_id", F.lit("labelled"))
    ids = known.filter("label = 0").orderBy(order, "doc_id").limit(per_label).unionByName(known.filter("label = 1").orderBy(order, "doc_id").limit(per_label))
    text = F.encode(F.col("text"), "UTF-8")
    start = F.greatest(F.lit(1), ((F.octet_length("text") - max_bytes) / 2).cast("int") + 1)
    rows = chosen(docs, id_col, text_col).dropna().join(F.broadcast(ids), "doc_id").select("doc_id", "label", F.substring(text, start, F.lit(max_bytes)).alias("text"))
    return sorted((r["doc_id"], r["label"], bytes(r["text"])) for r in rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect())


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None, per_label: int = 2000, dictionary_bytes: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> CompressionModel:
    """A model from at most per_label labelled texts of each label (a documented bound): half of them for the dictionaries, the others for the curve, which is then moved to the shares of the labels among all labelled rows. Without both labels the score is the share of label 1 in the sample, or 0.5 without any."""
    usable = F.lit(True) if usable is None else usable
    sample = labelled_sample(docs, labels, label_col, usable, per_label, id_col, text_col)
    return fit_sample([(label, text) for _, label, text in sample], dictionary_bytes, label_share(labels, label_col, usable, id_col))


def fit_sample(sample: list[tuple[int, bytes]], dictionary_bytes: int = 1_000_000, share: float | None = None) -> CompressionModel:
    """A model from (label, text); share: of label 1 where the model is used, that of the sample if None."""
    y = np.array([label for label, _ in sample], float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return CompressionModel(b"", b"", [float(np.log(p / (1 - p))), 0.0, 0.0])
    held = np.arange(len(sample)) % 2 == 0
    good, bad = (build_dictionary([t for (label, t), h in zip(sample, held, strict=True) if h and label == want], dictionary_bytes) for want in (1, 0))
    sizer = Sizer(CompressionModel(good, bad))
    rest = [s for s, h in zip(sample, held, strict=True) if not h] or sample
    if len({label for label, _ in rest}) < 2:
        rest = sample
    x, y = features(np.array([sizer.sizes(t) for _, t in rest])), np.array([label for label, _ in rest], float)
    return CompressionModel(good, bad, to_share(fit_logistic(x, y), y, share).tolist())


def _scored(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.value)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            got = model.value.score(np.array([sizer.sizes(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=SCORED.names)

    return score


def quality_scores(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score (0 to 1, higher: better). Whole texts count. Null and empty texts have no compressed size and get the curve's value for the shortest text. Repeated rows are scored one by one; other columns are not read; an empty table gives an empty result."""
    return chosen(docs, id_col, text_col).mapInArrow(tidy(_scored(docs.sparkSession.sparkContext.broadcast(model))), SCORED)


def accepted(docs: DataFrame, model: CompressionModel, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of docs with a score of at least `least`, all columns as they were. Rows stream through: nothing shuffles."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(broadcast.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(text_col), "").cast(pa.binary()).to_pylist()
            if texts:
                yield batch.filter(pa.array(broadcast.value.score(np.array([sizer.sizes(t) for t in texts])) >= least))

    return docs.mapInArrow(tidy(keep), docs.schema)


def remainder(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % modulus


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 5) != 0)
    return quality_scores(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
