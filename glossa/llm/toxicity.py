"""Toxicity by compression distance under two zstandard dictionaries.

Both dictionaries come from labelled text: one is trained on ordinary phrases,
one holds, as raw content, the wording that sets toxic texts apart (words whose
document frequency among toxic texts is well above that among ordinary ones, the
most telling up to TOXIC_BYTES). The ordinary model compresses with the first, the
toxic model with both, so what they share costs the same and the difference of
the two compressed lengths is what the toxic wording explains. The library's
trainer makes no such dictionary: it cuts short words up between its segments
(the README has the figures).
Windows are single words between a carrier that both know (it pays for the
block's fixed cost) and a tail (zstandard looks for no match in the last eight
bytes). A window's saving is the difference over its length; a text is scored
by how many windows reach each of LEVELS, through a logistic calibration fitted
on labelled texts that the dictionaries haven't seen.

The fit uses a bounded sample of labelled rows, FIT_TOXIC and FIT_ORDINARY
expected, and fewer where these would hold more than FIT_CHARS characters,
chosen by hash, and FIT_PHRASES of their phrases; scoring is one map over all
whole texts. Windows repeat, so a worker remembers MEMORY savings at most.

Defined cases: a null or empty text has no windows and gets the calibration's
score for none; without labels of both kinds, or too few to train on, every score
is 0; rows are scored each on its own, equal texts alike; repeated labels of a
document count once, toxic if any is, and of several texts under one labelled id
the least is the example; a very long text is scored whole; other columns are
ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.texts import fold, map_chunks
from glossa.session import small_side

FIT_TOXIC, FIT_ORDINARY, FIT_CHARS, FIT_PHRASES = 3000, 6000, 60_000_000, 50_000
LEVELS = (0.2, 0.3, 0.4, 0.5)
ORDINARY_BYTES, TOXIC_BYTES, MEMORY = 8192, 4096, 100_000
LEAST_DOCS, LEAST_RATIO, THRESHOLD = 3, 8.0, 0.7
_EDGES = b".,!?;:\"()*#$%&|<>"
_TAIL = b" ~^@|=+_0"


def windows(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


class Distance:
    """Levels of the windows' savings; plain bytes travel to the workers."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic

    def open(self) -> None:
        self.carrier = self.ordinary[-200:-160] + b"~" + self.ordinary[-100:-60] + b"^ "
        self.compress = [self._compressor(d).compress for d in (self.ordinary, self.toxic + self.ordinary)]
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        setting = zstandard.ZstdCompressionParameters.from_level(12, min_match=4, **plain)
        held.precompute_compress(compression_params=setting)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=setting)

    def level(self, window: bytes) -> int:
        word = window.strip(_EDGES)
        framed = self.carrier + word + _TAIL
        saved = (len(self.compress[0](framed)) - len(self.compress[1](framed))) / (len(word) + 2)
        return sum(saved >= bar for bar in LEVELS)

    def counts(self, text: str | None) -> list[int]:
        """Windows at each level, and all windows."""
        found, known = windows(text), self.known
        if len(known) > MEMORY:
            known.clear()
        for window in set(found).difference(known):
            known[window] = self.level(window)
        line = bytes([known[w] for w in found])
        return [line.count(k) for k in range(1, len(LEVELS) + 1)] + [len(found)]


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of [counts by level..., windows] as the calibration's terms."""
    c = np.asarray(counts, float).reshape(-1, len(LEVELS) + 1)
    strong = c[:, 2:-1].sum(1)
    rate = c[:, 1:-1].sum(1) / (c[:, -1] + 20)
    return np.column_stack([np.ones(len(c)), np.log1p(c[:, :-1]), np.log1p(strong), np.minimum(strong, 1), 10 * rate, np.log1p(c[:, -1])])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def dictionaries(rows: list[tuple[str, int]]) -> Distance | None:
    """Both dictionaries from labelled texts; None where there are too few."""
    docs, sizes, phrases = [Counter(), Counter()], [0, 0], []
    for text, toxic in rows:
        words = [w.strip(_EDGES) for w in windows(text)]
        docs[toxic].update(set(words))
        sizes[toxic] += 1
        if not toxic:  # phrases alone are kept: word lists of all texts take several times their memory
            phrases += [b" " + b" ".join(words[k : k + 4]) + b" " for k in range(0, len(words), 4)]
    if not all(sizes):
        return None
    ratio = sizes[0] / sizes[1]
    telling = {w for w, n in docs[1].items() if n >= LEAST_DOCS and w and n * ratio / (docs[0][w] + 0.5) >= LEAST_RATIO}
    random.Random(0).shuffle(phrases)
    try:
        ordinary = zstandard.train_dictionary(ORDINARY_BYTES, phrases[:FIT_PHRASES]).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return None
    chosen, held = [], 0
    for word in sorted(telling, key=lambda w: (-docs[1][w], w)):
        if (held := held + len(word) + 1) > TOXIC_BYTES:
            break
        chosen.append(word)
    # The most telling stand last, nearest the text.
    return Distance(ordinary, b" " + b" ".join(chosen[::-1]) + b" ")


def train(rows: list[tuple[str, int]], weights: tuple[float, float] = (1.0, 1.0)) -> tuple[Distance, np.ndarray] | None:
    """Dictionaries from the whole sample; the calibration from each half of it under the other half's."""
    final = dictionaries(rows)
    counts, marks = [], []
    for half in (0, 1):
        distance = dictionaries(rows[half::2])
        if distance is None or final is None:
            return None
        distance.open()
        counts += [distance.counts(text) for text, _ in rows[1 - half :: 2]]
        marks += [toxic for _, toxic in rows[1 - half :: 2]]
    y = np.array(marks, float)
    return final, calibrate(features(np.array(counts)), y, np.where(y > 0, weights[1], weights[0]))


def fit(docs: DataFrame, labels: DataFrame, *, text="text", doc_id="doc_id", toxic="toxic", held_out=None) -> tuple[Distance, np.ndarray] | None:
    """Train on a bounded sample of the labelled rows outside held_out."""
    marks = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("of")).agg(F.max((F.col(toxic) > 0).cast("int")).alias("mark"))
    if held_out is not None:
        marks = marks.where(~held_out("of"))
    sizes = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    strides = [max(1, -(-sizes.get(k, 0) // most)) for k, most in enumerate((FIT_ORDINARY, FIT_TOXIC))]
    chosen = marks.where(F.pmod(F.xxhash64("of", F.lit("fit")), F.when(F.col("mark") == 1, strides[1]).otherwise(strides[0])) == 0)
    texts = docs.select(F.col(doc_id).alias("of"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    near = lambda some: texts.join(small_side(some, some.count()), "of").groupBy("of", "mark").agg(F.min("text").alias("text"))
    chars = near(chosen).agg(F.sum(F.length("text"))).first()[0] or 0
    if (thin := -(-chars // FIT_CHARS)) > 1:
        chosen = chosen.where(F.pmod(F.xxhash64("of", F.lit("thin")), F.lit(thin)) == 0)
    rows = sorted((r["of"], r["text"], r["mark"]) for r in near(chosen).collect())
    return train([r[1:] for r in rows], (float(strides[0]), float(strides[1])))


def _scores(model: tuple[Distance, np.ndarray] | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    distance, beta = model
    if not hasattr(distance, "known"):
        distance.open()
    return 1 / (1 + np.exp(-np.clip(features(np.array([distance.counts(t) for t in texts])) @ beta, -30, 30)))


def score(docs: DataFrame, model: tuple[Distance, np.ndarray] | None, *, text="text", doc_id="doc_id") -> DataFrame:
    """doc_id, score, predicted for every row."""
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def judge(chunk: list[dict]) -> list[tuple]:
        scores = _scores(packed.value, [row["text"] for row in chunk])
        return [(row["doc_id"], float(x), int(x >= THRESHOLD)) for row, x in zip(chunk, scores, strict=True)]

    return map_chunks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), judge, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: tuple[Distance, np.ndarray] | None, *, text="text") -> DataFrame:
    """The rows of docs, all their columns, whose text isn't predicted toxic."""
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.filter(pa.array(_scores(packed.value, part.column(text).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def detect_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fitted on two folds of three, every document scored."""
    model = fit(docs, labels, held_out=lambda c: fold(c, 3) == 1)
    return score(docs, model).select("doc_id", (F.coalesce(fold("doc_id", 3), F.lit(-1)) == 1).alias("held_out"), "score", "predicted")
