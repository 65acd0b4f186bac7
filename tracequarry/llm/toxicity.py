"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text, as raw content (README.md says how dictionaries trained by zstandard did worse): an ordinary one of the words that ordinary documents use
most, and a toxic one that has in addition the words that toxic documents use in many more different
contexts than ordinary ones would (a context is the pair of neighbours, so the words of a much
copied document count once). Every window of a whole text is compressed with either; how many
bytes the toxic dictionary saves is the distance. A document's score is a logistic
function, fitted on labelled documents that the dictionaries have not seen, of its windows' savings.
Only the text is an input: no label, language, source or id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

#: The labelled sample: documents of each label at most, and bytes of text in all. The fit is on these alone.
TOXIC, ORDINARY, BYTES = 3000, 6000, 48 << 20
WINDOW, BASE, EXTRA = 128, 8192, 4096
THRESHOLD = 0.3
LONG = re.compile(rb"\S.{0,%d}(?!\S)|\S{1,%d}" % (WINDOW - 2, WINDOW), re.S)
EDGE = b".,|;:!?*&%$#()\"'"


def windows(text: str) -> list[bytes]:
    """The whole lower-cased text in runs of whole words of up to 128 bytes; a longer word is cut."""
    return LONG.findall(text.lower().encode("utf-8", "surrogatepass"))


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def compressors(self):
        return compressors(self.ordinary, self.toxic)

    def features(self, text: str) -> list[float]:
        plain, other = self.compressors()
        own = windows(text)
        if not own or not self.toxic:
            return [1.0] + [0.0] * 9
        saved = np.sort(np.array([len(plain(w)) - len(other(w)) for w in own], "f8"))[::-1]
        n, over = len(saved), np.maximum(saved - 2, 0)
        top, few, many = max(saved[0], 0), max(saved[:3].mean(), 0), (saved >= 3).sum()
        return [1.0, top**0.5, few**0.5, saved.mean(), np.log1p(many), (many / n) ** 0.5, np.log1p(np.maximum(saved - 1, 0).sum()), np.log1p(over.sum() / n**0.5), over.mean() ** 0.5, np.log(n)]

    def score(self, text: str) -> float:
        z = float(np.dot(self.features(text), self.weights))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@lru_cache(maxsize=4)
def compressors(ordinary: bytes, toxic: bytes):
    import zstandard as zs

    out = []
    for content in (ordinary, toxic):
        kind = zs.ZstdCompressionDict(content or b" " * 8, dict_type=zs.DICT_TYPE_RAWCONTENT)
        level = zs.ZstdCompressionParameters.from_level(13, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3, strategy=zs.STRATEGY_BTOPT, window_log=15)
        out.append(zs.ZstdCompressor(dict_data=kind, compression_params=level).compress)
    return tuple(out)


def words(text: str) -> list[bytes]:
    return [w.strip(EDGE) for w in text.lower().encode("utf-8", "surrogatepass").split()]


class Coded:
    """Texts as arrays of word numbers."""

    def __init__(self, texts: list[str]):
        known: dict[bytes, int] = {b"": 0}
        self.texts = []
        for t in texts:
            self.texts.append(np.array([0, *[known.setdefault(w, len(known)) for w in words(t)], 0], "i4"))
        self.words = list(known)

    def contexts(self, chosen) -> np.ndarray:
        """In how many different pairs of neighbours each word stands, over the chosen texts."""
        own = [self.texts[i] for i in chosen]
        if not own:
            return np.zeros(len(self.words), "i8")
        word = np.concatenate([x[1:-1] for x in own])
        pair = np.concatenate([x[:-2].astype("i8") << 32 | x[2:] for x in own])
        order = np.lexsort((pair, word))
        word, pair = word[order], pair[order]
        new = np.r_[True, (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])] if len(word) else np.zeros(0, bool)
        return np.bincount(word[new], minlength=len(self.words))


def content(chosen: list[bytes], size: int) -> bytes:
    """The best words last: zstandard codes what is near at less cost."""
    out, n = [], 0
    for w in chosen:
        n += len(w) + 1
        if n > size:
            break
        out.append(w)
    return b" " + b" ".join(out[::-1]) + b" " if out else b""


def dictionaries(coded: Coded, toxic_texts, plain_texts) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of texts given by their numbers; the latter is empty where nothing marks toxic text."""
    toxic, plain = coded.contexts(toxic_texts), coded.contexts(plain_texts)
    fit = np.array([3 <= len(w) <= 40 for w in coded.words])
    expected = (plain + 0.5) * (max(1, toxic.sum()) / max(1, plain.sum()))
    z = (toxic - expected) / (expected + 0.5) ** 0.5
    marked = np.flatnonzero(fit & (toxic >= 3) & (toxic >= 4 * expected) & (z >= 5))
    base = content([coded.words[i] for i in sorted(np.flatnonzero(fit & (plain > 0)).tolist(), key=lambda i: (-plain[i], coded.words[i]))], BASE)
    extra = content([coded.words[i] for i in sorted(marked.tolist(), key=lambda i: (z[i], coded.words[i]), reverse=True)], EXTRA)
    # The filler keeps the ordinary words at the same distance in both.
    return base + b"\xff" * len(extra), (base + extra if extra else b"")


def fit(sample: list[tuple[str, int]], folds: int = 3) -> Model:
    """A model of (text, label) pairs. Each fold is measured with the dictionaries of the others, so the weights rest on unseen text. Without both labels, or without a mark of toxic text, the score is constant: their share."""
    share = (sum(y for _, y in sample) + 0.5) / (len(sample) + 1)
    constant = Model(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * 9))
    of = {label: [i for i, (_, own) in enumerate(sample) if own == label] for label in (0, 1)}
    if not of[0] or not of[1]:
        return constant
    coded, x, y = Coded([t for t, _ in sample]), [], []
    for f in range(folds):
        part = Model(*dictionaries(coded, *([k for i, k in enumerate(of[label]) if i % folds != f] for label in (1, 0))), constant.weights)
        held = [(k, label) for label in (0, 1) for i, k in enumerate(of[label]) if i % folds == f]
        x += [part.features(sample[k][0]) for k, _ in held]
        y += [label for _, label in held]
    whole = dictionaries(coded, of[1], of[0])
    return Model(*whole, tuple(map(float, logistic(np.array(x), np.array(y))))) if whole[1] else constant


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(keep) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + keep * w)
    return w


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY, most_bytes: int = BYTES) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out: by a hash of doc_id, whatever the tables' order."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    own = own.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    ids = own.filter("y = 1").orderBy("h", "doc_id").limit(toxic).unionByName(own.filter("y = 0").orderBy("h", "doc_id").limit(ordinary))
    # At most toxic + ordinary ids of 8 bytes: broadcast.
    rows = texts_of(docs).join(F.broadcast(ids), "doc_id").select("h", "doc_id", "text", "y")
    sample, size = [], 0
    for r in rows.orderBy("h", "doc_id", "text").toLocalIterator():
        size += len(r["text"].encode("utf-8", "surrogatepass"))
        if size > most_bytes:
            break
        sample.append((r["text"], r["y"]))
    return fit(sample)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row's whole text; null texts count as empty, and empty ones have the score of a text without windows."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            own = np.array([model.score(t.as_py()) for t in b.column(1)], "f8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own), pa.array((own >= threshold).astype("i4"))], ["doc_id", "score", "predicted"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def kept(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose score is below threshold: each text is scored where it is read, nothing is shuffled."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = [model.score(t.as_py() or "") < threshold for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
