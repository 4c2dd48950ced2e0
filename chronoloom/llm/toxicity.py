"""Toxicity: compression-distance classification with one zstandard dictionary of toxic and one of ordinary text.

A window is one word without the marks around it. It is recoded before compression: every byte becomes the CRC-32 of the
word up to it, so a match with a dictionary is a common beginning of words, and lengths tell short words apart. The
difference of the two compressed lengths says how much better the toxic dictionary knows the word. A document's features are
its largest differences, how many (and how many different words) reach CLEAR, and these against its number of words; a calibrated
logistic turns them into a score.

The dictionaries hold the words of the labelled sample, the most frequent last (nearest to the window): of toxic documents only words
with a beginning that SHARE of them have (LEAST at least) and that is RATIO times as frequent there as in ordinary ones. At most TOXIC and ORDINARY labelled documents are
used, those of smallest hash of doc_id, two thirds for dictionaries and a third to calibrate; the calibration
weighs both by their counts among all labels. Every document is scored on its whole text.

Null text counts as empty; empty texts have a score like any other. Null labels are left out, several labels of one doc_id
count as their highest. Without toxic or without ordinary labels, scores are 0 or, with toxic labels only, 1.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import lean, step

TOXIC, ORDINARY = 3000, 6000
RATIO, SHARE, LEAST, SHORTEST = 8.0, 0.02, 5, 4
WORDS = 20_000
LEVEL = 12
CLEAR, CLIP = 8, 16
#: Bytes of a word that are compared; longer ones are cut into such windows.
LONG = 48
#: Words whose differences a worker remembers.
KEPT = 250_000
EDGE = b".,;:!?\"'()[]{}<>|%$#*&"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def spelled(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def recoded(word: bytes) -> bytes:
    code, out = 0, []
    for c in word + b" ":
        code = zlib.crc32(bytes((c,)), code)
        out.append(code)
    return struct.pack(f"<{len(out)}I", *out)


class Distance:
    """Differences of compressed lengths under two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.kept: dict[bytes, float] = {}
        self.packs = []
        for book in (ordinary, toxic):
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(book), write_checksum=0, write_content_size=0, write_dict_id=0)
            self.packs.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress)

    def of(self, word: bytes) -> float:
        bare = word.strip(EDGE)
        out = -float(CLIP)
        for i in range(0, len(bare), LONG):
            code = recoded(bare[i : i + LONG])
            out = max(out, min(CLIP, len(self.packs[0](code)) - len(self.packs[1](code))))
        if len(self.kept) >= KEPT:
            self.kept.clear()
        self.kept[word] = out
        return out

    def features(self, text: str | None) -> list[float]:
        get, of = self.kept.get, self.of
        found, told, words = [], set(), spelled(text)
        for w in words:
            d = get(w)
            if d is None:
                d = of(w)
            if d > 0:
                found.append(d)
                if d >= CLEAR:
                    told.add(w)
        found.sort(reverse=True)
        clear, n = sum(d >= CLEAR for d in found), len(words)
        strength = [found[0] / CLIP if found else 0.0, sum(found[:3]) / (3 * CLIP)]
        counts = [float(np.log1p(clear)), min(clear, 2) / 2, float(np.log1p(len(told)))]
        # a long text has more words that are like toxic ones by chance
        return [1.0, *strength, *counts, float(np.log1p(n)) / 8, clear / (n + 10) ** 0.5, 10 * clear / (n + 10)]


def books(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The two dictionaries."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    own = lambda x: {b for w in spelled(x) if (b := w.strip(EDGE))}
    starts = lambda ws: {w[:n] for w in ws for n in range(SHORTEST, min(len(w), 12) + 1)}
    there, here, common = Counter(), Counter(), Counter()
    for x in toxic:
        there.update(starts(own(x)))
    for x in ordinary:
        ws = own(x)
        common.update(ws)
        here.update(s for s in starts(ws) if s in there)
    typical = {s for s, n in there.items() if n >= max(LEAST, SHARE * len(toxic)) and n / len(toxic) > RATIO * (here[s] + 1) / max(1, len(ordinary))}
    told = Counter()
    for x in toxic:
        told.update(w for w in own(x) if any(w[:n] in typical for n in range(SHORTEST, len(w) + 1)))
    book = lambda c: b"".join(recoded(w[:LONG]) for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:WORDS][::-1]) or b"\0" * 16
    return book(told), book(common)


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * b * np.r_[0, np.ones(len(b) - 1)]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.diag(np.r_[1e-6, np.ones(len(b) - 1)])
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> tuple[bytes, bytes, np.ndarray]:
    """Dictionaries and calibration from labels(doc_id, label) of docs(doc_id, text)."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    take = lambda v, n: known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.select("doc_id", "text").join(F.broadcast(take(1, toxic).unionByName(take(0, ordinary))), "doc_id").select("doc_id", "label", "text").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    check = lambda r: zlib.crc32(f"calibrate {r['doc_id']}".encode()) % 3 == 0
    pairs = books([r["text"] or "" for r in rows if r["label"] == 1 and not check(r)], [r["text"] or "" for r in rows if r["label"] == 0 and not check(r)])
    rest = [r for r in rows if check(r)]
    y = np.array([r["label"] for r in rest], float)
    if not len(y) or y.min() == y.max():
        seen = {r["label"] for r in rows}
        return *pairs, np.array([40.0 if seen == {1} else -40.0] + [0.0] * 8)
    distance = Distance(*pairs)
    x = np.array([distance.features(r["text"]) for r in rest])
    weight = np.where(y == 1, total.get(1, 0) / y.sum(), total.get(0, 0) / (len(y) - y.sum()))
    return *pairs, calibrated(x, y, weight * len(y) / weight.sum())


@step
def _score(toxic: bytes, ordinary: bytes, b: np.ndarray):
    def run(batches):
        distance = Distance(toxic, ordinary)
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for i in range(0, batch.num_rows, 256):
                x = np.array([distance.features(t.as_py()) for t in column.slice(i, 256)])
                s = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, 256), pa.array(s), pa.array(x[:, 1] * CLIP), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "score", "largest", "predicted"])

    return run


def judged(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> DataFrame:
    """(doc_id, score, largest, predicted) for every row of docs(doc_id, text); largest is the largest difference of a word.

    labels(doc_id, label) are all used; leave out what is to be held out.
    """
    model = train(docs, labels, toxic, ordinary)
    kind = dict(docs.dtypes)["doc_id"]
    return lean(docs).select("doc_id", "text").mapInArrow(_score(*model), f"doc_id {kind}, score double, largest double, predicted int")
