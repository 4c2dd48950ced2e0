"""Benchmark decontamination by latent semantic retrieval.

1. Items of over PART words are split into parts that overlap by half, so that items and passages have like lengths. The benchmark is
   taken in passes of about PASS parts, an item's parts together. Words of a pass's items make its vocabulary, all of them; Spark counts the documents
   that have each (over all documents).
2. TF-IDF rows of every RANK parts are factorised by a distributed randomised SVD: tasks multiply their rows with a test matrix and
   add up, once to sample the range and once more to refine it; the driver only sees vocabulary x rank. As a block has no more parts than
   the basis has directions, the basis spans them all and cosines are exact, however many items there are.
3. Every document is read in overlapping passages of two widths. A passage whose TF-IDF weight lies outside the vocabulary so far
   that no item can reach the cosine is left out (Cauchy-Schwarz); the others are projected and compared with all parts.
4. A candidate counts if the longest common subsequence of the words around it covers COVER of the whole item; from PARTIAL on it counts
   too if the item's answer, its last ANSWER of the words, is there with COVER.

Words are runs of letters, digits and non-ASCII bytes, A-Z and the letters of Latin-1 in lower case; so case, marks and white space do not matter.
Null text counts as empty. Items without words match nothing, items of fewer than SHORT words must be covered in full. Repeated items
match alike, repeated documents give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import HEAVY, LOWER, U64, dealt_join, fresh, heavy, lean, prefix_hash, signed, span_hash, step, texts, written

#: Parts of items in a block, which has a basis of its own with as many directions.
RANK = 256
#: Parts that one pass over the documents compares, in blocks; larger benchmarks take several passes.
PASS = 4 * RANK
BLOCKS_LENGTH = 16
WIDTHS = (1, 2, 4)
#: Words of an item's part: as many as the widest passage has.
PART = WIDTHS[-1] * BLOCKS_LENGTH
#: Words of a unit, of which all passages consist, and units that are summed at once.
UNIT, UNITS = BLOCKS_LENGTH // 2, 4096
COSINE = 0.25
COVER, PARTIAL, ANSWER, SHORT = 0.75, 0.5, 0.3, 8

BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, for each row the place of its first word and one more at the end)."""
    full = ~BREAK[data]
    low = LOWER[data]
    # capital letters of Latin-1, two bytes each in UTF-8; the multiplication sign among them has no small form
    second = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)
    low[1:][second] += 0x20
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = full[:-1], full[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return span_hash(prefix_hash(low), starts, ends), np.searchsorted(starts, offsets)


def _places(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Index of each word in the sorted vocabulary, -1 where it has none."""
    if not len(vocabulary):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1)


def parts(n: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of an item of n words; the last ends with the item."""
    return [(a, a + PART) for a in range(0, n - PART, PART // 2)] + [(max(0, n - PART), n)]


def _n_parts(batches):
    for batch in batches:
        n = sum(len(parts(int(n))) for _, _, data, offsets in texts(batch.column("text")) for n in np.diff(tokens(data, offsets)[1]) if n)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


@step
def _counted(vocabulary: np.ndarray):
    def run(batches):
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in texts(batch.column("text")):
                words, first = tokens(data, offsets)
                at = _places(words, vocabulary)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                good = at >= 0
                seen = np.unique(doc[good] * len(vocabulary) + at[good]) % max(1, len(vocabulary))
                total += np.bincount(seen, minlength=len(vocabulary))
                n += len(offsets) - 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["at", "n"])

    return run


def _rows(words: np.ndarray, first: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised TF-IDF as (row, column, value)."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = _places(words, vocabulary)
    cell, tf = np.unique(row[at >= 0] * len(vocabulary) + at[at >= 0], return_counts=True)
    row, col = cell // max(1, len(vocabulary)), cell % max(1, len(vocabulary))
    value = tf * idf[col]
    norm = np.sqrt(np.bincount(row, value**2, len(first) - 1))
    return row, col, value / np.maximum(norm[row], 1e-12)


@step
def _sketch(vocabulary: np.ndarray, idf: np.ndarray, test: np.ndarray):
    """This task's part of A'(A test), by column of A and column of test."""

    def run(batches):
        out = np.zeros(test.shape)
        for batch in batches:
            for _, _, data, offsets in texts(batch.column("text")):
                row, col, value = _rows(*tokens(data, offsets), vocabulary, idf)
                y = np.zeros((len(offsets) - 1, test.shape[1]))
                np.add.at(y, row, value[:, None] * test[col])
                np.add.at(out, col, value[:, None] * y[row])
        some = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, test.shape[1])), pa.array(np.tile(np.arange(test.shape[1]), len(some))), pa.array(out[some].ravel())], ["i", "j", "x"])

    return run


def basis(items: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the TF-IDF rows of items(text)."""

    def multiplied(test: np.ndarray) -> np.ndarray:
        got = items.select("text").mapInArrow(_sketch(vocabulary, idf, test), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(test.shape)
        out[got["i"].to_numpy(), got["j"].to_numpy()] = got["x"].to_numpy()
        return out

    rank = min(rank, len(vocabulary))
    if not rank:
        return np.zeros((len(vocabulary), 0))
    test = np.random.Generator(np.random.PCG64(7)).standard_normal((len(vocabulary), rank))
    q = np.linalg.qr(multiplied(test))[0]
    z = multiplied(q)
    values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-300)
    return q @ turn[:, keep]


def masks(item: list[int]) -> dict[int, int]:
    """For each word of an item the bits of its places."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    return places


def _common(n: int, found: list[int]) -> int:
    v = full = (1 << n) - 1
    for at in found:
        if u := v & at:
            v = (v + u | v - u) & full
    return n - v.bit_count()


def lcs(item: list[int], window: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places = masks(item)
    return _common(len(item), [places[w] for w in window if w in places])


def confirmed(item: list[int], window: list[int], places: dict[int, int] | None = None) -> tuple[float, float] | None:
    """(share of the item, share of its answer) found in order, where that counts as contamination; places: masks(item), if they are known."""
    places = masks(item) if places is None else places
    found, least = [places[w] for w in window if w in places], 1.0 if len(item) < SHORT else PARTIAL
    # no more words can be found in order than are found
    if len(found) / len(item) < least:
        return None
    share = _common(len(item), found) / len(item)
    answer = item[-max(1, round(ANSWER * len(item))) :]
    if share < least:
        return None
    part = lcs(answer, window) / len(answer)
    return (share, part) if share >= COVER or part >= COVER else None


def _projected(own: np.ndarray, idf: np.ndarray, latent: np.ndarray, block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word of a pass in the block's rows, projections of words and zeros for others, projections of the block's parts)."""
    rows = np.vstack([idf[own, None] * latent, np.zeros((1, latent.shape[1]))]).astype(np.float32)
    places = np.full(len(idf) + 1, len(own))
    places[own] = np.arange(len(own))
    matrix = np.zeros((len(block), latent.shape[1]), np.float32)
    for i, at in enumerate(block):
        some, tf = np.unique(at, return_counts=True)
        matrix[i] = rows[places[at]].sum(0) / max(1e-9, np.sqrt(((tf * idf[some]) ** 2).sum()))
    return places, rows, matrix


@step
def _search(vocabulary: np.ndarray, idf: np.ndarray, rare: float, blocks: list[tuple], ids: list[list], id_kind: pa.DataType, items: list[list[int]], cosine: float):
    """blocks: for the parts of each the indexes of their items, and what _projected() gives."""
    weight = np.append(idf**2, rare**2)

    def run(batches):
        # a passage's products with the parts are the sums of its words' products
        scores = [rows @ matrix.T for _, _, rows, matrix in blocks]
        places_of = [masks(item) for item in items]
        for batch in batches:
            for a, b, data, offsets in texts(batch.column("text")):
                words, first = tokens(data, offsets)
                at = _places(words, vocabulary)
                norm = np.concatenate([[0], np.cumsum(weight[at])])
                best: dict[tuple[int, int], tuple] = {}
                tried: set[tuple[int, int, int, int]] = set()
                counts = np.diff(first)
                # passages consist of units, of half the narrowest width
                each_n = -(-counts // UNIT)
                unit_doc = np.repeat(np.arange(len(counts)), each_n)
                first_unit = np.cumsum(each_n) - each_n
                unit = first[unit_doc] + UNIT * (np.arange(len(unit_doc)) - first_unit[unit_doc])
                for (members, places, rows, _), score in zip(blocks, scores, strict=True):
                    place = places[at]
                    known = np.concatenate([[0], np.cumsum(np.where(place < len(rows) - 1, weight[at], 0))])
                    hopeful = []
                    for width in WIDTHS:
                        # passages of width steps, one step apart (half of it for the wider ones); the last may be shorter
                        size, stride = width * BLOCKS_LENGTH, width * BLOCKS_LENGTH // 2
                        n = np.maximum(1, -(-np.maximum(counts - size, 0) // stride) + 1) * (counts > 0)
                        doc = np.repeat(np.arange(len(counts)), n)
                        start = first[doc] + stride * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
                        end = np.minimum(start + size, first[doc + 1])
                        own, all_ = known[end] - known[start], norm[end] - norm[start]
                        hope = np.flatnonzero((own > 0) & (own >= cosine**2 * all_))
                        doc, start, end, all_ = doc[hope], start[hope], end[hope], all_[hope]
                        begin = first_unit[doc] + (start - first[doc]) // UNIT
                        hopeful.append((doc, start, end, np.sqrt(all_), begin, begin + -(-(end - start) // UNIT), []))
                    for low in range(0, len(unit), UNITS):
                        # those that begin among UNITS units, and the units that any of them has
                        spans = [slice(*np.searchsorted(h[4], (low, low + UNITS))) for h in hopeful]
                        need = np.zeros(UNITS + 2 * WIDTHS[-1] + 1, int)
                        for h, span in zip(hopeful, spans, strict=True):
                            np.add.at(need, h[4][span] - low, 1)
                            np.add.at(need, h[5][span] - low, -1)
                        some = np.flatnonzero(np.cumsum(need)) + low
                        if not len(some):
                            continue
                        sums = np.empty((len(some) + 1, score.shape[1]), np.float32)
                        # units that none has stand for the last, which is nothing
                        sums[-1] = 0
                        where = np.full(len(need), len(some))
                        where[some - low] = np.arange(len(some))
                        for k in range(0, len(some), 2048):
                            begins = unit[some[k : k + 2048]]
                            lengths = np.minimum(begins + UNIT, first[unit_doc[some[k : k + 2048]] + 1]) - begins
                            each = np.repeat(begins, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                            sums[k : k + len(begins)] = np.add.reduceat(score[place[each]], np.cumsum(lengths) - lengths, axis=0)
                        for (_, _, _, root, begin, stop, got), span, width in zip(hopeful, spans, WIDTHS, strict=True):
                            for k in range(span.start, span.stop, 512):
                                part = slice(k, min(k + 512, span.stop))
                                close = np.zeros((part.stop - k, score.shape[1]), np.float32)
                                for j in range(2 * width):
                                    close += sums[np.where(begin[part] + j < stop[part], where[np.minimum(begin[part] + j - low, len(where) - 1)], len(some))]
                                close = close / root[part, None]
                                x, y = np.nonzero(close >= cosine)
                                got.append((x + k, y, close[x, y]))
                    for doc, start, end, _, _, _, got in hopeful:
                        for x, y, near in (z for g in got for z in zip(*g, strict=True)):
                            s, e, d, i = start[x], end[x], doc[x], members[y]
                            wide = len(items[i])
                            if (d, i) in best and best[d, i][1] >= COVER:
                                continue
                            # many parts of a long item lead to nearly the same window, so these begin and end at multiples of a quarter of it
                            step = wide // 4 if wide > PART else 1
                            s, e = (s - first[d] - wide) // step * step + first[d], -(-(e - first[d] + wide) // step) * step + first[d]
                            s, e = max(first[d], s), min(first[d + 1], e)
                            if (d, i, s, e) in tried:
                                continue
                            tried.add((d, i, s, e))
                            window = signed(words[s:e]).tolist()
                            if (hit := confirmed(items[i], window, places_of[i])) and ((d, i) not in best or best[d, i][1] < hit[0]):
                                best[d, i] = (float(near), *hit)
                if best:
                    keys = [(d, i, item) for d, i in best for item in ids[i]]
                    docs = batch.column("doc_id").slice(a, b - a).take(pa.array([int(d) for d, *_ in keys]))
                    yield pa.RecordBatch.from_arrays([docs, pa.array([k[2] for k in keys], id_kind), *(pa.array([best[k[:2]][j] for k in keys], pa.float64()) for j in range(3))], ["doc_id", "item_id", "cosine", "covered", "answer"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, covered, answer, contaminated): a row for each document of docs(doc_id, text) and item of benchmark(item_id, text) that it holds."""
    spark = lean(docs).sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id {dict(benchmark.dtypes)['item_id']}, cosine double, covered double, answer double"
    total = items.mapInArrow(_n_parts, "n long").agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-total // PASS))
    out = None
    for k in range(passes):
        # items of equal words are compared as one
        slots: dict[tuple, list] = {}
        known = (items if passes == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k)).toArrow()
        for a, _, data, offsets in texts(known["text"]):
            hashes, first = tokens(data, offsets)
            for i in range(len(first) - 1):
                if first[i + 1] > first[i]:
                    same = slots.setdefault(tuple(signed(hashes[first[i] : first[i + 1]]).tolist()), [])
                    same.append(known["item_id"][a + i].as_py())
        words = [list(w) for w in slots]
        vocabulary = np.unique(np.array([w for item in words for w in item], np.int64).view(U64))
        got = docs.select("text").mapInArrow(_counted(vocabulary), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        at, n = got["at"].to_numpy(), got["n"].to_numpy()
        count = int(n[at < 0].sum())
        frequency = np.zeros(len(vocabulary))
        frequency[at[at >= 0]] = n[at >= 0]
        rare = float(np.log1p(max(1, count)))
        idf = np.log((1 + count) / (1 + frequency)) + 0.01
        blocks = []
        places = [_places(np.array(w, np.int64).view(U64), vocabulary) for w in words]
        cut = [(j, places[j][x:y]) for j in range(len(words)) for x, y in parts(len(words[j]))]
        for i in range(0, len(cut), rank):
            block = [p for _, p in cut[i : i + rank]]
            own = np.unique(np.concatenate(block))
            # the basis reads text, so the place of a word stands for it
            # an Arrow table, as rows would go through Python workers of their own
            named = spark.createDataFrame(pa.table({"text": pa.array([" ".join(map(str, p.tolist())) for p in block], pa.string())}))
            (_, _, data, offsets), = texts(pa.array([" ".join(map(str, own.tolist()))]))
            names = tokens(data, offsets)[0]
            order = np.argsort(names)
            latent = basis(named, names[order], idf[own][order], len(block))[np.argsort(order)]
            blocks.append(([j for j, _ in cut[i : i + rank]], *_projected(own, idf, latent, block)))
        found = docs.select("doc_id", "text").mapInArrow(_search(vocabulary, idf, rare, blocks, list(slots.values()), known["item_id"].type, words, cosine), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("contaminated", F.lit(True))


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows of docs, all columns, that hold no item; rows without doc_id are judged by their text like the others."""
    key = fresh(docs, "__text")
    hits = contaminated(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, cosine).select(F.col("doc_id").alias(key)).distinct()
    # texts that hold an item may be many or few; copies of one text may be a third of all, so those are dealt
    groups = docs.groupBy(F.xxhash64("text").alias(key)).agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
    return dealt_join(docs.withColumn(key, F.xxhash64("text")), written(hits, "hits"), [key], "left_anti", heavy(groups, key)).select(*(F.col(f"`{c}`") for c in docs.columns))
