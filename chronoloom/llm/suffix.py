"""Removal of repeated byte strings: a depth-limited radix sort of suffixes, most significant digit first.

Two suffixes count as equal when they agree through the threshold (length bytes), so an order of the suffixes through that
depth has the repeated strings as its groups of equal suffixes. The order is refined pass by pass and a suffix that is alone
in its group leaves the sort, as nothing can equal it any more:

1. Digit one of a suffix is the hash of one gram of gram bytes inside its first length bytes: the smallest, rightmost among
   equals. Neighbouring suffixes share it (a run), so a pass handles runs, not suffixes. Equal strings choose the same gram
   at the same place.
2. Digit two is the whole string under a run: equal runs are repeated in full.
3. Runs that are alone are cut into parts of PART suffixes, aligned at the gram, and these are compared, with one run of
   each repeated group under the same gram. All suffixes of a part share a core; a part whose core is alone is done with.
4. Parts that are alone but not by their core are compared suffix by suffix, again with one of each repeated group.

Every pass is a hash aggregation with partial sums, so a group of any size costs one row for each task that meets it. A text
that occurs more than once as a whole is known from its key. Within one document the last step compares locally.

Null text counts as empty. Matches never cross documents. Repeated rows repeat each other's text: texts of at least length
bytes are then removed whole. Rows may lack doc_id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import U64, apart, dealt_join, fields, heavy, lean, lists, mix, prefix_hash, signed, span_hash, step, texts, written

LENGTH, GRAM, PART = 200, 64, 16
SIEVE = 22
#: Rows that one step unpacks.
ROWS = 64


class Runs:
    """The runs of some documents: suffixes first..last (starts of length-byte strings) that share the gram at anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.length = length
        self.prefix = prefix_hash(data)
        self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
        self.gram = self.whole = np.zeros(0, U64)
        if len(data) < length:
            return
        window = length - gram + 1
        at = np.arange(len(data) - gram + 1)
        grams = span_hash(self.prefix, at, at + gram)
        # the smallest gram of each window, the rightmost among equals: hash above, place counted backwards below
        least = (grams & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - at.astype(U64))
        width = 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(least) - window + width], least[window - width :])
        anchor = (U64(0xFFFFFFFF) - (least & U64(0xFFFFFFFF))).astype(np.int64)
        sizes = np.diff(offsets)
        doc = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
        good = np.flatnonzero(offsets[doc + 1] - np.arange(len(anchor)) >= length)
        if not len(good):
            return
        anchor, doc = anchor[good], doc[good]
        new = np.ones(len(good), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        self.first, self.last = good[heads], good[np.append(heads[1:], len(good)) - 1]
        self.anchor, self.doc = anchor[heads], doc[heads]
        self.gram, self.whole = grams[self.anchor], span_hash(self.prefix, self.first, self.last + length)

    def parts(self, chosen: np.ndarray, size: int, core: bool = False) -> tuple[np.ndarray, ...]:
        """(run, first suffix, last suffix, hash) of the parts of the chosen runs, aligned at the anchor; core adds the hash of the bytes that all suffixes of a full part share."""
        start, stop, anchor = self.first[chosen], self.last[chosen], self.anchor[chosen]
        low, high = (start - anchor) // size, (stop - anchor) // size
        n = high - low + 1
        run = np.repeat(np.arange(len(chosen)), n)
        step = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        a = np.maximum(anchor[run] + step * size, start[run])
        b = np.minimum(anchor[run] + step * size + size - 1, stop[run])
        out = chosen[run], a, b, span_hash(self.prefix, a, b + self.length)
        if not core:
            return out
        full = anchor[run] + step * size
        return *out, span_hash(self.prefix, full + size - 1, full + self.length)


@step
def _scan(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in texts(batch.column("text")):
                runs = Runs(data, offsets, length, gram)
                keys = batch.column("k").slice(a, b - a).to_numpy(zero_copy_only=False)
                _, one = np.unique(mix(runs.gram + mix(runs.whole + runs.doc.astype(U64))), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(runs.gram[one])), pa.array(signed(runs.whole[one])), pa.array(keys[runs.doc[one]], pa.int64())], ["h", "c", "k"])

    return run


class Sieve:
    """A bitmap of 2**SIEVE places for the keys of a table: what it lacks isn't in the table. Its size is fixed; past some millions of keys it lets everything pass."""

    def __init__(self, keys: DataFrame):
        got = keys.select(F.col("k").bitwiseAND((1 << SIEVE) - 1).cast("int").alias("p")).distinct().toArrow()
        bits = np.zeros(1 << SIEVE, bool)
        bits[got["p"].to_numpy()] = True
        self.bits = np.packbits(bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & ((1 << SIEVE) - 1)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


@step
def squeeze(columns: list[str], sieve: Sieve | None = None):
    """Passes columns on and packs text as z; with a sieve, of rows only whose key is inside. The key is the first column."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            if sieve is not None:
                batch = batch.filter(pa.array(sieve.has(batch.column(columns[0]).to_numpy(zero_copy_only=False))))
            z = [pack((x.as_buffer() if x.is_valid else b"") or b"") for x in batch.column("text").cast(pa.large_string()).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(z, pa.binary())], [*columns, "z"])

    return run


def _unpacked(batches):
    """(part of a batch, its texts)."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, pa.array([unpack(z) for z in part.column("z").to_pylist()], pa.large_binary()).cast(pa.large_string())


def _marks(column, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (document, value) pairs of a list column, mixed into one number, for membership()."""
    part = column.slice(a, b - a)
    counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    return np.sort(_tag(np.repeat(np.arange(b - a), counts), values))


def _tag(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    return mix(values + mix(doc.astype(U64) + U64(1)))


def _in(sorted_marks: np.ndarray, tags: np.ndarray) -> np.ndarray:
    if not len(sorted_marks):
        return np.zeros(len(tags), bool)
    at = np.minimum(np.searchsorted(sorted_marks, tags), len(sorted_marks) - 1)
    return sorted_marks[at] == tags


@step
def _cut(length: int, gram: int, size: int):
    """Parts of the runs in the list wanted."""

    def run(batches):
        for part, raw in _unpacked(batches):
            keys = part.column("k").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in texts(raw):
                runs = Runs(data, offsets, length, gram)
                chosen = np.flatnonzero(_in(_marks(part.column("wanted"), a, b), _tag(runs.doc, runs.whole)))
                of, _, _, h, core = runs.parts(chosen, size, core=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(runs.gram[of])), pa.array(signed(h)), pa.array(signed(core)), pa.array(keys[a:b][runs.doc[of]], pa.int64())], ["h", "b", "o", "k"])

    return run


@step
def _single(length: int, gram: int, size: int):
    """Suffixes of the parts in the list wanted."""

    def run(batches):
        for part, raw in _unpacked(batches):
            keys = part.column("k").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in texts(raw):
                runs = Runs(data, offsets, length, gram)
                of, first, last, h = runs.parts(np.arange(len(runs.first)), size)
                some = _in(_marks(part.column("wanted"), a, b), _tag(runs.doc[of], h))
                of, first, n = of[some], first[some], (last - first + 1)[some]
                each = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(of, n)
                yield pa.RecordBatch.from_arrays([pa.array(signed(runs.gram[of])), pa.array(signed(span_hash(runs.prefix, each, each + length))), pa.array(keys[a:b][runs.doc[of]], pa.int64())], ["h", "w", "k"])

    return run


def _local(runs: Runs) -> np.ndarray:
    """Suffixes that occur again in their own document."""
    tags = _tag(runs.doc, runs.gram)
    _, back, n = np.unique(tags, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(n[back] > 1)
    if not len(chosen):
        return chosen
    of, at, _, h = runs.parts(chosen, 1)
    _, back, n = np.unique(_tag(runs.doc[of], h), return_inverse=True, return_counts=True)
    return at[n[back] > 1]


def removed(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray, whole: np.ndarray, length: int, gram: int, size: int) -> np.ndarray:
    """Which bytes go."""
    runs = Runs(data, offsets, length, gram)
    edge = np.zeros(len(data) + 1, np.int32)

    def mark(a, b):
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)

    hit = _in(marks, _tag(runs.doc, runs.whole))
    mark(runs.first[hit], runs.last[hit] + length)
    if len(marks):
        docs = np.zeros(len(offsets), bool)
        docs[runs.doc[hit]] = True
        of, a, b, h = runs.parts(np.flatnonzero(~hit), size)
        part = _in(marks, _tag(runs.doc[of], h))
        mark(a[part], b[part] + length)
        of, a, _, h = runs.parts(np.flatnonzero(~hit), 1)
        one = _in(marks, _tag(runs.doc[of], h))
        mark(a[one], a[one] + length)
    at = _local(runs)
    mark(at, at + length)
    out = np.cumsum(edge[:-1]) > 0
    for i in np.flatnonzero(whole & (np.diff(offsets) >= length)):
        out[offsets[i] : offsets[i + 1]] = True
    return out


@step
def _finish(length: int, gram: int, size: int, text: bool, sieve: Sieve | None = None):
    """What is left of texts; with a sieve, of rows as they come whose key __k is outside, so that nothing is marked in them."""

    def outside(batches):
        for batch in batches:
            keys = batch.column("__k").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(~sieve.has(keys)))
            yield batch, batch.column("text")

    def run(batches):
        for part, raw in _unpacked(batches) if sieve is None else outside(batches):
            none = np.zeros(0, U64)
            copies = np.zeros(part.num_rows, bool) if sieve else np.array(part.column("copied").fill_null(False).to_pylist(), bool)
            for a, b, data, offsets in texts(raw):
                gone = removed(data, offsets, none if sieve else _marks(part.column("found"), a, b), copies[a:b], length, gram, size)
                rows = []
                for i in range(b - a):
                    own, cut = data[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
                    spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if len(cut) else 0
                    if text:
                        # whole characters only: one that is cut in part stays
                        lead = (own & 0xC0) != 0x80
                        group = np.cumsum(lead) - 1
                        keep = np.ones(int(group[-1]) + 1 if len(group) else 0, bool)
                        if len(group):
                            keep[:] = np.bincount(group, weights=~cut) > 0
                        rows.append((len(own), int(cut.sum()), spans, own[keep[group]].tobytes().decode() if len(group) else ""))
                    else:
                        rows.append((len(own), int(cut.sum()), spans, hashlib.sha256(own[~cut].tobytes()).hexdigest()))
                n, r, s, x = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("row").slice(a, b - a), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.string())], ["row", "n_bytes", "n_removed", "n_spans", "text" if text else "kept_sha256"])

    return run


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    """Groups that rows of two texts at least share."""
    return rows.groupBy(*by).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).where("lo < hi").select(*by, "lo", "n")


def _onward(rows: DataFrame, by: str | list[str], many: DataFrame | None) -> DataFrame:
    """Rows that the next pass takes: those that are alone, and one of each repeated group that has such a neighbour under its key."""
    by = [by] if isinstance(by, str) else by
    hot = rows.where("lo is null").select(*by).distinct()
    return dealt_join(rows.where("lo is null or k = lo"), hot, by, "left_semi", many)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART, text: bool = False) -> DataFrame:
    """Removes each byte of a text that a string of length bytes covers which also starts anywhere else in docs(doc_id, text, ...).

    Returns one row per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256; with text=True, the columns of docs, of which text
    is what remains. There, a character of which some bytes would go and some stay is kept whole.
    """
    # all other columns go along as one, so their names can't clash
    others = [c for c in docs.columns if c != "text"] if text else ["doc_id"]
    source = lean(docs).select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__k", F.xxhash64("text"))
    rows = source.select(F.col("__k").alias("k"), "text").mapInArrow(_scan(length, gram), "h long, c long, k long")
    rows = written(rows, "grams")
    shared = written(_repeated(rows, "h"), "shared-grams")
    many = heavy(shared, "h")
    found = dealt_join(rows, shared.select("h"), ["h"], "left_semi", many).distinct()
    found = written(found, "runs")
    again = written(_repeated(found, "h", "c"), "repeated-runs")
    both = written(dealt_join(found, again.drop("n"), ["h", "c"], "left", heavy(again, "h", "c")), "marked-runs")
    copied = source.groupBy("__k", F.xxhash64("text", F.lit(1)).alias("k2")).agg(F.count("*").alias("n"), F.min("doc_id").alias("id")).where("n > 1").groupBy(F.col("__k").alias("k")).agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    copied = written(copied, "copies")
    copies = heavy(copied, "k")
    kind = dict(docs.dtypes)["doc_id"]

    def of_texts(wanted: DataFrame, step, schema: str) -> DataFrame:
        """step over the texts that wanted(k, wanted) names, one copy of each."""
        wanted = written(wanted.groupBy("k").agg(F.collect_set("v").alias("wanted")).join(copied.drop("n"), "k", "left"), "wanted")
        packed = apart(source.select(F.col("__k").alias("k"), "doc_id", "text").mapInArrow(squeeze(["k", "doc_id"], Sieve(wanted)), f"k long, doc_id {kind}, z binary"))
        return dealt_join(packed, wanted, ["k"], "inner", copies).where("id is null or doc_id = id").select("k", "z", "wanted").mapInArrow(step, schema)

    cut = written(of_texts(_onward(both, "h", many).select("k", F.col("c").alias("v")), _cut(length, gram, part), "h long, b long, o long, k long"), "parts")
    again, cores = written(_repeated(cut, "h", "b"), "repeated-parts"), written(_repeated(cut, "h", "o"), "repeated-cores")
    many_cores = heavy(cores, "h", "o")
    marked = dealt_join(cut, again.drop("n"), ["h", "b"], "left", heavy(again, "h", "b"))
    marked = written(dealt_join(marked, cores.select("h", "o"), ["h", "o"], "left_semi", many_cores), "marked-parts")
    ones = written(of_texts(_onward(marked, ["h", "o"], many_cores).select("k", F.col("b").alias("v")), _single(length, gram, part), "h long, w long, k long"), "suffixes")
    again = written(_repeated(ones, "h", "w"), "repeated-suffixes")
    ones = dealt_join(ones, again.select("h", "w"), ["h", "w"], "left_semi", heavy(again, "h", "w"))
    marks = both.where("lo is not null").select("k", F.col("c").alias("v")).unionByName(marked.where("lo is not null").select("k", F.col("b").alias("v"))).unionByName(ones.select("k", F.col("w").alias("v")))
    marks = marks.groupBy("k").agg(F.collect_set("v").alias("found")).join(copied.select("k", F.lit(True).alias("copied")), "k", "full").withColumnRenamed("k", "__k")
    marks = written(marks, "marks")
    # texts without marks needn't move
    sieve = Sieve(marks.select(F.col("__k").alias("k")))
    packed = apart(source.mapInArrow(squeeze(["__k", "row"], sieve), fields(source, "__k", "row").add("z", "binary")))
    packed = dealt_join(packed, marks, ["__k"], "left", None if copies is None else copies.withColumnRenamed("k", "__k"))
    kept = "text" if text else "kept_sha256"
    out = fields(source, "row").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add(kept, "string")
    done = packed.mapInArrow(_finish(length, gram, part, text), out).unionByName(source.mapInArrow(_finish(length, gram, part, text, sieve), out))
    if not text:
        return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
