"""Near-duplicate detection: circulant MinHash, banding, and confirmation on full shingle sets.

Two permutations give every signature coordinate: sigma scatters a shingle over Z_D (D = 2**32), pi orders Z_D, and
coordinate k is min over the set of pi((sigma(v) + k) mod D), that is pi circularly shifted by k. Documents of one set
form a class, of which only the member of smallest doc_id goes on. Buckets that more than one class shares link each member
to two centres, of which one, the hub, meets most others; every link is confirmed on the full sets. Members around one
hub that are still in different components are then compared in blocks, and a task returns only links between components: no
link between two classes that share a bucket is lost, and no list of pairs is made.

Null text counts as empty. Empty texts have no shingles and are linked with nothing. Rows of one doc_id are one node; rows
without doc_id link with nothing, have a null component and are kept. Extra columns are ignored by near_duplicates().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chronoloom.llm.common import LOWER, U64, apart, components, dealt_join, heavy, lean, lists, mix, prefix_hash, signed, span_hash, step, texts, words, written
from chronoloom.llm.suffix import Sieve, squeeze

BANDS, ROWS = 42, 6
#: Members of a block; two blocks meet in one task.
BLOCK = 128
#: Shingles times coordinates that one step holds.
CELLS = 1 << 19


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of size words; of all its words where there are fewer."""
    starts, ends, first = words(data, offsets)
    low = prefix_hash(LOWER[data])
    each = span_hash(low, starts, ends)
    runs = np.zeros(len(each), U64)
    n = max(0, len(each) - size + 1)
    for k in range(size):
        runs[:n] = mix(runs[:n] * U64(31) + each[k : k + n] + U64(k + 1))
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            one = np.full(1, 7, U64)
            for k in range(a, b):
                one = mix(one * U64(31) + each[k])
            out.append(one)
        else:
            out.append(each[:0])
    return out


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of Z_2**32, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x735A2D97)
    x ^= x >> np.uint32(15)
    return x


def signature(values: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash of one set of 64-bit values."""
    sigma = (mix(values.copy()) >> U64(32)).astype(np.uint32)
    shift = np.arange(length, dtype=np.uint32)
    out = np.full(length, 0xFFFFFFFF, np.uint32)
    step = max(1, CELLS // length)
    for k in range(0, len(sigma), step):
        np.minimum(out, _pi(shift[:, None] + sigma[None, k : k + step]).min(axis=1), out=out)
    return out


@step
def _sign(size: int, bands: int, rows: int):
    salt = mix(np.arange(1, bands + 1, dtype=U64))

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in texts(batch.column("text")):
                sets = shingles(data, offsets, size)
                keys, banded, counts, seen = np.zeros((2, len(sets)), U64), [], [], {}
                for i, s in enumerate(sets):
                    keys[:, i] = (s.sum(dtype=U64), np.bitwise_xor.reduce(mix(s + U64(17)))) if len(s) else (0, 0)
                    counts.append(bands if len(s) else 0)
                    if len(s):
                        if (key := (int(keys[0, i]), int(keys[1, i]))) not in seen:
                            parts = signature(s, bands * rows).astype(U64).reshape(bands, rows)
                            h = salt.copy()
                            for k in range(rows):
                                h = mix(h * U64(31) + parts[:, k])
                            seen[key] = signed(h)
                        banded.append(seen[key])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(keys[0])), pa.array(signed(keys[1])), lists(np.concatenate([*banded, np.zeros(0, np.int64)]), counts)],
                    ["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return run


@step
def _sets(size: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                raw = pa.array([unpack(x).decode() for x in batch.column("z").slice(i, 64).to_pylist()], pa.large_string())
                out = [signed(s).tobytes() for _, _, data, offsets in texts(raw) for s in shingles(data, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 64), pa.array(out, pa.binary())], ["doc_id", "shingles"])

    return run


@step
def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sx"), batch.column("sy"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def _meet(percent: int):
    """Links between the asking rows and the others of a group, one for each two components."""

    def run(table: pa.Table) -> pa.Table:
        reps, comps, asks = (table.column(c).to_numpy() for c in ("rep", "component", "asks"))
        held = [np.frombuffer(x.as_buffer(), U64) for x in table.column("shingles")]
        sizes = np.array([len(x) for x in held])
        _, ids = np.unique(np.concatenate(held), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(sizes)])
        found: dict[tuple[int, int], tuple[int, int]] = {}
        mark = np.zeros(len(ids) + 1, bool)
        told = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks):
            y = told[(comps[told] != comps[x]) & (100 * np.minimum(sizes[told], sizes[x]) >= percent * np.maximum(sizes[told], sizes[x]))]
            if not len(y):
                continue
            own = ids[at[x] : at[x + 1]]
            mark[own] = True
            for k in y:
                shared = int(np.count_nonzero(mark[ids[at[k] : at[k + 1]]]))
                if 100 * shared >= percent * (sizes[x] + sizes[k] - shared):
                    found.setdefault(tuple(sorted((int(comps[x]), int(comps[k])))), tuple(sorted((int(reps[x]), int(reps[k])))))
            mark[own] = False
        return pa.table({"a": pa.array([p[0] for p in found.values()], pa.int64()), "b": pa.array([p[1] for p in found.values()], pa.int64())})

    return run


def links(docs: DataFrame, signed_docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(class representatives of all rows, edges a-b between representatives that keep the components of all confirmed links)."""
    classes = signed_docs.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m"))
    classes = written(classes.select("k1", "k2", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n"), F.col("m.bands").alias("bands")), "classes")
    rows = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    shared = written(shared.withColumn("n", F.col("members")), "buckets")
    many = heavy(shared, "bucket")
    members = written(dealt_join(rows.withColumnRenamed("n", "size"), shared.drop("n"), ["bucket"], "inner", many).withColumnRenamed("size", "n"), "members")
    # centres: the smallest member, and the one that meets most others in all its buckets
    met = members.groupBy("rep").agg(F.sum("members").alias("met"))
    members = members.join(met, "rep")
    hubs = members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("p"), F.max(F.struct("met", "rep", "n")).alias("q"))
    near = F.expr(f"100 * least(c.n, n) >= {percent} * greatest(c.n, n)")
    hubs = written(hubs, "hubs")
    pairs = dealt_join(members, hubs, ["bucket"], "inner", many).select(F.explode(F.array("p", F.struct("q.rep", "q.n"))).alias("c"), "rep", "n").where(near & (F.col("c.rep") != F.col("rep")))
    pairs = written(pairs.select(F.least("c.rep", "rep").alias("a"), F.greatest("c.rep", "rep").alias("b")).distinct(), "pairs")
    # a text may meet any member of its buckets later
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    wanted = written(wanted, "wanted")
    # texts that are in no shared bucket needn't move
    packed = apart(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(squeeze(["doc_id"], Sieve(wanted.select(F.col("doc_id").alias("k")))), "doc_id long, z binary"))
    sets = written(packed.join(wanted, "doc_id").mapInArrow(_sets(size), "doc_id long, shingles binary").distinct(), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sx"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sy"))
        # a hub has a pair with each member
        both = pairs
        for side, of in (("a", x), ("b", y)):
            both = dealt_join(both, of, [side], "inner", heavy(pairs.groupBy(side).agg(F.count("*").alias("n")), side))
        return both.select("a", "b", "sx", "sy").mapInArrow(_confirm(percent), "a long, b long, ok boolean").where("ok").select("a", "b").distinct()

    edges = written(confirmed(pairs), "links")
    # all members of the buckets of one hub: those outside its component meet everyone in another component, block by block
    around = dealt_join(members.select("bucket", "rep"), hubs.select("bucket", F.col("q.rep").alias("hub")), ["bucket"], "inner", many).select("hub", "rep").distinct()
    comp = written(components(edges), "components")
    around = written(around.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    groups = written(around.groupBy("hub").agg(F.count("*").alias("n")), "groups")
    many_around = heavy(groups, "hub")
    main = groups.select("hub").join(comp.select(F.col("node").alias("hub"), F.col("component").alias("main")), "hub", "left")
    around = dealt_join(around, main, ["hub"], "left", many_around).withColumn("outside", F.col("component") != F.coalesce("main", "hub"))
    around = written(around.select("hub", "rep", "component", "outside"), "around")
    counts = around.groupBy("hub").agg(F.count("*").alias("all"), F.count_if("outside").alias("out")).where("out > 0")
    counts = written(counts, "counts")
    step = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("rep"), step(n)).cast("int")
    around = dealt_join(around, counts, ["hub"], "inner", many_around).withColumn("i", place("out")).withColumn("j", place("all"))
    row = ["hub", "rep", "component"]
    x = around.where("outside").select(*row, "i", F.explode(F.sequence(F.lit(0), step("all") - 1)).alias("j"), F.lit(True).alias("asks"))
    y = around.select(*row, F.explode(F.sequence(F.lit(0), step("out") - 1)).alias("i"), "j", F.lit(False).alias("asks"))
    met = x.unionByName(y).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    more = met.groupBy("hub", "i", "j").applyInArrow(_meet(percent), "a long, b long").distinct()
    return classes, written(edges.unionByName(more), "links")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Links texts whose sets of size-word shingles have 100 * intersection >= percent * union. A pair at 80 per cent shares
    no bucket with a probability of 3e-6. A component of copies is named by its smallest doc_id, which alone is kept.
    doc_id is of a whole number's type; other keys need numbers of their own, as corpus_pipeline gives rows.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be a whole number")
    source = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = written(source.mapInArrow(_sign(size, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signatures")
    classes, edges = links(source, marks, size, percent)
    named = classes.select("k1", "k2", "rep").join(components(edges).withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    one = marks.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return one.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
