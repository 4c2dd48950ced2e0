"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Compiled from a model file, as the composition of two machines: the normaliser (a space becomes the piece mark, a mark is put before the text) and the pieces
(a trie whose arcs write piece ids, weighted by minus their scores, and the byte fallback: a character that no piece has becomes its
UTF-8 bytes). Composition leaves one trie over the characters of the input, in which an arc for a mark is one for a space too. A text is
composed with it place by place, and the shortest path in the tropical semiring is read off: weights add along a path, the least is chosen among paths.

A model of kind BPE restricts which piece may follow which, as its merges are no sum of weights: the states carry the last piece, and an arc exists only if merging
the two pieces' characters by score gives these two pieces again. The shortest path over those states is what merging gives. No
piece has the mark after another character, so a text falls apart before every mark or space, as well as at characters without
a piece, and shortest paths of parts are kept.

Null text counts as empty and has no ids. Decoding turns the mark into a space, also where the text itself had the mark, and
replaces bytes that are not UTF-8. Ids out of range are errors. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from chronoloom.llm.common import REMEMBERED, fields, lean, lists, packed, step, unpacked

MARK = "▁"
#: Kinds of pieces in the model format.
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts whose paths a worker remembers.
KEPT = 250_000
#: Pairs of pieces whose fit it remembers.
FOLLOWS = 400_000
#: Pieces of equal scores that parts are searched for.
TIED = 16


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        match key & 7:
            case 0:
                yield key >> 3, varint()
            case 1:
                yield key >> 3, raw[at : (at := at + 8)]
            case 2:
                n = varint()
                yield key >> 3, raw[at : (at := at + n)]
            case 5:
                yield key >> 3, struct.unpack("<f", raw[at : (at := at + 4)])[0]
            case kind:
                raise ValueError(f"wire type {kind}")


class Leaf:
    """The arc that ends a piece."""

    __slots__ = ("piece", "ids", "weight", "after", "get")

    def __init__(self, piece: str, ids: tuple[int, ...], weight: float):
        self.piece, self.ids, self.weight = piece, ids, weight
        #: after which pieces it may stand, as far as that was needed
        self.after: dict[str | None, bool] = {}
        self.get = self.after.get


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models that keep the text as it is, with marks for spaces, can be compiled")
        self.prefix = MARK if normalizer.get(3, 1) else ""
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, DEFINED, UNUSED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, DEFINED)}
        self.trie: dict = {}
        for p, i in self.ids.items():
            if self.pieces[i][2] == UNUSED:
                continue
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = Leaf(p, (i,), -self.pieces[i][1])
        # merging gives one row of pieces, and only that one's neighbours all fit, where no two merges have one score and every character of a piece is one
        merges = Counter(s for p, s in self.score.items() if len(p) > 1)
        tied: list[str] = []
        for p in sorted((p for p, s in self.score.items() if len(p) > 1 and merges[s] > 1), key=len):
            if len(tied) <= TIED and not any(x in p for x in tied):
                tied.append(p)
        #: whether parts without tied pieces have one path; finds these pieces
        self.single = self.kind == BPE and len(tied) <= TIED and all("" in self.trie.get(c, ()) for c in {c for p in self.score for c in p})
        self.tied = re.compile("|".join(re.escape(p).replace(MARK, f"[ {MARK}]") for p in tied) or r"(?!)").search
        #: pairs of pieces that leaves remember
        self.held = 0
        #: ids of parts, as bytes
        self.kept: dict[str, bytes] = {}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has the mark after another character")
        # the normaliser's arcs: a space reads as the mark
        nodes, seen = [self.trie], set()
        while nodes:
            node = nodes.pop()
            if id(node) not in seen:
                seen.add(id(node))
                nodes += [x for c, x in node.items() if c]
                if MARK in node:
                    node[" "] = node[MARK]
        line = "" if any("\n" in p for p in self.ids) else "\n"
        self.split = re.compile(f"[ {MARK}]+[^ {MARK}{line}]*|[^ {MARK}{line}]+" + (f"|{line}+" if line else "")).findall
        #: what decoding writes for each id
        self.written = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]

    def _merged(self, text: str) -> list[str]:
        """Merging by score, best first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, last: str | None, leaf: Leaf, node: dict) -> bool:
        if not leaf.after and self.kind == BPE and len(leaf.piece) > 1 and self._merged(leaf.piece) != [leaf.piece]:
            # merging never gives the piece
            node.pop("", None)
            return False
        ok = last is None or self.kind == UNIGRAM or self._merged(last + leaf.piece) == [last, leaf.piece]
        if self.held < FOLLOWS:
            self.held += 1
            leaf.after[last] = ok
        return ok

    def path(self, part: str) -> tuple[int, ...]:
        """Ids on the shortest path of the machine composed with one part of a text."""
        return self._only(part) if self.single and not self.tied(part) else self._shortest(part)

    def _only(self, part: str) -> tuple[int, ...]:
        """The same where the machine has one path for a text: depth first, long arcs first. A place is reached by one path only, so none is tried twice."""
        n, trie, fits = len(part), self.trie, self._may_follow
        seen = bytearray(n + 1)
        # arcs to try: place after it, piece or None, ids, its node, the arc before
        stack: list[tuple] = [(0, None, (), None, None)]
        while stack:
            arc = stack.pop()
            at, leaf, _, node, before = arc
            if seen[at]:
                continue
            if leaf is not None:
                last = before[1] and before[1].piece
                ok = leaf.get(last)
                if not ok and (ok is not None or not fits(last, leaf, node)):
                    continue
            if at == n:
                break
            seen[at] = 1
            node, k = trie.get(part[at]), at + 1
            if node is None:
                stack.append((k, None, tuple(self.bytes[b] for b in (MARK if part[at] == " " else part[at]).encode()) if self.bytes else (self.unknown,), None, arc))
            while node is not None:
                if "" in node and not seen[k]:
                    leaf = node[""]
                    stack.append((k, leaf, leaf.ids, node, arc))
                if k == n:
                    break
                node, k = node.get(part[k]), k + 1
        else:
            return self._shortest(part)
        out = []
        while arc is not None:
            out.append(arc[2])
            arc = arc[4]
        return tuple(i for ids in reversed(out) for i in ids)

    def _shortest(self, part: str) -> tuple[int, ...]:
        n, trie = len(part), self.trie
        # states of each place: last piece, weight, ids of the arc, state before; a piece that ends at a place has one beginning
        states: list[list[tuple] | None] = [None] * (n + 1)
        states[0] = [(None, 0.0, (), None)]
        for at in range(n):
            here = states[at]
            if here is None:
                continue
            node, k = trie.get(part[at]), at + 1
            if node is None:
                # no piece follows or precedes such a character otherwise than it does
                c = MARK if part[at] == " " else part[at]
                best = min(here, key=lambda x: x[1])
                states[k] = [(None, best[1], tuple(self.bytes[b] for b in c.encode()) if self.bytes else (self.unknown,), best)]
                continue
            while node is not None:
                if "" in node:
                    leaf = node[""]
                    get, best = leaf.get, None
                    for state in here:
                        ok = get(state[0])
                        if (ok or ok is None and self._may_follow(state[0], leaf, node)) and (best is None or state[1] < best[1]):
                            best = state
                    if best is not None:
                        state = (leaf.piece, best[1] + leaf.weight, leaf.ids, best)
                        if states[k] is None:
                            states[k] = [state]
                        else:
                            states[k].append(state)
                if k == n:
                    break
                node, k = node.get(part[k]), k + 1
        out, state = [], min(states[n], key=lambda x: x[1])
        while state is not None:
            out.append(state[2])
            state = state[3]
        return tuple(i for ids in reversed(out) for i in ids)

    def _read(self, part: str) -> bytes:
        raw = array("i", self.path(part)).tobytes()
        if len(self.kept) < KEPT:
            self.kept[part] = raw
        return raw

    def ids_of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        get, read = self.kept.get, self._read
        return np.frombuffer(b"".join([get(part) or read(part) for part in self.split(self.prefix + text)]), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.ids_of(text).tolist()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.written.__getitem__, ids))
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode(errors="replace")


def read_model(path: str | None = None) -> bytes:
    """The model file; by default the public one that is installed with the tokenizer files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def machine_of(model: bytes) -> Transducer:
    """One machine for all tasks of a worker, with what it remembers."""
    return Transducer(model)


REMEMBERED.append((__name__, machine_of.cache_clear))


@step
def _encode(model: bytes, columns: list[str]):
    def run(batches):
        machine = machine_of(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids, digests, same = [], [], []
                for text in part.column("text").to_pylist():
                    ids.append(machine.ids_of(text))
                    back = machine.decode(ids[-1].tolist())
                    digests.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == (text or ""))
                counts = [len(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), lists(np.concatenate([*ids, np.zeros(0, np.int32)]), counts), pa.array(counts, pa.int64()), pa.array(digests), pa.array(same)],
                    [*columns, "ids", "n_ids", "decoded_sha256", "round_trip"],
                )

    return run


def encoded(docs: DataFrame, columns: list[str] | None = None, model: str | None = None) -> DataFrame:
    """The chosen columns of docs (default doc_id), ids, n_ids, decoded_sha256 and round_trip (whether decoding gives the text again).

    Columns of docs that bear these names, in whatever case, are replaced.
    """
    made = {"ids": ArrayType(IntegerType()), "n_ids": "long", "decoded_sha256": "string", "round_trip": "boolean"}
    columns = [c for c in docs.columns if c in (["doc_id"] if columns is None else columns) and c.lower() not in made]
    source = packed(lean(docs).select(*(F.col(f"`{c}`") for c in columns), *([] if "text" in columns else ["text"])))
    kept = ["row", "text"] if "text" in columns else ["row"]
    schema = fields(source, *kept)
    for name, kind in made.items():
        schema = schema.add(name, kind)
    return source.mapInArrow(_encode(read_model(model), kept), schema).transform(unpacked, columns, *made)


@step
def _decode(model: bytes):
    def run(batches):
        machine = machine_of(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if x is None else machine.decode(x) for x in part.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decoded(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of tokens(doc_id, ids); null ids give null."""
    return tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(read_model(model)), f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")
