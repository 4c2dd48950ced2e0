"""Document fingerprints by winnowing, in DataFrame functions only.

A text's tokens are its words, what stands between white space; of a run of more than WORD characters without any, as in scripts without
spaces, each character is a token. So tokens depend on what is around them and not on places, and a character put in changes those next to it only. A gram's
rolling hash is the value of a polynomial of its K tokens; those of all places come from those of half as long grams, as SQL has no running
state: K tokens take log2(K) steps. From every window of W grams the smallest hash is chosen, the rightmost among equals, and its
position is kept: two texts that share K + W - 1 tokens in a row share a chosen gram. Rolling hashes only choose; a fingerprint holds
64 bits of a digest of each chosen gram. A text of fewer tokens than K has one gram of all of them, a text without tokens none. All steps are linear in a text's length.

Null text counts as empty. Two empty fingerprints are alike by 1, an empty and another one by 0. Rows without doc_id come last; rows
of equal doc_id follow each other by hash of text. A table of one row follows itself. Extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 8, 8
#: Characters of a run that is one token.
WORD = 16
#: Hexadecimal digits of a digest, and of that of a token.
DIGITS, SHORT = 16, 7
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: Places in a text, counted backwards in the lowest bits so that the rightmost of equal hashes is the smallest.
PLACES = 1 << 32
#: Documents of one block of neighbours, as long as BLOCKS do.
ROWS, BLOCKS = 1000, 4096


def _steps(n: int) -> list[int]:
    """1, 2, 4 and so on below n, a power of two."""
    return [1 << k for k in range(n.bit_length() - 1)]


def _bind(x: Column, f) -> Column:
    """f(x), where a lambda computes x once however often f needs it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _with_later(step: int, f):
    """Of an array, f(each element, the element step places on, its own place); what is beyond the end is null."""
    return lambda a: F.transform(a, lambda x, i: f(x, F.get(a, i + step), i))


def tokens(text: Column) -> Column:
    """array<string>"""
    runs = F.regexp_extract_all(text, F.lit(r"([^\x09-\x0D\x20]+)"), F.lit(1))
    return _bind(runs, lambda r: F.when(F.exists(r, lambda x: F.length(x) > WORD), F.flatten(F.transform(r, lambda x: F.when(F.length(x) > WORD, F.split(x, "")).otherwise(F.array(x))))).otherwise(r))


def chosen(text: Column) -> Column:
    """array<struct<h string, p long>>: digests of the chosen grams and their positions, in tokens."""
    digest = lambda x: F.substring(F.md5(x), 1, DIGITS)

    def of(t: Column) -> Column:
        n = F.size(t)
        codes = F.transform(t, lambda x: F.conv(F.substring(F.md5(x), 1, SHORT), 16, 10).cast("long"))
        rolled = lambda s: _with_later(s, lambda x, y, i: (x * pow(BASE, s, PRIME) + y) % PRIME)
        placed = lambda s: _with_later(s, lambda x, y, i: (x * pow(BASE, s, PRIME) + y) % PRIME * PLACES + (PLACES - 1 - i))
        grams = _bind(reduce(lambda a, s: _bind(a, rolled(s)), _steps(K)[:-1], codes), placed(K // 2))
        # windows that reach beyond the end would be of fewer grams, and are left out; so are grams that do, which are null
        least = lambda g: F.slice(reduce(lambda a, s: _bind(a, _with_later(s, lambda x, y, i: F.least(x, y))), _steps(W), g), F.lit(1), F.greatest(n - (K + W - 2), F.lit(0)))
        some = _bind(grams, lambda g: F.when(n >= K + W - 1, least(g)).otherwise(F.array(F.array_min(g))))
        # a place that is no longer chosen isn't chosen again
        places = F.transform(F.array_distinct(some), lambda x: PLACES - 1 - x % PLACES)
        picks = F.transform(places, lambda p: F.struct(digest(F.concat_ws(" ", *(F.get(t, p.cast("int") + k) for k in range(K)))).alias("h"), p.alias("p")))
        one = F.array(F.struct(digest(F.array_join(t, " ")).alias("h"), F.lit(0).cast("long").alias("p")))
        return F.when(n >= K, picks).when(n > 0, one).otherwise(F.filter(one, lambda x: F.lit(False)))

    return _bind(tokens(text), of)


def _joined(text: Column) -> Column:
    return F.array_join(F.transform(chosen(text), lambda x: x["h"]), " ")


def _apart(joined: Column) -> Column:
    """The distinct digests of a joined fingerprint."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(joined, " ")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint: array of chosen digests, positions: of their grams) for every row of docs(doc_id, text)."""
    picks = docs.select("doc_id", chosen(F.coalesce("text", F.lit(""))).alias("x"))
    return picks.select("doc_id", F.transform("x", lambda x: x["h"]).alias("fingerprint"), F.transform("x", lambda x: x["p"]).alias("positions"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with fingerprint, and following and following_fingerprint: those of the next document by ascending doc_id; after the last, the first.

    Neighbours meet in blocks between bounds that are drawn from the rows themselves by hash, so blocks are about equal however
    ids are spread; a block is found by binary search, and gets a copy of the row that follows it. Bounds and first rows are BLOCKS or so at most.
    """
    own = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(own).alias("h"))
    base = docs.select("doc_id", own.alias("text"), key.alias("key"))
    every = max(ROWS, -(-base.count() // BLOCKS))
    drawn = base.select("key").where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(every)) == 0).distinct().orderBy("key")
    bounds = [r["key"] for r in drawn.collect()]
    kind = base.schema["key"].dataType.simpleString()
    known = F.from_json(F.lit(json.dumps([{"none": b["none"], "id": b["id"], "h": b["h"]} for b in bounds])), f"array<{kind}>")
    # how many bounds aren't above the key
    size = len(bounds)
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(size.bit_length()))))
    block = F.aggregate(halves, F.lit(0), lambda n, s: F.when((n + s <= size) & (F.get(known, n + s - 1) <= F.col("key")), n + s).otherwise(n)) if size else F.lit(0)
    rows = base.withColumn("block", block)
    firsts = sorted(rows.groupBy("block").agg(F.min("key").alias("key")).collect(), key=lambda r: r["block"])
    after = [(r["block"], firsts[(i + 1) % len(firsts)]["key"]) for i, r in enumerate(firsts)]
    after = F.broadcast(docs.sparkSession.createDataFrame(after, f"block int, key {kind}"))
    copies = base.join(after, "key").select("doc_id", "text", "key", "block", F.lit(True).alias("copy"))
    both = rows.select("doc_id", "text", "key", "block", F.lit(False).alias("copy")).unionByName(copies).withColumn("fingerprint", _joined(F.col("text")))
    near = Window.partitionBy("block").orderBy("copy", "key", "text")
    both = both.withColumns({"following": F.lead("text").over(near), "following_fingerprint": F.lead("fingerprint").over(near)})
    return both.where("not copy").select("doc_id", "text", "fingerprint", "following", "following_fingerprint")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row of docs(doc_id, text)."""
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edit = F.concat(F.left("text", n - cut), F.left("following", cut))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "following_fingerprint", edit.alias("edit"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edit", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "following_fingerprint", _joined(F.col("edit")).alias("edited_fingerprint"))
    rows = rows.withColumns({"__a": _apart(F.col("fingerprint")), "__b": _apart(F.col("edited_fingerprint")), "__c": _apart(F.col("following_fingerprint"))})
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("__a"), F.col("__b")).alias("near_edited"), likeness(F.col("__a"), F.col("__c")).alias("near_next"))


def sql() -> str:
    """The same result as edited(), in DuckDB SQL, without chunks."""
    each = lambda a, f: f"list_transform({a}, lambda x: {f})"
    pairs = lambda s, f: f"[{f} for i in range(1, len(a) - {s} + 1)]"
    runs = "regexp_extract_all(s, '[^\\x09-\\x0D\\x20]+')"
    steps = [
        f"t as (select doc_id, kind, flatten({each(runs, f'case when length(x) > {WORD} then string_split(x, {chr(39) * 2}) else [x] end')}) as t from s)",
        f"c0 as (select doc_id, kind, t, {each('t', f'({chr(39)}0x{chr(39)} || left(md5(x), {SHORT}))::bigint')} as a from t where len(t) > 0)",
    ]
    for k, s in enumerate(_steps(K)):
        steps.append(f"c{k + 1} as (select doc_id, kind, t, " + pairs(s, f"(a[i] * {pow(BASE, s, PRIME)} + a[i + {s}]) % {PRIME}") + f" as a from c{k})")
    n, big = len(_steps(K)), 1 << 31
    placed = f"[a[i] * {big} + ({big} - i) for i in range(1, len(a) + 1)]"
    steps.append(f"m0 as (select doc_id, kind, t, {placed} as a from c{n} where len(t) >= {K + W - 1})")
    for k, s in enumerate(_steps(W)):
        steps.append(f"m{k + 1} as (select doc_id, kind, t, " + pairs(s, f"least(a[i], a[i + {s}])") + f" as a from m{k})")
    short = f"short as (select doc_id, kind, t, case when len(t) < {K} then [{big} - 1] else [list_min({placed})] end as a from c{n} where len(t) < {K + W - 1})"
    digest = f"left(md5(array_to_string(t[{big} - x % {big}:{big} - x % {big} + {K - 1}], ' ')), {DIGITS})"
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as following from d),
e as (select *, left(text, (length(text) - length(text) // 4)::int) || left(following, (length(text) // 4)::int) as edit from n),
s as (select doc_id, kind, s from e, lateral (values ('text', text), ('edit', edit), ('following', following)) v(kind, s)),
{', '.join(steps)}, {short},
p as (select * from m{len(_steps(W))} union all select * from short),
o as (select doc_id, kind, t, list_filter(a, lambda x, i: i = 1 or a[i - 1] <> x) as a from p),
f as (select doc_id, kind, {each('a', digest)} as f from o),
q as (select e.doc_id, coalesce(max(f) filter (kind = 'text'), []) as a, coalesce(max(f) filter (kind = 'edit'), []) as b, coalesce(max(f) filter (kind = 'following'), []) as c from e left join f using (doc_id) group by all)
select e.doc_id, length(e.text)::bigint as n_chars, sha256(e.edit) as edited_sha256, array_to_string(a, ' ') as fingerprint, array_to_string(b, ' ') as edited_fingerprint,
  case when len(list_distinct(a || b)) = 0 then 1.0::double else len(list_intersect(list_distinct(a), list_distinct(b)))::double / len(list_distinct(a || b)) end as near_edited,
  case when len(list_distinct(a || c)) = 0 then 1.0::double else len(list_intersect(list_distinct(a), list_distinct(c)))::double / len(list_distinct(a || c)) end as near_next
from e join q using (doc_id)"""
