"""The pipeline's stages on a fixture, and the queries that have SQL against DuckDB."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import queries
from tests.llm.test_operators import brute_links, brute_repeats, good, near_group, prose

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark."""
    at = tmp_path_factory.mktemp("tables")
    shared = prose(777, 60)
    texts = [good(i) for i in range(60)] + [good(i).upper().replace(" ", "!! ") for i in range(60, 90)] + near_group(5, 150, 12, 0.04) + [good(200)] * 3
    texts += [f"{good(300 + i)} {shared} {good(400 + i)}" for i in range(4)] + [f"{good(500)} {prose(888, 25)} {good(501)}", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, prose(888, 25)), (1, prose(889, 30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns)
        kept.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
        old = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        if k == 0:
            assert not set(range(60, 90)) & set(kept[0]) and set(range(60)) <= set(kept[0])
        elif k == 1:
            assert set(kept[1]) == {i for i, (_, c) in brute_links(old, 5, 80).items() if c == i}
        elif k == 2:
            ids = sorted(old)
            want = dict(zip(ids, brute_repeats([old[i] for i in ids]), strict=True))
            assert set(kept[2]) == set(old) and all(len((kept[2][i] or "").encode()) == want[i][0] - want[i][1] for i in ids)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)
        elif k == 3:
            assert set(old) - set(kept[3]) == {109}
        else:
            assert kept[4] == kept[3] and docs.where("not round_trip").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, tables).collect()} == set(kept[4])


def test_stages_on_odd_rows(spark, tables):
    """Repeated rows, rows without doc_id, very long texts, and columns of all names that operators use inside."""
    long = ". ".join(good(2000 + i) for i in range(300))
    names = "z found copied __k n_bytes n_removed n_spans __text __p1 __grade ids n_ids row_number row grade p1 salt number key k Text_2 a.b".split()
    rows = [(None, good(900)), (None, good(900)), (None, good(901)), (5, good(902)), (5, good(902)), (5, good(903)), (6, None), (7, ""), (7, ""), (8, long), (9, good(902)), (10, good(901)), (11, good(904).upper().replace(" ", "!! "))]
    docs = spark.createDataFrame([(str(i) if i else None, t, "en", "s", len(t or ""), *names) for i, t in rows], "doc_id string, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted((r["doc_id"] or "", r["text"] or "") for r in df.collect())
    for name, stage in stages.items():
        out = stage(spark, docs, tables)
        made = {"ids", "n_ids"} if name.startswith("Sentence") else set()
        assert set(out.columns) >= set(docs.columns) and all(r[c] == c for r in out.collect() for c in set(names) - made), name
    assert key(stages["quality classifier"](spark, docs, tables)) == key(docs.where("doc_id is null or doc_id not in ('6', '7', '11')").unionByName(stages["quality classifier"](spark, docs.where("doc_id in ('6', '7', '11')"), tables)))
    kept = key(stages["MinHash near-dedup"](spark, docs, tables))
    assert kept == sorted([("", good(900)), ("10", good(901)), ("5", good(902)), ("5", good(903)), ("6", ""), ("7", ""), ("7", ""), ("8", long), ("11", good(904).upper().replace(" ", "!! "))])
    cut = stages["suffix-array dedup"](spark, docs, tables)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert key(stages["benchmark decontamination"](spark, docs, tables)) == key(docs)
    assert stages["SentencePiece encoding"](spark, docs, tables).where("not round_trip").count() == 0


def test_scratch_tables_go(spark, tables):
    from chronoloom.llm import common

    before = len(common.SCRATCH)
    out = corpus_pipeline.run(spark, tables)
    assert len(common.SCRATCH) == before + 1 and out.count() > 0


def test_stages_on_nothing(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_queries_return_what_is_agreed(spark):
    if not DATA.exists():
        pytest.skip("no tables")
    n = {t: spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("documents", "pages")}
    want = {
        "op1_html": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
        "op5_suffix": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}),
        "op6_urls": ("pages", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}),
        "op8_winnow": ("documents", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}),
        "op9_minhash": ("documents", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}),
        "op10_toxicity": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    }
    for name, (table, columns) in want.items():
        got = queries.queries()[name](spark, str(DATA))
        assert columns.items() <= dict(got.dtypes).items(), name
        assert got.count() == n[table], name
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, str(DATA))
        cols = sorted(got.columns)
        text = lambda rows: sorted(map(repr, rows))
        assert text(map(tuple, got.select(*map(F.col, cols)).collect())) == text(con.sql(f"select {', '.join(cols)} from ({sql})").fetchall()), name
