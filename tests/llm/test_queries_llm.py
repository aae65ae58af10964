"""The registered queries against their SQL, and the pipeline against plain Python."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
import brute
from compare import connection, difference, spark_rows, sql_rows
from panelspark.llm import lines, mixing, packing, quality, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    got = spark_rows(entry.queries()[name](spark, FOLDER))
    assert difference(got, sql_rows(connection(FOLDER), queries.ORACLES[name])) == ""


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_agrees_with_plain(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "MIN_SITES", 3)
    monkeypatch.setattr(lines.remove_boilerplate, "__defaults__", (3,))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = quality_rows = [r for r, k in zip(rows, brute.quality([r[:4] for r in rows], quality)) if k]
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, read, str(tmp_path))
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in quality_rows)
    judged = brute.boilerplate([(r[0], r[1], r[3]) for r in good], 3)
    bare = [(r[0], text, r[2], r[3]) for r, (_, n, gone, text) in zip(good, judged) if not gone or gone < n]
    two = stages[1](spark, one, str(tmp_path))
    assert {(r.doc_id, r.text, r.n_chars) for r in two.collect()} == {(r[0], r[1], len(r[1])) for r in bare}
    firsts = {c for c, _ in brute.near_classes([r[:2] for r in bare])}
    unlike = [r for r in bare if r[0] in firsts]
    three = stages[2](spark, two, str(tmp_path))
    assert sorted(r.doc_id for r in three.collect()) == sorted(r[0] for r in unlike)
    copies = brute.mix([(r[0], r[1], r[3]) for r in unlike], mixing.offset_of(20))
    four = stages[3](spark, three, str(tmp_path))
    assert {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()} == {d: n for (d, _), n in copies.items() if n}
    for frame in (one, two, three, four):
        assert frame.columns == read.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    for (doc_id, text), n in copies.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        mine = packed[packed["doc_id"] == doc_id]
        assert mine["length"].sum() == n * len(ids)
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert list(part["offset"]) == list(np.cumsum([0, *part["length"][:-1]])) and part["length"].sum() <= 1024
