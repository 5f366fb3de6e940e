"""The pipeline and the registered queries of the subpackage on small tables."""

import os
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import TABLES, cell
from crawlsieve.llm import bpe
from crawlsieve.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels and benchmark with a case for every stage; also columns that stages use themselves."""
    rng = np.random.default_rng(9)
    text = lambda seed, n=60: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))
    rows = [(i, text(i) + (" vile" if i % 4 == 0 else "")) for i in range(1000, 1600)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(1000, 1600)]
    item = " ".join(f"t{i}" for i in range(25))
    rows += [(1, text(1)), (2, text(1) + " tail"), (3, text(3) + " " + item + " " + text(4)), (4, text(5) + " mail me@x.example now"), (5, text(6) + " vile"), (6, None), (7, ""), (None, text(8)), (9, text(9)), (9, text(9)), (10, text(1))]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, class_id long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows), rng


def test_pipeline_stages_do_their_work(spark, tables):
    path, texts, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), name)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns or name == "byte_bpe"
    assert 5 not in kept["toxicity"] and not [i for i in range(1000, 1600, 4) if i in kept["toxicity"]]
    assert set(range(1001, 1600, 4)) <= set(kept["toxicity"]) and kept["toxicity"].count(9) == 2 and None in kept["toxicity"]
    near = kept["near_duplicates"]
    assert 1 in near and 2 not in near and 10 not in near and near.count(9) == 1 and {6, 7, None} <= set(near) and set(range(1001, 1600, 4)) <= set(near)
    assert set(near) - set(kept["decontamination"]) == {3} and kept["personal_data"] == kept["decontamination"] or sorted(map(str, kept["personal_data"])) == sorted(map(str, kept["decontamination"]))
    last = {r.doc_id: r for r in docs.collect()}
    assert last[4].text == texts[4].replace("me@x.example", "[EMAIL]") and last[1].text == texts[1] and last[6].text == ""
    tokens = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = np.frombuffer(bytes(last[1].ids), "<u4")
    assert tokens.decode(ids, np.array([len(ids)]))[0].tobytes().decode() == texts[1]


def test_pipeline_takes_an_empty_table(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_every_operator_has_its_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
