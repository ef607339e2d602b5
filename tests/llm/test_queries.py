"""The registered queries and the pipeline over the smallest supplied tables."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from trendframe.llm import toxicity
from trendframe.llm.common import shipped

from .test_decontaminate import slow as window_similarity
from .test_dedup import low, slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
                       "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op2_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint",
                            "loss_sha256": "string", "formatted_chars": "bigint"},
    "op3_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op4_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean",
                        "text_sha256": "string"},
    "op5_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6_simhash_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint",
                              "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint",
                         "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint",
                               "rank": "int"},
    "op13_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
}


def read(spark, name):
    return shipped(spark).read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_whole_table(spark, name):
    out = entry.queries()[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    if name == "op5_html_extraction":
        assert out.select("page_id").distinct().count() == read(spark, "pages").count()
    elif name == "op12_source_divergence":
        groups = read(spark, "documents").select(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).distinct().count()
        assert out.select("lang", "source").distinct().count() == groups
    elif name == "op13_nearest_neighbours":
        assert out.select("query_id").distinct().count() == read(spark, "embeddings").filter("vec_id % 50 = 0").count()
    elif name not in ("op2_chat_formatting", "op3_decontamination", "op11_prefix_trie"):
        assert out.select("doc_id").distinct().count() == read(spark, "documents").count()


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op4_exact_dedup", "op11_prefix_trie", "op12_source_divergence"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert all(((a[c].to_numpy() == b[c].to_numpy()) | (a[c].isna() & b[c].isna())).all() for c in cols)


def test_decontamination_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    items = {r.item_id: r.text for r in read(spark, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op3_decontamination"](spark, SF).collect()}
    shared = {(i, j) for i, t in docs.items() for j, b in items.items()
              if set(low(b).split()[2:6]) <= set(low(t).split()) and window_similarity(t, b) >= 0.8}
    assert shared <= got and all(window_similarity(docs[i], items[j]) >= 0.8 for i, j in got)


def test_pipeline_equals_brute_force(spark):
    docs = read(spark, "documents")
    machine = toxicity.train(docs, read(spark, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, machine).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect()}
    stage = {i: t for i, t in texts.items() if i not in toxic}
    last = {}
    for i in sorted(stage):
        last[low(stage[i])] = i
    stage = {i: stage[i] for i in last.values()}
    pairs = sorted((i, slow_fingerprint(t)) for i, t in stage.items())
    stage = {i: stage[i] for i in set(slow_components(pairs, 3))}
    leaks = {r.doc_id for r in entry.queries()["op3_decontamination"](spark, SF).collect()}
    stage = {i: t for i, t in stage.items() if i not in leaks}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, SF).collect()
    sizes, crc = {}, {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
        crc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(sizes) == set(stage)
    for i, t in stage.items():
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert sizes[i] == len(ids)
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c in crc[i])
    assert len(out) and 0 < len(toxic) < len(texts)


def test_stages_keep_columns_and_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "same words here and there again", None, None, 5),
            (3, "same words here and there again", "en", "s", 5), (3, "same words here and there again", "en", "s", 5)]
    docs = shipped(spark).createDataFrame(rows, schema)
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, empty, SF)
        assert none.count() == 0
        if name != "packing":
            assert out.columns == docs.columns and none.columns == docs.columns
            assert out.filter(F.col("doc_id") == 3).count() >= 1
    exact = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in exact) == [2, 3]
