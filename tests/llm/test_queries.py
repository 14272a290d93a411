"""The queries: results agree with SQL where there is some, columns are those asked for; the pipeline's stages."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest
from test_decontaminate import QUESTION
from test_packing import checked
from test_simhash import plain_components

import corpus_pipeline
from tilltrail.llm import packing, queries

TABLES = "documents embeddings pages benchmark labels conversations".split()
COLUMNS = {
    "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op2_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op4_simhash": ["doc_id", "fingerprint", "component_id"],
    "op5_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op8_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op10_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op12_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op13_prefix_trie": [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ],
}


@pytest.fixture(scope="module")
def duck(request):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    names = sorted(found.columns)
    answer = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    assert names == sorted(columns)
    expected = [tuple(row[columns.index(c)] for c in names) for row in answer.fetchall()]
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert set(COLUMNS[name]) <= set(found.columns)


def test_pipeline_is_registered():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id",
        "simhash_near_dedup",
        "benchmark_decontamination",
        "best_fit_packing",
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stage_by_stage(spark, tmp_path):
    base = "a text about many things that goes on for a while and says the same again and again "
    rows = [(i, f"{base * 3} number {chr(97 + i)}{chr(98 + i)} {'different words here ' * i}", "en") for i in range(8)]
    rows += [(20, rows[3][1], "en"), (21, None, "en"), (22, "", None), (23, "12 34 !", "en"), (24, f"{base} {QUESTION}", "en")]
    rows += [(25, "ganz anderer Text in einer anderen Sprache " * 5, "de"), (26, "mot " * 9000, None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {i: t for i, t, _ in rows}
    language, dedup, clean, pack = (stage for _, stage in corpus_pipeline.STAGES)
    one = language(spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    left = {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert sorted(r.doc_id for r in one.collect()) == sorted(left)
    two = dedup(spark, one, str(tmp_path))
    assert two.columns == docs.columns
    left = set(plain_components([(i, texts[i]) for i in left]).values())
    assert sorted(r.doc_id for r in two.collect()) == sorted(left) and 20 not in left
    three = clean(spark, two, str(tmp_path))
    assert three.columns == docs.columns
    left.discard(24)
    assert sorted(r.doc_id for r in three.collect()) == sorted(left)
    four = corpus_pipeline.run(spark, str(tmp_path))
    sizes = defaultdict(int, {i: len(texts[i].split()) for i in left})
    packed = four.collect()
    assert {r.doc_id for r in packed} == left
    order = sorted(left)
    renamed = [{**r.asDict(), "doc_id": order.index(r.doc_id)} for r in packed]
    checked(renamed, [sizes[i] for i in order], packing.CAPACITIES)
    assert sorted(map(tuple, pack(spark, three, str(tmp_path)).collect())) == sorted(map(tuple, packed))


def test_pipeline_without_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    own = {"_score": 9.5, "_lang_pred": "x", "_row_key": 7, "_doc_id": 8, "_key": 9, "row_key": 10, "score": 1.5, "_text": "t", "_h": 3}
    rows = [(1, "ein Text mit Worten", "de", *own.values()), (2, "a text of some words", "en", *own.values()), (2, "a text of some words", "en", *own.values())]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", *own])
    spark.createDataFrame([(0, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for (name, stage), left in zip(corpus_pipeline.STAGES[:3], (3, 2, 3)):
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        kept = found.collect()
        assert len(kept) == left and {tuple(r) for r in kept} == set(map(tuple, rows)), name
