"""Cross-parsing against a plain parse, and accuracy on documents that were held out."""

from __future__ import annotations

import random
import zlib

import numpy as np

from tilltrail.llm import language


def plain_phrases(text: list[int], sample: list[int]) -> int:
    """Longest phrases that occur in the sample, a lane at a time."""
    held = bytes(sample)
    count = 0
    for start in range(0, len(text), language.LANE):
        lane = bytes(text[start : start + language.LANE])
        at = 0
        while at < len(lane):
            end = at + 1
            while end < len(lane) and lane[at : end + 1] in held and lane[at:end] in held:
                end += 1
            at = end
            count += 1
    return count


def test_phrases_are_those_of_a_plain_parse():
    rnd = random.Random(2)
    sample = "".join(rnd.choice("abc d") for _ in range(300)).encode()
    model = language.train({"x": sample})
    texts = [b"", b"z", b"abcabc", b"ABC, abc -- 1", "é a".encode(), bytes(rnd.choice(b"abcd e") for _ in range(5000))]
    bits = language.entropies(model, texts)
    for text, found in zip(texts, bits[:, 0], strict=True):
        symbols = language.parsed_bytes(text).tolist()
        expected = plain_phrases(symbols, language.parsed_bytes(sample).tolist())
        assert np.isclose(found * max(1, len(symbols)) / model.parsers[0].bits, expected)


def test_slabs_do_not_change_sums(monkeypatch):
    rnd = random.Random(4)
    model = language.train({"x": b"some words of a language", "y": b"andere Worte einer Sprache"})
    texts = [bytes(rnd.choice(b"abcdefgh ") for _ in range(rnd.choice([0, 10, 3000, 9000]))) for _ in range(20)]
    whole = language.entropies(model, texts)
    monkeypatch.setattr(language, "SLAB_BYTES", 1024 * 4)
    assert np.abs(language.entropies(model, texts) - whole).max() < 0.05


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(found) == len(rows)
    judged = [(r["lang"], found[r["doc_id"]]) for r in rows if r["lang"] and found[r["doc_id"]]["held_out"]]
    assert len(judged) > 100
    assert sum(lang == f["lang_pred"] for lang, f in judged) >= 0.97 * len(judged)
    for row in rows:
        assert found[row["doc_id"]]["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= found[row["doc_id"]]["score"] <= 1


SCHEMA = "doc_id long, text string, lang string, score int, lang_pred int, text2 string"


def edge_docs(spark):
    rows = [(i, "the cat sat on the mat and the dog " * 3, "en") for i in range(12)]
    rows += [(i, "der Hund und die Katze sind auf dem Dach " * 3, "de") for i in range(12, 24)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "12 !? 3", None), (93, "漢字", None), (None, "the dog and the cat", None)]
    rows += [(94, "the cat " * 40_000, None), (94, "the cat " * 40_000, None)]
    return spark.createDataFrame([(i, t, x, 1, 2, "z") for i, t, x in rows], SCHEMA)


def test_edges(spark):
    found = language.identify(edge_docs(spark)).collect()
    assert len(found) == 31
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (90, 91, 92)] == ["und"] * 3
    assert by[93]["lang_pred"] in ("de", "en")
    assert by[None]["held_out"] is True
    assert by[94]["lang_pred"] == "en" and by[None]["lang_pred"] == "en"


def test_lang_and_id_are_no_inputs(spark):
    docs = edge_docs(spark)
    model = language.train(language.training_samples(docs))
    found = language.predict(docs, model, ["doc_id"]).collect()
    other = language.predict(docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'xx' AS lang"), model, ["doc_id"]).collect()
    assert sorted((r["lang_pred"], r["score"]) for r in found) == sorted((r["lang_pred"], r["score"]) for r in other)


def test_stage_keeps_columns_and_drops_what_has_no_language(spark):
    docs = edge_docs(spark)
    kept = language.readable_documents(docs)
    assert kept.columns == docs.columns and kept.schema["score"].dataType == docs.schema["score"].dataType
    assert {90, 91, 92}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert kept.count() == 28


def test_nothing_to_learn_from(spark):
    docs = edge_docs(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_without_labels_documents_with_letters_stay(spark):
    rows = [(i, t, None) for i, t in enumerate(["some text", "12 34 !", None, "", "слово"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language.readable_documents(docs).collect()) == [0, 4]
