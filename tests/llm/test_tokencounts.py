"""Counts after edits against counting the edited text anew."""

from __future__ import annotations

import random

import pytest

from tilltrail.llm import tokencounts as T


@pytest.fixture(scope="module")
def counter():
    return T.Counter()


def pieces_of(doc):
    return [p for leaf in doc.leaves for p in leaf.pieces]


def test_edits_end_where_cutting_anew_does(counter):
    rnd = random.Random(1)
    letters = "ab c'  \n1.,sé t"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 40, 900])))
        doc = T.Document.of(text, counter)
        for _ in range(rnd.randint(1, 4)):
            start = rnd.randint(0, len(text))
            end = min(len(text), start + rnd.choice([0, 1, 3, 20, 300]))
            new = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 9, 200])))
            doc.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert pieces_of(doc) == counter.cut.findall(text)
            assert doc.text() == text and doc.length == len(text)
            assert doc.count == len(counter.encoding.encode_ordinary(text))


def test_an_edit_recounts_only_its_surroundings(counter):
    doc = T.Document.of("some words and numbers 12 34. " * 20_000, counter)
    doc.edit(300_000, 300_004, "other")
    assert doc.recounted < 12
    doc.edit(10**9, 10**9, " end")
    assert doc.text().endswith(" end") and doc.recounted < 24


def test_leaves_split_where_a_text_grows(counter):
    rnd = random.Random(3)
    doc, text = T.Document.of("", counter), ""
    for i in range(400):
        at = rnd.choice([len(text), rnd.randint(0, len(text))])
        new = "".join(f" w{rnd.randint(0, 99)}, " for _ in range(rnd.randint(1, 40)))
        doc.edit(at, at, new)
        text = text[:at] + new + text[at:]
        assert max(len(leaf.pieces) for leaf in doc.leaves) <= 2 * T.LEAF
        if i % 50 == 0:
            assert pieces_of(doc) == counter.cut.findall(text)
    assert pieces_of(doc) == counter.cut.findall(text) and doc.length == len(text)
    assert doc.count == len(counter.encoding.encode_ordinary(text))
    assert len(doc.leaves) > 100 and len(doc.chars[0]) == len(doc.tokens[0]) == len(doc.leaves)
    doc.edit(0, len(text), "")
    assert (doc.count, doc.text()) == (0, "")


def test_vocabulary_is_read_by_the_driver(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    with pytest.raises(FileNotFoundError, match="ranks_path"):
        T.count_with_edits(docs, ranks_path=str(tmp_path / "absent"))
    own = tmp_path / "ranks"
    own.write_bytes(T.vocabulary())
    counted = T.count_with_edits(docs, ranks_path=str(own))
    own.unlink()
    assert counted.first()["tokens"] == 2


def test_what_is_remembered_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(T, "KNOWN", 50)
    own = T.Counter()
    text = " ".join(f"word{i}" for i in range(500))
    assert T.Document.of(text, own).count == len(own.encoding.encode_ordinary(text))
    assert len(own.known) <= 50


def test_documents(spark, counter):
    texts = [None, "", "mail me at ann.b@mail.example.com now", "call +1 (484) 555-1787 or 51.36.177.135.", "plain", "plain", "x " * 50_000 + "a@b.cd"]
    rows = [(i if i != 5 else None, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int, n_edits int")
    found = {r["doc_id"]: r for r in T.count_with_edits(docs).collect()}
    assert len(found) == len(texts)
    edited = ["", "", "mail me at [mail] now", "call [phone] or [address].", "plain", "plain", "x " * 50_000 + "[mail]"]
    for (i, text, _, _), after in zip(rows, edited, strict=True):
        assert found[i]["tokens"] == len(counter.encoding.encode_ordinary(text or ""))
        assert found[i]["tokens_edited"] == len(counter.encoding.encode_ordinary(after))
    assert [found[i]["n_edits"] for i in (0, 1, 2, 3, 4)] == [0, 0, 1, 2, 0]
    assert T.count_with_edits(docs.limit(0)).count() == 0


def test_the_test_table(spark, counter):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r for r in T.count_with_edits(docs).collect()}
    edits = 0
    for row in docs.collect():
        text = row["text"] or ""
        assert found[row["doc_id"]]["tokens"] == len(counter.encoding.encode_ordinary(text))
        for start, end, new in reversed(T.redactions(text)):
            text = text[:start] + new + text[end:]
            edits += 1
        assert found[row["doc_id"]]["tokens_edited"] == len(counter.encoding.encode_ordinary(text))
    assert edits
