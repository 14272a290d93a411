"""WARC archives: what is written is read back, wherever the magic occurs and files are split."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tilltrail.llm import warc

MAGIC = warc.MAGIC


def digest(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages) -> list[tuple]:
    first: dict = {}
    for page_id, _, html in pages:
        if page_id is not None and page_id < first.get(html or "", float("inf")):
            first[html or ""] = page_id
    rows = []
    for page_id, _, html in pages:
        least = first.get(html or "")
        revisit = least is not None and page_id != least
        rows.append((page_id, len((html or "").encode()), digest(html), "revisit" if revisit else "response", least if revisit else None))
    return sorted(rows, key=str)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], "page_id long, url string, html string, payload string, offset int")


def hostile_pages() -> list[tuple]:
    rnd = random.Random(6)
    inner = f"{MAGIC}WARC-Type: response\r\nWARC-Page-ID: 999\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = [
        None,
        "",
        "plain",
        "plain",
        "é漢字 ü",
        MAGIC,
        f"x{MAGIC}y{MAGIC}",
        inner,
        inner * 3,
        f"{MAGIC}Content-Length: 99999999999999999999\r\n\r\n",
        f"{MAGIC}Content-Length: 5\r\n\r\n",
        "\r\n\r\n" * 5,
        f"tail{MAGIC[:-1]}",
        "\r\n\r\n" + MAGIC[:5],
        "long " * 3000,
    ]
    pieces = ["a", "\r\n", MAGIC, "Content-Length: 4", "\r\n\r\n", "WARC", inner]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    urls = ["http://a/b?c", None, f"http://x/\r\n\r\n{MAGIC}", "http://é/ ü"]
    return [(i * 3, urls[i % 4], t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("compression", "split"), [("gzip", None), ("none", "97")])
def test_round_trip(spark, compression, split):
    pages = hostile_pages()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = warc.archive_round_trip(pages_of(spark, pages).coalesce(1), compression=compression).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(map(tuple, found), key=str) == expected(pages)


def test_missing_and_repeated_ids(spark):
    pages = [(5, "u", "same"), (None, "u", "same"), (3, None, "same"), (3, "u", "same"), (None, None, "alone"), (8, "u", "short")]
    found = warc.archive_round_trip(pages_of(spark, pages)).collect()
    assert sorted(map(tuple, found), key=str) == expected(pages)


def test_small_payloads_are_all_responses(spark):
    pages = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    found = warc.archive_round_trip(pages_of(spark, pages), smallest=3).collect()
    assert {r["page_id"]: r["refers_to"] for r in found} == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark):
    assert warc.archive_round_trip(pages_of(spark, [])).count() == 0


def test_only_the_chain_from_the_start_is_reached(spark):
    links = [("f", 0, 10), ("f", 5, 10), ("f", 10, 30), ("f", 12, 30), ("f", 30, 77), ("g", 4, 9), ("h", 0, None), ("h", 3, 3)]
    links += [("k", i, i + 1) for i in range(70)]
    table = spark.createDataFrame(links, "file string, offset long, next long")
    found = {(r["file"], r["offset"]) for r in warc.reached(table).collect()}
    assert {x for x in found if x[0] != "k"} == {("f", 0), ("f", 10), ("f", 30), ("f", 77), ("h", 0)}
    assert {x for f, x in found if f == "k"} == set(range(71))


def test_pieces_do_not_depend_on_how_a_later_read_packs_files(spark, monkeypatch):
    pages = pages_of(spark, [(i, "http://a/b", f"{i} {MAGIC}y{MAGIC} {i}") for i in range(24)]).repartition(6)
    least, reached = "spark.sql.files.minPartitionNum", warc.reached
    merged = "spark.sql.adaptive.coalescePartitions.enabled"

    def packed_anew(links):
        found = reached(links)
        spark.conf.set(least, "1")
        return found

    monkeypatch.setattr(warc, "reached", packed_anew)
    spark.conf.set(least, "64")
    spark.conf.set(merged, "false")
    try:
        found = warc.archive_round_trip(pages).collect()
    finally:
        spark.conf.unset(least)
        spark.conf.unset(merged)
    assert sorted((r["page_id"], r["payload_digest"]) for r in found) == [
        (i, digest(f"{i} {MAGIC}y{MAGIC} {i}")) for i in range(24)
    ]


def test_two_calls_do_not_share_archives(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(warc, "write_archives", lambda pages, path, *rest, write=warc.write_archives: (paths.append(path), write(pages, path, *rest)))
    pages = spark.createDataFrame([(1, "a"), (2, "a")], "page_id long, html string").withColumn("url", F.lit("http://a.b/"))
    first, second = warc.archive_round_trip(pages), warc.archive_round_trip(pages.limit(1))
    assert len(set(paths)) == 2
    assert (first.count(), second.count()) == (2, 1)
