"""Decontamination against planted copies and a plain search for literal windows."""

from __future__ import annotations

import random
import re

from tilltrail.llm import decontaminate

QUESTION = "A farmer named Otto has 12 apples and buys 7 kg of pears, then Otto gives 12 of them to a friend in Berlin tomorrow"
CHANGED = "A farmer named Hugo has 31 apples and buys 9 lb of pears, then Hugo gives 31 of them to a friend in Madrid tomorrow"
MIXED = "A farmer named Hugo has 31 apples and buys 9 lb of pears, then Karl gives 44 of them to a friend in Madrid tomorrow"
FILLER = "some words that stand around the passage and say nothing at all about it"


def docs_of(spark, texts):
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, item_id int, hash string")


def bench_of(spark, texts):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "item_id long, text string, doc_id int")


def found_in(spark, texts, items, **options):
    rows = decontaminate.contaminated(docs_of(spark, texts), bench_of(spark, items), **options).collect()
    return {(r["doc_id"], r["item_id"]): (r["windows"], r["changed_slots"]) for r in rows}


def test_literal_and_changed_copies_are_found_and_inconsistent_ones_are_not(spark):
    texts = [
        f"{FILLER}. {QUESTION} {FILLER}",
        f"{FILLER}. {CHANGED}. {FILLER}",
        f"{FILLER}. {MIXED}. {FILLER}",
        FILLER,
        QUESTION.lower(),
        QUESTION.upper(),
        None,
        "",
        QUESTION,
        QUESTION,
    ]
    found = found_in(spark, texts, [QUESTION])
    assert set(found) == {(i, 0) for i in (0, 1, 4, 5, 8, 9)}
    assert found[0, 0][1] == 0 and found[8, 0][1] == 0
    assert found[1, 0][1] > 0


def test_values_must_map_one_to_one(spark):
    item = "given the numbers 5 and 5 and 8 find the sum of all the even ones among them"
    same = "given the numbers 3 and 3 and 4 find the sum of all the even ones among them"
    split = "given the numbers 3 and 2 and 4 find the sum of all the even ones among them"
    merged = "given the numbers 3 and 3 and 3 find the sum of all the even ones among them"
    assert set(found_in(spark, [same, split, merged], [item])) == {(0, 0)}


def test_forms_that_are_taken_over_are_those_split_apart(spark):
    """Texts without numbers, without names, with both and with neither; breaks of both kinds; white space of any kind."""
    texts = [None, "", " . ", "Is it", "one, two.three:four", "1.5 kg, 2:30 and 7.", "so Otto. Then Hugo went", QUESTION, FILLER, "a\u00a0 b\n\nC d.e",
             "x5 Ab %Cd 3Ef gH Ij", "\u0001number of \u0001name", "\u00c4rzte in \u00d6sterreich \u0660\u0661"]
    rows = docs_of(spark, texts).select("doc_id", "text")
    D, F = decontaminate, decontaminate.F
    whole = rows.withColumn("_text", D._plain(F.col("text"))).withColumn("_numbered", D._numbered(F.col("_text")))
    before = r"(?<![\p{L}\p{N}%])\p{Lu}\p{Ll}\p{L}*"
    apart = whole.select(
        *rows.columns,
        D._split(F.col("_text"), D._BREAKS_OUTSIDE_NUMBERS).alias("cased"),
        D._split(F.lower("_text"), D._BREAKS_OUTSIDE_NUMBERS).alias(D.LITERAL),
        D._split(F.lower("_numbered")).alias("numbers"),
        D._split(F.lower(F.regexp_replace("_numbered", D._NAME, D.NAME))).alias("sentence"),
        D._split(F.lower(F.regexp_replace("_numbered", before, D.NAME))).alias("names"),
    )
    assert D._with_words(rows).orderBy("doc_id").collect() == apart.orderBy("doc_id").collect()


def test_short_items_count_as_a_whole(spark):
    """Items under five words are found word for word, but in no other words."""
    texts = ["well what is the capital of france anyway", "what is the capital of spain", "Is it", "visit Otto 5", "now visit Hugo 6", "this item"]
    items = ["What is the capital of France?", "is it", None, "", "visit Otto 5"]
    assert set(found_in(spark, texts, items)) == {(0, 0), (2, 1), (3, 4)}


def test_placeholders_alone_are_no_evidence(spark):
    """Thirty numbers are a copy if they are the same numbers."""
    numbers = " ".join(str(i) for i in range(30))
    found = found_in(spark, [numbers, " ".join(str(i * 7) for i in range(30)), f"{FILLER} {numbers} kg"], [numbers])
    assert found == {(0, 0): (18, 0), (2, 0): (18, 0)}


def test_values_are_those_of_their_own_words(spark):
    before = ["on 2020-01-05 then", "call 555-7713 now.", "write to the.72@mail3.example.com or", "it took 7 Days and", "id 3fa9c07e1b and"]
    assert set(found_in(spark, [f"{b} {QUESTION}" for b in before], [QUESTION])) == {(i, 0) for i in range(len(before))}
    assert set(found_in(spark, [f"{b} {CHANGED}" for b in before], [QUESTION])) == {(i, 0) for i in range(len(before))}
    assert found_in(spark, [f"{b} {MIXED}" for b in before], [QUESTION]) == {}


def test_literal_copies_are_found_whatever_they_are_made_of(spark):
    names = "Otto Hugo Karl Emma Anna Paul Lena Fritz Clara Max Ida Theo Mia Ben Nora"
    mixed = "Route 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"
    title = "What Is The Capital Of The Old Kingdom Of France In 1789"
    texts = [names, f"{FILLER} {names} {FILLER}", mixed, title, title.lower(), mixed.replace("15", "16"), FILLER]
    found = found_in(spark, texts, [names, mixed, title.lower()])
    assert set(found) == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 1)}
    assert found[0, 0][1] == 0 and found[3, 2][1] == 0


def test_names_do_not_depend_on_what_stands_around_them(spark):
    tom = "Tom has 5 apples and 2 pears. Tom buys 3 more of each one. Tom eats 4 of them all. Tom gives how many away?"
    france = "What is the capital of France?"
    lines = QUESTION.replace(" ", "\n")
    texts = [
        tom.replace("Tom", "Bob"),
        "well What is the capital of France anyway",
        "well What is the capital of Spain anyway",
        "well what is the capital of Spain anyway",
        CHANGED.replace("Hugo", "\u00a0 Hugo").replace(" in ", " in\n"),
        CHANGED.replace(" ", "  "),
        lines,
        tom.replace("Tom", "Bob", 2).replace("Tom", "Karl"),
    ]
    found = found_in(spark, texts, [tom, france, QUESTION])
    assert set(found) == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2)}


def test_an_edit_elsewhere_does_not_clear_a_copy(spark):
    # The first window stays word for word; in the second text an edited word parts two runs.
    head, tail = QUESTION.rsplit("Otto", 1)
    long = f"{QUESTION} while the rest of the fruit is kept in the cellar until Otto comes back to eat 12 more of them in the spring"
    parted = long.replace("12", "31").replace("while the rest", "while the remainder").replace("eat 31", "eat 44")
    texts = [f"{head}Karl{tail}", parted, MIXED]
    found = found_in(spark, texts, [QUESTION, long])
    assert {(0, 0), (0, 1), (1, 1)} <= set(found) and not {(2, 0), (2, 1)} & set(found)


def test_broadcast_and_shuffle_agree(spark):
    texts = [f"{FILLER} {QUESTION}", CHANGED, FILLER]
    assert found_in(spark, texts, [QUESTION], broadcast_windows=0) == found_in(spark, texts, [QUESTION])


def test_literal_windows_are_those_of_a_plain_search(spark):
    rnd = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(13, 30))) for _ in range(5)]
    texts = []
    for _ in range(40):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 50))]
        if rnd.random() < 0.6:
            item = rnd.choice(items).split()
            cut = rnd.randint(5, len(item))
            text[len(text) // 2 : len(text) // 2] = item[:cut]
        texts.append(" ".join(text))
    windows = {}
    for i, item in enumerate(items):
        own = item.split()
        for k in range(len(own) - 12):
            windows.setdefault(tuple(own[k : k + 13]), set()).add(i)
    expected = set()
    for d, text in enumerate(texts):
        own = re.split(r"\s+", text)
        for k in range(len(own) - 12):
            expected |= {(d, i) for i in windows.get(tuple(own[k : k + 13]), ())}
    assert set(found_in(spark, texts, items)) == expected and expected


def test_stage_drops_only_what_is_contaminated(spark):
    docs = docs_of(spark, [QUESTION, FILLER, None, "", CHANGED])
    repeated = docs.unionByName(docs_of(spark, [FILLER]))
    kept = decontaminate.clean_documents(repeated, bench_of(spark, [QUESTION]))
    assert kept.columns == docs.columns
    # Document 0 occurs with a contaminated and with a clean text.
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [(0, FILLER), (1, FILLER)]
    assert kept.count() == 4


def test_empty_tables(spark):
    assert found_in(spark, [], [QUESTION]) == {}
    assert decontaminate.clean_documents(docs_of(spark, [QUESTION]), bench_of(spark, [])).count() == 1


def test_planted_passages_of_the_test_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    bench = {r["item_id"]: " ".join(r["text"].split()) for r in items.collect()}
    expected = set()
    for row in docs.collect():
        text = " ".join((row["text"] or "").split())
        expected |= {(row["doc_id"], i) for i, passage in bench.items() if passage in text}
    assert expected and expected <= found


LONG = (
    "Maria bought 14 boxes of apples at the market in Vienna and carried them home with Jonas who had 3 bags of his own while "
    "the rain fell on the old bridge and the river rose to the second step of the stairs so that nobody could cross before the "
    "evening came and the lamps were lit along the whole street again"
)


def test_one_changed_value_does_not_clear_a_long_copy(spark):
    copy = LONG.replace("Maria", "Paula").replace("14", "22").replace("Vienna", "London").replace("Jonas", "Peter").replace(" 3 ", " 8 ")
    tail = " and at the end Maria counted her boxes and Jonas his bags and both were glad that Maria had bought them"
    clashing = copy + tail.replace("Maria", "Paula", 1).replace("Jonas", "Peter").replace("Maria", "Stella")
    found = found_in(spark, [copy, clashing, f"{FILLER} {clashing} {FILLER}"], [LONG, LONG + tail])
    assert {(0, 0), (1, 0), (1, 1), (2, 1)} <= set(found)
    assert found[1, 1][0] >= 30


def test_long_texts_and_what_is_shuffled_of_them(spark):
    """A text of 20,000 words goes through the shuffle as hashes with places."""
    words = " ".join(f"w{i % 977} x{i % 31}" for i in range(10_000))
    text = f"{words} {QUESTION} {words}"
    both = [found_in(spark, [text, text, words], [QUESTION], broadcast_windows=n) for n in (0, 1_000_000)]
    assert both[0] == both[1] and set(both[0]) == {(0, 0), (1, 0)}
    searched = decontaminate.benchmark_windows(bench_of(spark, [QUESTION]))
    rows = decontaminate._with_words(docs_of(spark, [text]).selectExpr("doc_id", "1L as row_key", "text"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = decontaminate._found_by_shuffle(rows, searched, [13])._jdf.queryExecution().executedPlan()
        shuffled = []
        stack = [plan.initialPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
        while stack:
            node = stack.pop()
            if node.nodeName() == "Exchange":
                shuffled.append(node.schema().simpleString())
            stack += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    documents = [s for s in shuffled if "doc_id" in s]
    assert documents and all("array" not in s and "string" not in s for s in documents)


def test_repeated_ids_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, QUESTION, "a", 1), (1, FILLER, "a", 1), (None, QUESTION, "b", 2), (1, QUESTION, "c", 3)],
        "doc_id long, text string, form string, windows int",
    )
    items = spark.createDataFrame([(7, QUESTION, 1), (8, QUESTION, 2), (7, QUESTION, 3)], "item_id long, text string, start int")
    found = decontaminate.contaminated(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in found) == [("1", 7), ("1", 8), ("None", 7), ("None", 8)]
    kept = decontaminate.clean_documents(docs, items)
    assert [tuple(r) for r in kept.collect()] == [(1, FILLER, "a", 1)] and kept.columns == docs.columns
