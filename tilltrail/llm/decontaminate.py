"""Benchmark decontamination by template canonicalisation, in DataFrame functions throughout.

Names, numbers and units become typed placeholders, so that a question with other values has the
same template. Every window of a document's template is looked up among the windows of the
benchmark by hash, and the values that stand in the placeholders must then map onto each other one
to one: the same value of the question is the same value everywhere in a stretch of windows. Windows that
agree word for word need no such check.

Templates are made on the whole text and windows are hashed after the words are exploded: both are
compiled by Spark, where functions over arrays would be interpreted word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilltrail.llm.store import row_key, stored, without_rows

WINDOW = 13
SHORTEST = 5
ANCHOR = 4
BROADCAST_WINDOWS = 1_000_000

# Words that name a unit if a number stands before them.
UNITS = (
    "mg g kg t lb lbs oz mm cm m km in ft yd mi ml cl l gal ms s sec min h hr hrs w kw v hz mhz ghz kb mb gb tb "
    "grams gram kilograms kilogram pounds pound ounces ounce meters meter metres metre kilometers kilometer kilometres "
    "kilometre miles mile feet foot inches inch liters liter litres litre seconds second minutes minute hours hour days "
    "day weeks week months month years year percent degrees dollars dollar euros euro cents cent"
).split()

_MARK = "\u0001"
NAME, NUMBER, UNIT = f"{_MARK}name", f"{_MARK}number", f"{_MARK}unit"
# A capitalised word inside a sentence is taken for a name.
_NAME = r"\p{Lu}(?<=[^.!?:\s][ \t]\p{Lu})\p{Ll}\p{L}*"
# What stands before is looked at behind the capital, so that it is looked at only there.
_NAME_IN_WORD = r"\p{Lu}(?<![\p{L}\p{N}%]\p{Lu})\p{Ll}\p{L}*"
_NUMBER = r"[$€£]?[0-9]+(?:[.,:/][0-9]+)*%?"
_UNIT = rf"(?i:{'|'.join(UNITS)})\b"
_QUANTITY = rf"{_NUMBER}(?:{_UNIT})?"
_BREAKS = r"[\s.,;:!?\"()\[\]]+"
# The same breaks in a text that still has its numbers: a mark between two digits belongs to the number.
_BREAKS_OUTSIDE_NUMBERS = r"(?:[\s;!?\"()\[\]]|[.,:](?!(?<=[0-9].)[0-9]))+"
_BLANKS = r"[\s\p{Z}\x85]+"
_ENDS = " \t\n\x0b\f\r.,;:!?\"()[]"
# Forms in which documents and items are compared.
LITERAL = "literal"
FIRST_WORD = "first_word"
FORMS = [LITERAL, "numbers", "sentence", "names", FIRST_WORD]


def _plain(text: Column) -> Column:
    """A text without marks, any white space between words as one blank."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(F.when(text.contains(_MARK), F.translate(text, _MARK, "")).otherwise(text), _BLANKS, " ")


def _numbered(text: Column) -> Column:
    """A text with placeholders for its numbers and their units."""
    out = F.regexp_replace(text, _NUMBER, NUMBER)
    return F.regexp_replace(out, rf"({NUMBER})(\s?){_UNIT}", f"$1$2{UNIT}")


def _split(text: Column, breaks: str = _BREAKS) -> Column:
    return F.split(F.btrim(text, F.lit(_ENDS)), breaks)


def _with_words(rows: DataFrame) -> DataFrame:
    """Rows with the words of their text in several forms, place by place the same words.

    ``cased`` are the words as they stand; the others are in lower case: ``literal`` has no placeholders,
    ``numbers`` has them for numbers and units, ``sentence`` for names inside sentences too, ``names`` for
    capitalised words anywhere. Null counts as empty, and an empty
    text is one empty word. A form that a text shares with an earlier one is not split again: most texts have no number or
    no name inside a sentence.
    """
    whole = rows.withColumn("_text", _plain(F.col("text"))).withColumn("_numbered", _numbered(F.col("_text")))
    whole = whole.withColumn("_named", F.regexp_replace("_numbered", _NAME, NAME))
    # Without a digit both kinds of breaks are the same.
    bare = F.col("_numbered") == F.col("_text")

    def outside_numbers(text: Column) -> Column:
        return F.when(bare, _split(text)).otherwise(_split(text, _BREAKS_OUTSIDE_NUMBERS))

    whole = whole.withColumns({"cased": outside_numbers(F.col("_text")), LITERAL: outside_numbers(F.lower("_text"))})
    whole = whole.withColumn("numbers", F.when(bare, F.col(LITERAL)).otherwise(_split(F.lower("_numbered"))))
    unnamed = F.col("_named") == F.col("_numbered")
    forms = {
        "sentence": F.when(unnamed, F.col("numbers")).otherwise(_split(F.lower("_named"))),
        "names": _split(F.lower(F.regexp_replace("_numbered", _NAME_IN_WORD, NAME))),
    }
    return whole.withColumns(forms).select(*rows.columns, "cased", LITERAL, "numbers", *forms)


def _held(at: Column) -> Column:
    """The word at a place as it stands, with the unit that follows its number."""
    words, numbers = F.col("cased"), F.col("numbers")
    unit_follows = F.get(numbers, at).endswith(NUMBER) & F.get(numbers, at + 1).startswith(UNIT)
    return F.concat(F.get(words, at), F.when(unit_follows, F.get(words, at + 1)).otherwise(""))


def _values(word: Column, names: Column) -> Column:
    """What the placeholders of a word stand for: its numbers, each with its unit, and its names."""
    found = F.when(names, F.regexp_extract_all(word, F.lit(f"{_NAME_IN_WORD}|{_QUANTITY}"), F.lit(0)))
    return F.transform(found.otherwise(F.regexp_extract_all(word, F.lit(_QUANTITY), F.lit(0))), F.lower)


def _windows(rows: DataFrame, size: int) -> DataFrame:
    """A row per window of ``size`` words and where it ``start``s.

    The outer form keeps Spark from testing the words for emptiness, which makes them twice.
    """
    cut = rows.select("*", F.posexplode_outer("numbers").alias("start", "_word")).drop("_word")
    return cut.filter(F.size("numbers") - F.col("start") >= size)


def _word(form: str, k: int) -> Column:
    """The word at a place of a window in one of the forms.

    ``first_word`` has names but for the first word, which a passage set into a sentence may write
    either way.
    """
    column = form if form != FIRST_WORD else "names" if k else "numbers"
    return F.get(column, F.col("start") + k)


def _window(form: str, size: int) -> list[Column]:
    return [_word(form, k) for k in range(size)]


def _hash(words: list[Column]) -> Column:
    """A hash of the words and, with them, of their number."""
    return F.xxhash64(*words, F.lit(len(words)))


def _has_mark(size: int) -> Column:
    """Whether a placeholder stands in the window in any form; ``names`` has all that the others have."""
    return reduce(lambda a, b: a | b, [F.coalesce(_word("names", k).contains(_MARK), F.lit(False)) for k in range(size)])


def _slots(words: Column) -> Column:
    """Places of a window where placeholders stand, counted from its start, and what those stand for.

    Words are counted, not placeholders: a word may hold several, and a number and its unit are one
    value in two words.
    """
    places = F.transform(words, lambda w, k: F.struct(k.alias("at"), w.contains(NAME).alias("names"), w.alias("word")))
    held = F.filter(places, lambda p: p["names"] | p["word"].contains(NUMBER))
    return F.transform(
        held,
        lambda p: F.struct(p["at"], p["names"], _values(_held(F.col("start") + p["at"]), p["names"]).alias("values")),
    )


def _pairs() -> Column:
    """The values of a window of the benchmark with the words at the same places of the window that was found.

    Neighbouring windows share these words, so their values are taken later, once a place. A literal window has the
    values of the item itself.
    """
    beside = F.transform(
        "item_slots",
        lambda slot: F.struct(
            (F.col("item_start") + slot["at"]).alias("at"), slot["names"].alias("names"), slot["values"].alias("values"),
            _held(F.col("start") + slot["at"]).alias("word"),
        ),
    )
    return F.when(F.col("form") != LITERAL, beside)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """``hash``, ``anchor``, ``size``, ``item_id``, ``form``, ``item_start`` and ``item_slots`` of every window of the benchmark.

    Items shorter than a window are one window. Each item is there word for word, in lower case, and
    with placeholders for numbers: without names, with those inside sentences, with all capitalised words
    as names, and with all but the first. Windows that are mostly placeholders, and items under ``shortest``
    words, would match by chance in other words: they are there word for word only. ``anchor`` is a hash of the first words.
    """
    items = _with_words(benchmark.select("item_id", "text")).filter(F.array_join(LITERAL, "") != "")
    items = stored(items.withColumn("size", F.least(F.lit(window), F.size("numbers"))), "benchmark-items")
    parts = []
    for size in sorted(r["size"] for r in items.select("size").distinct().collect()):
        cut = _windows(items.filter(F.col("size") == size), size)
        for form in FORMS if size >= shortest else [LITERAL]:
            words = F.array(*_window(form, size))
            plain = F.size(F.filter(words, lambda w: ~w.startswith(_MARK)))
            # Without a placeholder the other forms are the literal one.
            evidence = F.lit(True) if form == LITERAL else (plain * 2 > size) & _has_mark(size)
            parts.append(
                cut.filter(evidence).select(
                    _hash(_window(form, size)).alias("hash"),
                    _hash(_window(form, min(ANCHOR, size))).alias("anchor"),
                    "size",
                    "item_id",
                    F.lit("names" if form == FIRST_WORD else form).alias("form"),
                    F.col("start").alias("item_start"),
                    _slots(words).alias("item_slots"),
                )
            )
    if not parts:
        empty = (
            "hash long, anchor long, size int, item_id long, form string, item_start int, "
            "item_slots array<struct<at:int,names:boolean,values:array<string>>>"
        )
        return benchmark.sparkSession.createDataFrame([], empty)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


HIT = ["doc_id", "row_key", "start", "size", "item_id", "form", "item_start", "item_slots"]


def _hits_by_anchor(rows: DataFrame, searched: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows that agree, the benchmark's being broadcast.

    The first words of every window are looked up; only where they are found is all of it hashed. Where these few
    words hold no placeholder they are the same in all forms, so one hash serves for all. The words of windows that pass
    are stored: in one piece with the rest, the code for a word would be too large to be compiled by the JVM.
    """
    lengths = sorted({min(ANCHOR, size) for size in sizes})
    probes = []
    for n in lengths:
        every = F.struct(F.lit(None).cast("string").alias("one"), F.lit(n).alias("n"), _hash(_window(LITERAL, n)).alias("anchor"))
        own = [F.struct(F.lit(f).alias("one"), F.lit(n).alias("n"), _hash(_window(f, n)).alias("anchor")) for f in FORMS]
        probes.append(F.when(_has_mark(n), F.array(*own)).otherwise(F.array(every)))
    looked = _windows(rows, lengths[0]).withColumn("_probe", F.explode(F.concat(*probes) if len(probes) > 1 else probes[0]))
    looked = looked.withColumn("anchor", F.col("_probe.anchor"))
    near = looked.join(F.broadcast(searched.select("anchor").distinct()), "anchor", "left_semi")
    # One word more than a window has, as its last number may have a unit.
    words = [F.slice(c, F.col("start") + 1, F.lit(sizes[-1] + 1)).alias(c) for c in ("cased", LITERAL, "numbers", "sentence", "names")]
    near = near.select("doc_id", "row_key", F.col("start").alias("place"), F.lit(0).alias("start"), "_probe.one", "_probe.n", *words)
    near = stored(near, "benchmark-near")
    forms = F.when(F.col("one").isNull(), F.array(*map(F.lit, FORMS))).otherwise(F.array("one"))
    near = near.withColumn("_form", F.explode(forms))
    parts = []
    for size in sizes:
        own = near.filter((F.col("n") == min(ANCHOR, size)) & (F.size("numbers") >= size)).drop("n")
        found = own.withColumn("hash", _hash_of_form(size)).join(F.broadcast(searched.filter(F.col("size") == size)), "hash")
        parts.append(_aligned(found))
    return reduce(DataFrame.unionByName, parts)


ALIGNMENT = ["doc_id", "row_key", "item_id", "form", "size", "shift"]


def _aligned(found: DataFrame) -> DataFrame:
    """Windows that agree with the values that stand in both; the words of the document are at hand."""
    shift = (F.col("place") - F.col("item_start")).alias("shift")
    return found.select(*ALIGNMENT[:-1], shift, "item_start", _pairs().alias("pairs"))


def _hash_of_form(size: int) -> Column:
    """The hash of the window in the form that ``_form`` names."""
    out = _hash(_window(LITERAL, size))
    for form in FORMS:
        out = F.when(F.col("_form") == form, _hash(_window(form, size))).otherwise(out) if form != LITERAL else out
    return out


def _hits_by_shuffle(rows: DataFrame, searched: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows that agree, both sides shuffled by hash. What is shuffled of a document is a hash and where it stands, no words.

    Words are made again for the documents that were hit, which meet their hits by key.
    """
    hits = stored(_found_by_shuffle(rows, searched, sizes), "benchmark-hits").distinct()
    hit = rows.join(hits.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["doc_id", "row_key"])
    met = hits.join(hit.withColumnRenamed("doc_id", "_doc_id"), "row_key")
    return _aligned(met.filter(F.col("doc_id").eqNullSafe(F.col("_doc_id"))).withColumn("place", F.col("start")))


def _found_by_shuffle(rows: DataFrame, searched: DataFrame, sizes: list[int]) -> DataFrame:
    parts = []
    for size in sizes:
        hashes = F.when(_has_mark(size), F.array(*[_hash(_window(f, size)) for f in FORMS])).otherwise(F.array(_hash(_window(LITERAL, size))))
        cut = _windows(rows, size).select("doc_id", "row_key", "start", F.explode(F.array_distinct(hashes)).alias("hash"))
        parts.append(cut.join(searched.filter(F.col("size") == size), "hash").select(*HIT))
    return reduce(DataFrame.unionByName, parts)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shortest: int = SHORTEST,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``doc_id``, ``row_key``, ``item_id``, ``windows``, ``changed_slots``: which document holds which item.

    A document holds an item if at least one window of ``window`` words (or the whole of a
    shorter item) agrees word for word, or if windows at consecutive places agree with placeholders and a long
    enough stretch of them maps the values one to one: two thirds of the run, or as many windows as a window has words
    and one more. So neither an edit elsewhere nor a single changed value clears a long copy, and a few windows that agree by chance
    beside conflicting ones are no copy. ``windows`` counts those of the longest such stretch, ``changed_slots`` the values that
    differ in the least changed one: 0 if a window is copied word for word.

    Null and empty texts hold nothing, an item without text is no item; repeated documents are reported by id
    and text. Very long texts are read whole. Further columns of either table are not looked at, so they cannot clash.

    The windows of the benchmark are broadcast if they are counted to be at most
    ``broadcast_windows`` (about 100 bytes each); a larger benchmark is joined by shuffling hashes.
    """
    searched = stored(benchmark_windows(benchmark, window, shortest), "benchmark-windows")
    sizes = sorted(r["size"] for r in searched.select("size").distinct().collect()) or [window]
    small = searched.count() <= broadcast_windows
    keyed = docs.select("doc_id", row_key().alias("row_key"), "text")
    by_what = _hits_by_anchor if small else _hits_by_shuffle
    aligned = by_what(_with_words(keyed), searched, sizes)
    # Places less their rank are the same all along a run.
    run = F.col("item_start") - F.dense_rank().over(Window.partitionBy(*ALIGNMENT).orderBy("item_start"))
    # A window in two forms of a group is one place, so ranks are dense.
    runs = stored(aligned.withColumn("run", run), "benchmark-runs")
    return _longest_stretches(runs, [*ALIGNMENT, "run"], window)


def _longest_stretches(windows: DataFrame, run: list[str], window: int) -> DataFrame:
    """The longest stretch of windows of each run whose values map one to one, where it is long enough.

    Two values conflict if one side is the same and the other is not. A stretch ending at a window may begin behind
    the latest place that conflicts with a later one in it.
    """
    held = windows.select(*run, F.explode("pairs").alias("p")).select(*run, "p.at", "p.names", "p.values", "p.word").distinct()
    read = held.withColumn("_ours", _values(F.col("word"), F.col("names")))
    values = read.select(*run, "at", "_ours", F.posexplode("values").alias("nth", "item"))
    values = values.select(*run, "at", "nth", "item", F.get("_ours", F.col("nth")).alias("copy")).distinct()
    windows = windows.select(*run, "item_start").distinct()
    conflicts = values
    for same, other in (("item", "copy"), ("copy", "item")):
        occurrences = Window.partitionBy(*run, same).orderBy("at", "nth")
        before = F.lag(F.struct("at", other)).over(occurrences)
        switched = F.when(before.isNotNull() & ~before[other].eqNullSafe(F.col(other)), before["at"])
        conflicts = conflicts.withColumn(f"_{same}", switched)
        conflicts = conflicts.withColumn(f"_{same}", F.max(f"_{same}").over(occurrences.rowsBetween(Window.unboundedPreceding, 0)))
    differs = (~F.col("item").eqNullSafe(F.col("copy"))).cast("int")
    places = conflicts.select(
        *run, F.col("at").alias("place"), F.lit(0).alias("kind"), F.greatest("_item", "_copy").alias("conflict"), differs.alias("differs"),
        F.lit(None).cast("int").alias("item_start"),
    )
    ends = windows.select(
        *run, (F.col("item_start") + F.col("size") - 1).alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("conflict"),
        F.lit(0).alias("differs"), "item_start",
    )
    so_far = Window.partitionBy(*run).orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*run)
    both = places.unionByName(ends).withColumns(
        {
            "_first": F.min("item_start").over(whole),
            "_all": F.count("item_start").over(whole),
            "_changed": F.sum("differs").over(whole),
            "_behind": F.max("conflict").over(so_far) + 1,
        }
    )
    length = F.col("item_start") - F.greatest("_behind", "_first") + 1
    runs = both.filter("kind = 1").groupBy(*run).agg(
        F.max(length).alias("windows"), F.max("_all").alias("_all"), F.max("_changed").alias("changed")
    )
    enough = F.least(F.ceil(F.col("_all") * 2 / 3), F.lit(window + 1))
    return (
        runs.filter((F.col("windows") > 0) & (F.col("windows") >= enough))
        .groupBy("doc_id", "row_key", "item_id")
        .agg(F.max("windows").cast("long").alias("windows"), F.min("changed").cast("int").alias("changed_slots"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found = stored(contaminated(docs, benchmark).select("doc_id", "row_key").distinct(), "contaminated")
    return without_rows(docs, found, "left_anti")
