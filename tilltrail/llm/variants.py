"""Spelling variants: words of the corpus that differ by one code point, and the form each one stands for.

Two words with one edit between them agree before and behind a window that holds the edit. Words are grouped by what lies
outside such a window: first by either half of the shorter word, and a group that is too large again by the halves of its
window, until it is small or its window is one code point wide, where the alphabet bounds it. Each pair is looked
for in one group only, told by where the two words first differ.

Within a group the words are a sorted list. For each word, the list from there on is scanned with three cells of the edit
matrix per prefix: words that share a prefix share its row, and a range whose shared prefix is more than one edit away is
skipped whole. All words of a batch of groups are scanned at once, one code point further per step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilltrail.llm.store import discard, stored, stored_at

RUN = "([A-Za-z\\u00C0-\\u00FF]{%d,})"
SHORTEST = 7
LEAST_COUNT = 2
FORM_FACTOR = 10
HOT_GROUP = 4096
FLUSH_WORDS = 1 << 14
FAR = 9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- words ----------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT, noise: int | None = 31) -> DataFrame:
    """``word`` and ``n`` for every word of at least ``shortest`` code points and ``least`` occurrences in the whole texts.

    Words are maximal runs of letters, A-Z lower-cased. With ``noise``, a run of a document loses one code point where
    ``crc32("<doc_id>:<run>")`` is a multiple of it; a null id counts as empty text there.
    """
    runs = F.regexp_extract_all("text", F.lit(RUN % shortest), F.lit(1))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    if noise:
        # Each document's repeats of a run share their fate.
        words = words.withColumn("_hash", F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "word").cast("binary")))
        cut = (F.col("_hash") % F.length("word") + 1).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), cut - 1), F.substring(F.col("word"), cut + 1, F.length("word")))
        words = words.select(F.when(F.col("_hash") % noise == 0, shorter).otherwise(F.col("word")).alias("word"))
        words = words.filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


# --- groups ---------------------------------------------------------------------------------------


def _split(groups: DataFrame) -> DataFrame:
    """Each row twice: once with the first half of its group's window agreed, once with the second half.

    ``size`` is the length of the shorter word of a pair, so a word serves for its own length and for one less; ``head``
    and ``tail`` are the agreed ends, ``limit`` is where the two words must have differed already.
    """
    width = F.col("size") - F.col("head") - F.col("tail")
    half = F.floor(width / 2).cast("int")
    sides = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("limit").alias("limit")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + width - half).alias("tail"), (F.col("head") + half).alias("limit")),
    )
    split = groups.select("word", "n", "size", F.explode(sides).alias("s")).select("word", "n", "size", "s.head", "s.tail", "s.limit")
    return split.withColumn("group", _key())


def _key() -> Column:
    ends = (F.expr("left(word, head)"), F.expr("right(word, tail)"))
    numbers = [F.col(c).cast("string") for c in ("size", "head", "tail", "limit")]
    return F.unhex(F.md5(F.concat_ws(" ", *numbers, *ends)))


def groups_of(words: DataFrame, hot: int = HOT_GROUP) -> DataFrame:
    """Rows ``group, word, n, size, head, tail, limit``; groups of one word are left out, none is large."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1))
    start = words.select("word", "n", sizes.alias("size")).withColumns(
        {"head": F.lit(0), "tail": F.lit(0), "limit": F.col("size") + 1}
    )
    kept: list[DataFrame] = []
    rows, path = stored_at(_split(start), "variant-groups")
    while True:
        counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
        divisible = F.col("size") - F.col("head") - F.col("tail") > 1
        keyed = [side.withColumn("_h", F.hash("group")) for side in (rows, counts.filter("_n > 1"))]
        sized = keyed[0].join(keyed[1], ["group", "_h"]).drop("_h").withColumn("_hot", (F.col("_n") > hot) & divisible)
        sized, next_path = stored_at(sized, "variant-groups")
        discard(words.sparkSession, path)
        kept.append(sized.filter("not _hot").drop("_hot", "_n"))
        large = sized.filter("_hot").drop("_hot", "_n")
        if large.isEmpty():
            break
        rows, path = stored_at(_split(large), "variant-groups")
    whole = kept[0]
    for part in kept[1:]:
        whole = whole.unionByName(part)
    return whole


# --- the scan -------------------------------------------------------------------------------------


class SortedLists:
    """Sorted lists of words, one behind the other, with the common prefix of each word and the one before it."""

    def __init__(self, words: list[str], starts: np.ndarray, ends: np.ndarray):
        text = "".join(words)
        # A blank place behind the last word lets short reads past an end be masked instead of failing.
        self.codes = np.concatenate([np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), np.zeros(1, dtype=np.uint32)])
        self.lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if words else np.zeros(0, np.int64)
        self.starts, self.ends = starts, ends
        self.common = self._common()

    def at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The code point at a place of a word, 0 behind its end and before its start."""
        inside = (place >= 0) & (place < self.lengths[word])
        return np.where(inside, self.codes[np.where(inside, self.offsets[word] + place, 0)], 0)

    def _common(self) -> np.ndarray:
        """Common prefix with the word before, -1 at the start of a list."""
        found = np.full(len(self.lengths), -1, dtype=np.int64)
        open_ = np.setdiff1d(np.arange(len(self.lengths)), self.starts)
        place = 0
        while len(open_):
            found[open_] = place
            here = self.at(open_, np.full(len(open_), place))
            open_ = open_[(here == self.at(open_ - 1, np.full(len(open_), place))) & (here != 0)]
            place += 1
        return found


def near_pairs(lists: SortedLists, head: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words one edit apart, smaller first. ``head`` is what each word's list agrees in, ``limit`` as above.

    A state is a word and a range of later words that share a prefix, with the distances of that prefix to the
    word's prefixes of one less, the same, and one more. One step takes all states one code point further.
    """
    total = len(lists.lengths)
    relative = lists.common - head
    end_of = np.empty(total, dtype=np.int64)
    for start, end in zip(lists.starts, lists.ends):
        end_of[start:end] = end
    query = np.arange(total, dtype=np.int64)
    low, high = query + 1, end_of
    alive = low < high
    query, low, high = query[alive], low[alive], high[alive]
    less, same, more = (np.full(len(query), d, dtype=np.int8) for d in (1, 0, 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(query):
        # Ranges fall into parts that share one more code point: a part starts where the words no longer agree that far.
        cuts = np.flatnonzero(relative <= step)
        first = np.searchsorted(cuts, low, side="right")
        parts = np.searchsorted(cuts, high, side="left") - first + 1
        state = np.repeat(np.arange(len(query)), parts)
        nth = np.arange(len(state)) - np.repeat(np.cumsum(parts) - parts, parts)
        part_low = np.where(nth == 0, low[state], cuts[np.minimum(first[state] + nth - 1, len(cuts) - 1)] if len(cuts) else 0)
        last = nth == parts[state] - 1
        part_high = np.where(last, high[state], np.append(part_low[1:], 0))
        q, depth = query[state], head[query[state]] + step
        code = lists.at(part_low, depth)
        b0, b1, b2 = less[state], same[state], more[state]
        over = code == 0
        if over.any():
            # The part is one word that ends here: its distance is the cell at the query's full length.
            gap = lists.lengths[q] - depth
            distance = np.select([gap == -1, gap == 0, gap == 1], [b0, b1, b2], FAR)
            hit = over & (distance == 1)
            found.append((q[hit], part_low[hit]))
        room = lists.lengths[q]
        n0 = np.minimum(b0 + (lists.at(q, depth - 1) != code), b1 + 1)
        n1 = np.minimum(np.minimum(b1 + (lists.at(q, depth) != code), b2 + 1), n0 + 1)
        n2 = np.minimum(b2 + (lists.at(q, depth + 1) != code), n1 + 1)
        n0 = np.where(depth > room, FAR, n0)
        n1 = np.where(depth + 1 > room, FAR, n1)
        n2 = np.where(depth + 2 > room, FAR, n2)
        go = ~over & (np.minimum(np.minimum(n0, n1), n2) <= 1)
        query, low, high = q[go], part_low[go], part_high[go]
        less, same, more = (np.minimum(n[go], FAR).astype(np.int8) for n in (n0, n1, n2))
        step += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(side) for side in zip(*found))
    keep = first_difference(lists, a, b, head[a]) < limit[a]
    return a[keep], b[keep]


def first_difference(lists: SortedLists, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place where two words differ; both agree before ``start``."""
    place = start.copy()
    open_ = np.arange(len(a))
    while len(open_):
        here = lists.at(a[open_], place[open_])
        agree = (here == lists.at(b[open_], place[open_])) & (here != 0)
        open_ = open_[agree]
        place[open_] += 1
    return place


FOUND = "word string, n_near long, near_n long, near string"


def scan(rows: pd.DataFrame) -> pd.DataFrame:
    """Per word of whole groups, sorted: near words found, and the best of them."""
    words = rows["word"].tolist()
    code, _ = pd.factorize(rows["group"])
    starts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1]).astype(np.int64)
    ends = np.append(starts[1:], len(words))
    head, limit, size = (rows[c].to_numpy(dtype=np.int64) for c in ("head", "limit", "size"))
    a, b = near_pairs(SortedLists(words, starts, ends), head, limit)
    # Two words of the longer length belong to another size.
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    own = np.minimum(lengths[a], lengths[b]) == size[a]
    a, b = a[own], b[own]
    n, texts = rows["n"].to_numpy(dtype=np.int64), np.array(words, dtype=object)
    me, other = np.concatenate([a, b]), np.concatenate([b, a])
    pairs = pd.DataFrame({"word": texts[me], "near_n": n[other], "near": texts[other]})
    ranked = pairs.sort_values(["word", "near_n", "near"], ascending=[True, False, True])
    best = ranked.groupby("word", sort=False).agg(n_near=("near", "size"), near_n=("near_n", "first"), near=("near", "first"))
    return best.reset_index()[["word", "n_near", "near_n", "near"]]


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by group and word, cut where a group ends."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < FLUSH_WORDS:
            continue
        rows = pd.concat(held, ignore_index=True)
        cut = int((rows["group"] == rows["group"].iloc[-1]).to_numpy().argmax())
        if cut:
            yield scan(rows.iloc[:cut])
        held = [rows.iloc[cut:]]
    if held and sum(map(len, held)):
        yield scan(pd.concat(held, ignore_index=True))


def near_words(words: DataFrame, hot: int = HOT_GROUP) -> DataFrame:
    """``word``, ``n_near`` and the best near word ``near`` with its ``near_n``, for words that have any."""
    rows = groups_of(words, hot).select("group", "word", "n", "size", "head", "limit")
    dealt = rows.repartition("group").sortWithinPartitions("group", "word")
    found = dealt.mapInPandas(_whole_groups, FOUND)
    # The largest count, then the smallest word: the least of the negated count and the word.
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.rank")).alias("near_n"), F.col("best.near").alias("near"))


# --- forms ----------------------------------------------------------------------------------------


def _roots(forms: DataFrame, factor: int) -> DataFrame:
    """``word`` and ``root`` for words with a form, by doubling pointers.

    Each form occurs ``factor`` times as often as its word, so chains are no longer than the largest count has digits.
    """
    most = forms.agg(F.max("form_n")).first()[0] or 1
    longest = 1
    while factor**longest <= most:
        longest += 1
    roots, path = stored_at(forms.select("word", F.col("form").alias("root")), "variant-roots")
    spans = 1
    while spans < longest:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        keyed = [side.withColumn("_h", F.hash("root")) for side in (roots, further)]
        moved = keyed[0].join(keyed[1], ["root", "_h"], "left").select("word", F.coalesce("_next", "root").alias("root"))
        moved, next_path = stored_at(moved, "variant-roots")
        discard(forms.sparkSession, path)
        roots, path = moved, next_path
        spans *= 2
    return roots


def spelling_variants(docs: DataFrame, factor: int = FORM_FACTOR, hot: int = HOT_GROUP) -> DataFrame:
    """Each word of the corpus with its form and root: ``word, form, root, n, n_near, form_n``.

    A word's near words differ by one inserted, deleted or replaced code point. Its form is the near word with
    the largest count (ties: smallest in code-point order) if that is at least ``factor`` times its own; else null. Its root is
    reached by following forms; a word without one is its own.

    Null and empty texts have no words, a null ``doc_id`` counts as empty, repeated rows count each, an empty
    table gives no rows, texts are read whole. Only ``doc_id`` and ``text`` are read, so other names cannot clash.
    """
    words = stored(vocabulary(docs), "variant-words")
    near = stored(near_words(words, hot), "variant-near")
    forms = words.join(near, "word").filter(F.col("near_n") >= factor * F.col("n"))
    forms = stored(forms.select("word", F.col("near").alias("form"), F.col("near_n").alias("form_n")), "variant-forms")
    whole = words.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left")
    whole = whole.join(_roots(forms, factor), "word", "left")
    return whole.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )
