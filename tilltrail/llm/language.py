"""Language identification by cross-parsing entropy.

Of every language a bounded sample of labelled text becomes a suffix automaton. A text is parsed
against each of them into the longest phrases that occur in the sample; a language needs few
phrases if the text is written in it. Phrases times the bits it takes to point into the sample,
over the letters parsed, is the cross-parsing entropy; the lowest wins.

Texts are parsed as UTF-8. ASCII letters are folded to lower case, bytes of other letters stay, and
whatever else stands between letters is one blank. Texts are cut into lanes of equal length, and
all lanes of a batch walk an automaton side by side, a byte per step, so a very long text is no
slower than many short ones. A lane opens a phrase of its own; nothing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilltrail.llm.store import free_name

UNKNOWN = "und"
LANE = 1024
SLAB_BYTES = 8 << 20


def symbols() -> np.ndarray:
    """Symbol of every byte: blank 0, letters a-z 1 to 26, bytes of other characters from 27 on."""
    table = np.zeros(256, dtype=np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    table[128:] = np.arange(27, 155)
    return table


SYMBOLS = symbols()
WIDTH = 155


def parsed_bytes(text: bytes) -> np.ndarray:
    """Symbols of a text, runs of blanks as one."""
    found = SYMBOLS[np.frombuffer(text, dtype=np.uint8)]
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    return found[keep]


# --- automata -----------------------------------------------------------------------------------


def suffix_automaton(sample: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of the sample."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in sample.tolist():
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at != -1:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at != -1 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


@dataclass(frozen=True)
class Parser:
    """An automaton as one table: row of a state, column of a symbol.

    An entry is twice the offset of the next row, plus one where the symbol opens a phrase.
    Symbols that the sample lacks share the last column.
    """

    columns: np.ndarray
    table: np.ndarray
    width: int
    bits: float

    @staticmethod
    def of(sample: np.ndarray) -> Parser:
        moves = suffix_automaton(sample)
        used = sorted(moves[0])
        width = len(used) + 1
        columns = np.full(WIDTH, len(used), dtype=np.int32)
        columns[used] = np.arange(len(used))
        # Where a state has no way on, the phrase ends and the symbol opens the next from the root.
        again = np.ones(width, dtype=np.int32)
        for symbol in used:
            again[columns[symbol]] = moves[0][symbol] * width * 2 + 1
        table = np.tile(again, (len(moves), 1))
        for state, ways in enumerate(moves[1:], 1):
            for symbol, target in ways.items():
                table[state, columns[symbol]] = target * width * 2
        return Parser(columns, table.reshape(-1), width, math.log2(max(2, len(sample))))

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases per lane. ``lanes`` has a step per row; lanes are sorted by falling length."""
        state = np.zeros(lanes.shape[1], dtype=np.int32)
        count = np.zeros(lanes.shape[1], dtype=np.int32)
        active = np.searchsorted(-lengths, -np.arange(1, lanes.shape[0] + 1), side="right")
        for step, n in enumerate(active.tolist()):
            if not n:
                break
            moved = self.table[state[:n] + self.columns[lanes[step, :n]]]
            count[:n] += moved & 1
            state[:n] = moved >> 1
        return count


@dataclass(frozen=True)
class Model:
    languages: list[str]
    parsers: list[Parser]


def train(samples: dict[str, bytes]) -> Model:
    languages = sorted(samples)
    return Model(languages, [Parser.of(parsed_bytes(samples[x])) for x in languages])


# --- samples ------------------------------------------------------------------------------------


def fold(doc_id: Column, folds: int = 5) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``; 0 without an id."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def training_samples(
    docs: DataFrame, docs_per_language: int = 64, chars_per_document: int = 400, folds: int = 5
) -> dict[str, bytes]:
    """Labelled text per language, from all folds but the first.

    The sample is bounded: of each language the documents with the least hashes of their id, and of
    each a stretch of its text. The ranking by language keeps only that many rows per task before
    it shuffles, so a language with most of the rows is no hot key.
    """
    labelled = docs.filter((fold(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    stretch = F.substring("text", 1, chars_per_document)
    rows = labelled.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", stretch.alias("text"))
    chosen = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text")))
    samples: dict[str, list[str]] = {}
    for row in chosen.filter(F.col("n") <= docs_per_language).sort("lang", "n").collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return {lang: " ".join(texts).encode("utf-8", "replace") for lang, texts in samples.items()}


# --- prediction ---------------------------------------------------------------------------------


def _parts(words: list[bytes]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts by the slab: whose part it is, and its symbols. Texts over a slab are cut into several."""
    owner, parts, size = [], [], 0
    for i, word in enumerate(words):
        for at in range(0, len(word), SLAB_BYTES):
            part = parsed_bytes(word[at : at + SLAB_BYTES])
            owner.append(i)
            parts.append(part)
            size += len(part)
            if size >= SLAB_BYTES:
                yield owner, parts
                owner, parts, size = [], [], 0
    if parts:
        yield owner, parts


def entropies(model: Model, words: list[bytes]) -> np.ndarray:
    """Bits per symbol, a row per text and a column per language."""
    phrases = np.zeros((len(words), len(model.languages)))
    symbols_read = np.zeros(len(words))
    for owners, parts in _parts(words):
        sizes = np.array([len(p) for p in parts])
        symbols_read += np.bincount(owners, sizes, minlength=len(words))
        per_part = -(-sizes // LANE)
        part = np.repeat(np.arange(len(parts)), per_part)
        within = (np.arange(len(part)) - np.repeat(np.cumsum(per_part) - per_part, per_part)) * LANE
        lengths = np.minimum(LANE, sizes[part] - within)
        order = np.argsort(-lengths, kind="stable")
        part, within, lengths = part[order], within[order], lengths[order]
        flat = np.concatenate([*parts, np.zeros(LANE, np.uint8)])
        starts = (np.cumsum(sizes) - sizes)[part] + within
        lanes = flat[starts.astype(np.int32)[None, :] + np.arange(LANE, dtype=np.int32)[:, None]]
        owner = np.array(owners)[part]
        for k, parser in enumerate(model.parsers):
            phrases[:, k] += np.bincount(owner, parser.phrases(lanes, lengths), minlength=len(words))
    bits = np.array([p.bits for p in model.parsers])
    return phrases * bits / np.maximum(symbols_read, 1)[:, None]


def predict(
    docs: DataFrame, model: Model, keep: list[str], named: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The columns ``keep`` of every document with the predicted language and its score.

    The score is 0 if the two best languages take equally many bits and nears 1 as the best one takes
    far fewer; with a single language it is 1. Ties go to the language that sorts first. Texts
    that are null or have no letter, and all texts if there was nothing to learn from, are
    ``und`` with score 0. Columns named like the two new ones give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in named]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            read = [bool(x) for x in batch.column("_readable").to_pylist()]
            found, scores = [UNKNOWN] * len(read), np.zeros(len(read))
            if known.languages and len(read):
                texts = batch.column("_text").cast(pa.binary())
                bits = entropies(known, [t.as_py() if r else b"" for t, r in zip(texts, read, strict=True)])
                ranked = np.sort(bits, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    lead = 1 - ranked[:, 0] / ranked[:, 1] if bits.shape[1] > 1 else np.ones(len(read))
                best = bits.argmin(axis=1).tolist()
                found = [known.languages[b] if r else UNKNOWN for b, r in zip(best, read, strict=True)]
                scores = np.where(read, np.nan_to_num(lead), 0.0)
            columns = [batch.column(c) for c in carried]
            columns += [pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    # Clashing and awkward names stay out of the Python side; the text goes over once.
    carried = ["_text" if c == "text" else f"_c{i}" for i, c in enumerate(keep)]
    names = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(
        F.col("text").alias("_text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_readable"),
        *[F.col(c).alias(n) for c, n in zip(keep, carried, strict=True) if c != "text"],
    )
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)]
    done = rows.mapInArrow(of_batches, ", ".join([*kinds, "lang_pred string", "score double"]))
    new = zip(["lang_pred", "score"], named, strict=True)
    return done.select(*[F.col(n).alias(c) for n, c in [*zip(names, keep, strict=True), *new]])


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every document.

    The model is learned from the labelled documents outside the first fold; a prediction depends
    on the text alone.
    """
    model = train(training_samples(docs, folds=folds))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])


def readable_documents(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The documents that have a language; those that come out as ``und`` go. Columns stay as they are.

    If there was nothing to learn from, those whose texts have a letter stay.
    """
    model = train(training_samples(docs, folds=folds))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    predicted, score = free_name(docs, "_lang_pred"), free_name(docs, "_score")
    known = predict(docs, model, docs.columns, (predicted, score))
    return known.filter(F.col(predicted) != UNKNOWN).select(*docs.columns)
