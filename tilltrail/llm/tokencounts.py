"""Token counts that follow edits.

A document is cut into pre-tokens, groups of which are the leaves of a segment tree that sums their
characters and tokens. An edit is found by descending the tree, the pre-tokens it can have changed
are cut and encoded again, and the sums above them are updated; everything else keeps its count.

Cutting goes from left to right and looks at two characters behind a pre-token at most. So a pre-token
stays as it is if these are before the edit, and cutting may stop where a new boundary falls on an
old one behind the edit: from there on both cut alike.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this vocabulary cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
LOOK = 2
KNOWN = 200_000
# Personal data that the standard edits take out.
EMAIL = regex.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")
PHONE = regex.compile(r"\+\d{1,3}[ (]*\d{1,4}[) -]+\d{2,4}[ -]\d{2,5}(?:[ -]\d{2,5})?")
ADDRESS = regex.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")


def vocabulary(path: str = RANKS) -> bytes:
    """What the vocabulary file holds."""
    try:
        with open(path, "rb") as file:
            return file.read()
    except OSError as error:
        raise FileNotFoundError(f"the driver needs the vocabulary file {path}; ranks_path names another one") from error


class Counter:
    """Tokens of a pre-token; those met before are remembered, up to a bound."""

    def __init__(self, ranks: str | bytes = RANKS) -> None:
        """``ranks`` is the vocabulary file or what it holds."""
        lines = (ranks if isinstance(ranks, bytes) else vocabulary(ranks)).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def __call__(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            count = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return count


@dataclass
class Leaf:
    """Side-by-side pre-tokens."""

    pieces: list[str]
    tokens: int


@dataclass
class Document:
    """The leaves of a text and, level by level above them, sums of characters and of tokens."""

    counter: Counter
    leaves: list[Leaf] = field(default_factory=list)
    chars: list[list[int]] = field(default_factory=list)
    tokens: list[list[int]] = field(default_factory=list)
    recounted: int = 0

    @staticmethod
    def of(text: str, counter: Counter) -> Document:
        leaves = Document._cut_into_leaves(counter.cut.findall(text), counter) or [Leaf([], 0)]
        doc = Document(counter, leaves)
        doc.chars = _levels([sum(map(len, x.pieces)) for x in leaves])
        doc.tokens = _levels([x.tokens for x in leaves])
        return doc

    @staticmethod
    def _cut_into_leaves(pieces: list[str], counter: Counter) -> list[Leaf]:
        cut = [pieces[at : at + LEAF] for at in range(0, len(pieces), LEAF)]
        return [Leaf(own, sum(map(counter, own))) for own in cut]

    @property
    def count(self) -> int:
        return self.tokens[-1][0]

    @property
    def length(self) -> int:
        return self.chars[-1][0]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf.pieces)

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts; behind the end, the last one."""
        node, start = 0, 0
        for level in range(len(self.chars) - 2, -1, -1):
            sums, node = self.chars[level], node * 2
            if node + 1 < len(sums) and char >= start + sums[node]:
                start += sums[node]
                node += 1
        return node, start

    def _update(self, leaf: int) -> None:
        own = self.leaves[leaf]
        self.chars[0][leaf], self.tokens[0][leaf] = sum(map(len, own.pieces)), own.tokens
        for sums in (self.chars, self.tokens):
            node = leaf
            for level in range(1, len(sums)):
                node //= 2
                below = sums[level - 1]
                sums[level][node] = below[2 * node] + (below[2 * node + 1] if 2 * node + 1 < len(below) else 0)

    def _split(self, first: int, last: int, pieces: list[str]) -> None:
        """Put as many leaves as the pieces fill in the place of some, and build the sums above anew.

        Before that happens again at a leaf it has to double, so few edits pay for it.
        """
        leaves = self._cut_into_leaves(pieces, self.counter)
        self.leaves[first : last + 1] = leaves
        self.chars[0][first : last + 1] = [sum(map(len, x.pieces)) for x in leaves]
        self.tokens[0][first : last + 1] = [x.tokens for x in leaves]
        self.chars, self.tokens = _levels(self.chars[0]), _levels(self.tokens[0])

    def _pieces_from(self, leaf: int) -> Iterator[tuple[int, str]]:
        for at in range(leaf, len(self.leaves)):
            for piece in self.leaves[at].pieces:
                yield at, piece

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` to ``end``.

        Offsets are cut to the text. The first pre-token cut anew is the first that does not end before
        ``start`` by ``LOOK`` characters; old ones behind ``end`` are read as far as the cut needs them.
        """
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        first, at = self._find(max(0, start - LOOK))
        kept: list[str] = []
        old = self._pieces_from(first)
        gone: list[tuple[int, str]] = []
        for leaf, piece in old:
            if at + len(piece) + LOOK <= start and leaf == first:
                kept.append(piece)
                at += len(piece)
            else:
                gone.append((leaf, piece))
                break
        # ``region`` is the old text that is cut anew; its old boundaries behind the edit end a cut.
        region, ends = "", []

        def read(piece: str) -> None:
            nonlocal region
            region += piece
            ends.append(at + len(region))

        if gone:
            read(gone[0][1])
        while at + len(region) < end and (more := next(old, None)):
            gone.append(more)
            read(more[1])
        grown = len(new) - (end - start)
        while True:
            fresh = region[: start - at] + new + region[end - at :]
            cut, where = [], at
            boundaries = {e + grown for e in ends if e >= end}
            stop = None
            for match in self.counter.cut.finditer(fresh):
                cut.append(match.group())
                where += len(match.group())
                # A boundary near the end of what was read may move with the text that follows.
                if where in boundaries and where >= start + len(new) and where + LOOK <= at + len(fresh):
                    stop = where
                    break
            if stop is not None:
                break
            more = next(old, None)
            if more is None:
                break
            gone.append(more)
            read(more[1])
        # Pre-tokens read only to look ahead stay behind the new ones as they were.
        tail = [] if stop is None else [g for g, e in zip(gone, ends, strict=True) if e + grown > stop]
        touched = sorted({first, *(leaf for leaf, _ in gone)})
        last = touched[-1]
        rest = [p for _, p in tail]
        rest += [p for at_leaf, p in old if at_leaf == last] if gone else []
        self.recounted += len(cut)
        whole = kept + cut + rest
        if len(whole) > 2 * LEAF * len(touched):
            self._split(first, last, whole)
            return
        # New pre-tokens are dealt out to the leaves touched.
        share = -(-len(whole) // len(touched)) if whole else 0
        for i, leaf in enumerate(touched):
            own = whole[i * share : (i + 1) * share]
            self.leaves[leaf] = Leaf(own, sum(map(self.counter, own)))
            self._update(leaf)


def _levels(sums: list[int]) -> list[list[int]]:
    levels = [sums]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sum(below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


Edits = Callable[[str], list[tuple[int, int, str]]]


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that put placeholders for mail addresses, phone numbers and network addresses; none overlap."""
    found = []
    kinds = []
    if "@" in text:
        kinds.append((EMAIL, "[mail]"))
    if "+" in text:
        kinds.append((PHONE, "[phone]"))
    kinds.append((ADDRESS, "[address]"))
    for pattern, name in kinds:
        found += [(m.start(), m.end(), name) for m in pattern.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for edit in sorted(found):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def count_with_edits(docs: DataFrame, edits_of: Edits = redactions, ranks_path: str = RANKS) -> DataFrame:
    """``doc_id``, ``tokens``, ``n_edits``, ``tokens_edited``, ``pretokens``, ``recounted``: a row per document.

    ``tokens`` counts the text as it is, ``tokens_edited`` after the edits, which name places in the
    original text and do not overlap; ``recounted`` is how many pre-tokens that took. Null and empty
    texts have no tokens and no edits. Repeated documents are counted each; further columns are not
    read, whatever their names. No documents give no rows. Rows stay in the task that reads them, and a task remembers a bounded
    number of pre-tokens. The vocabulary is read by the driver alone and sent to the tasks; it is as large as its file.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                doc = Document.of(text, counter)
                before, pretokens = doc.count, sum(len(x.pieces) for x in doc.leaves)
                edits = edits_of(text)
                # From the back, so that places of earlier edits stay right.
                for start, end, new in reversed(edits):
                    doc.edit(start, end, new)
                rows.append((before, len(edits), doc.count, pretokens, doc.recounted))
            numbers = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            columns = [batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in numbers)]
            names = ["doc_id", "tokens", "n_edits", "tokens_edited", "pretokens", "recounted"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tokens long, n_edits long, tokens_edited long, pretokens long, recounted long"
    return docs.select("doc_id", "text").mapInArrow(of_batches, schema)
