"""Edit-aware token counts: pre-token segment trees that are updated where a text is edited.

A text is cut into leaves of about LEAF_CHARS characters at single spaces between two non-space characters. The vocabulary's
pre-token pattern always splits there, so a leaf's token count does not depend on its neighbours, and the leaves' counts
are summed in a binary tree. An edit re-encodes the leaves it touches, with those whose border stands within one character of
it, and updates the sums on the way to the root; the rest of the text is not read again.

Defined cases: null text is empty and has 0 tokens; edits must lie in the text, be sorted and not overlap; an edit may be
empty or replace by nothing; rows that repeat are counted one by one; a null id is kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAF_CHARS = 512
#: Pre-tokens whose counts each Python worker keeps.
CACHE_PRETOKENS = 400_000
Edit = tuple[int, int, str]

EMAIL_OR_NUMBER = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+?\d[\d\-. ()]{6,}\d")


@dataclass
class Counter:
    """Token counts under a byte-pair vocabulary given as ranks in a file, with its pre-token pattern."""

    path: str
    pattern: str
    known: dict[str, int] = field(default_factory=dict)
    encoding: object = None
    splitter: object = None

    def open(self) -> Counter:
        import tiktoken

        with open(self.path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.splitter = regex.compile(self.pattern)
        return self

    def count(self, text: str) -> int:
        total, known = 0, self.known
        for piece in self.splitter.findall(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= CACHE_PRETOKENS:
                    known.clear()
                n = known[piece] = len(self.encoding.encode_ordinary(piece))
            total += n
        return total


_open: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _open:
        _open[path, pattern] = Counter(path, pattern).open()
    return _open[path, pattern]


def leaf_starts(text: str, size: int = LEAF_CHARS) -> list[int]:
    """Starts of the leaves: a leaf after the first begins with a single space between non-space characters."""
    starts, at = [0], size
    while (at := text.find(" ", at)) >= 0:
        if at + 1 < len(text) and at > 0 and not text[at - 1].isspace() and not text[at + 1].isspace():
            starts.append(at)
            at += size
        else:
            at += 1
    return starts


class SegmentTree:
    """Leaves of a text with their token counts, and the sums above them."""

    def __init__(self, text: str, count: Callable[[str], int], size: int = LEAF_CHARS):
        self.text, self.count = text, count
        self.starts = leaf_starts(text, size)
        self.width = 1 << (len(self.starts) - 1).bit_length()
        self.sums = [0] * (2 * self.width)
        for i, (a, b) in enumerate(zip(self.starts, [*self.starts[1:], len(text)], strict=True)):
            self.sums[self.width + i] = count(text[a:b])
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def set_leaf(self, leaf: int, n: int) -> None:
        at = self.width + leaf
        change = n - self.sums[at]
        while at and change:
            self.sums[at] += change
            at //= 2

    def touched(self, edits: list[Edit]) -> list[tuple[int, int, list[Edit]]]:
        """(first leaf, last leaf, edits) of the regions to encode again, regions that meet joined."""
        ends = [*self.starts[1:], len(self.text)]
        out: list[tuple[int, int, list[Edit]]] = []
        leaf = 0
        for e in edits:
            while leaf > 0 and ends[leaf - 1] > e[0] - 2:
                leaf -= 1
            while leaf < len(ends) - 1 and ends[leaf] <= e[0] - 2:
                leaf += 1
            last = leaf
            while last < len(ends) - 1 and self.starts[last + 1] < e[1] + 2:
                last += 1
            if out and leaf <= out[-1][1]:
                out[-1] = (out[-1][0], max(last, out[-1][1]), [*out[-1][2], e])
            else:
                out.append((leaf, last, [e]))
        return out

    def apply(self, edits: list[Edit]) -> int:
        """Update text and sums for the edits; the number of leaves that were encoded again.

        The new text of a region stands in its first leaf; its other leaves become empty, so the tree keeps its shape.
        """
        ends = [*self.starts[1:], len(self.text)]
        n = moved = done = copied = 0
        pieces, starts = [], []
        for first, last, own in self.touched(edits):
            at, parts = self.starts[first], []
            for start, end, new in own:
                parts += [self.text[at:start], new]
                at = end
            parts.append(self.text[at : ends[last]])
            new = "".join(parts)
            self.set_leaf(first, self.count(new))
            for leaf in range(first + 1, last + 1):
                self.set_leaf(leaf, 0)
            n += last - first + 1
            pieces += [self.text[copied : self.starts[first]], new]
            starts += [x + moved for x in self.starts[done : first + 1]]
            moved += len(new) - (ends[last] - self.starts[first])
            starts += [ends[last] + moved] * (last - first)
            done, copied = last + 1, ends[last]
        self.starts = starts + [x + moved for x in self.starts[done:]]
        self.text = "".join([*pieces, self.text[copied:]])
        return n


def redactions(text: str) -> list[Edit]:
    """Edits that replace mail addresses and long numbers by a mark."""
    return [(m.start(), m.end(), "<email>" if "@" in m[0] else "<number>") for m in EMAIL_OR_NUMBER.finditer(text)]


def count_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, editor: Callable[[str], list[Edit]]) -> Iterator[pa.RecordBatch]:
    count = counter(path, pattern).count
    for batch in batches:
        out: list[list[int]] = [[], [], [], [], []]
        for text in batch.column(1):
            tree = SegmentTree(text.as_py() or "", count)
            before, edits = tree.total, editor(tree.text)
            again = tree.apply(edits)
            for col, x in zip(out, (before, len(tree.starts), len(edits), again, tree.total), strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], ["id", "n_tokens", "n_leaves", "n_edits", "n_encoded_again", "n_tokens_edited"])


def edited_counts(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", editor: Callable[[str], list[Edit]] = redactions) -> DataFrame:
    """Per row: id_col, n_tokens, n_leaves, n_edits, n_encoded_again (leaves), n_tokens_edited."""
    small_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = rows.mapInArrow(lambda it: count_batches(it, path, pattern, editor), f"id {kind}, n_tokens long, n_leaves long, n_edits long, n_encoded_again long, n_tokens_edited long")
    return got.withColumnRenamed("id", id_col)
