"""Passages of test items inside a corpus: Wu-Manber search for seeds, exact extension around them.

Texts are compared as sequences of words without case, accents, punctuation, spacing, hyphens and ways of
coding a character. A document holds an item when at least ``min_words`` successive words of the item stand
in it with at most one word in ``per_edit`` lost, added or changed. A passage of L item words is what an
alignment covers, so a word lost or changed at its ends counts as an edit like one inside.

Remarks of the record do not count. A remark is what stands in brackets, whatever its length and however
deeply nested, or between two successive dashes that join no words, across line breaks, if that reads as a sentence
(a capital letter first or a final mark last) or stands apart from other dashes. Whether such a span is a remark cannot be told from the text (a passage may have brackets and
dashes of its own), so each one may be passed over at no cost or read like other words, one by one: the
text is a line of words with ``jumps`` over its remarks, and an alignment may take any of them.

1. Seeds. A passage of L words with L / per_edit edits keeps a run of at least ``seed`` = 4 item words
   untouched (14 words, 2 edits: 12 words in 3 runs; longer passages likewise), so every case has a seed;
   runs of fewer than 4 words lose at most 3 words an edit, so its seeds cover at least L - 4 e >= 6 item words.
   All windows of 4 item words are the patterns of a Wu-Manber search whose alphabet is the words:
   the shift table of 2-word blocks skips positions at which no pattern can end (3 words at a time in
   unrelated text), the block that ends a pattern picks a bucket of test strings, and the words are compared
   directly. Windows that reach over a jump are walked from the words before it, with the same tables.
2. Extension. From a seed, furthest-reaching points per number of edits and diagonal give the most item
   words that e edits can cover to the right and to the left; where a jump is near, all points that e edits
   reach are followed instead. The case holds when some e_left + e_right = e gives L >= min_words and
   per_edit * e <= L. There are no scores, no heuristics and no limits of length.

The items are a given, bounded set: ``blocks`` splits them by words, and each block is broadcast and run
against all rows, so that what is broadcast has a proven bound whatever the number of items. The tables of a
block are made once in a Python worker.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import spread

SEED = 4
BLOCK = 2

_marks = re.compile(r"[̀-ͯ҃-҉­​-‏⁠-⁤﻿]+")
_word = re.compile(r"[^\W_]+(?:(?:[-‐‑]\s*\n\s*|[-‐‑'’ʼ´`])[^\W_]+)*")
_inner = re.compile(r"[\W_]+")
#: Brackets of either kind, and dashes that join no words: what remarks of the record stand in.
_edge = re.compile(r"[()\[\]（）［］]|(?<!\w)[–—-](?!\w)|(?<!\w)[–—]|[–—](?!\w)")
_CLOSES = {")": "(", "）": "(", "]": "[", "］": "["}


def words(text: str) -> list[str]:
    """The words of a text in the form in which they are compared; parts joined by a hyphen, an apostrophe or a hyphenated line end are one word."""
    if text.isascii():
        text = text.lower()
    else:
        text = _marks.sub("", unicodedata.normalize("NFKD", text)).casefold()
    return [w if w.isalnum() else _inner.sub("", w) for w in _word.findall(text)]


def remarks(text: str) -> list[tuple[int, int]]:
    """Spans that may be remarks: every pair of brackets (of one kind, balanced; nested ones too), every two successive dashes."""
    out = []
    open_: dict[str, list[int]] = {"(": [], "[": []}
    dash = -1
    for m in _edge.finditer(text):
        c, at = m.group(), m.start()
        if c in "–—-":
            if dash >= 0:
                out.append((dash, at + 1))
            dash = at
        elif c in _CLOSES:
            own = _CLOSES[c]
            if open_[own]:
                start = open_[own].pop()
                other = open_["[" if own == "(" else "("]
                while other and other[-1] > start:  # opened inside and never closed
                    other.pop()
                out.append((start, at + 1))
        else:
            open_["(" if c in "(（" else "["].append(at)
    return out


def _is_sentence(text: str, a: int, b: int) -> bool:
    """Does the span between two dashes read as a sentence of its own: a capital letter first or a final mark last?"""
    inside = text[a + 1 : b - 1].strip()
    return bool(inside) and (inside[-1] in "!?.…" or inside.lstrip("¡¿«»„“”\"'‚‘’").strip()[:1].isupper())


def parse(text: str, apart: int = 14) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of the text, and the jumps over its possible remarks as (word before which it starts, word after it).

    A span between dashes has a jump if it reads as a sentence, or if no other dash is within *apart* words
    of it: where dashes stand between the words of one sentence they are punctuation.
    """
    spans = remarks(text)
    if not spans:
        return words(text), []
    out: list[str] = []
    index, at = {}, 0
    for cut in sorted({x for s in spans for x in s}):
        out += words(text[at:cut])
        index[cut] = len(out)
        at = cut
    out += words(text[at:])
    jumps = set()
    dashes = sorted(index[x] for s in spans if text[s[0]] in "–—-" for x in s)
    for a, b in spans:
        x, y = index[a], index[b]
        if x == y:
            continue
        if text[a] in "–—-" and not _is_sentence(text, a, b):
            own = bisect_right(dashes, x) - bisect_left(dashes, x) + bisect_right(dashes, y) - bisect_left(dashes, y)
            if bisect_right(dashes, y + apart) - bisect_left(dashes, x - apart) > own:
                continue
        jumps.add((x, y))
    return out, sorted(jumps)


class Matcher:
    """The tables of a block of items."""

    def __init__(self, items: Sequence[tuple[int, str]], min_words: int = 14, per_edit: int = 6):
        self.min_words, self.per_edit = min_words, per_edit
        self.items = [(i, words(t)) for i, t in items if t]
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        if any((n - n // per_edit) // (n // per_edit + 1) + ((n - n // per_edit) % (n // per_edit + 1) > 0) < SEED for n in range(min_words, min_words + 12 * per_edit)):
            raise ValueError(f"with these limits a passage need not keep {SEED} successive words untouched")
        self.least = max(SEED, min(n - SEED * (n // per_edit) for n in range(min_words, min_words + 12 * per_edit)))
        most = SEED - BLOCK + 1
        for k, (_, w) in enumerate(self.items):
            for at in range(len(w) - SEED + 1):
                for j in range(BLOCK, SEED + 1):
                    block = (w[at + j - 2], w[at + j - 1])
                    self.shift[block] = min(self.shift.get(block, most), SEED - j)
                self.bucket[(w[at + SEED - 2], w[at + SEED - 1])].append((k, at))
        self.firsts = {a for a, _ in self.shift}

    def seeds(self, text: list[str]) -> dict[int, dict[int, list[int]]]:
        """item number -> diagonal (text position - item position) -> item positions of seeds."""
        found: dict[int, dict[int, list[int]]] = {}
        shift, bucket, items, most = self.shift.get, self.bucket, self.items, SEED - BLOCK + 1
        end, n = SEED - 1, len(text)
        while end < n:
            block = (text[end - 1], text[end])
            step = shift(block, most)
            if step:
                end += step
                continue
            at = end - SEED + 1
            a, b = text[at], text[at + 1]
            for k, pos in bucket[block]:
                w = items[k][1]
                if w[pos] == a and w[pos + 1] == b:
                    found.setdefault(k, {}).setdefault(at - pos, []).append(pos)
            end += 1
        return found

    def crossing(self, text: list[str], jumps: dict[int, list[int]]) -> dict[int, list[tuple[int, int, int]]]:
        """item number -> (item position, first text position, text position after) of seeds that reach over a jump."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        shift, n = self.shift, len(text)
        starts = sorted({p for s in jumps for p in range(max(0, s - SEED + 1), s) if text[p] in self.firsts})
        for first in starts:
            todo = [(first, (text[first],), False)]
            while todo:
                p, window, over = todo.pop()
                if len(window) == SEED:
                    if over:
                        for k, pos in self.bucket.get(window[-BLOCK:], ()):
                            if self.items[k][1][pos : pos + SEED - BLOCK] == list(window[:-BLOCK]):
                                found.setdefault(k, []).append((pos, first, p + 1))
                    continue
                if text[p] not in self.firsts:
                    continue
                ways, more = {p + 1: over}, [p + 1]
                while more:  # a remark may follow on a remark
                    for t in jumps.get(more.pop(), ()):
                        if t not in ways:
                            ways[t] = True
                            more.append(t)
                for t, jumped in ways.items():
                    # a pair of words that no pattern has ends the walk
                    if t < n and (text[p], text[t]) in shift:
                        todo.append((t, (*window, text[t]), jumped))
        return found

    def _reach(self, a: list[str], b: list[str], most: int) -> list[int]:
        """out[e]: the most words of a that an alignment of prefixes of a and b with e edits covers."""
        n, m = len(a), len(b)
        far = {0: 0}
        out = []
        for e in range(most + 1):
            if e:
                new: dict[int, int] = {}
                for d, i in far.items():  # d: position in b - position in a
                    if i < n and i + d < m and new.get(d, -1) < i + 1:
                        new[d] = i + 1  # changed
                    if i < n and new.get(d - 1, -1) < i + 1:
                        new[d - 1] = i + 1  # lost
                    if i + d < m and new.get(d + 1, -1) < i:
                        new[d + 1] = i  # added
                    if new.get(d, -1) < i:
                        new[d] = i
                far = new
            for d, i in far.items():
                while i < n and i + d < m and a[i] == b[i + d]:
                    i += 1
                far[d] = i
            out.append(max(far.values()))
            if out[-1] == n:
                break
        return out

    def _reach_over(self, a: list[str], text: list[str], start: int, step: int, jumps: dict[int, list[int]], most: int) -> list[int]:
        """The same along the text from the gap before word start on (step 1) or back (-1), any jump free: all points that e edits reach."""
        n, m = len(a), len(text)
        seen: set[tuple[int, int]] = set()
        todo, best, out = [(0, start)], 0, []
        for _ in range(most + 1):
            level = []
            while todo:
                point = todo.pop()
                if point in seen:
                    continue
                seen.add(point)
                level.append(point)
                i, j = point
                best = max(best, i)
                at = j if step > 0 else j - 1
                if i < n and 0 <= at < m and a[i] == text[at]:
                    todo.append((i + 1, j + step))
                for t in jumps.get(j, ()):
                    todo.append((i, t))
            out.append(best)
            if best == n:
                break
            for i, j in level:
                more = 0 <= (j if step > 0 else j - 1) < m
                if i < n:
                    todo.append((i + 1, j))
                    if more:
                        todo.append((i + 1, j + step))
                if more:
                    todo.append((i, j + step))
        return out

    def _enough(self, left: list[int], right: list[int]) -> bool:
        return any(SEED + r + le >= self.min_words and (x + y) * self.per_edit <= SEED + r + le for x, r in enumerate(right) for y, le in enumerate(left))

    def holds(self, item: list[str], text: list[str], diagonals: dict[int, list[int]], over: Sequence[tuple[int, int, int]] = (), near: "Jumps | None" = None) -> bool:
        """Do the item's seeds in the text extend to a case?

        Seeds of a case of L words and e edits cover C >= L - SEED * e item words, and per_edit * e <= L; so C
        bounds L, and with it the edits worth looking at.
        """
        covered: set[int] = set()
        for at in (*diagonals.values(), [pos for pos, _, _ in over]):
            for pos in at:
                covered.update(range(pos, pos + SEED))
        if len(covered) < self.least:
            return False
        most = len(item) // self.per_edit
        if self.per_edit > SEED:
            most = min(most, len(covered) // (self.per_edit - SEED))
        room = len(item) + most + 1

        def right(pos: int, j: int) -> list[int]:
            if near and near.ahead(j, j + room):
                return self._reach_over(item[pos:], text, j, 1, near.on, most)
            return self._reach(item[pos:], text[j : j + room], most)

        def left(pos: int, j: int) -> list[int]:
            if near and near.behind(j - room, j):
                return self._reach_over(item[:pos][::-1], text, j, -1, near.back, most)
            return self._reach(item[:pos][::-1], text[max(0, j - room) : j][::-1], most)

        for d, at in diagonals.items():
            done = -1
            for pos in at:
                j = pos + d
                if pos < done and not (near and (near.ahead(j - room, j + room) or near.behind(j - room, j + room))):
                    continue  # inside the run that the last seed was extended along
                to_right = right(pos + SEED, j + SEED)
                if self._enough(left(pos, j), to_right):
                    return True
                done = pos + SEED + to_right[0]
        return any(self._enough(left(pos, first), right(pos + SEED, after)) for pos, first, after in over)

    def find(self, text: str | None) -> list[int]:
        """Ids of the items that the text holds, each once."""
        if not text:
            return []
        w, jumps = parse(text)
        near = Jumps(jumps) if jumps else None
        straight = self.seeds(w)
        over = self.crossing(w, near.on) if near else {}
        out = []
        for k in straight.keys() | over.keys():
            item_id, item = self.items[k]
            if self.holds(item, w, straight.get(k, {}), over.get(k, ()), near):
                out.append(item_id)
        return sorted(out)


class Jumps:
    """The jumps of a text in both directions."""

    def __init__(self, jumps: Sequence[tuple[int, int]]):
        self.on: dict[int, list[int]] = defaultdict(list)
        self.back: dict[int, list[int]] = defaultdict(list)
        for a, b in jumps:
            self.on[a].append(b)
            self.back[b].append(a)
        self._starts, self._ends = sorted(self.on), sorted(self.back)

    def ahead(self, a: int, b: int) -> bool:
        """Does a jump start in a..b?"""
        k = bisect_left(self._starts, a)
        return k < len(self._starts) and self._starts[k] <= b

    def behind(self, a: int, b: int) -> bool:
        """Does a jump end in a..b?"""
        k = bisect_left(self._ends, a)
        return k < len(self._ends) and self._ends[k] <= b


def blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in id order, cut so that a block has about block_words words (one longer item is a block of its own)."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col).orderBy(id_col).toLocalIterator():
        n = len(r[1]) // 5 + 1
        if part and size + n > block_words:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += n
    if part:
        yield part


#: The tables of the last block in this process.
_made: dict[str, Matcher] = {}


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 14, per_edit: int = 6, block_words: int = 2_000_000) -> DataFrame:
    """Distinct pairs (*id_col*, *item_col*): the document holds a passage of the item.

    Null and empty texts hold nothing; items with fewer than min_words words are no case; items with the
    same text are each reported; a repeated document is reported once; a null id stays null; empty tables
    give no rows. Texts are searched whole, whatever their length.
    """
    spark = docs.sparkSession
    source = spread(docs.where(F.col(text_col).isNotNull())).select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    names = [id_col, item_col]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, items.schema[item_col].dataType)])
    item_type = schema[1].dataType
    out = None
    for block in blocks(items, item_col, item_text, block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            if key not in _made:
                _made.clear()
                _made[key] = Matcher(shared.value, min_words, per_edit)
            matcher = _made[key]
            for batch in batches:
                ids, at, found = batch.column(0), [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    got = matcher.find(t)
                    at += [k] * len(got)
                    found += got
                if at:
                    kind = pa.int64() if item_type.typeName() == "long" else pa.int32() if item_type.typeName() == "integer" else None
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(found, kind)], names=names)

        one = source.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.distinct()
