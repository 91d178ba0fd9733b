"""Byte-level BPE by a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton over tokens that accepts exactly the
correct tokenizations (Berglund, Martens, van der Merwe: Constructing a BPE tokenization DFA). It starts
with one state that loops on the 256 bytes. The gadget of a merge (u, v) -> w splits the state p that the
u-arcs lead to: they now lead to a copy of p without its v-arc, and every state that has a u-arc gets a
w-arc to where p's v-arc led. So all arcs of one token lead to one state, and a state is a version of the
state of some token: (owner, time). The arcs of a version are not written out (50,000 versions with
thousands of arcs each); ``accepts`` decides one by going back through the versions, and the answers are kept.

A word is encoded by table-driven transitions: a byte trie of the arc labels gives the tokens that start at
a position, the automaton says which of them may follow the token that ends there. Each prefix has exactly
one accepted tokenization, so one token per position is kept and nothing is ever undone. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import spread

#: Where the public tokenizers' files are; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the memory of encoded words in a worker; it is emptied when full, which changes no result.
MEMORY = 300_000


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = {}, 256
    for b in range(256):
        if b in shown:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


def load(path: str) -> tuple[list[tuple[int, int, int]], dict[int, bytes]]:
    """Merges (left id, right id, new id) in rank order and the bytes of each id, from a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = _byte_chars()
    vocab = model["vocab"]
    labels = {i: bytes(of[c] for c in s) for s, i in vocab.items() if all(c in of for c in s)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], labels


class Automaton:
    """Compiled merges. ``encode`` takes the bytes of one pre-split word."""

    def __init__(self, merges: list[tuple[int, int, int]], labels: dict[int, bytes]):
        size = max(labels) + 1
        self.label = labels
        self.left, self.right = [-1] * size, [-1] * size
        self.born = [-1] * size  # time of the merge that made the token; bytes: -1
        self.split: dict[int, int] = {}  # left * size + right -> time at which left's state lost its arc for right
        self.size = size
        self._memory: dict[bytes, list[int]] = {}
        self._known: dict[int, bool] = {}
        live = {i for i, b in labels.items() if len(b) == 1}
        for time, (u, v, w) in enumerate(merges):  # the gadgets, in order
            if u not in live or v not in live or w in live or not self._accepts(u, v, time - 1):
                continue  # no path u v is left: the gadget would change nothing
            self.split[u * size + v] = time
            self.left[w], self.right[w], self.born[w] = u, v, time
            live.add(w)
        self._known.clear()
        self.root: dict = {}
        for i in live:
            node = self.root
            for b in labels[i]:
                node = node.setdefault(b, {})
            node[-1] = i
        self.whole = {labels[i]: [i] for i in live}

    def _accepts(self, owner: int, y: int, now: int) -> bool:
        """Has the state of owner, in its version of time now, an arc for y?"""
        left, right, born, split, size = self.left, self.right, self.born, self.split, self.size
        while True:
            t = split.get(owner * size + y)
            if t is not None and t <= now:
                return False  # a split of this owner's state took the arc away
            if born[y] > born[owner]:  # the arc was added with y, to the states that had an arc for y's left part then
                now = min(now, born[y])
                y = left[y]
            elif born[owner] < 0:
                return True  # the first state has all bytes
            else:  # owner's first version was the version of its right part just before
                now = born[owner] - 1
                owner = right[owner]

    def accepts(self, owner: int, y: int) -> bool:
        key = owner * self.size + y
        got = self._known.get(key)
        if got is None:
            if len(self._known) > 4 * MEMORY:
                self._known.clear()
            got = self._known[key] = self._accepts(owner, y, len(self.left) + (1 << 30))
        return got

    def encode(self, word: bytes) -> list[int]:
        got = self.whole.get(word)
        if got is not None:
            return got
        n = len(word)
        last = [-1] * (n + 1)
        accepts, root, label = self.accepts, self.root, self.label
        for i in range(n):
            before = last[i]
            node = root
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None and last[j + 1] < 0 and (i == 0 or accepts(before, t)):
                    last[j + 1] = t
        out = []
        while n:
            out.append(last[n])
            n -= len(label[last[n]])
        out.reverse()
        return out

    def encode_text(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens (their strings are ordinary text); none for a null or empty text."""
        out: list[int] = []
        if not text:
            return out
        memory = self._memory
        for w in _split(text):
            ids = memory.get(w)
            if ids is None:
                ids = self.encode(w.encode("utf-8", "surrogatepass"))
                if len(w) < 64:
                    if len(memory) > MEMORY:
                        memory.clear()
                    memory[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that the labels of the arcs spell; an id that is no label raises KeyError."""
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "replace")


_split = regex.compile(PATTERN).findall
_made: dict[str, Automaton] = {}


def automaton(path: str, compiled=None) -> Automaton:
    """The automaton of a file, compiled once in a process."""
    if path not in _made:
        _made[path] = Automaton(*(compiled or load(path)))
    return _made[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """*id_col* and ``ids`` (array of int) of every row of df, by the tokenizer at *path*.

    A null or empty text gives an empty list; blanks are text; a null id stays null; repeated rows stay;
    an empty table gives none. Other columns of df don't matter, whatever their names. The file is read on
    the driver; the merges go to the executors once (their size is that of the vocabulary), the automaton
    is compiled once in a worker.
    """
    source = spread(df).select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    schema = source.select(id_col).withColumn("ids", F.array(F.lit(0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(path, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = pa.array([own.encode_text(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """*id_col* and ``text`` of encoded rows: the exact inverse of ``encode`` for texts without unpaired surrogates; empty and null lists give the empty text."""
    source = df.select(F.col(id_col), F.col(ids_col).alias("__ids"))
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    schema = source.select(id_col).withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(path, shared.value)
        for batch in batches:
            texts = pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return source.mapInArrow(run, schema)
