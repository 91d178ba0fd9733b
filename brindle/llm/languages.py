"""Languages of documents and of their passages: multilingual mixture inference.

A character n-gram model per language, fitted on a bounded sample of labelled texts, gives every word of a
document a likelihood in each language. The document is a mixture: its sentence-like units each come from
one language of a set S with proportions pi. For a given S, expectation-maximisation estimates pi; S is
chosen by penalised likelihood, language by language, starting from the best single one: a language is
added while the mixture's log-likelihood rises by more than the penalty. (A language whose largest
possible gain, all units reassigned to it at no cost, stays below the penalty needs no EM run.) Where S has
several languages, the words are then aligned to passages by the most likely path with a cost for each
change of language, and a passage of at least ``min_passage`` characters counts as one of the text's languages.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import spread

#: Labelled rows that are read to fit the model, at most.
MAX_SAMPLES = 20_000
ORDER = 4
#: The most evidence (in nats) of a single word for one language against another: a strange name decides nothing.
WORD_CLIP = 5.0
#: Cost of a further language in the penalised likelihood, and of a change of language between words.
PENALTY, CHANGE = 12.0, 14.0
MEMORY = 400_000

#: Notations of the languages: two-letter code, three-letter codes, names in English and in the language.
NOTATIONS = {
    "da": "da dan danish dansk",
    "de": "de deu ger german deutsch",
    "el": "el ell gre greek ελληνικά ελληνικα gr",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
    "nl": "nl nld dut dutch nederlands flemish",
    "pl": "pl pol polish polski",
    "pt": "pt por portuguese português portugues",
    "sv": "sv swe swedish svenska",
    "uk": "uk ukr ukrainian українська ua",
}
#: The two-letter codes of ISO 639-1. Languages without notations above are known by their code alone.
ISO_639_1 = """
aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy
ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv
mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw
ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu
"""
LABELS = {code: code for code in ISO_639_1.split()} | {unicodedata.normalize("NFC", name): code for code, names in NOTATIONS.items() for name in names.split()}

_token = re.compile(r"[^\W\d_](?:[^\W\d_]|-[ \t]*\n[ \t]*(?=[^\W\d_])|[̀-ͯ­​-‍⁠])*|[.!?…;·]+(?=\s|$)|\n[ \t]*\n")
_noise = re.compile(r"-\s*\n\s*|[­​-‍⁠]")


def label_language(label: str | None) -> str | None:
    """The two-letter code a label names, in any notation ('en', 'EN', 'en-GB', 'eng', 'English', 'Deutsch'); None if it names no language known here.

    This is the only parser of labels: of the samples' and, in ``wrong_labels``, of the documents'."""
    if label is None:
        return None
    head = re.split(r"[-_ (/]", unicodedata.normalize("NFC", label).strip().casefold(), maxsplit=1)[0]
    return LABELS.get(head)


class Model:
    """Interpolated character n-gram models of all languages; ``word`` gives the log-likelihoods of a word."""

    def __init__(self, samples: Sequence[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        at = {lang: k for k, lang in enumerate(self.langs)}
        n = len(self.langs)
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        self.seen: set[str] = set()
        for lang, text in samples:
            for w in _token.findall(text):
                if w[0].isalpha():
                    if w[0].islower():
                        self.seen.add(self.form(w))
                    s = "^" * (ORDER - 1) + self.form(w) + "$"
                    for i in range(ORDER - 1, len(s)):
                        for k in range(ORDER):
                            counts[s[i - k : i + 1]][at[lang]] += 1
        self.counts = dict(counts)
        self.total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        self.kinds: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        for gram, c in self.counts.items():
            self.total[gram[:-1]] += c
            self.kinds[gram[:-1]] += c > 0
        self.total, self.kinds = dict(self.total), dict(self.kinds)
        self.alphabet = 400.0
        self._gram: dict[str, np.ndarray] = {}
        self._index: dict[str, int] = {}
        self._rows = np.zeros((1024, n))

    @staticmethod
    def form(word: str) -> str:
        return _noise.sub("", unicodedata.normalize("NFKC", word)).casefold()

    def gram(self, g: str) -> np.ndarray:
        """log P(last character | the ones before) in each language, Witten-Bell interpolated over the orders."""
        got = self._gram.get(g)
        if got is None:
            p = np.full(len(self.langs), 1 / self.alphabet)
            for k in range(1, len(g) + 1):
                part = g[-k:]
                total, kinds = self.total.get(part[:-1]), self.kinds.get(part[:-1])
                if total is None:
                    break
                c = self.counts.get(part)
                kinds = np.maximum(kinds, 1e-9)
                p = ((c if c is not None else 0.0) + kinds * p) / (total + kinds)
            if len(self._gram) > MEMORY:
                self._gram.clear()
            got = self._gram[g] = np.log(p)
        return got

    def word(self, w: str) -> np.ndarray:
        """Log-likelihoods less the largest; all 0 (no evidence) for an abbreviation or a name: a capitalised word that the samples don't have in small letters."""
        if w[0].isupper() and (1 < len(w) < 5 if w.isupper() else self.form(w) not in self.seen):
            return np.zeros(len(self.langs))
        s = "^" * (ORDER - 1) + self.form(w) + "$"
        v = np.zeros(len(self.langs))
        for i in range(ORDER - 1, len(s)):
            v += self.gram(s[i - ORDER + 1 : i + 1])
        v -= v.max()
        return np.maximum(v, -WORD_CLIP)

    def index(self, w: str) -> int:
        got = self._index.get(w)
        if got is None:
            got = len(self._index)
            if got == len(self._rows):
                self._rows = np.vstack([self._rows, np.zeros_like(self._rows)])
            self._rows[got] = self.word(w)
            self._index[w] = got
        return got

    def room(self) -> None:
        """Empty the memory of words when it is full; call between documents."""
        if len(self._index) > MEMORY:
            self._index.clear()

    def lines(self, ids: Sequence[int]) -> np.ndarray:
        return self._rows[np.asarray(ids, np.int64)]


def _em(units: np.ndarray, weights: np.ndarray, rounds: int = 30) -> tuple[float, np.ndarray]:
    """By at most ``rounds`` rounds of expectation-maximisation, or until a round gains less than 0.001: log-likelihood and proportions of the mixture of the languages in the columns of units; a unit's part in the proportions is its words."""
    pi = np.full(units.shape[1], 1 / units.shape[1])
    top = units.max(axis=1, keepdims=True)
    like = np.exp(units - top)
    before = -math.inf
    while True:
        joint = like * pi
        total = joint.sum(axis=1)
        value = float((np.log(total) + top[:, 0]).sum())
        rounds -= 1
        if value - before < 1e-3 or rounds <= 0:
            return value, pi
        before = value
        pi = np.maximum((joint / total[:, None] * weights[:, None]).sum(axis=0) / weights.sum(), 1e-6)


def language_set(units: np.ndarray, weights: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], list[float]]:
    """The languages of a document (columns of units) by penalised likelihood, the best single one first, and their proportions."""
    shares = [1.0]
    chosen = [int(units.sum(axis=0).argmax())]
    value = float(units[:, chosen[0]].sum())
    while len(chosen) < units.shape[1]:
        have = units[:, chosen].max(axis=1)
        gain = np.maximum(units - have[:, None], 0).sum(axis=0)
        best, best_value = -1, value + penalty
        for k in np.nonzero(gain > penalty)[0]:
            if k not in chosen:
                got, pi = _em(units[:, [*chosen, int(k)]], weights)
                if got > best_value:
                    best, best_value, best_shares = int(k), got, pi.tolist()
        if best < 0:
            break
        chosen.append(best)
        value, shares = best_value, best_shares
    return chosen, shares


def _path(rows: np.ndarray, ends: np.ndarray, change: float) -> np.ndarray:
    """The most likely language of each word when a change costs ``change``, half of it after the end of a unit."""
    n, k = rows.shape
    score, back = rows[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        other = int(score.argmax())
        moved = score[other] - (change / 2 if ends[i] else change)
        stay = score >= moved
        back[i] = np.where(stay, np.arange(k), other)
        score = np.where(stay, score, moved) + rows[i]
    out = np.empty(n, np.int64)
    out[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _document(model: Model, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]] | None:
    """Rows of the words, rows of the units, their words, the units' first words; None for a text without letters."""
    if not text:
        return None
    model.room()
    ids: list[int] = []
    starts, known = [0], model._index.get
    for w in _token.findall(text):
        i = known(w)
        if i is not None:
            ids.append(i)
        elif w[0].isalpha():
            ids.append(model.index(w))
        elif len(ids) > starts[-1]:
            starts.append(len(ids))
    if not ids:
        return None
    if starts[-1] == len(ids):
        starts.pop()
    rows = model.lines(ids)
    return rows, np.add.reduceat(rows, starts, axis=0), np.diff([*starts, len(ids)]).astype(float), starts


def mixture(model: Model, text: str | None) -> list[tuple[str, float]]:
    """The languages of a text with their proportions of its words, as expectation-maximisation estimates them; none for a text without letters."""
    got = _document(model, text)
    if got is None:
        return []
    chosen, shares = language_set(got[1], got[2])
    return [(model.langs[k], x) for k, x in zip(chosen, shares)]


def passages(model: Model, text: str | None, min_passage: int = 120) -> list[tuple[int, int, str, float]]:
    """Passages (start, end, language, confidence) of the text in order; none for a text without letters.

    A run shorter than half of min_passage between two runs of one language belongs to them (a quotation, a
    remark). Words without evidence at the end of a run (a list of names) belong to it, but its length in
    ``text_languages`` is that of the part with evidence: start and end are those of that part.
    """
    got = _document(model, text)
    if got is None:
        return []
    rows, units, weights, starts = got
    chosen, _ = language_set(units, weights)
    # posterior of the chosen language against the others
    if len(chosen) == 1:
        total = units.sum(axis=0)
        share = np.exp(total - total.max())
        return [(0, len(text), model.langs[chosen[0]], float(1 / share.sum()))]
    spans = [(m.start(), m.end()) for m in _token.finditer(text) if m.group()[0].isalpha()]
    first = np.zeros(len(rows), bool)
    first[starts] = True
    path = _path(rows[:, chosen], first, CHANGE)
    runs: list[list[int]] = []  # language, first word, last word
    for i, k in enumerate(path.tolist()):
        if runs and runs[-1][0] == k:
            runs[-1][2] = i
        else:
            runs.append([k, i, i])
    at = 1
    while at < len(runs) - 1:
        a, b, c = runs[at - 1 : at + 2]
        if a[0] == c[0] and spans[b[2]][1] - spans[b[1]][0] < min_passage / 2:
            runs[at - 1 : at + 2] = [[a[0], a[1], c[2]]]
            at = max(1, at - 1)
        else:
            at += 1
    tells = rows.any(axis=1)
    out = []
    for k, i, j in runs:
        inside = np.nonzero(tells[i : j + 1])[0]
        a, b = (i + int(inside[0]), i + int(inside[-1])) if len(inside) else (i, j)
        end = spans[b][1]
        while end < len(text) and text[end] in ".!?…;:,)»“”":
            end += 1
        total = rows[i : j + 1].sum(axis=0)
        share = np.exp(total - total.max())
        out.append((spans[a][0], end, model.langs[chosen[k]], float(share[chosen[k]] / share.sum())))
    return out


def text_languages(found: Sequence[tuple[int, int, str, float]], text: str, min_passage: int = 120) -> list[str]:
    """The languages of a text: those with a passage of at least min_passage characters (without blanks at its ends), else the one with the most characters."""
    size: Counter[str] = Counter()
    long = set()
    for a, b, lang, _ in found:
        n = len(text[a:b].strip())
        size[lang] += n
        if n >= min_passage:
            long.add(lang)
    return sorted(long) if len(long) > 1 else [max(size, key=lambda x: (size[x], x))] if size else []


def fit(samples: DataFrame, lang_col: str = "lang", text_col: str = "text", max_samples: int = MAX_SAMPLES) -> list[tuple[str, str]]:
    """The labelled rows the model is fitted on: at most max_samples, those with a known label and a text."""
    rows = samples.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(lang_col, text_col).orderBy(F.xxhash64(text_col), text_col).limit(max_samples).collect()
    return [(code, r[1]) for r in rows if (code := label_language(r[0]))]


PASSAGES = [("passage_no", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("lang", T.StringType()), ("confidence", T.DoubleType()), ("counts", T.BooleanType())]
_models: dict[int, Model] = {}


def _model(samples: Sequence[tuple[str, str]]) -> Model:
    """The model of some samples, made once in a process."""
    key = hash(tuple(samples))
    if key not in _models:
        _models.clear()
        _models[key] = Model(samples)
    return _models[key]


def passage_rows(docs: DataFrame, samples: Sequence[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), min_passage: int = 120, label_col: str | None = None) -> DataFrame:
    """One row per passage: *id_col*, columns *keep*, ``label`` if label_col is given (the language that it names), ``passage_no, start, end`` (code points), ``lang, confidence, counts``.

    ``counts``: the language is one of the text's languages (``text_languages``). A null, empty or blank
    text, or one without letters, gives one row with null language and confidence 0. Repeated rows stay;
    texts are read whole; an empty table gives none. The samples are bounded by ``fit``.
    """
    source = spread(docs).select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(list(samples))
    labelled = [T.StructField("label", T.StringType())] if label_col is not None else []
    if label_col is not None:
        source = spread(docs).select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"), F.col(label_col).cast("string").alias("__label"))
    width = 1 + len(keep)
    schema = T.StructType([*source.schema.fields[:width], *labelled, *[T.StructField(n, t) for n, t in PASSAGES]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(width).to_pylist()):
                got = passages(model, text, min_passage)
                langs = text_languages(got, text or "", min_passage)
                for x, (a, b, lang, conf) in enumerate(got or [(0, len(text or ""), None, 0.0)]):
                    at.append(k)
                    rows.append((x, a, b, lang, conf, lang in langs))
            of = [label_language(x) for x in batch.column(width + 1).to_pylist()] if label_col is not None else []
            if at:
                ids = pa.array(at)
                cols = list(zip(*rows))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(ids) for c in range(width)] + ([pa.array(of, pa.string()).take(ids)] if of else []) + [pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

    return source.mapInArrow(run, schema)


def mixture_rows(docs: DataFrame, samples: Sequence[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """*id_col*, ``lang``, ``proportion``: the estimated mixture of each document; one row with nulls for a text without letters."""
    source = spread(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(list(samples))
    schema = T.StructType([source.schema.fields[0], T.StructField("lang", T.StringType()), T.StructField("proportion", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            got = [(k, *x) for k, text in enumerate(batch.column(1).to_pylist()) for x in (mixture(model, text) or [(None, None)])]
            if got:
                at, langs, shares = zip(*got)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(langs, pa.string()), pa.array(shares, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def wrong_labels(docs: DataFrame, samples: Sequence[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", min_passage: int = 120) -> DataFrame:
    """*id_col*, ``true_lang``: one row per language of each document whose label is missing, names no language or another one, or whose text has several languages."""
    rows = passage_rows(docs.select(id_col, text_col, label_col), samples, id_col, text_col, (), min_passage, label_col).where("counts").select(id_col, F.col("label").alias("__label"), "lang").distinct()
    # number of languages of a document: at most that of the model's, so a group is small
    per = rows.groupBy(id_col, "__label").agg(F.collect_set("lang").alias("__langs"))
    wrong = (F.size("__langs") > 1) | F.col("__label").isNull() | (F.col("__label") != F.col("__langs")[0])
    return per.where(wrong).select(id_col, F.explode("__langs").alias("true_lang")).distinct()
