"""Subject areas of documents by subject-specific interpolated n-gram language models.

Each subject and "no subject" has a model that interpolates word pairs, words and the background (the words of the whole corpus).
A sentence is scored by how much lower its cross-entropy is under a subject's model than under the background; a document treats
the subjects that enough of its sentences are about. The models start from labelled examples whose labels are checked against each
other, and are refined by expectation maximisation over every sentence of every document, with a prior per document. That carries
a subject from one language to another where documents mix them, and settles examples whose labels contradict each other.

How readily a subject is accepted is calibrated at the end on the examples, each held out of the models that judge it.

Counts are kept by the words and pairs themselves: every distinct one of the corpus and the examples has its own row in the tables, so
what is collected and sent to the tasks grows with the distinct pairs (classes x 4 bytes each), not with the documents. Tables larger than
``MAX_MODEL_BYTES`` are refused.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Labelled examples used at most; more are refused, not sampled.
MAX_EXAMPLES = 20_000
#: Subjects beyond this are refused, and tables of counts beyond this size, which every Python worker holds.
MAX_SUBJECTS, MAX_MODEL_BYTES = 1_000, 1 << 30

# Phrases after which a sentence only mentions or compares with something, in the languages of the corpus.
MENTIONS = (
    "not to be confused", "as opposed to", "a different matter from", "whatever one says of", "just as with", " unlike ",
    "anders als", "nicht zu verwechseln", "ganz im gegensatz zu", "im gegensatz zu",
    "à ne pas confondre", "a ne pas confondre", "contrairement à", "contrairement a",
)
_STOP = re.compile("[.!?…]")
_TAG = re.compile(r"</?[a-z!?][^<>\n]*>")
_NUMBERED = re.compile(r"^\d{1,3}[.)]\s+")
_MARKS = " \t>#*•·–-"
_BROKEN = re.compile(r"(\w)\s?-\n\s*(\w)")
_END = re.compile(r"(?<=[.!?…])[\"»”)\]]*\s+")
_CODE = re.compile(r"[=\[\]{}|;]|\):$")
_LETTERS = re.compile(r"[^\W\d_]{3}")
_WORD = re.compile(r"\w+")
_NUMBER = re.compile(r"\d+")
# Characters a scan confuses become one.
_SAME = str.maketrans({"0": "o", "1": "l", "e": "c"})


def fold_word(word: str) -> str:
    """A lower-case word without accents; characters that scans confuse are one, numbers are all alike."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return "0" if word.isdigit() else word.translate(_SAME).replace("rn", "m")


def _lines(lowered: str) -> list[str]:
    """Lines of a lower-case text without markup and list marks; words broken at a line's end are joined."""
    if "<" in lowered:
        lowered = _TAG.sub("\n", lowered)
    if "-\n" in lowered:
        lowered = _BROKEN.sub(r"\1\2", lowered)
    out = []
    for line in lowered.split("\n"):
        line = line.strip().lstrip(_MARKS)
        if line and line[0].isdigit():
            line = _NUMBERED.sub("", line)
        if line:
            out.append(line)
    return out


def without_mentions(lowered: str) -> str:
    """A lower-case text without what its sentences only mention: from the phrase to the end of the sentence."""
    for phrase in MENTIONS:
        i = lowered.find(phrase)
        while i >= 0:
            stop = _STOP.search(lowered, i + len(phrase))
            lowered = lowered[:i] + " " + (lowered[stop.start() :] if stop else "")
            i = lowered.find(phrase, i)
    return lowered


def last_lines(text: str | None, n: int = 3) -> list[str]:
    """The last lines of a text that aren't blank, without working through all of it."""
    out: list[str] = []
    rest = text or ""
    while rest and len(out) < n:
        rest, _, line = rest.rpartition("\n")
        out = _lines(line.lower()) + out
    return out[-n:]


def line_shape(line: str) -> str:
    """A line up to case and numbers, by which repeated footers are known."""
    return _NUMBER.sub("0", line.lower())


class Footers:
    """Shapes of footers, known by their digests whatever their length."""

    HEAD = 6

    def __init__(self, shapes: dict[bytes, str] | None = None):
        self.digests = frozenset(shapes or ())
        self.heads = frozenset((shapes or {}).values())

    @staticmethod
    def digest(shape: str) -> bytes:
        return hashlib.sha256(shape.encode("utf-8", "surrogatepass")).digest()

    @classmethod
    def head(cls, line: str) -> str:
        """The first characters of the shape, from as much of the line as they need."""
        part = line_shape(line[:40])
        return (part if len(part) > cls.HEAD or len(line) <= 40 else line_shape(line))[: cls.HEAD]

    def __contains__(self, line: str) -> bool:
        return bool(self.digests) and self.head(line) in self.heads and self.digest(line_shape(line)) in self.digests


def sentences(text: str | None, footers: Footers = Footers()) -> list[list[str]]:
    """Lower-case words of each sentence, without what it only mentions. Footers, code, tables and fragments under three words are no
    sentences; a line that doesn't end a sentence goes on in the next."""
    if not text:
        return []
    lowered = text.lower()
    if not lowered.isascii():
        lowered = unicodedata.normalize("NFC", lowered)
    kept, rest = [], ""
    for line in _lines(lowered):
        if not _LETTERS.search(line) or line in footers:
            continue
        ends = line.rstrip("\"»”)]")[-1:] in ".!?…"
        if not ends and _CODE.search(line):
            continue
        rest = f"{rest} {line}" if rest else line
        if ends or line[-1] == ":":
            kept.append(rest)
            rest = ""
    if rest:
        kept.append(rest)
    out = []
    for part in kept:
        for s in _END.split(without_mentions(part)):
            words = _WORD.findall(s)
            if len(words) >= 3:
                out.append(words)
    return out


def word_id(word: str) -> str:
    """What a lower-case word is counted by: the folded word itself."""
    return fold_word(word)


def _previous(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word before each; 0 at the start of a sentence."""
    before = np.concatenate([[0], ids[:-1]]).astype(np.int64) if len(ids) else ids.astype(np.int64)
    before[starts] = 0
    return before


@dataclass
class Places:
    """Rows of words and pairs in the tables, one each: 0 is the start of a sentence, the last one whatever isn't listed."""

    words: pa.Array  # folded words, each once
    pairs: np.ndarray | None = None  # numbers of pairs, ascending

    @property
    def n_words(self) -> int:
        return len(self.words) + 2

    @property
    def n_pairs(self) -> int:
        return len(self.pairs) + 1

    def ids(self, words: pa.Array) -> np.ndarray:
        return _row(words.cast(pa.string()), self.words) + 1

    def numbers(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A number of its own for each pair."""
        return before * self.n_words + ids

    def pair(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return _row(pa.array(self.numbers(before, ids)), pa.array(self.pairs))


def _row(values: pa.Array, listed: pa.Array) -> np.ndarray:
    """Place of each value in a list, the list's length if it isn't there."""
    return pc.fill_null(pc.index_in(values, value_set=listed), len(listed)).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Models:
    """Counts of each class (columns: subjects in order, then "no subject") by word, word as a context, and pair; the background's
    share of each word; and the rows of words and pairs."""

    words: np.ndarray
    contexts: np.ndarray
    pairs: np.ndarray
    background: np.ndarray
    places: Places
    pair_weight: float = 0.45
    word_weight: float = 0.40

    sharpness: float = 0.7
    lean: np.ndarray | None = None  # log weight of each class at acceptance

    def __post_init__(self) -> None:
        total = self.words.sum(axis=0)
        self._known = total > 0
        self._share = (self.word_weight * self.words / np.maximum(total, 1e-9)).astype(np.float32)
        self._base = self.background.astype(np.float32)

    @property
    def n_classes(self) -> int:
        return self.words.shape[1]

    def gain(self, ids: np.ndarray, before: np.ndarray, pair: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sentences x classes: log likelihood over the background's, the cross-entropy gain summed over the sentence.

        A class of which nothing is known yet is the background itself.
        """
        out = np.empty((len(starts), self.n_classes), dtype=np.float32)
        # A piece at a time, so that the words x classes tables stay small; pieces end where sentences do.
        bounds = np.searchsorted(starts, np.arange(0, len(ids), 200_000))
        bounds = np.unique(np.append(bounds, len(starts)))
        for a, b in zip(bounds[:-1], bounds[1:]):
            lo, hi = starts[a], starts[b] if b < len(starts) else len(ids)
            i = ids[lo:hi]
            out[a:b] = self._gain(self._share[i], self.contexts[before[lo:hi]], self.pairs[pair[lo:hi]], self._base[i], starts[a:b] - lo)
        out[:, ~self._known] = 0
        return out

    def _gain(self, share: np.ndarray, seen: np.ndarray, q: np.ndarray, base: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Interpolated likelihood over the background's, by the counts at each word; ``q`` (counts of pairs) is used up."""
        fresh = seen <= 0
        np.divide(q, seen, out=q, where=~fresh)
        np.minimum(q, 1, out=q)  # sums of small floats may differ in the last digits
        q *= np.float32(self.pair_weight)
        q[fresh] = 0
        q += share
        q /= base[:, None]
        q += np.float32(1 - self.pair_weight - self.word_weight)
        q += np.float32(self.pair_weight) * fresh
        np.log(q, out=q)
        return np.add.reduceat(q, starts, axis=0)

    def gain_without(self, ex: Examples, weights: np.ndarray, i: int, left_out: list[int]) -> np.ndarray:
        """Gain of example i (its sentences x classes) with some examples, counted with ``weights``, taken out of the counts."""
        ids, before, pair, starts = ex.part(i)
        words, seen, q, total = self.words[ids], self.contexts[before], self.pairs[pair], self.words.sum(axis=0)
        for d in left_out:
            w = weights[d].astype(np.float32)
            d_ids, d_before, d_pair, _ = ex.part(d)
            for counts, mine, theirs in ((words, ids, d_ids), (seen, before, d_before), (q, pair, d_pair)):
                listed, n = np.unique(theirs, return_counts=True)
                at = np.minimum(np.searchsorted(listed, mine), len(listed) - 1)
                counts -= np.where(listed[at] == mine, n[at], 0)[:, None].astype(np.float32) * w
            total = total - len(d_ids) * w
        for counts in (words, seen, q):
            counts[counts < 1e-4] = 0
        known = total > 1e-4
        share = np.float32(self.word_weight) * words / np.where(known, total, 1)
        out = self._gain(share, seen, q, self._base[ids], starts)
        out[:, ~known] = 0
        return out


def count_classes(places: Places, ids: np.ndarray, before: np.ndarray, pair: np.ndarray, starts: np.ndarray, p: np.ndarray, least: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (places x classes) for ``p``, sentences x classes; shares under ``least`` of a sentence are left out."""
    k = p.shape[1]
    s, c = np.nonzero(p > least)
    length = np.diff(np.append(starts, len(ids)))[s]
    first = np.repeat(starts[s] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    at = first + np.arange(int(length.sum()))
    column, weight = np.repeat(c, length), np.repeat(p[s, c], length)
    count = lambda x, size: np.bincount(x * k + column, weights=weight, minlength=size * k).reshape(size, k).astype(np.float32)
    return count(ids[at], places.n_words), count(before[at], places.n_words), count(pair[at], places.n_pairs)


def posteriors(gain: np.ndarray, doc: np.ndarray, n_docs: int, n_subjects: int, sharpness: float = 0.7, lean: np.ndarray | None = None, prior: float = 0.3, none: float = 0.3, rounds: int = 2) -> np.ndarray:
    """Class of each sentence given its gain and the document's own mix of subjects. ``sharpness`` tempers that words aren't independent,
    ``lean`` is a log weight of each class.

    The document only says which subject, not whether there is one: "no subject" keeps the share ``none`` beforehand.
    """
    z = sharpness * gain if lean is None else sharpness * gain + lean
    subject = np.arange(gain.shape[1]) != n_subjects
    log_prior = np.zeros((n_docs, gain.shape[1]))
    for r in range(rounds + 1):
        p = z + log_prior[doc]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        if r < rounds:
            mix = np.full((n_docs, gain.shape[1]), prior)
            np.add.at(mix, doc, p)
            mix[:, subject] *= (1 - none) / mix[:, subject].sum(axis=1, keepdims=True)
            mix[:, n_subjects] = none
            log_prior = np.log(mix)
    return p


# ---- examples ----------------------------------------------------------------------------------------------------------------


@dataclass
class Examples:
    """Sentences of the labelled examples, with the example and the class of each example."""

    words: list[str]
    starts: np.ndarray
    of: np.ndarray  # example of each sentence
    label: np.ndarray  # class of each example
    lang: np.ndarray  # language of each example

    @staticmethod
    def read(rows: list[tuple[int, str, str]]) -> Examples:
        """Rows are (class, text, language)."""
        words, starts, of, label, lang = [], [], [], [], []
        for k, text, spoken in rows:
            found = sentences(text)
            if not found:
                continue
            for s in found:
                starts.append(len(words))
                of.append(len(label))
                words += [word_id(w) for w in s]
            label.append(k)
            lang.append(spoken)
        return Examples(words, np.array(starts, dtype=np.int64), np.array(of, dtype=np.int64), np.array(label, dtype=np.int64), np.unique(np.array(lang, dtype=str), return_inverse=True)[1])

    def place(self, places: Places) -> None:
        self.places = places
        self.ids = places.ids(pa.array(self.words, pa.string()))
        self.before = _previous(self.ids, self.starts)
        if places.pairs is not None:
            self.pair = places.pair(self.before, self.ids)

    def counts(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts with ``weights``, examples x classes."""
        return count_classes(self.places, self.ids, self.before, self.pair, self.starts, weights[self.of])

    def languages(self) -> np.ndarray:
        """Log share of each word in each language of the examples."""
        length = np.diff(np.append(self.starts, len(self.ids)))
        of_word = np.repeat(self.lang[self.of], length)
        n = np.stack([np.bincount(self.ids[of_word == k], minlength=self.places.n_words) for k in range(self.lang.max() + 1)]) + 0.05
        return np.log(n / n.sum(axis=1, keepdims=True))

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of one example, those before them, their pairs, and where its sentences start."""
        mine = np.flatnonzero(self.of == i)
        lo = self.starts[mine[0]]
        hi = self.starts[mine[-1] + 1] if mine[-1] + 1 < len(self.starts) else len(self.ids)
        return self.ids[lo:hi], self.before[lo:hi], self.pair[lo:hi], self.starts[mine] - lo


def checked_labels(ex: Examples, n_subjects: int, background: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Weights, examples x classes, and the open cases.

    An example keeps its label unless models of all other examples say otherwise. If they say so still when any one example of that
    other subject is left out, the example moves there. If their word hangs on one example, the two contradict each other: such
    examples form an open case, a class of its own after "no subject", with the subjects it may belong to.
    """
    given = np.zeros((len(ex.label), n_subjects + 1))
    given[np.arange(len(ex.label)), ex.label] = 1
    out = given.copy()
    models = Models(*ex.counts(given), background, ex.places)
    words = [set(ex.part(i)[0].tolist()) for i in range(len(ex.label))]
    best_of = lambda i, left_out: int(models.gain_without(ex, given, i, left_out).sum(axis=0)[:n_subjects].argmax())
    case = np.arange(len(ex.label))  # union-find by relabelling: the examples are few
    contradicted = np.zeros(len(ex.label), dtype=bool)
    for i in range(len(ex.label)):
        best = best_of(i, [i])
        if best == int(ex.label[i]):
            continue
        # An example that shares no word with this one only dilutes its subject: without it the subject gains, so it decides nothing.
        hangs_on = [j for j in np.flatnonzero(ex.label == best).tolist() if j != i and words[i] & words[j] and best_of(i, [i, j]) != best]
        if not hangs_on:
            out[i] = 0
            out[i, best] = 1
        for j in hangs_on:
            case[case == case[j]] = case[i]
            contradicted[[i, j]] = True
    cases = []
    for c in np.unique(case[contradicted]):
        mine = np.flatnonzero((case == c) & contradicted)
        out = np.concatenate([out, np.zeros((len(out), 1))], axis=1)
        out[mine] = 0
        out[mine, -1] = 1
        cases.append(tuple(int(k) for k in np.unique(ex.label[mine])))
    return out, cases


def settled(ex: Examples, weights: np.ndarray, cases: list[tuple[int, ...]], docs: np.ndarray, both: np.ndarray, n_subjects: int) -> np.ndarray:
    """Weights without open cases: each goes to that of its subjects which documents in several languages put beside it.

    ``docs[k, l]`` is the number of documents with class k in language l, ``both[k, l, j]`` of those that also have subject j in
    another language. A case is compared with the settled subjects of its language: how much more often does j stand beside it?
    """
    out = weights[:, : n_subjects + 1].copy()
    in_doubt = {k for options in cases for k in options}
    for g, options in enumerate(cases):
        mine = np.flatnonzero(weights[:, n_subjects + 1 + g] > 0)
        lang = int(np.bincount(ex.lang[mine]).argmax())
        rate = (both[:, lang, :] + 0.5) / (docs[:, lang][:, None] + 50)
        lift = []
        for k in options:
            peers = [y for y in range(n_subjects) if y != k and y not in in_doubt] or [y for y in range(n_subjects) if y != k]
            lift.append(rate[n_subjects + 1 + g, k] / np.mean(rate[peers, k]))
        out[mine, options[int(np.argmax(lift))]] = 1
    return out


#: Log weights a subject may be given at acceptance, and how many held-out examples one unit of it must win.
LEANS, LEAN_COST = (-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0), 1.5


def calibrated(models: Models, ex: Examples, weights: np.ndarray, example_weight: float, rounds: int = 3) -> Models:
    """The models with a lean of each subject at acceptance, under which most held-out examples come out as their own subject.

    Each example is judged by the models without its own counts, its sentences sharing its vote. Leans are tried one subject at a time;
    one that wins fewer examples than ``LEAN_COST`` times its size is not worth it, so subjects that the examples tell apart as they are
    keep 0. "No subject" has no examples and no lean.
    """
    n = weights.shape[1] - 1
    label = weights[:, :n].argmax(axis=1)
    mine = np.flatnonzero(weights[:, :n].sum(axis=1) > 0)
    if len(mine) < 2 or n < 2:
        return models
    gains = [models.gain_without(ex, example_weight * weights, i, [i])[:, :n] for i in mine.tolist()]
    length = np.array([len(g) for g in gains])
    z, of, share = models.sharpness * np.concatenate(gains).astype(float), np.repeat(label[mine], length), np.repeat(1 / length, length)
    lean = np.zeros(n)

    def value(k: int, v: float) -> float:
        tried = lean.copy()
        tried[k] = v
        return share @ ((z + tried).argmax(axis=1) == of) - LEAN_COST * np.abs(tried).sum()

    for _ in range(rounds):
        before = lean.copy()
        for k in range(n):
            lean[k] = max(LEANS, key=lambda v: (round(value(k, v), 9), -abs(v)))
        if (lean == before).all():
            break
    return replace(models, lean=np.append(lean, 0.0))


# ---- corpus ------------------------------------------------------------------------------------------------------------------


def repeated_footers(docs: DataFrame, share: float = 0.02, least: int = 5) -> Footers:
    """Shapes of lines that stand among the last three of at least ``share`` of all documents (so at most 3 / share of them) and aren't
    prose that ends documents by chance: a share of all is needed, counted over all documents and lines of any length."""

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[bytes, str], int] = {}
            for t in batch.column(0).to_pylist():
                for s in {line_shape(x) for x in last_lines(t)}:
                    k = (Footers.digest(s), Footers.head(s))
                    found[k] = found.get(k, 0) + 1
            cols = [pa.array([d for d, _ in found], pa.binary()), pa.array([h for _, h in found], pa.string()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["digest", "head", "n"])

    counted = docs.select("text").mapInArrow(tails, "digest binary, head string, n long").groupBy("digest", "head").agg(F.sum("n").alias("n"))
    total = docs.count()
    return Footers({bytes(r["digest"]): r["head"] for r in counted.where(F.col("n") >= max(least, total * share)).collect()})


def encode_corpus(docs: DataFrame, footers: Footers, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, words, lengths): folded words of all sentences of each document and the length of each sentence."""
    kind = docs.schema[doc_id].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        folded: list[str] = []

        def look_up(word: str) -> int:
            known[word] = i = len(folded)
            folded.append(word_id(word))
            return i

        get = known.get
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
                folded.clear()
            at: list[int] = []
            lengths: list[int] = []
            word_ends, length_ends = [0], [0]
            for t in batch.column(1).to_pylist():
                for s in sentences(t, footers):
                    at += [look_up(w) if (i := get(w)) is None else i for w in s]
                    lengths.append(len(s))
                word_ends.append(len(at))
                length_ends.append(len(lengths))
            words = pa.array(folded, pa.string()).take(pa.array(at, pa.int32()))
            cols = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for e, v in ((word_ends, words), (length_ends, pa.array(lengths, pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[doc_id, "words", "lengths"])

    return docs.select(doc_id, "text").mapInArrow(encode, f"`{doc_id}` {kind.simpleString()}, words array<string>, lengths array<int>")


def _unpack(batch: pa.RecordBatch, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """ids, the word before each, starts of sentences, document of each sentence."""
    ids = places.ids(batch.column("words").flatten())
    lengths = batch.column("lengths").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(ids):
        return None
    per_doc = np.diff(batch.column("lengths").offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return ids, _previous(ids, starts), starts, np.repeat(np.arange(len(per_doc)), per_doc)


def _count_corpus(encoded: DataFrame, model, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts per class over all documents; at most classes x (2 words + pairs) numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        places = model.value.places
        for batch in batches:
            parts = _unpack(batch, places)
            if parts is None:
                continue
            ids, before, starts, doc = parts
            pair = places.pair(before, ids)
            p = posteriors(model.value.gain(ids, before, pair, starts), doc, batch.num_rows, size - 1)
            c = np.concatenate(count_classes(places, ids, before, pair, starts, p))
            total = c if total is None else total + c
        if total is not None:
            at, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(total[at, k].astype(np.float64))], names=["k", "at", "n"])

    rows = encoded.select("words", "lengths").mapInArrow(count, "k int, at long, n double").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    n_words, n_pairs = model.value.places.n_words, model.value.places.n_pairs
    dense = np.zeros((2 * n_words + n_pairs, size), dtype=np.float32)
    dense[rows.column("at").to_numpy(), rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return dense[:n_words], dense[n_words : 2 * n_words], dense[2 * n_words :]


def beside(p: np.ndarray, spoken: np.ndarray, n_lang: int, doc: np.ndarray, n_docs: int, n_subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each class in each language (at least one sentence), and those that have each subject in another language too."""
    size = p.shape[1]
    docs, both = np.zeros((size, n_lang)), np.zeros((size, n_lang, n_subjects))
    for lang in range(n_lang):
        here = spoken == lang
        a, b = np.zeros((n_docs, size)), np.zeros((n_docs, n_subjects))
        np.add.at(a, doc[here], p[here])
        np.add.at(b, doc[~here], p[~here][:, :n_subjects])
        a, b = (a >= 1).astype(float), (b >= 1).astype(float)
        docs[:, lang], both[:, lang, :] = a.sum(axis=0), a.T @ b
    return docs, both


def _beside_in_corpus(encoded: DataFrame, model, n_subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """``beside`` over all documents: classes x languages x (1 + subjects) numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, languages = model.value
            parts = _unpack(batch, models.places)
            if parts is None:
                continue
            ids, before, starts, doc = parts
            spoken = np.stack([np.add.reduceat(lang[ids], starts) for lang in languages], axis=1).argmax(axis=1)
            p = posteriors(models.gain(ids, before, models.places.pair(before, ids), starts), doc, batch.num_rows, n_subjects, rounds=0)
            docs, both = beside(p, spoken, len(languages), doc, batch.num_rows, n_subjects)
            k, lang, j = np.nonzero(np.concatenate([both, docs[:, :, None]], axis=2))
            n = np.concatenate([both, docs[:, :, None]], axis=2)[k, lang, j]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (k, lang, j)] + [pa.array(n)], names=["k", "lang", "j", "n"])

    rows = encoded.select("words", "lengths").mapInArrow(count, "k int, lang int, j int, n double").groupBy("k", "lang", "j").agg(F.sum("n").alias("n")).collect()
    models, languages = model.value
    out = np.zeros((models.n_classes, len(languages), n_subjects + 1))
    for r in rows:
        out[r["k"], r["lang"], r["j"]] = r["n"]
    return out[:, :, -1], out[:, :, :-1]


def words_of(encoded: DataFrame, more: list[str]) -> tuple[Places, np.ndarray]:
    """Rows of the words of the corpus and of ``more``, and the share of each among all words of the corpus, smoothed; one row a distinct
    word reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(batch.column("words").flatten())
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["w", "n"])

    rows = encoded.select("words").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    n = dict.fromkeys(more, 0) | dict(zip(rows.column("w").to_pylist(), rows.column("n").to_pylist()))
    listed = sorted(n)
    share = np.array([0, *[n[w] for w in listed], 0]) + 0.5
    return Places(pa.array(listed, pa.string())), share / share.sum()


def pairs_of(encoded: DataFrame, places: Places, more: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of the corpus and of ``more``, ascending; one a distinct pair reaches the driver."""
    sent = encoded.sparkSession.sparkContext.broadcast(places)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _unpack(batch, sent.value)
            if parts is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(sent.value.numbers(parts[1], parts[0])))], names=["pair"])

    rows = encoded.select("words", "lengths").mapInArrow(find, "pair long").distinct().toArrow()
    sent.unpersist()
    return np.union1d(rows.column("pair").to_numpy(), more)


def subjects_of(listed: DataFrame) -> list[int]:
    """The subject ids of a list, in order."""
    found = listed.where("subject_id is not null").select("subject_id").distinct().limit(MAX_SUBJECTS + 1).collect()
    if len(found) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    return sorted(r["subject_id"] for r in found)


def train(encoded: DataFrame, examples: DataFrame, subjects: list[int], rounds: int = 2, example_weight: float = 5.0) -> Models:
    """Models of the subjects (in order) and of no subject, from the examples and ``rounds`` passes over all documents."""
    rows = examples.where("text is not null and subject_id is not null").select("subject_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).distinct().limit(MAX_EXAMPLES + 1).collect()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} examples")
    place = {s: i for i, s in enumerate(subjects)}
    ex = Examples.read(sorted((place[r["subject_id"]], r["text"], r["lang"]) for r in rows if r["subject_id"] in place))
    n = len(subjects)
    if len(ex.label) == 0:
        places = Places(pa.array([], pa.string()), np.array([], dtype=np.int64))
        zero = [np.zeros((s, n + 1), dtype=np.float32) for s in (places.n_words, places.n_words, places.n_pairs)]
        return Models(*zero, np.full(places.n_words, 1 / places.n_words), places)
    places, background = words_of(encoded, ex.words)
    ex.place(places)
    places.pairs = pairs_of(encoded, places, places.numbers(ex.before, ex.ids))
    ex.place(places)
    spark = encoded.sparkSession
    weights, cases = checked_labels(ex, n, background)
    if cases:
        sent = spark.sparkContext.broadcast((Models(*[example_weight * c for c in ex.counts(weights)], background, places), ex.languages()))
        weights = settled(ex, weights, cases, *_beside_in_corpus(encoded, sent, n), n)
        sent.unpersist()
    if (need := 4 * (n + 1) * (2 * places.n_words + places.n_pairs)) > MAX_MODEL_BYTES:
        raise ValueError(f"the models take {need} bytes; at most {MAX_MODEL_BYTES} are sent to each worker")
    seed = [example_weight * c for c in ex.counts(weights)]
    models = Models(*seed, background, places)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(models)
        found = _count_corpus(encoded, sent, n + 1)
        sent.unpersist()
        models = Models(*[a + b for a, b in zip(seed, found)], background, places)
    return calibrated(models, ex, weights, example_weight)


def assign_subjects(encoded: DataFrame, models: Models, subjects: list[int], doc_id: str = "doc_id", least: float = 0.25) -> DataFrame:
    """(doc_id, subject_id, n_sentences, n_about, share): subjects that at least ``least`` of a document's sentences are about.

    Documents without sentences, and those about nothing in particular, have no row.
    """
    kind = encoded.schema[doc_id].dataType.simpleString()
    sent = encoded.sparkSession.sparkContext.broadcast(models)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _unpack(batch, sent.value.places)
            if parts is None or not sent.value.words.any():  # without any example nothing is about anything
                continue
            ids, before, starts, doc = parts
            p = posteriors(sent.value.gain(ids, before, sent.value.places.pair(before, ids), starts), doc, batch.num_rows, len(subjects), sent.value.sharpness, sent.value.lean)
            about = np.zeros((batch.num_rows, p.shape[1]), dtype=np.int64)
            np.add.at(about, (doc, p.argmax(axis=1)), 1)
            all_ = about.sum(axis=1)
            d, k = np.nonzero((about[:, :-1] >= least * all_[:, None] - 1e-9) & (about[:, :-1] > 0))
            cols = [batch.column(0).take(pa.array(d)), pa.array(np.array(subjects, dtype=np.int32)[k]), pa.array(all_[d]), pa.array(about[d, k]), pa.array(about[d, k] / all_[d])]
            yield pa.RecordBatch.from_arrays(cols, names=[doc_id, "subject_id", "n_sentences", "n_about", "share"])

    return encoded.select(doc_id, "words", "lengths").mapInArrow(assign, f"`{doc_id}` {kind}, subject_id int, n_sentences long, n_about long, share double")
