"""Subject areas of documents by interpolated n-gram language models (problem 9).

Every subject has a language model over letters, and so has what is not about it (its background).
Both interpolate the orders from 1 to ``ORDER``: each order's estimate is drawn to that of the next
lower one, and a subject's highest order to the background's.  A sentence is about a subject if its
cross-entropy under the subject's model is lower than under the background by enough; a document
treats each subject that enough of its sentences are about, and so may treat several or none.

Models run over letters alone: case, digits, marks, soft hyphens and spaces are left out, so a text
that lost its spaces or was garbled by marks reads like a clean one, in any script.

Labels say which subjects a document has but not where, so the models are fitted by
expectation-maximisation: sentences of labelled documents belong to one of the document's subjects
or to none of them, at first evenly.  The acceptance thresholds are calibrated, subject by subject,
on labelled documents that the models were not fitted on.  Fitting sees a bounded sample of the
labelled documents (``Settings.train_docs``); the fitted table is then applied to every text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 6
LOWEST = 3
#: A sentence ends at its mark, unless a digit or a further mark follows, or at a line's end.
_END = re.compile(r"[.!?…。！？][\"'”»)\]]*(?=[^\d.!?…。！？\"'”»)\]]|$)")
_SEED = np.uint64(0x9E3779B97F4A7C15)
PAD = 1  # stands before a sentence's first letter


def letter_table() -> np.ndarray:
    """Whether a code point is a letter; worked out once and shipped with a model."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Settings:
    """``train_docs`` bounds the labelled documents that fitting sees; ``sentences`` is how many of a
    document's sentences must be about a subject.  ``pull`` and ``subject_pull`` are the weights, in
    counts, of what an estimate is drawn to; ``nothing`` is the log ratio at which a training sentence
    is as likely about nothing."""

    train_docs: int = 3_000
    sentences: int = 3
    rounds: int = 5
    pull: tuple[float, ...] = (0.0, 5.0, 4.0, 3.0, 2.0, 2.0, 2.0)
    subject_pull: float = 8.0
    least_count: float = 2.0
    nothing: float = 0.7
    first_nothing: float = 0.1


def encoded(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all sentences of some texts as code points, each sentence after ORDER - 1 pads;
    the sentence of each position, and each sentence's text.  Sentences without a letter are left out."""
    # A sentence's end becomes a line's end; lines are then told apart as arrays.
    marked = [_END.sub("\n", unicodedata.normalize("NFKD", t).casefold()) + "\n" for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.cumsum((codes == 10) | (codes == 13))
    at = np.flatnonzero(letters[codes])
    if not len(at):
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.r_[True, np.diff(line[at]) != 0]
    of = np.cumsum(fresh) - 1
    doc = np.searchsorted(np.cumsum([len(m) for m in marked]), at[fresh], side="right")
    out = np.full(len(at) + (ORDER - 1) * len(doc), PAD, np.uint32)
    out[np.arange(len(at)) + (ORDER - 1) * (of + 1)] = codes[at]
    return out, np.repeat(np.arange(len(doc)), np.bincount(of) + ORDER - 1), doc


def sentences(text: str) -> list[str]:
    """The letters of each sentence of a text, those without a letter left out."""
    codes, of, doc = encoded([text], letter_table())
    return ["".join(map(chr, codes[(of == i) & (codes != PAD)])) for i in range(len(doc))]


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each character, for n from 1 to ORDER (index 0 is unused)."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _SEED
    mixed ^= mixed >> np.uint64(29)
    out = [np.empty(0, np.uint64), mixed]
    for n in range(2, ORDER + 1):
        last = out[-1]
        h = np.empty_like(last)
        h[0] = last[0]
        # The n-gram is the (n-1)-gram one before, times a constant, plus this character.
        h[1:] = last[:-1] * np.uint64(0xD6E8FEB86659FD93) + mixed[1:]
        h[:1] = mixed[:1]
        out.append(h)
    return out


@dataclass
class SubjectModel:
    """What applying needs: per n-gram hash the log ratio of subject to background, and thresholds."""

    subjects: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    ratios: dict[int, np.ndarray] = field(default_factory=dict)
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    letters: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def scores(self, codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence (see :func:`encoded`) the total log ratio by subject, and its letters."""
        letter = codes != PAD
        hashed = grams(codes)
        n = len(codes)
        value = np.zeros((n, len(self.subjects)), np.float32)
        open_ = np.flatnonzero(letter)
        for order in range(ORDER, LOWEST - 1, -1):
            keys = self.keys[order]
            if not len(open_) or not len(keys):
                continue
            h = hashed[order][open_]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            value[open_[hit]] = self.ratios[order][at[hit]]
            open_ = open_[~hit]
        first = np.flatnonzero(np.r_[True, np.diff(of) != 0]) if n else np.empty(0, np.int64)
        return np.add.reduceat(value, first, axis=0) if n else value, np.bincount(of[letter], minlength=len(first))


def decide(total: np.ndarray, letters: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The subject of each sentence, -1 for none: the one of the largest drop in cross-entropy, if the
    drop reaches the subject's threshold (nats in all, spread over the sentence's letters)."""
    if not total.size:
        return np.full(len(total), -1, np.int64)
    per_letter = total / np.maximum(letters, 1)[:, None]
    best = per_letter.argmax(axis=1)
    line = np.arange(len(total))
    enough = per_letter[line, best] * np.maximum(letters, 1) >= threshold[best]
    return np.where(enough, best, -1)


class _Counts:
    """N-grams of training sentences as arrays over distinct ones: each position's n-gram of the highest
    order, and for each distinct n-gram its suffix and its context among those one letter shorter.
    Counts of lower orders and of contexts follow from those of the highest order."""

    def __init__(self, codes: np.ndarray, of: np.ndarray):
        hashed = grams(codes)
        at = np.flatnonzero(codes != PAD)
        self.sentence = of[at]
        self.key, self.low, self.context, self.contexts = {}, {}, {}, {}
        place = at
        for n in range(ORDER, 0, -1):
            self.key[n], first, ident = np.unique(hashed[n][place], return_index=True, return_inverse=True)
            if n == ORDER:
                self.ident = ident.astype(np.int32)
            else:
                self.low[n + 1] = ident.astype(np.int32)
            place = place[first]  # a position of each distinct n-gram
            if n > 1:
                found, context = np.unique(hashed[n - 1][place - 1], return_inverse=True)
                self.context[n], self.contexts[n] = context.astype(np.int32), len(found)

    def log_models(self, weight: np.ndarray, own: np.ndarray, cfg: Settings) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """For sentence weights by class (sentences, classes; the last is none of them), over the
        positions ``own``: per order the counts of each n-gram and the log ratio of class to its
        background."""
        classes = weight.shape[1]
        sums = lambda at, values, size: np.stack([np.bincount(at, values[:, c], size) for c in range(classes)], 1)
        ident, sentence = self.ident[own], self.sentence[own]
        subject = {ORDER: np.stack([np.bincount(ident, weight[sentence, c], len(self.key[ORDER])) for c in range(classes)], 1)}
        for n in range(ORDER, 1, -1):
            subject[n - 1] = sums(self.low[n], subject[n], len(self.key[n - 1]))
        ratio = {}
        for n in range(1, ORDER + 1):
            mine = subject[n]
            rest = mine.sum(1, keepdims=True) - mine
            if n == 1:
                base = 1.0 / max(1, len(self.key[1]))
                p_rest = (rest + cfg.pull[1] * base) / (rest.sum(0) + cfg.pull[1])
                p_own = (mine + cfg.subject_pull * p_rest) / (mine.sum(0) + cfg.subject_pull)
            else:
                c_own = sums(self.context[n], mine, self.contexts[n])
                c_rest = c_own.sum(1, keepdims=True) - c_own
                ctx, low = self.context[n], self.low[n]
                lower_rest, lower_own = p_rest[low], p_own[low]
                p_rest = (rest + cfg.pull[n] * lower_rest) / (c_rest[ctx] + cfg.pull[n])
                # Drawn both to its own lower order and to the background's estimate.
                drawn = np.sqrt(lower_own / np.maximum(lower_rest, 1e-12)) * p_rest
                p_own = (mine + cfg.subject_pull * np.minimum(drawn, 1.0)) / (c_own[ctx] + cfg.subject_pull)
            ratio[n] = np.log(np.maximum(p_own, 1e-9)) - np.log(np.maximum(p_rest, 1e-9))
        return subject, ratio


def _fit_models(counts: _Counts, doc: np.ndarray, mine: np.ndarray, allowed: np.ndarray, names: list[str], cfg: Settings) -> SubjectModel:
    """EM over the sentences ``mine`` (a mask): ``doc`` is each sentence's document, ``allowed``
    (documents, subjects) its labels."""
    may = np.concatenate([allowed[doc], np.ones((len(doc), 1), bool)], axis=1)
    # What recurs under every subject is filler: to start from, a sentence is none's by half.
    # A document speaks with the root of its length, so that a long one doesn't make a model alone.
    share = mine * 2 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(allowed)), 1))[doc]
    weight = may * np.r_[np.ones(len(names)), cfg.first_nothing]
    weight *= share[:, None] / weight.sum(1, keepdims=True)
    own = np.flatnonzero(mine[counts.sentence])
    ident, sentence = counts.ident[own], counts.sentence[own]
    for turn in range(cfg.rounds + 1):
        count, ratio = counts.log_models(weight, own, cfg)
        if turn == cfg.rounds:
            break
        # Against its own background each class has one likelihood ratio; none of them is at 0.
        total = np.stack([np.bincount(sentence, ratio[ORDER][:, c][ident], len(doc)) for c in range(len(names))], 1)
        score = np.concatenate([total, np.full((len(doc), 1), cfg.nothing - (3.0 if turn < 2 else 0.0))], axis=1)
        score = np.where(may, score, -np.inf)
        score -= score.max(1, keepdims=True)
        weight = np.exp(np.maximum(score / 2, -30.0)) * may
        weight *= share[:, None] / weight.sum(1, keepdims=True)
    model = SubjectModel(names)
    for n in range(LOWEST, ORDER + 1):
        keep = count[n].sum(1) >= cfg.least_count
        model.keys[n] = counts.key[n][keep]
        model.ratios[n] = ratio[n][keep][:, :-1].astype(np.float32)
    model.threshold = np.full(len(names), 3.0)
    return model


def _document_counts(model: SubjectModel, texts: list[str], threshold: np.ndarray) -> np.ndarray:
    """Sentences about each subject, by text."""
    codes, of, doc = encoded(texts, model.letters)
    docs = len(texts)
    if not len(doc):
        return np.zeros((docs, len(model.subjects)), np.int64)
    total, letters = model.scores(codes, of)
    subject = decide(total, letters, threshold)
    out = np.zeros((docs, len(model.subjects)), np.int64)
    ok = subject >= 0
    np.add.at(out, (doc[ok], subject[ok]), 1)
    return out


def fit(texts: list[str], labels: list[set[str]], names: list[str], cfg: Settings | None = None) -> SubjectModel:
    """Models and thresholds from labelled texts.  Thresholds come from two halves, each scored by
    models fitted on the other, and serve the models fitted on both."""
    cfg = cfg or Settings()
    letters_of = letter_table()
    codes, of, doc = encoded(texts, letters_of)
    allowed = np.array([[n in own for n in names] for own in labels], bool).reshape(len(texts), len(names))
    if not len(doc):
        return SubjectModel(names, {n: np.empty(0, np.uint64) for n in range(LOWEST, ORDER + 1)}, {n: np.empty((0, len(names)), np.float32) for n in range(LOWEST, ORDER + 1)}, np.full(len(names), np.inf), letters_of)
    grid = np.arange(1.0, 12.1, 0.5)
    hits = np.zeros((3, len(grid), len(names)))
    counts = _Counts(codes, of)
    # Copies of a text share a half.
    halves = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 for t in texts])
    for half in (0, 1):
        own = halves[doc] == half
        model = _fit_models(counts, doc, own, allowed, names, cfg)
        if own.all():
            continue
        held = ~own[of]
        total, letters = model.scores(codes[held], np.unique(of[held], return_inverse=True)[1])
        seen = np.unique(doc[~own])
        for g, t in enumerate(grid):
            subject = decide(total, letters, np.full(len(names), t))
            out = np.zeros((len(texts), len(names)), np.int64)
            ok = subject >= 0
            np.add.at(out, (doc[~own][ok], subject[ok]), 1)
            said, true = out[seen] >= cfg.sentences, allowed[seen]
            hits[0, g] += (said & true).sum(0)
            hits[1, g] += (said & ~true).sum(0)
            hits[2, g] += (~said & true).sum(0)
    score = 2 * hits[0] / np.maximum(2 * hits[0] + hits[1] + hits[2], 1)
    # Of the thresholds within a small step of the best, the middle one: the peak is flat.
    best = score >= score.max(0) - 0.002
    final = _fit_models(counts, doc, np.ones(len(doc), bool), allowed, names, cfg)
    final.threshold = np.array([np.median(grid[best[:, c]]) for c in range(len(names))])
    final.letters = letters_of
    return final


def training_sample(documents: DataFrame, labels: DataFrame, subjects: DataFrame, cfg: Settings) -> tuple[list[str], list[set[str]], list[str]]:
    """Texts, their sets of subjects and all subjects' names; at most ``cfg.train_docs`` documents,
    chosen by a hash of their id among the labelled ones.  Labels of unknown subjects or documents,
    NULLs and blank texts are left out."""
    names = sorted(r[0] for r in subjects.select("subject").filter("subject is not null").distinct().collect())
    known = labels.select("doc_id", "subject").filter("doc_id is not null").join(F.broadcast(subjects.select("subject").distinct()), "subject")
    sets = known.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    # The ids are chosen before any text is touched: the bounded choice is broadcast, and documents are
    # scanned once and not shuffled.
    chosen = sets.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.train_docs)
    texts = documents.select("doc_id", "text").filter("text is not null and trim(text) <> ''")
    chosen = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("subjects").alias("subjects"))
    rows = sorted(chosen.select("doc_id", "text", "subjects").collect(), key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [set(r["subjects"]) for r in rows], names


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """(doc_id, subject, n_sentences) for every document and each subject that at least
    ``cfg.sentences`` of its sentences are about.  NULL, empty and letterless texts have none; a
    document without a subject has no row; repeated rows of a document repeat its result."""
    cfg = cfg or Settings()
    model = fit(*training_sample(documents, labels, subjects, cfg), cfg)
    # Bounded by the sample: a few dozen MB of n-gram ratios.
    shipped = documents.sparkSession.sparkContext.broadcast((model.subjects, model.keys, model.ratios, model.threshold, model.letters))
    need = cfg.sentences
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SubjectModel(*shipped.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, texts in _pieces(batch.column(1)):
                got = _document_counts(model, texts, model.threshold)
                r, c = np.nonzero(got >= need)
                yield pa.RecordBatch.from_arrays([pa.array([ids[rows[i]] for i in r], pa.int64()), pa.array([model.subjects[i] for i in c], pa.string()), pa.array(got[r, c], pa.int64())], names=["doc_id", "subject", "n_sentences"])

    return _spread(d).mapInArrow(run, "doc_id bigint, subject string, n_sentences bigint")


def _spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def _pieces(texts: pa.Array, letters: int = 300_000) -> Iterator[tuple[list[int], list[str]]]:
    """Whole documents in pieces of about so many letters, which bounds the arrays of a step: row
    numbers and texts."""
    rows: list[int] = []
    size = 0
    every = texts.to_pylist()
    for i, text in enumerate(every):
        if not text:
            continue
        rows.append(i)
        size += len(text)
        if size > letters:
            yield rows, [every[i] for i in rows]
            rows, size = [], 0
    if rows:
        yield rows, [every[i] for i in rows]
