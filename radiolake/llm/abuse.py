"""Abusive, hateful or sexual content, by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash space and lengths of the character n-grams.
BITS, LENGTHS = 20, (2, 3, 4, 5)
#: Share of the documents labelled clean that lie under the threshold when held out; the rest may be wrong labels.
CLEAN = 0.97
#: Characters of a sentence at most, of the windows of a longer one and between their starts; characters scored at once; lowest score from which a text is flagged.
LONGEST, WINDOW, STEP, AT_ONCE, THRESHOLD = 240, 120, 50, 400_000, -2.0
#: Labelled documents the classifier is fitted on at most (the smallest hashes of their ids).
MOST_LABELLED = 4_000

#: Letters of other scripts that look like Latin ones, and signs written for letters. Fixed values.
LOOKALIKES = str.maketrans("абеорсухіјкмнтвгдԁɡııαορεντκιυ", "abeopcyxijkmhtbrdd" + "giiaopevtkiu")
SIGNS = str.maketrans("013457@$!€", "oieastasie")
INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿️]")
ENDS = re.compile(r"(?<=[.!?。！？…])[\s\"'”»)\]]+|(?<=[.!?])(?=[^\W\d_]{3})|[。！？]|[\n\r  ]+|:\s+|[\s=(][\"'“«„‘]|[\"'”»’]\s")
SPACED = re.compile(r"(?<![^\W_])[^\W_]([.\-_*· ])(?:[^\W_]\1){2,}[^\W_](?![^\W_])")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
RULES = re.compile(r"([^\w\s])\1{3,}")
NUMBERS = re.compile(r"\d+")


#: The same ends in ASCII text, each alternative beginning with a character, which lets the search skip ahead; a mark of a sentence's end stays with it.
ASCII_ENDS = re.compile(r"[.!?](?:[\s\"')\]]+|(?=[A-Za-z]{3}))|[\n\r]+|:\s+|[\s=(][\"']|[\"']\s")
#: Kinds of ASCII characters for :func:`_spaced`: 1 letters and digits, 2 and more what may space them.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KINDS[[ord(c) for c in ".-_* "]] = [2, 3, 4, 5, 6]
#: Words kept written plainly, and the longest such word.
KNOWN_WORDS, LONGEST_WORD = 1 << 17, 48


def _word(w: str) -> str:
    """One word, written plainly: look-alikes in words of mixed script, signs between letters, stretching, digits."""
    if w.isascii() and w.isalpha():
        return REPEATED.sub(r"\1", w)
    if any(map(str.isalpha, w)):
        if not w.isascii() and re.search("[a-z]", w) and re.search("[Ͱ-ԯ]", w):
            w = w.translate(LOOKALIKES)
        core = w.strip(".,;:!?\"'()[]{}<>")
        if core and not core.isalpha() and sum(c.isalpha() for c in core) * 2 >= len(core) and "=" not in core and ":" not in core:
            w = w.replace(core, core.translate(SIGNS))
    return NUMBERS.sub("0", RULES.sub(r"\1", REPEATED.sub(r"\1", w)))


class _Words(dict):
    """Plainly written words; most words of a text were met before. Forgotten at ``KNOWN_WORDS``, so memory has a bound."""

    def __missing__(self, w: str) -> str:
        out = _word(w)
        if len(w) <= LONGEST_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[w] = out
        return out


_words = _Words()


def plain(text: str, spaced: bool = True) -> str:
    """A text as it is read: compatibility forms, case, invisible and look-alike characters, spacing and stretching undone. ``spaced``: letters may be spaced out."""
    t = text.lower() if text.isascii() else unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).lower()
    if spaced:
        t = SPACED.sub(lambda m: m[0].replace(m[1], ""), t)
    return " ".join(map(_words.__getitem__, t.split()))


def _spaced(texts: list[str]) -> np.ndarray:
    """Which ASCII texts may hold letters spaced out: four of them with the same sign between, found in all texts at once."""
    b = np.frombuffer("\n".join([*texts, "\n" * 6]).encode(), dtype=np.uint8)
    k = KINDS[b]
    gap, one = k[1:-5], k == 1
    hits = np.flatnonzero((gap > 1) & one[:-6] & one[2:-4] & (k[3:-3] == gap) & one[4:-2] & (k[5:-1] == gap) & one[6:])
    out = np.zeros(len(texts), dtype=bool)
    out[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), hits, side="right")] = True
    return out


def _pieces(text: str) -> list[str]:
    """A text cut at the ends of its sentences."""
    if not text.isascii():
        return ENDS.split(text)
    out, a = [], 0
    for m in ASCII_ENDS.finditer(text):
        i = m.start()
        out.append(text[a : i + (text[i] in ".!?")])
        a = m.end()
    out.append(text[a:])
    return out


def sentences_of(texts: list[str | None]) -> list[list[str]]:
    """The sentences of each text, plainly written; those without a letter say nothing. Very long ones come as overlapping windows."""
    plainly = [i for i, t in enumerate(texts) if t and t.isascii()]
    spaced = np.ones(len(texts), dtype=bool)
    if plainly:
        spaced[plainly] = _spaced([texts[i] for i in plainly])
    out = []
    for t, wide in zip(texts, spaced.tolist()):
        found = []
        for s in _pieces(t) if t else ():
            p = plain(s, wide)
            if any(map(str.isalpha, p)):
                found += [p] if len(p) <= LONGEST else [p[i : i + WINDOW] for i in range(0, len(p) - WINDOW + STEP, STEP)]
        out.append(found)
    return out


def sentences(text: str) -> list[str]:
    return sentences_of([text])[0]


def _hashes(parts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of n-gram with the hash at every position of the parts, which are written one after another with marks around them."""
    joined = "\x02" + "\x03\x02".join(parts) + "\x03"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    added = codes + np.uint64(0x9E3779B9)
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        h = h[: len(codes) - n + 1]
        h *= np.uint64(0x100000001B3)
        h += added[n - 1 :]
        if n in LENGTHS:
            yield n, ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def _starts(parts: list[str]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(p) + 2 for p in parts])])


def _sizes(parts: list[str]) -> np.ndarray:
    """How many n-grams each part has."""
    length = np.array([len(p) + 2 for p in parts])
    return sum(np.maximum(0, length - n + 1) for n in LENGTHS)


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each part, one after another, and where each part begins (with the end)."""
    starts, bounds = _starts(parts), np.concatenate([[0], np.cumsum(_sizes(parts))])
    owner = np.repeat(np.arange(len(parts)), np.diff(starts))
    out, at = np.empty(bounds[-1], dtype=np.int32), bounds[:-1].copy()
    for n, h in _hashes(parts):
        first = owner[: len(h)]
        inside = np.flatnonzero(first == owner[n - 1 :])
        part = first[inside]
        out[at[part] + inside - starts[part]] = h[inside]
        at += np.maximum(0, np.diff(starts) - n + 1)
    return out, bounds


def _added(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values``; an empty one is 0."""
    if len(bounds) < 2:
        return np.zeros(0)
    return np.where(np.diff(bounds) > 0, np.add.reduceat(np.append(values, values.dtype.type(0)), bounds, dtype=np.float64)[:-1], 0.0)


def sums(weights: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the weights of each part, scaled by the root of its length."""
    return _added(weights[index], bounds) / np.sqrt(np.maximum(1, np.diff(bounds)))


def sums_of(weights: np.ndarray, parts: list[str]) -> np.ndarray:
    """The same without holding the features."""
    starts, total = _starts(parts), np.zeros(len(parts))
    for n, h in _hashes(parts):
        stops = starts[1:] - n + 1
        some = np.flatnonzero(stops > starts[:-1])
        if len(some):
            cuts = np.stack([starts[some], stops[some]], axis=1).ravel()
            w = np.append(weights[h], weights.dtype.type(0))  # so that the last cut has a place
            total[some] += np.add.reduceat(w, cuts, dtype=np.float64)[::2]
    return total / np.sqrt(np.maximum(1, _sizes(parts)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float

    def score(self, text: str | None) -> float:
        parts = sentences(text) if text else []
        return float(self.scores(parts).max()) if parts else float("-inf")

    def scores(self, parts: list[str]) -> np.ndarray:
        """Log odds of each part, some characters at a time, so that memory doesn't follow the texts' lengths."""
        out, a, held = [], 0, 0
        for i, p in enumerate(parts, 1):
            held += len(p)
            if held > AT_ONCE or i == len(parts):
                out.append(sums_of(self.weights, parts[a:i]) + self.bias)
                a, held = i, 0
        return np.concatenate(out) if out else np.empty(0)


def _descend(index: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, penalty: float, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features by adaptive gradient steps; the weights come back unscaled."""
    used, lengths = np.flatnonzero(np.bincount(index, minlength=1 << BITS)), np.diff(bounds)
    place = np.zeros(1 << BITS, dtype=np.int32)
    place[used] = np.arange(len(used))
    at = place[index]
    scale, r = 1 / np.sqrt(np.maximum(1, lengths)), ratio[used]
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = _added((w * r)[at], bounds) * scale + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        gw = np.bincount(at, weights=np.repeat(g * scale, lengths), minlength=len(used)) * r + penalty * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.07 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= 0.07 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    out = np.zeros(1 << BITS)
    out[used] = w * r
    return out, float(b)


def _ratio(index: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes log-count ratio of each feature."""
    p = np.bincount(index, weights=np.repeat(y * weight, np.diff(bounds)), minlength=1 << BITS) + smooth
    q = np.bincount(index, weights=np.repeat((1 - y) * weight, np.diff(bounds)), minlength=1 << BITS) + smooth
    return np.log((p / p.sum()) / (q / q.sum()))


class _Bags:
    """Documents as lists of distinct sentences, each sentence's features held once."""

    def __init__(self, parts: list[list[str]]):
        known: dict[str, int] = {}
        self.of = [np.array(sorted({known.setdefault(s, len(known)) for s in p}), dtype=np.int64) for p in parts]
        self.index, self.bounds = features(list(known)) if known else (np.empty(0, np.int32), np.zeros(1, np.int64))
        self.distinct = [np.unique(self.take(d)[0]) for d in self.of]  # features of each document

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = self.bounds
        return np.concatenate([self.index[b[i] : b[i + 1]] for i in which]), np.concatenate([[0], np.cumsum(b[which + 1] - b[which])])

    def fit(self, docs: np.ndarray, y: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
        """The classifier of sentences from the documents ``docs`` and their labels."""
        one = np.ones(len(docs))
        whole = [self.distinct[d] for d in docs]
        weights, bias = _ratio(np.concatenate(whole), np.concatenate([[0], np.cumsum([len(x) for x in whole])]), y, one), 0.0
        clean, times = np.unique(np.concatenate([self.of[d] for d in docs[y == 0]]), return_counts=True)
        for _ in range(rounds):
            s = sums(weights, self.index, self.bounds) + bias
            top, often = np.unique([self.of[d][np.argmax(s[self.of[d]])] for d in docs[y == 1]], return_counts=True)
            index, bounds = self.take(np.concatenate([top, clean]))
            target = np.concatenate([np.ones(len(top)), np.zeros(len(clean))])
            weight = np.concatenate([often, times]).astype(float)
            weights, bias = _descend(index, bounds, target, weight, _ratio(index, bounds, target, weight), penalty)
        return weights, bias

    def scores(self, weights: np.ndarray, bias: float, docs: np.ndarray) -> np.ndarray:
        s = sums(weights, self.index, self.bounds) + bias
        return np.array([s[self.of[d]].max() for d in docs])


class _Sample:
    """Labelled documents made ready: those with sentences, their labels, the folds they belong to and their features."""

    def __init__(self, texts: list[str], labels: np.ndarray, folds: int):
        parts = sentences_of(texts)
        keep = [i for i, p in enumerate(parts) if p]
        self.y = np.array([labels[i] > 0.5 for i in keep], dtype=float)
        self.usable = bool(len(keep)) and self.y.min() != self.y.max()
        self.crossed = self.usable and min(self.y.sum(), (1 - self.y).sum()) >= 2 * folds
        self.docs, rank = np.arange(len(keep)), np.empty(len(keep), dtype=np.int64)
        for kind in (0, 1):
            rank[self.y == kind] = np.arange(int((self.y == kind).sum()))
        self.fold, self.bags = rank % folds, _Bags([parts[i] for i in keep]) if self.usable else None

    def held_out(self, k: int, rounds: int, penalty: float) -> np.ndarray:
        """Scores of fold ``k`` by a classifier of the others."""
        other = self.docs[self.fold != k]
        return self.bags.scores(*self.bags.fit(other, self.y[other], rounds, penalty), self.docs[self.fold == k])


def fit(
    texts: list[str], labels: np.ndarray, rounds: int = 3, penalty: float = 0.02, folds: int = 3, doubt: tuple[float, float] = (-1.0, 1.0), held_out: Callable[[int, int, float], list[np.ndarray]] | None = None
) -> Model:
    """Fits on texts and the share of raters that found each abusive.

    A label holds for a document, abuse for a sentence of it. So sentences are classified: those of clean documents are clean; of an abusive
    document the sentence that scores highest is the abusive one, found anew in each round (first by the log-count ratios of documents),
    the rest of the document is left out. Raters err: each fold is scored by a classifier of the others, and documents labelled
    abusive that score below ``doubt[0]`` or clean above ``doubt[1]`` are left out of the last fit. The same held-out scores give the threshold:
    ``CLEAN`` of the clean documents lie below it, so few labels make it careful. Without labels of both kinds nothing is flagged.
    ``held_out`` gives the scores of all folds where they are computed elsewhere (:func:`train`).
    """
    sample = _Sample(texts, labels, folds)
    y, docs, bags = sample.y, sample.docs, sample.bags
    if not sample.usable:
        return Model(np.zeros(1 << BITS, dtype=np.float32), -1.0, 0.0)
    trusted, threshold = np.ones(len(docs), dtype=bool), THRESHOLD
    if sample.crossed:
        held = np.empty(len(docs))
        each = held_out(folds, rounds, penalty) if held_out else [sample.held_out(k, rounds, penalty) for k in range(folds)]
        for k, scores in enumerate(each):
            held[sample.fold == k] = scores
        trusted = np.where(y == 1, held >= doubt[0], held <= doubt[1])
        threshold = max(THRESHOLD, float(np.quantile(held[y == 0], CLEAN)))
        if len(np.unique(y[trusted])) < 2:
            trusted[:] = True
    weights, bias = bags.fit(docs[trusted], y[trusted], rounds, penalty)
    return Model(weights.astype(np.float32), bias, threshold)


def labelled(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``text, share``: labelled documents and the share of raters that found them abusive; documents on which raters tie are left out.

    The documents are chosen from the votes and the ids alone, so that only their texts, at most ``most``, are joined with the votes.
    """
    votes = labels.filter("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("share")).filter("share <> 0.5")
    texts = documents.select("doc_id", "text").filter("text is not null")
    chosen = votes.join(texts.select("doc_id"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "share")  # at most ``most`` rows


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The classifier of the labelled documents, at most ``most``; the folds that find wrong labels are fitted by one task each."""
    spark = documents.sparkSession
    rows = labelled(documents, labels, most).toPandas()
    texts, shares = rows["text"].tolist(), rows["share"].to_numpy(dtype=float)
    given = spark.sparkContext.broadcast((texts, shares))  # at most ``most`` texts

    def held_out(folds: int, rounds: int, penalty: float) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    s = _Sample(*given.value, folds).held_out(k, rounds, penalty)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64()))], names=["k", "scores"])

        got = spark.range(0, folds, 1, folds).mapInArrow(run, "k long, scores array<double>").collect()
        return [np.array(r["scores"]) for r in sorted(got, key=lambda r: r["k"])]

    return fit(texts, shares, held_out=held_out)


def score(spark: SparkSession, documents: DataFrame, model: Model, ident: str = "doc_id", text: str = "text", rows_at_once: int = 512) -> DataFrame:
    """``documents`` without the text, with ``score`` (log odds of the document's worst sentence, null without text) and ``abusive``.

    One pass, no shuffle; the weights are 4 MB whatever the corpus. Whole texts are read, sentence by sentence.
    Defined results: null, empty and blank texts have a null score and are not abusive; repeated rows are scored alike.
    """
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in documents.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(a, rows_at_once)
                parts = sentences_of(b.column(len(rest)).to_pylist())
                n = np.array([len(p) for p in parts])
                out = np.full(len(parts), np.nan)
                if n.sum():
                    s = m.scores([x for p in parts for x in p])
                    out[n > 0] = np.maximum.reduceat(s, (np.cumsum(n) - n)[n > 0])
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(rest))], pa.array(out, pa.float64(), mask=n == 0), pa.array(np.nan_to_num(out, nan=-np.inf) > m.threshold)], names=[*rest, "score", "abusive"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    return documents.select(*[documents[c] for c in rest], documents[text]).mapInArrow(run, f"{kinds}, score double, abusive boolean")
