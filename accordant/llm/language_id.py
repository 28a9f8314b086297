"""Language identification of mixed texts.

A word is a run of letters (with their marks). Its script narrows the
languages that it may be of, its score under each of these is the sum of the
log probabilities of its letter n-grams, and a Viterbi path over a text's
words, with a penalty for each switch, labels spans. A text's language is that
of most of its letters.

The model is naive Bayes over n-grams hashed to ``BUCKETS``, so its size is
languages times buckets whatever it learns from. It learns from at most about
``TRAIN_DOCUMENTS`` documents of each language, those with the lowest hashes of
their ids; that bound is a parameter. Scoring works on numpy arrays of all
letters of a group of texts at once, and the path steps through the words of
all texts of a group together.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import bound_batches, slices, table

BUCKETS = 1 << 16
TRAIN_DOCUMENTS = 2_000
#: More languages than this mean that the column isn't a language.
MOST_LANGUAGES = 500
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
#: Letters of a group of texts that are scored at once; a longer text is scored in slices of about so many.
GROUP_CHARS = 1 << 18
#: Characters in which a slice's end is looked for at a blank, before any other character that is no letter will do.
BLANK_WITHIN = 1 << 10
UNKNOWN = "und"
#: The pipeline's stage rejects texts of which the predicted language has a smaller share of the letters.
LEAST_SHARE = 0.5

#: Scripts by ranges of code points (fixed values); other letters are of script 0.
SCRIPTS = {
    1: ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF)),
    2: ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    3: ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    4: ((0x530, 0x58F),),
    5: ((0x590, 0x5FF),),
    6: ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    7: ((0x900, 0x97F),),
    8: ((0x980, 0x9FF),),
    9: ((0xA00, 0xDFF),),
    10: ((0xE00, 0xE7F),),
    11: ((0x10A0, 0x10FF),),
    12: ((0x3040, 0x30FF),),
    13: ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)),
    14: ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
N_SCRIPTS = 15
BLANK = re.compile(r"\s")


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 2 for letters, 1 for marks, else 0; and the script."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))[0]
        if category in "LM":
            kind[c] = 2 if category == "L" else 1
    script = np.zeros(0x110000, np.uint8)
    for number, ranges in SCRIPTS.items():
        for low, high in ranges:
            script[low : high + 1] = number
    return kind, script


@dataclass
class Words:
    """All words of some texts, one after another."""

    grams: np.ndarray  # hashed n-grams of all words
    gram_starts: np.ndarray  # of each word
    lengths: np.ndarray  # letters of each word
    scripts: np.ndarray
    starts: np.ndarray  # place in the text's lower-case form
    ends: np.ndarray
    per_text: np.ndarray  # words of each text


def words_of(texts: list[str | None]) -> Words:
    kind, script = tables()
    # A gap that is no letter stands before, between and after texts.
    lowered = [(x or "").lower() for x in texts]
    codes = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    text_at = 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    inside = kind[codes] > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    has_letter = np.add.reduceat(kind[codes] == 2, np.stack((starts, ends), 1).ravel())[::2] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[has_letter], ends[has_letter]
    per_text = np.searchsorted(starts, text_at + sizes) - np.searchsorted(starts, text_at)
    owner = np.repeat(np.arange(len(texts)), per_text)
    lengths = ends - starts
    # Letters with a mark before and after each word; n-grams of 1 to 4 of them, hashed by a product (Knuth's constant).
    padded_at = np.concatenate(([0], np.cumsum(lengths + 2)))
    letters = np.full(padded_at[-1], 32, np.uint64)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters[np.repeat(padded_at[:-1] + 1, lengths) + within] = codes[np.repeat(starts, lengths) + within]
    word = np.repeat(np.arange(len(lengths)), lengths + 2)
    grams, of = [], []
    h = np.zeros(len(letters), np.uint64)
    for n in range(1, 5):
        h = h[: len(letters) - n + 1] * np.uint64(0x100000001B3) + letters[n - 1 :]
        same = word[: len(h)] == word[n - 1 :]
        if n > 1:
            grams.append(((h[same] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(48)).astype(np.int32))
            of.append(word[: len(h)][same])
    all_of = np.concatenate(of)
    order = np.argsort(all_of, kind="stable")
    counts = np.bincount(all_of, minlength=len(lengths))
    base = text_at[owner] if len(owner) else np.zeros(0, np.int64)
    return Words(np.concatenate(grams)[order], np.cumsum(counts) - counts, lengths, script[codes[starts]] if len(starts) else np.zeros(0, np.uint8), starts - base, ends - base, per_text)


def grouped(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[list[int]]:
    """Indexes of texts in groups of about ``limit`` characters, like lengths together."""
    group, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i] or "")):
        n = len(texts[i] or "")
        if group and size + n > limit:
            yield group
            group, size = [], 0
        group.append(i)
        size += n
    if group:
        yield group


def text_slices(text: str, limit: int = GROUP_CHARS) -> Iterator[str]:
    """A text cut between words into pieces of about ``limit`` characters; only a word as long makes a longer piece."""
    kind, _ = tables()
    at = 0
    while at < len(text):
        stop = at + limit
        blank = BLANK.search(text, stop, stop + BLANK_WITHIN)
        if blank:
            stop = blank.start()
        while stop < len(text) and kind[ord(text[stop])]:
            stop += 1
        yield text[at:stop]
        at = stop


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets, languages) log probabilities
    candidates: np.ndarray  # (scripts, languages) which languages use a script

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.lengths):
            return np.zeros((0, len(self.languages)))
        scores = np.add.reduceat(self.weights[words.grams], words.gram_starts, axis=0).astype(np.float64)
        allowed = self.candidates[words.scripts]
        return np.where(allowed | ~allowed.any(1, keepdims=True), scores, -np.inf)

    def labels(self, words: Words, penalty: float = SWITCH_PENALTY) -> np.ndarray:
        """The language of each word on the best path of its text."""
        scores, counts = self.word_scores(words), words.per_text
        # Texts by falling length: at each step those that still have words come first.
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        steps = int(counts[0]) if len(counts) else 0
        active = np.searchsorted(-counts, -np.arange(steps), side="left")
        value = np.zeros((len(counts), len(self.languages)))
        best_before, switched = [], []
        for t in range(steps):
            n = active[t]
            v = value[:n]
            before = v.argmax(1)
            change = v[np.arange(n), before][:, None] - penalty
            best_before.append(before)
            switched.append(v < change)
            value[:n] = np.maximum(v, change) + scores[first[:n] + t]
        out = np.zeros(len(scores), np.int32)
        state = value.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            s = state[:n]
            out[first[:n] + t] = s
            state[:n] = np.where(switched[t][np.arange(n), s], best_before[t], s)
        return out

    def long_labels(self, text: str, penalty: float = SWITCH_PENALTY, limit: int = GROUP_CHARS) -> tuple[np.ndarray, np.ndarray]:
        """The language and the letters of each word of one text, as ``labels`` gives them.

        Slices are scored one after another; of a word only its length and the
        way back through it are kept, a few bytes.
        """
        value = np.zeros(len(self.languages))
        lengths, best_before, switched = [], [], []
        for piece in text_slices(text, limit):
            words = words_of([piece])
            scores = self.word_scores(words)
            before, changes = np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)
            for t, own in enumerate(scores):
                before[t] = b = value.argmax()
                change = value[b] - penalty
                changes[t] = value < change
                value = np.maximum(value, change) + own
            lengths.append(words.lengths.astype(np.int32))
            best_before.append(before)
            switched.append(changes)
        before, changes = np.concatenate(best_before), np.concatenate(switched)
        out, state = np.zeros(len(before), np.int16), value.argmax()
        for t in range(len(before) - 1, -1, -1):
            out[t] = state
            if changes[t, state]:
                state = before[t]
        return out, np.concatenate(lengths)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its share of the letters; UNKNOWN and 0 without letters. Ties go to the first language by name."""
        languages, shares = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return languages, shares
        n = len(self.languages)
        for group in grouped(texts):
            if len(group) == 1 and len(texts[group[0]] or "") > GROUP_CHARS:
                of, lengths = self.long_labels(texts[group[0]])
            else:
                words = words_of([texts[i] for i in group])
                of, lengths = np.repeat(np.arange(len(group)), words.per_text) * n + self.labels(words), words.lengths
            letters = np.bincount(of, lengths, len(group) * n).reshape(-1, n)
            total, best = letters.sum(1), letters.argmax(1)
            for k, i in enumerate(group):
                if total[k]:
                    languages[i], shares[i] = self.languages[best[k]], float(letters[k, best[k]] / total[k])
        return languages, shares

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of runs of words of one language, in characters of the text's lower-case form."""
        words = words_of([text])
        out: list[tuple[int, int, str]] = []
        for a, b, k in zip(words.starts.tolist(), words.ends.tolist(), self.labels(words).tolist(), strict=True):
            if out and out[-1][2] == self.languages[k]:
                out[-1] = (out[-1][0], b, out[-1][2])
            else:
                out.append((a, b, self.languages[k]))
        return out


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = TRAIN_DOCUMENTS) -> Model:
    """Learn from rows with a text and a language. Without such rows the model knows no language and says UNKNOWN."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    counts = {r._lang: r.n for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    index = {x: i for i, x in enumerate(languages)}
    scale = 1 << 30
    share = F.create_map(*(F.lit(y) for x in languages for y in (x, min(scale, -(-scale * documents // counts[x])))))
    sample = rows.filter(F.pmod(F.xxhash64("_key", "_text"), F.lit(scale)) < share[F.col("_lang")]).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((len(languages), BUCKETS), np.int64), np.zeros((len(languages), N_SCRIPTS), np.int64)
        for batch in slices(batches):
            pieces = [(x, piece) for x, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for piece in text_slices(t)]
            langs, texts = [x for x, _ in pieces], [t for _, t in pieces]
            for group in grouped(texts):
                words = words_of([texts[i] for i in group])
                of_word = np.repeat(np.array([index[langs[i]] for i in group]), words.per_text)
                per_word = np.diff(np.append(words.gram_starts, len(words.grams)))
                grams += np.bincount(np.repeat(of_word, per_word) * BUCKETS + words.grams, minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(of_word * N_SCRIPTS + words.scripts, words.lengths, scripts.size).reshape(scripts.shape).astype(np.int64)
        both = np.hstack((grams, scripts))
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(both.ravel()[at], pa.int64())})

    # At most languages x (buckets + scripts) rows, whatever the input.
    found = sample.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(len(languages) * (BUCKETS + N_SCRIPTS))
    both[found["at"].to_numpy(np.int64)] = found["n"].to_numpy()
    both = both.reshape(len(languages), -1)
    grams, scripts = both[:, :BUCKETS], both[:, BUCKETS:]
    weights = np.log((grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * BUCKETS))
    used = scripts >= 0.01 * np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(languages, np.ascontiguousarray(weights.T.astype(np.float32)), used.T.copy())


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang_pred, score) of a text column. The model's size has a bound, so it is broadcast."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        languages, shares = shared.value.predict([x if isinstance(x, str) else None for x in texts])
        return pd.DataFrame({"lang_pred": languages, "score": shares})

    return run(text)


def fold(key: str, parts: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents by a model that hasn't seen those whose crc32(id) mod 4 is 2."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id", 4) != 2))
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), predicted(spark, model, F.col("text")).alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_known(
    spark: SparkSession,
    docs: DataFrame,
    sf_dir: str = "",
    languages: tuple[str, ...] | None = None,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """Pipeline stage: documents stay whose predicted language is one of ``languages`` (null: all that were learned)
    and has at least ``least_share`` of their letters.

    So documents without a letter go (language ``und``), and those that mix
    languages too much. The model learns from the stage's own documents; where
    none has a language, whether there is a letter decides alone.
    """
    model = train(docs)
    if not model.languages:
        model = Model(["?"], np.zeros((BUCKETS, 1), np.float32), np.zeros((N_SCRIPTS, 1), bool))
    said = predicted(spark, model, F.col("text"))
    known = F.lit(True) if languages is None else said["lang_pred"].isin(*languages)
    return docs.filter((said["lang_pred"] != UNKNOWN) & (said["score"] >= least_share) & known)
