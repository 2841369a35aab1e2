"""Language identification: script ranges narrow the candidates, then Viterbi labels spans.

Every word gets a score in each language from hashed letter trigrams, counted over all
training texts. A language takes part for a word only if the word's script belongs to
it. Viterbi with a switching penalty then labels the words of a whole text; runs of a
label are spans, and the language with the most letters is the text's.

The decoder is exact. Words are cut into blocks whose best-path matrices are computed
side by side; matrices are chained per text, and max-marginals give each word's label.

Defined cases: a null text or one without a letter gives `und`, score 0 and no spans;
ties go to the language that sorts first; with no training rows every text is `und`;
rows are predicted one by one, so repeated rows repeat; a null id is never held out
and never learnt from. Long texts are scored in slices, whatever their length.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.workspace import is_fold

BUCKETS = 1 << 16
SWITCH = 12.0  # nats that a change of language costs
BLOCK = 64
SLICE = 1 << 21  # characters scored at once
SCRIPT_SHARE = 0.02  # a script belongs to a language that writes this share of its letters in it

# First code points of script ranges, in order; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"),
    (0xFF65, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x40000, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: simple lower case (0 outside words), whether it is a letter, its script."""
    n = 0x110000
    kind = np.array([unicodedata.category(chr(i))[0] for i in range(n)])
    letter = kind == "L"
    low = np.zeros(n, np.uint32)
    for i in np.nonzero(letter | (kind == "M"))[0]:
        s = chr(i).lower()
        low[i] = ord(s) if len(s) == 1 else i
    script = np.zeros(n, np.uint8)
    for start, name in SCRIPTS:
        script[start:] = SCRIPT_NAMES.index(name)
    return low, letter, script


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a line feed after each, and where each text starts."""
    joined = "\n".join(texts) + "\n"
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10FFFF), starts


def _grams(low: np.ndarray) -> np.ndarray:
    """Trigram bucket at each position; neighbours outside a word count as 0."""
    a = np.zeros(len(low) + 2, np.uint32)
    a[1:-1] = low
    h = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)


def _slices(texts: list[str], size: int = SLICE) -> Iterator[list[int]]:
    """Groups of neighbouring texts of about `size` characters; a longer text is a group alone."""
    held, total = [], 0
    for i, t in enumerate(texts):
        if held and total + len(t) > size:
            yield held
            held, total = [], 0
        held.append(i)
        total += len(t)
    if held:
        yield held


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and language: counts of trigram buckets, then of letters by script."""
    counts: dict[str, np.ndarray] = {}
    low_of, letter_of, script_of = _tables()
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            texts = texts.tolist()
            total = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
            for group in _slices(texts):
                codes, _ = _codes([texts[i] for i in group])
                for at in range(0, len(codes), SLICE):
                    part = codes[max(0, at - 1) : at + SLICE + 1]
                    low = low_of[part]
                    own = slice(min(at, 1), min(at, 1) + SLICE)
                    inside = low[own] > 0
                    total[:BUCKETS] += np.bincount(_grams(low)[own][inside], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script_of[part[own][letter_of[part[own]]]], minlength=len(SCRIPT_NAMES))
    for lang, total in counts.items():
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


def train(docs: DataFrame, rows: Column) -> dict:
    """Trigram log-probabilities and scripts of every language, from all rows for which `rows` holds.

    What reaches the driver has BUCKETS entries a language at most, whatever the corpus.
    """
    kept = docs.filter(rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    got = kept.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    counts[np.searchsorted(langs, got["lang"].to_numpy(str)), got["bucket"].to_numpy(int)] = got["n"] if len(got) else 0
    grams, scripts = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
    log_p = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    has = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True), 1)
    return {"langs": langs, "log_p": np.ascontiguousarray(log_p), "has": has.T}


def word_scores(model: dict, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, letters and best-is-0 scores of every word with a letter."""
    low_of, letter_of, script_of = _tables()
    n = len(model["langs"])
    inside = low_of[codes] > 0
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    letter = np.concatenate(([0], np.cumsum(letter_of[codes])))
    letters = letter[end] - letter[start]
    start, end, letters = start[letters > 0], end[letters > 0], letters[letters > 0]
    score = np.zeros((len(start), n))
    cut = np.searchsorted(start, np.arange(0, len(codes) + SLICE, SLICE))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        for c in range(a, b, SLICE // 4):  # a slice holds whole words
            d = min(b, c + SLICE // 4)
            lo, hi = start[c], end[d - 1]
            low = low_of[codes[lo:hi]]
            g = _grams(low)
            logs = model["log_p"][g]
            logs[low == 0] = 0
            score[c:d] = np.add.reduceat(logs, start[c:d] - lo, axis=0)
    allowed = model["has"][script_of[codes[start]]] if n else np.zeros((len(start), 0), bool)
    some = allowed.any(axis=1)
    score[some] -= 1e3 * ~allowed[some]
    score[~some] = 0
    return start, end, letters, score - score.max(axis=1, keepdims=True) if n else score


def viterbi(score: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best labels of the words of each text; text i has the words bounds[i] to bounds[i + 1]."""
    n, k = score.shape
    sizes = np.diff(bounds)
    blocks = -(-sizes // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    label = np.zeros(n, np.int64)
    if not n:
        return label
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(n) - bounds[text_of]
    row, col = first[text_of] + within // BLOCK, within % BLOCK
    s = np.zeros((first[-1], BLOCK, k))
    s[row, col] = score
    # Best path through each block from each state before it.
    m = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(len(s), 0)
    for t in range(BLOCK):
        m = np.maximum(m, m.max(-1, keepdims=True) - penalty) + s[:, t, None, :]
    enter, leave = np.zeros((len(s), k)), np.zeros((len(s), k))
    order = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max(initial=0))):
        b = first[order[: np.searchsorted(-blocks[order], -j, side="left")]] + j
        enter[b] = (enter[b - 1][:, :, None] + m[b - 1]).max(1)
    last = first[1:] - 1
    for j in range(1, int(blocks.max(initial=0))):
        b = last[order[: np.searchsorted(-blocks[order], -j, side="left")]] - j
        leave[b] = (m[b + 1] + leave[b + 1][:, None, :]).max(2)
    ahead = np.empty_like(s)
    v = leave
    for t in range(BLOCK - 1, -1, -1):
        ahead[:, t] = v
        w = v + s[:, t]
        v = np.maximum(w, w.max(-1, keepdims=True) - penalty)
    v = enter
    out = np.empty(s.shape[:2], np.int64)
    begin = np.zeros(len(s), bool)
    begin[first[:-1][blocks > 0]] = True
    for t in range(BLOCK):
        v = np.maximum(v, v.max(-1, keepdims=True) - penalty) + s[:, t]
        out[:, t] = np.argmax(np.round(v + ahead[:, t], 6), axis=-1)
    return out[row, col]


def label_texts(model: dict, texts: list[str | None]) -> pd.DataFrame:
    """lang_pred, score and spans of each text."""
    n, langs = len(texts), model["langs"]
    best, share = np.full(n, "und", dtype=object), np.zeros(n)
    spans: list[list] = [[[], [], []] for _ in range(n)]
    clean = [t or "" for t in texts]
    for group in _slices(clean) if langs else ():
        codes, starts = _codes([clean[i] for i in group])
        start, end, letters, score = word_scores(model, codes)
        bounds = np.searchsorted(start, starts)
        label = viterbi(score, bounds)
        weight = np.zeros((len(group), len(langs)))
        text_of = np.repeat(np.arange(len(group)), np.diff(bounds))
        np.add.at(weight, (text_of, label), letters)
        total = weight.sum(axis=1)
        has = np.nonzero(total > 0)[0]
        at = np.array(group)[has]
        best[at] = np.array(langs, dtype=object)[weight[has].argmax(axis=1)]
        share[at] = weight[has].max(axis=1) / total[has]
        new = np.nonzero((np.diff(text_of, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))[0]
        stop = np.append(new, len(label))[1:] - 1
        for a, b in zip(new, stop, strict=True):
            o, i = starts[text_of[a]], group[text_of[a]]
            for out, x in zip(spans[i], (int(start[a] - o), int(end[b] - o), langs[label[a]]), strict=True):
                out.append(x)
    return pd.DataFrame({"lang_pred": best, "score": share, "span_start": [s[0] for s in spans], "span_end": [s[1] for s in spans], "span_lang": [s[2] for s in spans]})


RESULT = "lang_pred string, score double, span_start array<int>, span_end array<int>, span_lang array<string>"


def _label(shared):
    @F.pandas_udf(RESULT)
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield label_texts(shared.value, part.tolist())

    return label


def labelled(docs: DataFrame, model: dict) -> DataFrame:
    """docs as `doc` with `found`, the language of each text; the model, of a size fixed by the number of languages, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.struct("*").alias("doc"), _label(shared)(F.col("text")).alias("found"))


def in_training(key: Column) -> Column:
    return ~is_fold(key, 5, 0) & key.isNotNull()


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, prediction and spans of every row of docs, learning from its training fold."""
    model = train(docs, in_training(F.col("doc_id")))
    rows = labelled(docs.select("doc_id", "text"), model)
    return rows.select("doc.doc_id", is_fold(F.col("doc.doc_id"), 5, 0).alias("held_out"), "found.*")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of docs whose text has one language for at least that share of its letters; columns unchanged."""
    model = train(docs, in_training(F.col("doc_id")))
    return labelled(docs, model).filter((F.col("found.lang_pred") != "und") & (F.col("found.score") >= least)).select("doc.*")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs).select("doc_id", "held_out", "lang_pred", "score", F.size("span_start").alias("n_spans"))
