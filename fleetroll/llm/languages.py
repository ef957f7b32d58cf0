"""Language of texts as a mixture: shares of languages by expectation-maximisation over character trigrams.

A language is a distribution over hashed trigrams of letters (others count as one space). Its counts come from labelled training
rows, at most about ``MOST_TRAINING`` of them, chosen by hash. A text's trigrams are modelled as drawn from a mixture of the
languages; expectation-maximisation finds the shares. For one, two, ... languages with the largest shares the likelihood is
fitted again, until ``AHEAD`` further languages don't raise the likelihood minus a penalty for every language; the set where it
is best is chosen. ``languages`` has the set with its shares, largest first, ``fit`` the log likelihood per trigram under it. The
prediction is the language with the largest share, the score its share.

Null texts and texts without a letter are ``und`` with score 0, no languages and a null fit, as is everything where there are no training rows. Rows that
repeat are predicted one by one. Of languages with equal shares the first in code-point order is predicted. A text longer than
a slice is counted in slices. An empty table gives no rows. Only the text enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
MOST_TRAINING = 20_000
TURNS, AGAIN, AHEAD = 12, 5, 2
#: A further language has to raise the log likelihood by this many times the logarithm of the number of trigrams.
PENALTY = 3.0
#: The log likelihood per trigram of text that says nothing: every bucket as likely as any other.
NO_FIT = -float(np.log(BUCKETS))
SLICE = 1 << 20
UNKNOWN = "und"
LANGUAGES = "array<struct<lang: string, share: double>>"
SET = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (a row per text) of hashed trigrams around a letter, and how many trigrams each text has."""
    if all(len(t) <= SLICE for t in texts):
        counts = _counted([t.lower() for t in texts])
    else:
        counts = np.stack([_counted_in_slices(t.lower()) for t in texts])
    return counts, counts.sum(axis=1)


def _counted_in_slices(text: str) -> np.ndarray:
    """Counts of one long text, so that no array is longer than a slice."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), SLICE):
        begin = max(at - 1, 0)
        total += _counted([text[begin : at + SLICE + 1]], at - begin, at - begin + SLICE)[0]
    return total


def _counted(lowered: list[str], first: int = 0, last: int | None = None) -> np.ndarray:
    """Counts around the letters from place ``first`` to before ``last``; the characters beside them are only context."""
    joined = "  ".join([*lowered, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter().take(codes)
    x = np.where(letter, codes, np.uint32(32))
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in lowered), np.int64, len(lowered)))
    h = np.zeros(len(x), np.uint32)
    h[1:-1] = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    if len(x):  # the first letter of all has a space before it
        h[0] = np.uint32((32 * 0x9E3779B1 + int(x[0]) * 0x85EBCA77 + (int(x[1]) if len(x) > 1 else 32) * 0xC2B2AE3D) & 0xFFFFFFFF)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(letter)
    if first or last is not None:
        at = at[(at >= first) & (at < last)]
    text = np.searchsorted(ends, at, "right")
    bucket = (h[at] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return np.bincount(text * BUCKETS + bucket, minlength=len(lowered) * BUCKETS).reshape(len(lowered), BUCKETS)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE or k - begin >= 255:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 4 == 2


def train(labelled: DataFrame, most: int = MOST_TRAINING) -> tuple[list[str], np.ndarray]:
    """Languages and their distributions from rows (doc_id, text, lang). ``most`` bounds the rows, in expectation."""
    rows = labelled.where("lang is not null and text is not null")
    n = rows.count()
    if n > most:
        share = int(most / n * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in _slices(texts):
                counts, _ = trigram_counts(texts[a:b])
                for lang in set(langs[a:b]):
                    own = counts[[x == lang for x in langs[a:b]]].sum(axis=0)
                    total[lang] = total.get(lang, 0) + own
        for lang, own in total.items():
            used = np.flatnonzero(own)
            columns = [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(own[used])]
            yield pa.record_batch(columns, ["lang", "bucket", "n"])

    sums = rows.select("lang", "text").mapInArrow(count, "lang string, bucket bigint, n bigint")
    found = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # at most languages * BUCKETS rows
    langs = sorted({r["lang"] for r in found})
    counts = np.full((len(langs), BUCKETS), 0.5)
    place = {x: k for k, x in enumerate(langs)}
    for r in found:
        counts[place[r["lang"]], r["bucket"]] += r["n"]
    return langs, counts / counts.sum(axis=1, keepdims=True)


def shares(counts: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shares (a column per language, 0 for those not chosen) in the mixture with the best penalised likelihood, and
    its log likelihood per trigram."""
    counts = counts.astype(np.float32)
    model = model.astype(np.float32)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)

    def fit(start: np.ndarray, turns: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        mix, own, n = start, counts[some], total[some]
        for _ in range(turns):
            mix = mix * ((own / np.maximum(mix @ model, 1e-12)) @ model.T) / n
            mix /= np.maximum(mix.sum(axis=1, keepdims=True), 1e-30)
        return mix

    n = len(model)
    mix = fit(np.full((len(counts), n), 1 / n, np.float32), TURNS)
    order = np.argsort(-mix, axis=1, kind="stable")
    best, likely = np.full(len(counts), -np.inf), np.zeros(len(counts))
    chosen, size = np.zeros_like(mix), np.zeros(len(counts), np.int64)
    for k in range(1, n + 1):
        rows = np.flatnonzero(size + AHEAD >= k) if k > 1 else np.arange(len(counts))
        if not len(rows):
            break
        start, some = np.zeros((len(rows), n), np.float32), order[rows, :k]
        np.put_along_axis(start, some, np.maximum(np.take_along_axis(mix[rows], some, axis=1), 1e-3), axis=1)
        start /= start.sum(axis=1, keepdims=True)
        own = fit(start, AGAIN, rows) if k > 1 else start
        found = (counts[rows] * np.log(np.maximum(own @ model, 1e-12))).sum(axis=1)
        worth = found - PENALTY * k * np.log(total[rows, 0] + 1)
        better = worth > best[rows]
        at = rows[better]
        best[at], likely[at], chosen[at], size[at] = worth[better], found[better], own[better], k
    return np.clip(chosen, 0, 1), likely / total[:, 0]


def least_fit(model: np.ndarray) -> tuple[float, float]:
    """(fit, deviation): the fit half way between what says nothing and text of the least regular language, and the standard
    deviation of a single trigram's part in it. A text of n trigrams fits with at least fit - 3 * deviation / n ** 0.5."""
    if not len(model):
        return NO_FIT, 0.0
    logs = np.log(model)
    expected = (model * logs).sum(axis=1)
    deviation = np.sqrt((model * logs**2).sum(axis=1) - expected**2)
    return float((expected.min() + NO_FIT) / 2), float(deviation.max())


def predict(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``docs`` as a column ``row`` with ``lang_pred``, ``score``, ``languages``, ``fit`` and the number of ``trigrams``."""
    held = docs.sparkSession.sparkContext.broadcast((langs, model))  # languages * BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, distributions = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250).column("row")
                texts = [t or "" for t in pc.struct_field(some, "text").to_pylist()]
                for a, b in _slices(texts):
                    counts, trigrams = trigram_counts(texts[a:b])
                    some_letter = trigrams > 0
                    if names:
                        mix, fit = shares(counts, distributions)
                    else:
                        mix, fit, some_letter = np.zeros((b - a, 1)), np.zeros(b - a), np.zeros(b - a, bool)
                    top = mix.argmax(axis=1)
                    pred = [names[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), some_letter.tolist())]
                    score = np.where(some_letter, mix[np.arange(b - a), top], 0.0).astype(float)
                    order = np.argsort(-mix, axis=1, kind="stable")
                    sets = [
                        [{"lang": names[j], "share": float(own[j])} for j in o if own[j] > 0] if ok else []
                        for o, own, ok in zip(order.tolist(), mix, some_letter.tolist())
                    ]
                    columns = [
                        some.slice(a, b - a), pa.array(pred, pa.string()), pa.array(score), pa.array(sets, SET),
                        pa.array(fit.astype(float), pa.float64(), mask=~some_letter), pa.array(trigrams, pa.int64()),
                    ]
                    yield pa.record_batch(columns, ["row", "lang_pred", "score", "languages", "fit", "trigrams"])

    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    return docs.select(F.struct("*").alias("row")).mapInArrow(run, f"row {kind}, lang_pred string, score double, languages {LANGUAGES}, fit double, trigrams bigint")
