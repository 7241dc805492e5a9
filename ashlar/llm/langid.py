"""Language identification by cross-parsing (Ziv and Merhav 1993).

Each language is a suffix automaton of a bounded amount of labelled text.  A
text is parsed against it greedily: each phrase is the longest prefix of the
rest that occurs in the language's text.  The phrase count times
log2(training length), over the text's length, estimates the cross entropy;
the language that needs the fewest normalised phrases wins.

The automata become dense transition tables in which a missing transition
already leads on to the next phrase and carries a phrase mark in its lowest
bit, so whole batches are parsed in lockstep by table look-ups.  Texts are cut
into segments of ``SEGMENT`` bytes that are parsed side by side; all of a text
counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SEGMENT = 512
RUN = 1 << 21
PAD, OTHER = 0, 1
_LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    to: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in symbols:
        new = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


class Model:
    """Tables for each language: ``table[state * width + symbol]`` is 2 * next row + phrase mark."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        texts = [plain(samples[n]) for n in self.names]
        self.symbol = np.full(256, OTHER, np.uint8)
        self.symbol[:0x80] = 2  # what is no letter parts words
        self.symbol[97:123] = OTHER  # letters that no language has
        used = sorted({b for t in texts for b in set(t) if b >= 0x80 or 97 <= b <= 122})
        for k, b in enumerate(used):
            self.symbol[b] = 3 + k
        self.width = 3 + len(used)
        self.tables, self.bits = [], []
        for t in texts:
            symbols = self.symbol[np.frombuffer(t, np.uint8)].tolist()
            to = suffix_automaton(symbols)
            root = np.ones(self.width, np.int64)
            for c, s in to[0].items():
                root[c] = 2 * s * self.width + 1
            root[OTHER] = 1
            table = np.tile(root, len(to))
            state = np.fromiter((k for k, x in enumerate(to) for _ in x), np.int64)
            symbol = np.fromiter((c for x in to for c in x), np.int64)
            following = np.fromiter((s for x in to for s in x.values()), np.int64)
            table[state * self.width + symbol] = 2 * following * self.width
            table[np.arange(len(to)) * self.width + PAD] = 2 * np.arange(len(to)) * self.width
            self.tables.append(table.astype(np.int32))
            self.bits.append(log2(max(2, len(symbols))))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Normalised phrase counts, a row for each text and a column for each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        segments = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), segments)
        first = np.cumsum(segments) - segments
        flat = np.zeros(int(segments.sum()) * SEGMENT, np.uint8)
        raw = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        place = np.repeat(first * SEGMENT - (np.cumsum(sizes) - sizes), sizes)
        flat[np.arange(len(raw)) + place] = raw
        columns = np.ascontiguousarray(flat.reshape(-1, SEGMENT).T)
        out = np.zeros((len(texts), len(self.names)))
        for k, table in enumerate(self.tables):
            at = np.zeros(columns.shape[1], np.int32)
            marks = np.zeros(columns.shape[1], np.int32)
            for c in columns:
                v = table.take(at + c)
                marks += v & 1
                at = v >> 1
            out[:, k] = np.bincount(owner, marks, len(texts)) * self.bits[k]
        return out / np.maximum(sizes, 1)[:, None]


_models: dict[tuple, Model] = {}


def _model(samples: dict[str, str]) -> Model:
    key = tuple(sorted(samples.items()))
    if key not in _models:
        _models.clear()
        _models[key] = Model(samples)
    return _models[key]


def sample(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", chars: int = 40_000, piece: int = 800, most_languages: int = 64) -> dict[str, str]:
    """Training text for each language: pieces of ``piece`` characters from documents in hash order, ``chars`` in all.

    Every language is learned.  The bound of the model is ``chars * most_languages``;
    of more languages each has an equal share of it.  Rows with a null text,
    language or id are not used.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")).alias("h"), F.col(id_col).alias("id"))
    rows = rows.where("lang is not null and text is not null and id is not null and length(text) > 0")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return {}
    chars = min(chars, max(1, chars * most_languages // len(counts)))
    wanted = 3 * -(-chars // piece) + 20
    rates = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1000, -(-1000 * wanted // r["count"]))))))
    start = F.lit(1) + F.pmod("h", F.greatest(F.length("text") - piece, F.lit(1))).cast("int")
    drawn = rows.where(F.pmod("h", F.lit(1000)) < rates[F.col("lang")]).select("lang", "h", F.substring("text", start, F.lit(piece)).alias("t"))
    # counts beyond 1000 * wanted are thinned again, so that a language never gives the driver many more rows than wanted
    finer = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1000 * wanted / r["count"])))))
    drawn = drawn.where(F.pmod(F.shiftright("h", 20), F.lit(1 << 20)) < finer[F.col("lang")] * (1 << 20))
    found: dict[str, list[tuple[int, str]]] = {}
    for lang, h, t in drawn.collect():
        found.setdefault(lang, []).append((h, t))
    return {lang: " ".join(t for _, t in sorted(x))[:chars] for lang, x in found.items()}


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred (string) and lang_score (double, 0 to 1).

    The score is 1 - best / second best normalised phrase count.  A null text,
    one without any letter, or an empty model gives ``und`` and 0.  Ties go to
    the language name that sorts first.  Columns named like the outputs are
    replaced.
    """
    scratch.small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score")
    schema = docs.schema
    at = schema.fieldNames().index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(samples)

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not model.value:
            for b in parts:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([UNDETERMINED] * b.num_rows), pa.array([0.0] * b.num_rows)], names=[*schema.fieldNames(), "lang_pred", "lang_score"])
            return
        m = _model(model.value)
        for b in parts:
            names, scores = [], []
            for texts in _runs(b.column(at)):
                rates = m.phrases([plain(t or "") for t in texts])
                best = rates.argmin(axis=1)
                two = np.sort(rates, axis=1)[:, :2]
                for t, k, r in zip(texts, best.tolist(), two.tolist(), strict=True):
                    judged = t is not None and has_letter(t)
                    names.append(m.names[k] if judged else UNDETERMINED)
                    scores.append(min(1.0, max(0.0, 1 - r[0] / r[-1])) if judged and len(r) > 1 and r[-1] > 0 else float(judged and len(r) == 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*schema.fieldNames(), "lang_pred", "lang_score"])
        _models.clear()  # workers outlive their tasks; what follows needs the memory
        scratch.trim()

    return docs.mapInArrow(predict, type(schema)([*schema.fields]).add("lang_pred", "string").add("lang_score", "double"))


def _runs(column: pa.Array) -> Iterator[list[str | None]]:
    """Runs of texts of about RUN characters, so that tables of a batch stay small."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= RUN:
            yield held
            held, size = [], 0
    if held:
        yield held
