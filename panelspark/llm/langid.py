"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

A text is the vector of its hashed byte bigrams and trigrams (letters in lower case, digits alike), weighted
log(1 + tf) * idf and scaled to length one. Each language has several centroids from spherical k-means, and a text
takes the language of the centroid with the largest cosine. A text that lies farther from that centroid than nearly
all of the centroid's own training texts is rejected; texts of few n-grams may lie farther, in proportion.

Defined cases: a null or empty text or one without a letter is `und`, score 0, rejected; very long texts are counted
whole; repeated rows get equal results; of equal cosines the first centroid wins, languages in order of their names;
columns other than doc_id, text and, for fitting, lang are ignored; with no labelled row, or with more than MOST_LANGS
languages, fitting raises ValueError; an empty table to predict gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, small_batches, text_chunks

DIMS = 4096
#: The model is fitted on the driver on at most this many distinct texts of each language (and SAMPLE in all), those of least hash.
SAMPLE_PER_LANG = 800
SAMPLE = 8000
#: Languages beyond this number raise ValueError: the model is broadcast to every task.
MOST_LANGS = 1000
CENTROIDS = 4
#: A text is rejected below this share of the cosine that 99 % of a centroid's own training texts reach. Texts of other
#: languages, encoded bytes and the like stay below it; of 10,000 texts of the languages themselves none was under 0.79.
REJECT_SHARE = 0.5
#: Texts of fewer distinct n-grams get a proportionally smaller threshold.
FULL_EVIDENCE = 150

#: Bytes whose n-grams are hashed at once, which takes some 60 times their size; a longer text is counted piece by piece.
PIECE = 1 << 20

RESERVED = ("lang_pred", "score", "rejected", "__letters")

_CLASS = LOWER.copy()
_CLASS[48:58] = 48
_CLASS[np.r_[0:48, 58:65, 91:97, 123:128]] = 32


def _grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed bigram and trigram that begin at each byte, -1 for two blanks."""
    codes = _CLASS[raw].astype(np.uint32)
    pairs = codes[:-1] * np.uint32(256) + codes[1:]
    two = ((pairs * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
    triples = pairs[:-1] * np.uint32(256) + codes[2:]
    three = ((triples * np.uint32(0x85EBCA77)) >> np.uint32(20)).astype(np.int64)
    blank = np.uint32(32 * 257)
    two[pairs == blank] = -1  # runs of blanks say nothing
    return two, three


def _counted(two: np.ndarray, three: np.ndarray) -> np.ndarray:
    grams = np.concatenate((two, three))
    return np.bincount(grams[grams >= 0], minlength=DIMS)


def vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + tf) of the hashed n-grams, one row for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), dtype=np.float32)
    spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    if len(raw) <= PIECE:
        two, three = _grams(raw) if len(raw) > 1 else (raw, raw)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                out[k] = _counted(two[a : b - 1], three[a : max(a, b - 2)])
    else:
        for k, (a, b) in enumerate(spans):
            # The n-grams that begin in each piece; the two bytes after it end its last ones.
            pieces = (_grams(raw[at : min(b, at + PIECE + 2)]) for at in range(a, b - 1, PIECE))
            out[k] = sum(_counted(two[:PIECE], three[:PIECE]) for two, three in pieces)
    return np.log1p(out, out=out)


def _scaled(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    least: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid, its cosine, and whether that is too small."""
        cosines = _scaled(counts * self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        return best, score, score < self.least[best] * np.minimum(1, (counts > 0).sum(axis=1) / FULL_EVIDENCE)


def fit(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS, seed: int = 1) -> LanguageModel:
    """Fit on (text, lang) rows with both present; per_lang bounds what the driver collects."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # Copies of a text have one hash: each distinct text of a language counts once, and only once can it be chosen.
    distinct = rows.select("lang", F.xxhash64("text", F.lit(seed)).alias("h")).distinct()
    counts = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if not counts or len(counts) > MOST_LANGS:
        raise ValueError(f"expected 1 to {MOST_LANGS} languages, got {len(counts)}")
    per_lang = max(1, min(per_lang, SAMPLE // len(counts)))
    # Up to twice the texts wanted are let through by hash, so that only about that many vectors are sent.
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, max(2 * per_lang, 20) / n))))[F.col("lang")]
    chosen = rows.withColumn("h", F.xxhash64("text", F.lit(seed))).filter(F.pmod(F.col("h"), F.lit(1_000_000)) < share * 1_000_000).dropDuplicates(["lang", "h"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in text_chunks(batch.column(2)):
                own = [x.tobytes() for x in vectors(raw, offsets).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(own)) for k in (0, 1)), pa.array(own, type=pa.binary())], names=["lang", "h", "v"])

    # The per_lang texts of least hash of each language, as heaps with the largest of them first.
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in chosen.select("lang", "h", "text").mapInArrow(counted, "lang string, h long, v binary").toLocalIterator():
        held = texts.setdefault(r["lang"], [])
        (heapq.heappush if len(held) < per_lang else heapq.heappushpop)(held, (-r["h"], bytes(r["v"])))
    names = sorted(texts)

    def block_of(lang: str) -> np.ndarray:
        return np.stack([np.frombuffer(v, dtype=np.float16) for _, v in sorted(texts[lang], reverse=True)]).astype(np.float32)

    # A language at a time, so that the driver holds the counts of the sample once and one language's vectors.
    df = sum((block_of(lang) > 0).sum(axis=0) for lang in names)
    idf = np.log((1 + sum(map(len, texts.values()))) / (1 + df)).astype(np.float32) + np.float32(1)
    rng = np.random.default_rng(seed)
    found, langs, least = [], [], []
    for lang in names:
        x = _scaled(block_of(lang) * idf)
        texts.pop(lang)
        k = min(centroids, len(x))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(15):
            own = (x @ c.T).argmax(axis=1)
            c = _scaled(np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(k)]))
        cosines = x @ c.T
        own = cosines.argmax(axis=1)
        for j in range(k):
            found.append(c[j])
            langs.append(lang)
            near = cosines[own == j, j]
            least.append(REJECT_SHARE * float(np.quantile(near, 0.01)) if len(near) else 0.0)
    return LanguageModel(idf, np.stack(found).astype(np.float32), tuple(langs), np.array(least))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and rejected (they replace columns of these names); only the text is looked at."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in RESERVED]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = np.array(own.langs, dtype=object)
        at = kept.index("text")
        for batch in batches:
            for rows in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                letters = rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False)
                best, score, far = np.zeros(rows.num_rows, dtype=np.int64), np.zeros(rows.num_rows), np.zeros(rows.num_rows, dtype=bool)
                for first, raw, offsets in text_chunks(rows.column(at)):
                    part = slice(first, first + len(offsets) - 1)
                    best[part], score[part], far[part] = own.nearest(vectors(raw, offsets))
                pred = np.where(letters, names[best], "und")
                out = np.where(letters, score, 0.0)
                rejected = ~letters | far
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(kept))), pa.array(pred, type=pa.string()), pa.array(out), pa.array(rejected)], names=[*kept, "lang_pred", "score", "rejected"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    with_letters = docs.select("*", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    return with_letters.mapInArrow(judged, schema)
