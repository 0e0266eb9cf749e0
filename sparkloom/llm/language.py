"""Language identification by inference of a multilingual mixture.

Learning: letter trigrams of all labelled texts outside the held-out fold are hashed to ``BUCKETS`` and counted by language, first in
each Arrow batch, then over all; the counts, languages times BUCKETS numbers, make smoothed likelihoods.

Prediction: a document's trigrams are drawn from a mixture of languages. EM estimates the proportions; the set of languages
starts with the one of best likelihood and takes in the next by proportion as long as the log-likelihood gains more than the
penalty, ``PENALTY`` times log(trigrams) a language. The prediction is the largest proportion in the set. Its score is that proportion times
the probability that the set, by its penalised likelihood, has against the best one without the language; so a text of few
letters has a low score. Whole texts of any length; only the text is an input.

Null text or a text without a letter: ``und``, score 0; also when nothing was learnt, as from an empty table. A row with a null doc_id
is in no fold: it is not learnt from and counts as held out. Repeated rows count as often as they are there when they are learnt from, and
get the same prediction. Equal proportions, and equal likelihoods, go by the language's name. More than ``MOST_LANGUAGES`` values
of ``lang`` are an error: the model, languages times BUCKETS, is held by the driver and each worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import slices

BUCKETS_LOG2 = 15
BUCKETS = 1 << BUCKETS_LOG2
SMOOTHING, PENALTY, ROUNDS, LEAST_SHARE = 0.5, 4.0, 12, 0.05
UNKNOWN = "und"
MOST_LANGUAGES = 500


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams around each letter of a text, lower-cased, with other characters as spaces."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    c = np.where(letter, c, np.uint32(32))
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int64)[letter[1:-1]]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        p = counts + SMOOTHING
        self.likelihood = np.ascontiguousarray((p / p.sum(axis=1, keepdims=True)).T) if languages else np.zeros((BUCKETS, 0))

    @staticmethod
    def _mix(like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        share = np.full(like.shape[1], 1 / like.shape[1])
        total = n.sum()
        for _ in range(ROUNDS):
            share = share * ((n / (like @ share)) @ like) / total
        return share, float(n @ np.log(like @ share))

    def infer(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """The document's languages and their proportions, largest first; the score of the first."""
        found = trigrams(text)
        if not len(found) or not self.languages:
            return [], 0.0
        n = np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(n)
        n, like = n[at].astype(float), self.likelihood[at]
        penalty = PENALTY * np.log(len(found) + 1)
        share, _ = self._mix(like, n)
        alone = n @ np.log(like)
        chosen = [int(np.argmax(alone))]
        value, best = np.ones(1), float(alone[chosen[0]])
        for i in np.argsort(-share, kind="stable"):
            if i in chosen:
                continue
            if share[i] < LEAST_SHARE:
                break
            more, score = self._mix(like[:, [*chosen, i]], n)
            if score - best <= penalty:
                break
            chosen, value, best = [*chosen, int(i)], more, score
        order = sorted(range(len(chosen)), key=lambda j: (-value[j], self.languages[chosen[j]]))
        first, rest = chosen[order[0]], [chosen[j] for j in order[1:]]
        others = [float(x) for j, x in enumerate(alone) if j != first]
        if rest:
            others.append(self._mix(like[:, rest], n)[1] - penalty * (len(rest) - 1))
        margin = best - penalty * len(rest) - max(others) if others else np.inf
        sure = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
        return [(self.languages[chosen[j]], float(value[j])) for j in order], min(1.0, float(value[order[0]]) * float(sure))


def learn(docs: DataFrame) -> Model:
    """From the rows (doc_id, text, lang) that have a language and aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "b", "n"])

    rows = docs.where(F.col("lang").isNotNull() & ~held_out()).select("text", "lang")
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    got = rows.mapInArrow(run, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    index = {x: i for i, x in enumerate(languages)}
    if languages:
        counts[[index[x] for x in got["lang"].to_pylist()], got["b"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of each row of ``docs`` (doc_id, text, and lang to learn from)."""
    model = learn(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            said = [sent.value.infer(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("held_out"),
                    pa.array([x[0][0] if x else UNKNOWN for x, _ in said], pa.string()),
                    pa.array([score for _, score in said], pa.float64()),
                    pa.array([",".join(f"{lang}:{share:.3f}" for lang, share in x) for x, _ in said], pa.string()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages string")
