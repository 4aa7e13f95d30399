"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken on the executors from a bounded sample of the labelled rows; the matrix of log
probabilities, whose size depends on the numbers of buckets and languages only, is broadcast and whole
texts are scored batch by batch in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import map_arrow

UNKNOWN = "und"
ORDERS = (2, 3)
BUCKETS = 1 << 15
#: So many labelled rows, about, are drawn by a hash of their id to fit the model.
TRAIN_ROWS = 30_000
#: More languages than these are an error: they bound what is gathered and the matrix that is broadcast (64 MB).
MOST_LANGUAGES = 512
SMOOTHING = 0.5
#: Texts are joined up to so many characters to be scored at once.
CHUNK = 1 << 19

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(points: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the n-grams of one text whose runs of non-letters have become single spaces."""
    shift = np.uint32(33 - buckets.bit_length())
    mixed = points * np.uint32(0x9E3779B1)
    out = []
    for n in ORDERS:
        if len(points) < n:
            continue
        h = mixed[: len(points) - n + 1].copy()
        for k in range(1, n):
            h *= np.uint32(0x85EBCA77)
            h ^= mixed[k : len(points) - n + 1 + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append(h >> shift)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def normal(points: np.ndarray) -> np.ndarray:
    """Letters kept, each run of other characters one space, a space at both ends; empty without letters."""
    kept = letters()[points]
    if not kept.any():
        return points[:0]
    padded = np.zeros(len(points) + 2, np.uint32)
    padded[0] = padded[-1] = 32
    padded[1:-1] = np.where(kept, points, 32)
    space = padded == 32
    return padded[np.append(True, ~(space[1:] & space[:-1]))]


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages

    def score(self, text: str | None) -> tuple[str, float]:
        """The most probable language (ties to the smaller name) and its posterior probability."""
        if text is None or not self.languages:
            return UNKNOWN, 0.0
        points = normal(codes(text))
        if not len(points):
            return UNKNOWN, 0.0
        total = self.log_prior.copy()
        for i in range(0, len(points), CHUNK):
            # neighbouring pieces share the characters that their n-grams need
            found = grams(points[i : i + CHUNK + ORDERS[-1] - 1], len(self.log_prob))
            total += self.log_prob[found].sum(axis=0, dtype=np.float64)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.languages[best], float(1.0 / odds.sum())


def train(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fits on rows of docs with a text and a language for which allowed holds: all of them up to about
    `rows`, beyond it a sample drawn by a hash of the id."""
    fit = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n, languages = fit.agg(F.count(F.lit(1)), F.approx_count_distinct(lang_col)).first()
    if languages > 1.1 * MOST_LANGUAGES:
        raise ValueError(f"there are about {languages} languages; at most {MOST_LANGUAGES} can be told apart")
    if n > rows:
        fit = fit.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * rows / n))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, n = np.unique(grams(normal(codes(text)), BUCKETS), return_counts=True)
            by.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
            texts[lang] = texts.get(lang, 0) + 1
        out = [(lang, at := np.flatnonzero(sums), sums[at], texts[lang]) for lang, sums in by.items()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.append(at, -1) for _, at, _, _ in out])),
                pa.array(np.concatenate([np.append(n, docs) for _, _, n, docs in out])),
                pa.array([lang for lang, at, _, _ in out for _ in range(len(at) + 1)], pa.string()),
            ],
            names=["bucket", "n", "lang"],
        )

    found = map_arrow(fit.select(lang_col, text_col), count, "bucket long, n long, lang string").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique().tolist())
    counts, prior = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    at = found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)
    bucket, n = found["bucket"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64)
    prior[at[bucket < 0]] = n[bucket < 0]
    np.add.at(counts, (bucket[bucket >= 0], at[bucket >= 0]), n[bucket >= 0])
    counts += SMOOTHING
    return Model(names, np.log((prior + 1) / (prior + 1).sum()) if names else prior, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves 1 if divided by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns of keep, lang_pred string, score double) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    chosen = docs.select(id_col, *keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in chosen.schema[:-1])
    return map_arrow(chosen, step, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a row for each row of docs, from its text alone.

    The model is fitted on labelled rows that aren't held out. Null texts and texts without a letter get
    `und` and score 0, as does all if nothing is labelled; repeated rows get the same prediction; languages
    that tie go by name; an empty table gives no rows; other columns aren't read. score is the posterior
    probability of lang_pred."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(chosen, ~held_out())
    return predict(chosen.withColumn("held_out", held_out()), model, keep=("held_out",))


#: A document is rejected if no language reaches this posterior probability.
REJECT_UNDER = 0.5


def accept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, columns as they were and of any name, whose language is recognized: a known language with a
    posterior probability of at least REJECT_UNDER. Null texts and texts without a letter go; repeated rows stay or
    go together; an empty table gives no rows. If no row is labelled, nothing can be told and all stay."""
    model = train(docs.select(id_col, text_col, lang_col), ~held_out(id_col), id_col, text_col, lang_col)
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = (shared.value.score(x) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist())
        return batch.filter(pa.array([lang != UNKNOWN and score >= REJECT_UNDER for lang, score in found], pa.bool_()))

    return map_arrow(docs, step, docs.schema)
