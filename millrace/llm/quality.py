"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Ratings are grades 0 (toxic), 1 (poor) and 2 (good): toxic is the lowest, so that more toxic words never make a text
better. One weight for each hashed feature gives a document's score s; ordered thresholds give P(grade >= k) = sigmoid(s - t_k). From these follow the expected grade and the tail probability by which
documents are selected. The model is fitted to a bounded sample of the rated documents, in one task of an executor; only
its weights reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.sampling import bounded
from millrace.llm.texts import filter_texts, let_go, map_texts

#: Rated documents that the model is fitted to at most, and hashed features.
SAMPLE, DIMENSIONS = 16_000, 2**18
#: What a feature's statistic must reach to get a weight: chance alone lets about one in a million by. Passes, documents of
#: a step, step size and pull towards zero.
LEAST_TELLING, PASSES, STEP_DOCS, RATE, PULL = 27.0, 12, 64, 0.15, 1e-4
#: Grades, and the probability of the best one from which a document is kept.
GRADES, KEEP = 3, 0.5
MEMO = 200_000
#: Documents whose features are counted together.
COUNT_DOCS = 256
#: Bytes of a word's beginnings that are features of their own.
STEMS = (4, 5)

_TRIM = b".,;:!?\"'()[]{}*#%&$|-_=+~/\\"


class _Words(dict):
    """Hashed features of a word as it stands: the bare word, what it ends in, and its case; emptied when full."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        bare = word.strip(_TRIM)
        low = bare.lower()
        # Inflected forms share their beginnings.
        out = [_place(b"w " + low), *(_place(b"b " + low[:k]) for k in STEMS if len(low) > k)]
        if bare != word:
            out.append(_place(b"m " + word[len(word.rstrip(_TRIM)) :]))
        if len(bare) > 1 and bare.isupper():
            out.append(_place(b"upper"))
        if not bare:
            out.append(_place(b"bare " + word[:8]))
        if len(word) <= 64:
            self[word] = tuple(out)
        return tuple(out)


def _place(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) % DIMENSIONS


def features(text: str, words: dict) -> np.ndarray:
    """Distinct hashed features of a whole text; none without words."""
    raw = text.encode("utf-8", "surrogatepass").split()
    if not raw:
        return np.zeros(0, dtype=np.int32)
    distinct = set(raw)
    out = {i for w in distinct for i in words[w]}
    n = len(raw)
    letters = sum(map(len, raw))
    marks = letters - len(text.encode("utf-8", "surrogatepass").translate(None, _TRIM + b" \t\n\x0b\x0c\r"))
    upper = sum(w.isupper() for w in raw)
    # How the text is made up, in steps, so that weights are shared with the words'.
    for name, x in (("repeats", len(distinct) / n if n < 400 else min(1.0, len(distinct) / n * (n / 400) ** 0.35)), ("marks", min(1.0, 4 * marks / letters)), ("upper", upper / n), ("length", min(1.0, letters / n / 16))):
        out.add(_place(f"{name} {int(10 * x)}".encode()))
    out.add(_place(f"size {int(math.log2(n))}".encode()))
    return np.fromiter(out, dtype=np.int32, count=len(out))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a row a document."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _telling(rows: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """How unevenly each feature falls on the grades: the likelihood-ratio statistic of having it or not."""
    have = np.zeros((GRADES, DIMENSIONS))
    for g in range(GRADES):
        of = np.flatnonzero(grades == g).tolist()
        # Some rows at a time: all features of the sample in one array, and copies of it, took hundreds of megabytes.
        for at in range(0, len(of), COUNT_DOCS):
            have[g] += np.bincount(np.concatenate([rows[i] for i in of[at : at + COUNT_DOCS]]), minlength=DIMENSIONS)
    size = np.bincount(grades, minlength=GRADES).astype(float)[:, None]
    total, out = have.sum(axis=0), 0.0
    for part, whole in ((have, total), (size - have, size.sum() - total)):
        expected = size * whole / size.sum()
        out = out + 2 * (part * np.log(np.where(part > 0, part / np.where(expected > 0, expected, 1), 1))).sum(axis=0)
    return out


def slopes(s: np.ndarray, t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of -log P(grade) by each score, and of their sum by each threshold. P = sig(s - t_y) - sig(s - t_(y + 1))."""
    n, levels, r = len(s), len(t), np.arange(len(s))
    above = np.hstack([np.ones((n, 1)), _sigmoid(s[:, None] - t), np.zeros((n, 1))])
    slope = above * (1 - above)
    p = np.maximum(above[r, y] - above[r, y + 1], 1e-9)
    down, up = slope[r, y] / p, slope[r, y + 1] / p
    by_threshold = np.zeros(levels)
    np.add.at(by_threshold, y[y > 0] - 1, down[y > 0])
    np.add.at(by_threshold, y[y < levels], -up[y < levels])
    return up - down, by_threshold


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Adaptive steps on the cumulative-link likelihood; after each, weights are pulled to zero, thresholds kept in order."""
    n, levels = len(rows), GRADES - 1
    if not n:
        return Model(np.zeros(DIMENSIONS, np.float32), np.full(levels, -40.0))
    common = np.flatnonzero(_telling(rows, grades) >= LEAST_TELLING)
    column = np.full(DIMENSIONS, -1, dtype=np.int32)
    column[common] = np.arange(len(common))
    rows = [c[c >= 0] for c in (column[r] for r in rows)]
    w, seen = np.zeros(len(common)), np.full(len(common), 1e-8)
    # Thresholds: the first, and the logarithms of the steps between them.
    share = np.clip([(grades >= k).mean() for k in range(1, GRADES)], 0.01, 0.99)
    t = -np.log(share / (1 - share))
    base, gaps = t[0], np.log(np.maximum(np.diff(t), 0.1))
    rng, seen_t = np.random.default_rng(0), np.full(levels, 1e-8)
    total, steps = np.zeros(len(common) + levels), 0
    for epoch in range(PASSES):
        order = rng.permutation(n)
        for at in range(0, n, STEP_DOCS):
            pick = order[at : at + STEP_DOCS]
            idx = [rows[i] for i in pick]
            long = np.array([len(i) for i in idx])
            cat = np.concatenate(idx) if long.sum() else np.zeros(0, np.int32)
            owner = np.repeat(np.arange(len(pick)), long)
            s = np.bincount(owner, weights=w[cat], minlength=len(pick))
            t = np.concatenate([[base], base + np.cumsum(np.exp(gaps))])
            grad_s, grad_t = slopes(s, t, grades[pick])
            grad = np.bincount(cat, weights=grad_s[owner], minlength=len(common)) / len(pick)
            hit = np.flatnonzero(grad)
            seen[hit] += grad[hit] ** 2
            rate = RATE / np.sqrt(seen[hit])
            moved = w[hit] - rate * grad[hit]
            w[hit] = np.sign(moved) * np.maximum(np.abs(moved) - rate * PULL, 0)
            # base moves all thresholds, a gap those above it.
            chain = np.concatenate([[grad_t.sum()], np.exp(gaps) * np.cumsum(grad_t[::-1])[::-1][1:]]) / len(pick)
            seen_t += chain**2
            move = RATE * chain / np.sqrt(seen_t)
            base -= move[0]
            gaps = np.clip(gaps - move[1:], -6, 4)
            if epoch >= PASSES // 2:
                total += np.concatenate([w, [base], gaps])
                steps += 1
    total /= max(steps, 1)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[common] = total[: len(common)]
    base, gaps = total[len(common)], total[len(common) + 1 :]
    return Model(weights, np.concatenate([[base], base + np.cumsum(np.exp(gaps))]))


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 if toxic, else 1 for quality 0, else 2. Rows without a quality are left out; of several, the least counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _first_rows(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grade of each document by its id, the first row by its text's hash; without features none. Features are views of the table's."""
    ids, mixed, grades = (table.column(c).to_numpy() for c in ("doc_id", "mixed", "grade"))
    views = []
    for chunk in table.column("places").chunks:
        flat, at = chunk.values.to_numpy(), chunk.offsets.to_numpy().tolist()
        views += [flat[a:b] for a, b in zip(at, at[1:])]
    order = np.lexsort((mixed, ids))
    first = np.ones(len(ids), dtype=bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    keep = [k for k in order[first].tolist() if len(views[k])]
    return [views[k] for k in keep], grades[keep].astype(int)


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """The model for at most `sample` rated documents, taken by a hash of their id. docs: doc_id, text.

    Of rows that repeat an id one counts: the first by its text's hash.
    """
    chosen = bounded(ratings, "rated", F.col("doc_id"), sample)
    # At most `sample` rows of two numbers.
    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text")

    def make():
        words = _Words()

        def run(texts: list[str]) -> dict:
            return {"places": [features(t, words) for t in texts], "mixed": [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in texts]}

        return run

    def fitted(table: pa.Table) -> pa.Table:
        let_go()
        model = fit(*_first_rows(table))
        return pa.table({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tolist()]})

    rows = map_texts(rated, make, "places array<int>, mixed long").join(F.broadcast(chosen), "doc_id")
    # At most `sample` rows of a few hundred numbers meet in one task; the weights are a fixed size.
    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: fitted(t.drop_columns(["all"]) if "all" in t.column_names else t), "weights binary, thresholds array<double>").collect()
    return Model(np.frombuffer(found[0].weights, np.float32), np.array(found[0].thresholds)) if found else fit([], np.zeros(0, int))


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``(doc_id, expected_grade, p_good, kept)`` for every row of `docs`, over whole texts.

    kept: P(best grade) is at least `keep`. A null text, or one without words, has grade 0 and isn't kept. Repeated rows
    stay and agree; a null id stays null. Extra columns are left out; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # a fixed size

    def make():
        weights, thresholds = sent.value
        words, m = _Words(), Model(weights, thresholds)

        def run(texts: list[str]) -> dict:
            found = [features(t, words) for t in texts]
            tails = m.tails(np.array([float(weights[f].sum(dtype=np.float64)) for f in found]))
            tails[[not len(f) for f in found]] = 0.0
            return {"expected_grade": tails.sum(axis=1), "p_good": tails[:, -1], "kept": tails[:, -1] >= keep}

        return run

    return map_texts(docs, make, "expected_grade double, p_good double, kept boolean", id_col=id_col, text_col=text_col)


def select(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of `docs`, all columns, that `grade` keeps; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # a fixed size

    def make():
        weights, thresholds = sent.value
        words, m = _Words(), Model(weights, thresholds)

        def run(texts: list[str]) -> list[bool]:
            found = [features(t, words) for t in texts]
            tails = m.tails(np.array([float(weights[f].sum(dtype=np.float64)) for f in found]))[:, -1]
            return [bool(len(f) and p >= keep) for f, p in zip(found, tails)]

        return run

    return filter_texts(docs, make, text_col)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade(docs, train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
