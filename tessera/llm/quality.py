"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled documents train an additive logistic model that minimises
the non-negative unbiased risk, prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]).
The class prior is estimated from the same two samples: where a positive-against-unlabelled
score is highest nearly all unlabelled texts are positive, so the smallest ratio of the
unlabelled to the positive share above a score estimates it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import bounded_batches

#: Features of a text, in order; labels, language, source and id are none of them.
FEATURES = (
    "words", "chars", "word_length", "short_words", "long_words", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "upper_words", "title_words",
    "symbols", "exclamations", "bars", "digits", "stops", "commas", "lines", "distinct_lines", "plain_words", "non_ascii",
)
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~/"
_BATCH = 512


def text_features(text: str) -> list[float]:
    """Features of a whole text; an empty one has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x]
    per_word = lambda c: data.count(c) / n
    return [
        np.log1p(n), np.log1p(len(text)), lengths.mean(), (lengths <= 3).mean(), (lengths >= 12).mean(), len(counts) / n**0.9, max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n, (pairs + 1) / n, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        (len(data) - len(data.translate(None, _SYMBOLS))) / size, per_word(b"!"), per_word(b"|"), (len(data) - len(data.translate(None, b"0123456789"))) / size,
        per_word(b"."), per_word(b","), len(lines) / n, len(set(lines)) / len(lines), sum(map(str.isalpha, words)) / n, 1 - len(text) / size,
    ]


class QualityModel:
    """An additive logistic model over quantile bins of the features."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.cuts, self.weights, self.bias, self.prior = cuts, weights, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_design(x, self.cuts) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cuts(x: np.ndarray, bins: int = 24) -> np.ndarray:
    # the tails get cuts of their own: junk is often a few percent at one end
    shares = np.concatenate([[0.002, 0.005, 0.01, 0.02, 0.03], np.linspace(0.05, 0.95, bins - 10), [0.97, 0.98, 0.99, 0.995, 0.998]])
    return np.quantile(x, shares, axis=0).T


def _design(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Each feature as how many cuts it has passed, one column a cut."""
    return (x[:, :, None] > cuts[None]).reshape(len(x), -1).astype(np.float32)


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores; the large matrix stays in single precision, a wider vector would copy it."""
    return (x @ w[:-1].astype(np.float32)).astype(np.float64) + w[-1]


def _back(g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean gradient of the weights and the bias from those of the scores."""
    return np.append((g.astype(np.float32) @ x).astype(np.float64), g.sum()) / len(x)


def _descend(gradient, size: int, steps: int, rate: float) -> tuple[np.ndarray, float]:
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], w[-1]


def estimate_prior(p: np.ndarray, u: np.ndarray, penalty: float) -> float:
    """Share of positives among the unlabelled, from positive-against-unlabelled models fitted on one half and read on the other."""
    cuts, found = _cuts(np.concatenate([p, u])), []
    for fit, read in ((0, 1), (1, 0)):
        a, b = _design(p[fit::2], cuts), _design(u[fit::2], cuts)

        def gradient(w, a=a, b=b):
            gp, gu = _sigmoid(_times(a, w)) - 1, _sigmoid(_times(b, w))
            return _back(gp, a) + _back(gu, b) + np.append(penalty * w[:-1], 0)

        w, bias = _descend(gradient, a.shape[1], 150, 0.05)
        sp, su = (np.sort(_times(_design(x[read::2], cuts), np.append(w, bias))) for x in (p, u))
        # scores that at least half of the positives reach: below that the ratio is mostly noise
        at = np.quantile(sp, np.linspace(0, 0.5, 51))
        above = lambda s: 1 - np.searchsorted(s, at, side="left") / len(s)
        # a prior above the truth leaves junk no room in the risk, so take a lower confidence bound
        found.append((above(su) / above(sp)).min() - 0.5 / np.sqrt(len(sp)) - 0.5 / np.sqrt(len(su)))
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit_model(p: np.ndarray, u: np.ndarray, prior: float | None = None, penalty: float = 1e-3, steps: int = 300) -> QualityModel:
    """Minimise the non-negative unbiased risk (logistic loss) over positives ``p`` and unlabelled ``u``."""
    prior = estimate_prior(p, u, penalty) if prior is None else prior
    cuts = _cuts(np.concatenate([p, u]))
    a, b = _design(p, cuts), _design(u, cuts)

    def gradient(w):
        fp, fu = _times(a, w), _times(b, w)
        down_p, up_p, up_u = _sigmoid(fp) - 1, _sigmoid(fp), _sigmoid(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        unlabelled = _back(up_u, b) - prior * _back(up_p, a)
        # a negative part below zero is overfit: step back up along it instead
        g = prior * _back(down_p, a) + unlabelled if negative >= 0 else -unlabelled
        return g + np.append(penalty * w[:-1], 0)

    w, bias = _descend(gradient, a.shape[1], steps, 0.03)
    # the risk hardly fixes where between the two groups the scores cross 1/2: put it at the lower
    # end of the trusted positives if it lies below that
    lowest = np.quantile(_times(a, np.append(w, bias)), 0.002)
    return QualityModel(cuts, w, bias - max(0.0, lowest), prior)


def is_held_out(key: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; a row without an id is not one."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _features(rows: DataFrame, schema: str, kept: list[str], score=None) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                x = np.array([text_features(t or "") for t in part.column(len(kept)).to_pylist()]).reshape(part.num_rows, len(FEATURES))
                last = pa.array(list(x), type=pa.list_(pa.float64())) if score is None else pa.array(score(x))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], last], names=[*kept, "value"])

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def lowest_hashes(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` distinct ids of the smallest hashes.

    The (approximate) number of ids gives a bound of the hash below which some more than
    ``n`` lie, whatever the table's size; only those are sorted. Hashes spread evenly, so
    fewer than ``n`` are below it only where there are fewer ids.
    """
    mixed = F.xxhash64("id", F.lit("fit"))
    many = ids.agg(F.approx_count_distinct("id", 0.02)).first()[0]
    bound = int(min(1.0, 1.1 * (n + 8 * n**0.5 + 64) / max(1, many)) * 2**64) - 2**63 - 1
    return ids.filter(mixed <= F.lit(bound)).distinct().orderBy(mixed, "id").limit(n)


def train_model(docs: DataFrame, labels: DataFrame, positives: int = 8000, unlabelled: int = 12000, id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    """Fit on at most ``positives`` documents with quality 1 and ``unlabelled`` documents, none of them held out.

    Both are those of the smallest hash of their id. Without either there is no model.
    """
    fitting = lambda rows: rows.filter(F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    trusted = lowest_hashes(fitting(labels.filter("quality = 1").select(F.col(id_col).alias("id"))), positives).withColumn("positive", F.lit(True))
    web = lowest_hashes(fitting(docs.select(F.col(id_col).alias("id"))), unlabelled).withColumn("positive", F.lit(False))
    wanted = F.broadcast(trusted.union(web).distinct())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id").select("positive", "text")
    found = _features(rows, "positive boolean, value array<double>", ["positive"]).toArrow()
    kind, values = found.column(0).to_numpy(), found.column(1).combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    ordered = lambda x: x[np.lexsort(x.T[::-1])]
    p, u = ordered(values[kind.astype(bool)]), ordered(values[~kind.astype(bool)])
    if min(len(p), len(u)) < 4:
        return None
    order = np.random.default_rng(0)
    return fit_model(order.permutation(p), order.permutation(u))


def score_documents(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per document; without a model every score is 0.5. A null text is an empty one."""
    score = (lambda x: np.full(len(x), 0.5)) if model is None else model.score
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _features(docs.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kind}, value double", [id_col], score)
    return rows.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), F.col("value").alias("score"), (F.col("value") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns."""
    score = (lambda x: np.full(len(x), 0.5)) if model is None else model.score

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):  # a batch's texts are never all in Python at once
                part = batch.slice(at, _BATCH)
                x = np.array([text_features(t or "") for t in part.column(at_text).to_pylist()]).reshape(part.num_rows, len(FEATURES))
                yield part.filter(pa.array(score(x) >= threshold))
        pa.default_memory_pool().release_unused()

    bounded_batches(docs.sparkSession)
    at_text = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
