"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of two lexicons, how near second-person words stand to their terms,
capitals, punctuation and obfuscation rates. One lexicon is fixed, the other is learned: opening
letters of words (stems, as languages inflect) that far more toxic than other texts hold. The
labelled sample is cut in three by a hash of the id, so that no text is used twice: one part gives the
lexicon, one fits Spark's boosted trees, one calibrates their margins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality import is_held_out, lowest_hashes
from tessera.session import durable

#: Insults in four languages, and words of the second person.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass fool loser losers scum trash garbage clown pathetic worthless disgusting filthy ugly vermin pig pigs rat "
    "imbecile cretin freak creep bastard bitch whore slut asshole jerk shit shut kill die hate "
    "crétin connard connasse salaud salope abruti débile ordure pourriture stupide dégoûtant minable "
    "trottel idioten dummkopf arschloch schlampe abschaum dreckskerl blödmann widerlich erbärmlich wertlos "
    "imbécil estúpido estúpida tonto basura asqueroso escoria payaso inútil cabrón gilipollas".split()
)
YOU = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer ihr sie usted ustedes ti contigo vosotros".split())

FEATURES = (
    "words", "chars", "insults", "distinct_insults", "stem_weight", "strong_stems", "weak_stems", "distinct_stems", "heaviest_stem", "second_heaviest", "you", "near_you",
    "capitals", "shouted", "exclamations", "questions", "piled_marks", "symbols", "digits_in_words", "hidden_hits", "split_words", "stretched",
)
_LETTERS = re.compile(r"[^\W\d_]+")
_PILED = re.compile(r"[!?]{2,}")
#: Words written letter by letter: four single letters in a row or more.
_SPELT = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){3,}(?!\S)")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_HIDES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", ".": None, "-": None, "_": None, "*": None, "'": None})
_EDGES = ".,;:!?\"'()[]{}<>#$%&*+-/=@^_`|~¿¡«»„“”…"
_STEM = range(3, 9)
_BATCH = 512


def stems(word: str) -> set[str]:
    """A word's openings of 3 to 8 letters, and itself with its end marked."""
    return {word[:n] for n in _STEM if n <= len(word)} | {word + "|"}


class Words:
    """Looks up written words; what most of them are, nothing of note, is None.

    Otherwise (weight of its heaviest stem, fixed insult, second person, found only once
    undisguised, capitals, shouted, digits among letters, stretched, single letter, the word in plain).
    """

    def __init__(self, weights: dict[str, float], most: int = 200_000):
        self.weights, self.most, self.memo = weights, most, {}
        self.heads = {s[:3] for s in weights}

    def weight(self, word: str) -> float:
        # no stem is shorter than three letters, its end mark included
        return max(self.weights.get(s, 0.0) for s in stems(word)) if (word + "|")[:3] in self.heads else 0.0

    def look(self, token: str) -> tuple | None:
        if len(self.memo) >= self.most:
            self.memo.clear()
        low = token.lower()
        core = low.strip(_EDGES)
        word = core if core.isalpha() else ""
        stretched = _STRETCHED.search(core) is not None
        weight, insult, hidden, mixed = self.weight(word) if word else 0.0, word in INSULTS, False, False
        if not word and core or stretched:
            bare = _STRETCHED.sub(r"\1", low.rstrip(".,;:!?").translate(_HIDES)).strip(_EDGES)
            if bare.isalpha() and len(bare) > 2:
                weight, insult = max(weight, self.weight(bare)), insult or bare in INSULTS
                hidden = weight > 0 or insult
            mixed = any(map(str.isdigit, core)) and any(map(str.isalpha, core))
        caps = 0 if token == low else sum(map(str.isupper, token))
        found = (weight, insult, word in YOU, hidden, caps, caps > 2 and token.isupper(), mixed, stretched, len(core) == 1, core)
        self.memo[token] = found = found if any(found[:-1]) else None
        return found


def text_features(text: str, words: Words) -> list[float]:
    """FEATURES of a whole text; an empty one has zeros."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    memo, look = words.memo, words.look
    insults = strong = weak = yous = hidden = caps = shouted = mixed = stretched = singles = 0
    weight, heavy, rude, hits, you_at = 0.0, {}, set(), set(), set()
    for token, c in Counter(tokens).items():
        found = memo[token] if token in memo else look(token)
        if found is None:
            continue
        w, insult, you, hid, upper, loud, mix, long, single, core = found
        caps, shouted, mixed, stretched, singles = caps + c * upper, shouted + c * loud, mixed + c * mix, stretched + c * long, singles + c * single
        if w or insult:
            weight, insults, hidden = weight + c * w, insults + c * insult, hidden + c * hid
            strong, weak = strong + c * (w >= 4), weak + c * (0 < w < 4)
            hits.add(token)
            if w:
                heavy[core] = max(w, heavy.get(core, 0.0))
            if insult:
                rude.add(core)
        if you:
            yous += c
            you_at.add(token)
    near = 0.0
    if hits and you_at:
        at = np.array([i for i, t in enumerate(tokens) if t in you_at])
        marks = np.array([i for i, t in enumerate(tokens) if t in hits])
        right = np.searchsorted(at, marks)
        gap = np.minimum(np.abs(marks - at[np.minimum(right, len(at) - 1)]), np.abs(marks - at[np.maximum(right - 1, 0)]))
        near = float((gap <= 4).sum())
    spelt = [m.lower().replace(" ", "") for m in _SPELT.findall(" ".join(tokens))] if singles >= 4 else []
    hidden += sum(words.weight(w) > 0 or w in INSULTS for w in spelt)
    top = sorted(heavy.values())[-2:]
    letters = len("".join(tokens))
    rate = lambda *v: [x / n for x in v]
    return [
        np.log1p(n), np.log1p(len(text)), insults / n, np.log1p(len(rude)), *rate(weight, strong, weak), np.log1p(len(heavy)), top[-1] if top else 0.0, top[0] if len(top) > 1 else 0.0,
        *rate(yous, near), caps / letters, *rate(shouted, text.count("!"), text.count("?"), len(_PILED.findall(text))), sum(map(text.count, "#$%&*@")) / letters,
        *rate(mixed, hidden, len(spelt), stretched),
    ]


class ToxicityModel:
    """Stem weights, trees as nested (feature, cut, left, right) with their weights, and the calibration's corners."""

    def __init__(self, weights: dict[str, float], trees: list, shares: list[float], corners: tuple[list[float], list[float]]):
        self.weights, self.trees, self.shares, self.corners = weights, trees, shares, corners

    def margin(self, x: np.ndarray) -> np.ndarray:
        def grow(node, rows: np.ndarray, out: np.ndarray) -> None:
            if isinstance(node, float):
                out[rows] = node
            else:
                feature, cut, left, right = node
                below = x[rows, feature] <= cut
                grow(left, rows[below], out)
                grow(right, rows[~below], out)

        total, out = np.zeros(len(x)), np.zeros(len(x))
        for tree, share in zip(self.trees, self.shares):
            grow(tree, np.arange(len(x)), out)
            total += share * out
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; equal for equal texts."""
        return np.clip(np.interp(self.margin(x), *self.corners), 0, 1)


def _tree(node) -> tuple | float:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _with_features(rows: DataFrame, schema: str, kept: list[str], weights: dict[str, float], score=None) -> DataFrame:
    """``kept`` columns and, from the text after them, its features or its score."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Words(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                x = np.array([text_features(t or "", words) for t in part.column(len(kept)).to_pylist()]).reshape(part.num_rows, len(FEATURES))
                last = pa.array(list(x), type=pa.list_(pa.float64())) if score is None else pa.array(score(x))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], last], names=[*kept, "value"])

    return rows.mapInArrow(run, schema)


def learn_stems(rows: DataFrame, most: int = 3000, support: int = 4, certainty: float = 3.0) -> dict[str, float]:
    """Log-odds of the stems that stand in more of the toxic texts of ``rows`` (toxic, text), by at least ``certainty`` standard errors.

    A stem needs ``support`` toxic texts; the ``most`` certain ones are kept. Texts are counted
    per task before the shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(found: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"stem": pa.array(list(found), pa.string()), "bad": pa.array([v[1] for v in found.values()], pa.int64()), "good": pa.array([v[0] for v in found.values()], pa.int64())})

        found: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen = set()
                for word in set(_LETTERS.findall((text or "").lower())):
                    seen |= stems(word)
                for s in seen:
                    found.setdefault(s, [0, 0])[toxic] += 1
                if len(found) > 100_000:
                    yield made(found)
                    found = {}
        yield made(found)

    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = F.col("bad"), F.col("good")
    odds = F.log((bad + 0.5) / (sizes.get(1, 0) + 1)) - F.log((good + 0.5) / (sizes.get(0, 0) + 1))
    counted = rows.select("toxic", "text").mapInArrow(run, "stem string, bad bigint, good bigint").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sure = counted.filter(bad >= support).select("stem", odds.alias("odds"), (odds / F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))).alias("z")).filter(F.col("z") >= certainty)
    return {r.stem: r.odds for r in sure.orderBy(F.desc("z"), "stem").limit(most).collect()}


def train_model(docs: DataFrame, labels: DataFrame, toxic: int = 6000, other: int = 12_000, rounds: int = 20, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """Fit on at most ``toxic`` documents labelled 1 and ``other`` labelled 0, none of them held out: those of the smallest hashes.

    Half of them give the stems, three tenths fit the trees, two tenths calibrate. Where a part lacks texts
    of a label the trees take all of the sample, or the margins are calibrated by the logistic curve that the
    trees were fitted to; without both labels at all there is no model.
    """
    fitting = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("id")))
    of = lambda y, n: lowest_hashes(fitting.filter(F.col("toxic") == y).select("id"), n).withColumn("toxic", F.lit(y))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(10)).alias("part")
    wanted = of(1, toxic).union(of(0, other)).groupBy("id").agg(F.max("toxic").alias("toxic")).select("id", "toxic", part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id").select("id", "toxic", "part", "text")
    rows = durable(rows, "toxicity-sample")
    third = F.when(F.col("part") < 5, 0).when(F.col("part") < 8, 1).otherwise(2).alias("third")
    sizes = {(r["third"], r["toxic"]): r["count"] for r in rows.groupBy(third, "toxic").count().collect()}
    if not all(any(sizes.get((p, y), 0) for p in range(3)) for y in (0, 1)):
        return None
    enough = lambda p: min(sizes.get((p, 0), 0), sizes.get((p, 1), 0)) >= 10
    weights = learn_stems(rows.filter("part < 5"))
    kind = rows.schema["id"].dataType.simpleString()
    known = durable(_with_features(rows, f"id {kind}, toxic int, part bigint, value array<double>", ["id", "toxic", "part"], weights), "toxicity-features")
    fit = known.filter("part >= 5 AND part < 8") if enough(1) else known
    # one task reads the bounded sample in a fixed order, so the trees don't hang on how files were dealt
    fit = fit.orderBy("id", "toxic", "value").coalesce(1).select(F.col("toxic").cast("double").alias("label"), array_to_vector("value").alias("features"))
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5 if enough(1) else 1, seed=1).fit(fit)
    trees = [_tree(t._call_java("rootNode")) for t in fitted.trees]
    model = ToxicityModel(weights, trees, list(fitted.treeWeights), ([0.0], [0.0]))
    ends = np.linspace(-3, 3, 121)
    model.corners = (ends.tolist(), (1 / (1 + np.exp(-2 * ends))).tolist())
    if enough(2):
        held = known.filter("part >= 8").select(F.col("toxic").cast("double").alias("label"), "value").toArrow()
        margins = model.margin(np.array(held.column("value").to_pylist()))
        pairs = docs.sparkSession.createDataFrame([*zip(margins.tolist(), held.column("label").to_pylist())], "features double, label double")
        curve = IsotonicRegression().fit(pairs)
        model.corners = ([float(x) for x in curve.boundaries], [float(x) for x in curve.predictions])
    return model


def score_documents(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per document; without a model every score is 0. A null text is an empty one, equal texts score alike, repeated rows stay repeated."""
    score = (lambda x: np.zeros(len(x))) if model is None else model.score
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _with_features(docs.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kind}, value double", [id_col], model.weights if model else {}, score)
    return rows.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), F.col("value").alias("score"), (F.col("value") >= 0.5).cast("int").alias("predicted"))
