"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are rates over the whole text: density of lexicon terms, their nearness to second-person words, capitals,
punctuation, and terms written with other signs. The lexicon is a fixed seed list and the terms that a bounded
sample of labelled rows marks. Trees and calibration are Spark ML's, fitted on rows that are not held out.
"""

from __future__ import annotations

import bisect
import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, first_by_hash, held_out, small_batches

#: Most labelled rows that the classifier is fitted on, and that terms are counted in. Both are bounds on training alone.
TRAIN_ROWS, LEXICON_ROWS = 20_000, 4_000
SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown filthy ugly hate kill shut fool imbecile vermin".split())
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur youre you're tu te toi vous votre vos du dich dir dein ihr euch usted ustedes tuyo vosotros".split())
STRIP = ".,;:!?\"'()[]{}<>«»“”‘’…*#%&$|-_~`/\\"
#: Signs that stand for letters in terms written otherwise.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": None, ".": None, "-": None, "_": None, "+": "t"})
#: Of each code point, whether it is upper-case.
UPPER = np.fromiter(map(str.isupper, map(chr, range(sys.maxunicode + 1))), bool)
FEATURES = (
    "lexicon_density", "lexicon_log", "lexicon_kinds", "seed_density", "window_share", "second_density", "near_second", "capital_rate", "capital_words",
    "exclaim_rate", "question_rate", "mark_rate", "digit_rate", "obfuscated_density", "mixed_words", "repeat_rate", "log_words",
)


def _capitals(text: str) -> int:
    """How many code points of the whole text are upper-case."""
    return int(np.count_nonzero(UPPER[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]))


def features_of(text: str, lexicon: frozenset) -> list[float]:
    """The feature vector of one whole text; all zeros for a text without words."""
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    hits, seconds, kinds, seeds, hidden, mixed = [], [], set(), 0, 0, 0
    for i, word in enumerate(text.lower().split()):
        w = word if word.isalpha() else word.strip(STRIP)
        if w in lexicon:
            hits.append(i)
            kinds.add(w)
            seeds += w in SEEDS
        elif w in SECOND_PERSON:
            seconds.append(i)
        elif not w.isalpha() and w:
            mixed += 1
            plain = word.translate(LEET).strip(STRIP)
            if plain != w and plain in lexicon:
                hidden += 1
                hits.append(i)
    near = 0.0
    for i in hits:
        k = bisect.bisect(seconds, i)
        gap = min((abs(i - j) for j in seconds[max(0, k - 1) : k + 1]), default=99)
        near += math.exp(-gap / 4)
    within, lo = 0, 0
    for hi in range(len(hits)):  # most hits within 30 words
        while hits[hi] - hits[lo] > 30:
            lo += 1
        within = max(within, hi - lo + 1)
    size = len(text)
    marks = sum(map(text.count, "*#%&$|@^~"))
    return [
        100 * len(hits) / n, math.log1p(len(hits)), float(len(kinds)), 100 * seeds / n, float(within), 100 * len(seconds) / n, near,
        _capitals(text) / size, sum(map(str.isupper, raw)) / n,
        100 * text.count("!") / size, 100 * text.count("?") / size, 100 * marks / size, sum(map(text.count, "0123456789")) / size,
        100 * hidden / n, mixed / n, 1 - len(set(raw)) / n, math.log1p(n),
    ]


def _featured(df: DataFrame, lexicon: frozenset) -> DataFrame:
    small_batches(df.sparkSession)

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: features_of(t, lexicon))

    return df.withColumn("_x", vector("text"))


@dataclass
class ToxicityModel:
    """What ``fit`` returns: lexicon, trees (None where labels have one class) and calibration steps."""

    lexicon: frozenset
    trees: GBTClassificationModel | None
    steps: list[tuple[float, float]]
    base: float

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with score (0 to 1) and predicted (1 where score >= 0.5); existing columns of these names are replaced."""
        docs = docs.drop("score", "predicted")
        if self.trees is None:
            out = docs.withColumn("score", F.lit(self.base))
        else:
            rows = _featured(docs, self.lexicon).withColumn("_v", array_to_vector("_x"))
            raw = self.trees.setFeaturesCol("_v").setPredictionCol("_p").setProbabilityCol("_q").setRawPredictionCol("_r").transform(rows)
            p = vector_to_array("_q")[1]
            # Isotonic steps, joined by lines; a hundredth of the trees' own probability keeps the order within a step.
            xs, ys = zip(*self.steps, strict=True)

            @F.pandas_udf("double")
            def curve(s: pd.Series) -> pd.Series:
                return pd.Series(np.interp(s, xs, ys))

            out = raw.withColumn("_s", p)
            out = out.withColumn("score", 0.99 * curve("_s") + 0.01 * F.col("_s")).drop("_x", "_v", "_p", "_q", "_r", "_s")
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _lexicon(rows: DataFrame, base: float) -> frozenset:
    """Terms that toxic rows hold far more often than others do, by document counts of a bounded sample: all that pass the test."""
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), 1))).alias("w"))
    n, t = F.count(F.lit(1)), F.sum("toxic")
    counts = words.groupBy("w").agg(n.alias("n"), t.alias("t")).filter("t >= 4")
    excess = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    found = counts.withColumn("z", excess).filter((F.col("z") > 5) & (F.col("t") > 0.5 * F.col("n")))
    return SEEDS | {r.w for r in found.select("w").collect()}


def curve_of(held: DataFrame) -> list[tuple[float, float]]:
    """Points of the isotonic curve of ``held`` (s, toxic): the ends of its steps, joined by lines."""
    iso = IsotonicRegression(labelCol="toxic", featuresCol="s").fit(held)
    xs, ys = list(iso.boundaries), list(iso.predictions)
    keep = [i for i in range(len(xs)) if i in (0, len(xs) - 1) or ys[i] != ys[i - 1] or ys[i] != ys[i + 1]]
    return [(float(xs[i]), float(ys[i])) for i in keep]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``train_rows`` labelled rows that are not held out, taken by a hash of their ids over the whole table.

    Labels of null count as absent; where several labels name a document, the largest holds. Without labels of
    both classes every score is the share of label 1 (0 with no labels).
    """
    usable = labels.select("doc_id", F.col("toxic").cast("double").alias("toxic")).dropna().filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = first_by_hash(usable, train_rows)
    sample = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id"))  # at most train_rows small rows
    n, t = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    base = t / n if n else 0.0
    if not 0 < base < 1:
        return ToxicityModel(SEEDS, None, [], base)
    lexicon = _lexicon(sample.orderBy(F.xxhash64("doc_id", F.lit(1))).limit(LEXICON_ROWS), base)
    rows = _featured(sample, lexicon).select("doc_id", "toxic", array_to_vector("_x").alias("_v"), (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0).alias("cal"))
    rows = cut(rows.coalesce(4))
    kinds = {(r.cal, r.toxic) for r in rows.select("cal", "toxic").distinct().collect()}
    whole = len(kinds) < 4  # too few rows for a part of their own
    trees = GBTClassifier(featuresCol="_v", labelCol="toxic", predictionCol="_p", maxIter=20, maxDepth=3, stepSize=0.3, seed=7, cacheNodeIds=False)
    trees = trees.setProbabilityCol("_q").setRawPredictionCol("_r").fit(rows if whole else rows.filter(~F.col("cal")))
    held = trees.transform(rows if whole else rows.filter("cal")).select("toxic", vector_to_array("_q")[1].alias("s"))
    return ToxicityModel(lexicon, trees, curve_of(held), base)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null and empty texts get the score of a zero vector; repeated rows each get their row; other columns are
    ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels)
    return model.score(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; the columns stay.

    Null and empty texts are scored as a zero vector; rows of null or repeated doc_id are scored each by itself;
    without labels of both classes nothing goes unless most labels are toxic; an empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return fit(docs, labels).score(rows).filter("predicted = 0").select("_row.*")
