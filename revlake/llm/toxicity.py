"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

#: At most so many labelled rows are used to fit: words, trees and calibration.
FIT_ROWS = 20_000
#: Words whose presence speaks for the label in the fitting rows, besides the seed words.
LEARNED_WORDS = 200
THRESHOLD = 0.3
NEAR = 6  # words

#: Common insults, and forms of the second person.
SEED = frozenset("idiot idiots moron morons stupid dumb scum trash garbage pathetic worthless disgusting loser losers clown clowns imbecile fool vermin filth freak pig hate kill idiota estúpido imbécil basura idioten dummkopf abschaum müll crétin ordure connard".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tus su".split())
#: Signs written for letters.
LEET = str.maketrans("013457@$!", "oieastasi")

_MARKS = re.compile(r"[^\w\s]+")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")
_HIDDEN = re.compile(r"[^\W\d_]+[*@$!#0-9]+[^\W\d_]+|([^\W\d_])\1{2,}")
FEATURES = ("log_words", "seed_density", "seed_any", "learned_density", "learned_any", "near_second_person", "second_person_rate", "capital_rate", "shouted_rate", "mark_rate", "exclaim_rate", "hidden_rate", "hidden_seed")


def features(text: str, learned: frozenset[str]) -> list[float]:
    """FEATURES of a text; an empty one has zeros."""
    raw = text.split()
    n, chars = max(len(raw), 1), max(len(text), 1)
    words = _MARKS.sub(" ", text.lower()).split()
    seed = [k for k, w in enumerate(words) if w in SEED]
    known = [k for k, w in enumerate(words) if w in learned]
    second = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if second and (hits := sorted({*seed, *known})):
        spots = set(second)
        near = sum(any(k + d in spots for d in range(-NEAR, NEAR + 1)) for k in hits)
    hidden = [m.group().lower() for m in _HIDDEN.finditer(text)]
    plain = sum(h.translate(LEET) in SEED or h.replace("*", "") in SEED for h in hidden)
    m = max(len(words), 1)
    return [math.log1p(len(raw)), len(seed) / m, float(len(seed)), len(known) / m, float(len(known)), near / m, len(second) / m, len(_CAPITALS.findall(text)) / chars, sum(map(str.isupper, raw)) / n, sum(map(len, _MARKS.findall(text))) / chars, text.count("!") / n, len(hidden) / n, float(plain)]


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, mod 4: 2 is held out, 3 calibrates, 0 and 1 fit the words and trees. A null id is in 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def _featured(rows: DataFrame, learned: list[str]) -> DataFrame:
    words = rows.sparkSession.sparkContext.broadcast(frozenset(learned))

    @F.pandas_udf("array<double>")
    def dense(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([features(t, words.value) for t in texts])

    return rows.withColumn("x", dense("text"))


def _learn_words(rows: DataFrame, most: int) -> list[str]:
    """Words of a few letters or more that stand in labelled texts far more often than in the others."""
    words = rows.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), 1))).alias("w"))
    total = rows.agg(F.sum("y").alias("a"), F.count("*").alias("b")).first()
    if not total["a"] or total["a"] == total["b"]:
        return []
    rate = total["a"] / total["b"]
    odds = F.log((F.col("a") + rate) / (F.col("b") + 1) / rate)
    found = words.groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("b")).filter("a >= 4").withColumn("odds", odds).filter("odds > 0.8")
    return [r["w"] for r in found.orderBy(F.desc(F.col("odds") * F.sqrt("a")), "w").limit(most).collect()]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The input's columns as struct row, and held_out, score (0 to 1), predicted.

    Labels are learned only from rows whose fold is not 2, at most fit_rows of them, chosen by a hash of the id. A null
    text counts as empty; empty texts get the score of zeros in all features. Without labels of both kinds every score
    is the labelled rows' mean (0 if there are none). Null labels or ids are not learned from; other columns of the
    inputs are never read. Repeated labels of an id count by their largest. Repeated rows repeat. An empty
    table gives no rows; texts of any length are read whole; ids that are no longs are cast.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").filter(fold("id") != 2)
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    all_rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # fit_rows bounds what is broadcast here
    fit = stage(all_rows.select("id", "text").join(F.broadcast(known), "id").dropDuplicates(["id"]).repartition(F.spark_partition_id() % 8), "toxic-fit")
    trees = fit.filter(fold("id") != 3)
    learned = _learn_words(trees, LEARNED_WORDS)
    fit = stage(_featured(fit, learned).select("id", "y", array_to_vector("x").alias("features")), "toxic-features")
    scored = _featured(all_rows, learned).withColumn("features", array_to_vector("x")).drop("x", "text")
    kinds = {r["y"]: r["n"] for r in fit.filter(fold("id") != 3).groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        mean = sum(y * n for y, n in kinds.items()) / max(sum(kinds.values()), 1)
        scored = scored.withColumn("score", F.lit(float(mean)))
    else:
        model = GBTClassifier(labelCol="y", maxIter=24, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=10, seed=7).fit(fit.filter(fold("id") != 3))
        raised = lambda df: model.transform(df).withColumn("raw", vector_to_array("rawPrediction")[1])
        held = raised(fit.filter(fold("id") == 3))
        scored = raised(scored)
        if held.agg(F.countDistinct("y").alias("n")).first()["n"] == 2:
            steps = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="calibrated").fit(held)
            # steps tie many texts: the tree sum orders them within a step
            scored = steps.transform(scored).withColumn("score", 0.98 * F.col("calibrated") + 0.02 / (1 + F.exp(-2 * F.col("raw"))))
        else:
            scored = scored.withColumn("score", vector_to_array("probability")[1])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select("row", (fold("id") == 2).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
