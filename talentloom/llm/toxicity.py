"""Toxicity: gradient-boosted trees over dense features, calibrated.

Labelled rows outside the held-out third are sampled up to a documented bound
and dealt into folds by their family: the smallest hash of their word triples, which
near copies mostly share, so that these stay together and count once. The lexicon (word stems that toxic texts hold and clean ones do not) is cross-fitted:
a row's features for training come from the lexicon of the other folds, while
scoring uses the lexicon of all. A quarter of the rows, again by hash, fits the
isotonic calibration and the others train the trees. Features are built-in expressions over the
text alone: lexicon densities, second-person proximity, capitals, punctuation
and obfuscation rates. Scoring is a map over all rows, without a shuffle.

Edge cases: null and empty texts have zero features and get the score of such;
texts without labels are scored like others; labels given twice count once,
as toxic if any says so; null labels are ignored. Without labelled rows, or
with one class only, every score is that class's share (0 without rows).
Repeated rows get the same score. Extra columns that clash with feature names
are not carried; pass the wanted ones in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, stored, words

THRESHOLD = 0.7
#: Labelled rows that training reads at most (about): a sample by hash.
TRAIN_ROWS = 24_000
#: A stem enters the lexicon if at least so many toxic texts of its sample hold it
#: (a number, and a share of the toxic ones) ...
MIN_SUPPORT, MIN_SHARE = 4, 0.01
#: ... in the tier whose bound its share of toxic texts surely reaches (lower
#: end of a Wilson interval of three deviations).
TIERS = {"strong": 0.6, "middle": 0.42, "weak": 0.3}
DEVIATIONS = 3
STEM, LONGEST_STEM = 4, 9
TREES, DEPTH, SEED = 20, 3, 7

# A seed lexicon, pronouns of the second person, and characters
# that stand for letters in disguised words.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "ugly", "hate", "kill")
YOU = ("you", "your", "yours", "u", "ur", "tu", "toi", "vous", "votre", "ton", "ta", "du", "dich", "dir", "dein", "deine", "ihr", "sie", "te", "ti", "usted", "vos")
DISGUISE = ("013457@$", "oieastas")
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&|=/\\-_…«»„“”"
CAPITALS = "".join(map(chr, (*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF))))
FEATURES = (
    *(f"{tier}_{kind}" for tier in TIERS for kind in ("density", "count")),
    "seed_density", "near_you", "capitals", "marks", "disguised", "log_words",
)
FOLDS, CALIBRATE = 3, 4


def held_out(key: Column) -> Column:
    """The fold that is never learnt from: crc32 of the key's text leaves 1 by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def plain_words(text: Column) -> Column:
    """Words in lower case, punctuation dropped, disguises undone."""
    return words(F.translate(F.lower(text), PUNCTUATION + DISGUISE[0], " " * len(PUNCTUATION) + DISGUISE[1]))


def _starts(word: Column, stems: list[str]) -> Column:
    """Whether a word begins with one of ``stems``."""
    out = F.lit(False)
    for n in sorted({len(x) for x in stems}):
        out = out | F.substring(word, 1, n).isin([x for x in stems if len(x) == n])
    return out


def _hits(array: str, stems: list[str]) -> Column:
    """Number of words in a column of arrays that begin with one of ``stems``."""
    return F.size(F.filter(array, lambda x: _starts(x, stems)))


def features(df: DataFrame, lexicon: dict[str, list[str]], text: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns in ``keep`` and FEATURES of every row."""
    seeds = sorted({w[:STEM] for w in SEED_WORDS})
    tiers = {tier: lexicon.get(tier, []) for tier in TIERS}
    gate = sorted({x[:STEM] for known in tiers.values() for x in known} | set(seeds))
    alarm = sorted(set(tiers["strong"]) | set(seeds))
    you = F.array(*[F.lit(y) for y in YOU])
    body = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    body = body.select(
        *keep,
        plain_words(F.col("_t")).alias("_w"),
        F.length(F.translate("_t", SPACE_CHARS, "")).alias("_n"),
        (F.length("_t") - F.length(F.translate("_t", CAPITALS, ""))).alias("_caps"),
        (F.length("_t") - F.length(F.translate("_t", "!?*#$%&@", ""))).alias("_marks"),
        # The pattern is slow, and most texts hold none of its inner characters.
        F.when(F.length(F.translate("_t", "0134570@$*", "")) < F.length("_t"), F.regexp_count("_t", F.lit(r"\p{L}[0134570@$*]+\p{L}"))).otherwise(0).alias("_disguised"),
    )
    # Few words pass the gate, so that only they are compared with all stems.
    body = body.select("*", F.size("_w").alias("_words"), F.filter("_w", lambda x: F.substring(x, 1, STEM).isin(gate)).alias("_g"))
    beside = F.transform("_w", lambda x, i: F.substring(x, 1, STEM).isin(gate) & _starts(x, alarm) & F.arrays_overlap(F.slice("_w", F.greatest(i - 2, F.lit(1)), 7), you))
    body = body.select(
        "*",
        *[_hits("_g", known).alias(f"_{tier}") for tier, known in tiers.items()],
        F.size(F.filter("_g", lambda x: F.substring(x, 1, STEM).isin(seeds))).alias("_seed"),
        F.when(F.size("_g") > 0, F.size(F.filter(beside, lambda b: b))).otherwise(0).alias("_near"),
    )
    share = lambda x, by: F.coalesce(F.col(x) / F.when(F.col(by) > 0, F.col(by)), F.lit(0.0))
    columns = []
    for tier in TIERS:
        columns += [share(f"_{tier}", "_words"), F.least(F.col(f"_{tier}"), F.lit(9)).cast("double")]
    columns += [share("_seed", "_words"), share("_near", "_words"), share("_caps", "_n"), share("_marks", "_n"), share("_disguised", "_words")]
    columns.append(F.log1p(F.col("_words").cast("double")))
    return body.select(*keep, *[c.alias(name) for c, name in zip(columns, FEATURES, strict=True)])


@dataclass
class Model:
    """What scoring needs; ``constant`` replaces the rest where nothing was learnt."""

    lexicon: dict[str, list[str]]
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    constant: float = 0.0

    def score(self, df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The columns in ``keep`` and score double of every row."""
        if self.trees is None:
            return df.select(*keep, F.lit(self.constant).alias("score"))
        return _calibrated(self, features(df, self.lexicon, text, keep)).select(*keep, "score")


def _vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(df)


def _raw(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    trees.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p")
    return trees.transform(_vector(df)).withColumn("_raw", vector_to_array("_p")[1])


def _calibrated(model: Model, df: DataFrame) -> DataFrame:
    out = _raw(model.trees, df)
    if model.calibration is None:
        return out.withColumn("score", F.col("_raw"))
    return model.calibration.transform(out).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def family(text: Column) -> Column:
    """Smallest hash of a text's word triples (null and empty texts: 0)."""
    held = F.array(words(F.lower(text)))  # one element, so that the lambda's words are computed once
    least = F.transform(held, lambda w: F.array_min(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))
    return F.coalesce(F.get(least, F.lit(0)), F.lit(0))


def lexicons(rows: DataFrame) -> list[dict[str, list[str]]]:
    """Stems by tier: learnt from all ``rows`` (_text, _y, _family, _fold), then from all but each fold.

    Of each family one text a label counts: what near copies of one text share
    is no evidence for a word.
    """
    texts = rows.groupBy("_family", "_fold", "_y").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
    begun = F.transform(F.sequence(F.lit(STEM), F.lit(LONGEST_STEM)), lambda n: F.transform(F.filter("_w", lambda w: F.length(w) >= n), lambda w: F.substring(w, F.lit(1), n)))
    held = texts.select("_y", "_fold", F.array_distinct(plain_words(F.col("_text"))).alias("_w"))
    seen = held.select("_y", "_fold", F.explode(F.array_distinct(F.flatten(begun))).alias("stem"))
    left_out = (None, *range(FOLDS))
    counted = lambda k, what: F.sum(F.when(F.lit(k is None) | (F.col("_fold") != F.lit(k if k is not None else -1)), what).otherwise(0))
    toxic = texts.agg(*[counted(k, F.col("_y")) for k in left_out]).first()
    counts = seen.groupBy("stem").agg(*[c for i, k in enumerate(left_out) for c in (counted(k, F.col("_y")).alias(f"y{i}"), counted(k, F.lit(1)).alias(f"n{i}"))])
    z2 = DEVIATIONS**2
    lows = []
    for i in range(len(left_out)):
        y, n = F.col(f"y{i}"), F.col(f"n{i}")
        p = y / n
        low = (p + z2 / 2 / n - DEVIATIONS * F.sqrt((p * (1 - p) + z2 / 4 / n) / n)) / (1 + z2 / n)
        lows.append(F.when(y >= max(MIN_SUPPORT, MIN_SHARE * (toxic[i] or 0)), low).alias(f"low{i}"))
    # Each kept stem is in MIN_SHARE of the toxic texts, so the list is bounded by
    # the words of a text, not by the corpus.
    kept = counts.select("stem", *lows).filter(F.greatest(F.lit(0.0), *[f"low{i}" for i in range(len(lows))]) >= min(TIERS.values())).collect()
    out = [{tier: [] for tier in TIERS} for _ in left_out]
    for row in sorted(kept, key=lambda r: r["stem"]):
        for i, lexicon in enumerate(out):
            tier = next((t for t, bound in TIERS.items() if (row[f"low{i}"] or 0) >= bound), None)
            if tier:
                lexicon[tier].append(row["stem"])
    return out


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit lexicon, trees and calibration on labelled rows of ``df`` that are not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_y"))
    there = known.count()
    share = min(1.0, TRAIN_ROWS / there) if there else 1.0
    mark = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 30))
    known = known.filter(mark < F.lit(int(share * (1 << 30))))
    # At most TRAIN_ROWS narrow rows (in expectation), so the broadcast is bounded.
    rows = df.select(key, F.col(text).alias("_text")).join(F.broadcast(known), key)
    rows = rows.select("_text", "_y", family(F.col("_text")).alias("_family"))
    dealt = lambda n: F.pmod(F.xxhash64(F.lit(SEED + n), F.col("_family")), F.lit(n)).cast("int")
    rows = stored(rows.select("*", dealt(FOLDS).alias("_fold"), (dealt(CALIBRATE) == 0).alias("_check")), "toxicity-train")
    totals = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("y")).first()
    if not totals["n"] or totals["y"] in (0, totals["n"]):
        return Model({}, constant=float(totals["y"] or 0) / max(1, totals["n"]))
    whole, *others = lexicons(rows)
    parts = [features(rows.filter(F.col("_fold") == k), lexicon, "_text", ("_y", "_check")) for k, lexicon in enumerate(others)]
    ready = stored(reduce(DataFrame.unionByName, parts), "toxicity-features")
    grow, check = ready.filter(~F.col("_check")), ready.filter("_check")
    classes = grow.agg(F.min("_y"), F.max("_y")).first()
    if classes[0] == classes[1]:  # too few rows to split
        grow = check = ready
    trees = GBTClassifier(labelCol="_y", featuresCol="_x", maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(_vector(grow))
    model = Model(whole, trees)
    ends = check.agg(F.min("_y"), F.max("_y")).first()
    if ends[0] != ends[1]:
        held = _raw(trees, check).select(F.col("_y").cast("double").alias("_y"), "_raw")
        model.calibration = IsotonicRegression(labelCol="_y", featuresCol="_raw", predictionCol="score").fit(held)
    return model


def score_toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted (1 from THRESHOLD on) of every row."""
    scored = train(df, labels, key, text).score(df, text, (key,))
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
