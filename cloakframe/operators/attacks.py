"""Attack-risk measurement: linkage, membership and attribute inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as roles
from ..functions.randomness import bits, normal, uniform
from ..functions.scoring import advantage_level, level_tenths, messages, record_similarity
from ..session import materialize
from .columns import apply_codes, equal_width_bin, fit_codes, fit_scale, impute
from .distances import MEMBERSHIP_SAMPLE, membership_features
from .domains import MAX_BROADCAST, Domain
from .joins import lookup
from .neighbors import nearest
from .stats import numeric_summary

LINK_THRESHOLD = 0.8
FOREST_ALONE = 131_072  # rows up to which a forest takes the partitions it finds
FOREST_ROWS = 65_536  # rows of a task beyond that: with 100 trees the forest keeps about 500 bytes a row in memory


# ---- keyed samples -----------------------------------------------------------------


def exact_sample(df: DataFrame, n: int, key: Sequence[str], salt: str, stream: str = "sample") -> DataFrame:
    """Exactly ``n`` rows, those with the smallest keyed uniforms, without sorting the table.

    The cut-off is narrowed by two histograms of 65,536 buckets, so at the end
    only about rows / 2^32 candidates are looked at one by one.
    """
    draw = bits(salt, stream, key)
    if n <= 0:
        return df.limit(0)
    tagged = df.select(draw.alias("_b"), *key)

    def cut(rows: DataFrame, shift: int, need: int) -> tuple[int, int] | None:
        slots = F.shiftright("_b", shift).bitwiseAND(F.lit(0xFFFF)).alias("s")
        found = sorted((r["s"], r["n"]) for r in rows.groupBy(slots).agg(F.count(F.lit(1)).alias("n")).collect())
        for slot, size in found:
            if size >= need:
                return slot, need
            need -= size
        return None

    first = cut(tagged, 36, n)
    if first is None:
        return df
    inside = tagged.filter(F.shiftright("_b", 36) == first[0])
    second = cut(inside, 20, first[1])
    prefix = (first[0] << 16) | second[0]
    last = inside.filter(F.shiftright("_b", 20) == prefix).collect()
    chosen = sorted(tuple(r) for r in last)[: second[1]]
    edge = chosen[-1][0]
    same_draw = [r for r in chosen if r[0] == edge]
    at_edge = F.lit(False)
    for row in same_draw:
        is_row = F.lit(True)
        for c, v in zip(key, row[1:]):
            is_row = is_row & (F.col(c) == F.lit(v))
        at_edge = at_edge | is_row
    return df.filter((draw < F.lit(edge)) | ((draw == F.lit(edge)) & at_edge))


def auxiliary_sample(df: DataFrame, ratio: float, key: Sequence[str], salt: str) -> DataFrame:
    """What the attacker knows: int(rows * ratio) rows without replacement."""
    return exact_sample(df, int(df.count() * ratio), key, salt, "aux")


# ---- linkage -----------------------------------------------------------------------


def attack_ready(
    df: DataFrame, codes_from: DataFrame | None, columns: Sequence[str], codes: dict[str, Domain] | None = None
) -> tuple[DataFrame, dict[str, Domain]]:
    """Nulls filled (text ``missing``, numbers median), categories replaced by sorted codes, unseen ones by -1."""
    texts = [c for c in roles.categorical_columns(df) if c in columns]
    numbers = [c for c in roles.numeric_columns(df) if c in columns]
    missing = {c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in texts}
    filled = df.withColumns(missing) if missing else df
    filled = impute(filled, numbers) if numbers else filled
    if codes is None:
        base = codes_from if codes_from is not None else df
        codes = {c: fit_codes(base.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("missing"))), c) for c in texts}
    for c in texts:
        if c in codes:
            filled = apply_codes(filled, c, codes[c], f"_code_{c}").withColumn(c, F.col(f"_code_{c}")).drop(f"_code_{c}")
    return filled, codes


def _unit(columns: Sequence[str], scale) -> Column:
    z = [scale.column(c) for c in columns]
    norm = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    return F.when(norm > 0, F.array(*[v / norm for v in z])).otherwise(F.array(*[F.lit(0.0) for _ in z]))


def linkage_vectors(aux: DataFrame, derived: DataFrame, original: DataFrame, columns: Sequence[str], key: str):
    """Unit vectors of both sides: codes fitted on the original, z-scores on the auxiliary rows."""
    keep = [key, *columns]
    a, codes = attack_ready(aux.select(*keep), original, columns)
    numeric_change = [c for c in columns if c not in codes and c in roles.categorical_columns(derived)]
    d, _ = attack_ready(derived.select(*keep), None, columns, codes)
    for c in numeric_change:
        d = d.withColumn(c, F.lit(-1.0))
    scale = fit_scale(a, columns)
    return (
        materialize(a.select(F.col(key).alias("qid"), _unit(columns, scale).alias("vec")), "auxvectors"),
        materialize(d.select(F.col(key).alias("rid"), _unit(columns, scale).alias("vec")), "refvectors"),
    )


def linkage_scores(aux: DataFrame, derived: DataFrame, original: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``(qid, rid, score)``: the derived row with the highest cosine similarity to each auxiliary row."""
    return best_links(*linkage_vectors(aux, derived, original, columns, key))


def best_links(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Best match by cosine. On unit vectors the largest cosine is the smallest distance,
    so this is the exact nearest-neighbour join. A row without direction scores 0 with everything.
    """
    directed = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) > 0
    found = nearest(queries.filter(directed), refs.filter(directed))
    scored = found.select("qid", "rid", (F.lit(1.0) - F.col("distance") * F.col("distance") / F.lit(2.0)).alias("score"))
    lows = refs.agg(F.min("rid").alias("lowest"), F.min(F.when(~directed, F.col("rid"))).alias("flat")).first()
    flat, lowest = lows["flat"], lows["lowest"]
    if flat is not None:
        better = F.col("score") < 0
        scored = scored.withColumn("rid", F.when(better, F.lit(flat)).otherwise(F.col("rid")))
        scored = scored.withColumn("score", F.greatest("score", F.lit(0.0)))
    undirected = queries.filter(~directed).select("qid", F.lit(lowest).alias("rid"), F.lit(0.0).alias("score"))
    return scored.unionByName(undirected)


def mean_similarity(queries: DataFrame, refs: DataFrame, width: int) -> float:
    """Mean cosine over all pairs = dot product of the two mean unit vectors: no pair is formed."""
    mean = lambda df: df.agg(*[F.avg(F.col("vec")[i]).alias(f"m{i}") for i in range(width)]).first()
    a, b = mean(queries), mean(refs)
    return float(sum((x or 0.0) * (y or 0.0) for x, y in zip(a, b)))


def matched_similarity(left: DataFrame, right: DataFrame, columns: Sequence[str], l_prefix: str, r_prefix: str) -> Column:
    """Similarity expression over two prefixed copies of the same columns."""
    numeric, categorical = [], []
    for c in columns:
        both = (F.col(l_prefix + c), F.col(r_prefix + c))
        if roles.is_numeric(left.schema[c].dataType) and roles.is_numeric(right.schema[c].dataType):
            numeric.append(both)
        else:
            categorical.append((both[0].cast("string"), both[1].cast("string")))
    return record_similarity(numeric, categorical)


def prefixed(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def linkage_risk(
    original: DataFrame,
    derived: DataFrame,
    columns: Sequence[str],
    key: str,
    salt: str,
    ratio: float = 0.1,
    threshold: float = LINK_THRESHOLD,
) -> DataFrame:
    """Share of auxiliary rows whose best match is a near-identical record, in one row."""
    aux = materialize(auxiliary_sample(original, ratio, [key], salt), "aux")
    queries, refs = linkage_vectors(aux, derived, original, columns, key)
    attempts = min(aux.count(), derived.count())
    tried = aux if aux.count() == attempts else exact_sample(aux, attempts, [key], salt, "aux")
    best = materialize(best_links(queries, refs), "links")
    average = mean_similarity(queries, refs, len(columns))
    links = best.join(prefixed(tried, [key, *columns], "a_"), F.col("qid") == F.col(f"a_{key}"))
    # one derived record may be the best match of very many rows, hence the hot-key lookup
    uses = best.groupBy("rid").agg(F.count(F.lit(1)).alias("uses"))
    used = prefixed(derived, [key, *columns], "d_").join(uses, F.col(f"d_{key}") == F.col("rid"))
    table = used.select("rid", F.struct(*[f"d_{c}" for c in columns]).alias("match"), "uses")
    pairs = lookup(links, "rid", table, "match", "uses", attempts, MAX_BROADCAST, uses.count()).select("*", "match.*")
    correct = matched_similarity(original, derived, columns, "a_", "d_") >= F.lit(threshold)
    counted = pairs.withColumn("correct", correct.cast("int"))
    rate = F.try_divide(F.sum("correct").cast("double"), F.lit(attempts))
    return counted.agg(
        F.lit("linkage").alias("attack_type"),
        F.coalesce(rate, F.lit(0.0)).alias("success_rate"),
        F.lit(attempts).cast("bigint").alias("attempted_links"),
        F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("successful_links"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_similarity_score"),
        F.lit(average).alias("avg_similarity_score"),
    ).withColumn("risk_level", advantage_level(F.col("success_rate"), 0.3, 0.1))


# ---- membership --------------------------------------------------------------------


def non_member_rows(df: DataFrame, n: int, salt: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Records outside the data: numbers around min - 0.1 range, categories ``synthetic_{column}_{i}``."""
    columns = list(columns or df.columns)
    numbers = [c for c in roles.numeric_columns(df) if c in columns]
    summary = numeric_summary(df, numbers)
    out = df.sparkSession.range(n).withColumnRenamed("id", "row_id")
    for c in columns:
        if c in numbers and summary[c]["min"] is not None:
            low, width = summary[c]["min"], summary[c]["max"] - summary[c]["min"]
            value = F.lit(low - width * 0.1) + normal(salt, f"non:{c}", ["row_id"]) * F.lit(width * 0.5)
        else:
            value = F.concat(F.lit(f"synthetic_{c}_"), F.col("row_id").cast("string"))
        out = out.withColumn(c, value)
    return out


FEATURES = ["d_min", "d_mean", "d_std", "d_p25", "d_p75"]


def _dealt(vectors: DataFrame, rows: int) -> DataFrame:
    """``vectors`` in even tasks of about ``FOREST_ROWS``, each in a fixed order, whatever files they came from.

    The forest draws its bootstrap by partition and place, so the order has to be the same in every run.
    """
    if rows <= FOREST_ALONE:
        return vectors
    return vectors.repartition(-(-rows // FOREST_ROWS)).sortWithinPartitions("_u", "_label", vector_to_array("_features"))


def _forest(data: DataFrame, features: Sequence[str], label: str, salt: str, id_column: str, trees: int, classes: int):
    """Keyed 70/30 split, random forest; returns (accuracy, auc or None, importances)."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="_features").transform(data)
    vectors = vectors.select("_features", F.col(label).cast("double").alias("_label"), uniform(salt, "split", [id_column]).alias("_u"))
    vectors = materialize(vectors, "features")
    facts = vectors.agg(
        F.coalesce(F.max("_label"), F.lit(0.0)).alias("top"), F.count_if(F.col("_u") < 0.7).alias("seen"), F.count_if(F.col("_u") >= 0.7).alias("held")
    ).first()
    top = int(facts["top"]) + 1
    if top > 100:  # more labels than the classifier assumes by itself have to be declared
        vectors = vectors.withMetadata("_label", {"ml_attr": {"type": "nominal", "name": "_label", "num_vals": top}})
    model = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, seed=42).fit(_dealt(vectors.filter("_u < 0.7"), facts["seen"]))
    scored = model.transform(_dealt(vectors.filter("_u >= 0.7"), facts["held"]))
    accuracy = scored.agg(F.avg((F.col("prediction") == F.col("_label")).cast("double")).alias("a")).first()["a"]
    auc = None
    if classes == 2:
        auc = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="rawPrediction").evaluate(scored)
    return float(accuracy or 0.0), auc, [float(v) for v in model.featureImportances.toArray()]


def membership_risk(
    original: DataFrame, derived: DataFrame, columns: Sequence[str], key: str, salt: str,
    sample: int = MEMBERSHIP_SAMPLE, trees: int = 100,
) -> DataFrame:
    """How well a forest tells members from non-members by their distances to the derived table.

    The forest is fitted on a sample of at most ``sample`` labelled rows, half of either kind.
    """
    n = min(sample, original.count())
    members = exact_sample(original, n // 2, [key], salt, "member").select(F.col(key).cast("string").alias("qid"), *columns)
    outsiders = non_member_rows(original, n // 2, salt, columns).withColumn("qid", F.concat(F.lit("n"), F.col("row_id").cast("string")))
    parts = []
    for rows, label in ((members, 1.0), (outsiders, 0.0)):
        parts.append(membership_features(rows, derived, columns, "qid").withColumn("label", F.lit(label)))
    accuracy, auc, importance = _forest(parts[0].unionByName(parts[1]), FEATURES, "label", salt, "qid", trees, 2)
    row = [("membership", accuracy, auc, accuracy - 0.5, 0.5, n, dict(zip(FEATURES, importance)))]
    schema = "attack_type string, accuracy double, auc_score double, attack_advantage double, baseline_accuracy double, sample_size bigint, feature_importance map<string,double>"
    out = original.sparkSession.createDataFrame(row, schema)
    return out.withColumn("risk_level", advantage_level(F.col("attack_advantage"), 0.2, 0.1))


# ---- attribute ---------------------------------------------------------------------


def attribute_risk(
    derived: DataFrame, key: str, salt: str, targets: Sequence[str] | None = None, trees: int = 100
) -> DataFrame:
    """Accuracy of predicting each target column from the others, beyond guessing; one row per target."""
    columns = [c for c in derived.columns if c != key]
    targets = [t for t in (targets or [columns[-1]]) if t in columns]
    rows = []
    for target in targets:
        features = [c for c in columns if c != target]
        if not features:
            continue
        ready, _ = attack_ready(derived.select(key, *features, target).filter(F.col(target).isNotNull()), None, features)
        if target in roles.numeric_columns(derived):
            ready = equal_width_bin(ready, target, 5, "_target")
        else:
            ready = apply_codes(ready.withColumn(target, F.col(target).cast("string")), target,
                                fit_codes(derived.withColumn(target, F.col(target).cast("string")), target), "_target")
        scale = fit_scale(ready, features)
        ready = ready.select(key, "_target", *[scale.column(c).alias(c) for c in features])
        classes = ready.agg(F.count_distinct("_target").alias("k")).first()["k"]
        accuracy, auc, importance = _forest(ready, features, "_target", salt, key, trees, classes)
        baseline = 0.5 if classes <= 2 else 1.0 / classes
        rows.append((target, accuracy, baseline, accuracy - baseline, auc, dict(zip(features, importance))))
    schema = "target string, accuracy double, baseline_accuracy double, attack_advantage double, auc_score double, feature_importance map<string,double>"
    out = derived.sparkSession.createDataFrame(rows, schema)
    return out.withColumn("risk_level", advantage_level(F.col("attack_advantage"), 0.2, 0.1))


def attribute_summary(per_target: DataFrame) -> DataFrame:
    mean = F.coalesce(F.avg("attack_advantage"), F.lit(0.0))
    out = per_target.agg(F.lit("attribute").alias("attack_type"), mean.alias("attack_advantage"), F.count(F.lit(1)).alias("attributes_analyzed"))
    return out.withColumn("risk_level", advantage_level(F.col("attack_advantage"), 0.2, 0.1))


# ---- overall -----------------------------------------------------------------------


def overall_risk(attacks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean level score of the attacks; without any, 0.5."""
    score = F.coalesce(F.avg(level_tenths(F.col("risk_level"))) / F.lit(10.0), F.lit(0.5)).alias("overall_risk_score")
    return attacks.groupBy(*by).agg(score) if by else attacks.agg(score)


def risk_recommendations(levels: DataFrame, linkage: str, membership: str, attribute: str, overall: str) -> DataFrame:
    """Add ``recommendations`` from the three attack levels and the overall score."""
    link, member, attr, risk = F.col(linkage), F.col(membership), F.col(attribute), F.col(overall)
    # The advice given at each threshold.
    found = messages(
        (link == "high", "Consider increasing generalization of quasi-identifiers"),
        (link == "high", "Apply stronger statistical disclosure control"),
        (link == "medium", "Review quasi-identifier selection and apply targeted generalization"),
        (member == "high", "Decrease differential privacy epsilon budget"),
        (member == "high", "Apply stronger noise injection mechanisms"),
        (member == "medium", "Consider adjusting differential privacy parameters"),
        (attr == "high", "Apply stronger suppression of sensitive attributes"),
        (attr == "high", "Increase correlation disruption between features"),
        (attr == "medium", "Review correlation patterns and apply targeted perturbation"),
        (risk > 0.7, "Consider using stronger anonymization methods"),
        (risk > 0.7, "Reduce data granularity and increase aggregation"),
        ((risk > 0.4) & (risk <= 0.7), "Fine-tune privacy parameters for better protection"),
    )
    fine = F.array(
        F.lit("Current privacy protection appears adequate"), F.lit("Continue monitoring with periodic re-evaluation")
    )
    return levels.withColumn("recommendations", F.when(F.size(found) == 0, fine).otherwise(found))


ATTACKS = ("linkage", "membership", "attribute")


def assess_attacks(
    original: DataFrame,
    derived: DataFrame,
    columns: Sequence[str],
    key: str,
    salt: str,
    attacks: Sequence[str] = ATTACKS,
    ratio: float = 0.1,
    targets: Sequence[str] | None = None,
    trees: int = 100,
) -> DataFrame:
    """``(attack_type, score, risk_level)`` per attack; unknown names are skipped, and an error in an attack is raised, never a score."""
    out = None
    for name in [a.lower() for a in attacks if a.lower() in ATTACKS]:
        if name == "linkage":
            one = linkage_risk(original, derived, columns, key, salt, ratio).withColumnRenamed("success_rate", "score")
        elif name == "membership":
            one = membership_risk(original, derived, columns, key, salt, trees=trees).withColumnRenamed("attack_advantage", "score")
        else:
            per_target = attribute_risk(derived.select(key, *columns), key, salt, targets, trees)
            one = attribute_summary(per_target).withColumnRenamed("attack_advantage", "score")
        one = materialize(one.select("attack_type", "score", "risk_level"), name)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return original.sparkSession.createDataFrame([], "attack_type string, score double, risk_level string")
    return out
