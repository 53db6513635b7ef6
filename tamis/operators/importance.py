"""Feature relevance against a target: A12 mutual information (binned), A13 F-scores,
A14 forest importance, A15 cross-validated impact of new features, A9 MI ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tamis.functions.exprs import nan_as_null
from tamis.operators.base import col, one_row
from tamis.operators.features import bin_code, quantile_edges
from tamis.session import reliable_checkpoint as settled


def is_classification(df: DataFrame, target: str) -> bool:
    if isinstance(df.schema[target].dataType, StringType):
        return True
    return df.select(col(target)).distinct().limit(20).count() < 20


def _features(df, target, features):
    return [c for c in (features or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]) if c != target]


@nan_as_null
def mutual_information(df: DataFrame, target: str, features=None, bins: int = 10) -> DataFrame:
    """MI between each quantile-binned feature and the target (binned too for regression).

    One exploded aggregation counts every (feature, feature bin, target class) cell; the
    result has at most features × bins × classes rows.
    """
    feats = _features(df, target, features)
    spark = df.sparkSession
    if not feats:
        return spark.createDataFrame([], "feature string, mutual_info double")
    data = df.where(col(target).isNotNull())
    edges = quantile_edges(data, feats, bins)
    if is_classification(data, target):
        y = col(target).cast("string")
    else:
        te = quantile_edges(data, [target], bins)[target]
        y = bin_code(col(target).cast("double"), te).cast("string")
    feats = [c for c in feats if c in edges]
    cells = data.select(
        y.alias("__y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(bin_code(col(c).cast("double"), edges[c]), F.lit(-1)).alias("bx")) for c in feats])).alias("r"),
    )
    counts = settled(cells.groupBy("r.feature", "r.bx", "__y").agg(F.count(F.lit(1)).alias("n")))
    # I(X;Y) = sum n ln n - sum nx ln nx - sum ny ln ny + N ln N, over N: plain grouped sums, so
    # a target of many classes is never gathered by feature
    def entropy(table, name):
        return table.groupBy("feature").agg(F.sum(F.col("n") * F.ln("n")).alias(name))

    by_x = counts.groupBy("feature", "bx").agg(F.sum("n").alias("n"))
    by_y = counts.groupBy("feature", "__y").agg(F.sum("n").alias("n"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("n"))
    parts = entropy(counts, "hxy").join(entropy(by_x, "hx"), "feature").join(entropy(by_y, "hy"), "feature").join(total, "feature")
    return parts.select("feature", ((F.col("hxy") - F.col("hx") - F.col("hy") + F.col("n") * F.ln("n")) / F.col("n")).alias("mutual_info"))


@nan_as_null
def f_scores(df: DataFrame, target: str, features=None) -> DataFrame:
    """ANOVA F (classification) or the regression F = r²/(1−r²)·(n−2), one aggregation."""
    feats = _features(df, target, features)
    spark = df.sparkSession
    data = df.where(col(target).isNotNull())
    rows = []
    if not feats:
        return spark.createDataFrame([], "feature string, f_score double")
    if is_classification(data, target):
        # sums of values less their mean: nothing cancels where values are far from zero
        mean = one_row(data, *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(feats)])
        x = {i: col(c).cast("double") - F.lit(mean[f"m{i}"] or 0.0) for i, c in enumerate(feats)}
        per_class = data.groupBy(col(target).alias("__y")).agg(
            *[F.count(x[i]).alias(f"n{i}") for i in x], *[F.sum(x[i]).alias(f"s{i}") for i in x], *[F.sum(x[i] * x[i]).alias(f"q{i}") for i in x]
        )
        sums = [F.count(F.lit(1)).alias("k")]
        for i in x:
            between = F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") * F.col(f"s{i}") / F.col(f"n{i}"))
            sums += [F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"s{i}").alias(f"s{i}"), F.sum(f"q{i}").alias(f"q{i}"), F.sum(between).alias(f"b{i}")]
        row = one_row(per_class, *sums)
        k = row["k"]
        for i, c in enumerate(feats):
            n = row[f"n{i}"] or 0
            if n <= k or k < 2:
                rows.append((c, None))
                continue
            centre = row[f"s{i}"] ** 2 / n
            ssb = row[f"b{i}"] - centre
            ssw = row[f"q{i}"] - centre - ssb
            rows.append((c, (ssb / (k - 1)) / (ssw / (n - k)) if ssw > 0 else None))
    else:
        # one aggregation: r and n per feature over the rows where it is present
        from tamis.operators.features import pearson_pairs

        pr = pearson_pairs(data, [target] + feats)
        for c in feats:
            rr, n = pr[(target, c)]
            rows.append((c, rr * rr / (1 - rr * rr) * (n - 2) if rr is not None and abs(rr) < 1 else None))
    return spark.createDataFrame(rows, "feature string, f_score double")


@nan_as_null
def forest_importance(df: DataFrame, target: str, features=None, trees: int = 50, depth: int = 5, seed: int = 42) -> DataFrame:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    feats = _features(df, target, features)
    data = df.where(col(target).isNotNull())
    med = one_row(data, *[F.percentile_approx(col(c).cast("double"), 0.5, 10000).alias(c) for c in feats]).asDict()
    x = data.select(col(target).alias("__t"), *[F.coalesce(col(c).cast("double"), F.lit(med[c] or 0.0)).alias(c) for c in feats])
    va = VectorAssembler(inputCols=feats, outputCol="__x")
    x = va.transform(x)
    if is_classification(data, target):
        x = StringIndexer(inputCol="__t", outputCol="__y", stringOrderType="alphabetAsc").fit(x).transform(x)
        model = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(x)
    else:
        x = x.withColumn("__y", F.col("__t").cast("double"))
        model = RandomForestRegressor(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(x)
    imp = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(imp[i])) for i, c in enumerate(feats)], "feature string, importance double")


def feature_importance(df: DataFrame, target: str, features=None) -> DataFrame:
    """A12–A14 side by side, ranked by mutual information."""
    mi = mutual_information(df, target, features)
    fs = f_scores(df, target, features)
    return mi.join(fs, "feature", "full").orderBy(F.desc_nulls_last("mutual_info"), "feature")


@nan_as_null
def evaluate_features(df: DataFrame, target: str, base_features, new_features, folds: int = 3, seed: int = 42) -> dict:
    """K-fold CV score (accuracy or R²) without and with the new features."""
    from pyspark.ml import Pipeline as MLPipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = df.where(col(target).isNotNull())
    cls = is_classification(data, target)

    def score(feats):
        x = data.select(col(target).alias("__t"), *[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
        stages = [VectorAssembler(inputCols=list(feats), outputCol="__x")]
        if cls:
            stages.append(StringIndexer(inputCol="__t", outputCol="__y", stringOrderType="alphabetAsc"))
            est = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=50, maxDepth=5, seed=seed)
            ev = MulticlassClassificationEvaluator(labelCol="__y", metricName="accuracy")
        else:
            x = x.withColumn("__y", F.col("__t").cast("double"))
            est = RandomForestRegressor(featuresCol="__x", labelCol="__y", numTrees=50, maxDepth=5, seed=seed)
            ev = RegressionEvaluator(labelCol="__y", metricName="r2")
        cv = CrossValidator(estimator=MLPipeline(stages=stages + [est]), estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev, numFolds=folds, seed=seed)
        return float(cv.fit(x).avgMetrics[0])

    # the two cross-validations are independent Spark jobs: submit them concurrently
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=2) as pool:
        fb = pool.submit(score, base_features)
        fa = pool.submit(score, list(base_features) + list(new_features))
        before, after = fb.result(), fa.result()
    return {"metric": "accuracy" if cls else "r2", "before": before, "after": after, "improvement": after - before}
