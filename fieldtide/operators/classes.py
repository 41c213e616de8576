"""Class profiles: frequencies, shares, suggestions, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtide.constants import (
    ASSETS, BASE_LABELS, COMMON_OTHER_CROPS, DISPLAY_CLASSES, NON_CROP_CLASSES, OTHER_CROPS,
    TARGETED_CROPS,
)
from fieldtide.functions import text
from fieldtide.sources.sinks import replace_partitions
from fieldtide.sources.tables import read_observations


def class_distribution(decoded: DataFrame, *by: str, min_percent: float = 1.0) -> DataFrame:
    """Count and percentage per class, rare classes left out; no name counts as a class."""
    share = F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(*by))
    return (
        decoded.groupBy(*by, "class_name").count()
        .withColumn("percent", share).where(F.col("percent") >= min_percent)
    )


def aoi_stats_wide(distribution: DataFrame, classes: Sequence[str], *by: str) -> DataFrame:
    """One row per AOI with a column of whole percent per class; absent classes are null."""
    return (
        distribution.where(F.col("class_name").isin(list(classes)))
        .groupBy(*by).pivot("class_name", list(classes))
        .agg(F.max(F.col("percent").cast("int")))
    )


def class_share_by_year(samples: DataFrame) -> DataFrame:
    """Samples and share of each class within its year."""
    total = F.sum("count").over(Window.partitionBy("year"))
    return (
        samples.groupBy("year", "CDL").count()
        .select("year", "CDL", "count", total.alias("total"),
                F.round(F.col("count") * 100.0 / total, 2).alias("percent"))
    )


def count_by_class_year(df: DataFrame) -> DataFrame:
    return df.groupBy("CDL", "year").count().orderBy(F.desc("count"), "CDL", "year")


def year_summary(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Rows and mean of every numeric column per year."""
    return df.groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"mean_{c}") for c in numeric])


def asset_profile(obs: DataFrame, exact: bool = True) -> DataFrame:
    """Minimum, maximum and distinct values per asset.

    Values are reduced to distinct (asset, value) pairs before they are counted;
    with exact=False a sketch replaces that shuffle.
    """
    long = obs.select(*ASSETS).unpivot([], ASSETS, "asset", "value")
    if not exact:
        return long.groupBy("asset").agg(
            F.min("value").alias("min"), F.max("value").alias("max"),
            F.approx_count_distinct("value").alias("distinct_values"))
    return long.distinct().groupBy("asset").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("distinct_values"))


SKETCH = 12  # log2 of the buckets of a sketch: standard error about 1.04 / sqrt(4096), 1.6 %


def asset_sketches(obs: DataFrame, precision: int = SKETCH) -> DataFrame:
    """Minimum, maximum and a mergeable sketch of the distinct values per (bbox, year, asset).

    One aggregate over the wide rows with a sketch of bounded size for each asset; nothing is
    unpivoted before it. Null values count nowhere; an asset without any has a null sketch.
    """
    wide = obs.groupBy("bbox", "year").agg(*[F.struct(
        F.lit(a).alias("asset"), F.min(a).alias("min"), F.max(a).alias("max"),
        F.when(F.count(a) > 0, F.hll_sketch_agg(a, F.lit(precision))).alias("sketch")).alias(a) for a in ASSETS])
    return wide.select(F.inline(F.array(*ASSETS)), "bbox", "year")


def refresh_sketches(spark: SparkSession, source: str, root: str, precision: int = SKETCH) -> int:
    """Add the (bbox, year) stored below source that the sketches below root lack; how many.

    New partitions come from the listing of files and are a literal filter on the partition
    columns, so files of finished ones are not opened. The driver holds as many names as that
    listing has folders. A partition that has sketches counts as complete; one is replaced as a
    whole, so a repeated refresh changes nothing.
    """
    keys = ["bbox", "year"]
    here = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
        .select(F.col("bbox").cast("string"), F.col("year").cast("int")).distinct()
    )
    try:
        here = here.join(spark.read.parquet(root).select(*keys).distinct(), keys, "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    years: dict[int, list[str]] = {}
    for r in here.collect():
        years.setdefault(r.year, []).append(r.bbox)
    if not years:
        return 0
    new = F.lit(False)
    for year, boxes in years.items():
        new = new | ((F.col("year") == year) & F.col("bbox").isin(boxes))
    obs = read_observations(spark, source).where(new)
    replace_partitions(asset_sketches(obs, precision), root, keys)
    return sum(map(len, years.values()))


def sketch_profile(sketches: DataFrame) -> DataFrame:
    """Minimum, maximum and estimated distinct values per asset, from stored sketches alone."""
    return sketches.groupBy("asset").agg(
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct_values"))


def is_non_crop(name: Column, words: Sequence[str] = NON_CROP_CLASSES) -> Column:
    """Whether a class name is, or contains, one of the non-crop names."""
    hit = name.contains(words[0])
    for w in words[1:]:
        hit = hit | name.contains(w)
    return hit


def class_profile(samples: DataFrame, min_count: int = 0) -> DataFrame:
    """Frequency, share, kind and rank of every class.

    Ranks run over one row per class name, after the counts were combined.
    """
    counts = samples.where(F.col("CDL").isNotNull()).groupBy("CDL").count()
    everything = Window.partitionBy()
    rank = Window.partitionBy("kind").orderBy(F.desc("count"), "CDL")
    return (
        counts.withColumn("kind", F.when(is_non_crop(F.col("CDL")), "non_crop").otherwise("crop"))
        .select("CDL", "count", "kind",
                (F.col("count") * 100.0 / F.sum("count").over(everything)).alias("percent"),
                F.row_number().over(rank).cast("bigint").alias("rank"),
                F.col("CDL").isin(COMMON_OTHER_CROPS).alias("common_other"))
        .where(F.col("count") >= min_count)
    )


def top_classes(profile: DataFrame, crops: int = 50, others: int = 20) -> DataFrame:
    """Most frequent crops and non-crops."""
    return profile.where(
        ((F.col("kind") == "crop") & (F.col("rank") <= crops))
        | ((F.col("kind") == "non_crop") & (F.col("rank") <= others)))


def suggest_classes(
    profile: DataFrame, min_count: int = 0, lead: int = 10, targeted: int = 6, other: int = 20,
) -> DataFrame:
    """Suggested label scheme from the class ranking, as (section, position, name, count).

    The first `lead` crops are targeted unless they are common side crops, which
    open the list of other crops; that list is filled up to `other` in rank order.
    Leading crops beyond `targeted` stay in neither list.
    """
    crops = profile.where((F.col("kind") == "crop") & (F.col("count") >= min_count))
    leading = F.col("rank") <= lead
    group = (
        F.when(leading & ~F.col("common_other"), "targeted")
        .otherwise("other")
    )
    grouped = crops.withColumn("group", group)
    # side crops among the leaders come first, the rest follows in rank order
    order = Window.partitionBy("group").orderBy((~leading).cast("int"), "rank")
    placed = grouped.withColumn("position", F.row_number().over(order))
    kept = placed.where(
        ((F.col("group") == "targeted") & (F.col("position") <= targeted))
        | ((F.col("group") == "other") & (F.col("position") <= other)))
    lists = kept.select(F.concat(F.col("group"), F.lit("_crops")).alias("section"),
                        "position", F.col("CDL").alias("name"), "count")
    legend = kept.where(F.col("group") == "targeted").select(
        F.lit("label_legend").alias("section"),
        (F.col("position") + len(BASE_LABELS)).alias("position"), F.col("CDL").alias("name"),
        "count")
    base = profile.sparkSession.createDataFrame(
        [("label_legend", i, n, None) for i, n in enumerate(BASE_LABELS, 1)],
        "section string, position int, name string, count bigint")
    return lists.unionByName(legend).unionByName(base)


def class_difference(
    samples: DataFrame, listed: Sequence[str] = (*TARGETED_CROPS, *OTHER_CROPS),
) -> DataFrame:
    """Classes of the data that no list names (they count as uncultivated)."""
    return samples.select("CDL").distinct().where(~F.col("CDL").isin(list(listed)))


def class_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Each class of two regions with where it occurs: both, only train, only test."""
    side = lambda df, name: df.select("CDL").distinct().withColumn(name, F.lit(1))
    both = side(train, "a").join(side(test, "b"), "CDL", "full")
    where = (F.when(F.col("a").isNull(), "only_test").when(F.col("b").isNull(), "only_train")
             .otherwise("both"))
    return both.select("CDL", where.alias("found_in"))


def encode_cdl(
    samples: DataFrame, display: Sequence[str] = DISPLAY_CLASSES, default: int | None = None,
) -> DataFrame:
    """Display code of each class name; unknown names get the last code."""
    last = len(display) - 1
    code = F.array_position(text.words(display), F.col("CDL")).cast("int") - 1
    code = F.when(code < 0, F.lit(last if default is None else default)).otherwise(code)
    return samples.withColumn("encoded", F.greatest(F.lit(0), F.least(code, F.lit(last))))
