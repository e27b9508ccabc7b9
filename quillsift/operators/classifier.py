"""A linear classifier of segments over hashed features: features, scores, gate, training and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

#: Words, and sentence starts that are counted.
WORD = r"[a-z][a-z'-]*|\d+"
STARTS = (
    r"^\W*(submit|implement|write|describe|explain|use|include|provide|list|run|install|ensure|make sure|read|do not|don't|never|always|check|click|open|select|enter|add|"
    r"create|set|configure|follow|see|note)\b"
)


def _words(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def _tagged(tag: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(tag + ":"), w))


def tokens(segments: DataFrame) -> DataFrame:
    """segments with `tokens`, their feature names with repeats."""
    cut = F.substring("text", 1, fixed.FEATURE_CHARS)
    body = F.regexp_replace(cut, r"(?m)^#+ [^\n]*$", "")
    rows = segments.withColumn("_cut", cut).withColumn("_body", body).withColumn("_w", F.slice(_words(F.col("_body")), 1, fixed.FEATURE_WORDS))
    lines = F.filter(F.split("_body", "\n"), lambda x: F.trim(x) != "")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*([-*+•]|\d+[.)])\s")))
    bigrams = F.when(F.size("_w") > 1, F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat(F.lit("b:"), F.element_at("_w", i), F.lit(" "), F.element_at("_w", i + 1))))
    own = F.filter(F.split("_cut", "\n"), lambda x: x.startswith("#"))
    links = F.regexp_count("_cut", F.lit("http")) + F.regexp_count("_cut", F.lit(r"\]\("))
    shape = {
        "len": text.bucket(F.length("_cut"), (200, 500, 1000)), "lines": text.bucket(F.size(lines), (2, 5, 12)),
        "bullets": text.bucket(bullets / F.greatest(F.lit(1), F.size(lines)), (0.1, 0.5, 0.9)), "urls": text.bucket(links, (1, 3, 8)),
        "imperative": text.bucket(text.count("_body", STARTS, "imU"), (1, 3)), "you": text.bucket(F.size(F.filter("_w", lambda w: w.isin("you", "your"))), (1, 3)),
        "digits": text.bucket(F.regexp_count("_body", F.lit(r"(?U)\d")) / F.greatest(F.lit(1), F.length("_body")), (0.02, 0.1)),
    }
    none = F.expr("cast(array() as array<string>)")
    signals = F.array_distinct(F.transform(F.filter("signals", lambda s: ~(s.startswith("llm:") | s.startswith("distilled:"))), lambda s: F.concat(F.lit("s:"), text.signal_name(s))))
    parts = [
        _tagged("w", F.col("_w")), bigrams, F.flatten(F.transform("heading_path", lambda h: _tagged("h", _words(h)))), F.when(F.size("heading_path") > 0, _tagged("hl", _words(F.try_element_at("heading_path", F.lit(-1))))),
        F.flatten(F.transform(own, lambda x: _tagged("ho", _words(x)))), F.array_distinct(F.transform("flags", lambda f: F.concat(F.lit("f:"), f))), F.array(F.concat(F.lit("hz:"), "zone")),
        F.array(F.concat(F.lit("hc:"), text.bucket("confidence", (0.4, 0.6, 0.7, 0.85)))), signals, F.array(*(F.concat(F.lit(f"n:{n}"), c) for n, c in shape.items())),
        F.when(F.col("_cut").contains("```"), F.array(F.lit("n:fence"))), F.when(F.col("_body").contains("?"), F.array(F.lit("n:question"))),
    ]
    return rows.withColumn("tokens", F.concat(*(F.coalesce(p, none) for p in parts))).drop("_cut", "_body", "_w")


def features(tokenized: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, value): log counts summed in hashed slots, of length one for each segment."""
    by = tokenized.select(*keys, F.explode_outer("tokens").alias("t")).where("t IS NOT NULL").groupBy(*keys, "t").count()
    slots = by.groupBy(*keys, text.feature_slot("t").alias("slot")).agg(F.sum(F.log1p("count")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*keys)))
    return slots.select(*keys, "slot", (F.col("v") / norm).alias("value"))


def probabilities(vectors: DataFrame, weights: DataFrame, bias: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, zone, p) from vectors (keys, slot, value), weights (zone, slot, w) and bias (zone, b). Weights are zones x slots at most, so they are broadcast."""
    dot = vectors.join(F.broadcast(weights), "slot").groupBy(*keys, "zone").agg(F.sum(F.col("value") * F.col("w")).alias("z"))
    every = vectors.select(*keys).distinct().crossJoin(F.broadcast(bias))
    logits = every.join(dot, [*keys, "zone"], "left").withColumn("z", F.col("b") + F.coalesce("z", F.lit(0.0)))
    w = Window.partitionBy(*keys)
    e = logits.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return e.select(*keys, "zone", (F.col("e") / F.sum("e").over(w)).alias("p"))


def best(probability: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, best_zone, best_p): the first of the likeliest zones."""
    position = F.array_position(F.array(*map(F.lit, fixed.TRAINABLE)), F.col("zone"))
    return probability.groupBy(*keys).agg(F.max_by("zone", F.struct("p", -position)).alias("best_zone"), F.max("p").alias("best_p"))


def gate(segments: DataFrame, choice: DataFrame, keys: list[str]) -> DataFrame:
    """segments below the bar and not hidden take the classifier's zone unless it is unsure; `changed` marks new zones."""
    rows = segments.join(choice, keys, "left")
    asked = (F.col("confidence") < fixed.JUDGE_BELOW) & (F.col("zone") != "hidden") & F.col("best_p").isNotNull()
    take = asked & (F.col("best_p") >= fixed.LEAST_PROBABILITY)
    signal = F.when(take, F.concat(F.lit("distilled:"), F.format_number("best_p", 2))).when(asked, F.concat(F.lit("distilled:low("), "best_zone", F.lit(" "), F.format_number("best_p", 2), F.lit(")")))
    out = {
        "signals": F.when(signal.isNull(), F.col("signals")).otherwise(F.concat("signals", F.array(signal))), "zone": F.when(take, F.col("best_zone")).otherwise(F.col("zone")),
        "confidence": F.when(take, F.bround(F.least(F.lit(0.9), F.col("best_p")), 2)).otherwise(F.col("confidence")), "method": F.when(take, "distilled").otherwise(F.col("method")),
    }
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in segments.columns), (take & (F.col("best_zone") != F.col("zone"))).alias("changed"))


def folds(docs: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, fold): every document in one fold, so that no document is on both sides of a split."""
    return docs.select(key).distinct().withColumn("fold", F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): the root of how rare a class is."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    return counts.select(label, "n", F.sqrt(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))


def fit(vectors: DataFrame, labels: DataFrame, keys: list[str], label: str = "zone") -> tuple[DataFrame, DataFrame]:
    """(weights, bias) of a multinomial regression; small weights are pruned."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import SparseVector, VectorUDT

    spark = vectors.sparkSession

    @F.udf(VectorUDT())
    def sparse(entries):
        return SparseVector(fixed.SLOTS, sorted((e["slot"], e["value"]) for e in entries))

    del array_to_vector
    spot = F.array_position(F.array(*map(F.lit, fixed.TRAINABLE)), F.col(label)) - 1
    rows = vectors.groupBy(*keys).agg(F.collect_list(F.struct("slot", "value")).alias("v")).join(labels.where(F.col(label).isin(*fixed.TRAINABLE)), keys)
    rows = rows.join(F.broadcast(class_weights(rows, label)), label).select(sparse("v").alias("features"), spot.cast("double").alias("label"), "weight")
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-4, maxIter=30).fit(rows)
    matrix = model.coefficientMatrix.toArray()
    weights = [(fixed.TRAINABLE[i], int(j), round(float(matrix[i, j]), 4)) for i in range(matrix.shape[0]) for j in matrix[i].nonzero()[0] if abs(matrix[i, j]) >= fixed.PRUNE]
    bias = [(fixed.TRAINABLE[i], float(b)) for i, b in enumerate(model.interceptVector)]
    return spark.createDataFrame(weights, "zone string, slot int, w double"), spark.createDataFrame(bias, "zone string, b double")


def save(weights: DataFrame, bias: DataFrame, path: str, version: int = 1) -> None:
    rows = weights.select("zone", "slot", F.bround("w", 4).alias("w")).where(F.abs("w") >= fixed.PRUNE)
    rows.unionByName(bias.select("zone", F.lit(-1).alias("slot"), F.col("b").alias("w"))).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(path)


def load(spark, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(path)
    if rows.where(F.col("version") != version).head(1):
        raise ValueError(f"{path} has weights of another version than {version}")
    return rows.where("slot >= 0").select("zone", "slot", "w"), rows.where("slot < 0").select("zone", F.col("w").alias("b"))
