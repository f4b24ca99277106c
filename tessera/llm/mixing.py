"""Mixing sources to target weights by entropy balancing.

For each source the rates of its documents are those closest in entropy to one copy each, within 0 to `most` copies,
whose expected tokens meet the source's target. The solution is an exponential tilt of the odds, r / (most - r) =
exp(t * z) / (most - 1), z being the document's size over the source's mean size; the multiplier t solves a convex dual
by Newton's method.
The dual needs only sums over documents, so it runs on the histogram of (source, size); each round is one aggregation.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import each_slice, new_path, ranked, stored, words


def sized(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """The columns of keep, and size: the number of words `[^\\x20\\x09-\\x0D]+` of the whole text (null: 0)."""
    import numpy as np

    names = [f"c{i}" for i in range(len(keep))]

    def run(batches):
        for part, buf, offs in each_slice(batches, "__t", 4 << 20):
            n = np.bincount(words(buf, offs)[2], minlength=len(offs) - 1) if len(buf) else np.zeros(len(offs) - 1)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(n, pa.int64())], names=[*names, "size"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).alias("__t"))
    schema = ", ".join(f"{n} {kinds[c]}" for c, n in zip(keep, names)) + ", size long"
    return rows.mapInArrow(run, schema).toDF(*keep, "size")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Adds target to rows (source, source_size): share of all sizes split by weights, which repeat over the sources by
    code point, null last. A target stops at most times its source's size; the excess is shared again by weight.

    Sorted by cap over weight, the stopped sources are a prefix: source i stops if its level is at most what the rest
    would get a weight. So water filling is two window sums over one row a source, without a loop."""
    one = W.orderBy(F.col("source").isNull(), "source")
    ranked_ = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")).cast("double"))
    cap = ranked_.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    up = by_level.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = cap.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(up), F.lit(0.0)),
            "weights_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)),
            "total": F.sum("source_size").over(every) * F.lit(share),
        }
    )
    level = level.withColumn("level", (F.col("total") - F.col("before")) / F.col("weights_left"))
    stops = level.withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    free = stops.withColumn("free_level", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return free.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("free_level") * F.col("weight")).alias("target"))


def rates(hist: DataFrame, goals: DataFrame, most: int = 2, rounds: int = 40, close: float = 1e-5) -> DataFrame:
    """The tilted rate of each (source, size): hist has source, size, docs; goals has source, source_size, target.

    Newton on the dual, all sources in one aggregation a round, kept inside a bracket that halves when a step leaves it.
    The state is one row a source and lives in Spark; only the largest relative gap comes to the driver. A source that is
    not within close of its target after all rounds keeps its last rates: copies() owes it the rest, so it still ends
    near its target."""
    g = goals.select(F.col("source").alias("gs"), "target")
    sums = hist.where("size > 0").groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).cast("double").alias("all"), F.sum("docs").alias("n"))
    state = sums.join(g, F.col("source").eqNullSafe(F.col("gs"))).select(F.col("source").alias("ss"), (F.col("all") / F.col("n")).alias("mean"), "target", (F.col("target") / F.col("all") / most).alias("full"))
    state = stored(state.withColumns({"tilt": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6)}), "mix-state")
    base = -math.log(most - 1) if most > 1 else 36.0
    z = F.col("size") / F.col("mean")
    r = F.when(F.col("full") >= 1 - 1e-9, F.lit(1.0)).otherwise(1 / (1 + F.exp(-(F.lit(base) + z * F.col("tilt")))))
    keep = ["mean", "target", "full", "tilt", "low", "high"]
    for _ in range(rounds):
        at = hist.where("size > 0").join(state, F.col("source").eqNullSafe(F.col("ss")))
        tokens = F.col("docs") * F.col("size") * most
        sums = at.groupBy("ss").agg(F.sum(tokens * r).alias("got"), F.sum(tokens * z * r * (1 - r)).alias("slope"), *[F.first(c).alias(c) for c in keep])
        over = F.col("got") - F.col("target")
        sums = sums.withColumns({"gap": F.when(F.col("full") >= 1 - 1e-9, F.lit(0.0)).otherwise(F.abs(over) / F.greatest(F.col("target"), F.lit(1.0))), "step": F.col("tilt") - over / F.greatest(F.col("slope"), F.lit(1e-300))})
        sums = sums.withColumns({"low": F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))})
        low, high = F.greatest(F.col("low"), F.col("tilt") - 16), F.least(F.col("high"), F.col("tilt") + 16)
        tilt = F.when(F.col("gap") < close, F.col("tilt")).when((F.col("step") > low) & (F.col("step") < high), F.col("step")).otherwise((low + high) / 2)
        state = stored(sums.select("ss", "gap", *[tilt.alias(c) if c == "tilt" else F.col(c) for c in keep]), "mix-state")
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst < close:
            break
    at = hist.join(state, F.col("source").eqNullSafe(F.col("ss")), "left")
    return at.select("source", "size", "docs", F.coalesce(r * most, F.lit(0.0)).alias("rate"), F.coalesce("target", F.lit(0.0)).alias("target"))


def copies(classes: DataFrame, most: int = 2) -> DataFrame:
    """Whole copies of each (source, size): adds copies, from 0 to most * docs, by rounding down the sizes.

    Goes through a source's sizes from the largest and carries the tokens still owed to the next size, so a source ends
    within half of its smallest document of its target, as far as the bounds allow. Group size: the distinct sizes of
    one source, not its documents."""
    kind = classes.schema["source"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["size"].to_pylist(), table["docs"].to_pylist(), table["rate"].to_pylist()), reverse=True)
        out, owed = [], 0.0
        left = table["target"][0].as_py() - sum(r[0] * r[1] * r[2] for r in rows) if len(rows) else 0.0
        for k, (size, docs, rate) in enumerate(rows):
            owed += size * docs * rate + (left if k == 0 else 0.0)
            n = 0 if not size else min(most * docs, max(0, math.floor(owed / size + 0.5)))
            owed -= n * size
            out.append((size, n))
        return pa.table({"source": pa.array([key[0].as_py()] * len(out), table.schema.field("source").type), "size": [x[0] for x in out], "copies": [x[1] for x in out]})

    return classes.groupBy("source").applyInArrow(run, f"source {kind}, size long, copies long")


def mix(df: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, extra: list[str] | None = None) -> DataFrame:
    """Copies of each document that bring every source to its target tokens; reruns agree.

    Returns id_col, source, size, source_size, target (of the source), copies (0 to most), taken (copies * size) and the
    columns of extra. Null text has size 0 and is never taken; a null source is a source of its own, last in order. Repeated rows
    are told apart by rank. Sources are joined null-safe; a hot source or size is ranked in buckets."""
    extra = extra or []
    docs = stored(sized(df.withColumns({"__id": F.col(id_col), "__source": F.col(source_col).cast("string")}), "__id", text_col, ["__id", "__source", *extra]).withColumnsRenamed({"__id": "id", "__source": "source"}), "mix-docs")
    hist = stored(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-hist")
    sources = hist.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"))
    goals = stored(targets(sources, weights, share, most), "mix-goals")
    plan = stored(copies(rates(hist, goals, most), most), "mix-plan")
    plan = plan.join(hist.withColumnsRenamed({"source": "hs", "size": "hz"}), F.col("source").eqNullSafe(F.col("hs")) & (F.col("size") == F.col("hz")))
    plan = plan.join(goals.withColumnRenamed("source", "gs"), F.col("source").eqNullSafe(F.col("gs")))
    plan = plan.select("source", "size", "docs", F.col("copies").alias("all_copies"), "source_size", "target")
    row = ranked(docs, ["source", "size"], ["id"], "__rank", also=plan)
    n = F.floor(F.col("all_copies") / F.col("docs")) + (F.col("__rank") < F.col("all_copies") % F.col("docs")).cast("long")
    return row.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"), *extra)
