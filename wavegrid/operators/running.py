"""Running totals, roll-ups and rates of progress, and reconciliation of results with plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from wavegrid.functions.columns import big


def _upto(keys: list[str], order: str):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def prefix(rows: DataFrame, order: str, value: str, name: str, width: int = 4096, levels: int = 2) -> DataFrame:
    """rows with name: the sum of value over rows of a smaller order, an integer. Ranges of width are summed first, and ranges of such ranges, so one task
    sees a row for each width ** levels of the order's span, not all rows."""
    by, total, before = f"_range{levels}", f"_sum{levels}", f"_before{levels}"
    dealt = rows.withColumn(by, F.expr(f"{order} div {width}"))
    sums = dealt.groupBy(by).agg(F.sum(value).alias(total))
    if levels > 1:
        sums = prefix(sums, by, total, before, width, levels - 1).select(by, before)
    else:
        sums = sums.select(by, F.coalesce(F.sum(total).over(W.orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inner = F.coalesce(F.sum(value).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(sums, by).withColumn(name, big(F.col(before) + inner)).drop(by, before)


def cumulative(frames: DataFrame, keys: list[str], header_bytes: int = 0) -> DataFrame:
    """frames (frame, block_size, frame_bytes) with samples_done, frames_done and bytes_done; header bytes come with the first frame."""
    w = _upto(keys, "frame")
    return frames.select("*", big(F.sum("block_size").over(w)).alias("samples_done"), big(F.count("*").over(w)).alias("frames_done"), big(F.sum("frame_bytes").over(w) + header_bytes).alias("bytes_done"))


def two_phase(frames: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each frame and phase (0: decode, 1: encode) with phase_done, overall_done and overall_total, which counts samples twice."""
    phases = frames.withColumn("phase", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    total = F.sum("block_size").over(W.partitionBy(*keys, "phase"))
    done = F.sum("block_size").over(_upto([*keys, "phase"], "frame"))
    return phases.select(*keys, "frame", "phase", big(done).alias("phase_done"), big(done + F.when(F.col("phase") == 1, total).otherwise(0)).alias("overall_done"), big(total * 2).alias("overall_total"))


def batch_rollup(updates: DataFrame, file: str, order: str, value: str) -> DataFrame:
    """updates with batch_done: the sum of the latest value of each file so far. As each file's value only grows, that is a running sum of increments."""
    step = F.col(value) - F.coalesce(F.lag(value).over(W.partitionBy(file).orderBy(order)), F.lit(0))
    return prefix(updates.withColumn("step", step), order, "step", "batch_done").withColumn("batch_done", F.col("batch_done") + F.col("step")).drop("step")


def latest(updates: DataFrame, file: str, order: str, value: str) -> DataFrame:
    """A row for each file: its latest value."""
    return updates.groupBy(file).agg(F.max_by(value, order).alias(value))


def rates(updates: DataFrame, keys: list[str], order: str, done: str, elapsed_ms: str, total: str, warmup_ms: int = 250) -> DataFrame:
    """updates with warm (two advances, and warmup_ms since the first) and, where it is, rate (samples a second) and eta_ms."""
    w = W.partitionBy(*keys).orderBy(order)
    capped = F.least(F.col(done), F.col(total))
    before = F.coalesce(F.lag(F.least(done, total)).over(w), F.lit(0))
    rows = updates.withColumn("advanced", (capped > before).cast("bigint"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("advances", F.sum("advanced").over(upto)).withColumn("first_ms", F.min(F.when(F.col("advanced") == 1, F.col(elapsed_ms))).over(upto))
    warm = (F.col("advances") >= 2) & (F.col(elapsed_ms) - F.col("first_ms") >= warmup_ms) & (F.col(elapsed_ms) > 0) & (capped > 0)
    rate = F.when(warm, F.floor(capped * 1000 / F.col(elapsed_ms)))
    eta = F.when(warm, F.floor((F.col(total) - capped) * F.col(elapsed_ms) / capped))
    return rows.withColumn("warm", F.coalesce(warm, F.lit(False))).withColumn("rate", big(rate)).withColumn("eta_ms", big(eta)).drop("advanced", "advances", "first_ms")


def peak(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys with peak: the most intervals [start, end) that overlap."""
    edges = intervals.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.at", "e.d")
    steps = edges.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    live = steps.withColumn("live", F.sum("d").over(_upto(keys, "at")))
    return live.groupBy(*keys).agg(big(F.max("live")).alias("peak"))


def reconciled(plan: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys with planned, found and state (ok, early end, surplus, missing, unplanned): counts of a plan against what came."""
    both = plan.join(actual, keys, "full_outer")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("planned").isNull(), "unplanned").when(F.col("found") < F.col("planned"), "early end").when(F.col("found") > F.col("planned"), "surplus").otherwise("ok")
    return both.withColumn("state", state)


def drained(results: DataFrame, keys: list[str], arrival: str, frame: str) -> DataFrame:
    """results with released: the arrival at which a frame may go on, when all frames before it are there."""
    w = W.partitionBy(*keys).orderBy(frame).rowsBetween(W.unboundedPreceding, 0)
    return results.withColumn("released", big(F.max(arrival).over(w)))


def portions(blocks: DataFrame, budgets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, take, first (in the block) and samples: how takes of given budgets empty a buffer of blocks, in order, to the sample.

    blocks: keys, block and samples; budgets: keys, take and budget, which may be 0. What the budgets leave has a null take; what they ask beyond the
    buffer isn't there. Ends of blocks and of takes are put in one order, and between two ends lies one portion.
    """
    upto = lambda order, value: F.sum(value).over(_upto(keys, order))
    none = F.lit(None).cast("bigint")
    ends = blocks.select(*keys, upto("block", "samples").alias("end"), big("block").alias("block"), (upto("block", "samples") - F.col("samples")).alias("base"), none.alias("take"))
    ends = ends.unionByName(budgets.select(*keys, upto("take", "budget").alias("end"), none.alias("block"), none.alias("base"), big("take").alias("take")))
    # what lies before an end belongs to the first block and the first take that end there or later
    after = W.partitionBy(*keys).orderBy("end").rangeBetween(W.currentRow, W.unboundedFollowing)
    spans = ends.withColumns({"block": F.min("block").over(after), "base": F.min("base").over(after), "take": F.min("take").over(after)})
    spans = spans.groupBy(*keys, "end").agg(F.min("block").alias("block"), F.min("base").alias("base"), F.min("take").alias("take"))
    start = F.coalesce(F.lag("end").over(W.partitionBy(*keys).orderBy("end")), F.lit(0))
    spans = spans.withColumn("start", start).where((F.col("end") > F.col("start")) & F.col("block").isNotNull())
    return spans.select(*keys, "block", "take", big(F.col("start") - F.col("base")).alias("first"), big(F.col("end") - F.col("start")).alias("samples"))


def lifecycle(files: DataFrame, command: str) -> DataFrame:
    """files (file, input_bytes, started_ms, ended_ms, error) as events in order: seq, at_ms, event and line, the text of a trace: fields name=value with tabs between."""
    batch = F.count("*").over(W.partitionBy()) > 1  # a row a file
    begun = F.min("started_ms").over(W.partitionBy())
    rows = files.select("*", batch.alias("batch"), begun.alias("begun"))
    seconds = lambda ms: F.format_string("%.9f", ms.cast("double") / 1000)
    name = F.translate("file", "\t\r\n", "   ")
    both = F.explode(F.array(F.struct(F.col("started_ms").alias("at_ms"), F.lit("file_begin").alias("event")), F.struct(F.col("ended_ms").alias("at_ms"), F.when(F.col("error").isNull(), "file_finish").otherwise("file_error").alias("event")))).alias("e")
    rows = rows.select("file", "input_bytes", "started_ms", "batch", "begun", name.alias("name"), both).select("*", "e.at_ms", "e.event")
    fields = [("event", F.col("event")), ("kind", F.lit(command)), ("batch_mode", F.col("batch").cast("int").cast("string")), ("filename", F.col("name")), ("input_bytes", F.col("input_bytes").cast("string")),
              ("elapsed_seconds", seconds(F.col("at_ms") - F.col("started_ms"))), ("command_elapsed_seconds", seconds(F.col("at_ms") - F.col("begun")))]
    line = F.concat_ws("\t", *[F.concat(F.lit(f"{k}="), v) for k, v in fields])
    order = W.partitionBy().orderBy("at_ms", F.col("event") != "file_begin", "file")
    return rows.select(big(F.row_number().over(order) - 1).alias("seq"), "at_ms", "event", "file", line.alias("line"))
