"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Tasks count the n-grams of trusted documents and send each distinct one once; the counts are summed by shards of n-grams.
Lower orders count in how many n-grams of the next order each is the end. Discounts follow from how often counts of 1 to 4
occur; a context's totals and the next lower order's probabilities reach its n-grams by joins of those sharded counts.

Documents are scored by joins too. They are cut into blocks, whose rows are kept in files; each block sends its distinct n-grams, and the distinct
ones of all blocks meet the model's counts, order by order. What that gives is joined with the blocks' n-grams and goes back to the blocks,
whose documents add up their positions. No task needs more of the model than its join's share or its block's n-grams. What is broadcast has a row
for each character at most, of which there are 1,114,112.
A document is accepted if its perplexity is at most its language's quantile among trusted documents that the model was not trained on.

An n-gram is two numbers: the characters before the last, in 21 bits each, and the last.
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from wavegrid.llm import storage
from wavegrid.llm.common import chunks_of, discarded, extended, fresh, limited, pack, schema_with, shared_dir, small_batches, stored, trimmed, unpack, utf8, without

ORDER = 4
#: What stands before a text: no character has this code.
BEGIN = 0x110000
_BITS = 21


def codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' characters, ORDER - 1 marks before each text, and how many characters each text has."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    mark = np.full(ORDER - 1, BEGIN, np.uint32)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.decode().encode("utf-32-le"), np.uint32) if t else np.zeros(0, np.uint32)
        counts[i] = len(c)
        parts += [mark, c]
    return np.concatenate([*parts, np.zeros(0, np.uint32)]), counts


class Grams:
    """The distinct n-grams of ORDER characters of some texts: contexts and last characters in order, counts, and for each character of the texts
    the place of the n-gram that ends there."""

    def __init__(self, texts: list[bytes | None]):
        a, self.counts = codes(texts)
        at = np.arange(int(self.counts.sum())) + np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), self.counts)
        parts = []
        for begin in range(0, len(at), 1 << 22):
            parts += self._of(a, at[begin : begin + (1 << 22)])
        if len(parts) == 1:
            self.context, self.last, self.place, self.n = parts[0]
        else:
            self.context, self.last, self.n, places = merged([(c, x, n) for c, x, _, n in parts])
            self.place = np.concatenate([p[q] for p, (_, _, q, _) in zip(places, parts, strict=True)] or [np.zeros(0, np.int64)])

    @staticmethod
    def _of(a: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Of the positions at, which are few enough or cut until they have under 65,536 different characters: then an n-gram is one number."""
        low = int(at[0]) - ORDER + 1
        part = a[low : int(at[-1]) + 1]
        there = np.zeros(BEGIN + 1, bool)
        there[part] = True
        known = np.flatnonzero(there)
        if len(known) > 1 << 16:
            middle = len(at) // 2
            return [*Grams._of(a, at[:middle]), *Grams._of(a, at[middle:])]
        number = np.zeros(BEGIN + 1, np.uint16)
        number[known] = np.arange(len(known), dtype=np.uint16)
        short = number[part]
        key = np.zeros(len(at), np.uint64)
        for j in range(ORDER - 1, -1, -1):
            key <<= np.uint64(16)
            key |= short[at - (low + j)]
        order = np.argsort(key)
        s = key[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        place = np.empty(len(s), np.int64)
        place[order] = np.cumsum(first) - 1
        begins = np.flatnonzero(first)
        s = s[begins]
        context = np.zeros(len(s), np.int64)
        for j in range(ORDER - 1, 0, -1):
            context = (context << _BITS) | known[((s >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64)]
        return [(context, known[(s & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int32), place, np.diff(np.append(begins, len(key))))]


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Contexts, last characters and counts of all parts, in order; and for each part's n-grams their places."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), []
    context, last, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((last, context))
    c, x = context[order], last[order]
    first = np.ones(len(c), bool)
    first[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1])
    place = np.empty(len(c), np.int64)
    place[order] = np.cumsum(first) - 1
    total = np.bincount(place, n, int(first.sum())).astype(np.int64)
    return c[first], x[first], total, np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1])


def _last_of(context: Column, characters: int) -> Column:
    """The last characters of a context; none is 0."""
    return context.bitwiseAND(F.lit((1 << (_BITS * characters)) - 1)) if characters else F.lit(0).cast("long")


def count_grams(docs: DataFrame, text_col: str, batch_bytes: int = 2 << 20, most: int = 2_000_000) -> DataFrame:
    """(h, c, n): how often each n-gram of ORDER characters occurs. A task keeps about most n-grams before it sends them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def row() -> pa.RecordBatch:
            h, c, n = held[0] if held else merged([])[:3]
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(n)], ["h", "c", "n"])

        for table in chunks_of(batches, text_col, batch_bytes):
            g = Grams(utf8(table.column(text_col)))
            held = [merged([*held, (g.context, g.last, g.n)])[:3]]
            if len(held[0][0]) > most:
                yield row()
                held = []
        yield row()

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(trimmed(run), "h long, c int, n long").groupBy("h", "c").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Of counts 1, 2 and more, kept off their bounds so that no probability is 0."""
    c = counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    if not all(c):
        return [0.5, 0.5, 0.5]  # too few n-grams to estimate
    y = c[0] / (c[0] + 2 * c[1])
    return [min(k - 0.01, max(0.01, k - (k + 1) * y * c[k] / c[k - 1])) for k in (1, 2, 3)]


def train(trusted: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(kind, order, h, c, value), stored: kind 0 has an n-gram's log probability, kind 1 a context's log weight of the lower order (c is 0).

    Null and empty texts add nothing; without any text the model has no rows.
    """
    counts = stored(count_grams(trusted, text_col), "ngrams")
    orders = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        orders[n] = stored(orders[n + 1].select(_last_of(F.col("h"), n - 1).alias("h"), "c").groupBy("h", "c").agg(F.count("*").alias("n")), "ngrams")
    symbols = orders[1].count() + 1
    parts: list[DataFrame] = []
    tables = list(orders.values())
    lower: DataFrame | None = None
    for n in range(1, ORDER + 1):
        d = _discounts(orders[n])
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = orders[n].withColumn("d", discount)
        contexts = rows.groupBy("h").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("g"))
        if n == 1:
            only = contexts.first()  # of the empty context
            total, g = (only.total, only.g) if only else (1, 1.0)
            rows = rows.withColumn("total", F.lit(total)).withColumn("g", F.lit(g)).withColumn("below", F.lit(1 / symbols))
        else:
            rows = rows.join(contexts, "h").withColumn("low", _last_of(F.col("h"), n - 2)).join(lower, ["low", "c"])
        lower = stored(rows.select("h", "c", ((F.col("n") - F.col("d")) / F.col("total") + F.col("g") * F.col("below")).alias("p")), "ngrams")
        tables.append(lower)
        parts.append(lower.select(F.lit(0).alias("kind"), F.lit(n).alias("order"), "h", "c", F.log("p").alias("value")))
        parts.append(contexts.select(F.lit(1).alias("kind"), F.lit(n).alias("order"), "h", F.lit(0).alias("c"), F.log(F.greatest("g", F.lit(1e-300))).alias("value")))
        lower = lower.select(F.col("h").alias("low"), "c", F.col("p").alias("below"))
    model = parts[0]
    for p in parts[1:]:
        model = model.union(p)
    model = stored(model, "model")
    discarded(*tables)
    return model


def _shards(model: DataFrame, shard_bytes: int) -> tuple[int, int]:
    """Into how many shards the model is dealt for joins at least, such that each has about shard_bytes of it; the model's rows."""
    rows = model.count()
    return max(1, -(-rows * 24 // shard_bytes)), rows


def log_probabilities(grams: DataFrame, model: DataFrame) -> DataFrame:
    """grams (h, c and others, distinct) with p, the log probability of c after h: that of the longest end of the n-gram that the model knows, and the weights of the contexts it leaves."""
    known = lambda kind, n: model.where(f"kind = {kind} and `order` = {n}")
    names = grams.columns
    only = known(1, 1).first()  # the empty context has one row
    unseen = -float(np.log(known(0, 1).count() + 1))
    # a row a character, so bounded
    one = F.broadcast(known(0, 1).select("c", F.col("value").alias("seen")))
    df = grams.join(one, "c", "left").select(*names, F.coalesce("seen", F.lit((only.value if only else 0.0) + unseen)).alias("p"))
    for n in range(2, ORDER + 1):
        weights, ends = known(1, n).select(F.col("h").alias("low"), F.col("value").alias("g")), known(0, n).select(F.col("h").alias("low"), "c", F.col("value").alias("seen"))
        weights = F.broadcast(weights) if n == 2 else weights  # a row a character
        df = df.withColumn("low", _last_of(F.col("h"), n - 1)).join(weights, "low", "left").join(ends, ["low", "c"], "left")
        df = df.select(*names, F.coalesce("seen", F.col("g") + F.col("p"), "p").alias("p"))
    return df


class _Block:
    """A block that is being written: its rows go to a file as they come, and of its texts only the n-grams are held."""

    def __init__(self, path: str, number: int, schema: pa.Schema):
        self.number, self.size, self.grams = number, 0, []
        self.file = storage.creating(f"{path}/{number:016x}")
        self.writer = pa.ipc.new_file(self.file.__enter__(), schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def add(self, table: pa.Table, text_col: str) -> None:
        self.writer.write_table(table.combine_chunks())
        g = Grams(utf8(table.column(text_col)))
        self.grams.append((g.context, g.last, g.n))
        self.size += int(g.counts.sum())

    def done(self) -> pa.RecordBatch:
        self.writer.close()
        self.file.__exit__(None, None, None)
        h, c, _, _ = merged(self.grams)
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), pa.array([pack(h=np.diff(h, prepend=np.int64(0)), c=c)], pa.binary())], ["block", "payload"])


def _blocks(path: str, text_col: str, block_size: int):
    """Rows in; each block's rows are kept in a file, and its distinct n-grams go out, packed. Blocks have the same names when a task runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 24, None
        try:
            for table in chunks_of(batches, text_col, 1 << 20):
                block = block or _Block(path, number, table.schema)
                block.add(table, text_col)
                if block.size >= block_size:
                    yield block.done()
                    number, block = number + 1, None
            if block:
                yield block.done()
        except BaseException:
            if block:
                with contextlib.suppress(BaseException):
                    block.file.__exit__(*sys.exc_info())
            raise

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row an n-gram of a block."""
    for batch in batches:
        for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            e = unpack(payload)
            h, c = np.cumsum(e["h"], dtype=np.uint64).view(np.int64), e["c"].astype(np.int32)
            for begin in range(0, len(h), 50_000):
                few = slice(begin, begin + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[few]), number)), pa.array(h[few]), pa.array(c[few])], ["block", "h", "c"])


def _scored(path: str, text_col: str, hidden: str):
    """Blocks' n-grams with their log probabilities in, in order, after a row without an n-gram for each block; the blocks' rows with the sum over their positions out."""

    def pieces(number: int) -> Iterator[pa.Table]:
        with storage.seekable(f"{path}/{number:016x}") as f:
            file = pa.ipc.open_file(f)
            for i in range(file.num_record_batches):
                yield pa.Table.from_batches([file.get_batch(i)])

    def rows_of(number: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, c, p = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
        for some in pieces(number):
            g = Grams(utf8(some.column(text_col)))
            value, sums, any_ = p[_places(h, c, g.context, g.last)][g.place], np.zeros(len(g.counts)), g.counts > 0
            if any_.any():  # a document's sum is the same, whatever stands beside it
                sums[any_] = np.add.reduceat(value, (np.cumsum(g.counts) - g.counts)[any_])
            yield from extended(some, {hidden: pa.array(sums)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if block[i] != now:
                    if now is not None:
                        yield from rows_of(now, parts)
                    now, parts = int(block[i]), []
                some = batch.slice(i, j - i)
                some = some.filter(pc.is_valid(some.column(1)))
                parts.append(tuple(some.column(k).to_numpy() for k in (1, 2, 3)))
        if now is not None:
            yield from rows_of(now, parts)

    return run


def _places(h: np.ndarray, c: np.ndarray, context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the n-grams, which are in order and all there, stand among those of h and c, in order too."""
    both = np.lexsort((np.concatenate((np.zeros(len(h), np.int8), np.ones(len(context), np.int8))), np.concatenate((c, last)), np.concatenate((h, context))))
    return (np.cumsum(both < len(h)) - 1)[both >= len(h)]


def perplexity(docs: DataFrame, model: DataFrame, *, text_col: str = "text", shard_bytes: int = 32 << 20, block_size: int = 24 << 20) -> DataFrame:
    """docs with perplexity, per character of the whole text; null for null and empty texts. A column of that name is replaced.

    shard_bytes: of the model that a join's task meets at once, about. block_size: characters of texts whose n-grams are sent together; one text may have more.
    """
    docs = without(docs, ["perplexity"])
    spark, hidden = docs.sparkSession, fresh(docs.columns, "wg_log")
    path, usual = shared_dir(spark, "scored-blocks"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(docs.mapInArrow(trimmed(_blocks(path, text_col, block_size)), "block long, payload binary"), "scored-grams")
    grams = cut.mapInArrow(_unpacked, "block long, h long, c int")
    distinct = grams.select("h", "c").distinct()
    shards = _shards(model, shard_bytes)[0]
    if shards > usual:  # else as many as Spark deals by itself
        distinct = distinct.repartition(shards, "h", "c")
    known = stored(log_probabilities(distinct, model), "ngrams")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("h", "long"), ("c", "int"), ("p", "double"))]
    rows = grams.join(known, ["h", "c"]).select("block", "h", "c", "p").unionByName(cut.select("block", *none))
    rows = rows.repartition(max(usual, cut.count()), "block").sortWithinPartitions("block", F.col("h").asc_nulls_first(), "c")
    df = rows.mapInArrow(trimmed(_scored(path, text_col, hidden)), schema_with(docs, [T.StructField(hidden, T.DoubleType())]))
    length = F.length(f"`{text_col}`")
    return df.withColumn("perplexity", F.when(length > 0, F.exp(-F.col(hidden) / length))).drop(hidden)


def classify(docs: DataFrame, trusted_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, held_out: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with perplexity, threshold and accepted. trusted_ids: ids (in id_col) of documents whose text is trusted.

    Of the trusted documents one in held_out, by a hash of the id, gives the thresholds: the quantile of each language's perplexities, however many
    it has. A language without any takes the quantile of all; without any at all every document is accepted. A null language is a language of its own. Documents
    without text have no perplexity and are accepted. Columns named like a result are replaced. Repeated ids count each time.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, ["perplexity", "threshold", "accepted"])
    ids = limited(trusted_ids.select(F.col(f"`{id_col}`")).where(F.col(f"`{id_col}`").isNotNull()).distinct(), broadcast_rows)
    trusted = docs.join(ids, id_col, "left_semi").select(id_col, F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    apart = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(held_out)) == 0
    model = train(trusted.where(~apart), text_col="text")
    known = stored(perplexity(trusted.where(apart), model).select("lang", "perplexity").where("perplexity is not null"), "trusted-perplexity")
    every = known.agg(F.percentile_approx("perplexity", quantile, 100_000)).first()[0]
    language = fresh(docs.columns, "wg_lang")
    thresholds = known.groupBy(F.col("lang").alias(language)).agg(F.percentile_approx("perplexity", quantile, 100_000).alias("threshold"))
    scored = perplexity(docs, model, text_col=text_col)
    scored = scored.join(limited(thresholds, broadcast_rows), F.col(f"`{lang_col}`").eqNullSafe(F.col(language)), "left").drop(language)
    threshold = F.coalesce("threshold", F.lit(every).cast("double"))
    return scored.withColumn("threshold", threshold).withColumn("accepted", F.coalesce(F.col("perplexity") <= threshold, F.lit(True)))


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return classify(docs, trusted_labels(spark, sf_dir)).select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "accepted")
