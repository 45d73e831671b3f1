"""BPE encoding and decoding with a public tokenizer's vocabulary.

Text is encoded between ASCII white space, where the tokenizer always splits, with a bounded memo. Text that has none for
long is encoded by tree concatenation: halves are encoded on their own, then ever larger windows around the join are encoded
until a token of the window agrees, in place and id, with one of the left half, and a later one with one of the right half.
Tokens before the first, of the window between them, and after the second are then the encoding of the whole: in a BPE
encoding every two neighbours are the encoding of their joint text, and a sequence of such neighbours is the encoding.
Documents over a length are cut into pieces that different tasks encode; their tokens are joined in the same way.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from wavegrid.llm.common import chunks_of, extended, fresh, held, schema_with, small_batches, split_words, trimmed, utf8, without

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(words: pa.Array) -> np.ndarray:
    """Words without control characters, of code points below U+0280 but for U+0080 to U+00BF: the library's normaliser only lower-cases
    them, and Unicode's versions agree on their classes."""
    if not len(words):
        return np.zeros(0, bool)
    data, at = np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words)]
    odd = (data < 0x21) | (data == 0x7F) | (data == 0xC2) | (data > 0xC9)
    return ~np.logical_or.reduceat(odd[: int(np.frombuffer(words.buffers()[1], np.int64)[words.offset + len(words)])], at)


class Merges:
    """The vocabulary's merges in a byte-pair engine that takes many words at once.

    The engine joins two neighbours whenever the vocabulary has their text, the lowest rank first; the library joins only those
    that a merge names. For tokens that the merges make from their own text both do the same: until then, what happens within
    a token's text is what happens to that text alone, whose last step is its merge. Other tokens are left out, as the library
    never makes them. A carriage return marks a word's end; its joints with single bytes come before all merges.
    """

    def __init__(self, spec: dict):
        from tiktoken import Encoding
        from tokenizers.models import BPE

        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        value = {c: b for b, c in enumerate(byte_names())}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        bare, ended = BPE(vocab=model["vocab"], merges=pairs), BPE(vocab=model["vocab"], merges=pairs, end_of_word_suffix=self.suffix)
        ranks = {bytes((b,)): b for b in range(256)}
        ids = [model["vocab"].get(c, -1) for c in byte_names()]
        for b, c in enumerate(byte_names()):
            ranks[bytes((b, 13))] = 256 + b
            ids.append(model["vocab"].get(c + self.suffix, -1))
        for x, y in pairs:
            name = x + y
            ends = name.endswith(self.suffix)
            text = name.removesuffix(self.suffix) if ends else name
            if name in model["vocab"] and [t.value for t in (ended if ends else bare).tokenize(text)] == [name]:
                ranks.setdefault(bytes(value[c] for c in text) + b"\r" * ends, len(ids))
            ids.append(model["vocab"].get(name, -1))
        self.ids = np.array(ids, np.int32)
        self.engine = Encoding("merges", pat_str=r"[^\r\n]+\r|\n", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    @staticmethod
    def fits(spec: dict) -> bool:
        """Whether a tokenizer's file is of the form that this class reproduces."""
        try:
            normalizers = [n["type"] for n in spec["normalizer"]["normalizers"]]
            first, second = spec["pre_tokenizer"]["pretokenizers"]
            model = spec["model"]
            return (normalizers == ["NFC", "Replace", "Lowercase"] and first["behavior"] == "Removed" and first["invert"] and second["type"] == "ByteLevel" and not second["use_regex"] and not second["add_prefix_space"]
                    and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")))
        except (KeyError, TypeError, ValueError):
            return False

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        out = []
        for begin in range(0, len(words), 5000):
            text = b"\n".join(words[begin : begin + 5000]).decode().lower()
            out.append(np.array(self.engine.encode_ordinary(self.words.sub(r"\g<0>\r", text)), np.int32))
            out.append(np.array([10], np.int32))
        ranks = np.concatenate(out)
        cuts = np.flatnonzero(ranks == 10)
        ids = self.ids[ranks[ranks != 10]]
        if (ids < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        return ids, np.diff(np.concatenate(([-1], cuts))) - 1


def byte_names() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, more = [""] * 256, 256
    for b in range(256):
        names[b] = chr(b) if b in plain else chr(more)
        more += b not in plain
    return names


@dataclass
class Tokens:
    """Ids with the characters [start, end) that each stands for."""

    ids: list[int]
    starts: list[int]
    ends: list[int]

    def moved(self, by: int) -> Tokens:
        return Tokens(self.ids, [s + by for s in self.starts], [e + by for e in self.ends])

    def clean(self, i: int) -> bool:
        """Token i shares no character with its neighbours."""
        return (i == 0 or self.ends[i - 1] <= self.starts[i]) and (i + 1 == len(self.ids) or self.ends[i] <= self.starts[i + 1])


class Encoder:
    """leaf: characters of text without white space that are encoded at once. memo: pieces between white space that are remembered."""

    def __init__(self, path: str, leaf: int = 2048, memo: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.most = leaf, memo
        self.forget()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec) if Merges.fits(spec) else None
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.apart = special[0] if special else None

    def whole(self, text: str) -> Tokens:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return Tokens(e.ids, [o[0] for o in e.offsets], [o[1] for o in e.offsets])

    def joined(self, text: str, left: Tokens, right: Tokens, middle: int, window: int = 32) -> Tokens:
        """left and right: tokens of text before and after middle, by their places in text."""
        while True:
            low, high = max(0, middle - window), min(len(text), middle + window)
            w = self.whole(text[low:high]).moved(low)
            at = {(w.starts[k], w.ends[k], w.ids[k]): k for k in range(len(w.ids)) if w.clean(k)}
            i, k = 0, 0
            if low:
                i = next((i for i in range(len(left.ids) - 1, -1, -1) if left.starts[i] >= low and left.clean(i) and (left.starts[i], left.ends[i], left.ids[i]) in at), -1)
                k = at[left.starts[i], left.ends[i], left.ids[i]] if i >= 0 else -1
            j, m = len(right.ids), len(w.ids)
            if high < len(text):
                j = next((j for j in range(len(right.ids)) if right.ends[j] <= high and right.clean(j) and (right.starts[j], right.ends[j], right.ids[j]) in at), -1)
                m = at[right.starts[j], right.ends[j], right.ids[j]] if j >= 0 else -1
            if min(i, k, j, m) >= 0:
                return Tokens(*([*getattr(left, f)[:i], *getattr(w, f)[k:m], *getattr(right, f)[j:]] for f in ("ids", "starts", "ends")))
            window *= 2

    def tree(self, text: str) -> Tokens:
        """Halves down to leaf characters, joined upwards."""
        if len(text) <= self.leaf:
            return self.whole(text)
        parts = []
        for begin in range(0, len(text), self.leaf):
            piece = self.whole(text[begin : begin + self.leaf])
            parts.append((begin, piece.moved(begin)))
        return self.concatenated(text, parts)

    def concatenated(self, text: str, parts: list[tuple[int, Tokens]]) -> Tokens:
        """Neighbouring parts (where each begins, its tokens) are joined two by two until one is left. Each join sees its two parts' text only."""
        ends = [p[0] for p in parts[1:]] + [len(text)]
        parts = [(b, e, t) for (b, t), e in zip(parts, ends, strict=True)]
        while len(parts) > 1:
            above = []
            for k in range(0, len(parts) - 1, 2):
                (b, middle, left), (_, e, right) = parts[k : k + 2]
                t = self.joined(text[b:e], left.moved(-b), right.moved(-b), middle - b)
                above.append((b, e, t.moved(b)))
            parts = above + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0][2] if parts else Tokens([], [], [])

    def learn(self, words: list[bytes], plain: np.ndarray) -> None:
        """Remembers the words' ids. plain: words for which the merges' engine may stand in for the library."""
        apart = self.apart[0].encode() if self.apart else None
        quick = [w for w, p in zip(words, plain.tolist(), strict=True) if p and len(w) <= self.leaf and b"<|" not in w] if self.merges else []
        done = set(quick)
        short = [w for w in words if w not in done and apart and len(w) <= self.leaf and apart not in w]
        done.update(short)
        long = [w for w in words if w not in done] if len(done) < len(words) else []
        fresh: list[np.ndarray] = []
        if quick:
            ids, counts = self.merges.encode(quick)
            fresh.append(ids)
            self.counts.append(counts)
        for begin in range(0, len(short), 100):
            ids = np.array(self.tokenizer.encode_batch_fast([apart.join(short[begin : begin + 100]).decode()], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.apart[1])
            fresh.append(ids[ids != self.apart[1]])
            self.counts.append(np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)
        for w in long:
            fresh.append(np.array(self.tree(w.decode()).ids, np.int32))
            self.counts.append(np.array([len(fresh[-1])]))
        first = len(self.known)
        self.known.update(zip([*quick, *short, *long], range(first, first + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, *fresh])
        self.counts = [np.concatenate(self.counts)]
        self.begins = np.concatenate(([0], np.cumsum(self.counts[0])))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin, with their number; a null has none."""
        words, distinct, starts = split_words(texts)
        names = distinct.to_pylist()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if len(self.known) + len(missing) > self.most:
                self.forget()
                missing = np.arange(len(names))
            lost = [names[i] for i in missing.tolist()]
            self.learn(lost, _plain(distinct)[missing])
            at[missing] = np.fromiter(map(self.known.get, lost), np.int64, len(lost))
        place = at[words] if len(words) else words
        count = self.counts[0][place] if len(words) else place
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.begins[place] - (ends - count), count) + np.arange(total)] if total else np.zeros(0, np.int32)
        return flat, np.concatenate(([0], ends))[starts]

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.counts, self.begins = np.zeros(0, np.int32), [np.zeros(0, np.int64)], np.zeros(1, np.int64)


class Decoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = pa.array([self.tokenizer.id_to_token(i) for i in range(size)], pa.string())
        if self.tokenizer.decoder is None:  # then decoding joins the tokens' names with spaces
            self.tokenizer = None

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """As the library decodes with special tokens kept."""
        if self.tokenizer:
            return pa.array([self.tokenizer.decode(i or [], skip_special_tokens=False) for i in ids.to_pylist()], pa.string())
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.names.take(ids.flatten())), " ")


def encoder(path: str, **options) -> Encoder:
    """The worker process's own."""
    return held(("bpe", path, *sorted(options.items())), lambda: Encoder(path, **options))


def ids_array(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    flat = np.fromiter((x for i in ids for x in i), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_rows(path: str, text_col: str, batch_bytes: int = 2 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for table in chunks_of(batches, text_col, batch_bytes):
            flat, begins = e.encode(utf8(table.column(text_col)))
            yield from extended(table, {"ids": pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(flat))})

    return run


def _cut_long(text_col: str, row: str, part: str, piece: int):
    """Pieces of long texts, each with its row's number; the first keeps the row's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for i in range(batch.num_rows):
                text = batch.column(at)[i].as_py()
                for k, begin in enumerate(range(0, len(text), piece)):
                    one = pa.Table.from_batches([batch.slice(i, 1)]).set_column(at, text_col, pa.array([text[begin : begin + piece]]))
                    if k:
                        one = pa.table([c if j == at else pa.nulls(1, c.type) for j, c in enumerate(one.columns)], one.column_names)
                    yield from extended(one, {row: pa.array([number]), part: pa.array([k], pa.int32())})
                number += 1

    return run


def _encode_pieces(path: str, text_col: str, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                t = e.tree(one.column(text_col)[0].as_py())
                yield from extended(one, {"ids": ids_array([t.ids]), spans: ids_array([[x for pair in zip(t.starts, t.ends, strict=True) for x in pair]])})

    return run


def _join_pieces(path: str, text_col: str, row: str, part: str, spans: str):
    def run(key, table):
        table = table.sort_by(part)
        pieces = table.column(text_col).to_pylist()
        parts, begin = [], 0
        for text, ids, at in zip(pieces, table.column("ids").to_pylist(), table.column(spans).to_pylist(), strict=True):
            parts.append((begin, Tokens(ids, at[::2], at[1::2]).moved(begin)))
            begin += len(text)
        text = "".join(pieces)
        t = encoder(path).concatenated(text, parts)
        kept = table.slice(0, 1).select([c for c in table.column_names if c not in (row, part, spans)])
        kept = kept.set_column(kept.column_names.index(text_col), text_col, pa.array([text]))
        return kept.set_column(kept.column_names.index("ids"), "ids", ids_array([t.ids]))

    return run


def encode(docs: DataFrame, *, text_col: str = "text", path: str | None = None, piece: int = 1 << 16) -> DataFrame:
    """docs with ids (array of int): each whole text's ids, without begin, end or padding.

    Texts of more than piece characters are cut, encoded by several tasks and joined; the others aren't shuffled. Nulls and
    empty texts have no ids; repeated rows are encoded each. Special strings in a text are encoded as the library does by default. A column named ids is replaced.
    """
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    docs = without(docs, ["ids"])
    length = F.coalesce(F.length(f"`{text_col}`"), F.lit(0))
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    short = docs.where(length <= piece).mapInArrow(trimmed(_encode_rows(path, text_col), "bpe"), schema_with(docs, [ids]))
    row, part, spans = (fresh(docs.columns, f"wg_{k}") for k in ("row", "part", "spans"))
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    pieces = docs.where(length > piece).mapInArrow(_cut_long(text_col, row, part, piece), T.StructType([*nullable.fields, T.StructField(row, T.LongType()), T.StructField(part, T.IntegerType())]))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as pieces are small and their work isn't: they are not to be put together
    encoded = pieces.repartition(tasks, row, part).mapInArrow(trimmed(_encode_pieces(path, text_col, spans), "bpe"), schema_with(pieces, [ids, T.StructField(spans, T.ArrayType(T.IntegerType()))]))
    long = encoded.groupBy(row).applyInArrow(_join_pieces(path, text_col, row, part, spans), T.StructType([*nullable.fields, ids]))
    return short.union(long)


def decode(tokens: DataFrame, *, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """tokens with decoded: the text that the library decodes from the ids, special tokens kept. A null or no ids give the empty text."""
    path = path or vocabulary_path()
    tokens = without(tokens, ["decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                table = pa.Table.from_batches([batch.slice(begin, 500)]).combine_chunks()
                yield from extended(table, {"decoded": d.decoded(table.column(ids_col).chunk(0))})

    return tokens.mapInArrow(trimmed(run, "bpe"), schema_with(tokens, [T.StructField("decoded", T.StringType())]))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs).select("doc_id", "ids"))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
