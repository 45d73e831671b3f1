"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer becomes a deterministic transducer over bytes. What it must know of a word's prefix: for each place
where the next token may still begin, the bytes since, the token before that place and by how many tokens the count there
differs from the count now. The last token of a prefix's encoding is the one token that ends there and may follow the token
before it, so each byte leads to one state, and its transition emits how the count changes (a merge makes it fall). States are
compiled when a text first needs them, into a dense table that is emptied when it is full.

Words begin where the tokenizer's pattern says; that follows from classes of neighbouring characters. A batch's bytes are cut
into chunks that run side by side, one table look-up a byte. A chunk's map from entry to exit state is constant once a word
begins in it. The other chunks' maps are made for the states that may enter them: what the chunk before can leave, over all of its own
entries, until no chunk lacks one. Few rounds do, as states seldom depend on bytes far back. A parallel prefix scan then composes
the maps, doubling their reach each time, and gives every chunk its entry. Counts are sums of what a document's bytes emit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from wavegrid.llm.bpe import byte_names, vocabulary_path
from wavegrid.llm.common import chunks_of, extended, held, schema_with, small_batches, trimmed, utf8, without

VOCABULARY = "byte_bpe_50k.json"
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Fixed values of the tokenizer's pattern: what may follow an apostrophe as a word of its own.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def character_classes() -> np.ndarray:
    """The class of each code point, as the library's pattern engine has it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    classes = np.full(0x110000, OTHER, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(first, last)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                classes[first + a : first + b] = kind
    return classes


def word_starts(code: np.ndarray, classes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character. begins: where the segments begin, which are split on their own; none is empty."""
    n = len(code)
    kind = classes[code]
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run[begins] = True
    at = np.flatnonzero(run)
    end = np.append(at[1:], n)
    of, solid = kind[at], kind[at] != SPACE
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    blank = np.zeros(n + 1, bool)  # at i + 1: character i is a space that joins a word after it
    blank[1:] = code == 0x20
    joined = blank[at] & ~first[at]
    starts = np.zeros(n + 4, bool)
    starts[np.where(joined, at - 1, at)[solid]] = True
    space = ~solid
    last = space & first[end]  # white space that ends its segment is one word
    starts[at[last]] = True
    inner = space & ~first[end]
    starts[at[inner & (end - at >= 2)]] = True
    own = inner & (code[end - 1] != 0x20)
    starts[end[own] - 1] = True
    # an apostrophe that begins a word, and letters after it
    quote = at[(of == OTHER) & (code[at] == 0x27) & ~joined]
    if len(quote):
        text = np.append(code, [0, 0, 0])
        segment = np.searchsorted(begins, quote, side="right")
        limit = np.append(begins, n)[segment]
        taken = np.zeros(len(quote), bool)
        for letters in _CONTRACTIONS:
            fits = ~taken & (quote + len(letters) < limit)
            for k, c in enumerate(letters):
                fits &= text[quote + 1 + k] == ord(c)
            taken |= fits
            starts[quote[fits] + 1] = False
            starts[(quote + 1 + len(letters))[fits]] = True
    return starts[:n]


class Transducer:
    """limit: states after which the table is emptied, between batches."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not self.fits(spec):
            raise ValueError(f"{path} isn't a byte-level tokenizer of the form that is compiled here")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        names = byte_names()
        value = {c: b for b, c in enumerate(names)}
        self.names = names
        self.tokens = {bytes(value[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special and all(c in value for c in t)}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.bytes = {i: t for t, i in self.tokens.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.limit = limit
        self.clear()

    @staticmethod
    def fits(spec: dict) -> bool:
        """Whether a tokenizer's file is of the form that this class reproduces."""
        before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        return (spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and model.get("type", "BPE") == "BPE"
                and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
                and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]))

    def clear(self) -> None:
        """State 0 takes any byte and emits nothing; state 1 begins a word."""
        start = ((b"", -1, 0),)
        self.states: list[tuple] = [None, start]
        self.numbers = {start: 1}
        self.columns = np.full(256, -1, np.int16)
        self.width = 0
        self.table = np.full((4096, 32), -1, np.int32)
        self.table[0] = 128
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()

    def follows(self, a: int, b: int) -> bool:
        """Token b after token a (-1: first) is how their joint bytes are encoded."""
        if (a, b) not in self.pairs:
            joint = (self.bytes[a] if a >= 0 else b"") + self.bytes[b]
            found = [t.id for t in self.model.tokenize("".join([self.names[x] for x in joint]))]
            self.pairs[a, b] = found == ([a, b] if a >= 0 else [b])
        return self.pairs[a, b]

    def step(self, number: int, byte: int) -> int:
        """Compiles a transition: next state * 256 + 128 + what it emits."""
        live, ends, add = [], None, bytes((byte,))
        for since, before, count in self.states[number]:
            now = since + add
            if now in self.prefixes:
                live.append((now, before, count))
                token = self.tokens.get(now)
                if token is not None and ends is None and self.follows(before, token):
                    ends = token, count + 1
        token, emitted = ends
        state = (*((s, t, c - emitted) for s, t, c in live), (b"", token, 0))
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state] * 256 + 128 + emitted

    def compile(self, where: np.ndarray, bytes_: np.ndarray) -> None:
        """Fills the table for pairs of state and byte that it lacks."""
        for key in np.unique(where.astype(np.int64) * 256 + bytes_).tolist():
            number, byte = divmod(key, 256)
            if self.columns[byte] < 0:
                if self.width == self.table.shape[1]:
                    self.table = np.hstack((self.table, np.full(self.table.shape, -1, np.int32)))
                    self.table[0] = 128
                self.columns[byte] = self.width
                self.width += 1
            to = self.step(number, byte) if number else 128
            if len(self.states) > len(self.table):
                self.table = np.vstack((self.table, np.full(self.table.shape, -1, np.int32)))
            self.table[number, self.columns[byte]] = to

    def run(self, data: np.ndarray, starts: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs lanes side by side. data, starts: a row for each step, a column for each lane. Exit states, and what each byte emits."""
        emitted = np.empty(data.shape, np.int8)
        state = state.astype(np.int64)
        columns = self.columns[data]
        for j in range(len(data)):
            state = np.where(starts[j], 1, state)
            found = self.table[state, columns[j]]
            if (found < 0).any() or (columns[j] < 0).any():
                lacking, width = (found < 0) | (columns[j] < 0), self.width
                self.compile(state[lacking], data[j][lacking])
                if self.width > width:
                    columns = self.columns[data]
                found = self.table[state, columns[j]]
            state = found >> 8
            emitted[j] = (found & 255) - 128
        return state, emitted

    def emissions(self, data: np.ndarray, starts: np.ndarray, chunk: int) -> np.ndarray:
        """What each byte of a stream emits; the stream begins with a word."""
        if len(self.states) > self.limit:
            self.clear()
        n = len(data)
        lanes = -(-n // chunk)
        stream, marks = np.zeros(lanes * chunk, np.uint8), np.zeros(lanes * chunk, bool)
        stream[:n], marks[:n] = data, starts
        stream, marks = stream.reshape(lanes, chunk), marks.reshape(lanes, chunk)
        known = marks.any(axis=1)
        head = np.where(known, marks.argmax(axis=1), chunk)
        exits, out = self.run(np.ascontiguousarray(stream.T), np.ascontiguousarray(marks.T), np.zeros(lanes, np.int64))
        out = np.ascontiguousarray(out.T).astype(np.int32)
        whole = np.flatnonzero(~known)
        if len(whole):
            _, left, sums = self.composed(stream, whole, exits, n)
            exits[whole] = left
            out[whole] = 0
            out[whole, 0] = sums  # such a chunk lies within one word, so within one document
        rest = np.flatnonzero(known & (head > 0))
        rest = rest[np.argsort(-head[rest], kind="stable")]
        length, state = head[rest], exits[rest - 1]
        none = np.zeros((1, len(rest)), bool)
        for j in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -j, side="left"))
            to, e = self.run(stream[rest[:live], j][None], none[:, :live], state[:live])
            state[:live] = to
            out[rest[:live], j] = e[0]
        return out.reshape(-1)[:n]

    def composed(self, stream: np.ndarray, whole: np.ndarray, exits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry and exit states of the chunks in which no word begins, and what each emits in all. exits: of the other chunks; n: bytes of the stream."""
        follows = np.zeros(len(whole), bool)  # the chunk before is one of them too
        follows[1:] = whole[1:] == whole[:-1] + 1
        # lanes: a chunk (its place in whole) from an entry state. A chunk after another is tried from a word's first state, to see what may leave it.
        at, state = np.arange(len(whole)), np.where(follows, 1, exits[whole - 1])
        lanes = [np.zeros(0, np.int64)] * 4  # place, entry, exit, emitted; sorted by place and entry
        while len(at):
            data = np.ascontiguousarray(stream[whole[at]].T)
            to, emitted = self.run(data, np.zeros(data.shape, bool), state)
            emitted[n - (len(stream) - 1) * stream.shape[1] :, whole[at] == len(stream) - 1] = 0  # the last chunk is filled up
            lanes = [np.concatenate(x) for x in zip(lanes, (at, state, to, emitted.sum(axis=0, dtype=np.int64)), strict=True)]
            order = np.lexsort((lanes[1], lanes[0]))
            lanes = [x[order] for x in lanes]
            handed = (at + 1 < len(whole)) & follows[np.minimum(at + 1, len(whole) - 1)]
            wanted = np.unique((at[handed] + 1) << 32 | to[handed])
            wanted = wanted[~np.isin(wanted, lanes[0] << 32 | lanes[1])]
            at, state = wanted >> 32, wanted & 0xFFFFFFFF
        begin = np.searchsorted(lanes[0], np.arange(len(whole)))
        keys = lanes[0] << 32 | lanes[1]
        # chunk k's row: for each of the entries of the chunk before, which of its own entries it leads to; a first chunk has one entry
        before = np.where(follows, np.arange(len(whole)) - 1, 0)
        width = int(np.diff(np.append(begin, len(keys))).max())
        lane = np.minimum(begin[before][:, None] + np.arange(width), len(keys) - 1)
        maps = np.where(follows[:, None], np.searchsorted(keys, np.arange(len(whole))[:, None] << 32 | lanes[2][lane]) - begin[:, None], 0)
        maps = np.clip(maps, 0, width - 1)  # what stands beyond a chunk's entries is never looked up
        reach = 1
        while reach < len(whole):
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
            reach *= 2
        lane = begin + maps[:, 0]
        return lanes[1][lane], lanes[2][lane], lanes[3][lane]

    def counts(self, texts: list[bytes | None], classes: np.ndarray, chunk: int = 512) -> np.ndarray:
        """Tokens of each text, special strings in it as one each."""
        total = np.zeros(len(texts), np.int64)
        segments: list[bytes] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            parts = [text or b""]
            for s in self.special:
                if s in parts[0] or len(parts) > 1:
                    split = [p.split(s) for p in parts]
                    total[i] += sum(len(p) - 1 for p in split)
                    parts = [x for p in split for x in p]
            for p in parts:
                if p:
                    segments.append(p)
                    owner.append(i)
        if not segments:
            return total
        data = np.frombuffer(b"".join(segments), np.uint8)
        code = np.frombuffer(b"".join(segments).decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        begins = np.concatenate(([0], np.cumsum([len(s) for s in segments])[:-1]))
        starts = np.zeros(len(data), bool)
        starts[lead[word_starts(code, classes, np.searchsorted(lead, begins))]] = True
        sums = np.add.reduceat(self.emissions(data, starts, chunk).astype(np.int64), begins)
        np.add.at(total, owner, sums)
        return total


def count_tokens(docs: DataFrame, *, text_col: str = "text", path: str | None = None, batch_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens of each whole text, as the library counts them without added special tokens.

    Nulls and empty texts have none. Columns named like a result are replaced. A text of any length stays in one batch. path: a
    byte-level vocabulary with the usual pattern; another raises.
    """
    import zlib

    path = path or vocabulary_path(VOCABULARY)
    small_batches(docs.sparkSession)
    docs = without(docs, ["n_bytes", "n_tokens"])
    classes = docs.sparkSession.sparkContext.broadcast(zlib.compress(character_classes().tobytes()))  # always 1,114,112 entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = np.frombuffer(zlib.decompress(classes.value), np.uint8)
        compiled = held(("counts", path), lambda: Transducer(path))
        for table in chunks_of(batches, text_col, batch_bytes):
            texts = utf8(table.column(text_col))
            yield from extended(table, {"n_bytes": pa.array([len(t or b"") for t in texts], pa.int64()), "n_tokens": pa.array(compiled.counts(texts, table_of))})

    return docs.mapInArrow(trimmed(run, "counts"), schema_with(docs, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
