"""Token counts at every prefix of a text.

Byte-pair merging has a prefix property: the tokens of a text, cut after any of them, are the tokens of the text up to
there. So the encoding of every prefix follows by dynamic programming from the encodings of shorter prefixes: the last
token of a prefix is the one vocabulary entry ending there that merging leaves apart from the last token of the prefix
before it, and its count is one more than the count there. Whether two tokens stay apart is asked of the tokenizer
itself, once a pair. Stored counts then answer truncation and budget questions without encoding again.

They are stored as steps from each prefix to the next, a byte each (four, where a text has a step that a byte doesn't
hold), from which the counts come back exactly.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, table, texts
from .lattice import Lattice, Vocabulary, lattices

SPACE = "▁"  # stands for a space inside pieces
PAIR_BITS = 20  # of the table of token pairs; a newer pair takes the place of an older one


class PrefixCounter:
    """Counts of all prefixes under a sentencepiece BPE model, with memories of bounded size for words and token pairs."""

    def __init__(self, model_file: str, most_words: int = 250_000, window: int = 4096):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after other characters: words aren't independent in this model")
        if "\n" in pieces:
            raise ValueError("the model has a piece for the line break, which must separate here")
        self.pieces = Vocabulary(pieces)
        self.most_words, self.window = most_words, window
        self.steps: dict[str, bytes | None] = {}  # None: a step doesn't fit a byte
        self.wide: dict[str, np.ndarray] = {}
        self.pairs, self.apart = np.full(1 << PAIR_BITS, ~np.uint64(0)), np.zeros(1 << PAIR_BITS, bool)

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two tokens of each pair as they are."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        apart, missing = self.apart[slots], np.flatnonzero(self.pairs[slots] != keys)
        if len(missing):
            new, which = np.unique(keys[missing], return_inverse=True)
            names = [[self.pieces.entries[k >> 32], self.pieces.entries[k & 0xFFFFFFFF]] for k in new.tolist()]
            # the line break is no piece: what follows it is encoded on its own
            asked = self.model.encode(["\n" + "".join(n).replace(SPACE, " ") for n in names], out_type=str, num_threads=1)
            apart[missing] = np.array([a[2:] == n for a, n in zip(asked, names, strict=True)])[which]
            self.pairs[slots[missing]] = keys[missing]
            self.apart[slots[missing]] = apart[missing]
        return apart

    def _counts_long(self, word: str) -> np.ndarray:
        """The same for one long word, window by window, so that entries by size are held for one window at a time."""
        longest, n = self.pieces.longest, len(word)
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        known: dict[tuple[int, int], bool] = {}
        for first in range(0, n, self.window):
            begin, stop = max(0, first - longest + 1), min(n, first + self.window)
            lattice = Lattice(self.pieces, np.zeros(1, np.int64), [word[begin:stop]])
            table = np.stack([ids[0, first - begin :] for ids in lattice.ids], 1)
            single, spelled = table[:, 0].tolist(), lattice.utf8_sizes()[0, first - begin :].tolist()
            # entries by end, the longest first
            ends, turned = np.nonzero(table[:, ::-1] >= 0)
            sizes = table.shape[1] - turned
            pieces = table[ends, sizes - 1].tolist()
            ends, sizes, k = ends.tolist(), sizes.tolist(), 0
            for e in range(stop - first):
                end, taken = first + e + 1, False
                while k < len(ends) and ends[k] == e:
                    if not taken:
                        size, piece = sizes[k], pieces[k]
                        before = last[end - size]
                        taken = before < 0
                        if not taken:
                            if len(known) > 1_000_000:
                                known.clear()
                            taken = known.get((before, piece))
                            if taken is None:
                                taken = known[before, piece] = bool(self.stay_apart(np.array([before]), np.array([piece]))[0])
                        if taken:
                            last[end], counts[end] = piece, counts[end - size] + 1
                    k += 1
                if not taken:
                    if single[e] >= 0:
                        raise ValueError("no token ends where a known character does: this isn't a BPE vocabulary")
                    counts[end] = counts[end - 1] + spelled[e]
        return np.array(counts, np.int32)

    def counts(self, words: list[str]):
        """For chunks of the words: their places in the list, lengths and counts at prefixes of 0, 1, ... characters."""
        long_ = [i for i, w in enumerate(words) if len(w) > self.window]
        for i in long_:
            yield np.array([i]), np.array([len(words[i])]), self._counts_long(words[i])[None, :]
        short = np.array([i for i in range(len(words)) if len(words[i]) <= self.window], np.int64)
        for lattice in lattices(self.pieces, [words[i] for i in short.tolist()]):
            lattice.rows = short[lattice.rows]
            n, width = lattice.codes.shape
            last, counts = np.full((n, width + 1), -1, np.int64), np.zeros((n, width + 1), np.int32)
            spelled = lattice.utf8_sizes()
            for end in range(1, width + 1):
                open_ = lattice.sizes >= end
                for size in range(min(end, len(lattice.ids)), 0, -1):
                    ids = lattice.ids[size - 1][:, end - 1]
                    rows = np.flatnonzero((ids >= 0) & open_)
                    if not len(rows):
                        continue
                    before, piece = last[rows, end - size], ids[rows]
                    fits = before < 0
                    asks = np.flatnonzero(~fits)
                    if len(asks):
                        fits[asks] = self.stay_apart(before[asks], piece[asks])
                    rows = rows[fits]
                    last[rows, end], counts[rows, end] = piece[fits], counts[rows, end - size] + 1
                    open_[rows] = False
                rows = np.flatnonzero(open_)  # byte tokens, which nothing merges with
                if len(rows):
                    if (lattice.ids[0][rows, end - 1] >= 0).any():
                        raise ValueError("no token ends where a known character does: this isn't a BPE vocabulary")
                    counts[rows, end] = counts[rows, end - 1] + spelled[rows, end - 1]
            yield lattice.rows, lattice.sizes, counts

    @staticmethod
    def parts(text: str) -> list[str]:
        """Independent parts of a text. "x" stands for a space and x, "\\nx" for a line break and x; others begin with "▁"."""
        if "  " in text or SPACE in text or text[:1] == " ":
            text, out = (SPACE + text).replace(" ", SPACE), []
            for k, line in enumerate(text.split("\n")):
                found = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)
                if k:
                    out.append("\n" + (found.pop(0) if found and found[0][0] != SPACE else ""))
                out += found
            return out
        return text.replace("\n", " \n").split(" ") if text else []

    @staticmethod
    def word(part: str) -> str:
        return part[1:] if part[:1] == "\n" else part if part[:1] == SPACE else SPACE + part

    def learn(self, parts: set[str]) -> list[str]:
        """Put steps of the parts that are missing into the memory; returns those parts."""
        new = list(parts.difference(self.steps))
        asked = [p for p in new if p != "\n"]
        if "\n" in parts:
            self.steps["\n"] = b"\1"
        for rows, sizes, counts in self.counts([self.word(p) for p in asked]):
            steps = np.diff(counts, axis=1)
            width, fits = steps.shape[1], np.abs(steps).max(axis=1, initial=0) <= 127
            narrow = steps.astype(np.int8).tobytes()
            for k, (row, size) in enumerate(zip(rows.tolist(), sizes.tolist(), strict=True)):
                part = asked[row]
                line = part[:1] == "\n"
                # what lies beyond the word's size is no step of it
                if fits[k] or np.abs(steps[k, :size]).max(initial=0) <= 127:
                    self.steps[part] = b"\1" * line + narrow[k * width : k * width + size]
                else:
                    self.steps[part], self.wide[part] = None, np.concatenate([[1] * line, steps[k, :size]]).astype("<i4")
        return new

    def stored(self, parts: list[str]) -> bytes:
        """The steps of a text: their size in bytes, then those of all its parts. The first is that of the space in front."""
        try:
            return b"\1" + b"".join(map(self.steps.__getitem__, parts))
        except TypeError:
            every = [self.wide[p] if self.steps[p] is None else np.frombuffer(self.steps[p], np.int8) for p in parts]
            return b"\4" + np.concatenate(every).astype("<i4").tobytes()

    def of_texts(self, texts: list[str], most: int = 3_000_000) -> list[bytes]:
        """Stored steps of whole texts, in groups of about ``most`` characters."""
        out, group, size = [], [], 0
        for k, text in enumerate(texts):
            group.append(self.parts(text))
            size += len(text)
            if size > most or k == len(texts) - 1:
                new = self.learn(set().union(*group))
                out += map(self.stored, group)
                if len(self.steps) > self.most_words:
                    for part in new:
                        self.steps.pop(part, None)
                        self.wide.pop(part, None)
                group, size = [], 0
        return out


def _steps(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<i4" if stored[0] == 4 else np.int8, offset=1)


def counts_of(stored: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... code points from stored steps."""
    counts = np.cumsum(_steps(stored), dtype=np.int64)
    # the space that the model puts in front is no character of the text
    return np.concatenate([[0], counts[1:]]).astype(np.uint32)


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    """One for each worker process and model."""
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def _columns(docs: DataFrame) -> list[T.StructField]:
    return [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType())]


def prefix_steps(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``prefix_steps``, from which ``counts_of`` reads the count at every prefix, of each row of ``docs``."""
    schema = T.StructType([*_columns(docs), T.StructField("prefix_steps", T.BinaryType())])

    def count(batches):
        import pyarrow as pa

        counts = counter(model_file)
        for batch, rows in texts(batches):
            stored = counts.of_texts([b.decode("utf-8", "replace") for b in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in rows], pa.int64()), pa.array(stored, pa.binary())], [f.name for f in schema.fields])

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(count, schema)


def from_steps(steps: DataFrame, limit: int = 4096, keep: bool = True) -> DataFrame:
    """The columns of ``prefix_token_counts`` from those of ``prefix_steps``."""
    fields = [*_columns(steps), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    schema = T.StructType(fields + [T.StructField("prefix_counts", T.BinaryType())] * keep)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            stored = batch.column(2).to_pylist()
            totals = [int(_steps(s).sum(dtype=np.int64)) for s in stored]
            columns = [batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())]
            if keep:
                columns.append(pa.array([counts_of(s).astype("<u4").tobytes() for s in stored], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return steps.select("doc_id", "n_bytes", "prefix_steps").mapInArrow(read, schema)


def prefix_token_counts(docs: DataFrame, model_file: str, limit: int = 4096, keep: bool = True, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` and, with ``keep``, ``prefix_counts`` of each row of ``docs``.

    ``prefix_counts`` holds a little-endian unsigned 32-bit count for each prefix of 0, 1, ... code points. A null text
    counts as empty (no tokens); rows are never merged, so repeated rows and null ids come back as they are; an empty
    table gives an empty result; other columns are ignored. A pass over the rows: no shuffle, and memory for one Arrow
    batch and two bounded tables in each worker.
    """
    return from_steps(prefix_steps(docs, model_file, text), limit, keep)


def longest_prefix(counts: DataFrame, budget: int) -> DataFrame:
    """Adds ``prefix_chars``, the most code points whose prefix has at most ``budget`` tokens, from stored counts or steps.

    A longer prefix can have fewer tokens, so the whole array is looked through. A null array gives null.
    """
    name = "prefix_steps" if "prefix_steps" in counts.columns else "prefix_counts"

    @F.pandas_udf(T.LongType())
    def longest(stored):
        def one(raw):
            if raw is None:
                return None
            fits = np.flatnonzero((counts_of(raw) if name == "prefix_steps" else np.frombuffer(raw, "<u4")) <= budget)
            return int(fits[-1]) if len(fits) else None

        return stored.map(one, na_action=None).astype("Int64")

    return counts.withColumn("prefix_chars", longest(name))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return from_steps(stash(prefix_steps(docs, public_tokenizers.path("piece_bpe_32k.model"))), 4096, keep=False)


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
