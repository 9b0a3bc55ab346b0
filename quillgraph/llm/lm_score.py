"""Language-model scores by the likelihood of all segmentations into subwords.

A text is a sequence of words and an end. The model draws pieces of an existing vocabulary, each by its own probability,
and an end; pieces that begin a word carry the space mark, so a sequence of pieces spells exactly one text. The
probability of a text is the sum over all its segmentations. No piece crosses a word's begin: there the lattice of the
document has a single node, and its forward recursion falls into one for each word, whose log-sums add up. So the
recursion runs once for each distinct word.

The vocabulary file stores merge ranks, no probabilities. Scores come from the training documents: pieces start from their
length, and expectation maximisation over the lattices of all training words, weighted by their counts, reweights them.
A character that no piece spells falls back to its bytes.

Data flow, without a table of words for each document and without shuffling texts: where a text lies its words become
numbers of a block's vocabulary, and the rows of a block (of a bounded size, within one partition) leave as arrays of
those numbers. The block sends each of its distinct words once to the word's bucket, with its training count, packed into
a few rows; buckets add up counts and send (count, score) back to the blocks that asked. A very common word is one entry
for each block, not one for each use. A word of thousands of characters runs through windows that carry the recursion's
state, so its time and memory grow with its length alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, slices, stash, table
from .lattice import PAD, Lattice, Vocabulary, lattices

SPACE = "▁"
FOLDS, HELD_OUT = 7, 2


class Pieces:
    """Vocabulary, fallback to bytes, and log probabilities (natural) of pieces, bytes and the end, in this order."""

    def __init__(self, entries: list[str], window: int = 4096):
        self.vocabulary, self.window = Vocabulary(entries), window
        self.size = len(entries) + 256 + 1

    def start(self) -> np.ndarray:
        weights = np.array([4.0 ** -len(e) for e in self.vocabulary.entries] + [1e-6] * 256 + [0.05])
        return np.log(weights / weights.sum())

    def _bytes(self, codes: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of code points as ids; -1 beyond their number."""
        out = np.full((len(codes), 4), -1, np.int64)
        for k, c in enumerate(codes.tolist()):
            raw = chr(c).encode("utf-8", "surrogatepass")
            out[k, : len(raw)] = list(raw)
        return np.where(out < 0, -1, out + len(self.vocabulary.entries))

    def _costs(self, lattice: Lattice, log_p: np.ndarray):
        """Log probabilities of entries by size and place; where unknown characters stand and their bytes."""
        costs = [np.where(ids >= 0, log_p[ids], -np.inf) for ids in lattice.ids]
        unknown = np.nonzero((lattice.ids[0] < 0) & (lattice.codes < PAD))
        spelled = self._bytes(lattice.codes[unknown]) if len(unknown[0]) else np.zeros((0, 4), np.int64)
        costs[0][unknown] = np.where(spelled >= 0, log_p[spelled], 0.0).sum(1)
        return costs, unknown, spelled

    def _forward_long(self, word: str, log_p: np.ndarray, expected: np.ndarray | None, weight: float) -> float:
        """The same for one long word, window by window; the state between windows is the sums at the last places."""
        n, longest = len(word), self.vocabulary.longest
        ahead = np.full(n + 1, -np.inf)
        ahead[0] = 0.0

        def window(first: int, last: int):
            return self._costs(lattice := Lattice(self.vocabulary, np.zeros(1, np.int64), [word[first:last]]), log_p), lattice

        def run(sums: np.ndarray, costs: np.ndarray, at: int, backwards: bool) -> None:
            """Fill ``sums`` over a window; ``costs`` has a row for each place, in the order of the run, and a column for each size."""
            places, sizes = np.nonzero(np.isfinite(costs))
            values, here = costs[places, sizes].tolist(), sums.tolist()
            k, sizes, places = 0, (sizes + 1).tolist(), places.tolist()
            while k < len(places):
                p, terms = places[k], []
                end = at - p if backwards else at + p
                while k < len(places) and places[k] == p:
                    terms.append(here[end + sizes[k] if backwards else end - sizes[k]] + values[k])
                    k += 1
                top = max(terms)
                if top > -np.inf:
                    here[end] = top + math.log(sum(math.exp(t - top) for t in terms))
            sums[:] = here

        for first in range(0, n, self.window):
            begin, last = max(0, first - longest + 1), min(n, first + self.window)
            (costs, _, _), _ = window(begin, last)
            # a row for each end behind ``first``; entries that begin before the window's text aren't in it
            table = np.stack([c[0, first - begin :] for c in costs], 1)
            part = ahead[begin : last + 1].copy()
            run(part, table, first - begin + 1, False)
            ahead[first + 1 : last + 1] = part[first - begin + 1 :]
        whole = float(ahead[n])
        if expected is None or weight <= 0:
            return whole
        back = np.full(n + 1, -np.inf)
        back[n] = 0.0
        for first in reversed(range(0, n, self.window)):
            last = min(n, first + self.window)
            stop = min(n, last + longest - 1)
            (costs, unknown, spelled), lattice = window(first, stop)
            # by begin: the entry of size s that begins at a place ends s - 1 places on
            table = np.full((last - first, len(costs)), -np.inf)
            for s, c in enumerate(costs):
                ends = c[0, s : s + last - first]
                table[: len(ends), s] = ends
            part = back[first : stop + 1].copy()
            run(part, table[::-1], last - 1 - first, True)
            back[first:last] = part[: last - first]
            share_one = np.zeros(stop - first)
            for s, c in enumerate(costs):
                ids = lattice.ids[s][0, s : s + last - first]
                m = len(ids)
                share = np.exp(ahead[first : first + m] + table[:m, s] + back[first + s + 1 : first + s + 1 + m] - whole) * weight
                real = (ids >= 0) & (share > 0)
                expected += np.bincount(ids[real], share[real], self.size)
                if s == 0:
                    share_one[:m] = share
            inside = unknown[1] < last - first
            if inside.any():
                of = np.repeat(share_one[unknown[1][inside]][:, None], 4, 1)
                ids = spelled[inside]
                expected += np.bincount(ids[ids >= 0], of[ids >= 0], self.size)
        return whole

    def forward(self, words: list[str], log_p: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word over all segmentations; with ``weights`` also the expected counts of pieces."""
        scores, expected = np.zeros(len(words)), np.zeros(self.size) if weights is not None else None
        long_ = [i for i, w in enumerate(words) if len(w) > self.window]
        for i in long_:
            scores[i] = self._forward_long(words[i], log_p, expected, weights[i] if weights is not None else 0.0)
        short = [i for i in range(len(words)) if len(words[i]) <= self.window] if long_ else None
        for lattice in lattices(self.vocabulary, words if short is None else [words[i] for i in short], 600_000):
            if short is not None:
                lattice.rows = np.array(short, np.int64)[lattice.rows]
            n, width = lattice.codes.shape
            costs, unknown, spelled = self._costs(lattice, log_p)
            ahead = np.full((n, width + 1), -np.inf)
            ahead[:, 0] = 0.0
            for end in range(1, width + 1):
                terms = np.stack([ahead[:, end - s] + costs[s - 1][:, end - 1] for s in range(1, min(end, len(costs)) + 1)])
                top = terms.max(0)
                safe = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    ahead[:, end] = safe + np.log(np.exp(terms - safe).sum(0))
            whole = ahead[np.arange(n), lattice.sizes]
            scores[lattice.rows] = whole
            if expected is None:
                continue
            weight = weights[lattice.rows]
            back = np.full((n, width + 1), -np.inf)
            back[np.arange(n), lattice.sizes] = 0.0
            for at in range(width - 1, -1, -1):
                sizes = range(1, min(width - at, len(costs)) + 1)
                terms = np.stack([back[:, at + s] + costs[s - 1][:, at + s - 1] for s in sizes])
                top = terms.max(0)
                safe = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    value = safe + np.log(np.exp(terms - safe).sum(0))
                back[:, at] = np.where(at < lattice.sizes, value, back[:, at])
            for s, (ids, cost) in enumerate(zip(lattice.ids, costs, strict=True), 1):
                share = np.exp(ahead[:, : width + 1 - s] + cost[:, s - 1 :] + back[:, s:] - whole[:, None]) * weight[:, None]
                ids = ids[:, s - 1 :]
                real = (ids >= 0) & (share > 0)
                expected += np.bincount(ids[real], share[real], self.size)
                if s == 1 and len(spelled):
                    by_byte = np.repeat(share[unknown][:, None], 4, 1)
                    expected += np.bincount(spelled[spelled >= 0], by_byte[spelled >= 0], self.size)
        return scores, expected


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, first all their lowest bytes, then the next: the upper ones compress to next to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Block(dict):
    """Words of a block by their numbers, in order of appearance, and its documents as numbers."""

    def __init__(self):
        super().__init__()
        self.number = -1
        self.start_again()

    def start_again(self) -> None:
        self.clear()
        self.number, self.bytes, self.docs, self.open, self.trains = self.number + 1, 0, [], [], []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place

    def add(self, raw: bytes, held: bool) -> None:
        parts = [np.fromiter(map(self.__getitem__, tokens), np.uint32, len(tokens)) for _, part in split_long([(0, raw)]) if (tokens := part.translate(LOWER_AZ).split())]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.open.append(ids)
        self.bytes += len(raw)
        if not held:
            self.trains.append(ids)

    def close(self, ids, held: list[bool]) -> None:
        """The documents added since the last call have these ids."""
        if len(held):
            self.docs.append((ids, held, self.open))
            self.open = []

    def counts(self) -> np.ndarray:
        return np.bincount(np.concatenate(self.trains), minlength=len(self)) if self.trains else np.zeros(len(self), np.int64)


def _pieces(model_file: str) -> Pieces:
    if model_file not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        _loaded[model_file] = Pieces([model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])
    return _loaded[model_file]


_loaded: dict[str, Pieces] = {}


def _spell(word: bytes) -> str:
    return SPACE + word.decode("utf-8", "replace")


def _bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def split_long(rows, most: int = 1 << 20):
    """(row, part of its text) with parts cut at white space, so that no part is much longer than ``most`` bytes."""
    for row, raw in rows:
        at = 0
        while len(raw) - at > most:
            cut = max((raw.rfind(c, at, at + most) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")))
            if cut <= at:
                cut = min((p for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (p := raw.find(c, at + most)) >= 0), default=len(raw))
            yield row, raw[at:cut]
            at = cut
        yield row, raw[at:]


def lattice_scores(docs: DataFrame, model_file: str, steps: int = 2, block_bytes: int = 24_000_000, bucket_bytes: int = 16_000_000, most_words: int = 2_000_000, text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row of ``docs``.

    Documents whose crc32(doc_id as text) modulo 7 isn't 2 train; a null id counts as the empty text. Tokens are words, A-Z
    lower-cased, and one end. ``base_score`` sums log10((c + 1) / (N + V + 1)) over tokens and ``score`` is the log10
    probability of the text. A null text is empty: its only token is the end. Rows are never merged; without training
    documents counts are 0 and scores those of the start. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT)
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("trains")).first()
    n_bytes, ends = total["bytes"] or 0, total["trains"] or 0
    buckets = max(1, -(-n_bytes // bucket_bytes))
    id_type = docs.schema["doc_id"]
    written = T.StructType([T.StructField("block", T.LongType()), id_type, T.StructField("held_out", T.BooleanType()), T.StructField("ids", T.BinaryType()), T.StructField("bucket", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("words", "counts", "places")])

    def gather(batches):
        """Of each block: its documents as numbers of words, and its words by bucket with training counts and numbers."""
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        block = _Block()

        def flush():
            if not block.docs:
                return
            ids = pa.concat_arrays([a for a, _, _ in block.docs])
            stored = [_planes(d) for _, _, ds in block.docs for d in ds]
            held = [h for _, hs, _ in block.docs for h in hs]
            n = len(stored)
            nothing = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array([first + block.number] * n, pa.int64()), ids, pa.array(held, pa.bool_()), pa.array(stored, pa.binary()), nothing(pa.int32()), nothing(pa.binary()), nothing(pa.binary()), nothing(pa.binary())], [f.name for f in written.fields])
            counts = block.counts()
            packed: dict[int, list] = defaultdict(list)
            for word, place in block.items():
                packed[_bucket(word, buckets)].append((word, place))
            m = len(packed)
            places = [np.fromiter((p for _, p in v), np.int64, len(v)) for v in packed.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + block.number] * m, pa.int64()), pa.nulls(m, ids.type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.array(list(packed), pa.int32()),
                    pa.array([b"\n".join(w for w, _ in v) for v in packed.values()], pa.binary()), pa.array([counts[p].astype("<i8").tobytes() for p in places], pa.binary()), pa.array([_planes(np.diff(p, prepend=0)) for p in places], pa.binary()),
                ],
                [f.name for f in written.fields],
            )
            block.start_again()

        for batch in slices(batches):
            held, raws = batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            at = 0
            for i, raw in enumerate(raws):
                block.add(raw.as_py() or b"", held[i])
                if block.bytes >= block_bytes or len(block) >= most_words:
                    block.close(batch.column(0).slice(at, i + 1 - at), held[at : i + 1])
                    at = i + 1
                    yield from flush()
            block.close(batch.column(0).slice(at), held[at:])
        yield from flush()

    dealt = stash(rows.select("doc_id", "held_out", "text").mapInArrow(gather, written))
    asked = dealt.where("bucket is not null").select("block", "bucket", "words", "counts", "places")

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: Counter = Counter()
        for words, counts in zip(pdf["words"], pdf["counts"], strict=True):
            for word, n in zip(bytes(words).split(b"\n"), np.frombuffer(counts, "<i8").tolist(), strict=True):
                sums[word] += n
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "words": [b"\n".join(sums)], "counts": [np.fromiter(sums.values(), "<i8", len(sums)).tobytes()], "tokens": [sum(sums.values())], "kinds": [sum(n > 0 for n in sums.values())]})

    lexicon = stash(asked.groupBy("bucket").applyInPandas(add_up, "bucket int, words binary, counts binary, tokens long, kinds long"))
    known = lexicon.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    n_all, v_all = (known["n"] or 0) + ends, (known["v"] or 0) + (ends > 0)
    size = _pieces(model_file).size
    log_p = _pieces(model_file).start()

    def expect(log_p):
        def run(batches):
            import pyarrow as pa

            pieces, sums = _pieces(model_file), None
            for batch in batches:
                for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    weights = np.frombuffer(counts, "<i8").astype(float)
                    spelled = [_spell(w) for w, n in zip(words.split(b"\n"), weights.tolist(), strict=True) if n > 0]
                    got = pieces.forward(spelled, log_p, weights[weights > 0])[1]
                    sums = got if sums is None else sums + got
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], ["piece", "n"])

        return run

    for _ in range(steps if n_all else 0):
        # a row for each piece: as many as the vocabulary has, whatever the corpus; whole units, so reruns agree
        got = lexicon.select("words", "counts").mapInArrow(expect(log_p), "piece long, n double").groupBy("piece").agg(F.sum(F.round(F.col("n") * 1024).cast("long")).alias("n")).collect()
        counts = np.full(size, 0.01)
        for r in got:
            counts[r["piece"]] += r["n"] / 1024.0
        counts[-1] += ends
        log_p = np.log(counts / counts.sum())

    learned = log_p

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        here = pdf[pdf["block"] < 0]
        rest = pdf[pdf["block"] >= 0]
        words = bytes(here["words"].iloc[0]).split(b"\n")
        counts = np.frombuffer(here["counts"].iloc[0], "<i8")
        scores = _pieces(model_file).forward([_spell(w) for w in words], learned)[0] / np.log(10.0)
        at = {w: i for i, w in enumerate(words)}
        out = {"block": [], "places": [], "counts": [], "scores": []}
        for block, asked_words, places in zip(rest["block"], rest["words"], rest["places"], strict=True):
            found = np.fromiter(map(at.__getitem__, bytes(asked_words).split(b"\n")), np.int64)
            out["block"].append(block)
            out["places"].append(places)
            out["counts"].append(counts[found].tobytes())
            out["scores"].append(scores[found].tobytes())
        return pd.DataFrame(out)

    none = lambda kind: F.lit(None).cast(kind)
    both = asked.select("block", "bucket", "words", none("binary").alias("counts"), "places").union(lexicon.select(F.lit(-1).cast("long").alias("block"), "bucket", "words", "counts", none("binary").alias("places")))
    answers = stash(both.groupBy("bucket").applyInPandas(answer, "block long, places binary, counts binary, scores binary"))
    end_base, end_score = float(np.log10((ends + 1) / (n_all + v_all + 1))), float(log_p[-1] / np.log(10.0))
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )

    def score(batches):
        """Rows of a block: first its words with counts and scores, then its documents."""
        import pyarrow as pa

        at, tables, base_of, counts_of, scores_of = None, [], None, None, None
        for batch in batches:
            of, ids, held, docs_, places, counts, scores = (batch.column(i) for i in range(7))
            got = []
            for i, block in enumerate(of.to_pylist()):
                if block != at:
                    at, tables, base_of = block, [], None
                if places[i].is_valid:
                    tables.append((np.cumsum(_numbers(places[i].as_py()), dtype=np.int64), np.frombuffer(counts[i].as_py(), "<i8"), np.frombuffer(scores[i].as_py(), float)))
                    continue
                if base_of is None:
                    size_here = sum(len(t[0]) for t in tables)
                    counts_of, scores_of = np.zeros(size_here, np.int64), np.zeros(size_here)
                    for p, n, v in tables:
                        counts_of[p], scores_of[p] = n, v
                    base_of = np.log10((counts_of + 1) / (n_all + v_all + 1))
                found = _numbers(docs_[i].as_py())
                got.append((i, len(found) + 1, int(np.count_nonzero(counts_of[found])) + (ends > 0), float(base_of[found].sum()) + end_base, float(scores_of[found].sum()) + end_score))
            if got:
                rows_ = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows_), held.take(rows_), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([n_all] * len(got), pa.int64()), pa.array([g[3] for g in got], pa.float64()), pa.array([g[4] for g in got], pa.float64())],
                    [f.name for f in schema.fields],
                )

    of_words = answers.select("block", none(id_type.dataType).alias("doc_id"), none("boolean").alias("held_out"), none("binary").alias("ids"), "places", "counts", "scores", F.lit(0).alias("_o"))
    of_docs = dealt.where("ids is not null").select("block", "doc_id", "held_out", "ids", none("binary").alias("places"), none("binary").alias("counts"), none("binary").alias("scores"), F.lit(1).alias("_o"))
    ordered = of_words.union(of_docs).repartition(max(1, -(-n_bytes // block_bytes)), "block").sortWithinPartitions("block", "_o")
    return ordered.drop("_o").mapInArrow(score, schema)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_lm_score": op1_lm_score}
ORACLES: dict[str, str] = {}
