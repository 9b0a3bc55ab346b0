"""Personal data by candidates and gradient-boosted trees.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; what they find always stays. On top of that,
generators with a high recall propose overlapping spans: numbers with any separators, from any group of digits of a run
to any other, and addresses spelled with "at" and "dot". Trees score each proposal by the form of the span and by its
context, and the spans above a threshold are added.

There are no labelled spans, so the trees learn from what the checks of the base patterns say. A proposal that agrees
with a base span of its kind is a positive, one whose form a check refutes or whose characters a base span of another
kind holds a negative, and others, without a label, are what the trees are for. Features leave out what the labels are made of where a new span wouldn't have it (the leading
plus of a phone number, the at sign). All different labelled proposals of all documents take part: features become bins
whose borders come from counts over all of them, proposals with the same bins and label a row with their number, and each
level of a tree is one pass of Spark over these rows, of which the driver sees sums by node, feature and bin. One proposal
in four is left out, and there each kind's threshold is the lowest score from which on at least ``precision`` of the
labelled proposals are positive. Sums are of whole numbers, so the model doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stash, table, texts

#: Kinds, in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[\[({<] ?at ?[\])}>]|\bdot\b", re.I)
_NUMBERS = re.compile(r"(?<![\w+])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])+")
_AT = re.compile(r"@|[\[({<] ?at ?[\])}>]|(?<= )at(?= [a-z0-9-]{1,63} ?[\[({<]? ?dot\b)", re.I)
_NAME = re.compile(r"(?<![\w.])\w(?:[\w.+-]{0,62}\w)? ?$")
# A mark between names is parted from them by its own characters, and names are taken whole, so there is one way to read a
# place and the time grows with its length.
_PLACE = re.compile(r" ?[\w-]{1,63}+(?:(?: dot | ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| ?\. ?)[\w-]{2,63}+)++(?!\w)", re.I)
_WORDS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax")}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, not overlapping within a kind, failing ones dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of proposals; one span may be proposed as several kinds.

    In a run of numbers every stretch of whole groups of digits is proposed as each kind that its digits allow; none has
    more than 19 of them, so a run gives a bounded number of proposals a group.
    """
    out = []
    for m in _NUMBERS.finditer(text):
        run = m[0]  # each access would copy the run
        groups = [g.span() for g in re.finditer("[0-9]+", run)]
        for i, (first, _) in enumerate(groups):
            start, digits, dots = m.start() + first, 0, 0
            opened = start - (first > 0 and run[first - 1] in "+(")  # what stands before the number is part of a phone number
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                end = m.start() + groups[j][1]
                if j > i:
                    dots += run.count(".", groups[j - 1][1], groups[j][0]) == 1
                if j == i + 3 and dots == 3 and digits <= 12:
                    out.append((start, 1, end))
                if digits >= 13:
                    out.append((start, 2, end))
                if 9 <= digits <= 15:
                    out.append((opened, 3, end))
    for m in _AT.finditer(text):
        name, place = _NAME.search(text[max(0, m.start() - 65) : m.start()]), _PLACE.match(text, m.end())
        if name and place:
            out.append((max(0, m.start() - 65) + name.start(), 0, place.end()))
    return out


FEATURES = 16


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    parts = [int(g[:9]) for g in groups[:8]] or [0]
    return [
        kind, len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        max(parts), float(luhn(digits)) if digits else 0.0,
        len({c for c in span if not c.isalnum()} - {"+", "@"}), span.count("."), span.count("-") + span.count(" "),
        span.count("(") == span.count(")"),
        float(any(w in before for w in _WORDS[KINDS[kind]])),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or after[:1] in ",.;" or not after),
        float(bool(re.search(r"(?:^|\W)(?:no|nr|id|order|version|v|isbn|token)\W*$", before))),
    ]


def label(text: str, start: int, kind: int, end: int, base: set) -> int | None:
    """1: a base span of the kind; 0: a form that a check of the kind refutes; None: neither."""
    if (start, kind, end) in base:
        return 1
    span = text[start:end]
    digits = _digits(span)
    if kind == 1:
        return 0 if max(int(g) for g in re.findall("[0-9]+", span)) > 255 else None
    if kind == 2:
        return 0 if not luhn(digits) or len(digits) < 14 else None
    if kind == 3:
        return 0 if len(digits) > 13 or len(re.findall(r"[0-9]+", span)) == 1 or span.count(".") == 3 else None
    return None if re.search(r"@|\bdot\b", span, re.I) else 0


def _farthest(spans: list[tuple[int, int, int]]):
    """The farthest end among the sorted ``spans`` that start before a place (-1: none does)."""
    starts, ends = [s[0] for s in spans], [-1, *accumulate((s[2] for s in spans), max)]
    return lambda place: ends[bisect_left(starts, place)]


def labels(text: str, base: list[tuple[int, int, int]]):
    """Proposals and their labels; 0 also where a base span of another kind, which passed its check, holds characters of one."""
    known = set(base)
    others = [_farthest([b for b in base if b[1] != k]) for k in range(len(KINDS))]
    for c in candidates(text):
        y = label(text, *c, known)
        yield c, 0 if y is None and others[c[1]](c[2]) > c[0] else y


ONE = 1 << 30  # gradients and weights are whole multiples of 1 / ONE, so that sums don't depend on their order
STEPS = 1 << 20  # leaves are whole multiples of 1 / STEPS, so that scores are exact


def _leaf_of(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node of ``tree``, which may be growing, that each row of ``bins`` comes to."""
    node = np.ones(len(bins), np.int64)
    for at in sorted(k for k, v in tree.items() if isinstance(v, tuple)):
        j, cut = tree[at]
        here = node == at
        node[here] = 2 * at + (bins[here, j] > cut)
    return node


class Trees:
    """Boosted regression trees for the logistic loss, on binned features; small on purpose."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: float = 20.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.prior, self.trees, self.edges = 0.0, [], []

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def start(self, edges: list[np.ndarray], share: float) -> None:
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.edges, self.trees = edges, []
        self.prior = round(float(np.log(share / (1 - share))) * STEPS) / STEPS

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.start([np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) if len(x) else np.zeros(0) for j in range(FEATURES)], y.mean() if len(y) else 0.0)
        if len(np.unique(y)) < 2:
            return self
        bins, ones = self._bins(x), np.ones(len(y), np.int64)
        return self.boost(lambda tree, nodes: self.sums(tree, nodes, bins, y, ones))

    def sums(self, tree: dict, nodes: list[int], bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Gradients, weights and numbers of the rows, each standing for ``n``, by node of ``nodes``, feature and bin."""
        out = np.zeros((3, len(nodes), FEATURES, 32), np.int64)
        p = 1 / (1 + np.exp(-self.scores_of_bins(bins)))
        parts = [np.rint((y - p) * ONE).astype(np.int64) * n, np.rint(p * (1 - p) * ONE).astype(np.int64) * n, n]
        at = _leaf_of(tree, bins)
        for k, node in enumerate(nodes):
            rows = np.flatnonzero(at == node)
            for j in range(FEATURES):
                for part, values in enumerate(parts):
                    np.add.at(out[part, k, j], bins[rows, j], values[rows])
        return out

    def boost(self, sums) -> Trees:
        """Grow the trees level by level; ``sums`` gives for a growing tree and its open nodes what the method of this name gives for all rows."""
        for _ in range(self.rounds):
            tree: dict = {}
            nodes = [1]
            for level in range(self.depth):
                g, h, n = sums(tree, nodes)
                deeper = []
                for k, node in enumerate(nodes):
                    found = self._split(g[k], h[k], n[k])
                    if found is None:
                        tree[node] = self._value_of(g[k, 0].sum(), h[k, 0].sum())
                        continue
                    j, cut = tree[node] = found
                    for child, side in ((2 * node, slice(0, cut + 1)), (2 * node + 1, slice(cut + 1, None))):
                        if level + 1 < self.depth:
                            deeper.append(child)
                        else:
                            tree[child] = self._value_of(g[k, j, side].sum(), h[k, j, side].sum())
                nodes = deeper
                if not nodes:
                    break
            if len(tree) < 2:
                break  # nothing splits, so no later tree would
            self.trees.append(tree)
        return self

    def _value_of(self, g: int, h: int) -> float:
        return round(self.rate * int(g) / (int(h) + ONE) * STEPS) / STEPS

    def _split(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, int] | None:
        """Feature and bin of the best cut; None if none gains."""
        best, found = 1e-6, None
        g, h = g / ONE, h / ONE
        for j in range(FEATURES):
            gs, hs, ns = np.cumsum(g[j]), np.cumsum(h[j]), np.cumsum(n[j])
            ok = (ns >= self.least) & (ns[-1] - ns >= self.least)
            if ok.any():
                gain = np.where(ok, gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1), -np.inf)
                if gain.max() > best:
                    best, found = gain.max(), (j, int(gain.argmax()))
        return found

    def _value(self, tree, bins) -> np.ndarray:
        out, todo = np.zeros(len(bins)), [(1, np.arange(len(bins)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(tree[node], tuple):
                j, cut = tree[node]
                left = bins[rows, j] <= cut
                todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
            else:
                out[rows] = tree[node]
        return out

    def scores_of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.prior + sum((self._value(t, bins) for t in self.trees), np.zeros(len(bins)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.scores_of_bins(self._bins(x))


def thresholds(trees: Trees, x: np.ndarray, y: np.ndarray, precision: float, least: int = 50) -> list[float]:
    """For each kind the lowest score from which on ``precision`` of the held-out labels are positive; infinite without ``least`` positives there, or without a tree that splits."""
    if all(len(tree) < 2 for tree in trees.trees):
        return [float("inf")] * len(KINDS)
    out = []
    for kind in range(len(KINDS)):
        of = x[:, 0] == kind
        order = np.argsort(-trees.scores(x[of]), kind="stable")
        s, hit = trees.scores(x[of])[order], y[of][order]
        share = np.cumsum(hit) / np.arange(1, len(hit) + 1)
        last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)  # equal scores stay together
        good = np.flatnonzero((share >= precision) & last & (np.cumsum(hit) >= least))
        out.append(float(s[good[-1]]) if len(good) else float("inf"))
    return out


def lowest_keys(found: DataFrame, most: int) -> DataFrame:
    """The rows of ``found`` (key from 0 to 2 ** 63) up to a key below which at least ``most`` distinct keys lie, and not many more.

    Slices of the range are counted and the one that holds the border is cut again, 1,024 counts at a time. Counts are
    approximate, so twice as many keys are asked for; equal keys, however many, count once.
    """
    low, width, taken = 0, 1 << 53, 0
    while True:
        inside = found.where((F.col("key") >= low) & (F.col("key") <= min(low + 1024 * width, 1 << 63) - 1))
        counts = inside.groupBy(F.expr(f"(key - {low}) div {width}").alias("s")).agg(F.approx_count_distinct("key").alias("n"))
        border = None
        for s, n in sorted((r["s"], r["n"]) for r in counts.collect()):
            if taken + n >= 2 * most:
                border = s, n
                break
            taken += n
        if border is None:
            return found
        if width == 1 or border[1] <= most:
            return found.where(F.col("key") <= min(low + (border[0] + 1) * width, 1 << 63) - 1)
        low, width = low + border[0] * width, max(1, width >> 10)


def _edges(found: DataFrame) -> list[np.ndarray]:
    """Borders of at most 32 bins of each feature, quantiles of all rows of ``found`` (x: whole numbers); kinds have their own bins.

    Values of more than six bits count with the largest one that has the same first six, so the counts are few.
    """
    values = found.select(F.posexplode("x").alias("j", "v")).withColumn("low", F.greatest(F.length(F.bin("v")) - 6, F.lit(0)))
    counts = values.groupBy("j", F.expr("shiftleft(shiftright(v, low) + 1L, low) - 1").alias("v")).agg(F.count("*").alias("n"))
    held: list[list] = [[] for _ in range(FEATURES)]
    for r in counts.collect():
        held[r["j"]].append((r["v"], r["n"]))
    out = [np.arange(len(KINDS) - 1, dtype=float)]
    for of in held[1:]:
        of = np.array(sorted(of), np.int64).reshape(-1, 2)
        ends = np.cumsum(of[:, 1])
        out.append(np.unique(of[np.searchsorted(32 * ends, np.arange(1, 32) * ends[-1], "left"), 0]).astype(float) if len(of) else np.zeros(0))
    return out


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bins``, ``y`` and ``n`` of a batch."""
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, FEATURES)
    return bins, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _fit_all(found: DataFrame, precision: float, least: int = 50) -> tuple[Trees, list[float]]:
    """Trees and thresholds from all rows of ``found`` (key, y, x), of which equal keys with one label count once."""
    trees, never = Trees(), [float("inf")] * len(KINDS)
    distinct = stash(found.groupBy("key", "y").agg(F.first("x").alias("x")))
    held = F.col("key") % 4 == 0
    counts = {(r["held"], r["y"], r["kind"]): r["n"] for r in distinct.groupBy(held.alias("held"), "y", F.col("x")[0].alias("kind")).agg(F.count("*").alias("n")).collect()}
    learnt = [sum(n for (h, y, _), n in counts.items() if not h and y == of) for of in (0, 1)]
    if not all(learnt) or all(counts.get((True, 1, k), 0) < least for k in range(len(KINDS))):
        return trees, never
    trees.start(_edges(distinct), learnt[1] / sum(learnt))

    def binned(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(0).values.to_numpy(zero_copy_only=False).reshape(-1, FEATURES) if batch.num_rows else np.zeros((0, FEATURES))
            bins = [b.tobytes() for b in trees._bins(x).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.binary()), *batch.columns[1:]], ["bins", "y", "held"])

    rows = distinct.select("x", "y", held.alias("held")).mapInArrow(binned, "bins binary, y int, held boolean")
    rows = stash(rows.groupBy("bins", "y", "held").agg(F.count("*").alias("n")))
    learn = rows.where("not held").select("bins", "y", "n")

    def sums(tree: dict, nodes: list[int]) -> np.ndarray:
        def run(batches):
            import pyarrow as pa

            total = np.zeros((3, len(nodes), FEATURES, 32), np.int64)
            for batch in batches:
                total += trees.sums(tree, nodes, *_arrays(batch))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        # each task returns at most 48 KB
        return sum(np.frombuffer(r["sums"], np.int64).reshape(3, len(nodes), FEATURES, 32) for r in learn.mapInArrow(run, "sums binary").collect())

    trees.boost(sums)
    if not trees.trees:
        return trees, never

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            bins, y, n = _arrays(batch)
            score = np.rint(trees.scores_of_bins(bins) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins[:, 0].astype(np.int64)), pa.array(score), pa.array(n), pa.array(n * y)], ["kind", "score", "n", "hit"])

    out = list(never)
    total = lambda c: F.sum(c).alias(c)
    scores = rows.where("held").select("bins", "y", "n").mapInArrow(scored, "kind long, score long, n long, hit long").groupBy("kind", "score").agg(total("n"), total("hit"))
    # running sums in slices of the scores, after the sums of all slices above
    scores = stash(scores.withColumn("slice", F.expr("shiftright(score, 14)")))
    above = Window.partitionBy("kind").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    before = scores.groupBy("kind", "slice").agg(total("n"), total("hit")).select("kind", "slice", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "hit")))
    inside = Window.partitionBy("kind", "slice").orderBy(F.desc("score"))
    running = scores.join(before, ["kind", "slice"]).select("kind", "score", *((F.col(f"{c}_above") + F.sum(c).over(inside)).alias(c) for c in ("n", "hit")))
    for r in running.where((F.col("hit") / F.col("n") >= precision) & (F.col("hit") >= least)).groupBy("kind").agg(F.min("score").alias("score")).collect():
        out[r["kind"]] = r["score"] / STEPS
    return trees, out


def fit(docs: DataFrame, most_labelled: int | None = None, precision: float = 0.995, text: str = "text") -> tuple[Trees, list[float]]:
    """Trees and thresholds from all labelled proposals of all documents; with ``most_labelled``, from at most so many, those of lowest hash.

    A span with its kind and the 40 characters on both sides is one proposal wherever and however often it stands, so copies
    of a text are neither evidence of their own nor crowd out others. The driver gets sums by node, feature and bin, or
    ``most_labelled`` rows of numbers, so memory is bounded everywhere. A kind with fewer than 50 held-out positives
    can't be calibrated, and without labels of both classes to learn from no kind can: the threshold is then infinite and
    the method adds nothing, as on a small table. A null text is empty; in an empty table there is nothing to fit and only
    base spans are found; other columns are ignored. Texts count whole; of equal hashes and labels one row stays.
    """

    def run(batches):
        import pyarrow as pa

        kept: dict = {}
        seen: set = set()  # only spares rows that a shuffle would drop

        def out():
            keys = sorted(kept)[:most_labelled]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([list(map(int, kept[k])) for k in keys], pa.list_(pa.int32()))], ["key", "y", "x"])

        for _, raws in texts(batches):
            for raw in raws:
                s = raw.decode("utf-8", "replace")
                if not _HINT.search(s):
                    continue
                for (start, kind, end), y in labels(s, base_spans(s)):
                    if y is not None:
                        first = max(0, start - 40)
                        context = f"{kind} {start - first} {end - start} {s[first : end + 40]}"
                        key = int.from_bytes(hashlib.blake2b(context.encode(), digest_size=8).digest(), "little") >> 1
                        if (key, y) not in kept and (key, y) not in seen:
                            kept[key, y] = features(s, start, kind, end)
                if most_labelled is None and len(kept) >= 1000:
                    yield out()
                    seen = (seen if len(seen) < 100_000 else set()) | set(kept)
                    kept.clear()
            if most_labelled is not None and len(kept) > 2 * most_labelled:
                kept = {k: kept[k] for k in sorted(kept)[:most_labelled]}
        yield out()

    found = stash(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, y int, x array<int>"))
    if most_labelled is None:
        return _fit_all(found, precision)
    distinct = lowest_keys(found, most_labelled).groupBy("key", "y").agg(F.first("x").alias("x"))
    rows = distinct.orderBy("key", "y").limit(most_labelled).collect()
    x, y = np.array([r["x"] for r in rows], float).reshape(-1, FEATURES), np.array([r["y"] for r in rows], float)
    held = np.array([r["key"] % 4 == 0 for r in rows], bool)
    trees = Trees().fit(x[~held], y[~held])
    return trees, thresholds(trees, x[held], y[held], precision)


def all_spans(text: str, trees: Trees, limits: list[float]) -> tuple[list, list]:
    """Base spans, and base spans with those added."""
    if not _HINT.search(text):
        return [], []
    base = base_spans(text)
    known = set(base)
    proposed = [c for c in candidates(text) if c not in known and limits[c[1]] < float("inf")]
    # a proposal inside a base span adds nothing
    reach = _farthest(base)
    proposed = [c for c in proposed if reach(c[0] + 1) < c[2]]
    if not proposed:
        return base, base
    s = trees.scores(np.array([features(text, *c) for c in proposed], float))
    return base, sorted(known | {c for c, v in zip(proposed, s, strict=True) if v >= limits[c[1]]})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch that spans cover becomes one ``[KIND]`` of its first span."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: tuple[Trees, list[float]], carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` of each row and, prefixed with ``_pii_``: counts of base spans by kind (``n_email`` and so on),
    ``base_sha256``, all ``spans`` and the ``redacted`` text.

    A null text is empty and has no spans; its redacted text is null. Rows are never merged: repeated rows and null ids
    come back as they are. Spans with one score stand or fall together. An empty table gives an empty result; columns of
    ``docs`` beside ``carry`` are ignored, and names clash only with those that begin with ``_pii_``. One pass without a
    shuffle; time grows with the text's length, not with its square.
    """
    trees, limits = model
    fields = [T.StructField(f"_pii_n_{k}", T.LongType()) for k in KINDS] + [T.StructField(f"_pii_{n}", T.StringType()) for n in ("base_sha256", "spans", "redacted")]
    schema = T.StructType([docs.schema[c] for c in carry] + fields)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            counts, hashes, spans, redacted = [[] for _ in KINDS], [], [], []
            for s in batch.column(len(carry)).to_pylist():
                base, found = all_spans(s or "", trees, limits)
                for k in range(len(KINDS)):
                    counts[k].append(sum(b[1] == k for b in base))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
                redacted.append(s if not found else redact(s, found))
            columns = [*batch.columns[: len(carry)], *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (hashes, spans, redacted))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return docs.select(*carry, F.col(text).cast("string").alias("_pii_text")).mapInArrow(run, schema)


def redacted_documents(docs: DataFrame, text: str = "text", chars: str = "n_chars", **settings) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``chars``, if there is such a column, counted again where it was.

    Null texts stay null, repeated rows are redacted alike, an empty table gives an empty result, and any other columns come
    back as they are.
    """
    rest = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(F.lit(True).alias("_"), *(F.col(c) for c in rest)).alias("_row"), F.col(text).alias("text"))  # names can't clash inside
    found = stash(find_pii(packed, fit(packed, **settings), ["_row"]))
    own = {c: F.col("_row").getField(c) for c in rest} | {text: F.col("_pii_redacted")}
    if chars in rest:
        own[chars] = F.when(F.col("_pii_spans") == "", own[chars]).otherwise(F.length("_pii_redacted").cast(docs.schema[chars].dataType))
    return found.select(*(own[c].alias(c) for c in docs.columns))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", *(F.col(f"_pii_{c}").alias(c) for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")))


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
