"""Merkle manifest, n-gram join and token alignment on small tables against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import merkle, near_dedup, ngram_join, token_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, _g string, grp string, n string, row string, a string"
ODD = ["", " ", "a", " a", "a  b\n\n c", "é<s></s>x", "▁a▁▁b", "日本語 テキスト", "🙂 a\t\tx", "\r\n a\r\n", "\n", "x" * 3000, "the " * 500, "a\n b", "<|endoftext|> a <unk> <0x0A>", "　a　 b", "\0 a\0b", "Å fi ﬁ", None]


def table(spark, rows):
    """Rows of doc_id, text, lang, source and n_chars beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "leaf", "root", "g", "grp", "n", "row", "a") for r in rows], SCHEMA)


# Merkle manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows, fanout):
    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def steps(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                run = nodes[place - place % fanout : place - place % fanout + fanout]
                paths[k].append(("".join(run[: place % fanout]), "".join(run[place % fanout + 1 :])))
                at[k] = place // fanout
            nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        return nodes[0], paths

    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        later = n if n is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 else n + 1
        groups[lang].append((doc_id, leaf((doc_id, source, lang, n, text)), leaf((doc_id, source, lang, later, text))))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = []
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(steps([r[1] for r in groups[lang]]))
    root, above = steps([t[0] for t in trees]) if trees else (None, [])
    out = []
    for lang, (sub, paths), rest in zip(order, trees, above, strict=True):
        for (doc_id, own, later), path in zip(groups[lang], paths, strict=True):
            node = later
            for left, right in path + rest:
                node = sha(left + node + right)
            out.append((doc_id, own, sub, root, sha("".join(a + b for a, b in path + rest)), node, node == root))
    return sorted(map(str, out))


@pytest.mark.parametrize(("fanout", "block"), [(2, 4), (2, 4096), (3, 9), (5, 5)])
def test_manifest(spark, fanout, block, monkeypatch):
    rows = [(i % 37 if i % 11 else None, t, [None, "de", "en", "Ä", "x" * (i // 40)][min(4, i % 7)], [None, "a"][i % 2], [None, 5, -1][i % 3]) for i, t in enumerate(ODD * 4)]
    rows += [rows[3], rows[3], (1, "lone", "zz", None, 7)]
    inner = merkle.proofs
    monkeypatch.setattr(merkle, "proofs", lambda *a: inner(*a, fanout=fanout, block=block))
    tampered = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    for some in (rows, rows[:1], []):
        got = merkle.manifest(table(spark, some).repartition(3), ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": tampered})
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(str(tuple(r)) for r in got.collect()) == plain_manifest(some, fanout)


def test_proofs_keep_columns_and_fold_to_the_root(spark):
    rows = table(spark, [(i, "t", "en", "s", i) for i in range(50)]).withColumn("leaf", merkle.leaf_digest(["doc_id", "text"]))
    got = merkle.proofs(rows, "lang", "doc_id", block=8)
    assert got.columns == [c for c in rows.columns if c != "root"] + ["subroot", "root", "proof"]
    assert got.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 50
    assert got.where(merkle.folded(merkle.leaf_digest(["text"]), F.col("proof")) == F.col("root")).count() == 0


# N-gram join


def plain_components(rows, shingle, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().translate(near_dedup.LOWER_AZ).split()
        k = min(shingle, len(words))
        sets.append(frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset())
    label = {k: k for k, (i, _) in enumerate(rows) if i is not None}
    of = lambda k: k if label[k] == k else of(label[k])
    for x in label:
        for y in label:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                label[of(y)] = of(x)
    least = defaultdict(list)
    for k in label:
        least[of(k)].append(rows[k][0])
    return sorted(str((i, len(sets[k]), min(least[of(k)]) if i is not None else None)) for k, (i, _) in enumerate(rows))


def near_copies(seed):
    """Chains and stars of near copies, exact copies, passages in many texts, and texts at the limit."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = list(ODD)
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 10, 29, 60, 120]))] + passage * rng.randrange(2)
        for _ in range(rng.choice([1, 3, 14])):
            if rng.random() < 0.6:
                base = list(base)
            changed = list(base)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(len(changed))] = word()
            base = changed if rng.random() < 0.5 else base
            texts.append(" ".join(changed).upper() if rng.random() < 0.2 else "\n ".join(changed))
    texts += [" ".join(f"u{i}" for i in range(k, k + 21)) for k in (0, 1, 2, 5)] + texts[-3:]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    return [*rows, rows[-1], (rows[-1][0], "another text of this id entirely"), (None, texts[-1]), (None, None)]


@pytest.mark.parametrize(("seed", "crowd", "block", "percent"), [(1, 64, 512, 90), (2, 1, 3, 90), (3, 2, 2, 80), (4, 3, 512, 100)])
def test_ngram_join(spark, seed, crowd, block, percent):
    rows = near_copies(seed)
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in rows]).repartition(5)
    got = ngram_join.linked_documents(docs, 3, percent, crowd, block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_components(rows, 3, percent)


def test_ngram_join_of_nothing(spark):
    empty = table(spark, [])
    assert ngram_join.linked_documents(empty).count() == 0
    got = ngram_join.linked_documents(table(spark, [(3, None, None, None, None), (None, "a b c d", None, None, None)]))
    assert sorted(map(str, map(tuple, got.collect()))) == ["(3, 0, 3)", "(None, 2, None)"]


def test_links_in_crowded_groups_need_few_rows(spark):
    """A group of near copies that all link comes out as a forest, not as its pairs, and pairs of blocks add nothing."""
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]]), "en", "s", 1) for i in range(60)]
    docs = table(spark, rows).select("doc_id", "text")
    here = docs.select(F.lit(1).cast("long").alias("grp"), "doc_id", F.xxhash64("text").alias("text_hash"), F.lit(198).alias("n"), F.col("doc_id").alias("lab"))
    none = near_dedup._ordered(here.select(F.struct("doc_id", "text_hash").alias("x"), F.struct("doc_id", "text_hash").alias("y")))
    found = ngram_join.links_in_groups(here, docs, 3, 90, none, block=16)
    assert near_dedup.components(found).select("label").distinct().count() == 1 and found.count() < 2 * 60 + 8 * 8


def test_prefixes_are_sent_only_to_pairs_whose_sizes_allow_a_link(spark, monkeypatch):
    rng, asked = random.Random(3), []
    shared = " ".join(f"s{i}" for i in range(12))
    docs = table(spark, [(i, shared + "".join(f" w{rng.randrange(10**9)}" for _ in range(5 + 9 * i)), None, None, None) for i in range(24)])
    allow = ngram_join.prefixes_allow

    def seen(pairs, groups, percent):
        sizes = {r["gid"]: r["n"] for r in groups.collect()}
        asked.extend(100 * min(sizes[r["g"]], sizes[r["h"]]) >= percent * max(sizes[r["g"]], sizes[r["h"]]) for r in pairs.collect())
        return allow(pairs, groups, percent)

    monkeypatch.setattr(ngram_join, "prefixes_allow", seen)
    monkeypatch.setattr(ngram_join, "prefix_size", lambda n, percent: n)
    assert ngram_join.linked_documents(docs).where("doc_id = component_id").count() == 24
    assert asked and all(asked)


def test_only_texts_of_pairs_are_gathered(spark, monkeypatch):
    """Of texts that no pair asks for none is shuffled, unless marks fall together, which changes no result."""
    rows, asked = near_copies(5), []
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in rows]).repartition(5)
    confirm = near_dedup.confirmed

    def seen(pairs, docs, shingle, percent, held):
        asked.append(({r["x"] for r in pairs.select(F.explode(F.array("a", "b")).alias("x")).collect()}, [r["id"] for r in held.collect()]))
        return confirm(pairs, docs, shingle, percent, held=held)

    monkeypatch.setattr(ngram_join, "confirmed", seen)
    for marks in (ngram_join.marked, lambda ids: np.full(ngram_join.MARKS // 8, 255, np.uint8)):
        monkeypatch.setattr(ngram_join, "marked", marks)
        assert sorted(str(tuple(r)) for r in ngram_join.linked_documents(docs, 3, 90).collect()) == plain_components(rows, 3, 90)
    assert len(asked) == 4 and all(len(held) == len(set(held)) for _, held in asked)
    assert asked[0][0] and all(set(held) == ids for ids, held in asked[:2])
    assert all(ids < set(held) for ids, held in asked[2:])


def test_counts_come_in_small_batches(spark, monkeypatch):
    """Texts are counted in Arrow batches of few rows, as they are where tables are written, and the setting stays."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    docs, before = table(spark, [(i, f"a b c w{i}", "en", "s", 1) for i in range(9)]), spark.conf.get(name)
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: seen.append(int(spark.conf.get(name))) or collect(df))
    classes = ngram_join.count_classes(docs, 3)
    assert seen and max(seen) <= 1000 and spark.conf.get(name) == before
    assert classes.max() == int(4 * np.log2(10))


def test_sets_are_made_by_one_worker_of_a_task(spark, monkeypatch):
    """Each Python function of a task has a worker of its own, so marks and sets share one."""
    rows, plans = near_copies(6), []
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in rows]).repartition(5)
    inner = ngram_join.links_in_blocks

    def seen(open_, *rest):
        plans.append(open_._jdf.queryExecution().executedPlan().toString())
        return inner(open_, *rest)

    monkeypatch.setattr(ngram_join, "links_in_blocks", seen)
    assert sorted(str(tuple(r)) for r in ngram_join.linked_documents(docs, 3, 90, 1, 3).collect()) == plain_components(rows, 3, 90)
    assert plans and all(p.count("MapInArrow") == 1 for p in plans)


def test_prefix_size():
    for percent in (80, 90, 100):
        for n in range(1, 300):
            least = -(-percent * n // 100)
            assert ngram_join.prefix_size(n, percent) == n - least + 1


# Token alignment


def plain_alignment(texts):
    """Per text: ids, groups and links, from ranges of bytes; all pairs of tokens are looked at."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    alphabet, out = token_groups.byte_alphabet(), []
    for text in texts:
        whole = b" " + (text or "").encode()
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        named = [bytes(alphabet[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(n) != whole for n in named):
            out.append((0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in n]).tolist() for n in named]
        shared, groups, links, start = sorted(set(ends[0]) & set(ends[1])), [], [], 0
        for stop in shared:
            groups.append("|".join(",".join(str(i) for i, e in zip(side, at, strict=True) if start < e <= stop) for side, at in zip(ids, ends, strict=True)))
            start = stop
        for i, x in enumerate(ends[0]):
            for j, y in enumerate(ends[1]):
                if max(x - len(named[0][i]), y - len(named[1][j])) < min(x, y):
                    links.append((ids[0][i], ids[1][j]))
        out.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    held = Counter(pair for *_, links, _ in out for pair in set(links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(*o[:3], len(o[3]), sum(held[p] == best[p[0]] for p in o[3]), sum(held[p] for p in o[3]), o[4]) for o in out]


@pytest.mark.parametrize("most", [400_000, 60, 0])
def test_token_groups(spark, most):
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    texts = [t[:400] if t else t for t in ODD] + ["Straße übergroße naïve", "I don't know, 12345 x's", "don't know the the", "  two  blanks ", "مرحبا بالعالم", "a᠎ b  c\x1c d\xa0 e"] + ["the cat sat"] * 3
    rows = [(None if k == 5 else k % 20, t, "en", "s", 1) for k, t in enumerate(texts)]
    got = token_groups.token_groups(table(spark, rows).repartition(3), *files, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((r[0], *p)) for r, p in zip(rows, plain_alignment(texts), strict=True))
    assert token_groups.token_groups(table(spark, []), *files).count() == 0


def test_query_returns_what_a_plain_version_does(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy(F.length("text"), "doc_id").select("doc_id", "text").collect()
    short = [r for r in docs if len(r["text"]) < 700]
    got = token_groups.token_groups(spark.createDataFrame(short), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert len(short) > 20
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((r["doc_id"], *p)) for r, p in zip(short, plain_alignment([r["text"] for r in short]), strict=True))


def test_memory_of_parts_is_bounded():
    aligner = token_groups.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), most=3)
    texts = ["one two three four", "five six seven", "one two nine", "x" * 100 + " one"]
    first = [aligner.aligned([t])[1][0] for t in texts]
    assert aligner.aligned(texts)[1] == first and len(aligner.known) < 12


def test_jumps_reach_the_end_of_chains():
    chain = np.append(np.arange(1, 1000), 999)
    assert (token_groups.jumped(chain) == 999).all()
