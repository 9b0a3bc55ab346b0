"""Small tables with nulls, empty texts, ties, repeated rows and clashing columns, against plain versions."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat_format, lm_score, mixing, near_dedup, packing, pii, quality, token_counts, topk, url_filter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "a", " a", "a  b\n\n c", "é<s></s>x", "▁a▁▁b", "日本語 テキスト", "🙂 a\t\tx", "\r\n a\r\n", "\n", "x" * 3000, "the " * 500, "a\n b", "<|endoftext|> a", "　a　 b", None]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, size string, label string, x string"


def docs(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, ["en", None][i % 2], [None, "a", "b"][i % 3], 5, "n", "k", "s", "l", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [*ODD, *ODD[:5]], [*range(len(ODD) - 1), None, *range(5)]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, ["a"]).limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


# Prefix counts


def test_prefix_counts_equal_the_tokenizer(spark, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.prefix_token_counts(odd.select("*"), MODEL, 10)
    assert got.count() == odd.count()
    for r in got.join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        s = r["text"] or ""
        counts = np.frombuffer(r["prefix_counts"], "<u4")
        assert r["n_tokens"] == len(sp.encode(s)) == counts[-1] and r["over_limit"] == (r["n_tokens"] > 10) and r["n_bytes"] == len(s.encode())
        for i in range(0, min(len(s), 60) + 1):
            assert counts[i] == len(sp.encode(s[:i]))
    plain = token_counts.prefix_token_counts(odd, MODEL, 10, keep=False)
    assert sorted(map(str, rows(plain))) == sorted(str({k: v for k, v in r.items() if k != "prefix_counts"}) for r in rows(got))
    assert token_counts.prefix_token_counts(empty, MODEL).count() == 0


def test_query_stores_the_count_at_every_prefix(spark, odd, tmp_path, monkeypatch):
    import sentencepiece

    sp, kept = sentencepiece.SentencePieceProcessor(model_file=MODEL), []
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(token_counts, "stash", lambda df: kept.append(df.cache()) or kept[0])
    got = {str(r) for r in token_counts.op10_token_counts(spark, str(tmp_path)).select("n_bytes", "n_tokens", "over_limit").collect()}
    stored = kept[0].join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(stored) >= len(ODD) - 1
    for r in stored:
        s, counts = r["text"] or "", token_counts.counts_of(r["prefix_steps"])
        assert len(counts) == len(s) + 1 and f"Row(n_bytes={len(s.encode())}, n_tokens={counts[-1]}, over_limit={counts[-1] > 4096})" in got
        for i in {*range(0, min(len(s), 60) + 1), len(s)}:
            assert counts[i] == len(sp.encode(s[:i]))


def test_steps_that_a_byte_does_not_hold():
    counter = token_counts.PrefixCounter(MODEL)
    counter.learn({"ab", "c"})
    counter.steps["ab"], counter.wide["ab"] = None, np.array([1, 300, -300], "<i4")
    stored = counter.stored(["ab", "c", "ab"])
    n = len(counter.steps["c"])
    assert stored[0] == 4 and token_counts.counts_of(stored).tolist()[:3] == [0, 301, 1] and len(token_counts.counts_of(stored)) == 6 + n


def test_counts_of_long_words_run_through_windows():
    rng = random.Random(6)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet in ("abcdefgh0123/+", "the ing", "日é🙂ab") for n in (1, 31, 32, 33, 64, 65, 200)]
    whole, windowed = token_counts.PrefixCounter(MODEL), token_counts.PrefixCounter(MODEL, window=32)
    for t in texts:
        assert token_counts.counts_of(windowed.of_texts([t])[0]).tolist() == token_counts.counts_of(whole.of_texts([t])[0]).tolist()


def test_longest_prefix(spark):
    got = token_counts.longest_prefix(token_counts.prefix_token_counts(docs(spark, ["hello world again", ""]), MODEL), 2)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    s = "hello world again"
    assert {r["doc_id"]: r["prefix_chars"] for r in rows(got)} == {0: max(i for i in range(len(s) + 1) if len(sp.encode(s[:i])) <= 2), 1: 0}


# Packing


def test_pieces_and_sequences(spark, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    got = rows(packing.best_fit_packing(odd, BPE, size=64, ranks_file=RANKS))
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            import zlib

            want[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [p[0] for p in places] == [0, *itertools.accumulate(p[1] for p in places)][:-1] and sum(p[1] for p in places) <= 64
    assert packing.best_fit_packing(empty, BPE).count() == 0


def test_local_search_raises_squared_fill():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(300, 700, 900), rng.integers(1, 1024, 900), np.full(50, 600)):
        bins = packing.best_fit(lengths, 1024)
        squares = lambda bs: sum(int(lengths[b].sum()) ** 2 for b in bs)  # noqa: E731, B023
        before, n = squares(bins), len(bins)
        better = packing.improve([list(b) for b in bins], lengths, 1024)
        assert squares(better) >= before and len(better) <= n and sorted(p for b in better for p in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= 1024 for b in better)


def plain_improvements(bins, size):
    """Every move or exchange with one or two pieces, between two underfull bins, that raises the sum of squared fills."""
    fill = [sum(b) for b in bins]
    for k, o in itertools.permutations([k for k in range(len(bins)) if fill[k] < size], 2):
        for x in bins[k]:
            backs = [(), *((q,) for q in bins[o]), *itertools.combinations(bins[o], 2)]
            for back in backs:
                d = x - sum(back)
                if d > 0 and fill[o] + d <= size and (fill[o] + d) ** 2 + (fill[k] - d) ** 2 > fill[o] ** 2 + fill[k] ** 2:
                    yield k, o, x, back


def test_no_improving_exchange_is_left():
    rng = np.random.default_rng(11)
    for size, high, n in [(40, 39, 60), (40, 25, 60), (64, 10, 80), (64, 63, 40), (30, 20, 50)] * 6:
        lengths = rng.integers(1, high + 1, n)
        places = np.array_split(rng.permutation(n), n)  # a poor start: each piece alone
        for start in ([p.tolist() for p in places], packing.best_fit(lengths, size)):
            better = packing.improve([list(b) for b in start], lengths, size)
            assert sorted(p for b in better for p in b) == list(range(n))
            assert next(plain_improvements([lengths[b].tolist() for b in better], size), None) is None


def test_documents_fill_sequences(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    got = packing.best_fit_packing(spark.read.parquet(path), BPE, ranks_file=RANKS).groupBy("sequence_id").agg(F.sum("length").alias("f")).collect()
    fill = [r["f"] for r in got]
    assert max(fill) <= 1024 and len(fill) <= math.ceil(sum(fill) / 1024) * 1.005


def test_levels_end_where_nothing_fits(spark):
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(40).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    got = packing.pack_pieces(packing.stash(pieces), 64, shard_pieces=50)
    assert got.count() == got.select("sequence_id").distinct().count() == 500


def test_plain_texts_are_encoded_whole():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(BPE), packing._Encoder(BPE, RANKS)
    for text in ("new words each time, ñandú\r\n  A1 I'll", "", " a", "Жук  x\n", *filter(None, ODD)):
        assert encoder.of_text(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    encoder.clear()
    encoder.of_text("words that no other text has, ñandú")
    assert not encoder  # no piece of it was cut and remembered


def test_levels_of_packing(spark):
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") * 37 % 60 + 1).alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    got = packing.pack_pieces(packing.stash(pieces), 64, shard_pieces=400)
    fill = [r["f"] for r in got.groupBy("sequence_id").agg(F.sum("length").alias("f")).collect()]
    assert got.count() == 3000 and max(fill) <= 64 and len(fill) <= math.ceil(sum(fill) / 64) * 1.02 + 2


# Chat


def turns(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, rendered string")


def test_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", r"<\/s>", r"[\\INST] [\/SYS] <", "[ROLE=x] [/ROLE]", " x ", "", None, "[/INS", "[INST", "<", "\\", "[[INST]", "[ANS] [SYS]\n[/SYS]"]
    data = [(c, i, role, t, "z") for c, role in enumerate(("user", "assistant", "system", "odd role]", "", None)) for i, t in enumerate(hard)]
    data += [(None, None, "user", "n", "z"), data[0], data[0]]
    formatted = chat_format.format_turns(turns(spark, data))
    got = {r["conv_id"]: r for r in rows(chat_format.read_back(formatted))}
    texts = {}
    for r in chat_format.in_order(formatted).collect():
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["rendered"]
    for conv in {d[0] for d in data}:
        own = sorted(((d[1] if d[1] is not None else -1, d[2] or "", d[3] or "") for d in data if d[0] == conv), key=lambda d: (d[0], d[1], chat_format.render(d[1], d[2])[0]))
        assert [t[:2] for t in chat_format.parse(texts[conv])] == [d[1:] for d in own]
        assert got[conv]["n_turns"] == len(own) and got[conv]["formatted_chars"] == len(texts[conv])
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        learned = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv]["loss_chars"] == len(learned) and got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_turns(turns(spark, data).limit(0))).count() == 0


def test_any_text_comes_back():
    random.seed(5)
    parts = ["[", "]", "<", "/", "\\", "INST]", "s>", "ANS]", "SYS]", "ROLE=", " ", "a", "\n"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 9)))
        for role in ("user", "assistant", "we ird]"):
            turn, _ = chat_format.render(role, text)
            assert [t[:2] for t in chat_format.parse(turn + turn)] == [(role, text)] * 2


# URLs


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, code int")


def plain_ratio(strings, order):
    """Log ratios of windows, from counts in dictionaries."""
    counts = {k: {} for k in (True, False)}
    for s, good in strings:
        p = "`" * order + s + "`"
        for i in range(len(s) + 1):
            w = p[i : i + order + 1]
            for k in range(order + 1):
                counts[good].setdefault(w[order - k : order], Counter())[w[order]] += 1

    def prob(good, context, c):
        if context is None:
            return 1 / 32
        seen = counts[good].get(context, Counter())
        lower = prob(good, context[1:] if context else None, c)
        n, kinds = sum(seen.values()), len(seen)
        return (seen[c] + kinds * lower) / (n + kinds) if n else lower

    return lambda w: round(1000 * math.log(prob(True, w[:-1], w[-1]) / prob(False, w[:-1], w[-1])))


def test_url_rules_and_scores(spark):
    urls = [f"http://{a}{i}.example.{t}/{p}/{i}" for i in range(12) for a, t, p in (("news", "com", "fr"), ("spam", "net", "es"), ("blog", "org", "x"))]
    urls += [None, "", "no scheme", "HTTP://WWW.Example.COM/en/1?q#f", "http://example.com/en/", "http://a.example.com/en/x", "x://net/fr/", "http://com", "http://xcom/", "a://b://c/d", "http://h\n/p", urls[0], urls[2]]
    got = {r["page_id"]: r for r in rows(url_filter.url_filter(pages(spark, urls)))}
    assert len(got) == len(urls)
    rule = lambda u: got[urls.index(u)]["rule"]
    assert (got[39]["host"], got[39]["path"], got[39]["rule"], got[39]["verdict"]) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert rule("http://example.com/en/") == rule("http://a.example.com/en/x") == "example.com/en/" and rule("x://net/fr/") == "net/fr/"
    assert rule("http://com") is None and rule("http://xcom/") is None and got[36]["host"] == got[36]["path"] == "" and got[38]["host"] == ""
    # scores against dictionaries: the same folds train
    folds = {r["page_id"]: r["f"] for r in pages(spark, urls).select("page_id", url_filter.fold(F.col("url"), 5).alias("f")).collect()}
    shown = {r["page_id"]: r["s"] for r in pages(spark, urls).select("page_id", url_filter.symbols(*url_filter.host_and_path(F.col("url"))).alias("s")).collect()}
    ratio = plain_ratio([(shown[i], got[i]["verdict"] == "allow") for i in got if got[i]["rule"] and folds[i] != 0], 3)
    for i, r in got.items():
        if r["rule"] is None:
            p = "```" + shown[i] + "`"
            assert r["score"] == pytest.approx(sum(ratio(p[k : k + 4]) for k in range(len(shown[i]) + 1)) / 1000 / (len(shown[i]) + 1), abs=1e-3)
    assert url_filter.url_filter(pages(spark, ["a"]).limit(0)).count() == 0


def test_url_verdicts_against_sql(spark):
    """Folds, threshold and verdicts, with rules' verdicts in both classes and repeated rows."""
    import duckdb
    import pandas as pd

    random.seed(9)
    urls = [f"http://{random.choice(['news', 'spam', 'www'])}{i}.{random.choice(['example', 'site'])}.{random.choice(['com', 'net', 'org'])}/{random.choice(['fr', 'es', 'en', 'de'])}/{random.choice(['page', 'buy', 'read'])}{i % 7}" for i in range(300)]
    urls += [None, "", urls[0], urls[0], "http://a.net/fr/" + "z" * 5000]
    pages_ = pd.DataFrame({"page_id": range(len(urls)), "url": urls, "html": "h"})  # noqa: F841
    con = duckdb.connect()
    con.sql("create view pages as select * from pages_")
    want = {r[0]: r[1:] for r in con.sql(f"select page_id, host, path, rule, verdict, score from ({url_filter.ORACLES['op3_url_filter']})").fetchall()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], None if r["score"] is None else round(r["score"], 9)) for r in rows(url_filter.url_filter(pages(spark, urls)))}
    assert got == want and {"allow", "block"} == {v[3] for v in got.values() if v[2] is None}


# Top-k


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), [float(v) for v in rng.normal(size=6)], 1) for i in range(130)]
    data += [data[0], data[0], (7, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (8, None, 1), (9, [float("nan")] * 6, 1), (None, data[3][1], 1), (300, data[50][1], 1), (11, [1e30] * 6, 1), (12, [0.5, 0.5], 1), (50, [0.25, 1.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score int")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for a, (q, u) in enumerate(good):
        if q is None or q % 50:
            continue
        best = sorted(((-min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(u, v, strict=True)))), i is None, i or 0) for b, (i, v) in enumerate(good) if a != b and len(u) == len(v)))[:5]
        want.update((q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(best))
    for block in (16_384, 40):
        got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df, F.col("vec_id") % 50 == 0, row_block=block, query_block=2)))
        assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# Mixing


def test_mix(spark, odd, empty):
    random.seed(2)
    texts = [" ".join(["w"] * random.choice([1, 5, 20, 90, 400])) for _ in range(600)]
    df = docs(spark, texts)
    got = rows(mixing.mix(df))
    assert got == rows(mixing.mix(df)) or Counter(map(str, got)) == Counter(map(str, rows(mixing.mix(df))))
    source = {i: [None, "a", "b"][i % 3] for i in range(600)}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["size"] == len(texts[r["doc_id"]].split())
    total, weights, capped = sum(sizes.values()), {"a": 5, "b": 2, None: 1}, {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        share = {s: (total - sum(capped.values())) * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s, t in (capped | share).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= max(5, 0.01 * t)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(df).columns == df.columns and mixing.mixed_documents(df).count() == sum(r["copies"] for r in got if r["size"])


# Personal data


def test_spans_and_redaction(spark, odd, empty):
    text = "mail a.b@c.example.com or +1 (377) 555-0271, host 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111 no 1234567890123456."
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)] == [("email", "a.b@c.example.com"), ("phone", "+1 (377) 555-0271"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111")]
    found = {r["doc_id"]: r for r in rows(pii.find_pii(docs(spark, [text, "clean text", None]), pii.fit(docs(spark, [text])), ["doc_id", "n_words"]))}
    assert found[0]["_pii_n_email"] == 1 and found[0]["_pii_spans"].startswith("email:5:") and "[EMAIL]" in found[0]["_pii_redacted"] and found[1]["_pii_redacted"] == "clean text"
    assert found[2]["_pii_spans"] == "" and found[2]["_pii_redacted"] is None
    assert pii.redacted_documents(odd).count() == odd.count() and pii.redacted_documents(odd).columns == odd.columns and pii.redacted_documents(empty).count() == 0


def plain_base_spans(text):
    """The contract's patterns one by one."""
    import re

    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 10 <= len(digits) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns(spark):
    random.seed(8)
    parts = ["a", "b@", "@", ".", "..", "x.com", "1", "12", "255", "256", "1.2.3.4", "4111", "1111 1111", "+1", "+", "(", ")", " ", "  ", "-", "%", "_", "é", "\n", "555-0271", "٣", "007"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(30_000)]
    for t in texts:
        assert pii.base_spans(t) == plain_base_spans(t), t
    # the query's columns from the same plain spans
    for r in rows(pii.find_pii(docs(spark, texts[:500]), pii.fit(docs(spark, texts[:500])), ["doc_id"])):
        base = plain_base_spans(texts[r["doc_id"]])
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert r["_pii_base_sha256"] == digest and [r[f"_pii_n_{k}"] for k in pii.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]


@pytest.mark.parametrize("piece", ["aadot", "a dot ", "a.", "a . ", "[dot]", "a@", "a at b dot ", "1", "1 ", "1.", "+1(", "1-"])
def test_time_grows_with_the_length(piece):
    import time

    for text in ("a@" + piece * 20 + "x" * 90, "a@" + piece * (1_000_000 // len(piece))):
        began = time.process_time()
        assert isinstance(pii.base_spans(text) + pii.candidates(text), list)
        assert time.process_time() - began < 20


def test_spelled_addresses_are_proposed():
    for text in ("write to jane [at] example [dot] com now", "jane at mail dot example dot org", "jane (at) example . com", "jane@example.com"):
        assert any(k == 0 for _, k, _ in pii.candidates(text)), text


@pytest.mark.parametrize("most", [30, 190, 10_000])
def test_sample_of_labels_is_bounded(spark, monkeypatch, most):
    random.seed(1)
    texts = [f"call +1 ({random.randint(200, 999)}) 555-{random.randint(1000, 9999)} or {random.randint(10**15, 10**16 - 1)}" for _ in range(100)]
    seen = []
    monkeypatch.setattr(pii.Trees, "fit", lambda self, x, y: seen.append(len(y)) or self)
    monkeypatch.setattr(pii, "thresholds", lambda trees, x, y, precision: seen.append(len(y)) or [])
    pii.fit(docs(spark, texts).repartition(3), most_labelled=most)
    assert 0 < sum(seen) <= most and (most < 200 or sum(seen) >= 190)


def test_pii_copies_are_one_proposal(spark):
    line = "Write to a.b@c.example.com or call +1 (377) 555-0271, card 4111 1111 1111 1111."
    assert pii.fit(docs(spark, [line] * 400), most_labelled=200)[1] == [float("inf")] * 4
    untrained = pii.Trees().fit(np.zeros((90, pii.FEATURES)), np.ones(90))
    assert pii.thresholds(untrained, np.zeros((200, pii.FEATURES)), np.ones(200), 0.9) == [float("inf")] * 4
    # copies don't crowd out the others: the sample of a table with copies is that of the table without
    others = [f"mail user{i}@host{i % 7}.example.org now, ref {i * 7919 + 1000000000}" for i in range(600)]
    plain, crowded = (pii.fit(docs(spark, t).repartition(3), most_labelled=300) for t in ([*others, line], [*others, *[line] * 900]))
    assert plain[1] == crowded[1] and repr(plain[0].trees) == repr(crowded[0].trees)


@pytest.mark.parametrize("most", [1, 50, 3000, 10_000])
def test_pii_lowest_keys(spark, most):
    keys = [random.Random(5).getrandbits(63) for _ in range(1)] * 4000 + [random.Random(i).getrandbits(63) for i in range(3000)] + list(range(40))
    found = spark.createDataFrame([(k,) for k in keys], "key long").repartition(4)
    got = {r["key"] for r in pii.lowest_keys(found, most).collect()}
    assert set(sorted(set(keys))[:most]) <= got and (len(got) <= 4 * most + 10 or got == set(keys))


def test_all_labelled_proposals_are_learnt_from(spark, monkeypatch):
    random.seed(4)
    lines = [f"call +1 ({random.randint(200, 999)}) 555-{random.randint(1000, 9999)} or {random.randint(10**15, 10**16 - 1)} at {random.randint(1, 299)}.0.{i % 256}.{i // 256}" for i in range(12_000)]
    table, numbers = docs(spark, [*lines, *lines[:500]]).repartition(5), []  # copies count once
    boost = pii.Trees.boost
    monkeypatch.setattr(pii.Trees, "boost", lambda self, sums: numbers.append(int(sums({}, [1])[2, 0, 0].sum())) or boost(self, sums))
    trees, limits = pii.fit(table)
    known, x, y = {}, [], []
    for line in lines:
        for (start, kind, end), of in pii.labels(line, pii.base_spans(line)):
            if of is not None:
                first = max(0, start - 40)
                key = int.from_bytes(hashlib.blake2b(f"{kind} {start - first} {end - start} {line[first : end + 40]}".encode(), digest_size=8).digest(), "little") >> 1
                known[key, of] = pii.features(line, start, kind, end)
    held = np.array([key % 4 == 0 for key, _ in known])
    assert len(known) > 20_000 and numbers == [(~held).sum()]
    # the same trees and thresholds as from all rows in one place
    x, y = np.array(list(known.values()), float), np.array([of for _, of in known], float)
    plain = pii.Trees()
    plain.start(trees.edges, y[~held].mean())
    bins, ones = plain._bins(x[~held]), np.ones((~held).sum(), np.int64)
    boost(plain, lambda tree, nodes: plain.sums(tree, nodes, bins, y[~held], ones))
    assert plain.trees == trees.trees and len(trees.trees) == 40 and limits == pii.thresholds(plain, x[held], y[held], 0.995)
    assert sum(t < float("inf") for t in limits) > 1


def test_numbers_parted_by_a_blank_are_found(spark):
    cards, mixed = "7536784127813050 4845168114407329", "+1 (826) 555-4081 190.137.223.204"
    assert pii.base_spans(cards) == [] and [k for _, k, _ in pii.base_spans(mixed)] == [1]
    assert {(0, 2, 16), (17, 2, 33)} <= set(pii.candidates(cards)) and {(0, 3, 17), (18, 1, 33)} <= set(pii.candidates(mixed))
    many = " ".join("1" for _ in range(3000))
    assert len(pii.candidates(many)) < 20 * 3000
    # a form that no check refutes has no label, and what belongs to a base span of another kind is a negative
    assert pii.label("10. 0. 0. 1", 0, 1, 11, set()) is None and pii.label("10. 0. 0. 256", 0, 1, 13, set()) == 0
    card = "4111 1111 1111 1111"
    assert dict(pii.labels(card, pii.base_spans(card)))[0, 3, 14] == 0
    random.seed(2)
    texts = []
    for i in range(500):
        number = str(random.randint(10**14, 10**15 - 1))
        number += next(d for d in "0123456789" if pii.luhn(number + d))
        texts.append(f"word {number} word +1 ({random.randint(200, 999)}) 555-{random.randint(1000, 9999)} word {random.randint(1, 255)}.{random.randint(0, 255)}.0.{i % 256} word {random.randint(10**15, 10**16 - 1)} word")
    found = pii.redacted_documents(docs(spark, [*texts, f"word {cards} word", f"word {mixed} word"]))
    assert {r["doc_id"]: r["text"] for r in found.where("doc_id >= 500").collect()} == {500: "word [CARD] [CARD] word", 501: "word [PHONE] [IP] word"}


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, (4000, pii.FEATURES)).astype(float)
    y = ((x[:, 2] > 9) & (x[:, 5] < 12)).astype(float)
    trees = pii.Trees().fit(x[:3000], y[:3000])
    assert ((trees.scores(x[3000:]) > 0) == y[3000:]).mean() > 0.97


# Quality rules


def plain_repeats(words):
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + k for p in places.values() if len(p) > 1 for i in p for k in range(8)})


def test_quality_counts(spark, odd, empty):
    random.seed(4)
    texts = [*ODD[:-1], *(" ".join(random.choice("ab") for _ in range(60)) for _ in range(20)), "x y\nx y\n\n\nx y", "#*$%&|<> a"]
    for t in texts:
        words = [w for w in __import__("re").split("[ \t-\r]+", t) if w]
        lines = [line for line in t.split("\n") if __import__("re").search("[^ \t-\r]", line)]
        n, chars, symbols, dup, repeated, _ = quality.counts_of(t.encode())
        assert (n, chars, dup, repeated) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), plain_repeats(words))
        assert symbols == sum(c in "#*$%&|<>" for c in t)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.good_documents(odd, labels)
    assert got.columns == odd.columns and {len((r["text"] or "").split()) >= 20 for r in rows(got)} <= {True}
    assert quality.good_documents(empty, labels).count() == 0


def test_cutoffs_control_risk():
    bins = np.arange(0, 101)
    good, bad = np.zeros(101, int), np.zeros(101, int)
    good[:11], bad[50:] = 1000, 10
    chosen = quality.cutoff(bins, good, bad, 0.01, 1e-3, 5.0)
    assert chosen is not None and 10 < chosen <= 50
    assert quality.cutoff(bins, good // 500, bad, 0.01, 1e-3, 5.0) is None  # too few labels to be sure
    n, p, k = 200, 0.03, 2
    assert math.exp(quality._log_binomial_tail(k, n, p)) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


# Near duplicates


def plain_components(texts, ids, size, percent=80):
    sets = []
    for t in texts:
        words = (t or "").encode().translate(near_dedup.LOWER_AZ).split()
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    label = {i: i for i in range(len(texts))}
    changed = True
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = {i: ids[i] for i in label}
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return [(ids[i], len(sets[i]), low[i]) for i in label]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    random.seed(size)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[random.choice(vocabulary) for _ in range(120)] for _ in range(6)]
    texts = []
    for words in base:
        for edits in [0, 0, 1, 2, 3, 4, 6, 8, 12, 20] * 2:
            copy = list(words)
            for _ in range(edits):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy).upper() if edits == 1 else " ".join(copy))
    texts += ["", None, " \n", "one", "ONE", "two words", "a b", "a b a b"]
    ids = random.sample(range(1000), len(texts))
    got = near_dedup.near_duplicates(docs(spark, texts, ids), shingle=size)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(got)) == sorted(plain_components(texts, ids, size))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows(got))


def test_near_duplicate_rows(spark, odd, empty):
    assert near_dedup.near_duplicates(odd).count() == odd.count() and near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.one_of_each_group(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id is not null").count() == kept.where("doc_id is not null").select("doc_id").distinct().count()
    clashing = odd.withColumns({c: F.lit("x") for c in ("_id", "_HASH", "bucket", "n", "pivot", "blk", "component_id", "set_hash")})
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    again = near_dedup.one_of_each_group(clashing)
    assert again.columns == clashing.columns and again.count() == kept.count() and spark.conf.get(name) == before


def test_pairs_of_a_crowded_pivot_are_dealt_into_blocks(spark):
    texts = ["a b c d e f g h i j", *(f"a b c d e f g h i j k{i}" for i in range(40)), *(f"z{i} b y d x" for i in range(10))]
    df = docs(spark, texts).select("doc_id", "text")
    ids = df.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("a"))
    pairs = near_dedup.stash(ids.join(ids.where("a.doc_id in (0, 1)").withColumnRenamed("a", "b"), F.col("a.doc_id") > F.col("b.doc_id")))
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    want = {(a, b) for b in (0, 1) for a in range(b + 1, len(texts)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    for block in (3, 1000):
        assert {(r["a"]["doc_id"], r["b"]["doc_id"]) for r in near_dedup.confirmed(pairs, df, 2, 80, block=block).collect()} == want


@pytest.mark.parametrize("block", [1, 2, 2048])
def test_sets_alone_decide_in_crowded_buckets(spark, block):
    # a link whose signatures agree on 283 of 392 coordinates: 3.5 deviations below what 0.8 lets expect are 285.9
    shared = [f"s505x{i}" for i in range(100)]
    pair = [" ".join(shared + [f"{c}505x{i}" for i in range(12)]) for c in "ab"]
    x, y = (near_dedup.shingles(t.encode(), 1) for t in pair)
    signer = near_dedup.Signer(7, 56)
    assert (signer.signature(x) == signer.signature(y)).sum() == 283 and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    others = [" ".join(shared[: 20 + 5 * i] + [f"{i}o{j}" for j in range(60)]) for i in range(6)]
    held = near_dedup.held_sets(docs(spark, [*pair, *others]).select("doc_id", "text"), 1)
    found = near_dedup.near_limit(held.withColumns({"grp": F.lit(1).cast("long"), "lab": F.least("doc_id", F.lit(2).cast("long"))}), 80, block)
    assert [(r["a"]["doc_id"], r["b"]["doc_id"]) for r in found.collect()] == [(1, 0)]


def test_signature_is_circular_minimum():
    signer = near_dedup.Signer(2, 3)
    values = near_dedup.shingles(b"a b c d e f", 2)
    second = np.random.default_rng(7).permutation(near_dedup.D)
    places = (near_dedup.mixed(values) & np.uint64(near_dedup.D - 1)).astype(int)
    assert signer.signature(values).tolist() == [min(second[(p + k) % near_dedup.D] for p in places) for k in range(6)]


# Language model


def test_lattice_sums_all_segmentations():
    pieces = lm_score.Pieces(["▁", "a", "b", "ab", "▁a", "▁ab", "ba"])
    log_p = pieces.start()
    p = dict(zip(pieces.vocabulary.entries, np.exp(log_p), strict=False))

    def total(word):
        return 1.0 if not word else sum(p.get(word[:k], 0) * total(word[k:]) for k in range(1, len(word) + 1))

    words = ["▁" + "".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)]
    scores, expected = pieces.forward(words, log_p, np.ones(len(words)))
    assert np.allclose(scores, [math.log(total(w)) for w in words])
    # expected characters spelled by pieces are the characters there are
    assert sum(e * len(w) for e, w in zip(expected, pieces.vocabulary.entries, strict=False)) == pytest.approx(sum(map(len, words)))
    assert np.isfinite(pieces.forward(["▁日x"], log_p)[0]).all()


def test_long_words_run_through_windows():
    rng = random.Random(4)
    entries = ["▁", "a", "b", "ab", "▁a", "aba", "bbab"]
    whole, windowed = lm_score.Pieces(entries), lm_score.Pieces(entries, window=7)
    words = ["▁" + "".join(rng.choice("abé") for _ in range(n)) for n in (1, 6, 7, 8, 13, 14, 15, 60, 200)]
    log_p, weights = whole.start(), np.arange(1.0, 10.0)
    a, ea = whole.forward(words, log_p, weights)
    b, eb = windowed.forward(words, log_p, weights)
    assert np.allclose(a, b) and np.allclose(ea, eb) and np.allclose(whole.forward(words, log_p)[0], windowed.forward(words, log_p)[0])


def test_scores(spark, odd, empty):
    import zlib

    texts = [*ODD, "the cat sat", "The CAT sat on", "unseen zzqq the"]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in rows(lm_score.lattice_scores(df, MODEL))}
    words = [(t or "").encode().translate(lm_score.LOWER_AZ).split() for t in texts]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    counts = Counter(w for i in held if not held[i] for w in [*words[i], b"\n"])
    n, v = sum(counts.values()), len(counts)
    for i, r in got.items():
        tokens = [*words[i], b"\n"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)) and -math.inf < r["score"] < 0
    again = {r["doc_id"]: r["score"] for r in rows(lm_score.lattice_scores(df.repartition(3), MODEL, block_bytes=2000, bucket_bytes=2000, most_words=20))}
    assert all(again[i] == pytest.approx(r["score"]) for i, r in got.items())
    assert lm_score.lattice_scores(odd, MODEL).count() == odd.count() and lm_score.lattice_scores(empty, MODEL).count() == 0


def test_steps_raise_training_likelihood():
    pieces = lm_score._pieces(MODEL)
    words, weights = [f"▁{a}{b}" for a in ("the", "thing", "whole") for b in ("ing", "er", "ly", "")], np.arange(1.0, 13.0)
    log_p, last = pieces.start(), -math.inf
    for _ in range(4):
        scores, expected = pieces.forward(words, log_p, weights)
        assert scores @ weights >= last - 1e-9
        last = scores @ weights
        log_p = np.log(np.maximum(expected, 1e-300) / expected.sum())


def test_long_texts_are_split():
    raw = b"ab cd  " * 4000 + b"x" * 9000 + b" y"
    parts = [p for _, p in lm_score.split_long([(0, raw)], 1000)]
    assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()
