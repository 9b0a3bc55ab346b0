"""Each stage against a plain version, on the smallest tables and on rows with nulls, repeats and clashing columns."""

import itertools
import os
import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def stages(spark):
    """The name and the rows before and after each stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stash(stage(spark, docs, SF))
        assert name == corpus_pipeline.STAGES[-1][0] or after.columns == docs.columns
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()])
        docs = after
    return out


def test_quality_is_the_query_with_sql(spark, stages):
    import duckdb

    from quillgraph.llm import quality

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({quality.ORACLES['op7_quality_rules']}) where kept").fetchall()}
    before, after = stages["quality_rules"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r["doc_id"] in kept)


def test_one_of_each_group(stages):
    from test_operators import plain_components

    before, after = stages["near_duplicates"]
    least = {i: c for i, _, c in plain_components([r["text"] for r in before], [r["doc_id"] for r in before], 5)}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if least[r["doc_id"]] == r["doc_id"])


def test_personal_data_goes_and_nothing_else(stages):
    from test_operators import plain_base_spans

    before, after = stages["personal_data"]
    texts = {r["doc_id"]: r for r in after}
    assert len(before) == len(after) == len(texts)
    for r in before:
        got = texts[r["doc_id"]]
        assert {k: v for k, v in got.items() if k not in ("text", "n_chars")} == {k: v for k, v in r.items() if k not in ("text", "n_chars")}
        spans = plain_base_spans(r["text"])
        parts = re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", got["text"])
        if spans:
            assert len(parts) > 1 and not any(r["text"][a:b] in got["text"] for a, _, b in spans)
        if len(parts) == 1:
            assert got["text"] == r["text"] and got["n_chars"] == r["n_chars"]
        else:  # what is left stands in the text in this order, and the count is right
            at = 0
            for p in parts:
                at = r["text"].index(p, at) + len(p)
            assert got["n_chars"] == len(got["text"])


def plain_targets(sizes):
    """Targets of sources in order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, itertools.cycle((5, 2, 1)), strict=False))
    capped = {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        share = (sum(sizes.values()) - sum(capped.values())) / sum(weight[s] for s in free)
        over = {s: 3.0 * sizes[s] for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            return capped | {s: share * weight[s] for s in free}
        capped |= over


def test_mix_takes_sources_to_their_targets(stages):
    before, after = stages["source_mix"]
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += words(r)
        longest[r["source"]] = max(longest[r["source"]], words(r))
    for r in after:
        taken[r["source"]] += words(r)
    copies = Counter(map(str, after))
    assert set(copies) <= set(map(str, before)) and max(copies.values()) <= 3
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= max(longest[s], 0.02 * target)


def test_pieces_are_the_tokens(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages["best_fit_packing"]
    lengths, want, fill = Counter(), Counter(), Counter()
    for r in after:
        lengths[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    for r in before:
        want[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    least = max(-(-sum(fill.values()) // 1024), sum(r["length"] > 512 for r in after))  # no two longer ones share a sequence
    assert lengths == want and max(fill.values()) <= 1024 and len(fill) <= least * 1.05 + 1


def test_run(spark, stages):
    import corpus_pipeline

    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r["doc_id"] for r in stages["best_fit_packing"][1])


CLASHING = ("_id", "_hash", "_row", "_pii_text", "_pii_spans", "_q_text", "_q_kept", "_key", "size", "copies", "text_hash", "bucket", "n", "rep", "length", "_shard", "label")


def test_odd_rows_pass_all_stages(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with names that stages use."""
    import corpus_pipeline

    long = " ".join(f"word{i} of a very long text" for i in range(20_000))
    plain = " ".join(f"w{i}" for i in range(40))
    rows = [(1, plain, "en", "a", 9), (1, plain, "en", "a", 9), (2, plain, None, None, None), (None, plain + " x", "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", None, 0), (5, long, "de", "b", 5), (6, " \n\t", "en", "b", 3), (7, plain.upper(), "fr", "c", 7), (8, f"{plain} mail a.b@c.example.com {plain} y", "en", "c", 1)]
    docs = spark.createDataFrame([(*r, *("x" for _ in CLASHING)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    columns = docs.columns
    for empty in (False, True):  # noqa: B007
        here = docs.limit(0) if empty else docs
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            here = corpus_pipeline.stash(stage(spark, here, SF))
            assert name == corpus_pipeline.STAGES[-1][0] or here.columns == columns, name
            counts.append(here.count())
        assert counts == [0] * 5 if empty else counts[:3] == [6, 3, 3]
        if not empty:
            assert here.where("doc_id = 5").count() >= 0


def test_personal_data_learns_from_all_labelled_proposals(spark, monkeypatch):
    import corpus_pipeline
    from quillgraph.llm import pii

    lines = [f"call +1 ({200 + i % 700}) 555-{1000 + i} now" for i in range(22_000)]
    docs = spark.createDataFrame([(i, line, len(line)) for i, line in enumerate(lines)], "doc_id long, text string, n_chars long").repartition(3)
    seen = []
    monkeypatch.setattr(pii, "_fit_all", lambda found, precision: seen.append(found.select("key", "y").distinct().count()) or (pii.Trees(), [float("inf")] * 4))
    assert corpus_pipeline.personal_data(spark, docs, SF).count() == len(lines)
    assert len(seen) == 1 and seen[0] >= len(lines)
