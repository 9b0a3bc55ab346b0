"""Renderings and the budget against plain versions that join whole lists of strings."""

import random

import pytest

from quillgraph.operators import context

HIT = "query_id long, rank int, source string, text string, identity string, notes string"
TRIPLE = "query_id long, rank int, head string, relation string, tail string, source string, paragraph string, confidence double, identity string"


def _hits(rng):
    pick = lambda *xs: rng.choice(xs)
    words = lambda most: " ".join("".join(rng.choices("abé字", k=rng.randint(1, 8))) for _ in range(rng.randint(0, most)))
    return [(q, r, pick("a.md", "b.md", "", None), pick(None, "", " \n ", f" {words(5)}\n", words(40), words(900)), pick(None, f"S{r}; Clause 1; Evidence e{r}"), pick(None, "k:v")) for q in range(6) for r in range(1, 16) if q != 3]


def _triples(rng):
    pick = lambda *xs: rng.choice(xs)
    return [(q, r, pick("h", "- h", "", None), pick("is", "has"), pick("t", "t -", ""), pick("a.md", "b.md", None, ""), pick(None, "", "one", "two", "p" * 300), rng.randint(0, 8) / 8, pick(None, "S; Clause 2; Evidence e")) for q in range(6) for r in range(1, 18)]


def _blocks(hits, most=20):
    out = []
    for _, _, source, text, ident, _ in hits[:most]:
        if (text or "").strip():
            out.append(f"[{len(out) + 1}] 来源: {source or 'unknown'}" + (f" | {ident}\n条款身份: {ident}" if ident else "") + f"\n{text.strip()}")
    return "\n\n".join(out)


def _passages(hits, most=10):
    out = []
    for _, _, source, text, _, _ in hits[:most]:
        if (text or "").strip():
            out.append(f"[{len(out) + 1}] source: {source or ''}\n{text.strip()}\n---")
    return "\n".join(out)


def _evidence(hits):
    out = ["\n【相关文档段落】"]
    for i, (_, _, source, text, ident, notes) in enumerate(hits, 1):
        text = text or ""
        out += [f"[{i}] 来源: {source or ''}" + (f" | {ident}" if ident else ""), "内容: " + (text[:2000] + "…" if len(text) > 2000 else text)]
        out += [f"条款身份: {ident}"] * bool(ident) + [f"元信息: {notes}"] * bool(notes) + ["---"]
    return "\n".join(out) if hits else ""


def _graph(triples):
    groups = {}
    for _, _, h, r, t, source, paragraph, conf, ident in triples:
        groups.setdefault(source or "unknown", {}).setdefault(paragraph or "", []).append(f"- {h or ''} | {r} | {t or ''} (confidence={conf})" + (f" [条款身份: {ident}]" if ident else ""))
    out = ["【知识图谱信息】"]
    for source, paragraphs in groups.items():
        out.append(f"KG来源: {source}")
        for paragraph, lines in paragraphs.items():
            out += [f"段落: {paragraph}"] * bool(paragraph) + lines + [""]
    return "\n".join(out)


def _facts(triples):
    out = []
    for i, (_, _, h, r, t, source, paragraph, _, _) in enumerate(triples[:12], 1):
        fact = f"{h or ''} --{r}--> {t or ''}".strip(" -") + (f" (source: {source})" if source else "") + (f"\n   evidence: {paragraph[:240]}" if paragraph else "")
        if fact.strip("- >"):
            out.append(f"K{i}. {fact}")
    return "\n".join(["## Knowledge Graph Facts", *out]) if out else ""


def _trim(c, most):
    return c if len(c) <= most else c[:most] + "\n…[上下文已截断]"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(8)
    hits, triples = _hits(rng), _triples(rng)
    of = lambda rows: {q: [r for r in rows if r[0] == q] for q in range(6)}
    mixed = lambda rows, schema: spark.createDataFrame(rng.sample(rows, len(rows)), schema).repartition(3)
    return mixed(hits, HIT), mixed(triples, TRIPLE), of(hits), of(triples)


@pytest.mark.parametrize("most", [1, 40, 700, 24_000, 10**6])
def test_renderings_within_budgets(data, most):
    hits, triples, h, t = data
    cases = [
        ([(context.clause_blocks(hits, "query_id", 20), "\n\n")], lambda q: _blocks(h[q])),
        ([(context.passages(hits, "query_id"), "\n")], lambda q: _passages(h[q])),
        ([(context.evidence_blocks(hits, "query_id"), "\n")], lambda q: _evidence(h[q])),
        ([(context.graph_blocks(triples, "query_id"), "\n")], lambda q: _graph(t[q])),
        ([(context.fact_lines(triples, "query_id"), "\n")], lambda q: _facts(t[q])),
    ]
    for renderings, plain in cases:
        got = {r["query_id"]: r for r in context.contexts(renderings, "query_id", most=most).collect()}
        want = {q: plain(q) for q in range(6) if plain(q)}
        assert {q: r["context"] for q, r in got.items()} == {q: _trim(c, most) for q, c in want.items()}
        assert all(r["trimmed"] == (len(want[q]) > most) for q, r in got.items())


def test_renderings_together(data):
    hits, triples, h, t = data
    both = [(context.passages(hits, "query_id"), "\n"), (context.fact_lines(triples, "query_id"), "\n")]
    for most in (300, 24_000):
        got = {r["query_id"]: r["context"] for r in context.contexts(both, "query_id", between="\n\n", most=most).collect()}
        assert got == {q: _trim("\n\n".join(x for x in (_passages(h[q]), _facts(t[q])) if x), most) for q in range(6)}
    enhanced = [(context.graph_blocks(triples, "query_id"), "\n"), (context.evidence_blocks(hits, "query_id"), "\n")]
    got = {r["query_id"]: r["context"] for r in context.contexts(enhanced, "query_id").collect()}
    assert got == {q: _trim("\n".join(x for x in (_graph(t[q]), _evidence(h[q])) if x), 24_000) for q in range(6)}


def test_reports_and_defaults(spark, data):
    reports = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, None)], "query_id long, rank int, report string")
    found = context.contexts([(context.report_lines(reports, "query_id"), "\n")], "query_id")
    assert {r["query_id"]: r["context"] for r in found.collect()} == {1: "【图谱社区摘要】\nG1. first\nG2. second\n", 2: "【图谱社区摘要】\nG1. \n"}
    all_ = context.with_default(spark.createDataFrame([(1,), (1,), (7,)], "query_id long"), found, "query_id").collect()
    assert {r["query_id"]: (r["n_lines"], r["trimmed"], r["context"]) for r in all_} == {1: (3, False, "【图谱社区摘要】\nG1. first\nG2. second\n"), 7: (0, False, "No relevant context.")} and len(all_) == 2
    assert context.contexts([(context.passages(data[0].limit(0), "query_id"), "\n")], "query_id").count() == 0
