"""The graph of a question's passages against a plain version, on small made-up passages."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import questions as q
from quillgraph.operators import local

WORDS = q.NO_NAME


def telling(s):
    import re

    return [w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) >= 3 and w not in WORDS]


def same(a, b):
    x, y = a.lower().strip(), b.lower().strip()
    if not x or not y:
        return False
    if x == y or ((x in y or y in x) and min(len(x), len(y)) >= 6):
        return True
    s, t = sorted((telling(a), telling(b)), key=len)
    return bool(s) and all(w in t for w in s) and (len(s) >= 2 or len(s[0]) >= 6)


def plain_graph(question, kind, names, chunks, mentions, edges):
    seeds = []
    first = {}
    for idx, name in mentions:
        first[name] = min(first.get(name, idx), idx)
    for n in names:
        exact = sorted(m for m in first if m.lower() == n.lower())
        alike = sorted((m for m in first if same(n, m)), key=lambda m: (first[m], m))
        seeds += exact[:1] if exact else alike[:3]
    for _, title, _ in chunks:
        if title and (title.lower() in question.lower() or any(same(title, n) for n in [*names, *seeds])):
            seeds += [m for m in first if m.lower() == title.lower()]
    depth = {s: 0 for s in seeds}
    front = set(seeds)
    for d in (1, 2):
        new = set()
        for h, t, *_ in edges:
            for f in front:
                if same(f, h) or same(f, t):
                    new |= {h, t}
        low = {n.lower() for n in depth}
        front = {n for n in new if n.lower() not in low}
        depth |= {n: d for n in front}
    names_all = sorted(depth, key=lambda n: (depth[n], n))[:24]
    seeds = [n for n in names_all if depth[n] == 0]
    found = {}
    for h, t, idx, paragraph in edges:
        hs, ts = any(same(h, s) for s in seeds), any(same(t, s) for s in seeds)
        x = any(same(e, s) for s in names_all for e in (h, t))
        told = sum(len(n) >= 4 and (n.lower() in paragraph.lower() or n.lower() in f"{h} {t}".lower()) for n in names)
        if names_all and not (hs or ts or x):
            continue
        c = 0.75
        if hs or ts:
            c = (1.5 if told >= 2 else 1.35 if told else 1.15) + (0.15 if hs and ts else 0)
        elif x:
            c = 1.05 if told else 0.9
        key = (h, "with", t)
        found[key] = max(found.get(key, (0, 0)), (round(c, 9), -idx))
    if len(edges) and len([1 for h, t, *_ in edges if not names_all or any(same(e, s) for s in names_all for e in (h, t))]) < 4 or not edges:
        for idx, title, body in chunks:
            if names_all and (any((len(n) >= 4 and n.lower() in body.lower()) or same(title, n) for n in names_all)):
                found.setdefault((None, "context", title), (0.75, -idx))
    return {(k[1], k[2]): v[0] for k, v in found.items()}


CASES = [
    ("Who founded the company of Rex Maughan?", "cross", ["Rex Maughan", "Rex", "Maughan"], [(1, "Rex G. Maughan", "Rex G. Maughan founded Forever Living."), (2, "Forever Living", "Forever Living acquired Aloe Farms."), (3, "Unrelated", "Nothing here.")],
     [(1, "Rex G. Maughan"), (1, "Forever Living"), (2, "Forever Living"), (2, "Aloe Farms"), (3, "Nothing")], [("Rex G. Maughan", "Forever Living", 1, "Rex G. Maughan founded Forever Living."), ("Forever Living", "Aloe Farms", 2, "Forever Living acquired Aloe Farms."), ("Nothing", "Else Where", 3, "Nothing here.")]),
    ("Was Scream 2 set in Windsor College?", "single", ["Windsor College", "Scream 2"], [(1, "Scream 2", "Scream 2 at Windsor College."), (2, "Other", "A film.")], [(1, "Scream 2"), (1, "Windsor College"), (2, "Other")], [("Scream 2", "Windsor College", 1, "Scream 2 at Windsor College.")]),
    ("nothing named", "correlation", [], [(1, "Alpha", "Alpha and Beta")], [(1, "Alpha"), (1, "Beta")], [("Alpha", "Beta", 1, "Alpha and Beta")]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_graph(spark, case):
    question, kind, names, chunks, mentions, edges = CASES[case]
    asked = spark.createDataFrame([(1, question, kind, names)], "query_id long, text string, kind string, names array<string>")
    c = local.with_identity(spark.createDataFrame([(1, *x) for x in chunks], "query_id long, idx long, title string, text string"))
    m = spark.createDataFrame([(1, *x) for x in mentions], "query_id long, idx long, name string")
    e = spark.createDataFrame([(1, h, t, "with", i, p) for h, t, i, p in edges], "query_id long, head string, tail string, relation string, idx long, paragraph string")
    rows = local.local_graph(asked, c, m, e).collect()
    assert {(r["relation"], r["tail"]): r["confidence"] for r in rows} == pytest.approx(plain_graph(question, kind, names, chunks, mentions, edges))
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))


def test_injection(spark):
    found = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (1, 3, 3)], "query_id long, idx long, rank int")
    chunks = spark.createDataFrame([(1, i, "t") for i in range(1, 12)] + [(2, 1, "u"), (2, 2, " ")], "query_id long, idx long, text string")
    rows = {(r["query_id"], r["idx"]): (r["origin"], r["score"], r["position"]) for r in local.injected_passages(found, chunks).collect()}
    assert rows[1, 3] == ("unit", 1.0, 1) and rows[1, 2] == ("unit", 0.98, 2) and rows[1, 1] == ("fallback", 0.55, 3) and sum(k[0] == 1 for k in rows) == 8
    assert rows[2, 1] == ("fallback", 0.55, 1) and (2, 2) not in rows


def test_gold(spark):
    asked = spark.createDataFrame([(1, "was Rome near Paris?", "yes"), (2, "x", "blue"), (3, "x", "none")], "query_id long, text string, answer string")
    chunks = spark.createDataFrame([(1, i, f"about Rome {i}") for i in range(6)] + [(2, 1, "red"), (2, 2, "Blue sky"), (3, 4, "a"), (3, 5, "b")], "query_id long, idx long, text string")
    assert sorted((r["query_id"], r["idx"]) for r in local.infer_gold(asked, chunks).collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 2), (3, 4)]


def test_entities_of_a_question(spark):
    got = spark.createDataFrame([("Which film came after Scream 2, Scream or Windsor College?",)], "t string").select(local.question_entities(F.col("t")).alias("v")).first()["v"]
    assert got == ["windsor college", "scream 2"]
