"""Contexts of questions for a generator: renderings as lines of text, and a budget of characters for what they join to.

A rendering gives one row a line: the question's key, ``place`` (from 1, 0 for a heading) and ``line``. ``contexts`` joins the
lines of several renderings in order and cuts what passes the budget: a running size decides which lines begin within it and
how much of the last one fits, so no task gathers more text of a question than its budget.

Null and blank texts give no line where the rendering numbers texts. Ranks of a question must differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the surveyed formats.
MOST_CHARS, PASSAGE_CHARS, FACT_CHARS, MOST_FACTS = 24_000, 2_000, 240, 12
TRIMMED, CUT = "\n…[上下文已截断]", "…"
NO_PASSAGES, NO_EVIDENCE = "No relevant context.", "无相关上下文信息。"
EVIDENCE_HEADING, GRAPH_HEADING, REPORT_HEADING, FACT_HEADING = "\n【相关文档段落】", "【知识图谱信息】", "【图谱社区摘要】", "## Knowledge Graph Facts"


def _or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _stripped(c: str) -> Column:
    return F.regexp_replace(_or_empty(c), r"^\s+|\s+$", "")


def identity_line(standard: Column, clause: Column, evidence: Column) -> Column:
    """Standard, clause and evidence id as an answer may copy them; null without an evidence id."""
    named = F.concat(_or_empty(standard), F.lit("; Clause "), _or_empty(clause), F.lit("; Evidence "), evidence)
    return F.when(F.trim(evidence) != "", named)


def _with_heading(lines: DataFrame, key: str, heading: str) -> DataFrame:
    first = lines.select(key).distinct().select(key, F.lit(0).alias("place"), F.lit(heading).alias("line"))
    return first.unionByName(lines)


def _numbered(hits: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """The first ``most`` hits by rank; those with a text, stripped, get ``place`` from 1 without gaps."""
    w = Window.partitionBy(key).orderBy("rank")
    first = hits if most is None else hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    kept = first.withColumn("text", _stripped("text")).where(F.col("text") != "")
    return kept.withColumn("place", F.row_number().over(w))


def clause_blocks(hits: DataFrame, key: str, most: int) -> DataFrame:
    """Numbered clauses with file and identity. ``hits``: key, rank, source, text, identity (see ``identity_line``). Separate by an empty line."""
    header = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("unknown"))
    of = F.when(F.col("identity").isNotNull(), F.concat(F.lit(" | "), "identity", F.lit("\n条款身份: "), "identity")).otherwise("")
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] 来源: "), header, of, F.lit("\n"), "text")
    return _numbered(hits, key, most).select(key, "place", line.alias("line"))


def passages(hits: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Numbered passages with their source id, as questions of several hops have them."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] source: "), _or_empty("source"), F.lit("\n"), "text", F.lit("\n---"))
    return _numbered(hits, key, most).select(key, "place", line.alias("line"))


def evidence_blocks(hits: DataFrame, key: str, most: int = PASSAGE_CHARS) -> DataFrame:
    """All hits in order of rank, blank ones too, each text cut at ``most`` characters. ``notes``: what else is known, or null."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    body = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit(CUT))).otherwise(_or_empty("text"))
    of = F.when(F.col("identity").isNotNull(), F.concat(F.lit(" | "), "identity")).otherwise("")
    again = F.when(F.col("identity").isNotNull(), F.concat(F.lit("条款身份: "), "identity", F.lit("\n"))).otherwise("")
    notes = F.when(F.col("notes").isNotNull(), F.concat(F.lit("元信息: "), "notes", F.lit("\n"))).otherwise("")
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] 来源: "), _or_empty("source"), of, F.lit("\n内容: "), body, F.lit("\n"), again, notes, F.lit("---"))
    return _with_heading(hits.withColumn("place", place).select(key, "place", line.alias("line")), key, EVIDENCE_HEADING)


def graph_blocks(triples: DataFrame, key: str) -> DataFrame:
    """Triples by source and paragraph, both in order of their first triple. ``triples``: key, rank, head, relation, tail, source, paragraph, confidence, identity.

    The source stands before its first triple, the paragraph, if it isn't empty, before its own, and an empty line ends a paragraph.
    """
    t = triples.withColumns({"source": F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("unknown")), "paragraph": _or_empty("paragraph")})
    by_source, by_paragraph = Window.partitionBy(key, "source"), Window.partitionBy(key, "source", "paragraph")
    t = t.withColumns({"_s": F.min("rank").over(by_source), "_p": F.min("rank").over(by_paragraph), "_l": F.max("rank").over(by_paragraph)})
    source = F.when(F.col("rank") == F.col("_s"), F.concat(F.lit("KG来源: "), "source", F.lit("\n"))).otherwise("")
    paragraph = F.when((F.col("rank") == F.col("_p")) & (F.col("paragraph") != ""), F.concat(F.lit("段落: "), "paragraph", F.lit("\n"))).otherwise("")
    of = F.when(F.col("identity").isNotNull(), F.concat(F.lit(" [条款身份: "), "identity", F.lit("]"))).otherwise("")
    triple = F.concat(F.lit("- "), _or_empty("head"), F.lit(" | "), _or_empty("relation"), F.lit(" | "), _or_empty("tail"), F.lit(" (confidence="), F.col("confidence").cast("string"), F.lit(")"), of)
    line = F.concat(source, paragraph, triple, F.when(F.col("rank") == F.col("_l"), "\n").otherwise(""))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_s", "_p", "rank"))
    return _with_heading(t.withColumn("place", place).select(key, "place", line.alias("line")), key, GRAPH_HEADING)


def fact_lines(triples: DataFrame, key: str, most: int = MOST_FACTS) -> DataFrame:
    """The first ``most`` triples as facts with source and the beginning of their paragraph; numbers count triples without any text too."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    arrow = F.regexp_replace(F.concat(_or_empty("head"), F.lit(" --"), _or_empty("relation"), F.lit("--> "), _or_empty("tail")), "^[ -]+|[ -]+$", "")
    source = F.when(_or_empty("source") != "", F.concat(F.lit(" (source: "), "source", F.lit(")"))).otherwise("")
    paragraph = F.when(_or_empty("paragraph") != "", F.concat(F.lit("\n   evidence: "), F.substring("paragraph", 1, FACT_CHARS))).otherwise("")
    fact = triples.withColumns({"place": place, "_fact": F.concat(arrow, source, paragraph)}).where(F.col("place") <= most)
    line = F.concat(F.lit("K"), F.col("place").cast("string"), F.lit(". "), "_fact")
    return _with_heading(fact.where(F.regexp_replace("_fact", "^[ >-]+", "") != "").select(key, "place", line.alias("line")), key, FACT_HEADING)


def report_lines(reports: DataFrame, key: str) -> DataFrame:
    """Numbered reports of communities, an empty line behind the last. ``reports``: key, rank, report."""
    w = Window.partitionBy(key).orderBy("rank")
    end = F.when(F.lead("rank").over(w).isNull(), "\n").otherwise("")
    numbered = reports.withColumns({"place": F.row_number().over(w), "_end": end})
    line = F.concat(F.lit("G"), F.col("place").cast("string"), F.lit(". "), _or_empty("report"), "_end")
    return _with_heading(numbered.select(key, "place", line.alias("line")), key, REPORT_HEADING)


def contexts(renderings: list[tuple[DataFrame, str]], key: str, between: str = "\n", most: int = MOST_CHARS) -> DataFrame:
    """``key``, ``n_lines``, ``trimmed``, ``context``: the lines of ``renderings`` (lines and their separator), which ``between`` parts.

    A context longer than ``most`` characters ends there, in the middle of a line if need be, and says so. ``n_lines`` counts
    the lines that stand in it, whole or in part. A question without lines has no row; see ``with_default``.
    """
    union = None
    for part, (lines, separator) in enumerate(renderings):
        # no more of a line than the budget travels; its size does
        own = lines.select(key, F.lit(part).alias("part"), "place", F.lit(separator).alias("_sep"), F.length("line").alias("_n"), F.substring("line", 1, most).alias("line"))
        union = own if union is None else union.unionByName(own)
    w = Window.partitionBy(key).orderBy("part", "place")
    before = F.lag("part").over(w)
    joint = F.when(before.isNull(), "").when(before != F.col("part"), between).otherwise(F.col("_sep"))
    pieces = union.withColumn("_joint", joint).withColumn("_size", (F.length("_joint") + F.col("_n")).cast("long"))
    placed = pieces.withColumn("_end", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_begin", F.col("_end") - F.col("_size"))
    fits = placed.where(F.col("_begin") <= most).withColumn("_piece", F.substring(F.concat("_joint", "line"), F.lit(1), (F.lit(most) - F.col("_begin")).cast("int")))
    gathered = F.array_sort(F.collect_list(F.struct("part", "place", "_piece")))
    rows = fits.groupBy(key).agg(gathered.alias("_pieces"), F.count_if(F.length("_piece") > 0).alias("n_lines"), F.max(F.col("_end") > most).alias("trimmed"))
    joined = F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "")
    return rows.select(key, "n_lines", "trimmed", F.concat(joined, F.when(F.col("trimmed"), TRIMMED).otherwise("")).alias("context"))


def with_default(questions: DataFrame, found: DataFrame, key: str, default: str = NO_PASSAGES) -> DataFrame:
    """Every key of ``questions`` once with its context, ``default`` where nothing was found."""
    joined = questions.select(key).distinct().join(found, key, "left")
    return joined.na.fill({"n_lines": 0, "trimmed": False, "context": default})
