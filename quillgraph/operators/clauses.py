"""Clauses of Markdown texts: markers, ends, ancestors, one record for each clause id.

A marker is a heading with a clause number, or a plain line with a number and a title. A plain line of a number alone
waits for the next line that decides: a heading without a number becomes its title, any other marker or bare number ends
the wait. Lines are exploded once with their offsets; markers, ends, ancestors and clause texts are windows and groups
over them, so no marker carries the text of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .identity import clause_quality, first_by

LONGEST_MARKER = 180  # a numbered line beyond that is prose


def parse(docs: DataFrame, schema: str = text.CLAUSE_SCHEMA, key: str = "source") -> DataFrame:
    """``key``, ``source``, ``standard_id``, ``standard_version``, ``clause_id``, ``clause_title``, ``clause_path``, ``start_offset``,
    ``end_offset``, ``raw_text``, ``evidence_id``, ``content_hash``, ``parse_method``.

    ``docs`` has source (a file name), text and ``key``, which is unique. Offsets are code points from 0. A clause ends where the
    next marker begins. Of several clauses with one id in a text the better one stays (a body wins over a table of
    contents), the earlier in a tie.
    """
    standard, version = text.display_id(F.col("source"), F.coalesce("text", F.lit("")))
    own = list(dict.fromkeys([key, "source"]))
    lines = docs.select(*own, standard.alias("standard_id"), version.alias("standard_version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    by_line = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("start", F.sum(F.length("line") + 1).over(by_line) - F.length("line") - 1)
    # each step names what the next uses several times, so that nothing is written out twice in the generated code
    lines = lines.withColumn("body", F.trim(F.regexp_replace("line", r"[\r\t]", " ")))
    lines = lines.withColumns({"marks": F.length(F.regexp_extract("body", r"^(#{1,6})", 1)), "clean": F.trim(F.regexp_replace("body", r"^#{1,6}\s*", ""))})
    events = lines.where(F.regexp_like("body", F.lit(r"^#|^(?:\d|[A-Za-z]\s*[.．。]|附|(?i:appendix|annex))"))).withColumns({"number": text.clause_number(F.col("clean")), "own_title": text.clause_title(F.col("clean"))})
    has = F.col("number").isNotNull()
    bare = has & (F.col("own_title") == "") & F.regexp_like("number", F.lit(r"^\d+(?:\.\d+){0,7}$"))
    kind = F.when((F.col("marks") > 0) & has, "heading").when(F.col("marks") > 0, "title").when(bare, "bare").when(has & (F.length("body") <= LONGEST_MARKER), "plain")
    events = events.select(*own, "start", kind.alias("kind"), "marks", "number", "own_title", "clean").where("kind is not null")
    by_start = Window.partitionBy(key).orderBy("start")
    follows = F.lead(F.struct("kind", "marks", "clean")).over(by_start)
    plain_level = F.least(F.lit(6), F.length(F.regexp_replace("number", r"[^.]", "")) + 2)
    events = events.withColumn("_next", follows)
    waits = (F.col("kind") == "bare") & (F.col("_next.kind") == "title")
    markers = events.where((F.col("kind").isin("heading", "plain")) | waits).select(
        *own, "start",
        F.when(waits, F.col("_next.clean")).otherwise(F.col("own_title")).alias("clause_title"),
        F.when(waits, F.least(plain_level, F.col("_next.marks"))).when(F.col("kind") == "heading", F.col("marks")).otherwise(plain_level).alias("level"),
        F.when(waits, "split_number_heading").when(F.col("kind") == "heading", "markdown_heading").otherwise("plain_number_heading").alias("method"),
        "number",
    )
    # "652" at level 4 is "6.5.2" with lost dots
    lost = F.regexp_like("number", F.lit(r"^\d+$")) & (F.col("level") >= 3) & (F.length("number") == F.col("level") - 1)
    dotted = F.array_join(F.filter(F.split("number", ""), lambda c: c != ""), ".")
    markers = markers.select(*own, "start", "clause_title", "level", F.when(lost, dotted).otherwise(F.col("number")).alias("clause_id"), F.when(lost, F.concat("method", F.lit(":ocr_compact_id_repaired"))).otherwise(F.col("method")).alias("parse_method"))
    # ancestors: the last marker of each smaller level, unless one of a still smaller level came after it
    name = F.trim(F.concat_ws(" ", "clause_id", "clause_title"))
    path = []
    for level in range(1, 6):
        above = F.last(F.when(F.col("level") <= level, F.struct("level", name.alias("name"))), ignorenulls=True).over(by_start)
        path.append(F.when((F.col("level") > level) & (above["level"] == level), above["name"]))
    markers = markers.withColumn("clause_path", F.array_compact(F.array(*path, name)))
    # each line belongs to the last marker at or before it
    tagged = lines.select(*own, "standard_id", "standard_version", "start", "line").join(markers.drop("source") if key != "source" else markers, [key, "start"], "left")
    fields = ["clause_id", "clause_title", "clause_path", "parse_method", "marker_start"]
    tagged = tagged.withColumn("marker_start", F.when(F.col("clause_id").isNotNull(), F.col("start")))
    held = F.last(F.when(F.col("clause_id").isNotNull(), F.struct(*fields)), ignorenulls=True).over(by_start)
    owned = tagged.select(*own, "standard_id", "standard_version", "start", "line", held.alias("m")).where("m is not null")
    gathered = F.array_sort(F.collect_list(F.struct("start", "line")))
    whole = owned.groupBy(*own, "standard_id", "standard_version", "m").agg(F.array_join(F.transform(gathered, lambda x: x["line"]), "\n").alias("_raw"), F.max(F.col("start") + F.length("line")).alias("_last"))
    raw = F.regexp_replace("_raw", r"^\s+|\s+$", "")
    last = F.lead("m.marker_start").over(Window.partitionBy(key).orderBy("m.marker_start"))
    records = whole.select(
        *own, "standard_id", "standard_version", "m.clause_id", "m.clause_title", "m.clause_path", F.col("m.marker_start").alias("start_offset"), F.coalesce(last, "_last").alias("end_offset"), raw.alias("raw_text"),
        text.evidence_id(F.col("standard_id"), F.col("m.clause_id"), schema).alias("evidence_id"), F.sha2(text.compact(raw), 256).alias("content_hash"), "m.parse_method",
    )
    return first_by(records.withColumn("_quality", clause_quality(F.col("raw_text"))), [key, "evidence_id"], F.desc("_quality"), "start_offset").drop("_quality")
