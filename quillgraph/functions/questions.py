"""What a question names: standards, topics, dimensions of a comparison, people and things. All as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, STANDARD_CODE, comparison_id, document_key

#: Fixed value: an explicit standard with number and year.
FULL_STANDARD = r"(?i)(?<![A-Za-z0-9])(?:GB\s*/?\s*T|GBT|HB\s*[/._]\s*Z|HB[_\s]*Z|HB|GJB|QJ)[+\s]*\d{2,6}(?:[._-]\d+)?\s*[-—－]\s*\d{4}(?:\s*\(\d{4}\))?"
#: Standards in an answer without evidence, in this order.
CITED_STANDARDS = (r"(?i)GB/T\s*\d+(?:\.\d+)?[—\-]\d{4}", r"(?i)GBT\s*\d+(?:\.\d+)?[—\-]\d{4}", r"(?i)HB(?:/Z)?\s*\d+(?:\.\d+)?[—\-]\d{4}", r"(?i)GJB\s*\d+(?:\.\d+)?[—\-]\d{4}")
#: Fixed value: a standard and the number of one of its clauses.
CLAUSE_REFERENCE = r"(?i)((?:GB/T|GBT|GB|HB(?:/Z)?|GJB|QJ)\s*[\d.]+-\d{4}(?:\(\d{4}\))?)\s*第?\s*([A-Za-z]?\d+(?:\.\d+)*(?:\([A-Za-z0-9]+\))?)\s*条"
#: Fixed value: codes to take out of a topic.
TOPIC_CODE = r"(?i)(?:GB/T|GBT|GB|HB(?:/Z)?|GJB|QJ)[\s+]*[\d\-—－/.A-Za-z（）()]+"
#: Runs that are no topic.
NO_TOPIC = (
    "根据", "按照", "规定", "要求", "标准", "分别", "哪些", "什么", "如何", "有何", "不同", "异同", "方面", "内容", "开展", "结合", "还应", "提出", "进行", "以及",
    "或者", "综合", "参考", "统筹", "除", "外", "时", "中", "的", "与", "和", "对", "在", "为", "是", "了", "等", "及其", "具体", "相关",
)
#: Templates of what a question compares, the first that fits.
DIMENSIONS = (r"在(.{4,80}?)方面", r"围绕(.{4,80}?)(?:应如何|如何统筹|有何)", r"对(.{2,60}?)(?:的)?(?:要求|规定|应用|设置)?(?:有何|有什么)", r"(?i)^(.{2,60}?)(?:要求|规定)?在\s*(?:(?:GB/T|GBT|GB|HB(?:/Z)?|GJB|QJ)\s*[0-9])")
#: Words that are no part of a name.
NO_NAME = (
    "what", "which", "where", "when", "who", "whom", "whose", "why", "how", "that", "this", "these", "those", "with", "from", "have", "has", "had", "were", "been", "being",
    "into", "about", "after", "before", "during", "company", "companies", "organization", "organisations", "people", "person", "group", "film", "movie", "album", "song", "book",
    "city", "country", "state", "year", "years", "name", "named", "also",
    "known", "called", "based", "located", "founded", "born", "died", "american", "british", "english", "first", "second", "third", "same",
)
#: How kinds of standards are written.
PREFIXES = {"gbt": "GB/T", "gb": "GB", "hb": "HB", "hbz": "HB/Z", "gjb": "GJB", "qj": "QJ"}


def packed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _one_blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), 1)


def distinct_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first value of each key, in order."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: F.array_position(keys, key(v)) == i + 1)


# Standards


def standard_ids(question: Column) -> Column:
    """Explicit standards in one spelling, each once, in order."""

    def spelled(c: Column) -> Column:
        c = F.regexp_replace(_one_blank(F.regexp_replace(c, r"\+", " ")), r"\s*[-—－]\s*", "-")
        c = F.regexp_replace(F.regexp_replace(c, r"(?i)GB\s*/?\s*T", "GB/T"), r"(?i)HB\s*(?:/|\.|_)\s*Z", "HB/Z")
        kind = F.regexp_extract(c, r"(?i)^(HB|GJB|QJ)\s*(?=\d)", 1)
        return F.when(kind != "", F.concat(F.upper(kind), F.lit(" "), F.regexp_replace(c, r"(?i)^(?:HB|GJB|QJ)\s*(?=\d)", ""))).otherwise(c)

    return distinct_by(F.transform(_all(question, FULL_STANDARD), spelled), lambda c: F.upper(F.regexp_replace(c, " ", "")))


def standard_keys(question: Column) -> Column:
    """Comparison ids of the codes in a question, or their document keys where there is none; each once, in order."""
    key = lambda c: F.coalesce(F.nullif(comparison_id(c), F.lit("")), F.regexp_replace(document_key(c), r"\.md", ""))
    return F.array_distinct(F.filter(F.transform(_all(question, STANDARD_CODE), key), lambda k: k != ""))


def keys_or_of_entities(question: Column, entities: Column) -> Column:
    """Keys of the question; only if it has none, those of its entities."""
    own = standard_keys(question)
    return F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.flatten(F.transform(F.coalesce(entities, F.array().cast("array<string>")), standard_keys))))


def cited_standards(answer: Column) -> Column:
    """Standards that an answer names, pattern by pattern."""
    return distinct_by(F.concat(*(F.transform(_all(answer, p), lambda x: F.trim(x)) for p in CITED_STANDARDS)), lambda c: F.upper(packed(c)))


def surfaces(question: Column) -> Column:
    """Standards as the question writes them: six characters or more, without particles behind."""
    raw = F.transform(_all(question, STANDARD_CODE), lambda c: F.regexp_replace(_one_blank(F.regexp_replace(c, r"^[ ，,;；]+|[ ，,;；]+$", "")), "[的和与及]+$", ""))
    return distinct_by(F.filter(raw, lambda c: F.length(c) >= 6), lambda c: F.lower(packed(c)))


def clause_references(question: Column) -> Column:
    """(standard, clause) pairs that a question names, as structs ``standard`` and ``clause``."""
    whole = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(CLAUSE_REFERENCE), 0)
    return F.transform(whole, lambda c: F.struct(F.trim(F.regexp_extract(c, CLAUSE_REFERENCE, 1)).alias("standard"), F.regexp_extract(c, CLAUSE_REFERENCE, 2).alias("clause")))


def clause_form(c: Column) -> Column:
    """A clause number without white space, case and the words around it."""
    return F.regexp_replace(F.lower(packed(F.coalesce(c, F.lit("")))), "^[第条.;；]+|[第条.;；]+$", "")


def grounded_entities(question: Column, standards: Column, entities: Column) -> Column:
    """The standards, then the entities that the question holds literally; what looks like a standard and isn't one of them drops."""
    asked = F.lower(packed(F.coalesce(question, F.lit(""))))
    form = lambda e: F.lower(packed(e))
    trimmed = F.filter(F.transform(F.coalesce(entities, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda e: F.coalesce(e, F.lit("")) != "")
    kept = F.filter(trimmed, lambda e: F.array_contains(standards, e) | (F.contains(asked, form(e)) & ~F.regexp_like(form(e), F.lit("^(?:gb/?t|gbt|hb(?:/?z)?|gjb|qj)"))))
    return distinct_by(F.concat(standards, kept), form)


def canonical_token(token: Column) -> Column:
    """Comparison id of a key or a name."""
    t = _one_blank(F.regexp_replace(F.trim(token), r"^[{}\[\]]+|[{}\[\]]+$", ""))
    key = r"^(gbt|gb|hbz|hb|gjb|qj):(\d{2,6}):(\d*):(\d{4})$"
    return F.when(F.regexp_like(F.lower(t), F.lit(key)), F.regexp_replace(F.lower(t), "^gb:", "gbt:")).otherwise(comparison_id(t))


def surface_of(canonical: Column, of_question: Column) -> Column:
    """The question's spelling of a comparison id, or the usual one."""
    own = F.get(F.filter(of_question, lambda s: comparison_id(s) == canonical), 0)
    part = lambda i: F.get(F.split(canonical, ":"), i)
    prefix = F.coalesce(*(F.when(part(0) == k, v) for k, v in PREFIXES.items()), F.upper(part(0)))
    usual = F.concat(prefix, F.lit(" "), part(1), F.when(part(2) != "", F.concat(F.lit("."), part(2))).otherwise(""), F.lit("-"), part(3))
    return F.coalesce(own, F.when(F.size(F.split(canonical, ":")) == 4, usual), canonical)


def with_surfaces(question: Column, answer: Column) -> Column:
    """An answer with template slots and internal keys replaced by the question's spellings; as it is if the question names no standard."""
    own = surfaces(question)
    out = answer
    for slot, i in ((r"\{标准\s*A\}", 0), (r"\{标准\s*B\}", 1), (r"\{标准\s*1\}", 0), (r"\{标准\s*2\}", 1), (r"\{标准\s*3\}", 2), (r"\{标准号\}", 0)):
        out = F.when(F.size(own) > i, F.regexp_replace(out, F.lit(slot), F.get(own, i))).otherwise(out)
    out = F.regexp_replace(out, F.lit(r"\{标准…\}"), F.array_join(own, "、"))  # codes hold no sign that a replacement reads

    def in_braces(piece: Column) -> Column:
        tokens = F.filter(F.transform(F.split(F.regexp_replace(piece, r"^\{|\}$", ""), "[,，;；、]+"), lambda x: F.trim(x)), lambda x: x != "")
        named = F.exists(tokens, lambda x: canonical_token(x) != "")
        mapped = F.transform(tokens, lambda x: F.when(canonical_token(x) != "", surface_of(canonical_token(x), own)).otherwise(x))
        return F.when(F.regexp_like(piece, F.lit(r"^\{[^{}]{6,160}\}$")) & named, F.array_join(mapped, "、")).otherwise(piece)

    out = F.array_join(F.transform(F.regexp_extract_all(out, F.lit(r"(\{[^{}]{6,160}\}|[^{}]+|[{}])"), 1), in_braces), "")
    key = r"\b(?:gbt|gb|hbz|hb|gjb|qj):\d{2,6}:\d*:\d{4}\b"
    bare = lambda piece: F.when(F.regexp_like(piece, F.lit(f"(?i)^{key}$")), surface_of(canonical_token(piece), own)).otherwise(piece)
    out = F.array_join(F.transform(F.regexp_extract_all(out, F.lit(rf"(?is)({key}|(?:(?!{key}).)+)"), 1), bare), "")
    return F.when(F.coalesce(answer, F.lit("")) == "", answer).when(F.size(own) > 0, out).otherwise(answer)


# Topics


def topic(question: Column) -> Column:
    """The question without codes of standards."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(question, F.lit("")), TOPIC_CODE, " "), "综合参考|综合", " ")
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^[ ，,？?。]+|[ ，,？?。]+$", "")


def topic_terms(question: Column, most: int = 24) -> Column:
    """Pieces of two to four CJK characters that may name the topic, the longest first."""
    stop = F.array(*map(F.lit, NO_TOPIC))
    grams = lambda run, n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))
    none = F.array().cast("array<string>")

    def of(run: Column) -> Column:
        short = F.concat(F.array(run), F.when(F.length(run) >= 3, grams(run, 2)).otherwise(none))
        return F.when(F.length(run) <= 4, F.when(F.array_contains(stop, run), none).otherwise(short)).otherwise(F.concat(grams(run, 4), grams(run, 3), grams(run, 2)))

    runs = _all(F.regexp_replace(F.coalesce(question, F.lit("")), STANDARD_CODE, " "), f"[{CJK}]{{2,}}")
    terms = F.array_except(F.array_distinct(F.flatten(F.transform(runs, of))), stop)
    ordered = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(ordered, lambda x: x["t"]), 1, most)


def dimensions(question: Column, most: int = 4) -> Column:
    """What a question compares, at most ``most`` dimensions."""
    q = F.coalesce(question, F.lit(""))
    body = F.coalesce(*(F.when(F.regexp_like(q, F.lit(p)), F.regexp_extract(q, p, 1)) for p in DIMENSIONS), F.lit(""))
    parts = F.transform(F.split(body, r"\s*[与和、／/]\s*|\s+与\s+"), lambda p: packed(F.regexp_replace(p, "^[ ，,、]+|[ ，,、]+$", "")))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2)), 1, most)


def side_topic(question: Column, index: Column) -> Column:
    """The dimension of the ``index``-th standard (from 0); the only one serves all; without one the question."""
    dims = dimensions(question)
    return F.coalesce(F.when(F.size(dims) == 1, F.get(dims, 0)).when(index >= 0, F.get(dims, index)), question, F.lit(""))


def query_for_side(question: Column, index: Column) -> Column:
    """The question with its side in front, for a reranker."""
    q = F.trim(F.coalesce(question, F.lit("")))
    side = side_topic(q, index)
    return F.when((side != q) & (F.length(packed(side)) >= 2), F.concat(F.lit("关注："), side, F.lit("\n"), q)).otherwise(q)


# Names


def names(question: Column, extra: Column | None = None) -> Column:
    """Names of several capitalised words, words with a number, single words of four letters or more; then ``extra``; each once."""
    q = F.coalesce(question, F.lit(""))
    several = _all(q, r"(?U)\b[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)+\b")
    numbered = _all(q, r"(?U)\b[A-Z][a-zA-Z0-9]*(?:\s+\d+)\b")
    single = F.filter(_all(q, r"(?U)\b[A-Z][a-zA-Z0-9]{3,}\b"), lambda w: ~F.lower(w).isin(*NO_NAME))
    more = F.filter(F.transform(extra, lambda x: F.trim(x)), lambda w: F.coalesce(w, F.lit("")) != "") if extra is not None else F.array().cast("array<string>")
    return distinct_by(F.concat(several, numbered, single, more), F.lower)


def telling_tokens(c: Column) -> Column:
    """Words of three letters or more that can tell a name."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda t: (F.length(t) >= 3) & ~t.isin(*NO_NAME))


def same_name(a: Column, b: Column) -> Column:
    """Whether two names mean the same: equal; one of six letters or more inside the other; all telling words of the shorter in the longer."""
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    inside = (F.contains(x, y) | F.contains(y, x)) & (F.least(F.length(x), F.length(y)) >= 6)
    s, t = telling_tokens(a), telling_tokens(b)
    short, long_ = F.when(F.size(s) <= F.size(t), s).otherwise(t), F.when(F.size(s) <= F.size(t), t).otherwise(s)
    covered = F.forall(short, lambda w: F.array_contains(long_, w))
    words = (F.size(short) > 0) & covered & ((F.size(short) >= 2) | (F.length(F.get(short, 0)) >= 6))
    return (x != "") & (y != "") & ((x == y) | inside | F.coalesce(words, F.lit(False)))


def name_in(name: Column, lowered: Column) -> Column:
    """A name of four letters or more inside a lower-cased text."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (F.length(n) >= 4) & F.contains(lowered, n)


def entity_form(name: Column) -> Column:
    """An entity's name with single blanks and standards in one spelling."""
    s = _one_blank(F.coalesce(name, F.lit("")))
    for kind in ("HB", "GB/T", "GJB"):
        s = F.regexp_replace(s, rf"(?i){kind}\s*(\d+)\s*[-—]\s*(\d{{4}})", f"{kind} $1-$2")
    return s


def base_name(path: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(path, F.lit("")), r"[\\/]"), -1))


def slug(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\-]", "_")


def source_list(sources: Column) -> Column:
    """Sources without blank ones; ``unknown`` if none is left."""
    kept = F.filter(F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda s: F.coalesce(s, F.lit("")) != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("unknown")))


def id_list(c: Column) -> Column:
    """Ids of a text that is one id or a bracketed list of quoted ones."""
    s = F.trim(F.coalesce(c, F.lit("")))
    listed = F.filter(F.transform(F.split(F.regexp_replace(s, r"^\[|\]$", ""), ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))), lambda x: x != "")
    return F.when(s == "", F.array().cast("array<string>")).when(F.regexp_like(s, F.lit(r"^\[.*\]$")), listed).otherwise(F.array(s))


def passage_ids(c: Column) -> Column:
    """Ids of passages (24 hex digits and a number) in a text, each once."""
    return F.array_distinct(_all(c, r"(?i)\b[a-f0-9]{24}_\d+\b"))
