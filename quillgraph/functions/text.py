"""Text functions as columns. They stay in the JVM unless named ``*_udf``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = r"\x{4e00}-\x{9fff}"
#: Code prefixes of standards that texts name.
CODE_PREFIXES = ("GB/T", "GBT", "GB", "HB/Z", "HB_Z", "HB", "GJB", "QJ", "ISO")
#: Words that mark covers, contents and prefaces.
PREFACE_WORDS = ("目次", "目录", "前言", "出版", "印刷", "发行", "书号", "定价")
#: Phrases of a scope statement.
SCOPE_WORDS = ("适用于", "本标准规定", "本部分规定")
#: Patterns of text that can't serve as evidence.
UNUSABLE = (
    r"参\s*考\s*文\s*献|CCAR－|民航总局令|中华人民共和国(?:航空)?(?:行业)?标准|Requirements\s+for",
    r"ARINC\s*\d+|Air\s+transport\s+avionics|民用飞机飞行控制系统通用要求",
    r"本标准代替\s*HB|代替\s*HB\s*\d",
    r"分为以下\s*\d*\s*个部分|规范性引用文件|下列文件中的条款",
    r"^/\s*《",
)
STANDARD_CODE = r"(?i)(?:" + "|".join(CODE_PREFIXES) + r")[\s+]*[\d\-—－/.A-Za-z（）()]+"


def blank_to_null(c: Column) -> Column:
    """Missing, null and blank are the same."""
    return F.nullif(F.trim(c), F.lit(""))


def bound(c: Column, f) -> Column:
    """``f`` of a column that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), 0)


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


def mixed_tokens(c: Column) -> Column:
    """Single CJK characters and alphanumeric runs, case kept; all characters if there are none."""
    found = F.regexp_extract_all(c, F.lit(f"([{CJK}]|[A-Za-z0-9]+)"), 1)
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.split(c, ""), lambda x: x != ""))


def search_tokens(c: Column) -> Column:
    """Lower-cased CJK characters, letter runs and dotted numbers."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"([{CJK}]|[a-z]+|[0-9]+(?:\.[0-9]+)*)"), 1)


def english_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def char_ngrams(c: Column, n: int = 4) -> Column:
    """Set of character n-grams; a text of at most n characters is its own only gram; none of an empty text.

    The characters become an array, bound once, so that a gram costs the same wherever it stands.
    """
    grams = F.transform(
        F.array(F.split(c, "")),
        lambda chars: F.transform(F.sequence(F.lit(0), F.length(c) - n), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n)))),
    )
    return (
        F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.array().cast("array<string>"))
        .when(F.length(c) <= n, F.array(c))
        .otherwise(F.array_distinct(F.get(grams, 0)))
    )


def compact(c: Column) -> Column:
    """Lower case without tags, commands and anything but digits, a-z and CJK. For texts in NFKC (see ``nfkc_udf``)."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\\[a-zA-Z]+", ""), f"[^0-9a-z{CJK}]+", "")


@F.pandas_udf(T.StringType())
def nfkc_udf(s):
    """NFKC, then one form for dots, dashes and slashes; neither engine has it in SQL."""
    import unicodedata

    table = str.maketrans({"．": ".", "。": ".", "—": "-", "–": "-", "－": "-", "／": "/"})
    return s.fillna("").map(lambda t: unicodedata.normalize("NFKC", t).translate(table))


# Standards and clauses


def document_key(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    s = F.translate(F.regexp_replace(s, r"[+ ]", ""), "－—", "--")
    return F.regexp_replace(F.regexp_replace(s, r"\(\d{4}\)", ""), rf"[^a-z0-9{CJK}.\-_]", "")


#: Kinds and numbers in names of standards.
KINDS = "hbz|gbt|gjb|qj|hb"
NUMBER = r"(\d{2,6})(?:[.\-_](\d+))?"


def comparison_id(c: Column) -> Column:
    """``kind:number:part:year`` of a standard's name, or empty: prefix form, suffix form, loose prefix form, bare number."""
    s = F.regexp_replace(F.regexp_replace(document_key(c), r"\.md", ""), "_", "-")
    return bound(F.regexp_replace(F.regexp_replace(s, r"hb-z|hb/z", "hbz"), r"gb-t|gb/t", "gbt"), _comparison)


def _comparison(s: Column) -> Column:
    def tier(pattern: str, kind: int | Column, num: int, part: int, year: int) -> Column:
        get = lambda g: F.regexp_extract(s, pattern, g)
        name = get(kind) if isinstance(kind, int) else kind
        return F.when(F.regexp_like(s, F.lit(pattern)) & (name != ""), F.concat_ws(":", name, get(num), get(part), get(year)))

    bare_kind = F.coalesce(*(F.when(F.contains(s, F.lit(k)), k) for k in ("hbz", "gbt", "gjb", "qj")), F.when(s.startswith("hb") | F.regexp_like(s, F.lit(r"\bhb\b")), "hb"), F.lit(""))
    return F.coalesce(
        tier(rf"({KINDS}){NUMBER}-(\d{{4}})", 1, 2, 3, 4),
        tier(rf"{NUMBER}-(\d{{4}}).*?(gbt|gjb|qj|hbz|hb)", 4, 1, 2, 3),
        tier(rf"(?:^|[^a-z])({KINDS})[^\d]*{NUMBER}[^\d]*(\d{{4}})", 1, 2, 3, 4),
        tier(rf"{NUMBER}-(\d{{4}})", bare_kind, 1, 2, 3),
        F.lit(""),
    )


def same_document(a: Column, b: Column) -> Column:
    """Equal comparison ids if both have one; else equal keys, or containment of keys of 8 characters or more."""
    form = lambda c: F.struct(comparison_id(c).alias("id"), F.regexp_replace(document_key(c), r"\.md", "").alias("key"))
    return bound(F.struct(form(a).alias("a"), form(b).alias("b")), _same)


def _same(both: Column) -> Column:
    ia, ib, ka, kb = both["a"]["id"], both["b"]["id"], both["a"]["key"], both["b"]["key"]
    inside = (F.least(F.length(ka), F.length(kb)) >= 8) & (F.contains(ka, kb) | F.contains(kb, ka))
    return (ka != "") & (kb != "") & F.when((ia != "") & (ib != ""), ia == ib).otherwise((ka == kb) | inside)


def standard_codes(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({STANDARD_CODE})"), 1), lambda x: F.trim(x)))


#: Forms of punctuation that mean the same.
FORMS = ("．。—–－／", "..---/")


def one_form(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), *FORMS)


def display_id(file: Column, body: Column) -> tuple[Column, Column]:
    """Display name and year of a standard from its file name, with the head of its text where the name has no year."""
    s = F.regexp_replace(one_form(F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")), r"\+", " ")
    s = F.regexp_replace(F.regexp_replace(s, "_", "."), r"(?i)-(?:gbt|gb|hb|gjb)-(?:cd|e)-\d+$", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    upper, year = F.upper(s), F.regexp_extract(s, r"((?:19|20)\d{2})", 1)
    starts = [("GBT ", "GB/T "), ("GB ", "GB "), ("HB ", "HB "), ("GJB ", "GJB ")]
    name = F.coalesce(*(F.when(upper.startswith(k), F.concat(F.lit(v), F.substring(s, len(k) + 1, F.length(s)))) for k, v in starts), F.when(F.regexp_like(s, F.lit(r"^\d")), F.concat(F.lit("GB/T "), s)), s)
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*-\s*", "-"), r"\s+", " "))
    head, pattern = F.substring(one_form(body), 1, 1200), r"(?i)\b((?:GB\s*/?\s*T|GB|HB|GJB)\s*[0-9.]+)\s*-\s*((?:19|20)\d{2})"
    told, told_year = F.upper(F.regexp_replace(F.regexp_extract(head, pattern, 1), r"\s+", " ")), F.regexp_extract(head, pattern, 2)
    told = F.regexp_replace(F.concat(told, F.lit("-"), told_year), "GB ?/ T", "GB/T")
    by_text = (year == "") & (told_year != "")
    return F.when(by_text, told).otherwise(name), F.when(by_text, told_year).otherwise(year)


def clause_title(title: Column) -> Column:
    """What follows the number of a clause heading."""
    t = F.regexp_replace(F.trim(F.regexp_replace(one_form(title), r"^[#\s]+|[#\s]+$", "")), r"\s*\.\s*", ".")
    rest = F.regexp_replace(t, r"(?i)^(?:(?:附\s*录|附\s*件|appendix|annex)\s*[A-Z0-9一二三四五六七八九十]+|[A-Z]\.\d+(?:\.\d+){0,6}|\d+(?:\.\d+){0,7})", "")
    return F.regexp_replace(rest, r"^[ :：.\-\s]+|[ :：.\-\s]+$", "")


def clause_number(title: Column) -> Column:
    """Number of a clause heading (1.2.3, A.1, Annex B), or null."""
    t = F.regexp_replace(F.trim(F.regexp_replace(one_form(title), r"^[#\s]+|[#\s]+$", "")), r"\s*\.\s*", ".")
    after = rf"(?:\s|$|(?=[{CJK}A-Za-z（(]))"
    numeric = F.regexp_extract(t, rf"^(\d+(?:\.\d+){{0,7}}){after}", 1)
    letter = F.upper(F.regexp_extract(t, rf"(?i)^([A-Z]\.\d+(?:\.\d+){{0,6}}){after}", 1))
    annex = F.upper(F.regexp_extract(t, r"(?i)^(?:附\s*录|附\s*件|appendix|annex)\s*([A-Z0-9一二三四五六七八九十]+)\b", 1))
    return F.coalesce(F.nullif(numeric, F.lit("")), F.nullif(letter, F.lit("")), F.when(annex != "", F.concat(F.lit("Annex "), annex)))


# Evidence quality


def has_formula(c: Column) -> Column:
    return F.regexp_like(F.coalesce(c, F.lit("")), F.lit(r"\$\$[\s\S]{6,}\$\$|\$[^$]{8,}\$|式中|[ηη]\s*=|\\eta\s*\{?\s*="))


def unusable_evidence(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    latex = F.regexp_like(s, F.lit(r"\\mathrm|\\frac|\$\s*\\")) & ~F.regexp_like(s, F.lit(r"\$\$|式中|="))
    table_head = F.contains(squeezed(s), F.lit("零件材料材料技术要求"))
    out = (F.length(F.trim(s)) < 8) | latex | table_head
    for pattern in UNUSABLE:
        out |= F.regexp_like(s, F.lit("(?i)" + pattern))
    return out


def reference_density(c: Column) -> Column:
    """Standard codes for each 40 characters without white space (one at least)."""
    size = F.length(squeezed(c))
    hits = F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?i)(?:HB|GB/T|GBT|GB|GJB|QJ)\s*\d"))
    return F.when(size == 0, 0.0).otherwise(hits / F.greatest(F.lit(1.0), size / 40.0))


def preamble(c: Column) -> Column:
    s = squeezed(c)
    has = lambda words: F.regexp_like(s, F.lit("|".join(words)))
    cover = F.regexp_like(s, F.lit("HB[xX]{2,}|总规范")) & ~F.regexp_like(s, F.lit("应|宜|不得|不小于|不大于"))
    return (s == "") | has(PREFACE_WORDS) | (has(SCOPE_WORDS) & (F.length(s) < 80)) | (F.regexp_like(s, F.lit("^(?:范围|目次|前言)")) & (F.length(s) < 60)) | cover


def quality_ok(c: Column) -> Column:
    named = F.regexp_like(F.coalesce(c, F.lit("")), F.lit(r"(?i)中华人民共和国(?:航空)?(?:行业)?标准|Requirements\s+for|通用规范|规范性引用文件|分为以下\s*\d+\s*个部分"))
    return (F.coalesce(c, F.lit("")) != "") & ~unusable_evidence(F.substring(c, 1, 480)) & (F.length(squeezed(c)) >= 12) & ~preamble(c) & (reference_density(c) < 0.42) & ~named


def forward_reference(c: Column) -> Column:
    """Refers to another rule without a figure and unit of its own."""
    figure = r"(?i)\d+(?:\.\d+)?\s*(?:MΩ|kPa|mm|μm|%|次|℃|°C|N\b|Hz|h\b)"
    return F.regexp_like(F.coalesce(c, F.lit("")), F.lit("应符合.{0,20}的规定")) & ~F.regexp_like(F.coalesce(c, F.lit("")), F.lit(figure))


# Identities


CLAUSE_SCHEMA = "clause-v1"


def evidence_id(standard: Column, clause: Column, schema: str = CLAUSE_SCHEMA) -> Column:
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", standard, clause, F.lit(schema)), 256), 1, 20))


def identity(evidence: Column, standard: Column, clause: Column, chunk: Column) -> Column:
    """Evidence id, else standard and clause, else chunk id; defined once for all deduplication."""
    both = F.concat_ws("::", blank_to_null(standard), blank_to_null(clause))
    return F.coalesce(blank_to_null(evidence), F.when(blank_to_null(standard).isNotNull() & blank_to_null(clause).isNotNull(), both), blank_to_null(chunk.cast("string")))


def dedup_key(question: Column, answer: Column, explicit: Column | None = None) -> Column:
    """An explicit key, else the hash of question and answer with white space squeezed."""
    parts = [F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) for c in (question, answer)]
    hashed = F.sha2(F.concat_ws(" ", *parts), 256)
    return hashed if explicit is None else F.coalesce(blank_to_null(explicit), hashed)


#: Fixed value: a capitalised phrase, with small words inside. Word characters are ASCII, so that engines agree.
PHRASE = r"(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_'.-]*(?:\s+(?:of|the|and|de|[A-Z][A-Za-z0-9_'.-]*)){0,5})"


def capitalised_phrases(title: Column, text: Column, most: int = 32) -> Column:
    """The title, then capitalised phrases of the text, three characters or more, distinct, in order of appearance."""
    found = F.concat(F.array(F.coalesce(title, F.lit(""))), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHRASE), 1))
    long_enough = F.filter(found, lambda x: F.length(F.trim(x)) >= 3)
    return F.slice(F.array_distinct(F.transform(long_enough, lambda x: F.regexp_replace(x, r"^[ ,.;:()]+|[ ,.;:()]+$", ""))), 1, most)


# Model answers


def clean_answer(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)【(?:证据|Evidence)】.*$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"【(?:答案|Answer)】", ""), r"\[\d+\]", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def answer_tokens(c: Column) -> Column:
    """Multiset of numbers with units, Latin words of two characters or more, and CJK bigrams."""
    s = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), STANDARD_CODE, " "), r"\[\d+\]", " "))
    numbers = F.regexp_extract_all(s, F.lit(r"(\d+(?:\.\d+)?(?:%|mm|cm|m|mpa|pa|hz|v|a|ω|℃|μm|um|db|次|倍)?)"), 1)
    words = F.regexp_extract_all(s, F.lit(r"([a-z][a-z0-9_\-/]+)"), 1)
    runs = F.filter(F.regexp_extract_all(s, F.lit(f"([{CJK}]+)"), 1), lambda r: F.length(r) >= 2)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(numbers, words, pairs)


def answer_part(c: Column) -> Column:
    """The answer section, or all before an evidence section."""
    inside = F.regexp_extract(c, r"(?s)【(?:答案|Answer)】(.*?)(?=【(?:证据|Evidence)】|$(?!\n))", 1)
    return F.when(F.regexp_like(c, F.lit("【(?:答案|Answer)】")), inside).otherwise(F.element_at(F.split(c, "【(?:证据|Evidence)】", 2), 1))


def cited_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)(?:\.\d+)?\]"), 1), lambda x: x.cast("int"))


def cited_ids(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(ev_[0-9a-f]{20})\b"), 1), F.lower)


def judge_pass(score: Column, threshold: float = 0.7) -> Column:
    return F.coalesce(score.between(0.0, 1.0) & (score >= threshold), F.lit(False))


def judge_score(reply: Column) -> Column:
    """First number in [0, 1] of a judge's reply, -1 without one."""
    found = F.transform(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    return F.coalesce(F.get(F.filter(found, lambda x: x <= 1.0), 0), F.lit(-1.0))


# JSON replies

TRIPLE = "array<struct<head:struct<name:string,type:string>,relation:string,tail:struct<name:string,type:string>,confidence:double>>"


def parse_triples(reply: Column) -> Column:
    """Triples of a model's reply: thinking dropped, from the first "[" to the last "]", confidence 0.5 if missing; null if malformed."""
    s = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    rows = F.from_json(F.regexp_extract(s, r"(?s)(\[.*\])", 1), TRIPLE)
    return F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: r.withField("confidence", F.coalesce(r["confidence"], F.lit(0.5))))


def salvage_objects(reply: Column) -> Column:
    """Objects of a damaged JSON array as texts: thinking and control characters removed, trailing commas dropped, then object by object.

    An object is a stretch of balanced braces, strings and at most three levels of objects inside; Spark's parser decides
    whether it is one. What no brace closes drops.
    """
    s = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)<think>.*?</think>", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r",\s*([}\]])", "$1")
    inner = r'(?:[^{}"]|"(?:[^"\\]|\\.)*+")*+'
    for _ in range(3):
        inner = r'(?:[^{}"]|"(?:[^"\\]|\\.)*+"|\{' + inner + r'\})*+'
    found = F.regexp_extract_all(s, F.lit(r"(?s)(\{" + inner + r"\})"), 1)
    return F.filter(found, lambda x: F.get_json_object(x, "$").isNotNull())


def router_reply(reply: Column) -> Column:
    """Type (1, 2 or 3; else 1), entities and intent of a router's reply; from the first "{" to the last "}"."""
    row = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1), "struct<type_id:int,entities:array<string>,intent:string>")
    kind = F.when(row["type_id"].isin(1, 2, 3), row["type_id"]).otherwise(1)
    entities = F.filter(F.coalesce(row["entities"], F.array().cast("array<string>")), lambda e: blank_to_null(e).isNotNull())
    return F.struct(kind.alias("type_id"), F.transform(entities, lambda x: F.trim(x)).alias("entities"), F.coalesce(row["intent"], F.lit("")).alias("intent"))


# Vectors


def hash_embedding(tokens: Column, size: int = 16) -> Column:
    """Counts of tokens by the first hex digit of their MD5: a vector that every engine computes alike."""
    digits = F.transform(tokens, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 1), 16, 10).cast("int") % size)
    bound = F.array(digits)  # computed once, not for each component
    return F.get(F.transform(bound, lambda d: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(d, lambda x: x == i)).cast("double"))), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.when(norms > 0, norms), F.lit(0.0))
