"""Secret scans by a trigram inverted index, with DataFrame and SQL functions only.

Each rule's regular expression is turned into a Boolean query over lower-cased trigrams that any match must contain: an OR
over literal alternatives of the AND of their trigrams, one such clause for every literal stretch.  The index holds a
posting (trigram, document) for the trigrams that some rule asks for.  Intersecting the postings of a document gives the
rules it may match; the text is then searched for those rules alone.  A rule without a mandatory trigram (a run of hex
digits) is searched for in every text.

Spans are code-point offsets, end exclusive, leftmost and non-overlapping for each rule; they come from the lengths of the
matches and of the pieces between them.  The ``least`` group of a match must have ``least_length`` characters, else the match
is dropped after it has taken its place.

A document is known to the index by a hash of its id and text, so rows without an id, or with a shared one, are dealt out by
their texts.

Edge cases: a null or empty text has no spans; equal rows share postings and are reported one by one; an empty table gives no
rows; other columns are not read; a text's work is linear in its length and its matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least_length: int = 1
    base: bool = False


# Quotes are written as \x22 and \x27 so that a pattern can stand in any SQL literal.
RULES = [
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
MOST_LITERALS = 64
#: Matches folded at a time.
BLOCK = 128


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses to be ANDed; a clause is an OR of trigram sets, each to be contained whole.  No clause: nothing is mandatory."""
    parser, constants = re._parser, re._constants
    clauses: list[list[frozenset[str]]] = []

    def close(texts: set[str]) -> None:
        if texts and min(map(len, texts)) >= 3:
            clauses.append([frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in sorted(texts)])

    def exact(items) -> set[str] | None:
        """All texts the items match, if they are few."""
        texts = {""}
        for op, value in items:
            more = one(op, value)
            if more is None or len(texts) * len(more) > MOST_LITERALS:
                return None
            texts = {a + b for a in texts for b in more}
        return texts

    def one(op, value) -> set[str] | None:
        if op is constants.LITERAL:
            return {chr(value).lower()}
        if op is constants.SUBPATTERN:
            return exact(value[3])
        if op is constants.BRANCH:
            parts = [exact(x) for x in value[1]]
            return None if None in parts else set().union(*parts)
        if op is constants.IN:
            if any(k is not constants.LITERAL for k, _ in value) or len(value) > 6:
                return None
            return {chr(v).lower() for _, v in value}
        if op in (constants.MAX_REPEAT, constants.MIN_REPEAT) and value[1] <= 3:
            body = exact(value[2])
            if body is None:
                return None
            texts, run = ({""} if value[0] == 0 else set()), {""}
            for n in range(1, int(value[1]) + 1):
                run = {a + b for a in run for b in body}
                if n >= value[0]:
                    texts |= run
            return texts if len(texts) <= MOST_LITERALS else None
        return None

    held = {""}
    for op, value in parser.parse(pattern):
        more = one(op, value)
        if more is not None and len(held) * len(more) <= MOST_LITERALS:
            held = {a + b for a in held for b in more}
        else:
            close(held)
            held = {""} if more is None else more
    close(held)
    return clauses


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def spans_sql(rule: Rule, text: str = "text") -> str:
    """array<struct<start:int,end:int>> of the rule's matches that hold.

    Lengths are added up within blocks of matches and then over the blocks, so the work is linear in the matches of a text.
    """
    pat = _literal(rule.pattern)
    kept = "e.found is not null" + (f" and length(e.value) >= {rule.least_length}" if rule.group else "")
    value = f", regexp_extract_all({text}, {pat}, {rule.group}) as value" if rule.group else ""
    zipped = "arrays_zip(x.gaps, x.found" + (", x.value)" if rule.group else ")")
    within = f"""transform(sequence(0, (size(z) - 1) div {BLOCK}), b -> aggregate(slice(z, b * {BLOCK} + 1, {BLOCK}),
        struct(0 as at, cast(array() as array<struct<start:int,end:int>>) as spans), (a, e) ->
          struct(a.at + length(e.gaps) + coalesce(length(e.found), 0) as at,
            if({kept}, array_append(a.spans, struct(a.at + length(e.gaps) as start, a.at + length(e.gaps) + length(e.found) as end)), a.spans) as spans)))"""
    moved = """flatten(transform(w.blocks, (b, k) -> transform(b.spans, s -> struct(s.start + w.before[k] as start, s.end + w.before[k] as end))))"""
    before = "aggregate(y, array(0), (o, b) -> array_append(o, element_at(o, -1) + b.at))"
    source = f"array(struct(split({text}, {pat}, -1) as gaps, regexp_extract_all({text}, {pat}, 0) as found{value}))"
    return f"""transform(transform(transform(transform({source}, x -> {zipped}), z -> {within}),
      y -> struct(y as blocks, {before} as before)), w -> {moved})[0]"""


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """docs: t, text.  The inverted index: (gram, t) for each asked-for trigram and each document that has it."""
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return docs.select("t", F.lower("text").alias("low")).select("t", F.explode(present).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]], grams: list[str]) -> DataFrame:
    """t and a Boolean column may_<kind> per rule: the postings of each document, intersected by the rule's query."""
    place = {g: i for i, g in enumerate(grams)}
    words = (len(grams) + 62) // 63
    sums = [F.bit_or(F.when(F.floor(F.col("gram") / 63) == w, F.expr("shiftleft(1L, gram % 63)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]

    def has(need: frozenset[str]) -> Column:
        tests = []
        for w in range(words):
            mask = sum(1 << (place[g] % 63) for g in need if place[g] // 63 == w)
            if mask:
                tests.append(F.col(f"w{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        return _all(tests)

    held = index.groupBy("t").agg(*sums)
    flags = {f"may_{kind}": _all([_any([has(s) for s in clause]) for clause in clauses]) for kind, clauses in queries.items()}
    return held.select("t", *[c.alias(k) for k, c in flags.items()]).where(_any([F.col(k) for k in flags]))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def scanned(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """texts (doc_id, text without nulls, others) with a column s_<kind> of spans for every rule."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for clause in q for need in clause for g in need})
    joined = texts
    if queries:
        keyed = texts.withColumn("t", F.xxhash64("doc_id", "text"))
        joined = keyed.join(candidates(postings(keyed, grams), queries, grams), "t", "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    columns = []
    for r in rules:
        test = F.col(f"may_{r.kind}") if r.kind in queries else F.col("text").rlike(r.pattern)
        columns.append(F.when(F.coalesce(test, F.lit(False)), F.expr(spans_sql(r))).otherwise(none).alias(f"s_{r.kind}"))
    return joined.select(*texts.columns, *columns)


def gathered(rules: list[Rule], only_base: bool = False) -> str:
    """SQL for all spans as one sorted array of start, place, end, kind."""
    parts = [f"transform(s_{r.kind}, s -> struct(s.start as start, {i} as place, s.end as end, '{r.kind}' as kind))" for i, r in enumerate(rules) if r.base or not only_base]
    return f"sort_array(concat({', '.join(parts)}))"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_<base kind>..., base_sha256, spans (kind:start:end, comma-joined)."""
    texts = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    counts = [F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    out = scanned(texts, rules).select("doc_id", *counts, F.expr(gathered(rules, True)).alias("base_found"), F.expr(gathered(rules)).alias("found"))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return out.select("doc_id", *[f"n_{r.kind}" for r in rules if r.base], F.sha2(F.expr(joined.format("base_found")), 256).alias("base_sha256"), F.expr(joined.format("found")).alias("spans"))


def redacted(text: str, found: str, mark: str) -> str:
    """SQL for the text with every stretch of (sorted, possibly overlapping) spans replaced by one mark.

    Spans are taken in blocks, each from the text between the ends of two blocks, so that no step copies the whole.
    """
    blocks = f"transform(sequence(0, (size({found}) - 1) div {BLOCK}), b -> slice({found}, b * {BLOCK} + 1, {BLOCK}))"
    ends = "aggregate(y, array(0), (o, b) -> array_append(o, greatest(element_at(o, -1), array_max(transform(b, s -> s.end)))))"
    piece = f"""aggregate(transform(b, s -> struct(s.start - w.ends[k] as start, s.end - w.ends[k] as end)),
        struct(0 as at, '' as done, substring({text}, w.ends[k] + 1, w.ends[k + 1] - w.ends[k]) as part), (a, s) -> struct(greatest(a.at, s.end) as at,
          if(s.start >= a.at, concat(a.done, substring(a.part, a.at + 1, s.start - a.at), '{mark}'), a.done) as done, a.part as part),
        a -> a.done)"""
    return f"""transform(transform(array({blocks}), y -> struct(y as blocks, {ends} as ends)), w ->
      concat(array_join(transform(w.blocks, (b, k) -> {piece}), ''), substring({text}, element_at(w.ends, -1) + 1)))[0]"""


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, mark: str = "[SECRET]", length_col: str = "n_chars") -> DataFrame:
    """The rows of docs with the secrets in their texts marked out; a column of lengths follows the text."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{text_col}`").isNull().alias("no_text"), others.alias("others"))
    found = scanned(texts, rules).select("*", F.expr(gathered(rules)).alias("found"))
    done = found.select("others", "found", F.when(~F.col("no_text"), F.when(F.size("found") > 0, F.expr(redacted("text", "found", mark))).otherwise(F.col("text"))).alias("text"))
    def column(c: str) -> Column:
        if c == text_col:
            return F.col("text").alias(c)
        own = F.col("others").getField(c)
        if c == length_col:
            own = F.when(F.size("found") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)
    return done.select(*[column(c) for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


QUERIES = {"op7_secret_scan": op7_secret_scan}


def _oracle() -> str:
    """The same rules by plain full scans in DuckDB."""
    parts, spans = [], []
    for r in RULES:
        k, p = r.kind, r.pattern
        parts.append(f"string_split_regex(t, '{p}') as g_{k}, regexp_extract_all(t, '{p}', 0) as f_{k}" + (f", regexp_extract_all(t, '{p}', {r.group}) as v_{k}" if r.group else ""))
        start = f"list_sum(list_transform(g_{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f_{k}[1:i - 1], lambda x: length(x))), 0)"
        kept = f"list_filter(range(1, len(f_{k}) + 1), lambda i: length(v_{k}[i]) >= {r.least_length})" if r.group else f"range(1, len(f_{k}) + 1)"
        spans.append(f"list_transform({kept}, lambda i: struct_pack(s := cast({start} as bigint), p := {RULES.index(r)}, e := cast({start} + length(f_{k}[i]) as bigint), k := '{k}')) as s_{k}")
    text = "coalesce(array_to_string(list_transform(list_sort({}), lambda z: z.k || ':' || z.s || ':' || z.e), ','), '')"
    base = [r.kind for r in RULES if r.base]
    return f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, {", ".join(parts)} from t),
s as (select doc_id, {", ".join(spans)} from m)
select doc_id, {", ".join(f"cast(len(s_{k}) as bigint) as n_{k}" for k in base)},
  sha256({text.format(f"list_concat({', '.join(f's_{k}' for k in base)})")}) as base_sha256,
  {text.format("list_concat(" + ", ".join(f"s_{r.kind}" for r in RULES) + ")")} as spans
from s"""


ORACLE = {"op7_secret_scan": _oracle()}
