"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query of trigrams that every match must contain. The index has a posting
(trigram, text) for each trigram that some rule asks for; postings of a text meet in one group, which intersects them for all rules
at once, and only the texts left over are read again to verify their rules. Rules without mandatory trigrams scan
all texts. Copies of one text are one entry of the index. The index is over lower-cased texts, so that one trigram serves both
cases; it only ever finds too many.
"""

from __future__ import annotations

import re._constants as K
import re._parser as P
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and what length a group of a match must have. What every match must have goes into
    the expression, as in `{16,}`, where that can't move a match; else it is checked after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# What the kinds of secrets look like.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE
#: Most strings that a part of an expression is spelled out to, and most candidates that are broadcast.
MOST_STRINGS, MOST_BROADCAST = 64, 500_000
MARK, OTHER = "\u0001", "\u0002"
#: Parts of a text that are added up at once: an even number.
AT_ONCE = 512

# A query is True (any text), a trigram, or ("and" | "or", frozenset of queries).


def _join(kind: str, parts) -> object:
    """The conjunction or disjunction of queries, without needless nesting."""
    flat: set = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if kind == "and":
        flat.discard(True)
        return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))
    if True in flat or not flat:
        return True
    sets = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in flat}
    flat = {p for p in flat if not any(sets[q] < sets[p] for q in flat)}  # what a weaker part covers
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of_strings(strings: set[str]) -> object:
    """What a text that has one of the strings must contain."""
    return _join("or", [_join("and", {s[i : i + 3] for i in range(len(s) - 2)}) if len(s) > 2 else True for s in strings])


def _strings(node) -> set[str] | None:
    """All lower-cased strings that a part matches, if they are few."""
    op, value = node
    if op is K.LITERAL:
        return {chr(value).lower()}
    if op is K.IN:
        out: set[str] = set()
        for kind, v in value:
            if kind is K.LITERAL:
                out.add(chr(v).lower())
            elif kind is K.RANGE and v[1] - v[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is K.SUBPATTERN:
        return _sequence_strings(value[3])
    if op is K.BRANCH:
        parts = [_sequence_strings(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, what = value
        inner = _sequence_strings(what)
        if inner is None or high > 3:
            return None
        out, made = ({""} if low == 0 else set()), {""}
        for n in range(1, high + 1):
            made = {a + b for a in made for b in inner}
            if len(made) > MOST_STRINGS:
                return None
            out |= made if n >= low else set()
        return out
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(found) * len(out) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _query(nodes) -> object:
    parts, run = [], {""}
    for node in nodes:
        found = _strings(node)
        if found is not None and len(found) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in found}
            continue
        parts.append(_of_strings(run))
        run = found if found is not None else {""}
        op, value = node
        if found is None and op is K.SUBPATTERN:
            parts.append(_query(value[3]))
        elif found is None and op is K.BRANCH:
            parts.append(_join("or", [_query(p) for p in value[1]]))
        elif found is None and op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] > 0:
            parts.append(_query(value[2]))
    return _join("and", [*parts, _of_strings(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean query of lower-cased trigrams that every text with a match of pattern satisfies."""
    return _query(P.parse(pattern))


def trigrams(query: object) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams, query[1]))


def _holds(query: object, have: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(have, query)
    out = None
    for part in sorted(query[1], key=repr):
        c = _holds(part, have)
        out = c if out is None else out & c if query[0] == "and" else out | c
    return out


def postings(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, digest) for each wanted trigram that a text of (digest, text) has, in either case."""
    low = texts.select("digest", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in wanted]))
    return low.select("digest", has.alias("has")).select("digest", F.explode_outer("has").alias("trigram")).where("trigram is not null")


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(digest, kinds): the rules whose query a text's postings satisfy."""
    have = index.groupBy("digest").agg(F.collect_set("trigram").alias("have"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("have")), F.lit(k)) for k, q in queries.items()]))
    return have.select("digest", kinds.alias("kinds")).where(F.size("kinds") > 0)


_SPAN = "struct<start:int,order:int,kind:string,end:int>"


def _parts(text: Column, rule: Rule) -> Column:
    """A text without marks, cut at a rule's matches: every second part is one."""
    return F.split(F.regexp_replace(text, rule.pattern, f"{MARK}$0{MARK}"), MARK)


def _spans(parts: Column, order: int, rule: Rule) -> Column:
    """Spans of a rule's matches: lengths of parts add up to places. They are added up `AT_ONCE` at a time, so that a text of
    very many matches copies no long arrays over and over."""

    def add(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        good = F.length(F.regexp_extract(part, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        span = F.array(F.struct(state["at"].alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), (~state["match"]).alias("match"), F.when(state["match"] & good, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    def add_some(state: Column, first: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.lit(False).alias("match"), F.array().cast(f"array<{_SPAN}>").alias("found"))
        return F.aggregate(F.slice(parts, first, AT_ONCE), start, add, lambda s: F.struct(s["at"].alias("at"), F.concat(state["found"], F.array(s["found"])).alias("found")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("found"))
    return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(parts), F.lit(AT_ONCE)), start, add_some, lambda s: s["found"]))


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of each row of documents (doc_id, text); spans: array of (start, order, kind, end) in order of start, then of
    the rules; code points, end exclusive. A rule's spans are its leftmost, non-overlapping matches, without those too short.

    Null and empty texts have no spans. Repeated rows each get their row, and a null doc_id is kept. Other columns are not looked at.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.md5("text").alias("digest"))
    if indexed:
        wanted = sorted(set().union(*map(trigrams, indexed.values())))
        found = cut(candidates(postings(docs.select("digest", "text"), wanted), indexed), "secret-candidates")
        found = found.withColumnRenamed("digest", "of")
        small = found.count() <= MOST_BROADCAST
        docs = docs.join(F.broadcast(found) if small else found, F.col("digest") == F.col("of"), "left")
    else:
        docs = docs.withColumn("kinds", F.array().cast("array<string>"))
    docs = docs.select("doc_id", "kinds", F.replace("text", F.lit(MARK), F.lit(OTHER)).alias("text"))
    # parts are columns of their own, so that they are made once for each text and rule
    docs = docs.select("doc_id", *[(F.when(F.array_contains("kinds", r.kind), _parts(F.col("text"), r)) if r.kind in indexed else _parts(F.col("text"), r)).alias(f"parts{i}") for i, r in enumerate(rules)])
    none = F.array().cast(f"array<{_SPAN}>")
    spans = [F.coalesce(F.when(F.size(f"parts{i}") > 1, _spans(F.col(f"parts{i}"), i, r)), none) for i, r in enumerate(rules)]
    return docs.select("doc_id", F.sort_array(F.concat(*spans)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = find_secrets(read(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    kinds = " union all ".join(
        "select rid, {i} as o, '{k}' as kind, unnest(range(1, len(m) + 1)) as i, m, p, unnest(m) as hit, {g} as least from ("
        "select rid, regexp_extract_all(text, '{p}') as m, string_split_regex(text, '{p}') as p from docs)".format(i=i, k=r.kind, p=r.pattern.replace("'", "''"), g=r.least)
        for i, r in enumerate(RULES)
    )
    group = BASE[0].pattern.replace("'", "''")
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
hits as ({kinds}),
spans as (
  select rid, o, kind, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint as s, length(hit) as n
  from hits where least = 0 or length(regexp_extract(hit, '{group}', 2)) >= least),
named as (select rid, o, kind, s, kind || ':' || s || ':' || (s + n) as t from spans),
grouped as (
  select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         coalesce(string_agg(t, ',' order by s, o) filter (o < {len(BASE)}), '') as base, string_agg(t, ',' order by s, o) as spans
  from named group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join grouped using (rid)
"""


SQL = _sql()
