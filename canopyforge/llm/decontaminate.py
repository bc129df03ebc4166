"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is `WINDOW` consecutive words of a benchmark item; an item with fewer words is one window. Texts are hashed word
by word and k-gram by k-gram; of each window's k-gram hashes the least is its fingerprint. Two equal windows have equal
fingerprints, so joining fingerprints finds every shared window, and runs of neighbouring windows share one fingerprint, so
that there are far fewer of them than words.

A document's runs are joined with the benchmark's fingerprints by (length, fingerprint). Each run that hits is extended to all
windows that it covers, once for each different run however many documents have it, and those windows are verified by their
exact words. Windows that the same items share have one set of items, by which documents are joined with item ids at last.

Before the join, a bit table made from the benchmark's fingerprints drops most runs where the texts are; it only ever keeps too
many. It has 16 bits a fingerprint up to `MOST_BITS`; what it lets through beyond that the join drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BETWEEN_WORDS, DOCUMENTS_A_PART, a_to_z_lower, cut, in_parts, read

WINDOW, GRAM = 13, 5
#: Bits of the table of fingerprints: 16 for each one, within these bounds (256 KB).
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 21
#: Most bytes of fingerprints, windows or hits that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 16 << 20
_NO_SPANS, _NO_ITEMS = "cast(null as array<struct<at:int,end:int>>) as spans", "cast(null as array<string>) as items"


def raw_words(text: Column) -> Column:
    # regexp_extract_all copies the whole text for each word that it finds; split does not
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS), "")


def _fingerprints(df: DataFrame, n: int) -> DataFrame:
    """Adds prints: of each window of n words its fingerprint. Needs words; the hashes ignore case, which only finds more."""
    k = min(GRAM, n)
    df = df.withColumn("hashes", F.when(F.size("words") >= n, F.transform("words", lambda w: F.xxhash64(F.lower(w)))))
    grams = F.expr(f"transform(sequence(0, size(hashes) - {k}), i -> xxhash64({', '.join(f'get(hashes, i + {j})' for j in range(k))}))")
    df = df.withColumn("grams", F.when(F.size("hashes") >= n, grams))
    if n == k:
        return df.withColumn("prints", F.col("grams"))
    least = ", ".join(f"get(grams, i + {j})" for j in range(n - k + 1))
    return df.withColumn("prints", F.when(F.size("grams") > n - k, F.expr(f"transform(sequence(0, size(grams) - {n - k + 1}), i -> least({least}))")))


def windows_of(benchmark: DataFrame, n: int, whole: bool) -> DataFrame:
    """(length, print, window, item_id) of the windows of n words; whole: of the items that have n words altogether."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", raw_words(F.col("text")).alias("words"))
    items = _fingerprints(items.where(F.size("words") == n if whole else F.size("words") >= n), n)
    # an inner explode would put a filter on prints below, and with it all that makes them, once for each use
    each = items.select("item_id", "words", F.posexplode_outer("prints").alias("at", "print")).where("print is not null")
    text = a_to_z_lower(F.array_join(F.slice("words", F.col("at") + 1, n), " "))
    return each.select(F.lit(n).alias("length"), "print", text.alias("window"), "item_id")


def _small(df: DataFrame, size: str) -> DataFrame:
    """df marked for a broadcast if its rows, of `size` bytes each (SQL), add up to few."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(size))).first()[0] or 0) <= MOST_BROADCAST else df


def _bit_table(prints: DataFrame) -> tuple[int, str]:
    """log2 of the bits, and the table as an SQL array of longs. Its size has a bound; what is collected is at most that table."""
    n = prints.count()
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    shift = bits.bit_length() - 1
    at = F.shiftrightunsigned("print", 64 - shift)
    got = {r.word: r.held for r in prints.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - shift}) & 63 as int))")).alias("held")).collect()}

    # one string, cast when the plan is made: a literal for each word would make large plans
    return shift, f"cast(split('{','.join(str(got.get(i, 0)) for i in range(bits // 64))}', ',') as array<bigint>)"


def _runs(df: DataFrame, n: int, shift: int, table: str) -> DataFrame:
    """Adds runs: the runs of windows with one fingerprint whose bit is set, with the words they cover."""
    df = _fingerprints(df, n).withColumn("starts", F.expr("filter(sequence(0, size(prints) - 1), i -> i = 0 or get(prints, i) <> get(prints, i - 1))"))
    known = f"shiftrightunsigned(get({table}, cast(shiftrightunsigned(get(prints, s), {64 - shift + 6}) as int)), cast(shiftrightunsigned(get(prints, s), {64 - shift}) & 63 as int)) & 1L = 1L"
    # transform with a position needs the run's end, so runs are made first and filtered by bit then
    df = df.withColumn("ends", F.expr(f"transform(starts, (s, k) -> if({known}, coalesce(get(starts, k + 1), size(prints)), -1))"))
    pairs = F.expr("filter(arrays_zip(starts, ends), r -> r.ends > 0)")
    return df.withColumn("runs", F.transform(pairs, lambda r: F.struct(F.get("prints", r.starts).alias("print"), r.starts.alias("at"), (r.ends - r.starts).alias("n"), F.slice("words", r.starts + 1, r.ends - r.starts + n - 1).alias("covers"))))


def digest_of(text: Column) -> Column:
    """What decontaminate() names a text by."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, least_share: float = 0.05) -> DataFrame:
    """For each row of documents (doc_id, text): digest, n_words, n_hit (words within an occurrence of any item's window), items (ids
    of the items with occurring windows, sorted as strings), contaminated (n_hit > 0 and n_hit >= least_share of the words).

    Null and empty texts have no words and aren't contaminated. Rows with one doc_id and one text each get the same result;
    a null doc_id is kept. Benchmark rows without words or without item_id have no windows; repeated item_ids count once. An
    empty benchmark hits nothing. Other columns of either table are not looked at.
    """
    parts, n_docs = 1 / least_share, documents.count()
    sizes = benchmark.where(F.col("item_id").isNotNull()).select(F.size(raw_words(F.col("text"))).alias("words")).where("words > 0")
    sizes = {r.n: r.words for r in sizes.groupBy(F.least("words", F.lit(WINDOW)).alias("n")).agg(F.sum("words").alias("words")).collect()}
    lengths, n_windows = sorted(sizes), sum(sizes.values())  # 13 lengths and a window a word at most
    docs = in_parts(documents, n_docs, DOCUMENTS_A_PART).select("doc_id", digest_of(F.col("text")).alias("digest"), raw_words(F.col("text")).alias("words"))
    columns, wins = [], []
    for n in lengths:
        wins.append(windows_of(benchmark, n, whole=n < WINDOW))
        shift, table = _bit_table(wins[-1].select("print").distinct())
        docs = _runs(docs, n, shift, table).select("doc_id", "digest", "words", *columns, F.col("runs").alias(f"runs{n}"))
        columns.append(f"runs{n}")
    # one row a document that stands for it, and one for each run that may hit: written, as all that follows starts from it
    own = F.array(F.struct(F.lit(0).alias("length"), F.lit(None).cast("long").alias("print"), F.lit(0).alias("at"), F.size("words").alias("n"), F.lit(None).cast("array<string>").alias("covers")))
    held = [F.expr(f"coalesce(transform({c}, r -> named_struct('length', {n}, 'print', r.print, 'at', r.at, 'n', r.n, 'covers', r.covers)), cast(array() as array<struct<length:int,print:bigint,at:int,n:int,covers:array<string>>>))") for c, n in zip(columns, lengths)]
    rows = docs.select("doc_id", "digest", F.explode_outer(F.concat(own, *held)).alias("run")).select("doc_id", "digest", "run.*")
    rows = rows.withColumn("covers", a_to_z_lower(F.array_join("covers", " ")))
    rows = cut(rows.withColumn("run", F.when(F.col("length") > 0, F.md5(F.concat_ws(" ", "length", "n", "covers")))), "text-runs")
    parts_of = rows.where("length = 0").selectExpr("doc_id", "digest", "1L as copies", "n as n_words", _NO_SPANS, _NO_ITEMS)
    if wins:
        known = wins[0]
        for w in wins[1:]:
            known = known.unionByName(w)
        parts_of = parts_of.unionByName(_hits(rows.where("length > 0"), known, n_windows))
    out = parts_of.groupBy("doc_id", "digest").agg(
        F.sum("copies").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["at"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
        lambda a: a["n"],
    )
    out = out.select("doc_id", "digest", F.col("n_words").cast("long"), covered.cast("long").alias("n_hit"), "items", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    out = in_parts(out, n_docs, DOCUMENTS_A_PART)
    return out.select("doc_id", "digest", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (F.lit(round(parts)) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _hits(runs: DataFrame, known: DataFrame, n_windows: int) -> DataFrame:
    """What runs (doc_id, digest, length, print, at, n, covers, run: a digest of the run) hit of the n_windows rows of known (length,
    print, window, item_id), by document."""
    known = known.groupBy("length", "print", "window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    known = cut(known.withColumn("of", F.md5(F.array_join("items", ","))), "windows", n_windows)
    # the join of the fingerprints; a run that many documents have goes on as one
    prints = known.select("length", "print").distinct()
    different = runs.groupBy("run", "length", "print", "n").agg(F.first("covers").alias("covers")).join(_small(prints, "16"), ["length", "print"], "left_semi")
    # a hit is extended to the windows that its run covers
    each = different.select("run", "length", "print", F.split("covers", " ").alias("words"), F.explode(F.expr("sequence(0, n - 1)")).alias("o"))
    each = each.select("run", "length", "print", "o", F.array_join(F.expr("slice(words, o + 1, length)"), " ").alias("window"))
    verified = each.join(_small(known.select("length", "print", "window", "of"), "64 + length(window)"), ["length", "print", "window"])
    verified = cut(verified.groupBy("run").agg(F.collect_set("o").alias("offsets"), F.collect_set("of").alias("sets")), "verified-runs", runs.count())
    found = runs.select("doc_id", "digest", "run", "at", "length").join(_small(verified, "64 + 4 * size(offsets) + 40 * size(sets)"), "run")
    spans = found.select("doc_id", "digest", F.transform("offsets", lambda o: F.struct((F.col("at") + o).alias("at"), (F.col("at") + o + F.col("length")).alias("end"))).alias("spans"))
    items_of = known.select("of", "items").dropDuplicates(["of"])
    items = found.select("doc_id", "digest", F.explode("sets").alias("of")).distinct().join(_small(items_of, "64 + 24 * size(items)"), "of")
    nothing = ["cast(null as bigint) as copies", "cast(null as int) as n_words"]
    return spans.selectExpr("doc_id", "digest", *nothing, "spans", _NO_ITEMS).unionByName(items.selectExpr("doc_id", "digest", *nothing, _NO_SPANS, "items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
with docs as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null),
wins as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct n from wins),
occurrences as (
  select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as t
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
hits as (select rid, i, n, item_id from occurrences join wins using (n, t)),
words as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from hits)) group by rid),
ids as (select rid, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct rid, item_id::varchar as s from hits) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join words using (rid) left join ids using (rid)
"""
