"""Secret scans (operator 6), DataFrame functions only.

Three fixed patterns give the base spans.  A pair of character Markov models,
one of random strings and one of ordinary identifiers, finds further ones: a
run of token characters is a secret if its log-likelihood ratio is high.  The
models are bigram tables trained from labelled samples: strings of the corpus,
and strings that rules make of its words (slugs, dated names, paths, version
and run ids, UUIDs) and of digests (random keys).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm import common

#: The base patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of AKIA[A-Z0-9]+ with 20 and more characters
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so this drops just the shorter ones
KINDS = ("assign", "access", "hex", "markov")
#: What the models look at: runs of token characters outside base spans.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z][A-Za-z_-]{3,}"
#: Characters are the 95 printable ones of ASCII; 0 stands for the rest.
SYMBOLS = 96
#: Elements that a running total looks at together.
BLOCK = 64

SPAN = "array<struct<start: int, kind: int, end: int>>"
FOUND = "array<struct<start: int, kind: int, end: int, s: string>>"


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """both(.. both(v1, v2) .., vk) for each k of an array of integers.

    Totals are made in blocks and then across blocks, as appending to one array
    element by element would take time with the square of its length.
    """

    def scan(array: Column) -> Column:
        def step(acc, v):
            return F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(both(F.get(acc, F.size(acc) - 1), v))))

        return F.aggregate(array, F.array().cast("array<int>"), step)

    def of(v: Column) -> Column:
        last = F.ceil(F.size(v) / BLOCK).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: scan(F.slice(v, i * BLOCK + 1, F.lit(BLOCK))))
        told = lambda inner, ends: F.flatten(F.transform(inner, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: both(F.get(ends, i - 1), x)))))
        across = lambda inner: common.let(scan(F.transform(inner, lambda b: F.get(b, F.size(b) - 1))), lambda ends: told(inner, ends))
        return F.when(F.size(v) <= BLOCK, scan(v)).otherwise(common.let(blocks, across))

    return common.let(values, of)


def pieces(text: Column, pattern: str, group: int | None) -> Column:
    """m (matches), g (what their group holds) and p (the text before, between and behind them)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.struct(found.alias("m"), held.alias("g"), F.split(text, pattern, -1).alias("p"))


def located(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """Spans, and their strings, of the leftmost non-overlapping matches whose group has ``least`` code points.

    SQL gives matches and the pieces between them, not positions: these are
    sums of lengths.
    """

    def spans(x: Column) -> Column:
        ends = running(F.zip_with(x["m"], F.slice(x["p"], F.lit(1), F.size(x["m"])), lambda m, p: F.length(m) + F.length(p)), lambda a, b: a + b)
        marked = F.zip_with(x["m"], x["g"], lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
        placed = F.zip_with(marked, ends, lambda m, e: F.struct((e - F.length(m["m"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m["m"].alias("s"), m["g"].alias("g")))
        kept = F.filter(placed, lambda s: s["g"] >= least)
        return F.transform(kept, lambda s: F.struct(s["start"], s["kind"], s["end"], s["s"])).cast(FOUND)

    return F.when(text.rlike(pattern), common.let(pieces(text, pattern, group), spans)).otherwise(F.array().cast(FOUND))


def masked(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """The text with blanks in place of those matches; its length stays."""

    def blank(x: Column) -> Column:
        cut = F.zip_with(x["m"], x["g"], lambda m, g: F.when(F.length(g) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
        return F.array_join(F.zip_with(x["p"], cut, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return F.when(text.rlike(pattern), common.let(pieces(text, pattern, group), blank)).otherwise(text)


def symbol(c: Column) -> Column:
    return F.when(F.ascii(c).between(32, 126), F.ascii(c) - 31).otherwise(0)


def bigrams(s: Column) -> Column:
    """Codes prev * 96 + next of neighbouring characters."""
    of = lambda codes: F.transform(F.sequence(F.lit(0), F.greatest(F.size(codes) - 2, F.lit(0))), lambda i: F.get(codes, i) * SYMBOLS + F.get(codes, i + 1))
    return common.let(F.transform(F.split(s, ""), symbol), of)


def train(labelled: DataFrame, smoothing: float = 0.5, backoff: float = 64.0, mass: float = 50_000.0) -> list[float]:
    """Log-likelihood ratios random : ordinary of all bigrams, from rows (s string, secret boolean, kind string).

    All kinds of a class weigh the same, however many strings they have (there
    must be few kinds).  A character's followers are backed off to the model's
    characters at large.  Collected are at most 96 * 96 counts a kind.  Null and
    one-character strings tell nothing; without any rows all ratios are 0.
    """
    pairs = labelled.filter("length(s) >= 2 AND secret IS NOT NULL").select("secret", "kind", F.explode(bigrams(F.col("s"))).alias("g"))
    by: dict[tuple, dict[int, int]] = {}
    for r in pairs.filter("g IS NOT NULL").groupBy("secret", "kind", "g").count().collect():
        by.setdefault((r.secret, r.kind), {})[r.g] = r["count"]
    counts = {True: [0.0] * SYMBOLS**2, False: [0.0] * SYMBOLS**2}
    for (secret, _), found in sorted(by.items(), key=str):
        share = mass / sum(found.values())
        for g, n in found.items():
            counts[secret][g] += n * share

    def chances(n: list[float]) -> list[float]:
        alone = [sum(n[j::SYMBOLS]) + smoothing for j in range(SYMBOLS)]
        total = sum(alone)
        rows = [sum(n[i * SYMBOLS : (i + 1) * SYMBOLS]) + backoff for i in range(SYMBOLS)]
        return [(n[i * SYMBOLS + j] + backoff * alone[j] / total) / rows[i] for i in range(SYMBOLS) for j in range(SYMBOLS)]

    return [math.log(a / b) for a, b in zip(chances(counts[True]), chances(counts[False]), strict=True)]


def llr(s: Column, model: list[float]) -> Column:
    """Sum of the ratios of a string's bigrams."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    return F.aggregate(bigrams(s), F.lit(0.0), lambda acc, g: acc + F.coalesce(F.get(ratios, g), F.lit(0.0)))


def named(words: Column, digest: Column) -> Column:
    """Ordinary identifiers made of three words and the hex digits of a digest."""
    w = [F.lower(F.get(words, F.lit(i))) for i in range(3)]
    number = lambda at, size, most: F.pmod(F.conv(F.substring(digest, at, size), 16, 10).cast("long"), F.lit(most)).cast("string")
    two = lambda at, most: F.lpad((number(at, 3, most).cast("int") + 1).cast("string"), 2, "0")
    year, month, day, n = F.concat(F.lit("20"), two(1, 30)), two(4, 12), two(7, 28), number(10, 2, 20)
    title = F.concat_ws("", w[0], F.initcap(w[1]), F.initcap(w[2]))
    return F.array(
        F.concat_ws("-", *w, F.concat(F.lit("v"), n)), F.concat_ws("_", w[0], w[1], year, month, day, w[2]), F.concat_ws("-", w[0], year, month, day, w[1], w[2]),
        F.concat_ws("/", F.lit(""), w[0], year, month, day, F.concat_ws("-", w[1], w[2], n)), F.concat(title, n), F.upper(F.concat_ws("_", *w)), F.concat_ws("/", *w),
        F.concat_ws("-", w[0], F.concat(year, month, day, F.lit("T"), two(12, 23), two(15, 59), two(18, 59), F.lit("Z")), n), F.concat_ws("-", w[0], number(20, 1, 9), n, number(21, 2, 100), w[1]),
    )


def labelled_sample(docs: DataFrame, rows: int, made: int = 3000) -> DataFrame:
    """(s, secret, kind) from ``rows`` documents with the least hashes, and ``made`` strings of each rule."""
    marked = docs.select("text", F.xxhash64("doc_id", "text").alias("o"))
    # hashes alone are ordered; of equal rows one is taken
    least = F.broadcast(marked.select("o").distinct().orderBy("o").limit(rows))
    part = common.stash(marked.join(least, "o", "left_semi").dropDuplicates(["o"]), "sample")
    held = lambda p, g: F.filter(F.regexp_extract_all("text", F.lit(p), F.lit(g)), lambda s: (F.length(s) >= 16) & ~s.rlike("^[0-9a-f]+$"))
    row = lambda df, s, secret, kind: df.select(F.explode(s).alias("s"), F.lit(secret).alias("secret"), F.lit(kind).alias("kind"))
    seen = row(part, F.concat(held(ASSIGN, 2), held(ACCESS, 0)), True, "seen")
    # words outside base spans, and what rules make of three of them
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = part.select("o", F.regexp_extract_all(bare, F.lit(WORD), F.lit(0)).alias("words"))
    prose = row(plain, F.filter("words", lambda w: F.length(w) >= 8), False, "prose")
    some = F.transform(F.sequence(F.lit(0), F.least(F.floor(F.size("words") / 3), F.lit(8)).cast("int") - 1), lambda i: F.struct(F.slice("words", i * 3 + 1, F.lit(3)).alias("w"), F.md5(F.concat_ws("|", F.col("o").cast("string"), i.cast("string"))).alias("d")))
    names = plain.filter("size(words) >= 3").select(F.explode(some).alias("x")).select(F.col("x.w").alias("w"), F.col("x.d").alias("d"))
    names = row(names, named(F.col("w"), F.col("d")), False, "names")
    digests = docs.sparkSession.range(made).select(F.sha2(F.concat(F.lit("d"), F.col("id").cast("string")).cast("binary"), 512).alias("d"))
    uuid = F.regexp_replace(F.substring("d", 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    key = F.base64(F.unhex("d"))
    letters = lambda pattern: F.regexp_replace(key, pattern, "")
    random = F.array(key, F.translate(key, "+/=", "-_"), letters("[^A-Za-z0-9]"), letters("[^A-Z0-9]"), letters("[^A-Za-z]"))
    lower = F.array(F.lower(letters("[^A-Za-z]")), F.lower(letters("[^A-Za-z0-9]")))
    upper = F.array(F.upper(letters("[^A-Za-z]")), F.upper(letters("[^A-Za-z0-9]")))
    out = seen.unionByName(prose).unionByName(names)
    for strings, secret, kind in ((F.array(uuid), False, "uuid"), (random, True, "keys"), (lower, True, "lower"), (upper, True, "upper")):
        out = out.unionByName(row(digests, strings, secret, kind))
    return out


def secret_spans(df: DataFrame, sample_rows: int = 4000, margin: float = 12.0, rate: float = 0.4) -> DataFrame:
    """The input with ``spans``: all secret spans of ``text``, by start, then kind, in code points.

    Base spans stay as they are; the models add runs of 16 and more token
    characters outside them (what stands left or right of a base span is a run
    of its own).  A run is random if its ratio exceeds margin, and rate for each
    character, in nats.  sample_rows bounds the documents that the models are
    trained on.

    Null text has no spans, and neither has an empty one.  Rows are looked at one
    by one: repeated rows, null ids and further columns make no difference; a
    column ``spans`` is replaced.  Time grows with a text's length, and only
    slightly faster with its number of spans.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    model = train(labelled_sample(docs, sample_rows))
    text = common.text_of()
    base = F.concat(located(text, ASSIGN, 0, 2, 6), located(text, ACCESS, 1), located(text, HEX, 2))
    blanked = masked(masked(masked(text, ASSIGN, 2, 6), ACCESS), HEX)
    random = lambda s: llr(s["s"], model) > F.greatest(F.lit(margin), rate * F.length(s["s"]))
    more = lambda t: F.filter(located(t, CANDIDATE, 3), random)
    runs = lambda b: F.when(F.size(b) > 0, common.let(blanked, more)).otherwise(more(text))
    both = common.let(base, lambda b: F.concat(b, runs(b)))
    return df.withColumn("spans", F.sort_array(F.transform(both, lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(SPAN)))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """The input with each stretch of secret spans in ``text`` replaced by ``mark``; texts without one (and null) stay.

    Of overlapping spans one mark is left; spans that adjoin give one each.
    """
    marked = secret_spans(df, **options)
    spans = F.col("spans")

    def done(chars: Column, ends: Column) -> Column:
        join = lambda first, size: F.array_join(F.slice(chars, first + 1, size), "")

        def piece(s: Column, i: Column) -> Column:
            at = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            return F.when(s["start"] >= at, F.concat(join(at, s["start"] - at), F.lit(mark))).otherwise("")

        last = F.get(ends, F.size(ends) - 1)
        return F.concat(F.array_join(F.transform(spans, piece), ""), join(last, F.greatest(F.size(chars) - last, F.lit(0))))

    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    clean = common.let(F.split("text", ""), lambda chars: common.let(ends, lambda e: done(chars, e)))
    return marked.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = (count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3]))
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
