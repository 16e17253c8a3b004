"""Benchmark decontamination by templates (operator 4), DataFrame functions only.

Words become typed placeholders: numbers, units after numbers, and names
(capitalised words).  A window of five words is hashed twice, with names as
placeholders and with names as words, so that neither a question with other
names nor one in other capitals is missed; line breaks and blanks play no part.

1. Of each benchmark item the windows that fewest items share are its anchors:
   so many that whoever holds ``threshold`` of its windows holds one of them.
   The documents' window hashes are joined with the anchors' hashes alone.
2. Texts that hold an anchor meet all windows of that item.  Windows count
   where they lie together, on diagonals (place in the document less place in
   the item) that differ by about the item's length at most, and where slots are
   consistent: each value of the item stands for one value of the document, the
   one that most of its windows have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenfit.llm import common

TOKEN = r"\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*|[%$€£°]"
#: Units that may follow a number.
UNITS = ["%", "$", "€", "£", "°", "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "a", "k", "c", "f", "mph", "kmh", "ft", "in", "lb", "oz", "mb", "gb", "tb", "inches", "feet", "miles", "meters", "metres", "kilometers", "kilometres", "grams", "kilograms", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "pounds", "percent", "degrees"]
WIDTH, PLAIN = 5, 3
#: Marks of placeholders are odd, hashes of words are even.
NUMBER, UNIT, NAME = 1, 3, 5
#: Bits of the filter for window hashes before a shuffle.
BITS = 1 << 22


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def marks(ws: Column) -> Column:
    """An even hash for each word, or the mark of a number or unit."""
    # ascii() tells the common cases apart without a regular expression
    number = lambda w: F.ascii(w).between(48, 57) | ((F.ascii(w) > 127) & w.rlike(r"^\p{N}"))
    unit = lambda w, i: (i > 0) & (F.length(w) < 11) & number(F.get(ws, i - 1)) & F.lower(w).isin(UNITS)
    one = lambda w, i: F.when(number(w), F.lit(NUMBER)).when(unit(w, i), F.lit(UNIT)).otherwise(F.shiftleft(F.xxhash64(F.lower(w)), 1))
    return F.transform(ws, one)


def named(ws: Column, plain: Column) -> Column:
    """The marks with capitalised words of two letters and more as names."""
    upper = lambda w: (F.length(w) > 1) & (F.ascii(w).between(65, 90) | ((F.ascii(w) > 127) & w.rlike(r"^\p{Lu}")))
    return F.zip_with(ws, plain, lambda w, m: F.when((m % 2 == 0) & upper(w), F.lit(NAME)).otherwise(m))


def templates(text: Column, search) -> Column:
    """search(words, marks, marks with names) of a text, each array computed once; null under five words."""
    inner = lambda ws: common.let(marks(ws), lambda p: common.let(named(ws, p), lambda n: search(ws, p, n)))
    return common.let(words(text), lambda ws: F.when(F.size(ws) >= WIDTH, inner(ws)))


def slots(held: list[Column]) -> Column:
    return sum((h % 2 != 0).cast("int") for h in held[1:]) + (held[0] % 2 != 0).cast("int")


def window_hashes(docs: DataFrame, key: list[str]) -> DataFrame:
    """key, h of each window of ``text`` that has at least PLAIN words; a window without names once, others twice."""
    cut = lambda a, k: F.slice(a, F.lit(k + 1), F.size(a) - (WIDTH - 1))
    zipped = lambda ws, p, n: F.arrays_zip(*(cut(a, k) for a in (p, n) for k in range(WIDTH)))
    rows = docs.select(*key, F.explode(templates(F.col("text"), zipped)).alias("w"))
    plain, other = ([F.col("w")[str(k + at)] for k in range(WIDTH)] for at in (0, WIDTH))
    fits = lambda held: F.when(slots(held) <= WIDTH - PLAIN, F.xxhash64(*held))
    rows = rows.select(*key, fits(plain).alias("p"), fits(other).alias("n"))
    # one pass: the second hash only where it is another one
    return rows.filter("p IS NOT NULL").select(*key, F.explode(F.when(F.col("n").isNull() | (F.col("n") == F.col("p")), F.array("p")).otherwise(F.array("p", "n"))).alias("h"))


def windows(ws: Column, p: Column, n: Column) -> Column:
    """(at, h, slots) of each window and way to hash it; slots are the values behind its placeholders."""

    def window(marks_: Column, with_name: bool):
        def one(i: Column) -> Column:
            held = [F.get(marks_, i + k) for k in range(WIDTH)]
            values = F.array(*(F.when(held[k] % 2 != 0, F.lower(F.get(ws, i + k))) for k in range(WIDTH)))
            told = slots(held) <= WIDTH - PLAIN
            if with_name:
                told = told & F.array_contains(F.array(*held), F.lit(NAME).cast("long"))
            return F.when(told, F.struct(i.alias("at"), F.xxhash64(*held).alias("h"), F.filter(values, lambda v: v.isNotNull()).alias("slots")))

        return F.transform(F.sequence(F.lit(0), F.size(ws) - WIDTH), one)

    return F.filter(F.concat(window(p, False), window(n, True)), lambda w: w.isNotNull())


ITEM = ["item_id", "ih"]
DOC = ["doc_id", "h1", "h2"]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, ih (hash of the text), q, h, item_slots, n (places with a window) of each window of each item."""
    text = common.text_of()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("ih"), text.alias("text")).distinct()
    rows = items.select(*ITEM, F.explode(templates(F.col("text"), windows)).alias("w"))
    rows = rows.select(*ITEM, F.col("w.at").alias("q"), F.col("w.h").alias("h"), F.col("w.slots").alias("item_slots"))
    sizes = rows.groupBy(*ITEM).agg(F.count_distinct("q").alias("n"))
    return same(rows, sizes, ITEM)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys in which null equals null."""
    named_ = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named_, on, how).drop(*(f"_{k}" for k in keys))


def anchors(items: DataFrame, threshold: float) -> DataFrame:
    """item_id, ih, h of the windows that fewest items share, at so many places that no text with ``threshold`` of all lacks them."""
    shared = items.groupBy("h").agg(F.count_distinct(*(F.coalesce(k, F.lit(-1)) for k in ITEM)).alias("items"))
    by_place = items.join(shared, "h").groupBy(*ITEM, "q").agg(F.max("items").alias("items"), F.max("n").alias("n"))
    order = W.partitionBy(*ITEM).orderBy("items", "q")  # an item's windows
    need = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    chosen = by_place.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= need)
    return same(items.select(*ITEM, "q", "h"), chosen.select(*ITEM, "q"), [*ITEM, "q"], "left_semi").select(*ITEM, "h").distinct()


def may_be_in(hashes: DataFrame, h: Column) -> Column:
    """Whether a hash may be one of a table's: a filter of BITS bits, whatever the table's size."""
    bit = F.pmod(F.col("h"), F.lit(BITS))
    held = hashes.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("x"))
    longs = [0] * (BITS // 64)
    for r in held.collect():  # BITS / 64 rows at most
        longs[r["at"]] = r["x"]
    known = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")
    b = F.pmod(h, F.lit(BITS))
    return F.call_function("shiftright", F.get(known, F.shiftright(b, 6).cast("int")), (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def contaminated(df: DataFrame, benchmark: DataFrame, threshold: float = 0.8, most_broadcast: int = 200_000) -> DataFrame:
    """One row for each text and benchmark item of whose windows the text holds at least ``threshold``, together and consistently.

    doc_id, h1, h2 (two hashes of the text), item_id, n_windows, n_matched
    (different places of the item), containment, n_slots (values of the item
    that stand for a value there).

    What is broadcast (the anchors, the items' windows, the keys of texts with
    an anchor) is counted first; beyond most_broadcast rows it is shuffled, and
    the documents' hashes pass a filter of fixed size before.

    Null and empty texts, texts and items of fewer than five words, and windows
    of mostly placeholders match nothing.  Rows of ``df`` with one doc_id (or
    none) are judged text by text, and repeated rows give one row; so do
    benchmark rows: items with one item_id (or none) and other texts are items of
    their own.  Further columns are not read.  Empty tables give no rows.
    """
    items = common.stash(item_windows(benchmark), "templates")
    few = lambda table: F.broadcast(table) if table.count() <= most_broadcast else table
    wanted = common.stash(anchors(items, threshold), "anchors")
    text = common.text_of()
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    found = window_hashes(docs, DOC)
    if wanted.count() > most_broadcast:
        found = found.filter(may_be_in(wanted, F.col("h")))
    pairs = common.stash(found.join(few(wanted), "h").select(*DOC, *ITEM).distinct(), "pairs")

    holders = few(common.stash(pairs.select(*DOC).distinct(), "holders"))
    spans = same(docs, holders, DOC, "left_semi").dropDuplicates(DOC).select(*DOC, F.explode(templates(F.col("text"), windows)).alias("w"))
    hits = spans.select(*DOC, F.col("w.at").alias("at"), F.col("w.h").alias("h"), F.col("w.slots").alias("slots")).join(few(items), "h")
    hits = same(hits, pairs, [*DOC, *ITEM], "left_semi")
    # a passage lies in one bin of one of two rows of bins, which are twice as long as the item and overlap by half
    shift, n = F.col("at") - F.col("q"), F.col("n")
    bins = F.array(F.struct(F.lit(0).alias("row"), F.floor(shift / (2 * n)).alias("bin")), F.struct(F.lit(1).alias("row"), F.floor((shift + n) / (2 * n)).alias("bin")))
    zipped = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    hits = hits.select(*DOC, *ITEM, "q", "n", zipped.alias("pairs"), F.explode(bins).alias("b")).select(*DOC, *ITEM, "b.*", "q", "n", "pairs")
    hits = common.stash(hits, "hits")

    group = [*DOC, *ITEM, "row", "bin"]
    votes = hits.select(*group, F.explode("pairs").alias("p")).groupBy(*group, F.col("p.i").alias("i"), F.col("p.d").alias("d")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*group, "i").agg(F.max(F.struct("votes", "d"))["d"].alias("d"))
    chosen = best.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("i", "d"))).alias("values"))  # an item's values
    agreed = same(hits, chosen, group, "left").filter(F.forall("pairs", lambda p: F.col("values")[p["i"]] == p["d"]))
    out = agreed.groupBy(*group).agg(F.max("n").alias("n_windows"), F.count_distinct("q").alias("n_matched"), F.max(F.coalesce(F.size("values"), F.lit(0))).cast("long").alias("n_slots"))
    most = out.groupBy(*DOC, *ITEM).agg(F.max(F.struct("n_matched", "n_slots", "n_windows")).alias("x")).select(*DOC, "item_id", "x.*")
    most = most.withColumn("containment", F.col("n_matched") / F.col("n_windows"))
    return most.filter(F.col("containment") >= threshold)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "containment", "n_slots")


#: For DuckDB: all windows meet all windows, by their words; unlike above, nothing is hashed and no anchors are chosen.
SQL = r"""
WITH src AS (SELECT 0 AS side, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(t, '@TOKEN') AS ws FROM src),
p AS (SELECT side, id, ws, list_transform(ws, lambda x, i: CASE WHEN regexp_matches(x, '^\p{N}') THEN '#num' WHEN i > 1 AND regexp_matches(ws[i - 1], '^\p{N}') AND lower(x) IN (@UNITS) THEN '#unit' ELSE lower(x) END) AS p FROM w WHERE len(ws) >= 5),
n AS (SELECT *, list_transform(ws, lambda x, i: CASE WHEN p[i][1] <> '#' AND length(x) > 1 AND regexp_matches(x, '^\p{Lu}') THEN '#name' ELSE p[i] END) AS n FROM p),
each_ AS (SELECT side, id, ws, p, n, unnest(range(len(ws) - 4)) AS pos FROM n),
win AS (SELECT side, id, pos, list_transform(ws[pos + 1 : pos + 5], lambda x: lower(x)) AS ws, p[pos + 1 : pos + 5] AS k FROM each_ UNION SELECT side, id, pos, list_transform(ws[pos + 1 : pos + 5], lambda x: lower(x)), n[pos + 1 : pos + 5] FROM each_),
good AS (SELECT side, id, pos, array_to_string(k, ' ') AS k, list_filter(ws, lambda x, i: k[i][1] = '#') AS slots FROM win WHERE len(list_filter(k, lambda x: x[1] = '#')) <= 2),
sizes AS (SELECT id, count(DISTINCT pos) AS n FROM good WHERE side = 1 GROUP BY id),
hit AS (SELECT d.id AS doc_id, i.id AS item_id, i.pos AS q, s.n, d.pos - i.pos AS shift, i.slots AS si, d.slots AS sd FROM good d JOIN good i ON d.side = 0 AND i.side = 1 AND d.k = i.k JOIN sizes s ON s.id = i.id),
b AS (SELECT *, 0 AS tiling, floor(shift / (2 * n)) AS bin FROM hit UNION ALL SELECT *, 1, floor((shift + n) / (2 * n)) FROM hit),
v AS (SELECT doc_id, item_id, tiling, bin, i, d, count(*) AS votes FROM (SELECT doc_id, item_id, tiling, bin, unnest(si) AS i, unnest(sd) AS d FROM b) GROUP BY ALL),
best AS (SELECT doc_id, item_id, tiling, bin, i, d FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, tiling, bin, i ORDER BY votes DESC, d DESC) = 1),
vals AS (SELECT doc_id, item_id, tiling, bin, map(list(i), list(d)) AS m, count(*) AS n_slots FROM best GROUP BY ALL),
ok AS (SELECT b.*, coalesce(n_slots, 0) AS n_slots FROM b LEFT JOIN vals USING (doc_id, item_id, tiling, bin) WHERE len(list_filter(si, lambda x, k: m[x] <> sd[k])) = 0),
bins AS (SELECT doc_id, item_id, tiling, bin, max(n) AS n_windows, count(DISTINCT q) AS n_matched, max(n_slots) AS n_slots FROM ok GROUP BY ALL),
most AS (SELECT doc_id, item_id, n_windows, n_matched, n_slots FROM bins QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, n_slots DESC) = 1)
SELECT doc_id, item_id, n_windows, n_matched, n_matched / n_windows AS containment, n_slots FROM most WHERE n_matched / n_windows >= 0.8
""".replace("@TOKEN", TOKEN).replace("@UNITS", ", ".join(f"'{u}'" for u in UNITS))
