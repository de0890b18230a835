"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A paragraph is a stretch of text up to a line or sentence end. One of more than 160 characters is cut where its own letters say so (at
blanks between a vowel and one of a to h; where there are none, after 400), so an insertion moves no other cuts. All distinct ones of a
document are sketched, whatever their number; the cells needed depend on the difference of two texts, not on their
length. A digest goes to one cell of each of three subtables; a cell holds the count, the XOR of digests and the XOR of their checksums. Subtracting
two sketches cancels what both texts have; peeling cells that hold a single digest recovers the
others. The first try is on the returned fingerprints. Where it stalls, the counts of its cells tell about how much the texts differ (their
squares add up to that, as digests fall into cells at random), and a second try has as many cells as that takes, for each pair its own number; both are
within rows, so no digests are written. Few pairs stall again: they are tried with sketches GROWTH times as large, and so on until
all are peeled. Likeness is the share of common digests in all, from the digests recovered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, row_key, table

_END, _IN = r"[\n.!?|]", r"[^\n.!?|]"
PARAGRAPH = rf"{_IN}{{1,160}}+{_END}++|{_IN}{{1,400}}?(?<=[aeiou]) (?=[a-h])|{_IN}{{1,400}}+{_END}*+|{_END}++"
#: Cells of a subtable in a fingerprint, and how much larger sketches are at each retry.
SIZE, GROWTH = 8, 3
#: Cells of a subtable for each digest that is expected to differ (three times as many in all peel with near certainty), and besides.
SHARE, BESIDES = 0.6, 3
#: What an estimate of the difference is multiplied by; its standard deviation is about 0.3 of it.
MARGIN = 1.3
#: Ids in a stretch of the global order that one task sorts, and the most stretches by id.
STRETCH, STRETCHES = 2000, 1000


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _place(key: Column, j: int, size: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 21 * j), F.lit(size)).cast("int")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _cell(n: Column, key: Column, checksum: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.alias("key"), checksum.alias("sum"))


def _shape(size: Column) -> Column:
    """size, about its root `low`, and `high` such that high * low is size: rounded up."""
    low = F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("int")
    return _let(F.struct(low.alias("low"), F.ceil(size / low).cast("int").alias("high")), lambda x: F.struct((x["low"] * x["high"]).alias("size"), x["low"].alias("low"), x["high"].alias("high")))


def _placed(keys: Column, signs: Callable[[Column], Column], key: Callable[[Column], Column], size: int | Column) -> Column:
    """keys with the place of each in the three subtables; size: their cells, or a shape."""
    if isinstance(size, int):
        places = lambda x: [_place(key(x), j, size).alias(f"p{j}") for j in range(3)]
    else:
        at = lambda x, j: F.pmod(F.shiftrightunsigned(key(x), 21 * j), size["size"]).cast("int")
        places = lambda x: [y for j in range(3) for y in (F.floor(at(x, j) / size["low"]).cast("int").alias(f"h{j}"), (at(x, j) % size["low"]).alias(f"p{j}"))]
    return F.transform(keys, lambda x: F.struct(*places(x), signs(x).cast("int").alias("n"), key(x).alias("key"), F.hash(key(x)).alias("sum")))


def _summed(placed: Column, size: int | Column, start: Callable[[Column], Column], sign: int) -> Column:
    """The cells: each starts as start(its number), and has the entries placed there added (sign 1) or removed (-1). In a shape entries go to
    the `high` stretches of cells first, so each is looked at high + low times and not once for every cell."""
    one = lambda entries, j, c, at: F.aggregate(F.filter(entries, lambda x: x[f"p{j}"] == c), start(at), lambda s, x: _cell(s["n"] + sign * x["n"], s["key"].bitwiseXOR(x["key"]), s["sum"].bitwiseXOR(x["sum"])))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)

    def subtable(j: int) -> Column:
        if isinstance(size, int):
            return F.transform(numbers(F.lit(size)), lambda c: one(placed, j, c, c + j * size))
        stretch = lambda h: _let(F.filter(placed, lambda x: x[f"h{j}"] == h), lambda entries: F.transform(numbers(size["low"]), lambda c: one(entries, j, c, c + h * size["low"] + j * size["size"])))
        return F.flatten(F.transform(numbers(size["high"]), stretch))

    return F.concat(*[subtable(j) for j in range(3)])


def sketch(d: Column, size: int = SIZE) -> Column:
    """The cells of distinct digests d."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0))
    return _let(_placed(d, lambda x: F.lit(1), lambda x: x, size), lambda placed: _summed(placed, size, lambda c: empty, 1))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["sum"].bitwiseXOR(y["sum"])))


def _rounds(size: int | Column) -> Column:
    """Rounds of peeling: below the load at which sketches peel at all, some more than twice the logarithm are enough; one that isn't done
    then counts as stalled."""
    return F.lit(16 + 2 * size.bit_length()) if isinstance(size, int) else F.lit(18) + 2 * F.ceil(F.log2(size["size"])).cast("int")


def peel(cells: Column, size: int | Column) -> Column:
    """(ok, found): whether all was recovered, and the digests with n 1 for the first text's and -1 for the second's."""
    none = F.array().cast("array<struct<key:bigint,n:int>>")

    def step(s: Column, _: Column) -> Column:
        single = F.filter(s["cells"], lambda x: (F.abs(x["n"]) == 1) & (F.hash(x["key"]) == x["sum"]))
        pure = F.array_distinct(F.transform(single, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"))))

        def remove(p: Column) -> Column:
            rest = _let(_placed(p, lambda x: x["n"], lambda x: x["key"], size), lambda placed: _summed(placed, size, lambda c: F.element_at(s["cells"], c + 1), -1))
            return F.struct(
                F.when(F.size(p) > 0, rest).otherwise(s["cells"]).alias("cells"), F.concat(s["found"], p).alias("found"),
                ((F.size(p) == 0) | (F.size(s["found"]) > 3 * (size if isinstance(size, int) else size["size"]))).alias("stop"),
            )

        return F.when(s["stop"], s).otherwise(_let(pure, remove))

    start = F.struct(cells.alias("cells"), none.alias("found"), F.lit(False).alias("stop"))
    return F.aggregate(
        F.sequence(F.lit(1), _rounds(size)), start, step,
        lambda s: F.struct(F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["key"] == 0) & (x["sum"] == 0)).alias("ok"), s["found"].alias("found")),
    )


def recovered(a: Column, b: Column, size: Column) -> Column:
    """How many digests of either array the other lacks, from sketches of so many cells a subtable; null if peeling stalls. What is placed with
    1 for a's digests and -1 for b's is the difference of their sketches."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0))
    sign = lambda x, n: F.transform(x, lambda d: F.struct(d.alias("key"), F.lit(n).alias("n")))
    signed = F.concat(sign(a, 1), sign(b, -1))

    def of(shape: Column) -> Column:
        cells = _let(_placed(signed, lambda x: x["n"], lambda x: x["key"], shape), lambda placed: _summed(placed, shape, lambda c: empty, 1))
        return _let(peel(cells, shape), lambda x: F.when(x["ok"], F.size(x["found"])))

    return _let(_shape(size), of)


def estimate(cells: Column, n: Column, m: Column) -> Column:
    """About how many digests differ of arrays of n and m, from the difference of their fingerprints: at least n - m, at most n + m."""
    squares = F.aggregate(cells, F.lit(0).cast("long"), lambda s, x: s + x["n"].cast("long") * x["n"]) / 3
    apart = (n - m).cast("long")
    return F.least(n + m, F.greatest(F.abs(apart), F.ceil(MARGIN * (squares * SIZE - apart * apart) / (SIZE - 1)))).cast("int")


def differ(a: Column, b: Column, difference: Column) -> Column:
    """How many digests of either array the other lacks: from the difference of the fingerprints, where that stalls from sketches as large as it
    says; null if these stall too."""
    again = lambda cells: recovered(a, b, F.ceil(SHARE * estimate(cells, F.size(a), F.size(b))).cast("int") + BESIDES)
    return _let(difference, lambda cells: _let(peel(cells, SIZE), lambda x: F.when(x["ok"], F.size(x["found"])).otherwise(again(cells))))


def differences(pairs: DataFrame, size: int = GROWTH * SIZE) -> DataFrame:
    """pairs: columns of their own, a, b (different arrays of distinct digests; materialized). The same columns without a and b, and `differ`:
    how many digests the arrays don't share, by sketches of `size` cells a subtable at least, and more than the pair's digests need, that grow
    until each pair is peeled. A pair of equal digests and checksums apart, a sketch of a few times as many cells as digests always peels, so the rounds end."""
    names = [c for c in pairs.columns if c not in ("a", "b")]
    done, left, times = [], pairs, 1
    while left.limit(1).count():
        need = GROWTH * F.ceil(SHARE * (F.size("a") + F.size("b"))).cast("int") + BESIDES
        tried = left.withColumn("differ", recovered(F.col("a"), F.col("b"), F.greatest(F.lit(size), need) * times))
        tried = materialize(tried.select(*names, "differ", *[F.when(F.col("differ").isNull(), F.col(x)).alias(x) for x in "ab"]), "peeled")
        done.append(tried.where("differ is not null").select(*names, "differ"))
        left, times = tried.where("differ is null").drop("differ"), GROWTH * times
    return reduce(DataFrame.union, done) if done else pairs.select(*names, F.lit(0).alias("differ")).limit(0)


def alike(n: Column, m: Column, differ: Column) -> Column:
    """Likeness of arrays of n and m digests that differ in so many."""
    return F.when(n + m == 0, F.lit(1.0)).otherwise((n + m - differ) / (n + m + differ))


def as_text(cells: Column) -> Column:
    """A sketch as a string."""
    one = F.concat_ws("", F.transform(cells, lambda c: F.concat(F.substring(F.lpad(F.hex(c["n"].cast("long")), 16, "0"), 13, 4), F.lpad(F.hex(c["key"]), 16, "0"), F.substring(F.lpad(F.hex(c["sum"].cast("long")), 16, "0"), 9, 8))))
    return F.base64(F.unhex(one))


def _stretches(ids: DataFrame, parts: int) -> Column:
    """A number for each row of (doc_id, key); descending numbers follow the order (doc_id descending, nulls last, then key). Ids go by
    quantiles; the rows of one id that fills several of these, and those without one, are split by key."""
    nulls, total = ids.agg(F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    high = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 32)  # keys in order, from 0
    part_of = lambda m: F.shiftrightunsigned(high * m, 32).cast("int")
    if parts < 2:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], F.lit(100 * parts))).first()[0] or []
    times = {x: bounds.count(x) for x in bounds}
    base = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in sorted(times)]), lambda x: x < F.col("doc_id"))) if times else F.lit(0)
    heavy = [F.when(F.col("doc_id") == x, F.lit(m) - part_of(m)) for x, m in times.items() if m > 1]
    inside = F.coalesce(*heavy, F.lit(0))  # the id that is a stretch's upper bound comes before the others
    without = -1 - part_of(max(1, parts * nulls // max(1, total)))
    return F.when(F.col("doc_id").isNull(), without).otherwise(base * (parts + 1) + inside)


def following(docs: DataFrame) -> DataFrame:
    """(key, key2, need, next_key, next_key2) of each document: its next one by descending doc_id (the first one's, after the last).

    Only ids are put in order, in stretches; the first of each (at most 3 STRETCHES) passes through the driver.
    """
    ids = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "key", "key2", F.char_length("text").alias("n")).distinct(), "ids")
    stretch = _stretches(ids, max(1, min(STRETCHES, ids.count() // STRETCH)))
    order = Window.partitionBy("stretch").orderBy(F.col("doc_id").desc_nulls_last(), "key", "key2")
    led = ids.withColumn("stretch", stretch.cast("int")).select("*", F.row_number().over(order).alias("at"), F.lead("key").over(order).alias("next_key"), F.lead("key2").over(order).alias("next_key2"))
    led = materialize(led, "order")
    first = led.where("at = 1").select("stretch", "key", "key2").orderBy(F.desc("stretch")).collect()
    after = [(r["stretch"], *(first[(i + 1) % len(first)][1:])) for i, r in enumerate(first)]
    ends = ids.sparkSession.createDataFrame(after, "stretch int, first_key long, first_key2 long")
    led = led.join(F.broadcast(ends), "stretch")
    return led.select("key", "key2", F.floor(F.col("n") / 3).cast("int").alias("need"), F.coalesce("next_key", "first_key").alias("next_key"), F.when(F.col("next_key").isNull(), F.col("first_key2")).otherwise(F.col("next_key2")).alias("next_key2"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, more columns or none. For each of its rows: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and next_doc_id.

    A null text is empty. Rows with one doc_id and one text are one document in the order, each with its results; rows
    with one doc_id and several texts follow each other in a fixed order; null doc_ids come last. A single
    document is its own next one. Two texts without paragraphs have likeness 1. An empty table gives an empty result. Texts
    of any length are read whole; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    both = row_key(F.col("doc_id"), text)
    base = docs.select("doc_id", both["a"].alias("key"), both["b"].alias("key2"), text.alias("text"))
    pairs = materialize(following(base), "pairs")
    repeated = docs.count() > pairs.count()
    # both joins read base by the same columns, unrenamed, so that Spark deals the texts out once and reads them twice
    pairs = pairs.withColumnsRenamed({"key": "for_key", "key2": "for_key2"})
    given = base.dropDuplicates(["key", "key2"]) if repeated else base
    given = given.join(pairs, (F.col("key") == F.col("next_key")) & (F.col("key2") == F.col("next_key2")))
    given = given.select("for_key", "for_key2", "need", F.col("doc_id").alias("next_doc_id"), F.col("text").substr(F.lit(1), F.col("need")).alias("tail"), digests(F.col("text")).alias("next_all"))
    df = base.join(given, (F.col("key") == F.col("for_key")) & (F.col("key2") == F.col("for_key2")))
    df = df.select("key", "key2", "doc_id", "next_doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", "next_all", F.concat(F.col("text").substr(F.lit(1), F.char_length("text") - F.col("need")), "tail").alias("edited"))
    df = df.select("key", "key2", "doc_id", "next_doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("all"), digests(F.col("edited")).alias("edited_all"), "next_all")
    df = df.withColumns({f"_{x}": sketch(F.col(x)) for x in ("all", "edited_all", "next_all")})
    df = df.withColumns({f"d_{x}": differ(F.col("all"), F.col(f"{x}_all"), subtract(F.col("_all"), F.col(f"_{x}_all"))) for x in ("edited", "next")})
    stalled = lambda d, which, other: F.when(F.col(d).isNull(), F.struct(F.lit(which).alias("which"), F.col("all").alias("a"), F.col(other).alias("b")))
    rest = F.filter(F.array(stalled("d_edited", "edited", "edited_all"), stalled("d_next", "next", "next_all")), lambda x: x.isNotNull())
    sizes = [F.size(x).alias(f"n_{x}") for x in ("all", "edited_all", "next_all")]
    first = df.select("key", "key2", "doc_id", "n_chars", "edited_sha256", as_text(F.col("_all")).alias("fingerprint"), as_text(F.col("_edited_all")).alias("edited_fingerprint"), *sizes, "d_edited", "d_next", "next_doc_id", rest.alias("rest"))
    first = materialize(first, "first")
    again = first.where(F.size("rest") > 0)
    asked = again.dropDuplicates(["key", "key2"]) if repeated else again
    asked = materialize(asked.select("key", "key2", F.explode("rest").alias("x")).select("key", "key2", "x.*"), "stalled")
    found = differences(asked).groupBy("key", "key2").agg(*[F.max(F.when(F.col("which") == w, F.col("differ"))).alias(f"m_{w}") for w in ("edited", "next")])
    again = again.join(found, ["key", "key2"]).withColumns({f"d_{w}": F.coalesce(f"d_{w}", f"m_{w}") for w in ("edited", "next")}).select(*first.columns)
    out = first.where(F.size("rest") == 0).union(again)
    near = [alike(F.col("n_all"), F.col(f"n_{w}_all"), F.col(f"d_{w}")).alias(f"near_{w}") for w in ("edited", "next")]
    discard(pairs)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near, "next_doc_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op7_iblt_fingerprint": op7_fingerprints}
ORACLE: dict[str, str] = {}
