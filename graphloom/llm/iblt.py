"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's paragraphs are its lines. One over LONG characters is cut after words whose hash is 0 modulo EVERY, so that an edit within it changes
the paragraphs around it only; a text of up to SHORT characters has its words for paragraphs. A paragraph's
digest is a 64-bit hash of it and of how many equal ones stand before it: repeats count, the order of paragraphs doesn't.
A sketch has three parts of PART cells; a digest adds itself to one cell of each part: a count, an xor of digests and an xor of
check values. The difference of two sketches holds just the digests in which the texts differ. Peeling recovers them,
each with its side: a cell that holds one digest (its check says so) gives it up, and it is taken out of its other
cells, until nothing is left.

Peeling fails where a sketch is too small for the difference. Then it is retried larger: all digests are dealt into buckets of about
EACH, then into twice as many up to 16 times, by hashes that differ from retry to retry; each bucket has a sketch of its own, which is tried
AGAIN times. A retry fails with a small chance, which doesn't depend on the one before; after RETRIES the query fails. The likeness of two fingerprints is that of the sets of digests: common ones over all.

Neighbours in doc_id order are found without one task seeing all rows: ids fall into about sqrt(n) ordered buckets, and each
bucket gets the next bucket's first document as a guest.

Nulls: a null text is empty, one empty paragraph. Null ids come after all others; rows that repeat an id follow one
another in the order of a hash of their texts. A single row is its own neighbour. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.arrays import let, running
from graphloom.llm.common import ordered_buckets

PART, ROUNDS, SMALL, FEW, EACH, AGAIN, RETRIES = 8, 24, 3, 5, 2, 4, 24
SHORT, LONG, EVERY = 128, 256, 64


def paragraphs(text: Column) -> Column:
    def pieces(piece: Column) -> Column:
        cut = F.transform(F.split(piece, " "), lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(EVERY)) == 0, F.concat(w, F.lit("\n"))).otherwise(w))
        return F.when(F.char_length(piece) <= LONG, F.array(piece)).otherwise(F.split(F.array_join(cut, " "), "\n"))

    return F.when(F.char_length(text) <= SHORT, F.split(text, "[ \n]")).otherwise(F.flatten(F.transform(F.split(text, "\n"), pieces)))


def _numbered(hashes: Column) -> Column:
    """Hashes with repeats, as digests of a hash and its number among its equals."""
    kind = "struct<h:bigint,n:int,all:boolean>"

    def step(a: Column, b: Column) -> Column:
        on = (a["h"] == b["h"]) & b["all"]
        both = F.struct(b["h"].alias("h"), F.when(on, a["n"] + b["n"]).otherwise(b["n"]).alias("n"), (a["all"] & on).alias("all")).cast(kind)
        return F.when(a["n"] == 0, b).otherwise(both)

    runs = F.transform(F.sort_array(hashes), lambda h: F.struct(h.alias("h"), F.lit(1).alias("n"), F.lit(True).alias("all")).cast(kind))
    zero = F.struct(F.lit(0).alias("h"), F.lit(0).alias("n"), F.lit(True).alias("all")).cast(kind)
    return F.transform(running(runs, zero, step), lambda x: F.when(x["n"] == 1, x["h"]).otherwise(F.xxhash64(x["h"], x["n"])))


def digests(text: Column) -> Column:
    """The digests of a text's paragraphs, each once."""
    def once(hashes: Column) -> Column:
        return let(F.array_distinct(hashes), lambda d: F.when(F.size(d) == F.size(hashes), d).otherwise(F.array_distinct(_numbered(hashes))))

    return let(F.transform(paragraphs(text), lambda p: F.xxhash64(p)), once)


def _full(k: Column, n: Column, salt: Column, part: int = PART) -> Column:
    """A digest with its count, its check value and its cell in each of three parts."""
    h = F.xxhash64(k, salt)
    at = [F.pmod(F.shiftright(h, 20 * j), F.lit(part)).cast("int") + j * part for j in range(3)]
    return F.struct(n.cast("long").alias("n"), k.alias("k"), _check(k).alias("c"), at[0].alias("a"), at[1].alias("b"), at[2].alias("d"))


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), k.alias("k"), c.alias("c"))


def _cells(full: Column, part: int = PART) -> Column:
    """The cells of digests as _full() gives them, 3 * `part`."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def cells(name: str, first: int) -> Column:
        def one(i: Column) -> Column:
            mine = F.filter(full, lambda e: e[name] == i)
            return F.aggregate(mine, zero, lambda s, e: _cell(s["n"] + e["n"], s["k"].bitwiseXOR(e["k"]), s["c"].bitwiseXOR(e["c"])))

        return F.transform(F.sequence(F.lit(first), F.lit(first + part - 1)), one)

    return F.concat(cells("a", 0), cells("b", part), cells("d", 2 * part))


def sketch(keys: Column) -> Column:
    """The cells of an array of digests."""
    return let(F.transform(keys, lambda k: _full(k, F.lit(1), F.lit(0))), _cells)


def subtract(left: Column, right: Column) -> Column:
    """The cells of the difference of two sketches."""
    return F.zip_with(left, right, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


FOUND = "array<struct<digest:bigint,side:bigint>>"


def _peel(cells: Column, salt: Column, part: int = PART, rounds: int = ROUNDS) -> Column:
    """The digests that the difference of two sketches holds, with side 1 (left) or -1 (right); null where peeling gets stuck."""

    def pure(state: Column) -> Column:
        alone = F.filter(state, lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"]))
        return F.array_distinct(F.transform(alone, lambda x: _full(x["k"], x["n"], salt, part)))

    def without(state: Column, gone: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            return F.aggregate(
                gone, x, lambda s, g: F.when((g["a"] == i) | (g["b"] == i) | (g["d"] == i), _cell(s["n"] - g["n"], s["k"].bitwiseXOR(g["k"]), s["c"].bitwiseXOR(g["c"]))).otherwise(s)
            )

        return F.transform(state, one)

    def step(s: Column, _: Column) -> Column:
        # A round that finds nothing leaves all as it is; `gone` is kept in the state so that it is found once.
        found = F.concat(s["found"], F.transform(s["gone"], lambda g: F.struct(g["k"].alias("digest"), g["n"].alias("side"))))
        after = lambda x: F.struct(x.alias("cells"), pure(x).alias("gone"), found.alias("found"))
        return F.when(F.size(s["gone"]) > 0, let(without(s["cells"], s["gone"]), after)).otherwise(s)

    empty = lambda s: ~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
    start = lambda x: F.struct(x.alias("cells"), pure(x).alias("gone"), F.array().cast(FOUND).alias("found"))
    every = F.sequence(F.lit(1), F.lit(rounds))
    return let(cells, lambda x: F.aggregate(every, start(x), step, lambda s: F.when(empty(s), s["found"])))


def _larger(left: Column, right: Column, retry: Column) -> Column:
    """The same with a bucket for every EACH digests, and twice as many with each retry, by the retry's hash.

    A bucket's cells take digests of the left with 1 and of the right with -1, which is the difference of its two sketches. One that
    gets stuck is tried AGAIN times with other cells before all are dealt anew.
    """
    n = F.size(left) + F.size(right)
    # So many groups of so many buckets: dealing in two steps keeps long texts from comparing every digest with every bucket.
    side = F.greatest(F.ceil(F.sqrt(n / F.lit(EACH) * F.pow(F.lit(2.0), F.least(retry, F.lit(5)) - 1))), F.lit(1)).cast("int")

    def once(held: Column, salt: Column) -> Column:
        return _peel(_cells(F.transform(held, lambda x: _full(x["k"], x["n"], salt, SMALL)), SMALL), salt, SMALL, FEW)

    def peeled(held: Column) -> Column:
        tries = F.aggregate(F.sequence(F.lit(1), F.lit(AGAIN)), F.lit(None).cast(FOUND), lambda s, k: F.when(s.isNotNull(), s).otherwise(once(held, k)))
        return F.when(F.size(held) > 0, tries).otherwise(F.array().cast(FOUND))

    def dealt(m: Column) -> Column:
        def signed(x: Column, of: int) -> Column:
            to = lambda h: F.struct(F.pmod(h, m).alias("group"), F.pmod(F.shiftright(h, 32), m).alias("bucket"))
            return F.transform(x, lambda k: F.struct(to(F.xxhash64(k, retry, F.lit("bucket"))).alias("to"), k.alias("k"), F.lit(of).alias("n")))

        every = F.sequence(F.lit(0), m - 1)
        bucket = lambda held: lambda b: let(F.filter(held, lambda x: x["to"]["bucket"] == b), peeled)
        group = lambda all_: lambda g: let(F.filter(all_, lambda x: x["to"]["group"] == g), lambda held: F.transform(every, bucket(held)))
        each = let(F.concat(signed(left, 1), signed(right, -1)), lambda all_: F.flatten(F.transform(every, group(all_))))
        return let(each, lambda got: F.when(F.forall(got, lambda x: x.isNotNull()), F.flatten(got)))

    return let(side, dealt)


def difference(left: Column, right: Column, left_cells: Column, right_cells: Column) -> Column:
    """The digests in which two texts differ, each with its side: by their sketches, then by ever larger ones."""
    stuck = F.raise_error(F.lit("the difference of two sketches could not be peeled")).cast(FOUND)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), F.lit(None).cast(FOUND), lambda s, k: F.when(s.isNotNull(), s).otherwise(_larger(left, right, k)))
    return F.coalesce(_peel(subtract(left_cells, right_cells), F.lit(0)), again, stuck)


def likeness(left: Column, right: Column, differ: Column) -> Column:
    n = F.size(left) + F.size(right)
    return F.try_divide((n - differ).cast("double"), (n + differ).cast("double"))


def as_text(cells: Column) -> Column:
    """A sketch as hex digits: per cell two for the count (mod 256), 16 for the digests and 8 for the checks."""
    hex_ = lambda x, n: F.lpad(F.hex(x), n, "0")
    return F.lower(F.array_join(F.transform(cells, lambda x: F.concat(hex_(F.pmod(x["n"], F.lit(256)), 2), hex_(x["k"], 16), hex_(x["c"], 8))), ""))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and `next`, the text of the next document in descending doc_id order; after the last comes the first."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.withColumn("h", F.xxhash64("text")).withColumn("o", F.bitwise_not("h"))
    placed = placed.withColumn("bucket", ordered_buckets(placed, "doc_id", "o")).drop("o")
    tops = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("o"))).alias("top"))  # a row for each bucket
    down = Window.orderBy(F.desc("bucket"))
    ring = tops.withColumn("at", F.row_number().over(down)).withColumn("guest_of", F.lag("bucket").over(down)).withColumn("last", F.min("bucket").over(Window.partitionBy()))
    hosts = ring.select(F.col("top.doc_id").alias("g_id"), F.bitwise_not("top.o").alias("g_h"), F.coalesce("guest_of", "last").alias("host"))
    guests = placed.join(F.broadcast(hosts), placed.doc_id.eqNullSafe(F.col("g_id")) & (placed.h == F.col("g_h"))).select("doc_id", "text", "h", F.col("host").alias("bucket"))
    all_ = placed.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "h")
    return all_.withColumn("next", F.lead("text").over(order)).filter("guest = 0").select("doc_id", "text", "next")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and edited_difference of every row.

    edited_difference has the recovered digests: those of the text only (side 1) and those of the edited text only (side -1).
    """
    pairs = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next"), F.lit(1), cut))
    texts = pairs.withColumn("edited", edited)
    keyed = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), digests(F.col("next")).alias("c"))
    cells = keyed.withColumns({"sa": sketch(F.col("a")), "sb": sketch(F.col("b")), "sc": sketch(F.col("c"))})
    cols = {x: F.col(x) for x in ("a", "b", "c", "sa", "sb", "sc")}
    told = cells.withColumns({"de": difference(cols["a"], cols["b"], cols["sa"], cols["sb"]), "dn": F.size(difference(cols["a"], cols["c"], cols["sa"], cols["sc"]))})
    return told.select(
        "doc_id", "n_chars", "edited_sha256", as_text(cols["sa"]).alias("fingerprint"), as_text(cols["sb"]).alias("edited_fingerprint"),
        likeness(cols["a"], cols["b"], F.size("de")).alias("near_edited"), likeness(cols["a"], cols["c"], F.col("dn")).alias("near_next"), F.col("de").alias("edited_difference"),
    )
