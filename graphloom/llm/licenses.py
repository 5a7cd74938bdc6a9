"""Licence scan by ordered signature rules, in DataFrame functions only.

1. A keyword prefilter over the raw text: texts without any gate keyword are only counted.
2. The others become lower-case words joined by single spaces. Rules whose own keyword stands there are tried.
3. Every match is a detection with an interval. It is suppressed if another detection's interval contains it and has
   a better priority, or the same priority and a longer interval. Base phrases are never suppressed.

All of it happens within a row: no shuffle, and nothing depends on how many documents share a licence. Offsets are running sums
and suppression is a sweep, both in blocks, so that a long text full of detections takes little more than its length.

Nulls: a null text is empty: no words, no places, empty label strings, score 0. Rows with null or repeated ids are scanned like
any others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrays import let, running
from graphloom.llm.license_rules import BASE, GATE_WORDS, GATES, rules

WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
ANY_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: By priority, how sure a rule's detection is.
SURE = (1.0, 0.9, 0.6)


def _gate(text: Column) -> Column:
    low, out = F.lower(text), None
    for g in GATES:
        out = F.contains(low, F.lit(g)) if out is None else out | F.contains(low, F.lit(g))
    return out | F.regexp_like(text, F.lit(rf"(?i)(?<![0-9A-Za-z])(?:{'|'.join(GATE_WORDS)})(?![0-9A-Za-z])"))


def _starts(words: Column, phrase: str) -> Column:
    """Word numbers at which the words of `phrase` stand."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return out

    every = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.filter(every, lambda i: F.coalesce(here(i), F.lit(False)))


def _detections(norm: Column) -> Column:
    """start, end, priority and label of every match of every rule whose keyword stands in `norm`."""
    table = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("priority"), F.lit(f" {c}").alias("word"), F.lit(f"(?<= )(?:{d})(?= )").alias("pattern")) for a, b, c, d in rules()))

    def places(r: Column) -> Column:
        found = F.regexp_extract_all(norm, r["pattern"], F.lit(0))
        # Each match with the length of what lies before it, back to the match before.
        steps = F.zip_with(found, F.split(norm, r["pattern"], -1), lambda m, gap: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("size")))
        moves = let(F.filter(steps, lambda x: x["size"].isNotNull()), lambda kept: F.zip_with(running(F.transform(kept, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, y: a + y), kept, one))

        return F.transform(moves, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label")))

    def one(end: Column, x: Column) -> Column:
        return F.struct((end - x["size"]).alias("start"), end.alias("end"))

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(norm, r["word"])), places))


def _kept(found: Column) -> Column:
    """The detections that none suppresses, by a sweep.

    They are sorted so that whatever contains a detection stands before it. Then the furthest end so far of each priority, and among
    equal ends the earliest start, decide: both are one number, the end before 31 bits of how early the start is.
    """
    far = F.lit((1 << 31) - 1)
    levels = range(1, len(SURE) + 1)

    def reach(d: Column) -> Column:
        code = F.shiftleft((-d["back"]).cast("long"), 31) + (far - d["start"])
        return F.struct(*(F.when(d["priority"] == p, code).otherwise(F.lit(0).cast("long")).alias(f"p{p}") for p in levels))

    def further(a: Column, b: Column) -> Column:
        return F.struct(*(F.greatest(a[f"p{p}"], b[f"p{p}"]).alias(f"p{p}") for p in levels))

    def stands(d: Column, upto: Column) -> Column:
        own, out = F.shiftleft((-d["back"]).cast("long"), 31) + (far - d["start"]), F.lit(True)
        for p in levels:
            better = F.shiftright(upto[f"p{p}"], 31) >= -d["back"]
            out = out & ~F.when(d["priority"] > p, better).when(d["priority"] == p, upto[f"p{p}"] > own).otherwise(F.lit(False))
        return out

    zero = F.struct(*(F.lit(0).cast("long").alias(f"p{p}") for p in levels))
    ordered = F.sort_array(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label"))))
    back = lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"))
    told = lambda all_: F.zip_with(all_, running(F.transform(all_, reach), zero, further), lambda d, upto: F.struct(stands(d, upto).alias("ok"), back(d).alias("d")))
    return F.transform(F.filter(let(ordered, told), lambda x: x["ok"]), lambda x: x["d"])


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, n_words, base (label and starts of each base phrase), found (kept detections, offsets in the joined words), score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(key, text.alias("t")).select(
        key,
        F.regexp_count("t", F.lit(ANY_WORD)).cast("long").alias("n_words"),
        F.when(_gate(F.col("t")), F.regexp_extract_all(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))).alias("words"),
    )
    joined = counted.withColumn("norm", F.when(F.size("words") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    norm = F.col("norm")
    base = F.array(*(F.struct(F.lit(label).alias("label"), F.when(F.contains(norm, F.lit(f" {p} ")), _starts(F.col("words"), p)).alias("starts")) for label, p in sorted(BASE.items())))
    found = joined.withColumns({"base": F.when(norm.isNotNull(), F.filter(base, lambda b: F.size(b["starts"]) > 0)), "all": F.when(norm.isNotNull(), _detections(norm))})
    kept = found.withColumn("found", F.when(F.size("all") > 0, _kept(F.col("all"))))
    sure = F.greatest(
        F.aggregate(F.coalesce("found", F.array().cast(kept.schema["found"].dataType)), F.lit(0.0), lambda a, d: F.greatest(a, F.element_at(F.array(*map(F.lit, SURE)), d["priority"]))),
        F.when(F.size("base") > 0, F.lit(SURE[1])).otherwise(F.lit(0.0)),
    )
    return kept.select(key, "n_words", "base", "found", sure.alias("score"))


def label_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    strings = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    base = strings(F.transform("base", lambda b: b["label"]))
    mine = strings(F.transform("found", lambda d: d["label"]))
    starts = F.coalesce(F.flatten(F.transform("base", lambda b: b["starts"])), F.array().cast("array<int>"))
    return scan(docs).select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, mine))), ",").alias("labels"), "score",
    )
