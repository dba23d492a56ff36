"""A bounded sample of labelled documents for classifiers, the same one on every run.

For each label the documents with the smallest hashes of their ids are taken. Labels are counted
first; a hash under a cut that follows from the count lets about half more through than are asked for,
so nothing is ranked but these few, and no task gathers a label. Texts are read last, for the chosen ids.

Cases: rows with a null id or label are not learned from; a repeated id counts once, with its
greatest label and its smallest text; a null text leaves the sample one short; where a label has fewer
documents than asked for all are taken; of more labels than ``MOST_LABELS`` the most frequent are learned; no
label gives an empty sample; long texts are cut to evenly spaced stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.util import is_held_out

#: What the first cut lets through, as a multiple of what is asked for, and how it widens where too few are found.
SPARE, WIDEN = 1.5, 4
#: Bits of the hash that are looked at; a double holds them exactly.
BITS = 53
#: Labels that are learned, the most frequent ones: a column of very many values must not fill the driver.
MOST_LABELS = 1000
#: Stretches that a long text is cut to.
STRETCHES = 8


def stretches(text: Column, most: int, count: int = STRETCHES) -> Column:
    """The text, or evenly spaced stretches of ``most`` characters together."""
    size, length = most // count, F.char_length(text)
    parts = [F.substring(text, F.floor((length - size) * k / (count - 1)).cast("int") + 1, F.lit(size)) for k in range(count)]
    return F.when(length <= most, text).otherwise(F.concat_ws("\n", *parts))


def labelled_sample(docs: DataFrame, marks: DataFrame, per_label: int, most_chars: int) -> list[tuple[str, str]]:
    """(text, label) of at most ``per_label`` learnable documents a label, of at most ``most_chars`` characters each.

    ``docs`` has id and text, ``marks`` id and label; held-out ids are never taken.
    """
    spark = docs.sparkSession
    known = marks.where("id is not null and label is not null").where(~is_held_out(F.col("id")))
    known = known.select("id", "label", F.shiftrightunsigned(F.xxhash64("id"), 64 - BITS).alias("place"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(MOST_LABELS).collect()}
    kind = marks.schema["label"].dataType.simpleString()
    share = {label: SPARE * per_label / n for label, n in counts.items()}
    found: dict = {label: [] for label in counts}
    due = list(counts)
    while due:
        cuts = spark.createDataFrame([(label, int(min(1.0, share[label]) * 2**BITS)) for label in due], f"label {kind}, cut long")
        few = known.join(F.broadcast(cuts), "label").where("place < cut").groupBy("id", "place").agg(F.max("label").alias("label"))
        here = docs.select("id").join(F.broadcast(few), "id").distinct()  # few: bounded by the cut
        for label in due:
            found[label] = []
        for r in here.collect():
            if r.label in due:
                found[r.label].append((r.place, r.id))
        due = [label for label in due if len(found[label]) < per_label and share[label] < 1]
        share |= {label: WIDEN * share[label] for label in due}
    label_of = {i: label for label, rows in found.items() for _, i in sorted(rows)[:per_label]}
    if not label_of:
        return []
    wanted = spark.createDataFrame([(i,) for i in sorted(label_of)], f"id {docs.schema['id'].dataType.simpleString()}")
    texts = docs.where("text is not null").join(F.broadcast(wanted), "id").select("id", stretches(F.col("text"), most_chars).alias("text"))
    rows = texts.groupBy("id").agg(F.min("text").alias("text")).collect()
    return [(r.text, label_of[r.id]) for r in sorted(rows, key=lambda r: r.id)]
