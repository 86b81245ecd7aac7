"""How the filters of a corpus interact: what each removes in each order, alone, and on average.

One aggregation counts, for each of the 32 sets of five filters, the documents that fail all of its filters, as sums of products of failure
flags; the same with the labels of quality and toxicity as further factors. Everything else follows from these 32 numbers of a part:

* Survivors of a set of filters, by inclusion and exclusion: the sum over its subsets of (-1)^size times their joint failures (the Moebius
  transform over the lattice of subsets).
* What a filter removes after others: survivors of these less survivors with it. What it fails but finds removed: its failures less that.
* What only it fails: the sum over the sets with it of (-1)^(size - 1) times their joint failures.
* Shapley: removing documents is a game whose Harsanyi dividend of a set is (-1)^(size + 1) times its joint failures; each filter of the
  set gets an equal share of it. Over all 120 orders a share is 120 / size, so the sums are integers.

Filters, on whole texts (null is an empty one; words are maximal runs of characters other than blank and U+0009 to U+000D, compared as they
are): A under 100 words; B 100 * distinct words < 80 * words; C 100 * capital letters A-Z > 10 * characters; D has one of ``#$%&*|``; E is identical to the
text of a smaller doc_id, removed or not. Null and empty texts are identical. A null doc_id is neither smaller nor larger than another,
so its row never fails E, and it has no label. Rows with one doc_id are documents of their own; equal ids are not smaller, so neither fails E by the
other. A document has a label if any row of ``labels`` for its id has. An empty table gives no rows. Other columns, however called, play no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import apart, stored

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
#: Factors of the counts: 1 for every document, and its labels.
WEIGHTS = ("every", "good", "toxic")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D) for each row: flags 0 or 1 of the filters that look at one text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    flags = {
        "A": n < 100,
        "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length("text").cast("long"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    return rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), *(F.when(v, 1).otherwise(0).alias(k) for k, v in flags.items()))


def with_copies(rows: DataFrame) -> DataFrame:
    """Add E: 1 where a smaller doc_id has the same digest."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest", "lo")
    return rows.join(apart(first), "digest", "left").withColumn("E", F.when(F.col("doc_id") > F.col("lo"), 1).otherwise(0)).drop("lo", "digest")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add good and toxic, 0 or 1, and every, 1."""
    flag = lambda c, name: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name)
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality", "good"), flag("toxic", "toxic"))
    return rows.join(apart(own), "doc_id", "left").fillna(0, ["good", "toxic"]).withColumn("every", F.lit(1))


def joint_failures(rows: DataFrame) -> DataFrame:
    """(part, every0..every31, good0.., toxic0..): documents that fail all filters of each set, by the bits of FILTERS."""
    flags = [[f for i, f in enumerate(FILTERS) if s >> i & 1] for s in SETS]
    return rows.groupBy("part").agg(*(F.expr(f"sum(cast({' * '.join([*flags[s], w])} as bigint)) as {w}{s}") for w in WEIGHTS for s in SETS))


def _sign(s: int) -> int:
    return -1 if s.bit_count() % 2 else 1


def _total(weight: str, terms: dict[int, int]) -> str:
    """The sum of the joint failures of some sets, each times its factor."""
    return " + ".join(f"{k} * {weight}{s}" for s, k in terms.items())


def survivors(weight: str, s: int) -> str:
    """Documents that no filter of the set removes."""
    return _total(weight, {u: _sign(u) for u in SETS if u & s == u})


def orders() -> Column:
    """All orders of the filters, a row for each."""
    return F.explode(F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " "))


def interactions(joint: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from joint failures."""
    one = [1 << i for i in range(len(FILTERS))]
    array = lambda name, items: F.expr(f"array({', '.join(items)}) as {name}")
    table = joint.select(
        "part",
        *(array(f"{w}_left", (survivors(w, s) for s in SETS)) for w in WEIGHTS),
        array("fails", (f"every{x}" for x in one)),
        array("alone", (_total("every", {s: -_sign(s) for s in SETS if s & x}) for x in one)),
        array("shares", (_total("every", {s: -_sign(s) * (120 // s.bit_count()) for s in SETS if s & x}) for x in one)),
    )
    rows = table.withColumn("filter_order", orders()).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = " + ".join(f"if(contains(substring(filter_order, 1, step - 1), '{f}'), {x}, 0)" for f, x in zip(FILTERS, one))
    rows = rows.withColumns({"before": F.expr(before), "bit": F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1)) - 1")})
    rows = rows.withColumn("after", F.expr("before + shiftleft(1, bit)"))
    lost = lambda w: f"{w}_left[before] - {w}_left[after]"
    return rows.selectExpr(
        "part", "filter_order", "step", "every_left[after] as kept", f"{lost('every')} as removed", f"fails[bit] - ({lost('every')}) as redundant",
        "alone[bit] as unique_fails", f"{lost('good')} as good_lost", f"{lost('toxic')} as toxic_lost", "shares[bit] as shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters for each language; the narrow rows of flags are written once, so texts are read once."""
    rows = stored(failures(docs))
    return interactions(joint_failures(with_labels(with_copies(rows), labels)))
