"""Three-way merge of two branches of a table by tombstone sequences and conflict-recording registers.

A document is a sequence of lines.  Each line of the base keeps its number as a stable identifier in both branches: a dropped line
stays as a tombstone, and inserted lines are anchored to the line after which they stand, tombstone or not, so that branches never
disagree about places.  A branch is a table of replicas, which hold only what the branch changed: a register for each column, one for
each line (its new text, or a tombstone) and one for each gap after a line.  Replicas are joined with the base by id, and
their registers in pairs by identifier: a change of one side, or the same change of both, is clean; two different changes are a conflict,
which is recorded with both values and takes the right branch's.  Rows are registers too: a row that one branch drops and the other
changes is a conflict of its own.

One shuffle of the base by id serves base and replicas alike, and no group is larger than a document.

Defined results.  Nulls become empty first; a null id is named by the empty string, is the smallest id and
adds a row without an id.  A table has one row of an id: of rows that repeat an id the one that is greatest by lang, source and text counts,
as a merge by id can't tell them apart.  A row that is added with an id that the base has is no change.  An empty text is one empty line; a
text of which all lines are dropped is empty.  Very long texts are merged whole.  An empty table gives an
empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, lift, whole

COLUMNS = ("lang", "source")
#: A line's register: a tombstone, its new text, and the lines inserted after it.
_LINE = "struct<dropped:boolean,text:string,after:array<string>>"


class Branch(NamedTuple):
    """``edits``: ``id, dropped, lang, source, lines``, null where nothing changed, with a line's register at its number in the
    base; one row an id.  ``added``: ``id, lang, source, text`` of new rows, one an id."""

    edits: DataFrame
    added: DataFrame


def base_table(docs: DataFrame) -> DataFrame:
    """``id, lang, source, text``: one row of each id."""
    return _greatest(docs, [*COLUMNS, "text"])


def _greatest(docs: DataFrame, columns: list[str]) -> DataFrame:
    rows = docs.select(lift("doc_id").alias("id"), *[whole(c).alias(c) for c in columns])
    return rows.groupBy("id").agg(F.max(F.struct(*columns)).alias("row")).select("id", "row.*")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def coded_branch(docs: DataFrame, name: str) -> Branch:
    """A branch of ``docs`` whose changes follow from checksums of branch, id and element, modulo 7."""
    named = F.coalesce(give_back(F.col("id")).cast("string"), F.lit(""))
    code = lambda element: F.pmod(F.crc32(F.concat(F.lit(f"{name}:"), named, F.lit(":"), element)), F.lit(7)).cast("int")
    appended = lambda c, old: F.when(c == 1, F.concat(old, F.lit("!"))).when(c == 2, F.concat(old, F.lit("?")))
    inserted = lambda c: F.when(c == 3, F.array(F.lit("!"))).when(c == 4, F.array(F.lit("?")))
    coded = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(code(i.cast("string")).alias("c"), x.alias("x")))
    register = lambda e: F.when(e["c"] <= 4, F.struct((e["c"] == 0).alias("dropped"), appended(e["c"], e["x"]).alias("text"), inserted(e["c"]).alias("after")))
    dropped = code(F.lit("row")) == 0
    edited = {c: F.when(~dropped, F.when(code(F.lit(c)) == 0, F.lit("")).otherwise(appended(code(F.lit(c)), F.col(c)))) for c in COLUMNS}
    edits = base_table(docs).select("id", dropped.alias("dropped"), *[v.alias(c) for c, v in edited.items()], F.when(~dropped, F.transform(coded, register)).alias("lines"))
    # new rows need no texts, so the scan reads none
    row = code(F.lit("row"))
    fresh = _greatest(docs, [*COLUMNS]).withColumn("text", F.when(row == 3, F.lit("!")).when(row == 4, F.lit("?"))).filter("text IS NOT NULL")
    new_id = F.coalesce(F.lit(-1).cast("long") - give_back(F.col("id")), F.col("id"))
    return Branch(edits, fresh.select(new_id.alias("id"), *COLUMNS, "text"))


def _register(base: Column, left: Column, right: Column) -> dict[str, Column]:
    """A register's value and what became of it; the three values may be null (a tombstone)."""
    l_changed, r_changed = ~left.eqNullSafe(base), ~right.eqNullSafe(base)
    conflict = l_changed & r_changed & ~left.eqNullSafe(right)
    kind = F.when(conflict, F.when(left.isNull() | right.isNull(), F.lit("edit_delete")).otherwise(F.lit("edit_edit"))).when(l_changed | r_changed, F.lit("clean"))
    return {"value": F.when(r_changed, right).otherwise(left), "kind": kind, "l": l_changed, "r": r_changed}


def merged_lines(lines: Column, left: Column, right: Column) -> Column:
    """The sequence with its tombstones: each line's value (null: dropped), the lines after it, and the kinds of both."""
    none = F.lit(None).cast("array<string>")

    def one(x: Column, i: Column) -> Column:
        a, b = F.get(left, i), F.get(right, i)
        value = lambda e: F.when(F.coalesce(e["dropped"], F.lit(False)), F.lit(None).cast("string")).otherwise(F.coalesce(e["text"], x))
        return F.struct(x.alias("base"), value(a).alias("left"), value(b).alias("right"), F.coalesce(a["after"], none).alias("l_after"), F.coalesce(b["after"], none).alias("r_after"))

    def joined(e: Column) -> Column:
        line = _register(e["base"], e["left"], e["right"])
        both = e["l_after"].isNotNull() & e["r_after"].isNotNull() & (e["l_after"] != e["r_after"])
        gap = F.when(both, F.lit("insert_insert")).when(e["l_after"].isNotNull() | e["r_after"].isNotNull(), F.lit("clean"))
        return F.struct(
            line["value"].alias("text"), F.coalesce(e["r_after"], e["l_after"]).alias("after"), line["kind"].alias("kind"), gap.alias("gap"),
            (line["l"] | e["l_after"].isNotNull()).alias("l"), (line["r"] | e["r_after"].isNotNull()).alias("r"),
            e["left"].alias("left"), e["right"].alias("right"), e["l_after"].alias("l_after"), e["r_after"].alias("r_after"),
        )

    return F.transform(F.transform(lines, one), joined)


def visible(lines: Column) -> Column:
    """The text of a sequence: its lines without tombstones, each followed by what is anchored to it."""
    empty = F.array().cast("array<string>")
    alive = lambda m: F.when(m["text"].isNull(), empty).otherwise(F.array(m["text"]))
    return F.array_join(F.flatten(F.transform(lines, lambda m: F.when(m["after"].isNull(), alive(m)).otherwise(F.concat(alive(m), m["after"])))), "\n")


def _is(field: str, kind: str) -> Callable[[Column], Column]:
    return lambda e: e[field] == kind


KINDS = ("clean", "edit_edit", "edit_delete", "insert_insert")


def merge(base: DataFrame, left: Branch, right: Branch) -> DataFrame:
    """``id, present, lang, source, text``, the number of each of ``KINDS`` as ``n_<kind>``, and ``conflicts``: an array of element, kind and both values.

    ``base`` has one row of each id, as :func:`base_table` makes it.
    """
    return _merged_rows(base, left.edits, right.edits).unionByName(_merged_additions(base, left.added, right.added))


def _merged_rows(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    side = lambda edits, s: edits.select("id", *[F.col(c).alias(f"{s}_{c}") for c in ("dropped", *COLUMNS)], F.col("lines").cast(f"array<{_LINE}>").alias(f"{s}_lines"))
    rows = base.join(side(left, "l").hint("merge"), "id", "left").join(side(right, "r").hint("merge"), "id", "left")
    no = F.lit(False)
    rows = rows.withColumns({f"{s}_dropped": F.coalesce(f"{s}_dropped", no) for s in "lr"})
    # a dropped row's other registers count for nothing
    of = lambda s, c, other: F.when(F.col(f"{s}_dropped"), other).otherwise(F.coalesce(f"{s}_{c}", other))
    registers = {c: _register(F.col(c), of("l", c, F.col(c)), of("r", c, F.col(c))) for c in COLUMNS}
    kept = lambda s: F.when(~F.col(f"{s}_dropped"), F.col(f"{s}_lines"))
    rows = rows.withColumns({"m": merged_lines(lines_of(F.col("text")), kept("l"), kept("r")), **{f"_{c}": F.struct(*[v.alias(k) for k, v in r.items()], of("l", c, F.col(c)).alias("left"), of("r", c, F.col(c)).alias("right")) for c, r in registers.items()}})
    changed = lambda s: F.exists("m", lambda e: e[s]) | F.col(f"_lang.{s}") | F.col(f"_source.{s}")
    lost = (F.col("l_dropped") & ~F.col("r_dropped") & changed("r")) | (F.col("r_dropped") & ~F.col("l_dropped") & changed("l"))
    rows = rows.withColumns({"gone": F.col("l_dropped") | F.col("r_dropped"), "lost": lost})
    inside = {
        k: F.size(F.filter("m", _is("kind", k))) + F.size(F.filter("m", _is("gap", k))) + sum(F.coalesce((F.col(f"_{c}.kind") == k).cast("int"), F.lit(0)) for c in COLUMNS)
        for k in KINDS
    }
    alone = {"clean": ~F.col("lost"), "edit_delete": F.col("lost")}
    numbers = [F.when(F.col("gone"), alone.get(k, no).cast("int")).otherwise(n).cast("long").alias(f"n_{k}") for k, n in inside.items()]
    record = lambda element, kind, a, b: F.struct(element.cast("string").alias("element"), kind.cast("string").alias("kind"), a.cast("string").alias("left"), b.cast("string").alias("right"))
    numbered = F.transform("m", lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    bad = lambda kind: F.coalesce(kind != "clean", no)
    together = lambda a: F.array_join(a, "\n")
    inner = F.concat(
        *[F.when(bad(F.col(f"_{c}.kind")), F.array(record(F.lit(c), F.col(f"_{c}.kind"), F.col(f"_{c}.left"), F.col(f"_{c}.right")))).otherwise(_no_records()) for c in COLUMNS],
        F.transform(F.filter(numbered, lambda x: bad(x["e"]["kind"])), lambda x: record(x["i"], x["e"]["kind"], x["e"]["left"], x["e"]["right"])),
        F.transform(F.filter(numbered, lambda x: bad(x["e"]["gap"])), lambda x: record(x["i"], x["e"]["gap"], together(x["e"]["l_after"]), together(x["e"]["r_after"]))),
    )
    whole_row = F.when(F.col("lost"), F.array(record(F.lit("row"), F.lit("edit_delete"), F.when(F.col("l_dropped"), F.lit("dropped")).otherwise(F.lit("changed")), F.when(F.col("r_dropped"), F.lit("dropped")).otherwise(F.lit("changed"))))).otherwise(_no_records())
    present = ~F.col("gone") | (F.col("lost") & F.col("l_dropped"))
    state = [F.when(F.col("present"), F.col(f"_{c}.value")).alias(c) for c in COLUMNS]
    return rows.withColumn("present", present).select("id", "present", *state, F.when(F.col("present"), visible(F.col("m"))).alias("text"), *numbers, F.when(F.col("gone"), whole_row).otherwise(inner).alias("conflicts"))


def _no_records() -> Column:
    return F.array().cast("array<struct<element:string,kind:string,left:string,right:string>>")


def _merged_additions(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    sided = lambda d, s: d.select("id", F.lit(s).alias("side"), F.struct(*COLUMNS, "text").alias("row"))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("row"))).alias(s)
    both = sided(left, "l").union(sided(right, "r")).groupBy("id").agg(of("l"), of("r"))
    both = both.join(base.select("id").hint("merge"), "id", "left_anti")
    conflict = F.coalesce(F.col("l") != F.col("r"), F.lit(False))
    as_text = lambda s: F.concat_ws("\n", *[F.col(f"{s}.{c}") for c in (*COLUMNS, "text")])
    records = F.when(conflict, F.array(F.struct(F.lit("row").alias("element"), F.lit("insert_insert").alias("kind"), as_text("l").alias("left"), as_text("r").alias("right")))).otherwise(_no_records())
    value = F.coalesce("r", "l")
    numbers = {"clean": ~conflict, "insert_insert": conflict}
    return both.select(
        "id", F.lit(True).alias("present"), *[value[c].alias(c) for c in (*COLUMNS, "text")],
        *[numbers.get(k, F.lit(False)).cast("long").alias(f"n_{k}") for k in KINDS], records.alias("conflicts"),
    )


def merge_report(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, text_sha256`` and numbers of the merge of the branches L and R of ``docs``."""
    merged = merge(base_table(docs), coded_branch(docs, "L"), coded_branch(docs, "R"))
    return merged.select(give_back(F.col("id")).alias("doc_id"), *COLUMNS, F.sha2("text", 256).alias("text_sha256"), *[f"n_{k}" for k in KINDS])
