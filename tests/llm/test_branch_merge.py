"""The three-way merge against a plain merge of one document at a time."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tessera.llm import branch_merge

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NONE = object()


def plain_merge(rows):
    base = {}
    for i, text, lang, source in rows:
        value = (lang or "", source or "", text or "")
        base[i] = max(base.get(i, value), value)
    out, added = {}, {"L": {}, "R": {}}
    for i, (lang, source, text) in base.items():
        code = lambda b, name: zlib.crc32(f"{b}:{'' if i is None else i}:{name}".encode()) % 7  # noqa: B023, E731
        for b in "LR":
            if (c := code(b, "row")) in (3, 4):
                added[b][None if i is None else -1 - i] = (lang, source, "!?"[c - 3])
        state, counts, changes = {}, dict.fromkeys(["clean", "edit_edit", "edit_delete", "insert_insert"], 0), dict.fromkeys("LR", 0)
        own = {b: {} for b in "LR"}
        lines = text.split("\n")
        for name, old in [("lang", lang), ("source", source), *enumerate(lines)]:
            line = isinstance(name, int)
            new = [{0: NONE if line else "", 1: old + "!", 2: old + "?"}.get(code(b, name), old) for b in "LR"]
            registers = [(name, old, new, "edit")]
            if line:
                registers.append(((name, "gap"), "", ["!?"[code(b, name) - 3] if code(b, name) in (3, 4) else "" for b in "LR"], "insert"))
            for key, was, (l, r), kind in registers:  # noqa: E741
                for b, v in zip("LR", (l, r), strict=True):
                    changes[b] += v != was
                    own[b][key] = v
                state[key] = r if r != was else l
                if l != was and r != was and l != r:
                    counts["insert_insert" if kind == "insert" else "edit_delete" if NONE in (l, r) else "edit_edit"] += 1
                elif l != was or r != was:
                    counts["clean"] += 1
        gone = {b: code(b, "row") == 0 for b in "LR"}
        if any(gone.values()):
            lost = any(gone[a] and not gone[b] and changes[b] for a, b in ("LR", "RL"))
            counts = {"clean": int(not lost), "edit_edit": 0, "edit_delete": int(lost), "insert_insert": 0}
            state = own["R"] if lost and gone["L"] else None
        parts = state and [v for k in range(len(lines)) for v in (state[k], state[k, "gap"] or NONE) if v is not NONE]
        out[i] = (*(state and (state["lang"], state["source"], digest("\n".join(parts))) or (None,) * 3), *counts.values())
    for i in added["L"].keys() | added["R"].keys():
        if i not in base:
            l, r = added["L"].get(i), added["R"].get(i)  # noqa: E741
            bad = int(None not in (l, r) and l != r)
            value = r or l
            out[i] = (*value[:2], digest(value[2]), 1 - bad, 0, 0, bad)
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def got(docs):
    found = branch_merge.merge_report(docs).collect()
    out = {r.doc_id: (r.lang, r.source, r.text_sha256, r.n_clean, r.n_edit_edit, r.n_edit_delete, r.n_insert_insert) for r in found}
    assert len(out) == len(found)
    return out


def test_merge_equals_plain_merge(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["", "a", "b!", "wörd", "x" * 50]) for _ in range(rng.randrange(1, 12))), rng.choice(["en", "", None]), rng.choice(["s", None])) for i in range(400)]
    # repeated ids, texts without lines, an id that an added row takes, no id, a long text
    rows += [(5, "other", "zz", "t"), (5, "other", "zz", "t"), (401, None, "en", "s"), (402, "", "en", "s"), (403, "\n", "en", "s"), (None, "no id", "en", None), (None, None, None, None)]
    rows += [(-1 - i, "taken", "en", "s") for i in range(0, 400, 9)] + [(404, "line\n" * 30_000, "en", "s")]
    want = plain_merge(rows)
    assert {k for v in want.values() for k, n in enumerate(v[3:]) if n} == {0, 1, 2, 3} and any(v[2] is None for v in want.values())
    docs = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], DOCS)
    for name in ("id", "row", "m", "lines", "present", "l_lang", "kind", "side"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert got(docs) == want
    assert got(docs.repartition(13)) == want
    assert got(docs.limit(0)) == {}


def test_merge_of_given_branches_records_conflicts(spark):
    base = spark.createDataFrame([(1, "en", "s", "one\ntwo\nthree"), (2, "en", "s", "kept")], "id long, lang string, source string, text string")
    edits = "id long, dropped boolean, lang string, source string, lines array<struct<dropped:boolean,text:string,after:array<string>>>"
    added = "id long, lang string, source string, text string"
    left = branch_merge.Branch(
        spark.createDataFrame([(1, False, "fr", None, [(True, None, ["after a tombstone", "and another"]), (None, "zwei", None)]), (2, True, None, None, None)], edits),
        spark.createDataFrame([(9, "en", "s", "new")], added),
    )
    right = branch_merge.Branch(
        spark.createDataFrame([(1, None, "de", None, [None, (None, "deux", None), (None, None, ["end"])]), (2, None, None, None, [(None, "kept and changed", None)])], edits),
        spark.createDataFrame([(9, "en", "s", "newer")], added),
    )
    out = {r.id: r for r in branch_merge.merge(base, left, right).collect()}
    assert out[1].text == "after a tombstone\nand another\ndeux\nthree\nend" and out[1].lang == "de"
    assert [tuple(c) for c in out[1].conflicts] == [("lang", "edit_edit", "fr", "de"), ("1", "edit_edit", "zwei", "deux")]
    assert (out[1].n_clean, out[1].n_edit_edit) == (3, 2)
    assert out[2].present and out[2].text == "kept and changed" and [tuple(c) for c in out[2].conflicts] == [("row", "edit_delete", "dropped", "changed")]
    assert out[9].text == "newer" and out[9].n_insert_insert == 1


def test_nothing_goes_to_one_task_or_is_broadcast(spark, sf_dir):
    plan = branch_merge.merge_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan.write.format("noop").mode("overwrite").save()
    final = plan._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in final and "SinglePartition" not in final
