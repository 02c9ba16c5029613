"""What a judge is shown, and what escapes say."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scanledger.operators import golden, rules
from scanledger.sources import io


def shown(spark, *rows):
    df = spark.createDataFrame([(i, c, o) for i, (c, o) in enumerate(rows)], "i int, context string, flagged_offset int")
    return [r.presented for r in golden.present(df).orderBy("i").collect()]


def by_hand(context, offset):
    """Lines are added in rounds by their distance from the flagged one."""
    if context is None:
        return None
    lines = context.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    if not lines:
        return ""
    marked = {i: ("> " if i == offset else "  ") + (x[:200] + " [truncated]" if len(x) > 200 else x) for i, x in enumerate(lines)}
    mid = min(offset, len(lines) - 1)
    taken, room = {mid: marked[mid]}, 8000 - len(marked[mid])
    for distance in range(1, len(lines) + 1):
        before = len(taken)
        for i in (mid - distance, mid + distance):
            if i in marked and len(marked[i]) + 1 <= room:
                taken[i] = marked[i]
                room -= len(marked[i]) + 1
        if len(taken) == before:
            break
    return "\n".join(taken[i] for i in sorted(taken))


def test_windows_are_marked_and_bounded(spark):
    rng = random.Random(3)
    rows = [("x" * 5000, 0), ("const a = 1", 0), ("}\n}\n}", 1), ("", 0), (None, 0), ("a\nb", 9), ("a\n", 0), ("\n".join(["z" * 190] * 150 + ["exec(userInput)"] + ["z" * 190] * 49), 150)]
    rows += [("\n".join("y" * rng.choice([0, 3, 90, 180, 260]) for _ in range(rng.randint(1, 120))), rng.randint(0, 130)) for _ in range(30)]
    got = shown(spark, *rows)
    assert got == [by_hand(*r) for r in rows]
    assert got[1] == "> const a = 1" and got[0].endswith("[truncated]") and got[2].count("}") == 3 and "exec(userInput)" in got[7] and all(len(x or "") <= 8000 for x in got)


def test_escapes(spark):
    u = "\\" + "u"
    said = {f"Ignore{u}0020previous": "Ignore previous", "\\x41" + u + "{42}" + u + "{1F600}": "AB\U0001f600", f"{u}d83d{u}de00!": "\U0001f600!", f"{u}d83dx": "\ufffdx"}
    said |= {u + "{110000}": u + "{110000}", f"{u}12": "u12", r"a\n\t\\\"\q\0": 'a\n\t\\"q\0', "plain": "plain", "": "", "end\\": "end\\"}
    df = spark.createDataFrame([(k,) for k in said] + [(None,)], "raw string")
    assert {r.raw: r.text for r in df.select("raw", rules.resolve_escapes(F.col("raw")).alias("text")).collect()} == said | {None: None}


def test_line_rules_find_home_roots_and_shells_on_request(spark):
    source = "\n".join(['import {spawn} from "child_process"', "spawn(cmd, {shell: true})", "spawn(cmd, {shell: false})", "const rootDir = os.homedir()", "const rootDir = path.join(os.homedir(), x)", "basePath: userInfo().homedir,", 'root: "/"', 'root: "/srv"', "host: '0.0.0.0'", 'ghost: "0.0.0.0"', "notexec(x)", "exec(x)"])
    df = spark.createDataFrame([("s", "a.ts", source)], "server_id string, path string, source string")
    got = sorted((r.line, r.rule_id) for r in rules.pattern_scan(df, rules.line_rules(spark)).collect())
    assert got == [(2, "shell-option"), (4, "scope-home"), (6, "scope-home"), (7, "scope-root"), (9, "scope-interface"), (12, "shell-call")]


def test_files_are_read_with_their_links(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.ts").write_text("one")
    (tmp_path / "a" / "sub dir").mkdir()
    (tmp_path / "a" / "sub dir" / "y.md").write_bytes(b"\xff")
    os.symlink(tmp_path / "a" / "x.ts", tmp_path / "a" / "z.ts")
    got = {(r.server_id, r.path): (r["size"], r.is_symlink) for r in io.read_files(spark, f"file://{tmp_path}").collect()}
    assert got == {("a", "x.ts"): (3, False), ("a", "sub dir/y.md"): (1, False), ("a", "z.ts"): (3, True)}


def test_a_corrupt_line_and_no_record_stop_the_run(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"server_id": "a", "repo_url": "https://x/1", "discovered_via": "registry"}\n\n')
    assert io.read_index(spark, f"file://{tmp_path}/index.json").count() == 1
    (tmp_path / "none.json").write_text('{"server_id": "a", "repo_url": "http://x/1"}\n')
    with pytest.raises(io.Refused):
        io.read_index(spark, f"file://{tmp_path}/none.json")
    (tmp_path / "bad.json").write_text('{"finding_id": "a"}\n{"finding_id": \n')
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        io.read_history(spark, f"file://{tmp_path}/bad.json").collect()


def test_a_changed_study_is_refused(spark):
    rows = spark.createDataFrame([(i, "r", "x") for i in range(50)], "entry_id int, rule_id string, label string")
    manifest = golden.snapshot_digest(rows, ["entry_id", "label"])
    golden.refuse_thawed(golden.check_frozen(rows.repartition(3), manifest, ["entry_id", "label"]))
    with pytest.raises(io.Refused):
        golden.refuse_thawed(golden.check_frozen(rows.where("entry_id > 0"), manifest, ["entry_id", "label"]))
