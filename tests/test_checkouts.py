"""Checkouts are listed without following links."""

import os

from scanledger.operators import files
from scanledger.sources import io


def test_links_are_told_and_never_followed(spark, tmp_path):
    root, outside = tmp_path / "checkouts", tmp_path / "outside"
    (outside / "deep").mkdir(parents=True)
    (outside / "secret.ts").write_text("host secret")
    (outside / "deep" / "more.ts").write_text("more")
    for server in ("a", "b"):
        (root / server / "src").mkdir(parents=True)
        (root / server / "src" / "x.ts").write_text(server * 3)
    os.symlink(outside / "secret.ts", root / "a" / "out.ts")
    os.symlink(root / "a" / "src" / "x.ts", root / "a" / "again.ts")
    os.symlink(outside, root / "a" / "folder")
    os.symlink(root / "a", root / "a" / "src" / "loop")
    os.symlink(tmp_path / "nowhere", root / "b" / "broken.ts")
    os.symlink(outside, root / "linked")  # no server
    (root / "stray.ts").write_text("no server")
    (root / "b" / ".hidden.ts").write_text("h")
    (root / "b" / "big.ts").write_text("z" * 500)
    df = io.read_files(spark, f"file://{root}", most_bytes=100)
    got = {(r.server_id, r.path): (bytes(r.content).decode() if r.content is not None else None, r.is_symlink) for r in df.collect()}
    assert got == {
        ("a", "src/x.ts"): ("aaa", False), ("a", "out.ts"): (None, True), ("a", "again.ts"): (None, True), ("a", "folder"): (None, True), ("a", "src/loop"): (None, True),
        ("b", "src/x.ts"): ("bbb", False), ("b", "broken.ts"): (None, True), ("b", ".hidden.ts"): ("h", False), ("b", "big.ts"): (None, False),
    }
    skipped = {(r.server_id, r.path, r.reason) for r in files.skipped_files(df.where("path like '%.ts'")).collect()}
    assert {s[:2] for s in skipped if s[2] == "symlink"} == {("a", "out.ts"), ("a", "again.ts"), ("b", "broken.ts")}


def test_server_folders_of_two_levels_and_odd_names(spark, tmp_path):
    os.makedirs(os.path.join(os.fsencode(str(tmp_path)), b"c/own er/r\xff/d"))
    with open(os.path.join(os.fsencode(str(tmp_path)), b"c/own er/r\xff/d/f \xc3\xbc.py"), "wb") as f:
        f.write(b"\xff")
    for i in range(70):  # more than one partition
        os.makedirs(tmp_path / "c" / "many" / f"s{i}")
        (tmp_path / "c" / "many" / f"s{i}" / "x.py").write_text(str(i))
    got = {(r.server_id, r.path): bytes(r.content) for r in io.read_files(spark, f"file://{tmp_path}/c", server_depth=2).collect()}
    assert got.pop(("own er/r\ufffd", "d/f ü.py")) == b"\xff"
    assert got == {(f"many/s{i}", "x.py"): str(i).encode() for i in range(70)}
    (tmp_path / "none").mkdir()
    assert io.read_files(spark, f"file://{tmp_path}/none").collect() == []
