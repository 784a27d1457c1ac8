import json
import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from fernpath import schema
from fernpath.operators import build, render
from fernpath.operators import index as idx
from fernpath.operators.search import search
from fernpath.sources import ignores, walk


def _rows(spark, rows):
    return spark.createDataFrame(rows, schema.FILES)


def test_written_index(spark, tmp_path):
    files = _rows(spark, [(f"/tmp/file_{i:04d}.txt", i % 10, i, 0o644, "text/plain") for i in range(1000)][::-1])
    build.write(files, str(tmp_path / "db"), indexed_paths=["/tmp"], timestamp=0)
    found = build.read(spark, str(tmp_path / "db"), verify=True)
    table, posted, about = found.files, found.postings, found.about
    assert search(table, ["file_099"], index=found).count() == 10 and not os.path.exists(tmp_path / "db.lock")
    assert idx.with_extension(table, posted, "txt").count() == idx.in_folder(table, posted, "/", below=True).count() == idx.in_folder(table, posted, "/tmp").count() == 1000
    assert build.postings_bytes(spark, str(tmp_path / "db")) > 0
    rows = table.orderBy("full_path").collect()
    assert [r.doc_id for r in rows] == list(range(1000)) and rows[-1].full_path == "/tmp/file_0999.txt"
    assert search(table, ["file_099"], index=posted).count() == 10
    report = json.loads(build.report("db", posted, about).first().report)
    assert report["indexed_files"] == 1000 and report["last_indexed"] == "1970-01-01T00:00:00+00:00" and report["total_bytes_indexed"] == 4500
    build.write(files.limit(3), str(tmp_path / "db"))
    assert build.read(spark, str(tmp_path / "db"))[0].count() == 3
    with pytest.raises(build.IndexError_):
        build.read(spark, str(tmp_path / "none"))


def test_damaged_index(spark, tmp_path):
    where = str(tmp_path / "db")
    build.write(_rows(spark, [(f"/x/{i}", i, i, 0, "y") for i in range(50)]), where)
    good = build.read(spark, where, verify=True).files
    version = next(p for p in (tmp_path / "db").iterdir() if p.name.startswith("v"))
    good.withColumn("size", F.expr("if(doc_id = 7, size + 1, size)")).write.parquet(f"{version}/other")
    shutil.rmtree(version / "files")
    (version / "other").rename(version / "files")
    assert build.read(spark, where).files.count() == 50  # as many rows: only reading them all shows it
    with pytest.raises(build.IndexError_, match="damaged"):
        build.read(spark, where, verify=True)
    part = next(p for p in (version / "files").iterdir() if p.name.endswith(".parquet"))
    part.write_bytes(part.read_bytes()[:16])
    for x in (version / "files").glob(".*.crc"):
        x.unlink()
    with pytest.raises(build.IndexError_, match="damaged"):
        build.read(spark, where)


def test_update(spark, tmp_path):
    where, rows = str(tmp_path / "db"), [(f"/x/{i}", i, i, 0o644, "y") for i in range(20)]
    with pytest.warns(UserWarning, match="anew"):
        assert build.update(_rows(spark, rows), where) == "rebuild"
    assert build.update(_rows(spark, rows), where) == "update" and len(list((tmp_path / "db").glob("v*"))) == 1
    rows[3] = ("/x/3", 3, 3, 0o600, "y")  # the mode alone has changed
    assert build.update(_rows(spark, rows), where) == "update"
    assert sorted(build.read(spark, where).files.select(*schema.COLUMNS).collect()) == sorted(_rows(spark, rows).collect())
    assert build.update(_rows(spark, rows[:5]), where, force=True) == "rebuild" and build.read(spark, where).files.count() == 5
    with build.Lock(where), pytest.raises(build.IndexError_, match="exists"):
        build.write(_rows(spark, rows), where)


def test_interrupted_write(spark, tmp_path, monkeypatch):
    where, files = str(tmp_path / "db"), _rows(spark, [("/a", 1, 1, 0, "x")])
    build.write(files, where)

    def interrupted(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(build, "_checksum", interrupted)
    with pytest.raises(KeyboardInterrupt):
        build.write(files.union(files), where)
    monkeypatch.undo()
    assert [p.name for p in (tmp_path / "db").glob("v*")] == ["v000000000001"] and not os.path.exists(where + ".lock")
    assert build.read(spark, where, verify=True).total == 1


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([("/dup", 0, 0), ("/dup", 999, 1), ("/x", 5, 2)], "full_path string, size long, seq long")
    assert {(r.full_path, r.size) for r in build.dedup(rows).collect()} == {("/dup", 0), ("/x", 5)}


def test_prunes_whole_components(spark):
    rows = spark.createDataFrame([("/a/b",), ("/a/bc",), ("/a/b/c",)], "full_path string")
    assert [r.full_path for r in build.pruned(rows, ["/a/b"]).collect()] == ["/a/bc"]


def test_update_equals_rebuild(spark):
    old = _rows(spark, [("/a", 1, 1, 0, "x"), ("/b", 2, 2, 0, "x"), ("/c", 3, 3, 0, "x")])
    new = _rows(spark, [("/a", 1, 1, 7, "x"), ("/b", 9, 2, 0, "x"), ("/d", 4, 4, 0, "x")])
    assert sorted(build.updated(old, new).collect()) == sorted(new.collect())
    assert {tuple(r) for r in build.changes(old, new).collect()} == {("/b", "modified"), ("/c", "removed"), ("/d", "added")}


def test_lock(tmp_path):
    with build.Lock(str(tmp_path / "db")):
        with pytest.raises(build.IndexError_), build.Lock(str(tmp_path / "db")):
            pass
    assert not os.path.exists(tmp_path / "db.lock")


def test_walk(spark, tmp_path):
    for name in ("a/x.rs", "a/.hidden", "b/deep/y", "skip/z.txt", "skipped/k.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-1" if name.endswith("y") else b"")
    (tmp_path / "a/link").symlink_to(tmp_path / "b/deep/y")
    (tmp_path / "a/broken").symlink_to(tmp_path / "nothing")
    (tmp_path / "a/folder").symlink_to(tmp_path / "b")
    roots = [str(tmp_path), str(tmp_path / "a"), str(tmp_path / "missing")]
    counts = walk.Counts()
    found = {r.full_path: r for r in walk.crawl(spark, roots, [str(tmp_path / "skip")], quiet=True, counts=counts).collect()}
    assert (counts.folders, counts.skipped, counts.added, counts.denied) == (5, 2, 5, 0) and counts.scanned == 12
    assert {os.path.relpath(p, tmp_path) for p in found} == {"a/x.rs", "a/.hidden", "b/deep/y", "skipped/k.txt"}
    assert found[f"{tmp_path}/b/deep/y"].mime_type == "application/pdf" and found[f"{tmp_path}/a/x.rs"].mime_type == "text/x-rust"
    spread = walk.crawl_spread(spark, roots, [str(tmp_path / "skip")])
    assert sorted(spread.collect()) == sorted(tuple(found[p]) for p in found)
    assert walk.listing(spark, str(tmp_path)).where("size = 6").count() >= 1


def test_ignore_files(spark, tmp_path):
    for name in ("top.log", "keep.log", "build/x", "src/build/y", "src/a.tmp", "src/deep/b.tmp", "src/deep/keep.tmp", "plain/c.o", "docs/x/z.txt", "docs/z.txt"):
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text("")
    (tmp_path / "repo/.git").mkdir()
    (tmp_path / "repo/.gitignore").write_text("# logs\n*.log\n!keep.log\n/build/\ndocs/**/z.txt\n.git\n.gitignore\n.ignore\n")
    (tmp_path / "repo/src/.gitignore").write_text("*.tmp\n!deep/keep.tmp\n")
    (tmp_path / "repo/plain/.ignore").write_text("*.o\n")
    found = {os.path.relpath(p, tmp_path / "repo") for p in walk.walk([str(tmp_path)])}
    assert found == {"keep.log", "src/build/y", "src/deep/keep.tmp"}
    assert {os.path.relpath(r.full_path, tmp_path / "repo") for r in walk.crawl_spread(spark, [str(tmp_path)], []).collect()} == found
    (tmp_path / "repo/.git").rmdir()  # without a repository only .ignore holds
    assert {"top.log", "build/x", "src/a.tmp"} <= {os.path.relpath(p, tmp_path / "repo") for p in walk.walk([str(tmp_path)])}
    assert {os.path.relpath(p, tmp_path / "repo") for p in walk.walk([str(tmp_path / "repo/plain")])} == {"plain/.ignore"}


@pytest.mark.parametrize(
    "rule, path, folder, ignored",
    [("a?c", "x/abc", False, True), ("a?c", "x/a/c", False, False), ("x/*.o", "x/y.o", False, True), ("x/*.o", "x/z/y.o", False, False), ("**/t", "a/b/t", False, True), ("a/**", "a/b/c", False, True), ("a/**/d", "a/d", False, True), ("d/", "d", True, True), ("d/", "d", False, False), ("[!ab]z", "cz", False, True), ("[!ab]z", "az", False, False), (r"\#n", "#n", False, True), ("a\\ ", "a ", False, True)],
)
def test_ignore_rules(rule, path, folder, ignored):
    assert bool(ignores._verdict(ignores.parsed(rule), path, folder)) is ignored


def test_output(spark):
    files = _rows(spark, [("/b", 2048, 100, 1, "x/y"), ("/a", 1, 50, 2, "x/y")])
    assert json.loads("".join(render.json_array(files))) == [{"path": "/a", "size": 1, "mtime": 50, "mode": 2, "mime_type": "x/y"}, {"path": "/b", "size": 2048, "mtime": 100, "mode": 1, "mime_type": "x/y"}]
    assert "".join(render.json_array(files.limit(0))) == "[]" or json.loads("".join(render.json_array(files.limit(0)))) == []
    assert "".join(render.terminated(files)) == "/a\0/b\0"
    assert list(render.table(files, 160))[1].split() == ["1", "B", "1", "minutes", "ago", "/a"]
    plain, painted = list(render.table(files, 160, icons=True)), list(render.table(files, 160, icons=True, colour=True))
    assert [re.sub("\x1b\\[[0-9;]*m", "", x) for x in painted] == plain and "\x1b[1;97ma\x1b[0m" in painted[1]
    assert list(render.table(files, 160, colour=True)) != list(render.table(files, 160)) and list(render.table(files, 160, width=40)) == ["/a", "/b"]
