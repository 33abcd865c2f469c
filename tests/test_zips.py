import io
import zipfile

from docloom.sources import zips


def zipped(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, body in entries:
            z.writestr(name, body)


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.name or "", r.text, r.reason) for r in df.collect())


def test_entries_are_accepted_or_refused_one_by_one(spark, tmp_path):
    zipped(tmp_path / "a.zip", [("d/one.md", "first"), ("two.TXT", "é"), ("three.pdf", "x"), (".hidden.md", "x"), ("bytes.md", b"\xff\xfe"), ("blank.md", " \n"), ("large.md", "x" * 500)])
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "note.md").write_text("not an archive")
    zipped(tmp_path / "bomb.zip", [("a.md", "0" * 3000), ("b.md", "0" * 3000)])
    good = io.BytesIO()
    zipped(good, [("ok.md", "kept"), ("bad.md", "abcdefgh")], zipfile.ZIP_STORED)
    (tmp_path / "half.zip").write_bytes(good.getvalue().replace(b"abcdefgh", b"abcdefgX"))  # the checksum does not hold
    got = rows(zips.read_zips(spark, f"file://{tmp_path}", entry_bytes=400, unzipped_bytes=5000))
    assert got == [
        ("a.zip", ".hidden.md", None, "name"), ("a.zip", "blank.md", None, "blank"), ("a.zip", "bytes.md", None, "not_utf8"), ("a.zip", "large.md", None, "too_large"), ("a.zip", "one.md", "first", None),
        ("a.zip", "three.pdf", None, "extension"), ("a.zip", "two.TXT", "é", None), ("bomb.zip", "", None, "too_large"), ("broken.zip", "", None, "corrupt"), ("empty.zip", "", None, "corrupt"),
        ("half.zip", "bad.md", None, "corrupt"), ("half.zip", "ok.md", "kept", None),
    ]
    assert rows(zips.read_zips(spark, f"file://{tmp_path}/a.zip", extensions=".pdf"))[-2:] == [("a.zip", "three.pdf", "x", None), ("a.zip", "two.TXT", None, "extension")]
    (tmp_path / "none").mkdir()
    assert rows(zips.read_zips(spark, f"file://{tmp_path}/none")) == [] == rows(zips.read_zips(spark, f"file://{tmp_path}/missing"))


def test_splits_read_each_entry_once(spark, tmp_path):
    entries = [(f"{i:03}.md", f"text {i} " + chr(97 + i % 26) * (i * 37 % 900)) for i in range(300)]
    zipped(tmp_path / "one.zip", entries, zipfile.ZIP_STORED)
    df = zips.read_zips(spark, f"file://{tmp_path}", split_bytes=4000)
    assert df.rdd.getNumPartitions() > 20
    assert [(n, t) for _, n, t, _ in rows(df)] == entries


def test_archives_written_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(f"z{i % 5}", f"{i:03}.md", None if i == 7 else f"words {i}") for i in range(60)], "archive string, name string, text string")
    folder = f"file://{tmp_path}/out"
    assert {r.archive: r.entries for r in zips.write_zips(df, folder).collect()} == {f"z{k}": 12 for k in range(5)}
    back = {(r.path.rsplit("/", 1)[-1], r.name): (r.text, r.reason) for r in zips.read_zips(spark, folder).collect()}
    assert back == {(f"{r.archive}.zip", r.name): (r.text, None) if r.text else (None, "blank") for r in df.collect()}
    assert zips.write_zips(df.limit(0), folder).count() == 0
