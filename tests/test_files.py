"""File hashing."""

import hashlib

from slopeline.catalog import run
from slopeline.sources import files


def test_long_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """The streamed digest is that of the whole file, and short and long files are all there."""
    monkeypatch.setattr(files, "HASHED_BYTES", 1000)
    content = {"a.txt": b"a", "b.csv": b"x" * 1000, "sub dir/c%20d.bin": bytes(range(256)) * 40_000, "sub dir/é.json": b"{}" * 700}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {r.size_bytes: r.sha256 for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert found == {len(d): hashlib.sha256(d).hexdigest() for d in content.values()}


def test_a_file_above_two_gigabytes_has_its_hash(spark, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(3_000_000_000)
    digest = hashlib.sha256()
    for _ in range(3000):
        digest.update(bytes(1_000_000))
    row = files.file_inventory(spark, str(tmp_path)).first()
    assert (row.size_bytes, row.sha256) == (3_000_000_000, digest.hexdigest())


def test_tables_written_as_folders_are_one_line_each(spark, small, tmp_path):
    """Folders of files, a folder of the root's name inside it, and a stray file change no status."""
    root = tmp_path / "x" / "x"
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        rows.repartition(2 if name in ("part", "orders", "lineitem", "nation") else 1).write.parquet(str(root / f"{name}.parquet"))
    spark.range(3).write.parquet(str(root / "other.parquet"))
    got = sorted((r.relative_path, r.status) for r in run("a11_a12_manifest_verification", spark, str(root)).collect())
    want = sorted((r.relative_path, r.status) for r in run("a11_a12_manifest_verification", spark, small).collect())
    assert got == want and len(got) == 14


def test_a_changed_part_changes_its_table(spark):
    lines = lambda *rows: files.table_manifest(spark.createDataFrame(rows, "relative_path string, sha256 string, size_bytes long"))
    a = lines(("t.parquet/a.parquet", "1", 5), ("t.parquet/b.parquet", "2", 6), ("u.parquet", "3", 7), ("v.parquet/a.parquet", None, 1))
    b = lines(("t.parquet/b.parquet", "2", 6), ("t.parquet/a.parquet", "4", 5), ("u.parquet", "3", 7), ("v.parquet/a.parquet", None, 1))
    assert {r.relative_path: r.status for r in files.verify_manifest(a, b).collect()} == {"t.parquet": "MISMATCH", "u.parquet": "OK", "v.parquet": "UNHASHED"}
    assert {r.relative_path: r.size_bytes for r in a.collect()} == {"t.parquet": 11, "u.parquet": 7, "v.parquet": 1}
