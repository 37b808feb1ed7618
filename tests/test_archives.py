"""Archives as they are packed: one header a file, readable by any tar program, read back as they were."""

import os
import tarfile

from tracewell.sources import filesource


def test_whole_times_take_one_header(spark, tmp_path):
    rows = [(k % 2, f"src/f{k}.py", float(k) if k % 3 else k + 0.25, "x" * (k * 100)) for k in range(20)] + [
        (3, "é/" + "long" * 60 + ".py", 1.0, "y"), (3, "none.py", None, "z")]
    files = spark.createDataFrame(rows, "project_id int, path string, mtime double, content string")
    root = str(tmp_path / "packed")
    filesource.pack(files, root)
    found = {}
    for name in os.listdir(root):
        size = os.path.getsize(f"{root}/{name}")
        assert size % tarfile.RECORDSIZE == 0
        with tarfile.open(f"{root}/{name}") as archive:
            for m in archive:
                assert ("mtime" in m.pax_headers) == (m.mtime % 1 != 0)
                found[m.name] = (m.mtime, archive.extractfile(m).read().decode())
    assert found == {p: (t or 0, c) for _, p, t, c in rows}
    read = filesource.read_files(spark, root, []).collect()
    assert {(r.path, r.mtime, r.content.decode()) for r in read} == {(p, t or 0.0, c) for _, p, t, c in rows if c}
