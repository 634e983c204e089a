"""a folder is listed as it is read, so its size is no matter for a task's memory."""

import os
import tracemalloc

from pyarrow import fs as afs

from quern.sources import files


def test_large_folder_takes_little_memory(tmp_path):
    os.mkdir(tmp_path / "d")
    for k in range(20_000):
        os.mknod(tmp_path / f"d/{k:06}-{'x' * 40}.md")
    tracemalloc.start()
    n = sum(1 for _ in files._local(str(tmp_path), "d", False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 1 << 20


def test_both_listings_agree(tmp_path):
    for name in ("d/a.md", "d/_b/100%.md", "d/.c/x y.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "d/e/f").mkdir(parents=True)
    os.symlink(tmp_path / "d/_b", tmp_path / "d/link")
    os.symlink(tmp_path / "nowhere", tmp_path / "d/dangling")
    for deep in (True, False):
        here = sorted(files._local(str(tmp_path), "d", deep))
        assert here == sorted(files._remote(afs.LocalFileSystem(), str(tmp_path), "d", deep)) and ("d/e/f/" in [p for p, *_ in here]) is deep
    assert list(files._local(str(tmp_path), "none", True)) == [] == list(files._remote(afs.LocalFileSystem(), str(tmp_path), "none", True))
