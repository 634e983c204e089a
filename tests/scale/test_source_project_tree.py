"""contents join nothing, so they can't be broadcast; what is too large or a folder keeps its row."""

from quern.sources import files


def test_contents_do_not_go_through_the_driver(spark, tmp_path):
    for name, text in (("p/a.py", "x\r\ny"), ("p/big.txt", "z" * 100), ("q/.github/w.yml", "w"), ("q/bad.md", None)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"a\xff" if text is None else text.encode())
    (tmp_path / "q/empty").mkdir()
    tree = files.project_tree(spark, str(tmp_path), most_bytes=50)
    assert "Join" not in tree._jdf.queryExecution().executedPlan().toString()
    got = {(r.project, r.rel_path): (r.length, r.content) for r in tree.collect()}
    assert got == {("p", "a.py"): (4, "x\ny"), ("p", "big.txt"): (100, None), ("q", ".github/w.yml"): (1, "w"), ("q", "bad.md"): (2, "a�"), ("q", "empty/"): (0, None)}
