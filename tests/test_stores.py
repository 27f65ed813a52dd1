"""K8 / U3 through a file system that ``open()`` does not serve."""
import os

from trapline.sinks import files, stores

PLAN = "image_path string, dest_path string, folder_key string, dest_name string"


def uri(path):
    return "file://" + str(path)


def test_copy_and_move_by_uri(spark, tmp_path):
    src, dest = tmp_path / "src", tmp_path / "dest"
    src.mkdir()
    for n in ("a.jpg", "b.jpg", "c.jpg"):
        (src / n).write_bytes(n.encode() * 1000)
    (dest / "F").mkdir(parents=True)
    (dest / "F" / "c.jpg").write_bytes(b"other")
    rows = [(uri(src / n), uri(dest / "F" / n), "F", n) for n in ("a.jpg", "b.jpg", "c.jpg", "gone.jpg")]
    rows.append(("nowhere://x/y.jpg", uri(dest / "y.jpg"), "", "y.jpg"))
    plan = spark.createDataFrame(rows, PLAN)
    status = lambda df: {os.path.basename(r.image_path): r.status for r in df.collect()}
    want = {"a.jpg": "copied", "b.jpg": "copied", "c.jpg": "failed", "gone.jpg": "failed", "y.jpg": "failed"}
    first = files.execute_routing(plan)
    assert status(first) == want == status(first)  # a written table: read twice, copied once
    assert status(files.execute_routing(plan)) == {**want, "a.jpg": "exists", "b.jpg": "exists"}
    assert (dest / "F" / "a.jpg").read_bytes() == b"a.jpg" * 1000 and (dest / "F" / "c.jpg").read_bytes() == b"other"
    moved = files.execute_routing(plan, mode="move", status_path=str(tmp_path / "status"))
    assert status(moved) == {**want, "a.jpg": "moved", "b.jpg": "moved"}
    assert sorted(os.listdir(src)) == ["c.jpg"] and sorted(os.listdir(dest / "F")) == ["a.jpg", "b.jpg", "c.jpg"]


def test_retries_and_broken_copies(tmp_path, monkeypatch):
    src, dest = tmp_path / "a.jpg", tmp_path / "out" / "a.jpg"
    src.write_bytes(b"x" * 10)
    copy = stores._copy

    def torn(a, b):  # a copy that loses its end
        with b[0].open_output_stream(b[1]) as out:
            out.write(b"x")
        return stores._digest(a)

    monkeypatch.setattr(stores, "_copy", torn)
    assert files._place(uri(src), uri(dest), False)[0] == "failed" and os.listdir(dest.parent) == []

    def raced(a, b):  # another attempt of the task ends first
        dest.write_bytes(src.read_bytes())
        return copy(a, b)

    monkeypatch.setattr(stores, "_copy", raced)
    assert files._place(uri(src), uri(dest), False) == ("exists", None) and os.listdir(dest.parent) == ["a.jpg"]
    monkeypatch.setattr(stores, "_copy", copy)
    assert files._remove(uri(src), uri(src)) == ("exists", None) and src.exists()
    dest.write_bytes(b"y" * 10)
    assert files._remove(uri(src), uri(dest))[0] == "failed" and src.exists()
    dest.write_bytes(b"x" * 10)
    assert files._remove(uri(src), uri(dest))[0] == "moved" and not src.exists()
    assert files._remove(uri(src), uri(dest))[0] == "moved"  # retried after the deletion
    assert files._remove(uri(src), uri(tmp_path / "none"))[0] == "failed"
