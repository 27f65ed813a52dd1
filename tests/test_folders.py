"""Walking with a memory of folders, and past folders that can't be read."""
import os
import time

from trapline.sources import folders
from trapline.sources.folders import scan_tree, visit
from trapline.sources.images import list_images

OLD = time.time() - 3600


def tree(root, *names):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("x")


def settle(root):
    """Folder times in the past, as in an archive that rests."""
    for at, _, _ in os.walk(root):
        os.utime(at, (OLD, OLD))


def paths(scan, root):
    return sorted(os.path.relpath(r.path, root) for r in scan.files.collect())


def test_unchanged_folders_are_not_opened(spark, tmp_path):
    root, state = str(tmp_path / "archive"), str(tmp_path / "state")
    names = [f"cam{i}/d{j}/IMG_{k}.jpg" for i in range(3) for j in range(2) for k in range(4)] + ["notes.txt"]
    tree(root, *names)
    settle(root)
    first = scan_tree(spark, root, state)
    assert paths(first, root) == sorted(names) and first.counts()["folder"] == 10
    second = scan_tree(spark, root, state)
    assert paths(second, root) == sorted(names)
    assert second.counts() == {"same": 10}
    # a changed leaf, a new branch and a vanished one: only they and their parents are opened
    tree(root, "cam0/d0/new.jpg", "cam9/deep/er/x.jpg")
    for k in range(4):
        os.remove(os.path.join(root, f"cam2/d1/IMG_{k}.jpg"))
    os.rmdir(os.path.join(root, "cam2/d1"))
    third = scan_tree(spark, root, state)
    names = sorted([n for n in names if not n.startswith("cam2/d1")] + ["cam0/d0/new.jpg", "cam9/deep/er/x.jpg"])
    assert paths(third, root) == names
    counts = third.counts()
    assert counts["folder"] == 6 and counts["same"] == 6  # root, cam0/d0, cam2, cam9 and two below; the rest rests
    assert paths(scan_tree(spark, root, state), root) == names
    assert list_images(spark, root, state_path=state).count() == len(names) - 1


def test_a_fresh_time_is_not_trusted(spark, tmp_path):
    """A file added within the tick of the remembered time is found by the next run."""
    root, state = str(tmp_path / "a"), str(tmp_path / "s")
    tree(root, "d/1.jpg")
    now = time.time_ns()
    os.utime(os.path.join(root, "d"), ns=(now, now))
    assert scan_tree(spark, root, state).counts()["folder"] == 2
    tree(root, "d/2.jpg")
    os.utime(os.path.join(root, "d"), ns=(now, now))
    assert paths(scan_tree(spark, root, state), root) == ["d/1.jpg", "d/2.jpg"]


def test_vanished_and_unreadable_folders_are_rows(spark, tmp_path):
    root, state = str(tmp_path / "a"), str(tmp_path / "s")
    tree(root, "keep/1.jpg", "lost/2.jpg", "file/3.jpg")
    settle(root)
    scan_tree(spark, root, state)
    # the root looks unchanged, but a child is gone and another is no folder any more: as in a race with the walk
    os.remove(os.path.join(root, "lost/2.jpg"))
    os.rmdir(os.path.join(root, "lost"))
    os.remove(os.path.join(root, "file/3.jpg"))
    os.rmdir(os.path.join(root, "file"))
    tree(root, "file")
    settle(root)
    scan = scan_tree(spark, root, state)
    assert paths(scan, root) == ["keep/1.jpg"]
    got = {(os.path.relpath(r.path, root), r.kind, r.detail.split(":")[0]) for r in scan.problems.collect()}
    assert got == {("lost", "gone", "FileNotFoundError"), ("file", "error", "NotADirectoryError")}
    assert scan_tree(spark, str(tmp_path / "missing")).files.count() == 0


def test_errors_inside_a_folder(tmp_path, monkeypatch):
    tree(str(tmp_path), "ok.jpg", "gone.jpg")
    real = os.scandir

    class Entry:
        def __init__(self, e):
            self.e, self.name, self.path = e, e.name, e.path

        def is_dir(self, **k):
            return self.e.is_dir(**k)

        def is_file(self):
            return True

        def stat(self):
            if self.name == "gone.jpg":
                raise FileNotFoundError(2, "gone", self.path)
            return self.e.stat()

    class Listing(list):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    monkeypatch.setattr(folders.os, "scandir", lambda p: Listing(Entry(e) for e in real(p)))
    rows = list(visit(str(tmp_path)))
    assert [(r[1], os.path.basename(r[2])) for r in rows] == [("gone", "gone.jpg"), ("file", "ok.jpg"), ("folder", tmp_path.name)]

    def denied(p):
        raise PermissionError(13, "denied", p)

    monkeypatch.setattr(folders.os, "scandir", denied)
    assert [(r[1], r[7].split(":")[0]) for r in visit(str(tmp_path))] == [("error", "PermissionError")]


def test_remote_listing(spark, tmp_path):
    tree(str(tmp_path), "a/1.jpg", "2.png")
    got = {(r[1], r[2]) for r in visit(f"file://{tmp_path}")}
    assert got == {("sub", f"file://{tmp_path}/a"), ("file", f"file://{tmp_path}/2.png"), ("folder", f"file://{tmp_path}")}
    assert [r[1] for r in visit(f"file://{tmp_path}/none")] == ["gone"]
