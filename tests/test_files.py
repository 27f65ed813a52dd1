"""File-touching operators: listing (S1), EXIF (U2/P18), CSV in/out (S2/K2), copy/move (K8)."""
import os
import struct
import time

import pytest


from trapline.sinks.csv_excel import write_excel_csv
from trapline.sinks.files import execute_routing
from trapline.sources.detections_csv import read_detections_csv, typed_detections
from trapline.sources.exif import capture_dates, exif_dates
from trapline.sources.images import list_images


def touch(path, data=b"x", mtime=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    if mtime is not None:
        os.utime(path, (mtime, mtime))


def test_listing_extensions_and_skips(spark, tmp_path):
    root = str(tmp_path)
    for name in ("a.jpg", "b.JPG", "c.PnG", "d.txt", "e.tif", "f.tiff", "g.webp", "sub/h.jpeg", "sub/i.BMP",
                 "_hidden.jpg", ".dot.jpg"):
        touch(os.path.join(root, name))
    got = sorted(os.path.relpath(r.path, root) for r in list_images(spark, root).collect())
    assert got == [".dot.jpg", "_hidden.jpg", "a.jpg", "b.JPG", "c.PnG", "f.tiff", "g.webp", "sub/h.jpeg", "sub/i.BMP"]
    assert all(not r.path.startswith("file:") for r in list_images(spark, root).collect())
    assert list_images(spark, os.path.join(root, "missing")).count() == 0


def tiff_block(endian, ifd0_tags, exif_tags):
    """Little TIFF: IFD0 (+ pointer to an Exif IFD) with ASCII tags."""
    e = "<" if endian == "II" else ">"
    entries0 = dict(ifd0_tags)
    data = bytearray(endian.encode() + struct.pack(e + "HI", 42, 8))
    n0 = len(entries0) + (1 if exif_tags else 0)
    ifd0_size = 2 + 12 * n0 + 4
    exif_off = 8 + ifd0_size
    exif_size = 2 + 12 * len(exif_tags) + 4 if exif_tags else 0
    payload_off = exif_off + exif_size
    payload = bytearray()

    def entry(tag, value):
        nonlocal payload
        raw = value.encode() + b"\x00"
        off = payload_off + len(payload)
        payload += raw
        return struct.pack(e + "HHII", tag, 2, len(raw), off)

    ifd0 = bytearray(struct.pack(e + "H", n0))
    for tag, v in sorted(entries0.items()):
        ifd0 += entry(tag, v)
    if exif_tags:
        ifd0 += struct.pack(e + "HHII", 0x8769, 4, 1, exif_off)
    ifd0 += struct.pack(e + "I", 0)
    exif = bytearray()
    if exif_tags:
        exif += struct.pack(e + "H", len(exif_tags))
        for tag, v in sorted(exif_tags.items()):
            exif += entry(tag, v)
        exif += struct.pack(e + "I", 0)
    return bytes(data + ifd0 + exif + payload)


def jpeg(tiff):
    app1 = b"Exif\x00\x00" + tiff
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"


def test_exif_reader_both_byte_orders():
    for endian in ("II", "MM"):
        data = jpeg(tiff_block(endian, {306: "2021:01:02 03:04:05"},
                               {36867: "2022:03:14 09:26:53", 36868: "2022:03:15 00:00:00"}))
        assert exif_dates(data) == ("2022:03:14 09:26:53", "2022:03:15 00:00:00", "2021:01:02 03:04:05")
    assert exif_dates(b"\xff\xd8\xff\xe1\x00") == (None, None, None)  # truncated
    assert exif_dates(b"not an image") == (None, None, None)
    bad = bytearray(tiff_block("II", {306: "2021:01:02 03:04:05"}, {}))
    bad[4:8] = struct.pack("<I", 10_000)  # IFD offset out of range
    assert exif_dates(bytes(bad)) == (None, None, None)


def test_capture_date_priority(spark, tmp_path):
    root = str(tmp_path)
    mtime = time.mktime((2099, 1, 1, 12, 0, 0, 0, 0, -1))
    touch(f"{root}/a.jpg", jpeg(tiff_block("II", {306: "2022:03:14 09:26:53"}, {})), mtime)
    touch(f"{root}/b.jpg", jpeg(tiff_block("MM", {306: "2001:01:01 00:00:00"},
                                           {36867: "2020:05:06 07:08:09"})), mtime)
    touch(f"{root}/c.jpg", b"\xff\xd8garbage", mtime)
    touch(f"{root}/d.png", b"\x89PNG", mtime)
    got = {os.path.basename(r.image_path): r.capture_date
           for r in capture_dates(list_images(spark, root, with_content=True)).collect()}
    assert got["a.jpg"] == "2022-03-14"
    assert got["b.jpg"] == "2020-05-06"
    assert got["c.jpg"].startswith("2099-01-0") and got["d.png"].startswith("2099-01-0")


def test_csv_layouts_and_bom(spark, tmp_path):
    p8 = tmp_path / "eight.csv"
    p8.write_text("\ufeffimage_path,image_name,species,scientific_name,confidence,category,common_name,timestamp\n"
                  '/a.jpg,a.jpg,"Sus, scrofa",Sus scrofa,0.9,mammal,boar,t\n/b.jpg,b.jpg,,,oops,,,t\n',
                  encoding="utf-8")
    p10 = tmp_path / "ten.csv"
    p10.write_text("image_path,image_name,image_date,species,scientific_name,confidence,category,common_name,"
                   'japanese_name,timestamp\n/c.jpg,c.jpg,2024-01-01,X,X,0.5,bird,,"multi\nline",t\n',
                   encoding="utf-8")
    df = typed_detections(read_detections_csv(spark, [str(p8), str(p10)]))
    rows = {r.image_path: r for r in df.collect()}
    assert rows["/a.jpg"].species == "Sus, scrofa" and rows["/a.jpg"].image_date == ""
    assert rows["/b.jpg"].species == "" and rows["/b.jpg"].confidence == 0.0
    assert rows["/c.jpg"].japanese_name == "multi\nline" and rows["/c.jpg"].image_date == "2024-01-01"


def test_excel_csv_starts_with_bom(spark, tmp_path):
    out = str(tmp_path / "out")
    write_excel_csv(spark.createDataFrame([("a", 1)], "name string, n int"), out)
    part = [f for f in os.listdir(out) if f.startswith("part-")][0]
    with open(os.path.join(out, part), "rb") as f:
        head = f.read(3)
    assert head == b"\xef\xbb\xbf"
    back = read_detections_csv(spark, out)
    assert "name" in back.columns


def test_copy_and_move(spark, tmp_path):
    src = tmp_path / "src"
    for n in ("a.jpg", "b.jpg"):
        touch(str(src / n), n.encode())
    dest = tmp_path / "dest"
    plan = spark.createDataFrame(
        [(str(src / "a.jpg"), str(dest / "F" / "a.jpg"), "F", "a.jpg"),
         (str(src / "b.jpg"), str(dest / "F" / "b.jpg"), "F", "b.jpg"),
         (str(src / "gone.jpg"), str(dest / "F" / "gone.jpg"), "F", "gone.jpg")],
        "image_path string, dest_path string, folder_key string, dest_name string")
    status = {os.path.basename(r.image_path): r.status for r in execute_routing(plan).collect()}
    assert status == {"a.jpg": "copied", "b.jpg": "copied", "gone.jpg": "failed"}
    again = {os.path.basename(r.image_path): r.status for r in execute_routing(plan).collect()}
    assert again["a.jpg"] == "exists"  # idempotent re-run
    with pytest.raises(ValueError):
        execute_routing(plan, mode="move")
    moved = {os.path.basename(r.image_path): r.status
             for r in execute_routing(plan, mode="move", status_path=str(tmp_path / "status")).collect()}
    assert moved == {"a.jpg": "moved", "b.jpg": "moved", "gone.jpg": "failed"}
    assert not (src / "a.jpg").exists() and (dest / "F" / "a.jpg").read_bytes() == b"a.jpg"


def test_nothing_is_written_over(spark, tmp_path):
    """A destination with other content, of the same size or not, stays as it is, and so does the source."""
    src, dest = tmp_path / "src", tmp_path / "dest"
    touch(str(src / "a.jpg"), b"NEW")
    touch(str(src / "b.jpg"), b"NEWLONG")
    for n in ("a.jpg", "b.jpg"):
        touch(str(dest / n), b"OLD")
    plan = spark.createDataFrame([(str(src / n), str(dest / n), "", n, i) for i, n in enumerate(("a.jpg", "b.jpg"))],
                                 "image_path string, dest_path string, folder_key string, dest_name string, seen_order long")
    for mode in ("copy", "move"):
        got = execute_routing(plan, mode=mode, status_path=str(tmp_path / mode)).collect()
        assert {r.status for r in got} == {"failed"}
    assert (dest / "a.jpg").read_bytes() == (dest / "b.jpg").read_bytes() == b"OLD"
    assert (src / "a.jpg").read_bytes() == b"NEW" and (src / "b.jpg").read_bytes() == b"NEWLONG"
    assert sorted(os.listdir(dest)) == ["a.jpg", "b.jpg"]  # no temporary files are left


def test_far_directories_and_other_formats():
    tags = {36867: "2020:05:06 07:08:09"}
    block = tiff_block("II", {}, tags)
    far = bytearray(block[:8] + bytes(200_000) + block[8:])
    far[4:8] = struct.pack("<I", 200_008)

    def moved(data, by):  # offsets inside the directories
        out = bytearray(data)
        (n,) = struct.unpack_from("<H", out, 200_008)
        for i in range(n):
            at = 200_010 + 12 * i + 8
            struct.pack_into("<I", out, at, struct.unpack_from("<I", out, at)[0] + by)
        (sub,) = struct.unpack_from("<I", out, 200_010 + 8)
        (n,) = struct.unpack_from("<H", out, sub)
        for i in range(n):
            at = sub + 2 + 12 * i + 8
            struct.pack_into("<I", out, at, struct.unpack_from("<I", out, at)[0] + by)
        return bytes(out)

    want = ("2020:05:06 07:08:09", None, None)
    assert exif_dates(moved(far, 200_000)) == want
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc!"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", bytes(300_000)) + chunk(b"eXIf", block) + chunk(b"IEND", b"")
    assert exif_dates(png) == want and exif_dates(png[:-300]) is not None
    riff = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    for body in (block, b"Exif\x00\x00" + block):
        assert exif_dates(b"RIFF\0\0\0\0WEBP" + riff(b"VP8 ", bytes(333)) + riff(b"EXIF", body)) == want


def test_unknown_storage_is_an_error(spark):
    from trapline.sources.exif import capture_dates_for

    rows = spark.createDataFrame([("nowhere://bucket/a.jpg",)], "image_path string")
    with pytest.raises(Exception, match="nowhere|scheme|Unrecognized"):
        capture_dates_for(rows).collect()
