"""Sizes of images from headers that are written here by the formats' rules."""

import struct
import zlib

from docsift.sources.headers import image_size, image_sizes


def png(w, h):
    body = struct.pack(">II5B", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body)) + b"rest"


def bmp(w, h, core=False):
    info = struct.pack("<IHHHH", 12, w, h, 1, 24) if core else struct.pack("<IiiHH", 40, w, h, 1, 24) + b"\0" * 24
    return b"BM" + struct.pack("<IHHI", 100, 0, 0, 54) + info


def jpeg(w, h, before=(), frame=0xC0, filling=0):
    out = b"\xff\xd8"
    for marker, size in before:
        # what a segment holds may look like a frame
        out += bytes([0xFF, marker]) + struct.pack(">H", size + 2) + (b"\xff\xc0\0\x11\x08\0\1\0\1" * (size // 9 + 1))[:size]
    return out + b"\xff" * filling + bytes([0xFF, frame]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9 + b"\xff\xda\0\0data"


def test_sizes_of_files(spark, tmp_path):
    many = [(0xE0 + i % 16, 30) for i in range(200)]
    files = {
        "a.png": (png(640, 480), ("png", 640, 480)), "big.png": (png(70_000, 1), ("png", 70_000, 1)),
        "b.bmp": (bmp(31, 17), ("bmp", 31, 17)), "down.bmp": (bmp(31, -17), ("bmp", 31, 17)), "old.bmp": (bmp(5, 6, True), ("bmp", 5, 6)),
        "c.jpg": (jpeg(1024, 768), ("jpeg", 1024, 768)), "d.jpeg": (jpeg(33, 44, [(0xE0, 14), (0xE1, 60_000), (0xDB, 65), (0xC4, 20)], 0xC2, 3), ("jpeg", 33, 44)),
        "many.jpg": (jpeg(12, 34, many), ("jpeg", 12, 34)), "named.png": (jpeg(9, 8), ("jpeg", 9, 8)),
        "empty.png": (b"", "empty"), "short.png": (png(5, 5)[:18], "no size"), "text.jpg": (b"no image", "known kind"), "cut.jpg": (jpeg(5, 5, [(0xE0, 50)])[:30], "no size"),
        "zero.png": (png(0, 5), "no size"), "scan.jpg": (b"\xff\xd8\xff\xda\0\2" + jpeg(3, 3)[2:], "no size"), "note.txt": (b"x", None),
    }
    for i, (name, (content, _)) in enumerate(files.items()):
        (tmp_path / str(i % 2)).mkdir(exist_ok=True)
        (tmp_path / str(i % 2) / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in image_sizes(spark, str(tmp_path)).collect()}
    assert set(got) == set(files) - {"note.txt", "empty.png"}
    for name, (content, want) in files.items():
        if isinstance(want, tuple):
            assert (got[name]["kind"], got[name]["width"], got[name]["height"], got[name]["error"]) == (*want, None), name
        elif name in got:
            assert want in got[name]["error"] and got[name]["width"] is None, name
        if name in got:
            assert got[name]["bytes"] == len(content) and got[name]["stem"] == name.rsplit(".", 1)[0]


def test_no_content(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(b"",), (None,)], "content binary").select(image_size(F.col("content")).alias("s")).select("s.*")
    assert [tuple(r) for r in rows.collect()] == [(None, None, None, "the file is empty")] * 2


def test_no_python_runs(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(1, 2))
    assert "Python" not in image_sizes(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
