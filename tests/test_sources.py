import struct
import zlib

import pytest

from curata.operators.relational import with_row_index
from curata.sources import records as S
from curata.streaming.resume import process_new_files


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":"1","b":2}\n\n  \n{"a":"é"}\n')
    (tmp_path / "b.jsonl").write_text('{"a":"x"}\n{"a":\n[1]\n{"a":"y"}\n')
    rows = lambda name, strict=True: sorted(r.a for r in S.read_jsonl(spark, f"{tmp_path}/{name}", "a string, b long", strict).collect())
    assert rows("a.jsonl") == ["1", "é"] and rows("b.jsonl", False) == ["x", "y"]
    with pytest.raises(Exception, match="not a JSON object in .*b.jsonl"):
        rows("b.jsonl")
    assert sorted((r.file[-7:], r.line, r.value) for r in S.bad_lines(spark, str(tmp_path)).collect()) == [("b.jsonl", 2, '{"a":'), ("b.jsonl", 3, "[1]")]
    df = spark.createDataFrame([("é\n", None)], "a string, b long")
    S.write_jsonl(df, f"{tmp_path}/out")
    assert [tuple(r) for r in S.read_jsonl(spark, f"{tmp_path}/out", "a string, b long").collect()] == [("é\n", None)]
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    with pytest.raises(Exception, match="(?i)already exists"):
        S.write_jsonl(df, f"{tmp_path}/out")


def test_row_index_is_gapless_over_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" for i in range(4000)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(700)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "1000")
        text = spark.read.text(str(tmp_path)).select("value", "_metadata")
        assert text.rdd.getNumPartitions() > 5
        got = {r.value: r.row_idx for r in with_row_index(text, first=1).select("value", "row_idx").collect()}
        each = {r.value: r.row_idx for r in with_row_index(text, per_file=True).select("value", "row_idx").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    names = [f"a{i}" for i in range(4000)] + [f"b{i}" for i in range(700)]
    assert got == {n: i for i, n in enumerate(names, 1)} and each == {n: int(n[1:]) for n in names}


def test_decode(spark):
    every = bytes(b for b in range(1, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    inputs = ["é".encode(), b"\xef\xbb\xbfx", b"caf\xe9 \x80", every, every + b"\x81", b""]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(inputs)], "i int, b binary").select("i", S.decode(S.F.col("b")).alias("d")).orderBy("i").collect()
    assert [tuple(r.d) for r in got] == [("é", "utf-8"), ("x", "utf-8-sig"), ("café €", "cp1252"), (every.decode("cp1252"), "cp1252"), ((every + b"\x81").decode("latin-1"), "latin-1"), ("", "utf-8")]
    assert S.utf8_copy_path("/a.b/t.csv") == "/a.b/t_utf8.csv"


def test_titles_and_articles(spark, tmp_path):
    (tmp_path / "t.csv").write_text('article_id,image_id,article_url,article_title\n 1 ,7,u,"A ""b""\nc"\n,8,u,t\n3,9,u, \n4\n')
    assert [tuple(r) for r in S.read_titles_csv(spark, f"{tmp_path}/t.csv").collect()] == [("1", "7", "u", 'A "b"\nc')]
    assert sorted(r.article_id for r in S.skipped_titles(spark, f"{tmp_path}/t.csv").collect()) == ["", "3", "4"]
    got = S.read_articles(spark, f"{tmp_path}/t.csv").orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [(1, "1", "7", 'A "b" c'), (2, "2", "8", "t")]
    (tmp_path / "t.JSONL").write_text('{"article_title":" x  y "}\n\n{"article_id":5}\n{"article_id":"q","article_title":"z","image_id":3}\n')
    got = S.read_articles(spark, f"{tmp_path}/t.JSONL", first=0, keep_untitled=True).orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [(0, "0", "", "x y"), (1, "5", "", ""), (2, "q", "3", "z")]
    (tmp_path / "bad.csv").write_text("article_id\n1\n")
    with pytest.raises(ValueError, match="image_id"):
        S.read_titles_csv(spark, f"{tmp_path}/bad.csv")


def test_images_and_sidecar(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 30, 20, 8, 2, 0, 0, 0)
    png += struct.pack(">I", zlib.crc32(png[12:]))
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 7, 9) + bytes(10)
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 5, -4) + bytes(4)
    webp = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    (tmp_path / "in").mkdir()
    for name, data in (("b.PNG", png), ("in/a.x.jpg", jpeg), ("c.bmp", bmp), ("d.webp", webp), ("e.jpeg", b"no"), ("f.txt", png)):
        (tmp_path / name).write_bytes(data)
    got = S.image_files(spark, str(tmp_path)).collect()
    assert [(r.image_id, r.extension, r.width, r.height, r.aspect_ratio) for r in got] == [("b", "png", 30, 20, 1.5), ("c", "bmp", 5, 4, 1.25), ("d", "webp", 100, 50, 2.0), ("e", "jpeg", None, None, None), ("a.x", "jpg", 9, 7, 1.285714)]
    assert [r.metadata_error is None for r in got] == [True, True, True, False, True] and got[0].file_size_bytes == len(png)
    S.write_sidecar(spark.createDataFrame([(1, None)], "n int, x string"), f"{tmp_path}/side")
    assert [p.read_text() for p in (tmp_path / "side").glob("part-*")] == ['{"n":1,"x":null}\n']


def test_new_files_run_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: process_new_files(spark, f"{tmp_path}/in", "a string", lambda d: d.where("a <> 'no'"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    for name, text in (("1.json", '{"a":"x"}\n{"a":"no"}\n'), ("2.json", '{"a":"y"}\n')):
        (tmp_path / "in" / name).write_text(text)
        run()
        run()
    assert sorted(r.a for r in spark.read.schema("a string").json(f"{tmp_path}/out").collect()) == ["x", "y"]
