import gzip
import hashlib
import zlib

import pytest

from quillframe.llm import media


@pytest.mark.parametrize("n", [1, 2, 7])
def test_every_format_returns_its_samples(n):
    samples = bytes((k * 31) % 256 for k in range(media.UNIT * n))
    for kind, blob in (("png", media.encode_png(samples, media.UNIT)), ("wav", media.encode_wav(samples)), ("bmp", media.encode_bmp(samples, media.UNIT))):
        assert media.sniff(blob) == (kind, []) and media.decode(kind, blob)[0] == samples
        assert media.sniff(blob[:-1])[0] is None and media.sniff(blob + b"x")[0] is None


def test_damaged_media_are_not_confirmed():
    png = bytearray(media.encode_png(b"\1" * media.UNIT, media.UNIT))
    png[40] ^= 1
    assert media.carve(bytes(png)) == []
    assert media.carve(b"BM RIFF\xff\xd8\xffGIF89a" * 3) == []


def test_embedded_media_are_carved():
    png, wav, gz = media.encode_png(b"\2" * media.UNIT, media.UNIT), media.encode_wav(b"\3" * 10), gzip.compress(b"text")
    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    blob = b"head" + png + b"BM" + wav + gz + b"--" + gif
    assert [(k, blob[a : a + n]) for k, a, n in media.carve(blob)] == [("png", png), ("wav", wav), ("gzip", gz), ("gif", gif)]
    assert media.sniff(blob)[0] is None and media.sniff(None) == (None, [])


def test_columns_and_digest(spark):
    texts = [None, "", "a", "é" * 288, "é" * 289, "BM RIFF GIF89a", "x" * 200_000, "a"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = df.select("doc_id", media.digested(df, media.media_column(df)).alias("m"), media.sniffed(df, media.media_column(df)).alias("s")).orderBy("doc_id").collect()
    for (i, _, s), t in zip(rows, texts):
        m, p = rows[i]["m"], media.payload_of(t)
        assert len(p) % 576 == 0 and p.rstrip(b"\xff") == (t or "").encode()
        assert (m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert s["corrected"] == (s["media_type"] != media.store(t)[0]) and m["feature"].startswith(s["media_type"])
    assert rows[2]["m"] == rows[7]["m"] and rows[0]["m"] == rows[1]["m"]
    assert df.limit(0).select(media.digested(df, media.media_column(df)).alias("m")).count() == 0
