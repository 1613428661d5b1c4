"""Long-window Zstandard lines: frames, ranges, cut files, odd bytes."""

import os
import random

import pytest
import zstandard

from tessera.sources import dump
from tessera.sources.zstd_lines import read_zstd_lines, write_zstd_lines


def packed(parts, window_log=24, **how):
    """One frame a part."""
    options = zstandard.ZstdCompressionParameters.from_level(3, window_log=window_log, **how)
    out = b""
    for p in parts:
        c = zstandard.ZstdCompressor(compression_params=options).compressobj()
        out += c.compress(p) + c.flush()
    return out


def values(spark, path, **how):
    return sorted(r.value for r in read_zstd_lines(spark, str(path), **how).collect())


def pieces(rng, text, n):
    cuts = sorted(rng.randrange(len(text) + 1) for _ in range(n - 1))
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


@pytest.mark.parametrize("split", [50, 3_000, 1 << 27])
def test_lines_across_frames_and_ranges(spark, tmp_path, split):
    rng = random.Random(1)
    lines = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(400)] + ["x" * 400_000, "last"]
    text = "\n".join(lines).encode()
    for name, tail in (("a", b""), ("b", b"\n")):
        skipped = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345"
        frames = pieces(rng, text + tail, 40)
        (tmp_path / f"{name}.zst").write_bytes(skipped + packed(frames[:20], write_checksum=True) + skipped + packed(frames[20:]) + skipped)
    assert values(spark, tmp_path, split_bytes=split) == sorted(lines * 2)
    assert values(spark, tmp_path / "a.zst", split_bytes=split) == sorted(lines)


def test_a_file_that_is_cut_off_gives_its_whole_lines(spark, tmp_path):
    rng = random.Random(2)
    lines = [rng.randbytes(rng.randrange(200)).hex() for _ in range(5_000)]
    whole = packed(pieces(rng, "\n".join(lines).encode(), 5))
    for cut in (len(whole) - 3, len(whole) * 3 // 4, len(whole) // 2, 30, 9, 0):
        (tmp_path / "cut.zst").write_bytes(whole[:cut])
        got = [r.value for r in read_zstd_lines(spark, str(tmp_path / "cut.zst")).collect()]
        assert got == lines[: len(got)] and (cut < 100 or len(got) > len(lines) * (cut / len(whole)) * 0.6) and len(got) < len(lines)


def test_windows_that_the_text_reader_refuses(spark, tmp_path):
    lines = [f"line {k}" for k in range(2_000)]
    (tmp_path / "long.zst").write_bytes(packed(["\n".join(lines).encode()], window_log=30))
    assert sorted(r.value for r in dump.read_lines(spark, str(tmp_path / "long.zst")).collect()) == sorted(lines)
    with pytest.raises(Exception, match="FAILED_READ_FILE|too much memory|Frame requires"):
        spark.read.text(str(tmp_path / "long.zst")).collect()
    with pytest.raises(Exception, match="memory|window|Frame"):
        read_zstd_lines(spark, str(tmp_path / "long.zst"), window_log=20).collect()


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(f"é {k}" * (k % 5),) for k in range(1_000)], "value string").repartition(3)
    folder = f"file://{tmp_path}/out"
    written = write_zstd_lines(df, folder, window_log=30, frame_rows=70, broken_end=300_000).collect()
    assert sum(r.lines for r in written) == 1_000 and sorted(os.listdir(tmp_path / "out")) == [f"part-0000{k}.zst" for k in range(3)]
    back = read_zstd_lines(spark, folder, split_bytes=1_000)
    assert sorted(r.value for r in back.collect()) == sorted(r.value for r in df.collect())
    assert {r.path for r in back.select("path").distinct().collect()} == {r.path for r in written}


def test_bytes_that_are_not_text_and_missing_files(spark, tmp_path):
    (tmp_path / "odd.zst").write_bytes(packed([b"\xff\xfe\n\x00zero\n"]))
    assert values(spark, tmp_path / "odd.zst") == ["\x00zero", "��"]
    with pytest.raises(Exception, match="none"):
        values(spark, tmp_path / "none")
    (tmp_path / "junk.zst").write_bytes(b"this is no Zstandard file at all, though it says so")
    with pytest.raises(Exception, match="(?i)zstd|frame"):
        values(spark, tmp_path / "junk.zst")
