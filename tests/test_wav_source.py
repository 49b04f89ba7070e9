"""WAV files through the data sources, cut at any bytes, against the files' own samples."""

import numpy as np
import pytest
from test_levels import make, pcm, riff

from scribelake.functions import wav
from scribelake.sources import wav_source


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("wavs")
    r = np.random.default_rng(4)
    files = {
        "a.wav": make(pcm(r.uniform(-1, 1, 3 * 5000), 24), bits=24, channels=3),
        "b.WAV": make(pcm(r.uniform(-1, 1, 2 * 777), 32, 3), bits=32, code=3, channels=2),
        "c.wave": make(pcm(r.uniform(-1, 1, 10)), extra=[(b"junk", bytes(5001)), (b"note", b"x")]),
        "one.wav": make(pcm([0.5])),
        "broken.wav": make(pcm([0.1] * 100))[:-3],
        "text.wav": b"no sound",
        "empty.wav": b"",
        "nan.wav": make(np.array([0.5] * 40 + [np.nan] + [0.25] * 40, "<f4").tobytes(), bits=32, code=3),
        "tail.wav": riff([(b"fmt ", make(pcm([0.1, 0.2]))[20:36]), (b"data", pcm([0.1, 0.2]) + b"\x01")]),
        ".hidden.wav": b"", "d.mp3": b"",
    }
    for name, data in files.items():
        (at / name).write_bytes(data)
    (at / "folder.wav").mkdir()
    wav_source.register(spark)
    return str(at), {k: v for k, v in files.items() if k[0] != "." and k != "d.mp3"}


@pytest.mark.parametrize("limit, block", [(1 << 20, 100), (997, 7), (64, 3), (5, 50)])
def test_every_block_once_wherever_files_are_cut(spark, folder, limit, block):
    at, files = folder
    # Few files where ranges are tiny: a range is a task.
    chosen = files if limit > 500 else {k: v for k, v in files.items() if k in ("one.wav", "nan.wav", "tail.wav", "text.wav")}
    source = wav_source.BlockReader({"path": at, "partitionbytes": limit, "blockframes": block})
    parts = wav_source.planned([(f"{at}/{k}", len(v)) for k, v in chosen.items()], limit)
    assert sum(e - a for p in parts for _, _, a, e in p.parts) == sum(map(len, chosen.values()))
    assert all(sum(e - a for _, _, a, e in p.parts) <= limit for p in parts)
    got: dict = {}
    for part in parts:
        for batch in source.read(part):
            for row in batch.to_pylist():
                got.setdefault(row["path"].rsplit("/", 1)[-1], []).append(row)
    assert set(got) == {k for k in chosen if k != "empty.wav" or limit > 500}
    for name, data in chosen.items():
        if name not in got:
            continue
        try:
            head = wav.header(data)
        except wav.Refused as refused:
            assert [(r["reason"], r["block"]) for r in got[name]] == [(str(refused), None)]
            continue
        rows = sorted(got[name], key=lambda r: r["block"])
        assert [(r["block"], r["start_frame"]) for r in rows] == [(n, n * block) for n in range(-(-head["frames"] // block))]
        assert sum(r["frames"] for r in rows) == head["frames"] and {r["channels"] for r in rows} == {head["channels"]}
        for r in rows:
            part = slice(head["at"] + r["start_frame"] * head["align"], head["at"] + (r["start_frame"] + r["frames"]) * head["align"])
            if name == "nan.wav" and r["start_frame"] <= 40 < r["start_frame"] + r["frames"]:
                assert r["reason"] == "non_finite_samples" and r["samples"] is None
            else:
                want = wav.samples(data, head, r["start_frame"], r["start_frame"] + r["frames"])
                assert np.array_equal(np.array(r["samples"]), want.T) and data[part] and r["reason"] is None


def test_frames_by_spark(spark, folder):
    at, files = folder
    rows = spark.read.format("wav_blocks").option("partitionBytes", 4000).option("blockFrames", 500).load(at)
    assert rows.rdd.getNumPartitions() > 10
    frames = {r["path"].rsplit("/", 1)[-1]: r["n"] for r in rows.where("reason IS NULL").groupBy("path").agg({"frames": "sum"}).withColumnRenamed("sum(frames)", "n").collect()}
    assert frames["a.wav"] == 5000 and frames["b.WAV"] == 777 and frames["c.wave"] == 10 and "broken.wav" not in frames


def test_headers_are_read_without_samples(spark, folder, monkeypatch):
    at, files = folder
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in spark.read.format("wav_headers").load(at).collect()}
    assert set(rows) == set(files)
    for name, data in files.items():
        r = rows[name]
        assert r["size_bytes"] == len(data)
        try:
            h = wav.header(data)
            assert (r["reason"], r["frames"], r["channels"], r["orphan_bytes"]) == (None, h["frames"], h["channels"], h["orphan_bytes"])
            assert (r["sha256"] is not None) == (h["orphan_bytes"] > 0)
        except wav.Refused as refused:
            assert r["reason"] == str(refused)

    class Counted:
        read = 0

        def read_at(self, n, at):
            Counted.read += n
            return files["a.wav"][at : at + n]

    wav.header(wav_source.Ranges(Counted(), len(files["a.wav"])))
    assert Counted.read == wav_source.HEAD_BYTES
    # A file of more than 4 GB is planned by its size alone.
    parts = wav_source.planned([("/big.wav", 5 << 30)], 64 << 20)
    assert len(parts) == 80 and parts[-1].parts[0][3] == 5 << 30


def test_a_folder_must_be_named():
    with pytest.raises(ValueError):
        wav_source.BlockReader({})
