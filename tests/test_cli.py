import numpy as np
import pytest

from prismlake import cli
from prismlake.sources import envi, library_csv


@pytest.fixture()
def cube(tmp_path):
    rng = np.random.default_rng(0)
    x = rng.uniform(0.4, 0.6, (6, 8, 5)).astype(np.float32)
    target = np.array([1, 0.1, 0.9, 0.1, 0.8], dtype=np.float32)
    x[2, 3] = target
    (tmp_path / "c.hdr").write_text("ENVI\nsamples = 8\nlines = 6\nbands = 5\ndata type = 4\ninterleave = bip\n")
    (tmp_path / "c.float").write_bytes(x.tobytes())
    (tmp_path / "lib.csv").write_text("blood," + ",".join(map(str, target)) + "\npaint,1,1,1,1,1\n")
    return tmp_path


def test_score_and_evaluate(spark, cube, capsys):
    d = str(cube)
    assert cli.main(["score", "--cube", f"{d}/c.hdr", "--library", f"{d}/lib.csv", "--target", "blood", "--dump-score", f"{d}/s.f32", "--dump-target", f"{d}/t.i32", "--print", "5"], spark) == 0
    said = capsys.readouterr().out
    assert "blood 1" in said and "x 3 y 2" in said
    assert np.fromfile(f"{d}/s.f32", "<f4").argmin() == 19 and (np.fromfile(f"{d}/t.i32", "<i4") == 0).all()
    mask = np.zeros(48, np.uint8)
    mask[19], mask[0] = 1, 255
    mask.tofile(f"{d}/m.u8")
    assert cli.main(["eval", f"{d}/s.f32", f"{d}/m.u8", "--width", "8", "--height", "6"], spark) == 0
    assert "ROC AUC 1.0000" in capsys.readouterr().out
    assert cli.main(["eval", f"{d}/s.f32", f"{d}/m.u8", "--width", "8", "--height", "6", "--target", "3"], spark) == 1


def test_errors_are_said(spark, cube, capsys):
    d = str(cube)
    assert cli.main(["score", "--cube", f"{d}/c.hdr", "--library", f"{d}/lib.csv", "--target", "ketchup"], spark) == 2
    assert "blood" in capsys.readouterr().err
    assert cli.main(["detect", "--source", "envi", "--envi", f"{d}/c.hdr"], spark) == 2
    assert cli.main(["score", "--cube", f"{d}/none.hdr", "--library", f"{d}/lib.csv"], spark) == 2


def test_detect_on_sources(spark, cube, capsys):
    d = str(cube)
    assert cli.main(["detect", "--frames", "2", "--threshold", "0.05", "--nms", "4", "--csv", f"{d}/frames"], spark) == 0
    said = capsys.readouterr().out
    assert all(f"target_{k}" in said for k in range(3))
    assert spark.read.csv(f"{d}/frames", header=True).count() == 2
    assert cli.main(["detect", "--source", "envi", "--envi", f"{d}/c.hdr", "--library", f"{d}/lib.csv", "--detector", "ace", "--threshold", "0.9", "--loading", "1e-4"], spark) == 0


def test_prepare(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "anno").mkdir()
    x = np.arange(4 * 3 * 20, dtype=np.float32).reshape(4, 3, 20)
    for s in ("A_1", "B_1"):
        (tmp_path / "data" / f"{s}.hdr").write_text("ENVI\nsamples = 3\nlines = 4\nbands = 20\ndata type = 4\ninterleave = bip\nwavelength = {" + ",".join(map(str, range(400, 420))) + "}\n")
        (tmp_path / "data" / f"{s}.float").write_bytes(x.tobytes())
    gt = np.zeros((4, 3), int)
    gt[1, 1], gt[2, 2], gt[0, 0] = 1, 2, 9
    np.savez(tmp_path / "anno" / "A_1.npz", gt=gt)
    assert cli.main(["prepare", "--data-dir", str(tmp_path)], spark) == 0
    got, header = envi.read_cube(str(tmp_path / "clean" / "A_1.hdr"))
    assert (got == x[:, :, 5:13]).all() and header.wavelengths_nm[0] == 405
    assert np.fromfile(tmp_path / "clean" / "A_1_gt.u8", np.uint8).reshape(4, 3)[0, 0] == 255
    lib = library_csv.read_library(spark, str(tmp_path / "targets.csv"))
    assert lib.names == ("blood", "ketchup") and (lib.values[0] == x[1, 1, 5:13]).all() and len(lib.wavelengths_nm) == 8
