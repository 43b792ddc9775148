"""A whole run over PNG files made here, and its parts on files."""

from datetime import datetime
from pathlib import Path
import os

import numpy as np
import pytest

from lumenfold.__main__ import ThumbnailEmbedder
from lumenfold.operators import labels, manifests, moves
from lumenfold.run import run
from lumenfold.settings import Settings, load_settings
from lumenfold.sources import images, listing


def board(size=128, cell=16, shift=0):
    y, x = np.indices((size, size))
    on = ((x + shift) // cell + y // cell) % 2
    return np.repeat((on * 255).astype(np.uint8)[..., None], 3, axis=2)


def put(path: Path, pixels=None, when="2026-01-02 10:30:00", text=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(images.encode_png(pixels) if pixels is not None else (text or "x").encode())
    at = datetime.fromisoformat(when + "+00:00").timestamp()
    os.utime(path, (at, at))


def test_png_round_trip_and_truncation():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (13, 7, 3), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(pixels)) == pixels).all()
    with pytest.raises(ValueError):
        images.decode_png(images.encode_png(pixels)[:60])


def test_exif_dates_prefer_the_original():
    import struct

    entry = lambda tag, kind, count, value: struct.pack("<HHI4s", tag, kind, count, value)
    text = b"2026:01:02 10:30:00\0"
    base = 8 + 2 + 12 * 3 + 4
    block = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + entry(0x0112, 3, 1, struct.pack("<HH", 6, 0)) + entry(0x0132, 2, 20, struct.pack("<I", base)) + entry(0x9003, 2, 20, struct.pack("<I", base + 20)) + b"\0\0\0\0" + b"2025:01:01 00:00:00\0" + text
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"
    found = images.read_exif(jpeg)
    assert found == {0x0112: 6, 0x0132: "2025:01:01 00:00:00", 0x9003: "2026:01:02 10:30:00"}
    assert images.read_exif(b"no image") == {}


def test_quality_of_pixels():
    settings = Settings()
    f = lambda p: images.image_features(images.encode_png(p), images.decode_png, settings)
    assert f(board())["blur_score"] > 30
    flat = f(np.full((64, 64, 3), 5, np.uint8))
    assert flat["blur_score"] == 0 and flat["brightness_mean"] < 40 and abs(sum(flat["color_histogram"]) - 1) < 1e-9
    assert f(np.full((64, 64, 3), 255, np.uint8))["overexposed_ratio"] == 1
    assert images.image_features(b"text", images.decode_png, settings)["details"]


def test_scan_lists_top_level_files_only(spark, tmp_path):
    for name in ("photo.JPG", "raw.HEIF", "clip.MOV", "sidecar.AAE", "unknown.bin", "_odd.png", ".png"):
        put(tmp_path / name)
    put(tmp_path / "day01" / "inside.png")
    rows = {Path(r["source_path"]).name: r["classification"] for r in listing.scan_root(spark, Settings(root=tmp_path)).collect()}
    assert rows == {"photo.JPG": "photo", "raw.HEIF": "photo", "clip.MOV": "non_photo", "sidecar.AAE": "non_photo", "unknown.bin": "unsupported", "_odd.png": "photo", ".png": "unsupported"}
    with pytest.raises(NotADirectoryError):
        listing.scan_root(spark, Settings(root=tmp_path / "none"))


def test_run_moves_cleans_and_labels_and_a_second_run_does_nothing(spark, tmp_path):
    put(tmp_path / "a.png", board(), "2026-01-02 10:30:00")
    put(tmp_path / "b.png", board(), "2026-01-02 10:30:30")  # a duplicate of a in one burst
    put(tmp_path / "c.png", board(cell=8), "2026-01-03 10:00:00")
    put(tmp_path / "flat.png", np.full((64, 64, 3), 90, np.uint8), "2026-01-03 10:00:00")
    put(tmp_path / "broken.png", text="no picture", when="2026-01-03 11:00:00")
    put(tmp_path / "clip.mov", text="film", when="2026-01-01 09:00:00")
    settings = Settings(root=tmp_path)
    row = run(spark, settings, ThumbnailEmbedder, labels.RuleCategorizer()).first().asDict()
    assert {k: row[k] for k in ("total_items", "photo_items", "non_photo_items", "accepted_photos", "rejected_photos", "day_count", "moved_files", "duplicate_photos_rejected", "burst_group_count", "categorized_photos_moved")} == {
        "total_items": 6, "photo_items": 5, "non_photo_items": 1, "accepted_photos": 3, "rejected_photos": 2, "day_count": 3, "moved_files": 6, "duplicate_photos_rejected": 1, "burst_group_count": 2, "categorized_photos_moved": 2,
    }
    files = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    assert "day01/_rejected/not_photo/clip.mov" in files
    assert "day02/_rejected/duplicates/b.png" in files
    assert "day03/_rejected/low_quality/flat.png" in files and "day03/_rejected/not_photo/broken.png" in files
    assert any(f.startswith("day02/") and f.endswith("c001_b001_001.png") for f in files)
    built = {r["day_name"]: r for r in manifests.read(spark, tmp_path).collect()}
    assert built["day02"]["manifest_version"] == 3 and built["day02"]["summary"]["accepted_photo_count"] == 1
    again = run(spark, settings, ThumbnailEmbedder).first().asDict()
    assert again["total_items"] == again["moved_files"] == again["duplicate_photos_rejected"] == 0


def test_failing_labels_change_nothing(spark, tmp_path):
    from dataclasses import replace

    class Broken:
        def categorize(self, day_name, cluster_id, burst_id, path):
            raise labels.TransientError("down")

    put(tmp_path / "a.png", board())
    settings = Settings(root=tmp_path)
    settings = replace(settings, labels=replace(settings.labels, retries=1, first_delay_seconds=0.0))
    with pytest.raises(Exception, match="down"):
        run(spark, settings, ThumbnailEmbedder, Broken())
    assert (tmp_path / "day01" / "c001_b001_001.png").is_file()


def test_collision_on_disk_gets_a_counter(spark, tmp_path):
    put(tmp_path / "photo.jpg")
    put(tmp_path / "day01" / "photo.jpg", text="kept")
    plan = spark.createDataFrame([(str(tmp_path / "photo.jpg"), "day01", "accepted", None)], "source_path string, day_name string, destination_category string, destination_subfolder string")
    done = moves.apply_moves(moves.move_plan(plan), Settings(root=tmp_path))
    assert done.accepted == 1 and (tmp_path / "day01" / "photo__dup01.jpg").is_file() and (tmp_path / "day01" / "photo.jpg").read_text() == "kept"


def test_renames_swap_and_refuse_taken_targets(spark, tmp_path):
    put(tmp_path / "a.txt", text="A"), put(tmp_path / "b.txt", text="B"), put(tmp_path / "c.txt", text="C")
    frame = lambda rows: spark.createDataFrame(rows, "source_path string, target string")
    assert moves.apply_renames(frame([("a.txt", "b.txt"), ("b.txt", "a.txt")]), tmp_path) == 2
    assert (tmp_path / "a.txt").read_text() == "B"
    with pytest.raises(FileExistsError):
        moves.apply_renames(frame([("a.txt", "c.txt")]), tmp_path)
    assert (tmp_path / "a.txt").read_text() == "B"


def test_settings_and_secrets(tmp_path, monkeypatch):
    for name in ("CATEGORIZER_API_KEY", "EMBEDDER_TOKEN", "EMBEDDER_HUB_TOKEN"):
        monkeypatch.delenv(name, raising=False)
    (tmp_path / ".env").write_text("CATEGORIZER_API_KEY='one'\nEMBEDDER_HUB_TOKEN=two\n")
    settings, secrets = load_settings(tmp_path)
    assert secrets == {"categorizer_key": "one", "embedder_token": "two"} and not settings.labels.enabled
    monkeypatch.setenv("CATEGORIZER_API_KEY", "three")
    assert load_settings(tmp_path)[1]["categorizer_key"] == "three"
    assert settings.is_managed("day01") and settings.is_managed("to_print") and not settings.is_managed("day1")
