"""``python -m lumenfold --root FOLDER [--plan-only]``: a run over a folder of PNG files, with vectors from a table."""

from __future__ import annotations

import argparse
import numpy as np

from lumenfold import logs
from lumenfold.operators import report
from lumenfold.run import intake, run
from lumenfold.session import local_session
from lumenfold.settings import load_settings


class ThumbnailEmbedder:
    """A stand-in for a model: the brightness of a photo on a coarse grid."""

    def embed(self, paths: list[str]) -> np.ndarray:
        from pathlib import Path

        from lumenfold.sources.images import decode_png, luma, resample

        return np.stack([resample(luma(decode_png(Path(p).read_bytes()))[..., None], 8, 8).ravel() + 1.0 for p in paths])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumenfold")
    parser.add_argument("--root", required=True, help="folder with the files")
    parser.add_argument("--log-level", default="INFO")
    parser.add_argument("--plan-only", action="store_true", help="show what would move and touch nothing")
    args = parser.parse_args(argv)
    logs.configure(args.log_level)
    settings, _ = load_settings(args.root)
    spark = local_session()
    if args.plan_only:
        intake(spark, settings)["plan"].select("source_path", "target").show(1000, truncate=False)
    else:
        print(report.as_text(run(spark, settings, ThumbnailEmbedder)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
