"""The command: settings from flags and a file, one run, a report, an exit code.

0: all went well; 1: a run failed, had errors, or found photos and kept none; 2: settings that do
not hold, or files in the way; 130: interrupted.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from quernstone import __version__, config
from quernstone.plans import runs

Event = Callable[[str, str], None]

# Caption models by short name: the model's public id, its download, a note.
PRESETS = {
    "smolvlm": ("HuggingFaceTB/SmolVLM-Instruct", "~4.5 GB", "balanced quality and memory (default)"),
    "smolvlm-small": ("HuggingFaceTB/SmolVLM-500M-Instruct", "~1.0 GB", "the lightest"),
    "qwen": ("Qwen/Qwen2.5-VL-3B-Instruct", "~7.5 GB", "best detail; 16 GB of free memory"),
    "joycaption": ("fancyfeast/llama-joycaption-beta-one-hf-llava", "~17 GB", "diffusion captions; 24 GB of free memory, batch 1"),
    "joycaption-nf4": ("fancyfeast/llama-joycaption-beta-one-hf-llava", "~17 GB", "4-bit, on CUDA; batch 1"),
    "huihui-qwen3-vl-4b": ("huihui-ai/Huihui-Qwen3-VL-4B-Instruct-abliterated", "~9 GB", "16 GB of free memory, batch 1"),
    "blip": ("Salesforce/blip-image-captioning-large", "~1.9 GB", "fastest, short generic captions"),
}


def presets(spark: SparkSession):
    """The caption models as a small table: name, model, download, note."""
    return spark.createDataFrame([(name, *row) for name, row in PRESETS.items()], "name string, model string, download string, note string")


def reporter(quiet: bool, verbose: bool) -> Event:
    """Prints events: warnings and errors always, progress only if asked for."""

    def tell(level: str, message: str) -> None:
        if level in ("warn", "error"):
            print(f"{level}: {message}", file=sys.stderr)
        elif not quiet and (level != "progress" or verbose):
            print(message)

    return tell


#: Lines of the report: the statistic and what it counts; those of 0 are left out, but the first two.
REPORT = (
    ("scanned", "images scanned"), ("written", "crops written"), ("captioned", "captions written"), ("no_detection", "images without a detection"), ("multi", "images with several detections"),
    ("too_small", "detections that are too small"), ("blurry", "blurry crops"), ("no_face", "crops with no face to mask"), ("masked", "crops with masked faces"), ("unmasked_kept", "crops kept without a face"),
    ("background", "crops with a masked background"), ("background_box", "of these by their box"), ("clothing", "crops with masked clothing"), ("error", "errors"),
)


def report(stats: dict) -> str:
    lines = [f"{stats.get(name, 0):>10}  {text}" for k, (name, text) in enumerate(REPORT) if k < 2 or stats.get(name)]
    return "\n".join(lines + [f"{n:>10}  crops of {tier}" for tier, n in sorted(stats.get("by_tier", {}).items())])


def run(spark: SparkSession, s: config.Settings, tell: Event) -> dict:
    """What the settings ask for; returns the statistics."""
    root, output = (Path(x).expanduser().resolve().as_uri() for x in (s.input, s.output))
    staging = f"{output}/.staging-{uuid.uuid4().hex}"
    try:
        if s.rebuild_manifest:
            return {"written": runs.rebuild_run(spark, output, staging)}
        if s.training_config_only:
            return {"written": int(runs.training_run(spark, s, output) is not None)}
        if s.caption_only:
            return {"captioned": runs.caption_run(spark, s, output, staging)}
        stats = runs.crop_run(spark, s, root, output, staging, on_event=tell)
        if s.captioner != "none" and not s.dry_run and stats["written"]:
            try:
                stats["captioned"] = runs.caption_run(spark, s, output, staging)
            except ValueError as error:  # the crops are there; captions can follow
                tell("warn", f"no captions: {error}")
                stats["error"] += 1
        if s.training_config and not s.dry_run:
            runs.training_run(spark, s, output)
        return stats
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(staging)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None, on_event: Event | None = None) -> int:
    given = list(sys.argv[1:] if arguments is None else arguments)
    if "--version" in given:
        print(__version__)
        return 0
    if "--list-models" in given:
        for name, (model, size, note) in PRESETS.items():
            print(f"{name:<20} {size:>8}  {model}  {note}")
        return 0
    try:
        s = config.from_arguments(given)
    except config.SettingsError as error:
        print("\n".join(error.problems), file=sys.stderr)
        return 2
    tell = on_event or reporter(s.quiet, s.verbose)
    try:
        stats = run(spark or SparkSession.builder.appName("quernstone").getOrCreate(), s, tell)
    except KeyboardInterrupt:
        tell("error", "interrupted; what is in the manifest can be resumed")
        return 130
    except FileExistsError as error:
        tell("error", str(error))
        return 2
    except (RuntimeError, ValueError, OSError) as error:
        tell("error", str(error))
        return 1
    tell("info", report(stats))
    return int(bool(stats.get("error")) or bool(stats.get("scanned")) and not (stats.get("written") or stats.get("captioned")))


if __name__ == "__main__":
    sys.exit(main())
