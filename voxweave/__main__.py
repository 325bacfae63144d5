"""python -m voxweave INPUT: transcripts of a WAV file or folder, by the stub models unless others are given in code."""

from __future__ import annotations

import argparse
import hashlib
import os
import sys
import time

from voxweave.config import MODEL_SIZES, Options
from voxweave.log import LEVELS, configure
from voxweave.operators import models

#: Names of options and of what may be chosen.
RAW, OF_TURNS = (".txt", ".json", ".srt", "txt", "json", "srt", "all"), ("transcript.json", "transcript.txt")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxweave")
    p.add_argument("input", help="a WAV file, or a folder of them")
    p.add_argument("--format", action="append", choices=RAW, help="format of the transcript, or all of them; may be given again")
    p.add_argument("--output", "--output-dir", help="output folder")
    p.add_argument("--language")
    p.add_argument("--model", choices=MODEL_SIZES, help="size of the speech model, for engines that have sizes")
    p.add_argument("--device", choices=("cpu", "cuda"))
    p.add_argument("--engine", choices=tuple(models.ENGINES), default=next(iter(models.ENGINES)), help="the speech model")
    p.add_argument("--batch", action="store_true", help="the input is a folder, of which every WAV file is transcribed")
    p.add_argument("--skip-existing", action="store_true", help="leave out files that have all their outputs")
    p.add_argument("--log-level", choices=LEVELS, default="INFO")
    long = p.add_argument_group("long recordings")
    long.add_argument("--chunk", action="store_true", help="cut at silences, and go on after an interruption")
    long.add_argument("--chunk-minutes", type=float, default=10.0)
    long.add_argument("--silence-ms", type=int, default=800, help="least silence to cut at")
    long.add_argument("--keep-chunks", action="store_true", help="write the pieces to the output folder too")
    who = p.add_argument_group("speakers")
    who.add_argument("--diarize", action="store_true", help="turns under speaker roles")
    who.add_argument("--diarizer", choices=tuple(models.DIARIZERS), default=next(iter(models.DIARIZERS)), help="the speaker model")
    who.add_argument("--diarize-format", choices=OF_TURNS, default="transcript.json")
    who.add_argument("--num-speakers", type=int)
    who.add_argument("--flip-roles", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    given = {k: v for k, v in (("language", args.language), ("output_dir", args.output), ("model_size", args.model), ("device", args.device)) if v}
    options = Options.read(**given)
    configure(args.log_level)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from voxweave.operators import halt, render, resume
    from voxweave.operators.chunks import ChunkPlan
    from voxweave.plans import jobs, pipeline
    from voxweave.shared import shared_dir
    from voxweave.ship import ship
    from voxweave.sources import recordings
    from voxweave.sources.paths import resolve

    if args.batch and not os.path.isdir(args.input):
        print(f"--batch needs a folder, not {args.input}", file=sys.stderr)
        return 1
    where = args.input if os.path.isdir(args.input) else resolve(args.input)
    if not where:
        print(f"{args.input}: no such file", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("voxweave").getOrCreate()
    ship(spark)
    files = pipeline.read(spark, where, batch=os.path.isdir(where))
    asked = args.format or ([] if args.diarize else [".txt"])
    raw = [".txt", ".json", ".srt"] if "all" in asked else list(dict.fromkeys(x if x.startswith(".") else f".{x}" for x in asked))
    engine, diarizer = (models.configured(known[name], options) for known, name in ((models.ENGINES, args.engine), (models.DIARIZERS, args.diarizer)))
    formats = raw + ([args.diarize_format] if args.diarize else [])
    if args.skip_existing and os.path.isdir(options.output_dir):
        names = os.listdir(options.output_dir)
        have = [(n[: -len(f".{x.lstrip('.')}")], x) for n in names for x in formats if n.endswith(f".{x.lstrip('.')}")]
        table = spark.createDataFrame(have or [("", "")], "stem string, ext string")
        files = files.join(resume.unfinished(files.select(pipeline.STEM(F.col("path")).alias("stem"), "path"), table, formats).select("path"), "path", "left_semi")
    if files.isEmpty():
        print("nothing to do", file=sys.stderr)
        return 1
    # named by the input and the plan, so that the same call finds it again
    again = hashlib.sha256(f"{os.path.abspath(where)} {args.chunk_minutes} {args.silence_ms}".encode()).hexdigest()[:16]
    turned, head, began = None, None, time.perf_counter()
    plan, chosen = ChunkPlan(target_ms=int(args.chunk_minutes * 60_000)), recordings.Folder(spark, where)
    if args.skip_existing or args.diarize:  # some of the folder's files, or such as are decoded whole for their speakers anyway
        chosen = pipeline.Contents(files)
    stop = halt.Halt(listen=args.chunk)
    in_pieces = lambda: jobs.transcribe_in_pieces(chosen, plan, f"{shared_dir(spark)}/pieces-{again}", engine, stop=stop, least_ms=args.silence_ms, language=options.language)
    try:
        if args.diarize:
            turned, segments, status = jobs.transcribe_and_diarize(files, f"{shared_dir(spark)}/stage-{again}", engine, diarizer, args.num_speakers, args.flip_roles, in_pieces if args.chunk else None)
            for r in render.preview(turned).orderBy("source_id", "turn_index").toLocalIterator():
                print(r.line)
        elif args.chunk:
            segments, head = in_pieces()
            status = chosen.readable().filter("error is not null").select(F.col("path").alias("source_id"), F.lit("FAILED").alias("status"), "error") if isinstance(chosen, recordings.Folder) else None
        else:
            segments, status = jobs.transcribe_batch(files, engine)
            print(jobs.summary(status, time.perf_counter() - began))
    except halt.Halted as e:
        print(e, file=sys.stderr)
        return 1
    if args.chunk and args.keep_chunks:
        pipeline.keep_chunks(chosen, pipeline.plan_chunks(chosen, plan, args.silence_ms), options.output_dir)
    if status is not None:
        for r in status.filter("status = 'FAILED'").toLocalIterator():
            print(f"{r.source_id}: {r.error}", file=sys.stderr)
    head = pipeline.results(segments, options.language) if head is None else head
    for r in render.summaries(segments, head).orderBy("source_id").toLocalIterator():
        print(f"{r.source_id}: {r.line}")
    for name, n in pipeline.export(segments, options.output_dir, formats, turned=turned, head=head).items():
        print(f"{n} {name} in {options.output_dir}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
