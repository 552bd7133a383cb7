"""python -m textloom CORPUS OUT: the whole pretreatment, from a folder of texts by period to deduplicated segments."""

from __future__ import annotations

import argparse
import sys

from textloom.operators import dedup, lexicon, reports
from textloom.plans.pretreatment import pretreat
from textloom.session import build_session
from textloom.sources import corpus, sinks

#: What the exit code says.
NO_METADATA, NO_SEGMENTS, NOTHING_RETAINED, NOTHING_LEFT = 2, 3, 4, 5


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="textloom", description="Normalize, segment, filter and deduplicate a corpus.")
    out.add_argument("corpus", help="folder of <period>/<document>.txt")
    out.add_argument("out", help="folder for the results")
    out.add_argument("--metadata", help="CSV; <corpus>/metadata.csv by default")
    out.add_argument("--min-score", type=int, default=lexicon.MIN_SCORE)
    out.add_argument("--all-years", action="store_true", help="keep all years of the segments, not the key years alone")
    out.add_argument("--fuzzy-threshold", type=float, default=dedup.THRESHOLD)
    out.add_argument("--no-log", action="store_true", help="leave out the report of duplicates")
    return out


def main(given: list[str] | None = None) -> int:
    args = parser().parse_args(given)
    spark = build_session("textloom")
    meta = args.metadata or f"{args.corpus.rstrip('/')}/metadata.csv"
    path = spark._jvm.org.apache.hadoop.fs.Path(meta)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        print(f"no metadata at {meta}", file=sys.stderr)
        return NO_METADATA
    docs = corpus.scan_corpus(spark, args.corpus)
    done = pretreat(docs, corpus.read_metadata(spark, meta), args.min_score, args.all_years, args.fuzzy_threshold)
    out = args.out.rstrip("/")
    for name, frame in done.stats.items():
        sinks.write_json(frame, f"{out}/stats/{name}")
    if done.scored.isEmpty():
        return NO_SEGMENTS
    sinks.write_periods(done.segments, f"{out}/02_segments")
    if done.scored.where("reason is not null").isEmpty():
        return NOTHING_RETAINED
    keys = ["period", "source_file", "paragraph_idx", "segment_idx"]
    sinks.write_periods(lexicon.retained(done.scored), f"{out}/03_filtered/segments")
    sinks.write_json(reports.quality_report(done.scored, keys, args.min_score), f"{out}/03_filtered/quality_report")
    sinks.write_json(reports.quality_counts(done.scored, args.min_score), f"{out}/03_filtered/quality_counts")
    sinks.write_json(reports.top_years(done.scored), f"{out}/03_filtered/years_rejected")
    if done.kept.isEmpty():
        return NOTHING_LEFT
    sinks.write_periods(done.kept, f"{out}/04_dedup/segments")
    if not args.no_log:
        sinks.write_json(reports.duplicate_samples(done.log, done.found, "seq"), f"{out}/04_dedup/duplicate_report")
    return 0


if __name__ == "__main__":
    sys.exit(main())
