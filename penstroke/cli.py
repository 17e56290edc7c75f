"""Command line: profile a corpus, extract an author's turns, combine profiles into a report.

    python -m penstroke profile FOLDER --register essays --output essays.json --report essays.md
    python -m penstroke extract EXPORTS --format markdown --marker "## Ana" --output turns.txt
    python -m penstroke report essays.json chat:chat.json --output report.md

Each ends with 1, and says why, when there is nothing to read or nothing was found.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.operators import parsed, profile, turns
from penstroke.session import local_session
from penstroke.sinks import report, texts
from penstroke.sources import exports, profiles
from penstroke.sources import parsed as parsing
from penstroke.sources.text import read_corpus


class Failed(Exception):
    """What is said before ending with 1."""


def _say(*lines: str) -> None:
    print(*lines, sep="\n", file=sys.stderr)


def corpus_profile(docs: DataFrame, register: str, scope: str = "corpus", readability: bool = True, parse: bool = True, order: str = "ord") -> dict:
    """The profile of all ``docs`` as one register. Scope ``corpus`` measures one concatenated text; ``documents`` adds up
    the documents, for corpora that don't fit one row."""
    by = ["register"]
    named = docs.withColumn("register", F.lit(register))
    if scope == "corpus":
        named = profile.corpus(named, by, order)
    out = report.as_dicts(profile.profiles(named, by, order), "register")[0]
    if readability:
        row = profile.readability(profile.measure(named, by, order), by).first()
        out["readability"] = {k: round(v, 3) for k, v in row.asDict().items() if k.endswith("_approx")}
    if parse and parsing.available():
        prose = profile.measure(named, by, order).select("register", F.col("prose").alias("text"))
        tokens = parsing.parse(prose, "register", most_chars=parsing.SAMPLE_CHARS)
        deep = parsed.deep_syntax(tokens, by).first()
        pairs = parsed.tag_pairs(tokens, by).orderBy("rank").collect()
        out["deep_syntactic"] = {k: round(deep[k], 3) for k in ("avg_dependency_depth", "passive_ratio", "nominalization_per_1000w")}
        out["deep_syntactic"]["top_pos_bigrams"] = [{"pos_bigram": r["pos_bigram"], "count": r["n"]} for r in pairs]
    return out


def run_profile(spark: SparkSession, args: argparse.Namespace) -> None:
    if not Path(args.input).exists():
        raise Failed(f"{args.input} is neither a file nor a folder")
    docs = read_corpus(spark, args.input)
    if docs.isEmpty():
        raise Failed(f"no text found in {args.input}")
    found = corpus_profile(docs, args.register, args.scope, not args.no_readability, not args.no_parser)
    words = found["corpus_stats"]["word_count"]
    if words < args.min_words:
        _say(f"Warning: {words:,} words are left after filtering; {args.min_words:,} are recommended.")
    if args.output:
        report.write_json(found, args.output)
    else:
        print(report.as_json(found))
    if args.report:
        report.write_text(report.single_report(found, args.input), args.report)


def run_extract(spark: SparkSession, args: argparse.Namespace) -> None:
    if not Path(args.input).exists():
        raise Failed(f"{args.input} does not exist")
    warnings: list[str] = []
    if args.format == "markdown":
        if not Path(args.input).is_dir():
            raise Failed(f"{args.input} is no folder, which Markdown exports need")
        files = exports.markdown_files(spark, args.input, args.min_file_bytes, args.no_dedup)
        raw = F.length("text")
        mine = turns.headed_turns(files, args.marker)
    else:
        files = exports.json_files(spark, args.input)
        raw = F.col("size")
        read = exports.messages_by_sender if args.format == "claude" else exports.messages_by_mapping
        messages = read(files)
        warnings = [r.warning for r in exports.warnings(messages).orderBy("path").collect()]
        mine = exports.extracted(messages)
        files = files.join(exports.warnings(messages), "path", "left_anti")
    stats = turns.extraction_stats(files, mine, "path", raw, threshold=args.warn_threshold)
    warnings += [f"{r.path.rsplit('/', 1)[-1]}: only {r.yield_fraction * 100:.1f}% of it was extracted" for r in stats.where("warn").orderBy("path").collect()]
    total = turns.extraction_summary(stats).first()
    _say(
        f"Files: {total.files:,}", f"Source bytes: {total.raw_bytes:,}", f"Extracted bytes: {total.extracted_bytes:,}",
        f"Yield: {total.overall_yield * 100:.1f}%", f"Turns: {total.turns:,}", f"Files of low yield: {total.low_yield_files:,}",
    )
    _say(*[f"Warning: {w}" for w in warnings[:10]])
    if len(warnings) > 10:
        _say(f"and {len(warnings) - 10} more warnings")
    if args.preview > 0:
        shown = turns.preview(mine, args.preview, args.seed).collect()
        for i, row in enumerate(shown, 1):
            print(f"[{i} of {len(shown)}]\n{row.sample}\n")
        return
    text = texts.joined(mine, "path", "turn")
    if not text.strip():
        raise Failed("nothing was extracted; look at the format and the marker")
    if args.output:
        report.write_text(text, args.output)
    else:
        sys.stdout.write(text)


def run_report(args: argparse.Namespace) -> None:
    loaded = []
    for spec in args.profiles:
        try:
            loaded.append(profiles.load_profile(spec))
        except (OSError, ValueError) as error:
            raise Failed(f"{spec} can't be read: {error}") from error
    report.write_text(report.combined_report(loaded, args.author), args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="penstroke", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("profile", help="measure a text file, or the .md and .txt files of a folder")
    p.add_argument("input")
    p.add_argument("--register", default="default")
    p.add_argument("--output", help="JSON file; standard output without it")
    p.add_argument("--report", help="Markdown file")
    p.add_argument("--scope", choices=["corpus", "documents"], default="corpus")
    p.add_argument("--no-readability", "--no-textstat", action="store_true")
    p.add_argument("--no-parser", "--no-spacy", action="store_true")
    p.add_argument("--min-words", type=int, default=report.SMALL_CORPUS)
    p = commands.add_parser("extract", help="collect one author's turns from exports")
    p.add_argument("input")
    p.add_argument("--format", choices=["markdown", "claude", "chatgpt"], default="markdown")
    p.add_argument("--marker", default="## Author", help="heading of the author's turns in Markdown exports")
    p.add_argument("--output")
    p.add_argument("--preview", type=int, default=0, help="show so many samples and stop")
    p.add_argument("--seed", type=int, default=0, help="of the samples")
    p.add_argument("--min-file-bytes", type=int, default=500)
    p.add_argument("--no-dedup", action="store_true", help="read numbered copies too")
    p.add_argument("--warn-threshold", type=float, default=0.05)
    p = commands.add_parser("report", help="combine profiles: path or label:path")
    p.add_argument("profiles", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--author", default="")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "report":
            run_report(args)
        else:
            session = spark or local_session()
            {"profile": run_profile, "extract": run_extract}[args.command](session, args)
    except Failed as why:
        _say(f"Error: {why}")
        return 1
    return 0
