"""Command line: ``python -m tracequarry.cli dump|search|hunt|lint|analyse``.

Paths are files or folders on a store that the cluster shares. Results go to ``--output``
(a folder, written in parallel) or, cut to ``--rows``, to the screen.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.analyse import timeline as tl
from tracequarry.analyse import usage
from tracequarry.operators.hunt import aggregate_documents, hunt
from tracequarry.operators.search import search
from tracequarry.rules import parse
from tracequarry.rules.compile import documents_from_json
from tracequarry.rules.mapper import load_mappings
from tracequarry.sources import files, program_cache, sinks


class Writer:
    """Messages for people on standard error, with their level in front; ``quiet`` keeps errors only."""

    MARKS = {"success": "[+]", "error": "[x]", "warning": "[!]", "info": "[*]", "debug": "[~]"}

    def __init__(self, quiet: bool = False, verbose: bool = False, stream=None):
        self.quiet, self.verbose, self.stream = quiet, verbose, stream or sys.stderr

    def say(self, level: str, text: str) -> None:
        if level == "error" or not (self.quiet or (level == "debug" and not self.verbose)):
            print(f"{self.MARKS[level]} {text}", file=self.stream)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracequarry", description=__doc__)
    top.add_argument("-q", "--quiet", action="store_true")
    top.add_argument("-v", "--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, paths: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        if paths:
            c.add_argument("paths", nargs="+")
            c.add_argument("--extension", action="append")
            c.add_argument("--kind")
            c.add_argument("--load-unknown", action="store_true")
            c.add_argument("--skip-errors", action="store_true")
        c.add_argument("-o", "--output")
        c.add_argument("--rows", type=int, default=100)
        form = c.add_mutually_exclusive_group()
        form.add_argument("-j", "--json", dest="form", action="store_const", const="json")
        form.add_argument("--jsonl", dest="form", action="store_const", const="jsonl")
        form.add_argument("--csv", dest="form", action="store_const", const="csv")
        form.add_argument("--log", dest="form", action="store_const", const="log")
        return c

    command("dump", "write artefacts as documents").add_argument("--resident-data", action="store_true")
    s = command("search", "find documents by patterns and terms")
    s.add_argument("-e", "--regex", action="append", default=[])
    s.add_argument("--regex-file", action="append", default=[])
    s.add_argument("-t", "--tau", action="append", default=[])
    s.add_argument("-i", "--ignore-case", action="store_true")
    s.add_argument("--match-any", action="store_true")
    h = command("hunt", "test rules on documents")
    h.add_argument("-r", "--rule", action="append", default=[])
    h.add_argument("-s", "--sigma", action="append", default=[])
    h.add_argument("-m", "--mapping", action="append", default=[])
    h.add_argument("--level", action="append")
    h.add_argument("--status", action="append")
    for c in (s, h):
        c.add_argument("--timestamp")
        c.add_argument("--from", dest="start")
        c.add_argument("--to", dest="end")
    lint = command("lint", "check rule files", paths=False)
    lint.add_argument("path")
    lint.add_argument("--engine", default="native", choices=["native", "sigma"])
    lint.add_argument("-t", "--tau", action="store_true", help="show the optimised expressions")
    a = command("shimcache", "timeline of a program cache")
    a.add_argument("-e", "--regex", action="append", default=[])
    a.add_argument("-r", "--regex-file", action="append", default=[])
    a.add_argument("-a", "--amcache")
    a.add_argument("-p", "--tspair", action="store_true")
    u = command("srum", "resource usage with names")
    u.add_argument("-s", "--software", required=True)
    u.add_argument("--stats-only", action="store_true")
    return top


def emit(df: DataFrame, options, order: Sequence[str] = ()) -> None:
    """The result in the wanted form: to the output folder, else its first rows to the screen."""
    if options.output:
        write = {"json": lambda: sinks.write_json_array(df, options.output, order), "csv": lambda: sinks.write_csv(df, options.output), "log": lambda: sinks.write_log(df, options.output), "jsonl": lambda: sinks.write_jsonl(df, options.output)}
        write.get(options.form, lambda: sinks.write_yaml(df, options.output))()
        return
    shown = df.orderBy(*order) if order else df
    if options.form == "jsonl":
        for r in shown.select(sinks.as_json(shown).alias("v")).limit(options.rows).collect():
            print(r.v)
    else:
        print(sinks.table_text(shown, options.rows))


def _read(spark: SparkSession, o) -> DataFrame:
    return files.read(spark, o.paths, o.kind, o.extension, o.skip_errors, o.load_unknown, getattr(o, "resident_data", False))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one command; returns 0, or 1 where it failed."""
    o = parser().parse_args(arguments)
    out = Writer(o.quiet, o.verbose)
    try:
        return _run(o, spark, out)
    except (OSError, ValueError) as e:
        out.say("error", str(e))
        return 1


def _run(o, spark: SparkSession | None, out: Writer) -> int:
    if o.command == "lint":
        checked = parse.lint(o.path, o.engine)
        for name, error, expressions in checked:
            if error:
                out.say("error", f"{name}: {error}")
            elif o.tau:
                print(name, *expressions, sep="\n")
        bad = sum(e is not None for _, e, _ in checked)
        out.say("info", f"validated {len(checked) - bad} of {len(checked)} rule files")
        return 1 if bad else 0
    spark = spark or SparkSession.builder.appName("tracequarry").getOrCreate()
    if o.command == "dump":
        emit(_read(spark, o).select("source", "kind", "record_id", "timestamp", "data", *([] if o.skip_errors else ["error"])), o, ["source", "record_id"])
    elif o.command == "search":
        docs = documents_from_json(_read(spark, o).where("data IS NOT NULL"), "data", "doc")
        patterns = [*o.regex, *(p for f in o.regex_file for p in parse.load_patterns(f))]
        ts = docs.withColumn("__ts", F.try_variant_get("doc", "$." + o.timestamp, "string")) if o.timestamp else docs
        found = search(ts, patterns, o.tau, o.ignore_case, o.match_any, "__ts" if o.timestamp else None, o.start, o.end, F.replace(F.col("data"), F.lit("\\\\\\\\"), F.lit("\\\\")), "doc")
        emit(found.select("source", "record_id", "data"), o, ["source", "record_id"])
    elif o.command == "hunt":
        rules = [r for p in o.rule for r in parse.load_rules(p)] + [r for p in o.sigma for r in parse.load_rules(p, "sigma")]
        mappings = [m for p in o.mapping for m in load_mappings(p)]
        out.say("info", f"loaded {len(rules)} rules and {len(mappings)} mappings")
        docs = documents_from_json(_read(spark, o).where("data IS NOT NULL").drop("timestamp", "error"), "data", "doc")
        hits = hunt(docs, rules, mappings, F.col("kind"), o.timestamp, o.start, o.end, o.level, o.status, None, "doc", own_time=not o.timestamp, with_keys=True).drop("doc")
        counted = [r.name for r in rules if r.aggregate]
        single = hits.where(~F.col("rule").isin(*counted)) if counted else hits
        time = o.timestamp or "hit_ts"
        records = sinks.hit_records(single, ["source", "record_id", "data"], time, rules)
        if counted:
            groups = aggregate_documents(hits, rules, time, "source")
            records = records.unionByName(sinks.hit_records(groups, ["source", "record_id", "data"], time, rules), allowMissingColumns=True)
        emit(records, o, ["timestamp", "name"])
    elif o.command == "shimcache":
        keys = program_cache.hive_keys(files.read(spark, o.paths, "hve"))
        entries = program_cache.cache_entries(keys)
        for r in entries.where("error IS NOT NULL").select("source", "error").limit(20).collect():
            out.say("warning", f"{r.source}: {r.error}")
        entries = entries.where("error IS NULL")
        patterns = [*o.regex, *(p for f in o.regex_file for p in parse.load_patterns(f))]
        inventory = programs = None
        if o.amcache:
            other = program_cache.hive_keys(files.read(spark, [o.amcache], "hve"))
            inventory = program_cache.inventory_files(other).select(F.col("path").alias("file_path"), "sha1", "file_ts", "key_path")
            programs = program_cache.inventory_programs(other).drop("source")
        rows = tl.timeline(entries, patterns, inventory, o.tspair, modified="last_modified_ts", programs=programs, updates=entries.select("source", "last_update_ts"), file_order=["key_path"] if inventory is not None else ())
        emit(tl.timeline_columns(rows), o, ["Timeline Entry Number"])
    elif o.command == "srum":
        docs = files.read(spark, o.paths, o.kind or "esedb", o.extension, o.skip_errors)
        keys = program_cache.hive_keys(files.read(spark, [o.software], "hve"))
        extensions = program_cache.usage_extensions(keys)
        records = usage.usage_records(docs, program_cache.users(keys), extensions)
        if o.stats_only:
            emit(usage.details(usage.time_frames(records), usage.retained_tables(extensions, program_cache.usage_parameters(keys))), o)
        else:
            emit(records, o, ["source", "record_id"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
