"""python -m quire format|batch|render|check|schema"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quire.session import session


def render_one(source: str, out: str | None) -> int:
    """One record, checked and written as a file; the status is a line of JSON."""
    from pyspark.sql import functions as F

    from quire.operators import render
    from quire.sources import ooxml, records

    if source != "-" and not Path(source).exists():
        print(f"no such path: {source}", file=sys.stderr)
        return 2
    content = sys.stdin.read() if source == "-" else Path(source).read_text(encoding="utf-8")
    spark = session("render")
    one = spark.createDataFrame([(0, "record.docx", content)], "doc_id long, output_name string, json string").withColumn("record", records.post_processed(F.col("json")))
    said = sys.stdout if out else sys.stderr
    wrong = [f"{r.rule} {r.path}".strip() for r in records.violations(one).collect()]
    if wrong:
        print(json.dumps({"status": "error", "errors": wrong}), file=said)
        return 1
    data = bytes(ooxml.pack_documents(render.plan(one)).first().content)
    if out:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        Path(out).write_bytes(data)
    else:
        sys.stdout.buffer.write(data)
        sys.stdout.flush()
    print(json.dumps({"status": "success", "output": out, "bytes": len(data)}), file=said)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("format", "one file"), ("batch", "all files under a folder")):
        c = commands.add_parser(name, help=f"read, check and write {about}")
        c.add_argument("source")
        c.add_argument("--out", default="out")
        c.add_argument("--glob", default="*.docx")
        c.add_argument("--author", default="Unattributed")
        c.add_argument("--section", default="", help="the number of the section that the documents belong to")
        c.add_argument("--registry", help="a settings file with section names by number")
        c.add_argument("--converter", help="a program that makes .docx files of .doc files, such as soffice")
        c.add_argument("--case-sensitive", action="store_true", help="names that differ in case are no duplicates")
    c = commands.add_parser("render", help="write the file of one record: JSON from a file or, as -, from standard input")
    c.add_argument("source")
    c.add_argument("--out", help="a file; without it the bytes go to standard output, and the status to standard error")
    c = commands.add_parser("check", help="what this installation can do")
    c.add_argument("--server", help="a model server's URL")
    c.add_argument("--converter", default="soffice")
    commands.add_parser("schema", help="the record's schema as JSON")
    args = parser.parse_args(argv)
    if args.command == "schema":
        from quire.sources.records import schema_json

        session("schema")  # DDL is parsed by Spark
        print(schema_json())
        return 0
    if args.command == "check":
        from importlib.util import find_spec

        from quire.sources import probes

        spark = session("check")
        version = probes.command(args.converter)
        found = [("spark " + spark.version, True), ("pyarrow", find_spec("pyarrow") is not None), ("yaml (optional)", find_spec("yaml") is not None), (f"converter for .doc (optional): {version or args.converter}", version is not None)]
        if args.server:
            there, models = probes.server(args.server)
            found.append((f"model server {args.server}: {', '.join(models) or 'no models'}", there))
        for what, fine in found:
            print(f"{'ok ' if fine else 'no '} {what}")
        return 0
    if args.command == "render":
        return render_one(args.source, args.out)
    source = Path(args.source)
    if not source.exists():
        print(f"no such path: {source}", file=sys.stderr)
        return 2
    if args.command == "format" and source.suffix.lower() not in (".docx", ".doc" if args.converter else ".docx"):
        print(f"unsupported type: {source.suffix}", file=sys.stderr)
        return 2
    if Path(args.out).is_file():
        print(f"not a folder: {args.out}", file=sys.stderr)
        return 2
    from quire.operators import batch
    from quire.plans.folder import format_folder

    glob = source.name if args.command == "format" else args.glob
    options = {"glob": glob, "author": args.author, "section": args.section, "case_sensitive": args.case_sensitive}
    if args.registry:
        from quire.sources import config

        options["sections_registry"] = {str(k): v for k, v in config.load(args.registry).items()}
    if args.converter:
        from quire.sources import probes

        options["converter"] = probes.converter(args.converter)
    results = format_folder(session(args.command), str(source.parent if args.command == "format" else source), Path(args.out).resolve().as_uri(), **options).cache()
    for r in results.orderBy("path").toLocalIterator():
        print(r.status, r.path, r.output_path or r.reason)
    counts = {r.status: r.n for r in batch.summary(results).collect()}
    print(", ".join(f"{n} {s}" for s, n in sorted(counts.items())) or "no files")
    return 1 if counts.get("failed") else 0


if __name__ == "__main__":
    sys.exit(main())
