"""Command line: ``python -m brindle [DIR] [-json] [--max-rows N] [--trace] [--plain] -c SQL | -f FILE | --serve | --probe``."""

from __future__ import annotations

import argparse
import os
import sys
import time
from typing import TextIO

from .session import Session, spark_session
from .sources import json_rows, text_table
from .sources.sinks import _text

END, DONE = "--END--", "--DONE--"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brindle", description="Run SQL over a folder of Parquet tables.")
    p.add_argument("data", nargs="?", help="folder whose *.parquet become tables")
    p.add_argument("-json", "--json", action="store_true", help="one JSON array of row objects for each statement")
    p.add_argument("--max-rows", type=int, default=None, help="rows to print; never changes what is computed")
    p.add_argument("--trace", action="store_true", help="timings and advice on standard error")
    p.add_argument("--plain", action="store_true", help="no advice and no cache")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("-c", dest="sql", help="SQL text")
    what.add_argument("-f", dest="file", help="file of SQL")
    what.add_argument("--serve", action="store_true", help=f"blocks from standard input, each ended by {END}")
    what.add_argument("--probe", action="store_true", help="say what there is to run on")
    return p


def _register(session: Session, folder: str) -> None:
    names = sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))
    for n in names:
        session.spark.read.parquet(os.path.join(folder, n)).createOrReplaceTempView(n.removesuffix(".parquet"))


def run_text(session: Session, text: str, args: argparse.Namespace, out: TextIO, err: TextIO) -> bool:
    """All statements of a text; stops at the first error, which is said on ``err``."""
    began = time.perf_counter()
    try:
        for statement, df in session.script(text):
            if not df.columns:
                continue
            rows = session.rows(df, args.max_rows)
            if args.json:
                print(json_rows(rows, df.columns), file=out)
            else:
                print(text_table([[_text(v) for v in r] for r in rows], df.columns), file=out)
            if args.trace and session.accelerated:
                a = session.advise(df)
                print(f"advice: {'accelerate' if a.worthwhile else '; '.join(a.reasons)} [{statement[:60]}]", file=err)
    except Exception as e:
        print(f"Error: {str(e).split(chr(10) + chr(10) + 'JVM stacktrace')[0].strip()}", file=err)
        return False
    finally:
        if args.trace:
            print(f"wall: {(time.perf_counter() - began) * 1e3:.1f} ms", file=err)
    return True


def serve(session: Session, args: argparse.Namespace, inp: TextIO, out: TextIO) -> None:
    """Blocks of SQL; every reply ends with DONE, after an error too."""
    block: list[str] = []
    for line in inp:
        if line.strip() != END:
            block.append(line)
            continue
        run_text(session, "".join(block), args, out, out)
        block = []
        print(DONE, file=out, flush=True)


def main(argv: list[str] | None = None, inp: TextIO = sys.stdin, out: TextIO | None = None, err: TextIO | None = None) -> int:
    args = parser().parse_args(argv)
    out, err = out or sys.stdout, err or sys.stderr
    if args.max_rows is not None and args.max_rows < 0:
        parser().error("--max-rows is negative")
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.probe:
        sc = spark.sparkContext
        print(f"spark {spark.version}, master {sc.master}, {sc.defaultParallelism} cores", file=out)
        return 0
    with Session(spark, accelerated=not args.plain) as session:
        if args.data:
            _register(session, args.data)
        if args.serve:
            serve(session, args, inp, out)
            return 0
        text = args.sql
        if args.file:
            with open(args.file, encoding="utf-8") as f:
                text = f.read()
        return 0 if run_text(session, text, args, out, err) else 1
