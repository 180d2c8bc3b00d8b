"""Command line: build an index, search it (one query, a batch from standard input, or a prompt), corpus statistics, Zipf analysis.

    python -m quernel.cli index  --input corpus.json --output index_dir [--stats]
    python -m quernel.cli search --index index_dir [--query Q | --batch] [--limit 50]
    python -m quernel.cli stats  --input corpus.json [--output stats_dir]
    python -m quernel.cli zipf   --input corpus.json --output report_dir
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernel.operators import index as ix
from quernel.operators import search as se
from quernel.operators import stats as st
from quernel.sources import corpus as co
from quernel.sources import index_store


def session() -> SparkSession:
    return SparkSession.builder.appName("quernel").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def build_index(spark: SparkSession, source: str, target: str, show_stats: bool = False) -> list[str]:
    began = time.time()
    built = ix.build(co.read_ndjson(spark, source))
    index_store.save(built, target)
    took = time.time() - began
    meta = index_store.describe(spark, target).first()
    lines = [f"documents: {meta.n_docs}", f"terms: {meta.n_terms}", f"time: {took * 1000:.0f} ms", f"rate: {meta.n_docs / max(took, 1e-9):.0f} documents/s"]
    if show_stats:
        top = ix.top_terms(index_store.load(spark, target), 20)
        lines += [f"{k}. {r.term}: {r.df}" for k, r in enumerate(top.collect(), 1)]
    return lines


def report(index: ix.Index, query: str, limit: int) -> list[str]:
    """Found: N (time), at most `limit` of them with title, URL and category, and how many more there are."""
    began = time.time()
    hits = se.search(index, query)
    n = hits.count()
    took = int((time.time() - began) * 1e6)
    lines = [f"Found: {n} documents ({took} µs)"]
    rows = se.first(index, hits, limit).collect()
    for k, r in enumerate(rows, 1):
        lines += [f"{k}. {r.title}", f"   {r.url}"]
        if r.category:
            lines.append(f"   [{r.category}]")
    if n > len(rows):
        lines.append(f"... and {n - len(rows)} more")
    return lines


def batch_report(index: ix.Index, queries: Iterable[str], limit: int) -> list[str]:
    """All queries from one pass over the index."""
    texts = {f"{k}": q.rstrip("\n") for k, q in enumerate(queries) if q.strip("\n")}
    began = time.time()
    found = se.batch(index, texts).cache()
    totals = {r.qid: r.n for r in found.groupBy("qid").agg(F.count("*").alias("n")).collect()}
    took = int((time.time() - began) * 1e6)
    lines: list[str] = []
    for qid, text in texts.items():
        lines += [f"Q: {text}", f"R: {totals.get(qid, 0)} documents ({took} µs for all)"]
        if totals.get(qid) and limit:
            lines += [f"- {r.title}" for r in se.first(index, found.filter(F.col("qid") == qid).select("doc_id"), limit).collect()]
        lines.append("---")
    found.unpersist()
    return lines


def limit_of(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quernel")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("--input", default="../data/corpus.json")
    a.add_argument("--output", default="../data/index")
    a.add_argument("--stats", action="store_true")
    a = sub.add_parser("search")
    a.add_argument("--index", default="../data/index")
    a.add_argument("--query")
    a.add_argument("--batch", action="store_true")
    a.add_argument("--limit", type=limit_of, default=se.LIMIT)
    for name in ("stats", "zipf"):
        a = sub.add_parser(name)
        a.add_argument("--input", default="../data/corpus.json")
        a.add_argument("--output")
    return p


def main(argv: list[str] | None = None, stdin: Iterable[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark, stdin = session(), stdin if stdin is not None else sys.stdin
    if args.command == "index":
        print("\n".join(build_index(spark, args.input, args.output, args.stats)))
    elif args.command == "search":
        try:
            index = index_store.load(spark, args.index)
        except Exception as e:
            print(f"no index: {str(e).splitlines()[0]}", file=sys.stderr)
            return 1
        index = ix.Index(index.docs.cache(), index.occurrences, index.postings.cache())
        if index.docs.isEmpty():
            print("the index is empty", file=sys.stderr)
            return 1
        if args.query is not None:
            print("\n".join(report(index, args.query, args.limit)))
        elif args.batch:
            print("\n".join(batch_report(index, stdin, args.limit)))
        else:
            for line in stdin:
                line = line.rstrip("\n")
                if line in ("quit", "exit", "q"):
                    break
                if line:
                    print("\n".join(report(index, line, args.limit)))
    else:
        docs = co.read_ndjson(spark, args.input)
        if docs.isEmpty():
            print("the corpus is empty", file=sys.stderr)
            return 1
        if args.command == "stats":
            found = st.corpus_stats(docs)
            if args.output:
                co.write_stats(found, args.output)
            print(found.toJSON().first())
        else:
            freq = st.term_frequency(docs.select(F.concat_ws(" ", "text", "title").alias("text"))).cache()
            fit = st.zipf_fit(freq)
            row = fit.select("*", st.verdict(F.col("alpha")).alias("verdict")).first()
            print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))
            top = st.top_frequencies(freq)
            if args.output:
                co.write_tsv(top, f"{args.output}/top_terms")
                st.zipf_curve(freq, fit).write.mode("overwrite").parquet(f"{args.output}/curve")
            for r in top.collect():
                print(f"{r['rank']}\t{r.term}\t{r.frequency}")
            freq.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
