"""Command line: python -m lexmill COMMAND ...

format IN OUT      DOCX files to Markdown: rows (path, text, warnings) in OUT/status=good, unreadable files with their
                   error in OUT/status=failed; exit code 1 if there are any
chunk IN OUT       Markdown files to the chunks of their clauses
chunk-all IN OUT   the same with the chunks of what stands in front of the clauses and behind them
index IN OUT       chunks to a sparse index
search INDEX TEXT  the best chunks of an index for a question
eval STAGE DIR     a stage of the evaluation of DIR/testset.json over DIR/chunks: hyde, embed, retrieve, generate,
                   score-recall, score-answers, score-precision, or status, or report; exit code 1 if there are
                   errors, 2 if the input is wrong
query NAME DIR     a registered query over the tables of a folder
queries            names of all registered queries
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill import catalog
from lexmill.operators import bm25, chunking, citation, evaluation, runs, whole_files
from lexmill.plans.pipeline_queries import retrieve
from lexmill.sources import docx, files


def to_markdown(spark: SparkSession, folder: str, rewrite: whole_files.Rewriter = whole_files.plain_rewriter, **how):
    """path, text, warnings and error of each DOCX file; see whole_files."""
    return whole_files.files_to_markdown(docx.read_docx(spark, folder), rewrite, **how)


def to_chunks(spark: SparkSession, folder: str, max_tokens: int = chunking.MAX_TOKENS):
    """The chunks of the Markdown files whose chunk ids are all unique: front, clauses and back of each."""
    docs = files.read_markdown(spark, folder).select(F.col("path").alias("doc"), "text")
    good, _ = chunking.split_unique(whole_files.document_chunks(docs, F.regexp_extract("doc", "([^/]*)\\.md$", 1), max_tokens))
    return good


def evaluate(spark: SparkSession, stage: str, folder: str):
    """Does a stage of the run below the folder and returns its summary; or the status of all, or the report."""
    if not files.present(spark, f"{folder}/testset.json") or not files.present(spark, f"{folder}/chunks"):
        raise runs.InputError(f"{folder} needs testset.json and chunks")
    cases = files.read_testset(spark, f"{folder}/testset.json").drop("pos")
    chunks = files.read_swapped(spark, f"{folder}/chunks").select("chunk_id", "source_document", "breadcrumb", "content", "has_table", "raw_table")
    run = runs.Run(spark, f"{folder}/run", cases, [evaluation.KEY], evaluation.stages(lambda asked: retrieve(chunks, asked)), batches=4)
    if stage == "status":
        return run.status().drop("errors")
    return evaluation.report(run) if stage == "report" else run.do(stage)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["format", "chunk", "chunk-all", "index", "search", "eval", "query", "queries"])
    parser.add_argument("args", nargs="*")
    given = parser.parse_args(argv)
    wanted = {"queries": 0}.get(given.command, 2)
    if len(given.args) != wanted:
        parser.print_usage(sys.stderr)
        return 2
    if given.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("lexmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    source, target = given.args
    if given.command == "format":
        _, failed = whole_files.write_apart(to_markdown(spark, source), target)
        for row in failed.select("path", "error").limit(20).collect():
            print(f"{row['path']}: {row['error']}", file=sys.stderr)
        return 0 if failed.isEmpty() else 1
    elif given.command in ("chunk", "chunk-all"):
        found = to_chunks(spark, source)
        files.write_swapped(found if given.command == "chunk-all" else found.filter("place.region = 1"), target)
    elif given.command == "index":
        print(files.save_index(spark.read.parquet(source), target))
    elif given.command == "search":
        postings, terms, _ = files.load_index(spark, source)
        one, text = spark.createDataFrame([(1, target)], "query_id long, text string"), F.col("text")
        structural = citation.query_terms(citation.article_numbers(text), citation.clause_numbers(text), citation.detect_document(text))
        asked = bm25.terms(one, "query_id", text, structural)
        bm25.search(postings, "chunk_id", bm25.query_weights(asked, "query_id", terms), "query_id", 20).show(20, False)
    elif given.command == "eval":
        code, said = runs.exit_code(lambda: evaluate(spark, source, target))
        print(said, file=sys.stderr if code == runs.WRONG_INPUT else sys.stdout)
        return code
    else:
        catalog.QUERIES[source](spark, target).show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
