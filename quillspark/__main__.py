"""``python -m quillspark STEP [IN] [OUT]``: the steps from books to chunks, with the folders' usual names as defaults.

    epub      books/      extracted/   texts of EPUB files, and their metadata beside them
    clean     extracted/  cleaned/     texts without front and back matter, headers and marks
    chunk     cleaned/    chunks/      chunks by source file, as JSON, and all with the text that is embedded
    evaluate  cleaned/                 the quality report, best first, and its summary

Folders hold Parquet files of ``source_file, text``, or text files.  ``--author First Surname [Middle]``, ``--publisher``
(a pattern, again and again) and ``--lexicon`` (a Parquet file of ordinal, concept, pattern) are what the steps need to know
of a corpus.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.patterns import Author
from quillspark.operators.chunking import chunk_statistics, chunk_totals, pack_chunks
from quillspark.operators.cleaning import clean_documents
from quillspark.operators.quality import quality_scores, quality_summary
from quillspark.operators.tagging import read_lexicon, top_concepts
from quillspark.sources.books import book_metadata, book_texts, epub_items, read_files, read_texts, write_texts
from quillspark.sources.tables import write_chunks
from quillspark.staging import ship, written

FOLDERS = {"epub": ("books", "extracted"), "clean": ("extracted", "cleaned"), "chunk": ("cleaned", "chunks"), "evaluate": ("cleaned", None)}


def texts_of(spark: SparkSession, folder: str) -> DataFrame:
    """``source_file, text`` of a folder of Parquet or text files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return spark.read.parquet(folder).select("source_file", "text") if found else read_texts(spark, folder)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    ship(spark)
    source, target = FOLDERS[args.step]
    source, target = args.source or source, args.target or target
    if args.step == "epub":
        items = written(epub_items(read_files(spark, source, "*.epub")), "items")
        write_texts(book_texts(items), target)
        book_metadata(items).write.mode("overwrite").parquet(f"{target}-metadata")
        items.where("error is not null").select("source_file", "error").show(100, truncate=False)
    elif args.step == "clean":
        author = Author(*args.author[:2], *args.author[2:3]) if args.author else None
        write_texts(clean_documents(texts_of(spark, source), author=author, publishers=tuple(args.publisher)), target)
    elif args.step == "chunk":
        lexicon = read_lexicon(spark.read.parquet(args.lexicon), "ordinal", "concept", "pattern") if args.lexicon else None
        chunks = written(pack_chunks(texts_of(spark, source), "source_file", lexicon=lexicon, publishers=tuple(args.publisher)), "chunks")
        write_chunks(chunks, target)
        write_chunks(chunks, f"{target}-all", embedding_text=True)
        dated = chunks.withColumn("ingested_at", F.lit(None).cast("timestamp"))
        chunk_statistics(dated).orderBy("source_file").show(100, truncate=False)
        chunk_totals(dated).show()
        top_concepts(chunks).show(truncate=False)
    else:
        scores = written(quality_scores(texts_of(spark, source), "source_file"), "scores")
        scores.orderBy(F.desc("score"), "source_file").show(1_000, truncate=60)
        quality_summary(scores).show()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("step", choices=FOLDERS)
    parser.add_argument("source", nargs="?")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--author", nargs="+", metavar="NAME")
    parser.add_argument("--publisher", action="append", default=[])
    parser.add_argument("--lexicon")
    run(SparkSession.builder.appName("quillspark").getOrCreate(), parser.parse_args(argv))


if __name__ == "__main__":
    main()
