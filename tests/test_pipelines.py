"""Sources, plug-ins, the vector table, questions and the stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import indexing, retrieval
from quillspark.plans.answer import ask
from quillspark.plans.ingest import chunks_to_vectors, texts_to_chunks, upsert_vectors
from quillspark.plugins import HashEmbedder, TooManyRequests, embed_texts, with_retries
from quillspark.sources import books
from quillspark.sources.html import html_text, is_navigation
from quillspark.sources.tables import read_chunks, write_chunks
from quillspark.streaming.ingest import chunk_stream, current_version, text_stream


def test_html_blocks():
    assert html_text("<div><p>A <b>b</b>, c</p></div>") == "A b , c\n\nA b , c"
    assert html_text("<div><p>A <b>b</b>, c</p></div>", leaves_only=True) == "A b , c"
    assert html_text("<body>one\n two</body>") == "one\n\ntwo"
    assert html_text("<nav><p>x</p></nav><script>y</script><p>z") == "z"
    assert html_text(None) == "" and html_text("") == ""
    assert is_navigation("OPS/toc.xhtml", "") and not is_navigation("c1.xhtml", "<p>" + "a" * 200)


def book(spine=("c2", "c1", "c2")):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="part{i}.xhtml" media-type="application/xhtml+xml"/>' for i in (1, 2, 3))
        refs = "".join(f'<itemref idref="{x}"/>' for x in spine)
        z.writestr(
            "O/p.opf",
            '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title>'
            f"</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>",
        )
        for i in (1, 2, 3):
            z.writestr(f"O/part{i}.xhtml", f"<html><body><p>{f'text {i} ' * 30}</p></body></html>")
    return data.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.epub").write_bytes(b"not a zip")
    items = books.epub_items(books.read_files(spark, str(tmp_path), "*.epub")).cache()
    texts = {r.source_file: r.text for r in books.book_texts(items).collect()}
    assert list(texts) == ["a.epub"]
    assert [p[:6] for p in texts["a.epub"].split("\n\n")] == ["text 2", "text 1", "text 3"]
    assert items.where("source_file = 'b.epub'").first().error.startswith("BadZipFile")
    assert books.book_metadata(items.where("error is null")).first().title == "T"


def test_spine_order(spark):
    spine = spark.createDataFrame([("b", 0, "c2"), ("b", 1, "c1"), ("b", 2, "c2"), ("b", 3, "gone")], "source_file string, spine_pos int, item_id string")
    items = spark.createDataFrame([("b", f"c{i}", f"h{i}", i) for i in (1, 2, 3)], "source_file string, item_id string, href string, container_pos int")
    assert [r.href for r in books.spine_order(spine, items).orderBy("place").collect()] == ["h2", "h1", "h3"]


def test_pages(spark):
    pages = [[{"text": "12\nA word bro-\nken here\nGRAND SERIES", "kind": 0}, {"text": "image", "kind": 1}], [{"text": "ends.\nNew one", "kind": 0}]]
    df = spark.createDataFrame([(pages,)], "pages array<array<struct<text:string,kind:int>>>")
    assert df.select(books.page_text(F.col("pages"), series="grand series")).first()[0] == "A word broken here\n\nends.\n\nNew one"
    bad = books.pages_of(spark.createDataFrame([("a", bytearray(b"x"))], "source_file string, content binary"), lambda b: 1 / 0)
    assert bad.first().error.startswith("ZeroDivisionError")


def test_retries():
    waits, calls = [], []

    def busy(texts):
        calls.append(1)
        if len(calls) < 4:
            raise TooManyRequests
        return [[1.0]]

    assert with_retries(busy, ["a"], waits.append) == [[1.0]]
    assert waits == [5.0, 10.0, 20.0]
    with pytest.raises(TooManyRequests):
        with_retries(lambda t: (_ for _ in ()).throw(TooManyRequests()), ["a"], waits.append)


def test_failed_batches_are_kept_apart(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[1.0, 0.0]] * len(texts)

    df = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", None)], "id string, text string").coalesce(1)
    rows = {r.id: (r["values"], r.error) for r in embed_texts(df, embed, batch_rows=1).collect()}
    assert rows["a"][1] is None and rows["b"] == (None, "ValueError: no") and rows["c"][0] == [1.0, 0.0]


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, version int, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 1, "w"), ("c", None, "n")], "id string, version int, v string")
    once = indexing.upsert(old, new)
    assert {r.id: r.v for r in once.collect()} == {"a": "z", "b": "y", "c": "n"}
    assert {r.id: r.v for r in indexing.upsert(once, new).collect()} == {"a": "z", "b": "y", "c": "n"}


def test_batches(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(107)], "id string").repartition(5)
    sizes = {r.batch: r["rows"] for r in indexing.batch_sizes(indexing.numbered_batches(df)).collect()}
    assert sizes == {1: 50, 2: 50, 3: 7}
    assert indexing.numbered_batches(df.limit(0)).count() == 0


def test_top_similar_ties_and_bad_vectors(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0, 0.0]), ("d", [0.0, 1.0]), ("e", None), ("f", [0.0, 0.0]), ("g", [1.0])], "id string, values array<double>"
    ).repartition(3)
    asked = spark.createDataFrame([("q", [3.0, 0.0]), ("n", None)], "query_id string, values array<double>")
    hits = retrieval.top_similar(asked, rows, 2, k=2).orderBy("rank").collect()
    assert [(h.query_id, h.id, round(h.score, 6)) for h in hits] == [("q", "a", 1.0), ("q", "b", 1.0)]


def test_relevance(spark):
    df = spark.createDataFrame([("q", i + 1, s) for i, s in enumerate((0.95, 0.8, 0.75, 0.72, 0.7, 0.6))] + [("p", 1, 0.71), ("p", 2, 0.7)], "query_id string, rank int, score double")
    kept = [(r.query_id, r.score) for r in retrieval.relevant(df).orderBy("query_id", "rank").collect()]
    assert kept == [("p", 0.71), ("q", 0.95), ("q", 0.8), ("q", 0.75)]


def test_from_texts_to_answers(spark, tmp_path):
    prose = "The golden wolf crosses the silent river at night, and the old woman waits for it by the bridge. " * 4
    texts = spark.createDataFrame([("A - Wolf Book - P (1950).txt", prose + "\n" + prose), ("empty.txt", "")], "source_file string, text string")
    chunks = texts_to_chunks(texts).cache()
    assert chunks.count() == 1 and chunks.first().work_title == "Wolf Book (1950)"
    write_chunks(chunks, str(tmp_path / "json"), embedding_text=True)
    assert read_chunks(spark, str(tmp_path / "json") + "/*.json", True).first().text_for_embedding.startswith("passage: The golden")
    embed = HashEmbedder(64)
    records, failed = chunks_to_vectors(chunks, embed)
    assert failed.count() == 0
    vectors = upsert_vectors(records.withColumn("version", F.lit(None).cast("timestamp")).limit(0), records).cache()
    history = [{"role": "user", "content": "hello"}]
    questions = spark.createDataFrame(
        [(1, prose, history), (2, "zebra", None), (3, " ", None)], "query_id long, query string, history array<struct<role:string,content:string>>"
    )
    out = {r.query_id: r for r in ask(questions, vectors, embed, 64, lambda system, messages: messages[-1]["content"][:5]).collect()}
    assert set(out) == {1, 2}
    assert out[1].citations == "[1] Wolf Book (1950)" and out[1].message == "The g" and len(out[1].messages) == 2
    assert out[2].hits == 0 and "No relevant sources" in out[2].system


def test_stream(spark, tmp_path):
    def arrive(name, text, at):
        df = spark.createDataFrame([(name, text, at)], "source_file string, text string, at string")
        df.select("source_file", "text", F.to_timestamp("at").alias("arrived")).write.mode("append").parquet(str(tmp_path / "in"))

    table = str(tmp_path / "table")
    prose = "Some words about the river and the bridge. " * 20
    arrive("a.txt", prose, "2024-01-01")
    for turn in range(2):
        chunk_stream(text_stream(spark, str(tmp_path / "in")), table, str(tmp_path / "cp")).awaitTermination()
        arrive("b.txt", prose, "2024-01-02")
    assert {r.source_file for r in current_version(spark, table).collect()} == {"a.txt", "b.txt"}


def test_stream_replaces_a_text(spark, tmp_path):
    """A text that comes again with fewer chunks leaves none behind; an older delivery changes nothing; old files go."""
    table, prose = str(tmp_path / "table"), "Some words about the river and the bridge. " * 20

    def arrive(*rows):
        df = spark.createDataFrame(rows, "source_file string, text string, at string")
        df.select("source_file", "text", F.to_timestamp("at").alias("arrived")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        chunk_stream(text_stream(spark, str(tmp_path / "in")), table, str(tmp_path / "cp")).awaitTermination()
        return {(r.source_file, r.chunk_index): r.text for r in current_version(spark, table).collect()}

    long = "\n\n".join(f"{k} " + prose for k in range(6))
    first = arrive(("a.txt", long, "2024-01-02"), ("b.txt", prose, "2024-01-01"))
    count = sum(k[0] == "a.txt" for k in first)
    assert count > 1 and ("b.txt", 0) in first
    second = arrive(("a.txt", "New: " + prose, "2024-01-03"))
    assert sum(k[0] == "a.txt" for k in second) == 1 and second["a.txt", 0].startswith("New") and second["b.txt", 0] == first["b.txt", 0]
    assert arrive(("a.txt", long, "2024-01-01"), ("c.txt", prose, "2024-01-01")) == second | {("c.txt", 0): second["b.txt", 0]}
    arrive(("a.txt", None, "2024-01-04"))
    assert sum(k[0] == "a.txt" for k in ((r.source_file, 0) for r in current_version(spark, table).collect())) == 0
    assert len(list((tmp_path / "table" / "data").glob("*/bucket=*"))) <= 5


def test_failed_questions_have_their_error(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[1.0, 0.0]] * len(texts)

    vectors = spark.createDataFrame(
        [("v", [1.0, 0.0], ("W", None, "text"))], "id string, values array<float>, metadata struct<work_title:string,chapter:string,text:string>"
    )
    questions = spark.createDataFrame([(1, "good", None), (2, "bad", None)], "query_id int, query string, history array<struct<role:string,content:string>>").repartition(2, "query_id")
    out = {r.query_id: r for r in ask(questions, vectors, embed, 2, lambda system, messages: "yes").collect()}
    assert out[1].message == "yes" and out[1].hits == 1 and out[1].embedding_error is None
    assert out[2].message is None and out[2].system is None and out[2].embedding_error == "ValueError: no"
    assert calls.value == 2


@pytest.mark.parametrize("queries,k", [(3, 2), (700, 6)])
def test_top_similar_equals_brute_force(spark, queries, k):
    import numpy as np

    rng = np.random.default_rng(4)
    x, q = rng.integers(-2, 3, (900, 4)).astype(float), rng.integers(-2, 3, (queries, 4)).astype(float)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(900)], "id int, values array<double>").repartition(4)
    asked = spark.createDataFrame([(f"q{i}", q[i].tolist()) for i in range(queries)], "query_id string, values array<double>")
    got = {}
    for r in retrieval.top_similar(asked, rows, 4, k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(round(r.score, 9))
    good = np.flatnonzero(x.any(1))
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    for i in range(queries):
        expected = sorted((unit(x[good]) @ unit(q[i : i + 1])[0]).tolist(), reverse=True)[:k] if q[i].any() else []
        assert got.get(f"q{i}", []) == [round(s, 9) for s in expected]


def test_shared_folder_of_a_cluster_must_be_named():
    from types import SimpleNamespace

    from quillspark import staging

    for master in ("spark://host:7077", "k8s://host", "yarn"):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, applicationId="a"))
        with pytest.raises(RuntimeError):
            staging.shared_folder(fake)


def test_steps_from_the_command_line(spark, tmp_path, capsys):
    from quillspark.__main__ import main

    prose = "<p>" + "The golden wolf crosses the silent river at night, and the old woman waits. " * 30 + "</p>"
    items = [("one.xhtml", f"<html><body><h1>CHAPTER I: Wolf</h1>{prose}</body></html>")]
    df = spark.createDataFrame([("a.epub", items, ["one.xhtml"])], "source_file string, items array<struct<href:string,html:string>>, spine array<string>")
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "a.epub").write_bytes(bytes(books.pack_books(df).first().content))
    (tmp_path / "books" / "b.epub").write_bytes(b"no zip")
    at = lambda name: str(tmp_path / name)
    main(["epub", at("books"), at("extracted")])
    main(["clean", at("extracted"), at("cleaned"), "--author", "Maria", "Stone"])
    main(["chunk", at("cleaned"), at("chunks")])
    main(["evaluate", at("cleaned")])
    out = capsys.readouterr().out
    assert "BadZipFile" in out and "avg_score" in out
    assert read_chunks(spark, at("chunks-all") + "/*.json", True).first().chapter == "Chapter I: Wolf"


def test_an_index_has_one_length_and_metric(spark, tmp_path):
    from quillspark.sources.tables import ensure_index

    path = str(tmp_path / "index")
    for _ in range(2):
        ensure_index(spark, path, 2)
    for other in ({"dim": 3}, {"dim": 2, "metric": "dot"}):
        with pytest.raises(ValueError):
            ensure_index(spark, path, **other)
    held = spark.createDataFrame([("a", [1.0, 0.0], None)], "id string, values array<float>, version timestamp")
    good = spark.createDataFrame([("b", [0.0, 1.0])], "id string, values array<float>")
    assert {r.id for r in upsert_vectors(held, good, 2).collect()} == {"a", "b"}
    for bad in ([1.0], None):
        with pytest.raises(Exception, match="another length"):
            upsert_vectors(held, good.union(spark.createDataFrame([("c", bad)], good.schema)), 2).collect()
