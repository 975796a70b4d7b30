"""Edges of operators that the queries over the given tables don't reach."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import latex, redact as redaction, text as tx, vectors
from tessera.functions.html import page_markdown
from tessera.functions.redact import Redaction, inflections, redact
from tessera.operators import chunking, layout, registry, retrieval, sync
from tessera.operators.store import ChunkStore, usable_postings
from tessera.schema import CHUNKS
from tessera.sources import discovery, extract, trec


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("r")).first()["r"]


def packed(text: str, most: int, overlap: int) -> list[str]:
    """The chunker, sentence by sentence."""
    text = text.strip()
    if not text:
        return []
    if len(text) <= most:
        return [text]
    done, held, size = [], "", 0
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if held and size + len(sentence) > most:
            done.append(held)
            tail = held[-overlap:] if len(held) > overlap else ""
            tail = tail[tail.find(" ") + 1 :] if " " in tail else tail
            held, size = tail, len(tail)
        held = f"{held} {sentence}" if held else sentence
        size += len(sentence) + 1
    return [*done, held]


@pytest.mark.parametrize("text", ["", "  \n ", "One. Two! Three? Four.", "a" * 50 + ". " + "b" * 10 + ". c.", "x. " * 40, "no end " * 30, "A.\n\nB.  C."])
def test_chunks(spark, text):
    assert one(spark, text, lambda c: tx.chunk(c, 40, 12)) == packed(text, 40, 12)


def test_sections(spark):
    assert one(spark, "intro\n# A\nx\n<!-- c -->\n## B\ny", tx.markdown_sections) == ["intro\n", "# A\nx\n<!-- c -->\n", "## B\ny"]
    assert one(spark, "<!-- only -->\n# A\nx", tx.markdown_sections) == ["# A\nx"]
    assert one(spark, "a\n \nb\n\n\n c", tx.paragraphs) == ["a", "b", " c"]


def test_cosine_edges(spark):
    rows = spark.createDataFrame([(None,), ([0.0, 0.0],), ([1.0, 0.0],), ([0.0, 2.0],)], "v array<float>")
    assert [r[0] for r in rows.select(vectors.cosine_distance(F.col("v"), [3.0, 0.0])).collect()] == [2.0, 2.0, 0.0, 1.0]
    assert {r[0] for r in rows.select(vectors.cosine_distance(F.col("v"), [0.0, 0.0])).collect()} == {2.0}
    assert one(spark, "1.5", lambda c: vectors.similarity(c.cast("double"))) == -0.5
    with pytest.raises(Exception, match="out of range"):
        one(spark, "2.5", lambda c: vectors.similarity(c.cast("double")))


def test_embedding_takes_the_first_tokens_only():
    make = vectors.HashingBackend(64, max_tokens=5).load()
    one, more, other = make(["a b c d e", "a b c d e f g", "a b c d f"])
    assert (one == more).all() and (one != other).any()


def test_fusion(spark):
    schema = "document_name string, chunk_index int, page_number int, text string, rank int"
    a = spark.createDataFrame([("d", 0, 1, "a", 0), ("d", 1, 1, "b", 1)], schema)
    b = spark.createDataFrame([("d", 1, 1, "other", 0), ("e", 0, 1, "c", 1)], schema)
    rows = retrieval.fuse([a, b], 10).collect()
    assert [(r["document_name"], r["chunk_index"], r["text"]) for r in rows] == [("d", 1, "b"), ("d", 0, "a"), ("e", 0, "c")]
    assert rows[0]["rrf"] == pytest.approx(1 / 61 + 1 / 60)
    assert retrieval.fuse([a.limit(0), b.limit(0)], 10).count() == 0
    assert len(retrieval.fuse([a, b], 1).collect()) == 1


def test_decay(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    weigh = lambda kind, at, rate: one(spark, at, lambda c: retrieval.decay_weight(F.lit(kind), c, now, rate))
    assert weigh("fact", "2026-01-01 00:00:00", 0.1) == pytest.approx(2.718281828 ** (-2.4), rel=1e-6)
    assert weigh("fact", "2027-01-01", 0.1) == weigh("fact", "no time", 0.1) == weigh("", "2026-01-01", 0.1) == weigh("fact", "2026-01-01", 0) == 1.0


def test_limits():
    assert [retrieval.clamp_limit(v) for v in (0, 99, "7", "x", None)] == [1, 50, 7, 10, 10]
    with pytest.raises(ValueError):
        retrieval.strict_limit(0)


def test_bm25_edges(spark, sf_dir, tmp_path):
    from tessera.plans.tables import chunk_rows

    rows = chunk_rows(spark, sf_dir)
    terms, stats = retrieval.postings(rows)
    terms.write.partitionBy("page_number").parquet(str(tmp_path / "postings"))
    stored = (spark.read.parquet(str(tmp_path / "postings")), stats)
    words = "that the it is of und der le"
    fresh = retrieval.bm25_top_k(rows, words, 40).select("document_name", "chunk_index", "score").collect()
    assert len(fresh) == 40 and fresh == retrieval.bm25_top_k(rows, words, 40, index=stored).select("document_name", "chunk_index", "score").collect()
    assert retrieval.bm25_top_k(rows, "", 5).count() == 0 == retrieval.bm25_top_k(rows.limit(0), words, 5).count()


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("a@b.example", "[REDACTED:email]"), ("x_TOKEN=abc\r\nnext", "x_TOKEN=[REDACTED:env-secret]\r\nnext"), ("token=abc", "token=abc"),
        ("ghp_" + "a" * 20, "ghp_" + "a" * 20), ("see https://x.org/home/me", "see https://x.org/home/me"), ("/Users/me/x", "~/x"), ("Damn!", "[REDACTED:profanity]!"),
        ("shell class heller", "shell class heller"), ("a" * 40, "a" * 40), ("", ""),
    ],
)
def test_redaction(spark, text, clean):
    assert one(spark, text, redact) == clean
    assert one(spark, clean, redact) == clean


def test_inflections():
    assert {"damned", "damning"} <= inflections("damn")
    assert {"pissed", "pisses"} <= inflections("piss")


def test_html():
    page = "<html><head><title>T &amp; U</title></head><body><nav>menu</nav><p>One <b>two<p>three<script>var x='</p>';</script></body></html>"
    found = page_markdown(page)
    assert found.startswith("# T & U\n\nOne **two") and "menu" not in found and "var" not in found
    assert page_markdown("<body><h2>H</h2><ul><li>a</li><li>b</li></ul></body>") == "## H\n\n- a\n- b"
    assert page_markdown(None) == page_markdown("<nav>x</nav>") == ""


def test_latex():
    assert latex.escape("a_b\\{~") == r"a\_b\textbackslash{}\{\textasciitilde{}"
    assert latex.tabular(["h", "i"], [["1"], ["1", "2", "3"]]).split("\n")[4:6] == [r"1 &  \\", r"1 & 2 \\"]
    assert latex.tabular([], [["1"]]) == "" and latex.tables([], [], None) == []
    many = latex.tables(["h"], [[str(k)] for k in range(50)], "S", 150)
    assert len(many) > 3 and all(len(t) <= 150 and t.startswith("% Sheet: S") for t in many)
    assert latex.front_matter_block("---\nmemory:\n  a: b # c\n  d: e\nother: f\n---\nx", "memory") == {"a": "b", "d": "e"}
    assert latex.front_matter_block("no", "memory") is None


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_extract(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{s}"/>""" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    (tmp_path / "a.docx").write_bytes(_zip({"word/document.xml": f"<w:document {w}><w:body>{p('pre')}{p('H', 'Heading1')}{p('')}{p('body')}</w:body></w:document>"}))
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>y</t></is></c></row><row><c r="B2"><v>3</v></c></row></sheetData></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(_zip({
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet,
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>x</t></si></sst>',
    }))
    d, s = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    mark = lambda ph: f'<p:ph type="{ph}"/>' if ph else ""
    sp = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{mark(ph)}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda body: f'<p:sld xmlns:p="{s}" xmlns:a="{d}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>'
    (tmp_path / "c.pptx").write_bytes(_zip({"ppt/slides/slide2.xml": slide(sp("T", "title") + sp("b_c")), "ppt/slides/slide1.xml": slide("")}))
    (tmp_path / "d.py").write_text("import os\n# c\n@dec\ndef f():\n    pass\nx = 1\nclass A: pass\n")
    (tmp_path / "e.go").write_text("a\n\nb\n")
    (tmp_path / "f.csv").write_text("h,i\n1,2\n")
    (tmp_path / "g.txt").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "h.html").write_text("<body><h1>A</h1>x</body>")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "i.exe").write_bytes(b"x")
    rows = extract.extract_pages(extract.files(spark, str(tmp_path))).orderBy("document_name", "page_number").collect()
    by = {}
    for row in rows:
        by.setdefault(row["document_name"], []).append(row["text"])
        assert row["page_number"] == len(by[row["document_name"]]) and (row["error"] or row["total_pages"] >= row["page_number"])
    assert by["a.docx"] == ["pre", "H\nbody"] and by["d.py"] == ["import os\n# c", "@dec\ndef f():\n    pass", "x = 1", "class A: pass"]
    assert by["e.go"] == ["a\nb"] and by["g.txt"] == ["café"] and by["h.html"] == ["# A\n\nx"]
    assert r"x & y \\" in by["b.xlsx"][0] and r" & 3 \\" in by["b.xlsx"][0] and r"1 & 2 \\" in by["f.csv"][0]
    assert by["c.pptx"] == ["# T\n\nb\\_c"] and "i.exe" not in by
    assert [r["error"][:10] for r in rows if r["error"]] == ["BadZipFile"]


LINE = "page int, block int, line int, text string, x0 double, y0 double, x1 double, y1 double, height double"


def test_layout(spark):
    rows = [
        (1, 0, 0, "An informa-", 50, 100, 500, 110, 800), (1, 0, 1, "tion self-", 50, 112, 500, 122, 800), (1, 0, 2, "made end.", 50, 124, 300, 134, 800),
        (1, 0, 3, "New start 10-", 50, 136, 500, 146, 800), (1, 0, 4, "20 here", 50, 148, 200, 158, 800),
        (1, 1, 0, "12", 250, 780, 260, 790, 800), (1, 2, 0, "1999", 250, 5, 260, 15, 800),
        (2, 0, 0, "Intro", 50, 100, 90, 110, 800), (2, 0, 1, ". . . . .", 100, 101, 300, 111, 800), (2, 0, 2, "1", 310, 102, 320, 112, 800),
        (2, 0, 3, "Next", 50, 120, 90, 130, 800), (2, 0, 4, "......", 100, 120, 300, 130, 800), (2, 0, 5, "9", 310, 121, 320, 131, 800),
    ]
    lines = spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], LINE)
    found = {r["page"]: r["text"] for r in layout.page_texts(lines, ["page"]).collect()}
    assert found[1] == "An information self-made end.\n\nNew start 10-20 here\n\n1999"
    assert found[2] == "Intro . . . . . 1\n\nNext ...... 9"
    assert one(spark, "x" * 49 + "  ", layout.page_class) == "image" and one(spark, "x" * 50, layout.page_class) == "text"


def test_store(spark, tmp_path):
    def rows(*names, collection="c", index=0):
        made = spark.createDataFrame([(n, collection, index) for n in names], "document_name string, collection string, chunk_index int").withColumn("text", F.lit("t"))
        return made.withColumn("page_number", F.lit(1))

    store = ChunkStore(spark, str(tmp_path / "t"))
    assert store.count() == 0 and store.append(rows()) == 0 and store.read().schema == CHUNKS
    assert store.append(rows("a", "b", "it's")) == 3 and store.append(rows("a", index=1)) == 1 and store.append(rows("a", collection="d/e")) == 1
    first = store.versions()[-1]
    assert store.count("c") == 4 and store.count() == 5 and store.collections() == ["c", "d/e"]
    assert store.delete_document("it's") == 1 and store.delete_document("none") == 0
    with pytest.raises(ValueError):
        store.delete_tail("a", "c", 0)
    assert store.delete_tail("a", "c", 1) == 1 and store.count("c") == 2
    assert store.overwrite(rows("a", index=7)) == 1 and {(r["document_name"], r["chunk_index"]) for r in store.read("c").collect()} == {("a", 7), ("b", 0)}
    assert store.overwrite(rows()) == 0 and store.count("c") == 2
    assert store.read(version=first).count() == 5
    assert store.delete_collection("c") == 2 and store.delete_collection("c") == 0 and store.count() == 1
    store.append(spark.range(400).select(F.concat(F.lit("m"), F.col("id")).alias("document_name"), F.lit("many").alias("collection"), F.lit(1).alias("page_number"), F.col("id").cast("int").alias("chunk_index")).repartition(9))
    assert store.compact(3)["compacted"] and 1 < len(store.read("many").inputFiles()) <= 3 and store.count("many") == 400
    assert store.delete_collection("many") == 400
    assert store.compact()["compacted"] and not store.compact(most_files=0)["compacted"] and store.prune() > 0 and store.count() == 1


def test_finalize(spark, tmp_path):
    rows = spark.createDataFrame([("a", "c", 0, "red fox"), ("b", "c", 0, "blue fox")], "document_name string, collection string, chunk_index int, text string")
    rows = rows.withColumns({"page_number": F.lit(1), "vector": F.array(F.lit(1.0), F.lit(0.0))})
    kept = ChunkStore(spark, str(tmp_path / "t"))
    kept.append(rows.limit(1))
    kept.append(rows.where("document_name = 'b'"))
    before = kept.versions()

    def broken(chunks):
        raise OSError("no way there")

    done = kept.finalize(str(tmp_path / "i"), broken)
    assert done["compacted"] and done["error"] == "no way there" and done["pruned"] == 0 and set(before) < set(kept.versions())
    index = usable_postings(spark, done["index"])
    assert [r["document_name"] for r in retrieval.bm25_top_k(kept.read(), "red", 5, index=index).collect()] == ["a"]
    assert kept.prune(older_than=0.0) > 0 and len(kept.versions()) == 1 and kept.count() == 2
    with pytest.warns(UserWarning):
        assert usable_postings(spark, str(tmp_path / "none")) is False
    hits = retrieval.hybrid_search(kept.read(), "red", [1.0, 0.0], 2, F.current_timestamp(), index=False)
    assert hits.count() == 2 and ChunkStore(spark, str(tmp_path / "empty")).read().count() == 0


def test_sync_of_one_file(spark):
    planned = spark.createDataFrame([("/a", "ingest"), ("/b", "unchanged"), ("/c", "delete")], "path string, action string")
    assert sync.one_file(planned, "/a").count() == 1 and sync.one_file(planned, "/b").count() == 0 and sync.one_file(planned, "/c").count() == 0


def test_counted_collection_name(spark):
    digest = hashlib.sha256(b"/x/d").hexdigest()
    names = ["d", "d-x", *(f"d-{digest[:n]}" for n in range(8, 65)), f"d-{digest}-2", f"d-{digest}-4"]
    found = registry.named_collections(spark.createDataFrame([("/x/d",)], "directory string"), spark.createDataFrame([(n,) for n in names], "collection string"))
    assert found.first()["collection"] == f"d-{digest}-3"


def test_rescan_of_part_of_a_listing(spark):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "collection string")
    gone, purge = registry.rescan(one("a", "b"), one("a"), False, one("c"), one("c"), one("a"), one())
    assert gone.count() == 0 and purge.count() == 0
    gone, purge = registry.rescan(one("a", "b"), one("a"), True, one("c"), one("c"), one("a"), one())
    assert gone.first()["collection"] == "b" and purge.first()["collection"] == "c"


def test_chunk_rows(spark):
    pages = spark.createDataFrame([("d", 2, 2, " b ", "image"), ("d", 1, 2, "a", "section"), ("d", 3, 2, " ", "text")], "document_name string, page_number int, total_pages int, text string, page_type string")
    rows = chunking.ingest(pages, F.lit("2026-01-01"), vectors.HashingBackend(8)).orderBy("chunk_index").collect()
    assert [(r["text"], r["page_raw_text"], r["page_type"], r["chunk_index"]) for r in rows] == [("a", "a", "text", 0), ("b", " b ", "text", 1)]
    assert all(abs(sum(v * v for v in r["vector"]) - 1) < 1e-5 for r in rows)
    assert chunking.ingest(pages.limit(0), F.lit("2026-01-01")).count() == 0


def test_resume(spark):
    row = spark.range(1).select(
        sync.resume_from(F.lit(2), F.lit(5), F.lit("h"), F.lit("h"), F.lit(True)).alias("a"), sync.resume_from(F.lit(2), F.lit(5), F.lit("unknown"), F.lit("unknown"), F.lit(True)).alias("b"),
        sync.resume_from(F.lit(5), F.lit(5), F.lit("h"), F.lit("h"), F.lit(True)).alias("c"), sync.resume_from(F.lit(2), F.lit(5), F.lit(None).cast("string"), F.lit("h"), F.lit(True)).alias("d"),
    ).first()
    assert tuple(row) == (2, 0, 0, 0)


def test_discovery(spark, tmp_path, monkeypatch):
    for name in ("a.md", "b.log.md", "sub/c.md", "sub/skip.md", "sub/deep/skip.md", "node_modules/x.md", ".hid/x.md", "e.exe", "out/z.md"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text("x")
    (tmp_path / "r/.gitignore").write_text("# c\n*.log.md\nout/\n")
    (tmp_path / "r/sub/.gitignore").write_text("skip.md\n")
    repository = {"/repo/.git", "/repo/.tmp/inner/.git"}.__contains__
    for root in ("/tmp", "/tmp/x", "/PRIVATE/TMP/x", "file:///var/folders/a"):
        assert discovery.refuses_root(root), root
    for root in ("/repo/.tmp", "/repo/.tmp/x", "/repo/.tmp/inner/x"):
        assert discovery.refuses_root(root, exists=repository), root
    for root in ("/home/x", "/tmpx", "/srv/tmp/x", "/other/.tmp/x", "/repo/.TMP/x", "/repo/sub/.tmp/x", "/repo"):
        assert not discovery.refuses_root(root, exists=repository), root
    (tmp_path / "r/.git").mkdir()
    (tmp_path / "r/.tmp").mkdir()
    monkeypatch.setattr(discovery, "TEMPORARY", ())
    assert not discovery.discover(spark, str(tmp_path / "r/.tmp")).count()
    monkeypatch.setattr(discovery, "refuses_root", lambda *_: False)  # the test's own folder is a temporary one
    found = [r["relative"] for r in discovery.discover(spark, str(tmp_path / "r")).collect()]
    assert found == ["a.md", "sub/c.md", "sub/deep/skip.md"]


def test_query_set(spark, tmp_path):
    good = '{"id": "q1", "text": "t", "bucket": "natural", "split": "dev", "answer": null}\n'
    (tmp_path / "good.jsonl").write_text(good)
    assert trec.read_query_set(spark, str(tmp_path / "good.jsonl")).count() == 1
    for k, bad in enumerate((good + good, good.replace("natural", "other"))):
        (tmp_path / f"bad{k}.jsonl").write_text(bad)
        with pytest.raises(Exception, match="bad query"):
            trec.read_query_set(spark, str(tmp_path / f"bad{k}.jsonl")).collect()


def test_debounced_stream(spark, sf_dir, tmp_path):
    """A stream that ends gives the batches that the replay of its log does, but for those still open at its end."""
    from tessera.plans.ingest import HOUR, changes
    from tessera.streaming import watch

    events = changes(spark, sf_dir)
    total = events.count()
    for k in range(4):
        events.where((F.col("seq") >= k * total // 4) & (F.col("seq") < (k + 1) * total // 4)).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / "in/*")]).withWatermark("ts", "0 seconds")
    query = watch.debounced(stream.select(events.columns), 4 * HOUR, 12 * HOUR, 3).writeStream.format("memory").queryName("debounced").outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {tuple(r) for r in spark.table("debounced").collect()}
    whole = {tuple(r) for r in watch.debounced_batch(events, 4 * HOUR, 12 * HOUR, 3).select("database", "collection", "path", "deleted", "bulk", "flushed_ms").collect()}
    end = events.agg(F.unix_millis(F.max("ts"))).first()[0]
    assert got and got <= whole
    assert {r for r in whole if r[5] < end} <= got


def test_batch_search_covers_all_items(spark, sf_dir):
    from tessera.plans import QUERIES
    from tessera.plans.tables import table

    items = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "embeddings"), F.col("item_id") == F.col("vec_id"))
    wanted = {r["item_id"] for r in items.select("item_id").collect()}
    found = QUERIES["batch_search_all"](spark, sf_dir).collect()
    assert len(wanted) > 8 and {r["query_id"] for r in found} == wanted
    assert sorted(found) == sorted(QUERIES["batch_search"](spark, sf_dir).collect())


def test_batch_search_blocks(spark):
    rows = [(f"d{k}", 1, 0, f"w{k % 3} all", [float(k), 1.0]) for k in range(12)]
    chunks = spark.createDataFrame(rows, "document_name string, page_number int, chunk_index int, text string, vector array<float>")
    asked = [(k, f"w{k % 4}", [float(k), 2.0]) for k in range(7)]
    queries = spark.createDataFrame(asked, "query_id long, text string, vector array<float>")
    whole = retrieval.batch_search(chunks, queries, 3, 12).collect()
    found = retrieval.batch_search(chunks, queries, 3, 12, block=2).collect()
    assert len(found) == 21 and sorted(map(str, found)) == sorted(map(str, whole))
    for key, word, v in asked:
        cosine = lambda w: sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5
        near = sorted(rows, key=lambda r: (-cosine(r[4]), r[0]))
        worded = sorted((r for r in rows if word in r[3].split()), key=lambda r: r[0])
        score = {r[0]: 1 / (60 + near.index(r)) + (1 / (60 + worded.index(r)) if r in worded else 0) for r in rows}
        best = sorted(score, key=lambda d: (-round(score[d], 12), near.index(next(r for r in rows if r[0] == d))))[:3]
        assert [r["document_name"] for r in sorted(found, key=lambda r: r["position"]) if r["query_id"] == key] == best


def test_batch_search_where_a_task_has_no_vector(spark):
    kinds = "document_name string, page_number int, chunk_index int, text string, vector array<float>"
    rows = [(f"d{k:02}", 1, 0, f"w{k % 3} all", [float(k), 1.0] if k == 5 else None) for k in range(12)]
    chunks = spark.createDataFrame(rows, kinds)
    queries = spark.createDataFrame([(k, f"w{k} all", [1.0, 2.0]) for k in range(3)], "query_id long, text string, vector array<float>")
    key = ("document_name", "page_number", "chunk_index")
    apart = chunks.where("vector IS NULL").coalesce(1)
    near = vectors.batch_top_k(apart, key, "vector", {0: [1.0, 2.0]}, 3).collect()
    assert [(r["document_name"], r["distance"]) for r in near] == [("d00", 2.0), ("d01", 2.0), ("d02", 2.0)]
    found = retrieval.batch_search(chunks.coalesce(1).repartitionByRange(6, "document_name"), queries, 3, 4).collect()
    stored = retrieval.batch_search(chunks, queries, 3, 4, index=retrieval.postings(chunks)).collect()
    assert len(found) == 9 and sorted(map(str, found)) == sorted(map(str, stored))
    near = ["d05", "d00", "d01", "d02"]
    for n in range(3):
        worded = [r[0] for r in sorted(rows, key=lambda r: (f"w{n}" not in r[3], r[0]))][:4]
        score = {d: sum(1 / (60 + c.index(d)) for c in (near, worded) if d in c) for d in {*near, *worded}}
        best = sorted(score, key=lambda d: (-round(score[d], 12), near.index(d) if d in near else 9 + worded.index(d)))[:3]
        assert [r["document_name"] for r in sorted(found, key=lambda r: r["position"]) if r["query_id"] == n] == best


def test_words_are_scored_in_parts(spark, monkeypatch):
    from tessera.functions import tokens

    rows = [(f"d{k:03}", " ".join(f"w{(k * 7 + j) % 11}" for j in range(k % 5 + 1))) for k in range(200)] + [("e", None)]
    chunks = spark.createDataFrame(rows, "d string, text string").coalesce(1)
    asked = {n: {f"w{n}": 1.0 + n, f"w{n + 3}": 0.5} for n in range(8)}

    def taken(most):
        monkeypatch.setattr(tokens, "MOST_PAIRS", most)
        counted = tokens.counted_terms(retrieval._tokenized(chunks, ("d",)))
        best = tokens.batch_best(counted, ("d",), asked, 3.0, 200, 1.2, 0.75)
        return sorted(map(tuple, counted.select("d", "length", F.array_sort("terms").cast("string")).collect())), sorted(map(tuple, best.collect()))

    def plain():
        for n, terms in asked.items():
            for d, text in rows:
                words = (text or "").split()
                tf = {t: words.count(t) for t in terms if t in words}
                if tf:
                    yield n, d, round(sum(terms[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / 3.0)) for t, f in tf.items()), 9)

    whole, parts = taken(1 << 20), taken(7)
    assert whole == parts
    assert parts[1] == sorted(plain())
    named = tokens.counted_terms(retrieval._tokenized(chunks, ("d",)), only=["w3"]).select(F.explode("terms.term").alias("t"))
    assert {r["t"] for r in named.collect()} == {"w3"} and named.count() == sum("w3" in (t or "").split() for _, t in rows)


def test_pages_are_converted_once_and_in_parts(spark, monkeypatch):
    from tessera.functions import html

    given = [(f"u{k}", f"<h1>A</h1><p>x{k}</p><h2>B</h2><p>y</p>" if k % 3 else None) for k in range(20)]
    pages = spark.createDataFrame(given, "url string, html string").coalesce(1)
    made = html.html_pages(pages)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(node) for node in ("ArrowEvalPython", "MapInArrow")) == 1
    rows = sorted(map(tuple, made.select("document_name", "document_path", "page_number", "total_pages", "text").collect()))
    assert rows == sorted((u, u, n, 2, text) for u, h in given if h for n, text in ((1, f"# A\n\nx{u[1:]}\n\n"), (2, "## B\n\ny")))
    monkeypatch.setattr(html, "MOST_HELD", 30)
    assert sorted(map(tuple, html.with_markdown(pages, "html").collect())) == sorted((u, page_markdown(h)) for u, h in given)


def test_tokens_held_at_once_are_bounded():
    import numpy as np

    from tessera.functions.tokens import parts

    assert list(parts(np.array([3, 0, 4, 9, 1, 1]), 7)) == [(0, 3), (3, 4), (4, 6)]
    assert list(parts(np.array([], np.int64), 7)) == []
    sizes = np.random.default_rng(1).integers(0, 900, 10_000)
    runs = list(parts(sizes, 5000))
    assert [b for b, _ in runs[1:]] == [e for _, e in runs[:-1]] and runs[-1][1] == 10_000
    assert all(sizes[b:e].sum() <= 5000 for b, e in runs)


def test_ingest_redacts_once(spark):
    pages = spark.createDataFrame([("d", 1, 1, "mail a@b.example. " * 200, "text"), ("e", 1, 1, None, "text"), ("f", 1, 1, " ", "text")], "document_name string, page_number int, total_pages int, text string, page_type string")
    made = chunking.ingest(pages, F.lit("2026-01-01"), scrub=Redaction())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :]
    assert "Filter" not in below.split("Project", 1)[0] + below.split("Project", 1)[1]
    rows = made.collect()
    assert {r["document_name"] for r in rows} == {"d"} and all("a@b" not in r["text"] for r in rows)


def test_queries_read_whole_texts(spark, tmp_path):
    from tessera.plans import QUERIES

    deep = "plain words. " * 2000
    texts = [deep, deep + "mail ann@site.example now", "---\na: b\n---\n", deep + "commit abc1234 in PR #7"]
    rows = [(40 * k, t, "s", "en", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, k, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["doc_id"] for r in QUERIES["unclean_documents"](spark, str(tmp_path)).collect()] == [40]
    assert [tuple(r) for r in QUERIES["document_pollution"](spark, str(tmp_path)).collect()] == [(0, 0.25)]
    found = {r["turn"]: r for r in QUERIES["conversation_artifacts"](spark, str(tmp_path)).collect()}
    assert found[3]["commit_shas"] == ["abc1234"] and found[3]["pr_numbers"] == [7] and not found[0]["commit_shas"]
    headers = {r["turn"]: r["header"] for r in QUERIES["conversation_headers"](spark, str(tmp_path)).collect()}
    assert headers[3] == "## Session Artifacts\nCommits: abc1234\nPRs: #7" and not headers[0]


def test_throttle_as_one_request_after_another(spark):
    from tessera.streaming import watch

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 4000)) for _ in range(600)] + [("c", 7), ("c", 7), ("c", 36), ("c", 37)]
    given = spark.createDataFrame(rows, "database string, s long").select("database", F.timestamp_seconds("s").alias("ts"))
    true = {}
    for name, at in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        met = true.setdefault(name, [])
        if not met:
            met.append(at)
        elif at > met[-1]:
            met.append(max(at, met[-1] + 30))
    found = {}
    for r in watch.throttled(given.repartition(5)).select("database", F.unix_seconds("ts").alias("s")).collect():
        found.setdefault(r["database"], []).append(r["s"])
    assert {k: sorted(v) for k, v in found.items()} == true and watch.throttled(given.limit(0)).count() == 0


def test_no_text_or_vector_is_shuffled_by_word_search(spark):
    chunks = spark.range(50).select(F.concat(F.lit("d"), F.col("id")).alias("document_name"), F.lit("c").alias("collection"), F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index"), F.concat(F.lit("word"), F.col("id") % 7, F.lit(" rest")).alias("text"), F.array(F.lit(1.0)).alias("vector"))
    best = retrieval.bm25_top_k(chunks, "word3 rest", 4)
    assert [r["document_name"] for r in best.collect()] == ["d10", "d17", "d24", "d3"]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan


def test_rules_that_are_not_searched_find_nothing(spark, sf_dir, monkeypatch):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(
        spark.createDataFrame([(t,) for t in (None, "", "A_TOKEN = x", "ghs_" + "a" * 40, "sk-" + "b" * 33, "see /home/me and a@b.co", "Asses! crap craps DAMNED", "aws_secret_access_key=" + "c" * 40)], "text string")
    )
    found = lambda: sorted((str(r["text"]), str(r["redacted"]), str(sorted((r["redactions"] or {}).items()))) for r in redaction.with_redaction(texts, "text").collect())
    guarded = found()
    monkeypatch.setattr(redaction, "WITHIN", {})
    monkeypatch.setattr(redaction, "_branches", lambda forms: "|".join(forms))
    assert guarded == found() and any("craps [REDACTED:profanity]" in r[1] for r in guarded)


def test_strip_takes_all_white_space(spark):
    odd = [chr(c) for c in (*range(0x250), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), 0x3000, 0x3001, 0xFEFF)]
    texts = spark.createDataFrame([(c + " a" + c + "b \n" + c,) for c in odd] + [("",), (None,), (" \u3000\n",)], "t string")
    assert texts.where(~tx.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
