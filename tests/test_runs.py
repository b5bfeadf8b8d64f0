"""Passes with a model, whole runs to files, sinks, configuration and the command line."""

import pytest
from pyspark.sql import functions as F

import foliosmith.__main__ as command
from foliosmith.operators import cite, memo, pages, parts
from foliosmith.plans import config, inference, transcribe
from foliosmith.sources import files

TABLE = "<table><tr><td>11</td><td>22</td></tr></table>"
PIPE = "| 11 | 22 |\n|---|---|"


def log_of(folder):
    """What was asked, over all workers."""
    return sorted(p.read_text() for p in folder.iterdir())


def backend(folder, reply):
    """A backend that writes down each request and answers by ``reply(prompt)``."""

    class Told(inference.StubBackend):
        name = "told"

        def answer(self, prompt, image):
            import uuid

            (folder / uuid.uuid4().hex).write_text(f"{image}|{prompt}")
            return reply(prompt)

    return Told


def raw_pages(spark, docs=("a", "b"), pages=2):
    rows = []
    for d in docs:
        for p in range(1, pages + 1):
            raw = f"title[[1,1,9,9]]# The Gulls of {d}\nimage[[100,100,500,500]]image_caption[[1,1,2,2]]Figure {p}\ntable[[10,10,900,900]]{TABLE} text[[2,2,9,9]]Body {p} of {d}.\n## References\none"
            rows.append((d, p, 800, 1000, f"sha-{d}-{p}", raw, "stop"))
    return spark.createDataFrame(rows, "doc_id string, page_number int, width_px int, height_px int, raster_sha256 string, raw string, finish_reason string")


def none(spark):
    return spark.createDataFrame([], files.MEMO)


def test_each_miss_is_asked_once(spark, tmp_path):
    items = spark.createDataFrame([(f"k{i % 5}", f"p{i % 5}") for i in range(20)], "key string, prompt string").repartition(4).withColumn("image", F.lit(None).cast("string"))
    told = backend(tmp_path, lambda prompt: (f"answer to {prompt}", "stop"))
    done, entries = memo.memoised(items, none(spark), lambda misses: inference.infer(misses, told), 2)
    for _ in range(2):
        assert done.count() == 20 and entries.count() == 5
    used = {(r["key"], r["text"]) for r in done.collect()}
    assert used == {(r["key"], r["text"]) for r in entries.collect()} == {(f"k{i}", f"answer to p{i}") for i in range(5)}
    assert log_of(tmp_path) == sorted(f"None|p{i}" for i in range(5))


@pytest.mark.parametrize("reply,reason,kept", [(PIPE, "stop", PIPE), (PIPE, "length", None), ("no table", "stop", None), ("| 1 |\n|---|", "stop", None)])
def test_only_sound_tables_are_used_and_memoised(spark, tmp_path, monkeypatch, reply, reason, kept):
    monkeypatch.setitem(inference._BACKENDS, "told", backend(tmp_path, lambda prompt: (reply, reason)))
    own = config.resolve({"vlm": {"backend": "told"}})
    pages, entries = transcribe.refine_tables(transcribe.ocr_pass(raw_pages(spark, ("a",), 1)), none(spark), own)
    row = pages.first()
    assert row["tables_refined"] == int(kept is not None) and (PIPE in row["markdown"]) == (kept is not None) != (TABLE in row["markdown"])
    assert [r["text"] for r in entries.collect()] == ([kept] if kept else [])
    ((asked),) = log_of(tmp_path)
    assert asked.startswith("sha-a-1#") and transcribe.CROPPED in asked  # the region is known, so the crop is sent


def test_cut_descriptions_are_marked_and_empty_ones_not_memoised(spark, tmp_path, monkeypatch):
    replies = {"page 1": ("<img_desc>A gull ", "length"), "page 2": ("<img_desc> </img_desc>", "stop")}
    monkeypatch.setitem(inference._BACKENDS, "told", backend(tmp_path, lambda prompt: next(v for k, v in replies.items() if k in prompt)))
    own = config.resolve({"vlm": {"backend": "told"}})
    described, entries = transcribe.describe_figures(transcribe.ocr_pass(raw_pages(spark, ("a",))), none(spark), own)
    assert {r["fig_id"]: r["description"] for r in described.collect()} == {"fig_p1_1": "A gull [...]", "fig_p2_1": None}
    assert [r["text"] for r in entries.collect()] == ["A gull [...]"]
    again, fresh = transcribe.describe_figures(transcribe.ocr_pass(raw_pages(spark, ("a",))), entries, own)
    assert {r["fig_id"]: r["description"] for r in again.collect()}["fig_p1_1"] == "A gull [...]" and fresh.count() == 0
    assert len(log_of(tmp_path)) == 3


def test_another_model_has_other_keys(spark):
    keys = set()
    for own in ({}, {"model": "m"}, {"mmproj": "m"}, {"model": "m", "endpoint": "e"}):
        identity = transcribe.vlm_backend(config.resolve({"vlm": own})).identity()
        keys.add(spark.range(1).select(memo.figure_key(F.lit("p"), raster_sha256=F.lit("r"), bbox=F.lit("b"), padding=F.lit(0.02), identity=identity)).first()[0])
    assert len(keys) == 4


def test_pages_are_read_once_and_failures_are_empty(spark, tmp_path, monkeypatch):
    def reply(prompt):
        raise RuntimeError("no server")

    images = raw_pages(spark).drop("raw", "finish_reason")
    read, entries = transcribe.read_pages(images, none(spark))
    assert entries.count() == 4 and all(r["raw"].startswith("text[[") and r["error"] is None for r in read.collect())
    again, fresh = transcribe.read_pages(images, entries)
    assert fresh.count() == 0 and sorted(r["raw"] for r in again.collect()) == sorted(r["raw"] for r in read.collect())
    monkeypatch.setitem(inference._BACKENDS, "told", backend(tmp_path, reply))
    failed, fresh = transcribe.read_pages(images, none(spark), config.resolve({"ocr": {"backend": "told"}}))
    assert fresh.count() == 0 and {(r["raw"], r["error"]) for r in failed.collect()} == {("", "no server")}
    monkeypatch.setitem(inference._BACKENDS, "told", backend(tmp_path, lambda prompt: ("text[[1,1,2,2]]half", "length")))
    cut, fresh = transcribe.read_pages(images, none(spark), config.resolve({"ocr": {"backend": "told"}}))
    assert {r["finish_reason"] for r in cut.collect()} == {"length"} and {r["truncated"] for r in fresh.collect()} == {True}
    hit, _ = transcribe.read_pages(images, fresh, config.resolve({"ocr": {"backend": "told"}}))
    assert {r["finish_reason"] for r in hit.collect()} == {"length"}


def test_embedded_figures_need_their_column(spark):
    own = config.resolve({"figure": {"detect": "pdf-embedded"}})
    with pytest.raises(Exception, match="embedded"):
        transcribe.ocr_pass(raw_pages(spark), own).collect()
    box = F.struct(*[F.lit(v).alias(k) for k, v in (("x1", 0.1), ("y1", 0.1), ("x2", 0.6), ("y2", 0.6))])
    row = transcribe.ocr_pass(raw_pages(spark, ("a",), 1).withColumn("embedded", F.array(box)), own).first()
    assert [r["figure"] for r in row["regions"] if r["figure"]] == [1] and {"title", "table"} <= {r["label"] for r in row["regions"]} and row["markdown"].endswith("⟦FIG:fig_p1_1⟧") and row["markdown"].count("⟦") == 1


def catalogs(spark):
    paper = "struct<title:string,authors:array<string>,year:string,venue:string,doi:string,url:string>"
    by_title = spark.createDataFrame([("The Gulls of a", 1, ("The Gulls of a", ["Ann Kelp"], "1990", "Shore", None, None))], f"query string, rank int, paper {paper}")
    return transcribe.Catalogs(spark.createDataFrame([], f"arxiv_id string, paper {paper}"), spark.createDataFrame([], "arxiv_id string, title string, authors array<string>, year string, primary_class string"), by_title, "2024-02-03", "2024")


@pytest.mark.parametrize("mode,offline,want", [("on", False, {"a": ("kelp1990gulls", "s2-title"), "b": ("unknownYear", "mock")}), ("off", False, {"a": (None, ""), "b": (None, "")}), ("on", True, {"a": (None, ""), "b": (None, "")}), ("auto", True, {"a": ("lee1999gulls", "best-effort"), "b": (None, "not-citable")})])
def test_entries_by_mode(spark, mode, offline, want):
    documents = spark.createDataFrame([("a", "# The Gulls of a\nx", None), ("b", "# The Gulls of b\nx", None)], "doc_id string, markdown string, url string")
    probes = spark.createDataFrame([("a", (True, "The Gulls of a", ["Bo Lee"], "1999", None)), ("b", (False, None, [], None, None))], "doc_id string, probe struct<citable:boolean,title:string,authors:array<string>,year:string,venue:string>")
    own = config.resolve({"bibtex": {"mode": mode}, "net": {"offline": offline}})
    got = {r["doc_id"]: r for r in transcribe.entries_of(documents, probes, catalogs(spark), own).collect()}
    for doc, (key, source) in want.items():
        bibtex = got[doc]["bibtex"]
        assert (bibtex is None) == (key is None) and got[doc]["source"] == source and got[doc]["mock"] == (source == "mock")
        assert key is None or "{" + key + "," in bibtex


def test_a_run_to_files(spark, tmp_path, monkeypatch):
    probe = '{"citable": true, "title": "%s", "authors": ["Bo Lee"], "year": "1999"}'

    def reply(prompt):
        if "JSON" in prompt:
            return probe % ("The Gulls of a" if "Gulls of a" in prompt else "Terns"), "stop"
        return (PIPE, "stop") if "pipe table" in prompt else ("<img_desc>A bird.</img_desc>", "stop")

    (tmp_path / "log").mkdir()
    monkeypatch.setitem(inference._BACKENDS, "told", backend(tmp_path / "log", reply))
    own = config.resolve({"vlm": {"backend": "told"}, "bibtex": {"append_to_document": True}})
    sources = spark.createDataFrame([("a", None, "a"), ("b", None, "b")], "doc_id string, url string, name string")
    made, entries = transcribe.run_to_files(raw_pages(spark), sources, none(spark), catalogs(spark), own)
    rows = {(r["doc_id"], r["part"]): r for r in made.collect()}
    want = {"a": "kelp1990gulls", "b": "lee1999terns"}
    for doc, base in want.items():
        assert [rows[doc, part]["file"] for part in ("full", "main", "backmatter", "bib")] == [f"{base}_full.md", f"{base}_main.md", f"{base}_backmatter.md", f"{base}.bib"]
        text = rows[doc, "full"]["content"]
        assert text.startswith("```\n") and PIPE in text and "> **Image description.** A bird." in text and "OCR and VLMs; text, tables, and figure descriptions" in text
    root = tmp_path / "out"
    told = files.write_texts(made, str(root))
    assert told.count() == len(rows) and sorted(p.name for p in root.iterdir()) == sorted(r["file"] for r in rows.values())
    assert (root / rows["a", "full"]["file"]).read_bytes().decode() == rows["a", "full"]["content"]
    with pytest.raises(FileExistsError):
        files.write_texts(made, str(root), clobber=False)
    whole = {r["base"]: r["full"] for r in parts.join_splits(files.one_main_each(files.read_parts(spark, str(root / "*.md")))).collect()}
    assert set(whole) == set(want.values())
    asked = len(log_of(tmp_path / "log"))
    refined, again = transcribe.refine_tables(transcribe.ocr_pass(raw_pages(spark), own), entries, own)
    assert again.count() == 0 and {r["tables_refined"] for r in refined.collect()} == {1}
    assert len(log_of(tmp_path / "log")) == asked  # all from the memo


def test_names_that_clash_are_an_error(spark):
    own = config.resolve({"name": "same", "bibtex": {"mode": "off"}})
    sources = spark.createDataFrame([("a", None, "a"), ("b", None, "b")], "doc_id string, url string, name string")
    with pytest.raises(ValueError, match="same_"):
        transcribe.run_to_files(raw_pages(spark), sources, none(spark), None, own)


def test_one_paper_of_a_catalog_with_repeats(spark):
    repeated = catalogs(spark).by_title.unionAll(catalogs(spark).by_title)
    assert cite.first_ranked(repeated).count() == 1


def test_bundles_and_crops(spark, tmp_path):
    parsed = transcribe.ocr_pass(raw_pages(spark, ("a",), 1))
    whole = ["figures/fig_p1_1.png", "pages/sha-a-1.png"]
    present = spark.createDataFrame([(p,) for p in whole], "path string")
    assert files.check_references(parsed, present).count() == 1
    with pytest.raises(ValueError, match="fig_p1_1"):
        files.check_references(parsed, present.filter("path not like 'fig%'"))
    (tmp_path / "b" / "figures").mkdir(parents=True)
    (tmp_path / "b" / "figures" / "fig_p1_1.png").write_bytes(b"png")
    crops = spark.createDataFrame([("figures/fig_p1_1.png",), ("figures/gone.png",), (None,)], "crop_path string")
    got = {r["path"]: r["copied"] for r in files.copy_figures(crops, str(tmp_path / "b"), str(tmp_path / "o")).collect()}
    assert got == {"figures/fig_p1_1.png": True, "figures/gone.png": False} and (tmp_path / "o/figures/fig_p1_1.png").read_bytes() == b"png"


def test_parts_need_one_main(spark):
    schema = "base string, part string, content string"
    for rows in ([("x", "appendix", "a")], [("x", "main", "a"), ("x", "main", "b")], [("x", "main", "a"), ("x", "appendix", "b"), ("x", "appendix", "c")]):
        with pytest.raises(ValueError, match="x:"):
            files.one_main_each(spark.createDataFrame(rows, schema))


def test_pages_and_results_meet_one_to_one(spark):
    left, right = (spark.createDataFrame([(1, n), (2, n)], f"page int, {n} string") for n in "ab")
    assert pages.zipped(left, right, "page").count() == 2
    for wrong in (right.filter("page = 1"), right.unionAll(right.filter("page = 2")), right.unionAll(right.selectExpr("page + 5", "b"))):
        with pytest.raises(ValueError, match="page [26]: "):
            pages.zipped(left, wrong, "page")


def test_downloads_and_page_images(spark):
    inputs = spark.createDataFrame([("https://arxiv.org/abs/1907.00042",), ("https://arxiv.org/abs/1907.00043",), ("local.pdf",)], "value string")

    def fetch(url):
        if "43" in url:
            raise OSError("refused")
        return b"%PDF-1"

    rows = {r["value"][-5:]: r for r in files.downloads(files.route_inputs(inputs), fetch).collect()}
    assert rows["00042"]["is_pdf"] and rows["00043"]["error"] == "refused" and rows["l.pdf"]["content"] is None
    offline = files.downloads(files.route_inputs(inputs, offline=True), fetch).filter("is_url").collect()
    assert {r["error"] for r in offline} == {"no download: offline"} and all(r["content"] is None for r in offline)

    def render(pdf, edge):
        if pdf == b"bad":
            raise ValueError("no pages")
        return [(k, edge, edge // 2, b"image%d" % k) for k in (1, 2)]

    got = files.page_images(spark.createDataFrame([("d", b"good"), ("e", b"bad")], "doc_id string, content binary"), render, 640).collect()
    assert sorted((r["doc_id"], r["page_number"], r["width_px"], r["height_px"]) for r in got if r["error"] is None) == [("d", 1, 640, 320), ("d", 2, 640, 320)]
    assert [(r["doc_id"], r["error"]) for r in got if r["error"]] == [("e", "no pages")]


def test_configuration_problems_are_told_at_once():
    with pytest.raises(config.ConfigError) as e:
        config.resolve({"llama": {"port": 70000, "ctx_size": "big", "server_start_timeout": 0}, "ocr": {"resolution": "huge", "n_gpu_layers": "some", "backend": "unheard"}, "vlm": {"n_gpu_layers": -1}, "figure": {"crop_padding": True, "context_chars": 1.5}, "net": {"offline": "no"}, "inference": {"mode": "x"}})
    assert [line.split(":")[0] for line in str(e.value).splitlines()] == [
        "llama.port", "llama.server_start_timeout", "llama.ctx_size", "inference.mode", "ocr.backend", "ocr.resolution", "ocr.n_gpu_layers", "vlm.n_gpu_layers", "figure.crop_padding", "figure.context_chars", "net.offline"]
    with pytest.raises(config.ConfigError, match="fixed port"):
        config.resolve({"llama": {"port": 8080}, "inference": {"mode": "concurrent"}})
    assert config.resolve({"llama": {"port": 8080}, "inference": {"mode": "concurrent"}, "command": "ocr"}).llama.port == 8080


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    own = tmp_path / "c.toml"
    own.write_text('[output]\nsplit = true\nnotice = false\n[vlm]\nn_gpu_layers = "all"\n')
    assert command.main(["config", "-c", str(own), "--no-split", "--ctx", "4096", "--ocr-ngl", "0"]) == 0
    shown = __import__("json").loads(capsys.readouterr().out)
    assert shown["output"]["split"] is False and shown["output"]["notice"] is False and shown["llama"]["ctx_size"] == 4096 and shown["ocr"]["n_gpu_layers"] == 0 and shown["vlm"]["n_gpu_layers"] == "all"
    assert command.main(["config", "--port", "x"]) == 2 and "llama.port" in capsys.readouterr().err
    monkeypatch.setattr(command, "_session", lambda master: spark)
    raw_pages(spark).drop("raw", "finish_reason").write.parquet(str(tmp_path / "pages"))
    bundle, memo_path, out = (str(tmp_path / n) for n in ("bundle", "memo", "out"))
    assert command.main(["ocr", str(tmp_path / "pages"), "-o", bundle, "--memo", memo_path]) == 0
    assert files.read_bundle(spark, bundle).count() == 4
    assert command.main(["describe", bundle, "-o", out, "--memo", memo_path]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a_full.md", "a_main.md", "b_full.md", "b_main.md"]
    assert command.main(["run", str(tmp_path / "pages"), "-o", str(tmp_path / "run"), "--memo", memo_path]) == 0
    assert (tmp_path / "run/a_full.md").read_text() == (tmp_path / "out/a_full.md").read_text()
    assert command.main(["join", out, "-o", str(tmp_path / "joined"), "--no-full-suffix"]) == 0
    assert sorted(p.name for p in (tmp_path / "joined").iterdir()) == ["a.md", "b.md"]
