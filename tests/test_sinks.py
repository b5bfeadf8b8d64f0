"""Files in two phases, bundles with manifests, and a command line run that cites and keeps figures."""

import json
import threading

import pytest
from pyspark.sql import functions as F

import foliosmith.__main__ as command
from foliosmith.plans import config, transcribe
from foliosmith.sources import bundles, files, sink
from tests.test_runs import raw_pages


def texts(spark, names, content="x\r\ny"):
    return spark.createDataFrame([(n, content, None) for n in names], "file string, content string, source string").repartition(4)


def held(root):
    """What readers of a folder see."""
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not any(part.startswith(".") for part in p.relative_to(root).parts)} if root.exists() else {}


def test_published_together(spark, tmp_path):
    root = tmp_path / "out"
    (tmp_path / "from").mkdir()
    (tmp_path / "from" / "c.png").write_bytes(b"\x89png")
    rows = texts(spark, ["a.md", "b/é c.md"]).unionByName(spark.createDataFrame([("figures/c.png", None, str(tmp_path / "from" / "c.png"))], "file string, content string, source string"))
    sink.publish(rows, str(root), clobber=False)
    assert held(root) == {"a.md": b"x\ny", "b/é c.md": b"x\ny", "figures/c.png": b"\x89png"} and not list(root.glob(".*"))
    sink.publish(texts(spark, ["a.md"], "new"), str(root))
    assert held(root)["a.md"] == b"new"
    sink.publish(texts(spark, ["b.md"]).limit(0), str(root))


@pytest.mark.parametrize("clobber", [True, False])
def test_a_failing_task_leaves_nothing(spark, tmp_path, clobber):
    root = tmp_path / "out"
    fails = F.when(F.col("file") == "f50.md", F.raise_error(F.lit("no such text")).cast("string")).otherwise(F.col("content"))
    with pytest.raises(Exception, match="no such text"):
        sink.publish(texts(spark, [f"f{k}.md" for k in range(99)]).withColumn("content", fails), str(root), clobber)
    assert held(root) == {}
    for wrong in ("../up.md", "/etc/x", "", None):
        with pytest.raises(Exception, match="names no file"):
            sink.publish(texts(spark, ["a.md", wrong]), str(root), clobber)
    with pytest.raises(Exception, match="twice"):
        sink.publish(texts(spark, ["a.md", "b.md", "a.md"]), str(root), clobber)
    assert held(root) == {}


def test_a_name_that_is_taken(spark, tmp_path):
    sink.publish(texts(spark, ["m.md"], "first"), str(tmp_path), clobber=False)
    with pytest.raises(FileExistsError, match="m.md is there already"):
        sink.publish(texts(spark, ["a.md", "m.md", "z.md"]), str(tmp_path), clobber=False)
    assert held(tmp_path) == {"m.md": b"first"}


def test_of_writers_at_once_one_wins(spark, tmp_path):
    """Commits of writers that share names, at once and in any order: all files of one, none of the others."""
    for round_ in range(10):
        root, outcomes = tmp_path / str(round_), {}
        root.mkdir()

        def write(who):
            writer = sink._Writer(str(root), False)
            own = root / writer.stage / "0-0"
            own.mkdir(parents=True)
            names = [f"{n}.md" for n in ("abcdef" if who % 2 else "cdefgh")]
            for n in names:
                (own / n).write_text(str(who))
            barrier.wait()
            try:
                writer.commit([sink.Staged([(n, str(own / n)) for n in names]), None])
                outcomes[who] = names
            except FileExistsError:
                pass

        barrier = threading.Barrier(4)
        workers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
        for w in workers:
            w.start()
        for w in workers:
            w.join()
        assert len(outcomes) == 1
        ((who, names),) = outcomes.items()
        assert held(root) == {n: str(who).encode() for n in names}


def parsed(spark, docs=("a", "b")):
    return transcribe.ocr_pass(raw_pages(spark, docs))


def bundle_files(root, docs=("a", "b"), pages=2):
    for d in docs:
        for sub, names in (("figures", [f"fig_p{p}_1.png" for p in range(1, pages + 1)]), ("pages", [f"sha-{d}-{p}.png" for p in range(1, pages + 1)])):
            (root / f"{d}_ocr" / sub).mkdir(parents=True, exist_ok=True)
            for n in names:
                (root / f"{d}_ocr" / sub / n).write_bytes(b"png")


def test_bundles_round_trip(spark, tmp_path):
    pages, tmp_path = parsed(spark), tmp_path / "my bündles"
    files.write_texts(bundles.manifests(pages, "2024-01-01", {"backend": "stub"}, "grounding", 0.02), str(tmp_path))
    bundle_files(tmp_path)
    got = bundles.read_bundles(spark, str(tmp_path))
    columns = ["doc_id", "page_number", "width_px", "height_px", "raster_sha256", "raw", "markdown", "truncated", "regions"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, pages.select(columns).collect()))
    row = got.filter("doc_id = 'a' and page_number = 2").first()
    assert row["figures"][0]["crop_path"] == "figures/fig_p2_1.png" and row["raster_path"] == "pages/sha-a-2.png" and row["ocr"]["backend"] == "stub" and row["figure_crop_padding"] == 0.02
    only = bundles.read_bundles(spark, str(tmp_path), ["b"])
    assert {r["doc_id"] for r in only.collect()} == {"b"} and all("b_ocr" in f for f in bundles.read_bundles(spark, str(tmp_path), ["b"], check=False).inputFiles())


def test_bundles_that_can_not_be_read(spark, tmp_path):
    files.write_texts(bundles.manifests(parsed(spark), "2024-01-01"), str(tmp_path))
    with pytest.raises(Exception, match="the bundle lacks .*a_ocr/"):
        bundles.read_bundles(spark, str(tmp_path), ["a"]).collect()
    bundle_files(tmp_path)
    (tmp_path / "b_ocr" / "figures" / "fig_p2_1.png").unlink()
    with pytest.raises(Exception, match="the bundle lacks .*b_ocr/figures/fig_p2_1.png"):
        bundles.read_bundles(spark, str(tmp_path)).collect()
    assert bundles.read_bundles(spark, str(tmp_path), ["a"]).count() == 2
    path = tmp_path / "a_ocr" / "manifest.json"
    whole = json.loads(path.read_text())
    path.write_text(json.dumps({**whole, "later": {"x": 1}, "pages": [{**p, "more": [1]} for p in whole["pages"]]}))
    assert bundles.read_bundles(spark, str(tmp_path), ["a"]).count() == 2  # fields that are not known
    for wrong, told in (({**whole, "bundle_schema": 99}, "newer schema"), ({k: v for k, v in whole.items() if k != "bundle_schema"}, "no bundle_schema")):
        path.write_text(json.dumps(wrong))
        with pytest.raises(Exception, match=told):
            bundles.read_bundles(spark, str(tmp_path), ["a"]).collect()


def test_command_line_cites_and_keeps_figures(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(command, "_session", lambda master: spark)
    raw_pages(spark, ("a",)).write.parquet(str(tmp_path / "pages"))
    paper = ("The Gulls of a", ["Ann Kelp"], "1990", "Shore", None, None)
    spark.createDataFrame([("The Gulls of a", 1, paper)], command.CATALOGS["titles"]).write.parquet(str(tmp_path / "titles"))
    root, out = str(tmp_path / "bundles"), tmp_path / "out"
    assert command.main(["ocr", str(tmp_path / "pages"), "-o", root, "--manifests"]) == 0
    bundle_files(tmp_path / "bundles", ("a",))
    whole = ["describe", root, "--manifests", "--memo", str(tmp_path / "memo"), "--titles", str(tmp_path / "titles"), "--bibtex", "--bibtex-in-doc", "--figure-mode", "describe-and-keep", "--crops", f"{root}/a_ocr"]
    assert command.main([*whole, "-o", str(out)]) == 0
    names = set(held(out))
    assert {"kelp1990gulls_full.md", "kelp1990gulls.bib", "figures/fig_p1_1.png", "figures/fig_p2_1.png"} <= names
    text = (out / "kelp1990gulls_full.md").read_text()
    assert text.startswith("```\n@") and "(figures/fig_p1_1.png)" in text
    before = held(out)
    with pytest.raises(FileExistsError):
        command.main([*whole, "-o", str(out), "--no-clobber"])
    assert held(out) == before
    assert command.main(["run", str(tmp_path / "pages"), "-o", str(tmp_path / "mock"), "--bibtex", "--today", "2024-02-03"]) == 0
    assert any(n.endswith(".bib") for n in held(tmp_path / "mock"))


def test_crops_of_several_documents(spark):
    described = spark.createDataFrame([("a", "figures/x.png"), ("b", "figures/x.png"), ("b", None)], "doc_id string, crop_path string")
    keep = config.resolve({"figure": {"mode": "describe-and-keep"}})
    assert transcribe.crops_to_keep(described).count() == 0 and transcribe.crops_to_keep(described.filter("doc_id = 'b'"), keep).count() == 1
    with pytest.raises(ValueError, match="figures/x.png"):
        transcribe.crops_to_keep(described, keep)


def test_doubtful_names(spark):
    made = spark.createDataFrame([("x_main",), ("y",)], "base string")
    assert transcribe.doubtful_names(made) == [] and transcribe.doubtful_names(made, config.resolve({"output": {"full_suffix": False}})) == ["x_main"]
