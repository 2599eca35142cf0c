"""Trees, versioned state and the append log: predicates, packing, cut writes, replays, torn lines."""

import json

import pytest
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.sources import state, tree
from sparrowgrid.streaming.log import Log

LONG = "a text that is longer than forty bytes, so that a corpus keeps it"


@pytest.fixture
def root(tmp_path):
    files = {
        "b.txt": LONG, "a.md": LONG + " é", "short.md": "  short" + " " * 80, "x.rs": "fn main() {}", "blank.log": " \n\t ", "big.py": "x" * 5001, "edge.py": "é" * 5000, "sub/a.json": '{"k": "' + LONG + '"}',
        "sub/deep/er/z.txt": LONG, "target/skip.txt": LONG, ".idea/w.xml": "<x/>", "vendor/kept.rs": "y", "Cargo.lock": "lock", "yarn.lock": "kept", "poetry.lock": "lock", "sub/photo.PNG": "p",
    }
    for name, body in files.items():
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / "t" / "bad.txt").write_bytes(b"\xff" * 60)
    (tmp_path / "t" / "empty").mkdir()
    return tmp_path / "t"


def test_corpus_and_scan(spark, root):
    rows = tree.corpus(spark, f"file://{root}").collect()
    assert [r.rel for r in rows] == sorted(["a.md", "b.txt", "sub/a.json", "sub/deep/er/z.txt", "target/skip.txt"]) and rows[0].body == LONG + " é"
    labels = {r.path.removeprefix(f"{root}/"): r.label for r in tree.scan(spark, str(root)).collect()}
    assert set(labels) == {"b.txt", "a.md", "short.md", "x.rs", "edge.py", "sub/a.json", "sub/deep/er/z.txt", "target/skip.txt", ".idea/w.xml", "vendor/kept.rs"}
    assert labels["short.md"] == f"{root}/short.md: short"


def test_listing_pushes_its_predicates(spark, root):
    rows = tree.listing(spark, str(root), ("txt",), ("sub",), ("b.txt",), 10).collect()
    assert sorted(r.rel for r in rows if not r.folder) == ["bad.txt", "target/skip.txt"]
    assert sorted(r.rel for r in rows if r.folder) == [".idea", "empty", "target", "vendor"]
    with pytest.raises(Exception, match="(?i)no such file|not found|does not exist"):
        tree.listing(spark, f"{root}/nowhere").collect()


def test_packing_by_size(spark, root):
    files = tree.listing(spark, str(root), ("txt", "md")).where("NOT folder")
    bins = {r.rel: r.bin for r in tree.packed(files, 2 * tree.OPEN_BYTES).collect()}
    in_order = [bins[k] for k in sorted(bins)]
    assert in_order == sorted(in_order) and in_order[0] == 0 and len(set(in_order)) == len(in_order) // 2 + len(in_order) % 2
    got = tree.texts(files, str(root), 2 * tree.OPEN_BYTES)
    assert got.rdd.getNumPartitions() == len(set(in_order)) and [r.rel for r in got.collect()] == sorted(set(bins) - {"bad.txt"})


def test_project_leaves_out_what_is_fixed(spark, root):
    rows = {r.path: (r.kind, r.depth) for r in tree.project(spark, str(root)).collect()}
    assert not {"target", ".idea", "Cargo.lock", "poetry.lock"} & set(rows) and rows["vendor/kept.rs"] == ("source", 1) and rows["yarn.lock"] == ("other", 0)
    assert rows["empty"] == ("directory", 0) and rows["sub/deep/er"] == ("directory", 2) and rows["sub/photo.PNG"] == ("asset", 1)


def test_kinds_of_files(spark):
    want = {n: "manifest" for n in T.MANIFESTS} | {f"a/{n}": "manifest" for n in T.MANIFESTS} | {f"a/n.{e}": k for k, some in T.KINDS.items() for e in some}
    want |= {"tests/a.py": "test", "src/tests/a.py": "test", "src/test_a.py": "test", "testing": "test", "a_test.go": "test", "a.test.ts": "test", "attest.py": "source", "a/contest/b.py": "source", "cargo.toml": "config", "makefile": "other", "x": "other", "a.b/x": "other", "A.MD": "doc", ".env": "other"}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", T.shape_kind(F.col("p")).alias("k")).collect()
    assert {r.p: r.k for r in got} == want


def test_versions_are_whole_or_not_there(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/s")
    assert store.load_or_empty() == {}
    nodes, edges = spark.createDataFrame([(1, "a")], "id long, label string"), spark.createDataFrame([(1, 2)], "a long, b long")
    assert store.save({"nodes": nodes, "edges": edges}, note="first") == 1
    broken = spark.range(1).select(F.raise_error(F.lit("killed")).cast("long").alias("a"), F.lit(1).alias("b"))
    with pytest.raises(Exception, match="killed"):
        store.save({"nodes": spark.createDataFrame([(2, "b")], "id long, label string"), "edges": broken})
    got = store.load(deep=True)
    assert store.numbers() == [1] and [tuple(r) for r in got["nodes"].collect()] == [(1, "a")] and got["edges"].count() == 1
    # A second version names one table anew; the other isn't copied.
    assert store.save({"nodes": nodes.union(nodes)}, keep=True) == 2
    two = store.load()
    assert two["nodes"].count() == 2 and two["edges"].inputFiles() == got["edges"].inputFiles() and store.load(1)["nodes"].count() == 1
    # Empty tables keep their columns.
    assert store.save({"nodes": nodes.limit(0)}, keep=True) == 3 and store.load()["nodes"].columns == ["id", "label"]
    # Damage is passed over for the version before.
    (tmp_path / "s/versions/000000000003.json").write_text('{"format": 3, "tab')
    (tmp_path / "s/versions/.000000000003.json.crc").unlink(missing_ok=True)
    assert store.newest()[0] == 2
    part = next(p for p in (tmp_path / "s/data").glob(f"{store.manifest(2)['tables']['nodes']['folder']}/*.parquet"))
    part.unlink()
    assert store.newest()[0] == 1 and store.load()["nodes"].count() == 1
    assert store.save({"nodes": nodes}) == 4
    store.prune()
    assert store.numbers() == [4] and len(list((tmp_path / "s/data").iterdir())) == 1
    (tmp_path / "s/versions/000000000004.json").unlink()
    (tmp_path / "s/versions/000000000005.json").write_text("{}")
    with pytest.raises(state.Damaged):
        store.load_or_empty()


def test_two_writers_get_two_versions(spark, tmp_path, monkeypatch):
    store = state.Store(spark, f"file://{tmp_path}/s")
    monkeypatch.setattr(state.Store, "numbers", lambda self: [])
    rows = spark.range(2)
    assert store.save({"t": rows}) == 1 and store.save({"t": rows.limit(1)}) == 2
    monkeypatch.undo()
    assert store.load()["t"].count() == 1 and store.load(1)["t"].count() == 2


def test_older_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n[{"id": "n1", "label": "x"}, {"id": "n2", "label": null}]')
    (tmp_path / "b.json").write_text(json.dumps({"version": 2, "nodes": [{"id": "n1"}], "edges": [{"a": 1, "b": 2}, {"a": 3, "b": 4}], "tags": ["x", "y"], "empty": []}))
    one = state.older(spark, f"file://{tmp_path}/a.json")
    assert set(one) == {"nodes"} and sorted(r.id for r in one["nodes"].collect()) == ["n1", "n2"]
    two = state.older(spark, f"file://{tmp_path}/b.json")
    assert two["nodes"].count() == 1 and sorted(map(tuple, two["edges"].collect())) == [(1, 2), (3, 4)] and two["tags"].count() == 2
    (tmp_path / "c.json").write_text('{"nodes": [')
    with pytest.raises(Exception, match="(?i)malformed|parse|corrupt"):
        state.older(spark, f"file://{tmp_path}/c.json")


def test_registry_of_tables(spark, tmp_path):
    root, other = f"file://{tmp_path}/r", f"file://{tmp_path}/o"
    grams = spark.createDataFrame([(2, "a", "b", 3)], "n int, context string, next string, cnt long")
    assert state.install(spark, root, "en", grams, tokenizer="words") == 1 and state.install(spark, root, "en", grams.union(grams), tokenizer="words") == 2
    state.install(spark, root, "de", grams, tokenizer="marks")
    assert {r.name: (r.version, json.loads(r.facts)) for r in state.tables(spark, root).collect()} == {"en": (2, {"tokenizer": "words"}), "de": (1, {"tokenizer": "marks"})}
    assert state.table(spark, root, "en", tokenizer="words").count() == 2
    with pytest.raises(ValueError, match="tokenizer"):
        state.table(spark, root, "de", tokenizer="words")
    state.export(spark, root, "en", other)
    assert state.table(spark, other, "en", deep=True, tokenizer="words").count() == 2
    state.remove(spark, root, "en")
    assert [r.name for r in state.tables(spark, root).collect()] == ["de"]
    for bad in ("en", "../de", ""):
        with pytest.raises(ValueError):
            state.table(spark, root, bad)
    with pytest.raises(ValueError):
        state.remove(spark, root, "en")



def observed(spark, *names):
    return spark.createDataFrame([(None, n, "s", f"body {n}") for n in names], "at timestamp, source string, subject string, body string")


def test_log_numbers_and_replays(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    assert log.read().count() == 0 and log.tail(3).count() == 0
    assert log.append(observed(spark, "c", "a", "b"), "one") == (1, 3)
    assert log.append(observed(spark, "d"), "two") == (4, 4)
    assert log.append(observed(spark, "z", "y"), "one") == (1, 3) and log.append(observed(spark).limit(0), "three") == (5, 4)
    assert log.append(observed(spark, "e", "f"), "four") == (5, 6)
    assert [(r.seq, r.source) for r in log.read().orderBy("seq").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f")]
    assert [r.seq for r in log.tail(2).collect()] == [6, 5] and log.read(5).count() == 2
    # A write that was cut off before its commit adds nothing.
    (tmp_path / "log/parts/stray").mkdir()
    (tmp_path / "log/parts/stray/x.json").write_text('{"seq": 7, "source": "ghost"}\n')
    assert log.read().count() == 6 and log.append(observed(spark, "g"), "five") == (7, 7)


def test_slower_writer_takes_new_numbers(spark, tmp_path, monkeypatch):
    log = Log(spark, f"file://{tmp_path}/log")
    real, calls = Log.commits, []

    def stale(self):
        calls.append(1)
        found = real(self)
        if len(calls) == 1:
            Log(spark, self.path).append(observed(spark, "first"), "other")
            return found.limit(0)
        return found

    monkeypatch.setattr(Log, "commits", stale)
    assert log.append(observed(spark, "second"), "mine") == (2, 2)
    assert sorted((r.seq, r.source) for r in log.read().collect()) == [(1, "first"), (2, "second")] and len(list((tmp_path / "log/parts").iterdir())) == 2


def test_adopted_log_with_a_torn_line(spark, tmp_path):
    whole = [json.dumps({"seq": k, "source": f"s{k}", "subject": "x", "body": "b"}) for k in (1, 2, 3)]
    (tmp_path / "old.jsonl").write_text("\n".join([*whole, "", '{"seq": 4, "source": "cut o']))
    log = Log(spark, f"file://{tmp_path}/log")
    log.append(observed(spark, "a"), "new")
    assert log.adopt(f"file://{tmp_path}/old.jsonl", "old") == ((2, 4), 1) and log.adopt(f"file://{tmp_path}/old.jsonl", "old") == ((2, 4), 1)
    assert [(r.seq, r.source) for r in log.read().orderBy("seq").collect()] == [(1, "a"), (2, "s1"), (3, "s2"), (4, "s3")]
    assert spark.read.text(f"file://{tmp_path}/log/torn/old").first()[0] == '{"seq": 4, "source": "cut o'
    assert log.append(observed(spark, "b"), "later") == (5, 5)


def test_stream_writes_each_batch_once(spark, tmp_path):
    log, src = Log(spark, f"file://{tmp_path}/log"), tmp_path / "in"
    src.mkdir()
    schema = "source string, subject string, body string, at timestamp"

    def drain(checkpoint):
        q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)).writeStream.foreachBatch(log.sink("q")).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for k in range(2):
        (src / f"{k}.json").write_text(json.dumps({"source": f"f{k}", "subject": "s", "body": "b"}) + "\n")
    drain(tmp_path / "c1")
    assert log.read().count() == 2
    # The stream's progress is lost: it runs again from its start, and its batches are known.
    drain(tmp_path / "c2")
    assert sorted((r.seq, r.source) for r in log.read().collect()) == [(1, log.read(1).orderBy("seq").first().source), (2, log.read(2).first().source)]
    assert {r.batch for r in log.commits().collect()} == {"q-0", "q-1"}


def test_packs_that_do_not_parse_are_passed_over(spark, tmp_path):
    from sparrowgrid.sources import packs

    good = {"kind": "human", "domains": [{"name": "bolt", "domain": "D", "mode": "M"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text('{"kind": "human", "domains": [')
    (tmp_path / "c.json").write_text('{"kind": "tools"}')
    entries, warnings = packs.load_sound(spark, f"file://{tmp_path}")
    assert [r.key for r in entries.collect()] == ["bolt"]
    assert sorted((r.path.rsplit("/", 1)[-1], r.why) for r in warnings.collect()) == [("b.json", "it doesn't parse"), ("c.json", "it has no domains")]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        packs.load(spark, f"file://{tmp_path}").collect()


def test_reports_with_unknown_grades_fail(spark, tmp_path):
    from sparrowgrid.operators import structure

    o = lambda status: {"machine": "m", "target": "t", "claim": "c", "quantity": 1.5, "status": status}
    (tmp_path / "a.json").write_text(json.dumps({"machine_reports": [{"machine": "m", "observations": [o(g) for g in structure.GRADES]}, {"machine": "n", "observations": []}], "verdict": "open"}))
    rows = structure.reports(spark, f"file://{tmp_path}/a.json")
    assert rows.count() == 8 and [r.status for r in structure.certified(rows).collect()] == ["Established", "Derived", "EstablishedFinite", "Numerical"]
    (tmp_path / "b.json").write_text(json.dumps({"machine_reports": [{"machine": "m", "observations": [o("Proved")]}]}))
    with pytest.raises(Exception, match="no such grade: Proved"):
        structure.reports(spark, f"file://{tmp_path}").collect()


def test_models_are_copied_and_checked(spark, tmp_path):
    from sparrowgrid.sources import models

    folder, root = tmp_path / "m", f"file://{tmp_path}/registry"
    (folder / "deep").mkdir(parents=True)
    (folder / "weights.bin").write_bytes(b"w" * 100_000)
    (folder / "deep/vocab.txt").write_text("a\nb")
    assert models.install(spark, root, "mini", f"file://{folder}", kind="onnx") == 1
    (row,) = models.models(spark, root).collect()
    assert (row.name, row.version) == ("mini", 1) and json.loads(row.facts)["kind"] == "onnx"
    states = lambda: {r.file: r.state for r in models.check(spark, root, "mini").collect()}
    assert states() == {"weights.bin": "as installed", "deep/vocab.txt": "as installed"}
    (folder / "weights.bin").write_text("the source may go")
    here = models.path(spark, root, "mini").removeprefix("file://")
    assert states()["weights.bin"] == "as installed"
    (tmp_path / here / "weights.bin").write_text("changed")
    (tmp_path / here / "deep/vocab.txt").unlink()
    (tmp_path / here / "new.txt").write_text("?")
    assert states() == {"weights.bin": "changed", "deep/vocab.txt": "gone", "new.txt": "strange"}
    models.remove(spark, root, "mini")
    assert models.models(spark, root).count() == 0 and not (tmp_path / here).exists()
    for bad in (lambda: models.path(spark, root, "mini"), lambda: models.install(spark, root, "x", "http://a/b")):
        with pytest.raises(ValueError):
            bad()
