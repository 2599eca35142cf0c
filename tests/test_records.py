"""Records, questions, machines, catalog and embedders on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.operators import ask, embed, extract, journal, machines, ngram, triples
from sparrowgrid.sources import catalog, tree


def test_records_are_completed(spark):
    rows = spark.createDataFrame([("h", "src", 1.7, "x"), ("h", None, None, "y")], "h_id string, source string, confidence double, extra string")
    got = journal.complete(rows, "evidence").collect()
    assert [(r.supports, r.confidence, r.intake_id, r.extra) for r in got] == [(True, 1.0, None, "x"), (True, 1.0, None, "y")]
    party = journal.complete(spark.createDataFrame([("c", -3.0)], "claim string, authority double"), "party").first()
    assert (party.authority, party.confidence) == (0.0, 0.5)
    with pytest.raises(ValueError):
        journal.complete(rows, "nothing")
    log = journal.append(journal.complete(rows, "evidence"), spark.createDataFrame([("z",)], "h_id string"), "evidence")
    assert log.count() == 3 and log.where("h_id = 'z'").first().confidence == 1.0
    assert journal.complete(rows.limit(0), "edge").count() == 0


def test_transitions_and_verdicts(spark):
    h = spark.createDataFrame([("a", "candidate"), ("b", "supported")], "h_id string, status string")
    c = spark.createDataFrame([("a", "supported", 1, "r"), ("a", "failed", 2, "s"), ("b", "supported", 1, "t"), ("x", "failed", 1, "u")], "h_id string, status string, at long, reason string")
    after, events = journal.transition(h, c)
    assert {r.h_id: r.status for r in after.collect()} == {"a": "failed", "b": "supported"}
    assert sorted((r.h_id, r.at, r.previous, r.new) for r in events.collect()) == [("a", 1, "candidate", "supported"), ("a", 2, "supported", "failed")]
    nodes = spark.createDataFrame([(1, 0.3), (2, None)], "id long, verdict double")
    v = spark.createDataFrame([(1, -4.0, 1), (1, -0.5, 0), (3, 1.0, 0)], "id long, verdict double, at long")
    assert {r.id: r.verdict for r in journal.assert_verdicts(nodes, v).collect()} == {1: -1.0, 2: None}
    assert spark.createDataFrame([("Success",), ("?",)], "n string").select(journal.verdict(F.col("n")).alias("v")).collect() == [(1.0,), (None,)]
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "x"), ("a", "a")], "a string, b string")
    con = journal.pair_contradictions(h, pairs).withColumn("id", F.lit("c-1"))
    assert [(r.a, r.b, r.resolution) for r in con.collect()] == [("a", "b", "open")]
    assert journal.settle(con, "c-", "a-preferred").first().resolution == "a-preferred"
    with pytest.raises(ValueError):
        journal.settle(con, "q", "x")


@pytest.fixture(scope="module")
def world(spark):
    f = spark.createDataFrame
    return ask.World(
        f([("h1", "s", "supported", 0.9, 0.5, 0.5), ("h2", "t", "candidate", 0.1, 0.5, 0.5)], "h_id string, statement string, status string, semantic_fit double, ontological_fit double, logical_consistency double"),
        f([("h1", 1, "yes", True, 1.0, "a"), ("h1", 2, "but h2", False, 1.0, "b"), ("h2", 1, "ok", True, 1.0, "c")], "h_id string, ord int, claim string, supports boolean, confidence double, source string"),
        f([("h1", 0, False, 1), ("h1", 1, True, 2), ("h2", 0, None, 1)], "h_id string, idx int, correct boolean, made_at long"),
        f([("h1", 1, "candidate", "supported"), ("h1", 2, "supported", "supported")], "h_id string, at long, previous string, new string"),
        f([("h2", "h9", "contradicts"), ("h2", "h1", "supports")], "source string, target string, relation string"),
        f([(1, [1.0, 0.0], 1.0, 0.9), (2, [0.0, 1.0], -1.0, 0.1), (3, [0.9, 0.1], 0.5, None)], "id long, v array<double>, verdict double, coherence double"),
        f([("h1", 2, "late"), ("h1", 1, "early")], "subject string, at long, source string"),
    )


def test_questions(world):
    why = ask.ask(world, "why-believed", id="h1").first()
    assert [x.claim for x in why.supporting] == ["yes"] and [x.claim for x in why.contradicting] == ["but h2"] and [x.source for x in why.provenance] == ["early", "late"]
    assert sorted(tuple(r) for r in ask.ask(world, "what-contradicts", id="h2").collect()) == [("but h2", "b"), ("h9", "edge")]
    assert [r.idx for r in ask.ask(world, "after-prediction", id="h1").collect()] == [0, 1]
    assert [r.at for r in ask.ask(world, "why-changed", id="h1").collect()] == [1]
    assert [r.id for r in ask.ask(world, "insufficient-concepts").collect()] == [2]
    assert ask.ask(world, "strongest", limit=1).count() == 1 and ask.ask(world, "highest-empirical").first().h_id == "h2"
    assert [(r.h_id, r.idx) for r in ask.ask(world, "failed-predictions").collect()] == [("h1", 0)]
    assert [r.id for r in ask.ask(world, "similar-succeeded", v=[1.0, 0.0]).orderBy("rank").collect()] == [1, 3]
    assert [r.id for r in ask.ask(world, "similar-failed", v=[1.0, 0.0]).collect()] == [2]
    assert ask.ask(world, "why-believed", id="nobody").count() == 0
    with pytest.raises(ValueError):
        ask.ask(world, "who")


def test_machines_refuse(spark):
    series = spark.createDataFrame([("a", float(x), 2.0 * x) for x in range(6)] + [("b", 1.0, 1.0)], "key string, x double, y double")
    got = {r.target: (r.quantity, r.grade) for r in machines.inspect_all([machines.Scaling()], {"series": series}).collect()}
    assert got == {"a": (2.0, "measured"), "b": (0.0, "insufficient-data")}


def test_gates(spark):
    f = spark.createDataFrame([("a", "causes", "b", "observed"), ("b", "in", "c", "assumed")], "s string, p string, o string, kind string")
    assert triples.gates(f, f).first().accepted
    bad = f.union(spark.createDataFrame([("a", "contradicts", "b", "derived"), ("x", "precedes", "x", "derived")], f.schema))
    r = triples.gates(f, bad).first()
    assert (r.causal, r.temporal, r.composite, r.accepted) == (0.0, 0.0, 0.6, True)
    assert not triples.gates(f, f.where("s = 'b'")).first().accepted and not triples.gates(f, f, violated=1).first().accepted


def test_identity_sweep_is_brute_force(spark):
    rng = np.random.default_rng(4)
    words = "pump valve motor line dock gate crew shift".split()
    claims = [(i, [float(x) for x in rng.normal(size=3)], int(rng.integers(-1, 2)), sorted(set(rng.choice(words, 3).tolist()))) for i in range(25)]
    truth = [(i, j) for i in range(25) for j in range(i + 1, 25) if rng.random() < 0.1]
    got = extract.identity_sweep(spark.createDataFrame(claims, "id long, v array<double>, polarity int, content array<string>"), spark.createDataFrame(truth, "a long, b long")).collect()
    assert len(got) == 18 and sum(r.best for r in got) == 2
    for r in got:
        flagged = set()
        for i in range(25):
            for j in range(i + 1, 25):
                (_, a, p, c), (_, b, q, d) = claims[i], claims[j]
                cos = np.round(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b), 9)
                jac = round(len(set(c) & set(d)) / len(set(c) | set(d)), 6)
                if cos >= r.threshold if r.method == "embedding" else p * q < 0 and jac >= r.threshold:
                    flagged.add((i, j))
        assert (r.tp, r.fp) == (len(flagged & set(truth)), len(flagged - set(truth)))
        assert r.unresolved == sum(claims[i][2] == 0 or claims[j][2] == 0 for i, j in truth)
    # A column of groups gives the same as the pairs that it stands for.
    grouped = spark.createDataFrame([(*c, c[0] % 4) for c in claims], "id long, v array<double>, polarity int, content array<string>, label int")
    pairs = [(i, j) for i in range(25) for j in range(i + 1, 25) if i % 4 == j % 4 and claims[i][2] * claims[j][2] == -1]
    a, b = (sorted(map(tuple, extract.identity_sweep(grouped, t).collect())) for t in ("label", spark.createDataFrame(pairs, "a long, b long")))
    assert a == b and len(pairs) > 5


def test_embedders(spark):
    docs = spark.createDataFrame([(1, "pump valve pump"), (2, "nothing known"), (3, None), (4, "pump valve pump")], "id long, text string")
    table = spark.createDataFrame([("pump", [3.0, 0.0]), ("valve", [0.0, 8.0])], "w string, embedding array<double>")
    got = {r.id: (r.embedding, r.hits) for r in embed.sentences(docs, table, "id", "text", 2).collect()}
    assert got[1][0] == pytest.approx([0.6, 0.8]) and got[1][1] == 3 and got[2] == ([0.0, 0.0], 0) == got[3]
    syn = {r.id: r.embedding for r in embed.synthetic(docs, "id", "text", 16).collect()}
    assert syn[1] == syn[4] != syn[2] and np.linalg.norm(syn[3]) == pytest.approx(1.0)
    assert not embed.semantic(spark, embed.random_projection)
    meaning = {"car": 0, "automobile": 0, "dog": 1, "puppy": 1, "spindle motor overheated and tripped": 2, "thermal fault shut down the drive": 2}

    def oracle(df, id_col, text_col):
        return spark.createDataFrame([(r[id_col], [float(meaning.get(r[text_col], 3) == k) for k in range(4)]) for r in df.collect()], "id long, embedding array<double>")

    assert embed.semantic(spark, oracle) and embed.choose(spark, {"random": embed.random_projection, "good": oracle})[0] == "good"
    assert embed.choose(spark, {"random": embed.random_projection})[0] == "random-projection"
    with pytest.raises(ValueError):
        embed.choose(spark, {}, "missing")
    assert embed.tagged(docs, "x").first().embedder == "x"


def test_catalog(spark, tmp_path, monkeypatch):
    root = tmp_path / "proj"
    for f in ("Cargo.toml", "src/mainFile.rs", "tests/a_test.py", "target/x.rs", ".git/y", "Cargo.lock", "docs/deep/readme.md"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("x")
    got = {r.path: (r.kind, r.depth) for r in tree.project(spark, str(root)).collect()}
    assert got == {"Cargo.toml": ("manifest", 0), "src": ("directory", 0), "src/mainFile.rs": ("source", 1), "tests": ("directory", 0), "tests/a_test.py": ("test", 1), "docs": ("directory", 0), "docs/deep": ("directory", 1), "docs/deep/readme.md": ("doc", 2)}
    monkeypatch.setenv("SPARROWGRID_DIR", "/somewhere")
    assert catalog.state_dir() == "/somewhere"
    monkeypatch.delenv("SPARROWGRID_DIR")
    monkeypatch.setenv("HOME", "/home/me")
    assert catalog.state_dir() == "/home/me/.sparrowgrid" and catalog.read_optional(str(root / "no")) == ""
    (tmp_path / "run.json").write_text(catalog.example_settings())
    assert catalog.run_settings(str(tmp_path / "run.json")) == catalog.Run()
    (tmp_path / "bad.json").write_text(json.dumps({"what": 1}))
    with pytest.raises(ValueError, match="bad.json"):
        catalog.run_settings(str(tmp_path / "bad.json"))
    with pytest.raises(FileNotFoundError):
        catalog.run_settings(str(tmp_path / "none.json"))
    e = spark.createDataFrame([("x", "d1", "m", "c1"), ("y", "d2", "m", None)], "name string, domain string, mode string, category string")
    later = spark.createDataFrame([("x", "d9", "m", "c0")], e.schema)
    assert {(r.name, r.domain) for r in catalog.domains(e, later).collect()} == {("x", "d9"), ("y", "d2")}
    assert [r.category for r in catalog.categories(e.union(later)).collect()] == ["c0", "c1"] and catalog.source(e, " X ").count() == 1


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a \n b  ", "some/long/path/to/file.txt")], "t string, p string")
    r = df.select(T.single_line(F.col("t")).alias("a"), T.elide_middle(F.col("p"), 18).alias("b"), T.elide_middle(F.col("p"), 99).alias("c"), T.elide_middle(F.col("p"), 5).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("a b", "some/lon…/file.txt"[:8] + "…/file.txt", "some/long/path/to/file.txt", "file.txt") and len(r.b) == 18
    v = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    back = F.create_map(F.lit(1), F.lit("a"), F.lit(2), F.lit("b"))
    assert df.select(T.encode(F.lit("A x b"), v).alias("i"), T.decode(T.encode(F.lit("A x b"), v), back).alias("t")).first() == ([1, 2], "a b")


def test_table_model(spark):
    seq = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "d"],), (["a", "b", "c"],)], "t array<string>")
    m = ngram.TableModel(ngram.counts(seq, "t", 3), 3)
    assert m.generate(["a"], 2) == ["a", "b", "c"] and m.metadata()["order"] == 3 and "embed" not in m.capabilities
    with pytest.raises(ValueError):
        m.embed("x")
