"""Search results, names, documents and snapshots on small fixtures."""

import pytest

from commercelake.operators import research, runs, texts
from commercelake.session import shared_path
from commercelake.sources import payloads, snapshots, versioned
from commercelake.sources.tables import load_or_empty


def test_dedup_is_idempotent_and_keeps_blank_urls(spark):
    rows = [("q10", 9, 0, "u"), ("q2", 1, 5, "u"), ("q10", 9, 1, ""), ("q10", 9, 2, ""), ("q3", 2, 0, "v")]
    once = research.dedup_by_url(spark.createDataFrame(rows, "query string, query_pos int, rank int, url string"))
    got = sorted(map(tuple, once.collect()))
    assert got == [("", 9, 1, ""), ("", 9, 2, ""), ("q2", 1, 5, "u"), ("q3", 2, 0, "v")]
    assert sorted(map(tuple, research.dedup_by_url(once).collect())) == got


def test_first_nonempty_source(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("b", 0), ("b", 2)], "query string, source_rank int")
    assert sorted(map(tuple, research.first_nonempty_source(df).collect())) == [("a", 1), ("a", 1), ("b", 0)]


def test_known_names_keep_the_ordinal_unless_asked(spark):
    df = spark.createDataFrame([(1, "### 1. OpenCode\n| 1 | OpenCode |\n**Aider**\n|---|---|")], "doc_id int, text string")
    names = {r["name"] for r in research.extract_known_names(df, "doc_id").collect()}
    assert names == {"1. opencode", "1", "aider", "---"}
    plain = {r["name"] for r in research.extract_known_names(df, "doc_id", strip_ordinal=True).collect()}
    assert "opencode" in plain


def test_new_items(spark):
    found = spark.createDataFrame([(" Tool A ",), ("tool b",), ("Tool A",)], "name string")
    known = spark.createDataFrame([("tool a",), ("tool a",)], "name string")
    assert [r["name"] for r in research.new_items(found, known).collect()] == ["tool b"]


def test_route_model(spark):
    rows = [("a:30b", "b:1b"), ("x:1", "b:7b"), ("x", "y"), ("", "b:1b"), (None, None)]
    df = spark.createDataFrame(rows, "preferred string, fallback string")
    out = [r["model"] for r in research.route_model(df, ["first:1", "a:7b", "b:2b"]).collect()]
    assert out == ["a:7b", "b:2b", "first:1", "first:1", "first:1"]
    assert research.route_model(df, []).where("model IS NOT NULL").isEmpty()


def test_digest_without_items(spark):
    empty = spark.createDataFrame([], "id bigint, name string, type string, relevance int, viability int, description string")
    out = research.digest_message(empty, "id", "Title", "end").collect()
    assert len(out) == 1 and "Nenhum item novo" in out[0]["entry"]
    assert research.known_list(empty).first()["known"] == "(none)"


def test_payloads(spark):
    df = spark.createDataFrame([("q", '{"results": [{"title": "t", "url": "u"}, {}]}'), ("bad", "{oops"), ("none", "{}")], "query string, payload string")
    rows = sorted(map(tuple, payloads.flatten_results(df).collect()))
    assert rows == [("q", 0, "t", "u", ""), ("q", 1, "", "", "")]
    html = '<a class="result__a" href="x">A <b>b</b></a><a class="result__snippet">s\n1</a><a class="result__a">  </a><a class="result__snippet">s2</a>'
    out = payloads.extract_html_results(spark.createDataFrame([("q", html)], "query string, html string")).collect()
    assert [tuple(r) for r in out] == [("q", 0, "A b", "", "s\n1")]
    assert payloads.read_documents(spark, "/nowhere/at/all").isEmpty()


def test_spec_and_requirements(spark):
    df = spark.createDataFrame([(1, "x ---SPEC-START---\n RF-01: a\nRF-02: b \n---SPEC-END--- y"), (2, "---SPEC-START--- open"), (3, "no")], "id int, reply string")
    out = texts.extract_spec(df).orderBy("id").collect()
    assert [(r["has_spec"], r["spec"]) for r in out] == [(True, "RF-01: a\nRF-02: b"), (True, None), (False, None)]
    counted = texts.count_requirements(texts.extract_spec(df).where("id = 1")).first()
    assert (counted["requirements"], counted["enough"]) == (2, False)


def test_files(spark):
    df = spark.createDataFrame([(1, "# FILE: models.py\nx = 1\n---FILE---\n\n---FILE---\ny = 2")], "id int, reply string")
    out = texts.split_files(df, "id").collect()
    assert [(r["pos"], r["filename"]) for r in out] == [(0, "models.py"), (1, "unknown.py")]
    raw = spark.createDataFrame([("```python\n# FILE: a.py\nx\n```",), ("x\n```\ny\n```\nz",), ("plain",)], "raw string")
    got = [(r["content"], r["filename"], r["lines"]) for r in texts.clean_generated(raw).collect()]
    assert got == [("# FILE: a.py\nx", "a.py", 2), ("x\ny\nz", "unknown.py", 3), ("plain", "unknown.py", 1)]
    named = spark.createDataFrame([("x", "asked.py"), ("# FILE: own.py", "asked.py"), ("y", None)], "raw string, asked string")
    assert [r["filename"] for r in texts.clean_generated(named, "asked").collect()] == ["asked.py", "own.py", "unknown.py"]
    header = spark.createDataFrame([("# FILE: a\nb\nc",), ("# FILE: only",), ("x\ny",)], "c string")
    assert [r[0] for r in header.select(texts.strip_header(header["c"])).collect()] == ["b\nc", "", "x\ny"]


def test_salvage(spark):
    replies = [(1, 'ok ```json\n[{"name": "a"}, {"name": "b"}]\n``` end'), (2, "[not json]"), (3, "nothing"), (4, "[]")]
    out = texts.salvage_json_array(spark.createDataFrame(replies, "id int, reply string"), "id", "name string")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (1, "b")]


def test_log(spark):
    log = "test_a PASSED\ncollected 0 items / 1 error\nERROR test_main.py\n!!! Interrupted: 1 error !!!\n=== 1 error in 0.24s ==="
    row = texts.test_outcome(texts.parse_test_log(spark.createDataFrame([(log,), ("",)], "log string"))).collect()
    assert (row[0]["passed_summary"], row[0]["passed"], row[0]["errors"], row[0]["failures"], row[0]["status"]) == (0, 1, 1, "ERROR test_main.py", "PASS")
    assert row[1]["status"] == "SKIP"


def test_secrets_ignore_case_and_take_extra_patterns(spark):
    docs = spark.createDataFrame([(1, "AUTH_TOKEN: abcdefghijklmnopqrstuvwxyz"), (2, "fine MyHost")], "id int, text string")
    extra = texts.denylist(["", "# note", "myhost"])
    out = {r["label"]: r["result"] for r in texts.secret_scan(docs, {**texts.SECRET_PATTERNS, **extra}).collect()}
    assert out["likely token values"] == "FAIL" and out["myhost"] == "FAIL" and out["private key material"] == "OK"


def test_infer_filename(spark):
    outputs = spark.createDataFrame(
        [(1, "r", "unknown.py", "# FILE: main.py\n"), (2, "r", None, "router = APIRouter()"), (3, "r", "unknown.py", "?"), (4, "r", "given.py", "")],
        "id int, run string, filename string, content string",
    )
    known = spark.createDataFrame([("r", "main.py"), ("r", "routes.py"), ("other", "a_routes.py")], "run string, filename string")
    named = texts.infer_filename(outputs, known, "id", "run")
    assert {r["id"]: r["filename"] for r in named.collect()} == {1: "main.py", 2: "routes.py", 3: "unknown.py", 4: "given.py"}
    assert {r["id"] for r in texts.discard_unknown_targets(named, known, "run").collect()} == {1, 2}


def test_context(spark):
    files = spark.createDataFrame([("r", 1, "aa"), ("r", 2, "b"), ("r", 3, "c"), ("s", 1, "z")], "run string, pos bigint, text string")
    out = {(r["run"], r["pos"]): (r["context_files"], r["context_chars"]) for r in texts.progressive_context(files, "run", "pos", "text").collect()}
    assert out == {("r", 1): (0, 0), ("r", 2): (1, 2), ("r", 3): (2, 3), ("s", 1): (0, 0)}
    picked = texts.context_of(files, files.where("run = 'r' AND pos = 3"), "run", "pos")
    assert sorted(r["text"] for r in picked.collect()) == ["aa", "b"]


def test_readiness_needs_every_part(spark):
    rows = [("environment", True, None, None), ("security", True, None, None), ("finance", True, None, None), ("gateway", None, True, True),
            ("carrier", None, True, True), ("carrier", None, True, True), ("notifier", None, True, True)]
    status = spark.createDataFrame([("full", *r) for r in rows] + [("short", *r) for r in rows[1:]] + [("one", *r) for r in rows[:5] + rows[6:]],
                                   "env string, kind string, flag boolean, enabled boolean, healthy boolean")
    assert {r["env"]: r["ready"] for r in runs.readiness(status, ["env"]).collect()} == {"full": True, "short": False, "one": False}
    assert {r["env"]: r["passed"] for r in runs.smoke_checks(status, ["env"]).collect()}["full"]


# --- snapshots ------------------------------------------------------------------


def test_append_once_is_idempotent(spark):
    path = shared_path(spark, "once")
    batch = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, run_date string")
    snapshots.append_once(batch.where("id = 1"), path)
    for _ in range(2):
        snapshots.append_once(batch, path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_versions_and_checkpoints(spark):
    root = shared_path(spark, "versions")
    df = spark.createDataFrame([(1, "9.90")], "id int, price string")
    assert load_or_empty(spark, root, "id INT, price STRING").isEmpty()
    snapshots.write_version(df, root, 1)
    snapshots.write_version(df.union(df), root, 2)
    assert snapshots.read_latest(spark, root, "id INT, price STRING").count() == 2
    path = shared_path(spark, "points")
    snapshots.checkpoint(df, path, "RB1")
    assert snapshots.restore(spark, path, "RB1", "id INT, price STRING").count() == 1
    with pytest.raises(LookupError):
        snapshots.restore(spark, path, "RB9", "id INT, price STRING")


def test_writes_can_be_repeated(spark):
    df = spark.createDataFrame([(1, "2024-01-30", 0, 1, "approved")], "id int, run_date string, section int, position int, log string")
    path = shared_path(spark, "again")
    for _ in range(2):
        snapshots.checkpoint(df.select("id"), f"{path}/points", "a/b: 1")
        snapshots.checkpoint(df.select("id").limit(0), f"{path}/points", "none")
        snapshots.append_log(df.select("id", "log"), f"{path}/log", "run-1")
        research.write_report(df, f"{path}/report")
    snapshots.append_log(df.select("id", "log"), f"{path}/log", "run-2")
    assert snapshots.restore(spark, f"{path}/points", "a/b: 1", "id INT").count() == 1
    assert snapshots.restore(spark, f"{path}/points", "none", "id INT").isEmpty()
    assert spark.read.parquet(f"{path}/log").count() == 2
    assert spark.read.json(f"{path}/report").count() == 1


def test_append_once_knows_odd_dates(spark):
    path = shared_path(spark, "odd")
    batch = spark.createDataFrame([(1, "01"), (2, "1+1"), (3, "a:b%"), (4, None)], "id int, run_date string")
    for _ in range(2):
        snapshots.append_once(batch, path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]


def test_a_version_holds_its_changes_only(spark):
    root, schema = shared_path(spark, "versioned"), "id INT, v STRING"
    table = spark.createDataFrame([(i, "a") for i in range(100)], schema)
    assert versioned.read_version(spark, root, schema, "id").isEmpty()
    assert versioned.newest(spark, root) is None
    versioned.write_changes(table, root, 1, "id")
    versioned.compact(spark, root, schema, "id")
    with pytest.raises(ValueError):
        versioned.write_changes(table, root, 1, "id")
    for _ in range(2):
        versioned.write_changes(spark.createDataFrame([(3, "b")], schema), root, 2, "id")
    versioned.write_changes(spark.createDataFrame([(3, "c"), (200, "c")], schema), root, 3, "id", spark.createDataFrame([(4,)], "id INT"))
    assert spark.read.parquet(f"{root}/rows/kind=delta/version=2").count() == 1
    found = versioned.read_version(spark, root, schema, "id")
    assert {r["id"]: r["v"] for r in found.collect()} == {i: "a" for i in range(100) if i not in (3, 4)} | {3: "c", 200: "c"}
    assert len({f.split("version=")[1].split("/")[0] for f in found.inputFiles()}) == 3
    assert {r["v"] for r in versioned.read_version(spark, root, schema, "id", 2).where("id = 3").collect()} == {"b"}
    assert versioned.read_version(spark, root, schema, "id", 1).where("v = 'a'").count() == 100
    with pytest.raises(ValueError):
        versioned.write_changes(table, root, 2, "id")


def test_deltas_become_a_base(spark):
    root, schema = shared_path(spark, "compacted"), "id INT, v INT"
    for version in range(1, 8):
        versioned.write_changes(spark.createDataFrame([(version % 3, version)], schema), root, version, "id", every=3)
    base, deltas = versioned.held(spark, root)
    assert base == 6 and deltas == [7]
    found = versioned.read_version(spark, root, schema, "id")
    assert {r["id"]: r["v"] for r in found.collect()} == {1: 7, 2: 5, 0: 6}
    assert {f.split("kind=")[1].rsplit("/", 1)[0] for f in found.inputFiles()} == {"base/version=6", "delta/version=7"}
    # A folder without its entry was never finished, and is not seen.
    spark.createDataFrame([(9, 9, False)], "id INT, v INT, _removed BOOLEAN").write.parquet(f"{root}/rows/kind=delta/version=8")
    assert versioned.newest(spark, root) == 7


def test_upsert_last_write_wins(spark):
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, version int, v string")
    b = spark.createDataFrame([(1, 2, "c"), (3, 2, "d")], "id int, version int, v string")
    assert {r["id"]: r["v"] for r in snapshots.upsert(a, b, "id", "version").collect()} == {1: "c", 2: "b", 3: "d"}
