"""Runs from end to end: the command line, resumed jobs, streams, and cases that once gave wrong rows."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from kinweave import cli
from kinweave.functions.cleaning import ColumnClean, clean
from kinweave.operators.cascade import link_phase
from kinweave.operators.search import source_key
from kinweave.plans.run import COMPLETED, PENDING, Checkpoint, link_frame
from kinweave.plans.spec import DedupSpec, Execution, IndexSpec, LinkageSpec, SpecError, Storage, build
from kinweave.sources.index import ID, TextIndex
from kinweave.streaming.linkage import link_stream

RULES = [{"source_column": "name", "target_column": "name", "es_clause_type": "must", "query_type": "match", "similarity": "jaro_winkler", "weight": 1.0}]
PHASES = [{"phase_name": "one", "strong_match_score_threshold": 0.9, "rules": RULES}]
SOURCE = [("s1", "Ana Lima", "BA"), ("s2", "Bruno Reis", "SP"), ("s3", "Nobody", "SP")]
TARGET = [("t1", "Ana Lima"), ("t2", "Bruno Reis"), ("t3", "Carla Dias"), ("t2b", "Bruno Reiss")]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(SOURCE, "sid string, name string, uf string").write.option("header", True).csv(f"{tmp_path}/in/people")
    spark.createDataFrame(TARGET, "tid string, name string").write.option("header", True).csv(f"{tmp_path}/in/targets")
    return tmp_path


def written(path, content):
    path.write_text(yaml.safe_dump(content))
    return str(path)


def test_command_line_from_csv_to_entities(spark, tables, monkeypatch):
    monkeypatch.setattr(cli, "create_session", lambda *a: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    out = str(tables / "out")
    storage = {"source_path": f"{tables}/in", "source_format": "csv", "source_options": {"header": "true"}, "output_path": out}
    env = {"storage": storage, "execution": {"job_id": "j", "audit_log_path": f"{tables}/audit"}, "elasticsearch": {"es_connection_url": "http://none", "search_strategy": "single"}}
    index = {"source_config": {"source_table": "targets", "id_field": "tid", "id_from_source": True}, "index_config": {"name": "idx", "number_of_shards": 2}, "index_columns": [{"name": "tid", "type": "keyword"}, {"name": "name", "type": "text"}]}
    linkage = {"workflow_name": "w", "source_table": "people", "id_source_table": "sid", "target_es_index": "idx", "id_target_table": "tid", "blocking_phases": PHASES}
    env_file = written(tables / "env.yml", env)
    assert cli.main(["indexing", "--env-config", env_file, "--spec-config", written(tables / "index.yml", index)]) == 0
    assert cli.main(["linkage", "--env-config", env_file, "--spec-config", written(tables / "linkage.yml", linkage)]) == 0
    pairs = {(r["source_sid"], r["candidate_tid"]) for r in spark.read.parquet(f"{out}/w").collect()}
    assert pairs == {("s1", "t1"), ("s2", "t2"), ("s2", "t2b")}
    dedup = env | {"storage": {"source_path": f"{out}/w", "output_path": f"{tables}/entities"}, "deduplication": {"id_source_column": "source_sid", "id_target_column": "candidate_tid"}}
    assert cli.main(["deduplication", "--env-config", written(tables / "dedup.yml", dedup)]) == 0
    got = {r["source_sid"]: r["cluster_id"] for r in spark.read.parquet(f"{tables}/entities").collect()}
    assert len(set(got.values())) == 2
    phase = json.loads((tables / "audit/w/j/phases.jsonl").read_text().splitlines()[0])
    assert (phase["records_in"], phase["records_out"], phase["phase_index"], phase["status"], phase["unit_id"]) == (3, 3, 1, "completed", "global")
    assert phase["candidates_found"] >= 3 and phase["duration_s"] >= phase["search_duration_s"] > 0
    unit = json.loads((tables / "audit/w/j/units.jsonl").read_text().splitlines()[0])
    assert unit["total_links"] == 3 and unit["remaining"] == 1 and unit["started_at"] < unit["completed_at"]
    assert [json.loads(x)["event"] for x in (tables / "audit/indexing.jsonl").read_text().splitlines()] == ["indexing_start", "index_ensured", "indexing_complete"]


def test_unknown_strategy():
    with pytest.raises(SpecError):
        build(Execution, {"search_strategy": "parallel"}, "execution")


def linkage(**more):
    return LinkageSpec("people", "sid", "targets", "tid", PHASES, workflow_name="w", **more)


def over(spark, fields=None, rows=TARGET, schema="tid string, name string"):
    return TextIndex.simple(spark.createDataFrame(rows, schema), fields or {"tid": "keyword", "name": "text"}, "tid")


def test_resumed_job_leaves_units_that_are_not_asked_for(spark, tmp_path):
    source = spark.createDataFrame(SOURCE, "sid string, name string, uf string")
    old = Checkpoint(f"{tmp_path}/audit/w", "j")
    old.open(["uf_BA", "uf_SP"])
    run = Execution(job_id="j", partition_column="uf", filter_partitions=("SP",), audit_log_path=f"{tmp_path}/audit")
    sink = link_frame(source, over(spark), linkage(), Storage(f"{tmp_path}/out"), run)
    assert {r["source_uf"] for r in sink.read("w").collect()} == {"SP"}
    assert json.loads((tmp_path / "audit/w/j/state.json").read_text())["units"] == {"uf_BA": PENDING, "uf_SP": COMPLETED}


@pytest.mark.parametrize("kind, value, stored", [("date", "2020-01-01", "2020-01-01"), ("double", "5", "5.0"), ("integer", "07", "7"), ("text", "ana", "Ana Lima"), ("keyword", "x", "x")])
@pytest.mark.parametrize("clause", ["must", "should"])
def test_dynamic_columns_are_compared_by_type(spark, kind, value, stored, clause):
    index = over(spark, {"tid": "keyword", "name": "text", "d": kind}, [("t1", "Ana Lima", stored), ("t2", "Ana Lima", None)], "tid string, name string, d string")
    source = spark.createDataFrame([("s1", "Ana Lima", value), ("s2", "Ana Lima", None)], "sid string, name string, d string")
    phase = {"phase_name": "p", "strong_match_score_threshold": 0.0, "rules": [RULES[0] | {"es_clause_type": clause}], "indexed_dataset_filter": [{"column": {"source_column": "d", "target_column": "d"}}]}
    spec = LinkageSpec("people", "sid", "targets", "tid", [phase])
    assert [(r["source_sid"], r["candidate_tid"]) for r in link_phase(source, index, spec, spec.blocking_phases[0]).collect()] == [("s1", "t1")]


def test_queries_with_some_required_values_missing(spark):
    """Required values that a row lacks take no part; the rest still bind, and other rules only count."""
    rows = [("t1", "Ana Lima", "a", 1), ("t2", "Ana Lima", "a", 2), ("t3", "Bruno Reis", "b", 1), ("t4", "Ana Reis", None, 1)]
    index = over(spark, {"tid": "keyword", "name": "text", "k": "keyword", "n": "integer"}, rows, "tid string, name string, k string, n int")
    source = spark.createDataFrame([("s1", "Ana", "a", 1), ("s2", "Ana", None, 1), ("s3", "Ana", "a", None), ("s4", "Ana", None, None), ("s5", None, "b", 1), ("s6", None, " ", None), ("s7", "Ana", "none", 1)], "sid string, name string, k string, n int")
    rule = lambda c, kind, q="term": {"source_column": c, "target_column": c, "es_clause_type": kind, "query_type": q, "similarity": "exact", "weight": 1.0}
    phase = {"phase_name": "p", "candidate_limit": 2, "strong_match_score_threshold": 0.0, "rules": [rule("k", "must"), rule("n", "filter"), rule("name", "should", "match")]}
    spec = LinkageSpec("people", "sid", "targets", "tid", [phase])
    got = {}
    for r in link_phase(source, index, spec, spec.blocking_phases[0]).collect():
        got.setdefault(r["source_sid"], set()).add(r["candidate_tid"])
    assert got == {"s1": {"t1"}, "s2": {"t1", "t4"}, "s3": {"t1", "t2"}, "s4": {"t1", "t2"}, "s5": {"t3"}, "s6": {"t1", "t2"}}


def test_rows_that_read_alike_have_one_key(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None)], "x string, y string")
    assert df.select(source_key(["x", "y"]).alias("k")).distinct().count() == 3


def test_rename_onto_a_column_is_refused(spark):
    df = spark.createDataFrame([("a ", "keep")], "a string, b string")
    with pytest.raises(ValueError):
        clean(df, [ColumnClean("a", cleaned_name="b", trim=True)])
    assert clean(df, [ColumnClean("a", cleaned_name="c", trim=True)]).first() == ("a", "keep")


def test_index_is_replaced_as_a_whole(spark, tmp_path):
    spec = IndexSpec.of({"source_config": {"source_table": "t", "id_field": "tid", "id_from_source": True}, "index_config": {"name": "i"}, "index_columns": [{"name": "tid", "type": "keyword"}, {"name": "name", "type": "text"}]})
    path = f"{tmp_path}/i"
    TextIndex.over(spark.createDataFrame(TARGET, "tid string, name string"), spec).save(path, True)
    reader = TextIndex.load(spark, path)
    for _ in range(2):
        TextIndex.over(spark.createDataFrame([("t1", "B"), ("t1", "A"), ("t9", "New")], "tid string, name string"), spec).save(path, True)
    got = {r[ID]: r["name"] for r in TextIndex.load(spark, path).docs.collect()}
    assert set(got) == {"t1", "t2", "t2b", "t3", "t9"} and got["t1"] in "AB" and got["t9"] == "New"
    assert reader.docs.schema == TextIndex.load(spark, path).docs.schema
    assert len([p for p in (tmp_path / "i").iterdir() if p.name.startswith("docs")]) == 1


def test_generated_ids_do_not_change(spark):
    spec = IndexSpec.of({"source_config": {"source_table": "t", "id_field": "tid"}, "index_config": {"name": "i"}, "index_columns": [{"name": "tid", "type": "keyword"}, {"name": "name", "type": "text"}]})
    docs = TextIndex.over(spark.createDataFrame(TARGET, "tid string, name string"), spec).docs
    assert docs.join(docs, ID).count() == len(TARGET)


def test_stream_links_each_row_once(spark, tmp_path):
    folder = tmp_path / "stream"
    frame = lambda rows: spark.createDataFrame(rows, "sid string, name string, uf string")
    out = Storage(f"{tmp_path}/out")
    source = lambda: spark.readStream.schema("sid string, name string, uf string").parquet(str(folder))
    for rows in (SOURCE[:1], SOURCE[1:], [("s9", "Zed", "SP")]):
        frame(rows).coalesce(1).write.mode("append").parquet(str(folder))
        link_stream(source(), over(spark), linkage(), out, f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(out.path)
    assert sorted((r["source_sid"], r["candidate_tid"]) for r in got.collect()) == [("s1", "t1"), ("s2", "t2"), ("s2", "t2b")]
    assert got.where(F.col("source_sid") == "s9").count() == 0


def test_dedup_spec_needs_two_columns():
    with pytest.raises(SpecError):
        DedupSpec("a", "a")


# --- searches over many documents that read alike -------------------------------------------


def _plain_rule(column, clause_type, query_type="term"):
    return {"source_column": column, "target_column": column, "similarity": "exact", "weight": 1.0, "es_clause_type": clause_type, "query_type": query_type}


def _alike(spark, n=10_050):
    """An index of ``n`` documents with three names in two places, and its source."""
    names = F.element_at(F.array(*map(F.lit, ["ana silva", "ana lima", "rui costa"])), (F.col("id") % 3 + 1).cast("int"))
    docs = spark.range(n).select("id", names.alias("name"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"))
    source = spark.createDataFrame([("s1", "ana silva", "a"), ("s2", "ana silva", None), ("s3", "ana", "a"), ("s4", None, "b")], "sid string, name string, k string")
    return source, TextIndex.simple(docs, {"id": "long", "name": "text", "k": "keyword"}, "id")


def test_no_hit_is_cut_from_a_search_without_a_limit(spark):
    """the queries of all hits had a limit of 10,000."""
    from kinweave import queries

    source, index = _alike(spark, 33_000)
    rules = [_plain_rule("name", "must", "match")]
    spec = LinkageSpec("s", "sid", "t", "id", [{"phase_name": "p", "candidate_limit": queries.ALL, "strong_match_score_threshold": 0.0, "rules": rules}])
    got = link_phase(source.where("sid = 's1'"), index, spec, spec.blocking_phases[0], all_pairs=True)
    assert got.count() == 22_000 == got.select("candidate_id").distinct().count()


@pytest.mark.parametrize("k", [3, 2000])
def test_copies_are_searched_once_and_groups_by_lists(spark, k):
    """F2 to F6: a search joins classes of documents, and reads of a group of required values its first documents only."""
    from kinweave.operators import search

    source, index = _alike(spark, 600)
    rules = [_plain_rule("k", "filter"), _plain_rule("name", "should", "match")]
    spec = LinkageSpec("s", "sid", "t", "id", [{"phase_name": "p", "candidate_limit": k, "strong_match_score_threshold": 0.0, "rules": rules}])
    one = search.Search(index, spec.blocking_phases[0], [])
    part = search._Part(one, one.queries(source), 0)
    assert part.docs.count() == 3
    names = ["ana silva", "ana lima", "rui costa"]
    want = set()
    for sid, name, place in [("s1", "ana silva", "a"), ("s2", "ana silva", None), ("s3", "ana", "a"), ("s4", None, "b")]:
        # Rarer terms weigh more, and shorter documents are none: whole names, then half of one, then the rest of the place.
        hits = lambda i: len(set((name or "").split()) & set(names[i % 3].split()))
        ids = [i for i in range(600) if (i % 2 == "ab".index(place) if place else hits(i))]
        want |= {(sid, i) for i in sorted(ids, key=lambda i: (-hits(i), str(i)))[:k]}
    got = link_phase(source, index, spec, spec.blocking_phases[0], all_pairs=True)
    assert {(r["source_sid"], int(r["candidate_id"])) for r in got.collect()} == want
