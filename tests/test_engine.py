"""Specifications, scores, search details, sinks, checkpoints, clusters and the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinweave.cli import main
from kinweave.functions.cleaning import ColumnClean, clean, strip_accents
from kinweave.functions.scoring import score_names, score_pairs
from kinweave.functions.similarity import REGISTRY, jaro_winkler_value, register_similarity
from kinweave.operators.cascade import best_match_only, cascade, link_phase
from kinweave.operators.components import connected_components
from kinweave.operators.filters import clause
from kinweave.operators.search import edit_distance
from kinweave.plans.run import COMPLETED, FAILED, PENDING, Checkpoint, preflight, unit_ids
from kinweave.plans.spec import DedupSpec, Execution, Filter, IndexField, IndexSpec, LinkageSpec, Phase, Rule, SpecError, Storage, load_yaml
from kinweave.sources.index import TextIndex
from kinweave.sources.tables import PhaseSink, TableSource, union_phases


def rule(column="nome", **more):
    return Rule(**({"source_column": column, "target_column": column, "similarity": "exact", "weight": 1.0} | more))


# --- specifications ---------------------------------------------------------------------


@pytest.mark.parametrize("bad", [
    lambda: rule(weight=-1), lambda: rule(penalty=-0.1), lambda: rule(boost=0), lambda: rule(is_fuzzy=True, query_type="term"), lambda: Phase("p", (rule(),), candidate_limit=0),
    lambda: Phase("p", (rule(),), strong_match_score_threshold=1.1), lambda: LinkageSpec("a", "i", "b", "j", []), lambda: Filter(), lambda: Filter(term={"a": 1}, range={"b": {}}),
    lambda: Filter(column={"source_column": "x"}), lambda: Execution(sample_fraction=0), lambda: Execution(filter_partitions=("a",)), lambda: DedupSpec("a", "a"), lambda: Storage(""),
    lambda: IndexSpec("t", "", "n", (IndexField("a", "text"),)), lambda: LinkageSpec("a", "i", "b", "j", [{"phase_name": "p"}]),
])
def test_bad_specifications(bad):
    with pytest.raises(SpecError):
        bad()


def test_specification_defaults_and_merge():
    spec = LinkageSpec("a", "i", "b", "j", [{"phase_name": "p", "rules": [{"source_column": "x", "target_column": "y", "similarity": "exact", "weight": 1, "es_clause_type": "MUST"}], "indexed_dataset_filter": [{"term": {"k": 1}}]}], extra_target_fields=["z", "y"], indexed_dataset_filter=[{"range": {"q": {"gte": 1}}}])
    phase = spec.blocking_phases[0]
    assert (phase.candidate_limit, phase.strong_match_score_threshold, phase.enabled, phase.rules[0].es_clause_type) == (10, 0.9, True, "must")
    assert spec.workflow_name == "linkage_a_b" and [f.range is not None for f in spec.filters_of(phase)] == [True, False]
    assert spec.source_columns() == ["i", "x"] and spec.target_columns() == ["j", "y", "z"]
    assert json.loads(str(spec))["id_source_table"] == "i"


def test_yaml(tmp_path):
    (tmp_path / "a.yml").write_text("x: {y: 1}")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "list.yml").write_text("- 1")
    (tmp_path / "b.txt").write_text("x: 1")
    assert load_yaml(tmp_path / "a.yml") == {"x": {"y": 1}} and load_yaml(tmp_path / "empty.yaml") == {}
    for name in ("list.yml", "b.txt"):
        with pytest.raises(SpecError):
            load_yaml(tmp_path / name)
    with pytest.raises(FileNotFoundError):
        load_yaml(tmp_path / "none.yml")


def test_index_mapping():
    fields = {"a": IndexField("a", "string", index_as="both", analyzer="brazilian").mapping(), "b": IndexField("b", "text", index_as="keyword", ignore_above=32).mapping(), "c": IndexField("c", "date", format="yyyy-MM-dd").mapping(), "d": IndexField("d", "integer").mapping()}
    assert fields == {"a": {"type": "text", "fields": {"keyword": {"type": "keyword", "ignore_above": 256}}, "analyzer": "brazilian"}, "b": {"type": "keyword", "ignore_above": 32}, "c": {"type": "date", "format": "yyyy-MM-dd"}, "d": {"type": "integer"}}


# --- scores -------------------------------------------------------------------------------


def test_known_similarities():
    assert round(jaro_winkler_value("MARTHA", "MARHTA"), 4) == 0.9611 and round(jaro_winkler_value("DIXON", "DICKSONX"), 4) == 0.8133
    assert jaro_winkler_value("", "") == 1.0 and jaro_winkler_value("", "A") == 0.0 and jaro_winkler_value("ABC", "XYZ") == 0.0


def restated(rules, a, b):
    sims = {"exact": lambda x, y: float(x == y), "hamming": lambda x, y: 0.0 if len(x) != len(y) else 1.0 if not x else sum(p == q for p, q in zip(x, y)) / len(x), "jaro_winkler": jaro_winkler_value}
    raw, punished = 0.0, False
    for r in rules:
        x, y = a[r.source_column], b[r.target_column]
        if x is None or y is None:
            raw, punished = raw - r.penalty, punished or r.penalty > 0
        else:
            raw += r.weight * sims[r.similarity](x, y)
    norm = raw / sum(r.weight for r in rules)
    return round(min(1.0, norm) if punished else min(1.0, max(0.0, norm)), 6)


def test_scores_equal_their_restatement(spark):
    rng = random.Random(7)
    rules = [rule("x", weight=0.5, similarity="jaro_winkler"), rule("y", weight=0.3, similarity="hamming", penalty=0.4), rule("z", weight=0.2)]
    pick = lambda: rng.choice([None, "", "ANA", "ANNA", "BRUNO", "BRUNA", "JOSÉ"])
    data = [(i, *(pick() for _ in range(6))) for i in range(400)]
    df = spark.createDataFrame(data, "id int, x string, y string, z string, tx string, ty string, tz string")
    want = {r[0]: restated(rules, dict(zip("xyz", r[1:4])), dict(zip("xyz", r[4:]))) for r in data}
    got = {r["id"]: r["match_score"] for r in score_pairs(df, rules, F.col, lambda c: F.col("t" + c)).collect()}
    assert all(abs(got[i] - want[i]) <= 1.01e-6 for i in want)
    pruned = {r["id"] for r in score_pairs(df, rules, F.col, lambda c: F.col("t" + c), threshold=0.6).where("match_score >= 0.6").collect()}
    assert pruned == {i for i, v in got.items() if v >= 0.6}


def test_score_names_and_registry(spark):
    assert score_names([rule("a"), rule("a", target_column="b"), rule("c")]) == ["sim_a", "sim_a_b", "sim_c"]
    with pytest.raises(KeyError):
        score_pairs(spark.range(1), [rule(similarity="none such")], F.col, F.col)
    register_similarity("first_letter", lambda a, b: (F.substring(a, 1, 1) == F.substring(b, 1, 1)).cast("double"))
    df = spark.createDataFrame([("AB", "AC")], "nome string, t string")
    assert score_pairs(df, [rule(similarity="first_letter")], F.col, lambda c: F.col("t")).first()["match_score"] == 1.0
    del REGISTRY["first_letter"]
    assert score_pairs(df, [], F.col, F.col).first()["match_score"] == 0.0


def test_threshold_equality(spark):
    """A score at the threshold passes, whatever its digits."""
    for t in (0.6, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99):
        df = spark.createDataFrame([("a", "a", "x", "y")], "p string, tp string, q string, tq string")
        rules = [rule("p", weight=t), rule("q", weight=1 - t)]
        assert score_pairs(df, rules, F.col, lambda c: F.col("t" + c), threshold=t).where(F.col("match_score") >= t).count() == 1


# --- cleaning ---------------------------------------------------------------------------------


def test_cleaning(spark):
    df = spark.createDataFrame([("  José [D'Ávila] & Cia ", "99", "x1")], "a string, b string, c string")
    out = clean(df, [ColumnClean("a", cleaned_name="nome", trim=True, remove_characters="[]&'", strip_accents=True, case="upper", truncate=12), ColumnClean("b", invalid_values=["99"]), ColumnClean("c", cast="int")])
    assert out.columns == ["nome", "b", "c"] and tuple(out.first()) == ("JOSE DAVILA ", None, None)
    exact = spark.createDataFrame([("ﬁne ½ café",)], "a string").select(strip_accents(F.col("a"), exact=True).alias("a")).first()["a"]
    assert exact == "fine 1⁄2 cafe"
    for bad in ({"case": "none"}, {"truncate": 0}):
        with pytest.raises(ValueError):
            ColumnClean("a", **bad)


# --- search ---------------------------------------------------------------------------------------


def test_edit_distance_counts_transpositions_once(spark):
    df = spark.createDataFrame([("maria", "mraia"), ("maria", "mari"), ("maria", "marta"), ("oliveira", "olievria"), ("oliveira", "oliver"), ("abcdef", "uvwxyz"), ("oliveira", "oilveirx")], "a string, b string")
    assert [r[0] for r in df.select(edit_distance(F.col("a"), F.col("b"), 2)).collect()] == [1, 1, 1, 2, 2, None, 2]
    assert [r[0] for r in df.select(edit_distance(F.col("a"), F.col("b"), 1)).collect()][:3] == [1, 1, 1]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([("1", "Ana Maria Silva", 30, True, "2001-02-03", "SP"), ("2", "Bruno Souza", 41, False, "1999-12-31", "RJ"), ("3", "Ana Souza", None, None, None, None)], "id string, name string, age int, ok boolean, born string, uf string")
    fields = {"id": "keyword", "name": {"type": "text", "fields": {"keyword": {"type": "keyword", "ignore_above": 12}}}, "age": "integer", "ok": "boolean", "born": {"type": "date", "format": "yyyy-MM-dd"}, "uf": "keyword"}
    return TextIndex.simple(docs, fields, "id")


@pytest.mark.parametrize("body, ids", [
    ({"match_all": {}}, "123"), ({"term": {"name": "ana"}}, "13"), ({"term": {"name": "Ana"}}, ""), ({"term": {"age": "41"}}, "2"), ({"term": {"ok": True}}, "1"), ({"terms": {"uf": ["SP", "RJ"]}}, "12"),
    ({"range": {"born": {"lt": "2000-01-01"}}}, "2"), ({"range": {"field": "age", "gte": 30, "lt": None}}, "12"), ({"exists": {"field": "uf"}}, "12"), ({"ids": {"values": [1, "3"]}}, "13"), ({"prefix": {"name": "sou"}}, "23"),
    ({"wildcard": {"uf": "?P"}}, "1"), ({"regexp": {"uf": "[RS].*"}}, "12"), ({"match": {"name": "maria BRUNO"}}, "12"), ({"match_phrase": {"name": "ana maria"}}, "1"), ({"term": {"name.keyword": "Bruno Souza"}}, "2"), ({"term": {"name.keyword": "Ana Maria Silva"}}, ""),
    ({"bool": {"must": [{"match": {"name": "ana"}}], "must_not": {"exists": {"field": "uf"}}}}, "3"), ({"bool": {"should": [{"term": {"uf": "SP"}}, {"term": {"uf": "RJ"}}], "minimum_should_match": 1}}, "12"),
])
def test_clauses(index, body, ids):
    assert "".join(sorted(r["_id"] for r in index.docs.where(clause(index, body)).collect())) == ids


def test_unknown_clause(index):
    for body in ({"geo_shape": {}}, {"term": {"a": 1}, "range": {}}, {"term": {"nothing": 1}}):
        with pytest.raises(SpecError):
            clause(index, body)


def test_candidates_are_text_and_limited(spark, index):
    source = spark.createDataFrame([("s1", "Ana Maria Silva", 30), ("s2", None, 41), ("s3", "Zed", 5)], "sid string, nome string, idade int")
    spec = LinkageSpec("s", "sid", "t", "id", [{"phase_name": "p", "candidate_limit": 1, "strong_match_score_threshold": 0.0, "rules": [
        {"source_column": "nome", "target_column": "name", "es_clause_type": "should", "similarity": "exact", "weight": 0.5}, {"source_column": "idade", "target_column": "age", "es_clause_type": "should", "query_type": "term", "similarity": "exact", "weight": 0.5}]}], extra_target_fields=["ok"])
    out = link_phase(source, index, spec, spec.blocking_phases[0], debug=True)
    got = {r["source_sid"]: r for r in out.collect()}
    assert set(got) == {"s1", "s2"} and got["s1"]["candidate_age"] == "30" and got["s1"]["candidate_ok"] == "true" and got["s1"]["match_score"] == 1.0
    assert got["s2"]["match_score"] == 0.5 and json.loads(got["s2"]["score_debug_json"])["rules"][0]["is_null"] is True
    assert best_match_only(out.unionByName(out), "sid").count() == 2


def test_cascade_invariants(spark, index):
    source = spark.createDataFrame([(f"s{i}", n, u) for i, (n, u) in enumerate([("Ana Maria Silva", "SP"), ("Bruno Sousa", "RJ"), ("Ana Sousa", None), ("  ", "SP")])], "sid string, nome string, uf string")
    rules = lambda q, s, **k: [{"source_column": "nome", "target_column": "name", "es_clause_type": "must", "query_type": q, "similarity": s, "weight": 1.0} | k]
    spec = LinkageSpec("s", "sid", "t", "id", [{"phase_name": "one", "rules": rules("match", "exact"), "strong_match_score_threshold": 0.99}, {"phase_name": "off", "enabled": False, "rules": rules("match", "exact")}, {"phase_name": "two", "rules": rules("match", "jaro_winkler", is_fuzzy=True), "strong_match_score_threshold": 0.8}])
    results = cascade(source, index, spec)
    assert [r.status for r in results] == ["completed", "skipped", "completed"]
    seen = [{r["source_sid"] for r in x.linked.collect()} for x in results if x.linked is not None]
    assert seen == [{"s0"}, {"s1", "s2"}]


# --- storage and runs -------------------------------------------------------------------------------


def test_phase_sink_overwrites_only_its_partitions(spark, tmp_path):
    sink = PhaseSink(spark, Storage(str(tmp_path)))
    df = spark.createDataFrame([("a", "SP"), ("b", "BA")], "source_id string, source_uf string")
    assert sink.write(df, "x", "one", "uf") == 2 and sink.write(df.where("source_uf = 'BA'"), "x", "one", "uf") == 1
    assert sink.read("x").count() == 2
    assert sink.write(df.where("false"), "x", "one", "uf", "BA") == 0
    assert [r["source_uf"] for r in sink.read("x").collect()] == ["SP"]


def test_table_source(spark, tmp_path):
    spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, uf string").write.partitionBy("uf").parquet(str(tmp_path / "t"))
    source = TableSource(spark, Storage(str(tmp_path)))
    assert source.partitions("t", "uf") == ["a", "b"] and source.missing("t", ["id", "x"]) == ["x"] and source.problems("t") == [] and source.problems("none")
    assert source.read("t", uf="a").count() == 1
    with pytest.raises(ValueError):
        union_phases([None])


def test_work_units_and_checkpoint(tmp_path):
    run = Execution(job_id="j", partition_column="uf", filter_partitions=("S P", "RJ"))
    assert unit_ids(run) == {"uf_S_P": "S P", "uf_RJ": "RJ"} and unit_ids(Execution()) == {"global": None}
    with pytest.raises(SpecError):
        unit_ids(run, ["a b", "a_b"])
    state = Checkpoint(str(tmp_path), "j")
    state.open(unit_ids(run))
    taken = state.pending()
    state.mark(next(taken), COMPLETED)
    state.mark(next(taken), FAILED)
    again = Checkpoint(str(tmp_path), "j")
    again.open(unit_ids(run))
    assert again.state == {"uf_S_P": COMPLETED, "uf_RJ": PENDING}
    again.file.write_text("not json")
    broken = Checkpoint(str(tmp_path), "j")
    broken.open(["global"])
    assert broken.state == {"global": PENDING} and any("corrupt" in p.name for p in again.file.parent.iterdir())


def test_preflight(spark, index):
    spec = LinkageSpec("s", "sid", "t", "id", [{"phase_name": "p", "rules": [{"source_column": "x", "target_column": "nothing", "similarity": "odd", "weight": 1}]}])
    with pytest.raises(SpecError) as e:
        preflight(spark.range(1), index, spec, Execution(partition_column="uf"))
    assert all(w in str(e.value) for w in ("'sid'", "'x'", "'uf'", "'nothing'", "odd"))


def test_components_against_union_find(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 350)] + [(500, k) for k in range(501, 560)] + [(700, 700), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_command_line_errors(tmp_path):
    (tmp_path / "env.yml").write_text("storage: {}")
    assert main(["linkage", "--env-config", str(tmp_path / "env.yml")]) == 1
    assert main(["indexing", "--env-config", str(tmp_path / "none.yml")]) == 1


def test_unlimited_search_of_whole_values(spark):
    """Every document of equal required values, whatever the other rules say of it; ``must_not`` and ``must`` hold."""
    docs = spark.createDataFrame([(i, "SP" if i % 2 else "RJ", f"n{i % 7}", i % 3) for i in range(1500)] + [(None, "SP", "n1", 0), (1500, None, "n1", 0)], "id long, uf string, name string, age int")
    index = TextIndex.simple(docs, {"id": "long", "uf": "keyword", "name": "keyword", "age": "integer"}, "id")
    source = spark.createDataFrame([("a", "SP", "n1", 2), ("b", "SP", None, None), ("c", "RJ", "n2", 0), ("d", "XX", "n2", 0), ("e", None, "n1", 1)], "sid string, uf string, name string, age int")
    one = lambda c, kind, **k: {"source_column": c, "target_column": c, "es_clause_type": kind, "query_type": "term", "similarity": "exact", "weight": 0.5} | k
    for kind, drop in (("should", lambda s, d: False), ("must_not", lambda s, d: s[3] == d[3]), ("must", lambda s, d: s[3] is not None and s[3] != d[3])):
        found = {}
        for limit in (2**31 - 1, 100000):
            spec = LinkageSpec("s", "sid", "t", "id", [{"phase_name": "p", "candidate_limit": limit, "strong_match_score_threshold": 0.0, "rules": [one("uf", "filter"), one("name", "should", boost=2.0), one("age", kind)]}])
            got = link_phase(source.where("uf is not null"), index, spec, spec.blocking_phases[0], all_pairs=True)
            found[limit] = sorted((r["source_sid"], int(r["candidate_id"]), round(r["es_score"], 6)) for r in got.collect())
        want = {(s[0], d[0]) for s in source.collect() for d in docs.collect() if d[0] is not None and s[1] is not None and s[1] == d[1] and not drop(s, d)}
        assert found[2**31 - 1] == found[100000] and {x[:2] for x in found[100000]} == want and len(want) == len(found[100000])


def test_no_classes_are_made_where_pairs_are_told_directly(spark, monkeypatch):
    """Each work unit would sort the whole index for classes that nothing reads."""
    from kinweave.operators import search

    made = []
    monkeypatch.setattr(search, "staged", lambda df, tag, was=search.staged: made.append(tag) or was(df, tag))
    docs = spark.createDataFrame([("1", "SP", "ANA"), ("2", "SP", "EVA"), ("3", "RJ", "ANA")], "id string, uf string, name string")
    index = TextIndex.simple(docs, {"id": "keyword", "uf": "keyword", "name": "keyword"}, "id")
    rules = [{"source_column": c, "target_column": c, "es_clause_type": kind, "query_type": "term", "similarity": "exact", "weight": 0.5} for c, kind in (("uf", "filter"), ("name", "should"))]
    phase = LinkageSpec("s", "sid", "t", "id", [{"phase_name": "p", "candidate_limit": search.UNLIMITED, "strong_match_score_threshold": 0.0, "rules": rules}]).blocking_phases[0]
    source = spark.createDataFrame([("x", "SP", "ANA")], "sid string, uf string, name string")
    got = search.Search(index, phase, []).pairs(source, ["id"]).orderBy("candidate_id").collect()
    assert [r["candidate_id"] for r in got] == ["1", "2"] and got[0]["es_score"] > got[1]["es_score"]
    assert "classes" not in made


def test_sources_that_can_not_reach_the_threshold_end_early(spark):
    docs = spark.createDataFrame([(1, "SP", "ana"), (2, "SP", None)], "id long, uf string, name string")
    index = TextIndex.simple(docs, {"id": "long", "uf": "keyword", "name": "keyword"}, "id")
    rules = [{"source_column": c, "target_column": c, "es_clause_type": "filter" if c == "uf" else "should", "query_type": "term", "similarity": "jaro_winkler", "weight": 0.5, "penalty": 0.1} for c in ("uf", "name")]
    spec = LinkageSpec("s", "sid", "t", "id", [{"phase_name": "p", "strong_match_score_threshold": 0.5, "rules": rules}])
    source = spark.createDataFrame([("a", "SP", None), ("b", None, None), ("c", "SP", "ana")], "sid string, uf string, name string")
    (all_null,), (found,) = cascade(source.where("sid <> 'c'"), index, spec), cascade(source, index, spec)
    assert (all_null.status, all_null.candidates, all_null.remaining, all_null.linked.count()) == ("completed", 0, 2, 0)
    assert [(r["source_sid"], r["candidate_id"]) for r in found.linked.collect()] == [("c", "1")] and (found.candidates, found.remaining) == (2, 2)


def test_jaro_winkler_is_never_above_its_bound(spark):
    from kinweave.functions.similarity import jaro_winkler_most, letter_counts

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abAB éß😀漢aaaa", k=rng.choice([0, 1, 2, 5, 12, 30])))
    pairs = [(a, b if rng.random() < 0.6 else a[:4] + b) for a, b in ((word(), word()) for _ in range(1500))]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", letter_counts(F.col("a")).alias("x"), letter_counts(F.col("b")).alias("y"))
    got = df.select("a", "b", jaro_winkler_most(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("most")).collect()
    assert all(jaro_winkler_value(r["a"], r["b"]) <= r["most"] + 1e-9 for r in got) and any(r["most"] < 0.7 for r in got)
