"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.analysis import folding, standard
from kinweave.functions.cleaning import ColumnClean, clean, strip_accents
from kinweave.functions.scoring import score_pairs, strong
from kinweave.functions.similarity import exact, hamming, jaro_winkler
from kinweave.operators.cascade import candidate_pairs, cascade, link_phase, remaining
from kinweave.operators.cluster import clusters, deduplicate, vertices
from kinweave.operators.filters import clause
from kinweave.operators.search import UNLIMITED
from kinweave.plans.spec import DedupSpec, LinkageSpec, Rule, Storage
from kinweave.sources.index import TextIndex
from kinweave.sources.tables import TableSource, union_phases

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed values of the derived linkage pair: given names, family names, states.
GIVEN = "ANA BRUNO CARLA DANIEL ELISA FABIO GABRIELA HENRIQUE ISABEL JOAO KARINA LUCAS MARIA NELSON OLIVIA PAULO".split()
FAMILY = "SILVA SANTOS OLIVEIRA SOUZA LIMA PEREIRA COSTA ALMEIDA RIBEIRO CARVALHO GOMES MARTINS ROCHA".split()
STATES = "BA SP RJ MG PE CE RS".split()


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the pair of tables that linkage queries use ------------------------------------


def _pick(names: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)


def _div(x, n: int):
    return F.floor(x / n)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(
        k.alias("rec_id"),
        F.concat_ws(" ", _pick(GIVEN, k % 16), _pick(FAMILY, _div(k, 16) % 13), _pick(FAMILY, _div(k, 208) % 13)).alias("full_name"),
        F.when(k % 12 != 0, F.concat_ws(" ", _pick(GIVEN, (5 * k + _div(k, 7)) % 16), _pick(FAMILY, _div(k, 11) % 13))).alias("mother_name"),
        F.when(k % 17 != 0, F.concat((1940 + (13 * k) % 71).cast("string"), F.lit("-"), F.lpad(((5 * k) % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad(((7 * k) % 28 + 1).cast("string"), 2, "0"))).alias("birth_date"),
        _pick(STATES, k % 7).alias("uf"),
    )


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, n = people(spark, sf_dir), F.col("rec_id"), F.col("full_name")
    swapped = F.concat(F.substring(n, 1, 2), F.substring(n, 4, 1), F.substring(n, 3, 1), F.substring(n, 5, 200))
    shorter = F.concat(F.substring(n, 1, 3), F.substring(n, 5, 200))
    return p.where(k % 10 < 7).select(
        (k + 1000000).alias("tgt_id"), F.when(k % 5 == 0, swapped).when(k % 5 == 1, shorter).otherwise(n).alias("full_name"),
        F.when(k % 9 != 4, F.col("mother_name")).alias("mother_name"), "birth_date", "uf",
    )


def _sql_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


PEOPLE_SQL = f"""
g AS (SELECT {_sql_list(GIVEN)} AS g, {_sql_list(FAMILY)} AS f, {_sql_list(STATES)} AS u),
people AS (
  SELECT c_custkey AS rec_id,
    g[CAST(c_custkey % 16 + 1 AS INT)] || ' ' || f[CAST((c_custkey // 16) % 13 + 1 AS INT)] || ' ' || f[CAST((c_custkey // 208) % 13 + 1 AS INT)] AS full_name,
    CASE WHEN c_custkey % 12 <> 0 THEN g[CAST((5 * c_custkey + c_custkey // 7) % 16 + 1 AS INT)] || ' ' || f[CAST((c_custkey // 11) % 13 + 1 AS INT)] END AS mother_name,
    CASE WHEN c_custkey % 17 <> 0 THEN CAST(1940 + (13 * c_custkey) % 71 AS VARCHAR) || '-' || lpad(CAST((5 * c_custkey) % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST((7 * c_custkey) % 28 + 1 AS VARCHAR), 2, '0') END AS birth_date,
    u[CAST(c_custkey % 7 + 1 AS INT)] AS uf
  FROM customer, g
),
noisy AS (
  SELECT rec_id + 1000000 AS tgt_id,
    CASE WHEN rec_id % 5 = 0 THEN substr(full_name, 1, 2) || substr(full_name, 4, 1) || substr(full_name, 3, 1) || substr(full_name, 5)
         WHEN rec_id % 5 = 1 THEN substr(full_name, 1, 3) || substr(full_name, 5) ELSE full_name END AS full_name,
    CASE WHEN rec_id % 9 <> 4 THEN mother_name END AS mother_name, birth_date, uf
  FROM people WHERE rec_id % 10 < 7
)"""

FIELDS = {"tgt_id": "long", "full_name": "text", "mother_name": "text", "birth_date": "keyword", "uf": "keyword"}


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with a birth date: without it, a rule on it doesn't take part."""
    return people(spark, sf_dir).where("birth_date is not null")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with a mother's name."""
    return people(spark, sf_dir).where("mother_name is not null")


def _index(spark: SparkSession, sf_dir: str, **types) -> TextIndex:
    return TextIndex.simple(noisy(spark, sf_dir), FIELDS | types, "tgt_id")


def _rule(column: str, clause_type: str = "should", query_type: str = "match", similarity: str = "exact", weight: float = 1.0, **more) -> dict:
    return {"source_column": column, "target_column": more.pop("target", column), "es_clause_type": clause_type, "query_type": query_type, "similarity": similarity, "weight": weight} | more


def _spec(*phases: dict, **more) -> LinkageSpec:
    base = {"strong_match_score_threshold": 0.0, "candidate_limit": 10}
    phases = [base | {"phase_name": f"phase_{i}"} | p for i, p in enumerate(phases, 1)]
    return LinkageSpec("people", "rec_id", "noisy", "tgt_id", phases, **more)


def _found(spark: SparkSession, sf_dir: str, phase: dict, index: TextIndex | None = None, source: DataFrame | None = None, on_empty: str = "match_all", **more) -> DataFrame:
    """Candidates as ``(rec_id, tgt_id)``."""
    spec = _spec(phase, **more)
    source = people(spark, sf_dir) if source is None else source
    pairs = candidate_pairs(source, index or _index(spark, sf_dir), spec, spec.blocking_phases[0], on_empty)
    return pairs.select(F.col("source_rec_id").alias("rec_id"), F.col("candidate_tgt_id").cast("long").alias("tgt_id"), "es_score")


#: As in their SQL, no hit is left out.
ALL = UNLIMITED


# --- scans, sinks and projections ------------------------------------------------------


@query("SELECT * FROM nation")
def scan_all(spark, sf_dir):
    return TableSource(spark, Storage(sf_dir)).read("nation.parquet")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_slice(spark, sf_dir):
    return TableSource(spark, Storage(sf_dir)).read("orders.parquet", o_orderstatus="F").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def discover_partitions(spark, sf_dir):
    values = TableSource(spark, Storage(sf_dir)).partitions("orders.parquet", "o_orderpriority")
    return spark.createDataFrame([(v,) for v in values], "value string")


@query("SELECT 'l_comment_x' AS missing")
def validate_source_schema(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in TableSource(spark, Storage(sf_dir)).missing("lineitem.parquet", ["l_orderkey", "l_comment_x"])], "missing string")


@query("SELECT o_orderkey, o_orderdate FROM orders")
def schema_projection(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")


@query()
def sample_seeded(spark, sf_dir):
    return TableSource(spark, Storage(sf_dir)).sample("orders.parquet", 0.1, 42)


@query("SELECT c_custkey AS id, c_acctbal AS a, NULL::VARCHAR AS b FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def phase_union_merge(spark, sf_dir):
    one = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"))
    two = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("b"))
    return union_phases([one, None, two])


# --- cleaning --------------------------------------------------------------------------


@query("SELECT c_custkey, upper(trim('  ' || c_name || ' ')) AS c_name, lower(c_mktsegment) AS segment FROM customer")
def clean_trim_case(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), "c_mktsegment")
    return clean(df, [ColumnClean("c_name", trim=True, case="upper"), ColumnClean("c_mktsegment", cleaned_name="segment", case="lower")])


@query("SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN o_orderpriority END AS o_orderpriority FROM orders")
def clean_invalid_to_null(spark, sf_dir):
    return clean(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), [ColumnClean("o_orderpriority", invalid_values=["1-URGENT", "5-LOW"])])


@query("SELECT p_partkey, nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_name END), '') AS p_name FROM part")
def clean_empty_null(spark, sf_dir):
    df = _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_name")).alias("p_name"))
    return clean(df, [ColumnClean("p_name", trim=True, empty_to_null=True)])


@query("SELECT s_suppkey, translate(s_name, '#0[]&', '') AS s_name FROM supplier")
def clean_remove_chars(spark, sf_dir):
    return clean(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), [ColumnClean("s_name", remove_characters="#0[]&")])


@query("SELECT c_custkey, try_cast(substr(c_name, 10, 9) AS INTEGER) AS serial, substr(c_name, 1, 4) AS head FROM customer")
def clean_truncate_cast(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", 10, 9).alias("serial"), F.col("c_name").alias("head"))
    return clean(df, [ColumnClean("serial", cast="int"), ColumnClean("head", truncate=4)])


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def clean_strip_accents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", strip_accents(F.col("text")).alias("plain"))


@query("SELECT doc_id, substr(lower(strip_accents(translate(trim(text), '.,;!', ''))), 1, 80) AS headline FROM documents")
def clean_chain(spark, sf_dir):
    df = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(df, [ColumnClean("text", cleaned_name="headline", trim=True, remove_characters=".,;!", strip_accents=True, case="lower", truncate=80)])


# --- similarity and scores ---------------------------------------------------------------

_TRUE_PAIRS = "p JOIN noisy n ON n.tgt_id = p.rec_id + 1000000"


def _true_pairs(spark, sf_dir) -> DataFrame:
    n = noisy(spark, sf_dir)
    return people(spark, sf_dir).join(n.select("tgt_id", *(F.col(c).alias(f"t_{c}") for c in n.columns if c != "tgt_id")), F.col("tgt_id") == F.col("rec_id") + 1000000)


@query(f"WITH {PEOPLE_SQL} SELECT rec_id, CASE WHEN p.mother_name = n.mother_name THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sim FROM people {_TRUE_PAIRS}")
def sim_exact(spark, sf_dir):
    return _true_pairs(spark, sf_dir).select("rec_id", exact(F.col("mother_name"), F.col("t_mother_name")).alias("sim"))


@query(f"""WITH {PEOPLE_SQL} SELECT rec_id, CASE WHEN length(p.full_name) <> length(n.full_name) THEN 0.0::DOUBLE
  ELSE round(1 - hamming(p.full_name, n.full_name)::DOUBLE / length(p.full_name), 6) END AS sim FROM people {_TRUE_PAIRS}""")
def sim_hamming(spark, sf_dir):
    return _true_pairs(spark, sf_dir).select("rec_id", F.round(hamming(F.col("full_name"), F.col("t_full_name")), 6).alias("sim"))


@query(f"WITH {PEOPLE_SQL} SELECT rec_id, round(jaro_winkler_similarity(p.full_name, n.full_name), 6) AS sim FROM people {_TRUE_PAIRS}")
def sim_jaro_winkler(spark, sf_dir):
    return _true_pairs(spark, sf_dir).select("rec_id", F.round(jaro_winkler(F.col("full_name"), F.col("t_full_name")), 6).alias("sim"))


def _scored(spark, sf_dir, rules, **more):
    rules = [Rule(**r) for r in rules]
    return score_pairs(_true_pairs(spark, sf_dir), rules, lambda c: F.col(c), lambda c: F.col(f"t_{c}"), **more)


_JW = "jaro_winkler_similarity(p.full_name, n.full_name)"
_MOM = "coalesce((p.mother_name = n.mother_name)::INT, 0)"
_MOM_NULL = "(p.mother_name IS NULL OR n.mother_name IS NULL)"


@query(f"WITH {PEOPLE_SQL} SELECT rec_id, round(0.6 * {_JW} + 0.4 * {_MOM}, 6) AS match_score, round({_JW}, 6) AS sim_full_name FROM people {_TRUE_PAIRS}")
def score_weighted(spark, sf_dir):
    rules = [_rule("full_name", similarity="jaro_winkler", weight=0.6), _rule("mother_name", weight=0.4)]
    return _scored(spark, sf_dir, rules).select("rec_id", "match_score", "sim_full_name")


@query(f"""WITH {PEOPLE_SQL} SELECT rec_id, round(CASE WHEN {_MOM_NULL} THEN least(1.0, (0.6 * {_JW} - 0.05) / 1.0) ELSE 0.6 * {_JW} + 0.4 * {_MOM} END, 6) AS match_score FROM people {_TRUE_PAIRS}""")
def score_null_penalty(spark, sf_dir):
    rules = [_rule("full_name", similarity="jaro_winkler", weight=0.6), _rule("mother_name", weight=0.4, penalty=0.05)]
    return _scored(spark, sf_dir, rules).select("rec_id", "match_score")


@query(f"""WITH {PEOPLE_SQL} SELECT rec_id, round(CASE WHEN {_MOM_NULL} THEN least(1.0, (1.0 * (p.uf = n.uf)::INT - 5.0) / 2.0) ELSE ((p.uf = n.uf)::INT + {_MOM}) / 2.0 END, 6)::DOUBLE AS match_score FROM people {_TRUE_PAIRS}""")
def score_negative(spark, sf_dir):
    rules = [_rule("uf", weight=1.0), _rule("mother_name", weight=1.0, penalty=5.0)]
    return _scored(spark, sf_dir, rules).select("rec_id", "match_score")


@query(f"""WITH {PEOPLE_SQL} SELECT rec_id, 2 AS n_rules, round(0.5 * (p.uf = n.uf)::INT + CASE WHEN {_MOM_NULL} THEN 0 ELSE 0.5 * {_MOM} END, 6)::DOUBLE AS raw_score FROM people {_TRUE_PAIRS}""")
def score_debug_json(spark, sf_dir):
    out = _scored(spark, sf_dir, [_rule("uf", weight=0.5), _rule("mother_name", weight=0.5)], debug=True)
    parsed = F.from_json("score_debug_json", "raw_score double, rules array<struct<current_similarity: double>>")
    return out.select("rec_id", F.size(parsed["rules"]).alias("n_rules"), F.round(parsed["raw_score"], 6).alias("raw_score"))


@query("SELECT o_orderkey, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS match_score FROM orders WHERE CAST(o_orderkey % 100 AS DOUBLE) / 100 >= 0.9")
def threshold_inclusive(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100).cast("double") / 100).alias("match_score"))
    return strong(df, 0.9)


# --- blocking --------------------------------------------------------------------------------

_TOP = "SELECT rec_id, tgt_id FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(score, 6) DESC, CAST(tgt_id AS VARCHAR)) AS k FROM hits) WHERE k <= {k}"
_TOKENS_SQL = """
nt AS (SELECT tgt_id, unnest(string_split(lower({c}), ' ')) AS term FROM noisy WHERE {c} IS NOT NULL),
np AS (SELECT tgt_id, term, count(*) AS tf FROM nt GROUP BY ALL),
nd AS (SELECT tgt_id, count(*) AS dl FROM nt GROUP BY ALL),
ns AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM nd),
df AS (SELECT term, count(*) AS df FROM np GROUP BY ALL),
w AS (SELECT np.tgt_id, np.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s
      FROM np JOIN nd USING (tgt_id) JOIN df USING (term), ns),
pt AS (SELECT rec_id, unnest(string_split(lower({c}), ' ')) AS term FROM people WHERE {c} IS NOT NULL)"""


@query(f"WITH {PEOPLE_SQL}, hits AS (SELECT p.rec_id, n.tgt_id, 0 AS score FROM people p JOIN noisy n ON p.uf = n.uf AND p.birth_date = n.birth_date) " + _TOP.format(k=5))
def block_term_must(spark, sf_dir, of=dated):
    phase = {"rules": [_rule("uf", "must", "term"), _rule("birth_date", "must", "term")], "candidate_limit": 5}
    return _found(spark, sf_dir, phase, source=of(spark, sf_dir)).select("rec_id", "tgt_id")


@query(f"WITH {PEOPLE_SQL}, {_TOKENS_SQL.format(c='mother_name')}, hits AS (SELECT rec_id, tgt_id, sum(s) AS score FROM pt JOIN w USING (term) GROUP BY ALL) " + _TOP.format(k=3))
def block_match_tokens(spark, sf_dir, of=named):
    return _found(spark, sf_dir, {"rules": [_rule("mother_name", "must")], "candidate_limit": 3}, source=of(spark, sf_dir)).select("rec_id", "tgt_id")


@query(f"""WITH {PEOPLE_SQL}, {_TOKENS_SQL.format(c='full_name')}, sh AS (SELECT rec_id, tgt_id, sum(s) AS s FROM pt JOIN w USING (term) GROUP BY ALL),
kd AS (SELECT birth_date, count(*) AS df FROM noisy WHERE birth_date IS NOT NULL GROUP BY 1), kn AS (SELECT sum(df) AS n FROM kd),
hits AS (SELECT p.rec_id, n.tgt_id, ln(1 + (kn.n - df + 0.5) / (df + 0.5)) / 2.2 + coalesce(sh.s, 0) AS score
  FROM people p JOIN noisy n ON p.birth_date = n.birth_date JOIN kd ON kd.birth_date = n.birth_date LEFT JOIN sh ON sh.rec_id = p.rec_id AND sh.tgt_id = n.tgt_id, kn)
SELECT rec_id, tgt_id, round(score, 4) AS es_score FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(score, 6) DESC, CAST(tgt_id AS VARCHAR)) AS k FROM hits) WHERE k <= 4""")
def block_should_optional(spark, sf_dir, of=dated):
    phase = {"rules": [_rule("birth_date", "must", "term"), _rule("full_name", "should")], "candidate_limit": 4}
    return _found(spark, sf_dir, phase, source=of(spark, sf_dir)).withColumn("es_score", F.round("es_score", 4))


@query(f"WITH {PEOPLE_SQL}, hits AS (SELECT p.rec_id, n.tgt_id, 0 AS score FROM people p JOIN noisy n ON p.uf = n.uf) SELECT rec_id, tgt_id, 0.0::DOUBLE AS es_score FROM ({_TOP.format(k=2)})")
def block_filter_noscore(spark, sf_dir):
    return _found(spark, sf_dir, {"rules": [_rule("uf", "filter", "term")], "candidate_limit": 2})


@query(f"WITH {PEOPLE_SQL}, hits AS (SELECT p.rec_id, n.tgt_id, 0 AS score FROM people p JOIN noisy n ON p.birth_date = n.birth_date AND p.uf <> n.uf) " + _TOP.format(k=5))
def block_must_not(spark, sf_dir, of=dated):
    phase = {"rules": [_rule("birth_date", "must", "term"), _rule("uf", "must_not", "term")], "candidate_limit": 5}
    return _found(spark, sf_dir, phase, source=of(spark, sf_dir)).select("rec_id", "tgt_id")


@query(f"WITH {PEOPLE_SQL}, hits AS (SELECT p.rec_id, n.tgt_id, 0 AS score FROM people p JOIN noisy n ON p.uf = n.uf AND (p.rec_id % 2 = 1 OR p.mother_name = n.mother_name)) " + _TOP.format(k=3))
def block_blank_skipped(spark, sf_dir, of=None):
    source = people(spark, sf_dir).withColumn("mother_name", F.when(F.col("rec_id") % 2 == 1, "  ").otherwise(F.col("mother_name")))
    source = source if of else source.where("mother_name is not null")
    phase = {"rules": [_rule("uf", "filter", "term"), _rule("mother_name", "filter", "term")], "candidate_limit": 3}
    return _found(spark, sf_dir, phase, index=_index(spark, sf_dir, mother_name="keyword"), source=source).select("rec_id", "tgt_id")


@query(f"WITH {PEOPLE_SQL}, hits AS (SELECT p.rec_id, n.tgt_id, 0 AS score FROM people p, (SELECT tgt_id FROM noisy ORDER BY CAST(tgt_id AS VARCHAR) LIMIT 2) n WHERE p.mother_name IS NULL) SELECT rec_id, tgt_id, 1.0::DOUBLE AS es_score FROM hits")
def block_match_all_fallback(spark, sf_dir):
    source = people(spark, sf_dir).where("mother_name is null")
    return _found(spark, sf_dir, {"rules": [_rule("mother_name", "must")], "candidate_limit": 2}, source=source)


@query(f"""WITH {PEOPLE_SQL}, pre AS (SELECT rec_id, substr(full_name, 1, 5) AS p FROM people), hits AS (SELECT pre.rec_id, n.tgt_id, 1 AS score FROM pre JOIN noisy n ON starts_with(n.full_name, p)) """ + _TOP.format(k=4))
def block_prefix(spark, sf_dir):
    source = people(spark, sf_dir).withColumn("full_name", F.substring("full_name", 1, 5))
    return _found(spark, sf_dir, {"rules": [_rule("full_name", "must", "prefix")], "candidate_limit": 4}, index=_index(spark, sf_dir, full_name="keyword"), source=source).select("rec_id", "tgt_id")


@query(f"""WITH {PEOPLE_SQL}, hits AS (SELECT p.rec_id, n.tgt_id FROM people p JOIN noisy n
  ON contains(' ' || lower(n.full_name) || ' ', ' ' || lower(substr(p.full_name, position(' ' IN p.full_name) + 1)) || ' ') AND p.uf = n.uf AND p.birth_date = n.birth_date) SELECT * FROM hits""")
def block_phrase(spark, sf_dir, of=dated):
    source = of(spark, sf_dir).withColumn("full_name", F.expr("substring(full_name, instr(full_name, ' ') + 1)"))
    phase = {"rules": [_rule("full_name", "must", "match_phrase"), _rule("uf", "filter", "term"), _rule("birth_date", "filter", "term")], "candidate_limit": ALL}
    return _found(spark, sf_dir, phase, source=source).select("rec_id", "tgt_id")


@query(f"""WITH {PEOPLE_SQL}, q AS (SELECT DISTINCT unnest(string_split(lower(full_name), ' ')) AS q FROM people), t AS (SELECT DISTINCT unnest(string_split(lower(full_name), ' ')) AS t FROM noisy),
x AS (SELECT q, t FROM q, t WHERE damerau_levenshtein(q, t) <= CASE WHEN length(q) <= 2 THEN 0 WHEN length(q) <= 5 THEN 1 ELSE 2 END),
p1 AS (SELECT rec_id, uf, birth_date, unnest(string_split(lower(full_name), ' ')) AS q FROM people), n1 AS (SELECT tgt_id, uf, birth_date, unnest(string_split(lower(full_name), ' ')) AS t FROM noisy)
SELECT DISTINCT rec_id, tgt_id FROM p1 JOIN x USING (q) JOIN n1 ON n1.t = x.t AND n1.uf = p1.uf AND n1.birth_date = p1.birth_date""")
def block_fuzzy_auto(spark, sf_dir, of=dated):
    phase = {"rules": [_rule("full_name", "must", is_fuzzy=True), _rule("uf", "filter", "term"), _rule("birth_date", "filter", "term")], "candidate_limit": ALL}
    return _found(spark, sf_dir, phase, source=of(spark, sf_dir)).select("rec_id", "tgt_id")


@query(f"WITH {PEOPLE_SQL}, {_TOKENS_SQL.format(c='full_name')}, hits AS (SELECT rec_id, tgt_id, 2 * sum(s) AS score FROM pt JOIN w USING (term) GROUP BY ALL) SELECT rec_id, tgt_id, round(score, 4) AS es_score FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(score, 6) DESC, CAST(tgt_id AS VARCHAR)) AS k FROM hits) WHERE k <= 3")
def block_topk_bm25_boost(spark, sf_dir):
    return _found(spark, sf_dir, {"rules": [_rule("full_name", "should", boost=2.0)], "candidate_limit": 3}).withColumn("es_score", F.round("es_score", 4))


# --- filters -------------------------------------------------------------------------------------


def _orders_index(spark, sf_dir) -> TextIndex:
    fields = {"o_orderkey": "long", "o_orderstatus": "keyword", "o_totalprice": "double", "o_orderdate": "date", "o_orderpriority": "keyword"}
    return TextIndex.simple(_t(spark, sf_dir, "orders"), fields, "o_orderkey")


def _clause(body: dict):
    def run(spark, sf_dir):
        index = _orders_index(spark, sf_dir)
        return index.docs.where(clause(index, body)).select("o_orderkey")

    return run


for _name, _body, _where in (
    ("filter_static_term", {"term": {"o_orderstatus": "P"}}, "o_orderstatus = 'P'"),
    ("filter_range", {"range": {"o_totalprice": {"gte": 1000, "lt": 50000}}}, "o_totalprice >= 1000 AND o_totalprice < 50000"),
    ("filter_range_date", {"range": {"o_orderdate": {"gt": "1996-06-30"}}}, "o_orderdate > TIMESTAMP '1996-06-30'"),
    ("filter_query_terms_exists", {"bool": {"filter": [{"terms": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}}, {"exists": {"field": "o_orderdate"}}], "must_not": [{"ids": {"values": ["1", "2", "3"]}}]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate IS NOT NULL AND o_orderkey NOT IN (1, 2, 3)"),
    ("filter_wildcard_prefix", {"bool": {"should": [{"wildcard": {"o_orderpriority": "*-L?W"}}, {"prefix": {"o_orderpriority": "2-"}}]}}, "o_orderpriority LIKE '%-L_W' OR o_orderpriority LIKE '2-%'"),
):
    QUERIES[_name], ORACLES[_name] = _clause(_body), f"SELECT o_orderkey FROM orders WHERE {_where}"


@query(f"WITH {PEOPLE_SQL}, hits AS (SELECT p.rec_id, n.tgt_id, 0 AS score FROM people p JOIN noisy n ON p.birth_date = n.birth_date AND p.uf = n.uf) " + _TOP.format(k=5))
def filter_column_dynamic(spark, sf_dir, of=dated):
    phase = {"rules": [_rule("birth_date", "must", "term")], "candidate_limit": 5, "indexed_dataset_filter": [{"column": {"source_column": "uf", "target_column": "uf"}}]}
    return _found(spark, sf_dir, phase, source=of(spark, sf_dir)).select("rec_id", "tgt_id")


@query(f"WITH {PEOPLE_SQL}, hits AS (SELECT p.rec_id, n.tgt_id, 0 AS score FROM people p JOIN noisy n ON p.birth_date = n.birth_date AND p.uf = n.uf) " + _TOP.format(k=5))
def filter_column_dynamic_date(spark, sf_dir):
    """A dynamic column that the index holds as a date."""
    phase = {"rules": [_rule("uf", "must", "term")], "candidate_limit": 5, "indexed_dataset_filter": [{"column": {"source_column": "birth_date", "target_column": "birth_date"}}]}
    return _found(spark, sf_dir, phase, _index(spark, sf_dir, birth_date="date")).select("rec_id", "tgt_id")


@query(f"WITH {PEOPLE_SQL}, hits AS (SELECT p.rec_id, n.tgt_id, 0 AS score FROM people p JOIN noisy n ON p.birth_date = n.birth_date AND n.uf = 'SP' AND n.tgt_id >= 1000020) " + _TOP.format(k=5))
def filter_merge(spark, sf_dir, of=dated):
    phase = {"rules": [_rule("birth_date", "must", "term")], "candidate_limit": 5, "indexed_dataset_filter": [{"range": {"field": "tgt_id", "gte": 1000020, "lt": None}}]}
    return _found(spark, sf_dir, phase, source=of(spark, sf_dir), indexed_dataset_filter=[{"term": {"uf": "SP"}}]).select("rec_id", "tgt_id")


@query(f"""WITH {PEOPLE_SQL}, {_TOKENS_SQL.format(c='mother_name')}, s AS (SELECT rec_id, tgt_id, sum(s) AS s FROM pt JOIN w USING (term) GROUP BY ALL),
hits AS (SELECT p.rec_id, n.tgt_id, coalesce(s.s, 0) AS score FROM people p JOIN noisy n ON p.uf = n.uf LEFT JOIN s ON s.rec_id = p.rec_id AND s.tgt_id = n.tgt_id) """ + _TOP.format(k=40))
def filter_padding(spark, sf_dir):
    """Should rules under a filter: documents without a hit fill the list."""
    phase = {"rules": [_rule("mother_name", "should")], "candidate_limit": 40, "indexed_dataset_filter": [{"column": {"source_column": "uf", "target_column": "uf"}}]}
    return _found(spark, sf_dir, phase).select("rec_id", "tgt_id")


# --- the same over all people: a rule without a value takes no part ------------------------------

_DATE, _ANY_DATE = "p.birth_date = n.birth_date", "(p.birth_date IS NULL OR p.birth_date = n.birth_date)"
for _name, _old, _new in (
    ("block_term_must", _DATE, _ANY_DATE),
    ("block_must_not", _DATE, _ANY_DATE),
    ("block_phrase", _DATE, _ANY_DATE),
    ("block_fuzzy_auto", "n1.birth_date = p1.birth_date", "(p1.birth_date IS NULL OR n1.birth_date = p1.birth_date)"),
    ("filter_column_dynamic", _DATE, _ANY_DATE),
    ("filter_merge", _DATE, _ANY_DATE),
    ("block_should_optional", "sh.tgt_id = n.tgt_id, kn)", "sh.tgt_id = n.tgt_id, kn UNION ALL SELECT rec_id, tgt_id, s FROM sh JOIN people USING (rec_id) WHERE birth_date IS NULL)"),
    ("block_match_tokens", "JOIN w USING (term) GROUP BY ALL)", "JOIN w USING (term) GROUP BY ALL UNION ALL SELECT rec_id, n.tgt_id, 1 FROM people, (SELECT tgt_id FROM noisy ORDER BY CAST(tgt_id AS VARCHAR) LIMIT 3) n WHERE mother_name IS NULL)"),
    ("block_blank_skipped", "p.rec_id % 2 = 1 OR", "p.rec_id % 2 = 1 OR p.mother_name IS NULL OR"),
):
    assert ORACLES[_name].count(_old) == 1, _name
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = partial(QUERIES[_name], of=people), ORACLES[_name].replace(_old, _new)


# --- cascade, index and clusters --------------------------------------------------------------------

FIRST = {"phase_name": "exact", "candidate_limit": ALL, "strong_match_score_threshold": 0.99, "rules": [
    _rule("full_name", "filter", "term", "exact", 0.5), _rule("mother_name", "filter", "term", "exact", 0.3, penalty=0.1), _rule("birth_date", "filter", "term", "exact", 0.2)]}
SECOND = {"phase_name": "similar", "candidate_limit": ALL, "strong_match_score_threshold": 0.9, "rules": [
    _rule("uf", "filter", "term", "hamming", 0.1), _rule("birth_date", "filter", "term", "hamming", 0.2), _rule("full_name", "should", "term", "jaro_winkler", 0.5), _rule("mother_name", "should", "term", "jaro_winkler", 0.2, penalty=0.05)]}
DISABLED = SECOND | {"phase_name": "off", "enabled": False, "strong_match_score_threshold": 0.1}

_KEYWORDS = {"full_name": "keyword", "mother_name": "keyword"}
_CASCADE_SQL = f"""{PEOPLE_SQL},
a AS (SELECT p.rec_id, n.tgt_id, 1.0::DOUBLE AS match_score, 'exact' AS phase_match FROM people p JOIN noisy n ON p.full_name = n.full_name AND p.mother_name = n.mother_name AND p.birth_date = n.birth_date),
b0 AS (SELECT p.rec_id, n.tgt_id, round(CASE WHEN {_MOM_NULL} THEN least(1.0, 0.1 + 0.2 + 0.5 * {_JW} - 0.05)
    ELSE 0.1 + 0.2 + 0.5 * {_JW} + 0.2 * jaro_winkler_similarity(p.mother_name, n.mother_name) END, 6) AS match_score
  FROM people p JOIN noisy n ON p.uf = n.uf AND p.birth_date = n.birth_date WHERE p.rec_id NOT IN (SELECT rec_id FROM a)),
b AS (SELECT rec_id, tgt_id, match_score, 'similar' AS phase_match FROM b0 WHERE match_score >= 0.9),
linked AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def _linked(spark, sf_dir, *phases) -> DataFrame:
    results = cascade(people(spark, sf_dir), _index(spark, sf_dir, **_KEYWORDS), _spec(*phases))
    columns = [F.col("source_rec_id").alias("rec_id"), F.col("candidate_tgt_id").cast("long").alias("tgt_id"), "match_score", "phase_match"]
    return union_phases([r.linked.select(*columns) for r in results if r.linked is not None])


_USABLE = _CASCADE_SQL.replace("FROM people p JOIN noisy n ON p.uf = n.uf AND p.birth_date = n.birth_date WHERE", "FROM people p JOIN noisy n ON p.uf = n.uf AND p.birth_date = n.birth_date WHERE p.mother_name IS NOT NULL AND")


@query(f"WITH {_USABLE} SELECT * FROM linked")
def cascade_two_phase(spark, sf_dir):
    return _linked(spark, sf_dir, FIRST, SECOND)


@query(f"WITH {_USABLE} SELECT * FROM a")
def cascade_disabled_phase(spark, sf_dir):
    return _linked(spark, sf_dir, FIRST, DISABLED)


@query(f"WITH {_USABLE} SELECT rec_id, full_name FROM people WHERE rec_id NOT IN (SELECT rec_id FROM a)")
def cascade_remaining(spark, sf_dir):
    spec = _spec(FIRST)
    linked = link_phase(people(spark, sf_dir), _index(spark, sf_dir, **_KEYWORDS), spec, spec.blocking_phases[0])
    return remaining(people(spark, sf_dir), linked, "rec_id").select("rec_id", "full_name")


@query("SELECT * FROM (VALUES ('exact', 'completed'), ('all', 'completed'), ('similar', 'exhausted')) t(phase, status)")
def cascade_exhausted(spark, sf_dir):
    every = {"phase_name": "all", "candidate_limit": 1, "rules": [_rule("uf", "filter", "term", "exact", 1.0)]}
    results = cascade(people(spark, sf_dir), _index(spark, sf_dir, **_KEYWORDS), _spec(FIRST, every, SECOND))
    return spark.createDataFrame([(r.phase, r.status) for r in results], "phase string, status string")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier WHERE s_suppkey % 2 = 0")
def index_upsert(spark, sf_dir):
    return _saved(spark, sf_dir, True)


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier WHERE s_suppkey % 2 = 0")
def index_append_dup(spark, sf_dir):
    return _saved(spark, sf_dir, False)


def _saved(spark, sf_dir, upsert: bool) -> DataFrame:
    import uuid

    from kinweave.plans.staging import shared_root

    path = f"{shared_root(spark)}/kinweave/index-{uuid.uuid4().hex}"
    old = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    new = old.where("s_suppkey % 2 = 0").withColumn("s_name", F.upper("s_name"))
    for df in (old, new):
        TextIndex.simple(df, {"s_suppkey": "long", "s_name": "text"}, "s_suppkey").save(path, upsert)
    return TextIndex.load(spark, path).docs.select("s_suppkey", "s_name")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS INTEGER) AS n_terms, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), ' ') AS terms FROM documents")
def analyze_standard(spark, sf_dir):
    terms = standard(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(terms).alias("n_terms"), F.array_join(terms, " ").alias("terms"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{M}\p{N}]+'), ' ') AS terms FROM documents")
def analyze_folding(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(folding(F.col("text")), " ").alias("terms"))


DEDUP = DedupSpec("rec_id", "tgt_id", "entity")


def _chains(spark, sf_dir) -> DataFrame:
    """Pairs of orders of one customer, next to each other by key."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = _t(spark, sf_dir, "orders")
    both = orders.select((F.col("o_orderkey") + 10_000_000).cast("string").alias("tgt_id"), (F.lag("o_orderkey").over(w) + 10_000_000).cast("string").alias("rec_id"))
    return both.where("rec_id is not null").select("rec_id", "tgt_id")


_CHAIN_SQL = """
e AS (SELECT CAST(o_orderkey + 10000000 AS VARCHAR) AS tgt_id, CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 10000000 AS VARCHAR) AS rec_id, o_custkey FROM orders),
pairs AS (SELECT rec_id, tgt_id FROM e WHERE rec_id IS NOT NULL),
named AS (SELECT CAST(o_orderkey + 10000000 AS VARCHAR) AS id, CAST(min(o_orderkey + 10000000) OVER (PARTITION BY o_custkey) AS VARCHAR) AS cluster_id, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


@query(f"WITH {_CHAIN_SQL} SELECT DISTINCT rec_id AS id FROM pairs UNION SELECT tgt_id FROM pairs")
def cluster_vertices(spark, sf_dir):
    return vertices(_chains(spark, sf_dir), DEDUP)


@query(f"WITH {_CHAIN_SQL} SELECT id, cluster_id FROM named WHERE n > 1")
def cluster_components(spark, sf_dir):
    return clusters(_chains(spark, sf_dir), DEDUP)


@query(f"WITH {_CHAIN_SQL} SELECT rec_id, tgt_id, cluster_id AS entity FROM pairs JOIN named ON id = rec_id")
def cluster_join_back(spark, sf_dir):
    return deduplicate(_chains(spark, sf_dir), DEDUP)


@query(f"WITH {_USABLE} SELECT 's:' || rec_id AS id, min('s:' || rec_id) OVER (PARTITION BY tgt_id) AS cluster_id FROM a UNION SELECT 't:' || tgt_id, min('s:' || rec_id) OVER (PARTITION BY tgt_id) FROM a")
def cluster_namespaced(spark, sf_dir):
    pairs = _linked(spark, sf_dir, FIRST).select("rec_id", "tgt_id")
    return clusters(pairs, DEDUP, namespace_ids=True)


@query(f"WITH {_USABLE} SELECT * FROM linked")
def workunit_partitioned_linkage(spark, sf_dir):
    """The cascade by state, one work unit each, read back from the phase sink."""
    import uuid

    from kinweave.plans.run import link_frame
    from kinweave.plans.spec import Execution
    from kinweave.plans.staging import shared_root

    out = f"{shared_root(spark)}/kinweave/out-{uuid.uuid4().hex}"
    spec = _spec(FIRST, SECOND, workflow_name="people_noisy")
    run = Execution(job_id="units", partition_column="uf", filter_partitions=tuple(STATES))
    sink = link_frame(people(spark, sf_dir), _index(spark, sf_dir, **_KEYWORDS), spec, Storage(out), run)
    got = sink.read("people_noisy")
    return got.select(F.col("source_rec_id").alias("rec_id"), F.col("candidate_tgt_id").cast("long").alias("tgt_id"), "match_score", "phase_match")


@query(f"WITH {_USABLE} SELECT linked.* FROM linked JOIN people USING (rec_id) WHERE people.uf = 'SP'")
def workunit_resume(spark, sf_dir):
    """A job whose state still has a unit that is no longer asked for: only the others run."""
    import json
    import uuid

    from kinweave.plans.run import Files, link_frame
    from kinweave.plans.spec import Execution
    from kinweave.plans.staging import shared_root

    out = f"{shared_root(spark)}/kinweave/out-{uuid.uuid4().hex}"
    Files(f"{out}-audit/people_noisy/units", spark).write("state.json", json.dumps({"units": {"uf_BA": "PENDING", "uf_SP": "FAILED"}}))
    spec = _spec(FIRST, SECOND, workflow_name="people_noisy")
    run = Execution(job_id="units", partition_column="uf", filter_partitions=("SP",), audit_log_path=f"{out}-audit")
    got = link_frame(people(spark, sf_dir), _index(spark, sf_dir, **_KEYWORDS), spec, Storage(out), run).read("people_noisy")
    return got.select(F.col("source_rec_id").alias("rec_id"), F.col("candidate_tgt_id").cast("long").alias("tgt_id"), "match_score", "phase_match")


@query(f"WITH {_USABLE}, c AS (SELECT *, least(min(CAST(rec_id AS VARCHAR)) OVER (PARTITION BY tgt_id), CAST(tgt_id AS VARCHAR)) AS m FROM a) SELECT rec_id, tgt_id, match_score, phase_match, m AS entity FROM c")
def flagship(spark, sf_dir):
    """Linkage by exact keys, then entities."""
    return deduplicate(_linked(spark, sf_dir, FIRST), DEDUP)
