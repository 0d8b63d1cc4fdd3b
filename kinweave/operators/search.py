"""Blocking search: the top-k boolean text join of source rows with an index.

Source rows that read alike are one query, and documents that read alike one class, which counts
as often in statistics as it has documents. Each rule becomes a relation of hits from an
equi-join on terms, values, prefixes or expanded terms, and on the dynamic columns. Hits are
aggregated by query and class into a mask of rules and a score; the boolean logic is a
comparison of masks, and windows keep the best classes, then the best of their documents.

Required whole values (``must`` or ``filter`` rules on keyword, number, date or boolean fields)
are further columns of these joins. Documents that have them and no other hit all have one score, so
the first ones by id of each group of such values are kept as a list, and a query's own hits are
merged with its group's list next to the source row: such pairs are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.filters import dynamic_columns, static_predicate
from kinweave.plans.spec import Filter, Phase, Rule, SpecError
from kinweave.plans.staging import staged
from kinweave.sources.index import COPIES, ID, TextIndex

K1, B = 1.2, 0.75
#: Index terms that a fuzzy query term may stand for, as search engines have it.
MAX_EXPANSIONS = 50
#: Letters of a term up to which it is matched with edits; longer ones are matched as they are.
FUZZY_LETTERS = 255
#: A limit that keeps every hit, and the longest lists of documents.
UNLIMITED, LISTED = 2**31 - 1, 1024
_CLAUSES, _QUERIES = ("must", "filter", "must_not", "should"), ("match", "term", "match_phrase", "prefix")


def active(c: Column, dtype: str) -> Column:
    """Whether a source value takes part in retrieval: blank text and null don't."""
    return (c.isNotNull() & (F.trim(c) != "")) if dtype == "string" else c.isNotNull()


def _idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def _bm25(idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf * tf / (tf + K1 * (1 - B + B * dl / avgdl))


def deletions(term: Column, edits: int) -> Column:
    """The term and all results of deleting up to ``edits`` (1 or 2) characters."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    first = F.when(F.length(term) > 0, one(term)).otherwise(F.array().cast("array<string>"))
    if edits == 1:
        return F.array_distinct(F.concat(F.array(term), first))
    second = F.flatten(F.transform(first, lambda t: F.when(F.length(t) > 0, one(t)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(term), first, second))


def _swaps(a: Column) -> Column:
    """All results of exchanging two neighbours."""
    pair = F.sequence(F.lit(1), F.length(a) - 1)
    swapped = F.transform(pair, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))))
    return F.when(F.length(a) > 1, swapped).otherwise(F.array().cast("array<string>"))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edits with transpositions as one, up to ``most`` (2 at most); else null."""
    plain = F.levenshtein(a, b)
    if most == 1:
        return F.when(plain <= 1, plain).when(F.array_contains(_swaps(a), b), 1)
    after = F.array_min(F.transform(_swaps(a), lambda s: F.when(s == b, 0).when(F.levenshtein(s, b) <= 1, 1).when(F.array_contains(_swaps(s), b), 1)))
    best = F.least(plain, after + 1)
    return F.when(best <= 2, best)


def auto_edits(length: Column) -> Column:
    """Edits that a term of a length may have: 0 to two letters, 1 to five, then 2."""
    return F.when(length <= 2, 0).when(length <= 5, 1).otherwise(2)


def expand_fuzzy(queries: DataFrame, terms: DataFrame, limit: int = MAX_EXPANSIONS) -> DataFrame:
    """``(q, term, edits)``: index terms within the automatic number of edits of ``q``.

    Both dictionaries meet on shared deletions, so only near terms are ever compared.
    """
    q = queries.select("q").distinct().withColumn("k", F.when(F.length("q") <= FUZZY_LETTERS, auto_edits(F.length("q"))).otherwise(0))
    same = q.join(terms, q["q"] == terms["term"]).select("q", "term", F.lit(0).alias("edits"))
    found = same
    for k in (1, 2):
        left = q.where(F.col("k") == k).select("q", F.explode(deletions(F.col("q"), k)).alias("d"))
        right = terms.where(F.length("term").between(2, 6) if k == 1 else F.length("term").between(4, FUZZY_LETTERS + 2)).select("term", F.explode(deletions(F.col("term"), k)).alias("d"))
        near = left.join(right, "d").where("q <> term").select("q", "term").distinct()
        found = found.union(near.withColumn("edits", edit_distance(F.col("q"), F.col("term"), k)).where("edits is not null"))
    order = Window.partitionBy("q").orderBy("edits", "term")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")


class Search:
    """One phase's retrieval over an index."""

    def __init__(self, index: TextIndex, phase: Phase, filters: Sequence[Filter], on_empty: str = "match_all"):
        if on_empty not in ("match_all", "none"):
            raise SpecError("on_empty is match_all or none")
        self.index, self.phase, self.on_empty = index, phase, on_empty
        self.limit = phase.candidate_limit if phase.candidate_limit < UNLIMITED else None
        self.rules = [(i, r) for i, r in enumerate(phase.rules) if r.es_clause_type in _CLAUSES and r.query_type in _QUERIES]
        self.required = {i: r for i, r in self.rules if r.es_clause_type in ("must", "filter") and r.query_type != "prefix" and index.kind(r.target_column) != "text"}
        self.static = static_predicate(index, filters)
        self.dynamic = dynamic_columns(filters)
        self.filtered = self.static is not None or bool(self.dynamic)
        self.docs = index.docs.where(self.static) if self.static is not None else index.docs
        # Dynamic columns: equal whole values, or a term of a text field.
        self.equal = [(n, f) for n, f in self.dynamic if index.kind(f) != "text"]
        self.within = [(n, f) for n, f in self.dynamic if index.kind(f) == "text"]

    def queries(self, source: DataFrame) -> DataFrame:
        """One row of each ``hash`` of what is read of a source row: its ``key``, masks of live rules, values to join on."""
        types = dict(source.dtypes)
        columns = key_columns(self.phase, self.dynamic)
        probe = source.select(source_key(columns).alias("hash"), *(F.col(f"`{c}`") for c in columns)).dropDuplicates(["hash"])
        for name, _ in self.dynamic:
            probe = probe.where(F.col(f"`{name}`").isNotNull())
        alive = {i: active(F.col(f"`{r.source_column}`"), types[r.source_column]) for i, r in self.rules}
        mask = lambda rules: reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(f"alive{i}"), F.lit(1 << i)).otherwise(F.lit(0)) for i in rules], F.lit(0)).cast("long")
        of = lambda *kinds: [i for i, r in self.rules if r.es_clause_type in kinds]
        probe = probe.select("*", *(c.alias(f"alive{i}") for i, c in alive.items()), *(_typed(self.index, f, F.col(f"`{n}`")).alias(f"tie{j}") for j, (n, f) in enumerate(self.equal)))
        probe = probe.select("*", *(_typed(self.index, r.target_column, F.col(f"`{r.source_column}`")).alias(f"fixed{i}") for i, r in self.required.items()))
        masks = {"bound": mask(self.required), "need": mask(of("must", "filter")), "may": mask(of("should")), "bar": mask(of("must_not"))}
        inside = [F.col(f"`{n}`").cast("string").alias(f"in{j}") for j, (n, _) in enumerate(self.within)]
        return staged(probe.select("*", *(c.alias(n) for n, c in masks.items()), *inside, F.monotonically_increasing_id().alias("key")), "queries")

    def pairs(self, source: DataFrame, fields: Sequence[str], more: dict[str, Column] | None = None) -> DataFrame:
        """``source_*`` columns with ``candidate_*`` fields as text, ``more`` columns of documents and ``es_score``: at most ``candidate_limit`` documents of each source row."""
        probe = self.queries(source)
        more = more or {}
        candidate = [f"candidate_{f}" for f in [*fields, *more]]
        own = [f"source_{c}" for c in source.columns]
        rows = source.select(source_key(key_columns(self.phase, self.dynamic)).alias("hash"), *(F.col(f"`{c}`").alias(f"source_{c}") for c in source.columns))
        told = [F.col(f"`{f}`").cast("string").alias(f"candidate_{f}") for f in fields] + [c.alias(f"candidate_{n}") for n, c in more.items()]
        docs = self.index.docs.select(ID, *told)
        out = []
        for bound in sorted(r[0] for r in probe.select("bound").distinct().collect()):  # one for each set of required rules
            part = _Part(self, probe.where(F.col("bound") == bound), bound)
            if part.direct:
                out.append(part.met(rows, told).select(*own, *candidate, "es_score"))
                continue
            good = part.good()
            if self.limit is None:
                if good is not None:
                    keyed = rows.join(part.keys.select("hash", "key"), "hash")
                    out.append(keyed.join(good, "key").join(part.members(told), ID).select(*own, *candidate, F.col("score").alias("es_score")))
                continue
            hits = part.best(good) if good is not None else None
            if hits is not None and not part.all_listed:
                keyed = rows.join(part.keys.where(~part.listed).select("hash", "key"), "hash")
                out.append(keyed.join(hits, "key").join(docs, ID).select(*own, *candidate, F.col("score").alias("es_score")))
            if part.lists:
                out.append(part.merged(rows, hits, docs, told).select(*own, *candidate, "es_score"))
        if not out:
            return rows.join(docs, F.lit(False)).select(*own, *candidate, F.lit(0.0).alias("es_score"))
        return reduce(DataFrame.unionAll, out)


class _Part:
    """The queries that have the same required rules, and the classes of documents for the fields that these read."""

    def __init__(self, search: Search, probe: DataFrame, bound: int):
        self.search, self.bound, full = search, bound, search.index
        self.rules = [(i, r) for i, r in search.rules if i not in search.required]
        self.fixed = [(i, r) for i, r in search.required.items() if bound >> i & 1]
        self.tied = [(f"tie{j}", f) for j, (_, f) in enumerate(search.equal)] + [(f"fixed{i}", r.target_column) for i, r in self.fixed]
        self.ties = [t for t, _ in self.tied]
        read = [*(r.target_column for _, r in self.rules), *(f for _, f in self.tied), *(f for _, f in search.within)]
        self.columns = list(dict.fromkeys(f.partition(".")[0] for f in read))
        # Without a limit, rules on whole values are told next to the pair that the required values make, document by document.
        self.direct = bool(bound) and search.limit is None and not search.within and all(r.query_type != "prefix" and full.kind(r.target_column) != "text" for _, r in self.rules)
        if self.direct:
            classes = full.docs.withColumn(COPIES, F.lit(1))
        else:
            told = self._told().groupBy("_a", "_b").agg(*(F.first(f"`{c}`").alias(c) for c in self.columns), F.first("_ok").alias("_ok"), F.min(ID).alias("_first"), F.count(F.lit(1)).alias(COPIES))
            # Numbers in the order of each class's first document.
            classes = staged(told.orderBy("_first").withColumn(ID, F.monotonically_increasing_id()), "classes")
        self.index = TextIndex(classes, full.mapping, full.settings, full.id_field)
        self.docs = search.docs if self.direct else classes.where("_ok and _first is not null")
        self._posted: dict[str, tuple[DataFrame, DataFrame]] = {}
        # Queries whose required whole values are all that must hit, and nothing must not.
        self.lists = bool(bound) and search.limit is not None and search.limit <= LISTED and not search.within
        self.listed = (F.col("need") == bound) & (F.col("bar") == 0) if self.lists else F.lit(False)
        self.all_listed = self.lists and all(r.es_clause_type == "should" for _, r in self.rules)
        self.probe, self.keys = probe, self._scored(probe)

    def _told(self, more: Sequence[Column] = ()) -> DataFrame:
        """Documents with a 128-bit hash of what is read of them."""
        values = [F.col(f"`{c}`") for c in self.columns]
        ok = F.lit(True) if self.search.static is None else F.coalesce(self.search.static, F.lit(False))
        nulls = reduce(lambda x, y: x * 2 + y, [v.isNull().cast("long") for v in values], ok.cast("long"))
        return self.search.index.docs.select(ID, *values, *more, ok.alias("_ok"), F.xxhash64(nulls, *values).alias("_a"), F.xxhash64(F.lit(1), nulls, *values).alias("_b"))

    def _scored(self, probe: DataFrame) -> DataFrame:
        """The queries with ``base``, the score of their required rules."""
        base = F.lit(0.0)
        for i, r in self.fixed:
            if r.es_clause_type == "must" and self.index.kind(r.target_column) == "keyword":
                probe = probe.join(self._value_scores(r).select(F.col("t").alias(f"fixed{i}"), F.col("score").alias(f"score{i}")), f"fixed{i}")
                base = base + F.col(f"score{i}")
            elif r.es_clause_type == "must":
                base = base + F.lit(float(r.boost or 1.0))
        inside = [f"in{j}" for j in range(len(self.search.within))]
        return probe.select("hash", "key", "need", "may", "bar", *self.ties, *inside, base.alias("base"))

    # --- hits of one rule: (key, _id, score) ------------------------------------------

    def _postings(self, field: str) -> tuple[DataFrame, DataFrame]:
        """Postings of the documents that may be returned, and terms with their frequencies in all."""
        if field not in self._posted:
            full = self.index.postings(field)
            terms = full.groupBy("term").agg(F.sum(COPIES).alias("df"))
            mine = full.join(self.docs.select(ID), ID, "left_semi") if self.search.static is not None else full
            self._posted[field] = mine.drop(COPIES), terms.crossJoin(F.broadcast(self.index.field_stats(field)))  # the statistics are one row
        return self._posted[field]

    def _meet(self, asked: DataFrame, postings: DataFrame) -> DataFrame:
        """Postings of the asked terms in documents with equal dynamic columns and required values."""
        tied = postings.join(self.docs.select(ID, *self._tie_values()), ID) if self.ties else postings
        return asked.join(tied, ["term", *self.ties])

    def _tie_values(self) -> list[Column]:
        return [self.index.value(f).alias(t) for t, f in self.tied]

    def _text(self, probes: DataFrame, r: Rule) -> DataFrame:
        postings, terms = self._postings(r.target_column)
        boost = float(r.boost or 1.0)
        idf = _idf(F.col("n_docs"), F.col("df"))
        if r.query_type == "prefix":
            v = probes.select("key", *self.ties, F.col("v").cast("string").alias("p"))
            return self._meet(_started(v, terms.select("term")), postings).groupBy("key", ID).agg(F.lit(boost).alias("score"))
        if r.query_type == "term":
            q = probes.select("key", *self.ties, F.col("v").cast("string").alias("q"), F.lit(0).alias("qpos"))
        else:
            q = probes.select("key", *self.ties, F.posexplode(self.index.analyze(r.target_column, F.col("v"))).alias("qpos", "q"))
        if r.query_type == "match" and r.is_fuzzy:
            near = expand_fuzzy(q, terms.select("term"))
            weight = F.when(F.col("edits") == 0, 1.0).otherwise(1 - F.col("edits") / F.least(F.length("q"), F.length("term")))
            q = q.join(near, "q").select("key", *self.ties, "qpos", "term", weight.alias("w"))
        else:
            q = q.select("key", *self.ties, "qpos", F.col("q").alias("term"), F.lit(1.0).alias("w"))
        hits = self._meet(q.join(terms, "term"), postings)
        if r.query_type == "match_phrase":
            wanted = q.groupBy("key").agg(F.count(F.lit(1)).alias("want"))
            at = hits.select("key", ID, "dl", "avgdl", "qpos", idf.alias("idf"), F.explode(F.transform("positions", lambda p: p - F.col("qpos"))).alias("start"))
            whole = at.groupBy("key", ID, "dl", "avgdl", "start").agg(F.count_distinct("qpos").alias("have"), F.sum("idf").alias("idf")).join(wanted, "key").where("have = want")
            return whole.groupBy("key", ID).agg((F.lit(boost) * _bm25(F.first("idf"), F.count(F.lit(1)), F.first("dl"), F.first("avgdl"))).alias("score"))
        return hits.select("key", ID, (F.lit(boost) * F.col("w") * _bm25(idf, F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))

    def _value(self, probes: DataFrame, r: Rule) -> DataFrame:
        """Whole values: keyword, number, date, boolean."""
        field, boost = r.target_column, float(r.boost or 1.0)
        values = self.docs.select(ID, self.index.value(field).alias("t"), *self._tie_values()).where("t is not null")
        if r.query_type == "prefix":
            v = probes.select("key", *self.ties, F.col("v").cast("string").alias("p"))
            asked = _started(v, values.select(F.col("t").cast("string").alias("term")).distinct())
            return asked.join(values.withColumn("term", F.col("t").cast("string")), ["term", *self.ties]).groupBy("key", ID).agg(F.lit(boost).alias("score"))
        typed = probes.select("key", *self.ties, _typed(self.index, field, F.col("v")).alias("t")).where("t is not null")
        if self.index.kind(field) != "keyword":
            return typed.join(values, ["t", *self.ties]).select("key", ID, F.lit(boost).alias("score"))
        return typed.join(self._value_scores(r), "t").join(values, ["t", *self.ties]).select("key", ID, "score")

    def _value_scores(self, r: Rule) -> DataFrame:
        """``(t, score)`` of the values of a keyword field."""
        every = self.index.docs.select(self.index.value(r.target_column).alias("t"), COPIES).where("t is not null")
        stats = every.groupBy("t").agg(F.sum(COPIES).alias("df")).crossJoin(F.broadcast(every.agg(F.sum(COPIES).alias("n_docs"))))  # one row
        return stats.select("t", (F.lit(float(r.boost or 1.0)) * _idf(F.col("n_docs"), F.col("df")) / (1 + K1)).alias("score"))

    # --- all rules ----------------------------------------------------------------------

    def good(self) -> DataFrame | None:
        """``(key, _id, score)`` of the classes that the queries may get, those of a group's list only if a rule of their own hits."""
        search, within = self.search, range(len(self.search.within))
        parts = []
        for i, r in self.rules:
            v = self.probe.where(f"alive{i}").select("key", *self.ties, F.col(f"`{r.source_column}`").alias("v"))
            hit = self._text(v, r) if self.index.kind(r.target_column) == "text" else self._value(v, r)
            scored = F.col("score") if r.es_clause_type in ("must", "should") else F.lit(0.0)
            parts.append(hit.select("key", ID, F.lit(1 << i).cast("long").alias("bit"), scored.alias("score")))
        if parts:
            hits = reduce(DataFrame.unionAll, parts).groupBy("key", ID).agg(F.bit_or("bit").alias("bits"), F.sum("score").alias("score"))
        elif self.all_listed:
            return None
        else:
            hits = self.probe.sparkSession.createDataFrame([], f"key bigint, {ID} bigint, bits bigint, score double")
        pool = self.docs.select(ID, *self._tie_values(), *(self.index.analyze(f, F.col(f"`{f.partition('.')[0]}`")).alias(f"all{j}") for j, (_, f) in enumerate(search.within)))
        if self.bound and not self.all_listed:
            # Documents of the group without another hit, where no list stands for them.
            rest = self.keys.where((F.col("need") == self.bound) & ~self.listed)
            base = rest.join(pool, self.ties).select("key", ID).join(hits, ["key", ID], "left_anti")
            hits = hits.unionByName(base.select("key", ID, F.lit(0).cast("long").alias("bits"), F.lit(0.0).alias("score")))
        found = hits.join(self.keys, "key").withColumns({"bits": F.col("bits").bitwiseOR(F.lit(self.bound).cast("long")), "score": F.col("score") + F.col("base")})
        if within:
            held = reduce(lambda x, y: x & y, [F.array_contains(F.col(f"all{j}"), F.col(f"in{j}")) for j in within])
            found = found.join(pool.drop(*self.ties), ID).where(held)
        allowed = (F.col("bits").bitwiseAND(F.col("bar")) == 0) & (F.col("bits").bitwiseAND(F.col("need")) == F.col("need"))
        good = found.where(allowed & ((F.col("need") != 0) | (F.col("bits").bitwiseAND(F.col("may")) != 0))).select("key", ID, "score")
        if self.bound:
            return good

        # Queries without a clause that must hit: documents that pass the filters fill up the list.
        open_keys = self.keys.where((F.col("need") == 0) & (F.lit(search.filtered) | (F.col("may") == 0)))
        # Mostly every query has a clause that must hit, and that is known from the source alone.
        if (search.filtered or search.on_empty == "match_all") and not open_keys.isEmpty():
            good = good.unionByName(self._fill(open_keys, found, good, pool))
        return good

    def _fill(self, open_keys: DataFrame, found: DataFrame, good: DataFrame, pool: DataFrame) -> DataFrame:
        """Classes in the order of their first documents for the queries that have fewer hits than wanted."""
        k, one = self.search.limit, F.lit(1).alias("one")
        within, score = range(len(self.search.within)), 0.0 if self.search.filtered or any(r.es_clause_type == "must_not" for _, r in self.search.rules) else 1.0
        for j in within:
            pool = pool.withColumn(f"in{j}", F.explode(F.array_distinct(f"all{j}")))
        by = [*self.ties, *(f"in{j}" for j in within)]
        if k is None:
            every = open_keys.join(pool, by) if by else open_keys.crossJoin(pool)
            return every.select("key", ID).join(found, ["key", ID], "left_anti").select("key", ID, F.lit(score).alias("score"))
        has = good.groupBy("key").count().where(F.col("count") >= k)
        needy = staged(open_keys.join(has, "key", "left_anti"), "open-queries")
        seen = found.join(needy.select("key"), "key", "left_semi").groupBy("key").agg(F.collect_set(ID).alias("seen"))
        seen = staged(seen, "seen-documents")
        most = seen.agg(F.max(F.size("seen"))).first()[0] or 0
        if not by:
            first = pool.select(ID).orderBy(ID).limit(k + most).agg(F.sort_array(F.collect_list(ID)).alias("first")).select(one, "first")
            joined = needy.crossJoin(F.broadcast(first))  # one row of at most k + most ids
        else:
            rank = F.row_number().over(Window.partitionBy(*by).orderBy(ID))
            first = pool.select(ID, *by).withColumn("rank", rank).where(F.col("rank") <= k + most).groupBy(*by).agg(F.sort_array(F.collect_list(ID)).alias("first"))
            joined = needy.join(first, by)
        left = F.slice(F.when(F.col("seen").isNull(), F.col("first")).otherwise(F.array_except("first", "seen")), 1, k)
        return joined.join(seen, "key", "left").select("key", F.explode(left).alias(ID), F.lit(score).alias("score"))

    # --- classes and their documents ------------------------------------------------------

    def members(self, told: Sequence[Column]) -> DataFrame:
        """Each document that may be returned under its class, with its own id as ``_member`` and the ``told`` columns."""
        classes = self.docs.select("_a", "_b", F.col(ID).alias("_class"))
        each = self._told(told).drop(*self.columns).where(F.col(ID).isNotNull()).withColumnRenamed(ID, "_member")
        return each.join(classes, ["_a", "_b"]).drop("_a", "_b", "_ok").withColumnRenamed("_class", ID)

    def best(self, good: DataFrame) -> DataFrame:
        """``(key, _id, score)`` of the best documents. One among the best k is in one of the best k classes
        by score and first document, and among the first k of its class."""
        k = self.search.limit
        by = lambda c: Window.partitionBy("key").orderBy(F.round("score", 6).desc(), F.col(c))
        top = good.withColumn("k", F.row_number().over(by(ID))).where(F.col("k") <= k).drop("k")
        first = self.members([]).withColumn("k", F.row_number().over(Window.partitionBy(ID).orderBy("_member"))).where(F.col("k") <= k).drop("k")
        each = top.join(first, ID).select("key", F.col("_member").alias(ID), "score")
        return each.withColumn("k", F.row_number().over(by(ID))).where(F.col("k") <= k).drop("k")

    def met(self, rows: DataFrame, told: Sequence[Column]) -> DataFrame:
        """Rows with every document of equal required values, whose other rules are told from the pair: no pair is shuffled."""
        full, asked = self.search.index, self.keys.select("hash", "key", "need", "bar", "base", *self.ties)
        bits, score, values = F.lit(self.bound).cast("long"), F.col("base"), []
        for i, r in self.rules:
            v = F.when(F.col(f"alive{i}"), _typed(self.index, r.target_column, F.col(f"`{r.source_column}`")))
            asked = asked.join(self.probe.select("key", v.alias(f"asked{i}")), "key")
            gain = F.lit(float(r.boost or 1.0) if r.es_clause_type in ("must", "should") else 0.0)
            if r.es_clause_type in ("must", "should") and self.index.kind(r.target_column) == "keyword":
                asked = asked.join(self._value_scores(r).select(F.col("t").alias(f"asked{i}"), F.col("score").alias(f"gain{i}")), f"asked{i}", "left")
                gain = F.col(f"gain{i}")
            hit = F.coalesce(F.col(f"asked{i}") == F.col(f"held{i}"), F.lit(False))
            bits, score = bits.bitwiseOR(F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")), score + F.when(hit, gain).otherwise(F.lit(0.0))
            values.append(full.value(r.target_column).alias(f"held{i}"))
        docs = self.search.docs.where(F.col(ID).isNotNull()).select(ID, *told, *values, *(full.value(f).alias(t) for t, f in self.tied))
        each = rows.join(asked, "hash").join(docs, self.ties).where((bits.bitwiseAND(F.col("bar")) == 0) & (bits.bitwiseAND(F.col("need")) == F.col("need")))
        return each.withColumn("es_score", score)

    def merged(self, rows: DataFrame, hits: DataFrame | None, docs: DataFrame, told: Sequence[Column]) -> DataFrame:
        """Rows of listed queries with the best of their own hits and of the first documents of their group."""
        k, full = self.search.limit, self.search.index
        names = [c for c in docs.columns if c != ID]
        group = self.search.docs.where(F.col(ID).isNotNull()).select(ID, *told, *(full.value(f).alias(t) for t, f in self.tied))
        group = group.withColumn("k", F.row_number().over(Window.partitionBy(*self.ties).orderBy(ID))).where(F.col("k") <= k)
        group = group.groupBy(*self.ties).agg(F.sort_array(F.collect_list(F.struct(ID, *names))).alias("group"))
        keyed = rows.join(self.keys.where(self.listed).select("hash", "key", "base", *self.ties), "hash")
        low = -F.round("base", 6)
        plain = F.transform("group", lambda x: F.struct(low.alias("low"), x[ID].alias(ID), F.col("base").alias("score"), *(x[n].alias(n) for n in names)))
        if hits is not None:
            own = hits.join(docs, ID).groupBy("key").agg(F.collect_list(F.struct((-F.round("score", 6)).alias("low"), ID, "score", *names)).alias("own"), F.collect_set(ID).alias("ids"))
            keyed = keyed.join(own, "key", "left")
            others = F.filter(plain, lambda x: ~F.array_contains("ids", x[ID]))
            plain = F.when(F.col("own").isNull(), plain).otherwise(F.slice(F.sort_array(F.concat("own", others)), 1, k))
        each = keyed.join(group, self.ties).select(*(c for c in rows.columns if c != "hash"), F.explode(plain).alias("one"))
        return each.select(*(c for c in rows.columns if c != "hash"), *(F.col(f"one.{n}").alias(n) for n in names), F.col("one.score").alias("es_score"))


def _started(probes: DataFrame, terms: DataFrame) -> DataFrame:
    """The probes with each term that starts with their ``p``: terms are cut to the lengths that probes have."""
    lengths = sorted(r[0] for r in probes.select(F.length("p").alias("n")).where("n is not null").distinct().collect())  # lengths, not rows
    if not lengths:
        return probes.withColumn("term", F.lit("")).where("false").drop("p")
    cuts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n))
    return probes.join(terms.select("term", F.explode(cuts).alias("p")), "p").drop("p")


def _typed(index: TextIndex, field: str, c: Column) -> Column:
    """A source value as the field's type; null if it can't be read so."""
    from kinweave.sources.index import _CASTS, parse_date

    kind = index.kind(field)
    if kind == "date":
        return parse_date(c, index.mapping[field.partition(".")[0]].get("format", "strict_date_optional_time||epoch_millis"))
    return c.try_cast(_CASTS[kind]) if kind in _CASTS else c.cast("string")


def key_columns(phase: Phase, dynamic: Sequence[tuple[str, str]]) -> list[str]:
    """What a search reads of a source row."""
    return list(dict.fromkeys([*(r.source_column for r in phase.rules), *(s for s, _ in dynamic)]))


def source_key(columns: Sequence[str]) -> Column:
    """A 128-bit hash of what the search reads of a source row: rows that read alike are one query."""
    values = [F.col(f"`{c}`") for c in columns]
    nulls = reduce(lambda x, y: x * 2 + y, [v.isNull().cast("long") for v in values], F.lit(0).cast("long"))
    return F.struct(F.xxhash64(nulls, *values).alias("a"), F.xxhash64(F.lit(1), nulls, *values).alias("b"))
