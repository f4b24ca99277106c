"""The registered queries of the retrieval and memory engine, and their SQL."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto, filters, lexical
from ..functions.vectors import distance, vector
from ..model import MemoryFilter, Recall, Scope, Scoring
from ..operators import changes, context, knn, recall, search
from ..sources import embed
from ..streaming import feed
from . import lifecycle
from .view import DAY_MS, HOUR_MS, IDX, MEM, NOW_MS, START_MS, index, memories, q, sql_distance, table, vector_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


# ---------------------------------------------------------------- nearest neighbours

for _metric in ("l2", "cosine", "dot"):

    @query(f"SELECT vec_id AS id, round({sql_distance(_metric, 'embedding::DOUBLE[]', q(3))}, 6) AS distance FROM embeddings ORDER BY {sql_distance(_metric, 'embedding::DOUBLE[]', q(3))}, vec_id LIMIT 10", f"knn_{_metric}")
    def _knn(spark, sf_dir, metric=_metric):
        got = knn.top_k(index(spark, sf_dir), vector_of(spark, sf_dir, 3), 10, metric)
        return got.select("id", F.round("distance", 6).alias("distance"))

    @query(f"SELECT vec_id AS id, round({sql_distance(_metric, 'embedding::DOUBLE[]', q(1))}, 6) AS distance FROM embeddings WHERE vec_id = 42", f"distance_to_{_metric}")
    def _distance_to(spark, sf_dir, metric=_metric):
        return knn.distance_to(index(spark, sf_dir), 42, vector_of(spark, sf_dir, 1), metric).select("id", F.round("distance", 6).alias("distance"))

    @query(
        f"""SELECT q.vec_id AS query_id, v.vec_id AS id, round({sql_distance(_metric, 'v.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')}, 6) AS distance,
 CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_distance(_metric, 'v.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')}, v.vec_id) AS INTEGER) AS rank
 FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10""",
        f"knn_batch_{_metric}",
    )
    def _knn_batch(spark, sf_dir, metric=_metric):
        rows = index(spark, sf_dir)
        asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
        return knn.batch_top_k(rows, asked, 10, metric).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def _filtered(name: str, expr: dict, sql: str) -> None:
    @query(f"WITH {IDX} SELECT id, round({sql_distance('l2', 'e', q(5))}, 6) AS distance FROM idx WHERE {sql} ORDER BY {sql_distance('l2', 'e', q(5))}, id LIMIT 10", f"knn_filtered_{name}")
    def run(spark, sf_dir):
        got = knn.top_k(index(spark, sf_dir), vector_of(spark, sf_dir, 5), 10, "l2", filters.parse(expr))
        return got.select("id", F.round("distance", 6).alias("distance"))


_eq = lambda f, v: {"eq": {"field": f, "value": v}}
_filtered("eq", _eq("label", "3"), "has AND label = 3")
_filtered("in", {"in": {"field": "label", "values": ["1", "4", "7"]}}, "has AND label IN (1, 4, 7)")
_filtered("and_or_not", {"and": [{"or": [_eq("label", "2"), _eq("label", "5"), _eq("parity", "odd")]}, {"not": _eq("label", "5")}]}, "has AND (label IN (2, 5) OR parity = 'odd') AND label <> 5")
_filtered("not", {"not": _eq("parity", "even")}, "has AND parity = 'odd'")
_filtered("empty_and", {"and": []}, "false")
_filtered("empty_or", {"or": []}, "false")
_filtered("absent_value", _eq("label", "none"), "false")


@query(f"WITH {IDX} SELECT avg(CASE WHEN label = 3 THEN 1.0 ELSE 0.0 END) AS selectivity FROM idx WHERE has")
def filter_selectivity(spark, sf_dir):
    return filters.selectivity(index(spark, sf_dir), filters.parse(_eq("label", "3")))


@query(f"WITH {IDX} SELECT id FROM idx WHERE has AND label = 3 UNION SELECT id FROM idx WHERE has AND parity = 'odd'")
def filter_union_of_ids(spark, sf_dir):
    rows = index(spark, sf_dir)
    return changes.union_ids(rows.where(filters.parse(_eq("label", "3"))), rows.where(filters.parse(_eq("parity", "odd"))))


@query(f"WITH {IDX} SELECT id FROM idx WHERE has AND label = 3 INTERSECT SELECT id FROM idx WHERE has AND parity = 'odd'")
def filter_intersection_of_ids(spark, sf_dir):
    rows = index(spark, sf_dir)
    return rows.where(filters.parse(_eq("label", "3"))).select("id").intersect(rows.where(filters.parse(_eq("parity", "odd"))).select("id"))


@query(f"WITH {IDX} SELECT CAST(label AS VARCHAR) AS value, count(*) AS ids, min(id) AS first_id FROM idx WHERE has GROUP BY label")
def metadata_value_index(spark, sf_dir):
    rows = index(spark, sf_dir).select("id", F.explode("metadata").alias("field", "values")).where("field = 'label'").select("id", F.explode("values").alias("value"))
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("ids"), F.min("id").alias("first_id"))


@query()
def ann_recall_at_k(spark, sf_dir):
    """Inverted-file search against exact search; the recall is reported, not assumed."""
    rows = index(spark, sf_dir)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    lists = knn.default_lists(rows.count())
    centres = knn.centroids(rows, "embedding", lists)
    found = knn.probed_top_k(knn.with_list(rows, centres), centres, asked, 10, max(1, int(lists * 0.7)))
    return knn.recall_at_k(found, knn.batch_top_k(rows, asked, 10, "l2"))


# ---------------------------------------------------------------- recall

TERMS = ["the", "ontion", "und", "für"]


def bm25_sql(source: str, terms: list[str]) -> str:
    """bm25 of rows of source (id, content, ...) that hold a term, as CTEs ending in bm(id, bm25)."""
    tf = lambda w: f"len(list_filter(t, lambda x: x = '{w}'))"
    df = lambda w: f"(SELECT count(*) FROM tk WHERE list_contains(t, '{w}'))"
    n = "(SELECT count(*) FROM tk)"
    parts = " + ".join(f"ln(1 + ({n} - {df(w)} + 0.5) / ({df(w)} + 0.5)) * {tf(w)} * 2.2 / ({tf(w)} + 1.2 * (0.25 + 0.75 * len(t) / (SELECT avg(len(t)) FROM tk)))" for w in terms)
    return f"tk AS (SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}), bm AS (SELECT id, {parts} AS bm25 FROM tk WHERE list_has_any(t, [{', '.join(repr(w) for w in terms)}]))"


def recall_sql(vec: int, scope: tuple[str, str], limit: int, pred: str = "true", pushed: str = "true", s: Scoring = Scoring(), terms: list[str] | None = None, mode: str = "pool") -> str:
    """CTEs ending in sc, the scored pool."""
    inside = f"tenant_id = '{scope[0]}' AND namespace = '{scope[1]}'"
    first = 3 * limit
    fts = f"fs AS (SELECT * FROM mem WHERE {inside} AND status = 'active' AND {pushed}), {bm25_sql('fs', terms)}, fts AS (SELECT id AS fid, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS fts_rank FROM bm QUALIFY fts_rank <= {first})" if terms else "fts AS (SELECT CAST(NULL AS BIGINT) AS fid, CAST(NULL AS BIGINT) AS fts_rank WHERE false)"
    hits = "(SELECT count(*) FROM r WHERE ok AND fts_rank IS NOT NULL)"
    wide = f"CASE WHEN {hits} >= {limit} THEN {first} ELSE coalesce((SELECT min({first} * (1::BIGINT << j)) FROM range(0, 40) AS g(j) WHERE {first} * (1::BIGINT << j) >= (SELECT min(v) FROM c WHERE cum >= {limit})), 1::BIGINT << 60) END"
    member = "ok" if mode == "exact" else "ok AND (fts_rank IS NOT NULL OR v <= (SELECT n FROM n))"
    return f"""{MEM}, {fts}, live AS (SELECT *, {sql_distance('cosine', 'e', q(vec))} AS dist FROM mem WHERE status = 'active'),
 r AS (SELECT live.*, fts_rank, row_number() OVER (ORDER BY dist, id) AS v, coalesce({inside} AND (expires_at_ms IS NULL OR {NOW_MS} < expires_at_ms) AND {pred}, false) AS ok FROM live LEFT JOIN fts ON id = fid),
 c AS (SELECT *, {hits} + sum(CASE WHEN ok AND fts_rank IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum FROM r), n AS (SELECT {wide} AS n),
 f AS (SELECT *, least(greatest(1 - dist / 2, 0), 1) AS similarity, least(greatest(importance, 0), 1) AS imp, exp(-greatest({NOW_MS} - created_at_ms, 0) / ({s.half_life_days} * {DAY_MS}.0)) AS recency, least(access_count / 10.0, 1) AS reinf FROM c WHERE {member}),
 sc AS (SELECT *, {s.similarity} * similarity + {s.importance} * imp + {s.recency} * recency + {s.reinforcement} * reinf AS score FROM f)"""


COLUMNS = ["id", "kind", "score", "rank"]
TAIL = "SELECT id, kind, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc QUALIFY rank <= {limit}"


def shown(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def _recall(name: str, sql: str, **kw) -> None:
    vec, limit = kw.pop("vec", 3), kw.get("limit", 10)

    @query(f"WITH {sql} {TAIL.format(limit=limit)}", name)
    def run(spark, sf_dir):
        r = Recall(Scope("t0", "ns0"), vector_of(spark, sf_dir, vec), NOW_MS, **{"limit": limit} | kw)
        return shown(recall.recall(memories(spark, sf_dir), r))


_S = ("t0", "ns0")
_recall("recall_vector_default", recall_sql(3, _S, 10))
_recall("recall_small_limit", recall_sql(17, _S, 1), vec=17, limit=1)
_weights = Scoring(0.1, 0.45, 0.45, 0.0, 3.0)
_recall("recall_custom_weights", recall_sql(3, _S, 10, s=_weights), scoring=_weights)
_after, _before = START_MS + 50 * HOUR_MS, START_MS + 400 * HOUR_MS
_time = f"created_at_ms >= {_after} AND created_at_ms <= {_before}"
_recall("recall_time_window", recall_sql(3, _S, 10, _time), filters=MemoryFilter(created_after_ms=_after, created_before_ms=_before))
_recall("recall_kind_importance", recall_sql(3, _S, 10, "kind IN ('preference', 'fact') AND importance >= 0.5"), filters=MemoryFilter(kinds=["preference", "fact"], min_importance=0.5))
_recall("recall_no_kinds", recall_sql(3, _S, 10, "false"), filters=MemoryFilter(kinds=[]))
_recall("recall_metadata_eq", recall_sql(3, _S, 10, "label = 6"), filters=MemoryFilter(metadata={"label": 6}))
_recall("recall_metadata_typed", recall_sql(3, _S, 10, "false"), filters=MemoryFilter(metadata={"label": "6"}))
_recall("recall_exact_mode", recall_sql(3, _S, 10, mode="exact"), mode="exact")
_recall("recall_hybrid", recall_sql(3, _S, 10, terms=TERMS), text=" ".join(TERMS))
_recall("recall_hybrid_filtered", recall_sql(3, _S, 10, f"kind = 'preference' AND {_time}", _time, terms=["the"]), text="the", filters=MemoryFilter(kinds=["preference"], created_after_ms=_after, created_before_ms=_before))


@query(
    f"WITH {recall_sql(3, _S, 10, terms=TERMS)} SELECT id, round(score, 6) AS total, round(similarity, 6) AS similarity, round(imp, 6) AS importance, round(recency, 6) AS recency, round(reinf, 6) AS reinforcement,"
    " 'default_v1_scoring' || CASE WHEN fts_rank IS NOT NULL THEN '|fts5_lexical_candidate' ELSE '' END || CASE WHEN fts_rank IS NOT NULL AND v <= (SELECT n FROM n) THEN '|reciprocal_rank_fusion' ELSE '' END AS notes"
    " FROM sc ORDER BY score DESC, id LIMIT 10"
)
def recall_explain(spark, sf_dir):
    got = recall.recall(memories(spark, sf_dir), Recall(Scope(*_S), vector_of(spark, sf_dir, 3), NOW_MS, text=" ".join(TERMS)))
    e = [F.round(f"explanation.{c}", 6).alias(c) for c in ("total", "similarity", "importance", "recency", "reinforcement")]
    return got.select("id", *e, F.array_join("explanation.policy_notes", "|").alias("notes"))


@query(f"WITH {recall_sql(3, _S, 10, terms=TERMS)} SELECT id, round(coalesce(1.0 / (60 + CASE WHEN v <= (SELECT n FROM n) THEN v END), 0) + coalesce(1.0 / (60 + fts_rank), 0), 9) AS rrf FROM sc")
def rrf_fusion(spark, sf_dir):
    r = Recall(Scope(*_S), vector_of(spark, sf_dir, 3), NOW_MS, text=" ".join(TERMS))
    return recall.scored(recall.candidates(memories(spark, sf_dir), r, 10), r).select("id", F.round("rrf", 9).alias("rrf"))


@query(f"WITH {MEM} SELECT id FROM mem WHERE tenant_id = 't1' AND namespace = 'ns1' AND status = 'active' AND (expires_at_ms IS NULL OR {NOW_MS} < expires_at_ms)")
def scope_isolation(spark, sf_dir):
    return memories(spark, sf_dir, False).where(filters.eligible(Scope("t1", "ns1"), MemoryFilter(), NOW_MS)).select("id")


@query(f"WITH {MEM} SELECT id, expires_at_ms FROM mem WHERE status = 'active' AND expires_at_ms IS NOT NULL AND {NOW_MS} < expires_at_ms")
def recall_ttl(spark, sf_dir):
    return memories(spark, sf_dir, False).where(filters.alive(NOW_MS) & F.col("expires_at_ms").isNotNull()).select("id", "expires_at_ms")


@query(f"WITH {MEM} SELECT id, content, importance, status FROM mem WHERE tenant_id = 't0' AND namespace = 'ns0' AND id = 30")
def point_lookup(spark, sf_dir):
    """Any status, as the lowest layer has it."""
    return memories(spark, sf_dir).where(filters.in_scope(Scope("t0", "ns0")) & (F.col("id") == 30)).select("id", "content", "importance", "status")



def mmr_sql(limit: int = 5) -> str:
    """Greedy picks one after another, each as its own CTE over the pool and what is chosen."""
    steps, chosen = [], []
    for k in range(1, limit + 1):
        near = "0.0" if not chosen else "greatest(" + ", ".join(f"least(greatest(1 - ({sql_distance('cosine', 'p.e', f'(SELECT e FROM m{j})')}), 0), 1)" for j in chosen) + ", 0)"
        out = " AND ".join(f"p.id <> (SELECT id FROM m{j})" for j in chosen) or "true"
        steps.append(f"m{k} AS (SELECT id, kind, score, e FROM p WHERE {out} ORDER BY 0.5 * score - 0.5 * {near} DESC, rrf DESC, id LIMIT 1)")
        chosen.append(k)
    union = " UNION ALL ".join(f"SELECT id, kind, round(score, 6) AS score, {k} AS rank FROM m{k}" for k in chosen)
    return f"WITH {recall_sql(3, _S, limit)}, p AS (SELECT *, 1.0 / (60 + v) AS rrf FROM sc), {', '.join(steps)} {union}"


@query(mmr_sql())
def mmr_diversity(spark, sf_dir):
    r = Recall(Scope(*_S), vector_of(spark, sf_dir, 3), NOW_MS, limit=5, mmr_lambda=0.5)
    return shown(recall.recall(memories(spark, sf_dir), r))


@query(
    f"""WITH {MEM}, ok AS (SELECT * FROM mem WHERE tenant_id = 't0' AND namespace = 'ns0' AND status = 'active' AND (expires_at_ms IS NULL OR {NOW_MS} < expires_at_ms)),
 near AS (SELECT q.id AS query_id, v.*, {sql_distance('cosine', 'v.e', 'q.e')} AS dist FROM ok v, mem q WHERE q.id % 20 = 0),
 sc AS (SELECT *, 0.7 * least(greatest(1 - dist / 2, 0), 1) + 0.15 * importance + 0.1 * exp(-greatest({NOW_MS} - created_at_ms, 0) / (7.0 * {DAY_MS}.0)) + 0.05 * least(access_count / 10.0, 1) AS score FROM near)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM sc QUALIFY rank <= 10"""
)
def recall_batch(spark, sf_dir):
    m = memories(spark, sf_dir, False)
    asked = m.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = recall.batch_vector_recall(m, asked, Recall(Scope(*_S), [0.0], NOW_MS))
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- text

_texts = "SELECT doc_id AS id, text AS content FROM documents"


@query(f"WITH tx AS ({_texts}), {bm25_sql('tx', TERMS)} SELECT id FROM bm")
def lexical_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return docs.where(F.arrays_overlap(lexical.tokens(F.col("content")), F.array(*map(F.lit, TERMS)))).select("id")


@query(f"WITH tx AS ({_texts}), {bm25_sql('tx', TERMS)} SELECT id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 9) DESC, id LIMIT 30")
def lexical_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return search.bm25(docs, " ".join(TERMS)).orderBy(F.desc(F.round("bm25", 9)), "id").limit(30).select("id", F.round("bm25", 6).alias("bm25"))


@query("SELECT conv_id, turn, (strlen(coalesce(text, '')) + 3) // 4 AS tokens FROM conversations")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lexical.token_estimate(F.col("text")).alias("tokens"))


KEY = bytes([0x42]) * 32


@query("SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_-]+'), ['the', 'ontion'])")
def blind_index_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", lexical.blind_tokens(KEY, F.col("text")).alias("blind"))
    return docs.where(lexical.blind_match(KEY, F.col("blind"), "The; ontion!")).select("doc_id")


@query("SELECT doc_id, md5(text) AS plain_md5, true AS sealed, true AS moved_fails FROM documents")
def seal_roundtrip(spark, sf_dir):
    record = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", crypto.seal(F.col("text"), KEY, F.lit("t"), record, "content").alias("s"))
    opened = crypto.unseal(F.col("s"), KEY, F.lit("t"), record, "content")
    moved = crypto.unseal(F.col("s"), KEY, F.lit("other"), record, "content", strict=False)
    return docs.select("doc_id", F.md5(F.encode(opened, "UTF-8")).alias("plain_md5"), crypto.is_sealed(F.col("s")).alias("sealed"), moved.isNull().alias("moved_fails"))


@query(
    f"""WITH {recall_sql(3, _S, 10)}, t AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rn, '- [' || kind || '] ' || id || ' (score: ' || printf('%.2f', score) || ')' AS line FROM sc QUALIFY rn <= 10),
 u AS (SELECT rn, line, 7 + sum((strlen(line) + 3) // 4) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS upto FROM t)
 SELECT '### Relevant Agent Memories:' || chr(10) || coalesce(string_agg(line || chr(10), '' ORDER BY rn), '') AS context, CAST(coalesce(max(upto), 7) AS BIGINT) AS tokens, count(*) AS items FROM u WHERE upto <= 60""".replace("7 + sum", "8 + sum").replace("max(upto), 7", "max(upto), 8")
)
def format_context_budget(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("content", F.col("id").cast("string"))
    got = recall.recall(m, Recall(Scope(*_S), vector_of(spark, sf_dir, 3), NOW_MS))
    return context.format_context(got, context.ContextOptions(max_tokens=60))


@query()
def deterministic_embed(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return docs.select("conv_id", "turn", embed.embed_column(embed.DeterministicEmbedder(16), F.col("text")).alias("embedding"))


# ---------------------------------------------------------------- lifecycle

_changes_sql = "ch AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op, user_id AS id, value FROM events)"


def _changes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), F.col("user_id").alias("id"), "value")


@query(f"WITH {_changes_sql}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ch) SELECT id, seq, value FROM l WHERE rn = 1 AND op <> 'delete'")
def upsert_latest_wins(spark, sf_dir):
    return changes.live(_changes(spark, sf_dir)).select("id", "seq", "value")


@query(f"WITH {_changes_sql}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ch) SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM l WHERE rn = 1 AND op = 'delete')")
def tombstone_antijoin(spark, sf_dir):
    gone = changes.latest(_changes(spark, sf_dir)).where("op = 'delete'")
    return changes.without_tombstones(index(spark, sf_dir), gone).select("id")


@query("SELECT max(vec_id) + 1 AS next_id FROM embeddings")
def id_high_water_mark(spark, sf_dir):
    return spark.createDataFrame([(changes.next_id(index(spark, sf_dir)),)], "next_id long")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def idempotent_ops_dedup(spark, sf_dir):
    ops = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return changes.first_seen(ops, ["user_id", "event_type"], ["event_id"])


_patches_sql = "pt AS (SELECT vec_id AS pid, vec_id % 3 + 1 AS expected FROM embeddings WHERE vec_id % 9 = 0)"


@query(f"WITH {MEM}, {_patches_sql} SELECT id, CASE WHEN ok THEN 0.9 ELSE importance END AS importance, CASE WHEN ok THEN revision + 1 ELSE revision END AS revision FROM (SELECT *, pid IS NOT NULL AND status <> 'deleted' AND expected = revision AS ok FROM mem LEFT JOIN pt ON id = pid)")
def occ_update(spark, sf_dir):
    return _merged(spark, sf_dir)[0].select("id", "importance", "revision")


@query(f"WITH {MEM}, {_patches_sql} SELECT pid AS id, CASE WHEN status = 'deleted' THEN 'NotFound' ELSE 'RevisionConflict' END AS reason FROM pt JOIN mem ON id = pid WHERE status = 'deleted' OR expected <> revision")
def occ_conflicts(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


def _merged(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("updated_at_ms", F.col("created_at_ms"))
    p = table(spark, sf_dir, "embeddings").where("vec_id % 9 = 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3 + 1).alias("expected_revision"), F.lit(None).cast("string").alias("content"), F.lit(0.9).alias("importance"), F.lit(None).cast("string").alias("kind"))
    return changes.merge(m, p, NOW_MS)


@query(f"WITH {MEM} SELECT count(*) FILTER (status = 'active') AS active_memories, count(*) FILTER (status = 'deleted') AS tombstoned_memories, CAST(0 AS BIGINT) AS pending_operations FROM mem")
def health(spark, sf_dir):
    return changes.health(memories(spark, sf_dir, False))


@query(f"WITH {MEM} SELECT id FROM mem WHERE status = 'deleted' OR expires_at_ms <= {NOW_MS} ORDER BY id LIMIT 40")
def vacuum_candidates(spark, sf_dir):
    return memories(spark, sf_dir, False).where(filters.vacuum_candidates(NOW_MS)).orderBy("id").limit(40).select("id")


@query(f"WITH {_changes_sql}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ch) SELECT id, seq, value FROM l WHERE rn = 1 AND op <> 'delete'")
def stream_upsert(spark, sf_dir):
    """The events as a stream of changes into a snapshot; its final state."""
    return feed.replayed(spark, sf_dir)


@query("SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events")
def latency_percentiles(spark, sf_dir):
    p = [F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY value)").alias(n) for x, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return table(spark, sf_dir, "events").agg(*p, F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | lifecycle.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | lifecycle.oracle_sql()
