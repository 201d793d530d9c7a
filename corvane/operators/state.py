"""Folds, versions, queues, publication and other operators on state, as SQL that Spark and DuckDB share.

Keyed folds are aggregates with max_by, so that no history is gathered; running states are windows by key.
"""

from __future__ import annotations

from corvane.plans.registry import shared
from corvane.sources.tables import NOW

#: Task states and the moves that are allowed between them (fixed values).
MOVES = {
    "pending": ("running", "failed", "waiting_review"),
    "running": ("failed", "waiting_review", "approved"),
    "waiting_review": ("approved", "failed", "running"),
    "failed": ("pending", "running"),
    "approved": (),
}
#: Lifecycle states of knowledge objects and their successors (fixed values).
LIFECYCLE = {
    "created": ("processing", "archived"),
    "processing": ("reviewing", "failed", "archived"),
    "reviewing": ("active", "rejected", "processing"),
    "active": ("deprecated", "archived"),
    "deprecated": ("active", "archived"),
    "failed": ("processing", "archived"),
    "rejected": ("archived",),
    "archived": (),
}
STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'view' THEN 'waiting_review' ELSE 'approved' END"


def allowed(moves: dict[str, tuple[str, ...]], a: str, b: str) -> str:
    """SQL: whether the move from a to b is allowed."""
    return "(" + " OR ".join(f"({a} = '{k}' AND {b} IN ({', '.join(repr(x) for x in v)}))" for k, v in moves.items() if v) + ")"


def values(moves: dict[str, tuple[str, ...]]) -> str:
    """SQL: all pairs of states."""
    names = ", ".join(f"('{k}')" for k in moves)
    return f"(SELECT p.s AS prev, n.s AS next FROM (VALUES {names}) AS p(s) CROSS JOIN (VALUES {names}) AS n(s))"


shared("fn_25_lifecycle_moves", "region", f"SELECT prev, next, {allowed(LIFECYCLE, 'prev', 'next')} AS allowed FROM {values(LIFECYCLE)}", "Which moves of the lifecycle are allowed; none to itself.")
shared("sup_44_manifest_moves", "region", f"SELECT prev, next, {allowed({'draft': ('partial', 'invalid'), 'partial': ('ready', 'invalid'), 'ready': (), 'invalid': ()}, 'prev', 'next')} AS allowed FROM {values({'draft': (), 'partial': (), 'ready': (), 'invalid': ()})}", "Which moves of a series manifest are allowed.")

# Events and versions ------------------------------------------------------------------------------

LAST = "max_by(value, event_id)"
shared("ver_02_fold", "events", f"SELECT user_id, event_type AS field, {LAST} AS value, count(*) AS writes FROM events GROUP BY user_id, event_type", "The state that events leave: of each field the last value written.")
shared("ver_04_history", "events", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, value FROM events", "The versions of each object in order.")
shared("ver_06_update", "events", "SELECT event_id, user_id, event_type AS field, lag(value) OVER w AS before, value AS after, count(*) OVER w AS version FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)", "Each change with the value it replaced and the field's version after it.")
shared(
    "ver_07_compare_and_set",
    "events",
    "SELECT event_id, attempt, attempt <= 3 AS committed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS attempt FROM events)",
    "Writers of an object that saw the same version (those of one hour): each loses to all before it and gives up after three attempts.",
)
shared(
    "ver_09_restore",
    "events",
    "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.field, b.field) AS field, CASE WHEN a.user_id IS NULL THEN 'removed' WHEN b.user_id IS NULL THEN 'recreated' WHEN a.value = b.value THEN 'unchanged' ELSE 'restored' END AS action, a.value FROM "
    f"(SELECT user_id, event_type AS field, {LAST} AS value FROM events WHERE event_id < 5000 GROUP BY user_id, event_type) a FULL JOIN (SELECT user_id, event_type AS field, {LAST} AS value FROM events WHERE event_id >= 1000 GROUP BY user_id, event_type) b ON a.user_id = b.user_id AND a.field = b.field",
    "What restoring a snapshot does to each field of the present state.",
)
shared("gr_14_rebuild_snapshot", "events", f"SELECT block, user_id, event_type AS field, {LAST} AS value FROM (SELECT *, CAST(floor(event_id / 100) AS BIGINT) AS block FROM events) GROUP BY block, user_id, event_type", "What each hundred events change in the materialised state.")

# Lineage ------------------------------------------------------------------------------------------

shared("lin_01_register_source", "orders", "SELECT o_custkey AS source_id, max_by(o_orderpriority, o_orderkey) AS path, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS version FROM orders GROUP BY o_custkey", "Sources after all registrations, the last of each kept.")
shared("lin_03_link_artifact", "lineitem", "SELECT DISTINCT l_orderkey AS artifact, l_suppkey AS source FROM lineitem l WHERE l_returnflag <> 'R' OR NOT EXISTS (SELECT 1 FROM lineitem n WHERE n.l_orderkey = l.l_orderkey AND n.l_returnflag <> 'R')", "An artifact's sources: newer links (not returned) replace its older ones as a whole.")
shared("lin_07_pending_outbox", "events", "SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'purchase' AND d.event_id > e.event_id)", "Entries after which no delivery (a purchase) of the same user follows.")
shared("lin_08_replay_outbox", "events", "SELECT user_id, count(*) AS delivered, max(event_id) AS last FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'purchase' AND d.event_id > e.event_id) GROUP BY user_id", "What a replay delivers to each user.")
shared("lin_11_tombstone", "documents labels", "SELECT d.doc_id, CASE WHEN l.toxic = 1 AND d.n_chars = length(d.text) THEN 'deleted' WHEN l.toxic = 1 THEN 'hash_mismatch' ELSE 'present' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "Sources deleted explicitly, if what was observed is what is there.")

# Queues and streams -------------------------------------------------------------------------------

shared("stm_03_enqueue", "orders", "SELECT o_orderkey, coalesce(first_active < o_orderkey, false) AS duplicate FROM (SELECT o_orderkey, min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey, o_orderpriority) AS first_active FROM orders)", "A request is a duplicate while an earlier one with its hash (customer, priority) is active.")
shared(
    "stm_04_update_status",
    "events",
    f"SELECT event_id, user_id, prev, status, coalesce({allowed(MOVES, 'prev', 'status')}, true) AS allowed, CASE WHEN status = 'failed' THEN CASE WHEN failures >= 3 THEN 'dead_letter' ELSE 'retry' END END AS action FROM "
    f"(SELECT event_id, user_id, {STATUS} AS status, lag({STATUS}) OVER w AS prev, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS failures FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
    "Each change of a task: whether it is allowed, and whether a failure is retried or given up.",
)
shared(
    "stm_07_can_execute",
    "events",
    "SELECT event_id, fails >= 3 AS tripped, CASE WHEN fails < 3 THEN 'closed' WHEN ts >= last_fail + INTERVAL 60 SECOND THEN 'half_open' ELSE 'open' END AS state FROM "
    "(SELECT event_id, ts, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS fails, max(CASE WHEN event_type = 'error' THEN ts END) OVER w AS last_fail FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))",
    "A breaker that trips at three failures among the last ten calls and lets one through a minute after the last.",
)
shared("stm_09_should_run", "events", "SELECT event_id, coalesce(ts >= before + INTERVAL 23 HOUR, true) AS due FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)", "Whether at least 23 hours have passed since the run before.")
shared("stm_11_lifecycle_changes", "events", f"SELECT event_id, user_id, prev, status FROM (SELECT event_id, user_id, {STATUS} AS status, lag({STATUS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL AND prev <> status", "A record for each change of state.")
shared("stm_12_build_lease", "events", "SELECT date_trunc('day', ts) AS day, min_by(user_id, event_id) AS holder, count(DISTINCT user_id) - 1 AS refused FROM events GROUP BY date_trunc('day', ts)", "A lease a day goes to the first who asks; the others are refused.")
shared("stm_13_intent_ledger", "documents embeddings", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'pending' ELSE 'done' END AS state FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id", "Pages whose vectors were announced and not yet written.")
shared("stm_14_evolution", "documents labels", "SELECT d.lang, count(*) AS curated, sum(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS proposed, sum(CASE WHEN l.quality = 0 AND d.n_chars < 1000 THEN 1 ELSE 0 END) AS approved, sum(CASE WHEN l.quality = 0 AND d.n_chars < 1000 AND l.toxic = 0 THEN 1 ELSE 0 END) AS applied FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang", "Counters of a run: what was looked at, proposed, approved and applied.")
shared("sup_48_find_by_hash", "orders", "SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1", "Tasks that share a hash (customer, priority).")
shared("win_06_keep_newest", "orders", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k > 5", "Backups beyond the five newest of each owner, which go.")

# Publication and books ----------------------------------------------------------------------------

shared("pub_03_promote", "conversations", "SELECT conv_id, count(*) AS objects, count(DISTINCT role) AS kinds, sum(length(text)) AS bytes, max(turn) AS last FROM conversations GROUP BY conv_id HAVING count(*) > 1", "The manifest of each bundle that has more than its source.")
shared("pub_04_publish_bundle", "documents embeddings", "SELECT d.source, count(*) AS pages, count(e.vec_id) AS embedded, CASE WHEN count(*) = count(e.vec_id) THEN 'published' ELSE 'staged' END AS state FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.label IS NOT NULL GROUP BY d.source", "A bundle (a source's pages) is published when all its pages have vectors, else it stays staged.")
shared("pub_05_recover_staged", "documents embeddings", "SELECT d.doc_id, d.source FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.label IS NOT NULL WHERE e.vec_id IS NULL", "Pages that keep their bundle staged.")
CHAPTERS = "SELECT o_custkey AS chapter, o_orderkey AS unit, o_orderstatus = 'P' AS blocked, o_totalprice < 5000 AS unbound FROM orders"
shared("pub_09_compile_chapter", "orders", f"SELECT chapter, CASE WHEN bool_or(blocked) THEN 'integrity_block' WHEN bool_or(unbound) THEN 'evidence_unsupported' ELSE 'rendered' END AS outcome, count(*) AS units FROM ({CHAPTERS}) GROUP BY chapter", "A chapter is rendered as a whole or not at all: blocked units first, then unbound evidence.")
shared(
    "pub_08_rebuild_book",
    "orders customer",
    f"SELECT c_nationkey AS book, count(*) AS chapters, sum(CASE WHEN changed THEN 1 ELSE 0 END) AS rebuilt, CASE WHEN bool_or(failed AND changed) THEN 'aborted' ELSE 'written' END AS outcome FROM (SELECT chapter, bool_or(blocked) AS failed, max(unit) >= 14500 AS changed FROM ({CHAPTERS}) GROUP BY chapter) JOIN customer ON c_custkey = chapter GROUP BY c_nationkey",
    "Only chapters with changed units are rebuilt, and a failure among them aborts the book.",
)
shared("pub_07_book_snapshot", "orders customer", f"SELECT c_nationkey AS book, c_custkey AS chapter, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place, count(*) AS units, min(unit) AS first FROM ({CHAPTERS}) JOIN customer ON c_custkey = chapter GROUP BY c_nationkey, c_custkey", "The chapters of each book in order, with their units.")
shared("pub_10_release_manifest", "orders customer", "SELECT c_nationkey AS book, count(DISTINCT c_custkey) AS chapters, count(*) AS units, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey", "What a release of each book holds.")
shared("pub_14_decision_context", "conversations", "SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS question, max_by(text, turn) AS outcome, count(*) - 1 AS options FROM conversations GROUP BY conv_id", "Each decision with its question, outcome and number of options.")
shared("pub_13_recall", "documents labels embeddings", "SELECT d.doc_id, d.source, l.quality, e.label, (l.doc_id IS NOT NULL) AS decided FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id", "Objects with their provenance and decision.")
shared("sup_52_rebuild_view", "orders", "SELECT o_custkey AS view, o_orderkey AS page, CASE WHEN bool_or(o_totalprice < 2000) OVER (PARTITION BY o_custkey) THEN 'nothing_written' WHEN bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) THEN CASE WHEN o_orderstatus = 'P' AND NOT coalesce(bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'failed' ELSE 'skipped' END ELSE 'written' END AS outcome FROM orders", "Compile all first: any failure and nothing is written; then write in order, halt at the first failure and skip the rest.")

# Filters, joins, aggregates -----------------------------------------------------------------------

shared("flt_03_default_filter", "documents labels", f"SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) = 0 AND coalesce(l.quality, 1) = 1 AND {NOW} - (d.doc_id % 120) * 86400000 <= {NOW}", "Pages of the default view: verified, not quarantined, not rejected, valid now.")
shared("set_07_compare_readiness", "labels documents", "SELECT field, sum(CASE WHEN old IS DISTINCT FROM new THEN 1 ELSE 0 END) AS changed, count(*) AS records FROM (SELECT 'quality' AS field, l.quality AS old, CASE WHEN d.n_chars > 200 THEN 1 ELSE 0 END AS new FROM labels l JOIN documents d ON d.doc_id = l.doc_id UNION ALL SELECT 'toxic', l.toxic, 0 FROM labels l) GROUP BY field", "How many records differ, by field.")
shared("agg_11_judge_batch", "documents labels", "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l.toxic = 1 THEN 'reject' WHEN l.quality = 1 THEN 'pass' WHEN d.n_chars > 500 THEN 'retry' ELSE 'quarantine' END AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY verdict", "A batch split by verdict.")
shared("agg_21_reader_task", "benchmark documents", "SELECT b.item_id, count(d.doc_id) AS expected, sum(CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END) AS found, CAST(sum(CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(d.doc_id), 1) AS rate FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id GROUP BY b.item_id", "Locators found of those expected.")
shared("agg_27_prometheus", "events", "SELECT concat('corvane_events_total{type=\"', event_type, '\"} ', CAST(count(*) AS VARCHAR(20))) AS line FROM events GROUP BY event_type", "Counters in text exposition.")
shared("agg_35_gold_dataset", "benchmark documents", "SELECT coalesce(d.lang, 'none') AS tag, count(*) AS cases, count(d.doc_id) AS covered FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id GROUP BY coalesce(d.lang, 'none')", "Cases and coverage by tag.")
shared("agg_36_agent_tasks", "events", "SELECT CASE WHEN count(CASE WHEN event_type <> 'signup' THEN 1 END) = 0 THEN 0.0 ELSE CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS DOUBLE) / count(CASE WHEN event_type <> 'signup' THEN 1 END) END AS success_rate, user_id FROM events GROUP BY user_id", "Successes among tasks that ran at all; none ran is 0.")
shared("top_08_stub_order", "orders", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS importance, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders", "Stubs of each owner by importance.")
shared("sup_10_tag_distribution", "documents orders customer", "SELECT prefix, tag, count(*) AS n FROM (SELECT 'language' AS prefix, lang AS tag FROM documents UNION ALL SELECT 'src', source FROM documents UNION ALL SELECT 'priority', o_orderpriority FROM orders UNION ALL SELECT 'status', o_orderstatus FROM orders UNION ALL SELECT 'segment', c_mktsegment FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR(10)) FROM customer) GROUP BY prefix, tag", "Values of six tag prefixes.")
shared("sup_27_authorization", "orders", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS targets, bool_and(o_orderstatus = 'F') AS approved, count(DISTINCT o_orderpriority) = count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS same_targets FROM orders GROUP BY o_custkey", "An approval counts if its targets are exactly those asked for.")
shared("sup_30_error_policy", "events", "SELECT event_id, CASE WHEN value < 5 THEN 'invalid_input' WHEN value < 10 THEN 'data_consistency' WHEN value < 15 THEN 'programming' ELSE 'retryable' END AS policy FROM events WHERE event_type = 'error'", "The policy of each error's class; unknown ones are retried.")
shared("sup_32_bind_evidence", "lineitem part", "SELECT l.l_orderkey, count(DISTINCT l.l_partkey) AS cited, count(DISTINCT p.p_partkey) AS bound, count(DISTINCT l.l_partkey) = count(DISTINCT p.p_partkey) AS complete FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 5 GROUP BY l.l_orderkey", "A block is bound if every piece of evidence it cites is there.")
shared("sup_37_archive_zombies", "documents labels", "SELECT d.doc_id, CASE WHEN l.quality = 0 AND d.n_chars < 500 THEN 'archive' ELSE 'active' END AS folder FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "Pages that are moved to the archive.")
shared("sup_41_snapshot_store", "documents", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT doc_id, md5(source) AS h FROM documents WHERE n_chars > 100) a FULL JOIN (SELECT doc_id, md5(CASE WHEN lang = 'de' THEN lang ELSE source END) AS h FROM documents WHERE n_chars < 3000) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h <> b.h", "Files that were added, removed or changed between two snapshots.")
shared("sup_42_normalize_result", "documents embeddings", "SELECT coalesce(e.vec_id, d.doc_id) AS id, coalesce(d.source, 'vector') AS source, coalesce(CAST(e.label AS VARCHAR(20)), d.lang, '') AS kind, coalesce(d.n_chars, 0) AS size FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id", "Results of either search as rows of one type.")
shared("sup_46_build_index", "orders customer", "SELECT o_orderkey AS page, max_by(c_nationkey, c_custkey) AS volume, max(c_custkey) AS chapter FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey", "The volume and chapter of each page; the last one wins.")
shared("sup_49_base_type", "orders", "SELECT o_orderkey, coalesce(b.base, 'concept') AS base FROM orders LEFT JOIN (VALUES ('1-URGENT', 'synthesis'), ('2-HIGH', 'entity'), ('3-MEDIUM', 'source')) AS b(name, base) ON b.name = o_orderpriority", "The base type of custom types; concept if there is none.")
shared("sup_50_ingest_report", "documents labels", "SELECT d.source, count(*) AS pages, sum(d.n_chars) AS chars, sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) AS quarantined, count(l.doc_id) AS judged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source", "Counters of an ingest by source.")
shared("sup_39_theme_outline", "orders", "SELECT o_custkey AS volume, CASE WHEN count(*) > count(DISTINCT o_orderpriority) THEN 'invalid-chapter-id' WHEN bool_or(o_orderstatus <> 'P') AND count(*) > 5 THEN 'page-ids-not-empty' ELSE 'ok' END AS verdict FROM orders GROUP BY o_custkey", "Outlines whose chapters repeat or already have pages.")
shared("sup_38_polished_chapter", "lineitem", "SELECT l_orderkey AS chapter, count(*) = count(DISTINCT l_linenumber) AS blocks_unique, bool_and(l_quantity > 0) AS links_kept, CASE WHEN count(*) <> count(DISTINCT l_linenumber) THEN 'block_order_mismatch' WHEN NOT bool_and(l_discount < 0.1) THEN 'wikilink_mismatch' ELSE 'ok' END AS verdict FROM lineitem GROUP BY l_orderkey", "Whether polishing kept the multiset of blocks and the links.")
shared("gr_10_conflict_edge", "orders", "SELECT a AS source_id, b AS target_id, 'contradicts' AS type FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, o_orderstatus AS s, lead(o_orderstatus) OVER w AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE b IS NOT NULL AND s <> t UNION ALL SELECT b, a, 'contradicts' FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, o_orderstatus AS s, lead(o_orderstatus) OVER w AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE b IS NOT NULL AND s <> t", "Edges both ways between a customer's following orders of different status.")
shared("gr_21_tutorial_paths", "lineitem part", "SELECT l.l_orderkey AS path, sum(CASE WHEN p.p_partkey IS NULL THEN 1 ELSE 0 END) AS unknown, count(*) - count(DISTINCT l.l_partkey) AS repeated, sum(CASE WHEN p.p_partkey IS NULL THEN 1 ELSE 0 END) = 0 AND count(*) = count(DISTINCT l.l_partkey) AS valid FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 2 GROUP BY l.l_orderkey", "Paths whose steps exist and are distinct.")
shared("cnf_08_list_ids", "lineitem", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem", "The identifiers of all evidence.")
shared("fn_18_partial_overlap", "orders", "SELECT o_orderkey, same > 0 AND same < 3 AS partial, unknown AS has_unknown FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = lead(o_orderpriority) OVER w THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = lead(o_orderstatus) OVER w THEN 1 ELSE 0 END + CASE WHEN year(o_orderdate) = year(lead(o_orderdate) OVER w) THEN 1 ELSE 0 END AS same, o_orderpriority = '4-NOT SPECIFIED' OR coalesce(lead(o_orderpriority) OVER w, '4-NOT SPECIFIED') = '4-NOT SPECIFIED' AS unknown FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))", "Contexts of following orders that share some values but not all; and whether a shared dimension is unknown.")
